"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import byte_bpe, collocation, license_scan, line_dedup, media, mixing, near_dup, pii, quality, spelling, sql, token_count, toxicity, url_filter


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "pipeline": pipeline,
        "op1_license_scan": license_scan.op1_license_scan,
        "op2_url_lists": url_filter.op2_url_lists,
        "op3_token_count": token_count.op3_token_count,
        "op4_poisson_mix": mixing.op4_poisson_mix,
        "op5_near_dup": near_dup.op5_near_dup,
        "op6_line_quality": quality.op6_line_quality,
        "op7_wav_media": media.op7_wav_media,
        "op8_char_tagger": pii.op8_char_tagger,
        "op9_byte_bpe": byte_bpe.op9_byte_bpe,
        "op10_toxicity": toxicity.op10_toxicity,
        "op11_line_dedup": line_dedup.op11_line_dedup,
        "op12_spelling_variants": spelling.op12_spelling_variants,
        "op13_collocations": collocation.op13_collocations,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": sql.op1(),
        "op2_url_lists": sql.op2(),
        "op4_poisson_mix": sql.op4(),
        "op5_near_dup": sql.op5(),
        "op6_line_quality": sql.op6(),
        "op11_line_dedup": sql.op11(),
        "op12_spelling_variants": sql.op12(),
        "op13_collocations": sql.op13(),
    }
