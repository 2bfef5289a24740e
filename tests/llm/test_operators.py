"""Each operator against brute force or its library, on odd rows and on empty tables."""

from __future__ import annotations

import hashlib
import io
import random
import re
import wave
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, license_scan, media, mixing, pii, quality, toxicity, url_filter
from tidemark.llm import token_count as tc

try:
    import public_tokenizers
except ImportError:  # only what needs a vocabulary is left out
    public_tokenizers = None
needs_vocabulary = pytest.mark.skipif(public_tokenizers is None, reason="no public vocabularies here")

LONG = "the quick brown fox jumps. " * 8_000
TEXTS = [None, "", " ", "\n\n", "Licensed under CC BY 4.0.\nAll  rights\nreserved", "x" * 5_000, "é ß 日本語 🙂 İ", "a\x00b\tc\x0bd", "write to a.b@mail.example.com or 10.0.0.1", LONG]
SCHEMA = "doc_id bigint, text string, source string, n_words string, score string, ids string, copy int, labels string, media binary"


def docs(spark, texts=TEXTS):
    rows = [(i if i != 2 else None, t, None if i % 3 == 0 else f"s{i % 3}", "w", "s", "i", 9, "l", b"m") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[:1] if rows else rows, SCHEMA)


OPERATORS = {
    "license": license_scan.scan_licenses,
    "tokens": tc.count_tokens,
    "mix": mixing.mix,
    "quality": quality.clean_lines,
    "media": lambda d: media.read_media(media.store_media(d)),
    "pii": lambda d: pii.find_personal_data(d, TAGGER()),
    "redact": lambda d: pii.redact_documents(d, TAGGER()),
    "bpe": lambda d: byte_bpe.decode(byte_bpe.encode(d)),
    "bpe carried": lambda d: byte_bpe.decode(byte_bpe.encode(d, carry=True)),
    "toxicity": lambda d: toxicity.score_toxicity(d, toxicity.Lexicon([("idiot", True, 2.0)]).ready()),
    "drop toxic": lambda d: toxicity.drop_toxic(d, toxicity.Lexicon([("idiot", True, 2.0)]).ready()),
}
if public_tokenizers is None:
    OPERATORS = {k: v for k, v in OPERATORS.items() if k not in ("tokens", "bpe", "bpe carried")}
_tagger = []


def TAGGER():  # noqa: N802
    if not _tagger:
        _tagger.append(pii.train(["call me at the office, please do."] * 30, epochs=6))
    return _tagger[0]


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_empty_tables(spark, name):
    operator = OPERATORS[name]
    out = operator(docs(spark))
    rows = out.collect()
    if name != "mix":
        assert len(rows) == len(TEXTS) + 1
        assert Counter(r.doc_id for r in rows) == Counter([0, 0, 1, None, 3, 4, 5, 6, 7, 8, 9])
    empty = operator(docs(spark, []))
    assert empty.count() == 0 and empty.columns == out.columns
    if name in ("redact", "drop toxic"):
        assert out.columns == docs(spark).columns


NOT_UTF8 = "CAST(X'4120FF206964696F7420C3' AS STRING)"


@pytest.mark.parametrize("name", [n for n in OPERATORS if n not in ("mix", "quality")])
def test_texts_that_are_not_utf8(spark, name):
    """They are read with U+FFFD for what isn't UTF-8."""
    bad = spark.range(2).select(F.col("id").alias("doc_id"), F.expr(NOT_UTF8).alias("text"), F.lit("s").alias("source"))
    good = bad.withColumn("text", F.lit("A \ufffd idiot \ufffd"))
    assert [tuple(r) for r in OPERATORS[name](bad).collect()] == [tuple(r) for r in OPERATORS[name](good).collect()]


def test_columns_of_any_name_stay(spark):
    names = ["_words", "_good", "_WORDS", "_id", "_source", "_rate", "_n", "_salt", "_groups", "_key", "_score", "_doc_id", "_held_out", "_n_hits", "_text", "_kept0"]
    df = spark.createDataFrame([(i, "Here is a line of plain prose that ends quite well.", "s", "http://example.com") for i in range(6)], "doc_id bigint, text string, source string, url string")
    df = df.withColumns({n: F.concat(F.lit(n), F.col("doc_id")) for n in names if n != "_WORDS"}).withColumn("fetched_on", F.lit("2024-02-01").cast("date"))
    ledger = spark.createDataFrame([("l", "block", "example.com", "add")], "list_name string, kind string, key string, action string").withColumn("listed_on", F.lit("2024-01-01").cast("date"))
    lexicon = toxicity.Lexicon([("idiot", True, 2.0)]).ready()
    done = {"quality": quality.clean_lines(df), "mix": mixing.mix(df, {"s": 1.0}), "urls": url_filter.judge(df, ledger), "toxic": toxicity.drop_toxic(df, lexicon), "redact": pii.redact_documents(df, TAGGER())}
    for name, out in done.items():
        assert set(df.columns) <= set(out.columns) and len(set(out.columns)) == len(out.columns), name
        rows = out.collect()
        assert rows and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names if n in df.columns), name
    assert all(r.blocked for r in done["urls"].collect())


# -- license scans ------------------------------------------------------------------


def test_license_blocks_against_all_templates(spark):
    rng = random.Random(3)
    words = sorted({w for t in license_scan.TEMPLATES.values() for w in t.split()}) + ["foo", "bar"]
    lines = [" ".join(rng.sample(words, rng.randint(1, 14))) for _ in range(200)]
    for t in license_scan.TEMPLATES.values():
        kept = t.split()
        for _ in range(8):
            lines.append(" ".join(rng.sample(kept, max(1, len(kept) - rng.randint(0, 3))) + rng.sample(words, 3)).upper())
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")
    for threshold in (0.6, 0.8, 1.0):
        for r in license_scan.scan_licenses(df, threshold=threshold).collect():
            own = set(lines[r.doc_id].lower().split())
            want = sorted(k for k, t in license_scan.TEMPLATES.items() if len(own & set(t.split())) >= threshold * len(set(t.split())) - 1e-9)
            assert [b.label for b in r.blocks] == want, lines[r.doc_id]


WRAPPED = {
    "bsd": "/*\n * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n * are met:\n */",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice appears.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this file",
    "mit": "Released\nunder\nthe\nMIT\nlicense.",
}


def test_license_notices_over_several_lines(spark):
    far = "released " + "alpha " * 3_000 + "under " + "beta " * 3_000 + "the " + "gamma " * 3_000 + "license"
    inside = "alpha " * 3_000 + "released under the MIT license " + "beta " * 3_000
    texts = [*WRAPPED.values(), far, inside, "\n\n".join([WRAPPED["mit"]] * 3), "Released under the MIT license.\n" * 3, "eins mit zwei drei\nvier f\u00fcnf sechs sieben licensed under the Apache License, Version 2.0"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: [(b.label, b.line, b.word) for b in r.blocks] for r in license_scan.scan_licenses(df).collect()}
    for i, label in enumerate(WRAPPED):
        assert [b[0] for b in got[i]] == [label], texts[i]
    assert got[8] == [("apache-2.0", 1, 4)]
    assert got[4] == [] and got[5] == [("mit", 0, 3_000)]
    assert got[6] == [("mit", 0, 0), ("mit", 6, 5), ("mit", 12, 10)] and got[7] == [("mit", 0, 0), ("mit", 1, 5), ("mit", 2, 10)]


def test_license_runs_and_short_lines_against_brute_force(spark):
    rng = random.Random(8)
    words = sorted({w for t in license_scan.TEMPLATES.values() for w in t.split()}) + ["foo", "bar"]
    texts = []
    for t in list(license_scan.TEMPLATES.values()) * 6:
        kept = [w for w in t.split() if rng.random() > 0.12]
        for _ in range(rng.choice([0, 4, 30])):
            kept.insert(rng.randint(0, len(kept)), rng.choice(["foo", "bar", "baz"]))
        texts.append(" ".join([*rng.choices(words, k=rng.randint(0, 40)), *kept, *rng.choices(words, k=rng.randint(0, 40))]))
    rows = [(2 * i + k, x if not k else "".join(rng.choice([" ", "\n", " \n\n"]) if c == " " else c for c in x)) for i, x in enumerate(texts) for k in (0, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    seen = Counter()
    for r in license_scan.scan_licenses(df).collect():
        own, want = texts[r.doc_id // 2].split(), set()
        lines = [x.split() for x in rows[r.doc_id][1].split("\n")]
        for label, t in license_scan.TEMPLATES.items():
            size, width = len(set(t.split())), license_scan.window_of(t)
            runs = [own[i : i + width] for i in range(len(own))] + [x for x in lines if len(x) <= max(width, license_scan.SHORT_LINE)]
            if any(len(set(x) & set(t.split())) >= 0.8 * size - 1e-9 for x in runs):
                want.add(label)
        assert {b.label for b in r.blocks} == want, own
        seen[bool(want)] += 1
    assert seen[True] > 20 and seen[False] > 5


def test_license_places(spark):
    got = license_scan.scan_licenses(docs(spark)).filter("doc_id = 4").first()
    assert [(p.label, p.word) for p in got.places] == [("cc-by", 2), ("reserved", 6)] and got.n_words == 9


def test_license_passes_find_what_one_does(spark, monkeypatch):
    df = spark.createDataFrame(list(enumerate([*license_scan.TEMPLATES.values(), " ".join(license_scan.TEMPLATES.values()), None])), "doc_id bigint, text string")
    want = {r.doc_id: r for r in license_scan.scan_licenses(df).collect()}
    monkeypatch.setattr(license_scan, "PASS_WORDS", 20)
    assert [len(p) for p in license_scan.passes(license_scan.TEMPLATES, 20)] == [1, 2, 2, 2, 1, 2, 1, 2]
    assert {r.doc_id: r for r in license_scan.scan_licenses(df).collect()} == want and len(want[13].blocks) > 5


# -- URL lists -----------------------------------------------------------------------


def test_url_lists_against_brute_force(spark):
    rng = random.Random(1)
    keys = ["example.com", "a.example.com", "b.a.example.com", "example.org", "com"]
    day = lambda: f"2024-{rng.randint(1, 3):02}-{rng.randint(1, 28):02}"
    entries = [(rng.choice(["l1", "l2"]), rng.choice(["block", "block", "allow"]), rng.choice(keys), day(), rng.choice(["add", "add", "remove"])) for _ in range(60)] + [(None, "block", "com", "2024-01-01", "add"), ("l1", "block", None, "2024-01-01", "add")]
    urls = ["http://b.a.example.com/x", "https://u:p@A.example.com:80/?q", "http://example.org.", "ftp://other.net#x", "no url", None, "http://", "http://com/"]
    captures = [(i, rng.choice(urls), rng.choice([day(), day(), None])) for i in range(150)]
    df = spark.createDataFrame(captures, "page_id int, url string, d string").select("page_id", "url", F.col("d").cast("date").alias("fetched_on"), F.lit("x").alias("host"), F.lit("y").alias("key"))
    ledger = spark.createDataFrame(entries, "list_name string, kind string, key string, d string, action string").withColumn("listed_on", F.col("d").cast("date")).drop("d")
    got = {r.page_id: r for r in url_filter.judge(df, ledger).collect()}
    assert len(got) == 150
    hosts = dict(zip(urls, ["b.a.example.com", "a.example.com", "example.org", "other.net", None, None, None, "com"], strict=True))
    for i, url, at in captures:
        host, active = hosts[url], []
        if host and at:
            parts = host.split(".")
            for key in {".".join(parts[k:]) for k in range(len(parts))}:
                for name, kind in {(e[0], e[1]) for e in entries if e[2] == key and e[0]}:
                    last = max((e[3] for e in entries if e[:3] == (name, kind, key) and e[3] <= at), default=None)
                    if last and all(e[4] == "add" for e in entries if e[:4] == (name, kind, key, last)):
                        active.append((len(key), kind, name, key))
        r = got[i]
        longest = lambda k, a=active: max((x[0] for x in a if x[1] == k), default=0)
        assert r.host == host and r.n_active == len(active) and r.blocked == (longest("block") > longest("allow")), (url, at)
        assert r.active_lists == ",".join(sorted({x[2] for x in active})) and r.matched_key == (max(active)[3] if active else None)
    assert url_filter.judge(df, ledger.limit(0)).filter("blocked").count() == 0 and url_filter.judge(df.limit(0), ledger).count() == 0


# -- token counts --------------------------------------------------------------------


@needs_vocabulary
def test_token_counts_are_the_library_s():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(tc.MODEL))
    counts, rng = tc.load(None), random.Random(1)
    letters = " \t\n\x00abcdeéñ½日本①ﬁ▁<s>AZ_.,-'\"01 23​🙂ß"
    for i in range(3_000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        n = len(model.encode(text))
        for chunk in (1 << 16, 1, 3, 8):
            assert tc.count_text(text, counts, chunk) == n, (text, chunk)
    for text in (LONG, "ab" * 30_000, " " * 5_000, *filter(None, TEXTS)):
        assert tc.count_text(text, counts) == tc.count_text(text, counts, 1000) == len(model.encode(text))


@needs_vocabulary
def test_chunk_maps_compose_in_any_grouping():
    counts, rng = tc.load(None), random.Random(2)
    for letters, size in (("abc▁▁ñ日", 7), ("aba", 90), ("a", 101)):
        text = tc.MARK + "".join(rng.choice(letters) for _ in range(900))
        maps = [tc.map_of(text[i : i + size], text[max(0, i - 128) : i], counts) for i in range(0, len(text), size)]
        total = tc.scan(maps)(tc.START)
        left = maps[0]
        for m in maps[1:]:
            left = left.then(m)
        right = maps[-1]
        for m in reversed(maps[:-1]):
            right = m.then(right)
        assert total == left(tc.START) == right(tc.START) and total[1] == tc.count_text(text[1:], counts, 1 << 20)


@needs_vocabulary
def test_long_texts_are_counted_in_chunks(spark, monkeypatch):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(tc.MODEL))
    rng = random.Random(4)
    texts = ["a" * 3_000, "ab" * 1_700, "".join(rng.choices("abcdeñ日 ", k=4_000)), "".join(rng.choices("etaoins", k=5_000)), " " * 2_500, "the quick brown fox " * 200, "é" * 2_100, None, "", "short"]
    rows = [(i if i != 2 else None, t) for i, t in enumerate(texts)] + [(0, texts[0]), (0, texts[1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = sorted(((d, len((t or "").encode()), len(model.encode(t)) if t else 0) for d, t in rows), key=str)
    monkeypatch.setattr(tc, "LONG", 2_000)
    for chunk, shifts in ((300, 16), (1_000, 16), (300, 1)):
        monkeypatch.setattr(tc, "CHUNK", chunk)
        monkeypatch.setattr(tc, "SHIFTS", shifts)
        assert sorted((tuple(r) for r in tc.count_tokens(df).collect()), key=str) == want
    megabytes = "".join(rng.choices("etaoinshrdlu", k=2_000_000))
    assert tc.count_text(megabytes, tc.load(None)) == len(model.encode(megabytes))


# -- mixing ----------------------------------------------------------------------------


def test_poisson_counts_have_the_mean_and_variance_of_their_rate(spark):
    for rate in (0.2, 1.0, 7.5, 1_300.0):
        n = spark.range(4_000).select(mixing.repetitions(F.lit(rate), "s", F.col("id").cast("string")).alias("n")).agg(F.avg("n"), F.var_samp("n")).first()
        assert abs(n[0] - rate) < 5 * (rate / 4_000) ** 0.5 and abs(n[1] / rate - 1) < 0.15


def test_many_sources_and_rows_without_id(spark, monkeypatch):
    rows = [(i if i % 2 else None, f"text {i} " + "x" * (i % 30), f"s{i % 7}" if i % 3 else "big") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    weights = {"big": 3.0, **{f"s{k}": 1.0 for k in range(7)}}
    want = sorted(tuple(r) for r in mixing.mix(df, weights).select("text", "source", "copy").collect())
    monkeypatch.setattr(mixing, "MAX_BROADCAST_SOURCES", 2)
    assert sorted(tuple(r) for r in mixing.mix(df, weights).select("text", "source", "copy").collect()) == want
    unnamed = spark.createDataFrame([(None, f"text {i}", "a") for i in range(2_000)] + [(1, "y" * 40_000, "b")], "doc_id bigint, text string, source string")
    n = mixing.mix(unnamed, {"a": 1.0, "b": 1.0}).filter("source = 'a'").count()
    rate = mixing.source_rates(unnamed, {"a": 1.0, "b": 1.0}).filter("source = 'a'").first().rate
    assert abs(n / 2_000 / rate - 1) < 0.1


def test_mixture_meets_its_weights(spark):
    rows = [(i, "x" * (50 + i % 50), ("a", "a", "a", "b", None)[i % 5]) for i in range(6_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = mixing.mix(df, {"a": 1.0, "b": 2.0, "": 1.0})
    chars = {r[0]: r[1] for r in out.groupBy("source").agg(F.sum(F.length("text"))).collect()}
    total = sum(chars.values())
    assert abs(chars["a"] / total - 0.25) < 0.02 and abs(chars["b"] / total - 0.5) < 0.02 and abs(total / sum(len(r[1]) for r in rows) - 1) < 0.05
    first = out.select("doc_id", "copy").orderBy("doc_id", "copy").collect()
    assert first == mixing.mix(df.repartition(7), {"a": 1.0, "b": 2.0, "": 1.0}).select("doc_id", "copy").orderBy("doc_id", "copy").collect()
    assert mixing.mix(df, {"a": 1.0}).select("source").distinct().collect()[0][0] == "a"
    ids = [r.doc_id for r in out.limit(300).collect()]
    assert abs(np.corrcoef(ids, range(300))[0, 1]) < 0.3


# -- quality ----------------------------------------------------------------------------


def test_quality_figures_against_python(spark):
    rng = random.Random(4)
    texts = ["\n".join(" ".join(rng.choice(["a", "bb", "c#", "|", "é", "ccc."]) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 9))) for _ in range(120)] + [t for t in TEXTS if t]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in quality.clean_lines(df).collect():
        t = texts[r.doc_id]
        words = [w for w in re.split("[ \t\n\x0b\f\r]+", t) if w]
        assert r.n_words == len(words) and r.word_chars == sum(map(len, words)) and r.n_symbols == len(re.findall(r"[#*$%&|<>]", t))
        lines = [x for x in t.split("\n") if re.search("[^ \t\n\x0b\f\r]", x)]
        assert r.n_dup_lines == len(lines) - len(set(lines))
        grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        often = Counter(grams)
        covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(5)}
        assert r.n_repeat_words == len(covered) and r.base_failed == (len(words) < 10 or 100 * len(covered) > 20 * len(words))
        assert r.cleaned.count("\n") + 1 == t.count("\n") + 1 - r.n_bad_lines or r.n_bad_lines == t.count("\n") + 1


def test_quality_verdicts(spark):
    good = "Here is a line of plain prose that ends well.\nAnother line follows it, and it ends too."
    bad = {"menu": "Home | About | Shop | Contact | News | Help | More | Jobs", "marks": "we### are$$$ all%%% full&&& of*** marks### and$$$ signs%%% here&&& now***", "shout": "VERY!! LOUD!! TEXT!! IS!! HERE!! AND!! THERE!! AND!! ALL!! OVER!!", "short": "one\ntwo\nthree\nfour\nfive\nsix\nseven\neight\nnine\nten\neleven"}
    df = spark.createDataFrame([("good", good), ("both", good + "\nAll rights reserved."), *bad.items()], "k string, text string")
    got = {r.k: r for r in quality.clean_lines(df).collect()}
    assert got["good"].kept and got["both"].kept and got["both"].cleaned == good and not any(got[k].kept for k in bad)


# -- media --------------------------------------------------------------------------------


def test_media_round_trip_and_fingerprint(spark):
    for r in media.read_media(media.store_media(docs(spark))).collect():
        if r.doc_id is None:
            continue
        data = (TEXTS[r.doc_id] or "").encode()
        payload = data + b"\0" * (-len(data) % 64 or (0 if data else 64))
        assert r.n_bytes == len(data) and r.payload_bytes == len(payload) and len(payload) % 64 == 0 and len(payload) > 0
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        with wave.open(io.BytesIO(media.to_wav(payload))) as f:
            assert f.readframes(f.getnframes()) == payload
    tone = (128 + 60 * np.sin(2 * np.pi * 40 * np.arange(4096) / media.WINDOW)).astype(np.uint8).tobytes()
    assert (media.peaks_of(tone)[:-1, 0] == 40).all()
    t, c = media.fingerprint(tone)
    assert len(t) == len(c) and (np.diff(t) >= 0).all() and set((c >> 14).tolist()) <= set(range(257))
    assert len(media.fingerprint(b"\0" * 64)[0]) == 0


def plain_fingerprint(samples):
    """The fingerprint by the transform's definition, letter by letter."""
    short = len(samples) <= media.WINDOW
    size, hop, bands = (media.SHORT_WINDOW, media.SHORT_HOP, media.SHORT_BANDS) if short else (media.WINDOW, media.HOP, media.BANDS)
    before = size - hop if short else 0
    n = -(-(before + len(samples)) // hop) if short else max(1, -(-(len(samples) - size) // hop) + 1)
    sound = ([128] * before + list(samples) + [128] * size * 2)[: size + (n - 1) * hop]
    shape = [0.5 - 0.5 * np.cos(2 * np.pi * (k + short) / (size + (1 if short else -1))) for k in range(size)]
    turn = np.exp(-2j * np.pi * np.outer(np.arange(size // 2 + 1), np.arange(size)) / size)
    peaks, found = {}, []
    for f in range(n):
        part = sound[f * hop : f * hop + size]
        mean = 128 if short else sum(part) / size
        power = [round(abs(sum(turn[k] * [(x - mean) * w for x, w in zip(part, shape, strict=True)])), 3) for k in range(size // 2 + 1)]
        for b, (low, high) in enumerate(bands):
            best = max(range(low, high), key=lambda k, p=power: (p[k], -k))
            if power[best] >= media.LEAST:
                peaks[f, b] = best
                if short:
                    found.append((f, (best << 20) | (int(np.round(power[best] / media.LOUDNESS)) << 4)))
    for (f, b), k in peaks.items():
        found += [(f, (k << 14) | (other << 4) | (g - f)) for (g, c), other in peaks.items() if 0 < g - f <= media.AHEAD or (g == f and c > b)]
    return sorted(found)


def test_fingerprints_by_the_definition_of_the_transform():
    rng = random.Random(7)
    samples = [b"\xff" * 40 + b"a" * 24, bytes(rng.choices(b"abcdefgh ", k=64)), bytes(rng.choices(b"abcdefgh ", k=512)), bytes(rng.choices(b"abcdefgh ,.", k=1_600)), b"\0" * 700 + bytes(rng.choices(b"xyz", k=580)) + b"\0" * 1_280]
    for x in samples:
        times, codes = media.fingerprint(x)
        assert list(zip(times.tolist(), codes.tolist(), strict=True)) == plain_fingerprint(x), x[:20]
    # silence has no peaks, and peaks are paired across bands
    assert [len(c) for c in media.fingerprint(b"\0" * 4_096)] == [0, 0] and (media.peaks_of(samples[-1])[-3:] == -1).all()
    firsts, seconds = (set(((media.fingerprint(samples[3])[1] >> s) & 511).tolist()) for s in (14, 4))
    assert any(x < 64 for x in firsts) and any(x >= 64 for x in seconds)


def test_files_that_are_not_media(spark):
    wav = media.to_wav(b"ab" * 32)
    stereo = io.BytesIO()
    with wave.open(stereo, "wb") as f:
        f.setnchannels(2)
        f.setsampwidth(1)
        f.setframerate(8_000)
        f.writeframes(b"ab")
    rows = [(1, 2, wav), (2, 2, None), (3, 2, b"not a file"), (4, 2, b""), (5, 2, stereo.getvalue()), (6, 2, wav[:20])]
    got = {r.doc_id: r for r in media.read_media(spark.createDataFrame(rows, "doc_id bigint, n_bytes bigint, media binary")).collect()}
    assert got[1].payload_bytes == 64 and all(got[i].n_bytes == 2 for i in got)
    assert all(got[i][c] is None for i in (2, 3, 4, 5, 6) for c in ("payload_bytes", "payload_sha256", "media_bytes", "times", "codes"))


def test_short_media_have_fingerprints_of_their_own(spark):
    rng = random.Random(6)
    texts = [chr(c) for c in range(1, 128)] + ["ab", "ba", "abc", "cab", "x" * 64, "x" * 65, "y" * 512, "x" * 512, "x" * 513]
    texts += ["".join(rng.choices("abcdefgh ", k=rng.randint(3, 512))) for _ in range(300)]
    texts = sorted(set(texts))
    df = spark.createDataFrame([*enumerate(texts), (-1, ""), (-2, None)], "doc_id bigint, text string")
    got = {r.doc_id: (tuple(r.times), tuple(r.codes)) for r in media.read_media(media.store_media(df)).collect()}
    assert got[-1] == got[-2] == ((), ()) and all(got[i][1] for i in range(len(texts)))
    assert len({got[i] for i in range(len(texts))}) == len(texts)


# -- personal data --------------------------------------------------------------------------


def test_base_patterns_against_plain_regular_expressions():
    rng = random.Random(5)
    letters = "ab.@-+_%0123456789 ()x\n"
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

    def plain(t):
        out = [(m.start(), m.end(), 0) for m in email.finditer(t)]
        out += [(m.start(), m.end(), 1) for m in ip.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
        digits = lambda m: re.sub("[^0-9]", "", m[0])
        out += [(m.start(), m.end(), 2) for m in card.finditer(t) if 14 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
        out += [(m.start(), m.end(), 3) for m in phone.finditer(t) if 10 <= len(digits(m)) <= 15]
        return sorted(out, key=lambda x: (x[0], x[2], x[1]))

    for _ in range(4_000):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(t) == plain(t), t
    for t in ("4465758382889437 4465758382889437", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "+1 (663) 555-6869", "300.1.1.1", "00000000000001.1.1.1"):
        assert pii.base_spans(t) == plain(t), t
    assert len(pii.base_spans("1" * 200_000 + "@" * 50_000)) == 0


def test_gradients_are_derivatives():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in pii.Tagger.fresh(rng).p.items()}
    x, y, keep = rng.integers(1, 97, (3, 7)), rng.integers(0, pii.TAGS, (3, 7)), np.ones((3, 7), bool)
    keep[1, 5:] = False
    _, g = pii.gradients(p, x, y, keep)
    for k in p:
        i = tuple(rng.integers(0, s) for s in p[k].shape) if k != "emb" else (x[0, 2], 1)
        sides = []
        for h in (1e-3, -1e-3):
            q = {a: b.copy() for a, b in p.items()}
            q[k][i] += h
            sides.append(pii.gradients(q, x, y, keep)[0])
        assert abs((sides[0] - sides[1]) / 2e-3 - g[k][i]) < 1e-3, k


def test_windows_agree_with_the_whole_and_decoding_with_viterbi():
    rng = np.random.default_rng(2)
    trans = TAGGER().p["trans"]
    for _ in range(300):
        e = rng.normal(size=(60, pii.TAGS)).astype(np.float32) * 3
        e[:, 0] += 3
        assert (pii.decode(e, trans) == pii._viterbi(e, trans, 0, 60)).all()
    for n in (1, 319, 320, 321, 576, 577, 1000):
        starts = pii.window_starts(n)
        assert starts[0] == 0 and starts[-1] + min(pii.WINDOW, n) == n
    assert [len(t) for t in pii.tag_texts(TAGGER(), ["", "a", "b" * 700])] == [0, 1, 700]


def test_tagger_finds_what_patterns_miss():
    rng = random.Random(9)
    words = [" ".join(rng.choice(["some", "plain", "words", "stand", "here", "and", "there"]) for _ in range(40)) for _ in range(60)]
    tagger = pii.train(words)
    card = pii._with_check("446575838288943")
    text = f"{words[0]} {card} {card} {words[1]} 8f3a9c27d1e64b50a2c4e6f80912ab34cd56ef70 {words[2]} 10.1.2.3 {words[3]}"
    base, spans = pii.all_spans(text, pii.tag_texts(tagger, [text])[0])
    assert set(base) <= set(spans) and [text[s:e] for s, e, k in base] == ["10.1.2.3"]
    assert [text[s:e] for s, e, k in spans].count(card) == 2 and "8f3a9c27d1e64b50a2c4e6f80912ab34cd56ef70" in [text[s:e] for s, e, _ in spans]
    clean, tags = words[5:30], pii.tag_texts(tagger, words[5:30])
    assert not any(pii.all_spans(t, g)[1] for t, g in zip(clean, tags, strict=True))
    out = pii.redact(text, spans)
    assert card not in out and "[IP]" in out and out.count("[CARD]") == 2


# -- byte-level BPE -----------------------------------------------------------------------------


@needs_vocabulary
def test_byte_bpe_is_the_library_s():
    import tiktoken

    with open(public_tokenizers.path(byte_bpe.RANKS), "rb") as f:
        ranks = byte_bpe.read_ranks(f)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    bpe, rng = byte_bpe.load(None), random.Random(1)
    letters = " \t\n\x00abcdeéñ½日本①ﬁ'sre<AZ_.,-01 23​🙂ß　"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3_000)] + ["abcdethou" * 4_000, LONG, "<|endoftext|>"]
    for t in texts:
        ids = bpe.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(t) and bpe.decode(ids) == t.encode()


def test_perfect_hash():
    rng = random.Random(2)
    values = {bytes(rng.randrange(256) for _ in range(rng.randint(1, 9))): i for i in range(5_000)}
    h = byte_bpe.PerfectHash(values)
    assert all(h.find(k) == v for k, v in values.items()) and None not in h.keys and len(h.keys) == len(values)
    assert h.find(b"not in there at all") is None and byte_bpe.PerfectHash({}).find(b"a") is None


# -- toxicity ----------------------------------------------------------------------------------


def test_folding_exceptions_and_word_ends():
    x = toxicity.Lexicon([("idiot", True, 2.0), ("scum", False, 1.0)]).ready()
    hits = lambda t: len(x.hits(toxicity.fold(t)))
    assert hits("you IDIOT") == hits("1d10t!") == hits("іdіоt") == hits("id!ot") == hits("ｉｄｉｏｔ") == hits("i​diot") == 1
    assert hits("idiots") == 0 and hits("scumbag") == 1 and hits("viscum") == 0 and hits("pond scum") == 0 and hits("pond scum, scum") == 1
    assert x.weight("idiot") > x.weight("idiot " + "word " * 3_000) > 0 == x.weight(None) == x.weight("")
    assert x.score(0) == 0 and x.score(x.scale) == pytest.approx(toxicity.THRESHOLD) and toxicity.Lexicon([], ()).ready().hits("idiot") == []


def test_learning_from_labels(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8)))
    rows, marks = [], []
    for i in range(900):
        toxic = i % 4 == 0
        text = [word() for _ in range(60)]
        for _ in range(2 * toxic):
            text[rng.randrange(60)] = "zorgul" + word()
        rows.append((i, " ".join(text)))
        marks.append((i, int(toxic)))
    marks += [(None, 1), (5000, 1), (3, None), (4, 0)]
    docs_, labels = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(marks, "doc_id bigint, toxic int")
    x = toxicity.learn(docs_, labels)
    assert any(p.startswith("zorg") and not whole for p, whole, _ in x.entries)
    got = toxicity.score_toxicity(docs_, x).collect()
    out = [(r.predicted, r.doc_id % 4 == 0) for r in got if r.held_out]
    assert sum(a == b for a, b in out) / len(out) > 0.97 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    none = toxicity.learn(docs_, labels.limit(0))
    assert {w for w, _, _ in none.entries} == set(toxicity.SEEDS)
    assert toxicity.labelled(docs_, labels, 50).count() == 50


def test_lexicon_against_a_plain_search(spark):
    """Scores by looking for each entry at each place, without an automaton."""
    rng = random.Random(11)
    entries = [("idiot", True, 2.0), ("scum", False, 1.5), ("scumb", True, 3.0), ("trash", False, 1.0), ("ash", True, 4.0)]
    x = toxicity.Lexicon(entries).ready()
    parts = ["idiot", "scum", "scumb", "scumbag", "trash", "trash can", "trashcan", "pond scum", "ash", "wash", "1d10t", "five", "i-d", "\u0456diot", "clown fish"]
    texts = [rng.choice(["", " ", "- "]).join(rng.choice([*parts, *" ,.x"]) for _ in range(rng.randint(1, 14))) for _ in range(600)]

    def plain(text):
        t, best = toxicity.fold(text), {}
        word = lambda i: 0 <= i < len(t) and t[i].isalnum()
        covered = []
        for phrase in map(toxicity.fold, x.exceptions):
            covered += [(i, i + len(phrase)) for i in range(len(t)) if t.startswith(phrase, i) and not word(i - 1) and not word(i + len(phrase))]
        for pattern, whole, weight in entries:
            for i in range(len(t)):
                if t.startswith(pattern, i) and not word(i - 1) and not (whole and word(i + len(pattern))) and weight > best.get(i, (0, 0))[0]:
                    best[i] = (weight, i + len(pattern))
        total = sum(w for i, (w, e) in best.items() if not any(a <= i and e <= b for a, b in covered))
        return total / (1 + len(t) / toxicity.NORM) ** toxicity.POWER

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in toxicity.score_toxicity(df, x).collect():
        assert r.score == pytest.approx(x.score(plain(texts[r.doc_id]))), texts[r.doc_id]


def test_windows_give_what_the_whole_text_gives(spark):
    """Spans by windows against the network run over each whole text at once and Viterbi over all places."""
    rng, tagger = random.Random(12), TAGGER()
    words = lambda n: " ".join(rng.choice(["some", "plain", "words", "stand", "here"]) for _ in range(n))
    texts = [f"{words(60)} jo.doe@mail.example.com {words(70)} 10.0.0.1 {words(90)} +1 (663) 555-6869 {words(k)}" for k in range(0, 80, 8)]
    same = total = 0
    for text, tags in zip(texts, pii.tag_texts(tagger, texts), strict=True):
        x = pii.classes_of(text)
        whole = pii._viterbi(tagger.emissions(x[None], np.array([len(x)]))[0], tagger.p["trans"], 0, len(x))
        same, total = same + int((whole == tags).sum()), total + len(tags)
        base, spans = pii.all_spans(text, tags)
        assert set(base) <= set(spans) and {k for _, _, k in base} == {0, 1, 3}
    assert same / total > 0.99
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = {i: [(pii.KINDS[k], s, e) for s, e, k in pii.all_spans(t, g)[1]] for i, (t, g) in enumerate(zip(texts, pii.tag_texts(tagger, texts), strict=True))}
    assert {r.doc_id: [tuple(s) for s in r.spans] for r in pii.find_personal_data(df, tagger).collect()} == want


@needs_vocabulary
@pytest.mark.parametrize("name", ["op3_token_count", "op7_wav_media", "op8_char_tagger", "op9_byte_bpe", "op10_toxicity"])
def test_queries_over_their_whole_table(spark, name):
    """The contracts' columns of each text, made again without the operator."""
    from pathlib import Path

    import sentencepiece
    import tiktoken

    from tidemark.llm import entry

    if not Path("/root/testdata/sf0.001").exists():
        pytest.skip("no test tables here")
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()}
    rows = entry.queries()[name](spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    if name.startswith("op3"):
        model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(tc.MODEL))
    with open(public_tokenizers.path(byte_bpe.RANKS), "rb") as f:
        library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(f), special_tokens={}) if name.startswith("op9") else None
    for r in rows:
        text, data = texts[r.doc_id], texts[r.doc_id].encode()
        if name.startswith("op3"):
            n = len(model.encode(text))
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(data), n, n > 4096)
        elif name.startswith("op7"):
            payload = media.payload_of(data)
            times, codes = (",".join(map(str, x.tolist())) for x in media.fingerprint(payload))
            assert (r.n_bytes, r.payload_sha256, r.media_sha256) == (len(data), sha(payload), sha(media.to_wav(payload))) and r.feature == f"{times};{codes}"
        elif name.startswith("op8"):
            base = pii.base_spans(text)
            said = [f"{pii.KINDS[k]}:{s}:{e}" for s, e, k in base]
            assert r.base_sha256 == sha(",".join(said).encode()) and set(said) <= set(r.spans.split(",")) | {""}
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, _, k in base) for i in range(4)]
        elif name.startswith("op9"):
            ids = library.encode_ordinary(text)
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(data))
        else:
            assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


# -- the operators' SQL and the pipeline -----------------------------------------------------------


@pytest.mark.parametrize("name", ["op1_license_scan", "op2_url_lists", "op4_poisson_mix", "op5_near_dup", "op6_line_quality"])
def test_query_against_sql(spark, name):
    import sys
    from pathlib import Path

    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from test_queries import DATA, compare

    from tidemark.llm import entry

    if not DATA.exists():
        pytest.skip("no test tables here")
    compare(spark, entry.queries()[name], entry.oracle_sql()[name])


@needs_vocabulary
def test_pipeline_against_its_parts(spark, tmp_path):
    import corpus_pipeline as cp

    base = "here is a text with some words that goes on and on until it is long enough"
    rows = [(i, f"{base} {' '.join(f'w{i}x{j}' for j in range(40))}", "en", f"s{i % 2}", 1) for i in range(30)]
    rows += [(100 + i, rows[i][1], "en", "s0", 1) for i in range(5)] + [(200, "you idiot idiot idiot moron", "en", "s1", 1), (201, None, None, None, None), (202, rows[7][1] + " mail to jo.doe@mail.example.com", "en", "s0", 1)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 0) for i in range(30)] + [(200, 1)], "doc_id bigint, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs_ = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in cp.STAGES:
        before, docs_ = docs_, stage(spark, docs_, str(tmp_path))
        docs_.write.parquet(str(tmp_path / name))
        docs_ = spark.read.parquet(str(tmp_path / name))
        kept[name] = [r.doc_id for r in docs_.collect()]
        if name != "byte_bpe":
            assert docs_.columns == before.columns
    assert 200 not in kept["toxicity"] and len(kept["toxicity"]) == 37
    assert sorted(kept["near_dup"]) == sorted([*range(30), 201])
    assert sorted(kept["pii"]) == sorted(kept["near_dup"])
    assert set(kept["mixing"]) <= set(kept["pii"]) and docs_.filter("NOT round_trip").count() == 0
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_dup", "pii", "mixing", "byte_bpe"] and cp.ORACLE_SQL is None
