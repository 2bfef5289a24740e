"""Quality rules, line first: bad lines go, then documents that lose too much.

Only built-in functions: every figure comes from expressions over one row, so
the plan is a scan and a projection without any shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import let, lower_ascii, table, unused

NO_SYMBOL = "[^#*$%&|<>]+"
WORD = r"[^ \t\n\x0b\f\r]"
#: Lines made of these marks and words are menus.
SEPARATORS = ("|", ">", "»", "·", "•", "/", "::")
#: What pages say in every language of the corpus, in small letters (fixed values).
BOILERPLATE = (
    # English
    "all rights reserved", "accept cookies", "cookie policy", "enable javascript", "privacy policy", "terms of use", "terms of service", "sign up", "log in", "subscribe to", "click here", "lorem ipsum",
    # German
    "alle rechte vorbehalten", "cookies akzeptieren", "cookie-richtlinie", "javascript aktivieren", "hinweise zum datenschutz", "allgemeine nutzungsbedingungen", "jetzt registrieren", "hier klicken", "newsletter abonnieren",
    # French
    "tous droits réservés", "accepter les cookies", "politique de cookies", "activer javascript", "politique de confidentialité", "conditions d'utilisation", "mentions légales", "se connecter", "cliquez ici", "abonnez-vous à",
    # Spanish
    "todos los derechos reservados", "aceptar las cookies", "política de cookies", "activar javascript", "política de privacidad", "condiciones de uso", "aviso legal", "iniciar sesión", "haga clic aquí", "suscríbete a",
)
TERMINAL = r"""[.!?:;,…。！？]["'”’»)\]]*[ \t\f\r\x0b]*$"""
PUNCTUATION = r"[^\p{L}\p{N}\p{M} \t\n\x0b\f\r]"
#: A line with at least this many words may end without a stop.
LONG_LINE = 8
#: Punctuation and symbols may make up this percentage of a line's characters.
MAX_MARKS = 12
MAX_SEPARATORS = 20
#: A document that keeps less than this percentage of its word characters goes.
MIN_LEFT = 50
MIN_WORDS, WINDOW, MAX_REPEATED = 10, 5, 20
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bad_lines", "chars_left")


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, "[ \\t\\n\\x0b\\f\\r]+"), lambda w: w != "")


def line_fails(line: Column) -> Column:
    """Whether a line breaks a punctuation or navigation rule."""
    marks = F.length(line) - F.length(F.regexp_replace(line, PUNCTUATION, ""))

    def menu(w: Column) -> Column:
        short = (F.size(w) < LONG_LINE) & ~F.regexp_like(line, F.lit(TERMINAL))
        return short | (100 * F.size(F.filter(w, lambda x: x.isin(*SEPARATORS))) > MAX_SEPARATORS * F.size(w))

    return (100 * marks > MAX_MARKS * F.length(line)) | let(words_of(line), menu)


def says_boilerplate(text: Column) -> Column:
    """Whether a text holds a boilerplate phrase, in capitals or not."""
    return let(lower_ascii(text), lambda x: reduce(Column.__or__, [F.contains(x, F.lit(p)) for p in BOILERPLATE]))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in windows found twice or more in the same text.

    Windows are told apart by their 64-bit hash. Texts without a repeated
    window, nearly all of them, need one hash set; the others sort (hash,
    place) pairs, so that no text costs more than n log n.
    """

    def covered(places: Column) -> Column:
        fresh = F.transform(places, lambda p, j: F.when(j == 0, window).otherwise(F.least(F.lit(window), p - F.get(places, j - 1))))
        return F.aggregate(fresh, F.lit(0), lambda a, x: a + x)

    def places(pairs: Column) -> Column:
        same = lambda x, other: F.coalesce(x["h"] == other["h"], F.lit(False))
        twice = F.transform(pairs, lambda x, j: F.when(same(x, F.get(pairs, j - 1)) | same(x, F.get(pairs, j + 1)), x["i"]))
        return F.sort_array(F.filter(twice, lambda i: i.isNotNull()))

    def of(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        slow = let(pairs, lambda s: let(places(s), covered))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(slow)

    def hashed(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - window)
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)]))

    return let(words, lambda w: F.when(F.size(w) < window, F.lit(0)).otherwise(let(hashed(w), of)))


def clean_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the figures and verdict of every text, and its cleaned text.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_bad_lines, chars_left (all bigint), cleaned (the lines that pass, null
    only for a null text), base_failed and kept. A null text counts as empty,
    which fails; order, repeated rows and all other columns stay as they are,
    whatever their names; only columns with one of these names give way.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    lines = F.split(value, "\n")
    blank = lambda x: ~F.regexp_like(x, F.lit(WORD))
    worded = F.filter(lines, lambda x: ~blank(x))
    sound = F.filter(lines, lambda x: blank(x) | ~line_fails(x))
    # a line can hold a phrase only if the whole text does
    said = F.when(says_boilerplate(value), F.filter(sound, lambda x: ~says_boilerplate(x))).otherwise(sound)
    own = unused([*docs.columns, *FIGURES], "_words", "_good")
    words, good = F.col(own[0]), F.col(own[1])
    solid = lambda w: F.length(F.array_join(w, ""))
    left = F.when(F.size(good) == F.size(lines), solid(words)).otherwise(solid(words_of(F.array_join(good, "\n"))))
    figures = (
        F.size(words), solid(words), F.length(F.regexp_replace(value, NO_SYMBOL, "")), let(worded, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        repeated_words(words), F.size(lines) - F.size(good), left,
    )
    cleaned = F.when(F.col(text).isNotNull(), F.array_join(good, "\n"))
    out = docs.withColumns(dict(zip(own, (words_of(value), said), strict=True)))
    out = out.withColumns({**{k: x.cast("bigint") for k, x in zip(FIGURES, figures, strict=True)}, "cleaned": cleaned})
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return out.withColumns({"base_failed": failed, "kept": ~failed & (100 * F.col("chars_left") >= MIN_LEFT * F.col("word_chars"))}).drop(*own)


def op6_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return clean_lines(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_bad_lines", "chars_left")
