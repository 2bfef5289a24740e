"""Spelling variants by anagram hashing.

A word's key is the sum of its letters' fifth powers, so anagrams have one key,
and taking a letter out takes its power off. A word is filed under its own key
and under its key less each of its letters: words one letter apart then meet
under a key, as one is what is left of the other (an addition or a removal), or
as both leave the same when a letter of each is out (an exchange). Keys that
only one word is filed under go.

Letters under a key may stand in any order, and order is verified: each filing
is told apart by the place where the letter was taken out and by a hash of what
is left, in order. Words of one key, rest and place differ in that letter alone;
words of one key and rest are one letter longer than the word that is that rest.
Such groups can't be larger than letters times places, so near words are
counted, and the commonest of them found, without any pair being made, however
many words a key has.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

from tidemark.llm.common import hot_join, map_text, scratch_dir, stored, table

#: Words have at least so many letters and occurrences; a form has so many times its word's occurrences.
LEAST_LETTERS, LEAST_COUNT, TIMES = 7, 2, 10
#: One in so many of a document's words loses a letter before words are counted.
SLIP = 31
POWER = 5
#: The rest of a word is hashed as the number that its letters are in this base, by this modulus (a prime).
BASE, MODULUS = 1_000_003, (1 << 61) - 1
_RUN = re.compile(r"[a-zÀ-ÿ]+")

_COUNTED = StructType([StructField("word", StringType()), StructField("n", LongType())])
_FILED = StructType([StructField("word", StringType()), StructField("n", LongType()), StructField("key", LongType()), StructField("letter", StringType())])
_PLACED = StructType([StructField("word", StringType()), StructField("n", LongType()), StructField("key", LongType()), StructField("place", IntegerType()), StructField("rest", LongType()), StructField("first", BooleanType())])


def slipped(doc_id: object, word: str, slip: int = SLIP) -> str:
    """The word, or what a slip leaves of it: for one in slip of a document's words, by CRC-32, a letter is missing."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    if h % slip:
        return word
    i = h % len(word)
    return word[:i] + word[i + 1 :]


def count_words(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, slip: int | None = SLIP) -> DataFrame:
    """(word, n): runs of letters A-Z, a-z and À-ÿ with A-Z in small letters, after slips, that are long and frequent enough.

    A null text has none; a null doc_id counts as an empty one; rows that are
    there twice count twice; other columns are ignored; no rows, no words. Bytes
    that aren't UTF-8 are no letters. slip=None: words as they are.
    """

    def counted(ids: list, texts: list) -> dict[str, list]:
        total: Counter[str] = Counter()
        for i, x in zip(ids, texts, strict=True):
            if not x:
                continue
            # bytes know only ASCII letters, so no other letter changes
            runs = Counter(w for w in _RUN.findall(x.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")) if len(w) >= least_letters)
            if slip is None:
                total.update(runs)
                continue
            for w, n in runs.items():
                w = slipped(i, w, slip)
                if len(w) >= least_letters:
                    total[w] += n
        return {"word": list(total), "n": list(total.values())}

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return map_text(rows, counted, ["doc_id", "text"], _COUNTED).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _signed(key: int) -> int:
    """The key as a signed 64-bit number: sums of very long words go round, which equal sums do alike."""
    return ((key + (1 << 63)) & ((1 << 64) - 1)) - (1 << 63)


def anagram_key(word: str) -> int:
    return sum(ord(c) ** POWER for c in word)


def _filed(words: list, counts: list) -> dict[str, list]:
    out: dict[str, list] = {name: [] for name in _FILED.names}
    for w, n in zip(words, counts, strict=True):
        key = anagram_key(w)
        for letter in (None, *sorted(set(w))):
            out["word"].append(w)
            out["n"].append(n)
            out["key"].append(_signed(key - ord(letter) ** POWER if letter else key))
            out["letter"].append(letter)
    return out


def _placed(words: list, counts: list, keys: list, letters: list) -> dict[str, list]:
    """Each filing at each place of its letter; place -1: the whole word. first: the place is the first of a stretch of equal letters."""
    out: dict[str, list] = {name: [] for name in _PLACED.names}

    def add(w: str, n: int, key: int, place: int, rest: int, first: bool) -> None:
        for name, value in zip(_PLACED.names, (w, n, key, place, rest, first), strict=True):
            out[name].append(value)

    for w, n, key, letter in zip(words, counts, keys, letters, strict=True):
        if letter is None:
            add(w, n, key, -1, _hashed(w), False)
            continue
        # from the left: the number before the letter; from the right: the one after it, and its weight
        before, left = [], 0
        for c in w:
            before.append(left)
            left = (left * BASE + ord(c)) % MODULUS
        after, weight = 0, 1
        for i in range(len(w) - 1, -1, -1):
            c = w[i]
            if c == letter:
                add(w, n, key, i, (before[i] * weight + after) % MODULUS, i == 0 or w[i - 1] != c)
            after = (after + ord(c) * weight) % MODULUS
            weight = weight * BASE % MODULUS
    return out


def _hashed(word: str) -> int:
    h = 0
    for c in word:
        h = (h * BASE + ord(c)) % MODULUS
    return h


def near_words(words: DataFrame, folder: str) -> DataFrame:
    """(word, n_near, best): for each of words (word, n; a word once) with near ones, how many, and (-n, word) of the commonest, the first of equals."""
    filed = stored(map_text(words, _filed, ["word", "n"], _FILED, text="word"), folder, "filed")
    # an own key alone stands for anagrams, which aren't near
    shared = stored(filed.groupBy("key").agg(F.count("*").alias("n"), F.count("letter").alias("taken")).filter("n > 1 AND taken > 0"), folder, "shared")
    met = hot_join(filed, shared.select("key"), "key", "word", "left_semi", counts=shared.select("key", "n"))
    placed = map_text(met, _placed, ["word", "n", "key", "letter"], _PLACED, text="word")
    rank = F.struct((-F.col("n")).alias("minus"), "word")
    rest, place = W.partitionBy("key", "rest"), W.partitionBy("key", "rest", "place")
    ordered, taken = place.orderBy(rank), F.col("place") >= 0
    df = placed.withColumn("rank", rank).withColumns({
        # words that differ in this place: all but the word itself, of which the first is the best
        "others": F.count("*").over(place) - 1, "top": F.first("rank").over(ordered), "next": F.lead("rank").over(ordered),
        # words one letter longer than this one, and the word that is the rest
        "longer": F.count_if(F.col("first")).over(rest), "longest": F.min(F.when(F.col("first"), F.col("rank"))).over(rest), "own": F.max(F.when(~taken, F.col("rank"))).over(rest),
    })
    swapped = F.when(F.col("others") > 0, F.when(F.col("top.word") == F.col("word"), F.col("next")).otherwise(F.col("top")))
    shorter = F.when(F.col("first"), F.col("own"))
    near = F.when(taken, F.col("others") + F.when(shorter.isNotNull(), 1).otherwise(0)).otherwise(F.col("longer"))
    best = F.when(taken, F.least(swapped, shorter)).otherwise(F.col("longest"))
    return df.select("word", near.alias("near"), best.alias("best")).filter("near > 0").groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def follow(forms: DataFrame, folder: str) -> DataFrame:
    """(word, root) of forms (word, form): where following forms from word to word ends.

    Each round doubles how far a root is; as a form is many times as frequent as its word, chains are short.
    """
    root, round_ = stored(forms.select("word", F.col("form").alias("root")), folder, "root_0"), 0
    while True:
        on = root.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = hot_join(root, on, "root", "word", "left")
        moved = stored(moved.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), folder, f"root_{round_ + 1}")
        if moved.filter("moved").isEmpty():
            return moved.select("word", "root")
        root, round_ = moved.select("word", "root"), round_ + 1


def spelling_variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each of words (word, n).

    form: the commonest word at one inserted, deleted or replaced letter (the
    first by code points of equals), if it is times as frequent as the word or
    more; else null, as is form_n. root: the last form from form to form; the
    word itself if it has none. Words come once each; null words are left out,
    and a table without words gives none.
    """
    folder = scratch_dir(words.sparkSession)
    words = stored(words.filter("word IS NOT NULL AND n IS NOT NULL").select("word", F.col("n").cast("bigint").alias("n")), folder, "words")
    known = -F.col("best.minus")
    is_form = known >= times * F.col("n")
    df = words.join(near_words(words, folder), "word", "left")
    df = df.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, known).alias("form_n"))
    df = stored(df, folder, "forms")
    df = df.join(follow(df.filter("form IS NOT NULL"), folder), "word", "left")
    return df.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(count_words(table(spark, sf_dir, "documents").select("doc_id", "text")))
