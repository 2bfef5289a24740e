"""Toxicity: a weighted lexicon, matched by one Aho-Corasick automaton.

Texts are folded first, so that look-alike letters and digits for letters are
read as what they stand for. The lexicon holds beginnings of words and whole
words with weights; phrases that are harmless though they hold an entry are
exceptions and cancel what they cover. The weights' sum, normalised by the
text's length, is mapped to a score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from tidemark.llm.common import hashed_sample, map_text, table, unused

#: Look-alike letters (fixed values): what they are read as.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p",
    "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o",
    "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g",
}
#: Digits for letters, and marks for letters where they stand between two of them (fixed values).
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
MARKS = {"@": "a", "$": "s", "!": "i", "|": "l"}
#: Common insults; they count as seen in PRIOR toxic texts before any is read.
SEEDS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "disgusting")
PRIOR = 2
#: Harmless phrases that hold a word of the lexicon.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "clownfish", "class clown costume", "sore loser award", "pond scum", "scum line", "trash collection")
#: The lexicon is learned from this many labelled rows at most, drawn by a hash of their id.
TRAIN_ROWS = 8_000
MAX_ENTRIES = 2_000
#: A beginning of a word has this many letters.
SHORTEST, LONGEST = 4, 10
#: An entry stands in this share of the toxic texts of the sample, in so many at least, and so seldom in others.
SUPPORT, LEAST, PURITY = 0.012, 6, 0.9
#: The weights' sum is divided by (1 + letters / NORM) to this power.
NORM, POWER = 4_000, 0.5
THRESHOLD = 0.7

_fold = str.maketrans({c + 65248: c for c in range(33, 127)} | {ord(a): b for a, b in HOMOGLYPHS.items()} | {ord(a): b for a, b in DIGITS.items()} | {c: None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)})
_between = re.compile(r"(?<=[^\W_])[@$!|](?=[^\W_])")
_word = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    text = text.lower().translate(_fold)
    if "@" in text or "$" in text or "!" in text or "|" in text:
        text = _between.sub(lambda m: MARKS[m[0]], text)
    return text


@dataclass
class Lexicon:
    """entries: (pattern, whole word or only its beginning, weight)."""

    entries: list[tuple[str, bool, float]]
    exceptions: tuple[str, ...] = EXCEPTIONS
    scale: float = 1.0
    automaton: object = field(default=None, repr=False)

    def ready(self) -> Lexicon:
        by_pattern: dict[str, list] = {}
        for pattern, whole, weight in self.entries:
            by_pattern.setdefault(pattern, []).append((whole, weight))
        for phrase in self.exceptions:
            by_pattern.setdefault(fold(phrase), []).append(None)
        self.automaton = ahocorasick.Automaton()
        for pattern, value in by_pattern.items():
            self.automaton.add_word(pattern, (len(pattern), value))
        if by_pattern:
            self.automaton.make_automaton()
        return self

    def hits(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) in the folded text; of entries at the same word, the heaviest counts."""
        if not len(self.automaton):
            return []
        found, excused = {}, []
        for last, (size, values) in self.automaton.iter(text):
            start, end = last + 1 - size, last + 1
            if start and text[start - 1].isalnum():
                continue
            ends = end == len(text) or not text[end].isalnum()
            for value in values:
                if value is None:
                    if ends:
                        excused.append((start, end))
                elif (ends or not value[0]) and value[1] > found.get(start, (0, 0.0))[1]:
                    found[start] = (end, value[1])
        return [(s, e, w) for s, (e, w) in sorted(found.items()) if not any(a <= s and e <= b for a, b in excused)]

    def weight(self, text: str | None) -> float:
        """The sum of weights, normalised by length; 0 for null and empty texts."""
        if not text:
            return 0.0
        folded = fold(text)
        return sum(w for _, _, w in self.hits(folded)) / (1 + len(folded) / NORM) ** POWER

    def score(self, weight: float) -> float:
        """0 without a hit, THRESHOLD where weight is scale, towards 1 beyond."""
        return weight / (weight + self.scale * (1 - THRESHOLD) / THRESHOLD) if weight else 0.0


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 3 == 1


def labelled(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(text, toxic) of at most `rows` labelled documents that are not held out.

    Rows are drawn by a hash of the id. Equal texts count once, so that a group
    of copies teaches no more than one text; of two labels for an id the
    higher counts. Rows without id, text or label teach nothing.
    """
    # Spark's crc32 is the one of zlib
    usable = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    usable = usable.filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    drawn = hashed_sample(usable, "doc_id", rows)
    texts = docs.select("doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(drawn), "doc_id")
    return texts.groupBy(F.xxhash64("text").alias("_text")).agg(F.max(F.struct("toxic", "text")).alias("x")).select("x.text", "x.toxic")


_COUNTS = StructType([StructField("pattern", StringType()), StructField("whole", BooleanType()), StructField("toxic", LongType()), StructField("other", LongType())])


def _count(texts: list, toxic: list) -> dict[str, list]:
    """In how many texts of the slice each word and beginning stands; a row without pattern has the texts' number."""
    seen = {True: Counter(), False: Counter()}
    for text, label in zip(texts, toxic, strict=True):
        words = set(_word.findall(fold(text)))
        own = {(w, True) for w in words} | {(w[:k], False) for w in words for k in range(SHORTEST, min(len(w), LONGEST) + 1)}
        seen[label == 1].update(own)
        seen[label == 1][None, None] += 1
    keys = list(seen[True] | seen[False])
    return {"pattern": [k[0] for k in keys], "whole": [k[1] for k in keys], "toxic": [seen[True][k] for k in keys], "other": [seen[False][k] for k in keys]}


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """A lexicon from at most `rows` labelled documents.

    Counting runs on the executors; the driver gets at most MAX_ENTRIES
    patterns and one (weight, label) pair for each sampled row. Without
    labelled rows the lexicon is SEEDS at weight 1. Rows without id, text or
    label teach nothing, repeated texts count once, and columns other than
    doc_id, text and toxic are ignored.
    """
    sample = labelled(docs, labels, rows)
    counted = map_text(sample, _count, ["text", "toxic"], _COUNTS).groupBy("pattern", "whole").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    sizes = counted.filter("pattern IS NULL").collect()
    n1, n0 = (sizes[0].toxic, sizes[0].other) if sizes else (0, 0)
    least = max(LEAST, SUPPORT * n1)
    often = counted.filter((F.col("toxic") >= least) & (F.col("toxic") >= PURITY * (F.col("toxic") + F.col("other"))) & F.col("pattern").isNotNull())
    top = often.orderBy(F.col("toxic").desc(), "pattern", "whole").limit(MAX_ENTRIES).collect()
    found = {(r.pattern, r.whole): (r.toxic, r.other) for r in top}
    for word in SEEDS:
        a, b = found.get((word, True), (0, 0))
        found[word, True] = (a + PRIOR, b)
    entries: list[tuple[str, bool, float]] = []
    kept: set[str] = set()
    # the shortest pure beginning covers whatever begins with it
    for (pattern, whole), (a, b) in sorted(found.items(), key=lambda x: (len(x[0][0]), x[0])):
        if any(pattern[:k] in kept for k in range(SHORTEST, len(pattern) + 1)):
            continue
        if not whole:
            kept.add(pattern)
        entries.append((pattern, whole, math.log((a + 0.5) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1)) if n1 else 1.0))
    entries = [(p, w, x) for p, w, x in entries if x > 0] or [(w, True, 1.0) for w in SEEDS]
    lexicon = Lexicon(entries, exceptions).ready()
    weighed = map_text(sample, lambda x, t, y: {"weight": [x.weight(v) for v in t], "toxic": y}, ["text", "toxic"], _PAIR, make=_maker(lexicon))
    lexicon.scale = best_scale([(r.weight, r.toxic) for r in weighed.collect()])
    return lexicon


_PAIR = StructType([StructField("weight", DoubleType()), StructField("toxic", IntegerType())])


def _maker(lexicon: Lexicon):
    entries, exceptions, scale = lexicon.entries, lexicon.exceptions, lexicon.scale
    return lambda: Lexicon(entries, exceptions, scale).ready()


def best_scale(pairs: list[tuple[float, int]]) -> float:
    """The weight from which on a text counts as toxic: where F1 on the pairs is best, the middle of the gap below."""
    total = sum(y for _, y in pairs)
    best, at = -1.0, 1.0
    hit = n = 0
    ordered = sorted(((w, y) for w, y in pairs if w > 0), reverse=True)
    for i, (w, y) in enumerate(ordered):
        hit, n = hit + y, n + 1
        below = ordered[i + 1][0] if i + 1 < len(ordered) else 0.0
        f1 = 2 * hit / (n + total) if total else 0.0
        if below < w and f1 > best:
            best, at = f1, (w + below) / 2
    return at


_SCORED = StructType([StructField("doc_id", LongType()), StructField("held_out", BooleanType()), StructField("score", DoubleType()), StructField("n_hits", LongType())])


def _score(lexicon: Lexicon, ids: list, texts: list) -> dict[str, list]:
    hits = [lexicon.hits(fold(t)) if t else [] for t in texts]
    weights = [sum(w for _, _, w in h) / (1 + len(fold(t)) / NORM) ** POWER if h else 0.0 for h, t in zip(hits, texts, strict=True)]
    return {"doc_id": ids, "held_out": [held_out(i) for i in ids], "score": [lexicon.score(w) for w in weights], "n_hits": [len(h) for h in hits]}


def score_toxicity(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, held_out, score, n_hits and predicted for each row of docs (doc_id, text).

    Only the text makes the score. Null and empty texts score 0; a null doc_id
    stays null and is not held out; repeated rows repeat; other columns are
    ignored; no rows, none. Bytes that aren't UTF-8 are read as U+FFFD.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    scored = map_text(docs, _score, ["doc_id", "text"], _SCORED, make=_maker(lexicon))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The rows of docs whose text the lexicon does not call toxic, with all their columns and no others.

    Rows with null or empty texts stay, and so do rows without doc_id and
    repeated ones. Columns stay as they are, whatever their names; so do bytes of
    text that aren't UTF-8, which are scored as U+FFFD.
    """
    names = dict(zip(_SCORED.names, unused(docs.columns, *(f"_{n}" for n in _SCORED.names)), strict=True))
    own = StructType([StructField(names[f.name], f.dataType) for f in _SCORED])
    score = lambda x, i, t: {names[k]: v for k, v in _score(x, i, t).items()}
    scored = map_text(docs, score, ["doc_id", "text"], own, make=_maker(lexicon), carry=True)
    return scored.filter(F.col(names["score"]) < THRESHOLD).select(*docs.columns)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "held_out", "score", "predicted", "n_hits")
