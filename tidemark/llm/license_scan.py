"""License scans: an exact set-similarity join of text blocks with templates.

A text meets a template if some run of its words, no longer than the template's
window and whatever its line breaks, holds at least the threshold's share of
the template's words, or a short line does so in any order and spacing. Such a
line is one block; elsewhere runs that share no word are. All words of templates are ordered by how
often the corpus uses them, rarest first; two sets that share enough words must
share one within their prefixes in that order, so only the surroundings of
words of a template's prefix are looked at, and only those with enough of its
words are gone through run by run.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from tidemark.llm.common import map_text, table

#: Phrases by label (fixed values of the contract).
PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
#: Templates by label: well-known notices, each a set of words.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "cc-by-4.0": "licensed under cc by 4 0",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "cc-by-sa-4.0": "licensed under cc by sa 4 0",
    "cc0-1.0": "dedicated to the public domain under cc0 1 0",
    "gpl-3.0": "under the gnu general public license version 3",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "lgpl": "under the gnu lesser general public license",
    "mit": "released under the mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "mpl-2.0": "subject to the terms of the mozilla public license version 2 0",
    "proprietary": "copyright all rights reserved unauthorized copying prohibited",
}
THRESHOLD = 0.8
#: A template's window is so many times its words.
WINDOW_TIMES = 2
#: A line of so many words, or of a window's, is short.
SHORT_LINE = 24
#: The templates travel to every task; those of more words than this in all do so in several passes.
PASS_WORDS = 1_000_000

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}

MATCH = StructType([StructField("label", StringType()), StructField("line", LongType()), StructField("word", LongType()), StructField("containment", DoubleType())])
PLACE = StructType([StructField("label", StringType()), StructField("word", LongType())])
RESULT = StructType([
    StructField("doc_id", LongType()), StructField("n_words", LongType()),
    StructField("places", ArrayType(PLACE)), StructField("blocks", ArrayType(MATCH)),
])


def needed(size: int, threshold: float) -> int:
    return max(1, math.ceil(round(threshold * size, 9)))


def window_of(text: str) -> int:
    """How many consecutive words a template's words may be spread over."""
    return WINDOW_TIMES * len(WORD.findall(text))


class Index:
    """Templates by the words of their prefixes, in the order given by rank."""

    def __init__(self, templates: Mapping[str, str], threshold: float, rank: Mapping[str, int]):
        self.sets, self.by_word = [], {}
        for label, text in sorted(templates.items()):
            times = Counter(WORD.findall(text.translate(LOWER)))
            words = sorted(times, key=rank.__getitem__)
            if not words:
                continue
            least = needed(len(words), threshold)
            for w in words[: len(words) - least + 1]:
                self.by_word.setdefault(w, []).append(len(self.sets))
            self.sets.append((label, times, least, window_of(text)))

    def blocks(self, words: list[str], starts: list[int]) -> list[tuple[str, int, int, float]]:
        """(label, line, first word, containment) of the blocks of a text of these words, whose lines start there."""
        if self.by_word.keys().isdisjoint(words):
            return []
        places: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            for t in self.by_word.get(w, ()):
                places.setdefault(t, []).append(i)
        found = []
        for t, at in places.items():
            label, times, least, window = self.sets[t]
            if _near(words, at, times, least, max(window, SHORT_LINE)):
                found += [(label, bisect_right(starts, i) - 1, i, shared / len(times)) for i, shared in _blocks(words, starts, times, least, window)]
        return sorted(found, key=lambda x: (x[2], x[0]))


def _near(words: list[str], at: list[int], times: Mapping[str, int], least: int, reach: int) -> bool:
    """Whether the surroundings of any of these places hold enough of the template's words."""
    k = 0
    while k < len(at):
        low = max(0, at[k] - reach + 1)
        while k + 1 < len(at) and at[k + 1] - at[k] < 2 * reach:
            k += 1
        if len(times.keys() & set(words[low : at[k] + reach])) >= least:
            return True
        k += 1
    return False


def _blocks(words: list[str], starts: list[int], times: Mapping[str, int], least: int, window: int) -> list[tuple[int, int]]:
    """(first word, number of template words) of the short lines that meet the template, and of the runs between those."""
    by_line: dict[int, list[tuple[int, str]]] = {}
    for i, w in enumerate(words):
        if w in times:
            by_line.setdefault(bisect_right(starts, i) - 1, []).append((i, w))
    found, between = [], []
    for line, own in by_line.items():
        shared = len({w for _, w in own})
        end = starts[line + 1] if line + 1 < len(starts) else len(words)
        if shared >= least and end - starts[line] <= max(window, SHORT_LINE):
            found += [*_runs(between, times, least, window), (starts[line], shared)]
            between = []
        else:
            between += own
    return found + _runs(between, times, least, window)


def _runs(own: list[tuple[int, str]], times: Mapping[str, int], least: int, window: int) -> list[tuple[int, int]]:
    """(first word, number of template words) of runs with enough of them that share no word, from the left."""
    found: list[tuple[int, int]] = []
    held: Counter[str] = Counter()
    first = k = 0

    def drop() -> None:
        nonlocal first
        w = own[first][1]
        held[w] -= 1
        if not held[w]:
            del held[w]
        first += 1

    while k < len(own):
        held[own[k][1]] += 1
        while own[k][0] - own[first][0] >= window:
            drop()
        k += 1
        if len(held) < least:
            continue
        while held[own[first][1]] > 1:
            drop()
        # the rest of the notice, up to a word that it has had
        while k < len(own) and own[k][0] - own[first][0] < window and held[own[k][1]] < times[own[k][1]]:
            held[own[k][1]] += 1
            k += 1
        found.append((own[first][0], len(held)))
        held.clear()
        first = k
    return found


def places_of(words: list[str]) -> list[tuple[str, int]]:
    """(label, word index) of every place where a phrase stands."""
    found = []
    for label, phrase in PHRASES.items():
        parts = phrase.split()
        i = -1
        try:
            while True:
                i = words.index(parts[0], i + 1)
                if words[i : i + len(parts)] == parts:
                    found.append((label, i))
        except ValueError:
            pass
    return sorted(found, key=lambda x: (x[1], x[0]))


def _words(text: str | None) -> tuple[list[str], list[int]]:
    """A text's words and at which of them each line starts."""
    words, starts = [], []
    for line in (text or "").translate(LOWER).split("\n"):
        starts.append(len(words))
        words += WORD.findall(line)
    return words, starts


def _scan(index: Index, ids: list, texts: list) -> dict[str, list]:
    out = {k: [] for k in RESULT.names}
    for doc_id, text in zip(ids, texts, strict=True):
        words, starts = _words(text)
        out["doc_id"].append(doc_id)
        out["n_words"].append(len(words))
        out["places"].append([{"label": a, "word": i} for a, i in places_of(words)])
        out["blocks"].append([{"label": a, "line": n, "word": i, "containment": c} for a, n, i, c in index.blocks(words, starts)])
    return out


def _scan_more(index: Index, texts: list, blocks: list) -> dict[str, list]:
    """blocks with those of further templates."""
    more = ([{"label": a, "line": n, "word": i, "containment": c} for a, n, i, c in index.blocks(*_words(t))] for t in texts)
    return {"blocks": [sorted([*a, *b], key=lambda x: (x["word"], x["label"])) for a, b in zip(blocks, more, strict=True)]}


def passes(templates: Mapping[str, str], size: int) -> list[dict[str, str]]:
    """templates in parts of at most `size` words each, or of one template."""
    parts: list[dict[str, str]] = [{}]
    left = size
    for label, text in templates.items():
        n = len(WORD.findall(text))
        if parts[-1] and n > left:
            parts.append({})
            left = size
        parts[-1][label] = text
        left -= n
    return parts


def word_order(docs: DataFrame, vocabulary: set[str]) -> dict[str, int]:
    """The vocabulary's words by how many lines of all documents hold them, rarest first.

    What comes to the driver is one count per template word.
    """

    def count(texts: list) -> dict[str, list]:
        seen: Counter[str] = Counter()
        for text in texts:
            for line in (text or "").translate(LOWER).split("\n"):
                seen.update(vocabulary.intersection(WORD.findall(line)))
        return {"word": list(seen), "n": list(seen.values())}

    schema = StructType([StructField("word", StringType()), StructField("n", LongType())])
    counted = dict(map_text(docs, count, ["text"], schema).groupBy("word").agg(F.sum("n")).collect())
    return {w: r for r, w in enumerate(sorted(vocabulary, key=lambda w: (counted.get(w, 0), w)))}


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Phrases and template blocks of every whole text.

    docs needs doc_id and text; other columns are ignored. Returns a row for
    each row of docs: doc_id, n_words, places (label, word: where a phrase's
    words stand consecutively) and blocks (label, line and word: the block's first
    ones, containment). A null text counts as empty and has none of either; a
    null doc_id stays null; repeated rows give repeated results; no rows, none.
    Bytes that aren't UTF-8 are read as U+FFFD.

    However many templates there are, all are looked for, at most PASS_WORDS
    words of them in each pass over the texts; passes follow one another within
    a stage.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    vocabulary = {w for t in templates.values() for w in WORD.findall(t.translate(LOWER))}
    rank = word_order(docs, vocabulary)
    first, *more = (Index(t, threshold, rank) for t in passes(templates, PASS_WORDS))
    out = map_text(docs, _scan, ["doc_id", "text"], RESULT, make=lambda: first, carry=bool(more))
    for index in more:
        out = map_text(out, _scan_more, ["text", "blocks"], StructType([RESULT["blocks"]]), make=lambda x=index: x, carry=True)
    return out.select(*RESULT.names)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    labels = lambda *a: F.array_join(F.array_sort(F.array_distinct(F.concat(*a))), ",")
    best = F.coalesce(F.array_max("blocks.containment"), F.lit(0.0))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min("places.word").alias("first_word"),
        F.array_max("places.word").alias("last_word"),
        labels("places.label").alias("base_labels"),
        labels("places.label", "blocks.label").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(best).alias("score"),
        F.size("blocks").cast("bigint").alias("n_blocks"),
    )
