from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.llm import near_dup as nd

SCHEMA = "doc_id bigint, text string, component_id string, n bigint"


def brute(rows, size=4, similar=80):
    """Per row (n_shingles, component_id): every pair compared by sets of tuples of words."""
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set())
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None:
                both = len(sets[i] & sets[j])
                if 100 * both >= similar * (len(sets[i]) + len(sets[j]) - both):
                    group[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(len(s), None if d is None else least[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def run(spark, rows, **more):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    return [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in nd.near_duplicates(df, **more).collect()]


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    passage = [word() for _ in range(40)]
    rows, texts = [], []
    for i in range(160):
        k = rng.random()
        if texts and k < 0.5:
            words = rng.choice(texts).split(" ")
            for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
                words[rng.randrange(len(words))] = word()
            text = " ".join(words)
        else:
            text = " ".join([word() for _ in range(rng.choice([1, 3, 5, 20, 60, 250]))] + (passage if k > 0.8 else []))
        texts.append(text)
        rows.append((1000 - i * 3, text.upper() if rng.random() < 0.2 else text.replace(" ", "\n", 1)))
    return rows


@pytest.mark.parametrize("hot", [None, 2])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, monkeypatch, seed, hot):
    """hot: with so few rows to a group that nearly every join is dealt to several."""
    if hot:
        monkeypatch.setattr(common, "HOT_ROWS", hot)
    rows = corpus(seed)
    got = {d: (n, c, k) for d, n, c, k in run(spark, rows)}
    for (d, _), (n, c) in zip(rows, brute(rows), strict=True):
        assert got[d] == (n, c, d == c), d


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(5, None), (4, ""), (3, " \n\t"), (9, "a b"), (2, "A  b"), (7, "é É"), (8, "é É"), (None, "a b"), (6, long), (1, long + " end"), (2, "A  b"), (10, "a b c d e"), (11, "a b c d f")]
    got = run(spark, rows)
    assert sorted(got, key=str) == sorted([(d, n, c, d is None or c == d) for (d, _), (n, c) in zip(rows, brute(rows), strict=True)], key=str)


def test_empty_and_no_links(spark):
    assert run(spark, []) == []
    assert [r[3] for r in run(spark, [(1, "a b c d e"), (2, "f g h i j")])] == [True, True]


def test_near_copies_cost_no_pairs(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(400):
        words = list(base)
        words[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(words)))
    assert {c for _, _, c, _ in run(spark, rows)} == {0}


def test_bands_find_and_estimates_hold():
    rng = np.random.default_rng(0)
    for n in (5, 22, 60, 100, 500, 1100, 3000):
        for _ in range(20):
            u = rng.integers(0, 2**64, size=2 * n, dtype=np.uint64)
            d = max(1, n // 10)
            a, b = np.unique(u[:n]), np.unique(u[d:n] if n < 10 else np.concatenate([u[d:n], u[n : n + d]]))
            both = len(np.intersect1d(a, b))
            if both / (len(a) + len(b) - both) < 0.8:
                continue
            x, y = nd.sketch_of(a), nd.sketch_of(b)
            assert set(nd.bands_of(x, len(a))) & set(nd.bands_of(y, len(b)))
            assert nd.likely_any([x.tobytes()], [y.tobytes()], np.array([len(a)]), np.array([len(b)]))[0]
    x, y = (nd.sketch_of(rng.integers(0, 2**64, size=300, dtype=np.uint64)) for _ in range(2))
    assert not nd.likely_any([x.tobytes()], [y.tobytes()], np.array([300]), np.array([300]))[0]


def test_registers_are_least_hashes():
    values = np.random.default_rng(1).integers(0, 2**64, size=50, dtype=np.uint64)
    for style, (_, width) in enumerate(nd.STYLES):
        got = nd.registers_of(values, style)
        bits = width.bit_length() - 1
        for part in range(nd.REGISTERS // width):
            least = {}
            for v in values:
                seed = np.uint64(part * int(nd._MIX) % 2**64)
                h = int(nd._scramble(np.array([v ^ seed], np.uint64))[0])
                place, rest = (h >> (64 - bits) if bits else 0), (h << bits) & (2**64 - 1) | (1 << (bits - 1) if bits else 1)
                least[place] = min(least.get(place, 2**64), rest)
            for place in range(width):
                r = int(got[part * width + place])
                if place not in least:
                    assert r == 0
                else:
                    zeros = 64 - least[place].bit_length()
                    assert r == ((zeros + 1) << nd.MANTISSA) | ((least[place] << (zeros + 1)) & (2**64 - 1)) >> (64 - nd.MANTISSA)


def test_contraction(spark):
    rng = random.Random(2)
    links = [(a, b) for a, b in ((rng.randrange(300), rng.randrange(300)) for _ in range(260)) if a < b] + [(400 + i, 401 + i) for i in range(60)]
    df = spark.createDataFrame(links, "a bigint, b bigint")
    folder = nd.scratch_dir(spark)
    want = {i: i for i in range(500)}
    for _ in range(70):
        for a, b in links:
            want[a] = want[b] = min(want[a], want[b])
    got = {r.node: r.component for r in nd.components(df, folder).collect()}
    assert all(got.get(i, i) == want[i] for i in want)
    half = spark.createDataFrame(links[::2], "a bigint, b bigint")
    again = nd.merged(nd.components(half, folder, "h"), spark.createDataFrame(links[1::2], "a bigint, b bigint"), folder, "m")
    got = {r.node: r.component for r in again.collect()}
    assert all(got.get(i, i) == want[i] for i in want)


def test_hot_keys_are_few_and_lose_no_rows(spark, monkeypatch):
    rng = random.Random(3)
    left = [(rng.choice([1, 1, 1, 2, 3, None, 4 + i % 50]), i) for i in range(3_000)]
    right = [(k, -k) for k in range(60)] + [(7, -70)]
    left_df, right_df = spark.createDataFrame(left, "k int, _salt int"), spark.createDataFrame(right, "k int, _groups int")
    for rows, parts in ((1, 5), (64, 1_000), (10, 1)):
        monkeypatch.setattr(common, "HOT_ROWS", rows)
        monkeypatch.setattr(common, "HOT_PARTS", parts)
        counts = left_df.groupBy("k").agg(F.count("*").alias("n"))
        assert common.hot_keys(counts, ["k"], len(left))[0].count() <= max(parts, 1)
        for how in ("inner", "left", "left_semi"):
            want = left_df.join(right_df, "k", how)
            got = common.hot_join(left_df, right_df, "k", by="_salt", how=how)
            assert got.columns == want.columns and sorted(got.collect(), key=str) == sorted(want.collect(), key=str)


def test_texts_that_are_not_utf8(spark):
    texts = spark.range(3).select(F.col("id").alias("doc_id"), F.expr("CAST(X'6120FF206220632064' AS STRING)").alias("text"))
    assert [(r.n_shingles, r.component_id) for r in nd.near_duplicates(texts).collect()] == [(2, 0)] * 3


def test_columns_that_clash_and_rows_that_differ_elsewhere(spark):
    rows = [(1, "a b c d e f", "x", 2), (1, "a b c d e f", "x", 1), (2, "a b c d e f", "y", 1), (3, None, "z", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, _ID string, _text int").withColumn("kept", F.lit("k"))
    out = nd.drop_near_duplicates(df)
    assert out.columns == df.columns
    assert sorted(tuple(r) for r in out.collect()) == [(1, "a b c d e f", "x", 1, "k"), (3, None, "z", 1, "k")]


def test_dropping_keeps_one_of_each(spark):
    rows = [(3, "a b c d e f", "k", 1), (1, "a b c d e f", "k", 2), (1, "a b c d e f", "k", 3), (9, None, "k", 4), (None, "a b c d e f", "k", 5), (4, "other words stand here now", "k", 6)]
    out = nd.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA), size=5)
    assert out.columns == ["doc_id", "text", "component_id", "n"]
    got = sorted(out.collect(), key=lambda r: r.n)
    assert [r.doc_id for r in got] in ([1, 9, None, 4], [1, 9, None, 4]) and len(got) == 4
