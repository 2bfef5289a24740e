"""Line dedup, spelling variants and collocations against plain Python and SQL."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import pytest

from tidemark.llm import collocation, entry, line_dedup, spelling
from tidemark.session import session_like

DATA = Path("/root/testdata/sf0.001")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", ["op11_line_dedup", "op12_spelling_variants", "op13_collocations"])
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = entry.queries()[name](spark, str(DATA)).select(*columns).collect()
    assert Counter(map(tuple, got)) == Counter(want.fetchall()) and got


# -- lines -------------------------------------------------------------------------


def drop_lines(rows: list[tuple], least_chars: int, least_docs: int) -> list[tuple]:
    key = lambda line: line.strip(" \t\n\x0b\f\r").translate(LOWER)
    holders = defaultdict(set)
    for i, text in rows:
        if i is not None and text is not None:
            for line in text.split("\n"):
                holders[key(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        lost = lambda x: i is not None and text is not None and len(key(x)) >= least_chars and len(holders[key(x)]) >= least_docs and i != max(holders[key(x)])
        kept = [x for x in lines if not lost(x)]
        out.append((i, text, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


LINES = ["common line", "  Common LINE\t", "common  line", "other line é", "OTHER LINE É", "abc", "", " ", "a much longer line than the others", "tab\tinside it", "\x0bcommon line\f"]


@pytest.mark.parametrize(("batches", "seed"), [(1, 1), (3, 2), (12, 3)])
def test_lines(spark, batches, seed):
    r = random.Random(seed)
    rows = [(i, "\n".join(r.choice(LINES) for _ in range(r.randrange(1, 9)))) for i in range(60)]
    rows += [rows[7], rows[7], (7, "common line\nand another text of document 7"), (None, "common line\nabc"), (None, None), (61, None), (62, ""), (63, "\n\n"), (-5, "common line")]
    rows += [(64, "\n".join(f"line {j} of a long text" for j in range(3_000)) + "\ncommon line")]
    want = drop_lines(rows, 8, 3)
    df = spark.createDataFrame([(i, t, "x", 5, 6) for i, t in rows], "doc_id bigint, text string, KEY string, n_lines int, _places int")
    got = line_dedup.drop_repeated_lines(df, least_chars=8, least_docs=3, batches=batches)
    assert got.columns == ["doc_id", "text", "KEY", "_places", "n_lines", "n_dropped", "kept_text"]
    assert Counter(tuple(x) for x in got.select("doc_id", "text", "n_lines", "n_dropped", "kept_text").collect()) == Counter(want)
    assert any(x[3] for x in want)


def test_lines_of_hot_keys_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr("tidemark.llm.common.HOT_ROWS", 2)
    rows = [(i, f"the line of all documents\nline {i % 4} of some") for i in range(200)]
    got = line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), least_chars=8, least_docs=3).select("doc_id", "text", "n_lines", "n_dropped", "kept_text")
    assert sorted(map(tuple, got.collect())) == sorted(drop_lines(rows, 8, 3))


def test_no_lines(spark):
    assert line_dedup.drop_repeated_lines(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_runs_are_levelled(spark, tmp_path):
    runs = line_dedup.LineRuns(spark, str(tmp_path), fanout=2, buckets=3)
    batches = [[(b"%d" % (k % m), d) for k in range(20) for d in (100 - b, 200 - b) if k % m] for b, m in enumerate((5, 7, 3, 11, 2))]
    for b in batches:
        runs.add(spark.createDataFrame(sorted(set(b)), "key binary, doc_id bigint"))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    n, owner = Counter(), {}
    for b in batches:
        for k, d in set(b):
            n[k] += 1
        for k in {k for k, _ in b} - set(owner):
            owner[k] = max(d for x, d in b if x == k)
    assert {(bytes(r.key), r.n, r.owner) for r in runs.totals().collect()} == {(k, n[k], owner[k]) for k in n}
    names = runs.names
    runs.close()
    assert not any(spark.catalog.tableExists(x) for x in names)


@pytest.mark.parametrize(("bucket_rows", "files"), [(None, 1), (150, 2), (1, 4)])
def test_runs_have_files_by_rows(spark, tmp_path, monkeypatch, bucket_rows, files):
    if bucket_rows:
        monkeypatch.setattr(line_dedup, "BUCKET_ROWS", bucket_rows)
    pairs = [(b"%d" % (d % m), d, 0, m) for d in range(50) for m in (3, 7, 11, 13, 17, 50)]
    lines = spark.createDataFrame(pairs, "key binary, doc_id bigint, row bigint, place int")
    holders = defaultdict(set)
    for k, d, *_ in pairs:
        holders[k].add(d)
    got = line_dedup.repeated_lines(lines, 5, 3, str(tmp_path)).collect()
    assert {(bytes(r.key), r.n, r.owner) for r in got} == {(k, len(x), max(x)) for k, x in holders.items() if len(x) >= 5}
    runs = [len(list(x.glob("*.parquet"))) for x in tmp_path.glob("tidemark_run_*")]
    assert len(runs) == 3 and max(runs) == files
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"


def test_a_session_of_its_own_keeps_settings(spark):
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        own = session_like(spark, {"spark.sql.shuffle.partitions": 3})
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")
    names = ("spark.sql.ansi.enabled", "spark.sql.session.timeZone", "spark.sql.shuffle.partitions")
    assert [own.conf.get(x) for x in names] == ["false", "UTC", "3"]
    assert [spark.conf.get(x) for x in names] == ["true", "UTC", "4"]


# -- words -------------------------------------------------------------------------


def near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(words: dict[str, int], times: int) -> set[tuple]:
    forms, out = {}, []
    for w, n in words.items():
        others = sorted((-m, v) for v, m in words.items() if near(v, w))
        best = others[0] if others and -others[0][0] >= times * n else None
        forms[w] = best and best[1]
        out.append((w, n, len(others), best))
    end = lambda w: w if forms[w] is None else end(forms[w])
    return {(w, best and best[1], end(w), n, many, best and -best[0]) for w, n, many, best in out}


def test_variants(spark):
    r = random.Random(5)
    words = {"".join(r.choice("aabcé") for _ in range(r.randrange(1, 7))): r.choice((1, 1, 2, 2, 3, 10, 30, 200)) for _ in range(300)}
    words |= {"": 50, "a": 4, "aa": 40, "aaa": 400, "aaaa": 4_000, "ab": 7, "ba": 7, "ÿÿ": 3, "÷": 1, "z" * 30_000: 2, "z" * 29_999: 50}
    got = spelling.spelling_variants(spark.createDataFrame([*words.items(), (None, 4)], "word string, n bigint"), times=5)
    assert {tuple(x) for x in got.select("word", "form", "root", "n", "n_near", "form_n").collect()} == variants(words, 5)


def test_variants_of_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr("tidemark.llm.common.HOT_ROWS", 2)
    words = {"".join(p): n for n, p in enumerate({tuple(random.Random(i).sample("abcdefg", 7)) for i in range(80)}, 1)}
    words |= {"abcdefx": 9_000, "abcdefgx": 9_000, "bcdefg": 9_000, "abcdefg": 3}
    got = spelling.spelling_variants(spark.createDataFrame(list(words.items()), "word string, n bigint"))
    assert {tuple(x) for x in got.select("word", "form", "root", "n", "n_near", "form_n").collect()} == variants(words, 10)


def test_long_words_have_keys(spark):
    key = spelling.anagram_key("ÿ" * 9_000_000)
    assert spelling._signed(key - ord("ÿ") ** 5) == spelling._signed(spelling.anagram_key("ÿ" * 8_999_999))
    assert -(1 << 63) <= spelling._signed(key) < 1 << 63


def test_words_are_counted(spark):
    rows = [(1, "Hello, hELLo world-World ÀÉ àé ×÷ Straße x1y"), (2, None), (None, "hello hello"), (3, ""), (3, "Hello"), (3, "Hello"), (40, "world " * 500)]
    want = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            want[w if h % 3 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    df = spark.createDataFrame([(i, x, 1) for i, x in rows], "doc_id bigint, text string, n int")
    got = spelling.count_words(df, least_letters=2, least_count=1, slip=3).collect()
    assert {tuple(x) for x in got} == {(w, n) for w, n in want.items() if len(w) >= 2}
    assert spelling.spelling_variants(spelling.count_words(df.limit(0))).collect() == []


# -- phrases -----------------------------------------------------------------------


def best_phrases(rows: list[tuple], least: int, longest: int, top: int) -> list[tuple]:
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        often = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = {p[i:j] for p, a in often.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and a >= c[p[i:j]]}
        found = []
        for p, a in often.items():
            if p not in inside:
                score, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


@pytest.mark.parametrize(("least", "longest", "top", "buckets"), [(3, 5, 8, None), (2, 4, 1_000, collocation.CHUNK), (200, 3, 5, None)])
def test_phrases(spark, least, longest, top, buckets):
    r = random.Random(9)
    text = lambda: "".join(r.choice(("new ", "York ", "city", " ", "\t", "of", " a", "É", ". ", ",", "\n", "\x0b", " ", "e ", "x y z ")) for _ in range(r.randrange(0, 60)))
    rows = [(r.choice(("en", "en", "de", None, "und", "")), text()) for _ in range(120)] + [("en", None), ("fr", ""), (None, None), ("en", "one two three four five six. " * 250), ("en", "a " * 3_000)]
    df = spark.createDataFrame([(a, b, "k") for a, b in rows], "lang string, text string, phrase string").repartition(5)
    got = collocation.collocations(df, least=least, longest=longest, top=top, buckets=buckets)
    assert sorted(map(tuple, got.collect())) == best_phrases(rows, least, longest, top)


def test_no_phrases(spark):
    assert collocation.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []


def test_scores_beyond_64_bits(spark, monkeypatch):
    a = 10**13
    frequent = spark.createDataFrame([("en", "x", 1, 3 * a), ("en", "y", 1, 2 * a), ("en", "x y", 2, a + 1)], "lang string, phrase string, length int, f bigint")
    totals = spark.createDataFrame([("en", 7 * 10**14)], "lang string, n bigint")
    monkeypatch.setattr(collocation, "frequent_phrases", lambda *_: (frequent, totals))
    assert [tuple(x) for x in collocation.collocations(spark.createDataFrame([], "lang string, text string")).collect()] == [("en", 1, "x y", a + 1, 3 * a, 2 * a, 7 * 10**14, 1000 * (a + 1) * 7 * 10**14 // (6 * a * a))]


def test_bitmaps_hold_what_is_frequent(spark):
    words = collocation.Words("en", b"a b c, a b. a b d")
    assert [p for p, _ in words.counted((words.whole(2)).nonzero()[0], 2)] and dict(words.counted((words.whole(2)).nonzero()[0], 2))[b"a b"] == 3
    size = collocation.CHUNK
    bits = collocation._frequent_bits(spark.createDataFrame([("en", "a b"), ("en", "b d")], "lang string, phrase string"), 2, size)
    assert collocation.has(bits, words.hashes(2)[[0, 1, 4, 7, 8]]).tolist() == [True, False, True, True, True]
