"""Rule texts: what makes many of them take no longer than they need."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tidemark.catalog import FIELDS
from tidemark.plans import checking, texts
from tidemark.plans.checking import distance, nearest

NAMES = [f.name for f in FIELDS]


def plainly(name, known):
    """The rule for the nearest name, going through all of them."""
    low, known = name.lower(), sorted(known)
    ranked = sorted((distance(low, k.lower()), k) for k in known)
    if ranked and ranked[0][0] <= min(3, 1 + len(name) // 5):
        return ranked[0][1]
    related = [k for k in known if len(low) >= 4 and (low in k.lower() or k.lower() in low)]
    return related[0] if len(related) == 1 else None


def changed(rng, name):
    out = list(name)
    for _ in range(rng.randint(0, 4)):
        i = rng.randrange(len(out)) if out else 0
        match rng.randrange(4):
            case 0:
                out.insert(i, rng.choice("abc_17hZ"))
            case 1:
                del out[i : i + 1]
            case 2:
                out[i : i + 1] = [rng.choice("abc_17hZ")]
            case _:
                out[i : i + 2] = out[i : i + 2][::-1]
    return "".join(out)


def test_the_nearest_name_is_what_all_distances_say():
    rng = random.Random(4)
    for name in [changed(rng, rng.choice(NAMES)) for _ in range(250)] + ["", "a", "zzzzzz17", "amount_sum", "AMOUNT"]:
        assert nearest(name, NAMES) == plainly(name, NAMES), name
    assert nearest("x", []) is None and nearest("ab", ["b", "a"]) == plainly("ab", ["b", "a"]) == "a"


def test_few_distances_are_worked_out(monkeypatch):
    asked = []
    monkeypatch.setattr(checking, "distance", lambda a, b: asked.append(b) or distance(a, b))
    for i in range(50):
        assert nearest(f"zzzzzz{i + 900_000}", NAMES) is None
    assert not asked
    for _ in range(50):
        assert nearest("amout", NAMES) == "amount"
    assert len(asked) < 5


def test_texts_of_one_file_go_to_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(texts, "TASK", 10)
    spark.range(95).coalesce(1).write.parquet(str(tmp_path / "t"))
    df = texts.spread(spark.read.parquet(str(tmp_path / "t")))
    assert df.rdd.getNumPartitions() == 10 and df.count() == 95 and df.agg(F.sum("id")).first()[0] == 95 * 47
    assert texts.spread(df.filter("id < 0")).count() == 0
