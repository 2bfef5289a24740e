"""Near-duplicate documents by HyperMinHash.

Every distinct set of shingles becomes REGISTERS registers: shingles are dealt
to registers by their hash, and each register keeps its least hash in
floating-point form, as a leading-zero count and MANTISSA bits. Small sets
would leave registers empty, so sets are sketched by size: large ones once
into all registers, smaller ones several times into fewer each; a set near a
bound is sketched both ways. Runs of ROWS registers are bands; sets that share
a band are candidates, whose similarity the registers estimate, corrected for
chance collisions, before both full sets are compared. Links are closed to
components by star contraction.

Sets that share a band are not paired off. Each is first compared with the
least of all that it shares bands with, then with the least of each band that
is still of another component. Only bands that even then hold several
components are gone through in blocks, and only pairs across components are
compared there. So a group of near copies costs a star and none of its pairs,
while no link between components is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from tidemark.llm.common import hot_join, map_text, scratch_dir, stored, table, unused
from tidemark.shipping import ship

SHINGLE = 4
#: Percent of the union that the intersection must reach.
SIMILAR = 80
REGISTERS, MANTISSA = 256, 10
#: Registers in a band: 42 bands of 6 miss a pair at similarity 0.8 with probability 3e-6.
ROWS = 6
BANDS = REGISTERS // ROWS
#: (shingles from which on a set is sketched so, registers of each part).
STYLES = ((0, 1), (64, 16), (1024, 256))
#: The estimate may fall short by so many standard deviations before a pair is given up.
SLACK = 6.0
#: Sets of a band compared at a time, if it still holds several components.
BLOCK = 128

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str) -> list[bytes]:
    # bytes know only ASCII letters and white space: A-Z and the contract's six spaces
    return text.encode().lower().split()


def shingles_of(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles; of all its words if fewer."""
    words = words_of(text) if text else []
    if not words:
        return np.empty(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(hashed) - size + 1)
    out = np.full(n, min(len(hashed), size), np.uint64)
    for k in range(min(len(hashed), size)):
        out = _scramble(out * _MIX + hashed[k : k + n])
    return np.unique(out)


def styles_of(n: int) -> list[int]:
    """The ways (places in STYLES) in which a set of n shingles is sketched.

    Two sets similar enough have sizes within SIMILAR percent, and so a way in common.
    """
    return [i for i, (least, _) in enumerate(STYLES) if n * 100 >= least * SIMILAR and (i + 1 == len(STYLES) or n * SIMILAR < STYLES[i + 1][0] * 100)]


def registers_of(shingles: np.ndarray, style: int) -> np.ndarray:
    """HyperMinHash registers as 16-bit numbers: 0 if empty, else leading zeros + 1 above the mantissa.

    The registers are parts of `width` each; every part holds the whole set
    under a hash of its own, and the top bits of that hash choose the register.
    """
    width = STYLES[style][1]
    parts, bits = REGISTERS // width, width.bit_length() - 1
    low = np.full(REGISTERS, np.uint64(0xFFFFFFFFFFFFFFFF))
    used = np.zeros(REGISTERS, bool)
    seeds = np.arange(parts, dtype=np.uint64) * _MIX
    step = max(1, 2_000_000 // parts)
    for i in range(0, len(shingles), step):
        hashed = _scramble(shingles[i : i + step][None, :] ^ seeds[:, None])
        place = np.arange(parts, dtype=np.intp)[:, None] * width
        if bits:
            place = place + (hashed >> np.uint64(64 - bits)).astype(np.intp)
            # the bits that chose the register go; a set bit below bounds the zeros
            hashed = (hashed << np.uint64(bits)) | np.uint64(1 << (bits - 1))
            np.minimum.at(low, place.ravel(), hashed.ravel())
            used[place.ravel()] = True
        else:
            np.minimum(low, (hashed | np.uint64(1)).min(axis=1), out=low)
            used[:] = True
    # a double is exact to 53 bits, and the bits that count are the top ones
    zeros = 63 - (np.frexp((low >> np.uint64(11)).astype(np.float64))[1] - 1 + 11)
    zeros = np.clip(zeros, 0, 53)
    mantissa = (low << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
    packed = ((zeros + 1).astype(np.uint64) << np.uint64(MANTISSA)) | mantissa
    return np.where(used, packed, 0).astype(np.uint16)


def sketch_of(shingles: np.ndarray) -> np.ndarray:
    """The registers of each way in which a set of this size is sketched, one row each."""
    return np.array([registers_of(shingles, style) for style in styles_of(len(shingles))], np.uint16)


def bands_of(sketch: np.ndarray, n: int) -> list[int]:
    """A hash for each band of each row of a sketch of n shingles, of its registers; its last eight bits are the style and the band's place."""
    out = []
    for style, registers in zip(styles_of(n), sketch, strict=True):
        rows = registers[: BANDS * ROWS].reshape(BANDS, ROWS)
        raw, size = rows.tobytes(), rows.itemsize * ROWS
        for b in np.flatnonzero(rows.any(axis=1)).tolist():
            h = xxhash.xxh3_64_intdigest(raw[b * size : (b + 1) * size], seed=style * BANDS + b)
            out.append(((h & ~255) | (style << 6) | b) - (1 << 63))
    return out


def rows_of(sketches: list, n: np.ndarray, style: int) -> np.ndarray:
    """The registers of one style, a row for each of the stored sketches of n shingles; each must have it."""
    places = [styles_of(k).index(style) * REGISTERS * 2 for k in n.tolist()]
    return np.stack([np.frombuffer(x, np.uint16, REGISTERS, at) for x, at in zip(sketches, places, strict=True)])


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Registers expected to agree by chance in disjoint sets of n and m (the sketch's published approximation)."""
    ratio = np.minimum(n, m) / np.maximum(np.maximum(n, m), 1)
    return 0.169919487159739093975315012348 * 4 * ratio / (1 + ratio) ** 2 * REGISTERS / 2.0**MANTISSA


def likely(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, similar: int = SIMILAR) -> np.ndarray:
    """Whether pairs of register rows of one style may be similar enough: estimate plus slack reaches the threshold."""
    filled = ((a > 0) | (b > 0)).sum(axis=-1)
    same = ((a == b) & (a > 0)).sum(axis=-1)
    estimate = (same - chance(n, m)) / np.maximum(filled, 1)
    t = similar / 100
    # of sets whose sizes differ too much none can reach it
    sizes = 100 * np.minimum(n, m) >= similar * np.maximum(n, m)
    return sizes & (estimate + SLACK * np.sqrt(t * (1 - t) / np.maximum(filled, 1)) >= t)


def likely_any(a: list, b: list, n: np.ndarray, m: np.ndarray, similar: int = SIMILAR) -> np.ndarray:
    """likely for pairs of stored sketches of n and m shingles, by any style that both have."""
    out = np.zeros(len(a), bool)
    mine, its = ([set(styles_of(k)) for k in x.tolist()] for x in (n, m))
    for style in range(len(STYLES)):
        both = np.array([i for i, (x, y) in enumerate(zip(mine, its, strict=True)) if style in x & y], np.int64)
        if len(both):
            x, y = (rows_of([v[i] for i in both], k[both], style) for v, k in ((a, n), (b, m)))
            out[both] |= likely(x, y, n[both], m[both], similar)
    return out


SKETCH = StructType([
    StructField("doc_id", LongType()), StructField("n_shingles", LongType()), StructField("digest", BinaryType()),
    StructField("registers", BinaryType()),
])
SETS = StructType([StructField("doc_id", LongType()), StructField("digest", BinaryType()), StructField("shingles", BinaryType())])


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _sketcher(size: int) -> Callable:
    def sketch(ids: list, texts: list) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in SKETCH.names}
        out["doc_id"] = ids
        for text in texts:
            shingles = shingles_of(text, size)
            out["n_shingles"].append(len(shingles))
            out["digest"].append(_digest(shingles) if len(shingles) else None)
            out["registers"].append(sketch_of(shingles).tobytes() if len(shingles) else None)
        return out

    return sketch


BANDED = StructType([StructField("node", LongType()), StructField("band", LongType())])


def _banded(nodes: list, n: list, registers: list) -> dict[str, list]:
    bands = [bands_of(np.frombuffer(x, np.uint16).reshape(-1, REGISTERS), k) for k, x in zip(n, registers, strict=True)]
    return {"node": [n for n, b in zip(nodes, bands, strict=True) for _ in b], "band": [x for b in bands for x in b]}


def _setter(size: int) -> Callable:
    def full(ids: list, texts: list) -> dict[str, list]:
        sets = [shingles_of(t, size) for t in texts]
        return {"doc_id": ids, "digest": [_digest(x) for x in sets], "shingles": [x.tobytes() for x in sets]}

    return full


PAIR = "a bigint, b bigint"


def _both_sides(pairs: DataFrame, side: Callable[[str], DataFrame]) -> DataFrame:
    """pairs with side("a") and side("b"). b is one of many; a may be the least of a large group."""
    counts = pairs.groupBy("a").agg(F.count("*").alias("n"))
    return hot_join(pairs.join(side("b"), "b"), side("a").join(counts, "a", "left_semi"), "a", by="b", counts=counts, n=pairs.count())


def _estimated(pairs: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """The pairs (a, b) that their registers don't rule out."""
    narrow = sets.select("node", "n_shingles", "registers")
    side = lambda c: narrow.select(F.col("node").alias(c), F.struct("n_shingles", "registers").alias(f"s{c}"))
    joined = _both_sides(pairs, side)
    flat = joined.select("a", "b", F.col("sa.n_shingles").alias("n"), F.col("sb.n_shingles").alias("m"), F.col("sa.registers").alias("x"), F.col("sb.registers").alias("y"))

    def keep(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks:
            if block.num_rows:
                x, y = (block.column(i).to_pylist() for i in (4, 5))
                good = likely_any(x, y, block.column(2).to_numpy(), block.column(3).to_numpy(), similar)
                yield block.select(["a", "b"]).filter(pa.array(good))

    return flat.mapInArrow(keep, PAIR)


def _full_sets(nodes: DataFrame, docs: DataFrame, sets: DataFrame, size: int) -> DataFrame:
    """(node, shingles) of these nodes, made again from their texts."""
    wanted = sets.select("node", "digest").join(nodes.distinct(), "node", "left_semi")
    texts = docs.join(wanted.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    made = map_text(texts, _setter(size), ["doc_id", "text"], SETS)
    # an id may stand for several texts; the node's is the one with its digest
    full = made.join(wanted.withColumnRenamed("node", "doc_id"), ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"])
    return full.select(F.col("doc_id").alias("node"), "shingles")


def _verified(pairs: DataFrame, full: DataFrame, similar: int) -> DataFrame:
    """The pairs (a, b) whose full sets (node, shingles) reach the threshold."""
    side = lambda c: full.select(F.col("node").alias(c), F.col("shingles").alias(f"s{c}"))
    joined = _both_sides(pairs, side)

    def keep(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks:
            good = []
            for x, y in zip(block.column(2), block.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= similar * (len(x) + len(y) - both))
            yield block.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return joined.select("a", "b", "sa", "sb").mapInArrow(keep, PAIR).distinct()


def components(links: DataFrame, folder: str, name: str = "cc") -> DataFrame:
    """(node, component): the least node that each linked node can reach.

    links: a < b. Large-star and small-star contraction by turns; every step
    is written to the scratch folder. Each node's least neighbour comes from a
    partial aggregate and is joined back by groups of its links, so hubs are
    spread out.
    """
    step, before = 0, None
    edges = stored(links.distinct(), folder, f"{name}0")
    now = _size(edges)
    if not now[0]:
        return edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    while now != before:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lows = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
        large = hot_join(both.filter("b > a"), lows.select("a", "m"), "a", by="b", counts=lows.select("a", "n"), n=2 * now[0])
        # small star: a node's smaller neighbours, and itself, move to the least of them
        down = large.filter("m < b").select(F.col("b").alias("u"), F.col("m").alias("v")).distinct()
        small = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        moved = hot_join(down, small.select("u", "m"), "u", by="v", counts=small.select("u", "n"), n=2 * now[0]).filter("v > m").select(F.col("m").alias("a"), F.col("v").alias("b"))
        moved = moved.union(small.select(F.col("m").alias("a"), F.col("u").alias("b")))
        step, before = step + 1, now
        edges = stored(moved.distinct(), folder, f"{name}{step}")
        now = _size(edges)
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component"))


def _size(edges: DataFrame) -> tuple:
    """How many links there are and the sum of their hashes, by which two steps are told apart."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def merged(found: DataFrame, links: DataFrame, folder: str, name: str) -> DataFrame:
    """found (node, component) after more links (a, b): components are contracted over the links between them."""
    of = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    placed = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("x"), F.coalesce("cb", "b").alias("y"))
    upper = components(placed.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a < b"), folder, name)
    to = upper.select(F.col("node").alias("component"), F.col("component").alias("_to"))
    sizes = found.groupBy("component").agg(F.count("*").alias("n"))
    moved = hot_join(found, to, "component", by="node", how="left", counts=sizes, n=found.count()).select("node", F.coalesce("_to", "component").alias("component"))
    return stored(moved.unionByName(upper), folder, f"{name}_all")


def _apart(pairs: DataFrame, found: DataFrame, n: int) -> DataFrame:
    """The pairs (a, b), of n at most, whose ends found has not put into one component."""
    of = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    counts = pairs.groupBy("a").agg(F.count("*").alias("n"))
    placed = hot_join(pairs.join(of("b"), "b", "left"), of("a"), "a", by="b", how="left", counts=counts, n=n)
    return placed.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def _across(members: DataFrame, docs: DataFrame, sets: DataFrame, size: int, similar: int) -> DataFrame:
    """Links (a, b) between components within each band: all components that a link of the band joins are joined.

    members: band, n (its sets), q (those outside its largest component),
    asks (whether the set is one of those), node, component, n_shingles,
    registers. Sets that ask are compared with all of the band's, in blocks of
    about BLOCK times BLOCK, so a band costs its size times what lies outside
    its largest component, and no group of rows grows with it. A pair is
    looked at only in the first band that it shares. Registers come first; the
    full sets of those that they don't rule out are then compared in the same
    blocks, and a set that asks returns one link for each component at most.
    """
    own = lambda blocks, seed: F.pmod(F.xxhash64("node", F.lit(seed)), blocks).cast("int")
    askers, asked = F.ceil(F.col("q") / BLOCK).cast("bigint"), F.ceil(F.col("n") / BLOCK).cast("bigint")
    each = lambda blocks: F.explode(F.sequence(F.lit(0), blocks.cast("int") - 1))
    columns = ["node", "component", "n_shingles", "registers"]
    ask = members.filter("asks").withColumn("_y", each(asked)).select("band", own(askers, 1).alias("_x"), "_y", F.lit(True).alias("_asks"), *columns)
    answer = members.withColumn("_x", each(askers)).select("band", "_x", own(asked, 2).alias("_y"), F.lit(False).alias("_asks"), *columns)
    place = "band bigint, _x int, _y int"

    def compare(block: pa.Table) -> pa.Table:
        comp, n, asks = (block.column(c).to_numpy() for c in ("component", "n_shingles", "_asks"))
        code = block.column("band")[0].as_py() & 255
        style, band = code >> 6, code & 63
        rows = rows_of(block.column("registers").to_pylist(), n, style)
        others, part = np.flatnonzero(~asks), np.zeros(len(rows), bool)
        for i in np.flatnonzero(asks):
            with_ = others[comp[others] != comp[i]]
            if len(with_) and band:
                earlier = slice(0, band * ROWS)
                same = (rows[with_, earlier] == rows[i, earlier]).reshape(len(with_), band, ROWS).all(axis=2)
                with_ = with_[~(same & rows[i, earlier].reshape(band, ROWS).any(axis=1)).any(axis=1)]
            if len(with_):
                with_ = with_[likely(rows[with_], rows[i], n[with_], np.full(len(with_), n[i]), similar)]
                part[with_] = True
                part[i] |= bool(len(with_))
        return block.select(["band", "_x", "_y", "_asks", "node", "component"]).filter(pa.array(part))

    def confirm(block: pa.Table) -> pa.Table:
        node, comp, asks = (block.column(c).to_numpy() for c in ("node", "component", "_asks"))
        full = [np.frombuffer(v.as_buffer(), np.uint64) for v in block.column("shingles")]
        others = np.flatnonzero(~asks)
        sizes = np.array([len(full[j]) for j in others], np.int64)
        found: set[tuple[int, int]] = set()
        if len(others):
            all_, starts = np.concatenate([full[j] for j in others]), np.concatenate([[0], np.cumsum(sizes)[:-1]])
            for i in np.flatnonzero(asks):
                at = np.searchsorted(full[i], all_)
                both = np.add.reduceat((full[i][np.minimum(at, len(full[i]) - 1)] == all_).astype(np.int64), starts)
                good = others[(100 * both >= similar * (sizes + len(full[i]) - both)) & (comp[others] != comp[i])]
                _, first = np.unique(comp[good], return_index=True)
                found |= {(min(int(node[i]), int(node[j])), max(int(node[i]), int(node[j]))) for j in good[first]}
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    maybe = ask.unionByName(answer).groupBy("band", "_x", "_y").applyInArrow(compare, f"{place}, _asks boolean, node bigint, component bigint")
    maybe = stored(maybe, scratch_dir(members.sparkSession), "maybe")
    if maybe.isEmpty():
        return maybe.select(F.col("node").alias("a"), F.col("node").alias("b"))
    with_sets = maybe.join(_full_sets(maybe.select("node"), docs, sets, size), "node")
    return with_sets.groupBy("band", "_x", "_y").applyInArrow(confirm, PAIR).distinct()


def near_duplicates(docs: DataFrame, size: int = SHINGLE, similar: int = SIMILAR) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs (doc_id, text).

    component_id is the least doc_id that links reach, kept whether it is the
    row's own. Rows with equal sets are one group, which counts as linked. A
    text that is null or has no word is linked with nothing. A row without
    doc_id keeps its n_shingles, is linked with nothing, and has a null
    component_id; it is kept. Repeated rows get equal results; if an id has
    different texts, each row has the class of its own text. Other columns are
    ignored; no rows give none. Bytes that aren't UTF-8 are read as U+FFFD.
    """
    return _classes(docs, size, similar).drop("_text")


def drop_near_duplicates(docs: DataFrame, size: int = SHINGLE, similar: int = SIMILAR) -> DataFrame:
    """docs with one row of each group of near-duplicates, the one with the least doc_id.

    Of rows that repeat an id and text one stays, the one that is least as
    JSON. Rows without doc_id or without words all stay. Columns stay as they
    are, whatever their names.
    """
    classes = stored(_classes(docs, size, similar), scratch_dir(docs.sparkSession), "classes")
    id_, text = unused(docs.columns, "_id", "_text")
    named = lambda rows: rows.select(F.col("doc_id").alias(id_), F.col("_text").alias(text))
    marked = docs.withColumns({id_: F.col("doc_id").cast("bigint"), text: F.xxhash64("text")})
    out = marked.join(named(classes.filter("NOT kept")).distinct(), [id_, text], "left_anti")
    again = classes.filter("kept AND n_shingles > 0 AND doc_id IS NOT NULL").groupBy("doc_id", "_text").count().filter("count > 1")
    again = stored(named(again), scratch_dir(docs.sparkSession), "again")
    if not again.isEmpty():
        twice = out.join(again, [id_, text], "left_semi")
        # of rows that differ elsewhere one and the same stays in every run: the least as JSON
        one = twice.withColumn(_row := unused(twice.columns, "_row")[0], F.struct(*docs.columns)).groupBy(id_, text).agg(F.min_by(_row, F.to_json(_row)).alias(_row))
        out = out.join(again, [id_, text], "left_anti").select(*docs.columns).unionByName(one.select(f"{_row}.*"))
    return out.select(*docs.columns)


def _classes(docs: DataFrame, size: int, similar: int) -> DataFrame:
    """What near_duplicates returns, and _text, a hash of each row's text."""
    if similar < SIMILAR:
        raise ValueError(f"sketches and bands are made for similarities of {SIMILAR} percent or more")
    spark = docs.sparkSession
    ship(spark)
    folder = scratch_dir(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    marked = docs.withColumn("_text", F.xxhash64("text"))
    sketches = stored(map_text(marked, _sketcher(size), ["doc_id", "text"], SKETCH, carry=True).drop("text"), folder, "sketches")
    usable = sketches.filter("doc_id IS NOT NULL AND digest IS NOT NULL")
    # one node for each distinct set, named by its least document
    groups = stored(usable.groupBy("digest").agg(F.min("doc_id").alias("node"), F.count("*").alias("n_rows")), folder, "groups")
    # a row of each group: its least document's
    leads = usable.drop("_text").join(groups.select("digest", F.col("node").alias("doc_id")), ["digest", "doc_id"]).dropDuplicates(["digest", "doc_id"])
    sets = stored(leads.withColumnRenamed("doc_id", "node"), folder, "sets")
    banded = map_text(sets, _banded, ["node", "n_shingles", "registers"], BANDED, text="registers")
    bands = stored(banded.groupBy("band").agg(F.min("node").alias("lead"), F.max("node").alias("last"), F.count("*").alias("n")).filter("n > 1"), folder, "bands")
    wide = bands.filter("n > 2").select("band", "lead", "n")
    members = stored(hot_join(banded, wide, "band", by="node", counts=wide.select("band", "n")), folder, "members")
    star = members.filter("lead < node").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    pairs = stored(bands.filter("n = 2 AND lead < last").select(F.col("lead").alias("a"), F.col("last").alias("b")).union(star).distinct(), folder, "pairs")
    pairs = stored(_estimated(pairs, sets, similar), folder, "likely")
    # the full sets of all that may be linked, made once
    full = stored(_full_sets(pairs.select(F.explode(F.array("a", "b")).alias("node")), docs, sets, size), folder, "full")
    first = stored(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), folder, "first")
    found = stored(components(stored(_verified(first, full, similar), folder, "links_first"), folder), folder, "found")
    others = stored(_apart(pairs.join(first, ["a", "b"], "left_anti"), found, pairs.count()), folder, "others")
    if not others.isEmpty():
        found = merged(found, stored(_verified(others, full, similar), folder, "links_others"), folder, "stars")

    # bands that stars have not brought into one component
    placed = members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    shares = placed.groupBy("band", "component").agg(F.count("*").alias("_m"))
    open_ = shares.groupBy("band").agg(F.max_by("component", F.struct("_m", -F.col("component"))).alias("_largest"), F.max("_m").alias("_most"), F.sum("_m").alias("n"))
    open_ = stored(open_.filter("n > _most").withColumn("q", F.col("n") - F.col("_most")), folder, "open")
    rest = hot_join(placed.drop("n"), open_, "band", by="node", counts=open_.select("band", "n"))
    rest = rest.withColumn("asks", F.col("component") != F.col("_largest")).join(sets.select("node", "n_shingles", "registers"), "node")
    more = stored(_across(rest, docs, sets, size, similar), folder, "more")
    if not more.isEmpty():
        found = merged(found, more, folder, "rest")

    named = groups.join(found, "node", "left").select("digest", "node", F.coalesce("component", "node").alias("_component"), "n_rows")
    rows = sketches.select("doc_id", "_text", "n_shingles", "digest")
    # rows that are the only one of their set, and have no link, need no look-up
    other = named.filter("n_rows > 1 OR _component <> node").select("digest", "_component")
    linked = F.col("doc_id").isNotNull() & F.col("digest").isNotNull()
    joined = hot_join(rows.filter(linked), other, "digest", by="doc_id", how="left", counts=groups.select("digest", F.col("n_rows").alias("n")))
    joined = joined.unionByName(rows.filter(~linked).withColumn("_component", F.lit(None).cast("bigint")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id"))
    return joined.select("doc_id", "_text", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
