"""Byte-level BPE, encoding and decoding, by a two-tier lookup.

Each match of the pre-token pattern is looked up whole in a minimal perfect
hash of the vocabulary; one that is no entry is merged by a heap over a linked
list of its bytes.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from tidemark.llm.common import kept, map_text, table

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Pre-tokens of known ids that a process keeps in each of two generations.
CACHE_TOKENS = 200_000


class PerfectHash:
    """A minimal perfect hash from keys (bytes) to their values.

    Keys go to buckets of two in the mean; each bucket, the fullest first,
    gets the least displacement that puts its keys on free slots of a table
    with exactly as many slots as there are keys. Buckets of one key, which come
    last, name one of the slots that are left (as -1 - slot).
    """

    def __init__(self, values: dict[bytes, int]):
        n = self.n = len(values)
        self.n_buckets = max(1, n // 2)
        self.shift = [0] * self.n_buckets
        self.keys: list[bytes | None] = [None] * n
        self.values = [0] * n
        buckets: dict[int, list] = {}
        for key in values:
            h = xxhash.xxh3_64_intdigest(key)
            buckets.setdefault(h % self.n_buckets, []).append((h, key))
        left = None
        for bucket, members in sorted(buckets.items(), key=lambda x: (-len(x[1]), x[0])):
            if len(members) == 1:
                left = left or [s for s in range(n) if self.keys[s] is None]
                slot, key = left.pop(), members[0][1]
                self.shift[bucket] = -1 - slot
                self.keys[slot], self.values[slot] = key, values[key]
                continue
            d = 0
            while True:
                slots = [self._slot(h, d) for h, _ in members]
                if len(set(slots)) == len(slots) and all(self.keys[s] is None for s in slots):
                    break
                d += 1
            self.shift[bucket] = d
            for s, (_, key) in zip(slots, members, strict=True):
                self.keys[s], self.values[s] = key, values[key]

    def _slot(self, h: int, d: int) -> int:
        # mixed again for every displacement, so that no two keys clash at all of them
        x = (h ^ (d * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF
        x = ((x ^ (x >> 31)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
        return (x ^ (x >> 29)) % self.n

    def find(self, key: bytes) -> int | None:
        if not self.n:
            return None
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.n_buckets]
        slot = self._slot(h, d) if d >= 0 else -1 - d
        return self.values[slot] if self.keys[slot] == key else None


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.split = regex.compile(pattern).findall
        self.words = PerfectHash(ranks)
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.packed = {i: i.to_bytes(4, "little") for i in self.bytes_of}
        self.base = [ranks.get(bytes([b])) for b in range(256)]
        if None in self.base:
            raise ValueError("the vocabulary lacks single bytes")
        self.width = max(ranks.values(), default=0) + 1
        # what two neighbours merge to, by both ids
        self.merges = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    self.merges[a * self.width + b] = rank
        self.cache = Encoded(self)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token by merging the lowest rank first, the leftmost of equals."""
        ids: list = [self.base[b] for b in piece]
        n, width, known = len(ids), self.width, self.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # (rank, place of the left end, what both ends were)
        pairs = [a * width + b for a, b in zip(ids, ids[1:], strict=False)]
        heap = [(rank, i, pair) for i, pair in enumerate(pairs) if (rank := known(pair)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, pair = heapq.heappop(heap)
            j = after[i]
            # stale unless both ends are still what they were
            if j >= n or ids[i] < 0 or ids[i] * width + ids[j] != pair:
                continue
            ids[i], ids[j] = rank, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                pair = rank * width + ids[k]
                if (new := known(pair)) is not None:
                    heapq.heappush(heap, (new, i, pair))
            h = before[i]
            if h >= 0:
                pair = ids[h] * width + rank
                if (new := known(pair)) is not None:
                    heapq.heappush(heap, (new, h, pair))
        return [x for x in ids if x >= 0]

    def ids(self, token: str) -> list[int]:
        piece = token.encode()
        whole = self.words.find(piece)
        return [whole] if whole is not None else self.merge(piece)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.cache.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class Encoded(dict):
    """Encoded pre-tokens. Two generations of bounded size; lost ones are encoded again."""

    def __init__(self, bpe: ByteBpe):
        self.bpe, self.old = bpe, {}

    def __missing__(self, token: str) -> bytes:
        out = self.old.get(token)
        if out is None:
            out = b"".join(map(self.bpe.packed.__getitem__, self.bpe.ids(token)))
        if len(token) <= 64:
            if len(self) >= CACHE_TOKENS:
                self.old = dict(self)
                self.clear()
            self[token] = out
        return out


def read_ranks(lines: Iterable[bytes]) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def load(path: str | None) -> ByteBpe:
    """The tokenizer of a process, kept between its tasks."""

    def read() -> ByteBpe:
        import public_tokenizers

        with open(path or public_tokenizers.path(RANKS), "rb") as file:
            return ByteBpe(read_ranks(file), public_tokenizers.PATTERN)

    return kept(("byte_bpe", path), read)


ENCODED = StructType([StructField("doc_id", LongType()), StructField("n_tokens", LongType()), StructField("ids", BinaryType())])
DECODED = StructType([*ENCODED.fields, StructField("decoded", BinaryType())])


def _encode(bpe: ByteBpe, ids: list, texts: list) -> dict[str, list]:
    out = [bpe.encode(t) if t else b"" for t in texts]
    return {"doc_id": ids, "n_tokens": [len(x) // 4 for x in out], "ids": out}


def _decode(bpe: ByteBpe, doc_ids: list, n: list, ids: list) -> dict[str, list]:
    return {"doc_id": doc_ids, "n_tokens": n, "ids": ids, "decoded": [None if x is None else bpe.decode(x) for x in ids]}


def encode(docs: DataFrame, path: str | None = None, carry: bool = False) -> DataFrame:
    """doc_id, n_tokens and ids for each row of docs (doc_id, text).

    ids holds little-endian unsigned 32-bit integers, so that a long text is one
    binary value. A null text counts as empty and has no ids; a null doc_id
    stays null; repeated rows repeat; no rows, none. Other columns are ignored,
    or with carry kept, unless they have one of these names. Bytes of a text that
    aren't UTF-8 are read as U+FFFD and encoded as that.
    """
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return map_text(docs, _encode, ["doc_id", "text"], ENCODED, make=lambda: load(path), carry=carry)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """encoded with decoded, the bytes of its ids; null ids decode to null, an unknown id is an error.

    Other columns stay, repeated rows repeat; no rows, none.
    """
    return map_text(encoded, _decode, ENCODED.names, DECODED, text="ids", make=lambda: load(path), carry=True)


def _both(bpe: ByteBpe, doc_ids: list, texts: list) -> dict[str, list]:
    out = _encode(bpe, doc_ids, texts)
    return _decode(bpe, out["doc_id"], out["n_tokens"], out["ids"])


def round_trip(docs: DataFrame, path: str | None = None, carry: bool = False) -> DataFrame:
    """decode(encode(docs)) by one tokenizer in one process per task.

    A null text decodes to no bytes, one with bytes that aren't UTF-8 to U+FFFD in
    their place; rows and columns are treated as by encode.
    """
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return map_text(docs, _both, ["doc_id", "text"], DECODED, make=lambda: load(path), carry=carry)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = round_trip(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
