"""Token counts without tokens: a BPE vocabulary compiled to a transducer.

Merging by rank gives the one split of a text in which every two neighbours
are a pair that merging their joined text would give again. So the last piece
of each prefix is determined by the last pieces of shorter ones, and what a
later letter can still change is finite: how long the present end is a
beginning of some piece, and the last piece and count at each place in it.
These are the states of a deterministic transducer; each transition carries
by how much the number of pieces changes. States and transitions are made
when first needed.

A text is cut into chunks. A chunk's map tells, for the states in which it may
be entered, in which state it is left and how many pieces it adds. Maps compose
by looking one's exit up in the other's entries, in any grouping; a scan over
the maps of a text gives its count. The states in which a chunk may be entered
come from the letters before it: after a space, which no piece spans, there is
one; else the transducer is run over those letters from several places, as
nearly all histories end in the same few states. A state that is entered all
the same without being in a map is run when maps are composed.

Long texts are cut first, and their chunks go to tasks of their own.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from tidemark.llm.common import kept, map_text, scratch_dir, stored, table

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
#: Letters in a chunk, and letters of a text whose chunks are spread over tasks.
CHUNK, LONG = 1 << 16, 1 << 20
#: The states in which a chunk may be entered are looked for so many letters, and up to SHIFTS fewer, before it.
BEFORE, SHIFTS = 64, 16
#: What a process keeps: words of known count in each of two generations, and states.
CACHE_WORDS, MAX_STATES = 300_000, 400_000
MARK = "▁"
#: A word: marks and what follows them. A letter followed by a mark is where the transducer resets.
SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Transducer:
    """Counts of pieces, letter by letter.

    scores: pieces by their merge score (the higher is merged first). Letters
    without a piece fall back to one piece per byte and reset the state.
    """

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.alphabet = {c for p in scores for c in p}
        self.begins = {p[:i] for p in scores for i in range(1, len(p))}
        self.longest = max(map(len, scores), default=1)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}
        self._reset()

    def _reset(self) -> None:
        # a state: the live end, and for each place in it (the piece that ends there, count relative to now)
        start = ("", (("", 0),))
        self.states = [start]
        self.ids = {start: 0}
        self.moves: list[dict[str, tuple[int, int]]] = [{}]

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text, by merging; used on single pieces and pairs only."""
        parts = [c for c in text]
        while len(parts) > 1:
            best = max(range(len(parts) - 1), key=lambda i: (self.scores.get(parts[i] + parts[i + 1], -1e18), -i))
            if parts[best] + parts[best + 1] not in self.scores:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def stands(self, piece: str) -> bool:
        if piece not in self.whole:
            self.whole[piece] = self.merged(piece) == [piece]
        return self.whole[piece]

    def compatible(self, a: str, b: str) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > MAX_STATES:
                self.pairs.clear()
            known = self.pairs[a, b] = not a or self.merged(a + b) == [a, b]
        return known

    def move(self, state: int, letter: str) -> tuple[int, int]:
        """(next state, change of the count)."""
        if letter not in self.alphabet:
            return self._at(("", (("", 0),))), len(letter.encode("utf-8", "surrogatepass"))
        live, places = self.states[state]
        text, n = live + letter, len(live)
        for size in range(1, min(len(text), self.longest) + 1):
            piece = text[-size:]
            last, count = places[n + 1 - size]
            if piece in self.scores and self.stands(piece) and self.compatible(last, piece):
                change = count + 1
                break
        else:
            # the alphabet has a piece of its own for every letter in it, but for odd vocabularies
            piece, change = letter, 1
        places = [(p, c - change) for p, c in places] + [(piece, 0)]
        while text and text not in self.begins:
            text = text[1:]
        return self._at((text, tuple(places[len(places) - len(text) - 1 :]))), change

    def _at(self, state: tuple) -> int:
        found = self.ids.get(state)
        if found is None:
            found = self.ids[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
        return found

    def run(self, word: str, state: int = 0) -> tuple[int, int]:
        """(the state after a word, pieces that it adds), from a state on."""
        total, moves = 0, self.moves
        for letter in word:
            step = moves[state].get(letter)
            if step is None:
                step = moves[state][letter] = self.move(state, letter)
            state = step[0]
            total += step[1]
        return state, total

    def make_room(self) -> None:
        """Forget all states if there are too many; numbers of states don't outlive this."""
        if len(self.states) > MAX_STATES:
            self._reset()

    def count(self, word: str) -> int:
        """Pieces of a word, from the start state on."""
        self.make_room()
        return self.run(word)[1]


class Counts(dict):
    """Counts by word. Two generations of bounded size; lost words are counted again."""

    def __init__(self, transducer: Transducer):
        self.transducer, self.old = transducer, {}

    def __missing__(self, word: str) -> int:
        n = self.old.get(word)
        if n is None:
            n = self.transducer.count(word)
        if len(word) <= 64:
            if len(self) >= CACHE_WORDS:
                self.old = dict(self)
                self.clear()
            self[word] = n
        return n


#: The state after nothing, in the form that goes from process to process.
START = ("", (("", 0),))


@dataclass
class ChunkMap:
    """What a chunk does to the transducer: for each entry state its exit state and how many pieces it adds.

    fresh: it begins where the transducer resets, so every entry is START.
    again: runs the chunk from a state that moves doesn't have; None where its letters aren't at hand.
    """

    moves: dict[tuple, tuple[tuple, int]]
    fresh: bool
    again: Callable[[tuple], tuple[tuple, int]] | None = None

    def __call__(self, state: tuple) -> tuple[tuple, int]:
        state = START if self.fresh else state
        found = self.moves.get(state)
        if found is None:
            if self.again is None:
                raise LookupError("a chunk is entered in a state that was not foreseen")
            found = self.moves[state] = self.again(state)
        return found

    def then(self, after: ChunkMap) -> ChunkMap:
        """The map of both chunks, entered in the states in which this one is."""

        def through(state: tuple) -> tuple[tuple, int]:
            middle, n = self(state)
            end, m = after(middle)
            return end, n + m

        return ChunkMap({s: through(s) for s in self.moves}, self.fresh, through)


def map_of(chunk: str, before: str, counts: Counts) -> ChunkMap:
    """The map of a chunk after these letters: all of the text's, or BEFORE of them at least."""
    t = counts.transducer
    t.make_room()
    head, *words = SEGMENT.findall(chunk)
    fresh = not before or (chunk[0] == MARK and before[-1] != MARK)
    inside = sum(map(counts.__getitem__, words[:-1]))
    end = t.states[t.run(words[-1])[0]] if words else None
    inside += counts[words[-1]] if words else 0

    def run(state: tuple) -> tuple[tuple, int]:
        after, n = t.run(head, t._at(state))
        return (end if words else t.states[after]), n + inside

    if fresh:
        entries = {START}
    else:
        near = before[-BEFORE:]
        # from the last reset on there is one history only
        last = SEGMENT.findall(near)[-1]
        known = len(last) < len(near) or len(near) == len(before)
        entries = {t.states[t.run(last[i:])[0]] for i in range(1 if known else SHIFTS)}
    return ChunkMap({s: run(s) for s in entries}, fresh, run)


def scan(maps: list[ChunkMap]) -> ChunkMap:
    """The composition of all maps, pair by pair, as parallel scans go."""
    while len(maps) > 1:
        paired = [a.then(b) for a, b in zip(maps[::2], maps[1::2], strict=False)]
        maps = paired + maps[len(maps) & ~1 :]
    return maps[0]


def marked(text: str) -> str:
    return MARK + text.replace(" ", MARK)


def count_text(text: str, counts: Counts, chunk: int = CHUNK) -> int:
    if not text:
        return 0
    letters = marked(text)
    if len(letters) <= chunk:
        # one chunk, entered in START
        return sum(map(counts.__getitem__, SEGMENT.findall(letters)))
    maps = [map_of(letters[i : i + chunk], letters[max(0, i - 2 * BEFORE) : i], counts) for i in range(0, len(letters), chunk)]
    return scan(maps)(START)[1]


def load(path: str | None) -> Counts:
    """The counts of a process, kept between its tasks."""

    def compiled() -> Counts:
        import public_tokenizers
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(MODEL))
        usual = (i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)))
        scores = {model.id_to_piece(i): model.get_score(i) for i in usual}
        if any(MARK in p.lstrip(MARK) for p in scores):
            raise ValueError("a piece spans words; words can't be counted one by one")
        return Counts(Transducer(scores))

    return kept(("token_count", path), compiled)


RESULT = StructType([StructField("doc_id", LongType()), StructField("n_bytes", LongType()), StructField("n_tokens", LongType())])


def _count(counts: Counts, ids: list, texts: list) -> dict[str, list]:
    return {
        "doc_id": ids,
        "n_bytes": [len(t.encode()) if t else 0 for t in texts],
        "n_tokens": [count_text(t, counts) if t else 0 for t in texts],
    }


_ROW = [StructField("doc_id", LongType()), StructField("n_bytes", LongType()), StructField("digest", StringType())]
_PART = StructType([*_ROW, StructField("chunk", LongType()), StructField("before", StringType()), StructField("letters", StringType())])
_MAP = StructType([*_ROW, StructField("chunk", LongType()), StructField("fresh", BooleanType()), StructField("moves", StringType())])


def _cut(ids: list, texts: list) -> dict[str, list]:
    """A row for each chunk of each text, with the letters before it."""
    out: dict[str, list] = {k: [] for k in _PART.names}
    for doc_id, text in zip(ids, texts, strict=True):
        data, letters = text.encode(), marked(text)
        starts = range(0, len(letters), CHUNK)
        row = [doc_id, len(data), hashlib.sha256(data).hexdigest()]
        for name, value in zip(_PART.names, row, strict=False):
            out[name] += [value] * len(starts)
        out["chunk"] += range(len(starts))
        out["before"] += [letters[max(0, i - 2 * BEFORE) : i] for i in starts]
        out["letters"] += [letters[i : i + CHUNK] for i in starts]
    return out


def _mapped(counts: Counts, *columns: list) -> dict[str, list]:
    *kept, before, letters = columns
    maps = [map_of(x, b, counts) for x, b in zip(letters, before, strict=True)]
    return dict(zip(_MAP.names, kept, strict=False)) | {"fresh": [m.fresh for m in maps], "moves": [json.dumps([*m.moves.items()]) for m in maps]}


def _frozen(x: object) -> object:
    return tuple(map(_frozen, x)) if isinstance(x, list) else x


def _composed(rows: pd.DataFrame) -> pd.DataFrame:
    """The maps of one text composed; no count if a chunk was entered in a state that its map doesn't have."""
    times = int((rows["chunk"] == 0).sum())
    rows = rows.drop_duplicates("chunk").sort_values("chunk")
    maps = [ChunkMap(dict(_frozen(json.loads(m))), bool(f)) for m, f in zip(rows["moves"], rows["fresh"], strict=True)]
    try:
        n = scan(maps)(START)[1]
    except LookupError:
        n = None
    first = rows.iloc[0]
    return pd.DataFrame({"doc_id": [first["doc_id"]] * times, "n_bytes": first["n_bytes"], "digest": first["digest"], "n_tokens": pd.array([n] * times, "Int64")})


def _count_long(docs: DataFrame, path: str | None) -> DataFrame:
    """count_tokens for long texts: each chunk is mapped in a task of its own, and what meets again are the maps."""
    make = lambda: load(path)
    parts = map_text(docs, _cut, ["doc_id", "text"], _PART).repartition("digest", "chunk")
    maps = map_text(parts, _mapped, _PART.names, _MAP, text="letters", make=make)
    counted = stored(maps.groupBy("doc_id", "digest").applyInPandas(_composed, StructType([*_ROW, RESULT["n_tokens"]])), scratch_dir(docs.sparkSession), "long")
    done = counted.filter("n_tokens IS NOT NULL").drop("digest")
    open_ = counted.filter("n_tokens IS NULL").select("digest").distinct()
    # histories that leave states of their own are rare: such texts are gone through in one piece
    rest = docs.withColumn("digest", F.sha2("text", 256)).join(open_, "digest", "left_semi")
    return done.unionByName(map_text(rest, _count, ["doc_id", "text"], RESULT, make=make)).select(*RESULT.names)


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens for each row of docs (doc_id, text).

    path: a SentencePiece BPE model with byte fallback and identity
    normalisation, by default the public one. A null text counts as empty: no
    bytes, no tokens. A null doc_id stays null, repeated rows repeat, other
    columns are ignored, no rows give none. Bytes that aren't UTF-8 are read as
    U+FFFD. Texts of more than LONG letters are cut into chunks that are
    counted in parallel.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    long = F.length("text") > LONG
    usual = map_text(docs.filter(F.col("text").isNull() | ~long), _count, ["doc_id", "text"], RESULT, make=lambda: load(path))
    return usual.unionByName(_count_long(docs.filter(long).withColumn("text", F.make_valid_utf8("text")), path))


def op3_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > LIMIT)
