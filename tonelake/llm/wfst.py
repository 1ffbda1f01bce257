"""SentencePiece encoding and decoding as paths over the pieces of a model.

The normaliser writes the space sign and the leading dummy space; models with a character map are refused. Every piece is
an arc, and every other character goes through byte pieces. No transducers are composed as such: the arcs are looked up
position by position, in a set or a tree of the pieces.

In a unigram model an arc weighs the piece's negative log-probability and the path of least weight wins, position by
position. In a BPE model a piece may follow another only where merging their joint text leaves the boundary between them;
the path is found by a depth-first search, and by plain merging should the search find none. Since merges on both sides
of a boundary that stays are independent, exactly one path is left, and it is the one that merging finds.

Piece texts never hold certain neighbouring characters (a letter before the space sign, say). Paths split there, so
texts are composed word by word and words seen before are remembered, up to a bound.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonelake.llm.common import released

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
CACHED_WORDS = 250_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[at : at + size]
        at += size


class Transducer:
    """The compiled model: normaliser, pieces and byte fallback."""

    def __init__(self, model: bytes) -> None:
        self.texts: list[str] = []
        self.kinds: list[int] = []
        self.scores: list[float] = []
        self.bpe, self.fallback, self.prefix, self.squeeze = False, False, True, True
        for number, value in _fields(model):
            if number == 1:
                f = dict(_fields(value))
                self.texts.append(f[1].decode())
                self.scores.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
                self.kinds.append(f.get(3, NORMAL))
            elif number == 2:
                f = dict(_fields(value))
                self.bpe, self.fallback = f.get(3, 1) == 2, bool(f.get(35, 0))
            elif number == 3:
                f = dict(_fields(value))
                if f.get(2):
                    raise ValueError("the model's normaliser has a character map; only rules for spaces are compiled")
                self.prefix, self.squeeze = bool(f.get(3, 1)), bool(f.get(4, 1))
        self.arcs = {t: i for i, (t, k) in enumerate(zip(self.texts, self.kinds)) if k in (NORMAL, USER) and t}
        self.floor = min(self.scores, default=0.0) - 10  # worse than any piece
        self.longest = max(map(len, self.arcs), default=1)
        self.bytes = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(self.texts, self.kinds)) if k == BYTE}
        self.unknown = next((i for i, k in enumerate(self.kinds) if k == UNKNOWN), 0)
        self.beside = {t[k : k + 2] for t in self.arcs for k in range(len(t) - 1)}
        self.output = [bytes([int(t[3:5], 16)]) if k == BYTE else b" \xe2\x81\x87 " if k == UNKNOWN else b"" if k == CONTROL else t.replace(SPACE, " ").encode() for t, k in zip(self.texts, self.kinds)]
        # A word can be cut off before each space sign unless pieces hold a sign after another character.
        self.by_word = not any(SPACE in t.lstrip(SPACE) for t in self.arcs)
        self.follows: dict[str, dict[str, bool]] = {}
        self.tree: dict = {}
        for piece in self.arcs:
            node = self.tree
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = " ".join(x for x in text.split(" ") if x)
        if self.prefix and text:
            text = " " + text
        return text.replace(" ", SPACE)

    def _merged(self, text: str) -> list[str]:
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                piece = self.arcs.get(parts[k] + parts[k + 1])
                if piece is not None and (best is None or self.scores[piece] > best):
                    best, at = self.scores[piece], k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _may_follow(self, left: str, right: str) -> bool:
        known = left[-1] + right[0] not in self.beside or self._merged(left + right) == [left, right]
        if len(self.follows) >= CACHED_WORDS:
            self.follows.clear()
        self.follows.setdefault(left, {})[right] = known
        return known

    def path(self, text: str) -> list[str]:
        """Piece texts on the shortest path; single characters without an arc stand for their bytes."""
        return self._merge_path(text) if self.bpe else self._least_path(text)

    def _least_path(self, text: str) -> list[str]:
        """Least sum of negative scores, position by position."""
        arcs, scores, size = self.arcs, self.scores, len(text)
        cost, last = [0.0] + [float("inf")] * size, [""] * (size + 1)
        for end in range(1, size + 1):
            for start in range(max(0, end - self.longest), end):
                piece = text[start:end]
                arc = arcs.get(piece)
                if arc is None and end - start > 1:
                    continue
                total = cost[start] - (scores[arc] if arc is not None else self.floor)
                if total < cost[end]:
                    cost[end], last[end] = total, piece
        out = []
        while size:
            out.append(last[size])
            size -= len(last[size])
        return out[::-1]

    def _merge_path(self, text: str) -> list[str]:
        """The path without an infinite weight. Finite paths all weigh nothing, so the search goes depth first, long
        arcs first; a position belongs to one partial path only, so one that leads nowhere is never entered again."""
        follows, may, size = self.follows, self._may_follow, len(text)
        dead, out, open_ = bytearray(size + 1), [], []
        at, last, ends = 0, None, self._ends(text, 0)
        while at < size:
            while ends:
                end = ends.pop()
                if dead[end]:
                    continue
                piece = text[at:end]
                if last is not None:
                    known = follows.get(last)
                    fits = known.get(piece) if known is not None else None
                    if not (may(last, piece) if fits is None else fits):
                        continue
                open_.append((at, last, ends))
                out.append(piece)
                at, last = end, piece
                ends = self._ends(text, end)
                break
            else:
                if not open_:
                    return self._merged(text)
                dead[at] = 1
                out.pop()
                at, last, ends = open_.pop()
        return out

    def _ends(self, text: str, start: int) -> list[int]:
        """Where the arcs from a position end, in order: a walk down the tree of pieces."""
        node, ends, size, at = self.tree, [], len(text), start
        while at < size:
            node = node.get(text[at])
            if node is None:
                break
            at += 1
            if "" in node:
                ends.append(at)
        if start < size and (not ends or ends[0] > start + 1):
            ends.insert(0, start + 1)
        return ends

    def _ids(self, text: str) -> bytes:
        """Ids of one piece-closed part of a text, as packed int32."""
        out: list[int] = []
        for piece in self.path(text):
            arc = self.arcs.get(piece)
            if arc is not None:
                out.append(arc)
            elif self.fallback:
                out += [self.bytes[b] for b in piece.encode()]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return struct.pack(f"<{len(out)}i", *out)

    def _word(self, word: str) -> bytes:
        """Ids of a word that starts with its space signs; parts that no piece can join are looked up alone."""
        found = self.old.get(word)
        if found is None:
            beside, cuts = self.beside, [0]
            cuts += [k for k in range(1, len(word)) if word[k - 1 : k + 1] not in beside]
            if len(cuts) == 1 or not self.fallback:
                found = self._ids(word)
            else:
                parts = [word[a:b] for a, b in zip(cuts, [*cuts[1:], len(word)])]
                found = b"".join([self.young.get(p) or self._word(p) for p in parts])
        if len(self.young) >= CACHED_WORDS:
            self.old, self.young = self.young, {}
        if len(word) <= 64:
            self.young[word] = found
        return found

    def forget(self) -> None:
        """Drop the words seen so far: a worker keeps its transducer for the next task, but not the words of this one."""
        self.young, self.old = {}, {}
        self.follows.clear()

    def encode(self, text: str) -> np.ndarray:
        text = self.normalise(text)
        if not self.by_word:
            return np.frombuffer(self._ids(text), np.int32)
        parts = text.split(SPACE)
        if "" in parts[1:] or not self.prefix:  # runs of signs stay with the word after them
            words, signs = ([parts[0]] if parts[0] else []), ""
            for p in parts[1:]:
                signs += SPACE
                if p:
                    words.append(signs + p)
                    signs = ""
            words += [signs] if signs else []
        else:
            words = [SPACE + p for p in parts[1:]]
        get, word = self.young.get, self._word
        return np.frombuffer(b"".join([get(w) or word(w) for w in words]), np.int32)

    def decode(self, ids: list[int]) -> str:
        output = self.output
        data = b"".join([output[i] for i in ids])
        if self.prefix and data.startswith(b" "):
            data = data[1:]
        return data.decode("utf-8", "replace")


@lru_cache(2)
def _compiled(model: bytes) -> Transducer:
    return Transducer(model)


def _model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model_path: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with a column ``out`` of piece ids in place of a column of that name. Null texts count as empty: no ids.

    The model file is read once, by the driver, and sent with the tasks (half a megabyte for 32,000 pieces).
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(_model(model_path))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        transducer = _compiled(model.value)
        for texts in batches:
            ids = [transducer.encode(t.as_py() or "") for t in texts]
            offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
        transducer.forget()

    return docs.withColumn(out, F.arrow_udf(run, "array<int>")(F.col(text_col)))


def decode(docs: DataFrame, model_path: str, ids_col: str = "ids", out: str = "text") -> DataFrame:
    """``docs`` with a column ``out`` of the texts of piece ids; null ids give an empty text."""
    model = docs.sparkSession.sparkContext.broadcast(_model(model_path))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        transducer = _compiled(model.value)
        for column in batches:
            yield pa.array([transducer.decode(ids.as_py() or []) for ids in column], pa.string())

    return docs.withColumn(out, F.arrow_udf(run, "string")(F.col(ids_col)))


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids, lossless)``, one row per input row: ids, and whether they decode to the text again.

    Null and empty texts have no ids and are lossless as the empty text. The space sign itself (U+2581) decodes to a
    space, as the model has it. Null ids and repeated rows are kept; other columns are not read. Very long texts go through
    whole, word by word, so their ids are one row. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(_model(model_path))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = _compiled(model.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = part.column(1).to_pylist()
                ids = [transducer.encode(t) for t in texts]
                sizes = np.fromiter(map(len, ids), np.int32, len(ids))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]).astype(np.int32)), pa.array(np.concatenate(ids)))
                same = [transducer.decode(i.tolist()) == t for i, t in zip(ids, texts)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), lists, pa.array(same)], names=["doc_id", "n_tokens", "ids", "lossless"])
        transducer.forget()

    return rows.mapInArrow(released(run), f"doc_id {kind}, n_tokens int, ids array<int>, lossless boolean")
