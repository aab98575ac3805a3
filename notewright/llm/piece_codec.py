"""SentencePiece encoding and decoding by a max-plus parallel scan.

The pieces and scores of a SentencePiece model file define a lattice over a normalised text; the segmentation of the
highest total score is the unigram decoding of SentencePiece, which this operator computes for any model file
(a model of the BPE kind is read as a table of pieces and scores; see the README).

No piece holds the space sign but at its start, so a text falls into runs that no piece crosses; equal runs are decoded once.
A giant text is split into chunks of CHUNK characters.  A chunk's transfer matrix holds, for each entry
state (characters of a piece already begun in the chunk before) and each exit state, the highest score: max-plus
matrices, combined associatively in a tree of spans of FAN chunks, which gives each chunk's entry scores.  With them, each chunk says by
which entry state the best path reaches each of its exits; the path followed back gives all states, and all chunks are
traced back independently.  Chunks are rows: a giant text is spread over tasks, and only a few bytes a chunk meet in one.
Scores are multiples of 2 ** -20, so that sums are exact in any order and the two ways give the same ids, ties included.

Null text is empty; empty text has no ids.  Unknown characters fall back to byte pieces where the model has them, else to
the unknown piece.  Ties go to the segmentation whose last piece is longest, and so on back.  Rows: one for each
input row, repeated rows and null ids included.  Other columns than doc_id and text aren't read, whatever their names.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SPACE, CHUNK, GIANT, CACHE, LONG_RUN, FAN = "▁", 16_384, 65_536, 300_000, 256, 64
UNKNOWN_PENALTY = 10.0


class Pieces:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self.texts = [p.piece for p in model.pieces]
        kinds = [p.type for p in model.pieces]
        # to multiples of 2 ** -20, sums of which are exact in whatever order, so that ties are the same for all ways
        self.scores = {p.piece: (round(p.score * 2**20) / 2**20, i) for i, p in enumerate(model.pieces) if p.type in (1, 4)}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown = kinds.index(2)
        self.control = {i for i, k in enumerate(kinds) if k == 3}
        lows = [s for s, _ in self.scores.values()]
        self.unknown_score = float(min(lows)) - UNKNOWN_PENALTY
        self.longest = max(map(len, self.scores))
        #: The longest piece with each beginning of two characters.
        self.reach: dict[str, int] = {}
        for t in self.scores:
            self.reach[t[:2]] = max(len(t), self.reach.get(t[:2], 0))
        #: A trie: [next character -> node, score or None, id].
        self.trie: list = [{}, None, -1]
        for t, (gain, ident) in self.scores.items():
            node = self.trie
            for c in t:
                node = node[0].setdefault(c, [{}, None, -1])
            node[1:] = [gain, ident]
        self.plain = [None if i in self.byte_of or i in self.control else " ⁇ " if i == self.unknown else t.replace(SPACE, " ") for i, t in enumerate(self.texts)]
        if any(SPACE in t.lstrip(SPACE) for t in self.scores):
            raise ValueError("a piece holds the space sign after another character")
        self.known: dict[str, tuple[bytes, float]] = {"": (b"", 0.0)}
        self.older: dict[str, tuple[bytes, float]] = {}
        self.words: dict[str, bytes] = {}

    def normalise(self, text: str) -> str:
        """As the model file says: identity, a space sign for each space, one before the text."""
        return SPACE + text.replace(" ", SPACE) if text else ""

    def edges(self, text: str, start: int, end: int):
        """(end, score, ids) of the pieces from ``start`` on, longest last."""
        scores, found_one = self.scores, False
        for stop in range(start + 1, min(start + max(1, self.reach.get(text[start : start + 2], 1)), end) + 1):
            got = scores.get(text[start:stop])
            if got is not None:
                found_one |= stop == start + 1
                yield stop, got[0], got[1]
        if not found_one:
            yield start + 1, self.unknown_score, -1

    def ids_of(self, text: str, start: int, stop: int, ident: int) -> list[int]:
        if ident >= 0:
            return [ident]
        raw = text[start:stop].encode("utf-8", "surrogatepass")
        return [self.bytes[b] for b in raw] if len(self.bytes) == 256 else [self.unknown]

    def best(self, text: str, enter: int = 0, leave: int | None = None) -> tuple[list[int], float]:
        """Viterbi from ``enter`` to ``leave``; the piece chosen at a tie is the longest."""
        leave = len(text) if leave is None else leave
        low = -np.inf
        score = [low] * (leave + 1)
        back: list[tuple[int, int]] = [(-1, -1)] * (leave + 1)
        score[enter] = 0.0
        for at in range(enter, leave):
            if score[at] == low:
                continue
            for stop, gain, ident in self.edges(text, at, leave):
                if score[at] + gain > score[stop]:
                    score[stop], back[stop] = score[at] + gain, (at, ident)
        ids: list[int] = []
        at = leave
        while at > enter:
            before, ident = back[at]
            ids += reversed(self.ids_of(text, before, at, ident))
            at = before
        ids.reverse()
        return ids, score[leave]

    def best_run(self, text: str) -> tuple[bytes, float]:
        """As ``best`` over a whole run, by walking the trie."""
        n, low, first = len(text), -1e300, self.trie[0].get
        score, back, via = [0.0] + [low] * n, [0] * (n + 1), [-1] * (n + 1)
        for at in range(n):
            base, node, stop = score[at], first(text[at]), at
            if base == low:
                continue
            if node is None or node[1] is None:
                if base + self.unknown_score > score[at + 1]:
                    score[at + 1], back[at + 1], via[at + 1] = base + self.unknown_score, at, -1
            while node is not None:
                stop += 1
                gain = node[1]
                if gain is not None and base + gain > score[stop]:
                    score[stop], back[stop], via[stop] = base + gain, at, node[2]
                node = node[0].get(text[stop]) if stop < n else None
        ids, at = [], n
        while at:
            ident, before = via[at], back[at]
            if ident >= 0:
                ids.append(ident)
            else:
                ids += reversed(self.ids_of(text, before, at, -1))
            at = before
        ids.reverse()
        return array("i", ids).tobytes(), score[n]

    def runs(self, text: str) -> list[str]:
        """Parts that no piece crosses: space signs and what follows up to the next of them."""
        out, parts = [], text.split(SPACE)
        lead = SPACE
        if parts[0]:
            out.append(parts[0])
        for i, p in enumerate(parts[1:], 1):
            if p or i == len(parts) - 1:
                out.append(lead + p)
                lead = SPACE
            else:
                lead += SPACE
        return out

    def run(self, text: str) -> tuple[bytes, float]:
        """Ids, as 32-bit numbers, and score of a run."""
        got = self.known.get(text)
        if got is None:
            if len(self.known) > CACHE:  # two generations are kept
                self.older, self.known = self.known, {"": (b"", 0.0)}
            got = self.older.get(text) or self.best_run(text)
            self.known[text] = got
        return got

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, "<i4")
        if "  " in text or text[0] == " " or text[-1] == " " or SPACE in text:
            return np.frombuffer(b"".join([self.run(r)[0] for r in self.runs(self.normalise(text))]), "<i4")
        # every run is a space sign and what stands between two spaces
        if len(self.words) > 2 * CACHE:
            self.words.clear()
        words = self.words
        out = []
        for w in text.split(" "):
            ids = words.get(w)
            if ids is None:
                ids = words[w] = self.best_run(SPACE + w)[0]
            out.append(ids)
        return np.frombuffer(b"".join(out), "<i4")

    # the parallel scan

    def matrix(self, text: str, begin: int, end: int) -> np.ndarray:
        """Max-plus transfer matrix of text[begin:end]: [characters already taken, characters taken beyond].

        States 0 to longest - 1; a piece may end beyond ``end`` but not beyond the text.
        """
        m = self.longest
        width = end - begin
        table = np.full((m, width + m), -np.inf)
        for s in range(min(m, width + m)):
            table[s, s] = 0.0
        for at in range(width):
            column = table[:, at]
            if not np.isfinite(column).any():
                continue
            for stop, gain, _ in self.edges(text, begin + at, len(text)):
                k = stop - begin
                np.maximum(table[:, k], column + gain, out=table[:, k])
        return table[:, width : width + m]

    def transfer(self, text: str, width: int) -> np.ndarray:
        """The transfer matrix of text[:width].  No path passes over a run's start, so all that lies between the first and the last adds one sum."""
        cuts = [i for i in range(min(width, LONG_RUN)) if text[i] == SPACE and i and text[i - 1] != SPACE][:1]
        tail = next((i for i in range(width - 1, max(0, width - LONG_RUN), -1) if text[i] == SPACE and text[i - 1] != SPACE), None)
        if not cuts or tail is None or tail < cuts[0]:
            return self.matrix(text, 0, width)
        head = np.full(self.longest, -np.inf)
        for s in range(min(self.longest, cuts[0] + 1)):
            head[s] = self.best(text, s, cuts[0])[1] if s < cuts[0] else 0.0
        middle = 0.0
        for r in self.runs(text[cuts[0] : tail]):
            middle += self.run(r)[1]
        return head[:, None] + middle + self.matrix(text, tail, width)[:1]

    @staticmethod
    def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The max-plus product, which is associative."""
        return (a[:, :, None] + b[None, :, :]).max(1)

    def product(self, matrices) -> np.ndarray:
        """The product of neighbouring matrices."""
        out = None
        for x in matrices:
            out = x if out is None else self.times(out, x)
        return out

    def prefixes(self, start: np.ndarray, matrices) -> list[np.ndarray]:
        """The scores of each chunk's entry states, from those of the first one's; the last are those behind the last chunk."""
        out = [start]
        for x in matrices:
            out.append((out[-1][:, None] + x).max(0))
        return out

    def first(self) -> np.ndarray:
        """Scores of the entry states of a text."""
        out = np.full(self.longest, -np.inf)
        out[0] = 0.0
        return out

    def origins(self, text: str, width: int, prefix: np.ndarray) -> np.ndarray:
        """For each exit state of text[:width], the entry state by which the best path comes, ties as in ``best``.

        No path passes over a run's start: if there is one, it is the same for all exits.
        """
        m = self.longest
        cut = next((i for i in range(1, min(width, LONG_RUN)) if text[i] == SPACE and text[i - 1] != SPACE), None)
        end = width if cut is None else cut
        low = -np.inf
        score, origin = [low] * (end + m), [-1] * (end + m)
        for s in range(min(m, end + m)):
            score[s], origin[s] = float(prefix[s]), s if prefix[s] > low else -1
        for at in range(end):
            if score[at] == low:
                continue
            for stop, gain, _ in self.edges(text, at, len(text)):
                if score[at] + gain > score[stop]:
                    score[stop], origin[stop] = score[at] + gain, origin[at]
        return np.array(origin[width : width + m] if cut is None else [origin[cut]] * m, np.int32)

    def states(self, origins: list[np.ndarray]) -> list[int]:
        """Entry states of the chunks and the last one's exit, by following the best path back."""
        out = [0]
        for x in reversed(origins):
            out.append(int(x[out[-1]]))
        return out[::-1]

    def scan(self, text: str, chunk: int = 4096) -> list[int]:
        bounds = [*range(0, len(text), chunk), len(text)]
        spans = list(zip(bounds, bounds[1:], strict=False))
        prefixes = self.prefixes(self.first(), [self.matrix(text, a, b) for a, b in spans])
        states = self.states([self.origins(text[a : b + self.longest], b - a, p) for (a, b), p in zip(spans, prefixes, strict=False)])
        out: list[int] = []
        for (a, b), s, t in zip(spans, states, states[1:], strict=False):
            out += self.best(text[a : b + t], s, b + t - a)[0] if a + s < b + t else []
        return out

    def decode(self, ids) -> str:
        ids = ids.tolist() if isinstance(ids, np.ndarray) else ids
        parts = [self.plain[i] for i in ids]
        if None not in parts:
            text = "".join(parts)
            return text[1:] if text[:1] == " " else text
        raw = bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
            elif i not in self.control:
                raw += (" ⁇ " if i == self.unknown else self.texts[i].replace(SPACE, " ")).encode("utf-8", "surrogatepass")
        text = raw.decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def pieces(path: str) -> Pieces:
    return common.worker_held(("pieces", path), lambda: Pieces(path))


OUT = "uid long, doc_id long, n_chars long, n_ids int, ids array<int>, ids_crc32 long, round_trip boolean"
_ID_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.int64(), pa.bool_()]
_ID_NAMES = ["uid", "doc_id", "n_chars", "n_ids", "ids", "ids_crc32", "round_trip"]


def _row(own: Pieces, uid, doc, text: str, ids):
    return uid, doc, len(text), len(ids), ids, zlib.crc32(np.asarray(ids, "<u4").tobytes()), own.decode(ids) == text


def _encoding(path: str):
    def run(batches):
        own = pieces(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 100):
                part = batch.slice(start, 100)
                rows = [_row(own, uid, doc, text, own.encode(text)) for uid, doc, text in zip(*(c.to_pylist() for c in part.columns), strict=True)]
                columns = list(zip(*rows, strict=True))
                ids = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *columns[3]]), pa.int32()), pa.array(np.concatenate(columns[4]).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([ids if i == 4 else pa.array(c, t) for i, (c, t) in enumerate(zip(columns, _ID_TYPES, strict=True))], _ID_NAMES)

    return run


def _chunks(path: str):
    """A giant text's chunks, each with what a piece may take beyond it."""

    def run(batches):
        own = pieces(path)
        for batch in batches:
            for uid, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text = own.normalise(text)
                for i, a in enumerate(range(0, len(text), CHUNK)):
                    b = min(a + CHUNK, len(text))
                    yield pa.RecordBatch.from_arrays([pa.array([uid], pa.int64()), pa.array([i], pa.int32()), pa.array([b - a], pa.int32()), pa.array([text[a : b + own.longest]])], ["uid", "chunk", "width", "part"])

    return run


def _matrices(path: str):
    def run(batches):
        own = pieces(path)
        for batch in batches:
            for uid, chunk, width, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([uid]), pa.array([chunk], pa.int32()), pa.array([own.transfer(part, width).tobytes()], pa.binary())], ["uid", "chunk", "matrix"])

    return run


def _matrix(own: Pieces, data) -> np.ndarray:
    return np.frombuffer(data).reshape(own.longest, own.longest)


def _products(path: str):
    """One matrix for FAN neighbouring chunks."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pieces(path)
        pdf = pdf.sort_values("chunk")
        whole = own.product(_matrix(own, x) for x in pdf["matrix"])
        return pd.DataFrame({"uid": pdf["uid"][:1], "span": pdf["span"][:1], "matrix": [np.ascontiguousarray(whole).tobytes()]})

    return run


def _span_prefixes(path: str):
    """The entry scores of each span of FAN chunks of a text."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pieces(path)
        pdf = pdf.sort_values("span")
        found = own.prefixes(own.first(), (_matrix(own, x) for x in pdf["matrix"]))
        return pd.DataFrame({"uid": pdf["uid"], "span": pdf["span"], "prefix": [x.tobytes() for x in found[:-1]]})

    return run


def _chunk_prefixes(path: str):
    """The entry scores of each chunk of a span."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        own = pieces(path)
        left = left.sort_values("chunk")
        found = own.prefixes(np.frombuffer(right["prefix"].iloc[0]), (_matrix(own, x) for x in left["matrix"]))
        return pd.DataFrame({"uid": left["uid"], "chunk": left["chunk"], "prefix": [x.tobytes() for x in found[:-1]]})

    return run


def _origins(path: str):
    def run(batches):
        own = pieces(path)
        for batch in batches:
            for uid, chunk, width, part, prefix in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = own.origins(part, width, np.frombuffer(prefix))
                yield pa.RecordBatch.from_arrays([pa.array([uid]), pa.array([chunk], pa.int32()), pa.array([found.tobytes()], pa.binary())], ["uid", "chunk", "origins"])

    return run


def _states(path: str):
    """Follows the best path back over a text's chunks: a few bytes a chunk."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pieces(path)
        pdf = pdf.sort_values("chunk")
        states = own.states([np.frombuffer(x, np.int32) for x in pdf["origins"]])
        return pd.DataFrame({"uid": pdf["uid"], "chunk": pdf["chunk"], "enter": states[:-1], "leave": states[1:]}).astype({"enter": "int32", "leave": "int32"})

    return run


def _backtrace(path: str):
    def run(batches):
        own = pieces(path)
        for batch in batches:
            for uid, chunk, width, part, enter, leave in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                stop = width + leave
                ids = own.best(part[:stop], enter, stop)[0] if enter < stop else []
                yield pa.RecordBatch.from_arrays([pa.array([uid]), pa.array([chunk], pa.int32()), pa.array([np.asarray(ids, "<i4").tobytes()], pa.binary())], ["uid", "chunk", "ids"])

    return run


def _joined(path: str):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        own = pieces(path)
        parts = right.sort_values("chunk")["ids"]
        ids = np.frombuffer(b"".join(parts), "<i4")
        rows = [_row(own, r.uid, r.doc_id, r.text, ids) for r in left.itertuples()]
        return pd.DataFrame(rows, columns=_ID_NAMES)

    return run


def encode(docs: DataFrame, path: str, giant: int = GIANT) -> DataFrame:
    """(doc_id, n_chars, n_ids, ids, ids_crc32, round_trip), one row for each document."""
    common.prepare(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    small = rows.where(F.length("text") <= giant).mapInArrow(_encoding(path), OUT)
    large = common.materialise(rows.where(F.length("text") > giant), "pieces-giants")
    if large.isEmpty():
        return small.drop("uid")
    part = "uid long, chunk int, width int, part string"
    chunks = common.materialise(large.mapInArrow(_chunks(path), part).repartition("uid", "chunk"), "pieces-chunks")
    # up the tree: matrices of chunks, of spans of chunks; down again: entry scores of spans, of chunks
    matrices = chunks.mapInArrow(_matrices(path), "uid long, chunk int, matrix binary").withColumn("span", F.floor(F.col("chunk") / FAN).cast("int"))
    matrices = common.materialise(matrices, "pieces-matrices")
    spans = matrices.groupBy("uid", "span").applyInPandas(_products(path), "uid long, span int, matrix binary")
    starts = spans.groupBy("uid").applyInPandas(_span_prefixes(path), "uid long, span int, prefix binary")
    prefixes = matrices.groupBy("uid", "span").cogroup(starts.groupBy("uid", "span")).applyInPandas(_chunk_prefixes(path), "uid long, chunk int, prefix binary")
    origins = chunks.join(prefixes, ["uid", "chunk"]).select("uid", "chunk", "width", "part", "prefix").mapInArrow(_origins(path), "uid long, chunk int, origins binary")
    states = origins.groupBy("uid").applyInPandas(_states(path), "uid long, chunk int, enter int, leave int")
    traced = chunks.join(states, ["uid", "chunk"]).select("uid", "chunk", "width", "part", "enter", "leave").mapInArrow(_backtrace(path), "uid long, chunk int, ids binary")
    whole = large.groupBy("uid").cogroup(traced.groupBy("uid")).applyInPandas(_joined(path), OUT)
    return small.unionAll(whole).drop("uid")


def _decoding(path: str):
    def run(batches):
        own = pieces(path)
        for batch in batches:
            texts = [None if ids is None else own.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give null."""
    common.prepare(encoded.sparkSession)
    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(_decoding(path), "doc_id long, text string")
