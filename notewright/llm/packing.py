"""Packing along a Hilbert curve.

Each document's token ids are hashed to fixed pseudo-random vectors of DIMS components; their mean is the
document's place in a small cube.  Documents are range-sorted
by the place's Hilbert key (ties by doc_id, so that equal documents, however many, spread over tasks) and packed in
that order: sequences of LIMIT tokens are filled to the last token, cutting where they end.  What is
left at the end of a task's range is cut into powers of two, which need no padding.

Null or empty text: the end id alone.  Rows: one for each piece; repeated rows and null ids are documents of their own.
An empty table gives no rows.  Other columns than the id and the text aren't read, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LIMIT, END_ID, DIMS, BITS = 2048, 1, 4, 12
#: Characters of text that are encoded together, at least one document.
TOGETHER = 10_000_000
#: Distinct runs whose ids a worker keeps between calls.
CACHE = 300_000
_BLANKS = str.maketrans("\n\t\r", "   ")
_TAILED = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]+)")


def latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Encoder:
    """Token ids of whole texts, as 16-bit numbers (the vocabulary is below 65 536).

    No token spans white space, so each distinct run between, of all texts at hand, is encoded once.
    Runs of letters end at their one token with a word end, so many of them are encoded in one call; a call that gives another
    number of ends holds a letter whose lower case is more than letters, and its runs are encoded one by one.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are parallel already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # for lower-case Latin-1 letter runs, the normaliser and the pattern have nothing to do
        lean = json.loads(self.tokenizer.to_str())
        lean["normalizer"] = None
        lean["pre_tokenizer"]["pretokenizers"][0] = {"type": "WhitespaceSplit"}
        self.lean = Tokenizer.from_str(json.dumps(lean))
        self.ends = np.zeros(1 << 16, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        #: Ids of runs met before, and the letter runs among them that are several parts to the tokenizer.
        self.known: dict[str, bytes] = {"": b""}
        self.several: set[str] = set()

    def plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def encode_runs(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The distinct runs' ids one after another, and each one's number of ids."""
        if len(self.known) > CACHE:
            self.known, self.several = {"": b""}, set()
        known = self.known
        new = [w for w in runs if w not in known]
        words = {w for w in new if w.isalpha()}
        # letters with ASCII signs behind them are two parts, if the letters are one token's worth of letters in lower case too
        pairs = [(w, m[1], m[2]) for w in new if w not in words and (m := _TAILED.fullmatch(w)) and m[1].isalpha()]
        rest = set(new).difference(words, (p[0] for p in pairs))
        words.update(p[1] for p in pairs if p[1] not in known)
        for i in range(0, len(order := list(words)), 2000):
            part = order[i : i + 2000]
            joined = " ".join(part)
            with_ids = self.lean if latin(joined) and joined == joined.lower() else self.tokenizer
            ids = np.array(with_ids.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u2")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(part):  # each word has one end at least
                raw, cuts = ids.tobytes(), (ends * 2).tolist()
                known.update(zip(part, map(raw.__getitem__, map(slice, [0, *cuts], cuts)), strict=False))
            else:
                for w in part:
                    known[w] = self.plain(w)
                    if self.ends[np.frombuffer(known[w], "<u2")].sum() != 1:
                        self.several.add(w)
        rest.update(p[0] for p in pairs if p[1] in self.several)
        for part in {p[2] for p in pairs if p[2] not in known}.union(rest):
            known[part] = self.plain(part)
        known.update((w, known[letters] + known[tail]) for w, letters, tail in pairs if letters not in self.several)
        found = [known[w] for w in runs]
        return np.frombuffer(b"".join(found), "<u2"), np.array([len(x) // 2 for x in found], np.int64)

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        special = {i: np.frombuffer(self.plain(t), "<u2") for i, t in enumerate(texts) if "<|" in t}  # special tokens are found before anything else
        plain = []
        for i, text in enumerate(texts):
            if i in special:
                text = ""
            elif latin(text):  # lower case is letter by letter there, as the tokenizer's
                text = text.lower()
            plain.append(text.translate(_BLANKS) if len(text) < 64 else text.replace("\n", " ").replace("\t", " ").replace("\r", " "))
        lists = pc.split_pattern(pa.array(plain, pa.large_string()), " ")
        coded = lists.flatten().dictionary_encode()
        at = coded.indices.to_numpy()
        ids, sizes = self.encode_runs(coded.dictionary.to_pylist())
        starts = np.cumsum(sizes) - sizes
        n = sizes[at]
        ends = np.cumsum(n)
        flat = ids[np.repeat(starts[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate(([0], ends))[lists.offsets.to_numpy()]
        return [special[i] if i in special else flat[a:b] for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))]


def projection(dims: int = DIMS) -> np.ndarray:
    """A fixed vector of +-1 components for each 16-bit id, by a multiplicative hash."""
    x = (np.arange(1 << 16, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return np.stack([((x >> np.uint64(7 * d)) & np.uint64(1)).astype(np.float32) * 2 - 1 for d in range(dims)], 1)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert keys of integer points (n, dims), each coordinate below 2 ** bits (the transposed-axes method)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(on, p, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def place(ids: np.ndarray, table: np.ndarray) -> np.ndarray:
    mean = table[ids].mean(0) if len(ids) < 1 << 20 else sum(table[ids[i : i + (1 << 20)]].sum(0) for i in range(0, len(ids), 1 << 20)) / len(ids)
    return np.clip((mean * 1.5 + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)


def _encoding(path: str):
    def run(batches):
        own, table = common.worker_held(("packing", path), lambda: (Encoder(path), projection()))
        docs: list = []
        texts: list[str] = []
        size = 0

        def out():
            ids = [np.append(x, END_ID).astype("<u2") for x in own.encode_all(texts)]
            places = np.array([place(x, table) for x in ids]).reshape(-1, DIMS)
            keys = hilbert(places)
            for i in range(0, len(ids), 500):
                yield pa.RecordBatch.from_arrays([pa.array(docs[i : i + 500], pa.int64()), pa.array(keys[i : i + 500]), pa.array([x.tobytes() for x in ids[i : i + 500]], pa.binary())], ["doc_id", "key", "ids"])

        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = raw.as_py().decode("utf-8", "replace")
                docs.append(doc)
                texts.append(text)
                size += len(text)
                if size >= TOGETHER:
                    yield from out()
                    docs, texts, size = [], [], 0
        if docs:
            yield from out()

    return run


def _pieces(batches):
    """Fills sequences in order; the rest becomes powers of two."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    from pyspark import TaskContext

    first, wait = TaskContext.get().partitionId() << 33, []  # wait: the open sequence's (doc_id, start, ids, doc_tokens)
    filled, sequence = 0, 0

    def cut(parts, size):
        """Rows of the first ``size`` tokens of parts, and what is left."""
        rows, at, parts = [], 0, list(parts)
        while parts and at < size:
            doc, start, ids, total = parts.pop(0)
            take = min(size - at, len(ids))
            rows.append((doc, start, take, zlib.crc32(ids[:take].astype("<u4").tobytes()), total, first + sequence, at))
            if take < len(ids):
                parts.insert(0, (doc, start + take, ids[take:], total))
            at += take
        return rows, parts

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    out: list = []
    for batch in batches:
        for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = np.frombuffer(raw.as_py(), "<u2")
            total, start = len(ids), 0
            while start < total:
                take = min(LIMIT - filled, total - start)
                wait.append((doc, start, ids[start : start + take], total))
                filled, start = filled + take, start + take
                if filled == LIMIT:
                    out += cut(wait, LIMIT)[0]
                    wait, filled, sequence = [], 0, sequence + 1
            if len(out) > 4000:
                yield batch_of(out)
                out = []
    for power in (1 << b for b in range(LIMIT.bit_length() - 1, -1, -1)):
        if filled & power:
            rows, wait = cut(wait, power)
            out += rows
            sequence += 1
    if out:
        yield batch_of(out)


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one row for each piece of a document."""
    common.prepare(docs.sparkSession)
    coded = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_bytes(text_col).alias("text")).mapInArrow(_encoding(path), "doc_id long, key long, ids binary")
    coded = common.materialise(coded, "packing-ids")
    ordered = coded.repartitionByRange("key", "doc_id").sortWithinPartitions("key", "doc_id")
    return ordered.select("doc_id", "ids").mapInArrow(_pieces, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
