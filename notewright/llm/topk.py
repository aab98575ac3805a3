"""Exact top-k search by a three-phase uniform threshold.

A vector's score is an integer inner product, the sum of the partial products of PARTS runs of its components; a shard of rows
has PARTS lists, one a run.  Phase 1 gathers from each shard the k best of one of its lists (the lists take turns) with their whole
scores; the k-th best of what is gathered is a score that k candidates reach, a safe cutoff tau, which is broadcast.  Phase 2
collects from all lists of all shards the entries whose partial product reaches tau / PARTS: a score of tau or more has such a part.
Phase 3 resolves the other parts of these exactly, and keeps the k best that reach tau.

Shards stay in place, in the narrowest integers that hold them; queries go to them in waves of at most WAVE bytes, which bounds
what is broadcast whatever the table's size.  A task keeps at most k rows a query of a wave, so that
equal vectors or ties, however many, don't add rows.

Vectors that are null, or hold a null or a non-finite component, take no part; vectors are compared only
with those of equal length.  An empty table gives an empty result.  A row is told from others by its place, so
repeated vec_ids are rows of their own, as queries too; a query leaves out rows of its own vec_id.  Null ids take no part.
Other columns than the id and the vector aren't read, whatever their names.  A score beyond a long is an error.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

PARTS, SHARD, BLOCK, WAVE, AT_ONCE = 4, 8192, 2048, 32 << 20, 128
LOWEST = -(1 << 63)
_PACKED = "dim int, kind string, ids binary, mat binary"


def _shards(size: int):
    """Batches of (vec_id, vector) to rows of at most ``size`` vectors of one length, as integers."""

    def out(dim, ids, vectors):
        x = np.floor(np.asarray(vectors, np.float64).reshape(len(ids), dim) * 64)
        most = np.abs(x).max(initial=0)
        if most >= 2.0**62:
            raise OverflowError("a component's 64-fold is beyond a long")
        kind = next(k for k in ("<i1", "<i2", "<i4", "<i8") if most < 2.0 ** (8 * int(k[2]) - 1))
        return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([kind]), pa.array([np.asarray(ids, "<i8").tobytes()], pa.binary()), pa.array([x.astype(kind).tobytes()], pa.binary())], ["dim", "kind", "ids", "mat"])

    def run(batches):
        held: dict[int, tuple[list, list]] = {}
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, vectors = held.setdefault(len(v), ([], []))
                ids.append(i)
                vectors.append(v)
                if len(ids) >= size:
                    yield out(len(v), *held.pop(len(v)))
        for dim, (ids, vectors) in held.items():
            yield out(dim, ids, vectors)

    return run


def _unpack(dim: int, kind: str, ids: bytes, mat: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, "<i8")
    return ids, np.frombuffer(mat, kind).reshape(len(ids), dim)


def exact(q: np.ndarray, x: np.ndarray):
    """Both in a type whose products and sums are exact: doubles below 2 ** 53, else Python's integers."""
    most = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(x.astype(np.float64)).max(initial=0)) * max(1, q.shape[1])
    kind = np.float64 if most < 2.0**53 else object
    return q.astype(kind), x.astype(kind)


def _parts(dim: int) -> list[slice]:
    cuts = np.linspace(0, dim, PARTS + 1).astype(int)
    return [slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]


def _shard_rows(batches):
    for batch in batches:
        for dim, kind, ids, mat in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield dim, *_unpack(dim, kind, ids, mat)


def _gathering(queries, k: int):
    """Phase 1: (uid, scores): for each query the k best whole scores of what the lists' best entries have."""

    def run(batches):
        blocks = pickle.loads(queries.value)
        best = [np.full((len(q_ids), k), LOWEST, object if q.dtype.itemsize == 8 else np.int64) for _, q_ids, _, q in blocks]
        for turn, (dim, ids, rows) in enumerate(_shard_rows(batches)):
            part = _parts(dim)[turn % PARTS]
            for b, (_, q_ids, _, q) in enumerate(blocks):
                if q.shape[1] != dim:
                    continue
                every, x = exact(q, rows)
                for a in range(0, len(q), AT_ONCE):
                    own = every[a : a + AT_ONCE]
                    listed = (own[:, part] @ x[:, part].T).astype(np.float64)  # any k entries are safe, so rounding is too
                    listed[q_ids[a : a + AT_ONCE, None] == ids[None, :]] = -np.inf
                    n = min(k, len(ids))
                    near = np.argpartition(listed, len(ids) - n, axis=1)[:, len(ids) - n :]
                    whole = np.stack([x[near[r]] @ own[r] for r in range(len(own))])
                    whole = np.where(np.take_along_axis(listed, near, 1) == -np.inf, LOWEST, whole.astype(best[b].dtype))
                    both = np.concatenate([best[b][a : a + AT_ONCE], whole], 1)
                    best[b][a : a + AT_ONCE] = np.sort(both, 1)[:, -k:]
        for (uids, _, _, _), scores in zip(blocks, best, strict=True):
            for i in range(0, len(uids), 1000):
                lists = [[int(s) for s in row if s != LOWEST] for row in scores[i : i + 1000].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(uids[i : i + 1000]), pa.array(lists, pa.list_(pa.int64()))], ["uid", "scores"])

    return run


def _kept(uid: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int):
    """The k best of each uid, ties to the smaller id."""
    order = np.lexsort((ids, -scores, uid))  # no score is the lowest long
    uid = uid[order]
    starts = np.flatnonzero(np.r_[True, uid[1:] != uid[:-1]]) if len(uid) else np.zeros(0, int)
    place = np.arange(len(uid)) - np.repeat(starts, np.diff(np.r_[starts, len(uid)]))
    order = order[place < k]
    return order


def _resolving(queries, k: int):
    """Phases 2 and 3: rows (uid, query_id, vec_id, score), at most k a query."""

    def run(batches):
        blocks = pickle.loads(queries.value)
        found: list[np.ndarray] = []
        held, most = 0, 2_000_000

        def squeeze():
            whole = np.concatenate(found, 1)
            return whole[:, _kept(whole[0], whole[2], whole[3], k)]

        for dim, ids, rows in _shard_rows(batches):
            for uids, q_ids, taus, q in blocks:
                if q.shape[1] != dim:
                    continue
                every, x = exact(q, rows)
                for a in range(0, len(q), AT_ONCE):
                    own = every[a : a + AT_ONCE]
                    tau = taus[a : a + AT_ONCE]
                    share = np.where(tau == LOWEST, LOWEST, tau // PARTS + (tau % PARTS != 0))  # rounded up
                    lists = [own[:, p] @ x[:, p].T for p in _parts(dim)]
                    near = np.zeros(lists[0].shape, bool)
                    for p in lists:
                        near |= p >= share[:, None]
                    r, c = np.nonzero(near)
                    score = sum(p[r, c] for p in lists).astype(np.int64)
                    keep = (score >= tau[r]) & (ids[c] != q_ids[a + r])
                    r, c = r[keep], c[keep]
                    if len(r):
                        found.append(np.stack([uids[a + r], q_ids[a + r], ids[c], score[keep]]))
                        held += len(r)
                        if held > most:
                            found = [squeeze()]
                            held = found[0].shape[1]
                            most = max(most, 2 * held)
        if found:
            whole = squeeze()
            for i in range(0, whole.shape[1], 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(whole[j, i : i + 10_000]) for j in range(4)], ["uid", "query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", wave: int = WAVE) -> DataFrame:
    """Each query's k highest scores: (query_id, rank, vec_id, score).  Queries: rows whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    common.prepare(spark)
    x = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("i"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("i").isNotNull() & x.isNotNull() & F.coalesce(F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))), F.lit(False)))
    shards = common.materialise(rows.mapInArrow(_shards(SHARD), _PACKED), "topk-rows")
    blocks = rows.where(F.col("i") % every == 0).mapInArrow(_shards(BLOCK), _PACKED).withColumn("block", F.monotonically_increasing_id())
    blocks = common.materialise(blocks, "topk-queries")
    waves: list[list[int]] = []
    size = wave
    for block, n in blocks.select("block", F.length("ids") * 3 + F.length("mat")).collect():  # a row for each BLOCK queries
        if size + n > wave:
            waves.append([])
            size = 0
        waves[-1].append(block)
        size += n
    found = [_wave(spark, shards, blocks.where(F.col("block").isin(w)), k) for w in waves]
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out


def _wave(spark, shards: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    own = []
    for number, r in enumerate(blocks.collect()):  # at most WAVE bytes
        ids, q = _unpack(r.dim, r.kind, bytes(r.ids), bytes(r.mat))
        uids = (np.int64(number) << np.int64(32)) + np.arange(len(ids), dtype=np.int64)
        own.append([uids, ids, np.full(len(ids), LOWEST), q])
    sent = spark.sparkContext.broadcast(pickle.dumps(own))
    gathered = shards.mapInArrow(_gathering(sent, k), "uid long, scores array<long>")
    kth = F.try_element_at(F.sort_array(F.flatten(F.collect_list("scores")), asc=False), F.lit(k))
    taus = dict(gathered.groupBy("uid").agg(kth.alias("tau")).where("tau is not null").collect())  # a number for each query of the wave
    for block in own:
        block[2] = np.array([taus.get(u, LOWEST) for u in block[0].tolist()], np.int64)
    cut = spark.sparkContext.broadcast(pickle.dumps(own))
    rows = shards.mapInArrow(_resolving(cut, k), "uid long, query_id long, vec_id long, score long")
    order = Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id")
    best = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    best = common.materialise(best, "topk-best")
    sent.unpersist()
    cut.unpersist()
    return best
