"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints of 64 bits over 3-word shingles link at 3 or fewer differing bits.  Equal fingerprints are
one node from the start.  Then, in three steps that never emit all pairs of a group:

1. Every fingerprint emits the 65 variants within one bit, half the radius rounded down, and the variants are
   shuffled.  Fingerprints that meet on a variant differ in two bits at most, so a star on the smallest
   of them loses no link; a variant has at most 65 of them.  Their components are taken.
2. A pair at exactly three bits meets when one of three bit fields is left out of the key: either
   each side flips one bit of the rest, or the rest is equal.  Every fingerprint emits these keys; only those
   with fingerprints of two or more components count.  This is a filter, done with minima and maxima; where at most FEW share a
   key, which by chance they do more often the larger the table, their distances decide too.
3. What passes it emits the variants within two bits.  A fingerprint within one bit of a variant is at most
   three bits from each one within two bits of it, so a star on the smallest of the former loses no link
   and adds none; a variant has at most 2 081 of them.

The exact check follows: the distance of each star's ends is within three bits by construction, and is asserted
in the join that makes them.  Other columns than doc_id and text aren't read, whatever their names.  Rows: one for each input row; null text counts as empty; texts without a
word have fingerprint zero and link like others; rows with a null doc_id get a fingerprint but take no part in links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from . import common

SHINGLE, SEED, RADIUS, CHUNK = 3, 42, 3, 65_536
#: Fingerprints of a key that are compared with each other, and fingerprints a task whose wide balls are made.
FEW, SPREAD = 16, 500
#: Bit fields that a key may leave out: (first bit, bits).
FIELDS = ((0, 22), (22, 21), (43, 21))


def shingle_hashes(text: bytes, size: int = SHINGLE) -> np.ndarray:
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - size + 1)
    if size == 3 and n > 1:
        grams = map(b"%b %b %b".__mod__, zip(words, words[1:], words[2:], strict=False))
    else:
        grams = (b" ".join(words[i : i + size]) for i in range(n))
    return np.fromiter((xxh64_intdigest(g, SEED) for g in grams), np.uint64, n)


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """A bit is 1 if set in over half of the shingles' hashes."""
    h = shingle_hashes(text, size)
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), CHUNK):
        part = h[i : i + CHUNK]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int((np.uint64(1) << np.flatnonzero(2 * ones > len(h)).astype(np.uint64)).sum()) if (2 * ones > len(h)).any() else 0


def _fingerprints(batch: pa.RecordBatch) -> pa.RecordBatch:
    fps = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp as a signed long."""
    common.prepare(docs.sparkSession)
    return common.arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_bytes().alias("text")), _fingerprints, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _flips(bits) -> list[int]:
    return [_signed(1 << b) for b in bits]


def _exploded(fp, masks):
    """fp with each of the masks flipped."""
    return F.explode(F.transform(F.array(*[F.lit(m).cast(LongType()) for m in masks]), lambda m: fp.bitwiseXOR(m)))


def spread(rows: DataFrame, each: int) -> DataFrame:
    """Rows by fingerprint over as many tasks as have ``each`` of them: small tables whose rows become many."""
    return rows.repartition(max(1, -(-rows.count() // each)), "fp")


def links(nodes: DataFrame, components=common.components) -> DataFrame:
    """Star links (a, b) between fingerprints whose components are those of all pairs within three bits.

    nodes: distinct ``fp``; components: what finds (node, component) of links.
    """
    fp = F.col("fp")
    nodes = spread(nodes, 32 * SPREAD)
    # 1: balls of one bit
    ball = [0, *_flips(range(64))]
    met = nodes.select("fp", _exploded(fp, ball).alias("v")).groupBy("v").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    near = common.materialise(met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b").distinct(), "simhash-near")
    part = spread(nodes.join(components(near, "simhash-part"), nodes.fp == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("part")), 32 * SPREAD)
    part = common.materialise(part, "simhash-parts")
    # 2: keys that leave a field out, and meet between components
    keys = None
    for i, (first, n) in enumerate(FIELDS):
        hole = ((1 << n) - 1) << first
        rest = [b for b in range(64) if not first <= b < first + n]
        masked = fp.bitwiseAND(F.lit(_signed(~hole & ((1 << 64) - 1))))
        # the field's own bits hold its number; n >= 2
        key = F.lit(_signed(i << first)) if i else F.lit(0)
        one = part.select("fp", "part", _exploded(masked.bitwiseOR(key.cast(LongType())), [0, *_flips(rest)]).alias("key"), F.lit(i).alias("field"))
        keys = one if keys is None else keys.unionAll(one)
    mixed = keys.groupBy("field", "key").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("field", "key", "n")
    mixed = common.materialise(mixed, "simhash-mixed")
    hits = keys.join(mixed, ["field", "key"])
    # a key that few share, as by chance in a large table, is decided on its pairs; of the others all go on
    few = hits.where(F.col("n") <= FEW).groupBy("field", "key").agg(F.collect_list(F.struct("fp", "part")).alias("xs"))
    near_one = f"filter(xs, x -> exists(xs, y -> x.part <> y.part AND bit_count(x.fp ^ y.fp) <= {RADIUS}))"
    verified = few.select(F.explode(F.expr(near_one)).alias("x")).select("x.fp")
    again = common.materialise(verified.unionAll(hits.where(F.col("n") > FEW).select("fp")).distinct(), "simhash-again")
    # a small file would be one task; each fingerprint becomes 2 146 rows
    again = spread(again, SPREAD)
    # 3: balls of two bits for what is left
    two = [_signed((1 << i) | (1 << j)) for i in range(64) for j in range(i)]
    wide = again.select("fp", _exploded(fp, ball).alias("v"), F.lit(1).alias("one")).unionAll(again.select("fp", _exploded(fp, two).alias("v"), F.lit(0).alias("one")))
    stars = wide.groupBy("v").agg(F.min(F.when(F.col("one") == 1, fp)).alias("a"), F.count("*").alias("n"), F.collect_set("fp").alias("fps")).where("a is not null and n > 1")
    far = stars.select("a", F.explode("fps").alias("b")).where("a <> b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS).distinct()
    return near.unionAll(far)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id): component_id is the smallest doc_id reachable over links."""
    own = common.materialise(fingerprints(docs), "simhash-docs")
    nodes = common.materialise(own.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    parts = common.components(links(nodes.select("fp")), "simhash-components")
    joined = nodes.join(parts, nodes.fp == parts.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("part"))
    least = joined.groupBy("part").agg(F.min("least").alias("component_id"))
    # only fingerprints that don't stand for themselves alone need a join
    ids = joined.join(least, "part").select("fp", "component_id")
    out = common.join_hot(own, ids, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
