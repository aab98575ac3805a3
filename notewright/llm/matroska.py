"""Matroska media columns: a muxer, an EBML parser, and packet tables.

``mux`` stores a payload losslessly as 8-bit PCM samples: frames of FRAME samples, laced BLOCK frames to a
block (fixed-size lacing where the frames are equal, else EBML lacing; Xiph and no lacing are read too),
CLUSTER blocks to a cluster, and a cue for each cluster.  ``parse`` walks variable-length EBML elements,
of unknown size too, and gives a row for each packet: track, time in nanoseconds, byte range, keyframe, lacing.

Any nesting is walked; a number that doesn't fit its column is damage.  Columns besides those named aren't read.  A null text is empty.  What isn't Matroska, or breaks off, gives the packets before the break and ``damaged``; a null
column gives no packets.  Rows of the packet table: one for each packet of each input row; of features: one for each input row.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

RATE, FRAME, BLOCK, CLUSTER, UNIT = 8000, 512, 8, 7, 64
# Element ids of the Matroska specification (fixed values).
EBML, SEGMENT, INFO, TRACKS, CLUSTERS, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
DEFAULT_DURATION = 0x23E383
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, GROUP_BLOCK, BLOCK_DURATION, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = {EBML, SEGMENT, INFO, TRACKS, CLUSTERS, CUES, TRACK_ENTRY, AUDIO, BLOCK_GROUP, CUE_POINT, CUE_POSITIONS}
TOP = {INFO, TRACKS, CLUSTERS, CUES, 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469}
LACING = ("none", "xiph", "fixed", "ebml")


def vint(n: int, width: int = 0) -> bytes:
    """A variable-length size: 7 bits a byte, all ones kept for 'unknown'."""
    while not width or n >= (1 << 7 * width) - 1:
        width += 1
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(ident: int, data: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(data)) + data


def _uint(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _block(frames: list[bytes], time: int) -> bytes:
    head = vint(1) + struct.pack(">h", time)
    if len(frames) == 1:
        return element(SIMPLE_BLOCK, head + b"\x80" + frames[0])
    if len(set(map(len, frames))) == 1:
        return element(SIMPLE_BLOCK, head + b"\x84" + bytes([len(frames) - 1]) + b"".join(frames))
    sizes = [len(f) for f in frames]
    laced = vint(sizes[0])
    for a, b in zip(sizes, sizes[1:-1], strict=False):
        width = 1
        while not -(1 << 7 * width - 1) < b - a < (1 << 7 * width - 1):
            width += 1
        laced += vint(b - a + (1 << 7 * width - 1) - 1, width)
    return element(SIMPLE_BLOCK, head + b"\x86" + bytes([len(frames) - 1]) + laced + b"".join(frames))


def mux(payload: bytes, rate: int = RATE) -> bytes:
    """The payload as a Matroska file of one 8-bit PCM track; equal payloads give equal bytes."""
    tick = 1_000_000_000 // rate  # a timestamp counts samples
    header = element(EBML, _uint(EBML_VERSION, 1) + _uint(EBML_READ_VERSION, 1) + _uint(EBML_MAX_ID, 4) + _uint(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + _uint(DOC_VERSION, 4) + _uint(DOC_READ_VERSION, 2))
    info = element(INFO, _uint(TIMESTAMP_SCALE, tick) + element(DURATION, struct.pack(">d", len(payload))) + element(MUXING_APP, b"notewright") + element(WRITING_APP, b"notewright"))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", rate)) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + _uint(DEFAULT_DURATION, FRAME * tick) + audio))
    # times within a cluster are signed 16-bit numbers: FRAME * BLOCK * CLUSTER stays below 32 768
    per_block, per_cluster = FRAME * BLOCK, FRAME * BLOCK * CLUSTER
    parts, cues, at = [info, tracks], [], len(info) + len(tracks)
    for c in range(0, len(payload), per_cluster):
        end = min(c + per_cluster, len(payload))
        blocks = [_block([payload[f : min(f + FRAME, end)] for f in range(b, min(b + per_block, end), FRAME)], b - c) for b in range(c, end, per_block)]
        cluster = element(CLUSTERS, _uint(TIMESTAMP, c) + b"".join(blocks))
        cues.append(element(CUE_POINT, _uint(CUE_TIME, c) + element(CUE_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at))))
        parts.append(cluster)
        at += len(cluster)
    parts.append(element(CUES, b"".join(cues)))
    return header + element(SEGMENT, b"".join(parts))


class Packet(NamedTuple):
    track: int
    time_ns: int
    offset: int
    size: int
    keyframe: bool
    lacing: str
    cluster: int


class Media(NamedTuple):
    packets: list
    tracks: dict
    cues: list
    clusters: int
    duration_ns: float
    damaged: bool


def read_id(data, at: int) -> tuple[int, int]:
    first = data[at]
    width = 9 - first.bit_length()
    if not first or width > 4 or at + width > len(data):
        raise ValueError("bad element id")
    return int.from_bytes(data[at : at + width], "big"), at + width


def read_vint(data, at: int) -> tuple[int | None, int, int]:
    """(value, or None if all its bits are ones; the place after it; its width)."""
    first = data[at]
    width = 9 - first.bit_length()
    if not first or at + width > len(data):
        raise ValueError("bad size")
    n = int.from_bytes(data[at : at + width], "big") & ((1 << 7 * width) - 1)
    return (None if n == (1 << 7 * width) - 1 else n), at + width, width


def _frames(data, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """Byte ranges of a block's frames."""
    if not lacing:
        return [(at, end - at)]
    count = data[at] + 1
    at += 1
    if lacing == 2:
        each, rest = divmod(end - at, count)
        if rest:
            raise ValueError("frames of a fixed lacing differ")
        return [(at + i * each, each) for i in range(count)]
    sizes: list[int] = []
    for i in range(count - 1):
        if lacing == 1:
            n = 0
            while data[at] == 255:
                n, at = n + 255, at + 1
            n, at = n + data[at], at + 1
        else:
            n, at, width = read_vint(data, at)
            if n is None:
                raise ValueError("bad lace size")
            if i:
                n += sizes[-1] - (1 << 7 * width - 1) + 1
        sizes.append(n)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laces exceed their block")
    out = []
    for n in sizes:
        out.append((at, n))
        at += n
    return out


class _Master:
    """An open master element: its id, its end, whether its size is known, whether it goes beyond its parent, what was read in it."""

    def __init__(self, ident, end: int, known: bool = True, broken: bool = False):
        self.ident, self.end, self.known, self.broken, self.held = ident, end, known, broken, {}


def _fits(n: int, bits: int = 63) -> int:
    if not -(1 << bits) <= n < 1 << bits:
        raise ValueError("a number is out of range")
    return n


class _Parser:
    """Walks elements with a stack of its own, so that no nesting is too deep; numbers out of range are damage."""

    def __init__(self, data: bytes):
        self.data, self.packets, self.tracks, self.cues = data, [], {}, []
        self.scale, self.duration, self.clusters, self.time = 1_000_000, 0.0, 0, 0

    def number(self, a: int, b: int) -> int:
        if b - a > 8:
            raise ValueError("an integer of more than 8 bytes")
        return _fits(int.from_bytes(self.data[a:b], "big"))

    def real(self, a: int, b: int) -> float:
        return struct.unpack({4: ">f", 8: ">d"}[b - a], self.data[a:b])[0] if b - a in (4, 8) else 0.0

    def block(self, a: int, b: int, simple: bool, group: dict) -> None:
        track, at, _ = read_vint(self.data, a)
        if track is None or at + 3 > b:
            raise ValueError("bad block header")
        offset, flags = struct.unpack(">hB", self.data[at : at + 3])
        lacing = flags >> 1 & 3
        ranges = _frames(self.data, at + 3, b, lacing)
        start = _fits((self.time + offset) * self.scale)
        step = self.tracks.get(track, {}).get("frame_ns", 0)
        if group.get(BLOCK_DURATION) and not step:
            step = group[BLOCK_DURATION] * self.scale // len(ranges)
        _fits(start + len(ranges) * step)
        _fits(track, 31)
        key = bool(flags & 0x80) if simple else REFERENCE not in group
        self.packets.extend(Packet(track, start + i * step, x, n, key, LACING[lacing], self.clusters - 1) for i, (x, n) in enumerate(ranges))

    def close(self, master: _Master, held: dict) -> None:
        """What a finished master element says, to its parent or to the file."""
        own = master.held
        if master.broken:
            raise ValueError("an element exceeds its parent")
        if master.ident == TRACK_ENTRY:
            self.tracks[own.get(TRACK_NUMBER, 0)] = {"codec": own.get(CODEC_ID, ""), "type": own.get(TRACK_TYPE, 0), "frame_ns": own.get(DEFAULT_DURATION, 0), "rate": own.get(SAMPLING_FREQUENCY, 0.0)}
        elif master.ident == AUDIO:
            held.update(own)
        elif master.ident == CUE_POSITIONS:
            held[CUE_POSITIONS] = (own.get(CUE_TRACK, 0), own.get(CUE_CLUSTER, 0))
        elif master.ident == CUE_POINT and CUE_POSITIONS in own:
            self.cues.append((_fits(own.get(CUE_TIME, 0) * self.scale), *own[CUE_POSITIONS]))
        elif master.ident == BLOCK_GROUP and GROUP_BLOCK in own:
            self.block(*own[GROUP_BLOCK], False, own)

    def leaf(self, ident: int, at: int, stop: int, held: dict) -> None:
        if ident == SIMPLE_BLOCK:
            self.block(at, stop, True, held)
        elif ident == GROUP_BLOCK:
            held[ident] = (at, stop)
        elif ident == TIMESTAMP:
            self.time = self.number(at, stop)
        elif ident == TIMESTAMP_SCALE:
            self.scale = self.number(at, stop)
        elif ident == DURATION:
            self.duration = self.real(at, stop)
        elif ident == SAMPLING_FREQUENCY:
            held[ident] = self.real(at, stop)
        elif ident == CODEC_ID:
            held[ident] = self.data[at:stop].decode("ascii", "replace")
        elif ident in (TRACK_NUMBER, TRACK_TYPE, DEFAULT_DURATION, CUE_TIME, CUE_TRACK, CUE_CLUSTER, BLOCK_DURATION):
            held[ident] = self.number(at, stop)
        elif ident == REFERENCE:
            held[ident] = True

    def walk(self) -> None:
        at, stack = 0, [_Master(None, len(self.data))]
        while stack:
            top = stack[-1]
            begin, ends = at, at >= top.end
            if not ends:
                ident, at = read_id(self.data, at)
                # an element of unknown size ends before one that it can't hold
                ends = top.ident == CLUSTERS and ident in TOP or top.ident not in (None, SEGMENT) and ident in (SEGMENT, EBML)
            if ends:
                stack.pop()
                self.close(top, stack[-1].held if stack else {})
                at = top.end if top.known else begin
                continue
            size, at, _ = read_vint(self.data, at)
            stop = top.end if size is None else at + size
            if ident in MASTERS:
                self.clusters += ident == CLUSTERS
                stack.append(_Master(ident, min(stop, top.end), size is not None, stop > top.end))
                continue
            if stop > top.end:
                raise ValueError("an element exceeds its parent")
            self.leaf(ident, at, stop, top.held)
            at = stop


def parse(data: bytes) -> Media:
    """All packets, tracks and cues of a file; of a damaged one those before the damage."""
    parser, damaged = _Parser(data), False
    try:
        if read_id(data, 0)[0] != EBML:
            raise ValueError("no EBML header")
        parser.walk()
    except (ValueError, IndexError, struct.error):
        damaged = True
    return Media(parser.packets, parser.tracks, parser.cues, parser.clusters, parser.duration * parser.scale, damaged)


def read_payload(data: bytes, media: Media | None = None) -> bytes:
    """The packets' bytes, by their ranges, in time order."""
    media = media or parse(data)
    if media.damaged:
        raise ValueError("damaged Matroska file")
    return b"".join(data[p.offset : p.offset + p.size] for p in sorted(media.packets, key=lambda p: p.time_ns))


def cues_point_to_clusters(data: bytes, media: Media) -> bool:
    start = None
    ident, at = read_id(data, 0)
    size, at, _ = read_vint(data, at)
    ident, at = read_id(data, at + size)
    _, start, _ = read_vint(data, at)
    return all(read_id(data, start + place)[0] == CLUSTERS for _, _, place in media.cues)


def padded(text: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return text + b"\0" * (-len(text) % UNIT or (UNIT if not text else 0))


def _features(batch: pa.RecordBatch):
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for start in range(0, batch.num_rows, 200):
        rows = []
        part = batch.slice(start, 200)
        for doc, x in zip(part.column(0).to_pylist(), part.column(1), strict=True):
            text = x.as_py()
            stored = mux(padded(text))
            media = parse(stored)
            back = read_payload(stored, media)
            lacings = ",".join(f"{k}:{n}" for k in LACING if (n := sum(p.lacing == k for p in media.packets)))
            loud = int(np.frombuffer(back, np.uint8).sum(dtype=np.int64)) % 65536
            feature = f"tracks={len(media.tracks)};clusters={media.clusters};cues={len(media.cues)};packets={len(media.packets)};lacing={lacings};duration_us={int(media.duration_ns) // 1000};level={loud}"
            rows.append((doc, len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), feature))
        yield pa.RecordBatch.from_arrays([pa.array(c) if i else pa.array(c, pa.int64()) for i, c in enumerate(zip(*rows, strict=True))], names)


def media_features(docs: DataFrame) -> DataFrame:
    """Each text stored as Matroska, read back, and described."""
    common.prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_bytes().alias("text"))
    return common.arrow_map(rows, _features, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def _packet_rows(batch: pa.RecordBatch):
    names = ["media_id", "packet", "track", "time_ns", "byte_offset", "byte_size", "keyframe", "lacing", "cluster", "damaged"]
    types = [batch.column(0).type, pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int32(), pa.bool_()]
    for ident, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        data = x.as_py()
        if data is None:
            continue
        media = parse(data)
        for start in range(0, len(media.packets), 10_000):
            rows = [(ident, start + i, p.track, p.time_ns, p.offset, p.size, p.keyframe, p.lacing, p.cluster, media.damaged) for i, p in enumerate(media.packets[start : start + 10_000])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def packets(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """The packet table of a column of Matroska files."""
    common.prepare(media.sparkSession)
    return common.arrow_map(media.select(F.col(id_col).cast("long").alias("media_id"), F.col(media_col).cast("binary").alias("media")), _packet_rows, "media_id long, packet int, track int, time_ns long, byte_offset long, byte_size long, keyframe boolean, lacing string, cluster int, damaged boolean")
