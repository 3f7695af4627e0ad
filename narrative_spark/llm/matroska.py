"""Matroska media columns: variable-length EBML elements, clusters, lacing and cues as packet tables."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import bounded_arrow, shared_dir, until_exit

# Fixed values of the format (RFC 8794, RFC 9559): element ids.
EBML, DOC_TYPE, VOID = 0x1A45DFA3, 0x4282, 0xEC
SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, DEFAULT_DURATION, AUDIO = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383, 0xE1
SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xB5, 0x9F, 0x6264
CLUSTER_TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = {EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES, TRACK_ENTRY, AUDIO, BLOCK_GROUP, CUE_POINT, CUE_TRACK_POSITIONS}
LACINGS = ("none", "xiph", "fixed", "ebml")

#: How this module lays payloads out: samples a second, samples a frame, frames a block and blocks a cluster.
RATE, FRAME, LACE, BLOCKS = 8000, 256, 8, 16
FRAME_NS = FRAME * 1_000_000_000 // RATE
#: The name that files carry as that of their writer.
APP = b"narrative_spark"


def size_bytes(n: int, width: int = 0) -> bytes:
    """An element's size as a variable-length integer; all ones mean unknown, so that value takes a byte more."""
    need = 1
    while n >= (1 << (7 * need)) - 1:
        need += 1
    need = max(need, width)
    return ((1 << (7 * need)) | n).to_bytes(need, "big")


def element(name: int, body: bytes) -> bytes:
    return name.to_bytes((name.bit_length() + 7) // 8, "big") + size_bytes(len(body)) + body


def uint(name: int, value: int) -> bytes:
    return element(name, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], track: int, relative: int) -> bytes:
    """A SimpleBlock of some frames: fixed-size lacing if all are equal, EBML lacing if not, none for one frame."""
    head = size_bytes(track) + struct.pack(">h", relative)
    if len(frames) == 1:
        return element(SIMPLE_BLOCK, head + b"\x80" + frames[0])
    sizes = [len(f) for f in frames]
    if len(set(sizes)) == 1:
        return element(SIMPLE_BLOCK, head + b"\x84" + bytes([len(frames) - 1]) + b"".join(frames))
    laced = size_bytes(sizes[0])
    for a, b in zip(sizes[:-2], sizes[1:-1]):
        step, width = b - a, 1
        while not -((1 << (7 * width - 1)) - 1) <= step <= (1 << (7 * width - 1)) - 1:
            width += 1
        laced += ((1 << (7 * width)) | (step + (1 << (7 * width - 1)) - 1)).to_bytes(width, "big")
    return element(SIMPLE_BLOCK, head + b"\x86" + bytes([len(frames) - 1]) + laced + b"".join(frames))


_HEAD = element(EBML, element(DOC_TYPE, b"matroska"))
_TRACKS = element(
    TRACKS,
    element(
        TRACK_ENTRY,
        uint(TRACK_NUMBER, 1)
        + uint(TRACK_UID, 1)
        + uint(TRACK_TYPE, 2)
        + element(CODEC_ID, b"A_PCM/INT/LIT")
        + uint(DEFAULT_DURATION, FRAME_NS)
        + element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8)),
    ),
)


def pad(data: bytes) -> bytes:
    """The payload of a text: bytes 0 appended up to a positive multiple of 64."""
    return data + bytes(-len(data) % 64 if data else 64)


def mux(payload: bytes) -> bytes:
    """A Matroska file with one track of 8-bit PCM samples, which are the payload's bytes."""
    scale = 1_000_000
    length = element(DURATION, struct.pack(">d", len(payload) * 1000 / RATE))
    info = element(INFO, uint(TIMESTAMP_SCALE, scale) + length + element(MUXING_APP, APP) + element(WRITING_APP, APP))
    clusters, cues, position = [], [], len(info) + len(_TRACKS)
    step = FRAME * LACE * BLOCKS
    for at in range(0, len(payload), step):
        base = at * 1000 // RATE
        body = uint(CLUSTER_TIMESTAMP, base)
        for b in range(at, min(at + step, len(payload)), FRAME * LACE):
            end = min(b + FRAME * LACE, at + step, len(payload))
            body += lace([payload[x : min(x + FRAME, end)] for x in range(b, end, FRAME)], 1, b * 1000 // RATE - base)
        cues.append(element(CUE_POINT, uint(CUE_TIME, base) + element(CUE_TRACK_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER_POSITION, position))))
        clusters.append(element(CLUSTER, body))
        position += len(clusters[-1])
    return _HEAD + element(SEGMENT, info + _TRACKS + b"".join(clusters) + element(CUES, b"".join(cues)))


@dataclass
class Media:
    doc_type: str = ""
    scale: int = 1_000_000
    duration: float = 0.0
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[tuple] = field(default_factory=list)  # track, timestamp_ns, offset, size, cluster, lacing, keyframe
    clusters: list[int] = field(default_factory=list)  # positions in the segment
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # time, track, cluster position
    damaged: bool = False


class _Damage(ValueError):
    pass


def _vint(data: bytes, at: int, end: int, marker: bool) -> tuple[int, int, bool]:
    """``(value, next, unknown)``; ids keep the length marker."""
    if at >= end or not data[at]:
        raise _Damage("no variable-length integer of at most eight bytes")
    width = 9 - data[at].bit_length()
    if at + width > end:
        raise _Damage("cut in an integer")
    raw = int.from_bytes(data[at : at + width], "big")
    value = raw if marker else raw & ((1 << (7 * width)) - 1)
    return value, at + width, value == (1 << (7 * width)) - 1


def _frames(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """Offsets and sizes of a block's frames."""
    if not kind:
        return [(at, end - at)]
    if at >= end:
        raise _Damage("no frame count")
    n, at = data[at] + 1, at + 1
    if kind == 2:
        if (end - at) % n:
            raise _Damage("frames of one size don't fill the block")
        size = (end - at) // n
        return [(at + k * size, size) for k in range(n)]
    sizes = []
    if kind == 1:
        for _ in range(n - 1):
            size = 0
            while True:
                if at >= end:
                    raise _Damage("cut in a lace")
                size, at = size + data[at], at + 1
                if data[at - 1] != 255:
                    break
            sizes.append(size)
    elif n > 1:
        size, at, _ = _vint(data, at, end, False)
        sizes.append(size)
        for _ in range(n - 2):
            before = at
            raw, at, _ = _vint(data, at, end, False)
            size += raw - ((1 << (7 * (at - before) - 1)) - 1)
            sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise _Damage("frames beyond the block")
    found = []
    for size in sizes:
        found.append((at, size))
        at += size
    return found


#: What a number of a track or of a cue is called.
TRACK_FIELDS = {TRACK_NUMBER: "number", TRACK_TYPE: "type", DEFAULT_DURATION: "frame_ns", CHANNELS: "channels", BIT_DEPTH: "bits"}
CUE_FIELDS = {CUE_TIME: "time", CUE_TRACK: "track", CUE_CLUSTER_POSITION: "position"}
LONG = 1 << 63


class _Parser:
    """Elements of one file, met one after another; open masters are on a stack of its own, so no depth overflows."""

    def __init__(self, data: bytes):
        self.data, self.media = data, Media()
        self.track: dict = {}
        self.cue: dict = {}
        self.segment = self.base = 0

    def number(self, a: int, b: int) -> int:
        """An unsigned integer of at most eight bytes that fits a signed long."""
        if b - a > 8 or (value := int.from_bytes(self.data[a:b], "big")) >= LONG:
            raise _Damage("an integer is too long")
        return value

    def real(self, a: int, b: int) -> float:
        if b - a not in (0, 4, 8):
            raise _Damage("a real number has four or eight bytes")
        return struct.unpack(">f" if b - a == 4 else ">d", self.data[a:b])[0] if b > a else 0.0

    def block(self, a: int, b: int, simple: bool) -> None:
        media = self.media
        n, at, _ = _vint(self.data, a, b, False)
        if at + 3 > b:
            raise _Damage("cut in a block")
        relative, flags = struct.unpack(">hB", self.data[at : at + 3])
        kind = (flags >> 1) & 3
        frames = _frames(self.data, at + 3, b, kind)
        start, step = (self.base + relative) * media.scale, media.tracks.get(n, {}).get("frame_ns", 0)
        if not -LONG <= start <= start + step * len(frames) < LONG:
            raise _Damage("a time is beyond a long")
        for k, (offset, size) in enumerate(frames):
            media.packets.append((n, start + k * step, offset, size, len(media.clusters) - 1, LACINGS[kind], bool(flags & 0x80) if simple else True))

    def opened(self, name: int, start: int, at: int) -> None:
        if name == SEGMENT:
            self.segment = at
        elif name == CLUSTER:
            self.media.clusters.append(start - self.segment)
            self.base = 0
        elif name == TRACK_ENTRY:
            self.track = {}
        elif name == CUE_POINT:
            self.cue = {}

    def closed(self, name: int) -> None:
        if name == TRACK_ENTRY and "number" in self.track:
            self.media.tracks[self.track["number"]] = self.track
        elif name == CUE_TRACK_POSITIONS:
            self.media.cues.append((self.cue.get("time", 0), self.cue.get("track", 0), self.cue.get("position", 0)))

    def leaf(self, name: int, a: int, b: int) -> None:
        if name == DOC_TYPE:
            self.media.doc_type = self.data[a:b].decode("ascii", "replace")
        elif name == TIMESTAMP_SCALE:
            self.media.scale = self.number(a, b)
        elif name == DURATION:
            self.media.duration = self.real(a, b)
        elif name in TRACK_FIELDS:
            self.track[TRACK_FIELDS[name]] = self.number(a, b)
        elif name == CODEC_ID:
            self.track["codec"] = self.data[a:b].decode("ascii", "replace")
        elif name == SAMPLING_FREQUENCY:
            self.track["rate"] = self.real(a, b)
        elif name == CLUSTER_TIMESTAMP:
            self.base = self.number(a, b)
        elif name in (SIMPLE_BLOCK, BLOCK):
            self.block(a, b, name == SIMPLE_BLOCK)
        elif name in CUE_FIELDS:
            self.cue[CUE_FIELDS[name]] = self.number(a, b)

    def run(self) -> None:
        data, at = self.data, 0
        stack = [(0, len(data), False)]  # open masters: name, end, whether the file ends inside
        while True:
            name, end, cut = stack[-1]
            if at >= end:
                if len(stack) == 1:
                    return
                stack.pop()
                self.closed(name)
                if cut:
                    raise _Damage("cut in a master element")
                continue
            start = at
            child, at, _ = _vint(data, at, end, True)
            size, at, unknown = _vint(data, at, end, False)
            if name == CLUSTER and child in (CLUSTER, CUES, TRACKS, INFO):
                stack.pop()  # the end of a cluster of unknown size
                self.closed(name)
                at = start
                continue
            stop, short = (end, False) if unknown else (min(at + size, end), at + size > end)
            if child in MASTERS:
                self.opened(child, start, at)
                stack.append((child, stop, short))
            elif short:
                raise _Damage("cut in an element")
            else:
                self.leaf(child, at, stop)
                at = stop


def parse(data: bytes) -> Media:
    """All tracks, packets and cues. What stands before a damaged place is kept, and ``damaged`` is set."""
    parser = _Parser(data)
    try:
        parser.run()
    except _Damage:
        parser.media.damaged = True
    return parser.media


def feature(media: Media) -> str:
    """Counts and times of a file as one line."""
    seen = {p[5] for p in media.packets}
    used = [k for k in LACINGS if k in seen]
    places = set(media.clusters)
    known = sum(at in places for _, _, at in media.cues)
    last = max((p[1] for p in media.packets), default=0)
    codec = ",".join(str(media.tracks[k].get("codec", "")) for k in sorted(media.tracks))
    return f"codec={codec};packets={len(media.packets)};clusters={len(media.clusters)};cues={known};lacing={'+'.join(used)};last_ns={last};duration_ms={media.duration:g}"


def encode_media(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, media)``: each text as UTF-8, padded, in a file of its own. A null text is empty."""
    bounded_arrow(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(list(map(len, texts)), pa.int64()), pa.array([mux(pad(t)) for t in texts], pa.binary())], names=["doc_id", "n_bytes", "media"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes bigint, media binary")


PACKETS = "track bigint, packet int, timestamp_ns bigint, offset bigint, size bigint, cluster int, lacing string, keyframe boolean"


def packet_table(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per packet of every file: id, track, number, time, byte range in the file, cluster, lacing, key frame.

    Null, empty and foreign files have no packets; a damaged file has those before the damage.
    """
    bounded_arrow(media.sparkSession)
    fields = [x.split() for x in PACKETS.split(", ")]
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, owners = [], []
            for d, data in enumerate(batch.column(1).to_pylist()):
                for k, (track, ns, offset, size, cluster, lacing, key) in enumerate(parse(data or b"").packets):
                    rows.append((track, k, ns, offset, size, cluster, lacing, key))
                    owners.append(d)
            columns = list(zip(*rows)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owners, pa.int64())), *(pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields))], names=["id", *(n for n, _ in fields)]
            )

    kind = media.schema[id_col].dataType.simpleString()
    return media.select(F.col(id_col).alias("id"), media_col).mapInArrow(run, f"id {kind}, {PACKETS}").withColumnRenamed("id", id_col)


DIGEST = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def media_digest(media: DataFrame) -> DataFrame:
    """Per file of :func:`encode_media`: the payload joined from the packets' byte ranges, and its features."""
    bounded_arrow(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column(2).to_pylist():
                found = parse(data)
                payload = b"".join(data[p[2] : p[2] + p[3]] for p in found.packets)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature(found)))
            columns = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["doc_id", *(x.split()[0] for x in DIGEST.split(", "))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {kind}, {DIGEST}")


def media_table(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Store the media column of ``docs`` as Parquet, read it back and digest it: one row per input row.

    Null texts are empty; repeated rows are stored each; extra columns are ignored; an empty table gives no rows. Files
    without a ``path`` of the caller are deleted when Spark ends.
    """
    spark = docs.sparkSession
    own = path or shared_dir(spark, "media")
    made = encode_media(docs)
    made.write.option("compression", "zstd").parquet(own)
    if path is None:
        until_exit(spark, own)
    return media_digest(spark.read.schema(made.schema).parquet(own))
