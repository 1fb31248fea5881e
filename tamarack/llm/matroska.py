"""Media columns: writing and reading Matroska files held in binary columns.

The reader walks variable-length EBML elements (unknown sizes included), clusters, simple
blocks and block groups, undoes Xiph, fixed-size and EBML lacing, and gives one row per
packet with its track, timestamp and byte range in the file; cue points are read, each
with all its track positions, and checked against cluster positions. Damage ends the
reading of its file alone and is told in a column. The writer stores a payload losslessly as 8-bit mono
PCM samples, 512 to a frame, several frames laced in a block.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame

# Element ids fixed by the format.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TRACK_ENTRY, AUDIO, BLOCK_GROUP, CUE_POINT, CUE_POSITIONS = 0xAE, 0xE1, 0xA0, 0xBB, 0xB7
SIMPLE_BLOCK, BLOCK, TIMESTAMP, SCALE, DURATION = 0xA3, 0xA1, 0xE7, 0x2AD7B1, 0x4489
TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC, RATE, CHANNELS, BIT_DEPTH = 0xD7, 0x73C5, 0x83, 0x86, 0xB5, 0x9F, 0x6264
CUE_TIME, CUE_TRACK, CUE_CLUSTER = 0xB3, 0xF7, 0xF1
DEFAULT_DURATION, BLOCK_DURATION, REFERENCE_BLOCK = 0x23E383, 0x9B, 0xFB
DOC_TYPE, DOC_VERSION, READ_VERSION, MUXER, WRITER = 0x4282, 0x4287, 0x4285, 0x4D80, 0x5741
MASTERS = {EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES, TRACK_ENTRY, AUDIO, BLOCK_GROUP, CUE_POINT, CUE_POSITIONS}
TOP = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1043A770, 0x1941A469, 0x1254C367}  # ends an element of unknown size

SAMPLE_RATE, FRAME, LACED, BLOCKS_PER_CLUSTER = 8000, 512, 8, 8
FRAME_MS = FRAME * 1000 // SAMPLE_RATE
MS = 1_000_000  # nanoseconds


def _id(x: int) -> bytes:
    return x.to_bytes((x.bit_length() + 7) // 8, "big")


def vint(x: int, width: int = 0) -> bytes:
    """A variable-length size; all ones is reserved for unknown sizes."""
    n = width or next(n for n in range(1, 9) if x < (1 << 7 * n) - 1)
    return (x | 1 << 7 * n).to_bytes(n, "big")


def element(kind: int, data: bytes) -> bytes:
    return _id(kind) + vint(len(data)) + data


def uint(kind: int, x: int) -> bytes:
    return element(kind, x.to_bytes(max(1, (x.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], kind: str) -> tuple[int, bytes]:
    """Flag bits and body of a block of frames, by ``none``, ``xiph``, ``fixed`` or ``ebml`` lacing."""
    body, sizes = b"".join(frames), [len(f) for f in frames]
    if kind == "none":
        return 0, body
    head = bytes([len(frames) - 1])
    if kind == "fixed":
        return 0x04, head + body
    if kind == "xiph":
        return 0x02, head + b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1]) + body
    out = vint(sizes[0]) if len(sizes) > 1 else b""
    for a, b in zip(sizes, sizes[1:-1], strict=False):
        n = next(n for n in range(1, 9) if abs(b - a) < (1 << 7 * n - 1) - 1)
        out += vint(b - a + (1 << 7 * n - 1) - 1, n)
    return 0x06, head + out + body


def mux(payload: bytes) -> bytes:
    """A Matroska file whose track 1 holds ``payload`` as 8-bit PCM samples."""
    header = element(EBML, uint(0x4286, 1) + uint(0x42F7, 1) + uint(0x42F2, 4) + uint(0x42F3, 8) + element(DOC_TYPE, b"matroska") + uint(DOC_VERSION, 4) + uint(READ_VERSION, 2))
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    info = element(INFO, uint(SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) * 1000 / SAMPLE_RATE)) + element(MUXER, b"tamarack") + element(WRITER, b"tamarack"))
    audio = element(AUDIO, element(RATE, struct.pack(">d", float(SAMPLE_RATE))) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + uint(DEFAULT_DURATION, FRAME_MS * MS) + element(CODEC, b"A_PCM/INT/LIT") + audio))
    at, clusters, cues = len(info) + len(tracks), [], []
    for c in range(0, len(frames), LACED * BLOCKS_PER_CLUSTER):
        base = c * FRAME_MS
        blocks = []
        for b in range(c, min(len(frames), c + LACED * BLOCKS_PER_CLUSTER), LACED):
            group = frames[b : b + LACED]
            even = len({len(f) for f in group}) == 1
            kind = "none" if len(group) == 1 else "fixed" if even else ("ebml" if b % (2 * LACED) else "xiph")
            flags, body = lace(group, kind)
            offset = struct.pack(">h", b * FRAME_MS - base)
            if even:
                blocks.append(element(SIMPLE_BLOCK, vint(1) + offset + bytes([0x80 | flags]) + body))
            else:
                duration = sum(map(len, group)) * 1000 // SAMPLE_RATE
                blocks.append(element(BLOCK_GROUP, element(BLOCK, vint(1) + offset + bytes([flags]) + body) + uint(BLOCK_DURATION, duration)))
        cluster = element(CLUSTER, uint(TIMESTAMP, base) + b"".join(blocks))
        cues.append(element(CUE_POINT, uint(CUE_TIME, base) + element(CUE_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, at))))
        at += len(cluster)
        clusters.append(cluster)
    return header + element(SEGMENT, info + tracks + b"".join(clusters) + element(CUES, b"".join(cues)))


@dataclass
class Packet:
    track: int
    timestamp: int  # milliseconds
    start: int
    end: int
    keyframe: bool
    duration: int | None = None  # milliseconds, where the file tells


@dataclass
class Media:
    packets: list[Packet] = field(default_factory=list)
    tracks: dict[int, dict[str, object]] = field(default_factory=dict)
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # milliseconds, track, cluster position in the file
    clusters: list[int] = field(default_factory=list)
    scale: int = 1_000_000
    duration: float = 0.0  # milliseconds


def read_vint(data: bytes, at: int, keep: bool = False) -> tuple[int, int, int]:
    """Value, next position and width of a variable-length integer; ``keep`` leaves the length mark in (ids)."""
    first = data[at] if at < len(data) else 0
    n = 9 - first.bit_length()
    if not first or at + n > len(data):
        raise ValueError("broken variable-length integer")
    value = int.from_bytes(data[at : at + n], "big")
    return (value if keep else value & (1 << 7 * n) - 1), at + n, n


def unlace(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """Byte ranges of a block's frames."""
    if kind == 0:
        return [(at, end)]
    n, at = data[at] + 1, at + 1
    if kind == 2:
        if (end - at) % n:
            raise ValueError("fixed lacing does not divide the block")
        sizes = [(end - at) // n] * n
    else:
        sizes = []
        for i in range(n - 1):
            if kind == 1:
                size = 0
                while data[at] == 255:
                    size, at = size + 255, at + 1
                size, at = size + data[at], at + 1
            else:
                value, at, width = read_vint(data, at)
                size = value if not i else sizes[-1] + value - ((1 << 7 * width - 1) - 1)
            sizes.append(size)
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("lacing runs past the block")
    out = []
    for s in sizes:
        out.append((at, at + s))
        at += s
    return out


def demux(data: bytes) -> Media:
    """Packet table, tracks and cues of a whole Matroska file; ``ValueError`` if it is damaged."""
    media, error = read(data)
    if error:
        raise ValueError(error)
    return media


def read(data: bytes) -> tuple[Media, str | None]:
    """Packet table, tracks and cues of a Matroska file up to its first damage, and what that is.

    A cue point may name positions in several tracks, before or after its time; each is a
    cue of its own. Times are in milliseconds, whatever the file's scale. Frames of a lace follow each other by the track's default duration, else by an even
    share of the block's own duration, else they share a timestamp. A simple block says by
    a flag whether it is a key frame, a block of a group by having no reference to others.
    """
    media = Media()
    segment, cluster_time, ticks = 0, 0, 0.0
    points: list[tuple[int, dict[str, object]]] = []

    def block(at: int, end: int, simple: bool, duration: int | None = None, refers: bool = False) -> None:
        track, at, _ = read_vint(data, at)
        when, flags = struct.unpack(">hB", data[at : at + 3])
        frames = unlace(data, at + 3, end, flags >> 1 & 3)
        begin = (cluster_time + when) * media.scale
        step = int(media.tracks.get(track, {}).get("default_duration", 0))
        whole = None if duration is None else duration * media.scale
        step = step or (whole or 0) // len(frames)
        key = bool(flags & 0x80) if simple else not refers
        for i, (s, e) in enumerate(frames):
            own = step if whole is None else min(step, max(0, whole - i * step))
            media.packets.append(Packet(track, (begin + i * step) // MS, s, e, key, own // MS if step else None))

    def walk(at: int, end: int, parent: dict[str, object]) -> None:
        nonlocal segment, cluster_time, ticks
        while at < end:
            begin = at
            kind, at, _ = read_vint(data, at, True)
            size, at, width = read_vint(data, at)
            stop = at + size
            if size == (1 << 7 * width) - 1:  # unknown: to the next top-level element or the end
                stop = end
                if kind == CLUSTER:
                    probe = at
                    while probe < end:
                        k, p, _ = read_vint(data, probe, True)
                        if k in TOP:
                            stop = probe
                            break
                        s, p, _ = read_vint(data, p)
                        probe = p + s
            cut = stop > end  # of a cut-off file: what is there of its masters is read
            if cut and kind not in MASTERS:
                raise ValueError("element runs past its parent")
            stop = min(stop, end)
            own = data[at:stop] if stop - at <= 64 else b""
            if kind == SEGMENT:
                segment = at
            elif kind == CLUSTER:
                media.clusters.append(begin)
            if kind == TRACK_ENTRY:
                entry: dict[str, object] = {}
                walk(at, stop, entry)
                media.tracks[int(entry.get("number", 0))] = entry
            elif kind == BLOCK_GROUP:
                group: dict[str, object] = {}
                walk(at, stop, group)
                if "block" in group:
                    block(*group["block"], False, group.get("block_duration"), "reference" in group)
            elif kind == CUE_POINT:
                point: dict[str, object] = {}
                first = len(points)
                walk(at, stop, point)
                points[first:] = [(base, {**point, **place}) for base, place in points[first:]]
            elif kind == CUE_POSITIONS:
                place: dict[str, object] = {}
                walk(at, stop, place)
                points.append((segment, place))
            elif kind in MASTERS:
                walk(at, stop, parent)
            elif kind == SIMPLE_BLOCK:
                block(at, stop, True)
            elif kind == BLOCK:
                parent["block"] = (at, stop)
            elif kind == TIMESTAMP:
                cluster_time = int.from_bytes(own, "big")
            elif kind == SCALE:
                media.scale = int.from_bytes(own, "big") or MS
            elif kind == DURATION:
                ticks = _float(own)
            elif kind in _NUMBERS:
                parent[_NUMBERS[kind]] = int.from_bytes(own, "big")
            elif kind == RATE:
                parent["rate"] = _float(own)
            elif kind == CODEC:
                parent["codec"] = own.decode()
            if cut:
                raise ValueError("element runs past its parent")
            at = stop

    error = None
    try:
        walk(0, len(data), {})
    except (ValueError, IndexError, struct.error, RecursionError) as e:
        error = str(e) if isinstance(e, ValueError) else f"broken element ({type(e).__name__})"
    media.duration = ticks * media.scale / MS
    media.cues = [(int(p.get("time", 0)) * media.scale // MS, int(p.get("track", 0)), base + int(p.get("cluster", 0))) for base, p in points]
    return media, error


def _float(data: bytes) -> float:
    """An EBML float: four or eight bytes, or none for 0."""
    return struct.unpack(">d" if len(data) == 8 else ">f", data)[0] if data else 0.0


_NUMBERS = {TRACK_NUMBER: "number", TRACK_TYPE: "type", CHANNELS: "channels", BIT_DEPTH: "bits", CUE_TIME: "time", CUE_TRACK: "track", CUE_CLUSTER: "cluster"}
_NUMBERS |= {DEFAULT_DURATION: "default_duration", BLOCK_DURATION: "block_duration", REFERENCE_BLOCK: "reference"}


def payload_of(data: bytes, media: Media, track: int = 1) -> bytes:
    return b"".join(data[p.start : p.end] for p in media.packets if p.track == track)


def padded(text: str | None) -> bytes:
    """A text's UTF-8 bytes, filled with zeros to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\0" * (-len(raw) % 64 or 64 * (not raw))


def store(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media``: each text as a Matroska file in a binary column.

    A null or empty text has the payload of 64 zero bytes; a very long one is one file of
    many clusters. Extra columns are ignored; an empty table gives an empty result; equal
    texts give equal files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                texts = part["text"].to_pylist()
                size = [len((t or "").encode("utf-8", "surrogatepass")) for t in texts]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(size, pa.int64()), pa.array([mux(padded(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


PACKET_SCHEMA = "doc_id long, track long, packet int, timestamp_ms long, start long, end long, keyframe boolean, duration_ms long, error string"


def packets(media: DataFrame) -> DataFrame:
    """The packet table of a media column: one row per packet.

    Null files have no packets. A damaged file has those before its damage and one more row,
    null but for ``doc_id`` and ``error``. Files of any length are read whole; equal files
    give equal rows. Extra columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, data in zip(b["doc_id"].to_pylist(), b["media"], strict=True):
                got, error = read(data.as_py()) if data.is_valid else (Media(), None)
                rows = [(doc, p.track, i, p.timestamp, p.start, p.end, p.keyframe, p.duration, None) for i, p in enumerate(got.packets)]
                rows += [(doc, *[None] * 7, error)] if error else []
                cols = list(zip(*rows, strict=True)) or [()] * 9
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string()]
                names = ["doc_id", "track", "packet", "timestamp_ms", "start", "end", "keyframe", "duration_ms", "error"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return media.select("doc_id", "media").mapInArrow(run, PACKET_SCHEMA)


def digest(data: bytes) -> tuple[int | None, str | None, int | None, int, str, str | None, str | None]:
    """What a stored file holds, from its bytes alone; of a damaged one its own size and sum, and the damage."""
    media, error = read(data)
    known = set(media.clusters)
    if not error and any(c[2] not in known for c in media.cues):
        error = "a cue points past the clusters"
    whole = len(data), hashlib.sha256(data).hexdigest()
    if error:
        return None, None, None, *whole, None, error
    payload = payload_of(data, media)
    last = media.packets[-1] if media.packets else Packet(0, 0, 0, 0, False)
    mean = sum(payload) / max(1, len(payload))
    feature = f"packets={len(media.packets)};clusters={len(media.clusters)};cues={len(media.cues)};last_ms={last.timestamp};last_range={last.start}-{last.end};mean={mean:.6f}"
    return len(payload), hashlib.sha256(payload).hexdigest(), crc32(payload[-64:]), *whole, feature, None


DIGEST_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"


def digests(media: DataFrame) -> DataFrame:
    """Per file of a media column: what its packets hold, read back from the stored bytes.

    A null file has nulls only; one without packets has an empty payload. A damaged file has
    an ``error`` and, beside that, ``media_bytes`` and ``media_sha256`` alone. Files of any
    length are read whole; equal files give equal rows. Extra columns are ignored, whatever
    their names; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(zip(*(digest(d.as_py()) if d.is_valid else (None,) * 7 for d in b["media"]), strict=True)) or [()] * 7
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["n_bytes"], *(pa.array(c, t) for c, t in zip(rows, types, strict=True))], ["doc_id", "n_bytes", *names])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, DIGEST_SCHEMA)
