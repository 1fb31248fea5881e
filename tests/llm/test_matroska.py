import hashlib
import random
import struct
import zlib

import pytest

from tamarack.llm import matroska as M
from tamarack.llm.queries import op8_matroska

from .helpers import documents, rows, table


def expect(text):
    raw = (text or "").encode()
    pad = raw + b"\0" * (64 if not raw else -len(raw) % 64)
    return len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:])


def test_whole_table(spark, sf_dir):
    d = documents(sf_dir)
    want = {i: expect(t) for i, t in zip(d.doc_id, d.text)}
    got = rows(op8_matroska(spark, sf_dir))
    assert {r.doc_id: (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got.itertuples()} == want


def test_edges(spark):
    texts = [None, "", "same", "same", "é" * 32, "x" * 3_000_000]
    df = table(spark, texts)
    got = rows(M.digests(M.store(df)))
    assert [(r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got.itertuples()] == [expect(t) for t in texts]
    assert got.iloc[2, 1:].equals(got.iloc[3, 1:]) and got.iloc[0, 1:].equals(got.iloc[1, 1:])
    table_ = rows(M.packets(M.store(df)), ["doc_id", "packet"])
    big = table_[table_.doc_id == 5]
    assert (big.end - big.start).sum() == 3_000_000 and list(big.timestamp_ms) == [64 * i for i in range(len(big))]
    assert M.digests(M.store(df.where("doc_id < 0"))).count() == 0


@pytest.mark.parametrize("kind", ["xiph", "ebml", "fixed", "none"])
def test_lacing_round_trip(kind):
    rng = random.Random(kind)
    for _ in range(50):
        n = 1 if kind == "none" else rng.randrange(1, 20)
        size = rng.randrange(0, 700)
        frames = [bytes(size if kind == "fixed" else rng.randrange(0, 70_000 if kind == "ebml" else 800)) for _ in range(n)]
        flags, body = M.lace(frames, kind)
        got = M.unlace(body, 0, len(body), flags >> 1 & 3)
        assert [e - s for s, e in got] == [len(f) for f in frames] and got[-1][1] == len(body)


def test_unknown_sizes_and_void():
    block = M.element(M.SIMPLE_BLOCK, M.vint(1) + struct.pack(">hB", 5, 0x80) + b"abc")
    cluster = M._id(M.CLUSTER) + b"\xff" + M.uint(M.TIMESTAMP, 100) + M.element(0xEC, b"\0" * 9) + block
    data = M.element(M.EBML, b"") + M._id(M.SEGMENT) + b"\x01" + b"\xff" * 7 + cluster + cluster
    media = M.demux(data)
    assert [(p.timestamp, data[p.start : p.end]) for p in media.packets] == [(105, b"abc")] * 2 and len(media.clusters) == 2


def test_cues_and_damage():
    data = M.mux(bytes(range(256)) * 1000)
    media = M.demux(data)
    assert [c[2] for c in media.cues] == media.clusters and len(media.clusters) > 1
    assert media.tracks[1]["codec"] == "A_PCM/INT/LIT" and media.tracks[1]["bits"] == 8
    with pytest.raises(ValueError):
        M.demux(data[:-10])
    for x in (0, 126, 127, 128, 16382, 16383, 2**21, 2**40):
        assert M.read_vint(M.vint(x), 0)[0] == x


def track(*extra):
    return M.element(M.TRACKS, M.element(M.TRACK_ENTRY, M.uint(M.TRACK_NUMBER, 1) + M.uint(M.TRACK_TYPE, 1) + b"".join(extra)))


def test_durations_and_key_frames():
    flags, body = M.lace([b"ab", b"cde", b"f"], "ebml")
    head = M.vint(1) + struct.pack(">hB", 10, flags)
    group = lambda *more: M.element(M.BLOCK_GROUP, b"".join([M.element(M.BLOCK, head + body), *more]))
    cluster = M.element(M.CLUSTER, M.uint(M.TIMESTAMP, 100) + group(M.uint(M.BLOCK_DURATION, 60)) + group(M.element(M.REFERENCE_BLOCK, b"\xf6")) + M.element(M.SIMPLE_BLOCK, M.vint(1) + struct.pack(">hB", 0, 0) + b"x"))
    seen = lambda data: [(p.timestamp, p.keyframe, p.duration) for p in M.demux(data).packets]
    # by the track's default: 40 ms a frame, the last of a known block is shorter; not a sample rate's business
    audio = M.element(M.AUDIO, M.element(M.RATE, struct.pack(">d", 8000.0)))
    data = M.element(M.SEGMENT, track(M.uint(M.DEFAULT_DURATION, 40_000_000), M.element(M.CODEC, b"A_PCM/INT/LIT"), audio) + cluster)
    assert seen(data) == [(110, True, 40), (150, True, 20), (190, True, 0), (110, False, 40), (150, False, 40), (190, False, 40), (100, False, 40)]
    # without one: the block's own duration, or no telling
    data = M.element(M.SEGMENT, track() + cluster)
    assert seen(data) == [(110, True, 20), (130, True, 20), (150, True, 20), (110, False, None), (110, False, None), (110, False, None), (100, False, None)]
    # a scale of 2 ms
    data = M.element(M.SEGMENT, M.element(M.INFO, M.uint(M.SCALE, 2_000_000)) + track() + cluster)
    assert [p[0] for p in seen(data)][:3] == [220, 260, 300]


def naive_feature(data):
    """Packets by a second, plain walk: sizes by hand, laces by their three rules."""
    def num(at, keep):
        n = 1
        while not data[at] & 0x80 >> n - 1:
            n += 1
        v = int.from_bytes(data[at : at + n], "big")
        return (v if keep else v - (1 << 7 * n)), at + n, n

    clusters, cues, ranges, time, times = 0, 0, [], 0, []
    todo = [(0, len(data))]
    while todo:
        at, end = todo.pop()
        if at >= end:
            continue
        kind, a, _ = num(at, True)
        size, a, _ = num(a, False)
        todo.append((a + size, end))
        if kind in (0x18538067, 0x1F43B675, 0xA0, 0x1C53BB6B):
            clusters += kind == 0x1F43B675
            todo.append((a, a + size))
        cues += kind == 0xBB
        if kind == 0xE7:
            time = int.from_bytes(data[a : a + size], "big")
        if kind in (0xA1, 0xA3):
            start = time + struct.unpack(">h", data[a + 1 : a + 3])[0]
            lacing, p, stop = data[a + 3] >> 1 & 3, a + 4, a + size
            n = data[p] + 1 if lacing else 1
            p += lacing > 0
            sizes = []
            for i in range(n - 1):
                if lacing == 1:
                    sizes.append(0)
                    while data[p] == 255:
                        sizes[-1], p = sizes[-1] + 255, p + 1
                    sizes[-1], p = sizes[-1] + data[p], p + 1
                elif lacing == 3:
                    v, p, w = num(p, False)
                    sizes.append(v if not i else sizes[-1] + v - 2 ** (7 * w - 1) + 1)
            sizes = [(stop - p) // n] * n if lacing == 2 else [*sizes, stop - p - sum(sizes)]
            for i, s in enumerate(sizes):
                ranges.append((p, p + s))
                times.append(start + 64 * i)
                p += s
    body = b"".join(data[a:b] for a, b in ranges)
    return body, f"packets={len(ranges)};clusters={clusters};cues={cues};last_ms={times[-1]};last_range={ranges[-1][0]}-{ranges[-1][1]};mean={sum(body) / len(body):.6f}"


def test_features_of_stored_bytes(spark):
    texts = ["", "one", "é" * 5000, "y" * 40_000, "abc" * 100_000]
    stored = M.store(table(spark, texts))
    got = rows(M.digests(stored))
    for r, (text, data) in zip(got.itertuples(), [(t, bytes(x.media)) for t, x in zip(texts, rows(stored).itertuples())], strict=True):
        body, feature = naive_feature(data)
        assert hashlib.sha256(body).hexdigest() == r.payload_sha256 == expect(text)[2]
        assert (r.feature, r.media_bytes, r.media_sha256) == (feature, len(data), hashlib.sha256(data).hexdigest())


def test_null_files(spark):
    df = spark.createDataFrame([(1, 0, None, "x"), (2, 0, M.element(M.EBML, b""), "x")], "doc_id long, n_bytes long, media binary, feature string")
    got = rows(M.digests(df))
    assert got.payload_bytes.isna().tolist() == [True, False] and got.payload_bytes[1] == 0 and got.feature[0] is None
    assert M.packets(df).count() == 0


def foreign(scale, *points):
    """A file whose cues lie before its clusters, as other writers put them, each time with positions in several tracks."""
    block = M.element(M.SIMPLE_BLOCK, M.vint(1) + struct.pack(">hB", 0, 0x80) + b"abc")
    clusters = [M.element(M.CLUSTER, M.uint(M.TIMESTAMP, 100 * i) + block) for i in (1, 2)]
    info = M.element(M.INFO, M.uint(M.SCALE, scale) + M.element(M.DURATION, struct.pack(">f", 300.0)))
    position = lambda track, at: M.element(M.CUE_POSITIONS, M.element(M.CUE_TRACK, bytes([track])) + M.element(M.CUE_CLUSTER, at.to_bytes(4, "big")))
    cues = lambda at: M.element(M.CUES, b"".join(M.element(M.CUE_POINT, b"".join(
        [M.uint(M.CUE_TIME, time)] * (not late) + [position(t, at(c)) for t, c in where] + [M.uint(M.CUE_TIME, time)] * late)) for time, where, late in points))
    size = len(info) + len(cues(lambda c: 0))
    body = info + cues(lambda c: size + len(clusters[0]) * c) + b"".join(clusters)
    return M.element(M.EBML, b"") + M.element(M.SEGMENT, body)


def test_cues_of_other_writers():
    data = foreign(500_000, (100, [(1, 0), (2, 0)], False), (200, [(2, 1), (1, 1), (3, 0)], True))
    media = M.demux(data)
    a, b = media.clusters
    assert media.cues == [(50, 1, a), (50, 2, a), (100, 2, b), (100, 1, b), (100, 3, a)]
    assert media.duration == 150.0 and [p.timestamp for p in media.packets] == [50, 100]
    assert "cues=5;" in M.digest(data)[5]
    assert M.digest(foreign(500_000, (100, [(1, 7)], False)))[-1] == "a cue points past the clusters"


def test_damaged_files_do_not_stop_the_job(spark):
    whole = M.mux(bytes(range(256)) * 1000)
    rng = random.Random(3)
    bad = [whole[:-10], foreign(1_000_000, (1, [(1, 9)], False)), b"\0" * 50, b"no media", whole[:70], M._id(M.SEGMENT) + M.vint(5, 8) * 400]
    for _ in range(300):
        broken = bytearray(whole[:3000])
        for _ in range(rng.randrange(1, 6)):
            broken[rng.randrange(3000)] = rng.randrange(256)
        M.read(bytes(broken))  # any damage is told, none raises
    df = spark.createDataFrame([(i, 0, m, "x") for i, m in enumerate([whole, *bad])], "doc_id long, n_bytes long, media binary, error string")
    got = rows(M.digests(df))
    assert got.error.isna().tolist() == [True] + [False] * len(bad)
    assert got.payload_bytes.isna().tolist() == [False] + [True] * len(bad)
    assert got.media_sha256.tolist() == [hashlib.sha256(m).hexdigest() for m in [whole, *bad]]
    table_ = rows(M.packets(df), ["doc_id", "packet"])
    cut = table_[table_.doc_id == 1]
    assert cut.error.notna().sum() == 1 and cut.packet.notna().sum() == len(M.demux(whole).packets)  # the damage is in the cues
    assert table_[table_.doc_id == 0].error.isna().all()
