import hashlib
from pathlib import Path

import pytest

from tamarack.llm import warc

from .helpers import rows


def check(got, pages):
    best = {}
    for i, html in pages:
        body = (html or "").encode()
        if len(body) >= 1000:
            best[body] = max(i, best.get(body, i))
    want = {}
    for i, html in pages:
        body = (html or "").encode()
        refers = best.get(body)
        revisit = refers is not None and refers != i
        want[i] = (len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", refers if revisit else None)
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, None if r.refers_to != r.refers_to else r.refers_to) for r in got.itertuples()} == want


def test_edges(spark):
    big = "é" * 500
    html = [None, "", "x" * 999, "x" * 999, "x" * 1000, "x" * 1000, big, big, big, "y\r\n\r\n" * 400, "z" * 3_000_000]
    pages = [(i - 3, f"http://h/{i}\r\nX: 1" if i % 2 else None, h, "c") for i, h in enumerate(html)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, digest string").repartition(3)
    check(rows(warc.round_trip(df), "page_id"), [(p[0], p[2]) for p in pages])
    assert warc.round_trip(df.where("page_id > 100")).count() == 0


def test_whole_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/pages.parquet")
    d = df.toPandas()
    check(rows(warc.round_trip(df), "page_id"), list(zip(d.page_id, d.html)))


def test_files_are_plain_warc(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://a/", "p" * 1200), (2, "http://b/", "p" * 1200)], "page_id long, url string, html string").coalesce(1)
    manifest = warc.write_archives(df, f"file://{tmp_path}").collect()
    raw = b"".join(Path(r["path"].removeprefix("file://")).read_bytes() for r in manifest)
    records = [warc.parse_record(m) for m in warc.members(iter([raw]))]
    revisit = next(r for r in records if r.headers["warc-type"] == "revisit")
    assert revisit.payload == b"" and revisit.headers["warc-refers-to-target-uri"] == "http://b/"
    assert revisit.headers["warc-refers-to"] == warc.record_id(2) and "identical-payload-digest" in revisit.headers["warc-profile"]
    assert sum(r["records"] for r in manifest) == 2


def test_damage_is_noticed():
    raw = warc.gzip_member(warc.build_record(5, "u", b"abc"))
    assert [m[:8] for m in warc.members(iter([raw[:9], raw[9:] + raw]))] == [b"WARC/1.1"] * 2
    with pytest.raises(EOFError):
        list(warc.members(iter([raw[:-4]])))
    assert warc.page_of(warc.record_id(-7)) == -7
