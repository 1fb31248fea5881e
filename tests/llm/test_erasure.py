import hashlib
import math
import zlib
from pathlib import Path
from urllib.parse import urlparse

import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tamarack.llm import erasure
from tamarack.llm.queries import op11_erasure

AMOUNT = {"clients": "balance", "clicks": "value", "sales": "total", "sale_lines": "amount"}


def dec(v):
    return "" if v is None else str(v)


def crc(v):
    return zlib.crc32(dec(v).encode())


def lists(df):
    """Rows as tuples of plain values, None for null."""
    return [tuple(r) for r in df.collect()]


def order(row):
    return [(v is not None, 0 if v is None else v.encode() if isinstance(v, str) else v) for v in row]


def brute(tables, modulo=400, files=350):
    """Per final file: the report's cells, by the contract's words."""
    at = {t: {c: i for i, c in enumerate(tables[t][0])} for t in tables}
    rows = {t: tables[t][1] for t in tables}
    get = lambda t, r, c: r[at[t][c]]
    owner = {}
    for r in rows["sales"]:
        s, c = get("sales", r, "sale_id"), get("sales", r, "client_id")
        if s is not None:
            owner[s] = c if owner.get(s) is None else owner[s] if c is None else min(owner[s], c)
    key = {t: (lambda r, t=t: crc(owner.get(get(t, r, "sale_id")) if t == "sale_lines" else get(t, r, "client_id"))) for t in rows}
    own = {}
    for r in rows["clients"]:
        if get("clients", r, "master_id") is not None:
            own.setdefault(get("clients", r, "master_id"), set()).add(get("clients", r, "client_id"))
    clicks = pd.Series([get("clicks", r, "client_id") for r in rows["clicks"]], dtype=object).value_counts().to_dict()
    masters = {m for m in own if crc(m) % modulo == 0}
    if own:
        masters.add(min(own, key=lambda m: (-sum(clicks.get(c, 0) for c in own[m] if c is not None), m)))
    gone = {"clients": lambda r: get("clients", r, "master_id") in masters}
    clients = {get("clients", r, "client_id") for r in rows["clients"] if gone["clients"](r)} - {None}
    gone["clicks"] = lambda r: get("clicks", r, "client_id") in clients
    gone["sales"] = lambda r: get("sales", r, "client_id") in clients
    sales = {get("sales", r, "sale_id") for r in rows["sales"] if gone["sales"](r)} - {None}
    gone["sale_lines"] = lambda r: get("sale_lines", r, "sale_id") in sales
    out = {}
    for t in rows:
        ordered = sorted(rows[t], key=lambda r: (key[t](r), order(r)))
        size = 1 + len(ordered) // files
        for k in range(0, len(ordered), size):
            part = ordered[k : k + size]
            left = [r for r in part if not gone[t](r)]
            if left:
                amounts = [get(t, r, AMOUNT[t]) for r in left]
                cents = sum(math.floor(100 * a + 0.5) for a in amounts if a is not None and math.isfinite(a))
                digest = hashlib.sha256(",".join(dec(r[0]) for r in left).encode()).hexdigest()
                out[t, k // size] = (len(left), len(part) - len(left), cents, len(left) < len(part), digest, ",".join(tables[t][0]), left)
    return out


def held_to_brute(out, tables, **settings):
    want = brute(tables, **settings)
    got = out.collect()
    assert len(got) == len(want)
    assert {(r.table_name, r.file_no): (r.n_rows, r.n_erased, r.cents, r.rewritten, r.ids_sha256, r["columns"]) for r in got} == {k: v[:6] for k, v in want.items()}
    paths = {urlparse(r.path).path: want[r.table_name, r.file_no][6] for r in got}
    for p, left in paths.items():
        file = pq.ParquetFile(p)
        assert file.metadata.num_rows == len(left)
        first = file.metadata.row_group(0).column(0).statistics
        ids = [r[0] for r in left if r[0] is not None]
        if file.metadata.num_row_groups == 1 and ids:
            assert (first.min, first.max) == (min(ids), max(ids))
    if paths:
        root = Path(next(iter(paths))).parents[2]
        assert {str(p) for p in root.rglob("*") if p.is_file() and not p.name.startswith((".", "_"))} == set(paths)


def test_query_is_brute_force(spark, sf_dir):
    read = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in AMOUNT}
    out = op11_erasure(spark, sf_dir)
    assert dict(out.dtypes) == {"table_name": "string", "file_no": "bigint", "path": "string", "columns": "string", "n_rows": "bigint", "n_erased": "bigint", "cents": "bigint", "ids_sha256": "string", "rewritten": "boolean"}
    held_to_brute(out, {t: (df.columns, lists(df)) for t, df in read.items()})


SCHEMAS = {
    "clients": "client_id long, master_id long, note string, balance double, rank string",
    "clicks": "click_id long, client_id long, value double, rank string",
    "sales": "sale_id long, client_id long, total double, bucket string",
    "sale_lines": "sale_id long, line_no int, amount double, rows string",
}


def test_odd_rows(spark):
    """Nulls in every column, repeated rows, one client with a third of all, ties at no clicks, names that clash."""
    nan = float("nan")
    data = {
        "clients": [(i, i // 2, "x" if i % 3 else None, i * 1.005, None) for i in range(60)] + [(None, 3, None, None, None), (7, None, "é", nan, "r"), (None,) * 5] + [(5, 9, "d", 1.0, None)] * 9,
        "clicks": [(i, i % 50 if i % 3 else 7, i / 7, "k") for i in range(300)] + [(None, None, None, None)] * 5 + [(9, 7, -0.5, "same")] * 40,
        "sales": [(i, i % 50 if i % 3 else 7, i / 3, None) for i in range(200)] + [(3, None, 1.0, "b"), (None, 7, 1.0, None), (None,) * 4],
        "sale_lines": [(i % 210, i % 4, float(i), "r") for i in range(500)] + [(12, 1, 2.5, "one")] * 250 + [(None, 1, 1.0, None), (999, None, None, None), (None,) * 4],
    }
    for n in (7, 350):
        frames = [spark.createDataFrame(data[t], SCHEMAS[t]) for t in SCHEMAS]
        held_to_brute(erasure.shop_cascade(*frames, modulo=5, files=n), {t: ([c.split(" ")[0] for c in SCHEMAS[t].split(", ")], data[t]) for t in SCHEMAS}, modulo=5, files=n)
    frames[1] = frames[1].where("client_id < 0")
    data["clicks"] = []
    held_to_brute(erasure.shop_cascade(*frames, modulo=1000, files=9), {t: ([c.split(" ")[0] for c in SCHEMAS[t].split(", ")], data[t]) for t in SCHEMAS}, modulo=1000, files=9)


def test_empty_tables(spark):
    frames = [spark.createDataFrame([], SCHEMAS[t]) for t in SCHEMAS]
    assert erasure.shop_cascade(*frames).count() == 0


def test_only_affected_files_change(spark, tmp_path):
    rows = spark.range(1000).select("id", (F.col("id") % 10).alias("who"), F.lit(1.0).alias("x"), F.floor(F.col("id") / 100).alias("k"))
    path, schema = str(tmp_path / "t"), "id long, who long, x double, k long"
    assert erasure.store(rows.withColumn("sort_key", F.col("id")), "sort_key", path, 20) == 1000
    files = lambda: {p: (p.stat().st_mtime_ns, p.read_bytes()) for p in Path(path).rglob("*.parquet")}
    before = files()
    assert len(before) == 20
    keys = spark.createDataFrame([(3,), (None,)], "k long")
    gone = {r.file_no: r.n_erased for r in erasure.erase(spark, path, schema, keys, "k").collect()}
    after = files()
    assert sum(gone.values()) == 100 and set(gone) == {5, 6, 7}
    assert {p: v for p, v in before.items() if int(p.parent.name.split("=")[1]) not in gone} == {p: v for p, v in after.items() if int(p.parent.name.split("=")[1]) not in gone}
    assert len(after) == 20 - sum(n == 51 for n in gone.values())
    again = erasure.erase(spark, path, schema, keys, "k")
    assert again.count() == 0 and files() == after
    assert [r.id for r in erasure.stored(spark, path, schema).orderBy("file_no", "_row").collect()] == [i for i in range(1000) if i // 100 != 3]
