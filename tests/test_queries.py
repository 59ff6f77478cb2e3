"""Every registered query against its DuckDB oracle on the smallest tables."""

import datetime
import glob
import math
import os

import duckdb
import pytest

from reelforge.plans import registry

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, float):
        return f"{x:.9g}"
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    return str(x)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_oracle(spark, duck, name):
    df = registry.queries()[name](spark, SMALL)
    want = duck.sql(registry.oracle_sql()[name])
    cols = sorted(df.columns)
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert sorted(tuple(map(plain, r)) for r in df.select(*cols).collect()) == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SMALL).count() > 0


def test_signatures_are_of_whole_profiles(spark):
    d = "/root/testdata/sf0.01"
    entries: dict = {}
    for r in spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_type", "value").collect():
        entries.setdefault(r.user_id, set()).add(f"{r.event_type}-{min(int(r.value // 100), 2)}")
    groups: dict = {}
    for user, own in entries.items():
        groups.setdefault(",".join(sorted(own)), []).append(user)
    got = {r.entries: r.aliases for r in registry.queries()["alias_signatures_all"](spark, d).collect()}
    assert got == {k: ",".join(map(str, sorted(v))) for k, v in groups.items()}
    assert 1 < len(groups) < len(entries)


def test_files_are_matched_among_all_customers(spark):
    d = "/root/testdata/sf0.01"
    shelves: dict = {}
    for r in spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_nationkey").collect():
        k = r.c_custkey
        shelves.setdefault((r.c_nationkey, (k & -k).bit_length() - 1), []).append(k)
    want, kinds = {}, set()
    for r in spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", "s_nationkey").collect():
        files = shelves.get((r.s_nationkey, r.s_suppkey % 12), [])
        exact = [k for k in files if k % 9 == r.s_suppkey % 9]
        want[r.s_suppkey] = min(exact) if exact else files[0] if len(files) == 1 else None
        kinds.add("exact" if exact else ["none", "only", "ambiguous"][min(len(files), 2)])
    assert {r.s_suppkey: r.c_custkey for r in registry.queries()["unique_file_match_all"](spark, d).collect()} == want
    assert kinds == {"exact", "only", "ambiguous", "none"}
