"""Every registered query against its SQL on the smallest driver tables."""

from __future__ import annotations

import decimal
from pathlib import Path

import duckdb
import pytest

from tracemill.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    return repr(float(v)) if isinstance(v, decimal.Decimal) else str(v)


@pytest.mark.skipif(not Path(SF).exists(), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_agrees_with_sql(spark, oracle, name):
    got = registry.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    found = oracle.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == want


@pytest.mark.parametrize("name", ["intervals_halfopen", "intervals_inclusive"])
def test_reads_of_unknown_lines_agree_with_sql(spark, tmp_path, name):
    """Reads without a quantity have no last line, those without a supplier no line at all; no two reads of a file are equal."""
    reads = [(1, 1, 1, 1, None), (1, 2, 1, 1, 5.0), (1, 3, 3, 1, 7.0), (1, 4, None, 1, 2.0), (2, 5, 1, 1, None), (2, 6, 1, 2, None), (3, 7, None, 1, 1.0), (3, 8, 50, 1, 50.0), (None, 9, 1, 1, 3.0)]
    spark.createDataFrame(reads, "l_partkey long, l_orderkey long, l_suppkey long, l_linenumber int, l_quantity double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    got = registry.QUERIES[name](spark, str(tmp_path))
    want = con.execute(registry.ORACLE_SQL[name])
    assert got.columns == [d[0] for d in want.description]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))


def agrees(spark, folder, name, **tables):
    """Whether a query over made-up tables (rows and schema) has the rows of its SQL."""
    con = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    got = registry.QUERIES[name](spark, str(folder))
    want = con.execute(registry.ORACLE_SQL[name])
    assert got.columns == [d[0] for d in want.description]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))


def test_jobs_of_unknown_lines_agree_with_sql(spark, tmp_path):
    """Lines without a number or a price come last, those without a flag may have ended, and one without a quantity has no time."""
    lines = [(1, None, 1.0, 9.0, "N"), (1, 1, 1.0, 30.0, "A"), (1, 1, None, 5.0, "A"), (2, 1, 1.0, 3.0, "A"), (2, 2, 1.0, 3.0, None), (3, 1, 1.0, 3.0, None), (4, 1, 1.0, 3.0, None), (4, 2, 1.0, 49.0, "N")]
    lines += [(5, 1, 1.0, 3.0, "R"), (5, 2, 1.0, None, "R"), (5, 3, 1.0, 3.0, "N"), (6, 1, 1.0, None, "N"), (7, 1, 1.0, None, "A"), (8, 1, 1.0, None, "A"), (8, 2, 1.0, 9.0, "N"), (9, 1, 1.0, 1.0, "A"), (9, 2, 1.0, 40.0, None)]
    agrees(spark, tmp_path, "job_takeovers", lineitem=(lines, "l_orderkey long, l_linenumber int, l_extendedprice double, l_quantity double, l_returnflag string"))


@pytest.mark.parametrize("flip", [False, True])
def test_jobs_of_equal_lines_are_the_same_in_any_order(spark, tmp_path, flip):
    """Lines of one number and price follow each other by quantity and flag, however they are stored."""
    lines = [(job, 1, 5.0, float(q), flag) for job in range(20) for q, flag in ((50, "A"), (2, "N"), (2, "A"), (31, "R"))]
    spark.createDataFrame(lines[::-1] if flip else lines, "l_orderkey long, l_linenumber int, l_extendedprice double, l_quantity double, l_returnflag string").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = registry.QUERIES["job_takeovers"](spark, str(tmp_path)).filter("job_id = 7").orderBy("at").collect()
    assert [(r["at"], r["state"]) for r in got] == [(62, "queued"), (62, "running"), (192, "running"), (262, "failed"), (762, "expired")]


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def test_steps_of_unknown_arrival_agree_with_sql(spark, tmp_path):
    """A step without an id has no arrival and comes after the others."""
    events = [(i, None, user, "view", 1.0, "{}") for user in (1, 2) for i in (None, *range(10 * user, 10 * user + 4 * user))]
    agrees(spark, tmp_path, "topk_new_per_scope", events=(events, EVENTS))


def test_agents_of_unknown_arrival_agree_with_sql(spark, tmp_path):
    """An event without an id has no arrival and comes after the others, be it a start, a step or an end."""
    told = {1: ["signup", "view", "error", "view"], 2: ["view", "signup", "signup", "error"], 3: ["view"], 4: ["signup", "view"]}
    last = {1: "view", 2: "signup", 3: "signup", 4: "error"}
    events = [(10 * user + n, None, user, kind, 1.0, "{}") for user, kinds in told.items() for n, kind in enumerate(kinds)]
    agrees(spark, tmp_path, "agent_rows_fold", events=(events + [(None, None, user, kind, 1.0, "{}") for user, kind in last.items()], EVENTS))


def test_coverage_of_repeated_files_agrees_with_sql(spark, tmp_path):
    """A file is counted once, with the lines of all its rows, and so are those without a key."""
    parts = [(1,), (1,), (2,), (3,), (3,), (None,), (None,)]
    reads = [(1, 1, 0, 1, 60.0), (2, 2, 0, 1, 7.0), (2, 3, 49, 1, 5.0), (None, 4, 0, 1, 3.0)]
    agrees(spark, tmp_path, "coverage_full_partial_never", part=(parts, "p_partkey long"), lineitem=(reads, "l_partkey long, l_orderkey long, l_suppkey long, l_linenumber int, l_quantity double"))
