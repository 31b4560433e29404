"""Views of the driver's tables in the engine's shapes, as DataFrames and as SQL for the oracle."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        ship(spark)
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def n_paths(self) -> Column:
        return F.lit(self.supplier.count())

    def findings(self) -> DataFrame:
        li, o = self.lineitem, self.orders
        parts = [F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")] + [F.round(F.col("l_extendedprice") * 100).cast("long").cast("string"), F.round(F.col("l_discount") * 100).cast("long").cast("string"), F.date_format("l_shipdate", "yyyyMMdd")]
        level = F.substring("o_orderpriority", 1, 1)
        return li.join(o, li.l_orderkey == o.o_orderkey).select(
            F.concat(F.lit("F-"), F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 12)).alias("finding_id"), F.concat("l_returnflag", "l_linestatus").alias("rule"),
            F.when(level.isin("1", "2"), "error").when(level == "3", "warning").otherwise("note").alias("severity"), F.concat(F.lit("f"), F.col("l_suppkey").cast("string")).alias("path"),
            F.col("l_suppkey").alias("path_id"), (F.col("l_partkey") % 400).alias("line"), F.col("l_linenumber").alias("col"), F.col("l_orderkey").alias("run"), F.col("l_quantity").cast("long").alias("weight"))

    def methods(self) -> DataFrame:
        return self.part.select(
            F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("method_id"), "p_partkey", (F.col("p_partkey") % self.n_paths).alias("path_id"), (F.col("p_partkey") * 7 % 400).alias("start"),
            (F.col("p_partkey") * 7 % 400 + F.col("p_size")).alias("end"), F.col("p_brand").alias("provider"), F.col("p_type").alias("kind"), F.col("p_name").alias("name"), F.col("p_size").cast("long").alias("chars"))

    def edges(self) -> DataFrame:
        return self.lineitem.select(F.col("l_suppkey").alias("source"), (F.col("l_partkey") % self.n_paths).alias("target")).distinct().withColumn("ord", F.col("target"))

    def reads(self) -> DataFrame:
        offset = F.col("l_linenumber") * F.col("l_suppkey") % 90 + 1
        return self.lineitem.select(F.col("l_partkey").alias("file"), F.col("l_linenumber").alias("step"), F.col("l_orderkey").alias("run"), offset.alias("lo"), (offset + F.col("l_quantity").cast("long") - 1).alias("hi"), F.lit(100).cast("long").alias("total"))

    def trail(self) -> DataFrame:
        kind = F.when(F.col("event_type") == "signup", "agent_start").when(F.col("event_type") == "error", "agent_end").otherwise("agent_step")
        return self.events.select(F.col("event_id").alias("seq"), (F.col("event_id") * 7919 % 10007).alias("arrival"), "ts", F.col("user_id").alias("run"), "event_type", kind.alias("kind"), F.get_json_object("props", "$.k").cast("int").alias("k"), F.round(F.col("value") * 100).cast("long").alias("cents"))


#: The same views for DuckDB.
SQL = {
    "v_findings": """select 'F-' || substr(sha1(concat_ws('|', l_orderkey::varchar, l_partkey::varchar, l_suppkey::varchar, l_linenumber::varchar,
        round(l_extendedprice * 100)::bigint::varchar, round(l_discount * 100)::bigint::varchar, strftime(l_shipdate, '%Y%m%d'))), 1, 12) finding_id,
        l_returnflag || l_linestatus "rule", case when left(o_orderpriority, 1) in ('1', '2') then 'error' when left(o_orderpriority, 1) = '3' then 'warning' else 'note' end severity,
        'f' || l_suppkey::varchar path, l_suppkey path_id, l_partkey % 400 line, l_linenumber col, l_orderkey run, trunc(l_quantity)::bigint weight
        from lineitem join orders on l_orderkey = o_orderkey""",
    "v_methods": """select 'm' || p_partkey::varchar method_id, p_partkey, p_partkey % (select count(*) from supplier) path_id, p_partkey * 7 % 400 "start", p_partkey * 7 % 400 + p_size "end",
        p_brand provider, p_type kind, p_name "name", p_size::bigint chars from part""",
    "v_edges": "select distinct l_suppkey source, l_partkey % (select count(*) from supplier) target, l_partkey % (select count(*) from supplier) ord from lineitem",
    "v_reads": "select l_partkey file, l_linenumber step, l_orderkey run, l_linenumber * l_suppkey % 90 + 1 lo, l_linenumber * l_suppkey % 90 + trunc(l_quantity)::bigint hi, 100::bigint total from lineitem",
    "v_trail": """select event_id seq, event_id * 7919 % 10007 arrival, ts, user_id run, event_type, case event_type when 'signup' then 'agent_start' when 'error' then 'agent_end' else 'agent_step' end kind,
        (props::json ->> '$.k')::int k, round("value" * 100)::bigint cents from events""",
}


def oracle(sql: str) -> str:
    """`sql` with the views that it names as common table expressions."""
    used = [f"{name} as ({body})" for name, body in SQL.items() if name in sql]
    if not used:
        return sql
    head, _, rest = sql.strip().partition(" ")
    return f"with {', '.join(used)} {sql}" if head.lower() != "with" else f"with {'recursive ' if rest.lower().startswith('recursive ') else ''}{', '.join(used)}, {rest.removeprefix('recursive ')}"
