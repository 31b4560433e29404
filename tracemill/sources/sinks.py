"""Writers (SNK-1 to SNK-9). Spark's commit protocol makes a write appear whole or not at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import lookup
from ..operators.rows import ordinal


def package(tables: dict[str, DataFrame], root: str) -> None:
    """Tables of one bundle as JSON folders below `root`."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{root}/{name}")


def ordered_jsonl(df: DataFrame, path: str, *order: Column) -> None:
    """One file of one object a line in a total order; for lists that a person reads."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").json(path)


def verdicts(calls: DataFrame, path: str) -> None:
    """An AI report of calls (call_id, verdict, answer ...): the calls with a verdict, raw answers apart."""
    calls.filter("verdict is not null").drop("answer").write.mode("overwrite").json(f"{path}/verdicts")
    calls.filter("answer is not null").select("call_id", "answer").write.mode("overwrite").json(f"{path}/answers")


def numbered(rows: DataFrame, last_seq: int, *order: Column) -> DataFrame:
    """Events with a seq that goes on from last_seq in order."""
    return ordinal(rows, "seq", *order).withColumn("seq", F.col("seq") + last_seq + 1)


def appended(df: DataFrame, path: str, *by: str) -> None:
    """Append in partitions, so that retention is dropping a partition."""
    df.write.mode("append").partitionBy(*by).json(path)


def trail(rows: DataFrame, path: str, kinds: list[str], last_seq: int, *order: Column) -> None:
    """Append events to a trail: a seq that only grows, and kinds that aren't known as `unknown` with their raw_kind."""
    known_kinds(numbered(rows, last_seq, *order), kinds).write.mode("append").json(path)


def traffic(rows: DataFrame, path: str, texts: list[str], most_bytes: int = 4 << 20, width: int = 300) -> None:
    """Append rows of traffic with their texts cut, to `now` below path; once that holds most_bytes it becomes `before`, and the older one
    goes: one generation is kept."""
    spark = rows.sparkSession
    fs_of = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    now, before = (spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}") for n in ("now", "before"))
    if fs_of.exists(now) and fs_of.getContentSummary(now).getLength() >= most_bytes:
        fs_of.delete(before, True)
        fs_of.rename(now, before)
    rows.withColumns({c: F.substring(c, 1, width) for c in texts}).write.mode("append").json(f"{path}/now")


def step_archive(steps: DataFrame, path: str) -> None:
    """Append steps (run_id ...) to an archive with a folder a run: its id without odd characters, and the beginning of its sha256."""
    name = F.concat(F.regexp_replace("run_id", "[^A-Za-z0-9._-]", "_"), F.lit("-"), F.substring(F.sha2("run_id", 256), 1, 16))
    steps.withColumn("run_folder", name).write.mode("append").partitionBy("run_folder").json(path)


def slim(df: DataFrame, lists: list[str], n: int = 50) -> DataFrame:
    """Long lists cut to n with <name>_omitted counts."""
    for c in lists:
        df = df.withColumn(f"{c}_omitted", F.greatest(F.size(c) - n, F.lit(0))).withColumn(c, F.slice(c, 1, n))
    return df


def known_kinds(df: DataFrame, kinds: list[str]) -> DataFrame:
    """Events of other kinds become `unknown` and keep theirs as raw_kind."""
    return df.withColumn("raw_kind", F.when(~F.col("kind").isin(*kinds), F.col("kind"))).withColumn("kind", F.when(F.col("kind").isin(*kinds), F.col("kind")).otherwise("unknown"))


def markdown(df: DataFrame, title: str, most: int = 1000) -> str:
    """A small aggregated table as a Markdown document for a person. What `most` rows leave out is told in the last line;
    `markdown_files` writes all."""
    head = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    held = df.limit(most + 1).collect()
    body = ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in held[:most]]
    if len(held) > most:
        body += ["", f"{df.count() - most} more rows are left out."]
    return "\n".join([*head, *body])


def markdown_files(df: DataFrame, title: str, path: str, *order: Column) -> None:
    """The whole table as Markdown: text files in order below path, the first with the title and the head."""
    head = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    lines = table_lines(ordinal(df, "at", *(order or map(F.col, df.columns))), "at")
    top = df.sparkSession.createDataFrame([(i - len(head), h) for i, h in enumerate(head)], "at long, line string")
    top.unionByName(lines).orderBy("at").select("line").write.mode("overwrite").text(path)


def table_lines(rows: DataFrame, *keep: str) -> DataFrame:
    """line: each row as a line of a Markdown table, beside the columns `keep`, which aren't in it."""
    cells = [x for c in rows.columns if c not in keep for x in (F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(" | "))][:-1]
    return rows.select(*keep, F.concat(F.lit("| "), *cells, F.lit(" |")).alias("line"))


#: Colours of edges by provider.
COLOUR_OF_PROVIDER = {"lsp_call_hierarchy": "black", "lsp_references": "blue", "syntax_regex": "orange", "file_range": "gray"}


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines of a DOT graph (part, a, b, line): nodes (id, label) by id, then edges (source, target, provider) in their order. A graph is
    written as sorted lines, never as one text."""
    colour = F.coalesce(lookup(F.col("provider"), COLOUR_OF_PROVIDER), F.lit("black"))
    of = nodes.select(F.lit(0).alias("part"), F.col("id").alias("a"), F.lit(None).cast(nodes.schema["id"].dataType).alias("b"), F.concat(F.lit('  "'), F.col("id").cast("string"), F.lit('" [label="'), "label", F.lit('"];')).alias("line"))
    return of.unionByName(edges.select(F.lit(1).alias("part"), F.col("source").alias("a"), F.col("target").alias("b"), F.concat(F.lit('  "'), F.col("source").cast("string"), F.lit('" -> "'), F.col("target").cast("string"), F.lit('" [color="'), colour, F.lit('"];')).alias("line")))


def dot_file(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """The DOT graph as text: files in order, each in order."""
    spark = nodes.sparkSession
    ends = spark.createDataFrame([(-1, "digraph calls {"), (2, "}")], "part int, line string")
    lines = dot_lines(nodes, edges).unionByName(ends, allowMissingColumns=True)
    lines.orderBy("part", "a", "b").select("line").write.mode("overwrite").text(path)
