"""JSON, JSONL, text and report sources (SRC-4 to SRC-17)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import fixed
from ..operators.store import materialised

MOST_FILES = 5000


def files(spark: SparkSession, root: str, suffixes: tuple[str, ...] = (), most_bytes: int | None = None, skipped: tuple[str, ...] = (), hidden: bool = True) -> DataFrame:
    """path (below root), length and content of the files under root. Files under a skipped folder are left out, and those under
    a folder whose name begins with a dot unless `hidden`. Only files that are wanted are read."""
    rows, top = listed(spark, root, skipped, hidden), uri(spark, root)
    if most_bytes is not None:
        rows = rows.filter(F.col("length") <= most_bytes)
    if suffixes:
        rows = rows.filter(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*suffixes))

    def contents(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = pyarrow.fs.FileSystem.from_uri(top)
        for some in parts:
            for i in range(len(some)):  # a file at a time
                row = some.iloc[i : i + 1]
                with fs.open_input_file(f"{base}/{row['path'].iloc[0]}") as f:
                    yield row.assign(content=[f.read()])

    return rows.mapInPandas(contents, "path string, length long, content binary")


def uri(spark: SparkSession, path: str) -> str:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toUri().toString()
    return re.sub("^file:/+", "file:///", whole).rstrip("/")


def listed(spark: SparkSession, root: str, skipped: tuple[str, ...] = (), hidden: bool = True) -> DataFrame:
    """path (below root) and length of the files under root, names that begin with a dot or an underscore too. Folders are listed in
    tasks, a level a round, and skipped ones aren't entered; a round's table has the level's files and folders."""
    top = uri(spark, root)

    def entries(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = pyarrow.fs.FileSystem.from_uri(top)
        for some in parts:
            out = []
            for path in some["path"]:
                for e in fs.get_file_info(pyarrow.fs.FileSelector(f"{base}/{path}".rstrip("/"))):
                    folder = e.type == pyarrow.fs.FileType.Directory
                    if not (folder and (e.base_name in skipped or not hidden and e.base_name.startswith("."))):
                        out.append((f"{path}/{e.base_name}".lstrip("/"), None if folder else e.size, folder))
            yield pd.DataFrame(out, columns=["path", "length", "folder"]).astype({"length": "Int64", "folder": "bool"})

    level, found = spark.createDataFrame([("",)], "path string"), []
    while not level.isEmpty():
        found.append(materialised(level.repartition("path").mapInPandas(entries, "path string, length long, folder boolean")))
        level = found[-1].filter("folder").select("path")
    return reduce(DataFrame.unionByName, found).filter("not folder").select("path", "length")


def workspace_files(spark: SparkSession, root: str, suffixes: tuple[str, ...], most_bytes: int = 1 << 20, most_files: int = MOST_FILES) -> DataFrame:
    """Source files to look definitions up in, hidden folders too. The cap on their number is the listing's own feature; which
    files it leaves is the order of paths here, and the list comes in that order."""
    return files(spark, root, suffixes, most_bytes, fixed.WORKSPACE_SKIPS).orderBy("path").limit(most_files)


def inventory_files(spark: SparkSession, root: str, suffixes: tuple[str, ...] = (".py",)) -> DataFrame:
    """Files that a parser reads (all files without suffixes), by path; none is too large and hidden folders count."""
    return files(spark, root, suffixes, None, fixed.INVENTORY_SKIPS).orderBy("path")


def survey_files(spark: SparkSession, root: str) -> DataFrame:
    """All files but those under hidden or skipped folders, by path."""
    return files(spark, root, (), None, fixed.SURVEY_SKIPS, hidden=False).orderBy("path")


def texts(rows: DataFrame) -> DataFrame:
    """path, text (UTF-8 with replacement) and state: ok or binary (a NUL among the first 4,096 bytes)."""
    binary = F.instr(F.hex(F.substring("content", 1, 4096)), "00") > 0
    aligned = F.exists(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(4096), F.length("content")))), lambda i: F.substring("content", i, F.lit(1)) == F.unhex(F.lit("00")))
    state = F.when(binary & aligned, "binary").otherwise("ok")
    return rows.select("path", state.alias("state"), F.when(state == "ok", F.decode("content", "UTF-8")).alias("text"))


def jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Lines as objects with a column damaged for lines that aren't one; blank lines are left out."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return parsed_lines(spark.read.text(path), kind)


def parsed_lines(lines: DataFrame, kind: StructType) -> DataFrame:
    """Lines (value) as objects with a column damaged."""
    raw = lines.filter(F.trim("value") != "")
    parsed = raw.select("value", F.try_parse_json("value").alias("v"))
    whole = F.col("v").isNotNull() & F.startswith(F.ltrim("value"), F.lit("{"))
    return parsed.select(F.when(whole, F.from_json("value", kind)).alias("row"), (~whole).alias("damaged")).select("row.*", "damaged")


def tail(rows: DataFrame, order: str, limit: int = 200) -> DataFrame:
    """The newest `limit` whole rows, with the total of whole rows and the number of damaged lines."""
    counts = rows.agg(F.count_if(~F.col("damaged")).alias("total"), F.count_if("damaged").alias("n_damaged"))
    return rows.filter("not damaged").orderBy(F.desc(order)).limit(limit).crossJoin(F.broadcast(counts))  # counts is one row


def after(rows: DataFrame, seq: int, limit: int = 500) -> DataFrame:
    """Oldest whole rows with a greater seq."""
    return rows.filter(~F.col("damaged") & (F.col("seq") > seq)).orderBy("seq").limit(limit)


def last_session(rows: DataFrame, run: str, session: str, order: str) -> DataFrame:
    """Rows of each run since its session changed last: a session that comes back after another begins anew."""
    by = Window.partitionBy(run).orderBy(order)
    changed = ~F.col(session).eqNullSafe(F.lag(session).over(by)) | F.lag(F.lit(1)).over(by).isNull()
    numbered = rows.withColumn("__turn", F.sum(F.when(changed, 1).otherwise(0)).over(by))
    last = numbered.groupBy(run).agg(F.max("__turn").alias("__last"))
    return numbered.join(last.withColumnRenamed(run, "__run"), F.col(run).eqNullSafe(F.col("__run")) & (F.col("__turn") == F.col("__last"))).select(*rows.columns)


def documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents with file, folder and error: what can't be read keeps a row."""
    raw = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").schema(f"{schema}, _bad string").json(path)
    at = F.split(F.col("_metadata.file_path"), "/")
    return raw.select("*", F.col("_metadata.file_path").alias("file"), F.element_at(at, -2).alias("folder"), F.when(F.col("_bad").isNotNull(), "unreadable").alias("error")).drop("_bad")


def newest_first(rows: DataFrame, at: str = "created_at") -> DataFrame:
    return rows.orderBy(F.coalesce(F.col(at), F.lit("")).desc())


def listed_bundles(rows: DataFrame) -> DataFrame:
    """Rows of bundle manifests (folder, error and the manifest's fields) as the list of bundles: folders that begin with a dot are
    still being written; what a manifest lacks is null, what it lists is counted and its providers are named once, sorted."""
    fields = dict(rows.dtypes)
    shown = rows.filter(~F.startswith("folder", F.lit("."))).withColumn("bundle_id", F.col("folder"))
    for name, one in (("prunes", "prune_count"), ("degradations", "degradation_count")):
        if name in fields:
            shown = shown.withColumn(one, F.when(F.col("error").isNull(), F.size(F.coalesce(name, F.array().cast(fields[name]))))).drop(name)
    if "methods" in fields:
        shown = shown.withColumn("providers", F.array_sort(F.array_distinct(F.filter(F.transform("methods", lambda m: m["provider"]), lambda p: p.isNotNull())))).drop("methods")
    return newest_first(shown)


def manifests(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """`listed_bundles` of the manifest of every folder below path, or of the documents in it."""
    return listed_bundles(documents(spark, path, schema))


def registered_projects(rows: DataFrame, staging: str = ".staging-") -> DataFrame:
    """Project records (folder, error and fields), newest first: damaged ones and those in staging folders are left out."""
    return newest_first(rows.filter(F.col("error").isNull() & ~F.startswith("folder", F.lit(staging)))).drop("error")


def prompt_blocks(rows: DataFrame, prefix: DataFrame) -> DataFrame:
    """Blocks (bundle, at, block_id ...) with in_prefix: whether the bundle's prefix document (bundle, prefix_blocks) names them. A
    missing or unreadable prefix document is an empty set; a bundle without blocks is missing here, and an error to a reader."""
    named = prefix.select("bundle", F.explode("prefix_blocks").alias("block_id")).distinct().withColumn("in_prefix", F.lit(True))
    return rows.join(named, ["bundle", "block_id"], "left").withColumn("in_prefix", F.coalesce("in_prefix", F.lit(False)))


def flow_report(spark: SparkSession, path: str) -> DataFrame:
    """report (file), flow and its elements (label, method, file, line, code) in order, from tab-separated ELEM rows; others are
    passed over. Each file is one report and its line order counts."""
    return flow_elements(spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("report"), "value"))


def flow_elements(reports: DataFrame) -> DataFrame:
    """The flows of reports that are rows (report, value). Flow numbers are a report's own."""
    lines = reports.select("report", F.posexplode(F.split("value", "\r?\n")).alias("pos", "text"))
    cells = lines.select("report", "pos", F.split("text", "\t").alias("c")).filter((F.col("c")[0] == "ELEM") & (F.size("c") >= 7) & F.get(F.col("c"), F.lit(1)).rlike("^[0-9]+$"))
    element = F.struct("pos", F.col("c")[2].alias("label"), F.col("c")[3].alias("method"), F.col("c")[4].alias("file"), F.col("c")[5].alias("line"), F.col("c")[6].alias("code"))
    return cells.groupBy("report", F.col("c")[1].cast("int").alias("flow")).agg(F.array_sort(F.collect_list(element)).alias("elements"))


def symbols(spark: SparkSession, rows: DataFrame, keys: tuple[str, ...] = ("path",), depth: int | None = None) -> DataFrame:
    """Flat symbols of documentSymbol answers of any depth: rows of `keys` and payload (JSON text). place numbers an answer's symbols in
    preorder; parent is the chain of names above, joined by dots, or the container of a flat symbol, whose range is its location's. With
    `depth` so many levels below the first are read.

    A payload is read as a VARIANT, and a level's children are exploded until none is left: as many rounds as the deepest answer has
    levels, over what is left of the others. Levels are written."""
    from pyspark.sql.functions import lit

    def got(path: str, kind: str) -> Column:
        return F.try_variant_get(F.col("v"), path, kind)

    span = "struct<start:struct<line:int,character:int>,`end`:struct<line:int,character:int>>"
    level = rows.select(*keys, F.expr("try_parse_json(payload)").alias("v"), F.array().cast("array<int>").alias("at"), lit(None).cast("string").alias("above"))
    level, levels = materialised(exploded(level, keys, "$")), []
    while not level.isEmpty() and (depth is None or len(levels) <= depth):
        named = level.select(*keys, "at", "v", F.coalesce(got("$.name", "string"), lit("?")).alias("name"), got("$.kind", "int").alias("kind"), F.coalesce(got("$.range", span), got("$.location.range", span)).alias("range"), F.coalesce("above", got("$.containerName", "string"), lit("")).alias("parent"), "above")
        levels.append(named.filter("range is not null").drop("v", "above"))
        deeper = named.select(*keys, "at", "v", F.concat_ws(".", "above", "name").alias("above"))
        level = materialised(exploded(deeper, keys, "$.children"))
    if not levels:
        return level.select(*keys, lit("").alias("name"), lit(0).alias("kind"), lit(None).cast(span).alias("range"), lit("").alias("parent"), lit(0).alias("place"))
    out = reduce(DataFrame.unionByName, levels)
    # the path of places sorts in preorder; an answer's symbols are numbered by it
    return out.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("at")) - 1).drop("at")


def exploded(level: DataFrame, keys: tuple[str, ...], path: str) -> DataFrame:
    """The objects of an array in the variant `v`, each with its place behind the places of those above."""
    items = F.try_variant_get(F.col("v"), path, "array<variant>")
    each = level.select(*keys, "at", "above", F.posexplode(items).alias("__i", "__v"))
    return each.select(*keys, F.concat("at", F.array("__i")).alias("at"), "above", F.col("__v").alias("v"))
