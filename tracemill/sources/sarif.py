"""SARIF documents as findings (SRC-1 to SRC-3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars

RULE = "id string, aliases array<string>, shortDescription struct<text:string>, defaultConfiguration struct<level:string>, properties struct<tags:array<string>>"
REGION = "struct<startLine:int,startColumn:int,endLine:int,endColumn:int,snippet:struct<text:string>>"
SCHEMA = f"""runs array<struct<tool:struct<driver:struct<name:string,rules:array<struct<{', '.join(x.replace(' ', ':', 1) for x in RULE.split(', '))}>>>>,
    results:array<struct<ruleId:string,level:string,message:struct<text:string>,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:{REGION}>>>,fingerprints:map<string,string>>>>>, _bad string"""


def falsy(value: Column) -> Column:
    """Null for an empty text."""
    return scalars.nonempty(value)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole-document SARIF files with their run list; invalid JSON is an error when rows are read."""
    raw = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").schema(SCHEMA).json(path)
    checked = F.when(F.col("_bad").isNotNull(), F.raise_error(F.lit("invalid SARIF json"))).otherwise(F.col("runs"))
    return raw.select(F.col("_metadata.file_path").alias("file"), checked.alias("runs"))


def from_texts(texts: DataFrame, text: str = "text", file: str = "file") -> DataFrame:
    """Documents that are rows already."""
    kind = SCHEMA.rsplit(",", 1)[0]
    parsed = F.from_json(text, kind)
    checked = F.when(F.try_parse_json(text).isNull(), F.raise_error(F.lit("invalid SARIF json"))).otherwise(parsed["runs"])
    return texts.select(F.col(file).alias("file"), checked.alias("runs"))


def rules(runs: DataFrame) -> DataFrame:
    """file, run, rule_id and the rule's severity sources. A missing id is rule-<position>; of a repeated id the last counts; an
    alias fills in where no rule has that id."""
    each = runs.select("file", "run", F.posexplode(F.col("r.tool.driver.rules")).alias("pos", "rule"))
    own = each.withColumn("rule_id", F.coalesce(falsy(F.col("rule.id")), F.concat(F.lit("rule-"), F.col("pos").cast("string")))).withColumn("order", F.col("pos").cast("long"))
    alias = each.select("file", "run", "pos", "rule", F.explode("rule.aliases").alias("rule_id")).withColumn("order", -1 - F.col("pos").cast("long"))
    best = own.unionByName(alias).groupBy("file", "run", "rule_id").agg(F.max_by("rule", "order").alias("rule"))
    tags = F.filter(F.transform(F.coalesce("rule.properties.tags", F.array().cast("array<string>")), scalars.severity_of_text), lambda x: x.isNotNull())
    return best.select("file", "run", "rule_id", scalars.severity_of_text(F.col("rule.defaultConfiguration.level")).alias("rule_severity"), F.get(tags, F.lit(0)).alias("tag_severity"), F.col("rule.shortDescription.text").alias("rule_text"))


def findings(spark: SparkSession, path: str) -> DataFrame:
    return projected(documents(spark, path))


def projected(docs: DataFrame) -> DataFrame:
    """One row per result with a location and a uri: finding_id, rule, severity, path, region (0-based), message, snippet, tool."""
    runs = docs.select("file", F.posexplode("runs").alias("run", "r"))
    results = runs.select("file", "run", F.coalesce(falsy(F.col("r.tool.driver.name")), F.lit("unknown")).alias("tool"), F.explode("r.results").alias("x"))
    place = F.element_at("x.locations", 1)["physicalLocation"]
    region = place["region"]
    line = F.coalesce(F.nullif(region["startLine"], F.lit(0)), F.lit(1))
    rows = results.filter(F.size(F.coalesce("x.locations", F.array().cast(results.schema["x"].dataType["locations"].dataType))) > 0).select(
        "file", "run", "tool", F.coalesce(falsy(F.col("x.ruleId")), F.lit("unknown")).alias("rule"), F.col("x.level").alias("level"), F.coalesce(F.col("x.message.text"), F.lit("")).alias("message"), scalars.clean_path(falsy(place["artifactLocation"]["uri"])).alias("path"),
        F.greatest(F.lit(0), line - 1).alias("start_line"), F.greatest(F.lit(0), F.coalesce(region["startColumn"], F.lit(1)) - 1).alias("start_char"),
        F.greatest(F.lit(0), F.coalesce(F.nullif(region["endLine"], F.lit(0)), line) - 1).alias("end_line"), F.greatest(F.lit(0), F.coalesce(region["endColumn"], F.lit(1)) - 1).alias("end_char"),
        scalars.snippet(F.coalesce(region["snippet"]["text"], F.lit(""))).alias("snippet"),
    ).filter("path is not null")
    known = rules(runs).withColumnRenamed("rule_id", "rule")
    joined = rows.join(known, ["file", "run", "rule"], "left")
    severity = F.coalesce(scalars.severity_of_text(falsy(F.col("level"))), F.col("rule_severity"), F.col("tag_severity"), F.lit("warning"))
    fid = F.concat(F.lit("F-"), scalars.sha1_parts(F.col("rule"), F.col("path"), F.col("start_line"), F.col("start_char"), n=12))
    return joined.select(fid.alias("finding_id"), "rule", severity.alias("severity"), "path", "start_line", "start_char", "end_line", "end_char", "message", "snippet", "tool")
