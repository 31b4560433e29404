"""Scopes of a workspace from the names of its files, and what their files call for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, scalars

#: Names of the scopes that aren't a role's.
CONFIG, ROOT, WORKSPACE = "scope-config", "scope-root", "scope-workspace"


def kind_of(path: Column) -> Column:
    """struct<kind, group>: a path's role and the folder that has it; config where its suffix is one of configuration and it has no role
    (a config folder is no role: code in it is code), else null."""
    role = scalars.role_of_path(path)
    own = F.when(role["role"] != "config", role["role"])
    config = F.when(scalars.suffix_of(path).isin(*fixed.CONFIG_SUFFIXES), "config")
    return F.struct(F.coalesce(own, config).alias("kind"), F.when(own.isNotNull(), role["group"]).alias("group"))


def scope_id(role: Column, group: Column) -> Column:
    name = F.regexp_replace(F.regexp_replace(F.lower(group), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.concat(F.lit("scope-"), role, F.when(name != "", F.concat(F.lit("-"), name)).otherwise(""))


def discovered(files: DataFrame, path: str, keys: list[str], limit: int = 40) -> DataFrame:
    """keys, scope_id, kind, path (its folder), files (how many), place (from 1) and omitted (scopes beyond the limit, for each row): the scopes
    of each workspace.

    Source files are grouped by role and folder, in their order; then come the configuration files and those that nothing is known
    of, where there are any; a workspace without source files has one scope of no files. `members` has the files themselves, so a
    scope of any size is only counted here."""
    grouped = placed(files, path, keys)
    scopes = grouped.groupBy(*keys, "scope_id", "kind", "path", "turn").agg(F.count("*").alias("files"))
    known = scopes.select(*keys).distinct()
    none = files.select(*keys).distinct().join(known, keys, "left_anti") if keys else None
    if none is not None:
        blank = [F.lit(WORKSPACE).alias("scope_id"), F.lit("entrypoint").alias("kind"), F.lit(".").alias("path"), F.lit(3).alias("turn"), F.lit(0).cast("long").alias("files")]
        scopes = scopes.unionByName(none.select(*keys, *blank))
    ranked = scopes.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("turn", "kind", "path"))).filter(F.col("place") <= limit)
    sizes = scopes.groupBy(*keys).agg(F.greatest(F.count("*") - limit, F.lit(0)).alias("omitted"))
    return ranked.join(sizes, keys).select(*keys, "scope_id", "kind", "path", "files", "place", "omitted")


def placed(files: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """keys, file, scope_id, kind, path and turn (0 a role's scope, 1 configuration, 2 the rest) of source files."""
    told = kind_of(F.col(path))
    own = files.filter(scalars.suffix_of(F.col(path)).isin(*fixed.SOURCE_SUFFIXES)).select(*keys, F.col(path).alias("file"), told.alias("k"))
    role = F.col("k.group").isNotNull()
    config = F.col("k.kind") == "config"
    return own.select(
        *keys, "file", F.when(role, scope_id(F.col("k.kind"), F.col("k.group"))).when(config, CONFIG).otherwise(ROOT).alias("scope_id"),
        F.when(role | config, F.col("k.kind")).otherwise("entrypoint").alias("kind"), F.when(role, F.col("k.group")).otherwise(".").alias("path"), F.when(role, 0).when(config, 1).otherwise(2).alias("turn"),
    )


def members(files: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """keys, scope_id and file of every source file."""
    return placed(files, path, keys).select(*keys, "scope_id", "file")


def skills(files: DataFrame, path: str, keys: list[str], order: str) -> DataFrame:
    """keys and kinds: the distinct kinds of each group's files in the order in which they are first met; empty where no file has one.
    There are a handful of kinds, so only their first places meet in a row."""
    first = files.select(*keys, order, kind_of(F.col(path))["kind"].alias("kind")).groupBy(*keys, "kind").agg(F.min(order).alias("at"))
    each = F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("at", "kind"))))
    return first.groupBy(*keys).agg(F.transform(each, lambda x: x["kind"]).alias("kinds"))
