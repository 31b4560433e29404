"""Digests of trees of files."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streamed_digests(rows: DataFrame, keys: list[str], kinds: int, value: str, order: list[str], between: bytes = b",", after: bytes = b"\0", length: int = 16) -> DataFrame:
    """keys and digest: sha1 over the values of kind 0, then 1 and so on below `kinds`, in order, with `between` between the values
    of a kind and `after` behind each kind (empty ones too).

    rows: keys, kind, value (binary) and the order's columns. A key's rows pass one task as a sorted stream, so memory holds a hash and a
    batch; only the bytes themselves must pass it, as a digest of one sequence asks for."""
    types = dict(rows.dtypes)
    dealt = rows.repartition(*keys) if keys else rows.repartition(1)
    sorted_rows = dealt.sortWithinPartitions(*keys, "kind", *order).select(*keys, "kind", value)
    width = len(keys)
    fields = [*(f"`{k}` {types[k]}" for k in keys), "digest string"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, kind, fresh, kept = None, None, 0, True, None

        def closed() -> tuple:
            state.update(after * (kinds - kind))
            return *now, state.hexdigest()[:length]

        for batch in batches:
            kept, out = batch.schema, []
            for *key, k, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or tuple(key) != now:
                    if state is not None:
                        out.append(closed())
                    now, state, kind, fresh = tuple(key), hashlib.sha1(), 0, True
                if k != kind:
                    state.update(after * (k - kind))
                    kind, fresh = k, True
                if not fresh:
                    state.update(between)
                state.update(v)
                fresh = False
            yield laid(out, kept)
        if state is not None:
            yield laid([closed()], kept)

    def laid(out: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * (width + 1)
        return pa.RecordBatch.from_arrays([*(pa.array(c, schema.field(i).type) for i, c in enumerate(columns[:-1])), pa.array(columns[-1], "string")], [*schema.names[:width], "digest"])

    return sorted_rows.mapInArrow(run, ", ".join(fields))


def workspace_digest(files: DataFrame, length: int = 16) -> DataFrame:
    """digest of one workspace (path, content): sha1 over path NUL bytes NUL of all files by path, as a sorted stream;
    `tree_digests` needs no single stream."""
    nul = F.lit(b"\0")
    rows = files.select(F.lit(0).alias("kind"), "path", F.concat(F.col("path").cast("binary"), nul, F.col("content").cast("binary"), nul).alias("value"))
    empty = files.sparkSession.createDataFrame([(hashlib.sha1(b"").hexdigest()[:length],)], "digest string")
    told = streamed_digests(rows, [], 1, "value", ["path"], b"", b"", length)
    return told.unionByName(empty.join(told.limit(1), F.lit(True), "left_anti"))


def tree_digests(files: DataFrame, tree: str, key: str, content: str, rows: int = 1024, length: int = 16) -> DataFrame:
    """A digest of each tree (key: a number, content: hash of a file): ranges of keys are digested apart and a tree is the digest of its
    ranges' digests, so no tree's files meet in one task."""

    def digest(order: str, own: str) -> F.Column:
        each = F.array_sort(F.collect_list(F.struct(order, own)))
        return F.sha1(F.array_join(F.transform(each, lambda x: F.concat(x[order].cast("string"), F.lit("\0"), x[own], F.lit("\0"))), ""))

    ranges = files.groupBy(tree, F.floor(F.col(key) / rows).alias("__range")).agg(digest(key, content).alias("__h"))
    return ranges.groupBy(tree).agg(F.substring(digest("__range", "__h"), 1, length).alias("digest"))
