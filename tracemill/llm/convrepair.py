"""Repair of conversation structure by deduplicated signatures.

The roles and faults of a conversation's rows are encoded as a string of one character a row. Each distinct string is solved once:
cost matrices over the states of the wanted pattern are memoised for the halves of a string, halves of halves and so on, and
the cheapest edits (the ASCII-least of equals) are read off by the same recursion. Audits are joined back by the string, and
the edits replayed over the texts.

Roles must read `(s?(ua)+)?` by their initials. Keep costs 0, Rerole (to user or assistant) 3, Delete 4, Insert (an empty user
or assistant text) 3; a truncated row that stays costs 3 more. Blank and duplicate rows must be deleted.

Rows are ordered by turn (nulls first), rows of equal turn by role and then by a digest of role and text, so ties and
repeated rows have a defined order. Null roles and texts are one space. Rows of a null conv_id are a conversation. Extra
columns are ignored. An empty table gives no rows; a conversation without rows has an empty audit.

A conversation may hold any share of the rows: signatures are encoded by ranges of (conversation, turn), whose pieces are put
together (a byte a row, as in the audit), and equal rows are counted before the shuffle. Only the replay streams a conversation's
texts through one task, in order and a row at a time, as their digest needs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SPACES = " \t\n\x0b\x0c\r"
#: A character a row: the initial (s, u, a, other) of a row that is well, truncated, blank or a duplicate.
SYMBOLS = "suaoSUAO01234567"
NEVER = 1 << 40
#: States of the pattern: nothing yet, after s, after u, after a. What each edit leads to, and the cost of ending (by inserts).
INSERT = {0: 2, 1: 2, 2: 3, 3: 2}
KEEP = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
ENDS, TAILS = (0, 6, 3, 0), ("", "II", "I", "")
PIECE = 1 << 16


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies of the rows after damage by crc32(`conv_id:turn`) % 20: 0 drops the row, 1 empties its text,
    2 removes `.`, `!` and `?`, 3 makes two of it, 4 makes its role user. Nulls are one space, in the hash too."""
    names = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    kind = F.crc32(F.concat(names[0], F.lit(":"), names[1]).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(names[3], ".!?", "")).otherwise(names[3])
    return rows.filter(kind != 0).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(names[2]).alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("copies"))


def digest() -> Column:
    """Of conversation, role and text."""
    return F.unhex(F.sha2(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.length("role").cast("string"), "role", "text").cast("binary"), 256))


def symbols(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest and code of the distinct rows of conversations; code has a character for each copy."""
    last = F.right(F.rtrim(F.col("text"), F.lit(SPACES)), F.lit(1))
    known = rows.select("conv_id", "turn", "role", digest().alias("digest"), (last == "").alias("blank"), (~last.isin("", ".", "!", "?")).alias("cut"), "copies")
    known = common.written(known.groupBy("conv_id", "turn", "role", "digest").agg(F.any_value("blank").alias("blank"), F.any_value("cut").alias("cut"), F.sum("copies").alias("copies")), "turns")
    first = known.groupBy("digest").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    known = common.salted_join(known, first, ["digest"], "n", known.count(), how="left", spread=("turn",))
    begin = F.substring("role", 1, 1)
    initial = F.when(begin == "s", 0).when(begin == "u", 1).when(begin == "a", 2).otherwise(3)
    again = F.coalesce(F.struct("turn") > F.col("first"), F.lit(False))

    def symbol(fault: Column) -> Column:
        return F.substring(F.lit(SYMBOLS), fault * 4 + initial + 1, F.lit(1))

    further = symbol(F.when(F.col("blank"), 2).otherwise(3))
    code = F.concat(symbol(F.when(F.col("blank"), 2).when(again, 3).when(F.col("cut"), 1).otherwise(0)), F.repeat(further, (F.col("copies") - 1).cast("int")))
    return known.select("conv_id", "turn", "role", "digest", code.alias("code"))


def signatures(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """conv_id, gaps and signature of each conversation of `conversations`, from its damaged `rows`."""
    order = ["conv_id", "turn", "role", "digest"]
    coded = symbols(rows)
    parts = coded.sparkSession.conf.get("spark.sql.shuffle.partitions")
    coded = coded.repartitionByRange(int(parts), *order).sortWithinPartitions(*order).select("conv_id", "turn", "code")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, made, held = TaskContext.get().partitionId(), 0, [], None
        for batch in batches:
            for conv, turn, code in zip(*(batch[c].to_pylist() for c in ("conv_id", "turn", "code")), strict=True):
                if held is None or held[0] != conv or held[5] >= PIECE:
                    if held is not None:
                        made.append((held[0], part, n, held[1], held[2], held[3], "".join(held[4])))
                        n += 1
                    held = [conv, None, None, 0, [], 0]
                if turn is not None and turn != held[2]:
                    held[1], held[2], held[3] = turn if held[1] is None else held[1], turn, held[3] + 1
                held[4].append(code)
                held[5] += len(code)
            if made:
                yield laid(made)
                made = []
        if held is not None:
            yield laid([(held[0], part, n, held[1], held[2], held[3], "".join(held[4]))])

    def laid(made: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), ("int64", "int32", "int32", "int64", "int64", "int64", "string"), strict=True)], ["conv_id", "part", "n", "lo", "hi", "turns", "code"])

    found = coded.mapInArrow(pieces, "conv_id long, part int, n int, lo long, hi long, turns long, code string")
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()  # those without rows too
    found = found.unionByName(every, allowMissingColumns=True)
    found = found.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("part", "n", "lo", "hi", "turns", "code")))).alias("p"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("turns").alias("turns"))
    # a turn that goes on in the next piece was counted in both
    shared = F.expr("aggregate(transform(p, (x, i) -> if(i > 0 and x.lo <=> p[i - 1].hi and x.lo is not null, 1L, 0L)), 0L, (a, x) -> a + x)")
    gaps = F.coalesce(F.col("hi") - F.col("lo") + 1 - (F.col("turns") - shared), F.lit(0).cast("long"))
    return found.select("conv_id", gaps.alias("gaps"), F.array_join(F.transform("p", lambda x: x["code"]), "").alias("signature"))


@lru_cache(None)
def choices(symbol: str, state: int) -> tuple[tuple[str, int, int], ...]:
    """Edits that deal with one row from a state, inserts before it included, in ASCII order: edits, state after, cost."""
    fault, initial = divmod(SYMBOLS.index(symbol), 4)
    found, inserts, cost = [], "", 0
    for _ in range(3):
        found.append((inserts + "D", state, cost + 4))
        if fault < 2:
            stays = KEEP.get(("suao"[initial], state))
            if stays is not None:
                found.append((inserts + "K", stays, cost + 3 * fault))
            found.append((inserts + "R", INSERT[state], cost + 3 + 3 * fault))
        inserts, state, cost = inserts + "I", INSERT[state], cost + 3
    return tuple(sorted(found))


class Solver:
    """Audits of signatures. Tables of the strings met are forgotten when they hold `most` of them."""

    def __init__(self, most: int = 200_000):
        self.costs: dict[str, tuple] = {}
        self.found: dict[tuple, tuple] = {}
        self.most = most

    def matrix(self, s: str) -> tuple[tuple[int, ...], ...]:
        """Least cost from state to state over the rows of `s`."""
        got = self.costs.get(s)
        if got is None:
            if len(s) == 1:
                got = tuple(tuple(min([c for _, to, c in choices(s, q) if to == r], default=NEVER) for r in range(4)) for q in range(4))
            else:
                cut = halfway(s)
                left, right = self.matrix(s[:cut]), self.matrix(s[cut:])
                got = tuple(tuple(min(row[k] + right[k][r] for k in range(4)) for r in range(4)) for row in left)
            if len(s) <= PIECE:
                if len(self.costs) >= self.most:
                    self.costs.clear()
                self.costs[s] = got
        return got

    def edits(self, s: str, state: int, ahead: tuple[int, ...]) -> tuple[str, int, int]:
        """The best edits of `s` from `state`, where going on from each state costs `ahead`; the state after; their own cost."""
        key = (s, state, ahead)
        got = self.found.get(key)
        if got is None:
            if len(s) == 1:
                best = min(c + ahead[to] for _, to, c in choices(s, state))
                got = next((e, to, c) for e, to, c in choices(s, state) if c + ahead[to] == best)
            else:
                cut = halfway(s)
                right = self.matrix(s[cut:])
                between = tuple(min(c + a for c, a in zip(row, ahead, strict=True)) for row in right)
                first, at, cost = self.edits(s[:cut], state, level(between))
                rest, to, more = self.edits(s[cut:], at, ahead)
                got = first + rest, to, cost + more
            if len(s) <= PIECE:
                if len(self.found) >= self.most:
                    self.found.clear()
                self.found[key] = got
        return got

    def solve(self, s: str) -> tuple[int, int, int, int, int, str]:
        """blank, duplicate, truncated, illegal, cost and audit of a signature."""
        faults = [sum(map(s.count, SYMBOLS[4 * f : 4 * f + 4])) for f in (2, 3, 1)]
        initials = s.translate(INITIALS)
        illegal = max(0, len(s) - 1) - initials.count("su") - initials.count("ua") - initials.count("au")
        edits, state, cost = self.edits(s, 0, ENDS) if s else ("", 0, 0)
        return *faults, illegal, cost + ENDS[state], edits + TAILS[state]


INITIALS = str.maketrans({c: "suao"[i % 4] for i, c in enumerate(SYMBOLS)})


def halfway(s: str) -> int:
    """The greatest power of two below the length, so that equal beginnings share their halves."""
    return 1 << (len(s) - 1).bit_length() - 1


def level(costs: tuple[int, ...]) -> tuple[int, ...]:
    least = min(costs)
    return tuple(c - least for c in costs)


def solved(signed: DataFrame) -> DataFrame:
    """`signed` with blank, duplicate, truncated, illegal, cost and audit, each distinct signature solved once."""
    distinct = signed.groupBy("signature").agg(F.count("*").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solver = Solver()
        for batch in batches:
            for part in common.slices(batch, "signature", 1 << 20):
                out = [solver.solve(s) for s in part["signature"].to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c, "string" if i == 5 else "int64") for i, c in enumerate(zip(*out, strict=True)))], [*part.schema.names, "blank", "duplicate", "truncated", "illegal", "cost", "audit"])

    answers = common.written(distinct.mapInArrow(run, "signature string, n long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"), "signatures")
    return common.salted_join(signed, answers, ["signature"], "n", signed.count(), spread=("conv_id",))


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """conv_id, edit, role and text of the rows that stay or are inserted when `audits` are replayed over damaged `rows`; in a
    partition conversations follow each other, each in its order."""
    plans = audits.select("conv_id", F.lit(0).alias("kind"), F.col("audit").alias("text"))
    own = rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", digest().alias("digest"), "text", "copies")
    every = plans.unionByName(own, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, at, state = None, "", 0, 0

        def inserts() -> Iterator[tuple]:
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                at, state = at + 1, INSERT[state]
                yield conv, "I", "user" if state == 2 else "assistant", ""

        for batch in batches:
            for part in common.slices(batch, "text", 4 << 20):
                out: list[tuple] = []
                for key, kind, role, text, copies in zip(*(part[c].to_pylist() for c in ("conv_id", "kind", "role", "text", "copies")), strict=True):
                    if kind == 0:
                        out.extend(inserts())
                        conv, audit, at, state = key, text, 0, 0
                        continue
                    for _ in range(copies):
                        out.extend(inserts())
                        edit, at = audit[at], at + 1
                        if edit == "K":
                            state = KEEP[role[:1], state]
                            out.append((conv, "K", role, text))
                        elif edit == "R":
                            state = INSERT[state]
                            out.append((conv, "R", "user" if state == 2 else "assistant", text))
                if out:
                    yield laid(out)
        out = list(inserts())
        if out:
            yield laid(out)

    def laid(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), ("int64", "string", "string", "string"), strict=True)], ["conv_id", "edit", "role", "text"])

    return every.select("conv_id", "kind", "role", "text", "copies").mapInArrow(run, "conv_id long, edit string, role string, text string")


def digested(stayed: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256 (of `role:text`, joined by newlines) of conversations whose rows follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, began = None, None, False
        for batch in batches:
            out = []
            for key, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if not began or key != conv:
                    if began:
                        out.append((conv, state.hexdigest()))
                    conv, state, began = key, hashlib.sha256(), True
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            if out:
                yield laid(out)
        if began:
            yield laid([(conv, state.hexdigest())])

    def laid(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), ("int64", "string"), strict=True)], ["conv_id", "repaired_sha256"])

    return stayed.mapInArrow(run, "conv_id long, repaired_sha256 string")


def audited(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """The columns of `signatures` and `solved`, and repaired_sha256, of every conversation of `conversations`; `rows` are what is left
    of them (conv_id, turn, role, text, copies)."""
    audits = common.written(solved(common.written(signatures(rows, conversations), "signed")), "audits")
    digests = digested(repaired(rows, audits)).withColumnRenamed("conv_id", "__conv")
    whole = audits.join(digests, F.col("conv_id").eqNullSafe(F.col("__conv")), "left").drop("__conv")
    return whole.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())))
