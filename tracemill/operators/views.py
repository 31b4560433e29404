"""Projections and predicates of the screens: rows as a reader sees them. All are maps and filters; joins only meet small sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, scalars


def place(path: Column, start: Column, end: Column | None = None) -> Column:
    """path:line, or path:first-last, of 0-based lines as a reader counts them."""
    shown = F.concat(path, F.lit(":"), (start + 1).cast("string"))
    return shown if end is None else F.concat(shown, F.lit("-"), (end + 1).cast("string"))


def method_rows(methods: DataFrame) -> DataFrame:
    """`methods` (method_id, path, start, end, provider ...) with shown (the place) and the trust and confidence of their provider."""
    return methods.withColumn("shown", place(F.col("path"), F.col("start"), F.col("end"))).withColumn("trust", scalars.trust(F.col("provider"))).withColumn("confidence", scalars.confidence(F.col("provider")))


def scan_summaries(scans: DataFrame) -> DataFrame:
    """`scans` (command: array) with command_line; a bundle without a scan stays null."""
    return scans.withColumn("command_line", F.when(F.col("command").isNotNull(), F.array_join("command", " ")))


def dialogue(events: DataFrame) -> DataFrame:
    """Steps of agents with failure_kind: told by how the thought begins, else by the error's words, else an error is the tool's.

    events: seq, kind, agent, scope, thought, tool, arguments (map or text), ok, summary, error."""
    steps = events.filter(F.col("kind") == "agent_step").drop("kind")
    kind = F.when(F.lit(False), "")
    for begin, name in fixed.THOUGHT_FAILURES.items():
        kind = kind.when(F.startswith("thought", F.lit(begin)), name)
    kind = kind.when(F.col("error").rlike(fixed.ARGUMENT_FAILURE), "tool_arguments").when(F.coalesce("error", F.lit("")) != "", "tool_execution")
    return steps.withColumns({c: F.coalesce(c, F.lit("")) for c in ("agent", "scope", "thought", "summary")}).withColumn("failure_kind", kind)


def dialogue_filter(rows: DataFrame, agent: str = "", needle: str = "", problems: bool = False) -> DataFrame:
    """The rows that all filters keep, with total, the number before filtering. The needle is looked for in all texts, case aside."""
    kept = rows
    if agent:
        kept = kept.filter(F.col("agent") == agent)
    if problems:
        kept = kept.filter(F.col("error").isNotNull() | ~F.coalesce("ok", F.lit(True)))
    if needle.strip():
        arguments = F.col("arguments") if dict(rows.dtypes)["arguments"] == "string" else F.to_json("arguments")
        texts = F.lower(F.concat_ws(" ", "agent", "scope", F.coalesce("tool", F.lit("")), "thought", "summary", F.coalesce("error", F.lit("")), F.coalesce(arguments, F.lit("{}"))))
        kept = kept.filter(F.contains(texts, F.lit(needle.strip().lower())))
    return kept.crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))  # the total is one row


def finding_rows(events: DataFrame, kind: str, defaults: dict[str, object]) -> DataFrame:
    """Events of one kind; what they lack has its default."""
    return events.filter(F.col("kind") == kind).withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def tainted(kind: Column, classes: list[str]) -> Column:
    """Whether a vulnerability class is one that taint explains: any of `classes` in it, spaces and dashes as underscores."""
    return F.exists(F.array(*map(F.lit, classes)), lambda c: F.contains(F.lower(F.translate(kind, " -", "__")), c))


def derived_severity(reachable: Column, guarded: Column, weak: Column) -> Column:
    """low if no path reaches it, medium if a login or a long way guards it or its class is weak, else high."""
    return F.when(~F.coalesce(reachable, F.lit(False)), "low").when(F.coalesce(guarded, F.lit(False)) | F.coalesce(weak, F.lit(False)), "medium").otherwise("high")


def named(df: DataFrame, name: str) -> DataFrame:
    """Without synthetic names, which hold <."""
    return df.filter(~F.contains(name, F.lit("<")))


def task_evidence(events: DataFrame, members: DataFrame, key: str, *also: Column) -> DataFrame:
    """Events whose `key` is among the task's members, and those that any of the other rules of their kind keeps."""
    own = members.select(F.col(key).alias("__own")).distinct()
    other = F.lit(False)
    for rule in also:
        other = other | F.coalesce(rule, F.lit(False))
    told = events.join(own, events[key] == F.col("__own"), "left")
    return told.filter(F.col("__own").isNotNull() | other).drop("__own")


def language_depth(language: Column, graph: list[str] | None, taint: list[str] | None) -> Column:
    """full with a call graph and taint, call_graph with the graph alone, else findings_only; unknown capabilities count as full."""
    if graph is None or taint is None:
        return F.lit("full")
    return F.when(language.isin(*graph) & language.isin(*taint), "full").when(language.isin(*graph), "call_graph").otherwise("findings_only")


#: States of a job.
ACTIVE, TERMINAL = ("queued", "running"), ("succeeded", "failed", "canceled")


def active(state: Column, states: tuple[str, ...] = ACTIVE) -> Column:
    return state.isin(*states)


def terminal(state: Column, states: tuple[str, ...] = TERMINAL) -> Column:
    return state.isin(*states)


def job_rows(jobs: DataFrame, states: str = "state", active_states: tuple[str, ...] = ACTIVE, terminal_states: tuple[str, ...] = TERMINAL) -> DataFrame:
    """`jobs` with active and terminal."""
    return jobs.withColumn("active", active(F.col(states), active_states)).withColumn("terminal", terminal(F.col(states), terminal_states))


# --- prompt blocks: bundle, block_id, kind, context, rank, in_prefix, text -----------------------------------------
def selected_blocks(blocks: DataFrame, context: Column) -> DataFrame:
    """Blocks outside the prefix that belong to no context or to the named one."""
    return blocks.filter(~F.col("in_prefix") & ((F.col("kind") != "context") | (F.col("context") == context)))


def rendered(blocks: DataFrame, by: str, *order: str, text: str = "text", between: str = "\n") -> DataFrame:
    """One text a group: its blocks in order. A group is a bundle or a conversation, so its blocks fit a task."""
    each = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("__text"))))
    return blocks.groupBy(by).agg(F.array_join(F.transform(each, lambda b: b["__text"]), between).alias("prompt"))


def prefix_text(blocks: DataFrame, by: str, *order: str) -> DataFrame:
    """The prefix blocks of each group as one text."""
    return rendered(blocks.filter("in_prefix"), by, *order)


def block_order(rank: dict[str, int]) -> Column:
    """The static rank of a block's kind; unknown kinds come last."""
    return F.coalesce(scalars.lookup(F.col("kind"), rank), F.lit(max(rank.values(), default=0) + 1))


# --- usage and answers ------------------------------------------------------------------------------------------
def normalised_usage(usage: Column, names: tuple[tuple[str, ...], ...] = (("prompt_tokens",), ("completion_tokens",), ("prompt_tokens_details.cached_tokens", "prompt_cache_hit_tokens"))) -> list[Column]:
    """Prompt, completion and cached tokens of a provider's usage (JSON text): each under the first of its names that is there. What is
    not reported is null, never 0."""
    return [F.coalesce(*[F.get_json_object(usage, f"$.{n}").cast("int") for n in own]).alias(own[0].split(".")[-1]) for own in names]


def positive_line(value: Column) -> Column:
    """A line number as given if it is above 0, else null."""
    number = value.try_cast("int")
    return F.when(number > 0, number)


def as_list(value: Column) -> Column:
    """A JSON value as an array of texts: arrays as they are, null and empty texts as none, everything else alone."""
    whole = F.from_json(value, "array<string>")
    return F.when(value.isNull() | (F.trim(value) == ""), F.array().cast("array<string>")).when(F.startswith(F.ltrim(value), F.lit("[")), F.coalesce(whole, F.array().cast("array<string>"))).otherwise(F.array(F.trim(value, F.lit('"'))))


def repaired_container(value: Column, is_map: Column) -> Column:
    """An empty container (JSON text) as its field's kind: {} for maps and [] for lists; others as they are."""
    return F.when(value.isin("[]", "{}"), F.when(is_map, "{}").otherwise("[]")).otherwise(value)


def entry_marker(text: Column, markers: list[tuple[str, str]], default: str | None = None) -> Column:
    """The name of the first marker (text, name) that a file has."""
    return scalars.first_rule(text, markers, default)


def summarised(jobs: DataFrame, fields: dict[str, str], flags: dict[str, Column], filled: dict[str, tuple[str, str]]) -> DataFrame:
    """Flat rows of nested jobs: fields by their path (null where a part of it is), flags that are false where they can't be told, and texts
    with a word for none."""
    return jobs.select(*[F.col(path).alias(name) for name, path in fields.items()], *[F.coalesce(flag, F.lit(False)).alias(name) for name, flag in flags.items()], *[F.coalesce(F.when(F.col(path) != "", F.col(path)), F.lit(none)).alias(name) for name, (path, none) in filled.items()])
