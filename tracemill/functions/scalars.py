"""Scalar column functions. All are built-in expressions and stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

NUL = "\0"


def lookup(value: Column, table: dict) -> Column:
    """Value of a small literal dimension, null where it has no such key."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), value) if table else F.lit(None)


def nonempty(value: Column) -> Column:
    return F.when(value != "", value)


def sha1_parts(*parts: Column, n: int = 16) -> Column:
    """sha1 over the parts, each followed by a NUL; the first n hex digits."""
    return F.substring(F.sha1(F.concat(*[x for p in parts for x in (F.coalesce(p.cast("string"), F.lit("")), F.lit(NUL))])), 1, n)


def content_hash(text: Column) -> Column:
    return F.substring(F.sha1(text), 1, 20)


def estimate_tokens(text: Column) -> Column:
    """0 for no text, else the whole part of 0.9 a CJK character and 0.25 any other, and 1."""
    cjk = F.regexp_count(text, F.lit(r"[\x{2e80}-\x{9fff}\x{ac00}-\x{d7af}]"))
    return F.when(F.length(text) > 0, F.floor(cjk * F.lit(0.9) + (F.length(text) - cjk) / F.lit(4.0)).cast("long") + 1).otherwise(F.lit(0).cast("long"))


def estimate_byte_tokens(text: Column) -> Column:
    return F.ceil(F.octet_length(text) / F.lit(2.0)).cast("long")


def snippet(text: Column, n: int = 160) -> Column:
    """White space runs as single spaces, trimmed, cut to n characters."""
    return F.substring(F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x0b]+", " ")), 1, n)


def clip(text: Column, n: int, mark: str = "…") -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - len(mark)), F.lit(mark))).otherwise(text)


def clamp_text(text: Column, chars: int, lines: int) -> Column:
    """struct<text, cut_chars, cut_lines>: at most so many lines, then at most so many characters."""
    rows = F.split(text, "\n")
    short = F.when(F.size(rows) > lines, F.array_join(F.slice(rows, 1, lines), "\n")).otherwise(text)
    return F.struct(F.substring(short, 1, chars).alias("text"), (F.length(short) > chars).alias("cut_chars"), (F.size(rows) > lines).alias("cut_lines"))


def trim_line_ends(text: Column) -> Column:
    return F.regexp_replace(text, r"(?m)[ \t]+$", "")


def canonical_body(text: Column) -> Column:
    """Without trailing white space, then one newline; empty stays empty."""
    bare = F.regexp_replace(text, r"[ \t\n\r\f\x0b]+$", "")
    return F.when(bare != "", F.concat(bare, F.lit("\n"))).otherwise("")


def line_slice(text: Column, start: Column, end: Column) -> Column:
    """Lines start to end (0-based, inclusive, clamped); '' when inverted, null when end is missing."""
    rows = F.split(text, "\n")
    last = F.least(end, F.size(rows) - 1)
    first = F.greatest(start, F.lit(0))
    return F.when(end.isNull(), F.lit(None).cast("string")).when(last < first, "").otherwise(F.array_join(F.slice(rows, first + 1, F.greatest(last - first + 1, F.lit(0))), "\n"))


def slug(text: Column, mark: str = "_") -> Column:
    squeezed = F.regexp_replace(F.lower(F.trim(text)), r"[^\p{L}\p{N}]+", mark)
    return F.regexp_replace(squeezed, f"^{mark}+|{mark}+$", "")


def vulnerability_type(raw: Column) -> Column:
    """A name of the closed vocabulary: the slug itself, the first phrase that occurs, else the slug; blank is other."""
    text = F.coalesce(raw, F.lit(""))
    own = slug(text)
    lowered = F.regexp_replace(F.lower(F.trim(text)), "[-_]", " ")
    chain = F.when(F.trim(text) == "", "other").when(own.isin(*fixed.VULNERABILITY_TYPES), own)
    for phrase, name in fixed.TYPE_OF_PHRASE:
        chain = chain.when(F.contains(lowered, F.lit(phrase)), name)
    return chain.otherwise(F.when(own != "", own).otherwise("other"))


def severity_of_text(text: Column) -> Column:
    """The four-level severity of a word; null for unknown or empty."""
    return lookup(F.lower(F.trim(text)), fixed.SEVERITY_OF_TEXT)


def severity_of_number(number: Column) -> Column:
    """1 and 2 are warning and error; 0 counts as absent."""
    return F.when(number != 0, lookup(number.cast("int"), fixed.SEVERITY_OF_NUMBER))


def severity_rank(severity: Column, default: int = 4) -> Column:
    return F.coalesce(lookup(severity, fixed.SEVERITY_RANK), F.lit(default))


def trust(provider: Column) -> Column:
    return F.coalesce(lookup(provider, fixed.TRUST_OF_PROVIDER), F.lit("unknown"))


def confidence(provider: Column, given: Column | None = None) -> Column:
    known = F.coalesce(lookup(provider, fixed.CONFIDENCE_OF_PROVIDER), F.lit(fixed.DEFAULT_CONFIDENCE))
    return known if given is None else F.coalesce(given, known)


def words(text: Column) -> Column:
    """camelCase and punctuation boundaries, lower-cased, without empties."""
    return F.filter(F.split(F.lower(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")), "[^a-z0-9]+"), lambda w: w != "")


def role_of_path(path: Column) -> Column:
    """struct<role, group>: the deepest directory with a role after the first matching source root, else the first role word
    of the file's stem with the file's directory."""
    posix = F.replace(path, F.lit("\\"), F.lit("/"))
    lowered = F.lower(posix)
    relative = F.lit(None).cast("string")
    for root in reversed(fixed.SOURCE_ROOTS):
        relative = F.when(F.startswith(lowered, F.lit(root)), F.substring(lowered, len(root) + 1, 1 << 20)).otherwise(relative)
    parts = F.split(F.coalesce(relative, lowered), "/")
    depth = F.size(parts) - 1
    places = F.filter(F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>")), lambda i: lookup(F.element_at(parts, i), fixed.ROLE_OF_DIRECTORY).isNotNull())
    at = F.when(F.size(places) > 0, F.element_at(places, -1))
    stem = F.regexp_replace(F.element_at(F.split(posix, "/"), -1), r"\.[^.]*$", "")
    marks = F.filter(F.transform(words(F.lower(stem)), lambda w: lookup(w, fixed.ROLE_OF_WORD)), lambda r: r.isNotNull())
    parent = F.when(F.contains(posix, F.lit("/")), F.regexp_replace(posix, "/[^/]*$", "")).otherwise(".")
    by_directory = F.struct(lookup(F.element_at(parts, at), fixed.ROLE_OF_DIRECTORY).alias("role"), F.array_join(F.slice(parts, 1, at), "/").alias("group"))
    by_word = F.struct(F.element_at(marks, 1).alias("role"), parent.alias("group"))
    none = F.struct(F.lit(None).cast("string").alias("role"), F.lit("").alias("group"))
    return F.when(at.isNotNull(), by_directory).when(F.size(marks) > 0, by_word).otherwise(none)


def verdict_confidence(number: Column, text: Column) -> Column:
    """A number is clamped to 0..1; the first number of a text from over 1 to 100 is a percentage."""
    found = nonempty(F.regexp_extract(text, r"-?[0-9]+(\.[0-9]+)?", 0)).cast("double")
    of_text = F.when((found > 1) & (found <= 100), found / 100).otherwise(found)
    value = F.coalesce(number, of_text)
    return F.when(value.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)))


def harness_confidence(number: Column, text: Column) -> Column:
    """Unreadable is 0; numbers and texts from over 1 to 100 are percentages; a text must be a number as a whole."""
    value = F.coalesce(number, F.when(F.trim(text).rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$"), F.trim(text)).cast("double"), F.lit(0.0))
    value = F.when((value > 1) & (value <= 100), value / 100).otherwise(value)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))


def leading_severity(text: Column) -> Column:
    """struct<level, rest>: the severity name that starts the text and ends at a boundary, and what follows."""
    pattern = rf"^({'|'.join(fixed.FINDING_SEVERITIES)})([^\p{{L}}\p{{N}}].*)?$"
    bare = F.lower(F.trim(text))
    return F.struct(nonempty(F.regexp_extract(bare, pattern, 1)).alias("level"), F.trim(F.regexp_extract(bare, pattern, 2)).alias("rest"))


def json_object(text: Column) -> Column:
    """The object of a fenced block, else what stands from the first { to the last }."""
    fenced = nonempty(F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1))
    return F.coalesce(fenced, nonempty(F.regexp_extract(text, r"(?s)(\{.*\})", 1)))


def sorted_json(pairs: Column) -> Column:
    """Compact JSON of a flat map with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(pairs))))


def seconds_since(then: Column, now: Column) -> Column:
    """Infinite where `then` is null."""
    return F.coalesce((F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))) / F.lit(1e6), F.lit(float("inf")))


def duration_label(ms: Column) -> Column:
    """ms, seconds to a tenth, or minutes and seconds; a dash for null and NaN. Halves of the decimal value round up."""
    exact = F.when(~F.isnan(ms.cast("double")), ms.cast("decimal(24,6)"))
    whole = F.round(exact).cast("long")
    seconds = F.round(exact / F.lit(1000).cast("decimal(4,0)"), 1).cast("decimal(24,1)").cast("string")
    return F.when(exact.isNull(), "-").when(exact < 1000, F.concat(whole.cast("string"), F.lit(" ms"))).when(exact < 60_000, F.concat(seconds, F.lit(" s"))).otherwise(
        F.concat((whole / 60_000).cast("long").cast("string"), F.lit(" m "), F.floor(F.pmod(whole, F.lit(60_000)) / 1000).cast("string"), F.lit(" s")))


def percent_label(part: Column, whole: Column) -> Column:
    return F.coalesce(F.concat(F.round(F.try_divide(part.cast("double"), whole.cast("double")) * 100).cast("long").cast("string"), F.lit("%")), F.lit("-"))


def suffix_of(path: Column) -> Column:
    return nonempty(F.regexp_extract(F.lower(path), r"(\.[a-z0-9]+)$", 1))


def parameters(line: Column) -> Column:
    """Names between the brackets of a def line, without self, cls, stars and defaults; annotations stay."""
    inside = F.regexp_extract(line, r"def\s+\w+\s*\(([^)]*)\)", 1)
    each = F.transform(F.split(inside, ","), lambda p: F.trim(F.regexp_replace(F.trim(F.element_at(F.split(p, "="), 1)), r"^\*+", "")))
    return F.filter(each, lambda p: (p != "") & ~p.isin("self", "cls"))


def file_mentions(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"([\w./-]+\.(?:py|java|go|js|ts|kt|rb|php|c|h))"), F.lit(1)))


def first_rule(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The message of the first rule whose phrase occurs."""
    chain = F.when(F.lit(False), "")
    for phrase, message in rules:
        chain = chain.when(F.contains(F.lower(text), F.lit(phrase)), message)
    return chain.otherwise(default)


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def clean_path(path: Column) -> Column:
    """A path without scheme and with forward slashes; null if it leaves its root."""
    bare = F.regexp_replace(F.replace(F.regexp_replace(path, "^file://", ""), F.lit("\\"), F.lit("/")), "^[A-Za-z]:", "")
    return F.when(~F.concat(F.lit("/"), bare, F.lit("/")).contains("/../"), bare)


def bounded(items: Column, n: int) -> Column:
    """struct<items, omitted>: the first n and how many more there are."""
    return F.struct(F.slice(items, 1, n).alias("items"), F.greatest(F.size(items) - n, F.lit(0)).alias("omitted"))


def dataflow_outcome(sink: Column, sources: Column, answered: Column, flows: Column) -> Column:
    """What an engine's answer says about a claim: without a sink or candidates of sources nothing was asked (error), without an answer
    the claim goes on by other means (fallback), else a flow was found or not."""
    return F.when(~F.coalesce(sink, F.lit(False)) | (F.coalesce(sources, F.lit(0)) == 0), "error").when(~F.coalesce(answered, F.lit(False)), "fallback").when(F.coalesce(flows, F.lit(0)) == 0, "no_path").otherwise("flow")


def windowed(text: Column, offset: Column, limit: Column) -> Column:
    """struct<lines, total, next_offset>: `limit` lines from `offset` (from 1), how many there are, and where to go on (null at the end)."""
    rows = F.split(text, "\n")
    last = F.greatest(offset, F.lit(1)) - 1 + F.greatest(limit, F.lit(0))
    kept = F.slice(rows, F.greatest(offset, F.lit(1)), F.greatest(limit, F.lit(0)))
    return F.struct(kept.alias("lines"), F.size(rows).alias("total"), F.when(last < F.size(rows), last + 1).alias("next_offset"))
