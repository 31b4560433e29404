from __future__ import annotations

import random

#: Rows that every operator must take: nulls, empty and very long texts, ties, repeated rows and clashing extra columns.
EDGE = [
    (1, "The quick brown fox jumps over the lazy dog and runs away", "en", "a", 10), (2, "The quick brown fox jumps over the lazy dog and runs away", "en", "a", 10),
    (3, None, None, None, None), (4, "", "de", "b", 0), (5, "  \n\t ", "de", "b", 4), (6, "word " * 30000, "en", None, 1), (7, "x" * 50000, "fr", "c", 1),
    (8, "É\u0301ﬁ½ straße İ ΣΑΣ 日本語 \u00a0 \u2003 emoji 😀 \x00 end", "fr", "c", 1), (9, "don't <|endoftext|> 12,345.67 </s> mail me@x.org +1 (555) 123-4567", "en", "a", 1),
    (9, "don't <|endoftext|> 12,345.67 </s> mail me@x.org +1 (555) 123-4567", "en", "a", 1), (None, "no id here", "en", "z", 3), (10, "the QUICK brown  fox jumps over the lazy dog and runs away", "en", "a", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def edge(spark):
    """EDGE with extra columns whose names operators use inside."""
    df = spark.createDataFrame(EDGE, SCHEMA)
    for name in ("fp", "size", "score", "n_tokens", "shard", "range", "kind", "words", "component_id", "ids"):
        df = df.selectExpr("*", f"'x' as {name}")
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def prose(n: int, seed: int = 1) -> list[str]:
    rng = random.Random(seed)
    syllables = "the ing er on an re tion and es or th he in ed it is of un lo ka mi".split()
    return [" ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(rng.randint(5, 60))) for _ in range(n)]


def key(r):
    return (r is None, r)
