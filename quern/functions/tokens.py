"""Word tokens, their code-point offsets, and n-grams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.word_breaks import standard_tokens, standard_words

#: "simple": runs of letters, digits and underscores. "standard": Unicode's word boundaries (word_breaks); its pattern here
#: does the same for scripts with spaces alone: letters around ' and ., digits around . and ,.
PATTERNS = {
    "simple": r"[\p{L}\p{N}_]+",
    "standard": r"[\p{L}\p{M}\p{N}_]+(?:(?:(?<=\p{L})['’.:·](?=\p{L})|(?<=\p{N})[.,'](?=\p{N}))[\p{L}\p{M}\p{N}_]+)*",
}


def words(text: Column, mode: str = "simple") -> Column:
    """The tokens as they stand in the text."""
    if mode == "standard":
        return standard_words(text, lower=False)
    return F.regexp_extract_all(text, F.lit(PATTERNS[mode]), F.lit(0))


def tokens(text: Column, mode: str = "simple") -> Column:
    """Lower-case tokens."""
    if mode == "standard":
        return standard_words(text)
    return F.transform(words(text, mode), F.lower)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once for a row: within a lambda a plain expression is computed at every call."""
    return F.element_at(F.transform(F.array(value), then), 1)


def ngrams(token_array: Column, n: int, least: int | None = None) -> Column:
    """Space-joined n-grams in order. Fewer than n but at least `least` tokens make one shorter gram; others none."""
    least = n if least is None else max(1, least)

    def of(words: Column) -> Column:
        size = F.size(words)
        grams = F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))
        none = F.array().cast("array<string>")
        return F.when(size >= n, grams).otherwise(F.when(size >= least, F.array(F.array_join(words, " "))).otherwise(none))

    return let(token_array, of)


def token_offsets(docs: DataFrame, key: str = "doc_id", text: str = "text", mode: str = "simple") -> DataFrame:
    """(key, pos, token, start, end) of every token, in code points, end exclusive.

    A token starts after the gaps and tokens before it, whose lengths are summed by a window over the document.
    """
    if mode == "standard":
        return docs.select(key, F.posexplode(standard_tokens(F.col(text))).alias("pos", "t")).select(key, "pos", "t.token", "t.start", "t.end")
    parts = docs.select(key, F.arrays_zip(words(F.col(text), mode).alias("w"), F.split(F.col(text), PATTERNS[mode], -1).alias("g")).alias("p"))
    rows = parts.select(key, F.posexplode("p").alias("pos", "p")).select(key, "pos", F.col("p.w").alias("w"), F.length("p.g").alias("gap"))
    ends = F.sum(F.coalesce(F.length("w"), F.lit(0)) + F.col("gap")).over(Window.partitionBy(key).orderBy("pos"))
    placed = rows.withColumn("end", ends).filter("w IS NOT NULL")
    return placed.select(key, "pos", F.lower("w").alias("token"), (F.col("end") - F.length("w")).cast("int").alias("start"), F.col("end").cast("int").alias("end"))
