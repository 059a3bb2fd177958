"""Projection, exclusion, routing, sampling, splitting and chunking of documents."""

from __future__ import annotations

import math
import string
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.predicates import Field, compiled, struct_field
from quern.operators.staging import light, null_safe_join, rank_within, with_ordinal

#: Hex digits of a hash that make a range of a large group: 4096 ranges.
RANGE_DIGITS = 3


def keep_columns(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The listed columns that there are, in the frame's order."""
    return df.select(*[c for c in df.columns if c in set(keys)])


def drop_columns(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All but the listed columns; absent ones are fine."""
    return df.drop(*keys)


def exclude(df: DataFrame, predicates: Sequence[str | Column], field: Field = struct_field, null_policy: str = "keep") -> DataFrame:
    """Rows for which no predicate holds; a predicate that is null does not hold."""
    for p in predicates:
        met = compiled(p, field, null_policy) if isinstance(p, str) else F.coalesce(p, F.lit(False))
        df = df.filter(~met)
    return df


def route(df: DataFrame, groups: Mapping[str, str | Column], to: str = "group", field: Field = struct_field, unmatched: str | None = None) -> DataFrame:
    """Rows with the name of the first group whose predicate holds. Others go, or get the name `unmatched`."""
    name = F.lit(unmatched)
    for group, p in reversed(list(groups.items())):
        name = F.when(compiled(p, field) if isinstance(p, str) else F.coalesce(p, F.lit(False)), F.lit(group)).otherwise(name)
    return df.withColumn(to, name).filter(F.col(to).isNotNull())


def ranges(column: str, bounds: Sequence[float]) -> dict[str, Column]:
    """Groups for (lower, upper] ranges between the bounds."""
    return {f"({lo}, {hi}]": (F.col(column) > lo) & (F.col(column) <= hi) for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)}


def first_k(df: DataFrame, quotas: Mapping[str, int], value: str, order: Sequence[str], per: Sequence[str] = ()) -> DataFrame:
    """The first rows, in the given order, of each value with a quota (in each `per` group); others go.

    Spark keeps only the first k of a group before the shuffle, so large groups cost no more than small ones.
    """
    quota = F.create_map(*[F.lit(x) for pair in quotas.items() for x in pair])[F.col(value)]
    most = max(quotas.values(), default=0)
    listed = df.filter(F.col(value).isin(list(quotas)))
    place = F.row_number().over(Window.partitionBy(*per, value).orderBy(*order))
    return listed.withColumn("_place", place).filter(F.col("_place") <= most).filter(F.col("_place") <= quota).drop("_place")


def first_k_by_source(df: DataFrame, rules: Mapping[str, Mapping[str, int]], source: str, value: str, order: Sequence[str]) -> DataFrame:
    """first_k within each source, with the quotas of the first pattern that matches the source's start.

    Sources that no pattern matches stay whole.
    """
    rule = F.lit(None).cast("int")
    for n, pattern in reversed(list(enumerate(rules))):
        rule = F.when(F.col(source).rlike(f"^(?:{pattern})"), n).otherwise(rule)
    ruled = df.withColumn("_rule", rule)
    out = ruled.filter("_rule IS NULL").drop("_rule")
    for n, quotas in enumerate(rules.values()):
        out = out.unionByName(first_k(ruled.filter(F.col("_rule") == n).drop("_rule"), quotas, value, order, [source]))
    return out


def quotas_filled(sample: DataFrame, quotas: Mapping[str, int], value: str) -> DataFrame:
    """(value, quota, taken, success) for every quota."""
    wanted = sample.sparkSession.createDataFrame(list(quotas.items()), f"{value} string, quota int")
    taken = sample.groupBy(value).agg(F.count(F.lit(1)).alias("taken"))
    return wanted.join(taken, value, "left").select(value, "quota", F.coalesce("taken", F.lit(0)).alias("taken"), F.coalesce(F.col("taken") == F.col("quota"), F.col("quota") == 0).alias("success"))


def first_rows(df: DataFrame, k: int, *order: str | Column) -> DataFrame:
    """The first k rows of the whole frame in the given order; Spark keeps k rows of each task."""
    return df.orderBy(*order).limit(k)


def by_length(df: DataFrame, key: str = "doc_id", text: str = "text", longest_first: bool = True) -> DataFrame:
    """df with place (in the order of lengths, ties by key) and restored (in the order of keys), both from 0.

    Rows of like lengths make even batches; sorting the answers by restored brings back the order they came in.
    """
    size = F.coalesce(F.length(text), F.lit(0)).cast("long")
    rows = df.withColumn("_size", -size if longest_first else size)
    return with_ordinal(with_ordinal(rows, "_size", key, to="place"), key, "_size", to="restored").drop("_size")


def split_sizes(examples: Mapping[str, int | None], context: int, tokens_per_doc: float, files: int, available: int | None = None) -> dict[str, int | None]:
    """Documents per split in a file; None is the one split that takes the rest.

    If fewer documents are available than asked for, every sized split gives up an even share of what is missing and the
    first one also what does not divide.
    """
    sizes = {s: None if n is None else math.ceil(n / (tokens_per_doc / context) / files) for s, n in examples.items()}
    if sum(n is None for n in sizes.values()) > 1:
        raise ValueError("only one split can take the rest")
    sized = [s for s, n in sizes.items() if n is not None]
    missing = 0 if available is None else sum(sizes[s] for s in sized) - available
    if missing > 0:
        each, odd = divmod(missing, len(sized))
        for s in sized:
            sizes[s] -= each + (odd if s == sized[0] else 0)
    return sizes


def hash_order(key: str, seed: int) -> Column:
    """A reproducible random order of a key."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary"))


def assign_splits(df: DataFrame, sizes: Mapping[str, int | None], key: str = "doc_id", seed: int = 0, per: str | None = None, shrink: bool = False) -> DataFrame:
    """df with split: in the order of a hash, so many rows for each sized split, the rest for the open one or none.

    per: a file column; sizes then hold for each file. shrink: where a file (or all) has fewer rows than the sized splits
    ask for, each gives up an even share of what is missing, the first one also what doesn't divide.
    """
    ordered = df.withColumn("_hash", hash_order(key, seed))
    if per:
        place = rank_within(ordered, [per], F.substring("_hash", 1, RANGE_DIGITS), ["_hash", key], "_place")
    else:
        place = with_ordinal(ordered, "_hash", key, to="_place")
    split, upto = F.lit(next((s for s, n in sizes.items() if n is None), None)), []
    sized = [s for s, n in sizes.items() if n is not None]
    edge, each, odd = F.lit(0), F.lit(0), F.lit(0)
    if shrink and sized:
        rows = df.groupBy(*([F.col(per)] if per else [])).agg(F.count(F.lit(1)).alias("_rows"))
        place = null_safe_join(place, light(rows), [per] if per else []) if per else place.crossJoin(F.broadcast(rows))  # one row
        missing = F.greatest(F.lit(0), F.lit(sum(sizes[s] for s in sized)) - F.col("_rows"))
        each, odd = F.floor(missing / len(sized)), missing % len(sized)
    for s in sized:
        edge = edge + F.greatest(F.lit(0), F.lit(sizes[s]) - each - (odd if s == sized[0] else F.lit(0)))
        upto.append((edge, s))
    for end, s in reversed(upto):
        split = F.when(F.col("_place") < end, F.lit(s)).otherwise(split)
    return place.withColumn("split", split).filter(F.col("split").isNotNull()).drop("_hash", "_place", "_rows")


#: ASCII white space and punctuation, which do not count towards a chunk's size (fixed values).
UNCOUNTED = string.whitespace + string.punctuation


def chunks_of(text: str, least: int, delimiter: str) -> list[str]:
    """Runs of paragraphs with at least so many counting characters; the last run may have fewer."""
    strip = str.maketrans("", "", UNCOUNTED)
    out: list[str] = []
    held: list[str] = []
    count = 0
    for paragraph in filter(str.strip, text.split(delimiter)):
        held.append(paragraph)
        count += len(paragraph.translate(strip))
        if count >= least:
            out.append(delimiter.join(held).rstrip())
            held, count = [], 0
    return out + ([delimiter.join(held).rstrip()] if held else [])


def chunk_documents(df: DataFrame, least: int, delimiter: str = "\n\n", key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each chunk, with chunk_id ``chunk-j-of-n-id`` and the chunk as the text."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: chunks_of(t, least, delimiter) if t else [])

    cuts = df.withColumn("_chunks", cut(F.col(text)))
    rows = cuts.select(*[c for c in df.columns if c != text], F.size("_chunks").alias("_n"), F.posexplode("_chunks").alias("_j", text))
    name = F.concat(F.lit("chunk-"), (F.col("_j") + 1).cast("string"), F.lit("-of-"), F.col("_n").cast("string"), F.lit("-"), F.col(key).cast("string"))
    return rows.withColumn("chunk_id", name).drop("_n", "_j")


def choose(df: DataFrame, counts: Mapping[str, int], source: str = "source", key: str = "doc_id", seed: int = 0) -> DataFrame:
    """So many rows of each source in a hash order; more than there are repeat the source, with `epoch` from 0."""
    sizes = df.groupBy(source).agg(F.count(F.lit(1)).alias("_n"))
    wanted = df.sparkSession.createDataFrame(list(counts.items()), f"{source} string, _want long")
    plan = sizes.join(wanted, source)
    rows = df.join(F.broadcast(plan), source).withColumn("_hash", hash_order(key, seed))  # a row for each count that was asked for
    rows = rank_within(rows, [source], F.substring("_hash", 1, RANGE_DIGITS), ["_hash", key], "_place").drop("_hash")
    epochs = F.ceil(F.greatest(F.col("_want") - F.col("_place"), F.lit(0)) / F.col("_n")).cast("int")
    return rows.withColumn("epoch", F.explode(F.when(epochs > 0, F.sequence(F.lit(0), epochs - 1)))).drop("_n", "_want", "_place")


def proportional_counts(sizes: Mapping[str, int], weights: Mapping[str, float], total: int | None = None) -> dict[str, int]:
    """Rows to choose of each source so that they stand in proportion to the weights; total: all there are, if not given.

    Each gets the whole part of its share; what is left over goes, one each, to the largest remainders (ties: by name).
    """
    total = sum(sizes.get(s, 0) for s in weights) if total is None else total
    whole = sum(weights.values())
    shares = {s: total * w / whole for s, w in weights.items()} if whole else {}
    counts = {s: math.floor(x) for s, x in shares.items()}
    for s in sorted(shares, key=lambda s: (counts[s] - shares[s], s))[: total - sum(counts.values())] if shares else []:
        counts[s] += 1
    return counts


def choose_proportions(df: DataFrame, weights: Mapping[str, float], total: int | None = None, source: str = "source", key: str = "doc_id", seed: int = 0) -> DataFrame:
    """choose with counts in proportion to the weights of the sources."""
    listed = df.filter(F.col(source).isin(list(weights)))
    sizes = {r[source]: r["n"] for r in listed.groupBy(source).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each weight at most
    return choose(listed, proportional_counts(sizes, {s: w for s, w in weights.items() if s in sizes}, total), source, key, seed)


def mix_fractions(parts: Sequence[tuple[DataFrame, float | None, bool]], key: str = "doc_id", seed: int = 0) -> tuple[DataFrame, list[DataFrame]]:
    """The union of hash-chosen fractions (None: all) of each part, and what each part has left.

    The flag says whether the rows that are taken leave their part.
    """
    taken, left = None, []
    for df, fraction, remove in parts:
        share = F.conv(F.substring(hash_order(key, seed), 1, 8), 16, 10).cast("double") / float(1 << 32)
        chosen = F.lit(True) if fraction is None else share < fraction
        part = df.filter(chosen)
        taken = part if taken is None else taken.unionByName(part, allowMissingColumns=True)
        left.append(df.filter(~chosen) if remove else df)
    return taken, left
