"""Mixing sources to target weights, with DataFrame functions only.

Every row gets a hash-random key (md5 of its id and a seed). A source is dealt into ranges of the key; the ranges' token
sums, one small row each, give the distributed prefix sums, and thereby the one range in which the source's budget is
cut. Only the rows of that range, 1/4096 of a source, are sorted. What comes out is one row per source: how many whole
epochs it gives, and the key at which the last, partial epoch ends. The documents then decide on their own, so texts are
never shuffled, and a source may hold any share of the rows.

Defined results: a null or wordless text has size 0 and is never taken; the null source is a source, ordered last;
identical rows share the words cut within them; rows with equal ids differ by size and text hash; columns of the
names that are added are replaced, others pass through; an empty table gives no rows. Sources are few (one row each is kept in one window); over 10,000 of them are joined by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed, set_aside

#: Hex digits of the key that make a range: 16**3 ranges a source.
RANGE_DIGITS = 3


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _keyed(docs: DataFrame, text: str, source: str, doc_id: str, seed: int, size: Column | None) -> DataFrame:
    """docs with _s (source, never null, ordered by code point with null last), _key, _tie and _size."""
    return docs.withColumns({
        "_s": F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source))),
        "_key": F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.lit(f":{seed}")).cast("binary")),
        "_tie": F.xxhash64(F.col(text)),
        "_size": words_in(F.col(text)) if size is None else size,
    })


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """(_s, source_size, target) from (_s, source_size): share of all words by weight, none above cap times its source.

    With sources in the order of cap/weight, those before the first that its share fits are at their cap; the rest
    split what is left by weight. That is where resharing the excess again and again ends.
    """
    by_name = Window.orderBy("_s")
    at = (F.row_number().over(by_name) - 1) % len(weights) + 1
    w = sizes.withColumn("_w", F.element_at(F.array(*map(F.lit, map(float, weights))), at)).withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "_s")
    everything = Window.orderBy(F.col("_cap") / F.col("_w"), "_s").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - before) / F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing))
    fits = w.withColumn("_level", level).withColumn("_fit", F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_level")))
    at_level = F.first("_fit", ignorenulls=True).over(everything)
    return fits.withColumn("_at", at_level).select("_s", "source_size", F.when(F.col("_at").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_at") * F.col("_w"))).alias("target"))


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 11,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
    size: Column | None = None,
) -> DataFrame:
    """docs with size, source_size, target and taken (words that the mix takes of the document, repeats counted).

    Texts are read twice, unless a size is given: a caller who needs no texts stages ids, sizes and a hash first. weights repeat over the sources in the order of their names. taken is whole epochs times size, plus, in the last
    epoch, size for keys below the source's cut, and at the cut what is left of the budget.
    """
    given = "given__size"
    docs = docs.drop("size", "source_size", "target", "taken") if size is None else docs.withColumn(given, size).drop("size", "source_size", "target", "taken")
    docs, restored = set_aside(docs, text, source, doc_id, given)
    keyed = _keyed(docs, text, source, doc_id, seed, None if size is None else F.col(given)).drop(given)
    small = keyed.select("_s", "_key", "_tie", "_size", F.substring("_key", 1, RANGE_DIGITS).alias("_range"))
    ranges = checkpointed(small.groupBy("_s", "_range").agg(F.sum("_size").alias("_sum")))
    budgets = targets(ranges.groupBy("_s").agg(F.sum("_sum").alias("source_size")), weights, share, cap)
    budgets = budgets.withColumn("_budget", F.least(F.round("target").cast("long"), F.floor(F.col("source_size") * F.lit(float(cap))).cast("long")))
    budgets = budgets.withColumn("_epochs", F.when(F.col("source_size") > 0, F.expr("_budget div source_size")).otherwise(F.lit(0)).cast("long"))
    budgets = checkpointed(budgets.withColumn("_rest", F.col("_budget") - F.col("_epochs") * F.col("source_size")))
    n_sources = budgets.count()

    prefix = F.coalesce(F.sum("_sum").over(Window.partitionBy("_s").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut_range = ranges.withColumn("_before", prefix).join(budgets.select("_s", "_rest"), "_s")
    cut_range = cut_range.filter((F.col("_before") <= F.col("_rest")) & (F.col("_rest") < F.col("_before") + F.col("_sum"))).select("_s", "_range", "_before", "_rest")
    within = F.broadcast(cut_range) if n_sources <= 10_000 else cut_range  # one row per source at most
    runs = small.join(within, ["_s", "_range"]).groupBy("_s", "_before", "_rest", "_key", "_size", "_tie").agg(F.count(F.lit(1)).alias("_copies"))
    order = Window.partitionBy("_s").orderBy("_key", "_size", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_start", F.col("_before") + F.coalesce(F.sum(F.col("_size") * F.col("_copies")).over(order), F.lit(0)))
    at_cut = (F.col("_start") <= F.col("_rest")) & (F.col("_rest") < F.col("_start") + F.col("_size") * F.col("_copies"))
    cuts = runs.filter(at_cut).select(
        "_s",
        F.struct("_key", "_size", "_tie").alias("_cut"),
        F.expr("(_rest - _start) div _copies").alias("_part"),
    )
    plan = checkpointed(budgets.join(cuts, "_s", "left").select("_s", "source_size", "target", "_epochs", "_cut", "_part"))
    plan = F.broadcast(plan) if n_sources <= 10_000 else plan
    place = F.struct("_key", "_size", "_tie")
    last = F.when(F.col("_cut").isNull(), F.lit(0)).when(place < F.col("_cut"), F.col("_size")).when(place == F.col("_cut"), F.col("_part")).otherwise(F.lit(0))
    mixed = keyed.join(plan, "_s").withColumn("taken", (F.col("_epochs") * F.col("_size") + last).cast("long")).withColumn("size", F.col("_size"))
    return restored(mixed.drop("_s", "_key", "_tie", "_size", "_epochs", "_cut", "_part"))


def first_words(text: Column, n: Column) -> Column:
    """text up to its n-th word, with the white space between its words as it is."""
    pieces = F.split(text, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    lead = F.when(text.rlike(r"^[\x20\x09-\x0D]"), F.lit(1)).otherwise(F.lit(0))
    return F.array_join(F.slice(pieces, F.lit(1), (n + lead).cast("int")), "")


def mixed_rows(mixed: DataFrame, text: str = "text") -> DataFrame:
    """The mix as rows: a document as often as it is taken whole, and once up to the cut if the budget ends within it."""
    whole = F.expr("CASE WHEN size > 0 THEN taken div size ELSE 0 END").cast("int")
    rest = F.when(F.col("size") > 0, F.col("taken") - whole.cast("long") * F.col("size")).otherwise(F.lit(0))
    texts = F.concat(
        F.array_repeat(F.col(text), whole),
        F.when(rest > 0, F.array(first_words(F.col(text), rest))).otherwise(F.array().cast("array<string>")),
    )
    return mixed.withColumn(text, F.explode(texts))
