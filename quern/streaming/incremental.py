"""Work that goes on where it stopped, and windows over event streams (file sources)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quern.operators.gram_index import StoredGrams
from quern.operators.staging import with_ordinal
from quern.streaming.ledger import Ledger, search_stream


def remaining_grams(instances: DataFrame, done: int, *order: str, grams: str = "ngrams") -> DataFrame:
    """Gram lists without the first `done` grams in the given order of instances; emptied instances go."""
    rows = instances.select(*order, F.posexplode(grams).alias("_i", "gram"))
    placed = with_ordinal(rows, *order, "_i", to="_at").filter(F.col("_at") >= done)
    return placed.groupBy(*order).agg(F.array_sort(F.collect_list(F.struct("_i", "gram"))).alias("g")).select(*order, F.col("g.gram").alias(grams))


def read_stream(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def _watermarked(events: DataFrame, time: str, late: str) -> DataFrame:
    """A stream's event time with its watermark, which needs a time zone; a batch as it is."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if events.isStreaming else events


def windowed_counts(events: DataFrame, length: str, slide: str | None = None, late: str = "10 minutes", time: str = "ts", kind: str = "event_type") -> DataFrame:
    """(start, end, kind, n, total): counts and sums per window; a watermark bounds the state. Works on batches too."""
    marked = _watermarked(events, time, late)
    window = F.window(time, length, slide or length)
    return marked.groupBy(window.alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), kind, "n", "total")


def sessions(events: DataFrame, gap: str, user: str = "user_id", time: str = "ts", late: str = "1 hour") -> DataFrame:
    marked = _watermarked(events, time, late)
    return marked.groupBy(F.session_window(time, gap).alias("w"), user).agg(F.count(F.lit(1)).alias("n")).select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def decontaminate_stream(spark: SparkSession, docs: str, schema: str | T.StructType, grams: DataFrame | StoredGrams, out: str, checkpoint: str, files_per_batch: int = 1_000) -> StreamingQuery:
    """Searches each new file of documents for grams; hits (doc_id, digest, pos, n, gram) go to a ledger below out, once.

    Ledger(spark, out) gives the hits of all committed batches, the contaminated documents' and items' accumulated state
    and the position; the query resumes at its checkpoint.
    """
    from quern.operators.contamination import hits

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(docs)
    return search_stream(stream, lambda new: hits(new, grams), Ledger(spark, out), checkpoint)


#: What decontaminate_stream's ledger holds.
HITS = "doc_id long, digest long, pos int, n int, gram string"


def search_state(ledger: Ledger) -> tuple[DataFrame, DataFrame, int]:
    """(documents, grams, position): positions of hits per document and documents per gram of all committed batches."""
    found = ledger.found(HITS)
    documents = found.groupBy("doc_id", "digest").agg(F.array_sort(F.collect_set(F.struct("pos", "n"))).alias("hits"))
    grams = found.groupBy("gram").agg(F.count_distinct("doc_id", "digest").alias("documents"))
    return documents, grams, ledger.position()


def is_late(time: Column, watermark: Column, delay: str) -> Column:
    return time < watermark - F.expr(f"INTERVAL {delay}")
