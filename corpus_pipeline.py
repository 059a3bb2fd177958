"""Corpus pipeline: quality, toxicity, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; each works on all that the one before kept.

Defined results, of every stage: an empty table gives no rows; extra columns of any names pass through all but the last
stage, whatever the operators call theirs; repeated rows and null ids are rows. Quality and toxicity judge a null or empty
text as an empty line and leave it in or out by that score; near-duplicates link such texts with one another (no
shingles) and keep one; the mix never takes them, as they have no words; packing would give them their end token alone. The
classifiers learn from the tables in sf_dir, on rows that are not held out. Near-duplicates are texts whose sets of 5-word
shingles have a Jaccard similarity of 0.8 or more, and what such links join; operator 7's fingerprint groups propose the
closest of them, min-wise samples the others, and whole sets are compared. The mix takes a document as often as its source's epochs say and
cuts the text in which a source's budget ends, so packing may see an id several times.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import checkpoint_folder, set_aside, table
from quern.llm.mixing import mix, mixed_rows
from quern.llm.packing import pack
from quern.llm.quality import fit_quality, score_quality
from quern.llm.resemblance import keep_one_resembling
from quern.llm.toxicity import fit_toxicity, score_toxicity


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of quality 0.7 or more."""
    field = fit_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    plain, restored = set_aside(docs, "text")
    return restored(score_quality(plain, field).filter("score >= 0.7").drop("score"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of toxicity under 0.3."""
    machine = fit_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    plain, restored = set_aside(docs, "text")
    return restored(score_toxicity(plain, machine).filter("score < 0.3").drop("score"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of similarity 0.8 or more join."""
    return keep_one_resembling(docs, shingle=5, similarity=0.8).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources' documents at their target weights, repeated or cut at the budgets."""
    plain, restored = set_aside(docs, "doc_id", "text", "source", "n_chars")
    mixed = mixed_rows(mix(plain)).withColumn("n_chars", F.length("text").cast("long"))
    return restored(mixed.select(*plain.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each row goes, in sequences of 1024 tokens."""
    return pack(docs.select("doc_id", "text"), payload="ids_crc32")


STAGES = [
    ("quality classifier", quality),
    ("toxicity", toxicity),
    ("simhash and min-wise near-dedup", near_duplicates),
    ("mixing to target weights", mixing),
    ("best-fit packing", packing),
]

#: The classifiers and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet to the shared folder and read again; the last one's rows stay there."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for n, (_, stage) in enumerate(STAGES):
        out = f"{folder}/{n}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if n:  # the rows of the stage before have been read for the last time
            before = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n - 1}")
            before.getFileSystem(spark._jsc.hadoopConfiguration()).delete(before, True)
    return docs
