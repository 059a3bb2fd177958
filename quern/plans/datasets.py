"""Declared pipelines over named datasets, with an account of every step.

    pipeline:
      - {id: ngram_writer, input: items, output: grams, args: {default_ngram_size: 13}}
      - {id: contaminated_span_tagger, input: documents, inputs: {ngrams: grams}, output: spans}
      - {id: decontaminator, input: documents, inputs: {spans: spans}, output: clean}

A step reads `input` (what the step before gave, if not named), gets the datasets under `inputs` as further arguments, and
gives `output` (its id, if not named). Each output is written once, below the run's folder; its account - rows read and
written, characters of text - is observed by the job that writes it, so that nothing is scanned again to be counted. The
account is written last: a run that is started again takes over the steps that have one, if their declaration and
all before them are as they were, and goes on behind them.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quern.plans import pipeline

ACCOUNT = "step int, id string, inputs array<string>, output string, num_read long, num_documents long, num_chars long, signature string"


def _signature(entry: Mapping[str, Any], above: list[str]) -> str:
    return hashlib.sha256(json.dumps([entry, above], sort_keys=True, default=str).encode()).hexdigest()


def _finished(spark: SparkSession, folder: str, n: int) -> dict[str, Any] | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/accounts/{n:03d}/_SUCCESS")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    row = spark.read.schema(ACCOUNT).json(f"{folder}/accounts/{n:03d}").first()
    return row.asDict() if row else None


def run(config: Mapping[str, Any], given: Mapping[str, DataFrame], folder: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """(datasets by name, accounts): all given and made datasets, and a row for each step in order.

    given: datasets by name; the first is the input of a first step that names none. Rows of given ones are counted by
    Spark's count (for Parquet, from the files' footers).
    """
    spark = next(iter(given.values())).sparkSession
    known = pipeline.steps()
    frames, rows, signatures = dict(given), {}, {}
    last, accounts = next(iter(given)), []
    for n, entry in enumerate(config.get("pipeline", [])):
        if entry["id"] not in known:
            raise KeyError(f"no step {entry['id']}; there are {', '.join(sorted(known))}")
        source, extra, output = entry.get("input", last), entry.get("inputs") or {}, entry.get("output", entry["id"])
        for name in (source, *extra.values()):
            if name not in frames:
                raise KeyError(f"step {n} ({entry['id']}) reads {name}, which is neither given nor made before")
        if output in frames:
            raise ValueError(f"step {n} ({entry['id']}) makes {output}, which there is already")
        signature = _signature(entry, [signatures.get(name, name) for name in (source, *extra.values())])
        path = f"{folder}/{n:03d}-{output}"
        done = _finished(spark, folder, n)
        if not done or done["signature"] != signature:
            if source not in rows:
                rows[source] = frames[source].count()
            arguments = {**(entry.get("args") or {}), **(entry.get("call_kwargs") or {})}
            made = known[entry["id"]](frames[source], **arguments, **{k: frames[v] for k, v in extra.items()})
            seen = Observation(f"step-{n}")
            chars = F.sum(F.length("text")) if dict(made.dtypes).get("text") == "string" else F.max(F.lit(None).cast("long"))
            made.observe(seen, F.count(F.lit(1)).alias("rows"), chars.alias("chars")).write.mode("overwrite").parquet(path)
            told = seen.get
            done = {"step": n, "id": entry["id"], "inputs": [source, *extra.values()], "output": output, "num_read": rows[source], "num_documents": told["rows"], "num_chars": told["chars"], "signature": signature}
            spark.createDataFrame([tuple(done.values())], ACCOUNT).coalesce(1).write.mode("overwrite").json(f"{folder}/accounts/{n:03d}")
        accounts.append(tuple(done.values()))
        frames[output], rows[output], signatures[output], last = spark.read.parquet(path), done["num_documents"], signature, output
    return frames, spark.createDataFrame(accounts, ACCOUNT).drop("signature")
