"""Queries of whole corpora: declared runs with accounts, repeated rows, token files, samplers, updates, text metrics."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import cleaning, json_update, scoring, table_functions, text_metrics
from quern.functions.tokens import tokens
from quern.operators import bloom, contamination, dedup, gram_index, samplers
from quern.operators.staging import shared_folder, staged, with_following
from quern.plans import datasets
from quern.plans.catalog import SPANS_SQL, VOCAB_SQL, WORDS, _encoded, _grams_sql, query
from quern.sources import documents, token_files
from quern.sources import zstd_frames as zstd
from quern.streaming import incremental
from quern.streaming.ledger import Ledger


def _folder(name: str) -> str:
    """A new folder in the shared one."""
    return f"{shared_folder(SparkSession.getActiveSession())}/{name}-{uuid.uuid4().hex}"


# --- declared runs ----------------------------------------------------------------------------------------------------

DECLARED = """
pipeline:
  - {id: elastic_search_indexer, input: documents, output: indexed, args: {path: source}}
  - {id: ngram_writer, input: items, output: grams, args: {default_ngram_size: 13}}
  - {id: contaminated_span_tagger, input: documents, inputs: {ngrams: grams}, output: spans, args: {index: $folder/index}}
  - {id: decontaminator, input: documents, inputs: {spans: spans}, output: clean, args: {threshold: 0.5}}
  - {id: split_maker, output: split, args: {split_to_num_examples: {dev: 40, train: null}, context_len: 512, avg_num_tokens_per_doc: 256.0}}
  - {id: mds_writer, input: split, output: dev, args: {context_len: 128, num_tokens_per_chunk: 1000000000, split: dev}}
  - {id: memmap_writer, input: split, output: shards, args: {destination: $folder/tokens, num_shards: 3, of_split: dev}}
"""


@query(
    f"""WITH {SPANS_SQL}, c AS (SELECT d.doc_id, d.text FROM documents d LEFT JOIN (SELECT doc_id, sum("end" - "start") AS n FROM m GROUP BY doc_id) f USING (doc_id) WHERE n IS NULL OR n / length(d.text) < 0.5),
cut AS (SELECT v.doc_id, string_agg(substr(d.text, prev + 1, "start" - prev), '' ORDER BY "start") AS head, max("end") AS last
        FROM (SELECT doc_id, "start", "end", coalesce(lag("end") OVER (PARTITION BY doc_id ORDER BY "start"), 0) AS prev FROM m) v JOIN documents d USING (doc_id) GROUP BY v.doc_id),
x AS (SELECT c.doc_id, coalesce(head || substr(c.text, last + 1), c.text) AS text FROM c LEFT JOIN cut USING (doc_id)),
q AS (SELECT *, row_number() OVER (ORDER BY md5(doc_id || ':0'), doc_id) AS r FROM x),
dev AS (SELECT *, len(regexp_extract_all(text, '{WORDS}')) + 1 AS n FROM q WHERE r <= 80 AND text <> ''),
a(step, id, num_read, num_documents) AS (
  SELECT 0, 'elastic_search_indexer', (SELECT count(*) FROM documents), (SELECT count(DISTINCT source) FROM documents)
  UNION ALL SELECT 1, 'ngram_writer', (SELECT count(*) FROM benchmark), (SELECT count(*) FROM b)
  UNION ALL SELECT 2, 'contaminated_span_tagger', (SELECT count(*) FROM documents), (SELECT count(*) FROM m)
  UNION ALL SELECT 3, 'decontaminator', (SELECT count(*) FROM documents), (SELECT count(*) FROM x)
  UNION ALL SELECT 4, 'split_maker', (SELECT count(*) FROM x), (SELECT count(*) FROM x)
  UNION ALL SELECT 5, 'mds_writer', (SELECT count(*) FROM x), (SELECT (sum(n)::BIGINT - 1) // 128 FROM dev)
  UNION ALL SELECT 6, 'memmap_writer', (SELECT count(*) FROM x), 3)
SELECT step::INTEGER AS step, id, num_read, num_documents::BIGINT AS num_documents FROM a"""
)
def declared_accounts(t):
    """One declaration from documents and benchmark items to packed and token files; each step's rows, read and made."""
    import yaml

    folder = _folder("run")
    accounts = datasets.run(yaml.safe_load(DECLARED.replace("$folder", folder)), {"documents": t("documents"), "items": t("benchmark")}, folder)[1]
    return accounts.select("step", "id", "num_read", "num_documents")


# --- repeated rows ----------------------------------------------------------------------------------------------------


def _twice(t) -> DataFrame:
    """documents, and each of them again under its id with another text."""
    docs = t("documents").select("doc_id", "text")
    return docs.unionByName(docs.withColumn("text", F.concat(F.lit("Copy - "), F.col("text"))))


_TWICE_SQL = "docs2 AS (SELECT doc_id * 2 AS doc_id, text FROM documents UNION ALL SELECT doc_id * 2 + 1, 'Copy - ' || text FROM documents)"


@query(f"""WITH {_TWICE_SQL}, {SPANS_SQL.replace("FROM documents", "FROM docs2")} SELECT doc_id // 2 AS doc_id, "start", "end" FROM m""")
def spans_of_repeated_ids(t):
    grams = contamination.benchmark_grams(t("benchmark"), 13)
    return contamination.contaminated_spans(_twice(t), contamination.hits(_twice(t), grams)).drop("digest")


@query(
    f"""WITH {_TWICE_SQL}, {SPANS_SQL.replace("FROM documents", "FROM docs2")}, f AS (SELECT doc_id, sum("end" - "start") AS c FROM m GROUP BY doc_id)
SELECT d.doc_id // 2 AS doc_id, length(d.text)::INTEGER AS chars, c IS NOT NULL AS contaminated, round(coalesce(c / length(d.text), 0.0)::DOUBLE, 9) AS fraction FROM docs2 d LEFT JOIN f USING (doc_id)"""
)
def decontam_repeated_ids(t):
    docs = _twice(t)
    spans = contamination.contaminated_spans(docs, contamination.hits(docs, contamination.benchmark_grams(t("benchmark"), 13)))
    marked = contamination.decontaminate(docs.withColumn("chars", F.length("text")), spans, threshold=2.0)
    return marked.select("doc_id", "chars", "contaminated", scoring.rounded(F.col("fraction"), 9).alias("fraction"))


@query(
    f"""WITH d AS ({_grams_sql("documents", "doc_id", 13)}), b AS ({_grams_sql("benchmark", "item_id", 13)}) SELECT doc_id, count(DISTINCT pos)::BIGINT AS positions FROM d WHERE gram IN (SELECT gram FROM b) GROUP BY doc_id"""
)
def stored_gram_hits(t):
    """Hits by way of a stored index: written by the first call, opened by the second."""
    folder, grams = _folder("grams"), contamination.benchmark_grams(t("benchmark"), 13)
    written = gram_index.store_grams(grams, folder)
    opened = gram_index.store_grams(grams, folder)
    assert opened.version == written.version
    return contamination.hits(t("documents"), opened).groupBy("doc_id").agg(F.count_distinct("pos").alias("positions"))


@query("SELECT doc_id, md5(text) AS text_md5 FROM (SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text UNION ALL SELECT min(doc_id), 'Copy - ' || text FROM documents GROUP BY text)")
def dedup_repeated_ids(t):
    docs = _twice(t)
    return dedup.first_copies(docs.unionByName(docs)).select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def dedup_bloom(t):
    return bloom.first_copies(t("documents")).select("doc_id")


@query(
    """WITH l AS (SELECT doc_id, x, i FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)),
r AS (SELECT trim(x) AS line FROM l WHERE trim(x) <> '' GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3),
k AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY i) AS text FROM l WHERE trim(x) NOT IN (SELECT line FROM r) GROUP BY doc_id)
SELECT d.doc_id, md5(coalesce(k.text, '')) AS text_md5 FROM documents d LEFT JOIN k USING (doc_id)"""
)
def dedup_lines_removed(t):
    docs = t("documents")
    return dedup.without_lines(docs, dedup.repeated_lines(docs, 3)).select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


# --- token files ------------------------------------------------------------------------------------------------------


@query(
    f"""WITH {VOCAB_SQL}, o AS (SELECT doc_id, n, row_number() OVER (ORDER BY doc_id) - 1 AS r, count(*) OVER () AS t FROM n),
p AS (SELECT *, CASE WHEN r < t % 7 * (t // 7 + 1) THEN r // (t // 7 + 1) ELSE t % 7 + (r - t % 7 * (t // 7 + 1)) // (t // 7) END AS part FROM o)
SELECT part::INTEGER AS part, row_number() OVER (PARTITION BY part ORDER BY p.doc_id) - 1 AS doc, n AS num_tokens, s AS id_sum
FROM p JOIN (SELECT doc_id, sum(id)::BIGINT AS s FROM e GROUP BY doc_id) USING (doc_id)"""
)
def token_file_documents(t):
    back = token_files.write_token_files(_encoded(t), _folder("tokens"), parts=7)
    return back.select("part", "doc", F.size("ids").cast("long").alias("num_tokens"), F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum"))


# --- a search that goes on --------------------------------------------------------------------------------------------


@query(
    f"""WITH d AS ({_grams_sql("documents", "doc_id", 13)}), b AS ({_grams_sql("benchmark", "item_id", 13)}),
h AS (SELECT DISTINCT doc_id, gram FROM d WHERE gram IN (SELECT gram FROM b))
SELECT gram, count(DISTINCT doc_id) AS documents, (SELECT count(*) FROM documents) AS position FROM h GROUP BY gram"""
)
def streamed_grams(t):
    """The documents of each gram, searched in three batches of files; the last one is run again after it was committed."""
    docs, folder = t("documents").select("doc_id", "text"), _folder("stream")
    files = docs.sparkSession.sparkContext.defaultParallelism  # of a batch, so that all cores write and search it
    docs.repartition(3 * files).write.parquet(f"{folder}/in")
    grams = gram_index.store_grams(contamination.benchmark_grams(t("benchmark"), 13), f"{folder}/index")
    for _ in range(2):
        incremental.decontaminate_stream(docs.sparkSession, f"{folder}/in", "doc_id long, text string", grams, f"{folder}/out", f"{folder}/state", files).awaitTermination()
    ledger = Ledger(docs.sparkSession, f"{folder}/out")
    ledger.commit(ledger.committed()[-1], docs, lambda new: contamination.hits(new, grams))
    _, found, position = incremental.search_state(ledger)
    return found.withColumn("position", F.lit(position).cast("long"))


# --- words of many scripts --------------------------------------------------------------------------------------------

_SCRIPTS = ("aeiourn", "漢あカカกก字")


@query(
    rf"""WITH s AS (SELECT doc_id, lower(translate(text, '{_SCRIPTS[0]}.,:''', '{_SCRIPTS[1]}    ')) AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '[漢字あ]|[ก]+|[カ_]*カ[カ_]*|(?:[\p{{Latin}}\p{{N}}_]*[\p{{Latin}}\p{{N}}][\p{{Latin}}\p{{N}}_]*)') AS w FROM s)
SELECT doc_id, len(w)::BIGINT AS num_tokens, md5(array_to_string(w, '|')) AS tokens_md5 FROM w"""
)
def mixed_script_tokens(t):
    """Tokens of texts whose vowels and some consonants are Han, Hiragana, Katakana and Thai; marks between letters are blanks."""
    own = tokens(F.translate("text", _SCRIPTS[0] + ".,:'", _SCRIPTS[1] + "    "), "standard")
    return t("documents").select("doc_id", own.alias("w")).select("doc_id", F.size("w").cast("long").alias("num_tokens"), F.md5(F.array_join("w", "|").cast("binary")).alias("tokens_md5"))


# --- samplers ---------------------------------------------------------------------------------------------------------


def _place_sql(rows: str, n: str, seed: int, epoch: int) -> str:
    """CTEs that end in `placed` (key, x): the place of each ordinal o of rows (key, o), by the same rounds, walking on while beyond n."""

    def hashed(x: str, key: int) -> str:
        one = f"((({x} + {key}) & 2147483647) * 1103515245 & 2147483647)"
        two = f"((xor({one}, {one} >> 15)) * 1220703125 & 2147483647)"
        return f"xor({two}, {two} >> 13)"

    inner = "SELECT key, x // b AS l, x % b AS r, a, b, n FROM walk WHERE first OR x >= n"
    for i, key in enumerate(samplers.round_keys(seed, epoch)):
        left, right = ("l", f"(r + {hashed('l', key)}) % b") if i % 2 else (f"(l + {hashed('r', key)}) % a", "r")
        inner = f"SELECT key, {left} AS l, {right} AS r, a, b, n FROM ({inner})"
    return f"""size AS (SELECT n, a, greatest(1, (n + a - 1) // a) AS b FROM (SELECT n, CASE WHEN n <= 1 THEN 1 ELSE floor(sqrt(n - 1))::BIGINT + 1 END AS a FROM (SELECT ({n})::BIGINT AS n))),
walk(key, x, a, b, n, first) AS (
  SELECT key, o::BIGINT, a, b, n, true FROM ({rows}), size
  UNION ALL SELECT key, l * b + r, a, b, n, false FROM ({inner})),
placed AS (SELECT key, x FROM walk WHERE NOT first AND x < n)"""


@query(f"WITH RECURSIVE {_place_sql('SELECT doc_id AS key, row_number() OVER (ORDER BY doc_id) - 1 AS o FROM documents', 'SELECT count(*) FROM documents', 3, 1)} SELECT key AS doc_id, x AS place FROM placed")
def epoch_order(t):
    return samplers.epoch_order(t("documents").select("doc_id"), "doc_id", seed=3, epoch=1)


@query(
    f"""WITH RECURSIVE {_place_sql('SELECT doc_id AS key, row_number() OVER (ORDER BY doc_id) - 1 AS o FROM documents', 'SELECT count(*) FROM documents', 3, 2)},
r AS (SELECT key, x FROM placed UNION ALL SELECT key, x + n FROM placed, size WHERE x + n < (n + 6) // 7 * 7)
SELECT key AS doc_id, (x % 7)::INTEGER AS rank, x // 7 AS step FROM r"""
)
def rank_samples(t):
    return samplers.rank_samples(t("documents").select("doc_id"), 7, "doc_id", seed=3, epoch=2)


# --- updates, text metrics --------------------------------------------------------------------------------------------


@query(
    """SELECT event_id, '{"k":' || (json_extract_string(props, '$.k')::BIGINT * 2) || ',"from":{"ids":[{},' || event_id || ']},"kind":"' || event_type || '"}' AS props FROM events"""
)
def json_updates(t):
    rows = t("events").select("event_id", "event_type", "props")
    doubled = json_update.set_path(F.col("props"), "$.k", (F.get_json_object("props", "$.k").cast("long") * 2).cast("string"))
    listed = json_update.set_path(doubled, "$.from.ids[1]", F.col("event_id").cast("string"))
    return rows.select("event_id", json_update.set_path(listed, '["kind"]', F.to_json(F.array("event_type")).substr(F.lit(2), F.length(F.to_json(F.array("event_type"))) - 2)).alias("props"))


_PAIRS_SQL = r"""p AS (SELECT b.conv_id, b.turn, regexp_extract_all(lower(a.text), '[\p{L}\p{N}_]+') AS r, regexp_extract_all(lower(b.text), '[\p{L}\p{N}_]+') AS p FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
g AS (SELECT conv_id, turn, 'p' AS side, n, array_to_string(p[i : i + n - 1], ' ') AS w FROM (SELECT conv_id, turn, p, n, unnest(range(1, len(p) - n + 2)) AS i FROM p, (VALUES (1), (2)) v(n))
      UNION ALL SELECT conv_id, turn, 'r', n, array_to_string(r[i : i + n - 1], ' ') FROM (SELECT conv_id, turn, r, n, unnest(range(1, len(r) - n + 2)) AS i FROM p, (VALUES (1), (2)) v(n))),
c AS (SELECT conv_id, turn, n, w, count(*) FILTER (side = 'p') AS cp, count(*) FILTER (side = 'r') AS cr FROM g GROUP BY ALL),
m AS (SELECT conv_id, turn, n, sum(least(cp, cr)) AS m, sum(cp) AS t, sum(cr) AS u FROM c GROUP BY ALL)"""


@query(
    f"""WITH {_PAIRS_SQL}, s AS (SELECT conv_id, sum(m) FILTER (n = 1) AS m1, sum(m) FILTER (n = 2) AS m2, sum(t) FILTER (n = 1) AS t1, sum(t) FILTER (n = 2) AS t2 FROM m GROUP BY conv_id),
l AS (SELECT conv_id, sum(len(p)) AS a, sum(len(r)) AS b FROM p GROUP BY conv_id)
SELECT conv_id, coalesce(m1, 0)::BIGINT AS matches_1, coalesce(m2, 0)::BIGINT AS matches_2, round(CASE WHEN coalesce(m1, 0) + coalesce(m2, 0) > 0 AND t2 > 0 THEN 100 * CASE WHEN a < b THEN exp(1 - b / a) ELSE 1 END
  * exp((ln(CASE WHEN m1 > 0 THEN m1 / t1 ELSE 1 / (2 * t1) END) + ln(CASE WHEN m2 > 0 THEN m2 / t2 ELSE 1 / (CASE WHEN m1 > 0 THEN 2 ELSE 4 END * t2) END)) / 2) ELSE 0 END, 6) AS bleu
FROM l LEFT JOIN s USING (conv_id)"""
)
def bleu_of_turns(t):
    """BLEU-2 of each conversation's turns against the turns before them."""
    turns = t("conversations").select("conv_id", "turn", "text")
    pairs = turns.join(turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("before")), ["conv_id", "turn"])
    out = text_metrics.corpus_bleu(pairs, ["conv_id"], F.col("text"), F.array("before"), "simple", 2)
    return out.select("conv_id", F.element_at("counts", 1).alias("matches_1"), F.element_at("counts", 2).alias("matches_2"), F.round("bleu", 6).alias("bleu"))


@query(
    r"""WITH p AS (SELECT b.conv_id, b.turn, regexp_extract_all(lower(a.text), '[a-z0-9]+') AS r, regexp_extract_all(lower(b.text), '[a-z0-9]+') AS p FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
g AS (SELECT conv_id, turn, 1 AS side, unnest(p) AS w FROM p UNION ALL SELECT conv_id, turn, 2, unnest(r) FROM p),
c AS (SELECT conv_id, turn, w, count(*) FILTER (side = 1) AS cp, count(*) FILTER (side = 2) AS cr FROM g GROUP BY ALL),
m AS (SELECT conv_id, turn, sum(least(cp, cr)) AS m FROM c GROUP BY ALL)
SELECT conv_id, turn, round(CASE WHEN len(p) > 0 AND len(r) > 0 THEN 200.0 * coalesce(m, 0) / (len(p) + len(r)) ELSE 0 END, 6)::DOUBLE AS rouge1 FROM p LEFT JOIN m USING (conv_id, turn)"""
)
def rouge_of_turns(t):
    turns = t("conversations").select("conv_id", "turn", "text")
    pairs = turns.join(turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("before")), ["conv_id", "turn"])
    return pairs.select("conv_id", "turn", F.round(text_metrics.rouge(F.col("text"), F.col("before")).getField("rouge1"), 6).alias("rouge1"))


# --- table functions, zstd files --------------------------------------------------------------------------------------


@query(
    r"""WITH RECURSIVE p AS (
  SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS k, length(regexp_replace(x, '[\x09-\x0D !-/:-@\[-`{-~]', '', 'g')) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS k FROM documents WHERE text <> '') WHERE trim(x, ' ' || chr(9) || chr(13)) <> ''),
c(doc_id, k, chunk, held) AS (
  SELECT doc_id, k, 1, n FROM p WHERE k = 1
  UNION ALL
  SELECT p.doc_id, p.k, CASE WHEN c.held >= 900 THEN c.chunk + 1 ELSE c.chunk END, CASE WHEN c.held >= 900 THEN p.n ELSE c.held + p.n END FROM c JOIN p ON p.doc_id = c.doc_id AND p.k = c.k + 1),
j AS (SELECT doc_id, chunk, rtrim(string_agg(x, chr(10) ORDER BY k), ' ' || chr(9) || chr(10) || chr(13)) AS text FROM c JOIN p USING (doc_id, k) GROUP BY doc_id, chunk)
SELECT doc_id, lang, chunk::INTEGER AS chunk, max(chunk) OVER (PARTITION BY doc_id)::INTEGER AS "of", md5(j.text) AS text_md5 FROM j JOIN documents d USING (doc_id)"""
)
def chunks_by_sql(t):
    docs = t("documents").select("doc_id", "lang", "text")
    table_functions.register(docs.sparkSession)
    docs.createOrReplaceTempView("documents_to_chunk")
    made = docs.sparkSession.sql(r"SELECT * FROM chunks(TABLE(documents_to_chunk), 900, 'text', '\n')")
    return made.select("doc_id", "lang", "chunk", "of", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(f"""WITH {SPANS_SQL} SELECT doc_id, "start", "end" FROM m""")
def spans_merged_by_sql(t):
    """The spans of single hits, merged by a table function over partitions."""
    docs, grams = t("documents"), contamination.benchmark_grams(t("benchmark"), 13)
    found = contamination.hits(docs, grams)
    at = contamination.token_offsets(contamination.touched(docs, found).select("doc_id", "text").distinct())
    spans = found.join(at.select("doc_id", "pos", "start"), ["doc_id", "pos"]).join(at.select("doc_id", (F.col("pos") - 12).alias("pos"), "end"), ["doc_id", "pos"]).select("doc_id", "start", "end")
    table_functions.register(docs.sparkSession)
    spans.createOrReplaceTempView("spans_to_merge")
    return docs.sparkSession.sql("SELECT * FROM merged_spans(TABLE(spans_to_merge) PARTITION BY doc_id ORDER BY (start, `end`))")


@query(f"""SELECT lang, count(DISTINCT w)::DOUBLE AS words FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '{WORDS}')) AS w FROM documents) WHERE w LIKE 'a%' GROUP BY lang""")
def distinct_words(t):
    """Different words that begin with an a, from sketches that are larger than their numbers (and so exact)."""
    rows = t("documents").select("lang", F.explode(tokens(F.col("text"))).alias("w")).filter("w LIKE 'a%'")
    return table_functions.smallest_hashes(rows, ["lang"], F.col("w"), 1 << 20).select("lang", table_functions.distinct_estimate(F.col("hashes"), 1 << 20).alias("words"))


@query("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS line_num, doc_id, md5(text) AS text_md5 FROM documents")
def zstd_frames(t):
    """documents as JSON lines in zstd files (one for each range of the ids) of many frames that don't end with lines, read back run by run."""
    docs, folder = t("documents").select("doc_id", "text"), _folder("zstd")

    def write(rows):
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        part, held, count = TaskContext.get().partitionId(), bytearray(), 0
        at, name = token_files.file_system_of(f"{folder}/part-{part:05}.jsonl.zst")
        at.create_dir(name.rpartition("/")[0], recursive=True)
        with at.open_output_stream(name, compression=None) as out:
            for batch in rows:
                for line in batch.column(0):
                    held += line.as_py().encode() + b"\n"
                    count += 1
                    while len(held) >= 30_011:
                        out.write(zstandard.ZstdCompressor().compress(bytes(held[:30_011])))
                        del held[:30_011]
            if held:
                out.write(zstandard.ZstdCompressor().compress(bytes(held)))
        yield pa.RecordBatch.from_pydict({"part": [part], "n": [count]})

    sorted_lines = docs.orderBy("doc_id").select(F.to_json(F.struct("doc_id", "text")).alias("line"))
    sizes = staged(sorted_lines.mapInArrow(write, "part long, n long"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each file
    starts = sizes.select("part", before.alias("before"))
    lines = zstd.lines(docs.sparkSession, f"{folder}/*.jsonl.zst", 100_000).withColumn("part", F.regexp_extract("path", r"part-([0-9]+)\.jsonl\.zst$", 1).cast("int"))
    lines = lines.join(F.broadcast(starts), "part").withColumn("line_num", F.col("line_num") + F.col("before"))
    return lines.select("line_num", F.from_json("value", "doc_id long, text string").alias("r")).select("line_num", "r.doc_id", F.md5(F.col("r.text").cast("binary")).alias("text_md5"))


# --- scores that can go wrong -----------------------------------------------------------------------------------------


def _gain_sql(p: str, g: str) -> str:
    """F1 of two bags of a word and a number; the gold number must be there."""
    same = f"({p}.w = {g}.w)::INT + ({p}.k = {g}.k)::INT"
    return f"CASE WHEN {p}.k <> {g}.k THEN 0 ELSE ({same}) / 2.0 END"


@query(
    f"""WITH e AS (SELECT event_id, event_type AS a, coalesce(lead(event_type) OVER (ORDER BY event_id), 'none') AS b, user_id AS u FROM events),
s AS (SELECT event_id, {{'w': a, 'k': u % 3}} AS p1, {{'w': b, 'k': event_id % 3}} AS p2, unnest([
        {{'g1': {{'w': b, 'k': u % 3}}, 'g2': {{'w': a, 'k': event_id % 4}}}}, {{'g1': {{'w': a, 'k': event_id % 3}}, 'g2': {{'w': b, 'k': u % 2}}}}]) AS g FROM e),
x AS (SELECT event_id, (list_sort(list_distinct([p1, p2])) = list_sort(list_distinct([g.g1, g.g2])))::INT::DOUBLE AS exact,
        round(greatest({_gain_sql("p1", "g.g1")} + {_gain_sql("p2", "g.g2")}, {_gain_sql("p1", "g.g2")} + {_gain_sql("p2", "g.g1")}) / 2, 2)::DOUBLE AS f1 FROM s)
SELECT event_id, max(exact) AS exact, max(f1) AS f1 FROM x GROUP BY event_id"""
)
def spans_of_two_golds(t):
    """Two predicted spans of a word and a number against two golds of two spans; the SQL tries both assignments."""
    events = t("events").select("event_id", F.col("event_type").alias("a"), F.col("user_id").alias("u"))
    rows = with_following(events, "event_id", "a", "b").withColumn("b", F.coalesce("b", F.lit("none")))

    def span(word: str, number) -> Column:
        return F.concat_ws(" ", word, number.cast("string"))

    predicted = F.array(span("a", F.col("u") % 3), span("b", F.col("event_id") % 3))
    golds = F.array(F.array(span("b", F.col("u") % 3), span("a", F.col("event_id") % 4)), F.array(span("a", F.col("event_id") % 3), span("b", F.col("u") % 2)))
    return rows.select("event_id", scoring.spans_match(predicted, golds).alias("s")).select("event_id", "s.*")


@query(
    """WITH w AS (SELECT item_id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS w, (item_id % 5 + 2)::INT AS k FROM benchmark)
SELECT item_id, array_to_string(list_concat(list_append(w[1 : k - 1], '_'), w[k + 2 :]), ' ') AS masked FROM w"""
)
def word_differences(t):
    """Each item against itself with two of its words replaced by one that it hasn't."""
    words, k = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " "), F.col("item_id") % 5 + 2
    other = F.concat(F.slice(words, F.lit(1), k.cast("int") - 1), F.array(F.lit("QQQ")), F.slice(words, k.cast("int") + 2, F.size(words)))
    return t("benchmark").select("item_id", cleaning.word_difference(F.col("text"), F.array_join(other, " ")).alias("masked"))


_CHOICES_SQL = "[['a', 'bb', 'ccc', 'dddd'][1 + (i + vec_id) % 4] for i in range(4)]"


@query(
    f"""WITH q AS (SELECT vec_id, label, label % 5 AS gold, embedding[1:4]::DOUBLE[] AS ll, {_CHOICES_SQL} AS c FROM embeddings),
n AS (SELECT *, [ll[i] / length(c[i]) for i in range(1, 5)] AS by_size FROM q),
s AS (SELECT label, (list_position(ll, list_max(ll)) = gold + 1)::INT::DOUBLE AS acc, (list_position(by_size, list_max(by_size)) = gold + 1)::INT::DOUBLE AS acc_norm, -by_size[gold + 1] AS nll FROM n WHERE gold < 4)
SELECT label, round(avg(acc), 9) AS acc, round(avg(acc_norm), 9) AS acc_norm, round(avg(nll), 9) AS nll_per_char, count(*) AS questions FROM s GROUP BY label
UNION ALL SELECT DISTINCT label, NULL, NULL, NULL, 0 FROM q WHERE gold >= 4"""
)
def task_metric_means(t):
    """Means by label, with vectors' first components as log-likelihoods; labels whose gold choice is absent have none."""
    texts = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.element_at(F.array(*map(F.lit, ("a", "bb", "ccc", "dddd"))), ((i + F.col("vec_id")) % 4 + 1).cast("int")))
    likelihoods = F.slice("embedding", 1, 4).cast("array<double>")
    rows = t("embeddings").select("label", scoring.choice_scores(likelihoods, (F.col("label") % 5).cast("int"), texts).alias("scores"))
    return scoring.task_means(rows, "label").select("label", *[F.round(c, 9).alias(c) for c in ("acc", "acc_norm", "nll_per_char")], "questions")


@query(
    r"""SELECT role, round(exp(sum(n) * 0.9 / sum(w)), 6) AS word_perplexity, round(exp(sum(n) * 0.9 / sum(b)), 9) AS byte_perplexity, round(sum(n) * 0.9 / sum(b) / ln(2), 9) AS bits_per_byte
FROM (SELECT role, length(text) AS n, len(regexp_extract_all(text, '\S+')) AS w, octet_length(encode(text)) AS b FROM conversations) GROUP BY role"""
)
def perplexity_by_role(t):
    rows = t("conversations").select("role", "text", (F.length("text") * -0.9).alias("log_likelihood"))
    found = scoring.perplexities(rows, "role")
    return found.select("role", F.round("word_perplexity", 6).alias("word_perplexity"), F.round("byte_perplexity", 9).alias("byte_perplexity"), F.round("bits_per_byte", 9).alias("bits_per_byte"))


@query(
    """WITH s AS (SELECT page_id, ntile(7) OVER (ORDER BY page_id) AS shard FROM pages)
SELECT (shard % 3)::INTEGER AS rank, shard::INTEGER AS shard, count(*) AS pages, min(page_id) AS first, max(page_id) AS last FROM s GROUP BY shard"""
)
def pages_of_ranks(t):
    """The pages that each rank downloads, shard by shard."""
    sharded = documents.shard_urls(t("pages").select("page_id"), 7, "page_id")
    ranks = documents.shards_of_ranks(sharded, 3).select("rank", F.explode("shards").alias("shard"))
    return ranks.join(sharded, "shard").groupBy("rank", "shard").agg(F.count(F.lit(1)).alias("pages"), F.min("page_id").alias("first"), F.max("page_id").alias("last"))
