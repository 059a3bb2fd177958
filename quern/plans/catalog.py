"""Registered queries over the test tables, each beside SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import cleaning, scoring
from quern.functions.predicates import compiled, json_field
from quern.functions.tokens import ngrams, token_offsets, tokens
from quern.operators import chat, contamination, curation, dedup
from quern.operators import training_examples as examples
from quern.operators.staging import staged
from quern.plans import pipeline
from quern.sources import documents
from quern.streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function (tables by name -> DataFrame) under its name, with its SQL."""

    def add(function: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[function.__name__] = run
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


# --- tokens, n-grams, contamination -----------------------------------------------------------------------------------

WORDS = r"[\p{L}\p{N}_]+"


def _grams_sql(table: str, key: str, n: int) -> str:
    return rf"""
  SELECT {key}, i - 1 AS pos, array_to_string(t[i : i + {n - 1}], ' ') AS gram, len(t) - {n - 1} AS num_ngrams
  FROM (SELECT {key}, regexp_extract_all(lower(text), '{WORDS}') AS t FROM {table}), unnest(range(1, len(t) - {n - 2})) AS u(i)"""


def _contaminated(n: int) -> None:
    @query(f"WITH d AS ({_grams_sql('documents', 'doc_id', n)}), b AS ({_grams_sql('benchmark', 'item_id', n)}) SELECT DISTINCT doc_id FROM d WHERE gram IN (SELECT gram FROM b)")
    def contaminated(t):
        return contamination.contaminated_documents(t("documents"), contamination.benchmark_grams(t("benchmark"), n))

    QUERIES[f"contaminated_docs_{n}"] = QUERIES.pop("contaminated")
    ORACLES[f"contaminated_docs_{n}"] = ORACLES.pop("contaminated")


_contaminated(8)
_contaminated(13)


@query(
    f"WITH b AS ({_grams_sql('benchmark', 'item_id', 8)}) SELECT gram, count(*) AS occurrences, count(DISTINCT item_id) AS items, arg_min(item_id, item_id * 100000 + pos) AS first_item FROM b GROUP BY gram"
)
def ngram_index(t):
    return contamination.ngram_index(contamination.benchmark_grams(t("benchmark"), 8))


@query(
    rf"""WITH d AS ({_grams_sql("documents", "doc_id", 13)}), b AS ({_grams_sql("benchmark", "item_id", 13)})
SELECT item_id, max(num_ngrams)::INTEGER AS num_source_ngrams, count(DISTINCT gram) AS num_contaminated, md5(string_agg(DISTINCT gram, '|' ORDER BY gram)) AS grams_md5
FROM b WHERE gram IN (SELECT gram FROM d) GROUP BY item_id"""
)
def contaminated_sources(t):
    grams = contamination.benchmark_grams(t("benchmark"), 13)
    found = contamination.contaminated_sources(grams, contamination.hits(t("documents"), grams))
    return found.select("item_id", "num_source_ngrams", F.size("contaminated_ngrams").cast("long").alias("num_contaminated"), F.md5(F.array_join("contaminated_ngrams", "|").cast("binary")).alias("grams_md5"))


SPANS_SQL = rf"""
p AS (SELECT doc_id, unnest(regexp_extract_all(text, '{WORDS}')) AS w, unnest(regexp_split_to_array(text, '{WORDS}')[:-2]) AS g,
             unnest(range(len(regexp_extract_all(text, '{WORDS}')))) AS pos FROM documents),
o AS (SELECT doc_id, pos, sum(length(w) + length(g)) OVER (PARTITION BY doc_id ORDER BY pos) AS e, length(w) AS l FROM p),
d AS ({_grams_sql("documents", "doc_id", 13)}), b AS ({_grams_sql("benchmark", "item_id", 13)}),
h AS (SELECT DISTINCT doc_id, pos FROM d WHERE gram IN (SELECT gram FROM b)),
s AS (SELECT h.doc_id, a.e - a.l AS s, z.e AS e FROM h JOIN o a ON a.doc_id = h.doc_id AND a.pos = h.pos JOIN o z ON z.doc_id = h.doc_id AND z.pos = h.pos + 12),
i AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS n FROM s),
g AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY s, e) AS k FROM i),
m AS (SELECT doc_id, min(s)::INTEGER AS "start", max(e)::INTEGER AS "end" FROM g GROUP BY doc_id, k)"""


def _spans(t, **how):
    docs, grams = t("documents"), contamination.benchmark_grams(t("benchmark"), 13)
    return contamination.contaminated_spans(docs, contamination.hits(docs, grams), **how)


@query(f'WITH {SPANS_SQL} SELECT doc_id, "start", "end" FROM m')
def contaminated_spans(t):
    return _spans(t).drop("digest")


@query(
    rf"""WITH {SPANS_SQL},
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS k FROM documents),
q AS (SELECT doc_id, k, sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY k) - 1 AS e, length(x) AS n FROM l),
r AS (SELECT doc_id, e - n AS s, e, lead(e - n) OVER (PARTITION BY doc_id ORDER BY k) AS nxt FROM q WHERE n > 0),
w AS (SELECT m.doc_id, m."start", m."end", least(min(r.s), m."start") AS s, arg_max(coalesce(r.nxt, r.e), r.s) AS e
      FROM m JOIN r ON r.doc_id = m.doc_id AND r.e > m."start" AND r.s < m."end" GROUP BY m.doc_id, m."start", m."end"),
i2 AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS n FROM w),
g2 AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM i2)
SELECT doc_id, min(s)::BIGINT AS "start", max(e)::BIGINT AS "end" FROM g2 GROUP BY doc_id, k"""
)
def contaminated_lines(t):
    return _spans(t, delimiter="\n").select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


FRACTION_SQL = f"""WITH {SPANS_SQL}, f AS (SELECT doc_id, sum("end" - "start") AS c FROM m GROUP BY doc_id),
x AS (SELECT d.doc_id, d.source, d.text, f.c IS NOT NULL AS contaminated, coalesce(f.c / length(d.text), 0.0)::DOUBLE AS fraction FROM documents d LEFT JOIN f USING (doc_id))"""


def _marked(t, threshold=0.5, replacement="", drop_whole=False):
    return contamination.decontaminate(t("documents"), _spans(t), threshold=threshold, replacement=replacement, drop_whole=drop_whole)


@query(f"{FRACTION_SQL} SELECT doc_id, contaminated, round(fraction, 9) AS fraction, contaminated AND fraction >= 0.5 AS dropped FROM x")
def decontam_drop(t):
    return _marked(t).select("doc_id", "contaminated", scoring.rounded(F.col("fraction"), 9).alias("fraction"), "dropped")


@query(
    rf"""WITH {SPANS_SQL},
v AS (SELECT doc_id, "start", "end", coalesce(lag("end") OVER (PARTITION BY doc_id ORDER BY "start"), 0) AS prev FROM m),
c AS (SELECT v.doc_id, string_agg(substr(d.text, prev + 1, "start" - prev) || '[cut]', '' ORDER BY "start") AS head, max("end") AS last FROM v JOIN documents d USING (doc_id) GROUP BY v.doc_id)
SELECT d.doc_id, md5(coalesce(head || substr(d.text, last + 1), d.text)) AS text_md5 FROM documents d LEFT JOIN c USING (doc_id)"""
)
def decontam_replace(t):
    return _marked(t, 2.0, "[cut]").select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(
    f"""{FRACTION_SQL}, y AS (SELECT *, max(contaminated::INT) OVER (PARTITION BY source) AS touched FROM x)
SELECT sum((contaminated AND fraction >= 0.05)::BIGINT)::BIGINT AS num_docs_dropped, count(*) AS num_docs_total, sum(touched)::BIGINT AS num_docs_in_touched_shards,
       100.0::DOUBLE * sum((contaminated AND fraction >= 0.05)::BIGINT)::DOUBLE / count(*)::DOUBLE AS percent_docs_dropped FROM y"""
)
def decontam_stats(t):
    return contamination.decontamination_stats(_marked(t, 0.05), "source")


@query(
    rf"""WITH {SPANS_SQL} SELECT m.doc_id, m."start", m.doc_id % 2 = 0 AS success FROM m"""
)
def span_identity(t):
    spans = _spans(t).select(F.col("doc_id").alias("line_num"), "start", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).otherwise(-1).alias("id"))
    docs = t("documents").select(F.col("doc_id").alias("line_num"), F.col("doc_id").alias("id"))
    return contamination.span_identity(docs, spans, ["line_num"]).select(F.col("line_num").alias("doc_id"), "start", "success")


@query(
    rf"""WITH p AS (SELECT item_id, regexp_extract_all(text, '{WORDS}') AS w, regexp_split_to_array(text, '{WORDS}') AS g FROM benchmark),
u AS (SELECT item_id, unnest(w) AS w, unnest(g[: len(w)]) AS g, unnest(range(len(w))) AS pos FROM p)
SELECT item_id, pos::INTEGER AS pos, lower(w) AS token, (sum(length(w) + length(g)) OVER (PARTITION BY item_id ORDER BY pos) - length(w))::INTEGER AS "start",
       (sum(length(w) + length(g)) OVER (PARTITION BY item_id ORDER BY pos))::INTEGER AS "end" FROM u"""
)
def token_positions(t):
    return token_offsets(t("benchmark"), "item_id")


@query(
    rf"SELECT item_id, len(w) AS num_tokens, CASE WHEN len(w) >= 40 THEN len(w) - 39 ELSE CASE WHEN len(w) >= 20 THEN 1 ELSE 0 END END AS num_grams FROM (SELECT item_id, regexp_extract_all(lower(text), '{WORDS}') AS w FROM benchmark)"
)
def short_ngrams(t):
    own = tokens(F.col("text"))
    return t("benchmark").select("item_id", F.size(own).cast("long").alias("num_tokens"), F.size(ngrams(own, 40, 20)).cast("long").alias("num_grams"))


# --- projection, filters, routing, sampling ---------------------------------------------------------------------------


@query("SELECT doc_id, source FROM documents")
def project_keep(t):
    return curation.keep_columns(t("documents"), ["source", "doc_id", "absent"])


@query("SELECT doc_id, lang, n_chars FROM documents")
def project_drop(t):
    return curation.drop_columns(t("documents"), ["text", "source", "absent"])


@query("SELECT doc_id FROM documents WHERE source NOT IN ('src1', 'src2', 'src3') AND lang <> 'de'")
def exclude_in_list(t):
    return curation.exclude(t("documents"), ['.source == "src1" or .source == "src2" or .source == "src3"', '.lang == "de"']).select("doc_id")


@query("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NULL OR l.quality >= 0.5")
def score_exclude(t):
    rows = t("documents").select("doc_id").join(t("labels"), "doc_id", "left")
    return curation.exclude(rows, ["$[?(@.quality < 0.5)]"]).select("doc_id", "quality")


@query("SELECT d.doc_id FROM documents d JOIN labels l USING (doc_id) WHERE l.quality >= 0.5")
def score_exclude_nulls(t):
    rows = t("documents").select("doc_id").join(t("labels"), "doc_id", "left")
    return curation.exclude(rows, [".quality < 0.5"], null_policy="drop").select("doc_id")


@query("SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS DOUBLE) > 20 AND CAST(json_extract_string(props, '$.k') AS DOUBLE) <= 40")
def jsonpath_filter(t):
    return t("events").filter(compiled("$[?(@.k > 20 & @.k <= 40)]", json_field("props"))).select("event_id")


BUCKETS_SQL = "CASE WHEN n_chars > 0 AND n_chars <= 500 THEN '(0, 500]' WHEN n_chars > 500 AND n_chars <= 2000 THEN '(500, 2000]' WHEN n_chars > 2000 AND n_chars <= 8000 THEN '(2000, 8000]' END"


@query(f'SELECT doc_id, {BUCKETS_SQL} AS "group" FROM documents WHERE n_chars > 0 AND n_chars <= 8000')
def group_first_match(t):
    return curation.route(t("documents"), curation.ranges("n_chars", [0, 500, 2000, 8000])).select("doc_id", "group")


@query(f"""SELECT coalesce({BUCKETS_SQL}, 'discarded') AS "group", count(*) AS n FROM documents GROUP BY 1""")
def group_counts(t):
    return curation.route(t("documents"), curation.ranges("n_chars", [0, 500, 2000, 8000]), unmatched="discarded").groupBy("group").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) WHERE (lang = 'en' AND r <= 20) OR (lang = 'fr' AND r <= 5)")
def sample_first_k(t):
    return curation.first_k(t("documents"), {"en": 20, "fr": 5}, "lang", ["doc_id"]).select("doc_id", "lang")


@query(
    """SELECT doc_id, source, lang FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS r FROM documents)
WHERE CASE WHEN source LIKE 'src1%' THEN lang = 'en' AND r <= 2 WHEN source LIKE 'src2%' THEN lang = 'de' AND r <= 1 ELSE true END"""
)
def sample_by_source(t):
    rules = {"src1": {"en": 2}, "src[12]": {"de": 1}}
    return curation.first_k_by_source(t("documents"), rules, "source", "lang", ["doc_id"]).select("doc_id", "source", "lang")


@query(
    "SELECT v.lang, v.quota::INTEGER AS quota, least(count(d.doc_id), v.quota) AS taken, count(d.doc_id) >= v.quota AS success FROM (VALUES ('en', 20), ('it', 3)) v(lang, quota) LEFT JOIN documents d USING (lang) GROUP BY v.lang, v.quota"
)
def sample_quotas(t):
    quotas = {"en": 20, "it": 3}
    return curation.quotas_filled(curation.first_k(t("documents"), quotas, "lang", ["doc_id"]), quotas, "lang")


# --- splits, chunks, mixes, shards ------------------------------------------------------------------------------------


@query(
    "SELECT doc_id, CASE WHEN r <= 50 THEN 'dev' WHEN r <= 120 THEN 'test' ELSE 'train' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || ':0'), doc_id) AS r FROM documents)"
)
def split_assign(t):
    return curation.assign_splits(t("documents").select("doc_id"), {"dev": 50, "test": 70, "train": None})


@query(
    "SELECT source, split, count(*) AS n FROM (SELECT source, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY md5(doc_id || ':7'), doc_id) <= 4 THEN 'dev' WHEN row_number() OVER (PARTITION BY source ORDER BY md5(doc_id || ':7'), doc_id) <= 10 THEN 'test' END AS split FROM documents) WHERE split IS NOT NULL GROUP BY ALL"
)
def split_per_file(t):
    sizes = curation.split_sizes({"dev": 20, "test": 30}, 1024, 256.0, 20)
    return curation.assign_splits(t("documents").select("doc_id", "source"), sizes, seed=7, per="source").groupBy("source", "split").agg(F.count(F.lit(1)).alias("n"))


@query(
    r"""WITH RECURSIVE p AS (
  SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS k, length(regexp_replace(x, '[\x09-\x0D !-/:-@\[-`{-~]', '', 'g')) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS k FROM documents WHERE text <> '') WHERE trim(x, ' ' || chr(9) || chr(13)) <> ''),
c(doc_id, k, chunk, held) AS (
  SELECT doc_id, k, 1, n FROM p WHERE k = 1
  UNION ALL
  SELECT p.doc_id, p.k, CASE WHEN c.held >= 600 THEN c.chunk + 1 ELSE c.chunk END, CASE WHEN c.held >= 600 THEN p.n ELSE c.held + p.n END FROM c JOIN p ON p.doc_id = c.doc_id AND p.k = c.k + 1),
j AS (SELECT doc_id, chunk, rtrim(string_agg(x, chr(10) ORDER BY k), ' ' || chr(9) || chr(10) || chr(13)) AS text FROM c JOIN p USING (doc_id, k) GROUP BY doc_id, chunk)
SELECT 'chunk-' || chunk || '-of-' || max(chunk) OVER (PARTITION BY doc_id) || '-' || doc_id AS chunk_id, doc_id, md5(text) AS text_md5 FROM j"""
)
def chunk_paragraphs(t):
    return curation.chunk_documents(t("documents").select("doc_id", "text"), 600, "\n").select("chunk_id", "doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(
    """WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id || ':0'), doc_id) - 1 AS p, count(*) OVER (PARTITION BY source) AS n FROM documents),
w(source, want) AS (VALUES ('src0', 30), ('src1', 75), ('src2', 120))
SELECT doc_id, source, e::INTEGER AS epoch FROM r JOIN w USING (source), unnest(range(ceil(greatest(want - p, 0) / n)::BIGINT)) AS u(e)"""
)
def mix_choose(t):
    return curation.choose(t("documents").select("doc_id", "source"), {"src0": 30, "src1": 75, "src2": 120}).select("doc_id", "source", "epoch")


@query(
    """WITH h AS (SELECT doc_id, lang, ('0x' || substr(md5(doc_id || ':0'), 1, 8))::BIGINT / 4294967296.0 AS s FROM documents)
SELECT doc_id, lang, 'taken' AS part FROM h WHERE (lang = 'en' AND s < 0.25) OR lang = 'fr' UNION ALL SELECT doc_id, lang, 'left' FROM h WHERE lang = 'en' AND s >= 0.25"""
)
def mix_fractions(t):
    docs = t("documents").select("doc_id", "lang")
    taken, left = curation.mix_fractions([(docs.filter("lang = 'en'"), 0.25, True), (docs.filter("lang = 'fr'"), None, False)])
    return taken.withColumn("part", F.lit("taken")).unionByName(left[0].withColumn("part", F.lit("left")))


@query("SELECT page_id, shard::INTEGER AS shard, 'shard-' || shard || '-of-7' AS shard_name FROM (SELECT page_id, ntile(7) OVER (ORDER BY page_id) AS shard FROM pages) WHERE shard % 3 = 1")
def url_shards(t):
    return documents.of_rank(documents.shard_urls(t("pages").select("page_id"), 7, "page_id"), 1, 3)


# --- tokenising, packing, reports -------------------------------------------------------------------------------------

VOCAB_SQL = rf"""v AS (SELECT term, row_number() OVER (ORDER BY encode(term)) AS id FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{WORDS}')) AS term FROM documents)),
k AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{WORDS}')) AS term, unnest(range(len(regexp_extract_all(lower(text), '{WORDS}')))) AS pos FROM documents WHERE text <> ''),
e AS (SELECT doc_id, pos, id FROM k JOIN v USING (term) UNION ALL SELECT doc_id, len(regexp_extract_all(text, '{WORDS}')), 0 FROM documents WHERE text <> ''),
n AS (SELECT doc_id, count(*) AS n FROM e GROUP BY doc_id)"""


def _encoded(t):
    docs = t("documents")
    return examples.encode_words(docs, examples.vocabulary(docs))


@query(f"WITH {VOCAB_SQL} SELECT doc_id, count(*) AS num_tokens, sum(id)::BIGINT AS id_sum FROM e GROUP BY doc_id")
def tokenize_counts(t):
    return _encoded(t).select("doc_id", F.size("ids").cast("long").alias("num_tokens"), F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum"))


PACK_SQL = f"""WITH {VOCAB_SQL}, c AS (SELECT ceil(sum(n) / 50000)::BIGINT AS chunks FROM n),
o AS (SELECT doc_id, n, row_number() OVER (ORDER BY doc_id) - 1 AS r, count(*) OVER () AS docs, chunks FROM n, c),
a AS (SELECT *, docs // chunks AS q, docs % chunks AS m FROM o),
h AS (SELECT *, CASE WHEN r < m * (q + 1) THEN r // (q + 1) ELSE m + (r - m * (q + 1)) // q END AS chunk FROM a),
f AS (SELECT *, sum(n) OVER (PARTITION BY chunk ORDER BY doc_id) - n AS first, row_number() OVER (PARTITION BY chunk ORDER BY doc_id) - 1 AS doc FROM h),
l AS (SELECT chunk, sum(n) AS total FROM f GROUP BY chunk),
s AS (SELECT f.chunk, f.doc, f.first + e.pos AS tk, e.id, l.total FROM f JOIN e USING (doc_id) JOIN l USING (chunk)),
x AS (SELECT chunk, (tk // 512) AS example, tk % 512 AS i, id, doc FROM s WHERE tk < (total - 1) // 512 * 512),
y AS (SELECT chunk, ((tk - 1) // 512) AS example, id FROM s WHERE tk >= 1 AND tk <= (total - 1) // 512 * 512),
p AS (SELECT chunk::INTEGER AS chunk, example::INTEGER AS example, md5(string_agg(id, ',' ORDER BY i)) AS inputs_md5, count(DISTINCT doc) AS docs, min(doc)::INTEGER AS first_doc FROM x GROUP BY ALL),
z AS (SELECT chunk::INTEGER AS chunk, example::INTEGER AS example, sum(id)::BIGINT AS target_sum FROM y GROUP BY ALL)"""


def _packed(t):
    return examples.pack_stream(_encoded(t), 512, 50_000)


@query(f"{PACK_SQL} SELECT chunk, example, inputs_md5, docs, first_doc, target_sum FROM p JOIN z USING (chunk, example)")
def pack_examples(t):
    return _packed(t).select(
        "chunk",
        "example",
        F.md5(F.array_join(F.col("inputs").cast("array<string>"), ",").cast("binary")).alias("inputs_md5"),
        F.size(F.array_distinct("doc_ids")).cast("long").alias("docs"),
        F.array_min("doc_ids").alias("first_doc"),
        F.aggregate("targets", F.lit(0).cast("long"), lambda a, x: a + x).alias("target_sum"),
    )


@query(
    f"{PACK_SQL} SELECT 0 AS shard, (SELECT count(*) FROM n) AS docs, (SELECT sum(n)::BIGINT FROM n) AS num_tokens, (SELECT (sum(n) - sum(n) % 512)::BIGINT FROM n) AS num_tokens_floor, count(*) AS examples, count(*) * 512 AS packed_tokens FROM p"
)
def pack_manifest(t):
    encoded = staged(_encoded(t))
    return examples.manifest(encoded, examples.pack_stream(encoded, 512, 50_000), 512)


@query(
    """SELECT source AS dataset, sum(CASE WHEN s = 'train' THEN n_chars ELSE 0 END)::DOUBLE * 512 / 1e9 AS train_tokens, count(*) FILTER (s = 'dev') AS dev_docs, count(*) AS total_docs,
  count(*) FILTER (n_chars < 300) AS contaminated_docs, 100.0::DOUBLE * (count(*) FILTER (n_chars < 300))::DOUBLE / count(*) AS percent_contaminated_docs,
  bool_and(n_chars > 10) AS decontam_successful FROM (SELECT *, CASE WHEN doc_id % 5 = 0 THEN 'dev' ELSE 'train' END AS s FROM documents) GROUP BY source"""
)
def dataset_report(t):
    split = F.when(F.col("doc_id") % 5 == 0, "dev").otherwise("train")
    parts = t("documents").select(F.col("source").alias("dataset"), split.alias("split"), F.lit(1).alias("docs"), F.col("n_chars").alias("samples"), F.lit(1).alias("shards"), (F.col("n_chars") < 300).cast("int").alias("docs_dropped"), F.lit(1).alias("docs_before"), (F.col("n_chars") > 10).alias("complete"))
    return examples.dataset_report(parts, 512).select("dataset", "train_tokens", "dev_docs", "total_docs", "contaminated_docs", "percent_contaminated_docs", "decontam_successful")


@query("SELECT lang, num_lines, num_docs_added, num_lines - num_docs_added AS delta FROM (SELECT lang, count(*) AS num_lines, count(*) FILTER (n_chars > 200) AS num_docs_added FROM documents GROUP BY lang)")
def indexing_accounts(t):
    docs = t("documents")
    return documents.indexing_accounts(docs, docs.filter("n_chars > 200"), "lang")


# --- conversations ----------------------------------------------------------------------------------------------------

RENDER_SQL = "SELECT conv_id, string_agg('<|' || role || '|>' || chr(10) || text || '<|endoftext|>', chr(10) ORDER BY turn) || chr(10) AS rendered FROM conversations GROUP BY conv_id"


@query(f"SELECT conv_id, md5(rendered) AS rendered_md5, length(rendered) AS chars FROM ({RENDER_SQL})")
def render_chat(t):
    return chat.render(t("conversations")).select("conv_id", F.md5(F.col("rendered").cast("binary")).alias("rendered_md5"), F.length("rendered").cast("long").alias("chars"))


LOSS_SQL = r"""WITH m AS (SELECT *, len(regexp_extract_all('<|' || role || '|>' || chr(10) || text || '<|endoftext|>' || chr(10), '<\|[a-z]+\|>|\n|[^\s<]+|<')) AS n FROM conversations),
w AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS e, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM m),
s AS (SELECT conv_id, turn, e - n + CASE WHEN before <> 'assistant' THEN 2 ELSE 0 END - 1 AS s, e - 1 AS e FROM w WHERE role = 'assistant')"""


@query(f"""{LOSS_SQL} SELECT conv_id, turn, greatest(s, 0)::INTEGER AS "start", e::INTEGER AS "end" FROM s""")
def label_mask(t):
    return chat.loss_spans(t("conversations")).filter("role = 'assistant'").select("conv_id", "turn", "start", F.col("end").cast("int").alias("end"))


@query(f"{LOSS_SQL} SELECT conv_id, max(w.e)::BIGINT - 1 AS num_labels, (SELECT sum(s.e - greatest(s.s, 0)) FROM s WHERE s.conv_id = w.conv_id)::BIGINT AS num_loss FROM w WHERE conv_id IN (SELECT conv_id FROM s) GROUP BY conv_id")
def sft_examples(t):
    return chat.loss_counts(t("conversations"))


@query("SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'assistant') AS assistant_turns, sum(length(text))::BIGINT AS chars, arg_min(role, turn) AS first_role FROM conversations GROUP BY conv_id")
def conversation_stats(t):
    return chat.conversation_stats(t("conversations"))


# --- scoring ----------------------------------------------------------------------------------------------------------

NORMAL_SQL = r"""array_to_string([x for x in regexp_extract_all(translate(lower(text), '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~‘’´`', '                                    '), '\S+') if x not in ('a', 'an', 'the')], ' ')"""


@query(f"SELECT conv_id, turn, {NORMAL_SQL} AS answer FROM conversations")
def normalize_answer(t):
    return t("conversations").select("conv_id", "turn", cleaning.normal_answer(F.col("text")).alias("answer"))


@query(
    f"""WITH n AS (SELECT conv_id, turn, list_distinct(string_split({NORMAL_SQL}, ' ')) AS w FROM conversations),
p AS (SELECT a.conv_id, a.turn, len(list_intersect(a.w, b.w))::DOUBLE AS i, len(a.w) AS x, len(b.w) AS y FROM n a JOIN n b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, round(CASE WHEN i > 0 THEN 2 * (i / x) * (i / y) / (i / x + i / y) ELSE 0.0 END, 9) AS f1 FROM p"""
)
def token_f1(t):
    words = F.split(cleaning.normal_answer(F.col("text")), " ")
    rows = t("conversations").select("conv_id", "turn", words.alias("w")).withColumn("gold", F.lead("w").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("gold IS NOT NULL")
    return rows.select("conv_id", "turn", F.round(scoring.bag_f1(F.col("w"), F.col("gold")), 9).alias("f1"))


@query(
    "SELECT a.item_id, regexp_replace(lower(a.text), '[^a-z]', '', 'g') = regexp_replace(lower(b.text), '[^a-z]', '', 'g') AS matched FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id - a.item_id % 2"
)
def exact_match(t):
    items = t("benchmark")
    gold = items.select(F.col("item_id").alias("g"), F.col("text").alias("gold"))
    rows = items.join(gold, F.col("g") == F.col("item_id") - F.col("item_id") % 2)
    return rows.select("item_id", cleaning.exactly_matches(F.col("text"), F.col("gold"), True, True, ("[^a-zA-Z]",)).alias("matched"))


@query(r"SELECT event_id, coalesce(nullif(regexp_extract(props, '([0-9]+)[^0-9]*$', 1), ''), '[invalid]') AS answer FROM events")
def answer_extraction(t):
    return t("events").select("event_id", cleaning.match_at(F.col("props"), r"([0-9]+)").alias("answer"))


@query(
    r"SELECT item_id, regexp_extract(text, '^.*[a-zA-Z]', 0, 's') AS question, split_part(text, 'th', 1) AS stopped, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')[-1] AS last FROM benchmark WHERE text NOT LIKE '%?'"
)
def text_cleaning(t):
    text = F.col("text")
    return t("benchmark").select("item_id", cleaning.cut_question(text).alias("question"), cleaning.stopped(text, ("th", "")).alias("stopped"), cleaning.last_word(text).alias("last"))


@query()
def spans_score(t):
    """DROP-style scores of all of each turn's words against the next turn's, by optimal assignment."""
    words = F.split("text", " ")
    rows = t("conversations").select("conv_id", "turn", words.alias("p")).withColumn("g", F.lead("p").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("g IS NOT NULL")
    return rows.select("conv_id", "turn", scoring.spans_match(F.col("p"), F.array("g")).alias("s")).select("conv_id", "turn", "s.*")


@query(
    "SELECT model, turn, score, n FROM (SELECT source AS model, lang AS turn, avg(quality) AS score, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE quality <> -1 GROUP BY GROUPING SETS ((source, lang), (source)))"
)
def mt_scores(t):
    judged = t("documents").join(t("labels"), "doc_id").select(F.col("source").alias("model"), F.col("lang").alias("turn"), F.col("quality").alias("score"))
    return scoring.mean_scores(judged)


@query(
    """WITH j AS (SELECT event_type AS a, lead(event_type) OVER (ORDER BY event_id) AS b, CASE WHEN value > 15 THEN 'model_1' WHEN value > 5 THEN 'model_2' ELSE 'tie' END AS g1,
  CASE WHEN event_id % 7 = 0 THEN 'error' WHEN event_id % 2 = 0 THEN 'model_1' WHEN event_id % 3 = 0 THEN 'tie' ELSE 'model_2' END AS g2 FROM events),
r AS (SELECT a, b, CASE WHEN g1 = g2 AND g1 <> 'tie' THEN g1 ELSE 'tie' END AS w FROM j WHERE b IS NOT NULL AND g2 <> 'error'),
u AS (SELECT a AS model, CASE w WHEN 'model_1' THEN 'win' WHEN 'model_2' THEN 'loss' ELSE 'tie' END AS r FROM r UNION ALL SELECT b, CASE w WHEN 'model_2' THEN 'win' WHEN 'model_1' THEN 'loss' ELSE 'tie' END FROM r),
c AS (SELECT model, count(*) FILTER (r = 'win') AS win, count(*) FILTER (r = 'loss') AS loss, count(*) FILTER (r = 'tie') AS tie, count(*) AS n FROM u GROUP BY model)
SELECT model, win, loss, tie, win / n AS win_rate, loss / n AS loss_rate, (win::DOUBLE + 0.5::DOUBLE * tie) / n AS win_rate_adjusted FROM c"""
)
def win_rates(t):
    e = t("events")
    nxt = e.select((F.col("event_id") - 1).alias("event_id"), F.col("event_type").alias("model_2"))
    g1 = F.when(F.col("value") > 15, "model_1").when(F.col("value") > 5, "model_2").otherwise("tie")
    g2 = F.when(F.col("event_id") % 7 == 0, "error").when(F.col("event_id") % 2 == 0, "model_1").when(F.col("event_id") % 3 == 0, "tie").otherwise("model_2")
    return scoring.win_rates(e.join(nxt, "event_id").select(F.col("event_type").alias("model_1"), "model_2", g1.alias("g1_winner"), g2.alias("g2_winner")))


@query("SELECT l_returnflag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 6) AS mean, round(avg(CASE WHEN l_discount <> 0 THEN (l_tax = l_discount)::INT END), 9) AS accuracy FROM lineitem GROUP BY l_returnflag")
def weighted_avg(t):
    return t("lineitem").groupBy("l_returnflag").agg(F.round(scoring.weighted_mean(F.col("l_extendedprice"), F.col("l_quantity")), 6).alias("mean"), F.round(scoring.masked_accuracy(F.col("l_tax"), F.col("l_discount"), 0), 9).alias("accuracy"))


@query(
    """WITH b AS (SELECT event_type, event_id, value, min(value) OVER w AS best, row_number() OVER w AS r FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)),
l AS (SELECT *, CASE WHEN lag(best) OVER (PARTITION BY event_type ORDER BY event_id) IS DISTINCT FROM best THEN r END AS f FROM b)
SELECT event_type, event_id, best, r - max(f) OVER (PARTITION BY event_type ORDER BY event_id) AS since_best FROM l"""
)
def running_best(t):
    return scoring.running_best(t("events"), "value", "event_id", ["event_type"], 50).select("event_type", "event_id", "best", F.col("since_best").cast("long").alias("since_best"))


@query("SELECT quality AS score, count(*) AS n, round(100.0::DOUBLE * count(*)::DOUBLE / sum(count(*)) OVER (), 9) AS percent FROM labels GROUP BY quality")
def score_histogram(t):
    counts = t("labels").groupBy(F.col("quality").alias("score")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 9))


@query("SELECT doc_id, (n_chars >= 1500)::INT AS label, true AS success FROM documents")
def threshold_labels(t):
    return t("documents").select("doc_id", scoring.threshold_class(F.col("n_chars"), 1500.0).alias("s")).select("doc_id", "s.*")


@query("SELECT avg(l_extendedprice) AS chosen_mean, avg(l_quantity * 1000) AS rejected_mean, avg((l_extendedprice > l_quantity * 1000)::INT) AS accuracy, round(avg(l_extendedprice - l_quantity * 1000), 6) AS margin FROM lineitem")
def preference_metrics(t):
    rows = t("lineitem").select(F.col("l_extendedprice").alias("chosen"), (F.col("l_quantity") * 1000).alias("rejected"))
    return scoring.preference_metrics(rows).withColumn("margin", F.round("margin", 6))


@query("""SELECT p_partkey AS step, round(CASE WHEN p_partkey < 100 THEN 0.01 * p_partkey / 100 WHEN p_partkey < 1500 THEN 0.001 + 0.5 * 0.009 * (1 + cos(pi() * (p_partkey - 100) / 1400)) ELSE 0.001 END, 12) AS cosine,
round(CASE WHEN p_partkey < 100 THEN 0.01 * p_partkey / 100 WHEN p_partkey < 1500 THEN 0.01 - 0.01 / 1400 * (p_partkey - 100) ELSE 0.0 END, 12) AS linear FROM part""")
def learning_rates(t):
    step = F.col("p_partkey")
    return t("part").select(step.alias("step"), F.round(scoring.warmup_cosine(step, 100, 1500, 0.01), 12).alias("cosine"), F.round(scoring.linear_anneal(step, 1500, 0.01, 0.0, 100), 12).alias("linear"))


# --- duplicates, tags, urls -------------------------------------------------------------------------------------------


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def dedup_exact(t):
    return dedup.first_copies(t("documents")).select("doc_id")


@query(
    "SELECT line, count(DISTINCT doc_id) AS docs, count(*) AS occurrences FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents) WHERE line <> '' GROUP BY line HAVING count(DISTINCT doc_id) >= 3"
)
def dedup_lines(t):
    return dedup.repeated_lines(t("documents"), 3)


@query(
    r"""SELECT doc_id, length(text)::INTEGER AS chars, len(regexp_extract_all(text, '[\p{L}\p{N}_]+'))::INTEGER AS words, len(string_split(text, chr(10)))::INTEGER AS lines,
round(length(regexp_replace(text, '[^\p{L}\p{N}_]', '', 'g'))::DOUBLE / len(regexp_extract_all(text, '[\p{L}\p{N}_]+')), 9) AS mean_word FROM documents"""
)
def tag_lengths(t):
    return dedup.length_tags(t("documents")).select("doc_id", "chars", "words", "lines", scoring.rounded(F.col("mean_word"), 9).alias("mean_word"))


@query(
    r"""WITH k(kind, p) AS (VALUES ('email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+'), ('phone', '\+?[0-9]{1,3}[ -]?\([0-9]{3}\)[ -]?[0-9]{3}-[0-9]{4}'), ('ipv4', '\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b')),
e AS (SELECT doc_id, 'email' AS kind, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+')) AS hit FROM documents
UNION ALL SELECT doc_id, 'phone', unnest(regexp_extract_all(text, '\+?[0-9]{1,3}[ -]?\([0-9]{3}\)[ -]?[0-9]{3}-[0-9]{4}')) FROM documents
UNION ALL SELECT doc_id, 'ipv4', unnest(regexp_extract_all(text, '\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b')) FROM documents)
SELECT doc_id, kind, hit FROM e"""
)
def tag_pii_spans(t):
    rows = t("documents").select("doc_id", "text", F.explode(dedup.personal_spans(F.col("text"))).alias("s"))
    return rows.select("doc_id", "s.kind", F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("hit"))


@query(
    r"""SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://[^/]*/([a-z]+)/', 1) AS section, count(*) AS n, count(*) FILTER (regexp_extract(regexp_extract(url, '^[^?#]*'), '[^./]((\.[^./]+)+)$', 1) = '.html') AS html FROM pages GROUP BY ALL"""
)
def url_groups(t):
    host, section = F.regexp_extract("url", "://([^/?#]*)", 1), F.regexp_extract("url", "://[^/]*/([a-z]+)/", 1)
    ext = cleaning.compound_extension(F.regexp_extract("url", r"^[^?#]*", 0))
    return t("pages").groupBy(host.alias("host"), section.alias("section")).agg(F.count(F.lit(1)).alias("n"), F.count_if(ext == ".html").alias("html"))


# --- declared pipelines, event windows, relations ---------------------------------------------------------------------


@query("SELECT doc_id, lang, n_chars, CASE WHEN n_chars <= 1000 THEN 'short' ELSE 'long' END AS \"group\" FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents WHERE source <> 'src4') WHERE (lang = 'en' AND r <= 50) OR (lang = 'es' AND r <= 20)")
def pipeline_demo(t):
    config = {
        "pipeline": [
            {"id": "remove_json_keys", "args": {"keys_to_remove": ["text"]}},
            {"id": "document_filter", "args": {"exclude": ['.source == "src4"']}},
            {"id": "sampler", "args": {"value_to_samples": {"en": 50, "es": 20}, "value": "lang", "order": ["doc_id"]}},
            {"id": "grouper", "args": {"group_to_jsonpath": {"short": "$[?(@.n_chars <= 1000)]", "long": "$[?(@.n_chars > 1000)]"}}},
            {"id": "filter_json_keys", "call_kwargs": {"keys_to_keep": ["doc_id", "lang", "n_chars", "group"]}},
        ]
    }
    return pipeline.run(config, t("documents"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS \"end\", event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def event_windows(t):
    return incremental.windowed_counts(t("events"), "1 day").withColumn("total", F.round("total", 6))


@query(
    """SELECT c_mktsegment, r_name, count(*) AS orders, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderdate >= DATE '1995-01-01' GROUP BY ALL"""
)
def revenue_by_segment(t):
    lines = t("lineitem").join(t("orders").filter("o_orderdate >= DATE '1995-01-01'"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = lines.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("c_mktsegment", "r_name").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("revenue"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def top_orders(t):
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return t("orders").withColumn("r", place).filter("r <= 3").select("o_custkey", "o_orderkey", "o_totalprice")


from quern.plans import evaluation_catalog  # noqa: E402, F401  (registers its queries)

from quern.plans import corpus_catalog  # noqa: E402, F401  (registers its queries)
