"""More registered queries, each beside its SQL: judging and scores, prompts and choices, files and shards, token streams."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import cleaning, scoring
from quern.functions.tokens import tokens
from quern.operators import contamination, curation
from quern.operators import training_examples as examples
from quern.operators.staging import shared_folder, staged
from quern.plans.catalog import LOSS_SQL, PACK_SQL, SPANS_SQL, VOCAB_SQL, WORDS, _encoded, _grams_sql, _packed, _spans, query
from quern.sources import documents, token_files
from quern.streaming import incremental


def _folder(name: str) -> str:
    """A new place in the shared folder."""
    return f"{shared_folder(SparkSession.getActiveSession())}/{name}-{uuid.uuid4().hex}"


# --- judging ----------------------------------------------------------------------------------------------------------

ANSWERS_SQL = """WITH a AS (SELECT doc_id % 40 AS question_id, lang AS model, min(doc_id) AS answer FROM documents GROUP BY ALL),
q AS (SELECT item_id AS question_id, text AS question, CASE WHEN item_id % 2 = 0 THEN text END AS reference FROM benchmark)"""


def _judged(t):
    answers = t("documents").groupBy((F.col("doc_id") % 40).alias("question_id"), F.col("lang").alias("model")).agg(F.min("doc_id").alias("answer"))
    questions = t("benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    references = questions.filter("question_id % 2 = 0").withColumnRenamed("question", "reference")
    return answers, questions, references


@query(f"{ANSWERS_SQL} SELECT question_id, x.model AS model_1, y.model AS model_2, x.answer AS answer_1, y.answer AS answer_2, question, reference FROM a x JOIN a y USING (question_id) JOIN q USING (question_id) WHERE x.model < y.model")
def judge_pairs(t):
    return scoring.judge_pairs(*_judged(t))


@query(f"{ANSWERS_SQL} SELECT question_id, x.model AS model_1, y.model AS model_2, x.answer AS answer_1, y.answer AS answer_2, question, reference FROM a x JOIN a y USING (question_id) JOIN q USING (question_id) WHERE x.model <> 'en' AND y.model = 'en'")
def judge_baseline(t):
    return scoring.judge_pairs(*_judged(t), baseline="en")


@query(f"{ANSWERS_SQL} SELECT question_id, model, answer, question, reference FROM a JOIN q USING (question_id)")
def judge_single(t):
    return scoring.judge_single(*_judged(t))


@query("SELECT event_type || ':' || user_id % 10 AS key, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def later_wins(t):
    key = F.concat("event_type", F.lit(":"), (F.col("user_id") % 10).cast("string"))
    return scoring.later_wins(t("events").select(key.alias("key"), "value", "event_id"), "event_id")


@query(
    "SELECT event_type, round((avg((value > 5)::INT) + avg((value > 10)::INT) + avg((value > 15)::INT) + avg((value > 20)::INT)) / 4, 9) AS final_acc FROM events GROUP BY event_type"
)
def instruction_score(t):
    rates = [F.avg((F.col("value") > x).cast("int")) for x in (5, 10, 15, 20)]
    return t("events").groupBy("event_type").agg(F.round(scoring.mean_of_rates(*rates), 9).alias("final_acc"))


@query("SELECT event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) = 1")
def latest_checkpoint(t):
    return scoring.latest(t("events").select("event_type", "event_id", "value", "ts"), ["ts", "event_id"], ["event_type"]).drop("ts")


@query("SELECT event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) = 1")
def best_checkpoint(t):
    return scoring.best(t("events").select("event_type", "event_id", "value"), "value", ["event_id"], ["event_type"])


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 25")
def top_scores(t):
    return curation.first_rows(t("events").select("event_id", "value"), 25, F.desc("value"), "event_id")


DOUBT_SQL = "r AS (SELECT n_chars % 97 / 97.0::DOUBLE AS doubt, (doc_id % 4)::DOUBLE / 3.0::DOUBLE AS score, doc_id % 5 <> 0 AS has FROM documents)"


@query(
    f"""WITH {DOUBT_SQL}, g AS (SELECT doubt, sum(CASE WHEN has THEN score ELSE -1 END) AS g FROM r GROUP BY doubt), c AS (SELECT doubt, sum(g) OVER (ORDER BY doubt) AS x FROM g),
b AS (SELECT round(x, 9) AS x, doubt FROM c ORDER BY round(x, 9) DESC, doubt LIMIT 1)
SELECT round(100.0::DOUBLE * ((SELECT count(*) FILTER (NOT has) FROM r) + greatest(x, 0)) / (SELECT count(*) FROM r), 6) AS best, CASE WHEN x > 0 THEN round(doubt, 9) ELSE 0.0 END AS threshold FROM b"""
)
def best_threshold(t):
    rows = t("documents").select((F.col("n_chars") % 97 / 97.0).alias("doubt"), ((F.col("doc_id") % 4).cast("double") / 3.0).alias("score"), (F.col("doc_id") % 5 != 0).alias("has_answer"))
    return scoring.best_threshold(rows).select(F.round("best", 6).alias("best"), F.round("threshold", 9).alias("threshold"))


@query(
    """WITH r AS (SELECT (n_chars % 2)::DOUBLE AS exact, (n_chars % 7)::DOUBLE / 6 AS f1, doc_id % 3 > 0 AS h FROM documents)
SELECT round(100 * avg(exact), 6) AS exact, round(100 * avg(f1), 6) AS f1, round(100 * avg(exact) FILTER (h), 6) AS "HasAns_exact", round(100 * avg(f1) FILTER (h), 6) AS "HasAns_f1",
round(100 * avg(exact) FILTER (NOT h), 6) AS "NoAns_exact", round(100 * avg(f1) FILTER (NOT h), 6) AS "NoAns_f1" FROM r"""
)
def question_scores(t):
    rows = t("documents").select((F.col("n_chars") % 2).cast("double").alias("exact"), ((F.col("n_chars") % 7).cast("double") / 6).alias("f1"), (F.col("doc_id") % 3 > 0).alias("has_answer"))
    out = scoring.question_scores(rows)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("SELECT conv_id, round(list_sum([exp(-x / 1000) for x in l[1 : list_position(y, 0) - 1]]) / list_sum([exp(-x / 1000) for x in l]), 9) AS mass FROM (SELECT conv_id, list(length(text)::DOUBLE ORDER BY turn) AS l, list((role = 'user')::INT ORDER BY turn) AS y FROM conversations WHERE role <> 'system' GROUP BY conv_id) WHERE list_position(y, 0) > 1")
def truth_mass(t):
    rows = t("conversations").filter("role <> 'system'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", (-F.length("text") / 1000.0).alias("l"), (F.col("role") == "user").cast("int").alias("y")))).alias("c"))
    rows = rows.filter(F.array_position("c.y", 0) > 1)
    return rows.select("conv_id", F.round(scoring.true_mass(F.col("c.l"), F.col("c.y")), 9).alias("mass"))


@query("SELECT event_type, round(avg(value) * (6.0::DOUBLE * 1000000 + 12.0::DOUBLE * 2 * 4 * 16 * 512) / 312e12 * 1e6, 9) AS mfu FROM events GROUP BY event_type")
def utilisation(t):
    used = scoring.utilisation(F.col("value"), 1_000_000, 2, 4, 16, 512, scoring.PEAK_FLOPS["a100_bf16"])
    return t("events").groupBy("event_type").agg(F.round(used * 1e6, 9).alias("mfu"))


@query("SELECT p_partkey, (2 * w * 1000 + 4 * (4 * w + 2 * w * w + 2 * w * 2 * (w // 8) + 3 * w * 4 * w * 1))::BIGINT AS parameters FROM (SELECT p_partkey, (p_partkey % 16 + 1) * 8 AS w FROM part)")
def parameter_count(t):
    table = [((i + 1) * 8, scoring.parameter_count(4, 3, (i + 1) * 8, (i + 1) * 32, 8, 2, 1000)) for i in range(16)]
    known = F.create_map(*[F.lit(x) for pair in table for x in pair])
    return t("part").select("p_partkey", known[((F.col("p_partkey") % 16 + 1) * 8).cast("int")].cast("long").alias("parameters"))


@query("SELECT doc_id, i::INTEGER AS i FROM (SELECT doc_id, quality + toxic AS n FROM labels), unnest(range(n)) AS u(i)")
def expanded_scores(t):
    rows = t("labels").select("doc_id", (F.col("quality") + F.col("toxic")).alias("count"))
    out = documents.expanded_scores(rows, "doc_id", "count")
    return out.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("doc_id")) - 1).alias("i"))


@query(
    """WITH p AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN [n, ''] ELSE [] END AS a FROM (SELECT conv_id, turn, length(text)::VARCHAR AS n FROM conversations))
SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN length(text)::VARCHAR WHEN 1 THEN split_part(text, ' ', 1) || '|' || role ELSE trim(turn || ' May 2001') END AS spans FROM conversations"""
)
def gold_answers(t):
    text, kind = F.col("text"), F.col("turn") % 3
    answer = F.struct(
        F.when(kind == 0, F.length(text).cast("string")).otherwise("").alias("number"),
        F.when(kind == 1, F.array(F.substring_index(text, " ", 1), F.col("role"))).otherwise(F.array().cast("array<string>")).alias("spans"),
        F.col("turn").cast("string").alias("day"), F.lit("May").alias("month"), F.lit("2001").alias("year"),
    )
    return t("conversations").select("conv_id", "turn", F.array_join(F.element_at(scoring.gold_answers(F.array(answer)), 1), "|").alias("spans"))


@query("SELECT conv_id, turn, (a = b)::INT::DOUBLE AS exact, CASE WHEN a = b THEN 1.0 ELSE 0.0 END::DOUBLE AS f1 FROM (SELECT conv_id, turn, role AS a, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) WHERE b IS NOT NULL")
def spans_of_one_word(t):
    """Span scores where each answer is one span of one word: alike or not."""
    following = F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = t("conversations").select("conv_id", "turn", "role", following.alias("g")).filter("g IS NOT NULL")
    return rows.select("conv_id", "turn", scoring.spans_match(F.array("role"), F.array(F.array("g"))).alias("s")).select("conv_id", "turn", "s.*")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN (event_id % 50)::VARCHAR || '.0 items' ELSE lower(event_type) END AS answer FROM events")
def number_answers(t):
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("The "), (F.col("event_id") % 50).cast("string"), F.lit(". items"))).otherwise(F.concat(F.lit("a "), F.upper("event_type"), F.lit("!")))
    return t("events").select("event_id", cleaning.normal_answer_numbers(text).alias("answer"))


@query("SELECT conv_id, turn FROM conversations WHERE length(text) > 40 AND role = 'user'")
def registered_functions(t):
    """A function of the engine, registered by name and used from SQL."""
    rows = t("conversations")
    cleaning.register(rows.sparkSession)
    rows.createOrReplaceTempView("registered_turns")
    return rows.sparkSession.sql("SELECT conv_id, turn FROM registered_turns WHERE number_aware(role) = 'user' AND length(text) > 40")


# --- prompts and choices ----------------------------------------------------------------------------------------------


@query("SELECT item_id, 'Q' || item_id || ': ' || text || chr(10) || '{other} A:' AS prompt FROM benchmark")
def prompt_template(t):
    return t("benchmark").select("item_id", cleaning.filled("Q{number}: {question}\n{other} A:", number=F.col("item_id"), question=F.col("text")).alias("prompt"))


CHOICES_SQL = "c AS (SELECT item_id, string_split(text, ' ')[1:4] AS c, [(item_id % 4 = i)::INT for i in range(4)] AS y FROM benchmark)"


def _choices(t):
    words = F.slice(F.split("text", " "), 1, 4)
    marked = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.col("item_id") % 4 == i).cast("int"))
    return t("benchmark").select("item_id", words.alias("c"), marked.alias("y"))


@query(
    f"""WITH {CHOICES_SQL} SELECT item_id, 'A. ' || c[1] || chr(10) || 'B. ' || c[2] || chr(10) || 'C. ' || c[3] || chr(10) || 'D. ' || c[4] || chr(10) AS listed, chr((65 + item_id % 4)::INTEGER) AS "right",
c[item_id % 4 + 1] AS answer, array_to_string([trim(x) for x in c if trim(x) <> ''], '|') AS present FROM c"""
)
def listed_choices(t):
    rows = _choices(t)
    answer = cleaning.choice_text(F.col("c"), F.col("y"), F.lit(1))
    return rows.select("item_id", cleaning.listed_choices(F.col("c")).alias("listed"), cleaning.right_letters(F.col("y")).alias("right"), answer.alias("answer"), F.array_join(cleaning.choice_array(*[F.col("c")[i] for i in range(4)], F.lit(" ")), "|").alias("present"))


@query(
    f"""WITH {CHOICES_SQL}, s AS (SELECT item_id, unnest(c) AS c, unnest(range(4)) AS i FROM c), h AS (SELECT *, md5(item_id || ':' || i || ':0') AS h FROM s)
SELECT item_id, string_agg(c, '|' ORDER BY h) AS choices, chr((64 + arg_min(r, i))::INTEGER) AS answer FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY h) AS r FROM h) GROUP BY item_id"""
)
def shuffled_choices(t):
    mixed = cleaning.shuffled_choices(F.col("c")[0], F.slice("c", 2, 3), F.col("item_id"))
    return _choices(t).select("item_id", mixed.alias("m")).select("item_id", F.array_join("m.choices", "|").alias("choices"), "m.answer")


@query(r"SELECT item_id, regexp_replace(string_split(text, ' ')[3], '[^a-zA-Z,.]', '', 'g') AS last FROM benchmark")
def literal_lists(t):
    plain = F.transform(F.slice(F.split("text", " "), 1, 3), lambda w: F.regexp_replace(w, "[^a-zA-Z,.]", ""))
    written = F.concat(F.lit("['"), F.array_join(plain, "', '"), F.lit("']"))
    return t("benchmark").select("item_id", cleaning.last_literal(written).alias("last"))


@query("SELECT conv_id, md5(string_agg(text, chr(10) ORDER BY turn)) AS joined_md5 FROM conversations GROUP BY conv_id")
def joined_turns(t):
    turns = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("m"))
    return turns.select("conv_id", F.md5(cleaning.joined_turns(F.col("m.text")).cast("binary")).alias("joined_md5"))


@query(
    """SELECT doc_id, md5(CASE WHEN len(l) > 4 THEN array_to_string(l[2 : len(l) - 3], chr(10)) ELSE '' END) AS inner_md5, string_split(p, '.')[-1] = '' AS stopped, md5(b) AS before_md5 FROM (
SELECT doc_id, string_split(text, chr(10)) AS l, trim(split_part(text, chr(10), 1)) || CASE WHEN trim(split_part(text, chr(10), 1)) LIKE '%.' THEN '' ELSE '.' END AS p,
  array_to_string(string_split(trim(regexp_replace(lang || ' x  ' || source, '\\s+', ' ', 'g')), ' ')[:-2], ' ') AS b FROM documents WHERE trim(split_part(text, chr(10), 1)) <> '')"""
)
def line_cleaning(t):
    first = F.trim(F.substring_index("text", "\n", 1))
    rows = t("documents").filter(first != "")
    stopped = F.element_at(cleaning.with_periods(F.array(first, F.lit(" "))), 1).endswith(".")
    before = cleaning.before_last_word(F.concat("lang", F.lit(" x  "), "source"))
    return rows.select("doc_id", F.md5(cleaning.inner_lines(F.col("text")).cast("binary")).alias("inner_md5"), stopped.alias("stopped"), F.md5(before.cast("binary")).alias("before_md5"))


@query("SELECT item_id, replace(regexp_replace(replace(trim(x), ' [title]', '. '), '\\[.*?\\]', '', 'g'), '  ', ' ') AS clean FROM (SELECT item_id, split_part(text, ' ', 1) || ' [title] [step] ' || split_part(text, ' ', 2) || ' [substeps]  end' AS x FROM benchmark)")
def bracket_free(t):
    w = F.split("text", " ")
    return t("benchmark").select("item_id", cleaning.bracket_free(F.concat(w[0], F.lit(" [title] [step] "), w[1], F.lit(" [substeps]  end"))).alias("clean"))


@query("SELECT conv_id, turn, rtrim(c) AS context, substr(c, length(rtrim(c)) + 1) || role AS continuation FROM (SELECT conv_id, turn, role, split_part(text, ' ', 1) || repeat(' ', turn % 3) AS c FROM conversations)")
def context_split(t):
    context = F.concat(F.substring_index("text", " ", 1), F.repeat(F.lit(" "), (F.col("turn") % 3).cast("int")))
    return t("conversations").select("conv_id", "turn", cleaning.split_context(context, F.col("role")).alias("s")).select("conv_id", "turn", "s.*")


# --- files, shards, accounts ------------------------------------------------------------------------------------------


@query("SELECT doc_id, md5(text) AS text_md5, lang, source, n_chars FROM documents")
def jsonl_round_trip(t):
    """Written as gzipped JSON lines and read again with a schema."""
    docs, folder = t("documents"), _folder("jsonl")
    documents.write_jsonl(docs, folder)
    return documents.read_jsonl(docs.sparkSession, folder, docs.schema).select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "lang", "source", "n_chars")


@query("SELECT doc_id::VARCHAR AS id, lang AS kind, coalesce(source, '') AS source, 'none' AS created FROM documents")
def jsonl_binding(t):
    """JSON lines without a schema, bound to columns by paths, with a default for what they lack."""
    docs, folder = t("documents").select("doc_id", "lang", "source"), _folder("variant")
    documents.write_jsonl(docs, folder, "none")
    data = documents.read_jsonl(docs.sparkSession, folder)
    return documents.bind(data, {"id": "doc_id", "kind": "$.lang", "source": "source", "created": "absent"}, defaults={"created": F.lit("none")})


@query("SELECT count(*)::BIGINT AS num_docs, ceil(count(*) / 64)::BIGINT AS least_files, true AS within FROM documents")
def merged_files(t):
    """Files written anew with at most 64 rows each: all rows there, no file larger."""
    found = staged(documents.compact(t("documents").select("doc_id", "lang"), _folder("merged"), 64))
    return found.agg(F.sum("num_docs").alias("num_docs"), F.ceil(F.sum("num_docs") / 64).alias("least_files"), (F.max("num_docs") <= 64).alias("within"))


@query("SELECT doc_id, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1)::BIGINT AS line_num FROM documents")
def line_ordinals(t):
    """Documents with the number of their line in their file, read from one file a language."""
    docs, folder = t("documents").select("doc_id", "lang"), _folder("ordinals")
    documents.write_jsonl(docs.repartition(1).sortWithinPartitions("lang", "doc_id"), folder, "gzip", by="lang")
    return documents.read_jsonl(docs.sparkSession, f"{folder}/lang=*", "doc_id long", ordinals=True).select("doc_id", "line_num")


@query("SELECT page_id, replace(u, 'http://', 's3://bucket/') || CASE WHEN suffix(u, '.html') THEN '' ELSE '' END AS moved FROM (SELECT page_id, CASE WHEN suffix(url, '.html') THEN left(url, length(url) - 5) || '.jsonl.gz' ELSE url END AS u FROM pages) WHERE u LIKE 'http://%'")
def destinations(t):
    rows = t("pages").filter(F.col("url").startswith("http://"))
    return rows.select("page_id", documents.destination(F.col("url"), "http://", "s3://bucket/", {".html": ".jsonl.gz", "ml": ".x"}).alias("moved"))


@query("SELECT source || '-' || lang AS path FROM documents GROUP BY 1 HAVING count(*) FILTER (n_chars > 4000) = 0")
def empty_files(t):
    docs = t("documents").select(F.concat_ws("-", "source", "lang").alias("path"), "n_chars")
    return documents.empty_files(documents.indexing_accounts(docs, docs.filter("n_chars > 4000")))


@query("SELECT rank::INTEGER AS rank, string_agg(shard, ',' ORDER BY shard) AS shards FROM (SELECT unnest(range(1, 8)) AS shard), (SELECT unnest(range(3)) AS rank) WHERE shard % 3 = rank GROUP BY rank")
def shards_of_ranks(t):
    sharded = documents.shard_urls(t("pages").select("page_id"), 7, "page_id")
    return documents.shards_of_ranks(sharded, 3).select("rank", F.array_join(F.col("shards").cast("array<string>"), ",").alias("shards"))


@query(
    """WITH i AS (SELECT source, lang, CASE WHEN n_chars > 100 THEN text END AS text, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) - 1 AS i FROM documents)
SELECT source || '-' || lang || '-' || i AS id, source, lang AS split, i::INTEGER AS "index", md5(text) AS text_md5 FROM i WHERE text IS NOT NULL"""
)
def evaluation_documents(t):
    text = F.when(F.col("n_chars") > 100, F.col("text"))
    return documents.benchmark_documents(t("documents"), "doc_id", text, F.col("source"), F.col("lang")).select("id", "source", "split", "index", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(
    """WITH i AS (SELECT source AS task, CASE doc_id % 3 WHEN 0 THEN 'test' WHEN 1 THEN 'train' ELSE 'validation' END AS s, CASE WHEN n_chars > 500 THEN text END AS x FROM documents)
SELECT task, count(*) FILTER (s = 'test') AS test_n_total, count(x) FILTER (s = 'test') AS test_n_with_text, count(*) FILTER (s = 'test' AND x IS NULL) AS test_n_none,
count(*) FILTER (s = 'train') AS train_n_total, count(x) FILTER (s = 'train') AS train_n_with_text, count(*) FILTER (s = 'train' AND x IS NULL) AS train_n_none,
count(*) FILTER (s = 'validation') AS validation_n_total, count(x) FILTER (s = 'validation') AS validation_n_with_text, count(*) FILTER (s = 'validation' AND x IS NULL) AS validation_n_none FROM i GROUP BY task"""
)
def split_counts(t):
    split = F.when(F.col("doc_id") % 3 == 0, "test").when(F.col("doc_id") % 3 == 1, "train").otherwise("validation")
    items = t("documents").select(F.col("source").alias("task"), split.alias("s"), F.when(F.col("n_chars") > 500, F.col("text")).alias("x"))
    return documents.split_counts(items, "task", "s", "x").na.fill(0)


@query(
    """WITH p AS (SELECT source AS dataset, n_chars AS n, doc_id, doc_id % 5 = 0 AS dev FROM documents)
SELECT dataset, sum(CASE WHEN dev THEN n ELSE 0 END)::DOUBLE * 512 / 1e9 AS dev_tokens, sum(CASE WHEN dev THEN n ELSE 0 END)::DOUBLE / 1e6 AS dev_samples, sum(CASE WHEN dev THEN 0 ELSE n END)::DOUBLE / 1e6 AS train_samples,
count(*) FILTER (NOT dev) AS train_docs, round(sum(CASE WHEN dev THEN 0 ELSE n END)::DOUBLE / count(*) FILTER (NOT dev), 9) AS avg_samples_per_shard, round(sum(n)::DOUBLE / 1e6, 9) AS total_samples, round(sum(n)::DOUBLE * 512 / 1e9, 9) AS total_tokens FROM p GROUP BY dataset"""
)
def dataset_report_sizes(t):
    split = F.when(F.col("doc_id") % 5 == 0, "dev").otherwise("train")
    parts = t("documents").select(F.col("source").alias("dataset"), split.alias("split"), F.lit(1).alias("docs"), F.col("n_chars").alias("samples"), F.lit(1).alias("shards"), F.lit(0).alias("docs_dropped"), F.lit(1).alias("docs_before"), F.lit(True).alias("complete"))
    report = examples.dataset_report(parts, 512)
    return report.select("dataset", "dev_tokens", "dev_samples", "train_samples", "train_docs", *[F.round(c, 9).alias(c) for c in ("avg_samples_per_shard", "total_samples", "total_tokens")])


# --- splits and mixes -------------------------------------------------------------------------------------------------


@query(
    """WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id || ':0'), doc_id) - 1 AS p, count(*) OVER (PARTITION BY source) AS n FROM documents),
w(source, w) AS (VALUES ('src0', 1.0), ('src1', 2.0), ('src2', 1.5), ('src3', 3.1)), z AS (SELECT source, w, (SELECT count(*) FROM documents WHERE source IN ('src0', 'src1', 'src2', 'src3')) AS total FROM w),
s AS (SELECT source, total, total * w::DOUBLE / 7.6::DOUBLE AS share FROM z), f AS (SELECT source, floor(share) AS lo, row_number() OVER (ORDER BY floor(share) - share, source) AS k, total - sum(floor(share)) OVER () AS odd FROM s),
c AS (SELECT source, lo + (k <= odd)::INT AS want FROM f)
SELECT doc_id, source, e::INTEGER AS epoch FROM r JOIN c USING (source), unnest(range(ceil(greatest(want - p, 0) / n)::BIGINT)) AS u(e)"""
)
def mix_proportion(t):
    return curation.choose_proportions(t("documents").select("doc_id", "source"), {"src0": 1.0, "src1": 2.0, "src2": 1.5, "src3": 3.1}).select("doc_id", "source", "epoch")


@query("SELECT doc_id, (row_number() OVER (ORDER BY length(text) DESC, doc_id) - 1)::BIGINT AS place, (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS restored FROM documents")
def length_order(t):
    return curation.by_length(t("documents").select("doc_id", "text")).select("doc_id", "place", "restored")


# --- tokens, contamination, token streams -----------------------------------------------------------------------------


@query(
    rf"""WITH m AS (SELECT item_id, regexp_replace(regexp_replace(lower(text), '(\p{{L}})([''’.:·])(\p{{L}})', '\1' || chr(57344) || '\2\3', 'g'), '(\p{{L}})([''’.:·])(\p{{L}})', '\1' || chr(57344) || '\2\3', 'g') AS x FROM benchmark),
n AS (SELECT item_id, regexp_replace(regexp_replace(x, '(\p{{N}})([.,''])(\p{{N}})', '\1' || chr(57344) || '\2\3', 'g'), '(\p{{N}})([.,''])(\p{{N}})', '\1' || chr(57344) || '\2\3', 'g') AS x FROM m)
SELECT item_id, replace(array_to_string(regexp_extract_all(x, '[\p{{L}}\p{{M}}\p{{N}}_]+(?:' || chr(57344) || '[''’.:·,][\p{{L}}\p{{M}}\p{{N}}_]+)*'), '|'), chr(57344), '') AS tokens FROM n"""
)
def standard_tokens(t):
    return t("benchmark").select("item_id", F.array_join(tokens(F.col("text"), "standard"), "|").alias("tokens"))


GREEDY_SQL = SPANS_SQL.replace(
    "s AS (SELECT h.doc_id, a.e - a.l AS s, z.e AS e FROM h JOIN o a ON",
    "y AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY pos), e - l) AS f, coalesce(lead(e - l) OVER (PARTITION BY doc_id ORDER BY pos), e) AS t FROM o),\ns AS (SELECT h.doc_id, a.f AS s, z.t AS e FROM h JOIN y a ON",
).replace("JOIN o z ON", "JOIN y z ON")


@query(f'WITH {GREEDY_SQL} SELECT doc_id, "start", "end" FROM m')
def greedy_spans(t):
    return _spans(t, greedy=True).select("doc_id", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))


@query(
    f"""WITH a AS ({_grams_sql("benchmark", "item_id", 8)}), b AS ({_grams_sql("benchmark", "item_id", 13)})
SELECT item_id, pos::INTEGER AS pos, 8 AS n, md5(gram) AS gram_md5 FROM a WHERE item_id % 2 = 0 UNION ALL SELECT item_id, pos::INTEGER, 13, md5(gram) FROM b WHERE item_id % 2 = 1"""
)
def grams_by_source(t):
    items = t("benchmark").withColumn("task", F.when(F.col("item_id") % 2 == 0, "even").otherwise("odd"))
    grams = contamination.benchmark_grams(items, 13, sizes={"even": 8}, source="task")
    return grams.select("item_id", "pos", "n", F.md5(F.col("gram").cast("binary")).alias("gram_md5"))


@query(
    f"""WITH g AS ({_grams_sql("benchmark", "item_id", 13)}), r AS (SELECT *, row_number() OVER (ORDER BY item_id, pos) AS r FROM g)
SELECT item_id, count(*) AS grams, md5(string_agg(gram, '|' ORDER BY pos)) AS grams_md5 FROM r WHERE r > 100 GROUP BY item_id"""
)
def resume_grams(t):
    grams = contamination.benchmark_grams(t("benchmark"), 13)
    lists = grams.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("pos", "gram"))).alias("g")).select("item_id", F.col("g.gram").alias("ngrams"))
    left = incremental.remaining_grams(lists, 100, "item_id")
    return left.select("item_id", F.size("ngrams").cast("long").alias("grams"), F.md5(F.array_join("ngrams", "|").cast("binary")).alias("grams_md5"))


@query(f"{PACK_SQL} SELECT chunk::INTEGER AS chunk, example::INTEGER AS example, sum(c * (c + 1) / 2)::BIGINT AS seen FROM (SELECT chunk, example, doc, count(*) AS c FROM x GROUP BY ALL) GROUP BY chunk, example")
def boundary_masks(t):
    """Cells of each example's mask that are open; the SQL counts pairs within documents."""
    return _packed(t).select("chunk", "example", examples.open_cells(F.col("doc_ids")).alias("seen"))


@query(
    f"""{PACK_SQL}, w AS (SELECT f.chunk, d.source, count(*) AS c, min(f.r) AS first FROM f JOIN documents d USING (doc_id) GROUP BY ALL),
g AS (SELECT chunk, arg_max(source, c * 1000000 - first) AS source_id FROM w GROUP BY chunk)
SELECT DISTINCT 'shard-0-chunk-' || p.chunk || '-of-' || (SELECT chunks FROM c) || '-idx-' || p.example * 512 || '-to-' || (p.example + 1) * 512 AS uid, source_id FROM p JOIN g USING (chunk)"""
)
def pack_sources(t):
    encoded = _encoded(t).join(t("documents").select("doc_id", "source"), "doc_id")
    return examples.pack_stream(encoded, 512, 50_000, source=F.col("source")).select("uid", "source_id")


PACK_BY_SQL = f"""WITH {VOCAB_SQL}, l AS (SELECT doc_id, n, lang FROM n JOIN documents USING (doc_id)), t AS (SELECT lang, ceil(sum(n) / 20000) AS chunks, count(*) AS docs FROM l GROUP BY lang),
o AS (SELECT l.*, least(greatest(1, chunks), docs)::BIGINT AS chunks, docs, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS r FROM l JOIN t USING (lang)),
h AS (SELECT *, CASE WHEN r < docs % chunks * (docs // chunks + 1) THEN r // (docs // chunks + 1) ELSE docs % chunks + (r - docs % chunks * (docs // chunks + 1)) // (docs // chunks) END AS chunk FROM o)"""


@query(f"{PACK_BY_SQL} SELECT lang AS shard, chunk::INTEGER AS chunk, ((sum(n) - 1) // 256)::BIGINT AS examples FROM h GROUP BY lang, chunk HAVING (sum(n) - 1) // 256 > 0")
def pack_by_shard(t):
    encoded = _encoded(t).join(t("documents").select("doc_id", "lang"), "doc_id")
    return examples.pack_stream(encoded, 256, 20_000, shard="lang").groupBy("shard", "chunk").agg(F.count(F.lit(1)).alias("examples"))


@query(
    f"""WITH {VOCAB_SQL}, o AS (SELECT doc_id, n, (row_number() OVER (ORDER BY doc_id) - 1) // 70 AS part FROM n), f AS (SELECT doc_id, part, sum(n) OVER (PARTITION BY part ORDER BY doc_id) - n AS first FROM o),
l AS (SELECT part, sum(n) AS total FROM o GROUP BY part), s AS (SELECT part, first + pos AS tk, id, total FROM f JOIN e USING (doc_id) JOIN l USING (part))
SELECT part, (tk // 128)::INTEGER AS example, sum(id)::BIGINT AS input_sum, md5(string_agg(id, ',' ORDER BY tk)) AS inputs_md5 FROM s WHERE tk < (total - 1) // 128 * 128 GROUP BY part, tk // 128"""
)
def memmap_examples(t):
    folder = _folder("tokens")
    encoded = _encoded(t)
    token_files.write_token_files(encoded, folder, docs_per_part=70)
    made = token_files.examples(encoded.sparkSession, folder, 128)
    total = F.aggregate("inputs", F.lit(0).cast("long"), lambda a, x: a + x)
    return made.select(F.col("part").cast("long").alias("part"), F.col("example").cast("int").alias("example"), total.alias("input_sum"), F.md5(F.array_join(F.col("inputs").cast("array<string>"), ",").cast("binary")).alias("inputs_md5"))


@query(
    rf"""WITH b AS (SELECT item_id, [length(x) for x in regexp_extract_all(text, '{WORDS}')] AS i FROM benchmark WHERE item_id % 2 = 0), m AS (SELECT max(len(i)) + 1 AS w FROM b), y AS (SELECT item_id, list_append(i, (item_id % 4)::INTEGER) AS i FROM b)
SELECT array_to_string(list_concat(i, [0 for k in range(w - len(i))]), ',') AS input_ids, array_to_string([CASE WHEN k = len(i) - 2 THEN i[-1] ELSE -100 END for k in range(w)], ',') AS labels FROM y, m"""
)
def multiple_choice(t):
    ids = F.transform(F.regexp_extract_all("text", F.lit(WORDS), F.lit(0)), lambda w: F.length(w))
    task = F.when(F.col("item_id") % 2 == 0, "even").otherwise("odd")
    rows = t("benchmark").select(task.alias("task"), ids.alias("input_ids"), F.array((F.col("item_id") % 4).cast("int")).alias("target_ids"))
    out = examples.multiple_choice(rows, "even", 0)
    return out.select(*[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("input_ids", "labels")])


@query("SELECT conv_id, string_agg(CASE role WHEN 'user' THEN '50257' WHEN 'assistant' THEN '50258' ELSE '50259' END || ',50256', ',' ORDER BY turn) AS ids FROM conversations GROUP BY conv_id")
def special_token_ids(t):
    from quern.operators import chat

    table = examples.special_tokens(50_256, [chat.END, *chat.ROLES.values()])
    marks = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda m: F.array(chat.mark(m["role"]), F.lit(chat.END), F.lit("ordinary"))))
    rows = t("conversations").groupBy("conv_id").agg(marks.alias("w"))
    return rows.select("conv_id", F.array_join(examples.token_ids(F.col("w"), table).cast("array<string>"), ",").alias("ids"))


@query(
    f"""{LOSS_SQL}, r AS (SELECT conv_id, max(w.e)::BIGINT - 1 AS n FROM w GROUP BY conv_id)
SELECT conv_id, n AS num_labels, (n - (SELECT sum(least(s.e, n) - greatest(s.s, 0)) FROM s WHERE s.conv_id = r.conv_id))::BIGINT AS ignored FROM r WHERE conv_id IN (SELECT conv_id FROM s)"""
)
def masked_labels(t):
    from quern.operators import chat

    rows = chat.labels(t("conversations")).filter(F.exists("labels", lambda x: x != "-100"))
    return rows.select("conv_id", F.size("labels").cast("long").alias("num_labels"), F.size(F.filter("labels", lambda x: x == "-100")).cast("long").alias("ignored"))


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k"""
)
def event_sessions(t):
    return incremental.sessions(t("events"), "6 hours")


@query("SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 2 DAY")
def late_events(t):
    return t("events").filter(incremental.is_late(F.col("ts"), F.lit("2024-01-20 00:00:00").cast("timestamp"), "2 days")).select("event_id")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def small_customers(t):
    large = t("orders").filter("o_totalprice > 300000")
    return t("customer").join(large, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")
