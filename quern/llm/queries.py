"""The subpackage's queries: thin, each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import search
from .clustering import clusters_of
from .collocations import collocations
from .common import checkpointed, table
from .embedding_dedup import near_vectors
from .mixing import mix, words_in
from .packing import pack
from .quality import fit_quality, score_quality
from .secrets import fit_scanner, listed, secret_spans
from .sharding import shard_documents
from .simhash import hex_of, near_duplicates
from .token_counts import section_tokens
from .toxicity import fit_toxicity, score_toxicity
from .training import held_out
from .url_filter import hosts_in, url_verdicts

URL_RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
#: Hosts (with their subdomains) that are blocked where no rule fits: a file, so that a deployment can put in its own.
BLOCK_LIST = resources.files(__package__).joinpath("blocked_hosts.txt")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    field = fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = score_quality(docs, field).withColumn("held_out", held_out(F.col("doc_id")))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each line of each document; a token counts for the line of its first character."""
    found = section_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), rule="first")
    return found.select("doc_id", "section", "start", "end", F.col("tokens").cast("long").alias("tokens"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), payload="ids_crc32")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), 16)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", words_in(F.col("text")).alias("words"), F.xxhash64("text").alias("text"))
    return mix(checkpointed(docs), size=F.col("words")).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':11') AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w,
         source_size * 2.0::DOUBLE AS cap
  FROM s),
l AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
         row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS i
  FROM w),
f AS (SELECT level AS at_level FROM l WHERE level * w <= cap ORDER BY i LIMIT 1),
t AS (
  SELECT source, source_size, least(cap, coalesce((SELECT at_level FROM f) * w, cap)) AS target FROM l),
b AS (
  SELECT *, least(round(target)::BIGINT, source_size * 2) AS budget FROM t),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM b),
p AS (
  SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs, e.budget - e.epochs * e.source_size AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (epochs * size + least(size, greatest(0, rest - before)))::BIGINT AS taken
FROM p
"""


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = score_toxicity(docs, machine).withColumn("held_out", held_out(F.col("doc_id")))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES, hosts_in(BLOCK_LIST)).select("page_id", "host", "path", "rule", "verdict")


_RULES_SQL = ", ".join(f"('{v}', '{e[: e.index('/')]}', '{e[e.index('/') :]}')" for v, e in URL_RULES)
_BLOCKED_SQL = ", ".join(f"('{h}')" for h in hosts_in(BLOCK_LIST))
OP10_SQL = rf"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages),
r(verdict, h, t) AS (VALUES {_RULES_SQL}),
b(h) AS (VALUES {_BLOCKED_SQL}),
best AS (
  SELECT p.page_id, p.host, p.path, arg_max(r.h || r.t, length(r.h || r.t)) AS rule, arg_max(r.verdict, length(r.h || r.t)) AS verdict
  FROM p LEFT JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.t)
  GROUP BY ALL)
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE WHEN EXISTS (SELECT 1 FROM b WHERE bare = b.h OR ends_with(bare, '.' || b.h)) THEN 'block' ELSE 'allow' END) AS verdict
FROM (SELECT *, regexp_replace(regexp_replace(host, '^.*@', '', 's'), ':[0-9]*$', '') AS bare FROM best)
"""

def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"), least=30, longest=4, top=2_000)


OP11_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
f AS MATERIALIZED (
  SELECT lang, size, phrase, count(*) AS a
  FROM (SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase
        FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) AS s(size) WHERE len(w) >= size))
  GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, size, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND a >= 30),
u AS MATERIALIZED (
  SELECT lang, phrase, a, k, array_to_string(w[1 : k], ' ') AS lp, array_to_string(w[k + 1 : size], ' ') AS rp
  FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
k AS (
  SELECT u.lang, u.phrase, u.a, u.k, l.a AS l, r.a AS r, (u.a::HUGEINT * 2000000 // (l.a::HUGEINT + r.a))::BIGINT AS score
  FROM u JOIN f l ON l.lang = u.lang AND l.phrase = u.lp JOIN f r ON r.lang = u.lang AND r.phrase = u.rp),
b AS (SELECT lang, phrase, a, unnest(arg_min({'l': l, 'r': r, 'score': score}, score * 10 + k)) FROM k GROUP BY lang, phrase, a),
i AS (
  SELECT lang, array_to_string(w[j : j + m - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, w, a, m, unnest(range(1, size - m + 2)) AS j FROM c, (VALUES (2), (3)) AS t(m) WHERE m < size)
  GROUP BY ALL),
z AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM b LEFT JOIN i USING (lang, phrase) WHERE longer IS NULL OR 100 * longer::HUGEINT < 80 * a::HUGEINT)
SELECT lang, rank, phrase, a, l, r, n, score FROM z JOIN n USING (lang) WHERE rank <= 2000
"""


def op12_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters_of(table(spark, sf_dir, "embeddings"), components=64, scale=64, clusters=16, rounds=3, seed=1)


def _clustering_sql(components: int, scale: int, clusters: int, rounds: int, seed: int) -> str:
    """Lloyd's rounds one after another. v: vectors; c0, c1, ...: centroids; g0, g1, ...: each vector's cluster."""
    parts = [
        f"""v AS (
  SELECT row_number() OVER () AS i, vec_id, embedding AS raw, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = {components} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {components})""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, raw) - 1 AS k, v AS c FROM v ORDER BY k LIMIT {clusters})",
    ]
    for n in range(rounds + 1):
        parts.append(
            f"""g{n} AS (
  SELECT i, arg_min(k, d * {clusters} + k) AS k, min(d) AS d
  FROM (SELECT i, k, list_sum(list_transform(list_zip(v, c), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT AS d FROM v, c{n}) GROUP BY i)"""
        )
        if n < rounds:
            parts.append(
                f"""m{n} AS (
  SELECT k, j, sum(x)::BIGINT AS s, count(*) AS n
  FROM (SELECT k, unnest(v) AS x, unnest(range(1, {components + 1})) AS j FROM v JOIN g{n} USING (i)) GROUP BY k, j),
a{n} AS (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY j) AS c FROM m{n} GROUP BY k),
c{n + 1} AS (SELECT k, coalesce(a{n}.c, c{n}.c) AS c FROM c{n} LEFT JOIN a{n} USING (k))"""
            )
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, k::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY k)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM v JOIN g{rounds} USING (i) JOIN c{rounds} USING (k)"""


OP12_SQL = _clustering_sql(64, 64, 16, 3, 1)


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_spans(docs, fit_scanner(docs)).select("doc_id", "findings")

    def number(kind: str) -> Column:
        return F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long")

    base = F.filter("findings", lambda f: f["kind"] != "model")
    return found.select("doc_id", *[number(k).alias(f"n_{k}") for k in ("assign", "access", "hex", "model")], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("findings")).alias("spans"))


#: All pairs of a label, exactly.
OP5_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b
  FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.93),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT v.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON c.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_token_counts": op2_token_counts,
    "op3_packing": op3_packing,
    "op4_sharding": op4_sharding,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_ann": op6_ann,
    "op7_simhash": op7_simhash,
    "op8_mixing": op8_mixing,
    "op9_toxicity": op9_toxicity,
    "op10_url_filters": op10_url_filters,
    "op11_collocations": op11_collocations,
    "op12_clustering": op12_clustering,
    "op13_secrets": op13_secrets,
}
ORACLES: dict[str, str] = {"op5_embedding_dedup": OP5_SQL, "op8_mixing": OP8_SQL, "op10_url_filters": OP10_SQL, "op11_collocations": OP11_SQL, "op12_clustering": OP12_SQL}
