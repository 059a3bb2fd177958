"""URL rules against a plain loop; the subpackage's queries against their SQL and the pipeline's stages."""

from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import queries, url_filter

BLOCKED = url_filter.hosts_in(queries.BLOCK_LIST)


def plain(url, rules, blocked):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    under = lambda h: host == h or host.endswith("." + h)
    fits = [(len(r), r, v) for v, r in rules if under(r[: r.index("/")]) and path.startswith(r[r.index("/") :])]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    # a listed host is meant whole: its home page, which has no path, and its other ports too
    name = host.rsplit("@", 1)[-1]
    name = name[: name.rindex(":")] if ":" in name and not name[name.rindex(":") + 1 :].strip("0123456789") else name
    return host, path, None, "block" if any(name == h or name.endswith("." + h) for h in blocked) else "allow"


URLS = ["http://casino-win.example.com", "http://casino-win.example.com?a=1", "http://casino-win.example.com:80/x", "http://u:p@casino-win.example.com/", "http://u@x.casino-win.example.com:", "http://casino-win.example.com:80x/", None, "", "no scheme", "http://EXAMPLE.org", "https://www.example.org/es/1?x#y", "http://a.example.org/en/15", "http://b.com/fr/", "http://b.com/de/x", "x://org/", "ftp://notexample.org/es/", "http://h?q/org/", "http://cheap-pills.example.com/en/1", "http://x.cheap-pills.example.com/fr/1", "a://b://example.org/es/", "http://é.org/\n", "http://" + "a." * 200 + "org/" + "p" * 5_000]


def test_verdicts_equal_a_plain_loop(spark):
    rows = [(i, u, "clash") for i, u in enumerate(URLS * 2)] + [(None, URLS[4], "clash")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    out = url_filter.url_verdicts(pages, queries.URL_RULES, BLOCKED).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == plain(r["url"], queries.URL_RULES, BLOCKED)
    assert url_filter.url_verdicts(pages.limit(0), queries.URL_RULES).count() == 0
    assert {r["verdict"] for r in url_filter.url_verdicts(pages, ()).collect()} == {"allow"}


def test_blocked_hosts_are_blocked_without_a_path(spark):
    """Of the block list every URL of a host is meant; a rule fits only a path."""
    want = {
        "http://spam-farm.example.com": "block",
        "http://spam-farm.example.com/": "block",
        "http://casino-win.example.com?ref=1": "block",
        "http://a.b.free-bets.example.com#top": "block",
        "http://notfree-bets.example.com": "allow",
        "http://example.com": "allow",
        "http://b.example.org": "allow",
        "http://own.example.org/x": "allow",
        "http://own.example.org": "block",
        "spam-farm.example.com": "allow",
        "://": "allow",
        "http://casino-win.example.com:80/x": "block",
        "http://u@casino-win.example.com/": "block",
        "http://u:p@a.casino-win.example.com:8080": "block",
        "http://casino-win.example.com@b.example/": "allow",
    }
    pages = spark.createDataFrame([(u,) for u in want], "url string")
    out = url_filter.url_verdicts(pages, queries.URL_RULES, (*BLOCKED, "own.example.org")).collect()
    assert {r["url"]: r["verdict"] for r in out} == want
    assert {r["url"]: r["rule"] for r in out if r["rule"]} == {"http://own.example.org/x": "org/"}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ab./", min_size=1, max_size=6).map(lambda s: s + "/"), max_size=12), st.lists(st.text("ab./", max_size=7), max_size=12))
def test_array_finds_what_it_holds(tmp_path_factory, entries, probes):
    path = str(tmp_path_factory.mktemp("index") / "i")
    Path(path).write_bytes(url_filter.build([(e, "block", True) for e in entries]))
    index = url_filter.DigestArray(path)
    asked = [p.encode() for p in probes + entries]
    assert [f >= 0 for f in index.find(asked)] == [p.decode() in entries for p in asked]


def test_equal_digests_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda x: 7)
    (tmp_path / "i").write_bytes(url_filter.build([("a/", "block", True), ("b/", "allow", True)]))
    index = url_filter.DigestArray(str(tmp_path / "i"))
    found = index.find([b"b/", b"c/", b"a/"])
    assert found[1] == -1 and {VERDICT(index, found[0]), VERDICT(index, found[2])} == {"allow", "block"}


def VERDICT(index, at):
    return url_filter.VERDICTS[int(index.marks[at]) & 1]


def cells(frame):
    names = sorted(frame.columns)
    norm = lambda v: v.tolist() if isinstance(v, np.ndarray) else None if pd.isna(v) else round(float(v), 6) if isinstance(v, (int, float, np.number)) else str(v)
    return names, sorted(repr([norm(v) for v in row]) for row in frame[names].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert cells(queries.QUERIES[name](spark, sf).toPandas()) == cells(con.execute(queries.ORACLES[name]).df())


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]


def test_pipeline_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, counts = docs.columns, [docs.count()]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{n}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{n}")
        counts.append(docs.count())
        if n < 3:
            assert docs.columns == names and docs.join(before, ["doc_id", "text"], "left_anti").count() == 0
    assert counts[0] > counts[1] > counts[2] >= counts[3] > 0
    texts = spark.read.parquet(f"{tmp_path}/2").groupBy("text").count().filter("count > 1")
    assert texts.count() == 0
    words = lambda d: d.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert abs(words(spark.read.parquet(f"{tmp_path}/3")) - 1.5 * words(spark.read.parquet(f"{tmp_path}/2"))) < 20
    parts = docs.toPandas()
    for _, s in parts.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert (s["offset"].to_numpy() == np.concatenate([[0], np.cumsum(s["length"])[:-1]])).all() and s["length"].sum() <= 1024
