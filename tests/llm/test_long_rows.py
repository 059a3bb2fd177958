"""Rows of extreme length: runs of white space, hosts of dots, words without an end."""

import resource

import numpy as np
import pytest

from quern.llm import packing, token_counts, toxicity, url_filter


def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("blank", [" ", "\t", "\n", " ", "\r\n"])
def test_runs_of_white_space_have_the_library_ids(blank):
    encode, of, lib = packing.public_bpe(), token_counts.public_lengths(), library()
    for n in (packing.BLANKS - 1, packing.BLANKS, 40_000):
        for text in (blank * n, blank * n + "end", "start" + blank * n, f"a{blank * n}<|endoftext|>{blank * n}b"):
            assert encode([text])[0] == lib.encode(text, add_special_tokens=False).ids
            assert of(text).sum() == len(text.encode()) and len(of(text)) == len(encode([text])[0])


def test_five_million_blanks_in_spark(spark):
    rows = [(1, " " * 5_000_000), (2, "ab <|endoftext|> cd"), (3, "\n" * 1_100_000 + "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: len(library().encode(t, add_special_tokens=False).ids) for i, t in rows}
    packed = packing.pack(df, payload="none").groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] - 1 for r in packed} == want
    counted = token_counts.section_tokens(df, sections=lambda t: (np.array([0]), np.array([len(t)]))).groupBy("doc_id").sum("tokens").collect()
    assert {r[0]: int(r[1]) for r in counted} == want


def test_hosts_of_dots(tmp_path):
    (tmp_path / "f").write_bytes(url_filter.build([("example.org/es/", "block", True), ("bad.com", "block", False)]))
    index = url_filter.DigestArray(str(tmp_path / "f"))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    hosts = ["a." * 500_000 + "bad.com", "." * 1_000_000, "x.example.org", "." * 1_000_000 + "example.org", "xbad.com"]
    rules, verdicts = url_filter._judged(index, hosts, ["/", "/es/", "/es/1", "/es/", "/"], "allow")
    assert rules == [None, None, "example.org/es/", "example.org/es/", None] and verdicts == ["block", "allow", "block", "block", "allow"]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000


def test_a_long_word_is_judged_in_bounded_memory():
    machine = toxicity.SequenceMachine()
    machine.weights[:] = 0.01
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    long = "abcdefghijk" * 300_000
    assert machine.margins([long, "abc"])[0] > machine.margins(["abc"])[0] > -1
    machine.features([long])
    assert all(len(w) <= toxicity.WINDOW for w in machine._known)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000
