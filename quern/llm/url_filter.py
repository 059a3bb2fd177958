"""URL rules in a sorted array of 64-bit digests, memory-mapped by each Python worker.

An entry is a host (with all its subdomains) and the start of a path, with a verdict. The file holds, after a header,
the sorted xxhash64 keys of the entries' full strings, their places in a blob, their verdicts and the blob itself. A
URL's candidates are its host's suffixes, at label borders and no longer than the longest stored host, times the path lengths that entries have. A host of the
block list is stored without a path, and found by the suffixes of the host less user and port, so that it holds for
every URL of the host, with a path or without; a rule needs a path to fit. A batch of candidates is hashed, looked up by
one vectorised binary search, and each hit is confirmed against the stored string, so that a digest collision decides
nothing. The file is written to the shared folder and goes to every executor through SparkContext.addFile: it is fetched
again by executors that join later, and pages of it are read only where probed, whatever its size. It is built by the
driver, which holds the entries once: 100 bytes or so each.

Defined results: a null url or one without ``://`` has an empty host and path, no rule and the default verdict; rules
of one string given twice are one rule (the first counts); the longest fitting entry wins, by characters of host and path
together, then by the longer host. Extra columns pass through; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from importlib.resources.abc import Traversable
from pathlib import Path

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.staging import published

VERDICTS = ("allow", "block")
_MAGIC = b"QUERNDX2"
_OPEN: dict[str, DigestArray] = {}


class DigestArray:
    """The file, opened: keys, places, verdicts, whether an entry is a rule, blob, and the length of the longest host."""

    def __init__(self, path: str):
        head = np.fromfile(path, dtype="<u8", count=5)
        assert head[0].tobytes() == _MAGIC, "not a digest array"
        n, lengths, blob, self.longest = (int(x) for x in head[1:])
        at = 40
        self.lengths = np.fromfile(path, dtype="<u4", count=lengths, offset=at).tolist()
        at += 4 * lengths
        self.keys = np.memmap(path, "<u8", "r", at, (n,)) if n else np.zeros(0, "<u8")
        self.places = np.memmap(path, "<u8", "r", at + 8 * n, (n + 1,))
        at += 8 * n + 8 * (n + 1)
        self.marks = np.memmap(path, "u1", "r", at, (n,)) if n else np.zeros(0, "u1")
        self.blob = np.memmap(path, "u1", "r", at + n, (blob,)) if blob else np.zeros(0, "u1")

    def find(self, candidates: list[bytes]) -> np.ndarray:
        """The index of each candidate's entry, or -1."""
        hashed = np.fromiter(map(xxhash.xxh64_intdigest, candidates), np.uint64, len(candidates))
        at = np.searchsorted(self.keys, hashed)
        found = np.full(len(candidates), -1, np.int64)
        if not len(self.keys):
            return found
        for i in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == hashed):
            k = int(at[i])
            while k < len(self.keys) and self.keys[k] == hashed[i]:  # equal digests lie side by side
                if self.blob[self.places[k] : self.places[k + 1]].tobytes() == candidates[i]:
                    found[i] = k
                    break
                k += 1
        return found


def build(entries: Iterable[tuple[str, str, bool]]) -> bytes:
    """The file's content. entries: (host and path, like ``example.org/es/``, or a host alone; verdict; whether it is reported as a rule)."""
    first: dict[bytes, int] = {}
    for text, verdict, is_rule in entries:
        first.setdefault(text.encode(), VERDICTS.index(verdict) + 2 * is_rule)
    order = sorted((xxhash.xxh64_intdigest(text), text, mark) for text, mark in first.items())
    lengths = sorted({len(text.decode()) - text.decode().index("/") for text in first if b"/" in text})
    blob = b"".join(text for _, text, _ in order)
    places = np.cumsum([0, *(len(text) for _, text, _ in order)]).astype("<u8")
    longest = max((len(text.decode().partition("/")[0]) for text in first), default=0)
    head = _MAGIC + np.array([len(order), len(lengths), len(blob), longest], "<u8").tobytes() + np.array(lengths, "<u4").tobytes()
    return head + np.array([k for k, _, _ in order], "<u8").tobytes() + places.tobytes() + np.array([m for _, _, m in order], "u1").tobytes() + blob


def hosts_in(path: str | Path | Traversable) -> list[str]:
    """The hosts of a block list: a text file with one a line; blank lines and what follows ``#`` don't count."""
    file = Path(path) if isinstance(path, str) else path
    lines = (line.partition("#")[0].strip().lower() for line in file.read_text(encoding="utf-8").splitlines())
    return [host for host in lines if host]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


_USER, _PORT = re.compile(r"(?s)^.*@"), re.compile(r":[0-9]*$")


def bare(host: str) -> str:
    """The host less user and port."""
    return _PORT.sub("", _USER.sub("", host))


def _suffixes(host: str, longest: int) -> Iterator[str]:
    """The host and its suffixes at label borders, of the length that a stored host may have: others fit nothing."""
    if len(host) <= longest:
        yield host
    at = host.find(".", max(0, len(host) - longest - 1))
    while at >= 0:
        yield host[at + 1 :]
        at = host.find(".", at + 1)


def _judged(index: DigestArray, hosts: list[str], paths: list[str], default: str) -> tuple[list, list]:
    owner: list[int] = []
    rank: list[tuple[int, int]] = []
    candidates: list[bytes] = []
    for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
        if host:
            listed = ((suffix, 0) for suffix in _suffixes(bare(host), index.longest))
            ruled = ((suffix, n) for suffix in _suffixes(host, index.longest) for n in index.lengths if n <= len(path))
            for suffix, n in (*listed, *ruled):
                owner.append(i)
                rank.append((len(suffix) + n, len(suffix)))
                candidates.append((suffix + path[:n]).encode("utf-8", "surrogatepass"))
    rules: list = [None] * len(hosts)
    verdicts = [default] * len(hosts)
    best: dict[tuple[int, int], tuple[int, int]] = {}
    found = index.find(candidates)
    for c in np.flatnonzero(found >= 0):
        k, i = int(found[c]), owner[c]
        mark = int(index.marks[k])
        kind = mark >> 1
        if rank[c] > best.get((i, kind), (-1, -1)):
            best[i, kind] = rank[c]
            if kind or (i, 1) not in best:  # a rule outranks the block list, whatever their lengths
                verdicts[i] = VERDICTS[mark & 1]
                rules[i] = candidates[c].decode("utf-8", "surrogatepass") if kind else None
    return rules, verdicts


def url_verdicts(pages: DataFrame, rules: Iterable[tuple[str, str]], blocked_hosts: Iterable[str] = (), url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict. rules: (verdict, entry). blocked_hosts decide where no rule fits."""
    content = build([*((e, v, True) for v, e in rules), *((h, "block", False) for h in blocked_hosts)])
    sc = pages.sparkSession.sparkContext
    name = f"digests-{xxhash.xxh64_hexdigest(content)}"
    if not any(f.endswith(f"/{name}") for f in sc.listFiles):
        sc.addFile(published(pages.sparkSession, name, content))

    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        index = _OPEN.get(name) or _OPEN.setdefault(name, DigestArray(SparkFiles.get(name)))
        for hosts, paths in batches:
            found, verdicts = _judged(index, hosts.tolist(), paths.tolist(), default)
            yield pd.DataFrame({"rule": pd.Series(found, dtype=object), "verdict": verdicts})

    judged = F.pandas_udf(judge, "rule string, verdict string")
    parts = pages.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    return parts.withColumn("_j", judged("host", "path")).withColumn("rule", F.col("_j.rule")).withColumn("verdict", F.col("_j.verdict")).drop("_j")
