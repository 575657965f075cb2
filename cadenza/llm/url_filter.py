"""Operator 8: URL filters by a bit-parallel wildcard automaton.

Glob rules (`*` any run without '/', `**` any run, `?` one character but '/') become one bit for
each literal or class and one for the start; all rules lie side by side in 64-bit words.  One
step of a character is a shift with carry across the words, an AND with the character's mask,
and an OR with the states that may loop on it, for all rules and a whole batch of URLs at once:
    D = ((D << 1) & step[c]) | (D & loop[c])
A URL leaves the loop when it ends, when no state is alive, or when only accepting states that
loop on every character are.

Contract of `judged`: null URLs and URLs without "://" have empty host and path; rows are judged
one by one, so repeated rows get equal results; empty tables give empty results; very long URLs
are judged whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents

_U = np.uint64


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with all its subdomains and a path prefix, written host/path."""

    verdict: str
    target: str

    def globs(self) -> list[str]:
        return [f"{self.target}**", f"*.{self.target}**"]


class WildcardAutomaton:
    """All globs at once over byte strings; `run` gives a (strings, globs) table of whole matches."""

    def __init__(self, globs: list[str]):
        self.accept: list[int] = []
        starts = []
        loops: dict[int, np.ndarray] = {}
        steps: dict[int, np.ndarray] = {}
        everything, segment = np.ones(256, dtype=bool), np.ones(256, dtype=bool)
        segment[ord("/")] = False
        at = 0
        for glob in globs:
            starts.append(at)
            i, raw = 0, glob.encode()
            while i < len(raw):
                c = raw[i : i + 1]
                if c == b"*":
                    double = raw[i : i + 2] == b"**"
                    loops[at] = loops.get(at, np.zeros(256, dtype=bool)) | (everything if double else segment)
                    i += 1 + double
                    continue
                at += 1
                steps[at] = segment if c == b"?" else np.arange(256) == c[0]
                i += 1
            self.accept.append(at)
            at += 1
        self.words = max(1, -(-at // 64))
        self.step = np.zeros((256, self.words), dtype=_U)
        self.loop = np.zeros((256, self.words), dtype=_U)
        self.first = np.zeros(self.words, dtype=_U)
        self.settled = np.zeros(self.words, dtype=_U)
        for table, classes in ((self.step, steps), (self.loop, loops)):
            for bit, chars in classes.items():
                table[chars, bit // 64] |= _U(1) << _U(bit % 64)
        for bit in starts:
            self.first[bit // 64] |= _U(1) << _U(bit % 64)
        for bit in self.accept:
            if bit in loops and loops[bit].all():
                self.settled[bit // 64] |= _U(1) << _U(bit % 64)

    def run(self, strings: list[bytes]) -> np.ndarray:
        n = len(strings)
        size = np.array([len(s) for s in strings], dtype=np.int64)
        text = np.frombuffer(b"".join(strings), dtype=np.uint8)
        begin = np.concatenate([[0], np.cumsum(size)])[:-1]
        state = np.tile(self.first, (n, 1))
        rows = np.flatnonzero(size > 0)
        at = 0
        while len(rows):
            c = text[begin[rows] + at]
            held = state[rows]
            moved = held << _U(1)
            moved[:, 1:] |= held[:, :-1] >> _U(63)
            held = (moved & self.step[c]) | (held & self.loop[c])
            state[rows] = held
            at += 1
            rows = rows[((held & ~self.settled).any(axis=1)) & (size[rows] > at)]
        out = np.zeros((n, len(self.accept)), dtype=bool)
        for j, bit in enumerate(self.accept):
            out[:, j] = (state[:, bit // 64] >> _U(bit % 64)) & _U(1)
        return out


_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): host lower-cased (A-Z), both without query and fragment."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    for mark in "?#":
        rest = rest.partition(mark)[0]
    host, slash, path = rest.partition("/")
    return host.encode().translate(_LOWER).decode(), slash + path


class UrlJudge:
    """Longest fitting rule of a URL, else the verdict of the method's own globs, else `otherwise`."""

    def __init__(self, rules: list[Rule], own: list[tuple[str, str]], otherwise: str):
        ranked = sorted(rules, key=lambda r: len(r.target), reverse=True)
        self.names = [r.target for r in ranked]
        self.verdicts = [r.verdict for r in ranked] + [v for v, _ in own] + [otherwise]
        globs = [g for r in ranked for g in r.globs()]
        self.rule_globs = len(globs)
        self.automaton = WildcardAutomaton([*globs, *(g for _, g in own)])

    def judge(self, urls: list[str | None]) -> tuple[list, list, list, list]:
        parts = [split_url(u) for u in urls]
        hit = self.automaton.run([(h + p).encode() for h, p in parts])
        by_rule = hit[:, : self.rule_globs].reshape(len(urls), -1, 2).any(axis=2)
        choice = np.concatenate([by_rule, hit[:, self.rule_globs :], np.ones((len(urls), 1), dtype=bool)], axis=1).argmax(axis=1)
        rule = [self.names[k] if k < len(self.names) else None for k in choice]
        return [h for h, _ in parts], [p for _, p in parts], rule, [self.verdicts[k] for k in choice]


def judged(df: DataFrame, rules: list[Rule], own: list[tuple[str, str]] = (), otherwise: str = "allow",
           id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) per row.

    own: (verdict, glob) pairs of the method over host + path, first match first, for URLs
    that no rule fits.
    """
    rules, own = list(rules), list(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = UrlJudge(rules, own, otherwise)
        for batch in batches:
            host, path, rule, verdict = judge.judge(batch.column("url").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *(pa.array(x, pa.string()) for x in (host, path, rule, verdict))],
                names=["id", "host", "path", "rule", "verdict"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"))
    return rows.mapInArrow(run, "id long, host string, path string, rule string, verdict string").withColumnRenamed(
        "id", id_col)


RULES = [
    Rule("allow", "com/"),
    Rule("block", "example.com/en/"),
    Rule("allow", "www.example.com/en/"),
    Rule("block", "net/es/"),
    Rule("block", "net/fr/"),
]
#: Any URL with a host is allowed; the rest has nothing to fetch.
OWN = [("allow", "?**")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every URL of pages against the rules; without a host: block."""
    return judged(documents(spark, sf_dir, "pages"), RULES, OWN, "block")


OP8_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(verdict, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
  ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m AS (
  SELECT p.page_id, p.host, p.path, max_by(r.host || r.path, length(r.host || r.path)) AS rule,
         max_by(r.verdict, length(r.host || r.path)) AS verdict
  FROM p LEFT JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN host = '' THEN 'block' ELSE 'allow' END) AS verdict
FROM m
"""
