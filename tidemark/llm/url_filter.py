"""URL allow and block rules in a trie over reversed host labels, then path segments.

The rules are given by the caller on the driver, so their number is known; up to
``MAX_RULES`` the trie is sent to the executors, and more are refused.  A rule (host, path) fits its host and all
subdomains if the url's path starts with the rule's path.  The rule with most host labels wins, then the one with
the longest path; of equal ones, block wins.  Without a fitting rule the verdict is ``default``.

Defined cases: a null url, or one without ``://``, has an empty host and path; an empty table gives an
empty result; repeated rows are judged one by one; only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_RULES = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Trie:
    """``hosts``: {label: Trie}; ``paths``: {segment: ...} with rules under ends."""

    def __init__(self) -> None:
        self.hosts: dict[str, Trie] = {}
        self.paths: dict = {}

    @classmethod
    def of(cls, rules: Iterable[tuple[str, str, str]]) -> Trie:
        """From (verdict, host, path); the empty host fits every host."""
        root, n = cls(), 0
        for verdict, host, path in rules:
            n += 1
            if n > MAX_RULES:
                raise ValueError(f"more than {MAX_RULES} rules")
            node = root
            for label in reversed(host.split(".")) if host else ():
                node = node.hosts.setdefault(label, cls())
            *whole, rest = path.split("/")
            at = node.paths
            for segment in whole:
                at = at.setdefault(("/", segment), {})
            if at.get(("", rest), ("", ""))[1] != "block":
                at[("", rest)] = (host + path, verdict)
        return root

    def _path(self, segments: list[str]) -> tuple[str, str] | None:
        best, at = None, self.paths
        for segment in segments:
            ends = [(len(k[1]), v) for k, v in at.items() if k[0] == "" and segment.startswith(k[1])] if len(at) < 64 else [(n, v) for n in range(len(segment) + 1) if (v := at.get(("", segment[:n])))]
            if ends:
                best = max(ends, key=lambda e: e[0])[1]
            at = at.get(("/", segment))
            if at is None:
                break
        return best

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        segments = path.split("/")
        node: Trie | None = self
        best = self._path(segments) if self.paths else None
        for label in reversed(host.split(".")):
            node = node.hosts.get(label)
            if node is None:
                break
            if node.paths:
                best = node._path(segments) or best
        return best or (None, None)


def host_and_path(url: str | F.Column) -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path of a url column, by JVM functions alone."""
    u = F.col(url) if isinstance(url, str) else url
    at = F.coalesce(F.instr(u, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def url_filter(pages: DataFrame, rules: Iterable[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) for each row."""
    trie = pages.sparkSession.sparkContext.broadcast(Trie.of(rules))
    host, path = host_and_path(url_col)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = trie.value.find
        for b in batches:
            found = [find(h, p) for h, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r for r, _ in found], pa.string()), pa.array([v or default for _, v in found], pa.string())], names=["id", "host", "path", "rule", "verdict"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path")).mapInArrow(judge, f"id {kind}, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)
