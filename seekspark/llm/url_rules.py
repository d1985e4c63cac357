"""URL filter: a trie over reversed host labels and path segments, broadcast to all tasks.

A rule is ``(verdict, host, path)``. It fits its host and all subdomains of it if the
URL's path starts with the rule's path. Of the rules that fit, the one with the most host
labels decides, then the one with the longest path; of an allow and a block entry for the
same host and path the block entry counts. URLs that no rule fits get ``default``.

The trie has a node per host label, read from the right, and below each host a node per
whole path segment. What follows a rule's last ``/`` is only the start of a segment, so
it is kept in the node as a tail that is compared by its length.

Defined cases: a null URL, or one without ``://``, has an empty host and an empty path,
which only rules for the empty host and path fit. The host is everything up to ``/``,
``?`` or ``#``, so a port or user name belongs to it. Repeated rows are judged alike and
all returned; columns that aren't named in ``keep`` are ignored; an empty table gives an
empty result; URLs of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALLOW, BLOCK = "allow", "block"
# Characters of rules in one broadcast trie; longer lists are judged by several tries.
TRIE_CHARS = 32 << 20
# Hosts whose walk a task remembers before it starts anew.
REMEMBERED_HOSTS = 50_000

Rule = tuple[str, str, str]


class UrlTrie:
    """Longest-match look-up; nodes are numbered, so a trie of any depth can be shipped."""

    def __init__(self, rules: Iterable[Rule]) -> None:
        self.labels = self.segments = 0
        self.below_host: list[dict[str, int]] = [{}]
        self.paths_of: list[int | None] = [None]
        self.below_path: list[dict[str, int]] = []
        self.tails: list[dict[str, tuple[str, str]]] = []
        for verdict, host, path in rules:
            self._add(verdict, host, path)
        self.sizes = [sorted({len(t) for t in tails}, reverse=True) for tails in self.tails]

    def _path_node(self) -> int:
        self.below_path.append({})
        self.tails.append({})
        return len(self.tails) - 1

    def _add(self, verdict: str, host: str, path: str) -> None:
        if verdict not in (ALLOW, BLOCK):
            raise ValueError(f"a rule allows or blocks, not {verdict!r}")
        node, labels = 0, _labels(host)
        for label in labels:
            if label not in self.below_host[node]:
                self.below_host[node][label] = len(self.below_host)
                self.below_host.append({})
                self.paths_of.append(None)
            node = self.below_host[node][label]
        if self.paths_of[node] is None:
            self.paths_of[node] = self._path_node()
        place = self.paths_of[node]
        *whole, tail = path.split("/")
        for segment in whole:
            if segment not in self.below_path[place]:
                self.below_path[place][segment] = self._path_node()
            place = self.below_path[place][segment]
        if self.tails[place].get(tail, (ALLOW, ""))[0] == ALLOW:
            self.tails[place][tail] = (verdict, host + path)
        self.labels = max(self.labels, len(labels))
        self.segments = max(self.segments, len(whole))

    def hosts(self, host: str) -> list[tuple[int, int]]:
        """``(labels, path node)`` of the host and the domains above it, the longest first."""
        walk = [0]
        for label in _labels(host, self.labels):
            node = self.below_host[walk[-1]].get(label)
            if node is None:
                break
            walk.append(node)
        found = [(depth, self.paths_of[node]) for depth, node in enumerate(walk)]
        return [pair for pair in found[::-1] if pair[1] is not None]

    def longest(self, hosts: list[tuple[int, int]], path: str) -> tuple[int, int, str, str] | None:
        """``(labels, path length, verdict, rule)`` of the rule that decides."""
        segments = path.split("/", self.segments) if hosts else []
        for labels, node in hosts:
            best, before = None, 0
            for segment in segments:
                for size in self.sizes[node]:
                    hit = self.tails[node].get(segment[:size]) if size <= len(segment) else None
                    if hit is not None:
                        best = (labels, before + size, *hit)
                        break
                before += len(segment) + 1
                node = self.below_path[node].get(segment)
                if node is None:
                    break
            if best is not None:
                return best
        return None


def _labels(host: str, most: int = -1) -> list[str]:
    """Labels from the right, at most ``most`` whole ones and the rest in one."""
    return host.rsplit(".", most)[::-1] if host else []


def judge_urls(
    rows: DataFrame,
    url: str,
    rules: Sequence[Rule],
    *keep: str,
    default: str = ALLOW,
    trie_chars: int = TRIE_CHARS,
) -> DataFrame:
    """``keep`` columns with host, path, the deciding rule (or null) and the verdict.

    ``rules`` is a list of the driver. A trie is broadcast for each ``trie_chars`` of its
    characters, so no broadcast grows with the list; the tries are asked one after the
    other and the longest match of all counts.
    """
    address = F.coalesce(F.col(url), F.lit(""))
    start = F.instr(address, "://")
    rest = F.when(start > 0, F.substring(address, start + 3, F.length(address))).otherwise("")
    parts = rows.select(*keep, rest.alias("_rest")).withColumn("_raw", F.regexp_extract("_rest", "^[^/?#]*", 0))
    judged = parts.select(
        *keep,
        F.translate("_raw", UPPER, LOWER).alias("host"),
        F.regexp_extract(F.substring("_rest", F.length("_raw") + 1, F.length("_rest")), "^[^?#]*", 0).alias("path"),
        F.lit(None).cast("int").alias("_labels"), F.lit(None).cast("int").alias("_length"),
        F.lit(None).cast("string").alias("_verdict"), F.lit(None).cast("string").alias("rule"),
    )
    for part in _parts(rules, trie_chars):
        trie = rows.sparkSession.sparkContext.broadcast(UrlTrie(part))
        judged = judged.mapInArrow(_matcher(trie, judged.schema), judged.schema)
    return judged.select(
        *keep, "host", "path", "rule", F.coalesce("_verdict", F.lit(default)).alias("verdict")
    )


def _parts(rules: Sequence[Rule], most: int) -> Iterator[list[Rule]]:
    part, size = [], 0
    for rule in rules:
        if part and size + len(rule[1]) + len(rule[2]) > most:
            yield part
            part, size = [], 0
        part.append(rule)
        size += len(rule[1]) + len(rule[2])
    if part:
        yield part


def _matcher(broadcast, schema: StructType):
    names = schema.names
    places = [names.index(c) for c in ("_labels", "_length", "_verdict", "rule")]
    host_at, path_at = names.index("host"), names.index("path")

    def better(new, old) -> bool:
        if old[0] is None or new[:2] != tuple(old[:2]):
            return old[0] is None or new[:2] > tuple(old[:2])
        return new[2] == BLOCK and old[2] == ALLOW

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, walks = broadcast.value, {}
        for batch in batches:
            found = [list(batch.column(i).to_pylist()) for i in places]
            hosts, paths = batch.column(host_at).to_pylist(), batch.column(path_at).to_pylist()
            for i, (host, path) in enumerate(zip(hosts, paths)):
                tries = walks.get(host)
                if tries is None:
                    if len(walks) >= REMEMBERED_HOSTS:
                        walks.clear()
                    tries = walks[host] = trie.hosts(host)
                hit = trie.longest(tries, path)
                if hit is not None and better(hit, [f[i] for f in found]):
                    for column, value in zip(found, hit):
                        column[i] = value
            columns = list(batch.columns)
            for place, values in zip(places, found):
                columns[place] = pa.array(values, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return run
