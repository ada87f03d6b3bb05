"""URL filter lists: a trie over reversed host labels, then path segments.

The rules are compiled once into a trie that is broadcast; a URL walks its host
labels from the right and, below every label where rules end, its path segments.
The longest rule wins: more host labels first, then more path characters; a block
rule wins over an equally long allow rule.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import widened

#: Largest rule list that is compiled into the broadcast trie (about 100 MB of driver memory).
MAX_TRIE_RULES = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(_UPPER, _LOWER)


def parse_rule(rule: str) -> tuple[str, str]:
    """``host/path`` to (host, path starting with a slash); no slash: the whole host."""
    host, _, path = rule.partition("/")
    return host.translate(_FOLD), "/" + path


def split_url(url: str | None) -> tuple[str, str]:
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    tail = rest[end:]
    stop = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
    return rest[:end].translate(_FOLD), tail[:stop]


class Trie:
    """Host nodes are dicts by label; ``None`` holds the path trie of the rules that end there.
    Path nodes are dicts by whole segment; ``None`` holds [(last partial segment, rule, verdict)],
    longest first."""

    def __init__(self, rules: Iterable[tuple[str, str]]) -> None:
        self.root: dict = {}
        for verdict, rule in rules:
            host, path = parse_rule(rule)
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault(None, {})
            *whole, last = path.split("/")[1:]
            for segment in whole:
                node = node.setdefault(segment, {})
            ends = node.setdefault(None, [])
            ends.append((last, rule, verdict))
            ends.sort(key=lambda e: (-len(e[0]), e[2] != "block"))

    def match(self, host: str, path: str) -> tuple[str | None, str | None]:
        found, node, labels, segments = (None, None), self.root, None, path.split("/")[1:]
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            if None in node:
                labels = self._path(node[None], segments)
                found = labels or found
        return found

    @staticmethod
    def _path(node: dict, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for segment in segments:
            best = next(((r, v) for last, r, v in node.get(None, ()) if segment.startswith(last)), best)
            node = node.get(segment)
            if node is None:
                break
        return best


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], default: str = "allow", url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict for each row.

    ``rules`` are ("allow" | "block", "host/path"); a rule fits its host and all
    subdomains if the path starts with the rule's.  URLs without a rule get
    ``default`` and a null rule; a null url or one without ``://`` has an empty host
    and path.  Up to ``MAX_TRIE_RULES`` rules are broadcast as a trie; longer lists
    are joined by host suffix instead.  Columns of the same names are replaced.
    """
    pages = pages.drop("host", "path", "rule", "verdict")
    if len(rules) > MAX_TRIE_RULES:
        return _joined(pages, rules, default, url)
    trie = pages.sparkSession.sparkContext.broadcast(Trie(rules))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(h, p, *trie.value.match(h, p)) for h, p in map(split_url, b.column(0).to_pylist())]
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.record_batch([*b.columns, *(pa.array(c, pa.string()) for c in cols[:3]), pa.array([v or default for v in cols[3]], pa.string())], names=[*b.schema.names, "host", "path", "rule", "verdict"])

    wide = pages.select(F.col(url).alias("__wl_url"), "*")
    return wide.mapInArrow(judge, widened(wide, "host string, path string, rule string, verdict string")).drop("__wl_url")


def _joined(pages: DataFrame, rules: list[tuple[str, str]], default: str, url: str) -> DataFrame:
    """The way for rule lists too long to broadcast: host suffixes join the rules' hosts."""
    spark = pages.sparkSession
    listed = spark.createDataFrame([(*parse_rule(r), r, v) for v, r in rules], "__wl_rh string, __wl_rp string, __wl_rule string, __wl_v string")
    found = F.instr(url, "://") > 0
    rest = F.substring(F.col(url), F.instr(url, "://") + 3, F.length(url))
    host = F.when(found, F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)).otherwise("")
    path = F.when(found, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")
    parsed = pages.withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit(""))})
    labels = F.split("host", r"\.", -1)
    keys = parsed.select("host", "path").distinct()
    suffixes = keys.select("*", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("__wl_rh"))
    best = (
        suffixes.join(listed, "__wl_rh").filter(F.expr("startswith(path, __wl_rp)"))
        .groupBy("host", "path")
        .agg(F.max_by(F.struct("__wl_rule", "__wl_v"), F.struct(F.length("__wl_rh"), F.length("__wl_rp"), F.col("__wl_v") == "block")).alias("__wl_b"))
    )
    out = parsed.join(best, ["host", "path"], "left")
    return out.select(*[c for c in pages.columns], "host", "path", F.col("__wl_b.__wl_rule").alias("rule"), F.coalesce("__wl_b.__wl_v", F.lit(default)).alias("verdict"))
