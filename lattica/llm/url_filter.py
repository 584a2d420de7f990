"""URL filter: a trie over reversed host labels, then over path segments, with longest match.

The rule set is a parameter. Tries of at most MAX_RULES rules are broadcast, once to an executor; a larger set makes
several, which the pages pass in turns, keeping the deepest entry so far. Allow and block entries share a trie; the
deepest entry that fits decides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

Rule = tuple[str, str, str]  # allow or block, host, path

#: Rules of one trie, and so what a task holds.
MAX_RULES = 2_000_000


class UrlTrie:
    """Inner nodes are dicts from a label or segment to the next node. A rule's last path segment may be
    the start of the url's, so each node also has the partial segments that end a rule in it, longest first."""

    def __init__(self, rules: Sequence[Rule], default: str = "allow"):
        self.default, self.root = default, {}
        for verdict, host, path in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(verdict)
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault("h", {}).setdefault(label, {})
            node = node.setdefault("paths", {})
            *full, part = path.split("/")
            for segment in full:
                node = node.setdefault("s", {}).setdefault(segment, {})
            ends = node.setdefault("ends", {})
            if ends.get(part, (verdict, ""))[0] != verdict:
                raise ValueError(f"{host}{path} is both allowed and blocked")
            ends[part] = (verdict, host + path, len(path))

    def _path(self, node: dict, segments: list[str]) -> tuple[str, str, int] | None:
        best = None
        for segment in segments:
            for part in sorted(node.get("ends", ()), key=len):
                if segment.startswith(part):
                    best = node["ends"][part]
            node = node.get("s", {}).get(segment)
            if node is None:
                break
        return best

    def find(self, host: str, path: str) -> tuple[str, str, list[int]] | None:
        """(rule, verdict, its number of labels and length of path) of the deepest fitting rule: hosts count before paths."""
        node, best, segments = self.root, None, path.split("/")
        for depth, label in enumerate(reversed(host.split(".")), 1):
            node = node.get("h", {}).get(label)
            if node is None:
                break
            if "paths" in node and (own := self._path(node["paths"], segments)):
                best = (own[1], own[0], [depth, own[2]])
        return best

    def match(self, host: str, path: str) -> tuple[str | None, str]:
        """(rule, verdict); without a fitting rule None and the default."""
        found = self.find(host, path)
        return found[:2] if found else (None, self.default)


_UPPER = {i: i + 32 for i in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z in lower case) and path; both empty for null and where there is no ://."""
    head, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    n = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    path = rest[n:]
    return rest[:n].translate(_UPPER), path[: min((i for i in map(path.find, "?#") if i >= 0), default=len(path))]


def filter_urls(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (host and path of the deciding entry, or null), verdict.

    A rule fits its host and all its subdomains where the url's path starts with its path. Null
    and malformed urls have empty host and path and take the default. One output row per input row,
    repeated ones included; empty tables give empty results; no other column is read.
    """
    blocks = [UrlTrie(rules[i : i + MAX_RULES], default) for i in range(0, len(rules), MAX_RULES)] or [UrlTrie([], default)]
    kinds: dict[tuple[str, str], str] = {}
    for verdict, host, path in rules if len(blocks) > 1 else ():  # a trie checks its own
        if kinds.setdefault((host, path), verdict) != verdict:
            raise ValueError(f"{host}{path} is both allowed and blocked")

    def first(sent):
        def run(batches):
            trie = sent.value
            for b in batches:
                parts = [split_url(u) for u in b["url"]]
                found = [trie.find(h, p) or (None, default, [0, 0]) for h, p in parts]
                yield {"page_id": b["page_id"], "host": [x[0] for x in parts], "path": [x[1] for x in parts], "rule": [x[0] for x in found], "verdict": [x[1] for x in found], "depth": [x[2] for x in found]}

        return run

    def further(sent):
        def run(batches):
            trie = sent.value
            for b in batches:
                found = [max((r, v, d), trie.find(h, p) or (r, v, d), key=lambda x: x[2]) for h, p, r, v, d in zip(b["host"], b["path"], b["rule"], b["verdict"], b["depth"])]
                yield {n: b[n] for n in ("page_id", "host", "path")} | {"rule": [x[0] for x in found], "verdict": [x[1] for x in found], "depth": [x[2] for x in found]}

        return run

    send = pages.sparkSession.sparkContext.broadcast
    schema = "page_id long, host string, path string, rule string, verdict string, depth array<int>"
    out = map_rows(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url")), first(send(blocks[0])), schema, rows=4096)
    for trie in blocks[1:]:
        out = map_rows(out, further(send(trie)), schema, rows=4096)
    return out.drop("depth")
