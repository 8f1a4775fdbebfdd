"""Allow and block rules on hosts and paths.

Rules become a trie: labels of the host from the right, then path segments; it is broadcast, its size being that of
the rule list. A rule fits its host and all subdomains, if the url's path starts with the rule's path. The longest
rule wins: first the one with more host labels, then the one with the longer path.

Null urls and urls without `://` have an empty host and path, which no rule fits. Of rules given twice the later
counts. Repeated rows and other columns pass through; columns named host, path, rule or verdict are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from windrow.llm.common import lower_ascii, ship

Rule = tuple[str, str]  # (allow or block, host followed by the start of a path)


class Trie:
    """A node has next labels, next path segments, and the rules that end in it by the start of a segment."""

    def __init__(self, rules: Sequence[Rule]):
        self.root: dict = {}
        for number, (verdict, rule) in enumerate(rules):
            if verdict not in ("allow", "block") or "/" not in rule:
                raise ValueError(f"not a rule: {verdict} {rule}")
            host, path = rule.split("/", 1)
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault("labels", {}).setdefault(label, {})
            node = node.setdefault("path", {})
            *whole, start = path.split("/")
            for segment in whole:
                node = node.setdefault("segments", {}).setdefault(segment, {})
            node.setdefault("starts", {})[start] = number

    def find(self, host: str, path: str) -> int | None:
        found, node = None, self.root
        for label in reversed(host.split(".")):
            node = node.get("labels", {}).get(label)
            if node is None:
                break
            if "path" in node and (number := self.along(node["path"], path)) is not None:
                found = number
        return found

    @staticmethod
    def along(node: dict, path: str) -> int | None:
        if path[:1] != "/":
            return None
        found = None
        for segment in path[1:].split("/"):
            starts = node.get("starts", {})
            if fits := [s for s in starts if segment.startswith(s)]:
                found = starts[max(fits, key=len)]
            node = node.get("segments", {}).get(segment)
            if node is None:
                break
        return found


def judge(df: DataFrame, rules: Sequence[Rule], default: str = "allow", url: str = "url") -> DataFrame:
    """Adds host, path, rule (or null) and verdict (`default` without a rule)."""
    ship(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(Trie(rules))

    @F.arrow_udf("int")
    def find(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        trie = held.value
        for hosts, paths in batches:
            yield pa.array([trie.find(h, p) for h, p in zip(hosts.to_pylist(), paths.to_pylist())], pa.int32())

    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.col(url).substr(at + 3, F.length(url))).otherwise("")
    parted = df.withColumns({"host": lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)),
                             "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)})
    texts, verdicts = (F.array(*[F.lit(r[i]) for r in rules]) for i in (1, 0))
    number = F.col("_rule_number")
    return (parted.withColumn("_rule_number", find("host", "path") if rules else F.lit(None).cast("int"))
            .withColumns({"rule": F.get(texts, number), "verdict": F.coalesce(F.get(verdicts, number), F.lit(default))})
            .drop("_rule_number"))
