"""URL rules looked up by their rarest literal token."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tablewise.llm.common import map_rows

# Rules a task may hold at once; more are refused, not cut.
MAX_RULES = 200_000


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def pattern(self) -> str:
        """Over ``host + path``: the host or a subdomain of it, then the path as a prefix."""
        return rf"(?:[^/]*\.)?{re.escape(self.host)}{re.escape(self.path)}"

    @property
    def tokens(self) -> list[str]:
        """Tokens that every URL of this rule has: host labels, and path parts that end in a slash."""
        labels = ["h:" + x for x in self.host.split(".")]
        return labels + ["p:" + x for x in self.path.split("/")[1:-1]]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def url_tokens(host: Column, path: Column) -> Column:
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    parts = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.concat(labels, parts))


def token_counts(urls: DataFrame, tokens: list[str]) -> dict[str, int]:
    """Number of URLs with each of ``tokens``; the tokens come from the rules, so they are bounded."""
    wanted = urls.sparkSession.createDataFrame([(t,) for t in sorted(set(tokens))], "token string")
    seen = urls.select(F.explode(url_tokens(F.col("host"), F.col("path"))).alias("token"))
    counts = seen.join(F.broadcast(wanted), "token").groupBy("token").count()
    return {r["token"]: r["count"] for r in counts.collect()}


def judge_urls(pages: DataFrame, rules: list[Rule], default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """host, path, rule and verdict of every row.

    Each rule is filed under the token that the fewest URLs of the table have. A URL's
    tokens fetch the rules filed under them, and only those run their expression; the
    longest rule that fits wins, then the first by name. No rule: ``rule`` is null and
    ``verdict`` is ``default``. A null URL, or one without ``://``, has empty host and
    path and fits no rule. Repeated rows are judged each; an empty table gives no row;
    other columns are ignored. Rows are not shuffled; the rule index goes to the
    tasks and may hold at most MAX_RULES rules (an error beyond).
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    if any(not r.path.startswith("/") for r in rules):
        raise ValueError("the path of a rule starts with a slash")
    parts = pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    counts = token_counts(parts, [t for r in rules for t in r.tokens])
    index: dict[str, list[tuple[str, str, str]]] = {}
    for rule in rules:
        rarest = min(rule.tokens, key=lambda t: (counts.get(t, 0), t))
        index.setdefault(rarest, []).append((rule.pattern, rule.name, rule.verdict))
    shared = pages.sparkSession.sparkContext.broadcast(index)

    def make():
        filed = {
            token: sorted(((re.compile(p), name, verdict) for p, name, verdict in group), key=lambda x: (-len(x[1]), x[1]))
            for token, group in shared.value.items()
        }

        def block(rows):
            for page, host, path in rows:
                best: tuple[str, str] | None = None
                whole = host + path
                tokens = {"h:" + x for x in host.split(".")} | {"p:" + x for x in path.split("/")}
                for token in tokens & filed.keys():
                    for pattern, name, verdict in filed[token]:
                        if best is not None and (-len(name), name) >= (-len(best[0]), best[0]):
                            break
                        if pattern.match(whole):
                            best = (name, verdict)
                            break
                yield page, host, path, best[0] if best else None, best[1] if best else default

        return block

    kind = pages.schema[key].dataType.simpleString()
    return map_rows(parts, make, f"{key} {kind}, host string, path string, rule string, verdict string", rows=4096)
