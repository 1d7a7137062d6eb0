"""Robots rules: parsing, and which paths they allow."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.urls import ColumnLike, _c
from .tables import fresh

SQL = "struct<groups:array<struct<agent:string,kind:string,pattern:string>>,sitemaps:array<string>,crawl_delay:double>"
ARROW = pa.struct([("groups", pa.list_(pa.struct([("agent", pa.string()), ("kind", pa.string()), ("pattern", pa.string())]))), ("sitemaps", pa.list_(pa.string())), ("crawl_delay", pa.float64())])


def parse_text(content: str, strict_groups: bool = False) -> dict:
    """groups (agent, kind allow | disallow | none, pattern), sitemaps and crawl_delay.

    A group begins with agent lines that follow rules. An empty rule adds nothing,
    so the next agent line belongs to the same group; strict_groups lets it begin one.
    """
    groups, sitemaps, delay = [], [], None
    agents: list[str] = []
    rules: list[tuple[str, str]] = []
    ruled = False

    def close() -> None:
        nonlocal ruled
        for a in agents:
            groups.extend({"agent": a, "kind": k, "pattern": p} for k, p in rules or [("none", None)])
        agents.clear()
        rules.clear()
        ruled = False

    for line in content.splitlines():
        line = line.strip()
        if not line or line.startswith("#") or ":" not in line:
            continue
        name, _, value = line.partition(":")
        name, value = name.strip().lower(), value.partition("#")[0].strip()
        if name == "user-agent":
            if rules or (strict_groups and ruled):
                close()
            agents.append(value.lower())
        elif name in ("allow", "disallow"):
            ruled = True
            if value:
                rules.append((name, value))
        elif name == "sitemap" and value:
            sitemaps.append(value)
        elif name == "crawl-delay":
            try:
                delay = float(value)
            except ValueError:
                pass
    close()
    return {"groups": groups, "sitemaps": sitemaps, "crawl_delay": delay}


def parse(content: ColumnLike, strict_groups: bool = False) -> Column:
    """struct(groups, sitemaps, crawl_delay) of a robots file; null for null."""

    @F.arrow_udf(SQL)
    def run(col: pa.Array) -> pa.Array:
        return pa.array([None if c is None else parse_text(c, strict_groups) for c in col.to_pylist()], ARROW)

    return run(_c(content))


def rules(robots: DataFrame, strict_groups: bool = False) -> DataFrame:
    """(host, agent, kind, pattern) of robots(host, content)."""
    return robots.select("host", F.explode(parse("content", strict_groups)["groups"]).alias("g")).select("host", "g.*")


def pattern_regex(pattern: Column) -> Column:
    """A rule's pattern as a regular expression: "*" is any run, "$" at the end is the end, all else a prefix."""
    anchored = pattern.endswith("$")
    bare = F.when(anchored, F.substring(pattern, F.lit(1), F.length(pattern) - 1)).otherwise(pattern)
    quoted = F.replace(F.regexp_replace(bare, r"([\\.\[\]{}()+^$|?])", r"\\$1"), F.lit("*"), F.lit(".*"))
    return F.concat(F.lit("(?s)^"), quoted, F.when(anchored, F.lit(r"\z")).otherwise(F.lit("")))


def rules_by_host(found: DataFrame, agent: str) -> DataFrame:
    """(host, rules): those of the agent if a host names it, else those for all. One row a host, with its patterns as an array."""
    agent = agent.lower()
    mine = found.filter(F.col("agent").isin(agent, "*")).withColumn("own", F.col("agent") == agent)
    one = F.struct("own", "kind", pattern_regex(F.col("pattern")).alias("regex"), F.octet_length("pattern").alias("length"))
    x = mine.groupBy("host").agg(F.collect_list(one).alias("all"), F.max("own").alias("named"))
    return x.select("host", F.filter("all", lambda r: (r["own"] == F.col("named")) & (r["kind"] != "none")).alias("rules"))


def allowed_path(path: Column, found: Column) -> Column:
    """Whether the longest matching rule allows the path. Of equally long ones the allowing counts; no rule allows."""
    best = lambda kind: F.coalesce(F.array_max(F.transform(F.filter(found, lambda r: (r["kind"] == kind) & F.regexp_like(path, r["regex"])), lambda r: r["length"])), F.lit(-1))
    return F.coalesce(best("allow") >= best("disallow"), F.lit(True))


def allowed(pages: DataFrame, found: DataFrame, agent: str, url: str = "url") -> DataFrame:
    """pages with a column allowed. found(host, agent, kind, pattern) as rules() gives it; hosts without rules allow all."""
    own, host, rules_ = fresh(pages, "own", "host", "rules")
    by_host = rules_by_host(found, agent).select(F.col("host").alias(host), F.col("rules").alias(rules_))
    x = pages.withColumn(own, urls.host(url)).join(by_host, F.col(own) == F.col(host), "left")
    return x.withColumn("allowed", allowed_path(urls.path(url), F.col(rules_))).drop(own, host, rules_)
