"""URL filter by a sorted digest array.

A block list is written as shards of sorted 64-bit xxhash keys beside their
strings (see ``digests``). Workers memory-map them, probe all keys of a batch by a
vectorised binary search, and confirm each hit against the stored string, so that
colliding keys never block a URL.

Rules are "host:H", which blocks H and its subdomains, or "url:U", which blocks
one page: U is host, path and query of a URL, without scheme, port and fragment.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, digests

#: Rules in a shard, about.
SHARD_RULES = digests.SHARD_ROWS


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:\s]+)", 1))


def page_of(url: Column) -> Column:
    """Host, path and query; the path of a bare host is "/"."""
    rest = F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?[^/?#:\s]+(?::[0-9]*)?([^#]*)", 1)
    return F.concat(host_of(url), F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest)))


def rules_of(url: Column) -> Column:
    """The rules that would block a URL, the most specific first; none if it has no host."""
    labels = F.split(host_of(url), r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    return F.when(host_of(url) == "", F.array().cast("array<string>")).otherwise(F.concat(F.array(F.concat(F.lit("url:"), page_of(url))), hosts))


def write_filter(rules: DataFrame, shard_rules: int = SHARD_RULES) -> list[digests.Shard]:
    """Writes the digest arrays of rules(rule), and gives their shards. Null and repeated rules count once or not at all."""
    distinct, path = common.write_table(rules.filter("rule is not null").select(F.col("rule").alias("s")).distinct().withColumn("key", F.xxhash64("s")), "rules")
    out = digests.write(distinct, "urlfilter", max(1, -(-distinct.count() // shard_rules)))
    common.remove(rules.sparkSession, path)
    return out


def blocked(urls: DataFrame, rules: DataFrame, url: str = "url", id_: str = "page_id", shard_rules: int = SHARD_RULES) -> DataFrame:
    """(page_id, url, rule, blocked) for each row of urls: the most specific rule that blocks it, or null.

    A null URL, and one without scheme and host, isn't blocked. Rows with null or
    repeated page_id have rows of their own. Without rules nothing is blocked.
    Other columns aren't read.
    """
    shards = write_filter(rules, shard_rules)

    def run(batches):
        for b in batches:
            cand, keys = b.column("c"), b.column("k")
            off = cand.offsets.to_numpy().astype(np.int64)
            flat = cand.values.slice(off[0], off[-1] - off[0])
            hit = digests.probe(keys.values.slice(off[0], off[-1] - off[0]).to_numpy(zero_copy_only=False), flat, shards)[0] >= 0
            off = off - off[0]
            at = np.flatnonzero(hit)
            first = np.searchsorted(at, off[:-1])
            ok = (first < len(at)) & (np.append(at, 1 << 62)[first] < off[1:])
            idx = pa.array(np.where(ok, np.append(at, 0)[first], 0), mask=~ok)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), flat.take(idx) if len(flat) else pa.nulls(len(b), pa.string()), pa.array(ok)], [id_, url, "rule", "blocked"])

    x = urls.select(F.col(id_).cast("long").alias(id_), F.col(url).cast("string").alias(url))
    x = x.withColumn("c", rules_of(F.coalesce(F.col(url), F.lit(""))))
    x = x.select(id_, url, "c", F.transform("c", lambda r: F.xxhash64(r)).alias("k"))
    return x.mapInArrow(run, f"{id_} long, {url} string, rule string, blocked boolean")


def tracking_rules(pages: DataFrame) -> DataFrame:
    """The query's block list: pages reached through a tracking parameter, and the sites that have a mobile host, with all their subdomains."""
    u, h = F.coalesce(pages["url"], F.lit("")), host_of(F.coalesce(pages["url"], F.lit("")))
    sites = pages.filter(h.startswith("m.")).select(F.concat(F.lit("host:"), F.substring(h, F.lit(3), F.length(h))).alias("rule"))
    return sites.union(pages.filter(u.contains("utm_source=")).filter(h != "").select(F.concat(F.lit("url:"), page_of(u))))


ORACLE = r"""
WITH p AS (
  SELECT page_id, url, lower(regexp_extract(coalesce(url, ''), '^\s*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:\s]+)', 1)) AS h,
    regexp_extract(coalesce(url, ''), '^\s*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?[^/?#:\s]+(?::[0-9]*)?([^#]*)', 1) AS rest FROM pages),
q AS (SELECT *, h || CASE WHEN starts_with(rest, '/') THEN rest ELSE '/' || rest END AS page FROM p),
rules AS (
  SELECT 'host:' || substr(h, 3) AS rule FROM q WHERE starts_with(h, 'm.')
  UNION SELECT 'url:' || page FROM q WHERE contains(url, 'utm_source=') AND h <> ''),
u AS (SELECT DISTINCT url, h, page FROM q WHERE h <> ''),
c AS (
  SELECT url, 0 AS pos, 'url:' || page AS rule FROM u
  UNION ALL SELECT url, i AS pos, 'host:' || array_to_string(list_slice(string_split(h, '.'), i, 99), '.') FROM u, unnest(range(1, len(string_split(h, '.')) + 1)) t(i)),
m AS (SELECT url, arg_min(rule, pos) AS rule FROM c JOIN rules USING (rule) GROUP BY url)
SELECT page_id, q.url AS url, m.rule AS rule, m.rule IS NOT NULL AS blocked FROM q LEFT JOIN m ON q.url = m.url
"""
