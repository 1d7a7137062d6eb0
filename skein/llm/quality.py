"""Host-level quality rules.

Each document is tested against text rules, each with a hard and a stricter soft
bound. The documents that fail a hard bound are counted by host, the rates are
shrunk with a beta prior whose mean and variance are those of the hosts' rates,
and the verdict on the host goes back to its documents:

======== ============================== =================================
verdict  posterior failure rate         a document is rejected if it fails
======== ============================== =================================
trusted  below ``trust_below``          two hard bounds, or ``no_words``
normal   between                        one hard bound
bad      above ``bad_above``            one soft bound
======== ============================== =================================

A document that fails no bound is never rejected, whatever its host.

All is done by built-in expressions: one pass writes a narrow table of failures,
hosts are aggregated from that, and the table of hosts (one row each) is joined
back; the text is never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .near_dedup import sized

WORD = r"[^ \t\n\r\f\x0B]+"
SYMBOLS = "!#$%&*|<>{}~^=+@_\\"
#: rule -> (hard bound, soft bound)
BOUNDS = {"symbols": (0.05, 0.03), "capitals": (0.4, 0.3), "digits": (0.5, 0.4), "lines": (0.5, 0.4), "variety": (3.0, 3.5), "repeats": (0.3, 0.2), "word_length": (25.0, 18.0)}
RULES = ["no_words", *BOUNDS]


def failures(text: Column) -> Column:
    """struct(hard, soft): the names of the rules whose hard and whose soft bound the text fails, joined by commas.

    - no_words: null, empty or white space only (hard and soft; no other rule is tried)
    - symbols: share of characters that are symbols, more than the bound
    - capitals: share of characters that are upper-case letters, more
    - digits: share of characters that are ASCII digits, more
    - lines: share of lines that repeat another line, more (of 5 lines or more)
    - variety: distinct words over the square root of words, less (of 50 words or more)
    - repeats: share of words that equal the word before, more (of any number of words)
    - word_length: characters a word, more

    A measure that has nothing to divide by is null and fails no bound.
    """
    t = F.coalesce(text.cast("string"), F.lit(""))
    parts = F.struct(t.alias("t"), F.regexp_extract_all(t, F.lit(WORD), 0).alias("words"), F.split(t, "\n").alias("lines"))
    return _once(_once(parts, _measures), lambda m: F.struct(_failed(m, 0).alias("hard"), _failed(m, 1).alias("soft")))


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once however often body refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _measures(x: Column) -> Column:
    """What the rules measure, from struct(t, words, lines)."""
    t, words, lines = x["t"], x["words"], x["lines"]
    n, n_words, n_lines = F.length(t).cast("double"), F.size(words).cast("double"), F.size(lines).cast("double")
    share = lambda rest: F.try_divide(n - F.length(rest), n)
    return F.struct(
        n_words.alias("n_words"),
        share(F.regexp_replace(t, f"[{re.escape(SYMBOLS)}]+", "")).alias("symbols"),
        share(F.regexp_replace(t, r"\p{Lu}+", "")).alias("capitals"),
        share(F.regexp_replace(t, "[0-9]+", "")).alias("digits"),
        F.when(n_lines >= 5, 1 - F.size(F.array_distinct(lines)) / n_lines).otherwise(0.0).alias("lines"),
        F.when(n_words >= 50, F.size(F.array_distinct(words)) / F.sqrt(n_words)).otherwise(1e9).alias("variety"),
        F.try_divide(F.size(F.filter(words, lambda w, i: w == F.get(words, i - 1))).cast("double"), n_words - 1).alias("repeats"),
        F.try_divide(n, n_words).alias("word_length"),
    )


def _failed(m: Column, k: int) -> Column:
    tests = [F.when(m[r] < b[k] if r == "variety" else m[r] > b[k], F.lit(r)) for r, b in BOUNDS.items()]
    return F.when(m["n_words"] == 0, F.lit("no_words")).otherwise(F.concat_ws(",", *tests))


def _count(names: Column) -> Column:
    return F.when(names == "", 0).otherwise(F.size(F.split(names, ","))).cast("long")


def host_verdicts(failed: DataFrame, bad_above: float = 0.5, trust_below: float = 0.01) -> DataFrame:
    """(host, n_docs, n_failed, rate, verdict) from failed(host, hard).

    rate is the posterior mean under Beta(a, b). Its mean and variance are those
    of the hosts' rates; where they don't vary, or vary more than a beta
    distribution can, the prior counts as one document.
    """
    hosts = failed.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.when(F.col("hard") != "", 1).otherwise(0)).alias("n_failed"))
    r = F.col("n_failed") / F.col("n_docs")
    # sums of integers per host, so that the moments don't hang on the order of rows
    p = hosts.agg(F.avg(F.round(r * 1e9).cast("decimal(20,0)").cast("decimal(30,0)")).alias("m9"), F.count("*").alias("k"), F.avg((F.round(r * 1e9).cast("decimal(20,0)") * F.round(r * 1e9).cast("decimal(20,0)")).cast("decimal(38,0)")).alias("s18"))
    p = p.select((F.col("m9").cast("double") / 1e9).alias("m"), (F.col("s18").cast("double") / 1e18).alias("s"))
    v = F.col("s") - F.col("m") * F.col("m")
    strength = F.col("m") * (1 - F.col("m")) / v - 1
    p = p.select("m", F.when((v > 1e-12) & (strength > 0), strength).otherwise(1.0).alias("w"))
    x = hosts.crossJoin(F.broadcast(p))
    rate = (F.col("n_failed") + F.col("m") * F.col("w")) / (F.col("n_docs") + F.col("w"))
    x = x.select("host", "n_docs", "n_failed", F.round(rate, 6).alias("rate"))
    return x.withColumn("verdict", F.when(F.col("rate") > bad_above, "bad").when(F.col("rate") < trust_below, "trusted").otherwise("normal"))


def rejected(verdict: Column, hard: Column, soft: Column) -> Column:
    return F.when(verdict == "bad", soft != "").when(verdict == "trusted", (_count(hard) >= 2) | (hard == "no_words")).otherwise(hard != "")


def _host(docs: DataFrame, host: str) -> Column:
    return F.coalesce(docs[host].cast("string"), F.lit(""))


def quality_verdicts(docs: DataFrame, host: str = "source", **bounds) -> DataFrame:
    """One row for each row of docs: doc_id, host, the failed rules (hard, soft), the host's rate and verdict, and rejected.

    A null host counts as the host ''. Rows with null or repeated doc_id have
    rows of their own. A text of any length is tested whole. Columns other than doc_id, text and the host aren't read.
    An empty table gives an empty result.
    """
    failed, _ = common.write_table(docs.select(docs["doc_id"], _host(docs, host).alias("host"), failures(docs["text"]).alias("f")), "failures")
    failed = failed.select("doc_id", "host", "f.hard", "f.soft")
    hosts, _ = common.write_table(host_verdicts(failed, **bounds), "hosts")
    x = failed.join(sized(hosts, hosts.count(), 64), "host")
    return x.select("doc_id", "host", "hard", "soft", "n_docs", "n_failed", "rate", "verdict", rejected(F.col("verdict"), F.col("hard"), F.col("soft")).alias("rejected"))


def drop_rejected(docs: DataFrame, host: str = "source", **bounds) -> DataFrame:
    """docs without the rows that quality_verdicts rejects, all columns kept.

    The rules are evaluated once for the hosts' counts and once for the filter,
    which is cheaper than a shuffle of the texts. Null and blank texts go, as they have no word. Rows of equal
    content stay or go together, rows with null or repeated doc_id are judged by themselves, and equal rates are equal
    verdicts. Any columns may stand beside text and the host. An empty table gives an empty result.
    """
    failed = docs.select(_host(docs, host).alias("host"), failures(docs["text"]).alias("f")).select("host", "f.hard")
    hosts, path = common.write_table(host_verdicts(failed, **bounds), "hosts")
    h, f, name, verdict = common.fresh(docs, "h", "f", "host", "verdict")
    hosts = hosts.select(F.col("host").alias(name), F.col("verdict").alias(verdict))
    x = docs.withColumns({h: _host(docs, host), f: failures(docs["text"])})
    x = x.join(sized(hosts, hosts.count(), 64), F.col(h) == F.col(name))
    x = x.filter(~rejected(F.col(verdict), F.col(f"{f}.hard"), F.col(f"{f}.soft")))
    return x.select(*[x[f"`{c}`"] for c in docs.columns])


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
m AS (
  SELECT doc_id, host, length(t)::DOUBLE AS n, len(w)::DOUBLE AS nw, len(l)::DOUBLE AS nl,
    length(translate(t, '!#$%&*|<>{}~^=+@_\', ''))::DOUBLE AS no_sym, length(regexp_replace(t, '\p{Lu}+', '', 'g'))::DOUBLE AS no_cap,
    length(translate(t, '0123456789', ''))::DOUBLE AS no_dig, len(list_distinct(l))::DOUBLE AS dl, len(list_distinct(w))::DOUBLE AS dw,
    len(list_filter(w, lambda x, i: i > 1 AND x = w[i - 1]))::DOUBLE AS again
  FROM (SELECT *, regexp_extract_all(t, '[^ \t\n\r\f\x0B]+') AS w, string_split(t, chr(10)) AS l FROM t)),
s AS (
  SELECT doc_id, host, nw, (n - no_sym) / nullif(n, 0) AS symbols, (n - no_cap) / nullif(n, 0) AS capitals, (n - no_dig) / nullif(n, 0) AS digits,
    CASE WHEN nl >= 5 THEN 1 - dl / nl ELSE 0 END AS lines, CASE WHEN nw >= 50 THEN dw / sqrt(nw) ELSE 1e9 END AS variety, again / nullif(nw - 1, 0) AS repeats, n / nullif(nw, 0) AS wl
  FROM m),
f AS (
  SELECT doc_id, host,
    CASE WHEN nw = 0 THEN 'no_words' ELSE concat_ws(',', CASE WHEN symbols > 0.05 THEN 'symbols' END, CASE WHEN capitals > 0.4 THEN 'capitals' END,
      CASE WHEN digits > 0.5 THEN 'digits' END, CASE WHEN lines > 0.5 THEN 'lines' END, CASE WHEN variety < 3.0 THEN 'variety' END, CASE WHEN repeats > 0.3 THEN 'repeats' END, CASE WHEN wl > 25 THEN 'word_length' END) END AS hard,
    CASE WHEN nw = 0 THEN 'no_words' ELSE concat_ws(',', CASE WHEN symbols > 0.03 THEN 'symbols' END, CASE WHEN capitals > 0.3 THEN 'capitals' END,
      CASE WHEN digits > 0.4 THEN 'digits' END, CASE WHEN lines > 0.4 THEN 'lines' END, CASE WHEN variety < 3.5 THEN 'variety' END, CASE WHEN repeats > 0.2 THEN 'repeats' END, CASE WHEN wl > 18 THEN 'word_length' END) END AS soft
  FROM s),
h AS (SELECT host, count(*) AS n_docs, sum(CASE WHEN hard <> '' THEN 1 ELSE 0 END)::BIGINT AS n_failed FROM f GROUP BY host),
q AS (SELECT avg(r) AS m, avg(r * r) - avg(r) * avg(r) AS v FROM (SELECT round(n_failed::DOUBLE / n_docs * 1e9) / 1e9 AS r FROM h)),
p AS (SELECT m, CASE WHEN v > 1e-12 AND m * (1 - m) / v - 1 > 0 THEN m * (1 - m) / v - 1 ELSE 1.0 END AS w FROM q),
v AS (SELECT host, n_docs, n_failed, round((n_failed + m * w) / (n_docs + w), 6) AS rate FROM h, p),
u AS (SELECT *, CASE WHEN rate > 0.5 THEN 'bad' WHEN rate < 0.01 THEN 'trusted' ELSE 'normal' END AS verdict FROM v)
SELECT doc_id, host, hard, soft, n_docs, n_failed, rate, verdict,
  CASE WHEN verdict = 'bad' THEN soft <> '' WHEN verdict = 'trusted' THEN (hard <> '' AND len(string_split(hard, ',')) >= 2) OR hard = 'no_words' ELSE hard <> '' END AS rejected
FROM f JOIN u USING (host)
"""
