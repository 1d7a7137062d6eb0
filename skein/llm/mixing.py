"""Mixing sources to target weights over a domain-language-source tree.

Weights propagate from the root: a node's budget is divided among its children
by weight, where each child takes at most its capacity, the tokens below it
times ``max_epochs``. What a short child leaves goes to its siblings; as a
node's capacity is that of its subtree, only what no sibling can take reaches
the siblings of an ancestor. With capacities c and weights w, a child's share is
``least(c, w * max(l))``, where l runs over the children in order of c / w and
divides the budget left after the children before by the weight left.

A leaf with budget q and t tokens gives ``floor(q / t)`` whole epochs of its
documents, and of one more epoch the token-prefix that covers the rest, in the
order of a seeded hash of document and epoch: a document is taken if the tokens
of the documents before it are fewer than the rest.

The hash order needs no global sort. Tokens are first summed by leaf and hash
prefix; only the documents of the one prefix in which the rest ends are ordered,
and each leaf keeps a single cut-off, with which the filter is local to rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .near_dedup import sized
from .quality import WORD

#: Sources by domain; a source of none of them is of domain "other".
DOMAINS = {"web": [f"src{i}" for i in range(5)], "books": [f"src{i}" for i in range(5, 10)], "code": [f"src{i}" for i in range(10, 14)]}
DOMAIN_WEIGHTS = {"web": 40, "books": 30, "code": 20, "other": 10}
LANG_WEIGHTS = {"en": 60, "de": 15, "fr": 15, "es": 10}
#: The weight of a domain or language that has none, and of each source.
OTHER_WEIGHT = 1
SEED = 17
MAX_EPOCHS = 4
TREE = ["domain", "lang", "source"]


def _case(col: Column, values: dict, default) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(col == k, F.lit(v)).otherwise(out)
    return out


def _leaf(docs: DataFrame) -> dict[str, Column]:
    source = F.coalesce(docs["source"].cast("string"), F.lit("unknown"))
    domain = F.lit("other")
    for d, sources in DOMAINS.items():
        domain = F.when(source.isin(sources), d).otherwise(domain)
    return {"domain": domain, "lang": F.coalesce(docs["lang"].cast("string"), F.lit("unknown")), "source": source}


def order_key(doc_id: Column, epoch: Column, seed: int) -> Column:
    """The hexadecimal key by which an epoch orders its documents."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def _divide(nodes: DataFrame, budget: str, parent: list[str], name: str, weight: Column) -> DataFrame:
    """Children with their shares of the parents' budgets, see above."""
    w = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("w"), name)
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    x = nodes.withColumn("w", weight.cast("double"))
    x = x.withColumn("l", (F.col(budget) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("w").over(after))
    return x.withColumn("share", F.least(F.col("cap").cast("double"), F.col("w") * F.max("l").over(Window.partitionBy(*parent))))


def leaf_budgets(leaves: DataFrame, fraction: float = 1.0, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(domain, lang, source, tokens, budget, epochs, rest) from leaves(domain, lang, source, tokens).

    The root's budget is ``fraction`` of all tokens. epochs is the number of
    whole epochs and rest the tokens to take of one more. Leaves without tokens
    get nothing.
    """
    leaves = leaves.filter("tokens > 0").withColumn("cap", F.col("tokens") * max_epochs)
    total = leaves.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * F.lit(float(fraction)) + 1e-6).cast("double").alias("budget"))
    domains = leaves.groupBy("domain").agg(F.sum("cap").alias("cap")).crossJoin(F.broadcast(total)).withColumn("root", F.lit(0))
    domains = _divide(domains, "budget", ["root"], "domain", _case(F.col("domain"), DOMAIN_WEIGHTS, OTHER_WEIGHT)).select("domain", F.col("share").alias("domain_budget"))
    langs = leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).join(domains, "domain")
    langs = _divide(langs, "domain_budget", ["domain"], "lang", _case(F.col("lang"), LANG_WEIGHTS, OTHER_WEIGHT)).select("domain", "lang", F.col("share").alias("lang_budget"))
    out = _divide(leaves.join(langs, ["domain", "lang"]), "lang_budget", ["domain", "lang"], "source", F.lit(OTHER_WEIGHT))
    out = out.select(*TREE, "tokens", F.floor(F.col("share") + 1e-6).cast("long").alias("budget"))
    out = out.withColumn("epochs", F.expr("budget div tokens"))
    return out.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens"))


def _plan(docs: DataFrame, fraction: float, max_epochs: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, domain, lang, source, n_tokens) of all rows, and the leaves with their cut-offs."""
    words = F.size(F.regexp_extract_all(F.coalesce(docs["text"].cast("string"), F.lit("")), F.lit(WORD), 0)).cast("long")
    light, _ = common.write_table(docs.select(docs["doc_id"], *[c.alias(k) for k, c in _leaf(docs).items()], words.alias("n_tokens")), "tokens")
    sums = light.groupBy(*TREE).agg(F.sum("n_tokens").alias("tokens"))
    leaves, leaves_path = common.write_table(leaf_budgets(sums, fraction, max_epochs), "leaves")
    n = leaves.count()

    keyed = light.join(sized(leaves.select(*TREE, "epochs", "rest"), n, 200), TREE).filter("rest > 0")
    keyed = keyed.select(*TREE, "rest", "n_tokens", order_key(F.col("doc_id"), F.col("epochs") + 1, seed).alias("key")).withColumn("p", F.substring("key", 1, 4))
    by_leaf = Window.partitionBy(*TREE).orderBy("p")
    parts = keyed.groupBy(*TREE, "p").agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest"))
    parts = parts.withColumn("before", F.sum("n").over(by_leaf) - F.col("n"))
    last = parts.filter("before < rest").groupBy(*TREE).agg(F.max(F.struct("p", "before")).alias("x")).select(*TREE, F.col("x.p").alias("p"), F.col("x.before").alias("before"))
    last, last_path = common.write_table(last, "last")
    inside = keyed.join(sized(last, n, 200), [*TREE, "p"])
    ahead = Window.partitionBy(*TREE).orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same = Window.partitionBy(*TREE, "key")
    inside = inside.withColumn("before", F.col("before") + F.sum("n_tokens").over(ahead) - F.sum("n_tokens").over(same))
    cuts = inside.filter("before < rest").groupBy(*TREE).agg(F.max("key").alias("cut"))
    leaves, _ = common.write_table(leaves.join(cuts, TREE, "left"), "cuts")
    common.remove(docs.sparkSession, last_path, leaves_path)
    return light, leaves


def _epochs(leaves: dict[str, Column], doc_id: Column, seed: int) -> Column:
    more = F.when(leaves["cut"].isNotNull() & (order_key(doc_id, leaves["epochs"] + 1, seed) <= leaves["cut"]), 1).otherwise(0)
    return leaves["epochs"] + more


def mixture(docs: DataFrame, fraction: float = 1.0, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The sampled documents, one row for each epoch that takes them: doc_id, domain, lang, source, n_tokens, epoch, order_key.

    Tokens are runs of characters that aren't ASCII white space. A null language
    or source is "unknown". A null text has no tokens; documents without tokens
    come with the prefix in which their key lies. Rows of equal doc_id and leaf
    have equal keys: they are taken together. In an epoch, order_key gives the
    order. An empty table gives an empty result; extra columns aren't read.
    """
    light, leaves = _plan(docs, fraction, max_epochs, seed)
    x = light.join(sized(leaves.select(*TREE, "epochs", "cut"), leaves.count(), 200), TREE)
    times = _epochs({"epochs": F.col("epochs"), "cut": F.col("cut")}, F.col("doc_id"), seed)
    x = x.withColumn("n", times).filter("n > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    return x.select("doc_id", *TREE, "n_tokens", "epoch", order_key(F.col("doc_id"), F.col("epoch"), seed).alias("order_key"))


def mix(docs: DataFrame, fraction: float = 1.0, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The rows of docs as often as the mixture takes them, all columns kept. The texts aren't shuffled.

    Nulls, empty and very long texts, repeats and ties are as in mixture: a null language or source is "unknown", a text
    counts with all its words, rows of equal doc_id and leaf are taken together. Any columns may stand beside. An
    empty table gives an empty result.
    """
    _, leaves = _plan(docs, fraction, max_epochs, seed)
    plain = [*TREE, "epochs", "cut"]
    names = common.fresh(docs, *plain, *[f"of_{k}" for k in TREE], "n", "epoch")
    name, of, (n, epoch) = dict(zip(plain, names)), dict(zip(TREE, names[5:])), names[8:]
    leaves = leaves.select(*[F.col(c).alias(name[c]) for c in plain])
    x = docs.withColumns({of[k]: c for k, c in _leaf(docs).items()})
    x = x.join(sized(leaves, leaves.count(), 200), [F.col(of[k]) == F.col(name[k]) for k in TREE])
    x = x.withColumn(n, _epochs({"epochs": F.col(name["epochs"]), "cut": F.col(name["cut"])}, docs["doc_id"], seed)).filter(F.col(n) > 0)
    x = x.withColumn(epoch, F.explode(F.sequence(F.lit(1).cast("long"), n)))
    return x.select(*[x[f"`{c}`"] for c in docs.columns])


def _sql_case(col: str, values: dict, default: int) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + f" ELSE {default} END::DOUBLE"


def _sql_divide(frm: str, budget: str, parent: str, name: str, weight: str, out: str) -> str:
    return f"""
  SELECT *, least(cap::DOUBLE, w * max(l) OVER (PARTITION BY {parent})) AS {out} FROM (
    SELECT *, ({budget} - coalesce(sum(cap) OVER (PARTITION BY {parent} ORDER BY cap / w, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
      / sum(w) OVER (PARTITION BY {parent} ORDER BY cap / w, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS l
    FROM (SELECT *, {weight} AS w FROM {frm}))"""


_DOMAIN_SQL = "CASE " + " ".join(f"WHEN coalesce(source, 'unknown') IN ({', '.join(repr(s) for s in v)}) THEN '{k}'" for k, v in DOMAINS.items()) + " ELSE 'other' END"

ORACLE = rf"""
WITH light AS (
  SELECT doc_id, {_DOMAIN_SQL} AS domain, coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
    len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\f\x0B]+'))::BIGINT AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, (sum(n_tokens) * {MAX_EPOCHS})::BIGINT AS cap FROM light GROUP BY ALL HAVING sum(n_tokens) > 0),
d AS ({_sql_divide("(SELECT domain, sum(cap)::BIGINT AS cap, 0 AS root, (SELECT sum(tokens)::DOUBLE FROM leaves) AS b FROM leaves GROUP BY domain)", "b", "root", "domain", _sql_case("domain", DOMAIN_WEIGHTS, OTHER_WEIGHT), "db")}),
g AS ({_sql_divide("(SELECT x.*, d.db FROM (SELECT domain, lang, sum(cap)::BIGINT AS cap FROM leaves GROUP BY domain, lang) x JOIN d USING (domain))", "db", "domain", "lang", _sql_case("lang", LANG_WEIGHTS, OTHER_WEIGHT), "lb")}),
s AS ({_sql_divide("(SELECT x.*, g.lb FROM leaves x JOIN g USING (domain, lang))", "lb", "domain, lang", "source", f"{OTHER_WEIGHT}::DOUBLE", "sb")}),
q AS (SELECT domain, lang, source, tokens, floor(sb + 1e-6)::BIGINT AS budget, floor(sb + 1e-6)::BIGINT // tokens AS epochs FROM s),
x AS (SELECT l.*, epochs, budget - epochs * tokens AS rest, md5(concat_ws('|', '{SEED}', (epochs + 1)::VARCHAR, coalesce(doc_id::VARCHAR, 'null'))) AS key FROM light l JOIN q USING (domain, lang, source)),
y AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - sum(n_tokens) OVER (PARTITION BY domain, lang, source, key) AS before FROM x),
z AS (SELECT *, epochs + CASE WHEN rest > 0 AND before < rest THEN 1 ELSE 0 END AS n FROM y)
SELECT doc_id, domain, lang, source, n_tokens, e.epoch::BIGINT AS epoch, md5(concat_ws('|', '{SEED}', e.epoch::VARCHAR, coalesce(doc_id::VARCHAR, 'null'))) AS order_key
FROM z JOIN (SELECT unnest(range(1, {MAX_EPOCHS + 1})) AS epoch) e ON e.epoch <= z.n
"""
