"""Multi-party chat formatting by rotation of the perspective.

A dialogue is rendered once for each participant: with that speaker as the
assistant, all others as named users, and loss masks that cover what the speaker
says. One shuffle gathers the turns of a dialogue; the rest are higher-order
functions over its turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Roles that give instructions and take no part in the dialogue.
SYSTEM = ("system",)
BEGIN, END = "<|im_start|>", "<|im_end|>"


def _clean(text: Column) -> Column:
    """Keeps texts from closing or opening segments."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def rotate(turns: DataFrame, system_roles: tuple[str, ...] = SYSTEM) -> DataFrame:
    """(conv_id, perspective, n_turns, n_trained, rendered, mask, spans) of turns(conv_id, turn, role, text).

    mask has 1 for each segment that is trained on and 0 for others; spans are
    the half-open ranges of characters of rendered that are trained on, the end
    marker included. Segments are in the order of turn, role and text, a null turn
    first. A null or empty role is the participant "unknown", a null text is
    empty; repeated rows are turns of their own. A dialogue of system turns only
    has no participant and no row, nor has a null conv_id. "<|" in a text
    becomes "< |"; line ends, "<", ">" and "|" in a name become "_". Other
    columns aren't read.
    """
    role = F.coalesce(F.nullif(turns["role"].cast("string"), F.lit("")), F.lit("unknown"))
    rows = turns.filter(turns["conv_id"].isNotNull()).select(turns["conv_id"], F.struct(turns["turn"].alias("turn"), role.alias("role"), F.coalesce(turns["text"].cast("string"), F.lit("")).alias("text")).alias("t"))
    talks = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    speakers = F.filter(F.array_distinct(F.transform("turns", lambda t: t["role"])), lambda r: ~r.isin(*system_roles))
    x = talks.withColumn("perspective", F.explode(speakers))

    def segment(t: Column) -> Column:
        own = t["role"] == F.col("perspective")
        name = F.regexp_replace(t["role"], r"[\r\n<>|]", "_")
        head = F.when(own, "assistant").when(t["role"].isin(*system_roles), "system").otherwise(F.concat(F.lit("user name="), name))
        return F.struct(F.concat(F.lit(BEGIN), head, F.lit("\n")).alias("head"), F.concat(_clean(t["text"]), F.lit(END)).alias("body"), own.cast("int").alias("mask"))

    x = x.withColumn("s", F.transform("turns", segment))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc: Column, s: Column) -> Column:
        a = acc["at"] + F.length(s["head"])
        b = a + F.length(s["body"])
        span = F.concat(a.cast("string"), F.lit("-"), b.cast("string"))
        return F.struct((b + 1).alias("at"), F.when(s["mask"] == 1, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return x.select(
        "conv_id",
        "perspective",
        F.size("turns").cast("long").alias("n_turns"),
        F.aggregate("s", F.lit(0), lambda acc, s: acc + s["mask"]).cast("long").alias("n_trained"),
        F.concat_ws("", F.transform("s", lambda s: F.concat(s["head"], s["body"], F.lit("\n")))).alias("rendered"),
        F.concat_ws("", F.transform("s", lambda s: s["mask"].cast("string"))).alias("mask"),
        F.array_join(F.aggregate("s", start, step)["spans"], ",").alias("spans"),
    )


ORACLE = r"""
WITH t AS (SELECT conv_id, turn, coalesce(nullif(role, ''), 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM t),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
s AS (
  SELECT conv_id, perspective, pos, (role = perspective)::INT AS mask,
    '<|im_start|>' || CASE WHEN role = perspective THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user name=' || regexp_replace(role, '[\r\n<>|]', '_', 'g') END || chr(10) AS head,
    replace(text, '<|', '< |') || '<|im_end|>' AS body
  FROM p JOIN n USING (conv_id)),
o AS (SELECT *, sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective ORDER BY pos) AS stop FROM s)
SELECT conv_id, perspective, count(*) AS n_turns, sum(mask)::BIGINT AS n_trained, string_agg(head || body || chr(10), '' ORDER BY pos) AS rendered,
  string_agg(mask::VARCHAR, '' ORDER BY pos) AS mask,
  string_agg(CASE WHEN mask = 1 THEN (stop - 1 - length(body))::BIGINT::VARCHAR || '-' || (stop - 1)::BIGINT::VARCHAR END, ',' ORDER BY pos) AS spans
FROM o GROUP BY conv_id, perspective
"""
