"""Steps whose memory and work must not grow with a batch or a table."""

import pyarrow as pa

from skein.functions import text as T
from skein.operators import parse
from skein.plans import queries


def test_pieces_of_a_batch(monkeypatch):
    monkeypatch.setattr(parse, "PIECE", 300)
    live = []

    def one(body, k):
        live.append(body)
        return body.upper() + k if k else None

    got = parse.arrow_of(one, pa.string(), pa.array(["a" * 200, None, "b", "", "c" * 500]), pa.array(["1", "2", None, "4", "5"]))
    assert got.to_pylist() == ["A" * 200 + "1", None, None, "4", "C" * 500 + "5"]
    assert parse.arrow_of(one, pa.string(), pa.array([], pa.string()), pa.array([], pa.string())).to_pylist() == []


def test_feeds_are_bounded(spark, tmp_path, monkeypatch):
    spark.range(3000).selectExpr("id AS event_id", "'t' AS event_type", "id % 7 AS user_id").write.parquet(f"{tmp_path}/events.parquet")
    longest, rss = [], parse.parse_rss

    def seen(c):
        from pyspark.sql import functions as F

        longest.append(F.length(c))
        return rss(c)

    monkeypatch.setattr(queries.parse, "parse_rss", seen)
    got = queries.QUERIES["rss_items"](spark, str(tmp_path))
    assert len(longest) == 1 and got.count() == 3000 and got.distinct().count() == 3000
    plan = got._jdf.queryExecution().analyzed().toString()
    assert "FLOOR" in plan.upper()  # grouped by ranges of event_id too


def test_text_is_made_once(spark):
    from pyspark.sql import functions as F

    x = spark.range(1).select(F.explode(T.entities(F.concat(F.lit("v1.2.3 a@b.example "), F.md5(F.col("id").cast("string"))), T.PATTERNS)).alias("rule", "found"))
    assert {"email", "semver"} <= {r.rule for r in x.collect()}
    assert x._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 1
