"""Streaming forms against their batch forms."""

from pyspark.sql import functions as F

from skein.operators import frontier
from skein.streaming import streams


def run(df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_dedup_and_delay(spark, tmp_path):
    rows = spark.createDataFrame([(f"https://WWW.s.com/{i % 3}/", i, 200 if i % 2 else 429) for i in range(9)], "url string, at long, status int")
    rows = rows.withColumn("fetched_at", F.timestamp_seconds("at")).withColumn("host", F.lit("s.com"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    assert run(streams.dedup(stream), "seen", "append", tmp_path).count() == 3
    batch = frontier.adaptive_delay(rows).first()
    got = run(streams.adaptive_delay(stream.select("host", "at", "status")), "delay", "update", tmp_path).first()
    assert (got.n, got.delay_ms) == (batch.n, batch.delay_ms)


def test_rates(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    assert streams.rates(events).agg(F.sum("n")).first()[0] == events.count()
    assert streams.sessions(events).agg(F.sum("n")).first()[0] == events.count()
