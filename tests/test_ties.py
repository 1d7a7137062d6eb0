"""Rows that tie in what a result is ordered by."""

import hashlib

from skein.plans.queries import QUERIES
from skein.sources import sinks


def test_files_of_equal_addresses(spark):
    rows = [(i, "https://a.com/x", f"T{i}", "m", "now") for i in (100, 20, 3000)] + [(7, "https://a.com/X/", "T7", "m", "now")]
    x = spark.createDataFrame(rows, "page_id long, url string, title string, markdown string, crawled_at string")
    for order in ("page_id", "title"):
        got = sinks.files(x.repartition(3, order), "out", by=("page_id",)).collect()
        assert [(r.path, r.content.split("\n")[0]) for r in got] == [("out/a-com-x.md", "# T20")]
    assert sinks.files(x, "out").first().content.startswith("# T100\n")


def test_json_array_of_equal_addresses(spark):
    x = spark.createDataFrame([(10974, "https://a.com/x", "T10974"), (9894, "https://a.com/x", "T9894")], "page_id long, url string, title string")
    x.write.mode("overwrite").parquet(f"{spark.conf.get('spark.sql.warehouse.dir')}/ties/pages.parquet")
    got = QUERIES["json_array"](spark, f"{spark.conf.get('spark.sql.warehouse.dir')}/ties").first().digest
    assert got == hashlib.md5(b'[{"url":"https://a.com/x","title":"T9894"},{"url":"https://a.com/x","title":"T10974"}]').hexdigest()
