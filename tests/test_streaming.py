"""Page rules over a stream give what they give over the whole table."""

from pyspark.sql import functions as F

from quarry.sources import captures
from quarry.streaming import pages


def test_stream_equals_batch_and_survives_a_restart(spark, tmp_path):
    html = ["<title>a</title><h1>x</h1>", "<title>a</title><title>b</title><link rel=canonical href='/q'>", "", None]
    rows = [(k, f"https://e.t/{k}", h) for k, h in enumerate(html)]
    pages_ = captures.extract(spark.createDataFrame(rows, "page_id int, url string, html string"))
    hop = f"array<{captures.HOP}>"
    full = pages_.selectExpr(
        "url", "'default' AS agent", "CAST(page_id % 4 = 3 AS INT) AS agent_ord", "'complete' AS completion", "IF(page_id = 2, 404, 200) AS status", "url AS final_url", "'text/html' AS content_type",
        f"CAST(array() AS {hop}) AS redirects", "signals", "content", "CAST(1 AS DOUBLE) AS duration_ms", "CAST(NULL AS STRING) AS error",
    )
    source, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))

    def feed(part):
        part.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(captures.CAPTURE).parquet(source)
        q = pages.start(stream, out, ckpt, availableNow=True)
        q.awaitTermination()

    feed(full.where("url < 'https://e.t/1'"))
    feed(full.where("url >= 'https://e.t/1'"))
    key = lambda df: sorted((r.url, r.code, r.severity) for r in df.select("url", "code", "severity").collect())
    got = spark.read.parquet(out)
    assert got.select("batch").distinct().count() == 2
    assert key(got) == key(pages.page_findings(full))
    codes = {(r.url[-1], r.code) for r in got.where(F.col("severity") != "info").collect()}
    assert {("0", "missing-canonical"), ("1", "conflicting-title"), ("1", "missing-h1"), ("2", "not-found")} <= codes and not any(u == "3" for u, _ in codes)
