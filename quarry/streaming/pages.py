"""Page rules over captures as they arrive.

Page rules look at one route at a time, so each micro-batch is audited on its own with the batch rules; graph, group and soft-404 rules
need the whole site and stay batch. A batch is written to its own folder and overwritten when it is retried, so a
restart neither loses nor repeats findings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.functions.html import SIGNALS
from quarry.plans import rules
from quarry.sources.captures import CONTENT

_RENDERED = f"struct<completion:string,status:int,signals:{SIGNALS},content:{CONTENT}>"


def page_findings(captures: DataFrame, options: dict | None = None) -> DataFrame:
    """Findings of the page rules over primary captures (`captures.CAPTURE`, with `exempt` and `rendered` where known).

    `ord` is the address's hash: without an inventory there is no route order, and one route's findings keep theirs.
    """
    rows = captures.where("agent_ord = 0").withColumn("ord", F.xxhash64("url"))
    for name, kind in (("exempt", "boolean"), ("rendered", _RENDERED)):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(False if name == "exempt" else None).cast(kind))
    return rules.page_rules(rules.enrich(rows, options))


def start(captures: DataFrame, path: str, checkpoint: str, options: dict | None = None, **trigger) -> StreamingQuery:
    """Run the rules over a stream of captures; findings go to Parquet under path/batch=N. `trigger` as in `DataStreamWriter.trigger`."""

    def write(batch: DataFrame, n: int) -> None:
        rows = batch.persist()  # several rules read the batch; it is one micro-batch and may spill to disk
        try:
            page_findings(rows, options).write.mode("overwrite").parquet(f"{path}/batch={n}")
        finally:
            rows.unpersist()

    writer = captures.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
