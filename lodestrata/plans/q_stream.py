"""Structured Streaming over the events: an extension, the same sums as the batch."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..streaming import accumulate
from .registry import Catalog, R, r, t
from .shared import shared_dir

CATALOG = Catalog()


@CATALOG.add(
    "X1_stream_scores",
    f"""WITH e AS (SELECT event_type, value AS y, value * 0.9 + user_id % 7 AS p FROM events)
SELECT event_type, count(*) AS n, {R("1 - sum((p - y) * (p - y)) / nullif(count(*) * var_pop(y), 0)", 5)} AS r2, {R("covar_pop(y, p) / nullif(stddev_pop(y) * stddev_pop(p), 0)", 5)} AS corr, {R("sqrt(avg((p - y) * (p - y)))", 5)} AS rmse FROM e GROUP BY event_type""",
)
def x1(spark, sf):
    schema = t(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    pairs = stream.select("event_type", F.col("value").alias("y"), (F.col("value") * 0.9 + F.col("user_id") % 7).alias("p"))
    sums = accumulate.sums_by_batch(pairs, ["event_type"], accumulate.score_sums("y", "p"), f"{shared_dir(spark)}/lodestrata-stream-{uuid.uuid4().hex}")
    out = accumulate.finish_scores(sums, ["event_type"])
    return out.select("event_type", "n", r("r2", 5).alias("r2"), r("corr", 5).alias("corr"), r("rmse", 5).alias("rmse"))
