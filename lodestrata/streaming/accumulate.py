"""The mergeable aggregates as Structured Streaming queries. An extension: windows and watermarks are Spark's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.exprs import both_finite, ratio


def stream_table(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_mean(events: DataFrame, time: str, keys: list[str], value: str, window: str, lateness: str) -> DataFrame:
    """keys, window start, n, mean per event-time window; rows later than the watermark are dropped."""
    return (
        events.withWatermark(time, lateness)
        .groupBy(F.window(time, window), *keys)
        .agg(F.count(value).alias("n"), F.sum(value).alias("total"))
        .select(F.col("window.start").alias("start"), *keys, "n", ratio("total", "n").alias("mean"))
    )


def score_sums(y: str, p: str) -> list[Column]:
    """The seven sums behind R2, correlation, RMSE and MAE; sums of segments add up to those of the whole."""
    ok = both_finite(y, p)
    a, b = F.when(ok, F.col(y)), F.when(ok, F.col(p))
    e = b - a
    return [F.count(a).alias("n"), F.sum(a).alias("y"), F.sum(b).alias("p"), F.sum(a * a).alias("yy"), F.sum(b * b).alias("pp"), F.sum(a * b).alias("yp"), F.sum(e * e).alias("ee"), F.sum(F.abs(e)).alias("ae")]


def finish_scores(sums: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, r2, corr, rmse, mae from merged sums."""
    n, c = F.col("n"), F.col
    vy, vp = c("yy") - c("y") * c("y") / n, c("pp") - c("p") * c("p") / n
    cov = c("yp") - c("y") * c("p") / n
    return sums.select(
        *keys, "n", (1 - ratio(c("ee"), F.nullif(vy, F.lit(0.0)))).alias("r2"), ratio(cov, F.nullif(F.sqrt(F.greatest(vy * vp, F.lit(0.0))), F.lit(0.0))).alias("corr"), F.sqrt(ratio("ee", "n")).alias("rmse"), ratio("ae", "n").alias("mae")
    )


def merge(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Adds up the sums of segments."""
    rest = [c for c in sums.columns if c not in keys]
    return sums.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in rest])


def run_to_end(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Everything that is there now through an in-memory sink; for tests and small tables."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def sums_by_batch(stream: DataFrame, keys: list[str], sums: list[Column], path: str) -> DataFrame:
    """Everything that is there now, summed batch by batch: each micro-batch overwrites its own folder, so a repeated batch counts
    once, and the folders are merged at the end. State is one row per key and batch."""
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy(*keys).agg(*sums).write.mode("overwrite").parquet(f"{path}/sums/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return merge(spark.read.parquet(f"{path}/sums").drop("batch"), keys)
