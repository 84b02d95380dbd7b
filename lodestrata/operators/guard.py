"""A guard on bad rows: batches are observed while they are written or aggregated, and a streak of bad ones stops the run."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


class BadStreak(RuntimeError):
    """So many batches in a row were bad."""


class Guard:
    """Counts rows whose columns are null, NaN or infinite, as a side result of whatever job runs over a watched batch: no second pass.

    watch() hooks a batch, settle() reads what its job has counted. A batch is bad if more than `share` of its rows are. A good one
    ends a streak; a streak of `most` raises BadStreak. Every bad batch is an event in `events`; the log hears of the first three of a streak and then
    of every hundredth. An empty batch is good.
    """

    def __init__(self, columns: list[str], share: float = 0.0, most: int = 1000, log: logging.Logger | None = None):
        self.columns, self.share, self.most = columns, share, most
        self.log = log or logging.getLogger(__name__)
        self.streak, self.step, self.events, self._seen = 0, 0, [], None

    def watch(self, batch: DataFrame) -> DataFrame:
        """The batch itself, observed by whatever action runs on it next."""
        self._seen = Observation()
        value = [F.col(c).cast("double") for c in self.columns]
        bad = F.lit(False)
        for v in value:
            bad = bad | v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
        return batch.observe(self._seen, F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad"))

    def settle(self, detail: str = "") -> dict:
        """What the last watched batch held: step, n, bad, streak. Call it after the batch's action."""
        if self._seen is None:
            raise ValueError("no batch is being watched")
        found, self._seen = self._seen.get, None
        n, bad = found.get("n") or 0, found.get("bad") or 0
        self.streak = self.streak + 1 if bad > self.share * n else 0
        row = {"step": self.step, "n": n, "bad": bad, "streak": self.streak, "detail": detail}
        self.step += 1
        if self.streak:
            self.events.append(row)
            if self.streak <= 3 or self.streak % 100 == 0:
                self.log.warning("step %d: %d of %d rows are bad, streak %d %s", row["step"], bad, n, self.streak, detail)
        if self.streak >= self.most:
            raise BadStreak(f"{self.streak} bad batches in a row at step {row['step']}")
        return row

    def for_each_batch(self, write):
        """A function for writeStream.foreachBatch that guards what `write(batch, batch_id)` does with each batch."""

        def run(batch: DataFrame, batch_id: int) -> None:
            write(self.watch(batch), batch_id)
            self.settle(f"batch {batch_id}")

        return run

    def report(self, spark, path: str) -> None:
        """The events so far as a table of their own, appended."""
        if self.events:
            spark.createDataFrame(self.events, "step long, n long, bad long, streak long, detail string").coalesce(1).write.mode("append").json(path)
