"""What a running stream has done: progress lines at an interval, and counters that its batches observe."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQueryListener


def counted(batch: DataFrame, name: str = "entries") -> DataFrame:
    """The stream with counters that its progress reports: entries, those of each kind of change, and those dropped for want of a key."""
    no_key = F.coalesce(F.get_json_object("o2", "$._id"), F.get_json_object("o", "$._id")).isNull()
    return batch.observe(
        name, F.count(F.lit(1)).alias("entries"), F.count_if(F.col("op").isin("i", "u", "d")).alias("changes"), F.count_if(F.col("op") == "c").alias("commands"), F.count_if(F.col("op").isin("i", "u", "d") & no_key).alias("dropped")
    )


class ProgressLog(StreamingQueryListener):
    """Writes a line for each micro-batch and sums the observed counters. ``write`` takes the line."""

    def __init__(self, write: Callable[[str], None] = print, name: str = "entries"):
        self._write, self._name, self.totals = write, name, {}

    def onQueryStarted(self, event) -> None:
        self._write(f"started query={event.id}")

    def onQueryProgress(self, event) -> None:
        p = event.progress
        seen = (p.observedMetrics or {}).get(self._name)
        for key, value in (seen.asDict() if seen is not None else {}).items():
            self.totals[key] = self.totals.get(key, 0) + value
        offsets = " ".join(f"offset={s.endOffset}" for s in p.sources)
        self._write(f"progress batch={p.batchId} rows={p.numInputRows} {offsets}")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._write(f"ended query={event.id}" + (f" error={event.exception.splitlines()[0]}" if event.exception else ""))
