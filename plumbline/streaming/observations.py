"""Streaming views of the observation tables. An extension: batch is the norm.

Each takes a streaming DataFrame of observations and returns a streaming
DataFrame; sinks and triggers are the caller's.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def latest(observations: DataFrame, key: str = "purl", at: str = "observed_at") -> DataFrame:
    """The newest observation of each key, kept up to date (update mode)."""
    rest = [c for c in observations.columns if c != key]
    return observations.groupBy(key).agg(F.max_by(F.struct(*rest), at).alias("l")).select(key, "l.*")


def deduplicated(observations: DataFrame, keys: list[str], at: str = "observed_at", late: str = "1 hour") -> DataFrame:
    """Observations once, however often a source repeats them within ``late``."""
    return observations.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def activity(observations: DataFrame, at: str = "observed_at", window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Observations and distinct keys per window; late rows count until the watermark."""
    rows = observations.withWatermark(at, late)
    return rows.groupBy(F.window(at, window)).agg(F.count(F.lit(1)).alias("observations"), F.approx_count_distinct("purl").alias("purls"))


def repointed(observations: DataFrame, ref: str = "ref", value: str = "resolved", at: str = "observed_at") -> DataFrame:
    """``ref, previous, resolved, observed_at``: an alert whenever a ref resolves
    to something else than before. State per ref is one value."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values([at, value])
        last = state.get[0] if state.exists else None
        out = []
        for when, now in zip(rows[at], rows[value]):
            if last is not None and now != last:
                out.append((key[0], last, now, when))
            last = now
        state.update((last,))
        yield pd.DataFrame(out, columns=["ref", "previous", "resolved", "observed_at"])

    return observations.groupBy(ref).applyInPandasWithState(
        step, "ref string, previous string, resolved string, observed_at timestamp", "last string", "append", GroupStateTimeout.NoTimeout
    )
