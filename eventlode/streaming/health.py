"""Health of sources as a stream: the last few runs of each, kept as state.

State per source is its last `per_source` runs, so it is bounded by the number of sources; a source without a run for
`retention` of event time is forgotten by a timer. Each batch that brings a source runs gives its health anew; `current` keeps the newest.

Defined results: rows without a time take no part; a run that found null is no zero; runs that come late count by their time, unless
the watermark has passed them; runs of one time are ordered by their id.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

HEALTH = "job_name string, detail long, runs long, zeros long, last_run timestamp, last_found long, alert boolean, step long"
STATE = "at array<long>, ids array<long>, found array<long>, step long"


def health_of(runs: list[tuple[int, int, int | None]], zeros_from: int) -> tuple:
    """runs, zeros, last run (microseconds), what it found, alert, of runs (time, id, found) with the newest first."""
    zeros = sum(f == 0 for _, _, f in runs)
    return len(runs), zeros, runs[0][0], runs[0][2], zeros >= zeros_from and any(f is not None and f > 0 for _, _, f in runs)


def source_health_stream(runs: DataFrame, per_source: int = 5, zeros_from: int = 3, late: str = "60 days", retention_ms: int = 60 * 24 * 3600 * 1000) -> DataFrame:
    """Health after each batch, of the sources in it, from a stream of job_name, detail, started_at (timestamp), log_id, events_found.

    Alert: at least `zeros_from` of the last runs found nothing, and not all."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        own, step = [], 0
        if state.exists:
            at, ids, found, step = state.get
            own = list(zip(at, ids, found, strict=True))
        for b in batches:
            found = [None if pd.isna(f) else int(f) for f in b["events_found"]]
            own += zip(b["at"].tolist(), b["log_id"].tolist(), found, strict=True)
            own = sorted(own, key=lambda r: r[:2], reverse=True)[:per_source]
        state.update((*map(list, zip(*own, strict=True)), step + 1))
        state.setTimeoutTimestamp(max(own[0][0] // 1000, state.getCurrentWatermarkMs() + 1) + retention_ms)
        n, zeros, last, last_found, alert = health_of(own, zeros_from)
        yield pd.DataFrame({"job_name": [key[0]], "detail": [key[1]], "runs": [n], "zeros": [zeros], "last_run": [pd.Timestamp(last, unit="us")], "last_found": pd.array([last_found], "Int64"), "alert": [alert], "step": [step + 1]})

    rows = runs.filter(F.col("started_at").isNotNull()).withWatermark("started_at", late)
    own = rows.select("started_at", "job_name", "detail", "log_id", "events_found", F.unix_micros("started_at").alias("at"))
    return own.groupBy("job_name", "detail").applyInPandasWithState(update, HEALTH, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def current(steps: DataFrame) -> DataFrame:
    """The newest health of each source, from what the stream has written."""
    own = ["runs", "zeros", "last_run", "last_found", "alert"]
    newest = steps.groupBy("job_name", "detail").agg(F.max_by(F.struct(*own), F.struct("last_run", "step")).alias("h"))
    return newest.select("job_name", "detail", *[F.col(f"h.{c}").alias(c) for c in own])
