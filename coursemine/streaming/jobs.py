"""Jobs followed event by event: a stream that keeps each job's state and notices jobs that went silent."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from coursemine.sources.tables import claim_version, write_version

ENDED = ("success", "failed")
MAX_ERROR = 2000
# Values of a job, each with the event it comes from (time in microseconds, number).
_SEEN = ["last", "progress", "result", "error"]
STATE = "last_at long, last_no long, status string, progress_at long, progress_no long, progress int, " \
    "result_at long, result_no long, result string, error_at long, error_no long, error string, finished_at long, stalled boolean"
OUT = "job_id long, status string, progress int, result string, error_message string, finished_at timestamp, stalled boolean"
NEVER = -(1 << 62)
EMPTY = (NEVER, NEVER, None, NEVER, NEVER, 0, NEVER, NEVER, None, NEVER, NEVER, None, None, False)


def _progress(status: str, said: float | None) -> int | None:
    if status in ("pending", "success"):
        return 0 if status == "pending" else 100
    return max(0, min(100, int(said))) if status == "running" and not pd.isna(said) else None


def fold(state: tuple, events: Iterable[tuple]) -> tuple:
    """State after events (micros, event_id, status, progress, result, error) in any order; repeated ones change nothing."""
    at = {name: (state[3 * i], state[3 * i + 1], state[3 * i + 2]) for i, name in enumerate(_SEEN)}
    finished = state[12]
    for micros, number, status, said, result, error in events:
        values = {
            "last": status, "progress": _progress(status, said), "result": None if pd.isna(result) else result,
            "error": None if pd.isna(error) else error,
        }
        for name, value in values.items():
            counts = status == "failed" if name == "error" else name == "last" or value is not None
            if counts and (micros, number) >= at[name][:2]:
                at[name] = (micros, number, value)
        if status in ENDED:
            finished = micros if finished is None else max(finished, micros)
    return *[x for name in _SEEN for x in at[name]], finished, False


def track_jobs(events: DataFrame, silent_after: str = "2 hours", lateness: str = "10 minutes") -> DataFrame:
    """One row per job and change of a stream of events (job_id, event_id, ts, status, progress, result, error).

    The columns of ``job_state``, and ``stalled``: the job has not ended, and its last event lies more than
    ``silent_after`` behind the watermark.  An event that arrives later brings it back.  Events more than
    ``lateness`` behind the newest may be left out, as the watermark says; rows without a job or a time are.
    A job's state is some hundred bytes, however many events it has.
    """
    limit = int(pd.Timedelta(silent_after).total_seconds() * 1000)

    def out(job: int, s: tuple) -> pd.DataFrame:
        message = s[11][:MAX_ERROR] if s[2] == "failed" and s[11] is not None else None
        finished = pd.Timestamp(s[12], unit="us") if s[12] is not None else pd.NaT
        return pd.DataFrame({
            "job_id": [job], "status": [s[2]], "progress": [s[5]], "result": [s[8]], "error_message": [message],
            "finished_at": pd.Series([finished], dtype="datetime64[ns]"), "stalled": [s[13]],
        })

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            s = (*state.get[:-1], True)
            state.update(s)
            yield out(key[0], s)
            return
        s = state.get if state.exists else EMPTY
        for frame in frames:
            columns = [frame[c].tolist() for c in ("_micros", "event_id", "status", "progress", "result", "error")]
            s = fold(s, zip(*columns))
        if s[2] not in ENDED:
            due, mark = s[0] // 1000 + limit, state.getCurrentWatermarkMs()
            if due < mark:
                s = (*s[:-1], True)
            else:
                state.setTimeoutTimestamp(max(due, mark + 1))
        state.update(s)
        yield out(key[0], s)

    rows = events.select(
        F.col("job_id").cast("long").alias("job_id"), "ts", F.unix_micros("ts").alias("_micros"), F.col("event_id").cast("long").alias("event_id"),
        "status", F.col("progress").cast("double").alias("progress"), "result", "error",
    ).dropna(subset=["job_id", "ts", "event_id"])
    return rows.withWatermark("ts", lateness).groupBy("job_id").applyInPandasWithState(
        follow, OUT, STATE, "update", GroupStateTimeout.EventTimeTimeout
    )


def track_jobs_stream(
    events: DataFrame, table_path: str, checkpoint: str, silent_after: str = "2 hours", lateness: str = "10 minutes"
) -> StreamingQuery:
    """Changes of each micro-batch become one version of a table; ``newest`` reads the last state per job."""
    def run(batch: DataFrame, number: int) -> None:
        write_version(batch, table_path, claim_version(batch, table_path, number))

    return (
        track_jobs(events, silent_after, lateness).writeStream.outputMode("update").foreachBatch(run)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
