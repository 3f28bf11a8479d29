"""Structured Streaming: task state with de-duplication of unfinished tasks, windowed activity, orphan references."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillon.operators.references import OrphanTracker

TERMINAL = {"completed", "failed", "cancelled"}
NEXT = {
    "enqueue": "queued", "start": "active", "complete": "completed", "fail": "failed", "cancel": "cancelled", "retry": "queued", "interrupt": "interrupted",
}
OUTPUT = "task_key string, generation int, status string, progress double, event_id long"
STATE = "generation int, status string, progress double, last_event long"


def step(state: tuple[int, str, float, int], action: str, progress: float | None, event: int) -> tuple[int, str, float, int]:
    """The task state after an event: a new generation only if the task is finished, retries only from a stop, no progress backwards."""
    generation, status, done, _ = state
    if action == "enqueue":
        if status in TERMINAL or not status:
            return generation + 1, "queued", 0.0, event
        return generation, "queued" if status == "interrupted" else status, done, event
    if action == "progress":
        return generation, status, max(done, min(1.0, progress or 0.0)) if status == "active" else done, event
    if action == "retry" and status not in ("failed", "cancelled", "interrupted"):
        return state
    if action in ("start", "complete", "fail", "interrupt") and status in TERMINAL:
        return state
    target = NEXT.get(action, status)
    return generation, target, 1.0 if target == "completed" else done, event


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now = state.get if state.exists else (0, "", 0.0, -1)
    for pdf in frames:
        for r in pdf.sort_values("event_id").itertuples():
            now = step(tuple(now), r.action, None if pd.isna(r.progress) else r.progress, int(r.event_id))
    state.update(now)
    yield pd.DataFrame([(key[0], now[0], now[1], now[2], now[3])], columns=["task_key", "generation", "status", "progress", "event_id"])


def task_states(events: DataFrame) -> DataFrame:
    """Stream of (event_id, task_key, action, progress) → the state of every task an event touched."""
    return events.groupBy("task_key").applyInPandasWithState(_advance, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


def windowed_activity(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Events per window and type; rows later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, slide or width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


def session_activity(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))


def orphan_sink(tracker: OrphanTracker) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink for a change feed with the columns of parents and references and `change` of parent, removal, reference.

    The number of the micro-batch is the batch id of the tracker, so that a replayed one is not counted twice; the state is in the
    tracker's folder, so that a query started again goes on with a tracker opened on the same path.
    """
    parent = ["target", "k1", "k2", "k3", "parent_row", "arrived_at", "removed_at"]
    ref = ["table_name", "row_order", "field_name", "target", "k1", "k2", "k3", "arrived_at"]

    def take(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        tracker.step(
            batch.where("change = 'parent'").select(parent), batch.where("change = 'reference'").select(ref),
            batch.where("change = 'removal'").select(parent), f"batch {number}", number,
        )
        batch.unpersist()

    return take
