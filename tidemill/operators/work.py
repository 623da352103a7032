"""The work state machine as sets of transitions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators.tables import WORK

IS_READY = "dead = 0 and lease_id is null"


def claimable(work: DataFrame, now_ms: int | Column, slots: int) -> DataFrame:
    """The first due items in id order, as many as there are free slots; a top-k, not a sort of all."""
    return work.where(IS_READY).where(F.col("available_at_ms") <= now_ms).orderBy("work_id").limit(slots)


def claimed(due: DataFrame, now_ms: int, lease_ms: int, seq: int) -> DataFrame:
    """Claim transitions. Lease ids are random, so write the rows before using them twice."""
    return due.withColumns(
        {
            "seq": F.lit(seq).cast("long"),
            "attempt": F.col("attempt") + 1,
            "lease_id": F.uuid(),
            "lease_acquired_at_ms": F.lit(now_ms).cast("long"),
            "lease_expires_at_ms": F.lit(now_ms + lease_ms).cast("long"),
        }
    ).select(WORK.names)


def next_due(work: DataFrame) -> DataFrame:
    """``due_at_ms``: when the next ready item is due, null if none is."""
    return work.where(IS_READY).agg(F.min("available_at_ms").alias("due_at_ms"))


def without_handler(work: DataFrame, queues: Iterable[str], signal_queues: Iterable[str] = ()) -> DataFrame:
    """Items that no handler takes, dead with the reason."""
    known = F.when(F.col("signal") == 1, F.col("queue_name").isin(*signal_queues)).otherwise(F.col("queue_name").isin(*queues))
    why = F.concat(F.lit("no handler for "), F.when(F.col("signal") == 1, F.lit("signal ")).otherwise(F.lit("")), F.lit("queue "), F.col("queue_name"))
    return work.where(~known).withColumn("last_error", why)


def settled(leased: DataFrame, outcomes: DataFrame, now_ms: int | Column, default_retry_ms: int) -> DataFrame:
    """Transitions of finished items: ``outcomes(work_id, lease_id, disposition, error, retry_at_ms)``.

    Only the holder of the lease settles; a lost lease leaves no row. ``gone`` marks an ack. Signal
    work can't be dead-lettered: that is a retry. The default delay counts from ``now_ms``, the
    clock at settlement.
    """
    held = leased.alias("w").join(
        outcomes.alias("o"), (F.col("w.work_id") == F.col("o.work_id")) & (F.col("w.lease_id") == F.col("o.lease_id")) & (F.col("w.dead") == 0)
    )
    how = F.when((F.col("w.signal") == 1) & (F.col("o.disposition") == "dead_letter"), "retry").otherwise(F.col("o.disposition"))
    retry, dead = how == "retry", how == "dead_letter"
    at = F.when(retry, F.coalesce(F.col("o.retry_at_ms"), F.lit(now_ms) + default_retry_ms)).otherwise(F.col("w.available_at_ms"))
    return held.select(
        *[f"w.{c}" for c in WORK.names if c not in ("available_at_ms", "lease_id", "lease_acquired_at_ms", "lease_expires_at_ms", "dead", "last_error", "gone")],
        at.cast("long").alias("available_at_ms"),
        F.lit(None).cast("string").alias("lease_id"),
        F.lit(None).cast("long").alias("lease_acquired_at_ms"),
        F.lit(None).cast("long").alias("lease_expires_at_ms"),
        F.when(dead, F.lit(1)).otherwise(F.col("w.dead")).cast("int").alias("dead"),
        F.when(retry | dead, F.col("o.error")).otherwise(F.col("w.last_error")).alias("last_error"),
        (how == "ack").alias("gone"),
    ).select(WORK.names)


def released(work: DataFrame, now_ms: int | Column) -> DataFrame:
    """Leases given back: due at once, attempts and errors kept."""
    none = F.lit(None)
    return work.withColumns(
        {
            "lease_id": none.cast("string"),
            "lease_acquired_at_ms": none.cast("long"),
            "lease_expires_at_ms": none.cast("long"),
            "available_at_ms": (now_ms if isinstance(now_ms, Column) else F.lit(now_ms)).cast("long"),
        }
    ).select(WORK.names)


def expired(work: DataFrame, now_ms: int | Column) -> DataFrame:
    """Items whose lease ended before now; one that ends now still holds."""
    return work.where("lease_id is not null and dead = 0").where(F.col("lease_expires_at_ms") < now_ms)


def renewed(work: DataFrame, leases: DataFrame, now_ms: int, lease_ms: int) -> DataFrame:
    """Renewals of held leases ``leases(work_id, lease_id)``; a lease that isn't held gives no row."""
    held = work.where("dead = 0").join(leases.select("work_id", "lease_id"), ["work_id", "lease_id"], "left_semi")
    return held.withColumn("lease_expires_at_ms", F.lit(now_ms + lease_ms).cast("long")).select(WORK.names)


def counts(work: DataFrame) -> DataFrame:
    """Rows by ``signal`` and ``state``."""
    return work.groupBy("signal", "state").agg(F.count("*").alias("total"))
