"""Delta sync between devices.

A push exports what lies beyond the device's cursor and tombstones not pushed
yet, as one Parquet folder per delta under ``device_id=…/to_cursor=…``; the
folder names are the metadata that a pull prunes by.  Cursors count log
sequence numbers, per device, so a record dated back is not lost.  A pull
merges: new records are inserted, equal ones skipped, others resolved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.crypto import open_sealed, seal
from ..schema import RECORD, RECORD_LOG

COLUMNS = [part.split()[0] for part in RECORD.split(", ")]


def pending(log: DataFrame, namespace: str, branch: str, cursor: int, pushed: DataFrame) -> DataFrame:
    """Rows for the next delta: live rows beyond the cursor, and tombstones that were never pushed."""
    own = log.where((F.col("namespace") == namespace) & (F.col("branch") == branch))
    live = own.where((F.col("seq") > cursor) & ~F.col("is_tombstone"))
    gone = own.where("is_tombstone").join(pushed.select("record_id"), "record_id", "left_anti").select(live.columns)
    return live.union(gone)


def push(rows: DataFrame, path: str, device: str, namespace: str, key: bytes | None = None) -> int | None:
    """Write a delta; the new cursor, or None if there was nothing.  With ``key`` each row is sealed, bound to device and cursor."""
    to = rows.agg(F.max("seq")).first()[0]
    if to is None:
        return None
    if key is not None:
        rows = rows.select(seal(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}), key, F.lit(f"{device}\n{to}")).alias("sealed"))
    rows.write.mode("overwrite").parquet(f"{path}/{namespace}/deltas/device_id={device}/to_cursor={to}")
    return to


def deltas(spark, path: str, namespace: str, key: bytes | None = None, schema: str = RECORD_LOG) -> DataFrame:
    """All deltas; a sealed row that was tampered with, moved to another delta, or sealed by another key fails the read."""
    rows = spark.read.option("basePath", f"{path}/{namespace}/deltas").parquet(f"{path}/{namespace}/deltas/device_id=*/to_cursor=*")
    if key is None:
        return rows
    plain = open_sealed(F.col("sealed"), key, F.concat_ws("\n", "device_id", "to_cursor")).cast("string")
    sure = F.when(plain.isNull(), F.raise_error(F.lit("a delta does not open"))).otherwise(plain)
    return rows.select(F.from_json(sure, schema).alias("r"), "device_id", "to_cursor").select("r.*", "device_id", "to_cursor")


def incoming(all_deltas: DataFrame, me: str, cursors: dict[str, int]) -> DataFrame:
    """Rows of other devices' deltas beyond each device's cursor; both tests prune folders."""
    other = all_deltas.where(F.col("device_id") != me)
    seen = F.lit(False)
    for device, cursor in sorted(cursors.items()):
        seen = seen | ((F.col("device_id") == device) & (F.col("to_cursor") <= cursor))
    return other.where(~seen)


def replay_order() -> list[Column]:
    """Deltas by cursor, then device; within one, records before tombstones."""
    return [F.col("to_cursor"), F.col("device_id"), F.col("is_tombstone"), F.col("seq")]


def winner(strategy: str, local: str = "local", remote: str = "remote") -> Column:
    """``local`` or ``remote``: the later writer (a tie goes to remote); or under ``creator`` the local one unless both have one creator."""
    later = F.when(F.col(f"{remote}.created_at_ms") >= F.col(f"{local}.created_at_ms"), F.lit("remote")).otherwise(F.lit("local"))
    if strategy == "last_writer":
        return later
    if strategy == "creator":
        return F.when(F.col(f"{local}.created_by") == F.col(f"{remote}.created_by"), later).otherwise(F.lit("local"))
    raise ValueError(strategy)


def merge_actions(remote: DataFrame, local: DataFrame, strategy: str = "last_writer") -> DataFrame:
    """``record_id, action`` and the row that wins: insert, skip, or conflict resolved to one side."""
    r = remote.select("record_id", F.struct(*COLUMNS).alias("remote"))
    lo = local.select("record_id", F.struct(*COLUMNS).alias("local"))
    both = r.join(lo, "record_id", "left")
    same = F.col("local").isNotNull() & (F.to_json("local") == F.to_json("remote"))
    action = F.when(F.col("local").isNull(), "insert").when(same, "skip").otherwise(F.concat(F.lit("conflict_"), winner(strategy)))
    both = both.withColumn("action", action)
    return both.select("record_id", "action", F.when(F.col("action").isin("insert", "conflict_remote"), F.col("remote")).otherwise(F.col("local")).alias("row"))


def replayed(rows: DataFrame) -> DataFrame:
    """Of each record, the last row in replay order."""
    order = [F.col("to_cursor").desc(), F.col("device_id").desc(), F.col("is_tombstone").desc(), F.col("seq").desc()]
    w = Window.partitionBy("record_id").orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def pull(all_deltas: DataFrame, local: DataFrame, me: str, cursors: dict[str, int], strategy: str = "last_writer") -> DataFrame:
    """The records a device holds after a pull."""
    last = replayed(incoming(all_deltas, me, cursors))
    live = merge_actions(last.where(~F.col("is_tombstone")), local, strategy).select("row.*")
    kept = local.select(COLUMNS).join(last.select("record_id"), "record_id", "left_anti").select(COLUMNS)
    return kept.unionByName(live)


def new_cursors(all_deltas: DataFrame, me: str) -> DataFrame:
    """``device_id, cursor`` after a pull of everything."""
    return all_deltas.where(F.col("device_id") != me).groupBy("device_id").agg(F.max("to_cursor").alias("cursor"))


def status(log: DataFrame, namespace: str, branch: str, push_cursor: int, pushed: DataFrame) -> DataFrame:
    """``pending_push``: how many rows the next delta would have."""
    return pending(log, namespace, branch, push_cursor, pushed).agg(F.count(F.lit(1)).alias("pending_push"))


def delta_metadata(rows: DataFrame) -> DataFrame:
    """Per delta: counts of records and tombstones, and its cursor."""
    return rows.groupBy("device_id", "to_cursor").agg(F.count_if(~F.col("is_tombstone")).alias("records"), F.count_if(F.col("is_tombstone")).alias("tombstones"))


def pushed_tombstones(before: Column, now: Column) -> Column:
    """The sorted union of two lists of ids."""
    return F.array_sort(F.array_union(before, now))
