"""Reinforcement and archiving, folded from their logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import decayed_score


def fold(reinforcements: DataFrame, archived: DataFrame | None = None) -> DataFrame:
    """One row per record that was ever reinforced or archived; sums combine before the shuffle."""
    folded = reinforcements.groupBy("record_id").agg(
        F.sum("delta").alias("score"), F.count(F.lit(1)).alias("reinforce_count"), F.max_by("at_ms", "seq").alias("last_reinforced_at_ms"), F.min("at_ms").alias("first_seen_ms")
    )
    if archived is None:
        return folded.withColumn("archived_at_ms", F.lit(None).cast("bigint"))
    last = archived.groupBy("record_id").agg(F.max_by("archived_at_ms", "seq").alias("archived_at_ms"))
    both = folded.join(last, "record_id", "full")
    return both.withColumns({"score": F.coalesce("score", F.lit(0.0)), "reinforce_count": F.coalesce("reinforce_count", F.lit(0)), "first_seen_ms": F.coalesce("first_seen_ms", "archived_at_ms")})


def with_decay(metadata: DataFrame, now_ms: int, half_life: int) -> DataFrame:
    """``metadata`` with ``decayed_score`` and ``half_life_ms``."""
    last = F.coalesce(F.col("last_reinforced_at_ms"), F.lit(now_ms))
    return metadata.withColumn("decayed_score", decayed_score(F.col("score"), last, now_ms, half_life)).withColumn("half_life_ms", F.lit(half_life))


def stale(metadata: DataFrame, now_ms: int, half_life: int, below: float = 0.1, days: int = 90) -> DataFrame:
    """Records to archive: a decayed score under ``below``, and not reinforced for ``days``."""
    m = with_decay(metadata.where("archived_at_ms is null"), now_ms, half_life)
    return m.where((F.col("decayed_score") < below) & (F.coalesce("last_reinforced_at_ms", "first_seen_ms") < now_ms - days * 86_400_000))


def merge_keepers(candidates: DataFrame, group: str) -> DataFrame:
    """Of each group of facts that say the same, the one to keep: higher decayed score, then more sources, then smaller id."""
    best = F.max_by(F.struct("*"), F.struct("decayed_score", F.size("derived_from"), F.struct(*[-F.ascii(F.substring("record_id", i, 1)) for i in (1, 2)])))
    return candidates.groupBy(group).agg(best.alias("_best")).select("_best.*")
