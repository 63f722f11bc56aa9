"""What callers see of records, metadata, branches and namespaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsonval import Field
from .store import change_counts


def record_json() -> Column:
    """A record as a JSON object: all but its signature, the payload nested."""
    head = F.to_json(F.struct("record_id", "schema", "namespace", "created_by", "created_at_ms", F.col("previous_version")), {"ignoreNullFields": "false"})
    return F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"data":'), F.coalesce("data", F.lit("null")), F.lit("}"))


def metadata_json() -> Column:
    """Metadata with its decayed score (see ``metadata.with_decay``) as a JSON object."""
    return F.to_json(F.struct("record_id", "score", "reinforce_count", "last_reinforced_at_ms", "first_seen_ms", "archived_at_ms", "decayed_score", "half_life_ms"), {"ignoreNullFields": "false"})


def branch_summary(branches: DataFrame, log: DataFrame) -> DataFrame:
    """Branches with the number of records that each has written or deleted itself."""
    changes = change_counts(log).withColumnRenamed("branch", "id")
    return branches.join(changes, "id", "left").withColumn("change_count", F.coalesce("change_count", F.lit(0)))


def namespace_listing(namespaces: DataFrame, caller: str) -> DataFrame:
    return namespaces.withColumn("is_owner", F.col("owner") == caller).orderBy("created_at_ms", "id")


def sort_value(name: str) -> Column:
    """A record's value under a sort key, as JSON text; ``null`` if it is missing."""
    if name == "created_at_ms":
        return F.col("created_at_ms").cast("string")
    return F.coalesce(F.to_json(Field(F.col("data"), name).v), F.lit("null"))


def facts(records: DataFrame) -> DataFrame:
    """Fact records with their payload as columns: statement and topic (empty if there is none), confidence (0 if it is no number), sources, rationale, what they supersede."""
    f = F.from_json("data", "statement string, topic string, confidence double, derived_from array<string>, rationale string, supersedes string")
    part = records.withColumn("_f", f)
    return part.select("record_id", "namespace", "created_at_ms", F.coalesce("_f.statement", F.lit("")).alias("statement"), F.coalesce("_f.topic", F.lit("")).alias("topic"), F.coalesce("_f.confidence", F.lit(0.0)).alias("confidence"), F.coalesce("_f.derived_from", F.array().cast("array<string>")).alias("derived_from"), "_f.rationale", "_f.supersedes")
