"""The benchmark's tables as records, logs and indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import Fields, promoted

#: Payload fields of event records that are typed columns as well.
EVENT_FIELDS = Fields(promoted={"type": "type", "value": "value", "k": "k"}, kinds={"type": str, "value": float, "k": int})


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def millis(ts: str) -> Column:
    """Milliseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts}) div 1000").cast("bigint")


def _record(df: DataFrame, record_id: Column, schema: Column, namespace: str, author: Column, at: Column, data: Column, previous: Column | None = None, *more: Column) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(
        record_id.alias("record_id"), schema.alias("schema"), F.lit(namespace).alias("namespace"), author.alias("created_by"), at.alias("created_at_ms"), data.alias("data"),
        (none if previous is None else previous).alias("previous_version"), none.alias("sig"), *more,
    )


def events(spark: SparkSession, sf: str) -> DataFrame:
    """One record per event; the payload lacks ``k`` where the id is a multiple of 7."""
    e = read(spark, sf, "events").withColumn("k", F.when(F.col("event_id") % 7 != 0, F.get_json_object("props", "$.k").cast("int")))
    data = F.to_json(F.struct(F.col("event_type").alias("type"), "value", "k"))
    return _record(e, F.concat(F.lit("e"), F.col("event_id")), F.concat(F.lit("events."), F.col("event_type")), "events", F.concat(F.lit("user-"), F.col("user_id")), millis("ts"), data, None,
                   promoted(F.col("event_type"), "type"), promoted(F.col("value"), "value"), promoted(F.col("k"), "k"), F.col("event_id").alias("seq"), "user_id")


def orders(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders")
    data = F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority")))
    return _record(o, F.concat(F.lit("o"), F.col("o_orderkey")), F.lit("orders.order"), "orders", F.concat(F.lit("cust-"), F.col("o_custkey")), millis("o_orderdate"), data, None,
                   promoted(F.col("o_orderstatus"), "status"), promoted(F.col("o_totalprice"), "price"), promoted(F.col("o_orderpriority"), "priority"))


def conversations(spark: SparkSession, sf: str) -> DataFrame:
    """One record per turn, each a version after the turn before."""
    c = read(spark, sf, "conversations")
    name = lambda t: F.concat(F.lit("c"), F.col("conv_id"), F.lit("."), t)
    data = F.to_json(F.struct("role", "text"))
    return _record(c, name(F.col("turn")), F.lit("conversations.turn"), "conversations", F.col("role"), F.col("conv_id") * 1000 + F.col("turn"), data, F.when(F.col("turn") > 0, name(F.col("turn") - 1)), F.col("conv_id"), F.col("turn"))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Memory files: the source is the type; a third have a description."""
    d = read(spark, sf, "documents")
    data = F.to_json(F.struct(F.col("source").alias("type"), F.when(F.col("doc_id") % 3 == 0, F.substring("text", 1, 40)).alias("description"), F.col("text").alias("body"), F.concat(F.lit("/docs/"), F.col("doc_id")).alias("source_path"), F.col("lang").alias("project")))
    return _record(d, F.concat(F.lit("d"), F.col("doc_id")), F.lit("documents.memory"), "documents", F.col("source"), F.col("doc_id") * 60_000, data)


def parts(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "part")
    return _record(p, F.concat(F.lit("p"), F.col("p_partkey")), F.lit("parts.part"), "parts", F.col("p_brand"), F.col("p_partkey"), F.to_json(F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("size"))), None, promoted(F.col("p_name"), "name"), promoted(F.col("p_size"), "size"))


BRANCHES = [("events/main", None), ("events/dev", "events/main"), ("events/exp", "events/dev")]


def branches(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(b, "events", p, "active", 0, b.split("/")[1]) for b, p in BRANCHES], "id string, namespace string, parent string, state string, created_at_ms bigint, label string")


def branch_log(spark: SparkSession, sf: str) -> DataFrame:
    """Three events in a row write one record, on main, dev and exp; every 11th is a tombstone."""
    e = events(spark, sf)
    branch = F.element_at(F.array(*[F.lit(b) for b, _ in BRANCHES]), (F.col("seq") % 3 + 1).cast("int"))
    gone = F.col("seq") % 11 == 0
    return e.select(
        F.concat(F.lit("r"), F.floor(F.col("seq") / 3)).alias("record_id"), F.lit("events.item").alias("schema"), "namespace", "created_by", "created_at_ms", "data", "previous_version", "sig", branch.alias("branch"),
        F.when(gone, "tombstone").otherwise("put").alias("op"), "seq", F.lit(None).cast("bigint").alias("origin_seq"), gone.alias("is_tombstone"), F.lit(True).alias("tail_visible"),
    )


def device_log(spark: SparkSession, sf: str, device: int) -> DataFrame:
    """Every second event on each of two devices; a record is ten events' id modulo, every 13th a tombstone."""
    e = events(spark, sf).where(F.col("user_id") % 2 == device)
    return e.select(
        F.concat(F.lit("s"), F.col("seq") % 1000).alias("record_id"), "schema", "namespace", "created_by", "created_at_ms", "data", "previous_version", "sig", F.lit("events/main").alias("branch"),
        F.lit("put").alias("op"), "seq", F.lit(None).cast("bigint").alias("origin_seq"), (F.col("seq") % 13 == 0).alias("is_tombstone"), F.lit(True).alias("tail_visible"),
    )


def reinforcements(spark: SparkSession, sf: str, prefix: str = "u") -> DataFrame:
    """Each event reinforces its user's record by its value."""
    return events(spark, sf).select(F.concat(F.lit(prefix), F.col("user_id")).alias("record_id"), F.col("value").alias("delta"), F.col("created_at_ms").alias("at_ms"), "seq")


def archived(spark: SparkSession, sf: str, prefix: str = "u") -> DataFrame:
    """Users whose number is a multiple of 9 are archived."""
    users = read(spark, sf, "events").where("user_id % 9 = 0").select("user_id").distinct()
    return users.select(F.concat(F.lit(prefix), F.col("user_id")).alias("record_id"), F.lit(1_704_067_200_000).cast("bigint").alias("archived_at_ms"), F.col("user_id").cast("bigint").alias("seq"))


def users(spark: SparkSession, sf: str, prefix: str = "u") -> DataFrame:
    """One record per user, made at its first event."""
    e = events(spark, sf).groupBy("user_id").agg(F.min("created_at_ms").alias("at"))
    return _record(e, F.concat(F.lit(prefix), F.col("user_id")), F.lit("users.user"), "users", F.lit("system"), F.col("at"), F.to_json(F.struct(F.concat(F.lit("user "), F.col("user_id")).alias("statement"), F.concat(F.lit("group "), F.col("user_id") % 4).alias("topic"))))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "embeddings").select(F.lit("vec").alias("namespace"), F.concat(F.lit("v"), F.col("vec_id")).alias("record_id"), "embedding", "label", "vec_id")


def vector_records(spark: SparkSession, sf: str) -> DataFrame:
    v = read(spark, sf, "embeddings")
    return _record(v, F.concat(F.lit("v"), F.col("vec_id")), F.lit("vec.item"), "vec", F.lit("system"), F.lit(1_704_067_200_000) + F.col("vec_id") * 60_000, F.to_json(F.struct(F.col("label").cast("string").alias("type"))))


def episodes(spark: SparkSession, sf: str) -> DataFrame:
    """Events as episodes: the type is the topic but for every 5th, which has none; every 4th has a rule in place of a text."""
    e = events(spark, sf)
    line = F.concat(F.lit("user "), F.col("user_id"), F.lit(" did "), F.col("type"), F.lit(" "), F.repeat(F.lit("again "), (F.col("seq") % 40).cast("int")))
    data = F.to_json(F.struct(F.when(F.col("seq") % 5 != 0, F.col("type")).alias("topic"), F.when(F.col("seq") % 4 != 0, line).alias("text"), F.when(F.col("seq") % 4 == 0, line).alias("rule")))
    return e.select("record_id", "schema", "namespace", "created_by", "created_at_ms", data.alias("data"), "seq")
