"""Ranked recall: by vector, by keywords, by reinforcement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X
from . import vectors
from .filters import Fields, TypeIn

#: Newest rows that the command-line recall scores, and the keyword path; None scores all.
CLI_SCAN, KEYWORD_SCAN = 10_000, 1_000


def decayed(records: DataFrame, metadata: DataFrame, now_ms: int, half_life: int, ahead: bool = False) -> DataFrame:
    """``records`` with ``decayed_score`` (0 if never reinforced) and ``archived_at_ms``."""
    meta = metadata.select("record_id", "score", "last_reinforced_at_ms", "archived_at_ms")
    joined = records.join(meta, "record_id", "left")
    score = X.decayed_score(F.col("score"), F.coalesce("last_reinforced_at_ms", F.lit(now_ms)), now_ms, half_life, ahead)
    return joined.withColumn("decayed_score", F.coalesce(score, F.lit(0.0))).drop("score", "last_reinforced_at_ms")


def recall_deep(records: DataFrame, index: DataFrame, metadata: DataFrame, query: list[float], k: int, now_ms: int, half_life: int, oversample: int = 1, archived: bool = False, ahead: bool = False, natural: bool = False) -> DataFrame:
    """The nearest vectors' records, by similarity, freshness and decayed reinforcement.

    The cut to ``k`` comes before records are looked up; ``oversample`` takes
    so many times more into account.  Archived records are left out unless
    asked for.  Times after ``now_ms`` count as now unless ``ahead`` lets them
    count by their distance.  Ties, of similarity as of the score, go by
    record_id, shorter ones first if ``natural``.
    """
    hits = vectors.search(index, query, k * oversample, natural).withColumnRenamed("score", "similarity")
    found = decayed(records.join(hits, "record_id"), metadata, now_ms, half_life, ahead)
    if not archived:
        found = found.where("archived_at_ms is null")
    fresh = X.freshness(F.col("created_at_ms"), now_ms, half_life, ahead)
    found = found.withColumn("final_score", X.recall_score(F.col("similarity"), fresh, F.col("decayed_score")))
    return found.orderBy(F.desc("final_score"), *vectors.id_order(natural)).limit(k)


def embed_and_search(records: DataFrame, index: DataFrame, metadata: DataFrame, text: str, embed: Callable[[str], list[float]], k: int, now_ms: int, half_life: int) -> DataFrame:
    return recall_deep(records, index, metadata, list(embed(text)), k, now_ms, half_life)


def find_relevant(records: DataFrame, metadata: DataFrame, namespace: str, now_ms: int, half_life: int, query_text: str | None = None, types: list[str] | None = None, top_k: int = 5, index: DataFrame | None = None, embed: Callable[[str], list[float]] | None = None, scan: int | None = KEYWORD_SCAN) -> DataFrame:
    """Memories for a prompt: by vector where an index and an embedder are there, else by keywords and freshness.

    ``strategy`` says which.  Vector candidates are four times ``top_k``, at
    least 20, before the type filter.
    """
    own = records.where(F.col("namespace") == namespace)
    by_vector = query_text is not None and index is not None and embed is not None and not index.isEmpty()
    if by_vector:
        hits = vectors.search(index, list(embed(query_text)), max(4 * top_k, 20)).withColumnRenamed("score", "similarity")
        own = own.join(hits, "record_id")
    elif scan is not None:
        own = own.orderBy(F.desc("created_at_ms"), "record_id").limit(scan)
    if types is not None:
        own = own.where(TypeIn(types).compile(Fields()))
    payload = F.from_json("data", "type string, description string, body string, source_path string, project string, mtime_ms bigint")
    found = decayed(own, metadata, now_ms, half_life).withColumn("_p", payload)
    text = lambda c: F.coalesce(F.col(f"_p.{c}"), F.lit(""))
    found = found.withColumns({
        "type": text("type"), "description": text("description"), "body": text("body"), "source_path": F.col("_p.source_path"), "project": F.col("_p.project"), "mtime_ms": F.col("_p.mtime_ms"),
    })
    words = X.tokens_of(query_text) if query_text else []
    found = found.withColumn("keyword_score", X.keyword_score(words, F.concat_ws(" ", "description", "body")))
    found = found.withColumn("final_score", X.memory_score(F.col("similarity") if by_vector else None, F.col("keyword_score"), X.freshness(F.col("created_at_ms"), now_ms, half_life), F.col("decayed_score")))
    found = found.withColumn("statement", X.statement(F.col("description"), F.col("body"), F.col("source_path"))).withColumn("strategy", F.lit("vector+decay" if by_vector else "keyword+decay"))
    columns = ["record_id", "type", "description", "statement", "source_path", "project", "mtime_ms", "decayed_score", "final_score", "keyword_score", "strategy"] + ["similarity"] * by_vector
    return found.orderBy(F.desc("final_score"), "record_id").limit(top_k).select(columns)


def recall_top(records: DataFrame, metadata: DataFrame, now_ms: int, half_life: int, top: int = 8, scan: int | None = CLI_SCAN) -> DataFrame:
    """The records with the highest decayed score, the newer first among equals; archived ones are left out."""
    rows = records if scan is None else records.orderBy(F.desc("created_at_ms"), "record_id").limit(scan)
    found = decayed(rows, metadata, now_ms, half_life).where("archived_at_ms is null")
    return found.orderBy(F.desc("decayed_score"), F.desc("created_at_ms"), "record_id").limit(top)


def grouped_by_topic(top: DataFrame) -> DataFrame:
    """``topic, statements``: a top-N's statements by topic, best first."""
    rows = top.withColumn("_p", F.from_json("data", "topic string, statement string, text string, rule string, content string"))
    line = X.display_text(*[F.col(f"_p.{c}") for c in ("statement", "text", "rule", "content")])
    best = F.struct((-F.col("decayed_score")).alias("s"), (-F.col("created_at_ms")).alias("c"), "record_id", line.alias("line"))
    return rows.groupBy(F.coalesce("_p.topic", F.lit("")).alias("topic")).agg(F.transform(F.array_sort(F.collect_list(best)), lambda x: x["line"]).alias("statements"))


def markdown(top: DataFrame) -> str:
    """A top-N as Markdown; N rows reach the driver."""
    return "\n\n".join("\n".join([f"## {r['topic'] or 'general'}", *[f"- {s}" for s in r["statements"]]]) for r in grouped_by_topic(top).orderBy("topic").collect())
