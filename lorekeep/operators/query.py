"""Queries: scope, filter, sort and page, compiled to one DataFrame plan."""

from __future__ import annotations

import base64
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .access import AccessControl
from .filters import Fields, Filter

DEFAULT_LIMIT, MOST = 100, 1000


@dataclass(frozen=True)
class Cursor:
    """The last row of a page."""

    record_id: str
    created_at_ms: int

    def encode(self) -> str:
        return base64.urlsafe_b64encode(f"{self.record_id}:{self.created_at_ms}".encode()).decode().rstrip("=")

    @classmethod
    def decode(cls, text: str) -> Cursor:
        try:
            plain = base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)).decode()
            name, at = plain.rsplit(":", 1)
            return cls(name, int(at))
        except ValueError as e:
            raise ValueError("not a cursor") from e


def cursor_column(record_id: Column, created_at_ms: Column) -> Column:
    """``Cursor.encode`` as a column."""
    plain = F.concat(record_id, F.lit(":"), created_at_ms.cast("string"))
    return F.translate(F.regexp_replace(F.replace(F.base64(plain.cast("binary")), F.lit("\r\n"), F.lit("")), "=+$", ""), "+/", "-_")


@dataclass(frozen=True)
class SortKey:
    field: str
    descending: bool = False


@dataclass(frozen=True)
class Query:
    """What to fetch.  ``after`` is a cursor; ``offset`` counts from there."""

    namespace: str | None = None
    schema: str | None = None
    filter: Filter | None = None
    sort: tuple[SortKey, ...] = ()
    limit: int = DEFAULT_LIMIT
    after: str | None = None
    offset: int = 0


@dataclass
class Page:
    records: DataFrame
    has_more: bool
    next_cursor: str | None
    total_count: int = field(default=-1)


def order_by(sort: tuple[SortKey, ...], fields: Fields) -> list[Column]:
    """Ascending: missing last; descending turns the whole order, so missing first.  Ties go by record_id."""
    keys: list[Column] = []
    for s in sort or (SortKey("created_at_ms", True),):
        if s.field == "created_at_ms":
            columns = [F.col("created_at_ms")]
        elif s.field in fields.promoted:
            columns = [F.col(fields.promoted[s.field])]
        else:
            columns = fields.get(s.field).sort_keys()
        keys += [c.desc_nulls_first() if s.descending else c.asc_nulls_last() for c in columns]
    return [*keys, F.col("record_id").asc()]


def scoped(records: DataFrame, q: Query) -> DataFrame:
    """Scope always applies the namespace as well as the schema, whatever the access path."""
    if q.namespace is not None:
        records = records.where(F.col("namespace") == q.namespace)
    if q.schema is not None:
        records = records.where(F.col("schema") == q.schema)
    return records


def matching(records: DataFrame, q: Query, fields: Fields | None = None) -> DataFrame:
    """Rows in scope that pass the filter.  ``fields`` defaults to what the columns of ``records`` say."""
    found = scoped(records, q)
    return found.where(q.filter.where(fields or Fields.of(records))) if q.filter is not None else found


def after_cursor(found: DataFrame, q: Query, fields: Fields) -> DataFrame:
    """Rows beyond the cursor's row in the query's order.

    The cursor's row is looked up by id and its sort keys become a keyset
    predicate: nothing is numbered, and a page costs a top-k.  A cursor whose
    row is gone starts at its timestamp if the order is by time, else over.
    """
    if not q.after:
        return found
    cursor = Cursor.decode(q.after)
    sort = q.sort or (SortKey("created_at_ms", True),)
    keys = [(c, s.descending) for s in sort for c in ([F.col("created_at_ms")] if s.field == "created_at_ms" else [F.col(fields.promoted[s.field])] if s.field in fields.promoted else fields.get(s.field).sort_keys())]
    named = [F.col("record_id").alias("_id"), *[k.alias(f"_k{i}") for i, (k, _) in enumerate(keys)]]
    at = found.where(F.col("record_id") == cursor.record_id).select(*named).limit(1).first()
    if at is None:
        if len(keys) == 1 and sort[0].field == "created_at_ms":
            values: list = [cursor.created_at_ms]
        else:
            return found
    else:
        values = [at[f"_k{i}"] for i in range(len(keys))]
    beyond, tied = F.lit(False), F.lit(True)
    for (k, down), v in zip(keys, values):
        # descending: null, then large to small; ascending: small to large, then null
        if v is None:
            past = k.isNotNull() if down else F.lit(False)
        else:
            past = (k < F.lit(v)) if down else (k > F.lit(v)) | k.isNull()
        beyond = beyond | (tied & F.coalesce(past, F.lit(False)))
        tied = tied & k.eqNullSafe(F.lit(v))
    return found.where(beyond | (tied & (F.col("record_id") > cursor.record_id)))


def select_page(records: DataFrame, q: Query, fields: Fields | None = None, extra: int = 0) -> DataFrame:
    """The page as a plan: filter, order, offset and limit (clamped to 1,000)."""
    fields = fields or Fields.of(records)
    found = after_cursor(matching(records, q, fields), q, fields).orderBy(*order_by(q.sort, fields))
    if q.offset:
        found = found.offset(q.offset)
    return found.limit(min(max(q.limit, 0), MOST) + extra)


def execute(records: DataFrame, q: Query, fields: Fields | None = None, access: AccessControl | None = None, caller: str | None = None, now_ms: int = 0, with_total: bool = False) -> Page:
    """Run a query.  Access is decided before any plan is built."""
    if access is not None:
        access.require_read(caller, q.namespace, now_ms)
    limit = min(max(q.limit, 0), MOST)
    rows = select_page(records, q, fields, extra=1).collect() if limit else []
    more = len(rows) > limit if limit else not matching(records, q, fields).isEmpty()
    rows = rows[:limit]
    total = matching(records, q, fields).count() if with_total else -1
    last = Cursor(rows[-1]["record_id"], rows[-1]["created_at_ms"]).encode() if more and rows else None
    return Page(records.sparkSession.createDataFrame(rows, records.schema), more, last, total)


def across_namespaces(records: DataFrame, q: Query, namespaces: list[str]) -> DataFrame:
    """Union of namespaces, then one filter, order and page over all."""
    return records.where(F.col("namespace").isin(namespaces)).transform(lambda d: d.where(F.col("schema") == q.schema) if q.schema else d)


def execute_across(records: DataFrame, q: Query, namespaces: list[str], fields: Fields | None = None, access: AccessControl | None = None, caller: str | None = None, now_ms: int = 0) -> DataFrame:
    if access is not None:
        access.require_across(caller, namespaces, now_ms)
    return select_page(across_namespaces(records, q, namespaces), replace(q, namespace=None), fields)


def count(records: DataFrame, q: Query, fields: Fields | None = None) -> DataFrame:
    """``n``: rows that match, whatever the page."""
    return matching(records, q, fields).agg(F.count(F.lit(1)).alias("n"))


def with_total(records: DataFrame, q: Query, fields: Fields | None = None) -> DataFrame:
    """The page's rows, each with ``total_count`` of the filtered set."""
    total = count(records, q, fields).first()["n"]
    return select_page(records, q, fields).withColumn("total_count", F.lit(total).cast("bigint"))


def count_by_schema(records: DataFrame) -> DataFrame:
    """``schema, n``."""
    return records.groupBy("schema").agg(F.count(F.lit(1)).alias("n"))
