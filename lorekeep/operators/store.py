"""The record store: namespaces, schemas, branches and an append-only log.

Every write is appended; what a branch shows is a view.  A branch shows its
own rows and its ancestors', the nearest branch's row winning for each
record; a tombstone hides what lies behind it.  Ancestry is a handful of rows
and is broadcast after its size is known; the log is joined and ranked by
record.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.canonical import canonical_json, content_hash, envelope
from ..session import scratch

#: Ancestries are resolved on the driver up to this many branches.
MOST_BRANCHES = 100_000
#: Conflicts that a refused merge names.
MOST_CONFLICTS = 1_000


class StoreError(ValueError):
    pass


def ancestry(branches: DataFrame, branch: str) -> list[tuple[str, int]]:
    """``(branch, depth)`` from a branch to its root; a cycle ends the walk."""
    rows = branches.select("id", "parent").limit(MOST_BRANCHES + 1).collect()
    if len(rows) > MOST_BRANCHES:
        raise StoreError("too many branches to resolve on the driver")
    parents = {r["id"]: r["parent"] for r in rows}
    if branch not in parents:
        raise StoreError(f"no branch {branch}")
    chain: list[tuple[str, int]] = []
    at: str | None = branch
    while at is not None and at in parents and all(at != b for b, _ in chain):
        chain.append((at, len(chain)))
        at = parents[at]
    return chain


def visible(log: DataFrame, chain: list[tuple[str, int]]) -> DataFrame:
    """The rows a branch shows: per record the nearest branch's latest row, unless it is a tombstone.

    The window's key holds schema and namespace, which a record_id determines,
    so that predicates on them reach the scan.
    """
    depth = F.element_at(F.create_map(*[x for b, d in chain for x in (F.lit(b), F.lit(d))]), F.col("branch"))
    own = log.where(F.col("branch").isin([b for b, _ in chain])).withColumn("_depth", depth)
    first = Window.partitionBy("record_id", "schema", "namespace").orderBy("_depth", F.desc("seq"))
    return own.withColumn("_rank", F.row_number().over(first)).where("_rank = 1 and not is_tombstone").drop("_rank", "_depth")


def newest_first(rows: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    ordered = rows.orderBy(F.desc("created_at_ms"), "record_id")
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def get_record(log: DataFrame, chain: list[tuple[str, int]], record_id: str) -> DataFrame:
    """The record as the branch shows it: one row or none."""
    return visible(log.where(F.col("record_id") == record_id), chain)


def has_record(log: DataFrame, chain: list[tuple[str, int]], record_id: str) -> bool:
    return not get_record(log, chain, record_id).isEmpty()


def by_schema(log: DataFrame, chain: list[tuple[str, int]], schema: str, limit: int, offset: int = 0) -> DataFrame:
    return newest_first(visible(log, chain).where(F.col("schema") == schema), limit, offset)


def by_namespace(log: DataFrame, chain: list[tuple[str, int]], namespace: str, limit: int, offset: int = 0) -> DataFrame:
    return newest_first(visible(log, chain).where(F.col("namespace") == namespace), limit, offset)


def tail(log: DataFrame, namespace: str, after_seq: int, limit: int | None = 100, branch: str | None = None) -> DataFrame:
    """Live rows of the change log beyond a sequence number, in order; a row that a merge re-homed does not show again."""
    rows = log.where((F.col("namespace") == namespace) & (F.col("seq") > after_seq) & ~F.col("is_tombstone") & F.col("tail_visible"))
    if branch is not None:
        rows = rows.where(F.col("branch") == branch)
    latest = Window.partitionBy("branch", "record_id").orderBy(F.desc("seq"))
    rows = rows.withColumn("_rank", F.row_number().over(latest)).where("_rank = 1").drop("_rank").orderBy("seq")
    return rows if limit is None else rows.limit(limit)


def latest(rows: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Latest-wins view of an append-only table."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def change_counts(log: DataFrame) -> DataFrame:
    """``branch, change_count``: how many records each branch has written or deleted itself."""
    return log.where(F.col("op") != "move").groupBy("branch").agg(F.count_distinct("record_id").alias("change_count"))


def change_sets(log: DataFrame, branch: str) -> DataFrame:
    """``record_id, is_present`` of what a branch itself has written or deleted."""
    own = log.where((F.col("branch") == branch) & (F.col("op") != "move"))
    return latest(own, ["record_id"]).select("record_id", "schema", "namespace", (~F.col("is_tombstone")).alias("is_present"))


def merge_conflicts(log: DataFrame, branch: str, parent: str, deletes_conflict: bool = False) -> DataFrame:
    """Records that both a branch and its parent changed.

    A branch's deletion of what its parent holds is a deletion, not a
    conflict, unless ``deletes_conflict``.
    """
    mine = change_sets(log, branch)
    theirs = latest(log.where(F.col("branch") == parent), ["record_id"]).select("record_id")
    both = mine.join(theirs, "record_id", "left_semi")
    return both.select("record_id") if deletes_conflict else both.where("is_present").select("record_id")


def merge_moves(log: DataFrame, branch: str, parent: str, next_seq: int) -> DataFrame:
    """Log rows that re-home a branch's changes to its parent.

    Original sequence numbers are kept in ``origin_seq``; new ones follow
    ``next_seq`` in their order.  One append makes the whole merge.
    """
    mine = latest(log.where((F.col("branch") == branch)), ["record_id"])
    order = mine.select("record_id", F.col("seq").alias("_old"))
    numbered = numbered_rows(order, "_old", "record_id", start=next_seq).select("record_id", F.col("_n").alias("_seq"))
    return mine.join(numbered, "record_id").select(
        *[c for c in S_COLUMNS if c not in ("branch", "op", "seq", "origin_seq", "tail_visible", "is_tombstone")],
        F.lit(parent).alias("branch"), F.lit("move").alias("op"), F.col("_seq").alias("seq"), F.coalesce("origin_seq", "seq").alias("origin_seq"), "is_tombstone", F.lit(False).alias("tail_visible"),
    ).select(S_COLUMNS)


S_COLUMNS = [part.split()[0] for part in S.RECORD_LOG.split(", ")]


def numbered_rows(rows: DataFrame, *order: str, start: int = 0) -> DataFrame:
    """``_n``: consecutive numbers in the given order, without sorting everything in one task.

    Rows are range-partitioned in order and written to the shared folder, so
    that a lost executor renumbers nothing; numbers are counted within a
    partition and shifted by the rows of those before it.
    """
    spark, to = rows.sparkSession, scratch(rows.sparkSession)
    rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).write.parquet(to)
    placed = spark.read.parquet(to)
    sizes = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a partition
    shift, shifts = start, {}
    for p in sorted(sizes):
        shifts[p] = shift
        shift += sizes[p]
    offset = F.element_at(F.create_map(*[x for p, s in shifts.items() for x in (F.lit(p), F.lit(s))]), F.col("_part")) if shifts else F.lit(start)
    w = Window.partitionBy("_part").orderBy(*order)
    return placed.withColumn("_n", offset + F.row_number().over(w) - 1).drop("_part")


@dataclass
class MergeResult:
    """``conflicts`` names the first MOST_CONFLICTS of ``n_conflicts`` records; ``merge_conflicts`` gives all as rows."""

    merged: int
    conflicts: list[str]
    n_conflicts: int = 0


class RecordStore:
    """Tables as DataFrames on a path: each write is one Parquet append; a single writer numbers the rows."""

    TABLES = {"namespaces": f"{S.NAMESPACE}, seq bigint", "schemas": f"{S.SCHEMA}, seq bigint", "branches": f"{S.BRANCH}, seq bigint", "log": S.RECORD_LOG, "reinforce": S.REINFORCE_LOG, "archive": "record_id string, archived_at_ms bigint, seq bigint"}

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        for name, ddl in self.TABLES.items():
            try:
                spark.read.parquet(f"{self.path}/{name}")
            except Exception as e:
                if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
                    raise
                spark.createDataFrame([], ddl).write.mode("append").parquet(f"{self.path}/{name}")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.TABLES[name]).parquet(f"{self.path}/{name}")

    def _append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.path}/{name}")

    def _next(self, name: str) -> int:
        return (self.table(name).agg(F.max("seq")).first()[0] or 0) + 1

    # dimensions
    def namespaces(self) -> DataFrame:
        return latest(self.table("namespaces"), ["id"]).orderBy("created_at_ms", "id")

    def branches(self, namespace: str | None = None) -> DataFrame:
        rows = latest(self.table("branches"), ["id"])
        return rows.where(F.col("namespace") == namespace) if namespace else rows

    def schemas(self, namespace: str | None = None) -> DataFrame:
        rows = latest(self.table("schemas"), ["id"])
        return rows.where(F.col("namespace") == namespace) if namespace else rows

    def _one(self, rows: DataFrame, key: str):
        return rows.where(F.col("id") == key).first()

    def create_namespace(self, id: str, name: str, owner: str, created_at_ms: int, description: str | None = None, encrypted: bool = False) -> None:
        if self._one(self.namespaces(), id):
            raise StoreError(f"namespace {id} exists")
        self._append("namespaces", self.spark.createDataFrame([(id, name, owner, description, created_at_ms, encrypted, [], self._next("namespaces"))], self.TABLES["namespaces"]))
        self.create_branch(f"{id}/main", id, None, "main", created_at_ms)

    def register_schema(self, id: str, version: str, namespace: str, name: str, fields: list[tuple], registered_at_ms: int) -> None:
        """The latest registration of an id wins; the namespace lists it once."""
        ns = self._one(self.namespaces(), namespace)
        if ns is None:
            raise StoreError(f"no namespace {namespace}")
        self._append("schemas", self.spark.createDataFrame([(id, version, namespace, name, [tuple(f) for f in fields], registered_at_ms, self._next("schemas"))], self.TABLES["schemas"]))
        if id not in ns["schemas"]:
            self._append("namespaces", self.spark.createDataFrame([(*ns[:6], [*ns["schemas"], id], self._next("namespaces"))], self.TABLES["namespaces"]))

    def create_branch(self, id: str, namespace: str, parent: str | None, label: str, created_at_ms: int) -> None:
        if self._one(self.branches(), id):
            raise StoreError(f"branch {id} exists")
        if parent is not None and not self._one(self.branches(), parent):
            raise StoreError(f"no branch {parent}")
        self._append("branches", self.spark.createDataFrame([(id, namespace, parent, "active", created_at_ms, label, self._next("branches"))], self.TABLES["branches"]))

    def _state(self, branch: str, state: str) -> None:
        b = self._one(self.branches(), branch)
        self._append("branches", self.spark.createDataFrame([(b["id"], b["namespace"], b["parent"], state, b["created_at_ms"], b["label"], self._next("branches"))], self.TABLES["branches"]))

    def abandon_branch(self, branch: str) -> None:
        self._active(branch)
        self._state(branch, "abandoned")

    def _active(self, branch: str):
        b = self._one(self.branches(), branch)
        if b is None:
            raise StoreError(f"no branch {branch}")
        if b["state"] != "active":
            raise StoreError(f"branch {branch} is {b['state']}")
        return b

    # records
    def put(self, records: DataFrame, branch: str) -> None:
        """Upsert rows of the record schema; an equal record written twice shows once, a put after a delete shows again."""
        self._active(branch)
        rows = with_ids(records)
        rows = numbered_rows(rows, "created_at_ms", "record_id", start=self._next("log"))
        self._append("log", rows.select(*[c for c in S_COLUMNS if c in rows.columns], F.lit(branch).alias("branch"), F.lit("put").alias("op"), F.col("_n").alias("seq"), F.lit(None).cast("bigint").alias("origin_seq"), F.lit(False).alias("is_tombstone"), F.lit(True).alias("tail_visible")).select(S_COLUMNS))

    def remember(self, records: DataFrame, branch: str) -> None:
        """``put``, after a check that each record's schema is registered in its namespace."""
        known = self.schemas().select(F.col("id").alias("schema"), "namespace")
        if not records.join(known, ["schema", "namespace"], "left_anti").isEmpty():
            raise StoreError("a schema is not registered in its namespace")
        self.put(records, branch)

    def note(self, namespace: str, owner: str, content: str, now_ms: int) -> None:
        """A free-form record; namespace and note schema are made as needed."""
        if not self._one(self.namespaces(), namespace):
            self.create_namespace(namespace, namespace, owner, now_ms)
        if not self._one(self.schemas(), f"{namespace}.note"):
            self.register_schema(f"{namespace}.note", "1.0.0", namespace, "note", [("content", "json", True, None)], now_ms)
        row = self.spark.createDataFrame([(None, f"{namespace}.note", namespace, owner, now_ms, content, None, None)], S.RECORD)
        self.put(row, f"{namespace}/main")

    def delete(self, record_id: str, branch: str, now_ms: int) -> None:
        """A tombstone, which carries the record's schema and namespace."""
        self._active(branch)
        seen = get_record(self.table("log"), self.chain(branch), record_id).limit(1)
        if seen.isEmpty():
            raise StoreError(f"no record {record_id}")
        row = seen.select("record_id", "schema", "namespace", "created_by", F.lit(now_ms).cast("bigint").alias("created_at_ms"), F.lit(None).cast("string").alias("data"), F.lit(None).cast("string").alias("previous_version"), F.lit(None).cast("string").alias("sig"), F.lit(branch).alias("branch"), F.lit("tombstone").alias("op"), F.lit(self._next("log")).cast("bigint").alias("seq"), F.lit(None).cast("bigint").alias("origin_seq"), F.lit(True).alias("is_tombstone"), F.lit(False).alias("tail_visible"))
        self._append("log", self.spark.createDataFrame(row.select(S_COLUMNS).collect(), S.RECORD_LOG))

    def merge(self, branch: str, deletes_conflict: bool = False) -> MergeResult:
        """All or nothing: conflicts leave both branches as they were."""
        b = self._active(branch)
        if b["parent"] is None:
            raise StoreError(f"branch {branch} has no parent")
        log = self.table("log")
        rows = merge_conflicts(log, branch, b["parent"], deletes_conflict)
        conflicts = [r[0] for r in rows.orderBy("record_id").limit(MOST_CONFLICTS).collect()]
        if conflicts:
            return MergeResult(0, conflicts, len(conflicts) if len(conflicts) < MOST_CONFLICTS else rows.count())
        moves = merge_moves(log, branch, b["parent"], self._next("log")).persist()
        n = moves.count()
        self._append("log", moves)
        moves.unpersist()
        self._state(branch, "merged")
        return MergeResult(n, [])

    def chain(self, branch: str) -> list[tuple[str, int]]:
        return ancestry(self.branches(), branch)

    def visible(self, branch: str) -> DataFrame:
        return visible(self.table("log"), self.chain(branch))

    def reinforce(self, record_id: str, delta: float, now_ms: int) -> None:
        self._append("reinforce", self.spark.createDataFrame([(record_id, float(delta), now_ms, self._next("reinforce"))], S.REINFORCE_LOG))

    def archive(self, record_id: str, now_ms: int) -> None:
        self._append("archive", self.spark.createDataFrame([(record_id, now_ms, self._next("archive"))], self.TABLES["archive"]))

    def metadata(self) -> DataFrame:
        from .metadata import fold

        return fold(self.table("reinforce"), self.table("archive"))


def with_ids(records: DataFrame, algorithm: str = "sha256") -> DataFrame:
    """Records with canonical data, and ids that are the hash of their canonical envelope where they have none.

    Envelopes over 256 KiB fail the write.
    """
    rows = records.withColumn("data", canonical_json("data"))
    text = envelope(F.col("schema"), F.col("namespace"), F.col("created_by"), F.col("created_at_ms"), F.col("data"), F.col("previous_version"))
    rows = rows.withColumn("_envelope", text)
    small = F.when(F.octet_length("_envelope") > S.MOST_RECORD_BYTES, F.raise_error(F.lit("record is too large"))).otherwise(content_hash(F.col("_envelope"), algorithm))
    return rows.withColumn("record_id", F.coalesce("record_id", small)).drop("_envelope")


def integrity_ok(records: DataFrame, algorithm: str = "sha256") -> Column:
    """The record's id is the hash of its envelope."""
    text = envelope(F.col("schema"), F.col("namespace"), F.col("created_by"), F.col("created_at_ms"), canonical_json("data"), F.col("previous_version"))
    return F.coalesce(content_hash(text, algorithm) == F.col("record_id"), F.lit(False))


def version_chain(records: DataFrame, folder: str, depth: int | None = None) -> DataFrame:
    """``record_id, version_of, steps``: each record with each earlier version, up to ``depth`` steps back if it is given.

    Links are doubled: after round n all pairs at most 2**n steps apart are
    known, each round one join, written to ``folder``.  A cycle of versions is
    an error.
    """
    spark = records.sparkSession

    def saved(rows: DataFrame, name: str) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{folder}/{name}")

    step = records.select("record_id", F.col("previous_version").alias("version_of")).where("version_of is not null")
    known = saved(step.withColumn("steps", F.lit(1)), "versions-0")
    reach, n, most = 1, 0, known.count()
    while depth is None or reach < depth:
        far = known.where(F.col("steps") == reach).select("record_id", F.col("version_of").alias("_at"))  # as far as is known
        more = far.join(known.select(F.col("record_id").alias("_at"), "version_of", "steps"), "_at").select("record_id", "version_of", (F.col("steps") + reach).alias("steps"))
        if depth is not None:
            more = more.where(F.col("steps") <= depth)
        if more.isEmpty():
            break
        if reach > most:
            raise StoreError("versions go round in a circle")
        n, reach = n + 1, 2 * reach
        known = saved(known.unionByName(more), f"versions-{n}")
    return known


def namespace_status(log_visible: DataFrame, branches: DataFrame, namespaces: DataFrame, caller: str) -> DataFrame:
    """Per namespace: branches, records on its main branch, active digest branches, whether the caller owns it."""
    per_branch = branches.groupBy("namespace").agg(F.count(F.lit(1)).alias("branch_count"), F.count_if((F.col("state") == "active") & (F.col("label").startswith("digest-") | F.col("label").startswith("agent-digest-"))).alias("active_digests"))
    records = log_visible.groupBy("namespace").agg(F.count(F.lit(1)).alias("main_records"))
    out = namespaces.select(F.col("id").alias("namespace"), (F.col("owner") == caller).alias("is_owner"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.join(per_branch, "namespace", "left").join(records, "namespace", "left").select("namespace", "is_owner", zero("branch_count"), zero("active_digests"), zero("main_records"))
