"""The data model: table schemas, declared field types, and validation.

Records are immutable rows; everything mutable is an append-only log that a
view folds.  Declared field types are checked by an explicit operator only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, LongType, StringType, StructField, StructType, VariantType

from .functions.jsonval import is_number, member

RECORD = "record_id string, schema string, namespace string, created_by string, created_at_ms bigint, data string, previous_version string, sig string"
RECORD_LOG = f"{RECORD}, branch string, op string, seq bigint, origin_seq bigint, is_tombstone boolean, tail_visible boolean"
NAMESPACE = "id string, name string, owner string, description string, created_at_ms bigint, encrypted boolean, schemas array<string>"
SCHEMA = "id string, version string, namespace string, name string, fields array<struct<name:string,field_type:string,required:boolean,description:string>>, registered_at_ms bigint"
BRANCH = "id string, namespace string, parent string, state string, created_at_ms bigint, label string"
BRANCH_CHANGE = "branch string, record_id string, is_present boolean, seq bigint"
REINFORCE_LOG = "record_id string, delta double, at_ms bigint, seq bigint"
METADATA = "record_id string, score double, reinforce_count bigint, last_reinforced_at_ms bigint, first_seen_ms bigint, archived_at_ms bigint"
VECTOR = "namespace string, record_id string, embedding array<float>"
DELTA = f"device_id string, namespace string, branch string, from_cursor bigint, to_cursor bigint, records array<struct<{RECORD.replace(' ', ':').replace(',:', ',')}>>, tombstones array<string>, created_at_ms bigint"
MANIFEST = "device_id string, namespace string, last_push_cursor bigint, last_pull_cursor bigint, pushed_tombstones array<string>, updated_at_ms bigint"
FACT = "statement string, topic string, confidence double, derived_from array<string>, rationale string, supersedes string"
CONSENT = "action string, description string, consenter string, target string, namespace string, consented_at_ms bigint, expires_at_ms bigint"
DELEGATION = "delegation_id string, delegator string, delegate string, scopes array<string>, namespaces array<string>, created_at_ms bigint, expires_at_ms bigint, max_queries bigint, queries_used bigint, revoked boolean"

#: Bytes of a record's canonical envelope.
MOST_RECORD_BYTES = 262_144


@dataclass(frozen=True)
class FieldType:
    """A declared type: a base name, or ``array``/``optional`` of another."""

    name: str
    item: FieldType | None = None

    @classmethod
    def parse(cls, text: str) -> FieldType:
        t = text.strip().lower()
        for outer in ("array", "optional"):
            if t.startswith(outer) and t[len(outer) :][:1] in "(<" and t[-1:] in ")>":
                return cls(outer, cls.parse(t[len(outer) + 1 : -1]))
        if t not in ("string", "integer", "float", "boolean", "timestamp", "blob", "json"):
            raise ValueError(f"unknown field type {text!r}")
        return cls(t)

    def spark(self) -> DataType:
        if self.name == "array":
            return ArrayType(self.item.spark())
        if self.name == "optional":
            return self.item.spark()
        return {"string": StringType(), "blob": StringType(), "integer": LongType(), "timestamp": LongType(), "float": DoubleType(), "boolean": BooleanType(), "json": VariantType()}[self.name]


@dataclass(frozen=True)
class SchemaField:
    name: str
    field_type: FieldType
    required: bool = False


def struct_of(fields: list[SchemaField]) -> StructType:
    """The typed view of a declared schema; nothing in it is non-null, as enforcement is opt-in."""
    return StructType([StructField(f.name, f.field_type.spark()) for f in fields])


def _type_error(v: Column, tag: Column, kind: FieldType, name: str, depth: int = 0) -> Column:
    """The message of the first mismatch, or null."""
    if kind.name == "json":
        return F.lit(None).cast("string")
    if kind.name == "optional":
        return F.when(tag == "VOID", F.lit(None)).otherwise(_type_error(v, tag, kind.item, name, depth))
    said = lambda want: F.concat(F.lit(f"field '{name}': expected {want}, got "), value_type_name(tag))
    if kind.name == "array":
        items = F.try_variant_get(v, "$", "array<variant>")
        each = F.transform(items, lambda x, i: _type_error(x, F.schema_of_variant(x), kind.item, f"{name}[]", depth + 1))
        return F.when(~tag.startswith("ARRAY"), said("array")).otherwise(F.get(F.filter(each, lambda m: m.isNotNull()), 0))
    ok = {
        "string": tag == "STRING", "blob": tag == "STRING", "boolean": tag == "BOOLEAN",
        "integer": (tag == "BIGINT") | (tag == "DECIMAL(20,0)"), "timestamp": (tag == "BIGINT") | (tag == "DECIMAL(20,0)"), "float": is_number(tag),
    }[kind.name]
    return F.when(~ok, said(kind.name))


def value_type_name(tag: Column) -> Column:
    """The name of a JSON value's type."""
    return F.when(tag == "VOID", "null").when(tag == "BOOLEAN", "boolean").when(is_number(tag), "number").when(tag == "STRING", "string").when(tag.startswith("ARRAY"), "array").otherwise("object")


def validation_error(data: Column, fields: list[SchemaField]) -> Column:
    """Why JSON text ``data`` does not fit the declared fields, or null.

    Data must be an object; required fields must be present (null counts as
    present); present fields must have their type; other fields are allowed.
    """
    v = F.try_parse_json(data)
    checks = []
    for f in fields:
        x = member(v, f.name)
        wrong = _type_error(x, F.schema_of_variant(x), f.field_type, f.name)
        missing = F.lit(f"missing required field '{f.name}'") if f.required else F.lit(None).cast("string")
        checks.append(F.when(x.isNull(), missing).otherwise(wrong))
    not_object = F.when(v.isNull() | ~F.schema_of_variant(v).startswith("OBJECT"), F.lit("data must be an object"))
    return F.coalesce(not_object, *checks, F.lit(None).cast("string"))


def validate(records: DataFrame, fields: list[SchemaField]) -> DataFrame:
    """``records`` with ``error`` (null: valid)."""
    return records.withColumn("error", validation_error(F.col("data"), fields))
