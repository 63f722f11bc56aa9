"""Predicates over records: a closed set of leaves and connectives, compiled to columns.

Logic is two-valued: each leaf is coalesced to false before it is combined,
so ``Not`` of a comparison with a missing field holds.  Equality is strict
about types (1 is not 1.0); order compares numbers as doubles.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, FloatType, StringType

from ..functions.jsonval import Field

Json = Any


class Filter:
    """A predicate.  ``compile`` gives a column that is never null."""

    def compile(self, frame: Fields) -> Column:
        raise NotImplementedError

    def where(self, frame: Fields) -> Column:
        """For a WHERE clause, where null is as good as false: comparisons stay bare and reach the scan."""
        return self.compile(replace(frame, positive=True))

    def __and__(self, other: Filter) -> Filter:
        return And([self, other])

    def __or__(self, other: Filter) -> Filter:
        return Or([self, other])

    def __invert__(self) -> Filter:
        return Not(self)


@dataclass
class Fields:
    """How to reach payload fields.

    ``promoted`` maps a field to a typed column that holds the same values
    (null: missing); predicates on it reach the Parquet scan.  ``kinds`` names
    those columns' JSON types: int, float, str or bool.
    """

    data: str = "data"
    promoted: dict[str, str] = field(default_factory=dict)
    kinds: dict[str, type] = field(default_factory=dict)
    variant: bool = False
    #: Nulls may stand for false: nothing above negates.
    positive: bool = False

    @classmethod
    def of(cls, records: DataFrame) -> Fields:
        """The fields that ``records`` has as columns of their own (see ``promoted``); others are read from the payload."""
        found = {f.metadata[PROMOTED]: f for f in records.schema.fields if PROMOTED in f.metadata}
        kinds = {StringType: str, BooleanType: bool, DoubleType: float, FloatType: float}
        return cls(promoted={k: f.name for k, f in found.items()}, kinds={k: kinds.get(type(f.dataType), int) for k, f in found.items()})

    def get(self, name: str) -> Field:
        return Field(F.col(self.data), name, self.variant)


#: Key of a column's metadata: the payload field whose values it holds.
PROMOTED = "payload_field"


def promoted(column: Column, name: str) -> Column:
    """A column that holds a payload field's values (null: missing), as ``Fields.of`` finds it."""
    return column.alias(name, metadata={PROMOTED: name})


def _kind(v: Json) -> type | None:
    return None if v is None else bool if isinstance(v, bool) else type(v)


def _sure(c: Column, frame: Fields) -> Column:
    return c if frame.positive else F.coalesce(c, F.lit(False))


def _deep_equal(data: Column, name: str, want: Json) -> Column:
    """Equality with an array or object; types of numbers count, order of keys does not."""

    def same(a: Json, b: Json) -> bool:
        if _kind(a) != _kind(b):
            return False
        if isinstance(a, dict):
            return a.keys() == b.keys() and all(same(v, b[k]) for k, v in a.items())
        if isinstance(a, list):
            return len(a) == len(b) and all(map(same, a, b))
        return a == b

    @F.pandas_udf("boolean")
    def equal(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> bool:
            try:
                doc = json.loads(t) if t is not None else None
            except ValueError:
                return False
            return isinstance(doc, dict) and name in doc and same(doc[name], want)

        return texts.map(one).astype(bool)

    return equal(data)


@dataclass
class Eq(Filter):
    """Same JSON value; a missing field equals nothing, not even null."""

    field: str
    value: Json

    def compile(self, frame: Fields) -> Column:
        kind = _kind(self.value)
        if self.field in frame.promoted:
            return _sure(F.col(frame.promoted[self.field]) == F.lit(self.value), frame) if kind is frame.kinds[self.field] else F.lit(False)
        if kind in (list, dict):
            data = F.col(frame.data)
            return _sure(_deep_equal(F.to_json(data) if frame.variant else data, self.field, self.value), frame)
        f = frame.get(self.field)
        if kind is None:
            return f.null
        if kind is bool:
            return _sure(f.boolean == F.lit(self.value), frame)
        if kind is str:
            return _sure(f.string == F.lit(self.value), frame)
        if kind is int:
            small = -(1 << 63) <= self.value < 1 << 63
            return _sure((f.tag == ("BIGINT" if small else "DECIMAL(20,0)")) & (f.typed("bigint" if small else "decimal(20,0)") == F.lit(self.value).cast("bigint" if small else "decimal(20,0)")), frame)
        return _sure((f.tag.isin("DOUBLE", "FLOAT") | f.tag.startswith("DECIMAL")) & (f.typed("double") == F.lit(float(self.value))), frame)


@dataclass
class Ne(Filter):
    """Exactly not ``Eq``: a missing field is unequal."""

    field: str
    value: Json

    def compile(self, frame: Fields) -> Column:
        return ~Eq(self.field, self.value).compile(replace(frame, positive=False))


@dataclass
class _Order(Filter):
    field: str
    value: Json

    def _test(self, a: Column, b: Column) -> Column:
        raise NotImplementedError

    equal = False

    def compile(self, frame: Fields) -> Column:
        kind = _kind(self.value)
        if self.field in frame.promoted:
            alike = kind is frame.kinds[self.field] or {kind, frame.kinds[self.field]} <= {int, float}
            return _sure(self._test(F.col(frame.promoted[self.field]), F.lit(float(self.value) if kind is int and frame.kinds[self.field] is float else self.value)), frame) if alike and kind is not None else F.lit(False)
        f = frame.get(self.field)
        if kind is None:
            return f.null if self.equal else F.lit(False)
        if kind in (int, float):
            return _sure(self._test(f.number, F.lit(float(self.value))), frame)
        if kind is str:
            return _sure(self._test(f.string, F.lit(self.value)), frame)
        if kind is bool:
            return _sure(self._test(f.boolean, F.lit(self.value)), frame)
        return F.lit(False)


class Gt(_Order):
    def _test(self, a, b):
        return a > b


class Lt(_Order):
    def _test(self, a, b):
        return a < b


class Gte(_Order):
    equal = True

    def _test(self, a, b):
        return a >= b


class Lte(_Order):
    equal = True

    def _test(self, a, b):
        return a <= b


@dataclass
class _Text(Filter):
    field: str
    value: str

    def _test(self, a: Column) -> Column:
        raise NotImplementedError

    def compile(self, frame: Fields) -> Column:
        if self.field in frame.promoted:
            return _sure(self._test(F.col(frame.promoted[self.field])), frame) if frame.kinds[self.field] is str else F.lit(False)
        return _sure(self._test(frame.get(self.field).string), frame)


class Contains(_Text):
    def _test(self, a):
        return F.contains(a, F.lit(self.value))


class StartsWith(_Text):
    def _test(self, a):
        return F.startswith(a, F.lit(self.value))


@dataclass
class CreatedBy(Filter):
    key: str

    def compile(self, frame: Fields) -> Column:
        return _sure(F.col("created_by") == F.lit(self.key), frame)


@dataclass
class CreatedAfter(Filter):
    at_ms: int

    def compile(self, frame: Fields) -> Column:
        return _sure(F.col("created_at_ms") > F.lit(self.at_ms), frame)


@dataclass
class CreatedBefore(Filter):
    at_ms: int

    def compile(self, frame: Fields) -> Column:
        return _sure(F.col("created_at_ms") < F.lit(self.at_ms), frame)


@dataclass
class HasPreviousVersion(Filter):
    def compile(self, frame: Fields) -> Column:
        return F.col("previous_version").isNotNull()


@dataclass
class TypeIn(Filter):
    """The payload's ``type`` is one of a list; a missing one counts as empty text."""

    types: list[str]

    def compile(self, frame: Fields) -> Column:
        kind = F.col(frame.promoted["type"]) if "type" in frame.promoted else frame.get("type").string
        return F.coalesce(kind, F.lit("")).isin(self.types) if self.types else F.lit(True)


@dataclass
class And(Filter):
    filters: list[Filter]

    def compile(self, frame: Fields) -> Column:
        return reduce(lambda a, b: a & b, [f.compile(frame) for f in self.filters], F.lit(True))


@dataclass
class Or(Filter):
    filters: list[Filter]

    def compile(self, frame: Fields) -> Column:
        return reduce(lambda a, b: a | b, [f.compile(frame) for f in self.filters], F.lit(False))


@dataclass
class Not(Filter):
    filter: Filter

    def compile(self, frame: Fields) -> Column:
        return ~self.filter.compile(replace(frame, positive=False))


_LEAVES = {"eq": Eq, "ne": Ne, "gt": Gt, "lt": Lt, "gte": Gte, "lte": Lte, "contains": Contains, "starts_with": StartsWith}


def parse_filter(spec: Json) -> Filter:
    """A filter from its JSON form: ``{op, field, value}``, ``{op: and|or, filters}``, ``{op: not, filter}``."""
    if not isinstance(spec, dict) or not isinstance(spec.get("op"), str):
        raise ValueError("a filter is an object with an op")
    op = spec["op"]
    if op in ("and", "or"):
        if not isinstance(spec.get("filters"), list):
            raise ValueError(f"{op} takes a list of filters")
        parts = [parse_filter(f) for f in spec["filters"]]
        return And(parts) if op == "and" else Or(parts)
    if op == "not":
        return Not(parse_filter(spec.get("filter")))
    if op not in _LEAVES:
        raise ValueError(f"unknown op {op!r}")
    if not isinstance(spec.get("field"), str) or "value" not in spec:
        raise ValueError(f"{op} takes a field and a value")
    if op in ("contains", "starts_with") and not isinstance(spec["value"], str):
        raise ValueError(f"{op} takes text")
    return _LEAVES[op](spec["field"], spec["value"])
