"""Fields of JSON payloads, with their types told apart.

A field is a top-level key taken literally.  A missing field is null; an
explicit null is a variant null.  Type guards come before every cast, since
casts would read the text "5" as a number.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_number(tag: Column) -> Column:
    return tag.isin("BIGINT", "DOUBLE", "FLOAT") | tag.startswith("DECIMAL")


def member(v: Column, name: str) -> Column:
    """The value under a key taken literally, as a variant; null if it is missing."""
    for quote in ("'", '"'):
        if quote not in name and "\\" not in name:
            return F.try_variant_get(v, f"$[{quote}{name}{quote}]", "variant")
    return F.try_element_at(F.try_variant_get(v, "$", "map<string,variant>"), F.lit(name))


class Field:
    """One field of a payload column (JSON text or variant)."""

    def __init__(self, data: Column, name: str, variant: bool = False):
        self.v = member(data if variant else F.try_parse_json(data), name)
        self.tag = F.schema_of_variant(self.v)
        self.missing = self.v.isNull()
        self.null = F.coalesce(F.is_variant_null(self.v), F.lit(False))

    def typed(self, kind: str) -> Column:
        return F.try_variant_get(self.v, "$", kind)

    @property
    def number(self) -> Column:
        """As double, if it is a number of any kind."""
        return F.when(is_number(self.tag), self.typed("double"))

    @property
    def string(self) -> Column:
        return F.when(self.tag == "STRING", self.typed("string"))

    @property
    def boolean(self) -> Column:
        return F.when(self.tag == "BOOLEAN", self.typed("boolean"))

    def sort_keys(self) -> list[Column]:
        """A total order: numbers, then text, then booleans, then other values; missing is null in all."""
        rank = F.when(self.missing, F.lit(None)).when(is_number(self.tag), 0).when(self.tag == "STRING", 1).when(self.tag == "BOOLEAN", 2).otherwise(3)
        return [rank, self.number, self.string, self.boolean.cast("int")]
