"""Validation and repair of nested JSON records by a schema, over VARIANT columns.

A schema is built of kinds. ``errors`` walks a value along it, lists in lists included, and gives one message
for each fault with its path, such as ``roles[2].bullets[0]: expected text``. ``repaired`` turns a value into
the schema's struct, mending its form without making facts up. Both are expressions made from the schema,
so a table is validated in one pass without Python.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCALAR, _NUMBER = "^(STRING|BOOLEAN|BIGINT|DOUBLE|FLOAT|DECIMAL)", "^(BIGINT|DOUBLE|FLOAT|DECIMAL)"
_NONE = "array<string>"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once: the one element that an outer step maps."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _no_errors() -> Column:
    return F.array().cast(_NONE)


def _said(path: Column, message: str) -> Column:
    return F.array(F.concat(path, F.lit(f": {message}")))


@dataclass(frozen=True)
class Kind:
    """What may stand at a place; one that is ``nullable`` may be null, but must be there."""

    nullable: bool = field(default=False, kw_only=True)

    def errors(self, value: Column, path: Column) -> Column:
        def use(x: Column) -> Column:
            null = _no_errors() if self.nullable else _said(path, "is null")
            return F.when(x.isNull(), _said(path, "missing")).when(F.is_variant_null(x), null).otherwise(self.faults(x, F.schema_of_variant(x), path))

        return bound(value, use)

    def faults(self, x: Column, kind: Column, path: Column) -> Column:
        raise NotImplementedError

    def repaired(self, value: Column) -> Column:
        return bound(value, lambda x: self.mended(x, F.schema_of_variant(x)))

    def mended(self, x: Column, kind: Column) -> Column:
        raise NotImplementedError


@dataclass(frozen=True)
class Text(Kind):
    """A text of ``least`` letters or more, one of those listed if any are. Repair: numbers and flags become their text."""

    least: int = 0
    one_of: tuple[str, ...] = ()

    def faults(self, x, kind, path):
        text = F.try_variant_get(x, "$", "string")
        out = F.when(kind != "STRING", _said(path, "expected text")).when(F.length(text) < self.least, _said(path, "too short"))
        if self.one_of:
            out = out.when(~text.isin(*self.one_of), _said(path, f"not one of {', '.join(self.one_of)}"))
        return out.otherwise(_no_errors())

    def mended(self, x, kind):
        return F.when(kind.rlike(_SCALAR), F.try_variant_get(x, "$", "string"))


@dataclass(frozen=True)
class Number(Kind):
    """A number, ``least`` or more if given. Repair: the number with which a text begins; else 0, or null if that may be."""

    least: float | None = None

    def faults(self, x, kind, path):
        out = F.when(~kind.rlike(_NUMBER), _said(path, "expected number"))
        if self.least is not None:
            out = out.when(F.try_variant_get(x, "$", "double") < self.least, _said(path, "too small"))
        return out.otherwise(_no_errors())

    def mended(self, x, kind):
        begins = F.regexp_extract(F.try_variant_get(x, "$", "string"), r"^\s*([-+]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+))", 1)
        found = F.when(kind.rlike(_NUMBER), F.try_variant_get(x, "$", "double")).when(kind == "STRING", begins.try_cast("double"))
        return found if self.nullable else F.coalesce(found, F.lit(0.0))


@dataclass(frozen=True)
class Flag(Kind):
    """True or false. Repair: their names as text."""

    def faults(self, x, kind, path):
        return F.when(kind != "BOOLEAN", _said(path, "expected flag")).otherwise(_no_errors())

    def mended(self, x, kind):
        return F.when(kind.isin("BOOLEAN", "STRING"), F.try_variant_get(x, "$", "boolean"))


@dataclass(frozen=True)
class Items(Kind):
    """A list, ``least`` long or more, of one kind. Repair: nothing becomes an empty list, one value a list of it."""

    of: Kind
    least: int = 0

    def faults(self, x, kind, path):
        each = F.transform(F.try_variant_get(x, "$", "array<variant>"), lambda y, i: self.of.errors(y, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        short = F.when(F.size(each) < self.least, _said(path, "too short")).otherwise(_no_errors())
        return F.when(~kind.startswith("ARRAY"), _said(path, "expected list")).otherwise(F.concat(short, F.flatten(each)))

    def mended(self, x, kind):
        none = F.array().cast("array<variant>")
        items = F.when(kind.startswith("ARRAY"), F.try_variant_get(x, "$", "array<variant>")).when(x.isNotNull() & ~F.is_variant_null(x), F.array(x))
        return F.transform(F.coalesce(items, none), self.of.repaired)


@dataclass(frozen=True)
class Record(Kind):
    """Named values. Repair: what is missing is filled as its kind says; a text becomes the field ``from_text`` of a record
    whose others are those of ``made``, if there are such."""

    fields: tuple[tuple[str, Kind], ...]
    from_text: str | None = None
    made: tuple[tuple[str, object], ...] = ()

    def faults(self, x, kind, path):
        each = [k.errors(F.try_variant_get(x, f"$.{n}", "variant"), F.concat(path, F.when(path == "", "").otherwise("."), F.lit(n))) for n, k in self.fields]
        return F.when(~kind.startswith("OBJECT"), _said(path, "expected record")).otherwise(F.concat(*each))

    def mended(self, x, kind):
        def filled(value: Column) -> Column:
            return F.struct(*[k.repaired(F.try_variant_get(value, f"$.{n}", "variant")).alias(n) for n, k in self.fields])

        if not self.from_text:
            return filled(x)
        values = [F.lit(json.dumps(n) + ":" + json.dumps(v)) for n, v in self.made]
        text = F.concat(F.lit(f'"{self.from_text}":'), F.regexp_extract(F.to_json(F.struct(F.try_variant_get(x, "$", "string").alias("v"))), '^[{]"v":(.*)[}]$', 1))
        record = F.concat(F.lit("{"), F.concat_ws(",", text, *values), F.lit("}"))
        return bound(F.when(kind == "STRING", F.try_parse_json(record)).otherwise(x), filled)


def errors(text: Column, schema: Record) -> Column:
    """All faults of a record in a JSON text, in the schema's order; one for a text that is no JSON."""
    return bound(F.try_parse_json(text), lambda v: F.when(v.isNull(), F.array(F.lit("not JSON"))).otherwise(schema.errors(v, F.lit(""))))


def repaired(text: Column, schema: Record) -> Column:
    """The record as the schema's struct; null for a text that is no JSON."""
    return bound(F.try_parse_json(text), lambda v: F.when(v.isNotNull(), schema.mended(v, F.schema_of_variant(v))))


def repaired_json(text: Column, schema: Record) -> Column:
    """The repaired record as JSON that ``errors`` can judge: nulls are written."""
    return F.to_json(repaired(text, schema), {"ignoreNullFields": "false"})
