"""Fields of provider responses, judged one by one: typed values, and faults where a value is not what it should be."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import schemas

FAULTS = "faults"
_DAY = r"^\d{4}-\d{2}-\d{2}$"


def _date(text: Column) -> Column:
    return F.when(text.rlike(_DAY), text.try_cast("date"))


#: Typed value of a text, null where it is none, and what is said then.
KINDS = {
    "date": (_date, "not a date"),
    "stamp": (lambda text: _date(F.substring(text, 1, 10)), "not a date"),
    "price": (lambda text: text.try_cast(schemas.PRICE), "not a number"),
    "amount": (lambda text: text.try_cast("decimal(28,4)"), "not a number"),
    "number": (lambda text: F.when(text.try_cast("double").isNotNull() & ~F.isnan(text.try_cast("double")), text), "not a number"),
    "count": (lambda text: text.try_cast("double").try_cast("bigint"), "not a whole number"),
    "whole": (lambda text: text.try_cast("bigint"), "not a whole number"),
    "text": (lambda text: text, "missing"),
}


@dataclass(frozen=True)
class Field:
    """A field of an item: its text, its kind, and what holds where it is absent (null, or empty and not required)."""

    name: str
    text: Column
    kind: str
    required: bool = True
    default: object = None

    def value(self) -> Column:
        typed = KINDS[self.kind][0](self._given())
        return typed if self.default is None else F.when(self._given().isNull(), F.lit(self.default).cast(typed_name(self.kind))).otherwise(typed)

    def _given(self) -> Column:
        return F.when(F.trim(self.text) != "", F.trim(self.text))

    def fault(self) -> Column:
        convert, reason = KINDS[self.kind]
        given = self._given()
        missing = F.when(given.isNull(), F.lit("missing")) if self.required else F.lit(None)
        reason = F.coalesce(missing, F.when(given.isNotNull() & convert(given).isNull(), F.lit(reason)))
        return F.when(reason.isNotNull(), F.struct(F.lit(self.name).alias("field"), self.text.alias("value"), reason.alias("reason")))


def typed_name(kind: str) -> str:
    return {"price": schemas.PRICE.simpleString(), "amount": "decimal(28,4)", "count": "bigint", "whole": "bigint"}.get(kind, "string")


def judged(items: DataFrame, fields: Sequence[Field], keep: Sequence[str]) -> DataFrame:
    """`keep` and the typed fields of each item, with its faults; an item without faults has an empty list of them."""
    return items.select(*keep, *[f.value().alias(f.name) for f in fields], F.array_compact(F.array(*[f.fault() for f in fields])).alias(FAULTS))


def accepted(rows: DataFrame) -> DataFrame:
    """Items all of whose fields hold."""
    return rows.filter(F.size(FAULTS) == 0).drop(FAULTS)


def rejected(rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per fault: `keep`, field, value (as it came), reason."""
    return rows.select(*keep, F.explode(FAULTS).alias("fault")).select(*keep, "fault.field", "fault.value", "fault.reason")
