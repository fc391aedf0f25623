"""Reading JSON lists held in text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cleaning import MONEY, plain_float


def object_items(json_text: Column) -> Column:
    """Object elements of a JSON array as texts; anything else gives an empty array.

    Elements are kept one by one, so a stray number or string drops only itself.
    """
    items = F.from_json(json_text, "array<string>", {"mode": "PERMISSIVE"})
    objects = F.filter(items, lambda x: F.ltrim(x).startswith("{"))
    is_list = F.json_array_length(json_text).isNotNull()
    return F.coalesce(F.when(is_list, objects), F.array().cast("array<string>"))


def list_length(json_text: Column) -> Column:
    """Length of a JSON array; null for an object, a scalar or bad text."""
    return F.json_array_length(json_text)


_PARTICIPANT = "name string, registration_no string, reg_no string, suggested_price_eur string"


def participants(json_text: Column) -> Column:
    """Participant structs ``(name, reg, price)`` of a JSON list, in list order."""

    def shape(p: Column) -> Column:
        return F.struct(
            p["name"].alias("name"),
            F.coalesce(p["registration_no"], p["reg_no"]).alias("reg"),
            plain_float(p["suggested_price_eur"]).try_cast(MONEY).alias("price"),
        )

    return F.transform(F.transform(object_items(json_text), lambda x: F.from_json(x, _PARTICIPANT)), shape)
