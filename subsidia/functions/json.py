"""Typed reads from JSON text; whatever is missing or of another type is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(text: Column, wrap: bool = False) -> Column:
    """The document as a variant; invalid or missing text reads as ``{}``, or with ``wrap`` as ``{"raw": text}``."""
    other = F.to_json(F.named_struct(F.lit("raw"), text)) if wrap else F.lit("{}")
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(other), F.parse_json(F.lit("{}")))


def _path(keys: tuple[str, ...]) -> str:
    return "$" + "".join(f".{k}" for k in keys)


def get_float(document: Column, *keys: str) -> Column:
    return F.try_variant_get(document, _path(keys), "double")


def get_int(document: Column, *keys: str) -> Column:
    return F.try_variant_get(document, _path(keys), "bigint")


def get_text(document: Column, *keys: str) -> Column:
    return F.try_variant_get(document, _path(keys), "string")


def get_bool(document: Column, *keys: str) -> Column:
    """Booleans, and the words true and false in any case, blanks around them ignored."""
    text = F.lower(F.trim(get_text(document, *keys)))
    return F.when(text == "true", True).when(text == "false", False)


def get_map(document: Column, *keys: str) -> Column:
    """Text by key; an empty map for anything but an object."""
    return F.coalesce(F.try_variant_get(document, _path(keys), "map<string,string>"), F.create_map().cast("map<string,string>"))


def get_list(document: Column, *keys: str) -> Column:
    return F.coalesce(F.try_variant_get(document, _path(keys), "array<string>"), F.array().cast("array<string>"))


def float_map(values: Column) -> Column:
    """Values as numbers, null where they are none."""
    return F.transform_values(values, lambda _, v: v.try_cast("double"))


def text_map(values: Column) -> Column:
    """Any map's keys and values as text, null values kept; an empty map for null."""
    texts = F.transform_keys(F.transform_values(values, lambda _, v: v.cast("string")), lambda k, _: k.cast("string"))
    return F.coalesce(texts, F.create_map().cast("map<string,string>"))


def has_key(document: Column, *keys: str) -> Column:
    return F.try_variant_get(document, _path(keys), "variant").isNotNull()
