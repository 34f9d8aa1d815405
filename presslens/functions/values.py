"""Dates, numbers, arrays, maps and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The date formats that are tried after ISO, in this order.
DATE_FORMATS = ["yyyy-MM-dd", "dd-MM-yyyy", "dd/MM/yyyy", "yyyy/MM/dd"]
EPSILON = 1e-9


def timestamp(c: Column) -> Column:
    """A timestamp, null where the text isn't one."""
    return F.try_to_timestamp(F.trim(c))


def any_timestamp(c: Column) -> Column:
    t = F.trim(c)
    return F.coalesce(F.try_to_timestamp(t), *[F.try_to_timestamp(t, F.lit(f)) for f in DATE_FORMATS])


def stamp(c: Column) -> Column:
    """A 14-digit archive stamp as a timestamp."""
    return F.try_to_timestamp(c, F.lit("yyyyMMddHHmmss"))


def iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def day(c: Column) -> Column:
    return F.nullif(F.substring(c, 1, 10), F.lit(""))


def ratio(a: Column, b: Column) -> Column:
    return a / (b + F.lit(EPSILON))


def number(c: Column) -> Column:
    return c.try_cast("double")


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0 or null."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def logistic(c: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))


def positive_probability(negative: Column, positive: Column) -> Column:
    """Softmax of two logits, the positive one's share; neither exponential overflows."""
    top = F.greatest(negative, positive)
    return F.exp(positive - top) / (F.exp(negative - top) + F.exp(positive - top))


def list_of(c: Column, sep: str = ";") -> Column:
    """The non-empty parts of a list in a text."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), sep), lambda x: F.trim(x)), lambda x: x != "")


def first_string(c: Column) -> Column:
    """The first non-null string of a nested list."""
    return F.try_element_at(F.filter(F.flatten(c), lambda x: x.isNotNull()), F.lit(1))


def text_or_object(json: Column) -> Column:
    """A JSON value that is a plain text or an object with the text under #text; null for an object without."""
    plain = F.when(~json.startswith("{"), F.nullif(F.regexp_replace(json, '^"|"$', ""), F.lit("")))
    return F.coalesce(F.get_json_object(json, "$.#text"), plain)
