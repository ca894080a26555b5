"""Column expressions shared by the operators."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANKS = " \t\n\r\x0b\x0c"


def is_numeric(kind: T.DataType) -> bool:
    """Numbers; booleans are none."""
    return isinstance(kind, T.NumericType)


def missing(name: str, kind: T.DataType) -> Column:
    """Null, NaN, or a blank string."""
    c = F.col(f"`{name}`")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return c.isNull() | F.isnan(c)
    if isinstance(kind, T.StringType):
        return c.isNull() | (F.btrim(c, F.lit(BLANKS)) == "")
    return c.isNull()


def number(name: str, kind: T.DataType) -> Column:
    """The column as double, NaN as null; strings that are no numbers as null."""
    c = F.col(f"`{name}`")
    made = c.try_cast("double") if isinstance(kind, T.StringType) else c.cast("double")
    return F.when(~F.isnan(made), made)


def present(name: str, kind: T.DataType) -> Column:
    """The column with NaN as null."""
    c = F.col(f"`{name}`")
    return F.when(~F.isnan(c), c) if isinstance(kind, (T.FloatType, T.DoubleType)) else c


def text_of(name: str, kind: T.DataType) -> Column:
    """The value as Python writes it: True and False, nan for missing numbers, None for other nulls."""
    c = F.col(f"`{name}`")
    if isinstance(kind, T.BooleanType):
        return F.coalesce(F.initcap(c.cast("string")), F.lit("None"))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(c.isNull() | F.isnan(c), F.lit("nan")).otherwise(c.cast("string"))
    if is_numeric(kind):
        return F.coalesce(c.cast("string"), F.lit("nan"))
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return F.coalesce(F.to_json(c), F.lit("None"))
    return F.coalesce(c.cast("string"), F.lit("None"))


def skewness(x: Column) -> Column:
    """Bias-corrected skewness; 0 for constants and for fewer than three values."""
    n = F.count(x).cast("double")
    return F.when(n > 2, F.coalesce(F.skewness(x) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)), F.lit(0.0))).otherwise(F.lit(0.0))


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of the rows where both are present; null for constants."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(F.when(b.isNotNull(), a)) * F.stddev_pop(F.when(a.isNotNull(), b)))


def normalised_name(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(F.btrim(c)), "[^a-z0-9]+", "_"), F.lit("_"))


def unit_interval(c: Column) -> Column:
    """A text's place in [0, 1]: the first 12 hex digits of its sha256."""
    return F.conv(F.substring(F.sha2(c.cast("binary"), 256), 1, 12), 16, 10).cast("long") / F.lit(16**12 - 1)


#: The URL name space of name-based identifiers (RFC 4122), a fixed value.
URL_SPACE = "6ba7b8119dad11d180b400c04fd430c8"


def name_id(c: Column) -> Column:
    """32 hex digits of the version 5 identifier of a name in the URL name space."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_SPACE)), c.cast("binary")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3))).bitwiseOR(F.lit(8)).cast("long")))
    return F.concat(F.substring(h, 1, 12), F.lit("5"), F.substring(h, 14, 3), variant, F.substring(h, 18, 15))


def probe_id(dataset: Column, kind: Column, reason: Column) -> Column:
    return F.concat(F.lit("probe_"), F.substring(name_id(F.concat_ws(":", dataset, kind, reason)), 1, 16))


def canonical_json(value: Any) -> str:
    """Sorted keys, no blanks, letters as they are."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def payload_hash(value: Any) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()
