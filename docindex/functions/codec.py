"""Register codecs: text to typed value and back."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A pair of functions of a column, for registers of the user's own kind.
Custom = tuple[Callable[[Column], Column], Callable[[Column], Column]]
TYPES: dict[str, T.DataType] = {"binary": T.StringType(), "atom": T.StringType(), "existing_atom": T.StringType(), "list": T.StringType(), "boolean": T.BooleanType(), "integer": T.LongType(), "float": T.DoubleType()}


def _fail(message: str, strict: bool, kind: str) -> Column:
    return F.raise_error(F.lit(message)).cast(kind) if strict else F.lit(None).cast(kind)


def decode(c: Column, kind: str | Custom, strict: bool = True, domain: Iterable[str] = ()) -> Column:
    """The typed value of a text. Empty text is null in all types but binary; other misfits raise, or are null."""
    if isinstance(kind, tuple):
        return kind[1](c)
    if kind == "binary":
        return c
    text = F.nullif(c, F.lit(""))
    if kind in ("atom", "list"):
        return text
    if kind == "existing_atom":
        return F.when(text.isNull() | text.isin(*domain), text).otherwise(_fail("badarg: unknown atom", strict, "string"))
    if kind == "boolean":
        return F.when(text == "true", True).when(text == "false", False).when(text.isNull(), None).otherwise(_fail("badarg: boolean", strict, "boolean"))
    if kind == "integer":
        fits, to = text.rlike(r"^[+-]?[0-9]+$"), "bigint"
    elif kind == "float":
        fits, to = text.rlike(r"^[+-]?[0-9]+\.[0-9]+([eE][+-]?[0-9]+)?$"), "double"
    else:
        raise ValueError(f"badtype: {kind!r}")
    value = text.cast(to) if strict else text.try_cast(to)
    return F.when(text.isNull(), F.lit(None).cast(to)).when(fits, value).otherwise(_fail(f"badarg: {kind}", strict, to))


def encode(c: Column, kind: str | Custom) -> Column:
    """The text of a typed value; null is the empty text."""
    if isinstance(kind, tuple):
        return kind[0](c)
    if kind not in TYPES:
        raise ValueError(f"badtype: {kind!r}")
    return F.coalesce(c.cast("string"), F.lit(""))


def from_base(c: Column, base: int) -> Column:
    """The number written in a base of 2 to 36."""
    if not 2 <= base <= 36:
        raise ValueError("badarg: base")
    return F.conv(c, base, 10).cast("bigint")
