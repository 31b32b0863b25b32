"""Literals of the dialect and the types that they are compared with."""

from __future__ import annotations

import math
import re
from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import TypeMismatch

_WHOLE = re.compile(r"[+-]?[0-9]+")
#: Numbers, dates and times that Spark's casts take as well.
_REAL = re.compile(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|[+-]?(inf|infinity)|nan", re.IGNORECASE)
_DATE = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}")
_TIME = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?(Z|[+-][0-9]{2}:[0-9]{2})?)?")
_BITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


def is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def comparable(a: T.DataType, b: T.DataType) -> bool:
    """Numbers with numbers, otherwise only equal types."""
    return (is_number(a) and is_number(b)) or a == b


def check_literal(text: str, kind: T.DataType, where: str) -> None:
    """Raise unless text is a literal of the type, without waiting for a row."""
    try:
        if type(kind) in _BITS:
            if not _WHOLE.fullmatch(text.strip()):
                raise ValueError
            if not -(1 << (_BITS[type(kind)] - 1)) <= int(text) < 1 << (_BITS[type(kind)] - 1):
                raise ValueError
        elif is_number(kind):
            if not _REAL.fullmatch(text.strip()) or (isinstance(kind, T.DecimalType) and not math.isfinite(float(text))):
                raise ValueError
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            if not _TIME.fullmatch(text):
                raise ValueError
            datetime.fromisoformat(text)
        elif isinstance(kind, T.DateType):
            if not _DATE.fullmatch(text):
                raise ValueError
            date.fromisoformat(text)
        elif isinstance(kind, T.BooleanType):
            if text.lower() not in ("true", "false"):
                raise ValueError
    except ValueError:
        raise TypeMismatch(f'"{text}" is no {kind.simpleString()} in {where}') from None


def literal(text: str, kind: T.DataType) -> Column:
    """text cast to the column's own type, which constant folding turns into a value that can be pushed down."""
    return F.lit(text).cast(kind)


def compare(left: Column, operator: str, right: Column) -> Column:
    return {
        "<": left < right,
        ">": left > right,
        "<=": left <= right,
        ">=": left >= right,
        "=": left == right,
        "!=": left != right,
    }[operator]
