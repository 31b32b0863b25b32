"""Schema descriptions of text tables and their types."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import types as T

from ..errors import QueryError

TYPES = {"INTEGER": T.IntegerType(), "STRING": T.StringType(), "REAL": T.FloatType()}
KEYS = {"PK": "primary", "FK": "foreign", "NK": "none"}


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    kind: str
    range: int
    key: str
    size: int


@dataclass(frozen=True)
class TableSpec:
    """A description: how many columns, how many bytes a row, then name, type, range, key and bytes of each."""

    columns: tuple[ColumnSpec, ...]
    row_bytes: int

    @property
    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, TYPES[c.kind], True, {"key": KEYS[c.key]}) for c in self.columns])


def parse_spec(text: str) -> TableSpec:
    words = text.split()
    try:
        n, row_bytes = int(words[0]), int(words[1])
        parts = [words[2 + 5 * i : 7 + 5 * i] for i in range(n)]
        columns = tuple(ColumnSpec(a, b, int(c), d, int(e)) for a, b, c, d, e in parts)
    except (ValueError, IndexError):
        raise QueryError("a schema description is cut short or has no number where one belongs") from None
    for c in columns:
        if c.kind not in TYPES or c.key not in KEYS:
            raise QueryError(f"column {c.name} has type {c.kind} and key {c.key}")
    return TableSpec(columns, row_bytes)


def read_spec(path: str | Path) -> TableSpec:
    return parse_spec(Path(path).read_text())
