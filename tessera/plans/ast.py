"""The syntax tree of a query. All parts are values: equal texts parse to equal trees."""

from __future__ import annotations

from dataclasses import dataclass

AGGREGATES = ("MAX", "MIN", "SUM", "COUNT", "AVG")
OPERATORS = ("<=", ">=", "!=", "<", ">", "=")


@dataclass(frozen=True)
class Column:
    table: str
    name: str

    def __str__(self) -> str:
        return f"{self.table}.{self.name}"


@dataclass(frozen=True)
class Aggregate:
    function: str
    of: Column

    def __str__(self) -> str:
        return f"{self.function}({self.of})"


Attribute = Column | Aggregate


@dataclass(frozen=True)
class Literal:
    text: str


@dataclass(frozen=True)
class Condition:
    left: Attribute
    operator: str
    right: Attribute | Literal

    def __str__(self) -> str:
        right = f'"{self.right.text}"' if isinstance(self.right, Literal) else self.right
        return f"{self.left}{self.operator}{right}"


@dataclass(frozen=True)
class Query:
    """select is empty for `*`."""

    select: tuple[Attribute, ...]
    tables: tuple[str, ...]
    where: tuple[Condition, ...] = ()
    group_by: tuple[Attribute, ...] = ()
    order_by: tuple[Attribute, ...] = ()
    distinct: bool = False

    def __str__(self) -> str:
        """Text that parses to this tree."""
        names = lambda xs: ",".join(map(str, xs))
        text = f"SELECT {'DISTINCT ' * self.distinct}{names(self.select) or '*'} FROM {','.join(self.tables)}"
        for word, part in (("WHERE", self.where), ("GROUPBY", self.group_by), ("ORDERBY", self.order_by)):
            text += f" {word} {names(part)}" if part else ""
        return text
