"""DataFrames of checked queries: scan, filter, join, group, distinct, order, project."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions.aggregates import aggregate
from ..functions.literals import compare, literal
from ..plans.analyzer import Analysis
from ..plans.ast import Aggregate, Column, Condition, Literal
from ..plans.ordering import Estimate, components, estimate, order
from ..sources.statistics import TableStats, plan_bytes, planned

#: Join methods by the names that plans are asked for, as Spark's hints.
METHODS = {"nested": "shuffle_replicate_nl", "block_nested": "broadcast", "hash": "shuffle_hash", "sort_merge": "merge"}
#: Estimated bytes of a side up to which it is broadcast on demand, and of both sides of a join up to which each part
#: of one meets each part of the other; beyond them the method is Spark's choice.
BROADCAST_BYTES, NESTED_BYTES = 64 << 20, 16 << 20
#: Rows of a join's result that one task makes, by estimate, and most tasks that a join's input is dealt to for that.
#: Estimates from compressed files can be of far fewer rows than there are: a repeated table's by a hundred and more.
SPREAD_ROWS, SPREAD_TASKS = 100_000, 1000


def inner_name(c: Column) -> str:
    """The name under which a table's column goes through a plan; no two columns share it."""
    return f"{c.table}__{c.name}"


def scan(table: DataFrame, name: str) -> DataFrame:
    return table.select(*[table[f"`{c}`"].alias(inner_name(Column(name, c))) for c in table.columns])


def predicate(df: DataFrame, cond: Condition) -> SparkColumn:
    left = F.col(f"`{inner_name(cond.left)}`")
    if isinstance(cond.right, Literal):
        return compare(left, cond.operator, literal(cond.right.text, df.schema[inner_name(cond.left)].dataType))
    return compare(left, cond.operator, F.col(f"`{inner_name(cond.right)}`"))


def filtered(df: DataFrame, conditions: list[Condition]) -> DataFrame:
    for cond in conditions:
        df = df.filter(predicate(df, cond))
    return df


def hinted(left: DataFrame, right: DataFrame, method: str | None) -> DataFrame:
    """right with the hint of a method, where the sides' size allows it."""
    if method == "block_nested" and plan_bytes(right) > BROADCAST_BYTES:
        return right
    if method == "nested" and max(plan_bytes(left), plan_bytes(right)) > NESTED_BYTES:
        return right
    return right.hint(METHODS[method]) if method else right


def spread(left: DataFrame, right: DataFrame, rows: float, right_rows: float, made: float) -> tuple[DataFrame, DataFrame]:
    """The sides of a join that makes many rows of few, by estimate: the one of fewer rows is broadcast where its size
    allows it, the other dealt evenly to tasks, as few files or few keys would leave the result to few of them."""
    tasks = min(SPREAD_TASKS, int(made / SPREAD_ROWS))
    few, many = (left, right) if rows < right_rows else (right, left)
    width = sum(f.dataType.jsonValue() == "string" and 20 or 8 for f in few.schema)
    if tasks < 2 or made < 10 * max(rows, right_rows) or left.isStreaming or right.isStreaming:
        return left, right
    if min(rows, right_rows) * width > BROADCAST_BYTES:
        return left, right
    few, many = few.hint("broadcast"), many.repartition(tasks)
    return (few, many) if rows < right_rows else (many, few)


def join_order(done: Analysis, stats: Mapping[str, TableStats]) -> list[list[str]]:
    """The tables of FROM by what conditions tie together, each group in the order that its joins take; the group of
    the fewest estimated rows first, as groups are multiplied."""
    guess = estimate(stats, done.filters, done.joins)
    groups = [order(g, guess) for g in components(done.query.tables, done.joins)]
    return sorted(groups, key=lambda g: guess.joined(frozenset(g)))


def join_all(parts: Mapping[str, DataFrame], joins: list[Condition], groups: list[list[str]], method: str | None = None, guess: Estimate | None = None) -> DataFrame:
    """Tables joined in the order of their group; all conditions between them are one join's. Groups are multiplied
    last, and the product's sides are planned as Spark finds them small or not. guess: tells the joins whose sides are
    dealt out, see spread()."""
    if method is not None and method not in METHODS:
        raise QueryError(f"no join method {method}; there are {', '.join(METHODS)}")
    made = []
    for first, *rest in groups:
        out, have = parts[first], {first}
        for name in rest:
            use = [c for c in joins if name in (c.left.table, c.right.table) and {c.left.table, c.right.table} <= have | {name}]
            on = reduce(lambda a, b: a & b, [predicate(out, c) for c in use])
            right = hinted(out, parts[name], method)
            if guess and not method and any(c.operator == "=" for c in use):
                out, right = spread(out, right, guess.joined(frozenset(have)), guess.rows[name], guess.joined(frozenset(have | {name})))
            out = out.join(right, on, "inner")
            have.add(name)
        made.append(out)
    return reduce(lambda a, b: a.crossJoin(b), made)


def known_order(done: Analysis, tables: Mapping[str, DataFrame], stats: Mapping[str, TableStats] | None = None) -> list[list[str]]:
    if len(done.query.tables) == 1:
        return [list(done.query.tables)]
    return join_order(done, {t: (stats or {}).get(t) or planned(tables[t]) for t in done.query.tables})


def output_names(select: tuple) -> list[str]:
    """Flat names: the column's own where no other output has it, else with its table; aggregates as max_c."""
    plain = [f"{x.function.lower()}_{x.of.name}" if isinstance(x, Aggregate) else x.name for x in select]
    many = Counter(plain)
    full = []
    for x, name in zip(select, plain, strict=True):
        if many[name] > 1:
            c = x.of if isinstance(x, Aggregate) else x
            name = f"{x.function.lower()}_{c.table}_{c.name}" if isinstance(x, Aggregate) else f"{c.table}_{c.name}"
        full.append(name)
    used: Counter[str] = Counter()
    out = []
    for name in full:
        used[name] += 1
        out.append(name if used[name] == 1 else f"{name}_{used[name]}")
    return out


def build(done: Analysis, tables: Mapping[str, DataFrame], method: str | None = None, stats: Mapping[str, TableStats] | None = None) -> DataFrame:
    """stats: of the tables that have any; the others' are taken from their plans."""
    q = done.query
    parts = {t: filtered(scan(tables[t], t), done.filters.get(t, [])) for t in q.tables}
    groups, guess = known_order(done, tables, stats), None
    if len(q.tables) > 1:
        guess = estimate({t: (stats or {}).get(t) or planned(tables[t]) for t in q.tables}, done.filters, done.joins)
    df = join_all(parts, done.joins, groups, method, guess)
    col = lambda x: F.col(f"`{x}`" if isinstance(x, Aggregate) else f"`{inner_name(x)}`")
    aggregates = list(dict.fromkeys(x for x in done.select if isinstance(x, Aggregate)))
    if aggregates:
        made = [aggregate(x.function, F.col(f"`{inner_name(x.of)}`")).alias(str(x)) for x in aggregates]
        df = df.groupBy(*[col(k) for k in dict.fromkeys(q.group_by)]).agg(*made)
    elif q.group_by:
        df = df.select(*[col(k) for k in dict.fromkeys(q.group_by)]).distinct()
    if q.distinct:
        df = df.select(*[col(x) for x in dict.fromkeys(done.select)]).distinct()
    if q.order_by:
        df = df.orderBy(*[col(x).asc() for x in q.order_by])
    return df.select(*[col(x).alias(n) for x, n in zip(done.select, output_names(done.select), strict=True)])
