"""The engine: text or fluent queries over a catalog of tables."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from .errors import SyntaxQueryError
from .operators.relational import build, known_order
from .plans.analyzer import Analysis, analyze
from .plans.ast import Aggregate, Attribute, Column, Condition, Literal, Query
from .plans.parser import parse
from .sources.catalog import Catalog
from .sources.text import write_result, write_table

_ATTRIBUTE = re.compile(r"\s*(?:(MAX|MIN|SUM|COUNT|AVG)\s*\(\s*)?([A-Za-z_]\w*)\.([A-Za-z_]\w*)\s*(\))?\s*")


def attribute(text: str) -> Attribute:
    m = _ATTRIBUTE.fullmatch(text)
    if not m or bool(m[1]) != bool(m[4]):
        raise SyntaxQueryError(f"no attribute: {text!r}")
    column = Column(m[2], m[3])
    return Aggregate(m[1], column) if m[1] else column


class Engine:
    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame] | None = None) -> None:
        self.spark = spark
        self.catalog = tables if isinstance(tables, Catalog) else Catalog(spark)
        if self.catalog is not tables:
            for name, df in (tables or {}).items():
                self.catalog.register(name, df)

    def parse(self, text: str) -> Query:
        return parse(text)

    def analyze(self, query: str | Query) -> Analysis:
        query = parse(query) if isinstance(query, str) else query
        return analyze(query, {t: self.catalog[t].schema for t in query.tables if t in self.catalog})

    def dataframe(self, query: str | Query, method: str | None = None, watermark: tuple[str, str] | None = None) -> DataFrame:
        """The query's result. method: how tables are joined (nested, block_nested, hash or sort_merge); left to
        Spark by default. watermark: column and delay, for streaming tables that have that column."""
        done = self.analyze(query)
        tables = {t: self.catalog[t] for t in done.query.tables}
        if watermark:
            column, delay = watermark
            tables = {t: d.withWatermark(column, delay) if d.isStreaming and column in d.columns else d for t, d in tables.items()}
        return build(done, tables, method, self.catalog.stats)

    sql = dataframe

    def table(self, name: str) -> DataFrame:
        return self.catalog[name]

    def explain(self, query: str | Query, method: str | None = None) -> str:
        """The checked query, the order of its joins (x for products) and Spark's formatted plan."""
        df, done = self.dataframe(query, method), self.analyze(query)
        groups = known_order(done, {t: self.catalog[t] for t in done.query.tables}, self.catalog.stats)
        order = " x ".join(" ".join(g) for g in groups)
        mode = self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        return f"{done.query}\njoin order: {order}\n{df._jdf.queryExecution().explainString(mode)}"

    def run(self, query: str | Query, path: str, method: str | None = None) -> int:
        """Write the result as text; returns the number of rows."""
        titles = [str(x) for x in self.analyze(query).select]
        return write_result(self.dataframe(query, method), path, titles)

    def write(self, query: str | Query, path: str, method: str | None = None) -> None:
        """Write the result as a tab-separated text table; the executors write it, so it can be of any size."""
        write_table(self.dataframe(query, method), path)

    def from_(self, *tables: str) -> Fluent:
        return Fluent(self, Query((), tables))


class Fluent:
    """A query built step by step; every step gives a new one."""

    def __init__(self, engine: Engine, query: Query, method: str | None = None) -> None:
        self.engine, self.query, self.method = engine, query, method

    def _with(self, **parts: object) -> Fluent:
        return Fluent(self.engine, replace(self.query, **parts), self.method)

    def select(self, *names: str) -> Fluent:
        return self._with(select=tuple(map(attribute, names)))

    def distinct(self) -> Fluent:
        return self._with(distinct=True)

    def where(self, left: str, operator: str, value: object) -> Fluent:
        """Compare with a literal."""
        return self._with(where=(*self.query.where, Condition(attribute(left), operator, Literal(str(value)))))

    def on(self, left: str, operator: str, right: str) -> Fluent:
        """Compare with a column."""
        return self._with(where=(*self.query.where, Condition(attribute(left), operator, attribute(right))))

    def group_by(self, *names: str) -> Fluent:
        return self._with(group_by=tuple(map(attribute, names)))

    def order_by(self, *names: str) -> Fluent:
        return self._with(order_by=tuple(map(attribute, names)))

    def join_by(self, method: str) -> Fluent:
        return Fluent(self.engine, self.query, method)

    def dataframe(self) -> DataFrame:
        return self.engine.dataframe(self.query, self.method)
