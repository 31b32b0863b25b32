"""Tables by name."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession

from ..errors import UnknownTable
from .files import exists, read_small
from .schema import parse_spec
from .statistics import TableStats, gathered, parse_stats
from .text import read_text


class Catalog(Mapping[str, DataFrame]):
    """DataFrames by table name. Names are told apart by case; nothing is read before a query needs it."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self._tables: dict[str, DataFrame] = {}
        self.stats: dict[str, TableStats] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._tables:
            raise UnknownTable(f"table {name} is not registered")
        return self._tables[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._tables)

    def __len__(self) -> int:
        return len(self._tables)

    def __contains__(self, name: object) -> bool:
        return name in self._tables

    def register(self, name: str, df: DataFrame) -> Catalog:
        self._tables[name] = df
        self.stats.pop(name, None)
        return self

    def parquet(self, folder: str, *names: str) -> Catalog:
        """folder/<name>.parquet of each name."""
        for name in names:
            self.register(name, self.spark.read.parquet(f"{folder}/{name}.parquet"))
        return self

    def text(self, folder: str, *names: str, separator: str | None = None) -> Catalog:
        """folder/<name>.txt by the description folder/<name>.det of each name, and statistics where there is a
        folder/<name>.stat. The folder can be anywhere Spark reads."""
        for name in names:
            schema = parse_spec(read_small(self.spark, f"{folder}/{name}.det")).struct
            self.register(name, read_text(self.spark, f"{folder}/{name}.txt", schema, separator))
            if exists(self.spark, f"{folder}/{name}.stat"):
                self.stats[name] = parse_stats(read_small(self.spark, f"{folder}/{name}.stat"), schema.names)
        return self

    def open(self, folder: str, *names: str) -> Catalog:
        """folder/<name>.parquet of each name where there is one, else its text table."""
        for name in names:
            (self.parquet if exists(self.spark, f"{folder}/{name}.parquet") else self.text)(folder, name)
        return self

    def analyze(self, *names: str, exact: bool = False) -> Catalog:
        """Gather statistics of tables by reading them, for the order of joins."""
        for name in names:
            self.stats[name] = gathered(self[name], exact)
        return self
