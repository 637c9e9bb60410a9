"""How a query is registered: a function of bound tables, and SQL over the same."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .bindings import bind, duck

Tables = Callable[[str], DataFrame]


@dataclass(frozen=True)
class Entry:
    build: Callable[[Tables], DataFrame]
    sql: str | None = None

    def query(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(lambda name: bind(spark, sf_dir, name))

    @property
    def oracle(self) -> str | None:
        return duck(self.sql) if self.sql else None
