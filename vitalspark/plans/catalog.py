"""Named queries over the model's tables, each with its column contract and check SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalspark.sources.domain import DomainTables, duckdb_with

# kind -> (Spark expression, DuckDB expression); both sides give the same plain types
KINDS: dict[str, tuple[Callable[[Column], Column], str]] = {
    "n": (lambda c: c.cast("bigint"), "cast({c} as bigint)"),
    "f": (lambda c: c.cast("double"), "cast({c} as double)"),
    "s": (lambda c: c.cast("string"), "cast({c} as varchar)"),
    "d": (lambda c: c.cast("date").cast("string"), "cast(cast({c} as date) as varchar)"),
    "t": (
        lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"),
        "strftime({c}, '%Y-%m-%d %H:%M:%S.%f')",
    ),
    "b": (lambda c: c.cast("boolean"), "cast({c} as boolean)"),
}


@dataclass(frozen=True)
class Query:
    columns: tuple[tuple[str, str], ...]
    run: Callable[[DomainTables], DataFrame]
    tables: tuple[str, ...]
    sql: str | None

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        df = self.run(DomainTables(spark, sf_dir))
        return df.select(*[KINDS[k][0](F.col(c)).alias(c) for c, k in self.columns])

    def check_sql(self) -> str | None:
        if self.sql is None:
            return None
        shown = ", ".join(f"{KINDS[k][1].format(c=c)} as {c}" for c, k in self.columns)
        return f"{duckdb_with(self.tables)}\nselect {shown} from (\n{self.sql.strip()}\n)"


CATALOG: dict[str, Query] = {}


def query(name: str, columns: str, tables: str = "", sql: str | None = None):
    """Register a query: ``columns`` as ``name:kind`` words, ``tables`` as words."""
    spec = tuple(tuple(c.split(":")) for c in columns.split())

    def register(run: Callable[[DomainTables], DataFrame]):
        if name in CATALOG:
            raise ValueError(f"{name} is registered twice")
        CATALOG[name] = Query(spec, run, tuple(tables.split()), sql)
        return run

    return register


def load_all() -> dict[str, Query]:
    from vitalspark.plans import (  # noqa: F401
        account_queries,
        change_queries,
        equipment_queries,
        health_queries,
        intake_queries,
        strength_queries,
        stream_queries,
        submission_queries,
    )

    return CATALOG
