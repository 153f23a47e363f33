"""Accepted and rejected rows, and constraint checks."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalspark.schemas import RULES, TableRules
from vitalspark.skew import join_optional


#: Tasks of a uniqueness check, as a multiple of the configured shuffle partitions.
KEY_TASKS = 16


class Split(NamedTuple):
    """Outcome of a load or change: rows taken and rows set aside with a reason."""

    accepted: DataFrame
    rejected: DataFrame

    @staticmethod
    def by_reason(tagged: DataFrame) -> "Split":
        """Split on the ``reason`` column; accepted rows lose it."""
        return Split(
            tagged.filter(F.col("reason").isNull()).drop("reason"),
            tagged.filter(F.col("reason").isNotNull()),
        )


def row_rules(rules: TableRules, columns: list[str]) -> list[Column]:
    """One nullable text per rule that can be judged from the row alone."""
    have = set(columns)
    found = [
        F.when(F.col(c).isNull(), F.lit(f"{c} is null")) for c in rules.not_null if c in have
    ]
    found += [
        F.when(~F.col(c).isin(*allowed), F.lit(f"{c} not in list"))
        for c, allowed in rules.one_of.items() if c in have
    ]
    found += [
        F.when(F.char_length(c) > n, F.lit(f"{c} longer than {n}"))
        for c, n in rules.max_length.items() if c in have
    ]
    found += [
        F.when(F.abs(F.round(F.col(c), s)) >= 10 ** (p - s), F.lit(f"{c} out of range"))
        for c, (p, s) in rules.decimal_range.items() if c in have
    ]
    return found


def validate_constraints(
    t: Mapping[str, DataFrame], table: str, rules: TableRules | None = None
) -> DataFrame:
    """Violations of one table: (rule, row_key, row_count).

    Row rules take one pass. Uniqueness is a count per key; keys are nearly all different, so they
    are dealt over many small tasks that Spark does not merge again, away from the task that made
    the table's rows. A key with a null part never conflicts. A missing parent is a
    left join against the distinct parent keys. Rules on absent columns or parent tables are skipped.
    """
    rules = rules or RULES[table]
    df = t[table]
    have = set(df.columns)
    key = F.col(rules.key).cast("string") if rules.key in have else F.lit(None).cast("string")
    tasks = KEY_TASKS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = []
    checks = row_rules(rules, df.columns)
    if checks:
        parts.append(
            df.select(key.alias("row_key"), F.array_compact(F.array(*checks)).alias("_broken"))
            .select(F.explode("_broken").alias("rule"), "row_key")
            .withColumn("row_count", F.lit(1).cast("bigint"))
        )
    unique = [(cols, None) for cols in rules.unique] + list(rules.unique_where)
    for columns, where in unique:
        if not set(columns) <= have:
            continue
        subset = df.filter(where) if where else df
        subset = subset.dropna(subset=list(columns))
        parts.append(
            subset.select(*columns).repartition(tasks, *columns)
            .groupBy(*columns)
            .agg(F.count(F.lit(1)).alias("row_count"))
            .filter(F.col("row_count") > 1)
            .select(
                F.lit(f"({', '.join(columns)}) not unique").alias("rule"),
                F.concat_ws("|", *[F.col(c).cast("string") for c in columns]).alias("row_key"),
                "row_count",
            )
        )
    for column, (parent, parent_key) in rules.foreign.items():
        if column not in have or parent not in t:
            continue
        known = t[parent].select(F.col(parent_key).alias("_parent")).distinct()
        # count orphans per value first: a hot value is one row in the join
        used = df.dropna(subset=[column]).groupBy(column).agg(F.count(F.lit(1)).alias("row_count"))
        parts.append(
            used.join(known, used[column] == known["_parent"], "left_anti").select(
                F.lit(f"{column} has no {parent}").alias("rule"),
                F.col(column).cast("string").alias("row_key"),
                "row_count",
            )
        )
    return reduce(DataFrame.unionByName, parts).select("rule", "row_key", "row_count")


def quarantine(t: Mapping[str, DataFrame], table: str, rules: TableRules | None = None) -> Split:
    """Rows that satisfy row rules and foreign keys, and the others with their reasons."""
    rules = rules or RULES[table]
    df = t[table]
    reasons = row_rules(rules, df.columns)
    tagged = df
    marks = []
    for i, (column, (parent, parent_key)) in enumerate(rules.foreign.items()):
        if column not in df.columns or parent not in t:
            continue
        known = t[parent].select(F.col(parent_key).alias("_parent")).distinct()
        known = known.withColumn(f"_known{i}", F.lit(True))
        tagged = join_optional(tagged, known, column, "_parent", df.columns)
        reasons.append(
            F.when(
                F.col(column).isNotNull() & F.col(f"_known{i}").isNull(),
                F.lit(f"{column} has no {parent}"),
            )
        )
        marks.append(f"_known{i}")
    why = F.concat_ws("; ", *reasons) if reasons else F.lit("")
    tagged = tagged.withColumn("reason", F.nullif(why, F.lit(""))).drop(*marks)
    return Split.by_reason(tagged)
