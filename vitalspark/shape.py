"""Small helpers on the shape of a DataFrame."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_columns_once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add costly columns so that each is worked out once per row.

    A filter on an ordinary column is pushed beneath it with the expression copied into
    the filter; it stops at a generator, which here always yields one row.
    """
    one = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.array(one)))
