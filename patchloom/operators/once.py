"""Work that depends on some columns only is done once for each of their distinct values, of which there may be far fewer than rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import record


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt evenly over all tasks: few rows may be much work, and would otherwise be put into few tasks for their size."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def distinct(rows: DataFrame, *columns: str) -> DataFrame:
    """The distinct values of the columns, with `n`, the number of rows that have them."""
    return spread(rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")))


def held(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with these columns, each worked out once for a row: a generator, unlike a projection, isn't merged into what uses it, be that a filter or a lambda."""
    return rows.select("*", F.inline(F.array(record(**columns))))


def digest(*columns: str) -> Column:
    """A key of the columns' values, null apart from empty, for joins in which texts shouldn't move."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)
