"""Top N items within every group by one global range-partitioned sort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.operators.scan import ranged_positions


def top_n(df: DataFrame, group: list[str], score: str, tie: list[str], n: int, copies: list[str] | None = None) -> DataFrame:
    """The ``n`` rows of every group with the highest ``score``, equal scores by ``tie`` ascending
    (nulls last), with their exact ``position``.

    Rows whose score is null or NaN take no part; infinite and sentinel scores count as they are, and
    -0.0 equals 0.0.  A null in a group column is a group of its own.  Rows equal in all of ``copies``
    (they must include the group, score and tie columns) count once; without it repeated rows stay.
    A group may hold any share of all rows: it is cut over partitions by (group, score, tie)."""
    usable = df.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score))).withColumn(score, F.col(score) + F.lit(0.0))
    order = [F.col(score).desc(), *(F.col(c).asc_nulls_last() for c in tie)]
    return ranged_positions(usable, group, order, keep=n, copies=copies, label="topn")
