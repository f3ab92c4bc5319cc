"""A number for each row of a global order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.operators.tables import cut

_PART, _PLACE, _TIE = "_part", "_place", "_tie"


def with_sequence(rows: DataFrame, by: list[Column], name: str = "seq", first: int = 0) -> DataFrame:
    """``rows`` with a column ``name``: their numbers in the order of ``by``, from ``first`` on, without gaps.

    Rows are dealt to ranges of the key and sorted within them; a row's number
    is its place in its range and the sizes of the ranges before, of which
    there are as many as shuffle partitions.  Rows that are equal in ``by`` have
    neighbouring numbers in any order, and may fill several ranges.  Written to
    the checkpoint folder, so that the ranges are the same for both steps.
    """
    keys = [*by, F.col(_TIE)]
    ranged = rows.withColumn(_TIE, F.rand(0)).repartitionByRange(*keys).sortWithinPartitions(*keys).drop(_TIE)
    # a row's place within its partition is what is left of the id that Spark counts up in it
    placed = cut(ranged.withColumns({_PART: F.spark_partition_id(), _PLACE: F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    sizes = sorted((r[0], r[1]) for r in placed.groupBy(_PART).count().collect())  # one row for each range
    starts = [first] * (sizes[-1][0] + 1 if sizes else 1)
    for (part, n), (after, _) in zip(sizes, sizes[1:]):
        starts[after] = starts[part] + n
    offset = F.get(F.array(*[F.lit(x).cast("long") for x in starts]), F.col(_PART))
    return placed.withColumn(name, offset + F.col(_PLACE)).drop(_PART, _PLACE)
