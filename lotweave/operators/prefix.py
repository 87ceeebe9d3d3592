"""Running numbers, sums, maxima and previous values over groups of any size.

A plain window puts a whole group into one task. Here an order index is made first: rows are dealt
to range partitions by key, order and tie-break, cut where a sample of the rows says that the
partitions are equally large, so that a key with most of the rows is spread over most of the
partitions whatever its values are. The index is written, which fixes the cuts. Each partition
reports one carry value per key (few rows: keys plus partitions), a window over these gives what
comes before each part, and every (key, part) is finished on its own.

Rows that agree in key, order and tie-break follow each other by the hash of the whole row. Null keys
are a key of their own, a null order comes first, a null counts as 0 in a sum and is passed over by
a maximum. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotweave.session import cut_lineage


def order_index(df: DataFrame, keys: Sequence[str], order: str, tiebreak: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """``df`` with ``_part`` (rises along key, order and tie-break) and ``_tie``.

    ``parts`` defaults to the session's number of shuffle partitions.
    """
    count = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = [f.name for f in df.schema if "map<" not in f.dataType.simpleString()]  # maps have no hash
    tied = df.withColumn("_tie", F.xxhash64(*hashed))
    return cut_lineage(tied.repartitionByRange(count, *keys, order, *tiebreak, "_tie").withColumn("_part", F.spark_partition_id()))


def carried(index: DataFrame, keys: Sequence[str], order: str, tiebreak: Sequence[str], outs: Sequence[tuple[str, str, str]]) -> DataFrame:
    """The rows of an order index with every (kind, value, name) of ``outs``; kinds are sum, max and previous.

    All of them share one join and one sort.
    """
    at = [order, *tiebreak, "_tie"]
    of_part = {"sum": F.sum, "max": F.max, "previous": lambda v: F.max_by(v, F.struct(*at))}
    carry = [of_part[kind](value).alias(f"_c{i}") for i, (kind, value, _) in enumerate(outs)]
    parts = index.groupBy(*keys, "_part").agg(*carry)
    line = Window.partitionBy(*keys).orderBy("_part")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    of_line = {"sum": lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)), "max": lambda c: F.max(c).over(before), "previous": lambda c: F.lag(c).over(line)}
    base = parts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"),
                        *[of_line[kind](f"_c{i}").alias(f"_b{i}") for i, (kind, _, _) in enumerate(outs)])
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inner = Window.partitionBy(*keys, "_part").orderBy(*at)
    upto = inner.rowsBetween(Window.unboundedPreceding, 0)

    def finished(kind: str, value: str, b: Column) -> Column:
        if kind == "sum":
            return b + F.coalesce(F.sum(value).over(upto), F.lit(0))
        if kind == "max":
            return F.greatest(b, F.max(value).over(upto))
        return F.when(F.row_number().over(inner) == 1, b).otherwise(F.lag(value).over(inner))

    rows = [c for c in index.columns if c not in ("_part", "_tie")]
    return index.join(base, same).select(*rows, *[finished(kind, value, F.col(f"_b{i}")).alias(out) for i, (kind, value, out) in enumerate(outs)])


def running_sum(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str,
                tiebreak: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """Inclusive running sum of ``value`` per key in ``order``."""
    return carried(order_index(df, keys, order, tiebreak, parts), keys, order, tiebreak, [("sum", value, out)])


def running_number(df: DataFrame, keys: Sequence[str], order: str, out: str, tiebreak: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """1, 2, 3, ... per key in ``order``."""
    return running_sum(df.withColumn("_one", F.lit(1)), keys, order, "_one", out, tiebreak, parts).drop("_one")


def running_max(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str, tiebreak: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """Inclusive running maximum of ``value`` per key in ``order``."""
    return carried(order_index(df, keys, order, tiebreak, parts), keys, order, tiebreak, [("max", value, out)])


def previous_value(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str, tiebreak: Sequence[str] = (),
                   parts: int | None = None) -> DataFrame:
    """``value`` of the row before, per key in ``order``; null for the first."""
    return carried(order_index(df, keys, order, tiebreak, parts), keys, order, tiebreak, [("previous", value, out)])
