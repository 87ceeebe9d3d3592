"""Field access and value coercion shared by every rule."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _staged(name: str) -> str:
    """Column name of a parsed field; capitals are marked, since Spark compares names without case."""
    return "_num_" + re.sub("[A-Z]", lambda m: "^" + m.group(0).lower(), name)


class Fields:
    """Named access to the loose properties of a feature table.

    A typed column of that name is used when the table has one, else the entry of the
    ``props`` map. Names are compared case-sensitively, because ``APN`` and ``apn`` differ.
    """

    def __init__(self, df: DataFrame, props: str = "props", feature_id: str = "feature_id"):
        self._columns = set(df.columns)
        self._props = props if props in self._columns else None
        self._feature_id = feature_id

    def get(self, name: str) -> Column:
        if self._props:
            return F.col(self._props).getItem(name)
        if name in self._columns:
            return F.col(f"`{name}`").cast("string")
        return F.lit(None).cast("string")

    def has(self, name: str) -> Column:
        if self._props:
            return F.coalesce(F.map_contains_key(self._props, F.lit(name)), F.lit(False))
        return F.lit(name in self._columns)

    def num(self, name: str) -> Column:
        """The field as a finite double; a column staged by :func:`with_numbers` when there is one."""
        staged = _staged(name)
        return F.col(f"`{staged}`") if staged in self._columns else number(self.get(name))

    def feature_id(self) -> Column:
        if self._feature_id in self._columns:
            return F.col(self._feature_id).cast("string")
        return F.lit(None).cast("string")


def blank_to_null(value: Column) -> Column:
    trimmed = F.trim(value.cast("string"))
    return F.when(trimmed != "", trimmed)


NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d{1,3})?\s*$"


def number(value: Column) -> Column:
    """Finite double or null. The text pattern leaves out NaN and infinities in one step."""
    return F.trim(F.regexp_extract(value.cast("string"), NUMBER, 0)).try_cast("double")


def with_numbers(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Parse loose fields once, ahead of the rules that read them several times."""
    fields = Fields(df)
    return df.withColumns({_staged(n): number(fields.get(n)) for n in dict.fromkeys(names)})


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Null stays null; the bare functions would skip it."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def first_present(fields: Fields, names: Sequence[str]) -> Column:
    """First non-blank text of the named fields."""
    return F.coalesce(*[blank_to_null(fields.get(n)) for n in names])


def parcel_id(
    fields: Fields, order: Sequence[str], position: Column | None = None, with_feature_id: bool = True
) -> Column:
    """First non-blank id field, then the feature id, then ``parcel-{position}``."""
    options = [blank_to_null(fields.get(n)) for n in order]
    if with_feature_id:
        options.append(blank_to_null(fields.feature_id()))
    if position is not None:
        options.append(F.concat(F.lit("parcel-"), position.cast("string")))
    return F.coalesce(*options)


def truthy(value: Column, words: Sequence[str]) -> Column:
    """True for a listed word or a non-zero number; never null."""
    text = F.lower(F.trim(value.cast("string")))
    return F.coalesce(text.isin(*words), F.lit(False))


def numeric_truthy(value: Column, words: Sequence[str]) -> Column:
    """Like :func:`truthy`, for fields that may also hold numbers other than 0 and 1."""
    return truthy(value, words) | F.coalesce(value.try_cast("double") != 0, F.lit(False))


def tri_state(value: Column, true_words: Sequence[str], false_words: Sequence[str]) -> Column:
    text = F.lower(F.trim(value.cast("string")))
    return F.when(text.isin(*true_words), F.lit(True)).when(text.isin(*false_words), F.lit(False))


def contains_any(text: Column, words: Sequence[str]) -> Column:
    return text.rlike("|".join(re.escape(w) for w in words))


def when_in_order(cases: Sequence[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    """A ``CASE WHEN`` built from (condition, value) pairs; the first true condition wins."""
    expr = F.when(cases[0][0], cases[0][1])
    for condition, value in cases[1:]:
        expr = expr.when(condition, value)
    return expr if otherwise is None else expr.otherwise(otherwise)


def kept(*items: Column) -> Column:
    """Array of the non-null items, in order."""
    return F.array_compact(F.array(*items))


def thousands(value: Column) -> Column:
    return F.format_number(value.cast("bigint"), 0)


def pct0(value: Column) -> Column:
    """0.42 -> ``42`` as whole-percent text."""
    return F.round(value * 100, 0).cast("bigint").cast("string")


def fixed(value: Column, places: int) -> Column:
    return F.format_string(f"%.{places}f", value)


def collapse_first(df: DataFrame, keys: Sequence[str], order: str | Column, where: Column | None = None) -> DataFrame:
    """One row per key: the row with the smallest ``order``, of those that ``where`` holds for.

    A grouped ``min_by`` combines before the shuffle, so a key holding a large share of the
    rows still reaches the reducer as one row per map task. Each column has its own, all of one row, so
    that a column nobody reads is neither sorted nor shuffled. ``where`` is tested after the grouping:
    Spark moves a filter below the columns that it reads and computes them once more for it.
    """
    rest = [c for c in df.columns if c not in keys]
    first = F.col(order) if isinstance(order, str) else order
    if where is None:
        return df.groupBy(*keys).agg(*[F.min_by(c, first).alias(c) for c in rest]).select(*df.columns)
    marked = df.withColumn("_first", first).withColumn("_counts", where)
    of = F.when(F.col("_counts"), F.col("_first"))
    picked = marked.groupBy(*keys).agg(*[F.min_by(c, of).alias(c) for c in rest], F.bool_or("_counts").alias("_any"))
    return picked.filter("_any").select(*df.columns)
