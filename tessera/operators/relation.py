"""Keyed relations: a DataFrame with a name and a key, its scans and look-ups, and copy-on-write changes.

Nothing is changed in place: each change gives a new DataFrame, planned as one union, anti join or projection.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import hinted, staged

#: A key part: a column's name, or an expression over a row.
Key = str | Callable[[Callable[[str], Column]], Column]


def first_per_key(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row for each key, the smallest by all other columns. Aggregated before the shuffle, so hot keys are cheap."""
    rest = [c for c in df.columns if c not in key]
    if not rest:
        return df.dropDuplicates(list(key))
    best = df.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_first"))
    return best.select(*key, "_first.*").select(*df.columns)


def with_rn(df: DataFrame, key: Sequence[str], order: Sequence[str | Column] | None = None, name: str = "_rn") -> DataFrame:
    """`df` with the number of each row within its key, from 1, in the order of the given or all other columns."""
    order = order or [c for c in df.columns if c not in key] or list(key)
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order)))


def numbered(df: DataFrame, order: Sequence[str], name: str = "pos", start: int = 0) -> DataFrame:
    """`df` with a gapless position from `start` in the given total order, of columns of any type.

    Rows are dealt to as many ranges as the session has shuffle partitions, sorted in each, and staged with their place in
    it; the ranges' counts, a number for each, give the offsets. So no task sorts or counts the whole table.
    """
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    # The lower 33 bits count a partition's rows, the upper ones are its number.
    placed = staged(dealt.withColumn("_id", F.monotonically_increasing_id()), "numbered")
    counts = placed.groupBy(F.shiftright("_id", 33).alias("_range")).count().collect()
    before, rows = start, []
    for r in sorted(counts):
        rows.append((r["_range"], before))
        before += r["count"]
    offsets = F.broadcast(spark.createDataFrame(rows, "_range bigint, _before bigint"))  # a row for each range
    found = placed.withColumn("_range", F.shiftright("_id", 33)).join(offsets, "_range")
    place = F.col("_id").bitwiseAND((1 << 33) - 1)
    return found.select(*df.columns, (F.col("_before") + place).alias(name))


@dataclass(frozen=True)
class Relation:
    """`unique`: no two rows share the key, so joins need not number duplicates. `ordered`: merge joins are hinted."""

    df: DataFrame
    name: str
    key: tuple[Key, ...]
    unique: bool = True
    ordered: bool = True

    def __post_init__(self):
        missing = [k for k in self.key if isinstance(k, str) and k not in self.df.columns]
        if missing:
            raise ValueError(f"{self.name} has no key columns {missing}")

    # -- scans and look-ups

    def aliased(self, name: str) -> Relation:
        return replace(self, name=name)

    def keyed_by(self, *key: Key, unique: bool = True) -> Relation:
        return replace(self, key=key, unique=unique)

    def ordered_scan(self) -> DataFrame:
        return self.df.orderBy(*self.key_columns())

    def key_columns(self) -> list[Column]:
        return [F.col(k) if isinstance(k, str) else k(F.col) for k in self.key]

    def equal_range(self, *values) -> DataFrame:
        """All rows of a key; the predicate reaches the scan."""
        condition = F.lit(True)
        for k, v in zip(self.key_columns(), values, strict=True):
            condition &= k == F.lit(v)
        return self.df.where(condition)

    def find(self, *values) -> DataFrame:
        """At most one row of a key: the smallest by all columns, unless keys are unique anyway."""
        found = self.equal_range(*values)
        return found if self.unique else found.orderBy(*found.columns).limit(1)

    def assert_unique(self) -> Relation:
        if self.df.groupBy(*self.key_columns()).count().where("count > 1").take(1):
            raise ValueError(f"{self.name} has keys that repeat")
        return replace(self, unique=True)

    # -- changes

    def clear(self) -> Relation:
        """Without any row; the columns stay."""
        return replace(self, df=self.df.limit(0))

    def append(self, rows: DataFrame, check: bool = False) -> Relation:
        """Rows whose keys are at least the largest one; that is checked on demand."""
        if check:
            monotone(self.df, rows, self.key[0])
        return replace(self, df=self.df.unionByName(rows))

    def insert(self, rows: DataFrame) -> Relation:
        """Rows in any order, whether or not their keys are there."""
        return replace(self, df=self.df.unionByName(rows))

    def erase(self, keys: DataFrame) -> Relation:
        """One row for each requested key (a bag): all rows of it if keys are unique."""
        names = [k for k in self.key if isinstance(k, str)]
        if self.unique:
            return replace(self, df=self.df.join(keys.select(*names).distinct(), names, "left_anti"))
        mine = with_rn(self.df, names)
        asked = with_rn(keys.select(*names), names)
        return replace(self, df=mine.join(asked, [*names, "_rn"], "left_anti").drop("_rn").select(*self.df.columns))

    def erase_all(self, keys: DataFrame) -> tuple[Relation, DataFrame]:
        """Without any row of the keys, and a one-row frame with how many went."""
        names = [k for k in self.key if isinstance(k, str)]
        asked = keys.select(*names).distinct()
        return replace(self, df=self.df.join(asked, names, "left_anti")), self.df.join(asked, names, "left_semi").agg(F.count("*").alias("erased"))

    def upsert(self, rows: DataFrame, last: Sequence[str | Column] | None = None) -> Relation:
        """New rows replace old ones of their key. Of several new rows of a key the last by `last` wins."""
        names = [k for k in self.key if isinstance(k, str)]
        rest = [c for c in rows.columns if c not in names]
        order = F.struct(*(last or rest))
        new = rows.groupBy(*names).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*names, "_row.*")
        return replace(self, df=self.df.join(new, names, "left_anti").unionByName(new.select(*self.df.columns)))

    def update_from(self, rows: DataFrame) -> Relation:
        """Columns that both have take the value of the matching row of `rows`, even a null one; the rest stays."""
        names = [k for k in self.key if isinstance(k, str)]
        return replace(self, df=overwrite(self.df, rows, names, unique=True))

    def inserter(self) -> Deferred:
        return Deferred(self, lambda r, rows: r.insert(rows))

    def eraser(self) -> Deferred:
        return Deferred(self, lambda r, rows: r.erase(rows))


class Deferred:
    """Collects frames and applies them as one change when the block ends; the outcome is in `result`."""

    def __init__(self, relation: Relation, apply: Callable[[Relation, DataFrame], Relation]):
        self.result, self._apply, self._parts = relation, apply, []

    def __enter__(self) -> Deferred:
        return self

    def add(self, rows: DataFrame) -> None:
        self._parts.append(rows)

    def __exit__(self, kind, *_) -> None:
        if kind is None and self._parts:
            rows = self._parts[0]
            for more in self._parts[1:]:
                rows = rows.unionByName(more)
            self.result = self._apply(self.result, rows)


def overwrite(left: DataFrame, right: DataFrame, key: Sequence[str], unique: bool, hint: str | None = None) -> DataFrame:
    """Every left row once; on a match the columns that both have are the right's, nulls included."""
    shared = [c for c in right.columns if c in left.columns and c not in key]
    source = right.select(*key, *shared) if unique else first_per_key(right.select(*key, *shared), key)
    source = source.select(*key, F.struct(F.lit(True).alias("_hit"), *shared).alias("_new"))
    if hint:
        source = hinted(left, source, hint)
    joined = left.join(source, list(key), "left")
    hit = F.col("_new").isNotNull()
    return joined.select(*(F.when(hit, F.col("_new")[c]).otherwise(F.col(c)).alias(c) if c in shared else F.col(c) for c in left.columns))


def monotone(old: DataFrame, new: DataFrame, key: str) -> None:
    """Raise unless `new` is a continuation of the sorted log `old`."""
    top, low = old.agg(F.max(key)).first()[0], new.agg(F.min(key)).first()[0]
    if top is not None and low is not None and low < top:
        raise ValueError(f"{key} {low} comes before {top}")


def insert_at(df: DataFrame, pos: int, rows: DataFrame, name: str = "pos") -> DataFrame:
    """Rows, which have positions from 0, go before position `pos`; later rows move up."""
    n = rows.count()
    moved = df.withColumn(name, F.when(F.col(name) >= pos, F.col(name) + n).otherwise(F.col(name)))
    return moved.unionByName(rows.withColumn(name, F.col(name) + pos))


def erase_at(df: DataFrame, first: int, last: int, name: str = "pos") -> DataFrame:
    """Without positions first to last - 1; later rows move down."""
    kept = df.where((F.col(name) < first) | (F.col(name) >= last))
    return kept.withColumn(name, F.when(F.col(name) >= last, F.col(name) - (last - first)).otherwise(F.col(name)))


def new_ids(df: DataFrame, existing: DataFrame, key: str, order: Sequence[str], limit: int = 2**32 - 1) -> DataFrame:
    """`df` with fresh consecutive ids above the largest one in use; an overflow raises."""
    top = existing.agg(F.max(key)).first()[0]
    start = 0 if top is None else top + 1
    if start + df.count() - 1 > limit:
        raise OverflowError(f"{key} would exceed {limit}")
    return numbered(df, order, key, start)


def assign(row: DataFrame, other: dict[str, Column]) -> DataFrame:
    """Columns of `row` that `other` names take its values; names that `row` lacks are left out."""
    return row.withColumns({c: v for c, v in other.items() if c in row.columns})
