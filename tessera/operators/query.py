"""Index joins over named relations, with exact rules for keys that repeat.

A result row holds one struct for each relation, null where an outer join found nothing. With m left and n right rows
of a key: merge inner gives min(m, n) rows (rows are paired by their place), merge outer m (each with the first right
row), merge anti max(m - n, 0); find inner gives m if n > 0, find outer m, find anti m if n = 0. "First" is the smallest
by all columns. A null key matches nothing; anti joins keep it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relation import Key, Relation
from .staging import hinted


@dataclass(frozen=True)
class Query:
    """df: one struct column for each name. scope: the relation whose key the next join uses."""

    df: DataFrame
    names: tuple[str, ...]
    scope: str
    key: tuple[Key, ...]
    unique: bool
    ordered: bool = True

    # -- keys

    def key_columns(self) -> list[Column]:
        row = F.col(self.scope)
        return [row[k] if isinstance(k, str) else k(lambda c: row[c]) for k in self.key]

    def on(self, name: str, *key: Key, unique: bool = False) -> Query:
        """Later joins read the key from another relation of the bundle."""
        if name not in self.names:
            raise ValueError(f"no relation {name}")
        return replace(self, scope=name, key=key or self.key, unique=unique)

    def index(self, *key: Key, unique: bool = False) -> Query:
        """Later joins use another key, which may be an expression, of the same relation."""
        return replace(self, key=key, unique=unique)

    # -- joins

    def join(self, right: Query | Relation) -> Join:
        return Join(self, from_(right), "inner")

    def outer_join(self, right: Query | Relation) -> Join:
        return Join(self, from_(right), "left")

    def anti_join(self, right: Query | Relation) -> Join:
        return Join(self, from_(right), "left_anti")

    # -- results

    def sorted(self) -> Query:
        """Rows in the order of the key in scope; without it their order is free."""
        return replace(self, df=self.df.orderBy(*self.key_columns()))

    def select(self, **columns: tuple[str, str]) -> DataFrame:
        """A flat frame: each name is taken from (relation, column)."""
        return self.df.select(*(F.col(r)[c].alias(n) for n, (r, c) in columns.items()))

    def present(self, name: str) -> Column:
        return F.col(name).isNotNull()

    def where(self, condition: Callable[[Callable[[str], Column]], Column]) -> Query:
        return replace(self, df=self.df.where(condition(F.col)))


def from_(source: Query | Relation) -> Query:
    if isinstance(source, Query):
        return source
    df = source.df.select(F.struct(*source.df.columns).alias(source.name))
    return Query(df, (source.name,), source.name, source.key, source.unique, source.ordered)


@dataclass(frozen=True)
class Join:
    left: Query
    right: Query
    kind: str

    def merge(self) -> Query:
        """Both sides are walked in the order of the key; a side that can be broadcast need not be."""
        if self.kind == "left":
            return self._lookup("merge")
        keys, left, right = self._keyed()
        if not (self.left.unique and self.right.unique):
            number = lambda df, names: df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*names)))
            left, right = number(left, self.left.names), number(right, self.right.names)
            keys = [*keys, "_rn"]
        if self.kind == "left_anti":
            right = right.select(*keys)
        joined = left.join(hinted(left, right, "merge"), keys, self.kind)
        if self.kind == "inner":
            out = self.right  # an inner merge continues with the right's key
            return self._done(joined, out.scope, out.key, self.left.unique or self.right.unique)
        return self._done(joined, self.left.scope, self.left.key, self.left.unique)

    def find(self) -> Query:
        """The right's index is probed once for each left row. The planner broadcasts it where its size allows."""
        if self.kind == "left_anti":
            keys, left, right = self._keyed()
            return self._done(left.join(right.select(*keys), keys, "left_anti"), self.left.scope, self.left.key, self.left.unique)
        return self._lookup(None)

    def _lookup(self, hint: str | None) -> Query:
        keys, left, right = self._keyed()
        if not self.right.unique:
            best = F.min(F.struct(*self.right.names)).alias("_first")
            right = right.groupBy(*keys).agg(best).select(*keys, "_first.*")
        if hint:
            right = hinted(left, right, hint)
        return self._done(left.join(right, keys, self.kind), self.left.scope, self.left.key, self.left.unique)

    def _keyed(self) -> tuple[list[str], DataFrame, DataFrame]:
        clash = set(self.left.names) & set(self.right.names)
        if clash and self.kind != "left_anti":
            raise ValueError(f"alias one of the relations named {sorted(clash)}")
        keys = [f"_k{i}" for i in range(len(self.left.key))]
        if len(keys) != len(self.right.key):
            raise ValueError("keys have different numbers of parts")
        add = lambda q: q.df.withColumns(dict(zip(keys, q.key_columns(), strict=True)))
        return keys, add(self.left), add(self.right)

    def _done(self, df: DataFrame, scope: str, key: tuple[Key, ...], unique: bool) -> Query:
        names = self.left.names if self.kind == "left_anti" else (*self.left.names, *self.right.names)
        return Query(df.select(*names), names, scope, key, unique, self.left.ordered)
