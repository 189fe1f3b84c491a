"""Entities made of components: one frame for each component, all keyed by the entity's id."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from .query import Query, from_
from .relation import Relation, new_ids


@dataclass(frozen=True)
class Universe:
    """`components`: frames that have the column `id`, at most one row for each id."""

    components: Mapping[str, DataFrame]
    id: str

    def component(self, name: str) -> Relation:
        return Relation(self.components[name], name, (self.id,))

    def require(self, *names: str) -> EntityQuery:
        """Entities that have all the components."""
        query = from_(self.component(names[0]))
        for n in names[1:]:
            query = query.join(self.component(n)).merge()
        return EntityQuery(self, query)

    def require_all(self) -> EntityQuery:
        return self.require(*self.components)

    def include(self, *names: str) -> Include:
        return Include(self, names)

    def exclude(self, *names: str) -> Exclude:
        return Exclude(self, names)

    def erase(self, ids: DataFrame) -> Universe:
        """Without these entities in any component."""
        gone = ids.select(self.id).distinct()
        return replace(self, components={n: df.join(gone, self.id, "left_anti") for n, df in self.components.items()})

    def new_ids(self, rows: DataFrame, order: list[str]) -> DataFrame:
        """`rows` with ids that no component uses."""
        used = None
        for df in self.components.values():
            mine = df.select(self.id)
            used = mine if used is None else used.unionByName(mine)
        return new_ids(rows, used, self.id, order)


@dataclass(frozen=True)
class Include:
    """Adds optional components to a query; an absent one is a null struct."""

    universe: Universe
    names: tuple[str, ...]

    def in_(self, query: Query) -> Query:
        for n in reversed(self.names):
            query = query.outer_join(self.universe.component(n)).merge()
        return query


@dataclass(frozen=True)
class Exclude:
    """Drops entities that have any of the components."""

    universe: Universe
    names: tuple[str, ...]

    def in_(self, query: Query) -> Query:
        for n in self.names:
            query = query.anti_join(self.universe.component(n)).merge()
        return query


@dataclass(frozen=True)
class EntityQuery:
    universe: Universe
    query: Query

    def include(self, *names: str) -> EntityQuery:
        return replace(self, query=self.universe.include(*names).in_(self.query))

    def exclude(self, *names: str) -> EntityQuery:
        return replace(self, query=self.universe.exclude(*names).in_(self.query))

    def select(self, **columns: tuple[str, str]) -> DataFrame:
        return self.query.select(**columns)

    @property
    def df(self) -> DataFrame:
        return self.query.df
