"""Dense rows with stable surrogate handles. Which number a handle is carries no meaning."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from .relation import numbered


@dataclass(frozen=True)
class SlotMap:
    """df has the column `handle`. `scannable`: false for maps of resources, which are looked up only."""

    df: DataFrame
    handle: str = "handle"
    scannable: bool = True

    @staticmethod
    def of(rows: DataFrame, order: Sequence[str], handle: str = "handle", scannable: bool = True) -> SlotMap:
        """Handles 0, 1, 2 ... in the given total order."""
        return SlotMap(numbered(rows, order, handle), handle, scannable)

    def put(self, rows: DataFrame, order: Sequence[str]) -> SlotMap:
        """Handles above all in use. Freed ones are not used again, so a stale handle finds nothing."""
        from .relation import new_ids

        return replace(self, df=self.df.unionByName(new_ids(rows, self.df, self.handle, order)))

    def update(self, rows: DataFrame) -> SlotMap:
        """Replace the rows of the handles in `rows`."""
        kept = self.df.join(rows.select(self.handle), self.handle, "left_anti")
        known = rows.join(self.df.select(self.handle), self.handle, "left_semi")
        return replace(self, df=kept.unionByName(known))

    def erase(self, handles: DataFrame) -> SlotMap:
        return replace(self, df=self.df.join(handles.select(self.handle).distinct(), self.handle, "left_anti"))

    def scan(self) -> DataFrame:
        if not self.scannable:
            raise TypeError("resources are looked up by handle only")
        return self.df

    def lookup(self, refs: DataFrame, column: str) -> DataFrame:
        """`refs` with the row of each handle in `column`; rows with a null or freed handle go."""
        return refs.join(self.df.withColumnRenamed(self.handle, column), column)
