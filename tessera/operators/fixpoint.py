"""Closures and parsing: what needs repetition."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import staged


def transitive_closure(edges: DataFrame) -> DataFrame:
    """a, b for each path of at least one edge, in distinct rows.

    Paths double in each round, so rounds grow with the logarithm of the longest; it ends when a round adds nothing.
    """
    paths = edges.select("a", "b").where("a is not null and b is not null").distinct()
    n = paths.count()
    while True:
        longer = paths.alias("x").join(paths.alias("y"), F.col("x.b") == F.col("y.a")).select("x.a", "y.b")
        paths = staged(paths.unionByName(longer).distinct(), "paths")
        now = paths.count()
        if now == n:
            return paths
        n = now


class Grammar:
    """Rules (head, body, cost); bodies of any length. A symbol without rules is a terminal.

    Long bodies are cut into pairs with shared suffix symbols. `nullable` symbols derive the empty string at a cost;
    unit rules, and pairs of which one part is empty, are closed over when a chart cell is filled.
    """

    def __init__(self, rules: list[tuple[str, tuple[str, ...], float]]):
        self.units: dict[str, list[tuple[str, float]]] = defaultdict(list)
        self.pairs: dict[tuple[str, str], list[tuple[str, float]]] = defaultdict(list)
        self.nullable: dict[str, float] = {}
        for head, body, cost in rules:
            while len(body) > 2:
                rest = "<" + " ".join(body[1:]) + ">"
                self._add(head, (body[0], rest), cost)
                head, body, cost = rest, body[1:], 0.0
            self._add(head, body, cost)
        changed = True
        while changed:
            changed = False
            for (x, y), heads in self.pairs.items():
                if x in self.nullable and y in self.nullable:
                    for h, c in heads:
                        changed |= self._less(self.nullable, h, c + self.nullable[x] + self.nullable[y])
            for x, heads in self.units.items():
                if x in self.nullable:
                    for h, c in heads:
                        changed |= self._less(self.nullable, h, c + self.nullable[x])
        for (x, y), heads in list(self.pairs.items()):
            for h, c in heads:
                if y in self.nullable:
                    self.units[x].append((h, c + self.nullable[y]))
                if x in self.nullable:
                    self.units[y].append((h, c + self.nullable[x]))

    def _add(self, head: str, body: tuple[str, ...], cost: float) -> None:
        if not body:
            self._less(self.nullable, head, cost)
        elif len(body) == 1:
            if (head, cost) not in self.units[body[0]]:
                self.units[body[0]].append((head, cost))
        elif (head, cost) not in self.pairs[body]:
            self.pairs[body].append((head, cost))

    @staticmethod
    def _less(costs: dict[str, float], symbol: str, cost: float) -> bool:
        if cost < costs.get(symbol, float("inf")):
            costs[symbol] = cost
            return True
        return False

    def parse(self, tokens: list[dict[str, float]], start: str) -> tuple[float, str] | None:
        """Cost and bracketed tree of the cheapest derivation of `start`; of equal costs the first found stays.

        `tokens` gives for each place the symbols it may be, with costs.
        """
        n = len(tokens)
        if not n:
            return (self.nullable[start], f"({start})") if start in self.nullable else None
        cells: list[list[dict]] = [[{} for _ in range(n + 1)] for _ in range(n)]

        def close(cell: dict) -> None:
            work = list(cell)
            while work:
                x = work.pop(0)
                for h, c in self.units.get(x, ()):
                    if c + cell[x][0] < cell.get(h, (float("inf"),))[0]:
                        cell[h] = (c + cell[x][0], None, x, None)
                        work.append(h)

        for i, symbols in enumerate(tokens):
            cells[i][i + 1] = {s: (c, None, None, None) for s, c in symbols.items()}
            close(cells[i][i + 1])
        for width in range(2, n + 1):
            for i in range(n - width + 1):
                cell: dict = {}
                for m in range(i + 1, i + width):
                    for x, left in cells[i][m].items():
                        for y, right in cells[m][i + width].items():
                            for h, c in self.pairs.get((x, y), ()):
                                cost = c + left[0] + right[0]
                                if cost < cell.get(h, (float("inf"),))[0]:
                                    cell[h] = (cost, m, x, y)
                close(cell)
                cells[i][i + width] = cell

        def tree(i: int, j: int, s: str) -> list[str]:
            _, m, x, y = cells[i][j][s]
            inner = [] if x is None else tree(i, j, x) if m is None else tree(i, m, x) + tree(m, j, y)
            return inner if s.startswith("<") else ["(" + " ".join([s, *inner]) + ")"]

        found = cells[0][n].get(start)
        return None if found is None else (found[0], tree(0, n, start)[0])


def parse_sentences(sentences: DataFrame, grammar: Grammar, lexicon: dict[str, dict[str, float]], start: str, *keys: str, text: str = "text") -> DataFrame:
    """keys (by default id), cost, tree of each sentence; both null where it has no parse. Words outside the lexicon have no symbol."""
    keys = keys or ("id",)
    kinds = ", ".join(f"{k} {sentences.schema[k].dataType.simpleString()}" for k in keys)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [grammar.parse([lexicon.get(w, {}) for w in (t or "").split()], start) for t in part[text]]
            yield pd.DataFrame({**{k: part[k] for k in keys}, "cost": pd.Series([None if f is None else f[0] for f in found], dtype="float64"), "tree": [None if f is None else f[1] for f in found]})

    return sentences.select(*keys, text).mapInPandas(run, f"{kinds}, cost double, tree string")
