"""Boosted trees over a few categorical features, fitted on counts per feature pattern.

The rows of any table are first counted per (pattern, fold, label); the number of patterns is the
product of the features' sizes, so what reaches the driver does not grow with the table. The fitted
trees go back into the plan as CASE expressions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Leaf:
    value: float


@dataclass(frozen=True)
class Split:
    """``yes`` where ``feature`` equals ``value``, else ``no``."""

    feature: int
    value: int
    yes: Leaf | Split
    no: Leaf | Split


@dataclass(frozen=True)
class Model:
    features: tuple[str, ...]
    base: float
    trees: tuple[Leaf | Split, ...]
    threshold: float

    def score(self) -> Column:
        """The summed score as an expression over the columns named in ``features``."""
        return self.score_of([F.col(f) for f in self.features])

    def score_of(self, values: Sequence[Column]) -> Column:
        def walk(node):
            if isinstance(node, Leaf):
                return F.lit(node.value)
            return F.when(values[node.feature] == node.value, walk(node.yes)).otherwise(walk(node.no))
        out = F.lit(self.base)
        for tree in self.trees:
            out = out + walk(tree)
        return out

    def score_one(self, pattern: Sequence[int]) -> float:
        out = self.base
        for tree in self.trees:
            while isinstance(tree, Split):
                tree = tree.yes if pattern[tree.feature] == tree.value else tree.no
            out += tree.value
        return out


def _leaf(rows, rate: float, ridge: float) -> Leaf:
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    return Leaf(rate * g / (h + ridge))


def _grow(rows, depth: int, rate: float, ridge: float):
    """``rows``: (pattern, gradient, curvature). Best equality split by gain, ties by order."""
    total_g, total_h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    best = None
    if depth and rows:
        for f in range(len(rows[0][0])):
            sums: dict[int, list[float]] = {}
            for p, g, h in rows:
                s = sums.setdefault(p[f], [0.0, 0.0])
                s[0] += g
                s[1] += h
            for v in sorted(sums):
                if len(sums) < 2:
                    continue
                g, h = sums[v]
                gain = (g * g / (h + ridge) + (total_g - g) ** 2 / (total_h - h + ridge)
                        - total_g ** 2 / (total_h + ridge))
                if gain > 1e-9 and (best is None or gain > best[0] + 1e-12):
                    best = (gain, f, v)
    if best is None:
        return _leaf(rows, rate, ridge)
    _, f, v = best
    return Split(f, v, _grow([r for r in rows if r[0][f] == v], depth - 1, rate, ridge),
                 _grow([r for r in rows if r[0][f] != v], depth - 1, rate, ridge))


def fit(features: Sequence[str], patterns: Sequence[tuple[tuple[int, ...], bool, float, float]],
        rounds: int = 20, depth: int = 3, rate: float = 0.3, ridge: float = 1.0,
        precision: float = 0.95) -> Model | None:
    """``patterns``: (pattern, held out, rows, positive rows). None without both kinds of rows.

    The threshold is calibrated on the held-out rows: scores are made into a rising curve of
    precision (pooled neighbours), and the lowest score whose pooled precision reaches
    ``precision`` is taken; infinite when there is none.
    """
    fitted = sorted((p, n, k) for p, out, n, k in patterns if not out)
    n, k = sum(x[1] for x in fitted), sum(x[2] for x in fitted)
    if not 0 < k < n:
        return None
    base = math.log(k / (n - k))
    scores, trees = {p: base for p, _, _ in fitted}, []
    for _ in range(rounds):
        rows = []
        for p, n, k in fitted:
            q = 1 / (1 + math.exp(-scores[p]))
            rows.append((p, k - n * q, n * q * (1 - q)))
        trees.append(_grow(rows, depth, rate, ridge))
        step = Model(tuple(features), 0.0, (trees[-1],), 0.0)
        for p in scores:
            scores[p] += step.score_one(p)
    model = Model(tuple(features), base, tuple(trees), math.inf)
    held = sorted((model.score_one(p), n, k) for p, out, n, k in patterns if out)
    pools: list[list[float]] = []  # lowest score, rows, positive rows
    for s, n, k in held:
        pools.append([s, n, k])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            top = pools.pop()
            pools[-1][1] += top[1]
            pools[-1][2] += top[2]
    return Model(model.features, base, model.trees, min(
        (s for s, n, k in pools if k >= precision * n), default=math.inf) - 1e-9)
