"""Running a chain or graph of layers over vectors, and fitting bucket boundaries: loops on the driver over bounded tables.

A layer is a rule over an array column, so a whole chain is one projection; the driver only orders the layers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.operators import tensors as X


class Graph:
    """Layers by name with their inputs."""

    def __init__(self):
        self.rules: dict[str, Callable[..., Column]] = {}
        self.inputs: dict[str, list[str]] = {}

    def add(self, name: str, rule: Callable[..., Column], inputs: list[str] = ()) -> Graph:
        """A layer; without inputs it reads the graph's input column."""
        if name in self.rules:
            raise ValueError(f"layer {name} is there already")
        self.rules[name], self.inputs[name] = rule, list(inputs)
        return self

    def order(self) -> list[str]:
        """Layers after all of their inputs; ready ones by name. A cycle or an unknown input is an error."""
        unknown = {i for xs in self.inputs.values() for i in xs} - set(self.rules)
        if unknown:
            raise KeyError(f"no such layer: {', '.join(sorted(unknown))}")
        out: list[str] = []
        left = {n: set(xs) for n, xs in self.inputs.items()}
        while left:
            ready = sorted(n for n, xs in left.items() if not xs)
            if not ready:
                raise ValueError(f"layers in a cycle: {', '.join(sorted(left))}")
            out.append(ready[0])
            del left[ready[0]]
            for xs in left.values():
                xs.discard(ready[0])
        return out

    def predecessors(self, name: str) -> list[str]:
        return self.inputs[name]

    def run(self, df: DataFrame, column: str, output: str | None = None) -> DataFrame:
        """Adds `output` (the last layer by default) to df. Each layer's result is a column of its own until the end, so a
        layer that two others read is computed once a row."""
        names = self.order()
        if not names:
            return df
        wanted = output or names[-1]
        at = df
        for n in names:
            read = [F.col(f"_layer_{i}") for i in self.inputs[n]] or [F.col(column)]
            at = at.withColumn(f"_layer_{n}", self.rules[n](*read))
        return at.select(*df.columns, F.col(f"_layer_{wanted}").alias(wanted))


def elementwise(name: str) -> Callable[[Column], Column]:
    """A layer that applies an activation to each entry; unknown names pass values through."""
    return lambda x: F.transform(x, lambda v: X.activation(name, v))


def fit_boundaries(values: DataFrame, column: str, low: float = -1000.0, high: float = 1000.0, buckets: int = 100, rounds: int = 1000, tolerance: float = 0.01, rate: float = 0.01, fade: float = 0.995) -> list[float]:
    """Bucket boundaries moved toward the middles of their neighbours' means until they settle.

    Values are counted once into cells a hundredth of a bucket wide (count and sum); the rounds work on that bounded table.
    """
    width = (high - low) / (buckets * 100)
    v = F.col(column)
    inside = values.filter(v.isNotNull() & ~F.isnan(v))
    cell = F.least(F.lit(buckets * 100 - 1), F.greatest(F.lit(0), F.floor((v - low) / width)))
    counted = sorted((int(r["c"]), int(r["n"]), float(r["s"])) for r in inside.groupBy(cell.alias("c")).agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("s")).collect())
    edges = [low + (high - low) * i / buckets for i in range(buckets + 1)]
    for _ in range(rounds):
        n, s, at = [0] * buckets, [0.0] * buckets, 0
        for c, k, total in counted:
            middle = low + width * (c + 0.5)
            while at < buckets - 1 and middle > edges[at + 1]:
                at += 1
            n[at] += k
            s[at] += total
        moved = 0.0
        for i in range(1, buckets):
            if n[i - 1] and n[i]:
                step = rate * ((s[i - 1] / n[i - 1] + s[i] / n[i]) / 2 - edges[i])
                edges[i] += step
                moved = max(moved, abs(step))
        edges.sort()
        rate *= fade
        if moved < tolerance:
            break
    return edges
