"""Greedy generation over an embedding table: each step pools the ids so far and takes the best-scoring row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.operators import tensors as X


def next_token(rows: DataFrame, hidden: list[float], used: list[int], temperature: float = 0.8, penalty: float = 1.5) -> int | None:
    """The id of the best row (id, x) for a hidden vector; scores of used ids are divided (or multiplied, below zero) by the
    penalty; the lowest id on ties. One partial aggregate."""
    h = F.array(*(F.lit(float(v)) for v in hidden))
    s = X.finite_dot(F.col("x"), h) / temperature
    s = F.when(F.col("id").isin(used), F.when(s > 0, s / penalty).otherwise(s * penalty)).otherwise(s) if used else s
    best = rows.agg(F.max(F.struct(F.round(s, 9).alias("s"), (-F.col("id")).alias("n"))).alias("b")).first()["b"]
    return None if best is None else -best["n"]


def generate(rows: DataFrame, prompt: list[int], steps: int, end: int | None = None) -> list[int]:
    """Ids that follow a prompt. A step reads the rows of the ids so far (a filter on id) and scores all rows once; the
    loop holds ids and one vector on the driver."""
    ids = list(prompt)
    for _ in range(steps):
        wanted = rows.filter(F.col("id").isin(sorted(set(ids)))).select("id", "x").collect()
        by_id = {r["id"]: r["x"] for r in wanted}
        known = [by_id[i] for i in ids if i in by_id]
        if not known:
            break
        token = next_token(rows, [sum(c) / len(known) for c in zip(*known)], sorted(set(ids)))
        if token is None:
            break
        ids.append(token)
        if token == end:
            break
    return ids[len(prompt) :]
