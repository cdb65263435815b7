"""Hierarchical dictionary codes of tiles: pursuit, decoding, fused products, and fitting.

A tile is approximated in stages; stage l adds `gamma[l]` times a few signed atoms. Codes are (tile, stage, slot, atom,
sign). Atoms are a bounded table (a few hundred rows), tiles are not.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (atoms, stages, active atoms of a stage, rounds) for feed-forward tensors and for others.
ROLE_CONFIG = {"mlp": (512, 3, 8, 12), "other": (256, 3, 5, 8)}


def tile_of(row: Column, col: Column, tile_rows: int, tile_cols: int, cols: int) -> Column:
    """Number of the tile that holds an entry, row by row; null for entries outside the grid of full tiles."""
    across = cols // tile_cols
    inside = F.floor(col / tile_cols) < across
    return F.when(inside, F.floor(row / tile_rows) * across + F.floor(col / tile_cols))


def pack_code(atom: Column, sign: Column) -> Column:
    """Atom and sign in 16 bits; the top bit stands for minus."""
    return atom.bitwiseOR(F.when(sign < 0, 1 << 15).otherwise(0))


def unpack_code(code: Column) -> Column:
    return F.struct(code.bitwiseAND((1 << 15) - 1).alias("atom"), F.when(code.bitwiseAND(1 << 15) != 0, -1).otherwise(1).alias("sign"))


def gammas(stages: int, decay: float = 0.5) -> list[float]:
    return [decay**s for s in range(stages)]


def pursue(tiles: np.ndarray, atoms: np.ndarray, scales: list[float], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes (tile, stage, slot) of rows of `tiles`: atoms and signs. Each slot takes the atom with the largest product with
    what is left, an atom once a stage, the lowest number on ties."""
    left = tiles.astype(np.float64).copy()
    n = len(tiles)
    chosen, signs = np.zeros((n, len(scales), k), dtype=np.int32), np.zeros((n, len(scales), k), dtype=np.int8)
    rows = np.arange(n)
    for stage, gamma in enumerate(scales):
        used = np.zeros((n, len(atoms)), dtype=bool)
        for slot in range(k):
            product = left @ atoms.T
            size = np.where(used, -1.0, np.abs(product))
            best = size.argmax(axis=1)
            sign = np.where(product[rows, best] < 0, -1, 1)
            chosen[:, stage, slot], signs[:, stage, slot] = best, sign
            used[rows, best] = True
            left -= gamma * sign[:, None] * atoms[best]
    return chosen, signs


def encode(tiles: DataFrame, atoms: np.ndarray, scales: list[float], k: int) -> DataFrame:
    """(tile, stage, slot, atom, sign) of a table (tile, x). Atoms travel with the task; a batch of tiles is coded at a time."""
    bound = np.ascontiguousarray(atoms, dtype=np.float64)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            chosen, signs = pursue(x, bound, scales, k)
            n, s, c = chosen.shape
            stage, slot = np.meshgrid(np.arange(s), np.arange(c), indexing="ij")
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids, s * c)), pa.array(np.tile(stage.ravel(), n).astype(np.int32)), pa.array(np.tile(slot.ravel(), n).astype(np.int32)), pa.array(chosen.ravel()), pa.array(signs.ravel().astype(np.int32))],
                names=["tile", "stage", "slot", "atom", "sign"],
            )

    return tiles.select("tile", "x").mapInArrow(run, "tile long, stage int, slot int, atom int, sign int")


def decode(codes: DataFrame, atoms: DataFrame, scales: list[float]) -> DataFrame:
    """(tile, i, v): the sum of the signed, scaled atoms. atoms: (atom, i, w), a bounded table."""
    gamma = F.get(F.array(*map(F.lit, scales)), F.col("stage"))
    weight = codes.groupBy("tile", "atom").agg(F.sum(gamma * F.col("sign")).alias("g"))
    return weight.join(F.broadcast(atoms), "atom").groupBy("tile", "i").agg(F.sum(F.col("g") * F.col("w")).alias("v"))


def fused_product(codes: DataFrame, atoms: DataFrame, x: DataFrame, scales: list[float]) -> DataFrame:
    """(tile, y): codes times x without decoding: each atom's product with x is computed once and summed over the codes.
    x: (i, h)."""
    gamma = F.get(F.array(*map(F.lit, scales)), F.col("stage"))
    dx = atoms.join(F.broadcast(x), "i").groupBy("atom").agg(F.sum(F.col("w") * F.col("h")).alias("dx"))
    return codes.join(F.broadcast(dx), "atom").groupBy("tile").agg(F.sum(gamma * F.col("sign") * F.col("dx")).alias("y"))


def fit(tiles: DataFrame, n_atoms: int, scales: list[float], k: int, rounds: int, sample: int = 20_000) -> np.ndarray:
    """Atoms fitted to a bounded sample of tiles, taken in hash order; everything else codes all tiles."""
    rows = tiles.select("tile", "x").orderBy(F.xxhash64("tile"), "tile").limit(sample).collect()
    return fit_rows(np.array([r["x"] for r in rows], dtype=np.float64), n_atoms, scales, k, rounds)


def fit_rows(x: np.ndarray, n_atoms: int, scales: list[float], k: int, rounds: int) -> np.ndarray:
    """Atoms fitted to rows of tiles.

    Atoms start as tiles of unit norm scaled to the mean norm; each round moves an atom by half of the mean signed
    remainder of the tiles that use it, caps its norm at one and a half of the start norm, and gives atoms that no tile
    uses the tile with the largest remainder.
    """
    if not len(x):
        return np.zeros((0, 0))
    x = np.nan_to_num(x, nan=0.0, posinf=0.0, neginf=0.0)
    norms = np.linalg.norm(x, axis=1)
    start = norms.mean() / np.sqrt(k * len(scales))
    seeds = x[np.arange(n_atoms) % len(x)] + 1e-6 * np.cos(np.arange(n_atoms)[:, None] + np.arange(x.shape[1])[None, :])
    atoms = start * seeds / np.maximum(np.linalg.norm(seeds, axis=1, keepdims=True), 1e-12)
    gamma = np.array(scales)
    for _ in range(rounds):
        chosen, signs = pursue(x, atoms, scales, k)
        weight = gamma[None, :, None] * signs
        left = x - np.einsum("nsk,nskd->nd", weight, atoms[chosen])
        flat, g = chosen.reshape(len(x), -1), weight.reshape(len(x), -1)
        moved, mass = np.zeros_like(atoms), np.zeros(len(atoms))
        for slot in range(flat.shape[1]):
            np.add.at(moved, flat[:, slot], g[:, slot, None] * left)
            np.add.at(mass, flat[:, slot], g[:, slot] ** 2)
        atoms = atoms + 0.5 * moved / np.maximum(mass, 1e-12)[:, None]
        size = np.linalg.norm(atoms, axis=1, keepdims=True)
        atoms *= np.minimum(1.0, 1.5 * start / np.maximum(size, 1e-12))
        dead = np.flatnonzero(mass == 0)
        worst = np.argsort(-np.linalg.norm(left, axis=1))[: len(dead)]
        fresh = left[worst]
        atoms[dead[: len(worst)]] = start * fresh / np.maximum(np.linalg.norm(fresh, axis=1, keepdims=True), 1e-12)
    return atoms


def real_codes(tiles: np.ndarray, atoms: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthogonal matching pursuit: k atoms of each tile with real coefficients, fitted again after each atom; all tiles at once."""
    n, rows = len(tiles), np.arange(len(tiles))
    if not 0 < k <= len(atoms):
        raise ValueError(f"{k} of {len(atoms)} atoms")
    chosen, coefficients, left = np.zeros((n, k), dtype=np.int32), np.zeros((n, 0)), tiles.astype(float)
    free = np.ones((n, len(atoms)), dtype=bool)
    for j in range(k):
        best = np.where(free, np.abs(left @ atoms.T), -1).argmax(axis=1)
        chosen[:, j], free[rows, best] = best, False
        taken = atoms[chosen[:, : j + 1]]
        gram = taken @ taken.transpose(0, 2, 1)
        coefficients = np.einsum("nij,nj->ni", np.linalg.pinv(gram, hermitian=True), np.einsum("njd,nd->nj", taken, tiles))
        left = tiles - np.einsum("nj,njd->nd", coefficients, taken)
    return chosen, coefficients


def binary_codes(tiles: np.ndarray, atoms: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Atoms and signs of the real codes, magnitudes dropped."""
    chosen, c = real_codes(tiles, atoms, k)
    return chosen, np.sign(c)


def hybrid_codes(tiles: np.ndarray, atoms: np.ndarray, k: int) -> np.ndarray:
    """Reconstruction by binary codes and half as many real ones of what they leave."""
    chosen, sign = binary_codes(tiles, atoms, k)
    first = np.einsum("nk,nkd->nd", sign, atoms[chosen])
    rest, c = real_codes(tiles - first, atoms, max(1, k // 2))
    return first + np.einsum("nk,nkd->nd", c, atoms[rest])


def code_errors(tiles: DataFrame, atoms: np.ndarray, k: int, part: int = 1_024) -> DataFrame:
    """(tile, real, binary, hybrid): the remainder's share of a tile's energy under each code of k atoms, from tiles (tile, x).

    Tiles are coded where they are, `part` at a time; the dictionary, a bounded parameter, goes to each task. A tile of zeros
    has the errors' energy over 1e-12, as everywhere in this module.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, part):
                some = batch.slice(at, part)
                x = np.array(some.column(1).to_pylist(), dtype=float)
                found = []
                for chosen, c in (real_codes(x, atoms, k), binary_codes(x, atoms, k)):
                    found.append(np.einsum("nk,nkd->nd", c, atoms[chosen]))
                energy = np.maximum((x**2).sum(axis=1), 1e-12)
                shares = [pa.array(((x - y) ** 2).sum(axis=1) / energy) for y in (*found, hybrid_codes(x, atoms, k))]
                yield pa.RecordBatch.from_arrays([some.column(0), *shares], names=["tile", "real", "binary", "hybrid"])

    return tiles.select("tile", "x").mapInArrow(run, f"tile {dict(tiles.dtypes)['tile']}, real double, binary double, hybrid double")


def walsh(n: int) -> np.ndarray:
    """The n orthonormal Walsh vectors of length n, a power of two."""
    i = np.arange(n)
    return (1.0 - 2.0 * (np.bitwise_count(i[:, None] & i[None, :]) % 2)) / np.sqrt(n)


def fit_groups(tiles: DataFrame, by: str, n_atoms: int, scales: list[float], k: int, rounds: int, sample: int = 2_000) -> DataFrame:
    """(by, atom, x): one dictionary for each group, fitted to at most `sample` of its tiles in hash order.

    Only the sample's rows are dealt by group, so a group of any size costs a task the same.
    """
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy(by).orderBy(F.xxhash64("tile"), "tile"))
    # Rows beyond the sample are dropped on each side of the shuffle by the group limit that Catalyst infers from this filter.
    bounded = tiles.select(by, "tile", "x").withColumn("_r", place).filter(F.col("_r") <= sample).drop("_r")

    def run(pdf):
        import pandas as pd

        atoms = fit_rows(np.stack(pdf["x"].to_numpy()), n_atoms, scales, k, rounds)
        return pd.DataFrame({by: [pdf[by].iloc[0]] * len(atoms), "atom": range(len(atoms)), "x": list(atoms)})

    return bounded.groupBy(by).applyInPandas(run, f"{by} {dict(tiles.dtypes)[by]}, atom int, x array<double>")


def group_errors(tiles: DataFrame, by: str, atoms: DataFrame, scales: list[float], k: int, part: int = 50_000) -> DataFrame:
    """(by, n, nmse): tiles of each group and the mean squared remainder of their codes over the mean square of their entries.

    A group's tiles are dealt into parts by hash, so that no task holds more than about `part` of them; its atoms, a
    bounded table, go to each part.
    """
    parts = max(1, -(-tiles.count() // part))
    dealt = tiles.select(by, "x", F.pmod(F.xxhash64("tile"), F.lit(parts)).alias("_part"))
    copies = atoms.select(by, "atom", "x", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("_part"))

    def run(left, right):
        import pandas as pd

        if not len(left):
            return pd.DataFrame({by: [], "n": [], "e": [], "t": []})
        x, a = np.stack(left["x"].to_numpy()), np.stack(right.sort_values("atom")["x"].to_numpy())
        chosen, signs = pursue(x, a, scales, k)
        rest = x - np.einsum("nsk,nskd->nd", np.array(scales)[None, :, None] * signs, a[chosen])
        return pd.DataFrame({by: left[by].iloc[:1], "n": [len(x)], "e": [float((rest**2).sum())], "t": [float((x**2).sum())]})

    sums = dealt.groupBy(by, "_part").cogroup(copies.groupBy(by, "_part")).applyInPandas(run, f"{by} {dict(tiles.dtypes)[by]}, n long, e double, t double")
    return sums.groupBy(by).agg(F.sum("n").alias("n"), (F.sum("e") / F.greatest(F.sum("t"), F.lit(1e-12))).alias("nmse"))
