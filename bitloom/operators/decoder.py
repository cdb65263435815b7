"""Decoder blocks over token sequences: norm, attention with rotary positions and shared key heads, gated feed-forward.

A sequence is a group of rows of bounded length (a context window), so one task holds one at a time; weights are
parameters and travel with the task. `prefill` reads a whole sequence, `step` one more token with the keys and values
kept from before; both give the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame


@dataclass
class Block:
    """Weights of one block: norms are vectors, projections are (outputs, inputs)."""

    attn_norm: np.ndarray
    q: np.ndarray
    k: np.ndarray
    v: np.ndarray
    out: np.ndarray
    ffn_norm: np.ndarray
    gate: np.ndarray
    up: np.ndarray
    down: np.ndarray
    head_dim: int


def rms_norm(x: np.ndarray, weight: np.ndarray, eps: float = 1e-5) -> np.ndarray:
    return x / np.sqrt((x * x).mean(axis=-1, keepdims=True) + eps) * weight


def rope(x: np.ndarray, first: int, theta: float = 1_000_000.0) -> np.ndarray:
    """Rotates the pairs of each head of x (tokens, heads, head_dim); the first token stands at position `first`."""
    size = x.shape[-1]
    angle = (first + np.arange(len(x)))[:, None, None] * theta ** (-np.arange(0, size, 2) / size)
    out = np.empty_like(x)
    even, odd = x[..., 0::2], x[..., 1::2]
    out[..., 0::2] = even * np.cos(angle) - odd * np.sin(angle)
    out[..., 1::2] = even * np.sin(angle) + odd * np.cos(angle)
    return out


def attend(q: np.ndarray, k: np.ndarray, v: np.ndarray, first: int, tile: int = 256) -> np.ndarray:
    """Causal attention of queries (tokens from position `first`, heads, size) to all keys, in tiles of keys with a running
    maximum and sum, so that no more than a tile of scores is held for each query. Heads share keys where these are fewer."""
    share = q.shape[1] // k.shape[1]
    k, v = np.repeat(k, share, axis=1), np.repeat(v, share, axis=1)
    at = first + np.arange(len(q))
    most, norm, out = np.full(q.shape[:2], -np.inf), np.zeros(q.shape[:2]), np.zeros(q.shape)
    for low in range(0, len(k), tile):
        score = np.einsum("qhd,khd->qhk", q, k[low : low + tile]) / np.sqrt(q.shape[-1])
        score = np.where((low + np.arange(score.shape[-1]))[None, None, :] <= at[:, None, None], score, -np.inf)
        higher = np.maximum(most, score.max(axis=-1))
        fade, weight = np.exp(most - higher), np.exp(score - higher[..., None])
        norm = norm * fade + weight.sum(axis=-1)
        out = out * fade[..., None] + np.einsum("qhk,khd->qhd", weight, v[low : low + tile])
        most = higher
    return out / norm[..., None]


def forward(x: np.ndarray, block: Block, cache: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """The block's rows for tokens x (tokens, width), and the keys and values of all tokens so far."""
    first = 0 if cache is None else len(cache[0])
    heads = lambda w, n: (n @ w.T).reshape(len(n), -1, block.head_dim)
    normed = rms_norm(x, block.attn_norm)
    q, k, v = rope(heads(block.q, normed), first), rope(heads(block.k, normed), first), heads(block.v, normed)
    if cache is not None:
        k, v = np.concatenate([cache[0], k]), np.concatenate([cache[1], v])
    x = x + attend(q, k, v, first).reshape(len(x), -1) @ block.out.T
    normed = rms_norm(x, block.ffn_norm)
    gate = normed @ block.gate.T
    return x + (gate / (1 + np.exp(-gate)) * (normed @ block.up.T)) @ block.down.T, (k, v)


def prefill(x: np.ndarray, blocks: list[Block]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """A sequence through all blocks, and what later steps need of it."""
    caches = []
    for block in blocks:
        x, cache = forward(x, block)
        caches.append(cache)
    return x, caches


def step(x: np.ndarray, blocks: list[Block], caches: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Further tokens through all blocks with the caches of those before."""
    grown = []
    for block, cache in zip(blocks, caches, strict=True):
        x, cache = forward(x, block, cache)
        grown.append(cache)
    return x, grown


def run(rows: DataFrame, group: str, order: str, blocks: list[Block]) -> DataFrame:
    """(group, order, out): the rows `x` of each sequence through all blocks, in the order of a column."""
    types = dict(rows.dtypes)

    def one(pdf):
        pdf = pdf.sort_values(order)
        out, _ = prefill(np.stack(pdf["x"].to_numpy()).astype(float), blocks)
        return pdf[[group, order]].assign(out=list(out))

    return rows.select(group, order, "x").groupBy(group).applyInPandas(one, f"{group} {types[group]}, {order} {types[order]}, out array<double>")
