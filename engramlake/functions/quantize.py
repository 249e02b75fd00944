"""Vector quantisation and stochastic steps that have no column form.

The rotation, codebook and projection are seeded and small; batches go through
Arrow.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rotation(dims: int, seed: int = 42) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def codebook(bits: int, dims: int, rounds: int = 60) -> np.ndarray:
    """Lloyd-Max centroids of N(0, 1 / sqrt(dims)) for 2**bits levels."""
    n, sigma = 1 << bits, 1 / math.sqrt(dims)
    pdf = lambda x: np.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    cdf = np.vectorize(lambda x: 0.5 * (1 + math.erf(x / math.sqrt(2))))
    c = np.linspace(-3, 3, n)
    for _ in range(rounds):
        edges = np.concatenate([[-40.0], (c[1:] + c[:-1]) / 2, [40.0]])
        mass = np.maximum(cdf(edges[1:]) - cdf(edges[:-1]), 1e-12)
        c = (pdf(edges[:-1]) - pdf(edges[1:])) / mass
    return c * sigma


def encode(x: np.ndarray, bits: int, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(radii, codes) of the rows of x: rotated directions by nearest centroid."""
    radius = np.linalg.norm(x, axis=1)
    unit = x / np.maximum(radius, 1e-12)[:, None]
    c = codebook(bits, x.shape[1])
    return radius, np.searchsorted((c[1:] + c[:-1]) / 2, unit @ turn.T).astype(np.uint8)


def decode(radius: np.ndarray, codes: np.ndarray, bits: int, turn: np.ndarray) -> np.ndarray:
    return (codebook(bits, codes.shape[1])[codes] * radius[:, None]) @ turn


def pack(codes: np.ndarray, bits: int) -> list[bytes]:
    """Rows of codes as packed bytes."""
    spread = np.unpackbits(codes[:, :, None], axis=2)[:, :, 8 - bits :]
    return [row.tobytes() for row in np.packbits(spread.reshape(len(codes), -1), axis=1)]


def unpack(rows: list[bytes], bits: int, dims: int) -> np.ndarray:
    flat = np.unpackbits(np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(len(rows), -1), axis=1)[:, : dims * bits].reshape(len(rows), dims, bits)
    return (flat * (1 << np.arange(bits - 1, -1, -1))).sum(axis=2).astype(np.uint8)


def sign_sketch(x: np.ndarray, width: int = 128, seed: int = 7) -> np.ndarray:
    """Signs of random projections of the rows (booleans)."""
    return x @ np.random.default_rng(seed).normal(size=(x.shape[1], width)) >= 0


def sketch_dot(q: np.ndarray, signs: np.ndarray, norms: np.ndarray, seed: int = 7) -> np.ndarray:
    """Estimates q . x from sign sketches: sqrt(pi / 2) |x| mean((R q) sign(R x))."""
    rq = q @ np.random.default_rng(seed).normal(size=(q.shape[-1], signs.shape[1]))
    return math.sqrt(math.pi / 2) * norms * (rq @ (2 * signs - 1).T) / signs.shape[1]


def quantise(df: DataFrame, bits: int, key: str = "fact_id", vector: str = "v") -> DataFrame:
    """(key, radius, codes, error): packed codes and the relative squared error."""

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            x = np.stack(b[vector].to_numpy()).astype(float)
            turn = rotation(x.shape[1])
            radius, codes = encode(x, bits, turn)
            error = ((decode(radius, codes, bits, turn) - x) ** 2).sum(axis=1) / np.maximum(radius**2, 1e-24)
            yield pd.DataFrame({key: b[key], "radius": radius, "codes": pack(codes, bits), "error": error})

    return df.select(key, vector).mapInPandas(run, f"{key} long, radius double, codes binary, error double")


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose outputs look independent of their inputs' order."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gaussian_noise(keys: np.ndarray, step: int, dims: int, seed: int = 0) -> np.ndarray:
    """Standard normal numbers (keys, dims) that depend on seed, key, step and dimension alone, by the Box-Muller rule."""
    with np.errstate(over="ignore"):
        row = _mixed(keys.astype(np.int64).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(2 * seed + 1))
        place = np.uint64((step + 1) << 20) + np.arange(2 * dims, dtype=np.uint64)
        bits = _mixed(row[:, None] + _mixed(place)[None, :])
    u = ((bits >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
    return np.sqrt(-2 * np.log(u[:, :dims])) * np.cos(2 * math.pi * u[:, dims:])


def langevin_steps(x: np.ndarray, keys: np.ndarray, accesses: np.ndarray, age: np.ndarray, importance: np.ndarray, temperature: float, step: float, rounds: int, first: int = 0, seed: int = 0) -> np.ndarray:
    """Euler-Maruyama steps of rows of positions in the unit ball, kept within MOST_RADIUS.

    Pulled inwards by 2 (3 + .08 ln(1 + accesses) - .005 min(age, 365) / 365 + .5
    importance), outwards by forgetting, a tenth over max(.5, .3 ln(1 + accesses) + .4
    importance); noise and its correction go with the ball's metric.
    """
    pull = (2 * (3 + 0.08 * np.log1p(accesses) - 0.005 * np.minimum(age, 365) / 365 + 0.5 * importance))[:, None]
    forget = (0.1 / np.maximum(0.5, 0.3 * np.log1p(accesses) + 0.4 * importance))[:, None]
    dims = x.shape[1]
    for k in range(first, first + rounds):
        square = np.minimum((x * x).sum(axis=1, keepdims=True), MOST_RADIUS**2)
        metric = (1 - square) / 2
        length = np.sqrt((x * x).sum(axis=1, keepdims=True))
        out = np.divide(x, length, out=np.zeros_like(x), where=length > 1e-12)
        x = x + step * (-(metric**2) * pull * x + forget * out + 0.5 * temperature * (dims - 2) * metric * x)
        x = x + math.sqrt(2 * step * temperature) * metric * gaussian_noise(keys, k, dims, seed)
        length = np.sqrt((x * x).sum(axis=1, keepdims=True))
        x = np.where(length > MOST_RADIUS, x * (MOST_RADIUS / np.maximum(length, 1e-12)), x)
    return x


#: Positions stay within this radius.
MOST_RADIUS = 0.99


def langevin(df: DataFrame, key: str, temperature: float = 0.0, step: float = 0.01, rounds: int = 5, dims: int = 8, first: int = 0, seed: int = 0) -> DataFrame:
    """(key, radius, weight, position) after ``rounds`` steps, numbered from ``first``.

    Facts start at ``position`` if ``df`` has one, where it is null or missing at a
    place of radius .5 that their key gives.  Noise is a function of key and step,
    so results depend on neither partitions nor batches, and a run may be cut in two.
    """
    held = "position" in df.columns

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            keys = b[key].to_numpy()
            x = gaussian_noise(keys, -1, dims, seed)
            x *= 0.5 / np.linalg.norm(x, axis=1, keepdims=True)
            for i, p in enumerate(b["position"] if held else ()):
                if p is not None and len(p) == dims:
                    x[i] = p
            x = langevin_steps(x, keys, *[b[c].to_numpy(dtype=float) for c in ("access_count", "age_days", "importance")], temperature, step, rounds, first, seed)
            radius = np.linalg.norm(x, axis=1)
            yield pd.DataFrame({key: keys, "radius": radius, "weight": 1 - radius / MOST_RADIUS, "position": list(x)})

    return df.select(key, "access_count", "age_days", "importance", *(["position"] if held else [])).mapInPandas(run, f"{key} long, radius double, weight double, position array<double>")


def thompson(posteriors: DataFrame, keys: list[str], arm: str, seed: int) -> DataFrame:
    """(keys, arm, sample): the arm of the largest Beta draw of each stratum; a draw
    is seeded by its stratum and arm."""

    def run(batches):
        import zlib

        for b in batches:
            draws = [np.random.default_rng([seed, *[zlib.crc32(str(x).encode()) for x in row]]).beta(a, z) for row, a, z in zip(b[[*keys, arm]].itertuples(index=False), b["alpha"], b["beta"])]
            yield b[[*keys, arm]].assign(sample=draws)

    fields = dict(posteriors.dtypes)
    drawn = posteriors.select(*keys, arm, "alpha", "beta").mapInPandas(run, ", ".join(f"{c} {fields[c]}" for c in [*keys, arm]) + ", sample double")
    return drawn.groupBy(*keys).agg(F.max_by(arm, F.struct("sample", arm)).alias(arm), F.max("sample").alias("sample"))


def byte_tables(q: np.ndarray, bits: int, turn: np.ndarray) -> np.ndarray:
    """For each byte of a packed row and each of its 256 values, what it adds to the
    dot product of ``q`` with the decoded direction: (bytes, 256)."""
    c, per = codebook(bits, len(q)), 8 // bits
    turned = np.zeros(-(-len(q) // per) * per)
    turned[: len(q)] = turn @ q
    values = np.arange(256)
    out = np.zeros((len(turned) // per, 256))
    for k in range(per):
        code = (values >> (8 - bits * (k + 1))) & ((1 << bits) - 1)
        out += turned[k::per, None] * c[code][None, :]
    return out


def polar_encode(x: np.ndarray, bits: int, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(radii, codes) of the rows: the angles of the rotated vector in equal steps, those up
    to the last between 0 and pi, the last over the whole circle."""
    y = x @ turn.T
    tail = np.sqrt(np.cumsum((y * y)[:, ::-1], axis=1))[:, ::-1]  # length of what is left from a component on
    angles = np.arccos(np.clip(y[:, :-1] / np.maximum(tail[:, :-1], 1e-300), -1, 1))
    angles[:, -1] = np.arctan2(y[:, -1], y[:, -2]) % (2 * math.pi)
    span = np.full(angles.shape[1], math.pi)
    span[-1] = 2 * math.pi
    codes = np.minimum(angles / span * (1 << bits), (1 << bits) - 1).astype(np.uint8)
    return tail[:, 0], codes


def polar_decode(radius: np.ndarray, codes: np.ndarray, bits: int, turn: np.ndarray) -> np.ndarray:
    span = np.full(codes.shape[1], math.pi)
    span[-1] = 2 * math.pi
    angles = (codes + 0.5) * span / (1 << bits)
    sines = np.cumprod(np.hstack([np.ones((len(codes), 1)), np.sin(angles)]), axis=1)
    y = np.hstack([sines[:, :-1] * np.cos(angles), sines[:, -1:]])
    return (y * radius[:, None]) @ turn


def polar(df: DataFrame, bits: int, key: str = "fact_id", vector: str = "v") -> DataFrame:
    """(key, radius, codes, error) by polar angles."""

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            x = np.stack(b[vector].to_numpy()).astype(float)
            turn = rotation(x.shape[1])
            radius, codes = polar_encode(x, bits, turn)
            error = ((polar_decode(radius, codes, bits, turn) - x) ** 2).sum(axis=1) / np.maximum(radius**2, 1e-24)
            yield pd.DataFrame({key: b[key], "radius": radius, "codes": pack(codes, bits), "error": error})

    return df.select(key, vector).mapInPandas(run, f"{key} long, radius double, codes binary, error double")
