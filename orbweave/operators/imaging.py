"""Grey images: perceptual hashes over six windows, thumbs, proof of overlap without fill, and a tile's context from its measures.

Images travel as rows: an id, the greys row by row, height and width. Each row is worked on alone, so a task holds one
Arrow batch of images, as numbers and not as Python objects. Null or empty images have no hashes and an empty thumb; images whose length is not height times
width are an error.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave import storage

# Windows as shares of the sides (left, top, right, bottom); the hash's sides; the bounds of the proof and of contexts.
WINDOWS = ((0.0, 0.0, 1.0, 1.0), (0.0, 0.0, 0.6, 0.6), (0.4, 0.0, 1.0, 0.6), (0.0, 0.4, 0.6, 1.0), (0.4, 0.4, 1.0, 1.0), (0.2, 0.2, 0.8, 0.8))
HASH_SIDE, SMALL_SIDE, THUMB_SIDE, PROOF_SIDE = 8, 32, 8, 128
MIN_OVERLAP, DETAIL_SIGMA, DETAIL_STD, FLAT, MARGIN = 0.25, 3.0, 1.0, 5, 7
CLOUD_FRAC, LAND_BLOB_FRAC, LAND_EDGES = 0.9, 0.08, 0.12
# Rows that a worker takes and returns at a time, and the bytes of pairs of images that it is sent.
ROWS, PAIR_BYTES = 64, "4m"


@functools.lru_cache(maxsize=256)
def _area(n: int, m: int) -> np.ndarray:
    """The m by n matrix that averages n pixels over m cells of equal width; pixels that lie in two cells count by their share."""
    cell, pixel = np.arange(m)[:, None] * n / m, np.arange(n)[None, :]
    return np.clip(np.minimum(cell + n / m, pixel + 1) - np.maximum(cell, pixel), 0, None) * m / n


def shrink(grey: np.ndarray, side: int) -> np.ndarray:
    """Mean greys of ``side`` by ``side`` cells."""
    return _area(grey.shape[0], side) @ grey @ _area(grey.shape[1], side).T


@functools.lru_cache(maxsize=4)
def _cosines(n: int, m: int) -> np.ndarray:
    """The first m rows of the orthonormal cosine transform of length n."""
    k, j = np.arange(m)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * (2 * j + 1) * k / (2 * n)) * np.where(k == 0, math.sqrt(1 / n), math.sqrt(2 / n))


def phash(grey: np.ndarray) -> int:
    """64 bits, the first one highest, as a signed number: the low frequencies against the median of all but the mean."""
    basis = _cosines(SMALL_SIDE, HASH_SIDE)
    low = (basis @ shrink(grey, SMALL_SIDE) @ basis.T).ravel()
    return int.from_bytes(np.packbits(low > np.median(low[1:])).tobytes(), "big", signed=True)


def window_hashes(grey: np.ndarray) -> list[int]:
    """One hash a window that holds a pixel."""
    h, w = grey.shape
    cut = [grey[int(y0 * h) : int(y1 * h), int(x0 * w) : int(x1 * w)] for x0, y0, x1, y1 in WINDOWS]
    return [phash(x) for x in cut if x.size]


def unit_thumb(grey: np.ndarray) -> np.ndarray:
    """The thumb's greys less their mean, over their norm; without contrast, zeros."""
    less = shrink(grey, THUMB_SIDE).ravel()
    less = less - less.mean()
    norm = np.linalg.norm(less)
    return less / norm if norm > 1e-6 else np.zeros_like(less)


def _pixels(flat, h: int, w: int) -> np.ndarray | None:
    if flat is None or len(flat) == 0:
        return None
    return np.asarray(flat, dtype=np.float64).reshape(h, w)


def _lists(column: pa.ListArray) -> list[np.ndarray | None]:
    """The numbers of each row as a view of the column; None where the row is null."""
    at, there = column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
    flat = column.values.slice(at[0], at[-1] - at[0]).to_numpy(zero_copy_only=False)
    return [flat[i:j] if ok else None for i, j, ok in zip(at - at[0], at[1:] - at[0], there, strict=False)]


def _column(rows: list, kind: type) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.asarray(r, dtype=kind) for r in rows])))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield from (b.slice(start, ROWS) for start in range(0, b.num_rows, ROWS))


def _proof(img: np.ndarray) -> np.ndarray:
    return shrink(img, PROOF_SIDE).astype(np.float32)


def signatures(images: DataFrame, id_col: str, grey: str = "grey", height: str = "height", width: str = "width", proof: bool = True) -> DataFrame:
    """Per image: ``<id>, hashes, thumb`` - six hashes and the unit thumb - and, if asked for, ``proof``: its greys at 128 by 128."""
    kind = images.schema[id_col].dataType.simpleString()

    def sign(img: np.ndarray | None) -> tuple:
        if img is None:
            return [], [], []
        return window_hashes(img), unit_thumb(img), _proof(img).ravel() if proof else []

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches):
            rows = [sign(_pixels(*x)) for x in zip(_lists(b.column("grey")), b.column("h").to_pylist(), b.column("w").to_pylist(), strict=True)]
            made = {"hashes": np.int64, "thumb": np.float64} | ({"proof": np.float32} if proof else {})
            yield pa.RecordBatch.from_pydict({id_col: b.column("id")} | {name: _column([r[k] for r in rows], made[name]) for k, name in enumerate(made)})

    named = images.select(F.col(id_col).alias("id"), F.col(grey).alias("grey"), F.col(height).alias("h"), F.col(width).alias("w"))
    return named.mapInArrow(signed, f"`{id_col}` {kind}, hashes array<long>, thumb array<double>" + (", proof array<float>" if proof else ""))


def _spread(grid: np.ndarray, side: int, pick: np.ufunc, outside) -> np.ndarray:
    """``pick`` over the square of ``side`` about every pixel, by rows and then columns; what lies outside counts as ``outside``."""
    padded = np.pad(grid, side // 2, constant_values=outside)
    h, w = grid.shape
    tall = functools.reduce(pick, (padded[k : k + h] for k in range(side)))
    return functools.reduce(pick, (tall[:, k : k + w] for k in range(side)))


def real_pixels(grey: np.ndarray) -> np.ndarray:
    """True but for fill, which is perfectly flat where real images have noise, and a margin about it."""
    flat = _spread(grey, FLAT, np.maximum, -np.inf) == _spread(grey, FLAT, np.minimum, np.inf)
    return ~_spread(flat, MARGIN, np.logical_or, False)


def _shift(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Rows and columns by which b lies after a: the peak of the phase correlation, to the centroid of its surroundings."""
    taper = np.outer(np.hanning(a.shape[0]), np.hanning(a.shape[1]))
    cross = np.conj(np.fft.rfft2((a - a.mean()) * taper)) * np.fft.rfft2((b - b.mean()) * taper)
    power = np.fft.irfft2(cross / np.maximum(np.abs(cross), 1e-12), s=a.shape)
    at = np.unravel_index(int(np.argmax(power)), power.shape)
    near = np.arange(-2, 3)
    around = power[np.ix_((at[0] + near) % a.shape[0], (at[1] + near) % a.shape[1])]
    total = around.sum()
    moved = (around.sum(axis=1) @ near / total, around.sum(axis=0) @ near / total) if total > 1e-12 else (0.0, 0.0)
    whole = [p - n if p > n // 2 else p for p, n in zip(at, a.shape, strict=True)]
    return round(whole[0] + float(np.clip(moved[0], -2, 2))), round(whole[1] + float(np.clip(moved[1], -2, 2)))


def _smooth(grey: np.ndarray, sigma: float) -> np.ndarray:
    r = int(4 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    for axis in (0, 1):
        width = [(r, r) if k == axis else (0, 0) for k in (0, 1)]
        grey = np.lib.stride_tricks.sliding_window_view(np.pad(grey, width, mode="reflect"), 2 * r + 1, axis=axis) @ kernel
    return grey


def _correlation(a: np.ndarray, b: np.ndarray) -> float:
    a, b = a - a.mean(), b - b.mean()
    norm = float(np.linalg.norm(a) * np.linalg.norm(b))
    return float(a @ b) / norm if norm > 1e-6 else 0.0


def overlap_evidence(a: np.ndarray, b: np.ndarray) -> tuple[float, float, float]:
    """``coarse, detail, share`` of two greys of one shape over the part that both show, fill left out.

    Under a quarter of real or of common pixels: coarse 0 and detail NaN. Detail is NaN too where the fine texture of
    either has a deviation below one grey.
    """
    nothing = float("nan")
    real_a, real_b = real_pixels(a), real_pixels(b)
    if min(real_a.mean(), real_b.mean()) < MIN_OVERLAP:
        return 0.0, nothing, 0.0
    a, b = np.where(real_a, a, a[real_a].mean()), np.where(real_b, b, b[real_b].mean())
    h, w = a.shape
    dy, dx = _shift(a, b)
    if abs(dy) >= h or abs(dx) >= w:
        return 0.0, nothing, 0.0
    on_a = np.s_[max(-dy, 0) : h - max(dy, 0), max(-dx, 0) : w - max(dx, 0)]
    on_b = np.s_[max(dy, 0) : h - max(-dy, 0), max(dx, 0) : w - max(-dx, 0)]
    both = real_a[on_a] & real_b[on_b]
    share = float(both.sum()) / (h * w)
    if share < MIN_OVERLAP:
        return 0.0, nothing, share
    coarse = _correlation(a[on_a][both], b[on_b][both])
    fine_a, fine_b = (a - _smooth(a, DETAIL_SIGMA))[on_a][both], (b - _smooth(b, DETAIL_SIGMA))[on_b][both]
    detail = nothing if min(fine_a.std(), fine_b.std()) < DETAIL_STD else _correlation(fine_a, fine_b)
    return coarse, detail, share


def _proven(pairs: DataFrame, rows: DataFrame, id_col: str, grey: Callable[[Column], Column], sides: Callable[[Column], tuple[Column, Column]], proof: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """The rows of each pair meet as they are; what is made of them goes to Python a few at a time, and the answers to the shared folder."""
    own = lambda k: rows.select(F.col(id_col).alias(k), F.struct(*rows.columns).alias("of_" + k))
    kind = rows.schema[id_col].dataType.simpleString()

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            greys = [[_pixels(*x) for x in zip(_lists(batch.column("g" + k)), batch.column("h" + k).to_pylist(), batch.column("w" + k).to_pylist(), strict=True)] for k in "ab"]
            there = [k for k, (x, y) in enumerate(zip(*greys, strict=True)) if x is not None and y is not None]
            found = [overlap_evidence(*(proof(g[k]).astype(np.float64) for g in greys)) for k in there]
            ids = batch.select(["a", "b"]).take(pa.array(there, pa.int32())).columns
            yield pa.RecordBatch.from_arrays(ids + [pa.array([f[k] for f in found], pa.float64()) for k in range(3)], names=["a", "b", "coarse", "detail", "share"])

    both = pairs.select("a", "b").join(own("a"), "a").join(own("b"), "b")
    made = [c for k in "ab" for of in [F.col("of_" + k)] for c in (grey(of).alias("g" + k), *(s.alias(n + k) for s, n in zip(sides(of), "hw", strict=True)))]
    out = both.select("a", "b", *made).mapInArrow(prove, f"a {kind}, b {kind}, coarse double, detail double, share double")
    return storage.materialize(out, "evidence", batch=PAIR_BYTES)


def evidence(pairs: DataFrame, signed: DataFrame, id_col: str, proof: str = "proof") -> DataFrame:
    """``a, b, coarse, detail, share`` of candidate pairs; pairs with an image that has no greys have no row.

    The proofs, 64 KB each, travel to their pairs. Where images are stored in less, see ``image_evidence``.
    """
    side = lambda of: F.sqrt(F.size(of[proof])).cast("int")
    return _proven(pairs, signed.where(F.size(proof) > 0), id_col, lambda of: of[proof], lambda of: (side(of), side(of)), lambda img: img)


def image_evidence(pairs: DataFrame, images: DataFrame, id_col: str, grey: Callable[[Column], Column], height: int, width: int) -> DataFrame:
    """``evidence`` of images as they are stored: their rows travel to the pairs, and ``grey`` makes the greys of a row there."""
    return _proven(pairs, images, id_col, grey, lambda _: (F.lit(height), F.lit(width)), _proof)


def tile_context(cloud_frac: Column, edge_density: Column, big_blob_frac: Column, n_boxes: Column) -> Column:
    """What a tile shows, from its measures: clouds first, then land by large bright areas or by edges, then candidates."""
    land = (big_blob_frac >= LAND_BLOB_FRAC) | (edge_density >= LAND_EDGES)
    return F.when(cloud_frac >= CLOUD_FRAC, "cloud").when(land, "land_coast").when(n_boxes > 0, "candidates").otherwise("empty_sea")


def planning_context(context: Column, n_detections: Column) -> Column:
    """The context that the encoders plan with: the verdict on cloud and coast stands, on other tiles the detector decides."""
    return F.when(context == "cloud", "cloud").when(context == "land_coast", "coast").when(n_detections > 0, "ships").otherwise("empty")
