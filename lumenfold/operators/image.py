"""Image kernels over arrays of pixels: NumPy inside Arrow UDFs, geometry as column expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.fixed import TONE_CURVES


def gray_of(rgb: np.ndarray) -> np.ndarray:
    return rgb @ np.array([0.299, 0.587, 0.114])


def sharpness(gray: np.ndarray) -> float:
    """Variance of the Laplacian over ten, at most 100."""
    g = gray.astype(np.float64)
    lap = g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]
    return float(min(100.0, lap.var() / 10)) if lap.size else 0.0


def exposure(gray: np.ndarray) -> tuple[float, bool]:
    """Score from the shares of dark (below 26), blown (230 and over) and middle (64 to 191) pixels, and whether it is acceptable."""
    n = max(gray.size, 1)
    dark, blown, middle = (gray < 26).sum() / n, (gray >= 230).sum() / n, ((gray >= 64) & (gray <= 191)).sum() / n
    return float(np.clip(middle * 100 - dark * 50 - blown * 80 + 20, 0, 100)), bool(dark < 0.35 and blown < 0.15)


def perceptual_hash(gray: np.ndarray, size: int = 8, factor: int = 4) -> int:
    """64 bits: which low-frequency cosine coefficients of a reduced image exceed their median."""
    n = size * factor
    rows = np.add.reduceat(np.add.reduceat(gray.astype(np.float64), np.arange(n) * gray.shape[0] // n, axis=0), np.arange(n) * gray.shape[1] // n, axis=1)
    k = np.arange(n)
    basis = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n))
    low = (basis @ rows @ basis.T)[:size, :size]
    bits = (low > np.median(low)).ravel()
    return int(np.packbits(bits).view(">i8")[0])


def tone_table(points: list[tuple[int, int]]) -> list[int]:
    x, y = zip(*points)
    return np.interp(np.arange(256), x, y).astype(int).tolist()


def tone_tables(mood: str) -> list[list[int]]:
    return [tone_table(p) for p in TONE_CURVES.get(mood, TONE_CURVES["flat"])]


def graded(pixels: Column, channel: Column, mood: Column) -> Column:
    """Channel values (0 red, 1 green, 2 blue) through the tone curve of a mood; unknown moods are flat. No UDF is needed."""
    key = F.concat_ws("/", F.coalesce(F.when(mood.isin(list(TONE_CURVES)), mood), F.lit("flat")), channel.cast("string"))
    table = F.create_map(*(x for m in TONE_CURVES for c, t in enumerate(tone_tables(m)) for x in (F.lit(f"{m}/{c}"), F.lit(t))))
    return F.transform(pixels, lambda p: F.get(F.element_at(table, key), p))


def vibrance(rgb: np.ndarray, amount: float = 0.32) -> np.ndarray:
    """Less saturated pixels gain more."""
    x = rgb.astype(np.float64)
    mean, spread = x.mean(axis=-1, keepdims=True), (x.max(axis=-1, keepdims=True) - x.min(axis=-1, keepdims=True)) / 255
    return np.clip(mean + (x - mean) * (1 + amount * (1 - spread)), 0, 255).astype(np.uint8)


def vignette(rgb: np.ndarray, strength: float = 0.22) -> np.ndarray:
    h, w = rgb.shape[:2]
    y, x = np.linspace(-1, 1, h)[:, None], np.linspace(-1, 1, w)[None, :]
    return np.clip(rgb * (1 - strength * np.clip(x * x + y * y, 0, 1))[..., None], 0, 255).astype(np.uint8)


def grain(rgb: np.ndarray, amount: float = 3.5, seed: int = 0) -> np.ndarray:
    noise = np.random.default_rng(seed).normal(0, amount, rgb.shape[:2])[..., None]
    return np.clip(rgb + noise, 0, 255).astype(np.uint8)


def crop_box(w: Column, h: Column, target_w: int, target_h: int) -> Column:
    """left, top, width and height of the largest part of the target's shape, centred, or a little high."""
    ratio = target_w / target_h
    wide = w / h > ratio
    new_w, new_h = F.when(wide, F.floor(h * ratio)).otherwise(w), F.when(wide, h).otherwise(F.floor(w / ratio))
    return F.struct(F.floor((w - new_w) / 2).cast("int").alias("left"), F.floor((h - new_h) * 0.38).cast("int").alias("top"), new_w.cast("int").alias("width"), new_h.cast("int").alias("height"))


def collage_cell(i: Column, w: int, h: int, cols: int = 3, rows: int = 2, gap: int = 8) -> Column:
    """Place and size of the i-th cell of a collage."""
    cw, ch = (w - gap * (cols + 1)) // cols, (h - gap * (rows + 1)) // rows
    return F.struct((gap + i % cols * (cw + gap)).cast("int").alias("x"), (gap + F.floor(i / cols) * (ch + gap)).cast("int").alias("y"), F.lit(cw).alias("width"), F.lit(ch).alias("height"))


def technical(gray: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """`sharpness`, `exposure` (score and whether it is acceptable) and `perceptual_hash` of n pictures of one shape, n x h x w, at once."""
    g, count = gray.astype(np.float64), len(gray)
    lap = g[:, :-2, 1:-1] + g[:, 2:, 1:-1] + g[:, 1:-1, :-2] + g[:, 1:-1, 2:] - 4 * g[:, 1:-1, 1:-1]
    sharp = np.minimum(100.0, lap.reshape(count, -1).var(axis=1) / 10) if lap.size else np.zeros(count)
    n = max(g[0].size, 1)
    share = lambda x: x.sum(axis=(1, 2)) / n
    dark, blown, middle = share(g < 26), share(g >= 230), share((g >= 64) & (g <= 191))
    score = np.clip(middle * 100 - dark * 50 - blown * 80 + 20, 0, 100)
    size, m = 8, 32
    rows = np.add.reduceat(np.add.reduceat(g, np.arange(m) * g.shape[1] // m, axis=1), np.arange(m) * g.shape[2] // m, axis=2)
    k = np.arange(m)
    basis = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * m))
    low = (basis @ rows @ basis.T)[:, :size, :size].reshape(count, -1)
    bits = low > np.median(low, axis=1, keepdims=True)
    return sharp, score, (dark < 0.35) & (blown < 0.15), np.packbits(bits, axis=1).view(">i8")[:, 0].astype(np.int64)


def technical_udf(pixels: int = 1 << 20):
    """Of gray pixels and a width: sharpness, exposure score, whether the exposure is good, and the perceptual hash.

    Pictures of one shape are computed together, so many pixels at once at most; without pixels or a width all is null.
    """

    @F.arrow_udf("sharpness double, exposure double, exposure_ok boolean, phash bigint")
    def of(gray: pa.Array, width: pa.Array) -> pa.Array:
        there = np.flatnonzero(pc.and_(gray.is_valid(), width.is_valid()).to_numpy(zero_copy_only=False))
        starts, flat = gray.offsets.to_numpy(), gray.values.to_numpy(zero_copy_only=False)
        size, wide = np.diff(starts)[there], width.to_numpy(zero_copy_only=False)[there].astype(np.int64)
        of_all = [np.zeros(len(gray)), np.zeros(len(gray)), np.zeros(len(gray), bool), np.zeros(len(gray), np.int64)]
        for n, w in set(zip(size.tolist(), wide.tolist())):
            alike = there[(size == n) & (wide == w)]
            most = max(1, pixels // max(n, 1))
            for i in range(0, len(alike), most):
                at = alike[i : i + most]
                stack = flat[starts[at][:, None] + np.arange(n)].reshape(len(at), -1, w)
                for out, x in zip(of_all, technical(stack)):
                    out[at] = x
        missing = np.ones(len(gray), bool)
        missing[there] = False
        return pa.StructArray.from_arrays([pa.array(x, mask=missing) for x in of_all], ["sharpness", "exposure", "exposure_ok", "phash"])

    return of


def reduced(rgb: np.ndarray, longest: int) -> np.ndarray:
    """The picture with its longer side at most longest: means of whole blocks of pixels."""
    step = -(-max(rgb.shape[:2]) // longest)
    if step <= 1:
        return rgb
    h, w = (max(1, n // step) for n in rgb.shape[:2])
    cut = rgb[: h * step, : w * step].reshape(h, min(step, rgb.shape[0]), w, min(step, rgb.shape[1]), -1)
    return cut.mean(axis=(1, 3)).astype(np.uint8)


def upright(rgb: np.ndarray, orientation: int | None) -> np.ndarray:
    """The picture turned as its orientation tag says (3: half a turn, 6: a quarter clockwise, 8: a quarter counter-clockwise)."""
    return np.rot90(rgb, {3: 2, 6: 3, 8: 1}.get(orientation or 1, 0))


def gradient_bar(rgb: np.ndarray, top: bool, height: int = 240, strength: float = 0.78) -> np.ndarray:
    """A band at the top or bottom that darkens toward the edge, for text to be read on."""
    height = min(height, rgb.shape[0])
    ramp = 1 - strength * np.linspace(1, 0, height)
    out = rgb.astype(np.float64)
    if top:
        out[:height] *= ramp[:, None, None]
    else:
        out[-height:] *= ramp[::-1, None, None]
    return out.astype(np.uint8)
