"""Arithmetic of frame sampling and resizing. Rounding is half to even throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
FRAME_FACTOR, FPS, MIN_FRAMES, MAX_FRAMES = 2, 2.0, 4, 768


def by_factor(x: Column, factor: int, how: str = "round") -> Column:
    f = {"round": F.bround, "ceil": F.ceil, "floor": F.floor}[how]
    return (f(x / F.lit(factor)) * factor).cast("bigint")


def frame_bounds(start: Column, end: Column, fps: Column, total: Column) -> Column:
    """struct(first, last): seconds as frames, truncated, inside the video, at least one frame wide."""
    last_frame = F.greatest(total - 1, F.lit(0)).cast("bigint")
    a = F.least(F.greatest((start * fps).cast("bigint"), F.lit(0).cast("bigint")), last_frame)
    b = F.least(F.greatest((end * fps).cast("bigint"), a + 1), F.greatest(total.cast("bigint"), a + 1))
    return F.struct(a.alias("first"), b.alias("last"))


def sample_indices(start: Column, end: Column, fps: Column, raw_fps: Column, total: Column) -> Column:
    """Source frames nearest to start, start + 1/fps, ... up to end; inside the video, each once."""
    n = F.floor((end - start + 1e-6) * fps).cast("int")
    at = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: F.bround((start + i / fps) * raw_fps).cast("bigint"))
    return F.array_distinct(F.transform(at, lambda i: F.least(F.greatest(i, F.lit(0).cast("bigint")), (total - 1).cast("bigint"))))


def even_spread(first: Column, last: Column, n: Column) -> Column:
    """n whole numbers evenly spread from first to last, truncated."""
    step = F.when(n > 1, (last - first) / (n - 1)).otherwise(0.0)
    return F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: (first + i * step).cast("bigint"))


def smart_frames(total: Column, raw_fps: Column, fps: float = FPS, least: int = MIN_FRAMES, most: int = MAX_FRAMES) -> Column:
    """How many frames to take: the target rate, between the least and most (and the total), a multiple of the frame factor; null if fewer than that factor remain."""
    low = F.lit(-(-least // FRAME_FACTOR) * FRAME_FACTOR)
    high = by_factor(F.least(F.lit(most), total), FRAME_FACTOR, "floor")
    n = by_factor(F.least(F.least(F.greatest(total / raw_fps * fps, low), high), total), FRAME_FACTOR, "floor")
    return F.when((n >= FRAME_FACTOR) & (n <= total), n)


def frame_range(start: Column, end: Column, fps: Column, total: Column) -> Column:
    """struct(first, last): the first frame not before start, the last not after end; null if none."""
    a = F.greatest(F.ceil(start * fps), F.lit(0)).cast("bigint")
    b = F.least(F.floor(end * fps), total - 1).cast("bigint")
    return F.when(a <= b, F.struct(a.alias("first"), b.alias("last")))


def smart_size(height: Column, width: Column, factor: int, least: int, most: int) -> Column:
    """struct(height, width): multiples of the factor, as near to the shape as a number of pixels between least and most allows."""
    h = F.greatest(F.lit(factor), by_factor(height, factor))
    w = F.greatest(F.lit(factor), by_factor(width, factor))
    area = (height * width).cast("double")
    shrink, grow = F.sqrt(area / most), F.sqrt(F.lit(float(least)) / area)

    def pick(side: Column, plain: Column) -> Column:
        return F.when(h * w > most, by_factor(side / shrink, factor, "floor")).when(h * w < least, by_factor(side * grow, factor, "ceil")).otherwise(plain)

    return F.struct(pick(height, h).alias("height"), pick(width, w).alias("width"))


def sample_count(duration: Column, fps: Column, total: Column, most: int) -> Column:
    """How many frames a stored array has: floor(duration * fps), not above the total or the most, at least 1."""
    return F.greatest(F.least(F.floor(duration * fps), total, F.lit(most)), F.lit(1)).cast("bigint")


def budget_size(height: Column, width: Column, most: int) -> Column:
    """struct(height, width) shrunk to at most so many pixels, truncated, at least 1; unchanged if it fits."""
    by = F.least(F.sqrt(F.lit(float(most)) / (height * width)), F.lit(1.0))
    side = lambda x: F.greatest((x * by).cast("bigint"), F.lit(1).cast("bigint"))
    return F.struct(side(height).alias("height"), side(width).alias("width"))


def budget_frames(tokens: Column, side: Column, duration: Column) -> Column:
    """struct(frames, fps): frames that fit 85 % of a token budget at (side/28)^2 tokens each, and the rate that gives them."""
    n = F.greatest(F.floor(tokens * 0.85 / F.pow(side / 28.0, F.lit(2.0))), F.lit(1)).cast("bigint")
    return F.struct(n.alias("frames"), F.when(duration > 0, n / duration).otherwise(0.0).alias("fps"))


def nearest(available: Column, wanted: Column) -> Column:
    """The available frame nearest to the one wanted; the earlier in the list on a tie."""
    best = F.array_min(F.transform(available, lambda x, i: F.struct(F.abs(x - wanted).alias("d"), i.alias("i"), x.alias("x"))))
    return best["x"]
