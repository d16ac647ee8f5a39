"""Time spans in seconds on a video's own clock. Three different overlaps exist and are kept apart by name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-9


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def span(time: Column) -> Column:
    """struct(start, end) of a two-element list; null unless both are finite and end > start."""
    ok = (F.size(time) >= 2) & finite(F.try_element_at(time, F.lit(1))) & finite(F.try_element_at(time, F.lit(2))) & (F.try_element_at(time, F.lit(2)) > F.try_element_at(time, F.lit(1)))
    return F.when(ok, F.struct(F.try_element_at(time, F.lit(1)).alias("start"), F.try_element_at(time, F.lit(2)).alias("end")))


def positive(x: Column) -> Column:
    """The value if it is finite and above 0, else null."""
    return F.when(finite(x) & (x > 0), x)


def clipped_segment(start: Column, end: Column, duration: Column) -> Column:
    """struct(start, end) of a valid segment (0 <= start < end), with the end cut to a positive duration; null if nothing is left."""
    cut = F.when(duration > 0, F.least(end, duration)).otherwise(end)
    return F.when((start >= 0) & (end > start) & (cut > start), F.struct(start.alias("start"), cut.alias("end")))


def whole_video(duration: Column) -> Column:
    return F.struct(F.lit(0.0).alias("start"), F.when(duration > 0, duration).otherwise(0.0).alias("end"))


def _unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def iou_swapping(gs: Column, ge: Column, ps: Column, pe: Column) -> Column:
    """Overlap of the evaluator: reversed ends are swapped, spans no longer than 1e-9 give 0."""
    a, b, c, d = F.least(gs, ge), F.greatest(gs, ge), F.least(ps, pe), F.greatest(ps, pe)
    inter = F.greatest(F.lit(0.0), F.least(b, d) - F.greatest(a, c))
    union = (b - a) + (d - c) - inter
    return F.when(((b - a) <= EPS) | ((d - c) <= EPS) | (union <= EPS), 0.0).otherwise(_unit(inter / union))


def iou_strict(gs: Column, ge: Column, ps: Column, pe: Column) -> Column:
    """Overlap of the reward: spans that are reversed, empty or missing give 0; the union is the hull."""
    ok = finite(gs) & finite(ge) & finite(ps) & finite(pe) & (ge > gs) & (pe > ps)
    inter = F.greatest(F.lit(0.0), F.least(ge, pe) - F.greatest(gs, ps))
    hull = F.greatest(ge, pe) - F.least(gs, ps)
    return F.when(ok, _unit(inter / hull)).otherwise(0.0)


def iou_or_null(gs: Column, ge: Column, ps: Column, pe: Column) -> Column:
    """Overlap for inspection: null where a span is missing, reversed or empty."""
    ok = finite(gs) & finite(ge) & finite(ps) & finite(pe) & (ge > gs) & (pe > ps)
    return F.when(ok, iou_strict(gs, ge, ps, pe))


def gated_iou(iou: Column, matched: Column, parsed: Column, top1_is_gt: Column) -> Column:
    """The overlap where the answer is matched, its time was parsed and the retrieved item is right; else 0."""
    return F.when(F.coalesce(matched & parsed & top1_is_gt, F.lit(False)), iou).otherwise(0.0)


def seconds_text(x: Column) -> Column:
    """Seconds as text: whole numbers as N.0, else at most six decimals without trailing zeros."""
    six = F.format_string("%.6f", x)
    return F.when(F.abs(x - F.bround(x)) < EPS, F.concat(F.bround(x).cast("bigint").cast("string"), F.lit(".0"))).otherwise(F.regexp_replace(six, r"\.?0+$", ""))


def segment_id(video: Column, start: Column, end: Column, desc: Column) -> Column:
    """video|start|end|desc with two decimals."""
    return F.concat_ws("|", video, F.format_string("%.2f", start), F.format_string("%.2f", end), desc)
