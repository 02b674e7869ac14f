"""Boxes and points as columns. A box is four columns x1, y1, x2, y2."""

from __future__ import annotations

from math import log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 1000

Box = tuple[Column, Column, Column, Column]


def number(value) -> Column:
    return F.lit(float(value)) if isinstance(value, (int, float)) else value.cast("double")


def clipped(box: Box, width, height) -> Box:
    """The sides moved into the image."""
    w, h = number(width), number(height)
    clip = lambda v, most: F.greatest(F.lit(0.0), F.least(v.cast("double"), most))
    return clip(box[0], w), clip(box[1], h), clip(box[2], w), clip(box[3], h)


def clean(box: Box, width, height) -> Box:
    """Reversed sides swapped, clipped to the image; all null for a side that is null or not finite, or for a box without area left."""
    x1, y1, x2, y2 = box
    finite = lit_all(*(v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")) for v in box))
    out = clipped((F.least(x1, x2), F.least(y1, y2), F.greatest(x1, x2), F.greatest(y1, y2)), width, height)
    fine = finite & (out[2] > out[0]) & (out[3] > out[1])
    return tuple(F.when(fine, v) for v in out)


def lit_all(*conditions: Column) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & F.coalesce(c, F.lit(False))
    return out


def from_location(box: Box, location: Box) -> Box:
    """The box, or where one of its sides is missing that of (x, y, width, height)."""
    whole = lit_all(*(v.isNotNull() for v in box))
    x, y, w, h = location
    return tuple(F.when(whole, b).otherwise(v) for b, v in zip(box, (x, y, x + w, y + h)))


def box_error(box: Box, width, height) -> Column:
    """Why a box cannot be used as it stands, else null: not finite, or no area once clipped (sides are not swapped)."""
    finite = lit_all(*(v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")) for v in box))
    out = clipped(box, width, height)
    return F.when(~finite, "not finite").when((out[2] <= out[0]) | (out[3] <= out[1]), "degenerate")


def is_background(label: Column, box: Box, width, height, share: float = 0.9) -> Column:
    """Whether a shape covers so much of the image that it is its background."""
    return F.coalesce((label == "shape") & (area(box) / (number(width) * number(height)) >= share), F.lit(False))


def quantise(value: Column, size: int, bins: int = BINS) -> Column:
    """A coordinate clipped to [0, size - 1] on a scale of ``bins``, rounded half up; 0 for a size of 1."""
    if size <= 1:
        return F.lit(0).cast("long")
    clipped = F.greatest(F.lit(0.0), F.least(value.cast("double"), F.lit(float(size - 1))))
    return F.floor(clipped / float(size - 1) * float(bins - 1) + 0.5).cast("long")


def dequantise(code: Column, size: int, bins: int = BINS) -> Column:
    return F.greatest(F.lit(0.0), F.least(code.cast("double"), F.lit(float(bins - 1)))) / float(bins - 1) * float(max(size - 1, 0))


def dequantised(codes: Box, width: int, height: int, bins: int = BINS) -> Box:
    """A box of codes in pixels, its sides put in order; a code of ``bins`` counts as the last one."""
    x1, y1, x2, y2 = (dequantise(c, n, bins) for c, n in zip(codes, (width, height, width, height)))
    return F.least(x1, x2), F.least(y1, y2), F.greatest(x1, x2), F.greatest(y1, y2)


def are_codes(box: Box, bins: int = BINS) -> Column:
    """Whether a box may be one of codes: no side is over ``bins``, which itself is let pass."""
    return F.greatest(*(F.abs(v.cast("double")) for v in box)) <= float(bins)


def grown(low: Column, high: Column, bins: int = BINS) -> tuple[Column, Column]:
    """Two codes at least one apart: the higher grows first, the lower where that is at the edge."""
    flat = high <= low
    up = F.when(flat, F.least(low + 1, F.lit(bins - 1))).otherwise(high)
    return F.when(flat & (low >= bins - 1), F.lit(bins - 2)).otherwise(low).cast("long"), up.cast("long")


def area(box: Box) -> Column:
    return F.greatest(box[2] - box[0], F.lit(0.0)) * F.greatest(box[3] - box[1], F.lit(0.0))


def overlap(a: Box, b: Box) -> Column:
    return area((F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3])))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 where the union is empty."""
    inter = overlap(a, b)
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def coverage(target: Box, container: Box) -> Column:
    return F.when(area(target) > 0, overlap(target, container) / area(target)).otherwise(0.0)


def crop_iou(a: Box, b: Box) -> Column:
    """Intersection over union of crops, whose areas count as 1 at least."""
    inter = overlap(a, b)
    return inter / (F.greatest(area(a), F.lit(1.0)) + F.greatest(area(b), F.lit(1.0)) - inter)


def moved(box: Box, dx, dy) -> Box:
    return box[0] + dx, box[1] + dy, box[2] + dx, box[3] + dy


def scaled(box: Box, sx, sy, width, height, dx=0.0, dy=0.0) -> Box:
    """The box scaled, then moved, then clipped to an image."""
    return clipped(moved((box[0] * sx, box[1] * sy, box[2] * sx, box[3] * sy), dx, dy), width, height)


def bounded_interval(center: Column, length: Column, limit) -> tuple[Column, Column]:
    """Whole pixels (start, end) of a length about a centre, moved into [0, limit]; the whole range where it is too long."""
    most, n = number(limit), length.cast("double")
    start = F.floor(center - n / 2.0).cast("double")
    start = F.least(F.greatest(start, F.lit(0.0)), most - n)
    return F.when(n >= most, 0.0).otherwise(start).cast("long"), F.when(n >= most, most).otherwise(start + n).cast("long")


def least_size(crop: Box, size: int, width, height) -> Box:
    """A crop widened about its centre where a side is below ``size``."""
    out = []
    for low, high, limit in ((crop[0], crop[2], width), (crop[1], crop[3], height)):
        a, b = bounded_interval((low + high) / 2.0, F.least(F.lit(float(size)), number(limit)), limit)
        short = high - low < size
        out.append((F.when(short, a).otherwise(low), F.when(short, b).otherwise(high)))
    return out[0][0], out[1][0], out[0][1], out[1][1]


def bounded_aspect(crop: Box, ratio: float, width, height) -> Box:
    """A crop whose short side is widened about its centre where the long one is over ``ratio`` times it."""
    x1, y1, x2, y2 = crop
    w, h = (x2 - x1).cast("double"), (y2 - y1).cast("double")
    flat, tall = w / h > ratio, h / w > ratio
    top, bottom = bounded_interval((y1 + y2) / 2.0, F.least(number(height), F.greatest(h, F.ceil(w / ratio).cast("double"))), height)
    left, right = bounded_interval((x1 + x2) / 2.0, F.least(number(width), F.greatest(w, F.ceil(h / ratio).cast("double"))), width)
    return F.when(tall & ~flat, left).otherwise(x1), F.when(flat, top).otherwise(y1), F.when(tall & ~flat, right).otherwise(x2), F.when(flat, bottom).otherwise(y2)


def outward(box: Box, width: int, height: int) -> Box:
    """Whole pixels that hold the box, one at least, inside the image."""
    x1, y1, x2, y2 = (F.least(box[0], box[2]), F.least(box[1], box[3]), F.greatest(box[0], box[2]), F.greatest(box[1], box[3]))
    left, top = F.least(F.greatest(F.floor(x1), F.lit(0)), F.lit(width - 1)), F.least(F.greatest(F.floor(y1), F.lit(0)), F.lit(height - 1))
    return left, top, F.least(F.greatest(F.ceil(x2), left + 1), F.lit(width)), F.least(F.greatest(F.ceil(y2), top + 1), F.lit(height))


def inside(a: Box, b: Box) -> Column:
    return (a[0] >= b[0]) & (a[1] >= b[1]) & (a[2] <= b[2]) & (a[3] <= b[3])


def crosses(a: Box, b: Box) -> Column:
    return (a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3])


def padded(box: Box, ratio: float, width: int, height: int) -> Box:
    """The box with a margin of ``ratio`` of its sides, to whole pixels outwards, clipped."""
    x1, y1, x2, y2 = box
    mx, my = (x2 - x1) * ratio, (y2 - y1) * ratio
    return F.greatest(F.lit(0), F.floor(x1 - mx)), F.greatest(F.lit(0), F.floor(y1 - my)), F.least(F.lit(width), F.ceil(x2 + mx)), F.least(F.lit(height), F.ceil(y2 + my))


#: Bands of pixel counts, each up to its limit.
BANDS = (("below-0.2M", 200_704), ("0.2-0.5M", 500_000), ("0.5-1M", 1_000_000), ("1-2M", 2_000_000), ("2-4M", 4_000_001))


def pixel_band(pixels: Column) -> Column:
    out = F.lit("above-4M")
    for name, limit in reversed(BANDS):
        out = F.when(pixels < limit, name).otherwise(out)
    return out


ASPECT = 200  # sides of an image may differ by this factor at most


def resized(width: Column, height: Column, least: int, most: int, factor: int = 32) -> tuple[Column, Column]:
    """Sides as multiples of ``factor`` (half to even), scaled to stay between two numbers of pixels; null beyond ASPECT."""
    w, h = (F.greatest(F.lit(factor), F.bround(v / factor) * factor) for v in (width, height))
    big, small = F.sqrt(width * height / float(most)), F.sqrt(F.lit(float(least)) / (width * height))
    fine = (width > 0) & (height > 0) & (F.greatest(width, height) <= ASPECT * F.least(width, height))
    pick = lambda v, r: F.when(fine, F.when(w * h > most, F.greatest(F.lit(factor), F.floor(v / big / factor) * factor)).when(w * h < least, F.ceil(v * small / factor) * factor).otherwise(r).cast("long"))
    return pick(width, w), pick(height, h)


def aligned_candidates(width: Column, height: Column, target: int, least: int, most: int, factor: int = 32, upscale: float | None = None) -> Column:
    """Sizes of multiples of ``factor`` about a number of pixels: widths and heights up to four steps about the ideal
    ones, the other side following the ratio; array of struct(w, h) of those between two numbers of pixels."""
    multiple = lambda v: F.greatest(F.lit(float(factor)), F.rint(v / factor) * factor)
    start = F.struct(width.cast("double").alias("w"), height.cast("double").alias("h"), F.sqrt(F.lit(float(target)) / (width.cast("double") * height)).alias("scale"))
    ideal = F.transform(F.array(start), lambda s: F.struct(s["w"].alias("w"), s["h"].alias("h"), multiple(s["w"] * s["scale"]).alias("bw"), multiple(s["h"] * s["scale"]).alias("bh")))
    steps = F.array(*(F.lit(float(k * factor)) for k in range(-4, 5)))
    at_least = lambda v: F.greatest(F.lit(float(factor)), v)

    def about(s: Column) -> Column:
        wide = F.transform(steps, lambda d: F.struct(at_least(s["bw"] + d).alias("w"), multiple(at_least(s["bw"] + d) * s["h"] / s["w"]).alias("h")))
        high = F.transform(steps, lambda d: F.struct(multiple(at_least(s["bh"] + d) * s["w"] / s["h"]).alias("w"), at_least(s["bh"] + d).alias("h")))

        def allowed(p: Column) -> Column:
            fine = (p["w"] * p["h"]).between(least, most)
            return fine if upscale is None else fine & (p["w"] / s["w"] <= upscale + 1e-9) & (p["h"] / s["h"] <= upscale + 1e-9)

        return F.filter(F.concat(wide, high), allowed)

    return F.transform(ideal, about)[0]


def aligned_size(width: Column, height: Column, target: int, least: int, most: int, factor: int = 32, upscale: float | None = None) -> Column:
    """struct(width, height, allowed) of the candidate nearest to a number of pixels and to the sides' ratio, and how many different
    ones there are; null if there is none, and for sides that are not positive.

    The smallest sum of the two errors (as logarithms) wins, then the smaller error of the ratio, then of the pixels. All
    candidates of a batch of images are looked at together.
    """

    @F.pandas_udf("width long, height long, allowed long")
    def chosen(widths: pd.Series, heights: pd.Series) -> pd.DataFrame:
        w, h = (v.to_numpy(float)[:, None] for v in (widths, heights))
        steps = np.arange(-4, 5) * float(factor)
        multiple = lambda v: np.maximum(float(factor), np.rint(v / factor) * factor)
        with np.errstate(all="ignore"):
            scale = np.sqrt(target / (w * h))
            wide, high = np.maximum(float(factor), multiple(w * scale) + steps), np.maximum(float(factor), multiple(h * scale) + steps)
            cw, ch = np.hstack([wide, multiple(high * w / h)]), np.hstack([multiple(wide * h / w), high])
            fine = (w > 0) & (h > 0) & (cw * ch >= least) & (cw * ch <= most)
            if upscale is not None:
                fine &= (cw / w <= upscale + 1e-9) & (ch / h <= upscale + 1e-9)
            off, skew = np.abs(np.log(cw * ch / target)), np.abs(np.log((cw / ch) / (w / h)))
        left = fine.copy()
        for key in (off + skew, skew, off, cw, ch):  # of those that are best so far the best by the next key
            key = np.where(left, key, np.inf)
            left &= key == key.min(axis=1, keepdims=True)
        first, none = left.argmax(axis=1)[:, None], ~fine.any(axis=1)
        by_size = np.sort(np.where(fine, cw * (1 << 26) + ch, -1.0), axis=1)
        allowed = (by_size[:, :1] >= 0).sum(axis=1) + ((np.diff(by_size, axis=1) != 0) & (by_size[:, 1:] >= 0)).sum(axis=1)
        taken = {"width": np.take_along_axis(cw, first, 1)[:, 0], "height": np.take_along_axis(ch, first, 1)[:, 0], "allowed": allowed.astype(float)}
        return pd.DataFrame({k: pd.Series(np.where(none, np.nan, v)).astype("Int64") for k, v in taken.items()})

    best = chosen(width.cast("double"), height.cast("double"))
    return F.when(best["width"].isNotNull(), best)


def jittered(box: Box, noise: float, units: list[Column], width, height) -> Box:
    """A box whose sides are moved by up to ``noise`` of its width and height, by four numbers in [0, 1); clipped."""
    w, h = box[2] - box[0], box[3] - box[1]
    moved_by = [(2.0 * u - 1.0) * noise * side for u, side in zip(units, (w, h, w, h))]
    return clipped(tuple(v + d for v, d in zip(box, moved_by)), width, height)


def context_view(box: Box, proposal: Box, padding: Column, width: int, height: int, least: int = 4, aspect: float = 200.0) -> tuple[Box, Column]:
    """(crop, overlap): a crop about a proposal and the true box, with a margin, of a least size and a bounded aspect, so that
    it holds the true box; and the IoU of the two boxes."""
    both = (F.least(box[0], proposal[0]), F.least(box[1], proposal[1]), F.greatest(box[2], proposal[2]), F.greatest(box[3], proposal[3]))
    return bounded_aspect(least_size(margined(both, padding, width, height), least, width, height), aspect, width, height), iou(box, proposal)


def with_context_view(rows: DataFrame, box: Box, proposal: Box, padding: Column, width: int, height: int, names: list[str], least: int = 4, aspect: float = 200.0) -> tuple[DataFrame, Column]:
    """``rows`` with the crop of ``context_view`` in four columns ``names``, and the overlap: each step's sides are columns, so that no side is worked out again for every use."""
    steps = [f"_view_{k}" for k in range(4)]
    sides = lambda made: {n: v.cast("double") for n, v in zip(steps, made)}
    held = tuple(F.col(n) for n in steps)
    both = (F.least(box[0], proposal[0]), F.least(box[1], proposal[1]), F.greatest(box[2], proposal[2]), F.greatest(box[3], proposal[3]))
    rows = rows.withColumns(sides(both))
    rows = rows.withColumns(sides(margined(held, padding, width, height)))
    rows = rows.withColumns(sides(least_size(held, least, width, height)))
    return rows.withColumns(dict(zip(names, bounded_aspect(held, aspect, width, height)))).drop(*steps), iou(box, proposal)


def margined(box: Box, padding: Column, width: int, height: int) -> Box:
    """The box with a margin of a share of its sides, to whole pixels outwards, clipped."""
    mx, my = (box[2] - box[0]) * padding, (box[3] - box[1]) * padding
    return F.greatest(F.lit(0.0), F.floor(box[0] - mx)), F.greatest(F.lit(0.0), F.floor(box[1] - my)), F.least(F.lit(float(width)), F.ceil(box[2] + mx)), F.least(F.lit(float(height)), F.ceil(box[3] + my))


def padding_bucket(unit: Column, buckets: dict[str, tuple[float, float]]) -> Column:
    """struct(name, ratio) of one of some paddings {name: (weight, ratio)}, by a number in [0, 1)."""
    total, upto, out = sum(w for w, _ in buckets.values()), 0.0, None
    for name, (weight, ratio) in buckets.items():
        upto += weight / total
        one = F.struct(F.lit(name).alias("name"), F.lit(float(ratio)).alias("ratio"))
        out = F.when(unit < upto, one) if out is None else out.when(unit < upto, one)
    return out.otherwise(one)


STEPS = 48  # of a bisection


def padded_canvas(width: Column, height: Column, pads: tuple[Column, Column, Column, Column], most: int, factor: int = 32) -> Column:
    """struct(scale, width, height, left, top): the largest scale, to STEPS halvings, at which an image with margins (left,
    top, right, bottom, as shares of its sides), on a canvas of multiples of ``factor``, has ``most`` pixels at most."""
    w, h = width.cast("double"), height.cast("double")
    side = lambda v, scale, a, b: F.ceil(v * scale * (a + b + 1.0) / factor) * factor
    canvas = lambda scale: (side(w, scale, pads[0], pads[2]), side(h, scale, pads[1], pads[3]))

    @F.pandas_udf("double")
    def halved(w: pd.Series, h: pd.Series, left: pd.Series, top: pd.Series, right: pd.Series, bottom: pd.Series) -> pd.Series:
        """The scales of a batch of images, halved together."""
        w, h, left, top, right, bottom = (v.to_numpy(float) for v in (w, h, left, top, right, bottom))
        lo, hi = np.zeros(len(w)), np.ones(len(w))
        for _ in range(STEPS):
            mid = (lo + hi) / 2.0
            fits = np.ceil(w * mid * (left + right + 1.0) / factor) * factor * (np.ceil(h * mid * (top + bottom + 1.0) / factor) * factor) <= most
            lo, hi = np.where(fits, mid, lo), np.where(fits, hi, mid)
        return pd.Series(lo)

    cw, ch = canvas(F.lit(1.0))
    scale = F.when(cw * ch <= most, 1.0).otherwise(halved(w, h, *(p.cast("double") for p in pads)))
    return F.transform(F.array(scale), lambda s: F.struct(s.alias("scale"), canvas(s)[0].alias("width"), canvas(s)[1].alias("height"), F.floor(w * s * pads[0]).alias("left"), F.floor(h * s * pads[1]).alias("top")))[0]


def low_resolution(width: Column, height: Column, ratio: float, shortest: int, longest: int, chosen: Column, drawn: Column) -> Column:
    """struct(width, height) that an image is made small to, or null: a share ``ratio`` of images (those with ``chosen``, a number in [0, 1),
    below it), to a short side between two lengths, even on a scale of logarithms by ``drawn``; none that is short already."""
    short = F.rint(F.exp(F.lit(log(shortest)) + drawn * (log(longest) - log(shortest))))
    least = F.least(width, height).cast("double")
    side = lambda n: F.greatest(F.lit(4), F.rint(n * (short / least)).cast("int"))
    return F.when((chosen < ratio) & (least > short), F.struct(side(width).alias("width"), side(height).alias("height")))
