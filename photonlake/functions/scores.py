"""Per-photo scores as plain column expressions."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp01(v: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))


def round_to(v: Column, digits: int) -> Column:
    """Half away from zero on the binary value."""
    return F.round(v * 10**digits) / 10**digits


def ramp(v: Column, low: float, high: float) -> Column:
    return clamp01((v - low) / (high - low)) if high != low else F.lit(0.0)


def focus_score(ratio: Column) -> Column:
    return ramp(F.log(ratio + 1e-6), math.log(0.015), math.log(0.25))


def exposure_score(brightness: Column, highlights: Column, shadows: Column, dynamic_range: Column) -> Column:
    lost = 4 * F.greatest(F.lit(0.0), highlights - 0.01) + 2 * F.greatest(F.lit(0.0), shadows - 0.04)
    dim = F.greatest(F.lit(0.0), 0.25 - brightness) * 4 + F.greatest(F.lit(0.0), brightness - 0.75) * 4
    return clamp01(1 - lost - dim - F.greatest(F.lit(0.0), 0.5 - dynamic_range) * 0.8)


def color_score(cast_strength: Column, monochrome: Column) -> Column:
    return F.when(monochrome, 1.0).otherwise(1 - ramp(cast_strength, 3, 12))


def noise_score(noise: Column) -> Column:
    return 1 - ramp(noise, 1.5, 7)


def cast_label(a: Column, b: Column, strength: Column) -> Column:
    angle = F.degrees(F.atan2(b, a))
    return F.when(strength < 3, "neutral").when((angle >= 45) & (angle < 135), "warm/yellow").when((angle >= -45) & (angle < 45), "magenta").when((angle >= -135) & (angle < -45), "cool/blue").otherwise("green")


def face_focus_score(variance: Column, low: float = 20.0, high: float = 250.0) -> Column:
    return ramp(F.log10(1 + variance), math.log10(1 + low), math.log10(1 + high))


def technical(rating: Column, exposure: Column, color: Column, blockiness: Column) -> Column:
    """The rating with mild penalties for exposure, colour cast and compression."""
    return rating * (1 - 0.1 * (1 - exposure)) * (1 - 0.1 * (1 - color)) * (1 - 0.2 * clamp01((blockiness - 1.15) / 0.85))


def aesthetic_percent(rating: Column) -> Column:
    return clamp01((rating - 3) / 5) * 100


def overall(tech: Column, aesthetic: Column) -> Column:
    return F.when(aesthetic.isNull(), tech).otherwise(round_to(0.5 * tech + 0.5 * aesthetic_percent(aesthetic), 1))


def blended_focus(photo_focus: Column, face_focus: Column, face_share: Column, face_px: Column) -> Column:
    """A prominent face (6 % of the width, 48 pixels) decides most of the focus score."""
    return F.when((face_share >= 0.06) & (face_px >= 48), 0.7 * face_focus + 0.3 * photo_focus).otherwise(photo_focus)


def badges(focus: Column, exposure: Column, color: Column, monochrome: Column, blockiness: Column) -> Column:
    """Quality remarks in a fixed order."""
    return F.array_compact(
        F.array(
            F.when(focus < 0.3, "soft"),
            F.when(exposure < 0.5, "exposure"),
            F.when((color < 0.1) & ~monochrome, "cast"),
            F.when(blockiness > 1.5, "jpeg"),
        )
    )


#: Thresholds behind the names of the filter form.
FORM_PRESETS = {"focus": {"fair": 0.45, "good": 0.7, "sharp": 0.85}, "exposure": {"fair": 0.5, "good": 0.8}, "cast": {"mild": 6.0, "none": 3.0}}


def inspect_warnings(camera: Column, taken_at: Column, lens: Column, preview_px: Column, width: Column, height: Column, shown_w: Column, shown_h: Column, rotated: Column) -> Column:
    """What looks wrong with a decoded photo."""
    ratio = (width / height) / (shown_w / shown_h)
    off = F.greatest(ratio, 1 / ratio)
    return F.array_compact(
        F.array(
            F.when(F.coalesce(camera, F.lit("")) == "", "no camera"),
            F.when(F.coalesce(taken_at, F.lit(0)) == 0, "no capture time"),
            F.when(F.coalesce(lens, F.lit("")) == "", "no lens"),
            F.when(preview_px < 1000, "small preview"),
            F.when((off > 1.05) & ~rotated, "aspect ratio differs"),
            F.when(rotated, "rotated"),
        )
    )


@dataclass(frozen=True)
class RatingModel:
    """Quadratic rating: log of some features, standardise, monomials up to degree 2, standardise, weigh, clip."""

    features: list[str]
    log_features: list[str]
    mean1: list[float]
    scale1: list[float]
    powers: list[list[float]]
    mean2: list[float]
    scale2: list[float]
    coef: list[float]
    intercept: float

    @classmethod
    def load(cls, text: str) -> RatingModel:
        return cls(**json.loads(text))

    def column(self) -> Column:
        x = [((F.log1p(F.col(f)) if f in self.log_features else F.col(f)) - m) / s for f, m, s in zip(self.features, self.mean1, self.scale1, strict=True)]
        total = F.lit(self.intercept)
        for power, mean, scale, weight in zip(self.powers, self.mean2, self.scale2, self.coef, strict=True):
            term = F.lit(1.0)
            for value, p in zip(x, power, strict=True):
                for _ in range(int(p)):
                    term = term * value
            total = total + weight * (term - mean) / scale
        return 100 * clamp01(total)
