"""The filter language: one value of conditions, compiled to a column and semi-joins.

Every condition is off at its zero value; what is on is joined by AND. Plain conditions stay one expression that
reaches the scan; memberships (tag, person, stars) are semi-joins on the side tables.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photonlake.functions.paths import below_dirs
from photonlake.functions.text import contains_literal
from photonlake.functions.times import year_start
from photonlake.schemas import SOURCE_CAMERA, SOURCE_MEME, SOURCE_SAVED


@dataclass(frozen=True)
class Filter:
    min_overall: float = 0
    min_technical: float = 0
    min_focus: float = 0
    min_exposure: float = 0
    min_aesthetic: float = 0
    max_cast: float = 0
    max_noise: float = 0
    max_blockiness: float = 0
    camera: str = ""
    lens: str = ""
    path_contains: str = ""
    tag: str = ""
    person_id: int = 0
    faces: str = ""  # any, none, 1, group (3 or more)
    mono: str = ""  # only, exclude
    source: str = ""  # photos (no memes), camera, saved, memes
    starred: bool = False
    starred_by: int = 0
    time_from: int = 0  # seconds, inclusive
    time_to: int = 0  # seconds, exclusive
    year: int = 0
    year_from: int = 0
    year_to: int = 0
    dirs: tuple[str, ...] = ()
    sort: str = "overall"
    limit: int = 200
    offset: int = 0
    stacked: bool = False

    def __post_init__(self):
        for f in fields(self):
            v = getattr(self, f.name)
            if isinstance(v, float) and not math.isfinite(v):
                raise ValueError(f"{f.name} must be a finite number")

    def years(self) -> tuple[int, int]:
        """Inclusive years, 0 for no bound; a reversed pair is read the way it was meant."""
        if self.year:
            return self.year, self.year
        if self.year_from and self.year_to:
            return min(self.year_from, self.year_to), max(self.year_from, self.year_to)
        return self.year_from, self.year_to

    def predicate(self) -> Column | None:
        """The conditions on the photo's own columns, or None."""
        terms: list[Column] = []
        for name, column in (("min_overall", "overall"), ("min_technical", "technical"), ("min_focus", "focus_score"), ("min_exposure", "exposure_score"), ("min_aesthetic", "aesthetic")):
            if getattr(self, name) > 0:
                terms.append(F.col(column) >= getattr(self, name))
        if self.max_cast > 0:
            terms.append((F.col("cast_strength") <= self.max_cast) | F.col("monochrome"))
        for name, column in (("max_blockiness", "blockiness"), ("max_noise", "noise")):
            if getattr(self, name) > 0:
                terms.append(F.col(column) <= getattr(self, name))
        if self.camera:
            terms.append(contains_literal(F.concat("camera_make", F.lit(" "), "camera_model"), self.camera))
        if self.lens:
            terms.append(contains_literal(F.col("lens"), self.lens))
        if self.path_contains:
            terms.append(contains_literal(F.col("path"), self.path_contains))
        n = F.col("face_count") if self.faces else None
        if self.faces:
            terms.append({"any": n > 0, "none": n == 0, "1": n == 1, "group": n >= 3}[self.faces] if self.faces in ("any", "none", "1", "group") else F.lit(True))
        if self.mono:
            terms.append({"only": F.col("monochrome"), "exclude": ~F.col("monochrome")}.get(self.mono, F.lit(True)))
        if self.source:
            s = F.col("source")
            terms.append({"photos": s != SOURCE_MEME, "camera": s == SOURCE_CAMERA, "saved": s == SOURCE_SAVED, "memes": s == SOURCE_MEME}.get(self.source, F.lit(True)))
        if self.time_from:
            terms.append(F.col("taken_at") >= self.time_from)
        if self.time_to:
            terms.append(F.col("taken_at") < self.time_to)
        if self.dirs:
            terms.append(below_dirs(F.col("path"), list(self.dirs)))
        low, high = self.years()
        if low:
            terms.append(F.col("taken_at") >= year_start(low))
        if high:
            terms.append(F.col("taken_at") < year_start(high + 1))
        if low or high:
            terms.append(F.col("taken_at") != 0)
        out = None
        for t in terms:
            out = t if out is None else out & t
        return out

    def restricts(self) -> bool:
        """Is any condition on?"""
        plain = Filter(sort=self.sort, limit=self.limit, offset=self.offset, stacked=self.stacked, starred_by=self.starred_by)
        return self != plain

    def narrows(self) -> bool:
        """Is any condition on besides leaving memes out and the choice of folders?"""
        return replace(self, source="" if self.source == "photos" else self.source, dirs=()).restricts()


@dataclass
class Related:
    """Side tables that memberships look in."""

    tags: DataFrame | None = None
    faces: DataFrame | None = None
    stars: DataFrame | None = None
    cached: dict = field(default_factory=dict)


def apply_filter(photos: DataFrame, f: Filter, related: Related | None = None) -> DataFrame:
    """Photos that satisfy f (without order, page or stacking)."""
    related = related or Related()
    term = f.predicate()
    out = photos.filter(term) if term is not None else photos
    members = []
    if f.tag:
        members.append(related.tags.filter(F.col("tag") == f.tag))
    if f.person_id > 0:
        members.append(related.faces.filter(F.col("person_id") == f.person_id))
    if f.starred:
        members.append(related.stars.filter(F.col("user_id") == f.starred_by))
    for side in members:
        out = out.join(side.select(F.col("photo_id").alias("id")), "id", "left_semi")
    return out


def matching_ids(photos: DataFrame, ids: DataFrame, f: Filter, related: Related | None = None) -> DataFrame:
    """Which of ids (id) satisfy f."""
    return apply_filter(photos.join(ids.select("id"), "id", "left_semi"), f, related).select("id")


def visible_frames(matched: DataFrame) -> DataFrame:
    """Hide the lower frames of stacks whose top is among the matched photos themselves."""
    tops = matched.select(F.col("id").alias("stack_top"))
    shown = matched.filter(~F.coalesce(F.col("stacked"), F.lit(False)))
    return shown.unionByName(matched.filter(F.col("stacked")).join(tops, "stack_top", "left_anti").select(*matched.columns))


def filter_count(photos: DataFrame, f: Filter, related: Related | None = None) -> DataFrame:
    return apply_filter(photos, f, related).agg(F.count("*").alias("n"))


def discover_eligible(faces: DataFrame) -> DataFrame:
    """Unnamed faces that are large, certain and not turned away."""
    return faces.filter(F.col("person_id").isNull() & (F.col("width_px") >= 60) & (F.col("score") >= 0.7) & (F.abs("yaw") < 0.6))


def auto_label_eligible(faces: DataFrame) -> DataFrame:
    """Faces that no one named by hand."""
    return faces.filter(~F.col("person_source").eqNullSafe(F.lit("manual")))
