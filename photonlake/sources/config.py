"""Driver-side sources: categories, settings and the screenshot list of a photo library."""

from __future__ import annotations

import sqlite3
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession


def parse_categories(text: str) -> list[tuple[str, str]]:
    """(category, prompt) of lines ``name: prompt | prompt``; blank lines and # comments are left out. A line of another
    form is an error that names its number: a category is never dropped silently."""
    out, bad = [], []
    for n, line in enumerate(text.splitlines(), 1):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        name, colon, rest = line.partition(":")
        prompts = [p.strip() for p in rest.split("|") if p.strip()]
        if not colon or not name.strip() or not prompts:
            bad.append(f"line {n}: {line!r}")
            continue
        out += [(name.strip(), p) for p in prompts]
    if bad:
        raise ValueError("categories: each line must be `name: prompt | prompt`; fix " + ", ".join(bad))
    if not out:
        raise ValueError("categories: none defined")
    return out


def categories_frame(spark: SparkSession, text: str) -> DataFrame:
    rows = [(i, name, prompt) for i, (name, prompt) in enumerate(parse_categories(text))]
    return spark.createDataFrame(rows, "prompt int, name string, text string")


@dataclass(frozen=True)
class Settings:
    """Grouping settings with their ranges; values outside fall back to the default."""

    stacking: bool = True
    burst_gap: int = 3  # seconds, 1 to 60
    stack_hamming: int = 10  # bits, 0 to 16
    scene_gap: int = 10  # minutes, 0 to 120

    RANGES = {"burst_gap": (1, 60), "stack_hamming": (0, 16), "scene_gap": (0, 120)}

    @classmethod
    def read(cls, meta: dict[str, str]) -> Settings:
        got = {}
        for f in fields(cls):
            raw = meta.get(f.name)
            if raw is None:
                continue
            if f.name == "stacking":
                got[f.name] = raw not in ("0", "false", "off")
                continue
            low, high = cls.RANGES[f.name]
            if raw.lstrip("-").isdigit() and low <= int(raw) <= high:
                got[f.name] = int(raw)
        return cls(**got)


def library_screenshots(path: str) -> list[str]:
    """Relative paths of the screenshots in a photo library's SQLite database, opened read-only; a database without the
    expected table or columns has none."""
    db = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    try:
        tables = {r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}
        table = next((t for t in ("ZASSET", "ZGENERICASSET") if t in tables), None)
        columns = {r[1] for r in db.execute(f"PRAGMA table_info({table})")} if table else set()
        if not {"ZDIRECTORY", "ZFILENAME", "ZISDETECTEDSCREENSHOT"} <= columns:
            return []
        live = " AND coalesce(ZTRASHEDSTATE, 0) = 0" if "ZTRASHEDSTATE" in columns else ""
        rows = db.execute(f"SELECT ZDIRECTORY, ZFILENAME FROM {table} WHERE ZISDETECTEDSCREENSHOT = 1 AND ZFILENAME IS NOT NULL{live}")
        return [f"{d}/{f}" if d else f for d, f in rows]
    finally:
        db.close()
