"""Folder paths: a path that starts with / has / as its only separator, any other has / and backslash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Application packages and the folders in them that hold originals; folders that are always caches.
APP_PACKAGES = {".photoslibrary": ("originals", "masters"), ".photolibrary": ("masters", "originals"), ".aplibrary": ("masters",), ".cocatalog": ("originals",)}
CACHE_FOLDERS = ("captureone",)
UUID = r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}"


def is_unix(p: Column) -> Column:
    return F.startswith(p, F.lit("/"))


def trim_dir(p: Column) -> Column:
    """Without separators at its end; the root stays."""
    bare = F.when(is_unix(p), F.regexp_replace(p, "/+$", "")).otherwise(F.regexp_replace(p, r"[/\\]+$", ""))
    return F.when((bare == "") & (p != ""), "/").otherwise(bare)


def parent_dir(p: Column) -> Column:
    """The folder that holds p: / below the root, empty at the top."""
    unix = F.when(p == "/", "").when(F.expr("true") & F.regexp_like(p, F.lit("^/[^/]*$")), "/").otherwise(F.regexp_replace(p, "/[^/]*$", ""))
    other = F.when(F.regexp_like(p, F.lit(r"[/\\]")), F.regexp_replace(p, r"[/\\][^/\\]*$", "")).otherwise("")
    return F.when(is_unix(p), unix).otherwise(other)


def folder_name(p: Column) -> Column:
    """The last part of the path; the path itself when it has none."""
    last = F.when(is_unix(p), F.regexp_extract(p, "/([^/]+)$", 1)).otherwise(F.regexp_extract(p, r"[/\\]([^/\\]+)$", 1))
    return F.when(last == "", p).otherwise(last)


def in_dir(p: Column, folder: Column) -> Column:
    """Is p the folder, or below it?"""
    d = trim_dir(folder)
    after = F.substr(p, F.length(d) + 1, F.lit(1))
    below = F.startswith(p, d) & F.when(is_unix(d), after == "/").otherwise(after.isin("/", "\\"))
    return F.when(d == "/", is_unix(p)).otherwise((p == d) | below)


def dir_ranges(folder: str) -> list[tuple[str, str]]:
    """Byte ranges [low, high) of the paths below a folder: what Parquet statistics can prune by."""
    unix = folder.startswith("/")
    bare = folder.rstrip("/") if unix else folder.rstrip("/\\")
    out = [(bare + "/", bare + "0")]
    if not unix:
        out.append((bare + "\\", bare + "]"))
    return out


def below_dirs(p: Column, folders: list[str]) -> Column:
    out = F.lit(False)
    for folder in folders:
        for low, high in dir_ranges(folder):
            out = out | ((p >= low) & (p < high))
    return out


def ancestors(p: Column) -> Column:
    """Every folder above p from the top down: / first for a Unix path; the parts of a Windows one joined by backslashes."""
    unix = F.split(p, "/")
    steps = F.slice(F.transform(unix, lambda _, i: F.when(i == 0, "/").otherwise(F.array_join(F.slice(unix, 1, i + 1), "/"))), 1, F.size(unix) - 1)
    other = F.split(p, r"[/\\]")
    plain = F.slice(F.transform(other, lambda _, i: F.substr(p, F.lit(1), F.aggregate(F.slice(other, 1, i + 1), F.lit(0), lambda a, x: a + F.length(x) + 1) - 1)), 1, F.size(other) - 1)
    return F.when(is_unix(p), steps).otherwise(plain)


def child_of(p: Column, parent: str) -> Column:
    """The folder right below ``parent`` that p goes through; null when p is directly in it or elsewhere."""
    prefix = parent.rstrip("/") + "/"
    rest = F.substr(p, F.lit(len(prefix) + 1))
    return F.when(F.startswith(p, F.lit(prefix)) & F.contains(rest, F.lit("/")), F.substring_index(rest, "/", 1))


def library_parts(p: Column) -> Column:
    """struct(lib, rest) of a path in a photo library package; both empty elsewhere."""
    at = F.locate(".photoslibrary", F.lower(p))
    end = at + F.lit(len(".photoslibrary"))
    inside = (at > 0) & F.substr(p, end, F.lit(1)).isin("/", "\\")
    return F.struct(F.when(inside, F.substr(p, F.lit(1), end - 1)).otherwise("").alias("lib"), F.when(inside, F.substr(p, end + 1)).otherwise("").alias("rest"))


def is_library_original(rest: Column) -> Column:
    return F.lower(F.regexp_extract(rest, r"^[^/\\]*", 0)).isin("originals", "masters")


def original_uuid(p: Column) -> Column:
    """The UUID that a file name starts with, upper-case; empty when none."""
    return F.upper(F.regexp_extract(folder_name(p), UUID, 0))


def in_app_cache(p: Column) -> Column:
    """Does some level of the path lie where an application keeps its own files?"""
    parts = F.filter(F.split(F.lower(p), r"[/\\]"), lambda x: x != "")
    cache = F.exists(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda x: x.isin(*CACHE_FOLDERS))
    pairs = F.zip_with(parts, F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def forbidden(x: Column) -> Column:
        out = F.lit(False)
        for ext, allowed in APP_PACKAGES.items():
            out = out | (F.endswith(x["a"], F.lit(ext)) & x["b"].isNotNull() & ~x["b"].isin(*allowed))
        return out

    return cache | F.exists(pairs, lambda x: F.coalesce(forbidden(x), F.lit(False)))


#: Folders that a directory walk leaves out.
SYSTEM_FOLDERS = ("@eaDir", "#recycle", "#snapshot", "$RECYCLE.BIN", "System Volume Information", "node_modules", "lost+found")


def excluded(p: Column, patterns: list[str] = ()) -> Column:
    """File paths that a walk skips: below hidden or system folders, preview and no-index packages, resource forks, app
    caches, and the caller's patterns (one with * or ? is matched against each part, others are substrings)."""
    names = "|".join(s.replace("$", r"\$").replace("+", r"\+") for s in SYSTEM_FOLDERS)
    folder = rf"(?:^|[/\\])(?:\.[^/\\]+|{names}|[^/\\]*\.lrdata|[^/\\]*\.noindex)[/\\]"
    out = F.regexp_like(p, F.lit(folder)) | F.regexp_like(p, F.lit(r"(?:^|[/\\])\._[^/\\]*$")) | in_app_cache(p)
    for pattern in patterns:
        if "*" in pattern or "?" in pattern:
            body = "".join({"*": r"[^/\\]*", "?": r"[^/\\]"}.get(c, c if c.isalnum() else "\\" + c) for c in pattern)
            out = out | F.regexp_like(p, F.lit(rf"(?:^|[/\\]){body}(?:[/\\]|$)"))
        else:
            out = out | F.contains(p, F.lit(pattern))
    return out
