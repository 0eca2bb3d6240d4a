"""Text functions that follow byte collation and ASCII-only case folding."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ASCII_LOWER = str.maketrans(UPPER, LOWER)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; other letters keep their case."""
    return F.translate(c, UPPER, LOWER)


def contains_literal(c: Column, needle: str) -> Column:
    """Substring test, ASCII case-insensitive; nothing in ``needle`` is a wildcard. Null text gives null."""
    return F.contains(ascii_lower(c), F.lit(needle.translate(_ASCII_LOWER)))


def like_pattern(needle: str) -> str:
    """``needle`` as a LIKE pattern for a substring, with backslash as the escape."""
    return "%" + re.sub(r"([\\%_])", r"\\\1", needle) + "%"


def unicode_spellings(prefix: str) -> list[str]:
    """The prefix as given, composed and decomposed, without repeats."""
    return list(dict.fromkeys([prefix, unicodedata.normalize("NFC", prefix), unicodedata.normalize("NFD", prefix)]))


def starts_with_any_spelling(c: Column, prefix: str) -> Column:
    spellings = [F.startswith(c, F.lit(p)) for p in unicode_spellings(prefix)]
    out = spellings[0]
    for more in spellings[1:]:
        out = out | more
    return out


def same_name(a: Column, b: Column) -> Column:
    """ASCII case-insensitive equality, as people are looked up."""
    return ascii_lower(a) == ascii_lower(b)


def collapse_blanks(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def model_slug(c: Column) -> Column:
    """A model name: lower-case letters, digits, dots and dashes, none of the last two at the ends, 40 characters at most."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9.-]+", "-"), r"^[-.]+|[-.]+$", "")
    return F.regexp_replace(F.substring(plain, 1, 40), r"[-.]+$", "")


def camera_label(make: Column, model: Column) -> Column:
    """Make and model in one, blanks trimmed; a missing part is left out."""
    return F.trim(F.concat(F.coalesce(make, F.lit("")), F.lit(" "), F.coalesce(model, F.lit(""))))


@F.pandas_udf(T.StringType())
def name_key(names: pd.Series) -> pd.Series:
    """Key under which account names are unique: NFKC, then case folding."""
    return names.map(lambda s: None if s is None else unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", s).casefold()), na_action="ignore")


#: Latin ligatures and digraphs that caption cleaning spells out.
LIGATURES = {
    "\u0132": "IJ", "\u0133": "ij", "\u0149": "\u02bcn", "\u01c4": "D\u017d", "\u01c5": "D\u017e", "\u01c6": "d\u017e", "\u01c7": "LJ", "\u01c8": "Lj", "\u01c9": "lj", "\u01ca": "NJ", "\u01cb": "Nj", "\u01cc": "nj",
    "\u01f1": "DZ", "\u01f2": "Dz", "\u01f3": "dz", "\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl", "\ufb05": "\u017ft", "\ufb06": "st",
}


def repair_mojibake(s: str) -> str:
    """Undo one reading of UTF-8 as Windows-1252 or Latin-1: when every letter is one such byte and the bytes are UTF-8."""
    raw = bytearray()
    for ch in s:
        if ord(ch) < 256:
            raw.append(ord(ch))
            continue
        try:
            raw += ch.encode("cp1252")
        except UnicodeEncodeError:
            return s
    if raw.isascii():
        return s
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return s


def _plain(ch: str) -> str:
    """Straight quotes, ligatures spelled out, full- and half-width forms folded."""
    if "\u2018" <= ch <= "\u201b" or ch == "\u02bc":
        return "'"
    if "\u201c" <= ch <= "\u201f":
        return '"'
    if "\uff01" <= ch <= "\uffee" or ch == "\u3000":
        return unicodedata.normalize("NFKC", ch)
    return LIGATURES.get(ch, ch)


def clean_caption(s: str) -> str:
    """Text as a caption tokenizer reads it: repaired, plain letters, composed, HTML unescaped twice, blanks collapsed, lower-case."""
    s = unicodedata.normalize("NFC", "".join(map(_plain, repair_mojibake(s))))
    return " ".join(html.unescape(html.unescape(s)).split()).lower()


@F.pandas_udf(T.StringType())
def clean_text(texts: pd.Series) -> pd.Series:
    return texts.map(clean_caption, na_action="ignore")
