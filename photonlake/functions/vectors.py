"""Vectors: products, int8 quantisation, half floats, perceptual hashes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row: inside a lambda an outer expression would be computed per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, summed from the first component on."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalise(a: Column) -> Column:
    return bind(norm(a), lambda n: F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double"))))


def quantise(a: Column) -> Column:
    """struct(q array<int>, scale): symmetric int8 steps of max / 127, halves away from zero; a zero vector has scale 0."""

    def steps(top: Column) -> Column:
        q = F.when(top > 0, F.transform(a, lambda x: F.round(x.cast("double") * (F.lit(127.0) / top)).cast("int"))).otherwise(F.transform(a, lambda x: F.lit(0)))
        return F.struct(q.alias("q"), F.when(top > 0, top / 127.0).otherwise(0.0).alias("scale"))

    return bind(F.array_max(F.transform(a, lambda x: F.abs(x.cast("double")))), steps)


def dot_quantised(a: Column, b: Column) -> Column:
    """Approximate inner product of two quantised structs."""
    whole = F.aggregate(F.zip_with(a["q"], b["q"], lambda x, y: (x * y).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return whole * a["scale"] * b["scale"]


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def median_hash(a: Column) -> Column:
    """64 bits, first component first: is the component above the median of all?"""
    n = F.size(a)
    ordered = F.array_sort(F.transform(a, lambda x: x.cast("double")))
    median = bind(ordered, lambda o: (F.element_at(o, F.floor((n + 1) / 2).cast("int")) + F.element_at(o, (F.floor(n / 2) + 1).cast("int"))) / 2)
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    return bind(median, lambda m: F.aggregate(a, zero, lambda s, x: F.shiftleft(s, 1).bitwiseOR(F.when(x.cast("double") > m, one).otherwise(zero))))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_half(blobs: pd.Series) -> pd.Series:
    """Little-endian half floats to vectors."""
    return blobs.map(lambda b: np.frombuffer(b, dtype="<f2").astype("float32"), na_action="ignore")


def encode_half_array(v: np.ndarray) -> bytes:
    """Half floats with ties rounded up in magnitude; values beyond the range become infinite."""
    x = np.asarray(v, dtype=np.float32)
    half = x.astype(np.float16)
    up = np.nextafter(half, np.where(x < 0, -np.inf, np.inf).astype(np.float16))
    tie = (np.abs(x) > np.abs(half.astype(np.float32))) & (np.abs(x.astype(np.float64)) - np.abs(half.astype(np.float64)) == np.abs(up.astype(np.float64)) - np.abs(x.astype(np.float64)))
    return np.where(tie, up, half).astype("<f2").tobytes()


@F.pandas_udf(T.BinaryType())
def encode_half(vectors: pd.Series) -> pd.Series:
    return vectors.map(encode_half_array, na_action="ignore")
