"""Embedding near-dedup by cross-polytope hashing after fast Hadamard rotations.

A hash function rotates a unit vector by three rounds of random signs and a Hadamard transform and takes the nearest
signed axis. A table joins ``per_table`` functions; ``tables`` tables, each probed also at the second-best axis of
every function, give buckets per label. All pairs of a bucket that reach the cosine threshold are verified in double
precision by blocked products; a pair is counted in the first table where its vectors meet, so nothing has to be
deduplicated and no pair leaves its task: a bucket returns link counts and a spanning forest of its links.

Equal vectors of a label go on as one with their multiplicity. Buckets are cut into tiles of about ``TILE`` by ``TILE``
vectors, spread over tasks; a task takes many buckets from one sorted stream, and buckets of one size share a product.
``per_table`` follows the size of the labels, so that a bucket holds about ``CROWD`` unrelated vectors at most;
``tables`` follows the recall that is asked for, by the rate at which the functions themselves bring pairs at the
threshold together at the vectors' width.

Nulls and odd input: vectors that are null, zero, or hold null or non-finite components, or whose label is null, link with
nothing and are their own component; vectors of other lengths link among their own length; rows that share a vec_id
are one vector for components, do not link with each other unless they are equal, and each counts its own links; a null vec_id links with nothing and has a null
component (kept); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photonlake.llm.common import keep, materialize, mix64, powers, BASE
from photonlake.llm.components import connected_components

#: Vectors a side of a tile, and unrelated vectors that a bucket is meant to hold at most.
TILE, CROWD = 1024, 512


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, orthonormal; the width is a power of two."""
    n, width = x.shape
    step = 1
    while step < width:
        y = x.reshape(n, width // (2 * step), 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, width)
        step *= 2
    return x / math.sqrt(width)


def signs(seed: int, width: int) -> np.ndarray:
    """Fixed random signs of one rotation round."""
    h = mix64(np.arange(width, dtype=np.uint64) + np.uint64(seed * 1_000_003 + 17))
    return np.where(h >> np.uint64(63) == 1, -1.0, 1.0)


def polytope_axes(x: np.ndarray, function: int) -> tuple[np.ndarray, np.ndarray]:
    """Nearest and second-nearest signed axis (2 * axis + sign) of every rotated row."""
    width = 1 << max(1, (x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), width))
    y[:, : x.shape[1]] = x
    for turn in range(3):
        y = hadamard(y * signs(3 * function + turn, width))
    size = np.abs(y)
    first = size.argmax(axis=1)
    pick = np.arange(len(y))
    code = lambda axis: 2 * axis + (y[pick, axis] < 0)
    best = code(first)
    size[pick, first] = -1.0
    return best, code(size.argmax(axis=1))


def probe_codes(x: np.ndarray, tables: int, per_table: int) -> np.ndarray:
    """(n, tables, 1 + per_table) bucket codes: the table's own, and one for each function moved to its second axis."""
    out = np.zeros((len(x), tables, 1 + per_table), dtype=np.uint64)
    weight = powers(BASE, per_table + 1)[1:]
    for t in range(tables):
        pairs = [polytope_axes(x, t * per_table + f) for f in range(per_table)]
        own = sum((p[0].astype(np.uint64) + np.uint64(1)) * w for p, w in zip(pairs, weight, strict=True))
        out[:, t, 0] = own
        for f, (best, second) in enumerate(pairs):
            out[:, t, 1 + f] = own + (second.astype(np.uint64) - best.astype(np.uint64)) * weight[f]
    return mix64(out)


def _lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, max(1, values.shape[1]), dtype=np.int32)), pa.array(values.reshape(-1)))


def unit_rows(flat: np.ndarray, n: int) -> np.ndarray:
    x = flat.reshape(n, -1).astype(np.float64)
    top = np.abs(x).max(axis=1, keepdims=True)
    x = x / np.where(top > 0, top, 1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


@functools.lru_cache(maxsize=64)
def meeting_rate(width: int, per_table: int, threshold: float, pairs: int = 1000, tables: int = 4) -> float:
    """Share of pairs at the threshold that a table brings together, over fixed random pairs of the width."""
    rng = np.random.default_rng(0)
    x, side = rng.normal(size=(pairs, width)), rng.normal(size=(pairs, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side -= (side * x).sum(axis=1, keepdims=True) * x
    side /= np.maximum(np.linalg.norm(side, axis=1, keepdims=True), 1e-300)
    a, b = (probe_codes(v, tables, per_table) for v in (x, threshold * x + math.sqrt(1 - threshold**2) * side))
    return float((a[:, :, :, None] == b[:, :, None, :]).any(axis=(2, 3)).mean())


def hash_shape(crowd: float, width: int, threshold: float, recall: float) -> tuple[int, int]:
    """(functions per table, tables) for labels of ``crowd`` vectors: the fewest functions that leave at most ``CROWD``
    unrelated vectors in a bucket, and enough tables for the recall of pairs right at the threshold."""
    axes = 2 << max(1, (width - 1).bit_length())
    per_table = next(k for k in itertools.count(1) if crowd * (1 + k) <= CROWD * float(axes) ** k)
    hit = min(max(meeting_rate(width, per_table, threshold), 1e-3), 1 - 1e-9)
    return per_table, max(2, math.ceil(math.log(1 - recall) / math.log(1 - hit)))


def link_tile(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs whose cosine reaches the threshold, for stacks of rows: the product in double precision, ties decided by
    compensated sums."""
    dots = x @ np.swapaxes(y, -1, -2)
    hit = dots >= threshold
    for at in zip(*np.nonzero(np.abs(dots - threshold) < 1e-12), strict=True):
        *stack, i, j = at
        hit[at] = math.fsum(x[(*stack, i)] * y[(*stack, j)]) >= threshold
    return hit


def least_reachable(n: int, a: np.ndarray, b: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 with links (a, b): the least value in each one's component."""
    order = np.argsort(value, kind="stable")
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.arange(n)
    a, b, low = rank[a], rank[b], np.arange(n)
    while True:
        least = np.minimum(low[a], low[b])
        new = low.copy()
        for ends in (a, b, low[a], low[b]):
            np.minimum.at(new, ends, least)
        new = new[new]
        if (new == low).all():
            return value[order][low[rank]]
        low = new


#: What a task sorts its tile members by; a change of any of them begins another tile.
TILE_KEY = ["label", "width", "t", "code", "i", "j"]


class TileLinks:
    """Verified links of whole tiles that follow one another in a sorted stream of members."""

    #: Members taken together, and products held at a time.
    MEMBERS, PRODUCTS = 8_192, 4_000_000

    def __init__(self, threshold: float, tables: int, item: str):
        self.threshold, self.tables, self.item = threshold, tables, np.dtype(item)

    def stream(self, batches):
        held: list[pa.Table] = []
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            if sum(t.num_rows for t in held) >= self.MEMBERS:
                table = pa.concat_tables(held).combine_chunks()
                done = int(self.begins(table)[-1])
                if done:
                    yield self.links(table.slice(0, done))
                held = [table.slice(done)]
        if sum(t.num_rows for t in held):
            yield self.links(pa.concat_tables(held).combine_chunks())

    @staticmethod
    def begins(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, dtype=bool)
        new[0] = True
        for c in TILE_KEY:
            v = table.column(c).combine_chunks().dictionary_encode()
            v = (v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v).indices.to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    def unit(self, column: pa.ChunkedArray) -> np.ndarray:
        size = pc.binary_length(column).to_numpy()
        flat = np.frombuffer(b"".join(column.to_pylist()), dtype=self.item)
        width = size // self.item.itemsize
        if (width == width[0]).all():
            return unit_rows(flat, len(width))
        out = np.zeros((len(width), int(width.max())))
        start = np.cumsum(width) - width
        for w in np.unique(width):
            rows = np.flatnonzero(width == w)
            out[rows, :w] = unit_rows(flat[start[rows][:, None] + np.arange(w)], len(rows))
        return out

    def hits(self, x: np.ndarray, begin: np.ndarray, size: np.ndarray, side: np.ndarray):
        """Members (p, q) of every linked pair, tile by tile; tiles of equal size without sides share one product."""
        halved = np.add.reduceat(side, begin) > 0
        p, q = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at, n in zip(begin[halved], size[halved], strict=True):
            rows = np.arange(at, at + n)
            a, b = rows[side[rows] == 0], rows[side[rows] == 1]
            if len(a) and len(b):
                i, j = np.nonzero(link_tile(x[a], x[b], self.threshold))
                p.append(a[i])
                q.append(b[j])
        for n in np.unique(size[~halved]):
            if n < 2:
                continue
            first = begin[~halved & (size == n)]
            step = max(1, self.PRODUCTS // int(n * n + n * x.shape[1]))
            upper = np.triu(np.ones((n, n), dtype=bool), 1)
            for s in range(0, len(first), step):
                rows = first[s : s + step, None] + np.arange(n)
                m, i, j = np.nonzero(link_tile(x[rows], x[rows], self.threshold) & upper)
                p.append(rows[m, i])
                q.append(rows[m, j])
        return np.concatenate(p), np.concatenate(q)

    def first_meeting(self, t, code, mine, other) -> np.ndarray:
        """Whether a pair meets nowhere before: in no earlier table, and at no smaller shared code of this one."""
        alike = mine[:, :, :, None] == other[:, :, None, :]
        earlier = (alike.any(axis=(2, 3)) & (np.arange(self.tables) < t[:, None])).any(axis=1)
        at = np.arange(len(t))
        shared = np.where(alike[at, t].any(axis=2), mine[at, t], np.iinfo(np.int64).max).min(axis=1)
        return ~earlier & (shared == code)

    def links(self, table: pa.Table) -> pa.RecordBatch:
        """(h1, h2, id, links, peer): the links first met here, and the least id of the member's component in the tile."""
        begin = self.begins(table)
        size = np.diff(np.append(begin, table.num_rows))
        t, code, side, ids, copies = (table.column(c).to_numpy() for c in ("t", "code", "side", "id", "copies"))
        codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), dtype=np.int64).reshape(table.num_rows, self.tables, -1)
        p, q = self.hits(self.unit(table.column("x")), begin, size, side)
        keep_ = ids[p] != ids[q]
        p, q = p[keep_], q[keep_]
        peer = least_reachable(len(ids), p, q, ids)
        links = np.zeros(len(ids), dtype=np.int64)
        for s in range(0, len(p), 65_536):
            a, b = p[s : s + 65_536], q[s : s + 65_536]
            one = self.first_meeting(t[a], code[a], codes[a], codes[b])
            np.add.at(links, a[one], copies[b[one]])
            np.add.at(links, b[one], copies[a[one]])
        some = (links > 0) | (peer != ids)
        named = {"h1": table.column("h1").to_numpy(), "h2": table.column("h2").to_numpy(), "id": ids, "links": links, "peer": peer}
        return pa.RecordBatch.from_arrays([pa.array(c[some]) for c in named.values()], list(named))


def near_links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, recall: float = 0.9995) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row."""
    single = vectors.schema[vector_col].dataType.elementType.typeName() == "float"
    item = "<f4" if single else "<f8"
    v = F.col(vector_col) if single else F.transform(F.col(vector_col), lambda c: c.cast("double"))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), v.alias("v"))
    rows = rows.withColumn("ok", F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & fine, F.lit(False)))
    rows = rows.withColumn("h1", F.when(F.col("ok"), F.xxhash64("label", "v"))).withColumn("h2", F.when(F.col("ok"), F.xxhash64(F.lit(7), "label", "v")))
    same = keep(rows.filter("ok").groupBy("h1", "h2").agg(F.first("label").alias("label"), F.min("id").alias("id"), F.count("*").alias("copies"), F.first("v").alias("vector")).withColumn("width", F.size("vector")))
    labels = same.groupBy("label").agg(F.count("*").cast("double").alias("n"), F.max("width").alias("w"))
    shape = labels.agg(F.sum("n").cast("long").alias("n"), (F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("crowd"), F.max("w").alias("w")).first()
    per_table, tables = hash_shape(shape["crowd"] or 1.0, shape["w"] or 2, threshold, recall)

    def hashed(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            widths = table.column("width").to_numpy()
            for w in np.unique(widths):
                part = table.filter(pa.array(widths == w)).combine_chunks()
                flat = part.column("vector").combine_chunks().flatten().to_numpy()
                codes = probe_codes(unit_rows(flat, part.num_rows), tables, per_table).view(np.int64).reshape(part.num_rows, -1)
                x = flat.astype(item).reshape(part.num_rows, -1)
                raw = lambda m: pa.array([r.tobytes() for r in m], pa.binary())
                for name, column in (("x", raw(x)), ("codes", raw(codes)), ("at", _lists(codes))):
                    part = part.append_column(name, column)
                yield from part.drop_columns(["vector"]).to_batches()

    coded = keep(same.select("label", "width", "h1", "h2", "id", "copies", "vector").mapInArrow(hashed, "label string, width int, h1 long, h2 long, id long, copies long, x binary, codes binary, at array<long>"))
    entries = coded.select("label", "width", "h1", "h2", F.posexplode("at").alias("at", "code")).select("label", "width", F.floor(F.col("at") / (1 + per_table)).cast("int").alias("t"), "code", "h1", "h2")
    bucket = ["label", "width", "t", "code"]
    sizes = entries.groupBy(*bucket).agg(F.count("*").alias("n")).filter("n > 1").withColumn("n_tiles", F.ceil(F.col("n") / TILE).cast("int"))
    placed = entries.join(sizes.drop("n"), bucket).withColumn("own", F.pmod("h2", F.col("n_tiles")).cast("int"))
    tiles = placed.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n_tiles") - 1)))
    tiles = tiles.select(*bucket, "h1", "h2", F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j"), F.when(F.col("own") > F.col("k"), 1).otherwise(0).alias("side"))
    parts = tiles.join(coded.drop("at", "label", "width"), ["h1", "h2"]).select(*TILE_KEY, "side", "h1", "h2", "id", "copies", "codes", "x")
    work = TileLinks(threshold, tables, item)
    found = keep(parts.repartition(*TILE_KEY).sortWithinPartitions(*TILE_KEY).mapInArrow(work.stream, "h1 long, h2 long, id long, links long, peer long"))
    edges = materialize(found.filter("peer <> id").select(F.col("id").alias("a"), F.col("peer").alias("b")).distinct(), "vector-links")
    counted = found.groupBy("h1", "h2").agg(F.sum("links").alias("links"))
    comp = connected_components(edges)
    named = same.join(counted, ["h1", "h2"], "left").join(comp, F.col("id") == comp["node"], "left").select("h1", "h2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = rows.drop("v").join(named, ["h1", "h2"], "left").select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op7_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
