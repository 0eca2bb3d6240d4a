"""MinHash near-dedup with DartMinHash signatures.

A document is the multiset of its five-word shingles; a shingle's weight is how often it stands in the text. Every
unit of weight of a shingle is a cell of a fixed random dart process: darts arrive at hashed, exponentially spaced
ranks, each aimed at a hashed coordinate, and a signature keeps at every coordinate the earliest dart that the
document's cells receive. The rank bound of a document is inverse to its weight, so that some k ln k + k darts fill
its k coordinates whatever its length; documents with an empty coordinate throw again with twice the bound.
Two signatures agree at a coordinate with the probability of their weighted Jaccard similarity.

Texts with equal words form one class and go on as one. Bands of the signature give buckets, whose members are verified
exactly against the bucket's hub. In the groups of hubs that still hold several components, members of different
components are then tested against each other in place, tile by tile, so no link of a bucket is lost and no
table of pairs is made.

Nulls and odd input: texts without words (null, empty, blanks) have equal words and are one class; one of fewer than
five words is one shingle; rows that share a doc_id are one document for linking and are all returned; a null doc_id is
classed by equal words only; an empty table gives an empty result; other columns pass through ``dedup``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from photonlake.llm.common import BASE, keep, materialize, mix64, powers, span_hashes, text_buffers, text_slices, word_spans
from photonlake.llm.components import connected_components

WORDS, THRESHOLD = 5, 0.8
#: 18 bands of 5: a pair of similarity 0.8 meets in some band with probability 0.9992.
BANDS, ROWS = 18, 5
#: Members of a hub's group that are tested against each other in one task.
TILE = 512


def shingles(raw: np.ndarray, offsets: np.ndarray, size: int = WORDS):
    """(row, hash) of every shingle, with the (n, 2) hashes of each row's word sequence and its number of words."""
    starts, ends, first = word_spans(raw, offsets)
    n_words = np.diff(first)
    words = span_hashes(raw, starts, ends)
    whole = np.stack([span_hashes(words, first[:-1], first[1:]), span_hashes(mix64(words ^ BASE), first[:-1], first[1:])], axis=1)
    count = np.where(n_words == 0, 0, np.maximum(n_words - size + 1, 1))
    rows = np.repeat(np.arange(len(count)), count)
    at = np.arange(len(rows)) - np.repeat(np.concatenate([[0], np.cumsum(count)])[:-1], count) + first[rows]
    stop = first[rows + 1]
    factor = powers(BASE, size)
    out = np.zeros(len(rows), dtype=np.uint64)
    for k in range(size):
        inside = at + k < stop
        out[inside] += words[at[inside] + k] * factor[k] + np.uint64(k)
    return rows, mix64(out), whole, n_words


def multiset(rows: np.ndarray, hashes: np.ndarray):
    """Distinct (row, hash) in order, with how often each occurs."""
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    return rows[at], hashes[at], np.diff(np.append(at, len(rows)))


def unit_cells(rows: np.ndarray, hashes: np.ndarray, weights: np.ndarray):
    """(row, cell, share) for each unit of weight; the last unit of a fractional weight has a share below 1."""
    units = np.ceil(weights).astype(np.int64)
    row, of = np.repeat(rows, units), np.repeat(np.arange(len(units)), units)
    unit = np.arange(len(of)) - np.repeat(np.cumsum(units) - units, units)
    return row, mix64(hashes[of] + unit.astype(np.uint64) * BASE), np.minimum(weights[of] - unit, 1.0)


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def dart_signatures(n_rows: int, rows: np.ndarray, cells: np.ndarray, share: np.ndarray, k: int) -> np.ndarray:
    """(n_rows, k) signatures; rows without cells stay 0."""
    out = np.zeros((n_rows, k), dtype=np.uint64)
    norm = np.bincount(rows, weights=share, minlength=n_rows)
    bound = np.divide(k * np.log(k) + k, norm, out=np.zeros(n_rows), where=norm > 0)
    todo = norm > 0
    while todo.any():
        use = np.flatnonzero(todo[rows])
        key, rank, dart = [], [], []
        r, cell, limit, of, part = np.zeros(len(use)), cells[use], bound[rows[use]], rows[use], share[use]
        throw = 0
        while len(r):
            r = r - np.log(_uniform(mix64(cell + np.uint64((2 * throw + 1) * int(BASE) % (1 << 64)))))
            live = r <= limit
            r, cell, limit, of, part = r[live], cell[live], limit[live], of[live], part[live]
            h = mix64(cell ^ np.uint64((2 * throw + 2) * int(BASE) % (1 << 64)))
            hit = part >= 1.0
            if not hit.all():
                hit |= _uniform(mix64(h ^ BASE)) < part
            key.append(of[hit] * k + (h[hit] % np.uint64(k)).astype(np.int64))
            rank.append(r[hit])
            dart.append(mix64(h[hit]))
            throw += 1
        key, rank, dart = np.concatenate(key), np.concatenate(rank), np.concatenate(dart)
        order = np.lexsort((rank, key))
        key, dart = key[order], dart[order]
        head = np.ones(len(key), dtype=bool)
        head[1:] = key[1:] != key[:-1]
        key, dart = key[head], dart[head]
        filled = np.bincount(key // k, minlength=n_rows) == k
        done = filled[key // k]
        out.reshape(-1)[key[done]] = dart[done]
        todo &= ~filled
        bound[todo] *= 2
    return out


def band_hashes(signatures: np.ndarray, bands: int, per_band: int) -> np.ndarray:
    parts = signatures.reshape(len(signatures), bands, per_band)
    return mix64((parts * powers(BASE, per_band)).sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64))


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values.astype(np.int64)))


def signed(docs: DataFrame, id_col: str, text_col: str, bands: int, per_band: int) -> DataFrame:
    """id, text_hash, k1, k2 (hash of the words), bands (none without words)."""

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, 2):
                raw, offsets = text_buffers(part.column(2))
                rows, hashes, whole, n_words = shingles(raw, offsets)
                cells = unit_cells(*multiset(rows, hashes))
                sign = dart_signatures(part.num_rows, *cells, bands * per_band)
                none = n_words == 0
                keys = [pa.array(np.ascontiguousarray(whole[:, i]).view(np.int64)) for i in (0, 1)]
                found = np.where(none, 0, bands)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *keys, _lists(band_hashes(sign, bands, per_band)[~none].reshape(-1).view(np.int64), found)], ["id", "text_hash", "k1", "k2", "bands"])

    return docs.select(F.col(id_col).cast("long").alias("id"), text_hash(text_col).alias("text_hash"), text_col).mapInArrow(run, "id long, text_hash long, k1 long, k2 long, bands array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(id, units): a multiset as the distinct hashes of its unit cells, so that plain set operations weigh it."""

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, 1):
                rows, hashes, _, _ = shingles(*text_buffers(part.column(1)))
                row, cell, _ = unit_cells(*multiset(rows, hashes))
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(cell.view(np.int64), np.bincount(row, minlength=part.num_rows))], ["id", "units"])

    return docs.mapInArrow(run, "id long, units array<long>")


def verify(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose weighted Jaccard similarity reaches the threshold; sizes alone rule out many."""
    left = sets.select(F.col("id").alias("a"), F.col("units").alias("ua"))
    right = sets.select(F.col("id").alias("b"), F.col("units").alias("ub"))
    na, nb = F.size("ua"), F.size("ub")
    # Merge joins at every size: the plan, and so the disk that a run needs, grows in proportion.
    met = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").filter((F.least(na, nb) >= F.greatest(na, nb) * threshold - 1e-9))
    both = F.size(F.array_intersect("ua", "ub"))
    return met.withColumn("_both", both).filter(F.col("_both") >= (na + nb - F.col("_both")) * threshold - 1e-9).select("a", "b")


def cross_links(groups: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between members of different components of a hub's group; groups: (hub, rep, comp).

    Members outside a group's largest component meet each other and its members, in tiles of at most ``TILE`` by ``TILE``;
    the largest component never meets itself, so its members are copied only as often as there are blocks of others. A tile
    gets each member's units once and tests in place; no pair is written unless it is a link, and members that a link of
    the tile joined are not tested again."""
    counts = groups.groupBy("hub", "comp").agg(F.count("*").alias("n"))
    sizes = counts.groupBy("hub").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("all"))
    blocks = lambda n: F.ceil(n / TILE).cast("int")
    sizes = sizes.select("hub", F.col("top.comp").alias("top"), blocks(F.col("all") - F.col("top.n")).alias("n_few"), blocks(F.col("top.n")).alias("n_top"))
    placed = groups.join(sizes, "hub").withColumn("few", F.col("comp") != F.col("top"))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("rep"), F.when(F.col("few"), F.col("n_few")).otherwise(F.col("n_top"))).cast("int"))
    tile = lambda with_top, i, j: F.struct(F.lit(with_top).alias("with_top"), i.alias("i"), j.alias("j"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    among = F.transform(upto("n_few"), lambda k: tile(False, F.least("own", k), F.greatest("own", k)))
    across = F.transform(upto("n_top"), lambda k: tile(True, F.col("own"), k))
    back = F.transform(upto("n_few"), lambda k: tile(True, k, F.col("own")))
    tiles = placed.select("hub", "rep", "comp", F.explode(F.when(F.col("few"), F.concat(among, across)).otherwise(back)).alias("t")).select("hub", "rep", "comp", "t.*")
    parts = tiles.join(sets.withColumnRenamed("id", "rep").hint("merge"), "rep").select("hub", "with_top", "i", "j", "rep", "comp", "units")

    def run(table):
        table = table.sort_by("rep").combine_chunks()
        reps, units = table.column("rep").to_numpy(), table.column("units").combine_chunks()
        size = np.diff(units.offsets.to_numpy())
        start = np.cumsum(size) - size
        comp = np.unique(table.column("comp").to_numpy(), return_inverse=True)[1]
        values = np.unique(units.flatten().to_numpy(), return_inverse=True)[1]
        mark = np.zeros(int(values.max()) + 1 if len(values) else 1, dtype=bool)
        found = []
        largest = np.bincount(comp).argmax()
        # A pair is tested from its member outside the largest component; of two such, from the first.
        for p in np.flatnonzero(comp != largest):
            near = (comp != comp[p]) & (np.minimum(size, size[p]) >= np.maximum(size, size[p]) * threshold - 1e-9)
            near[:p] &= comp[:p] == largest
            q = np.flatnonzero(near)
            if not len(q):
                continue
            mark[values[start[p] : start[p] + size[p]]] = True
            at = np.repeat(start[q] - (np.cumsum(size[q]) - size[q]), size[q]) + np.arange(size[q].sum())
            both = np.add.reduceat(mark[values[at]].astype(np.int64), np.cumsum(size[q]) - size[q])
            mark[values[start[p] : start[p] + size[p]]] = False
            for o in q[both >= (size[p] + size[q] - both) * threshold - 1e-9]:
                if comp[o] != comp[p]:
                    found.append((reps[p], reps[o]))
                    old, new = sorted((comp[p], comp[o]), key=lambda c: c == largest)
                    comp[comp == old] = new
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return parts.groupBy("hub", "with_top", "i", "j").applyInArrow(run, "a long, b long")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, per_band: int = ROWS) -> DataFrame:
    """docs' rows as (id, class_id, kept): class_id is the smallest id of the class."""
    return _classed(docs, id_col, text_col, threshold, bands, per_band)[0]


def _classed(docs: DataFrame, id_col: str, text_col: str, threshold: float, bands: int, per_band: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``classes``, and (id, text_hash) of the one row of each class that ``dedup`` keeps."""
    rows = keep(signed(docs, id_col, text_col, bands, per_band))
    # One representative per word sequence: the smallest id. Copies combine before the shuffle.
    pick = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash")).alias("pick")
    same = keep(rows.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.min_by("bands", "id").alias("bands"), pick))
    reps = same.filter("rep is not null").select("rep", F.posexplode("bands").alias("band", "hash"))
    hubs = reps.groupBy("band", "hash").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # All pairs that share a bucket share its hub; the hub is a member of its own group.
    members = materialize(reps.join(hubs, ["band", "hash"]).select("hub", "rep").distinct(), "minhash-members")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_col).join(members.select(F.col("rep").alias("id")).distinct().hint("merge"), "id", "left_semi")
    sets = keep(shingle_sets(texts.groupBy("id").agg(F.first(text_col).alias(text_col))))
    star = members.filter("hub <> rep").select(F.col("hub").alias("a"), F.col("rep").alias("b"))
    edges = materialize(verify(star, sets, threshold), "minhash-links")
    comp = connected_components(edges)
    named = members.join(comp, members["rep"] == comp["node"], "left").select("hub", "rep", F.coalesce("component", "rep").alias("comp"))
    mixed = named.groupBy("hub").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("hub")
    groups = materialize(named.join(mixed, "hub", "left_semi"), "minhash-mixed")
    more = materialize(cross_links(groups, sets, threshold), "minhash-links")
    comp = connected_components(edges.unionByName(more))
    named = same.join(comp, same["rep"] == comp["node"], "left").select("k1", "k2", "rep", "pick", F.coalesce("component", "rep").alias("class_id"))
    heads = named.filter("rep is null or rep = class_id").select("pick.id", "pick.text_hash")
    out = rows.join(named.drop("pick", "rep"), ["k1", "k2"], "left").select("id", F.coalesce("class_id", "id").alias("class_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("class_id"), F.lit(True))), heads


def text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, per_band: int = ROWS) -> DataFrame:
    """One row of docs for each class: of the rows with the class's id and words, the one with the least text hash; rows
    equal to it go. Texts without an id are classed by equal words, and one of each stays."""
    heads = _classed(docs, id_col, text_col, threshold, bands, per_band)[1].withColumnsRenamed({"id": "_head", "text_hash": "_hash_"})
    hashed = docs.withColumn("_hash", text_hash(text_col))
    left = hashed.join(heads, F.col(id_col).cast("long").eqNullSafe(F.col("_head")) & (F.col("_hash") == F.col("_hash_")), "left_semi")
    return left.dropDuplicates([id_col, "_hash"]).drop("_hash")


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return classes(docs).withColumnRenamed("id", "doc_id")
