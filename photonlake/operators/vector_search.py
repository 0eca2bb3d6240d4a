"""Exact nearest-neighbour search: filter first, score, bounded top-k.

Scores are inner products of unit vectors in double precision. Query vectors are a small table that the caller
holds; they are sent as literals or broadcast, and every task keeps only its own best k before the merge.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from photonlake.functions.vectors import dot
from photonlake.operators.grouping import first_per_stack


def literal_vector(v) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def score(vectors: DataFrame, query, vector_col: str = "embedding") -> DataFrame:
    """vectors with their similarity to one query vector."""
    return vectors.withColumn("score", dot(F.col(vector_col), literal_vector(query)))


def knn(vectors: DataFrame, query, k: int | None, min_score: float | None = None, vector_col: str = "embedding") -> DataFrame:
    """(id, score) of the best k (None: of all), ties to the lower id."""
    hits = score(vectors, query, vector_col).select("id", "score")
    if min_score is not None:
        hits = hits.filter(F.col("score") >= min_score)
    ordered = hits.orderBy(F.col("score").desc(), F.col("id").asc())
    return ordered if k is None else ordered.limit(k)


def knn_filtered(vectors: DataFrame, allowed: DataFrame, query, k: int, **options) -> DataFrame:
    """The best k among the allowed ids: the filter comes before the cut, so none of the k is lost to it."""
    return knn(vectors.join(allowed.select("id"), "id", "left_semi"), query, k, **options)


def similar_to(vectors: DataFrame, source: DataFrame, k: int, vector_col: str = "embedding") -> DataFrame:
    """Best k for the single row of source, itself left out; none when source is empty. The row's vector is read first:
    Spark takes no subquery inside a product of arrays."""
    probe = source.select("id", vector_col).first()
    if probe is None:
        return vectors.limit(0).select("id", F.lit(0.0).alias("score"))
    return knn(vectors.filter(F.col("id") != probe["id"]), probe[vector_col], k, vector_col=vector_col)


#: Queries whose vectors are held together.
QUERY_BLOCK = 4096


def knn_many(vectors: DataFrame, queries: DataFrame, k: int, vector_col: str = "embedding", block: int = QUERY_BLOCK) -> DataFrame:
    """(query, id, score, rank): the best k of every query (id, vector). Queries go out in blocks of ``block``, one pass over
    the vectors each; a task keeps k candidates per query and batch, from blocked products."""
    wanted = queries.select(F.col("id").cast("long").alias("query"), F.col(vector_col).alias("v"))
    n_blocks = max(1, -(-wanted.count() // block))

    def candidates(names: np.ndarray, matrix: np.ndarray) -> DataFrame:
        shared = vectors.sparkSession.sparkContext.broadcast((names, matrix))

        def run(batches):
            names, matrix = shared.value
            for batch in batches:
                for at in range(0, batch.num_rows, 2048):
                    part = batch.slice(at, 2048)
                    ids = part.column(0).to_numpy()
                    x = part.column(1).flatten().to_numpy().reshape(len(ids), -1).astype(np.float64)
                    s = np.zeros((len(matrix), len(ids)))
                    for j in range(matrix.shape[1]):  # component by component: the order of a plain sum
                        s += matrix[:, j : j + 1] * x[:, j][None, :]
                    order = np.argsort(ids, kind="stable")
                    best = order[np.argsort(-s[:, order], axis=1, kind="stable")[:, :k]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, best.shape[1])), pa.array(ids[best].reshape(-1)), pa.array(np.take_along_axis(s, best, axis=1).reshape(-1))], ["query", "id", "score"])

        return vectors.select(F.col("id").cast("long"), vector_col).mapInArrow(run, "query long, id long, score double")

    found = None
    for b in range(n_blocks):
        rows = wanted.filter(F.pmod(F.xxhash64("query"), F.lit(n_blocks)) == b).orderBy("query").toArrow()
        if rows.num_rows:
            part = candidates(rows.column("query").to_numpy(), np.stack(rows.column("v").to_pylist()).astype(np.float64))
            found = part if found is None else found.unionByName(part)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query long, id long, score double, rank int")
    best = W.partitionBy("query").orderBy(F.col("score").desc(), F.col("id").asc())
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def search_by_exemplars(vectors: DataFrame, exemplars: list, k: int, skip: DataFrame | None = None, min_score: float = -1.0, vector_col: str = "embedding") -> DataFrame:
    """Best k by the largest similarity to any exemplar, without the ids to skip."""
    rows = vectors.join(skip.select("id"), "id", "left_anti") if skip is not None else vectors
    sims = F.array_max(F.array(*[dot(F.col(vector_col), literal_vector(e)) for e in exemplars]))
    return rows.select("id", sims.alias("score")).filter(F.col("score") >= min_score).orderBy(F.col("score").desc(), F.col("id").asc()).limit(k)


def photos_by_face(faces: DataFrame, exemplars: list, k: int, min_score: float, allowed: DataFrame | None = None) -> DataFrame:
    """(photo_id, face_id, score): photos by their best face."""
    rows = faces.join(allowed.select(F.col("id").alias("photo_id")), "photo_id", "left_semi") if allowed is not None else faces
    sims = F.array_max(F.array(*[dot(F.col("embedding"), literal_vector(e)) for e in exemplars]))
    best = rows.withColumn("score", sims).filter(F.col("score") >= min_score).groupBy("photo_id").agg(F.max(F.struct(F.col("score"), (-F.col("id")).alias("neg"))).alias("m"))
    return best.select("photo_id", (-F.col("m.neg")).alias("face_id"), F.col("m.score").alias("score")).orderBy(F.col("score").desc(), F.col("photo_id").asc()).limit(k)


def search_stacks(hits: DataFrame, k: int) -> DataFrame:
    """Best k with one hit a stack: hits (id, score, stack_top) collapse before the cut."""
    ranked = hits.withColumn("rank", F.struct((-F.col("score")).alias("s"), F.col("id").alias("i")))
    return first_per_stack(ranked).drop("rank").orderBy(F.col("score").desc(), F.col("id").asc()).limit(k)


def search_by_example(faces: DataFrame, example: DataFrame, k: int, min_score: float, allowed: DataFrame | None = None) -> DataFrame:
    """Photos like the largest face (box area, then the lower ordinal) among the detected faces of an example picture
    (ordinal, x1, y1, x2, y2, embedding); none when it has no face."""
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    probe = example.agg(F.min_by("embedding", F.struct((-area).alias("a"), "ordinal")).alias("v")).first()["v"]
    return photos_by_face(faces if probe is not None else faces.limit(0), [probe or []], k, min_score, allowed)


def in_rank_order(hits: DataFrame, photos: DataFrame) -> DataFrame:
    """Full rows of the hits (rank, id), best first."""
    return photos.join(hits.select("id", "rank"), "id").orderBy("rank")


def upsert_vectors(index: DataFrame, changed: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """Replace changed vectors, add new ones, drop deleted ids."""
    out = index.join(changed.select("id"), "id", "left_anti").unionByName(changed)
    return out.join(deleted.select("id"), "id", "left_anti") if deleted is not None else out
