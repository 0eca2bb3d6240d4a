"""People: exemplars, label propagation, discovery of recurring faces, and the label tables."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from photonlake.functions.text import ascii_lower


def farthest_points(v: np.ndarray, k: int) -> list[int]:
    """Row numbers of up to k mutually dissimilar vectors: the first, then always the one least like those chosen."""
    if len(v) <= k:
        return list(range(len(v)))
    chosen, nearest = [0], v @ v[0]
    while len(chosen) < k:
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, v @ v[chosen[-1]])
    return chosen


#: Faces of a person that one task takes at once; persons with more are worked through in rounds over the cluster.
PERSON_FACES = 20_000
#: Bytes of exemplars that are broadcast at a time.
EXEMPLAR_BYTES = 128 << 20


def _diverse_in_rounds(named: DataFrame, per_person: int) -> DataFrame:
    """Farthest points of persons with any number of faces: every round each task offers, for every person, its face least
    like those chosen so far, and the least of these is chosen. A task holds a batch and the exemplars chosen so far."""
    spark = named.sparkSession
    first = named.groupBy("person_id").agg(F.min_by(F.struct("id", "embedding"), "id").alias("x")).select("person_id", "x.*")
    chosen = {r["person_id"]: [(r["id"], np.array(r["embedding"]))] for r in first.collect()}
    for _ in range(per_person - 1):
        shared = spark.sparkContext.broadcast({p: (np.array([i for i, _ in x]), np.stack([v for _, v in x])) for p, x in chosen.items()})

        def offer(batches, shared=shared):
            best: dict[int, tuple] = {}
            for batch in batches:
                persons, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                x = np.stack(batch.column(2).to_pylist()) if len(ids) else np.zeros((0, 1))
                for p in np.unique(persons):
                    taken, v = shared.value[p]
                    at = np.flatnonzero((persons == p) & ~np.isin(ids, taken))
                    if len(at):
                        near = (x[at] @ v.T).max(axis=1)
                        k = np.lexsort((ids[at], near))[0]
                        mine = (float(near[k]), int(ids[at[k]]), x[at[k]])
                        if p not in best or mine[:2] < best[p][:2]:
                            best[p] = mine
            columns = [list(best), [m[0] for m in best.values()], [m[1] for m in best.values()], [m[2].tolist() for m in best.values()]]
            kinds = [pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["person_id", "near", "id", "embedding"])

        offers = named.mapInArrow(offer, "person_id long, near double, id long, embedding array<double>")
        picked = offers.groupBy("person_id").agg(F.min_by(F.struct("id", "embedding"), F.struct("near", "id")).alias("x")).select("person_id", "x.*").collect()
        for r in picked:
            chosen[r["person_id"]].append((r["id"], np.array(r["embedding"])))
        shared.unpersist()
    rows = [(p, i, v.tolist()) for p, x in chosen.items() for i, v in x]
    return spark.createDataFrame(rows, "person_id long, id long, embedding array<double>")


def exemplars(faces: DataFrame, per_person: int = 32) -> DataFrame:
    """(person_id, id, embedding) of each person's diverse exemplars among the faces named by hand, in id order."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        return pdf.iloc[farthest_points(np.stack(pdf["embedding"]).astype(np.float64), per_person)]

    schema = "person_id long, id long, embedding array<double>"
    named = faces.filter(F.col("person_source") == "manual").select("person_id", "id", F.col("embedding").cast("array<double>").alias("embedding"))
    many = [r["person_id"] for r in named.groupBy("person_id").count().filter(F.col("count") > PERSON_FACES).select("person_id").collect()]
    if not many:
        return named.groupBy("person_id").applyInPandas(pick, schema)
    crowded = F.col("person_id").isin(many)
    return named.filter(~crowded).groupBy("person_id").applyInPandas(pick, schema).unionByName(_diverse_in_rounds(named.filter(crowded), per_person))


def propagate_labels(faces: DataFrame, chosen: DataFrame, threshold: float = 0.45, margin: float = 0.08, only: int = 0, block_bytes: int = EXEMPLAR_BYTES) -> DataFrame:
    """(id, person_id, sim): a face takes the person of its most similar exemplar when that similarity reaches the
    threshold and leads the next person's (0 when there is none) by the margin.

    Exemplars travel as a matrix of at most ``block_bytes``; more of them go in blocks of whole persons, one pass over the
    faces each. A task keeps the two best persons of its own faces in a block, and a face's bests of all blocks meet
    in one aggregate, so nothing per pair of face and exemplar is made."""
    if not (-1 <= threshold <= 1 and 0 <= margin <= 2):
        raise ValueError("threshold must be in [-1, 1] and margin in [0, 2]")
    chosen = chosen.persist(StorageLevel.DISK_ONLY)
    size = chosen.agg(F.coalesce(F.sum(8 * F.size("embedding")), F.lit(0)).alias("n")).first()["n"]
    n_blocks = max(1, math.ceil(size / block_bytes))
    open_faces = faces.filter(~F.col("person_source").eqNullSafe(F.lit("manual"))).select(F.col("id").cast("long"), "embedding")

    def two_best(matrix: np.ndarray, persons: np.ndarray) -> DataFrame:
        starts = np.flatnonzero(np.concatenate([[True], persons[1:] != persons[:-1]]))
        shared = faces.sparkSession.sparkContext.broadcast((matrix, starts, persons[starts]))

        def run(batches):
            m, at, who = shared.value
            for batch in batches:
                for lo in range(0, batch.num_rows, 4096):
                    part = batch.slice(lo, 4096)
                    ids = part.column(0).to_numpy()
                    x = np.stack(part.column(1).to_pylist()).astype(np.float64)
                    s = np.zeros((len(ids), len(m)))
                    for j in range(m.shape[1]):
                        s += x[:, j : j + 1] * m[:, j][None, :]
                    best = np.maximum.reduceat(s, at, axis=1)
                    pick = np.arange(len(ids))
                    for _ in range(min(2, len(who))):
                        first = best.argmax(axis=1)
                        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(who[first]), pa.array(best[pick, first])], ["id", "person_id", "sim"])
                        best[pick, first] = -np.inf

        return open_faces.mapInArrow(run, "id long, person_id long, sim double")

    found = None
    for b in range(n_blocks):
        rows = chosen.filter(F.pmod(F.xxhash64("person_id"), F.lit(n_blocks)) == b).orderBy("person_id", "id").toArrow()
        if rows.num_rows:
            part = two_best(np.stack(rows.column("embedding").to_pylist()).astype(np.float64), rows.column("person_id").to_numpy())
            found = part if found is None else found.unionByName(part)
    if found is None:
        return faces.sparkSession.createDataFrame([], "id long, person_id long, sim double")
    # Ties go to the lower person; a person below 0 leads nobody.
    ranked = found.filter("sim > 0").groupBy("id").agg(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("sim", (-F.col("person_id")).alias("neg"))))), 1, 2).alias("best"))
    out = ranked.select("id", (-F.col("best")[0]["neg"]).alias("person_id"), F.col("best")[0]["sim"].alias("sim"), F.coalesce(F.get("best", F.lit(1))["sim"], F.lit(0.0)).alias("next"))
    ok = (F.col("sim") >= threshold) & (F.col("sim") - F.col("next") >= margin)
    return out.filter(ok & (F.col("person_id") == only) if only else ok).drop("next")


def apply_labels(faces: DataFrame, labels: DataFrame, only: int = 0) -> DataFrame:
    """Faces with automatic labels cleared (of one person, or all) and the new ones set; labels by hand stay."""
    auto = F.col("person_source").eqNullSafe(F.lit("auto"))
    cleared = auto if not only else auto & (F.col("person_id") == only)
    new = labels.select("id", F.col("person_id").alias("_person"), F.col("sim").alias("_sim"))
    joined = faces.join(new, "id", "left").withColumn("_new", F.col("_person").isNotNull() & ~F.col("person_source").eqNullSafe(F.lit("manual")))

    def value(column: str, fresh: str):
        return F.when(F.col("_new"), F.col(fresh) if fresh.startswith("_") else F.lit(fresh)).when(cleared, F.lit(None)).otherwise(F.col(column))

    out = joined.select("*", value("person_id", "_person").alias("_a"), value("person_source", "auto").alias("_b"), value("person_sim", "_sim").alias("_c"))
    return out.drop("person_id", "person_source", "person_sim", "_person", "_sim", "_new").withColumnsRenamed({"_a": "person_id", "_b": "person_source", "_c": "person_sim"}).select(*faces.columns)


def leader_clusters(v: np.ndarray, threshold: float) -> np.ndarray:
    """Cluster number of every row, in row order: the most similar leader above the threshold, else a new one."""
    leaders = np.zeros((0, v.shape[1]))
    out = np.zeros(len(v), dtype=np.int64)
    for i, x in enumerate(v):
        sims = leaders @ x
        best = int(sims.argmax()) if len(sims) else -1
        if best >= 0 and sims[best] > threshold:
            out[i] = best
        else:
            out[i] = len(leaders)
            leaders = np.vstack([leaders, x])
    return out


def discover(eligible: DataFrame, max_faces: int = 5000, min_photos: int = 3, threshold: float = 0.5, max_clusters: int = 100, sample: int = 12) -> DataFrame:
    """(cluster, size, photos, faces): recurring unnamed faces. The pass is order-dependent by definition, so the best
    ``max_faces`` faces (the feature's own bound) are clustered in one call; counts are Spark's."""
    best = eligible.orderBy((F.col("width_px") * F.col("score")).desc(), F.col("id").asc()).limit(max_faces)
    best = best.select("id", "photo_id", (F.col("width_px") * F.col("score")).alias("quality"), F.col("embedding").cast("array<double>").alias("embedding"))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["quality", "id"], ascending=[False, True])
        of = leader_clusters(np.stack(pdf["embedding"]), threshold)
        return pd.DataFrame({"cluster": of, "id": pdf["id"].to_numpy(), "photo_id": pdf["photo_id"].to_numpy(), "rank": np.arange(len(pdf))})

    members = best.groupBy(F.lit(0).alias("all")).applyInPandas(lambda pdf: work(pdf), "cluster long, id long, photo_id long, rank long")
    shown = F.slice(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]), 1, sample)
    out = members.groupBy("cluster").agg(F.count("*").alias("size"), F.count_distinct("photo_id").alias("photos"), shown.alias("faces"))
    return out.filter(F.col("photos") >= min_photos).orderBy(F.col("photos").desc(), F.col("cluster").asc()).limit(max_clusters)


def cluster_members(faces: DataFrame, leader, threshold: float, k: int | None) -> DataFrame:
    """Unnamed faces of at least the threshold to a leader's vector, the best k (None: all)."""
    from photonlake.operators.vector_search import knn

    return knn(faces.filter(F.col("person_id").isNull()), leader, k, min_score=threshold)


def person_counts(people: DataFrame, faces: DataFrame) -> DataFrame:
    """Photos and faces of each person, all and by hand, and the best face: by hand first, then the largest upright one."""
    manual = F.col("person_source").eqNullSafe(F.lit("manual"))
    quality = F.col("width_px") * F.col("score") * (1 - F.abs("yaw"))
    best = F.max(F.when(F.col("fid").isNotNull(), F.struct(manual.alias("m"), quality.alias("q"), (-F.col("fid")).alias("neg"))))
    side = faces.select(F.col("id").alias("fid"), "photo_id", "person_id", "person_source", "width_px", "score", "yaw")
    return (
        people.join(side, people["id"] == side["person_id"], "left")
        .groupBy("id", "name")
        .agg(
            F.count_distinct("photo_id").alias("photos"),
            F.count_distinct(F.when(manual, F.col("photo_id"))).alias("manual_photos"),
            F.count("fid").alias("faces"),
            F.count_if(manual).alias("manual_faces"),
            best.alias("_best"),
        )
        .withColumn("best_face", -F.col("_best.neg"))
        .drop("_best")
    )


def person_by_name(people: DataFrame, name: str) -> DataFrame:
    return people.filter(ascii_lower(F.col("name")) == ascii_lower(F.lit(name)))


def ensure_person(people: DataFrame, name: str, now: int) -> DataFrame:
    """People with the name among them: a new row only when none has it, whatever the case."""
    clean = " ".join(name.split())
    if not clean:
        raise ValueError("a name is needed")
    known = person_by_name(people, clean).select(F.lit(1).alias("one"))
    row = people.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id")).select("id", F.lit(clean).alias("name"), F.lit(now).cast("long").alias("created_at"))
    return people.unionByName(row.join(known, F.lit(True), "left_anti"))


def assign(faces: DataFrame, ids: DataFrame, person: int) -> DataFrame:
    """Name faces by hand. All or nothing: an unknown id fails the whole change."""
    missing = ids.join(faces.select("id"), "id", "left_anti").limit(1).count()
    if missing:
        raise ValueError("a face to name does not exist")
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    j = faces.join(hit, "id", "left")
    on = F.col("_hit").isNotNull()
    return j.withColumns({"person_id": F.when(on, F.lit(person).cast("long")).otherwise(F.col("person_id")), "person_source": F.when(on, "manual").otherwise(F.col("person_source")), "person_sim": F.when(~on, F.col("person_sim"))}).select(*faces.columns)


def unassign(faces: DataFrame, ids: DataFrame) -> DataFrame:
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    j = faces.join(hit, "id", "left")
    off = F.col("_hit").isNull()
    return j.withColumns({c: F.when(off, F.col(c)) for c in ("person_id", "person_source", "person_sim")}).select(*faces.columns)


def merge_people(people: DataFrame, faces: DataFrame, source: int, target: int) -> tuple[DataFrame, DataFrame]:
    """All of source's faces become target's, and source goes."""
    return people.filter(F.col("id") != source), faces.withColumn("person_id", F.when(F.col("person_id") == source, F.lit(target).cast("long")).otherwise(F.col("person_id")))


def rename_person(people: DataFrame, faces: DataFrame, person: int, name: str) -> tuple[DataFrame, DataFrame]:
    """A name that another person has merges into that person."""
    clean = " ".join(name.split())
    other = person_by_name(people, clean).filter(F.col("id") != person).select("id").first()
    if other:
        return merge_people(people, faces, person, other["id"])
    return people.withColumn("name", F.when(F.col("id") == person, F.lit(clean)).otherwise(F.col("name"))), faces


def delete_person(people: DataFrame, faces: DataFrame, person: int) -> tuple[DataFrame, DataFrame]:
    return people.filter(F.col("id") != person), unassign(faces, faces.filter(F.col("person_id") == person).select("id"))


def labelled_faces(faces: DataFrame, person: int, confirmed: bool = False) -> DataFrame:
    out = faces.filter(F.col("person_id") == person)
    return out.filter(F.col("person_source") == "manual") if confirmed else out


def distinct_photos(hits: DataFrame, limit: int) -> DataFrame:
    """(photos, at_least): distinct photos among face hits; at_least when the hits reach their limit."""
    return hits.agg(F.count_distinct("photo_id").alias("photos"), (F.count("*") >= limit).alias("at_least"))


def latest_by_priority(rows: DataFrame, keys: list[str], preferred: str, tie: str = "id") -> DataFrame:
    """The latest row with the preferred column set, else the latest row, of every key."""
    order = W.partitionBy(*keys).orderBy(F.col(preferred).isNotNull().desc(), F.col(tie).desc())
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def confident_faces(faces: DataFrame, least: float = 0.6) -> DataFrame:
    """Faces to count on a photo, and the sharpness of the widest."""
    return faces.groupBy("photo_id").agg(F.count_if(F.col("score") >= least).alias("face_count"), F.max_by("sharpness", F.struct("width_px", "id")).alias("face_sharpness"), F.max("width_px").alias("width_px"))


