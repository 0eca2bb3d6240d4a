"""Linear scoring, blends, softmax classes over prompts, and the source of a photo."""

from __future__ import annotations

import hashlib
import json
import math
import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from photonlake.functions.scores import overall, round_to
from photonlake.functions.vectors import dot
from photonlake.operators.vector_search import literal_vector
from photonlake.schemas import SOURCE_CAMERA, SOURCE_MEME, SOURCE_SAVED, SOURCE_UNKNOWN

#: Scale of the similarity logits.
LOGIT_SCALE = 100.0


def model_id(weights: list[float], bias: float) -> str:
    """Content address of a linear model: the same numbers have the same id."""
    return hashlib.sha256(struct.pack(f"<{len(weights) + 1}f", *weights, bias)).hexdigest()[:16]


def parse_model(text: str, width: int | None = None) -> dict:
    """{name, w, b, id} of a model file; anything off is an error."""
    m = json.loads(text)
    w, b = m.get("w"), m.get("b", 0.0)
    if not isinstance(w, list) or not w or width is not None and len(w) != width:
        raise ValueError("a model needs weights of the vectors' length")
    if not all(isinstance(x, (int, float)) and math.isfinite(x) for x in [*w, b]):
        raise ValueError("weights must be finite numbers")
    return {"name": m.get("name", ""), "w": [float(x) for x in w], "b": float(b), "id": model_id(w, b)}


def linear_score(vector: Column, weights: list[float], bias: float) -> Column:
    return dot(vector, literal_vector(weights)) + bias


def score_unscored(vectors: DataFrame, scores: DataFrame, model: dict) -> DataFrame:
    """(photo_id, model, score) of photos that the model has not scored yet."""
    done = scores.filter(F.col("model") == model["id"]).select("photo_id")
    return vectors.join(done, "photo_id", "left_anti").select("photo_id", F.lit(model["id"]).alias("model"), linear_score(F.col("clip"), model["w"], model["b"]).alias("score"))


def blend(scores: DataFrame, models: DataFrame, key: str = "photo_id") -> DataFrame:
    """(key, blend): weighted mean of the active models' present scores; null when no weight is present."""
    active = models.filter("active").select(F.col("id").alias("model"), "weight")
    parts = scores.join(F.broadcast(active), "model") if models.schema else scores
    out = parts.groupBy(key).agg(F.sum(F.col("weight") * F.col("score")).alias("_s"), F.sum("weight").alias("_w"))
    return out.select(key, F.when(F.col("_w") > 0, F.col("_s") / F.col("_w")).alias("blend"))


def refresh_blend(photos: DataFrame, blended: DataFrame) -> DataFrame:
    """(id, aesthetic, overall) of the rows that change by more than 1e-9; photos that no model scored keep theirs."""
    new = photos.join(blended.filter("blend is not null").withColumnRenamed("photo_id", "id"), "id")
    fresh = overall(F.col("technical"), F.col("blend"))
    differs = F.col("aesthetic").isNull() | (F.abs(F.col("aesthetic") - F.col("blend")) > 1e-9) | F.col("overall").isNull() | (F.abs(F.col("overall") - fresh) > 1e-9)
    return new.filter(differs).select("id", F.col("blend").alias("aesthetic"), fresh.alias("overall"))


def class_mass(rows: DataFrame, prompts: DataFrame, key: str = "id", vector: str = "embedding") -> DataFrame:
    """(key, name, prob): softmax over all prompts of the scaled similarity, summed per class.

    prompts (prompt, name, vector) are a fixed few dozen; they go out as one array per row, so no pair table is made."""
    fixed = [(r["name"], r["vector"]) for r in prompts.orderBy("prompt").collect()]
    sims = F.array(*[F.struct(F.lit(n).alias("name"), (dot(F.col(vector), literal_vector(v)) * LOGIT_SCALE).alias("x")) for n, v in fixed])
    opened = rows.select(key, sims.alias("s")).withColumn("m", F.array_max(F.transform("s", lambda x: x["x"])))
    raised = F.transform("s", lambda x: F.struct(x["name"].alias("name"), F.exp(x["x"] - F.col("m")).alias("e")))
    opened = opened.select(key, raised.alias("s")).withColumn("z", F.aggregate("s", F.lit(0.0), lambda a, x: a + x["e"]))
    names = list(dict.fromkeys(n for n, _ in fixed))

    def share(name: str) -> Column:
        return F.aggregate(F.filter("s", lambda x: x["name"] == name), F.lit(0.0), lambda a, x: a + x["e"]) / F.col("z")

    mass = F.array(*[F.struct(F.lit(n).alias("name"), share(n).alias("prob")) for n in names])
    return opened.select(key, F.explode(mass).alias("c")).select(key, "c.*")


def top_tags(mass: DataFrame, key: str = "id", least: float = 0.2, n: int = 3) -> DataFrame:
    """(key, tag, score): classes of at least ``least``, the best n, rounded to thousandths."""
    best = W.partitionBy(key).orderBy(F.col("score").desc(), F.col("tag").asc())
    tags = mass.filter(F.col("prob") >= least).select(key, F.col("name").alias("tag"), round_to(F.col("prob"), 3).alias("score"))
    return tags.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= n).drop("_n")


def photo_source(has_camera: Column, meme_prob: Column, threshold: float = 0.6) -> Column:
    """Camera when the metadata names one; unknown without a vector; else meme or saved by the meme mass."""
    return F.when(has_camera, SOURCE_CAMERA).when(meme_prob.isNull(), SOURCE_UNKNOWN).when(meme_prob >= threshold, SOURCE_MEME).otherwise(SOURCE_SAVED)


#: Prompts of the source classifier, memes and screenshots first.
SOURCE_PROMPTS_MEME = (
    "a meme with bold caption text over a picture",
    "a screenshot of a social media post",
    "a screenshot of a phone screen",
    "a screenshot of a text message conversation",
    "a news graphic with text and numbers",
    "a graphic with large text",
    "a poster or flyer with text",
    "a quote on a colored background",
    "a screenshot of a website or app",
    "a screenshot of a post with a caption above a photo",
    "a sports graphic with players and large text",
)
SOURCE_PROMPTS_PHOTO = (
    "a photo",
    "a photo of people",
    "a photo of a person",
    "a photo of a landscape",
    "a photo of an animal",
    "a photo of an object",
    "a photo of a building",
    "a snapshot taken with a phone camera",
    "a photo of food",
    "a photo of a street",
    "a photo of a sign with text",
    "a photo of a document or page of text",
    "a product photo of a device",
    "a close-up photo of something with writing on it",
    "a photo of toys",
    "a photo of a machine",
)


def feedback_samples(feedback: DataFrame) -> DataFrame:
    """(.., y, c, rated): a rating is its own target; agree, high and low are the shown score, 1 below and 1 above at half weight."""
    v = F.col("verdict")
    y = F.when(F.col("rating").isNotNull(), F.col("rating")).when(v == "agree", F.col("shown")).when(v == "high", F.col("shown") - 1).when(v == "low", F.col("shown") + 1)
    out = feedback.withColumn("y", y).withColumn("rated", F.col("rating").isNotNull())
    return out.withColumn("c", F.when(F.col("rated"), 1.0).otherwise(0.5)).filter("y is not null")


def scored_counts(models: DataFrame, scores: DataFrame) -> DataFrame:
    """Models with the number of photos each has scored."""
    n = scores.groupBy(F.col("model").alias("id")).agg(F.count("*").alias("scored"))
    return models.join(n, "id", "left").withColumn("scored", F.coalesce("scored", F.lit(0)))


def activate(models: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Exactly the given models active, with their weights (finite, above 0)."""
    for w in weights.values():
        if not (math.isfinite(w) and w > 0):
            raise ValueError("weights must be finite and above 0")
    known = {r["id"] for r in models.select("id").collect()}
    if set(weights) - known:
        raise ValueError("no such model")
    w = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]) if weights else F.lit(None).cast("map<string,double>")
    on = F.col("id").isin(*weights) if weights else F.lit(False)
    return models.withColumn("weight", F.when(on, F.element_at(w, F.col("id"))).otherwise(F.col("weight"))).withColumn("active", on)


def find_model(models: DataFrame, prefix: str) -> DataFrame:
    """The model whose id starts with prefix, when it is the only one."""
    hit = models.filter(F.startswith("id", F.lit(prefix)))
    return hit.withColumn("_n", F.count("*").over(W.partitionBy())).filter("_n = 1").drop("_n")


def adopt_scores(photos: DataFrame, scores: DataFrame, model: str) -> DataFrame:
    """Scores with the photos' own ratings taken over for a model that has none for them."""
    have = scores.filter(F.col("model") == model).select(F.col("photo_id").alias("id"))
    new = photos.filter("aesthetic is not null").join(have, "id", "left_anti").select(F.col("id").alias("photo_id"), F.lit(model).alias("model"), F.col("aesthetic").alias("score"))
    return scores.unionByName(new)


def judged_summary(feedback: DataFrame, vectors: DataFrame) -> DataFrame:
    """(rater, photos, no_vector): distinct photos judged, for every rater and, with a null rater, by anyone; of the latter
    also those without a vector. One distinct table of the pairs serves all."""
    pairs = feedback.select("rater", "photo_id").distinct()
    has = vectors.select("photo_id").distinct().withColumn("_has", F.lit(True))
    anyone = pairs.select("photo_id").distinct().join(has, "photo_id", "left").agg(F.count("*").alias("photos"), F.count_if(F.col("_has").isNull()).alias("no_vector"))
    each = pairs.groupBy("rater").agg(F.count("*").alias("photos")).withColumn("no_vector", F.lit(None).cast("long"))
    return each.unionByName(anyone.select(F.lit(None).cast("string").alias("rater"), "photos", "no_vector"))


def source_inputs(photos: DataFrame, vectors: DataFrame, after: int = 0, every: bool = False, limit: int = 1000) -> DataFrame:
    """(id, seq, camera, clip): a page, in id order, of the photos whose source is to be decided (or all), whether the
    metadata names a camera, and the vector (null when there is none)."""
    open_ = photos if every else photos.filter(F.col("source") == SOURCE_UNKNOWN)
    named = (F.coalesce("camera_make", F.lit("")) != "") | (F.coalesce("camera_model", F.lit("")) != "")
    first = open_.filter(F.col("id") > after).select("id", "seq", named.alias("camera")).orderBy("id").limit(limit)
    return first.join(vectors.select(F.col("photo_id").alias("id"), "clip"), "id", "left")


def judged_vectors(feedback: DataFrame, vectors: DataFrame, rater: str = "") -> DataFrame:
    """Each rater's standing judgement of a photo (the latest rating, else the latest verdict) with the photo's vector; photos
    without one are left out."""
    mine = feedback.filter(F.col("rater") == rater) if rater else feedback
    order = W.partitionBy("photo_id", "rater").orderBy(F.col("rating").isNotNull().desc(), F.col("id").desc())
    latest = mine.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
    return latest.join(vectors.select("photo_id", "clip"), "photo_id")


def photo_scores(scores: DataFrame) -> DataFrame:
    """(photo_id, scores): every model's score of a photo as a map."""
    return scores.groupBy("photo_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", "score")))).alias("scores"))


def add_scores(scores: DataFrame, model: str, new: DataFrame) -> DataFrame:
    """Scores with one model's new ones (photo_id, score) in place of its earlier ones."""
    fresh = new.select("photo_id", F.lit(model).alias("model"), "score")
    return scores.join(fresh.select("photo_id", "model"), ["photo_id", "model"], "left_anti").unionByName(fresh)
