"""Queries over single records and their upkeep: remaining filters and orders, judgements, scores, clean-ups, invites, vectors,
labels of values, and measures of an experiment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photonlake.functions import scores, text, times, vectors
from photonlake.operators import accounts, cleanup, folders, grouping, maintenance, matching, people, scoring, training, vector_search
from photonlake.operators.filters import Filter, Related, apply_filter, discover_eligible
from photonlake.operators.ordering import page, photo_order
from photonlake.plans import adapters as A
from photonlake.plans.browse import ORDERS
from photonlake.plans.upkeep import _FACES, _faces
from photonlake.session import load
from photonlake.sources.files import same_content

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _r6(c):
    return scores.round_to(c, 6)


_DOT = "list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
_MEASURED = """(SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS overall, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice % 10 END AS aesthetic, o_totalprice % 97 AS technical,
  (o_custkey % 20) / 20.0 AS focus_score, o_totalprice % 31 AS sharpness, o_totalprice % 53 AS colorfulness, o_totalprice % 13 AS cast_strength, o_custkey % 5 = 0 AS monochrome, 1 + o_totalprice % 3 AS blockiness, o_totalprice % 7 AS noise FROM orders)"""


def _measured(spark: SparkSession, d: str) -> DataFrame:
    """orders as photos with measurements; every third has no rating."""
    p, k, c = F.col("o_totalprice"), F.col("o_orderkey"), F.col("o_custkey")
    return load(spark, d, "orders").select(
        k.alias("id"), F.when(k % 5 != 0, p).alias("overall"), F.when(k % 3 != 0, p % 10).alias("aesthetic"), (p % 97).alias("technical"), (c % 20 / 20.0).alias("focus_score"), (p % 31).alias("sharpness"),
        (p % 53).alias("colorfulness"), (p % 13).alias("cast_strength"), (c % 5 == 0).alias("monochrome"), (1 + p % 3).alias("blockiness"), (p % 7).alias("noise"),
    )


# filters and orders


def _filtered(name: str, condition: str, f: Filter):
    @query(f"SELECT id FROM {_MEASURED} WHERE {condition}")
    def run(spark: SparkSession, d: str) -> DataFrame:
        return apply_filter(_measured(spark, d), f).select("id")

    QUERIES[name], ORACLES[name] = QUERIES.pop("run"), ORACLES.pop("run")


_filtered("filter_aesthetic", "aesthetic >= 7.5", Filter(min_aesthetic=7.5))
_filtered("filter_cast", "cast_strength <= 3 OR monochrome", Filter(max_cast=3.0))
_filtered("filter_artifacts", "blockiness <= 2 AND noise <= 3.5", Filter(max_blockiness=2.0, max_noise=3.5))
_filtered("filter_mono", "monochrome AND focus_score >= 0.45", Filter(mono="only", min_focus=0.45))


def _sorted(name: str, columns: str, sql_order: str, sort: str):
    @query(f"SELECT id, {columns} FROM {_MEASURED} ORDER BY {sql_order}, id LIMIT 51")
    def run(spark: SparkSession, d: str) -> DataFrame:
        return page(_measured(spark, d).select("id", *columns.split(", ")), photo_order(sort), 50)

    QUERIES[name], ORACLES[name] = QUERIES.pop("run"), ORACLES.pop("run")


_sorted("browse_sort_overall", "overall", "overall DESC NULLS LAST", "overall")
_sorted("browse_sort_technical", "technical", "technical DESC", "technical")
_sorted("browse_sort_aesthetic", "aesthetic", "aesthetic DESC NULLS LAST", "aesthetic")
_sorted("browse_sort_sharpness", "focus_score, sharpness", "focus_score DESC, sharpness DESC", "sharpness")
_sorted("browse_sort_colorful", "colorfulness", "colorfulness DESC", "colorful")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey = 3)")
def filter_starred(spark: SparkSession, d: str) -> DataFrame:
    stars = load(spark, d, "lineitem").select(F.col("l_suppkey").alias("user_id"), F.col("l_orderkey").alias("photo_id"))
    return apply_filter(_measured(spark, d), Filter(starred=True, starred_by=3), Related(stars=stars)).select("id")


_FILTERS = {"none": Filter(), "page": Filter(sort="newest", limit=5, offset=2), "photos": Filter(source="photos"), "dirs": Filter(dirs=("/a",)), "memes": Filter(source="memes"), "camera": Filter(camera="x")}


@query("SELECT * FROM (VALUES ('none', false, false), ('page', false, false), ('photos', true, false), ('dirs', true, false), ('memes', true, true), ('camera', true, true)) AS v(name, restricts, narrows)")
def filter_narrows(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(n, f.restricts(), f.narrows()) for n, f in _FILTERS.items()], "name string, restricts boolean, narrows boolean")


@query("SELECT p_partkey AS id FROM part WHERE p_partkey % 3 <> 2")
def filter_spellings(spark: SparkSession, d: str) -> DataFrame:
    """Paths below a folder whose name is written composed, decomposed, or without its accent."""
    k = F.col("p_partkey")
    path = F.concat(F.when(k % 3 == 0, "/Café/").when(k % 3 == 1, "/Café/").otherwise("/Cafe/"), k.cast("string"))
    return load(spark, d, "part").select(k.alias("id"), path.alias("path")).filter(text.starts_with_any_spelling(F.col("path"), "/Café/")).select("id")


@query("SELECT vec_id AS id FROM embeddings WHERE vec_id % 5 <> 0 AND 40 + vec_id % 120 >= 60 AND vec_id % 40 >= 10 AND abs((vec_id % 13) / 10.0 - 0.6) < 0.6")
def discoverable_faces(spark: SparkSession, d: str) -> DataFrame:
    return discover_eligible(A.face_rows(spark, d)).select("id")


# judgements and scores

_JUDGED = "(SELECT conv_id * 1000 + turn AS id, conv_id AS photo_id, role AS rater, CASE WHEN length(text) > 100 THEN length(text) / 100.0 END AS rating FROM conversations)"


def _judged(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("text")
    return load(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).cast("long").alias("id"), F.col("conv_id").alias("photo_id"), F.col("role").alias("rater"), F.when(n > 100, n / 100.0).alias("rating"))


def _clips(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of photos; every seventh photo has none."""
    return load(spark, d, "embeddings").filter("vec_id % 7 <> 0").select(F.col("vec_id").alias("photo_id"), F.col("embedding").alias("clip"))


@query(
    f"""SELECT coalesce(rater, '*') AS rater, count(DISTINCT photo_id) AS photos, -1 AS no_vector FROM {_JUDGED} GROUP BY rater
UNION ALL SELECT '*', count(DISTINCT photo_id), count(DISTINCT CASE WHEN photo_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 7 <> 0) THEN photo_id END) FROM {_JUDGED}"""
)
def judged_summary(spark: SparkSession, d: str) -> DataFrame:
    out = scoring.judged_summary(_judged(spark, d), _clips(spark, d))
    return out.select(F.coalesce("rater", F.lit("*")).alias("rater"), "photos", F.coalesce("no_vector", F.lit(-1)).alias("no_vector"))


@query(
    f"""SELECT id, photo_id, rater, {'round({} * 1e6) / 1e6'.format('CAST(embedding[1] AS DOUBLE)')} AS first FROM (SELECT *, row_number() OVER (PARTITION BY photo_id, rater ORDER BY (rating IS NOT NULL) DESC, id DESC) AS k FROM {_JUDGED}) j JOIN embeddings ON vec_id = photo_id AND vec_id % 7 <> 0 WHERE k = 1"""
)
def judged_vectors(spark: SparkSession, d: str) -> DataFrame:
    return scoring.judged_vectors(_judged(spark, d), _clips(spark, d)).select("id", "photo_id", "rater", _r6(F.col("clip")[0].cast("double")).alias("first"))


@query("SELECT doc_id AS id, doc_id % 3 = 0 AS camera, vec_id IS NOT NULL AS has_vector FROM (SELECT * FROM documents WHERE doc_id % 4 = 0 AND doc_id > 20 ORDER BY doc_id LIMIT 100) LEFT JOIN embeddings ON vec_id = doc_id AND vec_id % 7 <> 0")
def source_inputs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    p = load(spark, d, "documents").select(k.alias("id"), k.alias("seq"), F.when(k % 3 == 0, "X").alias("camera_make"), F.lit("").alias("camera_model"), (k % 4).cast("int").alias("source"))
    return scoring.source_inputs(p, _clips(spark, d), after=20, limit=100).select("id", "camera", F.col("clip").isNotNull().alias("has_vector"))


_SCORES = "(SELECT l_orderkey AS photo_id, l_returnflag AS model, max(l_quantity) AS score FROM lineitem GROUP BY 1, 2)"


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("photo_id"), F.col("l_returnflag").alias("model")).agg(F.max("l_quantity").alias("score"))


@query(f"SELECT photo_id, string_agg(model || '=' || CAST(score AS INTEGER), ',' ORDER BY model) AS scores FROM {_SCORES} GROUP BY 1")
def photo_scores(spark: SparkSession, d: str) -> DataFrame:
    m = F.transform(F.map_entries("scores"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("int").cast("string")))
    return scoring.photo_scores(_scores(spark, d)).select("photo_id", F.array_join(m, ",").alias("scores"))


@query(f"SELECT photo_id, model, score FROM {_SCORES} WHERE NOT (model = 'A' AND photo_id % 2 = 0) UNION ALL SELECT o_orderkey, 'A', 1.5 FROM orders WHERE o_orderkey % 2 = 0")
def added_scores(spark: SparkSession, d: str) -> DataFrame:
    new = load(spark, d, "orders").filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("photo_id"), F.lit(1.5).alias("score"))
    return scoring.add_scores(_scores(spark, d), "A", new)


@query("SELECT 'model-' || p_partkey AS id FROM part WHERE starts_with('model-' || p_partkey, 'model-17') QUALIFY count(*) OVER () = 1 UNION ALL SELECT 'model-' || p_partkey FROM part WHERE starts_with('model-' || p_partkey, 'model-200') QUALIFY count(*) OVER () = 1")
def found_model(spark: SparkSession, d: str) -> DataFrame:
    """A prefix finds a model only when no other has it."""
    m = load(spark, d, "part").select(F.concat(F.lit("model-"), F.col("p_partkey").cast("string")).alias("id"))
    return scoring.find_model(m, "model-17").unionByName(scoring.find_model(m, "model-200"))


@query("SELECT conv_id * 100 + turn AS id, CAST(conv_id AS BIGINT) AS photo_id, role AS rater FROM conversations UNION ALL SELECT -1, 1, 'new' FROM (SELECT 1) WHERE EXISTS (SELECT 1 FROM embeddings WHERE vec_id = 1)")
def added_feedback(spark: SparkSession, d: str) -> DataFrame:
    """A judgement of a known photo is appended, one of an unknown photo is not."""
    f = load(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).cast("long").alias("id"), F.col("conv_id").cast("long").alias("photo_id"), F.col("role").alias("rater"), F.lit(None).cast("double").alias("rating"), F.lit("agree").alias("verdict"))
    photos = A.vectors(spark, d).select("id")
    row = {"id": -1, "photo_id": 1, "rater": "new", "rating": 7.0, "verdict": None}
    out = maintenance.add_feedback(f, photos, row)
    return maintenance.add_feedback(out, photos, {**row, "id": -2, "photo_id": -5}).select("id", "photo_id", "rater")


@query("SELECT l_suppkey AS user_id, l_orderkey AS photo_id FROM lineitem WHERE l_suppkey < 4 GROUP BY 1, 2 HAVING NOT (l_suppkey = 1 AND l_orderkey = 7) UNION SELECT 9, 1 FROM orders WHERE o_orderkey = 1")
def starred_photos(spark: SparkSession, d: str) -> DataFrame:
    """A star is set once, unknown photos are left alone, and a star goes."""
    p = _measured(spark, d)
    stars = load(spark, d, "lineitem").filter("l_suppkey < 4").select(F.col("l_suppkey").alias("user_id"), F.col("l_orderkey").alias("photo_id"), F.lit(0).cast("long").alias("at")).distinct()
    out = maintenance.star(maintenance.star(stars, p, 9, 1, 5), p, 9, 1, 6)
    return maintenance.unstar(maintenance.star(out, p, 9, -3, 5), 1, 7).select("user_id", "photo_id")


# people, folders and stacks


@query(f"SELECT id, photo_id FROM {_FACES} WHERE person_id = 3 AND person_source = 'manual'")
def labelled_faces(spark: SparkSession, d: str) -> DataFrame:
    return people.labelled_faces(_faces(spark, d), 3, confirmed=True).select("id", "photo_id")


@query(f"SELECT * FROM (SELECT DISTINCT '/' || s[2] || '/' || s[3] AS path, s[3] AS name FROM (SELECT string_split(path, '/') AS s FROM {ORDERS})) WHERE starts_with(path, '/ASIA/')")
def child_folders(spark: SparkSession, d: str) -> DataFrame:
    r = folders.rollup(A.order_photos(spark, d))
    return folders.subfolders(r, "/ASIA").select("path", F.element_at(F.split("path", "/"), -1).alias("name"))


@query("SELECT path, added_at FROM (VALUES ('/a', 1), ('/b', 2), ('/c', 3)) AS v(path, added_at)")
def added_roots(spark: SparkSession, d: str) -> DataFrame:
    roots = spark.createDataFrame([("/a", 1, None), ("/b", 2, "B")], "path string, added_at long, name string")
    return maintenance.add_root(maintenance.add_root(roots, "/a", 9), "/c", 3).select("path", "added_at")


@query("SELECT * FROM (VALUES ('rules', '2'), ('seq', '7'), ('new', 'x')) AS v(key, value)")
def stored_values(spark: SparkSession, d: str) -> DataFrame:
    meta = spark.createDataFrame([("rules", "1"), ("seq", "7")], "key string, value string")
    return maintenance.put_value(maintenance.put_value(meta, "rules", "2"), "new", "x")


@query("SELECT doc_id AS id, CAST(length(text) AS BIGINT) AS overall FROM documents WHERE md5(text) = (SELECT md5(text) FROM documents GROUP BY 1 ORDER BY count(*) DESC, min(doc_id) LIMIT 1) ORDER BY 2 DESC, 1")
def stack_members(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("id"), F.length("text").cast("long").alias("overall"), F.md5(F.col("text").cast("binary")).alias("h"))
    tops = docs.groupBy("h").agg(F.min("id").alias("stack_top"), F.count("*").alias("n"))
    largest = tops.agg(F.min_by("stack_top", F.struct((-F.col("n")).alias("a"), "stack_top")).alias("t")).scalar()
    return grouping.stack_members(docs.join(tops, "h"), largest).select("id", "overall")


@query("SELECT DISTINCT o_custkey AS key FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)")
def gone_keys(spark: SparkSession, d: str) -> DataFrame:
    stored = load(spark, d, "orders").select(F.col("o_custkey").alias("key"))
    return maintenance.gone_keys(stored, load(spark, d, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("key")), "key")


# clean-ups

_UUID = "upper(substr(md5(text), 1, 8) || '-' || substr(md5(text), 9, 4) || '-' || substr(md5(text), 13, 4) || '-' || substr(md5(text), 17, 4) || '-' || substr(md5(text), 21, 12))"


def _library(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """documents as files of a library (even: originals, odd: the library's own copies), a face on each, judgements."""
    h, k = F.md5(F.col("text").cast("binary")), F.col("doc_id")
    uuid = F.upper(F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]))
    path = F.when(k % 2 == 0, F.concat(F.lit("/p/L.photoslibrary/originals/"), k.cast("string"), F.lit("/"), uuid, F.lit(".jpg"))).otherwise(F.concat(F.lit("/p/L.photoslibrary/resources/"), uuid, F.lit("_"), k.cast("string"), F.lit(".jpg")))
    photos = load(spark, d, "documents").select(k.alias("id"), path.alias("path"))
    copy = k % 2 == 1
    faces = load(spark, d, "documents").select(k.alias("id"), k.alias("photo_id"), F.lit(0.1).alias("x1"), F.lit(0.1).alias("y1"), F.lit(0.5).alias("x2"), F.lit(0.5).alias("y2"), F.when(copy, k % 7).alias("person_id"), F.when(copy, "manual").alias("person_source"))
    feedback = load(spark, d, "documents").filter("doc_id % 3 = 0").select((k + 1).alias("id"), k.alias("photo_id"))
    return photos, faces, feedback


_PAIRS = f"f AS (SELECT doc_id AS id, {_UUID} AS u FROM documents), pairs AS (SELECT c.id AS copy, arg_min(o.id, '/p/L.photoslibrary/originals/' || o.id || '/' || o.u || '.jpg') AS original FROM f c JOIN f o ON c.u = o.u AND o.id % 2 = 0 WHERE c.id % 2 = 1 GROUP BY 1)"


@query(
    f"""WITH {_PAIRS}, first AS (SELECT original, min(copy) AS copy FROM pairs GROUP BY 1),
names AS (SELECT f.id, CASE WHEN f.id % 2 = 1 THEN f.id % 7 WHEN first.copy IS NOT NULL THEN first.copy % 7 ELSE -1 END AS person FROM f LEFT JOIN first ON first.original = f.id WHERE f.id NOT IN (SELECT copy FROM pairs)),
judged AS (SELECT coalesce(original, doc_id) AS id, count(*) AS n FROM documents LEFT JOIN pairs ON copy = doc_id WHERE doc_id % 3 = 0 GROUP BY 1)
SELECT names.id, CAST(person AS BIGINT) AS person, coalesce(n, 0) AS judgements FROM names LEFT JOIN judged USING (id)"""
)
def cleaned_library(spark: SparkSession, d: str) -> DataFrame:
    """A library's copies go to their originals, with the names and judgements they carry."""
    out = cleanup.clean_libraries(*_library(spark, d))
    judged = out.feedback.groupBy(F.col("photo_id").alias("id")).agg(F.count("*").alias("judgements"))
    named = out.faces.select(F.col("photo_id").alias("id"), F.coalesce("person_id", F.lit(-1)).alias("person"))
    return out.photos.select("id").join(named, "id").join(judged, "id", "left").withColumn("judgements", F.coalesce("judgements", F.lit(0)))


@query(
    f"""WITH {_PAIRS} SELECT (SELECT count(*) FROM pairs) AS removed, (SELECT count(DISTINCT original) FROM pairs) AS labels_moved, (SELECT count(*) FROM pairs WHERE copy % 3 = 0) AS feedback_moved,
(SELECT count(*) FROM documents WHERE doc_id % 2 = 1 AND doc_id NOT IN (SELECT copy FROM pairs)) AS kept"""
)
def cleaned_library_report(spark: SparkSession, d: str) -> DataFrame:
    return cleanup.clean_libraries(*_library(spark, d)).report


@query(
    """WITH f AS (SELECT doc_id AS id, md5(text) AS h FROM documents), o AS (SELECT h, count(*) AS n, min(id) AS one FROM f WHERE id % 2 = 0 GROUP BY h),
c AS (SELECT f.id, n, one FROM f LEFT JOIN o USING (h) WHERE f.id % 2 = 1),
judged AS (SELECT doc_id AS id FROM documents WHERE doc_id % 3 = 0),
state AS (SELECT id, CASE WHEN n = 1 THEN 'twin' ELSE 'alone' END AS kind, id IN (SELECT id FROM judged) AS mine FROM c)
SELECT id FROM f WHERE id % 2 = 0 UNION ALL SELECT id FROM state WHERE kind = 'alone' AND mine"""
)
def cleaned_caches(spark: SparkSession, d: str) -> DataFrame:
    """Cache copies with one twin of their hash go; without one they stay only when they carry a judgement."""
    k = F.col("doc_id")
    where = F.when(k % 2 == 0, "/ok/").otherwise("/p/CaptureOne/")
    photos = load(spark, d, "documents").select(k.alias("id"), F.concat(where, k.cast("string"), F.lit(".jpg")).alias("path"), F.xxhash64("text").alias("phash"), F.lit(0).cast("long").alias("taken_at"), F.lit("").alias("camera_make"), F.lit("").alias("camera_model"))
    faces = spark.createDataFrame([], "id long, photo_id long, x1 double, y1 double, x2 double, y2 double, person_id long, person_source string")
    feedback = load(spark, d, "documents").filter("doc_id % 3 = 0").select((k + 1).alias("id"), k.alias("photo_id"))
    return cleanup.clean_app_caches(photos, faces, feedback).photos.select("id")


@query("SELECT a.doc_id AS path, b.doc_id AS other FROM documents a JOIN documents b ON a.text = b.text AND a.doc_id % 10 = 0 AND b.doc_id % 10 = 1")
def same_files(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "documents").select(F.col("doc_id").alias("path"), F.col("text").cast("binary").alias("content")).withColumn("size", F.octet_length("content").cast("long"))
    return same_content(rows.filter("path % 10 = 0"), rows.filter("path % 10 = 1"))


@query(
    """WITH b AS (SELECT l_orderkey AS photo, l_linenumber AS n, l_quantity AS q, l_suppkey AS s FROM lineitem), pairs AS (SELECT o_orderkey AS copy FROM orders WHERE o_orderkey % 2 = 1)
SELECT copy * 100 + 50 AS face_id, copy % 9 AS person_id FROM pairs"""
)
def moved_labels(spark: SparkSession, d: str) -> DataFrame:
    """The name on a copy's face moves to the original's face that overlaps it more; of two equal ones to the later."""
    c = load(spark, d, "orders").filter("o_orderkey % 2 = 1").select(F.col("o_orderkey").alias("k"))
    at = lambda x, n, photo, who, how: c.select((F.col("k") * 100 + n).alias("id"), (F.col("k") + photo).alias("photo_id"), F.lit(x).alias("x1"), F.lit(0.0).alias("y1"), F.lit(x + 0.4).alias("x2"), F.lit(0.4).alias("y2"), who.cast("long").alias("person_id"), F.lit(how).cast("string").alias("person_source"))
    none = F.lit(None)
    faces = at(0.0, 1, 0, F.col("k") % 9, "manual").unionByName(at(0.1, 40, 1_000_000, none, None)).unionByName(at(0.0, 49, 1_000_000, none, None)).unionByName(at(0.0, 50, 1_000_000, none, None))
    return matching.move_labels(c.select(F.col("k").alias("copy"), (F.col("k") + 1_000_000).alias("original")), faces)


# accounts


@query(
    """WITH i AS (SELECT o_orderkey AS token, 'N' || (o_custkey % 50) AS name, o_orderkey AS at FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderdate > TIMESTAMP '1997-01-01' AND o_orderkey % 2 = 0)
SELECT lower(name) AS name, min(token) AS token FROM i WHERE lower(name) NOT IN ('n7', 'n8') GROUP BY 1"""
)
def accepted_invites(spark: SparkSession, d: str) -> DataFrame:
    """Every second invite is accepted: a usable one makes an account, once a name, unless the name is in use."""
    o, k = load(spark, d, "orders"), F.col("o_orderkey")
    invites = o.select(k.cast("string").alias("token_hash"), F.concat(F.lit("N"), (F.col("o_custkey") % 50).cast("string")).alias("name"), F.lit("viewer").alias("role"), F.lit(None).cast("long").alias("user_id"), k.alias("created_at"), F.unix_timestamp("o_orderdate").alias("expires_at"), F.when(k % 3 == 0, 1).cast("long").alias("used_at"))
    users = spark.createDataFrame([(1, "n7", "admin", "x", 0, None), (2, "N8", "viewer", "y", 0, 5)], "id long, name string, role string, pw_hash string, created_at long, disabled_at long")
    sessions = spark.createDataFrame([], "token_hash string, user_id long")
    accepted = invites.filter(F.col("created_at") % 2 == 0).select("token_hash", F.concat(F.lit("pw"), "token_hash").alias("pw_hash"))
    _, made, _ = accounts.accept_invites(invites, users, sessions, accepted, 852076800)
    return made.filter("id > 2").select(F.lower("name").alias("name"), F.substring("pw_hash", 3, 20).cast("long").alias("token"))


@query("SELECT o_orderkey AS token FROM orders WHERE NOT (o_orderkey % 3 <> 0 AND o_orderkey % 5 = 0)")
def revoked_invites(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    invites = load(spark, d, "orders").select(k.alias("token_hash"), F.when(k % 3 == 0, 1).alias("used_at"))
    return accounts.revoke_invites(invites, invites.filter("token_hash % 5 = 0")).select(F.col("token_hash").alias("token"))


# values and their labels


@query(
    """SELECT c_custkey AS id, CASE WHEN abs(v) <= 90 THEN round(v * 1e6) / 1e6 ELSE -999 END AS degrees FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE -1 END * (c_custkey % 120 + (c_custkey % 60) / 60.0 + (c_nationkey * 2) / 3600.0) AS v FROM customer)"""
)
def gps_degrees(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    v = times.gps_degrees((k % 120).cast("double"), (k % 60).cast("double"), (F.col("c_nationkey") * 2).cast("double"), F.when(k % 2 == 0, "N").otherwise("s"), 90)
    return load(spark, d, "customer").select(k.alias("id"), F.coalesce(_r6(v), F.lit(-999.0)).alias("degrees"))


@query(
    """SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN p_brand || ' ' || p_type WHEN 1 THEN p_type ELSE lower(p_brand) || ' Z' END AS lens,
  CASE WHEN p_size % 2 = 0 THEN p_size || '-' || (p_size + 50) ELSE '' || p_size END || 'mm f/' || CASE WHEN p_size % 2 = 0 THEN '2.8-4' ELSE '1.5' END AS span FROM part"""
)
def lens_labels(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("p_partkey"), F.col("p_size")
    make = F.when(k % 3 == 1, "").otherwise(F.col("p_brand"))
    model = F.when(k % 3 == 2, F.concat(F.lower("p_brand"), F.lit(" Z"))).otherwise(F.col("p_type"))
    even = n % 2 == 0
    span = times.lens_range(n, F.when(even, n + 50).otherwise(n), F.when(even, 2.8).otherwise(1.5), F.when(even, 4.0).otherwise(1.5))
    return load(spark, d, "part").select(k.alias("id"), times.lens_name(make, model).alias("lens"), span.alias("span"))


@query("SELECT p_partkey AS id, lower(p_name) AS key, lower(p_name) || ' & ' || lower(p_brand) AS caption FROM part")
def name_keys(spark: SparkSession, d: str) -> DataFrame:
    caption = F.concat("p_name", F.lit("  &amp;amp; \n "), "p_brand")
    return load(spark, d, "part").select(F.col("p_partkey").alias("id"), text.name_key(F.col("p_name")).alias("key"), text.clean_text(caption).alias("caption"))


# vectors

_Q8 = """q AS (SELECT vec_id AS id, s / 127.0 AS scale, list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * (127.0 / s)) AS DOUBLE)) AS q FROM (SELECT *, list_max(list_transform(embedding, lambda y: abs(CAST(y AS DOUBLE)))) AS s FROM embeddings))"""


@query(f"WITH {_Q8} SELECT a.id, round(list_inner_product(a.q, b.q) * a.scale * b.scale * 1e6) / 1e6 AS score FROM q a, q b WHERE b.id = 7")
def quantised_scores(spark: SparkSession, d: str) -> DataFrame:
    v = A.vectors(spark, d).select("id", vectors.quantise(F.col("embedding")).alias("z"))
    z = v.filter("id = 7").first()["z"]
    probe = F.struct(F.lit(z["q"]).alias("q"), F.lit(z["scale"]).alias("scale"))
    return v.select("id", _r6(vectors.dot_quantised(F.col("z"), probe)).alias("score"))


@query(
    """SELECT vec_id AS id, round(list_sum(list_transform(embedding, lambda x: CASE WHEN x = 0 THEN 0.0 ELSE round(CAST(x AS DOUBLE) / pow(2, greatest(floor(log2(abs(CAST(x AS DOUBLE)))), -14) - 10)) * pow(2, greatest(floor(log2(abs(CAST(x AS DOUBLE)))), -14) - 10) END)) * 1e6) / 1e6 AS total FROM embeddings"""
)
def half_floats(spark: SparkSession, d: str) -> DataFrame:
    """Vectors stored as half floats and read back: eleven bits of each component, halves rounded up."""
    back = vectors.decode_half(vectors.encode_half(F.col("embedding").cast("array<float>")))
    return A.vectors(spark, d).select("id", back.alias("v")).select("id", _r6(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double"))).alias("total"))


@query("SELECT vec_id AS id, vec_id % 3 = 0 AS changed FROM embeddings WHERE vec_id % 5 <> 0 UNION ALL SELECT vec_id + 1000000, true FROM embeddings WHERE vec_id % 50 = 0")
def vector_upkeep(spark: SparkSession, d: str) -> DataFrame:
    """Changed vectors replaced, new ones added, deleted ones gone."""
    v = A.vectors(spark, d).select("id", "embedding", F.lit(False).alias("changed"))
    new = v.filter("id % 3 = 0").unionByName(v.filter("id % 50 = 0").withColumn("id", F.col("id") + 1_000_000)).withColumn("changed", F.lit(True))
    return vector_search.upsert_vectors(v, new, v.filter("id % 5 = 0 and id < 1000000").select("id")).select("id", "changed")


@query(f"SELECT a.vec_id AS id, a.label, row_number() OVER (ORDER BY {_DOT} DESC, a.vec_id) AS rank FROM embeddings a, embeddings b WHERE b.vec_id = 5 QUALIFY rank <= 20 ORDER BY rank")
def ranked_rows(spark: SparkSession, d: str) -> DataFrame:
    """Full rows of the best hits, in their order."""
    v = A.vectors(spark, d)
    hits = vector_search.knn_many(v, v.filter("id = 5"), 20).select("id", F.col("rank").cast("long").alias("rank"))
    return vector_search.in_rank_order(hits, v).select("id", "label", "rank")


@query(f"SELECT a.vec_id // 2 AS photo_id, arg_max(a.vec_id, ({_DOT}, -a.vec_id)) AS face_id, round(max({_DOT}) * 1e6) / 1e6 AS score FROM embeddings a, embeddings b WHERE b.vec_id = 12 AND {_DOT} >= 0.1 GROUP BY 1 ORDER BY max({_DOT}) DESC, 1 LIMIT 15")
def search_by_example(spark: SparkSession, d: str) -> DataFrame:
    """An example picture with three faces; the largest decides."""
    size = F.when(F.col("id") == 12, 0.5).otherwise(0.2)
    example = A.vectors(spark, d).filter("id in (11, 12, 13)").select(F.col("id").alias("ordinal"), F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), size.alias("x2"), size.alias("y2"), "embedding")
    hits = vector_search.search_by_example(A.face_rows(spark, d), example, 15, 0.1)
    return hits.withColumn("score", _r6(F.col("score")))


# measures of an experiment


@query(
    """WITH r AS (SELECT p_size % 3 = 0 AS hit, p_retailprice AS s FROM part), l AS (SELECT s, count(*) FILTER (WHERE hit) AS p, count(*) FILTER (WHERE NOT hit) AS n FROM r GROUP BY s),
b AS (SELECT *, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM l) SELECT round(sum(p * (below + n / 2.0)) / (sum(p) * sum(n)) * 1e6) / 1e6 AS auc FROM b"""
)
def ranking_auc(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "part").select((F.col("p_size") % 3 == 0).alias("hit"), F.col("p_retailprice").alias("s"))
    return training.roc_auc(p, "s", "hit").select(_r6(F.col("auc")).alias("auc"))


@query(
    """WITH r AS (SELECT p_partkey % 5 AS f, p_size AS s, (p_size + p_partkey % 17) > 30 AS y FROM part), t AS (SELECT DISTINCT s FROM r), k AS (SELECT DISTINCT f FROM r),
tried AS (SELECT k.f, t.s AS threshold, sum(CASE WHEN (r.s >= t.s) = r.y THEN 1 ELSE 0 END) AS ok FROM k, t, r WHERE r.f <> k.f AND t.s IN (SELECT s FROM r x WHERE x.f <> k.f) GROUP BY 1, 2),
best AS (SELECT f, arg_max(threshold, (ok, -threshold)) AS threshold FROM tried GROUP BY f)
SELECT best.f AS fold, threshold, round(avg(CASE WHEN (r.s >= threshold) = r.y THEN 1.0 ELSE 0.0 END) * 1e6) / 1e6 AS accuracy FROM best JOIN r ON r.f = best.f GROUP BY 1, 2"""
)
def threshold_folds(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("p_partkey"), F.col("p_size")
    rows = load(spark, d, "part").select((k % 5).alias("f"), n.alias("s"), ((n + k % 17) > 30).alias("y"))
    return training.threshold_accuracy(rows, "s", "y", "f").withColumn("accuracy", _r6(F.col("accuracy")))


@query("SELECT o_orderkey AS image, CAST(o_orderkey * 10 + n AS BIGINT) AS id, n = 1 OR (n = 2 AND o_orderkey % 2 = 0) AS hit FROM orders, (VALUES (1), (2)) AS v(n)")
def detected_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Two annotated boxes a picture; one detection overlaps both, a second only in every other picture."""
    k = load(spark, d, "orders").select(F.col("o_orderkey").alias("image"))
    at = lambda rows, n, x: rows.select("image", (F.col("image") * 10 + n).alias("id"), F.lit(x).alias("x1"), F.lit(0.0).alias("y1"), F.lit(x + 1.0).alias("x2"), F.lit(1.0).alias("y2"))
    truth = at(k, 1, 0.0).unionByName(at(k, 2, 0.2))
    found = at(k, 5, 0.1).unionByName(at(k.filter("image % 2 = 0"), 6, 0.3)).unionByName(at(k, 7, 5.0))
    return training.detection_recall(truth, found)
