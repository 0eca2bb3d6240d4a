"""Queries over sessions, groups, duplicates, folders and streams of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photonlake.functions.scores import round_to
from photonlake.operators import folders, grouping, sessions
from photonlake.operators.filters import Filter, apply_filter
from photonlake.plans import adapters as A
from photonlake.plans.browse import EVENTS, HASHES, ORDERS
from photonlake.session import load

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Gaps that give bursts and scenes on the test events (median step 7.5 hours).
BURST_GAP, SCENE_GAP = 4 * 3600, 12 * 3600


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


_RUNS = f"""ev AS (SELECT * FROM {EVENTS}),
steps AS (SELECT *, taken_at - lag(taken_at) OVER (PARTITION BY camera_model ORDER BY taken_at, id) AS step FROM ev WHERE taken_at <> 0),
runs AS (SELECT *, sum(CASE WHEN step > {BURST_GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY camera_model ORDER BY taken_at, id) AS run,
               sum(CASE WHEN step > {SCENE_GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY camera_model ORDER BY taken_at, id) AS scene FROM steps),
bursts AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY camera_model, run) >= 2 THEN min(id) OVER (PARTITION BY camera_model, run) ELSE 0 END AS burst_id FROM runs)"""

_SUMMARY = """min(taken_at) AS start_at, max(taken_at) AS end_at, coalesce(min(CASE WHEN taken_at <> 0 THEN taken_at END), 0) AS oldest_at,
  arg_max(id, (overall, -id)) AS best_id, max(overall) AS best_overall, min(overall) AS min_overall, greatest(0, max(overall * 2)) AS max_technical, greatest(0, max(overall % 10)) AS max_aesthetic,
  greatest(0, max((CAST(floor(overall % 7) AS DOUBLE), overall % 3))[1]) AS max_focus, greatest(0, max((CAST(floor(overall % 7) AS DOUBLE), overall % 3))[2]) AS focus_sharp, greatest(0, max(overall % 11)) AS max_colorful,
  CAST(greatest(0, max((id % 5, overall))[1]) AS INTEGER) AS max_faces, greatest(0, max((id % 5, overall))[2]) AS faces_overall, count(*) FILTER (WHERE source = 3) AS memes"""


def _bursts(spark: SparkSession, d: str) -> DataFrame:
    return sessions.scenes_and_bursts(A.event_groups(spark, d), ["camera_make", "camera_model"], BURST_GAP, SCENE_GAP)


@query(f"WITH {_RUNS} SELECT id, camera_model, CAST(run AS BIGINT) AS run, CAST(scene AS BIGINT) AS scene, burst_id FROM bursts")
def sessionise_bursts(spark: SparkSession, d: str) -> DataFrame:
    return _bursts(spark, d).select("id", "camera_model", "run", "scene", "burst_id")


@query(f"WITH {_RUNS} SELECT burst_id AS id, count(*) AS size, any_value(camera_model) AS camera, array_to_string(list_sort(list(id)), ',') AS members, {_SUMMARY} FROM bursts WHERE burst_id <> 0 GROUP BY burst_id")
def group_summary(spark: SparkSession, d: str) -> DataFrame:
    g = grouping.group_summary(_bursts(spark, d).filter("burst_id <> 0"), ["burst_id"]).withColumnRenamed("burst_id", "id")
    return g.withColumn("members", F.array_join(F.transform("members", lambda x: x.cast("string")), ","))


@query(
    f"""WITH {_RUNS}, g AS (SELECT burst_id AS id, count(*) AS size, max(taken_at) AS end_at, min(overall) AS min_overall FROM bursts WHERE burst_id <> 0 GROUP BY 1)
SELECT id, size, end_at, min_overall FROM g WHERE size >= 3 AND EXISTS (SELECT 1 FROM bursts b WHERE b.burst_id = g.id AND b.overall >= 30 AND b.source <> 3) ORDER BY min_overall, id DESC LIMIT 41"""
)
def group_page_filtered(spark: SparkSession, d: str) -> DataFrame:
    b = _bursts(spark, d).filter("burst_id <> 0")
    g = grouping.group_summary(b, ["burst_id"]).withColumnRenamed("burst_id", "id")
    match = apply_filter(b, Filter(min_overall=30, source="photos")).select("id")
    return grouping.group_page(g, b.select(F.col("burst_id").alias("id"), F.col("id").alias("photo_id")), match, "worst", 3, 40).select("id", "size", "end_at", "min_overall")


def _page(name: str, sort: str, sql_order: str):
    @query(f"WITH {_RUNS}, g AS (SELECT burst_id AS id, count(*) AS size, {_SUMMARY} FROM bursts WHERE burst_id <> 0 GROUP BY 1) SELECT id, size FROM g WHERE size >= 2 ORDER BY {sql_order}, id DESC LIMIT 26 OFFSET 25")
    def run(spark: SparkSession, d: str) -> DataFrame:
        b = _bursts(spark, d).filter("burst_id <> 0")
        g = grouping.group_summary(b, ["burst_id"]).withColumnRenamed("burst_id", "id")
        return grouping.group_page(g, b, None, sort, 2, 25, 25).select("id", "size")

    QUERIES[name], ORACLES[name] = QUERIES.pop("run"), ORACLES.pop("run")


_page("group_page_best", "overall", "best_overall DESC")
_page("group_page_newest", "newest", "end_at DESC")
_page("group_page_oldest", "oldest", "(oldest_at = 0), oldest_at")
_page("group_page_sharpness", "sharpness", "max_focus DESC, focus_sharp DESC")
_page("group_page_faces", "faces", "max_faces DESC, faces_overall DESC")


@query(f"WITH {_RUNS} SELECT id, overall, burst_id FROM bursts WHERE burst_id = (SELECT min(burst_id) FROM bursts WHERE burst_id > 100) ORDER BY overall DESC, id")
def group_members(spark: SparkSession, d: str) -> DataFrame:
    b = _bursts(spark, d)
    first = b.filter("burst_id > 100").agg(F.min("burst_id").alias("first")).scalar()
    members = b.select(F.col("burst_id").alias("id"), F.col("id").alias("photo_id"))
    return grouping.group_members(members, b, first).select("id", "overall", "burst_id")


def _chunks(limit: int) -> str:
    """Frames with the chunk of their scene: bursts packed one after another up to the limit."""
    return f"""{_RUNS}, n AS (SELECT camera_model, scene, run, count(*) AS n, sum(count(*)) OVER (PARTITION BY camera_model, scene) AS total FROM bursts GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY camera_model, scene ORDER BY run) AS k FROM n WHERE total > {limit}),
c AS (SELECT camera_model, scene, CAST(NULL AS HUGEINT) AS run, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS at, CAST(0 AS BIGINT) AS filled, CAST(0 AS BIGINT) AS chunk FROM r WHERE k = 1
  UNION ALL SELECT c.camera_model, c.scene, r.run, r.k, CASE WHEN r.n > {limit} THEN c.at + CAST(c.filled > 0 AS BIGINT) WHEN c.filled + r.n > {limit} THEN c.at + 1 ELSE c.at END,
    CASE WHEN r.n > {limit} THEN 0 WHEN c.filled + r.n > {limit} THEN r.n ELSE c.filled + r.n END, CASE WHEN r.n > {limit} THEN -1 WHEN c.filled + r.n > {limit} THEN c.at + 1 ELSE c.at END
  FROM c JOIN r ON r.camera_model = c.camera_model AND r.scene = c.scene AND r.k = c.k + 1),
packed AS (SELECT b.*, coalesce(c.chunk, 0) AS chunk FROM bursts b LEFT JOIN c ON c.camera_model = b.camera_model AND c.scene = b.scene AND c.run = b.run)"""


@query(f"WITH RECURSIVE {_chunks(8)} SELECT id, camera_model, CAST(scene AS BIGINT) AS scene, CAST(run AS BIGINT) AS run, chunk FROM packed")
def scene_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of at most 8 frames, packed one burst after another."""
    keys = ["camera_make", "camera_model"]
    return sessions.pack_chunks(_bursts(spark, d), keys, 8).select("id", "camera_model", "scene", "run", "chunk")


_NEAR = "bit_count(xor(o.hi, rest[1].hi)) + bit_count(xor(o.lo, rest[1].lo))"


@query(
    f"""WITH RECURSIVE {HASHES}, {_chunks(1000)},
frames AS (SELECT p.*, h.hi, h.lo FROM packed p JOIN h ON h.id = p.id WHERE h.hi <> 0 OR h.lo <> 0),
s AS (SELECT camera_model, scene, chunk, list({{id: id, hi: hi, lo: lo}} ORDER BY overall DESC, id) AS rest, CAST(NULL AS BIGINT[]) AS near FROM frames WHERE chunk >= 0 GROUP BY 1, 2, 3
  UNION ALL SELECT camera_model, scene, chunk, list_filter(rest[2:], lambda o: {_NEAR} > 24), list_transform(list_filter(rest, lambda o: {_NEAR} <= 24), lambda o: o.id) FROM s WHERE len(rest) > 0),
stacks AS (SELECT near[1] AS stack_top, len(near) AS stack_size, unnest(near) AS id FROM s WHERE len(near) > 1),
sets AS (SELECT id, CASE WHEN count(*) OVER (PARTITION BY hi, lo) > 1 THEN min(id) OVER (PARTITION BY hi, lo) ELSE 0 END AS dup_id FROM frames)
SELECT p.id, p.burst_id, coalesce(stack_top, 0) AS stack_top, coalesce(stack_size, 0) AS stack_size, coalesce(p.id <> stack_top, false) AS stacked, coalesce(dup_id, 0) AS dup_id
FROM packed p LEFT JOIN stacks ON stacks.id = p.id LEFT JOIN sets ON sets.id = p.id"""
)
def regroup(spark: SparkSession, d: str) -> DataFrame:
    """Bursts, stacks and duplicate sets of the whole catalogue, as a changed photo row each."""
    p = A.event_groups(spark, d).join(A.hashed_vectors(spark, d).select("id", "phash"), "id", "left").withColumn("phash", F.coalesce("phash", F.lit(0)))
    columns, _ = grouping.regroup(p, BURST_GAP, 24, SCENE_GAP)
    return columns


@query("SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY md5(text)) AS dup_id FROM documents QUALIFY count(*) OVER (PARTITION BY md5(text)) > 1")
def duplicate_sets(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "documents").select(F.col("doc_id").alias("id"), F.md5(F.col("text").cast("binary")).alias("phash"))
    return grouping.duplicate_sets(p)


@query(
    """WITH h AS (SELECT doc_id AS id, md5(text) AS h, length(text) AS n FROM documents), g AS (SELECT *, min(id) OVER (PARTITION BY h) AS top, count(*) OVER (PARTITION BY h) AS k FROM h),
r AS (SELECT *, row_number() OVER (ORDER BY n DESC, id) AS rank FROM g)
SELECT id, n FROM (SELECT *, row_number() OVER (PARTITION BY CASE WHEN k > 1 THEN top ELSE -id - 1 END ORDER BY rank) AS m FROM r) WHERE m = 1 ORDER BY n DESC, id LIMIT 30"""
)
def stack_collapse(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("id"), F.length("text").cast("long").alias("n"), F.md5(F.col("text").cast("binary")).alias("h"))
    tops = docs.groupBy("h").agg(F.min("id").alias("top"), F.count("*").alias("k"))
    hits = docs.join(tops, "h").select("id", "n", F.when(F.col("k") > 1, F.col("top") + 1).otherwise(0).alias("stack_top"), F.struct((-F.col("n")).alias("a"), F.col("id").alias("b")).alias("rank"))
    return grouping.first_per_stack(hits).select("id", "n").orderBy(F.desc("n"), "id").limit(30)


_FOLDERS = f"""p AS (SELECT *, string_split(path, '/') AS s FROM {ORDERS}),
up AS (SELECT '/' AS folder, * FROM p UNION ALL SELECT '/' || s[2], * FROM p UNION ALL SELECT '/' || s[2] || '/' || s[3], * FROM p UNION ALL SELECT '/' || s[2] || '/' || s[3] || '/' || s[4], * FROM p)"""


@query(
    f"""WITH {_FOLDERS} SELECT folder AS path, CASE WHEN folder = '/' THEN '' WHEN len(string_split(folder, '/')) = 2 THEN '/' ELSE regexp_replace(folder, '/[^/]*$', '') END AS parent, count(*) AS total,
  arg_max(id, (coalesce(overall, 0) - CASE WHEN source = 3 THEN 1000 ELSE 0 END, -id)) AS cover_id, max(coalesce(overall, 0) - CASE WHEN source = 3 THEN 1000 ELSE 0 END) AS cover_overall,
  coalesce(max(CASE WHEN taken_at <> 0 THEN taken_at END), 0) AS newest_at, count(overall) AS scored, round(sum(overall) * 100) / 100 AS score_sum, count(*) FILTER (WHERE source = 3) AS memes, round(sum(overall) / count(overall) * 1e4) / 1e4 AS mean
FROM up GROUP BY folder"""
)
def folder_rollup(spark: SparkSession, d: str) -> DataFrame:
    r = folders.rollup(A.order_photos(spark, d))
    mean = round_to(folders.average_score(F.col("score_sum"), F.col("scored")), 4)
    return r.withColumn("mean", mean).withColumn("score_sum", round_to(F.col("score_sum"), 2))


@query(
    f"""WITH {_FOLDERS}, g AS (SELECT * FROM (VALUES (1, '/ASIA'), (2, '/ASIA/NATION_12'), (3, '/EUROPE'), (3, '/AFRICA'), (4, '/NOWHERE')) AS v(grp, dir)),
m AS (SELECT DISTINCT grp, id, overall FROM up JOIN g ON folder = dir) SELECT grp, id, overall FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY overall DESC NULLS LAST, id) AS k FROM m) WHERE k = 1"""
)
def best_per_folder(spark: SparkSession, d: str) -> DataFrame:
    groups = spark.createDataFrame([(1, "/ASIA"), (2, "/ASIA/NATION_12/"), (3, "/EUROPE"), (3, "/AFRICA"), (4, "/NOWHERE")], "grp int, dir string")
    return folders.best_per_group(A.order_photos(spark, d), groups).select("grp", "id", "overall")


@query(f"WITH {_FOLDERS} SELECT folder AS grp, id, taken_at FROM (SELECT folder, id, taken_at, row_number() OVER (PARTITION BY folder ORDER BY (taken_at > 0) DESC, taken_at, id) AS k FROM up WHERE len(string_split(folder, '/')) = 3) WHERE k = 1")
def oldest_per_subfolder(spark: SparkSession, d: str) -> DataFrame:
    p = A.order_photos(spark, d)
    r = folders.rollup(p).filter(F.size(F.split("path", "/")) == 3).select(F.col("path").alias("grp"), F.col("path").alias("dir"))
    return folders.best_per_group(p, r, "oldest").select("grp", "id", "taken_at")


@query(f"WITH {_FOLDERS}, f AS (SELECT folder, count(*) AS total, coalesce(max(CASE WHEN taken_at <> 0 THEN taken_at END), 0) AS newest_at FROM up WHERE len(string_split(folder, '/')) = 3 GROUP BY 1) SELECT folder AS path, total, newest_at FROM f ORDER BY (newest_at = 0), newest_at DESC, lower(string_split(folder, '/')[3]), folder LIMIT 12")
def album_cards(spark: SparkSession, d: str) -> DataFrame:
    r = folders.rollup(A.order_photos(spark, d)).filter(F.size(F.split("path", "/")) == 3)
    return r.orderBy(*folders.card_order("newest")).limit(12).select("path", "total", "newest_at")


@query(f"WITH {_FOLDERS} SELECT s[2] AS album, count(*) AS total, round(sum(overall) * 100) / 100 AS score_sum, count(overall) AS scored, coalesce(max(CASE WHEN taken_at <> 0 THEN taken_at END), 0) AS newest_at FROM p GROUP BY 1")
def merged_albums(spark: SparkSession, d: str) -> DataFrame:
    r = folders.rollup(A.order_photos(spark, d)).filter(F.size(F.split("path", "/")) == 3).withColumn("album", F.split("path", "/")[1])
    return folders.merge_folders(r, "album").select("album", "total", round_to(F.col("score_sum"), 2).alias("score_sum"), "scored", "newest_at")


@query("SELECT * FROM (VALUES ('/a'), ('/b/c'), ('/b2')) AS v(path)")
def outermost_folders(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(x,) for x in ("/a", "/a/x", "/a/x/y", "/b/c", "/b/c/d", "/b2")], "path string")
    return folders.outermost(rows)


@query(
    """SELECT page_id, folder FROM (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, url, unnest([regexp_extract(url, '^https?://([^/]+)', 1)]) AS folder FROM pages)"""
)
def page_hosts(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("folder"))


@query(f"SELECT '/' || r_name || '/' || n_name || '/' || c_mktsegment AS folder, count(*) FILTER (WHERE o_orderkey % 7 = 0) AS missing, count(*) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def missing_by_folder(spark: SparkSession, d: str) -> DataFrame:
    p = A.order_photos(spark, d).select("path", (F.col("id") % 7 == 0).alias("missing"))
    return folders.missing_by_folder(p)
