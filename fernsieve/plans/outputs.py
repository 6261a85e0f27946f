"""Queries over what leaves the library: documents, sentences, sessions, and the whole pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernsieve.functions import imaging, rasters
from fernsieve.operators import album_export as albums_out
from fernsieve.operators import exports, pipeline, scoring, sentences
from fernsieve.plans.catalogue import WEIGHED, query
from fernsieve.plans.staging import stage_table
from fernsieve.plans.views import view
from fernsieve.schema import TYPE_FLAGS, ClusterSettings
from fernsieve.sources import demo

BOX = (819, 526)


@query(sql="""WITH r AS (SELECT vec_id AS id, [(vec_id * 31 + i * i * 7 + i * 13) % 256 FOR i IN range(72)] AS p, 2 + vec_id % 7 AS w, 1 + vec_id % 9 AS h FROM embeddings),
v AS (SELECT id, 4 * p[y * 8 + x + 1] - p[y * 8 + x] - p[y * 8 + x + 2] - p[y * 8 + x - 7] - p[y * 8 + x + 9] AS v FROM r, range(1, 8) a(y), range(1, 8) b(x) WHERE y < h - 1 AND x < w - 1)
SELECT r.id, round(coalesce(var_pop(v), 0), 4) AS variance FROM r LEFT JOIN v USING (id) GROUP BY r.id""")
def laplacian_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = F.expr("transform(sequence(0, 71), i -> (vec_id * 31 + i * i * 7 + i * 13) % 256)")
    made = view(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), pixels.alias("p"), (2 + F.col("vec_id") % 7).alias("w"), (1 + F.col("vec_id") % 9).alias("h"))
    return made.select("id", F.round(rasters.laplacian_variance(rasters.packed(F.col("p")), F.col("w"), F.col("h"), F.lit(8)), 4).alias("variance"))


@query(sql="""WITH b AS (SELECT doc_id AS id, hex(encode(text)) AS x, cast(length(hex(encode(text))) // 96 AS bigint) AS h FROM documents),
r AS (SELECT id, h, [('0x' || substr(x, 2 * i + 1, 2))::int FOR i IN range(48 * h)] AS p FROM b WHERE x IS NOT NULL),
v AS (SELECT id, 4 * p[y * 48 + x + 1] - p[y * 48 + x] - p[y * 48 + x + 2] - p[y * 48 + x - 47] - p[y * 48 + x + 49] AS v FROM (SELECT id, p, unnest(range(1, h - 1)) AS y FROM r WHERE h > 2), range(1, 47) a(x)),
d AS (SELECT id, var_pop(v) AS laplacian FROM v GROUP BY id)
SELECT b.id, b.h AS height, CASE WHEN r.id IS NOT NULL THEN round(coalesce(d.laplacian, 0), 4) END AS laplacian, CASE WHEN r.h > 0 THEN round(list_sum(p) / (len(p) * 255.0::double), 9) WHEN r.h = 0 THEN 0 END AS luma,
  CASE WHEN r.h > 0 THEN len(list_filter(p, lambda x: x <= 3)) / len(p)::double WHEN r.h = 0 THEN 0 END AS shadow, CASE WHEN r.h > 0 THEN len(list_filter(p, lambda x: x >= 252)) / len(p)::double WHEN r.h = 0 THEN 0 END AS highlight
FROM b LEFT JOIN r ON r.id = b.id LEFT JOIN d ON d.id = b.id""")
def text_rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detail and exposure of every text's bytes, taken as a raster 48 wide; both from one pass."""
    made = view(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.encode("text", "utf-8").alias("pixels"))
    made = made.withColumn("height", F.floor(F.octet_length("pixels") / 48))
    got = made.select("id", "height", rasters.raster_measures(F.col("pixels"), F.lit(48), F.col("height"), F.lit(48)).alias("m"))
    return got.select("id", "height", F.round("m.laplacian", 4).alias("laplacian"), F.round("m.luma", 9).alias("luma"), "m.shadow", "m.highlight")


ENTRY = "json_object('count', count(*), 'size_bytes', cast(coalesce(sum(filesize), 0) AS bigint))"
HAS = {"screenshot", "screen_recording", "burst", "selfie"}
BY_TYPE = " UNION ALL ".join(f"SELECT '{t}' AS k, json_object('count', count(*) FILTER ({c}), 'size_bytes', cast(coalesce(sum(filesize) FILTER ({c}), 0) AS bigint)) AS v FROM records" for t in sorted(TYPE_FLAGS) for c in [f"is_{t}" if t in HAS else "false"])
BY_BAND = " UNION ALL ".join(
    f"SELECT '{name}' AS k, json_object('count', count(*) FILTER ({c}), 'size_bytes', cast(coalesce(sum(filesize) FILTER ({c}), 0) AS bigint)) AS v FROM records"
    for name, low, high in (("30s-2m", 30, 120), ("5-30s", 5, 30), ("<5s", None, 5), (">2m", 120, None))
    for c in [" AND ".join(["is_video AND duration_seconds IS NOT NULL", *([f"duration_seconds >= {low}"] if low else []), *([f"duration_seconds < {high}"] if high else [])])]
)


@query("records", sql=f"""&
runs AS (SELECT sum(CASE WHEN date - before < INTERVAL 90 SECOND THEN 0 ELSE 1 END) OVER (ORDER BY date, uuid) AS run FROM (SELECT *, lag(date) OVER (ORDER BY date, uuid) AS before FROM records WHERE date IS NOT NULL)),
y AS (SELECT cast(year(date) AS varchar) AS k, {ENTRY} AS v FROM records WHERE date IS NOT NULL GROUP BY 1), t AS ({BY_TYPE}), b AS ({BY_BAND})
SELECT cast(json_object('items', count(*), 'photos', count(*) FILTER (NOT is_video), 'videos', count(*) FILTER (is_video), 'size_bytes', cast(coalesce(sum(filesize), 0) AS bigint),
  'favorites', count(*) FILTER (is_favorite), 'no_album', count(*) FILTER (album_count = 0), 'hidden', count(*) FILTER (is_hidden),
  'by_year', (SELECT json_group_object(k, v) FROM (SELECT * FROM y ORDER BY k)), 'by_type', (SELECT json_group_object(k, v) FROM (SELECT * FROM t ORDER BY k)), 'by_duration', (SELECT json_group_object(k, v) FROM (SELECT * FROM b ORDER BY k)),
  'near_duplicate_runs', (SELECT count(*) FROM (SELECT run FROM runs GROUP BY run HAVING count(*) >= 2))) AS varchar) AS document FROM records""")
def audit_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.audit_document(view(spark, sf_dir, "records"), date="date")


@query("vectors", sql="""&
w AS (SELECT bucket_id, min(uuid) AS winner FROM vectors GROUP BY bucket_id), b AS (SELECT v.bucket_id, winner, embedding AS best FROM vectors v JOIN w ON v.bucket_id = w.bucket_id AND uuid = winner)
SELECT v.bucket_id AS cluster_id, uuid, CASE WHEN uuid <> winner THEN round(sqrt(list_sum([pow(cast(x[1] AS double) - cast(x[2] AS double), 2) FOR x IN list_zip(embedding, best)])), 5) END AS distance_to_winner
FROM vectors v JOIN b ON v.bucket_id = b.bucket_id""")
def distances_to_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = view(spark, sf_dir, "vectors").withColumnRenamed("bucket_id", "cluster_id")
    winners = vectors.groupBy("cluster_id").agg(F.min("uuid").alias("winner"))
    got = exports.winner_distances(vectors.join(winners, "cluster_id"))
    return got.select("cluster_id", "uuid", F.round("distance_to_winner", 5).alias("distance_to_winner"))


@query("sub_scores", sql="""SELECT cluster_id, cast(to_json(list({'member_ord': cast(uuid AS bigint), 'uuid': uuid, 'width': width} ORDER BY cast(uuid AS bigint))) AS varchar) AS members FROM sub_scores GROUP BY cluster_id""")
def members_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = view(spark, sf_dir, "sub_scores").select("cluster_id", F.col("uuid").cast("bigint").alias("member_ord"), "uuid", "width")
    nested = exports.nested_members(exports.without_paths(members.withColumn("derivative_path", F.lit("/d"))))
    return nested.select("cluster_id", F.to_json("members", exports.WHOLE).alias("members"))


@query("sub_scores", sql="SELECT cluster_id, uuid, sharpness, exposure, faces, cast(NULL AS double) AS facing FROM sub_scores")
def payload_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = view(spark, sf_dir, "sub_scores")
    payload = exports.encode_payload(exports.score_photo({n: F.col(n) for n in ("sharpness", "exposure", "faces")}))
    kind = ", ".join(f"{n} double" for n in exports.WEIGHTS)
    back = scores.select("cluster_id", "uuid", payload.alias("payload")).withColumn("s", exports.decode_payload(F.col("payload"), kind))
    return back.select("cluster_id", "uuid", "s.sharpness", "s.exposure", "s.faces", "s.facing")


@query("sub_scores", sql="""&
s AS (SELECT cluster_id, count(*) AS size FROM sub_scores GROUP BY cluster_id)
SELECT count(*) AS clusters, count(*) FILTER (cluster_id % 2 = 0) AS sampled, cast(coalesce(sum(size), 0) AS bigint) AS photos_in_clusters, cast(coalesce(sum(size - 1), 0) AS bigint) AS culled_photos,
  cast(coalesce(sum(size - 1) FILTER (cluster_id % 2 = 0), 0) AS bigint) AS culled_photos_sampled FROM s""")
def sample_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = view(spark, sf_dir, "sub_scores").groupBy("cluster_id").agg(F.count("*").alias("size"))
    return exports.population(sizes, sizes.where("cluster_id % 2 = 0"))


@query("sizes", sql=f"""SELECT id, round(greatest(width / {BOX[0]}.0, height / {BOX[1]}.0), 6) AS scale, greatest(width / {BOX[0]}.0, height / {BOX[1]}.0) >= 1.05 AS useful, width > 1350 AS unlike FROM sizes""")
def display_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    scale = imaging.largest_scale(F.col("width"), F.col("height"), F.lit(BOX[0]), F.lit(BOX[1]))
    return view(spark, sf_dir, "sizes").select("id", F.round(scale, 6).alias("scale"), imaging.can_magnify(F.array(scale, F.lit(None))).alias("useful"), imaging.unlike_widths(F.array(F.col("width"), F.lit(1000))).alias("unlike"))


@query()
def evidence_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.evidence(view(spark, sf_dir, "sub_scores").select("cluster_id", "uuid", *WEIGHED), WEIGHED)


@query("sub_scores", sql="""&
d AS (SELECT cluster_id, count(sharpness) < count(*) AS s, count(faces) < count(*) AS f, count(exposure) < count(*) AS e FROM sub_scores GROUP BY cluster_id)
SELECT cluster_id, CASE WHEN NOT s AND NOT f AND NOT e THEN NULL WHEN s AND f AND NOT e THEN 'Ranked on exposure — faces and sharpness could not be measured for every take.'
  WHEN s AND NOT f AND NOT e THEN 'Ranked on faces and exposure — sharpness could not be measured for every take.' WHEN f AND NOT s AND NOT e THEN 'Ranked on sharpness and exposure — faces could not be measured for every take.' ELSE '?' END AS basis FROM d""")
def ranking_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scoring.common_criteria(view(spark, sf_dir, "sub_scores").select("cluster_id", "uuid", *WEIGHED), WEIGHED)
    return sentences.ranking_sentences(scored, WEIGHED)


def refusing_sink(album: object, photo: object, path: str, crop: dict) -> None:
    """Writes nothing, and refuses some photos."""
    if photo % 31 == 0:
        raise ValueError(f"refused {path}")


@query("entries", "album_photos", "renditions", sql="""&
k AS (SELECT p.uuid, coalesce(p.adjusted, false) AS adjusted, e.path AS ep, e.width AS ew, e.height AS eh, o.path AS op, o.width AS ow, o.height AS oh FROM album_photos p
  LEFT JOIN renditions e ON e.uuid = p.uuid AND e.edited AND e.path IS NOT NULL LEFT JOIN renditions o ON o.uuid = p.uuid AND NOT o.edited AND o.path IS NOT NULL),
c AS (SELECT uuid, adjusted AND ep IS NULL AND op IS NOT NULL AS flag, CASE WHEN adjusted AND ep IS NOT NULL THEN ep ELSE op END AS path, CASE WHEN adjusted AND ep IS NOT NULL THEN ew ELSE ow END AS width, CASE WHEN adjusted AND ep IS NOT NULL THEN eh ELSE oh END AS height FROM k),
j AS (SELECT n.*, c.uuid IS NOT NULL AS found, c.path, c.width, c.height, coalesce(flag, false) AS flag, cast(width AS double) / height > 1.5 AS wide FROM entries n LEFT JOIN c ON c.uuid = n.uuid),
s AS (SELECT *, least(width, CASE WHEN wide THEN cast(round_even(height * 1.5, 0) AS bigint) ELSE width END) AS w, least(height, CASE WHEN wide THEN height ELSE cast(round_even(width / cast(1.5 AS double), 0) AS bigint) END) AS h,
  CASE WHEN NOT found THEN 'no-photo' WHEN path IS NULL THEN 'no-rendition' WHEN width IS NULL THEN 'unreadable' END AS why FROM j)
SELECT album_id, place, cast(uuid AS varchar) AS uuid, CASE WHEN why IS NOT NULL OR uuid % 31 = 0 THEN 'failed' ELSE 'exported' END AS status, coalesce(why, CASE WHEN uuid % 31 = 0 THEN 'ValueError: refused ' || path END) AS reason, flag AS crop_not_applied,
  CASE WHEN why IS NULL THEN path END AS path,
  CASE WHEN why IS NULL THEN concat_ws(',', cast(round_even((width - w) * coalesce(offset_x, 0.5::double), 0) AS bigint), cast(round_even((height - h) * offset_y, 0) AS bigint), cast(w AS bigint), cast(h AS bigint)) END AS crop FROM s""")
def album_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as albums of parts: each line exported from the rendition that fits, through a sink that refuses some."""
    plan = albums_out.plan_export(*[view(spark, sf_dir, v) for v in ("entries", "album_photos", "renditions")], 1800, 1200)
    rows = albums_out.carry_out(plan, refusing_sink)
    crop = F.when(F.col("crop").isNotNull(), F.concat_ws(",", *[F.col(f"crop.{c}").cast("string") for c in ("x", "y", "width", "height")]))
    return rows.select("album_id", "place", F.col("uuid").cast("string").alias("uuid"), "status", "reason", "crop_not_applied", "path", crop.alias("crop"))


def _drawn(k: int, share: float) -> str:
    return f"('0x' || substr(d, {8 * k + 1}, 8))::bigint < {round(share * demo.DRAW)}"


SHARES = demo.DemoShares()
DEMO = f"""k AS (SELECT c_custkey AS n, sha256('7:' || c_custkey) AS d FROM customer),
z AS (SELECT *, CASE WHEN {_drawn(0, 17 / 24)} THEN 2 WHEN {_drawn(0, 19 / 24)} THEN 3 WHEN {_drawn(0, 21 / 24)} THEN 4 WHEN {_drawn(0, 22 / 24)} THEN 5 WHEN {_drawn(0, 23 / 24)} THEN 9 ELSE 20 END AS size FROM k),
c AS (SELECT *, 1 + n * 7 % (size - 1) AS best, {_drawn(1, SHARES.ambiguous)} AS ambiguous, {_drawn(2, SHARES.unmeasured)} AS blunt, {_drawn(5, SHARES.evicted)} AS evicted, {_drawn(6, SHARES.no_faces)} AS faceless, {_drawn(7, SHARES.no_horizon)} AS level,
  CASE WHEN {_drawn(3, SHARES.low)} THEN size WHEN {_drawn(3, SHARES.low + SHARES.mixed)} THEN 1 + ('0x' || substr(d, 33, 8))::bigint % (size - 1) ELSE 0 END AS n_small FROM z)"""


@query(sql=f"""WITH {DEMO}, m AS (SELECT *, abs(m - best) AS away, greatest(best, size - 1 - best) AS span, printf('demo-%02d-%03d', n, m) AS uuid FROM (SELECT *, unnest(range(size)) AS m FROM c))
SELECT n AS cluster_ord, cast(m AS int) AS member_ord, uuid, n * 86400 + m * 3 AS seconds, CASE WHEN NOT (evicted AND m = size - 1) THEN CASE WHEN m < n_small THEN '480x360' ELSE '1024x768' END END AS raster, uuid || CASE WHEN m < n_small THEN '' ELSE '-analysis' END || '.png' AS derivative_path,
  CASE WHEN NOT blunt THEN (10000 - (2 * CASE WHEN ambiguous THEN 200 ELSE 2600 END * away + span) // (2 * span)) / 10000.0::double END AS sharpness, CASE WHEN NOT faceless THEN 0.44::double END AS faces, CASE WHEN NOT faceless THEN 0.58::double END AS framing, CASE WHEN NOT level THEN 0.81::double END AS horizon,
  round(0.61::double + m * 0.01::double, 4) AS exposure, round(0.7::double - away * CASE WHEN ambiguous THEN 0.004::double ELSE 0.09::double END, 6) AS total, CASE WHEN away > 0 THEN round(0.11::double + 0.02::double * m, 4) END AS distance_to_winner,
  m = best AS winner, ambiguous, concat_ws(',', CASE WHEN faceless THEN 'faces,framing' END, CASE WHEN level THEN 'horizon' END, CASE WHEN blunt THEN 'sharpness' END) AS dropped FROM m""")
def demo_takes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A made-up cluster for every customer's number."""
    keys = view(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cluster_ord"))
    got = demo.demo_members(demo.demo_clusters(keys, seed=7))
    seconds = F.unix_timestamp("date") - F.unix_timestamp(F.lit(demo.FIRST_DAY).cast("timestamp"))
    return got.select("cluster_ord", "member_ord", "uuid", seconds.alias("seconds"), F.concat("display_width", F.lit("x"), "display_height").alias("raster"), "derivative_path", "sharpness", "faces", "framing", "horizon", "exposure", "total", "distance_to_winner",
        (F.col("uuid") == F.col("winner")).alias("winner"), "ambiguous", F.array_join("dropped", ",").alias("dropped"))


@query()
def whole_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records to ranked clusters: vectors and measures of a photo follow from its number."""
    prints = view(spark, sf_dir, "embeddings")
    n = max(1, prints.count())
    prints = stage_table(prints.select("vec_id", F.col("embedding").cast("array<float>").alias("embedding")), "prints")
    number = F.col("uuid").cast("bigint")
    vectors_of = lambda photos: photos.withColumn("vec_id", F.floor(number / 3) % n).join(prints, "vec_id")
    part = lambda k: ((number * k) % 100 / 100).cast("double")
    measures = {"laplacian": part(31) * 500, "width": F.lit(480), "height": F.lit(360), "exposure": part(13), "faces": part(29), "framing": part(7), "horizon": part(3), "capture_quality": part(5), "smiling": part(11)}
    analyse = lambda photos: photos.withColumns(measures)
    got = pipeline.run_pipeline(view(spark, sf_dir, "records"), vectors_of, analyse, ClusterSettings(similarity_threshold=1.0, gap_seconds=600.0))
    return got.members.join(got.clusters.select("cluster_id", "size", "diameter", "median_distance", "sharpness_available"), "cluster_id")
