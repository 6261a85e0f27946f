"""Queries over the driver's tables, one for each family of operators, and SQL that must give the same rows."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernsieve.functions import rasters, scalar
from fernsieve.operators import actions, albums, audit, decision_log, decisions, explain, pool, sampling, scoring, sessions, sweep, vectors
from fernsieve.plans.staging import shared_folder, stage_table
from fernsieve.plans.views import view, with_views
from fernsieve.schema import TYPE_FLAGS, SweepSettings
from fernsieve.sources import cache, library

#: Parameters of the fixture queries.
NOW, MONTHS = dt.datetime(2024, 2, 14, 10, 33, 36), 1
TRIP_HOURS, LINK_CUT = 3.0, 1.25
WEIGHED = {"sharpness": 0.35, "faces": 0.35, "exposure": 0.15}

QUERIES, ORACLES = {}, {}


def query(*views: str, sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with the SQL that follows the views' definitions."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"{with_views(*views)}{',' if views and sql.lstrip().startswith('&') else ''} {sql.replace('&', '', 1) if sql.lstrip().startswith('&') else sql}" if views else sql
        return f

    return put


@query("records", sql="""SELECT count(*) AS items, count(*) FILTER (NOT is_video) AS photos, count(*) FILTER (is_video) AS videos, cast(coalesce(sum(filesize), 0) AS bigint) AS size_bytes,
  count(*) FILTER (is_favorite) AS favorites, count(*) FILTER (album_count = 0) AS no_album, count(*) FILTER (is_hidden) AS hidden FROM records""")
def audit_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.totals(view(spark, sf_dir, "records"))


@query(sql="SELECT cast(year(o_orderdate) AS int) AS year, count(*) AS count, cast(sum(cast(floor(o_totalprice) AS bigint)) AS bigint) AS size_bytes FROM orders GROUP BY 1")
def audit_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = library.read_table(spark, sf_dir, "orders")
    return audit.by_year(orders.select(F.col("o_orderdate").alias("date_local"), F.floor("o_totalprice").alias("filesize")))


@query("records", sql="SELECT t.type, count(*) FILTER (f) AS count, cast(coalesce(sum(filesize) FILTER (f), 0) AS bigint) AS size_bytes FROM (" + " UNION ALL ".join(
    f"SELECT '{t}' AS type, {'is_' + t if t in ('screenshot', 'screen_recording', 'selfie', 'burst') else 'false'} AS f, filesize FROM records" for t in TYPE_FLAGS) + ") t GROUP BY t.type")
def audit_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.by_type(view(spark, sf_dir, "records"))


@query("records", sql="""SELECT b.band, count(r.uuid) AS count, cast(coalesce(sum(r.filesize), 0) AS bigint) AS size_bytes FROM (VALUES ('<5s', -1e9, 5), ('5-30s', 5, 30), ('30s-2m', 30, 120), ('>2m', 120, 1e18)) b(band, low, high)
  LEFT JOIN records r ON r.is_video AND r.duration_seconds >= b.low AND r.duration_seconds < b.high GROUP BY b.band""")
def audit_by_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.by_duration(view(spark, sf_dir, "records"))


@query("records", sql="""SELECT count(*) AS n_runs FROM (SELECT g, count(*) AS n FROM (SELECT sum(s) OVER (ORDER BY date, uuid) AS g FROM (
  SELECT *, CASE WHEN epoch_us(date) - epoch_us(lag(date) OVER (ORDER BY date, uuid)) < 90000000 THEN 0 ELSE 1 END AS s FROM records)) GROUP BY g) WHERE n >= 2""")
def gap_run_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.gap_run_count(view(spark, sf_dir, "records"))


BUCKETS = """flags AS (SELECT *, CASE WHEN epoch_us(date) - epoch_us(lag(date) OVER (ORDER BY date, uuid)) < 90000000 OR burst_key = lag(burst_key) OVER (ORDER BY date, uuid) THEN 0 ELSE 1 END AS s FROM records WHERE NOT is_shared),
buckets AS (SELECT *, cast(sum(s) OVER (ORDER BY date, uuid) - 1 AS bigint) AS bucket_ord FROM flags)"""
MERGED = BUCKETS + """, edges AS (SELECT DISTINCT a.bucket_ord AS a, b.bucket_ord AS b FROM buckets a JOIN buckets b ON a.burst_key = b.burst_key AND a.bucket_ord <> b.bucket_ord),
reach AS (SELECT a AS node, a AS low FROM edges UNION SELECT e.b, r.low FROM reach r JOIN edges e ON e.a = r.node),
roots AS (SELECT node, min(low) AS root FROM reach GROUP BY node),
merged AS (SELECT b.* EXCLUDE (bucket_ord), coalesce(r.root, b.bucket_ord) AS bucket_ord FROM buckets b LEFT JOIN roots r ON r.node = b.bucket_ord)"""


@query("records", sql="&" + BUCKETS + " SELECT uuid, bucket_ord, row_number() OVER (PARTITION BY bucket_ord ORDER BY date, uuid) - 1 AS member_ord FROM buckets")
def time_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.time_buckets(view(spark, sf_dir, "records").where("not is_shared")).select("uuid", "bucket_ord", F.col("member_ord").cast("bigint"))


@query("records", sql="&" + MERGED + " SELECT uuid, bucket_ord, row_number() OVER (PARTITION BY bucket_ord ORDER BY date, uuid) - 1 AS member_ord FROM merged")
def burst_merged_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.merge_bursts(sessions.time_buckets(view(spark, sf_dir, "records").where("not is_shared"))).select("uuid", "bucket_ord", F.col("member_ord").cast("bigint"))


@query("records", sql="&" + MERGED + """ SELECT * FROM (SELECT uuid, bucket_ord, count(*) OVER (PARTITION BY bucket_ord) AS bucket_size, row_number() OVER (PARTITION BY bucket_ord ORDER BY date, uuid) - 1 AS member_ord
  FROM merged WHERE derivative_path IS NOT NULL) WHERE bucket_size >= 2""")
def candidate_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.candidate_buckets(view(spark, sf_dir, "records")).select("uuid", "bucket_ord", "bucket_size", F.col("member_ord").cast("bigint"))


SHOTS = "(is_screenshot OR is_screen_recording) AND NOT (is_shared OR is_favorite OR is_hidden) AND date < TIMESTAMP '2024-01-15 00:00:00'"
SHORT = "is_video AND NOT (is_shared OR is_favorite OR is_hidden) AND duration_seconds < 5"
DUPLICATES = """groups AS (SELECT fingerprint, arg_min(uuid, (date IS NULL, coalesce(date, TIMESTAMP '1970-01-01'), uuid)) AS keep FROM {t} WHERE fingerprint <> '' GROUP BY fingerprint
  HAVING count(*) >= 2 AND bool_and(NOT (is_shared OR is_favorite OR is_hidden)))"""


@query("records", sql=f"SELECT uuid FROM records WHERE {SHOTS} ORDER BY uuid")
def sweep_screenshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep.old_screenshots(view(spark, sf_dir, "records"), NOW, MONTHS).select("uuid").orderBy("uuid")


@query("records", sql=f"SELECT uuid FROM records WHERE {SHORT} ORDER BY uuid")
def sweep_short_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep.short_videos(view(spark, sf_dir, "records")).select("uuid").orderBy("uuid")


@query("fingerprints", sql="&" + DUPLICATES.format(t="fingerprints") + " SELECT f.uuid FROM fingerprints f JOIN groups g ON f.fingerprint = g.fingerprint WHERE f.uuid <> g.keep")
def sweep_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep.exact_duplicates(view(spark, sf_dir, "fingerprints")).select("uuid")


FIRST = DUPLICATES.format(t="records") + f""", found AS (SELECT 0 AS k, 'screenshots' AS category, uuid FROM records WHERE {SHOTS} UNION ALL SELECT 1, 'short_videos', uuid FROM records WHERE {SHORT}
  UNION ALL SELECT 2, 'exact_duplicates', r.uuid FROM records r JOIN groups g ON r.fingerprint = g.fingerprint WHERE r.uuid <> g.keep), first AS (SELECT arg_min(category, k) AS category, uuid FROM found GROUP BY uuid)"""


@query("records", sql="&" + FIRST + " SELECT category, uuid FROM first")
def sweep_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sweep(spark, sf_dir)


def _sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep.build_sweep(view(spark, sf_dir, "records"), NOW, SweepSettings(screenshot_age_months=MONTHS))


@query("records", sql="&" + FIRST + " SELECT c.category, count(f.uuid) AS count FROM (VALUES ('screenshots'), ('short_videos'), ('exact_duplicates')) c(category) LEFT JOIN first f USING (category) GROUP BY c.category")
def sweep_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep.sweep_counts(_sweep(spark, sf_dir))


@query("records", sql="&" + FIRST + """ SELECT uuid, category, kind, CASE WHEN kind = 'keyword' THEN 'cull' ELSE CASE category WHEN 'screenshots' THEN 'Cull/Old Screenshots' WHEN 'short_videos' THEN 'Cull/Short Videos' ELSE 'Cull/Exact Duplicates' END END AS target
  FROM first CROSS JOIN (VALUES ('album'), ('keyword')) k(kind)""")
def sweep_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep.sweep_actions(_sweep(spark, sf_dir))


@query("records", sql="&" + FIRST + " SELECT category, 'sweep:' || category || ':' || substr(sha256(string_agg(uuid, chr(10) ORDER BY uuid)), 1, 16) AS sweep_key FROM first GROUP BY category")
def sweep_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep.sweep_keys(_sweep(spark, sf_dir))


@query("records", sql="SELECT uuid, date FROM records WHERE NOT is_video AND (is_favorite OR cast(uuid AS bigint) % 19 = 0)")
def keeper_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = view(spark, sf_dir, "records")
    return pool.keeper_pool(records, records.where("cast(uuid as bigint) % 19 = 0")).select("uuid", "date")


TRIPS = """flags AS (SELECT *, CASE WHEN epoch_us(date) - epoch_us(lag(date) OVER (ORDER BY date, uuid)) <= 10800000000 THEN 0 ELSE 1 END AS s FROM records WHERE is_favorite AND NOT is_video),
runs AS (SELECT *, cast(sum(s) OVER (ORDER BY date, uuid) - 1 AS bigint) AS trip_ord FROM flags), trips AS (SELECT *, count(*) OVER (PARTITION BY trip_ord) AS trip_size FROM runs QUALIFY trip_size >= 3)"""


def _trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = view(spark, sf_dir, "records")
    return sessions.trips(pool.keeper_pool(records, records.where("false")), TRIP_HOURS)


@query("records", sql="&" + TRIPS + " SELECT uuid, trip_ord, trip_size, row_number() OVER (PARTITION BY trip_ord ORDER BY date, uuid) - 1 AS member_ord FROM trips")
def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trips(spark, sf_dir).select("uuid", "trip_ord", "trip_size", F.col("member_ord").cast("bigint"))


@query("records", sql="&" + TRIPS + """, far AS (SELECT a.trip_ord, max(2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians(b.latitude - a.latitude) / 2), 2) + cos(radians(a.latitude)) * cos(radians(b.latitude)) * pow(sin(radians(b.longitude - a.longitude) / 2), 2))))) AS far
  FROM trips a JOIN trips b ON a.trip_ord = b.trip_ord AND a.uuid < b.uuid AND a.latitude IS NOT NULL AND b.latitude IS NOT NULL GROUP BY a.trip_ord)
SELECT t.trip_ord, t.size, CASE WHEN cast(lo AS date) = cast(hi AS date) THEN strftime(lo, '%b %-d, %Y') WHEN strftime(lo, '%Y%m') = strftime(hi, '%Y%m') THEN strftime(lo, '%b %-d') || ' - ' || strftime(hi, '%-d, %Y') ELSE '?' END AS title,
  round(f.far, 4) AS spread_km, coalesce(f.far > 150, false) AS wide FROM (SELECT trip_ord, count(*) AS size, min(date) AS lo, max(date) AS hi FROM trips GROUP BY trip_ord) t LEFT JOIN far f USING (trip_ord)""")
def trip_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool.trip_spread(_trips(spark, sf_dir)).withColumn("spread_km", F.round("spread_km", 4))


PAIRS = """pairs AS (SELECT a.bucket_id, a.uuid AS uuid_a, b.uuid AS uuid_b, list_distance(cast(a.embedding AS double[]), cast(b.embedding AS double[])) AS distance
  FROM vectors a JOIN vectors b ON a.bucket_id = b.bucket_id AND a.member_ord < b.member_ord)"""


@query("vectors", sql="&" + PAIRS + " SELECT bucket_id, uuid_a, uuid_b, round(distance, 6) AS distance FROM pairs WHERE distance < 1.25")
def pair_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.pair_distances(view(spark, sf_dir, "vectors"), below=LINK_CUT).withColumn("distance", F.round("distance", 6))


@query("vectors", sql="&" + PAIRS + " SELECT bucket_id, count(*) AS pairs, round(max(distance), 6) AS diameter, round(median(distance), 6) AS median FROM pairs GROUP BY bucket_id")
def pair_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = vectors.pair_statistics(view(spark, sf_dir, "vectors"))
    return stats.select("bucket_id", "pairs", F.round("diameter", 6).alias("diameter"), F.round("median", 6).alias("median"))


@query()
def linkage_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.linkage_clusters(view(spark, sf_dir, "vectors"), LINK_CUT)


@query("sub_scores", sql="SELECT cluster_id, substr(sha256(string_agg(uuid, chr(10) ORDER BY uuid)), 1, 16) AS cluster_key FROM sub_scores GROUP BY cluster_id")
def cluster_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.content_keys(view(spark, sf_dir, "sub_scores"))


FACE = "cast(vec_id % 10 AS double) / 10"


@query(sql=f"""WITH g AS (SELECT vec_id, vec_id % 100 / 100.0::double AS luma, vec_id % 7 / 50.0::double AS dark, vec_id % 5 / 50.0::double AS light, CASE WHEN vec_id % 3 = 0 THEN vec_id % 20 / 40.0::double END AS angle,
  {FACE} AS x, vec_id % 4 / 10.0::double AS y, CASE WHEN vec_id % 6 = 0 THEN NULL ELSE vec_id % 13 / 10.0::double END AS l, vec_id % 9 / 10.0::double AS r, vec_id % 8 <> 0 AS has FROM embeddings)
SELECT vec_id, round(greatest(0, least(1, exp(-pow(luma - 0.46, 2) / (2 * 0.18 * 0.18)) * (1 - least(1, 3 * (dark + light))))), 6) AS exposure, round(exp(-6 * abs(angle)), 6) AS horizon,
  CASE WHEN has THEN round(least(coalesce(greatest(0, least(1, l)), 9), greatest(0, least(1, r))), 6) END AS eyes,
  CASE WHEN has THEN round(exp(-2 * sqrt(pow(x + 0.15 - 0.5, 2) + pow(y + 0.15 - 0.5, 2))) * CASE WHEN least(x, y, 1 - (x + 0.3), 1 - (y + 0.3)) < 0 THEN greatest(0, 1 + 4 * least(x, y, 1 - (x + 0.3), 1 - (y + 0.3))) ELSE 1 END, 6) END AS framing,
  CASE WHEN has THEN round(greatest(0, least(1, (r - 0.5) / 2 + 0.5)), 6) END AS smile, CASE WHEN has THEN round(greatest(0, least(1, r)), 6) END AS capture FROM g""")
def pixel_and_face_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = library.read_table(spark, sf_dir, "embeddings").select("vec_id")
    part = lambda n, by: (F.col("vec_id") % n).cast("double") / by
    eye = F.when(F.col("vec_id") % 6 == 0, F.lit(None)).otherwise(part(13, 10.0)).cast("double")
    box = lambda x, y, w: F.struct(x.alias("x"), y.alias("y"), w.alias("w"), w.alias("h"))
    face = lambda b, left, right: F.struct(b.alias("bounding_box"), left.alias("left_eye_open"), right.alias("right_eye_open"), (part(9, 10.0) - 0.5).alias("smiling"), part(9, 10.0).alias("capture_quality"))
    none = F.lit(None).cast("double")
    faces = F.when(F.col("vec_id") % 8 != 0, F.array(face(box(part(10, 10.0), part(4, 10.0), F.lit(0.3)), eye, part(9, 10.0)), face(box(F.lit(0.1), F.lit(0.1), F.lit(0.1)), none, none))).otherwise(F.array().cast("array<struct<bounding_box:struct<x:double,y:double,w:double,h:double>,left_eye_open:double,right_eye_open:double,smiling:double,capture_quality:double>>"))
    s = v.withColumn("faces", faces).withColumn("angle", F.when(F.col("vec_id") % 3 == 0, part(20, 40.0)))
    six = lambda c, n: F.round(c, 6).alias(n)
    f = F.col("faces")
    return s.select("vec_id", six(scalar.exposure_score(part(100, 100.0), part(7, 50.0), part(5, 50.0)), "exposure"), six(scalar.horizon_score(F.col("angle")), "horizon"), six(scalar.eyes_score(f), "eyes"), six(scalar.framing_score(f), "framing"), six(scalar.smile_score(f), "smile"), six(scalar.capture_score(f), "capture"))


@query("sub_scores", sql="""SELECT s.cluster_id, s.uuid, CASE WHEN g.low > 0 AND g.high <= g.low AND g.best > 0 THEN round(s.laplacian / g.best, 6) END AS sharpness FROM sub_scores s
  JOIN (SELECT cluster_id, max(laplacian) AS best, min(greatest(width, height)) AS low, max(greatest(width, height)) AS high FROM sub_scores GROUP BY cluster_id) g USING (cluster_id)""")
def relative_sharpness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.relative_sharpness(view(spark, sf_dir, "sub_scores")).select("cluster_id", "uuid", F.round("sharpness", 6).alias("sharpness"))


TOTALS = """has AS (SELECT cluster_id, count(sharpness) = count(*) AS hs, count(faces) = count(*) AS hf FROM sub_scores GROUP BY cluster_id),
totals AS (SELECT s.*, h.hs, h.hf, (CASE WHEN hs THEN cast(0.35 AS double) * sharpness ELSE 0 END + CASE WHEN hf THEN cast(0.35 AS double) * faces ELSE 0 END + cast(0.15 AS double) * exposure)
  / (CASE WHEN hs THEN cast(0.35 AS double) ELSE 0 END + CASE WHEN hf THEN cast(0.35 AS double) ELSE 0 END + cast(0.15 AS double)) AS total FROM sub_scores s JOIN has h USING (cluster_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY round(total, 9) DESC, uuid) AS rank FROM totals),
top AS (SELECT cluster_id, max(total) FILTER (rank = 1) AS one, max(total) FILTER (rank = 2) AS two, max(uuid) FILTER (rank = 1) AS winner FROM ranked GROUP BY cluster_id)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = view(spark, sf_dir, "sub_scores").select("cluster_id", "uuid", "sharpness", "faces", "exposure", "long_side")
    return scoring.common_criteria(scores, WEIGHED).withColumn("total", F.round("total", 9))


@query("sub_scores", sql="&" + TOTALS + """ SELECT cluster_id, uuid, round(total, 6) AS total, CASE WHEN hs AND hf THEN '' WHEN hs THEN 'faces' WHEN hf THEN 'sharpness' ELSE 'faces,sharpness' END AS dropped FROM totals""")
def common_criteria_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("cluster_id", "uuid", F.round("total", 6).alias("total"), F.array_join("dropped", ",").alias("dropped"))


@query("sub_scores", sql="&" + TOTALS + " SELECT r.cluster_id, r.uuid, cast(r.rank AS int) AS rank, t.winner, coalesce(round(t.one, 9) - round(t.two, 9) < 0.05, false) AS ambiguous FROM ranked r JOIN top t USING (cluster_id)")
def cluster_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.rank_members(_scored(spark, sf_dir)).select("cluster_id", "uuid", "rank", "winner", "ambiguous")


POPULATION = MERGED + """, population AS (SELECT bucket_ord AS ord, count(*) AS size, cast(max(epoch_us(date)) - min(epoch_us(date)) AS double) / 1e6 AS diameter FROM merged GROUP BY bucket_ord HAVING count(*) >= 2),
cuts AS (SELECT list_sort(list(diameter))[cast(floor(0.25 * count(*)) AS bigint) + 1] AS q1, list_sort(list(diameter))[cast(floor(0.5 * count(*)) AS bigint) + 1] AS q2, list_sort(list(diameter))[cast(floor(0.75 * count(*)) AS bigint) + 1] AS q3 FROM population)"""


def _population(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = sessions.merge_bursts(sessions.time_buckets(view(spark, sf_dir, "records").where("not is_shared")))
    span = (F.max(sessions.micros("date")) - F.min(sessions.micros("date"))).cast("double") / 1e6
    return stage_table(merged.groupBy(F.col("bucket_ord").alias("ord")).agg(F.count("*").alias("size"), span.alias("diameter")).where("size >= 2"), "population")


@query("records", sql="&" + POPULATION + " SELECT q1, q2, q3 FROM cuts")
def floor_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.quartile_cuts(_population(spark, sf_dir), "diameter")


@query("records", sql="&" + POPULATION + """ SELECT CASE WHEN size <= 2 THEN '2' WHEN size <= 4 THEN '3-4' WHEN size <= 9 THEN '5-9' ELSE '10+' END || '/d' || (1 + (diameter >= q1)::int + (diameter >= q2)::int + (diameter >= q3)::int) AS stratum, count(*) AS count
  FROM population, cuts GROUP BY 1""")
def strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.strata(_population(spark, sf_dir)).groupBy("stratum").count()


@query(sql="""SELECT n, k, CASE WHEN k >= n THEN list_transform(range(n), lambda i: cast(i AS bigint)) WHEN k = 0 THEN [] WHEN k = 1 THEN [0] ELSE list_transform(range(k), lambda i: cast(round_even(cast(i * (n - 1) AS double) / (k - 1), 0) AS bigint)) END::varchar AS places
  FROM (SELECT c_custkey AS n, c_custkey % 12 AS k FROM customer)""")
def even_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = library.read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("n"), (F.col("c_custkey") % 12).alias("k"))
    return c.select("n", "k", F.concat(F.lit("["), F.array_join(sampling.even_places(F.col("n"), F.col("k")), ", "), F.lit("]")).alias("places"))


@query()
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stratified_sample(_population(spark, sf_dir)).select("ord", "size", "diameter", "stratum")


@query("records", sql="&" + POPULATION + " SELECT count(*) AS clusters, least(count(*), 200) AS sampled, cast(coalesce(sum(size), 0) AS bigint) AS photos, cast(coalesce(sum(size - 1), 0) AS bigint) AS culled FROM population")
def population_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    population = _population(spark, sf_dir)
    return sampling.population_totals(population, sampling.stratified_sample(population))


@query(sql="""SELECT vec_id, round(list_sum(p) / (len(p) * 255.0::double), 9) AS luma, len(list_filter(p, lambda x: x <= 3)) / len(p)::double AS shadow, len(list_filter(p, lambda x: x >= 252)) / len(p)::double AS highlight
  FROM (SELECT vec_id, list_transform(range(64), lambda i: (vec_id * 7 + i * i * 13) % 256) AS p FROM embeddings)""")
def pixel_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (F.col("vec_id") * 7 + i * i * 13) % 256)
    got = library.read_table(spark, sf_dir, "embeddings").select("vec_id", rasters.exposure_stats(rasters.packed(pixels), F.lit(64), F.lit(1), F.lit(64)).alias("e"))
    return got.select("vec_id", F.round("e.luma", 9).alias("luma"), "e.shadow", "e.highlight")


STATE = "state AS (SELECT cluster_key, max(batch_id) AS batch_id FROM batches WHERE batch_id NOT IN (SELECT batch_id FROM undos) GROUP BY cluster_key), standing AS (SELECT m.* FROM marks m JOIN state USING (cluster_key, batch_id))"


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.current_state(view(spark, sf_dir, "batches"), view(spark, sf_dir, "undos"))


def _standing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "marks").join(_state(spark, sf_dir), ["cluster_key", "batch_id"])


def _order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "batches").groupBy("cluster_key").agg(F.min("batch_id").alias("ord"))


@query("batches", "undos", "marks", sql="&" + STATE + " SELECT cluster_key, batch_id FROM state")
def decision_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state(spark, sf_dir)


@query("batches", "undos", "marks", sql="&" + STATE + " SELECT cluster_key, batch_id FROM state")
def logged_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of a log that is written in two parts, with a snapshot between them."""
    batches, undos = view(spark, sf_dir, "batches"), stage_table(view(spark, sf_dir, "undos"), "undos")
    half = (batches.agg(F.max("batch_id")).first()[0] or 0) // 2
    log = decision_log.DecisionLog(spark, f"{shared_folder(spark)}/log-{uuid.uuid4().hex}")
    log.append(batches.where(F.col("batch_id") <= half), undos.where(F.col("batch_id") <= half // 2))
    log.take_snapshot()
    log.append(batches.where(F.col("batch_id") > half), undos.where(F.col("batch_id") > half // 2))
    return log.state()


@query("batches", "undos", sql="SELECT batch_id, cluster_key, batch_id IN (SELECT batch_id FROM undos) AS undone FROM batches ORDER BY batch_id DESC")
def decision_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.history(view(spark, sf_dir, "batches"), view(spark, sf_dir, "undos"))


@query("batches", "undos", "marks", sql="&" + STATE + """, sized AS (SELECT DISTINCT cluster_key FROM batches) SELECT count(*) AS clusters, count(s.cluster_key) AS decided, count(*) - count(s.cluster_key) AS remaining,
  (SELECT count(*) FROM standing WHERE mark = 'keep') AS keep, (SELECT count(*) FROM standing WHERE mark = 'cull') AS cull, (SELECT count(*) FROM standing WHERE mark = 'unset') AS unset, cast(coalesce(sum(3) FILTER (s.cluster_key IS NULL), 0) AS bigint) AS undecided
  FROM sized LEFT JOIN state s USING (cluster_key)""")
def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters = view(spark, sf_dir, "batches").select("cluster_key").distinct().withColumn("size", F.lit(3))
    return decisions.dashboard(clusters, _standing(spark, sf_dir))


ORDERED = STATE + ", orders_ AS (SELECT cluster_key, min(batch_id) AS ord FROM batches GROUP BY cluster_key)"


@query("batches", "undos", "marks", sql="&" + ORDERED + " SELECT cluster_key, staged, ord FROM (SELECT cluster_key, count(*) AS staged FROM standing WHERE mark = 'cull' GROUP BY cluster_key) JOIN orders_ USING (cluster_key) ORDER BY staged DESC, ord LIMIT 10")
def largest_staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.largest_staged(_standing(spark, sf_dir), _order(spark, sf_dir))


@query("batches", "undos", "marks", sql="&" + ORDERED + " SELECT min(ord) AS next_ord FROM orders_ WHERE cluster_key NOT IN (SELECT cluster_key FROM state WHERE batch_id % 4 <> 0)")
def next_undecided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.next_undecided(_order(spark, sf_dir), _state(spark, sf_dir).where("batch_id % 4 <> 0"))


@query("batches", "undos", "marks", sql="&" + ORDERED + " SELECT ord, photo_id, mark FROM standing JOIN orders_ USING (cluster_key) WHERE mark = 'cull' ORDER BY ord, photo_id LIMIT 50 OFFSET 20")
def final_check_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _standing(spark, sf_dir).where("mark = 'cull'").join(_order(spark, sf_dir), "cluster_key").select("ord", "photo_id", "mark")
    return decisions.page(rows, ["ord", "photo_id"], 20, 50)


@query("batches", "undos", "marks", sql="&" + ORDERED + " SELECT sha256(string_agg(cluster_key::varchar || chr(9) || photo_id::varchar, chr(10) ORDER BY ord, photo_id)) AS digest, count(*) AS n_rows FROM standing JOIN orders_ USING (cluster_key) WHERE mark = 'cull'")
def staged_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _standing(spark, sf_dir).where("mark = 'cull'").join(_order(spark, sf_dir), "cluster_key")
    return decisions.ordered_digest(rows, ["ord", "photo_id"], F.concat_ws("\t", F.col("cluster_key").cast("string"), F.col("photo_id").cast("string")))


@query("batches", "undos", "marks", "live", sql="&" + STATE + """ SELECT cluster_key, CASE WHEN max(batch_id) % 7 = 0 THEN 'superseded' WHEN cluster_key % 10 = 3 THEN 'orphaned' WHEN bool_or(l.photo_id IS NULL OR coalesce(l.mod_key, '') <> s.mod_key) THEN 'requeued' ELSE 'applied' END AS status
  FROM standing s LEFT JOIN live l USING (photo_id) GROUP BY cluster_key""")
def reconcile_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    standing, live = _standing(spark, sf_dir), view(spark, sf_dir, "live")
    fresh = standing.where("cluster_key % 10 <> 3").select("cluster_key", "photo_id").join(live, "photo_id", "left")
    config = _state(spark, sf_dir).select("cluster_key", F.when(F.col("batch_id") % 7 == 0, "old").otherwise("new").alias("config_digest"))
    return decisions.reconcile(standing, fresh, live, "new", config)


PLANNED = STATE + """, status AS (SELECT s.*, CASE WHEN mark = 'unset' THEN 'ignored' WHEN l.photo_id IS NULL THEN 'gone' WHEN l.mod_key <> s.mod_key THEN 'edited' ELSE mark END AS status FROM standing s LEFT JOIN live l USING (photo_id)),
plan AS (SELECT photo_id, unnest(CASE WHEN status = 'cull' THEN ['album:Cull/Candidates', 'keyword:cull'] WHEN status = 'keep' AND favorite THEN ['favorite'] ELSE [] END) AS action FROM status)"""


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actions.mark_status(_standing(spark, sf_dir), view(spark, sf_dir, "live"))


@query("batches", "undos", "marks", "live", sql="&" + PLANNED + " SELECT status, count(*) AS count FROM status GROUP BY status")
def writeback_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _status(spark, sf_dir).groupBy("status").count()


@query("batches", "undos", "marks", "live", sql="&" + PLANNED + " SELECT photo_id, action FROM plan")
def writeback_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actions.plan_actions(_status(spark, sf_dir))


@query("batches", "undos", "marks", "live", sql="&" + PLANNED + " SELECT photo_id, action FROM plan WHERE photo_id % 2 <> 0")
def writeback_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = actions.plan_actions(_status(spark, sf_dir))
    return actions.split_by_ledger(planned, planned.where("photo_id % 2 = 0"))[0]


@query("sub_scores", sql="&" + TOTALS + """, partner AS (SELECT cluster_id, rank = 2 AS for_winner, sharpness AS ps, faces AS pf, exposure AS pe FROM ranked WHERE rank <= 2),
deltas AS (SELECT r.cluster_id, r.uuid, unnest([{'c': 'sharpness', 'w': cast(0.35 AS double), 'd': CASE WHEN hs THEN sharpness - ps END}, {'c': 'faces', 'w': cast(0.35 AS double), 'd': CASE WHEN hf THEN faces - pf END}, {'c': 'exposure', 'w': cast(0.15 AS double), 'd': exposure - pe}]) AS x
  FROM ranked r JOIN partner p ON r.cluster_id = p.cluster_id AND (r.rank = 1) = p.for_winner)
SELECT cluster_id, uuid, place, criterion, round(delta, 6) AS delta FROM (SELECT cluster_id, uuid, x.c AS criterion, x.d AS delta, cast(row_number() OVER (PARTITION BY cluster_id, uuid ORDER BY round(abs(x.w * x.d), 9) DESC, x.c) AS int) AS place FROM deltas WHERE abs(x.d) >= 0.005) WHERE place <= 3""")
def reasons_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = view(spark, sf_dir, "sub_scores").select("cluster_id", "uuid", "sharpness", "faces", "exposure")
    return explain.reasons(scores, WEIGHED).select("cluster_id", "uuid", "place", "criterion", F.round("delta", 6).alias("delta"))


@query("sub_scores", sql="&" + TOTALS + """, flags AS (SELECT r.cluster_id, t.one, t.two, r.long_side, r.sharpness FROM ranked r JOIN top t USING (cluster_id)),
of AS (SELECT cluster_id, bool_or(round(one, 9) - round(two, 9) < 0.05) AS a, bool_or(long_side IS NULL) AS b, count(sharpness) = 0 AS c, max(long_side) <= 640 AS d, max(long_side) > min(long_side) * cast(1.35 AS double) AS e, count(*) >= 10 AS f FROM flags GROUP BY cluster_id)
SELECT cluster_id, concat_ws(',', CASE WHEN a THEN 'ambiguous' END, CASE WHEN b THEN 'no-display' END, CASE WHEN c THEN 'no-sharpness' END, CASE WHEN d THEN 'low-detail' END, CASE WHEN e THEN 'mixed-resolution' END, CASE WHEN f THEN 'large-cluster' END) AS notes FROM of""")
def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explain.annotations(scoring.rank_members(_scored(spark, sf_dir))).select("cluster_id", F.array_join("notes", ",").alias("notes"))


@query("sub_scores", sql="&" + TOTALS + " SELECT cluster_id, uuid, CASE WHEN rank = 1 THEN 'keep' ELSE 'cull' END AS mark FROM ranked")
def proposed_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explain.proposed_marks(scoring.rank_members(_scored(spark, sf_dir)))


@query("sizes", sql="""&r AS (SELECT *, cast(width AS double) / height > 1.5 AS wide FROM sizes), c AS (SELECT *, least(width, CASE WHEN wide THEN cast(round_even(height * 1.5, 0) AS bigint) ELSE width END) AS w, least(height, CASE WHEN wide THEN height ELSE cast(round_even(width / cast(1.5 AS double), 0) AS bigint) END) AS h FROM r)
SELECT id, cast(round_even((width - w) * least(1, greatest(0, offset_x)), 0) AS bigint) AS x, cast(round_even((height - h) * least(1, greatest(0, offset_y)), 0) AS bigint) AS y, cast(w AS bigint) AS width, cast(h AS bigint) AS height, w <> width OR h <> height AS needs_crop FROM c""")
def crop_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = view(spark, sf_dir, "sizes").withColumn("crop", scalar.crop_rect(F.col("width"), F.col("height"), 1800, 1200, F.col("offset_x"), F.col("offset_y")))
    return s.select("id", F.col("crop.x").alias("x"), F.col("crop.y").alias("y"), F.col("crop.width").alias("width"), F.col("crop.height").alias("height"), albums.needs_crop(F.col("width"), F.col("height"), F.col("crop")).alias("needs_crop"))


@query(sql="""WITH s AS (SELECT c_custkey AS id, c_custkey % 7 AS a, c_custkey % 5 AS b FROM customer), w AS (SELECT *, list_filter([0, 1, 2, 3, 4, 5], lambda x: x <> a) AS rest FROM s)
SELECT id, CASE WHEN a = b OR a > 5 THEN '0,1,2,3,4,5' ELSE array_to_string(list_concat(list_concat(list_filter(rest, lambda x: x < b), [a]), list_filter(rest, lambda x: x >= b)), ',') END AS sequence FROM w""")
def sequence_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = library.read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.array(*[F.lit(k).cast("bigint") for k in range(6)]).alias("s"))
    return c.select("id", F.array_join(albums.move_before(F.col("s"), F.col("id") % 7, F.col("id") % 5), ",").alias("sequence"))


@query(sql="""WITH c AS (SELECT p_partkey AS id, k, CASE WHEN (p_partkey + k) % 6 = 0 THEN NULL ELSE 100 + (p_partkey * (k + 1)) % 4 * 100 END AS w, CASE WHEN (p_partkey + k) % 6 = 0 THEN NULL ELSE 100 + (p_partkey * (k + 2)) % 3 * 100 END AS h, '/p' || (p_partkey * 7 + k * 5) % 10 AS path
  FROM part, range(3) t(k) WHERE k < p_partkey % 4)
SELECT p.p_partkey AS id, CASE WHEN count(c.id) = 1 THEN max(path) ELSE arg_min(path, (w * h, w, h, path)) FILTER (w IS NOT NULL) END AS analysis, min(path) FILTER ((w * h, w, h) = top) AS display
FROM part p LEFT JOIN (SELECT *, max((w * h, w, h)) FILTER (w IS NOT NULL) OVER (PARTITION BY id) AS top FROM c) c ON c.id = p.p_partkey GROUP BY p.p_partkey""")
def derivative_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    dim = lambda i, a, m: F.when((k + i) % 6 != 0, (100 + (k * (i + a)) % m * 100).cast("int"))
    made = F.array(*[F.struct(dim(i, 1, 4).alias("w"), dim(i, 2, 3).alias("h"), F.concat(F.lit("/p"), ((k * 7 + i * 5) % 10).cast("string")).alias("path")) for i in range(3)])
    p = library.read_table(spark, sf_dir, "part").select(k.alias("id"), F.slice(made, 1, (k % 4).cast("int")).alias("c"))
    return p.withColumn("d", library.derivative_choice(F.col("c"))).select("id", "d.analysis", "d.display")


@query("vectors", sql="SELECT uuid, CASE WHEN member_ord % 5 = 0 THEN 'm1' ELSE '' END AS mod_key FROM vectors WHERE NOT (member_ord % 3 = 0 AND member_ord % 5 <> 0)")
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = view(spark, sf_dir, "vectors")
    wanted = v.select("uuid", F.when(F.col("member_ord") % 5 == 0, "m1").otherwise("").alias("mod_key"), F.lit("print").alias("analysis_key"))
    cached = v.where("member_ord % 3 = 0").select("uuid", F.lit("").alias("mod_key"), F.lit("print").alias("analysis_key"), "embedding")
    return cache.hits_and_misses(wanted, cached)[1].select("uuid", "mod_key")


@query("records", sql="&b AS (SELECT uuid, burst_key, min(uuid) OVER (PARTITION BY burst_key) AS first FROM records) SELECT uuid, CASE WHEN burst_key IS NOT NULL THEN first END AS burst_key FROM b WHERE burst_key IS NULL OR uuid = first OR cast(uuid AS bigint) % 10 <> 7")
def expand_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = view(spark, sf_dir, "records").select("uuid", "burst_key")
    member = F.struct(F.col("uuid"), (F.col("uuid").cast("bigint") % 10 == 7).alias("intrash"))
    keyed = r.where("burst_key is not null").groupBy("burst_key").agg(F.min("uuid").alias("uuid"), F.array_sort(F.collect_list(member)).alias("burst_photos"))
    single = r.where("burst_key is null").select("uuid", F.lit(False).alias("burst"), F.array().cast(keyed.schema["burst_photos"].dataType).alias("burst_photos"))
    photos = keyed.select("uuid", F.lit(True).alias("burst"), "burst_photos").union(single).withColumn("ordinal", F.col("uuid").cast("bigint"))
    return library.expand_bursts(photos).select("uuid", "burst_key")


