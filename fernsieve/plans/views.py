"""Inputs of the catalogue's queries as SQL over the driver's tables; the same text runs on Spark and on DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fernsieve.sources.library import read_table

RECORDS = """
SELECT lpad(cast(event_id AS varchar(20)), 10, '0') AS uuid, ts AS date, event_type = 'purchase' AS is_video, event_type = 'view' AS is_screenshot,
  event_type = 'error' AS is_screen_recording, event_type = 'signup' AS is_burst, event_id % 3 = 0 AS is_selfie, cast(floor(value * 1000) AS bigint) AS filesize,
  CASE WHEN event_type = 'purchase' AND event_id % 7 <> 0 THEN value / 10.0 END AS duration_seconds,
  event_id % 17 = 0 AS is_favorite, event_id % 23 = 0 AS is_hidden, event_id % 13 = 0 AS is_shared, CASE WHEN event_id % 5 = 0 THEN 0 ELSE 1 END AS album_count,
  CASE WHEN event_id % 4 <> 0 THEN cast(37.0 AS double) + (event_id % 97) * cast(0.05 AS double) END AS latitude,
  CASE WHEN event_id % 4 <> 0 THEN cast(-122.0 AS double) + (event_id % 89) * cast(0.05 AS double) END AS longitude,
  CASE WHEN event_type = 'signup' THEN concat(cast(user_id AS varchar(20)), '-', props) END AS burst_key,
  CASE WHEN event_id % 11 <> 0 THEN concat('/d/', cast(event_id AS varchar(20))) END AS derivative_path,
  CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN '' ELSE concat('f', cast(event_id % 3000 AS varchar(20))) END AS fingerprint
FROM events
"""
VECTORS = "SELECT label AS bucket_id, lpad(cast(vec_id AS varchar(20)), 10, '0') AS uuid, vec_id AS member_ord, embedding FROM embeddings"
FINGERPRINTS = """
SELECT lpad(cast(d.doc_id AS varchar(20)), 10, '0') AS uuid, d.text AS fingerprint, cast(NULL AS timestamp) AS date, coalesce(l.toxic, 0) = 1 AS is_shared, false AS is_favorite, false AS is_hidden
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""
BATCHES = "SELECT event_id AS batch_id, user_id AS cluster_key FROM events WHERE event_type IN ('view', 'click')"
UNDOS = """
SELECT max(b.event_id) AS batch_id FROM events e JOIN events b ON b.user_id = e.user_id AND b.event_type IN ('view', 'click') AND b.event_id < e.event_id AND b.event_id >= e.event_id - 20
WHERE e.event_type = 'error' GROUP BY e.event_id
"""
MARKS = """
SELECT b.batch_id, b.cluster_key, b.cluster_key * 10 + j.j AS photo_id, CASE WHEN (b.batch_id + j.j) % 3 = 0 THEN 'keep' WHEN (b.batch_id + j.j) % 3 = 1 THEN 'cull' ELSE 'unset' END AS mark,
  (b.batch_id + j.j) % 6 = 0 AS favorite, CASE WHEN (b.cluster_key * 10 + j.j) % 5 = 0 THEN 'm1' ELSE '' END AS mod_key
FROM batches b CROSS JOIN (SELECT 0 AS j UNION ALL SELECT 1 UNION ALL SELECT 2) j
"""
LIVE = """
SELECT DISTINCT photo_id, CASE WHEN photo_id % 29 = 0 THEN 'm2' ELSE mod_key END AS mod_key FROM marks WHERE photo_id % 19 <> 0
"""
SUB_SCORES = """
SELECT label AS cluster_id, lpad(cast(vec_id AS varchar(20)), 10, '0') AS uuid,
  CASE WHEN label % 4 = 0 AND vec_id % 10 = 0 THEN NULL ELSE cast((vec_id * 7) % 100 AS double) / cast(100 AS double) END AS sharpness,
  cast((vec_id * 13) % 100 AS double) / cast(100 AS double) AS exposure,
  CASE WHEN label % 3 = 0 AND vec_id % 5 = 0 THEN NULL ELSE cast((vec_id * 29) % 100 AS double) / cast(100 AS double) END AS faces,
  cast((vec_id * 31) % 500 AS double) AS laplacian, cast(CASE WHEN label % 2 = 0 THEN 480 ELSE 400 + (vec_id % 3) * 40 END AS int) AS width, cast(360 AS int) AS height,
  cast(CASE WHEN vec_id % 41 = 0 AND label = 5 THEN NULL WHEN label = 6 THEN 600 ELSE 1000 + (vec_id % (label + 2)) * 100 END AS int) AS long_side
FROM embeddings
"""
SIZES = """
SELECT p_partkey AS id, cast(1000 + (p_partkey * 37) % 3000 AS int) AS width, cast(800 + (p_partkey * 53) % 2500 AS int) AS height,
  cast((p_partkey % 11) AS double) / cast(10 AS double) AS offset_x, cast((p_partkey % 13) AS double) / cast(10 AS double) AS offset_y FROM part
"""
ENTRIES = """
SELECT l_orderkey AS album_id, l_linenumber AS place, CASE WHEN l_partkey % 37 <> 0 THEN l_partkey END AS uuid, CASE WHEN l_linenumber % 3 <> 0 THEN cast(l_linenumber AS double) / cast(8 AS double) END AS offset_x, cast(l_quantity AS double) / cast(50 AS double) AS offset_y FROM lineitem
"""
ALBUM_PHOTOS = "SELECT p_partkey AS uuid, CASE WHEN p_partkey % 7 <> 0 THEN p_partkey % 5 < 2 END AS adjusted FROM part WHERE p_partkey % 19 <> 0"
RENDITIONS = """
SELECT p_partkey AS uuid, k.k = 1 AS edited, CASE WHEN p_partkey % 23 <> k.k THEN concat('/r/', cast(p_partkey AS varchar(20)), CASE WHEN k.k = 1 THEN '-edited' ELSE '' END) END AS path,
  cast(CASE WHEN p_partkey % 29 = 0 THEN NULL ELSE 1000 + (p_partkey * 37 + k.k * 500) % 3000 END AS int) AS width, cast(800 + (p_partkey * 53) % 2500 AS int) AS height
FROM part CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) k WHERE k.k = 0 OR p_partkey % 10 <> 1
"""
VIEWS = {"records": RECORDS, "vectors": VECTORS, "fingerprints": FINGERPRINTS, "batches": BATCHES, "undos": UNDOS, "marks": MARKS, "live": LIVE, "sub_scores": SUB_SCORES, "sizes": SIZES, "entries": ENTRIES, "album_photos": ALBUM_PHOTOS, "renditions": RENDITIONS}
NEEDS = {"records": ("events",), "vectors": ("embeddings",), "fingerprints": ("documents", "labels"), "batches": ("events",), "undos": ("events",), "marks": ("batches",), "live": ("marks",), "sub_scores": ("embeddings",), "sizes": ("part",), "entries": ("lineitem",), "album_photos": ("part",), "renditions": ("part",)}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of VIEWS, or a table."""
    if name not in VIEWS:
        return read_table(spark, sf_dir, name)
    text, inputs = VIEWS[name], {}
    for need in NEEDS[name]:
        inputs[f"t_{need}"] = view(spark, sf_dir, need)
        for before in (f"FROM {need}", f"JOIN {need}"):
            text = text.replace(before, before.replace(need, f"{{t_{need}}}"))
    return spark.sql(text, **inputs)


def with_views(*names: str) -> str:
    """A WITH clause that defines these views, and those that they need, for DuckDB."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in VIEWS and name not in order:
            for need in NEEDS[name]:
                add(need)
            order.append(name)

    for name in names:
        add(name)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order)
