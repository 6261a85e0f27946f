import random
import statistics

import pyarrow as pa
from pyspark.sql import functions as F

from fernsieve.functions import rasters

SCHEMA = "id int, pixels binary, width int, height bigint, stride int"


def slow(pixels, w, h, s):
    """(laplacian, luma, shadow, highlight), pixel by pixel; None where the bytes do not hold the raster."""
    if None in (pixels, w, h, s) or w < 0 or h < 0 or s < w or (w and h and (h - 1) * s + w > len(pixels)):
        return None
    at = lambda x, y: pixels[y * s + x]
    inner = [4 * at(x, y) - at(x - 1, y) - at(x + 1, y) - at(x, y - 1) - at(x, y + 1) for y in range(1, h - 1) for x in range(1, w - 1)]
    seen = [at(x, y) for y in range(h) for x in range(w)]
    share = lambda hit: sum(map(hit, seen)) / len(seen) if seen else 0.0
    detail = statistics.pvariance(inner) if inner else 0.0
    return detail, sum(seen) / len(seen) / 255 if seen else 0.0, share(lambda v: v <= 3), share(lambda v: v >= 252)


def some_rasters():
    rng = random.Random(6)
    out = []
    for k in range(120):
        w, h, pad = rng.choice([(1, 1), (2, 5), (3, 3), (9, 7), (40, 30), (3, 50)]) + (rng.choice([0, 0, 5]),)
        out.append((k, bytes(rng.choice([0, 3, 4, 128, 251, 252, 255, rng.randrange(256)]) for _ in range((w + pad) * h)), w, h, w + pad))
    whole = bytes(range(256)) * 2
    return out + [(200, None, 3, 3, 3), (201, whole, None, 3, 3), (202, whole, 3, None, 3), (203, whole, 3, 3, None), (204, b"", 0, 0, 0), (205, b"", 3, 3, 3), (206, whole, 16, 33, 16), (207, whole, 0, 9, 4), (208, whole, 9, 9, 3), (209, whole[:29], 9, 3, 10), (210, whole, -1, 4, 4)]


def test_measures_equal_pixel_by_pixel(spark):
    rows = some_rasters()
    for stack in (rasters.STACK_BYTES, 64):
        rasters.STACK_BYTES, kept = stack, rasters.STACK_BYTES
        part = [pa.array(c) for c in zip(*rows)][1:]
        for from_, n in ((0, len(rows)), (7, 90)):  # slices of a batch begin within its buffers
            got = rasters._both.work(*[c.slice(from_, n) for c in part]).to_pylist()
            for g, (_, *raster) in zip(got, rows[from_ : from_ + n], strict=True):
                want = slow(*raster)
                assert (g is None) == (want is None)
                assert g is None or all(abs(a - b) < 1e-7 for a, b in zip(g.values(), want))
        rasters.STACK_BYTES = kept


def test_columns_of_rasters(spark):
    rows = some_rasters()
    args = [F.col(c) for c in ("pixels", "width", "height", "stride")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = df.select("id", rasters.laplacian_variance(*args).alias("v"), rasters.exposure_stats(*args).alias("e"), rasters.raster_measures(*args).alias("b")).collect()
    for r, (k, *raster) in zip(sorted(got), rows, strict=True):
        want = slow(*raster)
        if want is None:
            assert r["v"] is r["e"] is r["b"] is None
        else:
            assert r["id"] == k and abs(r["v"] - want[0]) < 1e-7 and all(abs(a - b) < 1e-9 for a, b in zip(r["e"], want[1:])) and r["b"]["laplacian"] == r["v"]
    assert df.limit(0).select(rasters.raster_measures(*args)).count() == 0
    assert spark.range(1).select(rasters.packed(F.array(F.lit(0), F.lit(9), F.lit(255))).alias("p")).first()["p"] == b"\x00\x09\xff"


def test_a_raster_of_the_usual_size_takes_milliseconds(spark):
    import time

    pixels = pa.array([random.Random(k).randbytes(480 * 360) for k in range(20)])
    sizes = [pa.array([v] * 20) for v in (480, 360, 480)]
    rasters._both.work(pixels, *sizes)
    began = time.thread_time()
    rasters._both.work(pixels, *sizes)
    assert (time.thread_time() - began) / 20 < 0.02  # about 1.2 ms where this was written
