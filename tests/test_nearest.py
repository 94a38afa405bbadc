"""The nearest centre of each point, against all pairs."""

import random

from tallyloom.operators import audit


def test_nearest_points(spark):
    r = random.Random(8)
    points = [(i % 3, i, r.randrange(20) + 0.5, float(r.randrange(20))) for i in range(200)] + [(0, 900, None, 1.0), (7, 901, 1.0, 1.0), (0, 902, 5.0, 5.0), (0, 902, 5.0, 5.0)]
    centres = [(i % 3, float(r.randrange(20)), float(r.randrange(20))) for i in range(60)] + [(0, 4.0, 5.0), (0, 6.0, 5.0), (8, 0.0, 0.0), (1, None, 2.0)]
    p, c = spark.createDataFrame(points, "instance_id int, item long, x double, y double"), spark.createDataFrame(centres, "instance_id int, cx double, cy double")
    want = {}
    for i, item, x, y in points:
        near = [(((x - cx) ** 2 + (y - cy) ** 2) ** 0.5, cx, cy) for j, cx, cy in centres if i == j and x is not None and cx is not None]
        if near:
            want[i, item] = min(near)
    for part in (5, 4096):
        rows = audit.nearest_points(p, c, part).collect()
        assert {(q.instance_id, q.item): (q.distance, q.cx, q.cy) for q in rows} == want and len(rows) == len(want)


def test_pairs_are_not_shuffled(spark):
    """A hundred thousand points and ten thousand centres of one instance: 10**9 pairs."""
    from pyspark.sql import functions as F

    p = spark.range(100_000).select(F.lit(1).alias("instance_id"), F.col("id").alias("item"), (F.col("id") % 317).alias("x"), (F.col("id") % 101).alias("y"))
    c = spark.range(10_000).select(F.lit(1).alias("instance_id"), (F.col("id") % 100).alias("cx"), (F.col("id") / 100).cast("int").alias("cy"))
    got = audit.nearest_points(p, c).agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("d")).first()
    assert (got.n, round(got.d, 6)) == (100_000, round((217**2 + 1) ** 0.5, 6))
