import numpy as np
from pyspark.sql import functions as F

from framesieve.functions import tables as TF
from framesieve.operators import stars as S
from framesieve.plans.star_queries import _luma


def test_stars_by_sql_and_by_frames(spark, sf):
    TF.register(spark)
    skies = _luma(spark, sf)
    skies.unionByName(skies.limit(1).withColumns({"frame": F.lit(-1).cast("long"), "luma": F.lit(None).cast("array<double>")})).createOrReplaceTempView("skies")
    got = spark.sql("SELECT f.frame, s.* FROM skies f, LATERAL frame_stars(f.width, f.height, f.luma) s")
    want = S.detect_stars(skies)
    assert got.columns == want.columns and sorted(tuple(map(str, r)) for r in got.collect()) == sorted(tuple(map(str, r)) for r in want.collect())


def test_triangles_by_sql(spark):
    TF.register(spark)
    rng = np.random.default_rng(0)
    rows = [(g, i, float(x), float(y)) for g in range(3) for i, (x, y) in enumerate(rng.uniform(0, 50, (6, 2)))]
    stars = spark.createDataFrame(rows, "frame int, star_id int, x double, y double")
    stars.createOrReplaceTempView("stars_of_frames")
    got = spark.sql("SELECT g.frame, t.* FROM (SELECT frame, collect_list(struct(star_id, x, y)) AS s FROM stars_of_frames GROUP BY frame) g, LATERAL star_triangles(g.s) t")
    a, b, c = (stars.alias(n) for n in "abc")
    def far(p, q):
        return F.hypot(F.col(f"{p}.x") - F.col(f"{q}.x"), F.col(f"{p}.y") - F.col(f"{q}.y"))

    sides = F.sort_array(F.array(far("a", "b"), far("b", "c"), far("c", "a")), asc=False)
    joined = a.join(b, F.expr("a.frame = b.frame AND a.star_id < b.star_id")).join(c, F.expr("c.frame = b.frame AND b.star_id < c.star_id"))
    want = joined.select("a.frame", "a.star_id", "b.star_id", "c.star_id", *(sides[i] for i in range(3)))
    one, two = (sorted((*r[:4], *(round(v, 9) for v in r[4:])) for r in df.collect()) for df in (got, want))
    assert one == two and len(one) == 60


def test_backgrounds_by_sql(spark, sf):
    TF.register(spark)
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    table.select("vec_id", F.explode("embedding").alias("v")).createOrReplaceTempView("samples")
    spark.sql("SELECT -1 AS vec_id, cast(null AS float) AS v UNION ALL SELECT * FROM samples").createOrReplaceTempView("samples_with_none")
    got = {r.vec_id: r.b for r in spark.sql("SELECT vec_id, clipped_background(v) AS b FROM samples_with_none GROUP BY vec_id").collect()}
    assert got.pop(-1) is None
    assert got == {r.vec_id: S.clipped_background(np.array(r.embedding, np.float32).astype(float))[0] for r in table.collect()}
