"""Stars of one frame against those of another: neighbours, triangles, and the transform between the frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Radius of a neighbour, least triangle side, tolerance of side ratios, bins of votes (pixels, pixels, radians).
NEIGHBOUR, LEAST_SIDE, RATIO_TOLERANCE, VOTE_SHIFT, VOTE_ANGLE = 10.0, 1.0, 0.02, 3.0, 0.005


def nearest(stars: DataFrame, references: DataFrame, by: list[str], radius: float = NEIGHBOUR) -> DataFrame:
    """(by, star_id, ref_id, distance): each star's nearest reference star closer than ``radius``, ties to the smaller id.

    Positions fall into cells of the radius; a star asks its own and the eight cells around, an equi-join.
    """
    def cell(c: str) -> Column:
        return F.floor(F.col(c) / radius)

    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    asked = stars.select(*by, "star_id", "x", "y", around.alias("s")).select(*by, "star_id", "x", "y", (cell("x") + F.col("s.i")).alias("gx"), (cell("y") + F.col("s.j")).alias("gy"))
    there = references.select(*by, F.col("star_id").alias("ref_id"), F.col("x").alias("rx"), F.col("y").alias("ry"), cell("x").alias("gx"), cell("y").alias("gy"))
    distance = F.sqrt((F.col("x") - F.col("rx")) * (F.col("x") - F.col("rx")) + (F.col("y") - F.col("ry")) * (F.col("y") - F.col("ry")))
    close = asked.join(there, [*by, "gx", "gy"]).withColumn("distance", distance).where(F.col("distance") < radius)
    best = close.groupBy(*by, "star_id").agg(F.min(F.struct("distance", "ref_id")).alias("b"))
    return best.select(*by, "star_id", F.col("b.ref_id").alias("ref_id"), F.col("b.distance").alias("distance"))


def triangles(stars: DataFrame, by: list[str]) -> DataFrame:
    """(by, i, j, k, r1, r2, orientation): every triangle of a frame's stars with all sides LEAST_SIDE or longer.

    r1 and r2 are the middle and short side over the long one. Give a bounded number of stars a frame (the
    brightest 30): a frame's stars are gathered in one row and combined there.
    """
    gathered = stars.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("star_id", "x", "y"))).alias("s"))
    first = gathered.select(*by, "s", F.posexplode("s").alias("p", "a"))
    second = first.select(*by, "s", "a", F.posexplode(F.slice("s", F.col("p") + 2, F.size("s"))).alias("q", "b"), "p")
    third = second.select(*by, "a", "b", F.explode(F.slice("s", F.col("p") + F.col("q") + 3, F.size("s"))).alias("c"))

    def side(a: str, b: str) -> Column:
        return F.sqrt((F.col(f"{a}.x") - F.col(f"{b}.x")) * (F.col(f"{a}.x") - F.col(f"{b}.x")) + (F.col(f"{a}.y") - F.col(f"{b}.y")) * (F.col(f"{a}.y") - F.col(f"{b}.y")))

    sides = F.array_sort(F.array(side("a", "b"), side("b", "c"), side("a", "c")))
    cross = (F.col("b.x") - F.col("a.x")) * (F.col("c.y") - F.col("a.y")) - (F.col("b.y") - F.col("a.y")) * (F.col("c.x") - F.col("a.x"))
    sized = third.withColumns({"d": sides, "cross": cross}).where(F.get("d", F.lit(0)) >= LEAST_SIDE)
    return sized.select(
        *by,
        F.col("a.star_id").alias("i"),
        F.col("b.star_id").alias("j"),
        F.col("c.star_id").alias("k"),
        (F.get("d", F.lit(1)) / F.get("d", F.lit(2))).alias("r1"),
        (F.get("d", F.lit(0)) / F.get("d", F.lit(2))).alias("r2"),
        F.when(F.col("cross") >= 0, 1).otherwise(-1).alias("orientation"),
    )


def match_triangles(left: DataFrame, right: DataFrame, by: list[str], tolerance: float = RATIO_TOLERANCE) -> DataFrame:
    """Pairs of triangles of equal orientation whose ratios are within ``tolerance``: (by, i, j, k, ri, rj, rk, gap).

    Ratios fall into cells of the tolerance; each left triangle asks nine of them, an equi-join.
    """
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    asked = left.withColumn("s", around).withColumns({"c1": F.floor(F.col("r1") / tolerance) + F.col("s.i"), "c2": F.floor(F.col("r2") / tolerance) + F.col("s.j")}).drop("s")
    there = right.select(*by, "orientation", F.col("i").alias("ri"), F.col("j").alias("rj"), F.col("k").alias("rk"), F.col("r1").alias("q1"), F.col("r2").alias("q2"), F.floor(F.col("r1") / tolerance).alias("c1"), F.floor(F.col("r2") / tolerance).alias("c2"))
    gap = F.sqrt((F.col("r1") - F.col("q1")) * (F.col("r1") - F.col("q1")) + (F.col("r2") - F.col("q2")) * (F.col("r2") - F.col("q2")))
    return asked.join(there, [*by, "orientation", "c1", "c2"]).withColumn("gap", gap).where(F.col("gap") <= tolerance).select(*by, "i", "j", "k", "ri", "rj", "rk", "gap")


def similarity_of_pairs(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, a, b, tx, ty): the least-squares similarity that takes (fx, fy) to (rx, ry); null with less than 2 pairs or no spread.

    x' = a x - b y + tx, y' = b x + a y + ty.
    """
    means = pairs.groupBy(*by).agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m{c}") for c in ("fx", "fy", "rx", "ry")))
    joined = pairs.join(means, by)
    fx, fy, rx, ry = (F.col(c) - F.col(f"m{c}") for c in ("fx", "fy", "rx", "ry"))
    sums = joined.groupBy(*by, "n", "mfx", "mfy", "mrx", "mry").agg(F.sum(fx * fx + fy * fy).alias("ff"), F.sum(fx * rx + fy * ry).alias("sa"), F.sum(fx * ry - fy * rx).alias("sb"))
    sound = (F.col("n") >= 2) & (F.abs("ff") >= 1e-10)
    solved = sums.withColumns({"a": F.when(sound, F.col("sa") / F.col("ff")), "b": F.when(sound, F.col("sb") / F.col("ff"))})
    return solved.select(*by, "n", "a", "b", (F.col("mrx") - F.col("a") * F.col("mfx") + F.col("b") * F.col("mfy")).alias("tx"), (F.col("mry") - F.col("b") * F.col("mfx") - F.col("a") * F.col("mfy")).alias("ty"))


def vote(transforms: DataFrame, by: list[str]) -> DataFrame:
    """(by, vx, vy, va, votes): the bin of shift and turn, rounded, that most transforms fall into; ties to the smallest bin."""
    binned = transforms.groupBy(*by, *(F.round(F.col(c) / size).cast("long").alias(v) for c, size, v in (("tx", VOTE_SHIFT, "vx"), ("ty", VOTE_SHIFT, "vy"), ("theta", VOTE_ANGLE, "va")))).agg(F.count("*").alias("votes"))
    best = binned.groupBy(*by).agg(F.min(F.struct(-F.col("votes"), "vx", "vy", "va", "votes")).alias("b"))
    return best.select(*by, "b.vx", "b.vy", "b.va", "b.votes")
