"""Counts are exact, draws follow the keys, cuts keep what they must."""

import pytest
from pyspark.sql import functions as F

from tallyfield.functions.rand import hashed, normal
from tallyfield.operators import augment as A
from tallyfield.operators import mixture as M


def test_counts_per_rank():
    assert M.batch_counts([0.4, 0.5, 0.1], 20, 2) == [4, 5, 1]
    assert M.batch_counts([1, 1, 1], 10) == [4, 3, 3]
    with pytest.raises(ValueError):
        M.batch_counts([], 10)


def test_every_batch_has_its_counts(spark):
    data = [("a", f"a{i}") for i in range(10)] + [("b", f"b{i}") for i in range(1000)] + [("c", f"c{i}") for i in range(5)]
    d = spark.createDataFrame(data, "source string, key string")
    counts = dict(zip("abc", M.batch_counts([0.4, 0.5, 0.1], 20, 2)))
    out = M.mixture(d, {**counts, "none": 3}, 30)
    per = {(r["batch"], r["source"]): r["count"] for r in out.groupBy("batch", "source").count().collect()}
    assert per == {(b, s): counts[s] for b in range(30) for s in "abc"}
    again = M.mixture(d.repartition(7), counts, 30, limit=50)
    key = ["batch", "source", "slot", "key"]
    assert sorted(map(tuple, out.select(*key).collect())) == sorted(map(tuple, again.select(*key).collect()))
    places = {b: sorted(r["place"] for r in out.where(F.col("batch") == b).collect()) for b in (0, 7)}
    assert places == {0: list(range(10)), 7: list(range(10))}
    # batches are shuffled, and another rank draws other records
    assert [r["source"] for r in out.where("batch = 0").orderBy("place").collect()] != sorted("a" * 4 + "b" * 5 + "c")
    other = M.mixture(d, counts, 30, rank=1)
    same = out.select(*key, "place").intersect(other.select(*key, "place")).count()
    assert same < 30


def test_uniform_and_normal_draws(spark):
    d = spark.range(20_000)
    u = hashed(1)("x", F.col("id"))
    n = normal(hashed(1), "y", F.col("id"))
    r = d.select(F.avg(u).alias("m"), F.min(u).alias("lo"), F.max(u).alias("hi"), F.avg(n).alias("nm"), F.stddev(n).alias("ns")).first()
    assert 0 <= r["lo"] and r["hi"] < 1 and r["m"] == pytest.approx(0.5, abs=0.02)
    assert r["nm"] == pytest.approx(0, abs=0.03) and r["ns"] == pytest.approx(1, abs=0.03)


def test_never_both_modalities_lost(spark):
    d = spark.range(4000).select("id", (F.col("id") % 10 != 0).alias("has_image"), (F.col("id") % 11 != 0).alias("has_points"))
    out = M.drop_modalities(d, "id", 0.5, 0.5).join(d.select("id", F.col("has_image").alias("i"), F.col("has_points").alias("p")), "id")
    assert out.where("NOT has_image AND NOT has_points AND (i OR p)").count() == 0
    assert out.where("NOT (i AND p) AND (has_image <> i OR has_points <> p)").count() == 0
    both = out.where("i AND p")
    lost = both.where("NOT has_image").count() / both.count()
    assert lost == pytest.approx(0.375, abs=0.04)


@pytest.fixture(scope="module")
def body(spark):
    d = spark.range(400)
    u = hashed(2)
    return d.select(
        F.lit(0).alias("cloud"), F.col("id").alias("idx"), (F.col("id") % 64).alias("channel"),
        (u("a", F.col("id")) * 0.6).alias("x"), (u("b", F.col("id")) * 1.8).alias("y"), (8 + u("c", F.col("id")) * 0.4).alias("z"),
    ).cache()


def test_cuts_take_their_share(body):
    low = A.height_cut(body, "cloud", 0.5)
    assert low.agg(F.max("y")).first()[0] <= 0.91 and 150 < low.count() < 250
    assert A.axis_cut(body, "cloud", "x", 0.25).agg(F.min("x")).first()[0] >= 0.14
    assert A.subsample(body, "cloud", "idx", 0.3).count() == 120


def test_outliers_and_jitter(body):
    out = A.add_outliers(body, "cloud", 0.1, 0.3)
    extra = out.where("outlier")
    assert extra.count() == 40 and extra.where("z < 7.69 OR z > 8.71 OR y < -0.31 OR y > 2.11").count() == 0
    moved = A.jitter(body, "idx", 0.02).select("idx", F.col("x").alias("x1")).join(body, "idx")
    assert moved.select(F.stddev(F.col("x1") - F.col("x"))).first()[0] == pytest.approx(0.02, abs=0.003)
    ray = A.range_jitter(body, "idx", (0.0, 0.0, 0.0), 0.05).select("idx", *[F.col(c).alias(f"{c}1") for c in "xyz"]).join(body, "idx")
    side = F.abs(F.col("x1") * F.col("z") - F.col("x") * F.col("z1"))
    assert ray.select(F.max(side)).first()[0] < 1e-9


def test_channels_and_cover(body):
    kept = A.drop_channels(body, "cloud", "channel", 64, 0.25)
    assert kept.select("channel").distinct().count() == 48
    assert A.drop_channels(body, "cloud", "channel", 64, 1.0).count() == 400  # nothing would remain
    d = body.withColumn("azimuth", F.col("idx") % 52 - 26.0)
    seen = A.cover(d, 64, -26.0, 26.0, top=0.5)
    assert seen.agg(F.min("channel")).first()[0] == 32


def test_occlusion_keeps_enough(spark, body):
    many = body.crossJoin(spark.range(60).select(F.col("id").alias("c"))).select(
        F.col("c").alias("cloud"), (F.col("idx") + F.col("c") * 1000).alias("idx"), "x", "y", "z"
    )
    small = many.where("idx % 1000 < 10").withColumn("cloud", F.col("cloud") + 100)
    out = A.occlude(many.unionByName(small), "cloud", "idx")
    n = {r["cloud"]: r["count"] for r in out.groupBy("cloud").count().collect()}
    assert all(n[c] >= 16 for c in range(60)) and all(n[c] == 10 for c in range(100, 160))
    assert any(n[c] < 300 for c in range(60)) and any(n[c] == 400 for c in range(60))


def test_exactly_n_points(body):
    more = A.sample_points(body, "cloud", "idx", 1000)
    assert more.count() == 1000 and more.where("point_valid").count() == 400
    assert more.where("point_valid").select("idx").distinct().count() == 400
    less = A.sample_points(body, "cloud", "idx", 64)
    assert less.count() == 64 and less.where("NOT point_valid").count() == 0
    assert A.sample_points(body.where("idx < 0"), "cloud", "idx", 64).count() == 0


def test_speed_settings(spark):
    with pytest.raises(ValueError):
        M.sample_speed(hashed(), 35.0, 0.0)
    v = spark.range(2000).select(M.sample_speed(hashed(), 30.0, 20.0, F.col("id")).alias("v"))
    lo, hi = v.agg(F.min("v"), F.max("v")).first()
    assert lo == 0 and hi <= 130 / 3.6


def test_draws_differ_between_clouds(spark):
    points = spark.range(300).select(
        (F.col("id") % 3).alias("cloud"), F.floor(F.col("id") / 3).alias("idx"), *[F.lit(0.0).alias(a) for a in "xyz"]
    )
    noise = A.jitter(points, "idx", 0.02, cloud="cloud")
    assert noise.select("x").distinct().count() == 300
    kept = A.subsample(points, "cloud", "idx", 0.3).groupBy("cloud").agg(F.sort_array(F.collect_list("idx")).alias("i"))
    assert kept.select("i").distinct().count() == 3


def test_occluded_clouds_with_large_ids(spark, tmp_path):
    """The sum of a cloud's ids is beyond a long."""
    from tallyfield.plans.mixtures import clouds_occluded

    rows = spark.range(14).selectExpr(
        "0L AS l_suppkey", "80000000L + id AS l_orderkey", "1 AS l_linenumber", "id AS l_partkey",
        "1.0D AS l_extendedprice", "1.0D AS l_quantity",
    )
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    got = clouds_occluded(spark, str(tmp_path)).collect()  # of fewer than 16 points none is lost
    ids = [((80_000_000 + i) * 10 + 1) * 10**10 + 100 for i in range(14)]
    assert [(r.cloud, r.n, int(r.idx_sum)) for r in got] == [(0, 14, sum(ids))]


def test_resampled_clouds_carry_no_other_columns(spark, monkeypatch):
    from tallyfield.plans import mixtures

    seen, real = [], A.sample_points
    monkeypatch.setattr(mixtures.A, "sample_points", lambda d, *a: seen.append(d.columns) or real(d, *a))
    mixtures.clouds_resampled(spark, "/root/testdata/sf0.001")
    assert seen == [["cloud", "idx"]]


def test_repeats_of_many_clouds_stay_off_the_driver(spark):
    """A cloud asks for many repeats: their rows are dealt out, however few the clouds are."""
    df = spark.range(60).select((F.col("id") % 20).alias("cloud"), F.col("id").alias("idx"))
    df = df.withColumn("cloud", F.when(F.col("cloud") > 0, F.col("cloud")))
    out = A.sample_points(df, "cloud", "idx", 500)
    assert out.columns == ["cloud", "idx", "slot", "point_valid"]
    got = out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan and "isFinalPlan=true" in plan
    own = {(r.cloud, r.idx) for r in df.collect()}
    assert {(r.cloud, r.idx) for r in got} == own == {(r.cloud, r.idx) for r in got if r.point_valid}
    assert sorted((r.cloud or 0, r.slot) for r in got) == [(c, s) for c in range(20) for s in range(500)]
    assert all(r.point_valid == (r.slot < 3) for r in got)
