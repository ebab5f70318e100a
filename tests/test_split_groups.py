"""The paths for groups too large for one task give the rows of the plain ones."""

import random

import pytest
from pyspark.sql import functions as F

from tallyfield.operators import ordered as O
from tallyfield.operators.augment import sample_points, subsample
from tallyfield.operators.evaluation import average_precision
from tallyfield.operators.matching import greedy_match
from tallyfield.operators.mixture import pack_tracks
from tallyfield.operators.points import farthest_points
from tallyfield.operators.quantiles import quantiles
from tallyfield.operators.sequences import pick_even, smooth_pairs, track_sessions


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.fixture(scope="module")
def hot(spark):
    """One group with most rows, one of a single row, a few in between, gaps and ties."""
    rnd = random.Random(3)
    data = [(0 if i % 3 else i % 7, i, rnd.randint(0, 50) if i % 11 else None) for i in range(900)]
    data.append((99, 5000, 7))
    return spark.createDataFrame(data, "g int, i int, v int").repartition(5).cache()


def running(df, limit):
    d = O.Ordered(df, ["g"], ["i"], limit)
    d.add(
        rn=O.row_number(),
        total=O.running_sum(F.col("v")),
        low=O.running_min(F.col("v")),
        before=O.min_before(F.col("v")),
        high=O.running_max(F.col("v")),
        later=O.max_from_here(F.col("v")),
        prev=O.previous(F.col("v")),
        fill=O.carried(F.col("v")),
        n=O.group_total(),
        s=O.group_total(F.col("v")),
    )
    return d


def test_running_values_do_not_depend_on_the_split(hot):
    names = ["g", "i", "rn", "total", "low", "before", "high", "later", "prev", "fill", "n", "s"]
    plain, split = running(hot, 10_000), running(hot, 20)
    assert not plain.split and split.split

    def all_rows(d):
        return sorted((tuple(r) for r in d.result().select(*names).collect()), key=lambda r: r[:2])

    assert all_rows(plain) == all_rows(split)


def test_running_values_build_on_each_other(hot):
    def two_steps(limit):
        d = O.Ordered(hot, ["g"], ["i"], limit).add(rn=O.row_number())
        d.add(half=O.running_sum((F.col("rn") % 2)))
        return rows(d.result(), "g", "i", "rn", "half")

    assert two_steps(10_000) == two_steps(20)


def test_any_column_names(spark, hot):
    mine = ["_part", "_pos", "_back", "_own_rn", "_sum_rn", "_in_rn", "_k_g", "__POS", "_k__part"]
    d = hot.withColumns({c: F.lit(k) + F.col("i") for k, c in enumerate(mine)})

    def done(limit):
        o = O.Ordered(d, ["g"], ["i"], limit).add(rn=O.row_number(), later=O.max_from_here(F.col("v")))
        return o.add(total=O.running_sum(F.col("_part")), prev=O.previous(F.col("_pos"))).result()

    plain, split = done(10_000), done(20)
    names = ["g", "i", "v", *mine, "rn", "later", "total", "prev"]
    assert plain.columns == split.columns == names
    assert sorted(map(str, plain.collect())) == sorted(map(str, split.collect()))
    o = O.Ordered(hot, ["g"], ["i"], 20).add(_part=O.row_number())
    assert rows(o.add(n=O.group_total()).result(), "g", "i", "_part") == rows(O.Ordered(hot, ["g"], ["i"]).add(_part=O.row_number()).result(), "g", "i", "_part")


def test_order_may_go_down_and_groups_may_be_absent(hot):
    def numbered(limit):
        d = O.Ordered(hot, [], [F.col("i").desc()], limit).add(rn=O.row_number())
        return rows(d.result(), "i", "rn")

    assert numbered(10_000) == numbered(20)


@pytest.mark.parametrize("lower", [False, True])
def test_quantiles(hot, lower):
    want = {"p10": 0.1, "p50": 0.5, "p90": 0.9}
    a = quantiles(hot, ["g"], F.col("v"), want, lower, limit=10_000)
    b = quantiles(hot, ["g"], F.col("v"), want, lower, limit=5)
    assert [tuple(round(x, 9) for x in r) for r in rows(a, "g", *want)] == [
        tuple(round(x, 9) for x in r) for r in rows(b, "g", *want)
    ]


def test_median_linear_and_lower(spark):
    d = spark.createDataFrame([(0, float(x)) for x in (1, 2, 3, 10)] + [(0, float("nan"))], "g int, v double")
    assert quantiles(d, ["g"], F.col("v"), {"m": 0.5}).first()["m"] == 2.5
    assert quantiles(d, ["g"], F.col("v"), {"m": 0.5}, lower=True).first()["m"] == 2.0


def test_average_precision_split(spark):
    rnd = random.Random(1)
    data = [(0, i, rnd.choice([0.1, 0.5, 0.9]), rnd.random()) for i in range(400)]
    d = spark.createDataFrame(data, "g int, k int, score double, iou double")
    a = average_precision(d, ["g"], "iou", "score", "k", limit=10_000).first()
    b = average_precision(d, ["g"], "iou", "score", "k", limit=30).first()
    for c in a.asDict():
        assert a[c] == pytest.approx(b[c], abs=1e-12)


def test_greedy_rounds_equal_greedy_order(spark):
    rnd = random.Random(5)
    data = [(f, a, b, rnd.choice([0.1, 0.2, 0.5, 0.9])) for f in range(3) for a in range(9) for b in range(9)]
    d = spark.createDataFrame(data, "frame int, label int, mask int, score double")
    plain = greedy_match(d, ["frame"], "label", "mask")
    rounds = greedy_match(d, ["frame"], "label", "mask", frame_limit=5)
    cols = ["frame", "label", "mask", "score"]
    assert rows(plain, *cols) == rows(rounds, *cols)


def test_packing_ranges_equal_one_walk(spark):
    rnd = random.Random(7)
    lengths = [rnd.randint(1, 40) for _ in range(120)] + [300]
    data = [(t, i) for t, n in enumerate(lengths) for i in range(n)]
    d = spark.createDataFrame(data, "track int, i int")
    a = pack_tracks(d, "track", 96).select("track", "batch").distinct()
    b = pack_tracks(d, "track", 96, limit=10).select("track", "batch").distinct()
    assert rows(a, "track", "batch") == rows(b, "track", "batch")
    fill, batch, want = 0, 0, []
    for t, n in enumerate(lengths):
        if fill and fill + n > 96:
            fill, batch = 0, batch + 1
        fill += n
        want.append((t, batch))
    assert rows(a, "track", "batch") == want


def test_farthest_points_rounds(spark):
    rnd = random.Random(9)
    data = [(c, i, rnd.random(), rnd.random(), rnd.random()) for c in range(3) for i in range(60)]
    d = spark.createDataFrame(data, "cloud int, idx int, x double, y double, z double")
    a = farthest_points(d, "cloud", "idx", 6)
    b = farthest_points(d, "cloud", "idx", 6, cloud_limit=10)
    assert rows(a, "cloud", "rank", "idx") == rows(b, "cloud", "rank", "idx")
    first = [r for r in rows(a, "cloud", "rank", "idx") if r[1] == 0]
    assert first == [(0, 0, 0), (1, 0, 0), (2, 0, 0)]


@pytest.mark.parametrize("how", ["floor", "ends", "ends_cut", "series"])
def test_even_picks(hot, how):
    a = pick_even(hot, 7, ["g"], ["i"], how)
    b = pick_even(hot, 7, ["g"], ["i"], how, limit=20)
    assert rows(a, "g", "i") == rows(b, "g", "i")
    for g, n in hot.groupBy("g").count().collect():
        got = a.where(F.col("g") == g).count()
        assert got == min(n, 7)


def test_pairs_and_sessions(hot):
    for limit in (10_000, 20):
        pairs = smooth_pairs(hot, ["g"], "i", "i", 3, limit)
        assert all(r["dt"] < 3 for r in pairs.collect())
    a = track_sessions(hot, ["g"], "i", "i", 3)
    b = track_sessions(hot, ["g"], "i", "i", 3, 20)
    assert rows(a, "g", "i", "session") == rows(b, "g", "i", "session")


def test_samples_do_not_depend_on_partitions(hot):
    d = hot.select("g", "i", F.lit(0.0).alias("x"))
    for fn in (lambda x: subsample(x, "g", "i", 0.3), lambda x: sample_points(x, "g", "i", 12)):
        assert rows(fn(d.repartition(1)), "g", "i") == rows(fn(d.repartition(8)), "g", "i")
    assert rows(subsample(d, "g", "i", 0.3), "g", "i") == rows(
        subsample(d, "g", "i", 0.3, limit=20), "g", "i"
    )


def test_quantiles_with_infinities_are_the_same_split(spark):
    from tallyfield.operators.quantiles import quantiles

    rows = [("a", 1.0), *[("a", float("inf"))] * 3, ("b", float("nan")), ("b", 2.0), ("b", None)]
    d = spark.createDataFrame(rows, "g string, v double")
    wanted = {"p50": 0.5, "p90": 0.9}
    got = [sorted(map(tuple, quantiles(d, ["g"], F.col("v"), wanted, limit=n).collect())) for n in (1, 100)]
    assert got[0] == got[1] == [("a", float("inf"), float("inf")), ("b", 2.0, 2.0)]


def test_greedy_match_without_keys_is_the_same_split(spark):
    from tallyfield.operators.matching import greedy_match

    rows = [(1, "a", "x", 0.9), (1, None, "x", 0.8), (1, "b", None, 0.7), (1, "b", "y", float("nan")), (1, "b", "x", 0.5)]
    d = spark.createDataFrame(rows, "f int, label string, mask string, score double")
    got = [[tuple(r) for r in greedy_match(d, ["f"], "label", "mask", frame_limit=n).collect()] for n in (0, 100)]
    assert got[0] == got[1] == [(1, "a", "x", 0.9)]


@pytest.mark.parametrize("limit", [1, 100])
def test_quantiles_of_several_columns_are_those_of_each(spark, limit):
    from tallyfield.operators.quantiles import quantiles_of

    inf, nan = float("inf"), float("nan")
    data = [("a", 1.0, inf), ("a", 4.0, None), ("a", 2.0, inf), ("b", nan, 3.0), (None, 5.0, -inf), ("c", None, nan)]
    d = spark.createDataFrame(data, "g string, x double, y double")
    names = {"x": {"x_m": 0.5, "x_p": 0.9}, "y": {"y_m": 0.5}}
    got = quantiles_of(d, ["g"], [(F.col(c), n) for c, n in names.items()], limit).collect()
    want = {c: {r["g"]: r for r in quantiles(d, ["g"], F.col(c), n).collect()} for c, n in names.items()}
    assert {r["g"] for r in got} == {"a", "b", None}
    for r in got:
        for c, n in names.items():
            for name in n:
                assert r[name] == (want[c][r["g"]][name] if r["g"] in want[c] else None)
