"""Hand-computed cases: ties, boundaries, gaps, single members, leakage."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from chronopanel.functions import text as T
from chronopanel.operators import inference, joins, monitor, rolling, splits
from chronopanel.operators.asof import asof_join, mask_to_members
from chronopanel.sources import sinks


def day(n: int) -> dt.date:
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def test_asof_same_day_strict_and_ties(spark):
    left = spark.createDataFrame([("a", day(1)), ("a", day(5)), ("b", day(5))], "k string, t date")
    right = spark.createDataFrame([("a", day(1), 1), ("a", day(1), 3), ("a", day(3), None)], "k string, at date, v int")
    rows = {(r.k, r.t): (r.at, r.v) for r in asof_join(left, right, "t", "at", ["k"], ties=("v",)).collect()}
    assert rows[("a", day(1))] == (day(1), 3)
    assert rows[("a", day(5))] == (day(3), None)  # a matched fact is carried with its null
    assert rows[("b", day(5))] == (None, None)
    strict = {(r.k, r.t): r.v for r in asof_join(left, right, "t", "at", ["k"], strict=True, ties=("v",)).collect()}
    assert strict[("a", day(1))] is None


def test_asof_forward_and_tolerance(spark):
    left = spark.createDataFrame([(day(2),), (day(9),)], "t date")
    right = spark.createDataFrame([(day(2),), (day(4),)], "at date")
    assert {r.t: r.at for r in asof_join(left, right, "t", "at", forward=True).collect()} == {day(2): day(2), day(9): None}
    assert {r.t: r.at for r in asof_join(left, right, "t", "at", forward=True, strict=True).collect()} == {day(2): day(4), day(9): None}
    assert {r.t: r.at for r in asof_join(left, right, "t", "at", tolerance_days=2).collect()} == {day(2): day(2), day(9): None}


def test_asof_does_not_see_the_future(spark):
    left = spark.createDataFrame([("a", day(3))], "k string, t date")
    right = spark.createDataFrame([("a", day(1), 1), ("a", day(4), 2)], "k string, at date, v int")
    whole = asof_join(left, right, "t", "at", ["k"]).collect()
    cut = asof_join(left, right.where(F.col("at") <= day(3)), "t", "at", ["k"]).collect()
    assert whole == cut and whole[0].v == 1


def test_members_before_first_snapshot_are_dropped(spark):
    panel = spark.createDataFrame([(day(0), "a"), (day(5), "a"), (day(5), "b"), (day(20), "a")], "date date, ticker string")
    members = spark.createDataFrame([(day(2), "a"), (day(10), "b")], "date date, ticker string")
    assert {(r.date, r.ticker) for r in mask_to_members(panel, members).collect()} == {(day(5), "a")}


def test_windows_count_sessions_and_known_values(spark):
    rows = [("a", day(i), v) for i, v in enumerate([10.0, None, 11.0, 12.0])] + [("b", day(1), 5.0)]
    grid = rolling.dense_grid(spark.createDataFrame(rows, "ticker string, date date, close double"))
    assert grid.count() == 8
    out = {(r.ticker, r.date): (r.r, r.p, r.m) for r in grid.select("ticker", "date", rolling.simple_return().alias("r"), rolling.simple_return(pad=True).alias("p"), rolling.momentum(2, "close").alias("m")).collect()}
    assert out[("a", day(2))][0] is None and abs(out[("a", day(2))][1] - 0.1) < 1e-12
    assert out[("a", day(3))][2] == 23.0 and out[("a", day(2))][2] is None


def test_peer_mean_of_one_is_null(spark):
    df = spark.createDataFrame([(1, "x", 2.0), (1, "x", 4.0), (1, "y", 9.0), (1, "x", None)], "d int, g string, v double")
    got = sorted((r.g, r.v, r.o) for r in df.select("g", "v", rolling.others_mean("v", "d", "g").alias("o")).where("v is not null").collect())
    assert got == [("x", 2.0, 4.0), ("x", 4.0, 2.0), ("y", 9.0, None)]


def test_average_ranks_and_thin_dates(spark):
    df = spark.createDataFrame([(1, float(i), float(-i)) for i in range(6)] + [(2, 1.0, 1.0)], "d int, s double, y double")
    ic = inference.rank_ic(df, ["d"], "s", "y").collect()
    assert len(ic) == 1 and abs(ic[0].ic + 1) < 1e-12


def test_hac_of_white_series(spark):
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate([1, -1, 1, -1])], "k string, i int, x double")
    h = inference.hac(df, ["k"], "i", "x", max_lag=1).first()
    assert h.n == 4 and h.mean == 0.0 and abs(h.se - ((1 + 2 * 0.5 * (-3 / 4)) / 4) ** 0.5) < 1e-12


def test_frame_diff_and_safe_divide(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0), ("z", 3.0)], "k string, v double")
    b = spark.createDataFrame([("y", 2.0), ("z", 4.0), ("w", 1.0)], "k string, v double")
    assert {r.k: r.change for r in joins.frame_diff(a, b, ["k"], "v").collect()} == {"x": "exited", "z": "increased", "w": "new"}
    assert spark.range(1).select(joins.safe_divide(F.lit(1.0), F.lit(0.0)).alias("r")).first().r is None


def test_purge_removes_overlapping_labels(spark):
    rows = [(day(i), day(i + 3)) for i in range(12)]
    df = spark.createDataFrame(rows, "date date, end date")
    t = splits.tag_walk_forward(df, splits.walk_forward_folds(df, "date", 2), "date", "end").collect()
    for fold in {r.fold for r in t}:
        start = min(r.date for r in t if r.fold == fold and r.role == "test")
        assert all(r.end <= start for r in t if r.fold == fold and r.role == "train")


def test_buckets_closed_on_the_right_side(spark):
    e = F.array(F.lit(1.0), F.lit(2.0))
    r = spark.range(1).select(monitor.bucket(F.lit(1.0), e).alias("right"), monitor.bucket(F.lit(1.0), e, False).alias("left")).first()
    assert (r.right, r.left) == (0, 1)


def test_append_is_idempotent_and_keeps_nulls(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    df = spark.createDataFrame([(1, None), (2, "b"), (2, "b")], "a int, b string")
    sinks.append_new_rows(df, path)
    sinks.append_new_rows(df, path)
    assert spark.read.parquet(path).count() == 2


def test_text_functions(spark):
    r = spark.range(1).select(
        T.normal_name(F.lit("The Foo-Bar Co., Inc. /DE/")).alias("n"), T.names_agree(F.lit("Alpha Groups"), F.lit("alpha group inc")).alias("g"), T.items(F.lit("Item 2.02; item 1.01, Item 2.02")).alias("i"),
        T.seen_date(F.lit("20240102T030405Z")).alias("s"), T.seen_date(F.lit("x")).alias("b"), T.strip_markup(F.lit("<p>a &amp; b<script>x</script></p>")).alias("m"),
    ).first()
    assert r.n == "FOO BAR" and r.g and r.i == ["1.01", "2.02"] and r.s == "2024-01-02T03:04:05Z" and r.b == "" and r.m == "a & b"


def test_factor_regression_matches_a_direct_computation(spark):
    import numpy as np

    from chronopanel.operators.regression import factor_regression

    r = np.random.default_rng(3)
    n = 90
    x1, x2 = r.normal(0, 1, n), r.normal(0, 2, n)
    u = np.convolve(r.normal(0, 1, n + 2), [1, 0.6, 0.3], "valid")
    y = 0.4 + 1.5 * x1 - 0.7 * x2 + u
    rows = [("a", i, float(y[i]), float(x1[i]), float(x2[i])) for i in range(n)] + [("a", n, None, 1.0, 1.0), ("b", 0, 1.0, 2.0, 3.0), ("b", 1, 1.0, 2.0, 3.0)]
    out = factor_regression(spark.createDataFrame(rows, "k string, t int, y double, x1 double, x2 double"), ["k"], "t", "y", ["x1", "x2"]).collect()
    assert {x.k for x in out} == {"a"}  # b has no spread
    out = [{x.coef: x for x in out}[c] for c in ("alpha", "x1", "x2")]
    z = np.c_[np.ones(n), x1, x2]
    inverse = np.linalg.inv(z.T @ z)
    beta = inverse @ z.T @ y
    e, lag = (y - z @ beta)[:, None] * z, 3
    s = e.T @ e + sum((1 - k / (lag + 1)) * (e[k:].T @ e[:-k] + e[:-k].T @ e[k:]) for k in range(1, lag + 1))
    se = np.sqrt(np.diag(inverse @ s @ inverse))
    assert out[0].lag == lag and np.allclose([x.value for x in out], beta) and np.allclose([x.se for x in out], se)
    assert abs(out[0].r2 - (1 - (y - z @ beta).var() / y.var())) < 1e-9


def test_rolling_beta_equals_covariance_over_variance(spark):
    import numpy as np

    r = np.random.default_rng(4)
    rows = [("a", day(i), None if i % 7 == 3 else float(r.normal(0, 0.02)), float(r.normal(0, 0.01))) for i in range(60)]
    out = rolling.with_beta(spark.createDataFrame(rows, "ticker string, date date, ret double, mkt double"), "b", 20, 10).orderBy("date").collect()
    for i, x in enumerate(out):
        held = [(a, b) for _, _, a, b in rows[max(0, i - 19) : i + 1] if a is not None]
        if len(held) < 10:
            assert x.b is None
        else:
            a, b = np.array(held).T
            assert abs(x.b - np.cov(a, b)[0, 1] / b.var(ddof=1)) < 1e-9


def test_normal_quantile_inverts_the_distribution(spark):
    from statistics import NormalDist

    ps = [1e-9, 0.001, 0.02, 0.3, 0.5, 0.77, 0.99, 1 - 1e-6]
    rows = spark.createDataFrame([(p,) for p in [*ps, 0.0, 1.0]], "p double").selectExpr("p", f"{inference.normal_quantile('p')} as z").collect()
    assert all(abs(x.z - NormalDist().inv_cdf(x.p)) < 1e-6 if 0 < x.p < 1 else x.z is None for x in rows)


def test_half_splits_rank_the_best_inside_outside(spark):
    import itertools

    r, blocks = [[0.3, 0.1, -0.2, 0.4], [0.2, 0.2, 0.1, 0.0], [-0.1, 0.5, 0.3, -0.4]], 4
    rows = [(f"k{i}", b, v) for i, vs in enumerate(r) for b, v in enumerate(vs)]
    out = {x["mask"]: (x.ticker, x.place, x.low, x.s) for x in inference.half_splits(spark.createDataFrame(rows, "ticker string, b int, ret double"), "b", blocks).collect()}
    assert len(out) == 6
    for inside in itertools.combinations(range(blocks), 2):
        ins = [sum(vs[b] for b in inside) for vs in r]
        oos = [sum(v for b, v in enumerate(vs) if b not in inside) for vs in r]
        best = ins.index(max(ins))
        assert out[sum(1 << b for b in inside)] == (f"k{best}", 1 + sum(o > oos[best] + 1e-12 for o in oos), 1 + sum(o < oos[best] - 1e-12 for o in oos), 3)


def test_components_match_a_union_find(spark):
    import random

    from chronopanel.operators.graph import connected_components

    r = random.Random(5)
    edges = [(f"n{r.randrange(120)}", f"n{r.randrange(120)}") for _ in range(70)] + [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(50)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        lo, hi = sorted((find(a), find(b)))
        root[hi] = lo
    got = {x.node: x.root for x in connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {x: find(x) for x in root}


def test_rules_negation_precedence_conflict_and_abstention(spark):
    rules = [(1, "a", "apache", False), (1, "g", "general public", False), (2, "o", "license", False), (3, "v", "void", True)]
    texts = ["Apache License", "not under the Apache license", "no one two three four apache", "apache, general public", "void apache", "nothing", None, "without any license"]
    got = [x.c for x in spark.createDataFrame([*enumerate(texts)], "i int, t string").orderBy("i").select(T.classified(F.coalesce("t", F.lit("")), rules).alias("c")).collect()]
    assert got == ["a", "o", "a", "conflict", "abstain", "abstain", "abstain", "abstain"]


def test_ages_are_stripped_only_on_evidence(spark):
    rows = [("Jane Doe 63", "63", "x"), ("John Roe 41", None, "x"), ("John Roe", None, "y"), ("Max Mo 55", None, "x"), ("Ann Po 12", "13", "z")]
    got = {x.name: (x.n, x.roles, x.n_stripped) for x in T.merged_persons(spark.createDataFrame(rows, "raw string, age string, role string")).collect()}
    assert got == {"jane doe": (1, "x", 1), "john roe": (2, "x,y", 1), "max mo 55": (1, "x", 0), "ann po 12": (1, "z", 0)}


def test_keyless_asof_maps_times_once(spark):
    left = spark.createDataFrame([(1, day(3)), (2, day(3)), (3, day(0)), (4, None)], "i int, t date")
    right = spark.createDataFrame([(day(1), "x", 1), (day(1), "y", 2), (day(3), "z", 0)], "at date, v string, o int")
    got = {x.i: (x.at, x.v) for x in asof_join(left, right, "t", "at", strict=True, ties=("o",)).collect()}
    assert got == {1: (day(1), "y"), 2: (day(1), "y"), 3: (None, None), 4: (None, None)}
    assert {x.i for x in asof_join(left, right, "t", "at", how="semi").collect()} == {1, 2}


def test_bootstrap_means_match_plain_python(spark):
    import hashlib

    xs = [0.5, -1.0, 2.0, 0.25, 3.0, -0.75, 1.5, 0.0]
    rows = spark.createDataFrame([("s", i, x) for i, x in enumerate(xs)], "k string, t int, x double")
    got = {x.replicate: x["mean"] for x in inference.bootstrap_means(rows, ["k"], "t", "x", n_boot=20, block=3).collect()}
    for rep in range(20):
        drawn = []
        for b in range(3):
            start = int(hashlib.md5(f"7|s|{rep}|{b}".encode()).hexdigest()[:8], 16) % 6
            drawn += [xs[min(start + o, 7)] for o in range(3) if b * 3 + o < 8]
        assert abs(got[rep] - sum(drawn) / 8) < 1e-12


def test_shared_folder_must_be_named_on_a_cluster():
    import pytest

    from chronopanel.shared import shared_dir

    class Context:
        master = "spark://somewhere:7077"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda *_: None)

    with pytest.raises(ValueError):
        shared_dir(Session())


def test_released_tables_are_gone_and_others_stay(spark):
    import os

    from chronopanel import shared

    kept = shared.stored(spark.range(3), "kept")
    at = shared.mark()
    for n in range(2):
        shared.stored(spark.range(n), "step")
    last = shared.stored(spark.range(5), "last")
    gone = [p.removeprefix("file://") for p in shared._WRITTEN[at:-1]]
    assert all(map(os.path.exists, gone))
    assert shared.release(spark, at, 1) == 2 and not any(map(os.path.exists, gone))
    assert (kept.count(), last.count()) == (3, 5) and shared.release(spark, at) == 1


def test_rolling_spillover_finds_what_the_process_spills(spark):
    import numpy as np

    r = np.random.default_rng(7)
    a, cov = np.array([[0.3, 0.25], [0.0, 0.4]]), np.array([[1.0, 0.3], [0.3, 1.0]])
    noise = r.multivariate_normal([0, 0], cov, 6000)
    v = np.zeros((6000, 2))
    for t in range(1, 6000):
        v[t] = a @ v[t - 1] + noise[t]
    power, num, den = np.eye(2), np.zeros((2, 2)), np.zeros(2)
    for _ in range(10):
        num, den, power = num + (power @ cov) ** 2, den + np.diag(power @ cov @ power.T), a @ power
    share = num / den[:, None]
    share /= share.sum(axis=1, keepdims=True)
    assert abs(inference.spillover_index(v) - 50 * (share[0, 1] + share[1, 0])) < 1.5
    rows = [("p", "q", i, float(x), float(y)) for i, (x, y) in enumerate(v[:200])]
    got = {x.i: x["index"] for x in inference.rolling_spillover(spark.createDataFrame(rows, "x string, y string, i long, rx double, ry double"), 60, 7, 10, 4).collect()}
    assert got == {i: round(inference.spillover_index(v[i - 59 : i + 1]), 6) for i in range(63, 200, 7)}
    assert inference.spillover_index(v[:20]) is None
