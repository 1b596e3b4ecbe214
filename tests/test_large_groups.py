"""Operators that must not gather a large group: exact quantiles, projections, boosted trees, regressions."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from chronopanel.operators import joins as J
from chronopanel.operators import monitor as M
from chronopanel.operators import quantiles as Q


def test_quantiles_equal_a_sort(spark, monkeypatch):
    monkeypatch.setattr(Q, "FEW", 5)
    monkeypatch.setattr(Q, "PARTS", 128)
    r = random.Random(1)
    groups = {
        "normal": [r.gauss(0, 1) for _ in range(700)], "tied": [r.choice([1.0, 2.0, 2.5]) for _ in range(300)], "one": [7.0], "same": [3.0] * 40, "two": [1.0, 4.0],
        "tail": [r.choice([-1, 1]) * 10 ** r.uniform(-9, 9) for _ in range(200)], "wide": [-1.7e308, 1.7e308, 0.0, 5.0, 5.0, 6.0], None: [float(i) for i in range(101)],
    }
    rows = [(k, x) for k, xs in groups.items() for x in xs] + [("one", None), ("one", float("nan")), ("none", None)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, x double").repartition(3)
    ps = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]
    got = {x.k: x for x in Q.exact_quantiles(df, "x", ps, ["k"]).collect()}
    assert set(got) == set(groups)
    for k, xs in groups.items():
        xs = sorted(xs)
        for p, q in zip(ps, got[k].quantiles, strict=True):
            at = (len(xs) - 1) * p
            lo, hi = xs[int(at)], xs[min(int(at) + 1, len(xs) - 1)]
            assert q == xs[round(at)] if abs(at - round(at)) < 1e-9 else np.isclose(q, lo * (1 - at % 1) + hi * (at % 1), rtol=1e-12)
        assert got[k].n == len(xs)
    whole = Q.exact_quantiles(df.where("k = 'normal'"), "x", [0.5]).collect()
    assert np.isclose(whole[0].quantiles[0], np.median(groups["normal"]))
    ends = spark.createDataFrame([(x,) for x in (float("-inf"), float("-inf"), 1.0, 2.0, float("inf"))], "x double")
    assert Q.exact_quantiles(ends, "x", [0.0, 0.25, 0.5, 0.75, 1.0]).first().quantiles == [float("-inf"), float("-inf"), 1.0, 2.0, float("inf")]
    assert Q.exact_quantiles(df.limit(0), "x", [0.5]).collect() == [] and Q.exact_quantiles(df.limit(0), "x", [0.5], ["k"]).collect() == []


def test_quantile_tasks_hold_counts_not_values(spark):
    df = spark.range(200_000).select((F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 7).alias("x"))
    want = np.quantile(np.array([r.x for r in df.collect()]), [0.1, 0.9])
    assert np.allclose(Q.exact_quantiles(df, "x", [0.1, 0.9]).first().quantiles, want, rtol=0, atol=1e-9)
    edges = M.inner_edges(df, "x", 10).first().edges
    assert len(edges) == 9 and edges == sorted(edges)


def test_projection_of_an_item_that_everybody_holds(spark):
    r = random.Random(2)
    pairs = [("q1", m, "all") for m in range(60)] + [("q1", r.randrange(60), f"i{r.randrange(9)}") for _ in range(150)] + [("q2", r.randrange(9), f"i{r.randrange(5)}") for _ in range(60)]
    pairs += pairs[:5] + [("q1", None, "all"), (None, 1, "all"), ("q1", 3, None)]
    held = defaultdict(set)
    for q, m, i in pairs:
        if None not in (q, m, i):
            held[q, m].add(i)
    want = {}
    for (q, a), (p, b) in combinations(sorted(held), 2):
        both = sorted(held[q, a] & held[p, b])
        if q == p and both:
            want[q, a, b] = (len(both), both[:3], len(both) > 3)
    df = spark.createDataFrame(pairs, "q string, m int, i string")
    for block in (7, 1000):
        got = {(x.q, x.a, x.b): (x.w, list(x.shared), x.truncated) for x in J.shared_items(df, "m", "i", 3, ["q"], block).collect()}
        assert got == want
    assert Counter(x.w for x in J.shared_items(df.where("q = 'q1'"), "m", "i").collect()).total() == 60 * 59 // 2


def plain_booster(x, y, x_new, p, keys):
    """The same trees by recursion over rows in plain Python."""
    from fractions import Fraction

    from chronopanel.operators import boosting as B

    top = max(abs(v) for v in y)
    scale = 2.0 ** (np.ceil(np.log2(top)) - 24)
    edges = []
    for j in range(x.shape[1]):
        known = x[~np.isnan(x[:, j]), j]
        edges.append(np.unique(np.quantile(known, [i / p.bins for i in range(1, p.bins)])))
    cell = lambda m: np.array([[0 if np.isnan(v) else 1 + int((edges[j] < v).sum()) for j, v in enumerate(row)] for row in m])
    b, b_new = cell(x), cell(x_new)
    base = np.rint(np.mean(y) / scale) * scale
    total, total_new = np.full(len(y), base), np.full(len(x_new), base)

    def grow(rows, rows_new, g, allowed, depth):
        best = (1e-12, None)
        own = sum(g[i] for i in rows)
        part = lambda s, n: (s * scale) ** 2 / (n + p.reg_lambda)
        if depth:
            for f in allowed:
                for cut in range(p.bins):
                    left = [i for i in rows if b[i, f] <= cut]
                    if min(len(left), len(rows) - len(left)) >= p.min_child:
                        s = sum(g[i] for i in left)
                        gain = part(s, len(left)) + part(own - s, len(rows) - len(left)) - part(own, len(rows))
                        if gain > best[0]:
                            best = (gain, (f, cut))
        if best[1] is None:
            v = p.learning_rate * (own * scale) / (len(rows) + p.reg_lambda)
            for i in rows_new[0]:
                total[i] += v
            for i in rows_new[1]:
                total_new[i] += v
            return
        f, cut = best[1]
        side = lambda left: ([i for i in rows if (b[i, f] <= cut) == left], ([i for i in rows_new[0] if (b[i, f] <= cut) == left], [i for i in rows_new[1] if (b_new[i, f] <= cut) == left]))
        for left in (True, False):
            grow(*side(left), g, allowed, depth - 1)

    for t in range(p.trees):
        g = [int(np.rint((v - s) / scale)) for v, s in zip(y, total, strict=True)]
        bag = B.in_bag(p, t, keys) if p.bagging_fraction < 1 else np.ones(len(y), bool)
        assert Fraction(sum(g)) == sum(map(Fraction, g))
        grow([i for i in range(len(y)) if bag[i]], (list(range(len(y))), list(range(len(x_new)))), g, B.chosen_features(p, t, x.shape[1]), p.depth)
    return total_new


def test_boosted_trees_match_a_plain_booster(spark):
    from chronopanel.operators import boosting as B

    rng = np.random.default_rng(3)
    n = 260
    x = rng.normal(size=(n, 4))
    x[rng.random((n, 4)) < 0.1] = np.nan
    x[:, 3] = np.round(x[:, 3])
    y = np.where(np.nan_to_num(x[:, 0]) > 0.3, 2.0, -1.0) + np.nan_to_num(x[:, 1]) * 0.5 + rng.normal(size=n) * 0.1
    fold, test = rng.integers(0, 2, n), rng.random(n) < 0.25
    rows = [(i, f"f{fold[i]}", "test" if test[i] else "train", *[None if np.isnan(v) else float(v) for v in x[i]], float(y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, fold string, role string, a double, b double, c double, d double, y double").repartition(3)
    p = B.BoostingParams(trees=6, depth=3, learning_rate=0.3, bins=16, min_child=5, stage=2)
    hashes = {r.id: r.h for r in df.select("id", F.xxhash64("id").alias("h")).collect()}
    got = {r.id: r.score for r in B.boosted_scores(df, list("abcd"), "y", ["id"], p).collect()}
    assert set(got) == {i for i in range(n) if test[i]}
    for k in (0, 1):
        tr, te = np.flatnonzero((fold == k) & ~test), np.flatnonzero((fold == k) & test)
        want = plain_booster(x[tr], y[tr], x[te], p, np.array([hashes[int(i)] for i in tr]))
        assert np.allclose([got[int(i)] for i in te], want, rtol=0, atol=1e-12)
    again = {r.id: r.score for r in B.boosted_scores(df.repartition(7), list("abcd"), "y", ["id"], p).collect()}
    assert again == got  # to the bit
    held = np.array([i for i in range(n) if test[i]])
    assert np.mean((y[held] - np.array([got[int(i)] for i in held])) ** 2) < 0.4 * np.var(y[held])


def test_student_t_equals_published_values(spark):
    from chronopanel.functions.special import incomplete_beta, log_gamma, student_p

    # Two-sided 5 % and 1 % points of Student's t, and one-sided ones of other sizes.
    table = [(12.706, 1, 0.05), (4.303, 2, 0.05), (2.571, 5, 0.05), (2.228, 10, 0.05), (2.042, 30, 0.05), (1.980, 120, 0.05), (63.657, 1, 0.01), (3.169, 10, 0.01), (2.617, 120, 0.01), (1.9623, 1000, 0.05), (1.9602, 10000, 0.05)]
    df = spark.createDataFrame(table, "t double, n int, p double").repartition(2)
    for x in df.select("p", student_p(F.col("t"), F.col("n")).alias("got"), student_p(-F.col("t"), F.col("n")).alias("other")).collect():
        assert abs(x.got - x.p) < 4e-5 * (1 if x.p > 0.01 else 0.5) and x.got == x.other
    one = spark.range(1).select(student_p(F.lit(0.0), F.lit(7)).alias("a"), student_p(F.lit(1.0), F.lit(1)).alias("b"), student_p(F.lit(None).cast("double"), F.lit(3)).alias("c"), student_p(F.lit(1.0), F.lit(0)).alias("d"), student_p(F.lit(60.0), F.lit(40)).alias("e"), log_gamma(F.lit(0.5)).alias("g"), incomplete_beta(F.lit(2.0), F.lit(3.0), F.lit(0.4)).alias("h")).first()
    assert (one.a, one.c, one.d) == (1.0, None, None) and abs(one.b - 0.5) < 1e-14 and 0 < one.e < 1e-38
    assert abs(one.g - np.log(np.pi) / 2) < 1e-14 and abs(one.h - 0.5248) < 1e-14


def newey_west(x, y, lag):
    z = np.c_[np.ones(len(y)), x]
    inv = np.linalg.inv(z.T @ z)
    b = inv @ z.T @ y
    u = z * (y - z @ b)[:, None]
    meat = u.T @ u
    for k in range(1, lag + 1):
        g = u[k:].T @ u[:-k]
        meat += (1 - k / (lag + 1)) * (g + g.T)
    return b, np.sqrt(np.diag(inv @ meat @ inv))


def test_regressions_on_five_factors_match_the_sandwich(spark):
    from chronopanel.operators.regression import factor_regression

    rng = np.random.default_rng(4)
    rows, want = [], {}
    for s, n in (("a", 140), ("b", 60), ("c", 6), ("flat", 40)):
        x = rng.normal(size=(n, 5)) + 3
        if s == "flat":
            x[:, 4] = x[:, 3] * 2
        y = 0.2 + x @ [0.5, -1, 0, 2, 0.1] + rng.normal(size=n).cumsum() * 0.1
        rows += [(s, i, float(y[i]), *map(float, x[i])) for i in range(n)]
        if s in "ab":
            want[s] = (*newey_west(x, y, max(1, int(4 * (n / 100) ** (2 / 9)))), 1 - np.var(y - np.c_[np.ones(n), x] @ np.linalg.lstsq(np.c_[np.ones(n), x], y, rcond=None)[0]) / np.var(y))
    rows += [("a", 1000, None, 1.0, 1.0, 1.0, 1.0, 1.0), ("a", 1001, 1.0, 1.0, float("nan"), 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "s string, i int, y double, " + ", ".join(f"x{j} double" for j in range(5))).repartition(3)
    got = {(r.s, r.coef): r for r in factor_regression(df, ["s"], "i", "y", [f"x{j}" for j in range(5)]).collect()}
    assert {k[0] for k in got} == {"a", "b"}
    for s in "ab":
        b, se, r2 = want[s]
        for j, name in enumerate(["alpha", *[f"x{j}" for j in range(5)]]):
            r = got[s, name]
            assert np.allclose([r.value, r.se, r.t, r.r2], [b[j], se[j], b[j] / se[j], r2], rtol=1e-8)


def test_rolling_exposures_match_least_squares(spark):
    from chronopanel.operators.regression import rolling_exposures

    rng = np.random.default_rng(5)
    rows = []
    for t in "uv":
        x = rng.normal(size=(90, 4)) * [1, 0.01, 5, 1] + [0, 1, -2, 0]
        y = x @ [1, 50, 0.2, -1] + rng.normal(size=90) * 0.1
        rows += [(t, i, None if rng.random() < 0.1 else float(y[i]), *map(float, x[i])) for i in range(90)]
    df = spark.createDataFrame(rows, "ticker string, date int, y double, a double, b double, c double, d double").repartition(3)
    ends = spark.createDataFrame([(i,) for i in range(4, 90, 5)], "date int")
    got = {(r.ticker, r.date): r for r in rolling_exposures(df, "y", list("abcd"), 30, 20, ends).collect()}
    assert len(got) == 2 * 18
    for (t, end), r in got.items():
        part = np.array([x[2:] for x in rows if x[0] == t and end - 30 < x[1] <= end and x[2] is not None], float)
        assert r.n == len(part)
        if len(part) < 20:
            assert r.b is None
        else:
            assert np.allclose(r.b, np.linalg.lstsq(np.c_[np.ones(len(part)), part[:, 1:]], part[:, 0], rcond=None)[0][1:], rtol=1e-6, atol=1e-6)


def test_lagged_surprises_match_a_loop(spark):
    from chronopanel.operators.regression import lagged_surprises

    rng = np.random.default_rng(6)
    window, lags = 12, 3
    series = {k: np.cumsum(rng.normal(size=n)) + 100 for k, n in (("a", 130), ("b", 40), ("c", 10))}
    series["a"][50] = np.nan
    df = spark.createDataFrame([(k, i, None if np.isnan(x) else float(x)) for k, v in series.items() for i, x in enumerate(v)], "k string, i int, x double").repartition(3)
    for ends in (17, 2048):
        got = {(r.k, r.i): r for r in lagged_surprises(df, "k", "i", "x", window, lags, 5.0, ends).collect()}
        assert len(got) == 180
        for k, v in series.items():
            e = np.full(len(v), np.nan)
            for t in range(window + lags, len(v)):
                z = np.array([[1, *v[i - lags : i][::-1]] for i in range(t - window, t)])
                y = v[t - window : t]
                if np.isfinite(z).all() and np.isfinite(y).all() and np.isfinite(v[t - lags : t + 1]).all():
                    e[t] = v[t] - np.r_[1, v[t - lags : t][::-1]] @ np.linalg.lstsq(z, y, rcond=None)[0]
            for t in range(len(v)):
                before = [x for x in e[max(0, t - window) : t] if np.isfinite(x)]
                want = np.clip(e[t] / np.std(before, ddof=1), -5, 5) if len(before) >= max(lags + 2, window // 2) and np.isfinite(e[t]) else None
                assert (got[k, t].residual is None) == bool(np.isnan(e[t])) and (got[k, t].surprise is None) == (want is None)
                if np.isfinite(e[t]):
                    assert abs(got[k, t].residual - e[t]) < 1e-6
                if want is not None:
                    assert abs(got[k, t].surprise - want) < 1e-5


def test_half_splits_in_groups_match_a_loop(spark):
    from chronopanel.operators.inference import half_splits

    rng = np.random.default_rng(7)
    rows = [(f"k{k:02}", b, float(rng.normal())) for k in range(23) for b in range(6) for _ in range(rng.integers(0, 3))]
    want = {}
    for m in (m for m in range(64) if m.bit_count() == 3):
        means = {}
        for k in sorted({r[0] for r in rows}):
            ins, oos = ([x for kk, b, x in rows if kk == k and (m >> b & 1) == side] for side in (1, 0))
            if ins and oos:
                means[k] = (sum(ins) / len(ins), sum(oos) / len(oos))
        best = max(means, key=lambda k: (round(means[k][0], 9), [-ord(c) for c in k]))
        want[m] = (best, 1 + sum(o > means[best][1] + 1e-9 for _, o in means.values()), 1 + sum(o < means[best][1] - 1e-9 for _, o in means.values()), len(means))
    df = spark.createDataFrame(rows, "ticker string, b int, ret double")
    got = {r.mask: (r.ticker, r.place, r.low, r.s) for r in half_splits(df, "b", 6, keys=5, masks=7).collect()}
    assert got == want


def test_components_equal_numpy(spark):
    from chronopanel.operators import components as C
    from chronopanel.plans import QUERIES

    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = e.select("vec_id", "embedding").collect()
    x = np.array([r.embedding for r in rows], float)
    c = C.fit_components(e.repartition(5), "embedding", 8)
    _, s, axes = np.linalg.svd(x - x.mean(0), full_matrices=False)
    axes = axes[:8] * np.where(axes[np.arange(8), np.abs(axes[:8]).argmax(1)] < 0, -1, 1)[:, None]
    assert np.allclose(c.axes, axes, atol=1e-8) and np.allclose(c.variance, s[:8] ** 2 / (len(x) - 1)) and np.allclose(c.share, s[:8] ** 2 / (s**2).sum())
    want = {r.vec_id: v for r, v in zip(rows, (x - x.mean(0)) @ axes.T, strict=True)}
    got = QUERIES["k21_embedding_components"](spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(want) and all(np.allclose([r[f"emb_{i}"] for i in range(8)], want[r.vec_id], atol=2e-5) for r in got)


def test_components_of_odd_vectors(spark):
    import pytest

    from chronopanel.operators import components as C

    good = [([float(i), 2.0 * i, 1.0],) for i in range(6)]
    df = spark.createDataFrame([*good, (None,), ([1.0, None, 2.0],), ([1.0, float("nan"), 2.0],)], "v array<double>")
    c = C.fit_components(df, "v", 2)
    assert c.n == 6 and np.allclose(c.axes[0], np.array([1, 2, 0]) / 5**0.5) and abs(c.variance[1]) < 1e-12
    assert [x.p is None for x in df.select(C.projected("v", c).alias("p")).collect()][:7] == [False] * 6 + [True]
    for rows in ([([1.0, 2.0],), ([1.0],), ([2.0, 3.0],)], good[:2], []):
        with pytest.raises(ValueError):
            C.fit_components(spark.createDataFrame(rows, "v array<double>"), "v", 2)


def test_whole_table_permutations_keep_values_and_gaps(spark):
    from chronopanel.operators import splits as S

    df = spark.createDataFrame([(i, None if i % 7 == 0 else float(i)) for i in range(300)], "k int, v double").repartition(5)
    got = {r.k: r.v for r in S.known_permuted(df, "v", [], ["k"], 3).collect()}
    assert {k for k, v in got.items() if v is None} == set(range(0, 300, 7)) and sorted(v for v in got.values() if v is not None) == [float(i) for i in range(300) if i % 7]
    assert sum(v == k for k, v in got.items()) < 15 and got == {r.k: r.v for r in S.known_permuted(df.repartition(2), "v", [], ["k"], 3).collect()}


def test_sample_rejects_conflicts_and_reports(spark):
    from datetime import datetime

    from chronopanel.operators.sampling import stratified_sample

    h = lambda c: c * 64
    day = datetime(2024, 1, 1)
    rows = [
        ("a", "t", "s", day, h("1")), ("a", "t", "s", day, h("1")), ("b", "t", "s", day, h("2")), ("b", "t", "s", day, h("3")), ("c", "t", "s", day, h("3")), ("d", "t", "s", day, h("4")), ("e", "t", "s", day, h("4")),
        ("f", "t", "s", None, h("5")), ("g", "t", "s", datetime(2030, 1, 1), h("6")), ("i", "t", "s", day, "XYZ"), ("j", "u", "s", day, h("7")), ("k", "t", "s", day, h("8")), ("l", "t", "s", day, None),
    ]
    records = spark.createDataFrame(rows, "event_id string, event_type string, sector string, filed timestamp, h string")
    quotas = spark.createDataFrame([("t", 2024, "s", 1), ("v", 2024, "s", 2)], "event_type string, year int, sector string, quota int")
    sample, report = stratified_sample(records, quotas, F.lit("2025-01-01").cast("timestamp"))
    import hashlib

    first = min(("a", h("1")), ("k", h("8")), key=lambda x: hashlib.sha256(f"0|{x[0]}|{x[1]}".encode()).hexdigest())
    assert [(r.event_id, r.h, r.k) for r in sample.collect()] == [(*first, 1)]
    assert {(r.kind, r.event_type, r.requested, r.found) for r in report.collect()} == {
        ("shortfall", "v", 2, 0), ("unrequested", "u", 0, 1), ("missing_filed", None, None, 1), ("future_filed", None, None, 1), ("illegal_hash", None, None, 2), ("event_hash_conflict", None, None, 1), ("conflicting_hash", None, None, 3),
    }
    empty, none = stratified_sample(records.limit(0), quotas.limit(0), F.lit("2025-01-01").cast("timestamp"))
    assert empty.collect() == [] and none.collect() == []


def test_offer_prices_with_commas_and_negation_windows(spark):
    from chronopanel.functions import text as T

    df = spark.createDataFrame([("at a price of $1,250.00 per share",), ("about $12,345,678.5 in all",), ("a price of $17 per share",)], "t string")
    price, kind = T.offer_price(F.col("t"))
    assert [tuple(r) for r in df.select(price, kind).collect()] == [(1250.0, "exact"), (12345678.5, "low"), (17.0, "exact")]
    texts = [("mit is fine", True, True), ("it is not under mit", False, False), ("mit? certainly not", True, False), ("not one two three mit", True, True), ("mit a b not", True, True), ("Mit never", True, False)]
    df = spark.createDataFrame([t[:1] for t in texts], "t string")
    got = df.select(T.rule_hit(F.col("t"), "mit", 3, 0), T.rule_hit(F.col("t"), "mit", 3, 2)).collect()
    assert [tuple(r) for r in got] == [t[1:] for t in texts]
    tags = spark.createDataFrame([("Buy $a, $gme and TSLA; not $toolong or A or tsla or ÉTÉ $X_Y",)], "t string").select(T.cashtags(F.col("t"))).first()[0]
    assert tags == ["A", "GME", "TSLA"]
