"""What queries write, exchange and hold while they run."""

from __future__ import annotations

import hashlib
import random
from pathlib import Path

from chronopanel.operators import inference, splits
from chronopanel.plans import QUERIES

DATA = Path("/root/testdata/sf0.001")


def test_ownership_documents_are_written_small(spark):
    at = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(at.glob("insider-*")) if at.exists() else set()
    rows = QUERIES["a08_insider_xml"](spark, str(DATA)).collect()
    (made,) = set(at.glob("insider-*")) - before
    parts = list(made.glob("part-*"))
    assert len(rows) == 10 and parts and all(p.name.endswith(".gz") for p in parts)
    assert sum(p.stat().st_size for p in parts) < 4 * (DATA / "lineitem.parquet").stat().st_size


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_resamples_of_strata_are_never_broadcast(spark):
    r = random.Random(3)
    rows = [(k, r.choice("aab"), r.random() < 0.5, r.random() < 0.6) for k in range(400)]
    out = inference.stratified_f1(spark.createDataFrame(rows, "k int, s string, g boolean, p boolean"), "s", "g", "p", "k", n_boot=30, seed=13)
    got = {x.stratum: x for x in out.collect()}
    assert "SortMergeJoin" in plan(out) and "BroadcastExchange" not in plan(out)
    means = []
    for rep in range(30):
        f1 = []
        for s in "ab":
            cells = [g and p for k, t, g, p in rows if t == s and (g or p)]
            n = len(cells)
            tp = sum(cells[int(hashlib.md5(f"13|{s}|{rep}|{j}".encode()).hexdigest()[:8], 16) % n] for j in range(n))
            f1.append(2 * tp / (n + tp))
        means.append(sum(f1) / 2)
    assert abs(got["macro"]["mean"] - sum(means) / 30) < 1e-6 and got["a"].n + got["b"].n == sum(g or p for _, _, g, p in rows)
    low = sorted(means)[0] + 0.725 * (sorted(means)[1] - sorted(means)[0])
    assert abs(got["macro"].low - low) < 1e-6


def test_event_study_makes_a_path_once_for_all_events_of_a_day(spark):
    r = random.Random(4)
    ab = {(t, i): r.gauss(0, 1) for t in "AB" for i in range(40) if r.random() < 0.93}
    events = [(f"e{k}", r.choice("xyz"), r.choice(["A", "B", "C", None]), r.randrange(40)) for k in range(500)]
    rows = spark.createDataFrame([(t, i, x) for (t, i), x in ab.items()] + [("A", 41, None)], "ticker string, date int, ab double")
    sessions = spark.createDataFrame([(i, i + 1) for i in range(42)], "date int, idx int")
    out = inference.event_study(rows, spark.createDataFrame(events, "event_id string, event_type string, ticker string, date int"), sessions, 2, 3)
    got = {(x.event_type, x.offset): x for x in out.collect()}
    assert "Generate explode(" not in plan(out)  # no row per event and offset
    want = {}
    for _, kind, t, i in events:
        path = [ab.get((t, i + k)) for k in range(-2, 4)]
        if None not in path:
            for k in range(6):
                want.setdefault((kind, k - 2), []).append(sum(path[: k + 1]))
    assert set(got) == set(want) and len(want) == 18
    for key, cars in want.items():
        n, mean = len(cars), sum(cars) / len(cars)
        se = (sum((x - mean) ** 2 for x in cars) / (n - 1) / n) ** 0.5
        assert got[key].n == n and abs(got[key]["mean"] - mean) < 1e-9 and abs(got[key].se - se) < 1e-9 and abs(got[key].high - mean - 1.96 * se) < 1e-9


def test_bootstrap_exchanges_rows_and_no_draws(spark):
    from pyspark.sql import functions as F

    r = random.Random(6)
    series = {k: [r.choice([None, r.gauss(0, 1)]) if r.random() < 0.2 else r.gauss(0, 1) for _ in range(n)] for k, n in (("a", 1), ("b", 4), ("c", 6), ("d", 23), ("e", 0))}
    rows = [(k, i, x, f"note {k}") for k, xs in series.items() for i, x in enumerate(xs)] + [(None, 0, 1.0, "nobody"), ("f", 0, None, "nothing")]
    r.shuffle(rows)
    means = inference.bootstrap_means(spark.createDataFrame(rows, "k string, t int, x double, note string"), ["k"], "t", "x", n_boot=9, carry=["note"])
    by_series = means.groupBy("k").agg(F.avg("mean"))
    assert plan(by_series).count("Exchange hashpartitioning") == 1 and "Join" not in plan(by_series)
    want = {}
    for k, xs in series.items():
        xs = [x for x in xs if x is not None]
        for rep in range(9 if xs else 0):
            drawn = []
            for b in range(-(-len(xs) // 6)):
                start = int(hashlib.md5(f"7|{k}|{rep}|{b}".encode()).hexdigest()[:8], 16) % max(len(xs) - 5, 1)
                drawn += [xs[min(start + o, len(xs) - 1)] for o in range(6) if b * 6 + o < len(xs)]
            want[k, rep] = sum(drawn) / len(xs)
    got = {(x.k, x.replicate): (x["mean"], x.note) for x in means.collect()}
    assert set(got) == set(want) and all(abs(got[k][0] - want[k]) < 1e-12 and got[k][1] == f"note {k[0]}" for k in want)


def test_bootstrap_interval_groups_replicates_where_they_arise(spark):
    out = QUERIES["l05_bootstrap_interval"](spark, str(DATA))
    exchanges = [line for line in plan(out).splitlines() if "Exchange" in line]
    assert exchanges and not any("replicate" in line or "__i" in line for line in exchanges) and "Join" not in plan(out)
    assert len(exchanges) == 2  # prices by month and ticker, returns by ticker


def test_a_learner_sees_batches_of_its_fold(spark):
    rows = [(f, "test" if i % 5 == 0 else "train", float(i + f)) for f in (1, 2) for i in range(3000)] + [(3, "test", 1.0)]
    tagged = spark.createDataFrame(rows, "fold int, role string, y double").repartition(3)
    learn = lambda train: (train["y"].sum(), len(train), len(train))
    merge = lambda a, b: (a[0] + b[0], a[1] + b[1], max(a[2], b[2]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        out = splits.per_fold_parts(tagged, learn, merge, lambda m, test: test[["fold", "y"]].assign(score=m[0] / m[1], most=max(m[2], len(test))), "fold int, y double, score double, most int").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    means = {f: sum(y for g, role, y in rows if g == f and role == "train") / 2400 for f in (1, 2)}
    assert sorted((x.fold, x.y) for x in out) == sorted((f, y) for f, role, y in rows if role == "test" and f < 3)
    assert all(abs(x.score - means[x.fold]) < 1e-9 and x.most <= 100 for x in out)
    whole = [line for line in plan(QUERIES["j02_learner_callback"](spark, str(DATA))).splitlines() if "FlatMapGroupsInPandas" in line]
    assert whole and all("part" in line for line in whole)
