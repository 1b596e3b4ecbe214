"""Incremental collection over many days: what is kept stays bounded, and what arrives late or twice is judged right."""

from __future__ import annotations

import random
from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from chronopanel.sources import sinks
from chronopanel.streaming import feeds

START = datetime(2024, 1, 1)


def at(days: float) -> datetime:
    return START + timedelta(days=days)


def test_window_takes_every_row_once_however_late(spark, tmp_path):
    src, table, late, ck = (str(tmp_path / n) for n in ("src", "table", "late", "ck"))
    schema = "id long, ts timestamp, x string"
    r = random.Random(1)
    rows = [(i, None if i % 17 == 0 else at(i / 10), r.choice([None, "a", "b"])) for i in range(300)]
    for poll in range(6):  # every poll repeats rows of all polls before it, and some of its own
        part = rows[50 * poll : 50 * poll + 50] + r.sample(rows[: 50 * poll + 50], 20)
        spark.createDataFrame(part, schema).write.mode("append").parquet(src)
        feeds.collect_window(feeds.file_stream(spark, src, schema, 1), table, late, ck, "ts", "2024-01-03", "2024-01-20")
    inside = lambda t: t is not None and at(2) < t <= at(19)
    held, rest = (Counter((x.id, x.ts, x.x) for x in spark.read.schema(schema).parquet(p).collect()) for p in (table, late))
    assert held == Counter(x for x in rows if inside(x[1])) and rest == Counter(x for x in rows if not inside(x[1]))


def test_ledger_logs_a_key_once(spark, tmp_path):
    src, ledger, ck = (str(tmp_path / n) for n in ("src", "ledger", "ck"))
    for keys in ([("2024-01-01", "a"), ("2024-01-01", None)], [("2024-01-02", "a"), ("2024-01-01", "a"), ("2024-01-01", None)], [(None, "a"), (None, "a")], [(None, "a")]):
        spark.createDataFrame(keys, "day string, k string").select(F.col("day").cast("date").alias("day"), "k").write.mode("append").parquet(src)
        feeds.ingest_ledger(feeds.file_stream(spark, src, "day date, k string", 1), ledger, ck, ["day", "k"], "day")
    got = Counter((str(x.day), x.k) for x in spark.read.schema("day date, k string").parquet(ledger).collect())
    assert got == Counter([("2024-01-01", "a"), ("2024-01-01", None), ("2024-01-02", "a"), ("None", "a")])


def test_newest_versions_stay_bounded_over_many_days(spark, tmp_path):
    src, table, ck = (str(tmp_path / n) for n in ("src", "table", "ck"))
    schema, keep, every, r = "url string, ts timestamp, title string", 5, 3, random.Random(2)
    seen, sizes = [], []
    for day in range(24):
        rows = [(f"u{r.randrange(20 * day // 3, 20 * day // 3 + 30)}", at(day + r.random()), f"{day}") for _ in range(20)]
        seen += rows
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        if day % 4 == 3:
            feeds.merge_newest(feeds.file_stream(spark, src, schema, 4), table, ck, "url", "ts", "title", keep_days=keep, every=every)
            sizes.append(spark.read.option("recursiveFileLookup", "true").schema(schema).parquet(table).count())
    newest = {}
    for row in seen:
        newest[row[0]] = max(newest.get(row[0], row), row, key=lambda x: (x[1], x[2]))
    last = max(x[1] for x in seen)
    want = {x for x in newest.values() if (last.date() - x[1].date()).days < keep}
    assert {tuple(x) for x in feeds.read_newest(spark, table, schema, "url", "ts", "title", keep_days=keep).collect()} == want
    assert len(seen) == 480 and max(sizes) < 420
    assert len(sinks.children(spark, f"{table}/base", "upto=")) <= 2 and len(sinks.children(spark, f"{table}/part", "batch=")) <= 3 * every


def test_commits_and_reveals_in_three_batches(spark, tmp_path):
    src, table, ck = (str(tmp_path / n) for n in ("src", "table", "ck"))
    never = datetime(1970, 1, 1)
    e = lambda kind, key, target, arm, seal, value, when: (kind, key, never, at(target), arm, seal, value, at(when))
    polls = [
        [e("commit", "a", 10, "", "s1", None, 0), e("commit", "b", 5, "", "s2", None, 1), e("reveal", "a", 10, "x", None, 0.5, 2), e("reveal", "c", 9, "x", None, 0.1, 2), ("commit", None, never, at(9), "", "s", None, at(1))],
        [e("commit", "a", 10, "", "s9", None, 3), e("commit", "a", 10, "", "s1", None, 4), e("reveal", "b", 5, "x", None, 0.2, 6), e("reveal", "b", 6, "x", None, 0.2, 7), e("commit", "c", 9, "", "s3", None, 7)],
        [e("reveal", "a", 10, "x", None, 0.7, 11), e("reveal", "a", 10, "x", None, 0.9, 12), e("reveal", "a", 10, "y", None, 0.3, 10), e("reveal", "c", 9, "x", None, 0.4, 9), e("reveal", "b", 5, "x", None, 0.8, 13)],
        [e("commit", "z", 90, "", "s5", None, 60)], [e("commit", "z", 90, "", "s5", None, 61)], [e("reveal", "a", 10, "w", None, 0.3, 61), e("commit", "z2", 91, "", "s6", None, 62)],
    ]
    states = []
    for rows in polls:
        spark.createDataFrame(rows, feeds.EVENTS).coalesce(1).write.mode("append").parquet(src)
        verdicts = feeds.commit_reveal(feeds.file_stream(spark, src, feeds.EVENTS, 1), keep_days=20, late="2 days")
        q = verdicts.writeStream.outputMode("append").format("parquet").option("path", table).option("checkpointLocation", ck).trigger(availableNow=True).start()
        q.awaitTermination()
        states.append([p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]][-1])
    got = Counter((x.kind, x.config, x.arm, (x.arrived - START).days, x.verdict, x.scored) for x in spark.read.schema(feeds.VERDICTS).parquet(table).collect())
    assert got == Counter([
        ("commit", "a", "", 0, "sealed", None), ("commit", "b", "", 1, "sealed", None), ("reveal", "a", "x", 2, "early", None), ("reveal", "c", "x", 2, "no commit", None), ("commit", None, "", 1, "unnamed", None),
        ("commit", "a", "", 3, "changed", None), ("commit", "a", "", 4, "repeated", None), ("reveal", "b", "x", 6, "scored", 0.2), ("reveal", "b", "x", 7, "no commit", None), ("commit", "c", "", 7, "sealed", None),
        ("reveal", "a", "x", 11, "scored", 0.7), ("reveal", "a", "x", 12, "repeated", 0.7), ("reveal", "a", "y", 10, "scored", 0.3), ("reveal", "c", "x", 9, "scored", 0.4), ("reveal", "b", "x", 13, "repeated", 0.2),
        ("commit", "z", "", 60, "sealed", None), ("commit", "z", "", 61, "repeated", None), ("reveal", "a", "w", 61, "no commit", None), ("commit", "z2", "", 62, "sealed", None),
    ])
    assert states[2] == 3 and states[-1] <= 2  # a, b and c went 20 days after their targets


def test_many_predictions_are_judged_in_few_calls(spark, tmp_path):
    src, table, ck = (str(tmp_path / n) for n in ("src", "table", "ck"))
    r, never, held, want, states, seen = random.Random(5), datetime(1970, 1, 1), {}, Counter(), [], -1e9
    for poll in range(4):  # no event is late: each poll's are after all of the polls before it
        rows = []
        for i in range(900):
            n, when = r.randrange(250 * poll // 2, 250 * poll // 2 + 300), 8 * poll + 7 * i / 900
            kind = r.choice(["commit", "reveal"])
            arm, seal, value = ("", r.choice(["s1", None]), None) if kind == "commit" else (r.choice("xy"), None, r.choice([None, 0.5, i / 8]))
            rows.append((kind, f"c{n}", never, at(n % 9), arm, seal, value, at(when)))
        spark.createDataFrame(rows, feeds.EVENTS).repartition(3).write.mode("append").parquet(src)
        verdicts = feeds.commit_reveal(spark.readStream.schema(feeds.EVENTS).parquet(src), keep_days=6, late="1 day", buckets=7)
        q = verdicts.writeStream.outputMode("append").format("parquet").option("path", table).option("checkpointLocation", ck).trigger(availableNow=True).start()
        q.awaitTermination()
        states.append(max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]))
        held = {k: p for k, p in held.items() if p[1] + timedelta(days=6) > at(seen - 1)} if poll else {}
        for kind, key, _, target, arm, seal, value, when in rows:
            verdict, scored = "no commit", None
            if kind == "commit":
                verdict = "sealed" if key not in held else "repeated" if held[key][:2] == (seal, target) else "changed"
                held.setdefault(key, (seal, target, {}))
            elif key in held:
                verdict = "early" if when < target else "repeated" if arm in held[key][2] else "scored"
                if verdict != "early":
                    scored = held[key][2].setdefault(arm, value)
            want[kind, key, arm, when, verdict, scored] += 1
        seen = 8 * poll + 7 * 899 / 900
    got = Counter((x.kind, x.config, x.arm, x.arrived, x.verdict, x.scored) for x in spark.read.schema(feeds.VERDICTS).parquet(table).collect())
    assert got == want
    assert len({k[4] for k in want}) == 6 and max(states) <= 7
