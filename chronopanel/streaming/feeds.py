"""Incremental collection as Structured Streaming: file sources, AvailableNow triggers, foreachBatch merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.sinks import children, exists, remove, row_hashes


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_now(stream: DataFrame, on_batch, checkpoint: str) -> None:
    """Process all that is there, then stop. A restart with the same checkpoint resumes after the last finished batch."""
    q = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def _put(df: DataFrame, table: str, batch: int, *by: str) -> None:
    """A batch of rows in a folder of its own: a replayed batch overwrites itself, and no batch touches what others wrote."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(f"{table}/batch={batch}")


def append_batches(stream: DataFrame, table: str, checkpoint: str) -> None:
    """Append every row that arrives, batch by batch."""
    run_now(stream, lambda df, i: _put(df, table, i), checkpoint)


def unseen(rows: DataFrame, table: str, batch: int, day: str) -> DataFrame:
    """The distinct rows that no other batch of the table holds. A row can only repeat under its own day (column ``day``, a
    date), so only the folders of the days in ``rows`` are read: work follows the arrivals, not the history."""
    spark = rows.sparkSession
    new = rows.distinct()
    if not exists(spark, table):
        return new
    schema = f"{', '.join(f'`{c}` {t}' for c, t in rows.dtypes)}, batch int"
    days = new.select(F.col(day).alias("__day")).distinct()
    old = spark.read.schema(schema).parquet(table).where(F.col("batch") != batch)
    old = old.join(F.broadcast(days), F.col(day).eqNullSafe(F.col("__day")), "left_semi")  # a calendar
    seen = old.select(*[h.alias(f"__s{i}") for i, h in enumerate(row_hashes(rows.columns))])
    return new.join(seen, [h == F.col(f"__s{i}") for i, h in enumerate(row_hashes(rows.columns))], "left_anti")


def collect_window(stream: DataFrame, table: str, late: str, checkpoint: str, ts: str, last_poll: str, snapshot: str) -> None:
    """Append rows timed in (last_poll, snapshot] to ``table``; others, and untimed ones, go to ``late``. A row that repeats
    comes once, however late the copy is: batches are compared with what the tables hold of the same days, so there is no
    state that could grow or expire. Tables have the folders batch and day."""
    inside = F.coalesce((F.col(ts) > F.lit(last_poll).cast("timestamp")) & (F.col(ts) <= F.lit(snapshot).cast("timestamp")), F.lit(False))

    def on_batch(df: DataFrame, batch: int) -> None:
        df = df.withColumn("day", F.to_date(ts)).persist()
        _put(unseen(df.where(inside), table, batch, "day"), table, batch, "day")
        _put(unseen(df.where(~inside), late, batch, "day"), late, batch, "day")
        df.unpersist()

    run_now(stream, on_batch, checkpoint)


def ingest_ledger(stream: DataFrame, ledger: str, checkpoint: str, keys: list[str], day: str) -> None:
    """One row per distinct key of arrivals, once, however often and late they arrive; ``day`` is the key that dates it."""
    run_now(stream.select(*keys), lambda df, i: _put(unseen(df, ledger, i, day), ledger, i, day), checkpoint)


def newest_wins(parts: DataFrame, key: str, ts: str, *ties: str, keep_days: int | None = None) -> DataFrame:
    """The newest row of each key; with keep_days only those within as many days of the newest of all."""
    w = Window.partitionBy(key).orderBy(F.desc(ts), *[F.desc(t) for t in ties])
    out = parts.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    if keep_days is not None:
        last = out.agg(F.max(ts).alias("__last"))
        out = out.crossJoin(F.broadcast(last)).where(F.datediff("__last", ts) < keep_days).drop("__last")  # one row
    return out


def merge_newest(stream: DataFrame, table: str, checkpoint: str, key: str, ts: str, *ties: str, keep_days: int, every: int = 8) -> None:
    """Keep the newest version of each key, for ``keep_days`` before the newest of all; ``read_newest`` reads it.

    Each batch writes its newest versions. Every so many batches all that is held is merged into one table without what is
    outdated or outlived, and what went into the merge before is removed (the last one stays for readers at work). So the
    table holds the keys alive and the versions of ``every`` batches, whatever has passed by. A replayed batch or merge
    writes the same again.
    """

    def on_batch(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        _put(newest_wins(df, key, ts, *ties), f"{table}/part", batch)
        if batch % every == every - 1:
            before = merged_at(spark, table)
            schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
            read_newest(spark, table, schema, key, ts, *ties, keep_days=keep_days, upto=batch).write.mode("overwrite").parquet(f"{table}/base/upto={batch}")
            for at in (x for x in before if x < batch):
                if at != max(before):
                    remove(spark, f"{table}/base/upto={at}")
            if before:
                for at in children(spark, f"{table}/part", "batch="):
                    if at <= max(before):
                        remove(spark, f"{table}/part/batch={at}")

    run_now(stream, on_batch, checkpoint)


def merged_at(spark: SparkSession, table: str) -> list[int]:
    """Batches up to which finished merges reach."""
    return [x for x in children(spark, f"{table}/base", "upto=") if exists(spark, f"{table}/base/upto={x}/_SUCCESS")]


def read_newest(spark: SparkSession, table: str, schema: str, key: str, ts: str, *ties: str, keep_days: int, upto: int | None = None) -> DataFrame:
    """The newest version of each key: of the last merge and of the batches after it."""
    bases = [x for x in merged_at(spark, table) if upto is None or x < upto]
    last = max(bases, default=-1)
    paths = [f"{table}/base/upto={last}"] if bases else []
    paths += [f"{table}/part/batch={x}" for x in children(spark, f"{table}/part", "batch=") if x > last and (upto is None or x <= upto)]
    rows = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    return newest_wins(rows, key, ts, *ties, keep_days=keep_days)


def missing_business_days(held: DataFrame, day: str, start: str, end: str) -> DataFrame:
    """(day) of the weekdays from start to end that ``held`` has no row of: what a resumed collection has to fetch."""
    days = held.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day")).where(F.weekday("day") < 5)
    return days.join(held.select(F.col(day).alias("__d")).distinct(), F.col("day") == F.col("__d"), "left_anti")


#: Events of a commit-reveal stream, and what is said of each.
EVENTS = "kind string, config string, predict_ts timestamp, target_t timestamp, arm string, seal string, value double, arrived timestamp"
VERDICTS = f"{EVENTS}, verdict string, scored double"


def commit_reveal(stream: DataFrame, keep_days: int = 30, late: str = "1 day", buckets: int = 256) -> DataFrame:
    """Each event of the stream (EVENTS; kind is commit or reveal) with its verdict, as it arrives.

    A prediction is named by (config, predict_ts). Its first commit is ``sealed``; the same seal and target again is
    ``repeated``, any other ``changed`` and refused. A reveal without a commit of that target is refused as ``no commit``,
    one that arrives before the target as ``early``; the first one of an arm after it is ``scored``, and further ones are
    ``repeated`` with the first one's value. Untimed events, and such without a name, are refused as ``unnamed``.

    State per prediction: seal, target and the arms scored. It goes when the watermark (``late`` behind the arrivals)
    passes ``keep_days`` after the target, so its size follows the predictions under way. Predictions are dealt to
    ``buckets`` by hash and a bucket's are judged together, as a call of the function costs far more than an event; the
    number stays as it is for the life of a checkpoint. Events of one prediction are taken in the order of arrival within
    a batch.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    day = 86_400_000_000

    def known(frame, name):
        return [None if x is None or x != x else x for x in frame[name].tolist()]

    def micros(frame, name):
        times = frame[name]
        return [None if gone else t for gone, t in zip(times.isna().tolist(), times.astype("datetime64[us]").astype("int64").tolist())]

    def judge(key, frames, state: GroupState):
        held = {}
        if state.exists:
            names, times, seals, targets, owners, arms, values = state.get
            held = {n: (s, t, {}) for n, s, t in zip(zip(names, times), seals, targets)}
            by_place = list(held.values())
            for i, arm, value in zip(owners, arms, values):
                by_place[i][2][arm] = value
        if not state.hasTimedOut:
            rows = pd.concat(list(frames)).sort_values(["arrived", "kind", "arm", "seal", "value"], kind="stable")
            verdicts, scores = [], []
            columns = (known(rows, "kind"), known(rows, "config"), micros(rows, "predict_ts"), micros(rows, "target_t"), known(rows, "arm"), known(rows, "seal"), rows["value"].tolist(), micros(rows, "arrived"))
            for kind, config, predict, target, arm, seal, value, arrived in zip(*columns):
                verdict, scored, p = "no commit", None, held.get((config, predict))
                if config is None or predict is None or target is None:
                    verdict = "unnamed"
                elif kind == "commit":
                    if p is None:
                        held[config, predict] = (seal, target, {})
                        verdict = "sealed"
                    else:
                        verdict = "repeated" if (seal, target) == p[:2] else "changed"
                elif p is not None and target == p[1]:
                    if arrived < target:
                        verdict = "early"
                    elif arm in p[2]:
                        verdict, scored = "repeated", p[2][arm]
                    else:
                        p[2][arm] = scored = value
                        verdict = "scored"
                verdicts.append(verdict)
                scores.append(scored)
        now = state.getCurrentWatermarkMs()
        ends = lambda p: (p[1] + keep_days * day) // 1000
        held = {n: p for n, p in held.items() if ends(p) > now}
        if held:
            alive = list(held.values())
            arms = [(i, arm, value) for i, p in enumerate(alive) for arm, value in p[2].items()]
            state.update((*map(list, zip(*held)), [p[0] for p in alive], [p[1] for p in alive], *([x[k] for x in arms] for k in range(3))))
            state.setTimeoutTimestamp(min(map(ends, alive)))
        elif state.exists:
            state.remove()
        if not state.hasTimedOut:
            yield rows.assign(verdict=verdicts, scored=pd.Series(scores, index=rows.index, dtype="float64"))[[c.split()[0] for c in VERDICTS.split(", ")]]

    names = [c.split()[0] for c in EVENTS.split(", ")]
    timed = stream.select(*names).withWatermark("arrived", late).withColumn("bucket", F.pmod(F.xxhash64("config", "predict_ts"), F.lit(buckets)))
    state = "config array<string>, predict_us array<bigint>, seal array<string>, target_us array<bigint>, owner array<int>, arm array<string>, value array<double>"
    return timed.groupBy("bucket").applyInPandasWithState(judge, VERDICTS, state, "append", GroupStateTimeout.EventTimeTimeout)


def windowed_counts(stream: DataFrame, ts: str, key: str, window: str = "1 day", slide: str | None = None, late: str = "2 days") -> DataFrame:
    """Counts per key and event-time window; rows later than the watermark are dropped by the engine."""
    stream = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    return stream.withWatermark(ts, late).groupBy(w, key).agg(F.count("*").alias("n"))
