"""Time splits with purge and embargo, controls, and naive baselines, as joins with small fold tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import ranked


def walk_forward_folds(times: DataFrame, date: str, n_folds: int) -> DataFrame:
    """(fold, test_start, test_end) of equal runs of the distinct dates after a first train part; a calendar-sized table."""
    numbered = times.select(date).distinct().withColumn("__b", F.ntile(n_folds + 1).over(Window.orderBy(date)) - 1)
    return numbered.where("__b > 0").groupBy(F.col("__b").alias("fold")).agg(F.min(date).alias("test_start"), F.max(date).alias("test_end"))


def tag_walk_forward(panel: DataFrame, folds: DataFrame, date: str, label_end: str) -> DataFrame:
    """Rows tagged (fold, role): test inside the fold's dates; train if dated before and labelled by its start."""
    role = F.when(F.col(date).between(F.col("test_start"), F.col("test_end")), "test").when((F.col(date) < F.col("test_start")) & (F.col(label_end) <= F.col("test_start")), "train")
    exploded = panel.crossJoin(F.broadcast(folds))  # a handful of folds
    return exploded.withColumn("role", role).where("role is not null").drop("test_start", "test_end")


def tag_group_kfold(panel: DataFrame, group: str, date: str, label_end: str, k: int, embargo_days: int = 0) -> DataFrame:
    """K folds of whole groups; a train row is purged if its span from date to label end overlaps a test group's span, or
    if it starts within the embargo after one."""
    spans = panel.groupBy(group).agg(F.min(date).alias("__lo"), F.max(label_end).alias("__hi"))
    spans = spans.withColumn("__fold", (F.dense_rank().over(Window.orderBy(group)) - 1) % k)
    tests = F.broadcast(spans.select(F.col("__fold").alias("fold"), "__lo", "__hi"))
    rows = panel.join(F.broadcast(spans.select(group, "__fold")), group)
    test = rows.withColumn("fold", F.col("__fold")).withColumn("role", F.lit("test"))
    train = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold")).where(F.col("fold") != F.col("__fold"))
    hit = (train["fold"] == tests["fold"]) & (train[date] <= F.date_add(tests["__hi"], embargo_days)) & (train[label_end] >= tests["__lo"])
    train = train.join(tests, hit, "left_anti").withColumn("role", F.lit("train"))
    return test.unionByName(train).drop("__fold")


def chronology(tagged: DataFrame, date: str, label_end: str) -> DataFrame:
    """Per fold: last train date and label end, first test date, and whether training ends before testing."""
    g = tagged.groupBy("fold").agg(
        F.max(F.when(F.col("role") == "train", F.col(date))).alias("train_last"), F.max(F.when(F.col("role") == "train", F.col(label_end))).alias("label_last"), F.min(F.when(F.col("role") == "test", F.col(date))).alias("test_first")
    )
    return g.withColumn("ok", (F.col("train_last") < F.col("test_first")) & (F.col("label_last") <= F.col("test_first")))


def hash_permuted(df: DataFrame, value: str, within: list[str], order: list[str], seed: int) -> DataFrame:
    """df with value permuted among the rows of each group: natural order joined to the order of an md5 of the seed and the
    order columns. Rows that agree in all of these must agree in value as well. Without ``within`` the whole table is one
    group, which is ranked by ranges, so no task holds it."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in order]))
    if not within:
        place = ranked(df, "__i", *order)
        other = ranked(df.select(F.col(value).alias("__v"), key.alias("__h"), *order), "__i", "__h", *order).select("__v", "__i")
        return place.join(other, "__i").drop("__i", value).withColumnRenamed("__v", value)
    natural = Window.partitionBy(*within).orderBy(*order)
    mixed = Window.partitionBy(*within).orderBy(key, *order)
    place = df.withColumn("__i", F.row_number().over(natural))
    other = df.select(*within, F.col(value).alias("__v"), F.row_number().over(mixed).alias("__i"))
    return place.join(other, [*within, "__i"]).drop("__i", value).withColumnRenamed("__v", value)


def known_permuted(df: DataFrame, value: str, within: list[str], order: list[str], seed: int) -> DataFrame:
    """hash_permuted among the rows whose value is known; the others keep their null, so coverage stays as it is."""
    known = df.where(F.col(value).isNotNull())
    return hash_permuted(known, value, within, order, seed).unionByName(df.where(F.col(value).isNull()))


def fit_lines(tagged: DataFrame, x: str, y: str, least: int = 10, by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Test rows of each fold (of each group ``by``) with the intercept, slope and score of the line fitted on its training rows; folds of fewer
    than ``least`` training rows give none. Fits are aggregates, so no fold is gathered in a task."""
    fits = tagged.where("role = 'train'").groupBy(*by, "fold").agg(F.count("*").alias("__n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept")).where(F.col("__n") >= least).drop("__n")
    return tagged.where("role = 'test'").join(F.broadcast(fits), [*by, "fold"]).withColumn("score", F.col("intercept") + F.col("slope") * F.col(x))  # a row per fold


def per_fold(tagged: DataFrame, fit_predict: Callable, schema: str) -> DataFrame:
    """Run a user's learner on each fold in parallel: fit_predict(train frame, test frame) -> frame of ``schema``. The
    learner sees its fold as pandas frames, so a fold must fit in a task; fit_lines() and per_fold_parts() have no such bound."""

    def run(pdf):
        return fit_predict(pdf[pdf["role"] == "train"], pdf[pdf["role"] == "test"])

    return tagged.groupBy("fold").applyInPandas(run, schema)


def per_fold_parts(tagged: DataFrame, learn: Callable, merge: Callable, predict: Callable, schema: str) -> DataFrame:
    """Run a user's learner on folds of any size: learn(train frame) -> what a batch teaches, merge(a, b) -> both of them,
    predict(model, test frame) -> frame of ``schema``, where a model is all parts of its fold merged.

    Rows are read in batches where they lie, and only parts, one per task and fold, are exchanged. A model goes along with
    the test rows of its fold, so it should be coefficients or counts. Folds without training rows give none. Select the
    columns that the learner needs beforehand.
    """
    import pickle
    from functools import reduce

    import pandas as pd

    def learned(frames):
        parts = {}
        for frame in frames:
            for fold, train in frame.groupby("fold"):
                part = learn(train)
                parts[fold] = merge(parts[fold], part) if fold in parts else part
        yield pd.DataFrame({"fold": list(parts), "part": [pickle.dumps(p) for p in parts.values()]})

    def merged(pdf):
        return pd.DataFrame({"fold": pdf["fold"][:1], "model": [pickle.dumps(reduce(merge, map(pickle.loads, sorted(pdf["part"]))))]})

    def predicted(frames):
        for frame in frames:
            for _, test in frame.groupby("fold"):
                yield predict(pickle.loads(test["model"].iloc[0]), test.drop(columns="model"))

    kind = dict(tagged.dtypes)["fold"]
    parts = tagged.where("role = 'train'").mapInPandas(learned, f"fold {kind}, part binary")
    models = parts.groupBy("fold").applyInPandas(merged, f"fold {kind}, model binary")
    tests = tagged.where("role = 'test'").join(F.broadcast(models), "fold")  # a row per fold
    return tests.mapInPandas(predicted, schema)
