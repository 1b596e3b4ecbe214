"""Queries through user hooks, and the fundamental ratios and growth of filings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import adapters as A
from ..operators import hooks as H
from ..operators import regression as G
from ..operators.asof import asof_join
from ..operators.joins import safe_divide
from .registry import query


@query()
def e28_ar_surprise(spark, d):
    """One-step errors of rolling autoregressions per ticker, in units of the deviation of the errors before."""
    out = G.lagged_surprises(A.prices_monthly(spark, d), "ticker", "date", "close", 21, 5)
    return out.select("ticker", "date", F.round("residual", 6).alias("residual"), F.round("surprise", 6).alias("surprise"))


WIDE = "select ticker, filed, max(value) filter (metric = '1-URGENT') as income, max(value) filter (metric = '2-HIGH') as assets, max(value) filter (metric = '3-MEDIUM') as equity, max(value) filter (metric = '5-LOW') as debt from facts group by 1, 2"


def statements(spark, d):
    """Facts side by side by filing date: one exchange for all metrics."""
    f = A.facts(spark, d).groupBy("ticker", "filed").pivot("metric", ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"]).agg(F.max("value"))
    return f.toDF("ticker", "filed", "income", "assets", "equity", "debt")


@query("select ticker, filed, round(case when abs(assets) >= 1e-9 then income / assets end, 6) as roa, round(case when abs(equity) >= 1e-9 then income / equity end, 6) as roe, round(case when abs(equity) >= 1e-9 then debt / equity end, 6) as debt_to_equity, round(case when abs(assets) >= 1e-9 then debt / assets end, 6) as leverage from wide", {"wide": WIDE})
def e35_fundamental_ratios(spark, d):
    c = F.col
    r = lambda n, x, name: F.round(safe_divide(c(n), c(x)), 6).alias(name)
    return statements(spark, d).select("ticker", "filed", r("income", "assets", "roa"), r("income", "equity", "roe"), r("debt", "equity", "debt_to_equity"), r("debt", "assets", "leverage"))


@query("select m.date, m.ticker, round(g.growth, 6) as growth from (select distinct cast(date_trunc('month', date) as date) as date, ticker from prices) m asof left join (select ticker, filed, assets / lag(assets) over (partition by ticker order by filed) - 1 as growth from wide where assets is not null) g on g.ticker = m.ticker and m.date >= g.filed", {"wide": WIDE})
def e36_filing_growth(spark, d):
    from .join_queries import month_keys

    g = statements(spark, d).where("assets is not null")
    g = g.select("ticker", "filed", (F.col("assets") / F.lag("assets").over(Window.partitionBy("ticker").orderBy("filed")) - 1).alias("growth"))
    return asof_join(month_keys(spark, d), g, "date", "filed", by=["ticker"]).select("date", "ticker", F.round("growth", 6).alias("growth"))


@query("select date, ticker, round(close, 6) as close, round(close / avg(close) over (partition by date) - 1, 6) as relative from prices_monthly")
def j01_feature_callback(spark, d):
    def relative(df):
        w = Window.partitionBy("date")
        return df.select("date", "ticker", F.round(F.col("close") / F.avg("close").over(w) - 1, 6).alias("relative"))

    out = H.with_features(A.prices_monthly(spark, d), relative, ["date", "ticker"])
    return out.select("date", "ticker", F.round("close", 6).alias("close"), "relative")


@query("select t.fold, count(*) as n, round(sqrt(avg((t.y - m.p) * (t.y - m.p))), 6) as rmse from tagged t join (select fold, avg(y) as p from tagged where role = 'train' group by 1) m using (fold) where t.role = 'test' group by 1", {"pan": "select *, cast(date + interval 1 month as date) as label_end from (select date, ticker, close, lead(close) over (partition by ticker order by date) / close - 1 as y from prices_monthly) where y is not null", "folds": "select b as fold, min(date) as test_start, max(date) as test_end from (select date, ntile(5) over (order by date) - 1 as b from (select distinct date from pan)) where b > 0 group by 1", "tagged": "select p.*, f.fold, case when date between test_start and test_end then 'test' when date < test_start and label_end <= test_start then 'train' end as role from pan p, folds f"})
def j02_learner_callback(spark, d):
    """A user's learner, here the training mean, on every fold; it learns and predicts by batches, so no task holds a fold."""
    from ..operators.splits import per_fold_parts
    from .split_queries import tagged

    def learn(train):
        return train["y"].sum(), int(train["y"].count())

    def merge(a, b):
        return a[0] + b[0], a[1] + b[1]

    def predict(model, test):
        return test[["fold", "y"]].assign(score=model[0] / model[1])

    scored = per_fold_parts(tagged(spark, d).select("fold", "role", "y"), learn, merge, predict, "fold int, y double, score double")
    return scored.groupBy(F.col("fold").cast("long").alias("fold")).agg(F.count("*").alias("n"), F.round(F.sqrt(F.avg((F.col("y") - F.col("score")) ** 2)), 6).alias("rmse"))


@query("select ticker, round(median(close), 6) as mid, round(max(close) - min(close), 6) as span from prices_monthly group by 1")
def j03_statistic_callback(spark, d):
    import pandas as pd

    def mid(v: pd.Series) -> float:
        return float(v.median())

    def span(v: pd.Series) -> float:
        return float(v.max() - v.min())

    return A.prices_monthly(spark, d).groupBy("ticker").agg(F.round(H.statistic(mid)("close"), 6).alias("mid"), F.round(H.statistic(span)("close"), 6).alias("span"))


@query("select conv_id, turn, round(length(text) / (length(text) + 100.0), 6) as positive from conversations")
def j04_text_scores(spark, d):
    def load():
        import pandas as pd

        return lambda texts: pd.DataFrame({"positive": (texts.str.len() / (texts.str.len() + 100.0)).round(6)})

    scorer = H.text_scorer(load, "positive double")
    return A.table(spark, d, "conversations").select("conv_id", "turn", scorer("text").alias("s")).select("conv_id", "turn", F.col("s.positive").alias("positive"))
