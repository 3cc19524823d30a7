"""Training sets, the calibration model and its scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinewell.functions.domain import edge_side, expected_value

FEATURES = ("prob_velocity", "bet_arrival_rate", "realized_vol", "market_prob")


def training_rows(features: DataFrame, markets: DataFrame, probabilities: DataFrame) -> DataFrame:
    """Features of resolved manifold markets with the probability at the same time; repeated times give a row for each pair."""
    resolved = markets.where("platform = 'manifold' and resolved_outcome is not null").select("market_id", "close_time", "resolved_outcome")
    prices = probabilities.select("market_id", "ts_ns", F.col("probability").alias("market_prob"))
    return features.join(resolved, "market_id").join(prices, ["market_id", "ts_ns"], "left")


def not_ahead(rows: DataFrame, close_ns: str = "close_ns") -> DataFrame:
    """Rows strictly before their market's close; an unknown close keeps the row."""
    return rows.where(F.col(close_ns).isNull() | (F.col("ts_ns") < F.col(close_ns)))


def priced(rows: DataFrame, column: str = "market_prob") -> DataFrame:
    """P4."""
    return rows.where(F.col(column).isNotNull() & ~F.isnan(column))


def newest_open_rows(features: DataFrame, markets: DataFrame, probabilities: DataFrame) -> DataFrame:
    """The newest features of open manifold markets, all of equal time, with the probability at that time."""
    open_markets = markets.where("platform = 'manifold' and resolved_outcome is null").select("market_id")
    own = features.join(open_markets, "market_id", "left_semi")
    newest = own.groupBy("market_id").agg(F.max("ts_ns").alias("ts_ns"))
    prices = probabilities.select("market_id", "ts_ns", F.col("probability").alias("market_prob"))
    return own.join(newest, ["market_id", "ts_ns"]).join(prices, ["market_id", "ts_ns"], "left")


def predictions(rows: DataFrame, fee: float = 0.0, slippage: float = 0.0, min_ev: float | None = None) -> DataFrame:
    """Rows of (p_model, p_market) with edge, side and expected value; only those above min_ev where it is given."""
    m, p = F.col("p_model"), F.col("p_market")
    out = rows.withColumn("edge", m - p).withColumn("side", edge_side(F.col("edge"))).withColumn("ev", expected_value(m, p, fee, slippage))
    return out if min_ev is None else out.where(F.col("ev") > min_ev)


def brier(y: str = "y", p: str = "p"):
    """A1."""
    return F.avg(F.pow(F.col(p) - F.col(y), 2))


def log_loss(y: str = "y", p: str = "p", eps: float = 1e-6):
    """A2."""
    q = F.least(F.greatest(F.col(p), F.lit(eps)), F.lit(1 - eps))
    return F.avg(-(F.col(y) * F.log(q) + (1 - F.col(y)) * F.log(1 - q)))


def reliability(df: DataFrame, bins: int = 10, y: str = "y", p: str = "p") -> DataFrame:
    """A3: count, mean prediction and observed frequency of each bin; empty bins have a count of 0 and null means."""
    place = F.least(F.greatest((F.col(p) * bins).cast("int"), F.lit(0)), F.lit(bins - 1))
    filled = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(place.alias("bin")).agg(
        F.count("*").alias("count"), F.avg(p).alias("mean_predicted"), F.avg(y).alias("observed")
    )
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(filled, "bin", "left").withColumn("count", F.coalesce("count", F.lit(0)))


def calibration_error(curve: DataFrame) -> DataFrame:
    """A4: of a reliability curve; null where it is empty."""
    gap = F.when(F.col("count") > 0, F.col("count") * F.abs(F.col("observed") - F.col("mean_predicted"))).otherwise(0.0)
    return curve.agg((F.sum(gap) / F.nullif(F.sum("count"), F.lit(0))).alias("ece"))


def side_by_side(*single: DataFrame) -> DataFrame:
    """Frames of one row each as one row."""
    out = single[0]
    for df in single[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out.agg(*[F.max(c).alias(c) for c in out.columns])


def report(df: DataFrame, bins: int = 10) -> DataFrame:
    """A5: one row: rows, markets, base rate, Brier score, log loss, calibration error."""
    scores = df.agg(
        F.count("*").alias("n"), F.countDistinct("market_id").alias("n_markets"), F.avg("y").alias("base_rate"), brier().alias("brier"), log_loss().alias("log_loss")
    )
    return side_by_side(scores, calibration_error(reliability(df, bins)))


def predicted_by(rows: DataFrame, model, columns: tuple[str, ...] = FEATURES, out: str = "p_model") -> DataFrame:
    """Scores of any fitted object with predict_proba(pandas frame of columns); of two columns of results the last is the probability of yes.

    The object travels to the workers; rows are scored an Arrow batch at a time.
    """

    @F.pandas_udf("double")
    def score(part: pd.DataFrame) -> pd.Series:
        p = np.asarray(model.predict_proba(part.set_axis(list(columns), axis=1)), float)
        return pd.Series(p[:, -1] if p.ndim == 2 else p)

    return rows.withColumn(out, score(F.struct(*columns)))


class BaselineModel:
    """Mean imputation, standardization by population deviation, and logistic regression with the ridge of C = 1.

    One class alone gives the base rate, no rows give 0.5, a column without any value is left out; predicting before fitting is an error.
    """

    def __init__(self, columns: tuple[str, ...] = FEATURES):
        self.columns = columns
        self.rate: float | None = None
        self.model = None

    def fit(self, df: DataFrame, label: str = "y") -> BaselineModel:
        from pyspark.ml.classification import LogisticRegression

        stats = df.agg(
            F.count("*").alias("n"), F.avg(label).alias("rate"),
            *[f(F.nanvl(F.col(c), F.lit(None).cast("double"))).alias(f"{k}_{c}") for c in self.columns for k, f in (("mean", F.avg), )],
        ).first()
        self.rate, self.model = (0.5 if not stats["n"] else float(stats["rate"])), None
        self.used = [c for c in self.columns if stats[f"mean_{c}"] is not None]
        self.means = {c: stats[f"mean_{c}"] for c in self.used}
        if not stats["n"] or self.rate in (0.0, 1.0) or not self.used:
            return self
        filled = self._filled(df)
        spread = filled.agg(*[F.stddev_pop(c).alias(c) for c in self.used]).first()
        self.scales = {c: spread[c] or 1.0 for c in self.used}
        ready = self._vectors(df).select("features", F.col(label).cast("double").alias("label"))
        self.model = LogisticRegression(regParam=1.0 / stats["n"], elasticNetParam=0.0, standardization=False, maxIter=1000, tol=1e-9).fit(ready)
        return self

    def _filled(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.coalesce(F.nanvl(F.col(c), F.lit(None).cast("double")), F.lit(self.means[c])) for c in self.used})

    def _vectors(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector

        z = [(F.col(c) - self.means[c]) / self.scales[c] for c in self.used]
        return self._filled(df).withColumn("features", array_to_vector(F.array(*z)))

    def predict(self, df: DataFrame, out: str = "p_model") -> DataFrame:
        if self.rate is None:
            raise RuntimeError("the model is not fitted")
        if self.model is None:
            return df.withColumn(out, F.lit(self.rate))
        from pyspark.ml.functions import vector_to_array

        scored = self.model.transform(self._vectors(df))
        p = vector_to_array("probability" if "probability" not in df.columns else self.model.getProbabilityCol())[1]
        return scored.withColumn(out, p).select(*df.columns, out)


def split_by_market(df: DataFrame, held_out: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Training and held-out rows; a market is in one of them with all its rows."""
    share = F.pmod(F.xxhash64("market_id"), F.lit(10_000)) / 10_000
    return df.where(share >= held_out), df.where(share < held_out)
