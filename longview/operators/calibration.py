"""Per-horizon calibration: fit, apply and report."""

from __future__ import annotations

from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from longview.functions.risk import HORIZONS, SCORE_COLUMNS, monotone
from longview.functions.text import half_even
from longview.session import cut

from .metrics import by_horizon, horizon_metrics, reliability, with_labels
from .splits import assert_train_only

METHODS = ("isotonic", "platt")
MAX_STEPS = 100


class Calibrator:
    """One fitted curve per horizon; an unfitted one passes scores through.

    ``models`` maps a horizon to an isotonic model, or to (slope, intercept).
    """

    def __init__(self, method: str = "isotonic", models: dict[int, object] | None = None, n_train: int = 0):
        if method not in METHODS:
            raise ValueError(f"method must be one of {METHODS}, got {method!r}")
        self.method, self.models, self.n_train = method, models or {}, n_train

    @property
    def fitted(self) -> bool:
        return bool(self.models)

    def fit(self, training: DataFrame) -> Calibrator:
        """Fit on rows of year_1..year_6 and label; both classes are required."""
        # Equal scores are one weighted point, so a hot score shrinks before any shuffle.
        points = cut(by_horizon(training).groupBy("horizon", "score").agg(
            F.count(F.lit(1)).cast("double").alias("weight"), F.sum("label").cast("double").alias("positives")))
        n, positives = fit_counts(points)
        if n == 0:
            raise ValueError("no labelled patients to calibrate on")
        if positives in (0, n):
            raise ValueError("calibration needs both positive and negative labels")
        self.models = fit_platt(points) if self.method == "platt" else fit_isotonic(points)
        self.n_train = n
        return self

    def apply(self, scores: DataFrame) -> DataFrame:
        """Calibrate year_1..year_6 in place, kept monotone; adds ``calibrated``."""
        if not self.fitted:
            return scores.withColumn("calibrated", F.lit(False))
        out = scores
        for horizon, column in zip(HORIZONS, SCORE_COLUMNS):
            out = self._predict(out, horizon, column)
        curve = monotone(F.array(*[F.col(f"_cal_{h}") for h in HORIZONS]))
        out = out.withColumn("_curve", curve)
        return out.withColumns({c: F.get("_curve", F.lit(i)) for i, c in enumerate(SCORE_COLUMNS)}).withColumn(
            "calibrated", F.lit(True)).drop("_curve", *[f"_cal_{h}" for h in HORIZONS])

    def _predict(self, df: DataFrame, horizon: int, column: str) -> DataFrame:
        model, name = self.models[horizon], f"_cal_{horizon}"
        if self.method == "isotonic":
            typed = df.withColumn(column, F.col(column).cast("double"))
            return model.copy({model.featuresCol: column, model.predictionCol: name}).transform(typed)
        slope, intercept = model
        return df.withColumn(name, sigmoid(F.col(column) * slope + intercept))

    def knots(self, spark: SparkSession) -> DataFrame:
        """The fitted points (isotonic) or slope and intercept (Platt) as a table."""
        rows = []
        for h, m in self.models.items():
            pairs = zip(m.boundaries, m.predictions) if self.method == "isotonic" else [m]
            rows += [(h, float(b), float(p)) for b, p in pairs]
        return spark.createDataFrame(rows, "horizon int, boundary double, prediction double")

    def save(self, spark: SparkSession, path: str) -> None:
        if self.method == "platt":
            self.knots(spark).withColumn("n_train", F.lit(self.n_train)).write.mode("overwrite").parquet(path)
            return
        for h, m in self.models.items():
            m.write().overwrite().save(f"{path}/n={self.n_train}/horizon={h}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, method: str, n_train: int) -> Calibrator:
        if method == "platt":
            rows = spark.read.parquet(path).collect()  # one row per horizon
            return cls(method, {r["horizon"]: (r["boundary"], r["prediction"]) for r in rows}, rows[0]["n_train"])
        return cls(method, {h: IsotonicRegressionModel.load(f"{path}/n={n_train}/horizon={h}") for h in HORIZONS}, n_train)


def fit_isotonic(points: DataFrame) -> dict[int, IsotonicRegressionModel]:
    """Isotonic regression per horizon over weighted points."""
    model = IsotonicRegression(featuresCol="score", labelCol="rate", weightCol="weight", isotonic=True)
    rated = points.withColumn("rate", F.col("positives") / F.col("weight"))
    return {h: model.fit(rated.filter(F.col("horizon") == c)) for h, c in zip(HORIZONS, SCORE_COLUMNS)}


def fit_platt(points: DataFrame) -> dict[int, tuple[float, float]]:
    """Logistic curve per horizon with a unit penalty on the slope, by Newton steps.

    All horizons advance together: a step is one small aggregate over the
    points. A step that raises the loss is halved.
    """
    names = dict(zip(SCORE_COLUMNS, HORIZONS))
    at = {c: (0.0, 0.0) for c in names}
    last: dict[str, tuple[float, tuple[float, float]]] = {}
    settled: set[str] = set()
    x, w, pos = F.col("score"), F.col("weight"), F.col("positives")
    for _ in range(MAX_STEPS):
        pick = lambda i: F.element_at(F.create_map(*[F.lit(v) for c, ab in at.items() for v in (c, ab[i])]), F.col("horizon"))
        z = x * F.col("_a") + F.col("_b")
        p, r = F.col("_p"), F.col("_p") * w - pos
        h = w * p * (1 - p)
        loss = w * (F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))) - pos * z
        sums = points.withColumns({"_a": pick(0), "_b": pick(1)}).withColumns({"_p": sigmoid(z), "_l": loss}).groupBy("horizon").agg(
            F.sum("_l").alias("l"), F.sum(r * x).alias("ga"), F.sum(r).alias("gb"), F.sum(h * x * x).alias("haa"),
            F.sum(h * x).alias("hab"), F.sum(h).alias("hbb")).collect()  # one row per horizon
        for s in sums:
            c, (a, b) = s["horizon"], at[s["horizon"]]
            total = s["l"] + a * a / 2
            if c in last and total > last[c][0] + 1e-9 * abs(last[c][0]):
                a0, b0 = last[c][1]
                at[c] = ((a + a0) / 2, (b + b0) / 2)
                continue
            last[c] = (total, (a, b))
            ga, haa, hab, hbb = s["ga"] + a, s["haa"] + 1.0, s["hab"], s["hbb"]
            det = haa * hbb - hab * hab
            da, db = (hbb * ga - hab * s["gb"]) / det, (haa * s["gb"] - hab * ga) / det
            at[c] = (a - da, b - db)
            if max(abs(da), abs(db)) < 1e-10 * (1 + abs(a) + abs(b)):
                settled.add(c)
        if len(settled) == len(at):
            return {names[c]: ab for c, ab in at.items()}
    raise RuntimeError(f"the logistic fit did not settle in {MAX_STEPS} steps")


def sigmoid(c: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))


def fit_counts(points: DataFrame) -> tuple[int, int]:
    """Rows and positives behind the weighted points."""
    one = points.filter(F.col("horizon") == SCORE_COLUMNS[0])
    row = one.agg(F.coalesce(F.sum("weight"), F.lit(0.0)), F.coalesce(F.sum("positives"), F.lit(0.0))).first()
    return int(row[0]), int(row[1])


def fit_on_train(scores: DataFrame, splits: DataFrame, method: str = "isotonic") -> Calibrator:
    """Fit on labelled train patients only."""
    training = with_labels(scores, splits, "train")
    assert_train_only(training)
    return Calibrator(method).fit(training)


def fit_info(training: DataFrame, method: str) -> DataFrame:
    """Size and positive rate of the fitting rows."""
    return training.agg(F.count(F.lit(1)).alias("n_train"), F.sum("label").alias("n_train_positive"),
                        half_even(F.avg("label"), 4).alias("train_positive_rate")).withColumn("method", F.lit(method))


def held_out_report(calibrator: Calibrator, scores: DataFrame, splits: DataFrame, split: str) -> tuple[DataFrame, DataFrame]:
    """ROC-AUC, Brier before and after, and reliability after, per horizon."""
    held = cut(with_labels(scores, splits, split))  # read three times below
    raw, cal = by_horizon(held), by_horizon(calibrator.apply(held))
    before, after = horizon_metrics(raw, digits=True), horizon_metrics(cal, digits=True)
    table = before.select("horizon", "n", "roc_auc", F.col("brier").alias("brier_before")).join(
        after.select("horizon", F.col("brier").alias("brier_after")), "horizon")
    return table, reliability(cal)
