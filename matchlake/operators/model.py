"""Workload-risk model: training in Spark ML, scoring and explanation as plain expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as C
from ..functions.numbers import stable_round
from ..plans.blocked import running


@dataclass(frozen=True)
class RiskModel:
    """Eight constants per kind: the whole model fits in expressions."""

    medians: tuple[float, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]
    coefficients: tuple[float, ...]
    intercept: float
    version: str = "risk-lr"


# Published coefficients, intercept and medians. Centre and scale are not published; these are round
# numbers of the right size and are replaced by training, so the model carries a version name of its own.
DEFAULT_MODEL = RiskModel(
    medians=(1.0328, 116.2901, 21.0, 8.7101, 30.5665, 85.0, 158.1629, 0.0),
    means=(1.05, 116.0, 21.0, 8.7, 30.5, 80.0, 158.0, 0.45),
    scales=(0.35, 12.0, 9.0, 2.5, 1.6, 15.0, 9.0, 0.5),
    coefficients=(1.71399, 0.52757, 0.48354, 0.19351, -0.01439, 0.23592, 0.45797, 0.03536),
    intercept=-1.00127,
    version="risk-lr-assumed-scale",
)


def level(percent: Column, red: float = C.RISK_RED, yellow: float = C.RISK_YELLOW) -> Column:
    return F.when(percent >= red, "red").when(percent >= yellow, "yellow").when(percent.isNotNull(), "green")


def _scaled(model: RiskModel, i: int) -> Column:
    value = F.coalesce(F.col(C.FEATURES[i]), F.lit(model.medians[i]))
    return (value - model.means[i]) / model.scales[i]


def score(rows: DataFrame, model: RiskModel = DEFAULT_MODEL) -> DataFrame:
    """Add probability, percent (one decimal), level and the contributions sorted by size."""
    terms = [_scaled(model, i) * model.coefficients[i] for i in range(len(C.FEATURES))]
    logit = sum(terms[1:], terms[0]) + model.intercept
    parts = [
        F.struct(
            F.lit(f).alias("feature"),
            stable_round(F.col(f), 4).alias("value"),
            F.col(f).isNull().alias("imputed"),
            stable_round(_scaled(model, i), 4).alias("scaled"),
            stable_round(terms[i], 4).alias("contribution"),
            F.lit(i).alias("place"),
        )
        for i, f in enumerate(C.FEATURES)
    ]
    out = rows.withColumn("probability", 1 / (1 + F.exp(-logit)))
    out = out.withColumn("risk_percent", stable_round(F.col("probability") * 100, 1))
    return out.withColumns(
        {"level": level(F.col("risk_percent")), "contributions": by_size(F.array(*parts)), "model_version": F.lit(model.version)}
    )


def contribution_rows(rows: DataFrame, keys: Sequence[str], model: RiskModel = DEFAULT_MODEL) -> DataFrame:
    """(keys, feature, contribution, imputed): the contributions of ``score`` as rows in no order, straight from the features."""
    each = [
        F.struct(
            F.lit(f).alias("feature"), stable_round(_scaled(model, i) * model.coefficients[i], 4).alias("contribution"), F.col(f).isNull().alias("imputed"),
        )
        for i, f in enumerate(C.FEATURES)
    ]
    return rows.select(*keys, F.explode(F.array(*each)).alias("__c")).select(*keys, "__c.*")


def by_size(parts: Column) -> Column:
    """Largest absolute contribution first; equal ones keep the feature order."""
    keyed = F.transform(parts, lambda p: F.struct((-F.abs(p["contribution"])).alias("k"), p["place"].alias("p"), p.alias("v")))
    return F.transform(F.array_sort(keyed), lambda s: s["v"])


def factors(contributions: Column, n: int = 5) -> Column:
    """The n largest measured drivers with their direction."""
    labels = F.create_map(*[F.lit(x) for kv in C.FEATURE_LABELS.items() for x in kv])
    measured = F.slice(F.filter(contributions, lambda p: ~p["imputed"]), 1, n)
    return F.transform(
        measured,
        lambda p: F.struct(
            p["feature"].alias("feature"), labels[p["feature"]].alias("label"), p["value"].alias("value"),
            p["contribution"].alias("contribution"),
            F.when(p["contribution"] > 0, "up").otherwise("down").alias("direction"),
        ),
    )


def bar_widths(factor_list: Column) -> Column:
    """Share of the largest absolute contribution, in whole percent."""
    top = F.array_max(F.transform(factor_list, lambda p: F.abs(p["contribution"])))
    return F.transform(
        factor_list,
        lambda p: F.struct(
            p["feature"].alias("feature"),
            F.when(top > 0, F.floor(F.abs(p["contribution"]) / top * 100 + 0.5)).otherwise(F.lit(0)).cast("bigint").alias("width"),
        ),
    )


def hold_out(rows: DataFrame, key: str = "player_id", buckets: int = 4) -> DataFrame:
    """Whole players go to one side: one bucket in four is the test side."""
    return rows.withColumn("is_test", F.pmod(F.col(key) * 7919 + 13, F.lit(buckets)) == 0)


def train(rows: DataFrame, label: str = "label", c: float = 1.0, median_error: float = 1e-4) -> RiskModel:
    """Median imputation, standardisation and L2 logistic regression; returns the constants for ``score``.

    ``median_error`` is the relative rank error of the medians; 0 makes them exact at the cost of larger sketches.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler

    feats = list(C.FEATURES)
    data = rows.select(*[F.col(f).cast("double").alias(f) for f in feats], F.col(label).cast("double").alias("label"))
    # a feature without any value has no median; it is filled with 0 so that it carries nothing
    known = data.agg(F.count(F.lit(1)).alias("n"), *[F.count(f).alias(f) for f in feats]).first()
    usable = [f for f in feats if known[f] > 0]
    imputer = Imputer(strategy="median", inputCols=usable, outputCols=[f"__{f}" for f in usable], relativeError=median_error)
    fitted = imputer.fit(data)
    medians = {f: fitted.surrogateDF.first()[f] for f in usable}
    filled = data.select("label", *[F.coalesce(F.col(f), F.lit(float(medians.get(f, 0.0)))).alias(f) for f in feats])
    vectors = VectorAssembler(inputCols=feats, outputCol="raw").transform(filled)
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(vectors)
    n = known["n"]
    lr = LogisticRegression(regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-8)
    fit = lr.fit(scaler.transform(vectors).select("label", "features"))
    # the sample deviation is kept as the scale, so scoring repeats exactly what was fitted
    scales = [s if s > 0 else 1.0 for s in scaler.std.toArray()]
    return RiskModel(
        medians=tuple(float(medians.get(f, 0.0)) for f in feats),
        means=tuple(float(v) for v in scaler.mean.toArray()),
        scales=tuple(float(v) for v in scales),
        coefficients=tuple(float(v) for v in fit.coefficients.toArray()),
        intercept=float(fit.intercept),
        version="risk-lr-trained",
    )


def quality(scored: DataFrame, keys: Sequence[str], label: str = "label", probability: str = "probability") -> DataFrame:
    """Accuracy, precision, recall and Brier score at threshold 0.5."""
    y, p = F.col(label), F.col(probability)
    hit = p >= 0.5
    n = lambda cond: F.count(F.when(cond, 1))
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        (n((y == 1) == hit) / F.count(F.lit(1))).alias("accuracy"),
        F.coalesce(F.try_divide(n(hit & (y == 1)), n(hit)), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide(n(hit & (y == 1)), n(y == 1)), F.lit(0.0)).alias("recall"),
        F.avg((p - y) * (p - y)).alias("brier"),
    )


def auc(scored: DataFrame, keys: Sequence[str], label: str = "label", probability: str = "probability", blocks: int = 4096) -> DataFrame:
    """Area under the ROC curve from counts per distinct score.

    The running count of negatives is taken in ``blocks`` equal parts of the score range, so no key is ordered in one task.
    """
    keys = list(keys)
    bins = scored.groupBy(*keys, F.col(probability).alias("p")).agg(F.sum(F.col(label)).alias("pos"), F.sum(1 - F.col(label)).alias("neg"))
    below = running(bins, keys, [F.col("p")], F.floor(F.col("p") * blocks), {"below": ("sum", F.col("neg"))}, inclusive=False, split=True)
    won = below.withColumn("won", F.col("pos") * (F.col("below") + F.col("neg") / 2))
    return won.groupBy(*keys).agg((F.sum("won") / (F.sum("pos") * F.sum("neg"))).alias("auc"))
