"""Account and ring models on Spark ML, neighbor-mean features, ablation and attributions."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.functions.running import quantiles
from verdigris.operators.evaluation import auc_metrics
from verdigris.operators.hops import linked_means
from verdigris.session import materialize

# Boosting parameters in Spark ML terms.
TREE_PARAMS = {"maxIter": 20, "stepSize": 0.1, "maxDepth": 4, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "seed": 42}


def with_class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """weight = negatives / positives on positive rows, 1 on the rest."""
    row = df.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("n")).first()
    ratio = float(row["n"]) / row["p"] if row["p"] else 1.0
    return df.withColumn("class_weight", F.when(F.col(label) == 1, F.lit(ratio)).otherwise(F.lit(1.0)))


def boosted_pipeline(columns: list[str], **params) -> Pipeline:
    assembler = VectorAssembler(inputCols=columns, outputCol="inputs", handleInvalid="error")
    trees = GBTClassifier(featuresCol="inputs", labelCol="label", weightCol="class_weight", **{**TREE_PARAMS, **params})
    return Pipeline(stages=[assembler, trees])


def fit_account_model(train: DataFrame, columns: list[str], **params) -> PipelineModel:
    """Boosted trees on tabular (or tabular + graph) columns. ``train`` has ``label``."""
    return boosted_pipeline(columns, **params).fit(with_class_weights(train))


def bounded_rows(df: DataFrame, limit: int, key: str = "account_id") -> DataFrame:
    """At most about ``limit`` rows, drawn by a hash of the key; all of them below that. No fit reads its rows through this."""
    n = df.count()
    if n <= limit:
        return df
    return df.filter(F.pmod(F.xxhash64(F.lit("labelled"), F.col(key)), F.lit(1 << 30)) < F.lit(int(limit / n * (1 << 30))))


def fit_stopped(rows: DataFrame, columns: list[str], train: str = "split = 'train'", held: str = "split = 'val'", **params) -> PipelineModel:
    """Boosted trees that end once a tree no longer lowers the loss on the held rows.

    ``rows`` has ``label``; all those matching ``train`` are fitted, all those matching ``held``
    are only watched. Positives weigh negatives / positives of the fitted rows.
    """
    known = rows.filter(f"({train}) OR ({held})").withColumn("held", F.expr(held))
    row = known.filter("NOT held").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") != 1).alias("n")).first()
    ratio = float(row["n"]) / row["p"] if row["p"] else 1.0
    known = known.withColumn("class_weight", F.when(F.col("label") == 1, F.lit(ratio)).otherwise(F.lit(1.0)))
    options = {"maxIter": 60, "maxDepth": 5, "validationTol": 0.001, **params}
    if not known.filter("held").isEmpty():
        options["validationIndicatorCol"] = "held"
    return boosted_pipeline(columns, **options).fit(known)


def fit_report(model: PipelineModel, rows: DataFrame, columns: list[str], name: str) -> DataFrame:
    """(model, trees, columns, pr_auc, roc_auc) over ``rows``: the size of a fit and how it ranks them."""
    ranked = score(model, rows, columns).select(F.lit(name).alias("model"), F.col("label").cast("int").alias("label"), F.col("proba").alias("score"))
    trees = model.stages[-1].getNumTrees
    return auc_metrics(ranked, ["model"]).select(
        "model", F.lit(trees).cast("long").alias("trees"), F.lit(len(columns)).cast("long").alias("columns"), "pr_auc", "roc_auc"
    )


def score(model: PipelineModel, df: DataFrame, columns: list[str], name: str = "proba") -> DataFrame:
    """Add the probability of the positive class; missing model columns are an error."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing for scoring: {missing}")
    made = ["inputs", "scaled", "rawPrediction", "probability", "prediction"]
    out = model.transform(df)
    return out.withColumn(name, vector_to_array("probability")[1]).drop(*[c for c in made if c in out.columns])


class AveragePrecision(Evaluator):
    """Exact average precision for model selection."""

    def _evaluate(self, dataset: DataFrame) -> float:
        rows = dataset.select(
            F.lit("m").alias("model"), F.col("label").cast("int").alias("label"),
            vector_to_array("probability")[1].alias("score"),
        )
        return float(auc_metrics(rows, ["model"]).first()["pr_auc"])

    def isLargerBetter(self) -> bool:
        return True


def tune_account_model(train: DataFrame, columns: list[str], fold_col: str = "fold", folds: int = 5, grid: dict | None = None):
    """Grid search by average precision with the given (grouped) folds."""
    pipe = boosted_pipeline(columns)
    trees = pipe.getStages()[1]
    builder = ParamGridBuilder()
    for name, values in (grid or {"maxDepth": [3, 4], "stepSize": [0.05, 0.1]}).items():
        builder = builder.addGrid(getattr(trees, name), values)
    cv = CrossValidator(
        estimator=pipe, estimatorParamMaps=builder.build(), evaluator=AveragePrecision(), numFolds=folds,
        foldCol=fold_col, parallelism=2,
    )
    fitted = cv.fit(with_class_weights(train))
    return fitted.bestModel, list(zip([{p.name: v for p, v in m.items()} for m in fitted.getEstimatorParamMaps()], fitted.avgMetrics, strict=True))


def feature_importance(model: PipelineModel, columns: list[str], spark) -> DataFrame:
    values = model.stages[-1].featureImportances.toArray()
    rows = [(c, float(v)) for c, v in zip(columns, values, strict=True)]
    return spark.createDataFrame(rows, "feature STRING, importance DOUBLE").orderBy(F.desc("importance"), "feature")


# ------------------------------------------------------------------ neighborhood model
def standardize(df: DataFrame, columns: list[str], fit_on: DataFrame) -> DataFrame:
    """Population z-scores with statistics of ``fit_on`` (the train rows)."""
    stats = fit_on.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in columns]).first()
    scaled = {}
    for c in columns:
        mean, std = stats[c]["m"] or 0.0, stats[c]["s"] or 0.0
        scaled[c] = (F.col(c) - F.lit(mean)) / F.lit(std if std > 0 else 1.0)
    return df.withColumns(scaled)


def neighbor_means(df: DataFrame, edges: DataFrame, columns: list[str], hops: int = 2) -> DataFrame:
    """Unweighted means over the closed neighborhood, repeated: columns h1_*, h2_*, ..."""
    loops = df.select(F.col("account_id").alias("src"), F.col("account_id").alias("dst"))
    ways = F.array(
        F.struct(F.col("account_id_1").alias("src"), F.col("account_id_2").alias("dst")),
        F.struct(F.col("account_id_2").alias("src"), F.col("account_id_1").alias("dst")),
    )
    links = edges.select(F.explode(ways).alias("w")).select("w.*").unionByName(loops)
    out, layer = df, df.select("account_id", *columns)
    for h in range(1, hops + 1):
        layer = materialize(linked_means(links, layer, columns), "hop")
        out = out.join(layer.withColumnsRenamed({c: f"h{h}_{c}" for c in columns}), "account_id")
    return out


def fit_neighborhood_model(train: DataFrame, columns: list[str]) -> PipelineModel:
    """Logistic regression on own and neighborhood columns, class weighted."""
    stages = [
        VectorAssembler(inputCols=columns, outputCol="inputs", handleInvalid="error"),
        StandardScaler(inputCol="inputs", outputCol="scaled", withMean=True, withStd=True),
        LogisticRegression(featuresCol="scaled", labelCol="label", weightCol="class_weight", regParam=0.01, maxIter=50),
    ]
    return Pipeline(stages=stages).fit(with_class_weights(train))


def ensemble(a: DataFrame, b: DataFrame, score_a: str, score_b: str) -> DataFrame:
    """Mean of two score columns, aligned by account."""
    left = a.select("account_id", F.col(score_a).alias("_a"))
    right = b.select("account_id", F.col(score_b).alias("_b"))
    return left.join(right, "account_id").select("account_id", ((F.col("_a") + F.col("_b")) / 2).alias("proba_ensemble"))


# ------------------------------------------------------------------ attributions and ablation
def linear_attributions(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(account_id, feature, value): coefficient x (value - mean), for linear scores."""
    means = df.agg(*[F.avg(c).alias(c) for c in weights]).first()
    items = F.array(*[
        F.struct(F.lit(c).alias("feature"), (F.lit(float(w)) * (F.col(c) - F.lit(means[c] or 0.0))).alias("value"))
        for c, w in weights.items()
    ])
    return df.select("account_id", F.explode(items).alias("x")).select("account_id", "x.feature", "x.value")


def medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    long = df.unpivot([], [F.col(c).cast("double").alias(c) for c in columns], "feature", "value")
    found = quantiles(long, ["feature"], "value", {"q": 0.5}).collect()  # one row per feature
    return {r["feature"]: r["q"] for r in found}


def ablate(model: PipelineModel, rows: DataFrame, columns: list[str], features: list[str], median_of: dict[str, float], keep: list[str]) -> DataFrame:
    """Score rows with each feature replaced by its median: one scoring pass over all copies.

    Returns keep columns, ``feature`` ('' = unchanged copy) and ``proba``.
    """
    variants = F.explode(F.array(*[F.lit(f) for f in ["", *features]]))
    copies = rows.select(*keep, *[c for c in columns if c not in keep], variants.alias("feature"))
    swapped = {
        f: F.when(F.col("feature") == f, F.lit(float(median_of.get(f) or 0.0))).otherwise(F.col(f).cast("double"))
        for f in features
    }
    return score(model, copies.withColumns(swapped), columns).select(*keep, "feature", "proba")


def ablate_wanted(model: PipelineModel, rows: DataFrame, columns: list[str], wanted: DataFrame, median_of: dict[str, float]) -> DataFrame:
    """``ablate`` for the wanted (account_id, feature) pairs only, beside one unchanged copy of each account."""
    names = sorted(median_of)
    asked = wanted.select("account_id", "feature").filter(F.col("feature").isin(names))
    asked = asked.unionByName(asked.select("account_id").distinct().withColumn("feature", F.lit("")))
    copies = asked.join(rows.select("account_id", *columns), "account_id")
    swapped = {f: F.when(F.col("feature") == f, F.lit(float(median_of[f] or 0.0))).otherwise(F.col(f).cast("double")) for f in names}
    return score(model, copies.withColumns(swapped), columns).select("account_id", "feature", "proba")


def population_ablation(scored: DataFrame) -> DataFrame:
    """Per feature: mean and mean absolute change of the score. Input from ``ablate``."""
    base = scored.filter("feature = ''").select("account_id", F.col("proba").alias("original"))
    j = scored.filter("feature <> ''").join(base, "account_id").withColumn("delta", F.col("proba") - F.col("original"))
    return j.groupBy("feature").agg(
        F.avg("delta").alias("mean_score_delta"), F.avg(F.abs("delta")).alias("mean_abs_score_delta")
    )


def account_ablation(scored: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per wanted (account_id, feature): original and ablated score and their difference."""
    base = scored.filter("feature = ''").select("account_id", F.col("proba").alias("original_score"))
    j = scored.join(wanted.select("account_id", "feature"), ["account_id", "feature"], "left_semi").join(base, "account_id")
    delta = F.col("proba") - F.col("original_score")
    return j.select(
        "account_id", "feature", "original_score", F.col("proba").alias("ablated_score"), delta.alias("score_delta"),
        F.abs(delta).alias("absolute_score_change"),
    )
