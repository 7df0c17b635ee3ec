"""Model queries. Trained scores are checked by rows only; everything computable is checked by value."""

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from verdigris.constants import RING_GRID
from verdigris.operators import evaluation as M
from verdigris.operators import models as L
from verdigris.operators import rings as K
from verdigris.operators import splits as P
from verdigris.operators import tree_contributions as C
from verdigris.operators.neighborhood import fit_neighborhood, hop_layers, predict
from verdigris.operators.tuning import draw_points, successive_halving
from verdigris.plans.catalog.base_queries import behavior, rounded
from verdigris.plans.catalog.case_queries import contributors
from verdigris.plans.catalog.graph_queries import edges, stored_features
from verdigris.plans.catalog.model_queries import groups, members, split
from verdigris.plans.catalog.prelude import PRELUDE
from verdigris.plans.catalog.registry import query
from verdigris.plans.catalog.whole_queries import whole_matrix
from verdigris.session import materialize, scratch_path

TREES = {"maxIter": 40, "maxDepth": 5}
RING_TREES = {"maxIter": 40, "maxDepth": 5, "stepSize": 0.05, "subsamplingRate": 0.9, "featureSubsetStrategy": "0.9"}
POINTS, RUNGS = 50, 6  # 50, 25, 13, 7, 4 and 2 points; the last two with all the trees they ask for
FIT_PARTS, PART_ROWS = 8, 250_000  # partitions of the rows that a fit reads: eight, and more once these are full
SMALL = [
    "total_orders", "avg_order_value", "return_rate", "refund_rate", "dispute_rate", "coupon_usage_rate",
    "discount_dependency_score", "account_age_days", "avg_order_gap_days", "distinct_devices",
    "shared_device_count", "shared_address_count", "accounts_per_phone", "orders_last_24h",
]


def labelled(d):
    """The whole graph matrix, which holds the feature matrix, with label and split; stored once."""
    if not hasattr(d, "_labelled"):
        t = d.truth.select("account_id", F.col("true_ring_member").cast("double").alias("label"))
        rows = whole_matrix(d).join(t, "account_id").join(split(d), "account_id")
        d._labelled = materialize(rows, "labelled")
    return d._labelled


def tabular(d):
    """Every numeric column of the feature matrix."""
    return P.input_columns(stored_features(d))


def graph(d):
    """Every numeric column of the graph matrix."""
    return P.input_columns(whole_matrix(d))


def fit_parts(rows):
    """All ``rows`` in few partitions: a fit's turns cost more for many small ones."""
    return rows.coalesce(max(FIT_PARTS, -(-rows.count() // PART_ROWS)))


def fitted(d, columns, attr):
    """Model and columns; fitted on train until the validation loss stops falling."""
    if not hasattr(d, attr):
        rows = labelled(d)
        keep = P.usable_columns(rows.select("account_id", *columns), rows.select("account_id", "split"))
        known = materialize(fit_parts(rows.filter("split <> 'test'").select("account_id", "split", "label", *keep)), "fit-rows")
        setattr(d, attr, (L.fit_stopped(known, keep, **TREES), keep))
    return getattr(d, attr)


def model_a(d):
    return fitted(d, tabular(d), "_model_a")


def model_b(d):
    return fitted(d, graph(d), "_model_b")


@query("l1_account_models")
def l1(d):
    """Tabular model A and graph model B on every numeric column that varies in train."""
    rows = labelled(d)
    (a, cols_a), (b, cols_b) = model_a(d), model_b(d)
    out = L.score(b, L.score(a, rows, cols_a, "proba_A"), cols_b, "proba_B")
    return out.select("account_id", "split", F.col("label").cast("int").alias("true_label"), "proba_A", "proba_B")


@query("l1b_model_report")
def l1b(d):
    """Trees, columns and validation ranking of models A and B and of one on fourteen columns."""
    held = labelled(d).filter("split = 'val'")
    reports = [L.fit_report(*args) for args in (
        (model_a(d)[0], held, model_a(d)[1], "A"), (model_b(d)[0], held, model_b(d)[1], "B"),
        (fitted(d, SMALL, "_model_small")[0], held, fitted(d, SMALL, "_model_small")[1], "small"),
    )]
    return reports[0].unionByName(reports[1]).unionByName(reports[2])


@query("l2_tuning")
def l2(d):
    """Successive halving over a seeded draw, five grouped folds; every fit's score."""
    keep = model_a(d)[1]
    train = labelled(d).filter("split = 'train'").join(P.group_folds(d.truth), "account_id")
    train = materialize(fit_parts(train.select("account_id", "label", "fold", *keep)), "folds")
    return successive_halving(train, keep, draw_points(POINTS), rungs=RUNGS)


HOP_COLUMNS = ["return_rate", "total_orders", "coupon_usage_rate"]
_HOPS = [f"h{h}_{c}" for h in (1, 2) for c in HOP_COLUMNS]
PRELUDE["hop_links"] = "SELECT src, dst FROM sym UNION ALL SELECT account_id, account_id FROM fx_accounts"
PRELUDE["hop1"] = f"SELECT src AS account_id, {', '.join(f'avg({c}) AS {c}' for c in HOP_COLUMNS)} FROM hop_links JOIN behavior ON account_id = dst GROUP BY 1"
PRELUDE["hop2"] = f"SELECT src AS account_id, {', '.join(f'avg({c}) AS {c}' for c in HOP_COLUMNS)} FROM hop_links JOIN hop1 ON account_id = dst GROUP BY 1"


@query("l3_neighbor_means", f"""
SELECT a.account_id, {', '.join(f'round(a.{c}, 9) AS h1_{c}' for c in HOP_COLUMNS)}, {', '.join(f'round(b.{c}, 9) AS h2_{c}' for c in HOP_COLUMNS)} FROM hop1 a JOIN hop2 b USING (account_id)""")
def l3(d):
    base = behavior(d).select("account_id", *HOP_COLUMNS)
    return rounded(L.neighbor_means(materialize(base, "base"), edges(d), HOP_COLUMNS).select("account_id", *_HOPS), _HOPS)


def neighborhood(d):
    """The fitted neighborhood model on every numeric column, and its stored hop layers."""
    if not hasattr(d, "_neighborhood"):
        rows, keep = labelled(d), model_b(d)[1]
        wide = hop_layers(rows.select("account_id", "split", "label", *keep), edges(d), keep, rows.filter("split = 'train'"))
        d._neighborhood = (fit_neighborhood(fit_parts(wide), keep), wide)
    return d._neighborhood


@query("l3b_neighborhood_model")
def l3b(d):
    model, wide = neighborhood(d)
    return predict(model, wide).select("account_id", "split", "proba_neighborhood")


@query("l3d_neighborhood_report")
def l3d(d):
    """Looks at the held rows during the fit."""
    model, _ = neighborhood(d)
    rows = [(e, float(loss), float(ap), len(model.columns)) for e, loss, ap in model.history]
    return d.spark.createDataFrame(rows, "epoch INT, loss DOUBLE, pr_auc DOUBLE, columns INT")


@query("l3c_standardize", """
SELECT account_id, round((total_orders - m) / s, 9) AS total_orders FROM behavior,
  (SELECT avg(total_orders) AS m, stddev_pop(total_orders) AS s FROM behavior JOIN split USING (account_id) WHERE split = 'train')""")
def l3c(d):
    rows = materialize(behavior(d).select("account_id", "total_orders").join(split(d), "account_id"), "rows")
    out = L.standardize(rows, ["total_orders"], rows.filter("split = 'train'"))
    return rounded(out.select("account_id", "total_orders"), ["total_orders"])


PRELUDE["ens"] = "SELECT account_id, true_label, (proba_A + proba_B) / 2 AS proba_ensemble FROM fx_scores"


@query("l4_ensemble", """
WITH cut AS (SELECT arg_min(thr, cost * 1000 + i) AS thr FROM (SELECT i, thr, sum(CASE WHEN proba_ensemble >= thr AND true_label = 0 THEN 2000 WHEN proba_ensemble < thr AND true_label = 1 THEN 15000 ELSE 0 END) AS cost
  FROM ens JOIN split USING (account_id) JOIN (SELECT i, 0.01::DOUBLE + i::DOUBLE * 0.98::DOUBLE / 198::DOUBLE AS thr FROM range(199) t(i)) ON true WHERE split = 'val' GROUP BY 1, 2))
SELECT account_id, round(proba_ensemble, 9) AS proba_ensemble, CAST(proba_ensemble >= (SELECT thr FROM cut) AS INTEGER) AS pred_ensemble FROM ens""")
def l4(d):
    both = L.ensemble(d.scores, d.scores, "proba_A", "proba_B").join(d.scores.select("account_id", "true_label"), "account_id")
    val = both.join(split(d).filter("split = 'val'"), "account_id")
    rows = val.select(F.lit("ensemble").alias("model"), F.col("true_label").alias("label"), F.col("proba_ensemble").alias("score"))
    threshold = M.best_threshold(rows, ["model"]).first()["threshold"]
    out = both.withColumn("pred_ensemble", (F.col("proba_ensemble") >= threshold).cast("int"))
    return rounded(out.select("account_id", "proba_ensemble", "pred_ensemble"), ["proba_ensemble"])


@query("l5_feature_importance")
def l5(d):
    model, cols = model_b(d)
    return L.feature_importance(model, cols, d.spark)


@query("l6_batch_scoring")
def l6(d):
    model, cols = model_a(d)
    path = scratch_path(d.spark, "model")
    model.write().save(path)
    return L.score(PipelineModel.load(path), labelled(d), cols).select("account_id", "proba")


def contributions(d):
    """What every input adds to model A's score of every account; stored once."""
    if not hasattr(d, "_tree_values"):
        model, cols = model_a(d)
        d._tree_values = materialize(C.tree_contributions(model, labelled(d), cols), "contributions")
    return d._tree_values


def strongest(d):
    """The five largest contributions of each account."""
    return C.strongest(C.by_feature(contributions(d), model_a(d)[1]))


@query("l7_population_ablation")
def l7(d):
    """Test scores with each of the ten features of largest mean contribution at its median."""
    model, cols = model_a(d)
    test = labelled(d).filter("split = 'test'")
    values = C.by_feature(contributions(d).join(test.select("account_id"), "account_id", "left_semi"), cols)
    sizes = C.mean_sizes(values, test.count())
    top = [r["feature"] for r in sizes.orderBy(F.desc("mean_abs"), "feature").limit(10).collect()]
    scored = materialize(L.ablate(model, test, cols, top, L.medians(test, top), ["account_id", "label"]), "ablated")
    long = scored.select(F.col("feature").alias("model"), F.col("label").cast("int").alias("label"), F.col("proba").alias("score"))
    metrics = M.auc_metrics(long, ["model"]).withColumnRenamed("model", "feature")
    return L.population_ablation(scored).join(metrics.drop("positives", "negatives"), "feature").join(sizes, "feature")


@query("l8_account_ablation")
def l8(d):
    """Scores of each account with each of its five strongest inputs at the median."""
    model, cols = model_a(d)
    wanted = strongest(d).select("account_id", "feature")
    names = [r["feature"] for r in wanted.select("feature").distinct().collect()]  # at most the model's columns
    rows = labelled(d)
    scored = materialize(L.ablate_wanted(model, rows, cols, wanted, L.medians(rows, names) if names else {}), "ablated")
    return L.account_ablation(scored, wanted)


@query("l9b_tree_contributors")
def l9b(d):
    """The five inputs that move each account's fitted score most."""
    return strongest(d).select("account_id", "feature", "value", "place", "direction")


@query("l9_top_contributors", "SELECT account_id, feature, value, CAST(place AS INTEGER) AS place, direction FROM contrib")
def l9(d):
    return contributors(d).select("account_id", "feature", "value", "place", "direction")


@query("k8_ring_model")
def k8(d):
    m = members(d)
    table = K.candidate_table(m, d.scores, "proba_A", edges(d), d.communities, behavior(d))
    labels = K.candidate_labels(m, K.positive_rings(m, d.truth)).select("candidate_id", F.col("is_abuse_ring").cast("double").alias("label"))
    sp = P.candidate_split(materialize(groups(d), "groups")).select("candidate_id", "split")
    rows = materialize(table.join(labels, "candidate_id").join(sp, "candidate_id"), "candidates")
    cols = [c for c in table.columns if c != "candidate_id"]
    model = L.fit_stopped(materialize(fit_parts(rows.filter("split <> 'test'")), "fit-rows"), cols, **RING_TREES)
    scored = materialize(L.score(model, rows, cols, "ring_proba"), "ring-scores")
    val = scored.filter("split = 'val'").select(F.lit("ring").alias("model"), F.col("label").cast("int").alias("label"), F.col("ring_proba").alias("score"))
    best = M.best_threshold(val, ["model"], RING_GRID).first()
    cut = best["threshold"] if best else 0.5
    return scored.select("candidate_id", "split", "label", "ring_proba", (F.col("ring_proba") >= cut).cast("int").alias("ring_pred"))
