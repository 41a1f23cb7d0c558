"""Training plan: features -> exact stratified split -> preprocessing fitted
on training rows -> three class-balanced classifiers, fitted at the same time -> evaluation
on the test rows -> selection by AUC-ROC -> persistence.

The logistic regression is fitted by Newton steps, the boosted trees by second-order boosting
and the forest without a depth limit (operators ``logistic``, ``boosting``, ``forest``); a forest
of bounded depth is Spark ML's.  The logistic
model scores as a native expression (sigmoid of a sum of products over the slot columns), so
batch and stream scoring stay inside whole-stage codegen; boosted trees score in Arrow batches.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import partial

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.common import sigmoid
from ..functions.features import add_features
from ..operators import explain as H
from ..operators import metrics as M
from ..operators.boosting import BoostedTrees
from ..operators.forest import DeepForest
from ..operators.logistic import LogisticModel, NewtonLogistic
from ..operators.moments import tasks
from ..operators.preprocess import Preprocessor
from ..operators.split import allocation, stratified_split, weight_column
from ..operators.trees import StoredTrees, TreeEnsemble, score_trees
from ..session import cut_lineage, shared_dir
from .at_once import run_at_once

MODEL_NAMES = ("LogisticRegression", "RandomForest", "GBT")


@dataclass
class TrainConfig:
    test_size: float = 0.2
    seed: int = 42
    lr_max_iter: int = 1000
    lr_c: float = 1.0             # inverse regularisation strength (L2)
    rf_trees: int = 200
    rf_max_depth: int | None = None   # None: no limit, as in the source; a number gives Spark ML's forest
    gbt_iter: int = 200
    gbt_step: float = 0.1
    gbt_depth: int = 5
    models: tuple = MODEL_NAMES
    threshold: float = 0.6        # decision threshold stored in the metadata
    at_once: bool = True          # fit the models at the same time, or one after the other


@dataclass
class TrainedModels:
    preprocessor: Preprocessor
    models: dict                       # name -> fitted model
    comparison: DataFrame              # model, auc_roc, avg_precision, best
    best: str
    metadata: dict = field(default_factory=dict)
    reports: dict = field(default_factory=dict)      # name -> class report on the test rows
    pr_curves: dict = field(default_factory=dict)    # name -> precision-recall points on the test rows
    data: DataFrame | None = None                    # leads with features and split, in the shared folder


def comparison(scored: DataFrame, models: list[str], label: str = S.LABEL_COL) -> DataFrame:
    """model, auc_roc, avg_precision and best of score columns of one table (ties: first name)."""
    rows = []
    for m in models:
        r = M.auc_ap(scored, m, label).first()
        rows.append((m, r["auc"], r["avg_precision"]))
    best = min(rows, key=lambda r: (-(r[1] if r[1] is not None else -1.0), r[0]))[0]
    return scored.sparkSession.createDataFrame([(n, a, p, n == best) for n, a, p in rows],
                                               "model string, auc_roc double, avg_precision double, best boolean")


def prepared(df_leads: DataFrame, cfg: TrainConfig) -> DataFrame:
    return stratified_split(add_features(df_leads), test_size=cfg.test_size, seed=cfg.seed)


def estimators(cfg: TrainConfig, slots: list[str]) -> dict:
    est = {}
    if "LogisticRegression" in cfg.models:
        est["LogisticRegression"] = NewtonLogistic(label=S.LABEL_COL, c=cfg.lr_c, max_iter=cfg.lr_max_iter)
    if "RandomForest" in cfg.models and cfg.rf_max_depth is None:
        est["RandomForest"] = DeepForest(trees=cfg.rf_trees, seed=cfg.seed, label=S.LABEL_COL, key=S.ID_COL, names=slots,
                                         spare=int(cfg.at_once and len(cfg.models) > 1))
    elif "RandomForest" in cfg.models:
        est["RandomForest"] = RandomForestClassifier(
            featuresCol="features", labelCol=S.LABEL_COL, weightCol="weight", numTrees=cfg.rf_trees,
            maxDepth=cfg.rf_max_depth, seed=cfg.seed, maxMemoryInMB=1024,   # more nodes a pass, fewer passes
            cacheNodeIds=True, checkpointInterval=10)
    if "GBT" in cfg.models:
        est["GBT"] = BoostedTrees(rounds=cfg.gbt_iter, rate=cfg.gbt_step, depth=cfg.gbt_depth, label=S.LABEL_COL, names=slots)
    return est


def n_sum(sizes: dict, name: str) -> int:
    return sum(r[name] for r in sizes.values())


def positive_probability(col: str = "probability") -> Column:
    return vector_to_array(F.col(col)).getItem(1)


def probabilities(model, x: DataFrame, keep: list[str], features: str = "features") -> DataFrame:
    """``keep`` and the positive-class probability ``score`` by any fitted model over a vector column."""
    if isinstance(model, LogisticModel):
        return x.select(*keep, vector_to_array(features).alias("_x")).select(
            *keep, sigmoid(model.margin(F.col("_x"))).alias("score"))
    if isinstance(model, (TreeEnsemble, StoredTrees)):
        return score_trees(x, model, vector_to_array(features), keep)
    return model.transform(x).select(*keep, positive_probability().alias("score"))


def train_all(spark: SparkSession, leads: DataFrame, cfg: TrainConfig | None = None) -> TrainedModels:
    cfg = cfg or TrainConfig()
    shared_dir(spark)  # iterative learners checkpoint into the shared folder
    # the split feeds the preprocessing fit (several aggregations) and the
    # transform: materialise it once in the shared folder (reliable checkpoint;
    # survives executor loss and cuts the join + ranking lineage)
    data = cut_lineage(prepared(leads, cfg))
    train = data.where(F.col("split") == "train")
    pp = Preprocessor().fit(train)
    sizes = {r[S.LABEL_COL]: r for r in allocation(data, test_size=cfg.test_size).collect()}   # one row per class
    counts = {c: r["n_train"] for c, r in sizes.items() if r["n_train"]}
    n_train, n_test = n_sum(sizes, "n_train"), n_sum(sizes, "n_test")
    n_all, k = sum(counts.values()), len(counts)
    weights = {c: n_all / (k * n) for c, n in counts.items()}
    spw = counts.get(0, 0) / counts.get(1, 1)
    x = pp.transform(data, keep=[S.ID_COL, S.LABEL_COL, "split"], vector_col="features")
    x = weight_column(x, weights, name="weight")
    x = x.withColumn("pos_weight", F.when(F.col(S.LABEL_COL) == 1, F.lit(float(spw))).otherwise(F.lit(1.0)))
    x = x.select(S.ID_COL, S.LABEL_COL, "split", "features", "weight", "pos_weight")
    slots = spark.sparkContext.defaultParallelism
    if tasks(data) < slots:   # few files or small partitions put together: the fits would leave slots idle
        x = x.repartition(slots)
    x = x.persist()
    try:
        tr, te = x.where(F.col("split") == "train"), x.where(F.col("split") == "test")

        def job(est):
            model = est.fit(tr)
            pred = cut_lineage(probabilities(model, te, [S.LABEL_COL]))
            table = cut_lineage(M.curve(pred))
            m = M.auc_ap(pred, table=table).collect()[0]
            return model, m["auc"], m["avg_precision"], M.class_report(pred), M.pr_points(pred, table=table)

        jobs = {name: partial(job, est) for name, est in estimators(cfg, pp.slot_names()).items()}
        x.count()   # held before the fits start, so that none computes it beside another
        results = run_at_once(spark, jobs) if cfg.at_once else {name: fit() for name, fit in jobs.items()}
        fitted = {n: r[0] for n, r in results.items()}
        rows = [(n, r[1], r[2]) for n, r in results.items()]
        reports, curves = {n: r[3] for n, r in results.items()}, {n: r[4] for n, r in results.items()}
        best = max(rows, key=lambda r: (r[1] if r[1] is not None else -1.0))[0]
        comp = spark.createDataFrame([(n, a, p, n == best) for n, a, p in rows],
                                     "model string, auc_roc double, avg_precision double, best boolean")
        best_row = [r for r in rows if r[0] == best][0]
        meta = {
            "melhor_modelo": best, "auc_roc": best_row[1], "avg_precision": best_row[2],
            "feature_names": list(S.MODEL_INPUT_COLS), "transformed_feature_names": pp.slot_names(),
            "n_features": len(S.MODEL_INPUT_COLS), "n_treino": n_train, "n_teste": n_test,
            "data_treinamento": datetime.now(timezone.utc).isoformat(), "threshold": cfg.threshold,
            "comparacao_modelos": {n: {"auc_roc": a, "avg_precision": p} for n, a, p in rows},
        }
        return TrainedModels(pp, fitted, comp, best, meta, reports, curves, data)
    finally:
        x.unpersist()


def metadata_frame(spark: SparkSession, meta: dict) -> DataFrame:
    """The training metadata as a one-row DataFrame (nested fields as JSON text)."""
    flat = {k: (json.dumps(v, ensure_ascii=False) if isinstance(v, (dict, list)) else v) for k, v in meta.items()}
    return spark.createDataFrame([flat])


def linear_score_expr(pp: Preprocessor, model) -> Column:
    """Positive-class probability of a fitted logistic model as a native
    expression over the raw lead columns (no vector, no UDF)."""
    coefs = list(model.coefficients.toArray())
    z = F.lit(float(model.intercept))
    for c, b in zip(pp.slot_columns(), coefs):
        z = z + F.lit(float(b)) * c
    return sigmoid(z)


def score_with(pp: Preprocessor, model, df: DataFrame, score_col: str = "score") -> DataFrame:
    """Score raw leads (features are derived here) with any fitted model."""
    feat = add_features(df)
    if H.choose_method(model) == "linear":
        return feat.withColumn(score_col, linear_score_expr(pp, model))
    x = pp.transform(feat, keep=feat.columns, vector_col="_features")
    if isinstance(model, (TreeEnsemble, StoredTrees)):
        return score_trees(x, model, vector_to_array("_features"), feat.columns, score_col)
    out = model.setFeaturesCol("_features").setProbabilityCol("_prob").setRawPredictionCol("_raw") \
               .setPredictionCol("_pred").transform(x)
    return out.withColumn(score_col, vector_to_array(F.col("_prob")).getItem(1)).drop("_features", "_prob", "_raw", "_pred")
