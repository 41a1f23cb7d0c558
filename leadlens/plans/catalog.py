"""The query catalogue: one callable (spark, sf_dir) -> DataFrame per operator.

Every query reads the driver's tables (through the lead view) so its work
grows with them.  Doubles are rounded to 6 places at the output so two
engines agree on the value hash; 1-4 place display roundings stay available
as function parameters but are not applied here.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.features import add_features
from ..functions.scorecard import log_odds, response_propensity
from ..functions.common import sigmoid
from ..functions.bands import band_left, band_right
from ..operators import select as sel
from ..operators import scoring
from ..sources.leads import leads_view
from ..sources.tables import read_table
from ..session import cut_lineage

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


def r6(c):
    return F.round(c, 6)


# ---------------------------------------------------------------- step 1: view, validation, options
@register("leads_view")
def q_leads_view(spark, sf):
    return leads_view(spark, sf)


@register("validate_leads")
def q_validate_leads(spark, sf):
    v = sel.validate(leads_view(spark, sf, dirty=True))
    return v.select("lead_id", "is_valid", "reasons")


@register("options")
def q_options(spark, sf):
    return sel.option_lists(leads_view(spark, sf))


# ---------------------------------------------------------------- step 2: features, scorecard, bands, list
@register("features")
def q_features(spark, sf):
    return add_features(leads_view(spark, sf)).select("lead_id", *S.DERIVED_COLS) \
        .withColumn("score_engajamento", r6(F.col("score_engajamento")))


@register("scorecard")
def q_scorecard(spark, sf):
    lo = log_odds()
    return leads_view(spark, sf).select("lead_id", r6(lo).alias("log_odds"), r6(sigmoid(lo)).alias("score"))


@register("response_propensity")
def q_response_propensity(spark, sf):
    return leads_view(spark, sf).select("lead_id", r6(response_propensity()).alias("prob_resposta"))


@register("bands_right")
def q_bands_right(spark, sf):
    s = sigmoid(log_odds())
    return leads_view(spark, sf).select("lead_id", r6(s).alias("score"), band_right(s).alias("classificacao"))


@register("bands_left")
def q_bands_left(spark, sf):
    s = sigmoid(log_odds())
    return leads_view(spark, sf).select("lead_id", r6(s).alias("score"), band_left(s).alias("classificacao"))


@register("list_leads")
def q_list_leads(spark, sf):
    out = scoring.list_leads(scoring.scored_leads(spark, sf), canal="Indicação", curso=None,
                             score_min=0.1, score_max=1.0, score_digits=None)
    return out.withColumn("score", r6(F.col("score")))


@register("list_all")
def q_list_all(spark, sf):
    out = scoring.list_leads(scoring.scored_leads(spark, sf), canal=S.ALL_OPTION, curso="",
                             score_digits=None)
    return out.withColumn("score", r6(F.col("score")))


@register("lookup_batch")
def q_lookup_batch(spark, sf):
    # Request batch derived from the orders table: order k asks for lead 2k+1,
    # so about half the requested ids exist and half do not.
    req = read_table(spark, sf, "orders", ["o_orderkey"]).select((F.col("o_orderkey") * 2 + 1).alias("lead_id"))
    out = sel.lookup_ids(scoring.scored_leads(spark, sf), req)
    return out.select("lead_id", "found", "nome_ficticio", r6(F.col("score")).alias("score"), "classificacao")


def _lookup_table(spark, sf):
    """The scored leads as a table bucketed by id, written for the caller's queries."""
    import uuid
    from ..session import scratch_path
    from ..sources import lookup as L
    name = f"leads_by_id_{uuid.uuid4().hex[:12]}"
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    L.save_lookup(scoring.scored_leads(spark, sf), name, scratch_path(spark, "lookup"), buckets)
    return name


@register("lookup_bucketed")
def q_lookup_bucketed(spark, sf):
    """The requests of lookup_batch, joined with the table bucketed by id."""
    from ..sources import lookup as L
    req = read_table(spark, sf, "orders", ["o_orderkey"]).select((F.col("o_orderkey") * 2 + 1).alias("lead_id"))
    out = L.lookup(spark, _lookup_table(spark, sf), req)
    return out.select("lead_id", "found", "nome_ficticio", r6(F.col("score")).alias("score"), "classificacao")


@register("lookup_few")
def q_lookup_few(spark, sf):
    """The orders of the ten customers of the smallest keys that have any: few ids, read from their buckets."""
    from ..sources import lookup as L
    orders = read_table(spark, sf, "orders", ["o_orderkey", "o_custkey"])
    first = orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("k")).orderBy("o_custkey").limit(10)
    req = first.select(F.explode(F.array(F.col("k") + 1, -F.col("k") - 1)).alias("lead_id"))
    out = L.lookup(spark, _lookup_table(spark, sf), req)
    return out.select("lead_id", "found", "nome_ficticio", r6(F.col("score")).alias("score"), "classificacao")


# ---------------------------------------------------------------- step 4: evaluation of the scorecard score
from ..operators import metrics as M  # noqa: E402


def _scored(spark, sf):
    return scoring.scored_leads(spark, sf)


def _round_cols(df, cols):
    return df.withColumns({c: r6(F.col(c)) for c in cols})


@register("roc_auc")
def q_roc_auc(spark, sf):
    return _round_cols(M.roc_auc(_scored(spark, sf), key="log_odds"), ["auc"])


@register("avg_precision")
def q_avg_precision(spark, sf):
    return _round_cols(M.average_precision(_scored(spark, sf), key="log_odds"), ["avg_precision"])


@register("confusion")
def q_confusion(spark, sf):
    return M.confusion(_scored(spark, sf))


@register("confusion_at_0_2")
def q_confusion_02(spark, sf):
    return M.confusion(_scored(spark, sf), threshold=0.2)


@register("class_report")
def q_class_report(spark, sf):
    return _round_cols(M.class_report(_scored(spark, sf), threshold=0.2), ["precision", "recall", "f1"])


@register("roc_points")
def q_roc_points(spark, sf):
    return _round_cols(M.roc_points(_scored(spark, sf), key="log_odds"), ["threshold", "fpr", "tpr"])


@register("roc_points_all")
def q_roc_points_all(spark, sf):
    return _round_cols(M.roc_points(_scored(spark, sf), drop_intermediate=False, key="log_odds"), ["threshold", "fpr", "tpr"])


@register("pr_points")
def q_pr_points(spark, sf):
    return _round_cols(M.pr_points(_scored(spark, sf), key="log_odds"), ["threshold", "precision", "recall"])


@register("impact_sweep")
def q_impact_sweep(spark, sf):
    return _round_cols(M.impact_sweep(_scored(spark, sf)), ["taxa_conversao_grupo", "esforco_relativo"])


@register("density_by_class")
def q_density_by_class(spark, sf):
    return _round_cols(M.density_by_class(_scored(spark, sf), "score", bins=40), ["bin_lo", "bin_hi", "density"])


# ---------------------------------------------------------------- step 3a: exploratory profile (raw leads)
from ..operators import profile as P  # noqa: E402


def _leads(spark, sf):
    return leads_view(spark, sf)


@register("shape")
def q_shape(spark, sf):
    return P.shape(_leads(spark, sf))


@register("describe")
def q_describe(spark, sf):
    return _round_cols(P.describe(_leads(spark, sf)), ["mean", "std", "min", "p25", "p50", "p75", "max"])


@register("target_rate")
def q_target_rate(spark, sf):
    return _round_cols(P.target_summary(_leads(spark, sf)), ["rate", "imbalance", "response_rate"])


@register("null_profile")
def q_null_profile(spark, sf):
    return _round_cols(P.null_profile(_leads(spark, sf)), ["pct"])


@register("missing_effect")
def q_missing_effect(spark, sf):
    return _round_cols(P.missing_effect(_leads(spark, sf)), ["rate_with", "rate_without"])


def _conv(key, **kw):
    def fn(spark, sf):
        return _round_cols(P.conversion_by(_leads(spark, sf), key, **kw), ["rate", "rate_pct"])
    return fn


register("conv_channel")(_conv("canal_captacao"))
register("conv_course")(_conv("curso_interesse"))
register("conv_attempts")(_conv("n_tentativas", order="key"))
register("conv_age")(_conv("faixa_etaria", drop_null_keys=True))
register("conv_shift")(_conv("turno_preferencia", drop_null_keys=True))


@register("value_counts_target")
def q_vc_target(spark, sf):
    return _round_cols(P.value_counts(_leads(spark, sf), "converteu"), ["share"])


@register("value_counts_channel")
def q_vc_channel(spark, sf):
    return _round_cols(P.value_counts(_leads(spark, sf), "canal_captacao"), ["share"])


@register("days_bands")
def q_days_bands(spark, sf):
    return _round_cols(P.conversion_by_days_band(_leads(spark, sf)), ["rate_pct"])


@register("box_days")
def q_box_days(spark, sf):
    return _round_cols(P.box_stats(_leads(spark, sf), "dias_sem_contato"),
                       ["q1", "median", "q3", "whisker_lo", "whisker_hi"])


@register("box_income")
def q_box_income(spark, sf):
    return _round_cols(P.box_stats(_leads(spark, sf), "renda_estimada"),
                       ["q1", "median", "q3", "whisker_lo", "whisker_hi"])


@register("hist_days")
def q_hist_days(spark, sf):
    return _round_cols(M.density_by_class(_leads(spark, sf), "dias_sem_contato", bins=30), ["bin_lo", "bin_hi", "density"])


@register("hist_income")
def q_hist_income(spark, sf):
    return _round_cols(M.density_by_class(_leads(spark, sf), "renda_estimada", bins=40), ["bin_lo", "bin_hi", "density"])


@register("group_means")
def q_group_means(spark, sf):
    return _round_cols(P.group_means(_leads(spark, sf)), ["mean_converted", "mean_not_converted", "difference"])


@register("corr_matrix")
def q_corr_matrix(spark, sf):
    return _round_cols(P.corr_matrix(_leads(spark, sf)), ["corr"])


@register("corr_target")
def q_corr_target(spark, sf):
    return _round_cols(P.corr_with_target(_leads(spark, sf)), ["corr", "abs_corr"])


@register("crosstab_age")
def q_crosstab_age(spark, sf):
    return P.crosstab(_leads(spark, sf), "faixa_etaria")


@register("numeric_summary")
def q_numeric_summary(spark, sf):
    return _round_cols(P.numeric_summary(_leads(spark, sf)), ["mean", "median", "min", "max"])


# ---------------------------------------------------------------- step 3b: management view (scored leads)
from ..operators import management as J  # noqa: E402


@register("kpis")
def q_kpis(spark, sf):
    return _round_cols(J.kpis(_scored(spark, sf)), ["media_score", "pct_alto"])


@register("score_hist")
def q_score_hist(spark, sf):
    return _round_cols(J.score_histogram(_scored(spark, sf)), ["bin_lo"])


@register("by_channel")
def q_by_channel(spark, sf):
    return _round_cols(J.mean_score_by(_scored(spark, sf), "canal_captacao", ascending=True), ["score_medio"])


@register("by_course")
def q_by_course(spark, sf):
    return _round_cols(J.mean_score_by(_scored(spark, sf), "curso_interesse", ascending=False), ["score_medio"])


@register("class_counts")
def q_class_counts(spark, sf):
    return _round_cols(J.class_counts(_scored(spark, sf)), ["share"])


@register("focus_impact")
def q_focus_impact(spark, sf):
    return _round_cols(J.focus_impact(_scored(spark, sf)), ["pct_foco", "esforco_poupado", "score_medio_foco"])


@register("focus_impact_channel")
def q_focus_impact_channel(spark, sf):
    # management view filtered to one channel (filters pushed below the scoring)
    s = scoring.filter_leads(_scored(spark, sf), canal="Indicação")
    return _round_cols(J.focus_impact(s), ["pct_foco", "esforco_poupado", "score_medio_foco"])


@register("best_channel")
def q_best_channel(spark, sf):
    return _round_cols(J.best_by(_scored(spark, sf), "canal_captacao"), ["score_medio"])


@register("best_course")
def q_best_course(spark, sf):
    return _round_cols(J.best_by(_scored(spark, sf), "curso_interesse"), ["score_medio"])


@register("response_rate")
def q_response_rate(spark, sf):
    return _round_cols(J.response_rate(_scored(spark, sf)), ["pct_resposta"])


@register("selector_labels")
def q_selector_labels(spark, sf):
    return J.selector_options(_scored(spark, sf))


@register("display_table")
def q_display_table(spark, sf):
    return J.display_table(_scored(spark, sf))


# ---------------------------------------------------------------- step 5: split, class balance, preprocessing
from ..operators import split as SP  # noqa: E402
from ..operators.preprocess import Preprocessor  # noqa: E402


def _split(spark, sf):
    return SP.stratified_split(add_features(leads_view(spark, sf)))


def _train(spark, sf):
    return _split(spark, sf).where(F.col("split") == "train")


@register("strat_split")
def q_strat_split(spark, sf):
    return _split(spark, sf).select("lead_id", "converteu", "split")


@register("split_sizes")
def q_split_sizes(spark, sf):
    return _split(spark, sf).groupBy("split", "converteu").agg(F.count(F.lit(1)).alias("n"))


@register("class_weights")
def q_class_weights(spark, sf):
    sizes = SP.allocation(leads_view(spark, sf))   # the split's class sizes need no split
    return _round_cols(SP.balanced_weights(sizes), ["weight"])


@register("pos_ratio")
def q_pos_ratio(spark, sf):
    return _round_cols(SP.negative_positive_ratio(_train(spark, sf)), ["scale_pos_weight"])


@register("impute_median")
def q_impute_median(spark, sf):
    q = P.quantiles_long(_train(spark, sf), list(S.NUMERIC_COLS), [0.5])
    return q.select("column", r6(F.col("quantile")).alias("median"))


@register("standardise")
def q_standardise(spark, sf):
    tr = _train(spark, sf)
    med = {r["column"]: r["quantile"] for r in P.quantiles_long(tr, list(S.NUMERIC_COLS), [0.5]).collect()}
    xs = {c: F.coalesce(F.col(c).cast("double"), F.lit(med[c])) for c in S.NUMERIC_COLS}
    one = tr.agg(*[F.avg(x).alias(f"{c}__m") for c, x in xs.items()],
                 *[F.stddev_pop(x).alias(f"{c}__s") for c, x in xs.items()])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}__m").alias("mean"),
                              F.when(F.col(f"{c}__s") == 0, F.lit(1.0)).otherwise(F.col(f"{c}__s")).alias("std"))
                     for c in S.NUMERIC_COLS])
    return _round_cols(one.select(F.inline(rows)), ["mean", "std"])


@register("impute_mode")
def q_impute_mode(spark, sf):
    tr = _train(spark, sf)
    long = tr.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value"))
                                         for c in S.CATEGORICAL_COLS])))
    vc = long.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return vc.groupBy("column").agg(F.min_by("value", F.struct((-F.col("n")).alias("nn"), F.col("value"))).alias("mode"))


def _fitted(spark, sf):
    # the split is read by every fitting aggregation and by the transform:
    # materialise it once in the shared folder (reliable checkpoint)
    split = cut_lineage(_split(spark, sf))
    pp = Preprocessor().fit(split.where(F.col("split") == "train"))
    return pp, split


@register("one_hot")
def q_one_hot(spark, sf):
    pp, split = _fitted(spark, sf)
    out = pp.transform(split, keep=["lead_id"])
    return out.select("lead_id", *[c for c in out.columns if c.startswith("categoricas__")])


@register("transform")
def q_transform(spark, sf):
    pp, split = _fitted(spark, sf)
    out = pp.transform(split, keep=["lead_id"])
    return out.withColumns({c: r6(F.col(f"`{c}`")) for c in out.columns if c.startswith("numericas__")})


# ---------------------------------------------------------------- step 6: additive explanations (scorecard model)
from ..operators import explain as H  # noqa: E402
from ..functions.scorecard import scorecard_terms  # noqa: E402


def _explained(spark, sf):
    leads = leads_view(spark, sf)
    terms = scorecard_terms()
    means = H.background_means(H.background(leads, 100), terms)
    return leads, terms, means


@register("linear_shap_top3")
def q_linear_shap_top3(spark, sf):
    leads, terms, means = _explained(spark, sf)
    out = H.flatten_top(H.top_k(leads, terms, means, 3)).drop("shap_sum", "top_feature")
    return _round_cols(out, ["top1_impact", "top2_impact", "top3_impact"])


@register("shap_long")
def q_shap_long(spark, sf):
    leads, terms, means = _explained(spark, sf)
    return _round_cols(H.explain_long(leads, terms, means), ["impact"])


@register("shap_sum")
def q_shap_sum(spark, sf):
    leads, terms, means = _explained(spark, sf)
    return _round_cols(H.explain_wide(leads, terms, means).select("lead_id", "shap_sum"), ["shap_sum"])


@register("top_feature")
def q_top_feature(spark, sf):
    leads, terms, means = _explained(spark, sf)
    return H.explain_wide(leads, terms, means).select("lead_id", "top_feature")


@register("global_importance")
def q_global_importance(spark, sf):
    leads, terms, means = _explained(spark, sf)
    return _round_cols(H.global_importance(leads, terms, means), ["mean_abs_impact"])


# ---------------------------------------------------------------- step 8: messages
from ..operators import messages as MSG  # noqa: E402
from ..functions import text as TX  # noqa: E402


def _scored_explained(spark, sf):
    scored = _scored(spark, sf)
    terms = scorecard_terms()
    means = H.background_means(H.background(leads_view(spark, sf), 100), terms)
    return MSG.with_explanations(scored, terms, means)


@register("shap_text")
def q_shap_text(spark, sf):
    return _scored_explained(spark, sf).select("lead_id", "shap_text")


@register("prompt")
def q_prompt(spark, sf):
    return MSG.add_messages(_scored_explained(spark, sf)).select("lead_id", "prompt")


@register("fallback_script")
def q_fallback_script(spark, sf):
    return _scored(spark, sf).select("lead_id", TX.fallback_script().alias("script"),
                                     F.lit(TX.SOURCE_FALLBACK).alias("fonte"))


@register("script_table")
def q_script_table(spark, sf):
    req = read_table(spark, sf, "orders", ["o_orderkey"]).select((F.col("o_orderkey") * 2 + 1).alias("lead_id"))
    out = MSG.script_table(_scored(spark, sf), req, score_digits=None)
    return out.withColumn("score", r6(F.col("score")))


# ---------------------------------------------------------------- step 7: models, scoring, streaming (rows-only checks)
from . import training as TR  # noqa: E402


@register("train_compare")
def q_train_compare(spark, sf):
    tm = TR.train_all(spark, leads_view(spark, sf), TR.TrainConfig())
    return tm.comparison


@register("train_logistic")
def q_train_logistic(spark, sf):
    tm = TR.train_all(spark, leads_view(spark, sf), TR.TrainConfig(models=("LogisticRegression",)))
    return _round_cols(tm.comparison, ["auc_roc", "avg_precision"])


@register("score_all")
def q_score_all(spark, sf):
    leads = leads_view(spark, sf)
    tm = TR.train_all(spark, leads, TR.TrainConfig(models=("LogisticRegression",)))
    scored = TR.score_with(tm.preprocessor, tm.models[tm.best], tm.data)   # the split as it was written for training
    return scored.select("lead_id", "split", r6(F.col("score")).alias("score"), band_right(F.col("score")).alias("classificacao"))


@register("stream_score")
def q_stream_score(spark, sf):
    """Leads written as files, scored by a streaming query (available-now
    trigger) into a file sink, read back as a table."""
    from ..session import scratch_path
    from ..sources.io import write_table
    from ..streaming.score_stream import run_scoring_stream
    src, sink = scratch_path(spark, "stream-src"), scratch_path(spark, "stream-out")
    write_table(leads_view(spark, sf), src, fmt="parquet")
    qy = run_scoring_stream(spark, src, sink)
    qy.awaitTermination()
    out = spark.read.parquet(sink)
    return out.select("lead_id", r6(F.col("score")).alias("score"), "classificacao")


@register("kept_list")
def q_kept_list(spark, sf):
    """Three feeds with repeats and late corrections through the stateful stream: the list they leave."""
    from ..streaming import kept_list as kl
    kept = kl.run_feeds(spark, kl.event_feeds(leads_view(spark, sf)))
    return kept.leads().select("lead_id", "n_tentativas", "respondeu_contato", F.dayofmonth("event_time").alias("event_day"),
                               r6(F.col("score")).alias("score"), "classificacao")


@register("kept_cards")
def q_kept_cards(spark, sf):
    """The management cards after the same feeds, from the maintained sums only."""
    from ..streaming import kept_list as kl
    kept = kl.run_feeds(spark, kl.event_feeds(leads_view(spark, sf)))
    return _round_cols(kl.cards(kept.sums()), ["value"])


# ---------------------------------------------------------------- step 9: exact attribution of a non-additive score
from ..operators.permutation import exact_attribution  # noqa: E402


@register("permutation_shap")
def q_permutation_shap(spark, sf):
    """Scorecard probability (not additive in probability units): exact Shapley values over all
    32 coalitions against the first 100 leads."""
    leads = leads_view(spark, sf)
    out = exact_attribution(leads, scorecard_terms(), H.background(leads, 100), sigmoid, S.SCORECARD_INTERCEPT)
    return _round_cols(out, ["impact"])


from ..operators import trees as TT  # noqa: E402
from ..operators.boosting import BoostedTrees  # noqa: E402

# A small forest of fixed values over raw and derived lead columns; an unknown value goes right.
FIXED_FOREST = [
    ("dias_sem_contato", 7, ("n_tentativas", 3, ("is_indicacao", 0.5, 0.12, 0.3), 0.08),
     ("respondeu_contato", 0.5, 0.02, ("dias_sem_contato", 14, 0.11, 0.05))),
    ("is_indicacao", 0.5, ("respondeu_contato", 0.5, 0.03, ("n_tentativas", 1, 0.16, 0.09)),
     ("renda_estimada", 4000, 0.21, ("dias_sem_contato", 3, 0.33, 0.18))),
    ("renda_estimada", 2500, ("n_tentativas", 4, 0.1, 0.04), ("dias_sem_contato", 21, ("respondeu_contato", 0.5, 0.07, 0.19), 0.01)),
]
FOREST_FEATURES = ["dias_sem_contato", "n_tentativas", "respondeu_contato", "renda_estimada", "is_indicacao"]


@register("tree_shap_top3")
def q_tree_shap_top3(spark, sf):
    """Exact attribution of a forest's score against the first 100 leads: score, sum and the three largest impacts."""
    feat = add_features(leads_view(spark, sf))
    forest = TT.TreeEnsemble.of(FOREST_FEATURES, FIXED_FOREST, base=0.05)
    x = TT.features_of(forest)
    impacts = TT.tree_impacts(feat, forest, H.background(feat, 100), x, ["lead_id"])
    top = H.flatten_top(impacts.select(
        "lead_id", F.aggregate("impacts", F.lit(0.0), lambda a, v: a + v).alias("shap_sum"),
        TT.top_impacts(F.col("impacts"), forest.names).alias("top_features")))
    return _round_cols(top, ["shap_sum", "top1_impact", "top2_impact", "top3_impact"])


@register("tree_scores")
def q_tree_scores(spark, sf):
    feat = add_features(leads_view(spark, sf))
    forest = TT.TreeEnsemble.of(FOREST_FEATURES, FIXED_FOREST, base=0.05)
    return _round_cols(TT.score_trees(feat, forest, TT.features_of(forest), ["lead_id"]), ["score"])


# cuts of the boosted model of two rounds
BOOST_CUTS = {"dias_sem_contato": [3.0, 7.0, 14.0, 30.0], "n_tentativas": [0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0],
              "respondeu_contato": [0.0], "is_indicacao": [0.0]}


@register("boosted_two_rounds")
def q_boosted_two_rounds(spark, sf):
    """Two rounds of second-order boosting of depth 2 over fixed cuts; positives weigh negatives / positives."""
    feat = cut_lineage(add_features(leads_view(spark, sf)).select("lead_id", "converteu", *BOOST_CUTS))
    ratio = SP.negative_positive_ratio(feat).first()["scale_pos_weight"]
    x = F.array(*[F.col(c).cast("double") for c in BOOST_CUTS])
    rows = feat.select("lead_id", "converteu", x.alias("features"),
                       F.when(F.col("converteu") == 1, F.lit(float(ratio))).otherwise(1.0).alias("pos_weight"))
    model = BoostedTrees(rounds=2, rate=0.3, depth=2, cuts=list(BOOST_CUTS.values()), names=list(BOOST_CUTS)).fit(rows)
    s = TT.score_trees(rows, model, F.col("features"), ["lead_id"])
    return s.select("lead_id", r6(F.col("score")).alias("score"), band_right(F.col("score")).alias("classificacao"))


# ---------------------------------------------------------------- step 8b: scoring new leads, explained list
@register("score_new_leads")
def q_score_new_leads(spark, sf):
    """The faulty lead payloads (validation fixture) scored set-based, with
    explanations against the first 100 leads of the clean table."""
    terms = scorecard_terms()
    means = H.background_means(H.background(leads_view(spark, sf), 100), terms)
    out = scoring.score_leads(leads_view(spark, sf, dirty=True), terms, means, score_digits=None)
    out = H.flatten_top(out.select("lead_id", "is_valid", "reasons", r6(F.col("score")).alias("score"),
                                   "classificacao", "top_features"))
    return _round_cols(out, ["top1_impact", "top2_impact", "top3_impact"])


@register("list_explained")
def q_list_explained(spark, sf):
    out = scoring.list_leads_explained(_scored_explained(spark, sf), canal="Indicação", score_min=0.1,
                                       score_digits=None)
    out = H.flatten_top(out).withColumn("score", r6(F.col("score")))
    return _round_cols(out, ["top1_impact", "top2_impact", "top3_impact"])


@register("default_score")
def q_default_score(spark, sf):
    """Explicit degraded scoring (every lead 0.5 / Médio), only when asked for."""
    return scoring.default_score(leads_view(spark, sf)).select("lead_id", "score", "classificacao")


@register("row_fallback")
def q_row_fallback(spark, sf):
    """The faulty leads, some with missing values and some with attempts beyond what the rule can square."""
    huge = F.when(F.col("lead_id") % 101 == 0, F.lit(2_000_000_000)).otherwise(F.col("n_tentativas"))
    lost = F.when(F.col("lead_id") % 103 != 0, F.col("dias_sem_contato"))
    leads = leads_view(spark, sf, dirty=True).withColumns({"n_tentativas": huge, "dias_sem_contato": lost})
    out = scoring.score_or_default(leads)
    return out.select("lead_id", "status", "error", r6(F.col("score")).alias("score"), "classificacao")


@register("payload_lines")
def q_payload_lines(spark, sf):
    """Leads as JSON lines, some cut short, blank, of a wrong type or with an unknown field: each scored or rejected."""
    from ..sources import payloads
    k = F.col("lead_id")
    line = F.to_json(F.struct(*payloads.FIELDS))
    cut = F.substring(line, F.lit(1), F.length(line) - 9)
    text = F.regexp_replace(line, '"dias_sem_contato":[0-9]+', '"dias_sem_contato":"soon"')
    more = F.concat(F.lit('{"utm":"x",'), F.substring(line, F.lit(2), F.length(line)))
    broken = F.when(k % 97 == 0, cut).when(k % 79 == 0, F.lit(" ")).when(k % 89 == 0, text).when(k % 83 == 0, more).otherwise(line)
    lines = leads_view(spark, sf).select("lead_id", broken.alias("value"))
    good, bad = payloads.divided(lines)
    s = sigmoid(log_odds())
    scored = good.select("lead_id", F.lit(1).alias("is_valid"), "reasons", "rescued", r6(s).alias("score"), band_left(s).alias("classificacao"))
    return scored.unionByName(bad.select("lead_id", F.lit(0).alias("is_valid"), "reasons"), allowMissingColumns=True)


@register("preview")
def q_preview(spark, sf):
    return P.preview(leads_view(spark, sf), 5)


@register("box_stats")
def q_box_stats(spark, sf):
    """Box statistics by class for days and income in one long table."""
    leads = _leads(spark, sf)
    parts = [P.box_stats(leads, c).withColumn("column", F.lit(c)) for c in ("dias_sem_contato", "renda_estimada")]
    return _round_cols(parts[0].unionByName(parts[1]), ["q1", "median", "q3", "whisker_lo", "whisker_hi"])


@register("hist_class")
def q_hist_class(spark, sf):
    """Class density histograms: days (30 bins) and income (40 bins)."""
    leads = _leads(spark, sf)
    hs = P.class_histograms(leads)
    out = None
    for c, h in hs.items():
        h = h.withColumn("column", F.lit(c))
        out = h if out is None else out.unionByName(h)
    return _round_cols(out, ["bin_lo", "bin_hi", "density"])


# ---------------------------------------------------------------- step 10: values taken away from the lead view
def _scored_nulls(spark, sf):
    return scoring.score_with_scorecard(add_features(leads_view(spark, sf, nulls=True)))


@register("list_all_nulls")
def q_list_all_nulls(spark, sf):
    """The whole list: leads that cannot be scored stay, at the end, without score and class."""
    return scoring.list_leads(_scored_nulls(spark, sf), score_digits=None).withColumn("score", r6(F.col("score")))


@register("by_channel_nulls")
def q_by_channel_nulls(spark, sf):
    return _round_cols(J.mean_score_by(_scored_nulls(spark, sf), "canal_captacao"), ["score_medio"])


@register("best_channel_nulls")
def q_best_channel_nulls(spark, sf):
    return _round_cols(J.best_by(_scored_nulls(spark, sf), "canal_captacao"), ["score_medio"])


@register("response_rate_nulls")
def q_response_rate_nulls(spark, sf):
    return _round_cols(J.response_rate(_scored_nulls(spark, sf)), ["pct_resposta"])


@register("conv_channel_nulls")
def q_conv_channel_nulls(spark, sf):
    return _round_cols(P.conversion_by(leads_view(spark, sf, nulls=True), "canal_captacao"), ["rate", "rate_pct"])


@register("conv_attempts_nulls")
def q_conv_attempts_nulls(spark, sf):
    return _round_cols(P.conversion_by(leads_view(spark, sf, nulls=True), "n_tentativas", order="key"), ["rate", "rate_pct"])


@register("bands_left_nulls")
def q_bands_left_nulls(spark, sf):
    return _scored_nulls(spark, sf).select("lead_id", r6(F.col("score")).alias("score"), band_left(F.col("score")).alias("classificacao"))


@register("linear_shap_top3_nulls")
def q_linear_shap_top3_nulls(spark, sf):
    leads, terms = leads_view(spark, sf, nulls=True), scorecard_terms()
    means = H.background_means(H.background(leads, 100), terms)
    out = H.flatten_top(H.top_k(leads, terms, means, 3)).drop("shap_sum", "top_feature")
    return _round_cols(out, ["top1_impact", "top2_impact", "top3_impact"])


# ---------------------------------------------------------------- step 11: a linear model of fixed coefficients over the slots
class FixedLinear:
    """Stands in for a fitted logistic model, so that scoring and explanation have an SQL twin."""

    def __init__(self, slots: int):
        self.coefficients = np.array([(i * 7 % 11 - 5) / 10 for i in range(slots)])
        self.intercept = -1.0

    def terms(self, pp: Preprocessor) -> dict:
        return H.linear_terms(dict(zip(pp.slot_names(), self.coefficients.tolist())))


def _fixed(spark, sf):
    pp, split = _fitted(spark, sf)
    x = pp.transform(split, keep=["lead_id", "converteu", "split", "dias_sem_contato"])
    model = FixedLinear(len(pp.slot_names()))
    z = F.lit(model.intercept)
    for t in model.terms(pp).values():
        z = z + t
    return cut_lineage(x.withColumn("z", z)), model.terms(pp)   # read twice: the background, then all rows


@register("fixed_model_score")
def q_fixed_model_score(spark, sf):
    x, _ = _fixed(spark, sf)
    s = sigmoid(F.col("z"))
    return x.select("lead_id", "split", r6(s).alias("score"), band_right(s).alias("classificacao"))


@register("fixed_model_shap_top3")
def q_fixed_model_shap_top3(spark, sf):
    """Attributions over the 32 slots: coefficient x (slot - background mean), the three largest."""
    x, terms = _fixed(spark, sf)
    means = H.background_means(H.background(x, 100), terms)
    out = H.flatten_top(H.top_k(x, terms, means, 3)).drop("shap_sum", "top_feature")
    return _round_cols(out, ["top1_impact", "top2_impact", "top3_impact"])


@register("model_comparison")
def q_model_comparison(spark, sf):
    """AUC and average precision of three fixed predictors on the test rows, the best one marked."""
    x, _ = _fixed(spark, sf)
    leads = leads_view(spark, sf).select(F.col("lead_id"), log_odds().alias("scorecard"))
    test = cut_lineage(x.where("split = 'test'").join(leads, "lead_id").select(
        "converteu", "scorecard", F.round("z", 9).alias("fixed_linear"), (-F.col("dias_sem_contato")).cast("double").alias("recency")))
    return _round_cols(TR.comparison(test, ["scorecard", "fixed_linear", "recency"]), ["auc_roc", "avg_precision"])
