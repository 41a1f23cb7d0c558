"""The lead service as DataFrame methods (no server).

``LeadService.start`` does what a service start-up does: load the fitted
preprocessor and model, read the leads, score every lead once, write the scored
table to the shared folder and read it back.  Linear models are explained by their
terms, tree ensembles exactly over the slots (``trees``), any other model by
``permutation_attribution`` over the raw inputs.  The request
handlers become set-based methods: ``list_leads`` (filters + ranking),
``score`` (a DataFrame of new payloads -> score, class, top-3 explanation),
``scripts`` (a DataFrame of requested ids -> message per id, unknown ids
flagged).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.bands import band
from ..functions.features import add_features
from ..operators import explain as H
from ..operators import messages as MSG
from ..operators import scoring
from ..operators.permutation import permutation_attribution
from ..operators.preprocess import Preprocessor
from ..operators.trees import StoredTrees, TreeEnsemble, from_spark_model, top_impacts, tree_impacts
from ..session import cut_lineage
from .training import linear_score_expr, score_with


@dataclass
class LeadService:
    spark: SparkSession
    preprocessor: Preprocessor
    model: object
    scored: DataFrame
    terms: dict
    means: dict
    background: DataFrame
    metadata: dict
    trees: TreeEnsemble | StoredTrees | None = None     # the node table of a tree ensemble

    @classmethod
    def start(cls, spark: SparkSession, leads: DataFrame, preprocessor: Preprocessor, model,
              metadata: dict | None = None, background_rows: int = 100) -> "LeadService":
        scored = score_with(preprocessor, model, leads).withColumn("classificacao", band("score", "right"))
        terms = cls._terms(preprocessor, model)
        background = cut_lineage(H.background(leads, background_rows))
        means = H.background_means(add_features(background), terms) if terms else {}
        if terms:
            scored = MSG.with_explanations(scored, terms, means)
        trees = None
        if H.choose_method(model) == "tree":
            trees = model if isinstance(model, (TreeEnsemble, StoredTrees)) else from_spark_model(spark, model, preprocessor.slot_names())
        return cls(spark, preprocessor, model, cut_lineage(scored), terms, means, background, metadata or {}, trees)

    def attributions(self, leads: DataFrame, id_col: str = S.ID_COL, n_permutations: int = 2) -> DataFrame:
        """(id, feature, impact) of raw leads for any model; a lead's impacts sum to its score minus the
        background's mean score (for boosted trees: to its log-odds minus their mean)."""
        if self.trees is not None:
            names = F.array(*[F.lit(n) for n in self.trees.names])
            return self._tree_impacts(leads, id_col).select(id_col, F.inline(F.transform(
                "impacts", lambda v, i: F.struct(F.element_at(names, i + 1).alias("feature"), v.alias("impact")))))
        return permutation_attribution(leads, lambda d: score_with(self.preprocessor, self.model, d), list(S.RAW_INPUT_COLS),
                                       self.background, n_permutations, id_col=id_col)

    def _tree_impacts(self, leads: DataFrame, id_col: str) -> DataFrame:
        slots = lambda df: self.preprocessor.transform(add_features(df), keep=[id_col], vector_col="_v")
        return tree_impacts(slots(leads), self.trees, slots(self.background), vector_to_array("_v"), [id_col])

    def _top3(self, leads: DataFrame, id_col: str) -> DataFrame:
        """(id, _top): the three entries of largest magnitude."""
        if self.trees is not None:
            return self._tree_impacts(leads, id_col).select(id_col, top_impacts(F.col("impacts"), self.trees.names).alias("_top"))
        return self.attributions(leads, id_col).groupBy(id_col).agg(F.slice(F.array_sort(F.collect_list(   # one per feature
            F.struct((-F.abs("impact")).alias("k"), "feature", "impact"))), 1, 3).alias("_top"))

    @staticmethod
    def _terms(pp: Preprocessor, model) -> dict:
        """Additive terms (slot-wise coef * x) of a linear model; empty otherwise."""
        if H.choose_method(model) != "linear":
            return {}
        coefs = list(model.coefficients.toArray())
        return {n: F.lit(float(b)) * c for n, b, c in zip(pp.slot_names(), coefs, pp.slot_columns())}

    def list_leads(self, canal=None, curso=None, score_min: float = 0.0, score_max: float = 1.0,
                   limit: int | None = None) -> DataFrame:
        return scoring.list_leads(self.scored, canal, curso, score_min, score_max, limit=limit)

    def score(self, payloads: DataFrame) -> DataFrame:
        """Validated, scored (left-closed classes) and explained payloads."""
        if self.terms:
            s = linear_score_expr(self.preprocessor, self.model)
            return scoring.score_leads(payloads, self.terms, self.means, score=s)
        scored = score_with(self.preprocessor, self.model, payloads, "_s")
        out = scoring.score_leads(scored, self.terms, self.means, score=F.col("_s")).drop("_s", "top_features")
        # payloads that are alike have one explanation; ids are theirs only within this call
        out = out.withColumn("_key", F.xxhash64(*S.RAW_INPUT_COLS))
        valid = out.where(F.col("is_valid") == 1).select("_key", *S.RAW_INPUT_COLS).dropDuplicates(["_key"])
        return out.join(self._top3(valid, "_key"), "_key", "left").withColumn("top_features", F.when(F.col("is_valid") == 1, F.transform(
            "_top", lambda t: F.struct(t["feature"].alias("feature"), t["impact"].alias("impact"))))).drop("_key", "_top")

    def scripts(self, requests: DataFrame, id_col: str = S.ID_COL) -> DataFrame:
        return MSG.script_table(self.scored, requests.select(F.col(id_col).alias(S.ID_COL)))
