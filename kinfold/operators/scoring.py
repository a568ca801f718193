"""Scores of candidate pairs: deterministic rules, heuristic mean, trained trees with isotonic
calibration, decision bands and explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions.dictionaries import HEURISTIC_WEIGHTS
from kinfold.operators.features import NAMES, pair_features, vector

AUTO, REVIEW = 0.95, 0.55


def deterministic_tier(a: str = "a", b: str = "b") -> Column:
    """struct(fired, is_match, probability, reason): the first rule that applies; is_match is NULL
    where a rule fired without deciding."""
    f = lambda side, n: F.col(f"{side}.{n}")
    pan = [f(s, "pan") for s in (a, b)]
    gst = [f(s, "gstin") for s in (a, b)]
    own = [f(s, "legal_entity_pan") for s in (a, b)]
    inner = [F.substring(g, 3, 10) for g in gst]
    sole = F.coalesce(f(a, "pan_is_proprietorship"), F.lit(False)) | F.coalesce(f(b, "pan_is_proprietorship"), F.lit(False))
    pins_differ = F.coalesce(f(a, "pin_code") != f(b, "pin_code"), F.lit(False))
    both = lambda x: x[0].isNotNull() & x[1].isNotNull()

    def out(match: bool | None, p: float | None, reason: str, fired: bool = True) -> Column:
        return F.struct(F.lit(fired).alias("fired"), F.lit(match).cast("boolean").alias("is_match"), F.lit(p).cast("double").alias("probability"), F.lit(reason).alias("reason"))

    return (
        F.when(both(pan) & (pan[0] == pan[1]) & sole, out(None, 0.7, "same_pan_proprietorship"))
        .when(both(pan) & (pan[0] == pan[1]) & pins_differ, out(None, 0.6, "same_pan_other_pin"))
        .when(both(pan) & (pan[0] == pan[1]), out(True, 1.0, "same_pan"))
        .when(both(pan), out(False, 0.0, "different_pan"))
        .when(both(gst) & (gst[0] == gst[1]), out(True, 1.0, "same_gstin"))
        .when(both(gst) & (inner[0] != inner[1]), out(False, 0.0, "different_gstin_pan"))
        .when(both(own) & (own[0] == own[1]) & ~sole, out(None, 0.75, "same_derived_pan"))
        .when(both(own) & (own[0] != own[1]), out(False, 0.0, "different_derived_pan"))
        .otherwise(out(None, None, "none", False))
    )


def heuristic_score(weights: dict[str, float] = HEURISTIC_WEIGHTS) -> Column:
    """Weighted mean of the features that are there; 0.3 if none is. May exceed 1 through blk_n_shared."""
    total = sum((F.when(F.col(n).isNotNull(), F.lit(w) * F.col(n)).otherwise(0.0) for n, w in weights.items()), F.lit(0.0))
    weight = sum((F.when(F.col(n).isNotNull(), F.lit(w)).otherwise(0.0) for n, w in weights.items()), F.lit(0.0))
    return F.when(weight > 0, total / weight).otherwise(0.3)


def blended(raw: Column, prior: Column) -> Column:
    return 0.3 * F.coalesce(prior, F.lit(0.5)) + 0.7 * raw


def heuristic_explanation(weights: dict[str, float] = HEURISTIC_WEIGHTS) -> Column:
    """Map feature -> weight x value of the features that are there."""
    entries = F.array(*[F.struct(F.lit(n).alias("key"), (F.lit(weights.get(n, 0.0)) * F.col(n)).alias("value")) for n in NAMES])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def top_factors(explanation: Column, k: int = 5) -> Column:
    """The k entries of largest absolute value, as an array of structs (ties: by name)."""
    order = lambda x, y: F.when(F.abs(x["value"]) != F.abs(y["value"]), F.signum(F.abs(y["value"]) - F.abs(x["value"])).cast("int")).otherwise(F.when(x["key"] < y["key"], -1).when(x["key"] > y["key"], 1).otherwise(0))
    return F.slice(F.array_sort(F.map_entries(explanation), order), 1, k)


def band(p: Column, is_match: Column) -> Column:
    return F.when(F.coalesce(is_match, F.lit(False)) | (p >= AUTO), "auto_link").when(p >= REVIEW, "review").otherwise("reject")


def score(featured: DataFrame) -> DataFrame:
    """Adds tier, raw_score and probability: decided pairs skip the model's score."""
    with_tier = featured.withColumn("tier", deterministic_tier())
    decided = F.col("tier.is_match").isNotNull()
    raw = heuristic_score()
    return with_tier.withColumn("raw_score", F.when(~decided, raw)).withColumn(
        "probability", F.when(decided, F.col("tier.probability")).otherwise(blended(F.col("raw_score"), F.col("tier.probability")))
    ).withColumn("decision", band(F.col("probability"), F.col("tier.is_match")))


def score_pairs(pairs: DataFrame) -> DataFrame:
    """`score` of pairs (structs a and b) whose features are only computed where the fixed rules do not
    decide: canonical_id_a, canonical_id_b, tier, raw_score, probability, decision, explanation."""
    columns = ("canonical_id_a", "canonical_id_b", "tier", "raw_score", "probability", "decision", "explanation")
    ruled = pairs.withColumn("tier", deterministic_tier())
    match = F.col("tier.is_match")
    none = F.lit(None)
    decided = ruled.where(match.isNotNull()).select(
        "canonical_id_a", "canonical_id_b", "tier", none.cast("double").alias("raw_score"), F.col("tier.probability").alias("probability"),
        band(F.col("tier.probability"), match).alias("decision"), none.cast("map<string,double>").alias("explanation"),
    )
    open_ = score(pair_features(ruled.where(match.isNull()).drop("tier"))).withColumn("explanation", heuristic_explanation())
    return decided.unionByName(open_.select(*columns))


def to_rescore(scored: DataFrame, pending: DataFrame, low: float = 0.20, high: float = 0.97) -> DataFrame:
    """Pairs near a decision or waiting for review, each once."""
    keys = ["canonical_id_a", "canonical_id_b"]
    near = scored.where(F.col("calibrated_probability").between(low, high)).select(*keys)
    return near.union(pending.select(*keys)).distinct()


class TrainedScorer:
    """Gradient-boosted trees on the 25 features and an isotonic calibration on a held-out fifth, chosen
    by hash of the pair so that a pair is never on both sides."""

    def __init__(self, trees: int = 40, depth: int = 5, step: float = 0.1, seed: int = 42):
        self.trees, self.depth, self.step, self.seed = trees, depth, step, seed

    def held(self) -> Column:
        """Whether a labelled pair is kept out of the training."""
        return F.pmod(F.xxhash64(F.lit(self.seed), "canonical_id_a", "canonical_id_b"), F.lit(5)) == 0

    def _assembled(self, featured: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector

        return featured.withColumn("features", array_to_vector(vector()))

    def fit(self, featured: DataFrame) -> TrainedScorer:
        """`featured` has the feature columns, canonical_id_a, canonical_id_b and label."""
        from pyspark.ml.classification import GBTClassifier
        from pyspark.ml.functions import vector_to_array
        from pyspark.ml.regression import IsotonicRegression

        data = self._assembled(featured).withColumn("held", self.held()).withColumn("label", F.col("label").cast("double"))
        gbt = GBTClassifier(maxIter=self.trees, maxDepth=self.depth, stepSize=self.step, seed=self.seed, validationIndicatorCol="held", validationTol=0.001)
        self.model = gbt.fit(data)
        scored = self.model.transform(data.where("held")).withColumn("raw", vector_to_array("probability")[1])
        self.isotonic = IsotonicRegression(featuresCol="raw_vector").fit(self._vector(scored.select("label", "raw")))
        return self

    @staticmethod
    def _vector(frame: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector

        return frame.withColumn("raw_vector", array_to_vector(F.array("raw")))

    def transform(self, featured: DataFrame) -> DataFrame:
        """Adds raw_score and calibrated_probability (clipped to [0, 1])."""
        from pyspark.ml.functions import vector_to_array

        scored = self.model.transform(self._assembled(featured)).withColumn("raw", vector_to_array("probability")[1])
        out = self.isotonic.transform(self._vector(scored).drop("prediction"))
        clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction")))
        return out.withColumn("raw_score", F.col("raw")).withColumn("calibrated_probability", clipped).drop("features", "rawPrediction", "probability", "prediction", "raw", "raw_vector")

    def importances(self) -> dict[str, float]:
        return dict(zip(NAMES, self.model.featureImportances.toArray().tolist()))

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/trees")
        self.isotonic.write().overwrite().save(f"{path}/isotonic")

    @classmethod
    def load(cls, path: str) -> TrainedScorer:
        from pyspark.ml.classification import GBTClassificationModel
        from pyspark.ml.regression import IsotonicRegressionModel

        out = cls()
        out.model, out.isotonic = GBTClassificationModel.load(f"{path}/trees"), IsotonicRegressionModel.load(f"{path}/isotonic")
        return out
