"""Training table, grouped folds, boosted or bagged trees, calibration, intervals and attribution."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pyrogrid import constants as K
from pyrogrid.functions import geo
from pyrogrid.functions.physics import lookup
from pyrogrid.functions.quantiles import exact_quantile
from pyrogrid.functions.text import rounded
from pyrogrid.operators import boosting
from pyrogrid.operators.boosting import Boosted
from pyrogrid.operators.features import build_features, check_leakage
from pyrogrid.operators.nearest import CandidateIndex
from pyrogrid.operators.scoring import classify_rules, offshore
from pyrogrid.session import stored
from pyrogrid.sources import files


def offending_labels(df: DataFrame, column: str = "label") -> DataFrame:
    """Distinct labels that are no known class."""
    known = df.sparkSession.createDataFrame([(c,) for c in K.CLASSES], f"{column} string")
    return df.select(column).filter(F.col(column).isNotNull()).distinct().join(F.broadcast(known), column, "left_anti")


def replace_synthetic(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """Drop the old synthetic rows and add the new ones."""
    origin = F.col("origin") if "origin" in existing.columns else F.lit("real")
    kept = existing.withColumn("origin", origin).filter(~F.col("origin").eqNullSafe("synthetic"))
    return kept.unionByName(fresh, allowMissingColumns=True)


def materialise(
    labelled: DataFrame, facilities: DataFrame, landcover: DataFrame | None = None, index: CandidateIndex | None = None
) -> DataFrame:
    """Feature table of the rows with a known class, with ``cls`` and ``block_id``."""
    name = "label" if "label" in labelled.columns else "cls" if "cls" in labelled.columns else None
    if name is None:
        raise ValueError("neither 'label' nor 'cls' column found")
    rows = labelled.filter(F.col(name).isin(K.CLASSES)) if name == "label" else labelled
    out = build_features(rows, facilities, landcover, index).withColumn("cls", F.col(name))
    missing = sorted((set(K.FEATURES) | {"cls", "block_id"}) - set(out.columns))
    if missing:
        raise ValueError(f"training table misses required columns: {missing}")
    return out


def labelled_blocks(df: DataFrame) -> DataFrame:
    """The rows of a labelled table with a known class as ``cls``, and their ``block_id``; raises on other classes."""
    if "label" in df.columns:
        df = df.filter(~F.col("label").eqNullSafe(K.UNLABELLED))
        bad = [r[0] for r in offending_labels(df).collect()]
        if bad:
            raise ValueError(f"labels outside the known classes: {sorted(bad)}")
        df = df.withColumn("cls", F.col("label"))
    elif "cls" in df.columns:
        bad = [r[0] for r in offending_labels(df, "cls").collect()]
        if bad:
            raise ValueError(f"classes outside the known classes: {sorted(bad)}")
    else:
        raise ValueError("neither 'label' nor 'cls' column found")
    if "block_id" not in df.columns:
        if not {"centroid_lat", "centroid_lon"} <= set(df.columns):
            raise ValueError("block_id cannot be derived without centroid_lat and centroid_lon")
        df = df.withColumn("block_id", geo.block_id(F.col("centroid_lat"), F.col("centroid_lon")))
    return df


def training_rows(df: DataFrame) -> DataFrame:
    """Validate a labelled table and derive class, block and row weight."""
    check_leakage()
    df = labelled_blocks(df)
    missing = sorted(set(K.FEATURES) - set(df.columns))
    if missing:
        raise ValueError(f"labelled data misses required features: {missing}")
    weight = F.when(F.col("origin") == "real", 2.0).otherwise(1.0) if "origin" in df.columns else F.lit(1.0)
    return df.withColumn("weight", weight)


def spatial_folds(df: DataFrame, folds: int = 5) -> DataFrame:
    """(block_id, n, fold): whole blocks, largest first onto the lightest fold.

    A block is two degrees wide, so at most 16,200 block counts reach the driver.
    """
    sizes = df.groupBy("block_id").agg(F.count(F.lit(1)).alias("n")).collect()
    ordered = sorted(sizes, key=lambda r: (-r["n"], r["block_id"]))
    loads = [0] * max(1, min(folds, len(ordered)))
    rows = []
    for r in ordered:
        fold = loads.index(min(loads))
        loads[fold] += r["n"]
        rows.append((r["block_id"], r["n"], fold))
    return df.sparkSession.createDataFrame(rows, "block_id string, n long, fold int")


def with_folds(df: DataFrame, folds: int = 5) -> DataFrame:
    return df.join(F.broadcast(spatial_folds(df, folds).select("block_id", "fold")), "block_id")


def numeric_features(df: DataFrame) -> DataFrame:
    """Model inputs: shape as its list position (unknown 4), nulls as zero."""
    code = lookup({s: float(i) for i, s in enumerate(K.DIURNAL_SHAPES)}, F.col("diurnal_shape"))
    code = F.coalesce(code, F.col("diurnal_shape").try_cast("double"), F.lit(4.0))
    columns = {f"x_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in K.FEATURES if c != "diurnal_shape"}
    return df.withColumns({**columns, "x_diurnal_shape": code})


def forest(trees: int = 300, depth: int = 6, seed: int = 42) -> Pipeline:
    assembler = VectorAssembler(inputCols=[f"x_{c}" for c in K.FEATURES], outputCol="features")
    indexer = StringIndexer(inputCol="cls", outputCol="y", stringOrderType="alphabetAsc", handleInvalid="keep")
    model = RandomForestClassifier(
        labelCol="y", featuresCol="features", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed,
        probabilityCol="p", rawPredictionCol="raw", predictionCol="y_hat",
    )
    return Pipeline(stages=[assembler, indexer, model])


def probability_map(classes: list[str], p: Column) -> Column:
    """Map class to probability from an array in class order, scaled to sum 1."""
    used = F.slice(p, 1, len(classes))
    total = F.aggregate(used, F.lit(0.0), lambda a, v: a + v)
    return F.map_from_arrays(
        F.array(*[F.lit(c) for c in classes]),
        F.transform(used, lambda v: F.when(total > 0, v / total).otherwise(F.lit(1.0 / len(classes)))),
    )


def top_class(probs: Column) -> Column:
    """struct(cls, p) of the largest probability; the first class wins ties."""
    best = F.array_max(F.map_values(probs))
    return F.struct(
        F.element_at(F.map_keys(probs), F.array_position(F.map_values(probs), best).cast("int")).alias("cls"),
        best.alias("p"),
    )


def classification_metrics(predictions: DataFrame) -> DataFrame:
    """(class, n, precision counts, f1) per class from columns ``cls`` and ``predicted``.

    Works on the class-by-class counts, whatever the number of rows.
    """
    cells = predictions.groupBy("cls", "predicted").agg(F.count(F.lit(1)).alias("n"))
    sides = cells.select(
        F.inline(
            F.array(
                F.struct(F.col("cls").alias("c"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("guessed"),
                         F.when(F.col("cls") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit")),
                F.struct(F.col("predicted").alias("c"), F.lit(0).cast("long").alias("actual"), F.col("n").alias("guessed"),
                         F.lit(0).cast("long").alias("hit")),
            )
        )
    )
    per_class = sides.groupBy(F.col("c").alias("cls")).agg(
        F.sum("actual").alias("n_actual"), F.sum("guessed").alias("n_predicted"), F.sum("hit").alias("n_hit")
    )
    return per_class.withColumn("f1", F.col("n_hit") * 2.0 / (F.col("n_actual") + F.col("n_predicted")))


def overall_metrics(predictions: DataFrame) -> DataFrame:
    """One row: accuracy, macro F1 and log loss (needs ``p_true``)."""
    per_class = classification_metrics(predictions)
    macro = per_class.agg(
        F.avg("f1").alias("macro_f1"), (F.sum("n_hit") / F.sum("n_actual")).alias("accuracy")
    )
    p = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col("p_true")))
    loss = predictions.agg(F.avg(-F.log(p)).alias("loss")).select("loss").scalar()
    return macro.withColumn("log_loss", loss)


def conformal_quantile(predictions: DataFrame, level: float = 0.90) -> DataFrame:
    """One row: quantile of 1 - p(true class), exact at any size."""
    scores = predictions.select((F.lit(1.0) - F.col("p_true")).alias("nonconformity"))
    return exact_quantile(scores, "nonconformity", level, width=1 / 1024, name="q")


def coverage(predictions: DataFrame, q: float | Column) -> DataFrame:
    """Share of confidences inside their own band, and share of true classes covered."""
    conf, width = F.col("conf"), (F.lit(float(q)) if isinstance(q, (int, float)) else q)
    lo, hi = F.greatest(F.lit(0.0), conf - width), F.least(F.lit(1.0), conf + width)
    return predictions.agg(
        F.avg(conf.between(lo, hi).cast("double")).alias("band_coverage"),
        F.avg((F.lit(1.0) - F.col("p_true") <= width).cast("double")).alias("true_coverage"),
    )


def block_summary(df: DataFrame) -> DataFrame:
    """One row: samples, distinct blocks and rows per origin."""
    origin = F.col("origin") if "origin" in df.columns else F.lit("real")
    return df.agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.countDistinct("block_id").alias("n_blocks"),
        F.count_if(origin == "real").alias("n_real"),
        F.count_if(origin == "synthetic").alias("n_synthetic"),
    )


@dataclass
class ForestFit:
    """A fitted forest; a feature's contribution is its importance times its standardised value, for every class."""

    pipeline: PipelineModel
    means: list[float]
    scales: list[float]

    @property
    def classes(self) -> list[str]:
        return list(self.pipeline.stages[1].labels)

    def with_probabilities(self, df: DataFrame) -> DataFrame:
        if "cls" not in df.columns:
            df = df.withColumn("cls", F.lit(self.classes[0]))
        found = self.pipeline.transform(df.withColumn("weight", F.lit(1.0)))
        return found.withColumn("_p", vector_to_array("p")).drop("features", "y", "raw", "p", "y_hat")

    def with_scores(self, df: DataFrame, contributions: bool = False) -> DataFrame:
        weights = self.pipeline.stages[-1].featureImportances.toArray()
        own = [F.lit(float(w)) * (F.col(f"x_{c}") - m) / s for c, w, m, s in zip(K.FEATURES, weights, self.means, self.scales)]
        return self.with_probabilities(df).withColumn("_contributions", F.array_repeat(F.array(*own), len(self.classes)))

    def save(self, spark: SparkSession, root: str) -> None:
        self.pipeline.write().overwrite().save(f"{root}/model")
        scales = [(i, m, s) for i, (m, s) in enumerate(zip(self.means, self.scales))]
        spark.createDataFrame(scales, "i int, mean double, scale double").coalesce(1).write.mode("overwrite").json(f"{root}/scales")

    @staticmethod
    def load(spark: SparkSession, root: str) -> ForestFit:
        scales = spark.read.json(f"{root}/scales").orderBy("i").collect()
        return ForestFit(PipelineModel.load(f"{root}/model"), [r["mean"] for r in scales], [r["scale"] for r in scales])


# Parts that a saved model of each kind needs.
PARTS = {
    "forest": ["model", "scales", "conformal", "calibrator", "metrics"],
    "boosted": ["nodes", "cuts", "shape", "conformal", "calibrator", "metrics"],
}


@dataclass
class AnomalyModel:
    """Fitted trees (ForestFit or Boosted) with calibration, interval width and metrics."""

    fitted: ForestFit | Boosted
    classes: list[str]
    calibration: list[tuple[float, float]]
    q: float
    metrics: dict = field(default_factory=dict)

    def _calibrated(self, p: Column) -> Column:
        parts = [
            F.lit(1.0) / (1.0 + F.exp(-(F.element_at(p, i + 1) * slope + offset)))
            for i, (slope, offset) in enumerate(self.calibration)
        ]
        return probability_map(self.classes, F.array(*parts))

    def score(self, features: DataFrame) -> DataFrame:
        """Calibrated class, interval and key features of that class; offshore sources are suppressed."""
        have = features.columns
        df = self.fitted.with_scores(numeric_features(features), contributions=True)
        df = df.withColumn("_probs", self._calibrated(F.col("_p")))
        df = df.withColumn("_top", top_class(F.col("_probs"))).withColumn("_off", offshore(features))
        suppressed = F.least("_top.p", F.lit(0.10))
        others = len(self.classes) - (1 if "UNRESOLVED" in self.classes else 0)
        names = self.classes if "UNRESOLVED" in self.classes else [*self.classes, "UNRESOLVED"]
        flat = F.map_from_arrays(
            F.array(*[F.lit(c) for c in names]),
            F.array(*[suppressed if c == "UNRESOLVED" else (F.lit(1.0) - suppressed) / others for c in names]),
        )
        of_class = F.array_position(F.array(*[F.lit(c) for c in self.classes]), F.col("_top.cls")).cast("int")
        df = df.withColumn("_own", F.element_at("_contributions", of_class))
        contributions = F.array(
            *[
                F.struct(F.lit(c).alias("name"), F.col(f"x_{c}").alias("value"), rounded(F.element_at("_own", i + 1), 4).alias("contribution"))
                for i, c in enumerate(K.FEATURES)
            ]
        )

        def by_size(a: Column, b: Column) -> Column:
            gap = F.abs(b["contribution"]) - F.abs(a["contribution"])
            return F.signum(gap).cast("int")

        conf = F.when(F.col("_off"), suppressed).otherwise(F.col("_top.p"))
        extra = {
            "cls": F.when(F.col("_off"), "UNRESOLVED").otherwise(F.col("_top.cls")),
            "conf": conf,
            "probs": F.when(F.col("_off"), flat).otherwise(F.col("_probs")),
            "lo": F.greatest(F.lit(0.0), conf - self.q),
            "hi": F.least(F.lit(1.0), conf + self.q),
            "score_reason": F.when(F.col("_off"), "unverified/offshore-suppressed").otherwise("trained model inference"),
            "offshore_suppressed": F.col("_off"),
            "top_features": F.slice(F.array_sort(contributions, by_size), 1, 3),
        }
        return df.select(*[c for c in have if c not in extra], *[v.alias(k) for k, v in extra.items()])

    def save(self, root: str) -> None:
        """Write the trees and one-row JSON tables beside them."""
        spark = SparkSession.active()
        self.fitted.save(spark, root)
        conformal = [("1.0", self.q, 0.90, self.classes)]
        spark.createDataFrame(conformal, "version string, q double, coverage_level double, classes array<string>").coalesce(
            1
        ).write.mode("overwrite").json(f"{root}/conformal")
        rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(self.calibration)]
        spark.createDataFrame(rows, "i int, slope double, offset double").coalesce(1).write.mode("overwrite").json(
            f"{root}/calibrator"
        )
        pairs = [(k, float(v)) for k, v in self.metrics.items() if isinstance(v, (int, float))]
        texts = [(k, str(v)) for k, v in self.metrics.items() if not isinstance(v, (int, float))]
        table = [(k, v, None) for k, v in pairs] + [(k, None, v) for k, v in texts]
        spark.createDataFrame(table, "metric string, value double, text string").coalesce(1).write.mode("overwrite").json(
            f"{root}/metrics"
        )

    @staticmethod
    def load(spark: SparkSession, root: str) -> AnomalyModel:
        """Read a saved model; ``FileNotFoundError`` names what is missing."""

        def there(part: str) -> bool:
            return files.exists(spark, f"{root}/{part}")

        kind = "boosted" if there("nodes") else "forest"
        missing = [part for part in PARTS[kind] if not there(part)]
        if missing:
            raise FileNotFoundError(f"model parts {missing} are missing in {root!r}; train the model first")
        head = spark.read.json(f"{root}/conformal").first()
        lines = spark.read.json(f"{root}/calibrator").orderBy("i").collect()
        kept = spark.read.schema("metric string, value double, text string").json(f"{root}/metrics").collect()
        metrics = {r["metric"]: r["text"] if r["value"] is None else r["value"] for r in kept}
        fitted = {"forest": ForestFit, "boosted": Boosted}[kind].load(spark, root)
        return AnomalyModel(fitted, list(head["classes"]), [(r["slope"], r["offset"]) for r in lines], head["q"], metrics)


def fit_trees(data: DataFrame, kind: str, trees: int, depth: int, rate: float) -> ForestFit | Boosted:
    """Fit rows of ``numeric_features`` with cls and weight: boosted trees, or a forest."""
    if kind == "boosted":
        return boosting.boost(data, K.FEATURES, trees, depth, rate)
    if kind != "forest":
        raise ValueError(f"trees are 'boosted' or a 'forest', not {kind!r}")
    names = [f"x_{c}" for c in K.FEATURES]
    moments = data.agg(*[F.avg(c).alias(f"m_{c}") for c in names], *[F.stddev_pop(c).alias(f"s_{c}") for c in names]).first()
    means = [float(moments[f"m_{c}"] or 0.0) for c in names]
    return ForestFit(forest(trees, depth).fit(data), means, [float(moments[f"s_{c}"] or 0.0) or 1.0 for c in names])


def out_of_fold(df: DataFrame, trees: int, depth: int, folds: int, kind: str = "boosted", rate: float = 0.05) -> DataFrame:
    """Predictions of every row by trees that never saw its block."""
    data = stored(with_folds(numeric_features(training_rows(df)), folds), "folds")
    numbers = sorted(r[0] for r in data.select("fold").distinct().collect())
    parts = []
    for fold in numbers:
        train_part = data.filter(F.col("fold") != fold) if len(numbers) > 1 else data
        fitted = fit_trees(train_part, kind, trees, depth, rate)
        part = fitted.with_probabilities(data.filter(F.col("fold") == fold))
        part = part.withColumn("probs", probability_map(fitted.classes, F.col("_p")))
        part = part.withColumn("_top", top_class(F.col("probs")))
        keep = ["source_id", "block_id", "fold", "cls"]
        parts.append(
            part.select(
                *[c for c in keep if c in part.columns],
                F.col("_top.cls").alias("predicted"),
                F.col("_top.p").alias("conf"),
                F.coalesce(F.element_at("probs", F.col("cls")), F.lit(0.0)).alias("p_true"),
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def calibrate(scored: DataFrame, classes: list[str]) -> list[tuple[float, float]]:
    """Per class a logistic line (slope, offset) from raw probability to outcome."""
    lines = []
    for i, name in enumerate(classes):
        pairs = scored.select(
            F.element_at("_p", i + 1).alias("s"), (F.col("cls") == name).cast("double").alias("hit"), "weight"
        )
        data = VectorAssembler(inputCols=["s"], outputCol="features").transform(pairs)
        fitted = LogisticRegression(labelCol="hit", weightCol="weight", maxIter=50, regParam=1e-3).fit(data)
        slope = fitted.coefficients[0] if math.isfinite(fitted.coefficients[0]) else 0.0
        offset = max(-30.0, min(30.0, fitted.intercept))
        lines.append((float(slope), float(offset)))
    return lines


def train(
    df: DataFrame, trees: int = 300, depth: int = 6, folds: int = 5, kind: str = "boosted", rate: float = 0.05
) -> AnomalyModel:
    """Spatial-block validation, interval width, final trees and calibration."""
    begun = datetime.now(timezone.utc)
    rows = stored(training_rows(df), "training")
    held_out = stored(out_of_fold(rows, trees, depth, folds, kind, rate), "held_out")
    q = round(float(conformal_quantile(held_out).first()["q"]), 4)
    overall = overall_metrics(held_out).first()
    cover = coverage(held_out, q).first()
    data = numeric_features(rows)
    fitted = fit_trees(data, kind, trees, depth, rate)
    scored = stored(fitted.with_probabilities(data).select("_p", "cls", "weight"), "scored")
    summary = block_summary(rows).first()
    metrics = {
        "spatial_block_cv_accuracy": round(overall["accuracy"], 4),
        "macro_f1": round(overall["macro_f1"], 4),
        "log_loss": round(overall["log_loss"], 4),
        "conformal_coverage_pct": round(cover["band_coverage"] * 100, 2),
        "true_class_coverage_pct": round(cover["true_coverage"] * 100, 2),
        "n_samples": summary["n_samples"],
        "n_blocks": summary["n_blocks"],
        "n_real": summary["n_real"],
        "n_synthetic": summary["n_synthetic"],
        **{f"f1_{r['cls']}": round(r["f1"], 4) for r in classification_metrics(held_out).collect() if r["n_actual"]},
        "kind": kind,
        "trained_at": begun.isoformat(),
        "training_seconds": round((datetime.now(timezone.utc) - begun).total_seconds(), 3),
    }
    return AnomalyModel(fitted, list(fitted.classes), calibrate(scored, list(fitted.classes)), q, metrics)


# Rows exchange values within a bucket; buckets are as many as rows need, and never fewer than this.
EXCHANGE_ROWS, LEAST_BUCKETS = 50_000, 8


def permutation_importance(model: AnomalyModel, df: DataFrame, seed: int = 7) -> DataFrame:
    """Loss of accuracy when one feature's values are taken from other rows.

    Values are exchanged by pairing rows of two hash orders inside hash buckets, so
    no global sort is needed.  One pass scores all features: every row is written once
    per feature, with that feature's value exchanged.
    """
    base = numeric_features(training_rows(df)).withColumn("_row", F.xxhash64("source_id", F.lit(seed)))
    names = [f"x_{c}" for c in K.FEATURES]
    base = stored(base.select("_row", "source_id", "cls", *names), "rows")
    buckets = max(LEAST_BUCKETS, -(-base.count() // EXCHANGE_ROWS))
    ring = Window.partitionBy(F.pmod("_row", F.lit(buckets))).orderBy("_row", "source_id")
    paired = base.withColumn("_other", F.lag(F.struct(*names)).over(ring))
    variants = paired.withColumn("_f", F.explode(F.sequence(F.lit(-1), F.lit(len(names) - 1))))
    shifted = variants.withColumns({n: F.when(F.col("_f") == i, F.coalesce(F.col(f"_other.{n}"), F.col(n))).otherwise(F.col(n)) for i, n in enumerate(names)})
    scored = model.fitted.with_probabilities(shifted.drop("_other"))
    hit = top_class(probability_map(model.classes, F.col("_p")))["cls"] == F.col("cls")
    # One figure per feature, whatever the number of rows.
    found = dict(scored.groupBy("_f").agg(F.avg(hit.cast("double"))).collect())
    losses = [(c, float(found[-1] - found[i])) for i, c in enumerate(K.FEATURES)] if found else []
    return df.sparkSession.createDataFrame(losses, "feature string, accuracy_loss double")


def contributions_of(model: Boosted, rows: DataFrame) -> DataFrame:
    """(source_id, cls, base, raw, feature, contribution) of rows with source_id and ``x_`` columns."""
    found = model.with_scores(rows, contributions=True)
    parts = [
        F.struct(F.lit(c).alias("cls"), F.lit(float(v)).alias("base"), F.element_at("_raw", k).alias("raw"), F.element_at("_contributions", k).alias("own"))
        for k, (c, v) in enumerate(zip(model.classes, model.base(), strict=True), 1)
    ]
    each = found.select("source_id", F.explode(F.array(*parts)).alias("of")).select("source_id", "of.*")
    names = F.array(*[F.lit(f) for f in model.features])
    return each.select("source_id", "cls", "base", "raw", F.posexplode("own").alias("_at", "contribution")).select(
        "source_id", "cls", "base", "raw", F.element_at(names, F.col("_at") + 1).alias("feature"), "contribution"
    )


def attribution(model: Boosted, features: DataFrame) -> DataFrame:
    """(source_id, cls, base, raw, feature, contribution): what each feature adds to each class's score of each source.

    ``base`` and the contributions of a source and class add up to ``raw``.
    """
    return contributions_of(model, numeric_features(features))


def get_scorer(spark: SparkSession, backend: str = "heuristic", root: str | None = None) -> tuple:
    """(score function, mode, disclosure): rules, or a model with a disclosed fallback."""
    if backend == "model":
        try:
            model = AnomalyModel.load(spark, root or "")
            return model.score, "model", "Trained trees with spatial-block validation and conformal intervals."
        except FileNotFoundError as exc:
            return classify_rules, "fallback", f"Fallback active: {exc}"
    return classify_rules, "heuristic", "Ordered rule table."
