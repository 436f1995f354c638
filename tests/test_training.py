import numpy as np
import pytest
from pyspark.sql import functions as F

from pyrogrid import constants as K
from pyrogrid.operators import boosting, training


def table(spark, n=240):
    df = spark.range(n).withColumn("u", F.rand(5)).withColumn("label", F.element_at(F.array(*[F.lit(c) for c in ("FLARE", "WILD", "COAL")]), (F.col("id") % 3 + 1).cast("int")))
    signal = F.when(F.col("label") == "FLARE", 1700.0).when(F.col("label") == "WILD", 900.0).otherwise(400.0)
    columns = {c: F.lit(0.0) for c in K.FEATURES if c != "diurnal_shape"}
    columns |= {c: signal + F.col("u") for c in K.FEATURES[1:30]}
    columns |= {"t_fire_K": signal + F.col("u") * 100, "dT": F.col("u"), "log1p_frp_max": F.lit(3.0)}
    return df.select(
        F.concat(F.lit("S"), "id").alias("source_id"), (F.floor(F.col("id") / 3) % 12 * 2.0 + 9).alias("centroid_lat"), F.lit(75.0).alias("centroid_lon"),
        "label", F.lit("SPARSE").alias("diurnal_shape"), F.lit("real").alias("origin"), F.lit("P").alias("facility_name"),
        F.lit(100.0).alias("dist_facility_m"), *[v.alias(k) for k, v in columns.items()],
    )


def test_train_score_save_and_fallback(spark, tmp_path):
    data = table(spark)
    model = training.train(data, trees=8, depth=4, folds=3, kind="forest")
    assert model.metrics["spatial_block_cv_accuracy"] > 0.95 and model.metrics["n_blocks"] == 12
    model.save(str(tmp_path / "m"))
    score, mode, _ = training.get_scorer(spark, "model", str(tmp_path / "m"))
    out = score(data)
    assert mode == "model" and out.filter(F.col("cls") == F.col("label")).count() > 228
    row = out.first()
    assert abs(sum(row["probs"].values()) - 1) < 1e-9 and len(row["top_features"]) == 3
    assert training.get_scorer(spark, "model", str(tmp_path / "none"))[1] == "fallback"
    sea = score(data.withColumn("landcover_water", F.lit(1.0))).first()
    assert sea["cls"] == "UNRESOLVED" and sea["conf"] <= 0.10 and abs(sum(sea["probs"].values()) - 1) < 1e-9


def test_contracts(spark):
    data = table(spark, 12)
    with pytest.raises(ValueError, match="BAD"):
        training.training_rows(data.withColumn("label", F.lit("BAD")))
    with pytest.raises(ValueError, match="t_fire_K"):
        training.training_rows(data.drop("t_fire_K"))
    with pytest.raises(ValueError, match="neither"):
        training.training_rows(data.drop("label"))
    folds = training.spatial_folds(training.training_rows(table(spark))).collect()
    assert {r["fold"] for r in folds} == set(range(5)) and len(folds) == 12
    old = data.withColumn("origin", F.when(F.col("source_id") == "S1", "synthetic").otherwise("real"))
    assert training.replace_synthetic(old, data.limit(2).withColumn("origin", F.lit("synthetic"))).count() == 13


def test_boosted_model_round_trip_and_held_out_accuracy(spark, tmp_path):
    data = table(spark)
    model = training.train(data, trees=4, depth=2, folds=2, rate=0.5)
    bagged = training.overall_metrics(training.out_of_fold(data, 4, 2, 2, "forest")).first()
    assert model.metrics["spatial_block_cv_accuracy"] >= round(bagged["accuracy"], 4) > 0.9
    assert model.metrics["kind"] == "boosted" and model.metrics["training_seconds"] > 0 and {"f1_FLARE", "f1_WILD", "f1_COAL"} <= set(model.metrics)
    model.save(str(tmp_path / "b"))
    again = training.AnomalyModel.load(spark, str(tmp_path / "b"))
    assert again.metrics["trained_at"] == model.metrics["trained_at"]
    first = model.score(data).collect()
    a, b = (sorted((r["source_id"], r["cls"], round(r["conf"], 12), str(r["top_features"])) for r in rows) for rows in (first, again.score(data).collect()))
    assert a == b
    # Thirty features carry the same signal; the first of them is taken where gains are equal.
    total = {}
    for t in (t for r in first for t in r["top_features"]):
        total[t["name"]] = total.get(t["name"], 0.0) + abs(t["contribution"])
    assert max(total, key=total.get) == "t_fire_K"


def numeric(spark, n=400, seed=3):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 12, n), np.round(rng.random(n), 2), rng.integers(0, 2, n), np.zeros(n)]).astype(float)
    y = np.where(x[:, 0] + 6 * x[:, 2] > 9, "B", np.where(x[:, 1] > 0.6, "C", "A"))
    w = rng.integers(1, 3, n).astype(float)
    df = spark.createDataFrame([(*map(float, r), str(c), float(v)) for r, c, v in zip(x, y, w)], "x_a double, x_b double, x_c double, x_d double, cls string, weight double")
    return df, x, y, w


def naive_cut(x, g, h, cuts):
    """The best (feature, cut) by trying them all."""
    best = None
    for f in range(x.shape[1]):
        for b, c in enumerate(cuts[f]):
            left = x[:, f] <= c
            hl, hr = h[left].sum(), h[~left].sum()
            if hl < 1 or hr < 1:
                continue
            gl, gr = g[left].sum(), g[~left].sum()
            gain = round(gl**2 / (hl + 1) + gr**2 / (hr + 1) - (gl + gr) ** 2 / (hl + hr + 1), 9)
            if gain > 0 and (best is None or gain > best[0]):
                best = (gain, f, b)
    return best


def test_trees_equal_brute_force(spark):
    df, x, y, w = numeric(spark)
    names = ["a", "b", "c", "d"]
    model = boosting.boost(df, names, rounds=3, depth=3, rate=0.4, bins=16)
    assert model.classes == ["A", "B", "C"] and model.rounds == 3 and len(model.cuts[3]) == 0
    raw, number = np.zeros((len(x), 3)), np.array([model.classes.index(c) for c in y])
    for tree in range(3):
        g, h = boosting.slopes(raw, number, w)
        for k in range(3):
            rows = {1: np.arange(len(x))}
            for node in range(1, 16):
                if node not in rows:
                    continue
                own = rows[node]
                value = -0.4 * g[own, k].sum() / (h[own, k].sum() + 1)
                assert abs(model.value[tree, k, node] - value) < 1e-9
                best = naive_cut(x[own], g[own, k], h[own, k], model.cuts) if node < 8 else None
                assert model.feature[tree, k, node] == (-1 if best is None else best[1])
                if best:
                    assert model.cut[tree, k, node] == best[2]
                    left = x[own, best[1]] <= model.cuts[best[1]][best[2]]
                    rows[2 * node], rows[2 * node + 1] = own[left], own[~left]
                else:
                    raw[own, k] += model.value[tree, k, node]
    assert np.allclose(raw, model.raw(model.bins_of(x)))


def test_contributions_and_base_are_the_score(spark):
    df, x, _, _ = numeric(spark, 300)
    model = boosting.boost(df, ["a", "b", "c", "d"], rounds=12, depth=3, rate=0.3)
    bins = model.bins_of(x)
    assert model.rounds == 12 and np.allclose(model.base() + model.contributions(bins).sum(axis=2), model.raw(bins))
    assert not model.contributions(bins)[:, :, 3].any()
    found = model.with_scores(df, contributions=True).collect()
    assert all(np.allclose(model.base() + np.array(r["_contributions"]).sum(axis=1), r["_raw"]) and abs(sum(r["_p"]) - 1) < 1e-9 for r in found)
    hits = [model.classes[int(np.argmax(r["_p"]))] == r["cls"] for r in found]
    assert np.mean(hits) > 0.97


def test_boosting_edges(spark):
    df, _, _, _ = numeric(spark, 30)
    assert boosting.boost(df.limit(0), ["a", "b"], 2, 2).rounds == 0
    one = boosting.boost(df.withColumn("cls", F.lit("A")), ["a", "b"], 2, 2)
    assert one.classes == ["A"] and one.rounds == 0
    with pytest.raises(ValueError, match="forest"):
        training.fit_trees(df, "trees", 1, 1, 0.1)


def test_permutation_importance_names_the_signal(spark):
    data = table(spark).withColumns({c: F.lit(0.0) for c in K.FEATURES[1:30] if c != "t_fire_K"})
    model = training.train(data, trees=4, depth=2, folds=2, rate=0.5)
    found = {r["feature"]: r["accuracy_loss"] for r in training.permutation_importance(model, data).collect()}
    assert max(found, key=found.get) == "t_fire_K" and found["t_fire_K"] > 0.3 and found["log1p_frp_max"] == 0.0
