import pytest
from pyspark.sql import functions as F

from pyrogrid import constants as K
from pyrogrid.functions import text
from pyrogrid.operators import features, records, scoring
from pyrogrid.operators.severity import severity
from pyrogrid.sources.registry import seed_facilities

BASE = dict(
    source_id="S", centroid_lat=21.113, centroid_lon=72.652, n_hits=24, n_days=8, n_nights=17, night_frac=0.7083, span_days=9,
    frp_mean=37.5, frp_max=61.0, frp_median=35.0, frp_cv=0.31, ti4_median=347.2, ti4_max=366.9, ti5_median=294.1, dT_median=53.1,
    ti4_std=5.5, local_solar_hour=1.5, pixel_area_m2=152_000.0, cluster_extent_m=640.0, fill_ratio=0.75, recurrence_gap_days=1.2,
    flare_score=31.0, frp_derived_MW=44.0, diurnal_shape="FLAT_24H", t_fire_K=1710.0, landcover_class="built", t_bg_K=None,
    last_seen="2026-08-14", deviation_z=None,
)
KINDS = {"source_id": "string", "diurnal_shape": "string", "landcover_class": "string", "last_seen": "string", "n_hits": "long", "n_days": "long", "n_nights": "long", "span_days": "long"}


def run(spark, *changes):
    rows = [BASE | {"source_id": f"S{i}"} | c for i, c in enumerate(changes)]
    schema = ", ".join(f"{k} {KINDS.get(k, 'double')}" for k in BASE)
    df = spark.createDataFrame([tuple(r[k] for k in BASE) for r in rows], schema)
    scored = scoring.classify_rules(features.build_features(df, seed_facilities(spark)))
    return records.build_records(scored).orderBy("id").collect()


def test_records(spark):
    flare, sea, crop, fire, kept = run(
        spark, {}, {"landcover_class": "water"},
        {"centroid_lat": 30.0, "centroid_lon": 76.0, "landcover_class": "cropland", "diurnal_shape": "EVENING_BURST", "t_fire_K": None, "night_frac": 0.1},
        {"centroid_lat": 21.2, "n_days": 1, "night_frac": 0.1, "t_fire_K": 300.0, "diurnal_shape": "SPARSE"},
        {"centroid_lat": 21.12, "centroid_lon": 72.64, "n_days": 2, "night_frac": 0.1, "diurnal_shape": "SPARSE", "t_fire_K": 300.0},
    )
    assert flare["cls"] == "FLARE" and flare["conf"] == 0.9 and flare["co2e_rate_tph"] == 87.12
    assert flare["co2e_total_t"] == round(flare["co2e_rate_tph"] * 9 * 24.0, 3)
    assert sea["cls"] == "UNRESOLVED" and sea["severity"] == "LOW" and sea["co2e_rate_tph"] is None and sea["conf"] == 0.1
    assert sea["cited_rule"] == "OFFSHORE-SUPPRESSED"
    assert crop["cls"] == "WILD" and crop["conf"] == 0.85 and crop["cited_rule"] == "CPCB-AGRICULTURAL-BURN"
    assert kept["cls"] == "IND_FIRE" and kept["severity"] == "CRITICAL"
    for r in (flare, sea, crop, fire, kept):
        assert abs(sum(r["probs"].values()) - 1) < 1e-4 and len(r["evidence"]) == 6 and len(r["top_features"]) == 3


def test_far_industrial_fire_is_lowered_unless_it_departs_from_its_history(spark):
    names = ["source_id", "cls", "conf", "probs", "lo", "hi", "offshore_suppressed"]
    probs = {c: (0.84 if c == "IND_FIRE" else 0.032) for c in K.CLASSES}
    far = {"centroid_lat": 15.0, "centroid_lon": 77.0, "frp_max": 60.0}
    rows = [BASE | far | {"source_id": "A"}, BASE | far | {"source_id": "B", "deviation_z": 6.0}]
    schema = ", ".join(f"{k} {KINDS.get(k, 'double')}" for k in BASE)
    df = features.build_features(spark.createDataFrame([tuple(r[k] for k in BASE) for r in rows], schema), seed_facilities(spark))
    score = spark.createDataFrame([(i, "IND_FIRE", 0.84, probs, 0.72, 0.96, False) for i in "AB"],
                                  "source_id string, cls string, conf double, probs map<string,double>, lo double, hi double, offshore_suppressed boolean")
    df = df.join(score, "source_id").withColumn("top_features", F.array(F.struct(F.lit("x").alias("name"), F.lit(1.0).alias("value"), F.lit(None).cast("double").alias("contribution"))))
    a, b = records.build_records(df).orderBy("id").collect()
    assert (a["cls"], a["conf"]) == ("UNRESOLVED", 0.35) and (b["cls"], b["conf"]) == ("IND_FIRE", 0.84)
    assert abs(sum(a["probs"].values()) - 1) < 1e-4 and names


def test_rules_need_context(spark):
    with pytest.raises(ValueError, match="dist_facility_m"):
        scoring.classify_rules(spark.createDataFrame([(1,)], "t_fire_K int"))
    features.check_leakage()
    with pytest.raises(ValueError):
        features.check_leakage(["lat", "dT"])
    assert len(K.FEATURES) == 43


def test_severity_steps(spark):
    rows = [("FLARE", 160.0, None, None), ("FLARE", 79.0, 5.0, None), ("LEAK", 25.0, None, 20000), ("GEO", 1.0, 3.0, None), ("LEAK", None, None, None)]
    df = spark.createDataFrame(rows, "c string, p double, z double, n long")
    level, why = severity(F.col("c"), F.col("p"), F.lit(False), F.col("z"), F.col("n"))
    out = df.select(level.alias("l"), why.alias("w")).collect()
    assert [r["l"] for r in out] == ["HIGH", "HIGH", "CRITICAL", "HIGH", "HIGH"]
    assert out[2]["w"].endswith("(20,000 persons in impact radius: +1)")


def test_rounding_is_exact_half_even(spark):
    values = [0.125, 3.25, 3.35, 3.45, 3.15, 20.655, 2.5, 3.5]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 1, 2):
        got = [float(r[0]) for r in df.select(text.fixed(F.col("v"), digits)).collect()]
        assert got == [round(v, digits) for v in values]


def test_guard(spark):
    facts = dict(cls="FLARE", conf=0.92, lo=0.85, hi=0.95, dist_facility_m=450.0, t_fire_K=1847.0, frp_max=62.1, n_days=5, night_frac=0.8, co2e_rate_tph=12.34)
    e = text.evidence({k: F.lit(v) for k, v in facts.items()})
    allowed = text.allowed_numbers(e)
    cases = [
        ("0.92 confidence [0.85-0.95], 1847 K, 5 days, 1574 C, 0.45 km, 92%", True), ("1847 K and 9999 MW", False), ("Rule 2016", False),
        ("", False), ("no numbers", True), ("word5 5é x5", True), ("7", False),
    ]
    df = spark.createDataFrame(cases, "t string, want boolean")
    assert df.filter(text.is_grounded(F.col("t"), allowed) != F.col("want")).count() == 0
