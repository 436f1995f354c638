"""Fixed expectations on the published sample: three CSV files of 170 detections.

The files are not part of this repository; PYROGRID_SAMPLE_DIR names their folder.
"""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pyrogrid.operators import cluster, features, ingest, landcover, matches, records, scoring
from pyrogrid.session import stored
from pyrogrid.sources import detections as src
from pyrogrid.sources.registry import load_facilities

FOLDER = os.environ.get("PYROGRID_SAMPLE_DIR")
pytestmark = pytest.mark.skipif(not FOLDER, reason="PYROGRID_SAMPLE_DIR not set")


@pytest.fixture(scope="module")
def out(spark):
    clean = stored(ingest.normalise(src.read_detections(spark, FOLDER)))
    assert clean.count() == 170
    assert cluster.regional_ambient(clean).first()[0] == pytest.approx(292.65)
    found = stored(landcover.annotate_landcover(cluster.cluster_sources(clean)))
    fac = load_facilities(spark)
    scored = scoring.classify_rules(features.build_features(found, fac))
    return found, stored(records.build_records(scored)), fac


def test_counts(out):
    found, rec, fac = out
    assert found.count() == 41
    assert Counter(r[0] for r in found.select("t_bg_method").collect()) == {"cluster_5th_percentile": 9, "regional_ambient": 32}
    assert Counter(r[0] for r in found.select("diurnal_shape").collect()) == {"SPARSE": 32, "SPIKE_DECAY": 8, "DAYTIME_ONLY": 1}
    rows = rec.collect()
    assert Counter(r["cls"] for r in rows) == {"FLARE": 2, "LEAK": 2, "WILD": 1, "UNRESOLVED": 36}
    assert Counter(r["severity"] for r in rows) == {"LOW": 23, "MODERATE": 15, "HIGH": 3}
    assert sum(r["offshore_suppressed"] for r in rows) == 21 and sum(r["temp_K"] is not None for r in rows) == 29
    assert matches.facility_matches(rec, fac, "FAC-004").count() == 4


def test_named_sources(out):
    rows = {r["id"]: r for r in out[1].filter(F.col("facility_name").isNotNull()).collect()}
    a, b = rows["AV-0B12A4B9"], rows["AV-95BA9779"]
    assert (a["n_hits"], a["n_days"], round(a["temp_K"], 1), round(a["frp_MW"], 2), round(a["dist_facility_m"], 1)) == (53, 5, 486.1, 9.23, 492.4)
    assert (b["n_hits"], b["n_days"], round(b["temp_K"], 1), round(b["frp_MW"], 2), round(b["dist_facility_m"], 1)) == (49, 5, 506.1, 10.37, 535.4)
    for name, hits, metres in (("AV-07D8247D", 2, 825.6), ("AV-EF7A2C35", 1, 1372.0)):
        r = rows[name]
        assert (r["cls"], r["conf"], r["temp_K"], r["n_hits"], round(r["dist_facility_m"], 1)) == ("LEAK", 0.55, None, hits, metres)
