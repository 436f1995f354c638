"""Data checks over the store tables, as rows of (check, status, details)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyrogrid import constants as K
from pyrogrid.functions.physics import brightness_temp, planck_radiance, retrieve_temperature

# fixed values: known mixed pixel (fire share, fire kelvin, background kelvin)
KNOWN_PIXEL = (0.002, 1150.0, 290.0)
STATUS_RANK = {"PASS": 0, "WARN": 1, "FAIL": 2}


def known_retrieval() -> Column:
    """Retrieved temperature of a pixel mixed from a known fire and background."""
    share, fire, ground = KNOWN_PIXEL

    def mixed(lam: float) -> Column:
        return brightness_temp(
            lam, planck_radiance(lam, F.lit(ground)) * (1 - share) + planck_radiance(lam, F.lit(fire)) * share
        )

    return retrieve_temperature(
        mixed(K.LAM_MIR), mixed(K.LAM_TIR), F.lit(K.DEFAULT_PIXEL_AREA_M2), F.lit(ground)
    )["t_fire_K"]


def data_checks(
    records: DataFrame,
    facilities: DataFrame,
    expected_ids: list[str],
    scorer_mode: str = "heuristic",
) -> DataFrame:
    """One row per check; each table is reduced to one row before they meet."""
    facts = records.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("landcover_status") == "resolved").alias("n_cover"),
        F.count_if(F.col("id").isin(list(expected_ids))).alias("n_expected"),
    )
    n_fac = facilities.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    row = facts.withColumns({"n_fac": n_fac, "t": known_retrieval(), "wanted": F.lit(len(expected_ids))})

    def check(name: str, status: Column, details: Column) -> Column:
        return F.struct(F.lit(name).alias("check"), status.alias("status"), details.alias("details"))

    def text(*parts) -> Column:
        return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])

    close = F.col("t").between(KNOWN_PIXEL[1] - 50, KNOWN_PIXEL[1] + 50)
    checks = F.array(
        check("detections", F.when(F.col("n") > 0, "PASS").otherwise("WARN"), text(F.col("n"), " detections stored")),
        check("facilities", F.when(F.col("n_fac") > 0, "PASS").otherwise("FAIL"), text(F.col("n_fac"), " facilities active")),
        check("scorer", F.lit("WARN" if scorer_mode == "fallback" else "PASS"), F.lit(f"mode={scorer_mode}")),
        check("retrieval", F.when(close, "PASS").otherwise("WARN"), text("T_fire=", F.round("t", 1), "K")),
        check("landcover", F.when(F.col("n_cover") > 0, "PASS").otherwise("WARN"), text(F.col("n_cover"), " resolved")),
        check(
            "expected ids",
            F.when(F.col("n_expected") == F.col("wanted"), "PASS").otherwise("WARN"),
            text(F.col("n_expected"), "/", F.col("wanted"), " present"),
        ),
    )
    return row.select(F.inline(checks))


def overall_status(checks: DataFrame) -> DataFrame:
    """One row with the worst status."""
    rank = F.when(F.col("status") == "FAIL", 2).when(F.col("status") == "WARN", 1).otherwise(0)
    names = F.array(*[F.lit(s) for s in STATUS_RANK])
    return checks.agg(F.element_at(names, F.max(rank) + 1).alias("status"))
