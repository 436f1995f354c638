"""Severity from class, power, deviation and exposure."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pyrogrid import constants as K
from pyrogrid.functions.physics import lookup
from pyrogrid.functions.text import fixed

SUPPRESSED_TEXT = "Offshore marine thermal cluster suppressed from terrestrial alerting"


def severity(
    cls: Column,
    frp_mw: Column,
    suppressed: Column,
    deviation_z: Column | None = None,
    population: Column | None = None,
) -> tuple[Column, Column]:
    """(level, rationale).  Confidence is no input, by intent."""
    z = F.lit(None).cast("double") if deviation_z is None else deviation_z
    people = F.lit(None).cast("long") if population is None else population
    power = F.when(frp_mw >= 0, frp_mw).otherwise(F.lit(0.0))
    flare = cls == "FLARE"
    base = lookup(K.BASE_SEVERITY, cls, F.lit(1))
    # fixed values: power steps in MW for flares and for other classes
    high, raised = F.when(flare, 150).otherwise(50), F.when(flare, 80).otherwise(20)
    by_power = F.when(power >= high, 2).when(power >= raised, 1).otherwise(0)
    by_z = F.when(z >= 5.0, 2).when(z >= 3.0, 1).otherwise(0)
    by_people = F.when(people > 10_000, 1).otherwise(0)
    level_names = F.array(*[F.lit(x) for x in K.SEVERITY_LEVELS])
    score = F.greatest(F.lit(0), F.least(F.lit(3), base + by_power + by_z + by_people))

    def name(i: Column) -> Column:
        return F.element_at(level_names, i + 1)

    shown = fixed(power, 1)
    notes = F.concat_ws(
        "; ",
        F.concat(F.lit("Base hazard for "), cls, F.lit(": "), name(base)),
        F.when(
            by_power == 2,
            F.concat(F.lit("High thermal intensity (FRP "), shown, F.lit(" MW >= "), high, F.lit(" MW: +2)")),
        ).when(
            by_power == 1,
            F.concat(
                F.lit("Elevated thermal intensity (FRP "), shown, F.lit(" MW >= "), raised, F.lit(" MW: +1)")
            ),
        ),
        F.when(by_z == 2, F.concat(F.lit("Severe baseline departure (z="), fixed(z, 1), F.lit(" >= 5.0: +2)"))).when(
            by_z == 1, F.concat(F.lit("Significant baseline departure (z="), fixed(z, 1), F.lit(" >= 3.0: +1)"))
        ),
        F.when(
            by_people == 1,
            F.concat(
                F.lit("High population exposure ("), F.format_number(people, 0),
                F.lit(" persons in impact radius: +1)"),
            ),
        ),
    )
    return (
        F.when(suppressed, "LOW").otherwise(name(score)),
        F.when(suppressed, SUPPRESSED_TEXT).otherwise(notes),
    )
