"""Planck radiation, sub-pixel temperature retrieval and emission rates."""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

from pyrogrid import constants as K
from pyrogrid.functions.text import rounded

# False-position steps on the log balance over 1/T, which is almost linear there;
# the tests compare the result with plain halving.
ROOT_STEPS = 12


def planck_radiance(lam_um: float, temp: Column) -> Column:
    """Spectral radiance at one wavelength; null for non-positive temperatures."""
    exponent = F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.lit(K.C2 / lam_um) / temp))
    return F.when(temp > 0, F.lit(K.C1 / lam_um ** 5) / F.expm1(exponent))


def brightness_temp(lam_um: float, radiance: Column) -> Column:
    """Temperature of a black body with this radiance; null for non-positive input."""
    return F.when(
        radiance > 0, F.lit(K.C2 / lam_um) / F.log1p(F.lit(K.C1 / lam_um ** 5) / radiance)
    )


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it on, instead of repeating its expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def retrieve_temperature(ti4: Column, ti5: Column, area_m2: Column, background: Column) -> Column:
    """Sub-pixel fire retrieval from two brightness temperatures.

    Returns struct(t_fire_K, t_bg_K, frac, frp_derived_MW, converged, flags).

    Between background and 3000 K the two-band balance changes sign at most once,
    because the ratio of the bands' excess radiances grows with temperature.  So a
    bracketing search over the same range finds the same root as a step-by-step
    scan; the range starts half a kelvin above background and ends on the last
    half-kelvin step not above 3000 K.
    """
    own_background = background.isNull() | (background >= ti5)
    bg = F.when(own_background, ti5).otherwise(background)
    first = bg + K.RETRIEVAL_STEP_K
    steps = F.floor((F.lit(K.RETRIEVAL_MAX_K + 0.01) - first) / K.RETRIEVAL_STEP_K)
    known = F.struct(
        own_background.alias("own"),
        background.isNull().alias("no_bg"),
        bg.alias("bg"),
        planck_radiance(K.LAM_MIR, ti4).alias("l4"),
        planck_radiance(K.LAM_TIR, ti5).alias("l5"),
        planck_radiance(K.LAM_MIR, bg).alias("b4"),
        planck_radiance(K.LAM_TIR, bg).alias("b5"),
        first.alias("lo"),
        (first + steps * K.RETRIEVAL_STEP_K).alias("hi"),
    )

    def balance(k: Column, temp: Column) -> Column:
        return (k.l4 - k.b4) * (planck_radiance(K.LAM_TIR, temp) - k.b5) - (k.l5 - k.b5) * (
            planck_radiance(K.LAM_MIR, temp) - k.b4
        )

    def log_excess(k: Column, u: Column) -> Column:
        """Log of the band balance at temperature 1/u; close to a line in u."""
        temp = F.lit(1.0) / u
        return F.log((k.l4 - k.b4) * (planck_radiance(K.LAM_TIR, temp) - k.b5)) - F.log(
            (k.l5 - k.b5) * (planck_radiance(K.LAM_MIR, temp) - k.b4)
        )

    def bracket(k: Column) -> Column:
        ends = F.struct(
            (F.lit(1.0) / k.lo).alias("ua"),
            log_excess(k, F.lit(1.0) / k.lo).alias("fa"),
            (F.lit(1.0) / k.hi).alias("ub"),
            log_excess(k, F.lit(1.0) / k.hi).alias("fb"),
        )

        def narrow(acc: Column, _: Column) -> Column:
            """One false-position step; an end kept twice counts half (Illinois rule)."""
            cut = (acc.ua * acc.fb - acc.ub * acc.fa) / (acc.fb - acc.fa)
            return F.when((acc.fb == 0) | (acc.ua == acc.ub), acc).otherwise(
                _let(
                    F.struct(cut.alias("u")),
                    lambda c: _let(
                        F.struct(c.u.alias("u"), log_excess(k, c.u).alias("f")),
                        lambda n: F.struct(
                            F.when(n.f * acc.fb < 0, acc.ub).otherwise(acc.ua).alias("ua"),
                            F.when(n.f * acc.fb < 0, acc.fb).otherwise(acc.fa / 2).alias("fa"),
                            n.u.alias("ub"),
                            n.f.alias("fb"),
                        ),
                    ),
                )
            )

        return F.aggregate(
            F.sequence(F.lit(1), F.lit(ROOT_STEPS)), ends, narrow, lambda acc: F.lit(1.0) / acc.ub
        )

    def root(k: Column) -> Column:
        at_start = balance(k, k.lo)
        return F.when(at_start == 0, k.lo).when(at_start * balance(k, k.hi) < 0, bracket(k))

    def flag(k: Column) -> Column:
        return (
            F.when(k.l4 <= k.b4 * K.MIR_EXCESS_RATIO, "NO_MIR_EXCESS")
            .when(k.own & k.no_bg, "NO_ROOT")
            .when(k.own, "BACKGROUND_UNAVAILABLE")
            .when(k.l5 <= k.b5, "NO_TIR_EXCESS")
        )

    def outcome(k: Column) -> Column:
        return _let(
            F.when(flag(k).isNull(), root(k)),
            lambda t: _let(
                (k.l4 - k.b4) / (planck_radiance(K.LAM_MIR, t) - k.b4),
                lambda raw: _let(
                    F.when(t.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(sys.float_info.epsilon), raw))),
                    lambda frac: F.struct(
                        t.alias("t_fire_K"),
                        k.bg.alias("t_bg_K"),
                        F.coalesce(frac, F.lit(0.0)).alias("frac"),
                        (frac * area_m2 * K.SIGMA * F.pow(t, F.lit(4.0)) / 1e6).alias("frp_derived_MW"),
                        t.isNotNull().alias("converged"),
                        F.when(t.isNull(), F.array(F.coalesce(flag(k), F.lit("NO_ROOT"))))
                        .when(frac != raw, F.array(F.lit("P_CLIPPED")))
                        .otherwise(F.array().cast("array<string>"))
                        .alias("flags"),
                    ),
                ),
            ),
        )

    return F.when(area_m2 > 0, _let(known, outcome))


def lookup(table: dict, key: Column, default: Column | None = None) -> Column:
    """Constant map lookup; ``default`` (or null) for other keys."""
    pairs = [F.lit(v) for item in table.items() for v in item]
    found = F.element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, default)


def emission_rates(cls: Column, power_mw: Column) -> tuple[Column, Column]:
    """(t CO2e per hour, kg black carbon per hour), 4 decimals, 0 without power."""
    usable = power_mw.isNotNull() & ~F.isnan(power_mw) & (power_mw > 0)
    rates = []
    for part in (0, 1):
        factors = {c: f[part] for c, f in K.EMISSION_FACTORS.items()}
        factor = lookup(factors, cls, F.lit(factors[K.DEFAULT_EMISSION_CLASS]))
        rates.append(F.when(usable, rounded(power_mw * 3.6 * factor, 4)).otherwise(F.lit(0.0)))
    return rates[0], rates[1]
