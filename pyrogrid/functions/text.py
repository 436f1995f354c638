"""Number formatting, narrative sentences and the grounding check."""

from __future__ import annotations

import unicodedata

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pyrogrid import constants as K


def fixed(value: Column, digits: int) -> Column:
    """Text with a fixed number of decimals, exact ties to the even digit."""
    pattern = "0." + "0" * digits if digits else "0"
    return F.call_function("format_number", value, F.lit(pattern))


def rounded(value: Column, digits: int) -> Column:
    """Number rounded on its exact value, ties to the even digit."""
    return fixed(value, digits).cast("double")


EVIDENCE_FIELDS = [
    "conf", "lo", "hi", "dist_facility_m", "t_fire_K", "frp_max", "n_days", "night_frac", "co2e_rate_tph",
]


def evidence(columns: dict[str, Column]) -> Column:
    """Compact evidence struct with the decimals that texts may quote.

    ``columns`` maps cls, conf, lo, hi, facility_name, facility_sector,
    dist_facility_m, t_fire_K, frp_max, n_days, night_frac, diurnal_shape,
    landcover_class, co2e_rate_tph and offshore_suppressed.
    """
    # fixed values: decimals kept per number
    digits = {
        "conf": 4, "lo": 4, "hi": 4, "dist_facility_m": 1, "t_fire_K": 1, "frp_max": 2, "night_frac": 4,
        "co2e_rate_tph": 4,
    }
    defaults = {"frp_max": 0.0, "night_frac": 0.0}
    fields = []
    for name, column in columns.items():
        if name in digits:
            column = rounded(column.cast("double"), digits[name])
            if name in defaults:
                column = F.coalesce(column, F.lit(defaults[name]))
        elif name == "n_days":
            column = F.coalesce(column, F.lit(1))
        elif name != "offshore_suppressed":
            column = F.nullif(column, F.lit(""))
        fields.append(column.alias(name))
    return F.struct(*fields)


def narrative(e: Column) -> Column:
    """struct(text, cited_rule) for an evidence struct: one sentence, two evidences."""
    cls = e["cls"]
    phrases = {
        "temperature": F.when(
            e["t_fire_K"] > 0,
            F.concat(F.lit("retrieved temperature of "), fixed(e["t_fire_K"], 0), F.lit(" K")),
        ),
        "distance": F.concat(
            F.lit("facility proximity of "), fixed(e["dist_facility_m"], 0), F.lit(" m to "),
            F.coalesce(e["facility_name"], e["facility_sector"], F.lit("industrial site")),
        ),
        "days": F.when(
            e["n_days"] > 1, F.concat(F.lit("persistent recurrence over "), e["n_days"].cast("string"), F.lit(" days"))
        ),
        "night": F.when(
            e["night_frac"] >= 0.5, F.concat(F.lit("high nocturnal fraction of "), fixed(e["night_frac"], 2))
        ),
        "power": F.when(
            e["frp_max"] > 0, F.concat(F.lit("peak radiative power of "), fixed(e["frp_max"], 1), F.lit(" MW"))
        ),
        "co2e": F.when(
            e["co2e_rate_tph"] > 0,
            F.concat(F.lit("estimated emission rate of "), fixed(e["co2e_rate_tph"], 2), F.lit(" t/h CO2e")),
        ),
        "diurnal": F.concat(e["diurnal_shape"], F.lit(" diurnal cycle")),
        "landcover": F.concat(e["landcover_class"], F.lit(" landcover classification")),
    }

    def ordered(names: list[str]) -> Column:
        return F.array(*[phrases[n] for n in names])

    pool = reduce(
        lambda chain, item: chain.when(cls == item[0], ordered(item[1])),
        list(K.EVIDENCE_ORDER.items())[1:],
        F.when(cls == "FLARE", ordered(K.EVIDENCE_ORDER["FLARE"])),
    ).otherwise(ordered(K.DEFAULT_EVIDENCE_ORDER))
    present = F.filter(pool, lambda p: p.isNotNull())
    first = F.coalesce(F.get(present, F.lit(0)), F.lit("satellite radiative retrieval"))
    second = F.coalesce(
        F.get(present, F.lit(1)),
        F.when(F.size(present) == 0, "regional thermal anomaly signature").otherwise(
            F.lit("satellite radiative retrieval")
        ),
    )

    def rule(part: int) -> Column:
        chain = F.when((cls == "WILD") & (e["landcover_class"] == "forest"), K.FOREST_RULE[part])
        for name, values in K.STATUTORY_RULES.items():
            chain = chain.when(cls == name, values[part])
        return chain.otherwise(F.lit(K.GENERAL_RULE[part]))

    conf, lo, hi = (fixed(e[n], 2) for n in ("conf", "lo", "hi"))
    band = F.concat(F.lit("["), lo, F.lit("-"), hi, F.lit("]"))
    lead = F.when(
        cls == "LEAK",
        F.concat(F.lit("candidate fugitive thermal anomaly - low confidence ("), conf, F.lit(") "), band),
    ).otherwise(F.concat(cls, F.lit(" alert confirmed with "), conf, F.lit(" confidence "), band))
    text = F.concat(
        lead, F.lit(" driven by "), first, F.lit(" and "), second, F.lit("; implicates "), rule(1),
        F.lit("; "), rule(2), F.lit("."),
    )
    suppressed_text = F.concat(
        cls, F.lit(" alert suppressed with "), conf, F.lit(" confidence "), band,
        F.lit(" driven by marine water landcover and zero inland facility proximity; implicates "),
        F.lit(K.SUPPRESSED_RULE[1]), F.lit("; "), F.lit(K.SUPPRESSED_RULE[2]), F.lit("."),
    )
    suppressed = F.coalesce(e["offshore_suppressed"], F.lit(False))
    return F.struct(
        F.when(suppressed, suppressed_text).otherwise(text).alias("text"),
        F.when(suppressed, K.SUPPRESSED_RULE[0]).otherwise(rule(0)).alias("cited_rule"),
    )


def allowed_numbers(e: Column, fields: list[str] = EVIDENCE_FIELDS) -> Column:
    """Every number a grounded text may contain."""

    def forms(value: Column, digits: list[int]) -> list[Column]:
        return [rounded(value, d) for d in digits]

    numbers = [F.lit(0.0), F.lit(1.0)]
    for name in fields:
        v = e[name].cast("double")
        numbers += forms(v, [4, 3, 2, 1, 0])
        share = F.when(v.between(0.0, 1.0), v * 100.0)
        numbers += forms(share, [2, 1, 0])
        if name == "dist_facility_m":
            numbers += forms(F.when(v > 0, v / 1000.0), [3, 2, 1, 0])
        if name == "t_fire_K":
            numbers += forms(F.when(v > 100, v - 273.15), [1, 0])
    return F.filter(F.array_distinct(F.array(*numbers)), lambda n: n.isNotNull())


# Every decimal digit beyond ASCII up to the end of the basic plane, zeros to nines of one script after another.
OTHER_DIGITS = "".join(chr(c) for c in range(0x80, 0x10000) if unicodedata.category(chr(c)) == "Nd")


def number_tokens(text: Column) -> Column:
    """Standalone decimal numbers of a text.

    A number counts only when no letter or digit of any script touches it.  Decimal
    digits of other scripts count as the digits they are; letters and other numerals
    beyond ASCII are replaced before the ASCII word-boundary match.
    """
    plain = F.translate(text, OTHER_DIGITS, "0123456789" * (len(OTHER_DIGITS) // 10))
    plain = F.regexp_replace(plain, r"[\p{L}\p{N}&&[^\x00-\x7F]]", "a")
    return F.regexp_extract_all(plain, F.lit(r"\b\d+(?:\.\d+)?\b"), 0)


def is_grounded(text: Column, allowed: Column) -> Column:
    """True when every number of a non-empty text is near an allowed number."""

    def near(n: Column, a: Column) -> Column:
        gap = F.abs(n - a)
        return (gap < 1e-3) | ((a != 0) & (gap / F.abs(a) < 1e-3))

    every = F.forall(number_tokens(text), lambda t: F.exists(allowed, lambda a: near(t.cast("double"), a)))
    return F.when(F.length(text) > 0, every).otherwise(F.lit(False))
