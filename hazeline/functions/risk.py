"""Concentration to health: bands, excess risk, impact and advice as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from hazeline.functions import constants as K
from hazeline.functions.numeric import null_if_nan, round_stable


def _by_upper_bound(pm25: Column, steps, above: str) -> Column:
    """First text whose upper bound is not exceeded, else ``above``."""
    out = None
    for bound, text in steps:
        hit = pm25 <= F.lit(bound)
        out = F.when(hit, text) if out is None else out.when(hit, text)
    return out.otherwise(above)


def risk_band(pm25: Column) -> Column:
    """Six-level band; zero, negative and missing readings, NaN included, are Unknown."""
    pm25 = null_if_nan(pm25)
    known = _by_upper_bound(pm25, [(b, label) for b, label, _ in K.RISK_BANDS], K.RISK_TOP[0])
    return F.when(pm25 > 0, known).otherwise(K.RISK_UNKNOWN)


def risk_message(pm25: Column) -> Column:
    """The message of the band, NULL for Unknown."""
    pm25 = null_if_nan(pm25)
    known = _by_upper_bound(pm25, [(b, text) for b, _, text in K.RISK_BANDS], K.RISK_TOP[1])
    return F.when(pm25 > 0, known)


def estimator_category(pm25: Column) -> Column:
    """P10: category and colour of the health estimator as a struct; missing counts as Hazardous."""
    label = _by_upper_bound(pm25, [(b, name) for b, name, _ in K.ESTIMATOR_CATEGORIES], K.ESTIMATOR_TOP[0])
    color = _by_upper_bound(pm25, [(b, hue) for b, _, hue in K.ESTIMATOR_CATEGORIES], K.ESTIMATOR_TOP[1])
    return F.struct(label.alias("category"), color.alias("color"))


def relative_risk(pm25: Column, coefficient: float) -> Column:
    """Relative risk against the annual guideline; NULL at or below it and for a missing reading."""
    pm25 = null_if_nan(pm25)
    steps = (pm25 - F.lit(K.GUIDELINE_ANNUAL)) / F.lit(10.0)
    return F.when(pm25 > K.GUIDELINE_ANNUAL, F.pow(F.lit(coefficient), steps))


def excess_percent(pm25: Column, coefficient: float) -> Column:
    """Excess risk in percent, one decimal; NULL at or below the guideline."""
    return round_stable((relative_risk(pm25, coefficient) - 1) * 100, 1)


def excess_risk_columns(pm25: Column) -> list[Column]:
    """One percent column per outcome of the short form."""
    return [
        excess_percent(pm25, coef).alias(f"{name}_excess_pct")
        for name, coef, _ in K.RISK_COEFFICIENTS
        if name in K.SHORT_OUTCOMES
    ]


def excess_risk_entries(pm25: Column) -> Column:
    """Array of (outcome, relative_risk, excess_risk_percent, description); empty at or below the guideline."""
    entries = F.array(*[
        F.struct(
            F.lit(name).alias("outcome"),
            round_stable(relative_risk(pm25, coef), 3).alias("relative_risk"),
            excess_percent(pm25, coef).alias("excess_risk_percent"),
            F.lit(text).alias("description"),
        )
        for name, coef, text in K.RISK_COEFFICIENTS
    ])
    return F.filter(entries, lambda e: e["relative_risk"].isNotNull())


def excess_risk_map(pm25: Column) -> Column:
    """P12 as a map keyed by outcome."""
    return F.map_from_entries(F.transform(
        excess_risk_entries(pm25),
        lambda e: F.struct(e["outcome"], F.struct(e["relative_risk"], e["excess_risk_percent"], e["description"])),
    ))


def population_impact_columns(pm25_mean: Column, population: int = 1_000_000) -> list[Column]:
    """Yearly cases for a population, rounded to whole cases."""
    excess = F.greatest(F.lit(0.0), pm25_mean - F.lit(K.GUIDELINE_ANNUAL))
    excess = F.when(pm25_mean.isNotNull(), excess)
    return [round_stable(F.lit(population * rate) * excess, 0).alias(name) for name, rate in K.IMPACT_RATES]


def recommendation(pm25: Column) -> Column:
    """General recommendation; NULL for a missing reading."""
    return F.when(pm25.isNotNull(), _by_upper_bound(pm25, K.RECOMMENDATIONS, K.RECOMMENDATION_TOP))


def profile_of_choice(choice: Column) -> Column:
    """Menu choice to profile, falling back to the default profile."""
    names = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in K.PROFILE_CHOICES.items()))
    return F.coalesce(F.try_element_at(names, choice), F.lit(K.DEFAULT_PROFILE))


def profile_advice(profile: Column, pm25: Column) -> Column:
    """Advice for a profile; an unknown profile is treated as the last one listed."""
    out = None
    *named, last = K.PROFILE_ADVICE.items()
    for name, (steps, above) in named:
        text = _by_upper_bound(pm25, steps, above)
        out = F.when(profile == name, text) if out is None else out.when(profile == name, text)
    return F.when(pm25.isNotNull(), out.otherwise(_by_upper_bound(pm25, *last[1])))


def district_display_name(slug: Column) -> Column:
    """Display name of a slug; unknown slugs stay as they are."""
    names = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in K.DISTRICT_NAMES.items()))
    return F.coalesce(F.try_element_at(names, slug), slug)
