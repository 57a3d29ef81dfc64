"""Row-level clinical rules as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import codes
from .numbers import numeric, numeric_text, whole
from .timing import minutes_between


def flag(condition: Column) -> Column:
    """1 where the condition holds, else 0 (also where it is NULL)."""
    return F.when(condition, 1).otherwise(0)


def has_item(items: list[int]) -> Column:
    """``itemid`` is one of a code list; one expression, however long the list."""
    return F.expr(f"itemid in ({', '.join(str(i) for i in items)})")


def any_positive(names: list[str]) -> Column:
    return reduce(or_, [F.col(n) > 0 for n in names])


# --- units -------------------------------------------------------------------------

def millilitres(amount: Column, unit: Column, microlitres: bool) -> Column:
    """Volume in mL; NULL for units that are no volume."""
    ml = F.when(unit.isin(codes.MILLILITRES), amount)
    if microlitres:
        ml = ml.when(unit == codes.MICROLITRES, amount / 1000)
    return numeric(ml.when(unit == codes.LITRES, amount * 1000))


def millilitres_per_hour(rate: Column, unit: Column, weight: Column) -> Column:
    return numeric(
        F.when(unit == "mL/hour", rate)
        .when(unit == "mL/min", rate * 60)
        .when(unit == "mL/kg/hour", rate * weight)
    )


def signed(value: Column, item: Column, inflow_item: int) -> Column:
    """Output volume; positive entries of an in-flow item count against it."""
    return F.when((item == inflow_item) & (value > 0), -value).otherwise(value)


# --- boluses -----------------------------------------------------------------------

def is_crystalloid_bolus() -> Column:
    """Enough volume, and charted as bolus or given fast."""
    large = F.when(F.col("amountuom") == codes.LITRES, F.col("amount") >= 0.25).otherwise(
        F.col("amount") >= 250
    )
    fast = ((F.col("rate") > 500) & (F.col("rateuom") == "mL/hour")) | (
        (F.col("rate") > 8.3) & (F.col("rateuom") == "mL/min")
    )
    return (
        has_item(codes.CRYSTALLOID_ITEMS)
        & large
        & ((F.col("ordercategorydescription") == "Bolus") | fast)
    )


def is_colloid_bolus() -> Column:
    return (
        has_item(codes.COLLOID_ITEMS)
        & (F.col("amount") > 100)
        & ((F.col("rateuom") == "mL/min") | (F.col("rate") > 250))
    )


def crystalloid_amount(whole_rows: bool = False) -> Column:
    ml = millilitres(F.col("amount"), F.col("amountuom"), microlitres=False)
    return whole(ml).cast("double") if whole_rows else ml


def colloid_amount(whole_rows: bool = False) -> Column:
    ml = numeric(F.col("amount"))
    return whole(ml).cast("double") if whole_rows else ml


# --- identity and outcome ----------------------------------------------------------

def race_class(text: Column) -> Column:
    (fragment, label), *rest = codes.RACE_FRAGMENTS
    found = F.when(text.ilike(f"%{fragment}%"), label)
    for fragment, label in rest:
        found = found.when(text.ilike(f"%{fragment}%"), label)
    return found.otherwise("other")


def admission_year(group: Column, anchor_year: Column, admittime: Column) -> Column:
    """Calendar year of an admission whose dates were shifted, from its anchor group."""
    moved = F.year(admittime) - anchor_year
    year = F.lit(None).cast("int")
    for label, first in codes.ANCHOR_YEARS.items():
        year = F.when(group == label, F.lit(first) + moved).otherwise(year)
    return year.cast("int")


def admission_period(year: Column) -> Column:
    return (
        F.when(year < 2011, "2008 - 2010")
        .when(year <= 2013, "2011 - 2013")
        .when(year <= 2016, "2014 - 2016")
        .when(year > 2016, "2017 - 2019")
    )


def renal_stage(history: Column, dialysis: Column, aki_stage: Column) -> Column:
    """Chronic dialysis overrides; a stay without any history record keeps its stage."""
    return (
        F.when(history == 1, F.lit(0))
        .when((history == 0) & (dialysis == 1), F.lit(3))
        .otherwise(aki_stage)
        .cast("int")
    )


def period_of_day(hour: Column) -> Column:
    """Unknown hours count as night."""
    return (
        F.when((hour >= 6) & (hour < 16), "day")
        .when((hour >= 16) & (hour < 22), "evening")
        .otherwise("night")
    )


# --- prescriptions -----------------------------------------------------------------

def is_infused_diuretic() -> Column:
    return F.col("frequency").isin(codes.INFUSION_FREQUENCIES) & F.col("prod_strength").isin(
        codes.INFUSION_STRENGTHS
    )


def is_diuretic_dose() -> Column:
    drugs = codes.LOOP_DIURETICS + codes.BUMETANIDE + codes.ETHACRYNATE
    dose = F.col("dose_val_rx")
    return (
        F.col("drug").isin(drugs)
        & F.col("route").isin(codes.INTRAVENOUS)
        & dose.rlike(codes.DOSE_PATTERN)
        & ~dose.isin(codes.NOT_A_DOSE)
    )


def furosemide_equivalent() -> Column:
    """Dose in whole mg of furosemide; 0 for an infusion, whose dose is a rate."""
    drug, dose = F.col("drug"), numeric_text(F.col("dose_val_rx"))
    factor = (
        F.when(drug.isin(codes.LOOP_DIURETICS), 1.0)
        .when(drug.isin(codes.BUMETANIDE), codes.BUMETANIDE_FACTOR)
        .when(drug.isin(codes.ETHACRYNATE), codes.ETHACRYNATE_FACTOR)
    )
    return whole(F.when(is_infused_diuretic(), 0.0).otherwise(dose * factor))


# --- combined state ----------------------------------------------------------------

def combined_change(changes: list[str]) -> Column:
    """One label for several drugs: any start, else any stop, else none."""
    started = reduce(or_, [F.col(c).eqNullSafe("start") for c in changes])
    stopped = reduce(or_, [F.col(c).eqNullSafe("stop") for c in changes])
    return F.when(started, "start").when(stopped, "stop")


def offset_of(column: str) -> Column:
    """Minutes from the start of the stay (``intime_hr`` on the same row)."""
    return minutes_between(F.col("intime_hr"), F.col(column))
