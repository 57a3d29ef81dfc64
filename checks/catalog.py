"""Every registered query with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stayline.functions import codes
from stayline.functions.numbers import sixtieths
from stayline.operators.grid import hour_grid, with_length
from stayline.operators.shape import leading_rows
from stayline.plans import cohort, fluid, panel, pressor, procedures, study
from stayline.session import tune

from . import oracles
from .standins import Tables, clinical_tables, sink

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(body: str):
    """Register a function of the clinical tables together with its SQL twin."""

    def register(build: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(clinical_tables(tune(spark), folder))

        QUERIES[build.__name__] = run
        ORACLES[build.__name__] = oracles.sql(body)
        return build

    return register


def sixes(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: six(F.col(n)) for n in names})


def six(value: Column) -> Column:
    """Six decimals, nudged off exact halves so that both engines round alike."""
    return F.rint((value + 0.000000033) * 1e6) / 1e6


def lengths(t: Tables) -> DataFrame:
    return with_length(t["icustay_times"])


# --- offsets and vasoactive drugs ---------------------------------------------------

@query(f"select stay_id, charttime, o as minute_offset, {oracles.six('value')} as urine from urine_points")
def minute_offsets(t):
    rows = fluid.placed(fluid.urine_points(t["urine_output"]), lengths(t))
    return rows.select(
        "stay_id", "charttime", F.col("offset").alias("minute_offset"), six(F.col("value")).alias("urine")
    )


@query(
    f"select stay_id, drug, starttime, b as begin_offset, e as end_offset, {oracles.six('rate')} as rate"
    " from pressor_rows"
)
def infusion_extract(t):
    return sixes(pressor.infusions(t["inputevents"], lengths(t)), "rate").drop("los_min")


_RATES = [*codes.PRESSORS, "vasopressor_rate"]


@query(f"select stay_id, hr, {', '.join(f'{oracles.six(d)} as {d}' for d in _RATES)} from pressor_hours")
def rate_hourly_mean(t):
    hourly = pressor.hourly(t["inputevents"], t["icustay_times"])
    return hourly.withColumns({d: six(F.col(d)) for d in _RATES})


@query("select * from pressor_days")
def rate_daily_max_wide(t):
    return pressor.daily(pressor.hourly(t["inputevents"], t["icustay_times"]))


# --- procedures --------------------------------------------------------------------

@query("select * from echo_kept")
def procedure_dedup(t):
    return procedures.deduplicated(procedures.charted(t["procedureevents"], t["icustay_times"]))


def _echo(t) -> DataFrame:
    return procedures.per_stay(t["procedureevents"], t["icustay_times"])


@query("select * from echo")
def procedure_pivot(t):
    return _echo(t)


# --- fluid extracts ----------------------------------------------------------------

def _bolus_side(t, side: str) -> DataFrame:
    return fluid.boluses(t["inputevents"], t["icustay_times"]).select(
        "stay_id", "bolus_offset", six(F.col(side)).alias(side)
    ).filter(F.col(side).isNotNull())


@query(
    f"""select stay_id, bolus_offset, {oracles.six('cristalloid_bolus')} as cristalloid_bolus from bolus
    where cristalloid_bolus is not null"""
)
def bolus_crystalloid(t):
    return _bolus_side(t, "cristalloid_bolus")


@query(
    f"""select stay_id, bolus_offset, {oracles.six('colloid_bolus')} as colloid_bolus from bolus
    where colloid_bolus is not null"""
)
def bolus_colloid(t):
    return _bolus_side(t, "colloid_bolus")


@query(
    f"""select stay_id, bolus_offset, {oracles.six('cristalloid_bolus')} as cristalloid_bolus,
        {oracles.six('colloid_bolus')} as colloid_bolus from bolus"""
)
def bolus_merge(t):
    rows = fluid.boluses(t["inputevents"], t["icustay_times"]).drop("los_min")
    return sixes(rows, "cristalloid_bolus", "colloid_bolus")


@query(
    f"""select stay_id, orderid, kind, s as start_offset, e as end_offset, {oracles.six('amount')} as amount,
        {oracles.six('rate')} as rate
    from (select *, 'intake' as kind from intake_orders union all select *, 'blood' from blood_orders) r"""
)
def order_rollup(t):
    rows = fluid.orders(t["inputevents"], lengths(t)).select(
        "stay_id", F.col("place").alias("orderid"), "kind", "start_offset", "end_offset", "amount", "rate"
    )
    return sixes(rows, "amount", "rate")


@query(
    f"""select stay_id, s as start_offset, e as end_offset, {oracles.six('amount')} as amount,
        {oracles.six('rate')} as rate, minute_amount, voids
    from voids join (select stay_id, o as e, {oracles.six('sum(value)')} as minute_amount, count(*) as voids
        from urine_points group by stay_id, o) m using (stay_id, e)
    where place = 1"""
)
def void_rate(t):
    rows = fluid.void_intervals(t["urine_output"], lengths(t)).drop("los_min")
    return sixes(rows, "amount", "rate", "minute_amount")


def _charted(rows: DataFrame, t) -> DataFrame:
    return sixes(fluid.charted(rows, lengths(t)), "value")


@query(
    f"""select stay_id, charttime, o as "offset", {oracles.six('value')} as value, 'hourly' as list
    from output_hourly_points union all
    select stay_id, charttime, o, {oracles.six('value')}, 'daily' from output_daily_points"""
)
def signed_output(t):
    hourly = _charted(fluid.output_points(t["outputevents"], codes.HOURLY_OUTPUT_ITEMS), t)
    daily = _charted(fluid.output_points(t["outputevents"], codes.DAILY_OUTPUT_ITEMS), t)
    return hourly.withColumn("list", F.lit("hourly")).unionByName(daily.withColumn("list", F.lit("daily")))


@query(f'select stay_id, charttime, o as "offset", {oracles.six('value')} as value from dialysis_points')
def dialysis_net(t):
    return _charted(fluid.dialysis_points(t["chartevents"]), t)


# --- hours -------------------------------------------------------------------------

@query("select stay_id, hr from hour_bounds")
def hour_grid_rows(t):
    return hour_grid(lengths(t))


@query(
    f"""select stay_id, hr, kind, {oracles.six('v')} as value from (
        select *, 'urine' as kind from hour_urine union all select *, 'output' from hour_output
        union all select *, 'dialysis' from hour_dialysis) r"""
)
def hour_points(t):
    points = (
        fluid.urine_points(t["urine_output"])
        .unionByName(fluid.output_points(t["outputevents"], codes.HOURLY_OUTPUT_ITEMS))
        .unionByName(fluid.dialysis_points(t["chartevents"]))
    )
    hours = fluid.point_hours(fluid.placed(points, lengths(t)))
    return sixes(hours.groupBy("stay_id", "hr", "kind").agg(F.sum("value").alias("value")), "value")


@query(
    f"""select stay_id, hr, {oracles.six('c')} as cristalloid_bolus, {oracles.six('a')} as colloid_bolus
    from hour_bolus"""
)
def hour_bolus(t):
    given = fluid.input_totals(t["inputevents"], lengths(t))
    hours = fluid.bolus_hours(fluid.bolus_sums(given)).groupBy("stay_id", "hr").agg(
        F.sum("cristalloid_bolus").alias("cristalloid_bolus"), F.sum("colloid_bolus").alias("colloid_bolus")
    )
    return sixes(hours, "cristalloid_bolus", "colloid_bolus")


def _shares(rows: DataFrame) -> DataFrame:
    sums = rows.groupBy("stay_id", "hr").agg(F.sum("value").alias("value"))
    return sums.withColumn("value", six(sixtieths(F.col("value"))))


def _prorated_orders(t, kind: str) -> DataFrame:
    given = fluid.orders(t["inputevents"], lengths(t)).filter(F.col("kind") == kind)
    return _shares(fluid.hour_shares(given, F.col("amount") * 60))


@query(f"select stay_id, hr, {oracles.six('v / 60')} as value from hour_intake")
def prorate_intake(t):
    return _prorated_orders(t, "intake")


@query(f"select stay_id, hr, {oracles.six('v / 60')} as value from hour_blood")
def prorate_blood(t):
    return _prorated_orders(t, "blood")


@query(f"select stay_id, hr, {oracles.six('v / 60')} as value from hour_void")
def prorate_void(t):
    voids = fluid.void_intervals(t["urine_output"], lengths(t))
    return _shares(fluid.hour_shares(voids, F.lit(0)))


@query("select * from fluid_hours")
def hourly_balance_running(t):
    return fluid.hourly(*study.fluid_inputs(t))


@query("select * from fluid_days")
def daily_balance_wide(t):
    return fluid.daily(*study.fluid_inputs(t))


@query("select * from fluid_hours")
def stage_sink_readback(t):
    return sink(t.spark)("fluid_hourly", fluid.hourly(*study.fluid_inputs(t)))


# --- cohort ------------------------------------------------------------------------

def _stay_rows(t) -> DataFrame:
    names = ["icustays", "icustay_detail", "icustay_times", "admissions", "services"]
    return cohort.stays_with_outcome(*[t[n] for n in names])


def _listed(stays: DataFrame) -> DataFrame:
    """Without the flag that is carried along for the renal status."""
    return stays.drop("hx")


def _septic(t) -> DataFrame:
    return cohort.septic(cohort.eligible(_stay_rows(t), t["diagnoses_icd"]), t["sepsis3"])


def _admitted(t) -> DataFrame:
    return cohort.with_admission(cohort.first_stays(_septic(t)), t["admissions"], t["patients"])


def _wide_stages(t) -> dict[str, DataFrame]:
    return {
        "vasopressor": pressor.daily(pressor.hourly(t["inputevents"], t["icustay_times"])),
        "fluid_balance": fluid.daily(*study.fluid_inputs(t)),
    }


def _base(t) -> DataFrame:
    """The cohort as a stage, built once: the queries below start from it."""
    if "cohort_base" not in t:
        t["cohort_base"] = t.written("cohort_base", study.base(t, _wide_stages(t), t.written))
    return t["cohort_base"]


def _episodes(t, base: DataFrame) -> DataFrame:
    doses = [t[n] for n in ("dobutamine", "inputevents", "epinephrine", "vasopressin")]
    return cohort.drug_episodes(*doses, base)


def _procedures(t, base: DataFrame) -> DataFrame:
    return sink(t.spark)("first_procedure", cohort.first_procedure(base, _echo(t)))


@query("select * from first_service_rows")
def first_service(t):
    return cohort.first_services(t["services"])


@query("select * from stay_rows")
def stay_outcomes(t):
    return _stay_rows(t)


@query("select stay_id, race from stay_rows")
def text_class(t):
    return _stay_rows(t).select("stay_id", "race")


@query(
    f"""select hadm_id, bool_or(seq_num in (1, 2) and icd_code in ({oracles._list(codes.ARREST_CODES)}))::int
    as card_arrest from diagnoses_icd group by hadm_id"""
)
def code_flag(t):
    return cohort.diagnosis_flags(t["diagnoses_icd"]).select("hadm_id", "card_arrest")


@query("select * from eligible")
def eligibility(t):
    return _listed(cohort.eligible(_stay_rows(t), t["diagnoses_icd"]))


@query("select * from septic")
def sepsis_window(t):
    return _listed(_septic(t))


@query("select * from first_stay_rows")
def first_stay(t):
    return _listed(cohort.first_stays(_septic(t)))


@query("select * from admitted")
def year_period(t):
    return _listed(_admitted(t))


@query("select * from renal_rows")
def stage_precedence(t):
    rows = cohort.with_renal_status(_admitted(t), t["kdigo_stages"], t["rrt"])
    return rows.select("stay_id", "hx_dialysis", "kdigo")


@query("select * from score_days")
def last_score_by_day(t):
    return cohort.scores_by_day(t["sofa"])


def _covariates(t) -> DataFrame:
    built = _wide_stages(t)
    known = [t[n] for n in ("first_day_weight", "apsiii", "charlson", "kdigo_stages", "rrt")]
    wide = [built["vasopressor"], built["fluid_balance"], cohort.scores_by_day(t["sofa"])]
    return cohort.with_covariates(_admitted(t), *known, *wide)


@query("select * from covariates")
def covariates_wide(t):
    return _covariates(t)


@query("select * from base")
def exposed_only(t):
    return study.base(t, _wide_stages(t), sink(t.spark))


@query("select stay_id, tte, tte_start1, t as tte_offset, tte_number from first_echo")
def first_procedure_5d(t):
    return _procedures(t, study.base(t, _wide_stages(t), sink(t.spark)))


@query(
    " union all ".join(
        f"select '{n}' as drug, stay_id, starttime, b as begin_offset, e as end_offset, rate, change, is_end"
        f" from episodes_of_{n}"
        for n in panel.DRUGS
    )
)
def drug_episodes(t):
    return _episodes(t, _base(t))


@query("select stay_id, starttime, o as diuretic_offset, diuretic_amount, diuretic_infusion from diuretic_rows")
def dose_equivalents(t):
    return cohort.diuretics(t["prescriptions"], t["pharmacy"], _base(t))


@query("select stay_id, starttime, o as betablocker_offset, betablocker, calcium_antagonist from rate_control_rows")
def drug_flags(t):
    return cohort.rate_control(t["prescriptions"], t["pharmacy"], _base(t))


@query("select stay_id, co_time, o as co_offset, co from monitor_rows")
def first_monitor(t):
    return cohort.first_monitor(t["vitals"], _base(t))


@query(
    f"""select stay_id, bolus_offset, {oracles.six('cristalloid_bolus')} as cristalloid_bolus,
        {oracles.six('albumin_bolus')} as albumin_bolus from base_bolus"""
)
def cohort_bolus(t):
    return sixes(cohort.base_boluses(t["inputevents"], _base(t)), "cristalloid_bolus", "albumin_bolus")


@query("select * from after_echo")
def post_procedure_changes(t):
    base = _base(t)
    e = study.events(t, base)
    after = cohort.after_procedure(
        _procedures(t, base), e["bolus"], e["episodes"], e["diuretic"], e["rate_control"], e["monitor"]
    )
    return after


# --- blocks ------------------------------------------------------------------------

@query("select stay_id, block, ms as minute_start, me as minute_end from block_bounds")
def block_grid_rows(t):
    return panel.blocks(_base(t), t["icustay_times"])


def _on_grid(rows: DataFrame, t, base: DataFrame) -> DataFrame:
    grid = panel.blocks(base, t["icustay_times"]).select("stay_id", "block")
    return rows.join(grid, ["stay_id", "block"], "left_semi")


@query("select stay_id, block, vent from block_vent")
def vent_blocks(t):
    base = _base(t)
    vent = panel.ventilation_intervals(t["ventilation"], t["icustay_times"])
    return _on_grid(panel.ventilation_blocks(vent), t, base)


@query(
    " union all ".join(
        f"select '{n}' as drug, stay_id, block, {n}_rate as rate, {n}_change as change from blocks_of_{n}"
        for n in panel.DRUGS
    )
)
def block_drug_change(t):
    base = _base(t)
    rows = panel.change_blocks(_episodes(t, base))
    first = leading_rows(rows, ["drug", "stay_id", "block"], [F.col("begin_offset")]).drop("begin_offset")
    return _on_grid(first, t, base)


def _own(rows: DataFrame, base: DataFrame) -> DataFrame:
    return rows.join(base.select("stay_id"), "stay_id", "left_semi")


@query(
    """select stay_id, block, vasopressor_rate, inotrope, sf_ratio from block_pressor
    full join block_oxygen using (stay_id, block)"""
)
def block_hour_series(t):
    base = _base(t)
    hourly = pressor.hourly(_own(t["inputevents"], base), _own(t["icustay_times"], base))
    parts = [panel.pressor_blocks(hourly), panel.oxygen_blocks(_own(t["oxygen_treat"], base))]
    rows = panel.merged(parts, ["vasopressor_rate", "inotrope", "sf_ratio"])
    return _on_grid(rows, t, base)


@query("select * from block_score")
def block_score_lead(t):
    base = _base(t)
    return panel.score_blocks(_own(t["sofa"], base), panel.blocks(base, t["icustay_times"]))


@query("select * from panel")
def block_panel(t):
    return study.run(t, sink(t.spark))
