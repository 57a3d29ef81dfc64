"""The whole run: five stages, then the cohort panel."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import InheritableThread
from pyspark.sql import DataFrame

from ..operators.grid import BLOCK_LIMIT, with_length
from ..sources.stages import keep
from . import cohort, fluid, panel, pressor, procedures

Tables = dict[str, DataFrame]
Sink = Callable[[str, DataFrame], DataFrame]


def fluid_inputs(tables: Tables) -> list[DataFrame]:
    names = ["inputevents", "outputevents", "chartevents", "urine_output", "icustay_times"]
    return [tables[n] for n in names]


def stages(tables: Tables, sink: Sink) -> Tables:
    """The stage tables by name, each handed to ``sink``."""
    times, given = tables["icustay_times"], tables["inputevents"]

    def pressors() -> Tables:
        hourly = sink("vasopressor_hourly", pressor.hourly(given, times))
        return {"vasopressor_hourly": hourly, "vasopressor": sink("vasopressor", pressor.daily(hourly))}

    def fluids() -> Tables:
        lengths = with_length(times)
        inputs = fluid_inputs(tables)
        _, outputs, charts, urine, _ = inputs
        at_hand = side_by_side(
            {
                "totals": lambda: sink("input_totals", fluid.input_totals(given, lengths)),
                "points": lambda: sink("fluid_points", fluid.fluid_points(outputs, charts, urine, lengths)),
            }
        )
        return side_by_side(
            {
                "fluid_hourly": lambda: sink("fluid_hourly", fluid.hourly(*inputs, **at_hand)),
                "fluid_balance": lambda: sink("fluid_balance", fluid.daily(*inputs, **at_hand)),
            }
        )

    def echo() -> Tables:
        return {"tte": sink("tte", procedures.per_stay(tables["procedureevents"], times))}

    parts = side_by_side({"pressors": pressors, "fluids": fluids, "echo": echo})
    return {name: df for part in parts.values() for name, df in part.items()}


def side_by_side(steps: dict[str, Callable]) -> dict:
    """Results of independent steps by name; their Spark jobs share the cluster.

    The threads take over the caller's job group and pool.  The first failure is raised once
    all steps have ended.
    """
    results, failures = {}, []

    def work(name: str, step: Callable) -> None:
        try:
            results[name] = step()
        except BaseException as failure:
            failures.append(failure)

    threads = [InheritableThread(target=work, args=item) for item in steps.items()]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    if failures:
        raise failures[0]
    return {name: results[name] for name in steps}


def base(tables: Tables, built: Tables, sink: Sink = keep) -> DataFrame:
    """One wide row per stay of the cohort.

    The exposed stays are read twice, once for their ids, so ``sink`` should store them.
    """
    t = tables
    stays = cohort.stays_with_outcome(
        t["icustays"], t["icustay_detail"], t["icustay_times"], t["admissions"], t["services"]
    )
    stays = cohort.septic(cohort.eligible(stays, t["diagnoses_icd"]), t["sepsis3"])
    stays = cohort.with_admission(cohort.first_stays(stays), t["admissions"], t["patients"])
    stays = sink("exposed", cohort.exposed(stays, built["vasopressor"]))
    ids = stays.select("stay_id")
    return cohort.with_covariates(
        stays,
        t["first_day_weight"],
        t["apsiii"],
        t["charlson"],
        t["kdigo_stages"],
        t["rrt"],
        None,
        built["fluid_balance"],
        cohort.scores_by_day(t["sofa"].join(ids, "stay_id", "left_semi")),
    )


def events(tables: Tables, base: DataFrame, sink: Sink = keep) -> dict:
    """Treatment events of the cohort.

    They are few next to their sources and read twice, so ``sink`` should store them.
    """
    t = tables
    doses = [t[n] for n in ("dobutamine", "inputevents", "epinephrine", "vasopressin")]
    rows = {
        "bolus": cohort.base_boluses(t["inputevents"], base),
        "diuretic": cohort.diuretics(t["prescriptions"], t["pharmacy"], base),
        "rate_control": cohort.rate_control(t["prescriptions"], t["pharmacy"], base),
        "monitor": cohort.first_monitor(t["vitals"], base),
        "episodes": cohort.drug_episodes(*doses, base),
    }
    return side_by_side({n: (lambda n=n, df=df: sink(n, df)) for n, df in rows.items()})


def cohort_panel(
    tables: Tables, built: Tables, base: DataFrame, sink: Sink = keep, limit: int = BLOCK_LIMIT
) -> DataFrame:
    """The panel for the stays in ``base``; ``base`` should be a stage, it is read many times.

    ``limit``: minutes of a stay that the blocks, and the first procedure, may lie in.
    """
    ids = base.select("stay_id")

    def own(df: DataFrame) -> DataFrame:
        return df.join(ids, "stay_id", "left_semi")

    e = events(tables, base, sink)
    first = sink("first_procedure", cohort.first_procedure(base, built["tte"], limit))
    after = cohort.after_procedure(
        first, e["bolus"], e["episodes"], e["diuretic"], e["rate_control"], e["monitor"]
    )
    grid = panel.blocks(base, tables["icustay_times"], limit)
    vent = panel.ventilation_intervals(own(tables["ventilation"]), tables["icustay_times"])
    summed = [
        panel.pressor_blocks(own(built["vasopressor_hourly"])),
        panel.bolus_blocks(e["bolus"]),
        panel.ventilation_blocks(vent, limit),
        panel.oxygen_blocks(own(tables["oxygen_treat"])),
        panel.diuretic_blocks(e["diuretic"]),
        panel.rate_control_blocks(e["rate_control"]),
        panel.monitor_blocks(e["monitor"]),
    ]
    return panel.panel(
        base,
        grid,
        after,
        summed,
        panel.balance_blocks(own(built["fluid_hourly"])),
        panel.score_blocks(own(tables["sofa"]), grid),
        panel.first_changes(panel.change_blocks(e["episodes"])),
    )


#: What a run leaves behind for its users; all other stages are helpers.
PUBLIC = ("vasopressor_hourly", "vasopressor", "fluid_hourly", "fluid_balance", "tte")


def run(tables: Tables, sink: Sink, limit: int = BLOCK_LIMIT) -> DataFrame:
    """All stages through ``sink``, then the ordered panel."""
    built = stages(tables, sink)
    cohort_base = sink("cohort_base", base(tables, built, sink))
    # a sort samples its input first: it reads a stage, so that the joins run once
    return sink("panel", cohort_panel(tables, built, cohort_base, sink, limit)).orderBy("stay_id", "block")
