"""Plans on hand-made stays, their shape, and a stay that holds most of the rows."""

import importlib
import sys
from datetime import datetime, timedelta
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from checks.catalog import QUERIES
from checks.standins import clinical_tables
from stayline.functions.timing import clock_text
from stayline.operators.grid import hour_grid, with_length
from stayline.plans import cohort, fluid, panel, pressor, procedures, study
from stayline.sources.stages import CatalogStages, Stages, shared_folder
from stayline.sources.tables import SCHEMAS, read_catalog, read_parquet

T0 = datetime(2024, 1, 1)


def at(minutes):
    return None if minutes is None else T0 + timedelta(minutes=minutes)


def table(spark, name, data):
    return spark.createDataFrame(data, SCHEMAS[name])


def times(spark, **los):
    return table(spark, "icustay_times", [(int(k[1:]), T0, at(v)) for k, v in los.items()])


def given(stay, item, start, end, amount=None, unit="mL", rate=None, rate_unit=None, order=1, category=None):
    return (stay, order, item, at(start), at(end), amount, unit, rate, rate_unit, 80.0, category)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_pressor_hours(spark):
    stays = times(spark, s1=89, s2=None, s3=11000)
    inputs = table(
        spark,
        "inputevents",
        [
            given(1, 221906, -30, 30, rate=2.0),
            given(1, 221906, 15, 45, rate=4.0),  # the higher rate wins where both run
            given(1, 221906, 0, 60, rate=5.5),  # charting error
            given(1, 221289, 60, 500, rate=3.0),  # cut at the end of the stay
            given(1, 229709, 0, 60, rate=9.0),
            given(2, 221906, 0, 60, rate=1.0),
            given(3, 221906, 10079, 10090, rate=6.0 - 1.0),
        ],
    )
    hours = pressor.hourly(inputs, stays)
    assert hours.filter("stay_id = 2").count() == 0
    got = rows(hours.filter("stay_id = 1"), "hr", "noradrenalin", "adrenalin", "vasopressor_rate")
    # 15 min of 2, 30 min of 4, 15 min of nothing; then minutes 60..89 only
    assert got == [(0, 2.5, 0.0, 2.5), (1, 0.0, 3.0, 3.0)]
    last = hours.filter("stay_id = 3").orderBy(F.desc("hr")).first()
    assert (last.hr, last.noradrenalin) == (167, pytest.approx(5.0 / 60))


def test_bolus_pairs_count_like_a_full_join(spark):
    stays = times(spark, s1=600)
    bolus = dict(category="Bolus")
    inputs = table(
        spark,
        "inputevents",
        [
            given(1, 225158, 10, 20, 300.0, **bolus),
            given(1, 225158, 10, 30, 0.25, unit="L", **bolus),
            given(1, 220864, 10, 30, 200.0, rate_unit="mL/min"),
            given(1, 220864, 10, 30, 150.0, rate=251.0),
            given(1, 220864, 40, 50, 150.0, rate=251.0),
            given(1, 225158, 50, 60, 249.0, **bolus),
            given(1, 225158, 70, 80, 250.0, rate=500.0, rate_unit="mL/hour"),
            given(1, 225158, 90, 95, 250.0, rate=8.4, rate_unit="mL/min"),
            given(1, 225158, 0, 5, 900.0, **bolus),  # not after the start of the stay
        ],
    )
    got = rows(fluid.boluses(inputs, stays), "bolus_offset", F.coalesce("cristalloid_bolus", F.lit(-1.0)), F.coalesce("colloid_bolus", F.lit(-1.0)))
    # two and two rows at minute 10: each side counts twice
    assert got == [(10, 1100.0, 700.0), (40, -1.0, 150.0), (90, 250.0, -1.0)]
    early = fluid.boluses(inputs, stays, after_start=False)
    assert 0 in [r.bolus_offset for r in early.collect()]


def test_hourly_balance_adds_up(spark):
    stays = times(spark, s1=180)
    inputs = table(
        spark,
        "inputevents",
        [
            given(1, 226453, 30, 150, 200.0, rate=100.0, rate_unit="mL/hour", order=1),
            given(1, 226453, 60, 120, 7.0, order=2),  # no rate: whole amount in each hour
        ],
    )
    outputs = table(spark, "outputevents", [(1, at(60), 226616, 40.0), (1, at(61), 226560, 99.0)])
    charts = table(spark, "chartevents", [(1, at(120), 225806, "30"), (1, at(121), 226499, "n/a")])
    urine = table(spark, "urine_output", [(1, at(0), 11.0), (1, at(90), 90.0), (1, at(90.5), 5.0)])
    hours = fluid.hourly(inputs, outputs, charts, urine, stays)
    got = rows(hours, "hr", "hourly_intake", "hourly_output", "hourly_urine", "est_hourly_urine", "hourly_dialysis", "cumm_hourly_balance")
    assert got == [
        (0, 50, 40, 0, 60, 0, 10),
        (1, 107, 65, 95, 30, -30, 52),
        (2, 50, 0, 0, 0, 0, 102),
        (3, 0, 0, 0, 0, 0, 102),
    ]


def _odd_stays(spark):
    """Stays of unknown and negative length, without a key, and twice with other times or no end."""
    stays = [(1, T0, at(500)), (2, T0, at(300)), (3, T0, None), (4, T0, at(-90)), (5, T0, at(0)), (None, T0, at(130))]
    stays += [(6, T0, at(900)), (6, at(200), at(260)), (7, T0, at(400)), (7, at(60), None), (8, T0, at(240)), (8, T0, at(240))]
    return table(spark, "icustay_times", stays)


def _spreads(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Generate explode(sequence(")


def test_pressor_hours_of_odd_stays(spark):
    """Every hour of a stay once, and none is made before the last shuffle."""
    stays = _odd_stays(spark)
    inputs = table(spark, "inputevents", [given(s, 221906, 70, 100, rate=2.0) for s in (1, 4, 6, 8)])
    hours = pressor.hourly(inputs, stays)
    lengths = with_length(stays).filter("los_min >= 0")
    want = {(r.stay_id, h) for r in lengths.collect() for h in range(r.los_min // 60 + 1)}
    got = [tuple(r) for r in hours.select("stay_id", "hr").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    found = rows(hours.filter("noradrenalin > 0"), "stay_id", "hr", "noradrenalin")
    assert found == [(1, 1, 1.0), (8, 1, 1.0)]  # of the two offsets in stay 6 the earlier counts, before it
    assert hours.filter("dobutamin is null or vasopressor_rate is null").count() == 0
    assert _spreads(hours) == 1  # the infusions; not the grid


def test_fluid_hours_of_odd_stays(spark):
    """Every hour of a stay once, whatever voids it has, without grid rows in the grouping."""
    stays = _odd_stays(spark)
    nothing = [table(spark, n, []) for n in ("outputevents", "chartevents")]
    inputs = table(spark, "inputevents", [given(2, 226453, 130, 170, 40.0, rate=60.0, rate_unit="mL/hour")])
    charted = [(1, 60), (1, 200), (1, 9000), (2, -50), (2, -10), (5, 0), (6, 700), (6, 890), (7, 300), (8, 90)]
    urine = table(spark, "urine_output", [(s, at(m), 6.0) for s, m in charted])
    want = {tuple(r) for r in hour_grid(with_length(stays)).collect()}
    for voided in (urine, urine.limit(0)):
        hours = fluid.hourly(inputs, *nothing, voided, stays)
        got = [tuple(r) for r in hours.select("stay_id", "hr").collect()]
        assert len(got) == len(set(got)) and set(got) == want
        assert rows(hours.filter("hourly_intake > 0"), "stay_id", "hr", "hourly_intake") == [(2, 2, 40)]
        assert hours.filter("hourly_balance is null or est_cumm_hourly_balance is null").count() == 0
        assert _spreads(hours) == 2  # what was given, and from void to void


def test_small_rows_are_dealt_before_they_are_spread(spark, folder):
    """Rows that grow by every hour of a stay come from all cores, not from one small file."""
    tables = clinical_tables(spark, folder)
    for name in ("sofa", "oxygen_treat"):
        made = tables.derive(name)
        assert made.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        assert made.count() == tables[name].count()


def test_daily_gates(spark):
    stays = times(spark, s1=5000, s2=1440)
    inputs = table(
        spark,
        "inputevents",
        [
            given(s, 226453, 60, 3000, 1.0, rate=60.0, rate_unit="mL/hour") for s in (1, 2)
        ],
    )
    none = [table(spark, n, []) for n in ("outputevents", "chartevents", "urine_output")]
    wide = {r.stay_id: r for r in fluid.daily(inputs, *none, stays).collect()}
    assert (wide[1].d1_intake, wide[1].d2_intake, wide[1].d3_intake) == (1380, 1440, 120)
    # the second day opens after 24 hours; the seventh opens with the fourth
    assert wide[1].d2_cumm_fluid_balance == 2820 and wide[2].d2_fluid_balance is None
    assert wide[1].d7_fluid_balance == 0 and wide[1].d5_fluid_balance is None
    assert wide[2].overall_7d_fluid == 2940


def test_procedure_chain_counts_once(spark):
    stays = times(spark, s1=600, s2=600)
    starts = [0, 50, 100, 161, 222, 700]
    data = [(1, 225432, at(m), None, at(m + 5)) for m in starts]
    data += [(2, 225432, at(-60), at(0), None), (2, 225432, at(-60), at(9), None), (2, 1, at(5), None, None)]
    found = procedures.deduplicated(procedures.charted(table(spark, "procedureevents", data), stays))
    assert rows(found, "stay_id", "tte_offset", "rn") == [
        (1, 0, 1), (1, 161, 2), (1, 222, 3), (2, -60, 1), (2, -60, 1),
    ]
    wide = {r.stay_id: r for r in procedures.table(found).collect()}
    assert (wide[1].tte_offset3, wide[1].tte_offset4, wide[1].tte_number) == (222, None, 3)
    assert (wide[2].tte_end1, wide[2].tte_end2) == (at(0), at(9))


def test_dose_text_and_drug_names(spark):
    base = spark.createDataFrame([(1, 10, T0)], "stay_id long, hadm_id long, icu_intime timestamp_ntz")
    doses = ["5", "5.", "-5", "-", ".", "", "5 mg", None]
    drugs = table(
        spark,
        "prescriptions",
        [(10, i, at(i), "Bumetanide", "IV", "x", d) for i, d in enumerate(doses)]
        + [(10, 0, at(50 + i), n, "IV", "x", "1") for i, n in enumerate(["Metoprolol", "Diltiazem", "Diltiaz", "metoCLOPramide"])]
        + [(10, 99, at(80), "Lasix", "IV", "100mg/10mL Vial", "40")],
    )
    pharmacy = table(spark, "pharmacy", [(i, "BID") for i in range(8)] + [(99, "INFUSION")])
    got = rows(cohort.diuretics(drugs, pharmacy, base), "diuretic_offset", "diuretic_amount", "diuretic_infusion")
    assert got == [(0, 100, 0), (1, 100, 0), (2, -100, 0), (80, 0, 1)]
    # the run-together names match nothing
    flags = rows(cohort.rate_control(drugs, pharmacy, base), "betablocker_offset", "betablocker", "calcium_antagonist")
    assert flags == [(52, 0, 1), (53, 1, 0)]


def test_drug_changes_by_block_equal_range_join(spark):
    spans = [(1, b, b + length) for b, length in [(-300, 70), (-200, 200), (10, 230), (100, 380), (300, 180), (700, 20)]]
    episodes = spark.createDataFrame(
        [(s, b, e, 1.0, "start" if i % 2 else None, i % 3 > 0) for i, (s, b, e) in enumerate(spans)],
        "stay_id long, begin_offset long, end_offset long, rate double, change string, ended boolean",
    ).withColumns({"is_end": F.col("ended").cast("int"), "drug": F.lit("milrinone")})
    first = panel.first_changes(panel.change_blocks(episodes))
    got = rows(first.filter("milrinone_change is not null"), "block", "milrinone_change")
    assert first.filter("dobutamin_change is not null").count() == 0
    want = []
    for block in range(31):
        low, high = block * 240 - 240, 60 if block == 0 else block * 240
        hits = []
        for i, (_, b, e) in enumerate(spans):
            stopped = low > b and low <= e <= high and i % 3 > 0
            started = low <= b < high and i % 2
            if stopped or started:
                hits.append((b, "stop" if low > b else "start"))
        want += [(block, label) for b, label in hits if b == min(hits)[0]]
    assert got == sorted(want)


@pytest.mark.parametrize("name", ["rate_hourly_mean", "hourly_balance_running", "daily_balance_wide", "block_panel", "post_procedure_changes"])
def test_no_join_without_an_equal_key(name, spark, folder):
    plan = QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python"):
        assert bad not in plan


def test_every_stage_of_the_run_joins_on_equal_keys(spark, folder, tmp_path):
    plans = {}

    class Recorded(Stages):
        def __call__(self, name, df):
            plans[name] = df._jdf.queryExecution().executedPlan().toString()
            return super().__call__(name, df)

    study.run(clinical_tables(spark, folder), Recorded(spark, str(tmp_path))).count()
    for plan in plans.values():
        assert not any(bad in plan for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python"))
    assert plans["panel"].count("Join ") <= 13  # five of them cut sources to the cohort
    # the scores are cut to the cohort below their grouping
    base = plans["cohort_base"]
    grouped = next(part for part in base.split("HashAggregate(keys=[stay_id") if "sofa_24hours" in part)
    assert "LeftSemi" in grouped
    assert base.count("FileScan parquet [stay_id#") >= 1 and "inputevents" not in base


def test_procedures_in_one_pass(spark, folder):
    for name in ("procedure_dedup", "procedure_pivot"):
        plan = QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 2 and plan.count("Exchange ") <= 3, name


def test_exposure_plans_the_infusions_once(spark, folder):
    tables = clinical_tables(spark, folder)
    hourly = pressor.hourly(tables["inputevents"], tables["icustay_times"])
    stays = tables["icustays"].select("stay_id")
    plan = cohort.exposed(stays, pressor.daily(hourly))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("[stay_id") and sum("itemid" in line and "FileScan" in line for line in plan.splitlines()) == 1


def test_ties_at_the_first_procedure(spark):
    rows_in = [(1, 0, 5), (1, 0, 7), (1, 0, None), (1, 50, 60), (1, 111, 120), (1, 112, 113), (1, 400, 9), (1, 400, 8), (2, 3, 4)]
    charted = spark.createDataFrame(
        [(s, o, at(o), at(e), None) for s, o, e in rows_in],
        "stay_id long, tte_offset long, tte_start timestamp_ntz, tte_end timestamp_ntz, tte_store timestamp_ntz",
    )
    kept = procedures.deduplicated(charted)
    got = sorted(((r.stay_id, r.tte_offset, r.rn, r.tte_end) for r in kept.collect()), key=str)
    want = [(1, 0, 1, at(5)), (1, 0, 1, at(7)), (1, 0, 1, None), (1, 111, 4, at(120)), (1, 400, 5, at(8)), (2, 3, 1, at(4))]
    assert got == sorted(want, key=str)
    assert rows(procedures.table(kept), "stay_id", "tte_number") == [(1, 5), (2, 1)]


def test_bucketed_stages_join_without_a_shuffle(spark):
    spark.sql("create database if not exists stayline_buckets")
    database = CatalogStages(spark, "stayline_buckets", buckets=8)
    stays = database("stays", spark.range(500).toDF("stay_id"))
    hours = database("hours", spark.range(4000).selectExpr("id % 500 as stay_id", "id div 500 as hr"))
    other = database("other", spark.range(3).toDF("hadm_id"))
    assert other.count() == 3
    per_stay = hours.groupBy("stay_id").agg(F.sum("hr").alias("hr"))
    joined = stays.hint("merge").join(per_stay, "stay_id")
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.filter("hr = 28").count() == 500
    database.drop()
    spark.sql("drop database stayline_buckets cascade")


def test_item_filter_reaches_the_scan(spark, tmp_path):
    sink = Stages(spark, str(tmp_path))
    inputs = sink("inputevents", table(spark, "inputevents", [given(1, 221906, 0, 9, rate=1.0)]))
    stays = sink("icustay_times", times(spark, s1=100))
    plan = pressor.hourly(inputs, stays)._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "itemid" in line)
    assert "PushedFilters: [In(itemid" in scan and "amount" not in scan


def test_stages_write_read_and_overwrite(spark, tmp_path):
    sink = Stages(spark, str(tmp_path))
    sink("stage", spark.range(5).toDF("stay_id"))
    assert sink("stage", spark.range(3).toDF("stay_id")).count() == 3
    sink("helper", spark.range(2).toDF("stay_id"))
    sink.drop(but=["stage"])
    assert {p.name for p in tmp_path.iterdir()} == {"stage"}
    Stages(spark, str(tmp_path / "in"))("pharmacy", table(spark, "pharmacy", [(1, "BID")]))
    for name in SCHEMAS:
        Stages(spark, str(tmp_path / "all"))(name, table(spark, name, []))
    assert set(read_parquet(spark, str(tmp_path / "all"))) == set(SCHEMAS)


def test_stages_need_a_shared_folder(spark):
    assert Stages(spark).folder.startswith(spark.conf.get("spark.checkpoint.dir"))
    bare = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default))
    for make in (shared_folder, Stages):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            make(bare)
    assert Stages(bare, "/some/folder").folder == "/some/folder"


def test_entry_survives_a_missing_library(monkeypatch):
    for name in [m for m in sys.modules if m.split(".")[0] in ("__spark_entry__", "corpus_pipeline") or m.startswith("stayline.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "zstandard", None)  # importing it fails
    entry = importlib.import_module("__spark_entry__")
    monkeypatch.delitem(sys.modules, "__spark_entry__")
    assert set(entry.queries()) == set(entry.oracle_sql()) == set(QUERIES)


def test_catalog_stages_keep_public_names_only(spark):
    spark.sql("create database if not exists stayline_test")
    spark.range(9).write.mode("overwrite").saveAsTable("stayline_test.bolus")
    database = CatalogStages(spark, "stayline_test", public=["tte"])
    for name in ("tte", "bolus"):
        assert database(name, spark.range(2).toDF("stay_id")).count() == 2
    assert spark.table("stayline_test.bolus").count() == 9
    database.drop(but=["tte"])
    spark.range(1).createOrReplaceTempView("only_a_view")  # views are listed with every database
    left = {r.tableName for r in spark.sql("show tables in stayline_test").collect() if not r.isTemporary}
    assert left == {"bolus", "tte"}
    for name in SCHEMAS:
        CatalogStages(spark, "stayline_test", SCHEMAS)(name, table(spark, name, []))
    found = read_catalog(spark, {n: f"stayline_test.{n}" for n in SCHEMAS})
    assert all(found[n].columns == [f.split()[0] for f in SCHEMAS[n].split(", ")] for n in SCHEMAS)
    spark.sql("drop database stayline_test cascade")


def test_blocks_of_a_longer_limit(spark):
    """A nine-day stay, blocks of ten days, ventilated on days seven and eight."""
    stays = times(spark, s1=9 * 1440)
    base = stays.select("stay_id")
    vent = spark.createDataFrame([(1, 6 * 1440, 8 * 1440, 1)], "stay_id long, vent_offset_start long, vent_offset_end long, vent int")
    for limit, last in ((5 * 1440, 30), (10 * 1440, 54)):
        grid = rows(panel.blocks(base, stays, limit), "block", "minute_start", "minute_end")
        assert grid[-1][0] == last
        found = {b for (b,) in rows(panel.ventilation_blocks(vent, limit), "block")}
        assert found & {b for b, *_ in grid} == {b for b, low, high in grid if 8 * 1440 >= low and 6 * 1440 < high}


def test_clock_text_in_a_zone_with_a_gap(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        row = spark.sql("select timestamp_ntz'2024-03-10 02:30:00' as t").select(clock_text(F.col("t")))
        assert row.first()[0] == "02:30"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_sources_of_the_base_are_scanned_once(spark, folder):
    tables, plans = clinical_tables(spark, folder), []

    def recorded(name, df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return tables.written(name, df)

    pressors = pressor.daily(pressor.hourly(tables["inputevents"], tables["icustay_times"]))
    built = {"vasopressor": pressors, "fluid_balance": fluid.daily(*study.fluid_inputs(tables))}
    recorded("exposed_base", study.base(tables, built, recorded))
    for plan, columns in zip(plans, (("icd_code", "antibiotic_time"), ("aki_stage", "dialysis_active")), strict=True):
        for column in columns:
            scans = [line for line in plan.splitlines() if "Relation" in line and f"{column}#" in line]
            assert len(scans) == 1, column


def test_hot_stay_is_split(spark, tmp_path):
    """One stay holds half of all rows: the join splits it, and the result stays the same."""
    sink = Stages(spark, str(tmp_path))
    events = spark.range(60000).select(
        F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id") % 500).alias("stay_id"),
        F.expr("timestampadd(second, cast(id as int) * 7, timestamp_ntz '2024-01-01 00:00:00')").alias("charttime"),
        (F.col("id") % 100).cast("double").alias("urineoutput"),
    )
    urine = sink("urine", events)
    stays = sink(
        "stays",
        spark.range(500).select(
            F.col("id").alias("stay_id"),
            F.lit(T0).cast("timestamp_ntz").alias("intime_hr"),
            F.lit(T0 + timedelta(days=6)).cast("timestamp_ntz").alias("outtime_hr"),
        ),
    )

    def query():
        voids = fluid.void_intervals(urine, with_length(stays))
        return fluid.hour_shares(voids, F.lit(0.0)).groupBy("stay_id", "hr").agg(F.sum("value").alias("v"))

    calm = {tuple(r[:2]): r[2] for r in query().collect()}
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16KB",
        "spark.sql.files.maxPartitionBytes": "64KB",
    }
    before = {k: spark.conf.get(k, None) for k in small}
    for key, value in small.items():
        spark.conf.set(key, value)
    try:
        df = query()
        hot = {tuple(r[:2]): r[2] for r in df.collect()}
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    assert "skew=true" in plan
    assert hot == pytest.approx(calm)
