"""Clinical input tables derived from the driver tables, once in SQL for two engines.

A stay is one user and one half of the month of ``events``, with time running twice as
fast, so that a stay lasts up to 7.5 days and the 7-day and 5-day limits are reached.  All
rows of the driver tables are used.  The text below is the same for Spark and DuckDB apart
from the handful of functions in ``Dialect``; the operators are never shared.
"""

from __future__ import annotations

import re
import tempfile
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from stayline.functions.codes import CARDIAC_UNITS, MONITOR_MEASURES
from stayline.sources.stages import Stages
from stayline.sources.tables import SCHEMAS, typed


@dataclass(frozen=True)
class Dialect:
    spark: bool

    @property
    def origin(self) -> str:
        kind = "timestamp_ntz" if self.spark else "timestamp"
        return f"{kind} '2024-01-01 00:00:00'"

    def seconds(self, since: str, until: str) -> str:
        if self.spark:
            return f"timestampdiff(second, {since}, {until})"
        return f"date_sub('second', {since}, {until})"

    def plus(self, ts: str, seconds: str) -> str:
        if self.spark:
            return f"timestampadd(second, cast({seconds} as int), {ts})"
        return f"({ts} + to_seconds(cast({seconds} as bigint)))"

    def div(self, a: str, b: int) -> str:
        return f"(({a}) div {b})" if self.spark else f"(({a}) // {b})"

    def pick(self, values: list, index: str) -> str:
        items = ", ".join("null" if v is None else repr(v) for v in values)
        place = f"cast(({index}) % {len(values)} as int) + 1"
        return f"element_at(array({items}), {place})" if self.spark else f"list_extract([{items}], {place})"

    def series(self, last: str) -> str:
        return f"explode(sequence(0, {last}))" if self.spark else f"unnest(generate_series(0, {last}))"


INFUSION_ITEMS = (
    [221906] * 4 + [221749] * 2 + [222315] * 2 + [221289, 221662, 221653] + [221986] * 2 + [229764]
    + [225828] * 3 + [225158] * 2 + [225827, 225825] + [220864] * 2 + [225174]
    + [225171, 220970, 225168] + [226453, 229014, 227090] + [999999, 229709]
)
DRUGS = [
    "Furosemide", "Furosemide ", "Lasix", "Bumetanide", "Ethacrynic Acid", "torsemide",
    "Esmolol", "Esmolol in Saline (Iso-osm)", "Metoprolol", "metoCLOPramide",
    "Metoprolol Tartrate", "metoprolol tartrate", "Diltia", "Diltiaz", "Diltiazem",
    "Verapamil", "Verapamil HCl", "Heparin",
]
RACES = [
    "WHITE", "WHITE - RUSSIAN", "BLACK/AFRICAN AMERICAN", "ASIAN - CHINESE", "UNKNOWN",
    "HISPANIC OR LATINO", "SOUTH AMERICAN", "AMERICAN INDIAN/ALASKA NATIVE",
    "NATIVE HAWAIIAN OR OTHER PACIFIC ISLANDER", "UNABLE TO OBTAIN",
    "PATIENT DECLINED TO ANSWER", "OTHER", None,
]


def definitions(d: Dialect) -> dict[str, str]:
    """``name -> select``; ``ev`` and ``st`` come first and feed the others."""
    at = d.plus(d.origin, "sec")
    on_hour = d.plus(d.origin, f"s0 + {d.div('sec - s0', 3600)} * 3600")
    half = f"case when e % 3 = 0 then {on_hour} else {at} end"

    def t(seconds: str) -> str:
        return d.plus(d.origin, seconds)

    fluid_slot = f"{d.div('sec', 21600)} * 21600"
    dose = {
        name: f"""
            select stay_id, {t('a')} as starttime, {t('b')} as endtime,
                case when e % 13 = 0 or not given then 0 when e % 17 = 0 then null else v / 15 end as vaso_rate
            from (
                select stay_id, e, v, e % 4 = {part} as given, sec as a,
                    sec + cast(floor(v * 3) as bigint) * 60 as b
                from ev
                union all
                select stay_id, e, v / 2, e % 4 = {part} and e % 8 < 4,
                    sec + cast(floor(v * 3) as bigint) * 60 + 1800,
                    sec + cast(floor(v * 3) as bigint) * 60 + 1800 + k * 60
                from ev
            ) rows"""
        for part, name in enumerate(["dobutamine", "epinephrine", "vasopressin"])
    }
    measures = ", ".join(
        f"case when e % 4 = 3 and (e + {i}) % 16 = 3 then v when (e + {i}) % 5 = 0 then null else 0.0 end as {m}"
        for i, m in enumerate(MONITOR_MEASURES)
    )
    return {
        "ev0": f"""
            select event_id as e, user_id as u, value as v,
                cast(regexp_extract(props, '([0-9]+)', 1) as int) as k,
                {d.div(d.seconds(d.origin, 'ts'), 2)} as sec,
                {d.div(d.seconds(d.origin, 'ts'), 1296000)} as half
            from events""",
        "ev": """
            select e, u, v, k, sec, half, u * 10 + half as stay_id,
                min(sec) over (partition by u, half) as s0
            from ev0""",
        "st": f"""
            select stay_id, min(u) as u, min(sec) as s0, max(sec) as s1,
                {d.div('max(sec) - min(sec)', 3600)} as hours
            from ev group by stay_id""",
        "icustay_times": f"""
            select stay_id, {t('s0')} as intime_hr,
                case when stay_id % 41 = 0 then null when stay_id % 43 = 0 then {t('s0 - 600')}
                    else {t('s1')} end as outtime_hr
            from st""",
        "icustays": f"""
            select u as subject_id, stay_id as hadm_id, stay_id,
                {d.pick(['MICU', 'SICU', 'Coronary Care Unit (CCU)', 'TSICU', 'MICU', CARDIAC_UNITS[-1], None], 'stay_id')}
                    as first_careunit
            from st""",
        "icustay_detail": f"""
            select stay_id, {d.pick(['M', 'F'], 'u')} as gender, 20.0 + u % 70 as admission_age,
                {t('s0 - (stay_id * 7 % 30) * 3600')} as admittime, {t('s1 + 7200')} as dischtime,
                {t('s0 + 300')} as icu_intime, {t('s1 + 1200')} as icu_outtime,
                {d.pick(RACES, 'stay_id + u')} as race, cast(hours as double) / 24 as los_icu,
                case when stay_id % 4 = 0 then 1 else 0 end as hospital_expire_flag,
                case when stay_id % 4 = 0 then cast({t('s1 + 86400 * (u % 3)')} as date) end as dod
            from st""",
        "admissions": f"""
            select stay_id as hadm_id,
                case when stay_id % 4 = 0 then {t('s1 + (u % 9) * 3600')} end as deathtime,
                case when stay_id % 3 > 0 then {t('s0 - 200000')} end as edregtime,
                case when stay_id % 3 > 0 then {t('s0 - 190000')} end as edouttime
            from st""",
        "patients": f"""
            select u as subject_id, 2024 - min(u) % 5 as anchor_year,
                {d.pick(['2008 - 2010', '2011 - 2013', '2014 - 2016', '2017 - 2019', '2020 - 2022'], 'u')}
                    as anchor_year_group
            from st group by u""",
        "services": f"""
            select o_custkey as hadm_id,
                {d.pick(['MED', 'SURG', 'CSURG', 'NMED', 'MED', 'TRAUM', 'CMED', 'OMED'], 'o_orderkey')}
                    as curr_service,
                case when o_orderkey % 97 = 0 then null else o_orderdate end as transfertime
            from orders""",
        "diagnoses_icd": f"""
            select case when {d.div('l_orderkey', 10)} % 29 = 0 then 1000000007
                    else {d.div('l_orderkey', 10)} end as hadm_id,
                case when l_partkey % 150 = 0 then 'I469' when l_partkey % 150 = 1 then 'I213'
                    when l_partkey % 211 = 5 then 'Z992' when l_partkey % 211 = 6 then 'V4511'
                    else concat(l_returnflag, l_linestatus) end as icd_code,
                l_linenumber as seq_num
            from lineitem""",
        "inputevents": f"""
            select stay_id, e % 23 as orderid, itemid, {t('a')} as starttime,
                case when e % 71 = 0 then null when e % 31 = 0 then {t('a')}
                    when e % 67 = 0 then {t('a - 1200')}
                    else {t('a + cast(floor(v * 4) as bigint) * 60')} end as endtime,
                case when e % 6 = 3 then v / 100 else v * 10 end as amount,
                {d.pick(['mL', 'ml', 'cm3', 'L', 'uL', 'mg'], 'e')} as amountuom,
                case when e % 7 = 0 then null
                    when itemid between 221000 and 223000 or itemid = 229764 then v / 20
                    when e % 4 = 0 then v * 8 when e % 4 = 1 then v / 6 else v / 20 end as rate,
                {d.pick(['mL/hour', 'mL/min', 'mL/kg/hour', 'units'], 'e')} as rateuom,
                50.0 + u % 50 as patientweight,
                case when e % 13 = 0 then null when e % 6 = 0 then 'Bolus' else 'Continuous Med' end
                    as ordercategorydescription
            from (
                select ev.*, {d.pick(INFUSION_ITEMS, 'e + k')} as itemid,
                    case when {d.pick(INFUSION_ITEMS, 'e + k')} in
                        (225828, 225158, 225827, 225825, 220864, 225174)
                        then {fluid_slot} else sec - 1800 end as a
                from ev
            ) rows""",
        "outputevents": f"""
            select stay_id, {half} as charttime,
                {d.pick([226616, 226569, 227488, 226560, 227511, 226618, 226563, 226588], 'e + k')}
                    as itemid,
                case when e % 23 = 0 then null else v end as value
            from ev""",
        "chartevents": f"""
            select stay_id, {half} as charttime,
                {d.pick([226499, 225806, 225807, 226457, 220045], 'e + k')} as itemid,
                case when e % 11 = 0 then 'see note' when e % 11 = 1 then null
                    else concat(cast(k * 3 as string), case when e % 2 = 0 then '.5' else '' end) end
                    as value
            from ev""",
        "urine_output": f"""
            select stay_id, {half} as charttime, case when e % 19 = 0 then null else v * 2 end as urineoutput
            from ev
            union all
            select stay_id, {d.plus(half, '20')}, cast(k as double) from ev where e % 5 = 0""",
        "procedureevents": f"""
            select stay_id, case when e % 3 = 0 then 225432 else 225401 end as itemid,
                {t('a')} as starttime, case when e % 17 = 0 then null else {t('a + b')} end as endtime,
                {t('a + 3600')} as storetime
            from (
                select stay_id, e, case when e % 29 = 0 then sec - 7200 else sec end as a, 1200 as b from ev
                union all select stay_id, e, sec + 3000, 1200 from ev where e % 6 = 0
                union all select stay_id, e, sec + 6000, 1200 from ev where e % 12 = 0
                union all select stay_id, e, sec, 3600 from ev where e % 29 > 0 and e % 2 = 1
            ) rows""",
        "prescriptions": f"""
            select stay_id as hadm_id, e as pharmacy_id, {at} as starttime, {d.pick(DRUGS, 'e + k')} as drug,
                {d.pick(['IV', 'IV DRIP', 'IV', 'PO/NG'], 'k')} as route,
                {d.pick(['100mg/10mL Vial', '40mg Tablet', '2.5mg/10mL Vial', '20mg/2mL Vial'], 'e')}
                    as prod_strength,
                case when e % 11 = 0 then '-' when e % 11 = 1 then '.' when e % 11 = 2 then concat(cast(k as string), ' mg')
                    when e % 11 = 3 then concat(cast(k as string), '.') when e % 11 = 4 then concat('-', cast(k as string))
                    when e % 11 = 5 then null when e % 11 = 6 then concat(cast(k as string), '.5')
                    else cast(k as string) end as dose_val_rx
            from ev""",
        "pharmacy": f"""
            select e as pharmacy_id, {d.pick(['INFUSION', 'BID', 'IV DRIP', 'DAILY', None], 'k')} as frequency
            from ev where e % 37 > 0""",
        **dose,
        "sepsis3": f"""
            select stay_id, {t('s0 - 3600')} as antibiotic_time, {t('s0 - 1800')} as culture_time,
                {t('s0 - 1800')} as suspected_infection_time,
                case when stay_id % 23 = 0 then null else {t('s0 + (stay_id % 5) * 3600')} end as sofa_time,
                2 + stay_id % 9 as sofa_score, stay_id % 4 as respiration, stay_id % 3 as coagulation,
                stay_id % 2 as liver, stay_id % 5 as cardiovascular, u % 4 as cns, u % 3 as renal
            from st where stay_id % 9 > 0""",
        "sofa": f"""
            select stay_id, hr, {t('s0 + hr * 3600')} as starttime,
                case when (stay_id + hr) % 5 = 0 then null else (stay_id * 3 + hr) % 20 end as sofa_24hours,
                case when (stay_id + hr) % 17 = 0 then null else (stay_id + hr) % 4 end as coagulation_24hours,
                (stay_id + hr * 3) % 5 as liver_24hours, (u + hr) % 3 as cns_24hours,
                (stay_id * 5 + hr) % 4 as renal_24hours
            from (select stay_id, u, s0, {d.series('hours')} as hr from st) rows""",
        "kdigo_stages": "select stay_id, k % 4 as aki_stage from ev where stay_id % 7 > 0",
        "rrt": """
            select stay_id, case when e % 40 = 0 then 1 else 0 end as dialysis_active
            from ev where stay_id % 3 = 0""",
        "apsiii": "select stay_id, 20 + stay_id % 90 as apsiii from st where stay_id % 6 > 0",
        "charlson": """
            select stay_id as hadm_id, stay_id % 2 as myocardial_infarct,
                stay_id % 3 % 2 as congestive_heart_failure, stay_id % 5 % 2 as diabetes_with_cc,
                stay_id % 12 as charlson_comorbidity_index
            from st where stay_id % 8 > 0""",
        "first_day_weight": "select stay_id, 50.5 + u % 60 as weight from st where stay_id % 10 > 0",
        "ventilation": f"""
            select stay_id, {at} as starttime, {t('sec + cast(floor(v * 6) as bigint) * 60')} as endtime,
                {d.pick(['InvasiveVent', 'SupplementalOxygen', 'NonInvasiveVent', 'None', 'Tracheostomy'], 'k')}
                    as ventilation_status
            from ev""",
        "vitals": f"select stay_id, {at} as charttime, e as rn, {measures} from ev",
        "oxygen_treat": f"""
            select stay_id, hr, 100.0 + (stay_id * 7 + hr * 13) % 400 as sf_ratio
            from (select stay_id, {d.series('hours')} as hr from st) rows where (stay_id + hr) % 6 = 0""",
    }


def with_clause(parts: dict[str, str], body: str) -> str:
    """``body`` with the parts it needs, directly or through others, as a WITH clause."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in parts:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(parts[name])

    visit(body)
    listed = ",\n".join(f"{n} as ({parts[n].strip()})" for n in parts if n in needed)
    return f"with {listed}\n{body}" if listed else body


def _typed_sql(name: str, select: str) -> str:
    """The select with the column types of the input table, as ``typed`` gives them in Spark."""
    if name not in SCHEMAS:
        return select
    names = {"timestamp_ntz": "timestamp", "string": "varchar"}
    fields = [f.split() for f in SCHEMAS[name].split(",")]
    columns = ", ".join(f"cast({c} as {names.get(kind, kind)}) as {c}" for c, kind in fields)
    return f"select {columns} from ({select}) typed"


DUCKDB = {n: _typed_sql(n, s) for n, s in definitions(Dialect(spark=False)).items()}


def sink(spark: SparkSession) -> Stages:
    """Stages in the cluster's shared folder; in a local session without one, in a temporary folder."""
    local = spark.sparkContext.master.startswith("local[") and not spark.conf.get("spark.checkpoint.dir", None)
    return Stages(spark, tempfile.mkdtemp(prefix="stayline-") if local else None)


class Tables(dict):
    """The clinical tables, derived by Spark from all rows of the driver tables in ``folder``.

    Each table is written as Parquet when first asked for and read back, so the queries
    start from a scan as they would on real clinical tables.
    """

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__()
        self.spark, self.folder = spark, folder
        self.parts = definitions(Dialect(spark=True))
        self.written = sink(spark)
        for source in SOURCES:
            spark.read.parquet(f"{folder}/{source}.parquet").createOrReplaceTempView(
                f"driver_{source}"
            )

    def __missing__(self, name: str) -> DataFrame:
        if name in ("ev", "st"):
            made = self.written(name, self.derive(name))
            made.createOrReplaceTempView(f"driver_{name}")
            if name == "st":  # one small file, but a row per hour of each stay comes from it
                cores = self.spark.sparkContext.defaultParallelism
                made.repartition(cores, "stay_id").createOrReplaceTempView("driver_st_dealt")
            self[name] = made
        else:
            self[name] = self.written(name, typed(self.derive(name), name))
        return self[name]

    def derive(self, name: str) -> DataFrame:
        text = self.parts[name]
        inputs = {"ev0": self.parts["ev0"]} if name == "ev" else {}
        text = with_clause(inputs, text)
        for source in [*SOURCES, "ev", "st"]:
            if re.search(rf"(from|join) {source}\b", text):
                if source not in SOURCES:
                    self[source]
                view = f"driver_{source}" + ("_dealt" if source == "st" and "sequence(" in text else "")
                text = re.sub(rf"(from|join) {source}\b", rf"\1 {view} {source}", text)
        return self.spark.sql(text)


@lru_cache(maxsize=4)
def clinical_tables(spark: SparkSession, folder: str) -> Tables:
    return Tables(spark, folder)


SOURCES = ["events", "orders", "lineitem"]
NAMES = [n for n in DUCKDB if n not in ("ev0", "ev", "st")]
