"""Input tables: their schemas, and reading them from Parquet or a catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.codes import MONITOR_MEASURES

_SOFA_PARTS = "coagulation_24hours int, liver_24hours int, cns_24hours int, renal_24hours int"
_DOSES = "stay_id bigint, starttime timestamp_ntz, endtime timestamp_ntz, vaso_rate double"

SCHEMAS = {
    "icustay_times": "stay_id bigint, intime_hr timestamp_ntz, outtime_hr timestamp_ntz",
    "icustays": "subject_id bigint, hadm_id bigint, stay_id bigint, first_careunit string",
    "icustay_detail": (
        "stay_id bigint, gender string, admission_age double, admittime timestamp_ntz,"
        " dischtime timestamp_ntz, icu_intime timestamp_ntz, icu_outtime timestamp_ntz,"
        " race string, los_icu double, hospital_expire_flag int, dod date"
    ),
    "admissions": (
        "hadm_id bigint, deathtime timestamp_ntz, edregtime timestamp_ntz, edouttime timestamp_ntz"
    ),
    "services": "hadm_id bigint, curr_service string, transfertime timestamp_ntz",
    "patients": "subject_id bigint, anchor_year int, anchor_year_group string",
    "diagnoses_icd": "hadm_id bigint, icd_code string, seq_num int",
    "inputevents": (
        "stay_id bigint, orderid bigint, itemid bigint, starttime timestamp_ntz,"
        " endtime timestamp_ntz, amount double, amountuom string, rate double, rateuom string,"
        " patientweight double, ordercategorydescription string"
    ),
    "outputevents": "stay_id bigint, charttime timestamp_ntz, itemid bigint, value double",
    "chartevents": "stay_id bigint, charttime timestamp_ntz, itemid bigint, value string",
    "procedureevents": (
        "stay_id bigint, itemid bigint, starttime timestamp_ntz, endtime timestamp_ntz,"
        " storetime timestamp_ntz"
    ),
    "urine_output": "stay_id bigint, charttime timestamp_ntz, urineoutput double",
    "prescriptions": (
        "hadm_id bigint, pharmacy_id bigint, starttime timestamp_ntz, drug string, route string,"
        " prod_strength string, dose_val_rx string"
    ),
    "pharmacy": "pharmacy_id bigint, frequency string",
    "dobutamine": _DOSES,
    "epinephrine": _DOSES,
    "vasopressin": _DOSES,
    "sepsis3": (
        "stay_id bigint, antibiotic_time timestamp_ntz, culture_time timestamp_ntz,"
        " suspected_infection_time timestamp_ntz, sofa_time timestamp_ntz, sofa_score int,"
        " respiration int, coagulation int, liver int, cardiovascular int, cns int, renal int"
    ),
    "sofa": f"stay_id bigint, hr bigint, starttime timestamp_ntz, sofa_24hours int, {_SOFA_PARTS}",
    "kdigo_stages": "stay_id bigint, aki_stage int",
    "rrt": "stay_id bigint, dialysis_active int",
    "apsiii": "stay_id bigint, apsiii int",
    "charlson": (
        "hadm_id bigint, myocardial_infarct int, congestive_heart_failure int,"
        " diabetes_with_cc int, charlson_comorbidity_index int"
    ),
    "first_day_weight": "stay_id bigint, weight double",
    "ventilation": (
        "stay_id bigint, starttime timestamp_ntz, endtime timestamp_ntz, ventilation_status string"
    ),
    "vitals": (
        "stay_id bigint, charttime timestamp_ntz, rn bigint, "
        + ", ".join(f"{m} double" for m in MONITOR_MEASURES)
    ),
    "oxygen_treat": "stay_id bigint, hr bigint, sf_ratio double",
}


def read_parquet(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All input tables from ``<folder>/<table>``; the schemas are given, not inferred."""
    return {
        name: spark.read.schema(schema).parquet(f"{folder}/{name}")
        for name, schema in SCHEMAS.items()
    }


def read_catalog(spark: SparkSession, names: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """All input tables from the catalog; ``names`` maps a table to its catalog name."""
    names = names or {}
    return {table: typed(spark.table(names.get(table, table)), table) for table in SCHEMAS}


def typed(df: DataFrame, table: str) -> DataFrame:
    """The columns of an input table with their expected types."""
    fields = StructType.fromDDL(SCHEMAS[table]).fields
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])
