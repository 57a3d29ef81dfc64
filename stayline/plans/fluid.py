"""Fluids: what went in and out per hour and per day, with running balances.

All sources become one stream of contributions ``(stay_id, bucket, kind, value)`` that is
summed once, in place of a join per source.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codes
from ..functions.clinical import (
    colloid_amount,
    crystalloid_amount,
    has_item,
    is_colloid_bolus,
    is_crystalloid_bolus,
    millilitres,
    millilitres_per_hour,
    offset_of,
    signed,
)
from ..functions.numbers import numeric, numeric_text, sixtieths, whole, whole_even, zero
from ..functions.timing import DAY, HOUR, bucket_from, bucket_upto, rounded_units
from ..operators.grid import dealt, spread, with_length
from ..operators.intervals import overlapped_buckets, rate_minutes
from ..operators.shape import by_day, total
from ..operators.timeline import running_sum


# --- intake ------------------------------------------------------------------------

def input_totals(inputevents: DataFrame, lengths: DataFrame) -> DataFrame:
    """Everything given, in one scan and one grouping.

    ``kind`` is 'intake' or 'blood' (one row per stay and order, ``place`` = order id) or
    'bolus' (one row per stay and start minute, ``place`` = offset).
    """
    rows = (
        inputevents.filter(has_item(codes.INTAKE_ITEMS))
        .join(lengths, "stay_id")
        .withColumn("start_offset", offset_of("starttime"))
        .withColumn("end_offset", offset_of("endtime"))
    )
    return _grouped(rows, [_intake_part(), _blood_part(), *_bolus_parts(True, False)])


def orders(inputevents: DataFrame, lengths: DataFrame) -> DataFrame:
    """Intake and blood per order: first start, first end, total amount and rate."""
    return input_totals(inputevents, lengths).filter(F.col("kind") != "bolus")


def boluses(
    inputevents: DataFrame, stays: DataFrame, after_start: bool = True, whole_rows: bool = False
) -> DataFrame:
    """Crystalloid and colloid boluses per stay and start minute.

    Several crystalloid and several colloid rows at one minute count once per pair, as in
    a full outer join on (stay, minute).  The totals follow from the sums and counts of the
    two sides, so the pairs are never built.
    """
    items = codes.CRYSTALLOID_ITEMS + codes.COLLOID_ITEMS
    rows = (
        inputevents.filter(has_item(items))
        .join(stays.select("stay_id", "intime_hr"), "stay_id")
        .withColumn("start_offset", offset_of("starttime"))
        .withColumn("end_offset", offset_of("endtime"))
        .withColumn("los_min", F.lit(None).cast("bigint"))
    )
    return bolus_sums(_grouped(rows, _bolus_parts(after_start, whole_rows)))


def bolus_sums(totals: DataFrame) -> DataFrame:
    return totals.filter(F.col("kind") == "bolus").select(
        "stay_id",
        F.col("place").alias("bolus_offset"),
        _crystalloid().alias("cristalloid_bolus"),
        _colloid().alias("colloid_bolus"),
        "los_min",
    )


def _part(kind, place, amount, rate=None, colloid=None, crystalloid_rows=0, colloid_rows=0):
    empty = F.lit(None).cast("double")
    return F.struct(
        F.lit(kind).alias("kind"),
        place.cast("bigint").alias("place"),
        (empty if amount is None else amount).alias("amount"),
        (empty if rate is None else rate).alias("rate"),
        (empty if colloid is None else colloid).alias("colloid"),
        F.lit(crystalloid_rows).alias("crystalloid_rows"),
        F.lit(colloid_rows).alias("colloid_rows"),
    )


def _intake_part() -> Column:
    amount = millilitres(F.col("amount"), F.col("amountuom"), microlitres=True)
    rate = millilitres_per_hour(F.col("rate"), F.col("rateuom"), F.col("patientweight"))
    return F.when(has_item(codes.INTAKE_ITEMS), _part("intake", F.col("orderid"), amount, rate))


def _blood_part() -> Column:
    rate = F.when(F.col("rateuom") == "mL/min", F.col("rate") * 60).otherwise(F.col("rate"))
    given = has_item(codes.BLOOD_ITEMS) & (F.col("starttime") > F.col("intime_hr"))
    part = _part("blood", F.col("orderid"), numeric(F.col("amount")), numeric(rate))
    return F.when(given, part)


def _bolus_parts(after_start: bool, whole_rows: bool) -> list[Column]:
    crystalloid, colloid = is_crystalloid_bolus(), is_colloid_bolus()
    if after_start:
        later = F.col("starttime") > F.col("intime_hr")
        crystalloid, colloid = crystalloid & later, colloid & later
    place = F.col("start_offset")
    clear = _part("bolus", place, numeric(crystalloid_amount(whole_rows)), crystalloid_rows=1)
    thick = _part("bolus", place, None, colloid=numeric(colloid_amount(whole_rows)), colloid_rows=1)
    return [F.when(crystalloid, clear), F.when(colloid, thick)]


def _grouped(rows: DataFrame, parts: list[Column]) -> DataFrame:
    return (
        rows.select(
            "stay_id",
            "los_min",
            "start_offset",
            "end_offset",
            F.explode(F.array_compact(F.array(*parts))).alias("part"),
        )
        .select("stay_id", "los_min", "start_offset", "end_offset", "part.*")
        .groupBy("stay_id", "kind", "place")
        .agg(
            F.min("start_offset").alias("start_offset"),
            F.min("end_offset").alias("end_offset"),
            F.sum("amount").alias("amount"),
            F.sum("rate").alias("rate"),
            F.sum("colloid").alias("colloid"),
            F.sum("crystalloid_rows").alias("crystalloid_rows"),
            F.sum("colloid_rows").alias("colloid_rows"),
            F.max("los_min").alias("los_min"),
        )
    )


# --- output ------------------------------------------------------------------------

def urine_points(urine_output: DataFrame) -> DataFrame:
    return urine_output.select(
        "stay_id", "charttime", F.lit("urine").alias("kind"), numeric(F.col("urineoutput")).alias("value")
    )


def output_points(outputevents: DataFrame, items: list[int]) -> DataFrame:
    value = signed(numeric(F.col("value")), F.col("itemid"), codes.IRRIGANT_IN_ITEM)
    return outputevents.filter(has_item(items)).select(
        "stay_id", "charttime", F.lit("output").alias("kind"), value.alias("value")
    )


def dialysis_points(chartevents: DataFrame) -> DataFrame:
    value = signed(numeric_text(F.col("value")), F.col("itemid"), codes.DIALYSATE_IN_ITEM)
    return chartevents.filter(has_item(codes.DIALYSIS_ITEMS)).select(
        "stay_id", "charttime", F.lit("dialysis").alias("kind"), value.alias("value")
    )


def placed(points: DataFrame, lengths: DataFrame) -> DataFrame:
    """Points with their offset in the stay."""
    return points.join(lengths, "stay_id").withColumn("offset", offset_of("charttime"))


def fluid_points(
    outputevents: DataFrame, chartevents: DataFrame, urine_output: DataFrame, lengths: DataFrame
) -> DataFrame:
    """All charted urine, output and dialysis with their offsets, for both views.

    ``hourly`` and ``daily`` tell which view counts a point; the two lists of output items differ.
    """
    hourly, daily = codes.HOURLY_OUTPUT_ITEMS, codes.DAILY_OUTPUT_ITEMS
    value = signed(numeric(F.col("value")), F.col("itemid"), codes.IRRIGANT_IN_ITEM)
    outputs = outputevents.filter(has_item(sorted({*hourly, *daily}))).select(
        "stay_id",
        "charttime",
        F.lit("output").alias("kind"),
        value.alias("value"),
        has_item(hourly).alias("hourly"),
        has_item(daily).alias("daily"),
    )
    others = urine_points(urine_output).unionByName(dialysis_points(chartevents))
    others = others.withColumns({"hourly": F.lit(True), "daily": F.lit(True)})
    return placed(outputs.unionByName(others), lengths).drop("intime_hr")


def charted(points: DataFrame, lengths: DataFrame) -> DataFrame:
    """Points summed per stay and chart time."""
    return (
        placed(points, lengths)
        .groupBy("stay_id", "charttime")
        .agg(F.min("offset").alias("offset"), F.sum("value").alias("value"))
    )


def void_intervals(urine_output: DataFrame, lengths: DataFrame) -> DataFrame:
    return voids(placed(urine_points(urine_output), lengths))


def voids(urine: DataFrame) -> DataFrame:
    """Each void as an interval from the void before it (or 0) to itself, with a rate.

    Several voids charted in one minute: the first ends the interval, the others have no
    length and no rate.  They stay visible as ``voids`` and ``minute_amount``.  One row per
    minute also bounds the window below by the length of the chart, 1,440 rows a day.
    """
    return _void_spans(_voids_per_minute(urine))


def _voids_per_minute(urine: DataFrame) -> DataFrame:
    order = F.struct(F.col("charttime"), F.col("value"))
    return (
        urine.filter(F.col("offset").isNotNull())
        .groupBy("stay_id", "offset")
        .agg(
            F.min_by("value", order).alias("amount"),
            F.sum("value").alias("minute_amount"),
            F.count(F.lit(1)).alias("voids"),
            F.max("los_min").alias("los_min"),
        )
    )


def _void_spans(per_minute: DataFrame) -> DataFrame:
    before = F.lag("offset").over(_along())
    rate = F.try_divide(F.col("amount") * 60, F.col("end_offset") - F.col("start_offset"))
    return (
        per_minute.withColumn("start_offset", zero(before))
        .withColumnRenamed("offset", "end_offset")
        .withColumn("rate", rate)
    )


def _along() -> Window:
    return Window.partitionBy("stay_id").orderBy(F.col("offset").asc_nulls_last())


def voids_to_the_end(urine: DataFrame, lengths: DataFrame) -> DataFrame:
    """``voids``, and of each stay one more row, without amount or rate, from the last void to the last hour.

    Void follows void, so all rows of a stay together touch every hour of its grid and no grid
    is needed beside them.  A stay of which there are several rows, of different lengths, is
    covered from where the shortest ends.  The rows are small before they are spread over the
    hours, so they are dealt to all shuffle partitions and not to as few as their size asks for.
    """
    ends = lengths.groupBy("stay_id").agg(F.max("los_min").alias("los_min"))
    rows = dealt(_voids_per_minute(urine).unionByName(ends, allowMissingColumns=True), "stay_id")
    # one more row that ends nowhere comes last in the window
    least = F.min(zero(F.col("los_min"))).over(_along().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = _void_spans(rows.withColumn("_least", least))
    last = F.col("end_offset").isNull()
    return rows.withColumns(
        {
            "start_offset": F.when(last, F.least("start_offset", "_least")).otherwise(F.col("start_offset")),
            "end_offset": F.when(last, (_last_hour() + 1) * HOUR).otherwise(F.col("end_offset")),
        }
    ).drop("_least")


# --- hourly ------------------------------------------------------------------------

def _last_hour() -> Column:
    return rounded_units(F.col("los_min"), HOUR)


def hour_shares(intervals: DataFrame, no_rate: Column) -> DataFrame:
    """Intervals spread over the hours of the stay: ``stay_id, hr, value`` (value = amount x 60)."""
    hours = overlapped_buckets(intervals, "start_offset", "end_offset", HOUR, _last_hour(), "hr")
    return hours.withColumn("value", _hour_share(no_rate))


def point_hours(points: DataFrame) -> DataFrame:
    """Points in the hour ``(60 hr, 60 hr + 60]`` of the stay."""
    return points.withColumn("hr", bucket_upto(F.col("offset"), HOUR)).filter(
        F.col("hr").between(F.lit(0), _last_hour())
    )


def bolus_hours(sums: DataFrame) -> DataFrame:
    """Boluses in the hour ``[60 hr, 60 hr + 60)`` of the stay."""
    return sums.withColumn("hr", bucket_from(F.col("bolus_offset"), HOUR)).filter(
        F.col("hr").between(F.lit(0), _last_hour())
    )


def _given_by(given: DataFrame, spread_kinds: list[str], width: int, last: Column, name: str):
    """Totals per bucket of the grid: ``spread_kinds`` in all they overlap, others in that of their start.

    One pass for all kinds; a filter per kind would scan the source once for each.
    """
    first = bucket_from(F.col("start_offset"), width)
    final = F.when(F.col("kind").isin(spread_kinds), bucket_upto(F.col("end_offset"), width)).otherwise(first)
    known = given.filter(F.col("start_offset").isNotNull() & final.isNotNull() & last.isNotNull())
    return spread(known, F.greatest(first, F.lit(0)), F.least(final, last), name)


def _crystalloid() -> Column:
    return F.col("amount") * F.greatest("colloid_rows", F.lit(1))


def _colloid() -> Column:
    return F.col("colloid") * F.greatest("crystalloid_rows", F.lit(1))


def _hour_share(no_rate: Column) -> Column:
    low, high = F.col("hr") * HOUR, F.col("hr") * HOUR + HOUR
    return rate_minutes(
        F.col("start_offset"), F.col("end_offset"), low, high, F.col("rate"), F.col("amount") * 60, no_rate
    )


def hourly_sums(
    inputevents: DataFrame,
    outputevents: DataFrame,
    chartevents: DataFrame,
    urine_output: DataFrame,
    stays: DataFrame,
    totals: DataFrame | None = None,
    points: DataFrame | None = None,
) -> DataFrame:
    """``stay_id, hr`` of the grid with a summed column per kind of contribution.

    The rows from void to void, and from the last one to the end, make up the grid.  Every
    source is read once.  A contribution has up to two values: boluses bring crystalloid and
    colloid, voids their estimated share of the hour and, in the hour they were charted, the
    amount.
    """
    lengths = with_length(stays)
    given = input_totals(inputevents, lengths) if totals is None else totals
    given = _given_by(given, ["intake", "blood"], HOUR, _last_hour(), "hr")
    bolus = F.col("kind") == "bolus"
    if points is None:
        points = fluid_points(outputevents, chartevents, urine_output, lengths)
    urine = F.col("kind") == "urine"
    spans = voids_to_the_end(points.filter(urine), lengths)
    spans = overlapped_buckets(spans, "start_offset", "end_offset", HOUR, _last_hour(), "hr")
    # a void lies in the last hour its interval overlaps
    charted_here = F.col("hr") == bucket_upto(F.col("end_offset"), HOUR)
    nothing = F.lit(None).cast("double")
    parts = [
        (
            given,
            F.col("kind"),
            F.when(bolus, _crystalloid()).otherwise(_hour_share(F.col("amount") * 60)),
            F.when(bolus, _colloid()),
        ),
        (point_hours(points.filter(F.col("hourly") & ~urine)), F.col("kind"), F.col("value"), nothing),
        (
            spans,
            F.lit("void"),
            _hour_share(F.lit(0.0)),
            F.when(charted_here, F.col("minute_amount")),
        ),
    ]
    stream = reduce(
        DataFrame.unionByName,
        [
            df.select("stay_id", "hr", kind.alias("kind"), value.alias("value"), second.alias("second"))
            for df, kind, value, second in parts
        ],
    )
    sums = {
        "intake": ("intake", "value"),
        "blood": ("blood", "value"),
        "est_urine": ("void", "value"),
        "urine": ("void", "second"),
        "output": ("output", "value"),
        "dialysis": ("dialysis", "value"),
        "cristalloid": ("bolus", "value"),
        "colloid": ("bolus", "second"),
    }
    return stream.groupBy("stay_id", "hr").agg(
        *[
            F.expr(f"coalesce(sum(case when kind = '{kind}' then {value} end), 0D) as {name}")
            for name, (kind, value) in sums.items()
        ]
    )


def hourly(
    inputevents: DataFrame,
    outputevents: DataFrame,
    chartevents: DataFrame,
    urine_output: DataFrame,
    stays: DataFrame,
    totals: DataFrame | None = None,
    points: DataFrame | None = None,
) -> DataFrame:
    """Hourly fluid table with running balances, in whole mL.

    ``totals`` is ``input_totals``, ``points`` is ``fluid_points`` if they are at hand already.
    'intake', 'blood' and 'est_urine' are kept in sixtieths (amount x 60) up to here.
    """
    sums = hourly_sums(inputevents, outputevents, chartevents, urine_output, stays, totals, points)
    out = F.col("output") + F.col("dialysis")
    balance = F.col("intake") - (out + F.col("urine")) * 60
    estimated = F.col("intake") - out * 60 - F.col("est_urine")
    sums = sums.withColumn("balance", balance).withColumn("estimated", estimated)

    def mixed(c: Column) -> Column:
        return whole_even(sixtieths(c))

    return sums.select(
        "stay_id",
        "hr",
        mixed(F.col("intake")).alias("hourly_intake"),
        whole(out + F.col("urine")).alias("hourly_output"),
        mixed(F.col("balance")).alias("hourly_balance"),
        mixed(running_sum(F.col("balance"), "stay_id", "hr")).alias("cumm_hourly_balance"),
        mixed(running_sum(F.col("estimated"), "stay_id", "hr")).alias("est_cumm_hourly_balance"),
        whole(F.col("urine")).alias("hourly_urine"),
        mixed(F.col("est_urine")).alias("est_hourly_urine"),
        whole(F.col("dialysis")).alias("hourly_dialysis"),
        whole(F.col("cristalloid")).alias("hourly_cristalloid_bolus"),
        whole(F.col("colloid")).alias("hourly_colloid_bolus"),
        mixed(F.col("blood")).alias("hourly_blood"),
    )


# --- daily -------------------------------------------------------------------------

DAYS = 7
DAILY_MEASURES = [
    "cristalloid_bolus", "colloid_bolus", "bolus", "blood", "intake", "urine", "dialysis",
    "output", "fluid_balance",
]


def _day_share() -> Column:
    """Unlike the hourly view, an order inside one day counts as duration x rate."""
    low, high = F.col("day") * DAY, F.col("day") * DAY + DAY
    start, end, rate = F.col("start_offset"), F.col("end_offset"), F.col("rate")
    return rate_minutes(start, end, low, high, rate, (end - start) * rate, F.col("amount") * 60)


def daily_sums(
    inputevents: DataFrame,
    outputevents: DataFrame,
    chartevents: DataFrame,
    urine_output: DataFrame,
    stays: DataFrame,
    totals: DataFrame | None = None,
    days: int = DAYS,
    points: DataFrame | None = None,
) -> DataFrame:
    """``stay_id, day, kind, value, second``: one sum per stay, day and kind.

    Intake is spread over the days (value = amount x 60); blood and boluses count to the
    day they began, urine, output and dialysis to the day they were charted.
    """
    lengths = with_length(stays)
    given = input_totals(inputevents, lengths) if totals is None else totals
    given = _given_by(given, ["intake"], DAY, F.lit(days - 1), "day")
    kind = F.col("kind")
    if points is None:
        points = fluid_points(outputevents, chartevents, urine_output, lengths)
    by_points = (
        points.filter("daily")
        .withColumn("day", bucket_upto(F.col("offset"), DAY))
        .filter(F.col("day").between(0, days - 1))
        .select("stay_id", "day", "kind", "value", F.lit(None).cast("double").alias("second"))
    )
    by_given = given.select(
        "stay_id",
        "day",
        "kind",
        F.when(kind == "bolus", _crystalloid())
        .when(kind == "blood", F.col("amount"))
        .otherwise(_day_share())
        .alias("value"),
        F.when(kind == "bolus", _colloid()).alias("second"),
    )
    return (
        by_given.unionByName(by_points)
        .groupBy("stay_id", "day", "kind")
        .agg(F.sum("value").alias("value"), F.sum("second").alias("second"))
    )


def daily(
    inputevents: DataFrame,
    outputevents: DataFrame,
    chartevents: DataFrame,
    urine_output: DataFrame,
    stays: DataFrame,
    totals: DataFrame | None = None,
    days: int = DAYS,
    points: DataFrame | None = None,
) -> DataFrame:
    """Daily fluid totals and balances side by side, one row per stay, in whole mL.

    A day's balance is shown only for stays that reached the day (the seventh day opens
    with the fourth, after 72 hours, as published).  The overall total is always shown.
    """
    sums = daily_sums(inputevents, outputevents, chartevents, urine_output, stays, totals, days, points)
    sources = {
        "cristalloid_bolus": ("bolus", "value"),
        "colloid_bolus": ("bolus", "second"),
        **{k: (k, "value") for k in ("blood", "intake", "urine", "dialysis", "output")},
    }
    cells = []
    for name, (kind, value) in sources.items():
        cells += by_day("day", f"case when kind = '{kind}' then {value} end", days, name)
    wide = with_length(stays).join(sums.groupBy("stay_id").agg(*cells), "stay_id", "left")

    shown = {}
    for d in range(1, days + 1):
        def c(name, d=d):
            return F.col(f"d{d}_{name}")

        out = zero(c("output")) + zero(c("dialysis"))
        shown[d] = {
            "cristalloid_bolus": whole(c("cristalloid_bolus")),
            "colloid_bolus": whole(c("colloid_bolus")),
            "bolus": whole(zero(c("cristalloid_bolus")) + zero(c("colloid_bolus"))),
            "blood": whole(c("blood")),
            "intake": whole_even(sixtieths(c("intake"))),
            "urine": whole(c("urine")),
            "dialysis": whole(c("dialysis")),
            "output": whole(out),
            "fluid_balance": whole_even(sixtieths(zero(c("intake")) - out * 60)),
        }
    rounded = wide.select(
        "stay_id",
        "los_min",
        *[shown[d][m].alias(f"d{d}_{m}") for d in shown for m in DAILY_MEASURES],
    )

    balances = [F.col(f"d{d}_fluid_balance") for d in range(1, days + 1)]
    columns = []
    for d in range(1, days + 1):
        columns += [F.col(f"d{d}_{m}") for m in DAILY_MEASURES[:-1]]
        if d == 1:
            columns.append(balances[0])
            continue
        opens = (3 if d == 7 else d - 1) * DAY
        reached = F.col("los_min") > opens
        columns.append(F.when(reached, balances[d - 1]).alias(f"d{d}_fluid_balance"))
        columns.append(F.when(reached, total(balances[:d])).alias(f"d{d}_cumm_fluid_balance"))
    return rounded.select("stay_id", *columns, total(balances).alias(f"overall_{days}d_fluid"))
