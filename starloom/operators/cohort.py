"""Retention of cohorts defined by the first active month."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starloom.functions.exact import rounded_ratio
from starloom.functions.measures import month_ordinal


WORD = 63  # bits of a long below its sign
MOST_WORDS = 32  # 170 years of months


def cohort_retention(df: DataFrame, user: str, month: str) -> DataFrame:
    """``(cohort_month, cohort_size, month_number, retained, retention_pct)`` for every observed pair.

    ``month`` holds first days of months. Rows without a user count as one person in the cohort size but are
    never retained. A person's active months are bits of a few longs, so one hash aggregate and one shuffle on the
    user make them, however many rows the person has: neither a self-join nor a second distinct is needed.
    """
    ordinal = month_ordinal(F.col(month))
    first, last = df.agg(F.min(ordinal), F.max(ordinal)).head()
    words = 0 if first is None else (last - first) // WORD + 1
    activity = (_by_bits(df, user, month, first, last) if words <= MOST_WORDS else _by_sets(df, user, month)).select(
        "_known",
        "cohort_month",
        (month_ordinal(F.col("_month")) - month_ordinal(F.col("cohort_month"))).alias("month_number"),
        "_people",
    )
    counted = activity.groupBy("cohort_month", "month_number").agg(
        F.sum("_people").alias("_all"),
        F.sum(F.when(F.col("_known"), F.col("_people")).otherwise(0)).alias("retained"),
    )
    # Everyone is active in month 0 of their own cohort, so that row holds the cohort size.
    size = F.max(F.when(F.col("month_number") == 0, F.col("_all"))).over(Window.partitionBy("cohort_month"))
    # At most one row per pair of calendar months is left: one partition serves the window and the sort.
    return (
        counted.repartition(1)
        .withColumn("cohort_size", size)
        .filter(F.col("retained") > 0)
        .select(
            "cohort_month",
            "cohort_size",
            "month_number",
            "retained",
            rounded_ratio(F.col("retained"), F.col("cohort_size"), per=100).alias("retention_pct"),
        )
        .orderBy("cohort_month", F.col("month_number").asc_nulls_last())
    )


def _by_bits(df: DataFrame, user: str, month: str, first: int | None, last: int | None) -> DataFrame:
    """``_known``, ``cohort_month``, ``_month`` and ``_people``: how many of a cohort were active in a month (NULL: undated)."""
    kind = df.schema[month].dataType
    months_in_all = 0 if first is None else last - first + 1
    words = -(-months_in_all // WORD)
    place = month_ordinal(F.col(month)) - F.lit(first)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (place % WORD).cast("int"))
    names = [f"_bits{w}" for w in range(words)]
    bits = [
        F.coalesce(F.bit_or(F.when(F.floor(place / F.lit(WORD)) == w, bit)), F.lit(0).cast("long")).alias(name)
        for w, name in enumerate(names)
    ]
    people = df.groupBy(user).agg(F.max(F.col(month).isNull()).alias("_undated"), *bits)
    known, one = F.col(user).isNotNull().alias("_known"), F.lit(1).cast("long").alias("_people")
    if not words:
        nothing = F.lit(None).cast(kind)
        return people.filter(F.lit(False)).select(known, nothing.alias("cohort_month"), nothing.alias("_month"), one)
    # The lowest bit that is set: what x and x - 1 differ in are that bit and those below it.
    starts = [
        F.when(F.col(x) != 0, F.bit_count(F.col(x).bitwiseXOR(F.col(x) - 1)) - 1 + w * WORD) for w, x in enumerate(names)
    ]
    # One place past the last stands for undated rows: with a cohort they are activity too.
    every = F.explode(F.sequence("_start", F.lit(months_in_all))).alias("_place")
    active = F.lit(False)
    for w, x in enumerate(names):
        here = F.col("_place").between(w * WORD, min(w * WORD + WORD, months_in_all) - 1)
        active = active | (here & (F.getbit(F.col(x), F.pmod("_place", F.lit(WORD))) == 1))
    undated = (F.col("_place") == months_in_all) & F.col("_undated")
    cohorts = people.select(known, "_undated", *names, F.coalesce(*starts).alias("_start")).filter("_start IS NOT NULL")
    months = cohorts.select("*", every).filter(active | undated)
    months = months.withColumn("_place", F.when(F.col("_place") < months_in_all, F.col("_place")))

    def day(place: str):
        # Ordinals count 12 months a year from month 1 on.
        before = F.col(place) + F.lit(first - 1)
        return F.make_date(F.floor(before / 12).cast("int"), (before % 12 + 1).cast("int"), F.lit(1)).cast(kind)

    return months.select("_known", day("_start").alias("cohort_month"), day("_place").alias("_month"), one)


def _by_sets(df: DataFrame, user: str, month: str) -> DataFrame:
    """The same for calendars that would take too many longs: sets of months."""
    people = df.groupBy(user).agg(
        F.collect_set(month).alias("_months"), F.max(F.col(month).isNull()).alias("_undated")
    )
    undated = F.array(F.lit(None).cast(df.schema[month].dataType))
    active = F.when(F.col("_undated"), F.concat("_months", undated)).otherwise(F.col("_months"))
    return (
        people.select(F.col(user).isNotNull().alias("_known"), F.array_min("_months").alias("cohort_month"), active.alias("_active"))
        .filter(F.col("cohort_month").isNotNull())
        .select("_known", "cohort_month", F.explode("_active").alias("_month"), F.lit(1).cast("long").alias("_people"))
    )
