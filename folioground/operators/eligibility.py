"""Screening applicants against rules held in a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioground import constants as C


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        C.SCREENING_RULES, "rule_id string, field string, lo double, hi double, scheme string, citation string")


def stated_values(applicants: DataFrame, fields: list[str]) -> DataFrame:
    """(applicant_id, field, value) for every parameter an applicant states."""
    parts = [applicants.select("applicant_id", F.lit(f).alias("field"), F.col(f).cast("double").alias("value")) for f in fields]
    return reduce(DataFrame.unionByName, parts).filter(F.col("value").isNotNull())


def within(value: Column, lo: Column, hi: Column) -> Column:
    """Above the exclusive lower bound and up to the inclusive upper one; a missing bound is open."""
    return (lo.isNull() | (value > lo)) & (hi.isNull() | (value <= hi))


def screen(applicants: DataFrame, rules: DataFrame) -> DataFrame:
    """Applicants against the rules on the fields they state: an equality on the field name, salted
    because there are few fields and many applicants. A failed lower bound alone is not reported."""
    fields = [r for r in applicants.columns if r != "applicant_id"]
    salts = 32
    values = stated_values(applicants, fields).withColumn("salt", F.pmod(F.xxhash64("applicant_id"), F.lit(salts)).cast("int"))
    spread = rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    ok = within(F.col("value"), F.col("lo"), F.col("hi"))
    reason = F.when(~ok, F.format_string("%s %,.2f exceeds %,.0f", "field", "value", "hi"))
    return (
        values.join(spread, ["field", "salt"]).withColumn("eligible", ok)
        .filter(F.col("eligible") | F.col("hi").isNotNull())
        .select("applicant_id", "rule_id", "scheme", "eligible", reason.alias("reason"),
                F.when(F.col("eligible"), F.col("citation")).alias("citation")))


def screening_summary(applicants: DataFrame, screened: DataFrame) -> DataFrame:
    counts = screened.groupBy("applicant_id").agg(
        F.count_if("eligible").alias("n_eligible"), F.count_if(~F.col("eligible")).alias("n_ineligible"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    return applicants.select("applicant_id").join(counts, "applicant_id", "left").select(
        "applicant_id", zero("n_eligible").alias("n_eligible"), zero("n_ineligible").alias("n_ineligible"),
        F.format_string("Evaluated criteria: %d potentially applicable schemes found, %d schemes ineligible based on "
                        "stated parameters.", zero("n_eligible"), zero("n_ineligible")).alias("evaluation_summary"))
