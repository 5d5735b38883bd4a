"""Structured intent of a question column: plain expressions, no join, no shuffle."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from folioground import constants as C
from folioground.functions import text as X


#: What a text holds wherever a pattern matches: most texts hold none of it, and looking for it costs far less than the pattern.
HINTS = {
    "transgender": ["trans", "gender"], "rural": ["rural", "village", "gram", "taluka", "tehsil"],
    "urban": ["urban", "city", "town", "municipal", "metro", "slum"], "BPL": ["bpl", "below poverty line"],
    "EWS": ["ews", "economically weaker section"], "Antyodaya": ["antyodaya", "aay"],
    "disability": ["pwd", "disab", "divyang", "handicapped", "physically challenged", "blind", "impaired", "locomotor"],
    "income": ["income", "salary", "earning"], "standalone": ["lakh", "lac"]}


def holds(q: Column, parts: list[str]) -> Column:
    """One of the parts stands anywhere in the text."""
    if len(parts) == 1:
        return F.contains(q, F.lit(parts[0]))
    return F.exists(F.array(*map(F.lit, parts)), lambda part: F.contains(q, part))


def has_digit(q: Column) -> Column:
    return q.rlike(r"\p{Nd}")


def _longest_runs(keywords: Iterable[str]) -> Column:
    return F.array(*map(F.lit, sorted({max(re.findall("[a-z]+", k), key=len) for k in keywords})))


def runs(q: Column, keywords: Iterable[str] = C.ALL_KEYWORDS) -> Column:
    """Runs of the letters a to z of a text, those that are the longest of a keyword. A keyword that stands in the text as
    whole words has all its own runs there, so a text without its longest does not hold it."""
    return F.array_intersect(F.split(q, "[^a-z]+"), _longest_runs(keywords))


def may_hold(w: Column, keywords: Iterable[str]) -> Column:
    """Whether the longest run of one of the keywords is among the runs of a text."""
    return F.arrays_overlap(w, _longest_runs(keywords))


def any_word(q: Column, keywords: list[str], w: Column | None = None) -> Column:
    """One of the keywords stands in the text as whole words; only a text with a run of one is searched. ``w``: the runs, if at hand."""
    return may_hold(runs(q, keywords) if w is None else w, keywords) & q.rlike(r"(?U)\b(?:" + "|".join(rf"\Q{k}\E" for k in keywords) + r")\b")


def first_label(q: Column, table: dict[str, list[str]], w: Column | None = None) -> Column:
    expr = F.when(F.lit(False), F.lit(None).cast("string"))
    for label, keywords in table.items():
        expr = expr.when(any_word(q, keywords, w), label)
    return expr


def first_name(q: Column, names: dict[str, str], w: Column | None = None) -> Column:
    expr = F.when(F.lit(False), F.lit(None).cast("string"))
    for key, name in names.items():
        expr = expr.when(any_word(q, [key], w), name)
    return F.when(may_hold(runs(q, names) if w is None else w, names), expr)


def first_pattern(q: Column, patterns: list[tuple[str, str]]) -> Column:
    expr = F.when(F.lit(False), F.lit(None).cast("string"))
    for label, pattern in patterns:
        hit = q.rlike("(?U)" + pattern)
        expr = expr.when(holds(q, HINTS[label]) & hit if label in HINTS else hit, label)
    return expr


def information_type(q: Column, w: Column | None = None) -> Column:
    return F.coalesce(first_label(q, C.INFORMATION_TYPES, w), F.lit("general"))


def age(q: Column) -> Column:
    found = F.array(*[F.regexp_extract(q, "(?U)" + p, 1).try_cast("int") for p in C.AGE_PATTERNS])
    return F.when(has_digit(q), F.get(F.filter(found, lambda v: v.between(1, 120)), F.lit(0)))


def gender(q: Column) -> Column:
    return first_pattern(q, C.GENDERS)


def _band(label: str, top: Column) -> Column:
    return F.struct(F.lit(label).alias("income_range"), top.alias("max_income"))


def income(q: Column) -> Column:
    """struct(income_range, max_income): a named band, else an amount with its unit."""
    amount = F.regexp_replace(F.regexp_extract(q, "(?U)" + C.INCOME_AMOUNT, 1), ",", "").try_cast("double")
    unit = F.regexp_extract(q, "(?U)" + C.INCOME_AMOUNT, 2)
    units = F.create_map(*[F.lit(x) for pair in C.INCOME_UNITS.items() for x in pair])
    factor = F.coalesce(F.try_element_at(units, unit), F.lit(1.0))
    alone = F.regexp_extract(q, "(?U)" + C.INCOME_STANDALONE, 1).try_cast("double") * F.lit(100000.0)
    value = F.when(has_digit(q), F.coalesce(F.when(holds(q, HINTS["income"]), amount * factor), F.when(holds(q, HINTS["standalone"]), alone)))
    expr = None
    for label, pattern, top in C.INCOME_BANDS:
        hit = holds(q, HINTS[label]) & q.rlike("(?U)" + pattern)
        expr = F.when(hit, _band(label, F.lit(top))) if expr is None else expr.when(hit, _band(label, F.lit(top)))
    spoken = lambda v: F.when(v.isNotNull(), F.format_string("<= Rs. %,.0f", v))
    # The lambda's argument holds the amount, which is looked for once.
    amounts = F.transform(F.array(value), lambda v: F.struct(spoken(v).alias("income_range"), v.alias("max_income")))
    return expr.otherwise(F.get(amounts, F.lit(0)))


def location(q: Column, w: Column | None = None) -> Column:
    return F.coalesce(first_name(q, C.DISTRICTS, w), first_name(q, C.STATES, w))


def locality(q: Column) -> Column:
    return first_pattern(q, C.LOCALITIES)


def disability(q: Column) -> Column:
    percent = F.regexp_extract(q, "(?U)" + C.DISABILITY_PERCENT, 1)
    return F.when(holds(q, HINTS["disability"]) & q.rlike("(?U)" + C.DISABILITY), F.when(
        percent != "", F.concat(F.lit("PwD ("), percent, F.lit("% benchmark disability)")))
        .otherwise("PwD / Divyangjan"))


def profile_terms(q: Column, years: Column, w: Column | None = None) -> Column:
    tagged = [F.when(any_word(q, kws, w), label) for label, kws in C.PROFILE_TERMS.items()]
    tagged.append(F.when(years >= 60, "senior-citizen"))
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*tagged))))


def missing_field(q: Column, info: Column, category: Column, years: Column, income_range: Column,
                  occupation: Column, disabled: Column) -> Column:
    """What must be asked before an eligibility question can be answered safely, else null."""
    says = lambda *parts: _any(F.contains(q, F.lit(p)) for p in parts)
    is_cat = lambda name: F.coalesce(category == name, F.lit(False))
    farmer = F.coalesce(occupation == "farmer", F.lit(False)) | says("farmer", "land")
    return (
        F.when(info != "eligibility", F.lit(None).cast("string"))
        .when((is_cat("housing") | says("pmay", "housing")) & income_range.isNull(), "annual_income")
        .when((is_cat("pension") | says("old age", "pension", "senior")) & years.isNull(), "age")
        .when((is_cat("agriculture") | says("kisan")) & ~farmer, "farmer_status_and_landholding")
        .when((is_cat("disability") | says("disability", "divyang")) & disabled.isNull(), "disability_status")
        .when(category.isNull() & years.isNull() & income_range.isNull() & occupation.isNull()
              & disabled.isNull(), "scheme_name_or_category"))


def _any(conditions) -> Column:
    expr = F.lit(False)
    for c in conditions:
        expr = expr | c
    return expr


def follow_up(missing: Column) -> Column:
    expr = F.when(F.lit(False), F.lit(None).cast("string"))
    for field, question in C.FOLLOW_UPS.items():
        expr = expr.when(missing == field, question)
    return expr


def understand(queries: DataFrame, query: str = "query") -> DataFrame:
    """Add every extracted field to a table of questions. A blank question is general and safe."""
    q, w = F.col("_q"), F.col("_runs")
    beneficiary = F.col("beneficiary_type")
    backfill = F.when(F.lit(False), F.lit(None).cast("string"))
    for term, label in C.PROFILE_BACKFILL:
        backfill = backfill.when(F.array_contains("profile_terms", term), label)
    return (
        queries.withColumn("raw_query", X.strip(F.coalesce(query, F.lit(""))))
        .withColumn("_q", F.lower("raw_query")).withColumn("_runs", runs(q))
        .withColumns({
            "information_type": information_type(q, w), "scheme_category": first_label(q, C.SCHEME_CATEGORIES, w),
            "beneficiary_type": first_label(q, C.BENEFICIARY_TYPES, w), "age": age(q), "gender": gender(q),
            "_income": income(q), "occupation": first_label(q, C.OCCUPATIONS, w),
            "understood_location": location(q, w), "locality": locality(q), "disability_status": disability(q)})
        .withColumns({
            "income_range": F.col("_income.income_range"), "max_income": F.col("_income.max_income"),
            "profile_terms": profile_terms(q, F.col("age"), w)})
        .withColumn("beneficiary_type", F.coalesce(beneficiary, backfill))
        .withColumn("missing_field", missing_field(
            q, F.col("information_type"), F.col("scheme_category"), F.col("age"), F.col("income_range"),
            F.col("occupation"), F.col("disability_status")))
        .withColumns({
            "follow_up_question": follow_up(F.col("missing_field")),
            "is_safe_to_answer": F.col("missing_field").isNull(), "confidence": F.lit(1.0)})
        .drop("_q", "_runs", "_income"))


def fill_location(requested: Column, understood: Column) -> Column:
    """The location asked for, else the one understood from the question."""
    return F.coalesce(F.nullif(requested, F.lit("")), understood)
