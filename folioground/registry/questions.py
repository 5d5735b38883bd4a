"""Queries over question understanding."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioground import constants as C
from folioground.operators import understanding as U
from folioground.registry.base import query
from folioground.registry.sql_views import with_views
from folioground.sources import views as V


def asked(spark, sf_dir):
    """Questions from customers, then every conversation turn as a question; ``t`` is the text that is searched, ``w`` its runs."""
    q = V.questions(spark, sf_dir).select(F.col("query_id").alias("qid"), "query")
    c = V.read_texts(spark, sf_dir, "conversations", "conv_id").select(
        (-1 - F.col("conv_id") * 1000 - F.col("turn")).alias("qid"), F.col("text").alias("query"))
    return q.unionByName(c).withColumn("t", F.lower(F.trim("query"))).withColumn("w", U.runs(F.col("t")))


# Word boundaries of the SQL side know ASCII only, so accented letters stand in as plain ones.
_Q = {"q": """select qid, query, regexp_replace(lower(regexp_replace(regexp_replace(query, '^\\s+', ''), '\\s+$', '')), '[\\x{C0}-\\x{24F}]', 'q', 'g') as t from (
  select query_id as qid, query from v_questions union all select -1 - conv_id * 1000 - turn, text from conversations)"""}


def _any(words: list[str]) -> str:
    return f"regexp_matches(t, '\\b(?:{'|'.join(words)})\\b')"


def _labels(table: dict[str, list[str]], default: str = "null") -> str:
    return "case " + " ".join(f"when {_any(ws)} then '{k}'" for k, ws in table.items()) + f" else {default} end"


def _names(table: dict[str, str]) -> str:
    return "case " + " ".join(f"when {_any([k])} then '{v}'" for k, v in table.items()) + " end"


def _patterns(table: list[tuple[str, str]]) -> str:
    return "case " + " ".join(f"when regexp_matches(t, '{p}') then '{k}'" for k, p in table) + " end"


def _age() -> str:
    tries = []
    for p in C.AGE_PATTERNS:
        v = f"try_cast(regexp_extract(t, '{p}', 1) as int)"
        tries.append(f"case when {v} between 1 and 120 then {v} end")
    return f"coalesce({', '.join(tries)})"


_AMOUNT = f"try_cast(replace(regexp_extract(t, '{C.INCOME_AMOUNT}', 1), ',', '') as double)"
_UNIT = f"case regexp_extract(t, '{C.INCOME_AMOUNT}', 2) when 'lakh' then 1e5 when 'lakhs' then 1e5 when 'lac' then 1e5 when 'k' then 1e3 when 'thousand' then 1e3 when 'crore' then 1e7 else 1e0 end"
_VALUE = f"coalesce({_AMOUNT} * {_UNIT}, try_cast(regexp_extract(t, '{C.INCOME_STANDALONE}', 1) as double) * 1e5)"
_BAND = "case " + " ".join(f"when regexp_matches(t, '{p}') then {{}}" for _, p, _ in C.INCOME_BANDS) + " else {} end"
SQL = {
    "information_type": _labels(C.INFORMATION_TYPES, "'general'"), "scheme_category": _labels(C.SCHEME_CATEGORIES),
    "beneficiary_type": _labels(C.BENEFICIARY_TYPES), "age": _age(), "gender": _patterns(C.GENDERS), "occupation": _labels(C.OCCUPATIONS),
    "income_range": _BAND.format("'BPL'", "'EWS'", "'Antyodaya'", f"'<= Rs. ' || format('{{:,}}', cast({_VALUE} as bigint))"),
    "max_income": _BAND.format("150000e0", "300000e0", "100000e0", _VALUE),
    "understood_location": f"coalesce({_names(C.DISTRICTS)}, {_names(C.STATES)})", "locality": _patterns(C.LOCALITIES),
    "disability_status": f"""case when regexp_matches(t, '{C.DISABILITY}') then case when regexp_extract(t, '{C.DISABILITY_PERCENT}', 1) <> ''
      then 'PwD (' || regexp_extract(t, '{C.DISABILITY_PERCENT}', 1) || '% benchmark disability)' else 'PwD / Divyangjan' end end""",
}
_PROFILE = "list_sort(list_distinct(list_filter([" + ", ".join(f"case when {_any(ws)} then '{k}' end" for k, ws in C.PROFILE_TERMS.items()) + \
    f", case when {_age()} >= 60 then 'senior-citizen' end], lambda x: x is not null)))"
_FIELDS = {"f": "select qid, t, " + ", ".join(f"{sql} as {name}" for name, sql in SQL.items()) + f", {_PROFILE} as profile from q"}


def _single(name: str, expr):
    @query(f"question_{name}", with_views("v_questions", extra=_Q, body=f"select qid, {SQL[name]} as {name} from q"))
    def run(spark, sf_dir):
        return asked(spark, sf_dir).select("qid", expr(F.col("t"), F.col("w")).alias(name))
    return run


_single("information_type", U.information_type)
_single("age", lambda q, w: U.age(q))
_single("gender", lambda q, w: U.gender(q))
_single("scheme_category", lambda q, w: U.first_label(q, C.SCHEME_CATEGORIES, w))
_single("beneficiary_type", lambda q, w: U.first_label(q, C.BENEFICIARY_TYPES, w))
_single("occupation", lambda q, w: U.first_label(q, C.OCCUPATIONS, w))
_single("disability_status", lambda q, w: U.disability(q))


@query("question_income", with_views("v_questions", extra=_Q, body=f"select qid, {SQL['income_range']} as income_range, {SQL['max_income']} as max_income from q"))
def question_income(spark, sf_dir):
    return asked(spark, sf_dir).select("qid", U.income(F.col("t")).alias("i")).select("qid", "i.*")


@query("question_location", with_views("v_questions", extra=_Q, body=f"""
select qid, {SQL['understood_location']} as place, {SQL['locality']} as locality, case when qid % 9 = 0 then 'Goa' else {SQL['understood_location']} end as filter_place from q"""))
def question_location(spark, sf_dir):
    q, w = F.col("t"), F.col("w")
    return asked(spark, sf_dir).select(
        "qid", U.location(q, w).alias("place"), U.locality(q).alias("locality"),
        U.fill_location(F.when(F.col("qid") % 9 == 0, "Goa"), U.location(q, w)).alias("filter_place"))


@query("question_profile_terms", with_views("v_questions", extra={**_Q, **_FIELDS}, body="select qid, array_to_string(profile, ',') as profile_terms from f"))
def question_profile_terms(spark, sf_dir):
    q, w = F.col("t"), F.col("w")
    return asked(spark, sf_dir).select("qid", F.array_join(U.profile_terms(q, U.age(q), w), ",").alias("profile_terms"))


_SAFE = """case when information_type <> 'eligibility' then null
 when (scheme_category = 'housing' or contains(t, 'pmay') or contains(t, 'housing')) and income_range is null then 'annual_income'
 when (scheme_category = 'pension' or contains(t, 'old age') or contains(t, 'pension') or contains(t, 'senior')) and age is null then 'age'
 when (scheme_category = 'agriculture' or contains(t, 'kisan')) and coalesce(occupation, '') <> 'farmer' and not contains(t, 'farmer') and not contains(t, 'land') then 'farmer_status_and_landholding'
 when (scheme_category = 'disability' or contains(t, 'disability') or contains(t, 'divyang')) and disability_status is null then 'disability_status'
 when scheme_category is null and age is null and income_range is null and occupation is null and disability_status is null then 'scheme_name_or_category' end"""


@query("question_safety_gate", with_views("v_questions", extra={**_Q, **_FIELDS}, body=f"""
select qid, m as missing_field, m is null as is_safe_to_answer, case m {' '.join(f"when '{k}' then '{v}'" for k, v in C.FOLLOW_UPS.items())} end as follow_up_question
from (select qid, {_SAFE} as m from f)"""))
def question_safety_gate(spark, sf_dir):
    return U.understand(asked(spark, sf_dir)).select("qid", "missing_field", "is_safe_to_answer", "follow_up_question")


@query("question_understanding", with_views("v_questions", extra={**_Q, **_FIELDS}, body=f"""
select qid, information_type, scheme_category, coalesce(beneficiary_type, case when list_contains(profile, 'widow') then 'widow' when list_contains(profile, 'student') then 'student'
  when list_contains(profile, 'farmer') then 'farmer' when list_contains(profile, 'senior-citizen') then 'senior_citizen' end) as beneficiary_type,
 age, gender, income_range, max_income, occupation, understood_location, locality, disability_status, array_to_string(profile, ',') as profile_terms,
 ({_SAFE}) is null as is_safe_to_answer, 1.0e0 as confidence from f"""))
def question_understanding(spark, sf_dir):
    return U.understand(asked(spark, sf_dir)).select(
        "qid", "information_type", "scheme_category", "beneficiary_type", "age", "gender", "income_range", "max_income", "occupation",
        "understood_location", "locality", "disability_status", F.array_join("profile_terms", ",").alias("profile_terms"), "is_safe_to_answer", "confidence")
