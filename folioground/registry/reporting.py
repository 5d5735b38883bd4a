"""Reports, screening and registered SQL functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioground.functions import text as X
from folioground.operators import catalog as D, eligibility as EL, reports as R
from folioground.registry.base import query
from folioground.registry.sql_views import fold, with_views
from folioground.registry.text import chunk_sql
from folioground.sources import views as V


@query("question_history", with_views("v_qa", body="select qa_id, question, is_refusal, latency_ms from v_qa order by qa_id desc limit 50"))
def question_history(spark, sf_dir):
    return R.newest(V.qa_log(spark, sf_dir).select("qa_id", "question", "is_refusal", F.col("latency_ms").cast("bigint")), 50, "qa_id")


@query("audit_history", "select event_id, ts, user_id, event_type as action from events order by ts desc, event_id desc limit 100")
def audit_history(spark, sf_dir):
    return R.newest(V.audit_events(spark, sf_dir), 100, "ts", "event_id").select(
        "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", "action")


@query("status_counts", with_views("v_documents", body="select collection_id, status, count(*) as n_documents from v_documents group by all"))
def status_counts(spark, sf_dir):
    return R.status_counts(V.documents(spark, sf_dir))


@query("answer_feedback", with_views("v_feedback", "v_qa", body="""
select q.collection_id, count(*) as n_ratings, round(avg(case when rating = 1 then 1.0e0 else 0.0e0 end), 6) as helpful_rate from v_feedback f join v_qa q using (qa_id) group by 1"""))
def answer_feedback(spark, sf_dir):
    return R.helpfulness(V.feedback(spark, sf_dir), V.qa_log(spark, sf_dir))


@query("service_levels", with_views("v_qa", body="""
select collection_id, count(*) as n_answers, round(avg(case when is_refusal then 1.0e0 else 0.0e0 end), 6) as refusal_rate,
 round(quantile_cont(cast(latency_ms as double), 0.95), 4) as latency_p95 from v_qa group by 1"""))
def service_levels(spark, sf_dir):
    return R.service_levels(V.qa_log(spark, sf_dir))


@query("ingestion_success", with_views("v_jobs", body="""
select count(*) as n_jobs, round(avg(case when status = 'COMPLETED' then 1.0e0 else 0.0e0 end), 6) as success_rate
from (select * from v_jobs qualify row_number() over (partition by document_id, version_id order by created_seq desc) = 1)"""))
def ingestion_success(spark, sf_dir):
    return R.ingestion_success(D.latest_jobs(V.jobs(spark, sf_dir), "document_id", "version_id"))


@query("audit_rollup", """
select event_type as action, cast(ts as date) as day, count(*) as n_events, round(sum(value), 2) as total_value from events group by rollup (event_type, cast(ts as date))""")
def audit_rollup(spark, sf_dir):
    return R.audit_rollup(V.audit_events(spark, sf_dir), F.to_date("ts"))


_SCREEN = """select applicant_id, 'income-ews' as rule_id, 'Pradhan Mantri Awas Yojana - Urban (PMAY-U) - CLSS EWS' as scheme, annual_income <= 300000 as eligible,
  case when annual_income > 300000 then printf('annual_income %s exceeds 300,000', case when annual_income >= 1000000 then
    cast(cast(annual_income as bigint) // 1000000 as varchar) || ',' || lpad(cast(cast(annual_income as bigint) // 1000 % 1000 as varchar), 3, '0') || ',' || lpad(cast(cast(annual_income as bigint) % 1000 as varchar), 3, '0')
    else cast(cast(annual_income as bigint) // 1000 as varchar) || ',' || lpad(cast(cast(annual_income as bigint) % 1000 as varchar), 3, '0') end || '.00') end as reason,
  case when annual_income <= 300000 then 'PMAY-U Guidelines 2024, Page 14' end as citation from v_applicants where annual_income is not null
 union all select applicant_id, 'land-holding', 'PM-Kisan Samman Nidhi', true, null, 'PM-Kisan Guidelines 2024, Page 4' from v_applicants where landholding_hectares > 0"""


@query("eligibility_screening", with_views("v_applicants", extra={"s": _SCREEN}, body="select * from s"))
def eligibility_screening(spark, sf_dir):
    return EL.screen(V.applicants(spark, sf_dir), EL.default_rules(spark))


@query("eligibility_summary", with_views("v_applicants", extra={"s": _SCREEN}, body="""
select applicant_id, count(*) filter (where eligible) as n_eligible, count(*) filter (where not eligible) as n_ineligible,
 'Evaluated criteria: ' || count(*) filter (where eligible) || ' potentially applicable schemes found, ' || count(*) filter (where not eligible) || ' schemes ineligible based on stated parameters.' as evaluation_summary
from v_applicants left join s using (applicant_id) group by applicant_id"""))
def eligibility_summary(spark, sf_dir):
    a = V.applicants(spark, sf_dir)
    return EL.screening_summary(a, EL.screen(a, EL.default_rules(spark)))


@query("eligibility_bands", with_views("v_applicants", body="""
select band, count(*) as n_applicants from (select case when annual_income > 0 and annual_income <= 100000 then 'a' when annual_income > 100000 and annual_income <= 300000 then 'b'
 when annual_income > 300000 and annual_income <= 600000 then 'c' end as band from v_applicants) where band is not null group by band"""))
def eligibility_bands(spark, sf_dir):
    """Income bands as rules: a range join on the stated value."""
    bands = spark.createDataFrame([("a", "annual_income", 0.0, 100000.0, "band a", ""), ("b", "annual_income", 100000.0, 300000.0, "band b", ""),
                                   ("c", "annual_income", 300000.0, 600000.0, "band c", "")], "rule_id string, field string, lo double, hi double, scheme string, citation string")
    s = EL.screen(V.applicants(spark, sf_dir).select("applicant_id", "annual_income"), bands).filter("eligible")
    return s.groupBy(F.col("rule_id").alias("band")).agg(F.count("*").alias("n_applicants"))


@query("sql_functions", """
select vec_id, round(greatest(0e0, least(1e0, list_cosine_similarity(cast(embedding as double[]), list_transform(cast(embedding as double[]), lambda x, i: x * i)))), 6) as similarity from embeddings""")
def sql_functions(spark, sf_dir):
    from folioground.functions.register import register_all
    register_all(spark)
    e = V.read_texts(spark, sf_dir, "embeddings", "vec_id").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return e.select("vec_id", F.round(F.call_function("cosine", F.col("e"), F.transform("e", lambda x, i: x * (i + 1))), 6).alias("similarity"))


@query("sql_normalize_text", f"select doc_id, sha256({fold('text')}) as folded_hash from documents")
def sql_normalize_text(spark, sf_dir):
    """The search form of a text by its SQL name."""
    from folioground.functions.register import register_all
    register_all(spark)
    return V.read_texts(spark, sf_dir, "documents", "doc_id").select("doc_id", F.sha2(F.call_function("normalize_text", F.col("text")), 256).alias("folded_hash"))


@query("sql_chunk_function", chunk_sql("select version_id, page_number, idx_in_page, section_heading, t as chunk_text from chunk"))
def sql_chunk_function(spark, sf_dir):
    from folioground.functions.register import register_all
    register_all(spark)
    V.pages(spark, sf_dir).createOrReplaceTempView("pages_to_chunk")
    return spark.sql("""select version_id, page_number, c.idx_in_page, c.section_heading, c.chunk_text
                        from pages_to_chunk, lateral chunk_text(raw_text, 350, 40) c""")
