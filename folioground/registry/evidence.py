"""Queries over grounding: sufficiency, answers, claims, citation checks, reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioground import constants as C
from folioground.functions import access as A
from folioground.operators import citations as CI, fusion, grounding as G, keyword as KW, reports as R
from folioground.plans import answer_log as L
from folioground.registry.base import query
from folioground.registry.retrieval import keyword_hits, passage_payload, payload_of, staged
from folioground.registry.sql_views import WS, strip, with_views
from folioground.sources import views as V
from folioground.staging import stage_path, stage_table


def shown_passages(spark, sf_dir):
    """Five best keyword passages per question, fused without vectors."""
    def build():
        hits = keyword_hits(spark, sf_dir, 15)
        p = payload_of(passage_payload(spark, sf_dir), hits)
        kw = KW.normalized_scores(hits).join(p.select("vector_id", "version_id", "page_number"), "vector_id")
        none = kw.limit(0).select("query_id", "vector_id", "version_id", "page_number", F.lit(0.0).alias("vec_score"), F.lit(1).alias("vec_rank"))
        merged = fusion.merge_candidates(kw, none).join(p.drop("version_id", "page_number"), "vector_id")
        return stage_table(fusion.citations(fusion.final_rank(fusion.fused_scores(merged))), "shown")
    return staged(spark, sf_dir, "shown_passages", build)


def questions(spark, sf_dir):
    """The questions; some ask for something their passages do not hold, some need a follow-up."""
    i = F.col("query_id")
    return V.bench_queries(spark, sf_dir).select(
        "query_id", F.when(i % 3 == 0, "What is the last date for student scholarship").otherwise(F.col("query")).alias("query"),
        F.when(i % 6 < 2, C.FOLLOW_UPS["age"]).alias("follow_up_question"), (i % 6 >= 2).alias("is_safe_to_answer"))


SHOWN = {
    "f0": """select *, cast(printf('%.4f', greatest(0e0, least(1e0, case when not is_historical then least(1e0, b + 0.05e0) else b end))) as double) as score
      from (select *, least(0.92e0, 0.45e0 + 0.45e0 * kw_score) as b from v_top)""",
    "shown": """select query_id, rank, document_id, scheme_name || ' (v' || version_number || ')' as document_title, version_id, page_number, section_heading,
      case when length(chunk_text) > 400 then substr(chunk_text, 1, 400) || '...' else chunk_text end as excerpt, score, scheme_name, collection_id from (
      select *, row_number() over (partition by query_id order by score desc, is_historical, version_number desc, kw_rank, vector_id) as rank from f0 where score >= 0.5) where rank <= 5""",
    "asked": f"""select query_id, case when query_id % 3 = 0 then 'What is the last date for student scholarship' else query end as query,
      case when query_id % 6 < 2 then '{C.FOLLOW_UPS['age']}' end as follow_up, query_id % 6 >= 2 as safe from v_bench""",
}
STOP = "[" + ", ".join(f"'{w}'" for w in C.STOPWORDS) + "]"


def all_words(x: str) -> str:
    runs = f"list_filter(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_-]+'), lambda w: regexp_full_match(w, '[a-z0-9_-]+'))"
    return f"list_distinct(flatten(list_transform({runs}, lambda w: regexp_extract_all(w, '\\b[a-zA-Z0-9_-]{{3,}}\\b'))))"


def content(x: str) -> str:
    return f"list_filter({all_words(x)}, lambda w: not list_contains({STOP}, w))"


SUFFICIENT = {
    **SHOWN,
    "ev": "select query_id, max(score) as top, lower(string_agg(concat_ws(' ', document_title, excerpt, coalesce(section_heading, '')), ' ' order by rank)) as body from shown group by 1",
    "su": f"""select a.*, top, len(ts) as n, len(list_filter(ts, lambda w: contains(body, w))) as hit from (select *, {content('query')} as ts from asked) a left join ev using (query_id)""",
    "suff": """select *, case when top is null then 'NO_PASSAGES_RETRIEVED' when top < 0.45 then 'RELEVANCE_BELOW_THRESHOLD (' || printf('%.2f', top) || ' < 0.45)'
      when n = 0 then 'SUFFICIENT' when hit / n < 0.2 then 'KEYWORD_OVERLAP_TOO_LOW (' || printf('%.2f', hit / n) || ' < 0.20)' else 'SUFFICIENT' end as reason from su""",
}
TEMPLATE = f"""'Under ' || document_title || ', Page ' || page_number || case when coalesce(section_heading, '') <> '' then ' [' || section_heading || ']' else '' end || ': '
 || {strip('excerpt')} || ' [Source: ' || document_title || ', Page ' || page_number || '].'"""
DRAFTS = {
    **SUFFICIENT,
    "tops": f"select query_id, {TEMPLATE} as t from shown where rank = 1",
    "drafts": f"""select s.query_id, reason <> 'SUFFICIENT' as is_refusal, case when reason <> 'SUFFICIENT' then reason end as refusal_reason,
      case when reason <> 'SUFFICIENT' then case when follow_up is not null and not safe then '{C.NO_ANSWER_FOLLOW_UP}' || follow_up else '{C.NO_ANSWER_PLAIN}' end
       else t || case when follow_up is not null and not safe then '{C.FOLLOW_UP_NOTE}' || follow_up else '' end end as answer
      from suff s left join tops using (query_id)""",
}


def claims_sql(answers: str, shown: str, p: str = "") -> dict[str, str]:
    """Statements of answers (akey, query_id, answer) checked against the passages of ``shown``."""
    marker = r"(?i)\[(?:Source:\s*|Doc:\s*)?([^,\]]+),\s*Page\s*(\d+)\]"
    anymark = r"(?i)\[(?:Source:\s*|Doc:\s*)?[^\]]+\]"
    return {
        f"{p}sent": f"""select akey, query_id, i as claim_idx, {strip('s')} as s from (select akey, query_id, unnest(ss) as s, unnest(generate_series(0, len(ss) - 1)) as i
          from (select *, string_split(regexp_replace(answer, '([.!?]){WS}+([A-Z\\[])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) as ss from {answers}))""",
        f"{p}st": f"""select *, regexp_matches(s, '{marker}') as cited, trim(regexp_extract(s, '{marker}', 1)) as ct, try_cast(regexp_extract(s, '{marker}', 2) as int) as cp,
          starts_with(lower(s), 'under ') or starts_with(lower(s), 'based on ') as lead, case when regexp_matches(s, '{marker}') then {content(f"regexp_replace(s, '{anymark}', '', 'g')")} else {content('s')} end as said
          from {p}sent where s <> '' and not starts_with(s, 'Note:') and not contains(s, 'safely without guessing') and not starts_with(s, 'To evaluate your eligibility')
           and not regexp_matches(s, '(?i)^\\[(?:Source:\\s*|Doc:\\s*)?[^\\]]+\\]\\.?$')""",
        f"{p}bp": f"""select query_id, lower(trim(document_title)) as tl, page_number, min(rank) as rank, arg_max(document_title || ' ' || excerpt, rank) as body from {shown} group by all""",
        f"{p}c1": f"""select akey, claim_idx, arg_min(case when len(said) > 0 then len(list_intersect(said, {all_words('body')})) / len(said) else 1e0 end, rank) as ov
          from {p}st join {p}bp b using (query_id) where cited and (contains(tl, lower(ct)) or contains(lower(ct), tl)) and (cp is null or cp = page_number) group by all""",
        f"{p}c2": f"""select akey, claim_idx, arg_min(struct_pack(o := ov, t := document_title, p := page_number), rank) as m from (
          select akey, claim_idx, rank, document_title, page_number, lead, said, case when len(said) > 0 then
            len(list_intersect(said, {all_words("concat_ws(' ', document_title, excerpt, coalesce(section_heading, ''))")})) / len(said) else 1e0 end as ov
          from {p}st join {shown} using (query_id) where not cited) where lead or (len(said) > 0 and ov >= 0.2) group by all""",
        f"{p}claims": f"""select akey, query_id, claim_idx, s as statement, case when cited then ct else m.t end as document_title, case when cited then cp else m.p end as page_number,
          case when cited then coalesce(ov >= 0.15, false) else m is not null end as verified, round(case when cited then coalesce(ov, 0) else coalesce(m.o, 0) end, 6) as overlap
          from {p}st left join {p}c1 using (akey, claim_idx) left join {p}c2 using (akey, claim_idx)""",
        f"{p}verdict": f"""select a.akey, a.query_id, coalesce(bool_and(verified) filter (where not starts_with(statement, 'Based on official scheme') and not starts_with(statement, 'Note:')), bool_and(verified), false) as grounded,
          count(c.akey) as n_claims, not coalesce(bool_and(verified), true) as has_unsupported from {answers} a left join {p}claims c on c.akey = a.akey group by a.akey, a.query_id""",
    }


@query("evidence_sufficiency", with_views("v_top", extra=SUFFICIENT, body="select query_id, reason = 'SUFFICIENT' as is_sufficient, reason from suff"))
def evidence_sufficiency(spark, sf_dir):
    return G.evidence_sufficiency(questions(spark, sf_dir), shown_passages(spark, sf_dir))


@query("extractive_answers", with_views("v_top", extra=DRAFTS, body="select query_id, is_refusal, refusal_reason, answer from drafts"))
def extractive_answers(spark, sf_dir):
    return G.draft_answers(questions(spark, sf_dir), shown_passages(spark, sf_dir))


@query("strict_rewrites", with_views("v_top", extra=SHOWN, body=f"select query_id, {TEMPLATE} as answer from shown where rank = 2"))
def strict_rewrites(spark, sf_dir):
    """Answers written anew when the first passage is not supported."""
    return G.extractive_answers(shown_passages(spark, sf_dir).filter("rank > 1"))


@query("strict_rewrites_or_refusals", with_views("v_top", "v_bench", extra=SHOWN, body=f"""
select b.query_id, coalesce({TEMPLATE}, '{C.NO_ANSWER_NO_PASSAGE}') as answer, s.query_id is null as is_refusal from v_bench b left join shown s on s.query_id = b.query_id and s.rank = 3"""))
def strict_rewrites_or_refusals(spark, sf_dir):
    """Every question answered anew from its third passage on; without one, a refusal."""
    return G.strict_answers(V.bench_queries(spark, sf_dir), shown_passages(spark, sf_dir).filter("rank > 2"))


def _talk(spark, sf_dir):
    """Assistant turns as answers, with and without a source marker, about the passages of a question."""
    c = V.read_texts(spark, sf_dir, "conversations", "conv_id").filter("role = 'assistant'")
    key = F.col("conv_id") * 1000 + F.col("turn")
    n_questions = V.read(spark, sf_dir, "benchmark").agg(F.count("*").alias("n_questions"))
    shown = shown_passages(spark, sf_dir).filter("rank = 1").select("query_id", "document_title", "page_number", "excerpt")
    mark = F.when(F.col("turn") % 3 == 1, F.concat(F.lit(" [Source: "), "document_title", F.lit(", Page "), F.col("page_number").cast("string"), F.lit("].")))
    quote = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit(" Based on official text: "), F.substring("excerpt", 1, 80), F.lit(".")))
    asked = c.crossJoin(F.broadcast(n_questions)).withColumn("query_id", F.col("conv_id") % F.col("n_questions"))  # one row
    return (asked.select(key.alias("akey"), "query_id", "text", "conv_id", "turn").join(shown, "query_id", "left")
            .select("akey", "query_id", F.concat("text", F.coalesce(mark, F.lit("")), F.coalesce(quote, F.lit("")), F.lit(" Note: ask again.")).alias("answer")))


_TALK = {**SHOWN, "talk": """select conv_id * 1000 + turn as akey, conv_id % n_questions as query_id, text || coalesce(case when turn % 3 = 1 then ' [Source: ' || document_title || ', Page ' || page_number || '].' end, '')
   || coalesce(case when conv_id % 2 = 0 then ' Based on official text: ' || substr(excerpt, 1, 80) || '.' end, '') || ' Note: ask again.' as answer
  from conversations c cross join (select count(*) as n_questions from benchmark) left join shown on shown.query_id = conv_id % n_questions and rank = 1 where role = 'assistant'""", **claims_sql("talk", "shown")}


@query("answer_sentences", with_views("v_top", extra=_TALK, body="select akey, query_id, cast(claim_idx as int) as claim_idx, s as statement from st"))
def answer_sentences(spark, sf_dir):
    return G.answer_sentences(_talk(spark, sf_dir), ["akey", "query_id"])


@query("citation_markers", with_views("v_top", extra=_TALK, body="""
select akey, query_id, cast(claim_idx as int) as claim_idx, case when cited then ct end as cited_title, case when cited then cp end as cited_page from st"""))
def citation_markers(spark, sf_dir):
    return G.citation_markers(G.answer_sentences(_talk(spark, sf_dir), ["akey", "query_id"])).drop("statement")


@query("claim_checks", with_views("v_top", extra=_TALK, body="select akey, query_id, cast(claim_idx as int) as claim_idx, statement, document_title, page_number, verified, overlap from claims"))
def claim_checks(spark, sf_dir):
    return G.check_claims(_talk(spark, sf_dir), shown_passages(spark, sf_dir), ["akey", "query_id"])


@query("answer_verdicts", with_views("v_top", extra=_TALK, body="select akey, query_id, grounded, n_claims, has_unsupported from verdict"))
def answer_verdicts(spark, sf_dir):
    t = _talk(spark, sf_dir)
    return G.answer_verdicts(t, G.check_claims(t, shown_passages(spark, sf_dir), ["akey", "query_id"]), ["akey", "query_id"])


@query("grounded_answers", with_views("v_top", extra={
    **DRAFTS, "mine": "select query_id as akey, query_id, answer from drafts where not is_refusal", **claims_sql("mine", "shown")}, body=f"""
select d.query_id, case when not is_refusal and not grounded then '{C.NO_ANSWER_UNVERIFIED}' else answer end as answer, is_refusal or not grounded as is_refusal,
 is_refusal or grounded as grounding_verified, case when not is_refusal and not grounded then 'GROUNDING_VALIDATION_FAILED' else refusal_reason end as refusal_reason
from drafts d left join verdict v using (query_id)"""))
def grounded_answers(spark, sf_dir):
    return G.grounded_answers(questions(spark, sf_dir), shown_passages(spark, sf_dir))


# ---- citations ------------------------------------------------------------------------

def cited(spark, sf_dir):
    """Shown passages as citations, some of them spoiled in a way that one of the checks must find."""
    k = (F.col("query_id") * 5 + F.col("rank")) % 11
    lost = k.isin(0, 1)
    return shown_passages(spark, sf_dir).select(
        "query_id", "rank", (F.col("rank") - 1).alias("citation_index"),
        F.when(lost, F.lit(-1)).when(k == 5, F.col("document_id") + 1).otherwise(F.col("document_id")).alias("document_id"),
        F.when(k == 0, F.concat(F.lit("SCHEME "), F.substring_index(F.substring("document_title", 8, 99), "-", 1), F.lit("-")))
        .when(k == 1, "No Such Title").otherwise(F.col("document_title")).alias("document_title"),
        F.when(lost, F.lit(None).cast("string")).otherwise(F.col("version_id")).alias("version_id"),
        F.when(k == 2, 0).when(k == 3, 99).otherwise(F.col("page_number")).alias("page_number"), "section_heading",
        F.when(k == 4, "Zebra quartz wholly unrelated wording.").otherwise(F.col("excerpt")).alias("excerpt"))


def citation_requests(spark, sf_dir):
    who = V.users(spark, sf_dir).select("user_id", A.role_permissions(F.col("role")).alias("permissions"))
    q = V.bench_queries(spark, sf_dir).withColumn("user_id", F.when(F.col("query_id") % 3 != 0, F.col("query_id")))
    return (q.join(who, "user_id", "left").withColumn("permissions", F.coalesce("permissions", A.text_array([])))
            .select("query_id", "collection_id", "user_id", "permissions", "include_historical"))


def checked(spark, sf_dir):
    return CI.validate_citations(
        cited(spark, sf_dir), citation_requests(spark, sf_dir), V.documents(spark, sf_dir), V.versions(spark, sf_dir),
        V.pages(spark, sf_dir), V.collections(spark, sf_dir), shown_passages(spark, sf_dir))


CITED = {
    **SHOWN,
    "cited": """select query_id, rank, rank - 1 as citation_index, case when k in (0, 1) then -1 when k = 5 then document_id + 1 else document_id end as document_id,
      case k when 0 then 'SCHEME ' || string_split(substr(document_title, 8), '-')[1] || '-' when 1 then 'No Such Title' else document_title end as document_title,
      case when k in (0, 1) then null else version_id end as version_id, case k when 2 then 0 when 3 then 99 else page_number end as page_number, section_heading,
      case when k = 4 then 'Zebra quartz wholly unrelated wording.' else excerpt end as excerpt from (select *, (query_id * 5 + rank) % 11 as k from shown)""",
    "found": """select c.*, coalesce(d.document_id, (select min(x.document_id) from v_documents x where contains(lower(x.scheme_name), lower(c.document_title)))) as resolved
      from cited c left join v_documents d on d.document_id = c.document_id""",
    "seen": f"""select query_id, citation_index, bool_or((p_doc = resolved or p_doc = document_id) and (len(cw) = 0 or len(list_intersect(cw, pw)) / len(cw) >= 0.25
        or contains(lower(p_text), lower(excerpt)) or contains(lower(excerpt), lower(p_text)))) as ok from (
      select f.*, {content('f.excerpt')} as cw, p.document_id as p_doc, p.excerpt as p_text, {all_words('p.excerpt')} as pw from found f join shown p using (query_id)) group by all""",
    "newest": "select document_id, arg_max(coalesce(total_pages, 0), version_number) as mp from v_versions group by 1",
    "checked": """select f.query_id, f.citation_index, f.document_id, f.document_title, f.page_number, case when f.resolved is null then 'DOCUMENT_NOT_FOUND'
       when d.collection_id <> q.collection_id then 'WRONG_COLLECTION'
       when c.is_private and not coalesce(c.owner_user_id = u.user_id, false) and not list_has_any(coalesce(u.perms, []::varchar[]), ['admin:all', 'docs:all', 'collections:manage']) then 'UNAUTHORIZED_PRIVATE_COLLECTION'
       when (d.status = 'ARCHIVED' or coalesce(v.status = 'ARCHIVED', false)) and not (q.include_historical and list_has_any(coalesce(u.perms, []::varchar[]), ['admin:all', 'docs:all', 'docs:archive'])) then 'UNAUTHORIZED_ARCHIVED_DOCUMENT'
       when f.page_number <= 0 or (p.page_number is null and (mp = 0 or f.page_number > mp)) then 'INVALID_PAGE_NUMBER'
       when not coalesce(s.ok, true) then 'NOT_IN_RETRIEVED_EVIDENCE' end as error_reason
      from found f join v_bench q using (query_id) left join v_documents d on d.document_id = f.resolved left join v_collections c on c.collection_id = q.collection_id
      left join v_user_perms u on u.user_id = case when q.query_id % 3 <> 0 then q.query_id end left join v_versions v on v.version_id = f.version_id
      left join v_pages p on p.document_id = f.resolved and p.page_number = f.page_number left join newest n on n.document_id = f.resolved
      left join seen s on s.query_id = f.query_id and s.citation_index = f.citation_index""",
    "report": """select query_id, count(*) as total_citations, count(*) filter (where error_reason is null) as valid_citations, count(*) filter (where error_reason is not null) as invalid_citations,
      coalesce(string_agg('Citation #' || (citation_index + 1) || ' (' || document_title || ', Page ' || page_number || ') rejected: ' || error_reason, chr(10) order by citation_index)
        filter (where error_reason is not null), '') as warnings from checked group by 1""",
}
_CITED_VIEWS = ("v_top", "v_documents", "v_versions", "v_collections", "v_user_perms", "v_pages", "v_bench")


@query("citation_checks", with_views(*_CITED_VIEWS, extra=CITED, body="""
select query_id, cast(citation_index as int) as citation_index, document_id, document_title, page_number, error_reason is null as is_valid, error_reason from checked"""))
def citation_checks(spark, sf_dir):
    return checked(spark, sf_dir)


@query("evidence_provenance", with_views(*_CITED_VIEWS, extra=CITED, body="""
select error_reason, count(*) as n from checked where coalesce(error_reason, 'NOT_IN_RETRIEVED_EVIDENCE') = 'NOT_IN_RETRIEVED_EVIDENCE' group by 1"""))
def evidence_provenance(spark, sf_dir):
    late = F.coalesce("error_reason", F.lit("NOT_IN_RETRIEVED_EVIDENCE")) == "NOT_IN_RETRIEVED_EVIDENCE"
    return checked(spark, sf_dir).filter(late).groupBy("error_reason").agg(F.count("*").alias("n"))


@query("citation_title_fallback", with_views("v_documents", body="""
select needle as title, min(document_id) as document_id from (select distinct 'sCHEME ' || source || '-' as needle from documents) t
join v_documents d on contains(lower(d.scheme_name), lower(needle)) group by 1"""))
def citation_title_fallback(spark, sf_dir):
    docs = V.documents(spark, sf_dir)
    titles = docs.select(F.concat(F.lit("sCHEME "), "collection_id", F.lit("-")).alias("document_title")).distinct().withColumn(
        "document_id", -F.length("document_title").cast("bigint"))
    return CI._resolve_documents(titles, docs).select(F.col("document_title").alias("title"), F.col("resolved").alias("document_id"))


@query("citation_report", with_views(*_CITED_VIEWS, extra=CITED, body="select * from report"))
def citation_report(spark, sf_dir):
    return CI.validation_report(checked(spark, sf_dir))


@query("citation_accuracy", with_views(*_CITED_VIEWS, extra=CITED, body="""
select cast(sum(total_citations) as bigint) as total_citations, cast(sum(valid_citations) as bigint) as valid_citations, round(sum(valid_citations)::double / sum(total_citations), 6) as citation_accuracy from report"""))
def citation_accuracy(spark, sf_dir):
    return R.citation_accuracy(CI.validation_report(checked(spark, sf_dir)))


_RECON = {
    **CITED,
    "supported": "select c.* from cited c join checked k using (query_id, citation_index) where k.error_reason is null",
    "given": f"select query_id, {TEMPLATE} || ' Zebras gallop over quartz hills daily.' as answer from shown where rank = 1 and query_id % 2 = 0 union all select query_id, {TEMPLATE} from shown where rank = 1 and query_id % 2 = 1",
    "rew": f"select query_id, {TEMPLATE} as answer from (select *, row_number() over (partition by query_id order by rank) as rn from supported) where rn = 1",
    "both_answers": "select query_id * 2 as akey, query_id, answer from given union all select query_id * 2 + 1, query_id, answer from rew",
    **claims_sql("both_answers", "supported"),
    "fin": """select g.query_id, g.answer, w.answer as rewritten, total_citations, valid_citations, invalid_citations, a.grounded and not a.has_unsupported and invalid_citations = 0 as sound, coalesce(b.grounded, false) as redone
      from given g join report r using (query_id) join verdict a on a.akey = g.query_id * 2 left join verdict b on b.akey = g.query_id * 2 + 1 left join rew w on w.query_id = g.query_id""",
}


@query("answer_reconciliation", with_views(*_CITED_VIEWS, extra=_RECON, body=f"""
select query_id, case when valid_citations = 0 then '{C.NO_ANSWER_BAD_CITATIONS}' when sound then answer when redone then rewritten else answer end as final_answer,
 valid_citations > 0 and (sound or redone) as grounding_verified, case when valid_citations = 0 then '{C.WARN_NO_CITATION}' when sound then null
 when redone then case when invalid_citations > 0 then 'Notice: ' || invalid_citations || ' unverified citation(s) were removed. The answer has been regenerated strictly from verified official sources.' end
 else '{C.WARN_UNVERIFIED}' end as verification_warning, valid_citations = 0 or not sound as has_unsupported_claims, total_citations, valid_citations, invalid_citations from fin"""))
def answer_reconciliation(spark, sf_dir):
    check = stage_table(checked(spark, sf_dir), "checked")
    return CI.reconcile(_first_answers(spark, sf_dir), cited(spark, sf_dir), check)


def _first_answers(spark, sf_dir):
    """Answers from the first passage, every other one with a statement that no passage has."""
    extra = F.when(F.col("query_id") % 2 == 0, F.concat("answer", F.lit(" Zebras gallop over quartz hills daily."))).otherwise(F.col("answer"))
    return G.extractive_answers(shown_passages(spark, sf_dir).filter("rank = 1")).withColumn("answer", extra)


# ---- the log of a run -------------------------------------------------------------------

_LOG = {
    **_RECON,
    "done": f"""select query_id, total_citations, valid_citations, invalid_citations, valid_citations = 0 or not sound as unsupported,
      case when valid_citations = 0 then '{C.NO_ANSWER_BAD_CITATIONS}' when sound then answer when redone then rewritten else answer end as answer, valid_citations > 0 and (sound or redone) as ok,
      case when valid_citations = 0 then '{C.WARN_NO_CITATION}' when sound then null when redone then case when invalid_citations > 0 then 'Notice: ' || invalid_citations
       || ' unverified citation(s) were removed. The answer has been regenerated strictly from verified official sources.' end else '{C.WARN_UNVERIFIED}' end as warning from fin""",
    "logged": f"""select 'first:' || b.query_id as qa_id, b.query_id, case when b.query_id % 5 > 0 then 'visitor-' || b.query_id % 17 end as session_token, b.query_id % 3 as asked_at, b.collection_id,
      b.query as question, coalesce(d.answer, '{C.NO_ANSWER_PLAIN}') as answer, d.query_id is null as is_refusal, coalesce(ok, true) as grounding_verified, warning as verification_warning
      from v_bench b left join done d using (query_id)""",
    "finals": "select query_id as akey, query_id, answer from done where valid_citations > 0",
    **{k: v for k, v in claims_sql("finals", "supported", "f").items()},
}


def _written_run(spark, sf_dir, table):
    """Write the log of a run over every question, twice as after a lost driver, and read a table of it."""
    i = F.col("query_id")
    asked = V.bench_queries(spark, sf_dir).select(
        "query_id", "query", "collection_id", F.when(i % 5 > 0, F.concat(F.lit("visitor-"), (i % 17).cast("string"))).alias("session_token"), (i % 3).alias("asked_at"))
    first = stage_table(_first_answers(spark, sf_dir), "first_answers")
    plain = F.col("answer").isNull()
    given = asked.select("query_id").join(first, "query_id", "left").select(
        "query_id", F.coalesce("answer", F.lit(C.NO_ANSWER_PLAIN)).alias("answer"), plain.alias("is_refusal"), F.lit(True).alias("grounding_verified"))
    shown = shown_passages(spark, sf_dir).select("query_id", "rank", "score")
    marks = stage_table(cited(spark, sf_dir).join(shown, ["query_id", "rank"]), "marks")
    check = stage_table(checked(spark, sf_dir), "checked")
    final = stage_table(CI.reconcile(first, marks, check), "final")
    facts = L.run_facts(asked, given, marks, check, final, "first")
    root, docs = stage_path(spark, "answer_log"), V.documents(spark, sf_dir)
    for _ in range(2):
        L.write_run(facts, docs, root, "first")
    return L.read_log(spark, root, table).drop("run_id")


@query("answer_log_answers", with_views(*_CITED_VIEWS, extra=_LOG, body="select * exclude (query_id) from logged"))
def answer_log_answers(spark, sf_dir):
    return _written_run(spark, sf_dir, "answers")


@query("answer_log_sessions", with_views(*_CITED_VIEWS, extra=_LOG, body="""
select session_token, arg_min(collection_id, (asked_at, query_id)) as collection_id, min(asked_at) as created_at from logged where session_token is not null group by 1"""))
def answer_log_sessions(spark, sf_dir):
    return _written_run(spark, sf_dir, "sessions")


@query("answer_log_citations", with_views(*_CITED_VIEWS, extra=_LOG, body="""
select 'first:' || c.query_id as qa_id, c.rank, c.document_id, c.page_number, c.document_title, c.excerpt, s.score as confidence_score
from supported c join shown s using (query_id, rank) where c.document_id in (select document_id from v_documents)"""))
def answer_log_citations(spark, sf_dir):
    return _written_run(spark, sf_dir, "citations")


@query("answer_log_claims", with_views(*_CITED_VIEWS, extra=_LOG, body="""
select 'first:' || query_id as qa_id, cast(claim_idx as int) as claim_idx, statement, document_title, page_number, verified, overlap from fclaims"""))
def answer_log_claims(spark, sf_dir):
    return _written_run(spark, sf_dir, "claims")


@query("answer_log_reports", with_views(*_CITED_VIEWS, extra=_LOG, body="""
select 'first:' || d.query_id as qa_id, d.total_citations, d.valid_citations, d.invalid_citations, unsupported as has_unsupported_claims,
 concat_ws(chr(10), nullif(warnings, ''), warning) as warnings, details from done d join report using (query_id)
 join (select query_id, string_agg(citation_index || ' ' || document_id || ' ' || page_number || ' ' || coalesce(error_reason, 'ok'), ';' order by citation_index) as details from checked group by 1) using (query_id)"""))
def answer_log_reports(spark, sf_dir):
    line = F.transform("details", lambda d: F.concat_ws(" ", d["citation_index"].cast("string"), d["document_id"].cast("string"), d["page_number"].cast("string"),
                                                      F.coalesce(d["error_reason"], F.lit("ok"))))
    return _written_run(spark, sf_dir, "reports").withColumns({"warnings": F.array_join("warnings", "\n"), "details": F.array_join(line, ";")})
