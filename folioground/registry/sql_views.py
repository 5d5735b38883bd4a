"""The adapter views and shared steps as DuckDB SQL, composed into WITH clauses."""

NOT_WS = r"[^\t-\r\x1c-\x20\x{85}\p{Z}]"
WS = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
LEN_WORD = r"[a-zA-Z0-9_-]"


def words(x: str) -> str:
    return f"regexp_extract_all({x}, '{NOT_WS}+')"


def n_words(x: str) -> str:
    return f"coalesce(len({words(x)}), 0)"


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{WS}+', ''), '{WS}+$', '')"


def fold(x: str) -> str:
    kept = rf"regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_\t-\r\x1c-\x20\x{{85}}\p{{Z}}.,\-%/:;]', ' ', 'g')"
    return f"coalesce(trim(regexp_replace({kept}, '{WS}+', ' ', 'g')), '')"


def meaningful(x: str) -> str:
    return (f"(len({words(x)}) >= 5 and length(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}]', '', 'g')) >= 10)")


STATUS = """case doc_id % 11 when 0 then 'DELETED' when 1 then 'ARCHIVED' when 2 then 'FAILED'
 when 3 then 'PROCESSING' else 'ACTIVE' end"""
EFFECTIVE = "case when doc_id % 9 <> 0 then timestamp '2024-01-01' + to_days(cast(doc_id % 365 as int)) end"

VIEWS = {
    "v_documents": ([], f"""
select doc_id as document_id, source as collection_id,
 'Scheme ' || source || '-' || cast(doc_id % 7 as varchar) as scheme_name,
 'Department ' || cast(cast(substr(source, 4) as int) % 4 as varchar) as department,
 case doc_id % 3 when 0 then 'National / All States' when 1 then 'Maharashtra - Pune' else 'Karnataka' end as state_or_district,
 lang as language, cast(1 + doc_id % 3 as int) as version_number, {STATUS} as status,
 sha256(text) as file_hash, {EFFECTIVE} as effective_date, text
from documents"""),
    "v_versions": ([], f"""
select doc_id || ':' || k as version_id, doc_id as document_id, cast(k as int) as version_number,
 sha256(case when k = 1 + doc_id % 3 then text else k || 'text' end) as file_hash,
 n_chars * k as file_size_bytes,
 case when doc_id % 10 <> 0 then cast(case when k = 1 + doc_id % 3
   then (len(string_split(text, chr(10))) + 7) // 8 else 1 end as int) end as total_pages,
 case when k <> 1 + doc_id % 3 then 'ARCHIVED' else {STATUS} end as status,
 case when k % 2 = 1 then {EFFECTIVE} end as effective_date
from (select *, unnest(generate_series(1, 1 + doc_id % 3)) as k from documents)"""),
    "v_pages": ([], """
select doc_id || ':' || (1 + doc_id % 3) as version_id, doc_id as document_id,
 cast(i + 1 as int) as page_number, array_to_string(ls[i * 8 + 1 : i * 8 + 8], chr(10)) as raw_text
from (select doc_id, ls, unnest(generate_series(0, (len(ls) - 1) // 8)) as i
 from (select doc_id, string_split(text, chr(10)) as ls from documents))"""),
    "v_lines": (["v_pages"], """
select version_id, page_number, unnest(string_split(raw_text, chr(10))) as line,
 unnest(generate_series(0, len(string_split(raw_text, chr(10))) - 1)) as line_no from v_pages"""),
    "v_readings": (["v_pages"], f"""
select version_id, document_id, page_number,
 case when document_id % 5 = 0 then array_to_string({words('raw_text')}[1:5], ' ') else raw_text end as native_text,
 case when document_id % 4 <> 1 then raw_text end as ocr_text from v_pages"""),
    "v_collections": ([], """
select source as collection_id, 'Collection ' || n as name, 'slug-' || n as slug, cast(n % 4 as int) as department_id,
 n % 5 = 0 as is_private, n % 10 <> 9 as is_active, cast(n as bigint) as owner_user_id
from (select distinct source, cast(substr(source, 4) as int) as n from documents)"""),
    "v_users": ([], """
select c_custkey as user_id, case c_mktsegment when 'AUTOMOBILE' then 'SYSTEM_ADMIN' when 'BUILDING' then 'SCHEME_ADMIN'
 when 'FURNITURE' then 'HELPDESK' when 'HOUSEHOLD' then 'CITIZEN' end as role from customer"""),
    "v_permissions": ([], """
select * from (values
 ('SYSTEM_ADMIN', ['admin:all','users:manage','audit:read','docs:all','docs:upload','docs:process','docs:archive','docs:delete',
   'collections:manage','query:execute','citations:preview','feedback:submit','history:read','eligibility:check']),
 ('SCHEME_ADMIN', ['docs:upload','docs:process','docs:archive','docs:delete','docs:all','collections:manage','audit:read',
   'query:execute','citations:preview','feedback:submit']),
 ('HELPDESK', ['query:execute','citations:preview','feedback:submit','history:read','eligibility:check']),
 ('CITIZEN', ['query:execute','citations:preview','feedback:submit'])) as t(role, perms)"""),
    "v_user_perms": (["v_users", "v_permissions"], """
select u.user_id, u.role, coalesce(p.perms, []::varchar[]) as perms from v_users u left join v_permissions p using (role)"""),
    "v_passages": (["v_pages"], f"""
select version_id || ':' || page_number || ':' || (page_number - 1) as vector_id, version_id, document_id, page_number,
 page_number - 1 as chunk_index,
 case when document_id % 6 = 0 then array_to_string({words('raw_text')}[1:3], ' ') end as section_heading,
 raw_text as chunk_text, {fold('raw_text')} as normalized_text
from v_pages where {meaningful('raw_text')}"""),
    "v_payload": (["v_passages", "v_documents", "v_versions"], """
select p.*, d.collection_id, 'corpus:' || d.collection_id as namespace, v.version_number, d.scheme_name, d.department,
 d.state_or_district, d.language, d.status as document_status, v.status as version_status,
 d.status = 'ACTIVE' and v.status = 'ACTIVE' as active, d.status = 'ARCHIVED' or v.status = 'ARCHIVED' as is_historical,
 strftime(coalesce(v.effective_date, d.effective_date), '%Y-%m-%d %H:%M:%S') as effective_date
from v_passages p join v_versions v using (version_id) join v_documents d on d.document_id = p.document_id"""),
    "v_bench": ([], f"""
select item_id as query_id, case when item_id % 4 = 3 then '"' || q || '"' else q end as query,
 'src' || (item_id % 20) as collection_id, item_id % 8 = 1 as include_historical,
 case when item_id % 5 = 2 then 'scheme src' end as scheme, case when item_id % 10 = 4 then 'pune' end as state_or_district,
 case when item_id % 5 = 1 then 'EN' end as language
from (select item_id, array_to_string({words('text')}, ' ') as q from benchmark)"""),
    "v_parsed": (["v_bench"], f"""
select *, lower(query) as q_low, {fold('query')} as q_norm,
 regexp_extract_all(query, '"([^"]*)"', 1) as phrases,
 list_filter({words("regexp_replace(query, '\"[^\"]*\"', ' ', 'g')")}, lambda t: length(t) > 1) as raw_tokens,
 list_filter({words(fold('query'))}, lambda t: length(t) > 1) as norm_tokens
from v_bench"""),
    "v_scored": (["v_parsed", "v_payload"], """
select q.query_id, c.*, round(
  case when contains(lower(c.scheme_name), q.q_low) then 3.0e0 else 0.0e0 end
  + coalesce(list_sum(list_transform(q.phrases, lambda p: case when contains(lower(c.chunk_text), lower(p)) then 2.5e0
      when contains(c.normalized_text, lower(p)) then 2.0e0 else 0.0e0 end)), 0.0e0)
  + 1.5e0 * len(list_filter(q.raw_tokens, lambda t: contains(lower(coalesce(c.section_heading, '')), lower(t))))
  + 1.0e0 * len(list_filter(q.norm_tokens, lambda t: contains(c.normalized_text, t) or contains(lower(c.chunk_text), t)))
  + 1.5e0 * len(list_filter(q.norm_tokens, lambda t: contains(lower(c.scheme_name), t)))
  + case when contains(lower(c.chunk_text), q.q_low) then 2.0e0 else 0.0e0 end, 2) as match_score
from v_parsed q join v_payload c on c.collection_id = q.collection_id
where c.document_status <> 'DELETED' and (q.include_historical or c.active)
 and (q.scheme is null or contains(lower(c.scheme_name), lower(q.scheme)))
 and (q.state_or_district is null or contains(lower(c.state_or_district), lower(q.state_or_district)))
 and (q.language is null or contains(lower(c.language), lower(q.language)))
 and case when len(q.phrases) > 0 then
   len(list_filter(q.phrases, lambda p: not (contains(lower(c.chunk_text), lower(p)) or contains(c.normalized_text, lower(p))
     or contains(lower(c.scheme_name), lower(p))))) = 0
  else len(list_filter(q.raw_tokens, lambda t: contains(lower(c.chunk_text), lower(t)) or contains(c.normalized_text, lower(t))
     or contains(lower(coalesce(c.section_heading, '')), lower(t)) or contains(lower(c.scheme_name), lower(t))
     or contains(lower(c.department), lower(t)))) > 0
   or len(list_filter(q.norm_tokens, lambda t: contains(c.normalized_text, t))) > 0 end"""),
    "v_kw_ranked": (["v_scored"], """
select *, row_number() over (partition by query_id order by match_score desc, vector_id) as kw_rank from v_scored"""),
    "v_top": (["v_kw_ranked"], """
select *, least(1.0e0, match_score / greatest(1.0e0, max(match_score) over (partition by query_id))) as kw_score
from v_kw_ranked where kw_rank <= 15"""),
    "v_qa": ([], """
select a.conv_id * 1000 + a.turn as qa_id, a.conv_id, a.text as question, b.text as answer,
 'src' || (a.conv_id % 20) as collection_id, 100 + (length(a.text) * 7) % 4000 as latency_ms, length(b.text) % 7 = 0 as is_refusal
from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1
where a.role = 'user' and b.role = 'assistant'"""),
    "v_feedback": ([], """
select doc_id * 1000 as qa_id, doc_id as user_id, case when quality = 1 then 1 else -1 end as rating from labels"""),
    "v_uploads": ([], """
select doc_id as upload_id, doc_id || case when doc_id % 13 = 0 then '.txt' else '.PDF' end as filename,
 case when doc_id % 23 = 0 then 0 else n_chars * 4096 end as file_size_bytes, doc_id % 17 <> 0 as confirmed,
 case when doc_id % 19 = 0 then 'unknown' else source end as collection_id, text from documents"""),
    "v_applicants": ([], """
select c_custkey as applicant_id, case when c_custkey % 11 <> 0 then round(c_acctbal * 100, 0) end as annual_income,
 case when c_custkey % 13 <> 0 then (c_custkey % 7) / 2.0e0 end as landholding_hectares from customer"""),
    "v_jobs": ([], """
select 'job-' || doc_id || '-' || k as job_id, doc_id as document_id, doc_id || ':' || (1 + doc_id % 3) as version_id,
 case when k = 2 and doc_id % 5 = 0 then 'FAILED' when k = 2 then 'COMPLETED' else 'QUEUED' end as status,
 cast(k * 50 as int) as progress_percent, k as created_seq,
 case when k = 2 and doc_id % 2 = 0 then doc_id % 9 + 1 end as s_total_pages,
 case when k = 2 and doc_id % 2 = 0 then doc_id % 4 end as s_ocr_pages, k = 2 and doc_id % 2 = 0 as has_summary
from (select *, unnest([1, 2]) as k from documents where doc_id % 3 <> 0)"""),
    "v_meta": ([], """
select doc_id as document_id, 'key_' || data_type as meta_key, data_type,
 case data_type when 'integer' then case when doc_id % 7 = 0 then 'n/a' else cast(n_chars as varchar) end
  when 'date' then '2024-' || lpad(cast(doc_id % 14 + 1 as varchar), 2, '0') || '-15'
  when 'boolean' then case when doc_id % 2 = 0 then 'true' else 'false' end
  when 'json' then '{"k": ' || (doc_id % 10) || '}' else source end as meta_value
from (select *, unnest(['integer', 'date', 'boolean', 'json', 'string']) as data_type from documents)"""),
    "v_questions": ([], """
select c_custkey as query_id, case c_custkey % 6
 when 0 then 'Am I eligible for the old age pension, I am ' || (18 + c_custkey % 80) || ' years old'
 when 1 then 'What documents are required for a house loan in Pune city for ews woman'
 when 2 then 'Am I eligible for kisan support, annual income below ' || (1 + c_custkey % 9) || ' lakh'
 when 3 then 'How much subsidy for disabled weaver with ' || (40 + c_custkey % 60) || '% disability in Bihar village'
 when 4 then 'What is the last date for student scholarship in tamil nadu'
 else 'check application status' end as query, 'src' || (c_custkey % 20) as collection_id, c_custkey as user_id
from customer"""),
}


def with_views(*names: str, body: str, extra: dict[str, str] | None = None) -> str:
    """``body`` behind the named views and all they depend on; ``extra`` follows them."""
    ordered: list[str] = []

    def add(name: str) -> None:
        deps, _ = VIEWS[name]
        for d in deps:
            add(d)
        if name not in ordered:
            ordered.append(name)

    for n in names:
        add(n)
    parts = [f"{n} as materialized ({VIEWS[n][1].strip()})" for n in ordered]
    parts += [f"{n} as materialized ({sql.strip()})" for n, sql in (extra or {}).items()]
    return ("with " + ",\n".join(parts) + "\n" if parts else "") + body.strip()
