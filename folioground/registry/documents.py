"""Queries over the catalog: intake, versions, duplicates, listings, lifecycle, access, index upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioground import constants as C
from folioground.functions import access as A, text as X, vectors as VX
from folioground.operators import catalog as D, index as I, matching as M, reports as R
from folioground.plans import answer as PA, ingest as P, jobs as JB
from folioground.registry.base import query
from folioground.registry.retrieval import passage_payload, staged
from folioground.registry.sql_views import VIEWS, fold, n_words, strip, with_views
from folioground.sources import tables as S, views as V
from folioground.sources.blobs import content_hash, header_reason
from folioground.staging import stage_table

BIG = "bigint"


# ---- sources and writes -----------------------------------------------------------

@query("table_scan", "select doc_id, lang, n_chars from documents where n_chars > 1000 and lang = 'en'")
def table_scan(spark, sf_dir):
    return V.read(spark, sf_dir, "documents").filter("n_chars > 1000 and lang = 'en'").select("doc_id", "lang", "n_chars")


@query("upload_intake", with_views("v_uploads", "v_collections", body="""
select upload_id, filename, file_size_bytes, u.collection_id, r is null as accepted, r as reason from (
 select u.*, case when not ends_with(lower(filename), '.pdf') then 'INVALID_EXTENSION' when file_size_bytes > 52428800 then 'FILE_TOO_LARGE'
  when file_size_bytes = 0 then 'FILE_EMPTY' when not confirmed then 'SOURCE_NOT_CONFIRMED' when c.collection_id is null then 'COLLECTION_NOT_FOUND' end as r
 from v_uploads u left join v_collections c using (collection_id)) u"""))
def upload_intake(spark, sf_dir):
    return S.upload_verdicts(V.uploads(spark, sf_dir), V.collections(spark, sf_dir))


@query("content_hashes", "select doc_id, sha256(text) as file_hash, octet_length(encode(text)) as n_bytes from documents")
def content_hashes(spark, sf_dir):
    t = V.read_texts(spark, sf_dir, "documents", "doc_id")
    return t.select("doc_id", content_hash(F.col("text").cast("binary")).alias("file_hash"), F.octet_length("text").cast(BIG).alias("n_bytes"))


@query("base64_payloads", with_views("v_uploads", body="""
select upload_id, case when upload_id % 29 = 0 then null else sha256(text) end as payload_hash from v_uploads"""))
def base64_payloads(spark, sf_dir):
    raw = F.when(F.col("upload_id") % 29 == 0, "not base64 !").otherwise(F.col("content_base64"))
    return V.uploads(spark, sf_dir).select("upload_id", F.sha2(S.decode_payload(raw), 256).alias("payload_hash"))


@query("file_header_check")
def file_header_check(spark, sf_dir):
    """Texts stored as files, read back through the file source: text, PDF-like and empty ones."""
    from folioground.sources.blobs import scan_blobs
    folder = staged(spark, sf_dir, "blobs", lambda: _store_blobs(spark, sf_dir))
    content = F.expr("substring(content, locate(':', cast(content as string)) + 1)")
    b = scan_blobs(spark, folder, "*.txt").withColumn("body", content)
    return b.select(F.length("body").cast(BIG).alias("n_bytes"), content_hash(F.col("body")).alias("file_hash"), header_reason(F.col("body")).alias("reason"))


@query("header_reasons", """
select doc_id, case when b = '' then 'File is empty (0 bytes).' when not starts_with(b, '%PDF-') then 'Invalid PDF file: Missing ''%PDF-'' header signature.' end as reason
from (select doc_id, case when doc_id % 7 = 0 then '' when doc_id % 3 = 0 then '%PDF-1.7 ' || text else text end as b from documents)""")
def header_reasons(spark, sf_dir):
    """Texts as stored bytes: some empty, some with the header of the format."""
    d = F.col("doc_id")
    body = F.when(d % 7 == 0, "").otherwise(F.concat(F.when(d % 3 == 0, "%PDF-1.7 ").otherwise(""), "text"))
    return V.read(spark, sf_dir, "documents").select("doc_id", header_reason(body.cast("binary")).alias("reason"))


def _store_blobs(spark, sf_dir) -> str:
    from folioground.staging import stage_path
    path = stage_path(spark, "blobs")
    d = F.col("doc_id")
    head = F.when(d % 3 == 0, "%PDF-1.7 ").otherwise("")
    line = F.concat(d.cast("string"), F.lit(":"), F.when(d % 7 == 0, "").otherwise(F.concat(head, F.replace("text", F.lit("\n"), F.lit(" ")))))
    V.read(spark, sf_dir, "documents").repartition(64, "doc_id").select(line.alias("value")).write.text(path)
    return path


@query("replace_version_pages", with_views("v_pages", body="""
select version_id, page_number, case when document_id % 4 = 0 then 'new ' || raw_text else raw_text end as raw_text
from v_pages where not (document_id % 4 = 0 and page_number > 1)"""))
def replace_version_pages(spark, sf_dir):
    """Versions processed again now have one page each: their old pages go."""
    old = V.pages(spark, sf_dir).select("version_id", "page_number", "raw_text", "document_id")
    new = old.filter("document_id % 4 = 0 and page_number = 1").withColumn("raw_text", F.concat(F.lit("new "), "raw_text"))
    return S.replace_rows(old, new, ["version_id"]).drop("document_id")


@query("vector_upsert", """
select namespace, vector_id, round(list_sum(cast(v as double[])), 4) as value_sum from (
 select 'ns:' || label as namespace, cast(vec_id as varchar) as vector_id, embedding as v from embeddings where vec_id % 3 <> 0
 union all select 'ns:' || label, cast(vec_id as varchar), list_transform(embedding, lambda x: x * 2) from embeddings where vec_id % 3 = 0
 union all select 'ns:' || label, 'new-' || vec_id, embedding from embeddings where vec_id % 10 = 0)""")
def vector_upsert(spark, sf_dir):
    old = V.stored_vectors(spark, sf_dir).select("namespace", "vector_id", "values")
    third = F.col("vector_id").cast(BIG) % 3 == 0
    first = old.filter(third).withColumn("seq", F.lit(1))
    again = first.withColumn("values", F.transform("values", lambda x: (x * 2).cast("float"))).withColumn("seq", F.lit(2))
    new = (old.filter(F.col("vector_id").cast(BIG) % 10 == 0).withColumn("vector_id", F.concat(F.lit("new-"), "vector_id")).withColumn("seq", F.lit(1)))
    out = I.upsert_vectors(old, first.unionByName(again).unionByName(new))
    total = F.aggregate(F.col("values").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return out.select("namespace", "vector_id", F.round(total, 4).alias("value_sum"))


@query("vector_delete", """
select 'all' as scope, 'ns:' || label as namespace, count(*) as n from embeddings where label <> 1 group by label
union all select 'ids', 'ns:' || label, count(*) from embeddings where not (label = 2 and vec_id % 2 = 0) group by label
union all select 'filter', 'ns:' || label, count(*) from embeddings where not (label = 3 and vec_id % 5 = 1) group by label""")
def vector_delete(spark, sf_dir):
    v = V.stored_vectors(spark, sf_dir).withColumn("part", F.col("vector_id").cast(BIG) % 5)
    ids = v.filter(F.col("vector_id").cast(BIG) % 2 == 0).select("vector_id")
    runs = {"all": I.delete_vectors(v, "ns:1", delete_all=True, ids=ids), "ids": I.delete_vectors(v, "ns:2", ids=ids, where={"part": 1}),
            "filter": I.delete_vectors(v, "ns:3", where={"part": 1})}
    parts = [df.groupBy("namespace").agg(F.count("*").alias("n")).select(F.lit(k).alias("scope"), "namespace", "n") for k, df in runs.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("insert_if_absent", """
select source as collection_id, min(name) as name from (
 select source, 'kept' as name from documents where doc_id % 2 = 0 union all
 select source, 'new' from documents where doc_id % 2 = 1 and source not in (select source from documents where doc_id % 2 = 0)) group by source""")
def insert_if_absent(spark, sf_dir):
    d = V.read(spark, sf_dir, "documents").select(F.col("source").alias("collection_id"), "doc_id")
    held = d.filter("doc_id % 2 = 0").select("collection_id").distinct().withColumn("name", F.lit("kept"))
    new = d.filter("doc_id % 2 = 1").select("collection_id", F.lit("new").alias("name"), F.col("doc_id").alias("seq"))
    return S.insert_if_absent(held, new, ["collection_id"], "seq")


@query("audit_append", "select event_type as action, count(*) * 2 as n_events from events group by event_type")
def audit_append(spark, sf_dir):
    """The same batch appended twice: a log keeps both."""
    from folioground.staging import stage_path
    path = stage_path(spark, "audit_log")
    e = V.audit_events(spark, sf_dir)
    for _ in range(2):
        S.append_log(e, path)
    return spark.read.schema(e.schema).parquet(path).groupBy("action").agg(F.count("*").alias("n_events"))


@query("json_columns", """
select event_id, cast(json_extract(props, '$.k') as bigint) as k, '{"action":"' || event_type || '","user":' || user_id || '}' as encoded from events""")
def json_columns(spark, sf_dir):
    e = V.audit_events(spark, sf_dir)
    return e.select("event_id", F.from_json("metadata_json", "k bigint")["k"].alias("k"),
                    F.to_json(F.struct("action", F.col("user_id").alias("user"))).alias("encoded"))


@query("persisted_citations", with_views("v_qa", "v_documents", body="""
select qa_id, d.document_id, d.scheme_name from v_qa q join v_documents d on d.document_id = q.conv_id * 7"""))
def persisted_citations(spark, sf_dir):
    qa = V.qa_log(spark, sf_dir).select("qa_id", F.col("qa_id").alias("query_id"), "conv_id")
    cites = qa.select("query_id", (F.col("conv_id") * 7).alias("document_id"))
    docs = V.documents(spark, sf_dir).select("document_id", "scheme_name")
    kept = S.persisted_citations(qa, cites, docs)
    return kept.join(docs, "document_id").select("qa_id", "document_id", "scheme_name")


@query("session_upsert", """
with asked as (select 'user-' || user_id as session_token, 'src' || (event_id % 20) as collection_id, event_id as asked_at from events)
select session_token, 'old' as collection_id from (select distinct session_token from asked) where cast(substr(session_token, 6) as int) % 3 = 0
union all select session_token, arg_min(collection_id, asked_at) from asked where cast(substr(session_token, 6) as int) % 3 <> 0 group by session_token""")
def session_upsert(spark, sf_dir):
    e = V.audit_events(spark, sf_dir)
    asked = e.select(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("session_token"), "user_id",
                     F.concat(F.lit("src"), (F.col("event_id") % 20).cast("string")).alias("collection_id"), F.col("event_id").alias("asked_at"))
    held = asked.filter("user_id % 3 = 0").select("session_token", F.lit("old").alias("collection_id"), F.lit(-1).cast(BIG).alias("created_at")).distinct()
    return S.upsert_sessions(held, asked.drop("user_id")).select("session_token", "collection_id")


@query("typed_metadata", with_views("v_meta", body="""
select document_id, meta_key, data_type, case when data_type = 'integer' then try_cast(meta_value as bigint) end as int_value,
 case when data_type = 'date' then try_cast(meta_value as date) end as date_value, case when data_type = 'boolean' then try_cast(meta_value as boolean) end as bool_value,
 case when data_type = 'json' and json_valid(meta_value) then meta_value end as json_value, case when data_type = 'string' then meta_value end as text_value from v_meta"""))
def typed_metadata(spark, sf_dir):
    return S.typed_metadata(V.doc_metadata(spark, sf_dir))


# ---- payload and filters ----------------------------------------------------------

@query("chunk_payload", with_views("v_payload", body="""
select vector_id, namespace, document_id, version_number, scheme_name, department, state_or_district, language, effective_date, active, is_historical,
 'text-embedding-3-small' as embedding_model, 1536 as embedding_dimension, coalesce(section_heading, '') as section_heading,
 sha256(case when length(trim(chunk_text)) > 950 then substr(trim(chunk_text), 1, 950) || '...' else trim(chunk_text) end) as snippet_hash from v_payload"""))
def chunk_payload(spark, sf_dir):
    return passage_payload(spark, sf_dir).select(
        "vector_id", "namespace", "document_id", "version_number", "scheme_name", "department", "state_or_district", "language", "effective_date",
        "active", "is_historical", "embedding_model", "embedding_dimension", F.coalesce("section_heading", F.lit("")).alias("section_heading"),
        F.sha2("snippet", 256).alias("snippet_hash"))


@query("metadata_filters", with_views("v_payload", body="""
select vector_id from v_payload where document_status <> 'DELETED' and document_status = 'ACTIVE' and version_status = 'ACTIVE'
 and contains(lower(scheme_name), '-3') and contains(lower(department), 'department 1') and contains(lower(state_or_district), 'pune') and contains(lower(language), 'e')"""))
def metadata_filters(spark, sf_dir):
    low = lambda c, v: F.contains(F.lower(c), F.lit(v.lower()))
    return I.searchable(passage_payload(spark, sf_dir)).filter(
        F.col("active") & low("scheme_name", "-3") & low("department", "Department 1") & low("state_or_district", "PUNE") & low("language", "E")).select("vector_id")


@query("payload_joins", with_views("v_passages", "v_documents", "v_versions", body="""
select d.collection_id, v.version_number, count(*) as n_chunks, cast(sum(length(p.chunk_text)) as bigint) as n_chars from v_passages p
join v_documents d on d.document_id = p.document_id join v_versions v on v.version_id = p.version_id group by all"""))
def payload_joins(spark, sf_dir):
    return passage_payload(spark, sf_dir).groupBy("collection_id", "version_number").agg(
        F.count("*").alias("n_chunks"), F.sum(F.length("chunk_text")).alias("n_chars"))


@query("pages_of_versions", with_views("v_pages", "v_versions", body="""
select v.status, v.version_number, count(*) as n_pages, max(p.page_number) as last_page from v_pages p join v_versions v using (version_id) group by all"""))
def pages_of_versions(spark, sf_dir):
    v = V.versions(spark, sf_dir).select("version_id", "status", "version_number")
    return (V.pages(spark, sf_dir).select("version_id", "page_number").join(v, "version_id").groupBy("status", "version_number")
            .agg(F.count("*").alias("n_pages"), F.max("page_number").alias("last_page")))


# ---- access -------------------------------------------------------------------------

_REQ = """select q.query_id, case when q.query_id % 31 = 0 then 'hi' when q.query_id % 37 = 0 then repeat('long ', 120) else q.query end as query,
  case when q.query_id % 41 = 0 then '' when q.query_id % 43 = 0 then 'nowhere' else q.collection_id end as collection_id,
  case when q.query_id % 6 <> 5 then q.user_id end as user_id, q.query_id % 7 = 0 as include_historical from v_questions q"""


def access_requests(spark, sf_dir):
    k = F.col("query_id")
    return V.questions(spark, sf_dir).select(
        "query_id", F.when(k % 31 == 0, "hi").when(k % 37 == 0, F.repeat(F.lit("long "), F.lit(120))).otherwise(F.col("query")).alias("query"),
        F.when(k % 41 == 0, "").when(k % 43 == 0, "nowhere").otherwise(F.col("collection_id")).alias("collection_id"),
        F.when(k % 6 != 5, F.col("user_id")).alias("user_id"), (k % 7 == 0).alias("include_historical"))


@query("request_verdicts", with_views("v_questions", "v_user_perms", "v_collections", extra={"r": _REQ}, body="""
select query_id, case when length(query) < 3 then 'QUERY_TOO_SHORT' when length(query) > 500 then 'QUERY_TOO_LONG'
 when trim(r.collection_id) = '' then 'COLLECTION_REQUIRED' when c.is_active is null or not c.is_active then 'COLLECTION_NOT_FOUND'
 when c.is_private and not coalesce(c.owner_user_id = r.user_id, false) and not list_has_any(coalesce(u.perms, []::varchar[]), ['admin:all', 'docs:all', 'collections:manage'])
  then 'FORBIDDEN_COLLECTION'
 when include_historical and not list_has_any(coalesce(u.perms, []::varchar[]), ['admin:all', 'docs:all', 'docs:archive']) then 'FORBIDDEN_HISTORICAL' end as reject_reason
from r left join v_user_perms u using (user_id) left join v_collections c on c.collection_id = r.collection_id"""))
def request_verdicts(spark, sf_dir):
    return PA.judge_requests(access_requests(spark, sf_dir), V.collections(spark, sf_dir), V.users(spark, sf_dir)).select("query_id", "reject_reason")


@query("collection_access", with_views("v_questions", "v_user_perms", "v_collections", extra={"r": _REQ}, body="""
select query_id, not c.is_private or coalesce(c.owner_user_id = r.user_id, false) or list_has_any(coalesce(u.perms, []::varchar[]), ['admin:all', 'docs:all', 'collections:manage']) as may_read,
 not c.is_private or coalesce(c.owner_user_id = r.user_id, false) or list_has_any(coalesce(u.perms, []::varchar[]), ['admin:all', 'collections:manage']) as may_list
from r left join v_user_perms u using (user_id) join v_collections c on c.collection_id = r.collection_id"""))
def collection_access(spark, sf_dir):
    who = V.users(spark, sf_dir).select(F.col("user_id").cast("string").alias("who"), A.role_permissions(F.col("role")).alias("perms"))
    own_key = F.coalesce(F.col("user_id").cast("string"), F.concat(F.lit("anonymous-"), F.col("query_id").cast("string")))
    args = (F.col("is_private"), F.col("owner_user_id"), F.col("user_id"), F.coalesce("perms", A.text_array([])))
    return (access_requests(spark, sf_dir).withColumn("who", own_key).join(who, "who", "left").join(V.collections(spark, sf_dir), "collection_id")
            .select("query_id", A.may_read(*args).alias("may_read"), A.may_list(*args).alias("may_list")))


@query("permission_check", with_views("v_user_perms", body="""
select user_id, list_contains(perms, 'admin:all') or list_has_all(perms, ['history:read', 'eligibility:check']) as allowed,
 list_has_any(perms, ['admin:all', 'docs:all']) as lists_archived, array_to_string(list_sort(list_intersect(perms, ['docs:all', 'audit:read', 'query:execute'])), ',') as shared from v_user_perms"""))
def permission_check(spark, sf_dir):
    p = A.role_permissions(F.col("role"))
    return V.users(spark, sf_dir).select(
        "user_id", A.holds_all(p, A.text_array(["history:read", "eligibility:check"])).alias("allowed"),
        A.holds_any(p, C.ARCHIVE_LISTING_ACCESS).alias("lists_archived"),
        F.array_join(F.array_sort(F.array_intersect(p, A.text_array(["docs:all", "audit:read", "query:execute"]))), ",").alias("shared"))


# ---- catalog ------------------------------------------------------------------------

@query("duplicate_warnings", with_views("v_documents", body="""
select document_id, file_hash, f as original_id, n as copies, 'Duplicate warning: An existing document ''' || s || ''' (ID: ' || f || ') shares the identical content hash.' as duplicate_warning
from (select *, min(document_id) over w as f, count(*) over w as n, arg_min(scheme_name, document_id) over w as s from v_documents where status <> 'DELETED' window w as (partition by file_hash))
where document_id <> f"""))
def duplicate_warnings(spark, sf_dir):
    return D.duplicate_warnings(V.documents(spark, sf_dir))


@query("latest_versions", with_views("v_versions", body="""
select document_id, version_id, version_number, total_pages, file_size_bytes, status from (
 select *, row_number() over (partition by document_id order by version_number desc) as rn from v_versions) where rn = 1"""))
def latest_versions(spark, sf_dir):
    v = V.versions(spark, sf_dir).select("document_id", "version_id", "version_number", "total_pages", "file_size_bytes", "status")
    return D.latest_versions(v)


@query("version_history", with_views("v_versions", body="""
select document_id, version_id, version_number, status from v_versions"""))
def version_history(spark, sf_dir):
    v = V.versions(spark, sf_dir).select("document_id", "version_id", "version_number", "status")
    return D.version_history(v, V.documents(spark, sf_dir))


def _listing(archived: bool) -> str:
    cut = "" if archived else "and d.status <> 'ARCHIVED'"
    return with_views("v_documents", "v_versions", body=f"""
select d.document_id, d.collection_id, d.scheme_name as title, d.department, d.state_or_district, d.language, d.status, d.file_hash,
 coalesce(v.version_number, d.version_number) as current_version, case when v.version_number is null then 1 else v.total_pages end as total_pages,
 case when v.version_number is null then 0 else v.file_size_bytes end as file_size_bytes
from v_documents d left join (select * from v_versions where document_id % 8 <> 0 qualify row_number() over (partition by document_id order by version_number desc) = 1) v
 using (document_id) where d.status <> 'DELETED' {cut}""")


@query("document_listing", _listing(False))
def document_listing(spark, sf_dir):
    return D.list_documents(V.documents(spark, sf_dir), V.versions(spark, sf_dir).filter("document_id % 8 <> 0"))


@query("document_listing_archived", _listing(True))
def document_listing_archived(spark, sf_dir):
    return D.list_documents(V.documents(spark, sf_dir), V.versions(spark, sf_dir).filter("document_id % 8 <> 0"), include_archived=True)


@query("collection_listing", with_views("v_collections", "v_documents", body="""
select viewer, c.collection_id, name, slug, case when department_id < 3 then 'Department ' || department_id end as department, is_private, owner_user_id,
 coalesce(n, 0) as total_documents from v_collections c
left join (select collection_id, count(*) as n from v_documents where status <> 'DELETED' group by 1) x using (collection_id)
join (values ('SYSTEM_ADMIN', true), ('SCHEME_ADMIN', true), ('OWNER', true), ('SYSTEM_ADMIN', false), ('SCHEME_ADMIN', false), ('HELPDESK', false), ('CITIZEN', false), ('ANONYMOUS', false)) as w(viewer, p)
 on w.p = c.is_private where is_active"""))
def collection_listing(spark, sf_dir):
    return D.list_collections(V.collections(spark, sf_dir), V.documents(spark, sf_dir), V.departments(spark, sf_dir))


@query("version_conflicts", with_views("v_documents", body="""
select collection_id, lower(trim(scheme_name)) as scheme_key, n as active_documents, document_id, version_number from (
 select *, count(*) over (partition by collection_id, lower(trim(scheme_name))) as n from v_documents where status = 'ACTIVE') where n > 1"""))
def version_conflicts(spark, sf_dir):
    return D.conflict_members(V.documents(spark, sf_dir))


@query("version_conflict_warnings", with_views("v_documents", body="""
select collection_id, arg_min(scheme_name, document_id) as scheme_name, count(*) as active_documents, 'Warning: ' || count(*) || ' active documents appear to cover scheme ''' ||
  arg_min(scheme_name, document_id) || ''' in the same collection. Consider archiving the superseded version to prevent ambiguous citations.' as message
from v_documents where status = 'ACTIVE' group by collection_id, lower(trim(scheme_name)) having count(*) > 1"""))
def version_conflict_warnings(spark, sf_dir):
    return D.conflict_warnings(V.documents(spark, sf_dir))


_INCOMING = """select document_id || ':n' || k as version_id, document_id, cast(k as int) as version_number, sha256(document_id || 'n' || k) as file_hash, k
 from (select document_id, unnest([2, 4, 4]) as k from v_documents where document_id % 5 = 0)"""


def incoming_versions(spark, sf_dir):
    """Second versions (some exist), fourth versions twice, and one for an unknown document each."""
    d = V.documents(spark, sf_dir).filter("document_id % 5 = 0").select("document_id")
    k = F.explode(F.array(*[F.struct(F.lit(n).alias("version_number"), F.lit(s).cast(BIG).alias("seq")) for n, s in ((2, 1), (4, 2), (4, 3))]))
    rows = d.select("document_id", k.alias("x")).select("document_id", "x.*")
    name = F.concat(F.col("document_id").cast("string"), F.lit("n"), F.col("version_number").cast("string"))
    return rows.select(
        F.concat_ws(":", F.col("document_id").cast("string"), F.concat(F.lit("n"), F.col("seq").cast("string"))).alias("version_id"), "document_id",
        "version_number", F.sha2(name, 256).alias("file_hash"), F.lit(10).cast(BIG).alias("file_size_bytes"),
        F.lit(None).cast("timestamp_ntz").alias("effective_date"), "seq")


@query("version_creation", with_views("v_documents", body="""
select document_id, case when document_id % 5 = 0 then 4 else version_number end as version_number,
 case when document_id % 5 = 0 then sha256(document_id || 'n4') else file_hash end as file_hash, effective_date from v_documents"""))
def version_creation(spark, sf_dir):
    out = D.add_versions(V.documents(spark, sf_dir), V.versions(spark, sf_dir), incoming_versions(spark, sf_dir))
    return out["documents"].select("document_id", "version_number", "file_hash", "effective_date")


@query("version_rejections", with_views("v_documents", body="""
select document_id || ':n1' as version_id, document_id, 2 as version_number, 'VERSION_EXISTS' as reason from v_documents where document_id % 5 = 0 and version_number >= 2
union all select document_id || ':n3', document_id, 4, 'VERSION_EXISTS' from v_documents where document_id % 5 = 0"""))
def version_rejections(spark, sf_dir):
    return D.add_versions(V.documents(spark, sf_dir), V.versions(spark, sf_dir), incoming_versions(spark, sf_dir))["rejected"]


def _actions(spark, sf_dir):
    d = F.col("document_id")
    return V.documents(spark, sf_dir).filter(d % 6 < 3).select(
        "document_id", F.when(d % 6 == 0, "ARCHIVE").when(d % 6 == 1, "RESTORE").otherwise("DELETE").alias("action"))


@query("lifecycle_versions", with_views("v_versions", body="""
select version_id, case document_id % 6 when 0 then 'ARCHIVED' when 1 then 'ACTIVE' else status end as status from v_versions"""))
def lifecycle_versions(spark, sf_dir):
    out = D.change_status(V.documents(spark, sf_dir), V.versions(spark, sf_dir), _actions(spark, sf_dir))
    return out["versions"].select("version_id", "status")


@query("lifecycle_audit", with_views("v_documents", body="""
select case document_id % 6 when 0 then 'DOC_ARCHIVE' when 1 then 'DOC_RESTORE' else 'DOC_DELETE' end as action, 'documents' as entity_type, cast(document_id as varchar) as entity_id,
 '{"scheme_name":"' || scheme_name || '","previous_status":"' || status || '","status":"' || case document_id % 6 when 0 then 'ARCHIVED' when 1 then 'ACTIVE' else 'DELETED' end || '"}' as details
from v_documents where document_id % 6 < 3"""))
def lifecycle_audit(spark, sf_dir):
    return D.change_status(V.documents(spark, sf_dir), V.versions(spark, sf_dir), _actions(spark, sf_dir))["audit"]


@query("audit_records", with_views("v_documents", body="""
select '7' as user_id, case document_id % 6 when 0 then 'DOC_ARCHIVE' when 1 then 'DOC_RESTORE' else 'DOC_DELETE' end as action, 'documents' as entity_type, cast(document_id as varchar) as entity_id,
 '{"scheme_name":"' || scheme_name || '","previous_status":"' || status || '","status":"' || case document_id % 6 when 0 then 'ARCHIVED' when 1 then 'ACTIVE' else 'DELETED' end || '"}' as details,
 timestamp '2024-01-01 00:00:00' as created_at
from v_documents where document_id % 6 < 3"""))
def audit_records(spark, sf_dir):
    audit = D.change_status(V.documents(spark, sf_dir), V.versions(spark, sf_dir), _actions(spark, sf_dir))["audit"]
    return D.audit_records(audit, F.lit(7), F.lit("2024-01-01 00:00:00"))


@query("lifecycle_documents", with_views("v_documents", body="""
select document_id, case document_id % 6 when 0 then 'ARCHIVED' when 1 then 'ACTIVE' when 2 then 'DELETED' else status end as status from v_documents"""))
def lifecycle_documents(spark, sf_dir):
    return D.change_status(V.documents(spark, sf_dir), V.versions(spark, sf_dir), _actions(spark, sf_dir))["documents"].select("document_id", "status")


@query("collection_deactivation", with_views("v_collections", body="select collection_id, is_active and department_id <> 2 as is_active from v_collections"))
def collection_deactivation(spark, sf_dir):
    c = V.collections(spark, sf_dir)
    return D.deactivate_collections(c, c.filter("department_id = 2"))["collections"].select("collection_id", "is_active")


@query("collection_creation", """
select 'slug-' || n as slug, 'New ' || min(item_id) as name from (select item_id, 10 + item_id // 2 as n from benchmark)
where 'slug-' || n not in (select 'slug-' || substr(source, 4) from documents) group by n""")
def collection_creation(spark, sf_dir):
    i = F.col("item_id")
    new = V.read(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("slug-"), (F.floor(i / 2) + 10).cast("string")).alias("slug"), F.concat(F.lit("New "), i.cast("string")).alias("name"), i.alias("seq"))
    return D.create_collections(V.collections(spark, sf_dir), new).select("slug", "name")


@query("page_previews", with_views("v_pages", body=f"""
select r.document_id, r.page_number, case when p.raw_text is null then 'Official scheme circular excerpt from page ' || r.page_number || '.' else substr(p.raw_text, 1, 1000) end as text_preview,
 'NATIVE' as extraction_method, coalesce({n_words('p.raw_text')}, 0) as word_count, p.raw_text is null as is_stand_in
from (select doc_id as document_id, cast(1 + doc_id % 4 as int) as page_number from documents) r left join v_pages p using (document_id, page_number)"""))
def page_previews(spark, sf_dir):
    asked = V.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), (1 + F.col("doc_id") % 4).cast("int").alias("page_number"))
    held = V.pages(spark, sf_dir).withColumn("extraction_method", F.lit("NATIVE")).withColumn("word_count", X.word_count(F.col("raw_text")))
    return D.page_previews(asked, held).withColumn("word_count", F.col("word_count").cast(BIG))


@query("processing_summary", with_views("v_readings", "v_documents", "v_jobs", extra={
    "m": f"select document_id, {n_words('native_text')} < 15 as scanned, {strip('native_text')} as n, {strip(f"case when {n_words('native_text')} < 15 then coalesce(ocr_text, '') else '' end")} as o from v_readings",
    "how": f"""select document_id, scanned, case when o = '' or lower(n) = lower(o) then 'NATIVE' when n = '' then 'OCR' when contains(lower(o), lower(n)) and {n_words('o')} > {n_words('n')} then 'OCR'
      when contains(lower(n), lower(o)) then 'NATIVE' else 'HYBRID' end as method from m""",
    "p": "select document_id, count(*) as n, count(*) filter (where method = 'NATIVE') as n_native, count(*) filter (where method <> 'NATIVE') as n_ocr, count(*) filter (where scanned) as n_scanned from how group by document_id",
    "j": "select * from v_jobs qualify row_number() over (partition by document_id order by created_seq desc) = 1"}, body="""
select d.document_id, coalesce(j.job_id, 'job-direct') as job_id, coalesce(j.status, d.status) as status,
 coalesce(j.progress_percent, case when d.status = 'ACTIVE' then 100 else 0 end) as progress_percent, coalesce(j.s_total_pages, greatest(p.n, 1), 1) as total_pages,
 case when j.job_id is null then greatest(coalesce(p.n_native, 0), 1) else coalesce(p.n_native, 0) end as native_text_pages, coalesce(j.s_ocr_pages, p.n_ocr, 0) as ocr_pages,
 0::bigint as failed_pages, 0::bigint as low_confidence_pages, coalesce(p.n_scanned, 0) as scanned_pages
from v_documents d left join p using (document_id) left join j on j.document_id = d.document_id"""))
def processing_summary(spark, sf_dir):
    pages = P.process_pages(V.page_readings(spark, sf_dir))
    return D.processing_summary(V.documents(spark, sf_dir), V.jobs(spark, sf_dir), pages)


@query("processing_summary_direct", with_views("v_documents", "v_pages", "v_jobs", extra={
    "p": f"select document_id, count(*) as n, count(*) filter (where {n_words('raw_text')} < 15) as scanned from v_pages group by document_id",
    "j": "select * from v_jobs qualify row_number() over (partition by document_id order by created_seq desc) = 1"}, body="""
select d.document_id, coalesce(j.job_id, 'job-direct') as job_id, coalesce(j.status, d.status) as status,
 coalesce(j.progress_percent, case when d.status = 'ACTIVE' then 100 else 0 end) as progress_percent, coalesce(j.s_total_pages, p.n) as total_pages, p.n as native_text_pages,
 coalesce(j.s_ocr_pages, 0) as ocr_pages, 0::bigint as failed_pages, 0::bigint as low_confidence_pages, p.scanned as scanned_pages
from v_documents d join p using (document_id) left join j on j.document_id = d.document_id"""))
def processing_summary_direct(spark, sf_dir):
    """Pages without OCR, so every page is native."""
    readings = V.pages(spark, sf_dir).withColumnRenamed("raw_text", "native_text").withColumn("ocr_text", F.lit(None).cast("string"))
    return D.processing_summary(V.documents(spark, sf_dir), V.jobs(spark, sf_dir), P.process_pages(readings))


@query("latest_jobs", with_views("v_jobs", body="select document_id, version_id, job_id, status, progress_percent from v_jobs qualify row_number() over (partition by document_id, version_id order by created_seq desc) = 1"))
def latest_jobs(spark, sf_dir):
    return D.latest_jobs(V.jobs(spark, sf_dir), "document_id", "version_id").select("document_id", "version_id", "job_id", "status", "progress_percent")


# ---- index upkeep -------------------------------------------------------------------

@query("reindex_everything", with_views("v_payload", "v_collections", body="""
select p.collection_id, count(distinct p.document_id) as documents_count, count(distinct p.version_id) as versions_reindexed, count(*) as total_vectors_indexed
from v_payload p join v_collections c using (collection_id) where c.is_active and p.active group by p.collection_id"""))
def reindex_everything(spark, sf_dir):
    return I.reindex_summary(I.reindex_scope(V.page_passages(spark, sf_dir), V.documents(spark, sf_dir), V.versions(spark, sf_dir), V.collections(spark, sf_dir)))


@query("reindex_collection", with_views("v_payload", body="""
select collection_id, count(distinct document_id) as documents_count, count(distinct version_id) as versions_reindexed, count(*) as total_vectors_indexed
from v_payload where active and collection_id = 'src3' group by collection_id"""))
def reindex_collection(spark, sf_dir):
    return I.reindex_summary(I.reindex_scope(V.page_passages(spark, sf_dir), V.documents(spark, sf_dir), V.versions(spark, sf_dir), V.collections(spark, sf_dir), collection_id="src3"))


@query("purge_versions", with_views("v_passages", body="""
select version_id, count(*) as n_chunks, count(case when document_id % 4 <> 1 then 1 end) as n_indexed, count(case when document_id % 4 <> 1 then 1 end) as n_vectors from v_passages group by version_id"""))
def purge_versions(spark, sf_dir):
    c = V.page_passages(spark, sf_dir).select("vector_id", "version_id", "document_id").withColumn("indexed_at", F.lit("2024-01-01"))
    left, cleared = I.purge_versions(c.select("vector_id", "version_id"), c, c.filter("document_id % 4 = 1"))
    n = left.groupBy("version_id").agg(F.count("*").alias("n_vectors"))
    return (cleared.groupBy("version_id").agg(F.count("*").alias("n_chunks"), F.count("indexed_at").alias("n_indexed"))
            .join(n, "version_id", "left").withColumn("n_vectors", F.coalesce("n_vectors", F.lit(0))))


@query("incompatible_vectors", """
select cast(vec_id as varchar) as vector_id, case when vec_id % 89 = 0 then 'other-model' else 'text-embedding-3-small' end as embedding_model,
 cast(64 - (vec_id % 97 = 0)::int as int) as found_dimension, case when vec_id % 97 = 0 then 'DIMENSION_MISMATCH' else 'MODEL_MISMATCH' end as reason
from embeddings where vec_id % 97 = 0 or vec_id % 89 = 0""")
def incompatible_vectors(spark, sf_dir):
    i = F.col("vector_id").cast(BIG)
    v = V.stored_vectors(spark, sf_dir).withColumns({
        "values": F.when(i % 97 == 0, F.slice("values", 1, 63)).otherwise(F.col("values")),
        "embedding_model": F.when(i % 89 == 0, "other-model").otherwise(C.EMBEDDING_MODEL)})
    return I.incompatible_vectors(v, dim=64)


@query("index_chunk_defaults", with_views("v_passages", body="""
select case when document_id % 2 = 0 then 'own-' || vector_id else vector_id end as vector_id, 'corpus:src' as namespace,
 case when document_id % 3 = 0 then 'custom' else 'text-embedding-3-small' end as embedding_model, 1536 as embedding_dimension, 1536 as n_values from v_passages"""))
def index_chunk_defaults(spark, sf_dir):
    d = F.col("document_id")
    c = V.page_passages(spark, sf_dir).select(
        F.when(d % 2 == 0, F.concat(F.lit("own-"), "vector_id")).alias("vector_id"), "version_id", "page_number", "chunk_index",
        F.lit(None).cast("array<float>").alias("values"), F.when(d % 3 == 0, "custom").alias("embedding_model"),
        F.lit(None).cast("int").alias("embedding_dimension"), F.lit(1).alias("seq"))
    none = spark.createDataFrame([], "vector_id string, namespace string, values array<float>, embedding_model string, embedding_dimension int")
    return I.index_chunks(c, none, F.lit("src")).select("vector_id", "namespace", "embedding_model", "embedding_dimension", F.size("values").alias("n_values"))


_GATE = {
    "held": """select *, case when document_id % 2 = 0 then 'own-' || vector_id else vector_id end as own_id, case when document_id % 7 = 3 then 3 else 1536 end as size,
      case when document_id % 11 = 5 then 'custom' else 'text-embedding-3-small' end as model, version_id as batch from v_passages""",
    "told": "select *, case when size <> 1536 then 'DIMENSION_MISMATCH' when model = 'custom' then 'MODEL_MISMATCH' end as own_reason from held",
    "spoilt": "select distinct batch from told where own_reason is not null",
}


def _gated(spark, sf_dir):
    """Passages as one batch a version: some with a vector of three numbers, some of another model, most to be embedded."""
    d = F.col("document_id")
    c = V.page_passages(spark, sf_dir).select(
        F.col("version_id").alias("batch"), F.when(d % 2 == 0, F.concat(F.lit("own-"), "vector_id")).alias("vector_id"), "version_id", "page_number", "chunk_index", "chunk_text",
        F.when(d % 7 == 3, F.array(*[F.lit(1.0).cast("float")] * 3)).alias("values"), F.when(d % 11 == 5, "custom").alias("embedding_model"),
        F.lit(None).cast("int").alias("embedding_dimension"), F.lit(1).alias("seq"))
    none = spark.createDataFrame([], "vector_id string, namespace string, values array<float>, embedding_model string, embedding_dimension int")
    return I.gated_upsert(c, none, F.lit("src"), VX.hashing_embedder())


@query("index_gate_accepted", with_views("v_passages", extra=_GATE, body="""
select own_id as vector_id, 'corpus:src' as namespace, model as embedding_model, 1536 as n_values, true as embedded from told where batch not in (select batch from spoilt)"""))
def index_gate_accepted(spark, sf_dir):
    v = _gated(spark, sf_dir)[0]
    return v.select("vector_id", "namespace", "embedding_model", F.size("values").alias("n_values"), F.exists("values", lambda x: x != 0).alias("embedded"))


@query("index_gate_refused", with_views("v_passages", extra=_GATE, body="""
select batch, own_id as vector_id, model as embedding_model, size as found_dimension, coalesce(own_reason, 'BATCH_REFUSED') as reason from told where batch in (select batch from spoilt)"""))
def index_gate_refused(spark, sf_dir):
    return _gated(spark, sf_dir)[1]


@query("index_statistics", """
select 'ns:' || label as namespace, count(*) as vectors_count, min(len(embedding)) as min_dimension, max(len(embedding)) as max_dimension from embeddings group by label""")
def index_statistics(spark, sf_dir):
    s = I.index_statistics(V.stored_vectors(spark, sf_dir))
    return s.select("namespace", "vectors_count", F.col("min_dimension").cast(BIG), F.col("max_dimension").cast(BIG))


@query("ingest_counts", with_views("v_pages", "v_documents", body="""
select collection_id, count(*) as n_pages from v_pages join v_documents using (document_id) group by collection_id"""))
def ingest_counts(spark, sf_dir):
    """An ingestion run without an embedder: pages per collection. ``ingest_vectors`` embeds."""
    readings = V.pages(spark, sf_dir).withColumnRenamed("raw_text", "native_text").withColumn("ocr_text", F.lit(None).cast("string"))
    out = P.ingest(readings, V.documents(spark, sf_dir), V.versions(spark, sf_dir))
    return (out["summary"].join(out["versions"].select("version_id", "document_id"), "version_id")
            .join(out["documents"].select("document_id", "collection_id"), "document_id")
            .groupBy("collection_id").agg(F.sum("n_pages").alias("n_pages")))


@query("ingest_vectors")
def ingest_vectors(spark, sf_dir):
    readings = V.page_readings(spark, sf_dir)
    out = P.ingest(readings, V.documents(spark, sf_dir), V.versions(spark, sf_dir), P.default_embedder())
    return out["vectors"].select("vector_id", "namespace", "active", F.size("values").alias("n_values"))


@query("reprocess_selected", with_views("v_documents", "v_pages", body="""
select 'ACTIVE' as status, count(distinct document_id) as n_documents, count(*) as n_pages from v_pages where document_id % 10 = 4"""))
def reprocess_selected(spark, sf_dir):
    """Selected documents processed again without an embedder: documents and pages by status."""
    docs = V.documents(spark, sf_dir)
    readings = V.pages(spark, sf_dir).withColumnRenamed("raw_text", "native_text").withColumn("ocr_text", F.lit(None).cast("string"))
    out = P.reprocess(docs.filter("document_id % 10 = 4"), readings, docs, V.versions(spark, sf_dir))
    done = out["summary"].join(out["versions"].select("version_id", "document_id", "status"), "version_id")
    return done.groupBy("status").agg(F.count("*").alias("n_documents"), F.sum("n_pages").alias("n_pages"))


# ---- ingestion that may fail --------------------------------------------------------------

_ERROR = """case outcome when 'unknown' then 'Document ' || document_id || ' or Version ' || version_id || ' not found in database.' when 'missing_file' then 'Document file missing in storage: ' || storage_key
   when 'exhausted' then 'Document processing failed after 3 attempts: the reader timed out' when 'retry' then 'the reader timed out' when 'invalid_file' then reason end"""
_RUN = {
    "req": """select doc_id as document_id, doc_id || ':' || case when doc_id % 11 = 0 then '99' else cast(1 + doc_id % 3 as varchar) end as version_id, 'files/' || doc_id as storage_key,
      cast(10 + doc_id % 2 as int) as job_seq, cast(case when doc_id % 11 = 4 then 3 else 1 end as int) as attempt, doc_id % 11 in (3, 4) as faulty, doc_id % 11 = 1 as no_file,
      case when coalesce(text, '') = '' then 'File is empty (0 bytes).' when doc_id % 11 = 2 then 'Invalid PDF file: Missing ''%PDF-'' header signature.' end as reason from documents""",
    "oc0": """select *, case when doc_missing then 'unknown' when no_file then 'missing_file' when faulty and attempt < 3 then 'retry' when faulty then 'exhausted' when reason is not null then 'invalid_file' else 'done' end as outcome
      from (select *, document_id % 11 = 0 as doc_missing from req)""",
    "oc": f"select *, {_ERROR} as error_message from oc0",
    "cnt": "select version_id, count(*) as n from v_pages group by 1",
    "heldjob": "select document_id, version_id, job_id, created_seq from v_jobs qualify row_number() over (partition by document_id, version_id order by created_seq desc) = 1",
}
_RUN_VIEWS = ("v_documents", "v_versions", "v_pages", "v_jobs")


def _job_run(spark, sf_dir):
    """Every document asked to be processed; some files are missing or unsound, some readers fail, some versions are unknown."""
    d = F.col("doc_id")
    src = V.read(spark, sf_dir, "documents")
    key = F.concat(F.lit("files/"), d.cast("string")).alias("storage_key")
    version = F.when(d % 11 == 0, "99").otherwise((1 + d % 3).cast("string"))
    requests = src.select(
        d.alias("document_id"), F.concat_ws(":", d.cast("string"), version).alias("version_id"), key, (10 + d % 2).cast("int").alias("job_seq"),
        F.when(d % 11 == 4, 3).otherwise(1).alias("attempt"), F.when((d % 11).isin(3, 4), "the reader timed out").alias("read_error"))
    body = F.when(d % 11 == 2, F.col("text")).otherwise(F.concat(F.when(F.col("text") == "", "").otherwise("%PDF-1.7 "), "text"))
    files = src.filter("doc_id % 11 <> 1").select(key, header_reason(body.cast("binary")).alias("reason"))
    readings = V.pages(spark, sf_dir).withColumnRenamed("raw_text", "native_text").withColumn("ocr_text", F.lit(None).cast("string"))
    return JB.run_jobs(requests, V.documents(spark, sf_dir), V.versions(spark, sf_dir), V.jobs(spark, sf_dir), files, readings)


@query("ingest_run_outcomes", with_views(*_RUN_VIEWS, extra=_RUN, body="""
select document_id, version_id, outcome, error_message, attempt, case when outcome = 'retry' then 0.5e0 end as retry_after_seconds from oc"""))
def ingest_run_outcomes(spark, sf_dir):
    return _job_run(spark, sf_dir)["outcomes"].drop("storage_key", "job_seq")


@query("ingest_run_jobs", with_views(*_RUN_VIEWS, extra=_RUN, body="""
select coalesce(h.job_id, 'job-' || o.version_id || '-' || job_seq) as job_id, o.document_id, o.version_id, case outcome when 'done' then 'COMPLETED' when 'retry' then 'RUNNING' else 'FAILED' end as status,
 case outcome when 'retry' then 45 else 100 end as progress_percent, coalesce(h.created_seq, job_seq) as created_seq, error_message, case when outcome = 'done' then coalesce(n, 0) end as total_pages
from oc o left join heldjob h on h.document_id = o.document_id and h.version_id = o.version_id left join cnt c on c.version_id = o.version_id where outcome <> 'unknown' or h.job_id is not null"""))
def ingest_run_jobs(spark, sf_dir):
    j = _job_run(spark, sf_dir)["jobs"]
    return j.withColumn("total_pages", F.get_json_object("summary_json", "$.total_pages").cast(BIG)).drop("summary_json")


@query("ingest_run_versions", with_views(*_RUN_VIEWS, extra=_RUN, body="""
select v.version_id, case when outcome is null or outcome = 'retry' then v.status when outcome = 'done' then 'ACTIVE' else 'FAILED' end as status,
 case when outcome = 'done' then coalesce(n, 0) else v.total_pages end as total_pages, case when outcome <> 'retry' then error_message end as error_message
from v_versions v left join oc o using (version_id) left join cnt c using (version_id)"""))
def ingest_run_versions(spark, sf_dir):
    return _job_run(spark, sf_dir)["versions"].select("version_id", "status", "total_pages", "error_message")


@query("ingest_run_documents", with_views(*_RUN_VIEWS, extra=_RUN, body="""
select d.document_id, d.collection_id, case outcome when 'retry' then d.status when 'done' then 'ACTIVE' else 'FAILED' end as status from v_documents d join oc using (document_id)"""))
def ingest_run_documents(spark, sf_dir):
    return _job_run(spark, sf_dir)["documents"].select("document_id", "collection_id", "status")


@query("ingest_run_audit", with_views(*_RUN_VIEWS, extra=_RUN, body="""
select case when outcome = 'done' then 'DOC_PROCESS_COMPLETED' else 'DOC_PROCESS_FAILED' end as action, 'documents' as entity_type, cast(document_id as varchar) as entity_id,
 case when outcome <> 'done' then error_message end as error, case when outcome = 'done' then coalesce(n, 0) end as total_pages, case when outcome = 'done' then attempt end as execution_attempts
from oc left join cnt using (version_id) where outcome in ('done', 'unknown', 'missing_file', 'exhausted')"""))
def ingest_run_audit(spark, sf_dir):
    part = lambda name, kind: F.get_json_object("details", f"$.{name}").cast(kind).alias(name)
    return _job_run(spark, sf_dir)["audit"].select("action", "entity_type", "entity_id", part("error", "string"), part("total_pages", BIG), part("execution_attempts", "int"))
