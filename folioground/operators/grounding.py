"""Evidence sufficiency, extractive answers, and claim checks for a table of queries.

A query has at most a handful of passages and its answer a handful of sentences: those are the
bounded groups collected here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioground import constants as C
from folioground.functions import text as X

_SENTENCE = r"(?<=[.!?])" + X.WS + r"+(?=[A-Z\[])"
_MARKER = r"(?iU)\[(?:Source:\s*|Doc:\s*)?([^,\]]+),\s*Page\s*(\d+)\]"
_ANY_MARKER = r"(?iU)\[(?:Source:\s*|Doc:\s*)?[^\]]+\]"
_ONLY_MARKER = r"(?iU)^\[(?:Source:\s*|Doc:\s*)?[^\]]+\]\.?$"


def _ratio(part: Column, whole: Column) -> Column:
    return F.size(part) / F.size(whole)


def _blank_if_null(c: str) -> Column:
    return F.coalesce(c, F.lit(""))


def evidence_sufficiency(queries: DataFrame, passages: DataFrame) -> DataFrame:
    """(query_id, is_sufficient, reason) for every query, with or without passages."""
    joined = F.concat_ws(" ", "document_title", "excerpt", _blank_if_null("section_heading"))
    evidence = (
        passages.groupBy("query_id")
        .agg(F.max("score").alias("top_score"),
             F.array_sort(F.collect_list(F.struct("rank", joined.alias("t")))).alias("ts"))
        .select("query_id", "top_score", F.lower(F.array_join(F.col("ts.t"), " ")).alias("body")))
    found = F.size(F.filter("terms", lambda t: F.contains(F.col("body"), t)))
    overlap = found / F.size("terms")
    reason = (
        F.when(F.col("top_score").isNull(), "NO_PASSAGES_RETRIEVED")
        .when(F.col("top_score") < C.SUFFICIENCY_SCORE, F.concat(
            F.lit("RELEVANCE_BELOW_THRESHOLD ("), X.fixed(F.col("top_score"), 2), F.lit(f" < {C.SUFFICIENCY_SCORE})")))
        .when(F.size("terms") == 0, "SUFFICIENT")
        .when(overlap < C.SUFFICIENCY_OVERLAP, F.concat(
            F.lit("KEYWORD_OVERLAP_TOO_LOW ("), X.fixed(overlap, 2), F.lit(" < 0.20)")))
        .otherwise("SUFFICIENT"))
    return (
        queries.select("query_id", X.content_words(F.col("query")).alias("terms"))
        .join(evidence, "query_id", "left")
        .select("query_id", (reason == "SUFFICIENT").alias("is_sufficient"), reason.alias("reason")))


def _template() -> Column:
    heading = F.when(_blank_if_null("section_heading") != "", F.concat(F.lit(" ["), "section_heading", F.lit("]"))).otherwise("")
    page = F.col("page_number").cast("string")
    return F.concat(
        F.lit("Under "), "document_title", F.lit(", Page "), page, heading, F.lit(": "),
        X.strip(F.col("excerpt")), F.lit(" [Source: "), "document_title", F.lit(", Page "), page, F.lit("]."))


def extractive_answers(passages: DataFrame) -> DataFrame:
    """(query_id, answer) quoting the first passage of each query with its source marker."""
    return passages.groupBy("query_id").agg(F.min_by(_template(), "rank").alias("answer"))


def strict_answers(queries: DataFrame, supported: DataFrame) -> DataFrame:
    """Answers written anew from supported passages alone; a refusal for a query that has none left."""
    return queries.select("query_id").join(extractive_answers(supported), "query_id", "left").select(
        "query_id", F.coalesce("answer", F.lit(C.NO_ANSWER_NO_PASSAGE)).alias("answer"), F.col("answer").isNull().alias("is_refusal"))


def draft_answers(queries: DataFrame, passages: DataFrame) -> DataFrame:
    """Answer or refusal per query, before claims are checked.

    ``queries``: query_id, query, follow_up_question, is_safe_to_answer.
    """
    asks = F.col("follow_up_question").isNotNull() & ~F.coalesce("is_safe_to_answer", F.lit(True))
    refusal = F.when(asks, F.concat(F.lit(C.NO_ANSWER_FOLLOW_UP), "follow_up_question")).otherwise(C.NO_ANSWER_PLAIN)
    body = F.concat("answer", F.when(asks, F.concat(F.lit(C.FOLLOW_UP_NOTE), "follow_up_question")).otherwise(""))
    return (
        queries.join(evidence_sufficiency(queries, passages), "query_id")
        .join(extractive_answers(passages), "query_id", "left")
        .select("query_id", F.when(F.col("is_sufficient"), body).otherwise(refusal).alias("answer"),
                (~F.col("is_sufficient")).alias("is_refusal"),
                F.when(~F.col("is_sufficient"), F.col("reason")).alias("refusal_reason")))


def answer_sentences(answers: DataFrame, keys: list[str] = ["query_id"]) -> DataFrame:
    """Sentences that state something: notes, advice and bare source tags are left out."""
    s = F.col("statement")
    return (
        answers.select(*keys, F.posexplode(F.split("answer", _SENTENCE)).alias("claim_idx", "raw"))
        .withColumn("statement", X.strip(F.col("raw"))).drop("raw")
        .filter((s != "") & ~s.startswith("Note:") & ~F.contains(s, F.lit("safely without guessing"))
                & ~s.startswith("To evaluate your eligibility") & ~s.rlike(_ONLY_MARKER)))


def citation_markers(sentences: DataFrame) -> DataFrame:
    """Title and page of the first source marker of each sentence, null without one."""
    s = F.col("statement")
    has = s.rlike(_MARKER)
    return sentences.withColumns({
        "cited_title": F.when(has, X.strip(F.regexp_extract(s, _MARKER, 1))),
        "cited_page": F.when(has, F.regexp_extract(s, _MARKER, 2).try_cast("int"))})


def check_claims(answers: DataFrame, passages: DataFrame, keys: list[str] = ["query_id"]) -> DataFrame:
    """Every statement with whether a passage carries it, by its marker or by shared words."""
    marked = citation_markers(answer_sentences(answers, keys))
    lead = F.lower("statement").startswith("under ") | F.lower("statement").startswith("based on ")
    bare = F.regexp_replace("statement", _ANY_MARKER, "")
    claims = (
        marked.withColumn("is_cited", F.col("cited_title").isNotNull()).withColumn("leads", lead)
        .withColumn("said", X.content_words(F.when(F.col("is_cited"), bare).otherwise(F.col("statement")))))
    title_page = F.struct(F.lower(X.strip(F.col("document_title"))).alias("t"), F.col("page_number").alias("p"))
    # The words of a passage are read once, before it meets its claims.
    everything = X.all_words(F.concat_ws(" ", "document_title", "excerpt", _blank_if_null("section_heading")))
    shown = passages.select("query_id", "rank", "document_title", "page_number", "excerpt",
                            title_page.alias("tp"), everything.alias("everything"))
    # A title and page shown twice keeps its first place but the words of its last passage.
    by_page = shown.groupBy("query_id", "tp").agg(
        F.min("rank").alias("rank"), F.max_by("excerpt", "rank").alias("excerpt"),
        F.max_by("document_title", "rank").alias("document_title")).select(
        "query_id", "tp", "rank", X.all_words(F.concat_ws(" ", "document_title", "excerpt")).alias("words_there"))
    ids = [*keys, "claim_idx"]

    cited_low = F.lower("cited_title")
    same = (F.contains(F.col("tp.t"), cited_low) | F.contains(cited_low, F.col("tp.t"))) & (
        F.col("cited_page").isNull() | (F.col("cited_page") == F.col("tp.p")))
    share = F.when(F.size("said") > 0, _ratio(F.array_intersect("said", "words_there"), F.col("said"))).otherwise(1.0)
    cited = (
        claims.filter("is_cited").join(by_page, "query_id", "left")
        .groupBy(*ids).agg(F.min_by(F.when(same, share), F.when(same, F.col("rank"))).alias("overlap"))
        .select(*ids, F.coalesce("overlap", F.lit(0.0)).alias("overlap"),
                F.coalesce(F.col("overlap") >= C.CLAIM_OVERLAP_CITED, F.lit(False)).alias("verified"),
                F.lit(None).cast("string").alias("found_title"), F.lit(None).cast("int").alias("found_page")))

    shared = F.when(F.size("said") > 0, _ratio(F.array_intersect("said", "everything"), F.col("said"))).otherwise(1.0)
    enough = F.col("leads") | ((F.size("said") > 0) & (F.col("shared") >= C.CLAIM_OVERLAP_UNCITED))
    where = F.when(enough & F.col("rank").isNotNull(), F.col("rank"))
    plain = (
        claims.filter("not is_cited").join(shown, "query_id", "left").withColumn("shared", shared)
        .groupBy(*ids).agg(F.min_by(F.struct("shared", "document_title", "page_number"), where).alias("m"))
        .select(*ids, F.coalesce("m.shared", F.lit(0.0)).alias("overlap"), F.col("m").isNotNull().alias("verified"),
                F.col("m.document_title").alias("found_title"), F.col("m.page_number").alias("found_page")))
    return (
        claims.join(cited.unionByName(plain), ids)
        .select(*ids, "statement", F.coalesce("cited_title", "found_title").alias("document_title"),
                F.coalesce("cited_page", "found_page").alias("page_number"), "verified",
                F.round("overlap", 6).alias("overlap")))


def answer_verdicts(answers: DataFrame, claims: DataFrame, keys: list[str] = ["query_id"]) -> DataFrame:
    """Whether every factual claim of an answer is verified; no claim at all is not verified."""
    factual = ~(F.col("statement").startswith("Based on official scheme") | F.col("statement").startswith("Note:"))
    per_answer = claims.groupBy(*keys).agg(
        F.bool_and(F.when(factual, F.col("verified"))).alias("factual_ok"), F.bool_and("verified").alias("all_ok"),
        F.count("*").alias("n_claims"))
    return answers.select(*keys).join(per_answer, keys, "left").select(
        *keys, F.coalesce("factual_ok", "all_ok", F.lit(False)).alias("grounded"),
        F.coalesce("n_claims", F.lit(0)).alias("n_claims"),
        (~F.coalesce("all_ok", F.lit(True))).alias("has_unsupported"))


def grounded_answers(queries: DataFrame, passages: DataFrame) -> DataFrame:
    """Drafts whose claims do not hold become refusals."""
    drafts = draft_answers(queries, passages)
    verdicts = answer_verdicts(drafts, check_claims(drafts.filter("not is_refusal"), passages))
    fails = ~F.col("is_refusal") & ~F.col("grounded")
    return (
        drafts.join(verdicts, "query_id")
        .select("query_id", F.when(fails, C.NO_ANSWER_UNVERIFIED).otherwise(F.col("answer")).alias("answer"),
                (F.col("is_refusal") | fails).alias("is_refusal"),
                (F.col("is_refusal") | F.col("grounded")).alias("grounding_verified"),
                F.when(fails, "GROUNDING_VALIDATION_FAILED").otherwise(F.col("refusal_reason")).alias("refusal_reason")))
