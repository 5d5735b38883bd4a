"""Citation validation against the catalog and the retrieved evidence, and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioground import constants as C
from folioground.functions import access as A, text as X
from folioground.operators import grounding as G
from folioground.operators.matching import substring_pairs
from folioground.staging import stage_table


def _resolve_documents(citations: DataFrame, documents: DataFrame) -> DataFrame:
    """The cited document by id, else the smallest id whose scheme name holds the cited title."""
    known = documents.select("document_id", F.lit(True).alias("known"))
    by_id = citations.join(known, "document_id", "left")
    found = by_id.filter("known").drop("known").withColumn("resolved", F.col("document_id"))
    lost = by_id.filter(F.col("known").isNull()).drop("known").withColumn("title_low", F.lower("document_title"))
    names = documents.groupBy(F.lower("scheme_name").alias("haystack")).agg(F.min("document_id").alias("doc"))
    by_title = (
        substring_pairs(lost.select(F.col("title_low").alias("needle")).distinct(), names.select("haystack"))
        .join(names, "haystack").groupBy(F.col("needle").alias("title_low")).agg(F.min("doc").alias("resolved")))
    return found.unionByName(lost.join(by_title, "title_low", "left").select(*found.columns))


def _same_evidence(cited: Column, shown: Column, cited_text: Column, shown_text: Column) -> Column:
    share = F.size(F.array_intersect(cited, shown)) / F.size(cited)
    a, b = F.lower(cited_text), F.lower(shown_text)
    return (F.size(cited) == 0) | (share >= C.EVIDENCE_OVERLAP) | F.contains(b, a) | F.contains(a, b)


def validate_citations(citations: DataFrame, requests: DataFrame, documents: DataFrame, versions: DataFrame,
                       pages: DataFrame, collections: DataFrame, passages: DataFrame) -> DataFrame:
    """Every citation with ``is_valid`` and the first reason against it.

    ``citations``: query_id, citation_index, document_id, document_title, version_id, page_number, excerpt.
    ``requests``: query_id, collection_id, user_id, permissions, include_historical.
    The resolved citations are written once. Lookups are equality joins, and documents, versions and page keys are
    cut to what is cited before anything of them moves.
    """
    cited = stage_table(_resolve_documents(citations, documents).join(
        requests.select("query_id", F.col("collection_id").alias("asked_collection"), "user_id", "permissions",
                        "include_historical"), "query_id"), "cited")
    wanted = cited.select(F.col("resolved").alias("document_id")).distinct()
    facts = documents.join(wanted, "document_id", "left_semi").select(F.col("document_id").alias("resolved"), F.col("collection_id").alias("held_in"),
                             F.col("status").alias("document_status"))
    rooms = collections.select(F.col("collection_id").alias("asked_collection"), "is_private", "owner_user_id")
    cited_versions = versions.join(cited.select("version_id").distinct(), "version_id", "left_semi").select(
        "version_id", F.col("status").alias("version_status"))
    page_keys = (pages.select(F.col("document_id").alias("resolved"), "page_number")
                 .join(cited.select("resolved", "page_number").distinct(), ["resolved", "page_number"], "left_semi").distinct()
                 .withColumn("page_known", F.lit(True)))
    newest = (versions.join(wanted, "document_id", "left_semi").groupBy(F.col("document_id").alias("resolved"))
              .agg(F.max_by("total_pages", "version_number").alias("max_pages")))
    evidence = (
        cited.select("query_id", "citation_index", "resolved", "document_id", "excerpt",
                     X.content_words(F.col("excerpt")).alias("cw"))
        .join(passages.select("query_id", F.col("document_id").alias("p_doc"), F.col("excerpt").alias("p_text"),
                              X.all_words(F.col("excerpt")).alias("pw")), "query_id")
        .groupBy("query_id", "citation_index")
        .agg(F.bool_or(((F.col("p_doc") == F.col("resolved")) | (F.col("p_doc") == F.col("document_id")))
                       & _same_evidence(F.col("cw"), F.col("pw"), F.col("excerpt"), F.col("p_text"))).alias("seen")))
    may_read = A.may_read(F.col("is_private"), F.col("owner_user_id"), F.col("user_id"), F.col("permissions"))
    archived = (F.col("document_status") == C.ARCHIVED) | F.coalesce(F.col("version_status") == C.ARCHIVED, F.lit(False))
    history_ok = F.coalesce("include_historical", F.lit(False)) & A.holds_any(F.col("permissions"), C.HISTORY_ACCESS)
    usable_max = F.when(F.col("max_pages") > 0, F.col("max_pages"))
    bad_page = (F.col("page_number") <= 0) | (
        F.col("page_known").isNull() & (usable_max.isNull() | (F.col("page_number") > usable_max)))
    reason = (
        F.when(F.col("resolved").isNull(), "DOCUMENT_NOT_FOUND")
        .when(F.col("held_in") != F.col("asked_collection"), "WRONG_COLLECTION")
        .when(~may_read, "UNAUTHORIZED_PRIVATE_COLLECTION")
        .when(archived & ~history_ok, "UNAUTHORIZED_ARCHIVED_DOCUMENT")
        .when(bad_page, "INVALID_PAGE_NUMBER")
        .when(~F.coalesce("seen", F.lit(True)), "NOT_IN_RETRIEVED_EVIDENCE"))
    return (
        cited.join(facts, "resolved", "left").join(rooms, "asked_collection", "left")
        .join(cited_versions, "version_id", "left").join(page_keys, ["resolved", "page_number"], "left")
        .join(newest, "resolved", "left").join(evidence, ["query_id", "citation_index"], "left")
        .select("query_id", "citation_index", "document_id", "document_title", "page_number",
                reason.isNull().alias("is_valid"), reason.alias("error_reason")))


def _rejection() -> Column:
    return F.format_string("Citation #%d (%s, Page %d) rejected: %s", F.col("citation_index") + 1,
                           "document_title", "page_number", "error_reason")


def validation_report(checked: DataFrame) -> DataFrame:
    """Totals and messages per query. A query has a handful of citations, so they are collected."""
    bad = ~F.col("is_valid")
    return (
        checked.groupBy("query_id")
        .agg(F.count("*").alias("total_citations"), F.count_if("is_valid").alias("valid_citations"),
             F.count_if(bad).alias("invalid_citations"),
             F.array_sort(F.collect_list(F.when(bad, F.struct("citation_index", _rejection().alias("m"))))).alias("ws"))
        .select("query_id", "total_citations", "valid_citations", "invalid_citations",
                F.array_join(F.col("ws.m"), "\n").alias("warnings")))


def validation_details(checked: DataFrame) -> DataFrame:
    """Per query every citation's check in its order (``details``) and the messages of the rejected ones."""
    item = F.struct("citation_index", "document_id", "document_title", "page_number", "is_valid", "error_reason")
    return (
        checked.groupBy("query_id")
        .agg(F.array_sort(F.collect_list(item)).alias("details"),
             F.array_sort(F.collect_list(F.when(~F.col("is_valid"), F.struct("citation_index", _rejection().alias("m"))))).alias("ws"))
        .select("query_id", F.col("ws.m").alias("messages"), "details"))


def reconcile(answers: DataFrame, citations: DataFrame, checked: DataFrame) -> DataFrame:
    """Final answer per query after its citations were checked.

    ``answers``: query_id, answer. ``citations`` are the cited passages with ``rank``, numbered from
    one; ``checked`` is their validation. Answers with a bad citation or claim are written anew from
    the supported passages and checked again; both variants are checked in one pass.
    """
    supported = citations.join(
        checked.filter("is_valid").select("query_id", (F.col("citation_index") + 1).alias("rank")),
        ["query_id", "rank"], "left_semi")
    rewritten = G.extractive_answers(supported)
    keys = ["query_id", "variant"]
    variants = (
        answers.select("query_id", F.lit("given").alias("variant"), "answer")
        .unionByName(rewritten.select("query_id", F.lit("rewritten").alias("variant"), "answer")))
    verdicts = G.answer_verdicts(variants, G.check_claims(variants, supported, keys), keys)
    side = lambda v: F.max(F.when(F.col("variant") == v, F.struct("grounded", "has_unsupported")))
    paired = verdicts.groupBy("query_id").agg(side("given").alias("g"), side("rewritten").alias("r"))
    bad = F.col("invalid_citations")
    sound = F.col("g.grounded") & ~F.col("g.has_unsupported") & (bad == 0)
    none_left, redone = F.col("valid_citations") == 0, F.coalesce("r.grounded", F.lit(False))
    notice = F.when(bad > 0, F.concat(
        F.lit("Notice: "), bad.cast("string"),
        F.lit(" unverified citation(s) were removed. The answer has been regenerated strictly from "
              "verified official sources.")))
    return (
        answers.join(validation_report(checked), "query_id").join(paired, "query_id")
        .join(rewritten.withColumnRenamed("answer", "rewritten"), "query_id", "left")
        .select(
            "query_id",
            F.when(none_left, C.NO_ANSWER_BAD_CITATIONS).when(sound, F.col("answer"))
            .when(redone, F.col("rewritten")).otherwise(F.col("answer")).alias("final_answer"),
            (~none_left & (sound | redone)).alias("grounding_verified"),
            F.when(none_left, C.WARN_NO_CITATION).when(sound, F.lit(None).cast("string"))
            .when(redone, notice).otherwise(C.WARN_UNVERIFIED).alias("verification_warning"),
            (none_left | ~sound).alias("has_unsupported_claims"),
            "total_citations", "valid_citations", "invalid_citations"))
