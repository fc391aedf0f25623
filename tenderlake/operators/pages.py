"""Portal pages: page facts, embedded document lists, report choice and status."""

from __future__ import annotations

import json
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..functions.cleaning import none_if_blank, strip
from ..functions.labels import contains_any
from ..functions.names import folded_lower

# Task helpers travel with the job, so workers need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def page_facts(pages: DataFrame, html: str = "html") -> DataFrame:
    """Captcha and publication flags and the request token of each page."""
    text = F.col(html)
    return pages.withColumns(
        {
            "is_captcha": contains_any(text, fixed.CAPTCHA_MARKERS),
            "csrf_token": none_if_blank(F.regexp_extract(text, fixed.CSRF_PATTERN, 1)),
            "is_publication": F.contains(text, F.lit(fixed.PUBLICATION_MARKER)),
        }
    )


def _array_text(page: str, variable: str) -> list[str]:
    """Objects of the array assigned to ``var <variable>``, each as JSON text."""
    at = page.find(f"var {variable} = ")
    start = page.find("[", at) if at >= 0 else -1
    if start < 0:
        return []
    try:
        found, _ = json.JSONDecoder(strict=True).raw_decode(page, start)
    except (json.JSONDecodeError, RecursionError):
        return []
    return [json.dumps(x, ensure_ascii=False) for x in found if isinstance(x, dict)]


def embedded_items(html: Column, variable: str) -> Column:
    """Array of JSON object texts that a page assigns to a script variable."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def read(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None else _array_text(t, variable))

    return read(html)


DOCUMENT = "Id string, TypeCode string, TypeTitle string, Title string"


def documents(pages: DataFrame, variable: str, html: str = "html", out: str = "docs") -> DataFrame:
    """Pages with the documents listed under a script variable."""
    parsed = F.transform(embedded_items(F.col(html), variable), lambda x: F.from_json(x, DOCUMENT))
    return pages.withColumn(out, parsed)


def _prefixed(texts: Column, prefix: str) -> Column:
    return F.transform(texts, lambda t: F.concat(F.lit(prefix), t))


def matched_titles(pages: DataFrame, html: str = "html", historical: bool = True, patterns: tuple[str, ...] = fixed.DESIGN_TITLE_PATTERNS) -> DataFrame:
    """Design-document titles per page, marked with the section they stand in."""
    any_pattern = "|".join(patterns)
    sections = {"actual": "ActualDocuments_items"}
    if historical:
        sections["historical"] = "HistoricalDocuments_items"
    lists = []
    for section, variable in sections.items():
        pages = documents(pages, variable, html, f"_{section}")
        titles = F.transform(F.col(f"_{section}"), lambda d: strip(F.coalesce(d["Title"], F.lit(""))))
        hits = F.filter(titles, lambda t: (t != "") & folded_lower(t).rlike(any_pattern))
        lists.append(_prefixed(hits, f"{section}:"))
    found = F.concat(*lists)
    out = pages.withColumns({"matched_document_titles": found, "matched_document_count": F.size(found)})
    return out.drop(*[f"_{s}" for s in sections])


def final_report(docs: Column) -> Column:
    """The outcome document of a list: final report, else financial summary, else any report; null if none."""

    def folded(x: Column) -> Column:
        return folded_lower(F.coalesce(x, F.lit("")))

    def is_final(d: Column) -> Column:
        code = F.coalesce(d["TypeCode"] == fixed.FINAL_REPORT_CODE, F.lit(False))
        wanted = F.lit(fixed.FINAL_REPORT_TITLE)
        return code | F.contains(folded(d["Title"]), wanted) | F.contains(folded(d["TypeTitle"]), wanted)

    def is_summary(d: Column) -> Column:
        return contains_any(F.concat_ws(" ", folded(d["Title"]), folded(d["TypeTitle"])), fixed.FINANCIAL_SUMMARY_TITLES)

    def is_report(d: Column) -> Column:
        return contains_any(folded(d["Title"]), fixed.REPORT_TITLES)

    return F.coalesce(*[F.try_element_at(F.filter(docs, tier), F.lit(1)) for tier in (is_final, is_summary, is_report)])


def report_status(records: DataFrame) -> DataFrame:
    """Download status of each record from its status, local file and fetch result.

    Expects ``procurement_status, local_file, document_found, fetch_error`` and,
    from earlier runs, ``is_eps_publication``; a found publication page is an
    ``eps_publication`` error.
    """
    skipped = F.coalesce(strip(F.col("procurement_status")).isin(*fixed.SKIPPED_STATUSES), F.lit(False))
    present = F.col("local_file").isNotNull()
    found = F.coalesce("document_found", F.lit(False))
    published = F.coalesce(F.col("fetch_error") == "eps_publication", F.lit(False))
    tried = ~(skipped | present)
    before = F.col("is_eps_publication") if "is_eps_publication" in records.columns else F.lit(None).cast("string")
    return records.withColumns(
        {
            "report_download_status": F.when(skipped, "skipped_status")
            .when(present, "already_present")
            .when(found, "downloaded")
            .when(published, "skipped_eps_publication")
            .otherwise("failed"),
            "report_selection_method": F.when(skipped, "skipped_by_procurement_status")
            .when(present, "existing_local_file")
            .when(published & ~found, "page_type_detection")
            .when(found, "select_final_report_document"),
            "report_selection_reason": F.when(
                skipped,
                F.concat(F.lit("Skipped remote download because procurement_status is "), F.col("procurement_status"), F.lit(".")),
            ).when(present, "Skipped remote download because a local report file already exists."),
            "report_document_path": F.when(skipped, None).when(present, F.col("local_file")),
            "report_download_error": F.when(tried & ~found, F.col("fetch_error")),
            "is_eps_publication": F.when(skipped, "unknown").when(published, "yes").otherwise(F.coalesce(before, F.lit("unknown"))),
        }
    )


def report_work(records: DataFrame, only_not_processed: bool = False, only_failed: bool = False, retry_error_prefix: str = "", limit: int | None = None) -> DataFrame:
    """Records whose report is still to be fetched, in (year, id, address) order."""
    if only_not_processed:
        records = records.where(F.coalesce(none_if_blank(F.col("report_download_status")), F.lit("not_processed")) == "not_processed")
    if only_failed:
        records = records.where(F.col("report_download_status") == "failed")
    if retry_error_prefix.strip():
        records = records.where(F.col("report_download_error").startswith(retry_error_prefix.strip()))
    ordered = records.orderBy("year", "procurement_id", "procurement_url")
    return ordered.limit(limit) if limit else ordered
