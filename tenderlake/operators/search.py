"""Tender search: a filter chain, sort orders and match texts; ``alerts`` has the saved searches."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.cleaning import deadline_date
from ..functions.labels import any_of
from .ranking import top

RESULT_TEXTS = (
    "procurement_id", "title", "buyer", "region", "cpv_main", "publication_date", "submission_deadline", "status",
    "procedure_type", "eis_url",
)
PAGE = 50
# A backslash before another letter than a wildcard stands for nothing.
STRAY_ESCAPE = r"\\([^%_\\]|$)"
# Region choices that ask for no region.
NO_REGION = (None, "", "All Latvia", "all")


@dataclass(frozen=True)
class Query:
    """Search parameters; ``as_of`` stands for today."""

    as_of: date
    category: str | None = None
    cpv_prefixes: tuple[str, ...] = ()
    similar_cpv_prefixes: tuple[str, ...] = ()
    similar_companies: tuple[str, ...] = ()
    cpv_code: str | None = None
    keywords: tuple[str, ...] = ()
    buyer: str | None = None
    planning_region: str | None = None
    status: str | None = None
    subject_type: str | None = None
    value_min_eur: float | None = None
    value_max_eur: float | None = None
    deadline_days: int | None = None
    procedure_type: str | None = None
    pub_date_from: str | None = None
    pub_date_to: str | None = None
    sort: str | None = None
    locale: str = "en"

    def prefixes(self) -> list[str]:
        """Explicit, then similar-company, then category prefixes, each once."""
        wanted = [*self.cpv_prefixes, *self.similar_cpv_prefixes, *fixed.CATEGORY_PREFIXES.get(self.category or "", [])]
        return list(dict.fromkeys(wanted))

    def region(self) -> str | None:
        return None if self.planning_region in NO_REGION else self.planning_region


def _like(column: str, word: str) -> Column:
    """Case-blind containment; ``%`` and ``_`` in the word stay wildcards."""
    return F.ilike(F.col(column), F.lit(f"%{re.sub(STRAY_ESCAPE, lambda m: m[1], word)}%"))


def conditions(q: Query) -> list[Column]:
    """Every active filter as a predicate."""
    deadline, today = deadline_date(F.col("submission_deadline")), F.lit(q.as_of)
    out: list[Column] = []
    if q.prefixes():
        out.append(any_of([F.col("cpv_main").startswith(p) for p in q.prefixes()]))
    if q.cpv_code:
        out.append(F.col("cpv_main").startswith(q.cpv_code))
    if q.keywords:
        out.append(any_of([_like("title", w) for w in q.keywords]))
    if q.buyer:
        out.append(_like("buyer", q.buyer))
    if q.region():
        words = fixed.SEARCH_REGION_KEYWORDS.get(q.region(), [q.region().lower()])
        out.append(any_of([_like("region", w) for w in words]))
    status = q.status or "open"
    if status == "open":
        out.append(F.col("status").isin(*fixed.OPEN_STATUSES))
        no_deadline = F.col("submission_deadline").isNull() | (F.col("submission_deadline") == "")
        out.append(no_deadline | (deadline >= today))
    elif status == "closed":
        out.append(F.col("status").isin(*fixed.CLOSED_STATUSES))
    elif status != "all":
        out.append(F.col("status") == status)
    if q.subject_type in fixed.SUBJECT_TYPES:
        out.append(F.col("subject_type") == fixed.SUBJECT_TYPES[q.subject_type])
    if q.value_min_eur is not None:
        out.append(F.col("estimated_value_eur") >= q.value_min_eur)
    if q.value_max_eur is not None:
        out.append(F.col("estimated_value_eur") <= q.value_max_eur)
    if q.deadline_days:
        out.append(deadline.between(today, F.date_add(today, q.deadline_days)))
    if q.procedure_type:
        out.append(F.col("procedure_type") == q.procedure_type)
    if q.pub_date_from:
        out.append(F.col("publication_date") >= q.pub_date_from)
    if q.pub_date_to:
        out.append(F.col("publication_date") <= q.pub_date_to)
    return out


def matching(announcements: DataFrame, q: Query) -> DataFrame:
    for condition in conditions(q):
        announcements = announcements.where(condition)
    return announcements


def match_text(q: Query) -> str:
    """Why these tenders match, from the active filters."""
    texts, parts = fixed.MATCH_TEXTS[q.locale], []
    own = [p for p in q.prefixes() if p not in q.similar_cpv_prefixes]
    if own:
        parts.append(texts["cpv"].format(", ".join(own)))
    if q.similar_companies and q.similar_cpv_prefixes:
        parts.append(f"similar to {', '.join(q.similar_companies)} (CPV {', '.join(q.similar_cpv_prefixes)})")
    if q.keywords:
        parts.append(texts["keywords"].format(", ".join(q.keywords)))
    if q.region():
        parts.append(texts["region"].format(q.region()))
    return texts["prefix"].format("; ".join(parts)) if parts else texts["all"]


def order(q: Query) -> list[Column]:
    tie = F.asc("procurement_id")
    if q.sort == "deadline":
        return [deadline_date(F.col("submission_deadline")).asc_nulls_last(), tie]
    if q.sort == "value_desc":
        return [F.desc_nulls_last("estimated_value_eur"), tie]
    return [F.desc_nulls_first("publication_date"), tie]


def search(announcements: DataFrame, q: Query, page: int = PAGE) -> DataFrame:
    """One result page; texts are never null."""
    found = top(matching(announcements, q), page, *order(q))
    shown = [F.coalesce(F.col(x), F.lit("")).alias(x) for x in RESULT_TEXTS]
    return found.select(*shown, "estimated_value_eur", F.lit(match_text(q)).alias("match_reason"))


def match_count(announcements: DataFrame, q: Query) -> DataFrame:
    """All matches, and the count a page reports."""
    counted = matching(announcements, q).agg(F.count(F.lit(1)).alias("match_count"))
    return counted.withColumn("total_count", F.least(F.col("match_count"), F.lit(PAGE).cast("long")))


def procedure_types(announcements: DataFrame) -> DataFrame:
    named = announcements.where(F.coalesce(F.col("procedure_type") != "", F.lit(False)))
    return named.select("procedure_type").distinct().orderBy("procedure_type")
