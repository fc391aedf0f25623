"""Lookups that turn codes, places and model words into labels."""

from __future__ import annotations

import re
from functools import reduce
from itertools import chain
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .cleaning import let, none_if_blank, strip
from .names import folded_lower


def lookup(table: dict[str, str]) -> Column:
    """Literal map of a small fixed table."""
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])


def any_of(conditions: list[Column]) -> Column:
    return reduce(or_, conditions)


def contains_any(c: Column, words) -> Column:
    """Whether any of the plain words occurs in the text."""
    return c.rlike("|".join(re.escape(w) for w in words))


def cpv_label(prefix: Column, labels: dict[str, str] = fixed.CPV_LABELS) -> Column:
    return F.coalesce(F.try_element_at(lookup(labels), prefix), F.concat(F.lit("CPV "), prefix, F.lit("xxx")))


def cpv_category(c: Column, labels: dict[str, str] = fixed.CPV_LABELS) -> Column:
    """Label of the two-digit division; ``unknown`` for a missing code."""
    prefix = F.substring(F.regexp_replace(strip(c), '^[="]+', ""), 1, 2)
    return F.when(c.isNull() | (c == ""), fixed.NO_CATEGORY).otherwise(let(prefix, lambda p: cpv_label(p, labels)))


def location_bucket(c: Column) -> Column:
    """First comma part that is neither a postal code nor a street."""
    text = strip(c)
    for phrase, short in fixed.COUNTRY_PHRASES:
        text = F.replace(text, F.lit(phrase), F.lit(short))
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.btrim(p, F.lit(" .-"))), lambda p: p != "")

    def is_town(part: Column) -> Column:
        lower = F.lower(part)
        return ~(lower.startswith("lv") | contains_any(lower, fixed.STREET_MARKS))

    def choose(found: Column) -> Column:
        return F.coalesce(F.get(F.filter(found, is_town), F.lit(0)), F.get(found, F.lit(0)), F.lit(fixed.NO_LOCATION))

    return F.when(F.coalesce(strip(c), F.lit("")).isin("", "-"), fixed.NO_LOCATION).otherwise(let(parts, choose))


def planning_region(location: Column) -> Column:
    """Region of the first keyword list met in the location bucket."""

    def choose(bucket: Column) -> Column:
        region = F.when(bucket == fixed.COUNTRY, fixed.WHOLE_COUNTRY)
        for name, words in fixed.REGION_KEYWORDS.items():
            region = region.when(contains_any(F.lower(bucket), words), name)
        return region.otherwise(fixed.NO_REGION)

    return let(location_bucket(location), choose)


def category(*candidates: Column) -> Column:
    """First candidate that is real text: not blank, not ``unknown``, not JSON."""
    usable = []
    for c in candidates:
        t = strip(c)
        usable.append(F.when((t != "") & (t != fixed.NO_CATEGORY) & ~t.startswith("{"), t))
    return F.coalesce(*usable, F.lit(fixed.NO_CATEGORY))


def finished_status(c: Column) -> Column:
    return F.coalesce(contains_any(folded_lower(c), fixed.FINISHED_MARKERS), F.lit(False))


def enum_value(c: Column, allowed: tuple[str, ...], synonyms: dict[str, str]) -> Column:
    """Allowed word, else its synonym, else ``unknown``."""
    table = {**synonyms, **{word: word for word in allowed}}
    return F.coalesce(F.try_element_at(lookup(table), F.lower(strip(c))), F.lit("unknown"))


def domain(c: Column) -> Column:
    return enum_value(c, fixed.DOMAINS, fixed.DOMAIN_SYNONYMS)


def scope(c: Column) -> Column:
    return enum_value(c, fixed.SCOPES, fixed.SCOPE_SYNONYMS)


def work(c: Column) -> Column:
    return enum_value(c, fixed.WORKS, fixed.WORK_SYNONYMS)


def scale(c: Column) -> Column:
    return enum_value(c, fixed.SCALES, fixed.SCALE_SYNONYMS)


def final_label(c: Column) -> Column:
    return enum_value(c, fixed.FINAL_CATEGORIES, fixed.FINAL_SYNONYMS)


def message_language(text: Column) -> Column:
    """``lv`` or ``en`` by letters, then hint words; null when undecided."""
    def decide(t: Column) -> Column:
        english, latvian = t["english"], t["latvian"]
        return (
            F.when(t["lower"].rlike(f"[{fixed.LATVIAN_LETTERS}]"), "lv")
            .when((english >= 2) & (english > latvian), "en")
            .when((latvian >= 1) & (latvian > english), "lv")
        )

    def count(t: Column) -> Column:
        def hits(words: tuple[str, ...]) -> Column:
            return F.size(F.filter(t["tokens"], lambda x: x.isin(*words)))

        return F.struct(t["lower"].alias("lower"), hits(fixed.ENGLISH_HINTS).alias("english"), hits(fixed.LATVIAN_HINTS).alias("latvian"))

    def cut(lower: Column) -> Column:
        return F.struct(lower.alias("lower"), F.regexp_extract_all(lower, F.lit(rf"([a-z{fixed.LATVIAN_LETTERS}]+)")).alias("tokens"))

    return let(let(let(F.lower(strip(text)), cut), count), decide)


def lot_count_in_text(text: Column) -> Column:
    """Lots a text announces: numbered headings first, then split phrases; else 1."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(fixed.NUMBERED_LOT)), lambda n: n.try_cast("int"))
    found = [F.array_max(numbers)]
    found += [F.regexp_extract(text, phrase, 1).try_cast("int") for phrase in fixed.SPLIT_PHRASES]
    return F.coalesce(*[F.when(n >= 2, n) for n in found], F.lit(1))


def first_json_object(text: Column) -> Column:
    """JSON object text inside a model answer: fences dropped, else the outermost braces."""
    ws = r"[\s\p{Z}]*"

    def unfence(t: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(t, rf"^```[a-zA-Z0-9_-]*{ws}", ""), rf"{ws}```$", "")

    def as_object(t: Column) -> Column:
        return F.when(F.schema_of_variant(F.try_parse_json(t)).startswith("OBJECT"), t)

    def choose(t: Column) -> Column:
        inner = none_if_blank(F.regexp_extract(t, r"(?s)(\{.*\})", 1))
        return F.when(F.try_parse_json(t).isNull(), as_object(inner)).otherwise(as_object(t))

    return let(let(strip(text), lambda t: F.when(t.startswith("```"), unfence(t)).otherwise(t)), choose)
