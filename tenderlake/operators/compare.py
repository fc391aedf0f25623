"""Field-by-field comparison of two stores of procurement records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed, jsonlists
from ..functions.cleaning import loose_flag, money_text, plain_text, squeeze, unify_quotes
from ..functions.names import compared_party_name, party_text
from ..sources.schemas import with_optional_columns

BUCKETS = 1 << 16
FIELD_SETS = {"all": fixed.ALL_COMPARED, "business": fixed.BUSINESS_COMPARED}


_NAMES = ("name", "winner_name", "participant_name")
_REGS = ("registration_no", "reg_no", "participant_reg_number", "winner_reg_number")
_VALUES = ("value_eur", "contract_value_eur")
_MEMBER = ", ".join(f"{x} string" for x in (*_NAMES, *_REGS, *_VALUES))


def _list_items(json_text: Column, with_value: bool) -> Column:
    """Members of a JSON list in canonical form, ordered by number, name and value.

    Each step is its own ``transform``, so every member is parsed and cleaned once.
    """

    def given(p: Column, keys: tuple[str, ...]) -> Column:
        return F.coalesce(*[F.when(p[k] != "", p[k]) for k in keys])

    def pick(p: Column) -> Column:
        return F.struct(given(p, _REGS).alias("reg"), given(p, _NAMES).alias("name"), given(p, _VALUES).alias("value"))

    def clean(p: Column) -> Column:
        fields = [F.coalesce(squeeze(unify_quotes(p["reg"])), F.lit("")).alias("registration_no"), F.coalesce(party_text(p["name"]), F.lit("")).alias("name")]
        if with_value:
            fields.append(F.coalesce(money_text(p["value"]), F.lit("")).alias("value_eur"))
        return F.struct(*fields)

    parsed = F.transform(jsonlists.object_items(json_text), lambda x: F.from_json(x, _MEMBER))
    return F.array_sort(F.transform(F.transform(parsed, pick), clean))


def canonical_list(json_text: Column, with_value: bool = False) -> Column:
    """Canonical text of a participant or winner list; null for none or for a non-list.

    Text that is no JSON at all counts as one name.
    """
    empty = F.coalesce(json_text, F.lit("")).isin("", "null")
    is_list = F.json_array_length(json_text).isNotNull()
    is_json = F.try_parse_json(json_text).isNotNull()
    name = F.coalesce(compared_party_name(json_text), F.lit(""))
    fields = [F.lit("").alias("registration_no"), name.alias("name")] + ([F.lit("").alias("value_eur")] if with_value else [])
    alone = F.to_json(F.array(F.struct(*fields)))
    return F.when(empty, None).when(is_list, F.to_json(_list_items(json_text, with_value))).when(~is_json, alone)


def canonical(field: str, c: Column) -> Column:
    """Comparable text of one field."""
    text = c.cast("string")
    if field == "procurement_participants_json":
        return canonical_list(text)
    if field == "winners_json":
        return canonical_list(text, True)
    if field in fixed.COMPARED_FLAGS:
        return F.coalesce(loose_flag(text).cast("string"), plain_text(text))
    if field in fixed.COMPARED_NUMBERS:
        return money_text(text)
    if field in fixed.COMPARED_NAMES:
        return compared_party_name(text)
    return plain_text(text)


def _complete(df: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    return with_optional_columns(df, T.StructType([T.StructField(f, T.StringType()) for f in fields]))


def _side(df: DataFrame, fields: tuple[str, ...], prefix: str) -> DataFrame:
    complete = _complete(df, fields)
    shaped = [canonical(f, F.col(f)).alias(f"{prefix}_{f}") for f in fields]
    return complete.where(F.col("procurement_id").isNotNull()).select("procurement_id", *shaped, F.lit(True).alias(f"in_{prefix}"))


def compare_wide(first: DataFrame, second: DataFrame, field_set: str = "all") -> DataFrame:
    """One row per procurement with both canonical values of every field and an overall status."""
    fields = FIELD_SETS[field_set]
    return _judged(_side(first, fields, "first").join(_side(second, fields, "second"), "procurement_id", "full"), fields)


def _judged(joined: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    here, there = F.col("in_first").isNotNull(), F.col("in_second").isNotNull()
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f"first_{f}").eqNullSafe(F.col(f"second_{f}"))
    status = F.when(here & ~there, "missing_in_second").when(there & ~here, "extra_in_second").when(same, "match").otherwise("field_mismatch")
    return joined.select(
        "procurement_id", here.alias("exists_in_first"), there.alias("exists_in_second"), status.alias("overall_status"),
        *[F.col(f"{side}_{f}") for f in fields for side in ("first", "second")],
    )


def _digested(df: DataFrame, fields: tuple[str, ...], buckets: int) -> DataFrame:
    """Field texts as they are, with a digest of all of them and the bucket of the id."""
    texts = [F.col(f).cast("string").alias(f) for f in fields]
    rows = _complete(df, fields).where(F.col("procurement_id").isNotNull()).select("procurement_id", *texts)
    # lengths part the texts, so no two rows give one concatenation; -1 stands for null
    parts = [x for f in fields for x in (F.coalesce(F.length(f), F.lit(-1)).cast("string"), F.lit(":"), F.coalesce(f, F.lit("")))]
    return rows.withColumns({"digest": F.sha2(F.concat(*parts), 256), "bucket": F.pmod(F.xxhash64(F.col("procurement_id").cast("string")), F.lit(buckets)).cast("int")})


def raw_differences(first: DataFrame, second: DataFrame, field_set: str = "all", buckets: int = BUCKETS) -> DataFrame:
    """Pairs of rows whose field texts are not the same letter by letter, not yet parsed: ``first_*``, ``second_*``, ``in_*``.

    Each side folds its digests per bucket of ids. Buckets with equal folds hold
    equal rows, and only rows of the others are exchanged. At most ``buckets``
    bucket numbers are sent to all tasks.
    """
    fields = FIELD_SETS[field_set]
    sides = {"first": _digested(first, fields, buckets), "second": _digested(second, fields, buckets)}

    def folded(prefix: str) -> DataFrame:
        # a sum, not an exclusive or, so that repeated rows don't cancel; the id is part of it
        whole = F.conv(F.substring(F.sha2(F.concat_ws(":", F.col("procurement_id").cast("string"), "digest"), 256), 1, 15), 16, 10).cast("decimal(20,0)")
        return sides[prefix].groupBy("bucket").agg(F.sum(whole).alias(f"sum_{prefix}"), F.count(F.lit(1)).alias(f"n_{prefix}"))

    same = F.col("sum_first").eqNullSafe(F.col("sum_second")) & F.col("n_first").eqNullSafe(F.col("n_second"))
    unequal = F.broadcast(folded("first").join(folded("second"), "bucket", "full").where(~same).select("bucket"))

    def rows(prefix: str) -> DataFrame:
        texts = [F.col(f).alias(f"{prefix}_{f}") for f in fields]
        return sides[prefix].join(unequal, "bucket", "left_semi").select("procurement_id", *texts, F.col("digest").alias(f"digest_{prefix}"), F.lit(True).alias(f"in_{prefix}"))

    joined = rows("first").join(rows("second"), "procurement_id", "full")
    return joined.where(~F.col("digest_first").eqNullSafe(F.col("digest_second"))).drop("digest_first", "digest_second")


def compare_changed(first: DataFrame, second: DataFrame, field_set: str = "all", buckets: int = BUCKETS) -> DataFrame:
    """The rows of ``compare_wide`` but those whose texts are the same on both sides, which match; only the rest is parsed."""
    fields = FIELD_SETS[field_set]
    raw = raw_differences(first, second, field_set, buckets)
    shaped = [
        F.when(F.col(f"in_{side}"), canonical(f, F.col(f"{side}_{f}"))).alias(f"{side}_{f}") for f in fields for side in ("first", "second")
    ]
    return _judged(raw.select("procurement_id", "in_first", "in_second", *shaped), fields)


def compare_long(wide: DataFrame, field_set: str = "all", show_matches: bool = False) -> DataFrame:
    """One row per differing field; a record on one side only is one row with field ``*``."""
    fields = FIELD_SETS[field_set]
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"first_{f}").alias("first_value"), F.col(f"second_{f}").alias("second_value")) for f in fields])
    none = F.lit(None).cast("string")
    missing = F.array(F.struct(F.lit("*").alias("field"), F.lit("present").alias("first_value"), none.alias("second_value")))
    extra = F.array(F.struct(F.lit("*").alias("field"), none.alias("first_value"), F.lit("present").alias("second_value")))
    status = F.col("overall_status")
    items = F.when(status == "missing_in_second", missing).when(status == "extra_in_second", extra).otherwise(pairs)
    listed = wide.select("procurement_id", "overall_status", F.explode(items).alias("p")).select("procurement_id", "overall_status", "p.*")
    equal = F.col("first_value").eqNullSafe(F.col("second_value"))
    whole = F.col("field") == "*"
    kind = F.when(whole, F.col("overall_status")).when(equal, "match").otherwise("field_mismatch")
    rows = listed.select("procurement_id", kind.alias("status"), "field", "first_value", "second_value")
    return rows if show_matches else rows.where(F.col("status") != "match")


def summary(wide: DataFrame, field_set: str = "all") -> DataFrame:
    """Totals and mismatches per field as ``measure, value``."""
    return _measured(wide, _measures(FIELD_SETS[field_set]))


def _measures(fields: tuple[str, ...]) -> dict[str, Column]:
    both = F.col("exists_in_first") & F.col("exists_in_second")
    status = F.col("overall_status")
    measures = {
        "first_compared": F.count_if("exists_in_first"),
        "second_loaded": F.count_if("exists_in_second"),
        "fully_matched": F.count_if(status == "match"),
        "with_any_difference": F.count_if(status.isin("field_mismatch", "missing_in_second")),
        "missing_in_second": F.count_if(status == "missing_in_second"),
        "extra_in_second": F.count_if(status == "extra_in_second"),
    }
    for f in fields:
        measures[f"field:{f}"] = F.count_if(both & ~F.col(f"first_{f}").eqNullSafe(F.col(f"second_{f}")))
    return measures


def _measured(wide: DataFrame, measures: dict[str, Column]) -> DataFrame:
    items = [F.struct(F.lit(name).alias("measure"), value.alias("value")) for name, value in measures.items()]
    return wide.agg(F.array(*items).alias("m")).select(F.inline("m"))


def summary_of_changed(changed: DataFrame, first: DataFrame, second: DataFrame, field_set: str = "all") -> DataFrame:
    """``summary`` from ``compare_changed``; ids are unique on each side, so the rows it leaves out are counted from the sides."""
    rows = changed
    for name, side in (("n_first", first), ("n_second", second)):
        size = side.where(F.col("procurement_id").isNotNull()).agg(F.count(F.lit(1)).alias(name))
        rows = rows.unionByName(size, allowMissingColumns=True)
    measures = _measures(FIELD_SETS[field_set])
    unread = F.max("n_first") - measures["first_compared"]
    measures |= {"first_compared": F.max("n_first"), "second_loaded": F.max("n_second"), "fully_matched": measures["fully_matched"] + unread}
    return _measured(rows, measures)


def differing_ids(wide: DataFrame, k: int = 50) -> DataFrame:
    """First ids with any difference, the report's sample."""
    odd = wide.where(F.col("overall_status").isin("field_mismatch", "missing_in_second"))
    return odd.select("procurement_id").orderBy("procurement_id").limit(k)
