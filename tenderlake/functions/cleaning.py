"""Cell cleaning and number, flag, date and code parsing."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

SPACE = r"[\s\p{Z}]+"
EDGE_SPACE = r"^[\s\p{Z}]+|[\s\p{Z}]+$"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
MONEY = "decimal(18,2)"


def strip(c: Column) -> Column:
    """Trim any whitespace, not only blanks."""
    return F.regexp_replace(c, EDGE_SPACE, "")


def squeeze(c: Column) -> Column:
    """Trim and collapse runs of whitespace to one blank."""
    return strip(F.regexp_replace(c, SPACE, " "))


def none_if_blank(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times, which keeps plans small."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def unwrap_loose(c: Column) -> Column:
    """``="123"`` to ``123``; only the opening mark is needed; null becomes empty."""
    return F.coalesce(F.regexp_replace(c, r'(?s)^="(.*?)"*$', "$1"), F.lit(""))


def unwrap_strict(c: Column) -> Column:
    """Trim, unwrap only a complete ``="..."`` and turn blanks into null."""
    return none_if_blank(F.regexp_replace(strip(c), r'(?s)^="(?:(.*)")?$', "$1"))


def clean_cell(c: Column) -> Column:
    """Trim and unwrap ``="..."`` or ``='...'``."""
    return F.regexp_replace(strip(c), r"""(?s)^=(?:(["'])(.*)\1|["'])$""", "$2")


def _number(bare: Column) -> Column:
    return F.regexp_extract(bare, NUMBER, 0).try_cast("double")


def plain_float(c: Column) -> Column:
    """Text that is a plain decimal number, else null (never ``1d`` or ``NaN``)."""
    return _number(strip(c))


def comma_float(c: Column) -> Column:
    return _number(strip(F.replace(c, F.lit(","), F.lit("."))))


def spaced_float(c: Column) -> Column:
    """Blanks dropped and decimal comma accepted: ``12 000,50``."""
    return _number(strip(F.translate(c, ", ", ".")))


def cell_float(c: Column) -> Column:
    return spaced_float(clean_cell(c))


def whole_number(c: Column) -> Column:
    """Integer text only: ``3.7`` is null."""
    return F.regexp_extract(strip(c), r"^[+-]?\d+$", 0).try_cast("int")


def truncated_int(c: Column) -> Column:
    """Number text cut to its integer part: ``3.7`` is 3."""
    return plain_float(c).try_cast("int")


def portal_flag(c: Column) -> Column:
    """Blank is null, known yes-words are true, anything else is false."""
    yes = F.lower(strip(c)).isin("1", "true", "jā", "ja", "yes")
    return F.when(c.isNotNull() & (c != ""), yes)


def loose_flag(c: Column) -> Column:
    """Yes-words true, no-words false, anything else null."""
    words = {**dict.fromkeys(("1", "true", "yes", "jā"), True), **dict.fromkeys(("0", "false", "no", "nē"), False)}
    table = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    return F.try_element_at(table, F.lower(squeeze(c)))


def pct(part: Column, whole: Column) -> Column:
    """Percentage to one decimal; null when the whole is null or zero."""
    return F.round(F.try_divide(part.cast("double") * 100.0, whole.cast("double")), 1)


def mean(total: Column, count: Column, digits: int = 2) -> Column:
    return F.round(F.try_divide(total.cast("double"), count.cast("double")), digits)


def reg_number(c: Column) -> Column:
    """Eleven digits after dropping a country prefix and blanks, else null."""
    bare = F.regexp_replace(F.regexp_replace(strip(c), r"^(?i:lv)", ""), SPACE, "")
    return none_if_blank(F.regexp_extract(bare, r"^\d{11}$", 0))


def cpv_code(c: Column) -> Column:
    return none_if_blank(F.regexp_extract(c, r"(\d{8}-\d)", 1))


def year_in_name(c: Column) -> Column:
    return F.regexp_extract(c, r"(20\d{2})", 1).try_cast("int")


def money_text(c: Column) -> Column:
    """Two-decimal text; text that is no number is kept as canonical text."""
    number = F.regexp_extract(strip(c), NUMBER, 0).try_cast("decimal(38,2)").cast("string")
    return F.coalesce(number, plain_text(c))


def unify_quotes(c: Column) -> Column:
    return F.translate(c, "„“”", '"""')


def plain_text(c: Column) -> Column:
    return none_if_blank(squeeze(unify_quotes(c)))


def _matches(c: Column, shape: str, parse: Column) -> Column:
    return F.when(c.rlike(shape), parse)


def guarded_date(c: Column) -> Column:
    """Strict ISO or ``DD.MM.YYYY`` text to a date."""
    return F.coalesce(
        _matches(c, r"^\d{4}-\d{2}-\d{2}$", F.try_to_date(c, "yyyy-MM-dd")),
        _matches(c, r"^\d{2}\.\d{2}\.\d{4}$", F.try_to_date(c, "dd.MM.yyyy")),
    )


def deadline_date(c: Column) -> Column:
    """``D.M.YYYY`` deadline text to a date."""
    return F.try_to_date(none_if_blank(c), "d.M.yyyy")


def decision_lag(deadline: Column, decision: Column) -> Column:
    """Days from the bid deadline (3 layouts) to the decision (2 layouts)."""
    closing = F.coalesce(
        _matches(deadline, r"^\d{4}-\d{1,2}-\d{1,2}T", F.try_to_timestamp(deadline, F.lit("yyyy-M-d'T'H:m:s")).cast("date")),
        _matches(deadline, r"^\d{1,2}\.\d{1,2}\.\d{4} ", F.try_to_timestamp(deadline, F.lit("d.M.yyyy H:m")).cast("date")),
        _matches(deadline, r"^\d{1,2}\.\d{1,2}\.\d{4}$", F.try_to_date(deadline, "d.M.yyyy")),
    )
    decided = F.coalesce(
        _matches(decision, r"^\d{4}-\d{1,2}-\d{1,2}$", F.try_to_date(decision, "yyyy-M-d")),
        _matches(decision, r"^\d{1,2}\.\d{1,2}\.\d{4}$", F.try_to_date(decision, "d.M.yyyy")),
    )
    return F.date_diff(decided, closing)


def size_band(c: Column) -> Column:
    band = F.when(c.isNull(), fixed.NO_ESTIMATE_BAND)
    for bound, label in fixed.SIZE_BANDS:
        band = band.when(c < bound, label)
    return band.otherwise(fixed.TOP_BAND)


def procurement_url(url: Column, procurement_id: Column) -> Column:
    """Absolute portal address; built from the id when no address is given."""
    pid = none_if_blank(clean_cell(procurement_id))
    bare = fixed.PORTAL_BARE_HOST.replace(".", r"\.")

    def absolute(given: Column) -> Column:
        return (
            F.when(given == "", F.concat(F.lit(fixed.PORTAL_PROCUREMENT), pid))
            .when(given.startswith("/"), F.concat(F.lit(fixed.PORTAL_ROOT), given))
            .when(given.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), given)
            .otherwise(F.concat(F.lit("https://"), F.regexp_replace(given, "^/+", "")))
        )

    whole = let(strip(F.coalesce(clean_cell(url), F.lit(""))), absolute)
    return F.regexp_replace(whole, rf"^(?i:([a-z]+))://{bare}(?=[/?#]|$)", f"$1://{fixed.PORTAL_HOST}")


def record_key(procurement_id: Column, url: Column) -> Column:
    """``id:...`` else ``url:...`` else null."""
    return F.coalesce(
        F.concat(F.lit("id:"), none_if_blank(strip(procurement_id))), F.concat(F.lit("url:"), none_if_blank(strip(url)))
    )
