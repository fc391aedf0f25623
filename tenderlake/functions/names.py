"""Accent folding, party names, match keys and addresses."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .cleaning import SPACE, none_if_blank, squeeze, strip, unify_quotes

_HANGUL = 0xAC00
# First character after the Latin letters.
_FAR = 0x250


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, str, str, str]:
    """How characters of any script fold: single letters (from, to, marks to delete last), longer forms as ``x=form`` entries, a pattern of the latter, and a short pattern that all of these fit.

    The fold of a text is that of its characters one by one: compatibility
    decomposition only reorders marks, and marks are dropped.
    """
    source, target, marks, longer = [], [], [], {}
    for code in range(0x80, sys.maxunicode + 1):
        if _HANGUL <= code < _HANGUL + 19 * 21 * 28:
            continue
        letter = chr(code)
        form = unicodedata.normalize("NFKD", letter)
        base = "".join(x for x in form if not unicodedata.combining(x))
        if base == letter:
            continue
        if len(base) == 1:
            source.append(letter)
            target.append(base)
        elif not base:
            marks.append(letter)
        else:
            longer[letter] = base
    ranges: list[list[int]] = []
    for code in map(ord, longer):
        if ranges and ranges[-1][1] == code - 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    pattern = "[\uac00-\ud7a3" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges) + "]"
    # letters without a counterpart are deleted
    near = "[" + "".join(x for x in longer if ord(x) < _FAR) + rf"\x{{{_FAR:X}}}-\x{{10FFFF}}]"
    return "".join(source + marks), "".join(target), "\n".join(f"{a}\t{b}" for a, b in longer.items()), pattern, near


def _syllable(x: Column) -> Column:
    """A Korean syllable as its letters."""
    at = F.ascii(x) - _HANGUL
    letters = [(0x1100, 19, F.floor(at / 588)), (0x1161, 21, F.floor(at % 588 / 28)), (0x11A7, 28, at % 28)]
    spelled = [F.substring(F.lit("".join(chr(first + i) for i in range(n))), place.cast("int") + 1, F.lit(1)) for first, n, place in letters]
    # the first of the last letters stands for none
    return F.concat(spelled[0], spelled[1], F.when(at % 28 > 0, spelled[2]).otherwise(""))


def fold(c: Column) -> Column:
    """Compatibility fold without accents, for text of any script, inside the JVM.

    One table serves all characters whose fold is one letter. ASCII text stands for
    itself, and only texts with a ligature, digraph, fraction, syllable or the like
    are taken apart; a short pattern tells Latin texts from others first.
    """
    source, target, longer, pattern, near = _fold_tables()
    forms = F.str_to_map(F.lit(longer), F.lit("\n"), F.lit("\t"))
    whole = F.array_join(
        F.transform(F.split(c, ""), lambda x: F.when(x.rlike("[\uac00-\ud7a3]"), _syllable(x)).when(x.rlike(pattern), F.try_element_at(forms, x)).otherwise(x)), ""
    )
    ascii_only = F.octet_length(c) == F.length(c)
    taken_apart = F.when(c.rlike(near) & c.rlike(pattern), whole).otherwise(c)
    return F.when(ascii_only, c).otherwise(F.translate(taken_apart, source, target))


def folded_lower(c: Column) -> Column:
    return F.lower(fold(c))


def _words(tokens: tuple[str, ...]) -> str:
    return r"\b(" + "|".join(tokens) + r")\b"


def party_name(c: Column) -> Column:
    """Grouping name: folded, upper-case, legal forms and quotes dropped."""
    text = F.translate(F.upper(fold(strip(c))), "„“”‘’", '"""""')
    for phrase in fixed.LEGAL_PHRASES:
        text = F.replace(text, F.lit(phrase), F.lit(" "))
    text = F.regexp_replace(text, _words(fixed.LEGAL_TOKENS), " ")
    text = squeeze(F.replace(text, F.lit('"'), F.lit("")))
    return F.coalesce(none_if_blank(text), F.lit(fixed.NO_PARTY))


def _drop_simple_tokens(text: Column) -> Column:
    for token in fixed.SIMPLE_PARTY_TOKENS:
        text = F.replace(text, F.lit(token + " "), F.lit(""))
        text = F.replace(text, F.lit(" " + token), F.lit(""))
    return text


def simple_party_name(c: Column) -> Column:
    """Fallback grouping name: no folding, legal forms cut as plain text."""
    text = _drop_simple_tokens(F.translate(F.upper(strip(c)), "„“”‘", '""""'))
    text = squeeze(F.translate(text, '.,"', "  "))
    return F.coalesce(none_if_blank(text), F.lit(fixed.NO_PARTY))


def party_text(c: Column) -> Column:
    """Comparison form of a name: as the fallback, also without apostrophes."""
    text = _drop_simple_tokens(F.upper(squeeze(unify_quotes(c))))
    return squeeze(F.translate(text, ".,\"'", "  "))


def compared_party_name(c: Column) -> Column:
    """Comparison name; blank is null."""
    return none_if_blank(party_text(c))


def display_name(c: Column) -> Column:
    return F.coalesce(F.when(c != "", squeeze(unify_quotes(c))), F.lit(fixed.NO_PARTY))


def without_noise(c: Column) -> Column:
    """Text before a trailing registration mark or, failing that, an eleven-digit run."""
    text = c
    marks = [rf"(?iU){m}" for m in (r"\(?rg\b", r"\(?reģ", r"\d{11}")]
    for mark in reversed(marks[1:]):
        text = F.when(c.rlike(mark), _before(c, mark)).otherwise(text)
    noisy = F.when(c.rlike(marks[0]), _before(c, marks[0])).otherwise(text)
    return strip(F.when(c.rlike(rf"(?iU)rg\b|reģ|\d{{11}}"), noisy).otherwise(c))


def _before(c: Column, mark: str) -> Column:
    """Text before the first place of a mark."""
    return F.split(c, mark, 2)[0]


def match_key(c: Column) -> Column:
    """Lower-case alphanumeric core used for fuzzy comparison."""
    text = folded_lower(without_noise(c))
    for phrase in fixed.MATCH_PHRASES:
        text = F.replace(text, F.lit(phrase), F.lit(" "))
    text = F.regexp_replace(text, _words(fixed.MATCH_TOKENS), " ")
    return F.trim(F.regexp_replace(text, r"[^a-z0-9]+", " "))


def name_core(c: Column) -> Column:
    """Folded name without the short legal forms."""
    return squeeze(F.regexp_replace(folded_lower(c), _words(fixed.CORE_TOKENS), ""))


def plausible(c: Column) -> Column:
    """At least three characters, two letters, and no stop phrase."""
    text = folded_lower(c)
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    known_bad = text.isin(*fixed.IMPLAUSIBLE_NAMES)
    return F.coalesce((F.length(c) >= 3) & (F.length(text) >= 3) & (letters >= 2) & ~known_bad, F.lit(False))


def name_quality(c: Column) -> Column:
    """Sort key of a display name: plausible first, few marks, short, then text."""
    marks = F.length(F.regexp_replace(c, r'[^"()„“]', ""))
    return F.struct(F.when(plausible(c), 0).otherwise(1).alias("doubt"), marks.alias("marks"),
                    F.length(c).alias("chars"), c.alias("name"))


def address_key(c: Column) -> Column:
    text = F.translate(folded_lower(c), ".,", "  ")
    return squeeze(F.regexp_replace(text, r"\blv-?\d{4}\b", ""))


def municipality(c: Column) -> Column:
    parts = F.filter(F.transform(F.split(c, ","), strip), lambda p: p != "")
    return F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit(""))


def sorted_tokens(c: Column) -> Column:
    """Blank-separated tokens in order, for order-free comparison."""
    return F.array_join(F.array_sort(F.split(c, " ")), " ")
