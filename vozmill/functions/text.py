"""Text cleaning and text flags as Column expressions."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from vozmill import lexicon as lx

# Blank characters in the sense of Unicode (ASCII separators 28-31 included).
_BLANK = r"(?U)[\s\x1c-\x1f]+"
# A blank character other than the space; the look-ahead passes over printable ASCII characters.
_OTHER_BLANK = r"(?=[^ -~])[\t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


@lru_cache(maxsize=1)
def _blank_chars() -> str:
    return "".join(chr(i) for i in range(sys.maxunicode + 1) if chr(i).isspace())


# Syllables of Hangul are arithmetic on three rows of letters, so they need no table.
_HANGUL = "\uac00-\ud7a3"
_HANGUL_ROWS = tuple(
    "".join(chr(first + i) for i in range(n)) for first, n in ((0x1100, 19), (0x1161, 21), (0x11A7, 28))
)
# Signs of up to this many letters are spelled letter by letter, the few longer ones one by one.
_SPELLED = 4


@lru_cache(maxsize=1)
def _bases() -> dict[str, str]:
    """Characters whose compatibility decomposition without marks differs from them; marks give nothing."""
    found = {}
    for code in [*range(0x80, 0xAC00), *range(0xD7A4, 0xD800), *range(0xE000, 0x110000)]:
        char = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        if base != char:
            found[char] = base
    return found


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str]:
    """Arguments of ``translate`` for characters with one base letter, and for marks, which go."""
    bases = _bases()
    single = [c for c, base in bases.items() if len(base) == 1]
    marks = [c for c, base in bases.items() if not base]
    return "".join(single + marks), "".join(bases[c] for c in single)


def _char_ranges(chars) -> str:
    """The characters, and all syllables, as ranges within a class of a regular expression."""
    codes, ranges = sorted(map(ord, chars)), []
    for code in codes:
        if ranges and code == ranges[-1][1] + 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges) + _HANGUL


@lru_cache(maxsize=1)
def _sign_tables() -> tuple[dict[str, str], list[tuple[str, str]], str]:
    """Characters of several letters: the long ones, ``translate`` arguments per letter, the ranges of all.

    The arguments for letter k delete the signs that have fewer letters.
    """
    wide = {c: base for c, base in _bases().items() if len(base) > 1}
    long = {c: base for c, base in wide.items() if len(base) > _SPELLED}
    short = {c: base for c, base in wide.items() if len(base) <= _SPELLED}
    steps = []
    for k in range(_SPELLED):
        having = [c for c in short if len(short[c]) > k]
        rest = [c for c in short if len(short[c]) <= k]
        steps.append(("".join(having + rest), "".join(short[c][k] for c in having)))
    return long, steps, _char_ranges(wide)


def _sign_class() -> str:
    """The class of all signs; ASCII fails at once."""
    return f"(?=[^\\x00-\\x7f])[{_sign_tables()[2]}]"


def _spell_signs(folded: Column) -> Column:
    """Ligatures, fractions, units and syllables as their letters.

    The text is taken apart into runs of ASCII, runs of other characters and single signs; only
    signs are looked at again. No position of an ASCII run is compared with the class of the signs.
    """
    long, steps, ranges = _sign_tables()
    signs = _sign_class()
    parts = F.regexp_extract_all(folded, F.lit(f"[\\x00-\\x7f]++|[^\\x00-\\x7f{ranges}]++|[{ranges}]"), F.lit(0))
    known = F.create_map(*[F.lit(x) for pair in long.items() for x in pair])

    def letters(part: Column) -> Column:
        number = F.ascii(part) - ord(_HANGUL[0])
        places = ((number / 588).cast("int"), ((number % 588) / 28).cast("int"), number % 28)
        rows = [F.substring(F.lit(row), place + 1, F.lit(1)) for row, place in zip(_HANGUL_ROWS, places)]
        syllable = F.concat(rows[0], rows[1], F.when(places[2] > 0, rows[2]).otherwise(F.lit("")))
        spelled = F.concat(*[F.translate(part, a, b) for a, b in steps])
        return (
            F.when(part.rlike(f"^[{_HANGUL}]$"), syllable)
            .when(part.rlike(f"^{signs}$"), F.coalesce(F.try_element_at(known, part), spelled))
            .otherwise(part)
        )

    return F.array_join(F.transform(parts, letters), "")


def _decompose(low: Column) -> Column:
    """Compatibility decomposition without marks. Few texts hold more than single letters with accents."""
    source, target = _fold_tables()
    signs = _sign_class()
    return bind(
        F.translate(low, source, target),
        lambda single: F.when(single.rlike(signs), _spell_signs(single)).otherwise(single),
    )


def bind(value: Column, make) -> Column:
    """``make(value)`` with the value computed once, however often ``make`` uses it.

    Without the binding an expression is repeated at every use, and nested uses
    multiply when Catalyst moves a filter below the projections it refers to.
    """
    return F.transform(F.array(value), lambda bound: make(bound)).getItem(0)


def text_or_blank(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    """Cut blank characters, Unicode ones included, from both ends."""
    return F.trim(text_or_blank(c), F.lit(_blank_chars()))


def collapse_spaces(c: Column) -> Column:
    """Every run of blank characters becomes one space, none at the ends."""
    return F.trim(F.regexp_replace(text_or_blank(c), _BLANK, " "))


def collapse_again(c: Column) -> Column:
    """T1 for texts that are mostly collapsed already: only those that are not are written anew."""
    def again(text: Column) -> Column:
        loose = text.contains("  ") | text.rlike(_OTHER_BLANK)
        return F.when(loose, F.trim(F.regexp_replace(text, _BLANK, " "))).otherwise(F.trim(text))

    return bind(text_or_blank(c), again)


def fold_accents(c: Column) -> Column:
    """Lower case without accents. Plain ASCII text skips the translation."""
    return bind(
        F.lower(text_or_blank(c)),
        lambda low: F.when(low.rlike(r"[^\x00-\x7f]"), _decompose(low)).otherwise(low),
    )


def fold_flat(flat: Column) -> Column:
    """:func:`fold_text` for a text that is collapsed already: ASCII text is only lowered."""
    def plain(low: Column) -> Column:
        # Some signs decompose to a space, so spaces are single again only after this.
        single = F.trim(F.regexp_replace(_decompose(low), "  +", " "))
        return F.when(low.rlike(r"[^\x00-\x7f]"), single).otherwise(low)

    return bind(F.lower(flat), plain)


def fold_text(c: Column) -> Column:
    """Lower case, no accents, single spaces."""
    return fold_flat(collapse_spaces(c))


def contains_any(c: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def contains_all(c: Column, words) -> Column:
    return reduce(lambda a, b: a & b, [c.contains(w) for w in words])


def count_hits(c: Column, words) -> Column:
    """How many of the words occur; each counts once."""
    return reduce(lambda a, b: a + b, [c.contains(w).cast("int") for w in words])


def is_boilerplate(c: Column, hints=lx.BOILERPLATE_HINTS) -> Column:
    """Any hint occurs in the folded text."""
    return is_boilerplate_flat(collapse_spaces(c), hints)


def is_boilerplate_flat(flat: Column, hints=lx.BOILERPLATE_HINTS) -> Column:
    """T3 for a text that is collapsed already."""
    return bind(fold_flat(flat), lambda folded: contains_any(folded, hints))


def has_loader_hint(c: Column, hints=lx.BOILERPLATE_HINTS_LOADER) -> Column:
    """T3 as the manual loader tests it: the spaces of the text are left as they are."""
    return bind(fold_accents(c), lambda folded: contains_any(folded, hints))


def site_suffix_pattern(brand: str, site: str) -> str:
    """One pattern for everything that starts a site footer or slogan.

    The tails "- brand - site" and "- site" come from page titles; the two
    slogans are fixed values. All cut to the end of the text, so the leftmost
    match decides and one pass over the text is enough.
    """
    site_words = r"\s*".join(re.escape(w) for w in site.split())
    brand_words = r"\s*".join(re.escape(w) for w in brand.split())
    return (
        rf"(?:\s*-\s*(?:{brand_words}\s*-\s*)?{site_words}|"
        + "|".join(lx.SLOGAN_PATTERNS)
        + r").*$"
    )


def cut_footer(flat: Column, brand: str = "Empresa", site: str = "Portal do Consumidor") -> Column:
    """Cut footers and slogans to the end of a text that is collapsed already.

    A text without the words of any of them is not searched with the pattern.
    """
    needed = [site.split(), *lx.SLOGAN_WORDS]
    plain = [[w.lower() for w in words if w.isascii()] for words in needed]

    def cut(text: Column) -> Column:
        gone = F.trim(F.regexp_replace(text, "(?i)" + site_suffix_pattern(brand, site), ""))
        if not all(plain):
            return gone
        able = bind(F.lower(text), lambda low: reduce(lambda a, b: a | b, [contains_all(low, words) for words in plain]))
        return F.when(able, gone).otherwise(text)

    return bind(flat, cut)


def strip_boilerplate(
    c: Column,
    brand: str = "Empresa",
    site: str = "Portal do Consumidor",
    hints=lx.BOILERPLATE_HINTS,
) -> Column:
    """T4: cut footers and slogans to the end; blank when hints remain."""
    cut = cut_footer(collapse_again(c), brand, site)
    return bind(cut, lambda t: F.when(is_boilerplate_flat(t, hints), F.lit("")).otherwise(t))


def sample_text(c: Column, limit: int = 150) -> Column:
    """T5: collapse, then cut to ``limit`` characters ending in '...'."""
    return bind(
        collapse_spaces(c),
        lambda flat: F.when(
            F.length(flat) > limit, F.concat(F.substring(flat, 1, limit - 3), F.lit("..."))
        ).otherwise(flat),
    )


def cut_text(c: Column, limit: int = 140) -> Column:
    """T5, plain form: collapse and cut, no dots."""
    return F.substring(collapse_spaces(c), 1, limit)


def status_class(c: Column) -> Column:
    """Resolved / unresolved / unknown; unresolved hints are tested first."""
    return bind(fold_text(c), status_of_folded)


def status_of_folded(folded: Column) -> Column:
    """T18 for a folded text."""
    return (
        F.when(contains_any(folded, lx.UNRESOLVED_HINTS), F.lit(lx.STATUS_UNRESOLVED))
        .when(contains_any(folded, lx.RESOLVED_HINTS), F.lit(lx.STATUS_RESOLVED))
        .otherwise(F.lit(lx.STATUS_UNKNOWN))
    )


_REFERENCE = "(?iU)" + lx.REFERENCE_PATTERN


def case_match(c: Column) -> Column:
    """First "protocolo 12345"-like place of a long text, blank when none."""
    return F.regexp_extract(text_or_blank(c), _REFERENCE, 0)


def reference_from(found: Column) -> Column:
    """Reference shown for a match of :func:`case_match`, or the placeholder."""
    label = F.regexp_replace(F.lower(F.regexp_extract(found, _REFERENCE, 1)), "^id$", "ID")
    code = F.trim(F.regexp_extract(found, _REFERENCE, 2), F.lit(".,;:)"))
    return bind(
        code,
        lambda bare: F.when(bare.rlike("[0-9*]"), F.concat_ws(" ", label, bare)).otherwise(
            F.lit(lx.REFERENCE_PLACEHOLDER)
        ),
    )


def case_reference(c: Column) -> Column:
    """Case reference of a text; the text itself is searched once."""
    return bind(case_match(c), reference_from)


def clean_author(c: Column) -> Column:
    """Blank for generic names."""

    def named(name: Column) -> Column:
        low = F.lower(name)
        generic = low.isin(lx.GENERIC_AUTHORS) | low.startswith(lx.GENERIC_AUTHOR_PREFIX)
        return F.when(generic, F.lit("")).otherwise(name)

    return bind(strip(c), named)


def infer_category(c: Column, hints=lx.REVIEW_NEGATIVE_HINTS) -> Column:
    """Complaint when any negative hint occurs, else praise."""
    return bind(
        F.lower(text_or_blank(c)),
        lambda low: F.when(contains_any(low, hints), F.lit(lx.CATEGORY_COMPLAINT)).otherwise(
            F.lit(lx.CATEGORY_PRAISE)
        ),
    )


def clean_review(c: Column) -> Column:
    """Strip blanks, then double, then single quotes, then collapse."""
    unquoted = F.trim(F.trim(strip(c), F.lit('"')), F.lit("'"))
    return collapse_spaces(unquoted)


def mojibake_hits(c: Column) -> Column:
    """Occurrences of the marker letters of wrongly decoded UTF-8."""
    return bind(
        text_or_blank(c), lambda t: F.length(t) - F.length(F.translate(t, lx.MOJIBAKE_LETTERS, ""))
    )


def looks_garbled(c: Column) -> Column:
    return mojibake_hits(c) >= lx.MOJIBAKE_THRESHOLD


def looks_like_complaint(c: Column, hints=lx.BOILERPLATE_HINTS, min_length: int = 40) -> Column:
    """long enough and no boilerplate."""
    return bind(
        collapse_spaces(c),
        lambda flat: is_complaint_flat(flat, hints, min_length),
    )


def is_complaint_flat(flat: Column, hints=lx.BOILERPLATE_HINTS, min_length: int = 40) -> Column:
    """F9 for a text that is collapsed already."""
    return (F.length(flat) >= min_length) & ~is_boilerplate_flat(flat, hints)
