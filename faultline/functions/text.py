"""Text predicates and tokenisers used by search and rules."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# JavaScript ``\s`` (ECMAScript WhiteSpace + LineTerminator), as a Java
# character class: tab, LF, VT, FF, CR, space, NBSP, U+1680, U+2000-U+200A, LS, PS,
# U+202F, U+205F, U+3000, BOM. Java's own ``(?U)\s`` differs (U+0085 in, BOM out).
JS_SPACE = r"\t\n\x{0B}\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
WORD_SPLIT = "[" + JS_SPACE + ",]+"
ODD_ESCAPE = r"\\([^%_\\])|(\\.)"
GRAM = 3


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def escape_like(s: str) -> str:
    """Escape LIKE wildcards so user text matches literally."""
    return s.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def ilike_contains(col, keyword, literal: bool = False) -> Column:
    """``col ILIKE '%keyword%'``.

    By default the keyword goes in unescaped, as the handlers did, so ``%``
    and ``_`` stay wildcards (T12); ``literal=True`` escapes them. A Column
    keyword (one per row, e.g. batch search) is supported too. A backslash
    before any other character than ``%``, ``_`` and itself stands for that
    character, as in the database; Spark's own LIKE would fail on it.
    """
    if isinstance(keyword, Column):
        kw = keyword if literal else F.regexp_replace(keyword, ODD_ESCAPE, "$1$2")
        if literal:
            kw = F.regexp_replace(F.regexp_replace(F.regexp_replace(kw, r"\\", r"\\\\"), "%", r"\\%"),
                                  "_", r"\\_")
        return F.ilike(_c(col), F.concat(F.lit("%"), kw, F.lit("%")))
    kw = escape_like(keyword) if literal else re.sub(ODD_ESCAPE, lambda m: m[1] or m[2], keyword)
    return _c(col).ilike(f"%{kw}%")


def search_words(text, min_len: int = 2) -> Column:
    """``text.split(/[\\s,]+/).filter(w => w.length > 1)`` as an array column."""
    parts = F.split(F.coalesce(_c(text), F.lit("")), WORD_SPLIT)
    return F.filter(parts, lambda w: F.length(w) >= F.lit(min_len))


def split_words_py(text: str | None, min_len: int = 2) -> list[str]:
    """Driver-side twin of ``search_words`` for request parameters."""
    if not text:
        return []
    py_class = ("\t\n\x0b\x0c\r \xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff")
    return [w for w in re.split("[" + py_class + ",]+", text) if len(w) >= min_len]


def grams(text, n: int) -> Column:
    """All substrings of ``n`` characters, in order (one pass over the text)."""
    return F.regexp_extract_all(_c(text), F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))


def pattern_grams(pattern, literal: bool = False) -> Column:
    """Grams that every text which matches ``%pattern%`` (ignoring case) holds in lower case.

    They are of the longest kind, ``GRAM`` characters down to one, that the
    pattern's parts between wildcards have; a pattern of wildcards only has none.
    """
    low = F.lower(_c(pattern))
    parts = F.array(low) if literal else F.split(low, r"[%_\\]")

    def of(n: int) -> Column:
        return F.array_distinct(F.flatten(F.transform(parts, lambda p: grams(p, n))))

    out = of(1)
    for n in range(2, GRAM + 1):
        out = F.when(F.size(of(n)) > 0, of(n)).otherwise(out)
    return out


def text_grams(text) -> Column:
    """The distinct grams of one to ``GRAM`` characters of a text in lower case; none of a null."""
    low = F.lower(_c(text))
    return F.coalesce(F.array_distinct(F.concat(*[grams(low, n) for n in range(1, GRAM + 1)])), F.array().cast("array<string>"))
