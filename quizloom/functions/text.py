"""Normalisation of text as column expressions.

Two steps have no built-in: decoding entities and composing accents. Texts that need either (see needs_python) take the
same path with one Arrow UDF; all others stay in the JVM.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

from quizloom.functions import patterns as P


_RUN = re.compile(f"[{re.escape(P.SPACE_CHARACTERS)}]+")
#: White space but the blank, tabs and ends of lines: one pattern, as collapse() runs inside of loops over arrays, where a search
#: for each character costs more.
_RARE = P.SPACE.replace(r"\t-\r\x1c-\x20", r"\x0b\x0c\x1c-\x1f")
#: What collapse() changes: white space but single blanks between other characters.
_LOOSE = rf"{_RARE[:-1]}\t\n\r]|  |^ | \z"
#: Without any of these a text is clean: tags, what collapse() changes, and what feedback begins or ends with.
_UNCLEAN = rf"^[ ✓✔✗✘●○→cirwCIRW]|{_RARE[:-1]}\t\n\r<]|  |[ )]\z"
_TAGS = re.compile(P.TAG)
_FEEDBACK = [re.compile(p.replace("(?iu)", ""), re.IGNORECASE) for p in (P.LEADING_MARK, P.LEADING_WORD, P.TRAILING_NOTE)]


def _plain(text: str) -> str:
    return html.unescape(_TAGS.sub("", text))


def _collapsed(text: str) -> str:
    return _RUN.sub(" ", unicodedata.normalize("NFC", text)).strip(" ")


def normalized_text(text: str) -> str:
    """As normalized(), for a string that is in Python already."""
    return _collapsed(_plain(text))


def cleaned_text(text: str) -> str:
    """As cleaned(), for a string that is in Python already."""
    out = _plain(text).strip()
    for pattern in _FEEDBACK:
        shorter = pattern.sub("", out, count=1)
        out = shorter if shorter.strip() else out
    return _collapsed(out)


@pandas_udf(StringType())
def normalized_python(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t is None else normalized_text(t))


@pandas_udf(ArrayType(StringType()))
def cleaned_python(s: pd.Series) -> pd.Series:
    """Cleans every string of an array."""
    return s.map(lambda a: a if a is None else [None if t is None else cleaned_text(t) for t in a])


def needs_python(text: Column) -> Column:
    """Has an entity, or a character from which on composition can change a text."""
    return F.contains(text, F.lit("&")) | text.rlike(r"[\u0300-\u03ff\u0460-\u200f\u2028-\x{10ffff}]")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space at the ends. To trim a set of characters costs more than to see that a text begins and ends with visible
    ASCII, as most do; in loops over arrays `text` should be a value that is there already, as it is named more than once."""
    done = text.between("!", "~") & F.substring(text, -1, 1).between("!", "~")
    return F.when(done, text).otherwise(F.btrim(text, F.lit(P.SPACE_CHARACTERS)))


def squeezed(text: Column) -> Column:
    """Runs of two white-space characters and more as one space. Few texts have any."""
    return F.when(text.rlike(r"[^!-~]{2}") & text.rlike(rf"{P.SPACE}{{2}}"), F.regexp_replace(text, rf"{P.SPACE}{{2,}}", " ")).otherwise(text)


def collapse(text: Column) -> Column:
    """White-space runs as one space, none at the ends. Most short texts have but single spaces inside and stay as they are."""
    common = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(" ")), "\n\t\r", text)
    plain = F.when(text.rlike(_RARE), F.regexp_replace(common, P.SPACE, " ")).otherwise(common)
    full = F.trim(F.when(F.contains(plain, F.lit("  ")), F.regexp_replace(plain, " {2,}", " ")).otherwise(plain))
    return F.when(text.rlike(_LOOSE), full).otherwise(text)


def strip_markup(text: Column) -> Column:
    """Tags go first, so that a decoded bracket is never taken for one."""
    return F.when(F.contains(text, F.lit("<")), F.regexp_replace(text, P.TAG, "")).otherwise(text)


def normalized(text: Column, python: bool = False) -> Column:
    return normalized_python(text) if python else collapse(strip_markup(text))


def strip_feedback(text: Column) -> Column:
    """A leading mark, a leading word and a trailing note go, each once, unless nothing would be left."""

    def without(out: Column, pattern: str) -> Column:
        return let(out, lambda t: let(F.regexp_replace(t, pattern, ""), lambda shorter: F.when(F.length(strip(shorter)) > 0, shorter).otherwise(t)))

    may = text.rlike(rf"{P.LEADING_MARK}|^{P.SPACE}*[✓✔✗✘●○→cirwCIRW]|\){P.SPACE}*$")  # few texts begin or end so
    return F.when(may, without(without(without(strip(text), P.LEADING_MARK), P.LEADING_WORD), P.TRAILING_NOTE)).otherwise(strip(text))


def cleaned(text: Column) -> Column:
    full = let(strip_markup(text), lambda t: let(strip_feedback(t), collapse))
    return F.when(text.rlike(_UNCLEAN), full).otherwise(text)


def cleaned_all(texts: Column, python: bool = False) -> Column:
    return cleaned_python(texts) if python else F.transform(texts, cleaned)


def answer_letters(cell: Column) -> Column:
    """Single letters of a list such as `A, c & D`, in upper case."""
    parts = F.split(cell, rf"(?:[,;/&+]|{P.SPACE})+", -1)
    return F.filter(F.transform(parts, lambda p: F.upper(strip(p))), lambda p: F.length(p) == 1)


def fold_letters(letters: Column, markers: Column) -> Column:
    """Answer letters in the alphabet of the option markers."""
    cyrillic = F.exists(markers, lambda m: m.rlike("^" + P.KEY_CYRILLIC_ONLY + "$"))
    to_cyrillic = F.transform(letters, lambda x: F.translate(x, P.KEY_LATIN, P.KEY_CYRILLIC))
    to_latin = F.transform(letters, lambda x: F.translate(x, P.KEY_CYRILLIC, P.KEY_LATIN))
    return F.when(cyrillic, to_cyrillic).otherwise(to_latin)


def answer_norm(text: Column) -> Column:
    return let(F.regexp_replace(F.lower(text), r"[.!?]+$", ""), strip)


def is_true_false(options: Column) -> Column:
    """Exactly two options that read as a true/false pair, in either order."""
    pair = F.array_join(F.array_sort(F.transform(options, answer_norm)), "\n")
    return (F.size(options) == 2) & pair.isin(["\n".join(sorted(p)) for p in P.TRUE_FALSE])


def family(question: Column, options: Column, n_correct: Column) -> Column:
    """Told by the material, never by the number of options."""
    several = question.rlike(P.SELECT_ALL) | (n_correct > 1)
    return F.when(several, "multiple-select").when(is_true_false(options), "true-false").otherwise("single-choice")


def deck_key(title: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    stem = F.regexp_replace(F.substring(F.when(slug == "", "captured").otherwise(slug), 1, 40), "-+$", "")
    return F.concat(F.when(stem == "", "captured").otherwise(stem), F.lit("-"), F.substring(F.sha2(title, 256), 1, 8))
