"""Legibility of recognised text: alphabets, page furniture, share of letters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quizloom.functions import patterns as P
from quizloom.functions.text import let, strip

#: Alphabets that are told apart, in the order in which ties are settled. A letter of any other is of none.
_NAMES = """LATIN CYRILLIC GREEK ARMENIAN HEBREW ARABIC SYRIAC THAANA DEVANAGARI BENGALI GURMUKHI GUJARATI ORIYA TAMIL TELUGU KANNADA
MALAYALAM SINHALA THAI LAO TIBETAN MYANMAR GEORGIAN HANGUL ETHIOPIC CHEROKEE KHMER MONGOLIAN HIRAGANA KATAKANA BOPOMOFO HAN"""
SCRIPTS = tuple(_NAMES.split())
_COMMON = SCRIPTS[:3]
_OTHERS = "[" + "".join(rf"\p{{Is{n}}}" for n in SCRIPTS[3:]) + "]"
#: No letter of the others has another code point than these: a range is told faster than 29 alphabets.
_FAR = r"[\u02ea\u02eb\u0530-\x{10ffff}]"
#: Without such a character a text is in one alphabet or in none, and no pattern of an alphabet is tried on it.
_FOREIGN = r"[^\x00-\x7f]"


def _scripts() -> Column:
    """SCRIPTS as one array: what goes over the alphabets is a loop over it, not an expression for each, as plans that name every
    alphabet wherever a text is judged take longer to make than to run."""
    return F.split(F.lit(" ".join(SCRIPTS)), " ")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?U)[^\W\d_]+"), F.lit(0))


def _letters(text: Column) -> Column:
    """How many characters of each alphabet a text has. Patterns put together from the names are compiled anew for each text, so
    a text in the first alphabets alone, as most are, takes fixed ones."""
    common = F.array(*[F.length(F.regexp_replace(text, rf"[^\p{{Is{n}}}]+", "")) for n in _COMMON])
    every = F.transform(_scripts(), lambda n: F.length(F.regexp_replace(text, F.concat(F.lit(r"[^\p{Is"), n, F.lit("}]+")), F.lit(""))))
    return F.when(text.rlike(_FAR) & text.rlike(_OTHERS), every).otherwise(F.concat(common, F.array_repeat(F.lit(0), len(SCRIPTS) - len(_COMMON))))


def mixed_script_words(text: Column) -> Column:
    """Words written in two alphabets at once."""
    return F.filter(words(text), lambda w: w.rlike(_FOREIGN) & (F.size(F.filter(_letters(w), lambda n: n > 0)) > 1))


def _first_most(counts: Column) -> Column:
    """The name in SCRIPTS with the largest count; the first of equals; empty if all are 0."""
    return let(counts, lambda c: F.when(F.array_max(c) == 0, "").otherwise(F.get(_scripts(), (F.array_position(c, F.array_max(c)) - 1).cast("int"))))


def dominant_script(text: Column) -> Column:
    """The alphabet of most letters; equal counts go to the first of SCRIPTS; empty without letters."""
    return F.when(text.rlike(_FOREIGN), _first_most(_letters(text))).when(text.rlike("[A-Za-z]"), "LATIN").when(text.isNotNull(), "")


def stray_script_words(text: Column) -> Column:
    """Words of other alphabets than most of the line, where they are few enough to be a misreading."""

    def strays(told: Column) -> Column:
        known = F.filter(told, lambda t: t["script"] != "")
        main = _first_most(F.transform(_scripts(), lambda n: F.size(F.filter(told, lambda t: t["script"] == n))))
        return let(main, lambda m: F.transform(F.filter(known, lambda t: t["script"] != m), lambda t: t["word"]))

    def few(told: Column) -> Column:
        found = (F.size(told) >= P.LEAST_WORDS) & F.exists(told, lambda t: ~t["script"].isin("LATIN", ""))
        return F.when(found, let(strays(told), lambda s: F.when(F.size(s) <= P.MINORITY * F.size(told), s).otherwise(_nothing()))).otherwise(_nothing())

    return let(F.transform(words(text), lambda w: F.struct(dominant_script(w).alias("script"), w.alias("word"))), few)


def _nothing() -> Column:
    return F.array().cast("array<string>")


def letter_ratio(text: Column) -> Column:
    """Letters among the characters that are not white space; 0 without any."""
    dense = F.length(F.regexp_replace(text, P.SPACE, ""))
    return F.when(dense == 0, F.lit(0.0)).otherwise(F.length(F.regexp_replace(text, r"[^\p{L}]+", "")) / dense)


def furniture(text: Column) -> Column:
    """Distinct furniture characters, ascending."""
    return F.array_compact(F.array(*[F.when(F.contains(text, F.lit(c)), c) for c in sorted(P.FURNITURE)]))


def reasons(text: Column) -> Column:
    """Why a text is not legible, in a fixed order; empty if it is."""

    def told(t: Column) -> Column:
        def some(found: Column, say: str, most: int | None, between: str) -> Column:
            return let(found, lambda w: F.when(F.size(w) > 0, F.concat(F.lit(say), F.array_join(w if most is None else F.slice(w, 1, most), between))))

        foreign = t.rlike(_FOREIGN)
        found = F.array(
            F.when(foreign, some(mixed_script_words(t), "written in two alphabets at once: ", 3, ", ")),
            F.when(foreign, some(stray_script_words(t), "a few words in another alphabet than the rest: ", 3, ", ")),
            some(furniture(t), "page furniture left in the text: ", None, " "),
            F.when((F.length(t) >= P.SHORT) & (letter_ratio(t) < P.LEAST_LETTERS), F.lit("too few letters to be prose")),
        )
        return F.when(F.length(t) == 0, F.array(F.lit("the text is empty"))).otherwise(F.array_compact(found))

    return let(strip(text), told)


def legible(text: Column) -> Column:
    return F.size(reasons(text)) == 0


def fold_homoglyphs(text: Column) -> Column:
    """Words not wholly in the alphabet of most letters are rewritten with its lookalikes; other texts stay as they are."""

    def fold(w: Column, main: Column) -> Column:
        folded = F.when(main == "LATIN", F.translate(w, P.WORD_CYRILLIC, P.WORD_LATIN)).otherwise(F.translate(w, P.WORD_LATIN, P.WORD_CYRILLIC))
        others = F.rlike(w, F.concat(F.lit(r"[\p{L}&&[^\p{Is"), main, F.lit("}]]")))
        for n in _COMMON:  # fixed patterns are compiled once
            others = F.when(main == n, w.rlike(rf"[\p{{L}}&&[^\p{{Is{n}}}]]")).otherwise(others)
        return F.when(main == "", w).when(w.rlike(r"^\p{L}") & others, folded).otherwise(w)

    parts = F.regexp_extract_all(text, F.lit(r"(?U)\w+|\W+"), F.lit(0))
    folded = let(dominant_script(text), lambda main: F.array_join(F.transform(parts, lambda w: fold(w, main)), ""))
    touched = text.rlike(_FOREIGN) & text.rlike(r"\p{IsCyrillic}|\p{IsGreek}") & ((F.size(mixed_script_words(text)) > 0) | (F.size(stray_script_words(text)) > 0))
    return F.when(touched, folded).otherwise(text)


def latin_ratio(text: Column) -> Column:
    """ASCII letters among all letters."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    return F.when(letters == 0, F.lit(0.0)).otherwise(F.length(F.regexp_replace(text, "[^A-Za-z]", "")) / letters)


def reads_better(candidate: Column, current: Column) -> Column:
    a, b = latin_ratio(candidate), latin_ratio(current)
    n_words = lambda t: F.size(F.filter(F.split(t, rf"{P.SPACE}+"), lambda w: w != ""))
    return (F.length(strip(candidate)) >= 3) & ((a > b + 0.05) | ((a >= b) & (n_words(candidate) > n_words(current))))


def _upper(word: Column) -> Column:
    return word.rlike(r"\p{L}") & (word == F.upper(word)) & (word != F.lower(word))


def drop_leading_widget(text: Column) -> Column:
    """A first token of one or two characters goes if it is not all letters, or is in capitals before a word that isn't."""
    pattern = rf"(?s)^([^{P.SPACE[1:-1]}]{{1,2}}){P.SPACE}+([^{P.SPACE[1:-1]}]+)(.*)$"
    token, following = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    rest = F.concat(following, F.regexp_extract(text, pattern, 3))
    widget = token.rlike(r"[^\p{L}]") | (_upper(token) & ~_upper(following))
    return F.when((token != "") & widget, rest).otherwise(text)
