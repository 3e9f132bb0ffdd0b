"""The patterns, word lists and letters that define what is read from learning material.

Patterns are for java.util.regex. White space is spelled out, since its `\\s` leaves out what Unicode counts as space.
"""

from __future__ import annotations

SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
SPACE_CHARACTERS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

# Markup and feedback.
TAG = r"<[^>]*>"
LEADING_MARK = rf"^[✓✔✗✘●○→]{SPACE}*"
LEADING_WORD = rf"(?iu)^(?:correct|incorrect|right|wrong)(?:[:.]|{SPACE}){SPACE}*"
TRAILING_NOTE = rf"(?iu){SPACE}*\((?:correct|incorrect|right answer|wrong)\){SPACE}*$"

# Lines of a quiz.
LETTER = "[A-Za-zА-Яа-я]"
OPTION = rf"(?d)^\(?({LETTER})[)\].:]{SPACE}+(.+)$"
BULLET = rf"(?d)^[-–—•*·]{SPACE}+(.+)$"
NUMBERED = rf"(?diu)^(?:(?:frage|question|q|въпрос|aufgabe){SPACE}*)?([0-9]{{1,3}}){SPACE}*[)\].:]{SPACE}*(.*)$"
INLINE_ANSWER = rf"(?diu)(?:answer|antwort|l[oö]sung|correct|solution|отговор|верен{SPACE}+отговор){SPACE}*[:\-–]?{SPACE}*({LETTER}(?:{SPACE}*[,;/&+]{SPACE}*{LETTER})*){SPACE}*$"
#: A line that states its answer has one of these, in lower case; the long s is another form of s.
INLINE_WORDS = ("answer", "antwort", "losung", "lösung", "correct", "solution", "отговор", "ſ")
KEY_HEADING = rf"(?diuU)^(?:answers?|l[oö]sungen|antworten|solutions?|answer{SPACE}+key|отговори|ключ)\b{SPACE}*:?{SPACE}*(.*)$"
KEY_PAIR = rf"([0-9]{{1,3}}){SPACE}*[-–)\].:]{SPACE}*({LETTER}(?:{SPACE}*[,;/&+]?{SPACE}*{LETTER})*)"
KEY_NUMBER = rf"^([0-9]{{1,3}}){SPACE}*[)\].:\-–]?{SPACE}*$"
KEY_ROW = rf"^([0-9]{{1,3}}){SPACE}*[)\].:\-–]{SPACE}*({LETTER}(?:{SPACE}*[,;/&+]{SPACE}*{LETTER})*){SPACE}*$"
CORRECT_MARK = rf"(?iu)(?:^|{SPACE})(?:[✓✔✅☑]|\({SPACE}*(?:correct|richtig|верен|верно){SPACE}*\))(?:{SPACE}|$)"
#: Without one of these no part of a line is a mark.
MARK_CHARACTERS = "✓✔✅☑("

# What decides the kind of a question.
SELECT_ALL = (
    rf"(?iu)select{SPACE}+all|all{SPACE}+that{SPACE}+apply|choose{SPACE}+all|mark{SPACE}+all|w[aä]hle[n]?{SPACE}+(?:sie{SPACE}+)?alle"
    rf"|mehrere{SPACE}+antworten|alle{SPACE}+zutreffenden|изберете{SPACE}+всички|отбележете{SPACE}+всички|повече{SPACE}+от{SPACE}+един"
)
TRUE_FALSE = (("true", "false"), ("wahr", "falsch"), ("richtig", "falsch"), ("вярно", "невярно"), ("верно", "невярно"))

# Letters drawn alike in two alphabets. The first pair is for answer letters, the second for words.
KEY_CYRILLIC, KEY_LATIN = "АВСЕНКМОРТХ", "ABCEHKMOPTX"
KEY_CYRILLIC_ONLY = "[БГДЖЗИЙЛПУФЦЧШЩЪЬЮЯ]"
WORD_CYRILLIC, WORD_LATIN = "АВЕКМНОРСТУХаеорсухкмтвн", "ABEKMHOPCTYXaeopcyxkmtbh"

# Legibility.
FURNITURE = "|@¤§¶©®™\\^~`"
LEAST_LETTERS = 0.55
SHORT = 12
MINORITY = 0.25
LEAST_WORDS = 4

# Families, tiers and capabilities.
VERIFIED_TIERS = ("source-verified", "reviewer-confirmed")
CAPABILITY = {"multiple-select": "mcq.multiple-select.v1", "true-false": "mcq.true-false"}
DRAFTABLE = ("single-choice", "multiple-select", "true-false", "flashcard")
#: The id of the target format; callers give that of their own target.
TARGET = "learncard.v1"
