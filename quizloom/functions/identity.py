"""Content-hash identities. Each is the SHA-256 of labelled lines, cut to a length and given a prefix."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _hash(*lines: Column | str) -> Column:
    return F.sha2(F.concat_ws("\n", *[F.lit(x) if isinstance(x, str) else x for x in lines]), 256)


def _line(label: str, value: Column) -> Column:
    return F.concat(F.lit(label + ":"), value)


def question_fingerprint(origin: Column, path: Column, family: Column, question: Column, options: Column) -> Column:
    """question and options are clean already; the order of options does not matter."""
    return _hash(
        "qfp:1", _line("origin", origin), _line("path", path), _line("family", F.lower(family)), _line("question", question),
        _line("option_count", F.size(options).cast("string")), _line("options", F.array_join(F.array_sort(options), "\n")),
    )


def state_fingerprint(question_fp: Column, states: Column, explanations: Column) -> Column:
    """states: array of struct(clean, checked, visible) in document order; equal texts keep that order."""
    placed = F.transform(states, lambda s, i: F.struct(s["clean"].alias("clean"), i.alias("i"), s["checked"].alias("checked"), s["visible"].alias("visible")))
    told = F.transform(F.array_sort(placed), lambda s: F.concat_ws(":", s["clean"], s["checked"].cast("int").cast("string"), s["visible"]))
    return _hash("sfp:1", _line("qfp", question_fp), _line("options", F.array_join(told, "|")), _line("explanation", F.array_join(explanations, "\n")))


def capture_id(created: Column, origin: Column, path: Column, state: Column, question_fp: Column, artifacts: Column) -> Column:
    lines = ("cid:1", _line("created", created), _line("origin", origin), _line("path", path), _line("state", state), _line("qfp", question_fp))
    return F.concat(F.lit("cap_"), _hash(*lines, _line("artifacts", F.array_join(F.array_sort(artifacts), "\n"))))


def run_capture_id(created: Column, origin: Column, path: Column, state: Column) -> Column:
    """The capture of a whole run: no question and no artifacts of its own."""
    return capture_id(created, origin, path, state, F.lit("0" * 64), F.array().cast("array<string>"))


def source_id(origin: Column, path: Column, question_fp: Column) -> Column:
    return F.concat(F.lit("src_"), F.substring(_hash("sid:1", _line("origin", origin), _line("path", path), _line("qfp", question_fp)), 1, 32))


def option_id(source: Column, clean: Column) -> Column:
    return F.concat(F.lit("opt_"), F.substring(_hash("oid:1", _line("source_id", source), _line("clean_text", clean)), 1, 32))


def card_id(source: Column) -> Column:
    return F.concat(F.lit("q-"), F.substring(_hash("crd:1", _line("source_id", source)), 1, 16))


def page_draft_id(source: Column, family: Column) -> Column:
    return F.concat(F.lit("draft_"), F.substring(_hash("drf:1", _line("source_id", source), _line("family", family)), 1, 16))


def text_draft_id(source: Column, family: Column) -> Column:
    return F.concat(F.lit("draft_"), F.substring(source, 1, 24), F.lit("_"), family)
