"""Quiz texts as lines, answer keys, question blocks and options: windows over the ordered lines of each document.

Every window is partitioned by doc_id, so one exchange on doc_id serves all steps.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quizloom.functions import patterns as P
from quizloom.functions.text import answer_letters, let, squeezed, strip


def _doc() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("n")


def _so_far() -> WindowSpec:
    return _doc().rowsBetween(Window.unboundedPreceding, 0)


def _before() -> WindowSpec:
    return _doc().rowsBetween(Window.unboundedPreceding, -1)


def lines(docs: DataFrame, body: str = "body") -> DataFrame:
    """doc_id, n, raw (ends stripped), text, kind (option, numbered, text, blank), marker and marked of every line.

    A null body has no lines; an empty one has one blank line.
    """
    one = docs.select("doc_id", F.posexplode(F.split(body, r"\r?\n", -1)).alias("n", "_line")).withColumn("raw", strip(F.col("_line")))
    may = reduce(or_, [F.contains("raw", F.lit(c)) for c in P.MARK_CHARACTERS])
    one = one.withColumn("marked", may & F.col("raw").rlike(P.CORRECT_MARK)).withColumn("blank", F.col("raw") == "")
    markless = F.when(F.col("marked"), F.regexp_replace("raw", P.CORRECT_MARK, " ")).otherwise(F.col("raw"))
    one = one.withColumn("clean", squeezed(markless)).withColumn("clean", strip(F.col("clean")))
    # each pattern is tried once: the first of its parts is never empty where a line has it
    one = one.withColumn("option", F.regexp_extract("clean", P.OPTION, 1))
    one = one.withColumn("bullet", F.when(F.col("option") == "", F.regexp_extract("clean", P.BULLET, 1)).otherwise(""))
    one = one.withColumn("numbered", F.when((F.col("option") == "") & (F.col("bullet") == ""), F.regexp_extract("clean", P.NUMBERED, 1)).otherwise(""))
    is_option, is_bullet, is_number = (F.col(c) != "" for c in ("option", "bullet", "numbered"))
    kind = F.when(F.col("blank"), "blank").when(is_option | is_bullet, "option").when(is_number, "numbered").otherwise("text")
    marker = F.when(is_option, F.upper("option")).when(is_number, F.col("numbered"))
    said = F.when(is_option, F.regexp_extract("clean", P.OPTION, 2)).when(is_bullet, F.col("bullet")).when(is_number, F.regexp_extract("clean", P.NUMBERED, 2))
    one = one.withColumn("said", said)
    text = F.when(F.col("blank"), "").when(F.col("said").isNotNull(), strip(F.col("said"))).otherwise(F.col("clean"))
    return one.select("doc_id", "n", "raw", text.alias("text"), kind.alias("kind"), marker.alias("marker"), "marked")


def answer_key(parsed: DataFrame) -> DataFrame:
    """doc_id, q_index, letters and cut (the line the key begins at) of the first section that yields a key.

    A section is a heading with pairs on it, or a bare heading and the unbroken run of rows below. The last row wins for a
    number that comes twice.
    """
    rows = parsed.filter("raw != ''").select("doc_id", "n", "raw")
    heading = F.col("raw").rlike(P.KEY_HEADING)
    rest = strip(F.regexp_extract("raw", P.KEY_HEADING, 1))
    numbers, cells = F.regexp_extract_all(rest, F.lit(P.KEY_PAIR), F.lit(1)), F.regexp_extract_all(rest, F.lit(P.KEY_PAIR), F.lit(2))
    pairs = F.filter(F.transform(F.arrays_zip(numbers.alias("q"), cells.alias("c")), lambda p: F.struct(p["q"].cast("int").alias("q"), answer_letters(p["c"]).alias("letters"))), lambda p: F.size(p["letters"]) > 0)
    rows = rows.withColumn("heading", heading).withColumn("pairs", F.when(heading, pairs))
    bare = F.col("heading") & (rest == "")
    rows = rows.withColumn("cut", F.last(F.when(bare, F.col("n")), ignorenulls=True).over(_so_far()))
    # one pass over the lines serves both kinds: a heading with pairs outside of a section is in a run of its own, and not below
    rows = rows.withColumn("below", F.coalesce(F.col("n") > F.col("cut"), F.lit(False))).filter(F.col("below") | (F.size("pairs") > 0))
    is_row, is_number = F.col("raw").rlike(P.KEY_ROW), F.col("raw").rlike(P.KEY_NUMBER)
    section = Window.partitionBy("doc_id", "cut").orderBy("n")
    before = section.rowsBetween(Window.unboundedPreceding, -1)
    loose = answer_letters(F.col("raw"))
    told = rows.withColumn("what", F.when(is_row, "row").when(is_number, "number").when(F.size(loose) > 0, "letters").otherwise("other"))
    # letters count only right after a number that still waits for them
    told = told.withColumn("carried", F.when((F.col("what") == "letters") & (F.lag("what").over(section) == "number"), F.regexp_extract(F.lag("raw").over(section), P.KEY_NUMBER, 1).cast("int")))
    told = told.withColumn("ends", (F.col("what") == "other") | ((F.col("what") == "letters") & F.col("carried").isNull()))
    told = told.withColumn("ended", F.coalesce(F.max(F.col("ends").cast("int")).over(before), F.lit(0)))
    kept = F.expr("below and ended = 0 and not ends and what != 'number'")
    q = F.when(F.col("what") == "row", F.regexp_extract("raw", P.KEY_ROW, 1).cast("int")).otherwise(F.col("carried"))
    letters = F.when(F.col("what") == "row", answer_letters(F.regexp_extract("raw", P.KEY_ROW, 2))).otherwise(loose)
    entry = lambda cut, n, q, letters: F.struct(cut.alias("cut"), n.alias("n"), q.alias("q"), letters.alias("letters"))
    inline = F.transform("pairs", lambda p, i: entry(F.col("n"), i, p["q"], p["letters"]))
    below = F.when(kept, F.array(entry(F.col("cut"), F.col("n"), q, letters)))
    none = F.array().cast("array<struct<cut:int,n:int,q:int,letters:array<string>>>")
    every = told.select("doc_id", F.explode(F.concat(F.coalesce(inline, none), F.coalesce(below, none))).alias("e")).select("doc_id", "e.*").filter(F.size("letters") > 0)
    first = every.withColumn("first", F.min("cut").over(Window.partitionBy("doc_id"))).filter("cut = first")
    return first.groupBy("doc_id", F.col("q").alias("q_index")).agg(F.max_by("letters", "n").alias("letters"), F.min("cut").alias("cut"))


def placed_lines(parsed: DataFrame, key: DataFrame) -> DataFrame:
    """Non-blank lines before the key with block_no, q_index and role (stem, option, wrap, inline, none).

    A block opens at the first line, at a numbered line, at an option that starts the markers over, or at the text before
    such an option. Lines that state the answer open nothing and belong to nothing.
    """
    cut = key.groupBy("doc_id").agg(F.min("cut").alias("cut"))
    # keys are few beside lines, but grow with the documents: each task meets those of its own documents, none is broadcast
    rows = parsed.filter("kind != 'blank'").join(cut.hint("shuffle_hash"), "doc_id", "left").filter("cut is null or n < cut").drop("cut")
    may = reduce(or_, [F.contains(F.lower("raw"), F.lit(w)) for w in P.INLINE_WORDS])
    rows = rows.withColumn("says", may & F.col("raw").rlike(P.INLINE_ANSWER))
    # a line of a stretch or block is one from its first line on, so windows over the document, in one order, tell all of them
    at = lambda told: F.when(told, F.col("n"))
    option = (F.col("kind") == "option") & ~F.col("says")
    marked = F.when(option & F.col("marker").isNotNull(), F.struct("n", "marker"))
    rows = rows.withColumns({
        "first": F.row_number().over(_doc()) == 1,
        "opened": F.max(at((F.col("kind") == "numbered") & ~F.col("says"))).over(_so_far()),
        "held": F.last(marked, ignorenulls=True).over(_before()), "option_at": F.max(at(option)).over(_before()),
    })
    since = lambda n, begun: F.coalesce(n >= F.coalesce(begun, F.lit(0)), F.lit(False))
    restarts = (F.col("kind") == "option") & F.col("marker").isNotNull() & since(F.col("held.n"), F.col("opened")) & (F.col("marker") <= F.col("held.marker"))
    rows = rows.withColumn("restarts", F.coalesce(restarts, F.lit(False)))
    rows = rows.withColumn("inline", F.col("says") & ~F.col("first") & ~F.col("restarts"))
    rows = rows.withColumn("follows", (F.col("kind") == "text") & ~F.col("inline") & since(F.col("option_at"), F.col("opened")))
    rows = rows.withColumns({"restarts_below": F.lead("restarts", 1, False).over(_doc()), "follows_above": F.lag("follows", 1, False).over(_doc())})
    numbered = (F.col("kind") == "numbered") & ~F.col("inline")
    # the text before an option that starts over has opened its block
    rows = rows.withColumn("starts", F.col("first") | numbered | (F.col("restarts") & ~F.col("follows_above")) | (F.col("follows") & F.col("restarts_below")))
    rows = rows.withColumns({
        "block_no": F.sum(F.col("starts").cast("int")).over(_so_far()), "begun": F.max(at(F.col("starts"))).over(_so_far()),
        "option_at": F.max(at((F.col("kind") == "option") & ~F.col("inline"))).over(_before()),
    })
    optioned = since(F.col("option_at"), F.col("begun"))
    role = F.when(F.col("inline"), "inline").when(F.col("kind") == "option", "option").when(numbered, F.when(F.col("text") != "", "stem").otherwise("none"))
    return rows.withColumn("role", role.when(optioned & ~F.col("starts"), "wrap").otherwise("stem")).select("doc_id", "n", "raw", "text", "kind", "marker", "marked", "block_no", "starts", "role")


def blocks(placed: DataFrame) -> DataFrame:
    """doc_id, block_no, q_index, question, options (array of pos, text, marker, marked), inline_letters, line_start, line_end.

    Blocks with neither stem nor options are left out; they have still taken a number.
    """
    # options are numbered through the document: those of a block follow each other
    rows = placed.withColumn("option_no", F.when(F.col("role").isin("option", "wrap"), F.sum((F.col("role") == "option").cast("int")).over(_so_far())))
    option = F.struct("n", "option_no", "text", "marker", "marked")
    printed = F.when(F.col("starts") & (F.col("kind") == "numbered"), F.col("marker").cast("int"))
    found = rows.groupBy("doc_id", "block_no").agg(
        F.max(printed).alias("printed"),
        F.array_sort(F.collect_list(F.when(F.col("role") == "stem", F.struct("n", "text")))).alias("stems"),
        F.array_sort(F.collect_list(F.when(F.col("option_no").isNotNull(), option))).alias("parts"),
        F.max_by(F.when(F.col("role") == "inline", answer_letters(F.regexp_extract("raw", P.INLINE_ANSWER, 1))), F.when(F.col("role") == "inline", F.col("n"))).alias("inline_letters"),
        F.min("n").alias("line_start"),
        F.max("n").alias("line_end"),
    ).filter((F.size("stems") > 0) | (F.size("parts") > 0))
    # each step names its value more than once, so each is a column
    found = found.withColumn("question", F.array_join(F.transform("stems", lambda s: s["text"]), " ")).withColumn("question", squeezed(F.col("question")))
    question = strip(F.col("question"))
    found = found.withColumns({"first": F.get("parts", F.lit(0))["option_no"], "last": F.try_element_at("parts", F.lit(-1))["option_no"]})

    def merged(i: F.Column) -> F.Column:
        def one(own: F.Column) -> F.Column:
            text = let(F.array_join(F.transform(own, lambda p: p["text"]), " "), strip)
            return F.struct((i - F.col("first")).cast("int").alias("pos"), text.alias("text"), own[0]["marker"].alias("marker"), F.exists(own, lambda p: p["marked"]).alias("marked"))

        return let(F.filter("parts", lambda p: p["option_no"] == i), one)

    options = F.when(F.size("parts") > 0, F.transform(F.sequence("first", "last"), merged)).otherwise(F.array().cast("array<struct<pos:int,text:string,marker:string,marked:boolean>>"))
    index = F.coalesce(F.when(F.col("printed") != 0, F.col("printed")), F.col("block_no").cast("int"))
    return found.select("doc_id", F.col("block_no").cast("int").alias("block_no"), index.alias("q_index"), question.alias("question"), options.alias("options"), "inline_letters", "line_start", "line_end")
