"""Pages read as words with boxes: text lines, type sizes, tinted bands and what they mark."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizloom.functions import quality
from quizloom.functions.tables import materialized
from quizloom.functions.text import collapse, strip

# Thresholds of the drawn-page reading.
LEAST_CONFIDENCE = 30.0
LEAST_LINE = 40.0
WIDGET_CHARACTERS = 2
WIDGET_CONFIDENCE = 92.0
ROW_STEP = 4
LEAST_TINT = 6.0
LEAST_BAND = 12
CLUSTER = 1.25
WORD_RUN = r"(?U)[^\W\d_]{3,}"


def text_lines(words: DataFrame, min_confidence: float = LEAST_CONFIDENCE) -> DataFrame:
    """Lines of recognised words (level 5 of a word table), ordered by top and left: doc_id, line_no, text, left, top,
    right, bottom, size (median height), confidence (mean), widget (does it open with a mark that was not read as a word) and
    rest (the text after its first word)."""
    kept = words.filter((F.col("level") == 5) & (F.trim("text") != "") & (F.col("conf") >= min_confidence))
    rows = kept.repartition("doc_id").groupBy("doc_id", "page_num", "block_num", "par_num", "line_num").agg(
        F.array_sort(F.collect_list(F.struct("left", "word_num", "text", "conf"))).alias("words"),
        F.min("left").alias("left"), F.min("top").alias("top"), F.max(F.col("left") + F.col("width")).alias("right"), F.max(F.col("top") + F.col("height")).alias("bottom"),
        F.expr("percentile(height, 0.5)").alias("size"), F.avg("conf").alias("confidence"),
    )
    order = Window.partitionBy("doc_id").orderBy("top", "left", "page_num", "block_num", "par_num", "line_num")
    first, joined = F.col("words")[0], lambda words: F.array_join(F.transform(words, lambda w: w["text"]), " ")
    widget = (F.length(first["text"]) <= WIDGET_CHARACTERS) & (first["conf"] < WIDGET_CONFIDENCE)
    rows = rows.withColumns({"line_no": F.row_number().over(order), "widget": widget, "text": joined(F.col("words")), "rest": joined(F.slice("words", 2, F.size("words")))})
    return rows.select("doc_id", "line_no", "text", "left", "top", "right", "bottom", "size", "confidence", "widget", "rest")


def is_content(confidence: Column, text: Column, least: float = LEAST_LINE) -> Column:
    """Readable, and with a run of letters: chrome is either unreadable or wordless."""
    return (confidence >= least) & text.rlike(WORD_RUN)


def size_clusters(lines: DataFrame) -> DataFrame:
    """doc_id, sizes (of type, largest first) and clusters (medians of runs of them, largest first) of each page. A size opens a
    cluster when the median of the current one is more than CLUSTER times larger, so sizes are taken in turn."""
    sizes = lines.filter("size > 0").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.col("size").cast("double")), asc=False).alias("sizes"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = []
            for values in batch.column("sizes").to_pylist():
                clusters: list[float] = []
                run: list[float] = []
                median = 0.0
                for v in [*values, None]:
                    if run and (v is None or median > v * CLUSTER):
                        clusters.append(median)
                        run = []
                    if v is not None:
                        run.append(v)  # descending, so the median is in the middle
                        n = len(run)
                        median = (run[(n - 1) // 2] + run[n // 2]) / 2
                pages.append(clusters)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("sizes"), pa.array(pages, pa.list_(pa.float64()))], names=["doc_id", "sizes", "clusters"])

    kind = lines.schema["doc_id"].dataType.simpleString()
    return sizes.mapInArrow(read, f"doc_id {kind}, sizes array<double>, clusters array<double>")


def role_sizes(lines: DataFrame) -> DataFrame:
    """doc_id, question_size and choice_size: of the two clusters that most lines are nearest to, the larger and the smaller;
    a page with one cluster has it twice."""
    nearest = lambda s: F.array_min(F.transform("clusters", lambda c: F.struct(F.abs(c - s).alias("gap"), (-c).alias("back"))))["back"]
    rows = size_clusters(lines).withColumn("near", F.transform("sizes", nearest))
    counts = F.transform("clusters", lambda c: F.struct(F.size(F.filter("near", lambda b: b == -c)).alias("n"), c.alias("c")))
    most = F.transform(F.slice(F.sort_array(F.filter(counts, lambda x: x["n"] > 0), asc=False), 1, 2), lambda x: x["c"])
    return rows.select("doc_id", most.alias("most")).select("doc_id", F.array_max("most").alias("question_size"), F.array_min("most").alias("choice_size"))


def column_edges(lines: DataFrame) -> DataFrame:
    """doc_id, left and right of the column that most lines stand in: the medians of their edges, in whole pixels."""
    edge = lambda c: F.expr(f"percentile({c}, 0.5)").cast("int").alias(c)
    return lines.groupBy("doc_id").agg(edge("left"), edge("right"))


def row_means(pixels: DataFrame, edges: DataFrame, step: int = ROW_STEP) -> DataFrame:
    """Mean colour of every `step`th row inside the column: doc_id, y, red, green, blue, height. pixels: doc_id, x, y, red,
    green, blue; the column is moved into the page, and is a pixel wide at least. Pixels that are dealt by doc_id stay where they
    are. No side is broadcast: how large pages are is not told by the size of what they are made from."""
    size = pixels.groupBy("doc_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    inside = edges.join(size.hint("shuffle_hash"), "doc_id").withColumn("left", F.greatest(F.lit(0), F.least("left", F.col("width") - 1)))
    inside = inside.withColumn("right", F.least(F.greatest(F.col("left") + 1, "right"), "width"))
    rows = pixels.filter(F.col("y") % step == 0).join(inside.hint("shuffle_hash"), "doc_id").filter("x >= left and x < right")
    return rows.groupBy("doc_id", "y").agg(*[F.avg(c).alias(c) for c in ("red", "green", "blue")], F.max("height").alias("height"))


def row_tint(red: Column, green: Column, blue: Column) -> tuple[Column, Column]:
    """How far the mean colour of a row leans to one channel, and which (the first of equals)."""
    total = red + green + blue
    leans = F.array(*[c - (total - c) / 2 for c in (red, green, blue)])
    return F.array_max(leans), (F.array_position(leans, F.array_max(leans)) - 1).cast("int")


def emphasis_bands(rows: DataFrame) -> DataFrame:
    """doc_id, top, bottom, channel of tinted runs, from sampled rows (doc_id, y, red, green, blue, height of the page).

    A change of channel ends a run, at the row that changes it; a run at the end of the page ends with the page.
    """
    amount, channel = row_tint(F.col("red"), F.col("green"), F.col("blue"))
    order = Window.partitionBy("doc_id").orderBy("y")
    told = rows.withColumn("lean", F.when(amount >= LEAST_TINT, channel).otherwise(-1))
    told = told.withColumn("opens", (F.coalesce(F.lag("lean").over(order), F.lit(-2)) != F.col("lean")).cast("int"))
    told = told.withColumn("run", F.sum("opens").over(order))
    runs = told.groupBy("doc_id", "run").agg(F.min("y").alias("top"), F.first("lean").alias("channel"), F.max("height").alias("height"))
    runs = runs.withColumn("bottom", F.coalesce(F.lead("top").over(Window.partitionBy("doc_id").orderBy("run")), F.col("height")))
    return runs.filter((F.col("channel") >= 0) & (F.col("bottom") - F.col("top") >= LEAST_BAND)).select("doc_id", "top", "bottom", "channel")


def _on(band_top: str, band_bottom: str, line_top: str, line_bottom: str) -> Column:
    centre = F.col(line_top) + (F.col(line_bottom) - F.col(line_top)) / 2
    return (F.col(band_top) <= centre) & (centre <= F.col(band_bottom))


def marking_bands(bands: DataFrame, options: DataFrame) -> DataFrame:
    """Bands that lie on an option and have the colour of most such bands; a tie of colours marks nothing."""
    lines = options.select("doc_id", F.col("top").alias("_top"), F.col("bottom").alias("_bottom"))
    on = bands.alias("b").join(lines.alias("l"), (F.col("b.doc_id") == F.col("l.doc_id")) & _on("b.top", "b.bottom", "_top", "_bottom"), "left_semi")
    page = Window.partitionBy("doc_id")
    told = on.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "channel"))).withColumn("most", F.max("n").over(page))
    alone = F.size(F.collect_set(F.when(F.col("n") == F.col("most"), F.col("channel"))).over(page)) == 1
    return told.withColumn("alone", alone).filter("alone and n = most").drop("n", "most", "alone")


def marked_lines(lines: DataFrame, marks: DataFrame) -> DataFrame:
    """lines with marked: is the centre of the line in a mark (of which a page has few)."""
    held = marks.groupBy("doc_id").agg(F.collect_list(F.struct("top", "bottom")).alias("_marks"))
    centre = F.col("top") + (F.col("bottom") - F.col("top")) / 2
    hit = F.exists("_marks", lambda m: (m["top"] <= centre) & (centre <= m["bottom"]))
    return lines.join(held, "doc_id", "left").withColumn("marked", F.coalesce(hit, F.lit(False))).drop("_marks")


def settled(options: DataFrame, keys: list[str]) -> DataFrame:
    """options with marked cleared in groups (by keys) that have more than half of their options marked; rows with a null there
    are no options."""
    group = Window.partitionBy(*keys)
    share = 2 * F.sum(F.col("marked").cast("int")).over(group) > F.count("marked").over(group)
    return options.withColumn("marked", F.col("marked") & ~share)


def drawn_roles(lines: DataFrame, roles: DataFrame) -> DataFrame:
    """lines with block_no and role: a line of question size (half-way up or larger) is a stem and closes a block that has
    options; much smaller lines are skipped; the first other line of a block, and any that opens with a widget, is an
    option, the rest continue it. A page with one size has no such order and gives nothing."""
    rows = lines.join(roles.filter("question_size > choice_size"), "doc_id").filter(F.col("size") >= 0.85 * F.col("choice_size"))
    order = Window.partitionBy("doc_id").orderBy("top", "left", "line_no")
    rows = rows.withColumn("stem", F.col("size") >= (F.col("question_size") + F.col("choice_size")) / 2)
    before = F.lag("stem").over(order)
    rows = rows.withColumn("opens", before.isNull() | (F.col("stem") & ~before)).withColumn("first", before.isNull() | before)
    rows = rows.withColumn("block_no", F.sum(F.col("opens").cast("int")).over(order))
    role = F.when(F.col("stem"), "stem").when(F.col("first") | F.col("widget"), "option").otherwise("wrap")
    return rows.withColumn("role", role).drop("stem", "opens", "first")


def reread(lines: DataFrame, readings: DataFrame) -> DataFrame:
    """lines with `better`: another reading of the same row (doc_id, top, reading) that reads better, without its widget."""
    one = readings.groupBy("doc_id", "top").agg(F.max("reading").alias("reading"))
    rows = lines.join(one, ["doc_id", "top"], "left")
    better = F.when(quality.reads_better(F.col("reading"), F.col("text")), quality.drop_leading_widget(strip(F.col("reading"))))
    return rows.withColumn("better", better).drop("reading")


def drawn_blocks(words: DataFrame, rows: DataFrame | None = None, readings: DataFrame | None = None) -> DataFrame:
    """Question blocks of pages told by type size, widgets and tinted rows; columns as segments.blocks() gives them.

    words: a word table; rows: mean colours as row_means() gives them; readings: marked rows read again. Lines that are not
    content, and pages without two sizes, give nothing. Marks that more than half of the options of a block have mean nothing.
    """
    lines = text_lines(words, 0.0)
    lines = materialized(lines.filter(is_content(F.col("confidence"), F.col("text"))), "drawn_lines")
    placed = materialized(drawn_roles(lines, role_sizes(lines)), "placed_lines")
    if rows is None:
        placed = placed.withColumn("marked", F.lit(False))
    else:
        choices = placed.filter("role != 'stem'").select("doc_id", "top", "bottom")
        placed = marked_lines(placed, marking_bands(emphasis_bands(rows), choices))
    placed = placed.withColumn("better", F.lit(None).cast("string")) if readings is None else reread(placed, readings.join(placed.filter("marked and role != 'stem'").select("doc_id", "top"), ["doc_id", "top"], "left_semi"))
    option = F.col("role") == "option"
    text = F.when(option & F.col("better").isNotNull(), F.col("better")).when(option & F.col("widget") & (F.col("rest") != ""), F.col("rest")).otherwise(F.col("text"))
    text = F.when(F.col("role") == "wrap", text).otherwise(strip(F.ltrim(text, F.lit("|:. "))))
    block = Window.partitionBy("doc_id", "block_no").orderBy("top", "left", "line_no")
    numbered = placed.withColumn("text", text).withColumn("option_no", F.sum(option.cast("int")).over(block))
    # the lines before the first option of a block are its stem
    parts = numbered.groupBy("doc_id", "block_no", "option_no").agg(
        F.array_sort(F.collect_list(F.struct("top", "left", "line_no", "text"))).alias("parts"), F.max(F.when(option, F.col("marked"))).alias("marked"),
        F.min("top").alias("line_start"), F.max("top").alias("line_end"),
    )
    joined = F.array_join(F.transform("parts", lambda p: p["text"]), " ")
    parts = settled(parts.withColumn("text", joined), ["doc_id", "block_no"])
    one = F.struct((F.col("option_no") - 1).cast("int").alias("pos"), strip(F.col("text")).alias("text"), F.lit(None).cast("string").alias("marker"), "marked")
    found = parts.groupBy("doc_id", "block_no").agg(
        F.max(F.when(F.col("option_no") == 0, F.col("text"))).alias("question"), F.array_sort(F.collect_list(F.when(F.col("option_no") > 0, one))).alias("options"),
        F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end"),
    )
    kind = "array<struct<pos:int,text:string,marker:string,marked:boolean>>"
    number = F.col("block_no").cast("int")
    question = collapse(F.coalesce("question", F.lit("")))
    return found.select("doc_id", number.alias("block_no"), number.alias("q_index"), question.alias("question"), F.col("options").cast(kind).alias("options"), F.lit(None).cast("array<string>").alias("inline_letters"), "line_start", "line_end")


def usable_blocks(blocks: DataFrame) -> DataFrame:
    """doc_id and usable: how many blocks can be answered, with a question and two options."""
    return blocks.groupBy("doc_id").agg(F.count_if((F.size("options") >= 2) & (F.col("question") != "")).alias("usable"))


def choose_reading(readings: DataFrame) -> DataFrame:
    """doc_id and the reading (text or drawn) with more usable blocks; a tie is for text. readings: doc_id, reading, usable."""
    return readings.groupBy("doc_id").agg(F.max_by("reading", F.struct("usable", (F.col("reading") == "text").cast("int"))).alias("reading"), F.max("usable").alias("usable"))


def best_pass(passes: DataFrame) -> DataFrame:
    """doc_id, psm and text of the recognition pass to keep: the first that was accepted, else the one with most words,
    the earlier of equals. passes: doc_id, attempt, psm, text, accepted."""
    n = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    order = F.struct(F.when(F.col("accepted"), 1).otherwise(0), F.when(F.col("accepted"), 0).otherwise(n), -F.col("attempt"))
    return passes.groupBy("doc_id").agg(F.max_by("psm", order).alias("psm"), F.max_by("text", order).alias("text"))
