"""Operator 7: information-theoretic sanitisation of personal data, with DataFrame functions only.

Fixed rules find protected values; each distinct value is an entity. From the whole corpus it is estimated how much each term
reveals an entity that it is met beside: their pointwise mutual information over distinct texts, with the lower bound of the
confidence interval in the place of the observed share, against the information of the entity. What is left of that is the
doubt of a reader who knows the term. Copies tell nothing new: a meeting counts once for the words around it. Terms that leave
too little doubt are spans as well, wherever they stand in any text: a text that has the term without the value gives the entity
away too. They are generalised, or removed if they leave next to none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quizloom.llm.common import documents, hot_join, stored

KINDS = ("email", "ip", "card", "phone")
TERM = "term"

# The base rules. Possessive groups and look-behinds only spare steps that cannot lead to another match.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){15,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}$"

#: Terms are runs of so many letters that don't run into an address; beside a value means within so many characters of it.
TOKEN = EMAIL + r"|\p{L}{3,}+(?![A-Za-z0-9._%+-]*+@)"
REACH = 48
#: Bits of doubt up to which a term is generalised (three meetings of three at least, in unlike words), and removed; and the
#: share of an entity's information that it must give.
GENERALISE = 1.25
REMOVE = 0.7
SHARE = 0.5
#: Half the width of the confidence interval, in standard deviations.
Z = 1.96
#: Terms are told by a broadcast if there are at most so many (some 60 bytes each), else through the shuffle.
MOST_TERMS = 100_000
#: Running sums go by chunks of so many values, as each step within one copies what the chunk has so far.
CHUNK = 256

SPAN = "array<struct<start:int,end:int,value:string>>"
INTS = "array<int>"


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each of an array of integers the combination (a sum, a maximum) of those up to it, from 0."""

    def scan(xs: Column) -> Column:
        begin = F.array(F.lit(0)).cast(INTS)
        return F.aggregate(xs, begin, lambda done, x: F.concat(done, F.array(combine(F.element_at(done, -1), x)).cast(INTS)))

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / CHUNK).cast("int")), lambda k: F.slice(scan(F.slice(values, k * CHUNK + 1, CHUNK)), 2, CHUNK))
    placed = lambda done: F.flatten(F.zip_with(done, scan(F.transform(done, lambda c: F.element_at(c, -1))), lambda c, before: F.transform(F.coalesce(c, F.array().cast(INTS)), lambda x: combine(before, x))))
    return F.when(F.size(values) > 0, _let(chunks, placed)).otherwise(F.array().cast(INTS))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def located(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches of a pattern in a text: start, end (code points) and value."""

    def placed(found: Column) -> Column:
        steps = F.zip_with(F.slice(found["gaps"], F.lit(1), F.size(found["values"])), found["values"], lambda gap, value: F.length(gap) + F.length(value))
        ends = running(steps, lambda a, b: a + b)
        return _let(ends, lambda ends: F.transform(found["values"], lambda v, i: F.struct((F.get(ends, i) - F.length(v)).alias("start"), F.get(ends, i).alias("end"), v.alias("value")))).cast(SPAN)

    return _let(F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values")), placed)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _none() -> Column:
    return F.array().cast(SPAN)


def base_spans(text: Column) -> list[Column]:
    """Spans of each kind in turn; a cheap test spares texts that cannot have any."""
    return [
        F.when(F.contains(text, F.lit("@")), located(text, EMAIL)).otherwise(_none()),
        F.when(text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), F.filter(located(text, IP), lambda s: s["value"].rlike(OCTETS))).otherwise(_none()),
        F.when(text.rlike(CARD), F.filter(located(text, CARD), lambda s: F.length(_digits(s["value"])).between(16, 19) & F.call_function("luhn_check", _digits(s["value"])))).otherwise(_none()),
        F.when(F.contains(text, F.lit("+")), F.filter(located(text, PHONE), lambda s: F.length(_digits(s["value"])).between(8, 15))).otherwise(_none()),
    ]


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, same (a hash of the text), spans (kind as a number, start, end, value), and the text of those that have any. Null
    text counts as empty."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({f"_{k}": found for k, found in zip(KINDS, base_spans(F.col("text")), strict=True)})

    def told(kind: int) -> Column:
        return F.transform(F.col(f"_{KINDS[kind]}"), lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))

    spans = F.concat(*[told(k) for k in range(len(KINDS))])
    rows = rows.select("doc_id", F.xxhash64("text").alias("same"), spans.alias("spans"), "text")
    return rows.withColumn("text", F.when(F.size("spans") > 0, F.col("text")))


def _words(texts: DataFrame) -> DataFrame:
    """same, term, start and end of the words of texts (same, text), but those inside addresses."""
    found = texts.select("same", F.explode(located(F.col("text"), TOKEN)).alias("w")).filter(~F.contains("w.value", F.lit("@")))
    return found.select("same", F.lower("w.value").alias("term"), "w.start", "w.end")


def _mentions(texts: DataFrame) -> DataFrame:
    """same, entity (kind and value, lower case), start and end of protected values."""
    one = texts.select("same", F.explode("spans").alias("s"))
    return one.select("same", F.concat(F.col("s.kind").cast("string"), F.lit(":"), F.lower("s.value")).alias("entity"), "s.start", "s.end")


def meetings(words: DataFrame, mentions: DataFrame) -> DataFrame:
    """term, entity and context of all words within REACH of a value, once for each context: the set of the words there. So
    copies of a text, and texts that are alike around the value, count once. Only what lies in neighbouring stretches of REACH
    characters is compared."""
    stretches = F.sequence(F.floor(F.greatest(F.col("start") - REACH, F.lit(0)) / REACH), F.floor((F.col("end") + REACH) / REACH))
    near = mentions.select("same", "entity", F.col("start").alias("m_start"), F.col("end").alias("m_end"), F.explode(stretches).alias("stretch"))
    found = words.withColumn("stretch", F.floor(F.col("start") / REACH)).join(near, ["same", "stretch"])
    found = found.filter((F.col("end") >= F.col("m_start") - REACH) & (F.col("start") <= F.col("m_end") + REACH))
    around = found.groupBy("same", "entity", "m_start").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    return around.select("entity", F.xxhash64("terms").alias("context"), F.explode("terms").alias("term")).distinct()


def lower_bound(hits: Column, of: Column) -> Column:
    """The lower end of the Wilson interval of a share."""
    p, z = hits / of, Z * Z
    return (p + z / (2 * of) - Z * F.sqrt((p * (1 - p) + z / (4 * of)) / of)) / (1 + z / of)


def _only(rows: DataFrame, terms: DataFrame, how: str = "inner", key: str = "term") -> DataFrame:
    """Rows joined with a stored table of one row for each key: by a broadcast if that is small, else through the shuffle."""
    return rows.join(F.broadcast(terms) if terms.count() <= MOST_TERMS else terms, key, how)


def _texts(docs: DataFrame) -> DataFrame:
    """same, text and weight of all rows: the copies of a text weigh one together."""
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("same", F.xxhash64("text"))
    copies = stored(rows.groupBy("same").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1"), "copies")
    return _only(rows, copies, "left", "same").select("same", "text", F.coalesce(1 / F.col("copies"), F.lit(1.0)).alias("weight"))


def _terms_of_texts(texts: DataFrame, *more: str) -> DataFrame:
    """The distinct words of every text, with other columns of it."""
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))
    return texts.select(*more, F.explode(words).alias("term")).filter(F.length("term") >= 3)


def disclosure(docs: DataFrame, met: DataFrame, mentions: DataFrame) -> DataFrame:
    """term, entity, doubt (bits that the term leaves of the entity) and share (of the entity's information that it gives away) of
    those beyond the thresholds, from counts over all distinct texts."""
    both = met.groupBy("term", "entity").agg(F.count(F.lit(1)).alias("_n"))
    enough = -F.log2(lower_bound(F.col("_n"), F.col("_n"))) <= GENERALISE  # were the term met nowhere else
    both = stored(both.filter(enough), "meetings")
    texts = _texts(docs)
    counts = _terms_of_texts(texts, "weight").groupBy("term").agg(F.round(F.sum("weight")).alias("n_term"))
    terms = counts.join(both.select("term").distinct(), "term")
    entities = mentions.select("same", "entity").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    n = float(round(texts.agg(F.sum("weight")).first()[0] or 0))
    found = both.join(terms, "term").join(entities, "entity")
    # a word beside an address may be counted as a part of it by one side and alone by the other
    doubt = -F.log2(lower_bound(F.col("_n"), F.greatest("n_term", "_n")))
    rows = found.select("term", "entity", doubt.alias("doubt"), F.greatest(F.log2(F.lit(n) / F.col("n_entity")), F.lit(1e-9)).alias("information"))
    return rows.withColumn("share", 1 - F.col("doubt") / F.col("information")).filter((F.col("doubt") <= GENERALISE) & (F.col("share") >= SHARE)).drop("information")


def _term_spans(docs: DataFrame, told: DataFrame) -> DataFrame:
    """same and terms (start, end, doubt) of every distinct text that has a disclosed term, whether a value stands there or not.
    told: term and doubt, a stored table."""
    texts = docs.filter("text is not null").select(F.xxhash64("text").alias("same"), "text")
    hits = stored(_only(_terms_of_texts(texts, "same"), told).select("same").distinct(), "hits")
    having = texts.join(hits, "same", "left_semi").dropDuplicates(["same"])
    return _only(_words(having), told).groupBy("same").agg(F.array_sort(F.collect_list(F.struct("start", "end", "doubt"))).alias("terms"))


def find_personal(docs: DataFrame) -> DataFrame:
    """Needs doc_id and text. Returns doc_id, same (a hash of the text), `base` spans (kind, start, end) and `terms` (start, end,
    doubt; null if none). Null and empty texts have none; repeated rows and null doc_ids are kept, and equal texts are one text
    in all counts."""
    scanned = stored(scan(docs), "personal")
    having = scanned.filter("text is not null").dropDuplicates(["same"])
    words, mentions = stored(_words(having), "words"), stored(_mentions(having), "mentions")
    met = stored(meetings(words, mentions), "met")
    told = stored(disclosure(docs, met, mentions).groupBy("term").agg(F.min("doubt").alias("doubt")), "disclosed")
    base = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    rows = scanned.select("doc_id", "same", base.alias("base"))
    if told.isEmpty():
        return rows.withColumn("terms", F.lit(None).cast("array<struct<start:int,end:int,doubt:double>>"))
    spans = stored(_term_spans(docs, told), "term-spans")
    many = rows.join(spans.select("same"), "same", "left_semi").groupBy("same").agg(F.count(F.lit(1)).alias("_n"))
    spans = stored(spans.join(many, "same"), "term-spans-of-rows")
    return hot_join(rows, spans, ["same"]).unionByName(rows.join(spans.select("same"), "same", "left_anti"), allowMissingColumns=True)


def sanitise(docs: DataFrame) -> DataFrame:
    """doc_id and text with protected values named by kind, and terms generalised to [TERM] or removed. Of spans that overlap
    the first gives the mark, and all they cover goes. Null text: empty. Rows with equal doc_id and text are changed alike."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = find_personal(texts)
    mark = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    cut = lambda s, mark: F.struct(s["start"].alias("start"), s["end"].alias("end"), mark.alias("mark"))
    cuts = F.concat(
        F.transform("base", lambda s: cut(s, F.get(mark, s["kind"]))),
        F.transform(F.coalesce("terms", F.array().cast("array<struct<start:int,end:int,doubt:double>>")), lambda s: cut(s, F.when(s["doubt"] <= REMOVE, "").otherwise("[TERM]"))),
    )
    marked = found.filter("size(base) > 0 or terms is not null").select(F.col("doc_id").alias("_doc"), F.col("same").alias("_same"), F.array_sort(cuts).alias("cuts")).dropDuplicates(["_doc", "_same"])
    rows = texts.join(marked, texts["doc_id"].eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_same")), "left")
    reached = running(F.transform("cuts", lambda c: c["end"]), lambda a, b: F.greatest(a, b))
    rows = rows.withColumns({"chars": F.when(F.col("cuts").isNotNull(), F.split("text", "")), "reached": F.when(F.col("cuts").isNotNull(), reached)})

    def piece(c: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(F.col("reached"), i - 1)).otherwise(0)
        gap = F.array_join(F.slice("chars", before + 1, F.greatest(c["start"] - before, F.lit(0))), "")
        return F.concat(gap, F.when(c["start"] >= before, c["mark"]).otherwise(""))

    end = F.element_at("reached", -1)
    tail = F.array_join(F.slice("chars", end + 1, F.size("chars")), "")
    done = F.concat(F.array_join(F.transform("cuts", piece), ""), tail)
    return rows.select("doc_id", F.coalesce(done, F.col("text")).alias("text"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal(documents(spark, sf_dir))
    names = F.array(*[F.lit(k) for k in KINDS])
    told = F.transform("base", lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")))
    terms = F.transform("terms", lambda s: F.concat_ws(":", F.lit(TERM), s["start"].cast("string"), s["end"].cast("string")))

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    counts = [count(k) for k in range(len(KINDS))]
    base = F.array_join(told, ",")
    every = F.array_join(F.concat(told, F.coalesce(terms, F.array().cast("array<string>"))), ",")
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), every.alias("spans"), F.coalesce(F.size("terms"), F.lit(0)).cast("long").alias("n_terms"))
