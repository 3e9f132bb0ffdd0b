"""Operator 13: fill-in-the-middle by a parallel automaton scan.

A text is read by an automaton of two states: in white space (or at the start), and in a word. A unit ends where a word meets
white space, and at the end of the text. Texts are cut into chunks of CHUNK bytes; what a chunk gives is a function of the
state it is entered in: the state it leaves in, and the boundaries it holds, for each entry state. Such functions compose
associatively, so the chunks of a giant document are scanned by many tasks at once, their functions are composed in order, and
only the chunks that hold a wanted boundary are looked into again. A text of one chunk is the same work without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from quizloom.llm.common import documents, raw_bytes

#: Bytes of a chunk. Longer texts go by chunks through the shuffle.
CHUNK = 1 << 16
#: Bytes of the texts of a batch that are scanned at a time: what numbers their positions takes many times as much.
PIECE = 1 << 20
SPM, PSM, PLAIN = "spm", "psm", "plain"
#: The marks of the output.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: States of the automaton.
BLANK, WORD = 0, 1
FUNCTION = "struct<ends:array<int>,counts:array<long>,chars:long>"

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, *range(9, 14)]] = True


def _scan(data: np.ndarray, at: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where units end, for rows data[at[k]:at[k + 1]] that are each entered in state entry[k]: positions of the white space
    after words, and the n + 1 offsets of the rows."""
    blank = _BLANK[data]
    ends = blank.copy()
    ends[1:] &= ~blank[:-1]
    full = at[:-1] < at[1:]
    first = at[:-1][full]
    ends[first] = blank[first] & (entry[full] == WORD)
    found = np.flatnonzero(ends)
    return found, np.searchsorted(found, at)


def _leads(data: np.ndarray) -> np.ndarray:
    """Code points that begin before each position, n + 1 of them."""
    out = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def chunk_function(chunk: pa.Array) -> pa.Array:
    """For each state a chunk is entered in: the state it is left in, and the ends of units in it; and its code points."""
    data, at = raw_bytes(chunk)
    full, leads = at[:-1] < at[1:], _leads(data)
    ends, counts = [], []
    for state in (BLANK, WORD):
        leaves = np.full(len(at) - 1, state)
        leaves[full] = np.where(_BLANK[data[at[1:][full] - 1]], BLANK, WORD)
        ends.append(leaves)
        counts.append(np.diff(_scan(data, at, np.full(len(at) - 1, state))[1]))
    rows = np.arange(0, 2 * len(at) - 1, 2, dtype=np.int32)
    pairs = [pa.ListArray.from_arrays(pa.array(rows), pa.array(np.stack(x, 1).ravel(), kind)) for x, kind in ((ends, pa.int32()), (counts, pa.int64()))]
    return pa.StructArray.from_arrays([*pairs, pa.array(np.diff(leads[at]))], ["ends", "counts", "chars"])


def chunk_boundaries(chunk: pa.Array, entry: pa.Array, wanted: pa.Array) -> pa.Array:
    """The code points before the wanted ends of units (from 1) in a chunk that is entered in the given state."""
    data, at = raw_bytes(chunk)
    found, first = _scan(data, at, entry.to_numpy(zero_copy_only=False))
    leads, out = _leads(data), []
    for k, ranks in enumerate(wanted.to_pylist()):
        out.append([int(leads[found[first[k] + r - 1]] - leads[at[k]]) for r in ranks])
    return pa.array(out, pa.list_(pa.int64()))


def cuts_of_texts(texts: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Units of whole texts of one chunk, and the code points before the ends of the chosen units."""
    for text, h1, h2 in texts:
        data, at = raw_bytes(text)
        hashes = np.stack([h.to_numpy(zero_copy_only=False) for h in (h1, h2)])
        done, low = [np.zeros((3, 0), np.int64)], 0
        while low < len(text):
            high = max(low + 1, int(np.searchsorted(at, at[low] + PIECE, "right")) - 1)
            done.append(_cuts(data[at[low] : at[high]], at[low : high + 1] - at[low], hashes[:, low:high]))
            low = high
        yield pa.StructArray.from_arrays([pa.array(x) for x in np.concatenate(done, axis=1)], ["n", "cut1", "cut2"])


def _cuts(data: np.ndarray, at: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Units of each row, and the code points before its two cuts."""
    found, first = _scan(data, at, np.zeros(len(at) - 1, np.int64))
    leads = _leads(data)
    n = np.diff(first) + (at[:-1] < at[1:])
    out = [n]
    for k in np.sort(hashes % (n + 1), axis=0):
        pick = np.clip(first[:-1] + k - 1, 0, max(0, len(found) - 1))
        end = np.where(k == n, at[1:], found[pick] if len(found) else 0)
        out.append(np.where(k == 0, 0, leads[end] - leads[at[:-1]]))
    return np.stack(out).astype(np.int64)


def composed(functions: pa.Array) -> pa.Array:
    """The chunk functions of each text, in order, composed: state, units ended and code points before each chunk and after the last."""
    out = []
    for row in functions.to_pylist():
        state, units, chars = BLANK, 0, 0
        states = [(state, units, chars)]
        for f in row:
            state, units, chars = f["ends"][state], units + f["counts"][state], chars + f["chars"]
            states.append((state, units, chars))
        out.append([dict(zip(("state", "units", "chars"), x, strict=True)) for x in states])
    return pa.array(out, pa.list_(pa.struct([("state", pa.int32()), ("units", pa.int64()), ("chars", pa.int64())])))


def _giant_cuts(rows: DataFrame) -> DataFrame:
    """_n, _c1 and _c2 of texts of more than one chunk, by _key. Each task holds one chunk at a time, and for each text at most
    2 GB / CHUNK functions of some 40 bytes."""
    raw = rows.select("_key", "_h1", "_h2", F.col("_text").cast("binary").alias("_raw")).dropDuplicates(["_key"])
    numbers = F.sequence(F.lit(0), F.ceil(F.octet_length("_raw") / CHUNK).cast("int") - 1)
    chunks = raw.select("_key", "_h1", "_h2", "_raw", F.explode(numbers).alias("_chunk"))
    chunks = chunks.select("_key", "_h1", "_h2", "_chunk", F.substring(F.col("_raw"), F.col("_chunk") * CHUNK + 1, F.lit(CHUNK)).alias("_bytes")).repartition("_key", "_chunk")
    scanned = chunks.select("_key", "_h1", "_h2", "_chunk", arrow_udf(chunk_function, FUNCTION)("_bytes").alias("f"))
    texts = scanned.groupBy("_key", "_h1", "_h2").agg(F.array_sort(F.collect_list(F.struct("_chunk", "f"))).alias("_fs")).select("_key", "_h1", "_h2", F.col("_fs.f").alias("_fs"))
    texts = texts.withColumn("_in", arrow_udf(composed, "array<struct<state:int,units:long,chars:long>>")("_fs")).withColumn("_all", F.element_at("_in", -1)).withColumn("_n", F.col("_all.units") + 1)
    picks = [F.col(h) % (F.col("_n") + 1) for h in ("_h1", "_h2")]
    texts = texts.select("_key", "_n", "_fs", "_in", F.least(*picks).alias("_k1"), F.greatest(*picks).alias("_k2"), F.col("_all.chars").alias("_chars"))
    entered = texts.select("_key", "_n", "_k1", "_k2", F.posexplode(F.arrays_zip(F.col("_fs.counts").alias("counts"), F.slice("_in", F.lit(1), F.size("_fs")).alias("state"))).alias("_chunk", "_x"))
    before = F.col("_x.state.units")
    held = F.get(F.col("_x.counts"), F.col("_x.state.state"))
    ranks = F.filter(F.array_distinct(F.array("_k1", "_k2")), lambda k: (k < F.col("_n")) & (k > before) & (k <= before + held))
    chosen = entered.select("_key", "_chunk", F.col("_x.state").alias("_in"), ranks.alias("_ranks")).filter(F.size("_ranks") > 0)
    local = chunks.select("_key", "_chunk", "_bytes").join(chosen, ["_key", "_chunk"])
    at = arrow_udf(chunk_boundaries, "array<long>")("_bytes", "_in.state", F.transform("_ranks", lambda k: k - F.col("_in.units")))
    places = local.select("_key", F.col("_in.chars").alias("_before"), F.arrays_zip("_ranks", at.alias("_at")).alias("_p")).select("_key", "_before", F.explode("_p").alias("_p"))
    ends = places.groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct(F.col("_p._ranks"), F.col("_before") + F.col("_p._at")))).alias("_ends"))
    out = texts.select("_key", "_n", "_k1", "_k2", "_chars").join(ends, "_key", "left")
    cut = lambda k: F.when(F.col(k) == 0, F.lit(0)).when(F.col(k) == F.col("_n"), F.col("_chars")).otherwise(F.try_element_at("_ends", F.col(k))).cast("long")
    return out.select("_key", "_n", cut("_k1").alias("_c1"), cut("_k2").alias("_c2"))


def restored(output: Column, form: Column) -> Column:
    """The text from output and form alone. A mark cannot arise where a part without marks meets one, so the first of each
    kind is the cut."""
    after = lambda x, at: F.substring(x, at + 3, F.length(x))
    between = lambda x, a, b: F.substring(x, a + 3, b - a - 3)
    p, s, m = (F.locate(k, output) for k in (PREFIX, SUFFIX, MIDDLE))
    psm = F.concat(between(output, p, s), after(output, m), between(output, s, m))
    spm = F.concat(between(output, p, m), after(output, m), between(output, s, p))
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)


def fill_in_middle(docs: DataFrame, rate: int = 50, spm_rate: int = 80, seed: str = "42") -> DataFrame:
    """docs with n (units), form, prefix_chars, middle_chars and output; columns of those names are replaced.

    rate: per cent of texts that are cut; spm_rate: per cent of those in which the suffix comes first. Both and the cuts hang
    on the hash of seed and doc_id alone. A null text counts as empty, and an empty text, or one with a mark in it, is plain;
    a null doc_id hashes as the empty string. Repeated rows give the same row each. No rows: none.
    """
    own = ["n", "form", "prefix_chars", "middle_chars", "output"]
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))), 256)
    part = lambda k: F.conv(F.substring(F.col("_hash"), 8 * k + 1, 8), 16, 10).cast("long")
    rows = docs.select(*[c for c in docs.columns if c not in own], text.alias("_text"), digest.alias("_hash")).select("*", *[part(k).alias(f"_h{k + 1}") for k in range(4)])
    small = rows.filter(F.octet_length("_text") <= CHUNK).withColumn("_cuts", arrow_udf(cuts_of_texts, "struct<n:long,cut1:long,cut2:long>")("_text", "_h1", "_h2"))
    small = small.select("*", F.col("_cuts.n").alias("_n"), F.col("_cuts.cut1").alias("_c1"), F.col("_cuts.cut2").alias("_c2")).drop("_cuts")
    giant = rows.filter(F.octet_length("_text") > CHUNK).withColumn("_key", F.concat_ws(":", "_hash", F.sha2("_text", 256)))
    cut = small.unionByName(giant.join(_giant_cuts(giant), "_key").drop("_key"))
    plain = (F.col("_n") == 0) | F.col("_text").contains(PREFIX) | F.col("_text").contains(SUFFIX) | F.col("_text").contains(MIDDLE) | (F.col("_h3") % 100 >= rate)
    cut = cut.withColumn("_form", F.when(plain, PLAIN).when(F.col("_h4") % 100 < spm_rate, SPM).otherwise(PSM))
    c1, c2 = F.col("_c1").cast("int"), F.col("_c2").cast("int")
    first, middle, rest = F.substring("_text", F.lit(1), c1), F.substring("_text", c1 + 1, c2 - c1), F.substring("_text", c2 + 1, F.octet_length("_text"))
    psm = F.concat(F.lit(PREFIX), first, F.lit(SUFFIX), rest, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), rest, F.lit(PREFIX), first, F.lit(MIDDLE), middle)
    moved = F.col("_form") != PLAIN
    return cut.select(
        *[c for c in docs.columns if c not in own], F.col("_n").alias("n"), F.col("_form").alias("form"), F.when(moved, F.col("_c1")).alias("prefix_chars"), F.when(moved, F.col("_c2") - F.col("_c1")).alias("middle_chars"),
        F.when(F.col("_form") == PSM, psm).when(F.col("_form") == SPM, spm).otherwise(F.col("_text")).alias("output"),
    )


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_in_middle(documents(spark, sf_dir).select("doc_id", "text"))
    return done.select(F.col("doc_id").cast("long").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
