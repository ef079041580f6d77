"""Texts that were cut at a length limit or in transfer, and each source's share of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typeloom.storage import Stage, balanced

TOLERANCE = 3  # a limit in bytes never cuts a character, so up to three bytes are missing
MIN_AT_LIMIT = 3
SPIKE = 8.0  # times as many as lengths below the limit would lead one to expect
MIN_CLOSING_SHARE = 0.005  # of the texts without a sentence's end that end in the same short line
MIN_DOTS_SHARE = 0.03  # of the texts that end in dots that end in the same words
SHORT = 60
BLOCKS = tuple(2**i for i in range(6, 17))  # bytes that a transfer may move at once
CLEAR = 0.9  # of the most excess lengths that any block size explains

_DOTS = r"(?:…|\.{3,}|\[\s*(?:…|\.{3,})\s*\]|\(\s*(?:…|\.{3,})\s*\))"
_TAIL = r"(?:[\s\x{200b}\x{feff}]|<[^<>\n]{1,40}>|&[a-z]{2,8};)+$"
_END = r"[.!?。！？]['\"”’»)\]*_`]*$"
_FENCE = r"(?m)^[ \t]*(?:```|~~~)"


def features(documents: DataFrame, key: str, source: str, column: str) -> DataFrame:
    """One narrow row a text; whole texts are read once and none goes on.

    ``chars`` and ``bytes`` measure the text without dots that were put after a cut. ``end`` is ``sentence``, ``dots``,
    ``fence`` (a closed code block), ``open`` (an open one), ``row`` (a table row) or ``none``; ``line`` is the last line,
    or for dots the last sentence, digits folded to 0 and paths to one name, where it is short.
    """
    text, body, last = F.col(column), F.col("body"), F.col("last")
    # each step is its own projection: the optimizer doesn't merge those that would repeat costly expressions
    texts = balanced(documents.filter(text.isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(source).alias("source"), text.alias("text")))
    texts = texts.withColumn("body", F.regexp_replace("text", _TAIL, ""))
    texts = texts.withColumn("last", F.trim(F.substring_index("body", "\n", -1))).withColumn("marked", F.col("last").rlike(_DOTS + "$"))
    text, marked = F.col("text"), F.col("marked")
    core = F.when(marked, F.regexp_replace(F.regexp_replace(text, r"\s+$", ""), r"(?:\s\[\s*(?:…|\.{3,})\s*\]|" + _DOTS + ")$", "")).otherwise(text)
    # only up to SHORT characters are kept, so the last 4*SHORT of the line say all there is to say
    bare = F.regexp_replace(F.substring(last, -4 * SHORT, 4 * SHORT), r"\s*" + _DOTS + "$", "")
    words = F.trim(F.regexp_extract(bare, r"(?:^|[.!?]['\"”)]?\s+)([^.!?]*)$", 1))
    open_block = F.size(F.regexp_extract_all(body, F.lit(_FENCE), F.lit(0))) % 2 == 1
    end = (
        F.when(body == "", "sentence")
        .when(open_block, "open")
        .when(last.rlike(r"^(?:```|~~~)$"), "fence")
        .when(marked, "dots")
        .when(last.rlike(_END), "sentence")
        .when(last.rlike(r"^\|.*\|$"), "row")
        .otherwise("none")
    )
    rows = texts.select(
        "key", "source", F.length(core).alias("chars"), F.octet_length(core).alias("bytes"),
        end.alias("end"), F.when(marked, words).otherwise(last).alias("line"), F.xxhash64(text).alias("content"), body.contains("\n").alias("many"),
    )
    folded = F.regexp_replace(F.regexp_replace(F.col("line"), r"[\w.-]+/[\w./-]*\w", "PATH"), r"[0-9]+", "0")
    return rows.withColumn("line", F.when((F.length("line") <= SHORT) & F.col("end").isin("dots", "none"), folded))


def limits(rows: DataFrame) -> DataFrame:
    """(source, unit, at): the sources whose lengths have a spike at their maximum, in characters or in bytes.

    The spike is the number of lengths within ``TOLERANCE`` of the maximum (bytes) or at it (characters), against what
    the lengths of the upper half of the range would put there. Where both have one, bytes win if they have over a tenth
    more texts at their limit, as the tolerance alone adds a few.
    """
    unit = F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("n")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("n"))))
    lengths = rows.select("source", unit.alias("x")).select("source", "x.unit", "x.n").groupBy("source", "unit", "n").agg(F.count("*").alias("k"))
    top = lengths.groupBy("source", "unit").agg(F.max("n").alias("at"))
    slack = F.when(F.col("unit") == "bytes", TOLERANCE).otherwise(0)
    near = lengths.join(top.withColumnsRenamed({"source": "s", "unit": "u"}), F.col("source").eqNullSafe(F.col("s")) & (F.col("unit") == F.col("u")))
    spot = F.col("n") >= F.col("at") - slack
    upper = (F.col("n") >= F.col("at") / 2) & ~spot
    tested = near.groupBy("source", "unit", "at").agg(F.sum(F.when(spot, F.col("k")).otherwise(0)).alias("here"), F.sum(F.when(upper, F.col("k")).otherwise(0)).alias("below"))
    expected = F.col("below") / F.greatest(F.col("at") / 2, F.lit(1)) * (slack + 1)
    spikes = tested.filter((F.col("here") >= MIN_AT_LIMIT) & (F.col("here") >= SPIKE * expected))
    return spikes.groupBy("source").agg(F.max_by(F.struct("unit", "at"), F.col("here") * F.when(F.col("unit") == "chars", 1.1).otherwise(1.0)).alias("x")).select("source", "x.unit", "x.at")


def blocks(rows: DataFrame) -> DataFrame:
    """(source, block): the sources that were cut in transfer at whole blocks of bytes.

    For each block size the different texts whose length is a multiple of it are held against the number that chance would
    give. Of the sizes with a spike, the largest that explains nearly as many as any counts: multiples of 512 are multiples
    of 256 as well, and the other way round only half are.
    """
    texts = rows.filter("bytes > 0").groupBy("source", "content").agg(F.max("bytes").alias("bytes"))
    sums = texts.groupBy("source").agg(
        *[F.count_if(F.col("bytes") % b == 0).alias(f"k{b}") for b in BLOCKS], *[F.count_if(F.col("bytes") >= b).alias(f"n{b}") for b in BLOCKS]
    )
    one = F.explode(F.array(*[F.struct(F.lit(b).alias("block"), F.col(f"k{b}").alias("k"), (F.col(f"n{b}") / b).alias("chance")) for b in BLOCKS])).alias("x")
    spikes = sums.select("source", one).select("source", "x.*").filter((F.col("k") >= MIN_AT_LIMIT) & (F.col("k") >= SPIKE * F.col("chance")))
    excess = spikes.withColumn("excess", F.col("k") - F.col("chance"))
    best = excess.groupBy(F.col("source").alias("s")).agg(F.max("excess").alias("most"))
    clear = excess.join(best, F.col("source").eqNullSafe(F.col("s"))).filter(F.col("excess") >= CLEAR * F.col("most"))
    return clear.groupBy("source").agg(F.max("block").alias("block"))


def formulas(rows: DataFrame, end: str, share: float) -> DataFrame:
    """(line): short last lines (or last words before dots) that so many different texts end in, mostly away from limits.

    There are at most 1/share of them.
    """
    of = rows.filter((F.col("end") == end) & F.col("line").isNotNull() & (F.col("line") != ""))
    total = rows.filter(F.col("end") == end).select("content").distinct().count()
    counts = of.groupBy("line", "content").agg(F.bool_or("at_limit").alias("cut")).groupBy("line").agg(F.count("*").alias("n"), F.count_if("cut").alias("cut"))
    return counts.filter((F.col("n") >= 2) & (F.col("n") >= share * total) & (2 * F.col("cut") < F.col("n"))).select("line")


def truncated(spark: SparkSession, documents: DataFrame, key: str = "doc_id", source: str = "source", column: str = "text") -> DataFrame:
    """(key, source, at_limit, cut, kind, unit, at, block) for every text that isn't null.

    A text is cut if it ends without the end of a sentence, or inside a code block. Blanks and tags at the end don't
    matter, and dots only say something if they are a habit: texts that end in dots after words that many different texts
    end in are whole, as are those that end in a line that many end in (sign-offs, states, list entries, references), in a
    table row or a closed code block. Away from the source's limit a short sign-off, state or lower-case list entry is
    taken for whole even if it is seen once. At a limit, only the end of a sentence or a habitual line counts. A limit is a
    spike at the source's longest text (``unit``, ``at``) or at multiples of a ``block`` of bytes. ``kind`` says of a cut
    text whether its length is at a limit (``limit``) or not (``transfer``). Empty and blank texts are whole. A null source
    is a source of its own. Repeated rows each get a row. An empty table gives no rows.
    """
    stage = Stage(spark, "truncation")
    rows = stage.keep(features(documents, key, source, column), "features")
    found = stage.keep(limits(rows), "limits")
    moved = stage.keep(blocks(rows), "blocks")
    there = F.when(F.col("unit") == "chars", F.col("chars") >= F.col("at")).when(F.col("unit") == "bytes", F.col("bytes") >= F.col("at") - TOLERANCE)
    there = F.coalesce(there, F.lit(False)) | F.coalesce((F.col("bytes") > 0) & (F.col("bytes") % F.col("block") == 0), F.lit(False))
    joined = rows.join(found.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    joined = joined.join(moved.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    rows = stage.keep(joined.withColumn("at_limit", there), "placed")
    dots = formulas(rows, "dots", MIN_DOTS_SHARE).select(F.lit("dots").alias("e"), F.col("line").alias("l"))
    lines = formulas(rows, "none", MIN_CLOSING_SHARE).select(F.lit("none").alias("e"), F.col("line").alias("l"))
    habits = F.broadcast(dots.unionByName(lines).withColumn("habit", F.lit(True)))  # at most 1/MIN_DOTS_SHARE + 1/MIN_CLOSING_SHARE rows
    known = rows.join(habits, (F.col("end") == F.col("e")) & (F.col("line") == F.col("l")), "left")
    closing = F.col("line").rlike(r"^(?:(?:--|—|–) ?\S.{0,40}|[A-Z][a-z]+: [a-z ]{2,20}|[-*•] [a-z][^.!?]{0,40}|see PATH)$") & F.col("many")
    whole = (
        F.col("end").isin("sentence", "fence", "row")
        | F.coalesce("habit", F.lit(False))
        | ((F.col("end") == "none") & ~F.col("at_limit") & F.coalesce(closing, F.lit(False)))
    )
    kind = F.when(~whole, F.when(F.col("at_limit"), "limit").otherwise("transfer"))
    return known.select(F.col("key").alias(key), F.col("source").alias(source), "at_limit", (~whole).alias("cut"), kind.alias("kind"), "unit", "at", "block")


def report(found: DataFrame, source: str = "source") -> DataFrame:
    """(source, n_docs, n_cut, n_limit, n_transfer, share, unit, limit, block) for each source; unit, limit and block are null
    where lengths show no such spike."""
    return found.groupBy(source).agg(
        F.count("*").alias("n_docs"), F.count_if("cut").alias("n_cut"), F.count_if(F.col("kind") == "limit").alias("n_limit"), F.count_if(F.col("kind") == "transfer").alias("n_transfer"),
        F.round(F.avg(F.col("cut").cast("double")), 6).alias("share"), F.first("unit").alias("unit"), F.first("at").alias("limit"), F.first("block").alias("block"),
    )
