"""Train, validation and test splits that keep related records together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from typeloom.llm.graph import min_label_components
from typeloom.storage import Stage

HASH_DIGITS = 40
MIN_DIGITS = 6  # a shorter rest names no font
SPLITS = ("train", "val", "test")
PROPORTIONS = (0.8, 0.1, 0.1)
BUCKETS = 1024


def hex_of(col: Column) -> Column:
    """The lower-case hex digits of a font hash without scheme, extension, index, dashes and blanks; null if none remain.

    The result has 40 digits, or fewer (at least 6) where the hash was shortened. Anything else is null.
    """
    bare = F.regexp_replace(F.lower(F.regexp_replace(col, r"\s+", "")), r"^(?:[a-z]+[0-9]*[:/]+|sha-?[0-9]+[-_:]|font[-_:])+", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?:\.[a-z0-9]+|#[0-9]*|…|\.\.\.)+$", ""), r"-", "")
    return F.when(bare.rlike(f"^[0-9a-f]{{{MIN_DIGITS},{HASH_DIGITS}}}$"), bare)


def resolved(stage: Stage, records: DataFrame, fonts: DataFrame) -> DataFrame:
    """(record_id, glyph_id, font): font is the full hash of the font that the record names, or null.

    Shortened hashes are looked up among the fonts' hashes and the full ones of other records. One that fits no hash, or
    several, names none.
    """
    named = stage.keep(records.select("record_id", "glyph_id", "raster_filename", hex_of(F.col("font_hash")).alias("hex")), "named")
    is_full = F.length("hex") == HASH_DIGITS
    known = fonts.select(hex_of(F.col("file_hash")).alias("hex")).unionByName(named.select("hex")).filter(is_full).distinct()
    short = named.filter(F.length("hex") < HASH_DIGITS).select(F.col("hex").alias("short")).distinct()
    head = lambda c: F.substring(c, 1, MIN_DIGITS)
    fits = short.join(known, head("short") == head("hex")).filter(F.col("hex").startswith(F.col("short")))
    only = fits.groupBy("short").agg(F.min("hex").alias("full"), F.count("*").alias("n")).filter("n = 1").select("short", "full")
    return named.join(only, F.col("hex") == F.col("short"), "left").select(
        "record_id", "glyph_id", "raster_filename", F.when(is_full, F.col("hex")).otherwise(F.col("full")).alias("font")
    )


def groups(spark: SparkSession, records: DataFrame, fonts: DataFrame) -> DataFrame:
    """(record_id, raster_filename, group_id): what shares a font or a glyph, directly or over others, has one group_id.

    The graph is bipartite: records on one side, the fonts and glyphs that they name on the other. Records that name the
    same font and glyph are one node of it, so a record node is an edge between two entities, and a round of propagation
    takes the smallest label from entities over records to entities. Font hashes sort before the names of glyphs
    (``g:...``), so a group's label is its smallest font hash, or its smallest glyph where it names no font. A record that
    names neither is a group of its own (``r:<record_id>``). Record ids are taken to be unique; repeated rows stay.
    """
    stage = Stage(spark, "grouped-splits")
    rows = stage.keep(resolved(stage, records, fonts), "resolved")
    glyph = F.concat(F.lit("g:"), F.col("glyph_id").cast("string"))
    nodes = rows.select("record_id", "raster_filename", "font", glyph.alias("glyph"))
    entities = rows.select(F.col("font").alias("id")).unionByName(rows.select(glyph.alias("id")))
    labels = min_label_components(stage, nodes.select(F.col("font").alias("u"), F.col("glyph").alias("v")), entities)
    either = nodes.withColumn("id", F.coalesce("font", "glyph"))
    alone = F.concat(F.lit("r:"), F.col("record_id").cast("string"))
    return either.join(labels, "id", "left").select("record_id", "raster_filename", F.coalesce("label", alone).alias("group_id"))


def label_of(col: Column) -> Column:
    """The whole label in a raster's name: what stands before the id, trimmed, in lower case; ``none`` for null and unlabelled names."""
    label = F.lower(F.trim(F.regexp_extract(col, r"([^/\\\\]*)_[0-9]+\.[A-Za-z0-9]+\s*$", 1)))
    return F.when(label != "", label).otherwise("none")


def assign(
    spark: SparkSession, grouped: DataFrame, proportions: tuple[float, ...] = PROPORTIONS, seed: int = 0, splits: tuple[str, ...] = SPLITS
) -> DataFrame:
    """(record_id, group_id, split): whole groups, with the proportions kept within each label as well as groups allow.

    Groups are placed by size, from the largest power of two down, at most 63 times. What each split still lacks of each
    label, against its goal, is known when a size is reached; the groups of that size stand in a seeded random order within
    their commonest label and are cut by those lacks. So what larger groups did to a label, in whatever company, is made up
    for by smaller ones, and a label ends up off its goal by about the size of its smallest groups. All sizes and labels go
    the same way, however many there are: goals and lacks are tables by label, and the running sizes are sums in two steps,
    over buckets and within a bucket, so no label is gathered in one task. Only the sizes' powers go to the driver.
    """
    if abs(sum(proportions) - 1) > 1e-6 or min(proportions) < 0 or len(proportions) != len(splits):
        raise ValueError("proportions must sum to 1, one for each split")
    stage = Stage(spark, "split-assignment")
    rows = stage.keep(grouped.select("record_id", "group_id", label_of(F.col("raster_filename")).alias("label")), "rows")
    counts = stage.keep(rows.groupBy("group_id", "label").agg(F.count("*").alias("n")), "counts")
    totals = stage.keep(counts.groupBy("label").agg(F.sum("n").alias("total")), "totals")
    sizes = counts.groupBy("group_id").agg(F.sum("n").alias("size"), F.max_by("label", F.struct("n", "label")).alias("main"))
    sizes = stage.keep(sizes.withColumn("power", F.floor(F.log2("size")).cast("int")), "sizes")
    h = F.xxhash64("group_id", F.lit(seed))
    have = None  # (label, h0, h1, ...): what larger groups have brought to each split
    chosen = []
    for power in sorted((r["power"] for r in sizes.select("power").distinct().collect()), reverse=True):
        lacks = totals if have is None else totals.join(have, "label", "left")
        room = [F.greatest(F.lit(0.0), share * F.col("total") - (F.lit(0) if have is None else F.coalesce(f"h{i}", F.lit(0)))) for i, share in enumerate(proportions)]
        lacks = lacks.select(F.col("label").alias("main"), *[x.alias(f"r{i}") for i, x in enumerate(room)])
        some = sizes.filter(F.col("power") == power).withColumn("h", h).withColumn("bucket", F.pmod("h", F.lit(BUCKETS)))
        sums = some.groupBy("main", "bucket").agg(F.sum("size").alias("s"))
        ahead = F.sum("s").over(Window.partitionBy("main").orderBy("bucket")) - F.col("s")
        base = sums.select("main", "bucket", ahead.alias("before"), F.sum("s").over(Window.partitionBy("main")).alias("every")).join(lacks, "main")
        inner = Window.partitionBy("main", "bucket").orderBy("h", "group_id")
        spot = some.withColumn("run", F.sum("size").over(inner) - F.col("size")).join(base, ["main", "bucket"])
        middle = (F.col("before") + F.col("run") + F.col("size") / 2) / F.col("every")
        whole = sum((F.col(f"r{i}") for i in range(1, len(splits))), F.col("r0"))
        cut, upto = F.lit(len(splits) - 1), F.lit(0.0)
        edges = []
        for i, share in enumerate(proportions[:-1]):
            upto = upto + F.when(whole > 0, F.col(f"r{i}") / whole).otherwise(share)
            edges.append(upto)
        for i, edge in reversed(list(enumerate(edges))):
            cut = F.when(middle < edge, i).otherwise(cut)
        chosen.append(stage.keep(spot.select("group_id", cut.alias("nr")), f"power-{power}"))
        brought = counts.join(chosen[-1], "group_id").groupBy("label").agg(*[F.sum(F.when(F.col("nr") == i, F.col("n")).otherwise(0)).alias(f"h{i}") for i in range(len(splits))])
        if have is not None:
            brought = have.unionByName(brought).groupBy("label").agg(*[F.sum(f"h{i}").alias(f"h{i}") for i in range(len(splits))])
        before, have = have, stage.keep(brought, "have")
        stage.drop(before)
    if not chosen:
        return rows.select("record_id", "group_id", F.lit(splits[0]).alias("split")).limit(0)
    every = chosen[0]
    for more in chosen[1:]:
        every = every.unionByName(more)
    name = F.element_at(F.array(*[F.lit(x) for x in splits]), F.col("nr") + 1)
    return rows.join(every, "group_id").select("record_id", "group_id", name.alias("split"))


def split_checks(assigned: DataFrame, proportions: tuple[float, ...] = PROPORTIONS, splits: tuple[str, ...] = SPLITS) -> DataFrame:
    """(n_records, torn_groups, splits_off): records assigned, groups in more than one split, and splits that miss their share of
    the records by more than half the largest group, which can't be divided, and a thousandth."""
    of = assigned.groupBy("group_id").agg(F.count("*").alias("n"), F.count_distinct("split").alias("k"), *[F.count_if(F.col("split") == s).alias(f"n_{s}") for s in splits])
    off = sum((F.when(F.abs(F.sum(f"n_{s}") / F.sum("n") - p) > F.max("n") / F.sum("n") / 2 + 0.001, 1).otherwise(0) for s, p in zip(splits, proportions)), F.lit(0))
    return of.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_records"), F.count_if(F.col("k") > 1).alias("torn_groups"), off.cast("bigint").alias("splits_off"))
