"""Evaluation of predictions(truth, pred, ...) as plain aggregates: confusion counts, F1, accuracies and their breakdowns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from typeloom.operators.counts import bucket

ACCURACY_EDGES = (0.0, 0.1, 0.3, 0.5, 0.7, 0.9, 1.0)


def confusion(predictions: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """(t, p, n), sparse; rows without a truth or a prediction don't count."""
    known = predictions.filter(F.col(truth).isNotNull() & F.col(pred).isNotNull())
    return known.groupBy(F.col(truth).alias("t"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))


def class_scores(matrix: DataFrame) -> DataFrame:
    """(label, support, predicted, hits, precision, recall, f1) for every class that is true or predicted somewhere.

    Each confusion cell adds to the row of its true and to that of its predicted class, so one aggregation gives both
    margins without a join.
    """
    zero = F.lit(0).cast("bigint")
    as_true = F.struct(F.col("t").alias("label"), F.col("n").alias("s"), zero.alias("q"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(zero).alias("h"))
    as_pred = F.struct(F.col("p").alias("label"), zero.alias("s"), F.col("n").alias("q"), zero.alias("h"))
    sides = matrix.select(F.explode(F.array(as_true, as_pred)).alias("x")).select("x.*")
    sums = sides.groupBy("label").agg(F.sum("s").alias("support"), F.sum("q").alias("predicted"), F.sum("h").alias("hits"))
    sums = sums.withColumn("precision", F.col("hits") / F.greatest("predicted", F.lit(1))).withColumn("recall", F.col("hits") / F.greatest("support", F.lit(1)))
    return sums.withColumn("f1", 2 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-12)))


def macro_f1(scores: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """(macro_f1_all, macro_f1_seen): means over the classes with support, and those of them that ``seen(label)`` lists; 0 for none."""
    marked = scores.withColumn("__seen", F.lit(True)) if seen is None else scores.join(seen.select("label").distinct().withColumn("__seen", F.lit(True)), "label", "left")
    mean = lambda c: F.round(F.coalesce(F.avg(F.when(c, F.col("f1"))), F.lit(0.0)), 9)
    true = F.col("support") > 0
    return marked.agg(mean(true).alias("macro_f1_all"), mean(true & F.coalesce("__seen", F.lit(False))).alias("macro_f1_seen"))


def per_class(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, support, accuracy) for every label of the map; 0 without support."""
    joined = labels.select("label").join(scores, "label", "left")
    return joined.select("label", F.coalesce("support", F.lit(0)).alias("support"), F.round(F.coalesce("recall", F.lit(0.0)), 9).alias("accuracy"))


def accuracies(predictions: DataFrame, subset: Column, k: int = 5) -> DataFrame:
    """(n, top1, topk, mean_loss, subset_top1); topk looks for the truth among the first k of ``ranked``; no rows give nulls."""
    hit, among = (F.col("truth") == F.col("pred")).cast("double"), F.array_contains(F.slice("ranked", 1, k), F.col("truth")).cast("double")
    return predictions.agg(
        F.count("*").alias("n"), F.round(F.avg(hit), 9).alias("top1"), F.round(F.avg(among), 9).alias("topk"), F.round(F.avg("loss"), 9).alias("mean_loss"),
        F.round(F.avg(F.when(subset, hit)), 9).alias("subset_top1"),
    )


def bucket_accuracy(predictions: DataFrame, edges: tuple[int, ...]) -> DataFrame:
    """(bucket, n, accuracy) by how often the true class occurs; empty buckets are left out."""
    counts = predictions.groupBy("truth").agg(F.count("*").alias("n"), F.sum((F.col("truth") == F.col("pred")).cast("bigint")).alias("hits"))
    of = counts.withColumn("bucket", bucket(F.col("n"), edges)).groupBy("bucket")
    return of.agg(F.sum("n").alias("n"), F.round(F.sum("hits") / F.sum("n"), 9).alias("accuracy"))


def coverage(scores: DataFrame) -> DataFrame:
    """(bin, classes): classes with support by accuracy in fixed bins; bin -1 holds the classes with at least one hit."""
    true = scores.filter("support > 0")
    inside = F.lit(0)
    for i, edge in enumerate(ACCURACY_EDGES[1:-1], 1):
        inside = F.when(F.col("recall") >= edge, i).otherwise(inside)
    counts = true.agg(F.count_if(F.col("hits") > 0).alias("hit"), *[F.count_if(inside == i).alias(f"b{i}") for i in range(len(ACCURACY_EDGES) - 1)])
    rows = F.array(F.struct(F.lit(-1).alias("bin"), F.col("hit").alias("classes")), *[F.struct(F.lit(i).alias("bin"), F.col(f"b{i}").alias("classes")) for i in range(len(ACCURACY_EDGES) - 1)])
    return counts.select(F.explode(rows).alias("x")).select("x.bin", "x.classes")


def head_tail(scores: DataFrame, trained: DataFrame) -> DataFrame:
    """Mean accuracy and support of the classes that are commonest and rarest in training, and of the rare ones with a hit.

    ``trained(label, n)`` are the training frequencies; a tenth of the classes is head, a tenth tail. Classes without support
    don't count; those that training never saw are the rarest.
    """
    true = scores.filter("support > 0").join(trained.select("label", F.col("n").alias("seen")), "label", "left")
    order = Window.orderBy(F.desc(F.coalesce("seen", F.lit(0))), "label")  # one row a class
    ranked = true.withColumn("rank", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy()))
    decile = F.greatest(F.lit(1), F.floor(F.col("n") / 10))
    head, tail = F.col("rank") <= decile, F.col("rank") > F.col("n") - decile
    mean = lambda c, x: F.round(F.avg(F.when(c, F.col(x))), 9)
    return ranked.agg(
        mean(head, "recall").alias("head_accuracy"), mean(head, "support").alias("head_support"), mean(tail, "recall").alias("tail_accuracy"),
        mean(tail, "support").alias("tail_support"), mean(tail & (F.col("hits") > 0), "recall").alias("tail_hit_accuracy"),
    )


def confused_pairs(matrix: DataFrame, n: int) -> DataFrame:
    """(i, j, i_as_j, j_as_i, score): pairs i < j with mistakes both ways first; score = min(a, b) * (a + b)."""
    off = matrix.filter("t <> p").select(F.least("t", "p").alias("i"), F.greatest("t", "p").alias("j"), (F.col("t") < F.col("p")).alias("up"), "n")
    pairs = off.groupBy("i", "j").agg(F.sum(F.when(F.col("up"), F.col("n")).otherwise(0)).alias("i_as_j"), F.sum(F.when(~F.col("up"), F.col("n")).otherwise(0)).alias("j_as_i"))
    total = F.col("i_as_j") + F.col("j_as_i")
    return pairs.withColumn("score", F.least("i_as_j", "j_as_i") * total).orderBy(F.desc("score"), F.desc(total), "i", "j").limit(n)


def first_errors(predictions: DataFrame, key: str, n: int = 50) -> DataFrame:
    return predictions.filter("pred <> truth").orderBy(key).limit(n)


def agreement(scored: DataFrame) -> DataFrame:
    """(n, agreement, mean_confidence, override_rate) of predictions against an assignment and what was made of both."""
    share = lambda c: F.round(F.avg(c.cast("double")), 9)
    return scored.agg(
        F.count("*").alias("n"), share(F.col("pred") == F.col("assigned")).alias("agreement"), F.round(F.avg("conf"), 9).alias("mean_confidence"),
        share(F.col("merged") != F.col("assigned")).alias("override_rate"),
    )
