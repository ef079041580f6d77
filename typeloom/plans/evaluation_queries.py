"""Predictions by nearest class mean, and everything that is asked of predictions, with SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typeloom.catalog import table
from typeloom.functions import text, vectors
from typeloom.operators import counts, evaluation, models, nearest
from typeloom.plans import grid_queries
from typeloom.storage import Stage

VOCABULARY, ITERATIONS = 1023, 200  # as in the reference
EDGES = (0, 40, 45, 50, 55, 60, 1_000_000)


def _labelled(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").filter("label IS NOT NULL")


def predictions(s: SparkSession, d: str) -> DataFrame:
    """(id, truth, pred, ranked, loss, d2): a classifier by class means, fitted on all labelled rows.

    A class's score is the negative squared distance to its mean; ``ranked`` holds the ten best classes, ties by the smaller
    one, ``loss`` is the cross-entropy of the true class. Rows without a label are scored too; their loss is null.
    """
    e = table(s, d, "embeddings")
    stage = Stage(s, "predictions")
    means = stage.keep(nearest.mean_vectors(_labelled(s, d), "label", "embedding"), "means")
    classes = F.lit([r["centroid_id"] for r in means.select("centroid_id").orderBy("centroid_id").collect()]).cast("array<int>")  # the classes
    scores = nearest.centroid_distances(e, "vec_id", "embedding", means).withColumn("scores", F.transform("d2", lambda x: -x))
    ranked = F.transform(vectors.top_k(F.col("scores"), 10), lambda x: F.get(classes, x["idx"].cast("int")))
    rows = e.select("vec_id", F.col("label").alias("truth")).join(scores, "vec_id")
    rows = rows.withColumn("ranked", ranked).withColumn("place", F.array_position(classes, F.col("truth").cast("int")))
    loss = F.when(F.col("place") > 0, vectors.cross_entropy(F.col("scores"), F.col("place") - 1))
    return rows.select(F.col("vec_id").alias("id"), "truth", F.col("ranked")[0].alias("pred"), "ranked", loss.alias("loss"), F.array_min("d2").alias("d2"))


def flagship(s: SparkSession, d: str) -> DataFrame:
    """Class means, nearest class, confusion counts, macro-F1: the pipeline in small."""
    return evaluation.macro_f1(evaluation.class_scores(evaluation.confusion(predictions(s, d))))


def confusion(s: SparkSession, d: str) -> DataFrame:
    return evaluation.confusion(predictions(s, d))


def line_confusion(s: SparkSession, d: str) -> DataFrame:
    return evaluation.confusion(table(s, d, "lineitem"), "l_returnflag", "l_linestatus")


def class_scores(s: SparkSession, d: str) -> DataFrame:
    r = lambda c: F.round(c, 9).alias(c)
    return evaluation.class_scores(evaluation.confusion(predictions(s, d))).select("label", "support", "predicted", "hits", r("precision"), r("recall"), r("f1"))


def macro_f1(s: SparkSession, d: str) -> DataFrame:
    """``seen`` are the classes of at least the mean size."""
    sizes = _labelled(s, d).groupBy("label").agg(F.count("*").alias("n"))
    seen = sizes.join(F.broadcast(sizes.agg(F.avg("n").alias("mean"))), F.col("n") >= F.col("mean")).select("label")  # the mean is one row
    return evaluation.macro_f1(evaluation.class_scores(evaluation.confusion(predictions(s, d))), seen)


def per_class_accuracy(s: SparkSession, d: str) -> DataFrame:
    labels = s.range(12).select(F.col("id").cast("int").alias("label"))
    return evaluation.per_class(evaluation.class_scores(evaluation.confusion(predictions(s, d))), labels)


def accuracies(s: SparkSession, d: str) -> DataFrame:
    """The subset are the rows of the first three classes."""
    return evaluation.accuracies(predictions(s, d), F.col("truth") < 3)


def bucket_accuracy(s: SparkSession, d: str) -> DataFrame:
    return evaluation.bucket_accuracy(predictions(s, d), EDGES)


def coverage_histogram(s: SparkSession, d: str) -> DataFrame:
    return evaluation.coverage(evaluation.class_scores(evaluation.confusion(predictions(s, d))))


def head_tail(s: SparkSession, d: str) -> DataFrame:
    trained = _labelled(s, d).groupBy("label").agg(F.count("*").alias("n"))
    return evaluation.head_tail(evaluation.class_scores(evaluation.confusion(predictions(s, d))), trained)


def _font_guess(s: SparkSession, d: str) -> DataFrame:
    """A wide confusion: what a sample's own label says against its glyph's label."""
    g = table(s, d, "glyphs").filter("label IS NOT NULL").groupBy("id").agg(F.min("label").alias("truth"))
    said = F.lower(F.trim("label"))
    return table(s, d, "cell_grids").filter("label IS NOT NULL").select(F.col("glyph_id").alias("id"), said.alias("pred")).join(g, "id")


def label_confusion(s: SparkSession, d: str) -> DataFrame:
    return evaluation.confusion(_font_guess(s, d))


def confused_pairs(s: SparkSession, d: str) -> DataFrame:
    pairs = table(s, d, "lineitem").select((F.col("l_partkey") % 40).alias("t"), ((F.col("l_partkey") + F.col("l_linenumber") * F.col("l_linenumber")) % 40).alias("p"))
    return evaluation.confused_pairs(evaluation.confusion(pairs, "t", "p"), 50)


def first_errors(s: SparkSession, d: str) -> DataFrame:
    return evaluation.first_errors(predictions(s, d).select("id", "truth", "pred"), "id")


def inference_summary(s: SparkSession, d: str) -> DataFrame:
    top = F.col("pred")
    status = text.match_status(F.col("truth"), top, F.slice("ranked", 1, 5)).alias("status")
    return predictions(s, d).select(status).groupBy("status").agg(F.count("*").alias("n"))


def model_agreement(s: SparkSession, d: str) -> DataFrame:
    p = predictions(s, d).select("id", "pred", F.col("truth").alias("assigned"), (1 / (1 + F.col("d2"))).alias("conf"))
    merged = p.join(grid_queries.hybrid_override(s, d).select(F.col("vec_id").alias("id"), "merged"), "id")
    return evaluation.agreement(merged)


def confidence_flags(s: SparkSession, d: str) -> DataFrame:
    top = vectors.top_k(vectors.softmax(F.transform("embedding", lambda x: x * 3)), 2)
    rows = table(s, d, "embeddings").select("vec_id", top.alias("t"))
    flags = text.confidence_flags(F.round(F.col("t")[0]["prob"], 9), F.round(F.col("t")[1]["prob"], 9))
    return rows.select("vec_id", F.array_join(flags, "+").alias("flags"))


def kmeans_vocabulary(s: SparkSession, d: str) -> DataFrame:
    """A vocabulary of 1,023 cell pictures and EMPTY; a mask weighs as many as its distinct cells."""
    masks = table(s, d, "cells").filter("mask <> 0 AND cell_id IS NOT NULL").select("cell_id", "mask").distinct().groupBy("mask").agg(F.count("*").alias("n"))
    return models.vocabulary(s, masks, "mask", VOCABULARY, seed=1, iterations=ITERATIONS, weight="n")


def mlp_predict(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    model = models.fit_classifier(e.filter("label IS NOT NULL"), "embedding", "label", 32, 10)
    from pyspark.ml.functions import array_to_vector

    scored = model.transform(e.select("vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("features")))
    return scored.select("vec_id", "label", F.col("prediction").cast("int").alias("pred"))


def class_support(s: SparkSession, d: str) -> DataFrame:
    return counts.class_weights(table(s, d, "embeddings"), "label", 1.0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        flagship, confusion, line_confusion, class_scores, macro_f1, per_class_accuracy, accuracies, bucket_accuracy, coverage_histogram, head_tail, label_confusion, confused_pairs, first_errors,
        inference_summary, model_agreement, confidence_flags, kmeans_vocabulary, mlp_predict, class_support,
    )
}

_P = f"""
    e AS ({grid_queries._VEC}), m AS ({grid_queries._MEANS}), far AS (SELECT vec_id, c, sum((e.x - m.x) * (e.x - m.x)) AS d2 FROM e JOIN m USING ("at") GROUP BY 1, 2),
    best AS (SELECT vec_id, min(d2) AS d2, list(c::INT ORDER BY d2, c)[1:10] AS ranked FROM far GROUP BY 1),
    soft AS (SELECT vec_id, ln(sum(exp(best.d2 - far.d2))) AS rest FROM far JOIN best USING (vec_id) GROUP BY 1),
    p AS (SELECT v.vec_id AS id, v.label AS truth, ranked[1] AS pred, ranked, far.d2 - best.d2 + rest AS loss, best.d2 AS d2
        FROM embeddings v JOIN best USING (vec_id) JOIN soft USING (vec_id) LEFT JOIN far ON far.vec_id = v.vec_id AND far.c = v.label),
    conf AS (SELECT truth AS t, pred AS p, count(*) AS n FROM p WHERE truth IS NOT NULL AND pred IS NOT NULL GROUP BY 1, 2),
    sums AS (SELECT label, sum(s)::BIGINT AS support, sum(q)::BIGINT AS predicted, sum(h)::BIGINT AS hits FROM (SELECT t AS label, n AS s, 0 AS q, CASE WHEN t = p THEN n ELSE 0 END AS h FROM conf UNION ALL SELECT p, 0, n, 0 FROM conf) GROUP BY 1),
    pr AS (SELECT *, hits::DOUBLE / greatest(predicted, 1) AS precision, hits::DOUBLE / greatest(support, 1) AS recall FROM sums),
    scores AS (SELECT *, 2 * precision * recall / greatest(precision + recall, 1e-12) AS f1 FROM pr)"""

ORACLE: dict[str, str] = {
    "flagship": f"WITH {_P} SELECT round(coalesce(avg(f1), 0), 9) AS macro_f1_all, round(coalesce(avg(f1), 0), 9) AS macro_f1_seen FROM scores WHERE support > 0",
    "confusion": f"WITH {_P} SELECT t, p, n FROM conf",
    "line_confusion": "SELECT l_returnflag AS t, l_linestatus AS p, count(*) AS n FROM lineitem GROUP BY 1, 2",
    "class_scores": f"WITH {_P} SELECT label, support, predicted, hits, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM scores",
    "macro_f1": f"""
    WITH {_P} SELECT round(coalesce(avg(f1), 0), 9) AS macro_f1_all, round(coalesce(avg(f1) FILTER (WHERE label IN (SELECT label FROM embeddings GROUP BY label HAVING count(*) >= (SELECT avg(n) FROM (SELECT count(*) AS n FROM embeddings WHERE label IS NOT NULL GROUP BY label)))), 0), 9) AS macro_f1_seen FROM scores WHERE support > 0""",
    "per_class_accuracy": f"WITH {_P} SELECT r.range::INT AS label, coalesce(support, 0) AS support, round(coalesce(recall, 0), 9) AS accuracy FROM range(12) r LEFT JOIN scores ON label = r.range",
    "accuracies": f"""
    WITH {_P} SELECT count(*) AS n, round(avg((truth = pred)::INT), 9) AS top1, round(avg(list_contains(ranked[1:5], truth)::INT), 9) AS topk, round(avg(loss), 9) AS mean_loss,
        round(avg((truth = pred)::INT) FILTER (WHERE truth < 3), 9) AS subset_top1 FROM p""",
    "bucket_accuracy": f"""
    WITH {_P}, c AS (SELECT truth, count(*) AS n, sum((truth = pred)::INT) AS h FROM p GROUP BY 1)
    SELECT CASE WHEN n < 40 THEN 0 WHEN n < 45 THEN 1 WHEN n < 50 THEN 2 WHEN n < 55 THEN 3 WHEN n < 60 THEN 4 ELSE 5 END AS bucket, sum(n)::BIGINT AS n, round(sum(h)::DOUBLE / sum(n), 9) AS accuracy FROM c GROUP BY 1""",
    "coverage_histogram": f"""
    WITH {_P}, b AS (SELECT CASE WHEN recall < 0.1 THEN 0 WHEN recall < 0.3 THEN 1 WHEN recall < 0.5 THEN 2 WHEN recall < 0.7 THEN 3 WHEN recall < 0.9 THEN 4 ELSE 5 END AS bin, hits FROM scores WHERE support > 0)
    SELECT r.range::INT AS bin, (SELECT count(*) FROM b WHERE (r.range >= 0 AND b.bin = r.range) OR (r.range = -1 AND hits > 0)) AS classes FROM range(-1, 6) r""",
    "head_tail": f"""
    WITH {_P}, r AS (SELECT *, row_number() OVER (ORDER BY support DESC, label) AS rk, count(*) OVER () AS n FROM scores WHERE support > 0), x AS (SELECT *, greatest(1, n // 10) AS d FROM r)
    SELECT round(avg(recall) FILTER (WHERE rk <= d), 9) AS head_accuracy, round(avg(support) FILTER (WHERE rk <= d), 9) AS head_support, round(avg(recall) FILTER (WHERE rk > n - d), 9) AS tail_accuracy,
        round(avg(support) FILTER (WHERE rk > n - d), 9) AS tail_support, round(avg(recall) FILTER (WHERE rk > n - d AND hits > 0), 9) AS tail_hit_accuracy FROM x""",
    "label_confusion": """
    SELECT g.truth AS t, lower(trim(c.label)) AS p, count(*) AS n FROM cell_grids c JOIN (SELECT id, min(label) AS truth FROM glyphs WHERE label IS NOT NULL GROUP BY id) g ON g.id = c.glyph_id WHERE c.label IS NOT NULL GROUP BY 1, 2""",
    "confused_pairs": """
    WITH c AS (SELECT l_partkey % 40 AS t, (l_partkey + l_linenumber * l_linenumber) % 40 AS p, count(*) AS n FROM lineitem GROUP BY 1, 2)
    SELECT least(t, p) AS i, greatest(t, p) AS j, sum(CASE WHEN t < p THEN n ELSE 0 END)::BIGINT AS i_as_j, sum(CASE WHEN t > p THEN n ELSE 0 END)::BIGINT AS j_as_i,
        (least(sum(CASE WHEN t < p THEN n ELSE 0 END), sum(CASE WHEN t > p THEN n ELSE 0 END)) * sum(n))::BIGINT AS score
    FROM c WHERE t <> p GROUP BY 1, 2 ORDER BY score DESC, sum(n) DESC, i, j LIMIT 50""",
    "first_errors": f"WITH {_P} SELECT id, truth, pred FROM p WHERE pred <> truth ORDER BY id LIMIT 50",
    "inference_summary": f"""
    WITH {_P} SELECT CASE WHEN truth IS NULL THEN NULL WHEN truth = pred THEN 'exact' WHEN list_contains(ranked[1:5], truth) THEN 'contained' ELSE 'miss' END AS status, count(*) AS n FROM p GROUP BY 1""",
    "model_agreement": f"""
    WITH {_P}, h AS ({grid_queries.ORACLE["hybrid_override"]})
    SELECT count(*) AS n, round(avg((pred = truth)::INT), 9) AS agreement, round(avg(1 / (1 + d2)), 9) AS mean_confidence, round(avg((merged <> truth)::INT), 9) AS override_rate FROM p JOIN h ON h.vec_id = p.id""",
    "confidence_flags": """
    WITH s AS (SELECT vec_id, list_reverse_sort(list_transform(embedding, lambda x: exp((x * 3)::DOUBLE - list_max(list_transform(embedding, lambda z: x - x + z * 3))::DOUBLE))) AS w FROM embeddings),
    p AS (SELECT vec_id, round(w[1] / list_sum(w), 9) AS a, round(w[2] / list_sum(w), 9) AS b FROM s)
    SELECT vec_id, concat_ws('+', CASE WHEN a >= 0.55 THEN 'OK' ELSE 'LOW_CONF' END, CASE WHEN a < 0.3 THEN 'VERY_LOW' END, CASE WHEN a - b < 0.05 THEN 'AMBIGUOUS' END) AS flags FROM p""",
    "class_support": "SELECT label, n, round(w / avg(w) OVER (), 9) AS weight FROM (SELECT label, n, sum(n) OVER () / (n + 1.0::DOUBLE) AS w FROM (SELECT label, count(*) AS n FROM embeddings WHERE label IS NOT NULL GROUP BY label))",
}
