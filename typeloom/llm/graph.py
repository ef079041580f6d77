"""Connected components by minimum-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typeloom.storage import Stage

MAX_ROUNDS = 60


def min_label_components(stage: Stage, edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """(id, label) for every end of ``edges(u, v)`` and every id of ``vertices(id)``: the smallest id of its component.

    A round lets every vertex take the smallest label among its neighbours' labels, hooks the root of its old label to
    that label too, and then jumps one pointer. Labels are themselves vertices, so a chain of length d is done in about
    log d rounds. Aggregations combine before the shuffle; in the joins one side has a single row a key, so a vertex with
    a third of all edges is split by the adaptive skew join. Each round is written to the shared folder, and only a count
    of changes comes to the driver. Rows with a null end are no edges. An empty input gives no rows.
    """
    both = edges.filter("u IS NOT NULL AND v IS NOT NULL AND u <> v").select("u", "v")
    both = stage.keep(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    ids = both.select(F.col("u").alias("id"))
    # the first round needs no join: every vertex is its own label
    labels = both.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("m")).select("id", F.least("id", "m").alias("label"))
    if vertices is not None:
        alone = vertices.select("id").filter("id IS NOT NULL").distinct().join(ids.distinct(), "id", "left_anti")
        labels = labels.unionByName(alone.select("id", F.col("id").alias("label")))
    labels = stage.keep(labels, "labels")
    for _ in range(MAX_ROUNDS):
        around = both.join(labels.select(F.col("id").alias("v"), F.col("label").alias("lv")), "v")
        least = around.groupBy(F.col("u").alias("id")).agg(F.min("lv").alias("m"))
        own = labels.join(least, "id", "left").select("id", "label", F.coalesce(F.least("m", "label"), "label").alias("m"))
        own = stage.keep(own, "own")
        # hooks: what a vertex found holds for the root it hung from as well
        hooks = own.filter("m < label").select(F.col("label").alias("id"), F.lit(None).alias("label"), "m")
        moved = own.unionByName(hooks).groupBy("id").agg(F.min("m").alias("m"), F.min("label").alias("old"))
        jump = moved.select(F.col("id").alias("m"), F.col("m").alias("mm"))
        found = F.least("m", F.coalesce("mm", "m"))
        new = stage.keep(moved.join(jump, "m", "left").select("id", found.alias("label"), (found != F.col("old")).alias("changed")), "labels")
        stage.drop(labels)
        stage.drop(own)
        labels = new.select("id", "label")
        labels._typeloom_path = new._typeloom_path
        if not new.filter("changed").limit(1).count():
            return labels
    raise RuntimeError(f"components not settled after {MAX_ROUNDS} rounds")
