"""Texts packed into containers of a fixed number of tokens.

Only the histogram of sizes, at most ``capacity`` numbers, is solved in one place. The solution is a list of patterns
("so many containers hold so many items of these sizes"), bounded by the capacity too and not by the number of texts; the
texts then find their seats by their rank among the texts of their size.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from typeloom.storage import Stage, balanced

CAPACITY = 2048
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"  # unless the session's spark.typeloom.tokenizer names another, on every executor
BUCKET_ROWS = 50_000

Pattern = tuple[dict[int, int], int]  # {size: items of that size in a container}, number of such containers


class _Sizes:
    """A multiset of sizes with the searches of the reduction; ``order`` holds the sizes that are left, rising."""

    def __init__(self, counts: dict[int, int]):
        self.n = {s: c for s, c in counts.items() if c > 0}
        self.order = sorted(self.n)

    def take(self, size: int, times: int) -> None:
        self.n[size] -= times
        if not self.n[size]:
            del self.n[size]
            self.order.remove(size)

    def largest(self, room: int, less: Counter) -> int | None:
        """The largest size of at most ``room`` of which an item is left when ``less`` are taken."""
        for size in reversed(self.order):
            if size <= room and self.n[size] > less[size]:
                return size
        return None

    def smallest(self, k: int, less: Counter) -> list[int]:
        out: list[int] = []
        for size in self.order:
            out += [size] * min(self.n[size] - less[size], k - len(out))
            if len(out) == k:
                break
        return out

    def best_two(self, room: int, less: Counter) -> tuple[int, int] | None:
        """The two items, larger first, with the largest sum of at most ``room``."""
        left = [s for s in self.order if self.n[s] > less[s]]
        best, i, j = None, 0, len(left) - 1
        while i <= j:
            a, b = left[j], left[i]
            if a + b > room or (i == j and self.n[a] - less[a] < 2):
                j -= 1
                continue
            if best is None or a + b > best[0] + best[1]:
                best = (a, b)
            i += 1
        return best


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Martello and Toth's reduction: fixed containers that dominate every other way to place their largest item, and the rest.

    Items are examined from the largest down: if nothing fits beside one, it stands alone; if only one more item can ever
    fit, or one fills the container, the largest fitting one joins it; if at most two can fit, the largest one joins it if
    it is at least as large as the best two together. Otherwise the item stays open, and may still be what joins a smaller
    one. Equal sizes are fixed together: the decision stays right while the stock of both lasts, for all else only gets
    scarcer. Each round ends the stock of a size or the examination of one, so there are at most two rounds a size.
    """
    sizes, fixed = _Sizes(counts), []
    below = capacity + 1  # sizes from here on have been examined
    while True:
        j = next((s for s in reversed(sizes.order) if s < below), None)
        if j is None:
            return fixed, dict(sizes.n)
        less, room = Counter({j: 1}), capacity - j
        few = sizes.smallest(3, less)
        fit = sum(1 for i in range(len(few)) if sum(few[: i + 1]) <= room)
        chosen: list[int] | None = None
        if fit == 0:
            chosen = [j]
        else:
            mate = sizes.largest(room, less)
            if fit == 1 or mate == room:
                chosen = [j, mate]
            elif fit == 2 and mate >= sum(sizes.best_two(room, less) or ()):
                chosen = [j, mate]
        if chosen is None:
            below = j
            continue
        need = Counter(chosen)
        times = min(sizes.n[s] // c for s, c in need.items())
        for s, c in need.items():
            sizes.take(s, c * times)
        fixed.append((dict(need), times))


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing over a histogram: items of a size go to the fullest containers that still hold one.

    Containers of equal content are one group. A size that doesn't fill all containers of a group splits it once, so the
    number of groups stays within a small multiple of the number of sizes.
    """
    groups: list[tuple[int, dict[int, int], int]] = []  # room, content, containers
    for size in sorted(counts, reverse=True):
        left = counts[size]
        groups.sort(key=lambda g: g[0])
        out: list[tuple[int, dict[int, int], int]] = []
        for room, content, many in groups:
            each = room // size
            if not left or not each:
                out.append((room, content, many))
                continue
            full = min(many, left // each)
            rest = left - full * each if full < many else 0
            add = lambda k, content=content: content | {size: content.get(size, 0) + k}
            if full:
                out.append((room - each * size, add(each), full))
            if rest:
                out.append((room - rest * size, add(rest), 1))
            if many - full - bool(rest):
                out.append((room, content, many - full - bool(rest)))
            left -= full * each + rest
        if left:
            each = capacity // size
            if left // each:
                out.append((capacity - each * size, {size: each}, left // each))
            if left % each:
                out.append((capacity - left % each * size, {size: left % each}, 1))
        groups = out
    return [(content, many) for _, content, many in groups]


def solve(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], int]:
    """Patterns that hold every item, and how many containers of them the reduction fixed."""
    fixed, rest = reduce_by_dominance(counts, capacity)
    return fixed + best_fit(rest, capacity), sum(n for _, n in fixed)


def token_counts(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) of whole texts; null and empty texts have none and are left out."""
    tokenizer = tokenizer or documents.sparkSession.conf.get("spark.typeloom.tokenizer", TOKENIZER)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(tokenizer)
        t.encode_special_tokens = True
        for batch in batches:
            texts, sizes = batch.column(1).to_pylist(), []
            for at in range(0, len(texts), 256):
                sizes += [len(x) for x in t.encode_batch_fast(texts[at : at + 256], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["doc_id", "n_tokens"])

    texts = documents.select("doc_id", "text").filter("text IS NOT NULL AND text <> ''")
    return balanced(texts).mapInArrow(count, "doc_id bigint, n_tokens bigint").filter("n_tokens > 0")


def packed(spark: SparkSession, items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, first_token, n_tokens, container_id) for ``items(doc_id, n_tokens)``.

    An item that exceeds the capacity is cut into full containers and a rest; the rest and every other item lie whole in
    one container. Items with null or no tokens take no room and are left out. Repeated rows are items of their own.
    Containers are numbered from 0 without gaps. An empty table gives no rows.
    """
    stage = Stage(spark, "packing")
    full = F.col("n_tokens") > capacity
    last = F.floor((F.col("n_tokens") - 1) / F.lit(capacity))
    piece = F.explode(F.when(full, F.sequence(F.lit(0).cast("bigint"), last)).otherwise(F.array(F.lit(0).cast("bigint"))))
    pieces = items.filter("n_tokens > 0").select("doc_id", "n_tokens", piece.alias("piece"))
    pieces = pieces.select("doc_id", "piece", (F.col("piece") * capacity).alias("first_token"), F.least(F.col("n_tokens") - F.col("piece") * capacity, F.lit(capacity)).alias("size"))
    pieces = stage.keep(pieces, "pieces")
    counts = {r["size"]: r["n"] for r in pieces.groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    patterns, _ = solve(counts, capacity)
    seats, taken, base = [], Counter(), 0
    for content, many in patterns:
        for size, each in content.items():
            seats.append((size, taken[size], taken[size] + each * many, each, base))
            taken[size] += each * many
        base += many
    assert taken == Counter(counts)
    table = spark.createDataFrame(seats, "size bigint, lo bigint, hi bigint, each bigint, base bigint")
    buckets = max(1, -(-max(counts.values(), default=1) // BUCKET_ROWS))
    mixed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    sums = mixed.groupBy("size", "bucket").agg(F.count("*").alias("n"))
    ahead = sums.select("size", "bucket", (F.sum("n").over(Window.partitionBy("size").orderBy("bucket")) - F.col("n")).alias("ahead"))
    inner = Window.partitionBy("size", "bucket").orderBy("doc_id", "piece")
    ranked = mixed.withColumn("rank", F.row_number().over(inner) - 1).join(ahead, ["size", "bucket"]).withColumn("rank", F.col("rank") + F.col("ahead"))
    # the seats are a few rows for each of at most `capacity` sizes
    at = ranked.join(F.broadcast(table), "size").filter((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    container = F.col("base") + F.floor((F.col("rank") - F.col("lo")) / F.col("each"))
    return at.select("doc_id", "piece", "first_token", F.col("size").alias("n_tokens"), container.alias("container_id"))


def summary(containers: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(n_containers, n_tokens, lower_bound, fill): ``lower_bound`` is what the tokens alone need."""
    used = containers.agg(F.count_distinct("container_id").alias("n_containers"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"))
    fill = F.round(F.try_divide(F.col("n_tokens"), F.col("n_containers") * capacity), 6)
    return used.select("n_containers", "n_tokens", F.ceil(F.col("n_tokens") / F.lit(capacity)).alias("lower_bound"), fill.alias("fill"))


def packing_checks(items: DataFrame, containers: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(n_docs, n_missing, overfull, torn, wasteful): documents packed, those whose tokens don't all stand in containers,
    containers beyond the capacity, documents within the capacity that were split, and whether a hundredth more containers
    than the tokens need were used."""
    per_doc = containers.groupBy("doc_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("pieces"))
    sized = items.groupBy("doc_id").agg(F.sum("n_tokens").alias("size")).join(per_doc, "doc_id", "left")
    docs = sized.agg(
        F.count("t").alias("n_docs"), F.count_if(~F.col("t").eqNullSafe(F.col("size"))).alias("n_missing"), F.count_if((F.col("pieces") > 1) & (F.col("size") <= capacity)).alias("torn"), F.sum("size").alias("all"),
    )
    used = containers.groupBy("container_id").agg(F.sum("n_tokens").alias("t")).agg(F.count("*").alias("k"), F.count_if(F.col("t") > capacity).alias("overfull"))
    return docs.crossJoin(used).select("n_docs", "n_missing", "overfull", "torn", (F.col("k") > 1.01 * F.ceil(F.col("all") / F.lit(capacity)) + 1).alias("wasteful"))  # one row each
