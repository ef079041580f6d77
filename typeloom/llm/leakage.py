"""Evaluation passages inside corpus texts: a prefix-filtered set join, verified over item-sized windows.

Half of an item's words are enough and any single word may be edited, so the only shingles that are sure to survive are
single words; shingles here are words, ordered by the number of documents they occur in. For an item of m words of which
t = ceil(m/2) must be found, any window that holds t of them holds at least l of its m-t+l rarest.

1. The corpus is turned into word codes once, over the vocabulary of all items, and kept.
2. Items go into shards of a bounded number of words, each written to the shared folder. A task holds a block of its
   documents and joins it with one shard after the other; neither the corpus nor the shards are shuffled or broadcast.
   A document is a row of overlapping blocks as long as an item's windows. Blocks are joined with items on the necessary
   prefix words (at least l of them in a block, a product of two incidence matrices), then held against the length
   bound (t of all words) and against the item's order in the block.
3. What is left is joined with the items and verified: the longest common subsequence of the item and each item-sized window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typeloom.llm.words import words
from typeloom.storage import Stage, balanced, open_shared

SHARE = 0.5  # of the item's words
STRETCH = 2  # window length by item length
SHARD_WORDS = 16_384  # of items that a task joins with at a time
GROUP_ITEMS = 256  # of like size within a shard
BLOCK_WORDS = 1_000_000  # of documents that a task holds; one document may be longer
_ENTRIES = 1 << 24  # of a matrix
_SIZE_STEP = 1.25
_PARTS = 8  # of an item, for the positional bound


def _slack(m: int) -> int:
    """The step between windows. A window of STRETCH*m words lies in one of STRETCH*m + slack words at a multiple of it."""
    return max(1, m // 8)


class Matcher:
    """One item's words as bit masks: a row for each distinct word and one for all others, 64 places to a lane."""

    def __init__(self, codes: np.ndarray):
        self.size, self.need = len(codes), int(np.ceil(SHARE * len(codes) - 1e-9))
        self.words, row = np.unique(codes, return_inverse=True)
        self.masks = np.zeros((len(self.words) + 1, -(-self.size // 64)), np.uint64)
        place = np.arange(self.size)
        np.bitwise_or.at(self.masks, (row, place // 64), np.uint64(1) << (place % 64).astype(np.uint64))

    def rows(self, codes: np.ndarray) -> np.ndarray:
        """The mask row of each code; the last one for words that the item lacks."""
        spot = np.minimum(np.searchsorted(self.words, codes), len(self.words) - 1)
        return np.where(self.words[spot] == codes, spot, len(self.words))

    def common(self, spot: np.ndarray) -> np.ndarray:
        """The longest common subsequence of the item and each line of mask rows, in bit-parallel steps."""
        known = spot < len(self.words)
        count = known.sum(axis=1)
        order = np.argsort(-count, kind="stable")
        # words that the item lacks change nothing; the others move together
        line, at = np.nonzero(known[order])
        packed = np.full((len(spot), int(count.max(initial=0))), len(self.words), np.int32)
        packed[line, np.arange(len(line)) - np.repeat(np.cumsum(count[order]) - count[order], count[order])] = spot[order][line, at]
        lanes = self.masks.shape[1]
        v = np.full((lanes, len(spot)), ~np.uint64(0), np.uint64)
        live = np.searchsorted(-count[order], -np.arange(packed.shape[1]), side="left")
        for step in range(packed.shape[1]):
            n = live[step]
            m = self.masks[packed[:n, step]]
            carry = np.zeros(n, np.uint64)
            for lane in range(lanes):
                old, mine = v[lane, :n], m[:, lane]
                hit = old & mine
                s = old + hit
                s2 = s + carry if lane else s
                if lane + 1 < lanes:
                    carry = ((s < old) | (s2 < s)).astype(np.uint64)
                v[lane, :n] = s2 | (old & ~mine)
        left = self.size - 64 * np.arange(lanes)
        within = np.array([2 ** min(64, int(x)) - 1 for x in left], np.uint64)
        out = np.empty(len(spot), np.int64)
        out[order] = np.bitwise_count(~v & within[:, None]).sum(axis=0, dtype=np.int64)
        return out

    def found(self, blocks: np.ndarray, begin: np.ndarray, hop: int) -> np.ndarray:
        """Whether a window that starts in the first ``hop`` places of a block, at a multiple of the slack, holds the item."""
        slack = _slack(self.size)
        long = STRETCH * self.size + slack
        blocks = self.rows(blocks)
        ok = np.zeros(len(blocks), bool)
        shift = -begin % slack
        while (open_ := ~ok & (shift < hop)).any():
            at = np.nonzero(open_)[0]
            cut = np.minimum(shift[at][:, None] + np.arange(long), blocks.shape[1] - 1)
            rows = np.where(shift[at][:, None] + np.arange(long) < blocks.shape[1], np.take_along_axis(blocks[at], cut, 1), len(self.words))
            ok[at] = self.common(rows) >= self.need
            shift = shift + slack
        return ok


class Group:
    """Items of like size, ready for the join with blocks."""

    def __init__(self, ids: np.ndarray, codes: list[np.ndarray], dfs: list[np.ndarray]):
        self.ids, self.items = ids, [Matcher(x) for x in codes]
        size = np.array([len(x) for x in codes])
        self.hop = max(1, int(size.max()) // 2)
        self.length = self.hop + STRETCH * int(size.max()) + _slack(int(size.max()))
        self.cells = -(-self.length // self.hop)
        self.need = np.array([x.need for x in self.items])
        self.few = -(-self.need // 2)
        self.words = np.unique(np.concatenate(codes))
        self.prefix, self.whole = np.zeros((2, len(ids), len(self.words)), np.float32)
        self.parts = np.zeros((_PARTS, len(ids), len(self.words)), np.float32)
        self.row = np.empty((len(ids), len(self.words) + 1), np.int32)  # of an item's masks
        for k, (x, df) in enumerate(zip(codes, dfs)):
            spot = np.searchsorted(self.words, x)
            np.add.at(self.whole[k], spot, 1)
            np.add.at(self.parts, (np.arange(size[k]) * _PARTS // size[k], k, spot), 1)
            rarest = np.lexsort((x, df))[: size[k] - self.need[k] + self.few[k]]
            np.add.at(self.prefix[k], spot[rarest], 1)
            self.row[k] = self.items[k].rows(np.append(self.words, -2))

    def search(self, codes: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
        """(documents, item's number, begins, blocks) that pass the prefix, the length, the positional and the order bound.

        A document is cut into cells of ``hop`` words; a block is ``cells`` of them, and begins at each. The positional bound:
        words that stand in the item's order lead, by parts of the item and cells of the block, along a path that only goes
        on in either; they are no more than the item's words in the parts and cells of the best such path.
        """
        sizes = np.diff(bounds)
        count = -(-sizes // self.hop)
        padded = count + self.cells - 1  # so that a block never reaches into the next document
        base = np.cumsum(padded) - padded
        doc = np.repeat(np.arange(len(sizes)), sizes)
        spot = np.minimum(np.searchsorted(self.words, codes), len(self.words) - 1)
        spot = np.where(self.words[spot] == codes, spot, len(self.words))
        known = np.nonzero(spot < len(self.words))[0]
        cell = base[doc[known]] + (known - bounds[doc[known]]) // self.hop
        cell_doc = np.repeat(np.arange(len(sizes)), padded)
        begin = (np.arange(len(cell_doc)) - base[cell_doc]) * self.hop
        step = max(self.cells, _ENTRIES // (len(self.words) + _PARTS * len(self.ids)))
        for r in range(0, len(cell_doc), step):
            n = min(step, len(cell_doc) - r)
            a, b = np.searchsorted(cell, (r, r + n + self.cells - 1))
            there = np.zeros((n + self.cells - 1, len(self.words)), np.float32)
            there[cell[a:b] - r, spot[known[a:b]]] = 1
            block = there[:n].copy()
            for j in range(1, self.cells):
                np.maximum(block, there[j : n + j], out=block)
            # float32 counts are exact up to 2^24 words
            passed = (block @ self.prefix.T >= self.few) & (begin[r : r + n] < sizes[cell_doc[r : r + n]])[:, None]
            passed &= block @ self.whole.T >= self.need
            at, item = np.nonzero(passed)
            counts = np.stack([there @ part.T for part in self.parts])
            best = np.zeros((_PARTS, len(at)), np.float32)
            for c in range(self.cells):
                for q in range(_PARTS):
                    best[q] = counts[q, at + c, item] + (np.maximum(best[q], best[q - 1]) if q else best[q])
            ok = best[-1] >= self.need[item]
            at, item = at[ok], item[ok]
            order = np.argsort(item, kind="stable")
            at, item = r + at[order], item[order]
            for k in np.unique(item):
                some = at[np.searchsorted(item, k) : np.searchsorted(item, k, side="right")]
                for part in np.array_split(some, -(-len(some) * self.length // _ENTRIES)):
                    place = (bounds[cell_doc[part]] + begin[part])[:, None] + np.arange(self.length)
                    inside = place < bounds[cell_doc[part] + 1][:, None]
                    place = np.minimum(place, len(codes) - 1)
                    good = self.items[k].common(self.row[k][np.where(inside, spot[place], len(self.words))]) >= self.need[k]
                    if good.any():
                        yield cell_doc[part[good]], int(k), begin[part[good]], np.where(inside[good], codes[place[good]], -1)


def groups_of(rows: pa.Table) -> list[Group]:
    ids = rows["item_id"].to_numpy()
    codes, dfs = ([np.array(x) for x in rows[name].to_pylist()] for name in ("codes", "dfs"))
    kind = np.array([int(np.ceil(np.log(len(x)) / np.log(_SIZE_STEP) - 1e-9)) for x in codes])
    out = []
    for c in np.unique(kind):
        of = np.nonzero(kind == c)[0]
        for at in range(0, len(of), GROUP_ITEMS):
            part = of[at : at + GROUP_ITEMS]
            out.append(Group(ids[part], [codes[i] for i in part], [dfs[i] for i in part]))
    return out


def word_lists(texts: DataFrame, key: str) -> DataFrame:
    """(key, words array<bigint>): 64-bit names of the words of each text that has any, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [words(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), _named(lists)], [key, "words"])

    return texts.select(F.col(key).cast("bigint").alias(key), "text").mapInArrow(run, f"`{key}` bigint, words array<bigint>").filter(F.size("words") > 0)


def _named(lists: list[list[str]]) -> pa.Array:
    flat = pa.array([w for x in lists for w in x], pa.string()).dictionary_encode()
    names = np.array([int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little", signed=True) for w in flat.dictionary.to_pylist()], np.int64)
    values = names[flat.indices.to_numpy()] if len(names) else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lists)]), pa.int32()), pa.array(values))


def _coded(lists: DataFrame, key: str, path: str) -> DataFrame:
    """(key, codes array<int>): places in the sorted vocabulary at ``path``; -1 for the words of no item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = open_shared(path)
        held = np.sort(rows["w"].to_numpy()) if rows is not None and rows.num_rows else np.zeros(1, np.int64)
        for batch in batches:
            names = batch.column(1).flatten().to_numpy()
            at = np.minimum(np.searchsorted(held, names), len(held) - 1)
            codes = np.where(held[at] == names, at, -1).astype(np.int32)
            offsets = batch.column(1).offsets.to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets - offsets[0]), pa.array(codes))], [key, "codes"])

    return lists.mapInArrow(run, f"`{key}` bigint, codes array<int>")


def _joined(coded: DataFrame, path: str, shards: int) -> DataFrame:
    """(doc_id, item_id, at, hop, block): the blocks of each document that may hold an item."""

    def through(block: list[pa.RecordBatch], held: dict) -> Iterator[pa.RecordBatch]:
        ids = np.concatenate([b.column(0).to_numpy() for b in block])
        codes = np.concatenate([b.column(1).flatten().to_numpy() for b in block])
        bounds = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(b.column(1).offsets.to_numpy()) for b in block]))]).astype(np.int64)
        for shard in range(shards):
            if shard not in held:
                held.clear()
                rows = open_shared(f"{path}/shard={shard}")
                held[shard] = groups_of(rows) if rows is not None and rows.num_rows else []
            for group in held[shard]:
                for doc, k, at, blocks in group.search(codes, bounds):
                    offsets = pa.array(np.arange(len(doc) + 1, dtype=np.int32) * group.length)
                    n = len(doc)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(ids[doc]), pa.array(np.full(n, group.ids[k])), pa.array(at), pa.array(np.full(n, group.hop, np.int32)),
                            pa.ListArray.from_arrays(offsets, pa.array(blocks.ravel().astype(np.int32))),
                        ],
                        ["doc_id", "item_id", "at", "hop", "block"],
                    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[pa.RecordBatch] = []
        held: dict = {}
        n = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                block.append(part)
                n += len(part.column(1).flatten())
                if n >= BLOCK_WORDS:
                    yield from through(block, held)
                    block, n = [], 0
        if block:
            yield from through(block, held)

    return balanced(coded).mapInArrow(run, "doc_id bigint, item_id bigint, at bigint, hop int, block array<int>")


def _verified(candidates: DataFrame) -> DataFrame:
    """(doc_id, item_id) of candidate blocks joined with their items' ``codes``, where an item-sized window holds the item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[tuple, list[int]] = {}
            for i, (item, hop, codes) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 3, 5)))):
                rows.setdefault((item, hop, tuple(codes)), []).append(i)
            keep = np.zeros(batch.num_rows, bool)
            begin, blocks = batch.column(2).to_numpy(), batch.column(4)
            for (_, hop, codes), at in rows.items():
                some = blocks.take(pa.array(at))
                keep[at] = Matcher(np.array(codes)).found(some.flatten().to_numpy().reshape(len(at), -1), begin[at], hop)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep)) for i in (0, 1)], ["doc_id", "item_id"])

    return candidates.select("doc_id", "item_id", "at", "hop", "block", "codes").mapInArrow(run, "doc_id bigint, item_id bigint").distinct()


def leaked(spark: SparkSession, documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): documents that hold at least half of an item's words, in order, within about twice its length.

    Whole texts are searched, however long, and items of any length and number: a task holds one block of documents and one
    shard of items. Null or empty texts and items without words match nothing; null ids don't take part. Repeated documents
    or items give each pair once; an item_id with several texts matches where any of them does. Further columns are ignored.
    Empty tables give no rows.
    """
    stage = Stage(spark, "leakage")
    wanted = items.select("item_id", "text").filter("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    wanted = stage.keep(word_lists(wanted, "item_id"), "items")
    vocabulary = stage.path("vocabulary")
    wanted.select(F.explode("words").alias("w")).distinct().write.parquet(vocabulary)
    wanted = stage.keep(_coded(wanted, "item_id", vocabulary).withColumn("nr", F.monotonically_increasing_id()), "item-codes")
    texts = documents.select("doc_id", "text").filter("doc_id IS NOT NULL AND text IS NOT NULL AND text <> ''")
    coded = stage.keep(_coded(word_lists(balanced(texts), "doc_id"), "doc_id", vocabulary), "coded")
    df = coded.select(F.explode(F.array_distinct("codes")).alias("code")).filter("code >= 0").groupBy("code").agg(F.count("*").alias("df"))
    spread = wanted.select("nr", F.posexplode("codes").alias("pos", "code")).join(df, "code", "left")
    dfs = spread.groupBy("nr").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("df", F.lit(0)).alias("df")))), lambda x: x["df"]).alias("dfs"))
    n_words = wanted.agg(F.coalesce(F.sum(F.size("codes")), F.lit(0))).first()[0]
    shards = max(1, -(-n_words // SHARD_WORDS))
    path = stage.path("item-shards")
    wanted.join(dfs, "nr").withColumn("shard", F.pmod(F.xxhash64("nr"), F.lit(shards)).cast("int")).repartition("shard").write.partitionBy("shard").parquet(path)
    candidates = stage.keep(_joined(coded, path, shards), "candidates")
    return _verified(candidates.join(wanted.select("item_id", "codes"), "item_id"))


def item_report(items: DataFrame, found: DataFrame) -> DataFrame:
    """(item_id, item_set, n_docs) for every item, leaked or not."""
    per = found.groupBy("item_id").agg(F.count("*").alias("n_docs"))
    return items.select("item_id", "item_set").distinct().join(per, "item_id", "left").select("item_id", "item_set", F.coalesce("n_docs", F.lit(0)).alias("n_docs"))
