"""Ranked lexical search by branch and bound over a hierarchical max tree.

Items are the queries; they run in blocks of at most ITEM_CHARS characters. For a block, one pass over all whole texts
counts each document's terms and keeps, of the terms that the block names, how often it holds them; N, L and the
documents of each term are sums of that. A term's score in a document is then a whole number, known exactly.

The tree: documents in the order of storage, FAN to a range, FAN ranges to a larger one, up to shards of SHARD
documents; each range holds, for every term inside, the largest score that any of its documents has for that term. An
item's bound of a range is the sum over its terms, which no document inside exceeds. Ranges are stored with their terms
side by side (and each shard as one row), so the bounds of a range's FAN children are one sum over neighbours. Each
shard is searched best first: the range of the highest bound is opened next, until that bound is below the score of the
k-th best document so far. Ranges whose bound equals it are opened too, as an equal score may have a smaller id.

Shards are branched on as well: from their top ranges alone every item gets the shard of its highest bound, which is
searched first; the k-th best score there is a bound for all others, and a shard below it is never opened for that
item. What shards give (k documents an item each) is cut to the k best, first in tasks, then by item.

Nothing of a document but its postings is exchanged or kept: texts never leave the pass over them, shards are made from
neighbouring rows, and only sums by term (as many as the block names) and k rows an item and shard meet. Memory is one
Arrow batch, or one shard. A word that is in every document is one posting a document, dealt out like the documents.

Edge cases: null and empty texts have no terms and are no results. An item that is null or has no known term gives no
rows. Items that repeat are ranked each, ids repeated included; a document row that repeats is a result of its own. Null ids of
documents come last among equal scores. Other columns are not read. Without documents or items the result is empty.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foretable.llm.common import Scratch, ship, stored

RESULTS = 20
#: Characters of items that are searched for at once: what a task knows of them is bounded by that.
ITEM_CHARS = 4_000_000
#: Ranges of a range, and documents of a shard.
FAN, SHARD = 16, 4_096
#: Letters and digits of ASCII, A-Z lower-cased, and every byte of other characters; all else is a space.
TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(TERMS).split() if text else []


@dataclass(frozen=True)
class Corpus:
    """N, L and the weight of each term of the block."""

    documents: int
    length: int
    weights: np.ndarray

    def scores(self, n: np.ndarray, terms: np.ndarray, uses: np.ndarray) -> np.ndarray:
        """Of each posting; n: the length of its document."""
        m = 100 - 25 + (25 * n * self.documents) // max(self.length, 1)
        return self.weights[terms] * ((1_000_000_000 * uses) // (1000 * uses + 12 * m))


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def postings(docs: DataFrame, number: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, uses) of every row: its terms in all, and those of number with their uses."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    schema = T.StructType([rows.schema["id"], T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("uses", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = number.get
        for batch in batches:
            sizes, terms, uses, ends = [], [], [], [0]
            for text in batch.column(1):
                found = terms_of(text.as_py())
                held = Counter(filter(None, map(known, found)))
                sizes.append(len(found))
                terms += held.keys()
                uses += held.values()
                ends.append(len(terms))
            ends = pa.array(ends, pa.int32())
            # numbers begin at 1 while they are looked up, so that filter(None) drops what is unknown
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (np.array(terms, np.int32) - 1, uses)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *lists], names=["id", "n", "terms", "uses"])

    return rows.mapInArrow(run, schema)


@dataclass
class Level:
    """Ranges of one size, side by side: range i has the entries starts[i] to starts[i + 1], a term and its largest score each."""

    starts: np.ndarray
    terms: np.ndarray
    most: np.ndarray

    def above(self) -> Level:
        """FAN of these ranges to one."""
        owner = np.repeat(np.arange(len(self.starts) - 1) // FAN, np.diff(self.starts))
        order = np.lexsort((self.terms, owner))
        owner, terms = owner[order], self.terms[order]
        first = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (terms[1:] != terms[:-1])])
        counts = np.bincount(owner[first], minlength=-(-(len(self.starts) - 1) // FAN))
        return Level(np.r_[0, np.cumsum(counts)], terms[first], np.maximum.reduceat(self.most[order], first))

    def packed(self) -> tuple[bytes, bytes, bytes]:
        return self.starts.astype("<i4").tobytes(), self.terms.astype("<i4").tobytes(), self.most.astype("<i8").tobytes()

    @staticmethod
    def unpacked(starts: bytes, terms: bytes, most: bytes) -> Level:
        return Level(np.frombuffer(starts, "<i4"), np.frombuffer(terms, "<i4"), np.frombuffer(most, "<i8"))

    def bounds(self, uses: np.ndarray, a: int, b: int) -> np.ndarray:
        """Of the ranges from a to b, for an item with so many uses of each term."""
        s, e = self.starts[a], self.starts[b]
        return np.add.reduceat(self.most[s:e] * uses[self.terms[s:e]], self.starts[a:b] - s)


def tree(level: Level) -> list[Level]:
    levels = [level]
    while len(levels[-1].starts) > 2:
        levels.append(levels[-1].above())
    return levels


def best_documents(levels: list[Level], uses: np.ndarray, least: int, k: int) -> list[tuple[int, int]]:
    """(score, document) of those that may be among the k best of all: none that scores below least, and none that k others
    here beat. Documents that tie with the k-th stay."""
    root = int(levels[-1].bounds(uses, 0, 1)[0])
    found: list[tuple[int, int]] = []
    floor, top = max(least, 1), []
    heap = [(-root, len(levels) - 1, 0)]
    while heap:
        bound, level, at = heapq.heappop(heap)
        if -bound < floor:
            break
        if level == 0:
            found.append((-bound, at))
            heapq.heappush(top, -bound)
            if len(top) > k:
                heapq.heappop(top)
            if len(top) == k:
                floor = max(floor, top[0])
            continue
        a = at * FAN
        b = min(a + FAN, len(levels[level - 1].starts) - 1)
        for i, x in enumerate(levels[level - 1].bounds(uses, a, b).tolist(), a):
            if x >= floor:
                heapq.heappush(heap, (-x, level - 1, i))
    return [x for x in found if x[0] >= floor]


def build_shards(held: DataFrame, corpus: Corpus) -> DataFrame:
    """(shard, ids, starts, terms, most, root_terms, root_most): each row a shard, its levels from documents upward."""
    spark, kind = held.sparkSession, held.schema["id"].dataType
    shared = spark.sparkContext.broadcast(corpus)
    schema = T.StructType([T.StructField("shard", T.LongType()), T.StructField("ids", T.ArrayType(kind)), *(T.StructField(c, T.ArrayType(T.BinaryType())) for c in ("starts", "terms", "most")), T.StructField("root_terms", T.BinaryType()), T.StructField("root_most", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, base, made = shared.value, TaskContext.get().partitionId() << 32, 0

        def shard(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            nonlocal made
            rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            sizes = np.diff(rows.column("terms").offsets.to_numpy()).astype(np.int64)
            terms, uses = (rows.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "uses"))
            scores = known.scores(np.repeat(rows.column("n").to_numpy(), sizes), terms, uses)
            levels = tree(Level(np.r_[0, np.cumsum(sizes)], terms, scores))
            packed = [list(x) for x in zip(*(v.packed() for v in levels), strict=True)]
            made += 1
            ids = pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), rows.column("id"))
            return pa.RecordBatch.from_arrays([pa.array([base + made]), ids, *(pa.array([x], pa.list_(pa.binary())) for x in packed), pa.array([packed[1][-1]]), pa.array([packed[2][-1]])], names=schema.names)

        parts: list[pa.RecordBatch] = []
        for batch in batches:
            while batch.num_rows:
                room = SHARD - sum(p.num_rows for p in parts)
                parts.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(p.num_rows for p in parts) == SHARD:
                    yield shard(parts)
                    parts = []
        if parts:
            yield shard(parts)

    return held.mapInArrow(run, schema)


def first_shards(shards: DataFrame, items: list[np.ndarray]) -> dict[int, list[int]]:
    """From a shard to the items that have their highest bound there; one shard for each item."""
    shared = shards.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[int, int]] = {}
        for batch in batches:
            for shard, terms, most in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                terms, most = np.frombuffer(terms, "<i4"), np.frombuffer(most, "<i8")
                for q, (named, uses) in enumerate(shared.value):
                    at = np.minimum(np.searchsorted(terms, named), len(terms) - 1)
                    bound = int((most[at] * uses)[terms[at] == named].sum())
                    best[q] = max(best.get(q, (0, -1)), (bound, shard))
        kept = [(q, *x) for q, x in best.items() if x[0] > 0]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in kept], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], names=["item", "bound", "shard"])

    found = shards.select("shard", "root_terms", "root_most").mapInArrow(run, "item int, bound long, shard long")
    first: dict[int, list[int]] = {}
    for r in found.groupBy("item").agg(F.max_by("shard", F.struct("bound", "shard")).alias("shard")).collect():
        first.setdefault(r.shard, []).append(r.item)
    return first


def search_shards(shards: DataFrame, items: list, vocabulary: int, k: int, wanted: Callable[[int], list[tuple[int, int]]]) -> DataFrame:
    """(item, id, score): of each shard, for the items that wanted(shard) names with the least score that matters, what may be
    among the k best."""
    kind = shards.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("id", kind), T.StructField("score", T.LongType())])
    shared = shards.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                shard = batch.column("shard")[i].as_py()
                ids = batch.column("ids")[i].values
                levels = [Level.unpacked(*x) for x in zip(*(batch.column(c)[i].as_py() for c in ("starts", "terms", "most")), strict=True)]
                of, at, scores = [], [], []
                for q, least in wanted(shard):
                    named, n = shared.value[q]
                    uses[named] = n
                    found = best_documents(levels, uses, least, k)
                    uses[named] = 0
                    if len(found) > k:
                        keys = dict(zip((d for _, d in found), ids.take(pa.array([d for _, d in found])).to_pylist(), strict=True))
                        found = sorted(found, key=lambda x: (-x[0], keys[x[1]] is None, keys[x[1]] if keys[x[1]] is not None else 0))[:k]
                    of += [q] * len(found)
                    scores += [s for s, _ in found]
                    at += [d for _, d in found]
                yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), ids.take(pa.array(at, pa.int64())), pa.array(scores, pa.int64())], names=schema.names)

    return shards.select("shard", "ids", "starts", "terms", "most").mapInArrow(run, schema)


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each item, with their rank."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _block(docs: DataFrame, items: list[tuple], id_col: str, text_col: str, k: int) -> DataFrame:
    """(item, id, score, rank) of the items given as (number, text)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "search")
    counted = {q: Counter(terms_of(text)) for q, text in items}
    number = {t: i for i, t in enumerate(sorted({t for c in counted.values() for t in c}), 1)}
    held = scratch.store(postings(docs, number, id_col, text_col), "postings")
    total = held.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("length")).first()
    weights = np.zeros(len(number), np.int64)
    for r in held.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        weights[r.term] = weight(total.documents, r["count"])
    corpus = Corpus(total.documents, total.length or 0, weights)
    vectors = [(np.array(sorted(number[t] - 1 for t in c), np.int64), np.array([n for _, n in sorted((number[t], n) for t, n in c.items())], np.int64)) for c in counted.values()]
    shards = scratch.store(build_shards(held.where(F.size("terms") > 0), corpus), "shards")
    scratch.drop("postings")
    first = first_shards(shards, vectors)
    seen = best(search_shards(shards.where(F.col("shard").isin(list(first))), vectors, len(number), k, lambda s: [(q, 1) for q in first[s]]), k)
    least = {r.item: r.score for r in seen.where(F.col("rank") == k).select("item", "score").collect()}
    bar = [(q, least.get(q, 1)) for q in range(len(vectors))]
    out = stored(best(search_shards(shards, vectors, len(number), k, lambda s: bar), k), "ranked")
    scratch.drop("shards")
    place = spark.createDataFrame(list(enumerate(counted)), "item int, number long")
    return out.join(F.broadcast(place), "item").select("number", "id", "score", "rank")


def lexical_search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", k: int = RESULTS, item_chars: int = ITEM_CHARS) -> DataFrame:
    """(item, rank, id, score): the k best documents of each item, columns named item_col, rank, id_col, score (the first two of
    equal names: the document's is id_col with an underscore)."""
    asked = stored(items.select(F.col(item_col).alias("item"), F.col(item_text).cast("binary").alias("text"), F.monotonically_increasing_id().alias("number")), "items")
    blocks = -(-(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // item_chars)
    parts = []
    for b in range(blocks):
        some = asked.where(F.col("text").isNotNull() & (F.pmod(F.xxhash64("number"), F.lit(blocks)) == b)).select("number", "text").collect()
        if some:
            parts.append(_block(docs, [(r.number, bytes(r.text)) for r in some], id_col, text_col, k))
    if not parts:
        none = asked.limit(0).crossJoin(docs.limit(0).select(F.col(id_col).alias("id")))
        found = none.select("number", "id", F.lit(0).cast("long").alias("score"), F.lit(0).alias("rank"))
    else:
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
    return found.join(asked.select("number", "item"), "number").select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col if id_col != item_col else f"{id_col}_"), "score")
