"""Near-duplicate groups by SuperMinHash, banding, verification and union-find.

A document is the set of its distinct shingles of SHINGLE words (A-Z lower-cased); fewer words are one shingle. Each
shingle draws, from its hash, a random permutation of the signature's slots and a fraction for each rank; a slot holds
the least rank plus fraction that any shingle puts there (SuperMinHash). Ranks are drawn one after the other for all
shingles of many documents at once, and a document stops when no later rank can lower a slot. Documents with the same
words (equal 128-bit content hashes of their words) become one node. Nodes that agree in a band of ROWS slots are
candidates; documents with equal sets but other words agree in every band and are candidates like any others.

Verification is exact, on the words themselves, and goes in rounds, as a bucket may hold a very large group of copies.
In a round each bucket has a leader, and members of other components than the leader's are compared with it: at most as
many comparisons as the bucket has members. Nodes are named by the number of their neighbours in buckets and their
hash, so that the first leader, a bucket's least node, stands in the middle of its group and is the root of its
component at once; later leaders are drawn by hash. After each round the components that its links join are merged (a
graph of components, not of documents), and rounds go on while what is left to compare far outnumbers the members and a
round lessens it. Then all pairs that share a bucket and no component are compared, without those that cannot pass by a
bitmap of each set: a bit that one set has and the other lacks stands for a shingle outside the intersection. No
candidate that could pass is left out, so the components are those of all candidates that pass.

With 32 bands of 4 slots, two documents at the threshold of 0.75 miss each other with probability 5e-6.

Texts are read twice, and the second time only those in some bucket of two nodes are kept. A leader's text goes to a
task once for each slice of about SLICE members, which are then streamed past it. A hot bucket, leader or component
goes through minima that combine before the exchange and are stored, and through joins whose two sides are both
exchanged for them, so that adaptive execution can split it. Nothing bounds what is joined with texts, so it is never
broadcast.

Edge cases: null text and text without words has no shingles, is linked to nothing, and is its own component.
component_id is the least id reachable; a null id counts as larger than any other. Rows that repeat an id are nodes of
their texts; of one id and text, rows are equal. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretable.llm.common import WORD, Scratch, ascii_lower, ship, text_or_empty, words
from foretable.llm.components import connected_components

SHINGLE, PERCENT = 5, 75
BANDS, ROWS = 32, 4
#: Comparing the bitmaps of two sets costs far less than a round's share for a row: rounds with leaders end when they leave
#: fewer pairs than MANY for each member, or more than LESSENED of those before.
MANY, LESSENED, MOST_ROUNDS = 256, 0.8, 12
#: A leader's text is sent once for about so many of those that are compared with it.
SLICE = 64
#: A bitmap is so many columns of 64 bits: few enough that the JVM compiles what compares two.
BITMAP = tuple(f"bits{i}" for i in range(16))
_U = np.uint64
#: Odd multipliers and shifts of a common 64-bit mixer.
_MIX = (_U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _MIX[1]
    x = (x ^ (x >> _U(27))) * _MIX[2]
    return x ^ (x >> _U(31))


def shingle_hashes(word_hashes: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of k words; of all words together if they are fewer."""
    n = len(word_hashes)
    if not n:
        return word_hashes
    size = min(k, n)
    total = np.full(n - size + 1, _U(size))
    for i in range(size):
        total = mix(total + _MIX[0] + word_hashes[i : n - size + 1 + i])
    return np.unique(total)


def signatures(hashes: np.ndarray, sizes: np.ndarray, slots: int) -> np.ndarray:
    """(document, slot): SuperMinHash of sets that stand one after the other in hashes. Rank in the high bits, fraction in the low 25."""
    docs = len(sizes)
    best = np.full(docs * slots, 0xFFFFFFFF, np.uint32)
    owner = np.repeat(np.arange(docs, dtype=np.int64) * slots, sizes)
    order = np.tile(np.arange(slots, dtype=np.uint8), (len(hashes), 1))
    rows = np.arange(len(hashes))
    for rank in range(slots):
        draw = mix(hashes + _U((rank + 1) * int(_MIX[0]) % (1 << 64)))
        swap = rank + ((draw >> _U(40)) % _U(slots - rank)).astype(np.int64)
        slot = order[rows, swap]
        order[rows, swap] = order[:, rank] if len(rows) == len(order) else order[rows, rank]
        value = (_U(rank << 25) | (draw & _U((1 << 25) - 1))).astype(np.uint32)
        np.minimum.at(best, owner + slot, value)
        # no later rank can lower a slot of a document whose slots are all below it
        open_ = best.reshape(docs, slots).max(axis=1) >= ((rank + 1) << 25)
        keep = open_[owner // slots]
        if not keep.any():
            break
        if not keep.all():
            hashes, owner, rows = hashes[keep], owner[keep], rows[keep]
            order, rows = order[rows], np.arange(len(rows))
    return best.reshape(docs, slots)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signature.astype(np.uint64).reshape(len(signature), bands, rows)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64) * _MIX[0]), (len(signature), bands))
    for i in range(rows):
        key = mix(key + _MIX[0] + parts[:, :, i])
    return key.view(np.int64)


def sketches(docs: DataFrame, id_col: str, text_col: str, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, print, digest, n, bands) of each row: a hash of its words (null if there are none), its set's size and a key for each band."""
    ship(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    source = source.select("id", F.xxhash64("text").alias("print"), words(ascii_lower(F.col("text"))).alias("words"))
    digest = F.when(F.size("words") > 0, F.unhex(F.md5(F.array_join("words", " "))))
    source = source.select("id", "print", digest.alias("digest"), F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    slots = bands * rows
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            flat, ends = lists.values.to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy()
            sets, first, size = [], 0, 0
            for i in range(batch.num_rows):
                sets.append(shingle_hashes(flat[ends[i] : ends[i + 1]]))
                size += len(sets[-1])
                if size >= 200_000 or i + 1 == batch.num_rows:
                    yield sketch(batch.slice(first, i + 1 - first), sets)
                    sets, first, size = [], i + 1, 0

    def sketch(batch: pa.RecordBatch, sets: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.array([len(s) for s in sets])
        keys = band_keys(signatures(np.concatenate(sets), sizes, slots), bands, rows)
        lists = [k if n else None for k, n in zip(keys, sizes, strict=True)]
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sizes, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], names=["id", "print", "digest", "n", "bands"])

    return source.mapInArrow(run, f"id {kind}, print long, digest binary, n long, bands array<long>")


_WORD = re.compile(WORD)


def _shingles(text: str) -> set:
    w = _WORD.findall(text)
    if len(w) < SHINGLE:
        return {tuple(w)} if w else set()
    return set(zip(*(w[i:] for i in range(SHINGLE)), strict=False))


def verified(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Of the pairs (a, b, size, c, c_2) of nodes the (c, c_2) of those whose sets overlap enough: 100 * intersection >=
    percent * union. size: about how many pairs b may have. b's text is sent once for each slice of its pairs."""
    sliced = pairs.select("a", "b", "c", "c_2", F.pmod(F.xxhash64("a"), F.ceil(F.col("size") / SLICE)).cast("int").alias("slice"))
    asked = sliced.hint("shuffle_merge").join(texts.toDF("a", "text"), "a")
    none = F.lit(None).cast("binary")
    leaders = sliced.select("b", "slice").distinct().hint("shuffle_merge").join(texts.toDF("b", "text"), "b").select(none.alias("a"), "b", none.alias("c"), none.alias("c_2"), "slice", "text")
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = leaders.unionByName(asked).repartition(n, "b", "slice").sortWithinPartitions("b", "slice", F.col("a").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: set = set()
        for batch in batches:
            keep = []
            for a, text in zip(batch.column("a"), batch.column("text"), strict=True):
                mine = _shingles(text.as_py())
                if not a.is_valid:
                    held = mine
                    keep.append(False)
                    continue
                both = len(mine & held)
                keep.append(100 * both >= percent * (len(mine) + len(held) - both))
            yield batch.select(["c", "c_2"]).filter(pa.array(keep, pa.bool_()))

    return rows.select("a", "text", "c", "c_2").mapInArrow(run, "c binary, c_2 binary")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row for each row of docs: id, n_shingles, component_id, kept."""
    scratch = Scratch(docs.sparkSession, "near")
    seen = scratch.store(sketches(docs, id_col, text_col, bands, rows), "sketches")
    at = F.struct("id", "print")
    nodes = seen.where("digest IS NOT NULL").groupBy("digest").agg(F.first("n").alias("n"), F.min("id").alias("least"), F.min_by("bands", at).alias("bands"), F.min(at).alias("at"))
    nodes = scratch.store(nodes, "nodes")
    buckets = nodes.select("digest", "n", F.explode("bands").alias("key"))
    shared = scratch.store(buckets.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "shared")
    members = scratch.store(buckets.join(shared, "key"), "members")
    # whoever is in a bucket of two nodes may be compared; a name sorts those with the most neighbours first
    name = F.concat(F.unhex(F.lpad(F.hex(F.lit(1 << 62) - F.sum("size")), 16, "0")), F.col("digest"))
    names = members.groupBy("digest").agg(name.alias("node"))
    names = scratch.store(names.join(nodes, "digest").select("digest", "node", "least", "at"), "names")
    placed = scratch.store(members.join(names.select("digest", "node"), "digest").select("key", "size", "node", "n"), "placed")
    scratch.drop("members", "shared")
    source = docs.select(F.col(id_col).alias("id"), ascii_lower(text_or_empty(text_col)).alias("text"), F.xxhash64(text_or_empty(text_col)).alias("print"))
    wanted = names.select("node", F.col("at.id").alias("of"), F.col("at.print").alias("as"))
    texts = source.join(wanted.hint("shuffle_merge"), F.col("id").eqNullSafe(F.col("of")) & (F.col("print") == F.col("as"))).select("node", "text")
    texts = scratch.store(texts.dropDuplicates(["node"]), "texts")
    merged = _merged(placed, texts, percent, scratch)
    label = names.select("digest", "node", "least")
    for i, step in enumerate(merged):
        last = "node" if i == 0 else f"c{i - 1}"
        new = step.toDF("__of", f"c{i}")
        label = label.join(new, F.col(last) == F.col("__of"), "left").drop("__of").withColumn(f"c{i}", F.coalesce(f"c{i}", last))
    label = scratch.store(label.select("digest", "least", F.col(f"c{len(merged) - 1}").alias("component")), "labels")
    least = scratch.store(label.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    known = scratch.store(nodes.select("digest", "least").join(label.join(least, "component").select("digest", "component_id"), "digest", "left").select(F.col("digest").alias("of"), F.coalesce("component_id", "least").alias("component_id")), "known")
    scratch.drop_all_but("sketches", "known")
    out = seen.join(known, F.col("digest") == F.col("of"), "left")
    found = F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), found.alias("component_id"), F.col("id").eqNullSafe(found).alias("kept"))


def _merged(placed: DataFrame, texts: DataFrame, percent: int, scratch: Scratch) -> list[DataFrame]:
    """Tables (node, component), to be applied one after the other: the components that each round's links join. placed:
    members of buckets, (key, size, node, n)."""
    out: list[DataFrame] = []

    def merge(asked: DataFrame, k: int) -> DataFrame:
        pairs = scratch.store(asked.groupBy("a", "b").agg(F.max("size").alias("size"), F.first("c").alias("c"), F.first("c_2").alias("c_2")), f"pairs-{k}")
        links = scratch.store(verified(pairs, texts, percent).distinct(), f"links-{k}")
        out.append(connected_components(links, scratch, f"merged-{k}"))
        return out[-1]

    placed, before, k = placed.withColumn("c", F.col("node")), None, 0
    while True:
        own = [c for c in placed.columns if c in ("node", "n", "c", "excess", *BITMAP)]
        rank = F.col("node") if k == 0 else F.struct(F.xxhash64("node", F.lit(k)), F.col("node"))
        leaders = placed.groupBy("key").agg(F.min(F.struct(rank.alias("rank"), *own)).alias("leader")).select("key", *(F.col("leader")[c].alias(f"{c}_2") for c in own))
        leaders = scratch.store(leaders, f"leaders-{k}")
        asked = placed.join(leaders, "key").where((F.col("c") != F.col("c_2")) & _could_pass(percent, bitmaps=k > 0))
        merged = merge(asked.select(F.col("node").alias("a"), F.col("node_2").alias("b"), "size", "c", "c_2"), k)
        now = placed.drop("whole", "main", "most").join(merged.toDF("c", "new"), "c", "left").withColumn("c", F.coalesce("new", "c")).drop("new")
        placed = _open(now, scratch, k)
        if k == 0:
            placed = scratch.store(placed.join(_bitmaps(placed, texts, scratch), "node"), "open-bits")
        rest = F.col("whole") - F.col("most")
        rows, left = placed.agg(F.count("*"), F.sum(rest * (F.col("whole") + F.col("most")) / 2 / F.col("whole"))).first()
        k += 1
        if not rows or left <= MANY * rows or k == MOST_ROUNDS or before and left > LESSENED * before:
            break
        before = left
    if rows:
        merge(_open_pairs(placed, percent), k)
    return out


def _could_pass(percent: int, bitmaps: bool) -> Column:
    """Whether the sets of a node and of a second one (columns with _2) can overlap enough, by their sizes and bitmaps."""
    most = F.least("n", "n_2")
    if bitmaps:
        both = F.bit_count(F.col(BITMAP[0]).bitwiseAND(F.col(f"{BITMAP[0]}_2")))
        for c in BITMAP[1:]:
            both = both + F.bit_count(F.col(c).bitwiseAND(F.col(f"{c}_2")))
        most = both + F.least("excess", "excess_2")
    return (100 + percent) * most >= percent * (F.col("n") + F.col("n_2"))


def _open(placed: DataFrame, scratch: Scratch, k: int) -> DataFrame:
    """The members of buckets that hold several components, with main, the largest component, and the numbers of all
    members (whole) and of those in main (most)."""
    placed = scratch.store(placed, f"now-{k}")
    sizes = placed.groupBy("key", "c").agg(F.count("*").alias("k"))
    parts = sizes.groupBy("key").agg(F.count("*").alias("parts"), F.sum("k").alias("whole"), F.max(F.struct("k", "c")).alias("most")).where("parts > 1")
    parts = scratch.store(parts.select("key", "whole", F.col("most.k").alias("most"), F.col("most.c").alias("main")), f"parts-{k}")
    return scratch.store(placed.join(parts, "key"), f"open-{k}")


def _bitmaps(placed: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """Of each node in placed: node, BITMAP (a bit for each shingle's hash) and excess (shingles beyond the bits that are set)."""
    hashed = texts.join(placed.select("node").distinct().hint("shuffle_merge"), "node").select("node", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("hashes"))
    size = 64 * len(BITMAP)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat, ends = lists.values.to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy()
            bits, excess = np.zeros((batch.num_rows, size), np.uint8), []
            for i in range(batch.num_rows):
                found = shingle_hashes(flat[ends[i] : ends[i + 1]])
                bits[i, (found % _U(size)).astype(np.int64)] = 1
                excess.append(len(found) - int(bits[i].sum()))
            packed = np.packbits(bits, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(excess, pa.int64()), *(pa.array(np.ascontiguousarray(x)) for x in packed.T)], names=["node", "excess", *BITMAP])

    return scratch.store(hashed.mapInArrow(run, "node binary, excess long, " + ", ".join(f"{c} long" for c in BITMAP)), "bitmaps")


def _open_pairs(placed: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes that share a bucket but no component and could pass. Of each bucket all nodes outside its
    largest component meet all nodes of other components."""
    own = ["node", "n", "c", "excess", *BITMAP]
    others = placed.where("c <> main").select("key", *(F.col(c).alias(f"{c}_2") for c in own))
    meets = (F.col("c") != F.col("c_2")) & ((F.col("c") == F.col("main")) | (F.col("node") < F.col("node_2")))
    return placed.select("key", "main", "size", *own).join(others, "key").where(meets & _could_pass(percent, bitmaps=True)).select(F.col("node").alias("a"), F.col("node_2").alias("b"), "size", "c", "c_2")
