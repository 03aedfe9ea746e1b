"""Repeated passages by prefix-partitioned suffix trees over words.

A passage is WINDOW consecutive words; all words of a passage that also starts anywhere else are removed. In the suffix
tree of all texts' words, those are the suffixes below an inner node of depth WINDOW or more. The tree is never built
whole; it is cut into subtrees that fit in memory, and each is built from the words themselves:

1. Suffixes are sampled so that equal windows choose equal samples: of the runs of PREFIX words inside a window, the one
   with the least hash (the leftmost of equals) is the window's prefix, about one in fourteen positions. A window can
   only be repeated if its prefix stands at two positions or more. Counting prefixes leaves the candidates; their hashes
   only decide what is looked at.
2. Suffixes are dealt out by prefix, each with the words of all windows that chose it. The suffixes of a prefix with at
   most GROUP positions are one subtree. A prefix with more is lengthened, to the whole window, so that its suffixes
   spread over as many groups as they have continuations; windows of lengthened prefixes that recur within a batch are
   found by a subtree of the batch, and one of each goes on for others to find, so that even a window in a third of all
   texts sends few rows to one task.
3. A subtree is its sorted suffixes with the lengths of the prefixes that neighbours share (subtree): words are numbered,
   and names of runs of 1, 2, 4 ... words are made from pairs of shorter runs' names, which sorts the suffixes and gives
   the shared lengths exactly. Stretches of neighbours that share WINDOW words or more are the deep inner nodes. Windows
   that follow each other in a text are joined to maximal repeats, (text, start, stop) in words.
4. Texts get their repeats by a join and lose the words.

Equal texts (by 128-bit content hashes) are one text with a count; with WINDOW words they are repeated as a whole.
Windows are judged on the input.

Edge cases: null text has no words. Ids play no part in what is found, so null and repeated ids are fine, and a
repeated row is a repeated text. A text of fewer than WINDOW words loses nothing. Existing columns named n_words,
n_removed or kept_text are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foretable.llm.common import WORD, Scratch, ship, text_or_empty, words
from foretable.llm.near_dedup import mix

WINDOW, PREFIX, GROUP = 35, 8, 1024
_U = np.uint64
#: Fixed value: an odd base, and its inverse modulo 2**64 below.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_WORD = re.compile(WORD)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, 2, ... modulo 2**64, at least n of them."""
    if len(_powers.get(base, ())) < n:
        size = 1 << max(n, 1024).bit_length()
        steps = np.full(size, _U(base))
        steps[0] = 1
        _powers[base] = np.multiply.accumulate(steps)
    return _powers[base][:n]


def prefixes(hashes: np.ndarray, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of a text: where its prefix stands, and the prefix's hash. Empty if the text is too short."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, _U)
    runs = len(hashes) - prefix + 1
    run = np.zeros(runs, _U)
    for i in range(prefix):
        run = mix(run + _MIXED + hashes[i : i + runs])
    at, span = np.arange(runs), window - prefix + 1
    reach = 1
    while reach < span:  # at[i]: the leftmost least of the reach runs from i
        step = min(reach, span - reach)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(run[left] <= run[right], left, right)
        reach += step
    return at, run[at]


_MIXED = _U(0x9E3779B97F4A7C15)


def window_hashes(hashes: np.ndarray, window: int) -> np.ndarray:
    n = len(hashes) - window + 1
    x = mix(hashes ^ _MIXED) * powers(_BASE, len(hashes))
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(x, dtype=_U)])
    return mix((sums[window:] - sums[:n]) * powers(_INVERSE, n))


def _lists(column: pa.ListArray, kind=np.uint64) -> tuple[np.ndarray, np.ndarray]:
    return column.values.to_numpy(zero_copy_only=False).view(kind), column.offsets.to_numpy()


def _sampled(texts: DataFrame, window: int, prefix: int) -> DataFrame:
    """(text, n_words, prefixes): of each position that some window of the text samples, the prefix there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, ends = _lists(batch.column(1))
            found = []
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                at, key = prefixes(flat[a:b], window, prefix)
                new = np.ones(len(at), bool)
                new[1:] = at[1:] != at[:-1]
                found.append(key[new].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends), pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["text_key", "n_words", "prefixes"])

    return texts.mapInArrow(run, "text_key binary, n_words long, prefixes array<long>")


def subtree(ids: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of ids (words, numbered from 0) at starts, as a suffix tree down to depth has them: their order (by the
    numbers), and how many words, depth at most, each shares with the one before it. Every start has depth words from it on."""
    if not len(starts):
        return starts, starts
    # as many names as fit into 63 bits make the name of a longer run
    most = len(ids)
    fold = 3 if most < 1 << 21 else 2
    names, size = [ids], 1
    while fold * size <= depth:
        n = most - fold * size + 1
        key = names[-1][:n].astype(np.int64)
        for i in range(1, fold):
            key = key * most + names[-1][i * size : i * size + n]
        names.append(np.unique(key, return_inverse=True)[1])
        size *= fold
    # runs of size words that overlap make one of depth words
    key = names[-1][starts].astype(np.int64)
    for at in {min(i * size, depth - size): None for i in range(1, fold + 1)}:
        key = key * most + names[-1][starts + at] if at else key
    order = np.argsort(key)
    left, right = starts[order[:-1]], starts[order[1:]]
    shared = np.zeros(len(left), np.int64)
    for step in reversed(range(len(names))):
        run = fold**step
        for _ in range(fold if run == size else fold - 1):
            open_ = np.flatnonzero(shared + run <= depth)
            same = names[step][left[open_] + shared[open_]] == names[step][right[open_] + shared[open_]]
            shared[open_[same]] += run
    return order, np.concatenate([[0], shared])


def deep_nodes(order: np.ndarray, shared: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each start, in the order that starts were given: the number of the node of depth that it is below, and that node's leaves."""
    node = np.empty(len(order), np.int64)
    node[order] = np.cumsum(shared < depth) - 1
    return node, np.bincount(node)[node] if len(node) else node


def _numbered(words_: pa.Array) -> np.ndarray:
    return words_.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


_SUFFIXES = "prefix long, branch long, text_key binary, pos int, length int, words string"
#: What a row of suffixes holds, by its length: so many windows from pos on; KNOWN + so many words from pos on are
#: repeated, which needs no more looking; HINT: one window that is repeated, for others to find.
KNOWN, HINT = 1 << 30, 0


def _suffixes(texts: DataFrame, window: int, prefix: int, portion: int = 500_000) -> DataFrame:
    """Rows of candidate windows from (text_key, words, hashes, keys, large): keys are the text's prefixes that stand elsewhere too, large
    tells which of them are to be lengthened. Equal texts stand next to each other, and one of them is taken."""

    def rows(flat: pa.Array, names: pa.Array, prefix_: np.ndarray, branch: np.ndarray, text: np.ndarray, pos: np.ndarray, length: np.ndarray, first: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        """text: -1 for none. first, size: where a row's words stand in flat."""
        for a in range(0, len(text), 20_000):
            part = slice(a, a + 20_000)
            held = flat.take(pa.array(_ranges(first[part], size[part])))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size[part])]), pa.int32()), held)
            owner = names.take(pa.array(text[part], mask=text[part] < 0))
            yield pa.RecordBatch.from_arrays([pa.array(prefix_[part].view(np.int64)), pa.array(branch[part].view(np.int64)), owner, pa.array(pos[part], pa.int32()), pa.array(length[part], pa.int32()), pc.binary_join(lists, " ")], names=["prefix", "branch", "text_key", "pos", "length", "words"])

    def part_of(batch: pa.RecordBatch, last: bytes | None) -> Iterator[pa.RecordBatch]:
        names, lists = batch.column(0), batch.column(1)
        flat, begin = lists.values, lists.offsets.to_numpy().astype(np.int64)
        (hashes, ends), (keys, cuts) = _lists(batch.column(2)), _lists(batch.column(3))
        large = batch.column(4).values.to_numpy(zero_copy_only=False)
        runs, hot = [], []
        for i, text in enumerate(names.to_pylist()):
            if text == last:
                continue
            last = text
            own, is_large = keys[cuts[i] : cuts[i + 1]], large[cuts[i] : cuts[i + 1]]
            order = np.argsort(own)
            own, is_large = own[order], is_large[order]
            h = hashes[ends[i] : ends[i + 1]]
            at, key = prefixes(h, window, prefix)
            spot = np.minimum(np.searchsorted(own, key), len(own) - 1)
            live = own[spot] == key
            if not live.any():
                continue
            lengthened = live & is_large[spot]
            if lengthened.any():
                p = np.flatnonzero(lengthened)
                hot.append((np.full(len(p), i), p, key[p], window_hashes(h, window)[p]))
                live &= ~lengthened
            new = np.concatenate([[True], at[1:] != at[:-1]])
            start = np.flatnonzero(live & (new | ~np.concatenate([[False], live[:-1]])))
            stop = np.flatnonzero(live & np.concatenate([new[1:] | ~live[1:], [True]])) + 1
            runs.append((np.full(len(start), i), start, stop - start, key[start]))
        if runs:
            text, pos, length, key = (np.concatenate(x) for x in zip(*runs, strict=True))
            yield from rows(flat, names, key, np.zeros(len(key), _U), text, pos, length, begin[text] + pos, length + window - 1)
        if hot:
            text, pos, key, full = (np.concatenate(x) for x in zip(*hot, strict=True))
            cut = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (pos[1:] != pos[:-1] + 1)]))
            length = np.diff(np.concatenate([cut, [len(text)]]))
            size = length + window - 1
            held = _numbered(flat.take(pa.array(_ranges(begin[text[cut]] + pos[cut], size))))
            node, leaves = deep_nodes(*subtree(held, _ranges(np.cumsum(size) - size, length), window), window)
            # one window of each node goes on
            one = np.unique(node, return_index=True)[1]
            many = leaves[one] > 1
            yield from rows(flat, names, key[one], full[one], np.where(many, -1, text[one]), pos[one], np.where(many, HINT, 1), begin[text[one]] + pos[one], np.full(len(one), window))
            again = leaves > 1
            text, start, stop = _joined(text[again], pos[again], window)
            spread = mix(start.astype(_U) + key[0])
            yield from rows(flat, names, spread, spread, text, start, KNOWN + stop - start, np.zeros(len(text), np.int64), np.zeros(len(text), np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            sizes = pc.list_value_length(batch.column(1)).to_numpy()
            chunk = np.cumsum(sizes) // portion
            for c in np.unique(chunk):
                at = np.flatnonzero(chunk == c)
                some = pa.Table.from_batches([batch.slice(at[0], len(at))]).take(pa.array(np.arange(len(at)))).combine_chunks().to_batches()[0]
                yield from part_of(some, last)
                last = some.column(0)[-1].as_py()

    return texts.mapInArrow(run, _SUFFIXES)


def _joined(text: np.ndarray, pos: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows, by text and position, joined to stretches of words: text, start, stop."""
    order = np.lexsort((pos, text))
    text, pos = text[order], pos[order]
    new = np.flatnonzero(np.concatenate([np.ones(min(1, len(text)), bool), (text[1:] != text[:-1]) | (pos[1:] > pos[:-1] + 1)]))
    last = np.concatenate([new[1:], [len(text)]])[: len(new)] - 1
    return text[new], pos[new], pos[last] + window


def _repeats(suffixes: DataFrame, window: int, held: int = 500_000) -> DataFrame:
    """(text_key, start, stop) from rows of suffixes that are sorted by group: the repeats that each group's subtree shows.
    As many groups as hold about held words are one step. A group of more, which only a whole window is, is settled in
    parts, of which one suffix for each node goes on."""

    def spans(rows: pa.Table, repeated: np.ndarray, owner: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
        n = rows.column("length").to_numpy()
        row, start, stop = _joined(owner[repeated], pos[repeated], window)
        known = np.flatnonzero(n >= KNOWN)
        p = rows.column("pos").to_numpy()
        keys = pa.concat_tables([rows.select(["text_key"]).take(pa.array(np.concatenate([row, known])))]).column(0).combine_chunks()
        return pa.RecordBatch.from_arrays([keys, pa.array(np.concatenate([start, p[known]]), pa.int32()), pa.array(np.concatenate([stop, p[known] + n[known] - KNOWN]), pa.int32())], names=["text_key", "start", "stop"])

    def settle(rows: pa.Table, go_on: bool) -> tuple[pa.RecordBatch, pa.Table]:
        rows = rows.combine_chunks()
        n = rows.column("length").to_numpy()
        windows = np.where(n >= KNOWN, 0, np.maximum(n, 1))
        live = np.flatnonzero(windows)
        if not len(live):
            return spans(rows, np.zeros(0, bool), live, live), rows.slice(0, 0)
        lists = pc.split_pattern(rows.column("words").combine_chunks().take(pa.array(live)), " ")
        begin, windows = lists.offsets.to_numpy().astype(np.int64)[:-1], windows[live]
        owner = np.repeat(live, windows)
        pos = rows.column("pos").to_numpy()[owner] + _ranges(np.zeros(len(live), np.int64), windows)
        node, leaves = deep_nodes(*subtree(_numbered(lists.values), _ranges(begin, windows), window), window)
        hint = n[owner] == HINT
        hinted = np.bincount(node, weights=hint)[node] > 0
        repeated = ((leaves > 1) | hinted) & ~hint
        out = spans(rows, repeated, owner, pos)
        if not go_on:
            return out, rows.slice(0, 0)
        one = np.unique(node, return_index=True)[1]
        rest = rows.take(pa.array(owner[one]))
        length = np.where((leaves[one] > 1) | hinted[one], HINT, 1)
        return out, rest.set_column(rest.schema.get_field_index("length"), "length", pa.array(length, pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = None, 0
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if rows is None else pa.concat_tables([rows, pa.Table.from_batches([batch])])
            size += batch.column("words").nbytes // 7
            if size < held:
                continue
            key = [rows.column(c).to_numpy() for c in ("prefix", "branch")]
            other = np.flatnonzero((key[0] != key[0][-1]) | (key[1] != key[1][-1]))
            tail = other[-1] + 1 if len(other) else 0
            if tail:
                yield settle(rows.slice(0, tail), False)[0]
                rows = rows.slice(tail).combine_chunks()
            if (rows.column("words").nbytes // 7) >= held and (rows.column("length").to_numpy() <= 1).all():
                out, rows = settle(rows, True)
                yield out
            size = rows.column("words").nbytes // 7
        if rows is not None:
            yield settle(rows, False)[0]

    return suffixes.mapInArrow(run, "text_key binary, start int, stop int")


def text_key(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(text_or_empty(text_col).alias("text")).select(F.unhex(F.md5("text")).alias("text_key"), "text")


def repeated_passages(docs: DataFrame, text_col: str = "text", window: int = WINDOW, prefix: int = PREFIX, group: int = GROUP) -> DataFrame:
    """(text_key, spans): for each text with repeats, its sorted maximal stretches of repeated words, array of start, stop."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "passages")
    hashes = F.transform("words", lambda w: F.xxhash64(w)).alias("hashes")
    texts = text_key(docs, text_col)
    sampled = _sampled(texts.select("text_key", words(F.col("text")).alias("words")).select("text_key", hashes), window, prefix)
    sampled = scratch.store(sampled.groupBy("text_key").agg(F.count("*").alias("copies"), F.first("n_words").alias("n_words"), F.first("prefixes").alias("prefixes")), "prefixes")
    places = sampled.select("text_key", F.explode("prefixes").alias("prefix"))
    common = scratch.store(places.groupBy("prefix").agg(F.count("*").alias("n")).where("n > 1").select("prefix", (F.col("n") > group).alias("large")), "common")
    chosen = places.join(common, "prefix").groupBy("text_key").agg(F.collect_set(F.struct("prefix", "large")).alias("own"))
    chosen = scratch.store(chosen, "chosen").select(F.col("text_key").alias("key"), F.col("own.prefix").alias("keys"), F.col("own.large").alias("large"))
    live = texts.join(chosen, F.col("text_key") == F.col("key")).select("text_key", words(F.col("text")).alias("words"), "keys", "large").select("text_key", "words", hashes, "keys", "large")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    suffixes = _suffixes(live, window, prefix).repartition(n, "prefix", "branch").sortWithinPartitions("prefix", "branch")
    found = _repeats(suffixes, window)
    whole = sampled.where((F.col("copies") > 1) & (F.col("n_words") >= window)).select("text_key", F.lit(0).alias("start"), F.col("n_words").cast("int").alias("stop"))
    spans = scratch.store(found.unionByName(whole).groupBy("text_key").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans")), "spans")
    scratch.drop_all_but("spans")
    return spans


def remove_passages(docs: DataFrame, spans: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, n_removed and kept_text: the words outside all spans, joined by one space."""
    added = {"n_words": T.LongType(), "n_removed": T.LongType(), "kept_text": T.StringType()}
    docs = docs.drop(*[c for c in docs.columns if c in added and c != text_col])
    schema = T.StructType([*docs.schema.fields, *(T.StructField(k, v) for k, v in added.items())])
    names = docs.columns
    rows = docs.select(F.struct(*names).alias("row"), F.unhex(F.md5(text_or_empty(text_col))).alias("key")).join(spans.select(F.col("text_key").alias("of"), "spans"), F.col("key") == F.col("of"), "left")
    columns = [F.col("row")[c].alias(f"c{i}") for i, c in enumerate(names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, kept = [], [], []
            for text, cut in zip(batch.column(names.index(text_col)), batch.column("spans"), strict=True):
                ws = _WORD.findall(text.as_py() or "")
                total = len(ws)
                if cut.is_valid:
                    left, at = [], 0
                    for s in cut.as_py():
                        left += ws[at : s["start"]]
                        at = max(at, s["stop"])
                    ws = left + ws[at:]
                n.append(total)
                gone.append(total - len(ws))
                kept.append(" ".join(ws))
            new = [pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *new], names=[*names, *added])

    return rows.select(*columns, "spans").mapInArrow(run, schema)


def substring_dedup(docs: DataFrame, text_col: str = "text", window: int = WINDOW, prefix: int = PREFIX, group: int = GROUP) -> DataFrame:
    """docs with n_words, n_removed and kept_text."""
    return remove_passages(docs, repeated_passages(docs, text_col, window, prefix, group), text_col)
