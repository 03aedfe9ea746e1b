"""Language identification by prediction by partial matching.

Each language has a context tree over bytes: for every context of up to ORDER bytes, how often which byte came next. A
language's code length for a text is the sum over its bytes of -log2 p. p comes from the longest context that the
language's tree holds; a byte new there costs an escape (method C: distinct bytes over distinct bytes and uses) and is
looked for in the next shorter context, without the bytes that the longer one has, and at last among the bytes never
seen, all alike. Statistics are frozen, so the cost of a byte depends on the longest context and the byte alone: it is
worked out once for each (context, language, byte), and scoring looks it up for every byte of every whole text. The least code length
wins; the score is that language's share of 2^-bits among all languages. Texts are lower-cased first.

Learning: of each of the MOST_LANGUAGES most frequent languages at most FIT_ROWS rows that are not held out (those of
the lowest id hashes; copies of an id count once) with at most FIT_BYTES bytes in all; a row longer than a sixteenth of
that is passed over as a whole. Tasks count contexts of their rows, counts meet by (context, byte, language), and of
the contexts with MIN_USES uses the most frequent are kept, as many as leave CELLS costs in all: that bounds what is
collected and broadcast. A context is never more frequent than its own end, so the kept ones form a tree.

Scoring is a mapInArrow stage: nothing is exchanged, memory is one Arrow batch and STEP positions, and a lost task is
simply run again.

Edge cases: null text, or one without a letter, is UNKNOWN with score 0, as is every text if there is nothing to learn
from. Equal code lengths go to the first language in order of names. Rows with a null id or language are predicted but
never learned from; rows repeated are predicted each. Existing columns named lang_pred, score or bits are replaced. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foretable.llm.common import ship, stored
from foretable.llm.toxicity import held_out

UNKNOWN = "und"
ORDER = 4
#: Bounds of what is learned from, for each language, and of the languages.
FIT_ROWS, FIT_BYTES, MOST_LANGUAGES = 2_000, 4_000_000, 200
#: A context is kept from so many uses, and in all there are so many costs (contexts x languages x bytes).
MIN_USES, CELLS = 24, 4_000_000
STEP = 1 << 18
#: UTF-8 never has this byte: it stands between texts.
BORDER = 0xFF


@dataclass
class ContextTrees:
    """symbols: the column of each byte. child: (2 x contexts, columns), where to go with one more byte to the left, times the
    number of columns; the second half stands for contexts that cannot be made longer. bits: (languages, contexts x columns)."""

    languages: list[str]
    symbols: np.ndarray
    child: np.ndarray
    bits: np.ndarray

    @property
    def columns(self) -> int:
        return int(self.symbols.max()) + 1


def training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, rows: int = FIT_ROWS, size: int = FIT_BYTES) -> DataFrame:
    """(lang, text): the bounded sample of each language, texts lower-cased, as bytes."""
    learn = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    counts = learn.groupBy(F.col(lang_col).alias("lang")).count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()
    buckets = 1 << 40
    most = {r["lang"]: min(buckets, 2 * rows * buckets // r["count"]) for r in counts}
    key = F.xxhash64(F.col(id_col))
    some = learn.select(F.col(lang_col).alias("lang"), key.alias("key"), F.lower(text_col).cast("binary").alias("text"))
    limits = docs.sparkSession.createDataFrame(list(most.items()) or [(None, 0)], "lang string, most long")
    some = some.join(F.broadcast(limits), "lang").where((F.pmod("key", F.lit(buckets)) < F.col("most")) & (F.length("text") <= size // 16))
    some = stored(some.groupBy("lang", "key").agg(F.max("text").alias("text")), "language-sample")
    order = Window.partitionBy("lang").orderBy(F.pmod("key", F.lit(buckets)), "key")
    chosen = some.select("lang", "key", F.row_number().over(order).alias("row"), F.sum(F.length("text")).over(order).alias("bytes")).where((F.col("row") <= rows) & (F.col("bytes") <= size))
    return some.join(chosen, ["lang", "key"]).select("lang", "text")


def context_counts(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """(depth, context, byte, lang, n). context: its bytes as a number, the nearest lowest."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                data = np.frombuffer(bytes([BORDER]) + bytes([BORDER]).join(texts), np.uint8).astype(np.int64)
                context, whole = np.zeros(len(data), np.int64), data != BORDER
                for depth in range(order + 1):
                    if depth:
                        before = np.full(len(data), BORDER, np.int64)
                        before[depth:] = data[:-depth]
                        whole &= before != BORDER
                        context |= before << (8 * (depth - 1))
                    grams, n = np.unique((context[whole] << 8) | data[whole], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), depth, np.int32)), pa.array(grams >> 8), pa.array((grams & 255).astype(np.int32)), pa.array([lang] * len(grams), pa.string()), pa.array(n.astype(np.int64))], names=["depth", "context", "byte", "lang", "n"])

    counts = rows.mapInArrow(run, "depth int, context long, byte int, lang string, n long")
    return counts.groupBy("depth", "context", "byte", "lang").agg(F.sum("n").alias("n"))


def byte_costs(counts: np.ndarray, parent: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Bits of each byte in each context of one language. counts: (contexts, columns), the last but one column for bytes never
    seen, the last for the border; contexts come after their parents."""
    n, columns = counts.shape
    total, distinct = counts.sum(axis=1), (counts > 0).sum(axis=1)
    log = lambda x: np.log2(np.maximum(x, 1))
    costs, beyond = np.empty((n, columns)), np.empty((n, columns))
    for level in range(depth.max() + 1):
        at = np.flatnonzero(depth == level)
        c, have = counts[at], counts[at] > 0
        if level == 0:
            beyond[at] = log(256 - distinct[at])[:, None]
            shorter = beyond[at]
        else:
            up = parent[at]
            # in the next shorter context, without the bytes that this one has
            rest = total[up] - (counts[up] * have).sum(axis=1)
            new = distinct[up] - distinct[at]
            escape = np.where(new > 0, log(rest + new) - log(new), 0.0)
            beyond[at] = np.where(counts[up] > 0, log(rest + new)[:, None] - log(counts[up]), escape[:, None] + beyond[up])
            shorter = costs[up]
        both = log(total[at] + distinct[at])[:, None]
        own = np.where(have, both - log(c), both - log(distinct[at])[:, None] + beyond[at])
        costs[at] = np.where((total[at] > 0)[:, None], own, shorter)
    costs[:, -1] = 0.0
    return costs


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, min_uses: int = MIN_USES, cells: int = CELLS) -> ContextTrees | None:
    """The trees of all languages; None if there is nothing to learn from."""
    counts = stored(context_counts(training_rows(docs, id_col, text_col, lang_col), order), "contexts")
    root = counts.where("depth = 0").groupBy("byte", "lang").agg(F.sum("n").alias("n")).collect()
    if not root:
        return None
    languages, alphabet = sorted({r.lang for r in root}), sorted({r.byte for r in root})
    columns = len(alphabet) + 2
    kept = counts.groupBy("depth", "context").agg(F.sum("n").alias("uses")).where((F.col("uses") >= min_uses) | (F.col("depth") == 0))
    kept = kept.orderBy(F.desc("uses"), "depth", "context").limit(max(1, cells // (len(languages) * columns))).select("depth", "context")
    place = F.array_position(F.array(*map(F.lit, languages)), F.col("lang")).cast("int") - 1
    table = counts.join(F.broadcast(kept), ["depth", "context"]).select(F.expr("shiftleft(bigint(depth), 56) | context").alias("key"), "byte", place.alias("lang"), "n").toArrow()
    symbols = np.full(256, columns - 2, np.int64)
    symbols[alphabet] = np.arange(len(alphabet))
    symbols[BORDER] = columns - 1
    contexts, at = np.unique(table.column("key").to_numpy(), return_inverse=True)
    depth, bytes_of = contexts >> 56, contexts & ((1 << 56) - 1)
    last = np.where(depth > 0, bytes_of >> (8 * np.maximum(depth - 1, 0)), 0)
    parent = np.searchsorted(contexts, np.maximum(depth - 1, 0) << 56 | np.where(depth > 0, bytes_of & ((1 << (8 * np.maximum(depth - 1, 0))) - 1), 0))
    n = len(contexts)
    child = np.repeat(np.arange(n, 2 * n, dtype=np.int32)[None, :], 2, axis=0).reshape(-1)[:, None].repeat(columns, axis=1) * columns
    deeper = np.flatnonzero(depth > 0)
    child[parent[deeper], symbols[last[deeper]]] = deeper * columns
    lang, byte, uses = table.column("lang").to_numpy(), symbols[table.column("byte").to_numpy()], table.column("n").to_numpy()
    bits = np.empty((len(languages), n * columns))
    for i in range(len(languages)):
        own = np.zeros((n, columns), np.int64)
        own[at[lang == i], byte[lang == i]] = uses[lang == i]
        bits[i] = byte_costs(own, parent, depth).ravel()
    return ContextTrees(languages, symbols, child.astype(np.int32), bits)


def code_lengths(texts: list[bytes], trees: ContextTrees, order: int = ORDER) -> np.ndarray:
    """(texts, languages): bits of each whole text."""
    columns, half = trees.columns, len(trees.child) // 2 * trees.columns
    data = np.frombuffer(bytes([BORDER]) * order + bytes([BORDER]).join(texts) + bytes([BORDER]), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1  # with the border behind each
    ends = np.cumsum(sizes)
    out, flat = np.zeros((len(texts), len(trees.languages))), trees.child.ravel()
    symbols = trees.symbols.astype(np.int32)
    for a in range(0, int(ends[-1]) if len(texts) else 0, STEP):
        b = min(a + STEP, int(ends[-1]))
        s = symbols[data[a : b + order]]
        node = np.zeros(b - a, np.int32)
        for k in range(1, order + 1):
            node = flat[node + s[order - k : len(s) - k]]
        node -= half * (node >= half).astype(np.int32)
        node += s[order:]
        first = int(np.searchsorted(ends, a, side="right"))
        last = int(np.searchsorted(ends, b - 1, side="right"))
        starts = np.maximum(ends[first : last + 1] - sizes[first : last + 1] - a, 0)
        for i, bits in enumerate(trees.bits):
            out[first : last + 1, i] += np.add.reduceat(bits[node], starts)
    return out


def predict_languages(docs: DataFrame, trees: ContextTrees | None, text_col: str = "text", order: int = ORDER) -> DataFrame:
    """docs with lang_pred, score (0 to 1) and bits (code length of a byte in that language, null where lang_pred is UNKNOWN)."""
    docs = docs.drop(*[c for c in docs.columns if c in ("lang_pred", "score", "bits") and c != text_col])
    if trees is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "bits": F.lit(None).cast("double")})
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(trees)
    written = "__lower"
    while written in docs.columns:
        written += "_"
    rows = docs.withColumn(written, F.when(F.rlike(text_col, F.lit(r"\p{L}")), F.lower(text_col).cast("binary")))
    names_of_docs = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            step = max(1, (8 << 20) * whole.num_rows // max(1, whole.column(written).nbytes))
            for i in range(0, whole.num_rows, step):
                batch = whole.slice(i, step)
                texts = batch.column(written).to_pylist()
                told = [k for k, t in enumerate(texts) if t is not None]
                bits = code_lengths([texts[k] for k in told], model, order)
                best = bits.argmin(axis=1)
                least = bits.min(axis=1, keepdims=True)
                score = 1 / np.exp2(np.maximum(least - bits, -1000)).sum(axis=1)
                names: list[str] = [UNKNOWN] * len(texts)
                scores, per = np.zeros(len(texts)), np.full(len(texts), np.nan)
                for j, k in enumerate(told):
                    names[k], scores[k], per[k] = model.languages[best[j]], score[j], least[j, 0] / len(texts[k])
                kept = [batch.column(c) for c in names_of_docs]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(names, pa.string()), pa.array(scores), pa.array(per, from_pandas=True)], names=schema.names)

    return rows.mapInArrow(run, schema)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs with lang_pred, score and bits, by trees learned from those rows of docs that have a language and are not held out."""
    return predict_languages(docs, fit_languages(docs, id_col, text_col, lang_col), text_col)
