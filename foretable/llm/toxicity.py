"""Toxicity by a linear-chain conditional random field over tokens.

Learning. Labels tell which documents are toxic, so tokens are labelled first: over all words of the labelled rows, one
aggregation gives how much more frequent a word, or a word's beginning, is in toxic documents than in others (log
odds of rates); in a toxic document, tokens above LABEL_ODDS are the toxic ones, in others none is. The field has two
states; a token's features are the class of its log odds, and whether a neighbour is above LABEL_ODDS. Its weights are
fitted by gradient ascent on the exact likelihood. A logistic model of what the marginals of a document add up to
(expected toxic tokens, their density, the largest marginal) turns marginals into the document's score.

Scoring. Forward-backward gives each token's marginal. Recursions run over blocks of tokens of many documents at once:
products of 2 x 2 matrices within blocks, then along a document's blocks, then within blocks again, which is exact.
Tokens of at least 0.5 are joined into spans.

What is learned from is at most FIT_ROWS labelled rows (those of the lowest id hashes), of which FIELD_ROWS with at most
FIELD_CHARS characters fit the field; the lexicon has all entries of those rows that are frequent enough. Scoring is a mapInArrow stage over all rows and whole texts: no exchange,
memory of one Arrow batch.

Edge cases: null and empty texts have the score of a text without toxic tokens. A null id is never learned from and not
held out. Labels that are null are ignored; of several labels of one id the highest counts. Without a toxic or without
a harmless labelled row, nothing is learned and every score is 0. Rows repeated are scored each. Existing columns named
score or spans are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foretable.llm.common import ship, stored, text_or_empty

#: Bounds of what is learned from: labelled rows, those of them that fit the field, and their characters (whole rows only).
FIT_ROWS, FIELD_ROWS, FIELD_CHARS = 20_000, 400, 8_000_000
#: A word or beginning is listed from this many uses in toxic rows, and labels tokens from these log odds.
LEAST_USES, LABEL_ODDS = 5, 2.5
BEGINNINGS = (3, 4, 5, 6, 7)
#: Limits of the classes of log odds; the first class is for words that aren't listed.
CLASSES = (0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 5.0, 6.0)
TOKEN = re.compile(r"\w+")
#: Tokens that a worker remembers; longer ones than LONGEST it never does.
BLOCK, REMEMBERED, LONGEST = 64, 500_000, 64


def held_out(id_: Column) -> Column:
    """Rows that only tests use."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, rows: int) -> DataFrame:
    """(id, text, toxic) of at most so many labelled rows that aren't held out."""
    marks = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("id")).agg(F.max("toxic").alias("toxic"))
    marks = marks.orderBy(F.xxhash64("id"), "id").limit(rows)
    return docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).join(marks, "id")


def lexicon(rows: DataFrame) -> DataFrame:
    """(feature, odds): words ("=word") and beginnings ("^begin") with the log odds of their rates."""
    words = rows.select("toxic", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)(\w+)"), 1)).alias("w"))
    words = words.groupBy("w").agg(F.sum(F.col("toxic").cast("long")).alias("bad"), F.count("*").alias("n"))
    starts = F.array(*(F.when(F.char_length("w") >= k, F.concat(F.lit("^"), F.substring("w", 1, k))) for k in BEGINNINGS))
    features = words.select("bad", (F.col("n") - F.col("bad")).alias("good"), F.explode(F.array_compact(F.concat(F.array(F.concat(F.lit("="), "w")), starts))).alias("feature"))
    features = stored(features.groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).where((F.col("bad") >= LEAST_USES) | F.col("feature").startswith("=")), "features")
    bad, good = features.where(F.col("feature").startswith("=")).agg(F.sum("bad"), F.sum("good")).first()
    if not bad or not good:
        return features.select("feature", F.lit(0.0).alias("odds")).limit(0)
    odds = F.log((F.col("bad") + 0.5) / F.lit(float(bad))) - F.log((F.col("good") + 0.5) / F.lit(float(good)))
    known = features.where(F.col("bad") >= LEAST_USES).select("feature", odds.alias("odds"), "bad").where(F.col("odds") >= CLASSES[0])
    return known.select("feature", "odds")


@dataclass
class Field:
    """odds by feature; weights of state 1: one for each class of odds, two for neighbours; score of a change into, out
    of and within state 1, and of a start in it; weights of the document's score."""

    odds: dict[str, float]
    weights: np.ndarray
    moves: np.ndarray
    document: np.ndarray


class Classes(dict):
    """From a token to the class of its log odds; remembers what it has seen."""

    def __init__(self, odds: dict[str, float]) -> None:
        super().__init__()
        self.odds = odds

    def __missing__(self, token: str) -> int:
        w = token.lower()
        best = max(self.odds.get(f, 0.0) for f in ("=" + w, *("^" + w[:k] for k in BEGINNINGS if len(w) >= k)))
        k = int(np.searchsorted(CLASSES, best, side="right"))
        if len(self) >= REMEMBERED:
            self.clear()
        if len(token) <= LONGEST:
            self[token] = k
        return k


HOT = CLASSES.index(LABEL_ODDS) + 1
N_CLASSES = len(CLASSES) + 1
N_CODES = N_CLASSES * 4


def token_codes(classes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Class, and which neighbours are hot, as one number for each token."""
    hot = classes >= HOT
    before, after = np.zeros_like(hot), np.zeros_like(hot)
    before[1:], after[:-1] = hot[:-1], hot[1:]
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[sizes > 0]
    before[starts] = False
    after[ends[sizes > 0] - 1] = False
    return classes * 4 + before * 2 + after


def code_features() -> np.ndarray:
    """(code, feature): what each code stands for."""
    out = np.zeros((N_CODES, N_CLASSES + 2))
    for code in range(N_CODES):
        out[code, code // 4] = 1
        out[code, N_CLASSES] = code >> 1 & 1
        out[code, N_CLASSES + 1] = code & 1
    return out


class Blocks:
    """Tokens of several documents in rows of BLOCK, each document beginning in a row of its own."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray) -> None:
        self.sizes = sizes
        rows = -(-sizes // BLOCK)
        self.first = np.cumsum(rows) - rows
        self.rows = rows
        start = np.repeat(self.first * BLOCK - (np.cumsum(sizes) - sizes), sizes)
        self.place = np.arange(len(codes)) + start
        pad = 2 * N_CODES
        flat = np.full(int(rows.sum()) * BLOCK, pad, dtype=np.int64)
        flat[self.place] = codes
        flat[self.first[sizes > 0] * BLOCK] += N_CODES  # a document's first token
        self.codes = flat.reshape(-1, BLOCK)

    def marginals(self, weights: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each token the probability of state 1; expected moves (0 to 1, 1 to 0, 1 to 1, started in 1)."""
        emit = np.exp(code_features() @ weights)
        table = np.zeros((2 * N_CODES + 1, 2, 2))
        move = np.exp(np.array([[0.0, moves[0]], [moves[1], moves[2]]]))
        table[:N_CODES] = move * np.stack([np.ones_like(emit), emit], 1)[:, None, :]
        table[N_CODES:-1, 0, 0], table[N_CODES:-1, 1, 1] = 1.0, emit
        table[-1] = np.eye(2)
        table /= table.max(axis=(1, 2), keepdims=True)
        n = len(self.codes)
        product = np.broadcast_to(np.eye(2), (n, 2, 2)).copy()
        for t in range(BLOCK):
            product = product @ table[self.codes[:, t]]
            product /= product.max(axis=(1, 2), keepdims=True)
        left, right = np.empty((n, 2)), np.empty((n, 2))
        start = np.array([1.0, np.exp(moves[3])])
        live = np.flatnonzero(self.rows > 0)
        state = np.tile(start / start.sum(), (len(live), 1))
        k = 0
        while len(live):
            at = self.first[live] + k
            left[at] = state
            state = np.einsum("bi,bij->bj", state, product[at])
            state /= state.sum(axis=1, keepdims=True)
            k += 1
            keep = self.rows[live] > k
            live, state = live[keep], state[keep]
        live = np.flatnonzero(self.rows > 0)
        k = 0
        state = np.full((len(live), 2), 0.5)
        while len(live):
            at = self.first[live] + self.rows[live] - 1 - k
            right[at] = state
            state = np.einsum("bij,bj->bi", product[at], state)
            state /= state.sum(axis=1, keepdims=True)
            k += 1
            keep = self.rows[live] > k
            live, state = live[keep], state[keep]
        before = np.empty((BLOCK, n, 2))
        state = left
        for t in range(BLOCK):
            before[t] = state
            state = np.einsum("bi,bij->bj", state, table[self.codes[:, t]])
            state /= state.sum(axis=1, keepdims=True)
        p, counts = np.empty((n, BLOCK)), np.zeros(4)
        state = right
        for t in range(BLOCK - 1, -1, -1):
            codes = self.codes[:, t]
            joint = before[t][:, :, None] * table[codes] * state[:, None, :]
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            p[:, t] = joint[:, :, 1].sum(axis=1)
            inner, first = codes < N_CODES, (codes >= N_CODES) & (codes < 2 * N_CODES)
            counts[:3] += joint[inner, 0, 1].sum(), joint[inner, 1, 0].sum(), joint[inner, 1, 1].sum()
            counts[3] += joint[first, 1, 1].sum()
            state = np.einsum("bij,bj->bi", table[codes], state)
            state /= state.sum(axis=1, keepdims=True)
        return p.reshape(-1)[self.place], counts


def fit_field(codes: np.ndarray, sizes: np.ndarray, toxic: np.ndarray, rounds: int = 120) -> tuple[np.ndarray, np.ndarray]:
    """Weights and moves. Tokens at or above HOT in toxic documents are the labelled ones."""
    y = (codes // 4 >= HOT) & np.repeat(toxic, sizes)
    blocks = Blocks(codes, sizes)
    features = code_features()
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[sizes > 0]
    inner = np.ones(len(codes), bool)
    inner[starts] = False
    y0, y1 = y[:-1][inner[1:]], y[1:][inner[1:]]
    seen_moves = np.array([(~y0 & y1).sum(), (y0 & ~y1).sum(), (y0 & y1).sum(), y[starts].sum()], float)
    seen = features.T @ np.bincount(codes, weights=y, minlength=N_CODES)
    theta = np.concatenate([np.full(N_CLASSES, -2.0), np.zeros(2), np.zeros(4)])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for i in range(1, rounds + 1):
        p, counts = blocks.marginals(theta[: N_CLASSES + 2], theta[N_CLASSES + 2 :])
        expected = features.T @ np.bincount(codes, weights=p, minlength=N_CODES)
        g = np.concatenate([seen - expected, seen_moves - counts]) - 0.5 * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + 0.3 * (1 - i / (rounds + 1)) * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    return theta[: N_CLASSES + 2], theta[N_CLASSES + 2 :]


def document_features(expected: np.ndarray, largest: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(sizes)), np.log1p(expected), largest, np.log1p(1000 * expected / np.maximum(sizes, 20))], 1)


def fit_document(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton's method, with a small penalty."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 0.1 * np.eye(x.shape[1])
        w = w + np.clip(np.linalg.solve(h, x.T @ (y - p) - 0.1 * w), -2, 2)
    return w


def tokens_of(texts: list[str], classes: Classes) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all tokens of all texts, and the number of tokens of each."""
    found = [TOKEN.findall(x) for x in texts]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    flat = np.fromiter((classes[w] for ws in found for w in ws), np.int64, int(sizes.sum()))
    return token_codes(flat, sizes), sizes


def by_document(p: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum and the largest of each document's marginals."""
    total, most = np.zeros(len(sizes)), np.zeros(len(sizes))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    np.add.at(total, owner, p)
    np.maximum.at(most, owner, p)
    return total, most


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = FIT_ROWS, field_rows: int = FIELD_ROWS, chars: int = FIELD_CHARS) -> Field | None:
    """The model, learned from labelled rows that aren't held out; None if they are all alike."""
    training = training_rows(docs, labels, id_col, text_col, rows)
    training = stored(training, "training")
    odds = {r.feature: r.odds for r in lexicon(training).collect()}
    if not odds:
        return None
    classes = Classes(odds)
    sample = _field_sample(training, field_rows, chars)
    codes, sizes = tokens_of([r.text for r in sample], classes)
    weights, moves = fit_field(codes, sizes, np.array([r.toxic == 1 for r in sample]))
    field = Field(odds, weights, moves, np.zeros(4))
    sums = _marginal_sums(training, field).collect()  # three numbers for each of at most FIT_ROWS rows
    x = document_features(*(np.array([r[k] for r in sums], float) for k in ("expected", "largest", "n")))
    field.document = fit_document(x, np.array([r.toxic == 1 for r in sums], float))
    return field


def _field_sample(training: DataFrame, rows: int, chars: int) -> list:
    """Labelled rows for the field, in the order of their ids' hashes, with at most so many characters in all: a row that
    would go beyond is left out as a whole. First only lengths reach the driver, then the texts that fit."""
    sizes = training.select("id", F.char_length("text").alias("size")).orderBy(F.xxhash64("id"), "id").limit(rows).collect()
    taken, total = [], 0
    for r in sizes:
        if total + r.size <= chars:
            taken.append(r.id)
            total += r.size
    return training.where(F.col("id").isin(taken)).orderBy(F.xxhash64("id"), "id").collect()


def _marginal_sums(rows: DataFrame, field: Field) -> DataFrame:
    schema = "toxic int, n long, expected double, largest double"
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = Classes(field.odds)
        for batch in batches:
            codes, sizes = tokens_of(batch.column(0).to_pylist(), classes)
            p, _ = Blocks(codes, sizes).marginals(field.weights, field.moves)
            total, most = by_document(p, sizes)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(sizes), pa.array(total), pa.array(most)], names=["toxic", "n", "expected", "largest"])

    return rows.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, schema)


def score_toxicity(docs: DataFrame, field: Field | None, text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1) and spans: array of start, end (code points) and probability of each toxic stretch."""
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("p", T.DoubleType())]))
    docs = docs.drop(*[c for c in docs.columns if c in ("score", "spans") and c != text_col])
    if field is None:
        return docs.withColumns({"score": F.lit(0.0), "spans": F.array().cast(span)})
    ship(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("spans", span)])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = Classes(field.odds)
        for whole in batches:
            step = max(1, (4 << 20) * whole.num_rows // max(1, whole.column(text_col).nbytes))
            for i in range(0, whole.num_rows, step):
                batch = whole.slice(i, step)
                texts = [x or "" for x in batch.column(text_col).to_pylist()]
                codes, sizes = tokens_of(texts, classes)
                p, _ = Blocks(codes, sizes).marginals(field.weights, field.moves)
                total, most = by_document(p, sizes)
                score = 1 / (1 + np.exp(-np.clip(document_features(total, most, sizes) @ field.document, -30, 30)))
                ends = np.cumsum(sizes)
                spans = [toxic_spans(x, p[e - n : e]) if m >= 0.5 else [] for x, e, n, m in zip(texts, ends, sizes, most, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array(spans, kind)], names=[*batch.schema.names, "score", "spans"])

    return docs.mapInArrow(run, schema)


def toxic_spans(text: str, p: np.ndarray) -> list[dict]:
    """Stretches of neighbouring tokens of 0.5 or more, with the largest marginal of each."""
    out: list[dict] = []
    last = -2
    for i, m in enumerate(TOKEN.finditer(text)):
        if p[i] >= 0.5:
            if last == i - 1:
                out[-1]["end"], out[-1]["p"] = m.end(), max(out[-1]["p"], float(p[i]))
            else:
                out.append({"start": m.start(), "end": m.end(), "p": float(p[i])})
            last = i
    return out


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with score and spans, by a model learned from labels (id, toxic)."""
    return score_toxicity(docs, fit_toxicity(docs, labels, id_col, text_col), text_col)
