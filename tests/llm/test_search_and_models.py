"""Whitening, language identification and ranked search against brute force, and on odd rows."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F
from test_llm import ODD, frame

from foretable.llm import language_id as li
from foretable.llm import lexical_search as ls
from foretable.llm import queries as q
from foretable.llm.whitening import lobpcg, whiten

D = f"{DATA}/sf0.001"
NAN, INF = float("nan"), float("inf")


def spectrum(x):
    n = len(x)
    y = x - x.sum(axis=0) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    return y, values[::-1], vectors[:, ::-1]


def check_whitened(rows, vectors, id_of, d, k):
    """rows: what came out; vectors: (id, entries) of the rows that are whole."""
    x = np.array([np.floor(256 * np.array(v, np.float64)) for _, v in vectors]).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    _, values, directions = spectrum(fit)
    k = min(k, int((values > 1e-12 * values[0]).sum())) if values[0] > 0 else 0
    z = (x - sums / n) @ directions[:, :k] / np.sqrt(values[:k])
    assert len(rows) == len(x) * k
    theirs = defaultdict(list)
    for (i, _), row in zip(vectors, z, strict=True):
        theirs[i].append(row)
    seen = defaultdict(lambda: np.zeros(k))
    for r in rows:
        seen[r[id_of]][r.component - 1] += r.whitened
        assert r.n == n and r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9) and abs(r.identity_error) < 1e-9
    turned = np.sign(sum(np.sum(theirs[i], axis=0) * seen[i] for i in theirs))
    for i in theirs:
        assert np.allclose(np.sum(theirs[i], axis=0) * turned, seen[i], atol=1e-8)
    exact = {i: sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True)) for (i, _), row in zip(vectors, x, strict=True)}
    assert all(r.deviation == exact[r[id_of]] for r in rows)


def test_op11_equals_a_dense_decomposition_of_the_whole_table(spark):
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{D}/embeddings.parquet").collect()]
    check_whitened(q.op11_embedding_whitening(spark, D).collect(), vectors, "vec_id", 64, 4)


def test_lobpcg_certifies_many_dimensions():
    rng = np.random.default_rng(1)
    turn = np.linalg.qr(rng.standard_normal((300, 300)))[0]
    values = np.r_[50.0, 49.9, 20.0, 19.0, np.linspace(10, 0, 296)]
    dense = (turn * values) @ turn.T
    found = lobpcg(lambda b: dense @ b, 300, 4)
    assert np.allclose(found.values, values[:4]) and found.residuals.max() < 1e-9
    assert np.allclose(np.abs((found.vectors * turn[:, :4]).sum(axis=0)), 1)


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(2)
    good = [(i, [float(v) for v in rng.standard_normal(5)], "x", 1, 2) for i in range(40)]
    copies = [(7, good[7][1], None, 1, 2)] * 300 + [(None, good[3][1], None, 1, 2), (100, [-0.0, 0.0, 1e-9, -1e-9, 3.0], None, None, None)]
    odd = [(200, None, "", 1, 1), (201, [1.0, None, 2.0, 3.0, 4.0], "", 1, 1), (202, [NAN, 1.0, 1.0, 1.0, 1.0], "", 1, 1), (203, [INF, 1.0, 1.0, 1.0, 1.0], "", 1, 1), (204, [1.0, 2.0], "", 1, 1), (205, [], "", 1, 1)]
    schema = "id long, x array<double>, text string, component int, n long"
    out = whiten(spark.createDataFrame(good + copies + odd, schema), "id", "x", 3).collect()
    check_whitened(out, [(r[0], r[1]) for r in good + copies], "id", 5, 3)
    assert whiten(spark.createDataFrame([], schema), "id", "x").collect() == []
    assert whiten(spark.createDataFrame(odd[:4], schema), "id", "x").collect() == []
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0], "", 1, 1)] * 3, schema), "id", "x").collect() == []
    line = [(i, [float(i), 2.0 * i], "", 1, 1) for i in range(9)]
    check_whitened(whiten(spark.createDataFrame(line, schema), "id", "x").collect(), [r[:2] for r in line], "id", 2, 4)
    far = whiten(spark.createDataFrame([(i, [1e12 * i, float(i * i)], "", 1, 1) for i in range(5)], schema), "id", "x", 1).collect()
    assert len(far) == 5 and any(r.deviation is None for r in far)


def plain_bits(counts, text, order):
    """Code length by method C with exclusion, byte by byte; counts: context to Counter of bytes."""
    total = 0.0
    for i, b in enumerate(text):
        gone, bits = set(), 0.0
        k = max(k for k in range(min(order, i) + 1) if text[i - k : i] in counts or k == 0)
        for k in range(k, -1, -1):
            left = {x: n for x, n in counts[text[i - k : i]].items() if x not in gone}
            uses = sum(left.values()) + len(left)
            if b in left:
                total += bits + math.log2(uses / left[b])
                break
            if left:
                bits += math.log2(uses / len(left))
            gone |= left.keys()
        else:
            total += bits + math.log2(256 - len(gone))
    return total


@pytest.fixture(scope="module")
def small_trees(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat sat on the mat", "en"), ("the dog ate the hat", "en"), ("der hund und die katze", "de"), ("die maus und der käse", "de"), ("a", "fr")] * 12)]
    return rows, li.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), min_uses=2)


def test_code_lengths_are_exact(small_trees):
    rows, trees = small_trees
    learned = [(t.encode(), lang) for i, t, lang in rows if __import__("zlib").crc32(str(i).encode()) % 3 != 1]
    counts = {lang: defaultdict(Counter) for lang in trees.languages}
    for t, lang in learned:
        for i, b in enumerate(t):
            for k in range(min(i, li.ORDER) + 1):
                counts[lang][t[i - k : i]][b] += 1
    uses = Counter()
    for of in counts.values():
        for c, found in of.items():
            uses[c] += sum(found.values())
    for of in counts.values():
        for c in [c for c in of if c and uses[c] < 2]:
            del of[c]
    texts = [b"the cat", b"", b"zebra \x01", "käse und brot".encode(), b"der the der", b"x" * 9, *(bytes([b]) for b in range(255))]
    found = li.code_lengths(texts, trees)
    for t, bits in zip(texts, found, strict=True):
        for lang, x in zip(trees.languages, bits, strict=True):
            assert x == pytest.approx(plain_bits(counts[lang], t, li.ORDER), abs=1e-9), (t, lang)
    # one byte of all 256 comes next with certainty: 0xFF, which no text holds, costs what any unseen byte costs
    for i in range(len(trees.languages)):
        p = np.exp2(-found[6:, i])
        assert p.sum() + p.min() == pytest.approx(1)


def test_long_texts_cost_the_sum_of_their_steps(small_trees, monkeypatch):
    trees = small_trees[1]
    texts = [random.Random(i).choice([b"the cat and ", b"der hund "]) * (i * 7) for i in range(12)]
    whole = li.code_lengths(texts, trees)
    monkeypatch.setattr(li, "STEP", 50)
    assert np.allclose(whole, li.code_lengths(texts, trees))


def test_op12_predicts_held_out_languages(spark):
    d = f"{DATA}/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    out = q.op12_language_id(spark, d).collect()
    assert sorted(r.doc_id for r in out) == sorted(docs)
    assert all(0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out]
    assert len(held) > 250 and sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.98 * len(held)


def test_language_of_odd_rows(spark, small_trees):
    rows, _ = small_trees
    schema = "doc_id long, text string, lang string, score string, lang_pred int, key long, __lower string"
    odd = [(900, None, "en"), (901, "", "en"), (902, "12 34 !?", "en"), (903, "THE CAT", None), (None, "the hat", "de"), (904, "der hund", "xx"), (904, "der hund", "xx"), (905, "the mat " * 60_000, None)]
    docs = spark.createDataFrame([(*r, "old", 1, 2, "mine") for r in rows + odd], schema)
    out = li.language_id(docs).collect()
    assert len(out) == len(rows) + len(odd) and all(r["__lower"] == "mine" and r.key == 2 for r in out)
    by = {r.doc_id: r for r in out}
    assert [(by[i].lang_pred, by[i].score, by[i].bits) for i in (900, 901, 902)] == [("und", 0.0, None)] * 3
    assert by[903].lang_pred == by[905].lang_pred == by[None].lang_pred == "en" and by[904].lang_pred == "de"
    assert li.language_id(docs.limit(0)).collect() == []
    nothing = li.language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_search(docs, items, k=20):
    """docs, items: (id, text). Rows (item, rank, score) and, of each, the ids that may stand there."""
    held = [(i, Counter(ws), len(ws)) for i, t in docs for ws in [TERM.findall((t or "").translate(LOWER))]]
    total, length = sum(n > 0 for *_, n in held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    rows = []
    for item, text in items:
        found = []
        for i, c, n in held:
            m = 100 - 25 + (25 * n * total) // max(length, 1)
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in TERM.findall((text or "").translate(LOWER)) if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        rows += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(found)[:k], 1)]
    return sorted(rows, key=repr)


def searched(out, item="item_id"):
    return sorted(((r[item], r["rank"], r.doc_id, r.score) for r in out.collect()), key=repr)


def test_search_over_several_shards_with_ties_and_copies(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)] + ["é", "ÉTÉ", "x9", "日本"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 9)))) for i in range(6_000)]
    docs += [(i, "w1 W2 w3, w3") for i in range(20_000, 17_000, -1)] + [(-1, "w1 w2\x00w3-w3")]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 12)))) for i in range(25)] + [(99, "w1 w2 w3 w3"), (98, "nothing known"), (97, "")]
    got = ls.lexical_search(frame(spark, [(i, t, None, None) for i, t in docs]), spark.createDataFrame(items, "item_id long, text string"))
    assert searched(got) == brute_search(docs, items)
    blocks = ls.lexical_search(frame(spark, [(i, t, None, None) for i, t in docs]), spark.createDataFrame(items[:6], "item_id long, text string"), k=3, item_chars=60)
    assert searched(blocks) == brute_search(docs, items[:6], 3)


def test_best_first_opens_what_may_tie_and_skips_the_rest():
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 6, 5_000)
    level = ls.Level(np.r_[0, np.cumsum(sizes)], np.concatenate([rng.choice(50, n, replace=False) for n in sizes]), rng.integers(1, 9, sizes.sum()))
    levels = ls.tree(level)
    assert len(levels) == 5 and len(levels[-1].starts) == 2
    for _ in range(20):
        uses = np.zeros(50, np.int64)
        uses[rng.choice(50, 6, replace=False)] = rng.integers(1, 3, 6)
        scores = level.bounds(uses, 0, 5_000)
        least = np.sort(scores)[-20]
        assert sorted(ls.best_documents(levels, uses, 0, 20)) == sorted((int(scores[i]), int(i)) for i in np.flatnonzero(scores >= max(least, 1)))
        assert ls.best_documents(levels, uses, int(scores.max()) + 1, 20) == []


def test_search_on_odd_rows(spark):
    items = [(1, "ten words"), (1, "ten words"), (None, "line of text"), (3, None), (4, "%%%"), (5, "w1x1 unknown")]
    asked = spark.createDataFrame([(*r, "t", 5, 1) for r in items], "item_id long, text string, term string, score long, rank int")
    docs = frame(spark, ODD)
    assert searched(ls.lexical_search(docs, asked)) == brute_search([r[:2] for r in ODD], items)
    assert ls.lexical_search(docs.limit(0), asked).collect() == []
    empty = ls.lexical_search(docs, asked.limit(0))
    assert empty.collect() == [] and empty.columns == ["item_id", "rank", "doc_id", "score"]
    same = ls.lexical_search(docs, docs, item_col="doc_id", k=1)
    assert same.columns == ["doc_id", "rank", "doc_id_", "score"] and same.count() == 7
