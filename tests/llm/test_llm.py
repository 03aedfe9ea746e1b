"""The operators against their SQL, against brute force, and on odd rows."""

import binascii
import hashlib
import itertools
import math
import random
import re
import struct

import numpy as np
import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from foretable.llm import queries as q
from foretable.llm import secret_scan as secrets
from foretable.llm import toxicity as tox
from foretable.llm.common import Scratch, sized
from foretable.llm.components import connected_components
from foretable.llm.exact_dedup import exact_dedup
from foretable.llm.line_dedup import line_bitmaps, line_dedup
from foretable.llm.mixing import mix_sources
from foretable.llm.near_dedup import near_dedup, signatures
from foretable.llm.piece_encoding import Decoder, MergeModel, WordEncoder, encode_text, piece_encode, public_model
from foretable.llm.quality import quality_features, quality_rules, references
from foretable.llm.substring_dedup import substring_dedup
from foretable.llm.secret_scan import Rule, secret_scan, trigram_query
from foretable.llm.url_filter import UrlRule, url_filter

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, ids binary, n_words long, hash string, id long, kept_text string, spans string, digest string, key string"


def frame(spark, rows, schema=SCHEMA):
    """Documents (id, text, lang, source), with more columns whose names the operators use themselves."""
    names = schema.split(", ")
    return spark.createDataFrame([(*r, *[None] * (len(names) - len(r))) for r in rows], schema)


LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
ODD = [
    (1, None, None, None), (2, "", "en", "a"), (3, "   \n\t ", "en", "a"), (None, "a null id with ten words in it, or some more", "en", "b"), (4, LONG, "en", "a"), (5, LONG, "en", "b"),
    (6, "Same Line of Text\nand another", "de", "a"), (6, "Same Line of Text\nand another", "de", "a"), (7, "same line of text \nother things", "de", None), (8, "ÄÖ ÜSS ß 🙂 日本", "xx", "a"), (None, None, None, None),
]


def text(t):
    return t or ""


def words(t):
    return SPACE.findall(text(t))


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_equals_its_sql(name, spark, sf_dir, duck):
    assert same_rows(q.queries()[name](spark, sf_dir), duck, q.oracle_sql()[name])


OPERATORS = {
    "exact": lambda s, d: exact_dedup(d), "quality": lambda s, d: quality_rules(d), "mixing": lambda s, d: mix_sources(d, max_repetition=2.0), "secrets": lambda s, d: secrets.secret_scan(d), "lines": lambda s, d: line_dedup(d),
    "near": lambda s, d: near_dedup(d), "passages": lambda s, d: substring_dedup(d), "pieces": lambda s, d: piece_encode(d, public_model()),
    "toxic": lambda s, d: tox.toxicity(d, s.createDataFrame([(2, 0), (6, 1), (7, 0), (None, 1), (8, None)], "doc_id long, toxic int")),
    "urls": lambda s, d: url_filter(d.withColumnsRenamed({"doc_id": "page_id", "text": "url", "lang": "html"})),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_no_rows(name, spark):
    out = OPERATORS[name](spark, frame(spark, ODD))
    assert out.count() >= len(ODD) if name == "mixing" else out.count() == len(ODD)
    assert OPERATORS[name](spark, frame(spark, [])).count() == 0


def test_exact_dedup_keeps_the_smallest_id_and_sees_collisions(spark):
    rows = [(3, "One", "", ""), (1, "oNE", "", ""), (2, "two", "", ""), (None, "TWO", "", ""), (9, "É", "", ""), (8, "é", "", "")]
    want = {(3, 1, 2, False), (1, 1, 2, True), (2, 2, 2, True), (None, 2, 2, False), (9, 9, 1, True), (8, 8, 1, True)}
    for key in (None, lambda t: F.lit(b"same")):
        out = exact_dedup(frame(spark, rows), **({"content_hash": key} if key else {}))
        assert {tuple(r)[:4] for r in out.collect()} == want
    assert out.where("doc_id = 3").first().text_sha256 == hashlib.sha256(b"one").hexdigest()


def brute_lines(rows):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    first, docs = {}, {}
    for i, t in rows:
        for line in text(t).split("\n"):
            if len(key(line)) >= 10:
                first[key(line)] = min(i, first.get(key(line), i))
                docs.setdefault(key(line), set()).add(i)
    return {i: "\n".join(x for x in text(t).split("\n") if not (len(key(x)) >= 10 and len(docs[key(x)]) > 1 and first[key(x)] != i)) for i, t in rows}


def test_line_dedup_by_brute_force(spark):
    rng = random.Random(5)
    pool = [f"Line number {i} of the pool" for i in range(30)] + ["short", "", "  padded line here  ", "PADDED line here"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 150)))) for i in range(60)]
    for slices in (1, 64):
        out = {r.doc_id: r.kept_text for r in line_dedup(frame(spark, [(*r, "", "") for r in rows]), slices=slices).collect()}
        assert out == brute_lines(rows)
    one = line_bitmaps(frame(spark, [(1, "a repeated line\n" * 70, "", ""), (2, "b\n" * 66 + "a repeated line", "", "")])).collect()
    assert [(r.id, [(x.word, x.bits) for x in r.kept]) for r in one] == [(2, [(1, ~4)])]


def brute_near(rows):
    def shingles(t):
        w = words(text(t).translate(LOWER))
        return set(zip(*(w[i:] for i in range(5)), strict=False)) if len(w) >= 5 else ({tuple(w)} if w else set())

    sets, parent = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_near_dedup_by_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for g in range(12):
        base = [f"v{rng.randrange(400)}" for _ in range(rng.randrange(3, 90))]
        for _ in range(rng.randrange(1, 9)):
            w = list(base)
            for _ in range(rng.randrange(0, max(1, len(w) // 20))):
                w[rng.randrange(len(w))] = f"n{rng.randrange(9999)}"
            rows.append((len(rows), " ".join(w).title() if g % 2 else "  ".join(w)))
            base = w if g % 3 == 0 else base  # chains: each like the one before
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup(frame(spark, [(*r, "", "") for r in rows])).collect()}
    assert out == brute_near(rows)


def test_signatures_estimate_similarity_better_than_chance():
    rng = np.random.default_rng(0)
    off = []
    for _ in range(40):
        a = np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64))
        b = np.unique(np.concatenate([a[:200], rng.integers(0, 2**63, 100, dtype=np.uint64)]))
        s = signatures(np.concatenate([a, b]), np.array([len(a), len(b)]), 128)
        off.append((s[0] == s[1]).mean() - 0.5)
    assert abs(np.mean(off)) < 0.02 and np.std(off) < math.sqrt(0.25 / 128)


def brute_passages(rows, window):
    count = {}
    for _, t in rows:
        w = words(t)
        for i in range(len(w) - window + 1):
            count[tuple(w[i : i + window])] = count.get(tuple(w[i : i + window]), 0) + 1
    out = {}
    for i, t in rows:
        w = words(t)
        gone = {k for a in range(len(w) - window + 1) if count[tuple(w[a : a + window])] > 1 for k in range(a, a + window)}
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


@pytest.mark.parametrize("group", [1, 1024])
def test_substring_dedup_by_brute_force(spark, group):
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(40):
        w = [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 120))]
        if i % 3 == 0:
            a = rng.randrange(0, 30)
            w[5:5] = passage[a : a + rng.randrange(25, 60)]
        rows.append((i, " ".join(w)))
    rows += [(40, "In. " * 80), (41, rows[0][1]), (42, rows[3][1] + " tail"), (43, "x y " * 40), (44, None), (45, "lone " * 36)]
    out = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(frame(spark, [(*r, "", "") for r in rows]).drop("kept_text"), group=group).collect()}
    assert out == brute_passages(rows, 35)


def test_components_of_a_random_graph_and_a_long_path(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(150)] + [(5, 5), (None, 3)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got = connected_components(spark.createDataFrame(edges, "a long, b long").repartition(7), Scratch(spark, "test")).collect()
    assert {r.node: r.component for r in got} == {x: root(x) for x in parent} and len(got) == len(parent)


def test_trigram_queries():
    assign, access, runs = (secrets.trigram_query(r.pattern) for r in secrets.BASE)
    assert runs == [] and access == [{frozenset({"aki", "kia"})}]
    assert {frozenset({"tok", "oke", "ken"}), frozenset({"sec", "ecr", "cre", "ret"})} <= assign[0] and len(assign) == 1
    assert secrets.trigram_query("ab+cde?f") == [{frozenset({"cdf"}), frozenset({"cde", "def"})}] and secrets.trigram_query("ab+c") == []


def test_secrets_by_brute_force(spark):
    rng = random.Random(7)
    parts = ["token", "Password", "api_key", "apikey", "secret", "=", ":", " ", "'", '"', "abcdefghijkl", "ABC123", "AKIA", "IOSFODNN7EXAMPLE", "deadbeef", "0123456789abcdef", "é", "🙂", "\n", "ghp_" + "a1B2" * 9]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(0, 40)))) for i in range(300)]
    out = {r.doc_id: [(x.start, x.kind, x.end) for x in r.found] for r in secrets.secret_scan(frame(spark, [(*r, "", "") for r in rows])).collect()}
    rules = secrets.BASE + secrets.MORE
    for i, t in rows:
        want = sorted((m.start(), k, m.end()) for k, r in enumerate(rules) for m in re.finditer(r.pattern, t, re.ASCII | (re.IGNORECASE if r.any_case else 0)) if len(m[r.group]) >= r.least)
        assert out[i] == want, t


def test_quality_rejects_what_is_unlike_its_language(spark):
    rng = random.Random(1)
    common = "the of and to in a is that it for on was with as".split()
    prose = lambda: " ".join(rng.choice(common) if rng.random() < 0.5 else "w" + "".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(120))
    rows = [(i, prose(), "en", "a") for i in range(40)] + [(40, " ".join(w + "%%%$$$" for w in prose().split()), "en", "a"), (41, prose().upper(), "en", "a"), (42, "too short", "en", "a"), (43, "again and again we say it " * 30, "en", "a")]
    docs = frame(spark, rows)  # in a made-up language, whose references are learned from the texts themselves
    out = {r.doc_id: r for r in quality_rules(docs, known=references(quality_features(docs))).collect()}
    assert all(out[i].kept for i in range(40))
    assert not any(out[i].kept for i in range(40, 44)) and out[42].base_failed and out[43].base_failed and not out[40].base_failed


def test_mixing_meets_its_targets(spark):
    rows = [(i, " ".join(["w"] * (5 + i % 7)), "en", "big" if i % 10 else f"small{i % 30}") for i in range(3000)]
    docs = frame(spark, rows).select("doc_id", "text", "source")
    shares = {}
    for i, t, _, s in rows:
        shares[s] = shares.get(s, 0) + len(words(t))
    total = sum(shares.values())
    twice = mix_sources(docs, max_repetition=2.0).collect()
    assert {r.doc_id for r in twice} == {r[0] for r in rows}  # nothing is lost
    used = {}
    for r in twice:
        used[r.source] = used.get(r.source, 0) + len(words(r.text))
    passes = {s: used[s] / shares[s] for s in shares}
    assert passes["big"] == pytest.approx(1, abs=1e-9) and max(passes.values()) == pytest.approx(2, abs=0.05)
    goal, budget = 1.2, total // 2
    mixed = mix_sources(docs, target_entropy=goal, budget_tokens=budget).collect()
    used = {}
    for r in mixed:
        used[r.source] = used.get(r.source, 0) + len(words(r.text))
    weights = [v / sum(used.values()) for v in used.values()]
    assert sum(used.values()) == pytest.approx(budget, rel=0.02)
    assert -sum(w * math.log(w) for w in weights) == pytest.approx(goal, abs=0.03)
    early = [r for r in mixed if r.mix_position < 0.3]
    assert sum(r.source == "big" for r in early) / len(early) == pytest.approx(sum(r.source == "big" for r in mixed) / len(mixed), abs=0.1)
    assert sorted(map(tuple, mixed)) == sorted(map(tuple, mix_sources(docs.repartition(7), target_entropy=goal, budget_tokens=budget).collect()))


def test_mixing_gives_the_same_however_its_passes_travel(spark, monkeypatch):
    docs = frame(spark, [(i, "w " * (1 + i % 5), "en", None if i % 9 == 0 else "big" if i % 4 else "small") for i in range(500)])
    few = mix_sources(docs, max_repetition=3.0)
    assert "BroadcastHashJoin" in few._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr("foretable.llm.mixing.sized", lambda keys: sized(keys, 1))
    many = mix_sources(docs, max_repetition=3.0)
    assert "SortMergeJoin" in many._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(repr, few.collect())) == sorted(map(repr, many.collect()))


def test_lines_give_the_same_in_more_slices(spark, monkeypatch):
    docs = frame(spark, [(i, f"a line that all have\nline of pair {i // 2}\nonly of {i}", "", "") for i in range(300)])
    once = sorted(map(tuple, line_dedup(docs).collect()))
    monkeypatch.setattr("foretable.llm.line_dedup.SLICE_ROWS", 5)
    assert sorted(map(tuple, line_dedup(docs).collect())) == once
    assert sum(r[-2] for r in once) == 299 + 150


def test_models_that_change_texts_are_refused(monkeypatch):
    import sentencepiece

    monkeypatch.setattr(sentencepiece.SentencePieceProcessor, "normalize", lambda self, text: " ".join(text.split()))
    with pytest.raises(ValueError, match="leaves texts as they are"):
        MergeModel(public_model())


def test_encoding_equals_the_library(spark):
    import sentencepiece

    model = MergeModel(public_model())
    encoder, decoder = WordEncoder(model), Decoder(model)
    sp = sentencepiece.SentencePieceProcessor(model_file=public_model())
    rng = random.Random(9)
    texts = ["", " ", "  a  b ", "▁▁x", "<s>", "<0x0A>", "\x00a", LONG[:3000]]
    texts += ["".join(rng.choice("abcdefgthe  \n\t.,éüß▁日本🙂<>0x s") for _ in range(rng.randrange(50))) for _ in range(3000)]
    ends = struct.pack("<I", 1), struct.pack("<I", 2)
    for t in texts:
        packed, want = encode_text(encoder, t, ends), sp.encode(t, add_bos=True, add_eos=True)
        assert list(struct.unpack(f"<{len(packed) // 4}I", packed)) == want, t
        assert decoder(packed) == sp.decode(want), t
    out = piece_encode(frame(spark, [(1, "ab c", "", ""), (2, None, "", "")]), public_model()).orderBy("doc_id").collect()
    assert [bytes(r.ids) for r in out] == [encode_text(encoder, "ab c", ends), b"".join(ends)] and [r.decoded for r in out] == ["ab c", ""]


def brute_marginals(codes, weights, moves):
    """All state sequences of one short document."""
    emit = tox.code_features() @ weights
    total, ones = 0.0, np.zeros(len(codes))
    for states in itertools.product((0, 1), repeat=len(codes)):
        score = moves[3] * states[0] + sum(emit[c] * s for c, s in zip(codes, states, strict=True))
        score += sum({(0, 1): moves[0], (1, 0): moves[1], (1, 1): moves[2]}.get(p, 0.0) for p in itertools.pairwise(states))
        total += math.exp(score)
        ones += math.exp(score) * np.array(states)
    return ones / total


def test_marginals_by_brute_force():
    rng = np.random.default_rng(4)
    weights, moves = rng.normal(size=tox.N_CLASSES + 2), rng.normal(size=4)
    sizes = np.array([3, 0, 1, 10, 2])
    codes = rng.integers(0, tox.N_CODES, sizes.sum())
    p, _ = tox.Blocks(codes, sizes).marginals(weights, moves)
    at = 0
    for n in sizes:
        if n:
            assert p[at : at + n] == pytest.approx(brute_marginals(codes[at : at + n], weights, moves))
        at += n
    long = rng.integers(0, tox.N_CODES, 1000)  # over many blocks: the same as one recursion from end to end
    p, _ = tox.Blocks(long, np.array([1000])).marginals(weights, moves)
    emit, move = np.exp(tox.code_features() @ weights), np.exp(np.array([[0, moves[0]], [moves[1], moves[2]]]))
    f, b = [np.array([1.0, np.exp(moves[3]) * emit[long[0]]])], [np.ones(2)]
    for c in long[1:]:
        x = (f[-1] @ move) * np.array([1.0, emit[c]])
        f.append(x / x.sum())
    for c in long[:0:-1]:
        x = move @ (b[-1] * np.array([1.0, emit[c]]))
        b.append(x / x.sum())
    want = np.array([x * y for x, y in zip(f, b[::-1], strict=True)])
    assert p == pytest.approx(want[:, 1] / want.sum(axis=1))


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(6)
    calm, bad = [f"calm{i}" for i in range(200)], ["vile", "rotten", "foul"]
    rows, labels = [], []
    for i in range(900):
        w = [rng.choice(calm) for _ in range(rng.randrange(5, 80))]
        if toxic := i % 5 == 0:
            for _ in range(rng.randrange(1, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(bad).title())
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs = frame(spark, [(*r, "", "") for r in rows]).select("doc_id", "text")
    out = tox.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [r for r in out if binascii.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(held) > 200 and all((r.score >= 0.7) == (r.doc_id % 5 == 0) for r in held)
    for r in held[:50]:
        assert [r.text[s.start : s.end] for s in r.spans] == [m[0] for m in re.finditer(r"(Vile|Rotten|Foul)( (Vile|Rotten|Foul))*", r.text)]
    flags = docs.select("doc_id", tox.held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r.h == (binascii.crc32(str(r.doc_id).encode()) % 3 == 1) for r in flags)


def test_urls_and_their_aliases(spark):
    page = lambda i, url, html="": (i, url, html)
    link = '<html><LINK href="https://bad.net/es/x" rel="canonical"></html>'
    rows = [
        page(1, "https://www.Example.com/en/a?q=1"), page(2, "http://example.com/en/a"), page(3, "http://notexample.com/en/"), page(4, "http://a.net/es/x#f"), page(5, "http://b.org/x", link), page(6, "http://b.org/x/?utm_source=u"),
        page(7, None), page(8, "no scheme"), page(9, "http://c.org/y"), page(10, "ftp://net/fr/"), page(11, "http://com"), page(12, "https://bad.net/es/x"), page(13, "http://ok.com/z", link), page(14, "http://d.org/1"), page(15, "http://d.org/2"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    redirects = spark.createDataFrame([("http://d.org/1", "http://d.org/2"), ("http://d.org/2", "http://a.net/es/x#f"), (None, "http://c.org/y")], "f string, t string")
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter(pages, redirects=redirects).collect()}
    assert out[1] == ("www.example.com", "/en/a", "www.example.com/en/", "allow") and out[2][2:] == ("example.com/en/", "block") and out[3][2:] == ("com/", "allow")
    assert out[4][2:] == ("net/es/", "block") and out[5][2:] == (None, "block") and out[6][2:] == (None, "block") and out[9][2:] == (None, "allow")
    assert out[7] == out[8] == ("", "", None, "allow") and out[10][2:] == ("net/fr/", "block") and out[11] == ("com", "", None, "allow")
    assert out[13][2:] == ("com/", "allow") and out[14][3] == out[15][3] == "block"


def test_a_blocked_target_that_is_no_page_blocks_its_aliases(spark):
    rows = [
        (1, "http://b.org/canonical", '<link rel="canonical" href="https://bad.net/es/x">'), (2, "http://b.org/refresh", '<meta http-equiv="refresh" content="0; url=https://bad.net/fr/y">'),
        (3, "http://b.org/from", ""), (4, "http://b.org/to", ""), (5, "http://b.org/free", '<link rel="canonical" href="https://ok.net/en/x">'), (6, "http://b.org/www", '<link rel="canonical" href="https://www.example.com/en/x">'),
        (7, "http://ok.com/z", '<link rel="canonical" href="https://bad.net/es/x">'),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    redirects = spark.createDataFrame([("http://b.org/from", "http://bad.net/es/z"), ("http://example.com/en/old", "http://b.org/to")], "f string, t string")
    out = {r.page_id: r.verdict for r in url_filter(pages, redirects=redirects).collect()}
    assert out == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "allow"}
    assert {r.verdict for r in url_filter(pages.where("page_id IN (3, 4)")).collect()} == {"allow"}


def test_every_form_of_a_declared_target_counts(spark):
    link = lambda href, more="": f"{more}<link rel=canonical href={href}>"
    refresh = lambda content: f"<meta http-equiv=refresh content={content}>"
    forms = [
        link("/en/goal"), link("'/en/goal'"), link('"//b.org/en/goal"'), link('"goal"'), link("./goal"), link('"../en/goal"'), link('"/x/../en/./goal#f"'), link("goal", '<base href="/en/">'), link("http://b.org/en/goal"),
        '<link data-href="/no" href="/en/goal" rel="nofollow Canonical">', "<link title=\"a rel='x' href='/no'\" rel='canonical'href='/en/goal' />",
        refresh("\"0; url='https://b.org/en/goal'\""), refresh("'0;URL=\"/en/goal\"'"), refresh('"5, goal"'), refresh('"0;url = //b.org/en/goal"'), refresh("0;url=/en/goal"), refresh("url=goal"),
    ]
    no = [link('"#goal"'), link('""'), link('"mailto:x@b.org"'), refresh("5"), '<link rel="alternate" href="/en/goal">']
    rows = [(i, f"http://b.org/en/from{i}", html) for i, html in enumerate(forms + no)]
    bad = (UrlRule("b.org", "/en/goal", "block"),)
    pages = spark.createDataFrame([*rows, (99, "http://b.org/en/page?id=1", '<link rel="canonical" href="?id=2">'), (98, "http://b.org/en/page?id=2", link("/en/goal"))], "page_id long, url string, html string")
    out = {r.page_id: r.verdict for r in url_filter(pages, bad).collect()}
    assert {i for i in out if out[i] == "block"} == {*range(len(forms)), 98, 99}
    redirects = spark.createDataFrame([("http://c.org/a/b", "../goal"), ("http://c.org/x", "/a/y"), ("c.org/no", "http://b.org/en/goal"), ("http://c.org/z", "mailto:x@c.org")], "f string, t string")
    pages = spark.createDataFrame([(i, f"http://c.org/{x}", None) for i, x in enumerate(("a/b", "x", "z", "goal"))], "page_id long, url string, html string")
    assert {r.page_id: r.verdict for r in url_filter(pages, (UrlRule("c.org", "/goal", "block"),), redirects).collect()} == {0: "block", 1: "allow", 2: "allow", 3: "block"}


@pytest.mark.parametrize(("pattern", "text"), [("[!-~]key", "a {key"), ("[\u0400-\u04ff]key", "a \u04ffkey")])
def test_wide_ranges_are_never_cut(pattern, text, spark):
    assert trigram_query(pattern) == [{frozenset({"key"})}]
    out = secret_scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), more=(Rule("wide", pattern),)).first()
    assert [(s.start, s.end) for s in out.found] == [(2, 6)]
