"""Scanning texts for secrets through an inverted index of trigrams, in DataFrame operations only.

From the syntax tree of each rule's pattern comes a Boolean query: every match contains, for each stretch of literals,
all trigrams of one of the stretch's alternatives. The index is a table of postings (trigram, document) for the trigrams that
any query names: one pass over each lower-cased text reads off, at every place, the trigram that begins there. Lists of
postings are intersected by document, those of a query's rarest trigrams first, as they are the shortest; that gives
candidates, which are then verified with the pattern itself. A rule whose pattern forces no trigram (a run of hexadecimal
digits) scans every text. Lower case can only add candidates.

Positions of matches are running sums of the lengths of matches and of what lies between them. They are added up in
stretches of STRETCH, and stretches are then moved by the sums before them, so that the work grows with the number of
matches in a text, however many there are.

Texts are read twice and are not exchanged as long as the candidates are few (common.sized counts them): the first pass
finds which of the queries' trigrams a text holds, and the spans of the rules that scan fully; the second verifies the
candidates. Postings, candidates and spans carry the document's id and a fingerprint of its text, no text. Joins match
that pair, of which no value is more frequent than the same document repeated.

Edge cases: null text is the empty text and has no secrets. Null and repeated ids are fine: verification reads each
row's own text. Columns of the input other than id and text are dropped. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretable.llm.common import Scratch, sized, text_or_empty

#: A stretch of literals is cut where it would have more alternatives than this.
ALTERNATIVES = 64
#: Lengths that are added up at a time.
STRETCH = 128


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # whose length counts
    least: int = 0  # characters that it has at least
    any_case: bool = False

    @property
    def regex(self) -> str:
        return f"(?i){self.pattern}" if self.any_case else self.pattern


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, any_case=True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("private", r"-----BEGIN[A-Z\x20]*PRIVATE\x20KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)


def trigram_query(pattern: str) -> list[set[frozenset[str]]]:
    """What a match must contain: of each list entry one set, and of that set all trigrams. Empty: nothing is certain."""
    from re import _constants as C
    from re import _parser

    query: list[set[frozenset[str]]] = []

    def close(run: set[str]) -> None:
        options = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run}
        if frozenset() not in options:
            query.append({o for o in options if not any(p < o for p in options)})

    def strings(items) -> set[str] | None:
        """All strings that a sequence can match, if they are few; what isn't literal gives None."""
        run = {""}
        for op, arg in items:
            more = one(op, arg)
            if more is None or len(run) * len(more) > ALTERNATIVES:
                return None
            run = {a + b for a, b in product(run, more)}
        return run

    def one(op, arg) -> set[str] | None:
        if op is C.LITERAL:
            return {chr(arg).lower()}
        if op is C.IN:
            found: set[str] = set()
            for kind, x in arg:
                if kind is C.LITERAL:
                    found.add(chr(x).lower())
                elif kind is C.RANGE:
                    if x[1] - x[0] >= ALTERNATIVES:
                        return None
                    found |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
                else:
                    return None
            return found if len(found) <= ALTERNATIVES else None
        if op is C.SUBPATTERN:
            return strings(arg[3])
        if op is C.BRANCH:
            parts = [strings(x) for x in arg[1]]
            return None if None in parts else set().union(*parts)
        if op is C.MAX_REPEAT and arg[1] == 1:
            inner = strings(arg[2])
            return None if inner is None else inner | ({""} if arg[0] == 0 else set())
        return None

    def walk(items) -> None:
        run = {""}
        for op, arg in items:
            more = one(op, arg)
            if more is not None and len(run) * len(more) <= ALTERNATIVES:
                run = {a + b for a, b in product(run, more)}
                continue
            close(run)
            run = {""}
            if op is C.SUBPATTERN:
                walk(arg[3])
            elif more is not None:
                run = more
        close(run)

    walk(_parser.parse(pattern))
    return query


def held_trigrams(text: Column, trigrams: list[str]) -> Column:
    """Those of the trigrams given that lower-cased text holds: a document's entries of the index. One scan: a look-ahead, so
    that trigrams may overlap, with one branch for each first character."""
    first = lambda c: "|".join(re.escape(t[1:]) for t in trigrams if t[0] == c)
    branches = "|".join(f"{re.escape(c)}(?:{first(c)})" for c in sorted({t[0] for t in trigrams}))
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"(?=({branches}))"), F.lit(1)))


def candidates(postings: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(id, print, rules): the kinds whose query a document's postings meet, for documents that meet any. postings: trigram, id,
    print. Documents without any of the rarest trigrams of an alternative need no intersection."""
    length = {r["trigram"]: r["count"] for r in postings.groupBy("trigram").count().collect()}  # as many as the queries name
    rarest = {min(sorted(need), key=lambda t: length.get(t, 0)) for r in rules for options in trigram_query(r.pattern) for need in options}
    short = postings.where(F.col("trigram").isin(sorted(rarest))).select("id", "print").distinct()
    held = postings.join(short.select(F.col("id").alias("of"), F.col("print").alias("as")), F.col("id").eqNullSafe(F.col("of")) & (F.col("print") == F.col("as")), "left_semi")
    held = held.groupBy("id", "print").agg(F.collect_set("trigram").alias("held"))
    has_all = lambda need: F.size(F.array_intersect("held", F.array(*map(F.lit, sorted(need))))) == len(need)

    def meets(rule: Rule) -> Column:
        found = F.lit(True)
        for options in trigram_query(rule.pattern):
            some = F.lit(False)
            for need in sorted(options, key=sorted):
                some = some | has_all(need)
            found = found & some
        return found

    return held.select("id", "print", F.array_compact(F.array(*(F.when(meets(r), F.lit(r.kind)) for r in rules))).alias("rules")).where(F.size("rules") > 0)


def with_value(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is made once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def running_sums(lengths: Column) -> Column:
    """Of an array of numbers that isn't empty, the sum up to each: array<int>."""
    none, last = F.array().cast("array<int>"), lambda a: F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0))
    added = lambda xs: F.aggregate(xs, none, lambda done, x: F.array_append(done, last(done) + x))
    in_stretches = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / STRETCH).cast("int")), lambda k: added(F.slice(v, k * STRETCH + 1, F.lit(STRETCH))))
    before = lambda parts: F.concat(F.array(F.lit(0)), added(F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), last)))
    moved = lambda parts: F.flatten(F.zip_with(parts, before(parts), lambda part, off: F.transform(part, lambda x: x + off)))
    return with_value(lengths, lambda v: with_value(in_stretches(v), moved))


def spans(text: Column, rule: Rule) -> Column:
    """array<struct<start, end, counted>> of the leftmost matches that do not overlap, without those that are too short; start
    and end in code points."""
    regex = F.lit(rule.regex)
    whole = F.regexp_extract_all(text, regex, F.lit(0))
    counted = F.regexp_extract_all(text, regex, F.lit(rule.group)) if rule.group else whole
    sizes = F.zip_with(whole, counted, lambda w, c: F.struct(F.length(w).alias("whole"), F.length(c).alias("counted")))
    steps = lambda s: F.zip_with(F.transform(F.slice(F.split(text, rule.regex, -1), F.lit(1), F.size(s)), F.length), s, lambda gap, m: gap + m["whole"])
    placed = lambda s: F.zip_with(s, running_sums(steps(s)), lambda m, end: F.struct((end - m["whole"]).alias("start"), end.alias("end"), m["counted"].alias("counted")))
    none = F.array().cast("array<struct<start:int,end:int,counted:int>>")
    return F.filter(with_value(sizes, lambda s: F.when(F.size(s) > 0, placed(s)).otherwise(none)), lambda s: s["counted"] >= rule.least)


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: tuple[Rule, ...] = MORE) -> DataFrame:
    """(id, found): found is array<struct<start, kind, end>> in order of start, then of the rules; kind is the number of
    the rule in BASE + more."""
    rules = BASE + more
    scratch = Scratch(docs.sparkSession, "secrets")
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).withColumn("print", F.xxhash64("text"))
    indexed = tuple(r for r in rules if trigram_query(r.pattern))
    trigrams = sorted({t for r in indexed for options in trigram_query(r.pattern) for need in options for t in need})
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def found(rule: Rule, maybe: Column) -> Column:
        # any match is long enough for this one if the pattern is a single run: it saves the short matches' positions
        run = re.fullmatch(r"(\[[^\]]+\])\+", rule.pattern)
        verify = Rule(rule.kind, f"{run[1]}{{{rule.least},}}") if run else rule
        hit = F.when(maybe & F.rlike("text", F.lit(verify.regex)), spans(F.col("text"), verify))
        return F.coalesce(F.transform(hit, lambda s: F.struct(s["start"].alias("start"), F.lit(rules.index(rule)).alias("kind"), s["end"].alias("end"))), none)

    full = F.concat(none, *(found(r, F.lit(True)) for r in rules if r not in indexed))
    scanned = scratch.store(rows.select("id", "print", held_trigrams(F.col("text"), trigrams).alias("trigrams"), full.alias("full")), "scanned")
    postings = scratch.store(scanned.select("id", "print", F.explode("trigrams").alias("trigram")), "postings")
    chosen = scratch.store(candidates(postings, indexed).select(F.col("id").alias("of"), F.col("print").alias("as"), "rules"), "candidates")
    pair = F.col("id").eqNullSafe(F.col("of")) & (F.col("print") == F.col("as"))
    verified = rows.join(sized(chosen), pair).select("of", "as", F.concat(none, *(found(r, F.array_contains("rules", r.kind)) for r in indexed)).alias("more"))
    verified = scratch.store(verified.where(F.size("more") > 0).dropDuplicates(["of", "as"]), "verified")
    scratch.drop("candidates", "postings")
    out = scanned.join(verified, pair, "left")
    return out.select(F.col("id").alias(id_col), F.sort_array(F.concat("full", F.coalesce("more", none))).alias("found"))


def written(found: Column, rules: tuple[Rule, ...] = BASE + MORE) -> Column:
    """kind:start:end of all spans, joined by commas."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")
