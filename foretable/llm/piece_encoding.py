"""Encoding and decoding with a merge-type (BPE) SentencePiece model, exactly as the library does it.

The greedy merges of such a model have one result, and a sequence of pieces is that result exactly when every two
neighbours are: if re-merging the concatenation of two adjacent pieces would join anything across their border, the
pair is impossible. So encoding is a search from left to right. An Aho-Corasick automaton gives the longest piece at
each position; a piece is taken if it fits the one before; else the next shorter piece is tried, and when none is left
the position is marked as failed in a bitfield and the last piece is given up. A marked position is never tried again,
so the search is linear.

Pieces cross no word border (no piece has the space mark behind another character, which the constructor checks), so a
text is encoded word by word, and a table, bounded in entries and in their length, remembers the words seen. Pieces of
several space marks hold nothing else and have the least of all scores (the constructor checks both), so they are made
last: a word is searched for with the one mark before it, and the marks that it does not take are merged among
themselves, step by step. Characters without a piece become byte pieces.

The work is a mapInArrow stage: rows do not depend on each other, nothing is exchanged, memory is one Arrow batch and
the word table, and a lost task is simply run again. The model reaches executors as a small table (its size is that of
the vocabulary) made on the driver from the model file, whose path is a parameter.

Models that change texts (other forms of characters, fewer spaces, no leading mark) are refused by a probe. Pieces of a
user's own, which the library takes before any merging, can't be told from others by its interface: a model must have none.

Edge cases: null text is the empty text, which has the begin and end ids only. Existing columns named n_tokens, ids or
decoded are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from foretable.llm.common import ship

MARK = "▁"
#: What a model that changes texts would change: compatibility forms, letters in capitals, combining marks, several and last spaces.
PROBE = "  Ａ  ﬁ Z\u0065\u0301\t\n ½  "
#: Words, and pairs of neighbours, that one worker remembers before it starts over; longer words than LONGEST it never remembers.
REMEMBERED, LONGEST = 500_000, 64


def public_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class MergeModel:
    """The vocabulary of a model, with what encoding needs: ranks (order of merging) and how each piece is merged."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if sp.normalize(PROBE) != MARK + PROBE.replace(" ", MARK):
            raise ValueError(f"{path}: a model that leaves texts as they are, but for one leading space mark, is needed")
        ids = range(sp.get_piece_size())
        special = {i for i in ids if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        self.bytes = {int(sp.id_to_piece(i)[1:-1], 16): i for i in ids if sp.is_byte(i)}
        normal = [i for i in ids if i not in special and not sp.is_byte(i)]
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in normal}
        self.id = {sp.id_to_piece(i): i for i in normal}
        self.begin, self.end = sp.bos_id(), sp.eos_id()
        if len(self.bytes) != 256:
            raise ValueError(f"{path}: a model with byte pieces is needed")
        if odd := [p for p in self.id if MARK in p.lstrip(MARK)]:
            raise ValueError(f"{path}: pieces cross word borders: {odd[:3]}")
        runs = {p for p in self.id if MARK * 2 in p}
        if odd := [p for p in runs if p.strip(MARK)]:
            raise ValueError(f"{path}: several space marks before other characters: {odd[:3]}")
        names = sorted((p for p in self.id if p not in runs), key=lambda p: (-self.score[p], self.id[p]))
        merged = [p for p in names if len(p) > 1]
        if len({self.score[p] for p in merged}) < len(merged):
            raise ValueError(f"{path}: pieces share a score")
        if runs and max(self.score[p] for p in runs) >= min(self.score[p] for p in merged):
            raise ValueError(f"{path}: pieces of space marks come before others")
        self.rank = {p: k for k, p in enumerate(names)}
        #: For each piece that its own merging yields: the two that are joined last, or none for a character.
        self.halves: dict[str, tuple[str, str] | None] = {}
        for p in names:
            end, last = self.merge(p)
            if end == [p]:
                self.halves[p] = last
        #: The next shorter piece that a piece begins with.
        self.shorter = {p: next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in self.halves), None) for p in self.halves}

    def merge(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """Joins neighbours, the best score first and then the leftmost, as long as that gives a piece. Also the last two joined."""
        part: list[str | None] = list(text)
        before, after = list(range(-1, len(text) - 1)), [*range(1, len(text)), -1]
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (joined := part[a] + part[b]) in self.score:
                heapq.heappush(heap, (-self.score[joined], a, b, joined))

        for i in range(len(text) - 1):
            offer(i, i + 1)
        last = None
        while heap:
            _, a, b, joined = heapq.heappop(heap)
            if part[a] is None or part[b] is None or part[a] + part[b] != joined or after[a] != b:
                continue
            last = (part[a], part[b])
            part[a], part[b] = joined, None
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [p for p in part if p is not None], last


class WordEncoder(dict):
    """From a word (or a run of space marks, or a line feed) to its ids, packed as little-endian unsigned 32-bit integers."""

    def __init__(self, model: MergeModel) -> None:
        import ahocorasick

        super().__init__()
        self.model, self.fits = model, {}
        self.automaton = ahocorasick.Automaton()
        for p in model.halves:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        known = {c for p in model.id for c in p}
        self.unknown = re.compile("([^" + re.escape("".join(sorted(known))) + "])")

    def __missing__(self, word: str) -> bytes:
        m, out = self.model, []
        for part in self.unknown.split(word):
            if part:
                for p in self.pieces(part):
                    out += [m.id[p]] if p in m.id else [m.bytes[b] for b in p.encode()]
        packed = struct.pack(f"<{len(out)}I", *out)
        if len(self) >= REMEMBERED:
            self.clear()
        if len(self.fits) >= REMEMBERED:
            self.fits.clear()
        if len(word) <= LONGEST:
            self[word] = packed
        return packed

    def pieces(self, part: str) -> list[str]:
        word = part.lstrip(MARK)
        marks = len(part) - len(word)
        if not word:
            return self.model.merge(part)[0]
        if marks < 2:
            return self.search(part)
        found = self.search(MARK + word)
        if found[0] == MARK:
            return self.model.merge(MARK * marks)[0] + found[1:]
        return self.model.merge(MARK * (marks - 1))[0] + found

    def search(self, text: str) -> list[str]:
        """The pieces of text, by longest matches, checks of neighbours and a bitfield of positions that failed."""
        n, failed, taken, at = len(text), 0, [], 0
        longest = list(text)
        for end, p in self.automaton.iter(text):
            start = end + 1 - len(p)
            if len(p) > len(longest[start]):
                longest[start] = p
        shorter, fits = self.model.shorter, self.fits
        piece: str | None = longest[0]
        while at < n:
            while piece is not None:
                end = at + len(piece)
                if not failed >> end & 1:
                    if not taken:
                        break
                    pair = (taken[-1], piece)
                    if (fit := fits.get(pair)) is None:
                        fit = fits[pair] = self.adjacent(*pair)
                    if fit:
                        break
                piece = shorter.get(piece)
            if piece is None:
                failed |= 1 << at
                piece = taken.pop()
                at -= len(piece)
            else:
                taken.append(piece)
                at = end
                piece = longest[at] if at < n else None
        return taken

    def adjacent(self, left: str, right: str) -> bool:
        """Whether merging left + right gives the two again. The merges of both are taken back one by one, the latest
        first; at each point the border must not have been worth joining before that merge."""
        m, halves = self.model, self.model.halves
        never = len(m.rank)
        until, before_left = never, False  # merges of a lower rank, or of the same rank if further left, had come first
        while True:
            across = m.rank.get(left + right)
            if across is not None and (across < until or across == until and before_left):
                return False
            a, b = halves.get(left), halves.get(right)
            if a is None and b is None:
                return True
            # the later of the two merges; of one rank, the one to the right is later
            if b is None or a is not None and m.rank[left] > m.rank[right]:
                until, before_left, left = m.rank[left], False, a[1]
            else:
                until, before_left, right = m.rank[right], True, b[0]


_SPLIT = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")


def encode_text(encoder: WordEncoder, text: str, ends: tuple[bytes, bytes]) -> bytes:
    if not text:
        return ends[0] + ends[1]
    marked = MARK + text.replace(" ", MARK)
    return b"".join([ends[0], *map(encoder.__getitem__, _SPLIT.findall(marked)), ends[1]])


class Decoder:
    """From packed ids to text."""

    def __init__(self, model: MergeModel) -> None:
        self.surface = {i: p.replace(MARK, " ").encode() for p, i in model.id.items()}
        self.surface |= {i: bytes([b]) for b, i in model.bytes.items()}
        self.silent = {model.begin, model.end}
        self.surface |= dict.fromkeys(self.silent, b"")

    def __call__(self, packed: bytes) -> str:
        ids = struct.unpack(f"<{len(packed) // 4}I", packed)
        said = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")
        return said[1:] if said[:1] == " " else said


_ready: dict[str, tuple[WordEncoder, Decoder]] = {}


def piece_encode(docs: DataFrame, model_path: str, text_col: str = "text", decode: bool = True) -> DataFrame:
    """docs with n_tokens (begin and end ids included), ids (little-endian unsigned 32-bit integers, packed) and, with
    decode, decoded: the text that the ids stand for."""
    added = {"n_tokens": T.LongType(), "ids": T.BinaryType()} | ({"decoded": T.StringType()} if decode else {})
    docs = docs.drop(*[c for c in docs.columns if c in added and c != text_col])
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(MergeModel(model_path))
    schema = T.StructType([*docs.schema.fields, *(T.StructField(k, v) for k, v in added.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model_path not in _ready:
            _ready[model_path] = WordEncoder(model.value), Decoder(model.value)
        encoder, decoder = _ready[model_path]
        ends = struct.pack("<I", model.value.begin), struct.pack("<I", model.value.end)
        for whole in batches:
            for batch in _pieces(whole, text_col):
                packed = [encode_text(encoder, x or "", ends) for x in batch.column(text_col).to_pylist()]
                new = [pa.array([len(x) // 4 for x in packed], pa.int64()), pa.array(packed, pa.binary())]
                if decode:
                    new.append(pa.array(map(decoder, packed), pa.string()))
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *added])

    return docs.mapInArrow(run, schema)


def _pieces(batch: pa.RecordBatch, text_col: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about most bytes of text: what is made from them stays small, however long the texts are."""
    per_row = max(1, batch.column(text_col).nbytes // max(1, batch.num_rows))
    step = max(1, most // per_row)
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)
