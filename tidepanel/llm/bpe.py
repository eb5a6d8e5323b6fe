"""Operator 9: BPE encoding and decoding by speculation and verification.

A text is cut at single spaces into units that the pre-tokenizer treats
independently.  Units that a worker has not met before are pre-tokenized into
words; for new words greedy longest match proposes tokens, a vectorised check
tests every adjacent pair of all proposals, and only words with a failing pair
go through exact merging.  A proposal whose tokens encode to themselves and
whose neighbours all stay apart is the exact encoding: the first merge across
a boundary would also happen with the two neighbours alone.

The vocabulary file is a parameter; workers open it from the path the library
package gives, and nothing of it is kept in the repository.

Defined results: NULL or empty text: no ids, both digests those of the empty
string.  An empty table gives an empty result.  Added tokens written out in a text become their id, as the library
does by default.  Very long texts and words are encoded whole.  Repeated rows
give repeated results; other columns of the input are carried only when named.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm.common import of_stage

RUN = 1_000_000  # characters that are cut into units at a time
CACHE_BYTES = 96 << 20  # of cached units, by their own estimate
MOST_PAIRS = 2_000_000  # known pairs are forgotten beyond these
SCALAR = 48  # words of more characters are merged one by one
_ID = struct.Struct("<I")
_AMBIGUOUS = re.compile(r" (?:\s|\Z)")
_SINGLE = re.compile(r" (?=\S)")
# Latin letters (all versions of Unicode agree on them), digits, ASCII marks but the apostrophe, and line feeds:
# on these the pre-tokenizer's words are plain runs.
_PLAIN = re.compile(r" ?(?:[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+|[0-9]+|[!-&(-/:-@\[-`{-~]+)|\n")
_RARE = re.compile(r"\n\n|\n\Z|<\|")
_ONE = re.compile(r" ?(?:[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+|[0-9]+)").fullmatch
_NONE = 1 << 30


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def units(text: str) -> list[str]:
    """Cut before spaces that are followed by a visible character: a word never reaches across one."""
    parts = _SINGLE.split(text) if _AMBIGUOUS.search(text) else text.split(" ")
    return [parts[0], *[" " + p for p in parts[1:]]]


def plain_words(unit: str) -> list[str] | None:
    """The words of a unit that is made of plain runs only, else None."""
    found = _PLAIN.findall(unit)
    return found if sum(map(len, found)) == len(unit) and not _RARE.search(unit) else None


class SpeculativeBpe:
    """Encoder and decoder of one byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self._added = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None
        pre = spec["pre_tokenizer"]
        self.words_of = pre_tokenizers.ByteLevel(add_prefix_space=pre["add_prefix_space"], use_regex=pre["use_regex"]).pre_tokenize_str
        self.pieces = {i: t for t, i in self.vocab.items()}
        self.shown = _byte_characters()
        self.spelling = {b: c for b, c in self.shown.items() if b}  # the byte 0 parts words
        self.byte_of = byte_of = {c: b for b, c in self.shown.items()}
        self.byte_at = np.full(512, 256)
        self.byte_at[[ord(c) for c in byte_of]] = list(byte_of.values())
        size = max([*self.pieces, *self.added.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for t, i in self.vocab.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in t)
        for t, i in self.added.items():
            self.bytes_of[i] = t.encode()
        self.size = size
        self.decimal = [str(i) for i in range(size)]
        # Merges as arrays: pair codes in order, their ranks, and the id that each rank makes.
        made = np.array([[self.vocab[x], self.vocab[y], self.vocab[x + y]] for x, y in pairs], np.int64).reshape(-1, 3)
        codes = made[:, 0] * size + made[:, 1]
        order = np.argsort(codes, kind="stable")
        last = np.append(codes[order][1:] != codes[order][:-1], True) if len(codes) else np.empty(0, bool)
        self.merge_codes, self.merge_ranks, self.merge_ids = np.append(codes[order][last], -1), np.append(order[last], _NONE), made[:, 2]
        self.letter = np.zeros(512, np.int64)
        for c, b in byte_of.items():
            self.letter[ord(c)] = self.vocab.get(c, 0)
        self._plant()
        # Two generations of units: when the younger is full it becomes the older, and what is met again moves back.
        self.units: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0
        # Pair codes known so far, sorted, and whether the two tokens stay apart.
        self.codes, self.apart = np.empty(0, np.int64), np.empty(0, bool)
        self.proposed = self.merged = 0

    def exact(self, word: str) -> tuple[int, ...]:
        """Merge the best-ranked pair, leftmost first, until none is left."""
        vocab, rank, none = self.vocab, self.ranks.get, 1 << 60
        parts = list(word)
        ranks = [rank(p, none) for p in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), none)
        return tuple([vocab[p] for p in parts])

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        codes = left * self.size + right
        at = np.searchsorted(self.merge_codes[:-1], codes)
        return np.where((self.merge_codes[at] == codes) & (right >= 0), self.merge_ranks[at], _NONE)

    def exact_many(self, words: Sequence[str]) -> list[bytes]:
        """``exact`` for many words, as bytes: one merge per word and step, all words of a length together."""
        found: list = [None] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        edges = np.flatnonzero(np.diff(lengths[order], prepend=-1))
        for begin, end in zip(edges.tolist(), [*edges[1:].tolist(), len(words)]):
            length = int(lengths[order[begin]])
            for at in range(begin, end, 32_768):
                some = order[at : min(end, at + 32_768)].tolist()
                if length > SCALAR:
                    for i in some:
                        found[i] = np.array(self.exact(words[i]), "<u4").tobytes()
                    continue
                ids = self.letter[np.frombuffer("".join([words[i] for i in some]).encode("utf-32-le"), np.uint32)].reshape(len(some), length)
                flat, sizes = self._merged(ids)
                ends = (np.cumsum(sizes) * 4).tolist()
                for i, a, b in zip(some, [0, *ends], ends):
                    found[i] = flat[a:b]
        return found

    def _merged(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(ids of all rows, ids per row) after merging; a row holds the letters of one word."""
        n, length = ids.shape
        ids = np.concatenate([ids, np.full((n, 1), -1)], axis=1)
        ranks = np.concatenate([self._ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, length), np.full((n, 1), _NONE)], axis=1)
        sizes, active, columns = np.full(n, length), np.arange(n), np.arange(length + 1)
        while len(active):
            best = ranks[active].argmin(axis=1)
            low = ranks[active, best]
            go = low < _NONE
            active, best, low = active[go], best[go], low[go]
            if not len(active):
                break
            # Everything behind the merged pair moves one place to the left.
            source = np.minimum(columns + (columns > best[:, None]), length)
            mine = np.take_along_axis(ids[active], source, axis=1)
            theirs = np.take_along_axis(ranks[active], np.minimum(columns + (columns >= best[:, None]), length), axis=1)
            rows = np.arange(len(active))
            mine[rows, best] = self.merge_ids[low]
            theirs[rows, best] = self._ranks(mine[rows, best], mine[rows, np.minimum(best + 1, length)])
            inner = np.flatnonzero(best > 0)
            theirs[inner, best[inner] - 1] = self._ranks(mine[inner, best[inner] - 1], mine[inner, best[inner]])
            ids[active], ranks[active] = mine, theirs
            sizes[active] -= 1
        return ids[ids >= 0].astype("<u4").tobytes(), sizes

    def _plant(self) -> None:
        """The tokens as a prefix tree in arrays: steps (node * 256 + byte) in order, where they lead, and the token of a node or -1."""
        steps, token = {}, [-1]
        for piece, number in self.vocab.items():
            at = 0
            for c in piece:
                key = at * 256 + self.byte_of[c]
                at = steps.get(key)
                if at is None:
                    at = steps[key] = len(token)
                    token.append(-1)
            token[at] = number
        keys = np.fromiter(steps, np.int64, len(steps))
        order = np.argsort(keys)
        self.steps, self.leads, self.token_at = np.append(keys[order], -1), np.append(np.fromiter(steps.values(), np.int64, len(steps))[order], 0), np.array(token)

    def propose(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(token ids of all words in order, ids per word) by greedy longest match, all words moving on by a byte per step."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        text = self.byte_at[np.frombuffer("\0".join([*words, ""]).encode("utf-32-le"), np.uint32)]  # a byte per character, 256 after each word
        start = np.cumsum(lengths + 1) - lengths - 1
        at, word, node = start.copy(), np.arange(len(words)), np.zeros(len(words), np.int64)
        best, until = np.full(len(words), -1), start.copy()
        ids, owners = [], []
        while len(word):
            byte = text[at]
            key = node * 256 + byte
            place = np.searchsorted(self.steps[:-1], key)
            goes = (self.steps[place] == key) & (byte < 256)
            on, stop = np.flatnonzero(goes), np.flatnonzero(~goes)
            node[on] = self.leads[place[on]]
            at[on] += 1
            hit = on[self.token_at[node[on]] >= 0]
            best[hit], until[hit] = self.token_at[node[hit]], at[hit]
            ids.append(best[stop])
            owners.append(word[stop])
            node[stop], at[stop] = 0, until[stop]
            best[stop] = -1
            ended = np.zeros(len(word), bool)
            ended[stop] = text[at[stop]] == 256
            if ended.any():
                keep = ~ended
                at, word, node, best, until = at[keep], word[keep], node[keep], best[keep], until[keep]
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        return np.concatenate(ids)[order], np.bincount(owner, minlength=len(words))

    def stay_apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For each pair of neighbours: does their joint text encode to just these two?

        Pairs are looked up by code; a token that does not encode to itself fails
        every pair (``right`` = ``size`` stands for the token alone).
        """
        codes = left.astype(np.int64) * (self.size + 1) + right
        at = np.searchsorted(self.codes, codes)
        known = at < len(self.codes)
        known[known] = self.codes[at[known]] == codes[known]
        if not known.all() and len(self.codes) > MOST_PAIRS:
            self.codes, self.apart, known = np.empty(0, np.int64), np.empty(0, bool), np.zeros(len(codes), bool)
        if not known.all():
            new = np.unique(codes[~known])
            verdict = self._apart(*np.divmod(new, self.size + 1))
            merged = np.concatenate([self.codes, new])
            order = np.argsort(merged, kind="stable")
            self.codes, self.apart = merged[order], np.concatenate([self.apart, verdict])[order]
            at = np.searchsorted(self.codes, codes)
        return self.apart[at]

    def _apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pieces, alone = self.pieces, self.size
        pairs = [(x,) if y == alone else (x, y) for x, y in zip(left.tolist(), right.tolist())]
        joint = self.exact_many(["".join([pieces[i] for i in pair]) for pair in pairs])
        return np.array([mine == struct.pack(f"<{len(pair)}I", *pair) for pair, mine in zip(pairs, joint)], bool)

    def encode_words(self, words: Sequence[str]) -> list[bytes]:
        """Encodings of whole pre-tokenizer words."""
        if not words:
            return []
        flat, lengths = self.propose(words)
        owner = np.repeat(np.arange(len(words)), lengths)
        right = np.append(flat[1:], self.size)
        inner = np.append(owner[1:] == owner[:-1], False)
        fine = self.stay_apart(flat, np.full(len(flat), self.size))
        fine[inner] &= self.stay_apart(flat[inner], right[inner])
        failing = np.unique(owner[~fine])
        self.proposed += len(words)
        self.merged += len(failing)
        raw, ends = flat.astype("<u4").tobytes(), np.cumsum(lengths) * 4
        found = [raw[a:b] for a, b in zip((ends - lengths * 4).tolist(), ends.tolist())]
        for i, mine in zip(failing.tolist(), self.exact_many([words[i] for i in failing.tolist()])):
            found[i] = mine
        return found

    def words_in(self, unit: str) -> list:
        """Words of a unit in the vocabulary's byte alphabet; added tokens as their ids."""
        if self._added and self._added.search(unit):
            found = []
            for k, piece in enumerate(self._added.split(unit)):
                found += [self.added[piece]] if k % 2 else [w for w, _ in self.words_of(piece)] if piece else []
            return found
        return [w for w, _ in self.words_of(unit)]

    def spelled(self, plain: list[str]) -> list[str]:
        """Plain words in the vocabulary's byte alphabet, all in one go."""
        return "\0".join(plain).encode().decode("latin-1").translate(self.spelling).split("\0") if plain else []

    def learn(self, fresh: Iterable[str]) -> None:
        """Encode units that are not in the cache yet; ids are kept as little-endian 32-bit bytes."""
        single, several, plain = [], [], []
        for u in fresh:
            if _ONE(u):
                single.append(u)
            elif (mine := plain_words(u)) is not None:
                several.append((u, len(mine)))
                plain += mine
            else:
                several.append((u, self.words_in(u)))
        spelled_single, spelled = self.spelled(single), self.spelled(plain)
        new = set(spelled_single).union(spelled)
        for _, mine in several:
            if mine.__class__ is list:
                new.update([w for w in mine if w.__class__ is str])
        new = list(new)
        words = dict(zip(new, self.encode_words(new)))
        known, at = self.units, 0
        known.update(zip(single, map(words.__getitem__, spelled_single)))
        for u, mine in several:
            if mine.__class__ is int:
                mine, at = spelled[at : at + mine], at + mine
            known[u] = b"".join([_ID.pack(w) if w.__class__ is int else words[w] for w in mine])
            self.held += 4 * len(u)
        self.held += 256 * len(single) + 256 * len(several)

    def prepare(self, cut: Sequence[list[str]]) -> None:
        """Make sure that all units are cached; the cache is emptied when it is full."""
        if self.held > CACHE_BYTES // 2:
            self.units, self.older, self.held = {}, self.units, 0
        fresh = set().union(*cut).difference(self.units)
        if self.older:
            again = fresh.intersection(self.older)
            self.units.update(zip(again, map(self.older.__getitem__, again)))
            self.held += 256 * len(again)
            fresh -= again
        if fresh:
            self.learn(fresh)

    def encode(self, cut: list[str]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.units.__getitem__, cut)), "<u4")

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def _byte_characters() -> dict[int, str]:
    """Printable stand-ins of the 256 bytes in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def encoder(path: str) -> SpeculativeBpe:
    """One encoder per worker, vocabulary and stage."""
    return of_stage(("speculative", path), lambda: SpeculativeBpe(path))


def slices(texts: pa.ChunkedArray | pa.Array, budget: int = 4_000_000) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) in runs of about ``budget`` characters; NULL becomes the empty text."""
    run, first, size = [], 0, 0
    for i, t in enumerate(texts):
        t = t.as_py() or ""
        run.append(t)
        size += len(t)
        if size >= budget:
            yield first, run
            run, first, size = [], i + 1, 0
    if run:
        yield first, run


def _digest_batches(path: str):
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in source:
            n, ids_hex, text_hex = [], [], []
            for _, run in slices(batch.column(1), RUN):
                cut = [units(t) for t in run]
                bpe.prepare(cut)
                for mine in cut:
                    ids = bpe.encode(mine).tolist()
                    n.append(len(ids))
                    ids_hex.append(hashlib.sha256(",".join(map(bpe.decimal.__getitem__, ids)).encode()).hexdigest())
                    text_hex.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return batches


def encode_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text; no shuffle."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_digest_batches(path or vocabulary_path()), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (array of INT)."""
    path = path or vocabulary_path()

    def batches(source):
        bpe = encoder(path)
        for batch in source:
            for first, run in slices(batch.column(1), RUN):
                cut = [units(t) for t in run]
                bpe.prepare(cut)
                ids = pa.array([bpe.encode(mine) for mine in cut], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(run)), ids], names=["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(batches, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows (doc_id, ids); NULL ids give an empty text."""
    path = path or vocabulary_path()

    def batches(source):
        bpe = encoder(path)
        for batch in source:
            text = [bpe.decode(ids.as_py() or ()) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("bigint").alias("doc_id"), "ids").mapInArrow(batches, "doc_id bigint, text string")


def op9_bpe(spark: SparkSession, root: str) -> DataFrame:
    return encode_digests(spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text"))
