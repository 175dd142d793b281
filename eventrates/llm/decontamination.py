"""Benchmark decontamination by latent semantic retrieval.

Words are hashed to features and weighed by how rarely blocks of the corpus hold them. A randomised singular value
decomposition of the TF-IDF matrix of all passages of the corpus and all benchmark items gives a latent space in which
every passage of every document is compared with every item. Pairs above a cosine are checked word by word: the
longest common subsequence must cover most of the item densely, and the item's rarest words, its answer, must be there.

A space of fixed rank tells many items apart less well than few. What it misses is found by equality: a run of words
leads to copies word for word, and every place with half of an item's answer words, which the check asks for, is checked.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache, cached_property
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import carried, own, packed, stored, unpacked

FEATURES = 1 << 15
BLOCK_WORDS = 16
# More passages of the corpus weigh as much as so many in the fit, so that items keep their weight beside them.
BALANCE = 12_000
# Passages multiplied at once, and how often a feature must stand in them to be summed by a matrix product.
CHUNK = 1024
OFTEN = 16
RANK = 64
EXTRA = 16
# The largest singular directions tell languages apart, not passages.
COMMON = 4
ITEM_WEIGHT = 3.0
LEAST_COSINE = 0.55
LEAST_COMMON = 0.6
LEAST_DENSITY = 0.5
LEAST_ANSWER = 0.5
# Items with fewer words must occur word for word.
SHORT = 8
# Words of the run by which longer items are found word for word.
RUN = 8
# Places of answer words, or words of places to check, held at once.
HELD = 1 << 22
# Items compared in one pass over the documents.
ITEMS_AT_ONCE = 20_000
# Bytes of text worked on at once.
SEGMENT = 1 << 19
SEED = 17
SLICE = 1024

# ASCII digits and small letters and all bytes of other characters make words.
_WORDS = bytes(i if 48 <= i < 58 or 97 <= i < 123 or i >= 128 else 32 for i in range(256))
# Feature of the places that fill up a document's last block; it weighs nothing.
NOTHING = FEATURES
_FACTOR = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)


def prepared(text: str | None) -> bytes:
    """Lower-cased words of ASCII letters, digits and all other characters beyond ASCII, with spaces around."""
    return (text or "").lower().encode("utf-8", "replace").translate(_WORDS)


def words_of(text: str | None) -> list[bytes]:
    return prepared(text).split()


@cache
def _powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd factor and of its inverse, modulo 2^64."""
    out = []
    for factor in (_FACTOR, pow(_FACTOR, -1, 1 << 64)):
        values = np.full(length, factor, np.uint64)
        values[0] = 1
        out.append(np.multiply.accumulate(values))
    return out[0], out[1]


def features_of(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Feature and first byte of each word of a prepared text, words hashed all at once by differences of sums."""
    ids, places = [], []
    at = 0
    while at < len(raw):
        end = len(raw)
        if end - at > SEGMENT:  # cut at a space, so long texts need no more memory
            end = raw.rfind(b" ", at, at + SEGMENT) + 1
            if end <= at:
                end = raw.find(b" ", at + SEGMENT) + 1 or len(raw)
        some = np.frombuffer(raw, np.uint8, end - at, at)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], some != 32, [False]])))
        starts, stops = edges[::2], edges[1::2]
        if len(starts):
            power, inverse = _powers(SEGMENT if len(some) <= SEGMENT else len(some))
            sums = np.zeros(len(some) + 1, np.uint64)
            np.cumsum(np.where(some != 32, some, 0).astype(np.uint64) * power[: len(some)], out=sums[1:])
            mixed = (sums[stops] - sums[starts]) * inverse[starts]
            mixed = (mixed ^ (mixed >> np.uint64(32))) * _MIX
            ids.append((mixed >> np.uint64(64 - FEATURES.bit_length() + 1)).astype(np.uint16))
            places.append(starts + at)
        at = end
    if not ids:
        return np.zeros(0, np.uint16), np.zeros(0, np.int64)
    return np.concatenate(ids), np.concatenate(places)


@dataclass(frozen=True)
class Blocks:
    """Features of the blocks of some texts; ``text`` is the text of each block, ``order`` its place there."""

    ids: np.ndarray
    text: np.ndarray
    order: np.ndarray


def blocks_of(texts: Iterable[str | None]) -> Iterator[Blocks]:
    """Blocks of ``BLOCK_WORDS`` words of whole texts, for texts of about ``SEGMENT`` bytes at a time."""
    first, held, size = 0, [], 0

    def flush() -> Blocks:
        ids, places = features_of(b" ".join(held))
        ends = np.cumsum([len(r) + 1 for r in held])
        text = np.searchsorted(ends, places, "right")
        starts = np.searchsorted(text, np.arange(len(held)))
        within = np.arange(len(ids)) - starts[text]
        counts = -(-np.bincount(text, minlength=len(held)) // BLOCK_WORDS)
        before = np.cumsum(counts) - counts
        out = np.full((int(counts.sum()), BLOCK_WORDS), NOTHING, np.uint16)
        out[before[text] + within // BLOCK_WORDS, within % BLOCK_WORDS] = ids
        owner = np.repeat(np.arange(len(held)), counts)
        return Blocks(out, owner + first, np.arange(len(owner)) - before[owner])

    for i, t in enumerate(texts):
        held.append(prepared(t))
        size += len(held[-1])
        if size >= SEGMENT:
            yield flush()
            first, held, size = i + 1, [], 0
    if held:
        yield flush()


def _passages(some: Blocks) -> np.ndarray:
    """Sorted features of the passages, two blocks each, that texts fall into."""
    heads, seconds = np.flatnonzero(some.order % 2 == 0), np.flatnonzero(some.order % 2)
    out = np.full((len(heads), 2 * BLOCK_WORDS), NOTHING, "<u2")
    out[:, :BLOCK_WORDS] = some.ids[heads]
    out[np.searchsorted(heads, seconds) - 1, BLOCK_WORDS:] = some.ids[seconds]
    return np.sort(out, axis=1)


def _corpus(docs: DataFrame, text: str) -> tuple[np.ndarray, DataFrame]:
    """IDF by feature over all blocks of all documents, and all different passages (ids)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(FEATURES + 1, np.int64)
        blocks = 0
        for batch in batches:
            for some in blocks_of(batch["text"]):
                rows = np.sort(some.ids, axis=1)
                fresh = np.ones(rows.shape, bool)
                fresh[:, 1:] = rows[:, 1:] != rows[:, :-1]
                held += np.bincount(rows[fresh], minlength=FEATURES + 1)
                blocks += len(rows)
                if passages := [p.tobytes() for p in _passages(some)]:
                    yield pd.DataFrame({"feature": None, "n": None, "ids": passages}).astype({"feature": "Int64", "n": "Int64"})
        some = np.flatnonzero(held[:FEATURES])
        if blocks:
            yield pd.DataFrame({"feature": np.r_[-1, some], "n": np.r_[blocks, held[some]], "ids": None})

    told = stored(docs.select(own(text).alias("text")).mapInPandas(read, "feature long, n long, ids binary"))
    counts = told.where("feature is not null").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    counts = dict(zip(counts["feature"], counts["n"], strict=True))
    total = counts.pop(-1, 0)
    idf = np.full(FEATURES, np.log(total + 1.0), np.float32)
    if counts:
        at = np.fromiter(counts, np.int64, len(counts))
        idf[at] = np.log((total + 1.0) / (np.fromiter(counts.values(), np.float64, len(counts)) + 1.0))
    # In order, so that sums of rounded numbers agree between runs.
    passages = told.where("ids is not null").select("ids").distinct().sortWithinPartitions("ids")
    return np.maximum(idf, 0.0), stored(passages)


def _directions(rank: int = RANK) -> np.ndarray:
    """Random orthonormal directions of features; their images tell the space."""
    drawn = np.random.default_rng(SEED).standard_normal((FEATURES, rank + EXTRA)).astype(np.float32)
    return np.linalg.qr(drawn)[0].astype(np.float32)


def _add_by_feature(out: np.ndarray, flat: np.ndarray, rows: np.ndarray) -> None:
    """Add each row to the sums of all the features in ``flat`` that stand for it, as many for every row."""
    flat = flat.astype(np.int64)
    row = np.arange(len(flat)) // (len(flat) // len(rows))
    often = np.flatnonzero(np.bincount(flat, minlength=len(out)) > OFTEN)
    column = np.full(len(out), -1, np.int64)
    column[often] = np.arange(len(often))
    of = column[flat]
    hit, rest = np.flatnonzero(of >= 0), np.flatnonzero(of < 0)
    times = np.bincount(row[hit] * len(often) + of[hit], minlength=len(rows) * len(often))
    out[often] += times.astype(np.float32).reshape(len(rows), -1).T @ rows
    # The first place of every other feature, then the second, and so on: no feature stands twice in one sum.
    rest = rest[np.argsort(flat[rest], kind="stable")]
    firsts = np.flatnonzero(np.diff(flat[rest], prepend=-1))
    counts = np.diff(np.r_[firsts, len(rest)])
    for n in range(OFTEN):
        firsts = firsts[counts > n]
        counts = counts[counts > n]
        at = rest[firsts + n]
        out[flat[at]] += rows[row[at]]


def _gram_times(passages: DataFrame, basis: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """A^T A ``basis`` over the rows of the TF-IDF matrix A of passages, summed in slices of features."""
    context = passages.sparkSession.sparkContext
    weights = np.append(idf, np.float32(0))
    shared = context.broadcast((np.vstack([basis, np.zeros_like(basis[:1])]) * weights[:, None], weights))
    width = basis.shape[1]

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weighed, weights = shared.value
        out, size = None, 2 * BLOCK_WORDS
        for batch in batches:
            every = np.frombuffer(b"".join(batch["ids"]), "<u2").reshape(-1, size)
            out = np.zeros_like(weighed) if out is None else out
            for at in range(0, len(every), CHUNK):
                ids = every[at : at + CHUNK]
                flat = ids.ravel()
                fresh = np.ones(ids.shape, bool)
                fresh[:, 1:] = ids[:, 1:] != ids[:, :-1]
                starts = np.flatnonzero(fresh)
                times = np.diff(np.r_[starts, len(flat)])
                norms = np.bincount(starts // size, (times * weights[flat[starts]]) ** 2, len(ids))
                image = weighed[ids[:, 0]]
                for j in range(1, size):
                    image += weighed[ids[:, j]]
                image /= np.where(norms > 0, norms, np.inf).astype(np.float32)[:, None]
                _add_by_feature(out, flat, image)
        if out is not None:
            out *= weights[:, None]
            for s in range(0, FEATURES, SLICE):
                yield pd.DataFrame({"slice": [s], "sums": [out[s : min(s + SLICE, FEATURES)].tobytes()]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, sums in zip(batch["slice"], batch["sums"], strict=True):
                part = np.frombuffer(sums, np.float32).astype(np.float64)
                totals[s] = totals[s] + part if s in totals else part
        for s, total in totals.items():
            yield pd.DataFrame({"slice": [s], "sums": [total.astype(np.float32).tobytes()]})

    schema = "slice int, sums binary"
    # A task sends sums of all features, so there are no more tasks than run at a time.
    sent = passages.coalesce(context.defaultParallelism).mapInPandas(multiply, schema)
    rows = sent.repartition("slice").mapInPandas(add, schema).collect()
    out = np.zeros(basis.shape)
    for r in rows:
        out[r["slice"] : r["slice"] + SLICE] = np.frombuffer(r["sums"], np.float32).reshape(-1, width)
    shared.unpersist()
    return out


def _items_times(items: Iterable[np.ndarray], basis: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """A^T A ``basis`` over the rows of the TF-IDF matrix A of items."""
    out = np.zeros(basis.shape)
    for ids in items:
        at, n = np.unique(ids, return_counts=True)
        v = n * idf[at]
        if norm := float(np.sqrt(v @ v)):
            v = v / norm
            out[at] += np.outer(v, v @ basis[at])
    return out


def latent_space(image: np.ndarray, basis: np.ndarray, idf: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Right singular vectors (features x rank) of the TF-IDF matrix A, without the largest few, weighed by IDF.

    ``image`` is A^T A ``basis``. One pass over the rows of A gives it, and Nystrom's approximation the vectors.
    """
    core = basis.T.astype(np.float64) @ image
    sizes, turn = np.linalg.eigh((core + core.T) / 2)
    told = sizes > 1e-6 * sizes[-1]
    root = np.where(told, 1 / np.sqrt(np.where(told, sizes, 1.0)), 0.0)
    vectors = np.linalg.svd(image @ (turn * root), full_matrices=False)[0][:, COMMON:rank]
    return np.ascontiguousarray(idf[:, None] * vectors, np.float32)


@dataclass(frozen=True)
class Item:
    """A benchmark item: its words, the bits of each word's places, and its answer words."""

    key: object
    words: tuple[bytes, ...]
    places: dict[bytes, int]
    answer: frozenset[bytes]


def item_of(key: object, text: str | None, idf: np.ndarray) -> Item:
    words = tuple(words_of(text))
    places: dict[bytes, int] = {}
    for i, w in enumerate(words):
        places[w] = places.get(w, 0) | 1 << i
    rarity = dict(zip(words, idf[features_of(b" ".join(words))[0]].tolist(), strict=True))
    ranked = sorted(rarity, key=lambda w: (-rarity[w], w))
    return Item(key, words, places, frozenset(ranked[: ceil(len(ranked) / 4)]))


def _rows(item: Item, words: list[bytes]) -> list[int]:
    """After each word, the item's places as bits: 0 where the common subsequence with the words so far grows."""
    full = (1 << len(item.words)) - 1
    rows = [full]
    for w in words:
        free = rows[-1]
        if m := item.places.get(w):
            hit = free & m
            free = ((free + hit) | (free - hit)) & full
        rows.append(free)
    return rows


def common_length(item: Item, words: list[bytes]) -> int:
    """Length of the longest common subsequence, all places of a word at once as bits."""
    return len(item.words) - _rows(item, words)[-1].bit_count()


def common_span(item: Item, words: list[bytes]) -> tuple[int, int]:
    """First and last place in ``words`` of one longest common subsequence."""
    rows = _rows(item, words)

    def length(i: int, j: int) -> int:
        return i - (rows[j] & ((1 << i) - 1)).bit_count()

    i, j, first, last = len(item.words), len(words), 0, -1
    while left := length(i, j):
        if length(i, j - 1) == left:
            j -= 1
        elif length(i - 1, j) == left:
            i -= 1
        else:
            i, j = i - 1, j - 1
            first, last = j, max(last, j)
    return first, last


def _latest_start(item: Item, words: list[bytes], length: int) -> int:
    """Last place from which the common subsequence with the rest of ``words`` is still ``length`` long."""
    n = len(item.words)
    places: dict[bytes, int] = {}
    for i, w in enumerate(reversed(item.words)):
        places[w] = places.get(w, 0) | 1 << i
    rows = _rows(Item(item.key, item.words[::-1], places, item.answer), words[::-1])
    return len(words) - next(j for j, row in enumerate(rows) if n - row.bit_count() == length)


def verified(
    item: Item, words: list[bytes], first: int, last: int, margin: int | None = None
) -> tuple[float, float, int, int] | None:
    """(share of the item in common, share of its answer, first word, words) near a passage, or None.

    The passage reaches from word ``first`` to ``last``; the item may stand around it on either side, by ``margin``
    words or its own length.
    """
    n = len(item.words)
    margin = n if margin is None else margin
    start = max(0, first - margin)
    near = words[start : last + margin]
    need = n if n < SHORT else ceil(LEAST_COMMON * n)
    length = common_length(item, near)
    if not n or length < need:
        return None
    a, b = common_span(item, near)
    if length < LEAST_DENSITY * (b - a + 1):  # common words long before the item may have taken its first places
        a = _latest_start(item, near[: b + 1], length)
    dense = length / (b - a + 1)
    answer = len(item.answer.intersection(near[a : b + 1])) / len(item.answer)
    if dense < (1.0 if n < SHORT else LEAST_DENSITY) or answer < LEAST_ANSWER:
        return None
    return length / n, answer, start + a, b - a + 1


def verified_within(item: Item, words: list[bytes], first: int, last: int) -> tuple[float, float, int, int] | None:
    """What ``verified`` tells of the words from ``first`` to ``last``, or of the best stretch of them.

    The longest common subsequence of a wide place can be thinner than that of the copy in it.
    """
    found = verified(item, words, first, last, 0)
    n = len(item.words)
    if found or n < SHORT or common_length(item, words[first:last]) < LEAST_COMMON * n:
        return found
    tries = [verified(item, words, at, at + n, n // 8) for at in range(first, last, max(1, n // 4))]
    return max((t for t in tries if t), default=None)


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every start, as many as counted."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def _pieces(sizes: np.ndarray) -> Iterator[slice]:
    """Slices of ``sizes`` that sum up to ``HELD`` or less, or hold one."""
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        until = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + HELD, "right")))
        yield slice(at, until)
        at = until


def _run_hashes(ids: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    out = np.zeros(len(starts), np.uint64)
    for j in range(length):
        out = out * np.uint64(_FACTOR) + ids[starts + j].astype(np.uint64) + np.uint64(1)
    return out


@dataclass(frozen=True)
class Index:
    """Latent vectors of features, the last one nothing, and of items, the items, and the IDF of features."""

    projection: np.ndarray
    vectors: np.ndarray
    items: tuple[Item, ...]
    idf: np.ndarray

    @cached_property
    def lengths(self) -> np.ndarray:
        return np.array([len(i.words) for i in self.items], np.int64)

    @cached_property
    def needs(self) -> np.ndarray:
        """Answer words without which an item is never verified."""
        return np.array([ceil(LEAST_ANSWER * len(i.answer)) for i in self.items], np.int64)

    @cached_property
    def answers(self) -> tuple[np.ndarray, np.ndarray]:
        """(item, feature) of the answer words of items that need not stand word for word, by item."""
        pairs = [
            (k, f)
            for k, i in enumerate(self.items)
            if len(i.words) >= SHORT
            for f in sorted(set(features_of(b" ".join(i.answer))[0].tolist()))
        ]
        both = np.array(pairs, np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1]

    @cached_property
    def members(self) -> np.ndarray:
        """Items and the features of their words as sorted numbers."""
        held = [k << 16 | f for k, i in enumerate(self.items) for f in set(features_of(b" ".join(i.words))[0].tolist())]
        return np.array(sorted(held), np.int64)

    @cached_property
    def runs(self) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Per length: whether a feature begins a run, and the runs' hashes in order, their items and places in them.

        A short item is one run; of a longer one it is the ``RUN`` words that weigh most.
        """
        found: dict[int, list[tuple[int, int, int, int]]] = {}
        for k, item in enumerate(self.items):
            ids = features_of(b" ".join(item.words))[0]
            length = min(len(ids), SHORT - 1 if len(ids) < SHORT else RUN)
            sums = np.convolve(self.idf[ids], np.ones(length), "valid")
            at = int(np.argmax(sums))
            mark = int(_run_hashes(ids, np.array([at]), length)[0])
            found.setdefault(length, []).append((mark, k, at, int(ids[at])))
        out = []
        for length, rows in sorted(found.items()):
            rows.sort()
            begins = np.zeros(FEATURES + 1, bool)
            begins[[r[3] for r in rows]] = True
            marks = np.array([r[0] for r in rows], np.uint64)
            out.append((length, begins, marks, np.array([r[1] for r in rows]), np.array([r[2] for r in rows])))
        return out

    def run_places(self, ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, first place, place after the last) wherever the run of an item stands among the words ``ids``."""
        for length, begins, marks, items, offsets in self.runs:
            at = np.flatnonzero(begins[ids[: max(0, len(ids) - length + 1)]])
            hashes = _run_hashes(ids, at, length)
            first, past = np.searchsorted(marks, hashes, "left"), np.searchsorted(marks, hashes, "right")
            hit = np.flatnonzero(past > first)
            for h in hit:
                for k in range(first[h], past[h]):
                    begin = int(at[h] - offsets[k])
                    yield int(items[k]), begin, begin + int(self.lengths[items[k]])

    def answer_places(self, ids: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, first place, place after the last) around every set of an item's answer words large enough to verify.

        ``begins`` and ``ends`` are the places of the text around each word of ``ids``. A verified place is at most
        twice as long as its item, and so many words of the item stand in it.
        """
        items, features = self.answers
        order = np.argsort(ids, kind="stable")
        firsts = np.searchsorted(ids[order], np.arange(FEATURES + 1))
        counts = firsts[features + 1] - firsts[features]
        for piece in _pieces(np.bincount(items, counts, minlength=len(self.items)).astype(np.int64)):
            some = slice(*np.searchsorted(items, [piece.start, piece.stop]))
            at = order[_spread(firsts[features[some]], counts[some])]
            of = np.repeat(items[some], counts[some])
            both = np.sort(of * len(ids) + at)
            of, at = np.divmod(both, len(ids))
            until = np.arange(len(at)) + self.needs[of] - 1
            inside = np.flatnonzero(until < len(at))
            until = until[inside]
            reach = 2 * self.lengths[of[inside]]
            near = (of[until] == of[inside]) & (at[until] - at[inside] < reach) & (begins[at[until]] == begins[at[inside]])
            inside, until, reach = inside[near], until[near], reach[near]
            of, first, past = of[inside], at[until] - reach + 1, at[inside] + reach
            first, past = np.maximum(first, begins[at[inside]]), np.minimum(past, ends[at[inside]])
            for part in _pieces(past - first):
                sizes = past[part] - first[part]
                if not len(sizes):
                    continue
                keys = np.repeat(of[part] << 16, sizes) | ids[_spread(first[part], sizes)]
                found = np.minimum(np.searchsorted(self.members, keys), len(self.members) - 1)
                common = np.add.reduceat(self.members[found] == keys, np.cumsum(sizes) - sizes, dtype=np.int64)
                for c in np.flatnonzero(common >= LEAST_COMMON * self.lengths[of[part]]) + part.start:
                    yield int(of[c]), int(first[c]), int(past[c])

    def leaks(self, texts: list[str | None]) -> list[list[tuple[int, float, float, float, int, int]]]:
        """Per text (item, cosine, common share, answer share, first word, words) of each item, at its best place."""
        best: list[dict[int, tuple]] = [{} for _ in texts]
        words: tuple[int, list[bytes]] = (-1, [])
        for some in blocks_of(texts) if self.items else ():
            sums = self.projection[some.ids[:, 0]]
            for j in range(1, BLOCK_WORDS):
                sums += self.projection[some.ids[:, j]]
            # A passage is a block and the next one; the last block of a text is in the passage before it.
            last = np.ones(len(sums), bool)
            last[:-1] = some.order[1:] == 0
            passages = sums.copy()
            passages[:-1][~last[:-1]] += sums[1:][~last[:-1]]
            kept = np.flatnonzero(~last | (some.order == 0))
            passages = passages[kept]
            passages /= np.sqrt(np.einsum("ij,ij->i", passages, passages))[:, None] + 1e-9
            flat = some.ids.ravel()
            heads = np.flatnonzero(some.order == 0)
            sizes = np.bincount(np.cumsum(some.order == 0) - 1, (some.ids != NOTHING).sum(axis=1)).astype(np.int64)
            spans = np.diff(np.r_[heads, len(sums)]) * BLOCK_WORDS
            begins = np.repeat(heads * BLOCK_WORDS, spans)
            ends = begins + np.repeat(sizes, spans)

            def near(places: Iterator[tuple[int, int, int]]) -> None:
                """Check places among all words, which may reach beyond a text or begin before it."""
                nonlocal words
                for i, start, stop in places:
                    if start < 0 or stop > len(flat) or begins[start] != begins[stop - 1] or stop > ends[start]:
                        continue
                    text = int(some.text[start // BLOCK_WORDS])
                    if i in best[text] and best[text][i][2] == 1.0:
                        continue
                    if words[0] != text:
                        words = (text, words_of(texts[text]))
                    head = int(begins[start])
                    found = verified_within(self.items[i], words[1], start - head, stop - head)
                    if found and (i not in best[text] or found[0] > best[text][i][2]):
                        block = (head + found[2]) // BLOCK_WORDS
                        cosine = passages[np.searchsorted(kept, block, "right") - 1] @ self.vectors[i]
                        best[text][i] = (i, float(cosine), *found)

            near(self.run_places(flat))
            step = max(1, (1 << 22) // len(self.items))
            for at in range(0, len(passages), step):
                cosines = passages[at : at + step] @ self.vectors.T
                for p, i in zip(*np.nonzero(cosines >= LEAST_COSINE), strict=True):
                    block = kept[at + p]
                    text = int(some.text[block])
                    if words[0] != text:
                        words = (text, words_of(texts[text]))
                    first = int(some.order[block]) * BLOCK_WORDS
                    found = verified(self.items[i], words[1], first, first + 2 * BLOCK_WORDS)
                    if found and (i not in best[text] or found[0] > best[text][int(i)][2]):
                        best[text][int(i)] = (int(i), float(cosines[p, i]), *found)
            near(self.answer_places(flat, begins, ends))
        return [list(b.values()) for b in best]


def _indexes(docs: DataFrame, benchmark: DataFrame, text: str, item_key: str, item_text: str) -> Iterator[Index]:
    """One index for each ``ITEMS_AT_ONCE`` items."""
    idf, passages = _corpus(docs, text)
    basis = _directions()
    image = _gram_times(passages, basis, idf) * min(1.0, BALANCE / max(1, passages.count()))
    items = benchmark.select(own(item_key).alias("key"), own(item_text).alias("text"))
    groups = ceil(items.count() / ITEMS_AT_ONCE)
    for g in range(groups):
        chosen = items.where(F.pmod(F.xxhash64("key", "text"), F.lit(groups)) == g).collect()
        held = sorted((item_of(r["key"], r["text"], idf) for r in chosen), key=lambda i: (i.words, str(i.key)))
        held = [i for i in held if i.words]
        own_rows = [features_of(b" ".join(i.words))[0] for i in held]
        space = latent_space(image + ITEM_WEIGHT**2 * _items_times(own_rows, basis, idf), basis, idf)
        projection = np.vstack([space, np.zeros((1, space.shape[1]), np.float32)])
        vectors = np.zeros((len(held), projection.shape[1]), np.float32)
        for k, ids in enumerate(own_rows):
            v = projection[ids].sum(axis=0)
            vectors[k] = v / (np.sqrt(v @ v) + 1e-9)
        yield Index(projection, vectors, tuple(held), idf)


LEAKS = "array<struct<item: int, cosine: double, common_share: double, answer_share: double, first_word: int, words: int>>"


def _told(text: Column, index: Index, docs: DataFrame) -> Column:
    shared = docs.sparkSession.sparkContext.broadcast(index)  # bounded by FEATURES and ITEMS_AT_ONCE

    @F.pandas_udf(LEAKS)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = ["item", "cosine", "common_share", "answer_share", "first_word", "words"]
        for texts in batches:
            found_in = shared.value.leaks(list(texts))
            yield pd.Series([[dict(zip(names, x, strict=True)) for x in f] for f in found_in], dtype=object)

    return found(text)


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """One row per row of ``docs`` and benchmark item found in it: the columns of ``docs``, the item's key, ``cosine``,
    ``common_share``, ``answer_share``, ``first_word`` and ``words`` of the place found.

    Whole texts are searched. NULL and empty texts and items are never found; items of fewer than ``SHORT`` words only
    word for word. Repeated documents each give their rows, repeated items each theirs. Input columns of the added
    names are replaced. Without documents or items the result is empty.
    """
    key_type = benchmark.schema[item_key].dataType
    added = [item_key, "cosine", "common_share", "answer_share", "first_word", "words"]
    columns = carried(docs, added)
    out = None
    for index in _indexes(docs, benchmark, text, item_key, item_text):
        read = docs.select(packed(docs, columns).alias("row"), _told(own(text), index, docs).alias("found"))
        hits = read.where(F.size("found") > 0).select("row", F.inline("found"))
        spark = docs.sparkSession
        keys = spark.createDataFrame(
            [(k, i.key) for k, i in enumerate(index.items)], f"at int, key {key_type.simpleString()}"
        )
        named = hits.join(F.broadcast(keys), F.col("item") == F.col("at")).select(
            *unpacked(columns), F.col("key").alias(item_key), *added[1:]
        )
        out = named if out is None else out.unionByName(named)
    if out is None:
        nothing = docs.where("false").select(packed(docs, columns).alias("row"))
        kinds = "double double double int int".split()
        out = nothing.select(
            *unpacked(columns),
            F.lit(None).cast(key_type).alias(item_key),
            *[F.lit(None).cast(k).alias(n) for k, n in zip(kinds, added[1:], strict=True)],
        )
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found, with their columns."""
    item_key, item_text = options.get("item_key", "item_id"), options.get("item_text", "text")
    out = docs
    for index in _indexes(docs, benchmark, text, item_key, item_text):
        row = out.select(packed(docs, docs.columns).alias("row"), _told(own(text), index, docs).alias("found"))
        out = row.where(F.size("found") == 0).select(*unpacked(docs.columns))
    return out
