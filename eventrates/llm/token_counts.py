"""Token counts that follow edits.

A document is cut into leaves at places where every tokenization of the whole text also cuts. A segment tree over the
leaves holds the characters and tokens below each node. An edit finds its leaves by descending the tree; only they, and
neighbours where the cut between them no longer holds, are encoded again, and the sums above them are corrected.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import carried, own, packed, unpacked

# Fixed value: how this family of byte-level vocabularies cuts text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
LEAF_CHARACTERS = 256


@cache
def encoding(vocabulary: str = VOCABULARY):
    """Encoder of a vocabulary file of ranks; the file lies at the same path on every machine."""
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(text: str, vocabulary: str = VOCABULARY) -> int:
    return len(encoding(vocabulary).encode_ordinary(text))


@cache
def kind(character: str) -> str:
    """``L`` letter, ``N`` number, ``S`` white space, ``O`` other, as the pattern tells them; empty where tables of
    Unicode may differ (the class of 2002 and that of today)."""

    def of(table) -> str:
        name = table.category(character)
        if character in "\t\n\v\f\r\x85" or name[0] == "Z":
            return "S"
        return "" if name == "Cn" else name[0] if name[0] in "LN" else "O"

    return of(unicodedata) if of(unicodedata) == of(unicodedata.ucd_3_2_0) else ""


def holds(before: str, after: str) -> bool:
    """Whether the text is cut between two parts whatever else they hold: where the kind changes, but not after white
    space.

    No alternative of the pattern goes on over such a place, but for an apostrophe before a letter. Only white space
    looks ahead, so what ends in another character is matched as if nothing followed.
    """
    a, b = before[-1:], after[:1]
    if not a or not b or (a == "'" and kind(b) == "L"):
        return False
    return kind(a) != kind(b) and kind(a) not in ("", "S") and kind(b) != ""


def cut(text: str) -> list[str]:
    """Leaves of about ``LEAF_CHARACTERS``. Only one run of letters, numbers or other characters, or of white space and
    the run after it, is longer: merges in it may depend on all of it."""
    leaves, at = [], 0
    while at < len(text):
        p = at + LEAF_CHARACTERS
        while p < len(text) and not holds(text[p - 1], text[p]):
            p += 1
        leaves.append(text[at:p])
        at = p
    return leaves


class Tree:
    """Characters and tokens of leaves, and their sums in two heaps; node 1 is the root."""

    def __init__(self, characters: np.ndarray, tokens: np.ndarray) -> None:
        self.width = width = 1 << max(0, int(len(characters) - 1).bit_length())
        self.sums = np.zeros((2, 2 * width), np.int64)
        self.sums[0, width : width + len(characters)] = characters
        self.sums[1, width : width + len(tokens)] = tokens
        low = width
        while low > 1:
            self.sums[:, low // 2 : low] = self.sums[:, low : 2 * low : 2] + self.sums[:, low + 1 : 2 * low : 2]
            low //= 2

    @classmethod
    def of(cls, text: str, vocabulary: str = VOCABULARY) -> Tree:
        leaves = cut(text)
        encode = encoding(vocabulary).encode_ordinary
        return cls(np.array([len(x) for x in leaves], np.int64), np.array([len(encode(x)) for x in leaves], np.int64))

    @property
    def characters(self) -> int:
        return int(self.sums[0, 1])

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def leaf_at(self, place: int) -> tuple[int, int]:
        """Leaf that holds a character, and the leaf's first character."""
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if place - start >= self.sums[0, node]:
                start += int(self.sums[0, node])
                node += 1
        return node - self.width, start

    def put(self, leaf: int, characters: int, tokens: int) -> None:
        """Replace a leaf and correct the sums above it."""
        node = leaf + self.width
        self.sums[:, node] = characters, tokens
        while node > 1:
            node //= 2
            self.sums[:, node] = self.sums[:, 2 * node] + self.sums[:, 2 * node + 1]


def in_order(edits: list[tuple[int, int, str]], length: int) -> list[tuple[int, int, str]]:
    """Edits (start, end, replacement) within the text by place; one that overlaps an earlier one is left out."""
    out: list[tuple[int, int, str]] = []
    for start, end, text in sorted(edits):
        if 0 <= start <= end <= length and (not out or start >= out[-1][1]):
            out.append((start, end, text))
    return out


def edit(tree: Tree, text: str, edits: list[tuple[int, int, str]], vocabulary: str = VOCABULARY) -> tuple[str, int]:
    """Apply edits to a text and its tree; returns the new text and how many characters were encoded again."""
    edits = in_order(edits, len(text))
    if not edits:
        return text, 0
    if not text:
        new = "".join(r for _, _, r in edits)
        tree.put(0, len(new), count(new, vocabulary))
        return new, len(new)
    starts = [e[0] for e in edits]

    def leaf_range(place: int) -> tuple[int, int]:
        leaf, start = tree.leaf_at(min(place, len(text) - 1))
        return start, start + int(tree.sums[0, leaf + tree.width])

    def edited(start: int, end: int) -> str:
        """The text of whole leaves from ``start`` to ``end`` with their edits; one at the very end is the last leaf's."""
        parts, at = [], start
        upto = len(edits) if end == len(text) else bisect_left(starts, end)
        for first, last, new in edits[bisect_left(starts, start) : upto]:
            parts += [text[at:first], new]
            at = last
        return "".join([*parts, text[at:end]])

    touched = deque((leaf_range(e[0])[0], leaf_range(max(e[0], e[1] - 1))[1]) for e in edits)
    done: list[tuple[int, int, str]] = []
    while touched:
        start, end = touched.popleft()
        while True:
            while touched and touched[0][0] < end:
                end = max(end, touched.popleft()[1])
            new = edited(start, end)
            if start > 0 and done and done[-1][1] == start:
                if not holds(done[-1][2], new):
                    start = done.pop()[0]
                    continue
            elif start > 0 and not holds(text[start - 1], new):
                start = leaf_range(start - 1)[0]
                continue
            if end < len(text) and not (touched and touched[0][0] == end) and not holds(new, text[end : end + 2]):
                end = leaf_range(end)[1]
                continue
            break
        done.append((start, end, new))
    parts, at, again = [], 0, 0
    changes = []
    for start, end, new in done:
        parts += [text[at:start], new]
        at = end
        place, leaves = start, []
        while place < end:
            leaf, first = tree.leaf_at(place)
            leaves.append(leaf)
            place = first + int(tree.sums[0, leaf + tree.width])
        changes.append((leaves, len(new), count(new, vocabulary)))
        again += len(new)
    for leaves, characters, tokens in changes:
        tree.put(leaves[0], characters, tokens)
        for leaf in leaves[1:]:
            tree.put(leaf, 0, 0)
    return "".join([*parts, text[at:]]), again


def with_trees(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """All rows of ``docs`` with ``leaves``, the characters and tokens of each leaf, and ``n_tokens``.

    Sums of inner nodes follow from the leaves when a tree is read. NULL and empty texts have no leaf and 0 tokens.
    Repeated rows stay. Input columns of the two names are replaced. An empty table gives an empty table.
    """
    columns = carried(docs, ["leaves", "n_tokens"])

    @F.pandas_udf("characters array<int>, tokens array<int>")
    def built(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encode = encoding(vocabulary).encode_ordinary
        for texts in batches:
            parts = [cut(t or "") for t in texts]
            yield pd.DataFrame(
                {"characters": [[len(x) for x in p] for p in parts], "tokens": [[len(encode(x)) for x in p] for p in parts]}
            )

    out = docs.select(packed(docs, columns).alias("row"), built(own(text)).alias("leaves"))
    total = F.aggregate("leaves.tokens", F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select(*unpacked(columns), "leaves", total.alias("n_tokens"))


def apply_edits(trees: DataFrame, edits: str = "edits", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Apply each row's ``edits`` (array of struct start, end, replacement; characters, end exclusive) to text and tree.

    ``text``, ``leaves`` and ``n_tokens`` become those after the edits; ``n_again`` is how many characters were encoded
    again. Of overlapping edits the first counts; edits outside the text and with NULL parts are left out; NULL texts
    stay NULL. The column of edits is dropped. Rows without edits are handed on without encoding anything.
    """
    columns = carried(trees, [edits, text, "leaves", "n_tokens", "n_again"])

    @F.pandas_udf("text string, characters array<int>, tokens array<int>, n_again long")
    def done(batches: Iterator[tuple[pd.Series, pd.DataFrame, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, leaves, changes in batches:
            rows = []
            for t, c, k, es in zip(texts, leaves["characters"], leaves["tokens"], changes, strict=True):
                if t is None or es is None or not len(es):
                    rows.append((t, c, k, 0))
                    continue
                tree = Tree(np.asarray(c, np.int64), np.asarray(k, np.int64))
                wanted = [(e["start"], e["end"], e["replacement"]) for e in es if None not in e.values()]
                new, again = edit(tree, t, wanted, vocabulary)
                used = tree.sums[:, tree.width :]
                used = used[:, used[0] > 0]
                rows.append((new, used[0].tolist(), used[1].tolist(), again))
            yield pd.DataFrame(rows, columns=["text", "characters", "tokens", "n_again"])

    row = packed(trees, columns).alias("row")
    new = trees.select(row, done(own(text), own("leaves"), own(edits)).alias("new"))
    leaves = F.struct("new.characters", "new.tokens")
    total = F.aggregate("new.tokens", F.lit(0).cast("long"), lambda a, x: a + x)
    return new.select(
        *unpacked(columns), F.col("new.text").alias(text), leaves.alias("leaves"), total.alias("n_tokens"), "new.n_again"
    )


# What a scrubbing pass replaces: addresses of electronic mail, and numbers of seven digits or more.
SCRUBBED = [(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "<EMAIL>"), (r"\+?\(?\d(?:[ ().-]{0,2}\d){6,}", "<NUMBER>")]


def scrubbing_edits(text: Column) -> Column:
    """Edits that replace mail addresses and long numbers; of overlapping ones the first counts."""
    patterns = [(re.compile(p), r) for p, r in SCRUBBED]

    @F.pandas_udf("array<struct<start: int, end: int, replacement: string>>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(
                [
                    [{"start": m.start(), "end": m.end(), "replacement": r} for p, r in patterns for m in p.finditer(t or "")]
                    for t in texts
                ],
                dtype=object,
            )

    return found(text)
