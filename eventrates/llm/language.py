"""Language identification with one Bloom filter for all languages.

Each slot of the filter is a mask with one bit per language. Ending the masks at an n-gram's slots tells all languages
that contain it. A text's hits per language, less those expected by chance from the filter's filling, decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .splits import sampled
from .storage import carried, checkpointed, own, packed, unpacked

# The fit sees about so many different rows of each language.
MOST_ROWS = 3000
SLOTS = 1 << 19
HASHES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
# An n-gram belongs to a language where its share is at least this part of its largest share in any language.
LEAST_PART = 0.3
LEAST_COUNT = 2
# Characters looked at in one step, to bound memory.
BLOCK = 1 << 19
UNDETERMINED = "und"


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _grams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams around each letter of an array of code points, other characters as 0, and the letters' places."""
    own_letter = _letters()[codes]
    c = np.where(own_letter, codes, 0).astype(np.uint64)
    at = np.flatnonzero(own_letter[1:-1]) + 1
    return (c[at - 1] << np.uint64(42)) | (c[at] << np.uint64(21)) | c[at + 1], at


def _blocks(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(trigrams, index of each one's text), in blocks; whole texts, in pieces where they are long."""
    first, held, size = 0, [], 0

    def flush() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        codes = np.frombuffer(("\n" + "\n".join(held) + "\n").encode("utf-32-le", "replace"), "<u4")
        ends = np.cumsum([len(t) + 1 for t in held]) + 1
        for at in range(0, max(1, len(codes) - 2), BLOCK):
            grams, places = _grams(codes[at : at + BLOCK + 2])
            yield grams, first + np.searchsorted(ends, places + at, "right")

    for i, t in enumerate(texts):
        t = t.lower()
        held.append(t)
        size += len(t)
        if size >= BLOCK:
            yield from flush()
            first, held, size = i + 1, [], 0
    if held:
        yield from flush()


@dataclass(frozen=True)
class Model:
    """Masks by slot (one row of 64-bit words each) and the chance of a false hit per language."""

    languages: tuple[str, ...]
    masks: np.ndarray
    false_hits: np.ndarray

    def hits(self, grams: np.ndarray) -> np.ndarray:
        """Masks of the languages that contain each n-gram."""
        out = self.masks[_slot(grams, HASHES[0])]
        for h in HASHES[1:]:
            out = out & self.masks[_slot(grams, h)]
        return out

    def tell(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        n = np.zeros(len(texts))
        hits = np.zeros((len(self.languages), len(texts)))
        for grams, of in _blocks(texts):
            if not len(grams):
                continue
            starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            who = of[starts]
            n[who] += np.diff(np.r_[starts, len(of)])
            found = self.hits(grams)
            for i in range(len(self.languages)):
                bit = (found[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
                hits[i, who] += np.add.reduceat(bit.astype(np.int64), starts)
        true = np.maximum(hits - n * self.false_hits[:, None], 0.0) / (1.0 - self.false_hits[:, None])
        if not len(self.languages):
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        best = true.argmax(axis=0)
        total = true.sum(axis=0)
        score = np.where(total > 0, true.max(axis=0) / np.maximum(total, 1e-9), 0.0)
        names = [self.languages[b] if k else UNDETERMINED for b, k in zip(best, n, strict=True)]
        return names, np.where(n > 0, score, 0.0)


def _slot(grams: np.ndarray, factor: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        mixed = grams * np.uint64(factor)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", most_rows: int = MOST_ROWS) -> Model:
    """Filter from labelled rows: NULL texts and languages are left out; without any, no language is known.

    Different rows are sampled per language up to about ``most_rows``, copies counting once. All n-grams of the sample
    are counted, and the filter's masks put together, in Spark; only the masks come to the driver, at most ``SLOTS``
    rows for each 64 languages.
    """
    rows = docs.select(own(text).alias("text"), own(lang).cast("string").alias("lang")).where("text is not null and lang is not null")
    rows = sampled(rows, "lang", most_rows)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, part in batch.groupby("lang"):
                for grams, _ in _blocks(list(part["text"])):
                    values, n = np.unique(grams, return_counts=True)
                    yield pd.DataFrame({"lang": name, "gram": values.astype(np.int64), "n": n.astype(np.int64)})

    counted = rows.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = checkpointed(counted)
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = counted.join(totals, "lang").select("lang", "gram", "n", (F.col("n") / F.col("total")).alias("share"))
    largest = F.max("share").over(Window.partitionBy("gram"))  # one row per language
    kept = shares.withColumn("largest", largest).where((F.col("share") >= LEAST_PART * F.col("largest")) & (F.col("n") >= LEAST_COUNT))
    kept = checkpointed(kept.select("lang", "gram"))
    languages = tuple(sorted(r["lang"] for r in kept.select("lang").distinct().collect()))
    place = {name: i for i, name in enumerate(languages)}

    def filled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = batch["lang"].map(place).to_numpy(np.int64)
            bits = (np.uint64(1) << (at % 64).astype(np.uint64)).view(np.int64)
            for h in HASHES:
                slots = _slot(batch["gram"].to_numpy().astype(np.uint64), h)
                yield pd.DataFrame({"slot": slots, "word": at // 64, "bits": bits})

    table = kept.mapInPandas(filled, "slot long, word long, bits long").groupBy("slot", "word").agg(F.bit_or("bits").alias("mask"))
    masks = np.zeros((SLOTS, max(1, -(-len(languages) // 64))), np.uint64)
    if languages:
        found = table.toPandas()
        masks[found["slot"].to_numpy(), found["word"].to_numpy()] = found["mask"].to_numpy(np.int64).view(np.uint64)
    set_bits = [(masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1) for i in range(len(languages))]
    false_hits = np.array([min(0.99, float(bit.mean()) ** len(HASHES)) for bit in set_bits])
    return Model(languages, masks, false_hits)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All rows of ``docs`` with ``lang_pred`` and ``score`` (0 to 1, the language's share of all corrected hits).

    Whole texts are read. NULL texts and texts without a letter are ``und`` with score 0. Equal hits go to the first
    language in code point order. Repeated rows stay. Input columns of the two names are replaced. An empty table
    gives an empty table.
    """
    columns = carried(docs, ["lang_pred", "score"])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by SLOTS

    @F.pandas_udf("lang_pred string, score double")
    def told(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            names, score = shared.value.tell([t or "" for t in texts])
            yield pd.DataFrame({"lang_pred": names, "score": score})

    out = docs.select(packed(docs, columns).alias("row"), told(own(text)).alias("told"))
    return out.select(*unpacked(columns), "told.lang_pred", "told.score")
