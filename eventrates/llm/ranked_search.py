"""Ranked lexical search by hashed max-sketches.

The index holds one sketch per document, whatever will be asked: its terms' frequencies are hashed to a few coordinates
each and every coordinate keeps the largest. A term's least coordinate is never below its frequency, so with the
document's length it bounds the term's score from above. Batches of queries are looked up in blocks of sketches. The
documents of highest bound are scored exactly first and give each query a threshold; then every document whose bound
reaches the threshold is scored, in descending order of its bound, until the bound falls below the scores found.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sharding import numbered
from .storage import broadcast_below, own, stored

# Sketch: coordinates a term, and at least so many coordinates for each distinct term.
HASHES = 3
WIDTH_PER_TERM = 8
LEAST_BITS = 6
FULL = 255
SPREAD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
# Queries of one pass over the index, and the documents of highest bound that give a query its first threshold.
ITEMS_AT_ONCE = 2000
SEEDS = 16
# Bytes of the tables that a task looks up at once.
BLOCK = 1 << 25
NOT_IN_TERMS = bytes(c for c in range(128) if not chr(c).isalnum())
TO_SPACE = bytes.maketrans(NOT_IN_TERMS, b" " * len(NOT_IN_TERMS))


def terms_of(text: str | None) -> list[bytes]:
    """Runs of letters, digits and characters beyond ASCII; A-Z lower-cased."""
    return (text or "").encode().lower().translate(TO_SPACE).split()


def _hashes(terms: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, terms), np.uint64, len(terms))


def _places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(hashes * np.uint64(s) >> np.uint64(64 - bits)).astype(np.int64) for s in SPREAD[:HASHES]]


def sketch_of(text: str | None) -> tuple[int, bytes]:
    """Number of terms, and the largest frequency at each coordinate, 255 for all from there on.

    The sketch is the longer the more terms a document has, a power of two of coordinates; without terms it is empty.
    """
    terms = terms_of(text)
    if not terms:
        return 0, b""
    counts = Counter(terms)
    bits = max(LEAST_BITS, (WIDTH_PER_TERM * len(counts) - 1).bit_length())
    level = np.minimum(np.fromiter(counts.values(), np.int64, len(counts)), FULL).astype(np.uint8)
    table = np.zeros(1 << bits, np.uint8)
    for place in _places(_hashes(list(counts)), bits):
        np.maximum.at(table, place, level)
    return len(terms), table.tobytes()


def sketches(text: Column) -> Column:
    """``n`` and ``sketch`` of a text column."""

    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([sketch_of(t) for t in texts], columns=["n", "sketch"])

    return F.pandas_udf(of, "n long, sketch binary")(text)


@dataclass
class Queries:
    """A block of queries: distinct terms by query, their weights, and the corpus sums that scores need."""

    terms: list[bytes]
    hashes: np.ndarray
    of_item: list[list[int]]
    weights: np.ndarray
    documents: int
    length: int

    def damping(self, n: np.ndarray) -> np.ndarray:
        """How much a document of ``n`` terms damps frequencies, in hundredths."""
        return 10 + 90 * n * self.documents // max(self.length, 1)

    def by_term(self) -> tuple[np.ndarray, np.ndarray]:
        """Queries of each term, one after another, and where those of a term start."""
        pairs = sorted((t, i) for i, own_terms in enumerate(self.of_item) for t in own_terms)
        starts = np.searchsorted([t for t, _ in pairs], np.arange(len(self.terms) + 1))
        return np.array([i for _, i in pairs], np.int64), starts

    def bounds(self, n: np.ndarray, tables: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of documents: their places in the batch, and upper bounds of their scores by query."""
        items, starts = self.by_term()
        sizes = np.array([len(t) for t in tables], np.int64)
        damping = self.damping(n)
        for size in np.unique(sizes[sizes > 0]):
            members = np.flatnonzero(sizes == size)
            places = _places(self.hashes, int(size).bit_length() - 1)
            step = int(max(1, BLOCK // max(size, len(self.terms), 8 * len(self.of_item))))
            for at in range(0, len(members), step):
                docs = members[at : at + step]
                table = np.frombuffer(b"".join(tables[d] for d in docs), np.uint8).reshape(len(docs), size)
                level = table[:, places[0]]
                for place in places[1:]:
                    np.minimum(level, table[:, place], out=level)
                d, t = np.nonzero(level)
                f = level[d, t].astype(np.int64)
                impact = np.where(f < FULL, 1_000_000_000 * f // (1000 * f + 8 * damping[docs[d]]), 1_000_000)
                impact *= self.weights[t]
                many = starts[t + 1] - starts[t]
                first = np.repeat(starts[t] - np.concatenate([[0], np.cumsum(many)[:-1]]), many)
                item = items[first + np.arange(len(first))]
                cell = np.repeat(d, many) * len(self.of_item) + item
                total = np.bincount(cell, np.repeat(impact, many), len(docs) * len(self.of_item))
                yield docs, total.reshape(len(docs), -1)

    def score(self, item: int, counts: Counter, damping: int) -> int:
        total = 0
        for t in self.of_item[item]:
            f = counts.get(self.terms[t])
            if f:
                total += int(self.weights[t]) * (1_000_000_000 * f // (1000 * f + 8 * damping))
        return total


def index(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Stored index of all rows: ``at`` (row), ``doc`` (key, a whole number), ``text``, ``n`` and ``sketch``."""
    whole = F.coalesce(own(text).cast("string"), F.lit(""))
    rows = docs.select(own(key).cast("long").alias("doc"), whole.alias("text"))
    rows = rows.select("doc", "text", sketches(F.col("text")).alias("of"))
    return stored(rows.select(F.monotonically_increasing_id().alias("at"), "doc", "text", "of.n", "of.sketch"))


def _frequencies(rows: DataFrame, terms: list[bytes]) -> list[int]:
    """Documents that hold each of the terms; each task adds up its own first."""
    sent = rows.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, found = sent.value, Counter()
        for pdf in batches:
            for text in pdf["text"]:
                found.update(number.keys() & set(terms_of(text)))
        yield pd.DataFrame({"t": [number[t] for t in found], "df": list(found.values())}, dtype="int64")

    out = [0] * len(terms)
    for r in rows.select("text").mapInPandas(counted, "t long, df long").groupBy("t").agg(F.sum("df")).collect():
        out[r[0]] = r[1]
    return out


def _block(rows: DataFrame, texts: list[str | None], documents: int, length: int) -> Queries:
    each = [sorted(set(terms_of(t))) for t in texts]
    terms = sorted(set().union(*each))
    number = {t: i for i, t in enumerate(terms)}
    weights = [math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in _frequencies(rows, terms)]
    of_item = [[number[t] for t in own_terms] for own_terms in each]
    return Queries(terms, _hashes(terms), of_item, np.array(weights, np.int64), documents, length)


def _seeds(rows: DataFrame, sent, most: int) -> DataFrame:
    """(item, at): the documents of highest bound for each query."""

    def highest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queries, best = sent.value, None
        for pdf in batches:
            at = pdf["at"].to_numpy()
            for docs, bound in queries.bounds(pdf["n"].to_numpy(), pdf["sketch"].to_list()):
                new = [bound, np.broadcast_to(at[docs][:, None], bound.shape)]
                both = new if best is None else [np.concatenate(x) for x in zip(best, new)]
                if len(both[0]) > most:
                    top = np.argpartition(-both[0], most - 1, axis=0)[:most]
                    both = [np.take_along_axis(x, top, axis=0) for x in both]
                best = both
        if best is not None:
            item = np.broadcast_to(np.arange(best[0].shape[1]), best[0].shape)
            out = pd.DataFrame({"item": item.ravel(), "bound": best[0].ravel(), "at": best[1].ravel()})
            yield out[out["bound"] > 0]

    found = rows.select("at", "n", "sketch").mapInPandas(highest, "item long, bound double, at long")
    order = Window.partitionBy("item").orderBy(F.desc("bound"), "at")
    return found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).select("item", "at")


def _thresholds(rows: DataFrame, seeds: DataFrame, sent, items: int, k: int) -> np.ndarray:
    """The k-th exact score among the seeds of each query; 1 where fewer have a score."""

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queries = sent.value
        for pdf in batches:
            out = []
            for text, n, asked in zip(pdf["text"], pdf["n"], pdf["items"]):
                counts, damping = Counter(terms_of(text)), int(queries.damping(n))
                out += [(i, queries.score(i, counts, damping)) for i in asked]
            yield pd.DataFrame(out, columns=["item", "score"], dtype="int64")

    asked = seeds.groupBy("at").agg(F.collect_list("item").alias("items")).withColumnRenamed("at", "of")
    asked = stored(asked)
    picked = rows.join(broadcast_below(asked, items * SEEDS), F.col("at") == F.col("of"))
    found = picked.select("text", "n", "items").mapInPandas(scored, "item long, score long")
    limits = np.ones(items, np.int64)
    for r in found.groupBy("item").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).collect():
        if len(r["s"]) >= k:
            limits[r["item"]] = max(1, r["s"][k - 1])
    return limits


def _rescored(rows: DataFrame, sent, limits: np.ndarray, k: int) -> DataFrame:
    """(item, doc, score): the ``k`` best documents of each task for each query, exactly scored."""

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queries = sent.value
        heaps: list[list[tuple]] = [[] for _ in queries.of_item]
        floor = limits.astype(np.float64)
        for pdf in batches:
            n, texts, names = pdf["n"].to_numpy(), pdf["text"].to_list(), pdf["doc"].to_numpy()
            unnamed, damping = pdf["unnamed"].to_numpy(), queries.damping(n)
            counts: dict[int, Counter] = {}
            for docs, bound in queries.bounds(n, pdf["sketch"].to_list()):
                row, item = np.nonzero(bound >= floor)
                order = np.lexsort((-bound[row, item], item))
                for d, i in zip(row[order].tolist(), item[order].tolist()):
                    if bound[d, i] < floor[i]:  # the query's later documents have lower bounds still
                        continue
                    doc = int(docs[d])
                    if doc not in counts:
                        counts[doc] = Counter(terms_of(texts[doc]))
                    score = queries.score(i, counts[doc], int(damping[doc]))
                    if score < floor[i]:
                        continue
                    entry = (score, not unnamed[doc], -int(names[doc]))
                    if len(heaps[i]) < k:
                        heapq.heappush(heaps[i], entry)
                    else:
                        heapq.heappushpop(heaps[i], entry)
                    if len(heaps[i]) == k:
                        floor[i] = max(floor[i], heaps[i][0][0])
        out = [(i, -doc if named else None, score) for i, heap in enumerate(heaps) for score, named, doc in heap]
        table = pd.DataFrame(out, columns=["item", "doc", "score"])
        yield table.astype({"item": "int64", "doc": "Int64", "score": "int64"})

    doc = [F.coalesce("doc", F.lit(0)).alias("doc"), F.col("doc").isNull().alias("unnamed")]
    return rows.select(*doc, "text", "n", "sketch").mapInPandas(best, "item long, doc long, score long")


def search(
    docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id",
    item_text: str = "text", k: int = 10,
) -> DataFrame:
    """The ``k`` documents of highest score for each row of ``items``: its key, ``rank``, ``doc_id`` and ``score``.

    Terms, weights and scores: see ``terms_of`` and ``Queries``. Only scores above 0 are ranked; equal scores stand in
    the order of the key, NULL last. NULL texts have no terms; repeated documents are ranked each, repeated items get a
    ranking each. Items are worked on in blocks of 2,000, each against all documents. Empty tables give an empty one.
    """
    rows = index(docs, text, key)
    total = rows.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    asked, many = numbered(items.select(own(item).alias("item_id"), own(item_text).alias("item_text")), "item_id", "number")
    asked = stored(asked)
    found = None
    context = docs.sparkSession.sparkContext
    for start in range(0, many, ITEMS_AT_ONCE):
        block = asked.where((F.col("number") >= start) & (F.col("number") < start + ITEMS_AT_ONCE)).orderBy("number").collect()
        queries = _block(rows, [r["item_text"] for r in block], total[0], total[1])
        if not queries.terms:
            continue
        sent = context.broadcast(queries)
        limits = _thresholds(rows, _seeds(rows, sent, max(SEEDS, k)), sent, len(block), k)
        part = _rescored(rows, sent, limits, k).withColumn("item", F.col("item") + start)
        found = part if found is None else found.union(part)
    names = asked.select(F.col("number"), "item_id")
    if found is None:
        return names.where("false").select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    ranked = stored(ranked)
    out = ranked.join(names, F.col("item") == F.col("number"))
    return out.select("item_id", F.col("rank").cast("int").alias("rank"), F.col("doc").alias("doc_id"), "score")
