"""Removal of byte strings that stand twice, by prefix doubling on anchored positions.

Every string of ``length`` bytes contains ``run`` grams; the one with the least hash is its anchor, wherever the string
stands. Only anchors (under one position in a hundred of plain text) take part in sorting, each for all the strings
that start at up to ``run`` places before it. A round names the byte string that all of those share, by a pair of names
at an offset from each other, Spark groups equal pairs, and positions whose pair is unique leave. Where even the string
that covers all of them is repeated, the places are done at once; otherwise the places are cut into eighths, whose
shared string reaches further (145, 369, 397, 400 bytes), and the next round groups pairs at the larger offsets. The
last round names whole strings of single places, so the result is exact up to equal 128-bit names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import carried, own, packed, stored, unpacked

LENGTH = 400
# Window starts of one text worked on at once; longer texts go through in pieces that overlap.
PIECE = 1 << 20
# Contexts whose names are computed at once.
ROWS = 1 << 11
BASE = 0x9E3779B97F4A7C15
SPLIT = 8
SPANS = "array<struct<start:long,end:long>>"


def shape(length: int) -> tuple[int, tuple[int, ...]]:
    """Bytes of a gram, and the number of places that each round takes together, down to one."""
    if length < 1:
        raise ValueError("length must be positive")
    run = 1 << max(0, (2 * length // 3).bit_length() - 1)
    widths = [run]
    while widths[-1] > 1:
        widths.append(max(1, widths[-1] // SPLIT))
    return length - run + 1, tuple(widths)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


VALUES = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse, modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) <= n:
        size = max(n + 1, 1 << 14)
        _POWERS[:] = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _POWERS.append(np.multiply.accumulate(factors))
    return _POWERS[0], _POWERS[1]


def _sums(data: np.ndarray) -> np.ndarray:
    """Running sums of byte values times powers, along the last axis, from 0."""
    n = data.shape[-1]
    total = np.zeros((*data.shape[:-1], n + 1), np.uint64)
    np.cumsum(VALUES[data] * _powers(n)[0][:n], axis=-1, out=total[..., 1:])
    return total


def _pair(take, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the first and last halves of the strings at ``starts``; ``take(starts, length)`` gives raw names."""
    half = (length + 1) // 2
    return _mixed(take(starts, half)), _mixed(take(starts + (length - half), half))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of ``width`` values."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: bytes, length: int = LENGTH) -> dict[str, np.ndarray]:
    """Anchors of one text: place ``a``, the nearest and farthest string start before it (``near``, ``far``), the pair
    of names of its gram (``k1``, ``k2``) and of the string around it (``u1``, ``u2``, where ``around``)."""
    gram, (run, *_) = shape(length)
    n, parts = len(data), []
    whole = np.frombuffer(data, np.uint8)
    for begin in range(0, n - length + 1, PIECE):
        count = min(PIECE, n - length + 1 - begin)
        low, high = max(0, begin - run), min(n, begin + count + 2 * length)
        total = _sums(whole[low:high])
        down = _powers(high - low)[1]

        def take(starts: np.ndarray, size: int, total: np.ndarray = total, down: np.ndarray = down) -> np.ndarray:
            return (total[starts + size] - total[starts]) * down[starts]

        at, m = begin - low, count + run - 1
        order = _mixed((total[at + gram : at + gram + m] - total[at : at + m]) * down[at : at + m])
        # The upper half of the hash decides, then the leftmost place.
        order = (order >> np.uint64(32) << np.uint64(32)) | np.arange(m, dtype=np.uint64)
        place = (_least(order, run) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        turns = np.flatnonzero(np.diff(place))
        first, last = np.concatenate([[0], turns + 1]), np.concatenate([turns, [count - 1]])
        a = place[first]
        k1, k2 = _pair(take, a + at, gram)
        left, right = a + at - run + 1, a + at + length
        around = (left >= 0) & (right <= high - low)
        spot = np.where(around, left, 0)
        if around.any():
            u1, u2 = _pair(take, spot, length + run - 1)
        else:
            u1 = u2 = np.zeros(len(a), np.uint64)
        # Names of nothing are told apart by their place, so that they spread over tasks.
        lone = _mixed(k1 ^ (a + begin).astype(np.uint64))
        u1, u2 = np.where(around, u1, lone), np.where(around, u2, lone)
        parts.append([a + begin, a - last, a - first, k1, k2, u1, u2, around])
        if len(parts) > 1 and parts[-2][0][-1] == a[0] + begin:  # an anchor shared by two pieces
            parts[-2][2][-1] = max(parts[-2][2][-1], parts[-1][2][0])
            parts[-2][1][-1] = min(parts[-2][1][-1], parts[-1][1][0])
            parts[-1] = [x[1:] for x in parts[-1]]
    columns = ["a", "near", "far", "k1", "k2", "u1", "u2", "around"]
    if not parts:
        return {c: np.empty(0, np.int64) for c in columns}
    return dict(zip(columns, map(np.concatenate, zip(*parts))))


ANCHOR_SCHEMA = "t1 long, t2 long, a long, o int, near int, far int, k1 long, k2 long, u1 long, u2 long, around boolean"
CONTEXT_SCHEMA = "t1 long, t2 long, a long, near int, far int, left int, bytes binary"


def _anchor_rows(length: int):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for t1, t2, text in zip(pdf["t1"], pdf["t2"], pdf["text"]):
                data = text.encode()
                if len(data) < length:
                    continue
                table = anchors(data, length)
                n = len(table["a"])
                found.append({"t1": np.full(n, t1), "t2": np.full(n, t2), "o": np.zeros(n, np.int32)} | table)
            if not found:
                continue
            out = {c: np.concatenate([f[c] for f in found]) for c in found[0]}
            for c in ("k1", "k2", "u1", "u2"):
                out[c] = out[c].astype(np.uint64).view(np.int64)
            out["near"], out["far"] = out["near"].astype(np.int32), out["far"].astype(np.int32)
            out["around"] = out["around"].astype(bool)
            yield pd.DataFrame(out)[[c.split()[0] for c in ANCHOR_SCHEMA.split(", ")]]

    return rows


def _context_rows(length: int, run: int):
    """The bytes around each open anchor: all strings that start up to ``run`` - 1 places before it."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.drop_duplicates(["t1", "t2"])
            out = []
            for t1, t2, text, places in zip(pdf["t1"], pdf["t2"], pdf["text"], pdf["places"]):
                data = text.encode()
                for p in places:
                    a = p["a"]
                    low = max(0, a - run + 1)
                    out.append((t1, t2, a, p["near"], p["far"], a - low, data[low : a + length]))
            if out:
                yield pd.DataFrame(out, columns=["t1", "t2", "a", "near", "far", "left", "bytes"])

    return rows


def _range_rows(length: int, run: int, before: int, width: int):
    """Pairs of names of the ranges of ``width`` places that open ranges of ``before`` places are cut into."""
    shared, around = length - width + 1, length + width - 1
    reach = run - 1 + length

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), ROWS):
                pdf = whole.iloc[at : at + ROWS]
                table = np.zeros((len(pdf), reach), np.uint8)
                low = run - 1 - pdf["left"].to_numpy()
                high = low + pdf["bytes"].map(len).to_numpy()
                for i, data in enumerate(pdf["bytes"]):
                    table[i, low[i] : high[i]] = np.frombuffer(data, np.uint8)
                total, down = _sums(table), _powers(reach)[1]
                counts = pdf["starts"].map(len).to_numpy()
                parents = np.concatenate(pdf["starts"].to_list()).astype(np.int64)
                each = before // width
                o = (parents[:, None] + np.arange(each) * width).ravel()
                i = np.repeat(np.repeat(np.arange(len(pdf)), counts), each)
                near, far = pdf["near"].to_numpy()[i], pdf["far"].to_numpy()[i]
                # The shared string starts at the last place of the range, the one around it at the first.
                start = run - 1 - o
                fits = (o <= far) & (o + width > near) & (start >= low[i]) & (start + shared <= high[i])
                o, i, start = o[fits], i[fits], start[fits]
                if not len(o):
                    continue

                def take(starts: np.ndarray, size: int, total=total, down=down, i=i) -> np.ndarray:
                    return (total[i, starts + size] - total[i, starts]) * down[starts]

                k1, k2 = _pair(take, start, shared)
                first = start - width + 1
                inside = (first >= low[i]) & (first + around <= high[i])
                u1, u2 = _pair(take, np.where(inside, first, 0), around)
                lone = _mixed(k1 ^ pdf["a"].to_numpy()[i].astype(np.uint64))
                out = {c: pdf[c].to_numpy()[i] for c in ("t1", "t2", "a")} | {"o": o.astype(np.int32)}
                out |= {c: pdf[c].to_numpy()[i] for c in ("near", "far")}
                out |= {"k1": k1.view(np.int64), "k2": k2.view(np.int64)}
                out |= {"u1": np.where(inside, u1, lone).view(np.int64), "u2": np.where(inside, u2, lone).view(np.int64)}
                yield pd.DataFrame(out | {"around": inside})

    return rows


def _twice(rows: DataFrame, names: list[str]) -> DataFrame:
    """Names that more than one row has. Stored, so that a join deals its own sides and can split a name of many rows."""
    return stored(rows.groupBy(*names).agg(F.count("*").alias("n")).where("n > 1").drop("n"))


def _judged(rows: DataFrame, last: bool) -> tuple[DataFrame, DataFrame | None]:
    """Ranges done: the string around them stands twice. And those that go on, as their shared string stands twice.

    Counts are added up by each task first and joined back, so a string of a third of all rows is no task's work alone.
    A range that is done goes on, too, where an open one may match it further; of those equal all around, one is enough.
    """
    names, shared, around = ["t1", "t2", "a", "o", "near", "far"], ["o", "k1", "k2"], ["o", "u1", "u2"]
    live = rows.join(_twice(rows, shared), shared, "left_semi")
    if last:
        return stored(live.select(*names)), None
    live = stored(live)
    found = live.join(_twice(live.where("around"), around).withColumn("met", F.lit(True)), around, "left")
    found = stored(found.withColumn("done", F.col("met").isNotNull() & F.col("around")).drop("met"))
    done, left = found.where("done"), found.where("not done")
    one = F.min(F.struct("t1", "t2", "a", "near", "far")).alias("one")
    met = stored(done.groupBy(*shared, "u1", "u2").agg(one)).join(stored(left.select(*shared).distinct()), shared, "left_semi")
    met = met.select("one.t1", "one.t2", "one.a", "o", "one.near", "one.far")
    return done.select(*names), left.select(*names).union(met)


def _spans(done: DataFrame, width: int, length: int) -> DataFrame:
    """Byte ranges covered by repeated strings."""
    start = F.col("a") - F.col("o") - (width - 1)
    end = F.col("a") - F.col("o") + length
    return done.select("t1", "t2", start.alias("start"), end.alias("end"))


def _merge(spans: pd.Series) -> pd.Series:
    """Maximal runs of overlapping or touching spans, in order."""
    out = []
    for row in spans:
        if len(row) == 0:
            out.append([])
            continue
        table = np.array([(s["start"], s["end"]) for s in row], np.int64)
        table = table[np.argsort(table[:, 0], kind="stable")]
        reach = np.maximum.accumulate(table[:, 1])
        new = np.flatnonzero(np.concatenate([[True], table[1:, 0] > reach[:-1]]))
        ends = reach[np.concatenate([new[1:] - 1, [len(table) - 1]])]
        out.append([{"start": int(s), "end": int(e)} for s, e in zip(table[new, 0], ends)])
    return pd.Series(out)


def _cut(text: pd.Series, spans: pd.Series) -> pd.Series:
    out = []
    for t, row in zip(text, spans):
        data = (t or "").encode()
        kept, at = [], 0
        for s in row if row is not None else ():
            kept.append(data[at : s["start"]])
            at = s["end"]
        out.append(b"".join([*kept, data[at:]]))
    return pd.Series(out)


def kept_bytes(text: Column, spans: Column) -> Column:
    """The bytes of a text outside the spans; a cut may fall within a character, so they are binary."""
    return F.pandas_udf(_cut, "binary")(text, spans)


def _named_texts(docs: DataFrame, text: str) -> list[Column]:
    whole = F.coalesce(own(text).cast("string"), F.lit(""))
    return [F.xxhash64(F.lit(1), whole).alias("t1"), F.xxhash64(F.lit(2), whole).alias("t2"), whole.alias("text")]


def repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, keep: list[str] | None = None) -> DataFrame:
    """Rows of ``docs`` with ``whole_text`` and ``removed`` (spans from byte start to end), ``n_bytes``, ``n_removed``, ``n_spans``.

    A byte is removed if a string of ``length`` bytes that covers it also starts anywhere else, in the same text or
    another, judged on the input. NULL text is empty; texts shorter than ``length`` stay whole; a repeated row is a
    place of its own, so both go if they are long enough. ``keep`` names the columns to carry. Input columns of the
    added names are replaced. An empty table gives an empty table. A text of one repeated byte has an anchor at each
    place: such stretches cost 60 bytes of rows a byte.
    """
    added = ["whole_text", "n_bytes", "removed", "n_removed", "n_spans"]
    names = carried(docs, added) if keep is None else [c for c in keep if c not in added]
    _, widths = shape(length)
    run = widths[0]
    texts = docs.select(*_named_texts(docs, text))
    rows = stored(texts.mapInPandas(_anchor_rows(length), ANCHOR_SCHEMA))
    done, left = _judged(rows, len(widths) == 1)
    spans = [_spans(done, run, length)]
    if left is not None:
        # Copies of a text count once from here on; that they are copies is known.
        place = F.struct("a", "near", "far")
        opened = stored(left.groupBy("t1", "t2").agg(F.collect_set(place).alias("places")))
        contexts = texts.join(opened, ["t1", "t2"]).mapInPandas(_context_rows(length, run), CONTEXT_SCHEMA)
        contexts = stored(contexts.dropDuplicates(["t1", "t2", "a"]))
        asked = contexts.withColumn("starts", F.array(F.lit(0)))
    for before, width in zip(widths, widths[1:]):
        rows = stored(asked.mapInPandas(_range_rows(length, run, before, width), ANCHOR_SCHEMA))
        done, left = _judged(rows, width == 1)
        spans.append(_spans(done, width, length))
        if left is not None:
            starts = left.groupBy("t1", "t2", "a").agg(F.collect_list("o").alias("starts"))
            asked = contexts.join(starts, ["t1", "t2", "a"])
    every = spans[0]
    for more in spans[1:]:
        every = every.union(more)
    copies = texts.select("t1", "t2", F.octet_length("text").cast("long").alias("end"))
    copies = copies.groupBy("t1", "t2").agg(F.count("*").alias("n"), F.max("end").alias("end"))
    copies = copies.where((F.col("n") > 1) & (F.col("end") >= length))
    covered = every.union(copies.select("t1", "t2", F.lit(0).cast("long").alias("start"), "end"))
    covered = covered.groupBy("t1", "t2").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    covered = stored(covered.select("t1", "t2", F.pandas_udf(_merge, SPANS)("spans").alias("removed")))
    whole = docs.select(packed(docs, names).alias("row"), *_named_texts(docs, text))
    out = whole.join(covered, ["t1", "t2"], "left")
    removed = F.coalesce("removed", F.array().cast(SPANS))
    out = out.select("row", "text", removed.alias("removed"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select(
        *unpacked(names),
        F.col("text").alias("whole_text"),
        F.octet_length("text").cast("long").alias("n_bytes"),
        "removed",
        gone.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
    )
