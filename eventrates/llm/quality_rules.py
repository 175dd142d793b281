"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit per failed rule; policies are
versioned sets of rules, applied as bit masks, and the effect of leaving a rule out follows from counts of bit patterns
without reading a text again. All expressions are built-in functions; nothing leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import carried, own, packed, unpacked

SPACE = r"\x20\x09-\x0D"
WINDOW = 5


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once."""
    return F.transform(F.array(value), then)[0]


def repeat_words(words: Column) -> Column:
    """Words inside windows of five words that occur twice or more in the text.

    Windows are compared by 64-bit hashes. Texts without a repeated hash end there; in others, sorting brings equal
    windows together, and one pass over their places counts the words they cover.
    """

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def marked(p: Column) -> Column:
            def twin(x: Column, j: Column) -> Column:
                same = F.coalesce(F.get(p, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(
                    F.get(p, j + 1)["h"] == x["h"], F.lit(False)
                )
                return F.when(same, x["i"])

            return F.sort_array(F.array_compact(F.transform(p, twin)))

        def add(s: Column, at: Column) -> Column:
            fresh = F.lit(WINDOW) - F.greatest(F.lit(0), s["end"] - at)
            return F.struct((s["n"] + fresh).alias("n"), (at + WINDOW).alias("end"))

        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(let(pairs, marked), start, add, lambda s: s["n"])

    def of(w: Column) -> Column:
        count = F.size(w)

        def window(i: Column) -> Column:
            return F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])

        hashes = F.transform(F.sequence(F.lit(0), F.greatest(count - WINDOW, F.lit(0))), window)
        twice = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))
        return F.when(count > WINDOW, twice).otherwise(0)

    return let(words, of).cast("long")


def only(text: Column, characters: str) -> Column:
    """Number of characters of a class."""
    return F.length(F.regexp_replace(text, f"[^{characters}]+", "")).cast("long")


def measurements(text: Column) -> dict[str, Column]:
    """What the rules need of a text; all are 0 for NULL and empty texts."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(f"[^{SPACE}]+"), F.lit(0))
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(f"[^{SPACE}]")))

    def of_lines(x: Column) -> Column:
        return F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(x, lambda s: F.rlike(s, F.lit(r"(?:\.\.\.|…)\s*$")))).cast("long").alias("n_ellipsis_lines"),
            F.size(F.filter(x, lambda s: F.rlike(s, F.lit(r"^\s*[-*•‣·]\s")))).cast("long").alias("n_bullet_lines"),
        )

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words"))

    return {
        "of_words": let(words, of_words),
        "of_lines": let(lines, of_lines),
        "word_chars": F.length(F.regexp_replace(text, f"[{SPACE}]+", "")).cast("long"),
        "n_symbols": only(text, "#*$%&|<>"),
        "n_exclamations": only(text, "!"),
        "n_letters": only(text, r"\p{L}"),
        "n_capitals": only(text, r"\p{Lu}"),
        "n_braces": only(text, "{}"),
        "n_letter_words": F.regexp_count(
            text, F.lit(rf"[^{SPACE}\p{{L}}]*+\p{{L}}[^{SPACE}]*+")
        ).cast("long"),
        "has_filler": F.rlike(text, F.lit("(?i)lorem ipsum")).cast("long"),
    }


MEASURES = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ellipsis_lines",
    "n_bullet_lines", "n_exclamations", "n_letters", "n_capitals", "n_braces", "n_letter_words", "has_filler",
]


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``fails``, SQL over the measurements, holds. Its bit is its place in ``RULES``."""

    name: str
    fails: str


# New rules go to the end, so that bits of stored ledgers keep their meaning.
RULES = (
    Rule("few_words", "n_words < 10"),
    Rule("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule("many_words", "n_words > 1000000"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 16 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("duplicate_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule("ellipsis_lines", "10 * n_ellipsis_lines > 3 * n_lines"),
    Rule("bullet_lines", "10 * n_bullet_lines > 9 * n_lines"),
    Rule("letterless_words", "10 * n_letter_words < 8 * n_words"),
    Rule("capitals", "10 * n_capitals > 6 * n_letters"),
    Rule("exclamations", "10 * n_exclamations > 3 * n_words"),
    Rule("braces", "20 * n_braces > n_words"),
    Rule("filler_text", "has_filler > 0"),
)
BITS = {r.name: 1 << i for i, r in enumerate(RULES)}
BASE = ("few_words", "repeated_windows")
# Policies by name and version.
POLICIES = {
    ("base", 1): BASE,
    ("web", 1): (*BASE, "symbols", "letterless_words", "capitals"),
    ("web", 2): tuple(r.name for r in RULES),
}


def mask(policy: tuple[str, int]) -> int:
    """The bits of a policy's rules."""
    return sum(BITS[name] for name in POLICIES[policy])


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """All rows of ``docs`` with the measurements and ``failures``, a long with one bit per failed rule.

    NULL and empty texts measure 0 and fail ``few_words``. Whole texts are read. Repeated rows stay. Input columns of
    the added names are replaced. An empty table gives an empty ledger.
    """
    columns = carried(docs, [*MEASURES, "failures"])
    measured = docs.select(
        packed(docs, columns).alias("row"), *[c.alias(n) for n, c in measurements(own(text)).items()]
    ).select("*", "of_words.*", "of_lines.*")
    bits = [F.when(F.expr(r.fails), F.lit(BITS[r.name])).otherwise(0).cast("long") for r in RULES]
    failures = bits[0]
    for b in bits[1:]:
        failures = failures.bitwiseOR(b)
    return measured.select("row", *MEASURES, failures.alias("failures")).select(
        *unpacked(columns), *MEASURES, "failures"
    )


def apply_policy(table: DataFrame, policy: tuple[str, int]) -> DataFrame:
    """Add ``kept``: whether no rule of the policy failed. Any ledger, stored ones too, will do."""
    return table.withColumn("kept", F.col("failures").bitwiseAND(F.lit(mask(policy))) == 0)


def ablation(table: DataFrame, policy: tuple[str, int]) -> DataFrame:
    """Per rule of a policy: rows that fail it, rows that fail it alone, and rows kept without it.

    The ledger is reduced to counts of bit patterns, by each task first; the rest works on those counts.
    """
    everything = mask(policy)
    counts = table.groupBy(F.col("failures").bitwiseAND(F.lit(everything)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(BITS[n]).cast("long").alias("bit")) for n in POLICIES[policy]])
    wide = counts.select("bits", "n", F.explode(rules).alias("r"))
    bit = F.col("r.bit")
    without = F.col("bits").bitwiseAND(F.bitwise_not(bit))
    return wide.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("bits").bitwiseAND(bit) != 0, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("bits") == bit, F.col("n")).otherwise(0)).alias("failed_alone"),
        F.sum(F.when(without == 0, F.col("n")).otherwise(0)).alias("kept_without"),
    )
