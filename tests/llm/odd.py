"""Small tables with the cases that every operator must stand: NULLs, empty and long texts, ties, repeats, name clashes."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, size long, shard string, at int"


def rows() -> list[tuple]:
    prose = "The cat sat on the mat and the dog sat by the door while it rained all day long in the old town."
    texts = [
        (1, prose, "en", "a"),
        (2, prose, "en", "a"),
        (2, prose, "en", "a"),
        (3, None, "en", "b"),
        (4, "", None, "b"),
        (5, " \t\n ", "de", None),
        (None, "no id here but some words to read", "en", None),
        (None, "no id here but some words to read", "en", None),
        (None, None, None, None),
        (6, "word", "en", "c"),
        (7, "two words", "en", "c"),
        (8, "very long " * 30_000, "en", "ümlaut"),
        (9, "Üñï çödé ¡sîgnß! 漢字 かな", "fr", ""),
        (10, "!!! ### $$$ \u0000 \x0b \x0c", "en", "a"),
        (11, prose.upper(), "en", "d"),
    ]
    return [(*t, len(t[1] or ""), "clash", 1, "clash", 7) for t in texts]


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
