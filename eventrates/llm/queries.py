"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_trie, decontamination, html_text, language, license_scan, mixing, near_copies, quality_classifier, quality_rules, ranked_search, repeated_bytes, sharding, token_counts
from .splits import held_out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix with source weights 5, 2, 1 takes of each document."""
    out = mixing.mix(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "size", "source_size", "target", "repeats", "taken")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and detections of each document."""
    out = license_scan.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    starts = F.transform("places", lambda d: d["start"])
    return out.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document before and after scrubbing mail addresses and long numbers from it."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = token_counts.with_trees(docs)
    trees = trees.select("*", F.col("n_tokens").alias("n_before"), token_counts.scrubbing_edits(F.col("text")).alias("edits"))
    trees = trees.withColumn("n_edits", F.size("edits").cast("long"))
    out = token_counts.apply_edits(trees)
    return out.select("doc_id", "n_before", "n_edits", F.col("n_tokens").alias("n_after"), "n_again")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document, learned from those that are not held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.train(docs.where(~held_out(F.col("doc_id"))))
    told = language.identify(docs.select("doc_id", "text"), model)
    return told.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of each page."""
    out = html_text.extract(_table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return out.select("page_id", "url", "text", "n_chars")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements, failed rules and verdict of each document."""
    table = quality_rules.ledger(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    judged = quality_rules.apply_policy(table, ("web", 2))
    base = F.col("failures").bitwiseAND(F.lit(quality_rules.mask(("base", 1)))) != 0
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), "kept", "failures",
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of each document among 16 shards of equal row counts."""
    text = F.coalesce("text", F.lit(""))
    docs = _table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
    )
    placed = sharding.shard_rows(docs, "doc_id", shards=16)
    return placed.select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item and the place."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.leaks(docs, _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "cosine", "common_share", "answer_share", "first_word", "words")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of each document, learned from labels that are not held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").select("doc_id", "quality")
    told = quality_classifier.classify(docs, classifier_of(docs, labels))
    return told.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def classifier_of(docs: DataFrame, labels: DataFrame) -> quality_classifier.Model | None:
    """The quality model of the rows and labels that are not held out."""
    open_docs = docs.where(~held_out(F.col("doc_id")))
    positives = labels.where((F.col("quality") == 1) & ~held_out(F.col("doc_id"))).select("doc_id")
    return quality_classifier.train(open_docs, positives, labels.select("doc_id"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of near copies of each document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = near_copies.near_copies(docs, keep=["doc_id"])
    return out.select("doc_id", near_copies.hexadecimal(F.col("fingerprint")).alias("fingerprint"), "component_id")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all conversations, each with its borrowed head."""
    turns = conversation_trie.ordered_turns(_table(spark, sf_dir, "conversations"))
    return conversation_trie.trie(*conversation_trie.borrowed(turns))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents of highest score for each benchmark item."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return ranked_search.search(docs, _table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each document that stand in a string of 400 bytes found elsewhere, and what is left without them."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = repeated_bytes.repeats(docs, keep=["doc_id"])
    kept = repeated_bytes.kept_bytes(F.col("whole_text"), F.col("removed"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(kept, 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_licenses, op3_token_counts, op4_language, op5_html_text, op6_quality_rules, op7_sharding, op8_decontamination, op9_quality_classifier, op10_simhash, op11_prefix_trie, op12_ranked_search, op13_suffix_dedup)}

ORACLES: dict[str, str] = {
    "op6_quality_rules": r"""
WITH rows_ AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
cut AS (
  SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM rows_),
words AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM cut),
wins AS (
  SELECT rid, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' '
    || lead(w, 4) OVER o AS five FROM words WINDOW o AS (PARTITION BY rid ORDER BY i)),
twice AS (SELECT rid, i FROM wins WHERE five IS NOT NULL QUALIFY count(*) OVER (PARTITION BY rid, five) > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, range(5) AS r(k) GROUP BY rid),
measured AS (
  SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words, len(ls) AS n_lines,
    len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) AS n_ellipsis,
    len(list_filter(ls, lambda x: regexp_matches(x, '^\s*[-*•‣·]\s'))) AS n_bullets,
    length(regexp_replace(t, '[^!]+', '', 'g')) AS n_exclamations,
    length(regexp_replace(t, '[^\p{L}]+', '', 'g')) AS n_letters,
    length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) AS n_capitals,
    length(regexp_replace(t, '[^{}]+', '', 'g')) AS n_braces,
    len(regexp_extract_all(t, '[^\x20\x09-\x0D\p{L}]*\p{L}[^\x20\x09-\x0D]*')) AS n_letter_words,
    regexp_matches(t, '(?i)lorem ipsum') AS filler
  FROM cut LEFT JOIN covered USING (rid)),
bits AS (
  SELECT *, (n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT
    + 4 * (n_words > 1000000)::BIGINT + 8 * (word_chars < 2 * n_words)::BIGINT + 16 * (word_chars > 16 * n_words)::BIGINT
    + 32 * (10 * n_symbols > n_words)::BIGINT + 64 * (10 * n_dup_lines > 3 * n_lines)::BIGINT
    + 128 * (10 * n_ellipsis > 3 * n_lines)::BIGINT + 256 * (10 * n_bullets > 9 * n_lines)::BIGINT
    + 512 * (10 * n_letter_words < 8 * n_words)::BIGINT + 1024 * (10 * n_capitals > 6 * n_letters)::BIGINT
    + 2048 * (10 * n_exclamations > 3 * n_words)::BIGINT + 4096 * (20 * n_braces > n_words)::BIGINT
    + 8192 * filler::BIGINT AS failures FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures & 3 <> 0 AS base_failed,
  failures = 0 AS kept, failures FROM bits""",
    "op12_ranked_search": r"""
WITH cut AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
asked AS (
  SELECT row_number() OVER () AS iid, item_id,
    list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS ts FROM benchmark),
item_terms AS (SELECT iid, unnest(ts) AS term FROM asked),
sums AS (SELECT count(*) FILTER (len(ts) > 0) AS docs, sum(len(ts))::BIGINT AS total FROM cut),
damped AS (SELECT rid, doc_id, 10 + (90 * len(ts) * docs) // total AS m FROM cut, sums WHERE len(ts) > 0),
words AS (SELECT rid, unnest(ts) AS term FROM cut),
tfs AS (SELECT rid, term, count(*) AS tf FROM words SEMI JOIN item_terms USING (term) GROUP BY rid, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM tfs, sums GROUP BY term, docs),
scored AS (
  SELECT iid, rid, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM item_terms JOIN weights USING (term) JOIN tfs USING (term) JOIN damped USING (rid) GROUP BY iid, rid, doc_id),
ranked AS (
  SELECT iid, doc_id, score, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked JOIN asked USING (iid) WHERE rank <= 10""",
}
