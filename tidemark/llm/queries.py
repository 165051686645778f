"""Registered queries of the training-data operators: thin digests of what each operator returns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, divergence, forest, langid, licenses, merkle, pieces, quality, sharding, simhash, substrings, tokencounts, unitdedup
from tidemark.llm.common import held_out, table

SHARDS = 24


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.learn(langid.training_rows(docs))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "language.*")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held_out(F.col("doc_id")))
    scored = quality.score(docs, quality.learn(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))
    left = unitdedup.remove_repeated_units(docs)
    return left.select(
        "doc_id", "n_chars", (F.col("n_chars") - F.coalesce(F.length("text"), F.lit(0))).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), unitdedup.spans_text(F.col("removed")).alias("spans"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def op5_piece_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = pieces.read_pieces(pieces.MODEL_PATH)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = pieces.with_checked_pieces(docs, vocabulary).select("doc_id", "coded.*")
    return coded.select("doc_id", pieces.n_pieces(F.col("ids")).alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), F.col("same").alias("round_trip"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = [1.0] * SHARDS
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"),
        sharding.shard_of([F.col("doc_id")], weights).alias("shard"),
        sharding.grown_shard_of([F.col("doc_id")], weights).alias("grown_shard"),
    )
    return sharding.with_slots(rows, "shard", ["doc_id"])


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_embedding_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_substring_bwt(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.remove_repeated_strings(table(spark, sf_dir, "documents"), hash_only=True)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", substrings.kept_hash(F.col("kept")).alias("kept_sha256"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = tokencounts.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = tokencounts.with_token_counts(docs, vocabulary)
    return counted.select("doc_id", tokencounts.n_bytes(F.col("text")).alias("n_bytes"), "n_tokens", (F.col("n_tokens") > tokencounts.LIMIT).alias("over_limit"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents").select("text", "lang", "source"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*merkle.COLUMNS)
    return merkle.check_documents(docs).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_license_scan": op2_license_scan,
    "op3_quality_crf": op3_quality_crf,
    "op4_unit_dedup": op4_unit_dedup,
    "op5_piece_coding": op5_piece_coding,
    "op6_simhash": op6_simhash,
    "op7_rendezvous_shards": op7_rendezvous_shards,
    "op8_decontaminate": op8_decontaminate,
    "op9_embedding_forest": op9_embedding_forest,
    "op10_substring_bwt": op10_substring_bwt,
    "op11_token_counts": op11_token_counts,
    "op12_source_divergence": op12_source_divergence,
    "op13_merkle_manifest": op13_merkle_manifest,
}
# Units again from the rule: lines, sentences of lines with several, their words, the first occurrence of each form, merged spans.
_WORDS = "regexp_extract_all(lower({}), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+')"
_SPACE = "length(regexp_extract({0}, '^\\s*'))"
_UNITS = f"""
given AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
split AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM given),
placed AS (SELECT doc_id, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos,
  {_WORDS.format("line")} AS words, regexp_extract_all(line, '[^.!?]*[.!?]+|[^.!?]+') AS parts FROM split),
long_lines AS (SELECT * FROM placed WHERE len(words) >= {unitdedup.LINE_WORDS}),
sentences AS (SELECT doc_id, pos AS line_pos, len(words) AS line_words, unnest(parts) AS part, unnest(range(1, len(parts) + 1)) AS part_no FROM long_lines WHERE len(parts) > 1),
parted AS (SELECT doc_id, part, line_words, {_WORDS.format("part")} AS words,
  line_pos + coalesce(sum(length(part)) OVER (PARTITION BY doc_id, line_pos ORDER BY part_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM sentences),
both_kinds AS (
  SELECT doc_id, line AS part, pos, words FROM long_lines
  UNION ALL SELECT doc_id, part, pos, words FROM parted WHERE len(words) >= {unitdedup.SENTENCE_WORDS} AND len(words) < line_words),
units AS (SELECT doc_id, CAST(pos + {_SPACE.format("part")} AS BIGINT) AS first_char, CAST(pos + length(regexp_replace(part, '\\s+$', '')) AS BIGINT) AS end_char, array_to_string(words, ' ') AS form FROM both_kinds),
firsts AS (SELECT form, min(doc_id) AS first_doc FROM units GROUP BY 1),
starts AS (SELECT u.form, first_doc, min(first_char) AS first_at FROM units u JOIN firsts f ON u.form = f.form AND u.doc_id = f.first_doc GROUP BY 1, 2),
later AS (SELECT DISTINCT doc_id, first_char, end_char FROM units JOIN starts USING (form) WHERE doc_id <> first_doc OR first_char <> first_at),
reached AS (SELECT *, max(end_char) OVER (PARTITION BY doc_id ORDER BY first_char, end_char ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM later),
numbered AS (SELECT *, sum(CASE WHEN reach IS NULL OR first_char > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY first_char, end_char ROWS UNBOUNDED PRECEDING) AS span_no FROM reached),
spans AS (SELECT doc_id, span_no, min(first_char) AS s, max(end_char) AS e FROM numbered GROUP BY 1, 2),
gaps AS (
  SELECT doc_id, s AS ordinal, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS a, s AS b FROM spans
  UNION ALL SELECT doc_id, 9223372036854775807, coalesce(max(e), 0), 9223372036854775807 FROM (SELECT doc_id, NULL AS e FROM given UNION ALL SELECT doc_id, e FROM spans) GROUP BY 1),
kept AS (SELECT doc_id, string_agg(substr(text, CAST(a AS BIGINT) + 1, CAST(least(b, length(text)) - a AS BIGINT)), '' ORDER BY ordinal) AS left_over FROM gaps JOIN given USING (doc_id) GROUP BY 1)
"""

# Templates again from the rule. The benchmark's items all have eight words or more, so windows of eight are all there are.
_EDGE = "[ \\t.,;:!?\"''()\\[\\]{}<>«»“”‘’…*|_`]+"
_UNIT_WORDS = ", ".join(f"'{u}'" for u in sorted(decontam.UNITS))


def _templates(source: str, key: str, name: str) -> str:
    """Words, kinds and windows of a table's texts, as table expressions that start with ``name``."""
    return f"""
{name}_raw AS (SELECT {key} AS owner, unnest(raws) AS raw, unnest(range(1, len(raws) + 1)) AS raw_no FROM (SELECT {key}, regexp_extract_all(coalesce(text, ''), '\\S+') AS raws FROM {source})),
{name}_bare AS (SELECT *, regexp_replace(regexp_replace(raw, '^{_EDGE}', ''), '{_EDGE}$', '') AS bare, regexp_matches(raw, '[.!?:]$') AS ends FROM {name}_raw),
{name}_lower AS (SELECT *, lower(bare) AS word, coalesce(lag(ends) OVER (PARTITION BY owner ORDER BY raw_no), true) AS begins FROM {name}_bare WHERE bare <> '' OR ends),
{name}_first AS (SELECT *, CASE
    WHEN regexp_matches(word, '^[+-]?[$€£]?[0-9][0-9.,]*%?$') OR (regexp_matches(word, '^[+-]?[0-9][0-9.,]*[a-z]+$') AND regexp_extract(word, '[a-z]+$') IN ({_UNIT_WORDS})) THEN 1
    WHEN NOT begins AND length(bare) > 1 AND regexp_matches(bare, '^\\p{{Lu}}[^\\p{{Lu}}]*$') AND regexp_matches(substr(bare, 2), '\\p{{Ll}}') THEN 2 ELSE 0 END AS kind0 FROM {name}_lower),
{name}_kind AS (SELECT *, CASE WHEN kind0 = 0 AND word IN ({_UNIT_WORDS}) AND lag(kind0) OVER (PARTITION BY owner ORDER BY raw_no) = 1 THEN 3 ELSE kind0 END AS kind FROM {name}_first),
{name}_lists AS (SELECT owner, list(word ORDER BY raw_no) AS words, list(kind ORDER BY raw_no) AS kinds,
  list(CASE kind WHEN 0 THEN word ELSE '<' || kind || '>' END ORDER BY raw_no) AS marks FROM {name}_kind WHERE bare <> '' GROUP BY 1),
{name}_spots AS (SELECT *, unnest(range(1, len(words) - {decontam.WINDOW - 2})) AS spot FROM {name}_lists WHERE len(words) >= {decontam.WINDOW}),
{name}_windows AS (SELECT owner, len(words) AS n, spot, array_to_string(marks[spot:spot + {decontam.WINDOW - 1}], ' ') AS template,
  words[spot:spot + {decontam.WINDOW - 1}] AS words, kinds[spot:spot + {decontam.WINDOW - 1}] AS kinds FROM {name}_spots
  WHERE len(list_filter(kinds[spot:spot + {decontam.WINDOW - 1}], lambda k: k = 0)) >= {decontam.LEAST_WORDS})"""


_LEAKS = f"""
SELECT DISTINCT doc_id, item_id, coverage, first_word, kind FROM (
  SELECT doc_id, item_id, count(DISTINCT place) * 1.0 / max(n) AS coverage, min(first_word) AS first_word, max(kind) AS kind FROM (
    SELECT doc_id, item_id, n, unnest(places) AS place, first_word, kind FROM (
      SELECT w.doc_id, w.item_id, w.shift, max(w.n) AS n, flatten(list(range(w.item_spot, w.item_spot + {decontam.WINDOW}))) AS places, min(w.doc_spot) - 1 AS first_word,
             CASE WHEN coalesce(max(v.other), 0) = 0 THEN 'verbatim' WHEN max(v.pairs) = max(v.sources) THEN 'reworded' END AS kind
      FROM met w LEFT JOIN values_of v ON v.doc_id = w.doc_id AND v.item_id = w.item_id AND v.shift = w.shift GROUP BY 1, 2, 3) WHERE kind IS NOT NULL) GROUP BY 1, 2)
WHERE coverage >= {decontam.COVERAGE}
"""

# The tree again level by level: enough levels for 8^6 leaves a language and 8^2 languages. DuckDB has no CRC-32, so it is worked out by its table.
_CRC = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), "
    "lambda c, b: xor(c >> 8, crc_of[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"
)
_TREE = f"""
crc_table AS (SELECT list(list_reduce(list_prepend(CAST(n AS BIGINT), CAST(range(8) AS BIGINT[])), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) ORDER BY n) AS crc_of FROM range(256) t(n)),
changed AS (SELECT *, CASE WHEN {_CRC} % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS claimed_text FROM documents CROSS JOIN crc_table),
leaves AS (SELECT doc_id, lang, {{leaf}} AS leaf, {{claimed}} AS f0 FROM changed),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS number, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS grp FROM leaves),
"""


def _levels(name: str, first: str, depth: int) -> str:
    """Nodes and runs of each level over ``first``, a query of (grp, number, h)."""
    out = [f"{name}0 AS ({first})"]
    for k in range(depth):
        out.append(
            f"{name}_runs{k} AS (SELECT grp, number // 8 AS parent, list(h ORDER BY number) AS run, any_value(n) AS n FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS n FROM {name}{k}) GROUP BY ALL)"
        )
        out.append(f"{name}{k + 1} AS (SELECT grp, parent AS number, CASE WHEN n = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS h FROM {name}_runs{k})")
    return ",\n".join(out)


def _folded(name: str, source: str, depth: int, group: str, number: str) -> str:
    """Each row of ``source`` with the siblings on its path through the levels of ``name`` and the digest they lead to."""
    out, now = [], source
    for k in range(depth):
        place = f"({number} // {8**k}) % 8"
        out.append(
            f"{source}_{name}{k} AS (SELECT s.* EXCLUDE (n, l, r, proof, f0), CASE WHEN n = 1 THEN f0 ELSE sha256(l || f0 || r) END AS f0, proof || l || r AS proof FROM (SELECT s.*, {name}_runs{k}.n, "
            f"array_to_string(run[1:{place}], '') AS l, array_to_string(run[{place} + 2:], '') AS r FROM {now} s JOIN {name}_runs{k} ON {group} = {name}_runs{k}.grp AND {number} // {8 ** (k + 1)} = parent) s)"
        )
        now = f"{source}_{name}{k}"
    return ",\n".join(out)


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


_SHARE = "1 + {unit}::HUGEINT * (n + 2) // (sum(n) OVER ({over}) + 2 * kept)"
_DIVERGENCE = f"""
docs AS (SELECT row_number() OVER () AS row_no, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words FROM documents),
said AS (SELECT row_no, lang, source, unnest(words) AS term FROM docs),
kept_terms AS (SELECT lang, term, count(*) AS lang_n FROM said GROUP BY 1, 2 HAVING count(DISTINCT row_no) >= {divergence.LEAST_DOCS}),
sized AS (SELECT *, count(*) OVER (PARTITION BY lang) AS kept FROM kept_terms),
lang_shares AS (SELECT lang, term, {_SHARE.format(unit=divergence.UNIT, over="PARTITION BY lang")} AS q FROM (SELECT lang, term, kept, lang_n AS n FROM sized)),
groups AS (SELECT DISTINCT lang, source FROM docs),
said_in AS (SELECT lang, source, term, count(*) AS n FROM said GROUP BY ALL),
counts AS (SELECT g.lang, g.source, k.term, k.kept, coalesce(s.n, 0) AS n FROM groups g JOIN sized k USING (lang) LEFT JOIN said_in s ON s.lang = g.lang AND s.source = g.source AND s.term = k.term),
shares AS (SELECT lang, source, term, n, {_SHARE.format(unit=divergence.UNIT, over="PARTITION BY lang, source")} AS p FROM counts),
pairs AS (SELECT g.lang, g.source, h.source AS item, coalesce(CAST(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS BIGINT), 0) AS value
  FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN shares a ON a.lang = g.lang AND a.source = g.source
  LEFT JOIN shares b ON b.lang = h.lang AND b.source = h.source AND b.term = a.term GROUP BY ALL),
telling AS (SELECT s.lang, s.source, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM shares s JOIN lang_shares USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, 'pair' AS part FROM pairs UNION ALL SELECT *, 'term' AS part FROM telling)
"""

CHECKS: dict[str, str] = {
    "op12_source_divergence": f"""
WITH {_DIVERGENCE.strip()}
SELECT lang, source, part, item, value, rank FROM (
  SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM ranked)
WHERE part = 'pair' OR rank <= {divergence.TOP_TERMS}
""",
    "op13_merkle_manifest": f"""
WITH {_TREE.strip().format(leaf=_leaf_sql("text"), claimed=_leaf_sql("claimed_text"))}
{_levels("node", "SELECT grp, number, leaf AS h FROM placed", 6)},
{_levels("top", "SELECT 0 AS grp, grp AS number, h FROM node6", 2)},
begun AS (SELECT *, '' AS proof FROM placed),
{_folded("node", "begun", 6, "s.grp", "s.number")},
inner_paths AS (SELECT * FROM begun_node5),
{_folded("top", "inner_paths", 2, "0", "s.grp")}
SELECT doc_id, leaf, node6.h AS subroot, top2.h AS root, sha256(proof) AS proof_sha256, f0 AS folded_root, f0 = top2.h AS verified
FROM inner_paths_top1 p JOIN node6 ON node6.grp = p.grp CROSS JOIN top2
""",
    "op8_decontaminate": f"""
WITH {_templates("documents", "doc_id", "d").strip()},{_templates("benchmark", "item_id", "b")},
met AS (SELECT DISTINCT d.owner AS doc_id, b.owner AS item_id, b.n, d.spot AS doc_spot, b.spot AS item_spot, d.spot - b.spot AS shift, d.words AS doc_words, b.words AS item_words, d.kinds AS kinds
  FROM d_windows d JOIN b_windows b USING (template)),
slots AS (SELECT doc_id, item_id, shift, unnest(kinds) AS kind, unnest(item_words) AS item_word, unnest(doc_words) AS doc_word FROM met),
values_of AS (SELECT doc_id, item_id, shift, count(DISTINCT kind || ' ' || item_word || ' ' || doc_word) AS pairs, count(DISTINCT kind || ' ' || item_word) AS sources,
  count(*) FILTER (item_word <> doc_word) AS other FROM slots WHERE kind > 0 GROUP BY 1, 2, 3)
{_LEAKS.strip()}
""",
    "op4_unit_dedup": f"""
WITH {_UNITS.strip()}
SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans, coalesce(listed, '') AS spans, sha256(left_over) AS kept_sha256
FROM given JOIN kept USING (doc_id)
LEFT JOIN (SELECT doc_id, sum(e - s) AS gone, count(*) AS n, string_agg(s || '-' || e, ';' ORDER BY s) AS listed FROM spans GROUP BY 1) USING (doc_id)
""",
}
