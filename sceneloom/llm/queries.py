"""The registered queries: each applies one operator to whole tables and derives the columns asked for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontamination, filter_audit, minhash, mixing, personal_data, quality, sharding, substring_dedup, token_counts, token_files, toxicity, vector_codes, warc
from .common import LOWER, UPPER, table, work_dir

SHARDS = 40
TOKEN_LIMIT = 4096
END_ID = 2


def op1_shuffle_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark, "shards")
    sharding.write_shards(sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), SHARDS), folder)
    docs = spark.read.schema("doc_id long, text string, slot long, shard int").parquet(folder)
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return docs.select("doc_id", sharding.row_size(F.col("text")).alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_words(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op4_find_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_windows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = decontamination.n_hit()
    listed = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), listed.alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeated(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = work_dir(spark, "token-ids")
    written = token_files.write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return token_files.read(spark, folder, written).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=2)


def op8_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op9_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = warc.write(table(spark, sf_dir, "pages"), work_dir(spark, "warc"))
    return warc.read(spark, written).drop("payload")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("filter")


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.find_spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    number = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(number, personal_data.KINDS), F.sha2(personal_data.written(base), 256).alias("base_sha256"), personal_data.written(F.col("spans")).alias("spans"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    told = vector_codes.with_label_errors(found)
    return told.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(books.sha256() if books else None).cast("string").alias("codebooks_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


_LOWER = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
_PASSAGE_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows of documents and of items meet as texts.
FIND_BENCHMARK_SQL = f"""WITH own AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_PASSAGE_WORDS}') AS words FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '{_PASSAGE_WORDS}') AS words FROM benchmark),
patterns AS (SELECT DISTINCT item, n, array_to_string(words[i : i + n - 1], ' ') AS window_text FROM (SELECT item, words, least(10, len(words)) AS n, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM items WHERE len(words) > 0)),
windows AS (SELECT doc_id, n, i, array_to_string(words[i : i + n - 1], ' ') AS window_text FROM (SELECT doc_id, n, words, unnest(range(1, len(words) - n + 2)) AS i FROM own, (SELECT DISTINCT n FROM patterns))),
found AS (SELECT doc_id, i, w.n, item FROM windows w JOIN patterns p ON w.n = p.n AND w.window_text = p.window_text),
hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, item FROM found WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM own LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)"""

_WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
REPEATED_PASSAGES_SQL = f"""WITH own AS (SELECT doc_id, {_WORDS_SQL} AS words FROM documents),
windows AS (SELECT doc_id, i, array_to_string(words[i : i + 49], ' ') AS window_text FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM own)),
smallest AS (SELECT window_text, min(doc_id) AS least FROM windows GROUP BY window_text),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS place FROM windows JOIN smallest USING (window_text) WHERE least < doc_id),
listed AS (SELECT doc_id, list(place) AS places FROM gone GROUP BY doc_id),
kept AS (SELECT doc_id, words, CASE WHEN places IS NULL THEN words ELSE list_filter(words, lambda w, i: NOT list_contains(places, i)) END AS stay FROM own LEFT JOIN listed USING (doc_id))
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - len(stay) AS BIGINT) AS n_removed, sha256(array_to_string(stay, ' ')) AS kept_sha256 FROM kept"""

NEAR_DUPLICATES_SQL = rf"""WITH RECURSIVE own AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS words FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(words[i : i + 1], ' ') AS shingle FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 1) + 1)) AS i FROM own WHERE len(words) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
linked AS (SELECT a, b FROM shared s JOIN sizes x ON s.a = x.doc_id JOIN sizes y ON s.b = y.doc_id WHERE 100 * s.n >= 80 * (x.n + y.n - s.n)),
links AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM own UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
component AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM component LEFT JOIN sizes USING (doc_id)"""


_DISTINCT = "len(list_distinct(words))"
#: Each order's steps by the first filter that a pattern of failures meets in it.
FILTER_AUDIT_SQL = f"""WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
flagged AS (SELECT d.doc_id, part, len(words) < 200 AS a, 100 * {_DISTINCT} < 50 * len(words) AS b, 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
  coalesce(min(doc_id) OVER (PARTITION BY text) < doc_id, false) AS e, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic
  FROM (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM texts) d LEFT JOIN labels USING (doc_id)),
patterns AS (SELECT part, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS fails,
  count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM flagged GROUP BY ALL),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM letter p, letter q, letter r, letter s, letter t WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
steps AS (SELECT filter_order, step, filter_order[step] AS filter FROM orders, range(1, 6) AS t(step)),
met AS (SELECT part, filter_order, fails, n, good, toxic, coalesce(list_min(list_filter([strpos(filter_order, x) FOR x IN string_split(fails, '')], lambda k: k > 0)), 6) AS gone_at FROM patterns, orders),
told AS (SELECT m.part, s.filter_order, s.step, s.filter, sum(n) FILTER (WHERE fails = '' OR gone_at > step) AS kept, sum(n) FILTER (WHERE fails <> '' AND gone_at = step) AS removed,
  sum(n) FILTER (WHERE contains(fails, s.filter) AND gone_at < step) AS redundant, sum(n) FILTER (WHERE fails = s.filter) AS unique_fails, sum(good) FILTER (WHERE fails <> '' AND gone_at = step) AS good_lost,
  sum(toxic) FILTER (WHERE fails <> '' AND gone_at = step) AS toxic_lost FROM met m JOIN steps s USING (filter_order) GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM told"""


def _code_rounds(rounds: int) -> str:
    """Lloyd's algorithm in plain joins: each part with each entry of its codebook."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"near_{k} AS (SELECT vec_id, p, arg_min(entry, (far, entry)) AS entry, min(far) AS far FROM (SELECT vec_id, p, entry, list_sum([(x[1] - x[2]) * (x[1] - x[2]) FOR x IN list_zip(v, c)]) AS far FROM parts JOIN book_{k} USING (p)) GROUP BY ALL)")
        if k < rounds:
            means = f"SELECT p, entry, list(CAST(floor(total / n) AS BIGINT) ORDER BY i) AS c FROM (SELECT p, entry, i, sum(v[i]) AS total, count(*) AS n FROM (SELECT p, entry, v, unnest(range(1, len(v) + 1)) AS i FROM near_{k} JOIN parts USING (vec_id, p)) GROUP BY ALL) GROUP BY ALL"
            steps.append(f"book_{k + 1} AS (SELECT b.p, b.entry, coalesce(m.c, b.c) AS c FROM book_{k} b LEFT JOIN ({means}) m USING (p, entry))")
    return ",\n".join(steps)


VECTOR_CODES_SQL = f"""WITH kept AS (SELECT vec_id, label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS whole FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, p, whole[p * (len(whole) // 16) + 1 : (p + 1) * (len(whole) // 16)] AS v FROM kept, range(16) AS t(p)),
smallest AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 64),
book_0 AS (SELECT p, entry, v AS c FROM smallest JOIN parts USING (vec_id)),
{_code_rounds(2)},
coded AS (SELECT vec_id, string_agg(lower(printf('%02x', entry)), '' ORDER BY p) AS code, CAST(sum(far) AS BIGINT) AS error FROM near_2 GROUP BY vec_id),
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, entry)) AS codebooks_sha256 FROM book_2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), books"""


def oracle_sql() -> dict[str, str]:
    """SQL for what joins can express; hashes, models, tokenizers and files are tested in other ways."""
    return {"op11_filter_audit": FILTER_AUDIT_SQL, "op13_vector_codes": VECTOR_CODES_SQL, "op4_find_benchmark": FIND_BENCHMARK_SQL, "op5_repeated_passages": REPEATED_PASSAGES_SQL, "op7_near_duplicates": NEAR_DUPLICATES_SQL}
