"""The registered query of each operator: production parameters, whole tables, digests where a contract asks for them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import bpe, decontaminate, html_blocks, jaccard_join, langid, line_dedup, neighbours, quality, sharding, substring_dedup, vector_codes, whitening, word_bpe
from tilewright.llm.jobs import table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_PIECES = public_tokenizers.path("word_bpe_49k.json")


def op1_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_blocks.extract(pages, html_blocks.train(pages), keep=["page_id", "url"]).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op2_quality_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), quality.grade(), quality.GRADES)
    tail = F.element_at("at_least", -1)
    return quality.score(docs, model, keep=["doc_id"]).select("doc_id", "expected_grade", tail.alias("tail_probability"), (tail >= quality.SELECT_FROM).alias("selected"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op6_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False)).alias("held_out"))
    model = langid.train(docs.filter("NOT held_out"))
    return langid.predict(docs, model, keep=["doc_id", "held_out"])


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = bpe.load(spark, RANKS)
    ids = bpe.encode(table(spark, sf_dir, "documents"), vocabulary, keep=["doc_id"])
    digests = ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"), "ids")
    back = bpe.decode(digests, vocabulary, keep=["doc_id", "n_tokens", "ids_sha256"])
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op9_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_components(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = whitening.whiten(table(spark, sf_dir, "embeddings"), keep=["vec_id"])
    return rows


def op12_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = word_bpe.load(spark, WORD_PIECES)
    ids = word_bpe.encode(table(spark, sf_dir, "documents"), vocabulary, keep=["doc_id"], digest=True)
    back = word_bpe.decode(ids, vocabulary, keep=["doc_id", "n_tokens", "ids_sha256"])
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return rows.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


#: The definition of op3 as it stands: all variants of all lines, without the shortcut through halves.
OP3_SQL = r"""
WITH split AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
lines AS (
  SELECT doc_id, p.pos AS pos, parts[p.pos] AS line, list_filter(regexp_split_to_array(parts[p.pos], '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM split, LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS pos) p),
classes AS (
  SELECT w, len(w) AS n, min({'d': doc_id, 'p': pos}) AS spot FROM lines WHERE len(w) > 0 GROUP BY w),
variants AS (
  SELECT spot, i.i AS i, array_to_string(CASE WHEN i.i = 0 THEN w ELSE list_concat(w[1:i.i - 1], w[i.i + 1:]) END, ' ') AS x
  FROM classes, LATERAL (SELECT unnest(range(0, n + 1)) AS i) i WHERE n >= 8),
firsts AS (SELECT x, min(spot) AS any_spot, min(spot) FILTER (i = 0) AS whole FROM variants GROUP BY x),
places AS (SELECT x, i, min(spot) AS same FROM variants GROUP BY x, i),
near AS (
  SELECT DISTINCT spot FROM variants JOIN firsts USING (x) JOIN places USING (x, i)
  WHERE same < spot OR (i = 0 AND any_spot < spot) OR (i > 0 AND whole < spot)),
judged AS (
  SELECT l.doc_id, l.pos, l.line, len(l.w) > 0 AND (c.spot <> {'d': l.doc_id, 'p': l.pos} OR near.spot IS NOT NULL) AS drop
  FROM lines l LEFT JOIN classes c ON l.w = c.w LEFT JOIN near ON near.spot = c.spot),
per_doc AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (drop) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT drop), '') AS kept
  FROM judged GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, CASE WHEN text IS NOT NULL THEN sha256(coalesce(kept, '')) END AS kept_sha256
FROM documents d LEFT JOIN per_doc USING (doc_id)
"""


OP4_SQL = r"""
WITH folded AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
sized AS (SELECT item_id, w, least(10, len(w)) AS k FROM folded WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[p.p : p.p + k - 1], ' ') AS g FROM sized, LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS p) p),
d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
grams AS (SELECT doc_id, k.k AS k, p.p AS p, array_to_string(w[p.p : p.p + k.k - 1], ' ') AS g FROM d, (SELECT DISTINCT k FROM win) k, LATERAL (SELECT unnest(range(1, len(w) - k.k + 2)) AS p) p),
hits AS (SELECT doc_id, p, k, item_id FROM grams JOIN win USING (k, g)),
covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS list FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP8_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, p.p AS p, md5(array_to_string(w[p.p : p.p + 19], ' ')) AS g FROM d, LATERAL (SELECT unnest(range(1, len(w) - 18)) AS p) p),
firsts AS (SELECT g, min({'d': doc_id, 'p': p}) AS f FROM win GROUP BY g),
gone AS (SELECT DISTINCT doc_id, q FROM (SELECT doc_id, unnest(range(p, p + 20)) AS q FROM win JOIN firsts USING (g) WHERE {'d': doc_id, 'p': p} <> f)),
words AS (SELECT doc_id, q.q AS q, w[q.q] AS word FROM d, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS q) q),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY q) AS kept FROM words ANTI JOIN gone USING (doc_id, q) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

#: Whole sets joined shingle by shingle, and what the links reach.
OP10_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (
  SELECT doc_id, array_to_string(w[p.p : p.p + 2], ' ') AS s FROM d, LATERAL (SELECT unnest(range(1, len(w) - 1)) AS p) p WHERE len(w) >= 3
  UNION SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 2),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)),
ways AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
reach AS (SELECT x, y FROM ways UNION SELECT r.x, b.y FROM reach r JOIN ways b ON r.y = b.x),
lowest AS (SELECT x AS doc_id, min(y) AS other FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(other, d.doc_id)) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN lowest USING (doc_id)
"""


def _op13_sql(parts: int = vector_codes.PARTS, entries: int = vector_codes.ENTRIES, rounds: int = vector_codes.ROUNDS) -> str:
    """The rounds one after the other, every part against every entry of its position."""
    ctes = [
        """good AS (
  SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)""",
        "usual AS (SELECT len(v) AS d FROM good GROUP BY ALL ORDER BY count(*) DESC, d LIMIT 1)",
        "kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS r, vec_id, label, v FROM good WHERE len(v) = (SELECT d FROM usual))",
        f"part AS MATERIALIZED (SELECT r, p.p AS p, v[p.p * len(v) // {parts} + 1 : (p.p + 1) * len(v) // {parts}] AS x FROM kept, (SELECT unnest(range({parts})) AS p) p)",
        f"book0 AS MATERIALIZED (SELECT p, r - 1 AS i, x AS e FROM part WHERE r <= {entries})",
    ]
    for k in range(rounds + 1):
        ctes.append(
            f"""near{k} AS MATERIALIZED (
  SELECT r, p, x, min({{'d': d, 'i': i}}) AS best FROM (
    SELECT r, part.p AS p, x, i, list_sum(list_transform(list_zip(x, e), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS d FROM part JOIN book{k} USING (p)) GROUP BY ALL)"""
        )
        if k < rounds:
            ctes.append(
                f"""mean{k} AS (
  SELECT p, i, list(CAST(floor(s / n) AS BIGINT) ORDER BY pos) AS e FROM (
    SELECT p, best.i AS i, pos, CAST(sum(c) AS DOUBLE) AS s, count(*) AS n FROM (SELECT p, best, unnest(x) AS c, generate_subscripts(x, 1) AS pos FROM near{k}) GROUP BY ALL) GROUP BY ALL)"""
            )
            ctes.append(f"book{k + 1} AS MATERIALIZED (SELECT p, i, coalesce(m.e, b.e) AS e FROM book{k} b LEFT JOIN mean{k} m USING (p, i))")
    ctes.append(
        f"coded AS MATERIALIZED (SELECT r, string_agg(format('{{:02x}}', best.i), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM near{rounds} GROUP BY r)"
    )
    ctes.append(f"said AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY p, i)) AS h FROM book{rounds})")
    return "WITH " + ",\n".join(ctes) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM coded JOIN kept USING (r), said"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_blocks": op1_html_blocks,
        "op2_quality_ordinal": op2_quality_ordinal,
        "op3_line_dedup": op3_line_dedup,
        "op4_winnowing": op4_winnowing,
        "op5_byte_bpe": op5_byte_bpe,
        "op6_nn_descent": op6_nn_descent,
        "op7_language_id": op7_language_id,
        "op8_substring_dedup": op8_substring_dedup,
        "op9_vector_packing": op9_vector_packing,
        "op10_jaccard_join": op10_jaccard_join,
        "op11_whitening": op11_whitening,
        "op12_word_bpe": op12_word_bpe,
        "op13_vector_codes": op13_vector_codes,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": OP3_SQL, "op4_winnowing": OP4_SQL, "op8_substring_dedup": OP8_SQL, "op10_jaccard_join": OP10_SQL, "op13_vector_codes": _op13_sql()}
