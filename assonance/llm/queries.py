"""The queries over the operators of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assonance.llm import alignment, decontaminate, exact_dedup, html_text, line_dedup, near_dup, neighbours, pieces, quality, runs, sharding, token_counts, warc
from assonance.llm.batches import small_batches
from assonance.plans.durable import durable
from assonance.plans.spread import spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(
        "doc_id",
        sharding.text_size(F.col("text")).alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
    )
    # Records in the order of their texts' checksums: equal texts stand together, and part only where a shard is full.
    placed = sharding.shard_by_bytes(docs, "text_crc32", F.col("size"), shards=8)
    return placed.select("row.*", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = line_dedup.drop_site_lines(docs, "source", "text", phrase_ratio=0.01, distinct=True)
    return out.select("row.doc_id", "text", "n_lines", "n_dropped")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), quality.score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_hits(docs, _table(spark, sf_dir, "benchmark"))
    return found.select(
        "row.doc_id",
        "n_words",
        decontaminate.n_hit(F.col("spans")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated(F.col("spans"), F.col("n_words")).alias("contaminated"),
    )


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.search(vectors, F.col("vec_id") % 20 == 0, k=20)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = token_counts.with_token_counts(docs, "text", _vocabulary("byte_bpe_50k.json"), limit=1024)
    return out.select("row.doc_id", "n_bytes", "n_tokens", "over_limit")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return pieces.round_trip(_table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    folder = warc.new_folder(spark)
    kind = pages.schema["page_id"].dataType
    try:
        archives = warc.write_archives(warc.planned(pages, "page_id", "url", "html"), folder)
        members = warc.normalise_archives(archives, folder)
        read = warc.read_archives(members, folder)
        return durable(read.select(F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")))
    finally:
        warc.remove_folder(folder)


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = near_dup.components(docs, "doc_id", "text", width=2, threshold=0.8)
    return out.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"),
    )


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = runs.with_runs(docs, runs.with_planted_run(F.col("doc_id"), F.col("text")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    best = runs.densest(F.col("runs"))
    return out.withColumn("best", best).select(
        "row.doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = alignment.align(docs, _vocabulary("byte_bpe_50k.json"), _vocabulary("piece_bpe_32k.model"), keep=["doc_id"])
    return found.documents.select("row.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = exact_dedup.groups(docs)
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_shards": op1_shards,
        "op2_line_dedup": op2_line_dedup,
        "op3_neighbours": op3_neighbours,
        "op4_html_text": op4_html_text,
        "op5_token_counts": op5_token_counts,
        "op6_quality": op6_quality,
        "op7_decontaminate": op7_decontaminate,
        "op8_warc": op8_warc,
        "op9_sentencepiece": op9_sentencepiece,
        "op10_near_dup": op10_near_dup,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_token_alignment": op12_token_alignment,
        "op13_exact_dedup": op13_exact_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_dedup": OP2_SQL,
        "op3_neighbours": OP3_SQL,
        "op7_decontaminate": OP7_SQL,
        "op8_warc": OP8_SQL,
        "op10_near_dup": OP10_SQL,
        "op13_exact_dedup": OP13_SQL,
    }


OP2_SQL = r"""
WITH pages AS (
  SELECT doc_id, coalesce(source, chr(1)) AS host, coalesce(md5(text), '') AS whole, string_split(text, chr(10)) AS lines
  FROM documents),
totals AS (SELECT host, count(DISTINCT whole) AS host_pages FROM pages GROUP BY host),
seen AS (
  SELECT host, line, count(DISTINCT whole) AS pages
  FROM (SELECT host, whole, unnest(list_distinct(list_transform(lines, lambda x: trim(x, ' ' || chr(9) || chr(13))))) AS line FROM pages)
  WHERE line <> '' GROUP BY host, line),
heavy AS (
  SELECT host, list(line) AS heavy
  FROM seen JOIN totals USING (host)
  WHERE pages >= 5 AND pages / host_pages > CASE WHEN regexp_matches(line, '[^\t\n\x0B\f\r ][\t\n\x0B\f\r ]+[^\t\n\x0B\f\r ]') THEN 0.01 ELSE 0.1 END GROUP BY host),
marked AS (
  SELECT doc_id, lines, coalesce(heavy, []) AS heavy FROM pages LEFT JOIN heavy USING (host))
SELECT doc_id,
       array_to_string(list_filter(lines, lambda x: NOT list_contains(heavy, trim(x, ' ' || chr(9) || chr(13)))), chr(10)) AS text,
       coalesce(len(list_filter(lines, lambda x: trim(x, ' ' || chr(9) || chr(13)) <> '')), 0) AS n_lines,
       coalesce(len(list_filter(lines, lambda x: list_contains(heavy, trim(x, ' ' || chr(9) || chr(13))))), 0) AS n_dropped
FROM marked
"""

_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP7_SQL = f"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS_SQL} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS gram
  FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM item WHERE len(w) > 0)),
doc AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS_SQL} AS w FROM documents),
place AS (
  SELECT r, n, unnest(generate_series(1, len(w) - n + 1)) AS i, w
  FROM doc, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
met AS (
  SELECT r, i, p.n, item
  FROM (SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS gram FROM place) p
  JOIN win ON win.n = p.n AND win.gram = p.gram),
cover AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS j FROM met) GROUP BY r),
named AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM met GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN cover USING (r) LEFT JOIN named USING (r)
"""

OP10_SQL = r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
    ELSE list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]) END) AS s
  FROM doc),
item AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
-- Sets as similar as 0.8 share one of the rarest fifth of either's shingles.
ranked AS (
  SELECT doc_id, n, x, row_number() OVER (PARTITION BY doc_id ORDER BY f, x) AS k
  FROM item JOIN (SELECT x, count(*) AS f FROM item GROUP BY x) USING (x)),
cand AS (
  SELECT DISTINCT a.doc_id AS a, b.doc_id AS b
  FROM (SELECT * FROM ranked WHERE k <= n - ceil(0.8 * n) + 1) a
  JOIN (SELECT * FROM ranked WHERE k <= n - ceil(0.8 * n) + 1) b USING (x)
  WHERE a.doc_id < b.doc_id AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
link AS (
  SELECT a, b FROM cand JOIN sets p ON p.doc_id = a JOIN sets q ON q.doc_id = b
  WHERE 100 * len(list_intersect(p.s, q.s)) >= 80 * (len(p.s) + len(q.s) - len(list_intersect(p.s, q.s)))),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id,
       doc_id <= coalesce(low, doc_id) AS kept
FROM sets LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) ON a = doc_id
"""

# DuckDB has no base32: each five bits of the SHA-1 name one of 32 letters.
OP8_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
first AS (SELECT html, min(page_id) AS low FROM p GROUP BY html),
bits AS (
  SELECT page_id, html, array_to_string(list_transform(string_split(h, ''), lambda c: right('000' || bin(CAST('0x' || c AS INTEGER)), 4)), '') AS b FROM p)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + list_sum(list_transform(generate_series(0, 4), lambda j: CAST(substr(b, CAST(5 * i + j + 1 AS INTEGER), 1) AS INTEGER) * (16 >> CAST(j AS INTEGER))))::INTEGER, 1)), '') AS payload_digest,
       CASE WHEN page_id = low THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> low THEN low END AS refers_to
FROM bits JOIN first USING (html)
"""

OP13_SQL = r"""
WITH doc AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER same AS kept, text_sha256
FROM doc WINDOW same AS (PARTITION BY text_sha256)
"""

OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pair AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.x, v.x) AS score
  FROM v AS q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pair)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
