"""The queries opN_<name> of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh_path, table, until_end

URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urlfilter import RULES_SCHEMA, filter_urls

    return filter_urls(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, RULES_SCHEMA))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixdedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import decontaminate

    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), with_text=False)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secretscan import ordinary_samples, random_samples, scan_secrets, span_count, span_list, train

    docs = table(spark, sf_dir, "documents")
    model = train(random_samples(spark).union(ordinary_samples(docs, table(spark, sf_dir, "labels"))))
    return scan_secrets(docs, model).select(
        "doc_id",
        *[span_count("base", k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(span_list("base").cast("binary"), 256).alias("base_sha256"),
        span_list("spans").alias("spans"),
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokenbin import read_token_files, write_token_files

    folder = fresh_path(spark, "token-files")
    manifest = write_token_files(table(spark, sf_dir, "documents"), folder)
    until_end(spark, folder)
    return read_token_files(spark, folder, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .htmlextract import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lmscore import score_documents

    return score_documents(table(spark, sf_dir, "documents")).drop("lattice_score")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repetition import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefixtrie import conversation_trie

    return conversation_trie(table(spark, sf_dir, "conversations"))


def op12_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .piececodec import decode_ids, encode_texts

    path = "piece_bpe_32k.model"

    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    decoded = decode_ids(encode_texts(table(spark, sf_dir, "documents"), path), path)
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), F.xxhash64("begins", "ends").alias("places_hash")
    )


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vectorcode import compress_vectors

    return compress_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_secret_scans": op4_secret_scans,
    "op5_packing": op5_packing,
    "op6_token_files": op6_token_files,
    "op7_html_extraction": op7_html_extraction,
    "op8_lm_scores": op8_lm_scores,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_quality_rules": op10_quality_rules,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_piece_codec": op12_piece_codec,
    "op13_vector_codes": op13_vector_codes,
}

_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in URL_RULES)
#: Of a decimal id: all bits, then for each byte the byte and eight shifts.
_CRC_STEPS = "[4294967295] || flatten(list_transform(range(1, length(CAST(c AS VARCHAR)) + 1), lambda j: [CAST(ascii(substr(CAST(c AS VARCHAR), CAST(j AS BIGINT), 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"


def _code_round(r: int) -> str:
    """Nearest entries of round r's codebooks, and the next ones: floors of the means."""
    far = "list_sum(list_transform(list_zip(part.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    near = f"""
), a{r} AS MATERIALIZED (SELECT i, part.p, part.v, min_by(e, {{'d': {far}, 'e': e}}) e, CAST(min({far}) AS BIGINT) d FROM part JOIN c{r} c ON part.p = c.p GROUP BY i, part.p, part.v"""
    if r == 6:
        return near + ")"
    return near + f"""
), m{r} AS (SELECT p, e, j, CAST(sum(x) AS BIGINT) s, count(*) n FROM (SELECT p, e, unnest(v) x, generate_subscripts(v, 1) j FROM a{r}) GROUP BY p, e, j
), c{r + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(n.v, c.v) v FROM c{r} c LEFT JOIN (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY j) v FROM m{r} GROUP BY p, e) n USING (p, e)"""


_CODE_ROUNDS = "".join(_code_round(r) for r in range(7)).replace("\n), a0", ",\n a0", 1)
ORACLES = {
    "op1_url_filters": f"""
WITH rules(h, p, a) AS (VALUES {_RULE_ROWS}),
u AS (
  SELECT row_number() OVER () AS rid, page_id,
    CASE WHEN url IS NULL OR position('://' IN url) = 0 THEN '' ELSE substr(url, position('://' IN url) + 3) END AS rest
  FROM pages
), v AS (
  SELECT rid, page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), m AS (
  SELECT v.*, h, p, a, row_number() OVER (PARTITION BY rid ORDER BY length(h) + length(p) DESC, length(h) DESC) AS k,
    count(h) OVER (PARTITION BY rid) AS unused
  FROM v LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
), n AS (
  SELECT rid, count(*) AS n_expressions
  FROM v, (SELECT DISTINCT length(h) AS lh, length(p) AS lp FROM rules)
  WHERE lp <= length(path) AND (lh = length(host) OR (lh < length(host) AND substr(host, length(host) - lh, 1) = '.'))
  GROUP BY rid
)
SELECT page_id, host, path, h || p AS rule,
  coalesce(a, CASE WHEN host = '' THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(n_expressions, 0) AS n_expressions
FROM m LEFT JOIN n USING (rid) WHERE k = 1
""",
    "op11_conversation_trie": f"""
WITH t AS (
  SELECT conv_id c, coalesce(role, '') role, coalesce(text, '') x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) r
  FROM conversations WHERE conv_id IS NOT NULL
), k AS (SELECT DISTINCT c FROM t), h AS (
  SELECT c, c - c % 100 b, CAST(xor(list_reduce({_CRC_STEPS}, lambda s, v: CASE WHEN v >= 0 THEN xor(s, v) ELSE xor(s >> 1, 3988292384 * (s & 1)) END), 4294967295) AS BIGINT) % 6 h
  FROM k
), turns AS (
  SELECT h.c, t.r d, t.role, t.x FROM h JOIN t ON t.c = h.b WHERE t.r <= h.h
  UNION ALL
  SELECT h.c, least(h.h, (SELECT count(*) FROM t u WHERE u.c = h.b)) + t.r - h.h, t.role, t.x FROM h JOIN t ON t.c = h.c WHERE t.r > h.h
), sized AS (SELECT c, (SELECT count(*) FROM turns u WHERE u.c = h.c) n FROM h),
 members AS (
  SELECT c, d, length(x) len, n, sha256(string_agg(sha256(role || chr(1) || x), '') OVER (PARTITION BY c ORDER BY d)) p FROM turns JOIN sized USING (c)
  UNION ALL SELECT c, 0, 0, n, 'root' FROM sized
), nodes AS (
  SELECT p, d, any_value(len) len, count(*) n_convs, min(c) conv, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d), '')) ends FROM members GROUP BY p, d
), up AS (
  SELECT DISTINCT a.p, a.d, b.p q FROM members a JOIN members b ON a.c = b.c AND b.d = a.d - 1
), kids AS (SELECT q p, count(*) n FROM up GROUP BY q),
 below AS (SELECT DISTINCT a.p, b.p q FROM members a JOIN members b ON a.c = b.c AND b.d >= a.d),
 sums AS (
  SELECT below.p, sum((n.n_convs - 1) * n.len) saved, count(*) FILTER (coalesce(kids.n, 0) = 0) leaves
  FROM below JOIN nodes n ON n.p = below.q LEFT JOIN kids ON kids.p = below.q GROUP BY below.p
)
SELECT n.conv AS conv_id, CAST(n.d AS BIGINT) AS depth, o.conv AS parent_conv_id, n.n_convs, coalesce(kids.n, 0) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, n.ends AS ends_sha256
FROM nodes n LEFT JOIN up ON up.p = n.p LEFT JOIN nodes o ON o.p = up.q LEFT JOIN kids ON kids.p = n.p JOIN sums ON sums.p = n.p
""",
    "op13_vector_codes": f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) i, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) q
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), part AS MATERIALIZED (
  SELECT i, p, list_slice(q, p * (len(q) // 8) + 1, (p + 1) * (len(q) // 8)) v FROM kept, range(8) t(p)
), c0 AS MATERIALIZED (SELECT p, i - 1 e, v FROM part WHERE i <= 16){_CODE_ROUNDS},
 books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) s FROM c6),
 coded AS (SELECT i, string_agg(printf('%02x', e), '' ORDER BY p) code, CAST(sum(d) AS BIGINT) error FROM a6 GROUP BY i)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, s AS codebooks_sha256 FROM kept JOIN coded USING (i), books
""",
}
