"""The operators of this subpackage as queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, fingerprint, langid, linededup, pii, ranked, sharding, simhash, tokencount, toxicity, trie, warc
from tidemark.llm.rows import documents, held_out, prepare


def tokenizer(name: str) -> str:
    """Where a public tokenizer's file lies; asked for only when a query needs one."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy, accepted; learns from documents that are not held out."""
    docs = documents(spark, sf_dir)
    model = langid.trained(spark, docs.where(~held_out()))
    found = langid.identify(docs, model)
    return found.withColumnRenamed("id", "doc_id").select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "cross_entropy", "accepted")


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    return fingerprint.edits(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op3_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    return tokencount.token_counts(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, containment of every benchmark item whose shingles a document has to 0.8 or more."""
    found = decontaminate.matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "containment")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text with pseudonyms, n_pseudonyms of every document. The key is a setting of the session; the one here is for test tables."""
    key = spark.conf.get("spark.tidemark.pseudonyms.key", "key of the test tables")
    return pii.pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), key, count_col="n_pseudonyms")


def op6_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text with one line of each group kept, removed (places of the lines that went) of every document."""
    return linededup.dedup(documents(spark, sf_dir).select("doc_id", "text"), removed_col="removed")


def op7_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law (rows), shard, slot, grown_shard (null), hilbert of every document."""
    found = sharding.placed(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; learns from labels that are not held out."""
    docs = documents(spark, sf_dir)
    machine = toxicity.trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out()))
    found = toxicity.score_documents(docs.select("doc_id", "text"), machine)
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    return bpe.encode_digests(documents(spark, sf_dir), tokenizer("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id of every document."""
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_prefixtrie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node of the rebuilt conversations."""
    return trie.nodes(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record, read from the archives that are written for all pages."""
    folder = f"{spark.sparkContext.getCheckpointDir()}/warc-{uuid.uuid4().hex}"
    warc.write(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return warc.read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, rank, doc_id, score: the 20 documents with the highest scores of every benchmark item."""
    found = ranked.best_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_langid": op1_langid,
    "op2_fingerprint": op2_fingerprint,
    "op3_tokencount": op3_tokencount,
    "op4_decontaminate": op4_decontaminate,
    "op5_pii": op5_pii,
    "op6_linededup": op6_linededup,
    "op7_hilbert": op7_hilbert,
    "op8_toxicity": op8_toxicity,
    "op9_bpe": op9_bpe,
    "op10_simhash": op10_simhash,
    "op11_prefixtrie": op11_prefixtrie,
    "op12_warc": op12_warc,
    "op13_ranked": op13_ranked,
}

ORACLE_SQL: dict[str, str] = {
    # Exact containment by shingles: what the search must find, and no more.
    "op4_decontaminate": """
        WITH dw AS (SELECT row_number() OVER () r, doc_id, list_filter(string_split(regexp_replace(lower(text), '[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]', ' ', 'g'), ' '), lambda x: x <> '') w FROM documents WHERE text IS NOT NULL),
        iw AS (SELECT row_number() OVER () k, item_id, list_filter(string_split(regexp_replace(lower(text), '[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]', ' ', 'g'), ' '), lambda x: x <> '') w FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
        si AS (SELECT DISTINCT k, item_id, least(5, len(w)) n, unnest(list_transform(range(1, greatest(1, len(w) - 4) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) s FROM iw WHERE len(w) > 0),
        sizes AS (SELECT k, count(*) m FROM si GROUP BY k),
        sd AS (SELECT DISTINCT r, doc_id, n, s FROM (SELECT r, doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) s FROM dw, (SELECT DISTINCT n FROM si) WHERE len(w) >= n)),
        hit AS (SELECT r, any_value(doc_id) doc_id, k, any_value(item_id) item_id, count(*) c FROM sd JOIN si USING (n, s) GROUP BY r, k)
        SELECT doc_id, item_id, c * 1.0::DOUBLE / m AS containment FROM hit JOIN sizes USING (k) WHERE c * 1.0::DOUBLE / m >= 0.8 - 1e-12
    """,
    "op11_prefixtrie": """
        WITH own AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS r, length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS turn, length(coalesce(text, '')) AS len FROM conversations WHERE conv_id IS NOT NULL),
        crc AS (SELECT c, xor(list_reduce(list_transform(range(length(c::VARCHAR)), lambda i: ascii(substr(c::VARCHAR, (i + 1)::BIGINT, 1))::BIGINT), lambda a, b: list_reduce(range(8)::BIGINT[], lambda x, k: xor(x >> 1, 3988292384 * (x & 1)), xor(a, b)), 4294967295::BIGINT), 4294967295::BIGINT) % 6 AS h FROM (SELECT DISTINCT c FROM own)),
        seq AS (SELECT crc.c, 0 AS part, own.r, turn, len FROM crc JOIN own ON own.c = crc.c - crc.c % 100 AND own.r <= h UNION ALL SELECT c, 1, r, turn, len FROM own JOIN crc USING (c) WHERE r > h),
        upto AS (SELECT c, row_number() OVER w AS pos, sha256(string_agg(sha256(turn), '') OVER w) AS key, len FROM seq WINDOW w AS (PARTITION BY c ORDER BY part, r) UNION ALL SELECT c, 0, '', 0 FROM crc),
        p AS (SELECT *, max(pos) OVER (PARTITION BY c) AS whole FROM upto),
        n AS (SELECT pos, key, min(c) AS owner, count(*) AS n, any_value(len) AS len, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (pos = whole), '')) AS ends FROM p GROUP BY pos, key),
        up AS (SELECT n.*, m.owner AS parent, m.key AS parent_key FROM n LEFT JOIN p ON p.c = n.owner AND p.pos = n.pos - 1 LEFT JOIN n AS m ON m.pos = p.pos AND m.key = p.key),
        kids AS (SELECT pos - 1 AS pos, parent_key AS key, count(*) AS kids FROM up WHERE pos > 0 GROUP BY ALL),
        own_values AS (SELECT up.owner, up.pos, CASE WHEN kids IS NULL THEN 1 ELSE 0 END AS leaf, (n - 1) * len AS saved FROM up LEFT JOIN kids USING (pos, key)),
        sums AS (SELECT p.pos, p.key, sum(leaf)::BIGINT AS leaves, sum(saved)::BIGINT AS saved FROM own_values v JOIN p ON p.c = v.owner AND p.pos <= v.pos GROUP BY p.pos, p.key)
        SELECT owner AS conv_id, pos AS depth, parent AS parent_conv_id, n AS n_convs, coalesce(kids, 0) AS n_children, leaves AS n_leaves, sums.saved AS saved_tokens, ends AS ends_sha256 FROM up LEFT JOIN kids USING (pos, key) JOIN sums USING (pos, key)
    """,
    "op12_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS h, row_number() OVER (PARTITION BY html ORDER BY page_id NULLS LAST) AS k, first(page_id) OVER (PARTITION BY html ORDER BY page_id NULLS LAST) AS least FROM p)
        SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((((strpos('0123456789abcdef', h[1 + i * 5 // 4]) - 1) * 16 + strpos('0123456789abcdef', h[2 + i * 5 // 4]) - 1) >> (3 - i * 5 % 4)) & 31)::BIGINT]), '') AS payload_digest,
        CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN least END AS refers_to FROM d
    """,
    "op13_ranked": """
        WITH dw AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
        iw AS (SELECT row_number() OVER () AS k, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
        qt AS (SELECT k, item_id, term, count(*) AS c FROM (SELECT k, item_id, unnest(w) AS term FROM iw) GROUP BY ALL),
        dl AS (SELECT r, doc_id, len(w)::BIGINT AS n, w FROM dw WHERE len(w) > 0),
        total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM dl),
        tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(w) AS term FROM dl) SEMI JOIN qt USING (term) GROUP BY ALL),
        wt AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, total GROUP BY term),
        hit AS (SELECT k, item_id, r, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words))))::BIGINT AS score FROM tf JOIN wt USING (term) JOIN qt USING (term), total GROUP BY k, item_id, r, doc_id),
        placed AS (SELECT item_id, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM hit WHERE score > 0 AND doc_id IS NOT NULL)
        SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 20
    """,
}


def _prepared(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _prepared(query) for name, query in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
