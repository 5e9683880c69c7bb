"""The queries of the corpus operators, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termdrift.llm import byte_bpe, centroids, exact_dedup, line_dedup, near_dedup, packing, phrases, pii, pivot_search, quality, toxicity, unigram, warc
from termdrift.llm.labelled import held_out
from termdrift.llm.tables import read, small_batches


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    scored = quality.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    coded = byte_bpe.encode_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = F.array_join(F.col("token_ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_repeated_lines(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return toxicity.grade_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).select("doc_id", "severity", "grade", "toxic")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return unigram.count_corpus(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_tokens")


def op6_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_search.top_inner_products(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, then n_secret long, the spans that the trees add as secrets, and n_spans long, all spans."""
    found = pii.find(read(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda spans, name: F.size(spans).cast("long").alias(name)
    n = [count(pii.of_kind(F.col("base_spans"), kind), f"n_{kind}") for kind in pii.BASE_KINDS]
    more = count(pii.of_kind(F.col("spans"), "secret"), "n_secret"), count(F.col("spans"), "n_spans")
    return found.select("doc_id", *n, F.sha2(pii.shown(F.col("base_spans")), 256).alias("base_sha256"), pii.shown(F.col("spans")).alias("spans"), *more)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = exact_dedup.mark_copies(read(spark, sf_dir, "documents"))
    return marked.select("doc_id", "keep_id", "group_size", "kept", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark, 2000)
    return packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return near_dedup.cluster_documents(read(spark, sf_dir, "documents"), shingle=4)


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.with_inertia(*centroids.cluster_vectors(read(spark, sf_dir, "embeddings")))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(read(spark, sf_dir, "pages"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return phrases.mine_phrases(read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_quality, op2_byte_bpe, op3_line_dedup, op4_toxicity, op5_token_counts, op6_pivot_search, op7_pii, op8_exact_dedup, op9_packing, op10_near_dedup,
    op11_centroids, op12_warc, op13_phrases, pipeline,
)}


def _rounds(n: int) -> str:
    """n rounds of assignment and means, each as two tables; then the last assignment, a{n}."""
    near = lambda r: f"""a{r} AS MATERIALIZED (
            SELECT vec_id, place, any_value(e) AS e, min(CAST(ee + cc - 2 * list_inner_product(e, c) AS BIGINT) * 64 + j) AS best
            FROM v, (SELECT *, list_inner_product(c, c) AS cc FROM c{r}) GROUP BY vec_id, place)"""  # noqa: E731
    mean = lambda r: f"""c{r + 1} AS MATERIALIZED (
            SELECT o.j, coalesce(n.c, o.c) AS c FROM c{r} o LEFT JOIN (
                SELECT j, list(floor(s / n) ORDER BY i) AS c FROM (
                    SELECT best % 64 AS j, i, sum(e[i]) AS s, count(*) AS n FROM a{r}, range(1, 65) t(i) GROUP BY ALL) GROUP BY j) n ON o.j = n.j)"""  # noqa: E731
    return ", ".join(f"{near(r)}, {mean(r)}" for r in range(n)) + f", {near(n)}"


ORACLE_SQL = {
    "op3_line_dedup": """
        WITH l AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
            FROM documents),
        k AS (
            SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        r AS (
            SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10
            GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
        m AS (
            SELECT k.doc_id, k.place, k.line, r.first_doc IS NOT NULL AND r.first_doc <> k.doc_id AS gone
            FROM k LEFT JOIN r ON k.key = r.key)
        SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM m GROUP BY doc_id""",
    "op6_pivot_search": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20""",
    "op8_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op11_centroids": f"""
        WITH v AS MATERIALIZED (
            SELECT *, list_inner_product(e, e) AS ee, row_number() OVER () AS place FROM (
                SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
                WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
        c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), e) - 1 AS j, e AS c FROM v WHERE vec_id IS NOT NULL QUALIFY j < 40),
        {_rounds(5)},
        d AS (SELECT vec_id, CAST(best % 64 AS INTEGER) AS cluster, best // 64 AS distance FROM a5)
        SELECT d.*, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
               sha256(array_to_string(list_transform(c, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256
        FROM d JOIN c5 ON d.cluster = c5.j""",
    "op12_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
        k AS (SELECT *, CASE WHEN octet_length(payload) >= 1000 THEN max(page_id) OVER (PARTITION BY payload) END AS keep FROM p)
        SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest,
               CASE WHEN keep IS NOT NULL AND keep IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN keep IS DISTINCT FROM page_id THEN keep END AS refers_to
        FROM k""",
    "op13_phrases": r"""
        WITH d AS (
            SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
        w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
        n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
        g AS (
            SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase
            FROM w, range(1, 5) t(m) WHERE len(ws) >= m),
        f AS (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
        c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE m > 1),
        inside AS (
            SELECT lang, a, unnest(list_transform(range(1, m - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM c, range(2, 4) t(k) WHERE k < m),
        longer AS (SELECT lang, phrase, max(a) AS most FROM inside GROUP BY ALL),
        left_over AS (SELECT c.* FROM c LEFT JOIN longer o ON c.lang = o.lang AND c.phrase = o.phrase WHERE most IS NULL OR 100 * most < 80 * c.a),
        cuts AS (SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS x, array_to_string(ws[k + 1:m], ' ') AS y FROM left_over, range(1, 4) t(k) WHERE k < m),
        scores AS (
            SELECT cuts.*, l.a AS l, r.a AS r, CAST(CAST(2000000 AS HUGEINT) * cuts.a // (l.a + r.a) AS BIGINT) AS score
            FROM cuts JOIN f l ON cuts.lang = l.lang AND x = l.phrase JOIN f r ON cuts.lang = r.lang AND y = r.phrase),
        best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
        FROM best JOIN n USING (lang) QUALIFY rank <= 2000""",
}
