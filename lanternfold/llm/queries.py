"""Registered queries of the operators, and their DuckDB counterparts where SQL has one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfold.llm import ball_tree, chat, divergence, exact_dedup, jaccard, line_dedup, mixing, packing, pii, quality, token_counts, topk, wrapper
from lanternfold.llm.common import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk.search(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.main_texts(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.without_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summarise(pii.find(table(spark, sf_dir, "documents")))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.histogram(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return token_counts.with_sums(counted)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("row")


def op11_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer, tricky = public_tokenizers.path("byte_bpe_50k.json"), "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.digest(chat.format_conversations(rows, tokenizer), tokenizer)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


QUERIES = {f.__name__: f for f in (
    op1_packing, op2_topk, op3_html, op4_line_dedup, op5_quality, op6_jaccard, op7_pii, op8_exact_dedup, op9_token_counts,
    op10_mixing, op11_chat, op12_divergence, op13_lexical)}

ORACLES = {
    "op2_topk": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
          FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
          SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
               vec_id, score
        FROM scored QUALIFY rank <= 10""",
    "op4_line_dedup": """
        WITH l AS (
          SELECT d.doc_id, u.i, u.line,
                 translate(trim(u.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
          FROM documents d, LATERAL (
            SELECT unnest(string_split(coalesce(d.text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(d.text, ''), chr(10)), 1) AS i) u
        ), k AS (
          SELECT k, max(doc_id) AS last FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
        ), m AS (
          SELECT l.doc_id, l.i, l.line, k.last IS NOT NULL AND l.doc_id <> k.last AS gone
          FROM l LEFT JOIN k ON l.k = k.k
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
        FROM m GROUP BY doc_id""",
    "op8_exact_dedup": """
        WITH t AS (
          SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
          FROM documents
        )
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY t)""",
    "op10_mixing": """
        WITH RECURSIVE u AS (
          SELECT doc_id, source, coalesce(text, '') AS text, md5(coalesce(text, '')) AS row,
                 len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) + 1 AS words
          FROM documents
        ), d AS (
          SELECT doc_id, source, row, CAST(sum(words) AS BIGINT) AS tokens, count(*) AS n_rows FROM u GROUP BY ALL
        ), s AS (
          SELECT source, CAST(sum(tokens) AS BIGINT) AS whole FROM d GROUP BY source
        ), p AS (
          SELECT source, whole, sum(whole) OVER () AS every, whole / sum(whole) OVER () AS share FROM s
        ), ends AS (SELECT min(share) AS least, max(share) AS most FROM p),
        b AS (
          SELECT 0 AS i, CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi
          UNION ALL
          SELECT i + 1, CASE WHEN pow(least / most, (lo + hi) / 2 - 1) <= 2 THEN lo ELSE (lo + hi) / 2 END,
                 CASE WHEN pow(least / most, (lo + hi) / 2 - 1) <= 2 THEN (lo + hi) / 2 ELSE hi END
          FROM b, ends WHERE i < 60
        ), a AS (
          SELECT CASE WHEN pow(least / most, -1) <= 2 THEN 0 ELSE hi END AS alpha FROM b, ends WHERE i = 60
        ), w AS (
          SELECT source, whole, pow(share, alpha) / sum(pow(share, alpha)) OVER () AS weight,
                 sum(pow(share, alpha)) OVER () / pow(max(share) OVER (), alpha - 1) * every AS total
          FROM p, a
        ), q AS (
          SELECT source, whole, greatest(whole, CAST(round(total * weight, 0) AS BIGINT)) AS quota,
                 greatest(1, CAST(ceil(CAST(total AS BIGINT) / 1000000.0) AS BIGINT)) AS blocks
          FROM w
        ), r AS (
          SELECT d.*, q.quota, q.blocks, c.copy, md5(d.doc_id || ':' || d.row || ':' || c.copy) AS o
          FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source,
               LATERAL (SELECT unnest(range(0, (q.quota - 1) // q.whole + 1)) AS copy) c
        ), t AS (
          SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY copy, o, doc_id ROWS UNBOUNDED PRECEDING) AS stop FROM r
        ), f AS (
          SELECT *, least(blocks - 1, CAST(floor((stop - tokens) * (blocks / quota)) AS BIGINT)) AS block
          FROM t WHERE stop <= quota
        )
        SELECT doc_id, source, n_rows, copy, tokens, block,
               CAST(row_number() OVER (PARTITION BY block ORDER BY o, doc_id, source) AS INTEGER) AS position
        FROM f""",
    "op11_chat": """
        WITH r AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
          UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
        ), e AS (
          SELECT *, len(regexp_extract_all(role || chr(0) || text, '<~*/s>|<~*s>|<~*<SYS>>|<~*</SYS>>|<~*\\|(role|text|end|endoftext)\\|>|\\[~*/?INST\\]'))
                      - CASE WHEN role IN ('user', 'system', 'assistant')
                             THEN len(regexp_extract_all(role, '<~*/s>|<~*s>')) ELSE 0 END AS escapes
          FROM r
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(length(text) + escapes + CASE role WHEN 'user' THEN 13 WHEN 'system' THEN 15 WHEN 'assistant' THEN 7
                                                      ELSE length(role) + 23 END) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op12_divergence": """
        WITH d AS (
          SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                 translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
        ), w AS (
          SELECT i, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d
        ), k AS (
          SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT i) >= 3
        ), v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
        g AS (SELECT DISTINCT lang, source FROM d),
        c AS (SELECT lang, source, term, count(*) AS c FROM w JOIN k USING (lang, term) GROUP BY ALL),
        n AS (SELECT lang, source, coalesce(sum(c), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
        cl AS (SELECT lang, term, sum(c) AS c FROM c GROUP BY ALL),
        nl AS (SELECT lang, sum(c) AS n FROM c GROUP BY ALL),
        p AS (
          SELECT n.lang, n.source, k.term, coalesce(c.c, 0) AS c,
                 1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.c, 0) + 1) // CAST(n.n + v.v AS HUGEINT) AS p
          FROM n JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)
        ), q AS (
          SELECT lang, term, 1 + CAST(1000000000 AS HUGEINT) * (cl.c + 1) // CAST(nl.n + v.v AS HUGEINT) AS q
          FROM cl JOIN nl USING (lang) JOIN v USING (lang)
        ), f AS (
          SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
          FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
        ), pairs AS (
          SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
               LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
        ), terms AS (
          SELECT p.lang, p.source, 'term' AS part, p.term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value
          FROM p JOIN q USING (lang, term) WHERE p.c > 0 AND p > q
        ), every AS (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
        SELECT lang, source, part, item, value,
               CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
        FROM every QUALIFY part = 'pair' OR rank <= 200""",
    "op13_lexical": """
        WITH d AS (
          SELECT doc_id, row_number() OVER () AS i,
                 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM documents
        ), b AS (
          SELECT item_id, row_number() OVER () AS j,
                 unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark
        ), s AS (SELECT count(*) AS n, CAST(sum(len(t)) AS BIGINT) AS l FROM d WHERE len(t) > 0),
        w AS (SELECT i, unnest(t) AS term FROM d),
        tf AS (SELECT i, term, count(*) AS tf FROM w WHERE term IN (SELECT term FROM b) GROUP BY ALL),
        df AS (SELECT term, CAST(floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY term, n),
        m AS (SELECT i, doc_id, 25 + (75 * len(t) * n) // l AS m FROM d, s WHERE len(t) > 0),
        r AS (
          SELECT b.j, b.item_id, m.i, m.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
          FROM b JOIN tf USING (term) JOIN df USING (term) JOIN m USING (i) GROUP BY ALL HAVING score > 0
        ), o AS (
          SELECT *, CAST(row_number() OVER (PARTITION BY j ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM r
        )
        SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10""",
}
