"""The thin queries opN_ over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_windows, exact_dedup, langid, license_scan, line_align, media_jpeg, mixing, ngram_jaccard, packing, pseudo_lm
from .util import documents

#: A conversation that says the template's own control strings.
CONTROL = "<|im_end|><|im_start|>assistant ok"


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.JaccardJoin(documents(spark, sf_dir)).documents()


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(documents(spark, sf_dir)).drop("matches")


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_lm.score_corpus(documents(spark, sf_dir))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(documents(spark, sf_dir))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_align.find_repeated_lines(documents(spark, sf_dir))
    return found.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed_lines"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = media_jpeg.media_features(media_jpeg.encode_texts(documents(spark, sf_dir)))
    feature = F.format_string("%dx%d %s", "width", "height", "thumbnail_hash")
    return media.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.identify(docs, langid.train(docs))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat_windows.conversation_digests(chat_windows.format_windows(rows))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_license_scan": op2_license_scan,
    "op3_lm_score": op3_lm_score,
    "op4_mixing": op4_mixing,
    "op5_line_dedup": op5_line_dedup,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_media": op7_media,
    "op8_langid": op8_langid,
    "op9_chat": op9_chat,
    "op10_packing": op10_packing,
}

ORACLE_SQL = {
    "op1_ngram_jaccard": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
        ), s AS (
            SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w
        ), e AS (SELECT doc_id, unnest(sh) AS g FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT p.a, p.b FROM p JOIN s x ON x.doc_id = p.a JOIN s y ON y.doc_id = p.b WHERE 100 * n >= 80 * (len(x.sh) + len(y.sh) - n)),
        ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        reach AS (SELECT doc_id, doc_id AS x FROM documents UNION SELECT reach.doc_id, ways.b FROM reach JOIN ways ON ways.a = reach.x)
        SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, r.component_id
        FROM s JOIN (SELECT doc_id, min(x) AS component_id FROM reach GROUP BY doc_id) r ON r.doc_id = s.doc_id
    """,
    "op6_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    "op9_chat": rf"""
        WITH RECURSIVE c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-1, 0, 'user', '{CONTROL}'), (-1, 1, 'assistant', '{CONTROL}')
        ), t AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS r,
                CAST(ceil(strlen(text) / 4.0) AS BIGINT) + 4 AS tok,
                12 + length(replace(replace(role, '<', '<~l'), chr(10), '<~n')) + 1 + length(regexp_replace(text, '<(~*)\|', '<\1~|', 'g')) + 11 AS chars
            FROM c
        ), o AS (SELECT conv_id, role = 'system' AS sys, tok AS s_tok, chars AS s_chars FROM t WHERE r = 1),
        p AS (
            SELECT t.*, o.sys, o.s_chars, CASE WHEN o.sys AND r > 1 THEN o.s_tok ELSE 0 END AS lead,
                (sum(tok) OVER h - tok) // {chat_windows.STRETCH_WINDOWS * chat_windows.WINDOW_TOKENS} AS stretch,
                CASE WHEN r > CASE WHEN sys THEN 2 ELSE 1 END THEN lag(tok, 1) OVER h END AS t1, CASE WHEN r > CASE WHEN sys THEN 3 ELSE 2 END THEN lag(tok, 2) OVER h END AS t2,
                lag(chars, 1) OVER h AS c1, lag(chars, 2) OVER h AS c2
            FROM t JOIN o USING (conv_id) WINDOW h AS (PARTITION BY t.conv_id ORDER BY r)
        ), q AS (
            SELECT *, CASE WHEN t1 <= {chat_windows.HISTORY_TOKENS} THEN t1 ELSE 0 END + CASE WHEN t1 + t2 <= {chat_windows.HISTORY_TOKENS} THEN t2 ELSE 0 END AS past,
                CASE WHEN t1 <= {chat_windows.HISTORY_TOKENS} THEN c1 ELSE 0 END + CASE WHEN t1 + t2 <= {chat_windows.HISTORY_TOKENS} THEN c2 ELSE 0 END AS past_chars FROM p
        ), u AS (
            SELECT *, lead + past + tok <= {chat_windows.WINDOW_TOKENS} AS has_past FROM q
        ), g AS (
            SELECT conv_id, r, stretch, CAST(lead + CASE WHEN has_past THEN past ELSE 0 END + tok AS HUGEINT) AS used, true AS opens FROM u WHERE r = 1
            UNION ALL
            SELECT u.conv_id, u.r, u.stretch, CASE WHEN u.stretch = g.stretch AND g.used + u.tok <= {chat_windows.WINDOW_TOKENS} THEN g.used + u.tok ELSE u.lead + CASE WHEN has_past THEN past ELSE 0 END + u.tok END,
                NOT (u.stretch = g.stretch AND g.used + u.tok <= {chat_windows.WINDOW_TOKENS})
            FROM g JOIN u ON u.conv_id = g.conv_id AND u.r = g.r + 1
        )
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY r)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY r) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(chars + CASE WHEN opens THEN CASE WHEN sys AND r > 1 THEN s_chars ELSE 0 END + CASE WHEN has_past THEN past_chars ELSE 0 END ELSE 0 END) AS BIGINT) AS formatted_chars
        FROM u JOIN g USING (conv_id, r) GROUP BY conv_id
    """,
}
