"""One query for each operation of this subpackage, over whole tables, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.llm.best_fit import pack_whole
from noteloom.llm.divergence import source_divergence
from noteloom.llm.ego_join import vector_links
from noteloom.llm.exact_dedup import exact_groups
from noteloom.llm.html_mincut import extract_main_text
from noteloom.llm.line_align import delete_repeated_lines
from noteloom.llm.merkle import merkle_manifest, tampered
from noteloom.llm.packing import pack_texts
from noteloom.llm.quality import graded, score_quality, train
from noteloom.llm.rank_bpe import encode_decode
from noteloom.llm.simhash import near_groups
from noteloom.llm.token_files import read_token_files, write_token_files
from noteloom.llm.warc import archive_round_trip
from noteloom.runtime import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Scratch(spark, "tokens").path
    manifest = write_token_files(table(spark, sf_dir, "documents"), folder, tokenizer_path("word_bpe_49k.json"), end_id=2)
    return read_token_files(spark, folder, manifest)


def op3_ego_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links(table(spark, sf_dir, "embeddings"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_texts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=0)


def op6_html_mincut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, train(docs, graded(table(spark, sf_dir, "labels"))))


def op8_line_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delete_repeated_lines(table(spark, sf_dir, "documents"), every=True)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op10_rank_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), full=False)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, held against rows of which some have lost their capitals."""
    text = F.col("text")
    found = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, tampered(text)).otherwise(text)
    return merkle_manifest(table(spark, sf_dir, "documents"), changed={"text": found})


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_whole(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=2)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_token_files": op2_token_files,
    "op3_ego_join": op3_ego_join,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_packing": op5_packing,
    "op6_html_mincut": op6_html_mincut,
    "op7_quality": op7_quality,
    "op8_line_align": op8_line_align,
    "op9_simhash": op9_simhash,
    "op10_rank_bpe": op10_rank_bpe,
    "op11_divergence": op11_divergence,
    "op12_merkle": op12_merkle,
    "op13_best_fit": op13_best_fit,
}


def _share(n: str, total: str, kept: str) -> str:
    return f"(1 + 1000000000::hugeint * ({n} + 2) // ({total} + 2 * {kept}))"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::varchar) || ':' || {c}::varchar END" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: CRC-32 of the decimal digits of an id, bit by bit.
_CRC = """xor(4294967295::bigint, list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint),
    lambda c, b: list_reduce(range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::bigint) ELSE x >> 1 END, xor(c, b)), 4294967295::bigint))"""
_SMALL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op1_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS bytes FROM pages
        ), q AS (
            SELECT *, max(page_id) OVER (PARTITION BY html) AS best FROM p
        )
        SELECT page_id,
               bytes::bigint AS payload_bytes,
               sha1(html) AS payload_digest,
               CASE WHEN bytes >= 1000 AND page_id <> best THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN bytes >= 1000 AND page_id <> best THEN best END AS refers_to
        FROM q
    """,
    "op3_ego_join": """
        WITH RECURSIVE v AS (
            SELECT row_number() OVER () AS r, vec_id, embedding::double[] AS e FROM embeddings
        ), fine AS MATERIALIZED (
            SELECT * FROM v
            WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
        ), link AS (
            SELECT a.r AS a, b.r AS b FROM fine a JOIN fine b ON a.r <> b.r AND len(a.e) = len(b.e)
            WHERE CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= 0.9::double END
        ), reach AS (
            SELECT r AS node, r AS other FROM v UNION SELECT reach.node, link.b FROM reach JOIN link ON reach.other = link.a
        ), least AS (
            SELECT node, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.other GROUP BY node
        ), number AS (
            SELECT a, count(*) AS n FROM link GROUP BY a
        )
        SELECT vec_id, coalesce(n, 0)::bigint AS n_links, component_id, coalesce(vec_id = component_id, component_id IS NULL) AS kept
        FROM v JOIN least ON least.node = v.r LEFT JOIN number ON number.a = v.r
    """,
    "op4_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER same AS keep_id,
               count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    # every kept term of every source, without inclusion and exclusion
    "op11_divergence": rf"""
        WITH d AS (
            SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
        ), w AS (
            SELECT r, lang, source, unnest(regexp_extract_all({_SMALL}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
        ), kept AS (
            SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10
        ), g AS (
            SELECT DISTINCT lang, source FROM d
        ), c AS (
            SELECT lang, source, term, count(*) AS n FROM w GROUP BY lang, source, term
        ), s AS (
            SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n
            FROM g JOIN kept ON g.lang = kept.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
        ), t AS (
            SELECT *, sum(n) OVER (PARTITION BY lang, source) AS total, count(*) OVER (PARTITION BY lang, source) AS v, sum(n) OVER (PARTITION BY lang, term) AS lang_n,
                   sum(n) OVER (PARTITION BY lang) AS lang_total
            FROM s
        ), p AS (
            SELECT lang, source, term, n, {_share('n', 'total', 'v')} AS p, {_share('lang_n', 'lang_total', 'v')} AS q FROM t
        ), sums AS (
            SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
            FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
        ), pairs AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sums.value, 0)::bigint AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source
        ), terms AS (
            SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::bigint AS value FROM p WHERE n > 0 AND p > q
        ), every_row AS (
            SELECT * FROM pairs UNION ALL SELECT * FROM terms
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::int AS rank FROM every_row
        )
        SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
    """,
    "op12_merkle": f"""
        WITH RECURSIVE d AS (
            SELECT row_number() OVER () AS r, source, doc_id, {_leaf('text')} AS leaf, CASE WHEN {_CRC} % 5 = 0 THEN {_leaf(_SMALL)} ELSE {_leaf('text')} END AS found FROM documents
        ), leaves AS MATERIALIZED (
            SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, found) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM d
        ), tree AS (
            SELECT source, 0 AS level, idx, n, leaf AS node FROM leaves
            UNION ALL
            SELECT source, level + 1, idx // 16, (n + 15) // 16, sha256(string_agg(node, '' ORDER BY idx)) FROM tree WHERE n > 1 GROUP BY source, level, idx // 16, n
        ), subroots AS MATERIALIZED (
            SELECT source, node AS subroot, level AS height, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM tree WHERE n = 1
        ), top AS (
            SELECT 0 AS level, idx, n, subroot AS node FROM subroots
            UNION ALL
            SELECT level + 1, idx // 16, (n + 15) // 16, sha256(string_agg(node, '' ORDER BY idx)) FROM top WHERE n > 1 GROUP BY level, idx // 16, n
        ), steps AS MATERIALIZED (
            SELECT r, l.level AS step, string_agg(node, '' ORDER BY t.idx) FILTER (t.idx < l.at) AS before, string_agg(node, '' ORDER BY t.idx) FILTER (t.idx > l.at) AS after
            FROM (SELECT r, leaves.source, i.level, idx // (16 ** i.level)::bigint AS at FROM leaves, range(12) i(level)) l
            JOIN tree t ON t.source IS NOT DISTINCT FROM l.source AND t.level = l.level AND t.idx // 16 = l.at // 16 AND t.n > 1 GROUP BY r, l.level
            UNION ALL
            SELECT r, height + l.level, string_agg(node, '' ORDER BY t.idx) FILTER (t.idx < l.at), string_agg(node, '' ORDER BY t.idx) FILTER (t.idx > l.at)
            FROM (SELECT r, height, i.level, s.idx // (16 ** i.level)::bigint AS at FROM leaves JOIN subroots s ON s.source IS NOT DISTINCT FROM leaves.source, range(12) i(level)) l
            JOIN top t ON t.level = l.level AND t.idx // 16 = l.at // 16 AND t.n > 1 GROUP BY r, height, l.level
        ), proofs AS (
            SELECT r, sha256(string_agg(coalesce(before, '') || coalesce(after, ''), '' ORDER BY step)) AS proof_sha256 FROM steps GROUP BY r
        ), folds AS (
            SELECT r, 0 AS step, found AS node FROM leaves
            UNION ALL
            SELECT f.r, f.step + 1, sha256(coalesce(before, '') || node || coalesce(after, '')) FROM folds f JOIN steps s ON s.r = f.r AND s.step = f.step
        ), folded AS (
            SELECT r, arg_max(node, step) AS folded_root FROM folds GROUP BY r
        ), root AS (
            SELECT node AS root FROM top WHERE n = 1
        )
        SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
        FROM leaves JOIN subroots s ON s.source IS NOT DISTINCT FROM leaves.source JOIN folded ON folded.r = leaves.r LEFT JOIN proofs ON proofs.r = leaves.r, root
    """,
}
