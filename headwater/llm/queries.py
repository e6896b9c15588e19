"""The registered queries of this subpackage, and the SQL that checks those which SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headwater.llm import (
    bpe_codec, decontamination, exact_dedup, merkle, near_dedup, paragraphs, pattern_packing, quality, spelling, token_counts, token_matrix,
    url_rules, warc,
)
from headwater.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

GIVEN_RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
]

# CRC-32 of a blob in SQL: the table of 256 remainders, and its use byte by byte.
CRC_TABLE = """
    crc_table AS (
        SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS crcs
        FROM (SELECT unnest(range(256)) AS n)
    )"""


def crc_sql(text: str) -> str:
    """The unsigned CRC-32 of a text; ``crcs`` is the list of ``CRC_TABLE``."""
    octets = f"list_transform(range(strlen({text})), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295)"


def query(sql: str | None = None) -> Callable:
    def register(build: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[build.__name__] = build
        if sql is not None:
            ORACLES[build.__name__] = sql
        return build

    return register


@query()
def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query()
def op2_bpe_codec(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoded = bpe_codec.encode(table(spark, folder, "documents"), path)
    return bpe_codec.decode(encoded, path).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256")
    )


@query()
def op3_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of documents teach about the pages that hold their text; bad is toxic or of low quality."""
    pages, labels = table(spark, folder, "pages"), table(spark, folder, "labels")
    bad = labels.groupBy("doc_id").agg(F.max((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).alias("bad"))
    labelled = url_rules.label_pages(pages, table(spark, folder, "documents"), bad)
    return url_rules.judge_urls(pages, GIVEN_RULES, url_rules.mine_rules(labelled))


@query()
def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_verdicts(table(spark, folder, "documents"))


@query("""
    WITH payloads AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS digest FROM pages),
    parts AS (
        SELECT *, max(page_id) OVER (PARTITION BY payload) AS keep,
               list_transform([1, 11, 21, 31], lambda i: to_base(CAST('0x' || substr(digest, i, 10) AS BIGINT), 32, 8)) AS part
        FROM payloads
    )
    SELECT page_id, octet_length(payload) AS payload_bytes,
           translate(list_aggregate(part, 'string_agg', ''), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
           CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> keep THEN keep END AS refers_to
    FROM parts
""")
def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages"))


@query()
def op6_token_matrix(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    shards, pieces = token_matrix.write_matrices(docs, public_tokenizers.path("word_bpe_49k.json"))
    return token_matrix.read_pieces(spark, shards, pieces)


@query()
def op7_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return paragraphs.substring_duplicates(table(spark, folder, "documents"))


@query()
def op8_pattern_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pattern_packing.packed_documents(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("""
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
""")
def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return exact_dedup.exact_duplicates(docs, exact_dedup.older_half(docs))


@query(r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
    ),
    sets AS (SELECT doc_id, list_distinct(list_transform(range(greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i + 1 : i + 4], ' '))) AS grams FROM w WHERE len(w) > 0),
    members AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM sets),
    pairs AS (
        SELECT a.doc_id AS a, b.doc_id AS b FROM members a JOIN members b ON a.gram = b.gram AND a.doc_id < b.doc_id
        GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
    ),
    links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
    reached(doc_id, root) AS (
        SELECT doc_id, doc_id FROM documents
        UNION
        SELECT links.b, reached.root FROM reached JOIN links ON reached.doc_id = links.a WHERE reached.root < links.b
    ),
    least AS (SELECT doc_id, min(root) AS component_id FROM reached GROUP BY doc_id)
    SELECT d.doc_id, coalesce(len(grams), 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
    FROM documents d JOIN least ON least.doc_id = d.doc_id LEFT JOIN sets ON sets.doc_id = d.doc_id
""")
def op10_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, folder, "documents"))


def _leaf_sql(count: str) -> str:
    values = ["CAST(doc_id AS VARCHAR)", "source", "lang", f"CAST({count} AS VARCHAR)", "text"]
    return "sha256(concat(" + ", ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + "))"


# A level above is made by hashing two neighbours at a time; the nodes of all levels stay for the proofs.
@query(f"""
    WITH RECURSIVE {CRC_TABLE.strip()},
    rows AS (
        SELECT doc_id, lang, {_leaf_sql('n_chars')} AS leaf,
               CASE WHEN {crc_sql('CAST(doc_id AS VARCHAR)')} % 7 = 0 THEN {_leaf_sql('(n_chars + 1)')} ELSE {_leaf_sql('n_chars')} END AS claim,
               row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS place
        FROM documents, crc_table
    ),
    trees(lang, level, nodes) AS (
        SELECT lang, 0, list(leaf ORDER BY place) FROM rows GROUP BY lang
        UNION ALL
        SELECT lang, level + 1, list_transform(range((len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')))
        FROM trees WHERE len(nodes) > 1
    ),
    heads AS (SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM trees WHERE len(nodes) = 1),
    top(level, nodes) AS (
        SELECT 0, list(subroot ORDER BY place) FROM heads
        UNION ALL
        SELECT level + 1, list_transform(range((len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')))
        FROM top WHERE len(nodes) > 1
    ),
    levels AS (
        SELECT lang, list(nodes ORDER BY level) AS below FROM trees WHERE len(nodes) > 1 GROUP BY lang
    ),
    above AS (SELECT list(nodes ORDER BY level) AS over FROM top WHERE len(nodes) > 1),
    root AS (SELECT nodes[1] AS root FROM top WHERE len(nodes) = 1),
    paths AS (
        SELECT r.doc_id, leaf, claim, subroot, root,
               list_transform(coalesce(below, []), lambda l, i: {{'left': (r.place >> (i - 1)) % 2 = 1, 'node': coalesce(l[xor(r.place >> (i - 1), 1) + 1], '')}})
               || list_transform(coalesce(over, []), lambda l, i: {{'left': (h.place >> (i - 1)) % 2 = 1, 'node': coalesce(l[xor(h.place >> (i - 1), 1) + 1], '')}}) AS path
        FROM rows r JOIN heads h ON r.lang IS NOT DISTINCT FROM h.lang
        LEFT JOIN levels v ON r.lang IS NOT DISTINCT FROM v.lang CROSS JOIN above CROSS JOIN root
    ),
    done AS (
        SELECT *, list_reduce(list_prepend({{'left': false, 'node': claim}}, path),
            lambda a, b: {{'left': false, 'node': sha256(CASE WHEN b['left'] THEN b.node || a.node ELSE a.node || b.node END)}}).node AS folded_root
        FROM paths
    )
    SELECT doc_id, leaf, subroot, root, sha256(list_aggregate(list_transform(path, lambda s: s.node), 'string_agg', '')) AS proof_sha256,
           folded_root, folded_root = root AS verified
    FROM done
""")
def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.verified_proofs(table(spark, folder, "documents"), F.crc32(F.col("doc_id").cast("string")) % 7 == 0)


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query(f"""
    WITH docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
    windows AS (
        SELECT DISTINCT item, least(len(w), 10) AS n, unnest(list_transform(range(greatest(len(w) - 9, 1)), lambda i: array_to_string(w[i + 1 : i + 10], ' '))) AS words
        FROM items WHERE len(w) > 0
    ),
    places AS (
        SELECT doc_id, n, unnest(list_transform(range(len(w) - n + 1), lambda i: {{'spot': i, 'words': array_to_string(w[i + 1 : i + n], ' ')}})) AS p
        FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n
    ),
    hits AS (SELECT DISTINCT doc_id, p.spot AS spot, windows.n AS n, item FROM places JOIN windows ON p.words = windows.words),
    covered AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(spot, spot + n)) AS word FROM hits) GROUP BY doc_id),
    found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
    SELECT docs.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(list, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
    FROM docs LEFT JOIN covered ON docs.doc_id = covered.doc_id LEFT JOIN found ON docs.doc_id = found.doc_id
""")
def op12_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


# Near words share a text that is left when one letter of either, or none, is taken away at the same place.
@query(f"""
    WITH RECURSIVE {CRC_TABLE.strip()},
    runs AS (
        SELECT doc_id, run, count(*) AS n FROM (
            SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
            FROM documents
        ) WHERE length(run) >= 7 GROUP BY ALL
    ),
    hashed AS (SELECT run, n, {crc_sql("(doc_id || ':' || run)")} AS h FROM runs, crc_table),
    damaged AS (SELECT n, CASE WHEN h % 31 = 0 THEN run[: h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word FROM hashed),
    words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM damaged WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
    gaps AS (SELECT word, n, unnest(range(length(word))) AS spot FROM words),
    shorter AS (SELECT word, n, spot, word[: spot] || word[spot + 2 :] AS rest FROM gaps),
    near AS (
        SELECT a.word, b.word AS near, b.n AS near_n FROM shorter a JOIN shorter b ON a.rest = b.rest AND a.spot = b.spot AND a.word <> b.word
        UNION SELECT a.word, b.word, b.n FROM shorter a JOIN words b ON a.rest = b.word
        UNION SELECT b.word, a.word, a.n FROM shorter a JOIN words b ON a.rest = b.word
    ),
    best AS (SELECT word, count(*) AS n_near, max(near_n) AS near_n, arg_min(near, {{'n': -near_n, 'w': near}}) AS near FROM near GROUP BY word),
    forms AS (
        SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * n THEN near END AS form, CASE WHEN near_n >= 10 * n THEN near_n END AS form_n
        FROM words LEFT JOIN best ON words.word = best.word
    ),
    chains(word, root) AS (
        SELECT word, word FROM forms
        UNION
        SELECT chains.word, forms.form FROM chains JOIN forms ON chains.root = forms.word WHERE forms.form IS NOT NULL
    )
    SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n
    FROM forms f JOIN chains c ON f.word = c.word JOIN forms e ON c.root = e.word WHERE e.form IS NULL
""")
def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, folder, "documents"))
