"""One registered query for each operator, over whole tables, and its SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sumwise.llm.common import table
from sumwise.llm.decontaminate import benchmark_passages
from sumwise.llm.divergence import source_divergence
from sumwise.llm.exact_copies import exact_copies
from sumwise.llm.fingerprints import edited_fingerprints
from sumwise.llm.html_text import main_texts
from sumwise.llm.license_scan import license_paragraphs
from sumwise.llm.near_duplicates import near_duplicates
from sumwise.llm.packing import packed
from sumwise.llm.token_counts import token_counts
from sumwise.llm.warc import archive_digests
from sumwise.llm.toxicity import toxicity
from sumwise.llm.url_filter import SOFT, STRICT, Rule, url_verdicts
from sumwise.llm.vector_codes import vector_codes

RULES = [
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
]


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed(table(spark, folder, "documents"))


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


def op5_benchmark_passages(spark: SparkSession, folder: str) -> DataFrame:
    return benchmark_passages(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op6_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_paragraphs(table(spark, folder, "documents"))


def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    return archive_digests(table(spark, folder, "pages"))


def op8_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return edited_fingerprints(table(spark, folder, "documents"))


def op9_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_verdicts(table(spark, folder, "pages"), RULES)


def op10_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return main_texts(table(spark, folder, "pages"))


def op11_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return source_divergence(table(spark, folder, "documents"))


def op12_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes(table(spark, folder, "embeddings"))


def op13_exact_copies(spark: SparkSession, folder: str) -> DataFrame:
    return exact_copies(table(spark, folder, "documents"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_packing": op2_packing,
    "op3_token_counts": op3_token_counts,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_benchmark_passages": op5_benchmark_passages,
    "op6_license_scan": op6_license_scan,
    "op7_warc": op7_warc,
    "op8_fingerprints": op8_fingerprints,
    "op9_url_filter": op9_url_filter,
    "op10_html_text": op10_html_text,
    "op11_divergence": op11_divergence,
    "op12_vector_codes": op12_vector_codes,
    "op13_exact_copies": op13_exact_copies,
}


def _url_filter_sql() -> str:
    def hits(terms):
        found = [f"regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)', 's')::INT" for t in terms]
        return f"coalesce({' + '.join(found)}, 0)"

    return f"""
    WITH parts AS (
      SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest,
        translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
      FROM pages
    ), named AS (
      SELECT page_id, low,
        translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
      FROM parts
    ), judged AS (
      SELECT *, CASE
          WHEN '.' || host LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
          WHEN '.' || host LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
          WHEN '.' || host LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
          WHEN '.' || host LIKE '%.net' AND path LIKE '/%' THEN 'net/'
        END AS rule, {hits(STRICT)} AS strict_hits, {hits(SOFT)} AS soft_hits
      FROM named
    )
    SELECT page_id, host, path, rule, strict_hits, soft_hits,
      CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
        WHEN rule IS NOT NULL THEN 'allow'
        WHEN strict_hits > 0 OR soft_hits >= 2 THEN 'block' ELSE 'allow' END AS verdict
    FROM judged"""


#: Exact: all pairs that share a shingle, then the smallest id that links reach.
_NEAR_DUPLICATES_SQL = r"""
    WITH RECURSIVE words AS (
      SELECT doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
        lambda w: w <> '') AS w
      FROM documents
    ), sets AS (
      SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
      FROM words
    ), items AS (
      SELECT doc_id, len(s) AS n, unnest(s) AS item FROM sets
    ), links AS (
      SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.item = b.item AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
    ), reach AS (
      SELECT doc_id, doc_id AS other FROM sets UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
    )
    SELECT s.doc_id, len(s.s) AS n_shingles, min(r.other) AS component_id, s.doc_id = min(r.other) AS kept
    FROM sets s JOIN reach r USING (doc_id) GROUP BY s.doc_id, s.s"""


#: Base32 by fives of hexadecimal digits: 20 bits are four characters.
_WARC_SQL = """
    WITH hashed AS (
      SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
    ), coded AS (
      SELECT page_id, payload_bytes, hex, array_to_string(list_transform(range(8), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0x' || substr(hex, 1 + 5 * i, 5))::BIGINT >> 15)::INT, 1) ||
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 5 * i, 5))::BIGINT >> 10) & 31)::INT, 1) ||
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 5 * i, 5))::BIGINT >> 5) & 31)::INT, 1) ||
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0x' || substr(hex, 1 + 5 * i, 5))::BIGINT & 31)::INT, 1)), '')
        AS payload_digest, max(page_id) OVER (PARTITION BY hex) AS top
      FROM hashed
    )
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN page_id <> top THEN top END AS refers_to
    FROM coded"""


_DIVERGENCE_SQL = r"""
    WITH d AS (
      SELECT row_number() OVER () AS nr, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
      FROM documents
    ), found AS (
      SELECT nr, lang, source, unnest(regexp_extract_all(low, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
    ), kept AS (
      SELECT lang, term, count(*) AS n FROM found GROUP BY lang, term HAVING count(DISTINCT nr) >= 10
    ), counts AS (
      SELECT f.lang, f.source, f.term, count(*) AS n FROM found f JOIN kept k ON f.lang = k.lang AND f.term = k.term GROUP BY ALL
    ), sources AS (
      SELECT DISTINCT lang, source FROM d
    ), langs AS (
      SELECT l.lang, count(k.term) AS v, coalesce(sum(k.n), 0)::HUGEINT AS n
      FROM (SELECT DISTINCT lang FROM d) l LEFT JOIN kept k ON l.lang = k.lang GROUP BY l.lang
    ), totals AS (
      SELECT s.lang, s.source, coalesce(sum(c.n), 0)::HUGEINT AS n
      FROM sources s LEFT JOIN counts c ON s.lang = c.lang AND s.source = c.source GROUP BY s.lang, s.source
    ), p AS (
      SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n,
        1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (t.n + 2 * l.v) AS p, 1 + 1000000000::HUGEINT * (k.n + 2) // (l.n + 2 * l.v) AS q
      FROM totals t JOIN langs l ON t.lang = l.lang JOIN kept k ON t.lang = k.lang
        LEFT JOIN counts c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term
    ), pairs AS (
      SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
    ), parts AS (
      SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
      FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
      UNION ALL
      SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q
    )
    SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
    FROM parts QUALIFY part = 'pair' OR rank <= 10"""


def _assigned(books: str) -> str:
    return f"""
      SELECT vec_id, part, arg_min(entry, (apart, entry)) AS entry, min(apart) AS apart FROM (
        SELECT c.vec_id, c.part, b.entry, sum((c.x - b.x) * (c.x - b.x))::BIGINT AS apart
        FROM cells c JOIN {books} b ON c.part = b.part AND c.place = b.place GROUP BY ALL
      ) GROUP BY vec_id, part"""


def _moved(books: str, assigned: str) -> str:
    return f"""
      SELECT b.part, b.entry, b.place, coalesce(s.x, b.x) AS x FROM {books} b LEFT JOIN (
        SELECT a.part, a.entry, c.place, floor(sum(c.x)::DOUBLE / count(*))::BIGINT AS x
        FROM {assigned} a JOIN cells c ON a.vec_id = c.vec_id AND a.part = c.part GROUP BY ALL
      ) s ON b.part = s.part AND b.entry = s.entry AND b.place = s.place"""


_VECTOR_CODES_SQL = f"""
    WITH kept AS (
      SELECT vec_id, label, embedding, len(embedding) // 16 AS width, row_number() OVER (ORDER BY vec_id) - 1 AS nr FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), spread AS (
      SELECT vec_id, nr, width, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM kept
    ), cells AS MATERIALIZED (
      SELECT vec_id, nr, pos // width AS part, pos % width AS place, floor(256 * x)::BIGINT AS x FROM spread
    ), books0 AS MATERIALIZED (SELECT part, nr AS entry, place, x FROM cells WHERE nr < 64),
    first AS MATERIALIZED ({_assigned("books0")}), books1 AS MATERIALIZED ({_moved("books0", "first")}),
    second AS MATERIALIZED ({_assigned("books1")}), books2 AS MATERIALIZED ({_moved("books1", "second")}),
    last AS MATERIALIZED ({_assigned("books2")}), codes AS (
      SELECT vec_id, string_agg(lpad(printf('%x', entry), 2, '0'), '' ORDER BY part) AS code, sum(apart)::BIGINT AS error FROM last GROUP BY vec_id
    )
    SELECT c.vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
      (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, place)) FROM books2) AS codebooks_sha256
    FROM codes c JOIN kept k ON c.vec_id = k.vec_id"""


_EXACT_COPIES_SQL = """
    WITH hashed AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
      sha256(text) AS text_sha256
    FROM hashed WINDOW same AS (PARTITION BY text)"""


SQL = {
    "op11_divergence": _DIVERGENCE_SQL,
    "op12_vector_codes": _VECTOR_CODES_SQL,
    "op13_exact_copies": _EXACT_COPIES_SQL,
    "op7_warc": _WARC_SQL,
    "op4_near_duplicates": _NEAR_DUPLICATES_SQL,
    "op9_url_filter": _url_filter_sql(),
}
