"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeflow.llm.divergence import source_divergence
from noticeflow.llm.exact_dedup import exact_dedup
from noticeflow.llm.fingerprints import fingerprint_edits
from noticeflow.llm.license_scan import TEMPLATES, anchors, license_scan, template_bigrams
from noticeflow.llm.merkle import as_text, fold, merkle_manifest, proof_digest, row_digest
from noticeflow.llm.near_dedup import near_dedup
from noticeflow.llm.packing import pack_documents
from noticeflow.llm.piece_bpe import encode_pieces
from noticeflow.llm.pitman_yor import language_scores
from noticeflow.llm.quality import fit_quality, score_quality
from noticeflow.llm.shared import Scratch
from noticeflow.llm.token_orc import span_checksums, token_spans, write_token_orc
from noticeflow.llm.tokens import vocabulary
from noticeflow.llm.url_filter import judge_urls
from noticeflow.llm.warc import round_trip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode_pieces(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), ids=False)
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op6_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"), least=0)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op8_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0, capacity=2048).drop("ids")


def op9_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Scratch(spark, "token-orc").path("files")
    write_token_orc(table(spark, sf_dir, "documents"), folder, vocabulary("word_bpe_49k.json"), end_id=1)
    return span_checksums(token_spans(spark, folder))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(touched, row_digest(*columns[:-1], lowered))
    found = merkle_manifest(table(spark, sf_dir, "documents"), columns, carry={"tampered": tampered})
    found = found.withColumn("folded", fold(F.coalesce("tampered", "node"), F.col("path")))
    return found.select(
        "doc_id", as_text(F.col("node")).alias("leaf"), as_text(F.col("subroot")).alias("subroot"), as_text(F.col("root")).alias("root"), proof_digest(F.col("path")).alias("proof_sha256"),
        as_text(F.col("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )


def op12_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


#: Canonical links and refreshes are reached with the same patterns in RE2.
OP1_SQL = r"""
WITH RECURSIVE tags AS (
  SELECT url, unnest(list_concat(
      list_filter(regexp_extract_all(html, '(?i)<link\b[^>]*>'), lambda t: regexp_matches(t, '(?i)\brel\s*=\s*["'']?canonical\b')),
      list_filter(regexp_extract_all(html, '(?i)<meta\b[^>]*>'), lambda t: regexp_matches(t, '(?i)\bhttp-equiv\s*=\s*["'']?refresh\b')))) AS tag
  FROM pages WHERE url IS NOT NULL
), raws AS (
  SELECT url, replace(CASE WHEN regexp_matches(tag, '(?i)<meta\b') THEN regexp_extract(tag, '(?i)\burl\s*=\s*[''"]?([^"''>\s]+)', 1)
              ELSE regexp_extract(tag, '(?i)\bhref\s*=\s*["'']?([^"''>\s]+)', 1) END, '&amp;', '&') AS raw
  FROM tags
), targets AS (
  SELECT url, CASE WHEN contains(raw, '://') THEN raw
                   WHEN raw LIKE '//%' THEN regexp_extract(url, '(?s)^(.*?)://', 1) || ':' || raw
                   WHEN raw LIKE '/%' THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || raw
                   ELSE regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) ||
                        coalesce(nullif(regexp_replace(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '[^/]*$', ''), ''), '/') || raw END AS target
  FROM raws WHERE raw <> ''
), all_urls AS (
  SELECT DISTINCT u FROM (SELECT url AS u FROM pages UNION ALL SELECT target FROM targets)
), parts AS (
  SELECT u, lower_ascii AS host, path, lower_ascii || path || rest AS address FROM (
    SELECT u, translate(coalesce(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii,
           coalesce(regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
           coalesce(regexp_extract(u, '(?s)^.*?://[^/?#]*[^?#]*(\??[^#]*)', 1), '') AS rest
    FROM all_urls)
), rules(verdict, h, p) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), fits AS (
  SELECT u, max_by(h || p, length(h || p)) AS rule, max_by(verdict, length(h || p)) AS verdict
  FROM parts JOIN rules ON (host = h OR host LIKE '%.' || h) AND starts_with(path, p) GROUP BY u
), edges AS (
  SELECT DISTINCT a.address AS a, b.address AS b FROM targets t JOIN parts a ON a.u = t.url JOIN parts b ON b.u = t.target WHERE a.address <> '' AND b.address <> ''
), both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
tainted AS (
  SELECT DISTINCT r.a FROM reach r JOIN parts p ON p.address = r.b JOIN fits f ON f.u = p.u WHERE f.verdict = 'block'
)
SELECT page_id, coalesce(p.host, '') AS host, coalesce(p.path, '') AS path, f.rule AS rule,
       coalesce(f.verdict, CASE WHEN t.a IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM pages LEFT JOIN parts p ON p.u = pages.url LEFT JOIN fits f ON f.u = pages.url LEFT JOIN tainted t ON t.a = p.address
"""


def _op2_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ",\n    ".join(
        f"({i}, {quote(name)}, [{', '.join(map(quote, template_bigrams(text)))}])" for i, (name, text) in enumerate(TEMPLATES)
    )
    laid = ",\n    ".join(f"({quote(g)}, {at}, {n})" for g, places in anchors(TEMPLATES, 0.8).items() for at, n in places)
    return rf"""
WITH templates(t, license_id, grams) AS (VALUES
    {rows}
), laid(gram, place, n) AS (VALUES
    {laid}
), texts AS (SELECT row_number() OVER () AS d, doc_id, coalesce(text, '') AS text FROM documents),
raw AS (
  SELECT doc_id, unnest(flatten([string_split(text, chr(10)), regexp_split_to_array(text, '\n[^A-Za-z0-9\n]*\n'), regexp_split_to_array(text, '[.!?]\s+'), [text]])) AS unit,
         unnest(list_concat(list_transform(flatten([string_split(text, chr(10)), regexp_split_to_array(text, '\n[^A-Za-z0-9\n]*\n'), regexp_split_to_array(text, '[.!?]\s+')]), lambda u: NULL::BIGINT), [d])) AS d FROM texts
), words AS (
  SELECT doc_id, d, string_split(trim(regexp_replace(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM raw
), whole AS (SELECT * FROM words WHERE d IS NOT NULL),
starts AS (
  SELECT DISTINCT d, i - 1 - place AS s, n FROM (SELECT d, w[i] || ' ' || w[i + 1] AS gram, i FROM whole, range(1, len(w)) r(i)) JOIN laid USING (gram)
), units AS (
  SELECT DISTINCT doc_id, w FROM (
    SELECT doc_id, w FROM words WHERE d IS NULL UNION ALL SELECT doc_id, list_slice(w, greatest(s, 0) + 1, s + n) FROM starts JOIN whole USING (d)) WHERE len(w) >= 2
), grams AS (
  SELECT doc_id, w, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM units
), scored AS (
  SELECT doc_id, w, license_id, 2.0 * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS dice
  FROM grams JOIN templates ON len(g) BETWEEN len(grams) / 1.5 - 1 AND len(grams) * 1.5 + 1
)
SELECT doc_id, license_id, max(dice)::DOUBLE AS dice, count(DISTINCT w) AS units FROM scored WHERE dice >= 0.8 GROUP BY ALL
"""


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), r AS (
  SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS place,
         count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id
  FROM d
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM r
"""


#: crc32 is worked out byte by byte: DuckDB has none.
OP11_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) AS c FROM range(256) r(i))
), rows_ AS (
  SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS g,
         [doc_id::VARCHAR, source, lang, n_chars::VARCHAR] AS head, text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered,
         xor(4294967295, list_reduce(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda k: ascii(substr(doc_id::VARCHAR, k, 1))::BIGINT),
             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295)) % 3 = 0 AS touched
  FROM documents, crc_table
), texts AS (
  SELECT *, list_transform(head || [text], lambda v: CASE WHEN v IS NULL THEN '-' ELSE strlen(v) || ':' || v END) AS values_,
         list_transform(head || [lowered], lambda v: CASE WHEN v IS NULL THEN '-' ELSE strlen(v) || ':' || v END) AS touched_values FROM rows_
), leaves AS (
  SELECT doc_id, g, leaf, start, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n FROM (
    SELECT doc_id, g, sha256(array_to_string(values_, '')) AS leaf, CASE WHEN touched THEN sha256(array_to_string(touched_values, '')) ELSE sha256(array_to_string(values_, '')) END AS start FROM texts)
), low(level, g, idx, n, node) AS (
  SELECT 0, g, idx, n, leaf FROM leaves
  UNION ALL
  SELECT level + 1, g, idx // 8, (any_value(n) + 7) // 8, sha256(string_agg(node, '' ORDER BY idx)) FROM low WHERE n > 1 GROUP BY level, g, idx // 8
), subroots AS (SELECT g, node AS subroot FROM low WHERE n = 1),
high(level, g, idx, n, node) AS (
  SELECT 1000, '', row_number() OVER (ORDER BY g) - 1, count(*) OVER (), subroot FROM subroots
  UNION ALL
  SELECT level + 1, g, idx // 8, (any_value(n) + 7) // 8, sha256(string_agg(node, '' ORDER BY idx)) FROM high WHERE n > 1 GROUP BY level, g, idx // 8
), places AS (SELECT g, row_number() OVER (ORDER BY g) - 1 AS place FROM subroots),
nodes AS (
  SELECT *, coalesce(string_agg(node, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before_,
         coalesce(string_agg(node, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after_
  FROM (SELECT * FROM low WHERE n > 1 UNION ALL SELECT * FROM high WHERE n > 1) WINDOW run AS (PARTITION BY level, g, idx // 8 ORDER BY idx)
), steps AS (
  SELECT l.doc_id, l.g AS home, l.idx AS leaf_idx, l.leaf, l.start, list((before_, after_) ORDER BY level) FILTER (WHERE level IS NOT NULL) AS path
  FROM leaves l JOIN places p USING (g) LEFT JOIN nodes s ON (s.level < 1000 AND s.g = l.g AND s.idx = l.idx // (8 ** s.level)::BIGINT) OR (s.level >= 1000 AND s.idx = p.place // (8 ** (s.level - 1000))::BIGINT)
  GROUP BY ALL
), folded AS (
  SELECT *, coalesce(list_reduce(path, lambda h, s: (sha256(s[1] || h[1] || s[2]), ''), (start, ''))[1], start) AS folded_root,
         sha256(coalesce(array_to_string(list_transform(path, lambda s: s[1] || s[2]), ''), '')) AS proof_sha256 FROM steps
)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM folded JOIN subroots ON g = home CROSS JOIN (SELECT node AS root FROM high WHERE n = 1)
"""

#: HUGEINT keeps all products exact.
OP13_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), words AS (
  SELECT d, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (SELECT lang, term, count(*) AS total FROM words GROUP BY ALL HAVING count(DISTINCT d) >= 3),
counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, count(*) AS v, sum(total) AS lang_n FROM kept GROUP BY lang),
groups AS (
  SELECT lang, source, coalesce(v, 0) AS v, coalesce(lang_n, 0) AS lang_n, coalesce(big_n, 0) AS big_n
  FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN langs USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS big_n FROM counts GROUP BY ALL) USING (lang, source)
), shares AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(n, 0) + 1) // (big_n + v)::HUGEINT AS p,
         1 + 1000000000::HUGEINT * (total + 1) // (lang_n + v)::HUGEINT AS q
  FROM groups JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)
), pairs AS (
  SELECT lang, source, 'pair' AS part, item, coalesce(value, 0) AS value FROM (
    SELECT a.lang, a.source, b.source AS item FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  ) LEFT JOIN (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  ) USING (lang, source, item)
), terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
) WHERE part = 'pair' OR rank <= 200
"""


def queries() -> dict:
    return {
        "op1_url_filter": op1_url_filter,
        "op2_license_scan": op2_license_scan,
        "op3_minhash_near_dedup": op3_minhash_near_dedup,
        "op4_sentencepiece": op4_sentencepiece,
        "op5_winnowing": op5_winnowing,
        "op6_warc_chunks": op6_warc_chunks,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_pattern_packing": op8_pattern_packing,
        "op9_token_orc": op9_token_orc,
        "op10_quality_classifier": op10_quality_classifier,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_pitman_yor": op12_pitman_yor,
        "op13_source_divergence": op13_source_divergence,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": OP1_SQL, "op2_license_scan": _op2_sql(), "op7_exact_dedup": OP7_SQL, "op11_merkle_manifest": OP11_SQL, "op13_source_divergence": OP13_SQL}
