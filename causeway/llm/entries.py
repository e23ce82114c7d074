"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm import bpe, cotraining, decontam, lm, ngram_join, pii, quality, rollups, warc, wrapper
from causeway.runtime import scratch, table

#: The byte-level vocabulary: a file name among the public tokenizers, or a path.
TOKENIZER = "byte_bpe_50k.json"


def op4_cotraining_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, less those that labels call toxic."""
    gone = table(spark, sf_dir, "labels").where("toxic = 1")
    versions = {"words-1": None, "byte_bpe_50k-1": TOKENIZER}
    return rollups.maintained(table(spark, sf_dir, "documents"), gone, versions, rollups.Ledger(spark, scratch(spark, "ledger")))


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"), TOKENIZER).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op1_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract(table(spark, sf_dir, "pages"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents"), ngram_join.Similarity(4, 85, 100))


def op3_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.findings(table(spark, sf_dir, "documents"))


def op9_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("url")


def op10_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents")).drop("char_distance", "word_distance")


_DIGITS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(('0x' || substr(h, {10 * (k // 8) + 1}, 10))::BIGINT >> {35 - 5 * (k % 8)} & 31 AS INTEGER), 1)" for k in range(32))
OP9_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, {_DIGITS} AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (h)
"""


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP2_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOW}, '[\x09-\x0d ]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda k: array_to_string(w[k:k + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS node, a AS other FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.other)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.low, d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT node, min(other) AS low FROM r GROUP BY 1) c ON c.node = d.doc_id
"""

_WORDS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP3_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
i AS (SELECT item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda p: array_to_string(w[p:p + k - 1], ' '))) AS x FROM (SELECT *, least(13, len(w)) AS k FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM i),
t AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS p, unnest(list_transform(range(1, len(w) - k + 2), lambda p: array_to_string(w[p:p + k - 1], ' '))) AS x FROM d, sizes WHERE len(w) >= k),
m AS (SELECT DISTINCT doc_id, item_id, t.k, p FROM t JOIN i ON t.k = i.k AND t.x = i.x),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM m) GROUP BY 1),
f AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM m) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN f ON f.doc_id = d.doc_id
"""


def _classes() -> str:
    """Counts of each class of characters, as a list."""
    kinds = (" \\x09-\\x0D", "a-z", "A-Z", "0-9", ".,;:'\"?()\\-", "|<>{}\\[\\]", "!", "#$%&*+/=@\\\\^_`~\\x00-\\x08\\x0E-\\x1F\\x7F")
    counts = [f"length(regexp_replace(t, '[^{k}]', '', 'g'))".replace("'\"", "''\"") for k in kinds]
    return "[" + ", ".join([*counts, "length(regexp_replace(t, '[\\x00-\\x7F]', '', 'g'))"]) + "]"


def _divergence(share: str, of: str) -> str:
    """Jensen-Shannon distance from the bins that a text has: those that it lacks add their share of the reference."""
    return f"sqrt(greatest(0, (sum(CASE WHEN {share} > 0 THEN {share} * log2({share} / (({share} + {of}) / 2)) ELSE 0 END) + sum(CASE WHEN {share} > 0 AND {of} > 0 THEN {of} * log2({of} / (({share} + {of}) / 2)) ELSE 0 END) + 1 - sum(CASE WHEN {share} > 0 THEN {of} ELSE 0 END)) / 2))"


_COMMON = ", ".join(f"('{w.decode()}')" for w in quality.WORDS)
_RULES = quality.QualityRules()
OP8_SQL = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, CASE WHEN lang IN {quality.LANGS} THEN lang ELSE '*' END AS lang FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(t, '[ \x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \x09-\x0D]')) AS lines,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols FROM d),
g AS (SELECT r, unnest(range(1, len(w) - 6)) AS p, unnest(list_transform(range(1, len(w) - 6), lambda p: array_to_string(w[p:p + 7], ' '))) AS x FROM w WHERE len(w) >= 8),
again AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + 8)) AS q FROM g JOIN (SELECT r, x FROM g GROUP BY r, x HAVING count(*) > 1) USING (r, x)) GROUP BY r),
base AS (SELECT r, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM w LEFT JOIN again USING (r)),
c AS (SELECT r, lang, unnest(range(9)) AS k, unnest({_classes()}) AS n FROM d),
cr AS (SELECT lang, k, sum(n) AS n FROM (SELECT lang, k, n FROM c UNION ALL SELECT '*', k, n FROM c WHERE lang <> '*') GROUP BY ALL),
cs AS (SELECT r, lang, k, n / nullif(sum(n) OVER (PARTITION BY r), 0) AS p FROM c), crs AS (SELECT lang, k, n / sum(n) OVER (PARTITION BY lang) AS q FROM cr),
dc AS (SELECT r, {_divergence('p', 'q')} AS dc FROM cs JOIN crs USING (lang, k) WHERE p IS NOT NULL GROUP BY r),
common AS (SELECT * FROM (VALUES {_COMMON}) AS v(word)),
x AS (SELECT r, lang, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x60\x7B-\x7F]+')) AS x FROM d),
b AS (SELECT r, lang, coalesce(word, '#') AS k, count(*) AS n FROM x LEFT JOIN common ON word = x GROUP BY ALL),
br AS (SELECT lang, k, sum(n) AS n FROM (SELECT lang, k, n FROM b UNION ALL SELECT '*', k, n FROM b WHERE lang <> '*') GROUP BY ALL),
bs AS (SELECT r, lang, k, n / sum(n) OVER (PARTITION BY r) AS p FROM b), brs AS (SELECT lang, k, n / sum(n) OVER (PARTITION BY lang) AS q FROM br),
dw AS (SELECT r, {_divergence('p', 'q')} AS dw FROM bs JOIN brs USING (lang, k) GROUP BY r),
f AS (SELECT doc_id, base.* EXCLUDE (r), n_words < {_RULES.min_words} OR 100 * n_repeat_words > {_RULES.max_repeat_pct} * n_words AS base_failed, coalesce(dc, 0) AS dc, coalesce(dw, 0) AS dw, {_RULES.scatter} / sqrt(greatest(n_words, 1)) AS slack
  FROM d JOIN base USING (r) LEFT JOIN dc USING (r) LEFT JOIN dw USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_words >= {_RULES.guard_words} AND (dc > {_RULES.max_char_distance} + slack / 4 OR dw > {_RULES.max_word_distance} + slack)) AS kept FROM f
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_wrapper_induction": op1_wrapper_induction,
        "op2_ngram_jaccard": op2_ngram_jaccard,
        "op3_suffix_decontamination": op3_suffix_decontamination,
        "op4_cotraining_quality": op4_cotraining_quality,
        "op7_token_rollups": op7_token_rollups,
        "op5_bpe_codec": op5_bpe_codec,
        "op6_pii_boosting": op6_pii_boosting,
        "op8_quality_rules": op8_quality_rules,
        "op9_warc_transactions": op9_warc_transactions,
        "op10_log_bilinear": op10_log_bilinear,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_ngram_jaccard": OP2_SQL,
        "op3_suffix_decontamination": OP3_SQL,
        "op8_quality_rules": OP8_SQL,
        "op9_warc_transactions": OP9_SQL,
    }
