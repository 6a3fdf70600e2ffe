"""One query per operator over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm import fill_middle, fingerprints, html_text, jaccard_trie, mixing, packing, quality, secrets, substrings, token_counts, url_model, warc, whitening

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _quality_sql() -> str:
    """The counts by list functions, the sketch by GROUP BY, the fences by windows."""

    def quart(name: str, source: str, by: str) -> str:
        keys = f"{by}, " if by else ""
        part = f"PARTITION BY {keys}measure"
        return f"""{name} AS (
  SELECT {keys}measure, any_value(docs) AS docs,
    min(CASE WHEN 4 * upto >= docs THEN low END) AS q1,
    min(CASE WHEN 4 * upto >= 3 * docs THEN low END) AS q3
  FROM (SELECT {keys}measure, bucket, low, sum(n) OVER ({part} ORDER BY bucket) AS upto,
          sum(n) OVER ({part}) AS docs
        FROM (SELECT {keys}measure, bucket, any_value(low) AS low, sum(n) AS n FROM {source}
              GROUP BY {keys}measure, bucket) AS m) AS r
  GROUP BY {keys}measure)"""

    values = ", ".join(
        f"('{m}', CAST(floor({parts} * {count} / n_words) AS BIGINT))"
        for m, (count, parts, _, _) in quality.MEASURES.items()
    )
    pick = "CASE WHEN a.docs >= {n} THEN a.{c} WHEN b.docs >= {n} THEN b.{c} ELSE c.{c} END AS {c}"
    margins = " ".join(f"WHEN '{m}' THEN {margin}" for m, (_, _, margin, _) in quality.MEASURES.items())
    two = ", ".join(f"'{m}'" for m, x in quality.MEASURES.items() if x[3])
    return rf"""
WITH d AS (SELECT *, row_number() OVER () AS row, {WORDS} AS w FROM documents),
grams AS (
  SELECT row, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT row, w, unnest(range(1, len(w) - 1)) AS i FROM d) AS x),
often AS (SELECT row, i, count(*) OVER (PARTITION BY row, g) AS times FROM grams),
covered AS (
  SELECT row, count(DISTINCT i + k) AS n FROM often, range(3) AS t(k) WHERE times > 1 GROUP BY row),
lines AS (SELECT row, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM d),
dups AS (
  SELECT row, count(*) - count(DISTINCT line) AS n FROM lines
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row),
counted AS (
  SELECT d.row, doc_id, lang, source, len(w) AS n_words,
    coalesce(CAST(list_sum(list_transform(w, lambda x: length(x))) AS BIGINT), 0) AS word_chars,
    len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS n_symbols,
    coalesce(dups.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM d LEFT JOIN dups ON dups.row = d.row LEFT JOIN covered ON covered.row = d.row),
based AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted),
vals AS (
  SELECT row, lang, source, v.measure, v.value, length(bin(v.value)) - 6 AS e
  FROM based, LATERAL (VALUES {values}) AS v(measure, value) WHERE NOT base_failed),
sketch AS (
  SELECT lang, source, measure,
    CASE WHEN value < 64 THEN value ELSE e * 32 + (value >> e) END AS bucket,
    CASE WHEN value < 64 THEN value ELSE (value >> e) << e END AS low, count(*) AS n
  FROM vals GROUP BY ALL),
{quart("qa", "sketch", "lang, source")},
{quart("qb", "sketch", "lang")},
{quart("qc", "sketch", "")},
picked AS (
  SELECT a.lang, a.source, a.measure, {pick.format(n=quality.MIN_DOCS, c="q1")},
    {pick.format(n=quality.MIN_DOCS, c="q3")}
  FROM qa AS a JOIN qb AS b ON a.lang IS NOT DISTINCT FROM b.lang AND a.measure = b.measure
    JOIN qc AS c ON a.measure = c.measure),
limits AS (
  SELECT *, greatest({quality.SPREAD} * (q3 - q1), CASE measure {margins} END) AS reach FROM picked),
bad AS (
  SELECT DISTINCT v.row FROM vals AS v JOIN limits AS l
    ON v.lang IS NOT DISTINCT FROM l.lang AND v.source IS NOT DISTINCT FROM l.source
    AND v.measure = l.measure
  WHERE v.value > q3 + reach OR (v.measure IN ({two}) AND v.value < q1 - reach))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND row NOT IN (SELECT row FROM bad) AS kept
FROM based"""


@query("op1_quality_rules", _quality_sql())
def quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality.judge(table(spark, sf, "documents"))


_JACCARD_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_transform({WORDS}, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0) AS x),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common
  FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT u, v FROM pairs JOIN n AS x ON x.doc_id = u JOIN n AS y ON y.doc_id = v
  WHERE 100 * common >= 90 * (x.n + y.n - common)),
reach(u, v) AS (
  SELECT doc_id, doc_id FROM d
  UNION
  SELECT reach.u, links.v FROM reach JOIN links ON links.u = reach.v)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reach.v) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN reach ON reach.u = d.doc_id GROUP BY d.doc_id"""


@query("op2_ngram_jaccard_join", _JACCARD_SQL)
def ngram_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_trie.jaccard_components(table(spark, sf, "documents"))


_REPEATS_SQL = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
win AS (
  SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d) AS x),
marked AS (SELECT doc_id, i, doc_id > min(doc_id) OVER (PARTITION BY h) AS hit FROM win),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM marked, range(50) AS t(k) WHERE hit),
words AS (SELECT doc_id, i, w[i] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) AS y),
kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n
  FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(kept.n, 0) AS n_removed,
  sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id"""


@query("op9_substring_dedup", _REPEATS_SQL)
def substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf, "documents"))


@query("op5_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"))


@query("op6_token_counts")
def token_limits(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.corpus_limits(table(spark, sf, "documents"))


@query("op3_secret_scans")
def secret_scans(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.scan(table(spark, sf, "documents")).drop("secrets")


_MIXING_SQL = f"""
WITH sizes AS (SELECT source, CAST(sum(length(coalesce(text, ''))) AS DOUBLE) AS size FROM documents GROUP BY source),
rates AS (
  SELECT source, round(sqrt(size) / (SELECT sum(sqrt(size)) FROM sizes)
    * (SELECT sum(size) FROM sizes) / size, 9) AS rate FROM sizes),
steps AS (
  SELECT source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c
  FROM (SELECT source, rate, unnest(range(CAST(ceil(rate + 12 * sqrt(rate) + 26) AS BIGINT))) AS k FROM rates) AS r),
drawn AS (
  SELECT doc_id, source,
    CAST(CAST('0x' || md5('{mixing.SEED}:' || doc_id || ':' || source)[1:13] AS BIGINT) AS DOUBLE) / 16::DOUBLE ** 13 AS u
  FROM documents),
counted AS (
  SELECT doc_id, d.source, (SELECT count(*) FROM steps AS s WHERE s.source = d.source AND s.c <= d.u) AS times
  FROM drawn AS d)
SELECT doc_id, source, CAST(copy AS INTEGER) AS copy, md5('order {mixing.SEED}:' || doc_id || ':' || copy) AS shuffle_key
FROM (SELECT doc_id, source, unnest(range(times)) AS copy FROM counted) AS x"""


@query("op10_mixing_to_weights", _MIXING_SQL)
def mixing_to_weights(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    rates = mixing.repetition_rates(docs)
    return mixing.replicate(docs.select("doc_id", "source"), rates)


URL_RULES = (
    url_model.Rule("org", "/", "allow"),
    url_model.Rule("example.org", "/es/", "block"),
    url_model.Rule("example.org", "/en/1", "block"),
    url_model.Rule("com", "/fr/", "allow"),
    url_model.Rule("com", "/de/", "block"),
)


@query("op4_url_filters")
def url_filters(spark: SparkSession, sf: str) -> DataFrame:
    return url_model.judge(table(spark, sf, "pages"), URL_RULES)


@query("op8_document_fingerprints")
def document_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf, "documents"))


@query("op7_html_extraction")
def html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return html_text.main_texts(table(spark, sf, "pages"))


_MIDDLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
    sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h
  FROM documents),
drawn AS (
  SELECT doc_id, t, u, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS x,
    CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS y,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
        OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 50 THEN 'plain'
      WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
cut AS (
  SELECT *, array_to_string(u[1:least(x, y)], '') AS p, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS m,
    array_to_string(u[greatest(x, y) + 1:n], '') AS s
  FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM cut"""


@query("op13_fill_in_middle", _MIDDLE_SQL)
def fill_in_middle(spark: SparkSession, sf: str) -> DataFrame:
    made = fill_middle.fill_in_middle(table(spark, sf, "documents"))
    return made.withColumns(
        {
            "output_sha256": F.sha2("output", 256),
            "restored_sha256": F.sha2(fill_middle.restore(F.col("form"), F.col("output")), 256),
        }
    ).drop("output")


@query("op11_embedding_whitening")
def embedding_whitening(spark: SparkSession, sf: str) -> DataFrame:
    """A deviation beyond 64 bits, which takes millions of vectors, is null here; the operator
    gives it as a decimal."""
    white = whitening.whiten(table(spark, sf, "embeddings"))
    return white.withColumn("deviation", F.col("deviation").try_cast("bigint"))


_WARC_SQL = """
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html,
    max(page_id) OVER (PARTITION BY coalesce(html, '')) AS owner,
    strftime(TIMESTAMP '2000-01-01' + to_seconds(greatest(coalesce(page_id, 0), 0)), '%Y%m%d%H%M%S') AS captured
  FROM pages),
k AS (
  SELECT *, sha1(html) AS h,
    CASE WHEN contains(url, '://') THEN array_to_string(list_reverse(string_split(
        translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '.')), ',')
      || ')' || regexp_extract(url, '://[^/?#]*([^#]*)', 1) ELSE url END AS urlkey
  FROM p)
SELECT page_id, strlen(html) AS payload_bytes,
  translate(array_to_string(list_transform(range(8), lambda i: to_base(CAST('0x' || h[5 * i + 1:5 * i + 5] AS BIGINT), 32, 4)), ''),
    '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
  CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> owner THEN owner END AS refers_to, urlkey, captured,
  row_number() OVER (ORDER BY urlkey, captured, page_id) AS position,
  row_number() OVER (PARTITION BY urlkey ORDER BY captured, page_id) AS capture
FROM k"""


@query("op12_warc_captures", _WARC_SQL)
def warc_captures(spark: SparkSession, sf: str) -> DataFrame:
    return warc.captures(table(spark, sf, "pages")).drop("file", "offset", "length")
