"""The operators of this package applied to the given tables, and the pipeline over ``documents``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import (
    embedding_dedup,
    html_extraction,
    importance_resampling,
    language_id,
    lexical_search,
    line_dedup,
    mixing,
    packing,
    secret_scan,
    simhash_dedup,
    site_quality,
    toxicity,
    vector_search,
)
from lamina.session import durable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def remainder(divisor: int) -> Column:
    """CRC-32 of the id as text, modulo ``divisor``; no id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % divisor


@query
def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extraction.extract_pages(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    net = toxicity.fit_toxicity(docs, read(spark, sf_dir, "labels"), remainder(3) != 1)
    scored = toxicity.score_toxicity(docs, net).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", (remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), tokenizer_path(), added=True)


@query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.simhash_groups(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        F.col("component").alias("component_id"))


@query
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(read(spark, sf_dir, "documents"))
    def listed(parts):
        return F.array_join(F.transform(parts, lambda p: F.concat_ws(":", p["kind"], p["start"], p["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("parts", lambda p: p["base"] & (p["kind"] == kind))).cast("long").alias(f"n_{kind}")

    base = F.filter("parts", lambda p: p["base"])
    counts = [count(kind) for kind in secret_scan.LEAST]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(listed(base), 256).alias("base_sha256"),
                        listed(F.col("parts")).alias("spans"))


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    field = language_id.fit_languages(docs, remainder(4) != 2)
    found = language_id.identify_languages(docs, field).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score")


@query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mix of as many tokens as the corpus has, as even as can be with no source read more than 1.25 times."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", mixing.token_estimate(F.col("text")).alias("tokens"))
    return mixing.mix(docs, tokens=F.col("tokens"), max_repeats=1.25)


ORACLES["op7_mixing"] = """
WITH RECURSIVE t AS (
  SELECT doc_id, source, greatest(1, CAST(ceil(coalesce(length(text), 0) / 4.0) AS BIGINT)) AS tokens,
    ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT AS bh,
    ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 9, 15))::BIGINT AS oh
  FROM documents),
total AS (SELECT CAST(sum(tokens) AS BIGINT) AS n FROM t),
s AS (SELECT source, CAST(sum(tokens) AS BIGINT) AS tokens, sum(tokens)::DOUBLE / (SELECT n FROM total)::DOUBLE AS p FROM t GROUP BY source),
halve AS (
  SELECT 0 AS lo, 1000000 AS hi
  UNION ALL
  SELECT CASE WHEN held THEN lo ELSE mid + 1 END, CASE WHEN held THEN mid ELSE hi END FROM (
    SELECT lo, hi, (lo + hi) // 2 AS mid,
      (SELECT max(pow(p, ((lo + hi) // 2) / 1000000.0::DOUBLE) / p) / sum(pow(p, ((lo + hi) // 2) / 1000000.0::DOUBLE)) FROM s) <= 1.25 AS held
    FROM halve WHERE lo < hi)),
chosen AS (SELECT max(lo) / 1000000.0::DOUBLE AS a FROM halve WHERE lo = hi),
w AS (SELECT source, tokens, a, pow(p, a) AS w, sum(pow(p, a)) OVER () AS all_w FROM s, chosen),
want AS (
  SELECT *, CAST(round(w / all_w * 1000000000.0::DOUBLE) AS BIGINT) AS weight, CAST(round(w * ((SELECT n FROM total) / all_w)) AS BIGINT) AS wanted,
    least(4096, CAST(ceil(tokens / 1000000.0) AS BIGINT)) AS blocks FROM w),
plan AS (SELECT *, wanted // tokens AS epochs, wanted % tokens AS spare FROM want),
rows_ AS (SELECT t.*, plan.weight, plan.a, epochs, spare, blocks, bh % blocks AS block FROM t JOIN plan ON t.source IS NOT DISTINCT FROM plan.source),
placed AS (
  SELECT *, (block * (list_extract([1000003, 15485863, 32452843, 49979687, 67867967, 86028121, 104395301, 122949823], CAST(epochs % 8 + 1 AS INT)) % blocks)
    + epochs * 7919 + 1) % blocks AS last_place FROM rows_),
-- Places first, then order hashes: one running sum per source decides what the last epoch takes.
ends AS (
  SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY last_place, oh RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM placed),
-- From the first that exceeds the budget on, nothing of the source is taken.
times AS (SELECT *, epochs + CASE WHEN upto <= spare THEN 1 ELSE 0 END AS n FROM ends)
SELECT doc_id, source, tokens, e AS mix_epoch,
  (block * (list_extract([1000003, 15485863, 32452843, 49979687, 67867967, 86028121, 104395301, 122949823], CAST(e % 8 + 1 AS INT)) % blocks) + e * 7919 + 1) % blocks AS mix_place,
  oh AS mix_order, weight AS mix_weight, a AS mix_exponent
FROM times, LATERAL (SELECT unnest(range(n)) AS e)
"""


@query
def op8_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the site of the page that shows them: its host and first path segment. A document
    that no page shows belongs to its source, by language."""
    docs = read(spark, sf_dir, "documents")
    url = F.col("url")
    pages = read(spark, sf_dir, "pages").select(
        F.regexp_extract(url, r"/(\d{1,18})(?:\.html?)?/?(?:[?#].*)?$", 1).alias("_number"),
        F.struct(F.regexp_extract(url, r"^[a-z]+://([^/?#]+)", 1).alias("host"), F.regexp_extract(url, r"^[a-z]+://[^/?#]+/([^/?#]*)", 1).alias("path")).alias("_site"))
    sites = pages.where(F.col("_number") != "").groupBy(F.col("_number").cast("long").alias("_shown")).agg(F.min("_site").alias("_site"))
    classifier, prior = site_quality.fit_classifier(docs, read(spark, sf_dir, "labels"), remainder(3) != 1)
    # The texts are read before the join and stay behind: only the evidence is shuffled.
    evidence = site_quality.text_evidence(docs, classifier, "doc_id", "text", ["source", "lang"])
    sited = evidence.join(sites, F.col("id") == F.col("_shown"), "left").select(
        "id", "evidence", F.coalesce("_site.host", "source").alias("host"), F.coalesce("_site.path", "lang").alias("path"))
    found = site_quality.score_sites(durable(sited), prior)
    return found.select(F.col("id").alias("doc_id"), "host", "path", "evidence", "host_rate", "path_rate", "score", (F.col("score") >= 0.5).alias("kept"))


@query
def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embedding_dedup.embedding_groups(read(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"),
                        F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))


ORACLES["op9_embedding_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b
  ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (
  SELECT vec_id AS node, vec_id AS other FROM embeddings
  UNION
  SELECT reach.node, links.b FROM reach JOIN links ON reach.other = links.a),
least_ AS (SELECT node, min(other) AS component FROM reach GROUP BY node),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component AS component_id, vec_id = component AS kept
FROM embeddings JOIN least_ ON vec_id = node LEFT JOIN counted ON vec_id = a
"""


@query
def op10_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query
def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents of 20 words and more, drawn by how much they look like the benchmark."""
    found = importance_resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))


# A CRC-32 of the bytes of each different word, by a table of remainders.
ORACLES["op11_resampling"] = r"""
WITH folded AS (
  SELECT doc_id AS id, true AS is_doc, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
  UNION ALL
  SELECT item_id, false, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
each AS (SELECT id, is_doc, unnest(words) AS word FROM folded),
remainders AS (
  SELECT list(r ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda r, step: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END) AS r
    FROM range(256) AS t(i))),
spelled AS (
  SELECT word, list_transform(range(strlen(word)::BIGINT), lambda p: ('0x' || substr(hex(encode(word)), 2 * p + 1, 2))::BIGINT) AS bytes
  FROM (SELECT DISTINCT word FROM each)),
buckets AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM spelled, remainders),
counts AS (SELECT bucket, count(*) FILTER (is_doc) AS s, count(*) FILTER (NOT is_doc) AS t FROM each JOIN buckets USING (word) GROUP BY bucket),
sums AS (SELECT sum(s)::DOUBLE AS all_s, sum(t)::DOUBLE AS all_t FROM counts),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (all_s + 10000) / ((s + 1)::DOUBLE * (all_t + 10000))))::BIGINT AS gain FROM counts, sums),
weights AS (
  SELECT id, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
  FROM each JOIN buckets USING (word) JOIN gains USING (bucket) WHERE is_doc GROUP BY id),
scored AS (
  SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM documents LEFT JOIN weights ON doc_id = id),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT scored.*, CASE WHEN place <= 10 * n // 100 THEN place END::BIGINT AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""


@query
def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item, over all documents."""
    return lexical_search.ranked_search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


ORACLES["op12_lexical"] = r"""
WITH d AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
lengths AS (SELECT doc_id, count(*)::BIGINT AS n FROM d GROUP BY doc_id),
whole AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS every FROM lengths),
tf AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM d WHERE term IN (SELECT term FROM i) GROUP BY doc_id, term),
w AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, whole GROUP BY term, docs),
impacts AS (
  SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // every)) AS impact FROM tf JOIN lengths USING (doc_id), whole),
scores AS (SELECT item_id, doc_id, sum(w * impact)::BIGINT AS score FROM i JOIN w USING (term) JOIN impacts USING (term) GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 10
"""


@query
def op13_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines of ten code points and more that an earlier document has."""
    found = line_dedup.drop_shared_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLES["op13_lines"] = """
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, nth, lines[nth] AS line FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS nth FROM cut)),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
shared AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT k.*, first IS NOT NULL AND first <> doc_id AS goes FROM k LEFT JOIN shared USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (goes) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY nth) FILTER (NOT goes), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
