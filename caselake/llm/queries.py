"""The registered queries of this subpackage; each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, lines, media, mixing, neighbours, packing, phrases, pieces, ranking, setjoin, suffixes, tokens, toxicity
from .common import table

WORD_BPE, PIECE_BPE = "word_bpe_49k.json", "piece_bpe_32k.model"

#: Of five parts of the documents by a checksum of the id, this one is held out from learning.
HELD_OUT = "coalesce(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, true)"


def op1_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op 1 over every document."""
    got = suffixes.repeated_spans(table(spark, sf_dir, "documents"))
    return got.select(F.col("_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four best segmentations of every whole document with their ids, and whether the best one decodes to it again."""
    return pieces.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_BPE)).drop("ids")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op 3 over every document."""
    return setjoin.jaccard_components(table(spark, sf_dir, "documents")).withColumnRenamed("_id", "doc_id")


OP3_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS s FROM words
), posted AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM posted a JOIN posted b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (SELECT doc_id AS node, doc_id AS root FROM sets UNION SELECT l.b, r.root FROM reach r JOIN links l ON r.node = l.a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, (SELECT min(root) FROM reach WHERE node = doc_id) AS component_id FROM sets
"""


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op 4 over every document: stored as deflated TIFF strips with a horizontal predictor, and read back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("payload"))
    stored = media.to_tiff(docs.select("doc_id", F.octet_length("payload").cast("long").alias("n_bytes"), "payload"), "payload")
    named = stored.select("doc_id", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    return media.digests(media.pages(named))


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its text rid of lines like an earlier line."""
    return lines.drop_similar_lines(table(spark, sf_dir, "documents")).select("doc_id", "text")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op 6 over every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", F.expr(HELD_OUT))
    parts, bias = toxicity.fit(table(spark, sf_dir, "labels").where(f"not {HELD_OUT}"), docs)
    return toxicity.score(docs, parts, bias).select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op 7 over every document."""
    rows = packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))
    return packing.pack(rows)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op 8 over every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", F.expr(HELD_OUT))
    known = language.vocabulary(public_tokenizers.path(PIECE_BPE))
    langs, p = language.fit(docs.where("not held_out"), known)
    return language.predict(docs.drop("lang"), known, langs, p).select("doc_id", "held_out", "lang_pred", "score")


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op 9 over every vector."""
    return neighbours.search(table(spark, sf_dir, "embeddings"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of encoded lengths of every document, and what each context limit keeps."""
    lengths = tokens.encoded_lengths(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))
    return tokens.context_report(tokens.length_histogram(lengths))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op 11 over every document, sorted by the time of a document's first visit."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", F.col("first_position").alias("position"))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16) AS k FROM documents
), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source
), w AS (SELECT *, [3, 1, 2][place % 3 + 1] AS w FROM s
), r AS (
  SELECT *, sum(source_size) OVER () AS all_size, sum(w) OVER () AS all_w, coalesce(sum(source_size) OVER before, 0) AS size_before, coalesce(sum(w) OVER before, 0) AS w_before FROM w
  WINDOW before AS (ORDER BY source_size * 6 / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (SELECT *, 200 * source_size * (all_w - w_before) <= w * (150 * all_size - 200 * size_before) AS full_ FROM r
), t AS (
  SELECT source, source_size, place, CASE WHEN full_ THEN CAST(2 * source_size AS DOUBLE)
    ELSE w * CAST(150 * all_size - 200 * coalesce(sum(source_size) FILTER (full_) OVER (), 0) AS DOUBLE) / CAST(100 * coalesce(sum(w) FILTER (NOT full_) OVER (), 1) AS DOUBLE) END AS target FROM f
), o AS (
  SELECT doc_id, size, source_size, target, place, CAST(floor(target + 0.5) AS BIGINT) AS ask,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), v AS (SELECT *, CASE WHEN size > 0 AND o < ask THEN CAST(o AS DOUBLE) / CAST(ask AS DOUBLE) END AS u FROM o)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(greatest(0, least(size, ask - o)) + greatest(0, least(size, ask - o - source_size)) AS BIGINT) AS taken,
  CASE place % 3 WHEN 0 THEN 2 * u / (1.5 + sqrt(2.25 - 2 * u)) WHEN 1 THEN 2 * u / (0.5 + sqrt(0.25 + 2 * u))
    ELSE CASE WHEN u >= 0.5 THEN 0.5 + 2 * (u - 0.5) / (1.5 + sqrt(2.25 - 4 * (u - 0.5))) ELSE 2 * u / (0.5 + sqrt(0.25 + 4 * u)) END END AS position FROM v
"""


def op12_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op 12: every item of ``benchmark`` against every document."""
    return ranking.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark
), c AS (SELECT count(*) AS nn, CAST(sum(len(t)) AS BIGINT) AS ll FROM d WHERE len(t) > 0
), m AS (SELECT r, doc_id, 10 + (90 * CAST(len(t) AS BIGINT) * nn) // ll AS m FROM d, c
), tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(t) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY r, t
), w AS (SELECT t, CAST(floor(1000 * ln((2 * max(nn) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, c GROUP BY t
), s AS (
  SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN tf USING (t) JOIN w USING (t) JOIN m USING (r) GROUP BY item_id, r, doc_id
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op 13 over every document."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH p AS (
  SELECT row_number() OVER () AS id, lang, piece FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
), g AS (
  SELECT lang, k, unnest(list_transform(range(1, greatest(0, len(w) - k + 1) + 1), lambda i: w[i:i+k-1])) AS g FROM w, (SELECT unnest([1, 2, 3]) AS k)
), f AS (SELECT lang, k, g, CAST(count(*) AS HUGEINT) AS f FROM g GROUP BY lang, k, g
), n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (
  SELECT a.lang, a.k, a.g, a.f AS a, l.f AS l, r.f AS r, cut, (1000000 * a.f * a.f) // (l.f * r.f) AS score FROM (SELECT *, unnest(range(1, k)) AS cut FROM f WHERE k > 1 AND f >= 10) a
  JOIN f l ON l.lang = a.lang AND l.k = cut AND l.g = a.g[1:cut] JOIN f r ON r.lang = a.lang AND r.k = a.k - cut AND r.g = a.g[cut+1:]
), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) AS o FROM c) WHERE o = 1
), inside AS (SELECT lang, g, max(f) AS f FROM (SELECT lang, g[1:2] AS g, f FROM f WHERE k = 3 AND f >= 10 UNION ALL SELECT lang, g[2:3], f FROM f WHERE k = 3 AND f >= 10) GROUP BY lang, g
), kept AS (
  SELECT b.lang, array_to_string(b.g, ' ') AS phrase, a, l, r, score FROM b LEFT JOIN inside i ON b.k = 2 AND i.lang = b.lang AND i.g = b.g WHERE i.f IS NULL OR 100 * i.f < 50 * a
), o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM o JOIN n USING (lang) WHERE rank <= 2000
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffixes": op1_suffixes,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_media": op4_media,
    "op5_lines": op5_lines,
    "op6_toxicity": op6_toxicity,
    "op7_packing": op7_packing,
    "op8_language": op8_language,
    "op9_neighbours": op9_neighbours,
    "op10_token_counts": op10_token_counts,
    "op11_mixing": op11_mixing,
    "op12_ranking": op12_ranking,
    "op13_phrases": op13_phrases,
}
ORACLE_SQL: dict[str, str] = {"op3_jaccard_join": OP3_SQL, "op11_mixing": OP11_SQL, "op12_ranking": OP12_SQL, "op13_phrases": OP13_SQL}
