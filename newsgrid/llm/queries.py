"""The queries opN over whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from newsgrid.llm.ann import nearest_rows
from newsgrid.llm.audit import audit
from newsgrid.llm.bpe import bpe_encode
from newsgrid.llm.common import ORACLES, QUERIES, query, read, scratch
from newsgrid.llm.crf import held_out, identify
from newsgrid.llm.decontaminate import find_items
from newsgrid.llm.hostrank import judge_urls
from newsgrid.llm.huffman import read_tokens, write_texts
from newsgrid.llm.infill import infill, restored
from newsgrid.llm.lines import dedup_lines
from newsgrid.llm.quality import classify, held_out as quality_held_out, learn
from newsgrid.llm.shard import shard_by_bytes
from newsgrid.llm.simhash import group_near
from newsgrid.llm.substrings import dedup_substrings

__all__ = ["ORACLES", "QUERIES"]

BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

ALLOW = ("org/", "com/fr/")
BLOCK = ("example.org/es/", "example.org/en/1", "com/de/")


def bpe_digest(docs: DataFrame) -> DataFrame:
    """Encode, decode again, and reduce both to digests."""
    return bpe_encode(docs, BYTE_RANKS, decoded=True).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op9_bpe_round_trip")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digest(read(spark, sf_dir, "documents"))


@query("op3_shards")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query("op7_token_file")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-file")
    write_texts(read(spark, sf_dir, "documents"), WORD_TOKENIZER, path)
    return read_tokens(spark, path).select(
        "doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"))


@query("op1_simhash_groups")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_near(read(spark, sf_dir, "documents"))


def _fits(rule: str) -> str:
    name, _, start = rule.partition("/")
    return f"((host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{start}'))"


OP6_SQL = r"""
WITH RECURSIVE cut AS (
  SELECT page_id, html, CASE WHEN strpos(url, '://') > 0
                             THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
named AS (
  SELECT page_id, html, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM cut),
found AS (
  SELECT page_id, html, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM named),
ruled AS (
  SELECT *, CASE """ + " ".join(f"WHEN {_fits(r)} THEN '{r}'" for r in sorted(
    (*ALLOW, *BLOCK), key=lambda r: (-len(r), r))) + r""" END AS rule FROM found),
links AS (
  SELECT host AS src, lower(unnest(regexp_extract_all(
    html, '(?i)\shref\s*=\s*["'']?\s*(?:https?:)?//([^\s"''<>/?#]+)', 1))) AS dst
  FROM ruled WHERE host <> ''),
edges AS (SELECT src, dst, count(*) AS n FROM links WHERE src <> dst GROUP BY src, dst),
spread AS (
  SELECT 'trust' AS kind, src AS host, dst AS next, n / sum(n) OVER (PARTITION BY src) AS share FROM edges
  UNION ALL
  SELECT 'distrust', dst, src, n / sum(n) OVER (PARTITION BY dst) FROM edges),
step AS (
  SELECT 0 AS round, CASE WHEN rule IN """ + str(BLOCK) + r""" THEN 'distrust' ELSE 'trust' END AS kind,
         host, count(*) * 0.15::DOUBLE AS score
  FROM ruled WHERE rule IS NOT NULL GROUP BY ALL
  UNION ALL
  SELECT round + 1, kind, next, sum(score * share * 0.85::DOUBLE)
  FROM step JOIN spread USING (kind, host) WHERE round < 60 GROUP BY round, kind, next),
scores AS (
  SELECT host, coalesce(sum(score) FILTER (kind = 'trust'), 0) AS trust,
         coalesce(sum(score) FILTER (kind = 'distrust'), 0) AS distrust FROM step GROUP BY host)
SELECT page_id, r.host, path, rule,
       CASE WHEN rule IN """ + str(BLOCK) + r""" THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN distrust > 2.0 * trust THEN 'block' ELSE 'allow' END AS verdict
FROM ruled r LEFT JOIN scores s ON r.host = s.host
"""


@query("op6_url_verdicts", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages"), ALLOW, BLOCK)


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
  FROM documents),
i AS (
  SELECT item_id, w, least(5, len(w)) AS n FROM (
    SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
    FROM benchmark) WHERE len(w) > 0),
ds AS (
  SELECT DISTINCT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2),
         lambda k: array_to_string(w[k:k + n - 1], ' '))) AS s
  FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n),
si AS (
  SELECT DISTINCT item_id, n, unnest(list_transform(range(1, len(w) - n + 2),
         lambda k: array_to_string(w[k:k + n - 1], ' '))) AS s FROM i),
total AS (SELECT item_id, count(*) AS n_shingles FROM si GROUP BY item_id)
SELECT doc_id, item_id, n_shingles, count(*) AS n_shared, count(*) / n_shingles AS containment
FROM ds JOIN si USING (n, s) JOIN total USING (item_id)
GROUP BY doc_id, item_id, n_shingles
HAVING count(*) >= ceil(0.8 * n_shingles - 1e-9)
"""


@query("op8_benchmark_matches", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP10_SQL = r"""
WITH raw AS (
  SELECT doc_id, unnest(l) AS raw, generate_subscripts(l, 1) AS n
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
unit AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS i,
         len(string_split_regex(line, '\s+')) AS w
  FROM (SELECT doc_id, n, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS line FROM raw) WHERE line <> ''),
summed AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS total FROM unit),
pair AS (
  SELECT a.doc_id, a.i AS a, b.i AS b FROM summed a JOIN summed b
    ON a.doc_id = b.doc_id AND a.i <= b.i AND b.total - a.total + a.w >= 50),
win AS (
  SELECT doc_id, a, min(b) AS b FROM pair GROUP BY doc_id, a
  UNION SELECT doc_id, max(a), b FROM pair GROUP BY doc_id, b),
run AS (
  SELECT win.doc_id, a, b, string_agg(line, chr(10) ORDER BY i) AS run
  FROM win JOIN unit ON win.doc_id = unit.doc_id AND i BETWEEN a AND b GROUP BY win.doc_id, a, b),
later AS (
  SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY run ORDER BY doc_id, a) > 1),
gone AS (
  SELECT DISTINCT unit.doc_id, i, n FROM later JOIN unit
    ON later.doc_id = unit.doc_id AND i BETWEEN a AND b),
stretch AS (
  SELECT doc_id, n AS low, CASE WHEN lead(i) OVER w = i + 1 THEN lead(n) OVER w - 1 ELSE n END AS high,
         lag(i) OVER w IS DISTINCT FROM i - 1 AS head
  FROM gone WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
kept AS (
  SELECT raw.doc_id, string_agg(raw.raw, chr(10) ORDER BY n) FILTER (low IS NULL) AS kept,
         count(low) AS n_removed
  FROM raw LEFT JOIN stretch ON raw.doc_id = stretch.doc_id AND n BETWEEN low AND high
  GROUP BY raw.doc_id),
spans AS (SELECT doc_id, count(*) FILTER (head) AS n_spans FROM stretch GROUP BY doc_id)
SELECT doc_id, n_removed, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(kept, '')) AS kept_sha256
FROM kept LEFT JOIN spans USING (doc_id)
"""


@query("op10_line_dedup", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, spans="spans").select(
        "doc_id", F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["first"])
        .cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op4_language")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return identify(docs, ~held_out()).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query("op5_neighbours")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_rows(read(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


@query("op2_substring_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["first"]).cast("long")
    return dedup_substrings(read(spark, sf_dir, "documents")).select(
        "doc_id", (F.length("kept") + removed).alias("n_bytes"), removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
f AS (
  SELECT doc_id, part, CASE WHEN len(w) < 200 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t)
                 THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS failing FROM d),
l AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic
  FROM labels GROUP BY doc_id),
c AS (
  SELECT part, failing, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n
  FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
x(a) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (
  SELECT p.a || q.a || r.a || s.a || u.a AS filter_order FROM x p, x q, x r, x s, x u
  WHERE len(list_distinct([p.a, q.a, r.a, s.a, u.a])) = 5),
z AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS here, substr(filter_order, 1, step - 1) AS before
  FROM o, (SELECT unnest(range(1, 6)) AS step)),
y AS (
  SELECT *, contains(failing, here) AS fails, translate(before, failing, '') <> before AS gone FROM c, z),
g AS (
  SELECT part, filter_order, step, here,
         sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN fails AND gone THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN failing = here THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN fails AND NOT gone AND good THEN n ELSE 0 END) AS good_lost,
         sum(CASE WHEN fails AND NOT gone AND toxic THEN n ELSE 0 END) AS toxic_lost
  FROM y GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
       redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
       toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, here))::BIGINT AS shapley
FROM g
"""


@query("op11_filter_audit", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(t) AS n,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
k AS (
  SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS x, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS y,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                   OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
              WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (
  SELECT *, least(x, y) AS a, greatest(x, y) - least(x, y) AS b, substr(t, 1, a) AS prefix,
         substr(t, a + 1, b) AS middle, substr(t, a + b + 1) AS suffix FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN b END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
              ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""


@query("op13_infill", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = infill(read(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"),
        F.col("middle_units").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


@query("op12_quality")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    net = learn(docs, read(spark, sf_dir, "labels"), ~quality_held_out())
    return classify(docs, net).select("doc_id", quality_held_out().alias("held_out"), "score", "predicted")
