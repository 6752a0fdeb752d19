"""Registered queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import bpe, byte_bpe, fim, gru, itq, mixing, passages, ppm, simhash, sites, topk, toxicity, turns
from newsloom.llm.frames import fold_of, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(build):
    QUERIES[build.__name__] = build
    return build


@query
def op1_ppm_score(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text").withColumn("_fold", fold_of("doc_id", 7))
    return ppm.score(docs, "_fold <> 2")


@query
def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = fold_of("doc_id", 3) == 1
    net = gru.learn(docs.where(~held_out))
    return gru.identify(docs, net).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = fold_of("doc_id", 4) == 2
    lexicon = toxicity.learn(docs, table(spark, folder, "labels").where(~held_out))
    return toxicity.score(docs, lexicon).select(
        "doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.3).cast("int").alias("predicted"))


@query
def op4_itq_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return itq.near_vectors(table(spark, folder, "embeddings"))


@query
def op5_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex(F.col("prints")[0]), 16, "0")).alias("fingerprint"), "component_id")


def quality_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Weight of a labelled document: 2 for quality 1, one half for quality 0."""
    labels = table(spark, folder, "labels").where("doc_id is not null and quality is not null")
    return labels.groupBy("doc_id").agg(F.when(F.max("quality") == 1, 2.0).otherwise(0.5).alias("weight"))


@query
def op6_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    taken = mixing.takes(table(spark, folder, "documents"), quality_weights(spark, folder))
    return taken.select("doc_id", "size", "source_size", "target", "taken")


ORACLES["op6_source_mixing"] = r"""
WITH sized AS (
  SELECT d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    -ln((('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 1) / 4503599627370496.0)
      / coalesce(q.weight, 1.0) AS k
  FROM documents d LEFT JOIN (
    SELECT doc_id, CASE WHEN max(quality) = 1 THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END AS weight
    FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id) q ON q.doc_id = d.doc_id
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, ([5.0, 2.0, 1.0])[1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3]::DOUBLE AS w,
    2.0::DOUBLE * source_size AS cap FROM sizes
), levels AS (
  SELECT *, row_number() OVER fill AS place,
    (1.5::DOUBLE * (SELECT sum(source_size) FROM sizes) - coalesce(sum(cap) OVER (fill ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
      / sum(w) OVER (fill ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed WINDOW fill AS (ORDER BY cap / w, encode(source) NULLS LAST)
), targets AS (
  SELECT source, source_size, least(cap, coalesce(w * (SELECT min_by(level, place) FROM levels WHERE level <= cap / w), cap)) AS target
  FROM levels
), plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM targets
), ordered AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.epochs, floor(p.target - p.epochs * p.source_size)::BIGINT AS rest,
    coalesce(sum(s.size) OVER (PARTITION BY p.source ORDER BY s.k, s.doc_id::VARCHAR NULLS LAST, s.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken
FROM ordered
"""


@query
def op7_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


ORACLES["op7_exact_topk"] = """
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM rows q JOIN rows c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


@query
def op8_site_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Documents have no URL: the source is the host, and its language the path. Labels of one fold of five are held out."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    held_out = fold_of("doc_id", 5) == 1
    labels = table(spark, folder, "labels").where(~held_out)
    found = sites.site_quality(docs, labels, F.col("source"), F.col("lang"), sites.learn(docs, labels))
    return found.select("doc_id", held_out.alias("held_out"), "host", "path", "evidence", "host_quality", "path_quality", "score", "kept")


@query
def op9_bpe_round_trip(spark: SparkSession, folder: str, tokenizer: str | None = None) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, tokenizer or public_tokenizers.path("word_bpe_49k.json"))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op10_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return passages.repeated_passages(table(spark, folder, "documents"))


def _hashed(text: str | Column, name: str) -> Column:
    return F.sha2((F.col(text) if isinstance(text, str) else text).cast("binary"), 256).alias(name)


@query
def op11_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    cut = fim.fill_in_middle(table(spark, folder, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", _hashed("output", "output_sha256"), _hashed(fim.restored(), "restored_sha256"))


ORACLES["op11_fill_in_middle"] = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units,
    sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), numbered AS (
  SELECT *, len(units)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
    ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM drawn
), cut AS (
  SELECT doc_id, t, n,
    coalesce(array_to_string(units[1:least(h1 % (n + 1), h2 % (n + 1))], ''), '') AS p,
    coalesce(array_to_string(units[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], ''), '') AS m,
    coalesce(array_to_string(units[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:n], ''), '') AS s,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain'
      WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM numbered
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM cut
"""


@query
def op12_byte_bpe_round_trip(spark: SparkSession, folder: str, ranks: str | None = None) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    coded = byte_bpe.encode(docs, ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        _hashed(F.array_join(F.col("ids").cast("array<string>"), ","), "ids_sha256"), _hashed("decoded", "decoded_sha256"))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversation rows with planted faults, by a hash of `conv_id:turn`; nulls become one space, dropped rows are marked."""
    space = F.lit(" ")
    hashed = F.crc32(F.concat(*(F.coalesce(F.col(c).cast("string"), space) if c else F.lit(":") for c in ("conv_id", "", "turn"))).cast("binary"))
    fault, text = F.col("_fault"), F.coalesce(F.col("text"), space)
    return rows.withColumn("_fault", hashed % 20).select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(F.coalesce(F.col("role"), space)).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (fault != 0).alias("there"), F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")).drop("_copy")


@query
def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return turns.summaries(turns.repair(damaged(rows), there="there"))


ORACLES["op13_conversation_repair"] = r"""
WITH RECURSIVE coded AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), faulty AS (
  SELECT *, xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(k, ''), lambda x: ascii(x)::UBIGINT)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]),
      lambda x, y: xor(x >> 1, (x & 1::UBIGINT) * 3988292384::UBIGINT))), 4294967295::UBIGINT) % 20 AS fault
  FROM coded
), there AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM faulty, range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM there
), judged AS (
  SELECT *, substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 3 ELSE 0 END AS bad
  FROM ordered
), ids AS (
  SELECT DISTINCT conv_id FROM conversations
), sizes AS (
  SELECT c.conv_id, count(j.i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
    count(*) FILTER (bad = 1) AS blank, count(*) FILTER (bad = 2) AS duplicate, count(*) FILTER (bad = 3) AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM ids c LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM c.conv_id GROUP BY c.conv_id
), following(state, due, name) AS (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')
), inserts AS (
  SELECT state AS origin, state, 0 AS price, '' AS letters, []::VARCHAR[] AS added FROM following
  UNION ALL SELECT state, due, 3, 'I', [name || ':'] FROM following
  UNION ALL SELECT f.state, g.due, 6, 'II', [f.name || ':', g.name || ':'] FROM following f JOIN following g ON g.state = f.due
), kept(state, initial, target) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)
), ways AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS state, {'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]} AS way FROM ids
  UNION ALL
  SELECT conv_id, i + 1, target, min({'cost': cost, 'audit': audit, 'lines': lines}) FROM (
    SELECT w.conv_id, w.i, e.target, w.way.cost + s.price + e.price AS cost, w.way.audit || s.letters || e.letter AS audit,
      list_concat(w.way.lines, s.added, e.added) AS lines
    FROM ways w JOIN inserts s ON s.origin = w.state
    JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.i = w.i + 1
    JOIN LATERAL (
      SELECT s.state AS target, 4 AS price, 'D' AS letter, []::VARCHAR[] AS added
      UNION ALL SELECT due, 3 + CASE bad WHEN 3 THEN 3 ELSE 0 END, 'R', [f.name || ':' || j.text] FROM following f WHERE f.state = s.state AND j.bad IN (0, 3)
      UNION ALL SELECT target, CASE bad WHEN 3 THEN 3 ELSE 0 END, 'K', [j.role || ':' || j.text] FROM kept t
        WHERE t.state = s.state AND t.initial = j.initial AND j.bad IN (0, 3)) e ON true
  ) GROUP BY conv_id, i, target
), ended AS (
  SELECT w.conv_id, min({'cost': w.way.cost + s.price, 'audit': w.way.audit || s.letters, 'lines': list_concat(w.way.lines, s.added)}) AS way
  FROM ways w JOIN inserts s ON s.origin = w.state AND s.state IN (0, 3) JOIN sizes z ON z.conv_id IS NOT DISTINCT FROM w.conv_id AND z.n = w.i
  GROUP BY w.conv_id
)
SELECT z.conv_id, gaps, blank, duplicate, truncated, illegal, way.cost AS cost, way.audit AS audit,
  sha256(coalesce(array_to_string(way.lines, chr(10)), '')) AS repaired_sha256
FROM sizes z JOIN ended e ON e.conv_id IS NOT DISTINCT FROM z.conv_id
"""
