"""One query for each operator, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import bpe, decontaminate, html, jaccard, language, lines, merkle, neighbours, pii, quality, resample, substring, urls
from assayer.llm.shared import bounded_batches
from assayer.sources import tables

#: Rules of hosts and paths, with their verdicts.
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
#: Listed canonical URLs, a small list of spam hosts; a production list is a table.
LISTED = ["ads-track.example.org/", "casino-win.example.org/", "cheap-pills.example.com/", "free-bets.example.com/", "spam-farm.example.org/"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return tables.dealt_table(spark, sf_dir, name)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from all training; a null id is held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(True))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"), min_words=35)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["past"] - s["first"])
    return out.select(F.col("id").alias("doc_id"), "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    filters = language.learn(docs.where(~held_out()))
    return language.identify(docs, filters).select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "lang_pred", "score")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("node").alias("doc_id"), "rep", "class_id", "n_links")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "removed_lines", F.length("text").cast("long").alias("n_chars"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), "item_ids", "n_windows", "verbatim")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(u,) for u in LISTED], "url string")
    out = urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), urls.entries(spark, RULES, listed))
    return out.select("page_id", "host", "path", "rule", "verdict")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs.where(~held_out()), table(spark, sf_dir, "labels"))
    out = quality.score(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = bpe.round_trip(docs, tokenizer_path()).drop("text")
    text = F.array_join("ids", ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(text.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find(tables.table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.array(*map(F.lit, pii.KINDS))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind_no"] + 1), s["start"], s["end"])), ",")
    of_kind = lambda i: F.size(F.filter(base, lambda s: s["kind_no"] == i)).cast("long")
    counts = [of_kind(i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS)]
    return out.select(F.col("id").alias("doc_id"), *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    changed = merkle.digest_of([F.col(c) + 1 if c == "n_chars" else F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")])
    trees, top = merkle.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", carried={"changed": F.when(tampered, changed)})
    out = merkle.proofs(trees, top)
    siblings = F.array_join(F.flatten(F.transform("steps", lambda s: s["others"])), "")
    out = out.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"), merkle.fold(F.coalesce("changed", "leaf"), F.col("steps")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text")
    out = resample.draw(resample.importance(docs, target, n=1, buckets=10_000), percent=10, least_words=20, seed=2024)
    return out.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


QUERIES = {f.__name__: f for f in (op1_inverted_multi_index, op2_substring_dedup, op3_main_text, op4_language, op5_jaccard_join, op6_line_dedup, op7_decontamination, op8_url_filter, op9_quality, op10_bpe, op11_pii, op12_merkle_manifest, op13_importance_resampling)}

#: SQL over the same tables, where it can express an operator exactly.
ORACLE: dict[str, str] = {}

ORACLE["op2_substring_dedup"] = r"""
WITH w AS (
  SELECT doc_id, t.pos, t.word FROM documents, LATERAL (SELECT unnest(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS word, generate_subscripts(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> ''), 1) AS pos) t
), grams AS (
  SELECT doc_id, pos, word, string_agg(word, ' ') OVER win AS gram, count(*) OVER win AS n FROM w WINDOW win AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)
), marked AS (
  SELECT doc_id, pos, word, n = 35 AND count(*) OVER (PARTITION BY gram, n) > 1 AS again FROM grams
), covered AS (
  SELECT doc_id, pos, word, max(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM marked
)
SELECT d.doc_id, count(c.word) AS n_words, count(c.word) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(c.word, ' ' ORDER BY c.pos) FILTER (NOT gone), '')) AS kept_sha256
FROM documents d LEFT JOIN covered c ON d.doc_id = c.doc_id GROUP BY d.doc_id
"""

ORACLE["op6_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents
), keyed AS (
  SELECT doc_id, pos, line, trim(line) AS a, lead(trim(line), 1) OVER w AS b, lead(trim(line), 2) OVER w AS c FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), marked AS (
  SELECT doc_id, pos, line, c IS NOT NULL AND (a <> '' OR b <> '' OR c <> '') AND row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) > 1 AS again FROM keyed
), covered AS (
  SELECT doc_id, pos, line, max(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS gone FROM marked
), kept AS (
  SELECT doc_id, count(*) FILTER (gone) AS removed_lines, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text FROM covered GROUP BY doc_id
)
SELECT d.doc_id, coalesce(removed_lines, 0) AS removed_lines, CASE WHEN d.text IS NULL THEN NULL ELSE length(k.text) END AS n_chars, md5(coalesce(k.text, '')) AS text_md5
FROM documents d LEFT JOIN kept k USING (doc_id)
"""

ORACLE["op8_url_filter"] = r"""
WITH parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages
), entries(rule, host, path, verdict, listed) AS (
  VALUES ('com/', 'com', '/', 'allow', false), ('example.com/en/', 'example.com', '/en/', 'block', false), ('www.example.com/en/', 'www.example.com', '/en/', 'allow', false), ('net/es/', 'net', '/es/', 'block', false), ('net/fr/', 'net', '/fr/', 'block', false),
  ('ads-track.example.org/', 'ads-track.example.org', '/', 'block', true), ('casino-win.example.org/', 'casino-win.example.org', '/', 'block', true), ('cheap-pills.example.com/', 'cheap-pills.example.com', '/', 'block', true), ('free-bets.example.com/', 'free-bets.example.com', '/', 'block', true), ('spam-farm.example.org/', 'spam-farm.example.org', '/', 'block', true)
), fits AS (
  SELECT p.page_id, p.host, p.path, e.rule, e.verdict, e.listed, row_number() OVER (PARTITION BY p.page_id ORDER BY e.listed, length(e.rule) DESC) AS n
  FROM parts p LEFT JOIN entries e ON (p.host = e.host OR ends_with(p.host, '.' || e.host)) AND starts_with(p.path, e.path)
)
SELECT page_id, host, path, CASE WHEN NOT listed THEN rule END AS rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE n = 1
"""

# the manifest level by level, each proof folded step by step; CRC-32 of decimal ids bit by bit
ORACLE["op12_merkle_manifest"] = r"""
WITH RECURSIVE rows AS (
  SELECT doc_id, lang,
    sha256(concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-'), coalesce(strlen(text) || ':' || text, '-'))) AS leaf,
    sha256(concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-'), coalesce(strlen(text) || ':' || text, '-'))) AS changed,
    xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda h, b: list_reduce([xor(h, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) % 7 = 0 AS tampered
  FROM documents
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM rows
), nodes AS (
  SELECT lang, 0 AS level, pos, leaf AS digest, count(*) OVER (PARTITION BY lang) AS n FROM leaves
  UNION ALL
  SELECT lang, level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM nodes WHERE n > 1 GROUP BY lang, level, pos // 2
), subroots AS (
  SELECT lang, level AS height, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS level, pos, subroot AS digest, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM tops WHERE n > 1 GROUP BY level, pos // 2
), walk AS (
  SELECT l.doc_id, l.lang, l.leaf, s.subroot, s.height, s.pos AS top, 0 AS step, l.pos, '' AS proof, CASE WHEN l.tampered THEN l.changed ELSE l.leaf END AS folded
  FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang
  UNION ALL
  SELECT w.doc_id, w.lang, w.leaf, w.subroot, w.height, CASE WHEN step >= height THEN top // 2 ELSE top END, step + 1, CASE WHEN step < height THEN w.pos // 2 ELSE 0 END,
    w.proof || coalesce(a.digest, b.digest, ''),
    CASE WHEN coalesce(a.digest, b.digest) IS NULL THEN sha256(folded) WHEN (CASE WHEN step < height THEN w.pos ELSE top END) % 2 = 0 THEN sha256(folded || coalesce(a.digest, b.digest)) ELSE sha256(coalesce(a.digest, b.digest) || folded) END
  FROM walk w
  LEFT JOIN nodes a ON step < height AND a.lang IS NOT DISTINCT FROM w.lang AND a.level = step AND a.pos = xor(w.pos, 1)
  LEFT JOIN tops b ON step >= height AND b.level = step - height AND b.pos = xor(top, 1)
  WHERE step < height + (SELECT max(level) FROM tops)
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM walk, (SELECT digest AS root FROM tops WHERE n = 1) WHERE step = height + (SELECT max(level) FROM tops)
"""

# CRC-32 of each distinct word's bytes, bit by bit
ORACLE["op13_importance_resampling"] = r"""
WITH texts AS (
  SELECT doc_id, text, false AS aim FROM documents UNION ALL SELECT NULL, text, true FROM benchmark
), found AS (
  SELECT doc_id, aim, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM texts
), counted AS (
  SELECT word, count(*) FILTER (NOT aim) AS s, count(*) FILTER (aim) AS t FROM found GROUP BY word
), bucketed AS (
  SELECT word, s, t, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, 2 * octet_length(encode(word)), 2), lambda i: ('0x' || substr(hex(encode(word)), i, 2))::BIGINT)), lambda h, b: list_reduce([xor(h, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) % 10000 AS bucket FROM counted
), gains AS (
  SELECT bucket, floor(1000 * ln((sum(t) + 1)::DOUBLE * (sum(sum(s)) OVER () + 10000)::DOUBLE / ((sum(s) + 1)::DOUBLE * (sum(sum(t)) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM bucketed GROUP BY bucket
), weighed AS (
  SELECT d.doc_id, coalesce(w.n, 0) AS n_features, coalesce(w.weight, 0) AS weight
  FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS weight FROM found JOIN bucketed USING (word) JOIN gains USING (bucket) WHERE NOT aim GROUP BY doc_id) w USING (doc_id)
), scored AS (
  SELECT *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM weighed
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY n_features >= 20 DESC, score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () * 10 // 100 AS drawn FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank FROM ranked
"""
