"""One thin query for each operator of the subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """Path of the byte-level vocabulary that op10 and the pipeline use; other files can be given to the operator."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarn.llm.suffixes import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarn.llm.quality import judge

    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "reason")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarn.llm.pii import KINDS, find_spans

    return find_spans(table(spark, sf_dir, "documents"), with_text=False).select("doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarn.llm.language import fold, identify

    return identify(table(spark, sf_dir, "documents")).select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score", "rejected")


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarn.llm.shards import shard_documents

    placed = shard_documents(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarn.llm.simhash import group

    return group(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarn.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarn.llm.urls import judge

    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarn.llm.vectors import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0).select("query_id", "rank", "vec_id", "score")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarn.llm.bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), vocabulary(), with_ids=False)


def op11_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarn.llm.exact import deduplicate

    return deduplicate(spark, f"{sf_dir}/documents.parquet")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tarn.llm.alignment import align

    return align(table(spark, sf_dir, "documents"), vocabulary(), public_tokenizers.path("piece_bpe_32k.model"), with_groups=False)[0]


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarn.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_quality": op2_quality,
    "op3_pii": op3_pii,
    "op4_language": op4_language,
    "op5_shards": op5_shards,
    "op6_simhash": op6_simhash,
    "op7_mixing": op7_mixing,
    "op8_urls": op8_urls,
    "op9_neighbours": op9_neighbours,
    "op10_bpe": op10_bpe,
    "op11_exact": op11_exact,
    "op12_alignment": op12_alignment,
    "op13_whitening": op13_whitening,
}

ORACLES: dict[str, str] = {
    # every 100-byte string of every document, and the bytes covered by those that are not the first of their kind
    "op1_suffix_dedup": r"""
WITH docs AS (
  SELECT row_number() OVER (ORDER BY doc_id) AS id, doc_id, encode(coalesce(text, '')) AS raw FROM documents
), strings AS (
  SELECT id, p, array_slice(raw, p + 1, p + 100) AS w
  FROM (SELECT id, raw, unnest(range(octet_length(raw) - 99)) AS p FROM docs WHERE octet_length(raw) >= 100)
), firsts AS (
  SELECT w, min(id * 4294967296 + p) AS place FROM strings GROUP BY w HAVING count(*) > 1
), repeats AS (
  SELECT id, p FROM strings JOIN firsts USING (w) WHERE id * 4294967296 + p > place
), runs AS (
  SELECT id, p, sum(fresh) OVER (PARTITION BY id ORDER BY p) AS run
  FROM (SELECT id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY id ORDER BY p) + 100 THEN 0 ELSE 1 END AS fresh FROM repeats)
), spans AS (
  SELECT id, min(p) AS a, max(p) + 100 AS b FROM runs GROUP BY id, run
), kept AS (
  SELECT id, b AS start, coalesce(lead(a) OVER (PARTITION BY id ORDER BY a), 1000000000000) AS stop FROM spans
  UNION ALL SELECT id, 0, min(a) FROM spans GROUP BY id
), pieces AS (
  SELECT id, string_agg(hex(array_slice(raw, start + 1, least(stop, octet_length(raw)))), '' ORDER BY start) AS digits
  FROM kept JOIN docs USING (id) WHERE start < least(stop, octet_length(raw)) GROUP BY id
), removed AS (
  SELECT id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY id
)
SELECT doc_id, octet_length(raw) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(CASE WHEN n_removed IS NULL THEN raw ELSE unhex(coalesce(digits, '')) END) AS kept_sha256
FROM docs LEFT JOIN removed USING (id) LEFT JOIN pieces USING (id)
""",
    # counts from the words one by one; quartiles from the buckets of each measure, blended from the whole table down to (lang, source)
    "op2_quality": r"""
WITH docs AS (
  SELECT row_number() OVER () AS id, doc_id, lang, source, coalesce(text, '') AS t FROM documents
), words AS (
  SELECT id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (SELECT id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM docs)
), follow AS (
  SELECT id, i, word, lag(word) OVER o AS previous,
         word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o
              || ' ' || lead(word, 5) OVER o || ' ' || lead(word, 6) OVER o || ' ' || lead(word, 7) OVER o AS eight
  FROM words WINDOW o AS (PARTITION BY id ORDER BY i)
), repeated AS (
  SELECT id, count(DISTINCT place) AS n_repeat_words
  FROM (SELECT id, unnest(range(i, i + 8)) AS place FROM (SELECT id, i, count(*) OVER (PARTITION BY id, eight) AS n FROM follow WHERE eight IS NOT NULL) WHERE n > 1)
  GROUP BY id
), worded AS (
  SELECT id, count(*) AS n_words, sum(length(word))::BIGINT AS word_chars, count(*) FILTER (WHERE word = previous) AS n_echoes FROM follow GROUP BY id
), lined AS (
  SELECT id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT id, unnest(string_split(t, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY id
), counted AS (
  SELECT d.id, doc_id, lang, source, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
         length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, coalesce(n_echoes, 0) AS n_echoes
  FROM docs d LEFT JOIN worded USING (id) LEFT JOIN lined USING (id) LEFT JOIN repeated USING (id)
), based AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted
), rules(nth, measure, spreads, floor) AS (
  VALUES (1, 'symbol_share', 6.0::DOUBLE, 0.005::DOUBLE), (2, 'upper_share', 6.0, 0.02), (3, 'dup_line_share', 6.0, 0.08),
         (4, 'repeat_share', 6.0, 0.05), (5, 'echo_share', 6.0, 0.03), (6, 'word_length', 8.0, 0.25)
), shares AS (
  SELECT id, lang, source, base_failed, nth, measure, spreads, floor,
         CASE nth WHEN 1 THEN n_symbols / nullif(word_chars, 0) WHEN 2 THEN n_upper / nullif(word_chars, 0) WHEN 3 THEN n_dup_lines / nullif(n_lines, 0)
                  WHEN 4 THEN n_repeat_words / nullif(n_words, 0) WHEN 5 THEN n_echoes / nullif(n_words, 0) ELSE word_chars / nullif(n_words, 0) END AS x
  FROM based, rules
), sketch AS (
  SELECT lang, source, measure, CASE WHEN x > 0 THEN ceil(ln(x) / ln(1.04::DOUBLE))::INTEGER ELSE -10000 END AS bucket, count(*) AS n
  FROM shares WHERE NOT base_failed AND x IS NOT NULL GROUP BY ALL
), levels AS (
  SELECT 0 AS level, lang, source, measure, bucket, n FROM sketch
  UNION ALL SELECT 1, lang, NULL, measure, bucket, sum(n) FROM sketch GROUP BY lang, measure, bucket
  UNION ALL SELECT 2, NULL, NULL, measure, bucket, sum(n) FROM sketch GROUP BY measure, bucket
), running AS (
  SELECT level, lang, source, measure, CASE WHEN bucket = -10000 THEN 0.0 ELSE 2 * pow(1.04::DOUBLE, bucket) / 2.04 END AS value,
         sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY level, lang, source, measure) AS total
  FROM levels
), quartiles AS (
  SELECT level, lang, source, measure, max(total)::DOUBLE AS total, min(value) FILTER (WHERE upto >= total * 0.25::DOUBLE) AS low, min(value) FILTER (WHERE upto >= total * 0.75::DOUBLE) AS high
  FROM running GROUP BY level, lang, source, measure
), blended AS (
  SELECT a.lang, a.source, a.measure,
         (a.total * a.low + 200.0 * ((b.total * b.low + 200.0 * c.low) / (b.total + 200.0))) / (a.total + 200.0) AS low,
         (a.total * a.high + 200.0 * ((b.total * b.high + 200.0 * c.high) / (b.total + 200.0))) / (a.total + 200.0) AS high
  FROM quartiles a JOIN quartiles b ON b.level = 1 AND a.lang IS NOT DISTINCT FROM b.lang AND a.measure = b.measure JOIN quartiles c ON c.level = 2 AND a.measure = c.measure
  WHERE a.level = 0
), broken AS (
  SELECT s.id, arg_min(s.measure, s.nth) AS measure
  FROM shares s JOIN blended q ON s.lang IS NOT DISTINCT FROM q.lang AND s.source IS NOT DISTINCT FROM q.source AND s.measure = q.measure
  WHERE s.x > (q.high + s.spreads * greatest(q.high - q.low, s.floor)) * 1.04::DOUBLE
  GROUP BY s.id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND measure IS NULL AS kept, CASE WHEN base_failed THEN 'base' ELSE measure END AS reason
FROM based LEFT JOIN broken USING (id)
""",
    # groups by the text itself; the digest is only shown
    "op11_exact": r"""
WITH texts AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS content, row_number() OVER () AS place FROM documents
), ranked AS (
  SELECT doc_id, content, count(*) OVER (PARTITION BY content) AS group_size, first_value(doc_id) OVER o AS keep_id, row_number() OVER o = 1 AS kept
  FROM texts WINDOW o AS (PARTITION BY content ORDER BY chars DESC, doc_id NULLS LAST, place)
)
SELECT doc_id, keep_id, group_size, kept, sha256(content) AS text_sha256 FROM ranked
""",
    # the documents of a source in the order of their hashes, up to the one at which the sum comes nearest to the rest of its target
    "op7_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('23:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS hash, row_number() OVER () AS at
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM sized GROUP BY source
), weighed AS (
  SELECT source, source_size, [5.0::DOUBLE, 2.0, 1.0][(n % 3 + 1)::INTEGER] AS weight, 3.0::DOUBLE * source_size AS cap, n FROM sources
), levelled AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed WINDOW before AS (ORDER BY cap / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), common AS (
  SELECT arg_min(level, cap / weight) AS level FROM levelled WHERE cap >= level * weight
), targets AS (
  SELECT source, source_size, least(cap, common.level * weight) AS target FROM levelled, common
), budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes FROM targets
), placed AS (
  SELECT d.doc_id, d.size, b.source_size, b.target, d.source, b.passes, b.target - b.passes * b.source_size AS rest,
         (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.hash, d.at ROWS UNBOUNDED PRECEDING) - d.size)::DOUBLE AS before
  FROM sized d JOIN budgets b ON d.source IS NOT DISTINCT FROM b.source
), taken AS (
  SELECT *, CASE WHEN size = 0 THEN 0 ELSE least(3, passes + CASE WHEN before < rest AND (before + size <= rest OR 2 * (rest - before) >= size) THEN 1 ELSE 0 END) END::INTEGER AS copies
  FROM placed
)
SELECT doc_id, size, source_size, target, copies * size AS taken, source, copies FROM taken
""",
    # PageRank by 300 rounds of a recursive query, when 0.85^300 of the start is left
    "op8_urls": r"""
WITH RECURSIVE parsed AS (
  SELECT page_id, html, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
), matched AS (
  SELECT *, CASE WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/' WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
                 WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/' WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parsed
), ruled AS (
  SELECT *, CASE WHEN rule IN ('example.com/de/', 'net/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS decided FROM matched
), hosts AS (
  SELECT host, count(*) AS pages, count(*) FILTER (WHERE decided = 'allow') AS allowed, count(*) FILTER (WHERE decided = 'block') AS blocked FROM ruled WHERE host <> '' GROUP BY host
), links AS (
  SELECT DISTINCT host AS src, translate(unnest(regexp_extract_all(html, '(?is)href\s*=\s*["'']?\s*(?:https?:)?//([^/?#"''\s>]+)', 1)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM ruled
), ways AS (
  SELECT 'trust' AS kind, src, dst FROM links WHERE src <> '' AND dst <> '' AND src <> dst UNION ALL SELECT 'distrust', dst, src FROM links WHERE src <> '' AND dst <> '' AND src <> dst
), parts AS (
  SELECT kind, src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY kind, src) AS part FROM ways
), seeds AS (
  SELECT kind, host, 1.0::DOUBLE / count(*) OVER (PARTITION BY kind) AS weight
  FROM (SELECT 'trust' AS kind, host FROM hosts WHERE allowed * 2 > pages UNION ALL SELECT 'distrust', host FROM hosts WHERE blocked * 2 > pages)
), nodes AS (
  SELECT kind, host FROM (VALUES ('trust'), ('distrust')) k(kind), (SELECT host FROM hosts UNION SELECT dst FROM links WHERE dst <> '') h
), walk AS (
  SELECT 0 AS step, n.kind, n.host, coalesce(s.weight, 0.0)::DOUBLE AS score FROM nodes n LEFT JOIN seeds s ON n.kind = s.kind AND n.host = s.host
  UNION ALL
  SELECT w.step + 1, w.kind, w.host,
         0.85::DOUBLE * coalesce(g.got, 0.0) + (1.0::DOUBLE - 0.85::DOUBLE * coalesce(sum(g.got) OVER (PARTITION BY w.kind), 0.0)) * coalesce(s.weight, 0.0)
  FROM walk w
  LEFT JOIN (SELECT p.kind, p.dst, sum(x.score * p.part) AS got FROM walk x JOIN parts p ON x.kind = p.kind AND x.host = p.src GROUP BY p.kind, p.dst) g ON g.kind = w.kind AND g.dst = w.host
  LEFT JOIN seeds s ON s.kind = w.kind AND s.host = w.host
  WHERE w.step < 300
), scores AS (
  SELECT host, sum(score) FILTER (WHERE kind = 'trust') AS trust, sum(score) FILTER (WHERE kind = 'distrust') AS distrust FROM walk WHERE step = 300 GROUP BY host
)
SELECT r.page_id, r.host, r.path, r.rule, coalesce(r.decided, CASE WHEN s.distrust > s.trust + 0.05::DOUBLE / (SELECT count(*) FROM hosts) THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled r LEFT JOIN scores s ON r.host = s.host AND r.host <> ''
""",
    # exact search (factor 1): products are added in the order of the dimensions, as the operator does
    "op9_neighbours": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])), lambda a, b: a + b) AS score
  FROM v q JOIN v c ON q.vec_id IS DISTINCT FROM c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank, vec_id, score FROM pairs
)
SELECT * FROM ranked WHERE rank <= 20
""",
}
