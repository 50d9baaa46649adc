"""The registered queries of the subpackage, and SQL stating the same result where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.llm import alignment, codes, exact_dedup, jaccard, language, main_text, mixing, neighbours, packing, quality, quality_rules, url_rules, warc
from factloom.plans.session import tune

QUERIES, ORACLES = {}, {}


def query(name: str, *tables: str, sql: str | None = None):
    def register(build):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(*[tune(spark).read.parquet(f"{folder}/{table}.parquet") for table in tables])

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def _fold(folds: int):
    """Fold of a document by its id, as the contracts fix it."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds


@query("op1_jaccard_join", "documents")
def op1(docs: DataFrame) -> DataFrame:
    return jaccard.similar_components(docs)


@query("op2_nearest_neighbours", "embeddings")
def op2(vectors: DataFrame) -> DataFrame:
    return neighbours.nearest_neighbours(vectors, F.col("vec_id") % 50 == 0)


@query("op3_warc", "pages")
def op3(pages: DataFrame) -> DataFrame:
    return warc.archive_pages(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op4_main_text", "pages")
def op4(pages: DataFrame) -> DataFrame:
    found = main_text.extract(pages.select("page_id", "url", "html"), main_text.trained())
    return found.select("page_id", "url", F.col("__text").alias("text"), F.length("__text").cast("long").alias("n_chars"))


_RULES_SQL = ", ".join(f"({k}, '{r.name}', '{r.verdict}', '{r.pattern}', {str(r.ordered).lower()})"
                       for k, r in enumerate(url_rules.SITE_RULES + url_rules.PATTERN_RULES))


@query("op5_url_rules", "pages", sql=f"""
WITH rules(rule_no, name, verdict, pattern, ordered) AS (VALUES {_RULES_SQL}),
p AS (SELECT page_id, url, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
u AS (SELECT DISTINCT host, path FROM p),
best AS (SELECT host, path, name, verdict, ordered FROM u JOIN rules ON regexp_matches(u.host || u.path, rules.pattern)
  QUALIFY row_number() OVER (PARTITION BY host, path ORDER BY ordered DESC, length(name) DESC, rule_no) = 1)
SELECT page_id, host, path, CASE WHEN ordered THEN name END AS rule, coalesce(verdict, 'allow') AS verdict,
  CASE WHEN NOT ordered THEN name END AS pattern FROM p LEFT JOIN best USING (host, path)""")
def op5(pages: DataFrame) -> DataFrame:
    judged = url_rules.judge_urls(pages)
    return judged.select("page_id", *[F.col(f"__{c}").alias(c) for c in ("host", "path", "rule", "verdict", "pattern")])


@query("op6_source_mixing", "documents", sql=r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS k, source IS NULL AS o, source,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS h FROM documents),
s AS (SELECT k, o, CAST(sum(size) AS BIGINT) AS n FROM d GROUP BY ALL),
w AS (SELECT *, list_extract([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE], CAST((row_number() OVER (ORDER BY o, k) - 1) % 3 + 1 AS INTEGER)) AS weight FROM s),
r AS (SELECT *, n * 3.0::DOUBLE AS most, n * 3.0::DOUBLE / weight AS ratio, sum(n::DOUBLE) OVER () AS total, sum(weight) OVER () AS all_weight FROM w),
l AS (SELECT *, (total - coalesce(sum(most) OVER b, 0)) / (all_weight - coalesce(sum(weight) OVER b, 0)) AS level FROM r
  WINDOW b AS (ORDER BY ratio, o, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, bool_or(ratio >= level) OVER (ORDER BY ratio, o, k) AS below, row_number() OVER (ORDER BY ratio, o, k) AS place FROM l),
t AS (SELECT k, o, n, CASE WHEN NOT below THEN most ELSE weight * (SELECT arg_min(level, place) FROM f WHERE below) END AS target FROM f),
b AS (SELECT d.*, t.n, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
  coalesce(sum(size) OVER (PARTITION BY d.k, d.o ORDER BY h, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.k = t.k AND d.o = t.o)
SELECT doc_id, source, size, n AS source_size, target,
  CAST(CASE WHEN n = 0 THEN 0 ELSE budget // n * size + least(greatest(budget % n - before, 0), size) END AS BIGINT) AS taken FROM b""")
def op6(docs: DataFrame) -> DataFrame:
    return mixing.plan_mix(docs)


@query("op7_exact_dedup", "documents", sql="""
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  coalesce(doc_id = max(doc_id) OVER g, false) AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""")
def op7(docs: DataFrame) -> DataFrame:
    return exact_dedup.mark_copies(docs)


@query("op8_best_fit", "documents")
def op8(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


@query("op9_language", "documents")
def op9(docs: DataFrame) -> DataFrame:
    held_out = _fold(3) == 1
    model = language.train(docs.filter(~held_out))
    return language.identify(docs, model).select("doc_id", held_out.alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))


@query("op10_quality", "documents", "labels")
def op10(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held_out = _fold(5) == 0
    scored = quality.score_quality(docs, labels.filter(~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality.CUT).cast("int").alias("predicted"))


_STOP_SQL = ", ".join(f"'{w}', '{w.capitalize()}', '{w.upper()}'" for w in quality_rules.STOP_WORDS)
_NEXT_SQL = ", ".join(f"lead(x, {k}) OVER by_place" for k in range(1, 8))
_FAILED_SQL = ", ".join(f"CASE WHEN {t.fails()} THEN '{t.name}' END" for t in quality_rules.THRESHOLDS)


@query("op11_quality_rules", "documents", sql=rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
u AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS k FROM d),
p AS (SELECT r, k, concat_ws(' ', x, {_NEXT_SQL}) AS g, lead(x, 7) OVER by_place AS eighth FROM u WINDOW by_place AS (PARTITION BY r ORDER BY k)),
m AS (SELECT r, k, count(*) OVER (PARTITION BY r, g) AS n FROM p WHERE eighth IS NOT NULL),
s AS (SELECT r, sum(least(8, coalesce(after - k, 8))) AS n_repeat_words FROM (SELECT r, k, lead(k) OVER (PARTITION BY r ORDER BY k) AS after FROM m WHERE n > 1) GROUP BY r),
c AS (SELECT doc_id, len(w) AS n_words, CAST(list_sum(list_transform(w, lambda x: length(x))) AS BIGINT) AS word_chars,
  length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
  len(list_filter(w, lambda x: x IN ({_STOP_SQL}))) AS n_stop_words,
  len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_letter_words,
  len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullet_lines,
  len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_dotted_lines,
  CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN s USING (r)),
j AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  concat_ws(', ', {_FAILED_SQL}) AS failed_rules FROM (SELECT * REPLACE (coalesce(word_chars, 0) AS word_chars) FROM c))
SELECT *, NOT base_failed AND failed_rules = '' AS kept FROM j""")
def op11(docs: DataFrame) -> DataFrame:
    judged = quality_rules.judge_quality(docs.select("doc_id", "text"))
    return judged.select("doc_id", "__rules.*").withColumn("failed_rules", F.array_join("failed", ", ")).drop("failed")


def _lloyd_sql(rounds: int) -> str:
    """The rounds of Lloyd's method, one after the other, over (row, part, position, integer)."""
    nearest = """a{r} AS MATERIALIZED (SELECT r, part, min(d * 16 + e) % 16 AS e, min(d * 16 + e) // 16 AS d FROM
  (SELECT r, part, e, CAST(sum((x - y) * (x - y)) AS BIGINT) AS d FROM x JOIN c{r} USING (part, pos) GROUP BY ALL) GROUP BY ALL)"""
    moved = """c{n} AS MATERIALIZED (SELECT part, e, pos, coalesce(m, y) AS y FROM c{r} LEFT JOIN
  (SELECT part, e, pos, CAST(floor(sum(x) / count(*)) AS BIGINT) AS m FROM x JOIN a{r} USING (r, part) GROUP BY ALL) USING (part, e, pos))"""
    steps = [text.format(r=r, n=r + 1) for r in range(rounds) for text in (nearest, moved)] + [nearest.format(r=rounds)]
    return ",\n".join(steps)


@query("op12_vector_codes", "embeddings", sql=f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS r, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda z: z IS NULL OR NOT isfinite(z))) = 0),
x AS MATERIALIZED (SELECT r, CAST(pos * 8 // len(embedding) AS INTEGER) AS part, pos, CAST(floor(4096 * CAST(embedding[pos + 1] AS DOUBLE)) AS BIGINT) AS x
  FROM (SELECT *, unnest(range(len(embedding))) AS pos FROM k)),
c0 AS MATERIALIZED (SELECT part, r - 1 AS e, pos, x AS y FROM x WHERE r <= 16),
{_lloyd_sql(codes.ROUNDS)},
b AS (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY part, e, pos)) AS codebooks_sha256 FROM c{codes.ROUNDS}),
o AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{codes.ROUNDS} GROUP BY r)
SELECT vec_id, label, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN o USING (r), b""")
def op12(vectors: DataFrame) -> DataFrame:
    return codes.compress(vectors)


@query("op13_token_alignment", "documents")
def op13(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return alignment.linked_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
