"""Registered queries of the operators, with their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retrace.llm import (
    boosted_trees, chat_pairs, decontaminate, divergence, importance, license_scan, mixing, permutation_index,
    ppm, quality_rules, simhash, substring_dedup, token_files,
)
from retrace.llm.scratch import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_quality_rules")
def quality(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics and verdict for every document."""
    found = quality_rules.judged(table(spark, folder, "documents"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words"
    )


def tokenizer_path() -> str:
    """The public word-level tokenizer, installed on all machines."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op2_token_files")
def tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Documents written as token files and read back, ids as a checksum."""
    path = new_path(spark, "token-files")
    token_files.write(table(spark, folder, "documents"), path, tokenizer_path())
    return token_files.checksums(token_files.read(spark, path))


MIXING_SQL = """
WITH RECURSIVE counted AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
weighted AS (SELECT source, n, sqrt(n) AS w FROM counted),
quotas AS (SELECT source, greatest(CAST(round(w / (SELECT sum(w) FROM weighted) * 1000) AS BIGINT), 1) AS quota FROM weighted),
q AS (SELECT list(source ORDER BY source) AS names, list(quota ORDER BY source) AS quota, CAST(sum(quota) AS BIGINT) AS slots FROM quotas),
sched AS (
  SELECT CAST(0 AS BIGINT) AS t, list_transform(quota, lambda x: CAST(0 AS BIGINT)) AS done, CAST(NULL AS BIGINT) AS i, CAST(NULL AS BIGINT) AS turn FROM q
  UNION ALL
  SELECT t + 1, list_transform(range(1, len(done) + 1), lambda j: done[j] + CASE WHEN j = best THEN 1 ELSE 0 END), best, done[best]
  FROM (SELECT t, done, (list_min(list_filter(list_transform(range(1, len(done) + 1), lambda j:
          CASE WHEN done[j] < q.quota[j] AND done[j] * slots // q.quota[j] <= t
               THEN ((done[j] + 1) * slots + q.quota[j] - 1) // q.quota[j] * 100000 + j END), lambda x: x IS NOT NULL)) % 100000) AS best
        FROM sched, q WHERE t < slots)),
plan AS (SELECT names[i] AS source, quota[i] AS quota, slots, turn, t - 1 AS slot FROM sched, q WHERE i IS NOT NULL),
ranked AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n FROM documents),
blocks AS (SELECT doc_id, source, n, n // 16 AS block FROM ranked)
SELECT doc_id, b.source, n, block, block // quota * slots + slot AS slot, block * slots // quota AS release,
       ((block + 1) * slots + quota - 1) // quota AS deadline
FROM blocks b JOIN plan p ON b.source = p.source AND b.block % p.quota = p.turn
"""


@query("op3_mixing", MIXING_SQL)
def mixing_slots(spark: SparkSession, folder: str) -> DataFrame:
    """Place of every document in the mixture, sources weighted by the square root of their size."""
    return mixing.placed(table(spark, folder, "documents"))


_SIDE = """(SELECT conv_id, list({{'r': role, 't': text}} ORDER BY turn) AS turns FROM conversations GROUP BY conv_id)"""
_RENDER = "array_to_string(list_transform({0}, lambda e: '<|' || e.r || '|>' || chr(10) || e.t || '<|end|>' || chr(10)), '')"
CHAT_SQL = f"""
WITH told AS {_SIDE.format()},
joint AS (SELECT a.conv_id // 2 AS pair_id, a.conv_id AS chosen_id, b.conv_id AS rejected_id, a.turns AS a, b.turns AS b
         FROM told a JOIN told b ON a.conv_id % 2 = 0 AND b.conv_id = a.conv_id + 1),
cut AS (SELECT *, CAST(coalesce(list_max(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[1:i] = b[1:i])), 0) AS BIGINT) AS k FROM joint),
parts AS (SELECT *, a[1:k] AS p, a[k + 1:len(a)] AS x, b[k + 1:len(b)] AS y FROM cut)
SELECT pair_id, chosen_id, rejected_id, k AS n_prompt_turns, {_RENDER.format('p')} AS prompt, {_RENDER.format('x')} AS chosen,
       {_RENDER.format('y')} AS rejected,
       CAST(list_sum(list_transform(list_filter(x, lambda t: t.r = 'assistant'), lambda t: length(t.t) + 8)) AS BIGINT) AS chosen_trained,
       CAST(list_sum(list_transform(list_filter(y, lambda t: t.r = 'assistant'), lambda t: length(t.t) + 8)) AS BIGINT) AS rejected_trained
FROM parts
"""


@query("op4_decontaminate")
def benchmark_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that cover half of a benchmark item or more."""
    found = decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.drop("digest")


@query("op5_ppm")
def scores(spark: SparkSession, folder: str) -> DataFrame:
    """Log probability of every document; those whose id's checksum leaves 2 modulo 7 are held out of training."""
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    found = ppm.scored(table(spark, folder, "documents"), train=~held_out)
    return found.withColumn("held_out", ~F.col("train")).drop("train")


@query("op6_chat_pairs", CHAT_SQL)
def preference(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbouring conversations as preference pairs; the masks are summed to characters trained on."""
    turns = table(spark, folder, "conversations")
    found = chat_pairs.preference_pairs(turns, chat_pairs.neighbour_pairs(turns))
    trained = lambda c: F.when(F.size(c) > 0, F.aggregate(c, F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"]))
    return found.select(
        "pair_id", "chosen_id", "rejected_id", "n_prompt_turns", "prompt", "chosen", "rejected",
        trained("chosen_mask").alias("chosen_trained"), trained("rejected_mask").alias("rejected_trained"),
    )


@query("op7_substring_dedup")
def repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of repeated chunks: where they stand, and the document that has them first."""
    return substring_dedup.repeats(table(spark, folder, "documents")).drop("row", "digest")


@query("op8_simhash")
def near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_groups(table(spark, folder, "documents"))
    return found.select("doc_id", simhash.digits("fp0").alias("fingerprint"), "component_id")


@query("op9_license_scan")
def licenses(spark: SparkSession, folder: str) -> DataFrame:
    """License phrases and notices of every document."""
    return license_scan.scanned(table(spark, folder, "documents"))


@query("op10_boosted_trees")
def quality_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document; labels of those whose id's checksum leaves 0 modulo 5 are held out of training."""
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    found = boosted_trees.scored(table(spark, folder, "documents"), table(spark, folder, "labels"), ~held_out)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


DIVERGENCE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT row) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT lang, source, coalesce(n, 0) AS n, coalesce(v, 0) AS v FROM (SELECT DISTINCT lang, source FROM d)
      LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL) USING (lang, source) LEFT JOIN v USING (lang)),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
        CAST(1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (g.n + 2 * g.v) AS BIGINT) AS p
      FROM g JOIN kept k USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, CAST(1 + 1000000000::HUGEINT * (n + 2) // (total + 2 * v) AS BIGINT) AS q
      FROM (SELECT lang, term, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY lang) AS total FROM c GROUP BY lang, term) JOIN v USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS BIGINT) AS value
          FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
all_pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
              LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT lang, source, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT lang, source, 'pair' AS part, item, value FROM all_pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM r QUALIFY part = 'pair' OR rank <= 10
"""


@query("op11_divergence", DIVERGENCE_SQL)
def source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """Distances between the sources of each language, and the terms that set a source apart."""
    return divergence.audit(table(spark, folder, "documents"))


@query("op12_importance")
def importance_draw(spark: SparkSession, folder: str) -> DataFrame:
    """Weight, score and place of every document, drawn towards the benchmark's words."""
    found = importance.resampled(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


@query("op13_permutation_index")
def nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The twenty nearest vectors of every twentieth one."""
    return permutation_index.neighbours(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)
