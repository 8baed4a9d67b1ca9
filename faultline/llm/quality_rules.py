"""Quality rules: base counts of each text, and a hashed n-gram log-likelihood ratio between a trusted target and the corpus.

Tokens are runs of letters and digits, and runs of other characters that aren't white space. Single tokens and pairs fall into
BUCKETS hash buckets. Two smoothed multinomials over the buckets, one of the documents labelled good and one of all documents,
give each bucket a weight in millionths of a nat; the mean weight of a text's n-grams must reach a fixed threshold. Weights and
sums are whole numbers, so a verdict never depends on the order of additions. All of it is DataFrame work.

Defined results: a null or empty text has no words, so all counts are 0, base_failed is true and kept false. Repeated rows give
repeated results. Without any trusted text every weight is 0, so the base rules decide. An empty table gives an empty one.
Other columns aren't read by `verdicts`; `keep_good` passes them on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import common

#: The base rules.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
#: N-grams are hashed to this many hexadecimal digits of their MD5, so there are 4096 buckets.
DIGITS = 3
BUCKETS = 16**DIGITS
#: Added to every bucket's count.
SMOOTHING = 1
#: Least mean weight of a text's n-grams that is kept, in millionths of a nat.
THRESHOLD = -250_000
#: Up to so many trusted ids (8 bytes each) are broadcast; more meet the documents in a shuffle.
BROADCAST_IDS = 500_000
WORD = r"[^\x20\x09-\x0D]+"
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]+"


def base_counts(rows: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed to rows with a text."""
    gap = F.lit(common.GAPS)
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, gap) != "")
    rows = rows.withColumn("_w", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    rows = rows.withColumn("n_words", F.size("_w").cast("long")).withColumn("_l", lines)
    windows = F.when(
        F.col("n_words") >= 3,
        F.transform(
            F.sequence(F.lit(0), F.size("_w") - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))
        ),
    ).otherwise(F.array().cast("array<long>"))
    rows = rows.withColumn("_g", windows)
    # sorted (window, place) pairs, only where some window is found twice
    sorted_windows = F.when(
        F.size(F.array_distinct("_g")) < F.size("_g"),
        F.sort_array(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i")))),
    ).otherwise(F.array().cast("array<struct<g:long,i:int>>"))
    rows = rows.withColumn("_s", sorted_windows)
    again = F.filter(
        "_s",
        lambda s, k: F.coalesce(
            (F.get("_s", k + 1)["g"] == s["g"]) | ((k > 0) & (F.get("_s", F.greatest(k - 1, F.lit(0)))["g"] == s["g"])),
            (k > 0) & (F.get("_s", F.greatest(k - 1, F.lit(0)))["g"] == s["g"]),
        ),
    )
    rows = rows.withColumn("_r", again)
    covered = F.flatten(F.transform("_r", lambda s: F.array(s["i"], s["i"] + 1, s["i"] + 2)))
    rows = rows.withColumns(
        {
            "word_chars": F.length(F.translate("text", common.GAPS, "")).cast("long"),
            "n_symbols": (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "n_repeat_words": F.size(F.array_distinct(covered)).cast("long"),
        }
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return rows.withColumn("base_failed", failed).drop("_w", "_l", "_g", "_s", "_r")


def hashed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, buckets): the hashed n-grams of each text, computed once and read twice."""
    rows = common.texts(docs).select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    rows = rows.select("doc_id", "text_key", F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)).alias("_t"))
    pairs = F.zip_with("_t", F.slice("_t", F.lit(2), F.size("_t")), lambda a, b: F.concat(a, F.lit(" "), b))
    # the last token has no pair
    rows = rows.select("doc_id", "text_key", "_t", F.slice(pairs, F.lit(1), F.greatest(F.size("_t") - 1, F.lit(0))).alias("_p"))

    def bucket(gram: Column) -> Column:
        return F.conv(F.substring(F.md5(gram.cast("binary")), 1, DIGITS), 16, 10).cast("smallint")

    return common.store(rows.select("doc_id", "text_key", F.transform(F.concat("_t", "_p"), bucket).alias("buckets")), "grams")


def weights(grams: DataFrame, trusted: DataFrame) -> DataFrame:
    """(bucket, weight) from all documents and those whose doc_id is in `trusted`: BUCKETS rows at most."""
    ids = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    rows = grams.join(ids.withColumn("good", F.lit(1)), "doc_id", "left")
    rows = rows.select(F.coalesce("good", F.lit(0)).alias("good"), F.explode("buckets").alias("bucket"))
    counts = rows.groupBy("bucket", "good").agg(F.count("*").alias("n"))
    counts = counts.groupBy("bucket").agg(F.sum("n").alias("raw"), F.sum(F.col("n") * F.col("good")).alias("target"))
    totals = counts.agg(F.sum("raw").alias("all_raw"), F.sum("target").alias("all_target"))

    def share(n: str, total: str) -> Column:
        return F.ln((F.col(n) + SMOOTHING).cast("double") / (F.col(total) + SMOOTHING * BUCKETS).cast("double"))

    ratio = F.round(1_000_000 * (share("target", "all_target") - share("raw", "all_raw"))).cast("long")
    # one row of totals
    return counts.crossJoin(F.broadcast(totals)).select(
        "bucket", F.when(F.col("all_target") > 0, ratio).otherwise(F.lit(0).cast("long")).alias("weight")
    )


def scored(grams: DataFrame, table: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_grams, ratio): rows with the same id and text are scored together, which leaves their mean as it is."""
    rows = grams.select("doc_id", "text_key", F.explode("buckets").alias("bucket"))
    found = rows.join(F.broadcast(table), "bucket")
    return found.groupBy("doc_id", "text_key").agg(F.count("*").alias("n_grams"), F.sum("weight").alias("ratio"))


def verdicts(docs: DataFrame, trusted: DataFrame, *carry: str) -> DataFrame:
    """One row per document with the base counts and `kept`; `carry` names input columns to pass on."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.struct(*[F.col(common.quoted(c)) for c in carry]).alias("_row") if carry else F.lit(None).alias("_row"),
    )
    base = base_counts(rows).withColumn("text_key", F.xxhash64("text")).drop("text")
    grams = hashed(docs)
    table = common.store(weights(grams, trusted), "weights")
    score = scored(grams, table).withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
    joined = base.join(score, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    good = F.coalesce(F.col("ratio") >= THRESHOLD * F.col("n_grams"), F.lit(False))
    # one condition on both sides of the join: a filter on it stays above the join, so the array work below isn't done twice
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(good)
    return joined.withColumn("kept", kept).drop("_id", "_key", "text_key")


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def keep_good(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """The rows of documents that pass base rules and method, with all their columns."""
    return verdicts(docs, trusted, *docs.columns).filter("kept").select("_row.*")


def trusted_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of documents labelled good."""
    return common.read(spark, folder, "labels").filter("quality = 1").select("doc_id")


def op2_quality_ratio(spark: SparkSession, folder: str) -> DataFrame:
    found = verdicts(common.read(spark, folder, "documents"), trusted_ids(spark, folder))
    return found.select("doc_id", *COUNTS, "base_failed", "kept")


ORACLE_VERDICTS = r"""
  d0 AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
  w0 AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
                list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d0),
  g0 AS (SELECT r, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS g
         FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w0)),
  again AS (SELECT r, i FROM g0 QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
  rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY r),
  b0 AS (SELECT w0.r, doc_id, len(w)::BIGINT AS n_words,
                length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
                length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
                (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
         FROM w0 LEFT JOIN rep USING (r)),
  t0 AS (SELECT r, doc_id, regexp_extract_all(text, '[\pL\pN]+|[^\pL\pN\x20\x09-\x0D]+') AS t FROM d0),
  grams AS (SELECT r, doc_id, substr(md5(g), 1, 3) AS bucket FROM (
              SELECT r, doc_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS g FROM t0)),
  c0 AS (SELECT bucket, count(*) AS raw, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS target
         FROM grams GROUP BY bucket),
  s0 AS (SELECT sum(raw) AS all_raw, sum(target) AS all_target FROM c0),
  wt AS (SELECT bucket, CASE WHEN all_target > 0 THEN round(1000000 * (ln((target + 1)::DOUBLE / (all_target + 4096)::DOUBLE)
                - ln((raw + 1)::DOUBLE / (all_raw + 4096)::DOUBLE)))::BIGINT ELSE 0 END AS weight FROM c0, s0),
  sc AS (SELECT r, count(*) AS n_grams, sum(weight) AS ratio FROM grams JOIN wt USING (bucket) GROUP BY r),
  v0 AS (SELECT r, doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
                n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
                coalesce(ratio >= -250000 * n_grams, false) AS good FROM b0 LEFT JOIN sc USING (r))
"""
ORACLE = f"""WITH {ORACLE_VERDICTS}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, good AND NOT base_failed AS kept FROM v0"""
