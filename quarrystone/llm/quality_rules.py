"""Quality rules combined by weak supervision, on DataFrame functions only.

Seven rules look at a text and vote keep (1), reject (-1) or abstain (0).  The votes of all
documents are counted by pattern (3**7 patterns at most, whatever the input), and
expectation-maximisation over those counts estimates, for every rule, how often it votes keep
on good and reject on bad documents, and the share of good documents.  A document's posterior
probability of being good decides; no rule vetoes alone, but for the stated base conditions.

Defined results: a null or empty text has no words, fails the base and is not kept; repeated
rows each give their row; an empty table gives an empty result; columns other than the id and
the text are ignored, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, words_column

WINDOW = 5
RULES = ("length", "word_length", "symbols", "dense_symbols", "shouting", "lines", "repeats")
STEPS = 25
#: Start of the estimation: share of good documents, P(keep vote | good), P(reject vote | bad).
START = (0.85, 0.98, 0.45)
#: Bounds of the two rates, so that no rule ever has infinite weight.
LOW, HIGH = 0.02, 0.998
KEEP_AT = 0.5


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts per document, in the input's partitions: no shuffle, no Python.

    Windows of five words are compared by 64-bit hash within one text only.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    d = d.select("doc_id", "_t", words_column("_t").alias("_w"), F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"))
    n = F.size("_w")
    d = d.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(F.regexp_replace("_t", SPACE_CLASS, "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("_t", F.lit("!")).cast("long").alias("n_shouts"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get("_w", i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>")).alias("_h"),
    )
    # Only texts with a repeated window pay for the sort; each array is a column of its own, as a lambda evaluates what it holds once an element.
    d = d.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    d = d.withColumn("_p", F.sort_array(F.transform(F.filter("_s", lambda x, k: F.coalesce((F.when(k > 0, F.get("_s", k - 1)["h"]) == x["h"]), F.lit(False)) | F.coalesce(F.get("_s", k + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"])))
    covered = F.aggregate(F.transform("_p", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_p", k + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_shouts", "n_lines", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def votes() -> dict[str, Column]:
    """Each rule's vote, from integer comparisons of the counts."""
    w, c = F.col("n_words"), F.col

    def rule(reject: Column, keep: Column) -> Column:
        return F.when(reject, -1).when(keep, 1).otherwise(0)

    return {
        "length": rule(w < 10, w >= 50),
        "word_length": rule((c("word_chars") < 2 * w) | (c("word_chars") > 15 * w), (c("word_chars") >= 3 * w) & (c("word_chars") <= 12 * w)),
        "symbols": rule(20 * c("n_symbols") > w, 200 * c("n_symbols") <= w),
        "dense_symbols": rule(10 * c("n_symbols") > w, c("n_symbols") == 0),
        "shouting": rule(10 * c("n_shouts") > w, 100 * c("n_shouts") <= w),
        "lines": rule(2 * c("n_dup_lines") > c("n_lines"), (c("n_dup_lines") == 0) & (c("n_lines") >= 2)),
        "repeats": rule(100 * c("n_repeat_words") > 20 * w, (100 * c("n_repeat_words") <= 2 * w) & (w >= 10)),
    }


def estimate(voted: DataFrame) -> DataFrame:
    """Expectation-maximisation over the counts of vote patterns, as one SQL expression on one row.

    One row: prior, keep rates on good and reject rates on bad documents; none without documents.
    """
    m = len(RULES)
    patterns = voted.groupBy(*RULES).agg(F.count(F.lit(1)).cast("double").alias("n"))
    row = patterns.agg(F.array_sort(F.collect_list(F.struct(F.array(*RULES).alias("v"), "n"))).alias("ps")).select("ps", F.aggregate("ps", F.lit(0.0), lambda a, p: a + p["n"]).alias("total"))

    def state(prior, good, bad):
        return F.struct(prior.alias("prior"), good.alias("good"), bad.alias("bad"))

    def step(s, _):
        weighed = F.transform("ps", lambda p: F.struct(p["v"].alias("v"), p["n"].alias("n"), (p["n"] * posterior(p["v"], s["prior"], s["good"], s["bad"])).alias("g")))
        sums = F.aggregate(
            weighed,
            F.array(*[F.lit(0.0)] * (1 + 4 * m)),
            lambda a, p: F.array(
                a[0] + p["g"],
                *[a[1 + j] + F.when(p["v"][j] == 1, p["g"]).otherwise(0.0) for j in range(m)],
                *[a[1 + m + j] + F.when(p["v"][j] != 0, p["g"]).otherwise(0.0) for j in range(m)],
                *[a[1 + 2 * m + j] + F.when(p["v"][j] == -1, p["n"] - p["g"]).otherwise(0.0) for j in range(m)],
                *[a[1 + 3 * m + j] + F.when(p["v"][j] != 0, p["n"] - p["g"]).otherwise(0.0) for j in range(m)],
            ),
            lambda a: state(clip((a[0] + 1) / (F.col("total") + 2)), F.array(*[clip((a[1 + j] + 1) / (a[1 + m + j] + 2)) for j in range(m)]), F.array(*[clip((a[1 + 2 * m + j] + 1) / (a[1 + 3 * m + j] + 2)) for j in range(m)])),
        )
        return sums

    start = state(F.lit(START[0]), F.array(*[F.lit(START[1])] * m), F.array(*[F.lit(START[2])] * m))
    return row.filter("total > 0").select(F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step).alias("s")).select("s.*")


def clip(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(LOW)), F.lit(HIGH))


def posterior(v, prior, good, bad) -> Column:
    """Probability of a good document, given its votes; abstentions say nothing."""
    odds = F.log(prior / (1 - prior))
    for j in range(len(RULES)):
        odds = odds + F.when(v[j] == 1, F.log(good[j] / (1 - bad[j]))).when(v[j] == -1, F.log((1 - good[j]) / bad[j])).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, votes and posterior per document, and the verdict: base conditions, then posterior >= 0.5.

    The counts, small rows, are shuffled once, as both the estimate and the result read them: what deals
    them names all their columns, so both need the same ones and share the exchange.
    """
    counts = features(docs, id_col, text_col).withColumn("_part", F.spark_partition_id())
    counts = counts.repartition(F.xxhash64(*counts.columns))
    voted = counts.select("*", *[v.alias(k) for k, v in votes().items()])
    # The state is one row.
    voted = voted.drop("_part").join(F.broadcast(estimate(voted)), F.lit(True))
    p = posterior([F.col(r) for r in RULES], F.col("prior"), [F.col("good")[j] for j in range(len(RULES))], [F.col("bad")[j] for j in range(len(RULES))])
    w = F.col("n_words")
    failed = (w < 10) | (100 * F.col("n_repeat_words") > 20 * w)
    return voted.withColumn("posterior", p).withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("posterior") >= KEEP_AT)).drop("prior", "good", "bad")


def query(spark, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")




def _oracle() -> str:
    """The same counts, estimation and verdict as DuckDB SQL, the estimation as a recursive table of its steps."""
    rules = {
        "length": ("n_words < 10", "n_words >= 50"),
        "word_length": ("word_chars < 2 * n_words OR word_chars > 15 * n_words", "word_chars >= 3 * n_words AND word_chars <= 12 * n_words"),
        "symbols": ("20 * n_symbols > n_words", "200 * n_symbols <= n_words"),
        "dense_symbols": ("10 * n_symbols > n_words", "n_symbols = 0"),
        "shouting": ("10 * n_shouts > n_words", "100 * n_shouts <= n_words"),
        "lines": ("2 * n_dup_lines > n_lines", "n_dup_lines = 0 AND n_lines >= 2"),
        "repeats": ("100 * n_repeat_words > 20 * n_words", "100 * n_repeat_words <= 2 * n_words AND n_words >= 10"),
    }
    names = ", ".join(f'"{r}"' for r in rules)
    odds = "ln(s.prior / (1 - s.prior))" + "".join(f""" + CASE WHEN "{r}" = 1 THEN ln(s.good[{j}] / (1 - s.bad[{j}])) WHEN "{r}" = -1 THEN ln((1 - s.good[{j}]) / s.bad[{j}]) ELSE 0 END""" for j, r in enumerate(rules, 1))
    post = f"1 / (1 + exp(-({odds})))"
    clip = f"least(greatest(%s, {LOW}), {HIGH})"
    good = ", ".join(clip % f"""(sum(CASE WHEN "{r}" = 1 THEN g ELSE 0 END) + 1) / (sum(CASE WHEN "{r}" <> 0 THEN g ELSE 0 END) + 2)""" for r in rules)
    bad = ", ".join(clip % f"""(sum(CASE WHEN "{r}" = -1 THEN n - g ELSE 0 END) + 1) / (sum(CASE WHEN "{r}" <> 0 THEN n - g ELSE 0 END) + 2)""" for r in rules)
    votes_sql = ", ".join(f'CASE WHEN {a} THEN -1 WHEN {b} THEN 1 ELSE 0 END AS "{r}"' for r, (a, b) in rules.items())
    m = len(rules)
    return rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT k, unnest(range(1, len(w) - 3)) AS i, w FROM w WHERE len(w) >= 5),
h AS (SELECT k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] AS s FROM g),
p AS (SELECT k, i FROM h QUALIFY count(*) OVER (PARTITION BY k, s) > 1),
q AS (SELECT k, count(DISTINCT i + o) AS n FROM p, (SELECT unnest([0, 1, 2, 3, 4]) AS o) GROUP BY k),
c AS (SELECT d.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(length(t) - length(replace(t, '!', '')) AS BIGINT) AS n_shouts,
             CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(q.n, 0) AS BIGINT) AS n_repeat_words
      FROM d JOIN w USING (k) LEFT JOIN q USING (k)),
v AS (SELECT *, {votes_sql} FROM c),
patterns AS (SELECT {names}, CAST(count(*) AS DOUBLE) AS n FROM v GROUP BY ALL),
states AS (
  SELECT 0 AS step, CAST({START[0]} AS DOUBLE) AS prior, list_transform(range({m}), lambda x: CAST({START[1]} AS DOUBLE)) AS good, list_transform(range({m}), lambda x: CAST({START[2]} AS DOUBLE)) AS bad
  UNION ALL
  SELECT step + 1, {clip % "(sum(g) + 1) / (sum(n) + 2)"}, [{good}], [{bad}]
  FROM (SELECT s.step, patterns.*, n * {post} AS g FROM states s, patterns WHERE s.step < {STEPS}) GROUP BY step),
f AS (SELECT * FROM states WHERE step = {STEPS}),
r AS (SELECT v.*, {post} AS posterior, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM v, f s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND posterior >= {KEEP_AT} AS kept FROM r
"""


ORACLE_SQL = _oracle()
