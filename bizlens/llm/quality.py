"""Quality rules at host level, in DataFrame expressions only.

Per document: word counts, symbol characters, repeated lines and words inside
8-word windows that occur at least twice.  Per host (``source``): the failures
of every rule are summed; an empirical beta prior per rule, from the moments
of the host rates, shrinks each host's rate towards the corpus, so a host with
few documents is not judged by one of them.  A host whose shrunk rate exceeds
``max_rate`` for any rule is rejected; its documents take that verdict.

Features are written once to the shared folder; hosts are aggregated from them
with map-side sums (a host of any size costs one row a task), and only the four
pairs of prior moments reach the driver.

Edge cases: null text has no words; a null host is a host of its own; repeated
rows count as often as they stand; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, words_column

WINDOW = 8
MAX_RATE = 0.5
MIN_WORDS, MAX_REPEAT_PCT = 20, 30
#: Host rules: name -> SQL condition over the features (a failed document).
RULES = {
    "short": f"n_words < {MIN_WORDS}",
    "repeats": f"100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "dup_lines": "10 * n_dup_lines > 3 * n_lines",
}
_SPACE = " \t\n\x0b\f\r"
_SYMBOLS = "#*$%&|<>"


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words)."""
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", "source", text.alias("text"))
    d = d.withColumns({
        "words": words_column(F.col("text")),
        "lines": F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(_SPACE)) != ""),
    })
    d = d.select(
        "doc_id", "source", F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", _SPACE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hw"))
    places = F.when(F.size("hw") >= WINDOW, F.sequence(F.lit(0), F.size("hw") - WINDOW)).otherwise(F.array().cast("array<int>"))
    d = d.withColumn("win", F.transform(places, lambda i: F.xxhash64(*[F.get("hw", i + k) for k in range(WINDOW)]))).drop("hw")
    same = F.size(F.array_distinct("win")) == F.size("win")
    d = d.withColumn("order", F.when(~same, F.array_sort(F.transform("win", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("win")
    twice = F.filter("order", lambda x, j: (x["h"] == F.get("order", j - 1)["h"]) | (x["h"] == F.get("order", j + 1)["h"]))
    d = d.withColumn("twice", F.array_sort(F.transform(twice, lambda x: x["i"]))).drop("order")
    cover = F.transform("twice", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get("twice", j + 1) - p, F.lit(WINDOW))))
    return d.withColumn("n_repeat_words", F.coalesce(F.aggregate(cover, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))).drop("twice")


def host_verdicts(feats: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """(source, n_docs, rate_<rule>..., host_rejected): shrunk failure rates of every host."""
    hosts = feats.groupBy("source").agg(F.count("*").alias("n"), *[F.sum(F.expr(c).cast("long")).alias(r) for r, c in RULES.items()])
    rate = {r: F.col(r) / F.col("n") for r in RULES}
    sums = hosts.agg(F.sum("n").alias("n"), *[F.sum(r).alias(r) for r in RULES],
                     *[F.sum(F.col("n") * rate[r] * rate[r]).alias(f"{r}_sq") for r in RULES]).first()
    out = hosts
    n = sums["n"] or 1
    for r in RULES:
        mean = (sums[r] or 0) / n
        var = max((sums[f"{r}_sq"] or 0.0) / n - mean * mean, 0.0)
        strength = min(max(mean * (1 - mean) / var - 1, 1.0), 1e6) if var > 1e-12 else 1e6
        out = out.withColumn(f"rate_{r}", (F.col(r) + mean * strength) / (F.col("n") + strength))
    bad = F.lit(False)
    for r in RULES:
        bad = bad | (F.col(f"rate_{r}") > max_rate)
    return out.select("source", F.col("n").alias("n_docs"), *[f"rate_{r}" for r in RULES], bad.alias("host_rejected"))


def judge(docs: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """Features, base verdict, host rates and ``kept`` of every document."""
    feats = stored(features(docs), "quality")
    hosts = host_verdicts(feats, max_rate).withColumnRenamed("source", "_host")
    out = feats.join(hosts, F.col("source").eqNullSafe(F.col("_host")), "left").drop("_host")
    base = F.expr(f"({RULES['short']}) OR ({RULES['repeats']})")
    return out.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def sql(max_rate: float = MAX_RATE) -> str:
    """DuckDB twin of the digest (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)."""
    sums = ", ".join(f"sum(CASE WHEN {c} THEN 1 ELSE 0 END) AS {r}" for r, c in RULES.items())
    prior = ", ".join(f"sum({r}) / sum(n) AS m_{r}, greatest(sum(n * ({r} / n) * ({r} / n)) / sum(n) - (sum({r}) / sum(n)) * (sum({r}) / sum(n)), 0) AS v_{r}" for r in RULES)
    power = ", ".join(f"m_{r}, CASE WHEN v_{r} > 1e-12 THEN least(greatest(m_{r} * (1 - m_{r}) / v_{r} - 1, 1.0), 1e6) ELSE 1e6 END AS s_{r}" for r in RULES)
    bad = " OR ".join(f"(h.{r} + m_{r} * s_{r}) / (h.n + s_{r}) > {max_rate}" for r in RULES)
    return f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM t),
win AS (SELECT r, unnest(range(1, len(words) - {WINDOW - 2})) AS p, words FROM w WHERE len(words) >= {WINDOW}),
g AS (SELECT r, p, list_slice(words, p, p + {WINDOW - 1}) AS g FROM win),
dup AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1),
rep AS (SELECT r, sum(least({WINDOW}, coalesce(nx - p, {WINDOW}))) AS n_repeat_words
        FROM (SELECT r, p, lead(p) OVER (PARTITION BY r ORDER BY p) AS nx FROM dup) GROUP BY r),
f AS (SELECT doc_id, source, CAST(len(words) AS BIGINT) AS n_words,
             CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN rep USING (r)),
h AS (SELECT source, count(*) AS n, {sums} FROM f GROUP BY source),
pr AS (SELECT {prior} FROM h), ps AS (SELECT {power} FROM pr),
v AS (SELECT h.source, ({bad}) AS host_rejected FROM h, ps),
b AS (SELECT f.*, ({RULES['short']}) OR ({RULES['repeats']}) AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT host_rejected AS kept
FROM b JOIN v ON b.source IS NOT DISTINCT FROM v.source
"""
