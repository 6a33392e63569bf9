"""Cross-site boilerplate lines by distinct-site spread.

A line (text between ``\\n``, without blanks, tabs and carriage returns at its
ends) is boilerplate when it stands on at least ``min_sites`` distinct sites.

1. A HyperLogLog sketch of the sites per line hash, merged by aggregation
   (map-side partial sketches; a line of any frequency costs one sketch a task).
2. Lines whose estimate is near the threshold (``margin``) get an exact
   distinct count; far estimates decide by themselves.
3. Every occurrence of a boilerplate line goes.  A document of which more than
   ``max_share`` of the characters would go, and whose lines that are not blank
   are those of another document (another doc_id) in the same order, is a copy
   of a whole text: it is left whole, for the document-level stages to judge
   (``whole_copy`` is true).

Boilerplate lines are joined back in ``SALTS`` copies each, so the occurrences
of one very common line are dealt to as many tasks.

Edge cases: blank lines are never counted or removed; null text is an empty
text (``text`` stays null); a null site counts for no line, yet its documents
are cleaned; repeated rows and null doc_ids are kept as rows; an empty table
gives an empty result; extra columns pass through, but for those named like an
added one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_SITES = 10
MARGIN = 0.25
MAX_SHARE = 0.5
#: log2 of the sketch's registers: standard error 1.6 %, far inside the margin.
LG_K = 12
_ENDS = " \t\r"
#: Columns that the operator adds; columns of these names in the input are replaced.
ADDED = ("n_lines", "n_removed", "whole_copy")
#: Tasks that share the occurrences of one line.
SALTS = 32


def _norm(line: Column) -> Column:
    return F.btrim(line, F.lit(_ENDS))


#: 128 bits that stand for a row, in two columns.
ROW = ("r", "q")


def _row_key(text: str) -> list[Column]:
    return [F.xxhash64(F.col("doc_id"), F.col(text)).alias("r"), F.xxhash64(F.lit("q"), F.col(text), F.col("doc_id")).alias("q")]


def line_keys(docs: DataFrame, site: str, text: str = "text") -> DataFrame:
    """(r, q, site, pos, a, b) of every line that is not blank; (a, b) is its 96-bit key."""
    # the row's key is made before its lines are, not once a line
    rows = docs.select(*_row_key(text), F.col(site).alias("site"), F.split(text, "\n").alias("lines"))
    lines = rows.select(*ROW, "site", F.posexplode("lines").alias("pos", "line"))
    lines = lines.select(*ROW, "site", "pos", _norm(F.col("line")).alias("line")).where(F.length("line") > 0)
    return lines.select(*ROW, "site", "pos", F.xxhash64("line").alias("a"), F.hash("line").alias("b"))


def _standing(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``lines`` whose line is in ``keys`` (distinct, few beside the lines)."""
    salt = F.pmod(F.xxhash64("r", "pos"), F.lit(SALTS)).cast("int").alias("salt")
    salted = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return lines.withColumn("salt", salt).join(salted, ["a", "b", "salt"], "left_semi").drop("salt")


def boilerplate(docs: DataFrame, site: str = "source", text: str = "text", min_sites: int = MIN_SITES, margin: float = MARGIN) -> DataFrame:
    """(a, b) hashes of the lines on at least ``min_sites`` sites."""
    lines = line_keys(docs, site, text)
    spread = lines.where("site IS NOT NULL").groupBy("a", "b").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"))
    far = spread.where(F.col("sites") >= min_sites * (1 - margin))  # the rest is below the threshold beyond the sketch's error
    sure = far.where(F.col("sites") > min_sites * (1 + margin)).select("a", "b")
    near = far.where(F.col("sites") <= min_sites * (1 + margin)).select("a", "b")
    exact = (_standing(lines.where("site IS NOT NULL"), near).select("a", "b", "site").distinct()
             .groupBy("a", "b").count().where(F.col("count") >= min_sites).select("a", "b"))
    return sure.unionAll(exact)


def copied(docs: DataFrame, text: str = "text") -> DataFrame:
    """(r, q) of the documents whose lines, blank ones aside, stand in the same order in a document of another id."""
    lines = F.filter(F.transform(F.split(text, "\n"), _norm), lambda x: F.length(x) > 0)
    own = docs.select(*_row_key(text), lines.alias("lines")).where(F.size("lines") > 0)
    # rows of one doc_id and text are one document; the ends of a group tell whether it has two
    own = own.select(*ROW, F.xxhash64("lines").alias("a"), F.hash("lines").alias("b"), F.size("lines").alias("n"))
    twice = own.groupBy("a", "b", "n").agg(F.min("r").alias("lo"), F.max("r").alias("hi")).where("lo < hi").select("a", "b", "n")
    return own.join(twice, ["a", "b", "n"], "left_semi").select(*ROW).distinct()


def remove_boilerplate(docs: DataFrame, site: str = "source", text: str = "text", min_sites: int = MIN_SITES,
                       margin: float = MARGIN, max_share: float = MAX_SHARE) -> DataFrame:
    """``docs`` with boilerplate lines removed from ``text``, plus n_lines, n_removed and whole_copy."""
    hits = (_standing(line_keys(docs, site, text), boilerplate(docs, site, text, min_sites, margin))
            .groupBy(*ROW).agg(F.collect_set("pos").alias("hit")))
    hits = hits.join(copied(docs, text).withColumn("copy", F.lit(True)), list(ROW), "left")
    # the lines stand for the text from here on: below a join they are a column, which no lambda splits again
    others = [c for c in docs.columns if c != text]
    rows = docs.select(*_row_key(text), F.struct(F.lit(0), *[F.col(f"`{c}`") for c in others]).alias("doc"), F.split(text, "\n").alias("lines")).join(hits, list(ROW), "left")
    gone = F.aggregate(F.coalesce("hit", F.array().cast("array<int>")), F.lit(0), lambda n, p: n + F.length(F.element_at("lines", p + 1)))
    chars = F.aggregate("lines", F.lit(0), lambda n, x: n + F.length(x))
    rows = rows.withColumn("whole", F.coalesce((gone > max_share * chars) & F.col("copy"), F.lit(False)))
    act = F.col("hit").isNotNull() & ~F.col("whole")
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "hit")  # hashed: no search of the hits for every line
    kept = F.array_join(F.transform(left, lambda p: F.element_at("lines", p + 1)), "\n")
    return rows.select(
        *[F.when(act, kept).otherwise(F.array_join("lines", "\n")).alias(c) if c == text else F.col(f"doc.`{c}`").alias(c) for c in docs.columns if c not in ADDED],
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"), F.when(act, F.size("hit")).otherwise(0).cast("long").alias("n_removed"), F.col("whole").alias("whole_copy"))


#: DuckDB twin of ``remove_boilerplate`` with plain distinct counts: a SELECT over ``{docs}``.
SQL = """
WITH split AS (SELECT doc_id, text, source, row_number() OVER () AS r, coalesce(string_split(text, chr(10)), []) AS lines FROM {docs}),
ln AS (SELECT r, source, unnest(range(len(lines))) AS pos, unnest(lines) AS raw FROM split),
nl AS (SELECT r, source, pos, raw, trim(raw, ' ' || chr(9) || chr(13)) AS line FROM ln WHERE trim(raw, ' ' || chr(9) || chr(13)) <> ''),
bp AS (SELECT line FROM nl GROUP BY line HAVING count(DISTINCT source) >= {min_sites}),
hit AS (SELECT r, list(pos) AS hit, sum(length(raw)) AS gone FROM nl WHERE line IN (SELECT line FROM bp) GROUP BY r),
body AS (SELECT r, string_agg(line, chr(10) ORDER BY pos) AS body FROM nl GROUP BY r),
twice AS (SELECT body FROM body JOIN split USING (r) GROUP BY body HAVING count(DISTINCT coalesce(CAST(doc_id AS VARCHAR), '-') || '|' || text) > 1),
j AS (SELECT s.*, h.hit, coalesce(b.body IN (SELECT body FROM twice), false)
             AND coalesce(h.gone, 0) > {max_share} * coalesce(list_sum(list_transform(s.lines, lambda x: length(x))), 0) AS whole_copy
      FROM split s LEFT JOIN hit h USING (r) LEFT JOIN body b USING (r))
SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines,
       CAST(CASE WHEN hit IS NOT NULL AND NOT whole_copy THEN len(hit) ELSE 0 END AS BIGINT) AS n_removed, whole_copy,
       CASE WHEN hit IS NOT NULL AND NOT whole_copy
            THEN array_to_string(list_filter(lines, lambda x, i: NOT list_contains(hit, i - 1)), chr(10)) ELSE text END AS text
FROM j
"""


def sql(docs: str = "documents", min_sites: int = MIN_SITES, max_share: float = MAX_SHARE) -> str:
    return SQL.format(docs=docs, min_sites=min_sites, max_share=max_share)
