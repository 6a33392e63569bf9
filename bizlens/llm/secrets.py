"""Secret scan: candidates by shape, false positives removed by a random forest.

Everything is DataFrame expressions and Spark's own forest; no Python runs on executors.

1. *Candidates*: the runs of value characters of a word, split at quotes and
   assignment signs, of at least ``MIN_LEN`` characters in a word that holds a
   digit; and every quoted literal after a credential name, whatever its
   characters and length.
2. *Features*: length; character transitions (letter-digit, case, runs of
   consonants, share of hexadecimal digits, distinct characters); dictionary
   coverage (share of the letters that are words frequent in the corpus); path
   (slashes, dots, at signs, colons); neighbouring words, hashed into places.
3. *Labelled findings*: the caller's (doc_id, place, label), or the weak labels
   of ``weak_labels``: a quoted literal assigned to a credential name is a
   finding, an e-mail address, an IP address or a plain number is not; other
   candidates have no label.
4. *Forest*: fitted on labelled findings of documents outside the held-out fold
   (crc32 of the id modulo 5), at most about ``max_fit_rows`` by hash (a documented
   bound); every candidate of every document is scored.

The findings lie in clear text in the shared folder, since the result reads them:
delete that folder after use; the candidates are deleted when the findings are written.

Edge cases: null and empty texts have no candidates; a null doc_id or source is
kept; repeated rows give their findings once a row; without labels of both kinds
the weak label decides alone (score 1 or 0); empty tables give an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stored, words_column

MIN_LEN = 12
#: Documents a word must stand in to count as a dictionary word.
DICT_DOCS = 20
#: Hash places of each neighbouring word.
PLACES = 16
MAX_FIT_ROWS = 50_000
FOLDS = 5
# Names that credentials are assigned to.
NAMES = ("token", "secret", "password", "passwd", "pwd", "key", "apikey", "api_key", "access_key", "secret_key", "auth", "credential", "credentials", "bearer")
_EMAIL = r"^[^@\s]+@[^@\s]+\.[A-Za-z]+$"
_IP = r"^[0-9]{1,3}(\.[0-9]{1,3}){3}(:[0-9]+)?$"
_NUMBER = r"^[0-9][0-9.,:/-]*$"


_SIGN = r"(?:=>|:=|=|:)"
_NAME = r"(?<![A-Za-z])(?:" + "|".join(NAMES) + r")\\?[\"'`]?"
_RUN = r"[A-Za-z0-9][A-Za-z0-9+/_.@:-]*"
#: Runs of value characters: a padded literal, a name before a colon (not the four digits of an address), any other run with its padding.
_RUNS = (r"(?<=[\"'`])" + _RUN + r"={1,2}(?=[\"'`])"
         r"|(?![0-9A-Fa-f]{1,4}:)[A-Za-z][A-Za-z0-9_-]*(?=:(?!//))"
         r"|" + _RUN + r"(?:={1,2}(?![A-Za-z0-9+/_.@:=\"'`-]))?")


def _literal(before: str) -> str:
    """The characters of a literal up to its own kind of quote; ``before`` is what stands before the quote."""
    return "|".join(f"(?<={before}{q})[^{q}]+" for q in "\"'`")


#: A literal that a name of this word, or (``_NEXT``) of the words before, is assigned.
_HERE = "(?i:" + _literal(_NAME + _SIGN + r"\\?") + ")"
_NEXT = _literal(f"^{_SIGN}?" + r"\\?")


def _pieces(word: Column, pattern: str) -> Column:
    """Gaps (even places) and matches (odd places) of a word; words hold no line end."""
    return F.split(F.regexp_replace(word, pattern, "\n$0\n"), "\n")


def _holding(quote: str) -> Column:
    """Numbers of the words that hold ``quote``."""
    return F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.contains(F.get("w", i), F.lit(quote)))


def _next_of(at: str) -> Column:
    """For every word the least number in the column ``at`` that is not below its own; ends with the last."""
    return F.flatten(F.transform(at, lambda x, k: F.array_repeat(x, x - F.coalesce(F.get(at, k - 1), F.lit(-1)))))


def candidates(docs: DataFrame) -> DataFrame:
    """(row, doc_id, place, offset, value, quoted, assigned, before, before2, after): candidates with their neighbours.

    ``offset`` is the candidate's first character in its word; ``assigned`` marks
    a quoted literal after a credential name.  The name and the sign of an
    assignment are neighbours like words of their own.  A literal ends at its
    quote, however many words on; without one it is its first word.
    """
    d = docs.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", words_column(F.col("text")).alias("w")).where(F.size("w") > 0)
    # per kind of quote: the words that hold it, and for every word the next of those from it on
    kinds = dict(zip("\"'`", ("double", "single", "back")))
    d = d.withColumns({f"at_{n}": _holding(q) for q, n in kinds.items()})
    d = d.withColumns({f"next_{n}": _next_of(f"at_{n}") for n in kinds.values()})
    low = lambda i: F.coalesce(F.lower(F.get("w", i)), F.lit(""))
    lead = lambda i: F.regexp_extract(F.get("w", i), f"^{_SIGN}", 0)
    named = lambda i: F.get("w", i).rlike(f"^{_SIGN}?" + r"\\?[\"'`]") & F.rtrim(F.concat(low(i - 2), F.lit(" "), low(i - 1), F.lit(" "), lead(i))).rlike(_NAME + r"\s*" + _SIGN + "$")
    open_ = lambda i: F.get("w", i).rlike("[\"'`]") & (named(i) | F.get("w", i).rlike(_HERE))
    at = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: ((F.length(F.get("w", i)) >= MIN_LEN) & F.get("w", i).rlike("[0-9]")) | open_(i))
    # the words after one that may open a literal of several words, up to the next with such a quote: literals of one kind do not overlap
    closing = lambda i, n: F.get(f"next_{n}", i + 1)
    rest = lambda i, q, n: F.when(F.contains(F.get("w", i), F.lit(q)) & closing(i, n).isNotNull() & open_(i), F.array_join(F.slice("w", i + 2, closing(i, n) - i), " "))
    found = F.transform(at, lambda i: F.struct(
        i.cast("long").alias("place"), F.get("w", i).alias("raw"), named(i).alias("named"), *[rest(i, q, n).alias(f"rest_{n}") for q, n in kinds.items()],
        low(i - 1).alias("b1"), low(i - 2).alias("b2"), low(i + 1).alias("a1")))
    d = d.select("row", "doc_id", F.explode(found).alias("f")).select("row", "doc_id", "f.*")
    d = d.withColumn("p", F.when(F.col("named"), _pieces(F.col("raw"), f"{_NEXT}|{_HERE}|{_RUNS}")).otherwise(_pieces(F.col("raw"), f"{_HERE}|{_RUNS}")))
    d = d.where(F.size("p") > 1).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("p") - 1, F.lit(2))))
    part = lambda k: F.coalesce(F.get("p", k), F.lit(""))
    k = F.col("k")
    d = d.withColumns({"run": part(k), "gap": part(k - 1), "offset": F.aggregate(F.slice("p", 1, k), F.lit(0), lambda n, x: n + F.length(x))})
    head = F.substring(F.col("raw"), F.lit(1), F.col("offset"))
    quote = F.regexp_extract("gap", "([\"'`])$", 1)
    first = k == 1
    d = d.withColumn("quote", quote).withColumn("assigned", (F.col("quote") != "") & (
        (F.col("named") & first & head.rlike(f"^{_SIGN}?" + r"\\?[\"'`]$")) | head.rlike("(?i)" + _NAME + _SIGN + r"\\?[\"'`]$")))
    # a literal that its word does not close goes on to its quote in the words after
    more = F.when(F.col("assigned") & (k == F.size("p") - 2) & (part(k + 1) == ""),
                  F.coalesce(*[F.when(F.col("quote") == q, F.regexp_extract(f"rest_{n}", f"^([^{q}]*){q}", 1)) for q, n in kinds.items()], F.lit("")))
    d = d.withColumn("more", F.coalesce(more, F.lit("")))
    d = d.withColumn("value", F.regexp_replace(F.when(F.col("more") != "", F.concat("run", F.lit(" "), "more")).otherwise(F.col("run")), r"\\+$", ""))
    sign = F.regexp_replace("gap", "[\"'`\\\\]", "")
    split = first & (sign == "") & F.col("b1").rlike(r"[\p{L}\p{N}].*[=:]$") & (F.col("quote") != "")
    d = d.withColumns({
        "before": F.when(~first | (sign != ""), F.when(sign.rlike("[=:]"), sign).when(first, F.col("b1")).otherwise(sign)).when(split, F.regexp_extract("b1", _SIGN + "$", 0)).otherwise(F.col("b1")),
        "before2": F.when(~first, F.lower(part(k - 2))).when((sign != "") & sign.rlike("^[=:]"), F.col("b1")).when(split, F.regexp_replace("b1", _SIGN + "$", "")).otherwise(F.col("b2")),
        "after": F.when(k + 2 < F.size("p"), F.lower(part(k + 2))).otherwise(F.col("a1"))})
    name = part(k + 1).rlike("^\\\\?[\"'`]?[=:]")
    shaped = (F.length("value") >= MIN_LEN) & (F.col("value").rlike("[0-9]") | (F.col("raw").rlike("[0-9]") & ~name))
    return d.where((F.length("value") > 0) & (shaped | F.col("assigned"))).select(
        "row", "doc_id", "place", F.col("offset").cast("long").alias("offset"), "value", (F.col("quote") != "").alias("quoted"), "assigned", "before", "before2", "after")


def dictionary(docs: DataFrame, min_docs: int = DICT_DOCS) -> DataFrame:
    """Lower-case words of the corpus that stand in at least ``min_docs`` rows."""
    plain = F.array_distinct(F.filter(words_column(F.col("text")), lambda w: F.length(w).between(3, 12) & w.rlike("^[a-z]+$")))
    return docs.select(F.explode(plain).alias("word")).groupBy("word").count().where(F.col("count") >= min_docs).select("word")


FEATURES = ["length", "letter_digit", "digit_letter", "case", "consonants", "hex", "distinct", "coverage", "slashes", "dots", "ats", "colons"]


def featured(found: DataFrame, words: DataFrame) -> DataFrame:
    """``found`` with an array of features; ``uid`` tells its rows apart, also those of repeated documents."""
    n = F.length("value")
    share = lambda c: c / n
    pieces = found.select("uid", F.explode(F.regexp_extract_all(F.lower("value"), F.lit("[a-z]{3,}"), F.lit(0))).alias("word"))
    cover = pieces.join(words, "word").groupBy("uid").agg(F.sum(F.length("word")).alias("covered"))
    out = found.join(cover, "uid", "left").withColumns({
        "length": n.cast("double"),
        "letter_digit": share(F.regexp_count("value", F.lit("[A-Za-z](?=[0-9])"))),
        "digit_letter": share(F.regexp_count("value", F.lit("[0-9](?=[A-Za-z])"))),
        "case": share(F.regexp_count("value", F.lit("[a-z](?=[A-Z])"))),
        "consonants": share(F.regexp_count("value", F.lit("[bcdfghjklmnpqrstvwxzBCDFGHJKLMNPQRSTVWXZ]{4,}"))),
        "hex": share(F.length(F.regexp_replace("value", "[^0-9a-fA-F]", ""))),
        "distinct": share(F.size(F.array_distinct(F.split("value", "")))),
        "coverage": share(F.coalesce("covered", F.lit(0))),
        "slashes": share(F.regexp_count("value", F.lit("/"))), "dots": share(F.regexp_count("value", F.lit(r"\."))),
        "ats": share(F.regexp_count("value", F.lit("@"))), "colons": share(F.regexp_count("value", F.lit(":"))),
    })
    near = [F.when(F.pmod(F.xxhash64(F.regexp_replace(c, r"[^\p{L}=:]", "")), F.lit(PLACES)) == k, 1.0).otherwise(0.0)
            for c in ("before", "before2", "after") for k in range(PLACES)]
    return out.withColumn("features", F.array(*[F.col(c).cast("double") for c in FEATURES], *near))


def weak_labels(found: DataFrame) -> DataFrame:
    """``found`` with ``label``: 1, 0 or null by the rules in the module text."""
    assigned = F.col("assigned") | (F.col("quoted") & F.col("before").isin("=", ":", ":=") & F.regexp_replace("before2", r"[^\p{L}_]", "").isin(*NAMES))
    other = F.col("value").rlike(_EMAIL) | F.col("value").rlike(_IP) | F.col("value").rlike(_NUMBER)
    return found.withColumn("label", F.when(assigned, 1).when(other, 0))


def fit(labelled: DataFrame, max_fit_rows: int = MAX_FIT_ROWS, trees: int = 40, depth: int = 8, seed: int = 7) -> RandomForestClassificationModel | None:
    """A forest on rows (row, place, offset, features, label); None unless both labels occur."""
    rows = labelled.where("label IN (0, 1)")
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(counts) < 2:
        return None
    total = sum(counts.values())
    sample = rows.where(F.pmod(F.xxhash64("row", "place", "offset"), F.lit(total)) < max_fit_rows)
    # one partition of the bounded sample in a fixed order: the same forest on any cluster
    sample = sample.select("row", "place", "offset", array_to_vector("features").alias("features"), F.col("label").cast("double").alias("label"))
    sample = sample.repartition(1).sortWithinPartitions("row", "place", "offset").select("features", "label")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(sample)


def scan(docs: DataFrame, labels: DataFrame | None = None, min_docs: int = DICT_DOCS, max_fit_rows: int = MAX_FIT_ROWS, threshold: float = 0.5) -> DataFrame:
    """(doc_id, place, offset, value, length, label, score, is_secret) of every candidate.

    ``place`` is the candidate's word number and ``offset`` its place in the word;
    ``labels``: (doc_id, place, label) or (doc_id, place, offset, label) of reviewed
    findings, in place of the weak labels; without ``offset`` a label holds for
    every candidate of the word.
    """
    # numbered before they are written, so that the numbers stay
    found = stored(candidates(docs).withColumn("uid", F.monotonically_increasing_id()), "candidates")
    feats = weak_labels(featured(found, dictionary(docs, min_docs)))
    if labels is not None:
        key = ["doc_id", "place", *(["offset"] if "offset" in labels.columns else [])]
        feats = feats.withColumnRenamed("label", "weak").join(labels.select(*key, "label").dropDuplicates(key), key, "left")
    feats = stored(feats.select("row", "doc_id", "place", "offset", "value", "features", "label"), "findings")
    discard(found)  # holds secrets in clear text
    training = feats.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != 0)
    model = fit(training, max_fit_rows)
    if model is None:
        out = feats.withColumn("score", F.when(F.col("label") == 1, 1.0).otherwise(0.0))
    else:
        out = model.transform(feats.withColumnRenamed("features", "f").withColumn("features", array_to_vector("f")))
        out = out.withColumn("score", vector_to_array("probability")[1])
    return out.select("doc_id", "place", "offset", "value", F.length("value").cast("long").alias("length"), "label", "score", (F.col("score") >= threshold).alias("is_secret"))
