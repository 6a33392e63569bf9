"""Business-name and address text rules as native Column expressions.

Every function maps a string Column to a Column; nothing runs in a Python
worker, so the chains compile into whole-stage codegen next to the scan.

Regex notes (Java regex inside Spark, written to reproduce Python ``re``):
* Python's ``\\s`` on text is Unicode whitespace including U+001C..U+001F;
  Java's ``(?U)\\s`` lacks those four, hence ``[\\s\\x1c-\\x1f]`` under ``(?U)``.
* Python's ``\\w`` is letters, digits and ``_``: written ``[\\p{L}\\p{N}_]``.
* Spark's ``trim`` removes only U+0020, so ``py_strip`` strips by regex.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference rules; natural order as written there)
# ---------------------------------------------------------------------------
# Corporate-marker and temporary-licence literals removed from names, in order.
CORP_MARKERS = ["(주)", "( 주)", "(주", "주)", "( 주"]
CORP_WORD = "주식회사"
TEMP_MARKERS = ["-한시적", " -한시적", "(한시적)"]
# Branch suffixes: a trailing word ending in one of these is a branch name.
BRANCH_SUFFIX = "(지점|점|센터|분점)"
# Sentinel for names held back for dictionary resolution.
HOLD = "보류"
# Stop-words: matched brands that carry no brand information.
STOPWORDS = ["중앙", "잡화", "우리", "우정", "제일",
             "그린", "대성", "드림", "타임", "스타",
             "마루", "명가", "정성", "코코", "현대"]
# Brand standardisation: whole-value replacement (case-sensitive, not chained).
BRAND_MAP = {
    "씨유": "CU",
    "씨유 CU": "CU",
    "CU": "CU",
    "지에스25": "GS25",
    "지에스25 GS": "GS25",
    "지에스25 GS25": "GS25",
    "GS25": "GS25",
    "이디야": "이디야커피",
    "이디야커피": "이디야커피",
}
# Patterns of the reference rules, in the order the rules apply them.  They
# are the reference's Python patterns written for Java regex: Python's
# Unicode \s becomes WS under (?U), \w becomes WORD, and $-anchored text has
# no line breaks left when these run.
WS = r"[\s\x1c-\x1f]"                                    # Python \s
WORD = r"[\p{L}\p{N}_]"                                   # Python \w
LATIN_IN_PARENS = r"\(([^)]*[a-z][^)]*)\)"                 # C1 step 4: captured text
ANY_PARENS = r"\([^)]*\)"                                  # C1 step 5
BRANCH_TAIL = rf"(?U){WS}+\S{{1,20}}{BRANCH_SUFFIX}$"      # C1 step 6
HOLD_FORM = rf"[가-힣a-z0-9]{{2,}}{BRANCH_SUFFIX}$"          # C1 step 7
SINGLE_SYMBOL = r"^[^\p{L}\p{N}_\s]$"                     # C1 step 8
ANY_LATIN_IN_PARENS = r"\(([^)]*[a-zA-Z][^)]*)\)"          # C2 test
PARENS = r"[()]"                                          # C2, C4
CORP_PAREN = rf"(?U){WS}*\( ?주\)?{WS}*"                  # C3
NOT_KEPT = r"(?U)[^가-힣a-z0-9\s\x1c-\x1f\-&.·]"          # C4
HANGUL_THEN_LATIN = rf"(?U)([가-힣]){WS}+([a-zA-Z])"        # C8
LATIN_THEN_HANGUL = rf"(?U)([a-zA-Z]){WS}+([가-힣])"        # C8
INNER_PARENS_COMMA = r"\(([^(),]*)(?:,[^()]*)?\)"         # C9 (keep text before the first comma)
ALL_DIGITS = r"^\p{Nd}+$"                                  # F5
# ---------------------------------------------------------------------------



def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def py_strip(col: Column | str) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace."""
    return F.regexp_replace(_c(col), rf"(?U)^{WS}+|{WS}+$", "")


def collapse_ws(col: Column | str) -> Column:
    """Collapse every whitespace run to one space, then strip."""
    return F.trim(F.regexp_replace(_c(col), rf"(?U){WS}+", " "))


def _remove_literals(col: Column, literals: Sequence[str]) -> Column:
    for lit in literals:
        col = F.replace(col, F.lit(lit), F.lit(""))
    return col


def _clean_steps_1_to_6(raw: Column) -> tuple[Column, Column]:
    """Steps 2-6 of C1: (text after branch removal, captured Latin parentheses)."""
    s = collapse_ws(raw)
    s = _remove_literals(s, CORP_MARKERS)
    s = _remove_literals(s, [CORP_WORD])
    s = _remove_literals(s, TEMP_MARKERS)
    eng = F.regexp_extract_all(s, F.lit(LATIN_IN_PARENS), F.lit(1))
    s6 = F.trim(F.regexp_replace(s, ANY_PARENS, ""))
    s6 = F.regexp_replace(s6, BRANCH_TAIL, "")
    return s6, eng


def _clean_decide(raw: Column, s6: Column, eng: Column) -> Column:
    """Steps 1 and 7-12 of C1 on the step-6 text and the captured Latin parts."""
    name = F.trim(s6)
    return (
        F.when(raw.isNull(), F.lit(None).cast("string"))
        .when(s6.rlike(HOLD_FORM), F.lit(HOLD))
        .when(s6.rlike(SINGLE_SYMBOL), F.lit(None))
        .when(name == "", F.lit(None))
        .when((name == "주") & (F.size(eng) == 0), F.lit(None))
        .when(F.size(eng) > 0, F.concat_ws(" ", name, F.array_join(eng, " ")))
        .otherwise(name)
    )


def clean_business_name(col: Column | str) -> Column:
    """The 12-step business-name rule.

    Returns the cleaned name, the hold sentinel for ``<name><branch>`` forms,
    or null.  Literal removals stay sequential (one alternation would differ
    when a removal creates a new match).  As a single Column the step-6 text
    is repeated in several branches; on large inputs prefer
    ``with_clean_business_name``, which computes it once per row.
    """
    raw = _c(col)
    s6, eng = _clean_steps_1_to_6(raw)
    return _clean_decide(raw, s6, eng)


def with_clean_business_name(df: DataFrame, src: str, out: str) -> DataFrame:
    """C1 as staged projections: every intermediate is evaluated once per row.

    Catalyst does not collapse a projection into one that references its
    non-trivial outputs several times, so the stages stay separate and the
    generated code stays small.
    """
    s6, eng = _clean_steps_1_to_6(F.col(src))
    staged = df.withColumn("_c1_s6", s6).withColumn("_c1_eng", eng)
    return (staged.withColumn(out, _clean_decide(F.col(src), F.col("_c1_s6"), F.col("_c1_eng")))
            .drop("_c1_s6", "_c1_eng"))


def recover_parenthesised_latin(col: Column | str) -> Column:
    """If some ``(...)`` holds a Latin letter, drop all parens, strip, lower."""
    raw = _c(col)
    return F.when(
        raw.rlike(ANY_LATIN_IN_PARENS),
        F.lower(py_strip(F.regexp_replace(raw, PARENS, ""))),
    )


def strip_corp_tokens(col: Column | str) -> Column:
    """Remove ``( 주)``-style markers (closing paren optional) and the corp word."""
    s = F.regexp_replace(_c(col), CORP_PAREN, "")
    s = F.replace(s, F.lit(CORP_WORD), F.lit(""))
    return py_strip(s)


def clean_special_tokens(col: Column | str) -> Column:
    """C4: drop parens, ``,``/``/`` to space, keep Hangul/a-z/0-9/space/-&.· only."""
    s = F.regexp_replace(_c(col), PARENS, "")
    s = F.translate(s, ",/", "  ")
    s = F.regexp_replace(s, NOT_KEPT, "")
    return collapse_ws(s)


def standardise_brand(col: Column | str, mapping: Mapping[str, str] = BRAND_MAP) -> Column:
    """Whole-value replacement through a literal map (not chained)."""
    c = _c(col)
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(m, c), c)


def join_script_boundary(col: Column | str) -> Column:
    """If both Hangul and Latin occur, join Hangul/Latin across whitespace with ``_``."""
    c = _c(col)
    s = F.regexp_replace(c, HANGUL_THEN_LATIN, "$1_$2")
    s = F.regexp_replace(s, LATIN_THEN_HANGUL, "$1_$2")
    return F.when(c.rlike("[가-힣]") & c.rlike("[a-zA-Z]"), s).otherwise(c)


def clean_address(col: Column | str) -> Column:
    """Inside each innermost ``(...)`` keep text before the first comma; collapse."""
    s = F.regexp_replace(_c(col), INNER_PARENS_COMMA, "($1)")
    return collapse_ws(s)


def is_not_numeric_except_year(col: Column | str) -> Column:
    """F5 keep-mask: non-digit names pass; all-digit names pass only at length 4."""
    c = _c(col)
    return c.isNotNull() & (~c.rlike(ALL_DIGITS) | (F.length(c) == 4))


def is_word_char(ch: Column) -> Column:
    """True when a one-character string is a (Python) word character."""
    return ch.rlike(rf"^{WORD}$")
