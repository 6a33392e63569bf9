"""DuckDB (RE2) spellings of the text rules, for the oracle SQL only.

RE2 differs from Java regex: ``\\s`` is ASCII, ``(?U)`` means ungreedy, ``\\b``
finds a boundary inside Hangul runs, and replacements use ``\\1`` with the
``'g'`` flag for all matches.  So the oracle writes its own patterns instead of
sharing text with the Spark side; the two only meet in the results.
"""

from __future__ import annotations

from ..functions import text as tx

# Python's Unicode whitespace, spelled out for RE2.
WS = (r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
      r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
WS_INNER = WS[1:-1]


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def py_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def remove_literals(x: str, lits) -> str:
    for lit in lits:
        x = f"replace({x}, {q(lit)}, '')"
    return x


def strip_corp(x: str) -> str:
    return py_strip(f"replace(regexp_replace({x}, '{WS}*\\( ?주\\)?{WS}*', '', 'g'), {q(tx.CORP_WORD)}, '')")


def special_tokens(x: str) -> str:
    s = f"translate(regexp_replace({x}, '[()]', '', 'g'), ',/', '  ')"
    s = f"regexp_replace({s}, '[^가-힣a-z0-9{WS_INNER}\\-&.·]', '', 'g')"
    return collapse(s)


def brand_map(x: str) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in tx.BRAND_MAP.items())
    return f"(CASE {x} {whens} ELSE {x} END)"


def not_numeric(x: str) -> str:
    return f"({x} IS NOT NULL AND (NOT regexp_full_match({x}, '\\p{{Nd}}+') OR length({x}) = 4))"


def recover_latin(x: str) -> str:
    return (f"(CASE WHEN regexp_matches({x}, '\\(([^)]*[a-zA-Z][^)]*)\\)') "
            f"THEN lower({py_strip(f'regexp_replace({x}, {q("[()]")}, {q("")}, {q("g")})')}) END)")


def script_boundary(x: str) -> str:
    s = f"regexp_replace({x}, '([가-힣]){WS}+([a-zA-Z])', '\\1_\\2', 'g')"
    s = f"regexp_replace({s}, '([a-zA-Z]){WS}+([가-힣])', '\\1_\\2', 'g')"
    return f"(CASE WHEN regexp_matches({x}, '[가-힣]') AND regexp_matches({x}, '[a-zA-Z]') THEN {s} ELSE {x} END)"


def clean_address(x: str) -> str:
    return collapse(f"regexp_replace({x}, '\\(([^(),]*)(?:,[^()]*)?\\)', '(\\1)', 'g')")


def clean_name_select(src: str, id_col: str = "unique_id", name_col: str = "bizname") -> str:
    """SELECT producing (unique_id, bizname, c1 = C1(name), c2 = C2(name))."""
    s3 = collapse(name_col)
    s3 = remove_literals(s3, tx.CORP_MARKERS + [tx.CORP_WORD] + tx.TEMP_MARKERS)
    suffix = "(지점|점|센터|분점)"
    return f"""
SELECT {id_col} AS unique_id, {name_col} AS bizname,
  CASE WHEN {name_col} IS NULL THEN NULL
    WHEN regexp_matches(s6, '[가-힣a-z0-9]{{2,}}{suffix}$') THEN {q(tx.HOLD)}
    WHEN regexp_full_match(s6, '[^\\pL\\pN_\\s]') THEN NULL
    WHEN trim(s6) = '' THEN NULL
    WHEN trim(s6) = '주' AND len(eng) = 0 THEN NULL
    WHEN len(eng) > 0 THEN concat_ws(' ', trim(s6), array_to_string(eng, ' '))
    ELSE trim(s6) END AS c1,
  {recover_latin(name_col)} AS c2
FROM (
  SELECT *, regexp_replace(trim(regexp_replace(s3, '\\([^)]*\\)', '', 'g')), '{WS}+[^{WS_INNER}]{{1,20}}{suffix}$', '') AS s6,
    regexp_extract_all(s3, '\\(([^)]*[a-z][^)]*)\\)', 1) AS eng
  FROM (SELECT *, {s3} AS s3 FROM {src}) t3
) t6"""


def names_ctes(top_n: int, min_freq: int, src: str = "lic") -> str:
    """CTEs n1, n2, n3 (and helpers) of the name pipeline; append after a WITH list."""
    stop = ", ".join(q(w) for w in tx.STOPWORDS)
    n1c = "coalesce(c1, CASE WHEN c2 <> 'null' THEN c2 END)"
    return f""",
n1raw AS ({clean_name_select(src)}),
n1 AS (SELECT unique_id, bizname, {n1c} AS clean_name, {n1c} AS clean_result FROM n1raw),
n2rest AS (SELECT * FROM n1 WHERE clean_result IS DISTINCT FROM {q(tx.HOLD)}),
n2hold AS (SELECT unique_id, bizname, {strip_corp('bizname')} AS hold_text FROM n1 WHERE clean_result = {q(tx.HOLD)}),
n2vocab AS (SELECT clean_result AS brand, count(*) AS cnt FROM n2rest WHERE length(clean_result) >= 2
            GROUP BY clean_result ORDER BY cnt DESC, brand ASC LIMIT {top_n}),
n2dict AS (SELECT brand, cnt, row_number() OVER (ORDER BY length(brand) DESC, cnt DESC, brand ASC) AS match_order FROM n2vocab),
n2cand AS (SELECT h.unique_id, h.bizname, d.brand, d.match_order FROM n2hold h JOIN n2dict d ON
  CASE WHEN length(d.brand) <= 2 AND regexp_matches(d.brand, '[a-z]')
       THEN regexp_matches(h.hold_text, '(^|[^\\pL\\pN_])\\Q' || d.brand || '\\E($|[^\\pL\\pN_])')
       ELSE contains(h.hold_text, d.brand) END),
n2best AS (SELECT unique_id, bizname, arg_min(brand, match_order) AS brand FROM n2cand GROUP BY unique_id, bizname),
n2good AS (SELECT brand FROM n2best GROUP BY brand HAVING count(*) >= {min_freq} AND brand NOT IN ({stop})),
n2 AS (SELECT unique_id, bizname, clean_name, clean_result FROM n2rest
       UNION ALL SELECT unique_id, bizname, brand, brand FROM n2best WHERE brand IN (SELECT brand FROM n2good)),
n3a AS (SELECT unique_id, bizname, lower({brand_map('clean_name')}) AS clean_name,
               lower({brand_map('clean_result')}) AS clean_result FROM n2),
n3b AS (SELECT unique_id, bizname, {special_tokens('clean_name')} AS clean_name,
               {special_tokens('clean_result')} AS clean_result FROM n3a WHERE {not_numeric('clean_name')}),
n3 AS (SELECT * FROM n3b WHERE length({py_strip('clean_name')}) > 1)
"""
