"""Golden rows for the name/address text rules (hand-derived, FIXTURES.md section 4)."""
import pytest
from pyspark.sql import functions as F

from bizlens.functions import text as tx
from bizlens.operators import names as nm

HOLD = tx.HOLD
C1_N1 = [
    (None, None, None),
    ("(주)씨유 강남점", "씨유", "씨유"),
    ("GS25역삼점", HOLD, HOLD),
    ("지에스25", "지에스25", "지에스25"),
    ("이디야 홍대센터", "이디야", "이디야"),
    ("이디야 센터", "이디야 센터", "이디야 센터"),
    ("맘스터치 (moms touch)", "맘스터치 moms touch", "맘스터치 moms touch"),
    ("(CAFE ONE)", None, "cafe one"),
    ("(moms)", None, "moms"),
    ("주식회사  한빛", "한빛", "한빛"),
    ("주", None, None), ("(주", None, None), ("*", None, None), ("   ", None, None),
    ("_", "_", "_"),
    ("김밥천국-한시적", "김밥천국", "김밥천국"),
    ("김밥천국신촌점", HOLD, HOLD),
    ("호프(주점)", "호프점)", "호프점)"),
    ("빵집(광주)", "빵집(광", "빵집(광"),
    ("편의점", HOLD, HOLD),
    ("주점", "주점", "주점"),
    ("a (b) c", "a  c b", "a  c b"),
    ("주 (co)", "주 co", "주 co"),
    ("(null)", None, None),
    ("가나다(a)점", HOLD, HOLD),
    ("가　나", "가 나", "가 나"),
    ("가\x1c나", "가 나", "가 나"),
    (" a b\t", "a b", "a b"),
]


def test_clean_business_name_and_stage1(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(C1_N1)], "unique_id long, bizname string")
    c1 = {r.unique_id: r.c for r in df.select("unique_id", tx.clean_business_name("bizname").alias("c")).collect()}
    staged = {r.unique_id: r.c for r in tx.with_clean_business_name(df, "bizname", "c").collect()}
    n1 = {r.unique_id: r.clean_name for r in nm.clean_names(df).collect()}
    for i, (raw, want_c1, want_n1) in enumerate(C1_N1):
        assert c1[i] == want_c1, raw
        assert staged[i] == want_c1, raw
        assert n1[i] == want_n1, raw


@pytest.mark.parametrize("fn,cases", [
    (tx.strip_corp_tokens, [("(주)현대마트", "현대마트"), ("현대 ( 주) 마트", "현대마트"), ("(주점)호프", "점)호프"),
                            ("주식회사 가", "가")]),
    (tx.clean_special_tokens, [("a,b/c & d", "a b c & d"), ("(12345)", "12345"), ("GS25!", "25"),
                               ("b·c.", "b·c."), ("12,345", "12 345")]),
    (tx.join_script_boundary, [("한글 abc 나 d", "한글_abc_나_d"), ("abc def", "abc def"), ("가 나", "가 나"),
                               ("가나 25 a", "가나 25 a"), ("가 a 나  b", "가_a_나_b")]),
    (tx.clean_address, [("서울 강남구 (역삼동, 빌딩)  1층", "서울 강남구 (역삼동) 1층"), ("a (,d)", "a ()"),
                        ("((a,b),c)", "((a),c)"), ("x (y", "x (y")]),
    (tx.standardise_brand, [("씨유", "CU"), ("지에스25 GS", "GS25"), ("이디야", "이디야커피"), ("cu", "cu"),
                            (None, None)]),
])
def test_text_functions(spark, fn, cases):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, x string")
    got = {r.i: r.y for r in df.select("i", fn("x").alias("y")).collect()}
    for i, (raw, want) in enumerate(cases):
        assert got[i] == want, raw


def test_numeric_keep_mask(spark):
    cases = [("1234", True), ("12345", False), ("123", False), ("", True), ("12a", True), (None, False)]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, x string")
    got = {r.i: r.y for r in df.select("i", tx.is_not_numeric_except_year("x").alias("y")).collect()}
    for i, (raw, want) in enumerate(cases):
        assert got[i] == want, raw


def test_dictionary_match_golden(spark):
    dictionary = spark.createDataFrame(
        [("이디야커피", 1), ("이디야", 2), ("cu", 3), ("현대", 4)], "brand string, match_order int")
    cases = [("홍대이디야커피점", "이디야커피"), ("홍대이디야점", "이디야"), ("가 cu 점", "cu"), ("가cu점", None),
             ("더현대몰점", "현대"), ("없음점", None), ("cu", "cu"), ("a cu-b", "cu"), ("", None)]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "unique_id long, t string")
    got = {r.unique_id: r.brand for r in nm.match_dictionary(df, "t", dictionary).collect()}
    for i, (text, want) in enumerate(cases):
        assert got.get(i) == want, text


def test_hold_split_keeps_nulls(spark):
    from bizlens.operators.filters import split_hold
    df = spark.createDataFrame([(1, HOLD), (2, None), (3, "x")], "id int, c string")
    held, rest = split_hold(df, "c")
    assert sorted(r.id for r in held.collect()) == [1]
    assert sorted(r.id for r in rest.collect()) == [2, 3]
