import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, n_lines string, key string, root int, h int, value string, label int"


def make_docs(spark, rows):
    """(doc_id, text, source) rows as documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 0.5, "x", "k", 1, 2, "v", 3) for i, t, s in rows], SCHEMA)


def vocabulary_words(seed=5, n=400):
    rnd = random.Random(seed)
    return ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 8))) for _ in range(n)]


def edge_rows(seed=1):
    """Null, empty, blank, short and very long texts, copies, near copies, ties and repeated rows."""
    rnd, words = random.Random(seed), vocabulary_words()
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passage, base, line = text(60), text(120), "This line stands on every site."
    near = base.split()
    near[50] = "changed"
    rows = [(1, None, "s1"), (2, "", "s2"), (3, " \n\t ", "s3"), (4, "one", None), (5, "one two three four", "s1"),
            (6, base, "s1"), (7, base, "s2"), (8, " ".join(near), "s3"), (9, base.upper(), "s4"), (9, base.upper(), "s4"),
            (10, text(30) + " " + passage + " " + text(25), "s5"), (11, passage + "\n" + text(40), "s6"), (12, text(10) + " " + passage, "s7"),
            (13, text(9000), "s1"), (None, text(50), "s2"), (None, None, None), (14, "a  b\n\n\nc   d \t e\r\n", "s1"),
            (15, "\x1f weird \x0b\x0c controls   İΣ 😀".encode("utf-16", "surrogatepass").decode("utf-16"), "s2")]
    for k in range(20, 50):
        rows.append((k, text(rnd.randint(5, 90)) + "\n" + line + "\n" + text(rnd.randint(20, 60)), f"site{k % 14}"))
    big = " ".join(rnd.choice(words[:3]) for _ in range(300))
    rows += [(60, big, "s1"), (61, "\n".join(["same line of text here"] * 40), "s2"), (62, "w " * 19 + "w", "s3"), (63, "#*$%&|<> " * 30, None)]
    return rows


@pytest.fixture(scope="module")
def edges(spark):
    return make_docs(spark, edge_rows())


@pytest.fixture(scope="module")
def no_docs(spark):
    return make_docs(spark, [])
