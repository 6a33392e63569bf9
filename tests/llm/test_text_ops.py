"""Text operators against brute force on edge cases and given tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from bizlens.llm import quality
from bizlens.llm.decontamination import contaminated, decontaminate, myers, normal, signs
from bizlens.llm.html_text import extract, main_text
from bizlens.llm.line_dedup import boilerplate, remove_boilerplate
from bizlens.llm.near_dup import drop_near_duplicates, near_duplicates, shingle_sets, superminhash
from bizlens.llm.secrets import candidates, featured, scan, weak_labels
from bizlens.llm.substring_dedup import FMIndex, remove_repeats
from bizlens.llm.toxicity import _TOKEN, _tokens, Scorer, held_out, reject_toxic, score_documents, token_evidence, toxic_scores, train
from llm_cases import edge_rows, edges, make_docs, no_docs, vocabulary_words  # noqa: F401


def words(t):
    return (t or "").encode("utf-8", "surrogatepass").split()


# --- op8 ------------------------------------------------------------------
def brute_components(rows):
    sets = []
    for i, t, _ in rows:
        w = (t or "").encode("utf-8", "surrogatepass").lower().split()
        sets.append((i, {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            k = len(sets[a][1] & sets[b][1])
            if sets[a][1] and sets[b][1] and 100 * k >= 75 * len(sets[a][1] | sets[b][1]):
                parent[find(a)] = find(b)
    groups = defaultdict(list)
    for k, (i, _) in enumerate(sets):
        groups[find(k)].append(i)
    out = []
    for k, (i, s) in enumerate(sets):
        ids = [x for x in groups[find(k)] if x is not None]
        least = min(ids) if ids else None
        out.append((i, len(s), least if s else i, i == least if i is not None and s else True))
    return out


def near_rows():
    rnd, vocab = random.Random(11), vocabulary_words()
    rows = edge_rows()
    n = 100
    for g in range(6):  # chains of near copies: neighbours are linked, ends may not be
        w = [rnd.choice(vocab) for _ in range(90)]
        for _ in range(15):
            rows.append((n, " ".join(w), "s"))
            n += 1
            for _ in range(rnd.randint(1, 3)):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
    passage = [rnd.choice(vocab) for _ in range(40)]
    for _ in range(60):  # short texts that share a passage: alike, but mostly below the threshold
        rows.append((n, " ".join(passage + [rnd.choice(vocab) for _ in range(rnd.randint(4, 25))]), "s"))
        n += 1
    rnd.shuffle(rows)
    return rows


def test_near_duplicates(spark, no_docs):
    rows = near_rows()
    got = near_duplicates(make_docs(spark, rows)).collect()
    want = brute_components(rows)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    left = drop_near_duplicates(make_docs(spark, rows)).select("doc_id").collect()
    ids = [r[0] for r in left if r[0] is not None]
    assert sorted(ids) == sorted({w[0] for w in want if w[3] and w[0] is not None})
    assert near_duplicates(no_docs).count() == 0


def test_near_duplicates_go_by_row(spark):
    """An id on two texts loses only the copy; null ids are in groups like others."""
    rnd, vocab = random.Random(17), vocabulary_words()
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    a, b, c = text(80), text(70), text(60)
    rows = [(1, a, "s"), (2, a + " tail", "s"), (2, b, "s"), (None, c, "s"), (None, c + " end", "s"), (None, b + " x", "s"), (3, None, "s"), (3, None, "s")]
    docs = make_docs(spark, rows)
    out = drop_near_duplicates(docs)
    left = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert out.columns == docs.columns and (1, a) in left and (2, b) in left and (2, a + " tail") not in left
    assert len([t for i, t in left if i is None]) == 1 and left.count((3, None)) == 2 and len(left) == 5


def test_superminhash_estimates_jaccard():
    rnd = random.Random(2)
    a = [str(rnd.random()) for _ in range(300)]
    b = a[:200] + [str(rnd.random()) for _ in range(100)]
    s, n = shingle_sets([" ".join(a), " ".join(b), "x"])
    sig = superminhash(s, n, 256)
    x, y = set(s[:n[0]].tolist()), set(s[n[0]:n[0] + n[1]].tolist())
    assert abs((sig[0] == sig[1]).mean() - len(x & y) / len(x | y)) < 0.1
    one = superminhash(s[n[0]:n[0] + n[1]], n[1:2], 256)
    assert (one[0] == sig[1]).all()


# --- op5 ------------------------------------------------------------------
def brute_repeats(rows):
    seen, out = set(), []
    for i, t in sorted({(i, t) for i, t, _ in rows}, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        w, gone = words(t), set()
        for p in range(len(w) - 19):
            g = tuple(w[p:p + 20])
            if g in seen:
                gone.update(range(p, p + 20))
            seen.add(g)
        left = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(left)).hexdigest()))
    return out


@pytest.mark.parametrize("hot,shard", [(500, 300_000), (1, 300_000), (500, 200), (10 ** 9, 50)])
def test_remove_repeats(spark, no_docs, hot, shard):
    rows = [r for r in near_rows() if r[0] is not None]
    docs = make_docs(spark, rows).distinct()
    got = remove_repeats(docs, hot=hot, shard_symbols=shard).select("doc_id", "n_words", "n_removed", F.sha2("text", 256)).collect()
    assert sorted(map(tuple, got)) == sorted(brute_repeats(rows))
    assert remove_repeats(no_docs).count() == 0


def test_repeats_null_ids(spark):
    docs = make_docs(spark, edge_rows())
    assert remove_repeats(docs).count() == docs.count()


def test_fm_index_finds_earliest():
    import numpy as np

    text = np.array([1, 2, 3, 0, 2, 3, 1, 2, 3, 0, 1, 2, 0])
    fm = FMIndex(text)
    starts = np.array([0, 1, 4, 5, 6, 7, 10])
    for n in (1, 2):
        want = [min(p for p in range(len(text) - n + 1) if (text[p:p + n] == text[s:s + n]).all()) for s in starts]
        assert fm.earliest(text, starts, n).tolist() == want


# --- op10 -----------------------------------------------------------------
def test_line_dedup(spark, edges, no_docs):
    want = Counter()
    for _, t, s in {(i, t, s) for i, t, s in edge_rows()}:
        for line in {x.strip(" \t\r") for x in (t or "").split("\n")}:
            if line and s is not None:
                want[line, s] += 1
    sites = Counter(line for line, _ in want)
    bad = {k for k, n in sites.items() if n >= 10}
    assert bad == {"This line stands on every site."}
    got = remove_boilerplate(edges)
    assert got.count() == edges.count()
    rows = {(r["doc_id"], r["n_lines"], r["n_removed"], r["text"]) for r in got.collect()}
    for i, t, _ in edge_rows():
        lines = (t or "").split("\n") if t is not None else []
        left = [x for x in lines if x.strip(" \t\r") not in bad]
        gone = sum(map(len, lines)) - sum(map(len, left))
        if gone > 0.5 * sum(map(len, lines)):
            left = lines
        assert (i, len(lines), len(lines) - len(left), t if t is None else "\n".join(left)) in rows
    assert remove_boilerplate(no_docs).count() == 0


def test_short_pages_lose_their_menus_and_copies_stay(spark):
    rnd, vocab = random.Random(12), vocabulary_words()
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    menu, story = [text(12) for _ in range(4)], "\n".join(text(20) for _ in range(3))
    rows = [(k, "\n".join([menu[0], f"own words {k}", "", *menu[1:]]), f"site{k}") for k in range(12)]
    rows += [(100 + k, story, f"site{k}") for k in range(12)]  # a text that was copied
    rows += [(200, "\n".join(menu), "site1"), (200, "\n".join(menu), "site1"), (None, "\n".join(menu[:2]), "site2")]  # repeated rows are no copies
    rows += [(201, "own\n" + story, "site3")]
    got = {(r["doc_id"], r["text"]): r for r in remove_boilerplate(make_docs(spark, rows)).collect()}
    want = {(k, f"own words {k}\n", 4, False) for k in range(12)} | {(100 + k, story, 0, True) for k in range(12)}
    want |= {(200, "", 4, False), (None, "", 2, False), (201, "own", 3, False)}
    assert {(r["doc_id"], r["text"], r["n_removed"], r["whole_copy"]) for r in got.values()} == want


def test_near_threshold_lines_are_counted_exactly(spark):
    rows = [(k, f"line {n}", f"site{k}") for n in range(1, 16) for k in range(n)]
    docs = make_docs(spark, rows)
    got = {r["a"] for r in boilerplate(docs, margin=1.0).collect()}
    want = {r[0] for r in spark.createDataFrame([(f"line {n}",) for n in range(10, 16)], "t string").select(F.xxhash64("t")).collect()}
    assert got == want


# --- op3 ------------------------------------------------------------------
def test_quality_rules(spark, edges, no_docs):
    got = quality.judge(edges).collect()
    assert len(got) == len(edge_rows())
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]))
    for i, t, _ in edge_rows():
        w = words(t)
        seen = Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
        rep = {k + o for k in range(len(w) - 7) if seen[tuple(w[k:k + 8])] > 1 for o in range(8)}
        lines = [x for x in (t or "").split("\n") if x.encode("utf-8", "surrogatepass").strip()]
        assert (len(w), sum(len(x.decode("utf-8", "surrogatepass")) for x in w), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(rep),
                len(w) < 20 or 100 * len(rep) > 30 * len(w)) in by[i]
    assert quality.judge(no_docs).count() == 0


def test_bad_host_is_rejected_and_small_host_is_shrunk(spark):
    good, rnd, vocab = [], random.Random(4), vocabulary_words()
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    for k in range(300):
        good.append((k, text(60) if k % 12 else "short", f"host{k % 10}"))
    junk = [(1000 + k, "spam" if k % 10 else text(60), "junk") for k in range(100)]
    one = [(2000, "too short", "single")]
    hosts = {r["source"]: r for r in quality.host_verdicts(quality.features(make_docs(spark, good + junk + one))).collect()}
    assert hosts["junk"]["host_rejected"] and not any(hosts[f"host{k}"]["host_rejected"] for k in range(10))
    assert hosts["single"]["rate_short"] < 1
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(make_docs(spark, good + junk + one)).collect()}
    assert not any(kept[1000 + k] for k in range(100)) and kept[1]


# --- op4 ------------------------------------------------------------------
def brute_distance(p, t):
    prev = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        cur = [i]
        for j, b in enumerate(t, 1):
            cur.append(min(prev[j - 1] + (a != b), prev[j] + 1, cur[-1] + 1))
        prev = cur
    return min(prev)


def test_myers_equals_dynamic_programme():
    rnd = random.Random(6)
    for _ in range(60):
        p = "".join(rnd.choice("abc ") for _ in range(rnd.randint(1, 90)))
        t = "".join(rnd.choice("abc ") for _ in range(rnd.randint(0, 60))) + p[rnd.randint(0, 3):] + "ab"
        d = brute_distance(p, t)
        assert myers(p, t, len(p))[0] == d


def test_decontamination(spark, edges, no_docs):
    rnd, vocab = random.Random(9), vocabulary_words()
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(k, text(rnd.randint(12, 40))) for k in range(12)] + [(90, None), (91, ""), (92, " \n"), (0, text(20))]
    rows, n = edge_rows(), 500
    for k, t in items[:12]:
        chars = list(t)
        for _ in range(int(len(normal(t)) / 16) - 1):
            chars[rnd.randrange(len(chars))] = "z"
        rows += [(n, text(30) + " " + t.upper() + ".!! " + text(30), "s"), (n + 1, text(50) + "\n" + "".join(chars) + "\n" + text(5), "s"),
                 (n + 2, text(10) + " " + " ".join(t.split()[:6]) + " " + text(40), "s")]
        n += 3
    docs = make_docs(spark, rows)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = set()
    for i, t, _ in rows:
        for k, item in items:
            p = normal(item)
            if len(p) >= 32:
                d = brute_distance(p, normal(t)) if len(normal(t)) < 2000 else 10 ** 9
                if d <= len(p) // 16:
                    want.add((i, k, d))
    for block in (1_000_000, 200):
        got = contaminated(docs, bench, block_chars=block).select("doc_id", "item_id", "distance").collect()
        assert {tuple(r) for r in got} == want and len(want) >= 24
    left = decontaminate(docs, bench)
    bad = {i for i, _, _ in want}
    assert left.columns == docs.columns and left.count() == len([r for r in rows if r[0] not in bad])
    assert contaminated(no_docs, bench).count() == 0 and decontaminate(docs, bench.limit(0)).count() == docs.count()


def test_short_items_of_a_benchmark(spark):
    """Items under the length that admits edits: exact, on word borders, with their signs where little else is left."""
    bench = spark.createDataFrame([(1, "Ohm's law, briefly"), (2, "x^2 + y^2 = z^2"), (3, "cat"), (4, "!!! ???"), (5, "{ }"), (6, "Straße Ünal"), (3, "cat")], "item_id bigint, text string")
    texts = {
        10: "first OHM S LAW: briefly!", 11: "ohm's law briefl", 12: "so x^2 +  y^2\n= z^2 holds", 13: "x^2 + y^2 = z^22", 14: "max^2 + y^2 = z^2",
        15: "x 2 y 2 z 2", 16: "concatenate category", 17: "a cat.", 18: "cat", 19: "what!!! ???", 20: "if (a) { } else", 21: "die straße ünal", 22: "STRASSE ÜNAL",
        23: None, 24: "", 25: " ", 26: "cat " * 40_000,
    }
    docs = make_docs(spark, [(k, t, "s") for k, t in texts.items()])
    want = {(10, 1), (12, 2), (17, 3), (18, 3), (26, 3), (19, 4), (20, 5), (21, 6)}
    for block in (1_000_000, 8):
        rows = contaminated(docs, bench, block_chars=block).collect()
        assert {(r["doc_id"], r["item_id"]) for r in rows} == want and all(r["distance"] == r["allowed"] == 0 for r in rows)
        assert len(rows) == len(want) + 3  # the repeated item gives its own rows
        assert {r["doc_id"] for r in decontaminate(docs, bench, block_chars=block).collect()} == set(texts) - {d for d, _ in want}


def test_short_items_against_a_plain_search(spark):
    import re

    rnd = random.Random(15)
    items = [(k, "".join(rnd.choice("ab +=") for _ in range(rnd.randint(1, 6)))) for k in range(60)]
    texts = ["".join(rnd.choice("aab  +=") for _ in range(rnd.randint(0, 40))) for _ in range(80)]
    want = set()
    for k, item in items:
        words = "".join(re.findall(r"\w", item))
        form = signs if 3 * len(words) <= 2 * len(re.sub(r"\s", "", item)) else normal
        if p := form(item):
            border = (r"(?<!\w)" if p[0] in "ab" else "") + re.escape(p) + (r"(?!\w)" if p[-1] in "ab" else "")
            want |= {(d, k) for d, t in enumerate(texts) if re.search(border, form(t))}
    docs = make_docs(spark, [(d, t, "s") for d, t in enumerate(texts)])
    got = contaminated(docs, spark.createDataFrame(items, "item_id bigint, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want and len(want) > 50


# --- op7 ------------------------------------------------------------------
@pytest.mark.parametrize("html,want", [
    (None, ""), ("", ""), ("plain &amp; text", "plain & text"), ("<p>a  b\n c<p>d &lt;e", "a b c\nd <e"),
    ("<html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>m</a></nav><div class='ad'>buy</div><article><h1>Head &eacute;</h1>"
     "<p><b>one <i>two</i></b> three<br>four</p><form>f</form><div class=\"comments\"><p>c</p></div></article><footer>foot</footer></body></html>",
     "Head é\none two three\nfour"),
    ("<body><div id=menu><a>x</a></div><div><p>" + "long words of text " * 30 + "</p><p>short</p></div><div class='cookie-notice'>ok</div><script>var a='</p>'</script></body>",
     ("long words of text " * 30).strip() + "\nshort"),
    ("<article><p>cut off in <b>the mid", "cut off in the mid"), ("<body><ul><li>a<li>b</ul><table><tr><td>1<td>2</table></body>", "a\nb\n1\n2"),
])

def test_main_text(html, want):
    assert main_text(html) == want


STORY = "\n".join(["a sentence of the story, with words enough. " * 8] * 4)
STORY_HTML = "".join(f"<p>{x}</p>" for x in STORY.split("\n"))
STORY_TEXT = "\n".join(" ".join(x.split()) for x in STORY.split("\n"))
LINKS = "<ul>" + "<li><a href=x>menu entry</a>" * 6 + "</ul>"


@pytest.mark.parametrize("html", [
    f"<body><div id=m class='nav-menu'>{LINKS}</div><div class='content has-sidebar'>{STORY_HTML}</div></body>",
    f"<body><div id=page class=no-sidebar><div class=sidebar>{LINKS}</div><article>{STORY_HTML}</article></div></body>",
    f"<body><div class=elementor-widget-text-editor>{STORY_HTML}</div><div class=site-footer>foot</div></body>",
    f"<body><div class=menu>{LINKS}</div><section class='post with-comments'>{STORY_HTML}<div id=comments><p>first!</p></div></section></body>",
    f"<body><div class=widget><article>{STORY_HTML}</article></div><div class=related>{LINKS}</div></body>",
    f"<body><article>{STORY_HTML}<div class=related-posts>{LINKS}</div><div class='comments'><article><p>{'a long reply ' * 9}</p></article></div></article></body>",
])
def test_wrappers_named_like_boilerplate_keep_the_article(html):
    assert main_text(html) == STORY_TEXT


def test_sections_named_like_boilerplate_stay_in_the_article():
    section = "<div class=related-work><p>" + "earlier studies of this are many. " * 9 + "</p></div>"
    assert main_text(f"<body><article>{STORY_HTML}{section}</article></body>") == STORY_TEXT + "\n" + ("earlier studies of this are many. " * 9).strip()


def test_extract(spark):
    schema = "page_id bigint, url string, html string, text int"
    pages = spark.createDataFrame([(1, "u", "<p>a &amp; b</p>", 1), (None, None, None, 2), (1, "u", "<p>a &amp; b</p>", 1)], schema)
    got = sorted(map(tuple, extract(pages).collect()), key=str)
    assert got == sorted([(1, "u", "a & b", 5), (None, None, "", 0), (1, "u", "a & b", 5)], key=str)
    assert extract(pages.limit(0)).count() == 0


# --- op2 ------------------------------------------------------------------
def test_secret_scan(spark, edges, no_docs):
    rnd, vocab = random.Random(8), vocabulary_words()
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    rows = edge_rows()
    secret = set()
    for k in range(200, 400):
        token = "".join(rnd.choice("0123456789abcdef") for _ in range(40))
        kind = k % 4
        body = [f'token = "{token}"', "mail.12@host3.example.com", "192.168.100.201", "4929123412341234"][kind]
        rows.append((k, f"{text(10)} {body} {text(10)}", "s"))
        if kind == 0:
            secret.add(k)
    rows.append((900, f'{text(4)} token = {"9f" * 20} {text(4)}', "s"))  # not quoted: no weak label
    got = scan(make_docs(spark, rows), min_docs=3).collect()
    held = [r for r in got if r["doc_id"] and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and 200 <= r["doc_id"] < 400]
    assert len(held) > 20 and all(r["is_secret"] == (r["doc_id"] in secret) for r in held)
    assert [r["is_secret"] for r in got if r["doc_id"] == 900] == [True]
    assert scan(no_docs).count() == 0
    assert scan(edges).count() >= 0  # no labelled findings of both kinds: the weak label decides
    reviewed = spark.createDataFrame([(200, 13, 0)], "doc_id bigint, place bigint, label int")
    assert scan(make_docs(spark, rows), labels=reviewed, min_docs=3).count() == len(got)


@pytest.mark.parametrize("text,want", [
    ('password="9f3a8b7c6d5e4f3a2b1c"', {("9f3a8b7c6d5e4f3a2b1c", 1)}),
    ('{"token":"ghp_9f3a8b7c6d5e4f3a","id":"4929123412341234"}', {("ghp_9f3a8b7c6d5e4f3a", 1), ("4929123412341234", 0)}),
    ("api_key='abcdef0123456789'", {("abcdef0123456789", 1)}), ('a {"token": "ghp_9f3a8b7c6d5e4f3a"}', {("ghp_9f3a8b7c6d5e4f3a", 1)}),
    ('SECRET_ACCESS_KEY="wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"', {("wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", 1)}),
    ("TOKEN=9f3a8b7c6d5e4f3a", {("9f3a8b7c6d5e4f3a", None)}), ('password = "hunter"', {("hunter", 1)}), ("pwd: 'p$w!'", {("p$w!", 1)}),
    ('secret ="correct horse battery" x', {("correct horse battery", 1)}), ('auth="ZGVhZGJlZWYxMjM0NQ=="', {("ZGVhZGJlZWYxMjM0NQ==", 1)}),
    ("https://host1.example.com/a", {("https://host1.example.com/a", None)}), ("DE:AD:BE:EF:12:34:56", {("DE:AD:BE:EF:12:34:56", None)}),
    ("mail.12@host3.example.com,192.168.100.201", {("mail.12@host3.example.com", 0), ("192.168.100.201", 0)}), ('monkey="banana" say "hello"', set()),
])
def test_candidates_of_compact_assignments(spark, text, want):
    got = weak_labels(candidates(make_docs(spark, [(1, text, "s")]))).collect()
    assert {(r["value"], r["label"]) for r in got} == want and len(got) == len(want)
    for r in got:
        word = text.split()[r["place"]]
        assert word[r["offset"]:].startswith(r["value"].split()[0])


def test_literals_of_any_length(spark):
    long = " ".join(f"word{i}" for i in range(300))
    texts = [f'password = "{long}" and more', f"a key='{long}' b", f'token: `{long}` x "y"', 'secret = "open and never closed', 'auth = "it\'s fine" x']
    got = {r["doc_id"]: r["value"] for r in candidates(make_docs(spark, [(i, t, "s") for i, t in enumerate(texts)])).where("assigned").collect()}
    assert got == {0: long, 1: long, 2: long, 3: "open", 4: "it's fine"}


def test_many_openings_in_one_text(spark):
    """Every opened literal is carried only up to its quote: the work grows with the text."""
    text = " ".join(f'token = "a{i} b{i}"' for i in range(20_000)) + " key = 'x" + " x" * 20_000
    got = candidates(make_docs(spark, [(1, text, "s")])).where("assigned")
    assert got.count() == 20_001
    assert got.agg(F.max(F.length("value"))).first()[0] == len("a19999 b19999")


def test_repeated_documents_keep_their_features(spark):
    rows = [(1, 'password="9f3a8b7c6dcloud5e4friverf3a2b1c"', "s"), (2, "cloud river", "s")]
    words_ = spark.createDataFrame([("cloud",), ("river",)], "word string")
    number = lambda d: d.withColumn("uid", F.monotonically_increasing_id())
    once = featured(number(candidates(make_docs(spark, rows))), words_).collect()
    twice = featured(number(candidates(make_docs(spark, rows + rows))), words_).collect()
    assert len(twice) == 2 * len(once) and {tuple(r["features"]) for r in twice} == {tuple(r["features"]) for r in once}


# --- op9 ------------------------------------------------------------------
@pytest.fixture(scope="module")
def toxic_rows():
    rnd, vocab = random.Random(21), vocabulary_words(n=300)
    bad = ["fooey", "blast", "cursed"]
    rows, labels = [], []
    for k in range(600):
        w = [rnd.choice(vocab) for _ in range(rnd.randint(20, 80))]
        y = int(k % 6 == 0)
        if y:
            for _ in range(rnd.randint(2, 5)):
                w.insert(rnd.randrange(len(w)), rnd.choice(bad))
        rows.append((k, " ".join(w), "s"))
        labels.append((k, 1, y))
    return rows, labels


def test_toxicity_held_out(spark, toxic_rows):
    rows, labels = toxic_rows
    docs = make_docs(spark, rows)
    got = toxic_scores(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()
    truth = {i: y for i, _, y in labels}
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {k for k in range(600) if zlib.crc32(str(k).encode()) % 5 == 0}
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    texts = dict((i, t) for i, t, _ in rows)
    for r in got:
        for s in r["spans"]:
            assert texts[r["doc_id"]][s["start"]:s["stop"]] in ("fooey", "blast", "cursed")
    # labels of the held-out fold do not change a score
    flipped = [(i, q, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, q, y in labels]
    again = toxic_scores(docs, spark.createDataFrame(flipped, "doc_id bigint, quality int, toxic int")).collect()
    assert {(r["doc_id"], r["score"]) for r in again} == {(r["doc_id"], r["score"]) for r in got}


def test_marginals_equal_full_forward_backward(spark, toxic_rows):
    import numpy as np

    rows, labels = toxic_rows
    model = train(make_docs(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    scorer = Scorer(model)
    for _, text, _ in rows[:40]:
        marks, n = scorer.document(text)
        emit = [np.array([1.0, np.exp(model.bias + (scorer.gains[w] or 0.0))]) for w in text.split()]
        trans = np.exp(np.array(model.trans))
        f, b = [emit[0]], [np.ones(2)]
        for e in emit[1:]:
            f.append((f[-1] @ trans) * e)
        for e in emit[:0:-1]:
            b.insert(0, trans @ (e * b[0]))
        full = [float((x * y)[1] / (x * y).sum()) for x, y in zip(f, b)]
        for i, p in marks:
            assert abs(full[i] - p) < 1e-9


def test_toxicity_edges(spark, edges, no_docs, toxic_rows):
    rows, labels = toxic_rows
    frame = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = train(make_docs(spark, rows), frame)
    assert score_documents(edges, model).count() == edges.count()
    assert toxic_scores(no_docs, frame).count() == 0
    none = toxic_scores(edges, frame.limit(0)).collect()
    assert len(none) == edges.count() and not any(r["predicted"] for r in none)
    kept = reject_toxic(make_docs(spark, rows), frame)
    assert kept.columns == edges.columns and 0 < kept.count() < len(rows)
    assert spark.range(3).select(held_out(F.col("id"))).count() == 3


def test_offsets_are_places_of_the_text_as_it_stands(spark, toxic_rows):
    rows, labels = toxic_rows
    model = train(make_docs(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    texts = {1: "\u0130stanbul fooey blast", 2: "FOOEY, \u0130\u0130 Cursed"}  # a letter that grows when lowered
    for r in score_documents(make_docs(spark, [(i, t, "s") for i, t in texts.items()]), model).collect():
        assert [texts[r["doc_id"]][x["start"]:x["stop"]].lower() for x in r["spans"]] == {1: ["fooey", "blast"], 2: ["fooey", "cursed"]}[r["doc_id"]]


def test_tokens_of_a_text_lowered_first_are_the_same():
    rnd = random.Random(3)
    odd = "aZ9_ .'-\u00c9\u00df\u0130\u03a3\u03c3\u0301\u0915\u093f\u094d\u4e2d\u2014\u1e9e\U0001d400\U00010400"
    for _ in range(5000):
        t = "".join(rnd.choice(odd[:rnd.randint(8, len(odd))]) for _ in range(rnd.randint(0, 12)))
        assert _tokens(t) == [w.lower() for w in _TOKEN.findall(t)]


def test_words_with_combining_marks_are_evidence(spark, toxic_rows):
    rows, labels = toxic_rows
    truth = {i: y for i, _, y in labels}
    bad = "\u0928\u093f\u0928\u094d\u0926\u093e"  # vowel signs and a virama
    docs = [(f"{t} {bad}" if truth[i] else t, truth[i]) for i, t, _ in rows]
    got = {r["token"] for r in token_evidence(spark.createDataFrame(docs, "text string, toxic int"), 4.0, 2000)}
    assert bad in got


def test_pure_words_of_a_small_language_are_toxic(spark):
    """Words that few documents hold, none of them clean, count beside words that are ten times as frequent."""
    rnd, vocab, other = random.Random(4), vocabulary_words(n=300), [f"{c}{i:03d}zu" for c in "klmnp" for i in range(100)]
    rows, labels = [], []
    for k in range(1500):
        small, y = k % 12 == 0, int(rnd.random() < 0.12)
        w = [rnd.choice(other if small else vocab) for _ in range(40)]
        if y:
            w += ["qarbat", "qorbit"] if small else ["fooey", "blast"]
        rows.append((k, " ".join(w), "s"))
        labels.append((k, 1, y))
    got = toxic_scores(make_docs(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()
    assert all(r["predicted"] == labels[r["doc_id"]][2] for r in got)


def test_documents_that_share_a_long_word_count_each(spark, toxic_rows):
    rows, labels = toxic_rows
    truth = {i: y for i, _, y in labels}
    footer = [(f"{t} footeridentifier20240101", truth[i]) for i, t, _ in rows]
    copies = [("Only Here, stands unheardof!" if k % 2 else "only here stands  UNHEARDOF", 1) for k in range(60)]
    got = {r["token"]: r for r in token_evidence(spark.createDataFrame(footer + copies, "text string, toxic int"), 4.0, 2000)}
    assert {"fooey", "blast", "cursed"} <= set(got) and "unheardof" not in got
    for w in ("fooey", "blast", "cursed"):
        assert got[w]["a"] == len({t for t, y in footer if y and w in t.split()}) and got[w]["b"] == 0


ARTICLE = "<article><h1>Head line</h1>" + "".join(f"<p>Sentence number {k} of the article, with a few words more.</p>" for k in range(9)) + "</article>"


@pytest.mark.parametrize("page, extra", [
    ("<body><form action='/x'><input name=q><label>Search</label>{}</form></body>", None),
    ("<body><div><dialog open>{}</dialog></div></body>", None),
    ("<body><object>{}</object></body>", None),
    ("<body>{}<form><p>Sign up to our letter now</p><label>Mail</label></form></body>", None),
    ("<body><div style='display: none'><p>We use cookies on this page</p></div>{}</body>", None),
    ("<body>{}<dialog><p>Please accept all of it</p></dialog></body>", None)])
def test_wrappers_keep_the_article(page, extra):
    want = "Head line\n" + "\n".join(f"Sentence number {k} of the article, with a few words more." for k in range(9))
    assert main_text("<html>" + page.format(ARTICLE) + "</html>") == want


def test_formulas_stay_in_their_paragraph():
    html = "<body><article><p>With <math><mi>x</mi><mo>=</mo><mn>2</mn></math> the sum of all the values is known.</p><p>More words follow here.</p></article></body>"
    assert main_text(html) == "With x=2 the sum of all the values is known.\nMore words follow here."
