"""Toxic spans by a linear-chain conditional random field.

Training, on labelled documents outside the held-out fold:

1. *Token evidence*, as Spark aggregations over every training document: for
   each lower-case token and word beginning, the number of toxic and clean
   documents with it, the smoothed log-odds and their significance.
2. *Token labels*: in a toxic document, tokens of significantly toxic evidence
   are labelled toxic; every other token of any document is labelled clean.
3. *CRF*: weights of the evidence features, the bias of other tokens and the
   tag transitions, fitted by gradient ascent with forward-backward expectations
   on a hash sample of about ``max_fit_docs`` documents (a documented bound;
   evidence and the calibration below use all training rows).
4. *Calibration*: marginals of a document sum up to features of a logistic
   score, fitted on all training documents.

Scoring runs over whole texts inside tasks.  Tokens without evidence share one
emission, so runs of them fold into powers of the transition matrix: the
forward-backward marginals at informative tokens are exact, at a cost per
document that grows with its informative tokens.

The model (a lexicon bounded by ``max_lexicon`` and a few weights) is sent to
the tasks.  Inputs of a score are the text alone.

Edge cases: null and empty texts get the calibrated score of no evidence;
without labelled rows, or with one class alone, every score is the base rate
(0.0 without labels); unlabelled rows are scored like others; repeated doc_ids
are scored row by row; a doc_id with conflicting labels counts under each;
extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, stored

#: Combining marks are part of a word: the same tokens as ``_JAVA_TOKEN`` in Spark.
_MARKS = "".join(chr(c) for c in range(0x300, 0x1F000) if unicodedata.category(chr(c))[0] == "M")
_TOKEN = re.compile(rf"[\w{_MARKS}]+")
#: Letters and marks whose words differ when a text is lowered as a whole.
_ODD = re.compile(f"[\u0130\u03a3{_MARKS}]")
_PLAIN_TOKEN = re.compile(r"\w+")
_JAVA_TOKEN = r"[\p{L}\p{M}\p{N}_]+"
FOLDS = 5
#: Labels of at most so many rows (16 bytes each) are sent to the tasks; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text is divisible by five."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


@dataclass
class Model:
    lexicon: dict[str, float] = field(default_factory=dict)  # token -> emission gain of the toxic tag
    bias: float = 0.0                                        # toxic emission of a token without evidence
    trans: list[list[float]] = field(default_factory=lambda: [[0.0, 0.0], [0.0, 0.0]])
    doc: list[float] = field(default_factory=lambda: [0.0, 0.0, 0.0, 0.0])  # logistic weights and intercept


def _tokens(text: str) -> list[str]:
    """Words of the text as it stands, each lowered by itself, so that places are places of the text.

    A text without marks and such letters may be lowered first, with the same words in a seventh of the time.
    """
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        if _ODD.search(text):
            return [w.lower() for w in _TOKEN.findall(text)]
    return _PLAIN_TOKEN.findall(text.lower())


def _marginals(model: Model, powers, found: list[tuple[int, float]], n: int) -> list[float]:
    """Toxic marginals at the informative tokens ``found`` (place, gain) of ``n`` tokens."""
    if not found:
        return []
    m = powers(1)
    base = np.array([1.0, math.exp(model.bias)])
    emit = [np.array([1.0, math.exp(model.bias + g)]) for _, g in found]
    start = np.ones(2)
    fwd = []
    at, gain = found[0][0], emit[0]
    # a step multiplies by the transition and by the emission of the token it reaches
    a = (start * base if at else start)
    if at:
        a = a @ powers(at - 1) if at > 1 else a
        a = (a @ m) / base * gain
    else:
        a = a * gain
    fwd.append(a / a.sum())
    for (p, _), (q, _), e in zip(found, found[1:], emit[1:]):
        a = fwd[-1] @ powers(q - p) / base * e
        fwd.append(a / a.sum())
    b = powers(n - 1 - found[-1][0]) @ np.ones(2)
    out = [0.0] * len(found)
    for i in range(len(found) - 1, -1, -1):
        both = fwd[i] * b
        out[i] = float(both[1] / both.sum())
        if i:
            b = powers(found[i][0] - found[i - 1][0]) @ (emit[i] / base * b)
            b = b / b.sum()
    return out


#: Lengths of the word beginnings that count as evidence beside the word itself.
PREFIXES = (4, 5, 6)


def _keys(token: str) -> list[str]:
    return [token, *(token[:k] + "*" for k in PREFIXES if len(token) > k)]


class _Gains(dict):
    """Token -> emission gain, or None; looked up by the token and its beginnings once, then kept (bounded)."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon

    def __missing__(self, token: str):
        if len(self) > 500_000:
            self.clear()
        found = [self.lexicon[k] for k in _keys(token) if k in self.lexicon]
        self[token] = got = max(found) if found else None
        return got


class Scorer:
    """Scores texts with a model; holds the powers of the folded transition."""

    def __init__(self, model: Model):
        self.model, self.gains = model, _Gains(model.lexicon)
        t = np.exp(np.array(model.trans)) * np.array([1.0, math.exp(model.bias)])
        self.t = t / t.sum()
        self.kept: dict[int, np.ndarray] = {0: np.eye(2), 1: self.t}

    def powers(self, k: int) -> np.ndarray:
        if k not in self.kept:
            if len(self.kept) > 50_000:
                self.kept = {0: np.eye(2), 1: self.t}
            half = self.powers(k // 2)
            p = half @ half @ (self.t if k % 2 else self.kept[0])
            self.kept[k] = p / p.sum()
        return self.kept[k]

    def document(self, text: str) -> tuple[list[tuple[int, float]], int]:
        toks = _tokens(text)
        found = [(i, g) for i, g in enumerate(map(self.gains.__getitem__, toks)) if g is not None]
        return [(i, p) for (i, _), p in zip(found, _marginals(self.model, self.powers, found, len(toks)))], len(toks)

    @staticmethod
    def features(marks: list[tuple[int, float]], n: int) -> list[float]:
        p = [x for _, x in marks]
        expected = sum(p)
        none = math.exp(sum(math.log1p(-min(x, 1 - 1e-9)) for x in p))
        return [1 - none, math.log1p(expected), math.log1p(100 * expected / max(n, 1)), 1.0]

    def score(self, marks: list[tuple[int, float]], n: int) -> float:
        z = sum(w * x for w, x in zip(self.model.doc, self.features(marks, n)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def spans(self, text: str, marks: list[tuple[int, float]], least: float) -> list[tuple[int, int]]:
        """Character offsets [from, to) of the tokens whose marginal reaches ``least``."""
        wanted = {i for i, p in marks if p >= least}
        if not wanted:
            return []
        return [m.span() for i, m in enumerate(_TOKEN.finditer(text)) if i in wanted]


def _evidence_columns(na: float, nb: float):
    """(log-odds, z) of columns a and b; z is the root of the likelihood-ratio statistic."""
    n, rate = F.col("a") + F.col("b"), na / (na + nb)
    ratio = 2 * (F.col("a") * F.log(F.greatest("a", F.lit(1e-9)) / (n * rate)) + F.col("b") * F.log(F.greatest("b", F.lit(1e-9)) / (n * (1 - rate))))
    odds = F.log((F.col("a") + 0.5) / (na + 0.5)) - F.log((F.col("b") + 0.5) / (nb + 0.5))
    return F.round(odds, 6), F.round(F.sqrt(F.greatest(ratio, F.lit(0.0))), 6)


def _strongest(counts: DataFrame, na: float, nb: float, min_docs: float, z: float, most: int) -> DataFrame:
    odds, root = _evidence_columns(na, nb)
    return (counts.where(F.col("a") >= min_docs).withColumn("odds", odds).withColumn("z", root)
            .where((F.col("z") > z) & (F.col("odds") > 1)).orderBy(F.desc("z"), "token").limit(most))


def token_evidence(labelled: DataFrame, min_docs: float, max_lexicon: int) -> list:
    """Tokens and word beginnings (``begi*``) of the strongest toxic evidence: (token, a, b, odds, z).

    First by the documents of each label that have them; then, for at most ten
    times ``max_lexicon`` of them, by the distinct texts of those documents (their
    tokens in order), so that copies of one text do not look like evidence from
    many and every other document counts.
    Counts are distributed; at most that many rows reach the driver.
    """
    words = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(_JAVA_TOKEN), F.lit(0)), F.lower))
    rows = labelled.select("toxic", words.alias("words"))
    begun = [F.transform(F.filter("words", lambda w, k=k: F.length(w) > k), lambda w, k=k: F.concat(F.substring(w, 1, k), F.lit("*"))) for k in PREFIXES]
    counts = rows.select("toxic", F.explode(F.array_distinct(F.concat("words", *begun))).alias("token")).groupBy("token").agg(
        F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    total = labelled.agg(F.sum("toxic").alias("na"), F.sum(1 - F.col("toxic")).alias("nb")).first()
    na, nb = float(total["na"] or 0), float(total["nb"] or 0)
    if not na or not nb:
        return []
    known = {r["token"] for r in _strongest(counts, na, nb, min_docs, 3.0, 10 * max_lexicon).select("token").collect()}

    def marks(batches):
        import xxhash

        for batch in batches:
            out = []
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                toks = _tokens(t)
                own = set(toks)
                if own:
                    mark = xxhash.xxh3_64_intdigest(" ".join(toks).encode("utf-8", "surrogatepass")) - (1 << 63)
                    out.append(("", mark, y))  # the mark itself, for the totals
                    out += [(k, mark, y) for k in {k for w in own for k in _keys(w)} & known]
            c = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_pydict({n: pa.array(v, k) for n, v, k in zip(("token", "mark", "toxic"), c, (pa.string(), pa.int64(), pa.int32()))})

    once = map_batches(labelled.select("text", "toxic"), marks, "token string, mark bigint, toxic int").distinct()
    once = once.groupBy("token").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).persist()
    try:
        whole = once.where("token = ''").first()
        if not whole or not whole["a"] or not whole["b"]:
            return []
        return _strongest(once.where("token <> ''"), float(whole["a"]), float(whole["b"]), min_docs, 3.5, max_lexicon).collect()
    finally:
        once.unpersist()


#: Tokens of a training segment.
SEGMENT = 64


def _training_segments(sample: list, feats: dict[str, list[float]], seeds: set[str]):
    """Arrays (features, tags, weights) of segments; segments without informative tokens are one row with their count."""
    xs, ys, blank = [], [], 1
    width = len(next(iter(feats.values()))) + 1
    empty = np.zeros((SEGMENT, width))
    empty[:, 0] = 1.0
    for places, toks, n, label in sample:
        by: dict[int, list[tuple[int, str]]] = {}
        for p, w in zip(places, toks):
            by.setdefault(p // SEGMENT, []).append((p % SEGMENT, w))
        blank += max(-(-n // SEGMENT) - len(by), 0)
        for _, own in sorted(by.items()):
            x, y = empty.copy(), np.zeros(SEGMENT)
            for p, w in own:
                x[p, 1:] = feats[w]
                y[p] = float(label == 1 and w in seeds)
            xs.append(x)
            ys.append(y)
    xs.append(empty)
    ys.append(np.zeros(SEGMENT))
    return np.array(xs), np.array(ys), np.array([1.0] * (len(xs) - 1) + [float(blank)])


#: Significance that labels a token toxic: relative to the strongest token, or, for tokens that hardly any clean text holds, by itself.
SEED_Z, SEED_SHARE, PURE_Z, PURE = 4.5, 0.25, 4.0, 10


def _is_seed(r, top: float) -> bool:
    """A language with few documents has no token as significant as the strongest of all, but it has pure ones."""
    return r["z"] >= max(SEED_Z, SEED_SHARE * top) or (r["z"] >= PURE_Z and r["a"] >= PURE * r["b"])


def _fit_crf(sample: list, evidence: list, steps: int = 200, rate: float = 0.15) -> Model:
    """CRF weights by gradient ascent (Adam) on the conditional log-likelihood of the tag sequences."""
    top = max(float(r["z"]) for r in evidence)
    seeds = {r["token"] for r in evidence if _is_seed(r, top)}
    feats = {r["token"]: [1.0, float(r["odds"]) / 4, float(r["z"]) / top, float(r["token"] in seeds)] for r in evidence}
    x, y, weight = _training_segments(sample, feats, seeds)
    n = weight.sum()
    pair = y[:, :-1] * 2 + y[:, 1:]
    seen = np.array([((pair == k) * weight[:, None]).sum() for k in range(4)])
    k = x.shape[2]
    theta, m, v = np.concatenate([[-3.0], np.zeros(k - 1), np.zeros(3)]), 0.0, 0.0
    for t in range(1, steps + 1):
        emit = np.stack([np.ones(x.shape[:2]), np.exp(np.clip(x @ theta[:k], -30, 30))], axis=2)
        trans = np.exp(np.array([[0.0, theta[k]], [theta[k + 1], theta[k + 2]]]))
        fwd, bwd = np.empty_like(emit), np.empty_like(emit)
        a = emit[:, 0]
        fwd[:, 0] = a / a.sum(axis=1, keepdims=True)
        for i in range(1, SEGMENT):
            a = (fwd[:, i - 1] @ trans) * emit[:, i]
            fwd[:, i] = a / a.sum(axis=1, keepdims=True)
        bwd[:, -1] = 0.5
        for i in range(SEGMENT - 2, -1, -1):
            b = (emit[:, i + 1] * bwd[:, i + 1]) @ trans.T
            bwd[:, i] = b / b.sum(axis=1, keepdims=True)
        p = fwd * bwd
        p = p[:, :, 1] / p.sum(axis=2)
        joint = fwd[:, :-1, :, None] * trans * (emit * bwd)[:, 1:, None, :]
        joint = (joint / joint.sum(axis=(2, 3), keepdims=True) * weight[:, None, None, None]).sum(axis=(0, 1)).reshape(4)
        grad = np.concatenate([np.einsum("s,sp,spk->k", weight, y - p, x), (seen - joint)[1:]]) / n - 1e-4 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = theta + rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    gains = {w: float(np.dot(f, theta[1:k])) for w, f in feats.items()}
    return Model(lexicon=gains, bias=float(theta[0]), trans=[[0.0, float(theta[k])], [float(theta[k + 1]), float(theta[k + 2])]])


def train(docs: DataFrame, labels: DataFrame, max_fit_docs: int = 4000, max_lexicon: int = 2000, min_docs: float = 4.0) -> Model:
    """Fit on labelled documents outside the held-out fold."""
    marked = labels.select("doc_id", "toxic").where("toxic IN (0, 1)").where(~held_out(F.col("doc_id")))
    if marked.count() <= BROADCAST_ROWS:
        marked = F.broadcast(marked)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(marked, "doc_id")
    rows = stored(rows.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")), "labelled")
    evidence = token_evidence(rows, min_docs, max_lexicon)
    total = rows.agg(F.count("*").alias("n"), F.avg("toxic").alias("rate")).first()
    rate = float(total["rate"] or 0.0)
    flat = Model(doc=[0.0, 0.0, 0.0, math.log(max(rate, 1e-9) / max(1 - rate, 1e-9))])
    if not evidence:
        return flat
    # sample by hash, of max_fit_docs rows in expectation; only informative tokens and their places leave the executors
    known = {r["token"]: float(r["z"]) for r in evidence}

    def reduce_docs(batches):
        for batch in batches:
            own = [_tokens(t) for t in batch.column(0).to_pylist()]
            keys = [[max((k for k in _keys(w) if k in known), key=known.get, default=None) for w in toks] for toks in own]
            places = [[i for i, k in enumerate(ks) if k] for ks in keys]
            yield pa.RecordBatch.from_pydict({
                "places": pa.array(places, pa.list_(pa.int32())), "toks": pa.array([[k for k in ks if k] for ks in keys], pa.list_(pa.string())),
                "n": pa.array(list(map(len, own)), pa.int64()), "toxic": batch.column(1).cast(pa.int32())})

    picked = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(int(total["n"]))) < max_fit_docs).select("text", "toxic")
    sample = [tuple(r) for r in map_batches(picked, reduce_docs, "places array<int>, toks array<string>, n bigint, toxic int").collect()]
    if not sample:
        return flat
    sample.sort()
    model = _fit_crf(sample, evidence)
    model.doc = _calibrate(rows, model)
    return model


def _calibrate(rows: DataFrame, model: Model, steps: int = 25) -> list[float]:
    """Logistic weights over all training documents: Newton steps on distributed sums."""

    def features(batches):
        scorer = Scorer(model)
        for batch in batches:
            x = [scorer.features(*scorer.document(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"x": pa.array(x, pa.list_(pa.float64())), "y": batch.column(1).cast(pa.int32())})

    # features repeat a lot (no evidence at all): distinct feature rows with counts stay small and are summed on executors
    table = map_batches(rows.select("text", "toxic"), features, "x array<double>, y int")
    table = table.select(F.transform("x", lambda v: F.round(v, 2)).alias("x"), "y").groupBy("x").agg(F.count("*").alias("n"), F.sum("y").alias("y"))
    got = table.persist()
    try:
        w = np.zeros(4)
        for _ in range(steps):
            z = sum((F.col("x")[i] * float(w[i]) for i in range(4)), F.lit(0.0))
            p = 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))))
            sums = [F.sum(F.col("x")[i] * (F.col("y") - F.col("n") * p)).alias(f"g{i}") for i in range(4)]
            sums += [F.sum(F.col("x")[i] * F.col("x")[j] * F.col("n") * p * (1 - p)).alias(f"h{i}{j}") for i in range(4) for j in range(i, 4)]
            r = got.agg(*sums).first()
            grad = np.array([r[f"g{i}"] for i in range(4)]) - 0.05 * w
            hess = np.array([[r[f"h{min(i, j)}{max(i, j)}"] for j in range(4)] for i in range(4)]) + 0.05 * np.eye(4)
            step = np.linalg.solve(hess, grad)
            new = w + np.clip(step, -3, 3)
            new[:3] = np.maximum(new[:3], 0.0)  # more toxic evidence never lowers a score
            done, w = np.abs(new - w).max() < 1e-4, new
            if done:
                break
    finally:
        got.unpersist()
    return [float(v) for v in w]


def score_documents(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """(doc_id, score, predicted, n_tokens, spans) of every row; ``spans`` are character offsets of toxic tokens."""

    def run(batches):
        scorer = Scorer(model)
        for batch in batches:
            scores, sizes, spans = [], [], []
            for t in batch.column(1).to_pylist():
                marks, n = scorer.document(t or "")
                scores.append(scorer.score(marks, n))
                sizes.append(n)
                spans.append([{"start": a, "stop": b} for a, b in scorer.spans(t or "", marks, least)])
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0).cast(pa.int64()), "score": pa.array(scores, pa.float64()), "n_tokens": pa.array(sizes, pa.int64()),
                "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))})

    out = map_batches(docs.select("doc_id", "text"), run, "doc_id bigint, score double, n_tokens bigint, spans array<struct<start:int,stop:int>>")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows predicted toxic; every column passes through."""
    model = train(docs, labels)
    at = docs.columns.index("text")

    def run(batches):
        scorer = Scorer(model)
        for batch in batches:
            fine = [scorer.score(*scorer.document(t or "")) < 0.5 for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(fine, pa.bool_()))

    return map_batches(docs, run, docs.schema)


def toxic_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on the labels and score every document: (doc_id, held_out, score, predicted, n_tokens, spans)."""
    out = score_documents(docs, train(docs, labels))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted", "n_tokens", "spans")
