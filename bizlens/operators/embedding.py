"""Name embeddings without a vocabulary on the driver.

Words that stand near each other in names are counted, weighted by positive
pointwise mutual information, and the sparse symmetric matrix of the weights is
factored by a randomised range finder:

1. ``pairs``: counts of (word, neighbour) within a window.  Equal names are
   counted first, so a name that a third of all rows share is taken apart once.
2. The matrix times random signs (hashes of word and column) gives a table of
   ``dim + EXTRA`` numbers a word; its small Gram matrix makes the columns
   orthogonal, and the matrix times these gives the small core that is solved.
3. A word's vector is its row of the factor.  Vectors stay a table.

Every step is a join or an aggregation over tables of words or pairs; the driver
sees Gram matrices of (dim + EXTRA) squared numbers, whatever the vocabulary.  The
number of tasks follows the session and the data.

A word without neighbours has no vector; a name's vector is the mean of its
words' vectors, and a name without a known word gets zeros.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .joins import attach_embedding
from .models import W2V_DIM, W2V_WINDOW, name_tokens

#: Columns beyond the wanted ones that the range finder draws.
EXTRA = 8


def word_pairs(names: DataFrame, col: str = "clean_name", window: int = W2V_WINDOW) -> DataFrame:
    """(a, b, n): how often ``b`` stands within ``window`` words of ``a``, in either direction."""
    words = F.filter(name_tokens(col), lambda w: w != "")
    texts = names.where(F.col(col).isNotNull()).groupBy(words.alias("ws")).agg(F.count(F.lit(1)).alias("n"))
    near = F.flatten(F.transform("ws", lambda w, i: F.transform(F.slice("ws", i + 2, F.lit(window)), lambda v: F.struct(w.alias("a"), v.alias("b")))))
    one = texts.select(F.explode(near).alias("p"), "n").select("p.a", "p.b", "n")
    return one.unionAll(one.select("b", "a", "n")).groupBy("a", "b").agg(F.sum("n").alias("n"))


def mutual_information(pairs: DataFrame) -> DataFrame:
    """(a, b, m): positive pointwise mutual information of the pairs."""
    margin = pairs.groupBy("a").agg(F.sum("n").alias("na"))
    total = pairs.agg(F.sum("n").alias("t"))
    both = pairs.join(margin, "a").join(margin.select(F.col("a").alias("b"), F.col("na").alias("nb")), "b").crossJoin(F.broadcast(total))  # one row
    m = F.log(F.col("n").cast("double") * F.col("t") / (F.col("na").cast("double") * F.col("nb")))
    return both.select("a", "b", m.alias("m")).where("m > 0")


def _times(matrix: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The matrix (a, b, m) times a table (word, v) of ``k`` columns."""
    joined = matrix.join(vectors, F.col("b") == F.col("word"))
    return joined.groupBy("a").agg(F.array(*[F.sum(F.col("m") * F.col("v")[j]) for j in range(k)]).alias("v")).withColumnRenamed("a", "word")


def _block(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _gram(rows: DataFrame, x: str, y: str) -> np.ndarray:
    """x' y of two vector columns: a partial product a task, summed by place."""
    def partial(batches):
        total = None
        for b in batches:
            if b.num_rows:
                part = _block(b.column(0)).T @ _block(b.column(1))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(total.size), pa.int32()), "v": pa.array(total.ravel(), pa.float64())})

    places = rows.select(x, y).mapInArrow(partial, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()  # k squared
    k = int(round(len(places) ** 0.5))
    return np.array([r["v"] for r in places]).reshape(k, k)


def _mapped(vectors: DataFrame, matrix: np.ndarray) -> DataFrame:
    """(word, v) with every v times a small matrix."""
    def run(batches):
        for b in batches:
            out = _block(b.column(1)) @ matrix if b.num_rows else np.zeros((0, matrix.shape[1]))
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * matrix.shape[1], pa.int32()), pa.array(out.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), values], names=["word", "v"])

    return vectors.select("word", "v").mapInArrow(run, "word string, v array<double>")


def word_vectors(names: DataFrame, col: str = "clean_name", dim: int = W2V_DIM, window: int = W2V_WINDOW, seed: int = 42) -> DataFrame:
    """(word, vector) of every word with neighbours; ``vector`` is an array of ``dim`` floats."""
    ensure_checkpoint_dir(names.sparkSession)
    matrix = mutual_information(word_pairs(names, col, window)).checkpoint()
    k = dim + EXTRA
    signs: Column = F.array(*[F.when(F.xxhash64("word", F.lit(seed), F.lit(j)) % 2 == 0, 1.0).otherwise(-1.0) for j in range(k)])
    words = matrix.select(F.col("b").alias("word")).distinct()
    first = _times(matrix, words.select("word", signs.alias("v")), k).checkpoint()
    gram = _gram(first, "v", "v")
    if not gram.size:
        return first.select("word", F.array().cast("array<float>").alias("vector"))
    size, turn = np.linalg.eigh(gram)
    real = size > 1e-10 * size.max()
    range_ = _mapped(first, turn[:, real] / np.sqrt(size[real])).checkpoint()
    image = _times(matrix, range_, int(real.sum())).withColumnRenamed("v", "z")
    core = _gram(range_.join(image, "word"), "v", "z")
    value, turn = np.linalg.eigh((core + core.T) / 2)
    most = np.argsort(-np.abs(value))[:dim]
    factor = np.zeros((len(value), dim))
    factor[:, :len(most)] = turn[:, most] * np.sqrt(np.abs(value[most]))
    return _mapped(range_, factor).select("word", F.col("v").cast("array<float>").alias("vector")).checkpoint()


def export_name_vectors(names: DataFrame, vectors: DataFrame, dim: int = W2V_DIM) -> DataFrame:
    """E4 + J6: (unique_id, business_name, cleaned_business_name, embedding_array) by joins with the vector table.

    A name is looked up once, however many rows have it.
    """
    known = names.select("clean_name").where(F.col("clean_name").isNotNull()).distinct()
    words = known.select("clean_name", F.explode(name_tokens("clean_name")).alias("word")).join(vectors, "word")
    means = words.groupBy("clean_name").agg(F.array(*[F.avg(F.col("vector")[j]).cast("float") for j in range(dim)]).alias("vector"))
    base = names.select("unique_id", F.col("bizname").alias("business_name"), F.col("clean_name").alias("cleaned_business_name"))
    return attach_embedding(base, means, "cleaned_business_name", word_col="clean_name", dim=dim)
