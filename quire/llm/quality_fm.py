"""Quality classifier: a factorisation machine on hashed words, structure statistics and metadata."""

from __future__ import annotations

import operator
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import append_columns, arrow_map, words_of

#: Hashed words, factors for each feature, and the most labelled rows that are learned from.
BUCKETS, FACTORS, MAX_TRAIN = 2048, 8, 3000
THRESHOLD = 0.3
STATS = ("log_words", "log_chars", "word_chars", "symbols", "upper", "digits", "stops", "same_as_last", "distinct", "top_word", "dup_lines", "line_words", "bangs", "blank", "told_chars", "told_gap")


def statistics(text: str | None, words: list[bytes], counts: Counter, told: int | None) -> list[float]:
    """STATS of a text; told: the number of characters that its metadata give, null if they give none."""
    n = max(len(words), 1)
    text = text or ""
    chars = max(len(text), 1)
    lines = [s for s in text.split("\n") if s and not s.isspace()]
    upper = sum(c for w, c in counts.items() if len(w) > 1 and w.isupper())
    return [
        np.log1p(len(words)), np.log1p(len(text)), sum(map(len, words)) / n, sum(map(text.count, "#*$%&|<>")) / n, upper / n,
        sum(map(text.count, "0123456789")) / chars, (text.count(".") + text.count(",")) / n, sum(map(operator.eq, words, words[1:])) / n,
        len(counts) / n ** 0.8, max(counts.values(), default=0) / n, 1 - len(set(lines)) / max(len(lines), 1), np.log1p(n / max(len(lines), 1)), text.count("!") / n, float(not words),
        np.log1p(max(told, 0)) if told is not None else np.log1p(len(text)), min(abs(told - len(text)) / chars, 4.0) if told is not None else 0.0,
    ]


def features(text: str | None, told: int | None = None) -> tuple[list[int], list[float], list[float]]:
    """Buckets of the words and their weights (unit length), and the statistics, of a whole text and its metadata."""
    words = words_of(text)
    counts = Counter(words)
    sums: dict[int, float] = {}
    for w, c in counts.items():
        k = zlib.crc32(w.strip(b".,;:!?").lower()) % BUCKETS
        sums[k] = sums.get(k, 0.0) + c
    weights = np.log1p(np.fromiter(sums.values(), float, len(sums)))
    return list(sums), (weights / max(np.linalg.norm(weights), 1e-9)).tolist(), statistics(text, words, counts, told)


@dataclass
class Machine:
    """bias + x.w + half the sum over factors of (x.v)^2 - (x^2).(v^2); the last len(STATS) features are statistics."""

    bias: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def scaled(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.scale, -4, 4)

    def score(self, texts: list[str | None], told: list[int | None] | None = None) -> np.ndarray:
        """In time linear in the features: each is met once for w and once for each factor."""
        made = [features(t, n) for t, n in zip(texts, told or [None] * len(texts))]
        if not made:
            return np.zeros(0)
        stats = self.scaled(np.array([m[2] for m in made]))
        sizes = np.array([len(m[0]) for m in made])
        at = np.concatenate([m[0] for m in made]).astype(int)
        x = np.concatenate([m[1] for m in made]).astype(float)
        row = np.repeat(np.arange(len(made)), sizes)
        total = np.column_stack([np.bincount(row, x * c, len(made)) for c in (self.w[at], *self.v[at].T)])
        square = np.column_stack([np.bincount(row, x * x * c * c, len(made)) for c in self.v[at].T])
        sv = self.v[BUCKETS:]
        linear = total[:, 0] + stats @ self.w[BUCKETS:]
        both = total[:, 1:] + stats @ sv
        pair = 0.5 * (both**2 - square - stats**2 @ sv**2).sum(1)
        return 1 / (1 + np.exp(-np.clip(self.bias + linear + pair, -30, 30)))


def fit(rows: list[tuple[list[int], list[float], list[float]]], labels: list[int], rounds: int = 250, rate: float = 0.03, decay: float = 1e-4, seed: int = 7) -> Machine:
    """Adam on the mean logistic loss over all rows. Without rows, or with one label only, it scores by the bias."""
    n, d = len(rows), BUCKETS + len(STATS)
    y = np.array(labels, np.float32)
    stats = np.array([r[2] for r in rows]).reshape(n, len(STATS))
    mean = stats.mean(0) if n else np.zeros(len(STATS))
    scale = (stats.std(0) if n else np.ones(len(STATS))) + 1e-3
    share = (y.sum() + 1) / (n + 2)
    m = Machine(float(np.log(share / (1 - share))), np.zeros(d, np.float32), np.random.default_rng(seed).normal(0, 0.02, (d, FACTORS)).astype(np.float32), mean, scale)
    if len(set(labels)) < 2:
        return m
    x = np.zeros((n, d), np.float32)
    for i, (at, val, _) in enumerate(rows):
        x[i, at] = val
    x[:, BUCKETS:] = m.scaled(stats)
    x2 = x * x
    p = [np.array([m.bias], np.float32), m.w, m.v]
    first, second = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for t in range(1, rounds + 1):
        xv = x @ p[2]
        z = p[0] + x @ p[1] + 0.5 * ((xv**2).sum(1) - (x2 @ p[2] ** 2).sum(1))
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        grads = [np.array([g.sum()]), x.T @ g + decay * p[1], x.T @ (g[:, None] * xv) - (x2.T @ g)[:, None] * p[2] + decay * p[2]]
        for a, b, c, gr in zip(p, first, second, grads):
            b += 0.1 * (gr - b)
            c += 0.001 * (gr * gr - c)
            a -= rate * (b / (1 - 0.9**t)) / (np.sqrt(c / (1 - 0.999**t)) + 1e-8)
    m.bias, m.w, m.v = float(p[0][0]), p[1], p[2]
    return m


def learnable(c) -> object:
    """Whether labels of this doc_id may be learned from: crc32 of its text mod 5 is not 0."""
    return F.crc32(c.cast("string")) % 5 != 0


def metadata(docs: DataFrame, n_chars: str = "n_chars"):
    """The characters that a row's metadata give, as a long; null where the column is missing or holds no number."""
    return F.col(n_chars).try_cast("long") if n_chars in docs.columns else F.lit(None).cast("long")


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_train: int = MAX_TRAIN) -> Machine:
    """Fits on the labelled rows that may be learned from, on `max_train` of them (those with the least hashes) if
    there are more. Only their ids, then their features (at most BUCKETS for each) reach the driver.

    A doc_id with several labels has the largest, one with several texts the first of them by code point; null ids and
    labels are left out.
    """
    known = labels.select(F.col(doc_id).cast("long").alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    picked = known.where(learnable(F.col("id"))).groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_train).collect()
    y_of = {r.id: r.y for r in picked}
    spark = docs.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(i,) for i in y_of], "id long"))  # max_train rows at most
    found = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("t"), metadata(docs).alias("m")).join(wanted, "id", "left_semi")
    found = found.groupBy("id").agg(F.min(F.struct("t", "m")).alias("r")).select("id", "r.t", "r.m")  # one row for each id

    def rows(it):
        for i, t, m in it:
            yield i, *features(t, m)

    kinds = [("id", "long", pa.int64()), ("at", "array<int>", pa.list_(pa.int32())), ("x", "array<float>", pa.list_(pa.float32())), ("s", "array<double>", pa.list_(pa.float64()))]
    made = arrow_map(found, rows, ", ".join(f"{n} {k}" for n, k, _ in kinds), pa.schema([(n, t) for n, _, t in kinds])).collect()
    made.sort(key=lambda r: r.id)
    return fit([(r.at, r.x, r.s) for r in made], [y_of[r.id] for r in made])


def score(docs: DataFrame, model: Machine, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    The score depends on the whole text and on n_chars, the only metadata that may be read; a null text scores as an
    empty one, a null or missing n_chars as the text's own. Null ids are not held out; repeated rows score alike; an
    empty table gives none. Other columns are not read.
    """
    ids = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), metadata(docs).alias("told"))
    scored = append_columns(ids, ["text", "told"], lambda texts, told: [(float(s),) for s in model.score(texts, told)], [("score", "double", pa.float64())])
    held = F.coalesce(~learnable(F.col("doc_id")), F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Machine, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score `threshold` or more, all columns as they were, in one pass without a shuffle."""
    name, told = "score", "told"
    while name in docs.columns or told in docs.columns:
        name, told = name + "_", told + "_"
    marked = docs.withColumn(told, metadata(docs))
    scored = append_columns(marked, [text, told], lambda texts, n: [(float(s),) for s in model.score(texts, n)], [(name, "double", pa.float64())], keep=lambda r: r[0] >= threshold)
    return scored.drop(name, told)
