"""Quality rules: base figures of a text, and a linear-chain CRF that marks each line content or boilerplate."""

from __future__ import annotations

import math
import operator
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import arrow_map, words_of

SYMBOLS = "#*$%&|<>"
#: The most labelled texts that are learned from, and the most lines of each: of a longer text a window of so many.
MAX_TRAIN, MAX_LINES = 1500, 256
CONTENT_SHARE = 0.5
#: Phrases of notices, menus and forms.
NOTICE = re.compile(r"(?i)\b(?:licen[sc]ed?|copyright|rights reserved|terms of (?:use|service)|privacy policy|cookies?|subscribe|newsletter|sign (?:up|in)|log ?in|click here|read more|share this|powered by)\b|©|\(c\)|://")
FEATURES = ("one", "log_words", "short", "symbols", "upper", "digits", "seen", "same_as_last", "same", "ends", "bangs", "capital", "notice", "first", "word_chars", "marked", "bars")


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words that lie in a window of `width` words found twice or more in the text, the first included.

    Windows get exact numbers by pairing: words -> pairs -> fours -> fives; memory is a few numbers for each word.
    """
    n = len(words)
    if n <= width:
        return 0
    seen: dict[bytes, int] = {}
    one = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    number, span = one, 1
    while span < width:
        step = min(span, width - span)
        right = number if step == span else one
        paired = number[: n - span - step + 1] * (int(right.max()) + 1) + right[span : n - step + 1]
        _, number = np.unique(paired, return_inverse=True)
        span += step
    twice = np.bincount(number)[number] > 1
    delta = np.zeros(n + 1, np.int64)
    delta[: len(twice)] += twice
    delta[width : width + len(twice)] -= twice
    return int((np.cumsum(delta[:n]) > 0).sum())


@dataclass
class Base:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int

    @property
    def failed(self) -> bool:
        return self.n_words < 10 or 100 * self.n_repeat_words > 20 * self.n_words


def base_figures(text: str | None, words: list[bytes]) -> Base:
    text = text or ""
    lines = [s for s in text.split("\n") if words_of(s)]
    blanks = sum(map(text.count, " \t\n\v\f\r"))
    return Base(len(words), len(text) - blanks, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words))


def line_features(text: str | None) -> tuple[list[list[float]], list[int]]:
    """FEATURES and number of words of every line that has a word."""
    rows, sizes, seen = [], [], set()
    for line in (text or "").split("\n"):
        words = words_of(line)
        if not words:
            continue
        n, chars = len(words), len(line)
        symbols = sum(map(line.count, SYMBOLS))
        rows.append([
            1.0, min(math.log1p(n) / 4, 2), 1.0 if n < 4 else 0.0, min(symbols / n, 2), sum(w.isupper() for w in words) / n, min(4 * sum(map(line.count, "0123456789")) / chars, 2),
            1.0 if line in seen else 0.0, sum(map(operator.eq, words, words[1:])) / n, 1 - len(set(words)) / n if n > 5 else 0.0, 1.0 if line.rstrip()[-1:] in ".!?\"'" else 0.0,
            min(line.count("!") / n, 2), 1.0 if line[:1].isupper() else 0.0, 1.0 if NOTICE.search(line) else 0.0, 1.0 if not rows else 0.0, min(chars / n / 10, 2),
            sum(len(w) > 1 and w[-1] in _MARKS for w in words) / n if symbols else 0.0, words.count(b"|") / n if symbols else 0.0,
        ])
        sizes.append(n)
        seen.add(line)
    return rows, sizes


_MARKS = SYMBOLS.encode()
#: A line of a bad text is boilerplate if one of these is reached: words that end in a symbol, bars between words,
#: words in capitals, words that repeat the one before. The others, and those of good texts, are content; notices are
#: boilerplate in either.
JUNK = {"marked": 0.5, "bars": 0.2, "upper": 0.5, "same_as_last": 0.4}
_AT = {name: i for i, name in enumerate(FEATURES)}


def weak_labels(rows: list[list[float]], quality: int) -> list[int]:
    """What each line of a text of this quality is taken for in training: 1 content, 0 boilerplate."""
    junk = lambda x: quality == 0 and any(x[_AT[name]] >= least for name, least in JUNK.items())
    return [0 if x[_AT["notice"]] or junk(x) else 1 for x in rows]


@dataclass
class Chain:
    """Emissions (2 x features), transitions (from x to) and start weights; label 1 is content, 0 boilerplate."""

    emit: np.ndarray
    move: np.ndarray
    start: np.ndarray

    def decode(self, rows: list[list[float]]) -> list[int]:
        """Viterbi: the most likely sequence of labels; on equal weights, content."""
        if not rows:
            return []
        e = (np.array(rows) @ self.emit.T).tolist()
        (m00, m01), (m10, m11) = self.move.tolist()
        a, b = self.start[0] + e[0][0], self.start[1] + e[0][1]
        back = []
        for x, y in e[1:]:
            to0, to1 = (0 if a + m00 > b + m10 else 1), (0 if a + m01 > b + m11 else 1)
            back.append((to0, to1))
            a, b = (a + m00 if to0 == 0 else b + m10) + x, (a + m01 if to1 == 0 else b + m11) + y
        out = [0 if a > b else 1]
        for step in reversed(back):
            out.append(step[out[-1]])
        return out[::-1]


def log_add(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis)
    return top + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis))


def expected(x: np.ndarray, mask: np.ndarray, p: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over sequences of up to len(x) lines at once: expected features by label, pairs of labels and
    first labels. x: (lines, sequences, features); mask: whether a sequence has that line."""
    steps, n = mask.shape
    e = x @ p[0].T
    f = np.zeros((steps, n, 2))
    f[0] = p[2] + e[0]
    for k in range(1, steps):
        f[k] = np.where(mask[k][:, None] > 0, log_add(f[k - 1][:, :, None] + p[1], 1) + e[k], f[k - 1])
    z = log_add(f[-1], 1)
    b, pairs = np.zeros((n, 2)), np.zeros((2, 2))
    gone = np.zeros((steps, n, 2))
    gone[-1] = np.exp(f[-1] + b - z[:, None])
    for k in range(steps - 1, 0, -1):
        on = mask[k][:, None, None] > 0
        joint = f[k - 1][:, :, None] + p[1] + (e[k] + b)[:, None, :]
        pairs += (np.exp(joint - z[:, None, None]) * on).sum(0)
        b = np.where(on[:, :, 0], log_add(p[1] + (e[k] + b)[:, None, :], 2), b)
        gone[k - 1] = np.exp(f[k - 1] + b - z[:, None])
    return np.einsum("tnf,tn,tnk->kf", x, mask, gone, optimize=True), pairs, gone[0].sum(0)


def fit(sequences: list[list[list[float]]], labels: list[list[int]], rounds: int = 120, rate: float = 0.1, decay: float = 1e-3) -> Chain:
    """Maximum likelihood by Adam; labels: one for each line of each sequence. Sequences of like lengths are worked on
    together. Without lines every line is content."""
    p = [np.zeros((2, len(FEATURES))), np.zeros((2, 2)), np.array([0.0, 1e-3])]
    kept = sorted(((s, y) for s, y in zip(sequences, labels) if s), key=lambda r: len(r[0]))
    if not kept:
        return Chain(*p)
    seen = [np.zeros_like(a) for a in p]
    groups: list[tuple[np.ndarray, np.ndarray]] = []
    at = 0
    while at < len(kept):
        end = next((i for i in range(at, len(kept)) if len(kept[i][0]) > 2 * len(kept[at][0])), len(kept))
        part = kept[at:end]
        x, mask = np.zeros((len(part[-1][0]), len(part), len(FEATURES))), np.zeros((len(part[-1][0]), len(part)))
        for i, (s, y) in enumerate(part):
            x[: len(s), i], mask[: len(s), i] = s, 1
            hot = np.eye(2)[y]
            seen[0] += hot.T @ np.array(s)
            seen[1] += hot[:-1].T @ hot[1:]
            seen[2] += hot[0]
        groups.append((x, mask))
        at = end
    lines = sum(mask.sum() for _, mask in groups)
    first, second = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for t in range(1, rounds + 1):
        sums = [sum(parts) for parts in zip(*(expected(x, mask, p) for x, mask in groups))]
        for a, m, v, want, have in zip(p, first, second, seen, sums):
            g = (have - want) / lines + decay * a
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            a -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Chain(*p)


def window(rows: list, name: str, most: int) -> list:
    """All of rows, or `most` of them in a row, from a place that the name's hash decides."""
    if len(rows) <= most:
        return rows
    at = zlib.crc32(name.encode()) % (len(rows) - most + 1)
    return rows[at : at + most]


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_train: int = MAX_TRAIN, max_lines: int = MAX_LINES) -> Chain:
    """Fits the chain to the lines of labelled texts, each line labelled by weak_labels().

    It learns from at most `max_train` texts (those with the least hashes of their ids) and of each from at most
    `max_lines` lines; only these lines' figures reach the driver. A doc_id with several labels has the largest, one
    with several texts the first of them by code point; null ids and labels are left out.
    """
    known = labels.select(F.col(doc_id).cast("long").alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    y_of = {r.id: r.y for r in known.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_train).collect()}
    wanted = F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in y_of], "id long"))  # max_train rows at most
    found = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("t")).join(wanted, "id", "left_semi").groupBy("id").agg(F.min("t").alias("t"))

    def rows(it):
        for i, t in it:
            yield i, window(line_features(t)[0], str(i), max_lines)

    arrow = pa.schema([("id", pa.int64()), ("x", pa.list_(pa.list_(pa.float64())))])
    made = sorted(arrow_map(found, rows, "id long, x array<array<double>>", arrow).collect(), key=lambda r: r.id)
    return fit([r.x for r in made], [weak_labels(r.x, y_of[r.id]) for r in made])


def judge(docs: DataFrame, chain: Chain, doc_id: str = "doc_id", text: str = "text", share: float = CONTENT_SHARE) -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    content_words (words in lines marked content).

    kept: the base did not fail and at least `share` of the words lie in content lines. Null and empty texts have no
    words, so their base fails. Repeated rows are judged alike; an empty table gives none. Other columns are not read.
    """

    def rows(it):
        for i, t in it:
            words = words_of(t)
            b = base_figures(t, words)
            lines, sizes = line_features(t)
            content = sum(s for s, y in zip(sizes, chain.decode(lines)) if y)
            yield i, b.n_words, b.word_chars, b.n_symbols, b.n_dup_lines, b.n_repeat_words, b.failed, not b.failed and content >= share * b.n_words, content

    ids = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    longs = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    arrow = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in longs), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("content_words", pa.int64())])
    return arrow_map(ids, rows, f"doc_id long, {', '.join(f'{c} long' for c in longs)}, base_failed boolean, kept boolean, content_words long", arrow)
