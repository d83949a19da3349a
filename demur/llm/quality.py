"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, a calibrated probability.

A token is a word or a run of other signs. Every token has a sparse random index vector, drawn from the hash of its form; the vector of a
known token is its index vector plus the sum of the index vectors that stood around it in the training sample, each of length one. Tokens
outside the vocabulary share the vector of their shape (case, kind, length). Counts of repeated neighbours, repeated words and repeated lines
enter as tokens of their own. A document is the mean over its tokens; a network of one hidden layer gives a score,
and a temperature fitted on documents it was not trained on turns it into a probability.

Learned from: ``SAMPLE_PER_LABEL`` labelled documents of either label outside the held-out fold, those of the smallest id hashes;
``VOCABULARY`` tokens, the most frequent of the sample. Scoring reads whole texts and nothing but the text.

Rows: null and empty texts have one token of their own and get a score; labels that are null or not 0 or 1, and null
ids, are not learned from; a document labelled twice counts once per label; repeated rows give repeated rows; with fewer than one document of
either label the score is the share of label 1 (0.5 without labels); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from demur.sources.staging import stage

from .common import held, held_out, map_text, sample_per_class

SAMPLE_PER_LABEL = 2000
VOCABULARY = 20_000
DIM, SPIKES, REACH, HIDDEN = 64, 8, 2, 24
KEEP_FROM = 0.3
REMEMBERED_TOKENS = 200_000
#: Tokens of a text that are looked at together.
PART = 65_536
token_pattern = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
tokens = token_pattern.findall
REPEATED, SEEN_BEFORE, SAME_LINE, EMPTY = "<repeated>", "<seen before>", "<same line>", "<empty>"


def index_vector(form: str) -> np.ndarray:
    """Sparse random signs, the same for a form in every process."""
    draw = np.random.default_rng(zlib.crc32(form.encode()))
    out = np.zeros(DIM, np.float32)
    out[draw.choice(DIM, SPIKES, replace=False)] = draw.choice([-1.0, 1.0], SPIKES) / np.sqrt(SPIKES)
    return out


def shape(token: str) -> str:
    if token.isdigit():
        kind = "digits"
    elif not token[0].isalpha():
        kind = "signs " + token[0]
    else:
        kind = "upper" if token.isupper() else "lower" if token.islower() else "title" if token.istitle() else "mixed"
    return f"<{kind} {min(len(token), 12)}>"


def token_parts(text: str) -> Iterator[list[str]]:
    """The tokens of a text in order, ``PART`` at a time, so that a very long text needs no more memory than a part and its distinct tokens."""
    if len(text) <= PART:
        if found := tokens(text):
            yield found
        return
    each = (m[0] for m in token_pattern.finditer(text))
    while found := list(islice(each, PART)):
        yield found


def line_counts(text: str) -> tuple[int, int]:
    """How many lines a text has, and how many different ones."""
    seen, start = set(), 0
    while (end := text.find("\n", start)) >= 0:
        seen.add(text[start:end])
        start = end + 1
    seen.add(text[start:])
    return text.count("\n") + 1, len(seen)


@dataclass
class Model:
    vocabulary: dict[str, np.ndarray]
    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    temperature: float
    constant: float | None = None


class Pooler:
    """Mean token vector of texts; remembers where the vector of a token stands."""

    def __init__(self, vocabulary: dict[str, np.ndarray]):
        self.vocabulary, self.rows, self.table, self.place = vocabulary, [], np.zeros((0, DIM), np.float32), {}
        self.shapes: dict[str, int] = {}
        self.special = [self._add(index_vector(form)) for form in (REPEATED, SEEN_BEFORE, SAME_LINE, EMPTY)]
        self.words = {w: self._add(v + index_vector(shape(w))) for w, v in vocabulary.items()}
        self._freeze()

    def _add(self, vector: np.ndarray) -> int:
        self.rows.append(vector)
        return len(self.rows) - 1

    def _freeze(self) -> None:
        self.table = np.vstack(self.rows)

    def _locate(self, token: str) -> int:
        at = self.place.get(token)
        if at is None:
            at = self.words.get(token)
            if at is None:
                form = shape(token)
                if form not in self.shapes:
                    self.shapes[form] = self._add(index_vector(form))
                at = self.shapes[form]
            if len(self.place) >= REMEMBERED_TOKENS:
                self.place.clear()
            self.place[token] = at
        return at

    def pool(self, text: str | None) -> np.ndarray:
        total, n, repeated, seen, last = np.zeros(DIM, np.float32), 0, 0, set(), None
        for found in token_parts(text or ""):
            try:
                at = list(map(self.place.__getitem__, found))
            except KeyError:
                at = list(map(self._locate, found))
                if len(self.rows) > len(self.table):
                    self._freeze()
            total = total + self.table[np.array(at)].sum(0)
            repeated += sum(map(str.__eq__, found, found[1:])) + (found[0] == last)
            n, last = n + len(found), found[-1]
            seen.update(found)
        if not n:
            return self.table[self.special[3]].copy()
        count, distinct = line_counts(text)
        extra = (repeated, n - len(seen), (count - distinct) * n / count)
        for k, row in zip(extra, self.special):
            total = total + np.float32(k) * self.table[row]
        return total / n


def _context_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per token of a task: its count and the sum of the index vectors around it."""
    counts: Counter = Counter()
    sums: dict[str, np.ndarray] = {}
    index: dict[str, np.ndarray] = {}
    for batch in batches:
        for text in batch.column(0).to_pylist():
            parts = token_parts(text or "")
            before, found = [], next(parts, None)
            while found:
                after = next(parts, None)
                # The part with the tokens within reach on either side.
                wide = before + found + (after or [])[:REACH]
                for t in wide:
                    if t not in index:
                        index[t] = index_vector(t)
                vectors = np.vstack([index[t] for t in wide])
                around = np.zeros_like(vectors)
                for step in range(1, REACH + 1):
                    around[step:] += vectors[:-step]
                    around[:-step] += vectors[step:]
                counts.update(found)
                for t, v in zip(found, around[len(before):]):
                    if t in sums:
                        sums[t] += v
                    else:
                        sums[t] = v.copy()
                before, found = found[-REACH:], after
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64()),
         pa.array([sums[t].tolist() for t in counts], pa.list_(pa.float32()))], names=["token", "n", "around"])


def learn_vectors(sample: DataFrame, size: int = VOCABULARY) -> dict[str, np.ndarray]:
    """token -> vector of the most frequent tokens of a bounded sample of texts."""
    sums = [F.sum(F.get("around", F.lit(i))).alias(f"a{i}") for i in range(DIM)]
    rows = (sample.select("text").mapInArrow(_context_counts, "token string, n long, around array<float>")
            .groupBy("token").agg(F.sum("n").alias("n"), *sums).where(F.col("n") >= 3)
            .orderBy(F.desc("n"), "token").limit(size).select("token", F.array(*[F.col(f"a{i}").cast("float") for i in range(DIM)]).alias("v")).collect())
    out = {}
    for row in rows:
        v = np.array(row["v"], np.float32)
        out[row["token"]] = index_vector(row["token"]) + v / max(np.linalg.norm(v), 1e-9)
    return out


def _forward(x: np.ndarray, w: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    h = np.tanh(x @ w[0] + w[1])
    return h, h @ w[2] + w[3][0]


def train_network(x: np.ndarray, y: np.ndarray, steps: int = 400, rate: float = 0.02, decay: float = 1e-3, seed: int = 7) -> list[np.ndarray]:
    """Two layers by full-batch Adam on the logistic loss."""
    draw = np.random.default_rng(seed)
    w = [draw.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), draw.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    for step in range(1, steps + 1):
        h, logit = _forward(x, w)
        error = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - y) / len(y)
        back = np.outer(error, w[2]) * (1 - h * h)
        grads = [x.T @ back + decay * w[0], back.sum(0), h.T @ error + decay * w[2], np.array([error.sum()])]
        for a, g, m, v in zip(w, grads, first, second):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            a -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return w


def fit_temperature(logit: np.ndarray, y: np.ndarray) -> float:
    """The temperature of the least log loss, on a grid from 0.25 to 16."""
    grid = np.geomspace(0.25, 16, 61)
    loss = [np.mean(np.logaddexp(0, np.where(y == 1, -1, 1) * logit / t)) for t in grid]
    return float(grid[int(np.argmin(loss))])


def learn(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> Model:
    """Model from ``docs`` (doc_id, text) and ``labels`` (doc_id, quality)."""
    usable = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", "quality").distinct()
    chosen = sample_per_class(usable, "quality", "doc_id", per_label)
    sample = stage(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "labelled")
    vocabulary = learn_vectors(sample)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pooler = Pooler(shared.value)
        for batch in batches:
            vectors = [pooler.pool(t).tolist() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(vectors, pa.list_(pa.float32()))], names=["doc_id", "quality", "v"])

    rows = sample.select("doc_id", F.col("quality").cast("int"), "text").mapInArrow(pooled, "doc_id long, quality int, v array<float>").collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], r["quality"]))
    y = np.array([r["quality"] for r in rows], float)
    if len(set(y.tolist())) < 2:
        return Model(vocabulary, np.zeros(DIM), np.ones(DIM), [], 1.0, float(y.mean()) if len(y) else 0.5)
    x = np.array([r["v"] for r in rows], float)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    x = (x - mean) / scale
    apart = np.arange(len(y)) % 5 == 0
    if len(set(y[~apart].tolist())) < 2:
        apart[:] = False
    weights = train_network(x[~apart], y[~apart])
    check = apart if apart.any() else ~apart
    return Model(vocabulary, mean, scale, weights, fit_temperature(_forward(x[check], weights)[1], y[check]))


def probability(model: Model, pooled: np.ndarray) -> np.ndarray:
    if model.constant is not None:
        return np.full(len(pooled), model.constant)
    logit = _forward((pooled - model.mean) / model.scale, model.weights)[1]
    return 1 / (1 + np.exp(-np.clip(logit / model.temperature, -40, 40)))


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``score``, the probability of label 1, of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key = uuid.uuid4().hex

    def run(texts: pa.Array) -> list[pa.Array]:
        pooler = held(key, lambda: Pooler(shared.value.vocabulary))
        vectors = np.array([pooler.pool(t.as_py()) for t in texts], float).reshape(-1, DIM)
        return [pa.array(probability(shared.value, vectors), pa.float64())]

    return map_text(docs, list(keep), run, "score double")
