"""Quality classifier: a hidden linear-chain conditional random field over the lines of a document.

Every line has a hidden label, good or bad. A line's features are its own (length, shares of symbols, digits and capitals,
repeated and distinct words, ...) and some of the line before and after it; transition weights tie neighbours.
Forward-backward gives each line's marginal of being good, and a document's score is their mean weighted by the lines'
length in bytes: the probability that a byte of it lies in a good line.

Labels are by document, so the lines' labels are summed out in training: the likelihood of "good" is the score, that of
"bad" is 1 - score, over all labellings of the lines. A good document may thus hold bad lines, and the other way round. So
that transitions see labels change, the sample is doubled by mixed sequences: a run of lines of a document of one label
inside one of the other, where each part has its own likelihood. The gradient of a marginal is a covariance under the
field; both it and the pairs' are had as the directional derivative of forward-backward, by central differences.

The model is fitted in the driver on a bounded sample: at most `SAMPLE_DOCS` labelled documents in the order of a seeded
hash, of at most `SAMPLE_LINES` lines each, and as many mixed sequences. Scoring is one pass over whole texts.

Null text is one empty line, as is empty text; every text has a score. A very long text is scored in its task as a whole,
which holds some 300 bytes for each of its lines. Labels that are null count as none, those that disagree for one id count
as the smaller. A null id has no label and is not held out. Repeated rows get equal scores; a score that ties with the
threshold is accepted. Without labels of both kinds nothing can be learned: every score is then the share of good documents
among the labelled ones, or 1 where there are none. An empty table gives an empty result. lang, source, labels and ids are
never features.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket_of, documents, labels, text_bytes, text_slices

SAMPLE_DOCS, SAMPLE_LINES = 4000, 200
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2

_SYMBOLS = b"#*$%&|<>{}[]=_~^\\/@+"
_MARKS = b".,;:!?\"'()-"
_DIGITS = b"0123456789"
_UPPERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_HIGH = bytes(range(128, 256))
_SPACES = b" \t\n\x0b\x0c\r"
_ENDS = (b".", b"!", b"?", b":", b'"', b")")
_STOPWORDS = frozenset(
    b"the of and to in is that it for with as was are by on this be from at or an not have has but which they we you he his"
    b" la le les de des du et un une en que qui dans pour sur est pas par au ce il elle ne se son sa der die das und ist"
    b" nicht ein eine zu mit den von dem auf sich im el los las del y por con para una su lo como al es".split()
)
OWN = 18
#: Own features that the lines before and after are also described by.
SHARED = (0, 2, 3, 7, 9, 10, 12)
WIDTH = OWN + 2 * len(SHARED) + 3


def _line(line: bytes, seen: set[bytes], before: bytes) -> tuple[float, ...]:
    n, words = len(line), line.split()
    m = len(words)
    if not m:
        return (0.0,) * 15 + (1.0, 0.0, 0.0)
    counts = Counter(words)
    cut = lambda chars: (n - len(line.translate(None, chars))) / n
    stop = sum(k for w, k in counts.items() if w.lower().strip(_MARKS) in _STOPWORDS)
    pairs = len(set(zip(words, words[1:])))
    return (
        np.log1p(m),
        np.log1p(n),
        cut(_SYMBOLS),
        (n - m + 1) / m / 10.0,
        cut(_MARKS),
        cut(_DIGITS),
        cut(_UPPERS),
        len(counts) / m,
        cut(_HIGH),
        max(counts.values()) / m,
        1.0 if line in seen else 0.0,
        1.0 if line == before else 0.0,
        stop / m,
        1.0 - pairs / (m - 1) if m > 1 else 0.0,
        1.0 if line.rstrip(_SPACES).endswith(_ENDS) else 0.0,
        0.0,
        max(map(len, words)) / 40.0,
        1.0 if m < 4 else 0.0,
    )


def own_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Each line's own features (lines x OWN) and length."""
    lines = text.split(b"\n")
    seen: set[bytes] = set()
    own, before = np.zeros((len(lines), OWN), np.float32), b""
    for i, line in enumerate(lines):
        own[i] = _line(line, seen, before)
        seen.add(line)
        before = line
    return own, np.array([len(x) + 1 for x in lines], np.float64)


def line_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Features (lines x WIDTH) and lengths of a text's lines."""
    own, lengths = own_features(text)
    return _with_neighbours(own), lengths


def _with_neighbours(own: np.ndarray) -> np.ndarray:
    n = len(own)
    out = np.zeros((n, WIDTH), np.float32)
    out[:, :OWN] = own
    k = len(SHARED)
    out[1:, OWN : OWN + k] = own[:-1, SHARED]
    out[:-1, OWN + k : OWN + 2 * k] = own[1:, SHARED]
    out[0, -3] = out[-1, -2] = 1.0
    out[:, -1] = 1.0
    return out


# --- the field -----------------------------------------------------------------------------------


@dataclass
class Field:
    """weights give a line's log-odds of good; transitions are log-potentials, [before, after], 0 bad and 1 good."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    transitions: np.ndarray

    def emissions(self, x: np.ndarray) -> np.ndarray:
        w = self.weights / self.scale
        return x @ w - self.mean @ w


def _messages(u: np.ndarray, active: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-odds of good of each line by what comes before it and itself, and by what comes after it; the logarithm of the weight of "bad" so far. All are steps x documents, and active[t] documents have more than t steps."""
    forward, backward, bad = np.zeros_like(u), np.zeros_like(u), np.zeros_like(u)
    if len(u):
        forward[0] = u[0]
    for t in range(1, len(u)):
        k = active[t]
        last = forward[t - 1, :k]
        to_bad = np.logaddexp(a[0, 0], last + a[1, 0])
        forward[t, :k] = u[t, :k] + np.logaddexp(a[0, 1], last + a[1, 1]) - to_bad
        bad[t, :k] = bad[t - 1, :k] + to_bad
    for t in range(len(u) - 2, -1, -1):
        k = active[t + 1]
        later = backward[t + 1, :k] + u[t + 1, :k]
        backward[t, :k] = np.logaddexp(a[1, 0], a[1, 1] + later) - np.logaddexp(a[0, 0], a[0, 1] + later)
    return forward, backward, bad


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def forward_backward(u: np.ndarray, n: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """u: log-odds (documents x steps), n: steps of each, most first. Gives the messages forward and backward (documents x steps), log Z and P(good)."""
    docs, steps = u.shape
    forward, backward, bad = _messages(np.ascontiguousarray(u.T), np.searchsorted(-n, -np.arange(steps), side="left"), a)
    end = (n - 1, np.arange(docs))
    return forward.T, backward.T, bad[end] + np.logaddexp(0.0, forward[end]), _sigmoid(forward + backward).T


class _Sequences:
    """Training sequences as one grid of steps x documents, longest first."""

    def __init__(self, texts: list[tuple]):
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i][0]))
        self.n = np.array([len(texts[i][0]) for i in order])
        self.x = np.concatenate([texts[i][0] for i in order]).astype(np.float64)
        self.y = np.concatenate([np.broadcast_to(np.asarray(texts[i][1], float), len(texts[i][0])) for i in order])
        self.weight = np.concatenate([np.asarray(texts[i][2], float) if len(texts[i]) > 2 else np.ones(len(texts[i][0])) for i in order])
        self.doc = np.repeat(np.arange(len(self.n)), self.n)
        self.step = np.arange(len(self.x)) - np.repeat(np.cumsum(self.n) - self.n, self.n)
        self.weight /= np.bincount(self.doc, self.weight)[self.doc]
        self.active = np.searchsorted(-self.n, -np.arange(int(self.n[0])), side="left")
        self.inner = np.flatnonzero(self.step > 0)
        # a document's lines of one label are one part: its label is that of a byte of it
        self.part = 2 * self.doc + (self.y > 0.5)

    def grid(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros((int(self.n[0]), len(self.n)))
        out[self.step, self.doc] = values
        return out

    def expectations(self, u: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of the lines and probabilities of pairs (inner lines x before x after)."""
        forward, backward, _ = _messages(self.grid(u), self.active, a)
        at = (self.step, self.doc)
        line = _sigmoid((forward + backward)[at])
        before, after = forward[self.step[self.inner] - 1, self.doc[self.inner]], backward[self.step[self.inner], self.doc[self.inner]] + u[self.inner]
        log = np.stack([np.zeros_like(before) + a[0, 0], after + a[0, 1], before + a[1, 0], before + after + a[1, 1]], axis=1)
        log -= log.max(axis=1, keepdims=True)
        pair = np.exp(log)
        return line, pair / pair.sum(axis=1, keepdims=True)

    def gradient(self, u: np.ndarray, a: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Mean negative log-likelihood, and its gradients by the lines' log-odds and by the transitions."""
        line, _ = self.expectations(u, a)
        right = np.where(self.y > 0.5, line, 1 - line)
        size = np.bincount(self.part, self.weight, 2 * len(self.n))
        share = np.bincount(self.part, self.weight * right, 2 * len(self.n)) / np.maximum(size, 1e-300)
        share = np.clip(share, 1e-6, 1.0)
        loss = -(size * np.log(share)).sum() / len(self.n)
        # of the loss by each line's marginal; then the derivative of all expectations in this direction
        way = -self.weight * np.where(self.y > 0.5, 1.0, -1.0) / share[self.part] / len(self.n)
        reach = np.zeros(len(self.n))
        np.maximum.at(reach, self.doc, np.abs(way))
        h = 1e-3 / np.maximum(reach, 1e-300)
        (up_line, up_pair), (down_line, down_pair) = (self.expectations(u + s * h[self.doc] * way, a) for s in (1, -1))
        by_line = (up_line - down_line) / (2 * h[self.doc])
        by_pair = ((up_pair - down_pair) / (2 * h[self.doc[self.inner]])[:, None]).sum(axis=0).reshape(2, 2)
        return loss, by_line, by_pair


def fit(texts: list[tuple], steps: int = 150, rate: float = 0.1, ridge: float = 1e-4, ridge_transitions: float = 1e-3) -> Field:
    """Likelihood of the labels by full-batch Adam. texts: (features, label or labels of the lines, and if given weights of the lines); documents weigh alike whatever their length."""
    own = _Sequences(texts)
    mean, scale = own.x.mean(axis=0), own.x.std(axis=0)
    mean[-1], scale[scale < 1e-6] = 0.0, 1.0
    x = (own.x - mean) / scale
    value = [np.zeros(x.shape[1]), np.zeros((2, 2))]
    m, v = [np.zeros_like(g) for g in value], [np.zeros_like(g) for g in value]
    for i in range(1, steps + 1):
        _, by_line, by_pair = own.gradient(x @ value[0], value[1])
        for k, grad in enumerate((x.T @ by_line + ridge * value[0], by_pair + ridge_transitions * value[1])):
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.99 * v[k] + 0.01 * grad**2
            value[k] = value[k] - rate * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-8)
    return Field(mean, scale, *value)


def mixed_sequences(sample: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 17) -> list[tuple]:
    """For each document of the sample (own features, lengths, label) a run of its lines inside a document of the other label, as (features, labels, lengths)."""
    r = np.random.default_rng(seed)
    by = [[d for d in sample if d[2] == q] for q in (0, 1)]
    out = []
    for own, length, q in sample:
        other, other_length, _ = by[1 - q][int(r.integers(len(by[1 - q])))]
        most = min(len(own), 8)
        take = int(r.integers(1, most + 1))
        first, at = int(r.integers(0, len(own) - take + 1)), int(r.integers(0, len(other) + 1))
        join = lambda a, b: np.concatenate([a[:at], b[first : first + take], a[at:]])  # noqa: B023, E731
        labels = np.full(len(other) + take, 1 - q)
        labels[at : at + take] = q
        out.append((_with_neighbours(join(other, own)), labels, join(other_length, length)))
    return out


def line_marginals(field: Field, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the probability of each of its lines to be good, and the lines' lengths."""
    described = [line_features(t) for t in texts]
    if not described:
        return []
    n = np.array([len(w) for _, w in described])
    ends = np.cumsum(n)
    u = np.concatenate([field.emissions(x) for x, _ in described])
    described = [(None, w) for _, w in described]
    out: list = [None] * len(texts)
    size = np.frexp(n)[1]  # documents of like numbers of lines go together
    for s in np.unique(size):
        own = np.flatnonzero(size == s)
        own = own[np.argsort(-n[own], kind="stable")]
        for part in np.array_split(own, max(1, int(n[own].sum()) // 200_000)):
            if not len(part):
                continue
            grid = np.zeros((int(n[part[0]]), len(part)))
            for column, i in enumerate(part):
                grid[: n[i], column] = u[ends[i] - n[i] : ends[i]]
            forward, backward, _ = _messages(grid, np.searchsorted(-n[part], -np.arange(len(grid)), side="left"), field.transitions)
            good = _sigmoid(forward + backward)
            for column, i in enumerate(part):
                out[i] = (good[: n[i], column], described[i][1])
    return out


def scores(field: Field, texts: list[bytes]) -> list[float]:
    return [min(1.0, max(0.0, float((good * length).sum() / length.sum()))) for good, length in line_marginals(field, texts)]


# --- Spark ---------------------------------------------------------------------------------------


def training_sample(docs: DataFrame, labelled: DataFrame, most: int = SAMPLE_DOCS) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """At most `most` labelled documents outside the held-out fold, as (own features of the lines, their lengths, label)."""
    known = labelled.where(F.col("quality").isin(0, 1) & (bucket_of("doc_id", FOLDS) != HELD_OUT)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(most)
    rows = docs.join(F.broadcast(chosen), "doc_id")  # at most `most` rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            kept = [(q, t) for q, t in zip(batch.column(0).to_pylist(), texts) if t.count(b"\n") < SAMPLE_LINES]
            lines = [own_features(t) for _, t in kept]
            yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in kept], pa.int32()), *(pa.array([x[k].tobytes() for x in lines], pa.binary()) for k in (0, 1))], ["quality", "features", "lengths"])

    found = text_bytes(rows.withColumn("quality", F.col("quality").cast("int")), "quality").mapInArrow(run, "quality int, features binary, lengths binary")
    # repeated rows of a labelled id could pass the bound; the order makes the sample the same in every run
    got = found.orderBy(F.xxhash64("features", "lengths"), "quality").limit(most).collect()
    return [(np.frombuffer(r["features"], np.float32).reshape(-1, OWN), np.frombuffer(r["lengths"], np.float64), r["quality"]) for r in got]


def learn(docs: DataFrame, labelled: DataFrame) -> Field | float:
    """The field, or where both kinds of label are not there the score of every document."""
    sample = training_sample(docs, labelled)
    good = sum(q for *_, q in sample)
    if not sample or good in (0, len(sample)):
        return good / len(sample) if sample else 1.0
    return fit([(_with_neighbours(own), q, length) for own, length, q in sample] + mixed_sequences(sample))


def score_documents(docs: DataFrame, model: Field | float, name: str = "score") -> DataFrame:
    """docs with a column for the score."""
    kept = [c for c in docs.columns if c != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{name}` double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            found = scores(model, texts) if isinstance(model, Field) else [model] * len(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.float64())], [*batch.schema.names[:-1], name])

    if set(kept) == {"doc_id"}:
        return text_bytes(docs, "doc_id").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, `{name}` double")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            texts = [t.encode() if isinstance(t, str) else t for t in texts]
            found = scores(model, texts) if isinstance(model, Field) else [model] * len(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, name])

    return docs.mapInArrow(whole, schema)


def classify(docs: DataFrame, labelled: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    found = score_documents(docs.select("doc_id", "text"), learn(docs.select("doc_id", "text"), labelled))
    held = F.coalesce(bucket_of("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labelled: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the field does not reject, with every column they have."""
    from .common import fresh

    name = fresh(docs, "__score")
    model = learn(docs.select("doc_id", "text"), labelled)
    return score_documents(docs, model, name).where(F.col(name) >= threshold).select(*docs.columns)


def op3_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), labels(spark, sf_dir))


QUERIES = {"op3_line_crf": op3_line_crf}
ORACLES: dict[str, str] = {}
