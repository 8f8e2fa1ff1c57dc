"""Toxic spans and scores from a linear-chain conditional random field."""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boolsieve.llm.common import release, slices, utf8, without, words
from boolsieve.session import Shared, cut

#: Labelled rows of each class that the model is fitted on, at most, of those whose text takes at most so many bytes.
SAMPLE_ROWS = 1500
SAMPLE_BYTES = 32 << 10
#: Every fifth id by CRC-32 is held out.
FOLDS = 5
#: A word is labelled toxic in toxic texts if it, or its stem, has this many different contexts there, this many times its share
#: in others, and so few by chance that of all words chosen this share is wrong (by Benjamini and Hochberg's step-up rule).
MIN_CONTEXTS, MIN_LIFT, FALSE_SHARE = 3, 8.0, 0.05

_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
#: Bytes of the stems that are features beside the word itself, so that other forms of a toxic word are found.
STEMS = (4, 5)
#: Words on either side of a training window's middle, and windows of each text besides those around all its marked words and
#: all that look like marked ones.
HALF_WINDOW, OTHER_WINDOWS = 4, 4
_CACHE = 150_000


def fold(id_col: str) -> F.Column:
    return F.pmod(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")), F.lit(FOLDS))


def _features(word: bytes) -> tuple[bytes, bytes, bytes]:
    return word, b"4<" + word[: STEMS[0]], b"5<" + word[: STEMS[1]]


@dataclass
class Model:
    """Weights of toxic against other by feature, transitions and starts in log space, and the document's regression."""

    weights: dict[bytes, float] = field(default_factory=dict)
    bias: float = -8.0
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    starts: np.ndarray = field(default_factory=lambda: np.zeros(2))
    document: np.ndarray = field(default_factory=lambda: np.zeros(3))


class Emissions(dict):
    """The score of each word seen, computed once."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model = model

    def __missing__(self, word: bytes) -> float:
        if len(self) > _CACHE:
            self.clear()
        get = self.model.weights.get
        self[word] = value = self.model.bias + sum(get(f, 0.0) for f in _features(word))
        return value


def marginals(emission: np.ndarray, first: np.ndarray, model: Model, width: int = 256) -> np.ndarray:
    """The probability of the toxic tag of every word, by forward-backward over texts laid end to end.

    ``first`` marks words that begin a text: what comes before can't reach them. The chain is cut into equal pieces; the
    product of each piece's 2x2 matrices gives the messages between pieces, and all pieces run side by side.
    """
    n = len(emission)
    if not n:
        return np.zeros(0)
    pieces = -(-n // width)
    size = pieces * width
    odds = np.ones(size)
    odds[:n] = np.exp(np.clip(emission, -30, 30))
    begin = np.ones(size, bool)
    begin[:n] = first
    odds, begin = odds.reshape(pieces, width).T.copy(), begin.reshape(pieces, width).T.copy()
    a, s = np.exp(model.moves), np.exp(model.starts)
    t = [[np.where(begin, s[j], a[i, j]) * (odds if j else 1.0) for j in (0, 1)] for i in (0, 1)]
    m00, m01, m10, m11 = np.ones(pieces), np.zeros(pieces), np.zeros(pieces), np.ones(pieces)
    for k in range(width):
        m00, m01 = m00 * t[0][0][k] + m01 * t[1][0][k], m00 * t[0][1][k] + m01 * t[1][1][k]
        m10, m11 = m10 * t[0][0][k] + m11 * t[1][0][k], m10 * t[0][1][k] + m11 * t[1][1][k]
        total = m00 + m01 + m10 + m11
        m00, m01, m10, m11 = m00 / total, m01 / total, m10 / total, m11 / total
    ins, outs = np.empty((2, pieces)), np.empty((2, pieces))
    rows = list(zip(m00.tolist(), m01.tolist(), m10.tolist(), m11.tolist()))
    x0 = x1 = 0.5
    for k, (p, q, r, u) in enumerate(rows):
        ins[:, k] = x0, x1
        y0, y1 = x0 * p + x1 * r, x0 * q + x1 * u
        x0, x1 = y0 / (y0 + y1), y1 / (y0 + y1)
    x0 = x1 = 0.5
    for k in range(pieces - 1, -1, -1):
        outs[:, k] = x0, x1
        p, q, r, u = rows[k]
        y0, y1 = p * x0 + q * x1, r * x0 + u * x1
        x0, x1 = y0 / (y0 + y1), y1 / (y0 + y1)
    forward = np.empty((width, pieces))
    f0, f1 = ins
    for k in range(width):
        f0, f1 = f0 * t[0][0][k] + f1 * t[1][0][k], f0 * t[0][1][k] + f1 * t[1][1][k]
        total = f0 + f1
        f0, f1 = f0 / total, f1 / total
        forward[k] = f1
    b0, b1 = outs
    found = np.empty((width, pieces))
    for k in range(width - 1, -1, -1):
        toxic, other = forward[k] * b1, (1 - forward[k]) * b0
        found[k] = toxic / (toxic + other)
        b0, b1 = t[0][0][k] * b0 + t[0][1][k] * b1, t[1][0][k] * b0 + t[1][1][k] * b1
        total = b0 + b1
        b0, b1 = b0 / total, b1 / total
    return found.T.ravel()[:n]


def _sides(tokens: list[bytes], at: int) -> tuple[int, int]:
    """Hashes of the two words before a place, and of the two after it."""
    return hash(tuple(tokens[max(0, at - 2) : at])), hash(tuple(tokens[at + 1 : at + 3]))


def places(contexts: set[tuple]) -> int:
    """How many places contexts (before, after) come from: those that share a side are one, as copies with an edit do."""
    root: dict[tuple[int, int], tuple[int, int]] = {}

    def find(x: tuple[int, int]) -> tuple[int, int]:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for before, after in contexts:
        root[find((0, before))] = find((1, after))
    return len({find(x) for x in root})


def toxic_words(texts: list[list[bytes]], toxic: list[bool]) -> set[bytes]:
    """The words whose places in toxic texts get the toxic label: many contexts there, few elsewhere.

    A text counts a word once, by what stands on either side of it there, so copies of a text count as one, edited or not.
    """
    standing = Counter(word for tokens, bad in zip(texts, toxic) if bad for word in set(tokens))
    contexts: dict[bytes, set] = {w: set() for w, n in standing.items() if n >= MIN_CONTEXTS}
    totals = [0, sum(standing.values())]
    for tokens in (t for t, bad in zip(texts, toxic) if bad):
        for word in contexts.keys() & set(tokens):
            contexts[word].add(_sides(tokens, tokens.index(word)))
    likely = {w: n for w, c in contexts.items() if len(c) >= MIN_CONTEXTS and (n := places(c)) >= MIN_CONTEXTS}
    contexts.clear()
    there: dict[bytes, set] = {w: set() for w in likely}
    for tokens in (t for t, bad in zip(texts, toxic) if not bad):
        seen = set(tokens)
        totals[0] += len(seen)
        for word in seen & likely.keys():
            there[word].add(_sides(tokens, tokens.index(word)))
    elsewhere = {w: places(c) for w, c in there.items()}
    share = totals[1] / max(1, sum(totals))
    rated = sorted((_by_chance(n, n + elsewhere[w], share), w) for w, n in likely.items())
    bound = max((k for k, (p, _) in enumerate(rated, 1) if p <= FALSE_SHARE * k / len(standing)), default=0)
    return {w for _, w in rated[:bound] if likely[w] * (1 - share) >= MIN_LIFT * (elsewhere[w] + 0.5) * share}


def _by_chance(n: int, of: int, share: float) -> float:
    """The chance that at least ``n`` of so many places are in toxic texts, if they hold this share of all words."""
    if not 0 < share < 1:
        return 1.0
    log, total = math.log, 0.0
    for k in range(n, of + 1):
        term = math.exp(math.lgamma(of + 1) - math.lgamma(k + 1) - math.lgamma(of - k + 1) + k * log(share) + (of - k) * log(1 - share))
        total += term
        if k > of * share and term < 1e-6 * total:
            break
    return min(1.0, total)


def fit(rows: list[tuple[bytes, bool]], shares: tuple[float, float]) -> Model:
    """The field and the document's regression. ``shares``: how many labelled rows stand for each row of either class."""
    one: dict[bytes, bytes] = {}  # a word that stands often is one object
    texts, toxic = [[one.setdefault(w, w) for w in words(t)] for t, _ in rows], [b for _, b in rows]
    model = Model()
    bad, forms = set(), set()
    if any(toxic) and not all(toxic):
        bad = toxic_words(texts, toxic)
        short = {w: w[: STEMS[1]] for w in one}
        forms = {w for w in toxic_words([[short[w] for w in t] for t in texts], toxic) if len(w) == STEMS[1]}
    stems = {w[: STEMS[0]] for w in bad | forms}
    windows: list[tuple[list[bytes], list[int], bool]] = []
    for i, (tokens, is_toxic) in enumerate(zip(texts, toxic)):
        marks = [int(is_toxic and (w in bad or w[: STEMS[1]] in forms)) for w in tokens]
        alike = [k for k, w in enumerate(tokens) if not marks[k] and w[: STEMS[0]] in stems]  # what the model must tell apart
        middles = [k for k, y in enumerate(marks) if y] + alike + [(i * 7919 + j * 104729) % len(tokens) for j in range(OTHER_WINDOWS) if tokens]
        for k in middles:
            a = max(0, k - HALF_WINDOW)
            windows.append((tokens[a : k + HALF_WINDOW + 1], marks[a : k + HALF_WINDOW + 1], a == 0))
    if stems and windows:
        _train(model, windows)
    _regress(model, texts, toxic, shares)
    return model


def _train(model: Model, windows: list[tuple[list[bytes], list[int], bool]], rounds: int = 12, batch: int = 256, rate: float = 0.3) -> None:
    """Maximum likelihood of the windows' tags, by adaptive gradient steps with a small penalty."""
    index: dict[bytes, int] = {}
    length = 2 * HALF_WINDOW + 1
    n = len(windows)
    ids = np.zeros((n, length, 3), np.int64)
    tags, real, heads = np.zeros((n, length), np.int64), np.zeros((n, length), bool), np.array([h for _, _, h in windows])
    for r, (tokens, marks, _) in enumerate(windows):
        for k, (w, y) in enumerate(zip(tokens, marks)):
            ids[r, k] = [index.setdefault(f, len(index)) for f in _features(w)]
            tags[r, k], real[r, k] = y, True
    params = [np.zeros(len(index)), np.array([-2.0]), np.zeros((2, 2)), np.zeros(2)]
    sums = [np.full_like(p, 1e-6) for p in params]
    order = np.random.default_rng(5).permutation(n)
    for _ in range(rounds):
        for at in range(0, n, batch):
            rows = order[at : at + batch]
            _, grads = likelihood(params, ids[rows], tags[rows], real[rows], heads[rows])
            for value, grad, total in zip(params, grads, sums):
                grad = grad / len(rows) + 1e-5 * value
                total += grad**2
                value -= rate * grad / np.sqrt(total)
    weights, bias, moves, starts = params
    model.weights = {f: float(weights[k]) for f, k in index.items() if abs(weights[k]) > 0.02}
    model.bias, model.moves, model.starts = float(bias[0]), moves, starts


def likelihood(params: list[np.ndarray], ids: np.ndarray, y: np.ndarray, ok: np.ndarray, heads: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """The negative log likelihood of windows' tags and its gradient by weights, bias, moves and starts.

    ``ids`` are the features of each word, ``ok`` says where a window has words, ``heads`` which windows begin a text.
    """
    weights, bias, moves, starts = params
    rows, length = y.shape
    at = np.arange(rows)
    e = weights[ids].sum(axis=2) + bias[0]
    alpha = np.empty((length, rows, 2))
    alpha[0, :, 0], alpha[0, :, 1] = np.where(heads, starts[0], 0), e[:, 0] + np.where(heads, starts[1], 0)
    told = alpha[0, at, y[:, 0]]
    for k in range(1, length):
        step = np.logaddexp(alpha[k - 1, :, :1] + moves[0], alpha[k - 1, :, 1:] + moves[1])
        step[:, 1] += e[:, k]
        alpha[k] = np.where(ok[:, k, None], step, alpha[k - 1])
        told = told + np.where(ok[:, k], moves[y[:, k - 1], y[:, k]] + e[:, k] * y[:, k], 0)
    log_z = np.logaddexp(alpha[-1, :, 0], alpha[-1, :, 1])
    beta, p, pairs = np.zeros((rows, 2)), np.empty((rows, length)), np.zeros((2, 2))
    for k in range(length - 1, -1, -1):
        p[:, k] = np.exp(alpha[k, :, 1] + beta[:, 1] - log_z) * ok[:, k]
        if k:
            inner = beta.copy()
            inner[:, 1] += e[:, k]
            joint = alpha[k - 1, :, :, None] + moves + inner[:, None, :] - log_z[:, None, None]
            pairs += (np.exp(joint) * ok[:, k, None, None]).sum(axis=0)
            np.subtract.at(pairs, (y[ok[:, k], k - 1], y[ok[:, k], k]), 1.0)
            beta = np.where(ok[:, k, None], np.logaddexp(moves[:, 0] + inner[:, :1], moves[:, 1] + inner[:, 1:]), beta)
    wrong = (p - y) * ok
    by_weight = np.bincount(ids.ravel(), np.repeat(wrong.ravel(), ids.shape[2]), len(weights))
    begin = wrong[heads, 0].sum()
    return float((log_z - told).sum()), [by_weight, np.array([wrong.sum()]), pairs, np.array([-begin, begin])]


def aggregate(p: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the largest marginal, and the sum of those of one half or more."""
    most, total = np.zeros(len(ends)), np.zeros(len(ends))
    starts = np.concatenate([[0], ends[:-1]])
    full = ends > starts
    if full.any():
        most[full] = np.maximum.reduceat(p, starts[full])
        total[full] = np.add.reduceat(np.where(p >= 0.5, p, 0.0), starts[full])
    return most, total


def _design(most: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(most)), np.round(most, 6), np.round(np.log1p(total), 6)], axis=1)


def _tag(texts: list[list[bytes]], emissions: Emissions, model: Model) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    n = int(ends[-1]) if len(ends) else 0
    scores = np.fromiter((emissions[w] for t in texts for w in t), np.float64, n)
    first = np.zeros(n, bool)
    first[(ends - sizes)[sizes > 0]] = True
    return marginals(scores, first, model), ends


def _regress(model: Model, texts: list[list[bytes]], toxic: list[bool], shares: tuple[float, float]) -> None:
    """Logistic regression of the label on a text's aggregated marginals, each row with its class's share."""
    y = np.array(toxic, float)
    if not len(y) or y.min() == y.max():
        model.document = np.array([3.0 if len(y) and y.min() else -3.0, 0.0, 0.0])
        return
    emissions = Emissions(model)
    x = np.concatenate([_design(*aggregate(*_tag(texts[k : k + 256], emissions, model))) for k in range(0, len(texts), 256)])
    weight = np.where(y == 1, shares[1], shares[0])
    weight = weight / weight.mean()
    b = np.zeros(3)
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        hess = (x * (weight * q * (1 - q))[:, None]).T @ x + 0.05 * np.eye(3)
        step = np.linalg.solve(hess, x.T @ (weight * (y - q)) - 0.05 * b)
        b = b + np.clip(step, -4, 4)
    model.document = b


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple[DataFrame, dict[bool, int]]:
    """(_id, _toxic, text): up to SAMPLE_ROWS training texts of each class, those with the smallest hashes; and the rows of each class."""
    key, text = F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`").cast("string")
    known = labels.filter(f"`{label_col}` is not null and `{id_col}` is not null").filter(fold(id_col) != 0)
    known = known.groupBy(key.alias("_id")).agg((F.max(label_col) > 0).alias("_toxic")).withColumn("_h", F.xxhash64("_id"))
    fitting = docs.filter(F.octet_length(text) <= SAMPLE_BYTES)
    known = cut(known.join(fitting.select(key.alias("_id")).distinct(), "_id", "left_semi"))
    sizes = {r["_toxic"]: r["count"] for r in known.groupBy("_toxic").count().collect()}
    parts = [known.filter(F.col("_toxic") == flag).orderBy("_h", "_id").limit(SAMPLE_ROWS) for flag in (False, True)]
    chosen = F.broadcast(cut(parts[0].unionAll(parts[1]).select("_id", "_toxic")))  # 2 * SAMPLE_ROWS rows at most
    rows = fitting.select(key.alias("_d"), text.alias("text")).join(chosen, F.col("_d") == F.col("_id"))
    return cut(rows.groupBy("_id", "_toxic").agg(F.min("text").alias("text"))), sizes


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model of a bounded sample of labelled rows outside the held-out fifth; ids are compared as strings.

    Of an id with several texts the smallest is learnt; labels of an id that has several count as toxic if one is. One task
    fits it: the sample is bounded, and the driver gets the weights only.
    """
    rows, sizes = sample(docs, labels, id_col, text_col, label_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[tuple[str, bytes, bool]] = []
        for batch in batches:
            got += zip(batch.column("_id").to_pylist(), utf8(batch.column("text")), batch.column("_toxic").to_pylist())
        got.sort()
        counts = [max(1, sum(1 for r in got if r[2] == flag)) for flag in (False, True)]
        model = fit([(t, b) for _, t, b in got], (sizes.get(False, 0) / counts[0], sizes.get(True, 0) / counts[1]))
        got.clear()
        release()
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(vars(model))], pa.binary())})

    found = rows.coalesce(1).mapInArrow(run, "model binary").first()  # 2 * SAMPLE_ROWS texts of SAMPLE_BYTES at most
    return Model(**pickle.loads(found["model"])) if found else fit([], (0.0, 0.0))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """``docs`` as ``apply`` rates them by a model that is learnt from them and ``labels``."""
    return apply(docs, learn(docs, labels, id_col, text_col, label_col), text_col)


def apply(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1), ``predicted`` (1 if score >= 0.5) and ``toxic_spans`` (offsets in characters).

    Nothing but a text's words makes its score, so equal texts have equal scores. Words are lower-cased runs of letters,
    digits and characters above ASCII; a span joins neighbouring words of which the toxic tag is likelier than not. Null,
    empty and wordless texts have the score of texts without toxic words and no spans. Without labels of both classes
    every score is constant. Columns with the three names are replaced.
    """
    shared = Shared(docs.sparkSession, model)
    rows = without(docs, "score", "predicted", "toxic_spans")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        emissions = Emissions(own)
        for part in slices(batches, text_col):
            raw = utf8(part.column(text_col))
            p, ends = _tag([words(t) for t in raw], emissions, own)
            x = _design(*aggregate(p, ends)) @ own.document
            scores = np.round(1 / (1 + np.exp(-np.clip(x, -30, 30))), 6)
            spans: list[list[dict[str, int]]] = [[] for _ in raw]
            hits = np.flatnonzero(p >= 0.5)
            for d in np.unique(np.searchsorted(ends, hits, side="right")).tolist():
                a, b = (int(ends[d - 1]) if d else 0), int(ends[d])
                spans[d] = _offsets(raw[d], p[a:b] >= 0.5)
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array(spans, _SPAN)],
                [*part.schema.names, "score", "predicted", "toxic_spans"],
            )

    return rows.mapInArrow(run, f"{fields}, score double, predicted int, toxic_spans array<struct<start:int,end:int>>")


def _offsets(text: bytes, marked: np.ndarray) -> list[dict[str, int]]:
    places = [m.span() for m in _WORD.finditer(text)]
    edges = np.diff(np.concatenate([[0], marked.astype(np.int8), [0]]))
    out, at, chars = [], 0, 0
    for a, b in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()):
        start, end = places[a][0], places[b - 1][1]
        chars += len(text[at:start].decode())
        size = len(text[start:end].decode())
        out.append({"start": chars, "end": chars + size})
        chars, at = chars + size, end
    return out


