"""Toxicity by a linear-chain conditional random field over word tokens.

Training (driver, on a bounded sample of at most `MAX_TRAIN` labelled rows):
each word has its full form, byte prefixes and suffixes as features; a feature's
evidence is the log-odds of its document frequency in toxic against other rows.
A token of a toxic row whose evidence reaches `TOKEN_EVIDENCE` is a labelled
toxic token, any other token is labelled clean. Evidence of a training row is
taken from the other folds, so that a row does not vouch for itself. The field
(two states, transitions, own and neighbours' evidence) is fitted by gradient
ascent on its exact log-likelihood; document scores are a logistic function of
the marginals, fitted on the same rows.

Scoring (executors, one pass, no shuffle): forward-backward over every word of
the whole text. Words without evidence share one potential, so a run of them is
one power of the transfer matrix; this is exact. Tokens with a marginal of 0.5
or more are returned as offending offsets (code points).

Defined cases: null, empty and word-less texts score as texts without evidence;
labels other than 0 and 1 are ignored; without two classes among the sampled
rows every document gets the sample's toxic share (0 without any); repeated rows
are scored one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from ._common import arrow_map, extended, own_names, prepare

#: Labelled rows that are read for training, drawn by a hash of the id.
MAX_TRAIN = 6000
#: Least evidence of a feature, and toxic rows that hold it; what the sampled rows give of such features is kept.
LEAST_EVIDENCE, LEAST_ROWS = 2.0, 3
TOKEN_EVIDENCE = 3.0
PREFIXES, SUFFIXES = (4, 5, 6, 7, 8), (5, 7)
FOLDS, CHUNK_TOKENS, ROUNDS = 4, 32, 80
PREDICT_AT, SPAN_AT = 0.3, 0.5
#: Separators of words: everything in ASCII but letters.
NOT_LETTER = B.NOT_ALNUM.copy()
NOT_LETTER[0x30:0x3A] = True


def _folded(data: np.ndarray) -> np.ndarray:
    """Lower case for A-Z and for the Latin-1 letters of two UTF-8 bytes."""
    out = B.LOWER[data]
    lead = np.flatnonzero(out[:-1] == 0xC3) + 1
    second = out[lead]
    out[lead] = np.where((second >= 0x80) & (second <= 0x9E) & (second != 0x97), second + 0x20, second)
    return out


def _tokens(texts: list[bytes | None]):
    """Word starts, ends, first word of each row, and a (words, features) array of hashes; 0 where a feature is absent."""
    joined = B.Joined(texts)
    starts, ends, first = joined.words(NOT_LETTER)
    sums = B.prefix(B.BYTE_VALUE[_folded(joined.data)])
    columns = [B.spans_hash(sums, starts, ends) | B.U(1)]
    for k, n in enumerate(PREFIXES + SUFFIXES):
        ok = ends - starts > n
        a, b = (starts, np.minimum(starts + n, ends)) if k < len(PREFIXES) else (np.maximum(ends - n, starts), ends)
        h = (B.spans_hash(sums, a, b) ^ B.U(0x51ED270B * (k + 1))) | B.U(1)
        columns.append(np.where(ok, h, B.U(0)))
    return joined, starts, ends, first, np.stack(columns, 1) if len(starts) else np.empty((0, 1 + len(PREFIXES + SUFFIXES)), np.uint64)


class Model:
    """A fitted field: feature evidence, weights, transitions, document logistic."""

    def __init__(self, base: float):
        self.keys, self.value = np.empty(0, np.uint64), np.empty(0)
        self.weights = np.zeros(5)
        self.move = np.zeros((2, 2))
        self.doc: np.ndarray | None = None
        self.base = base

    def evidence(self, features: np.ndarray) -> np.ndarray:
        if not len(self.keys) or not len(features):
            return np.zeros(len(features))
        out = np.zeros(len(features))
        for column in features.T:
            place = np.searchsorted(self.keys, column)
            place[place == len(self.keys)] = 0
            np.maximum(out, np.where(self.keys[place] == column, self.value[place], 0.0), out=out)
        return out / 5

    def marginals(self, evidence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of tokens with own or neighbouring evidence, and their marginals."""
        n = len(evidence)
        active = np.flatnonzero(evidence > 0)
        if not len(active):
            return active, np.empty(0)
        at = np.unique(np.concatenate([active, active - 1, active + 1]))
        at = at[(at >= 0) & (at < n)]
        own = evidence[at]
        before = np.where(at > 0, evidence[at - 1], 0)
        after = np.where(at + 1 < n, evidence[np.minimum(at + 1, n - 1)], 0)
        w = self.weights
        emit = np.exp(np.clip(w[0] + w[1] * own + w[2] * (own > 0) + w[3] * before + w[4] * after, -30, 30)).tolist()
        gaps = [int(at[0]), *(np.diff(at) - 1).tolist(), int(n - 1 - at[-1])]
        (t00, t01), (t10, t11) = self._step
        ahead, a0, a1, started = [], 0.5, 0.5, False
        for gap, e in zip(gaps, emit):
            if gap:
                m = self._run(gap - (not started))
                if not started:
                    a0, a1, started = 0.5, 0.5 * self._idle, True
                a0, a1 = a0 * m[0] + a1 * m[2], a0 * m[1] + a1 * m[3]
            if started:
                a0, a1 = a0 * t00 + a1 * t10, (a0 * t01 + a1 * t11) * e
            else:
                a0, a1, started = 0.5, 0.5 * e, True
            z = a0 + a1
            a0, a1 = a0 / z, a1 / z
            ahead.append((a0, a1))
        out, b0, b1 = [0.0] * len(at), 1.0, 1.0
        for k in range(len(at) - 1, -1, -1):
            if gap := gaps[k + 1]:
                m = self._run(gap)
                b0, b1 = m[0] * b0 + m[1] * b1, m[2] * b0 + m[3] * b1
            p0, p1 = ahead[k][0] * b0, ahead[k][1] * b1
            out[k] = p1 / (p0 + p1)
            b1 *= emit[k]
            b0, b1 = t00 * b0 + t01 * b1, t10 * b0 + t11 * b1
            z = b0 + b1
            b0, b1 = b0 / z, b1 / z
        return at, np.array(out)

    @functools.cached_property
    def _step(self):
        return np.exp(self.move).tolist()

    @functools.cached_property
    def _idle(self) -> float:
        return math.exp(min(30.0, max(-30.0, float(self.weights[0]))))

    @functools.cached_property
    def _kept(self) -> dict:
        return {}

    def _run(self, n: int) -> tuple[float, float, float, float]:
        """Transfer through n tokens without evidence, scaled."""
        if n not in self._kept:
            m, power, k = np.eye(2), np.array(self._step) * [1.0, self._idle], n
            while k:
                if k & 1:
                    m = m @ power
                    m /= m.sum()
                power = power @ power
                power /= power.sum()
                k >>= 1
            if len(self._kept) > 100_000:
                self._kept.clear()
            self._kept[n] = tuple(m.ravel().tolist())
        return self._kept[n]

    def score(self, p: np.ndarray, words: int) -> float:
        if self.doc is None:
            return self.base
        return 1 / (1 + math.exp(-float(np.clip(_summary(p, words) @ self.doc, -500, 500))))


def _summary(p: np.ndarray, words: int) -> np.ndarray:
    """What the document logistic sees: noisy-or strength, expected toxic tokens, and the strongest token."""
    strong = float(-np.log1p(-np.minimum(p, 0.999)).sum())
    return np.array([1.0, math.log1p(strong), math.log1p(float(p.sum())), float(p.max(initial=0.0)), math.log1p(1000 * float(p.sum()) / max(1, words)) / 3])


def _fit_field(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions that maximise the likelihood of chunks of (evidence, labels)."""
    xs, ys = [], []
    for e, y in rows:
        pad = -len(e) % CHUNK_TOKENS
        before, after = np.concatenate([[0], e[:-1]]), np.concatenate([e[1:], [0]])
        x = np.stack([np.ones(len(e)), e, e > 0, before, after], 1)
        x, y = np.concatenate([x, np.zeros((pad, 5))]), np.concatenate([y, np.zeros(pad, np.int64)])
        x, y = x.reshape(-1, CHUNK_TOKENS, 5), y.reshape(-1, CHUNK_TOKENS)
        keep = (x[:, :, 1] > 0).any(1)
        keep[:1] = True
        xs.append(x[keep])
        ys.append(y[keep])
    x, y = np.concatenate(xs), np.concatenate(ys)
    real = x[:, :, 0]
    n, t, _ = x.shape
    w, move = np.array([-3.0, 1, 0, 0, 0]), np.zeros((2, 2))
    m1, m2 = np.zeros(9), np.zeros(9)
    target = np.concatenate([np.einsum("nt,ntk->k", y * real, x), np.zeros(4)])
    for a in (0, 1):
        for b in (0, 1):
            target[5 + 2 * a + b] = ((y[:, :-1] == a) & (y[:, 1:] == b) & (real[:, 1:] > 0)).sum()
    for step in range(1, ROUNDS + 1):
        emit, jump = np.exp(np.clip(x @ w, -30, 30)), np.exp(move)
        ahead = np.empty((n, t, 2))
        a = np.stack([np.ones(n), emit[:, 0]], 1)
        ahead[:, 0] = a / a.sum(1, keepdims=True)
        for k in range(1, t):
            a = ahead[:, k - 1] @ jump
            a[:, 1] *= emit[:, k]
            ahead[:, k] = a / a.sum(1, keepdims=True)
        back, got = np.ones((n, 2)), np.zeros(9)
        for k in range(t - 1, -1, -1):
            p = ahead[:, k] * back
            p = (p / p.sum(1, keepdims=True))[:, 1] * real[:, k]
            got[:5] += p @ x[:, k]
            if k:
                q = back.copy()
                q[:, 1] *= emit[:, k]
                pair = ahead[:, k - 1, :, None] * jump * q[:, None, :]
                pair *= (real[:, k] / pair.sum((1, 2)))[:, None, None]
                got[5:] += pair.sum(0).ravel()
                q = q @ jump.T
                back = np.where(real[:, k : k + 1] > 0, q / q.sum(1, keepdims=True), back)
        slope = (target - got) / n - 1e-4 * np.concatenate([w, move.ravel()])
        m1, m2 = 0.9 * m1 + 0.1 * slope, 0.99 * m2 + 0.01 * slope**2
        change = 0.15 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
        w, move = w + change[:5], move + change[5:].reshape(2, 2)
    return w, move


def _fit_doc(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(z.shape[1])
    ridge = np.diag([1e-6, *[0.05] * (z.shape[1] - 1)])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge + 1e-9 * np.eye(len(w)), z.T @ (y - p) - ridge @ w)
    return w


def _distinct(features: np.ndarray) -> np.ndarray:
    """Distinct features of one text."""
    found = np.unique(features)
    return found[found > 0]


def fit_rows(texts: list[bytes | None], labels: list[int]) -> Model:
    """A model of labelled texts."""
    y = np.array(labels, np.int64)
    model = Model(float(y.mean()) if len(y) else 0.0)
    if not 0 < y.sum() < len(y):
        return model
    fold = np.empty(len(y), np.int64)
    for c in (0, 1):
        fold[y == c] = np.arange((y == c).sum()) % FOLDS
    # Only features of several toxic rows can serve; those are found first, and then counted over all rows.
    toxic = [_distinct(_tokens([text])[4]) for text, c in zip(texts, labels) if c == 1]
    keys, met = np.unique(np.concatenate(toxic), return_counts=True)
    keys = keys[met >= LEAST_ROWS - 1]
    count = np.zeros((len(keys), 2, FOLDS), np.int64)
    for k, text in enumerate(texts):
        own = _distinct(_tokens([text])[4])
        place = np.searchsorted(keys, own)
        place[place == len(keys)] = 0
        count[place[keys[place] == own] if len(keys) else place[:0], y[k], fold[k]] += 1
    rows_in = np.array([[((y == c) & (fold == f)).sum() for f in range(FOLDS)] for c in (0, 1)])

    def odds(c, n):
        value = np.log((c[:, 1] + 0.5) / (n[1] + 1)) - np.log((c[:, 0] + 0.5) / (n[0] + 1))
        good = (c[:, 1] >= LEAST_ROWS) & (value >= LEAST_EVIDENCE)
        return keys[good], value[good]

    evidence, parts = [], []
    for f in range(FOLDS):
        part = Model(0.0)
        part.keys, part.value = odds(count.sum(2) - count[:, :, f], rows_in.sum(1) - rows_in[:, f])
        parts.append(part)
    for k, text in enumerate(texts):
        evidence.append(parts[fold[k]].evidence(_tokens([text])[4]))
    labelled = [(e, ((e * 5 >= TOKEN_EVIDENCE) & (c == 1)).astype(np.int64)) for e, c in zip(evidence, labels) if len(e)]
    if labelled:
        model.weights, model.move = _fit_field(labelled)
    z = np.stack([_summary(model.marginals(e)[1], len(e)) for e in evidence])
    model.doc = _fit_doc(z, y)
    model.keys, model.value = odds(count.sum(2), rows_in.sum(1))
    return model


def fit(documents: DataFrame, labels: DataFrame, *, train_on: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN) -> Model:
    """Fit on at most `max_train` labelled rows that satisfy `train_on` (an expression over the label table).

    Equal label rows count once; of documents that share an id, the least text (by bytes) is the labelled one.
    """
    named = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    named = named.where(train_on) if train_on is not None else named
    named = named.select(F.col(id_col).alias("k"), F.col(label_col).cast("int").alias("y")).distinct().orderBy(F.xxhash64("k"), "k", "y").limit(max_train)
    texts_of = documents.select(F.col(id_col).alias("k"), F.col(text_col).cast("binary").alias("t")).join(F.broadcast(named), "k")
    rows = texts_of.groupBy("k", "y").agg(F.min("t").alias("t")).toArrow()  # one text for each id and label, however many rows share the id
    order = sorted({(k, c): i for i, (k, c) in enumerate(zip(rows.column("k").to_pylist(), rows.column("y").to_pylist()))}.items())
    texts = rows.column("t").to_pylist()
    return fit_rows([texts[i] for _, i in order], [c for (_, c), _ in order])


def _score_pass(batches, col: int, sent):
    model = sent.value
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
    for batch in batches:
        for a, b in B.slices(batch.column(col)):
            part = batch.slice(a, b - a)
            joined, starts, ends, first, features = _tokens(texts := B.binary(part.column(col)))
            evidence = model.evidence(features)
            scores, spans = [], []
            for k, text in enumerate(texts):
                at, p = model.marginals(evidence[first[k] : first[k + 1]])
                scores.append(model.score(p, int(first[k + 1] - first[k])))
                hit, base, found, place, points = at[p >= SPAN_AT] + first[k], int(joined.start[k]), [], 0, 0
                for w, q in zip(hit.tolist(), p[p >= SPAN_AT].tolist()):
                    s, e = int(starts[w]) - base, int(ends[w]) - base
                    points += len(text[place:s].decode("utf-8", "replace"))
                    long = len(text[s:e].decode("utf-8", "replace"))
                    found.append({"start": points, "end": points + long, "p": q})
                    place, points = e, points + long
                spans.append(found)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64()), pa.array(spans, span)], names=[*part.schema.names, "toxic_score", "toxic_spans"])


def score(documents: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """Columns of documents under names in_0, in_1, ... with toxic_score and toxic_spans."""
    spark = prepare(documents.sparkSession)
    plain, text = own_names(documents, text_col)
    sent = spark.sparkContext.broadcast(model)
    at = plain.columns.index(text)
    added = "toxic_score double, toxic_spans array<struct<start:int,end:int,p:double>>"
    return arrow_map(plain, lambda batches: _score_pass(batches, at, sent), extended(plain.schema, added))


def reject(documents: DataFrame, model: Model, *, text_col: str = "text", threshold: float = PREDICT_AT) -> DataFrame:
    """Documents that score under the threshold, with their own columns."""
    scored = score(documents, model, text_col=text_col).where(F.col("toxic_score") < threshold)
    return scored.select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(documents.columns)])


def held_out(column: str = "doc_id") -> Column:
    """The rows that the contract keeps out of training."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(4)) == 2


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns, and the offending offsets, one row per document."""
    model = fit(documents, labels, train_on=~held_out())
    scored = score(documents.select("doc_id", "text"), model).withColumnRenamed("in_0", "doc_id")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= PREDICT_AT).cast("int").alias("predicted"), F.col("toxic_spans").alias("spans"))
