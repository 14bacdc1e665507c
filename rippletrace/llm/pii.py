"""Personal data by fixed patterns and a skip-chain conditional random field.

Pattern spans (e-mail, ip, card, phone) are found first and always stay. The
field then labels every token that holds a digit or an at sign. Its potentials:

* own evidence: weights over shape features of the token, fitted by softmax
  regression; tokens inside pattern spans are clamped to their kind;
* chain edges between such tokens that follow each other (all tokens between
  are plain words, observed as outside, which ends a chain);
* skip edges between a token and the previous one in the document with the same
  normalised form or the same digits, however distant.

Edge tables are log ratios of joint to independent label frequencies (piecewise
training). Labels for training are the pattern spans of at most `MAX_TRAIN`
rows, drawn by a hash of the text. Beliefs come from damped loopy sum-product
over all tokens of an Arrow slice at once. Tokens whose most probable kind
reaches `ADD_AT` and that touch no pattern span become further spans; adjoining
phone tokens make one span, and spans with an impossible number of digits go. Whole texts are read; one pass, no shuffle.

Defined cases: null and empty texts have no spans; repeated rows are judged one
by one; without any pattern span to train on nothing is added; an empty table
gives an empty result; other columns pass through `redact` unchanged. Offsets
are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from ._common import arrow_map, extended, own_names, prepare

KINDS = ("email", "ip", "card", "phone")
MAX_TRAIN = 2000
#: Belief that adds a span; change of a message below which it stands still, and damping of the message passing.
ADD_AT, CHANGE, DAMPING = 0.9, 1e-4, 0.3
#: Sweeps that a text has beside one for each of its tokens, after which evidence has reached every token; only messages that swing forever come so far.
SETTLING = 100
#: Tokens a row of the training sample gives at most to the edge and shape statistics.
OUTSIDE = len(KINDS)

# The possessive and look-behind forms match as the plain patterns do, in linear time.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_MARK = re.compile(r"[0-9@]\S*")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str):
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            free = found.end()
            yield start, free
        else:  # the run that ends here starts no match, so none of its characters need a second look
            free = at + 1
        at = text.find("@", free)


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the pattern spans, by kind, then start."""
    if not text:
        return []
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


def _tokens(text: str) -> list[tuple[int, int]]:
    """Trimmed tokens between white space that hold a digit or an at sign."""
    out, done = [], 0
    for m in _MARK.finditer(text):
        a, b = m.span()
        while a > done and not text[a - 1].isspace():
            a -= 1
        done = b
        while b > a and not (text[b - 1].isalnum() or text[b - 1] == ")"):
            b -= 1
        while a < b and not (text[a].isalnum() or text[a] in "+("):
            a += 1
        if a < b:
            out.append((a, b))
    return out


_COUNTS = (1, 2, 3, 4, 5, 7, 9, 12, 13, 16, 17, 20)
N_FEATURES = 2 * len(_COUNTS) + 14


def _shape(text: str, a: int, b: int) -> list[int]:
    """Numbers of the features that hold."""
    t = text[a:b]
    digits = sum(c.isdigit() for c in t)
    letters = sum(c.isalpha() for c in t)
    f = [0, 1 + sum(digits >= n for n in _COUNTS), 2 + len(_COUNTS) + sum(b - a >= n for n in _COUNTS)]
    k = 2 * len(_COUNTS) + 3
    f += [k + i for i, on in enumerate((
        "@" in t, t.count(".") == 1, t.count(".") == 3, t.count(".") > 0 and "@" in t, t[0] == "+", "(" in t and ")" in t, "-" in t,
        letters > 0, letters == 0 and digits == b - a, letters > 0 and digits > 0 and "@" not in t, all(c in "0123456789abcdef" for c in t) and letters > 0,
    )) if on]
    return f


def _key(t: str) -> tuple[str, str]:
    """Normalised form; the digits alone where there are many."""
    digits = "".join(c for c in t if c.isdigit())
    return t.casefold(), digits if len(digits) >= 7 else ""


class _Graph:
    """Tokens, clamped labels and edges of several texts."""

    def __init__(self):
        self.row, self.span, self.feature, self.label = [], [], [], []
        self.chain, self.skip = [], []

    def add(self, row: int, text: str, base: list[tuple[int, int, int]]) -> None:
        last: dict[str, int] = {}
        tokens, spans, at = _tokens(text), sorted((s, e, k) for k, s, e in base), 0
        reach, previous = 0, None
        for a, b in tokens:
            while at < len(spans) and spans[at][1] <= a:
                at += 1
            inside = next((k for s, e, k in spans[at : at + 4] if s < b and a < e), OUTSIDE)
            i = len(self.row)
            self.row.append(row)
            self.span.append((a, b))
            self.feature.append(_shape(text, a, b))
            self.label.append(inside)
            if previous is not None and not text[reach:a].strip(" ()+-.,;:|\t\n"):
                self.chain.append((previous, i))
            previous, reach = i, b
            for key in {k for k in _key(text[a:b]) if k}:
                if key in last:
                    self.skip.append((last[key], i))
                last[key] = i


class Field:
    """Weights of the shapes, and the tables of chain and skip edges."""

    def __init__(self):
        self.weights = np.zeros((N_FEATURES, OUTSIDE + 1))
        self.chain = np.zeros((OUTSIDE + 1, OUTSIDE + 1))
        self.skip = np.zeros((OUTSIDE + 1, OUTSIDE + 1))
        self.fitted = False


def _ratio(pairs: list[tuple[int, int]], label: np.ndarray) -> np.ndarray:
    n = OUTSIDE + 1
    joint = np.full((n, n), 0.5)
    if pairs:
        p = np.array(pairs)
        np.add.at(joint, (label[p[:, 0]], label[p[:, 1]]), 1)
    joint /= joint.sum()
    return np.clip(np.log(joint) - np.log(joint.sum(1, keepdims=True) * joint.sum(0, keepdims=True)), -3, 3)


def fit_texts(texts: list[str]) -> Field:
    """A field from the pattern spans of these texts."""
    graph, field = _Graph(), Field()
    for k, text in enumerate(texts):
        graph.add(k, text, base_spans(text))
    label = np.array(graph.label, np.int64)
    if not len(label) or (label == OUTSIDE).all():
        return field
    x = np.zeros((len(label), N_FEATURES))
    for i, f in enumerate(graph.feature):
        x[i, f] = 1
    y = np.eye(OUTSIDE + 1)[label]
    w = field.weights
    speed = np.zeros_like(w)
    for _ in range(300):
        z = x @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        speed = 0.9 * speed + x.T @ (y - p) / len(x) - 2e-4 * w
        w += 0.5 * speed
    field.chain, field.skip, field.fitted = _ratio(graph.chain, label), _ratio(graph.skip, label), True
    return field


def beliefs(graph: _Graph, field: Field) -> np.ndarray:
    """Loopy sum-product over all tokens of the graph; clamped tokens keep their label."""
    label = np.array(graph.label, np.int64)
    n, k = len(label), OUTSIDE + 1
    own = np.zeros((n, k))
    for i, f in enumerate(graph.feature):
        own[i] = field.weights[f].sum(0)
    clamped = label != OUTSIDE
    own[clamped] = -50
    own[clamped, label[clamped]] = 0
    edges = np.array(graph.chain + graph.skip, np.int64).reshape(-1, 2)
    if len(edges):
        # Both directions of an edge at (0, e) and (1, e); texts whose messages stand still leave the sweeps.
        tables = np.stack([np.exp(field.chain), np.exp(field.skip)])
        kind = np.repeat([0, 1], [len(graph.chain), len(graph.skip)])
        row = np.array(graph.row, np.int64)
        most = np.bincount(row) + SETTLING
        message = np.zeros((2, len(edges), k))
        live, sweep = np.arange(len(edges)), 0
        while len(live):
            sweep += 1
            e, t, old = edges[live], tables[kind[live]], message[:, live]
            total = own.copy()
            np.add.at(total, e[:, 1], old[0])
            np.add.at(total, e[:, 0], old[1])
            out = np.stack([total[e[:, 0]] - old[1], total[e[:, 1]] - old[0]])
            out = np.exp(out - out.max(2, keepdims=True))
            new = np.log(np.stack([np.einsum("ea,eab->eb", out[0], t), np.einsum("eb,eab->ea", out[1], t)]) + 1e-30)
            new -= new.max(2, keepdims=True)
            new = DAMPING * old + (1 - DAMPING) * new
            message[:, live] = new
            moved = np.zeros(len(most))
            np.maximum.at(moved, row[e[:, 0]], np.abs(new - old).max((0, 2)))
            live = live[((moved > CHANGE) & (sweep < most))[row[e[:, 0]]]]
        np.add.at(own, edges[:, 1], message[0])
        np.add.at(own, edges[:, 0], message[1])
    p = np.exp(own - own.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _plausible(text: str, kind: int, a: int, b: int) -> bool:
    """Whether a span that the field adds can be of its kind at all."""
    t = text[a:b]
    digits = sum("0" <= c <= "9" for c in t)
    if kind == 0:
        return "@" in t
    if kind == 1:
        parts = re.findall("[0-9]+", t)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    return 13 <= digits <= 19 if kind == 2 else 9 <= digits <= 15


def find(texts: list[str | None], field: Field) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """(pattern spans, all spans) of each text, by kind, then start."""
    graph, base = _Graph(), []
    for k, text in enumerate(texts):
        base.append(base_spans(text))
        if field.fitted and text:
            graph.add(k, text, base[-1])
    added = defaultdict(list)
    if graph.row:
        p = beliefs(graph, field)
        best = p.argmax(1)
        keep = (best != OUTSIDE) & (p.max(1) >= ADD_AT) & (np.array(graph.label) == OUTSIDE)
        chained = set(graph.chain)
        previous = None
        for i in np.flatnonzero(keep).tolist():
            kind, (a, b), row = int(best[i]), graph.span[i], graph.row[i]
            if kind == 3 and previous == i - 1 and (i - 1, i) in chained and added[row] and added[row][-1][0] == 3:
                added[row][-1] = (3, added[row][-1][1], b)
            else:
                added[row].append((kind, a, b))
            previous = i
    return [(b, sorted(b + [s for s in added[k] if _plausible(texts[k], *s)])) for k, b in enumerate(base)]


def fit(documents: DataFrame, *, text_col: str = "text", max_train: int = MAX_TRAIN) -> Field:
    """Fit on at most `max_train` distinct texts with a digit or at sign, drawn by a hash of the text."""
    marked = documents.select(F.col(text_col).alias("t")).where(F.col("t").rlike("[0-9@]"))
    chosen = marked.select(F.xxhash64("t").alias("h")).distinct().orderBy("h").limit(max_train).agg(F.max("h")).first()[0]
    if chosen is None:
        return Field()
    rows = marked.where(F.xxhash64("t") <= chosen).dropDuplicates().toArrow()
    return fit_texts(sorted(rows.column("t").to_pylist()))


def _named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def _find_pass(batches, col: int, sent):
    field = sent.value
    for batch in batches:
        for a, b in B.slices(batch.column(col), 1_000_000):
            part = batch.slice(a, b - a)
            texts = part.column(col).to_pylist()
            found = find(texts, field)
            clean = []
            for text, (_, spans) in zip(texts, found):
                if spans:
                    out, place = [], 0
                    for s, e, k in sorted((s, e, k) for k, s, e in spans):
                        if s >= place:
                            out += [text[place:s], f"[{KINDS[k].upper()}]"]
                        place = max(place, e)
                    text = "".join(out) + text[place:]
                clean.append(text)
            counts = [[sum(k == i for k, _, _ in base) for base, _ in found] for i in range(len(KINDS))]
            columns = [pa.array(c, pa.int64()) for c in counts]
            columns += [pa.array([_named(base) for base, _ in found], pa.string()), pa.array([_named(spans) for _, spans in found], pa.string()), pa.array(clean, pa.string())]
            yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, *(f"n_{k}" for k in KINDS), "base", "spans", "clean"])


def scan(documents: DataFrame, field: Field, *, text_col: str = "text") -> DataFrame:
    """Columns of documents as in_0, in_1, ... with n_email, n_ip, n_card, n_phone, base, spans and the redacted text `clean`."""
    spark = prepare(documents.sparkSession)
    plain, text = own_names(documents, text_col)
    sent = spark.sparkContext.broadcast(field)
    at = plain.columns.index(text)
    added = ", ".join(f"n_{k} bigint" for k in KINDS) + ", base string, spans string, clean string"
    return arrow_map(plain, lambda batches: _find_pass(batches, at, sent), extended(plain.schema, added))


def redact(documents: DataFrame, *, text_col: str = "text") -> DataFrame:
    """Documents with every span replaced by its kind in brackets."""
    found = scan(documents, fit(documents, text_col=text_col), text_col=text_col)
    return found.select(*[F.col("clean" if c == text_col else f"in_{i}").alias(c) for i, c in enumerate(documents.columns)])


def report(documents: DataFrame) -> DataFrame:
    """The contract's columns, one row per document."""
    found = scan(documents.select("doc_id", "text"), fit(documents))
    return found.select(F.col("in_0").alias("doc_id"), *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")


def digest(spans: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(_named(spans).encode()).hexdigest()
