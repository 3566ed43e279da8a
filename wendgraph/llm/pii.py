"""Personal data: exact patterns, and a skip-chain conditional random field that adds spans to them."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, words

KINDS = ("email", "ip", "card", "phone", "secret")
LABELS = ("other", *KINDS)
BASE = KINDS[:4]
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_EVIDENCE = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"(?<!\S)\S*?[0-9@]\S*")
_EDGES = "\"'`.,;:!?()[]{}<>#$%&*|"
_PREVIOUS = re.compile(r"[^\W\d_]{2,}")
_VALUE = re.compile(r"(?i)(?:token|secret|password|passwd|api[_-]?key|key)[\"']?\s{0,2}[:=]\s{0,2}(\S+)")
_WORD = re.compile(r"\S+")
_ASSIGNED = re.compile(r"(?i)(?:token|secret|password|passwd|api[_-]?key|key)\W{1,4}$")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the four patterns, by kind and start; leftmost, non-overlapping within a kind.
    Every pattern is searched in linear time: an email is looked for at each @ only, to whose left its local
    part runs back as far as the last match, and a digit run is tried at its first digit only."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        m = _DOMAIN.match(text, at)
        start = at
        if m:
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                done = m.end()
                out.append(("email", start, done))
        at = text.find("@", max(at + 1, done))
    if _EVIDENCE.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append(("phone", *m.span()))
    return out


class Tokens(NamedTuple):
    start: list[int]
    end: list[int]
    text: list[str]
    feature: np.ndarray  # tokens x FEATURES
    skip: np.ndarray  # pairs of tokens that are repeated or similar: the later one and the one before it


FEATURES = 20
_SHAPE = [9, 10, 12, 19]  # those that say of which characters a token is


def _values(text: str) -> set[str]:
    """The values, in lower case and without digit or @, that the text assigns to a telling name (password = ...)."""
    if "=" not in text and ":" not in text:
        return set()
    return {v for v in (v.strip(_EDGES).lower() for v in _VALUE.findall(text)) if v and not _EVIDENCE.search(v)}


def tokens(text: str) -> Tokens:
    """The chain's nodes: white-space tokens with a digit or @, without quotes and punctuation around them, and tokens that
    are assigned to a telling name anywhere in the text. All others are no personal data of these kinds, whatever is
    near, and count through the features of the nodes next to them. Each node is tied to the last one before it
    with the same characters but for case, with the same digits (six or more) in another writing, or, of an
    address, with its part before the @."""
    start, end, texts, rows = [], [], [], []
    values = _values(text)
    for m in (_WORD if values else _TOKEN).finditer(text):
        raw = m[0]
        if values and not _EVIDENCE.search(raw) and raw.strip(_EDGES).lower() not in values and raw.rpartition("=")[2].strip(_EDGES).lower() not in values:
            continue
        inner = raw.lstrip(_EDGES)
        a = m.start() + len(raw) - len(inner)
        inner = inner.rstrip(_EDGES)
        if not inner:
            continue
        digits = sum(c.isdigit() for c in inner)
        hexa = sum(c in "0123456789abcdefABCDEF" for c in inner)
        before = text[max(0, a - 24) : a]
        n = len(inner)
        rows.append((1.0, "@" in inner, inner.count("@") > 1, inner.count(".") == 3 and digits >= 4, "." in inner, inner[0] == "+", digits == n, digits >= 13, 9 <= digits <= 15, digits / n, hexa == n, n >= 16, n >= 32, n <= 3, any(c in "-()" for c in inner), bool(_ASSIGNED.search(before)), any(c in before[-3:] for c in "=:"), '"' in before[-1:] + raw[-1:], any(ord(c) > 127 for c in inner), n >= 8 and 0 < digits < n and hexa < n))
        start.append(a)
        end.append(a + n)
        texts.append(inner)
    last: dict[str, int] = {}
    skip = []
    for i, t in enumerate(texts):
        digits = "".join(c for c in t if c.isdigit())
        keys = [t.lower()] + (["#" + digits] if len(digits) >= 6 else [])
        if "@" in t:
            keys.append(t.lower().partition("@")[0])
        tied = {last[k] for k in keys if k in last}
        skip.extend((i, j) for j in tied)
        last.update((k, i) for k in keys)
    return Tokens(start, end, texts, np.array(rows, np.float64).reshape(len(rows), FEATURES), np.array(skip, np.int64).reshape(len(skip), 2))


class Field(NamedTuple):
    node: np.ndarray  # FEATURES x labels
    chain: np.ndarray  # labels x labels, of a node and the next one
    tied: np.ndarray  # labels x labels, of tied nodes


def infer(field: Field, feature: np.ndarray, chain: np.ndarray, skip: np.ndarray, fixed: np.ndarray, rounds: int = 12, damping: float = 0.3) -> np.ndarray:
    """Nodes' marginals by loopy message passing (sum-product, all messages at once, damped, `rounds` times) over
    chain and tied pairs of any number of documents together. fixed: a label that is known, or -1."""
    unary = feature @ field.node
    known = np.flatnonzero(fixed >= 0)
    unary[known] = -1e3
    unary[known, fixed[known]] = 0
    k = len(LABELS)
    kinds = [(x.T[0], x.T[1], np.exp(m), np.full((len(x), k), 1 / k), np.full((len(x), k), 1 / k)) for x, m in ((chain, field.chain), (skip, field.tied)) if len(x)]

    def belief() -> np.ndarray:
        total = unary.copy()
        for a, b, _, to_a, to_b in kinds:
            np.add.at(total, b, np.log(to_b))
            np.add.at(total, a, np.log(to_a))
        return total

    for _ in range(rounds if kinds else 0):
        total, new = belief(), []
        for a, b, potential, to_a, to_b in kinds:  # an edge kind's potentials are shared by its edges
            new_b = _normal(total[a] - np.log(to_a)) @ potential
            new_a = _normal(total[b] - np.log(to_b)) @ potential.T
            mixed = [np.maximum(damping * old + (1 - damping) * x / x.sum(1, keepdims=True), 1e-12) for old, x in ((to_a, new_a), (to_b, new_b))]
            new.append((a, b, potential, *mixed))
        kinds = new
    return _normal(belief())


def _normal(log: np.ndarray) -> np.ndarray:
    x = np.exp(log - log.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def _labels(t: Tokens, text: str, spans: list[tuple[str, int, int]], weak: bool) -> np.ndarray:
    """Nodes' labels: the kind of the base span that covers one; if weak, secret for a long token that is
    assigned to a telling name, and other for the rest; else -1 for the rest."""
    out = np.full(len(t.text), 0 if weak else -1)
    starts, ends = np.array(t.start, np.int64), np.array(t.end, np.int64)
    at = np.array([(a, b) for _, a, b in spans], np.int64).reshape(-1, 2)
    for (kind, *_), i, j in zip(spans, np.searchsorted(ends, at[:, 0], "right").tolist(), np.searchsorted(starts, at[:, 1], "left").tolist()):
        out[i:j] = LABELS.index(kind)
    if weak:
        assigned = (t.feature[:, 15] > 0) & (t.feature[:, 11] > 0)
        out[assigned & (out == 0)] = LABELS.index("secret")
    return out


def train(docs: DataFrame, sample: int = 2000, steps: int = 150, chars: int = 20_000) -> Field:
    """The field's weights by maximum pseudo-likelihood: each node's label given its features and its neighbours'
    labels. Labels are the base patterns' and, for secrets, assignments to a telling name; what the second
    kind was told by stays visible in half of the rows only, so that shape and tied nodes count too, and in a quarter
    what secrets are made of isn't, so that assigned words without a digit count. Learned
    from a bounded sample: of the documents with a digit or @ and at most `chars` characters, `sample` chosen by a hash of
    id and text. An empty table gives a field of zeros, which adds nothing."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.where(F.col("text").rlike("[0-9@]") & (F.length("text") <= chars))
    chosen = shared.hashed_sample(rows, sample, rows.count(), "doc_id", "text").collect()
    k = len(LABELS)
    features, labels, chains, skips, n = [], [], [], [], 0
    for i, r in enumerate(chosen):
        t = tokens(r["text"])
        y = _labels(t, r["text"], base_spans(r["text"]), weak=True)
        f = t.feature.copy()
        if i % 2:
            f[:, 15:18] = 0
        elif i % 4:
            f[np.ix_(y == LABELS.index("secret"), _SHAPE)] = 0
        features.append(f)
        labels.append(y)
        chains.append(n + _next(len(y)))
        skips.append(n + t.skip)
        n += len(y)
    if not n:
        return Field(np.zeros((FEATURES, k)), np.zeros((k, k)), np.zeros((k, k)))
    f, y, chain, skip = np.concatenate(features), np.concatenate(labels), np.concatenate(chains), np.concatenate(skips)
    one = np.eye(k)[y]
    before, after, other = (np.zeros((n, k)) for _ in range(3))
    before[chain[:, 1]], after[chain[:, 0]] = one[chain[:, 0]], one[chain[:, 1]]
    np.add.at(other, skip[:, 0], one[skip[:, 1]])
    np.add.at(other, skip[:, 1], one[skip[:, 0]])
    w, c, s = np.zeros((FEATURES, k)), np.zeros((k, k)), np.eye(k)
    m = [np.zeros_like(x) for x in (w, c, s)]
    v = [np.zeros_like(x) for x in (w, c, s)]
    for step in range(1, steps + 1):
        d = (_normal(f @ w + before @ c + after @ c.T + other @ s) - one) / n
        g = (f.T @ d + 1e-4 * w, before.T @ d + d.T @ after + 1e-3 * c, other.T @ d + 1e-3 * s)
        for x, gx, mx, vx in zip((w, c, s), ((g[0]), (g[1]), (g[2] + g[2].T) / 2), m, v):
            mx += 0.1 * (gx - mx)
            vx += 0.01 * (gx * gx - vx)
            x -= 0.1 * (mx / (1 - 0.9**step)) / (np.sqrt(vx / (1 - 0.99**step)) + 1e-8)
    return Field(w, c, s)


def _next(n: int) -> np.ndarray:
    return np.stack([np.arange(n - 1), np.arange(1, n)], axis=1) if n > 1 else np.zeros((0, 2), np.int64)


def detect(texts: list[str], field: Field, least: float = 0.8) -> list[tuple[list, list]]:
    """Of each text, its base spans and the spans that the field adds: nodes outside base spans whose most likely
    label is a kind with a probability of `least` or more. Messages are passed in about a million characters of texts at
    once, and in all of one text."""
    return [x for a, b in words.blocks([len(t) for t in texts]) for x in _detected(texts[a:b], field, least)]


def _detected(texts: list[str], field: Field, least: float) -> list[tuple[list, list]]:
    base = [base_spans(t) if t else [] for t in texts]
    found = [(i, tokens(t)) for i, t in enumerate(texts) if t and (_EVIDENCE.search(t) or _values(t))]
    added: list[list] = [[] for _ in texts]
    found = [(i, t) for i, t in found if t.text]
    if found:
        offset = np.cumsum([0, *(len(t.text) for _, t in found)])
        fixed = np.concatenate([_labels(t, texts[i], base[i], weak=False) for i, t in found])
        chain = np.concatenate([n + _next(len(t.text)) for n, (_, t) in zip(offset, found)])
        skip = np.concatenate([n + t.skip for n, (_, t) in zip(offset, found)])
        p = infer(field, np.concatenate([t.feature for _, t in found]), chain, skip, fixed)
        best = p.argmax(axis=1)
        hit = (best > 0) & (fixed < 0) & (p.max(axis=1) >= least)
        for n, (i, t) in zip(offset.tolist(), found):
            for j in np.flatnonzero(hit[n : n + len(t.text)]).tolist():
                added[i].append((LABELS[best[n + j]], t.start[j], t.end[j]))
    return list(zip(base, added))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """Per row: doc_id, the base patterns' counts, base_sha256, spans (base and added, kind:start:end in code
    points by kind and start) and n_added. Null counts as empty, and both have no spans. Whole texts are
    searched whatever their length; repeated rows each get their row; other columns are not looked at. An
    empty table gives no rows."""
    shared.small_batches(docs.sparkSession)
    field = field or train(docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, (base, added) in zip(batch["doc_id"].astype("Int64").tolist(), detect(["" if t is None else t for t in batch["text"]], field)):
                n = [sum(s[0] == k for s in base) for k in BASE]
                out.append((doc, *n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + added), len(added)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, SCHEMA)


def redact(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """The documents with every span replaced by its kind in brackets, and n_chars, where there is such a column,
    the new text's length. Overlapping spans are replaced as one, by the kind that starts first. Null texts
    stay null; all other columns stay as they are."""
    shared.small_batches(docs.sparkSession)
    field = field or train(docs)
    names, counted = docs.columns, "n_chars" in docs.columns

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = batch.tolist()
            out = []
            for text, (base, added) in zip(texts, detect(["" if t is None else t for t in texts], field)):
                if text is None or not (base or added):
                    out.append(text)
                    continue
                parts, at = [], 0
                for kind, a, b in sorted(base + added, key=lambda s: (s[1], -s[2])):
                    if a >= at:
                        parts += (text[at:a], f"[{kind.upper()}]")
                    at = max(at, b)
                out.append("".join([*parts, text[at:]]))
            yield pd.Series(out, dtype=object)
        shared.release()

    out = docs.withColumn("text", F.pandas_udf(run, "string")(F.col("text").cast("string")))
    if counted:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))
    return out.select(names)
