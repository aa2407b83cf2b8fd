"""Personal data by weak supervision: patterns propose spans, labelers vote, expectation-maximisation weighs them, a classifier decides."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import releasing

#: The kinds that every document is searched for, in their order, and those that only the method adds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "number", "handle")

#: The patterns asked for. Look-behinds and possessive repeats change no match, as a match that fails at the start of a run of
#: digits fails inside the run too; they keep long runs from taking quadratic time.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: Further spans to vote on.
SECRET = re.compile(r"[\"'][0-9A-Za-z+/_=-]{16,}+[\"']")
NUMBER = re.compile(r"(?<![0-9+])[0-9](?:[ ./()-]?[0-9])++")
HANDLE = re.compile(r"[^\s@<>\"']{1,64}@[^\s@<>\"']{1,255}")

#: Words that announce personal data or secrets.
GAZETTEER = frozenset(
    "account address api apikey auth bearer bic call card carte cell contact credential credit direccion email fax handy host iban ip key konto "
    "kreditkarte mail mobile movil passwd password passwort phone private pwd secret server sms ssn tarjeta tel telefon telefono telephone token user visa".split()
)
WORD = re.compile(r"[^\W\d_]+")
LABELERS = 5


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the four base kinds, each searched leftmost and without overlaps; matches that fail a test are dropped."""
    out = []
    at, floor = text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, 0, m.end()))
            floor = m.end()
            at = text.find("@", floor)
        else:
            floor = at + 1
            at = text.find("@", floor)
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(_digits(m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def candidates(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and other spans worth a vote that overlap none of them."""
    if not any(c in text for c in '@"\'') and not re.search("[0-9]", text):
        return [], []
    base = base_spans(text)
    taken = sorted((a, b) for a, _, b in base)
    more: list[tuple[int, int, int]] = []
    for kind, pattern, least in ((4, SECRET, 18), (5, NUMBER, 7), (6, HANDLE, 5)):
        if kind == 6 and "@" not in text:
            continue
        starts, ends = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
        found = []
        for m in pattern.finditer(text):
            a, b = (m.start() + 1, m.end() - 1) if kind == 4 else m.span()
            before = bisect_left(starts, b)  # spans taken that start before this one's end
            if m.end() - m.start() >= least and not (before and ends[before - 1] > a):
                found.append((a, b))
        more += [(a, kind, b) for a, b in found]
        taken = sorted(taken + found)
    return base, sorted(more)


def votes(text: str, start: int, kind: int, end: int) -> list[int]:
    """Each labeler's vote on a span: 1 for, -1 against, 0 no opinion."""
    span, before, after = text[start:end], text[max(0, start - 24) : start], text[end : end + 3]
    digits = _digits(span)
    letters = len(span) - len(digits)
    if kind < len(BASE_KINDS):
        form = 1
    elif kind == 4:
        form = 1 if digits and letters and len(span) >= 20 else 0 if digits else -1
    elif kind == 5:
        form = 1 if letters and 10 <= len(digits) <= 15 else -1 if len(digits) < 9 else 0
    else:
        form = 0 if "." in span[span.find("@") :] else -1
    near = WORD.findall(before.lower())[-2:]
    gazetteer = 1 if any(w in GAZETTEER for w in near) else 0
    edge = before.rstrip()[-1:]
    context = 1 if edge in ("=", ":") else -1 if edge in ("$", "€", "£", "#", "§") or after.lstrip()[:1] in ("%", "€", "$") else -1 if edge and before[-1:].isalnum() else 0
    check = 0
    if kind in (2, 5) and len(digits) >= 13:
        check = 1 if luhn(digits) else -1
    elif kind == 1:
        check = 1
    variety = len(set(span))
    return [form, gazetteer, context, check, 1 if variety >= 8 else -1 if variety <= 3 else 0]


def features(text: str, start: int, kind: int, end: int) -> list[int]:
    """What the final classifier sees of a span: small numbers, so that equal spans can be counted together."""
    span = text[start:end]
    digits = len(_digits(span))
    share = 4 * digits // max(1, len(span))
    before = text[start - 1] if start else " "
    after = text[end] if end < len(text) else " "
    side = [0 if c.isspace() else 1 if c.isalnum() else 2 if c in "\"'" else 3 for c in (before, after)]
    return [kind, min(7, len(span) // 5), min(4, share), side[0], side[1], int(bool(re.search(r"[=:]\s*[\"']?$", text[max(0, start - 4) : start])))]


FEATURE_SIZES = (len(KINDS), 8, 5, 4, 4, 2)


def encode(v: list[int], f: list[int]) -> int:
    """Votes and features as one number."""
    code = 0
    for x in v:
        code = 3 * code + x + 1
    for x, n in zip(f, FEATURE_SIZES, strict=True):
        code = n * code + x
    return code


def decode(code: int) -> tuple[list[int], list[int]]:
    f, v = [], []
    for n in reversed(FEATURE_SIZES):
        code, x = divmod(code, n)
        f.append(x)
    for _ in range(LABELERS):
        code, x = divmod(code, 3)
        v.append(x - 1)
    return v[::-1], f[::-1]


def reliabilities(v: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """EM for two hidden classes and labelers that vote independently given the class. v: rows of votes; weight: how often each row came.
    Returns P(vote | class) as [labeler, class, vote + 1] and each row's posterior of class 1."""
    post = 1 / (1 + np.exp(-v.sum(axis=1).astype(float)))
    table = np.zeros((v.shape[1], 2, 3))
    for _ in range(rounds):
        own = np.stack([1 - post, post]) * weight
        prior = np.clip(own.sum(axis=1) / max(weight.sum(), 1), 0.02, 0.98)
        for k in range(v.shape[1]):
            for x in (-1, 0, 1):
                table[k, :, x + 1] = (own[:, v[:, k] == x].sum(axis=1) + 1) / (own.sum(axis=1) + 3)
        # a labeler's vote for a class never counts against it, else the two classes could change places
        odds = np.log(prior[1] / prior[0]) + sum(np.where(v[:, k] == 0, 0.0, np.where(v[:, k] > 0, np.maximum(0, np.log(table[k, 1, 2] / table[k, 0, 2])), np.minimum(0, np.log(table[k, 1, 0] / table[k, 0, 0])))) for k in range(v.shape[1]))
        post = 1 / (1 + np.exp(-odds))
    return table, post


def _one_hot(f: np.ndarray) -> np.ndarray:
    """Indicators of every feature value and of every (kind, other value), and a constant."""
    columns = [np.ones(len(f))]
    for k, n in enumerate(FEATURE_SIZES):
        columns += [(f[:, k] == x).astype(float) for x in range(n)]
    for k, n in enumerate(FEATURE_SIZES[1:], 1):
        columns += [((f[:, 0] == kind) & (f[:, k] == x)).astype(float) for kind in range(len(KINDS)) for x in range(n)]
    return np.stack(columns, axis=1)


@dataclass
class SpanModel:
    """Weights of the span classifier, and what EM found of the labelers."""

    weights: np.ndarray
    tables: np.ndarray

    def accepts(self, f: list[int]) -> bool:
        return float((_one_hot(np.array([f])) @ self.weights)[0]) > 0


def train(counts: list[tuple[int, int]], rounds: int = 300) -> SpanModel:
    """From (code, count): reliabilities by EM, then a logistic regression on the posteriors by gradient steps with momentum."""
    if not counts:
        return SpanModel(-np.ones(_one_hot(np.zeros((1, len(FEATURE_SIZES)), int)).shape[1]), np.zeros((LABELERS, 2, 3)))
    counts = sorted(counts)
    both = [decode(c) for c, _ in counts]
    v, f, weight = np.array([b[0] for b in both]), np.array([b[1] for b in both]), np.array([n for _, n in counts], float)
    tables, post = reliabilities(v, weight)
    x, share = _one_hot(f), weight / weight.sum()
    w, step = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for _ in range(rounds):
        slope = x.T @ (share * (1 / (1 + np.exp(-np.clip(x @ w, -35, 35))) - post)) + 1e-4 * w
        step = 0.9 * step - 1.0 * slope
        w = w + step
    return SpanModel(w, tables)


def fit(docs: DataFrame, text: str = "text") -> SpanModel:
    """Votes and features of all candidate spans of all texts, counted by their code (a bounded number of codes, however many texts), go
    to the driver, which trains on the counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for value in batch.column(text):
                s = value.as_py()
                if s:
                    base, more = candidates(s)
                    found.update(encode(votes(s, *x), features(s, *x)) for x in (*base, *more))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["code", "n"])

    counts = docs.select(F.col(text)).mapInArrow(releasing(run), "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))
    return train([(r["code"], r["n"]) for r in counts.collect()])


def find(text: str | None, model: SpanModel, memo: dict | None = None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans of a text, sorted by start and kind."""
    if not text:
        return [], []
    base, more = candidates(text)
    memo = {} if memo is None else memo
    added = []
    for x in more:
        f = tuple(features(text, *x))
        if f not in memo:
            memo[f] = model.accepts(list(f))
        if memo[f]:
            added.append(x)
    return base, sorted([*base, *added])


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Text with each span, or run of overlapping spans, replaced by the first one's kind in brackets."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k]}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def private_data(docs: DataFrame, model: SpanModel | None = None, columns: list[str] | None = None, key: str = "doc_id", text: str = "text", redacted: bool = False) -> DataFrame:
    """Personal data in whole texts.

    Returns ``columns`` (default: the key), n_email, n_ip, n_card, n_phone (base spans by kind), base (the base spans as kind:start:end),
    spans (these and the accepted others; offsets in code points, end exclusive) and, with ``redacted``, the text with all spans replaced.
    Null and empty texts have no spans (a null stays null when redacted); repeated rows and null keys are handled like any others;
    without candidate spans nothing is added; an empty table gives no rows."""
    model = model or fit(docs, text)
    columns = columns or [key]
    kept = [docs.schema[c] for c in columns]
    counts = [f"n_{k}" for k in BASE_KINDS]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"{c} bigint" for c in counts), "base string", "spans string", *(["redacted string"] if redacted else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in batches:
            numbers, base_, all_, clean = [], [], [], []
            for value in batch.column("_text"):
                s = value.as_py()
                base, spans = find(s, model, memo)
                numbers.append([sum(1 for x in base if x[1] == k) for k in range(len(BASE_KINDS))])
                base_.append(written(base))
                all_.append(written(spans))
                if redacted:
                    clean.append(redact(s, spans) if s and spans else s)
            by_kind = [pa.array([n[k] for n in numbers], pa.int64()) for k in range(len(BASE_KINDS))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *by_kind, pa.array(base_, pa.string()), pa.array(all_, pa.string()), *([pa.array(clean, pa.string())] if redacted else [])], names=[*columns, *counts, "base", "spans", *(["redacted"] if redacted else [])])

    return docs.select(*columns, F.col(text).alias("_text")).mapInArrow(releasing(run), schema)


def brute_force(text: str | None) -> str:
    """Digest of the base spans by the plain patterns; for tests."""
    text, out = text or "", []
    for k, pattern in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            d = _digits(m.group())
            if k == 0 or k == 1 and max(map(int, m.group().split("."))) <= 255 or k == 2 and 14 <= len(d) <= 19 and luhn(d) or k == 3 and 10 <= len(d) <= 15:
                out.append((m.start(), k, m.end()))
    return hashlib.sha256(written(sorted(out)).encode()).hexdigest()
