"""Personal data: fixed patterns, and a linear-chain conditional random field beside them.

The patterns find e-mail addresses, IPv4 addresses, card numbers and telephone numbers.
The field labels white-space separated tokens near a digit or an at-sign with the begin
or inside of such an entity, from the shapes of a token and its neighbours. It learns from
a small labelled table: ``EXAMPLES`` and the windows of a bounded sample of texts, labelled
by the patterns. It is decoded by Viterbi, in numpy batches of windows; a span is added
where it touches none of the patterns' spans and has the digits (or the sign) of its kind.

Defined cases: a null text is an empty one without spans; equal spans of one kind do not
occur twice in a text; long runs of any characters are scanned in linear time; repeated
rows get equal results; an empty table gives no rows; other columns are not read (``redact``
keeps them).
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deckflow.llm.common import slices, text_rows

Span = tuple[str, int, int]

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: Whatever an address, card or telephone number consists of lies in one such stretch.
_STRETCH = re.compile(r"[0-9+][0-9 ().+-]*")
_IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def _luhn(digits: list[int]) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = 2 * d if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its test, by kind and start."""
    emails, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            emails.append(("email", start, found.end()))
            done = found.end()
        at = text.find("@", max(at + 1, done))
    ips, cards, phones = [], [], []
    for stretch in _STRETCH.finditer(text):
        low, high = stretch.span()
        if high - low < 7:
            continue
        for m in _IP.finditer(text, low, high):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                ips.append(("ip", *m.span()))
        for m in _CARD.finditer(text, low, high):
            digits = [ord(c) - 48 for c in m[0] if c not in " -"]
            if 13 <= len(digits) <= 19 and _luhn(digits):
                cards.append(("card", *m.span()))
        for m in _PHONE.finditer(text, low, high):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                phones.append(("phone", *m.span()))
    return emails + ips + cards + phones


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


# The field.

LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
BITS = 14
SAMPLE_ROWS = 2_000
REACH = 40
#: Words, and the kind of those in brackets.
EXAMPLES = (
    ("call me on {(415) 555-0132} after six", "phone"),
    ("office {415-555-0177} or at home", "phone"),
    ("tel {020 7946 0018} in the morning", "phone"),
    ("mobile {07700 900 461} only", "phone"),
    ("dial {1-800-555-0199} for help", "phone"),
    ("reach us at {555.010.4477} today", "phone"),
    ("write to {mary.jones@example} for this", "email"),
    ("mail {info@mailhost} or come by", "email"),
    ("paid with {4111.1111.1111.1111} last week", "card"),
    ("card no {5500_0000_0000_0004} was used", "card"),
    ("host {10-20-30-40} went down", "ip"),
    ("in 1998 there were 12500 of them", ""),
    ("version 2.0 of 4 May 2011 at 12:30", ""),
    ("order 4471 cost 129.90 in all", ""),
    ("see pages 118-124 and table 7", ""),
)
_TOKEN = re.compile(r"\S+")
_HINT = re.compile(r"[0-9@]+")
_TRIM = re.compile(r"[A-Za-z0-9+(@](?:.*[A-Za-z0-9])?", re.S)


def windows(text: str) -> list[list[tuple[int, int]]]:
    """Tokens (start, end) within ``REACH`` characters of a digit or at-sign, by stretch."""
    bounds: list[list[int]] = []
    for hint in _HINT.finditer(text):
        if bounds and hint.start() < bounds[-1][1] - REACH:
            continue
        low, high = max(0, hint.start() - REACH), min(len(text), hint.end() + REACH)
        floor = bounds[-1][1] if bounds else 0
        while low > floor and not text[low - 1].isspace():
            low -= 1
        while high < len(text) and not text[high].isspace():
            high += 1
        if bounds and low <= bounds[-1][1]:
            bounds[-1][1] = max(high, bounds[-1][1])
        else:
            bounds.append([low, high])
    return [[m.span() for m in _TOKEN.finditer(text, *b)] for b in bounds]


def _shape(token: str) -> str:
    out = []
    for c in token[:32]:
        out.append("d" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c)
    return "".join(out)


def _features(tokens: list[str]) -> np.ndarray:
    """A row of hashed word-shape features for each token."""
    shapes = ["<", *map(_shape, tokens), ">"]
    rough = [re.sub(r"(.)\1+", r"\1+", s) for s in shapes]
    rows = []
    for i, token in enumerate(tokens, 1):
        digits = len(_DIGIT.findall(token))
        names = (
            "b",
            f"s{shapes[i]}",
            f"r{rough[i]}",
            f"p{rough[i - 1]}",
            f"n{rough[i + 1]}",
            f"pr{rough[i - 1]} {rough[i]}",
            f"rn{rough[i]} {rough[i + 1]}",
            f"d{min(digits, 20)} {'@' in token} {min(len(token), 24)}",
        )
        rows.append([xxhash.xxh32_intdigest(n) >> (32 - BITS) for n in names])
    return np.array(rows, np.int64).reshape(len(tokens), 8)


def _allowed() -> np.ndarray:
    """Zero where a label may follow another (first row: at the start), else minus a lot."""
    rules = np.zeros((len(LABELS) + 1, len(LABELS)))
    for j, after in enumerate(LABELS):
        if after[0] == "I":
            rules[:, j] = -1e9
            for i, before in enumerate(LABELS, 1):
                if before[1:] == after[1:]:
                    rules[i, j] = 0.0
    return rules


@dataclass
class Model:
    """Weights of features per label, and of label pairs (first row: of starting with it)."""

    emission: np.ndarray
    transition: np.ndarray

    @classmethod
    def empty(cls) -> Model:
        return cls(np.zeros((1 << BITS, len(LABELS))), np.zeros((len(LABELS) + 1, len(LABELS))))

    def decode(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        """The most likely labels of each sequence of feature rows; sequences of a like length together."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(sequences)
        order = sorted((i for i, s in enumerate(sequences) if len(s)), key=lambda i: len(sequences[i]))
        rules = self.transition + _allowed()
        while order:
            # A batch of about as many steps, whatever the length of its sequences.
            part = order[: max(1, 50_000 // len(sequences[order[min(511, len(order) - 1)]]))][:512]
            order = order[len(part) :]
            steps = len(sequences[part[-1]])
            scores = np.zeros((len(part), steps, len(LABELS)))
            sizes = np.array([len(sequences[i]) for i in part])
            for row, i in enumerate(part):
                scores[row, : sizes[row]] = self.emission[sequences[i]].sum(axis=1)
            best = scores[:, 0] + rules[0]
            back = np.zeros((len(part), steps, len(LABELS)), np.int8)
            for t in range(1, steps):
                ways = best[:, :, None] + rules[None, 1:]
                back[:, t] = ways.argmax(axis=1)
                on = (t < sizes)[:, None]
                best = np.where(on, ways.max(axis=1) + scores[:, t], best)
            for row, i in enumerate(part):
                label, labels = int(best[row].argmax()), np.zeros(sizes[row], np.int64)
                for t in range(sizes[row] - 1, -1, -1):
                    labels[t] = label
                    label = int(back[row, t, label])
                out[i] = labels
        return out

    def learn(self, rows: list[tuple[np.ndarray, np.ndarray]], epochs: int = 12, rate: float = 0.3, l2: float = 1e-4) -> None:
        """Stochastic ascent of the log-likelihood, with a rate per weight."""
        rules, n = _allowed(), len(LABELS)
        seen_e, seen_t = np.full_like(self.emission, 1e-6), np.full_like(self.transition, 1e-6)
        for _ in range(epochs):
            for x, y in rows:
                score, move = self.emission[x].sum(axis=1), self.transition + rules
                steps = len(x)
                ahead, behind = np.zeros((steps, n)), np.zeros((steps, n))
                ahead[0] = score[0] + move[0]
                for t in range(1, steps):
                    ahead[t] = score[t] + np.logaddexp.reduce(ahead[t - 1][:, None] + move[1:], axis=0)
                for t in range(steps - 2, -1, -1):
                    behind[t] = np.logaddexp.reduce(move[1:] + score[t + 1] + behind[t + 1], axis=1)
                norm = np.logaddexp.reduce(ahead[-1])
                node = np.exp(ahead + behind - norm)
                node[np.arange(steps), y] -= 1
                pair = np.zeros_like(self.transition)
                pair[0] = node[0]
                for t in range(1, steps):
                    pair[1:] += np.exp(ahead[t - 1][:, None] + move[1:] + score[t] + behind[t] - norm)
                    pair[1 + y[t - 1], y[t]] -= 1
                g = np.repeat(node[:, None, :], x.shape[1], axis=1).reshape(-1, n)
                at, inverse = np.unique(x.ravel(), return_inverse=True)
                grad = np.zeros((len(at), n))
                np.add.at(grad, inverse, g)
                grad += l2 * self.emission[at]
                seen_e[at] += grad * grad
                self.emission[at] -= rate * grad / np.sqrt(seen_e[at])
                pair += l2 * self.transition
                seen_t += pair * pair
                self.transition -= rate * pair / np.sqrt(seen_t)

    def spans(self, texts: list[str]) -> list[list[Span]]:
        """What the field finds in each text."""
        places, sequences = [], []
        for n, text in enumerate(texts):
            for tokens in windows(text):
                places.append((n, tokens))
                sequences.append(_features([text[a:b] for a, b in tokens]))
        out: list[list[Span]] = [[] for _ in texts]
        for (n, tokens), labels in zip(places, self.decode(sequences)):
            for kind, first, last in _entities(labels):
                low, high = tokens[first][0], tokens[last][1]
                trimmed = _TRIM.search(texts[n], low, high)
                if trimmed and _plausible(kind, trimmed[0]):
                    out[n].append((kind, *trimmed.span()))
        return out


def _entities(labels: np.ndarray) -> Iterator[tuple[str, int, int]]:
    start = None
    for i, label in enumerate([*labels.tolist(), 0]):
        name = LABELS[label]
        if start is not None and name[0] != "I":
            yield LABELS[labels[start]][2:], start, i - 1
            start = None
        if name[0] == "B":
            start = i


def _plausible(kind: str, found: str) -> bool:
    digits = len(_DIGIT.findall(found))
    if kind == "email":
        return "@" in found[1:-1]
    return {"ip": 4 <= digits <= 12, "card": 13 <= digits <= 19, "phone": 9 <= digits <= 15}[kind]


def all_spans(texts: list[str | None], model: Model) -> list[tuple[list[Span], list[Span]]]:
    """For each text the spans of the patterns, and those with what the field adds."""
    texts = [t or "" for t in texts]
    out = []
    for text, more in zip(texts, model.spans(texts)):
        base = base_spans(text)
        added: list[Span] = []
        # Ends before each start, of all spans so far: what begins after them touches none.
        taken = sorted((low, high) for _, low, high in base)
        ends = list(accumulate((high for _, high in taken), max, initial=0))
        done = 0
        for span in sorted(more, key=lambda s: s[1:]):
            at = bisect_left(taken, (span[2],))
            if ends[at] <= span[1] and done <= span[1]:
                added.append(span)
                done = span[2]
        every = sorted([*base, *added], key=lambda s: (KINDS.index(s[0]), s[1]))
        out.append((base, every))
    return out


def _labelled(text: str, spans: list[Span]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows of a text with the labels of its spans."""
    for tokens in windows(text):
        labels = np.zeros(len(tokens), np.int64)
        for kind, low, high in spans:
            inside = [i for i, (a, b) in enumerate(tokens) if a < high and low < b]
            for place, i in enumerate(inside):
                labels[i] = 1 + 2 * KINDS.index(kind) + (place > 0)
        yield _features([text[a:b] for a, b in tokens]), labels


def _examples() -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for marked, kind in EXAMPLES:
        low, high = marked.find("{"), marked.find("}") - 1
        text = marked.replace("{", "").replace("}", "")
        yield from _labelled(text, [(kind, low, high)] if kind else [])


def train(
    docs: DataFrame,
    sample_rows: int = SAMPLE_ROWS,
    windows_per_text: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Model:
    """Fit on ``EXAMPLES`` and windows of the ``sample_rows`` texts with the smallest hash of their id.

    Of each text, the first ``windows_per_text`` windows of at most 100 tokens teach.
    """
    ids = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"))
        .dropna()
        .distinct()
        .withColumn("rank", F.xxhash64("doc_id"))
        .orderBy("rank")
        .limit(sample_rows)
    )

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch):
                rows = []
                for rank, text in zip(some.column("rank").to_pylist(), some.column("text").to_pylist()):
                    short = (w for w in _labelled(text or "", base_spans(text or "")) if len(w[0]) <= 100)
                    for x, y in islice(short, windows_per_text):
                        rows.append((rank, x.astype("<i4").tobytes(), y.astype("<i4").tobytes()))
                columns = list(zip(*rows)) or [[]] * 3
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())],
                    ["rank", "x", "y"],
                )

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [
            (np.frombuffer(r["x"], "<i4").reshape(-1, 8).astype(np.int64), np.frombuffer(r["y"], "<i4").astype(np.int64))
            for batch in batches
            for r in batch.to_pylist()
        ]
        model = Model.empty()
        model.learn([*rows, *list(_examples()) * 5])
        yield pa.RecordBatch.from_arrays(
            [pa.array([model.emission.tobytes()]), pa.array([model.transition.tobytes()])], ["emission", "transition"]
        )

    # The sample is bounded by ``sample_rows`` pairs of numbers.
    got = (
        text_rows(docs, id_col, text_col)
        .join(F.broadcast(ids), "doc_id")
        # Of rows that share an id one teaches, so that the fit takes no more texts than ids.
        .groupBy("rank").agg(F.min("text").alias("text"))
        .mapInArrow(label, "rank long, x binary, y binary")
        .repartition(1)
        .sortWithinPartitions("rank", "x", "y")
        .mapInArrow(fit, "emission binary, transition binary")
        .first()
    )
    if got is None:
        return Model.empty()
    n = len(LABELS)
    return Model(np.frombuffer(got[0]).reshape(-1, n).astype(np.float32), np.frombuffer(got[1]).reshape(-1, n))


RESULT = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
)


def find(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and a digest of the patterns' spans, and all spans as text, for every whole text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch):
                got = []
                for base, every in all_spans(some.column("text").to_pylist(), model):
                    kinds = [s[0] for s in base]
                    digest = hashlib.sha256(joined(base).encode()).hexdigest()
                    got.append((*map(kinds.count, KINDS), digest, joined(every), len(every) - len(base)))
                types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id")] + [pa.array(c, k) for c, k in zip(zip(*got), types)],
                    [f.split()[0] for f in RESULT.split(", ")],
                )

    return text_rows(docs, id_col, text_col).mapInArrow(rows, RESULT)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with ``[KIND]`` in place of its spans; overlapping spans become one."""
    out, done = [], 0
    for kind, low, high in sorted(spans, key=lambda s: (s[1], -s[2])):
        if low >= done:
            out += [text[done:low], f"[{kind.upper()}]"]
        done = max(done, high)
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, model: Model, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``docs`` with all spans replaced in the text; ``length_col`` gets the new number of characters."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, text_col=text_col):
                texts = some.column(text_col).cast(pa.string()).to_pylist()
                new = [
                    t if t is None else redacted(t, every) for t, (_, every) in zip(texts, all_spans(texts, model))
                ]
                columns = {f.name: some.column(f.name) for f in some.schema}
                columns[text_col] = pa.array(new, some.schema.field(text_col).type)
                if length_col:
                    columns[length_col] = pa.array(
                        [n if t is None else len(t) for t, n in zip(new, columns[length_col].to_pylist())],
                        some.schema.field(length_col).type,
                    )
                yield pa.RecordBatch.from_arrays(list(columns.values()), schema=some.schema)

    return docs.mapInArrow(rows, docs.schema)
