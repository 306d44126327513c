"""Personal data by a linear-chain conditional random field over word shapes.

Kinds: email, ip, card, phone. The rules of ``base_spans`` find the plain cases. The
field adds others (numbers without a country code, say): it labels words (runs without
white space) as outside, begin or inside of a kind. A word without a digit and without
``@`` is outside by definition, so decoding runs over the stretches between such words;
their shapes still are features of their neighbours. Stretches of a batch are decoded
together by Viterbi, as numpy arrays of similar length. What the field finds is kept where
no base span lies.

The field is trained on a small labelled table (``labelled``: at most MOST_LABELLED rows,
made from templates with a fixed seed; any DataFrame of that form can be given instead).

Spans are in code points, end exclusive. Defined results: a null text counts as empty and
has no spans; repeated rows give repeated results; extra columns are ignored by ``find`` and
kept by ``redact``; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.text import few, pick
from tidewatch.plans.registry import query
from tidewatch.session import table

KINDS = ("email", "ip", "card", "phone")
#: Rows the labelled table may have, hashed features, and training steps.
MOST_LABELLED, FEATURES, ROUNDS = 5_000, 1 << 13, 80

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SIGNAL = re.compile(r"[0-9@]")
# the rules' patterns, written so that no stretch of text is read twice
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by rules, sorted."""
    if not _SIGNAL.search(text):
        return []
    out = []
    end = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            end = m.end()
            out.append((0, start, end))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _DIGITS.sub("", m.group())
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_DIGITS.sub("", m.group())) <= 15:
                out.append((3, m.start(), m.end()))
    return out


# labels: 0 outside, then begin and inside of each kind
LABELS = 1 + 2 * len(KINDS)
_BARRED = np.zeros((LABELS + 1, LABELS), dtype=bool)  # row LABELS: the start of a stretch
for _i in range(len(KINDS)):
    _BARRED[:, 2 + 2 * _i] = True
    _BARRED[[1 + 2 * _i, 2 + 2 * _i], 2 + 2 * _i] = False


def stretches(text: str) -> Iterator[list[tuple[int, int]]]:
    """Neighbouring words with a digit or ``@``, as spans."""
    run: list[tuple[int, int]] = []
    at = 0
    while m := _SIGNAL.search(text, at):
        start = m.start()
        while start > at and not text[start - 1].isspace():
            start -= 1
        end = m.end()
        while end < len(text) and not text[end].isspace():
            end += 1
        if run and text[run[-1][1]:start].strip():
            yield run
            run = []
        run.append((start, end))
        at = end
    if run:
        yield run


_RUNS = ((re.compile(r"[a-z]+"), "x"), (re.compile(r"[A-Z]+"), "X"), (re.compile(r"[^\x00-\x7f]+"), "u"))


def _shapes(word: str) -> tuple[str, str]:
    for pattern, sign in _RUNS:
        word = pattern.sub(sign, word)
    return re.sub(r"[0-9]+", lambda m: f"d{min(len(m.group()), 20)}", word), re.sub(r"[0-9]+", "d", word)


_known_shapes = functools.lru_cache(maxsize=1 << 14)(_shapes)


def shapes(word: str) -> tuple[str, str]:
    """Shape with the length of each run of digits, and without it; long words are not remembered."""
    return _known_shapes(word) if len(word) <= 64 else _shapes(word)


def _neighbour(text: str, at: int, step: int) -> str:
    """The whole word that ends before ``at`` (step -1) or begins at or after it (step 1); empty if none."""
    if step < 0:
        end = at
        while end > 0 and text[end - 1].isspace():
            end -= 1
        start = end
        while start > 0 and not text[start - 1].isspace():
            start -= 1
        return text[start:end]
    start = at
    while start < len(text) and text[start].isspace():
        start += 1
    end = start
    while end < len(text) and not text[end].isspace():
        end += 1
    return text[start:end]


def features(text: str, run: list[tuple[int, int]]) -> list[list[int]]:
    """Hashed features of each whole word of a stretch: its shape and that of its neighbours."""
    before, after = _neighbour(text, run[0][0], -1), _neighbour(text, run[-1][1], 1)
    words = [before or "^", *[text[a:b] for a, b in run], after or "$"]
    out = []
    for i in range(1, len(words) - 1):
        word = words[i]
        full, short = shapes(word)
        number = _DIGITS.sub("", word)
        digits = len(number)
        names = (
            "bias", f"f{full}", f"s{short}", f"a{word[0]}", f"z{word[-1]}", f"n{min(len(word), 24)}", f"d{min(digits, 20)}",
            f"@{word.count('@')}", f".{min(word.count('.'), 4)}", f"p{shapes(words[i - 1])[0]}", f"q{shapes(words[i + 1])[0]}",
            f"l{_luhn(number) if 13 <= digits <= 19 else None}", f"c{words[i - 1].lower().strip('.,:;=')}",
        )
        out.append([zlib.crc32(x.encode()) % FEATURES for x in names])
    return out


def _padded(runs: list[list[list[int]]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(r) for r in runs])
    wide = len(runs[0][0])
    out = np.zeros((len(runs), sizes.max(), wide), dtype=np.int64)
    for i, r in enumerate(runs):
        out[i, :len(r)] = r
    return out, sizes


def viterbi(scores: np.ndarray, sizes: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best label paths of padded stretches: scores (stretch, word, label)."""
    n, length, _ = scores.shape
    best = moves[LABELS] + scores[:, 0]
    back = np.zeros((n, length, LABELS), dtype=np.int8)
    for t in range(1, length):
        ways = best[:, :, None] + moves[None, :LABELS]
        back[:, t] = ways.argmax(axis=1)
        step = ways.max(axis=1) + scores[:, t]
        best = np.where((t < sizes)[:, None], step, best)
    path = np.zeros((n, length), dtype=np.int8)
    label = best.argmax(axis=1).astype(np.int8)
    for t in range(length - 1, -1, -1):
        path[:, t] = label
        came = back[np.arange(n), t, label]
        label = np.where((t < sizes) & (t > 0), came, label)
    return path


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def fit(rows: list[tuple[str, list[tuple[str, int, int]]]]) -> tuple[np.ndarray, np.ndarray]:
    """Weights (feature, label) and moves (label before, label) from labelled texts."""
    if len(rows) > MOST_LABELLED:
        raise ValueError(f"more than {MOST_LABELLED} labelled rows")
    runs, paths = [], []
    for text, spans in rows:
        for run in stretches(text):
            path = []
            for a, b in run:
                kind = next((k for k, s, e in spans if a < e and s < b), None)
                started = kind is not None and any(s <= a and a > s for k, s, e in spans if k == kind and a < e and s < b)
                path.append(0 if kind is None else 1 + 2 * KINDS.index(kind) + started)
            runs.append(features(text, run))
            paths.append(path)
    weights, moves = np.zeros((FEATURES, LABELS)), np.where(_BARRED, -1e4, 0.0)
    if not runs:
        weights[:, 0] = 1.0
        return weights.astype(np.float32), moves
    x, sizes = _padded(runs)
    y = np.zeros(x.shape[:2], dtype=np.int64)
    for i, p in enumerate(paths):
        y[i, :len(p)] = p
    n, length, _ = x.shape
    there = np.arange(length)[None] < sizes[:, None]
    eye = np.eye(LABELS)
    last = sizes - 1
    grads = [np.zeros_like(weights), np.zeros_like(moves)]
    seen = [np.full_like(weights, 1e-6), np.full_like(moves, 1e-6)]
    for _ in range(ROUNDS):
        scores = weights[x].sum(axis=2)
        ahead = np.zeros((n, length, LABELS))
        ahead[:, 0] = moves[LABELS] + scores[:, 0]
        for t in range(1, length):
            ahead[:, t] = _logsum(ahead[:, t - 1, :, None] + moves[None, :LABELS], 1) + scores[:, t]
        behind = np.zeros((n, length, LABELS))
        for t in range(length - 2, -1, -1):
            step = _logsum(moves[None, :LABELS] + (scores[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
            behind[:, t] = np.where((t < last)[:, None], step, 0)
        total = _logsum(ahead[np.arange(n), last], 1)
        chance = np.exp(ahead + behind - total[:, None, None]) * there[:, :, None]
        error = (eye[y] - chance) * there[:, :, None]
        grads[0][:] = -1e-3 * weights
        for f in range(x.shape[2]):
            np.add.at(grads[0], x[:, :, f], error)
        grads[1][:] = 0
        grads[1][LABELS] = (eye[y[:, 0]] - chance[:, 0]).sum(axis=0)
        for t in range(1, length):
            on = there[:, t]
            pair = ahead[:, t - 1, :, None] + moves[None, :LABELS] + (scores[:, t] + behind[:, t])[:, None, :] - total[:, None, None]
            grads[1][:LABELS] -= np.exp(pair[on]).sum(axis=0)
            np.add.at(grads[1], (y[on, t - 1], y[on, t]), 1.0)
        for value, grad, square in zip((weights, moves), grads, seen, strict=True):
            square += grad**2
            value += 0.3 * grad / np.sqrt(square)
        moves[_BARRED] = -1e4
    return weights.astype(np.float32), moves


def labelled(seed: int = 7) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """The small labelled table: words around values of each kind, and around other numbers."""
    rng = random.Random(seed)

    def digits(n: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(n))

    def word() -> str:
        return "".join(rng.choice("abcdefghilmnorstuv") for _ in range(rng.randint(2, 9)))

    def number() -> str:  # as long as a card's, but not one
        return next(x for x in iter(lambda: digits(16), "") if not _luhn(x))

    def card(shape: str) -> str:
        body = digits(15)
        full = next(body + c for c in "0123456789" if _luhn(body + c))
        return shape.join(full[i:i + 4] for i in range(0, 16, 4)) if shape else full

    made = {
        "email": lambda: f"{word()}{rng.choice(['.', '', digits(2)])}{word()}@{word()}.{rng.choice(['com', 'org', 'example.net'])}",
        "ip": lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        "card": lambda: card(rng.choice(["", " ", "-"])),
        "phone": lambda: rng.choice([
            f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}",
            f"+{digits(2)} {digits(3)} {digits(3)} {digits(3)}", f"{digits(3)}-{digits(3)}-{digits(4)}",
        ]),
    }
    other = [
        lambda: str(rng.randint(1, 9999)), lambda: f"{rng.randint(1900, 2030)}", lambda: f"{rng.randint(1, 99)}.{rng.randint(0, 99)}",
        lambda: f"{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 40)}", lambda: f"20{digits(2)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}",
        lambda: f"{rng.randint(10, 23)}:{digits(2)}", lambda: f"\"{''.join(rng.choice('0123456789abcdef') for _ in range(40))}\"",
        lambda: f"{word()}{digits(2)}", lambda: f"${digits(3)}.{digits(2)}", lambda: f"#{digits(5)}", lambda: f"{digits(12)}",
        lambda: f"{digits(3)},{digits(3)},{digits(3)}", lambda: f"@{word()}", lambda: f"{word()}[{digits(1)}]", lambda: f"{digits(2)}%",
        lambda: f"({digits(2)})", lambda: f"{digits(1)} {digits(1)} {digits(2)}", number, number, lambda: f"{digits(4)} {digits(3)}",
        lambda: f"{digits(3)}-{digits(2)}-{digits(3)}-{digits(5)}-{digits(1)}", lambda: f"{''.join(rng.choice('0123456789abcdef') for _ in range(8))}-{digits(4)}-{digits(4)}",
    ]
    out = []
    for _ in range(90):
        for kind, make in [*made.items(), *[(None, o) for o in rng.sample(other, 9)]]:
            lead = " ".join(word() for _ in range(rng.randint(1, 4)))
            value, tail = make(), rng.choice(["", ".", ",", ""])
            text = f"{lead} {value}{tail} {word()} {word()}"
            out.append((text, [(kind, len(lead) + 1, len(lead) + 1 + len(value))] if kind else []))
    return out


@functools.lru_cache(maxsize=4)
def default_model() -> tuple[np.ndarray, np.ndarray]:
    return fit(labelled())


def model_of(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The field trained on a labelled table (text, spans array<struct<kind, start, end>>)."""
    found = rows.select("text", "spans").limit(MOST_LABELLED + 1).collect()
    return fit([(r["text"], [(s["kind"], s["start"], s["end"]) for s in r["spans"] or []]) for r in found if r["text"]])


def decode(runs: list[list[list[int]]], model: tuple[np.ndarray, np.ndarray]) -> list[list[int]]:
    """Labels of stretches, in batches of similar length."""
    weights, moves = model
    out: list = [None] * len(runs)
    order = sorted(range(len(runs)), key=lambda i: len(runs[i]))
    low = 0
    while low < len(order):
        size = len(runs[order[low]])
        high = low
        while high < len(order) and len(runs[order[high]]) <= 2 * size and (high - low) * len(runs[order[high]]) < 50_000:
            high += 1
        high = max(high, low + 1)
        x, sizes = _padded([runs[i] for i in order[low:high]])
        scores = np.zeros((*x.shape[:2], LABELS), dtype=np.float32)
        for f in range(x.shape[2]):
            scores += weights[x[:, :, f]]
        for i, path, n in zip(order[low:high], viterbi(scores, sizes, moves), sizes, strict=True):
            out[i] = path[:n].tolist()
        low = high
    return out


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    while start < end and not (text[start].isalnum() or text[start] in "+("):
        start += 1
    while end > start and not text[end - 1].isalnum():
        end -= 1
    return start, end


def all_spans(texts: list[str], model: tuple[np.ndarray, np.ndarray]) -> list[list[tuple[int, int, int, bool]]]:
    """(kind, start, end, by a rule) of each text, sorted by kind and start."""
    base = [base_spans(t) for t in texts]
    runs, owners = [], []
    for i, text in enumerate(texts):
        for run in stretches(text):
            if not all(any(s <= a and b <= e for _, s, e in base[i]) for a, b in run) if len(base[i]) < 50 else True:
                runs.append(features(text, run))
                owners.append((i, run))
    out = [[(k, s, e, True) for k, s, e in spans] for spans in base]
    for (i, run), path in zip(owners, decode(runs, model), strict=True):
        at = 0
        taken = sorted((s, e) for _, s, e in base[i])
        while at < len(path):
            label, first = path[at], at
            at += 1
            if label == 0:
                continue
            while at < len(path) and path[at] == 2 * ((label - 1) // 2) + 2:
                at += 1
            start, end = _trimmed(texts[i], run[first][0], run[at - 1][1])
            if start < end and not _overlaps(taken, start, end):
                out[i].append(((label - 1) // 2, start, end, False))
    return [sorted(spans) for spans in out]


def _overlaps(taken: list[tuple[int, int]], start: int, end: int) -> bool:
    return any(s < end and start < e for s, e in taken)


def _steps(part: pa.RecordBatch, column: int, size: int = 1 << 21) -> Iterator[tuple[int, list[str]]]:
    """Texts of a batch, by about ``size`` characters."""
    first, held, chars = 0, [], 0
    for i, text in enumerate(part.column(column).to_pylist()):
        held.append(text or "")
        chars += len(held[-1])
        if chars >= size:
            yield first, held
            first, held, chars = i + 1, [], 0
    if held:
        yield first, held


def find(df: DataFrame, model: tuple[np.ndarray, np.ndarray] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, spans (kind, start, end, base)."""
    shared = df.sparkSession.sparkContext.broadcast(model or default_model())
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(span))])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in few(parts):
            for first, texts in _steps(part, 1):
                found = [
                    [{"kind": KINDS[k], "start": s, "end": e, "base": b} for k, s, e, b in spans]
                    for spans in all_spans(texts, shared.value)
                ]
                yield pa.RecordBatch.from_arrays([part.column(0).slice(first, len(texts)), pa.array(found, schema.field(1).type)], schema=schema)

    rows = pick(df, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>")


def masked(text: str, spans: list[tuple[int, int, int, bool]]) -> str:
    """Text with every span replaced by its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    for kind, start, end, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind]}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(df: DataFrame, model: tuple[np.ndarray, np.ndarray] | None = None, text: str = "text") -> DataFrame:
    """The rows of ``df`` with personal data in ``text`` replaced by its kind; null stays null."""
    shared = df.sparkSession.sparkContext.broadcast(model or default_model())
    at = df.columns.index(text)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in few(parts):
            for first, texts in _steps(part, at):
                own = part.slice(first, len(texts))
                clean = [masked(t, s) if s else t for t, s in zip(texts, all_spans(texts, shared.value), strict=True)]
                clean = [None if was is None else t for was, t in zip(own.column(at).to_pylist(), clean, strict=True)]
                yield own.set_column(at, own.schema.field(at).name, pa.array(clean, pa.string()))

    return df.mapInArrow(run, df.schema)


def _told(spans) -> object:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query("op8_pii")
def op8_pii(spark: SparkSession, directory: str) -> DataFrame:
    """Personal data in every whole text: counts of the rules' spans, and all spans."""
    done = find(table(spark, directory, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    found = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(found) - F.size(F.array_remove(found, kind))).cast("bigint").alias(f"n_{kind}") for kind in KINDS]
    return done.select("doc_id", *counts, F.sha2(_told(base), 256).alias("base_sha256"), _told(F.col("spans")).alias("spans"))
