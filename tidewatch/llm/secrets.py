"""Secret scan: candidate strings, and a random forest that removes false positives.

Candidates, whatever their length and characters, are: values after an assignment (``=``, ``:``
and the like; up to the closing quote, or to a blank or separator), words that begin within NEAR
characters after a cue (password, token, ...), and the password of ``scheme://user:password@host``.
Without any of these, a run of at least SHORTEST characters of ``A-Za-z0-9_+/=.-`` with a digit
and a letter is one. Candidates can lie in each other (``a=b=c`` has two values).

The forest looks at a candidate's length, character classes and transitions between
them, entropy, dictionary coverage (letter pairs common in words), shape (hexadecimal, path,
version, dated, dashed, a placeholder) and at the 40 characters before it, not after it. It is trained on a small table of labelled
findings (``labelled``: at most MOST_LABELLED rows, made from templates with a fixed seed; any
rows of that form can be given instead): extremely randomised trees over bootstrap samples.

Spans are in code points, end exclusive. Defined results: a null text counts as empty and has no
candidates; repeated rows give repeated results; extra columns are ignored; an empty table gives
an empty table.
"""

from __future__ import annotations

import functools
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.text import pick
from tidewatch.plans.registry import query
from tidewatch.session import table

#: Least length of a run that nothing points at, reach of a cue, most labelled rows.
SHORTEST, NEAR, MOST_LABELLED = 16, 40, 5_000
TREES, DEPTH, LEAST_LEAF, TRIES = 48, 8, 3, 8

_DIGIT = re.compile(r"[0-9]")
_NOT_RUN = re.compile(r"[^A-Za-z0-9_+/=.\-]")
_CUE = re.compile(r"(?i)(token|secret|passw|pwd|api.?key|access.?key|auth(?!or(?!i[sz]))|bearer|credential|private.?key|signature)")
_ASSIGN = re.compile(r"[=:]\s*[\"']?$")
_INNOCENT = re.compile(r"(?i)(commit|sha|md5|hash|digest|checksum|uuid|guid|revision|rev|build|version|etag|file|path|url|id)\W*$")
_NAMED = re.compile(_CUE.pattern + r"[\w\-]*[\"'`\])\\]*(\s*[=:]+>?\s*|\s+((is|was|are|to|of|as|set|be)\s+)*)[\[({]*[\"'`\\]*$")
_LOGIN = re.compile(r"://[^\s/:@\"'<>]*:(?:([^\s/\"'<>]+)@|((?:(?!://)[^\s\"'<>])+?)@)")
_IN_LOGIN = re.compile(r"://[^\s/:@]*:$")
_PLACEHOLDER = re.compile(r"(?i)(null|none|nil|true|false|undefined|required|optional|str|string|text|varchar.*|\*+|x+|\.+|[$%]?\{.*|<.*|\$\w+|(os|process|self|config|request|settings)\..*|\w+\(.*)")
_OPERATOR = re.compile(r"[=:]+>?")
_OPEN = re.compile(r"\s*[\[({]*\s*(?:[A-Za-z]{0,2}(?=[\"'`]))?")
_QUOTE = re.compile(r"\\*[\"'`]")
_VALUE_END = re.compile(r"[\s\"'`<>,;&]|$")
_WORD = re.compile(r"[^\s\"'`<>,;&()\[\]{}=:]+=*")
_SOUND = re.compile(r"[^\W_]")
#: Letter pairs that are common inside words of European languages.
_PAIRS = frozenset(
    "th he in er an re nd on en at ou ed ha to or it is hi es ng st ar te se me sa le no ea ti ve of nt al de la el os as ra co ci do "
    "ch ei ie un ge be sc au ue io qu ai li mo pa il et em us ur om ta ro ma si ca tr di lo ll so fo we wa ow my".split()
)


def runs(text: str) -> list[tuple[int, int]]:
    """Spans of long runs with a digit and a letter."""
    if not _DIGIT.search(text):
        return []
    out = []
    at = 0
    while m := _DIGIT.search(text, at):  # only runs with a digit are looked at, each once
        start = m.start()
        while start > at and _NOT_RUN.match(text[start - 1]) is None:
            start -= 1
        stop = _NOT_RUN.search(text, m.end())
        end = stop.start() if stop else len(text)
        at = end
        while start < end and text[start] in "=./-+":
            start += 1
        while end > start and text[end - 1] in "./-":
            end -= 1
        body = text[start:end]
        if "=" in body.rstrip("="):  # name=value
            start = start + body.rstrip("=").rindex("=") + 1
        if end - start >= SHORTEST and re.search(r"[A-Za-z]", text[start:end]):
            out.append((start, end))
    return out


def values(text: str) -> list[tuple[int, int]]:
    """Spans of the values after assignments and of passwords in addresses."""
    login = {m.start(k): m.end(k) for m in _LOGIN.finditer(text) for k in (1, 2) if m[k]}
    out = []
    word_end = line_end = -1  # of the last value; one that begins before it ends there, too
    for m in _OPERATOR.finditer(text):
        if m[0][-1] == ":" and text.startswith("//", m.end()):  # the scheme of an address
            continue
        start = _OPEN.match(text, m.end()).end()
        if start in login:
            out.append((start, login[start]))
            continue
        if quote := _QUOTE.match(text, start):
            start = quote.end()
            if start > line_end:
                line_end = text.find("\n", start)
                line_end = len(text) if line_end < 0 else line_end
            close = text.find(quote[0], start, line_end)
            if close >= 0:
                out.append((start, close))
                continue
        if start >= word_end:
            word_end = _VALUE_END.search(text, start).start()
        end = word_end
        while end > start and text[end - 1] in ".,:!?)]}\\":
            end -= 1
        out.append((start, end))
    return out


def near_cues(text: str) -> list[tuple[int, int]]:
    """Spans of the words that begin within NEAR characters after a cue."""
    out = []
    at = 0
    for m in _CUE.finditer(text):
        at = max(at, m.end())
        while at > 0 and (text[at - 1].isalnum() or text[at - 1] in "_-") and at < len(text) and (text[at].isalnum() or text[at] in "_-"):
            at += 1  # the rest of the cue's own name
        while (word := _WORD.search(text, at)) and word.start() <= m.end() + NEAR:
            start, at = word.span()
            end = at
            while start < end and text[start] in "./-+":
                start += 1
            while end > start and text[end - 1] in "./-!?:\\":
                end -= 1
            out.append((start, end))
    return out


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans of possible secrets."""
    found: dict[tuple[int, int], tuple[int, int]] = {}
    for spans in (values(text), near_cues(text), runs(text)):
        first = -1
        for start, end in sorted(spans):
            if start > first:  # the first letter or digit from here on
                sound = _SOUND.search(text, start)
                first = sound.start() if sound else len(text)
            last = end
            while last > first and not text[last - 1].isalnum():
                last -= 1
            if first < last:  # spans that differ in signs around them are one
                found.setdefault((first, last), (start, end))
    return sorted(set(found.values()))


FEATURES = (
    "length", "digits", "upper", "lower", "symbols", "transitions", "entropy", "pairs", "longest_letters", "hex", "slashes", "dots",
    "dashes", "cue", "assigned", "innocent", "quoted", "distinct", "vowels", "uuid",
    "named", "login", "placeholder",
)


def features(text: str, start: int, end: int) -> list[float]:
    """Numbers the forest decides on, from the whole candidate and what stands before it."""
    word, before = text[start:end], text[max(0, start - 40):start]
    n = len(word)
    kinds = "".join("d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in word)
    counts = Counter(word)
    letters = word.lower()
    pairs = sum(letters[i:i + 2] in _PAIRS for i in range(n - 1))
    letter_runs = [len(r) for r in re.findall(r"[A-Za-z]+", word)] or [0]
    return [
        end - start, kinds.count("d") / n, kinds.count("u") / n, kinds.count("l") / n, kinds.count("s") / n,
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n, -sum(c / n * math.log2(c / n) for c in counts.values()), pairs / n,
        max(letter_runs), float(all(c in "0123456789abcdefABCDEF" for c in word)), word.count("/"), word.count("."), word.count("-"),
        float(bool(_CUE.search(before + word))), float(bool(_ASSIGN.search(before))), float(bool(_INNOCENT.search(before.rstrip("\"'=: ")))),
        float(before[-1:] in ("'", '"')), len(counts) / n, sum(c in "aeiou" for c in letters) / n,
        float(bool(re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", word))),
        float(bool(_NAMED.search(before))), float(bool(_IN_LOGIN.search(before))), float(bool(_PLACEHOLDER.fullmatch(word))),
    ]


class Forest:
    """Trees as arrays: feature (-1: leaf), threshold, left and right node, share of secrets."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.trees = []
        for _ in range(TREES):
            at = rng.integers(0, len(x), len(x))
            nodes: list[list[float]] = []
            self._grow(x[at], y[at], 0, nodes, rng)
            self.trees.append(np.array(nodes))

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, nodes: list, rng: np.random.Generator) -> int:
        number = len(nodes)
        nodes.append([-1, 0, -1, -1, float(y.mean())])
        if depth == DEPTH or len(y) < 2 * LEAST_LEAF or y.min() == y.max():
            return number
        best = None
        for f in rng.integers(0, x.shape[1], TRIES):
            low, high = x[:, f].min(), x[:, f].max()
            if low == high:
                continue
            cut = rng.uniform(low, high)
            left = x[:, f] <= cut
            n = left.sum()
            if min(n, len(y) - n) < LEAST_LEAF:
                continue
            a, b = y[left].mean(), y[~left].mean()
            impurity = n * a * (1 - a) + (len(y) - n) * b * (1 - b)
            if best is None or impurity < best[0]:
                best = impurity, f, cut, left
        if best:
            _, f, cut, left = best
            nodes[number][:2] = [f, cut]
            nodes[number][2] = self._grow(x[left], y[left], depth + 1, nodes, rng)
            nodes[number][3] = self._grow(x[~left], y[~left], depth + 1, nodes, rng)
        return number

    def score(self, x: np.ndarray) -> np.ndarray:
        """Mean share of secrets over the trees."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for tree in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                f = tree[at, 0].astype(np.int64)
                inner = f >= 0
                if not inner.any():
                    break
                left = x[rows, np.maximum(f, 0)] <= tree[at, 1]
                at = np.where(inner, np.where(left, tree[at, 2], tree[at, 3]), at).astype(np.int64)
            total += tree[at, 4]
        return total / len(self.trees)


def labelled(seed: int = 5) -> list[tuple[str, int]]:
    """The small table of labelled findings: (text with one candidate, 1 if it is a secret)."""
    rng = random.Random(seed)

    def chars(alphabet: str, n: int) -> str:
        return "".join(rng.choice(alphabet) for _ in range(n))

    hexa, upper, lower, digit = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    mixed = upper + lower + digit

    def words(n: int, sign: str = " ") -> str:
        return sign.join("".join(rng.choice(["th", "er", "on", "an", "re", "en", "de", "la", "ti", "or", "ei", "ch"]) for _ in range(rng.randint(1, 4))) for _ in range(n))

    cue = ["token", "secret", "password", "api_key", "access_key", "auth_token", "client_secret", "bearer"]
    calm = ["commit", "sha256", "md5", "checksum", "revision", "uuid", "build", "digest", "file", "etag"]
    sure = [
        lambda: f"{rng.choice(cue)} = \"{chars(hexa, rng.choice([32, 40, 40, 64]))}\"",
        lambda: f"{rng.choice(cue)}={chars(mixed, rng.randint(20, 48))}", lambda: f"{rng.choice(cue)}: '{chars(mixed + '+/', 40)}'",
        lambda: f"AKIA{chars(upper + digit, 16)}", lambda: f"ghp_{chars(mixed, 36)}", lambda: f"sk_live_{chars(mixed, 24)}",
        lambda: f"xoxb-{chars(digit, 11)}-{chars(mixed, 24)}", lambda: f"Authorization: Bearer {chars(mixed + '-_', 40)}",
        lambda: f"eyJ{chars(mixed, 30)}.eyJ{chars(mixed, 40)}.{chars(mixed + '-_', 43)}",
    ]
    not_one = [
        lambda: f"{rng.choice(calm)} {chars(hexa, rng.choice([32, 40, 64]))}", lambda: f"{rng.choice(calm)}: {chars(hexa, 40)}",
        lambda: f"{chars(hexa, 8)}-{chars(hexa, 4)}-{chars(hexa, 4)}-{chars(hexa, 4)}-{chars(hexa, 12)}",
        lambda: f"/usr/{words(1)}/{words(2, '/')}{rng.randint(1, 99)}/{words(1)}.txt", lambda: f"www.{words(1)}.example.com/{words(2, '-')}-{rng.randint(1, 999)}",
        lambda: f"{words(3, '_')}_{rng.randint(1, 99)}", lambda: f"{words(3, '-')}-20{chars(digit, 2)}-10-{chars(digit, 2)}", lambda: f"{words(2, '')}{words(2, '')}{rng.randint(1, 9)}",
        lambda: f"{words(1)}-{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 20)}-{words(1)}-{words(1)}.jar", lambda: f"20{chars(digit, 2)}-10-{chars(digit, 2)}T{chars(digit, 2)}:00", lambda: f"{chars(hexa, 40)}",
        lambda: f"{chars(digit, 2)}@mail{chars(digit, 1)}.example.com", lambda: f"{words(2, '.')}.{chars(digit, 2)}.{words(2, '.')}",
    ]
    # short ones, and ones of letters or digits alone: known by the name or address they stand in
    strong, sign = ["password", "passwd", "pwd", "db_password", "secret", "api_key", "access_token", "auth_token", "PASSWORD"], ["=", " = ", ": ", ":", " => "]
    tame = ["name", "title", "lang", "port", "color", "year", "note", "author", "size", "host", "user", "level", "city", "time"]

    def short() -> str:
        return rng.choice([
            lambda: chars(mixed, rng.randint(6, 15)), lambda: chars(mixed + "!#$%*?", rng.randint(8, 15)), lambda: chars(lower, rng.randint(6, 32)),
            lambda: chars(digit, rng.randint(5, 24)), lambda: words(1) + chars(digit, rng.randint(1, 4)), lambda: words(rng.randint(1, 2), ""), lambda: chars(upper, rng.randint(8, 24)),
        ])()

    def quoted(body: str) -> str:
        return rng.choice(["{}", '"{}"', "'{}'"]).format(body)

    sure_short = [
        *[lambda: f"{rng.choice(strong)}{rng.choice(sign)}{quoted(short())}"] * 4, lambda: f"\"{rng.choice(strong)}\": \"{short()}\"",
        lambda: f"{rng.choice(strong)} = \"{words(rng.randint(3, 5))}\"",
        *[lambda: f"{rng.choice(['postgres', 'https', 'redis', 'amqp'])}://{rng.choice(['u', 'app', 'root', ''])}:{short().strip('#?')}@host"] * 2,
        lambda: f"password {rng.choice(['is', 'was', 'set to'])} {chars(mixed, rng.randint(8, 15))}{rng.choice(digit)}",
        *[lambda: f"{rng.choice(['password', 'pwd', 'token', 'secret'])} {rng.choice(['is', 'was', 'set to'])} {words(1)}{chars(digit, rng.randint(1, 3))}{chars(lower, rng.randint(0, 3))}"] * 2,
    ]
    not_short = [
        *[lambda: f"{rng.choice(tame)}{rng.choice(sign)}{quoted(words(1))}", lambda: f"{rng.choice(tame)}{rng.choice(sign)}{quoted(words(1).capitalize())}"] * 2, lambda: f"{rng.choice(tame)}{rng.choice(sign)}{quoted(chars(digit, rng.randint(1, 6)))}",
        lambda: f"{rng.choice(tame)}: \"{words(rng.randint(2, 6))}\"", lambda: f"\"{rng.choice(tame)}\": \"{words(1)}{chars(digit, 2)}\"",
        lambda: f"{chars(digit, 2)}:{chars(digit, 2)}", lambda: f"color: #{chars(hexa, 6)}", lambda: f"{rng.choice(tame)}=20{chars(digit, 2)}-10-{chars(digit, 2)}",
        lambda: f"{rng.choice(strong)}{rng.choice(sign)}{rng.choice(['null', 'None', 'true', 'false', 'string', '${SECRET}', 'os.environ', '********', 'required', 'getpass()', '<secret>'])}",
        *[lambda: f"the {rng.choice(['password', 'token', 'secret', 'signature', 'credentials'])} {words(rng.randint(2, 5))}"] * 3,
        lambda: f"https://www.{words(1)}.com:80{chars(digit, 2)}/{words(1)}",
    ]
    out = []
    for label, made in ((1, sure), (0, not_one)):
        for make in made:
            out += [(f"{words(rng.randint(0, 3))} {make()} {words(2)}", label) for _ in range(40)]
    for label, made in ((1, sure_short), (0, not_short)):
        for make in made:
            out += [(f"{words(rng.randint(0, 3))} {make()}", label) for _ in range(80)]
    return out


def fit(rows: list[tuple[str, int]]) -> Forest:
    """A forest from labelled findings; a row's label is that of its longest candidate."""
    if len(rows) > MOST_LABELLED:
        raise ValueError(f"more than {MOST_LABELLED} labelled rows")
    x, y = [], []
    for text, label in rows:
        spans = candidates(text)
        if spans:
            start, end = max(spans, key=lambda s: s[1] - s[0])
            x.append(features(text, start, end))
            y.append(label)
    return Forest(np.array(x), np.array(y, dtype=float))


@functools.lru_cache(maxsize=2)
def default_model() -> Forest:
    return fit(labelled())


def scan(df: DataFrame, model: Forest | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, candidates (start, end, score)."""
    shared = df.sparkSession.sparkContext.broadcast((model or default_model()).trees)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
    schema = pa.schema([("doc_id", pa.int64()), ("candidates", pa.list_(span))])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest.__new__(Forest)
        forest.trees = shared.value
        for part in parts:
            x, where, found = [], [], []
            for i, body in enumerate(part.column(1).to_pylist()):
                found.append([])
                for start, end in candidates(body or ""):
                    x.append(features(body, start, end))
                    where.append((i, start, end))
            scores = forest.score(np.array(x)).tolist() if x else []
            for (i, start, end), score in zip(where, scores, strict=True):
                found[i].append({"start": start, "end": end, "score": score})
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, schema.field(1).type)], schema=schema)

    rows = pick(df, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return rows.mapInArrow(run, "doc_id long, candidates array<struct<start:long,end:long,score:double>>")


@query("op10_secret_scan")
def op10_secret_scan(spark: SparkSession, directory: str) -> DataFrame:
    """Candidates of every whole text, and the spans the forest keeps as secrets."""
    done = scan(table(spark, directory, "documents"))
    kept = F.filter("candidates", lambda c: c["score"] >= 0.5)
    return done.select(
        "doc_id", F.size("candidates").cast("bigint").alias("n_candidates"), F.size(kept).cast("bigint").alias("n_secrets"),
        F.array_join(F.transform(kept, lambda c: F.concat_ws(":", c["start"].cast("string"), c["end"].cast("string"))), ",").alias("secrets"),
    )
