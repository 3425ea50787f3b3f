r"""Personal data: base patterns, then a skip-chain conditional random field.

Base spans come from four patterns and their conditions.  The field then labels
a text's other tokens: every number group of four digits or more, dotted numbers
and everything that looks like an address, also where it is bracketed, spaced or
spelled out: ``joe (at) mail dot test``, ``10[.]0[.]0[.]1``, ``564 555 4526``.
Its factors are

    node: features of the token's shape and of what stands around it,
    chain: the labels of neighbouring tokens,
    skip: the labels of tokens that repeat, or whose digits end alike or
    whose letters and digits are the same, however far apart they stand.

Loopy sum-product message passing gives marginals; tokens that base spans of the
kind cover are observed.  Where another token's most probable label is a kind of
personal data with at least ``CERTAIN``, its span is added.

Skip edges go from each token to an observed one of the same key, the last before
it or else the first after it; where none is observed, to the one before of the
key.  So what is observed reaches every repeat in one step and repeats do not
outvote it, and a token that occurs a thousand times makes a thousand edges a key
and not a million.  Messages pass until they no longer change; the bound on rounds
grows with the tokens, so that it cuts off no evidence.

All weights are fitted together, by the field's own likelihood: its gradient is
the difference of what message passing expects with and without the labels.  The
sample is bounded: tokens of a text are cut into runs of at most ``RUN`` tokens
and the ``TRAIN_RUNS`` different runs of least hash are taken, of texts of any
length.  Labels are the base spans.  An unlabelled token that is like a labelled
one is hidden, not a counterexample.  In copies of the runs labelled tokens are
rewritten, or repeated in other writing, so that the field knows such forms.

Finding is linear in the text: runs of characters are taken whole, never rescanned.

Cases: null and empty texts have no spans; tokens of a text are as many as it
has; very long tokens and digit runs take time in proportion; repeated rows are
labelled alike; without labelled tokens in the sample nothing is added; offsets
count code points; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed: kinds in their order; label 0 is none of them.
KINDS = ("email", "ip", "card", "phone")
TRAIN_RUNS, RUN = 2000, 48
CERTAIN = 0.9
#: Bound of the rounds of message passing, besides two a token.
ROUNDS = 12
DAMPING = 0.3
#: Steps of training, rounds of messages in each, and their rate.
STEPS, STEP_ROUNDS, RATE, DECAY = 150, 4, 0.1, 1e-3
#: Digits in which two numbers must end alike to be similar.
SAME_TAIL = 7
#: Fewest digits of a number group, and from how many on it never goes on after a space.
LEAST_DIGITS, ALONE_DIGITS, MOST_DIGITS = 4, 9, 19
SEED = 5

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_NO_DIGIT = re.compile("[^0-9]+")
_DOTTED = re.compile("[0-9][0-9.]*")
_SPACED = re.compile(r"[0-9][0-9\x20-]*[0-9]")
_TWO_BREAKS = re.compile(r"[\x20-]{2,}")

#: Number groups across brackets, single separators and dots spelled out.
_DOT = r"\x20?[\[(](?:\.|dot)[\])]\x20?|\x20\.\x20"
_NUMBER = re.compile(rf"\+?\(?[0-9]+(?:(?:{_DOT}|[\x20()./-]{{1,2}})[0-9]+)*+")
#: At signs as they are written, and domains after them.
_AT = re.compile(r"@|[\[({<]\x20?at\x20?[\])}>]|(?<=[A-Za-z0-9])\x20at(?=\x20(?!(?:the|an?|this|that)\x20)[A-Za-z0-9-]+(?:\x20dot\x20|\x20?[\[({]dot[\])}]))", re.I)
_HOST = re.compile(r"[A-Za-z0-9-]++(?:(?:\.|\x20?[\[({]\x20?(?:dot|\.)\x20?[\])}]\x20?|\x20dot\x20|\x20\.\x20)[A-Za-z0-9-]+)*+", re.I)
_DOT_WORD = re.compile(r"\x20?[\[({]\x20?(?:dot|\.)\x20?[\])}]\x20?|\x20dot\x20|\x20\.\x20", re.I)


def only_digits(s: str) -> str:
    return _NO_DIGIT.sub("", s)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _local_start(text: str, at: int, free: int) -> int:
    """Where the run of local-part characters that ends at ``at`` begins, not before ``free``."""
    size = 64
    while True:
        lo = max(free, at - size)
        left = len(text[lo:at].rstrip(_LOCAL))
        if left or lo == free:
            return lo + left
        size *= 4


def _emails(text: str):
    """Matches of the email pattern: each at sign with the longest local part before it."""
    at, free = text.find("@"), 0
    while at >= 0:
        nxt = at + 1
        if (m := _DOMAIN.match(text, nxt)) and (lo := _local_start(text, at, free)) < at:
            yield lo, m.end()
            nxt = free = m.end()
        at = text.find("@", nxt)


def _addresses(text: str):
    """Matches of the ip pattern: of dotted numbers every four in turn."""
    for m in _DOTTED.finditer(text):
        if m.group().count(".") < 3:
            continue
        at = m.start()
        groups: list[tuple[int, str]] = []
        for group in [*m.group().split("."), ""]:
            if group:
                groups.append((at, group))
            if len(groups) == 4 or not group:
                if len(groups) == 4 and all(_byte(g) for _, g in groups):
                    yield groups[0][0], groups[3][0] + len(groups[3][1])
                groups = []
            at += len(group) + 1


def _cards(text: str):
    """Matches of the card pattern: digits with single spaces or hyphens between them."""
    for m in _SPACED.finditer(text):
        if m.end() - m.start() < 14:
            continue
        at, whole = m.start(), m.group()
        for gap in [*_TWO_BREAKS.finditer(whole), None]:
            end = m.end() if gap is None else m.start() + gap.start()
            if 14 <= end - at <= 2 * MOST_DIGITS:
                digits = only_digits(text[at:end])
                if 14 <= len(digits) <= 19 and luhn(digits):
                    yield at, end
            at = end if gap is None else m.start() + gap.end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the base spans, in order."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        out += [(a, 1, b) for a, b in _addresses(text)]
        out += [(a, 2, b) for a, b in _cards(text)]
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(only_digits(m.group())) <= 15]
    return sorted(out)


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and int(part) <= 255)


@dataclass
class Token:
    start: int
    end: int
    text: str
    before: str  # the character before, and the word before that
    after: str
    word: str = ""


def _pieces(text: str, start: int, end: int):
    """A run of numbers cut at spaces: long groups stand alone, short ones go together up to a card's length."""
    lo, digits, at, last = start, 0, start, False
    for piece in text[start:end].split(" "):
        n = len(only_digits(piece))
        alone = n >= ALONE_DIGITS
        if digits and (alone or last or digits + n > MOST_DIGITS):
            yield lo, at - 1
            lo, digits = at, 0
        digits, last = digits + n, alone
        at += len(piece) + 1
    yield lo, end


def candidates(text: str) -> list[Token]:
    spans = []
    low = text.lower() if "@" not in text else ""
    if "@" in text or "at]" in low or "at)" in low or "at}" in low or "at>" in low or " dot " in low or "dot]" in low:
        free = 0
        for m in _AT.finditer(text):
            at = m.start() - (m.start() > free and text[m.start() - 1] == " ")
            nxt = m.end() + (text[m.end() : m.end() + 1] == " ")
            lo = _local_start(text, at, free) if at > free else at
            if lo < at and (host := _HOST.match(text, nxt)):
                spans.append((lo, host.end()))
                free = host.end()
    if _DIGIT.search(text):
        for m in _NUMBER.finditer(text):
            if m.end() - m.start() >= LEAST_DIGITS:
                whole = _DOT_WORD.search(m.group()) is not None
                for a, b in ([m.span()] if whole else _pieces(text, *m.span())):
                    s = text[a:b]
                    if len(only_digits(s)) >= LEAST_DIGITS or len(re.findall("[0-9]+", s)) >= 4:
                        spans.append((a, b))
    spans.sort()
    out: list[Token] = []
    for a, b in spans:
        if not out or a >= out[-1].end:
            lead = text[max(0, a - 24) : max(0, a - 1)].split()
            out.append(Token(a, b, text[a:b], text[a - 1 : a], text[b : b + 1], lead[-1].lower() if lead else ""))
    return out


def _address_like(t: str) -> bool:
    return _AT.search(t) is not None


WORD_BUCKETS = 16


def features(t: Token) -> np.ndarray:
    s = t.text
    digits = only_digits(s)
    n = len(digits)
    groups = re.findall("[0-9]+", s) if n <= 64 else [digits]
    has_at, dots = _address_like(s), len(re.findall(r"\.|dot", s, re.I)) if n <= 64 else 0
    quad = len(groups) == 4 and dots == 3 and not has_at and max(map(len, groups)) <= 3
    number = not has_at and not quad
    shape = [
        1.0, has_at, has_at and dots > 0, has_at and "@" in s, quad, quad and all(_byte(g) for g in groups),
        number and s.startswith("+"), number and "(" in s, number and n <= 6, number and 7 <= n <= 9, number and 10 <= n <= 11, number and 12 <= n <= 13, number and 14 <= n <= 19, n > 19,
        number and len(groups) == 1, number and len(groups) in (3, 4), number and "-" in s, number and " " in s, number and "." in s, number and 14 <= n <= 19 and luhn(digits),
        number and 10 <= n <= 15 and s.startswith("+"), number and 10 <= n <= 11 and len(groups) > 2, t.before.isalnum(), t.after.isalnum(), t.before != "" and t.before in "=:\"'", t.after != "" and t.after in "\"'",
    ]
    word = np.zeros(WORD_BUCKETS)
    if t.word:
        word[zlib.crc32(t.word.encode()) % WORD_BUCKETS] = 0.25
    return np.concatenate([np.array(shape, float), word])


def keys(t: Token) -> list[str]:
    """Keys by which tokens count as the same or alike."""
    digits = only_digits(t.text)
    if _address_like(t.text):
        return ["a" + re.sub("[^a-z0-9]", "", _DOT_WORD.sub(".", _AT.sub("@", t.text.lower())))]
    if len(groups := re.findall("[0-9]+", t.text)) == 4 and max(map(len, groups)) <= 3 and len(re.findall(r"\.|dot", t.text)) == 3:
        return ["d" + ".".join(groups)]
    return ["n" + digits, "t" + digits[-SAME_TAIL:]] if len(digits) > SAME_TAIL else ["n" + digits]


def skip_edges(tokens: list[Token], seen: list[int] | None = None) -> list[tuple[int, int]]:
    """Edges to the token before of the same key, or to an observed one where ``seen`` tells any of the key."""
    named = [keys(t) for t in tokens]
    told = {k for i, ks in enumerate(named) if seen and seen[i] for k in ks}
    last: dict[str, int] = {}
    known: dict[str, int] = {}
    waiting: dict[str, list[int]] = {}
    edges = set()
    for i, ks in enumerate(named):
        for k in ks:
            if k in last and told.isdisjoint(set(ks).intersection(named[last[k]])):
                edges.add((last[k], i))
            last[k] = i
            if seen and seen[i]:
                known[k] = i
                edges.update((j, i) for j in waiting.pop(k, ()))
            elif seen and k in known:
                edges.add((known[k], i))
            elif k in told:
                waiting.setdefault(k, []).append(i)
    return sorted(edges)


def observed(tokens: list[Token], base: list[tuple[int, int, int]]) -> list[int]:
    """Label of each token that a base span meets, else 0."""
    out, j = [0] * len(tokens), 0
    for i, t in enumerate(tokens):
        while j < len(base) and base[j][2] <= t.start:
            j += 1
        met = [k for a, k, b in base[j : j + 8] if a < t.end and b > t.start]
        if met:
            out[i] = met[0] + 1
    return out


N_FEATURES = len(features(Token(0, 1, "1", "", "")))
N_LABELS = len(KINDS) + 1


@dataclass
class Weights:
    node: np.ndarray  # features by labels
    chain: np.ndarray  # labels by labels, log factors
    skip: np.ndarray


NEUTRAL = Weights(np.zeros((N_FEATURES, N_LABELS)), np.zeros((N_LABELS, N_LABELS)), np.zeros((N_LABELS, N_LABELS)))


def _normal(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


class Graph:
    """Directed messages of undirected edges: the first ``near`` are chain edges, the others skip edges."""

    def __init__(self, n: int, near: list[tuple[int, int]], skip: list[tuple[int, int]]):
        edge = np.array([*near, *skip], np.int64).reshape(-1, 2)
        self.n, self.near, self.edges = n, len(near), len(edge)
        self.src, self.dst = np.concatenate([edge[:, 0], edge[:, 1]]), np.concatenate([edge[:, 1], edge[:, 0]])
        self.back = np.concatenate([np.arange(self.edges, 2 * self.edges), np.arange(self.edges)])
        self.order = np.argsort(self.dst, kind="stable")
        self.into, self.begin = np.unique(self.dst[self.order], return_index=True)

    def factors(self, w: Weights) -> np.ndarray:
        out = np.concatenate([np.repeat(np.exp(w.chain)[None], self.near, 0), np.repeat(np.exp(w.skip)[None], self.edges - self.near, 0)])
        return np.concatenate([out, out.transpose(0, 2, 1)])

    def belief(self, node: np.ndarray, message: np.ndarray) -> np.ndarray:
        out = node.copy()
        if self.edges:
            out[self.into] += np.add.reduceat(message[self.order], self.begin, axis=0)
        return out

    def passed(self, node: np.ndarray, factor: np.ndarray, message: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next messages, and what each edge's source says without its target."""
        out = self.belief(node, message)[self.src] - message[self.back]
        out = np.exp(out - out.max(1, keepdims=True))
        new = np.einsum("el,elm->em", out, factor)
        return DAMPING * message + (1 - DAMPING) * np.log(new / new.sum(1, keepdims=True)), out

    def pairs(self, node: np.ndarray, factor: np.ndarray, message: np.ndarray) -> np.ndarray:
        """Marginals of the edges' label pairs."""
        out = self.passed(node, factor, message)[1]
        both = out[: self.edges, :, None] * factor[: self.edges] * out[self.back[: self.edges], None, :]
        return both / both.sum((1, 2), keepdims=True)


def _clamped(node: np.ndarray, labels: np.ndarray, known: np.ndarray) -> np.ndarray:
    out = node.copy()
    out[known] = -1e3  # no number of messages outweighs it
    out[known, labels[known]] = 0.0
    return out


def _rewritten(text: str, kind: int, rng: np.random.Generator) -> str:
    """A labelled token in other writing."""
    if kind == 0:
        at = str(rng.choice([" (at) ", "[at]", " at ", " [at] ", "(at)", " @ "]))
        dot = " dot " if at == " at " else str(rng.choice([".", "[dot]", " dot ", "(dot)"]))
        local, _, domain = text.partition("@")
        return local + at + domain.replace(".", dot)
    if kind == 1:
        return str(rng.choice(["[.]", "(dot)", "[dot]", " . ", "(.)"])).join(re.findall("[0-9]+", text))
    digits = only_digits(text)
    if kind == 2:
        return str(rng.choice([" ", "-", ".", ""])).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    local, sep = digits[-10:], str(rng.choice([" ", "-", "."]))
    form = int(rng.integers(4))
    body = [f"({local[:3]}) {local[3:6]}-{local[6:]}", sep.join((local[:3], local[3:6], local[6:])), local, f"{local[:3]}{sep}{local[3:]}"][form]
    return body if len(digits) == 10 or rng.integers(2) else f"{digits[:-10]}{sep}{body}"


#: A run is a list of (text, character before, character after, word before, label).
Run = list[tuple[str, str, str, str, int]]


def with_copies(runs: list[Run], seed: int = SEED) -> list[Run]:
    """The runs, and of each with labelled tokens a copy in which those are rewritten or repeated in other writing."""
    rng, out = np.random.default_rng(seed), list(runs)
    for run in runs:
        if not any(r[4] for r in run):
            continue
        copy: Run = []
        for text, before, after, word, label in run:
            if not label:
                copy.append((text, before, after, word, label))
                continue
            other = _rewritten(text, label - 1, rng)
            if rng.integers(2):
                copy.append((text, before, after, word, label))
            copy.append((other, " ", " ", word, label))
        out.append(copy)
    return out


def fit(runs: list[Run], steps: int = STEPS, rate: float = RATE, decay: float = DECAY) -> Weights:
    """Node, chain and skip weights together, by gradient ascent on the field's likelihood of the labels."""
    x, y, hidden, near, skip = [], [], [], [], []
    for run in with_copies(runs):
        at = len(y)
        tokens = [Token(0, 0, *r[:4]) for r in run]
        labels = [r[4] for r in run]
        named = [set(keys(t)) for t in tokens]
        told = {k for ks, label in zip(named, labels, strict=True) if label for k in ks}
        x += [features(t) for t in tokens]
        y += labels
        hidden += [not label and not told.isdisjoint(ks) for ks, label in zip(named, labels, strict=True)]
        near += [(at + i, at + i + 1) for i in range(len(run) - 1)]
        skip += [(at + i, at + j) for i, j in skip_edges(tokens)]
    if not any(y):
        return NEUTRAL
    x, y, known = np.stack(x), np.array(y), ~np.array(hidden)
    graph = Graph(len(y), near, skip)
    w = Weights(np.zeros((N_FEATURES, N_LABELS)), np.zeros((N_LABELS, N_LABELS)), np.zeros((N_LABELS, N_LABELS)))
    told, free = (np.zeros((len(graph.src), N_LABELS)) for _ in range(2))
    # Rare kinds count as much as all together would by share's root.
    share = np.bincount(y, minlength=N_LABELS) / len(y)
    weight = np.where(share[y] > 0, 1 / np.sqrt(np.maximum(share[y], 1e-6)), 0.0)
    weight /= weight.mean()
    moments = [(np.zeros_like(v), np.zeros_like(v)) for v in (w.node, w.chain, w.skip)]
    for step in range(1, steps + 1):
        node, factor = x @ w.node, graph.factors(w)
        node -= node.max(1, keepdims=True)
        fixed = _clamped(node, y, known)
        for _ in range(STEP_ROUNDS):
            told, free = graph.passed(fixed, factor, told)[0], graph.passed(node, factor, free)[0]
        more = _normal(graph.belief(fixed, told)) - _normal(graph.belief(node, free))
        grads = [x.T @ (more * weight[:, None]) / len(y)]
        if graph.edges:
            both = graph.pairs(fixed, factor, told) - graph.pairs(node, factor, free)
            for part in (both[: graph.near], both[graph.near :]):
                g = part.sum(0) / len(y)
                grads.append(g + g.T)
        else:
            grads += [np.zeros_like(w.chain)] * 2
        for v, g, (first, second) in zip((w.node, w.chain, w.skip), grads, moments, strict=True):
            g = g - decay * v
            first += 0.1 * (g - first)
            second += 0.01 * (g * g - second)
            v += rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return w


def marginals(weights: Weights, tokens: list[Token], seen: list[int], rounds: int | None = None) -> np.ndarray:
    """Loopy sum-product over the chain and skip edges; observed tokens are fixed."""
    n = len(tokens)
    node = np.stack([features(t) for t in tokens]) @ weights.node
    node -= node.max(1, keepdims=True)
    labels = np.array(seen)
    node = _clamped(node, labels, labels > 0)
    graph = Graph(n, [(i, i + 1) for i in range(n - 1)], skip_edges(tokens, seen))
    if not graph.edges:
        return _normal(node)
    factor, message = graph.factors(weights), np.zeros((len(graph.src), N_LABELS))
    for _ in range(rounds or ROUNDS + 2 * n):
        new, _ = graph.passed(node, factor, message)
        done = np.abs(new - message).max() < 1e-6
        message = new
        if done:
            break
    return _normal(graph.belief(node, message))


def added_spans(weights: Weights, text: str, base: list[tuple[int, int, int]], certain: float = CERTAIN) -> list[tuple[int, int, int]]:
    if not weights.node.any():
        return []
    tokens = candidates(text)
    seen = observed(tokens, base)
    if all(seen):
        return []
    p = marginals(weights, tokens, seen)
    best = p.argmax(1)
    return [(t.start, int(best[i]) - 1, t.end) for i, t in enumerate(tokens) if not seen[i] and best[i] and p[i].max() >= certain]


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def _find(batches, weights):
    weights = weights.value
    for batch in batches:
        out: dict[str, list] = {k: [] for k in (*(f"n_{k}" for k in KINDS), "base_sha256", "spans")}
        for text in batch.column("text"):
            text = text.as_py() or ""
            base = base_spans(text)
            for k, kind in enumerate(KINDS):
                out[f"n_{kind}"].append(sum(s[1] == k for s in base))
            out["base_sha256"].append(hashlib.sha256(listed(base).encode()).hexdigest())
            out["spans"].append(listed(base + added_spans(weights, text, base)))
        kinds = [pa.int64()] * len(KINDS) + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True))], names=["doc_id", *out])


def runs_of(text: str) -> list[Run]:
    tokens = candidates(text)
    rows = [(t.text, t.before, t.after, t.word, label) for t, label in zip(tokens, observed(tokens, base_spans(text)), strict=True)]
    return [rows[i : i + RUN] for i in range(0, len(rows), RUN)]


def _runs(batches, most):
    """Of one task's runs the ``most`` different ones of least hash."""
    heap: list[tuple[int, str]] = []
    held: set[int] = set()
    for batch in batches:
        for text in batch.column("text"):
            for run in runs_of(text.as_py() or ""):
                said = json.dumps(run)
                h = int.from_bytes(hashlib.blake2b(said.encode(), digest_size=7).digest())
                if h in held or (len(heap) >= most and h >= -heap[0][0]):
                    continue
                held.add(h)
                heapq.heappush(heap, (-h, said))
                if len(heap) > most:
                    held.discard(-heapq.heappop(heap)[0])
    yield pa.RecordBatch.from_arrays([pa.array([-h for h, _ in heap], pa.int64()), pa.array([s for _, s in heap], pa.string())], names=["h", "run"])


def train(docs: DataFrame, runs: int = TRAIN_RUNS) -> Weights:
    """Weights from the bounded sample: a task sends no more than ``runs`` runs, the driver takes no more."""
    text = F.col("text").cast("string")
    usable = docs.select(text.alias("text")).filter(F.col("text").rlike("(?i)[0-9@]|[(\\[{<] ?at ?[)\\]}>]| dot "))
    found = usable.mapInArrow(lambda batches: _runs(batches, runs), "h bigint, run string").dropDuplicates(["h"])
    return fit([[tuple(t) for t in json.loads(r["run"])] for r in found.orderBy("h").limit(runs).collect()])


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans, base_sha256 and all spans of every row."""
    weights = docs.sparkSession.sparkContext.broadcast(train(docs))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id bigint, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string"
    return rows.mapInArrow(lambda batches: _find(batches, weights), schema)
