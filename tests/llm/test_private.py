"""The skip-chain field: added spans against exact inference, planted forms and long texts."""

import random
import time
from collections import Counter

import numpy as np
import pytest

from kinfold.llm import pii_crf as P

from .cases import SCHEMA, awkward

VOCAB = ["talea", "onder", "mirel", "sopta", "vane", "kerin", "dulo", "pasti"]


def digits(rng, n):
    return "".join(str(rng.randrange(10)) for _ in range(n))


def card(rng):
    body = "4" + digits(rng, 14)
    return next(body + c for c in "0123456789" if P.luhn(body + c))


def entity(rng, kind):
    if kind == "email":
        return f"{rng.choice(VOCAB)}.{digits(rng, 2)}@mail{digits(rng, 1)}.example.test"
    if kind == "ip":
        return ".".join(str(rng.randrange(10, 256)) for _ in range(4))
    return card(rng) if kind == "card" else f"+1 ({digits(rng, 3)}) 555-{digits(rng, 4)}"


def other_form(rng, kind, text):
    if kind == "email":
        return text.replace("@", rng.choice([" (at) ", "[at]", " [at] "])).replace(".example", "[dot]example")
    if kind == "ip":
        return text.replace(".", rng.choice(["[.]", "(dot)"]))
    if kind == "card":
        return ".".join(text[i : i + 4] for i in range(0, 16, 4))
    return text[3:].replace("(", "").replace(")", "")


def prose(rng, n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def not_card(rng):
    while P.luhn(number := digits(rng, 16)):
        pass
    return number


def planted(rng):
    """A text, and the spans of the forms that the base patterns do not match."""
    parts, want, at = [], [], 0

    def put(s, kind=None):
        nonlocal at
        if kind:
            want.append((at, P.KINDS.index(kind), at + len(s)))
        parts.append(s + " ")
        at += len(s) + 1

    kind = rng.choice(P.KINDS)
    said = entity(rng, kind)
    put(prose(rng, 5))
    put(said)
    for _ in range(rng.randint(1, 4)):
        put(prose(rng, rng.randint(1, 30)))
        put(other_form(rng, kind, said), kind)
        put(prose(rng, 3))
        put(rng.choice([f"order {digits(rng, 5)}", f"19{digits(rng, 2)}", f"version 3.{digits(rng, 1)}.{digits(rng, 2)}", f"no {not_card(rng)}", f'token = "{digits(rng, 3)}ab{digits(rng, 30)}c"']))
        put(prose(rng, 3))
    return "".join(parts), want


@pytest.fixture(scope="module")
def weights():
    rng = random.Random(1)
    texts = [f"{prose(rng, 6)} {entity(rng, rng.choice(P.KINDS))} {prose(rng, 4)} {rng.choice([digits(rng, 5), '19' + digits(rng, 2), not_card(rng), '3.' + digits(rng, 3), chr(34) + digits(rng, 4) + 'ab' + digits(rng, 20) + chr(34)])} {prose(rng, 3)}" for _ in range(600)]
    return P.fit([r for t in texts for r in P.runs_of(t)])


def test_planted_forms_are_found(weights):
    rng, hit, miss, wrong = random.Random(2), 0, 0, 0
    for _ in range(300):
        text, want = planted(rng)
        got = P.added_spans(weights, text, P.base_spans(text))
        hit += len(set(got) & set(want))
        miss += len(set(want) - set(got))
        wrong += len(set(got) - set(want))
    assert hit / (hit + miss) >= 0.95 and hit / (hit + wrong) >= 0.95


def test_clean_texts_get_none(weights):
    rng = random.Random(3)
    for _ in range(200):
        text = f"{prose(rng, 20)} {digits(rng, 5)} {prose(rng, 3)} 19{digits(rng, 2)} {prose(rng, 3)} {not_card(rng)} {prose(rng, 5)} at the dot of noon"
        assert P.added_spans(weights, text, P.base_spans(text)) == []


def plain_marginals(w, tokens, seen):
    """Every labelling counted."""
    n, k = len(tokens), P.N_LABELS
    node = np.stack([P.features(t) for t in tokens]) @ w.node
    edges = P.skip_edges(tokens, seen)
    logs, labels = [], list(np.ndindex(*(k,) * n))
    for y in labels:
        if any(s and s != v for s, v in zip(seen, y, strict=True)):
            logs.append(-np.inf)
            continue
        logs.append(sum(node[i, v] for i, v in enumerate(y)) + sum(w.chain[a, b] for a, b in zip(y, y[1:], strict=False)) + sum(w.skip[y[a], y[b]] for a, b in edges))
    p = np.exp(np.array(logs) - max(logs))
    out = np.zeros((n, k))
    for y, v in zip(labels, p / p.sum(), strict=True):
        for i, label in enumerate(y):
            out[i, label] += v
    return out


def test_spans_against_every_labelling(weights):
    rng, compared, added = random.Random(4), 0, 0
    while compared < 60:
        text, _ = planted(rng)
        base = P.base_spans(text)
        tokens = P.candidates(text)
        if not 2 <= len(tokens) <= 5:
            continue
        compared += 1
        seen = P.observed(tokens, base)
        p = plain_marginals(weights, tokens, seen)
        assert P.marginals(weights, tokens, seen) == pytest.approx(p, abs=0.05)
        if np.abs(p.max(1) - P.CERTAIN).min() > 0.05:
            want = [(t.start, int(p[i].argmax()) - 1, t.end) for i, t in enumerate(tokens) if not seen[i] and p[i].argmax() and p[i].max() >= P.CERTAIN]
            assert P.added_spans(weights, text, base) == want
            added += len(want)
    assert added >= 20


def test_repeats_reach_one_another(weights):
    text = "call +1 (564) 555-4526 now. " + "Later: 564 555 4526 again. " * 50
    assert len(P.added_spans(weights, text, P.base_spans(text))) == 50


def test_numbers_run_together_come_apart(weights):
    rng = random.Random(6)
    a, b = card(rng), card(rng)
    text = f"vane {a} {b} dulo"
    assert P.base_spans(text) == []
    tokens = P.candidates(text)
    assert [t.text for t in tokens] == [a, b]
    assert P.marginals(weights, tokens, [0, 0]).argmax(1).tolist() == [3, 3]


@pytest.mark.parametrize("text", ["1" * 5_000_000, "a" * 5_000_000 + "@ x", "a.b-" * 1_200_000 + "[at]"], ids=["digits", "token", "bracket"])
def test_time_is_linear(text):
    began = time.perf_counter()
    assert P.base_spans(text) == []
    P.candidates(text)
    assert time.perf_counter() - began < 3


def _field(pull):
    """A field whose nodes lean to none and whose skip edges pull towards equal labels."""
    node = np.zeros((P.N_FEATURES, P.N_LABELS))
    node[0, 0] = 1.0
    return P.Weights(node, np.zeros((P.N_LABELS,) * 2), pull * np.eye(P.N_LABELS))


@pytest.mark.parametrize("first", [True, False])
def test_evidence_reaches_fifty_repeats(first):
    one, many = "call +1 (564) 555-4526 now. ", " ".join(f"Then 564 555 4526, order 98{i:06d}." for i in range(50)) + " "
    text = one + many if first else many + one
    got = [(text[a:b], P.KINDS[k]) for a, k, b in P.added_spans(_field(3.0), text, P.base_spans(text), certain=0.7)]
    assert got == [("564 555 4526", "phone")] * 50
    assert P.added_spans(_field(3.0), many, P.base_spans(many), certain=0.7) == []


def test_messages_pass_until_they_settle():
    rng = np.random.default_rng(1)
    k, n = P.N_LABELS, 60
    w = P.Weights(np.zeros((P.N_FEATURES, k)), 6 * np.eye(k) + rng.normal(size=(k, k)) / 9, np.zeros((k, k)))
    tokens = [P.Token(i * 20, i * 20 + 9, f"{10**8 + i * 7919}", "", "") for i in range(n)]
    p = P.marginals(w, tokens, [4] + [0] * (n - 1))
    f, m = np.exp(w.chain), np.eye(k)[4]
    onward = np.ones(k)
    after = [onward]
    for _ in range(n - 1):
        onward = f @ onward
        after.append(onward := onward / onward.sum())
    for i in range(n):
        exact = m * after[n - 1 - i]
        assert p[i] == pytest.approx(exact / exact.sum(), abs=1e-3)
        m = m @ f
        m /= m.sum()


def test_no_sample_adds_nothing(spark):
    rows = [(i, t) for i, t in enumerate(["none here", None, "", "year 2019 and 564 555 4526"])]
    got = P.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.spans == "" for r in got)


def test_find_is_rowwise_and_repeats(spark):
    rng = random.Random(7)
    texts = [planted(rng)[0] for _ in range(120)]
    docs = spark.createDataFrame([(i, t, None, None, 0, "r", "s", "c", 0, "t", 0, 0, 0, 0) for i, t in enumerate(texts + texts[:10])] + awkward(), SCHEMA)
    weights = P.train(docs)
    want = Counter((r.doc_id, P.listed(P.base_spans(r.text or "") + P.added_spans(weights, r.text or "", P.base_spans(r.text or "")))) for r in docs.select("doc_id", "text").collect())
    for parts in (1, 4):
        assert Counter((r.doc_id, r.spans) for r in P.find(docs.repartition(parts)).collect()) == want
    assert sum(s.count(":") for _, s in want) // 2 > sum(len(P.base_spans(t)) for t in texts)
