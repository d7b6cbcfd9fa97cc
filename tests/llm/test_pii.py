import random
import re

import numpy as np
from deckflow.llm import pii


def luhn(digits):
    total = 0
    for i, c in enumerate(digits[::-1]):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def brute(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_patterns_equal_brute_force():
    rng = random.Random(1)
    parts = ["a@b.c", "@", "x@y", "a.b@c-d.e.f", "@@", "1.2.3.4", "300.1.1.1", "001.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (415) 555-0132", "+", "٣", "-", ".", " ", "  ", "(", ")", "7", "12", "+49.30 12345678", "é", "\n"]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 8)))
        assert pii.base_spans(text) == brute(text), text


def test_long_runs_take_linear_time():
    for c in ("a", "1", "1 ", "+1", "a.", "1.", "a@", "+ (", "@"):
        pii.base_spans(c * 100_000)
        pii.windows(c * 100_000)


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(2)
    model = pii.Model(rng.normal(size=(1 << pii.BITS, len(pii.LABELS))), rng.normal(size=(len(pii.LABELS) + 1, len(pii.LABELS))))
    rules = model.transition + pii._allowed()
    from itertools import product

    sequences = [rng.integers(0, 1 << pii.BITS, (n, 8)) for n in (1, 3, 2, 3, 0)]
    for x, got in zip(sequences, model.decode(sequences)):
        score = model.emission[x].sum(axis=1)
        paths = product(range(len(pii.LABELS)), repeat=len(x))
        total = lambda p: sum(score[t, y] + rules[p[t - 1] + 1 if t else 0, y] for t, y in enumerate(p))
        assert tuple(got.tolist()) == max(paths, key=total)


def trained():
    model = pii.Model.empty()
    model.learn(list(pii._examples()) * 5)
    return model


def test_field_learns_the_examples_and_keeps_plain_numbers():
    model = trained()
    texts = ["ring (212) 555-0148 before noon", "in 2004 there were 31200 of them", "office 646-555-0190 or at home"]
    found = model.spans(texts)
    assert [texts[0][a:b] for _, a, b in found[0]] == ["(212) 555-0148"]
    assert found[1] == [] and [k for k, *_ in found[2]] == ["phone"]


def test_added_spans_touch_no_other():
    base, every = pii.all_spans(["call +1 (212) 555-0148 or 646-555-0190 office 646-555-0191 x"], trained())[0]
    assert [s for s in every if s in base] == base
    ordered = sorted((s[1], s[2]) for s in every)
    assert all(a[1] <= b[0] for a, b in zip(ordered, ordered[1:]))


def test_redacted():
    text = "mail a@b.org, 1.2.3.4 now"
    assert pii.redacted(text, brute(text)) == "mail [EMAIL], [IP] now"
    assert pii.redacted("abcdef", [("ip", 1, 4), ("card", 2, 5)]) == "a[IP]f"


def test_edges(spark, edges):
    model = pii.train(edges)
    rows = {r.doc_id: r for r in pii.find(edges, model).collect()}
    assert (rows[6].n_email, rows[6].n_ip, rows[6].n_phone) == (1, 1, 1) and rows[3].spans == rows[4].spans == ""
    clean = {r.doc_id: r for r in pii.redact(edges, model, length_col="n_chars").collect()}
    assert clean[3].text is None and "[EMAIL]" in clean[6].text and clean[6].n_chars == len(clean[6].text)
    assert pii.redact(edges, model).columns == edges.columns
    assert pii.find(edges.limit(0), pii.train(edges.limit(0))).count() == 0


def test_gradient_equals_finite_differences():
    """One step of learning against the likelihood over all paths of labels."""
    import itertools

    import numpy as np

    rng = np.random.default_rng(2)
    x = pii._features(["call", "+1", "415"])
    labels = len(pii.LABELS)
    y = np.array([0, pii.LABELS.index("B-phone"), pii.LABELS.index("I-phone")])
    model = pii.Model.empty()
    model.emission[np.unique(x)] = rng.normal(size=(len(np.unique(x)), labels)) * 0.3
    model.transition[:] = rng.normal(size=model.transition.shape) * 0.3
    emission, transition, rules = model.emission.copy(), model.transition.copy(), pii._allowed()

    def loss():
        score, move = emission[x].sum(axis=1), transition + rules
        total = {}
        for path in itertools.product(range(labels), repeat=len(x)):
            s = score[0, path[0]] + move[0, path[0]]
            for t in range(1, len(x)):
                s += score[t, path[t]] + move[1 + path[t - 1], path[t]]
            total[path] = s
        return np.logaddexp.reduce(list(total.values())) - total[tuple(y)]

    model.learn([(x, y)], epochs=1, rate=1.0, l2=0.0)

    def gradient(before, after):
        step = before - after  # g / sqrt(1e-6 + g * g)
        return step * 1e-3 / np.sqrt(np.maximum(1 - step * step, 1e-300))

    for weights, learnt in ((emission, model.emission), (transition, model.transition)):
        found, at = gradient(weights, learnt), [(int(r), c) for r in (np.unique(x)[:3] if weights is emission else range(3)) for c in range(labels)]
        for place in at:
            kept, h = weights[place], 1e-5
            weights[place] = kept + h
            above = loss()
            weights[place] = kept - h
            below = loss()
            weights[place] = kept
            assert abs((above - below) / (2 * h) - found[place]) < 1e-5
