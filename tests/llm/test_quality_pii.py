"""Quality network and personal data."""

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from arterial.llm import pii, quality

from .conftest import hard_texts, rows_of


def test_network_learns_and_whole_texts_count(spark, hard, empty):
    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(list("abcdeimnorst"), rng.integers(2, 8)))
    good = [" ".join(word() for _ in range(rng.integers(5, 120))) for _ in range(80)]
    bad = [" ".join(word() + "###" for _ in range(rng.integers(5, 120))) for _ in range(80)]
    rows = [(i, t, 1) for i, t in enumerate(good)] + [(1000 + i, t, 0) for i, t in enumerate(bad)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 5] + [(None, 1), (3, None), (1, 1)], "doc_id long, quality int")
    net = quality.learn(docs, labels)
    got = {r.doc_id: r for r in quality.score(docs, net).collect()}
    assert np.mean([got[i].predicted == y for i, _, y in rows if not i % 5]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    # the end of a long text reaches the score
    clean = " ".join(good * 3).encode()
    assert quality.probabilities(net, [clean + b" x### y### z###" * 60])[0] < quality.probabilities(net, [clean])[0]
    # texts do not depend on their neighbours, and pieces join without seams
    texts = [(t or "").encode() for t in hard_texts()] + [clean * 8]
    together = quality.probabilities(net, texts)
    alone = np.concatenate([quality.probabilities(net, [t]) for t in texts])
    assert np.allclose(together, alone, atol=1e-5)
    assert quality.score(hard, net).count() == hard.count() and quality.score(empty, net).count() == 0
    assert quality.keep_good(hard, net).columns == hard.columns


def test_gradients():
    rng = np.random.default_rng(2)
    net = quality.Network.fresh()
    texts = [bytes(rng.integers(32, 127, n).astype(np.uint8)) for n in (3, 130, 700)]
    y = np.array([1, 0, 1], np.float32)
    loss = lambda: -np.mean(np.log(np.where(y == 1, quality.probabilities(net, texts), 1 - quality.probabilities(net, texts))))
    g = quality._gradients(net, texts, y)
    for name in "acwdve":
        p = getattr(net, name)
        i = np.unravel_index(np.abs(g[name]).argmax(), p.shape)
        old = p[i]
        p[i] = old + 2e-3
        up = loss()
        p[i] = old - 2e-3
        assert (up - loss()) / 4e-3 == pytest.approx(float(g[name][i]), rel=0.1, abs=1e-3), name
        p[i] = old


def test_labels_of_one_value(spark, hard):
    one = spark.createDataFrame([(6, 1), (9, 1)], "doc_id long, quality int")
    assert quality.score(hard, quality.learn(hard, one)).filter("score < 0.99").count() == 0
    none = quality.learn(hard, one.filter("quality = 0"))
    assert {r.score for r in quality.score(hard, none).collect()} == {0.5}


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(pii._digits(s)) <= 19 and pii.luhn(pii._digits(s))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(pii._digits(s)) <= 15),
}


def plain_spans(text):
    out = [(k, *m.span()) for k, (p, ok) in BASE.items() for m in re.finditer(p, text) if ok(m.group())]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


ODD = [
    "a@b.co_m@x.y @c.d a@@b.c x@y a@b. c@d.e.f-g.", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0004 1..2.3.4 9.9.9.9",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111111111111112 4111  1111 1111 1111 1", "+1 (017) 555-7713 +12 +1+234567890123 +49.30.1234567-8 +1((((2",
    "٣.٤.٥.٦ é@x.com é.a@x.com", "@" * 50, "+" * 50 + "1", "9" * 3000, "a" * 3000 + "@b.c", "1.1" * 900, "+1 " + "2 " * 800, "a.b@c.d@e.f@g.h",
]


def test_base_spans():
    rng = np.random.default_rng(1)
    noise = ["".join(rng.choice(list("ab@.+-_ 0123456789()é"), 120)) for _ in range(300)]
    for text in ODD + noise + [t or "" for t in hard_texts()]:
        good, _ = pii.base_spans(text)
        assert sorted(good, key=lambda s: (s[1], pii.KINDS.index(s[0]))) == plain_spans(text), text[:80]


@pytest.fixture(scope="module")
def trees():
    return pii.learn()


#: Made by other rules than those that the trees learn from.
SENTENCES = [
    "Please {cue} {datum} before Friday", "Our old notes say {cue}: {datum}. Nothing else changed", "He wrote {datum} on the back",
    "New {cue} {datum}, same as last year", "({cue} {datum})", "Reach me, {cue} = {datum}; thanks", "{datum} was on the form",
]
CUES = {
    "email": ["mail", "e-mail", "contact", "write to", "address"], "ip": ["ip", "host", "server", "from", "address"],
    "card": ["card", "visa", "credit card", "paid with", "number"], "phone": ["call", "tel", "phone", "fax", "mobile"],
}


def digits(r, n):
    return "".join(str(r.randrange(10)) for _ in range(n))


def held_datum(r, kind):
    if kind == "email":
        who = r.choice(["maria", "j.smith", "bob_77", "k-lee", "info", "Anna.Maria", "x9"])
        at, dot = r.choice([(" (at) ", " (dot) "), ("(at)", "(dot)"), ("[at]", "[dot]"), (" [at] ", " [dot] "), (" at ", " dot "), (" AT ", " DOT "), (" @ ", ".")])
        return who + at + r.choice(["example", "mail-host", "uni", "Post"]) + dot + r.choice(["com", "de", "org", "co.uk", "io"]).replace(".", dot)
    if kind == "ip":
        return r.choice(["[.]", "(.)", " . "]).join(str(r.choice([10, 192, 8, 172, 77, 254, 1, 0])) for _ in range(4))
    if kind == "card":
        d = r.choice(["4", "51", "37", "6011"])
        d += digits(r, r.choice([15, 16, 16, 16]) - 1 - len(d))
        d += next(str(c) for c in range(10) if pii.luhn(d + str(c)))
        groups = [d[:4], d[4:10], d[10:]] if len(d) == 15 else [d[i : i + 4] for i in range(0, 16, 4)]
        return r.choice([".", "/", "  ", " - ", " / "]).join(groups)
    a, b, c = r.randrange(200, 990), r.randrange(100, 999), r.randrange(1000, 9999)
    return r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"0{a} {b} {c}", f"0049 {a} {b}{c}", f"{a} {b} {c}", f"(0{a}) {b} {c}", f"001-{a}-{b}-{c}"])


def held_example(r):
    kind = r.choice(pii.KINDS)
    datum = held_datum(r, kind)
    cue = r.choice(CUES[kind]) if r.random() < 0.6 else r.choice(["see", "for", "and"])
    text = r.choice(SENTENCES).format(cue=cue, datum=datum)
    at = text.index(datum)
    return text, (kind, at, at + len(datum))


def clean_example(r):
    n = lambda k: digits(r, k)
    return r.choice([
        f"Order {n(4)}-{n(4)}-{n(4)}-{n(3)}7 shipped", f"version {n(1)}.{n(1)}.{n(2)} is out", f"In 19{n(2)} and 20{n(2)}, {n(3)} of {n(4)} were sold",
        "meet at noon and dot the line", "look at the cat.The dog slept", f"table: {n(2)} {n(3)} {n(2)} {n(3)} {n(1)}", f"see pages {n(2)}-{n(2)}, {n(3)}-{n(3)}",
        f"ISBN 978-{n(1)}-{n(4)}-{n(4)}-{n(1)}", f"on 20{n(2)}-{n(2)}-{n(2)} at {n(2)}:{n(2)}:{n(2)}", f"price {n(1)},{n(3)},{n(3)}.{n(2)} total",
    ])


def test_trees_hold_on_examples_of_another_maker(trees):
    r = random.Random(7)
    made = [held_example(r) for _ in range(1200)]
    hit, truths = Counter(), Counter()
    for (_, truth), (base, added) in zip(made, pii.find([t for t, _ in made], trees)):
        truths[truth[0]] += 1
        hit[truth[0]] += any(s[0] == truth[0] and abs(s[1] - truth[1]) <= 2 and abs(s[2] - truth[2]) <= 2 for s in base + added)
    assert all(hit[k] >= 0.9 * n for k, n in truths.items()), (hit, truths)
    clean = [clean_example(r) for _ in range(1200)]
    assert sum(bool(added) for _, added in pii.find(clean, trees)) <= 12


def test_many_spans_in_one_text(trees):
    text = " ".join(f"tel. 212-555-{i:04} and a{i}@b.co" for i in range(8000))
    began = time.time()
    ((base, added),) = pii.find([text], trees)
    assert len(base) == 8000 and len(added) > 7000 and time.time() - began < 30


def test_scan(spark, hard, empty, trees):
    want = Counter()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string").unionByName(hard.select("doc_id", "text"))
    for doc_id, text in rows_of(docs):
        base = plain_spans(text or "")
        want[(doc_id, *(sum(s[0] == k for s in base) for k in pii.KINDS), hashlib.sha256(pii.written(base).encode()).hexdigest())] += 1
    got = pii.scan(docs, trees).collect()
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
    assert pii.scan(empty, trees).count() == 0
    assert pii.redact("to a@b.c now", [("email", 3, 8)]) == "to [email] now"


def test_dense_written_out_addresses_are_proposed_whole():
    names = ["frank", "greta.lund", "h7", "ida", "jo"]
    for at, dot in ((" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "), (" @ ", "."), (" at ", ".")):
        data = [f"{names[i % 5]}{i}{at}example{i}{dot}com" for i in range(200)]
        text = ", ".join(data)
        got = [text[b:e] for kind, b, e in pii.proposals(text) if kind == "email"]
        assert got == data, (at, dot)
    long = "a" * 64 + " at " + ".".join(["b" * 63] * 5)
    assert ("email", 0, len(long)) in pii.proposals(long)
    # the trees keep the written-out ones of a dense list
    text = "; ".join(f"mail {names[i % 5]}{i} (at) example{i} (dot) com" for i in range(200))
    (_, added), = pii.find([text], pii.learn())
    assert sum(kind == "email" for kind, *_ in added) == 200
