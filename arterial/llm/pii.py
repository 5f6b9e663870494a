"""Personal data by boosted trees over candidate spans.

Base spans (addresses of e-mail and the Internet, card and telephone numbers,
by fixed patterns and checks) always stay. High-recall generators propose more:
written-out addresses, numbers with other separators, telephone numbers without
a plus sign. Boosted trees score each proposal by its format and its context,
and those above their kind's calibrated threshold are added where they overlap
no base span and no better proposal. The trees learn from examples made by a
rule with a fixed seed, half of which set the thresholds.

Null text counts as empty. Offsets are code points, ends exclusive. Every row
gives one row, repeated rows too; an empty table gives none.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from arterial.llm.common import slices

#: In the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @ so that a long run of letters
    without one costs nothing."""
    at, free = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at) if begin < at else None
        if m:
            yield begin, m.end()
            free = m.end()
        at = text.find("@", m.end() if m else at + 1)


def base_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans that pass their check, and matches that fail it."""
    good: list[Span] = []
    bad: list[Span] = []
    if "@" in text:
        good += [("email", b, e) for b, e in _emails(text)]
    if not _DIGIT.search(text):
        return good, bad
    if "." in text:
        for m in _IP.finditer(text):
            ok = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split("."))
            (good if ok else bad).append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        d = _digits(m.group())
        (good if 14 <= len(d) <= 19 and luhn(d) else bad).append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            (good if 10 <= len(_digits(m.group())) <= 15 else bad).append(("phone", *m.span()))
    return good, bad


#: Stretches of text that can hold a number of any kind.
_REGION = re.compile(r"[0-9+(][0-9\x20().\[\]/+-]{6,}")
_LOOSE = {
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?:\x20?\.\x20?|\[\.\]|\(\.\))[0-9]{1,3}){3}(?![0-9])"),
    "card": re.compile(r"(?<![0-9])[0-9](?:[\x20./-]{0,3}[0-9]){13,18}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+])(?:\+|00)?\x20?(?:\(?[0-9]{1,5}\)?[\x20./-]{1,2}){1,5}[0-9]{2,8}(?![0-9])"),
}
_SPOKEN_AT = re.compile(r"@|[(\[]at[)\]]|\bat\b", re.IGNORECASE)
_SPOKEN_DOMAIN = re.compile(r"\x20?[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?(?:[(\[]dot[)\]]|\bdot\b)\x20?)[A-Za-z0-9-]{1,63}){1,4}", re.IGNORECASE)


def _spoken(text: str) -> Iterator[tuple[int, int]]:
    """Written-out addresses from each sign: at most 64 signs of a local part
    before it, a domain after it. A match begins where the last one ended, or
    later."""
    free = 0
    for m in _SPOKEN_AT.finditer(text):
        if m.start() < free:
            continue
        last = m.start() - (text[m.start() - 1 : m.start()] == " ")
        begin = last
        while begin > max(free, last - 64) and text[begin - 1] in _LOCAL:
            begin -= 1
        domain = _SPOKEN_DOMAIN.match(text, m.end()) if begin < last else None
        if domain:
            yield begin, domain.end()
            free = domain.end()


def proposals(text: str) -> list[Span]:
    """Overlapping spans of any kind, most of them wrong."""
    out: list[Span] = [("email", b, e) for b, e in _spoken(text)]
    if _DIGIT.search(text):
        for m in _REGION.finditer(text):
            for kind, pattern in _LOOSE.items():
                out += [(kind, m.start() + x.start(), m.start() + x.end()) for x in pattern.finditer(m.group())]
    return out


#: Words before a number that tell its kind.
_CUES = {
    "email": re.compile(r"mail|contact|write", re.IGNORECASE),
    "ip": re.compile(r"\bip\b|host|server|addr", re.IGNORECASE),
    "card": re.compile(r"card|visa|master|amex|credit|pan\b|konto", re.IGNORECASE),
    "phone": re.compile(r"tel|phone|call|fax|mobil|cell|ring", re.IGNORECASE),
}


#: Last labels of domains that are in common use; two letters stand for countries.
_TOP = frozenset("com org net edu gov mil int info biz name dev app".split())
#: Lengths of the groups in which card numbers are printed.
_PRINTED = ((4, 4, 4, 4), (4, 6, 5), (4, 4, 4, 4, 3), (4, 6, 4))


def _known_top(s: str) -> bool:
    last = re.split(r"[^A-Za-z0-9]+", s)[-1].lower()
    return last in _TOP or (len(last) == 2 and last.isalpha() and last not in _SHORT_WORDS)


#: Words of two letters that end no domain here.
_SHORT_WORDS = frozenset("am an as by do go he if in is my no of on or so to up we".split())


def features(text: str, span: Span) -> list[float]:
    kind, b, e = span
    s, before = text[b:e], text[max(0, b - 24) : b]
    d = _digits(s)
    groups = [len(g) for g in re.findall(r"[0-9]+", s)] or [0]
    side = lambda c: 0 if not c or c.isspace() else 1 if c.isalpha() else 2 if c.isdigit() else 3
    small = [int(g) <= 255 for g in re.findall(r"[0-9]{1,9}", s)]
    return [
        KINDS.index(kind),
        len(s),
        len(d),
        len(s) - len(d),
        len({c for c in s if not c.isalnum()}),
        len(groups),
        max(groups),
        min(groups),
        groups[-1],
        float(luhn(d)) if d else 0.0,
        float(all(small)),
        float(s[:1] == "+" or s[:2] == "00"),
        float("(" in s or "[" in s),
        side(text[b - 1 : b]),
        side(text[e : e + 1]),
        float(bool(_CUES[kind].search(before))),
        float(any(p.search(before) for k, p in _CUES.items() if k != kind)),
        float(sum(c.isupper() for c in s)),
        float(kind == "email" and _known_top(s)),
        float(tuple(groups) in _PRINTED),
        len(set(re.findall(r"[^0-9]+", s))),
        float(s[:1] in "3456"),
        float(s[:3] in ("978", "979")),
        len(text[b:e].split()),
    ]


@dataclass
class Trees:
    """Boosted trees of fixed depth: feature and cut of each inner node, value
    of each leaf, and the threshold of each kind."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    bias: float
    thresholds: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        depth = (self.leaf.shape[1]).bit_length() - 1
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += v[node - (2**depth - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2) -> Trees:
    """Boost regression trees on the gradient of the log loss."""
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    bias = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 17)[:-1])) for c in x.T]
    margin = np.full(len(y), bias)
    fs, cs, vs = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p) + 1e-6
        f, c = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                own = np.flatnonzero(node == k)
                if len(own) < 8:
                    continue
                go, ho, total = g[own], h[own], g[own].sum() ** 2 / (h[own].sum() + 1)
                best = 1e-6
                for j, options in enumerate(cuts):
                    for cut in options:
                        right = x[own, j] > cut
                        gr, hr = go[right].sum(), ho[right].sum()
                        gl, hl = go.sum() - gr, ho.sum() - hr
                        gain = gr * gr / (hr + 1) + gl * gl / (hl + 1) - total
                        if gain > best:
                            best, f[k], c[k] = gain, j, cut
            node = 2 * node + 1 + (x[np.arange(len(y)), f[node]] > c[node])
        leaf = node - (2**depth - 1)
        v = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + 1)
        margin += v[leaf]
        fs.append(f), cs.append(c), vs.append(v)
    return Trees(np.array(fs), np.array(cs), np.array(vs), bias, np.full(len(KINDS), 0.5))


def _made(rng: np.random.Generator) -> tuple[str, Span | None]:
    """An example: a text, and the personal datum in it or None."""
    number = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda: "".join(rng.choice(list("abcdefghilmnoprstu"), rng.integers(2, 9)))
    pick = lambda *options: options[rng.integers(len(options))]
    kind = pick(*KINDS, None, None, None)
    if kind == "email":
        at, dot = pick((" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "), ("(at)", "."), (" [at] ", "."), (" AT ", " DOT "), (" @ ", "."), ("(at)", "(dot)"))
        top = pick("com", "org", "net", "edu", "info", f"co{dot}uk", "de", "fr", "nl", "ch", "io", "es", "pl", "se")
        name = pick(word(), word().title(), word() + pick(".", "_", "-") + word(), word() + number(2), word()[0] + number(1))
        datum = f"{name}{at}{pick(word(), word() + '-' + word(), word().title())}{dot}{top}"
    elif kind == "ip":
        datum = pick(" . ", "[.]", "(.)").join(str(rng.integers(0, 256)) for _ in range(4))
    elif kind == "card":
        shape = _PRINTED[rng.integers(len(_PRINTED))] if rng.random() < 0.6 else _PRINTED[0]
        d = str(rng.integers(3, 7)) + number(sum(shape) - 2)
        d += next(str(c) for c in range(10) if luhn(d + str(c)))
        cuts = np.cumsum((0, *shape))
        datum = pick(".", "/", "  ", " - ", " / ", "--").join(d[i:j] for i, j in zip(cuts, cuts[1:]))
    elif kind == "phone":
        area, sep = number(3), pick("-", ".", " ", "/")
        datum = pick(
            f"({area}) {number(3)}{sep}{number(4)}", f"0{area}{sep}{number(3)}{sep}{number(4)}", f"00{rng.integers(1, 99)} {area} {number(3)} {number(4)}",
            f"{area}{sep}{number(3)}{sep}{number(4)}", f"(0{area}) {number(6)}", f"00{rng.integers(1, 99)}{sep}{area}{sep}{number(7)}",
        )
    else:
        datum = pick(
            f"20{number(2)}-{number(2)}-{number(2)} {number(2)}:{number(2)}",
            f"{number(16)}",
            f"{number(4)} {number(4)} {number(4)} {number(4)}",
            f"{number(4)}-{number(4)}-{number(4)}-{number(4)}",
            f"{number(4)}.{number(4)}.{number(4)}.{number(4)}",
            f"{rng.integers(1, 9)}.{rng.integers(0, 20)}.{rng.integers(0, 20)}",
            f"{number(3)}.{number(3)}",
            f"{number(2)} {number(2)} {number(2)}",
            f"{number(5)}-{number(4)}-{number(7)}",
            f"97{rng.integers(8, 10)}-{number(1)}-{number(4)}-{number(4)}-{number(1)}",
            f"meet {word()} at {word()} dot {word()} lines",
            f"look at {word()}.{word().title()} then",
            f"{number(4)}/{number(4)} {number(4)}/{number(2)}",
            f"({number(2)}) {number(5)} ({number(3)}) {number(2)}",
            f"{number(1)}.{number(3)}.{number(3)}.{number(3)}.{number(2)}",
            f"{number(2)}-{number(2)}, {number(3)}-{number(3)}",
        )
    cue = {"email": "mail ", "ip": "ip ", "card": "card ", "phone": "tel. "}.get(kind or pick(*KINDS), "") if rng.random() < 0.5 else ""
    lead = f"{word()} {word()} {cue}"
    text = f"{lead}{datum}{pick('', '.', ',', '!!', '***', '.' , ')')} {word()}"
    return text, (kind, len(lead), len(lead) + len(datum)) if kind else None


def learn(examples: int = 4000, seed: int = 3, precision: float = 0.98) -> Trees:
    """Trees from made examples; each kind's threshold is the least one that
    keeps the precision on the half that the trees have not seen."""
    rng = np.random.default_rng(seed)
    halves: list[tuple[list, list]] = [([], []), ([], [])]
    for i in range(examples):
        text, truth = _made(rng)
        for span in proposals(text):
            halves[i % 2][0].append(features(text, span))
            halves[i % 2][1].append(float(bool(truth) and span[0] == truth[0] and abs(span[1] - truth[1]) + abs(span[2] - truth[2]) <= 2))
    (x, y), (xc, yc) = [(np.array(a, float), np.array(b)) for a, b in halves]
    trees = boost(x, y)
    p = trees.probability(xc)
    for k in range(len(KINDS)):
        own = xc[:, 0] == k
        order = np.argsort(-p[own])
        right = np.cumsum(yc[own][order]) / np.arange(1, own.sum() + 1)
        fine = np.flatnonzero(right >= precision)
        trees.thresholds[k] = max(0.5, p[own][order][fine[-1]]) if len(fine) else 2.0
    return trees


class _Free:
    """What base spans and spans taken later leave free, looked up by
    bisection. Base spans may overlap each other; they are merged."""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        self.begins: list[int] = []
        self.ends: list[int] = []
        for b, e in sorted(spans):
            if self.ends and b < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.begins.append(b)
                self.ends.append(e)

    def take(self, b: int, e: int) -> bool:
        """Whether b..e was free; if so, it is taken now."""
        at = bisect.bisect_left(self.begins, e)
        if at and self.ends[at - 1] > b:
            return False
        self.begins.insert(at, b)
        self.ends.insert(at, e)
        return True


def find(texts: list[str], trees: Trees) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and added spans of each text, in order."""
    based = [base_spans(t) for t in texts]
    # what failed a base check can still be proposed
    rest = [[s for s in dict.fromkeys(proposals(t) + bad)] for t, (_, bad) in zip(texts, based)]
    flat = [features(t, s) for t, spans in zip(texts, rest) for s in spans]
    p = trees.probability(np.array(flat, float)) if flat else np.zeros(0)
    out, at = [], 0
    for (good, _), spans in zip(based, rest):
        own = p[at : at + len(spans)]
        at += len(spans)
        added: list[Span] = []
        free = _Free((b, e) for _, b, e in good)
        for i in np.argsort(-own, kind="stable").tolist():
            kind, b, e = spans[i]
            if own[i] >= trees.thresholds[KINDS.index(kind)] and free.take(b, e):
                added.append(spans[i])
        key = lambda s: (s[1], KINDS.index(s[0]))
        out.append((sorted(good, key=key), sorted(added, key=key)))
    return out


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{b}:{e}" for k, b, e in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))))


def redact(text: str, spans: list[Span]) -> str:
    """The text with each stretch that spans cover replaced by its first kind."""
    out, at = [], 0
    for kind, b, e in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))):
        if b >= at:
            out += [text[at:b], f"[{kind}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, trees: Trees) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans."""
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for base, added in find([t or "" for t in batch.column(1).to_pylist()], trees):
                n = [sum(s[0] == k for s in base) for k in KINDS]
                rows.append((*n, hashlib.sha256(written(base).encode()).hexdigest(), written(base + added)))
            columns = list(zip(*rows))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
