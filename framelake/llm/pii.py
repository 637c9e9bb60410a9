"""Personal data: base patterns, and a character-level bidirectional LSTM with CRF transitions.

The network is trained in numpy from labelled spans (those of the base patterns in a bounded sample
of texts, and generated variants of their formats that the patterns do not know: spaced or defanged
addresses, numbers with other separators), tags the characters of overlapping windows, and every
window is decoded by Viterbi. The spans of all windows of a text are reconciled globally: those that
a window's border cuts give way to whole ones that they overlap, those of one kind that overlap are
joined, of different kinds the longer stays. Ends within a run of letters or digits move to its ends,
so that no number is cut; what then lacks the parts of its kind (four numbers up to 255, a Luhn sum,
9 to 15 digits in groups, a domain) is dropped.

A span of any kind holds a digit or an ``@``; decoding drops others. So windows without one of
these characters cannot yield a span and are not run; this changes no result, at any size.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, sample_ids, sampled_rows, small_batches, tidied

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. That of email is [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+,
#: searched from its ``@`` so that long runs without one cost nothing; an ip can only start a run of digits.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
PATTERNS = (
    re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
)
Span = tuple[int, int, int]  # kind, start, end

WIDTH, STRIDE = 128, 64
#: Windows that the network is fitted on: twice as wide as the longest of the made-up values.
TRAIN_WIDTH = 64
HIDDEN = 24
#: Most texts that spans are learnt from (those of them that hold a digit or ``@``).
SAMPLE = 6000
#: Tags: 0 outside, then begin and inside of each kind.
TAGS = 1 + 2 * len(KINDS)
_CHARS = "0123456789@+.-()_%: \n"
_ANCHOR = re.compile("[0-9@]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _valid(kind: int, text: str) -> bool:
    digits = [c for c in text if c in "0123456789"]
    if kind == 1:
        return all(int(p[-4:]) <= 255 and not p[:-3].strip("0") for p in text.split("."))
    if kind == 2:
        return 13 <= len(digits) <= 19 and _luhn("".join(digits))
    if kind == 3:
        return 9 <= len(digits) <= 15
    return True


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns, by kind and then start; leftmost and non-overlapping within a kind."""
    found = _emails(text)
    for kind, pattern in enumerate(PATTERNS, 1):
        found += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if _valid(kind, m.group())]
    return found


def _emails(text: str) -> list[Span]:
    found, low, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            found.append((0, start, m.end()))
        low = m.end() if m else at + 1
        at = text.find("@", low)
    return found


def span_text(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


# ---------------------------------------------------------------------------------- the network


def codes(text: str) -> np.ndarray:
    """A small alphabet: the characters of the formats, lower and upper letters, other letters, the rest."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    out = np.full(len(points), len(_CHARS) + 3, np.int64)
    out[(points >= 97) & (points <= 122)] = len(_CHARS)
    out[(points >= 65) & (points <= 90)] = len(_CHARS) + 1
    out[points >= 192] = len(_CHARS) + 2
    for i, c in enumerate(_CHARS):
        out[points == ord(c)] = i
    return out


ALPHABET = len(_CHARS) + 4
PAD = ALPHABET  # beyond the text


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


@dataclass
class Network:
    """embed: gate inputs of every character (2 directions); recur: hidden to gates; out: to tags; trans: CRF."""

    embed: np.ndarray
    recur: np.ndarray
    out: np.ndarray
    trans: np.ndarray

    @staticmethod
    def fresh(seed: int = 9, kind: type = np.float32) -> Network:
        rng = np.random.default_rng(seed)
        embed = rng.normal(0, 0.4, (2, ALPHABET + 1, 4 * HIDDEN))
        embed[:, :, HIDDEN : 2 * HIDDEN] += 1  # forget gates open
        recur = rng.normal(0, 0.25, (2, HIDDEN, 4 * HIDDEN))
        return Network(*(p.astype(kind) for p in (embed, recur, rng.normal(0, 0.2, (2 * HIDDEN + 1, TAGS)), rng.normal(0, 0.1, (TAGS, TAGS)))))

    def params(self) -> list[np.ndarray]:
        return [self.embed, self.recur, self.out, self.trans]

    def forward(self, x: np.ndarray, train: bool = False) -> tuple[np.ndarray, list]:
        """Tag scores (batch, width, tags) of character codes, and what the backward pass needs.

        Both directions advance together: step t is character t of the one and width - 1 - t of the other.
        """
        (batch, width), n = x.shape, HIDDEN
        given = np.stack([self.embed[0][x.T], self.embed[1][x[:, ::-1].T]], axis=1)  # width, direction, batch, gates
        h, c, kept = np.zeros((2, batch, n), given.dtype), np.zeros((2, batch, n), given.dtype), []
        states = np.empty((width, 2, batch, n), given.dtype)
        for t in range(width):
            z = given[t] + h @ self.recur
            ifo, g = _sigmoid(z[..., : 3 * n]), np.tanh(z[..., 3 * n :])
            i, f, o = ifo[..., :n], ifo[..., n : 2 * n], ifo[..., 2 * n :]
            c_new = f * c + i * g
            tc = np.tanh(c_new)
            if train:
                kept.append((i, f, o, g, c, tc, h))
            h, c = o * tc, c_new
            states[t] = h
        both = np.concatenate([states[:, 0], states[::-1, 1]], axis=-1).transpose(1, 0, 2)
        return both @ self.out[:-1] + self.out[-1], [both, kept]

    def backward(self, x: np.ndarray, memo: list, slope: np.ndarray) -> list[np.ndarray]:
        (both, kept), (batch, width), n = memo, x.shape, HIDDEN
        d_out = np.vstack([np.tensordot(both, slope, ((0, 1), (0, 1))), slope.sum(axis=(0, 1))[None]])
        pulled = (slope @ self.out[:-1].T).transpose(1, 0, 2)
        d_states = np.stack([pulled[..., :n], pulled[::-1, :, n:]], axis=1)
        d_recur, dzs = np.zeros_like(self.recur), np.empty((width, 2, batch, 4 * n), d_states.dtype)
        dh_next = dc_next = np.zeros((2, batch, n), d_states.dtype)
        for t in range(width - 1, -1, -1):
            i, f, o, g, c, tc, h = kept[t]
            dh = d_states[t] + dh_next
            dc = dh * o * (1 - tc**2) + dc_next
            dzs[t] = dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g**2)], axis=-1)
            d_recur += h.transpose(0, 2, 1) @ dz
            dh_next, dc_next = dz @ self.recur.transpose(0, 2, 1), dc * f
        d_embed = np.empty_like(self.embed)
        for d, codes_ in enumerate((x.T, x[:, ::-1].T)):
            which = (codes_.reshape(-1, 1) == np.arange(ALPHABET + 1)).astype(dzs.dtype)
            d_embed[d] = which.T @ dzs[:, d].reshape(-1, 4 * n)
        return [d_embed, d_recur, d_out]


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def crf_slopes(scores: np.ndarray, tags: np.ndarray, trans: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean log loss of the true tags, and its slopes in scores and transitions."""
    batch, width, k = scores.shape
    alpha, beta = np.empty_like(scores), np.zeros_like(scores)
    alpha[:, 0] = scores[:, 0]
    for t in range(1, width):
        alpha[:, t] = scores[:, t] + _logsumexp(alpha[:, t - 1, :, None] + trans, 1)
    for t in range(width - 2, -1, -1):
        beta[:, t] = _logsumexp(trans + (scores[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
    norm = _logsumexp(alpha[:, -1], 1)
    marginal = np.exp(alpha + beta - norm[:, None, None])
    d_trans = np.zeros((k, k))
    for t in range(1, width):
        pair = alpha[:, t - 1, :, None] + trans + (scores[:, t] + beta[:, t])[:, None, :] - norm[:, None, None]
        d_trans += np.exp(pair).sum(axis=0)
    np.subtract.at(d_trans, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), 1)
    rows, cols = np.arange(batch)[:, None], np.arange(width)
    gold = scores[rows, cols, tags].sum(axis=1) + trans[tags[:, :-1], tags[:, 1:]].sum(axis=1)
    marginal[rows, cols, tags] -= 1
    return float((norm - gold).mean()), marginal / batch, d_trans / batch


def viterbi(scores: np.ndarray, trans: np.ndarray) -> np.ndarray:
    batch, width, _ = scores.shape
    best, back = scores[:, 0], np.empty(scores.shape, np.int8)
    for t in range(1, width):
        step = best[:, :, None] + trans
        back[:, t] = step.argmax(axis=1)
        best = step.max(axis=1) + scores[:, t]
    tags = np.empty((batch, width), np.int64)
    tags[:, -1] = best.argmax(axis=1)
    for t in range(width - 1, 0, -1):
        tags[:, t - 1] = back[np.arange(batch), t, tags[:, t]]
    return tags


# ---------------------------------------------------------------------------------- training

_FILL = "of and the to in la de der die que el que an is for this that with number call write server pay le les un".split()


def _with_luhn(digits: str) -> str:
    """The digits with a last one that makes their Luhn sum right."""
    return next(digits + c for c in "0123456789" if _luhn(digits + c))


#: What may stand around an ``@`` or a full stop, and between groups of digits, in the values that the network learns
#: from; the tests hold others out.
AROUND = (("", ""), ("", ""), ("", ""), (" ", " "), ("[", "]"), ("(", ")"), (" [", "] "), (" (", ") "))
BETWEEN = ("", "-", " ", ".", "/", "  ", " - ", ",", "_", ":", "|", "--")


def _made_up(rng: np.random.Generator, around: tuple = AROUND, between: tuple = BETWEEN) -> tuple[str, int]:
    """A value of one of the kinds in a format of the base patterns or a variant, or (kind -1) something
    that looks a little like one."""
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    letters = lambda n: "".join(chr(97 + i) for i in rng.integers(0, 26, n))
    pick = lambda *xs: xs[rng.integers(0, len(xs))]

    def wrapped(core: str) -> str:
        before, behind = pick(*around)
        return before + core + behind

    kind = (0, 0, 1, 1, 2, 2, 3, 3, 4, 5, 5, 5)[rng.integers(0, 12)]
    if kind == 0:
        host = [letters(rng.integers(3, 8)) + pick("", digits(1)), *pick(("example", "com"), ("example", "org"), ("com",), ("net",), ("co", "uk"), ("de",), ("info",), (letters(2),), (letters(4), letters(3)))]
        return f"{letters(rng.integers(2, 9))}{pick('', '.', '_', '-')}{pick('', digits(2), letters(3))}{wrapped('@')}{wrapped('.').join(host)}", 0
    if kind == 1:
        return wrapped(".").join(str(n) for n in (rng.integers(0, 256, 4) if rng.random() < 0.7 else rng.integers(0, 32, 4))), 1
    if kind == 2:
        head, groups = pick(("4", (4, 4, 4, 4)), ("5" + str(rng.integers(1, 6)), (4, 4, 4, 4)), ("37", (4, 6, 5)), ("6011", (4, 4, 4, 4)), ("4", (4, 4, 4, 1)))
        number, ends = _with_luhn(head + digits(sum(groups) - 1 - len(head))), np.cumsum((0, *groups))
        return pick(*between).join(number[x:y] for x, y in zip(ends, ends[1:], strict=False)), 2
    if kind == 3:
        a, b, c, sep = digits(3), digits(3), digits(4), pick(*[x for x in between if x and "," not in x])
        front = pick(f"+{digits(rng.integers(1, 3))}{sep}{a}", f"+1 ({a})", f"({a})", f"0{a}", a, f"00{sep}{digits(2)}{sep}{a}")
        return front + pick(sep, sep, " ") + pick(f"{b}{sep}{c}", f"{c}{sep}{b}", f"{digits(2)}{sep}{digits(2)}{sep}{b}"), 3
    if kind == 4:
        return f'token = "{"".join(rng.choice(list("0123456789abcdef"), 40))}"', -1
    wrong = _with_luhn("5" + digits(14))
    wrong = wrong[:-1] + str((int(wrong[-1]) + 1 + int(rng.integers(0, 8))) % 10)
    return pick(
        f"version {digits(1)}.{digits(1)}", digits(rng.integers(1, 9)), f"{digits(2)}.{digits(2)}.{digits(4)}", f"{digits(1)},{digits(3)}", f"AKIA{letters(12).upper()}{digits(3)}",
        f"password={digits(3)}{letters(4)}{digits(6)}", f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}:{digits(2)}:{digits(2)}", f"@{letters(5)}", f"{letters(4)} @ {digits(2)}",
        digits(rng.integers(10, 16)), wrong, f"978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}", f"{digits(1)}.{digits(1)}.{digits(1)}", f"{letters(5)}[{digits(1)}].{letters(4)}({digits(2)})",
    ), -1


def examples(texts: list[str], rng: np.random.Generator, n: int, width: int = TRAIN_WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """``n`` windows and their tags: a third around the base spans of the texts, the others with made-up values."""
    x, y = np.full((n, width), PAD), np.zeros((n, width), np.int64)
    real = [(t, s) for t in texts if _ANCHOR.search(t) for s in [base_spans(t)]]
    for row in range(n):
        if row % 3 == 0 and real:
            text, spans = real[rng.integers(0, len(real))]
            anchors = [m.start() for m in _ANCHOR.finditer(text)]
            at = max(0, anchors[rng.integers(0, len(anchors))] - int(rng.integers(0, width)))
        else:
            words, spans, text, at = [], [], "", 0
            while len(text) < width:
                if rng.random() < 0.25:
                    value, kind = _made_up(rng)
                    if kind >= 0:
                        spans.append((kind, len(text), len(text) + len(value)))
                    text += value + (" ", " ", ". ", ", ", "\n")[rng.integers(0, 5)]
                else:
                    text += _FILL[rng.integers(0, len(_FILL))] + " "
        part = codes(text[at : at + width])
        x[row, : len(part)] = part
        for kind, a, b in spans:
            a, b = max(a - at, 0) if a >= at else a - at, min(b - at, width)
            if b > 0 and a < width:
                y[row, max(a, 0) : b] = 2 + 2 * kind
                if a >= 0:
                    y[row, a] = 1 + 2 * kind
    return x, y


def fit(texts: list[str], steps: int = 450, batch: int = 64, rate: float = 0.02, seed: int = 9) -> Network:
    """Adam on the CRF's log loss, over batches drawn from a set of windows."""
    net, rng = Network.fresh(seed), np.random.default_rng(seed)
    m, v = [np.zeros_like(p) for p in net.params()], [np.zeros_like(p) for p in net.params()]
    xs, ys = examples(texts, rng, 150 * batch)
    for step in range(1, steps + 1):
        rows = rng.integers(0, len(xs), batch)
        x, y = xs[rows], ys[rows]
        scores, memo = net.forward(x, True)
        _, slope, d_trans = crf_slopes(scores, y, net.trans)
        pull = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, (p, g) in enumerate(zip(net.params(), [*net.backward(x, memo, slope), d_trans], strict=True)):
            g = np.clip(g, -1, 1)
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g**2
            p -= (pull * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(p.dtype)
    return net


def train(docs: DataFrame, n: int = SAMPLE) -> Network:
    """Fit on the base spans of at most ``n`` sampled texts, in one task (the sample is bounded in rows and
    bytes). Fit once and pass the network on to use it again."""
    texts = id_text(docs)
    sample = sampled_rows(texts, sample_ids(texts, "doc_id", n, 10)).where(F.rlike("text", F.lit("[0-9@]"))).repartition(1).sortWithinPartitions("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = fit([t for b in batches for t in b.column("text").to_pylist()])
        yield pa.RecordBatch.from_arrays([pa.array([p.tobytes()]) for p in net.params()], names=["embed", "recur", "out", "trans"])

    found = sample.mapInArrow(tidied(run), "embed binary, recur binary, out binary, trans binary").first()
    if found is None:  # no rows, no task
        return fit([])
    shapes = [p.shape for p in Network.fresh().params()]
    return Network(*(np.frombuffer(raw, np.float32).reshape(shape).copy() for raw, shape in zip(found, shapes, strict=True)))


# ---------------------------------------------------------------------------------- decoding


def windows_of(text: str) -> list[int]:
    """Starts of the windows that hold a digit or ``@``."""
    found: set[int] = set()
    for m in _ANCHOR.finditer(text):
        k = m.start() // STRIDE
        found.update((k * STRIDE, max(k - 1, 0) * STRIDE))
    return sorted(found)


def _decoded(tags: np.ndarray) -> list[Span]:
    found, at = [], 0
    while at < len(tags):
        kind = (tags[at] - 1) // 2
        end = at + 1
        if tags[at]:
            while end < len(tags) and tags[end] == 2 + 2 * kind:
                end += 1
            found.append((int(kind), at, end))
        at = end
    return found


def network_spans(net: Network, texts: list[str], batch: int = 256) -> list[list[Span]]:
    """Reconciled spans of every text's windows, their ends moved to those of words and numbers."""
    where = [(i, at) for i, t in enumerate(texts) for at in windows_of(t)]
    whole: list[list[Span]] = [[] for _ in texts]
    cut: list[list[Span]] = [[] for _ in texts]
    for first in range(0, len(where), batch):
        part = where[first : first + batch]
        x = np.full((len(part), WIDTH), PAD)
        for r, (i, at) in enumerate(part):
            c = codes(texts[i][at : at + WIDTH])
            x[r, : len(c)] = c
        tags = viterbi(net.forward(x)[0], net.trans)
        for r, (i, at) in enumerate(part):
            for kind, a, b in _decoded(tags[r]):
                at_border = a == 0 < at or b == WIDTH < len(texts[i]) - at
                (cut if at_border else whole)[i].append((kind, a + at, min(b + at, len(texts[i]))))
    return [[s for s in (tidy(t, s) for s in reconcile(w, c)) if s] for t, w, c in zip(texts, whole, cut, strict=True)]


def reconcile(whole: list[Span], cut: list[Span] = ()) -> list[Span]:
    """Spans that a border cuts give way to whole ones they overlap. Of those left, spans of one kind that
    overlap are joined; of different kinds the longer stays (then the earlier, then the kind listed first)."""
    left = sorted({c for c in cut if all(c[2] <= a or c[1] >= b for _, a, b in whole)} | set(whole))
    joined: list[list[int]] = []
    for kind, a, b in left:
        if joined and joined[-1][0] == kind and a < joined[-1][2]:
            joined[-1][2] = max(joined[-1][2], b)
        else:
            joined.append([kind, a, b])
    kept: list[Span] = []
    for kind, a, b in sorted(joined, key=lambda s: (s[1] - s[2], s[1], s[0])):
        if all(b <= x or a >= y for _, x, y in kept):
            kept.append((kind, a, b))
    return sorted(kept)


def tidy(text: str, span: Span) -> Span | None:
    """The span without blanks and stops around it, its ends moved out to those of runs of letters or digits."""
    kind, a, b = span
    while a < b and (text[a].isspace() or text[a] in ",;:"):
        a += 1
    while b > a and (text[b - 1].isspace() or text[b - 1] in ".,;:"):
        b -= 1
    while 0 < a < b and text[a].isalnum() and text[a - 1].isalnum():
        a -= 1
    while a < b < len(text) and text[b - 1].isalnum() and text[b].isalnum():
        b += 1
    return (kind, a, b) if _ANCHOR.search(text, a, b) else None


_STOP = r"[^0-9A-Za-z.@]{0,2}\.[^0-9A-Za-z.@]{0,2}"
_PLAUSIBLE = (
    re.compile(rf"[A-Za-z0-9._%+-]+[^0-9A-Za-z.@]{{0,2}}@[^0-9A-Za-z.@]{{0,2}}[A-Za-z0-9-]+({_STOP}[A-Za-z0-9-]+)+"),
    re.compile(rf"[0-9]{{1,3}}({_STOP}[0-9]{{1,3}}){{3}}"),
    re.compile(r"[0-9]([^0-9A-Za-z]{0,3}[0-9]){12,18}"),
    re.compile(r"[+(]?[0-9]+([^0-9A-Za-z]{1,3}[0-9]+)+"),
)


def plausible(kind: int, text: str) -> bool:
    """Has a span the parts of its kind?"""
    if not _PLAUSIBLE[kind].fullmatch(text):
        return False
    numbers = re.findall("[0-9]+", text)
    digits = "".join(numbers)
    return (True, all(int(n) <= 255 for n in numbers), _luhn(digits), 9 <= len(digits) <= 15 and len(numbers) > 2)[kind]


def settled(text: str, span: Span) -> Span | None:
    """A span of the network alone counts if it has the parts of its kind; one that is too long for a phone
    number and has those of a card is a card."""
    kind, a, b = span
    return next(((k, a, b) for k in ((kind, 2) if kind == 3 else (kind,)) if plausible(k, text[a:b])), None)


def all_spans(net: Network, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and all spans of each text: a network span is added where it overlaps no base span."""
    found = []
    for text, extra in zip(texts, network_spans(net, texts), strict=True):
        base = base_spans(text) if _ANCHOR.search(text) else []
        more = [s for s in (settled(text, x) for x in extra) if s and all(s[2] <= a or s[1] >= b for _, a, b in base)]
        found.append((base, sorted(base + more)))
    return found


FOUND_SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"


def detect(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """Spans of every row (code points, end exclusive), counts of the base spans by kind and their digest.

    Null text counts as empty and has no spans; repeated rows stay; an empty table gives an empty one;
    texts of any length are read as wholes. Where spans tie, ``reconcile`` says which stays.
    """
    net = net or train(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = all_spans(net, b.column("text").to_pylist())
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in range(len(KINDS))]
            digest = pa.array([hashlib.sha256(span_text(base).encode()).hexdigest() for base, _ in found], pa.string())
            every = pa.array([span_text(spans) for _, spans in found], pa.string())
            n = pa.array([len(spans) for _, spans in found], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *counts, digest, every, n], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"])

    small_batches(docs.sparkSession)
    return id_text(docs).mapInArrow(tidied(run), FOUND_SCHEMA)


def _masked(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind; of spans that overlap, the stretch by the first's kind."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, net: Network | None = None, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with personal data replaced by ``[KIND]`` and the length column, if any, set anew where
    a text has changed; null texts stay null, repeated rows stay, further columns are unchanged, an empty
    table gives an empty one."""
    net = net or train(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(text_col).to_pylist()
            found = all_spans(net, [t or "" for t in texts])
            masked = [t if t is None else _masked(t, spans) for t, (_, spans) in zip(texts, found, strict=True)]
            cols = list(b.columns)
            cols[b.schema.get_field_index(text_col)] = pa.array(masked, b.schema.field(text_col).type)
            at = b.schema.get_field_index(length_col)
            if at >= 0:
                old = cols[at].to_pylist()
                cols[at] = pa.array([o if m == t else len(m) for o, m, t in zip(old, masked, texts, strict=True)], b.schema.field(length_col).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    small_batches(docs.sparkSession)
    return docs.mapInArrow(tidied(run), docs.schema)
