"""Personal data by fixed patterns and a character-level bidirectional LSTM with CRF transitions.

The network is trained in numpy from labelled spans: samples are cut from a bounded number of texts,
where the fixed patterns label what they match, and made-up addresses and numbers in more forms than
the patterns know are put between the words with their labels; so are numbers that are no personal
data. Texts are read in overlapping windows; each window is decoded by Viterbi, and the windows are
reconciled globally: every character takes its label from the window that holds it most centrally,
and spans are runs of labels over the whole text, so one may cross any number of windows.

A span of any kind holds a digit or an ``@``, so it lies in a window whose own part holds one, or
runs on from there. Windows with neither are computed only where a run of labels reaches their edge.

Spans of the patterns always stay. A span of the network is added if it overlaps none of them and
has the digits (or the ``@``) that its kind asks for and no letter or digit right beside it.

Defined results: a null or empty text has no spans; repeated rows are read each; very long texts are
read whole; without any sample text the network learns from made-up samples alone; an empty table
gives an empty result; an input column named like a new one gives way to it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from random import Random

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import with_columns

KINDS = ["email", "ip", "card", "phone"]
CORE, MARGIN, HIDDEN = 64, 24, 12
WINDOW = CORE + 2 * MARGIN
SAMPLE_TEXTS, SAMPLE_WINDOWS, STEPS, BATCH = 400, 2400, 160, 64
LABELS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
CODES = 100  # 0 padding, 1-95 printable ASCII, 96 white space, 97 other letter, 98 other digit, 99 other

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")
_code_tables: list[np.ndarray] = []
_mark_tables: list[np.ndarray] = []


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping; found from each ``@``, so that long words cost no more than their length."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            yield start, domain.end()
            free = domain.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order."""
    if not text or not _TRIGGER.search(text):
        return []
    out = [(s, 0, e) for s, e in emails(text)]
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = re.sub("[ -]", "", m[0]) if m.end() - m.start() < 64 else ""
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def encode(text: str) -> np.ndarray:
    """Character classes of a text."""
    if not _code_tables:
        table = np.full(0x110000, 99, np.uint8)
        table[32:127] = np.arange(1, 96)
        for c in range(128, 0x3000):
            table[c] = 97 if chr(c).isalpha() else 98 if chr(c).isdigit() else 99
        table[0x3000:0xE000] = 97
        table[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x3000]] = 96
        _code_tables.append(table)
    return _code_tables[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def marked(text: str) -> np.ndarray:
    """Whether each character is an ``@`` or a digit of any script, as :func:`fits` counts them."""
    if not _mark_tables:
        table = np.zeros(0x110000, bool)
        table[[c for c in range(0x110000) if c == 64 or chr(c).isdigit()]] = True
        _mark_tables.append(table)
    return _mark_tables[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


@dataclass
class Tagger:
    """Parameters by name; ``f`` and ``b`` are the directions."""

    p: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def fresh(seed: int = 7, hidden: int = HIDDEN) -> Tagger:
        rng = np.random.default_rng(seed)
        p = {}
        for d in "fb":
            p[f"x{d}"] = rng.normal(0, 0.3, (CODES, 4 * hidden)).astype(np.float32)
            p[f"h{d}"] = rng.normal(0, 0.25, (hidden, 4 * hidden)).astype(np.float32)
            p[f"x{d}"][:, hidden : 2 * hidden] += 1  # forget gates start open
        p["out"] = rng.normal(0, 0.3, (2 * hidden, LABELS)).astype(np.float32)
        p["bias"] = np.zeros(LABELS, np.float32)
        p["trans"] = np.zeros((LABELS, LABELS), np.float32)
        return Tagger(p)

    def run(self, codes: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states [time, batch, hidden] of one direction for codes [batch, time]."""
        n, steps = codes.shape
        hidden = self.p["h" + d].shape[0]
        h = c = np.zeros((n, hidden), np.float32)
        out = np.empty((steps, n, hidden), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = self.p["x" + d][codes[:, t]] + h @ self.p["h" + d]
            gates = _sigmoid(z[:, : 3 * hidden])
            i, f, o = gates[:, :hidden], gates[:, hidden : 2 * hidden], gates[:, 2 * hidden :]
            g = np.tanh(z[:, 3 * hidden :])
            before, last = c, h
            c = f * c + i * g
            th = np.tanh(c)
            h = o * th
            out[t] = h
            if keep is not None:
                keep.append((t, i, f, o, g, before, th, last))
        return out

    def emissions(self, codes: np.ndarray) -> np.ndarray:
        both = np.concatenate([self.run(codes, "f"), self.run(codes, "b")], axis=2)
        return both @ self.p["out"] + self.p["bias"]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """Most likely labels [batch, time]."""
        e, allowed = self.emissions(codes), self.p["trans"] + _FORBIDDEN
        steps, n, _ = e.shape
        back = np.empty((steps, n, LABELS), np.int8)
        score = e[0] + _FORBIDDEN[0]
        for t in range(1, steps):
            paths = score[:, :, None] + allowed
            back[t] = paths.argmax(1)
            score = paths.max(1) + e[t]
        labels = np.empty((n, steps), np.int8)
        labels[:, -1] = score.argmax(1)
        rows = np.arange(n)
        for t in range(steps - 1, 0, -1):
            labels[:, t - 1] = back[t][rows, labels[:, t]]
        return labels

    def gradients(self, codes: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean CRF loss of a batch, and its gradients."""
        n, steps = codes.shape
        hidden = self.p["hf"].shape[0]
        kept: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([self.run(codes, d, kept[d]) for d in "fb"], axis=2)
        e, trans = both @ self.p["out"] + self.p["bias"], self.p["trans"]
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for t in range(1, steps):
            alpha[t] = _lse(alpha[t - 1][:, :, None] + trans, 1) + e[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = _lse(trans + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        total = _lse(alpha[-1], 1)
        rows, times = np.arange(n), np.arange(steps)
        score = e[times[:, None], rows, gold.T].sum(0) + trans[gold[:, :-1], gold[:, 1:]].sum(1)
        de = np.exp(alpha + beta - total[:, None])
        de[times[:, None], rows, gold.T] -= 1
        de /= n
        dtrans = np.zeros_like(trans)
        for t in range(1, steps):
            dtrans += np.exp(alpha[t - 1][:, :, None] + trans + (e[t] + beta[t])[:, None, :] - total[:, None, None]).sum(0)
        np.add.at(dtrans, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), -1)
        grads = {"trans": dtrans / n, "bias": de.sum((0, 1)), "out": np.einsum("tnh,tnl->hl", both, de)}
        dboth = de @ self.p["out"].T
        for k, d in enumerate("fb"):
            dx, dh_w = np.zeros_like(self.p["x" + d]), np.zeros_like(self.p["h" + d])
            dh = dc = np.zeros((n, hidden), np.float32)
            for t, i, f, o, g, before, th, last in reversed(kept[d]):
                dh = dh + dboth[t][:, k * hidden : (k + 1) * hidden]
                dc = dc + dh * o * (1 - th * th)
                dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - g * g)], axis=1)
                np.add.at(dx, codes[:, t], dz)
                dh_w += last.T @ dz
                dh, dc = dz @ self.p["h" + d].T, dc * f
            grads["x" + d], grads["h" + d] = dx, dh_w
        return float((total - score).mean()), grads

    def fit(self, codes: np.ndarray, gold: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = 0.03, seed: int = 11) -> Tagger:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        for step in range(1, steps + 1):
            rows = rng.integers(0, len(codes), batch)
            _, grads = self.gradients(codes[rows], gold[rows])
            now = rate * min(1, 2 * (1 - step / (steps + 1)))
            for k, g in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return self


def _forbidden() -> np.ndarray:
    """An inside label follows only the begin or inside label of its kind; row 0 also holds for starts, where windows may cut a span."""
    out = np.zeros((LABELS, LABELS), np.float32)
    for kind in range(len(KINDS)):
        inside = 2 + 2 * kind
        out[:, inside] = -1e4
        out[[inside - 1, inside], inside] = 0
    return out


_FORBIDDEN = _forbidden()


def made_up(rng: Random) -> tuple[str, int | None]:
    """An address or number with its kind, or a number that is no personal data (None)."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda a, b: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(a, b)))
    what = rng.randrange(9)
    if what < 2:
        user = rng.choice([word(3, 9), f"{word(2, 6)}.{word(2, 8)}", f"{word(2, 6)}_{digits(2)}", f"{word(3, 7)}.{digits(2)}", f"{word(1, 3)}+{word(2, 4)}"])
        return f"{user}@{rng.choice([word(3, 8) + rng.choice(['.com', '.org', '.net', '.de']), f'{word(3, 6)}{digits(1)}.{word(3, 8)}.com', 'localhost', word(4, 8)])}", 0
    if what == 2:
        return ".".join(str(rng.randint(0, 255)) for _ in range(4)), 1
    if what == 3:
        sep = rng.choice(["", " ", "-", "."])
        return rng.choice([sep.join(digits(4) for _ in range(4)), f"{digits(4)}{sep}{digits(6)}{sep}{digits(5)}"]), 2
    if what < 6:
        a, b, c = digits(3), digits(3), digits(4)
        return rng.choice([f"+{rng.randint(1, 99)} ({a}) {b}-{c}", f"+{rng.randint(1, 99)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{rng.randint(1, 9)}{a}{b}{c}", f"00{rng.randint(10, 99)} {a} {b}{c}"]), 3
    return rng.choice([f"20{digits(2)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}", f"{rng.randint(1, 99)},{digits(3)}.{digits(2)}", f"v{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}", digits(rng.randint(1, 7)), f"{rng.randint(10, 23)}:{digits(2)}:{digits(2)}", f"INV-{digits(6)}", f"#{digits(5)}", f"@{word(3, 8)}", f"{digits(3)}{word(2, 5)}{digits(3)}", f"{rng.randint(1, 9)}.{digits(3)}"]), None


def training_windows(texts: list[str], windows: int = SAMPLE_WINDOWS, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Codes and labels of windows: stretches of the texts with their pattern spans, and made-up items between words."""
    rng = Random(seed)
    plain = [t for t in texts if len(t) > 20] or ["some plain words of no text in particular, and then again. "]
    known = [(t, s) for t in plain if (s := base_spans(t))]
    codes, gold = np.zeros((windows, WINDOW), np.uint8), np.zeros((windows, WINDOW), np.int64)
    for row in range(windows):
        if known and row % 6 == 0:
            text, spans = rng.choice(known)
            at = max(0, rng.choice(spans)[0] - rng.randint(0, WINDOW - 10))
        else:
            text, spans, at = "", [], 0
            while len(text) < WINDOW:
                source = rng.choice(plain)
                cut = rng.randrange(len(source))
                text += _TRIGGER.sub("", source[cut : cut + rng.randint(5, 50)]) + rng.choice([" ", " ", "\n", ": ", " ("])
                item, kind = made_up(rng)
                if kind is not None:
                    spans.append((len(text), kind, len(text) + len(item)))
                text += item + rng.choice([" ", " ", ", ", ". ", "\n", ")"])
        part = encode(text[at : at + WINDOW])
        codes[row, : len(part)] = part
        for start, kind, end in spans:
            if end > at and start < at + WINDOW:
                gold[row, max(0, start - at) : end - at] = 2 + 2 * kind
                gold[row, max(0, start - at)] = 1 + 2 * kind
    return codes, gold


def train(docs: DataFrame, key: str, text: str, texts: int = SAMPLE_TEXTS) -> Tagger:
    """Fit on a hash sample of about ``texts`` texts, at most four times as many, and at most 20,000 characters of each."""
    share = max(1, min(1 << 20, (texts << 20) // max(1, docs.count()) + 1))
    place = F.pmod(F.xxhash64(key, text), F.lit(1 << 20))
    rows = docs.where(place < share).select(F.substring(text, 1, 20000).alias("t"), place.alias("place")).orderBy("place", "t").limit(4 * texts).collect()
    return Tagger.fresh().fit(*training_windows(sorted(r.t for r in rows if r.t)))


def added_spans(tagger: Tagger, texts: list[str | None], base: list[list[tuple[int, int, int]]], batch: int = 512) -> list[list[tuple[int, int, int]]]:
    """Spans of the network that overlap no pattern span, for each text.

    Starts from the tiles that hold a digit or ``@`` and goes on to the next tile wherever a label
    other than outside stands at an edge, which gives the spans that computing every tile gives.
    """
    labels: dict[int, np.ndarray] = {}
    places: list[tuple[int, int]] = []
    coded: dict[int, np.ndarray] = {}
    known: dict[int, np.ndarray] = {}
    for i, text in enumerate(texts):
        if text and (marks := marked(text)).any():
            codes = encode(text)
            tiles = -(-len(codes) // CORE)
            padded = np.zeros(tiles * CORE + 2 * MARGIN, np.uint8)
            padded[MARGIN : MARGIN + len(codes)] = codes
            coded[i], labels[i] = padded, np.zeros(tiles * CORE, np.int8)
            known[i] = np.zeros(tiles, bool)
            known[i][np.flatnonzero(marks) // CORE] = True
            places += [(i, int(tile)) for tile in np.flatnonzero(known[i])]
    while places:
        reached: list[tuple[int, int]] = []
        for at in range(0, len(places), batch):
            some = places[at : at + batch]
            decoded = tagger.decode(np.stack([coded[i][t * CORE : t * CORE + WINDOW] for i, t in some]))
            for (i, t), row in zip(some, decoded, strict=True):
                own = labels[i][t * CORE : (t + 1) * CORE] = row[MARGIN : MARGIN + CORE]
                for edge, near in ((0, t - 1), (-1, t + 1)):
                    if own[edge] and 0 <= near < len(known[i]) and not known[i][near]:
                        known[i][near] = True
                        reached.append((i, near))
        places = reached
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for i, row in labels.items():
        for start, kind, end in label_runs(row):
            text = texts[i]
            apart = not text[start - 1 : start].isalnum() and not text[end : end + 1].isalnum()
            if apart and fits(kind, text[start:end]) and not any(s < end and start < e for s, _, e in base[i]):
                out[i].append((start, kind, end))
    return out


def label_runs(labels: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Runs of one kind; a begin label within a run of its kind ends it."""
    places = np.flatnonzero(labels)
    start = None
    for at in places:
        kind = (labels[at] - 1) // 2
        if start is not None and (at != last + 1 or kind != held or labels[at] % 2 == 1):
            yield int(start), int(held), int(last) + 1
            start = None
        if start is None:
            start, held = at, kind
        last = at
    if start is not None:
        yield int(start), int(held), int(last) + 1


def fits(kind: int, text: str) -> bool:
    digits = sum(c.isdigit() for c in text)
    if kind == 0:
        return "@" in text[1:-1]
    if kind == 1:
        return len([p for p in re.split(r"[^0-9]+", text) if p and int(p[:9]) <= 255]) == 4
    return 12 <= digits <= 19 if kind == 2 else 9 <= digits <= 15


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def find_personal_data(docs: DataFrame, tagger: Tagger, text: str = "text") -> DataFrame:
    """Add n_email, n_ip, n_card, n_phone and base_sha256 of the pattern spans, and spans, the text of all spans."""
    sent = docs.sparkSession.sparkContext.broadcast(tagger)
    fields = [(f"n_{k}", T.LongType()) for k in KINDS] + [("base_sha256", T.StringType()), ("spans", T.StringType())]

    def work(texts: list[str | None]) -> list[list]:
        base = [base_spans(t) for t in texts]
        more = added_spans(sent.value, texts, base)
        counts = [[sum(kind == k for _, kind, _ in spans) for spans in base] for k in range(len(KINDS))]
        return [*counts, [hashlib.sha256(shown(b).encode()).hexdigest() for b in base], [shown(b + a) for b, a in zip(base, more, strict=True)]]

    return with_columns(docs, text, fields, work)


def redact(docs: DataFrame, tagger: Tagger, text: str = "text", length: str | None = None) -> DataFrame:
    """Replace every span by its kind in angle brackets; spans that overlap are one, of the first one's kind.

    Null texts stay null. ``length`` names a column that gets the new length of texts that aren't null.
    """
    sent = docs.sparkSession.sparkContext.broadcast(tagger)

    def one(t: str | None, spans: list[tuple[int, int, int]]) -> str | None:
        if not spans:
            return t
        parts, at, upto = [], 0, -1
        for start, kind, end in sorted(spans):
            if start >= max(upto, 0):
                parts += [t[at:start], f"<{KINDS[kind].upper()}>"]
            upto = max(upto, end)
            at = upto
        return "".join([*parts, t[at:]])

    def work(texts: list[str | None]) -> list[list]:
        base = [base_spans(t) for t in texts]
        return [[one(t, b + a) for t, b, a in zip(texts, base, added_spans(sent.value, texts, base), strict=True)]]

    made = "__redacted"
    out = with_columns(docs, text, [(made, T.StringType())], work)
    new = {text: F.col(made)} | ({length: F.coalesce(F.char_length(made).cast(docs.schema[length].dataType), F.col(length))} if length else {})
    return out.withColumns(new).select(docs.columns)
