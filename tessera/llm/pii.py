"""Personal data: fixed patterns, plus a character BiLSTM-CRF trained here.

The fixed patterns find the base spans. A bidirectional LSTM over character
classes with CRF transitions, written in numpy, is trained from labelled
windows of the corpus: base spans are labels as they are, and rewritten in
forms that the patterns miss (``rewritten``: bracketed or spelled-out
separators, other or wider ones, telephone numbers without ``+``). It tags the
neighbourhood of every cue: overlapping windows of the whole text are decoded
by Viterbi, pieces of a span that windows cut are joined, and all spans are
reconciled over the text by weighted interval scheduling. Spans that touch no
base span, have a form of their kind and a sufficient margin are added; base
spans always stay.

Every form holds a cue by definition (a digit, ``@``, a bracketed "at", or
"dot") and has at most ``MAX_SPAN`` characters, so a window that is not near a
cue cannot hold a part of an accepted span, and leaving it out changes nothing
(``decode_all`` tests that).

Defined cases: null text is empty and has no spans; ties between spans go to
the earlier start, then to the kind listed first; repeated rows are treated
each; very long texts are searched whole, in time proportional to their
length but for sorting their spans; with fewer than ``MIN_TRAIN`` labelled
windows (or none) only the base spans are found; an empty table gives an empty
result; ``mask_pii`` keeps all columns, ``pii_digests`` reads two.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import tidy

KINDS = ("email", "ip", "card", "phone")
_RANK = {k: i for i, k in enumerate(KINDS)}
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_TAIL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: The fixed patterns; look-behind and possessive repeats only save retries inside one run of digits.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SPELLED = re.compile(r"[\[({<]at[\])}>]|dot", re.IGNORECASE)
_CUE = re.compile(r"[0-9@]|" + _SPELLED.pattern, re.IGNORECASE)
_CUE_BYTES = re.compile(_CUE.pattern.encode(), re.IGNORECASE)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start and kind."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        left = at
        while left > done and text[left - 1] in _LOCAL:
            left -= 1
        m = _DOMAIN.match(text, at + 1) if left < at else None
        if m:
            out.append((left, m.end(), "email"))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((m.start(), m.end(), "phone"))
    out.sort(key=lambda s: (s[0], _RANK[s[2]]))
    return out


# ---------------------------------------------------------------- the tagger

WINDOW, STRIDE = 96, 48
HIDDEN, EMBED = 16, 8
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
#: Bound of the training sample, and the least of it to train at all.
MAX_TRAIN, MIN_TRAIN = 400, 20
STEPS, BATCH, RATE = 240, 32, 0.02
#: Rewritten copies of each labelled window with a span.
COPIES = 3
#: Longest added span.
MAX_SPAN = WINDOW + STRIDE
#: Least margin per character of an added span's path (emissions and transitions) over one that stays outside.
MARGIN = 0.25


def classes() -> np.ndarray:
    """Class of each byte value; every code point beyond ASCII has class 1."""
    table = np.ones(256, np.int64)
    for c in range(128):
        ch = chr(c)
        table[c] = 2 if ch.islower() else 3 if ch.isupper() else 4 if ch.isdigit() else 5 if ch in " \t\r\x0b\x0c" else 6 if ch == "\n" else 7
    for i, ch in enumerate("@.+-()_%:/=#,\"'"):
        table[ord(ch)] = 8 + i
    return table


CLASSES = classes()
N_CLASSES = int(CLASSES.max()) + 1  # class 0 pads


def encode(text: str) -> np.ndarray:
    """Classes of the characters of a text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return CLASSES[np.minimum(points, 255)]


class BiLstmCrf:
    """Tagger of windows; parameters are a dict of float32 arrays."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        h, e = HIDDEN, EMBED
        shapes = {"E": (N_CLASSES, e), "O": (2 * h, TAGS), "ob": (TAGS,), "T": (TAGS, TAGS)}
        for d in "fb":
            shapes |= {f"W{d}": (e, 4 * h), f"U{d}": (h, 4 * h), f"c{d}": (4 * h,)}
        self.p = {k: (r.standard_normal(s) * (0.3 if len(s) > 1 else 0)).astype(np.float32) for k, s in shapes.items()}
        for d in "fb":
            self.p[f"c{d}"][h : 2 * h] = 1.0  # remember at first

    def _direction(self, x: np.ndarray, d: str, keep: list | None):
        h, p = HIDDEN, self.p
        n, t = x.shape
        table = p["E"] @ p[f"W{d}"] + p[f"c{d}"]
        hs = np.zeros((t, n, h), np.float32)
        hid, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            z = table[x[:, i]] + hid @ p[f"U{d}"]
            g = np.tanh(z[:, 3 * h :])
            s = 1 / (1 + np.exp(-z[:, : 3 * h]))
            old, before = cell, hid
            cell = s[:, h : 2 * h] * old + s[:, :h] * g
            out = np.tanh(cell)
            hid = s[:, 2 * h :] * out
            hs[i] = hid
            if keep is not None:
                keep.append((i, s, g, old, out, before))
        return hs

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Scores (time, window, tag)."""
        both = np.concatenate([self._direction(x, "f", None), self._direction(x, "b", None)], axis=2)
        return both @ self.p["O"] + self.p["ob"]

    def train(self, x: np.ndarray, y: np.ndarray) -> None:
        """Adam on the CRF's negative log-likelihood; x and y are (window, time)."""
        r, m, v = np.random.default_rng(11), {}, {}
        for step in range(1, STEPS + 1):
            pick = r.integers(0, len(x), min(BATCH, len(x)))
            grads = self.gradients(x[pick], y[pick])
            norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
            for k, g in grads.items():
                g = g * min(1, 5 / max(norm, 1e-9))
                m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                v[k] = 0.99 * v.get(k, 0) + 0.01 * g * g
                self.p[k] -= (RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)

    def loss(self, x: np.ndarray, y: np.ndarray) -> float:
        """Mean negative log-likelihood of a window."""
        em, tr = self.emissions(x), self.p["T"]
        t, n = em.shape[:2]
        gold, rows = em[0][np.arange(n), y[:, 0]].astype(float), np.arange(n)
        a = em[0]
        for i in range(1, t):
            gold += em[i][rows, y[:, i]] + tr[y[:, i - 1], y[:, i]]
            a = _logsum(a[:, :, None] + tr, 1) + em[i]
        return float((_logsum(a, 1) - gold).mean())

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict:
        p, h = self.p, HIDDEN
        kept = {"f": [], "b": []}
        hs = {d: self._direction(x, d, kept[d]) for d in "fb"}
        both = np.concatenate([hs["f"], hs["b"]], axis=2)
        em, tr = both @ p["O"] + p["ob"], p["T"]
        t, n = em.shape[:2]
        fwd, bwd = np.zeros_like(em), np.zeros_like(em)
        fwd[0] = em[0]
        for i in range(1, t):
            fwd[i] = _logsum(fwd[i - 1][:, :, None] + tr, 1) + em[i]
        for i in range(t - 2, -1, -1):
            bwd[i] = _logsum(tr + (em[i + 1] + bwd[i + 1])[:, None, :], 2)
        z = _logsum(fwd[-1], 1)
        d_em = np.exp(fwd + bwd - z[:, None])
        d_tr = np.zeros_like(tr)
        for i in range(1, t):
            d_tr += np.exp(fwd[i - 1][:, :, None] + tr + (em[i] + bwd[i])[:, None, :] - z[:, None, None]).sum(0)
        rows = np.arange(n)
        for i in range(t):
            d_em[i][rows, y[:, i]] -= 1
            if i:
                np.subtract.at(d_tr, (y[:, i - 1], y[:, i]), 1)
        d_em, d_tr = d_em / n, d_tr / n
        g = {k: np.zeros_like(a) for k, a in p.items()}
        g["T"], g["ob"] = d_tr, d_em.sum((0, 1))
        g["O"] = both.reshape(-1, 2 * h).T @ d_em.reshape(-1, TAGS)
        d_both = d_em @ p["O"].T
        for k, d in enumerate("fb"):
            d_table = np.zeros((N_CLASSES, 4 * h), np.float32)
            d_hid, d_cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
            for i, s, gate, old, out, before in reversed(kept[d]):
                d_hid = d_hid + d_both[i][:, k * h : (k + 1) * h]
                d_cell = d_cell + d_hid * s[:, 2 * h :] * (1 - out * out)
                ds = np.concatenate([d_cell * gate, d_cell * old, d_hid * out], axis=1) * s * (1 - s)
                dz = np.concatenate([ds, d_cell * s[:, :h] * (1 - gate * gate)], axis=1)
                np.add.at(d_table, x[:, i], dz)
                g[f"U{d}"] += before.T @ dz
                d_hid, d_cell = dz @ p[f"U{d}"].T, d_cell * s[:, h : 2 * h]
            g["E"] += d_table @ p[f"W{d}"].T
            g[f"W{d}"] = p["E"].T @ d_table
            g[f"c{d}"] = d_table.sum(0)
        return g

    def viterbi(self, em: np.ndarray) -> np.ndarray:
        """Best tags (window, time)."""
        t, n = em.shape[:2]
        back, score = np.zeros((t, n, TAGS), np.int8), em[0]
        for i in range(1, t):
            cand = score[:, :, None] + self.p["T"]
            back[i] = cand.argmax(1)
            score = cand.max(1) + em[i]
        tags = np.zeros((n, t), np.int64)
        tags[:, -1] = score.argmax(1)
        rows = np.arange(n)
        for i in range(t - 1, 0, -1):
            tags[:, i - 1] = back[i][rows, tags[:, i]]
        return tags


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return np.log(np.exp(a - top).sum(axis=axis)) + top.squeeze(axis)


def tags_of(n: int, spans: list[tuple[int, int, str]]) -> np.ndarray:
    """Tags of n characters; of overlapping spans the earlier stays."""
    out, done = np.zeros(n, np.int64), 0
    for a, b, kind in spans:
        if a >= done and a < n:
            k = 1 + 2 * _RANK[kind]
            out[a], out[a + 1 : b] = k, k + 1
            done = b
    return out


def train_tagger(samples: list[tuple[str, list[tuple[int, int, str]]]]) -> BiLstmCrf | None:
    """A tagger from labelled windows (text of at most WINDOW characters, spans), or None if they are few."""
    if len(samples) < MIN_TRAIN:
        return None
    x, y = np.zeros((len(samples), WINDOW), np.int64), np.zeros((len(samples), WINDOW), np.int64)
    for i, (text, spans) in enumerate(samples):
        text = text[:WINDOW]
        x[i, : len(text)], y[i, : len(text)] = encode(text), tags_of(len(text), spans)
    model = BiLstmCrf()
    model.train(x, y)
    return model


_LABEL = "[A-Za-z0-9-]+"
_SOME_DOT = r"(?:\.|\s?[\[({<](?:\.|dot)[\])}>]\s?|\sdot\s)"
_SPELLED_DOT = r"(?:\s?[\[({<](?:\.|dot)[\])}>]\s?|\sdot\s)"
_EMAIL_FORM = re.compile(
    rf"[A-Za-z0-9][A-Za-z0-9._%+-]*(?:\s?@\s?|\s?[\[({{<]at[\])}}>]\s?){_LABEL}(?:{_SOME_DOT}{_LABEL})+"
    rf"|[A-Za-z0-9][A-Za-z0-9._%+-]*\sat\s{_LABEL}(?:{_SPELLED_DOT}{_LABEL})+",
    re.IGNORECASE,
)
_IP_FORM = re.compile(r"[0-9]{1,3}(?:(?:[.:-]|\s\.\s|[\[(]\.[\])])[0-9]{1,3}){3}")
_CARD_FORM = re.compile(r"[0-9](?:[ ./-]{0,3}[0-9])+")
_PHONE_FORM = re.compile(r"(?:\+|00|\()[0-9][0-9 ().+/-]*[0-9]|[0-9]+(?:[ ./)(-]{1,3}[0-9]+){2,}")


def form_fits(kind: str, span: str) -> bool:
    """Whether a decoded span can be of its kind at all."""
    digits = "".join(c for c in span if "0" <= c <= "9")
    if len(span) > MAX_SPAN:
        return False
    if kind == "email":
        return bool(_EMAIL_FORM.fullmatch(span))
    if kind == "ip":
        return bool(_IP_FORM.fullmatch(span)) and all(int(p) <= 255 for p in re.findall("[0-9]+", span))
    if kind == "card":
        return 14 <= len(digits) <= 19 and bool(_CARD_FORM.fullmatch(span)) and luhn(digits)
    return 10 <= len(digits) <= 15 and bool(_PHONE_FORM.fullmatch(span))


def rewritten(span: str, kind: str, r: random.Random) -> str:
    """A base span in a form that the fixed patterns miss."""
    if kind == "email":
        local, _, domain = span.partition("@")
        at, dot = r.choice([(" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", " (dot) "), ("(at)", "."), (" at ", " dot "), (" @ ", "."), ("@", "[.]"), (" [at] ", ".")])
        return local + at + domain.replace(".", dot)
    if kind == "ip":
        return span.replace(".", r.choice(["[.]", "(.)", " . ", "-", ":"]))
    digits = re.sub("[^0-9]", "", span)
    if kind == "card":
        return r.choice([".", "/", "  ", " - "]).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    parts = re.findall("[0-9]+", span)
    if len(parts) < 3:
        parts = [digits[:-7], digits[-7:-4], digits[-4:]]
    head = r.choice(["00", "", ""])
    return head + r.choice(["-", ".", " ", "/"]).join(parts)


def with_rewritten(samples: list[tuple[str, list]]) -> list[tuple[str, list]]:
    """The labelled windows, and copies of those with spans in which each span is rewritten."""
    out = list(samples)
    for text, spans in samples:
        r = random.Random(hashlib.md5(text.encode("utf-8", "replace")).hexdigest())
        for _ in range(COPIES if spans else 0):
            made, labels, done = "", [], 0
            for a, b, kind in spans:
                if a < done:
                    continue
                new = rewritten(text[a:b], kind, r)
                made += text[done:a]
                labels.append((len(made), len(made) + len(new), kind))
                made, done = made + new, b
            made += text[done:]
            over = max(0, labels[-1][1] - WINDOW)  # the window slides to the last span
            out.append((made[over : over + WINDOW], [(a - over, b - over, k) for a, b, k in labels if a >= over]))
    return out


def window_starts(text: str, codes: np.ndarray, gate: bool = True) -> np.ndarray:
    """Starts of the overlapping windows of a text; with ``gate`` only those within a span's length of a cue."""
    starts = np.arange(0, max(1, len(codes) - STRIDE), STRIDE)
    if not gate:
        return starts
    marks = (codes == 4) | (codes == CLASSES[ord("@")])
    for m in _SPELLED.finditer(text):
        marks[m.start() : m.end()] = True
    cue = np.concatenate([[0], np.cumsum(marks)])
    return starts[cue[np.minimum(starts + WINDOW + MAX_SPAN, len(codes))] > cue[np.maximum(starts - MAX_SPAN, 0)]]


def reconcile(spans: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str]]:
    """Of overlapping spans from all windows the disjoint set with the largest total score."""
    best: dict[tuple[int, int, str], float] = {}
    for a, b, kind, score in spans:
        best[a, b, kind] = max(best.get((a, b, kind), score), score)
    items = sorted(((b, a, _RANK[k], s) for (a, b, k), s in best.items()))
    ends = [b for b, *_ in items]
    total, choice = [0.0], []
    for i, (_, a, _, s) in enumerate(items):
        j = bisect_right(ends, a, 0, i)
        take = total[j] + s > total[i]
        choice.append((take, j))
        total.append(total[j] + s if take else total[i])
    out, i = [], len(items)
    while i:
        take, j = choice[i - 1]
        if take:
            b, a, k, _ = items[i - 1]
            out.append((a, b, KINDS[k]))
        i = j if take else i - 1
    return out[::-1]


def decode_all(model: BiLstmCrf, texts: list[str], gate: bool = True) -> list[list[tuple[int, int, str]]]:
    """Reconciled spans of the model in each text, by windows over all of it."""
    found: list[list] = [[] for _ in texts]
    rows, where = [], []
    #: of a text: the last window, and the start, kind and score of the piece that its right edge cuts
    open_piece: dict[int, tuple[int, int, int, float]] = {}

    def flush():
        x = np.stack(rows)
        em = model.emissions(x)
        tags = model.viterbi(em)
        margin = np.take_along_axis(em.transpose(1, 0, 2), tags[:, :, None], 2)[:, :, 0] - em[:, :, 0].T
        for r in np.flatnonzero(tags.any(axis=1)):
            doc, start = where[r]
            t, i = tags[r], 0
            before = open_piece.pop(doc, None)
            while i < WINDOW:
                if t[i] == 0:
                    i += 1
                    continue
                kind, j = int(t[i] - 1) // 2, i + 1
                while j < WINDOW and t[j] == 2 + 2 * kind:
                    j += 1
                path = np.concatenate([[0] if i else [], t[i:j], [0] if j < WINDOW else []]).astype(int)
                a, score = start + i, float(margin[r, i:j].sum()) + float((model.p["T"][path[:-1], path[1:]] - model.p["T"][0, 0]).sum())
                whole = i > 0 or start == 0
                if not whole and before and before[0] == start - STRIDE and before[2] == kind:
                    # the piece goes on where the window before ended
                    a, score, whole = before[1], before[3] + float(margin[r, WINDOW - STRIDE : j].sum()), True
                if whole and j == WINDOW and start + WINDOW < lengths[doc]:
                    open_piece[doc] = (start, a, kind, score)
                elif whole:
                    found[doc].append((a, min(start + j, lengths[doc]), KINDS[kind], score))
                i = j
        rows.clear()
        where.clear()

    lengths = [len(t) for t in texts]
    for doc, text in enumerate(texts):
        if gate and not _CUE.search(text):
            continue
        codes = encode(text)
        for s in window_starts(text, codes, gate):
            x = np.zeros(WINDOW, np.int64)
            part = codes[s : s + WINDOW]
            x[: len(part)] = part
            rows.append(x)
            where.append((doc, int(s)))
            if len(rows) == 512:
                flush()
    if rows:
        flush()
    return [reconcile([s for s in spans if s[3] >= MARGIN * (s[1] - s[0]) and form_fits(s[2], text[s[0] : s[1]])]) for spans, text in zip(found, texts)]


def all_spans(texts: list[str], model: BiLstmCrf | None) -> list[tuple[list, list]]:
    """Base spans and all spans of each text."""
    base = [base_spans(t) for t in texts]
    if model is None:
        return [(b, b) for b in base]
    out = []
    for b, extra in zip(base, decode_all(model, texts)):
        starts, upto, most = [a for a, *_ in b], [0], 0
        for _, e, _ in b:
            most = max(most, e)
            upto.append(most)
        taken = [s for s in extra if upto[bisect_left(starts, s[1])] <= s[0]]
        out.append((b, sorted([*b, *taken], key=lambda s: (s[0], _RANK[s[2]]))))
    return out


def cued(batch: pa.RecordBatch) -> tuple[list[bytes], list[int]]:
    """UTF-8 texts of a batch, and the indices of those with a cue."""
    texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
    return texts, [i for i, t in enumerate(texts) if _CUE_BYTES.search(t)]


def labelled_windows(docs: DataFrame) -> list[tuple[str, list]]:
    """At most MAX_TRAIN windows around cues of all ``docs``, by least hash, with the base spans in them."""

    def run(batches):
        for batch in batches:
            hashes, windows, labels = [], [], []
            texts, some = cued(batch)
            for i in some:
                text = texts[i].decode("utf-8", "replace")
                spans = base_spans(text)
                m = _CUE.search(text)
                start = max(0, (spans[len(text) % len(spans)][0] if spans else m.start()) - 10 - len(text) % 30)
                window = text[start : start + WINDOW]
                inside = [(a - start, b - start, k) for a, b, k in spans if a >= start and b <= start + WINDOW]
                if len(inside) == sum(b > start and a < start + WINDOW for a, b, _ in spans):
                    hashes.append(hashlib.md5(window.encode("utf-8", "replace")).hexdigest())
                    windows.append(window)
                    labels.append(",".join(f"{a}:{b}:{k}" for a, b, k in inside))
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.string()), pa.array(windows, pa.string()), pa.array(labels, pa.string())], ["h", "w", "s"])

    rows = docs.select("text").mapInArrow(run, "h string, w string, s string").distinct().orderBy("h", "w", "s").limit(MAX_TRAIN).collect()
    parse = lambda s: [(int(a), int(b), k) for a, b, k in (x.split(":") for x in s.split(",") if x)]
    return [(r.w, parse(r.s)) for r in rows]


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def _with_spans(docs: DataFrame):
    """The model, shared with the tasks, trained on a bounded sample of ``docs``."""
    model = train_tagger(with_rewritten(labelled_windows(docs)))
    shared = docs.sparkSession.sparkContext.broadcast(None if model is None else model.p)

    def load() -> BiLstmCrf | None:
        if shared.value is None:
            return None
        tagger = BiLstmCrf()
        tagger.p = shared.value
        return tagger

    return load


def pii_digests(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, SHA-256 of the base spans, and all spans, a row for each row of ``docs``."""
    load = _with_spans(docs)

    def run(batches):
        model = load()
        empty = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            n = batch.num_rows
            counts, shas, spans = {k: [0] * n for k in KINDS}, [empty] * n, [""] * n
            texts, some = cued(batch)
            for i, (base, full) in zip(some, all_spans([texts[i].decode("utf-8", "replace") for i in some], model)):
                for _, _, k in base:
                    counts[k][i] += 1
                shas[i], spans[i] = hashlib.sha256(joined(base).encode()).hexdigest(), joined(full)
            arrays = [batch.column("doc_id"), *[pa.array(counts[k], pa.int64()) for k in KINDS], pa.array(shas), pa.array(spans)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string")


def mask_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in angle brackets; null texts stay null."""
    load = _with_spans(docs)

    def run(batches):
        model = load()
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts, some = cued(batch)
            whole = batch.column(at).to_pylist()
            for i, (_, spans) in zip(some, all_spans([texts[i].decode("utf-8", "replace") for i in some], model)):
                out, done = [], 0
                for a, b, kind in spans:
                    if b > done:
                        out += [whole[i][done : max(a, done)], f"<{kind}>" if a >= done else ""]
                        done = b
                whole[i] = "".join(out) + whole[i][done:]
            yield batch.set_column(at, batch.schema.field(at), pa.array(whole, batch.schema.field(at).type))

    return docs.mapInArrow(tidy(run), docs.schema)
