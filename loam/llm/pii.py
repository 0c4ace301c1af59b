"""Personal data by patterns and a character-level BiLSTM with CRF transitions.

The base spans are those of fixed patterns (email, ip, card, phone), found in linear time. A
bidirectional LSTM over character classes with a CRF on top, trained in numpy from labelled spans,
adds what the patterns miss: phone numbers without a country code, cards and addresses with other
separators. Every kind holds a digit or an "@", so windows are laid over the
surroundings of those characters and nowhere else. Of overlapping windows, a character takes the
scores of the one in which it stands furthest from an edge; each stretch that windows cover without
a gap is then decoded as a whole, so spans that reach across windows come out in one piece. A stretch
takes some 50 bytes a character while it is decoded. An added span is kept if it can be of its kind (a card must pass its check digit), stands apart from other letters
and digits and overlaps no base span.

The labelled spans are made by templates from a seeded generator (``EXAMPLES`` of them), so
training reads no document.

Defined results: null text is empty and has no span; repeated rows give repeated results; an empty
table gives an empty result; other columns are ignored (``redact`` carries them along unchanged).
"""

from __future__ import annotations

import functools
import hashlib
import re
from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import ids_and_text, tidy

KINDS = ("email", "ip", "card", "phone")
EXAMPLES = 1800
HIDDEN = 12
WINDOW = 64
STRIDE = 32
REACH = 20

# --- base patterns ---------------------------------------------------------------------------

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match begins at the start of a run of digits: where it fails there, it fails further on in the run.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str):
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        # an address can't begin before an "@" without a domain behind it, so runs are walked once
        at, end = text.find("@", max(at + 1, end)), max(end, at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start; code points, end exclusive."""
    out = [("email", a, b) for a, b in _emails(text)]
    if re.search("[0-9]", text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = re.sub("[^0-9]", "", m.group())
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", m.start(), m.end()))
        for m in _PHONE.finditer(text):
            if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


# --- the model -------------------------------------------------------------------------------

_CLASSES = "a A 9 @ . - + ( ) _ % : / , # ~".split(" ")  # small letter, capital, digit, themselves, white space "#", other "~"
_TAGS = 1 + 2 * len(KINDS)  # outside; first and further characters of each kind


@functools.lru_cache(1)
def _class_table():
    import numpy as np

    table = np.full(0x110000, _CLASSES.index("~"), np.uint8)
    for code in range(0x250):
        c = chr(code)
        if c.isalpha():
            table[code] = _CLASSES.index("A" if c.isupper() else "a")
        elif c in "0123456789":
            table[code] = _CLASSES.index("9")
        elif c.isspace():
            table[code] = _CLASSES.index("#")
        elif c in _CLASSES and c not in "#~":
            table[code] = _CLASSES.index(c)
    return table


def char_classes(text: str):
    import numpy as np

    return _class_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]


def labelled(n: int = EXAMPLES, seed: int = 7) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Labelled sentences: spans of each kind in made-up words, and look-alikes without a label."""
    import random

    r = random.Random(seed)
    word = lambda: "".join(r.choice(["an", "er", "é", "th", "or", "qu", "sch", "ó", "in", "da"]) for _ in range(r.randint(1, 4)))
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    octet = lambda: str(r.randint(0, 255))

    def email():
        name = word().encode("ascii", "ignore").decode() or "mx"
        name += r.choice(["", ".", "_", "-"]) + r.choice([digits(2), "lee", ""])
        host = r.choice(["mail", "post", "web"]) + r.choice(["", digits(1)]) + "." + r.choice(["example.com", "example.org", "test.net"])
        return name + r.choice(["@", "@", "@", " @ ", "(@)"]) + host

    def ip():
        return r.choice([".", ".", ".", " . "]).join(octet() for _ in range(4))

    def card():
        sep = r.choice(["", "", " ", "-", "."])
        n = digits(15)
        n += next(c for c in "0123456789" if luhn(n + c))
        return sep.join(n[k : k + 4] for k in range(0, 16, 4))

    def phone():
        a, b, c = digits(3), digits(3), digits(4)
        return r.choice([f"+1 ({a}) {b}-{c}", f"+1 ({a}) {b}-{c}", f"+44 {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+1-{a}-{b}-{c}", f"+49 {a}{b}{c}"])

    def other():
        return r.choice(
            [digits(r.randint(1, 7)), f"{digits(1)}.", f"{digits(1)}.{digits(1)}", f"{digits(4)}-{digits(2)}-{digits(2)}", f"v{digits(1)}.{digits(1)}.{digits(2)}", f"{digits(2)}:{digits(2)}", f"@{word()}", f"${digits(2)}.{digits(2)}", f"{digits(2)}%", f"({digits(4)})", f"{word()}={digits(3)}a{digits(2)}f{digits(2)}", f"AB{digits(2)}C{digits(1)}DEF{digits(1)}", f"{digits(1)},{digits(3)},{digits(3)}", f"{digits(2)}/{digits(2)}/{digits(4)}", f"3.0, {digits(4)}", f'"{digits(4)}ab{digits(3)}c{digits(5)}de{digits(4)}"', f"{word()}{digits(3)}"]
        )

    make = {"email": email, "ip": ip, "card": card, "phone": phone}
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(r.randint(1, 3)):
            text += " ".join([word().capitalize() if r.random() < 0.2 else word() for _ in range(r.randint(1, 3))]) + r.choice([" ", " ", ". ", "\n", ", "])
            if r.random() < 0.55:
                kind = r.choice(KINDS)
                value = make[kind]()
                spans.append((kind, len(text), len(text) + len(value)))
                text += value + r.choice([" ", " ", ". ", "\n", ", "])
            else:
                text += other() + r.choice([" ", "\n", ". "])
        out.append((text + word(), spans))
    return out


class Tagger:
    """Parameters: per direction the input rows (class x 4H), recurrent matrix and, shared, output and transitions."""

    def __init__(self, p: dict):
        self.p = p

    @staticmethod
    def fresh(seed: int = 3) -> Tagger:
        import numpy as np

        rng, h, v = np.random.default_rng(seed), HIDDEN, len(_CLASSES) + 1
        g = lambda *s: (rng.normal(size=s) * 0.3).astype(np.float32)
        p = {f"x{d}": g(v, 4 * h) for d in "fb"} | {f"u{d}": g(h, 4 * h) for d in "fb"}
        for d in "fb":
            p[f"x{d}"][:, h : 2 * h] += 1  # the forget gate begins open
        return Tagger(p | {"w": g(2 * h, _TAGS), "b": np.zeros(_TAGS, np.float32), "t": np.zeros((_TAGS, _TAGS), np.float32)})

    def _run(self, x, d: str, keep: bool):
        """Hidden states over time (T, N, H) of one direction; keep: also what the gradient needs."""
        import numpy as np

        h, (n, steps) = HIDDEN, x.shape
        hs, tape = np.zeros((steps, n, h), np.float32), []
        hid, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = self.p["x" + d][x[:, t]] + hid @ self.p["u" + d]
            sig = 1 / (1 + np.exp(-z[:, : 3 * h]))
            g = np.tanh(z[:, 3 * h :])
            old, last = cell, hid
            cell = sig[:, h : 2 * h] * old + sig[:, :h] * g
            tc = np.tanh(cell)
            hid = sig[:, 2 * h :] * tc
            hs[t] = hid
            if keep:
                tape.append((t, sig, g, old, last, tc))
        return hs, tape

    def emissions(self, x):
        import numpy as np

        f, _ = self._run(x, "f", False)
        b, _ = self._run(x, "b", False)
        return np.concatenate([f, b], 2) @ self.p["w"] + self.p["b"]

    def decode(self, e, lens):
        """Best tags (N, T) of scores e (T, N, tags) of stretches with ``lens`` characters, longest first."""
        import numpy as np

        steps, n, _ = e.shape
        live = np.searchsorted(-np.asarray(lens), -np.arange(steps), side="left")  # stretches longer than t
        score, back = e[0].copy(), np.zeros((steps, n, _TAGS), np.int8)
        move = self.p["t"] + _FORBIDDEN()
        for t in range(1, steps):
            k = live[t]
            s = score[:k, :, None] + move[None]
            back[t, :k] = s.argmax(1)
            score[:k] = s.max(1) + e[t, :k]
        tags, now = np.zeros((n, steps), np.int8), score.argmax(1)
        for t in range(steps - 1, -1, -1):
            k = live[t]
            tags[:k, t] = now[:k]
            if t:
                now[:k] = back[t, np.arange(k), now[:k]]
        return tags

    def gradient(self, x, y):
        """Mean negative log-likelihood of tags y given classes x, and its gradient."""
        import numpy as np

        p, h, (n, steps) = self.p, HIDDEN, x.shape
        runs = {d: self._run(x, d, True) for d in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], 2)
        e = (both @ p["w"] + p["b"]).astype(np.float64)
        trans = p["t"].astype(np.float64)
        lse = lambda a, k: (m := a.max(k, keepdims=True)).squeeze(k) + np.log(np.exp(a - m).sum(k))
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for t in range(1, steps):
            alpha[t] = lse(alpha[t - 1][:, :, None] + trans[None], 1) + e[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = lse(trans[None] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        z = lse(alpha[-1], 1)
        de = np.exp(alpha + beta - z[None, :, None])
        rows = np.arange(n)
        gold = np.zeros(n)
        dt = np.zeros_like(trans)
        for t in range(steps):
            gold += e[t, rows, y[:, t]]
            de[t, rows, y[:, t]] -= 1
            if t:
                gold += trans[y[:, t - 1], y[:, t]]
                dt += np.exp(alpha[t - 1][:, :, None] + trans[None] + (e[t] + beta[t])[:, None, :] - z[:, None, None]).sum(0)
                np.subtract.at(dt, (y[:, t - 1], y[:, t]), 1)
        de = (de / n).astype(np.float32)
        grad = {"w": np.einsum("tnh,tnk->hk", both, de), "b": de.sum((0, 1)), "t": (dt / n).astype(np.float32)}
        dboth = de @ p["w"].T
        for i, d in enumerate("fb"):
            dx, du = np.zeros_like(p["x" + d]), np.zeros_like(p["u" + d])
            dh, dc = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
            for t, sig, g, old, last, tc in reversed(runs[d][1]):
                dh = dh + dboth[t][:, i * h : (i + 1) * h]
                o = sig[:, 2 * h :]
                dc = dc + dh * o * (1 - tc * tc)
                dz = np.concatenate([dc * g, dc * old, dh * tc], 1) * sig * (1 - sig)
                dz = np.concatenate([dz, dc * sig[:, :h] * (1 - g * g)], 1)
                np.add.at(dx, x[:, t], dz)
                du += last.T @ dz
                dh, dc = dz @ p["u" + d].T, dc * sig[:, h : 2 * h]
            grad["x" + d], grad["u" + d] = dx, du
        return float((z - gold).mean()), grad


@functools.lru_cache(1)
def _FORBIDDEN():
    """A span's further characters follow its kind's first or further ones."""
    import numpy as np

    m = np.zeros((_TAGS, _TAGS), np.float32)
    for k in range(2, _TAGS, 2):
        m[:, k] = -1e4
        m[k - 1, k] = m[k, k] = 0
    return m


PAD = len(_CLASSES)


def _training_windows(examples):
    import numpy as np

    xs, ys = [], []
    for text, spans in examples:
        x = char_classes(text)
        y = np.zeros(len(x), np.int64)
        for kind, a, b in spans:
            k = 1 + 2 * KINDS.index(kind)
            y[a:b] = k + 1
            y[a] = k
        for a in range(0, max(1, len(x) - WINDOW + STRIDE), STRIDE):
            if 0 < a and y[a] > 0 and y[a] % 2 == 0:
                continue  # a window that begins within a span is no labelled example of one
            px, py = np.full(WINDOW, PAD, np.int64), np.zeros(WINDOW, np.int64)
            part = x[a : a + WINDOW]
            px[: len(part)], py[: len(part)] = part, y[a : a + WINDOW]
            xs.append(px)
            ys.append(py)
    return np.array(xs), np.array(ys)


@functools.lru_cache(2)
def trained(examples: int = EXAMPLES, epochs: int = 6, batch: int = 64, rate: float = 0.02, seed: int = 7) -> Tagger:
    """Adam over the labelled windows; the same weights each time."""
    import numpy as np

    x, y = _training_windows(labelled(examples, seed))
    tagger, rng = Tagger.fresh(), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in tagger.p.items()}
    v2 = {k: np.zeros_like(v) for k, v in tagger.p.items()}
    step, total = 0, epochs * -(-len(x) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), batch):
            step += 1
            _, grad = tagger.gradient(x[order[a : a + batch]], y[order[a : a + batch]])
            size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            now = rate * (1 - step / (total + 1))
            for k, g in grad.items():
                g = g * min(1.0, 5 / (size + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v2[k] = 0.99 * v2[k] + 0.01 * g * g
                tagger.p[k] = tagger.p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-6)
    return tagger


def stretches(x) -> list[tuple[int, int]]:
    """(first window's start, windows) of the stretches of a text's classes that hold digits and "@"."""
    import numpy as np

    hot = np.flatnonzero((x == _CLASSES.index("9")) | (x == _CLASSES.index("@")))
    near = np.unique(np.concatenate([(hot + d) // STRIDE for d in (-REACH, 0, REACH)]))
    near = near[(near >= 0) & (near * STRIDE < len(x))]
    starts = np.unique(np.concatenate([np.maximum(near - 1, 0), near])) * STRIDE
    if not len(starts):
        return []
    cuts = np.flatnonzero(np.diff(starts) > STRIDE) + 1
    return [(int(s[0]), len(s)) for s in np.split(starts, cuts)]


def _scores(tagger: Tagger, classes: list, parts: list[tuple[int, int, int]]):
    """Scores (T, N, tags) of stretches (text, start, windows), and their lengths: from each window the
    characters that stand further from its edges than in the windows beside it."""
    import numpy as np

    w = np.full((sum(k for _, _, k in parts), WINDOW), PAD, np.int64)
    r = 0
    for i, a, k in parts:
        for j in range(k):
            piece = classes[i][a + j * STRIDE : a + j * STRIDE + WINDOW]
            w[r, : len(piece)] = piece
            r += 1
    e = np.concatenate([tagger.emissions(w[c : c + 2048]) for c in range(0, len(w), 2048)], 1)
    lens = [min(len(classes[i]) - a, (k - 1) * STRIDE + WINDOW) for i, a, k in parts]
    out, r, edge = np.zeros((max(lens), len(parts), _TAGS), e.dtype), 0, STRIDE // 2
    for n, (_, _, k) in enumerate(parts):
        for j in range(k):
            lo, hi = (edge if j else 0), (WINDOW if j == k - 1 else WINDOW - edge)
            to = out[j * STRIDE + lo : min(j * STRIDE + hi, lens[n]), n]
            to[:] = e[lo : lo + len(to), r]
            r += 1
    return out, lens


def added_spans(texts: list[str], bases: list[list[tuple[str, int, int]]], tagger: Tagger, lot: int = 2048) -> list[list[tuple[str, int, int]]]:
    """The model's spans of each text that overlap no base span; ``lot``: windows scored together."""
    import numpy as np

    classes = [char_classes(t) if "@" in t or re.search("[0-9]", t) else None for t in texts]
    jobs = [(i, a, k) for i, x in enumerate(classes) if x is not None for a, k in stretches(x)]
    jobs.sort(key=lambda j: -j[2])
    best: list[dict[int, np.ndarray]] = [{} for _ in texts]  # tags by a stretch's start
    while jobs:
        n = max(1, lot // jobs[0][2])  # of like length, so that padding stays small
        part, jobs = jobs[:n], jobs[n:]
        part.sort(key=lambda j: -min(len(classes[j[0]]) - j[1], (j[2] - 1) * STRIDE + WINDOW))
        e, lens = _scores(tagger, classes, part)
        for (i, a, _), tags, m in zip(part, tagger.decode(e, lens), lens):
            best[i][a] = tags[:m]
    out = []
    for text, base, b in zip(texts, bases, best):
        own: list[tuple[str, int, int]] = []
        taken = sorted((s, e) for _, s, e in base)
        begins, reach = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
        for first, tag in sorted(b.items()):
            at = np.flatnonzero(tag)
            k = 0
            while k < len(at):
                s = e = int(at[k])
                kind = (int(tag[s]) - 1) // 2
                k, e = k + 1, e + 1
                while k < len(at) and at[k] == e and tag[e] == 2 * kind + 2:
                    k, e = k + 1, e + 1
                s, e = s + first, e + first
                j = bisect_right(begins, e - 1)
                free = j == 0 or reach[j - 1] <= s
                apart = not (s and text[s - 1].isalnum()) and not text[e : e + 1].isalnum()
                if free and apart and _plausible(KINDS[kind], text[s:e]):
                    own.append((KINDS[kind], s, e))
        out.append(own)
    return out


def _plausible(kind: str, value: str) -> bool:
    """What a span of the kind must hold at least, so that a stray tag is no finding."""
    digits = sum(c in "0123456789" for c in value)
    if value != value.strip() or "\n" in value:
        return False
    if kind == "email":
        return bool(re.fullmatch(r"\S+ ?\(?@\)? ?\S+\.\S+", value))
    if kind == "ip":
        return bool(re.fullmatch(r"[0-9]{1,3}( ?\. ?[0-9]{1,3}){3}", value))
    if kind == "card":
        return 13 <= digits <= 19 and digits >= 0.7 * len(value) and luhn(re.sub("[^0-9]", "", value))
    return 9 <= digits <= 15 and bool(re.search(r"[-() +.]", value))


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def find_spans(texts: list[str], tagger: Tagger) -> tuple[list, list]:
    bases = [base_spans(t) for t in texts]
    return bases, added_spans(texts, bases, tagger)


FOUND = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS],
        T.StructField("base_sha256", T.StringType()),
        T.StructField("spans", T.StringType()),
    ]
)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, count of base spans by kind, digest of the base spans, all spans."""
    rows = ids_and_text(docs, id_col, text_col)
    shared = rows.sparkSession.sparkContext.broadcast(trained().p)  # about 3,000 numbers

    def run(batches):
        import pyarrow as pa

        tagger = Tagger(shared.value)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a in range(0, len(texts), 512):
                bases, more = find_spans(texts[a : a + 512], tagger)
                counts = [[sum(s[0] == k for s in b) for b in bases] for k in KINDS]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, 512), *[pa.array(c, pa.int64()) for c in counts], pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b in bases]), pa.array([written(b + m) for b, m in zip(bases, more)])],
                    names=FOUND.names,
                )

    return rows.mapInArrow(tidy(run), FOUND)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; null text stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(trained().p)
    place = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        tagger = Tagger(shared.value)
        for batch in batches:
            texts = batch.column(place).to_pylist()
            new = []
            for a in range(0, len(texts), 512):
                part = texts[a : a + 512]
                bases, more = find_spans([t or "" for t in part], tagger)
                for t, b, m in zip(part, bases, more):
                    if t is not None and (b or m):
                        out, end = [], 0
                        for kind, s, e in sorted(b + m, key=lambda x: (x[1], -x[2])):
                            if e > end:
                                out += [t[end : max(s, end)], f"<{kind}>" if s >= end else ""]
                                end = e
                        t = "".join(out) + t[end:]
                    new.append(t)
            columns = [pa.array(new, batch.schema.field(k).type) if k == place else batch.column(k) for k in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(tidy(run), docs.schema)


def op3_pii(spark, sf_dir: str) -> DataFrame:
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
