"""Personal data: fixed patterns plus a character-level bidirectional LSTM with CRF transitions.

* The base spans come from the fixed patterns of ``spans`` and always stay.
* ``train`` fits the tagger in numpy from labelled spans: contexts of the base spans in a bounded sample of documents
  (at most `sample` rows, picked by a hash of the id), the same contexts with each value respelled by rule (an address
  with "(at)", a card in groups, a phone without its plus) and digit-bearing text without a span.
* ``scan`` tags whole texts. A span of these kinds holds a digit or an at-sign, spelled or not, so the tagger reads the
  regions of the tokens around one and `REACH` characters on either side - however many and however long - and everything
  outside is O. A region is cut into overlapping windows, each gives forward-backward marginals; where windows overlap the
  marginals are averaged, and one Viterbi pass over the whole region under the CRF's transitions decides the spans.
* A tagged span grows to the ends of the name or number that it cuts and, when several cards stand side by side in it, is
  cut between them. It is added when the mean marginal of its tags reaches `sure`, its shape is possible for the kind (an
  address has both signs, a number enough digits) and it overlaps no base span. A pattern's match that failed its test
  vetoes nothing.

Cases: null text is empty; rows are scanned one by one, so repeated rows, null ids and empty tables need no rule; a
sample without any base span still trains on generated ones; very long texts are read in full, window by window.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegraph.llm import spans
from casegraph.llm.common import id_and_text
from casegraph.llm.secrets import SPAN, SPAN_SQL

KINDS = ("email", "ip", "card", "phone")
FINDERS = (spans.emails, spans.ips, spans.cards, spans.phones)
TAGS = 1 + 2 * len(KINDS)            # O, then B and I of each kind
GATE = re.compile(r"[0-9@]|[(\[]\s?at\s?[)\]]")
#: Tokens of the characters of addresses and numbers, joined over a spelled at-sign.
TOKEN = spans.LOCAL | frozenset("@()[]/")
AROUND = re.compile(r"[A-Za-z0-9._%+@()\[\]/-]++(?:(?:\s(?=[(\[]\s?at\s?[)\]])|(?<=[(\[])\s(?=at\s?[)\]])|(?<=at)\s(?=[)\]])|(?<=at[)\]])\s|(?<=at\s[)\]])\s)[A-Za-z0-9._%+@()\[\]/-]++)*+")
REACH, WINDOW, STEP, HIDDEN, EMBED = 24, 64, 32, 12, 8
REGIONS = 256                        # tagged together: bounds a worker's memory, not what is read
#: Characters: letters by case, digits, the signs of the kinds, space, other letters, the rest.
SIGNS = "@.-+()[]_%/:;,\n \"'="
LETTERS = "atdo"                     # kept apart, for spelled signs
N_CHARS = 6 + len(SIGNS) + len(LETTERS)


def codes(text: str) -> np.ndarray:
    """A small integer per character."""
    point = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    table = np.full(128, 5, np.int64)
    table[97:123], table[65:91], table[48:58] = 1, 2, 3
    for k, c in enumerate(SIGNS):
        table[ord(c)] = 6 + k
    for k, c in enumerate(LETTERS):
        table[ord(c)] = 6 + len(SIGNS) + k
    return np.where(point < 128, table[np.minimum(point, 127)], 4)


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Tagger:
    weights: dict[str, np.ndarray]

    @classmethod
    def new(cls, seed: int) -> Tagger:
        rng, h, w = np.random.default_rng(seed), HIDDEN, {}
        w["E"] = rng.normal(0, 0.3, (N_CHARS, EMBED))
        for d in "fb":
            w[f"W{d}"] = rng.normal(0, 1 / np.sqrt(EMBED + h), (EMBED + h, 4 * h))
            w[f"c{d}"] = np.zeros(4 * h)
            w[f"c{d}"][h: 2 * h] = 1.0
        w["O"], w["o"] = rng.normal(0, 1 / np.sqrt(2 * h), (2 * h, TAGS)), np.zeros(TAGS)
        w["T"], w["S"] = np.zeros((TAGS, TAGS)), np.zeros(TAGS)
        return cls(w)

    def allowed(self) -> np.ndarray:
        """Penalty of impossible transitions: I of a kind follows B or I of that kind only."""
        out = np.zeros((TAGS, TAGS))
        for k in range(len(KINDS)):
            inside = 2 + 2 * k
            out[:, inside] = -1e4
            out[[1 + 2 * k, inside], inside] = 0
        return out

    def run(self, x: np.ndarray, d: str, keep: bool = False):
        """Hidden states over time of one direction: x (time, batch, EMBED)."""
        h, n, w, c = HIDDEN, x.shape[1], self.weights[f"W{d}"], self.weights[f"c{d}"]
        state, cell, out, kept = np.zeros((n, h)), np.zeros((n, h)), np.empty((len(x), n, h)), []
        order = range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
        given = x @ w[:EMBED] + c
        for t in order:
            z = given[t] + state @ w[EMBED:]
            i, f, o, g = _sigmoid(z[:, :h]), _sigmoid(z[:, h: 2 * h]), _sigmoid(z[:, 2 * h: 3 * h]), np.tanh(z[:, 3 * h:])
            before, cell_before = state, cell
            cell = f * cell + i * g
            tc = np.tanh(cell)
            state = o * tc
            out[t] = state
            if keep:
                kept.append((t, i, f, o, g, tc, before, cell_before))
        return out, kept

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Emissions (time, batch, TAGS) of coded windows (batch, time)."""
        e = self.weights["E"][x.T]
        return np.concatenate([self.run(e, "f")[0], self.run(e, "b")[0]], 2) @ self.weights["O"] + self.weights["o"]

    def marginals(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tag marginals, summed pair marginals, log partition) under the CRF, by forward-backward."""
        trans, t_n = self.weights["T"] + self.allowed(), len(u)
        start = self.weights["S"] + np.array([0.0] + [0.0, -1e4] * len(KINDS))
        a, b = np.empty_like(u), np.zeros_like(u)
        a[0] = u[0] + start
        for t in range(1, t_n):
            a[t] = _lse(a[t - 1][:, :, None] + trans, 1) + u[t]
        for t in range(t_n - 2, -1, -1):
            b[t] = _lse(trans[None] + (u[t + 1] + b[t + 1])[:, None, :], 2)
        z = _lse(a[-1], 1)
        pairs = np.zeros((TAGS, TAGS))
        for t in range(1, t_n):
            pairs += np.exp(a[t - 1][:, :, None] + trans + (u[t] + b[t])[:, None, :] - z[:, None, None]).sum(0)
        return np.exp(a + b - z[None, :, None]), pairs, z

    def decode(self, u: np.ndarray) -> np.ndarray:
        """The best tag path of one region of scores (time, TAGS)."""
        trans = self.weights["T"] + self.allowed()
        best, back = u[0] + self.weights["S"] + np.array([0.0] + [0.0, -1e4] * len(KINDS)), np.zeros((len(u), TAGS), np.int64)
        for t in range(1, len(u)):
            options = best[:, None] + trans
            back[t] = options.argmax(0)
            best = options.max(0) + u[t]
        path = np.empty(len(u), np.int64)
        path[-1] = best.argmax()
        for t in range(len(u) - 1, 0, -1):
            path[t - 1] = back[t, path[t]]
        return path

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean negative log likelihood; x, y (batch, time); padded tags are O."""
        w, h, n = self.weights, HIDDEN, len(x)
        e = w["E"][x.T]
        (hf, kf), (hb, kb) = self.run(e, "f", True), self.run(e, "b", True)
        hidden = np.concatenate([hf, hb], 2)
        u = hidden @ w["O"] + w["o"]
        gamma, pairs, _ = self.marginals(u)
        gold = np.eye(TAGS)[y.T]
        du = (gamma - gold) / n
        seen = np.zeros((TAGS, TAGS))
        np.add.at(seen, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        g = {"T": (pairs - seen) / n, "S": (gamma[0] - gold[0]).sum(0) / n, "O": np.einsum("tnh,tnk->hk", hidden, du), "o": du.sum((0, 1))}
        dh, de = du @ w["O"].T, np.zeros_like(e)
        for d, kept, part in (("f", kf, dh[:, :, :h]), ("b", kb, dh[:, :, h:])):
            gw, gc, ds, dc = np.zeros_like(w[f"W{d}"]), np.zeros(4 * h), np.zeros((n, h)), np.zeros((n, h))
            for t, i, f, o, gg, tc, before, cell_before in reversed(kept):
                ds = ds + part[t]
                do, dc = ds * tc, dc + ds * o * (1 - tc ** 2)
                dz = np.concatenate([dc * gg * i * (1 - i), dc * cell_before * f * (1 - f), do * o * (1 - o), dc * i * (1 - gg ** 2)], 1)
                gw[:EMBED] += e[t].T @ dz
                gw[EMBED:] += before.T @ dz
                gc += dz.sum(0)
                back = dz @ w[f"W{d}"].T
                de[t] += back[:, :EMBED]
                ds, dc = back[:, EMBED:], dc * f
            g[f"W{d}"], g[f"c{d}"] = gw, gc
        g["E"] = np.zeros_like(w["E"])
        np.add.at(g["E"], x.T, de)
        return g


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def respelled(kind: str, value: str, rng: np.random.Generator) -> str:
    """The same value as people write it to be read, not matched."""
    digits = spans.digits_of(value)
    pick = int(rng.integers(3))
    if kind == "email":
        return value.replace("@", (" (at) ", "[at]", "(at)")[pick])
    if kind == "card":
        return (".".join, "/".join, "_".join)[pick]([digits[k: k + 4] for k in range(0, len(digits), 4)])
    if kind == "phone":
        d = digits[-10:]
        return (f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}")[pick]
    return value.replace(".", ("[.]", "(.)", " . ")[pick])


def examples(contexts: list[tuple[str, str, str, str]], plain: list[str], seed: int, size: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Labelled texts: (left, kind, value, right) contexts as they are and respelled, generated values, plain text."""
    rng = np.random.default_rng(seed)
    digit = lambda n: "".join(rng.choice(list("0123456789"), n))
    word = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n))
    values = {
        "email": lambda: f"{word(3 + int(rng.integers(6)))}.{digit(2)}@{word(4 + int(rng.integers(4)))}.{rng.choice(['com', 'org', 'net'])}",
        "ip": lambda: ".".join(str(int(rng.integers(1, 256))) for _ in range(4)),
        "card": lambda: digit(16),
        "phone": lambda: f"+{int(rng.integers(1, 99))} ({digit(3)}) {digit(3)}-{digit(4)}",
    }
    around = [(c[0], c[3]) for c in contexts] or [(f"{word(4)} {word(6)} ", f" {word(3)} {word(5)}") for _ in range(40)]
    out = []
    for n in range(size):
        left, right = around[int(rng.integers(len(around)))]
        turn = n % 8
        if turn >= 5:  # digits that are no personal data: versions, years, counts, codes
            value = (f"{rng.integers(1, 9)}.{rng.integers(0, 9)}", str(rng.integers(1900, 2100)), digit(int(rng.integers(1, 7))), f"{word(2).upper()}{digit(5)}{word(2).upper()}",
                     f"{digit(2)}:{digit(2)}", f"{digit(4)}-{digit(2)}-{digit(2)}", f"{word(6)}={word(1)}{digit(3)}{word(2)}{digit(4)}{word(1)}")[int(rng.integers(7))]
            out.append((left + value + right, []))
            continue
        kind = KINDS[int(rng.integers(4))]
        value = values[kind]()
        if contexts and turn < 2:
            left, kind, value, right = contexts[int(rng.integers(len(contexts)))]
        if turn in (1, 3, 4):
            value = respelled(kind, value, rng)
        out.append((left + value + right, [(KINDS.index(kind), len(left), len(left) + len(value))]))
    return out + [(p, []) for p in plain]


def fit(labelled: list[tuple[str, list[tuple[int, int, int]]]], seed: int = 5, epochs: int = 12, batch: int = 64, rate: float = 0.02) -> Tagger:
    """Adam over windows of labelled texts."""
    tagger, rng = Tagger.new(seed), np.random.default_rng(seed)
    x, y = np.full((len(labelled), WINDOW), 5), np.zeros((len(labelled), WINDOW), np.int64)
    for n, (text, found) in enumerate(labelled):
        own = codes(text)[:WINDOW]
        x[n, : len(own)] = own
        for kind, start, end in found:
            y[n, start:end] = 2 + 2 * kind
            y[n, start] = 1 + 2 * kind
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in tagger.weights.items()}
    turn = 0
    total = epochs * -(-len(x) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            rows, turn = order[at: at + batch], turn + 1
            step = rate * (1 - 0.9 * turn / total)
            for k, g in tagger.gradients(x[rows], y[rows]).items():
                g = np.clip(g, -1, 1)
                m, v = moment[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                tagger.weights[k] -= step * (m / (1 - 0.9 ** turn)) / (np.sqrt(v / (1 - 0.99 ** turn)) + 1e-8)
    return tagger


def contexts_of(text: str) -> tuple[list[tuple[str, str, str, str]], list[str]]:
    """Base spans of a text with some characters on either side, and stretches with digits but no span."""
    own, taken = [], []
    for kind, find in zip(KINDS, FINDERS):
        for start, end in find(text):
            taken.append((start, end))
            if end - start <= WINDOW - 24:
                own.append((text[max(0, start - 12): start], kind, text[start:end], text[end: end + 12]))
    plain = [text[max(0, m.start() - 20): m.start() + 40] for m in GATE.finditer(text)
             if not any(s < m.start() + 44 and m.start() - 24 < e for s, e in taken)][:2]
    return own, plain


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 400, size: int = 1600) -> Tagger:
    """Fit on at most `sample` documents with digits, those with the least hash of their id."""
    texts = id_and_text(docs, id_col, text_col)
    share = min(1.0, 20.0 * sample / max(1, texts.count()))
    picked = texts.filter(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30))).filter(
        F.col("text").rlike("[0-9@]")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    kept = "array<struct<l:string,k:string,v:string,r:string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(c, pa.string()) for c in "lkvr"]))
        for b in batches:
            found = [contexts_of(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), pa.array([[dict(zip("lkvr", c)) for c in own[:4]] for own, _ in found], kind),
                pa.array([plain for _, plain in found], pa.list_(pa.string()))], ["doc_id", "own", "plain"])

    rows = sorted(picked.mapInArrow(run, f"doc_id long, own {kept}, plain array<string>").collect(), key=lambda r: r.doc_id or 0)
    contexts = [tuple(c) for r in rows for c in r.own]
    return fit(examples(contexts, [p for r in rows for p in r.plain][:sample], 11, size))


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches within REACH characters of a token with a digit or at-sign."""
    out: list[tuple[int, int]] = []
    done = 0
    for m in GATE.finditer(text):
        if m.start() < done:
            continue
        first = m.start()
        while first > done and text[first - 1] in TOKEN:
            first -= 1
        if first == m.start() and m[0][0] in "([" and first > done and text[first - 1].isspace():
            first -= 1
            while first > done and text[first - 1] in TOKEN:
                first -= 1
            first += text[first].isspace()
        done = AROUND.match(text, first).end()
        start, end = max(0, first - REACH), min(len(text), done + REACH)
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


def tagged(tagger: Tagger, pieces: list[str], sure: float) -> list[list[tuple[int, int, int]]]:
    """(kind, start, end) in each region: windows of all regions are scored together."""
    windows, owner = [], []
    for n, piece in enumerate(pieces):
        own = codes(piece)
        for at in range(0, max(1, len(own) - WINDOW + STEP), STEP):
            window = np.full(WINDOW, 5)
            part = own[at: at + WINDOW]
            window[: len(part)] = part
            windows.append(window)
            owner.append((n, at, len(part)))
    gammas = [np.zeros((len(p), TAGS)) for p in pieces]
    counts = [np.zeros(len(p)) for p in pieces]
    for low in range(0, len(windows), 256):
        gamma = tagger.marginals(tagger.scores(np.array(windows[low: low + 256])))[0]
        for k, (n, at, size) in enumerate(owner[low: low + 256]):
            gammas[n][at: at + size] += gamma[:size, k]
            counts[n][at: at + size] += 1
    out = []
    for gamma, count in zip(gammas, counts):
        p = gamma / count[:, None]
        path, found, at = tagger.decode(np.log(p + 1e-9)), [], 0
        while at < len(path):
            if path[at] % 2 == 1:
                end = at + 1
                while end < len(path) and path[end] == path[at] + 1:
                    end += 1
                if p[np.arange(at, end), path[at:end]].mean() >= sure:
                    found.append(((int(path[at]) - 1) // 2, at, end))
                at = end
            else:
                at += 1
        out.append(found)
    return out


def possible(kind: int, value: str) -> bool:
    """Shapes that a respelled value of the kind can have."""
    if not value:
        return False
    n = len(spans.digits_of(value))
    if kind == 0:
        return bool(re.search(r"@|[(\[]\s?at\s?[)\]]", value)) and "." in value and value[0].isalnum() and value[-1].isalnum()
    numbers = re.findall(r"[0-9]+", value)
    if kind == 1:
        return len(numbers) == 4 and all(len(v) <= 3 and int(v) <= 255 for v in numbers)
    if kind == 2:
        return 16 <= n <= 19 and spans.luhn(spans.digits_of(value))
    return 8 <= n <= 15 and len(numbers) > 1 and not re.search(r"[A-Za-z]", value)


NAME = re.compile(r"[A-Za-z0-9_%+-]*+(?:\.[A-Za-z0-9_%+-]++)*+")
NAME_BACK = re.compile(r"[A-Za-z0-9._%+-]*+")
DIGITS = re.compile(r"[0-9]*+")


def grown(kind: int, text: str, back: str, start: int, end: int) -> tuple[int, int]:
    """The span with the whole name or number at either end, without signs around it; `back` is the text reversed."""
    before, after = (NAME_BACK, NAME) if kind == 0 else (DIGITS, DIGITS)
    if kind == 0 or text[start].isdigit():
        start -= len(before.match(back, len(text) - start)[0])
    if kind == 0 or text[end - 1].isdigit():
        end = after.match(text, end).end()
    while start < end and not (text[start].isalnum() or kind == 3 and text[start] in "(+"):
        start += 1
    while start < end and not text[end - 1].isalnum():
        end -= 1
    if kind == 3 and start and text[start - 1] == "(" and ")" in text[start:end] and "(" not in text[start:end]:
        start -= 1
    return start, end


def side_by_side(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Cards in a span with the digits of several: from left to right, the first group of whole numbers that is one."""
    numbers = [(start + m.start(), start + m.end()) for m in re.finditer("[0-9]+", text[start:end])]
    out, k = [], 0
    while k < len(numbers):
        n, last = 0, k
        while last < len(numbers) and (n := n + numbers[last][1] - numbers[last][0]) <= 19 and not (
                last > k and re.search("[A-Za-z]", text[numbers[last - 1][1]: numbers[last][0]])):
            if possible(2, text[numbers[k][0]: numbers[last][1]]):
                out.append((numbers[k][0], numbers[last][1]))
                k = last
                break
            last += 1
        k += 1
    return out


def scan(docs: DataFrame, tagger: Tagger, id_col: str = "doc_id", text_col: str = "text", sure: float = 0.7) -> DataFrame:
    """(doc_id, spans): kind, start, end and whether a base pattern found it, by kind, then start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            found = [[(k, s, e, True) for k, find in enumerate(FINDERS) for s, e in find(t)] for t in texts]
            where = [(n, s, e) for n, t in enumerate(texts) for s, e in regions(t)]
            parts = (where[low: low + REGIONS] for low in range(0, len(where), REGIONS))
            tags = ((at, own) for part in parts for at, own in zip(part, tagged(tagger, [texts[n][s:e] for n, s, e in part], sure)))
            backs: dict[int, str] = {}
            for (n, start, _), own in tags:
                text, done = texts[n], 0
                for kind, low, high in own:
                    if start + low < done:
                        continue
                    if n not in backs:
                        backs = {n: text[::-1]}
                    s, done = grown(kind, text, backs[n], start + low, start + high)
                    for s, e in [(s, done)] if possible(kind, text[s:done]) else side_by_side(text, s, done) if kind == 2 else []:
                        if not any(a < e and s < b for _, a, b, _ in found[n]):
                            found[n].append((kind, s, e, False))
            rows = [[{"kind": KINDS[k], "start": s, "end": e, "base": b} for k, s, e, b in sorted(own)] for own in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, SPAN)], ["doc_id", "spans"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, f"doc_id long, spans {SPAN_SQL}")
