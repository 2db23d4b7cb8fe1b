"""Secret scans: a character convolutional network over every candidate and its context.

Base findings come from three fixed patterns and always stay. Candidates are all runs of 12
or more characters of the value alphabet that are not plain words, those inside base findings
included. Each goes through a small network in numpy with the characters before and after it:
embedding, convolution, maximum over each of the three parts, logistic output. The maximum takes
a candidate of any length: a long one is cut into pieces that overlap by a convolution less one
character, and the maximum is over all of them.

It is trained on labelled findings that owe nothing to the base patterns: secrets of known
public formats and look-alikes of known harmless formats, both generated, the look-alikes with words of
the corpus; and candidates of the corpus that have a harmless format (web and mail addresses,
numbers, dates). What else the corpus holds has no label and takes no part. Scores are calibrated by
Platt scaling on a held-out part. For each shape of candidate (hex, key, other) the threshold
is the highest that still finds ``RECALL`` of the held-out secrets; nothing else moves it. A
candidate that reaches it and is not wholly inside base findings is added as kind ``cnn``.

The bound on training data is ``SAMPLE_DOCS`` documents, ``SAMPLE_WINDOWS`` distinct windows and
``SAMPLE_WORDS`` distinct words of them, all chosen by hash. Scanning covers every candidate of every
whole text.

Cases: a null or empty text has no findings; a null doc_id and repeated rows are scanned
as they are; an empty table gives an empty result and a network trained on the generated
set alone; other columns are passed over, or through where the text is redacted.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import common

SAMPLE_DOCS, SAMPLE_WINDOWS, SAMPLE_WORDS, GENERATED = 4_000, 2_000, 3_000, 6_000
#: Share of held-out secrets that each threshold keeps; so many of a shape are needed for a threshold of its own.
RECALL, LEAST_HELD = 0.995, 50
KINDS = ("assign", "access", "hex", "cnn")
SHAPES = ("hex", "key", "other")

# The patterns of the base findings.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST = 12

_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
# Possessive throughout: linear in the run.
_WORDS_ONLY = re.compile(r"[A-Za-z][a-z]*+(?:[-_./=+](?:[A-Za-z][a-z]*+)?+)*+|[A-Z]++(?:[-_./=+][A-Z]*+)*+|[-_./=+]++")
_ALL_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")

BEFORE, INSIDE, AFTER = 24, 48, 12
WIDTH = BEFORE + INSIDE + AFTER
CONV, EMBED, FILTERS = 5, 8, 16


def base_findings(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base findings, by start, then kind as listed."""
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)] + [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda f: (f[0], f[2]))]


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs of the value alphabet that are more than words, without punctuation at their ends."""
    out = []
    for m in _RUN.finditer(text):
        a, b = m.span()
        run = m[0]
        a += len(run) - len(run.lstrip(".-=+/_"))
        b -= len(run) - len(run.rstrip(".-=_"))
        if b - a >= 12 and not _WORDS_ONLY.fullmatch(text, a, b):
            out.append((a, b))
    return out


def shape(run: str) -> str:
    if _ALL_HEX.fullmatch(run):
        return "hex"
    return "key" if re.search("[0-9]", run) and re.search("[a-z]", run) and re.search("[A-Z]", run) else "other"


def window(text: str, a: int, b: int) -> str:
    """Context and whole candidate: ``BEFORE`` characters, the run, filled up to ``INSIDE``, ``AFTER`` characters."""
    return text[max(0, a - BEFORE) : a].rjust(BEFORE, "\0") + text[a:b].ljust(INSIDE, "\0") + text[b : b + AFTER].ljust(AFTER, "\0")


def run_of(w: str) -> str:
    return w[BEFORE : len(w) - AFTER].rstrip("\0")


def _pieces(w: str) -> Iterator[str]:
    """A window in pieces of ``WIDTH`` characters; the context is in the first and the last."""
    if len(w) == WIDTH:
        yield w
        return
    end = len(w) - AFTER
    for at in range(BEFORE, end - CONV + 1, INSIDE - CONV + 1):
        first, last = at == BEFORE, at + INSIDE >= end
        yield (w[:BEFORE] if first else "\0" * BEFORE) + w[at : min(at + INSIDE, end)].ljust(INSIDE, "\0") + (w[end:] if last else "\0" * AFTER)
        if last:
            return


def _codes(pieces: list[str]) -> np.ndarray:
    """Character numbers: 0 for none, 1 to 96 for ASCII, 97 for any other."""
    points = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(pieces), WIDTH)
    return np.where(points == 0, 0, np.where(points < 32, 1, np.where(points < 127, points - 30, 97))).astype(np.int64)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


class Network:
    """Embedding, convolution, maximum over three parts, logistic output, in numpy."""

    parts = ((0, BEFORE - CONV + 1), (BEFORE - CONV + 1, BEFORE + INSIDE), (BEFORE + INSIDE - CONV + 1, WIDTH - CONV + 1))
    #: Pieces that are in memory at once.
    block = 512

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        p = {
            "embed": r.normal(0, 0.3, (98, EMBED)),
            "conv": r.normal(0, (2 / (CONV * EMBED)) ** 0.5, (CONV * EMBED, FILTERS)),
            "bias": np.zeros(FILTERS),
            "out": r.normal(0, 0.2, 3 * FILTERS),
            "end": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in p.items()}
        self.scale, self.shift = 1.0, 0.0
        self.thresholds = dict.fromkeys(SHAPES, 0.5)

    def _convolved(self, codes: np.ndarray):
        """Of each piece: convolution inputs, place and value of each part's maximum."""
        x = self.p["embed"][codes]
        spread = np.concatenate([x[:, k : WIDTH - CONV + 1 + k] for k in range(CONV)], axis=2)
        h = np.maximum(spread @ self.p["conv"] + self.p["bias"], 0)
        at = [a + h[:, a:b].argmax(axis=1) for a, b in self.parts]
        return spread, at, np.concatenate([np.take_along_axis(h, i[:, None], axis=1)[:, 0] for i in at], axis=1)

    def logits(self, windows: list[str]) -> np.ndarray:
        top = np.zeros((len(windows), 3 * FILTERS), np.float32)
        held, owner = [], []

        def pool() -> None:
            if held:
                starts = np.flatnonzero(np.diff(owner, prepend=-1))
                own = np.array(owner)[starts]
                top[own] = np.maximum(top[own], np.maximum.reduceat(self._convolved(_codes(held))[2], starts))
                held.clear(), owner.clear()

        for k, w in enumerate(windows):
            for piece in _pieces(w):
                held.append(piece)
                owner.append(k)
                if len(held) == self.block:
                    pool()
        pool()
        return top.astype(np.float64) @ self.p["out"] + float(self.p["end"][0])

    def probabilities(self, windows: list[str]) -> np.ndarray:
        return _sigmoid(self.scale * self.logits(windows) + self.shift)

    def fit(self, windows: list[str], y: np.ndarray, rounds: int = 6, batch: int = 64, seed: int = 11) -> None:
        """Adam on the logistic loss, classes weighted evenly."""
        r, pieces = np.random.default_rng(seed), [list(_pieces(w)) for w in windows]
        begin = np.append(0, np.cumsum([len(p) for p in pieces]))
        codes = _codes([p for own in pieces for p in own])
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
        m, v = ({k: np.zeros_like(p) for k, p in self.p.items()} for _ in range(2))
        t, steps = 0, rounds * -(-len(y) // batch)
        for _ in range(rounds):
            order = r.permutation(len(y))
            for k in range(0, len(order), batch):
                rows = order[k : k + batch]
                mine = np.concatenate([np.arange(begin[i], begin[i + 1]) for i in rows])
                starts = np.append(0, np.cumsum(begin[rows + 1] - begin[rows])[:-1])
                owner = np.repeat(np.arange(len(rows)), begin[rows + 1] - begin[rows])
                spread, at, each = self._convolved(codes[mine])
                top = np.maximum.reduceat(each, starts)
                z = top @ self.p["out"] + self.p["end"][0]
                d = ((_sigmoid(z) - y[rows]) * weight[rows] / len(rows)).astype(np.float32)
                # The piece with the maximum takes the gradient; pieces that tie share it.
                wins = (each == top[owner]) & (each > 0)
                ties = np.maximum(np.add.reduceat(wins.astype(np.float32), starts), 1)
                dtop = np.where(wins, d[owner][:, None] * self.p["out"] / ties[owner], 0).astype(np.float32)
                g = {"out": top.T @ d, "end": np.array([d.sum()]), "conv": np.zeros_like(self.p["conv"]), "bias": np.zeros(FILTERS, np.float32), "embed": np.zeros_like(self.p["embed"])}
                n = np.arange(len(mine))
                for part, i in enumerate(at):
                    dh = dtop[:, part * FILTERS : (part + 1) * FILTERS]
                    here = spread[n[:, None], i]  # pieces, filters, conv * embed
                    g["conv"] += np.einsum("nfc,nf->cf", here, dh)
                    g["bias"] += dh.sum(axis=0)
                    dx = (dh[:, :, None] * self.p["conv"].T[None]).reshape(-1, EMBED)
                    used = codes[mine][n[:, None, None], i[:, :, None] + np.arange(CONV)].ravel()
                    g["embed"] += np.stack([np.bincount(used, dx[:, e], 98) for e in range(EMBED)], axis=1).astype(np.float32)
                t += 1
                rate = 0.01 * (1 - t / (steps + 1)) + 0.0005
                for name, grad in g.items():
                    m[name] = 0.9 * m[name] + 0.1 * grad
                    v[name] = 0.999 * v[name] + 0.001 * grad**2
                    self.p[name] = (self.p[name] - rate * (m[name] / (1 - 0.9**t)) / (np.sqrt(v[name] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)

    def calibrate(self, windows: list[str], y: np.ndarray) -> None:
        """Platt scaling, then for each shape the highest threshold that keeps the recall."""
        z = self.logits(windows)
        a, b = 1.0, 0.0
        for _ in range(200):
            p = _sigmoid(a * z + b)
            a, b = a - 0.1 * float(((p - y) * z).mean()), b - 0.1 * float((p - y).mean())
        self.scale, self.shift = max(a, 1e-3), b
        p = self.probabilities(windows)
        shapes = np.array([shape(run_of(w)) for w in windows])
        for s in SHAPES:
            own = np.sort(p[(shapes == s) & (y == 1)])
            own = own if len(own) >= LEAST_HELD else np.sort(p[y == 1])
            if len(own):
                self.thresholds[s] = float(own[int((1 - RECALL) * len(own))])


#: Public formats of secrets, as a class of characters and a number of them after a fixed beginning. Fixed values.
_FORMATS = [
    ("AKIA", "U9", 16), ("ASIA", "U9", 16), ("ghp_", "uU9", 36), ("gho_", "uU9", 36), ("github_pat_", "uU9_", 60), ("glpat-", "uU9_-", 20), ("sk_live_", "uU9", 24),
    ("rk_live_", "uU9", 24), ("AIza", "uU9_-", 35), ("npm_", "uU9", 36), ("hf_", "uU", 34), ("dop_v1_", "h", 64), ("SG.", "uU9_-", 60), ("xapp-1-", "U9", 40),
]
_ALPHABETS = {"u": "abcdefghijklmnopqrstuvwxyz", "U": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "9": "0123456789", "h": "0123456789abcdef", "H": "0123456789ABCDEF"}
_SYLLABLES = "ba de fi go lu ma ne pi ro su ter ing tion en er an re al st ch sch ou eau ión ñ ß é".split()


def generated_findings(n: int = GENERATED, seed: int = 3, words: list[str] | None = None) -> tuple[list[str], np.ndarray]:
    """Windows of generated secrets (1) and of harmless runs (0), half each; ``words`` for names and prose."""
    r = np.random.default_rng(seed)

    def pick(kinds: str, low: int, high: int | None = None) -> str:
        chars = "".join(_ALPHABETS.get(k, k) for k in kinds)
        return "".join(chars[i] for i in r.integers(len(chars), size=low if high is None else r.integers(low, high)))

    one = lambda values: values[int(r.integers(len(values)))]
    made = lambda: "".join(one(_SYLLABLES) for _ in range(r.integers(1, 5)))
    prose = lambda k: " ".join(one(words) if words and r.random() < 0.7 else made() for _ in range(k))
    number = lambda low, high: str(r.integers(low, high))

    def word() -> str:
        plain = re.sub("[^A-Za-z]", "", one(words) if words and r.random() < 0.7 else made())
        return plain or "the"

    def known() -> str:
        lead, kinds, k = one(_FORMATS)
        return lead + pick(kinds, k)

    secret = [
        known, known, known,
        lambda: pick("h", 16, 65),
        lambda: pick("H", 20, 65),
        lambda: pick("uU9", 20, 64),
        lambda: pick("uU9+/", 40) + "=" * int(r.integers(0, 3)),
        lambda: one(["", "MII"]) + pick("uU9+/", 64),
        lambda: pick("u9", 20, 44),
        lambda: pick("U9", 20, 44),
        lambda: f"xox{one('bpas')}-{pick('9', 10, 13)}-{pick('9', 10, 13) + '-' if r.random() < 0.5 else ''}{pick('uU9', 12, 33)}",
        lambda: "eyJ" + pick("uU9", 20, 60) + ".eyJ" + pick("uU9_-", 20, 160) + "." + pick("uU9_-", 27, 87),
    ]
    plain = [
        lambda: f"{word()}.{number(1, 99)}.example.{one(['com', 'org', 'net'])}",
        lambda: f"mail{number(1, 99)}.{word()}.com",
        lambda: f"{word()}.{number(1, 9999)}",
        lambda: f"//www.{word()}.org/{word()}/{number(1, 99999)}",
        lambda: f"{one(['www.', ''])}{word()}.{one(['com', 'org', 'net'])}/{number(1990, 2030)}/{number(10, 13)}/{word()}-{word()}-{word()}",
        lambda: f"{number(1990, 2030)}-{number(10, 13)}-{number(10, 29)}T{number(10, 24)}",
        lambda: f"{number(100, 255)}.{number(10, 255)}.{number(100, 255)}.{number(10, 255)}",
        lambda: f"{word().title()}{word().title()}{word().title()}{one(['Factory', 'Error', 'Test2', ''])}",
        lambda: f"{word()[:1].upper()}{word().title()}{word()}",
        lambda: f"{word()}_{word()}_{word()}_v{number(1, 99)}",
        lambda: f"{word().upper()}_{word().upper()}_{number(1, 99)}",
        lambda: f"{word()}-{word()}-{word()}-{number(1, 2030)}",
        lambda: f"/{word()}/{word()}/{word()}{number(1, 99)}.{one(['py', 'html', 'jpg', 'txt', 'mp4'])}",
        lambda: pick("9", 12, 40),
        lambda: f"{number(0, 999)}.{pick('9', 10, 18)}",
        lambda: f"555-{pick('9', 4)}-{pick('9', 4)}",
        lambda: f"{word().upper()}-{pick('9', 5, 9)}",
        lambda: f"v{number(0, 20)}.{number(0, 99)}.{number(0, 99)}-{one(['beta', 'rc', 'dev'])}.{number(1, 9)}",
        lambda: "-".join(pick("h", k) for k in (8, 4, 4, 4, 12)),
        lambda: f"{word()}={word()}+{number(1, 99)}/{word()}",
        lambda: one("-=._/") * int(r.integers(12, 60)) + number(1, 99),
        lambda: "_".join(word() for _ in range(r.integers(8, 25))) + number(1, 99),
    ]
    lead = ["token = \"", "password: ", "secret=", "api_key: '", "Authorization: Bearer ", "key is ", "", "", "", "\n"]
    windows, y = [], []
    while len(y) < n:
        hit = len(y) % 2
        before, after = prose(4) + " ", one([" ", ". ", "\n", "\" "]) + prose(3)
        before += one(lead) if hit else one(["", "", "see ", "at ", "(", "id ", "\n", "@", "key is ", "the token "])
        run = one(secret)() if hit else one(plain)()
        text = before + run + after
        if hit:
            places = [(len(before), len(before) + len(run))]
        else:  # what the scan makes of it
            places = [(a, b) for a, b in candidates(text) if a < len(before) + len(run) and b > len(before)]
        windows += [window(text, a, b) for a, b in places[:1]]
        y += [hit] * len(places[:1])
    return windows, np.array(y, np.float64)


#: What a candidate and its neighbourhood look like where it is harmless: mail and web addresses, numbers with signs, dates.
_HARMLESS = re.compile(r"[^\s\0]*@[^\s\0]*|(?:https?:)?//\S*|www\.\S*|[-+0-9.,:/T]+Z?")


def _harmless(text: str, a: int, b: int) -> bool:
    """Whether the whole stretch between blanks around the candidate is of a harmless format."""
    low, high = max(0, a - 200), b + 200
    begin = max(text.rfind(blank, low, a) for blank in " \n\t") + 1
    end = min((k for blank in " \n\t" if (k := text.find(blank, b, high)) >= 0), default=min(len(text), high))
    return len(text[begin:end]) < 400 and _HARMLESS.fullmatch(text[begin:end].strip(".,;:!?*#%&$()[]<>\"'")) is not None


def corpus_sample(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_windows: int = SAMPLE_WINDOWS, sample_words: int = SAMPLE_WORDS) -> tuple[list[str], list[str]]:
    """Distinct windows of harmless candidates, and distinct words, of documents chosen by the hash of their text."""
    n = docs.count()
    share = min(1.0, sample_docs / max(n, 1))
    mark = F.pmod(F.xxhash64(F.col("text").cast("string")), F.lit(1 << 30)) < int(share * (1 << 30))

    def each(batches):
        for batch in batches:
            out: set[tuple[str, bool]] = set()
            for value in batch.column(0):
                text = value.as_py() or ""
                base = base_findings(text)
                for a, b in candidates(text):
                    if b - a <= 4 * INSIDE and _harmless(text, a, b) and not any(s < b and a < e for s, e, _ in base):
                        out.add((window(text, a, b), True))
                out.update((w, False) for w in set(text.split()) if w.isalpha() and len(w) < 20)
            for at in range(0, len(rows := sorted(out)), 10_000):
                part = rows[at : at + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], pa.string()), pa.array([k for _, k in part], pa.bool_())], names=["w", "harmless"])

    found = docs.filter(mark).select(F.col("text").cast("string")).mapInArrow(each, "w string, harmless boolean").distinct()
    found = common.stored(found.withColumn("h", F.xxhash64("w")), "sample")
    first = lambda kind, k: [r["w"] for r in found.filter(kind).orderBy("h", "w").limit(k).collect()]
    return first("harmless", sample_windows), first("NOT harmless", sample_words)


def learn(harmless: list[str] = (), words: list[str] | None = None) -> Network:
    """Network, calibration and thresholds; what is held out for the latter is generated apart, with a quarter of ``harmless``."""
    held = [int(hashlib.md5(w.encode("utf-8", "surrogatepass")).hexdigest(), 16) % 4 == 0 for w in harmless]
    net = Network()
    for use, seed, out in ((net.fit, 3, False), (net.calibrate, 4, True)):
        windows, y = generated_findings(seed=seed, words=words)
        more = [w for w, h in zip(harmless, held) if h == out]
        use(windows + more, np.append(y, np.zeros(len(more))))
    return net


def train(docs: DataFrame) -> Network:
    """A network that ``learn`` makes with a bounded sample of the documents."""
    return learn(*corpus_sample(docs))  # SAMPLE_WINDOWS and SAMPLE_WORDS at most


@lru_cache(maxsize=4096)
def _shape(run: str) -> str:
    return shape(run)


def _inside(base: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether base findings, sorted, cover all of a stretch."""
    for s, e in base:
        if s <= a < e:
            a = e
    return a >= b


def scan(net: Network, texts: list[str]) -> list[tuple[list[tuple[int, int, str]], int]]:
    """All findings of each text, by start, then kind as listed, and how many candidates were scored."""
    found, places, windows = [base_findings(t) for t in texts], [], []
    for k, t in enumerate(texts):
        base, at = sorted((s, e) for s, e, _ in found[k]), 0
        for a, b in candidates(t):
            while at < len(base) and base[at][1] <= a:
                at += 1
            near = at
            while near < len(base) and base[near][0] < b:
                near += 1
            places.append((k, a, b, _inside(base[at:near], a, b)))
            windows.append(window(t, a, b))
    scored = [0] * len(texts)
    for (k, a, b, inside), score in zip(places, net.probabilities(windows)):
        scored[k] += 1
        if not inside and score >= net.thresholds[(_shape if b - a < 200 else shape)(texts[k][a:b])]:
            found[k].append((a, b, "cnn"))
    return [(sorted(f, key=lambda x: (x[0], KINDS.index(x[2]))), n) for f, n in zip(found, scored)]


def findings(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_cnn, n_candidates of every document."""
    net = net or train(docs)

    def each(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = []
                for found, scored in scan(net, [t or "" for t in part.column(1).to_pylist()]):
                    said = [f"{k}:{a}:{b}" for a, b, k in found if k != "cnn"]
                    counts = [sum(f[2] == k for f in found) for k in KINDS]
                    rows.append((*counts[:3], hashlib.sha256(",".join(said).encode()).hexdigest(), ",".join(f"{k}:{a}:{b}" for a, b, k in found), counts[3], scored))
                kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()] * 2
                arrays = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_cnn", "n_candidates"])

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_cnn long, n_candidates long"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(each, schema)


def redact_text(text: str, found: list[tuple[int, int, str]], mark: str = "[SECRET]") -> str:
    """Every stretch that findings cover, alone or overlapping, becomes one mark."""
    out, at = [], 0
    for a, b, _ in sorted(found):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """All columns of ``docs`` with the findings in text replaced; n_chars follows if it is there."""
    net = net or train(docs)

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            given = [t if isinstance(t, str) else "" for t in texts]
            yield pd.Series([redact_text(t, f) if f else (t if isinstance(o, str) else None) for t, (f, _), o in zip(given, scan(net, given), texts)], dtype="object")
        common.release()

    done = docs.withColumn("text", clean(F.col("text").cast("string")))
    return done.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))) if "n_chars" in docs.columns else done


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: findings in every whole text."""
    return findings(common.documents(spark, sf_dir))
