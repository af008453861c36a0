"""Secret scan: fixed patterns, and a character convolutional network over every other candidate.

The network (numpy, one convolution, max and mean pooling, a logistic output) reads a candidate together with
the characters around it. It is trained on labelled findings made here from a seed, its output is calibrated
on a held-out part of them, and its threshold is the highest that keeps the asked-for recall there.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orebed.llm.common import slices, table

#: The base kinds in order, their patterns and least lengths (of group 2 for assign).
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LENGTH, ACCESS_LENGTH, HEX_LENGTH = 12, 18, 16
KINDS = ("assign", "access", "hex", "model")
ASSIGN_WORDS = ("passw", "secret", "token", "key")

#: A candidate is a run of these characters of CANDIDATE_LENGTH or more, or what base findings leave of one.
CANDIDATE_LENGTH = 12
RUN = re.compile(rf"[A-Za-z0-9+/_.=-]{{{CANDIDATE_LENGTH},}}")

#: Characters of a window's candidate part, its context on either side, and the step of windows over long candidates.
CORE, SIDE, STEP = 64, 20, 48
WIDTH = CORE + 2 * SIDE

#: Network: characters told apart, embedding, filters and their width; training: findings, rounds, seed; recall to keep.
SYMBOLS, EMBED, FILTERS, SPAN = 130, 8, 16, 5
FINDINGS, ROUNDS, SEED, RECALL = 5000, 6, 7, 0.98

#: Windows that one pass of the network takes.
BATCH = 256


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns' findings, leftmost and non-overlapping in each kind."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LENGTH]
    for run in RUN.finditer(text):  # every access or hex finding lies within a run
        s, e = run.span()
        if "AKIA" in run[0]:
            out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text, s, e) if m.end() - m.start() >= ACCESS_LENGTH]
        if e - s >= HEX_LENGTH:
            out += [(m.start(), 2, m.end()) for m in HEX.finditer(text, s, e) if m.end() - m.start() >= HEX_LENGTH]
    return sorted(out)


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Spans for the network: runs, and the parts of runs beside base findings that are as long as a candidate."""
    out, k, taken = [], 0, sorted(taken)
    reach = 0
    for m in RUN.finditer(text):
        at, end = max(m.start(), reach), m.end()
        while k < len(taken) and taken[k][0] < end:
            if taken[k][0] - at >= CANDIDATE_LENGTH:
                out.append((at, taken[k][0]))
            reach = max(reach, taken[k][2])
            at = max(at, reach)
            k += 1
        if end - at >= CANDIDATE_LENGTH:
            out.append((at, end))
    return out


def windows(text: str, start: int, end: int) -> list[np.ndarray]:
    """Symbol ids of the windows over a whole candidate: its part in the middle, context around, 0 beyond the text."""
    out = []
    for at in range(start, max(start + 1, end - CORE + STEP), STEP):
        stop = min(end, at + CORE)
        row = np.zeros(WIDTH, np.int64)
        lo = max(0, at - SIDE)
        piece = text[lo : stop + SIDE]
        code = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
        ids = np.where(code < 128, code + 2, 1)
        row[SIDE - (at - lo) : SIDE - (at - lo) + len(ids)] = ids
        out.append(row)
    return out


class CharCNN:
    """Embedding, convolution with ReLU, max and mean pooling, logistic output; trained by Adam."""

    def __init__(self, rng: np.random.Generator) -> None:
        n = SPAN * EMBED
        self.p = {"e": rng.normal(0, 0.3, (SYMBOLS, EMBED)), "k": rng.normal(0, np.sqrt(2 / n), (n, FILTERS)), "b": np.zeros(FILTERS), "w": rng.normal(0, 0.2, 2 * FILTERS), "c": np.zeros(1)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        emb = self.p["e"][x]
        cols = np.lib.stride_tricks.sliding_window_view(emb, SPAN, axis=1).transpose(0, 1, 3, 2).reshape(len(x), WIDTH - SPAN + 1, -1)
        act = np.maximum(cols @ self.p["k"] + self.p["b"], 0)
        pooled = np.concatenate((act.max(axis=1), act.mean(axis=1)), axis=1)
        return pooled @ self.p["w"] + self.p["c"], (cols, act, pooled)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        z, (cols, act, pooled) = self.forward(x)
        dz = ((1 / (1 + np.exp(-z)) - y) / len(y)).astype(np.float32)
        dpool = dz[:, None] * self.p["w"]
        dact = np.repeat(dpool[:, None, FILTERS:] / act.shape[1], act.shape[1], axis=1)
        rows, filters = np.meshgrid(np.arange(len(x)), np.arange(FILTERS), indexing="ij")
        dact[rows, act.argmax(axis=1), filters] += dpool[:, :FILTERS]
        dact = dact * (act > 0)
        dcols = (dact @ self.p["k"].T).reshape(len(x), -1, SPAN, EMBED)
        demb = np.zeros((len(x), WIDTH, EMBED), np.float32)
        for j in range(SPAN):
            demb[:, j : j + dcols.shape[1]] += dcols[:, :, j]
        de = np.zeros_like(self.p["e"])
        np.add.at(de, x.ravel(), demb.reshape(-1, EMBED))
        return {"e": de, "k": np.tensordot(cols, dact, axes=([0, 1], [0, 1])), "b": dact.sum(axis=(0, 1)), "w": pooled.T @ dz, "c": dz.sum(keepdims=True)}

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability that each window holds a secret."""
        z = np.concatenate([self.forward(x[i : i + BATCH])[0] for i in range(0, len(x), BATCH)]) if len(x) else np.empty(0)
        return 1 / (1 + np.exp(-(self.scale * z + self.shift)))


# Words of four languages, for harmless runs; common ones, the long ones among them as long as a candidate.
WORDS = """people because different important government development information environment relationship understanding
responsibility international communication organization particularly university administration opportunities
the and with from that have this water house letter music river garden window history science project server backup
report archive account customer invoice morning between without another question example number system
und der die das nicht werden haben eine zwischen Wissenschaft Gesellschaft Entwicklung Geschwindigkeit Zusammenarbeit
Veranstaltung selbstverständlich Krankenversicherung Bundesregierung Möglichkeiten Haus Wasser Strasse Fenster Arbeit
que los las para como pero también desarrollo conocimiento universidad importante administración comunicación
posibilidades casa agua ventana trabajo ciudad escuela hermano
les des une pour dans avec mais gouvernement développement connaissance malheureusement environnement établissement
aujourd maison fenêtre travail ville école frère""".split()

ONSETS = "b c d f g h j k l m n p r s t v w z bl br ch cl cr dr fl fr gl gr kn pf pl pr qu sch sh sp st str th tr wh".split()
VOWELS = "a e i o u ai au ea ee ei eu ia ie io oa oi ou ue".split()
CODAS = ["", "", "", *"b ck d f g k l ll lt m n nd ng nt p r rd rs rt s ss st t tion tz x ch cht".split()]


def labelled_findings(n: int = FINDINGS, seed: int = SEED) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label): secrets and harmless strings in varied surroundings, made from a seed.

    Harmless are words, invented words, shouted and run together ones, names of files, hosts and paths, numbers,
    dates, versions, addresses and rules of punctuation.
    """
    rng = np.random.default_rng(seed)
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    letters = alnum[:52]
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    draw = lambda chars, k: "".join(chars[i] for i in rng.integers(0, len(chars), k))
    invented = lambda k: "".join(pick(ONSETS) + pick(VOWELS) + pick(CODAS) for _ in range(k))
    word = lambda: pick(WORDS) if rng.random() < 0.5 else invented(rng.integers(1, 4))
    num = lambda lo, hi: str(rng.integers(lo, hi))
    cased = lambda x: pick((x, x, x, x.capitalize(), x.upper()))
    phrase = lambda sep, k: sep.join(cased(word()) for _ in range(k))
    stop = lambda: pick(("", "", ".", "..."))
    secret = [
        lambda: draw("0123456789abcdef", rng.integers(20, 65)),
        lambda: draw("0123456789ABCDEF", rng.integers(20, 65)),
        lambda: draw(alnum, rng.integers(16, 50)),
        lambda: base64.b64encode(rng.bytes(rng.integers(14, 48))).decode(),
        lambda: pick(("sk_live_", "sk-", "ghp_", "xoxb-", "glpat-")) + draw(alnum, rng.integers(20, 37)),
        lambda: "AKIA" + draw(alnum[:26] + "0123456789", 16),
        lambda: ".".join(draw(alnum + "_-", rng.integers(15, 40)) for _ in range(3)),
        lambda: draw(alnum[26:] + "_-", rng.integers(18, 40)),
        lambda: draw(letters, rng.integers(14, 40)),
        lambda: draw(letters[:26], rng.integers(16, 40)),
        lambda: draw(letters[26:], rng.integers(16, 40)),
        lambda: phrase(pick("-_."), rng.integers(4, 7)),
    ]
    address = lambda: ".".join(num(0, 256) for _ in range(4))
    date = lambda: pick((f"{num(1990, 2031)}-{num(1, 13):0>2}-{num(1, 29):0>2}", f"{num(1, 29):0>2}.{num(1, 13):0>2}.{num(1990, 2031)}"))
    harmless = [
        *[lambda: cased(invented(rng.integers(3, 8))) + stop()] * 4,
        *[lambda: cased("".join(word() for _ in range(rng.integers(2, 4)))) + stop()] * 3,
        lambda: pick([w for w in WORDS if len(w) >= CANDIDATE_LENGTH]) + stop(),
        lambda: phrase(pick("-_."), rng.integers(2, 7)),
        lambda: word() + "".join(word().capitalize() for _ in range(rng.integers(1, 4))),
        lambda: f"{word()}{num(1, 99)}.{word()}.example.com",
        lambda: f"{pick(('www', 'mail', 'cdn', 'm'))}.{word()}{pick('-.')}{word()}.{pick(('com', 'org', 'net', 'de', 'info'))}",
        lambda: f"{date()}T{num(0, 24):0>2}.{num(0, 60):0>2}.{num(0, 60):0>2}",
        lambda: f"{word()}-{date()}.{pick(('log', 'txt', 'csv', 'pdf', 'tar.gz'))}",
        lambda: f"{word()}_{word()}_{num(1, 2030)}.{pick(('py', 'html', 'json', 'jpeg', 'docx'))}",
        lambda: f"{word()}-{num(1, 99)}-{word()}-{num(1, 99)}",
        lambda: draw("0123456789", rng.integers(12, 17)),
        *[address] * 3,
        lambda: f"{address()}{pick('/.')}{num(8, 33)}",
        lambda: f"{num(0, 100)}.{num(0, 100)}.{num(0, 1000)}-{pick(('beta', 'alpha', 'rc', 'dev', 'final'))}.{num(1, 9)}",
        lambda: f"+{num(1, 99)}-{num(100, 1000)}-{num(100, 1000)}-{num(1000, 10000)}",
        lambda: "".join("/" + word() for _ in range(rng.integers(2, 5))),
        lambda: f"/{word()}/{word()}/{num(1, 60000)}/{word()}",
        lambda: f"{num(1, 10000)}{word()}{word()}{word()}",
        lambda: pick("-=._/+") * int(rng.integers(12, 60)),
        lambda: "=" * int(rng.integers(8, 20)) + num(100, 10000) + "-" * 6,
    ]
    lead = ["token = \"", "password: ", "api_key=", "secret='", "", "", "", "key ", "Bearer ", "see ", "at http://", "id ", "| ", "(", "@", "mail@"]
    cues = ["passphrase: ", "passphrase=\"", "Passphrase is ", "passphrase '"]  # what tells a passphrase from other words
    around = lambda: " ".join(word() for _ in range(rng.integers(0, 8)))
    out = []
    while len(out) < n:
        label = int(rng.random() < 0.5)
        kinds = secret if label else harmless
        kind = int(rng.integers(len(kinds)))
        core = kinds[kind]()
        if len(core) < CANDIDATE_LENGTH:
            continue
        if not RUN.fullmatch(core):  # words with letters beyond ASCII are cut to a run
            runs = RUN.findall(core)
            if not runs:
                continue
            core = runs[0]
        before = around() + " " + pick(cues if label and kind == len(secret) - 1 else lead)
        after = pick(('"', " ", "\n", "! ", ", ", ") ")) + around()
        out.append((before + core + after, len(before), len(before) + len(core), label))
    return out


def train(findings: list[tuple[str, int, int, int]] | None = None, recall: float = RECALL) -> CharCNN:
    """Fit on four fifths of the findings, calibrate and set the threshold on the rest. The same findings give the same network."""
    findings = labelled_findings() if findings is None else findings
    rng = np.random.default_rng(SEED)
    net = CharCNN(rng)
    each = [windows(t, s, e) for t, s, e, _ in findings]  # every window, as the scan sees them
    owner = np.repeat(np.arange(len(each)), [len(w) for w in each])
    x = np.stack([row for w in each for row in w])
    y = np.array([f[3] for f in findings], np.float32)[owner]
    held = owner % 5 == 4
    xs, ys = x[~held], y[~held]
    m, v, step = {k: 0.0 for k in net.p}, {k: 0.0 for k in net.p}, 0
    for _ in range(ROUNDS):
        order = rng.permutation(len(ys))
        for lo in range(0, len(ys), 32):
            at, step = order[lo : lo + 32], step + 1
            for k, g in net.gradients(xs[at], ys[at]).items():
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                net.p[k] = (net.p[k] - 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    z, t = net.forward(x[held])[0].astype(np.float64), y[held]
    scale, shift = 1.0, 0.0
    for _ in range(300):  # logistic calibration on the held-out findings
        d = 1 / (1 + np.exp(-(scale * z + shift))) - t
        scale, shift = scale - 0.05 * float((d * z).mean() + 1e-3 * scale), shift - 0.05 * float(d.mean())
    net.scale, net.shift = max(scale, 1e-3), shift
    whole = np.zeros(len(each))
    np.maximum.at(whole, owner[held], net.probability(x[held]))
    found = np.sort(whole[np.unique(owner[held & (y == 1)])])
    net.threshold = float(found[int((1 - recall) * len(found))]) if len(found) else 0.5
    return net


def scan_texts(texts: list[str | None], net: CharCNN) -> list[tuple[list, list]]:
    """For each text its base spans and all spans, as sorted (start, kind, end)."""
    base = [base_spans(t or "") for t in texts]
    rows, owner = [], []
    for i, t in enumerate(texts):
        for s, e in candidates(t or "", base[i]):
            w = windows(t, s, e)
            rows += w
            owner += [(i, s, e)] * len(w)
    added: list[set] = [set() for _ in texts]
    for lo in range(0, len(rows), BATCH):
        p = net.probability(np.stack(rows[lo : lo + BATCH]))
        for (i, s, e), hit in zip(owner[lo : lo + BATCH], p >= net.threshold, strict=True):
            if hit:
                added[i].add((s, 3, e))
    return [(b, sorted([*b, *a])) for b, a in zip(base, added, strict=True)]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


SPANS = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_model long"

#: Texts whose candidates go through the network together.
TEXTS = 128


def scan(docs: DataFrame, net: CharCNN | None = None) -> DataFrame:
    """One row a document: counts by kind, digest of the base spans, and all spans as kind:start:end.

    Whole texts are read; null is empty and gives no spans. Repeated rows get equal results, an empty table
    none; other columns are ignored. Offsets are code points, ends exclusive.
    """
    net = train() if net is None else net

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            found = [x for lo in range(0, len(texts), TEXTS) for x in scan_texts(texts[lo : lo + TEXTS], net)]
            count = lambda kind: [sum(s[1] == kind for s in every) for _, every in found]  # noqa: E731, B023
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(ids, pa.int64()),
                **{name: pa.array(count(k), pa.int64()) for k, name in enumerate(("n_assign", "n_access", "n_hex"))},
                "base_sha256": pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], pa.string()),
                "spans": pa.array([joined(every) for _, every in found], pa.string()),
                "n_model": pa.array(count(3), pa.int64()),
            })

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SPANS)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
