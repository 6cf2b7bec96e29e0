"""Secret scans: base patterns, and a character convolutional network over every candidate.

Base findings (fixed patterns for assignments, access keys and long hexadecimal runs) always
stay. Every candidate, that is a run of 12 or more characters of ``[A-Za-z0-9+/_.=-]`` with a
letter and a digit, whether or not a base finding touches it, is scored in numpy from its own
characters and ``CONTEXT`` characters on either side. A run longer than ``PART`` is scored in
overlapping parts that cover all of it; the parts that score, widened to whole words, are the
findings. One that a base finding covers is not listed again.

The network learns from labelled findings: base findings of all documents, each also without its
keyword and in another context, and generated credentials in generated contexts, against plain
tokens (numbers, dates, versions, addresses, identifiers). Equal windows are one row with their number.
Labelled rows are split in three by a hash: the network is trained on the first part, Platt scaling on
the second calibrates its scores, and on the third the threshold is the largest that still recalls
``recall`` of all findings and of the generated ones alone. No labelled row is gathered on the driver: groups of rows are trained side by
side and their weights averaged, round by round, and scores come as numbers for each ``1 / STEPS``.
The rows of the table weigh as much as the generated ones at most.

Null and empty texts have no findings. Each row, repeated ones too, gives one row; an empty table
gives an empty result; other columns are not read, so none can clash. Offsets are code points, end
exclusive. Only labelled windows are shuffled.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm import cnn
from inkwell.llm.common import id_text, materialize, spent

#: Fixed patterns; letters of ``assign`` keywords in either case, ASCII only.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "model")
# Long runs are found first; runs without a digit or a letter are dropped afterwards.
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
CONTEXT, PART = 24, 48
LENGTH = CONTEXT + 1 + PART + 1 + CONTEXT
#: Labelled windows of a group and groups at most, rounds of training and epochs of each.
GROUP, GROUPS, ROUNDS, EPOCHS = 8192, 256, 5, 2
#: Steps of one in which scores are counted.
STEPS = 1024


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of base findings, in order of start and kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    # Runs are maximal, so a least length in the pattern drops the same runs.
    out += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs with a letter and a digit."""
    out = []
    for m in RUN.finditer(text):
        t = m[0]
        if not t.isalpha() and any(map(str.isdigit, t)) and any(map(str.isalpha, t)):
            out.append((m.start(), m.end()))
    return out


def parts(a: int, b: int) -> list[tuple[int, int]]:
    """A span in overlapping parts of at most ``PART`` characters; what is shorter than half of one lies whole in a part."""
    if b - a <= PART:
        return [(a, b)]
    return [*((i, i + PART) for i in range(a, b - PART, PART // 2)), (b - PART, b)]


def widened(text: str, span: tuple[int, int], scored: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """Parts of a span that scored, each to the ends of its words; those that meet are one, of the largest score."""
    out: list[tuple[int, int, float]] = []
    for a, b, p in scored:
        if out and a < out[-1][1]:
            a, b = out[-1][0], max(b, out[-1][1])
        while a > span[0] and text[a - 1].isalnum() and text[a].isalnum():
            a -= 1
        while b < span[1] and text[b].isalnum() and text[b - 1].isalnum():
            b += 1
        if out and a < out[-1][1]:
            out[-1] = (min(a, out[-1][0]), max(b, out[-1][1]), max(p, out[-1][2]))
        else:
            out.append((a, b, p))
    return out


def windows(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """Bytes around each span of at most ``PART`` characters: context, the span, context."""
    x = np.zeros((len(spans), LENGTH), np.uint8)
    for i, (a, b) in enumerate(spans):
        row = text[max(0, a - CONTEXT) : a] + "\x01" + text[a:b] + "\x02" + text[b : b + CONTEXT]
        x[i, : len(row)] = np.frombuffer(row.encode("latin1", "replace"), np.uint8)
    return x


def generated(n: int, seed: int = 11) -> tuple[list[tuple[str, int, int]], list[int]]:
    """Labelled findings made from a seed: credentials of common shapes, and harmless tokens."""
    rng = np.random.default_rng(seed)
    alnum = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"))
    pick = lambda a, k: "".join(rng.choice(a, k))
    letters, digits = alnum[26:52], alnum[52:]
    word = lambda: pick(letters, int(rng.integers(3, 9)))
    out, y = [], []
    for i in range(n):
        secret = i % 2
        if secret:
            run = [
                lambda: pick(np.array(list("0123456789abcdef")), int(rng.integers(24, 65))),
                lambda: pick(np.array(list("0123456789ABCDEF")), int(rng.integers(24, 65))),
                lambda: pick(alnum, int(rng.integers(20, 48))),
                lambda: "AKIA" + pick(np.concatenate([alnum[:26], digits]), 16),
                lambda: pick(np.concatenate([alnum, np.array(list("+/"))]), int(rng.integers(24, 64))) + "=" * int(rng.integers(0, 3)),
                lambda: f"{pick(letters, 2)}_{word()}_{pick(alnum, int(rng.integers(20, 40)))}",
            ][i // 2 % 6]()
            lead = ["", "key: ", 'token = "', "Authorization: Bearer ", "password=", "secret: '"][int(rng.integers(6))]
        else:
            run = [
                lambda: f"{rng.integers(1990, 2030)}-{rng.integers(1, 13):02}-{rng.integers(1, 29):02}T{rng.integers(0, 24):02}",
                lambda: f"{word()}-{rng.integers(0, 20)}.{rng.integers(0, 99)}.{rng.integers(0, 99)}-{word()}",
                lambda: f"/{word()}/{word()}/{rng.integers(0, 9999)}.html",
                lambda: f"{word()}_{word()}_{rng.integers(0, 999)}",
                lambda: word() + word() + word() + pick(digits, int(rng.integers(1, 4))),
                lambda: f"www.{word()}{rng.integers(0, 99)}.example.com",
                lambda: f"{word()}.{word()}{rng.integers(0, 9)}.{word()}",
                lambda: pick(digits, int(rng.integers(10, 20))) + word()[:2],
                lambda: f"{word()}{rng.integers(0, 99)}.{word()}.{['com', 'org', 'net', 'de'][int(rng.integers(4))]}",
            ][i // 2 % 9]()
            lead = ["", "see ", "version ", "on ", "https://", "file ", f"{word()}.{rng.integers(0, 99)}@"][int(rng.integers(7))]
        before, after = " ".join(word() for _ in range(4)) + " " + lead, [" ", '" ', ". ", "\n"][int(rng.integers(4))] + " ".join(word() for _ in range(4))
        for a, b in parts(len(before), len(before) + len(run)):
            out.append((before + run + after, a, b))
            y.append(secret)
    return out, y


def embedded(n: int, seed: int = 12) -> tuple[list[tuple[str, int, int]], list[int]]:
    """Labelled parts of long paths and addresses made from a seed, half of them around a credential."""
    rng = np.random.default_rng(seed)
    alnum = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"))
    pick = lambda a, k: "".join(rng.choice(a, k))
    word = lambda: pick(alnum[26:52], int(rng.integers(2, 10)))
    step = lambda: [word, lambda: f"v{rng.integers(0, 20)}", lambda: f"{word()}-{word()}", lambda: f"{rng.integers(1990, 2030)}", lambda: f"{word()}_{rng.integers(0, 999)}", lambda: f"{word()}.{word()}"][int(rng.integers(6))]()
    path = lambda k: "/".join(step() for _ in range(k))
    out, y = [], []
    for i in range(n):
        key = pick([alnum, alnum[:16], alnum[26:]][int(rng.integers(3))], int(rng.integers(24, 64))) if i % 2 else ""
        head = f"{word()}.example.com/" * int(rng.integers(0, 2)) + path(int(rng.integers(1, 6))) + "/"
        tail = "/" + path(int(rng.integers(1, 6))) + ["", ".png", ".html", ".tar.gz"][int(rng.integers(4))]
        run = head + (key or path(8)) + tail
        before = " ".join(word() for _ in range(4)) + " "
        text, at = before + run + " " + word(), len(before) + len(head)
        for a, b in parts(len(before), len(before) + len(run)):
            inside = min(b, at + len(key)) - max(a, at)
            if not key or inside >= PART // 2 or inside <= 0:  # what holds less of a key has no label
                out.append((text, a, b))
                y.append(int(bool(key) and inside > 0))
    return out, y


@dataclass
class SecretModel:
    net: cnn.ByteCNN
    slope: float
    shift: float
    threshold: float
    #: Share of findings recalled on the rows that set the threshold, and labelled rows of each part.
    recalled: float = 0.0
    sizes: dict[str, int] = field(default_factory=dict)

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.empty(0)
        return self.calibrated(margins(self.net, x))

    def calibrated(self, d: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * d + self.shift, -30, 30)))

    def findings(self, texts: list[str | None]) -> tuple[list[list[tuple[int, int, int]]], list[list[tuple[int, int, int, float]]]]:
        """Base spans of each text, and spans with scores that the network adds."""
        base = [base_spans(t) if t else [] for t in texts]
        where, rows = [], []
        for i, t in enumerate(texts):
            if t and (got := candidates(t)):
                cut = [(s, a, b) for s in got for a, b in parts(*s)]
                where += [(i, s, a, b) for s, a, b in cut]
                rows.append(windows(t, [(a, b) for _, a, b in cut]))
        scored: dict[tuple[int, tuple[int, int]], list[tuple[int, int, float]]] = {}
        if rows:
            for (i, s, a, b), p in zip(where, self.probability(np.concatenate(rows)), strict=True):
                if p >= self.threshold:
                    scored.setdefault((i, s), []).append((a, b, float(p)))
        added: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
        for (i, s), x in scored.items():
            found = widened(texts[i], s, x)
            known = set(_outside([(a, b) for a, b, _ in found], base[i]))
            added[i] += [(a, 3, b, p) for a, b, p in found if (a, b) in known]
        return base, added


def _outside(spans: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Spans that base findings, joined where they meet, don't cover."""
    if not base:
        return spans
    merged: list[list[int]] = []
    for a, _, b in base:  # in order of start
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    begins = [m[0] for m in merged]
    return [(a, b) for a, b in spans if (k := bisect_right(begins, a) - 1) < 0 or merged[k][1] < b]


def elsewhere(text: str, a: int, b: int, nth: int) -> tuple[str, int, int]:
    """A finding's value without its keyword, in a context of its own."""
    m = ASSIGN.match(text, a)
    value = m[2] if m and m.end() == b else text[a:b]
    before, after = [("", ""), ("see ", " there"), ("the new one is ", "."), ("> ", "\n> and so on")][nth % 4]
    return before + value + after, len(before), len(before) + len(value)


def margins(net: cnn.ByteCNN, x: np.ndarray) -> np.ndarray:
    z = net.logits(x)
    return (z[:, 1] - z[:, 0]).astype(float)


def labelled(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """x, y, n, fold: every distinct labelled window of all documents, with its number."""

    def gather(batches):
        for b in batches:
            for t in b.column(text).to_pylist():
                base = base_spans(t)
                touched = lambda a, e: any(s < e and a < f for s, _, f in base)  # noqa: E731, B023
                spans = [(t, a, e, 1) for a, _, e in base] + [(t, a, e, 0) for a, e in candidates(t) if not touched(a, e)]
                spans += [(*elsewhere(t, a, e, a), 1) for a, _, e in base]
                if spans:
                    spans = [(s, p, q, y) for s, a, e, y in spans for p, q in parts(a, e)]
                    x = [windows(s, [(a, e)])[0] for s, a, e, _ in spans]
                    yield pa.RecordBatch.from_pydict({"x": [r.tobytes() for r in x], "y": [s[3] for s in spans]}, pa.schema([("x", pa.binary()), ("y", pa.int32())]))

    rows = id_text(docs, key, text).where(F.length(text) > 0).mapInArrow(gather, "x binary, y int")
    return rows.groupBy("x", "y").agg(F.count("*").alias("n")).withColumn("fold", F.pmod(F.xxhash64("x", "y"), F.lit(5)).cast("int"))


def _opened(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows, labels and weights. Unlabelled runs may be secrets themselves: they weigh less than generated ones."""
    x = np.frombuffer(b"".join(v.as_buffer() for v in batch.column("x")), np.uint8).reshape(-1, LENGTH)
    y = batch.column("y").to_numpy().astype(np.int64)
    return x, y, np.where(y == 1, 1.0, 0.2) * batch.column("n").to_numpy()


def fitted(net: cnn.ByteCNN, rows: DataFrame, groups: int, x: np.ndarray, y: np.ndarray) -> cnn.ByteCNN:
    """The network trained on all ``rows`` and on generated ``x`` and ``y``, which every group has besides its rows."""
    names = ("emb", "conv", "bias", "out", "base")

    def learn(batches):
        held = [_opened(b) for b in batches if b.num_rows]
        if held:
            ours, labels, weight = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((labels, *ours.T[::-1]))
            ours, labels, weight = ours[order], labels[order], weight[order]
            weight = np.concatenate([np.ones(len(y)), weight * min(1.0, len(y) / weight.sum())])
            now.train(np.concatenate([x, ours]), np.concatenate([y, labels]), epochs=EPOCHS, weights=weight, seed=nth)
            yield pa.RecordBatch.from_pydict({"first": [ours[0].tobytes()], "rows": [len(ours)], "net": [np.concatenate([getattr(now, k).ravel() for k in names]).tobytes()]})

    dealt = rows.select("x", "y", "n", F.pmod(F.xxhash64("y", "x"), F.lit(max(1, groups))).cast("int").alias("part"))
    for nth in range(ROUNDS):
        now = net
        got = sorted(dealt.repartitionById(groups, F.col("part")).select("x", "y", "n").mapInArrow(learn, "first binary, rows long, net binary").collect(), key=lambda r: bytes(r.first)) if groups else []
        if not got:
            net.train(x, y, epochs=EPOCHS, seed=nth)
            continue
        mean = np.average([np.frombuffer(r.net, np.float32) for r in got], axis=0, weights=[r.rows for r in got]).astype(np.float32)
        at = 0
        for k in names:
            size = getattr(net, k).size
            setattr(net, k, mean[at : at + size].reshape(getattr(net, k).shape))
            at += size
    return net


def _counted(net: cnn.ByteCNN, rows: DataFrame) -> dict[tuple[int, int], np.ndarray]:
    """For each fold and label, the least margin in each step, rising, with the number of windows and how many are distinct."""

    def score(batches):
        for b in batches:
            if b.num_rows:
                d = margins(net, _opened(b)[0])
                yield pa.RecordBatch.from_arrays([b.column("fold"), b.column("y"), b.column("n"), pa.array(d), pa.array(np.floor(d * STEPS).astype(np.int64))], ["fold", "y", "n", "d", "step"])

    scored = rows.mapInArrow(score, "fold int, y int, n long, d double, step long")
    out: dict[tuple[int, int], list] = {}
    for r in scored.groupBy("fold", "y", "step").agg(F.min("d").alias("d"), F.sum("n").alias("n"), F.count("*").alias("m")).collect():
        out.setdefault((r.fold, r.y), []).append((r.d, r.n, r.m))
    return {k: np.array(sorted(v), float) for k, v in out.items()}


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", made: int = 4000, recall: float = 0.95) -> SecretModel:
    """Fit on the findings of all documents and ``made`` generated ones."""
    rows = materialize(labelled(docs, key, text))
    made_x, made_y = (a + b for a, b in zip(generated(made), embedded(made // 3), strict=True))
    x, y = np.concatenate([windows(t, [(a, b)]) for t, a, b in made_x]), np.array(made_y)
    order = np.random.default_rng(4).permutation(len(y))
    use, scale, last = np.split(order, [3 * len(y) // 5, 4 * len(y) // 5])
    learnt = rows.where("fold < 3")
    n = learnt.count()
    net = fitted(cnn.ByteCNN(2, LENGTH, widths=(2, 3, 5), filters=16, seed=8), learnt, min(GROUPS, -(-n // GROUP)), x[use], y[use])
    found = _counted(net, rows.where("fold >= 3"))
    spent(rows)
    none = np.empty((0, 3))
    theirs = {(fold, label): found.get((fold, label), none) for fold in (3, 4) for label in (0, 1)}
    model = SecretModel(net, 1.0, 0.0, 0.5)
    model.sizes = {"network": len(use) + n, **{k: len(own) + int(sum(theirs[fold, label][:, 2].sum() for label in (0, 1))) for k, own, fold in (("scale", scale, 3), ("threshold", last, 4))}}
    d = np.concatenate([margins(net, x[scale]), theirs[3, 0][:, 0], theirs[3, 1][:, 0]])
    t = np.concatenate([y[scale], np.zeros(len(theirs[3, 0])), np.ones(len(theirs[3, 1]))])
    w = np.concatenate([0.2 * theirs[3, 0][:, 1], theirs[3, 1][:, 1]])
    w = np.concatenate([np.ones(len(scale)), w * min(1.0, len(scale) / max(w.sum(), 1e-9))])
    for _ in range(200):  # Platt scaling
        p = model.calibrated(d)
        g = w * (p - t)
        model.slope, model.shift = model.slope - 0.05 * float((g * d).sum() / w.sum()), model.shift - 0.5 * float(g.sum() / w.sum())
    own, w = model.calibrated(margins(net, x[last][y[last] == 1])), theirs[4, 1][:, 1]
    p = np.concatenate([own, model.calibrated(theirs[4, 1][:, 0])])
    w = np.concatenate([np.ones(len(own)), w * min(1.0, len(own) / max(w.sum(), 1e-9))])
    model.threshold = min(recalling(own, recall), recalling(p, recall, w))
    model.recalled = float(w[p >= model.threshold].sum() / w.sum()) if len(p) else 0.0
    return model


def recalling(found: np.ndarray, recall: float, weight: np.ndarray | None = None) -> float:
    """The largest score that ``recall`` of the findings reach; one half without findings."""
    if not len(found):
        return 0.5
    order = np.argsort(found, kind="stable")
    below = np.cumsum(np.ones(len(found)) if weight is None else weight[order])
    return float(found[order][min(int(np.searchsorted(below, (1 - recall) * below[-1], "right")), len(found) - 1)])


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secrets(docs: DataFrame, model: SecretModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_assign, n_access, n_hex, base (spans as text), added (array of spans with scores)."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def scan(batches):
        for b in batches:
            base, added = model.findings(b.column(text).to_pylist())
            count = lambda k: pa.array([sum(s[1] == k for s in x) for x in base], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(key), count(0), count(1), count(2),
                    pa.array([_joined(x) for x in base], pa.string()),
                    pa.array([_joined(sorted([*x, *(s[:3] for s in a)])) for x, a in zip(base, added, strict=True)], pa.string()),
                    pa.array([[{"start": s[0], "end": s[2], "score": s[3]} for s in a] for a in added], kind),
                ],
                [key, "n_assign", "n_access", "n_hex", "base", "spans", "added"],
            )

    return id_text(docs, key, text).mapInArrow(scan, f"`{key}` long, n_assign long, n_access long, n_hex long, base string, spans string, added array<struct<start:bigint,end:bigint,score:double>>")


def digest_query(docs: DataFrame) -> DataFrame:
    out = secrets(docs, train(docs))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", F.size("added").cast("long").alias("n_model"))


def brute_force(text: str | None) -> tuple[list[tuple[int, int, int]], str]:
    """Base findings by the plain rule, for tests."""
    t = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m.group(2)) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(t) if len(m.group()) >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(t) if len(m.group()) >= 24]
    out.sort()
    return out, hashlib.sha256(_joined(out).encode()).hexdigest()
