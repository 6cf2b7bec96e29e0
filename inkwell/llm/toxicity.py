"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

1. Voters: every term of a lexicon, and patterns over a text (share and number of lexicon words
   in steps, shouting, exclamation, address in the second person, no lexicon word at all, no
   lexicon word in a text of many words). The lexicon holds seed insults and terms mined from
   labelled rows: words, and word beginnings of 4 to 8 bytes, that make up a much larger share of
   toxic texts. A voter that does not fire abstains; a few vote for clean. Given labels are one
   more voter, which errs like others.
2. Label model: a hidden class makes the votes. Which voters depend on each other is part of the
   model: each vote depends on the class and on at most one other vote, along the tree of the
   largest conditional mutual information, so that votes that move together, or shut each other
   out, count once. Expectation-maximisation starts from a majority in which voters have the
   same say, but for those that vote alike, who share one, and estimates tree, rates of all votes in either class, hence accuracies,
   and the class share.
3. Classifier: logistic regression with an L1 penalty on the posterior labels, over the presence
   of terms and the patterns. Only its weights reach the scoring pass.

Training reads a bounded sample of labelled rows (``per_label`` of each label); scoring reads
every whole text in place, without a shuffle. Null and empty texts get the score of a text
without words. Without labelled rows nothing is mined and the seed lexicon decides. Each row gives
one row, repeated ones the same score; an empty table gives an empty result; only ids, texts and
labels are read, so no other column can clash.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm import words as W
from inkwell.llm.common import fold, id_text, sampled, slices, utf8

#: Insults of four languages, and words that address the reader.
SEED = (
    "idiot moron stupid scum loser pathetic disgusting worthless trash clown imbecile bastard cretin dimwit "
    "scumbag vermin degenerate filth subhuman "
    "abruti connard salaud ordure minable crétin débile pourriture "
    "arschloch dummkopf trottel abschaum widerlich erbärmlich missgeburt "
    "gilipollas imbécil escoria basura cabrón patético asqueroso inútil"
).split()
ADDRESS = "you your you're tu toi vous votre du dich dir euch usted ustedes vosotros".split()

LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
PREFIXES = (4, 5, 6, 7, 8)
SHARES = (2, 5, 10, 15, 20, 30, 50)  # thousandths of the words
PATTERNS = ("none", "wordy", "two", "three", "shouting", "exclaiming", "addressed", *(f"share{t}" for t in SHARES))
#: Those that vote for clean.
CLEAN = ("none", "wordy")


def _hashes(tokens: list[str]) -> np.ndarray:
    joined = " ".join(tokens).encode()
    data = np.frombuffer(joined, np.uint8)
    s, e, _ = W.word_spans(data, np.array([0, len(data)]), W.NOT_SPACE)
    return np.sort(W.span_hashes(data, s, e, W.LOWER_CODES))


def tokens(column: pa.Array):
    """For ranges of rows: (first row, rows, bytes, word starts, word ends, row of each word, shouted words, exclamations)."""
    offsets, data = utf8(column)
    for a, b in slices(offsets):
        off, d = offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]]
        s, e, row = W.word_spans(d, off, LETTERS)
        caps = np.concatenate([[0], np.cumsum(UPPER[d])])
        shout = np.bincount(row, (caps[e] - caps[s] == e - s) & (e - s > 1), b - a)
        marks = np.concatenate([[0], np.cumsum(d == 33)])
        yield a, b - a, d, s, e, row, shout, (marks[off[1:]] - marks[off[:-1]])


def _patterns(n_words: np.ndarray, n_lex: np.ndarray, n_you: np.ndarray, shout: np.ndarray, marks: np.ndarray) -> np.ndarray:
    per = np.maximum(n_words, 1)
    first = [n_lex == 0, (n_lex == 0) & (n_words >= 100), n_lex >= 2, n_lex >= 3, shout * 2 > per, marks * 5 > per, (n_you > 0) & (n_lex > 0)]
    return np.stack([*first, *((n_lex * 1000 >= t * per) & (n_lex > 0) for t in SHARES)], 1)


@dataclass
class ToxicityModel:
    """Terms by length (0: the whole word) as sorted hashes with their index in ``weights``."""

    terms: dict[int, tuple[np.ndarray, np.ndarray]]
    weights: np.ndarray
    patterns: np.ndarray
    base: float
    address: np.ndarray = field(default_factory=lambda: _hashes(ADDRESS))
    names: list[str] = field(default_factory=list)

    def find(self, d: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(term of each word or -1, whether it addresses the reader)."""
        h = W.span_hashes(d, s, e, W.LOWER_CODES)
        you = _member(h, self.address) >= 0
        out = np.full(len(h), -1)
        for k, (known, index) in self.terms.items():
            if k:
                fit = np.flatnonzero((e - s >= k) & (out < 0))
                at = _member(W.span_hashes(d, s[fit], s[fit] + k, W.LOWER_CODES), known)
                out[fit] = np.where(at >= 0, index[at], -1)
            else:
                at = _member(h, known)
                out = np.where(at >= 0, index[at], out)
        return out, you

    def score(self, column: pa.Array) -> np.ndarray:
        out = np.empty(len(column))
        m = len(self.weights)
        for a, n, d, s, e, row, shout, marks in tokens(column):
            term, you = self.find(d, s, e)
            on = term >= 0
            feats = _patterns(np.bincount(row, minlength=n), np.bincount(row[on], minlength=n), np.bincount(row[you], minlength=n), shout, marks)
            pairs = np.unique(row[on] * m + term[on])
            z = self.base + feats @ self.patterns + np.bincount(pairs // m, self.weights[pairs % m], n)
            out[a : a + n] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out


def _member(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Index in the sorted array ``known``, or -1."""
    if not len(known):
        return np.full(len(h), -1)
    i = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[i] == h, i, -1)


def dependencies(votes: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For each voter the one it depends on besides the class, or -1: a maximum spanning forest of
    conditional mutual information, of those edges that chance does not explain."""
    n, m = votes.shape
    total = np.zeros((m, m))
    for w in (q, 1 - q):
        size = max(float(w.sum()), 1e-9)
        one = (w @ votes)[:, None]
        both = votes.T @ (w[:, None] * votes)
        for cell, a, b in ((both, one, one.T), (one - both, one, size - one.T), (one.T - both, size - one, one.T), (size - one - one.T + both, size - one, size - one.T)):
            cell = np.maximum(cell, 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                total += np.where(cell > 1e-9, cell / n * np.log(cell * size / (a * b)), 0)
    # Twice n times the information is chi-squared for independent votes, one degree of freedom in each class.
    total[total < 7.0 / n] = 0
    np.fill_diagonal(total, 0)
    parent, best, inside = np.full(m, -1), np.zeros(m), np.zeros(m, bool)
    for _ in range(m):
        j = int(np.where(inside, -1, best).argmax())
        inside[j] = True
        better = ~inside & (total[j] > best)
        best[better], parent[better] = total[j][better], j
    return parent


def label_model(votes: np.ndarray, toxic: np.ndarray, labels: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Posterior P(toxic) of each row and accuracy of each voter, from a 0/1 matrix of fired voters and which of them vote for toxic.

    The given labels are one more voter, the last, which never abstains.
    """
    v = np.concatenate([votes, labels[:, None]], 1).astype(np.float64)
    # A majority: each vote has the odds of a voter who is right seven times in ten, shared among those that vote alike.
    side = np.where(np.append(toxic, True), 1.0, -1.0)
    rest = v - v.mean(0)
    sd = np.sqrt(np.maximum((rest * rest).sum(0), 1e-9))
    says = side / np.maximum(((rest.T @ rest / sd[:, None] / sd[None]) ** 2).sum(1), 1.0)
    says[-1] = 1.0
    ballots = v @ says - (1 - labels) * says[-1]
    q = 1 / (1 + np.exp(-np.clip(np.log(0.7 / 0.3) * ballots, -30, 30)))
    for i in range(rounds):
        if i % 5 == 0:
            # Labels err on their own: they tie the hidden class to what is asked for.
            parent = np.append(dependencies(v[:, :-1], q), -1)
            given = np.where(parent[None] >= 0, v[:, np.maximum(parent, 0)], 0.0)
        share = float(np.clip(q.mean(), 1e-3, 1 - 1e-3))
        odds = np.full(len(v), np.log(share / (1 - share)))
        for sign, w in ((1, q), (-1, 1 - q)):
            base = (w @ v + 0.5) / (w.sum() + 1)  # rates without the parent, towards which small counts lean
            for b in (0.0, 1.0):
                here = w[:, None] * (given == b)
                rate = ((here * v).sum(0) + 2 * base) / (here.sum(0) + 2)
                odds += sign * np.where(given == b, np.where(v > 0, np.log(rate), np.log1p(-rate)), 0).sum(1)
        q = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    right = np.where(side > 0, q @ v, (1 - q) @ v) / np.maximum(v.sum(0), 1e-9)
    return q, right


def _index(terms: list[bytes], whole: list[bool]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    out = {}
    for k in (0, *PREFIXES):
        ids = np.array([i for i, (t, w) in enumerate(zip(terms, whole, strict=True)) if (0 if w else len(t)) == k], np.int64)
        if len(ids):
            data = np.frombuffer(b"".join(terms[i] for i in ids), np.uint8)
            ends = np.cumsum([len(terms[i]) for i in ids])
            h = W.span_hashes(data, np.concatenate([[0], ends[:-1]]), ends, W.LOWER_CODES)
            order = np.argsort(h)
            out[k] = h[order], ids[order]
    return out


def mine(docs: list[tuple[list[bytes], np.ndarray]], n_words: np.ndarray, toxic: np.ndarray, most: int = 200, least: int = 12, lift: float = 6.0) -> tuple[list[bytes], list[bool]]:
    """Words and word beginnings whose share of toxic texts is ``lift`` times that of others.

    Evidence is a log-likelihood ratio over texts, so that one text of many hits counts once;
    the strongest term goes first and shuts out those that begin it or that it begins.
    """
    seen: dict[tuple[bytes, bool], list[float]] = {}
    n = [np.maximum((1 - toxic).sum(), 1), np.maximum(toxic.sum(), 1)]
    for (words, times), size, y in zip(docs, n_words, toxic, strict=True):
        share: dict[tuple[bytes, bool], int] = {}
        for w, t in zip(words, times, strict=True):
            share[w, True] = share.get((w, True), 0) + t
            for k in PREFIXES:
                if len(w) >= k:
                    share[w[:k], False] = share.get((w[:k], False), 0) + t
        for key, t in share.items():
            row = seen.setdefault(key, [0, 0, 0, 0])
            row[y] += 1
            row[2 + y] += t / max(size, 1)
    found = []
    for key, (d0, d1, s0, s1) in seen.items():
        if d1 < least or (s1 / n[1]) < lift * ((s0 + 1e-3) / n[0]):
            continue
        p, p0, p1 = (d0 + d1) / sum(n), d0 / n[0], d1 / n[1]
        if p1 <= p0:
            continue
        g = d1 * np.log(p1 / p) + (n[1] - d1) * np.log(max(1 - p1, 1e-9) / (1 - p + 1e-9))
        g += d0 * np.log(max(p0, 1e-9) / p) + (n[0] - d0) * np.log((1 - p0) / (1 - p + 1e-9))
        # Presence in texts, weighted by how much larger the share in toxic texts is.
        found.append((g * min(np.log((s1 / n[1]) / ((s0 + 1e-3) / n[0])), 4), key))
    found.sort(key=lambda x: (-x[0], x[1]))
    terms, whole = [], []
    for g, (t, w) in found:
        if g < 20 or len(terms) == most:
            break
        if not any(t.startswith(u) if not v else (u.startswith(t) if not w else t == u) for u, v in zip(terms, whole, strict=True)) and not any(u.startswith(t) for u, v in zip(terms, whole, strict=True) if not v and not w):
            terms.append(t)
            whole.append(w)
    return terms, whole


def fit(docs: list[tuple[list[bytes], np.ndarray]], extra: np.ndarray, toxic: np.ndarray) -> ToxicityModel:
    """From each row's distinct words with counts, (words, shouted, exclamations, addresses), and its label."""
    n = len(toxic)
    seed = [w.encode() for w in SEED]
    terms, whole = mine(docs, extra[:, 0], toxic) if n else ([], [])
    more = [w for w in seed if not any(w == t or not v and w.startswith(t) for t, v in zip(terms, whole, strict=True))]
    terms, whole = terms + more, whole + [True] * len(more)
    model = ToxicityModel(_index(terms, whole), np.zeros(len(terms)), np.zeros(len(PATTERNS)), 0.0, names=[t.decode("utf8", "replace") for t in terms])
    if not n:
        model.patterns[0], model.base = -4.0, 1.5
        return model
    counts = np.zeros((n, len(terms)))
    for i, (words, times) in enumerate(docs):
        if words:
            ends = np.cumsum([len(w) for w in words])
            term, _ = model.find(np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], ends[:-1]]), ends)
            np.add.at(counts[i], term[term >= 0], times[term >= 0])
    x = _patterns(extra[:, 0], counts.sum(1), extra[:, 3], extra[:, 1], extra[:, 2])
    fired = counts * 1000 >= 1.5 * np.maximum(extra[:, :1], 1)
    says_toxic = np.array([True] * len(terms) + [c not in CLEAN for c in PATTERNS])
    q, _ = label_model(np.concatenate([fired & (counts > 0), x], 1), says_toxic, toxic)
    # Linear classifier on posterior labels by proximal gradient steps, each scaled by the
    # weight's own curvature bound and damped as features overlap.
    x = np.concatenate([counts > 0, x], 1).astype(float)
    w, b = np.zeros(x.shape[1]), 0.0
    curve = 0.25 * x.mean(0) + 1e-3
    rate, l1 = 0.1, 1e-3
    for _ in range(800):
        s = 1 / (1 + np.exp(-np.clip(b + x @ w, -30, 30)))
        g = (s - q) / n
        w = w - rate * (x.T @ g) / curve
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1 / curve, 0)
        b = b - rate * g.sum() / 0.25
    model.weights, model.patterns, model.base = w[: len(terms)], w[len(terms) :], float(b)
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", per_label: int = 2000) -> ToxicityModel:
    """Fit on about ``per_label`` labelled rows of each class of ``labels`` joined to ``docs``."""
    picked = sampled(labels.select(F.col(key).cast("long").alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y in (0, 1)"), "k", per_label, "y")
    # The sample has a fixed size, so this side may be broadcast.
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).join(F.broadcast(picked.distinct()), "k")
    address = _hashes(ADDRESS)

    def gather(batches):
        for batch in batches:
            y, k = batch.column("y").to_numpy(zero_copy_only=False), batch.column("k").to_numpy(zero_copy_only=False)
            for a, n, d, s, e, row, shout, marks in tokens(batch.column("t")):
                low = W.LOWER[d].tobytes()
                you = _member(W.span_hashes(d, s, e, W.LOWER_CODES), address) >= 0
                cuts = np.searchsorted(row, np.arange(n + 1))
                got = [Counter(low[s[j] : e[j]] for j in range(cuts[i], cuts[i + 1])) for i in range(n)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "k": k[a : a + n],
                        "y": y[a : a + n],
                        "w": [b" ".join(c) for c in got],
                        "c": [np.array(list(c.values()), np.int64).tobytes() for c in got],
                        "n": np.diff(cuts),
                        "s": shout.astype(np.int64),
                        "m": marks.astype(np.int64),
                        "v": np.bincount(row[you], minlength=n),
                    }
                )

    got = rows.mapInArrow(gather, "k long, y int, w binary, c binary, n long, s long, m long, v long").collect()
    got.sort(key=lambda r: (r.k, r.y, bytes(r.w)))
    # Near copies count once for each label: those that agree in two minimum hashes of their words.
    once = {}
    for r in got:
        words = bytes(r.w).split()
        once.setdefault((r.y, min(map(zlib.crc32, words), default=0), min((zlib.adler32(w) * 2654435761 % (1 << 32) for w in words), default=0), len(words) < 3 and bytes(r.w)), r)
    got = list(once.values())
    docs_ = [(bytes(r.w).split(), np.frombuffer(r.c, np.int64)) for r in got]
    return fit(docs_, np.array([(r.n, r.s, r.m, r.v) for r in got], np.int64).reshape(-1, 4), np.array([r.y for r in got], np.int64))


def toxicity(docs: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score for every row."""

    def score(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(model.score(b.column(text)))], [key, "score"])

    return id_text(docs, key, text).mapInArrow(score, f"`{key}` long, score double")


def evaluate_query(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted: labels learnt from outside the held-out fold only."""
    out = toxicity(docs, train(docs, labels.where(fold("doc_id", 3) != 1)))
    held = F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    return out.select("doc_id", held, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
