"""Language-model scores from a gated recurrent network in numpy.

Word counts are taken over all training documents. The words seen ``often``
times, and at least the ``vocabulary`` most frequent ones (and the end mark),
form classes of equal size by frequency, of ``class_size`` words or as many words as classes;
all other words form one tail class. The next token's probability is that of its
class times that of the word in its class, both softmax outputs of a GRU; in
the tail class it is the word's add-one frequency. The network is trained by
truncated backpropagation over every training document once: in each round,
every executor partition trains on its own documents of the round from common
weights, and the weights are averaged, weighted by tokens. Scoring carries the state from window to window through the whole
document.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import repeat
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import load, materialize, ship
from .langid import held_out

ship(__name__)

END = 0
LN10 = float(np.log(10))


@dataclass(frozen=True)
class Config:
    """vocabulary: words of the network on small inputs; ``often``: words seen so many times join it, up to ``resolved``.

    resolved: up to so many frequent words' counts go to every task; rarer words meet their counts in a join.
    tokens_per_part: so many tokens are trained on between two averages of the models.
    """

    vocabulary: int = 1024
    often: int = 4000
    class_size: int = 128
    hidden: int = 8
    window: int = 16
    lanes: int = 512
    rounds: int = 3
    rate: float = 0.4
    resolved: int = 150_000
    tokens_per_part: int = 1_500_000
    seed: int = 7


def words_of(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased."""
    return (text or b"").lower().split()


def _count(batches):
    counts: Counter = Counter()

    def out():
        items = list(counts.items())
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in items], pa.binary()), pa.array([n for _, n in items], pa.int64())], ["word", "n"])

    for batch in batches:
        for text in batch.column(0):
            counts.update(words_of(text.as_py()))
            if len(counts) > 400_000:
                yield out()
                counts = Counter()
    if counts:
        yield out()


def word_counts(texts: DataFrame) -> DataFrame:
    """word (binary) and c (long) over all texts of the one binary column."""
    return texts.mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def _exp_sum(logit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials, in place of the logits, and their row sums; rows that would overflow are shifted first, in a copy that is no longer the argument."""
    if np.abs(logit[:, 0]).max(initial=0) < 40 and logit.max(initial=0) < 80:
        np.exp(logit, out=logit)
        return logit, logit.sum(1)
    logit -= logit.max(1, keepdims=True)
    e = np.exp(logit)
    return e, e.sum(1)


class GRU:
    """Parameters and passes; tokens are 0 to size - 1, token size is the tail."""

    NAMES = ("inp", "rec", "cls_w", "cls_b", "out_w", "out_b")

    def __init__(self, cfg: Config, counts: np.ndarray, tail: float):
        rng = np.random.default_rng(cfg.seed)
        self.cfg, self.size = cfg, len(counts)
        h, s = cfg.hidden, max(cfg.class_size, ceil(sqrt(self.size - 1)))
        self.width = s
        self.classes = -(-self.size // s)
        mass = np.zeros(self.classes * s)
        mass[: self.size] = counts + 1.0
        mass = mass.reshape(self.classes, s)
        self.p = {
            "inp": rng.normal(0, 0.1, (self.size + 1, 3 * h)).astype(np.float32),
            "rec": rng.normal(0, h**-0.5, (h, 3 * h)).astype(np.float32),
            "cls_w": np.zeros((h, self.classes + 1), np.float32),
            "cls_b": np.log(np.append(mass.sum(1), tail + 1.0) / (mass.sum() + tail + 1.0)).astype(np.float32),
            "out_w": np.zeros((self.classes, h, s), np.float32),
            "out_b": np.where(mass > 0, np.log(np.maximum(mass, 1e-9) / mass.sum(1, keepdims=True)), -1e4).astype(np.float32),
        }

    def pack(self) -> bytes:
        return b"".join(self.p[k].tobytes() for k in self.NAMES)

    def unpack(self, blob: bytes) -> None:
        flat, at = np.frombuffer(blob, np.float32), 0
        for k in self.NAMES:
            n = self.p[k].size
            self.p[k] = flat[at : at + n].reshape(self.p[k].shape).copy()
            at += n

    def states(self, x: np.ndarray, h: np.ndarray, keep: np.ndarray | None = None, trace: dict | None = None) -> np.ndarray:
        """Hidden states after each of the steps of x (steps, rows), from h (rows, hidden).

        Where ``keep`` (steps, rows) is 0 a document starts and the state is 0.
        ``trace`` gets what the way back needs.
        """
        k = self.cfg.hidden
        rec, given = self.p["rec"], self.p["inp"][x]
        given[:, :, : 2 * k] *= 0.5  # sigmoid(a) = (tanh(a / 2) + 1) / 2
        half = rec.copy()
        half[:, : 2 * k] *= 0.5
        shape = (len(x), len(h), k)
        out = np.empty(shape, np.float32)
        if trace is not None:
            trace |= {"before": np.empty(shape, np.float32), "gate": np.empty((*shape[:2], 2 * k), np.float32), "new": np.empty(shape, np.float32), "pull": np.empty(shape, np.float32)}
        for t in range(len(x)):
            if keep is not None:
                h = h * keep[t][:, None]
            a, u = given[t], h @ half
            g = a[:, : 2 * k] + u[:, : 2 * k]
            np.tanh(g, out=g)
            g += 1
            g *= 0.5
            z = g[:, :k]
            n = u[:, 2 * k :] * g[:, k:]
            n += a[:, 2 * k :]
            np.tanh(n, out=n)
            if trace is not None:
                trace["before"][t], trace["gate"][t], trace["new"][t], trace["pull"][t] = h, g, n, u[:, 2 * k :]
            h = np.subtract(h, n, out=out[t])
            h *= z
            h += n
        return out

    def log_probs(self, h: np.ndarray, y: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log probability of each token (of its class, for the tail); with grads, also the loss's slope in h.

        Tokens are sorted by class, so that each class's rows are one slice.
        """
        s = self.width
        order = np.argsort(y, kind="stable")
        h, y = h[order], y[order]
        cls = np.minimum(y // s, self.classes)
        cls[y >= self.size] = self.classes
        rows = np.arange(len(y))
        logit = h @ self.p["cls_w"]
        logit += self.p["cls_b"]
        lp = logit[rows, cls]
        e, total = _exp_sum(logit)
        lp = lp - np.log(total) if e is logit else logit[rows, cls] - np.log(total)
        dh = None
        if grads is not None:
            e /= total[:, None]
            e[rows, cls] -= 1
            grads["cls_w"] += h.T @ e
            grads["cls_b"] += e.sum(0)
            dh = e @ self.p["cls_w"].T
        ends = np.searchsorted(cls, np.arange(self.classes + 1))
        w = y - cls * s
        for c in np.flatnonzero(ends[1:] > ends[:-1]):
            lo, hi = ends[c], ends[c + 1]
            hc, wc, k = h[lo:hi], w[lo:hi], rows[: hi - lo]
            logit = hc @ self.p["out_w"][c]
            logit += self.p["out_b"][c]
            own = logit[k, wc]
            e, total = _exp_sum(logit)
            lp[lo:hi] += (own if e is logit else logit[k, wc]) - np.log(total)
            if grads is not None:
                e /= total[:, None]
                e[k, wc] -= 1
                grads["out_w"][c] += hc.T @ e
                grads["out_b"][c] += e.sum(0)
                dh[lo:hi] += e @ self.p["out_w"][c].T
        back = np.empty(len(y))
        back[order] = lp
        if dh is not None:
            slope = np.empty_like(dh)
            slope[order] = dh
            dh = slope
        return back, dh

    def slopes(self, x: np.ndarray, y: np.ndarray, keep: np.ndarray, h: np.ndarray, grads: dict) -> tuple[float, np.ndarray]:
        """The loss over a window and the state after it; adds the loss's slope in each parameter to ``grads``.

        Where y is -1 there is no token.
        """
        k = self.cfg.hidden
        trace: dict = {}
        hs = self.states(x, h, keep, trace)
        valid = y >= 0
        lp, slope = self.log_probs(hs[valid], y[valid], grads)
        dhs = np.zeros_like(hs)
        dhs[valid] = slope
        before, gate, new = trace["before"], trace["gate"], trace["new"]
        z, r = gate[:, :, :k], gate[:, :, k:]
        to_new = (1 - z) * (1 - new * new)
        to_z = (before - new) * z * (1 - z)
        to_r = trace["pull"] * r * (1 - r)
        da = np.empty((*x.shape, 3 * k), np.float32)
        du = np.empty_like(da)
        back = np.zeros_like(h)
        rec_t = np.ascontiguousarray(self.p["rec"].T)
        for t in range(len(x) - 1, -1, -1):
            dh = dhs[t]
            dh += back
            a, u = da[t], du[t]
            np.multiply(dh, to_z[t], out=a[:, :k])
            np.multiply(dh, to_new[t], out=a[:, 2 * k :])
            np.multiply(a[:, 2 * k :], to_r[t], out=a[:, k : 2 * k])
            u[:, : 2 * k] = a[:, : 2 * k]
            np.multiply(a[:, 2 * k :], r[t], out=u[:, 2 * k :])
            back = u @ rec_t
            back += dh * z[t]
            back *= keep[t][:, None]
        grads["rec"] += before.reshape(-1, k).T @ du.reshape(-1, 3 * k)
        flat = x.ravel()
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        start = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
        grads["inp"][flat[start]] += np.add.reduceat(da.reshape(-1, 3 * k)[order], start)
        return -float(lp.sum()), hs[-1]

    def train(self, docs: list[np.ndarray]) -> int:
        """Truncated backpropagation with Adagrad over the documents; returns the tokens seen.

        Documents follow one another in ``lanes`` lanes of about equal length;
        the state is carried from window to window and starts anew with each
        document.
        """
        cfg = self.cfg
        order = np.random.default_rng(cfg.seed).permutation(len(docs))
        sizes = np.array([len(docs[i]) for i in order])
        total = int(sizes.sum())
        if not total:
            return 0
        # one stream, cut into lanes
        lanes = max(1, min(cfg.lanes, total // (100 * cfg.window)))  # a hundred steps at least
        steps = -(-total // lanes)
        y = np.full(lanes * steps, -1, np.int64)
        y[:total] = np.concatenate([docs[i] for i in order])
        first = np.zeros(lanes * steps, bool)
        first[np.cumsum(sizes) - sizes] = True
        x = np.concatenate([[END], y[:-1]])
        x[first | (x < 0)] = END
        x, y, keep = (np.ascontiguousarray(v.reshape(lanes, steps).T) for v in (x, y, (~first).astype(np.float32)))
        h = np.zeros((lanes, cfg.hidden), np.float32)
        acc = {n: np.full(v.shape, 1e-4, np.float32) for n, v in self.p.items()}
        grads = {n: np.zeros_like(v) for n, v in self.p.items()}
        for at in range(0, steps, cfg.window):
            xs, ys = x[at : at + cfg.window], y[at : at + cfg.window]
            _, h = self.slopes(xs, ys, keep[at : at + cfg.window], h, grads)
            count = int((ys >= 0).sum())
            if not count:
                continue
            # words and classes that did not occur have no slope
            cls = np.unique(ys[(ys >= 0) & (ys < self.size)] // self.width)
            met = {"inp": np.unique(xs), "out_w": cls, "out_b": cls}
            for name, v in self.p.items():
                rows = met.get(name, slice(None))
                grad = grads[name][rows] / count
                grads[name][rows] = 0
                sums = acc[name][rows] + grad * grad
                acc[name][rows] = sums
                v[rows] -= cfg.rate * grad / np.sqrt(sums)
        return total

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        """Natural log probability of each whole document."""
        order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
        sizes = np.array([len(docs[i]) for i in order])
        out = np.zeros(len(docs))
        if not len(docs):
            return out
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        flat = np.concatenate([docs[i] for i in order])
        h, live = np.zeros((len(docs), self.cfg.hidden), np.float32), len(docs)
        before = np.full(len(docs), END, np.int64)
        at = 0
        while live:
            steps = min(max(self.cfg.window, 6000 // live), int(sizes[0]) - at)
            when = at + np.arange(steps)[:, None]
            valid = when < sizes[:live]
            y = flat[np.where(valid, starts[:live] + when, starts[:live])]
            x = np.concatenate([before[None, :live], y[:-1]])
            hs = self.states(x, h[:live])
            lp = np.zeros(valid.shape)
            lp[valid] = self.log_probs(hs[valid], y[valid])[0]
            out[:live] += lp.sum(0)
            h, before, at = hs[-1], y[-1], at + steps
            live = int(np.searchsorted(-sizes, -at, "left"))
        back = np.empty(len(docs))
        back[order] = out
        return back


class Words:
    """The most frequent words with their counts; position 0 is the end mark."""

    def __init__(self, cfg: Config, head: list[tuple[bytes, int]], ends: int):
        self.cfg = cfg
        self.at = {w: i + 1 for i, (w, _) in enumerate(head)}
        self.counts = np.array([ends, *(c for _, c in head)], np.int64)
        self.size = min(max(cfg.vocabulary, int((self.counts[1:] >= cfg.often).sum()) + 1), len(self.counts))

    def tokens(self, words: list[bytes]) -> np.ndarray:
        """Positions of the words and of the end; -1 for words that are not here."""
        return np.fromiter(map(self.at.get, words, repeat(-1)), np.int64, len(words))

    def network(self, positions: np.ndarray) -> np.ndarray:
        """The network's tokens: its vocabulary, or the tail."""
        return np.append(np.where((positions < 0) | (positions >= self.size), self.size, positions), END)


def _trainer(cfg: Config, words: Words, tail: float, blob: bytes):
    def train(batches):
        docs = []
        for batch in batches:
            for text in batch.column(0):
                docs.append(words.network(words.tokens(words_of(text.as_py()))))
        if docs:
            gru = GRU(cfg, words.counts[: words.size], tail)
            gru.unpack(blob)
            seen = gru.train(docs)
            yield pa.RecordBatch.from_arrays([pa.array([gru.pack()], pa.binary()), pa.array([seen], pa.int64())], ["w", "n"])

    return train


def _average(batches):
    total, n = None, 0
    for batch in batches:
        for w, k in zip(batch.column(0), batch.column(1)):
            v = np.frombuffer(w.as_py(), np.float32).astype(np.float64) * k.as_py()
            total, n = (v if total is None else total + v), n + k.as_py()
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([(total / n).astype(np.float32).tobytes()], pa.binary()), pa.array([n], pa.int64())], ["w", "n"])


def fit(learn: DataFrame, tokens: int, cfg: Config, words: Words, tail: float) -> GRU:
    """Local training and averaging in rounds; ``learn`` has a binary text and ``part`` (the round), with about so many tokens."""
    gru = GRU(cfg, words.counts[: words.size], tail)
    for r in range(cfg.rounds):
        parts = max(1, -(-tokens // (cfg.rounds * cfg.tokens_per_part)))
        docs = learn.filter(F.col("part") == r).select("text").repartition(parts)
        found = docs.mapInArrow(_trainer(cfg, words, tail, gru.pack()), "w binary, n long")
        if parts > 32:  # up to 16 models are averaged where they were trained, without moving
            parts = max(32, -(-parts // 16))
            found = found.coalesce(parts).mapInArrow(_average, "w binary, n long")
        while parts > 4:  # averages of averages, so that the driver gets 4 models at most
            parts = -(-parts // 16)
            found = found.repartition(parts).mapInArrow(_average, "w binary, n long")
        total, seen = None, 0
        for w, n in found.toLocalIterator():  # one model at a time
            v = np.frombuffer(bytes(w), np.float32).astype(np.float64) * n
            total, seen = (v if total is None else total + v), seen + n
        if seen:
            gru.unpack((total / seen).astype(np.float32).tobytes())
    return gru


def frequent(counts: DataFrame, most: int, longest: int = 100) -> list[tuple[bytes, int]]:
    """The words down to the least count for which they are at most ``most``, by falling count; none is longer than ``longest`` bytes.

    Counts fall into eight classes for each power of two; whole classes are taken, so that the driver gets one bounded list.
    """
    level = F.floor(F.log2("c") * 8)
    known = counts.filter(F.octet_length("word") <= longest)
    upto, least = 0, None
    for k, n in known.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("level")).collect():  # 512 at most
        if upto + n > most:
            break
        upto, least = upto + n, k
    if least is None:
        return []
    return sorted(((bytes(w), c) for w, c in known.filter(level >= least).select("word", "c").collect()), key=lambda x: (-x[1], x[0]))


def _scorer(cfg: Config, words: Words, tail: float, blob: bytes, tail_total: float):
    log_c = np.log10(words.counts + 1.0)

    def score(batches):
        gru = GRU(cfg, words.counts[: words.size], tail)
        gru.unpack(blob)
        for batch in batches:
            for first in range(0, batch.num_rows, 4000):
                part = batch.slice(first, 4000)
                docs, n, known, base, inner, rare, times = [], [], [], [], [], [], []
                for text in part.column(part.num_columns - 1):
                    own = words_of(text.as_py())
                    pos = words.tokens(own)
                    docs.append(words.network(pos))
                    here = pos[pos >= 0]
                    far = here[here >= words.size]
                    n.append(len(own) + 1)
                    known.append(int((words.counts[here] > 0).sum()) + int(words.counts[END] > 0))
                    base.append(float(log_c[here].sum() + log_c[END]))
                    inner.append(float(log_c[far].sum()) - np.log10(tail_total) * (len(far) + len(own) - len(here)))
                    lost = Counter(own[i] for i in np.flatnonzero(pos < 0))
                    rare.append(list(lost.keys()))
                    times.append(list(lost.values()))
                scores = gru.score(docs) / LN10 + np.array(inner)
                arrays = [*part.columns[:-1], pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(scores, pa.float64()), pa.array(rare, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, [*part.schema.names[:-1], "n_tokens", "known", "base", "model", "rare", "times"])

    return score


def score_documents(docs: DataFrame, held, cfg: Config = Config(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every row's whole text; learn from the rows where the column ``held`` is false.

    Returns one row per input row: ``id_col``, ``held_out``, ``n_tokens`` (words
    and one end), ``n_known``, ``train_tokens``, ``base_score`` (add-one unigram,
    log10) and ``score`` (the model's log10 probability of the text, the end
    included). Null and empty texts are one end token. Ids may repeat or be
    null. Without training rows nothing is known and the base is log10(1) a token.
    """
    rows = docs.select(F.col(id_col).alias("__id"), held.alias("held_out"), F.col(text_col).cast("string").cast("binary").alias("text"))
    learn = rows.filter(~F.col("held_out"))
    counts = materialize(word_counts(learn.select("text")), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    ends = learn.count()
    n, v = total + ends, distinct + (1 if ends else 0)
    words = Words(cfg, frequent(counts, cfg.resolved), ends)
    tail = float(n - words.counts[: words.size].sum())
    tail_total = tail + max(0, v - words.size) + 1.0
    part = F.pmod(F.xxhash64("__id", "text", F.lit(cfg.seed)), F.lit(cfg.rounds))
    gru = fit(learn.select("text", part.alias("part")), n, cfg, words, tail)
    keyed = rows.select(F.monotonically_increasing_id().alias("rid"), "__id", "held_out", "text")
    kind = rows.schema["__id"].dataType.simpleString()
    schema = f"rid long, `__id` {kind}, held_out boolean, n_tokens long, known long, base double, model double, rare array<binary>, times array<long>"
    scored = materialize(keyed.mapInArrow(_scorer(cfg, words, tail, gru.pack(), tail_total), schema), "scored")
    rare = scored.select("rid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("rid", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    rare = rare.join(counts, "word").groupBy("rid").agg(F.sum("times").alias("rare_known"), F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("rare_log"))
    out = scored.drop("rare", "times").join(rare, "rid", "left")
    log = F.coalesce("rare_log", F.lit(0.0))
    return out.select(
        F.col("__id").alias(id_col), "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + log - F.col("n_tokens") * float(np.log10(n + v + 1.0))).alias("base_score"), (F.col("model") + log).alias("score"),
    )


def op9_gru(spark, sf_dir: str) -> DataFrame:
    """Log-likelihoods of all documents."""
    docs = load(spark, sf_dir, "documents")
    return score_documents(docs, held_out(F.col("doc_id"), 7))
