"""Language identification by hierarchical discrimination.

A text becomes a normalised vector of hashed byte trigrams of its lower-cased
letters. A linear model first separates the language families; within the
family predicted, one-versus-one linear support vector machines vote. All are
fitted by dual coordinate descent in numpy on a bounded sample of labelled rows
(``per_language`` rows for each language, spread evenly over the input).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, load, ship

ship(__name__)

#: Closely related languages; a language that is in no family is one of its own.
FAMILIES = {"en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ru": "slavic", "pl": "slavic", "cs": "slavic", "uk": "slavic"}
DIMENSIONS = 4096
#: Long texts are counted in pieces of so many bytes.
PIECE = 1 << 20
UNKNOWN = "und"


def features(text: str) -> np.ndarray | None:
    """Unit-length root counts of hashed byte trigrams of the whole text; None without a letter."""
    raw = text.lower().encode("utf-8", "replace")
    counts, latin, other = np.zeros(DIMENSIONS, np.int64), False, False
    tail, before = np.array([32], np.uint32), True
    for at in range(0, len(raw), PIECE):
        c = np.frombuffer(raw, np.uint8, min(PIECE, len(raw) - at), at)
        low, high = (c >= 97) & (c <= 122), c >= 128
        latin, other = latin or bool(low.any()), other or bool(high.any())
        letter = low | high
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # one blank for each run of other characters
        keep[0] |= before
        before = letter[-1]
        c = np.concatenate([tail, np.where(letter, c, 32)[keep], np.full(int(at + PIECE >= len(raw)), 32, np.uint8)]).astype(np.uint32)
        h = (c[:-2] * np.uint32(961) + c[1:-1]) * np.uint32(961) + c[2:]
        h = (h * np.uint32(2654435761)) >> np.uint32(20)
        counts += np.bincount(h, minlength=DIMENSIONS)[:DIMENSIONS]
        tail = c[-2:]
    if not latin and not (other and regex.search(r"\p{L}", text)):
        return None
    roots = np.sqrt(counts.astype(np.float32))
    return roots / np.linalg.norm(roots)


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 4.0, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Linear SVM with hinge loss by dual coordinate descent; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    norm = (x * x).sum(1)
    share = np.where(y > 0, (y > 0).mean(), (y < 0).mean())
    bound = c * 0.5 / share  # balanced classes
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in rng.permutation(len(x)):
            g = y[i] * (w @ x[i]) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), bound[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


@dataclass
class Model:
    """Families with their one-versus-rest weights, and pairs of languages within each."""

    families: dict[str, list[str]]
    family_weights: dict[str, np.ndarray] = field(default_factory=dict)
    pair_weights: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    @classmethod
    def fit(cls, x: np.ndarray, langs: list[str], families: dict[str, str] | None = None) -> Model:
        of = FAMILIES if families is None else families
        langs = np.array(langs, object)
        found: dict[str, list[str]] = {}
        for lang in sorted(set(langs)):
            found.setdefault(of.get(lang, lang), []).append(lang)
        model = cls(found)
        own = np.array([of.get(a, a) for a in langs], object)
        if len(found) > 1:
            for f in found:
                model.family_weights[f] = fit_svm(x, np.where(own == f, 1.0, -1.0))
        for members in found.values():
            for i, a in enumerate(members):
                for b in members[i + 1 :]:
                    of_pair = (langs == a) | (langs == b)
                    model.pair_weights[a, b] = fit_svm(x[of_pair], np.where(langs[of_pair] == a, 1.0, -1.0))
        return model

    def predict(self, v: np.ndarray) -> tuple[str, float]:
        """Language and a score in [0, 1]: the family's certainty times that of the winner within it."""
        if not self.families:
            return UNKNOWN, 0.0
        sure = 1.0
        if self.family_weights:
            margins = {f: float(w[:-1] @ v + w[-1]) for f, w in self.family_weights.items()}
            family = max(sorted(margins), key=margins.get)
            others = max(m for f, m in margins.items() if f != family)
            sure = 1 / (1 + np.exp(-2 * (margins[family] - others)))
        else:
            family = next(iter(self.families))
        members = self.families[family]
        votes = {m: 0 for m in members}
        mass = {m: 0.0 for m in members}
        for (a, b), w in self.pair_weights.items():
            if a in votes:
                m = float(w[:-1] @ v + w[-1])
                votes[a if m >= 0 else b] += 1
                p = 1 / (1 + np.exp(-4 * m))
                mass[a] += p
                mass[b] += 1 - p
        best = max(members, key=lambda m: (votes[m], mass[m]))
        return best, float(sure * (mass[best] / (len(members) - 1) if len(members) > 1 else 1.0))


def _vectors(batches):
    for batch in batches:
        langs, out = batch.column(0).to_pylist(), []
        for text in batch.column(1):
            v = features(text.as_py() or "")
            out.append(None if v is None else v.astype(np.float16).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(out, pa.binary())], ["lang", "v"])


def train(labelled: DataFrame, per_language: int = 500, families: dict[str, str] | None = None) -> Model:
    """Fit on about ``per_language`` rows of each language (the documented bound), chosen by a hash of key and text; rows that repeat both count once.

    ``labelled`` has ``key`` (any column, for the choice only), ``text``, ``lang``; rows with a null in text or lang are left out.
    """
    rows = labelled.filter("text is not null and lang is not null")
    counts = {r[0]: r[1] for r in rows.groupBy("lang").agg(F.count(F.lit(1))).collect()}
    if not counts:
        return Model({})
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, per_language / n))).otherwise(share)
    u = F.pmod(F.xxhash64(F.col("key"), F.col("text"), F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.filter(u < share).select("key", "lang", "text").distinct().select("lang", "text").mapInArrow(lean(_vectors), "lang string, v binary").filter("v is not null").collect()
    sample = sorted((r[0], bytes(r[1])) for r in sample)
    if not sample:
        return Model({})
    x = np.stack([np.frombuffer(v, np.float16).astype(np.float32) for _, v in sample])
    return Model.fit(x, [a for a, _ in sample], families)


def _predictor(model: Model, at: int, keep: int):
    """Predictions for the texts in column ``at``; the first ``keep`` columns are handed on."""

    def predict(batches):
        for batch in batches:
            langs, scores = [], []
            for text in batch.column(at):
                v = features(text.as_py() or "")
                lang, score = (UNKNOWN, 0.0) if v is None else model.predict(v)
                langs.append(lang)
                scores.append(min(1.0, max(0.0, score)))
            names = [*batch.schema.names[:keep], "lang_pred", "score"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names)

    return predict


def identify(rows: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``keep``, ``lang_pred`` and ``score`` of every row, from its whole text alone.

    A text that is null, empty or has no letter is ``und`` with score 0, and so
    is everything where the model saw no labelled row.
    """
    if text_col in keep and rows.schema[text_col].dataType.simpleString() == "string":
        rows, at = rows.select(*keep), keep.index(text_col)  # the text crosses to Python once
    else:
        rows, at = rows.select(*keep, F.col(text_col).cast("string").alias("__text")), len(keep)
    schema = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in keep) + "lang_pred string, score double"
    return rows.mapInArrow(lean(_predictor(model, at, len(keep))), schema)


def held_out(doc_id, parts: int = 4):
    """Whether crc32 of the id's text leaves 2; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)) == 2, F.lit(False))


def fit_documents(docs: DataFrame) -> Model:
    """A model from the documents that are not held out."""
    return train(docs.filter(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("key"), "text", "lang"))


def op5_language_families(spark, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = load(spark, sf_dir, "documents")
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return identify(out, fit_documents(docs), keep=("doc_id", "held_out"))
