"""Language identification by a byte convolutional network over fixed-length windows.

The network is trained in numpy on the driver from a bounded sample of labelled rows
(``per_label`` documents of each language, ``pieces`` pieces of each); all windows of every
whole text are then scored where the rows lie, without a shuffle. The prediction is the
language of the largest mean probability, windows weighted by their bytes.

Null texts and texts without a letter are ``und`` with score 0, as is every text when no row
is labelled. Repeated rows are scored alike; the label column is only read for training.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm import cnn
from inkwell.llm.common import fold, fresh, id_text, sampled, slices, utf8

LENGTH = 128


@dataclass
class LanguageModel:
    labels: list[str]
    net: cnn.ByteCNN | None

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        n = len(texts)
        names, scores = ["und"] * n, np.zeros(n)
        offsets, data = utf8(texts)
        if self.net is None:
            return names, scores
        strings = texts.to_pylist()
        for a, b in slices(offsets):
            x, row, valid = cnn.cut(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], LENGTH)
            if not len(x):
                continue
            p = cnn.softmax(self.net.logits(x)) * valid[:, None]
            total = np.stack([np.bincount(row, p[:, k], b - a) for k in range(p.shape[1])], 1)
            size = np.bincount(row, valid, b - a)
            for i in np.flatnonzero(size):
                if any(map(str.isalpha, strings[a + i])):
                    k = int(total[i].argmax())
                    names[a + i], scores[a + i] = self.labels[k], min(1.0, total[i, k] / size[i])
        return names, scores


def train(docs: DataFrame, label: str = "lang", key: str = "doc_id", text: str = "text", per_label: int = 500, pieces: int = 4, piece_chars: int = 400) -> LanguageModel:
    """Fit on about ``per_label`` rows of each non-null label of ``docs``."""
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"), F.col(label).alias("y"))
    rows = sampled(rows.where("y is not null and length(t) > 0"), "k", per_label, "y")
    at = F.pmod(F.xxhash64("k", "i"), F.greatest(F.length("t") - piece_chars, F.lit(1))).cast("int") + 1
    got = (
        rows.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(pieces))))
        .select("y", "k", "i", F.substring(F.col("t"), at, F.lit(piece_chars)).alias("t"))
        .collect()
    )
    got.sort(key=lambda r: (r.y, r.k if r.k is not None else -1, r.i, r.t))
    labels = sorted({r.y for r in got})
    if not labels:
        return LanguageModel([], None)
    offsets, data = utf8(pa.array([r.t for r in got], pa.string()))
    x, row, valid = cnn.cut(data, offsets, LENGTH)
    y = np.array([labels.index(r.y) for r in got])[row]
    keep = valid >= 16
    if keep.any():
        x, y = x[keep], y[keep]
    share = np.bincount(y, minlength=len(labels))
    weights = (len(y) / (len(labels) * np.maximum(share, 1)))[y]
    return LanguageModel(labels, cnn.ByteCNN(len(labels), LENGTH).train(x, y, weights=weights))


def identify(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """key, carried columns, lang_pred, score for every row; the last two get underscores where carried columns have their names."""
    names = [key, *carry]
    whole, lang_name, score_name = (fresh(c, names) for c in ("text", "lang_pred", "score"))
    src = docs.select(*names, F.col(text).cast("string").alias(whole))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.select(*names).schema) + f", `{lang_name}` string, `{score_name}` double"

    def score(batches):
        for b in batches:
            lang, s = model.predict(b.column(whole))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(lang, pa.string()), pa.array(s, pa.float64())], [*names, lang_name, score_name])

    return src.mapInArrow(score, schema)


def evaluate_query(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: trained on rows outside the held-out fold."""
    fitted = docs.where(fold("doc_id", 4) != 2)
    out = identify(id_text(docs), train(fitted))
    return out.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
