"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the n-gram buckets of each language in every task and adds the counts up;
the model is a languages x buckets matrix of log probabilities, whose size does not follow
the number of documents. Scoring broadcasts it and adds up whole slices of texts at once.

Texts are code points, lower-cased by Unicode; tab to carriage return count as spaces. An
n-gram is a run of 1 to 4 code points inside one text. Long texts are worked on in blocks, so
memory does not follow the length of a text.

Defined results: null text, or text without a letter, is `und` with score 0. Without any
labelled text every text is `und`. Of equal scores the smaller language name wins. Null
ids count as not held out. Only doc_id, text and (for training) lang are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import LETTER, Slice, mix, slices

BUCKETS = 1 << 15
ORDERS = (1, 2, 3, 4)
SMOOTHING = 0.5
UNKNOWN = "und"

# Code points that are worked on at once.
_BLOCK = 1 << 20
_PRIME = np.uint64(0x100000001B3)

def _code_points(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """(lower-cased code points of all texts, where each begins and the last ends)."""
    texts = [str(part.text(i), "utf-8", "replace").lower().encode("utf-32-le", "surrogatepass") for i in range(len(part))]
    codes = np.frombuffer(b"".join(texts), "<u4")
    codes = np.where((codes >= 9) & (codes <= 13), np.uint32(32), codes)
    return codes, np.concatenate([[0], np.cumsum([len(t) // 4 for t in texts])]).astype(np.int64)


def _features(part: Slice, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, text) of every n-gram, block by block and order by order."""
    codes, bounds = _code_points(part)
    shift = np.uint64(64 - buckets.bit_length() + 1)
    for low in range(0, len(codes), _BLOCK):
        high = min(low + _BLOCK, len(codes))
        owner = np.repeat(np.arange(len(part)), np.diff(np.clip(bounds, low, high)))
        left = bounds[owner + 1] - np.arange(low, high)  # code points to the end of the text
        gram = np.zeros(high - low, np.uint64)
        for n in range(1, max(ORDERS) + 1):
            ahead = np.zeros(high - low, np.uint64)
            own = codes[low + n - 1 : high + n - 1]
            ahead[: len(own)] = own
            gram = mix(gram * _PRIME + ahead + np.uint64(n))
            if n in ORDERS:
                ok = left >= n
                yield (gram[ok] >> shift).astype(np.intp), owner[ok]


@dataclass
class Model:
    languages: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray  # buckets x languages

    def predict(self, part: Slice) -> tuple[np.ndarray, np.ndarray]:
        """(best language, its posterior) of each text."""
        total = np.zeros((len(part), len(self.languages)))
        for bucket, owner in _features(part, len(self.log_prob)):
            for k in range(len(self.languages)):
                total[:, k] += np.bincount(owner, weights=self.log_prob[:, k][bucket], minlength=len(part))
        total += self.log_prior
        best = total.argmax(axis=1)
        share = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        return best, share


def train(docs: DataFrame, labelled: Column, buckets: int = BUCKETS) -> Model:
    """Fit on all rows where `labelled` holds and text and lang are not null."""
    wanted = docs.where(labelled & F.col("text").isNotNull() & F.col("lang").isNotNull())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        texts: dict[str, int] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for part in slices(batch.column(0)):
                own = langs[part.low : part.low + len(part)]
                names, code = np.unique(own.astype(str), return_inverse=True)
                total = np.zeros(len(names) * buckets, np.int64)
                for bucket, owner in _features(part, buckets):
                    total += np.bincount(code[owner] * buckets + bucket, minlength=len(total))
                for i, name in enumerate(names.tolist()):
                    seen[name] = seen.get(name, 0) + total[i * buckets : (i + 1) * buckets]
                    texts[name] = texts.get(name, 0) + int((code == i).sum())
        for name, total in seen.items():
            at = np.flatnonzero(total)
            yield pa.record_batch(
                [pa.array([name] * (len(at) + 1)), pa.array([-1, *at.tolist()], pa.int32()), pa.array([texts[name], *total[at].tolist()], pa.int64())],
                ["lang", "bucket", "n"],
            )

    # At most languages x buckets rows come back, whatever the size of the corpus.
    counts = (
        wanted.select(F.col("text").cast("string"), F.col("lang").cast("string"))
        .mapInArrow(count, "lang string, bucket int, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    languages = sorted(counts["lang"].unique().tolist())
    index = {name: i for i, name in enumerate(languages)}
    table = np.full((buckets, len(languages)), SMOOTHING)
    texts = np.ones(len(languages))
    column = counts["lang"].map(index).to_numpy(np.int64)
    bucket, n = counts["bucket"].to_numpy(np.int64), counts["n"].to_numpy(np.float64)
    inner = bucket >= 0
    table[bucket[inner], column[inner]] += n[inner]
    texts[column[~inner]] = n[~inner]
    with np.errstate(divide="ignore"):
        return Model(languages, np.log(texts / max(1.0, texts.sum())), np.log(table / table.sum(axis=0)))


def _has_letter(part: Slice) -> np.ndarray:
    found = part.per_text(LETTER[part.data]) > 0
    for i in np.flatnonzero(~found & (np.diff(part.offsets) > 0)):
        found[i] = any(map(str.isalpha, str(part.text(i), "utf-8", "replace")))
    return found


PREDICTIONS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
)


def predict(docs: DataFrame, model: Model, held_out: Column) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            names, scores = [], []
            for part in slices(batch.column(2)):
                if not fitted.languages:
                    names += [UNKNOWN] * len(part)
                    scores += [0.0] * len(part)
                    continue
                best, share = fitted.predict(part)
                known = _has_letter(part)
                names += [fitted.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)]
                scores += np.where(known, share, 0.0).tolist()
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], PREDICTIONS.fieldNames())

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text")
    ).mapInArrow(run, PREDICTIONS)


def id_fold(of: int) -> Column:
    """crc32 of the id as text, modulo `of`."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % of
