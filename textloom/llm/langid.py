"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased; every run of other characters than letters counts as one space, and the text's end as marks of its own.
Its grams of 1 to 3 characters, which start at its characters and at the first mark and never reach into another text, fall into
2^`bits` hash buckets.

Training counts grams per language and bucket over all training rows: each task counts its rows densely, gives the
counts that are not zero, and Spark sums them (a hot language or bucket combines before the shuffle). The sums, at most
languages x 2^bits numbers, become the log-probability matrix, which is broadcast: its size is bounded by `most_langs`.
Scoring is by batch: all texts of a batch are one array of bucket numbers, each picks its row of the matrix, and the rows
of a text are summed.

Defined cases: a text that is null or has no letter is `und` with score 0; without any training row every text is `und`;
ties go to the language that sorts first; the score is the posterior probability of the language, whose prior is its share of
the training rows;
rows with a null language are not trained on; repeated rows count as often as they occur; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, sliced

UNKNOWN = "und"
_letters: np.ndarray | None = None


def _is_letter(codes: np.ndarray) -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters[codes]


def grams(texts: list[str | None], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all grams (one row per gram size), the first place of each text among them, and whether it has a letter."""
    joined = "\0\0\0".join([t.replace("\0", " ").lower() if t else "" for t in texts]) + "\0\0\0"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    marks = codes == 0
    letter = _is_letter(codes)
    c = np.where(letter, codes, np.where(marks, 0, 1)).astype(np.uint64)
    keep = ~((c == 1) & (np.concatenate(([0], c[:-1])) == 1))
    # three marks end a text; grams start at its characters and at the first of them
    thirds = np.flatnonzero(marks)[2::3]
    has = np.add.reduceat(letter, np.concatenate(([0], thirds[:-1] + 1))) > 0
    c = np.concatenate((c[keep], np.zeros(2, np.uint64)))
    n, shift = len(c) - 2, np.uint64(64 - bits)
    own, ends = c[:n] != 0, np.flatnonzero(c[:n] == 0)[2::3]
    own[ends - 2] = True
    at = np.cumsum(own)
    starts = np.concatenate(([0], at[ends][:-1])) if len(ends) else np.zeros(0, np.int64)
    one = c[:n] * np.uint64(0x9E3779B97F4A7C15)
    two = (one ^ c[1 : n + 1]) * np.uint64(0xC2B2AE3D27D4EB4F)
    three = (two ^ c[2 : n + 2]) * np.uint64(0x165667B19E3779F9)
    return np.stack([(h[own] >> shift).astype(np.int32) for h in (one, two, three)]), starts, has


def count_grams(rows: DataFrame, bits: int) -> DataFrame:
    """lang, bucket, n over rows of (text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for whole in batches:
            for b in sliced(whole, 0, 4 << 20):
                by: dict[str, list[str]] = {}
                for t, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    by.setdefault(lang, []).append(t)
                for lang, texts in by.items():
                    total = counts.setdefault(lang, np.zeros(1 << bits, dtype=np.int64))
                    for row in grams(texts, bits)[0]:
                        total += np.bincount(row, minlength=1 << bits)
        for lang, total in counts.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], ["lang", "bucket", "n"])

    return rows.mapInArrow(run, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    def __init__(self, langs: list[str], weights: np.ndarray, bits: int, priors: np.ndarray | None = None):
        self.langs, self.weights, self.bits, self.priors = langs, weights, bits, np.zeros(len(langs)) if priors is None else priors

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        buckets, starts, has = grams(texts, self.bits)
        scores = np.tile(self.priors, (len(texts), 1))
        for row in buckets:
            for k, column in enumerate(self.weights):
                scores[:, k] += np.add.reduceat(column[row], starts, dtype=np.float64)
        best = scores.argmax(axis=1)
        top = scores[np.arange(len(texts)), best]
        sure = 1 / np.exp(scores - top[:, None]).sum(axis=1)
        return [self.langs[k] if h else UNKNOWN for k, h in zip(best, has)], np.where(has, sure, 0.0)


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", bits: int = 16, smoothing: float = 0.5, most_langs: int = 256) -> Model:
    """Learns from every row of `rows` whose text and language are not null."""
    prepare(rows.sparkSession)
    learn = rows.select(F.col(text).alias("t"), F.col(lang).alias("l")).filter("t is not null and l is not null")
    rows_of = {r.l: r.n for r in learn.groupBy("l").agg(F.count("*").alias("n")).limit(most_langs + 1).collect()}
    if len(rows_of) > most_langs:
        raise ValueError(f"more than {most_langs} languages; the matrix would not be bounded")
    names = sorted(rows_of)
    if not names:
        return Model([], np.zeros((0, 1 << bits), np.float32), bits)
    found = count_grams(learn, bits).toPandas()
    counts = np.zeros((len(names), 1 << bits))
    counts[found["lang"].map({x: i for i, x in enumerate(names)}).to_numpy(), found["bucket"].to_numpy()] = found["n"].to_numpy()
    counts += smoothing
    shares = np.array([rows_of[x] for x in names], float)
    return Model(names, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32), bits, np.log(shares / shares.sum()))


def predict(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns, lang_pred, score."""
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.select(*keep, F.col(text).alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.select(*keep).schema)
    kept = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in sliced(whole, kept, 4 << 20):
                langs, scores = sent.value.predict(b.column(kept).to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns[:kept], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*b.schema.names[:kept], "lang_pred", "score"])

    return base.mapInArrow(run, f"{fields}, lang_pred string, score double")


def held_out(of: int, remainder: int, doc_id: str = "doc_id"):
    """Whether crc32 of the id as text leaves that remainder; a null id does not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % of == remainder, F.lit(False))


def digest(docs: DataFrame) -> DataFrame:
    """The columns that the query returns."""
    model = fit(docs.filter(~held_out(5, 0)))
    flagged = docs.withColumn("held_out", held_out(5, 0))
    return predict(flagged, model, keep=("doc_id", "held_out"))
