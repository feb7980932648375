"""A quality classifier: Bradley-Terry pairwise ranking of documents by features of their whole text.

A document's strength is linear in its features. Of a good and a bad document, the probability that the good one is preferred is the
logistic function of the difference of strengths, so the weights are those of a logistic regression, without intercept, on feature
differences. All labelled rows are learned from: they are dealt by hash to blocks of some hundreds of each label, and all pairs within a block
count. The threshold is the level of strength that parts all labelled rows best (by Youden's index). Scores are the strengths, put through a
logistic curve that gives `cut` at the threshold.

Features are of two kinds: FEATURES, which count bytes, lines and words, and the shares of WORDS hash buckets in a text's words (A-Z in
lower case), which say what it is about. The former also enter by their square and root, as a text can be too long or too short. They are
computed on the executors, in numpy over the bytes of a batch. Those of labelled rows are written as blocks; each step of Newton's method is a
Spark job over them, whose sums are added on the executors and only then reach the driver. Work grows with the number of labelled rows.

Defined cases: a null text is an empty one and is scored like any other; where one of the two labels is missing, every
score is `cut`; several labels of one document that differ count for both; null labels and ids are not trained on;
repeated documents are each scored; extra columns are kept by `filter_quality` and ignored otherwise.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_list, drop, prepare, release, sliced, written
from .langid import held_out

#: Classes of bytes: 0 other symbol, 1 capital, 2 small letter, 3 digit, 4 space, 5 line break, 6 sentence punctuation, 7 beyond ASCII, 8 quotes and brackets.
_CLASS = np.array([5 if c in (10, 13) else 4 if c in (9, 11, 12, 32) else 1 if 65 <= c <= 90 else 2 if 97 <= c <= 122 else 3 if 48 <= c <= 57 else 7 if c >= 128 else 6 if c in b".,;:?" else 8 if c in b"'\"()-" else 0 for c in range(256)], dtype=np.uint8)
FEATURES = (
    "log bytes", "log words", "capitals", "digits", "spaces", "line breaks", "sentence punctuation", "symbols", "beyond ASCII", "quotes", "word length",
    "distinct words", "distinct lines", "lines a word", "same byte again", "symbols in a row", "words of capitals", "most frequent word", "exclamation marks", "words without a letter", "links", "full stops a word",
)
#: Buckets of words, and pairs whose differences are held at once.
WORDS, CHUNK = 128, 2048
#: Documents of each label that a block has at least, if there are as many, and levels of strength that are tried as the threshold.
LEAST, LEVELS = 8, 1 << 14


def features(texts: list[bytes]) -> np.ndarray:
    """A row of FEATURES and of WORDS shares for each text."""
    sizes = np.array([len(t) for t in texts])
    out = np.zeros((len(texts), len(FEATURES) + WORDS))
    flat = np.frombuffer(b"".join(t + b"\n" for t in texts), dtype=np.uint8)
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    kind = _CLASS[flat]
    total = lambda mask: np.add.reduceat(mask, starts, dtype=np.int64)
    size = np.maximum(sizes, 1)
    for k, c in ((2, 1), (3, 3), (4, 4), (5, 5), (6, 6), (7, 0), (8, 7), (9, 8)):
        out[:, k] = (total(kind == c) - (c == 5)) / size
    same = np.concatenate(([False], flat[1:] == flat[:-1]))
    same[starts] = False
    out[:, 14] = total(same & (kind != 4)) / size
    out[:, 15] = total(np.concatenate(([False], (kind[1:] == 0) & (kind[:-1] == 0)))) / size
    upper_run = np.concatenate(([False], (kind[1:] == 1) & (kind[:-1] == 1)))
    out[:, 16] = total(upper_run) / size
    out[:, 18] = total(flat == 33) / size
    for i, t in enumerate(texts):
        words, lines = t.split(), t.split(b"\n")
        n = max(len(words), 1)
        counts = Counter(words)
        out[i, 0], out[i, 1] = np.log1p(len(t)), np.log1p(len(words))
        out[i, 10] = len(t) / n
        out[i, 11] = len(counts) / n**0.8
        out[i, 12] = len(set(lines)) / len(lines)
        out[i, 13] = len(lines) / n
        out[i, 17] = max(counts.values(), default=0) / n
        out[i, 20] = (t.count(b"http") + t.count(b"@")) / n
        out[i, 21] = t.count(b".") / n
        buckets = np.bincount(np.fromiter((zlib.crc32(w) for w in map(bytes.lower, counts)), np.int64, len(counts)) % WORDS, np.fromiter(counts.values(), np.float64, len(counts)), WORDS)
        out[i, len(FEATURES) :] = np.sqrt(buckets / n)
    starts_word = np.concatenate(([True], (kind[:-1] == 4) | (kind[:-1] == 5))) & (kind != 4) & (kind != 5)
    out[:, 19] = total(starts_word & ((kind == 0) | (kind == 6) | (kind == 8))) / np.maximum(np.expm1(out[:, 1]), 1)
    return out


class Model:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, threshold: float, spread: float, cut: float):
        self.mean, self.scale, self.weights, self.threshold, self.spread, self.cut = mean, scale, weights, threshold, spread, cut

    def shaped(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        plain = z[:, : len(FEATURES)]
        return np.hstack([z, np.minimum(plain * plain, 16), np.sqrt(np.abs(plain))])

    def score(self, x: np.ndarray) -> np.ndarray:
        strength = self.shaped(x) @ self.weights
        return 1 / (1 + np.exp(-np.clip((strength - self.threshold) / self.spread + np.log(self.cut / (1 - self.cut)), -700, 700)))


def draw(good: np.ndarray, pairs: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the preferred and of the other document of each pair."""
    rng = np.random.default_rng(seed)
    return rng.choice(np.flatnonzero(good), pairs), rng.choice(np.flatnonzero(~good), pairs)


def fit_pairs(x: np.ndarray, good: np.ndarray, cut: float, pairs: int = 40_000, seed: int = 7, ridge: float = 1e-3, steps: int = 25) -> Model:
    """The same likelihood for a small matrix, on `pairs` drawn pairs; `good` is the label of each row of `x`. The operator uses `fit`."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    model = Model(mean, scale, np.zeros(x.shape[1] + 2 * min(x.shape[1], len(FEATURES))), 0.0, 1.0, cut)
    if good.all() or not good.any():
        return model
    z = model.shaped(x)
    up, down = draw(good, pairs, seed)
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        grad, hess = -ridge * w, ridge * np.eye(len(w))
        for start in range(0, pairs, CHUNK):
            diff = z[up[start : start + CHUNK]] - z[down[start : start + CHUNK]]
            p = 1 / (1 + np.exp(-np.clip(diff @ w, -30, 30)))
            grad += diff.T @ (1 - p) / pairs
            hess += (diff * (p * (1 - p))[:, None]).T @ diff / pairs
        step = np.linalg.solve(hess, grad)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    strength = z @ w
    order = np.sort(strength)
    levels = np.unique(np.quantile(order, np.linspace(0.001, 0.999, 999)))
    below = lambda s: np.searchsorted(np.sort(s), levels, side="left") / len(s)
    youden = below(strength[~good]) - below(strength[good])
    best = levels[int(np.median(np.flatnonzero(youden >= youden.max() - 1e-9)))]
    k = min(max(int(np.searchsorted(order, best, side="left")), 1), len(order) - 1)  # halfway between the rows on either side of the level
    model.weights, model.threshold, model.spread = w, float(order[k - 1] + order[k]) / 2, max(float(np.std(strength)) / 2, 1e-6)
    return model


def _scored(df: DataFrame, kept: int, at: int, model: Model | None) -> DataFrame:
    """The first `kept` columns and the score, or without a model the features, of the text in column `at`."""
    prepare(df.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[:kept])
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in sliced(whole, at, 4 << 20):
                x = features(bytes_list(b.column(at)))
                last = pa.array(list(x), pa.list_(pa.float64())) if sent.value is None else pa.array(sent.value.score(x), pa.float64())
                yield pa.RecordBatch.from_arrays([*b.columns[:kept], last], [*b.schema.names[:kept], "score" if sent.value else "features"])
        release()

    return df.mapInArrow(run, fields + (", score double" if model else ", features array<double>"))


def _blocks(docs: DataFrame, labels: DataFrame, text: str, doc_id: str, quality: str, rows: int, most: int) -> DataFrame:
    """good, bad, own: blocks of about `rows` labelled documents of each label, as the features of the good ones and of the bad ones. Every labelled document is in
    one block; those of a label that is too rare for all blocks are in several, of which the first counts as `own`."""
    marks = labels.select(F.col(doc_id).alias("_id"), (F.col(quality) == 1).alias("_good")).filter("_id is not null and _good is not null").distinct()
    marks, texts = written(marks, "marks"), docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    if marks.count() <= most:  # texts stay where they are; beyond that features travel, and not the texts
        found = _scored(texts.join(F.broadcast(marks), "_id").select("_id", "_good", "_text"), 2, 2, None)
    else:
        found = _scored(texts, 1, 1, None).join(marks, "_id").select("_id", "_good", "features")
    found = written(found, "features")
    counts = {r._good: r.n for r in found.groupBy("_good").agg(F.count("*").alias("n")).collect()}
    n = max(1, -(-max(counts.values(), default=0) // rows))
    copies = lambda good: min(n, -(-LEAST * n // max(counts.get(good, 0), 1)))  # noqa: E731  LEAST of each label in a block, if there are as many
    own = F.pmod(F.xxhash64("_id", F.col("features")), F.lit(n))
    spread = F.when(F.col("_good"), copies(True)).otherwise(copies(False)).cast("int")
    dealt = found.withColumn("_copy", F.explode(F.sequence(F.lit(0), spread - 1))).withColumn("_block", F.pmod(own + F.col("_copy") * F.ceil(F.lit(n) / spread), F.lit(n)))

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        x = table["features"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
        good, first = (table[c].to_numpy(zero_copy_only=False).astype(bool) for c in ("_good", "_copy_is_own"))
        release()
        return pa.table({"good": pa.array([x[good].tobytes()], pa.binary()), "bad": pa.array([x[~good].tobytes()], pa.binary()), "own": pa.array([np.concatenate((first[good], first[~good])).tobytes()], pa.binary())})

    sent = dealt.select("_block", "_good", "features", (F.col("_copy") == 0).alias("_copy_is_own"))
    made = written(sent.groupBy("_block").applyInArrow(run, "good binary, bad binary, own binary"), "blocks")
    drop(docs.sparkSession, found, marks)
    return made


def _total(blocks: DataFrame, figures: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...] | None:
    """Sums over all blocks of what `figures` gives for features of good and bad documents and which of these are a block's own; summed in each task first, then on
    the executors."""
    add = lambda a, b: b if a is None else a if b is None else tuple(x + y for x, y in zip(a, b))
    width = len(FEATURES) + WORDS

    def one(held, row):
        good, bad = (np.frombuffer(row[c], np.float64).reshape(-1, width) for c in ("good", "bad"))
        return add(held, figures(good, bad, np.frombuffer(row["own"], bool)))

    return blocks.rdd.treeAggregate(None, one, add)


def pair_sums(up: np.ndarray, down: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Over all pairs of a row of `up` and one of `down`: the log likelihood's gradient and minus its Hessian, by matrix products, and the number of pairs."""
    p = 1 / (1 + np.exp(-np.clip((up @ w)[:, None] - (down @ w)[None, :], -30, 30)))
    miss, var = 1 - p, p * (1 - p)
    cross = up.T @ (var @ down)
    hess = (up * var.sum(axis=1)[:, None]).T @ up + (down * var.sum(axis=0)[:, None]).T @ down - cross - cross.T
    return up.T @ miss.sum(axis=1) - down.T @ miss.sum(axis=0), hess, np.array(float(p.size))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", quality: str = "quality", cut: float = 0.7, rows: int = 512, ridge: float = 1e-3, steps: int = 25, most: int = 1_000_000) -> Model:
    """Learns from all labelled documents; up to `most` labels are broadcast to the texts. The driver holds sums over features, and counts of LEVELS levels of strength, only."""
    prepare(docs.sparkSession)
    width, blocks = len(FEATURES) + WORDS, _blocks(docs, labels, text, doc_id, quality, rows, most)
    own = lambda good, bad, first: np.vstack((good, bad))[first]
    got = _total(blocks, lambda g, b, o: (own(g, b, o).sum(axis=0), np.array([o[: len(g)].sum(), o[len(g) :].sum()], float)))
    model = Model(np.zeros(width), np.ones(width), np.zeros(width + 2 * len(FEATURES)), 0.0, 1.0, cut)
    if got is None:
        return model
    n_good, n_bad = got[1]
    mean = got[0] / (n_good + n_bad)
    (spread,) = _total(blocks, lambda g, b, o: (((own(g, b, o) - mean) ** 2).sum(axis=0),))
    model.mean, model.scale = mean, np.maximum(np.sqrt(spread / (n_good + n_bad)), 1e-6)
    if not n_good or not n_bad:
        return model
    w = model.weights
    for _ in range(steps):
        grad, hess, pairs = _total(blocks, lambda g, b, o, w=w: pair_sums(model.shaped(g), model.shaped(b), w))
        step = np.linalg.solve(hess / pairs + ridge * np.eye(len(w)), grad / pairs - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    # the level of strength that parts all labelled documents best, of LEVELS between the least and the largest
    strengths = lambda g, b, o: (model.shaped(g[o[: len(g)]]) @ w, model.shaped(b[o[len(g) :]]) @ w)
    extremes = blocks.rdd.map(lambda r: np.concatenate(strengths(*(np.frombuffer(r[c], np.float64).reshape(-1, width) for c in ("good", "bad")), np.frombuffer(r["own"], bool)))).filter(len)
    low, high = extremes.map(lambda s: (s.min(), s.max())).treeReduce(lambda a, b: (min(a[0], b[0]), max(a[1], b[1])))
    size = max(high - low, 1e-12) / LEVELS
    place = lambda s: np.clip(((s - low) / size).astype(np.int64), 0, LEVELS - 1)

    def counted(g, b, o):
        s, t = strengths(g, b, o)
        both = np.concatenate((s, t))
        return np.bincount(place(s), minlength=LEVELS), np.bincount(place(t), minlength=LEVELS), np.array([both.sum(), (both * both).sum()])

    good, bad, (total, squares) = _total(blocks, counted)
    youden = np.cumsum(bad)[:-1] / n_bad - np.cumsum(good)[:-1] / n_good
    model.threshold = float(low + size * (1 + np.median(np.flatnonzero(youden >= youden.max() - 1e-9))))
    n = n_good + n_bad
    model.weights, model.spread = w, max(float(np.sqrt(max(squares / n - (total / n) ** 2, 0.0))) / 2, 1e-6)
    drop(docs.sparkSession, blocks)
    return model


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns, score (0 to 1), predicted (1 from `cut` on)."""
    out = _scored(docs.select(*keep, F.col(text).alias("_text")), len(keep), len(keep), model)
    return out.withColumn("predicted", (F.col("score") >= model.cut).cast("int"))


def filter_quality(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents predicted as good, with their own columns."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    good = _scored(plain, len(docs.columns), docs.columns.index(text), model).filter(F.col("score") >= model.cut)
    return good.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns that the query returns."""
    model = fit(docs, labels.filter(~held_out(4, 2)))
    return score(docs.withColumn("held_out", held_out(4, 2)), model, keep=("doc_id", "held_out"))
