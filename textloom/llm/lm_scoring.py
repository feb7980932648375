"""Language-model scoring with a probabilistic suffix tree of words, beside a smoothed unigram base.

Tokens are words between ASCII white space, after A-Z are lower-cased, then one end. The root of the tree is the base:
a token's share of the training tokens, smoothed so that all words that training lacks are one more token. A node is a
context, the last 1 to `depth` words before a token; its distribution is its next-token counts smoothed towards that of
its parent, the longest shorter suffix that is a node:

    p(w) = (N(context, w) + s * p_parent(w)) / (N(context) + s), s = N(context) ** `spread`,

as the number of different followers of a context grows with some such power of its count. A context is retained by a
divergence test: over the training tokens w that follow it, each left out of the counts in turn, the sum of
ln(p(w) / p_parent(w)) is `gain` nats or more. So chance followers count against a context, however few tokens it has. A text is
scored token by token, by the longest suffix of what precedes the token that is a node.

All counts are over all training texts and nothing of the tree is gathered on the driver or broadcast, so it grows with
the input. A block (a run of whole documents of a task) keeps its texts as numbers of its distinct words. It asks for
the counts of its distinct runs of words by sending them, as 64-bit hashes with its own counts, to hash buckets, which
add up and answer; a run, however frequent, is one entry a block. The test is a sum over tokens as well: blocks that know
the counts add up their tokens' shares for each context, in fixed point, and buckets sum these and answer which contexts
are nodes. Runs longer than two words are asked for only where the words before the last one occur `least` times in training. Depth d
takes d + 1 such exchanges.

Defined cases: a null text is empty and has the end as its one token; without training texts every token has probability
one; repeated rows count as often as they occur; a null id is never held out; an empty table gives no rows; extra columns
are ignored. Two runs of words whose 64-bit hashes agree would share a count.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_tables, column_bytes, drop, from_planes, in_blocks, planes, prepare, release, replayable, written
from .langid import held_out
from .ngram_join import mix, word_hashes

END = np.uint64(0xA0761D6478BD642F)
_M = np.uint64(0x9E3779B97F4A7C15)
UNIT = 1 << 12  # of a nat, in sums of the divergence test


_SMALL = 1 << 16


@lru_cache(4)
def _power(spread: float) -> np.ndarray:
    return np.arange(_SMALL + 1) ** spread


class Keys:
    """The distinct hashes of an array, ascending, and the place among them of each."""

    def __init__(self, hashes: np.ndarray):
        bits = np.uint64(max(1, len(hashes).bit_length()))
        low = (np.uint64(1) << bits) - np.uint64(1)
        order = (np.sort(hashes & ~low | np.arange(len(hashes), dtype=np.uint64)) & low).astype(np.int64)
        found = hashes[order]
        if (found[1:] < found[:-1]).any():  # two hashes that differ in the lowest bits only
            order = np.argsort(hashes, kind="stable")
            found = hashes[order]
        new = np.concatenate((np.ones(min(1, len(found)), bool), found[1:] != found[:-1]))
        self.distinct, self.at = found[new], np.empty(len(hashes), np.int32)
        self.at[order] = np.cumsum(new, dtype=np.int32) - 1

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, values, len(self.distinct))


class Block:
    """A block's tokens, and what the corpus has answered about them so far."""

    def __init__(self, often: np.ndarray, once: np.ndarray, at: np.ndarray, counts: np.ndarray, train: np.ndarray, options: dict):
        """Words as in _bodies(): hashes of those that occur more than once and of the others, and each word's place."""
        self.o, self.sizes = options, counts + 1
        self.ends = np.cumsum(self.sizes)
        word = np.ones(int(self.sizes.sum()), bool)
        word[self.ends - 1] = False
        hashes = np.concatenate((often, once, [END]))
        order = np.argsort(hashes)
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        place = at.astype(np.int32) - 1
        place[at == 0] = np.arange(len(often), len(often) + len(once), dtype=np.int32)
        self.words, self.word = hashes[order], np.full(len(word), rank[-1], np.int32)
        self.word[word] = rank[place]
        self.h = self.words[self.word]
        self.pos = np.arange(len(word), dtype=np.int32) - np.repeat((self.ends - self.sizes).astype(np.int32), self.sizes)
        self.train = np.repeat(train, self.sizes)

    def exchange(self, answers: list[dict[str, np.ndarray]], n: int, v: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """What to ask next, given the answers so far: hashes, ascending, with this block's counts or shares of the test.
        Once all is answered, self.p, self.known and self.state are set instead."""
        live = np.flatnonzero(self.pos)  # tokens behind contexts of k words that may be nodes
        run = self.h.copy()  # the hash of the context and the token
        run[live] = mix(self.h[live] * _M + self.h[live - 1] + np.uint64(1))
        runs = Keys(run[live])
        if not answers:
            return {"words": (self.words, np.bincount(self.word, self.train, len(self.words))), "pairs": (runs.distinct, runs.sums(self.train[live]))}
        self.known = answers[0]["words"][self.word]
        self.p = (self.known + 0.1) / (n + 0.1 * (v + 1))
        self.state, asked = np.zeros(len(self.h), np.int8), {}
        # contexts, the place among them of the one that ends at each token, and how often training has it
        contexts, place, before, at, follow = self.words, self.word, self.known, runs.at, answers[0]["pairs"][runs.at]
        for k in range(1, self.o["depth"] + 1):
            size = before[live - 1]
            often = size >= self.o["least"]
            live, at, follow, size = live[often], at[often], follow[often], size[often].astype(float)
            context, use = place[live - 1], self.train[live]
            s = _power(self.o["spread"])[np.minimum(size, _SMALL).astype(np.int32)]
            large = size > _SMALL
            s[large] = size[large] ** self.o["spread"]
            # a context that two tokens follow, each once, is no node: whoever sees this need not ask, and the sum of no shares
            # tells all others the same
            left = np.zeros(len(contexts), bool)
            left[context] = True
            left[context[use & (size == 2) & (follow == 1)]] = False
            if len(answers) == k:
                i = np.flatnonzero(use)
                p, many = self.p[live[i]], size[i] - 1 + s[i]
                share = np.log((follow[i] - 1 + s[i] * p) / (many * p))
                asked["test"] = contexts[left], np.rint(np.bincount(context[i], share, len(contexts))[left] * UNIT)
            else:
                passed = np.zeros(len(contexts), bool)
                passed[left] = answers[k]["test"] > 0
                i = np.flatnonzero(passed[context])
                self.p[live[i]] = (follow[i] + s[i] * self.p[live[i]]) / (size[i] + s[i])
                self.state[live[i]] = k
            if k == self.o["depth"]:
                break
            place, before = np.zeros(len(self.h), np.int32), np.zeros(len(self.h), np.int64)
            contexts, place[live], before[live] = runs.distinct, at, follow
            live = live[follow >= self.o["least"]] + 1
            live = live[live < len(self.h)]
            live = live[self.pos[live] > k]  # not those of the next text
            run[live] = mix(run[live] * _M + self.h[live - k - 1] + np.uint64(k + 1))
            runs = Keys(run[live])
            if len(answers) == k:
                asked["runs"] = runs.distinct, runs.sums(self.train[live])
                break
            at, follow = runs.at, answers[k]["runs"][runs.at]
        return asked


def _edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    return np.searchsorted(keys >> np.uint64(32), (np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(buckets))


def _questions(block: int, asked: dict[str, tuple[np.ndarray, np.ndarray]], buckets: int) -> pa.RecordBatch:
    edges = {name: _edges(keys, buckets) for name, (keys, _) in asked.items()}
    found = []
    for k in range(buckets):
        parts, sizes = [], {}
        for name, (keys, values) in asked.items():
            s = slice(edges[name][k], edges[name][k + 1])
            sizes[name] = int(s.stop - s.start)
            v = values[s].astype(np.int64)
            parts += [planes(np.diff(keys[s], prepend=np.uint64(0))), planes(((v << 1) ^ (v >> 63)).view(np.uint64))] if sizes[name] else []
        if any(sizes.values()):
            found.append((k, zstandard.compress(pickle.dumps((sizes, b"".join(parts))), 1)))
    return pa.RecordBatch.from_arrays([pa.array([block] * len(found), pa.int64()), pa.array([k for k, _ in found], pa.int32()), pa.array([z for _, z in found], pa.binary())], ["block", "bucket", "packed"])


def _answer(gain: float) -> Callable:
    """Sums a bucket's questions of all blocks; nodes for the test."""

    def run(table: pa.Table) -> pa.Table:
        asked = []
        for raw in map(zstandard.decompress, table.column("packed").to_pylist()):
            sizes, flat = pickle.loads(raw)
            at, found = 0, {}
            for name, n in sizes.items():
                zigzag = from_planes(flat[at + 8 * n : at + 16 * n], n)
                found[name] = np.cumsum(from_planes(flat[at : at + 8 * n], n), dtype=np.uint64), (zigzag >> np.uint64(1)).view(np.int64) ^ -(zigzag & np.uint64(1)).view(np.int64)
                at += 16 * n
            asked.append(found)
        out, total, kinds = [{} for _ in asked], 0, 0
        for name in sorted(set().union(*asked)):
            have = [i for i, found in enumerate(asked) if name in found]
            keys = Keys(np.concatenate([asked[i][name][0] for i in have]))
            sums = np.zeros(len(keys.distinct), np.int64)
            np.add.at(sums, keys.at, np.concatenate([asked[i][name][1] for i in have]))
            if name == "words":
                total, kinds = int(sums.sum()), int((sums > 0).sum())
            every, at = (sums >= gain * UNIT).astype(np.uint8) if name == "test" else sums.astype(np.uint64), 0
            for i in have:
                n = len(asked[i][name][0])
                got = every[keys.at[at : at + n]]
                out[i][name] = got.tobytes() if name == "test" else planes(got)
                at += n
        packed = [zstandard.compress(pickle.dumps(o), 1) for o in out]
        release()
        first = [1] + [0] * (len(out) - 1)
        return pa.table([table.column("block"), table.column("bucket"), pa.array(packed, pa.binary()), pa.array([total * f for f in first], pa.int64()), pa.array([kinds * f for f in first], pa.int64())], ["block", "bucket", "packed", "n", "v"])

    return run


def _received(told: pa.Table, steps: int) -> list[dict[str, np.ndarray]]:
    """The answers of each exchange, in the order of the questions."""
    out = []
    step, bucket, packed = told.column("step").to_numpy(), told.column("bucket").to_numpy(), told.column("packed").to_pylist()
    for k in range(steps):
        at = np.flatnonzero(step == k)
        parts = [pickle.loads(zstandard.decompress(packed[i])) for i in at[np.argsort(bucket[at])]]
        found = {}
        for name in ("words", "pairs", "test", "runs"):
            if name == "test":
                found[name] = np.frombuffer(b"".join(p.get(name, b"") for p in parts), np.uint8)
            else:
                found[name] = np.concatenate([np.zeros(0, np.int64), *(from_planes(p[name], len(p[name]) // 8).astype(np.int64) for p in parts if name in p)])
        out.append(found)
    return out


def _bodies(kept: int, block_bytes: int) -> Callable:
    """Blocks as numbers: the hashes of words that occur more than once in the block and of each word its place among these,
    from 1 on, or 0 for one that occurs once, whose hashes follow in their order."""
    blocks = block_tables(kept, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, table in blocks(batches):
            hashes, counts = word_hashes(column_bytes(table, kept))
            words = Keys(hashes)
            times = np.bincount(words.at, minlength=len(words.distinct))
            rank = np.argsort(-times, kind="stable")[: int((times > 1).sum())]
            place = np.zeros(len(times), np.uint32)
            place[rank] = np.arange(len(rank)) + 1
            at = place[words.at]
            sink = pa.BufferOutputStream()
            rest = table.select(range(kept))
            with pa.ipc.new_stream(sink, rest.schema) as w:
                w.write_table(rest)
            body = pickle.dumps((sink.getvalue().to_pybytes(), words.distinct[rank], hashes[at == 0], counts, at.view(np.uint8).reshape(-1, 4).T.copy()))
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([zstandard.compress(body, 1)], pa.binary())], ["block", "packed"])

    return run


def _opened(bodies: pa.Table | pa.RecordBatch, options: dict) -> tuple[pa.Table, Block]:
    rest, often, once, counts, at = pickle.loads(zstandard.decompress(bodies.column("packed")[0].as_py()))
    table = pa.ipc.open_stream(rest).read_all()
    at = np.ascontiguousarray(at.T).view(np.uint32).ravel()
    return table, Block(often, once, at, counts, ~table.column("held_out").to_numpy().astype(bool), options)


def score(docs: DataFrame, is_held_out=None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), block_bytes: int = 8 << 20, depth: int = 3, least: int = 2, gain: float = 8.0, spread: float = 0.6) -> DataFrame:
    """`keep` columns, held_out, n_tokens, n_known, train_tokens, base_score, score; learns from rows that are not held out."""
    prepare(docs.sparkSession)
    out = held_out(10, 0) if is_held_out is None else is_held_out
    base = docs.select(*keep, out.alias("held_out"), F.col(text).alias("_text"))
    if not replayable(base):
        base = written(base, "scoring")
    kept, parts = len(keep) + 1, base.rdd.getNumPartitions()
    options, buckets = {"depth": depth, "least": least, "spread": spread}, max(32, 4 * parts)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.select(*keep, "held_out").schema)
    bodies = written(base.mapInArrow(_bodies(kept, block_bytes), "block bigint, packed binary"), "blocks")
    row = "block bigint, bucket int, packed binary"

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                yield _questions(one.column("block")[0].as_py(), _opened(one, options)[1].exchange([], 0, 0), buckets)
                release()

    questions, told, n, v = bodies.mapInArrow(first, row), None, 0, 0
    for step in range(depth + 1):
        summed = questions.groupBy("bucket").applyInArrow(_answer(gain), f"{row}, n bigint, v bigint")
        answers = written(summed.withColumn("step", F.lit(step)), "answers")
        if step == 0:
            n, v = (x or 0 for x in answers.agg(F.sum("n"), F.sum("v")).first())
        told = answers if told is None else told.union(answers)
        if step < depth:
            questions = in_blocks(bodies, told, 4 * parts).applyInArrow(_next(step + 1, n, v, buckets, options), row)
        drop(docs.sparkSession)

    def last(bodies: pa.Table, told: pa.Table) -> pa.Table:
        release()
        table, block = _opened(bodies, options)
        block.exchange(_received(told, depth + 1), n, v)
        total = lambda x: np.add.reduceat(x, block.ends - block.sizes) if len(block.sizes) else x
        base_score = total(np.log10(block.known + 0.1)) - block.sizes * np.log10(n + 0.1 * (v + 1))
        columns = [pa.array(block.sizes), pa.array(total((block.known > 0).astype(np.int64))), pa.array(np.full(len(block.sizes), n, np.int64)), pa.array(base_score), pa.array(total(np.log10(block.p)))]
        return pa.table([*table.columns, *columns], [*table.column_names, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return in_blocks(bodies, told, 4 * parts).applyInArrow(last, f"{fields}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def _next(steps: int, n: int, v: int, buckets: int, options: dict) -> Callable:
    def run(bodies: pa.Table, told: pa.Table) -> pa.Table:
        release()
        _, block = _opened(bodies, options)
        asked = block.exchange(_received(told, steps), n, v)
        return pa.Table.from_batches([_questions(bodies.column("block")[0].as_py(), asked, buckets)])

    return run


def digest(docs: DataFrame) -> DataFrame:
    """The columns that the query returns."""
    return score(docs)


def reference(docs: list[tuple[int, str | None, bool]], depth: int = 3, least: int = 2, gain: float = 8.0, spread: float = 0.6) -> tuple[Callable, set[tuple]]:
    """By the definition, from rows (id, text, held out) with counts of tuples of words: the probability of a token behind
    others, and the nodes; for tests."""
    from collections import Counter, defaultdict

    train = [_tokens(t) for _, t, out in docs if not out]
    grams = Counter(tuple(w[a : a + k]) for w in train for k in range(1, depth + 2) for a in range(len(w) - k + 1))
    n, v = sum(map(len, train)), len({w for t in train for w in t})
    nodes: set[tuple] = set()

    def p(behind: tuple, w) -> float:
        context = behind[max(0, len(behind) - depth) :]
        if not context:
            return (grams[(w,)] + 0.1) / (n + 0.1 * (v + 1))
        below = p(context[1:], w)
        return (grams[(*context, w)] + grams[context] ** spread * below) / (grams[context] + grams[context] ** spread) if context in nodes else below

    for k in range(1, depth + 1):
        tests: dict[tuple, float] = defaultdict(float)
        for t in train:
            for j in range(k, len(t)):
                c = tuple(t[j - k : j])
                if grams[c] >= least:
                    s, q = grams[c] ** spread, p(c[1:], t[j])
                    tests[c] += np.log((grams[(*c, t[j])] - 1 + s * q) / (grams[c] - 1 + s) / q)
        nodes |= {c for c, x in tests.items() if x >= gain}
    return p, nodes


def _tokens(text: str | None) -> list[bytes | None]:
    return [*(text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split(), None]


def brute_force(docs: list[tuple[int, str | None, bool]], **options) -> dict[int, tuple[float, float]]:
    """Base and score of each text; for tests."""
    p, _ = reference(docs, **options)
    texts = {i: _tokens(t) for i, t, _ in docs}
    return {i: (sum(np.log10(p((), w)) for w in t), sum(np.log10(p(tuple(t[:j]), w)) for j, w in enumerate(t))) for i, t in texts.items()}
