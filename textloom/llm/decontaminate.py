"""Benchmark decontamination: find benchmark passages in documents by word n-grams, then drop the documents or cut the passages.

A word is a run of characters other than ASCII punctuation, spaces and control characters, after A-Z are lower-cased. An
item of n words or more gives its runs of n consecutive words as windows; a shorter one with any word is one window.

The windows of the benchmark, as a hash set over numbered words, go to every executor in one broadcast; each task scans
the token windows of its documents against it in numpy and verifies each hash hit word by word. Documents are never
shuffled.

A benchmark of more than `slice_bytes` of text (measured first) does not go whole: its windows are a table, and only their 64-bit
hashes are broadcast, in slices of at most `hash_bytes`. Each slice is one scan of the documents, which gives the windows whose hash is
in it as rows and writes no text; these are verified word by word by a join with the table of windows, and joined back by a
128-bit hash of the text, as equal texts have equal hits. So a benchmark of a hundred megabytes takes a few scans.

Defined cases: null text has no words and no hits; a null item text has no windows; an item without id marks words but is
not counted among the items; repeated items count once, repeated documents are each judged; an empty benchmark marks
nothing; extra columns of either table are ignored by `find_leaks`, and kept by `decontaminate`.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_list, prepare, release, sliced, written
from .ngram_join import mix, word_hashes

#: A-Z to a-z; every other ASCII character outside 0-9a-z to a space; bytes of other characters stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_MUL = np.uint64(0x9E3779B97F4A7C15)


def split_words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Windows:
    """The hash set of a benchmark slice's windows, by window length: hashes, ascending, with the words' numbers and the item."""

    def __init__(self, items: list[tuple[int | None, bytes]], n: int):
        self.vocab: dict[bytes, int] = {}
        rows: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
        self.items: list[int | None] = [i for i, _ in items]
        for at, (_, text) in enumerate(items):
            ids = np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in split_words(text)], dtype=np.int32)
            if size := min(n, len(ids)):
                windows = np.lib.stride_tricks.sliding_window_view(ids, size)
                rows[size].append((windows, np.full(len(windows), at, np.int32)))
        self.windows = {}
        for size, parts in rows.items():
            words, owner = np.concatenate([w for w, _ in parts]), np.concatenate([o for _, o in parts])
            hashes = hash_windows([words[:, k] for k in range(size)])
            order = np.lexsort((owner, hashes))
            hashes, owner, words = hashes[order], owner[order], words[order]
            new = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1]) | (words[1:] != words[:-1]).any(axis=1)))
            self.windows[size] = hashes[new], words[new], owner[new]

    def scan(self, words: list[list[bytes]]) -> tuple[list[np.ndarray], list[set[int]]]:
        """For each document: the indices of its hit words, sorted, and the items found."""
        counts = np.array([len(w) for w in words], dtype=np.int64)
        starts = np.concatenate(([0], np.cumsum(counts + 1)))
        ids = np.zeros(int(starts[-1]) + 1, dtype=np.int64)
        for k, w in enumerate(words):
            ids[starts[k] : starts[k] + len(w)] = np.fromiter(map(self.vocab.get, w, repeat(0)), np.int64, len(w))
        hit = np.zeros(len(ids), dtype=bool)
        found: list[set[int]] = [set() for _ in words]
        unknown = np.concatenate(([0], np.cumsum(ids == 0)))
        for size, (known, known_words, owner) in self.windows.items():
            if len(ids) < size:
                continue
            at = np.flatnonzero(unknown[size:] == unknown[:-size])
            hashes = hash_windows([ids[at + k] for k in range(size)])
            place = np.searchsorted(known, hashes)
            near = np.flatnonzero(known[np.minimum(place, len(known) - 1)] == hashes)
            for i, h, k in zip(at[near].tolist(), hashes[near], place[near].tolist()):
                while k < len(known) and known[k] == h:
                    if (known_words[k] == ids[i : i + size]).all():
                        hit[i : i + size] = True
                        if (item := self.items[owner[k]]) is not None:
                            found[int(np.searchsorted(starts, i, side="right")) - 1].add(item)
                    k += 1
        return [np.flatnonzero(hit[starts[k] : starts[k] + counts[k]]) for k in range(len(words))], found


def hash_windows(columns: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(columns[0]), dtype=np.uint64)
    for c in columns:
        out = (out ^ c.astype(np.uint64)) * _MUL
        out ^= out >> np.uint64(29)
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, n: int = 10, text: str = "text", item: str = "item_id", item_text: str = "text", keep: tuple[str, ...] = ("doc_id",), slice_bytes: int = 4 << 20, hash_bytes: int = 64 << 20) -> DataFrame:
    """`keep` columns of every document, then n_words, n_hit, hit_words (indices of hit words), item_ids (sorted as strings)."""
    spark = docs.sparkSession
    prepare(spark)
    items = benchmark.select(F.col(item).cast("long").alias("i"), F.col(item_text).alias("t")).filter("t is not null")
    if (items.agg(F.sum(F.octet_length("t"))).first()[0] or 0) > slice_bytes:
        return _find_by_hash(docs, items, n, text, keep, hash_bytes)
    inside = text in keep
    cur = docs.select(*keep) if inside else docs.select(*keep, F.col(text).alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cur.select(*keep).schema)
    sent = spark.sparkContext.broadcast(Windows([(r.i, r.t.encode()) for r in items.toLocalIterator()], n))
    return cur.mapInArrow(_scanner(sent, keep.index(text) if inside else len(keep), len(keep)), fields + ", n_words bigint, n_hit bigint, hit_words array<int>, item_ids array<string>")


def hashed_windows(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of `size` words: the text, the place of the first word in it, and a hash of the words."""
    words, counts = word_hashes([t.translate(FOLD) for t in texts])
    starts = np.cumsum(counts) - counts
    many = np.maximum(counts - size + 1, 0)
    owner = np.repeat(np.arange(len(texts)), many)
    place = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    h = np.full(len(owner), size, np.uint64)
    for k in range(size):
        h = mix(h * _MUL + words[starts[owner] + place + k]) if len(owner) else h
    return owner, place, h


def _item_windows(n: int):
    """size, h, words, item: a row for each distinct window of an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, 1, 1 << 20):
                rows: set[tuple] = set()
                texts, words = bytes_list(batch.column(1)), [split_words(t) for t in bytes_list(batch.column(1))]
                ids = batch.column(0).to_pylist()
                for size in sorted({min(n, len(w)) for w in words} - {0}):
                    own = [k for k, w in enumerate(words) if min(n, len(w)) == size]
                    for k, place, h in zip(*(x.tolist() for x in hashed_windows([texts[k] for k in own], size))):
                        rows.add((size, h, b" ".join(words[own[k]][place : place + size]), ids[own[k]]))
                if rows:
                    size, h, found, ident = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(size, pa.int32()), pa.array(np.array(h, np.uint64).view(np.int64)), pa.array(found, pa.binary()).cast(pa.string()), pa.array(ident, pa.int64())], ["size", "h", "words", "item"])

    return run


def _words_of(known: dict[int, list[bytes]], texts: list[bytes], k: int) -> list[bytes]:
    if k not in known:
        known[k] = split_words(texts[k])
    return known[k]


def _candidates(sent):
    """x, y, size, pos, h, words of the windows of texts (x, y, text) whose hash is in the slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, 2):
                texts = bytes_list(batch.column(2))
                words: dict[int, list[bytes]] = {}
                for size, known in sent.value.items():
                    owner, place, h = hashed_windows(texts, size)
                    at = np.flatnonzero(known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h)
                    if len(at):
                        own = owner[at]
                        found = [b" ".join(_words_of(words, texts, k)[p : p + size]) for k, p in zip(own.tolist(), place[at].tolist())]
                        of = pa.array(own)
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(np.full(len(at), size, np.int32)), pa.array(place[at].astype(np.int32)), pa.array(h[at].view(np.int64)), pa.array(found, pa.binary()).cast(pa.string())], ["x", "y", "size", "pos", "h", "words"])
        release()

    return run


def _find_by_hash(docs: DataFrame, items: DataFrame, n: int, text: str, keep: tuple[str, ...], hash_bytes: int) -> DataFrame:
    """As find_leaks, for a benchmark of any size."""
    spark = docs.sparkSession
    windows = written(items.select("i", "t").mapInArrow(_item_windows(n), "size int, h bigint, words string, item bigint").distinct(), "windows")
    hashes = written(windows.select("size", "h").distinct(), "window-hashes")
    slices = 1 + 8 * hashes.count() // hash_bytes
    key = [F.xxhash64(F.col(text)).alias("x"), F.xxhash64(F.lit(1), F.col(text)).alias("y")]
    texts = docs.filter(F.col(text).isNotNull()).select(*key, F.col(text).alias("t"))
    found = None
    for k in range(slices):
        table = hashes.filter(F.pmod("h", F.lit(slices)) == k).toArrow()
        size, h = table.column("size").to_numpy(), table.column("h").to_numpy().view(np.uint64)
        sent = spark.sparkContext.broadcast({int(c): np.sort(h[size == c]) for c in np.unique(size)})
        part = texts.mapInArrow(_candidates(sent), "x bigint, y bigint, size int, pos int, h bigint, words string")
        found = part if found is None else found.union(part)
    one = ["size", "h", "words"]
    sure = written(found.distinct().join(windows.select(*one).distinct(), one, "left_semi"), "hits")
    spans = sure.groupBy("x", "y").agg(F.collect_set(F.struct("pos", "size")).alias("s"))
    hits = spans.select("x", "y", F.array_sort(F.array_distinct(F.flatten(F.transform("s", lambda r: F.sequence(r["pos"], r["pos"] + r["size"] - 1))))).alias("hit_words"))
    named = sure.select("x", "y", *one).distinct().join(windows.filter("item is not null"), one).select("x", "y", F.col("item").cast("string").alias("item")).distinct()
    named = named.groupBy("x", "y").agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    told = hits.join(named, ["x", "y"], "left")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([len(split_words(t)) for t in bytes_list(batch.columns[-1])], pa.int64())], [*batch.schema.names[:-1], "n"])

    names = [f"c{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, names)], *key, F.col(text).alias("t"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    none = lambda kind: F.array().cast(f"array<{kind}>")
    out = rows.mapInArrow(count, f"{fields}, n bigint").join(told, ["x", "y"], "left").withColumn("hit_words", F.coalesce("hit_words", none("int")))
    return out.select(*[F.col(k).alias(c) for c, k in zip(keep, names)], F.col("n").alias("n_words"), F.size("hit_words").cast("bigint").alias("n_hit"), "hit_words", F.coalesce("item_ids", none("string")).alias("item_ids"))


def _scanner(sent, at: int, kept: int):
    """Scans the text in column `at`; the first `kept` columns stay."""

    def run(batches):
        windows = sent.value
        for whole in batches:
            for batch in sliced(whole, at):
                words = [split_words(t) for t in bytes_list(batch.column(at))]
                hits, found = windows.scan(words)
                cols = [*batch.columns[:kept], pa.array([len(w) for w in words], pa.int64()), pa.array([len(h) for h in hits], pa.int64()), pa.array([h.astype(np.int32) for h in hits], pa.list_(pa.int32())), pa.array([sorted(map(str, f)) for f in found], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names[:kept], "n_words", "n_hit", "hit_words", "item_ids"])
        release()

    return run


def digest(leaks: DataFrame) -> DataFrame:
    """The columns that the query returns."""
    return leaks.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, mode: str = "drop", text: str = "text", slice_bytes: int = 4 << 20) -> DataFrame:
    """The documents without leaks, with their own columns: mode "drop" drops a document with any hit word, "cut" removes
    each maximal run of hit words from its text (the characters between the run's words included) and keeps the rest."""
    if mode not in ("drop", "cut"):
        raise ValueError(f"mode is drop or cut, not {mode!r}")
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text)
    marked = find_leaks(docs.toDF(*names), benchmark, n, text=names[at], keep=tuple(names), slice_bytes=slice_bytes)
    back = [F.col(k).alias(c) for k, c in zip(names, docs.columns)]
    if mode == "drop":
        return marked.filter("n_hit = 0").select(*back)
    rows = marked.select(*names, "hit_words")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches):
        for b in batches:
            cut = [None if t is None else cut_words(t, h) if len(h) else t for t, h in zip(b.column(at).to_pylist(), b.column("hit_words").to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(cut, pa.string()), *b.columns[at + 1 : -1]], names)

    return rows.mapInArrow(run, fields).select(*back)


def cut_words(text: str, hit: list[int]) -> str:
    body, spans, end = text.encode(), [], 0
    folded = body.translate(FOLD)
    for w in folded.split():
        start = folded.index(w, end)
        end = start + len(w)
        spans.append((start, end))
    out, at, marked = [], 0, set(hit)
    for k, (start, stop) in enumerate(spans):
        if k in marked:
            if k - 1 not in marked:
                out.append(body[at:start])
            at = stop
    return b"".join([*out, body[at:]]).decode()


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], n: int = 10) -> dict[int, tuple]:
    """By the definition, one window at a time; for tests."""
    wins = [(i, w[k : k + min(n, len(w))]) for i, t in items for w in [split_words((t or "").encode())] for k in range(max(0, len(w) - min(n, len(w)) + 1) if w else 0)]
    out = {}
    for doc, t in docs:
        words, hit, found = split_words((t or "").encode()), set(), set()
        for i, w in wins:
            for k in range(len(words) - len(w) + 1):
                if words[k : k + len(w)] == w:
                    hit.update(range(k, k + len(w)))
                    found.add(str(i))
        out[doc] = (len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out
