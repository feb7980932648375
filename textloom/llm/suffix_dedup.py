"""Removal of repeated byte strings: every byte covered by a string of `width` bytes that also starts earlier.

Which windows of `width` bytes are repeats is decided in shards by external suffix sorting with common prefixes
(induced_sort.py). A window's shard follows from its own bytes: the gram that is its minimiser (anchors.py). Equal windows
of whichever documents meet in one shard, so no match is lost, and none crosses documents.

1. A block (a run of whole documents in one task) cuts its windows into chunks by minimiser. Of equal chunks in a block
   only the first can hold a first occurrence. For each gram, the block gives one row: the hash of the chunk's bytes, or a
   mark that it has several different ones. However many copies there are, a gram is one row a block.
2. Rows of equal grams meet. A gram with one chunk everywhere needs no sorting: the earliest chunk stays, the others
   repeat it byte for byte. A gram with different chunks is a border between what repeats and what does not.
3. Blocks give the bytes of border chunks, which are suffix-sorted in shards of about `shard_bytes`, in files on the
   task's own disk while it runs. Windows whose common prefix covers `width` bytes are equal; the earliest stays.
   A gram with more than `hot` different chunks (by default, what fills a sixteenth of a shard) is divided first: its windows
   fall into halves by where the gram lies in them, and the bytes that all windows of a half share are a longer gram.
   The sorter's queues hold `shard_bytes` in memory and the rest on disk, so they spill in any shard of about its size.
4. Blocks meet their verdicts and remove bytes.

Defined cases: a null text is empty and keeps its hash of nothing; texts under `width` bytes lose nothing; of rows that
repeat an id, the one in the earlier block, and in a block the earlier row, counts as earlier; a null id counts as larger
than all others; an empty table gives no rows; extra columns are kept by `remove_repeats` if named.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import GRAM, chunks, gram_hashes
from .common import block_bodies, block_tables, body_table, column_bytes, drop, from_planes, in_blocks, planes, prepare, release, replayable, sliced, written
from .induced_sort import CAP, sort_file

_LATE = np.iinfo(np.int64).max
SEVERAL = np.uint64(0)  # in place of a chunk's hash
KEEP, REPEAT, BORDER = 0, 1, 2


class Cut:
    """A block's chunks, and which of them the rest of the corpus has to judge."""

    def __init__(self, ids: np.ndarray, texts: list[bytes], width: int, buckets: int):
        self.texts, self.ids = texts, ids
        sizes = np.array([len(t) for t in texts], np.int64)
        self.begins = np.concatenate(([0], np.cumsum(sizes)))
        text, h, c, self.first, self.count = chunks(texts, width)
        c = np.maximum(c, np.uint64(1))
        rank = np.empty(len(texts), np.int64)
        rank[np.argsort(ids, kind="stable")] = np.arange(len(texts))
        self.text = text
        gram = h >> np.uint64(16)
        order = np.lexsort((self.first, rank[text], c, gram))
        g, k = gram[order], c[order]
        new_gram = np.concatenate(([True], g[1:] != g[:-1])) if len(g) else np.zeros(0, bool)
        new = new_gram | np.concatenate(([True], k[1:] != k[:-1])) if len(g) else new_gram
        self.local_repeat = np.ones(len(g), bool)
        self.local_repeat[order[new]] = False
        heads = np.flatnonzero(new_gram)
        kinds = np.add.reduceat(new.astype(np.int64), heads) if len(heads) else heads
        #: a row for each distinct gram: the gram, its chunk's hash or SEVERAL, the id of the chunk's document
        self.row_gram = g[heads]
        self.row_hash = np.where(kinds > 1, SEVERAL, k[heads]) if len(heads) else k
        self.row_id = ids[text[order[heads]]] if len(heads) else np.zeros(0, np.int64)
        self.row_of = np.empty(len(g), np.int64)
        self.row_of[order] = np.cumsum(new_gram) - 1
        self.bucket = (self.row_gram * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(buckets)
        self.by_bucket = np.argsort(self.bucket, kind="stable")
        self.edges = np.searchsorted(self.bucket[self.by_bucket], np.arange(buckets + 1))

    def judged(self, verdicts: pa.Table) -> np.ndarray:
        """KEEP, REPEAT or BORDER for each chunk."""
        row = np.zeros(len(self.row_gram), np.uint8)
        filled = 0
        for bucket, packed in zip(verdicts.column("bucket").to_pylist(), verdicts.column("verdict").to_pylist()):
            at = self.by_bucket[self.edges[bucket] : self.edges[bucket + 1]]
            got = np.frombuffer(zstandard.decompress(packed), np.uint8)
            if len(got) != len(at):
                raise RuntimeError("the documents changed between two passes; write them as a table first")
            row[at] = got
            filled += len(at)
        if filled != len(row):
            raise RuntimeError("the documents changed between two passes; write them as a table first")
        return np.where(self.local_repeat, REPEAT, row[self.row_of]) if len(row) else np.zeros(0, np.uint8)


def _cut(table: pa.Table, kept: int, width: int, buckets: int) -> Cut:
    ids = table.column(0).combine_chunks().fill_null(_LATE).to_numpy(zero_copy_only=False).astype(np.int64)
    return Cut(ids, column_bytes(table, kept), width, buckets)


def _rows(kept: int, block_bytes: int, width: int, buckets: int) -> Callable:
    blocks = block_tables(kept, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, table in blocks(batches):
            cut = _cut(table, kept, width, buckets)
            out = []
            for k in np.flatnonzero(np.diff(cut.edges)).tolist():
                at = cut.by_bucket[cut.edges[k] : cut.edges[k + 1]]
                g = cut.row_gram[at]  # ascending
                out.append((k, len(at), zstandard.compress(planes(np.diff(g, prepend=np.uint64(0))) + planes(cut.row_hash[at]) + planes(cut.row_id[at].view(np.uint64)), 1)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([block] * len(out), pa.int64()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.binary())], ["bucket", "block", "n", "packed"])

    return run


def _judge(table: pa.Table) -> pa.Table:
    blocks, sizes = table.column("block").to_numpy(), table.column("n").to_numpy().astype(np.int64)
    gram, hashes, ids = (np.empty(int(sizes.sum()), np.uint64) for _ in range(3))
    at = np.concatenate(([0], np.cumsum(sizes)))
    for i, packed in enumerate(table.column("packed").to_pylist()):
        raw, n = zstandard.decompress(packed), int(sizes[i])
        s = slice(at[i], at[i + 1])
        gram[s], hashes[s], ids[s] = np.cumsum(from_planes(raw[: 8 * n], n), dtype=np.uint64), from_planes(raw[8 * n : 16 * n], n), from_planes(raw[16 * n :], n)
    block = np.repeat(blocks, sizes)
    # few grams occur twice: only those are put in order
    order = np.argsort(gram, kind="stable")
    g = gram[order]
    same = np.concatenate((g[1:] == g[:-1], [False]))
    twice = order[same | np.concatenate(([False], same[:-1]))]
    verdict = np.where(hashes == SEVERAL, BORDER, KEEP).astype(np.uint8)
    if len(twice):
        sub = twice[np.lexsort((block[twice], ids[twice].view(np.int64), hashes[twice], gram[twice]))]
        g, c = gram[sub], hashes[sub]
        new = np.concatenate(([True], g[1:] != g[:-1]))
        heads = np.flatnonzero(new)
        fresh = new | np.concatenate(([True], c[1:] != c[:-1]))
        mixed = np.repeat((np.add.reduceat(fresh.astype(np.int64), heads) > 1) | (np.minimum.reduceat(c, heads) == SEVERAL), np.diff(np.append(heads, len(g))))
        verdict[sub] = np.where(c == SEVERAL, BORDER, np.where(~fresh, REPEAT, np.where(mixed, BORDER, KEEP)))
    out = [zstandard.compress(verdict[at[i] : at[i + 1]].tobytes(), 1) for i in range(len(sizes))]
    return pa.table([table.column("bucket"), table.column("block"), pa.array(out, pa.binary())], ["bucket", "block", "verdict"])


def _border_bytes(kept: int, width: int, buckets: int) -> Callable:
    def run(bodies: pa.Table, verdicts: pa.Table) -> pa.Table:
        release()
        table = body_table(bodies)
        cut = _cut(table, kept, width, buckets)
        at = np.flatnonzero(cut.judged(verdicts) == BORDER)
        flat = b"".join(cut.texts)
        first, count = cut.first[at], cut.count[at]
        pieces = [flat[s : s + n] for s, n in zip(first.tolist(), (count + width - 1).tolist())]
        return pa.table([pa.array(cut.row_gram[cut.row_of[at]].view(np.int64)), pa.array(np.full(len(at), bodies.column("block")[0].as_py(), np.int64)), pa.array(cut.ids[cut.text[at]]), pa.array(first), pa.array(pieces, pa.binary())], ["gram", "block", "id", "first", "piece"])

    return run


def _sort_shard(width: int, budget: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as where:
            path, meta, size = os.path.join(where, "symbols"), [], 0
            with open(path, "wb") as f:
                for b in batches:
                    col = b.column(b.schema.get_field_index("piece"))
                    sizes = np.diff(np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]).astype(np.int64)
                    if not len(sizes):
                        continue
                    out = np.zeros(int(sizes.sum()) + len(sizes), np.uint16)
                    ends = np.cumsum(sizes + 1) - 1
                    body = np.ones(len(out), bool)
                    body[ends] = False
                    out[body] = np.frombuffer(b"".join(col.to_pylist()), np.uint8).astype(np.uint16) + 1
                    out.tofile(f)
                    meta.append(np.stack([b.column(b.schema.get_field_index(c)).to_numpy() for c in ("block", "id", "first")] + [ends - sizes + size, sizes]))
                    size += len(out)
            if not meta:
                return
            release()
            block, ident, first, start, sizes = np.concatenate(meta, axis=1)
            found = []
            for place, common in sort_file(path, width, budget):
                group = np.cumsum(common < width)
                piece = np.searchsorted(start, place, side="right") - 1
                offset = place - start[piece]
                live = np.flatnonzero(offset + width <= sizes[piece])
                p, o, g = piece[live], offset[live], group[live]
                many = np.bincount(g)[g] > 1 if len(g) else np.zeros(0, bool)
                p, o, g = p[many], o[many], g[many]
                if not len(g):
                    continue
                order = np.lexsort((first[p] + o, block[p], ident[p], g))
                g = g[order]
                later = order[np.concatenate(([False], g[1:] == g[:-1]))]
                found.append(np.stack([block[p[later]], first[p[later]] + o[later]]))
            if found:
                blk, at = np.concatenate(found, axis=1)
                order = np.lexsort((at, blk))
                blk, at = blk[order], at[order]
                heads = np.flatnonzero(np.concatenate(([True], (blk[1:] != blk[:-1]) | (at[1:] != at[:-1] + 1))))
                yield pa.RecordBatch.from_arrays([pa.array(blk[heads]), pa.array(at[heads]), pa.array(np.diff(np.append(heads, len(at))).astype(np.int64))], ["block", "first", "count"])
        release()

    return run


def _halves(width: int) -> Callable:
    """Rows (gram, block, id, first, piece, lo, hi, place) cut in two by where in a window the gram lies: lo to hi bytes from its
    start. All windows of a half share more bytes around the gram, and these are its new gram. place: of the first gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in sliced(whole, whole.schema.get_field_index("piece"), 1 << 20):
                rows: list[tuple] = []
                for gram, block, ident, first, piece, lo, hi, place in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("gram", "block", "id", "first", "piece", "lo", "hi", "place"))):
                    if place is None:  # the leftmost gram with this hash is the minimiser
                        found = gram_hashes(np.frombuffer(piece, np.uint8)) >> np.uint64(16)
                        place = int(np.flatnonzero(found == np.uint64(gram))[0])
                    mid = (lo + hi) // 2
                    for u, v in ((lo, mid), (mid + 1, hi)):
                        start, end = max(0, place - v), min(len(piece) - width, place - u)
                        if start <= end:
                            part = piece[start : end + width]
                            new = hashlib.blake2b(b"%d %d " % (u, v) + piece[place - u : place + width - v], digest_size=8).digest()
                            rows.append((int.from_bytes(new, "big", signed=True), block, ident, first + start, part, u, v, place - start, hashlib.blake2b(part, digest_size=16).digest()))
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["gram", "block", "id", "first", "piece", "lo", "hi", "place", "same"])

    return run


def _divided(border: DataFrame, width: int, hot: int) -> tuple[DataFrame, DataFrame | None]:
    """The chunks with no gram that has more than `hot` different ones, and the ranges that this has already shown to repeat.

    Chunks of such a gram are cut in two (_halves); of halves that are equal byte for byte the earliest stays and the others
    repeat it; a new gram with one kind of half needs no sorting, and one that still has too many is cut again. A gram that is
    a whole window has one kind, so this ends after log2(width) cuts. A lookup by the bytes' 128-bit hash is what equal means.
    """
    repeats = None
    rest = border.select(*_PIECE, F.lit(0).alias("lo"), F.lit(width - GRAM).alias("hi"), F.lit(None).cast("int").alias("place"))
    cold = None
    while True:
        often = written(rest.groupBy("gram").count().filter(F.col("count") > hot).select("gram"), "often")
        many = often.count()
        if not many:
            cold = rest if cold is None else cold.union(rest)
            return cold.select(*_PIECE), repeats
        flags = F.broadcast(often.withColumn("hot", F.lit(True))) if many <= 1_000_000 else often.withColumn("hot", F.lit(True))
        parts = written(rest.join(flags, "gram", "left"), "parts")
        calm = parts.filter("hot is null").drop("hot")
        cold = calm if cold is None else cold.union(calm)
        cut = written(parts.filter("hot").drop("hot").mapInArrow(_halves(width), "gram bigint, block bigint, id bigint, first bigint, piece binary, lo int, hi int, place int, same binary"), "halves")
        when = F.struct("id", "block", "first")
        kinds = written(cut.groupBy("gram", "same").agg(F.min(F.struct(when.alias("e"), "piece", "lo", "hi", "place")).alias("r"), F.count("*").alias("n")).select("gram", "same", "r.*", "n"), "kinds")
        later = cut.select("gram", "same", "block", "first", when.alias("w"), (F.octet_length("piece") - width + 1).cast("long").alias("count"))
        later = later.join(kinds.filter("n > 1").select("gram", "same", "e"), ["gram", "same"]).filter("w <> e").select("block", "first", "count")
        repeats = written(later if repeats is None else repeats.union(later), "repeats")
        several = written(kinds.groupBy("gram").count().filter("count > 1").select("gram"), "several")
        rest = kinds.join(several, "gram", "left_semi").select("gram", "e.block", "e.id", "e.first", "piece", "lo", "hi", "place")


_PIECE = ("gram", "block", "id", "first", "piece")


def _remove(kept: int, width: int, buckets: int, full: bool) -> Callable:
    def run(bodies: pa.Table, told: pa.Table) -> pa.Table:
        release()
        table = body_table(bodies)
        cut = _cut(table, kept, width, buckets)
        ranges = told.filter(pa.compute.is_null(told.column("verdict")))
        judged = cut.judged(told.filter(pa.compute.is_valid(told.column("verdict"))))
        repeat = np.flatnonzero(judged == REPEAT)
        first = np.concatenate((cut.first[repeat], ranges.column("first").to_numpy()))
        count = np.concatenate((cut.count[repeat], ranges.column("count").to_numpy()))
        change = np.zeros(int(cut.begins[-1]) + 1, np.int32)
        np.add.at(change, first, 1)
        np.add.at(change, first + count + width - 1, -1)
        np.cumsum(change, out=change)
        gone = change[:-1] > 0
        del change
        sizes = np.diff(cut.begins)
        opened = gone & ~np.concatenate(([False], gone[:-1]))
        removed, spans, digests, left = [], [], [], []
        null = table.column(kept).is_null().to_pylist() if full else []
        for i, (a, b) in enumerate(zip(cut.begins[:-1].tolist(), cut.begins[1:].tolist())):
            mask = gone[a:b]
            n = int(np.count_nonzero(mask))
            rest = cut.texts[i] if not n else np.frombuffer(cut.texts[i], np.uint8)[~mask].tobytes()
            removed.append(n)
            spans.append(int(np.count_nonzero(opened[a:b])) + (a > 0 and n > 0 and bool(mask[0]) and bool(gone[a - 1])) if n else 0)
            digests.append(hashlib.sha256(rest).hexdigest())
            if full:
                left.append(None if null[i] else rest.decode("utf-8", "ignore"))
        out = [pa.array(sizes), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())] + ([pa.array(left, pa.string())] if full else [])
        return pa.table([*table.columns[1:kept], *out], [*table.column_names[1:kept], *("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")[: len(out)]])

    return run


def find_repeats(docs: DataFrame, width: int = 100, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] = ("doc_id",), block_bytes: int = 12 << 20, shard_bytes: int = 4 << 20, hot: int | None = None, full: bool = False) -> DataFrame:
    """`keep` columns, n_bytes, n_removed, n_spans, kept_sha256; with `full`, kept (the text that is left, without
    characters that are cut through; null for null)."""
    if not GRAM <= width <= CAP:
        raise ValueError(f"width is {GRAM} to {CAP} bytes, not {width}")
    prepare(docs.sparkSession)
    base = docs.select(F.col(f"`{doc_id}`").cast("long").alias("_order"), *keep, F.col(f"`{text}`").alias("_text"))
    if not replayable(base):
        base = written(base, "repeats")
    kept = len(keep) + 1
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.select(*keep).schema)
    buckets = max(32, 2 * base.rdd.getNumPartitions())
    tasks = buckets
    rows = base.mapInArrow(_rows(kept, block_bytes, width, buckets), "bucket int, block bigint, n int, packed binary")
    verdicts = written(rows.groupBy("bucket").applyInArrow(_judge, "bucket int, block bigint, verdict binary"), "verdicts")
    bodies = block_bodies(base, kept, block_bytes)
    border = written(in_blocks(bodies, verdicts, tasks).applyInArrow(_border_bytes(kept, width, buckets), "gram bigint, block bigint, id bigint, first bigint, piece binary"), "borders")
    drop(docs.sparkSession)
    border, repeats = _divided(border, width, max(1, shard_bytes // (16 * width)) if hot is None else hot)
    shards = max(8, 1 + int((border.agg(F.sum(F.octet_length("piece"))).first()[0] or 0) // shard_bytes))
    ranges = border.repartition(shards, "gram").mapInArrow(_sort_shard(width, shard_bytes), "block bigint, first bigint, count bigint")
    if repeats is not None:
        ranges = ranges.union(repeats)
    told = verdicts.select("block", "bucket", "verdict", F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("count")).unionByName(written(ranges, "ranges"), allowMissingColumns=True)
    more = ", kept string" if full else ""
    return in_blocks(bodies, told, tasks).applyInArrow(_remove(kept, width, buckets, full), f"{fields}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string{more}")


def digest(docs: DataFrame) -> DataFrame:
    """The columns that the query returns."""
    return find_repeats(docs)


def remove_repeats(docs: DataFrame, width: int = 100, text: str = "text", doc_id: str = "doc_id", block_bytes: int = 12 << 20) -> DataFrame:
    """The documents, with their own columns, without repeated bytes; a character that is cut through goes whole."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text)
    others = tuple(n for i, n in enumerate(names) if i != at)
    found = find_repeats(docs.toDF(*names), width, names[at], names[docs.columns.index(doc_id)], others, block_bytes=block_bytes, full=True)
    return found.select(*[F.col("kept" if i == at else n).alias(c) for i, (n, c) in enumerate(zip(names, docs.columns))])


def brute_force(docs: list[tuple[int, str | None]], width: int = 100) -> dict[int, tuple[int, int, int, str]]:
    """By the definition, over a set of all earlier strings; for tests."""
    seen: set[bytes] = set()
    out = {}
    for doc, text in sorted(docs, key=lambda d: d[0]):
        t = (text or "").encode()
        gone = bytearray(len(t))
        for i in range(len(t) - width + 1):
            w = t[i : i + width]
            if w in seen:
                gone[i : i + width] = b"\1" * width
            seen.add(w)
        out[doc] = (len(t), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest())
    return out
