"""N-gram Jaccard join: which documents' sets of word shingles have a Jaccard similarity of at least num/den, exactly.

A document's set is that of its distinct shingles of k words, each as a 64-bit hash; one of fewer words is one shingle.

1. Equal sets are one class. A task gives the tiles of one member of each class only, however many copies there are.
2. Size bands. Classes fall into bands of set size, each half as large again as the one before; a class is entered in
   its own band and, if a partner may be there, in the next ones.
3. Tiles. Sets of sizes a and b that link differ in at most (den - num)(a + b) / (den + num) shingles. With d the largest
   such difference in a band, the shingles of each set are dealt by hash into more than d parts: d differing shingles
   touch d parts at most, so sets that link agree wholly in the others. A tile is the classes of a band that agree in one
   part and have shingles there. A set with so many empty parts that all those which agree may be empty is dealt again,
   by another hash, until it has fewer; of two sets that link, the one that is done first shares a tile with the other in
   that deal. Sets that are never done (with low thresholds only) share one tile of their band. So no pair that links is
   lost, and only classes that share a tile are compared.
4. In a tile, the class with the smallest id is compared with each other one: edges of a star, not all pairs. Pairs are
   compared once, first by set sizes and hashed bitmaps of their sets: a bit that differs is at least one shingle that only
   one of the two has, so the count of such bits bounds the overlap from above. The bitmaps, not the texts, travel to the
   pairs. For pairs that the bound leaves, and whose sets are not equal, the texts are fetched and the sorted sets intersected.
5. Linked classes form components. Where a tile's classes lie in more than one, all pairs across components that the
   bitmaps leave are compared, in blocks of `block` classes; most tiles have one component by then, and tiles of the same
   classes are compared once. While such tiles are large (more than `few` classes on average), blocks in which the bitmaps leave
   more than PAIRS pairs a class are put off: each class there is first compared with the likeliest one of another component only.
   Tiles that had such blocks, and no others, come back round after round as long as that links any, so that few pairs are left; then
   all of theirs are compared.

A block of documents links the members of a tile that it has itself, and sends the smallest one only, so a tile that many
documents share is one row a block where blocks meet.

Defined cases: texts that are null or without words have an empty set and link with nothing; a null id stands for
nothing, and its rows come back with a null component; rows that repeat an id: each has its own set size, and the
component joins them all; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import block_tables, bytes_list, column_bytes, connected_components, drop, from_planes, planes, prepare, release, replayable, sliced, written

#: A-Z to a-z and the other ASCII spaces to a plain one.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if c in b"\t\n\x0b\x0c\r" else c for c in range(256))
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
DEALS = 12
PRECISION = 16
TILE_BITS = 48  # tiles that agree by chance cost a comparison, no more
PAIRS = 4


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M2
    return (x ^ (x >> np.uint64(29))) * _M1


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, in order, and the number of words of each text."""
    flat = np.frombuffer(b"".join(t.translate(_LOWER) + b" " for t in texts), dtype=np.uint8)
    sizes = np.array([len(t) + 1 for t in texts])
    inside = flat != 32
    first = np.flatnonzero(inside & np.concatenate(([True], ~inside[:-1])))
    last = np.flatnonzero(inside & np.concatenate((~inside[1:], [True]))) + 1
    counts = np.diff(np.searchsorted(first, np.concatenate(([0], np.cumsum(sizes)))))
    if not len(first):
        return np.zeros(0, np.uint64), counts
    # eight bytes at a time, all words of that length at once
    width = last - first
    out = np.zeros(len(first), np.uint64)
    pos = first.copy()
    left = width.copy()
    live = np.arange(len(first))
    padded = np.concatenate((flat, np.zeros(8, np.uint8)))
    view = np.lib.stride_tricks.as_strided(padded, (len(flat), 8), (1, 1))
    while len(live):
        take = np.minimum(left, 8)
        eight = np.ascontiguousarray(view[pos]).view(np.uint64).ravel()
        eight &= np.where(take == 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (take.astype(np.uint64) * np.uint64(8) & np.uint64(63))) - np.uint64(1))
        out[live] = mix(out[live] * _M1 + eight + take.astype(np.uint64) * _M2)
        more = left > 8
        live, pos, left = live[more], pos[more] + 8, left[more] - 8
    return out, counts


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, counts = word_hashes(texts)
    out, at = [], 0
    w = np.concatenate((words, np.zeros(k, np.uint64)))
    h = np.zeros(len(words), np.uint64)
    for j in range(k):
        h = mix(h * _M1 + w[j : j + len(words)])
    for n in counts.tolist():
        if 0 < n < k:
            short = np.uint64(n)
            for x in words[at : at + n]:
                short = mix(np.array([short]) * _M1 + x)[0]
            out.append(np.array([short]))
        else:
            out.append(np.unique(h[at : at + max(0, n - k + 1)]))
        at += n
    return out


@lru_cache
def _ends(most: int = 1 << 40) -> np.ndarray:
    """Lower ends of the size bands."""
    ends = [1]
    while ends[-1] < most:
        ends.append(max(ends[-1] + 1, ends[-1] * 3 // 2))
    return np.array(ends)


def _part_keys(s: np.ndarray, parts: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each part: a hash of the shingles that are dealt to it and of its place, and whether it is empty."""
    part = ((mix(s + np.uint64(seed)) >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    heads = np.flatnonzero(np.diff(part[order], prepend=-1))
    sums = np.zeros(parts, np.uint64)
    sums[part[order][heads]] = np.add.reduceat(mix(s[order] ^ _M1), heads)
    empty = np.ones(parts, bool)
    empty[part] = False
    return mix(sums + mix(np.arange(parts, dtype=np.uint64) * _M1 + np.uint64(seed))), empty


@lru_cache(1 << 12)
def _parts(band: int, num: int, den: int) -> int:
    """More than the shingles that differ in sets of the band, by as many as parts are likely to be empty."""
    low, high = int(_ends()[band]) * num // den, int(_ends()[band + 1]) - 1
    differ = (den - num) * 2 * high // (den + num)
    spare = 0
    for _ in range(4):
        parts = differ + 1 + spare
        empty = parts * math.exp(-max(low, 1) / parts)
        spare = min(math.ceil(empty + 3 * math.sqrt(empty)), differ + 4) if differ else 0
    return differ + 1 + spare


def tiles(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """All tiles of a set."""
    ends, n, out = _ends(), len(s), []
    if not n:
        return np.zeros(0, np.uint64)
    own = band = int(np.searchsorted(ends, n, side="right")) - 1
    while band == own or n * den >= num * int(ends[band]):  # a partner as small as the band's smallest may link
        parts = _parts(band, num, den)
        partner = min(int(ends[band + 1]) - 1, n * den // num)
        sure = parts - (den - num) * (n + partner) // (den + num)  # parts that agree with any partner in the band
        tag = np.uint64((band * 0x5851F42D4C957F2D + 1) & 0xFFFFFFFFFFFFFFFF)
        for deal in range(DEALS):
            keys, empty = _part_keys(s, parts, deal)
            out.append(mix(keys[~empty] ^ tag))
            if int(empty.sum()) < sure:
                break
        else:
            out.append(mix(np.array([tag])))
        band += 1
    return np.unique(np.concatenate(out)) >> np.uint64(64 - TILE_BITS)


def bitmap(s: np.ndarray, num: int, den: int) -> bytes:
    """A hashed bitmap of the set: a bit is set if an odd number of shingles falls on it. It has PRECISION bits or more for each
    shingle in which a set of this size may differ from one that links, as a power of two of 64-bit words: then sets that
    differ in a seventh more are told apart, as few shingles fall together."""
    words = 1
    while 64 * words < PRECISION * (den - num) * 2 * len(s) // (den + num):
        words *= 2
    odd = np.bincount(((s >> np.uint64(7)) & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(maps: list[bytes], words: int) -> np.ndarray:
    """The bitmaps as rows of `words` words, which none has fewer of: words that fall together are added bit by bit."""
    sizes, out = np.array([len(m) for m in maps]), np.empty((len(maps), words), np.uint64)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        flat = np.frombuffer(b"".join([maps[i] for i in at]), np.uint64)
        out[at] = np.bitwise_xor.reduce(flat.reshape(len(at), -1, words), axis=1)
    return out


def most_common(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An upper bound of each pair's overlap, from rows of bitmaps and set sizes: what is common falls on the same bits, so
    bits that differ are at least one shingle each that only one of the two has."""
    return (a + b - np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)) // 2


def sketches(docs: DataFrame, k: int, num: int, den: int, buckets: int, block_bytes: int = 12 << 20) -> DataFrame:
    """Three kinds of rows over rows (id, t): id, n, s (set size and 128-bit fingerprint of the set; null if empty) and bits
    (the bitmap, for those whose tiles were given); tile, a, b for the members b of a tile that one block has several of, a
    the smallest; bucket, packed for the smallest member of each tile of a block."""
    blocks = block_tables(1, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, bytes]] = set()
        for _, table in blocks(batches):
            ids, texts = table.column(0).combine_chunks(), column_bytes(table, 1)
            sizes, prints, maps, who, keys = [], [], [], [], []
            for start, end in _runs(texts):
                for i, s in enumerate(shingle_sets(texts[start:end], k), start):
                    f = None if not len(s) else mix(s).sum(dtype=np.uint64).tobytes() + mix(s ^ _M2).sum(dtype=np.uint64).tobytes()
                    new = f is not None and ids[i].is_valid and (len(s), f) not in seen
                    if new:
                        found = tiles(s, num, den)
                        who.append(np.full(len(found), i))
                        keys.append(found)
                        if len(seen) < 1 << 20:
                            seen.add((len(s), f))
                    sizes.append(len(s))
                    prints.append(f)
                    maps.append(bitmap(s, num, den) if new else None)
            yield _rows(id=ids, n=pa.array(sizes, pa.int64()), s=pa.array(prints, pa.binary()), bits=pa.array(maps, pa.binary()))
            if not keys:
                continue
            member, tile = ids.fill_null(0).to_numpy()[np.concatenate(who)], np.concatenate(keys)
            order = np.lexsort((member, tile))
            member, tile = member[order], tile[order]
            heads = np.flatnonzero(np.concatenate(([True], tile[1:] != tile[:-1])))
            counts = np.diff(np.append(heads, len(tile)))
            least = np.repeat(member[heads], counts)
            many = np.repeat(counts > 1, counts)
            if many.any():
                yield _rows(tile=pa.array(tile[many].view(np.int64)), a=pa.array(least[many]), b=pa.array(member[many]))
            tile, member = tile[heads], member[heads]
            edges = np.searchsorted(tile >> np.uint64(TILE_BITS - 32), (np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(buckets))
            full = np.flatnonzero(np.diff(edges)).tolist()
            packed = [zstandard.compress(planes(np.diff(tile[edges[q] : edges[q + 1]], prepend=np.uint64(0))) + planes(member[edges[q] : edges[q + 1]].astype(np.int64).view(np.uint64)), 1) for q in full]
            yield _rows(bucket=pa.array(full, pa.int32()), packed=pa.array(packed, pa.binary()))

    return docs.mapInArrow(run, ", ".join(f"{n} {t}" for n, (t, _) in _ROWS.items()))


_ROWS = {"id": ("bigint", pa.int64()), "n": ("bigint", pa.int64()), "s": ("binary", pa.binary()), "bits": ("binary", pa.binary()), "tile": ("bigint", pa.int64()), "a": ("bigint", pa.int64()), "b": ("bigint", pa.int64()), "bucket": ("int", pa.int32()), "packed": ("binary", pa.binary())}


def _runs(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes (a longer one stands alone)."""
    start = size = 0
    for end, t in enumerate(texts):
        if end > start and size + len(t) > most:
            yield start, end
            start, size = end, 0
        size += len(t)
    if texts:
        yield start, len(texts)


def _rows(**columns: pa.Array) -> pa.RecordBatch:
    size = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns.get(n, pa.nulls(size, t)) for n, (_, t) in _ROWS.items()], list(_ROWS))


def _meet(table: pa.Table) -> pa.Table:
    """tile, a, b for the blocks' smallest members b of a tile that several blocks have, a the smallest of all."""
    release()
    tile, member = [], []
    for raw in map(zstandard.decompress, table.column("packed").to_pylist()):
        n = len(raw) // 16
        tile.append(np.cumsum(from_planes(raw[: 8 * n], n), dtype=np.uint64))
        member.append(from_planes(raw[8 * n :], n).view(np.int64))
    tile, member = np.concatenate(tile), np.concatenate(member)
    order = np.argsort(tile, kind="stable")
    same = np.concatenate((tile[order][1:] == tile[order][:-1], [False]))
    order = order[same | np.concatenate(([False], same[:-1]))]
    order = order[np.lexsort((member[order], tile[order]))]
    tile, member = tile[order], member[order]
    heads = np.flatnonzero(np.concatenate(([True], tile[1:] != tile[:-1]))) if len(tile) else np.zeros(0, np.int64)
    least = np.repeat(member[heads], np.diff(np.append(heads, len(tile))))
    return pa.table([pa.array(tile.view(np.int64)), pa.array(least), pa.array(member)], ["tile", "a", "b"])


def only(docs: DataFrame, ids: DataFrame, most: int = 1_000_000) -> DataFrame:
    """The rows whose id is in `ids` (a written table): by broadcast up to `most` ids, else by a shuffle."""
    ids = ids.distinct()
    return docs.join(F.broadcast(ids) if ids.count() <= most else ids, "id", "left_semi")


def plausible(pairs: DataFrame, signs: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that may link by set sizes and bitmaps in `signs` (id, n, s, bits), each once, and whether they surely
    do, as their sets are equal."""
    side = lambda c: signs.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("s").alias(f"s{c}"), F.col("bits").alias(f"bits{c}"))
    near = F.least("na", "nb") * den >= F.greatest("na", "nb") * num
    rows = pairs.join(side("b"), "b").join(side("a"), "a").filter(near).select("a", "b", "na", "nb", "bitsa", "bitsb", ((F.col("sa") == F.col("sb")) & (F.col("na") == F.col("nb"))).alias("equal"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(at, 4096) for at in range(0, whole.num_rows, 4096)):
                na, nb = b.column("na").to_numpy(), b.column("nb").to_numpy()
                x, y = b.column("bitsa").to_pylist(), b.column("bitsb").to_pylist()
                words = np.minimum([len(m) for m in x], [len(m) for m in y]) // 8
                keep = np.zeros(b.num_rows, bool)
                for w in np.unique(words):
                    at = np.flatnonzero(words == w)
                    both = most_common(folded([x[i] for i in at], w), folded([y[i] for i in at], w), na[at], nb[at])
                    keep[at] = _links(na[at], nb[at], both, num, den)
                yield b.select(["a", "b", "equal"]).filter(pa.array(keep))

    return rows.mapInArrow(run, "a bigint, b bigint, equal boolean").groupBy("a", "b").agg(F.max("equal").alias("equal"))


def verify(pairs: DataFrame, signs: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that link: by bitmaps first, so that only texts of pairs that these leave are moved; then by the
    exact intersection of the sets of the texts in rows (id, t)."""
    pairs = written(plausible(pairs, signs, num, den), "plausible")
    sure, pairs = pairs.filter("equal").select("a", "b"), pairs.filter("not equal").select("a", "b")
    docs = only(docs, pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))))
    left, right = docs.alias("l"), docs.alias("r")
    rows = pairs.join(right, F.col("b") == F.col("r.id")).select("a", "b", F.col("r.t").alias("tb")).join(left, F.col("a") == F.col("l.id")).select("a", "b", F.col("l.t").alias("ta"), "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, 3, 1 << 20):
                heads = bytes_list(batch.column(2))
                distinct = list(dict.fromkeys(heads))
                known = dict(zip(distinct, shingle_sets(distinct, k)))
                good = []
                for i, (head, y) in enumerate(zip(heads, shingle_sets(bytes_list(batch.column(3)), k))):
                    x = known[head]
                    if len(x) and len(y):
                        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                        if _links(len(x), len(y), int((y[at] == x).sum()), num, den):
                            good.append(i)
                yield batch.select(["a", "b"]).take(pa.array(good, pa.int64()))
        release()

    return rows.mapInArrow(run, "a bigint, b bigint").union(sure)


def _links(a, b, both, num: int, den: int):
    return den * both >= num * (a + b - both)


def join_components(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, text: str = "text", doc_id: str = "doc_id", block: int = 1024, few: int = 200, block_bytes: int = 12 << 20) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of `docs`."""
    spark = docs.sparkSession
    prepare(spark)
    base = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("t"))
    if not replayable(base):
        base = written(base, "jaccard")
    rows = written(sketches(base, k, num, den, max(32, 2 * base.rdd.getNumPartitions()), block_bytes), "sketches")
    across = rows.filter("bucket is not null").select("bucket", "packed").groupBy("bucket").applyInArrow(_meet, "tile bigint, a bigint, b bigint")
    shared = written(rows.filter("tile is not null").select("tile", "a", "b").union(across), "shared")
    found = written(rows.filter("n is not null").select("id", "n", "s", "bits"), "sets")
    drop(spark, rows)
    signs = found.filter("bits is not null")
    pairs = written(shared.filter("a <> b").select("a", "b").distinct(), "pairs")
    edges = written(verify(pairs, signs, base, k, num, den), "links")
    roots, every = connected_components(edges), False
    members = shared.select("tile", "b").repartition("tile").distinct()  # one exchange serves the window below, too
    of_tile, spent = Window.partitionBy("tile"), [shared, pairs]
    while True:
        # tiles that still hold classes of more than one component; of those with the same classes, one
        known = roots.withColumnRenamed("node", "b")
        placed = members.join(F.broadcast(known) if known.count() <= 1_000_000 else known, "b", "left").select("tile", "b", F.coalesce("root", "b").alias("root"))
        figures = {"lo": F.min("root"), "hi": F.max("root"), "m": F.count("*"), "x": F.bit_xor(F.xxhash64("b")), "y": F.bit_xor(F.xxhash64("b", F.lit(1)))}
        mixed = written(placed.withColumns({c: f.over(of_tile) for c, f in figures.items()}).filter("lo <> hi and m > 2").drop("lo", "hi"), "mixed")
        one = mixed.groupBy("x", "y", "m").agg(F.min("tile").alias("tile")).select("tile")
        rest = written(mixed.join(one, "tile").drop("x", "y"), "open")
        drop(spark, mixed)
        open_rows, sure = rest.agg(F.count("*"), F.sum("m")).first()
        if not open_rows:
            break
        every = every or sure <= few * open_rows  # an open tile's size, on average over its rows
        left = written(_across(rest.join(signs.select(F.col("id").alias("b"), F.col("n").alias("size"), "bits"), "b"), open_rows, num, den, block, every), "left")
        more = written(left.filter("tile is null").select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti"), "more")
        # a tile whose pairs have all been compared is done; one that had more than were taken comes back
        again = left.filter("tile is not null").select("tile").distinct()
        members = written(rest.select("tile", "b").join(again, "tile", "left_semi"), "members")
        drop(spark, rest, left)
        new = written(verify(more, signs, base, k, num, den), "links")
        linked = not new.isEmpty()
        if linked:
            edges = written(edges.union(new), "links")
            roots = connected_components(edges)
        if members.isEmpty():  # all pairs across components have been compared
            break
        every, pairs = not linked, written(pairs.union(more), "pairs")
        spent += [members, pairs]
    drop(spark, *spent)
    classes = found.filter("s is not null").groupBy("s", "n").agg(F.min("id").alias("lo"), F.min(F.when(F.col("bits").isNotNull(), F.col("id"))).alias("node"))
    classes = classes.join(roots, "node", "left").select("s", "n", "lo", F.coalesce("root", "node").alias("root"))
    labels = classes.groupBy("root").agg(F.min("lo").alias("component_id"))
    own = classes.join(labels, "root").select("s", "n", "component_id")
    return found.drop("bits").join(own, ["s", "n"], "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))


def _across(rows: DataFrame, count: int, num: int, den: int, block: int, every: bool) -> DataFrame:
    """Pairs (a < b) of one tile but of different components that the bitmaps leave, from `count` rows (tile, b, root, m, size,
    bits): every one; or, unless `every`, for each class the likeliest only where a block has more than PAIRS pairs a class. The tiles of
    such blocks are rows, too.

    A tile of more than `block` classes is cut into blocks by hash, and each pair of blocks is apart; so many of these and of
    small tiles as have some thousands of rows together are one group, whatever the tiles' sizes.
    """
    cut = rows.withColumn("m", F.ceil(F.col("m") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("b"), F.col("m")).cast("int"))
    cut = cut.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).withColumns({"p": F.least("own", "q"), "q": F.greatest("own", "q")})
    cut = cut.withColumn("k", F.pmod(F.xxhash64("tile", "p", "q"), F.lit(1 + count // 32768)))

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        tile, p, q, own = (table[c].to_numpy() for c in ("tile", "p", "q", "own"))
        order = np.lexsort((own, q, p, tile))
        tile, p, q, own, ids, roots, size = (x[order] for x in (tile, p, q, own, table["b"].to_numpy(), table["root"].to_numpy(), table["size"].to_numpy()))
        maps = table["bits"].to_pylist()
        maps = [maps[i] for i in order]
        # rows of a part that is one block, or the first of two, are compared with those after them, in its second block if there is one
        at = np.flatnonzero(np.concatenate(([True], (tile[1:] != tile[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])))) if len(tile) else np.zeros(0, np.int64)
        ends = np.append(at[1:], len(tile))
        out, held, unfinished = [np.zeros((2, 0), np.int64)], 0, set()
        # the likeliest of a class in all of the group's tiles, by the place of its row in `of_row`
        classes, of_row = np.unique(ids, return_inverse=True)
        best, likeliest = np.full(len(classes), -1), np.zeros(len(classes), np.int64)
        for s, e in zip(at.tolist(), ends.tolist()):
            words = min(map(len, maps[s:e])) // 8
            bits = folded(maps[s:e], words)
            if p[s] == q[s]:
                left, first = np.arange(e - s - 1), np.arange(1, e - s)
            else:
                half = int(np.searchsorted(own[s:e], q[s]))
                left, first = np.arange(half), np.full(half, half)
            step = max(1, (1 << 21) // ((e - s) * words))
            taken, room = [], None if every else PAIRS * (e - s)
            for low in range(0, len(left), step):
                i, f = left[low : low + step], first[low : low + step]
                n = e - s - f
                i, j = np.repeat(i, n), np.repeat(f - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                apart = np.flatnonzero(roots[s + i] != roots[s + j])
                i, j = i[apart], j[apart]
                a, b = size[s + i], size[s + j]
                both = most_common(bits[i], bits[j], a, b)
                spare = den * both - num * (a + b - both)
                live = np.flatnonzero(spare >= 0)
                i, j, spare = i[live], j[live], spare[live]
                if room is None or room >= 0:
                    taken.append(np.stack((np.minimum(ids[s + i], ids[s + j]), np.maximum(ids[s + i], ids[s + j]))))
                    held += len(i)
                    if every:
                        if held > 1 << 20:  # a pair may share many tiles
                            out, taken = [np.unique(np.concatenate(out + taken, axis=1), axis=1)], []
                            held = 0
                        continue
                    room -= len(i)
                for x, y in ((i, j), (j, i)):
                    by = np.argsort(spare, kind="stable")
                    by = by[spare[by] > best[of_row[s + x[by]]]]
                    likeliest[of_row[s + x[by]]] = ids[s + y[by]]  # the last one assigned is the likeliest
                    best[of_row[s + x[by]]] = spare[by]
            if room is None or room >= 0:
                out += taken
            else:
                unfinished.add(int(tile[s]))
        if unfinished:
            x = np.flatnonzero(best >= 0)
            out.append(np.stack((np.minimum(classes[x], likeliest[x]), np.maximum(classes[x], likeliest[x]))))
        a, b = np.unique(np.concatenate(out, axis=1), axis=1)
        release()
        found, missing = pa.table([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], ["a", "b", "tile"]), pa.nulls(len(unfinished), pa.int64())
        return pa.concat_tables([found, pa.table([missing, missing, pa.array(sorted(unfinished), pa.int64())], ["a", "b", "tile"])])

    return cut.groupBy("k").applyInArrow(run, "a bigint, b bigint, tile bigint")


def digest(docs: DataFrame) -> DataFrame:
    """The columns that the query returns."""
    return join_components(docs)


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, text: str = "text", doc_id: str = "doc_id", block_bytes: int = 12 << 20) -> DataFrame:
    """The documents without those whose component has a smaller id: one of each group stays, and all without a set. Of rows
    that repeat the smallest id of a group, one stays: the one whose columns have the smallest hash, which is the same at every run."""
    found = written(join_components(docs, k, num, den, text, doc_id, block_bytes=block_bytes).filter("doc_id is not null and n_shingles > 0"), "components")
    gone = written(found.filter("component_id < doc_id").select(F.col("doc_id").alias(doc_id)).distinct(), "copies")
    left = docs.join(F.broadcast(gone) if gone.count() <= 1_000_000 else gone, doc_id, "left_anti").select(*docs.columns)
    again = written(found.filter("component_id = doc_id").groupBy(F.col("doc_id").alias(doc_id)).count().filter("count > 1").select(doc_id), "repeated")
    drop(docs.sparkSession, found)
    if again.isEmpty():
        return left
    columns = [F.col(f"`{c}`") for c in docs.columns]
    hashable = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    some = left.join(again, doc_id, "left_semi").select(*columns)
    first = some.groupBy(F.col(f"`{doc_id}`").alias("_of")).agg(F.min_by(F.struct(*columns), F.xxhash64(*hashable)).alias("_row")).select("_row.*")
    return left.join(again, doc_id, "left_anti").select(*docs.columns).unionByName(first)
