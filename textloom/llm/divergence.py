"""How far the sources of a language are from each other and from the language, by the shares of its terms; exact integers only.

Terms are runs of letters A-Z, in lower case, and of all characters beyond ASCII. A language keeps the V terms that are in at
least `min_docs` of its documents. A group (language and source) or a language with N kept terms in all gives a term that it has
c times the share p = 1 + floor(10^9 (c + 1) / (N + V)); p against q is floor((p - q)^2 / q).

Counting: each task counts what it reads by language, source and term, and hands on its counts when it holds FLUSH of them. The
counts are added before and after one shuffle; the rest works on them, not on texts.

Meeting: a language's terms are dealt by hash to slices of about SLICE terms, its sources to blocks of about the square root
of their number (BLOCK at least). What a block knows of a slice, its sources' counts, is one compressed row. Rows of a language
and slice play a round-robin tournament (the circle method): block i meets block j in round r where i + j = 2 r modulo the rounds. Each block
stays in the partition that it was dealt to (persisted there); one of two that meet, in turn the lower and the higher, travels as
its compressed row. A meeting gives both directions of all pairs of its sources. Sources of one block meet at home, where
the language's own counts come by, too, and a heap a source keeps its best terms. WAVE rounds travel in one job, so that a
task has WAVE rows besides its own, and the shuffle holds WAVE / 2 copies of the rows at most. Pairs are added over slices at the end.

Bounds: a row has the counts of one block in one slice, the driver the number of rounds. Frequent terms, languages and sources
are split by slices and blocks and have been added up before they are shuffled. The number of pairs in the result is quadratic in a
language's sources, as asked for. Tables between steps are in the shared folder; a lost executor costs its tasks.

Defined cases: null texts, languages and sources are empty ones, which are groups like others. Rows are documents each, also
where they repeat. Groups without terms have c = 0 and N = 0; a language without kept terms has pairs of value 0 and no terms. Equal
values rank by the item's UTF-8 bytes. Texts of any length are counted in pieces that end between terms. An empty table gives
no rows. Other columns are not read. Totals (N + V) stay below 9 * 10^15.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from . import common

#: Terms of a slice, about; sources of a block, at least; rounds of a job.
SLICE, BLOCK, WAVE = 2048, 8, 8
#: Counts that a task holds, and bytes of text that it splits at once.
FLUSH, PIECE = 400_000, 1 << 22
UNIT = 1_000  # shares have three times three digits
FOUND = "lang string, source string, part string, item string, value bigint"
#: Bytes of terms in lower case, all others as spaces.
_LETTERS = bytes(b if b > 0x7F or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def terms_of(text: bytes, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in order, a list for each piece of it."""
    spaced, start = text.translate(_LETTERS), 0
    while start < len(spaced):
        end = spaced.find(b" ", start + piece)
        end = len(spaced) if end < 0 else end
        yield spaced[start:end].split()
        start = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple[str, str], Counter] = {}
    docs: dict[tuple[str, str], Counter] = {}
    held = 0

    def flushed() -> Iterator[pa.RecordBatch]:
        for (lang, source), own in counts.items():
            terms = list(own)
            columns = [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(own.values(), pa.int64()), pa.array([docs[lang, source][t] for t in terms], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), common.bytes_list(batch.column(2))):
            own = counts.setdefault((lang, source), Counter())
            before, seen = len(own), set()
            for terms in terms_of(text):
                own.update(terms)
                seen.update(terms)
            docs.setdefault((lang, source), Counter()).update(seen)
            held += len(own) - before
            if held >= FLUSH:
                yield from flushed()
                counts, docs, held = {}, {}, 0
    yield from flushed()


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, term, n (how often it occurs in the group), docs (in how many of its documents)."""
    common.prepare(docs.sparkSession)
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (lang, source, text)])
    found = rows.mapInArrow(_count, "lang string, source string, term string, n bigint, docs bigint")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(counts: np.ndarray, totals: np.ndarray, v: int) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / (total + v)), three digits at a time, so that nothing overflows."""
    base = np.asarray(totals, np.int64)[..., None] + v
    rest, out = counts + 1, np.zeros_like(counts)
    for _ in range(3):
        rest = rest * UNIT
        out = out * UNIT + rest // base
        rest = rest % base
    return out + 1


def against(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def pack(sources: list[str], totals: list[int], owner: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> bytes:
    """A compressed row: each source with its total and, by term id, its counts; owner: the place of each count's source."""
    order = np.lexsort((ids, owner))
    edges = pa.array(np.searchsorted(owner[order], np.arange(len(sources) + 1)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(edges, pa.array(x[order])) for x in (ids.astype(np.int32), counts.astype(np.int64))]
    batch = pa.RecordBatch.from_arrays([pa.array(sources, pa.string()), pa.array(totals, pa.int64()), *lists], ["source", "total", "ids", "counts"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return zstandard.compress(sink.getvalue(), 3)


def unpack(body: bytes, terms: int, v: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Sources, their counts (sources x terms of the slice) and shares."""
    table = pa.ipc.open_stream(zstandard.decompress(body)).read_all().combine_chunks()
    sources, ids, counts = table.column("source").to_pylist(), table.column("ids").chunk(0), table.column("counts").chunk(0)
    dense = np.zeros((len(sources), terms), np.int64)
    dense[np.repeat(np.arange(len(sources)), np.diff(ids.offsets.to_numpy())), ids.flatten().to_numpy()] = counts.flatten().to_numpy()
    return sources, dense, shares(dense, table.column("total").to_numpy(), v)


def _pack_group(members: pa.Table, kept: pa.Table) -> pa.Table:
    """One row of lang, slice, block, blocks, terms, v, body."""
    first = members.slice(0, 1).to_pylist()[0]
    order = sorted(range(members.num_rows), key=members.column("source").to_pylist().__getitem__)
    members = members.take(pa.array(order, pa.int64()))
    sources = members.column("source").to_pylist()
    place = {s: i for i, s in enumerate(sources)}
    owner = np.array([place[s] for s in kept.column("source").to_pylist()], np.int64)
    body = pack(sources, members.column("total").to_pylist(), owner, kept.column("id").to_numpy(), kept.column("n").to_numpy())
    return pa.table({"lang": pa.array([first["lang"]], pa.string()), "slice": pa.array([first["slice"]], pa.int64()), "block": pa.array([first["block"]], pa.int64()), "blocks": pa.array([first["blocks"]], pa.int64()), "v": pa.array([first["v"]], pa.int64()), "body": pa.array([body], pa.binary())})


def _pack_terms(rows: pa.Table) -> pa.Table:
    """One row of lang, slice, terms and counts in order of id."""
    rows = rows.sort_by("id")
    one = lambda c, kind: pa.array([rows.column(c).to_pylist()], pa.list_(kind))
    return pa.table({"lang": rows.column("lang").slice(0, 1), "slice": rows.column("slice").slice(0, 1), "terms": one("term", pa.string()), "counts": one("n", pa.int64())})


def rounds_of(blocks: int) -> int:
    return 0 if blocks < 2 else blocks - 1 + blocks % 2


def opponent(block: Column, turn: Column, blocks: Column) -> Column:
    """Whom a block meets in a round; `blocks` or more where it rests."""
    last = blocks - 1 + blocks % 2
    other = F.pmod(2 * turn - block, last)
    return F.when(block == last, turn).when(other == block, last).otherwise(other)


def _found(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 4 + [pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], ["lang", "source", "part", "item", "value"])


def _at_home(best: int):
    """Pairs within a block, and each source's best terms against the language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                terms, v = r["terms"] or [], r["v"]
                sources, dense, p = unpack(r["body"], len(terms), v)
                rows = []
                for i, source in enumerate(sources):
                    values = against(p[i], p).sum(axis=1)
                    rows += [(r["lang"], source, "pair", other, int(x)) for other, x in zip(sources, values) if other != source]
                if terms:
                    q = shares(np.array(r["counts"], np.int64), np.int64(r["lang_total"]), v)
                    for i, source in enumerate(sources):
                        at = np.flatnonzero((dense[i] > 0) & (p[i] > q))
                        heap = heapq.nsmallest(best, zip((-against(p[i][at], q[at])).tolist(), at.tolist()))  # ids are in order of the terms
                        rows += [(r["lang"], source, "term", terms[t], -x) for x, t in heap]
                yield _found(rows)

    return run


def _meet(resident: pa.Table, visitors: pa.Table) -> pa.Table:
    """Both directions of all pairs of a block's sources with those of its visitors."""
    rows = []
    if visitors.num_rows:
        if resident.num_rows != 1:
            raise RuntimeError("a block has one row; the documents changed between two passes, write them as a table first")
        home = resident.to_pylist()[0]
        mine, _, p = unpack(home["body"], home["terms"], home["v"])
        for body in visitors.column("body").to_pylist():
            theirs, _, q = unpack(body, home["terms"], home["v"])
            for i, source in enumerate(mine):
                there, back = against(p[i], q).sum(axis=1).tolist(), against(q, p[i]).sum(axis=1).tolist()
                rows += [(home["lang"], source, "pair", other, x) for other, x in zip(theirs, there)]
                rows += [(home["lang"], other, "pair", source, x) for other, x in zip(theirs, back)]
    return pa.Table.from_batches([_found(rows)])


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = 3, best: int = 200, slice_terms: int = SLICE, block_sources: int = BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank: part `pair`, how far the source is from each other source of the language; part `term`, the
    `best` terms that it has more of than the language."""
    counted = common.written(term_counts(docs, lang, source, text), "term-counts")
    groups = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source")).distinct()
    vocabulary = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")).filter(F.col("docs") >= min_docs).drop("docs")
    vocabulary = common.written(vocabulary, "vocabulary")
    sizes = vocabulary.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_total"))
    langs = groups.groupBy("lang").agg(F.count("*").alias("s")).join(sizes, "lang", "left").fillna(0, ["v", "lang_total"])
    langs = langs.withColumn("slices", F.greatest(F.lit(1), F.ceil(F.col("v") / slice_terms))).withColumn("blocks", F.ceil(F.col("s") / F.greatest(F.lit(block_sources), F.ceil(F.sqrt("s")))))
    langs = common.written(langs.drop("s"), "langs")
    dealt = vocabulary.join(langs.select("lang", "slices", "blocks"), "lang").withColumn("slice", F.pmod(F.xxhash64("term"), F.col("slices")))
    by_id = Window.partitionBy("lang", "slice").orderBy("term")
    dealt = common.written(dealt.select("lang", "slice", "blocks", "term", "n", (F.row_number().over(by_id) - 1).alias("id")), "slices")

    block = F.pmod(F.xxhash64("source"), F.col("blocks")).alias("block")
    kept = counted.select("lang", "source", "term", "n").join(dealt.drop("n"), ["lang", "term"]).select("lang", "slice", block, "source", "id", "n")
    kept = common.written(kept, "kept-counts")
    members = groups.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").fillna(0, ["total"]).join(langs, "lang")
    members = members.select("lang", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), block, "blocks", "v", "source", "total")
    keys = ["lang", "slice", "block"]
    packed = members.groupBy(keys).cogroup(kept.groupBy(keys)).applyInArrow(_pack_group, "lang string, slice bigint, block bigint, blocks bigint, v bigint, body binary")
    slices = dealt.groupBy("lang", "slice").applyInArrow(_pack_terms, "lang string, slice bigint, terms array<string>, counts array<bigint>")
    slices = common.written(slices.join(langs.select("lang", "lang_total"), "lang"), "slice-terms")
    packed = packed.join(slices.select("lang", "slice", F.size("terms").alias("terms")), ["lang", "slice"], "left").fillna(0, ["terms"])
    packed = common.written(packed, "blocks")

    home = packed.drop("terms").join(slices, ["lang", "slice"], "left").select("lang", "v", "body", "terms", "counts", "lang_total")
    found = [common.written(home.mapInArrow(_at_home(best), FOUND), "home")]
    turns = rounds_of(packed.agg(F.max("blocks")).first()[0] or 0)
    resident = packed.filter("blocks > 1").repartition(*keys).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for start in range(0, turns, WAVE):
            own = F.col("blocks") - 1 + F.col("blocks") % 2
            travel = packed.filter((F.col("blocks") > 1) & (own > start)).select("lang", "slice", "block", "blocks", "body", F.explode(F.sequence(F.lit(start).cast("bigint"), F.least(own, F.lit(start + WAVE)) - 1)).alias("turn"))
            travel = travel.withColumn("host", opponent(F.col("block"), F.col("turn"), F.col("blocks")))
            goes = (F.col("host") < F.col("blocks")) & ((F.col("block") < F.col("host")) == ((F.col("block") + F.col("host")) % 2 == 0))
            travel = travel.filter(goes).select("lang", "slice", "host", "body")
            met = resident.groupBy(keys).cogroup(travel.groupBy("lang", "slice", "host")).applyInArrow(_meet, FOUND)
            found.append(common.written(met.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")), "meetings"))
    finally:
        resident.unpersist()
    rows = found[0]
    for more in found[1:]:
        rows = rows.union(more)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = rows.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    terms = found[0].filter("part = 'term'")
    return pairs.withColumn("rank", F.row_number().over(order)).union(terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best))
