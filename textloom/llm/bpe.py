"""BPE encoding and decoding with a given tokenizer file, through a table of distinct words.

Documents are split into chunks at ASCII white space, which this kind of tokenizer drops: no token crosses it, so a text's
ids are its chunks' ids in order. Equal chunks recur within and across documents, so each distinct one is encoded once:

1. every block (a run of whole documents of about `block_bytes` within one task) gives its distinct chunks, sorted, in
   one compressed row for each of `buckets` hash buckets;
2. a bucket's rows of all blocks meet in one task, which encodes each distinct chunk once and gives the ids back to each
   block in the order of the block's chunks;
3. the distinct ids of each block are joined with the id-to-piece table, whose size is the tokenizer's vocabulary;
4. the blocks' documents, compressed, meet their ids and pieces and join them by position: the k-th chunk of a document takes
   its ids, and each id its piece.

An id that the table lacks has no piece and is an error there. `decode` is the same join for arrays of ids of any origin, position by
position.

However often a chunk occurs, it is one entry a block; a bucket holds 1/`buckets` of the entries, and the number of
buckets grows with the input, so what one task holds does not. Documents and dictionaries are two passes over the input,
so an input that is not a plain scan is written as a table first; a lost task is then made again from the same rows.

Defined cases: null and empty texts have no tokens; repeated rows are each encoded; special-token strings in a text are
encoded as the tokenizer does by default; extra columns come back unchanged if named in `keep`.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import block_bodies, block_tables, body_table, column_bytes, in_blocks, prepare, release, replayable, written

SPACES = "[\x20\x09-\x0d]"
#: Stands for a bucket in rows that hold a block's pieces.
PIECES = -1


@lru_cache(2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """The id-to-piece table: id, piece; as large as the vocabulary."""
    return spark.createDataFrame(list(enumerate(p.decode() for p in _encoder(path).pieces())), "id int, piece string")


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def check_tokenizer(spec: dict) -> None:
    """Whether chunks at white space may be encoded apart from each other; raises ValueError if not."""
    parts = lambda x: [x] if x and "pretokenizers" not in x and "normalizers" not in x else (x or {}).get("pretokenizers") or (x or {}).get("normalizers") or []
    split = [p for p in parts(spec.get("pre_tokenizer")) if p["type"] == "Split"]
    if not split or split[0]["behavior"] != "Removed" or not split[0]["invert"] or re.search(r"\\s\+|\\s\*| \?", re.sub(r"\[\^[^]]*\]", "", split[0]["pattern"]["Regex"])):
        raise ValueError("the tokenizer keeps white space; chunks cannot be encoded apart")
    if spec.get("decoder"):
        raise ValueError("the tokenizer has a decoder step; pieces cannot be joined by position")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(SPACES, t["content"]) for t in spec.get("added_tokens", [])):
        raise ValueError("an added token takes in white space; chunks cannot be encoded apart")


class Encoder:
    """Encodes distinct chunks; one to a Python worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()

    def ids(self, chunks: list[str]) -> list[bytes]:
        encode = getattr(self.tok, "encode_batch_fast", self.tok.encode_batch)  # without offsets, where there is such
        found = [e.ids for e in encode(chunks, add_special_tokens=False)]
        flat, out, at = array("I", chain.from_iterable(found)).tobytes(), [], 0
        for f in found:
            out.append(flat[at : at + 4 * len(f)])
            at += 4 * len(f)
        return out

    def pieces(self) -> list[bytes]:
        """The id-to-piece table. The tokenizer has no decoder step: decode() puts one space between pieces."""
        return [(self.tok.id_to_token(i) or "").encode() for i in range(self.tok.get_vocab_size(with_added_tokens=True))]


def _by_bucket(texts: list[bytes], buckets: int) -> list[list[bytes]]:
    """The distinct chunks, sorted, by bucket: the same for the same texts in whichever process."""
    out: list[list[bytes]] = [[] for _ in range(buckets)]
    for w in sorted(set().union(*map(bytes.split, texts))):
        out[zlib.crc32(w) % buckets].append(w)
    return out


def _dictionaries(kept: int, block_bytes: int, buckets: int) -> Callable:
    blocks = block_tables(kept, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, table in blocks(batches):
            found = [(k, zstandard.compress(b"\n".join(ws), 3)) for k, ws in enumerate(_by_bucket(column_bytes(table, kept), buckets)) if ws]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([block] * len(found), pa.int64()), pa.array([z for _, z in found], pa.binary())], ["bucket", "block", "chunks"])

    return run


def _encode(path: str) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        release()
        lists = [zstandard.decompress(z).decode().split("\n") for z in table.column("chunks").to_pylist()]
        distinct = sorted(set().union(*lists))
        ids = dict(zip(distinct, _encoder(path).ids(distinct)))
        out, own = [], []
        for words in lists:
            found = [ids[w] for w in words]
            raw = b"".join(found)
            own.append(np.unique(np.frombuffer(raw, "<i4")))
            out.append(zstandard.compress(np.array([len(f) // 4 for f in found], dtype="<u4").tobytes() + raw, 3))
        return pa.table([table.column("bucket"), table.column("block"), pa.array([len(w) for w in lists], pa.int32()), pa.array(out, pa.binary()), pa.array(own, pa.list_(pa.int32()))], ["bucket", "block", "n", "ids", "own"])

    return run


def _assemble(kept: int, buckets: int, with_ids: bool, with_text: bool) -> Callable:
    def run(bodies: pa.Table, told: pa.Table) -> pa.Table:
        release()
        table = body_table(bodies)
        texts = column_bytes(table, kept)
        packed = {r["bucket"]: r for r in told.select(["bucket", "n", "ids"]).to_pylist()}
        of_pieces = told.filter(pc.equal(told.column("bucket"), PIECES))
        pieces = dict(zip(*([x for c in of_pieces.column(name).to_pylist() for x in c] for name in ("own", "pieces")))) if of_pieces.num_rows else {}
        pieces, ids_of, text_of = {i: p.encode() for i, p in pieces.items()}, {}, {}
        for k, words in enumerate(_by_bucket(texts, buckets)):
            if not words:
                continue
            if k not in packed or packed[k]["n"] != len(words):
                raise RuntimeError("the documents changed between two passes; write them as a table first")
            flat = np.frombuffer(zstandard.decompress(packed[k]["ids"]), dtype="<u4")
            ends, names = np.cumsum(flat[: len(words)]).tolist(), [pieces[i] for i in flat[len(words) :].tolist()]
            raw, start = flat[len(words) :].tobytes(), 0
            for w, end in zip(words, ends):
                ids_of[w], text_of[w], start = raw[4 * start : 4 * end], b" ".join(names[start:end]), end
        silent = b"" in text_of.values()  # chunks without tokens
        counts, digests, decoded_digests, all_ids, all_texts = [], [], [], [], []
        for t in texts:
            chunks = t.split()
            ids = b"".join(map(ids_of.__getitem__, chunks))
            decoded = b" ".join(filter(None, map(text_of.__getitem__, chunks)) if silent else map(text_of.__getitem__, chunks))
            counts.append(len(ids) // 4)
            digests.append(hashlib.sha256(ids).hexdigest())
            decoded_digests.append(hashlib.sha256(decoded).hexdigest())
            if with_ids:
                all_ids.append(ids)
            if with_text:
                all_texts.append(decoded)
        out = {"n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(digests, pa.string()), "decoded_sha256": pa.array(decoded_digests, pa.string())}
        if with_ids:
            out["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(np.frombuffer(b"".join(all_ids), "<i4")))
        if with_text:
            out["decoded"] = pa.array(all_texts, pa.binary()).cast(pa.string())
        return pa.table([*table.columns[:kept], *out.values()], [*table.column_names[:kept], *out])

    return run


def encode(docs: DataFrame, tokenizer: str | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), block_bytes: int = 12 << 20, ids: bool = False, decoded: bool = False) -> DataFrame:
    """`keep` columns, n_tokens, ids_sha256 and decoded_sha256; on demand, ids (array of int) and the decoded text too."""
    prepare(docs.sparkSession)
    path = tokenizer or tokenizer_file()
    with open(path, encoding="utf-8") as f:
        check_tokenizer(json.load(f))
    base = docs.select(*keep, F.col(text).alias("_text"))
    if not replayable(base):
        base = written(base, "encode")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.select(*keep).schema)
    buckets = max(32, 2 * base.rdd.getNumPartitions())
    sent = base.mapInArrow(_dictionaries(len(keep), block_bytes, buckets), "bucket int, block bigint, chunks binary")
    found = written(sent.groupBy("bucket").applyInArrow(_encode(path), "bucket int, block bigint, n int, ids binary, own array<int>"), "chunk-ids")
    own = found.groupBy("block").agg(F.array_distinct(F.flatten(F.collect_list("own"))).alias("own")).select("block", F.explode("own").alias("id"))
    named = own.join(F.broadcast(piece_table(docs.sparkSession, path)), "id")  # of the vocabulary's size
    rows = F.collect_list(F.struct("id", "piece"))
    pieces = named.groupBy("block").agg(rows.alias("p")).select(F.lit(PIECES).alias("bucket"), "block", F.lit(0).alias("n"), F.lit(b"").alias("ids"), F.col("p.id").alias("own"), F.col("p.piece").alias("pieces"))
    told = found.withColumns({"own": F.lit(None).cast("array<int>"), "pieces": F.lit(None).cast("array<string>")}).union(pieces)
    bodies = block_bodies(base, len(keep), block_bytes)
    more = ", ids array<int>" * ids + ", decoded string" * decoded
    return in_blocks(bodies, told, buckets).applyInArrow(_assemble(len(keep), buckets, ids, decoded), f"{fields}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{more}")


def digest(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The columns that the query returns."""
    return encode(docs, tokenizer)


def decode(df: DataFrame, tokenizer: str | None = None, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds `out`, the decoded text of an array of ids, by a join of each position with the id-to-piece table. Null and empty
    arrays give an empty text; ids that the table lacks give nothing. Equal arrays are decoded once. Other columns, whatever their names,
    stay; one that has the name `out` is replaced."""
    key = lambda c: F.sha2(F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit(""))), ","), 256)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.coalesce(F.col(f"`{ids}`"), F.array().cast("array<int>")).alias("ids")).withColumn("key", key(F.col("ids")))
    each = rows.select("key", "ids").dropDuplicates(["key"]).select("key", F.posexplode("ids").alias("pos", "id"))
    named = each.join(F.broadcast(piece_table(df.sparkSession, tokenizer or tokenizer_file())), "id")
    texts = named.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), " ").alias("text"))
    text = F.coalesce("text", F.lit("")).alias(out)
    return rows.join(texts, "key", "left").select(*[F.col(f"row.`{c}`").alias(c) for c in df.columns if c != out], text)
