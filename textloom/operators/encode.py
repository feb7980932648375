"""Encoding texts with ONNX models inside Arrow UDFs.

One UDF returns all heads of a row in one struct, from one forward pass, so heads cannot misalign. A session is built once
a Python worker and kept for its model and settings.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays
from ..sources.tokenizer_files import load_tokenizer
from ..session import ship_active
from . import selfcheck
from .batching import BUDGET, parts, passes
from .layout import settled

#: Names that an embedding output may have, in order of precedence, when there are several outputs.
PRECEDENCE = ("text_embeds", "last_hidden_state", "sentence_embedding")
DEFAULT_BATCH, DEFAULT_LENGTH = 256, 512
#: A cap that no text reaches.
WHOLE = 1 << 40
KEPT = 4
_cache: dict[tuple, tuple] = {}


@dataclass(frozen=True)
class Encoder:
    """What to run and how to read it.

    model: a path, or the file's bytes. external: initialisers that live beside the model, as (name, bytes) or, with a path,
    files in its directory. head: dense, lexical, splade, joint, dual or rerank. attention_budget: bytes of attention scores that
    a pass may take (one row always may). pin: passes of a length have one number of rows, so that there is one shape for each
    length of the ladder; with fixed_shape, which pads all to max_length, there is one shape in all. pad_id: the tokenizer's own where
    it is not given. reference: the vector that
    check_text must have; a worker checks it before its first pass, and a task whose check fails has no rows. double: dense vectors are
    array<double>, as pooling and norm compute them, and not rounded to single precision.
    """

    model: str | bytes
    tokenizer: str
    head: str = "dense"
    pooling: str = "cls"
    normalize: bool = True
    inner_epsilon: bool = False
    output: str | None = None
    sparse_output: str | None = None
    max_length: int = DEFAULT_LENGTH
    batch_size: int = DEFAULT_BATCH
    pad_left: bool = False
    pad_id: int | None = None
    fixed_shape: bool = False
    pin: bool = False
    attention_budget: int = BUDGET
    quantization: str = "none"
    threads: int = 1
    providers: tuple[str, ...] = ("CPUExecutionProvider",)
    external: tuple[tuple[str, bytes], ...] = ()
    weight: tuple[float, ...] = ()
    bias: float = 0.0
    transformer: Callable | None = field(default=None, compare=False)
    reference: tuple[float, ...] = ()
    check_text: str = selfcheck.TEXT
    double: bool = False

    @property
    def kind(self) -> type:
        """The numbers of dense vectors."""
        return np.float64 if self.double else np.float32

    def __post_init__(self) -> None:
        if self.batch_size < 1:
            raise ValueError("batch_size is at least 1")
        if self.pooling not in arrays.POOLING:
            raise ValueError(f"unknown pooling {self.pooling!r}; known: {', '.join(sorted(arrays.POOLING))}")
        if self.head not in ("dense", "lexical", "splade", "joint", "dual", "rerank"):
            raise ValueError(f"unknown head {self.head!r}")
        if self.quantization not in ("none", "static", "dynamic"):
            raise ValueError(f"unknown quantization {self.quantization!r}")
        if self.reference and (self.head in ("lexical", "splade", "rerank") or self.transformer is not None):
            raise ValueError("only a dense vector can be held against a reference")


def check_providers(wanted: tuple[str, ...]) -> tuple[str, ...]:
    """The providers, or an error that says which are there; a named provider never falls back to another."""
    import onnxruntime as ort

    missing = [p for p in wanted if p not in ort.get_available_providers()]
    if missing:
        raise ValueError(f"not available: {', '.join(missing)}; this build has {', '.join(ort.get_available_providers())}")
    return wanted


@dataclass
class Loaded:
    """A session with its tokenizer (which neither cuts nor pads), the names of the inputs, and how texts are cut and padded."""

    session: object
    tokenizer: object
    inputs: set[str]
    limit: int
    pad_id: int
    special: int
    status: selfcheck.Status | None = None
    status_of: tuple[float, ...] | None = None


def session(e: Encoder) -> Loaded:
    """What this worker has loaded for the encoder."""
    import onnxruntime as ort

    digest = lambda x: x if isinstance(x, str) else hashlib.blake2b(x).digest()
    key = (digest(e.model), e.tokenizer, e.max_length, e.providers, e.threads, e.pad_left, e.pad_id, e.fixed_shape, tuple((n, digest(b)) for n, b in e.external), e.reference, e.check_text)
    if key in _cache:
        _cache[key] = _cache.pop(key)  # the last one used is the last to go
    else:
        while len(_cache) >= KEPT:
            _cache.pop(next(iter(_cache)))
        options = ort.SessionOptions()
        options.graph_optimization_level = ort.GraphOptimizationLevel.ORT_ENABLE_ALL
        options.intra_op_num_threads = e.threads  # tasks share the machine
        options.inter_op_num_threads = 1
        if e.external:
            options.add_external_initializers_from_files_in_memory([n for n, _ in e.external], [b for _, b in e.external], [len(b) for _, b in e.external])
        s = ort.InferenceSession(e.model, options, providers=list(check_providers(e.providers)))
        tok = load_tokenizer(e.tokenizer, e.max_length, e.pad_left)
        limit = min(e.max_length, (tok.truncation or {}).get("max_length", e.max_length))
        pad_id = (tok.padding or {}).get("pad_id", 0) if e.pad_id is None else e.pad_id
        tok.no_truncation()
        tok.no_padding()
        _cache[key] = Loaded(s, tok, {i.name for i in s.get_inputs()}, limit, pad_id, tok.num_special_tokens_to_add(False))
        if e.reference:
            status = checked(e)
            if not status.serving:
                _cache.pop(key, None)
                raise RuntimeError(f"the encoder does not give its reference vector: {status.error}, cosine {status.cosine}")
            _cache[key].status = status
    return _cache[key]


def checked(e: Encoder, reference: tuple[float, ...] | None = None) -> selfcheck.Status:
    """The self-check of the encoder in this worker."""
    wanted = e.reference if reference is None else reference
    return selfcheck.check(lambda text: encode_tokens(e, tokenise(e, [text]))[0]["dense"], np.array(wanted, np.float32) if wanted else None, text=e.check_text)


def statuses(e: Encoder):
    """A UDF from any column to the status of the worker's encoder, which is checked once a worker and does not fail there:
    struct<cosine, serving, verified, attempts, error>."""
    ship_active()

    @F.arrow_udf(f"struct<{selfcheck.SCHEMA}>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        status = None
        for batch in batches:
            if status is None:
                try:
                    loaded = session(replace(e, reference=()))
                    if loaded.status is None or loaded.status_of != e.reference:
                        loaded.status, loaded.status_of = checked(replace(e, reference=()), e.reference), e.reference
                    status = loaded.status
                except Exception as problem:  # a model that does not load is a status, too
                    status = selfcheck.Status(None, False, False, 0, str(problem))
            row = {"cosine": status.cosine, "serving": status.serving, "verified": status.verified, "attempts": status.attempts, "error": status.error}
            kind = pa.struct([("cosine", pa.float64()), ("serving", pa.bool_()), ("verified", pa.bool_()), ("attempts", pa.int32()), ("error", pa.string())])
            yield pa.array([row] * len(batch), kind)

    return run


@dataclass
class Tokens:
    """Texts as token ids, cut to their caps, with the number of tokens before the cut: None for a text that is refused."""

    ids: list[np.ndarray]
    kinds: list[np.ndarray]
    counts: list[int | None]

    def take(self, at: Sequence[int]) -> Tokens:
        return Tokens(*([x[i] for i in at] for x in (self.ids, self.kinds, self.counts)))


def _raw(tokenizer, texts: Sequence[str]) -> list:
    """Encodings without special tokens; None for a text that the tokenizer refuses."""
    try:
        return tokenizer.encode_batch(list(texts), add_special_tokens=False)
    except Exception:  # one of them is refused
        if len(texts) == 1:
            return [None]
        return [x for t in texts for x in _raw(tokenizer, [t])]


def tokenise(e: Encoder, texts: list[str], caps: list[int] | None = None, pairs: list[str] | None = None) -> Tokens:
    """One tokenisation for counts and input. caps: at most so many tokens of each text, below the encoder's own limit."""
    x = session(e)
    out = Tokens([], [], [])
    for start in range(0, len(texts), 256):
        part = texts[start : start + 256]
        x.tokenizer.no_truncation()
        whole = None
        raw = _raw(x.tokenizer, part)
        other = [None] * len(part) if pairs is None else _raw(x.tokenizer, pairs[start : start + 256])
        special = x.special if pairs is None else x.tokenizer.num_special_tokens_to_add(True)
        for i, (r, o) in enumerate(zip(raw, other)):
            if r is None or pairs is not None and o is None:
                out.ids.append(np.zeros(0, np.int64))
                out.kinds.append(out.ids[-1])
                out.counts.append(None)
                continue
            count = len(r) + special + (0 if o is None else len(o))
            cap = x.limit if caps is None else min(x.limit, caps[start + i])
            if count > cap:
                if whole != cap:
                    x.tokenizer.enable_truncation(cap)
                    whole = cap
                done = x.tokenizer.post_process(r, o)
            else:
                if whole is not None:
                    x.tokenizer.no_truncation()
                    whole = None
                done = r if not special and o is None else x.tokenizer.post_process(r, o)
            out.ids.append(np.array(done.ids, np.int64))
            out.kinds.append(np.array(done.type_ids, np.int64) if "token_type_ids" in x.inputs else out.ids[-1][:0])
            out.counts.append(count)
    x.tokenizer.no_truncation()
    return out


def select_output(outputs: dict[str, np.ndarray], name: str | None = None) -> np.ndarray:
    """The named output; else the only one; else the first that PRECEDENCE has."""
    if name is not None:
        if name not in outputs:
            raise ValueError(f"no output {name!r}; there are {', '.join(outputs)}")
        return outputs[name]
    if len(outputs) == 1:
        return next(iter(outputs.values()))
    for known in PRECEDENCE:
        if known in outputs:
            return outputs[known]
    raise ValueError(f"none of {', '.join(PRECEDENCE)} among {', '.join(outputs)}")


def select_by_fragment(outputs: dict[str, int], fragment: str, rank: int) -> str:
    """The output of this name; else the one whose name holds it; else the only one of the rank; never by position."""
    named = [fragment] if fragment in outputs else [n for n in outputs if fragment in n]
    if len(named) == 1:
        return named[0]
    ranked = [n for n, r in outputs.items() if r == rank]
    if not named and len(ranked) == 1:
        return ranked[0]
    raise ValueError(f"cannot tell which of {', '.join(outputs)} is the {fragment} output")


def forward(e: Encoder, tokens: Tokens, at: Sequence[int] | None = None, length: int | None = None, rows: int | None = None) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Outputs by name, ids and mask of one pass over the rows `at`, padded to `length` (the longest's where it is not given) and filled
    up to `rows` with the first one."""
    x = session(e)
    at = range(len(tokens.ids)) if at is None else at
    length = max((len(tokens.ids[i]) for i in at), default=0) if length is None else length
    n = len(at) if rows is None else rows
    ids, mask, kinds = np.full((n, length), x.pad_id, np.int64), np.zeros((n, length), np.int64), np.zeros((n, length), np.int64)
    for row, i in enumerate([*at, *[at[0]] * (n - len(at))]):
        own = tokens.ids[i]
        where = slice(length - len(own), length) if e.pad_left else slice(0, len(own))
        ids[row, where], mask[row, where] = own, 1
        if len(tokens.kinds[i]):
            kinds[row, where] = tokens.kinds[i]
    feed = {n: v for n, v in (("input_ids", ids), ("attention_mask", mask), ("token_type_ids", kinds)) if n in x.inputs}
    return dict(zip([o.name for o in x.session.get_outputs()], x.session.run(None, feed))), ids, mask


def dense(e: Encoder, outputs: dict[str, np.ndarray], mask: np.ndarray) -> np.ndarray:
    h = arrays.covers(select_output(outputs, e.output), len(mask), None)
    v = arrays.POOLING[e.pooling](h, mask)
    return (arrays.l2_normalize_inner if e.inner_epsilon else arrays.l2_normalize)(v, e.kind) if e.normalize else v.astype(e.kind)


def encode_rows(e: Encoder, texts: list[str], cap: int | None = None) -> Iterator[dict]:
    """A dict for each text, in order: dense, sparse, multi, as the head gives them."""
    yield from encode_tokens(e, tokenise(e, texts, None if cap is None else [cap] * len(texts)))


def encode_tokens(e: Encoder, tokens: Tokens, batch_size: int | None = None) -> list[dict]:
    """As encode_rows, of texts that are tokens already, in planned passes of at most `batch_size` rows (the encoder's own where it is
    not given), with the number of rows of its pass as `rows`; None for a refused text. A dynamically quantised model gets all in one
    pass. With `pin`, each pass is run until as many rows come back as went in."""
    known = [i for i, c in enumerate(tokens.counts) if c is not None]
    if len(known) < len(tokens.counts):
        found = [None] * len(tokens.counts)
        for i, row in zip(known, encode_tokens(e, tokens.take(known), batch_size)):
            found[i] = row
        return found
    n = len(tokens.ids)
    size = e.batch_size if batch_size is None else batch_size
    if e.quantization == "dynamic":
        if n > size:
            raise ValueError(f"a dynamically quantised model takes all rows in one batch; there are {n}, more than {size}")
        return encode_pass(e, tokens, range(n), None, n) if n else []
    lengths = [len(x) for x in tokens.ids]
    found: list = [None] * n
    for p in passes(lengths, session(e).limit, size, e.attention_budget, e.fixed_shape, e.pin):
        run = lambda p=p: encode_pass(e, tokens, p.at, p.length, p.rows)
        for i, row in zip(p.at, settled(run, len(p.at)) if e.pin else run()):
            found[i] = row
    return found


def encode_pass(e: Encoder, tokens: Tokens, at: Sequence[int], length: int | None, rows: int) -> list[dict]:
    """A dict for each row of one pass: dense, sparse, multi."""
    outputs, ids, mask = forward(e, tokens, at, length, rows)
    if rows > len(at):
        outputs, ids, mask = {k: v[: len(at)] if len(v) == rows else v for k, v in outputs.items()}, ids[: len(at)], mask[: len(at)]
    n, none = len(at), [None] * len(at)
    if e.transformer is not None:
        rows = [np.asarray(r, e.kind) for r in e.transformer(outputs, mask)]
        found = rows, none, none
    elif e.head == "dense":
        found = dense(e, outputs, mask), none, none
    elif e.head == "splade":
        logits = arrays.covers(arrays.check_rank(select_output(outputs, e.output), False), n, ids.shape[1])
        found = none, arrays.splade_head(logits, mask), none
    elif e.head == "lexical":
        h = outputs[select_by_fragment({k: v.ndim for k, v in outputs.items()}, e.sparse_output, 3)] if e.sparse_output else select_output(outputs, e.output)
        found = none, arrays.lexical_head(h, ids, mask, np.array(e.weight, np.float32), e.bias), none
    elif e.head == "dual":
        ranks = {k: v.ndim for k, v in outputs.items()}
        d = outputs[select_by_fragment(ranks, e.output or "dense", 2)]
        if d.ndim != 2 or len(d) < n:
            raise ValueError(f"the dense output's shape {d.shape} does not cover {n} rows")
        h = outputs[select_by_fragment(ranks, e.sparse_output or "hidden", 3)]
        found = arrays.l2_normalize(d[:n], e.kind), arrays.lexical_head(h, ids, mask, np.array(e.weight, np.float32), e.bias), none
    else:  # joint: dense as it comes, weights of tokens, vectors of tokens
        if len(outputs) < 3:
            raise ValueError(f"a joint model has three outputs, not {len(outputs)}")
        d, w, multi = list(outputs.values())[:3]
        w = w[..., 0] if w.ndim == 3 else w
        found = d[:n].astype(e.kind), [arrays.max_per_id(ids[i][: w.shape[1]], w[i], mask[i][: w.shape[1]]) for i in range(n)], arrays.multivector_keep(multi[:n], mask)
    if any(len(f) != n for f in found):
        raise ValueError(f"heads of {', '.join(str(len(f)) for f in found)} rows for {n} texts")
    return [{"dense": a, "sparse": b, "multi": c, "rows": rows} for a, b, c in zip(*found)]


ENCODING = "struct<dense: array<float>, sparse: struct<indices: array<bigint>, values: array<float>>, multi: array<array<float>>>"
REQUEST = "struct<n_tokens: array<int>, dense: array<array<float>>, sparse: array<struct<indices: array<bigint>, values: array<float>>>, multi: array<array<array<float>>>, pass_rows: array<int>>"


def _typed(schema: str, e: Encoder) -> str:
    """ENCODING or REQUEST with the encoder's kind of dense vectors."""
    return re.sub(r"(dense: (?:array<)+)float", r"\1double", schema) if e.double else schema


def _lists(rows: list, values: Callable[[list], pa.Array]) -> pa.ListArray:
    """A list column; `values` makes the child of all rows that are there. None is null."""
    there = [r for r in rows if r is not None]
    edges = np.cumsum([0, *(0 if r is None else len(r) for r in rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edges), values(there), mask=pa.array([r is None for r in rows], pa.bool_()))


def _numbers(rows: list, kind: str) -> pa.ListArray:
    return _lists(rows, lambda there: pa.array(np.concatenate(there).astype(kind) if there else np.zeros(0, kind)))


def _vectors(there: list[np.ndarray]) -> pa.ListArray:
    """The rows of all matrices as lists, without an object for each."""
    sizes = np.concatenate([np.full(len(m), m.shape[1] if m.ndim == 2 else 0, np.int32) for m in there]) if there else np.zeros(0, np.int32)
    flat = np.concatenate([np.asarray(m, np.float32).ravel() for m in there]) if there else np.zeros(0, np.float32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(flat))


def packed(found: list[dict | None], kind: type = np.float32) -> pa.StructArray:
    """Rows of encode_tokens as ENCODING, with this kind of dense vectors; a row that is None has null fields."""
    of = lambda name: [None if r is None else r[name] for r in found]
    sparse = [None if r is None or r["sparse"] is None else r["sparse"] for r in found]
    parts = [_numbers([None if s is None else s[k] for s in sparse], kind) for k, kind in ((0, "i8"), (1, "f4"))]
    pairs = pa.StructArray.from_arrays(parts, ["indices", "values"], mask=pa.array([s is None for s in sparse], pa.bool_()))
    multi = _lists(of("multi"), _vectors)
    return pa.StructArray.from_arrays([_numbers(of("dense"), np.dtype(kind).str), pairs, multi], ["dense", "sparse", "multi"])


def encoder(e: Encoder):
    """A UDF from text to ENCODING; a null text gives nulls."""
    ship_active()

    @F.arrow_udf(_typed(ENCODING, e))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for (texts,) in (part for batch in batches for part in parts(batch, whole=e.quantization == "dynamic")):
            found: list[dict | None] = [None] * len(texts)
            known = [(i, t) for i, t in enumerate(texts.to_pylist()) if t is not None]
            for (i, _), r in zip(known, encode_rows(e, [t for _, t in known])):
                found[i] = r
            yield packed(found, e.kind)

    return run


def planned(e: Encoder):
    """A UDF from text to its number of tokens before the cut, the length that it is padded to, and the rows of its pass."""
    ship_active()

    @F.arrow_udf("struct<n_tokens: int, length: bigint, rows: int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for (texts,) in (part for batch in batches for part in parts(batch)):
            known = [(i, t) for i, t in enumerate(texts.to_pylist()) if t is not None]
            tokens = tokenise(e, [t for _, t in known])
            there = [k for k, c in enumerate(tokens.counts) if c is not None]
            out: list[dict] = [{"n_tokens": None, "length": None, "rows": None} for _ in range(len(texts))]
            for p in passes([len(tokens.ids[k]) for k in there], session(e).limit, e.batch_size, e.attention_budget, e.fixed_shape, e.pin):
                for k in p.at:
                    out[known[there[k]][0]] = {"n_tokens": tokens.counts[there[k]], "length": p.length, "rows": p.rows}
            yield pa.array(out, pa.struct([("n_tokens", pa.int32()), ("length", pa.int64()), ("rows", pa.int32())]))

    return run


def capped_encoder(e: Encoder):
    """A UDF from text and the most tokens of it to ENCODING; texts with different caps share passes. Nulls give nulls."""
    ship_active()

    @F.arrow_udf(_typed(ENCODING, e))
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, caps in (part for batch in batches for part in parts(*batch, whole=e.quantization == "dynamic")):
            found: list[dict | None] = [None] * len(texts)
            known = [(i, t, c) for i, (t, c) in enumerate(zip(texts.to_pylist(), caps.to_pylist())) if t is not None and c is not None]
            for (i, _, _), r in zip(known, encode_tokens(e, tokenise(e, [t for _, t, _ in known], [c for _, _, c in known]))):
                found[i] = r
            yield packed(found, e.kind)

    return run


def request_encoder(e: Encoder):
    """A UDF from a request's texts, its cap and its largest batch to REQUEST: arrays in the order of the texts, from one tokenisation.

    Texts of the requests of a part share passes, where their largest batch is the same; a dynamically quantised model has one pass for each
    request. A null text has a null count and null vectors; a null array is an empty one."""
    ship_active()

    @F.arrow_udf(_typed(REQUEST, e))
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for requests, caps, sizes in (part for batch in batches for part in parts(*batch)):
            lists = [x or [] for x in requests.to_pylist()]
            edges = pa.array(np.cumsum([0, *map(len, lists)]).astype(np.int32))
            owner = [k for k, texts in enumerate(lists) for _ in texts]
            texts, caps, sizes = [t for x in lists for t in x], caps.to_pylist(), sizes.to_pylist()
            known = [i for i, t in enumerate(texts) if t is not None]
            tokens = tokenise(e, [texts[i] for i in known], [min(WHOLE, WHOLE if caps[owner[i]] is None else caps[owner[i]]) for i in known])
            together: dict[object, list[int]] = {}
            for place, i in enumerate(known):
                together.setdefault((owner[i] if e.quantization == "dynamic" else None, sizes[owner[i]] or e.batch_size), []).append(place)
            found: list[dict | None] = [None] * len(texts)
            counts: list[int | None] = [None] * len(texts)
            for (_, size), places in together.items():
                for place, r in zip(places, encode_tokens(e, tokens.take(places), size)):
                    found[known[place]], counts[known[place]] = r, tokens.counts[place]
            made = packed(found, e.kind)
            columns = [pa.array(counts, pa.int32()), *[made.field(k) for k in range(3)], pa.array([None if r is None else r["rows"] for r in found], pa.int32())]
            yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(edges, c) for c in columns], ["n_tokens", "dense", "sparse", "multi", "pass_rows"])

    return run


def encode(df: DataFrame, e: Encoder, text: str = "text", out: str = "encoding") -> DataFrame:
    """Adds the encoding of a text column.

    A dynamically quantised model's scales depend on the whole batch: its input is one batch in one task, and more rows
    than batch_size are an error before anything runs.
    """
    if e.quantization == "dynamic":
        n = df.limit(e.batch_size + 1).count()
        if n > e.batch_size:
            raise ValueError(f"a dynamically quantised model takes all rows in one batch; there are more than {e.batch_size}")
        return df.coalesce(1).withColumn(out, encoder(e)(F.col(text)))
    return df.withColumn(out, encoder(e)(F.col(text)))


def logits(e: Encoder, queries: list[str], documents: list[str], batch_size: int | None = None) -> list[float | None]:
    """The first logit of each pair; None for a pair that the tokenizer refuses."""
    tokens = tokenise(e, queries, None, documents)
    known = [i for i, c in enumerate(tokens.counts) if c is not None]
    own, out = tokens.take(known), [None] * len(queries)
    for p in passes([len(t) for t in own.ids], session(e).limit, batch_size or e.batch_size, e.attention_budget, e.fixed_shape, e.pin):
        outputs, _, _ = forward(e, own, p.at, p.length, p.rows)
        if "logits" not in outputs:
            raise ValueError(f"a reranker has an output named logits; there are {', '.join(outputs)}")
        for i, x in zip(p.at, outputs["logits"].reshape(p.rows, -1)[:, 0]):
            out[known[i]] = float(x)
    return out


def scorer(e: Encoder):
    """A UDF from query and document to the first logit; null if either is null."""
    ship_active()

    @F.arrow_udf("float")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for queries, documents in (part for batch in batches for part in parts(*batch)):
            out: list[float | None] = [None] * len(queries)
            both = [(i, q, d) for i, (q, d) in enumerate(zip(queries.to_pylist(), documents.to_pylist())) if q is not None and d is not None]
            for (i, _, _), x in zip(both, logits(e, [q for _, q, _ in both], [d for _, _, d in both])):
                out[i] = x
            yield pa.array(out, pa.float32())

    return run


def request_scorer(e: Encoder):
    """A UDF from a request's query, documents and largest batch to the first logits, in the order of the documents; null where the query
    or the document is null. A null array is an empty one."""
    ship_active()

    @F.arrow_udf("array<float>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for queries, documents, sizes in (part for batch in batches for part in parts(*batch)):
            queries, lists, sizes = queries.to_pylist(), [x or [] for x in documents.to_pylist()], sizes.to_pylist()
            out: list[list[float | None]] = [[None] * len(x) for x in lists]
            together: dict[int, list[tuple[int, int]]] = {}
            for k, own in enumerate(lists):
                for i, d in enumerate(own):
                    if d is not None and queries[k] is not None:
                        together.setdefault(sizes[k] or e.batch_size, []).append((k, i))
            for size, pairs in together.items():
                for (k, i), x in zip(pairs, logits(e, [queries[k] for k, _ in pairs], [lists[k][i] for k, i in pairs], size)):
                    out[k][i] = x
            yield pa.array(out, pa.list_(pa.float32()))

    return run


def raw_outputs(df: DataFrame, e: Encoder, transform: Callable[[dict[str, np.ndarray], np.ndarray], list[np.ndarray]], text: str = "text", out: str = "values") -> DataFrame:
    """Adds what a function of all outputs and the mask gives for each row of a batch."""
    made = encoder(replace(e, transformer=transform))
    return df.withColumn(out, made(F.col(text))["dense"])


def dimension_of(vector: Column) -> Column:
    """An aggregate: the length of a vector that was measured; null, never 0, without rows."""
    return F.max(F.when(vector.isNotNull(), F.size(vector)))


def dimension(encoded: DataFrame, vector: str) -> int | None:
    """The same as a number."""
    return encoded.agg(dimension_of(F.col(vector))).first()[0]
