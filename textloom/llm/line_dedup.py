"""Lines that many documents share go, except in the last document that holds them; DataFrame functions only.

A line's key is the line without white space (tab, line feed, vertical tab, form feed, carriage return, space) at its ends and
with A-Z in lower case. Keys of at least `min_chars` code points that occur in at least `min_docs` documents lose their lines
in all documents but the one of the largest id.

Texts are read once for keys: each line that is long enough is a row of two 64-bit hashes of its key (128 bits in all; two of
10^12 different keys agree with a probability of about 10^-15), document and position, written as a table. The table is
range-partitioned by hash and sorted within by hash, document and position, so a key's lines are one stream, in which the
first line of each document is marked, documents are counted and the first document, the one of the largest id, is told from
the others. What comes back is a keep bitmap a document, as lengths of runs (`keep_bitmaps`), and no text; `apply` and `digest`
join it with the texts.

Frequent keys never meet in one task. A histogram of at most BUCKETS buckets of hashes, pre-aggregated in each task, is the only
thing the driver sees; of buckets with more than 8 times their share, the keys with more than 4 times a bucket's share are hot.
There are BUCKETS / 4 of these at most, so they are broadcast with their number of documents and largest id, and their lines
are decided where they are. All other keys hold less than 8 / buckets of all lines each.

Defined cases: a null or empty text is one empty line. Rows that repeat an id are parts of one document: they count once, and
all of them keep a key whose largest id is theirs; each row gets its own bitmap. A row without an id counts for no key and
keeps all its lines. All occurrences of a key in the document that keeps it stay. A text whose lines all go becomes empty. Ids
may be of any type with an order. An empty table gives no rows. Extra columns are kept by `apply`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Buckets of the histogram at most.
BUCKETS = 65536
WHITE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(line: Column) -> Column:
    """A-Z in lower case, nothing else; lines of ASCII only take the short way."""
    return F.when(F.char_length(line) == F.octet_length(line), F.lower(line)).otherwise(F.translate(line, _UPPER, _LOWER))


def _text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def hashed_lines(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """h1, h2, id, part, pos: a row for each line with a key of at least `min_chars` code points; part tells rows of one id apart."""
    rows = docs.select(F.col(doc_id).alias("id"), _text(F.col(text)).alias("text")).filter("id is not null")
    lines = rows.select("id", F.xxhash64("text").alias("part"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    bare = lines.select("id", "part", "pos", F.btrim("line", F.lit(WHITE)).alias("bare")).filter(F.char_length("bare") >= min_chars)
    keyed = bare.select("id", "part", "pos", lowered(F.col("bare")).alias("key"))
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "id", "part", "pos")


def hot_keys(lines: DataFrame, buckets: int) -> DataFrame | None:
    """h1, h2, n_docs, last: keys with over 4 / buckets of all lines, buckets / 4 of them at most; None where no bucket is full enough."""
    bucket = F.pmod("h1", F.lit(buckets))
    counts = {r.b: r["count"] for r in lines.groupBy(bucket.alias("b")).count().collect()}
    total = sum(counts.values())
    full = [b for b, n in counts.items() if n * buckets > 8 * total]
    if not full:
        return None
    found = lines.filter(bucket.isin(full)).groupBy("h1", "h2").agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_docs"), F.max("id").alias("last"))
    return found.filter(F.col("n") * buckets > 4 * total).select("h1", "h2", "n_docs", "last")


def dropped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """id, part, gone: the positions of lines that go, ascending, for each row of documents that has any."""
    if min_docs < 2 or min_chars < 1:
        raise ValueError("a line that goes is in two documents at least and has a character at least")
    spark = docs.sparkSession
    lines = written(hashed_lines(docs, doc_id, text, min_chars), "lines")
    hot = hot_keys(lines, min(BUCKETS, 16 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rest, gone = lines, None
    if hot is not None:
        hot = F.broadcast(written(hot, "hot-lines"))
        gone = lines.join(hot, ["h1", "h2"]).filter((F.col("n_docs") >= min_docs) & (F.col("id") < F.col("last"))).select("id", "part", "pos")
        rest = lines.join(hot, ["h1", "h2"], "left_anti")
    stream = Window.partitionBy("h1", "h2").orderBy(F.desc("id"))
    whole = stream.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    dealt = rest.repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", F.desc("id"), "pos")
    marked = dealt.withColumn("first", F.coalesce(F.lag("id").over(stream) != F.col("id"), F.lit(True)))
    judged = marked.select("id", "part", "pos", F.sum(F.col("first").cast("int")).over(whole).alias("n_docs"), F.first("id").over(whole).alias("last"))
    found = judged.filter((F.col("n_docs") >= min_docs) & (F.col("id") < F.col("last"))).select("id", "part", "pos")
    return (found if gone is None else found.union(gone)).groupBy("id", "part").agg(F.array_sort(F.collect_set("pos")).alias("gone"))


def runs(gone: Column, n_lines: Column) -> Column:
    """Lengths of runs of kept and dropped lines in turn, the first of kept ones (0 if the first line goes). `gone` is a column."""
    starts = F.filter(gone, lambda p, i: (i == 0) | (F.get(gone, i - 1) != p - 1))
    ends = F.transform(F.filter(gone, lambda p, i: (i == F.size(gone) - 1) | (F.get(gone, i + 1) != p + 1)), lambda p: p + 1)
    edges = F.flatten(F.zip_with(starts, ends, lambda a, b: F.array(a, b)))
    tail = n_lines - F.element_at(gone, -1) - 1
    lengths = F.zip_with(edges, F.slice(F.concat(F.array(F.lit(0)), edges), F.lit(1), F.size(edges)), lambda b, a: b - a)
    return F.when(tail > 0, F.concat(lengths, F.array(tail))).otherwise(lengths)


def kept_text(text: Column, keep: Column) -> Column:
    """The lines that the runs keep, joined (null lines are passed over)."""
    flags = F.flatten(F.transform(keep, lambda n, i: F.array_repeat(i % 2 == 0, n)))
    return F.array_join(F.zip_with(F.split(text, "\n", -1), flags, lambda line, on: F.when(on, line)), "\n")


def _judged(docs: DataFrame, doc_id: str, text: str, min_docs: int, min_chars: int) -> DataFrame:
    """row (all of the document's columns), n_lines, keep: runs, null where no line goes."""
    gone = dropped(docs, doc_id, text, min_docs, min_chars)
    whole = _text(F.col(f"row.`{text}`"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn("n_lines", F.octet_length(whole) - F.octet_length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1)
    joined = rows.join(gone, (F.col(f"row.`{doc_id}`") == F.col("id")) & (F.xxhash64(whole) == F.col("part")), "left")
    return joined.select("row", "n_lines", F.when(F.col("gone").isNotNull(), runs(F.col("gone"), F.col("n_lines"))).alias("keep"))


def _n_dropped(keep: Column) -> Column:
    """The lengths of every second run."""
    return F.coalesce(F.aggregate(F.filter(keep, lambda n, i: i % 2 == 1), F.lit(0).cast("bigint"), lambda a, n: a + n), F.lit(0).cast("bigint"))


def keep_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """The id, n_lines, n_dropped and keep: lengths of runs of kept and dropped lines in turn. No text is shuffled beyond the
    rows that are joined by id."""
    found = _judged(docs.select(doc_id, text), doc_id, text, min_docs, min_chars)
    return found.select(F.col(f"row.`{doc_id}`").alias(doc_id), F.col("n_lines").cast("bigint").alias("n_lines"), _n_dropped(F.col("keep")).alias("n_dropped"), F.coalesce("keep", F.array("n_lines")).alias("keep"))


def apply(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """The documents, with their columns, and texts of kept lines only; a null text stays null."""
    found = _judged(docs, doc_id, text, min_docs, min_chars)
    old = F.col(f"row.`{text}`")
    new = F.when(F.col("keep").isNull(), old).otherwise(kept_text(_text(old), F.col("keep")))
    return found.select(*[new.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256."""
    found = _judged(docs.select("doc_id", "text"), "doc_id", "text", 3, 20)
    text = _text(F.col("row.text"))
    kept = F.when(F.col("keep").isNull(), text).otherwise(kept_text(text, F.col("keep")))
    return found.select("row.doc_id", F.col("n_lines").cast("bigint").alias("n_lines"), _n_dropped(F.col("keep")).alias("n_dropped"), F.sha2(kept, 256).alias("kept_sha256"))
