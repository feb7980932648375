"""Vector functions over array columns, as expressions that Catalyst keeps in the JVM.

Sums are taken in double precision in array order. The two cosines and the two normalisations differ at their edges only;
each has its own name, as callers depend on the edge.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Added to a norm before dividing, and under the root of the other kind.
NORM_EPSILON = 1e-12
#: The least mask count that a clamped mean divides by.
MASK_EPSILON = 1e-9


def _double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def total(v: Column) -> Column:
    """The sum of an array; 0 of an empty one, null of null."""
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    """The dot product up to the shorter array's end."""
    n = F.least(F.size(a), F.size(b))
    return total(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double")))


def squared(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))


def norm(v: Column) -> Column:
    return F.sqrt(squared(v))


def cosine(a: Column, b: Column) -> Column:
    """The cosine; 0 if either vector is all zero. Lengths may differ, as for dot()."""
    length = norm(a) * norm(b)
    return F.when(length == 0, F.lit(0.0)).otherwise(dot(a, b) / length)


def strict_cosine(a: Column, b: Column) -> Column:
    """The cosine for self-checks; -1 for lengths that differ, and for empty or zero vectors."""
    length = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (F.size(a) < 1) | (length == 0), F.lit(-1.0)).otherwise(dot(a, b) / length)


def l2_normalize(v: Column) -> Column:
    """v / (|v| + epsilon); a zero vector stays zero."""
    length = norm(v) + NORM_EPSILON
    return F.transform(v, lambda x: x.cast("double") / length)


def l2_normalize_inner(v: Column) -> Column:
    """v / sqrt(|v|^2 + epsilon)."""
    length = F.sqrt(squared(v) + NORM_EPSILON)
    return F.transform(v, lambda x: x.cast("double") / length)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def drift(new: Column, old: Column) -> Column:
    """differ (how many components), most and mean (of their distances), between vectors of one length; null for other lengths, as there
    is no telling which components are the same."""
    gaps = F.zip_with(new, old, lambda a, b: F.abs(a.cast("double") - b.cast("double")))
    found = F.struct(F.size(F.filter(gaps, lambda g: g > 0)).alias("differ"), F.array_max(gaps).alias("most"), (total(gaps) / F.size(gaps)).alias("mean"))
    return F.when((F.size(new) == F.size(old)) & (F.size(new) > 0), found)


def cls_pool(hidden: Column) -> Column:
    """The first token's vector of an array of token vectors."""
    return F.when(F.size(hidden) > 0, hidden[0])


def last_token_pool(hidden: Column, mask: Column) -> Column:
    """The vector of the last token whose mask is positive, else of the last one."""
    n = F.size(hidden)
    at = F.array_max(F.transform(F.sequence(F.lit(1), n), lambda i: F.when(F.element_at(mask, i) > 0, i)))
    return F.when(n > 0, F.element_at(hidden, F.coalesce(at, n)))


def _mean(hidden: Column, mask: Column, count: Column) -> Column:
    dim = F.size(hidden[0])
    return F.transform(F.sequence(F.lit(0), dim - 1), lambda d: F.aggregate(F.zip_with(hidden, mask, lambda h, m: h[d].cast("double") * m), F.lit(0.0), lambda a, x: a + x) / count)


def mean_pool(hidden: Column, mask: Column) -> Column:
    """The mask-weighted mean of token vectors; a mask without any token divides by 1."""
    count = total(mask)
    return F.when(F.size(hidden) > 0, _mean(hidden, mask, F.when(count == 0, F.lit(1.0)).otherwise(count)))


def mean_pool_clamped(hidden: Column, mask: Column) -> Column:
    """The mask-weighted mean of token vectors; the mask's count is MASK_EPSILON at least."""
    return F.when(F.size(hidden) > 0, _mean(hidden, mask, F.greatest(total(mask), F.lit(MASK_EPSILON))))


def multivector_keep(vectors: Column, mask: Column) -> Column:
    """Token vectors without the first position's: vector j stays if the mask at j + 1 is 1."""
    return F.filter(F.transform(vectors, lambda v, j: F.struct(v.alias("v"), (F.get(mask, j + 1) == 1).alias("k"))), lambda s: s["k"])["v"]


def splade_weight(logit: Column, mask: Column) -> Column:
    """ln(1 + relu(logit)) where the mask is set."""
    return F.log1p(relu(logit)) * mask


def lexical_weight(hidden: Column, weight: Column, bias: Column) -> Column:
    """relu of the token's projection."""
    return relu(dot(hidden, weight) + bias)
