"""Fingerprints of tables that do not depend on the order of rows, so that they can be summed by parts.

A row is written as canonical text and hashed; the fingerprint binds the number of rows, the sums and the exclusive
ors of two wide parts of all hashes. Sums tell repeated rows apart where exclusive ors cancel. All of it is one
partial aggregate: no rows are sorted, and nothing but the sums is shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hexadecimal digits of each part; 60 bits, so that a part is a positive long.
PART_DIGITS = 15


def canonical_text(values: Mapping[str, Column]) -> Column:
    """Named values as text: each with its length, null as a dash. Give numbers as integers; floats have no one text."""

    def shown(value: Column) -> Column:
        text = value.cast("string")
        return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.length(text).cast("string"), F.lit(":"), text))

    return F.concat(*[part for name, value in values.items() for part in (F.lit(f"{name}="), shown(value), F.lit(";"))])


def thousandths(value: Column) -> Column:
    return F.round(value * 1000).cast("long")


def _parts(text: Column) -> Column:
    """The wide parts of a row's hash, as an array of longs."""
    digest = F.sha2(text, 256)
    return F.array(*[F.conv(F.substring(digest, 1 + k * PART_DIGITS, PART_DIGITS), 16, 10).cast("long") for k in range(2)])


def _exact_sum(part: Column) -> Column:
    """The sum of 60-bit longs as a decimal: two sums of 30-bit halves, which fit a long for 2^33 rows, put together once."""
    high, low = F.sum(F.shiftright(part, 30)), F.sum(part.bitwiseAND((1 << 30) - 1))
    wide = "decimal(19,0)"
    return (high.cast(wide) * F.lit(1 << 30).cast("decimal(10,0)") + low.cast(wide)).cast("decimal(38,0)")


def _bound(parts: Column) -> Column:
    """An aggregate: SHA-256 over count, sums and exclusive ors of the rows' hash parts."""
    sums = [_exact_sum(parts[k]).cast("string") for k in range(2)]
    ors = [F.bit_xor(parts[k]).cast("string") for k in range(2)]
    return F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *sums, *ors), 256)


def multiset_fingerprint(text: Column) -> Column:
    """An aggregate: SHA-256 over count, sums and exclusive ors of the rows' hashes."""
    return _bound(_parts(text))


def repetition_fingerprints(rows: DataFrame, keys: Sequence[str], shared: Mapping[str, Column], repetitions: Mapping[str, Mapping[str, Column]]) -> DataFrame:
    """Per key: rows, the fingerprint of each repetition, and whether all repetitions have one fingerprint.

    ``shared`` are the values that all repetitions have in common, ``repetitions`` the others by repetition. A row whose
    text is that of the first repetition is not hashed again.
    """
    first, *others = repetitions
    # A text names each value more than once, so values become text in a projection of their own.
    values = {f"_{n}": v for n, v in shared.items()} | {f"_{r}_{n}": v for r, own in repetitions.items() for n, v in own.items()}
    named = rows.select(*keys, *[v.cast("string").alias(n) for n, v in values.items()])
    common = {n: F.col(f"_{n}") for n in shared}
    texts = {r: canonical_text({**common, **{n: F.col(f"_{r}_{n}") for n in own}}) for r, own in repetitions.items()}
    shown = named.select(*keys, *[t.alias(f"_{r}_text") for r, t in texts.items()])
    text = {r: F.col(f"_{r}_text") for r in repetitions}
    hashed = shown.withColumn(f"_{first}_parts", _parts(text[first]))
    again = {n: F.when(text[n] == text[first], F.col(f"_{first}_parts")).otherwise(_parts(text[n])) for n in others}
    hashed = hashed.withColumns({f"_{n}_parts": c for n, c in again.items()})
    found = hashed.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"), *[_bound(F.col(f"_{n}_parts")).alias(f"{n}_fingerprint") for n in repetitions])
    names = [F.col(f"{n}_fingerprint") for n in repetitions]
    distinct = F.size(F.array_distinct(F.array(*names)))
    return found.withColumns({"distinct_fingerprints": distinct.cast("long"), "fingerprints_match": distinct == 1})
