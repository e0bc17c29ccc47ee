"""Linear folds over a recording's sorted array, and joins of intervals in time buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The least number of elements that a fold takes up before their values are set aside.
BLOCK = 64


def scan(source: str, kind: str, out: str, state: dict[str, tuple[str, str]], let: str = "false", finish: str | None = None, block: int = BLOCK) -> str:
    """SQL of an array with a value of ``kind`` for each element of the array ``source``, in order.

    state: name to (first value, value after an element). ``let`` is worked out once for each
    element and known as z; ``out`` and the new states may use z, a.<state>, the index i and
    {source}[i]. finish: what becomes of the fold instead of the array, which it knows as made.

    A fold's state is copied at every step. So that this does not cost the square of the length, an
    inner fold makes the values of about as many elements as the root of the length, and only then
    does an outer one set them aside: work and copies grow with the length times its root.
    """
    names = list(state)
    first = ", ".join(f"'{k}', {state[k][0]}" for k in names)
    taken = ", ".join(f"'{k}', o.{k}" for k in names)
    after = ", ".join(f"'{k}', {state[k][1]}" for k in names)
    given = ", ".join(f"'{k}', r.{k}" for k in names)
    width = f"cast(greatest({block}, sqrt(size({source}))) as int)"
    made = "flatten(a.__d)"
    return f"""aggregate(sequence(0, cast((size({source}) - 1) div {width} as int)), named_struct('__d', cast(array() as array<array<{kind}>>), {first}),
      (o, c) -> aggregate(array(
          aggregate(sequence(c * {width}, least(size({source}) - 1, c * {width} + {width} - 1)), named_struct('__c', cast(array() as array<{kind}>), {taken}),
            (a, i) -> aggregate(array({let}), a, (b, z) -> named_struct('__c', concat(a.__c, array(cast({out} as {kind}))), {after})))),
        o, (b, r) -> named_struct('__d', concat(b.__d, array(r.__c)), {given})),
      a -> {finish.replace("made", made) if finish else made})"""


def buckets(low: Column, high: Column, width: int) -> Column:
    """Numbers of the buckets of ``width`` that an interval touches, ends included."""
    return F.sequence(F.floor(low / width), F.floor(F.greatest(low, high) / width))


def meeting(left: DataFrame, low: str, high: str, right: DataFrame, start: str, end: str, on: str = "doc_id", width: int = 6000) -> DataFrame:
    """Pairs of rows with one ``on`` whose closed intervals meet, each pair once.

    Both sides are listed under the buckets that they touch, so that a long recording's intervals
    do not all meet in one group; a pair counts in the first bucket that both touch. Column names
    of the sides must differ but for ``on``.
    """
    a = left.withColumn("__a", F.floor(F.col(low) / width)).withColumn("__b", F.explode(buckets(F.col(low), F.col(high), width)))
    b = right.withColumn("__s", F.floor(F.col(start) / width)).withColumn("__b", F.explode(buckets(F.col(start), F.col(end), width)))
    met = a.join(b, [on, "__b"]).where((F.col(low) <= F.col(end)) & (F.col(start) <= F.col(high)) & (F.col("__b") == F.greatest("__a", "__s")))
    return met.drop("__a", "__b", "__s")
