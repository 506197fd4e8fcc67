"""Ordered work inside a key without ever holding a large key in one task.

A plain window over a key sorts all of its rows in one task, which fails once a single motor
holds a third of the data. So every key is cut into spans of its sequence column, as many as its
rows call for: one for most keys. The last rows of each span, of which there are few, are carried
into the next, so that a window over (key, span) sees the same frame as one over the key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import session

SPAN = 1 << 20

# As many spans per key may be listed in every task; a longer list meets the rows in a join.
MOST_LISTED = 100_000

_SPAN, _CONTEXT = "_span", "_is_context"


def _same_keys(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[n].eqNullSafe(right[f"_k_{n}"]) for n in names])


def cuts(df: DataFrame, keys: Sequence[str], seq: str, span: int = SPAN) -> DataFrame:
    """Where to cut keys of more than `span` rows: their first sequence number and the width of a span."""
    sizes = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min(seq).alias("_low"), F.max(seq).alias("_high")
    ).where(F.col("_n") > span)
    width = F.ceil((F.col("_high") - F.col("_low") + 1) / F.ceil(F.col("_n") / span))
    return sizes.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_low", width.alias("_width"))


def listed_cuts(df: DataFrame, keys: Sequence[str], seq: str, span: int = SPAN) -> tuple[DataFrame, int]:
    """The cuts, settled, and how many keys they cut."""
    session.ready_checkpoints(df.sparkSession)
    listed = cuts(df, keys, seq, span).checkpoint()
    return listed, listed.count()


def _placed(df: DataFrame, keys: Sequence[str], seq: str, listed: DataFrame, n: int) -> DataFrame:
    joined = df.join(F.broadcast(listed) if n <= MOST_LISTED else listed, _same_keys(df, listed, keys), "left")
    number = F.floor((F.col(seq) - F.col("_low")) / F.col("_width"))
    return joined.select(
        *df.columns, F.coalesce(number, F.lit(0)).alias(_SPAN), F.col("_low").isNotNull().alias("_cut")
    )


def with_spans(df: DataFrame, keys: Sequence[str], seq: str, span: int = SPAN) -> DataFrame:
    """Adds `_span`, growing with `seq` inside a key, and `_cut`, whether the key has several."""
    return _placed(df, keys, seq, *listed_cuts(df, keys, seq, span))


def carried(spanned: DataFrame, keys: Sequence[str], seq: str, context: int) -> DataFrame:
    """For each span of a key the last `context` rows before it, under that span's number."""
    columns = [c for c in spanned.columns if c not in (seq, _SPAN, "_cut")]
    newest = Window.partitionBy(*keys, _SPAN).orderBy(F.col(seq).desc())
    tails = (
        spanned.where("_cut").withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= context)
        .groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys], _SPAN)
        .agg(F.sort_array(F.collect_list(F.struct(seq, *columns))).alias("_rows"))
    )
    # Every span has a row, so the last `context` rows lie in as many spans at most.
    before = Window.partitionBy(*[f"_k_{k}" for k in keys]).orderBy(_SPAN).rowsBetween(-context, -1)
    rows = F.flatten(F.collect_list("_rows").over(before))
    last = F.slice("_rows", F.greatest(F.lit(1), F.size("_rows") - (context - 1)), context)
    return (
        tails.select(_SPAN, rows.alias("_rows")).select(_SPAN, F.explode(last).alias("_row")).select(_SPAN, "_row.*")
    )


def in_order(
    df: DataFrame, keys: Sequence[str], seq: str, context: int, compute: Callable[[DataFrame, list[str]], DataFrame],
    span: int = SPAN,
) -> DataFrame:
    """Runs `compute` on the rows of each key in the order of `seq`, a whole number unique in the key.

    `compute(rows, window_keys)` adds columns with windows over `window_keys` ordered by `seq`
    that look back at most `context` rows. Where no key is cut there is nothing to carry, and the
    rows are read and shuffled by key once.
    """
    listed, n = listed_cuts(df, keys, seq, span)
    if n == 0:
        return compute(df, list(keys))
    spanned = _placed(df, keys, seq, listed, n)
    own = spanned.select(*df.columns, _SPAN, F.lit(False).alias(_CONTEXT))
    before = carried(spanned, keys, seq, context).select(*df.columns, _SPAN, F.lit(True).alias(_CONTEXT))
    return compute(own.unionByName(before), [*keys, _SPAN]).where(~F.col(_CONTEXT)).drop(_SPAN, _CONTEXT)
