"""Global orders without a global window: range-sorted tables, numbers by partition offsets, and folds whose state goes from partition to partition."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.plans.storage import checkpoint

#: ``monotonically_increasing_id`` counts the rows of a partition below this bit.
_ROW_BITS = 33
#: Candidates of ``pack_best`` that are looked at between two scans.
PAGE = 1000


def fresh(df: DataFrame, name: str) -> str:
    """A column name beginning with ``name`` that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def placed(rows: DataFrame, order: tuple[Column, ...], at: str) -> DataFrame:
    """``rows`` sorted by range, with ``at``: the partition above bit _ROW_BITS and the place in it below; written, so that it stays as it is."""
    return checkpoint(rows.orderBy(*order).withColumn(at, F.monotonically_increasing_id()))


def numbered(rows: DataFrame, *order: Column, into: str = "ord") -> DataFrame:
    """``rows`` with their number from 1 in an order.  They are sorted over the network, so they should be narrow; equal rows are numbered as they come.

    Each partition of the range sort adds the number of rows in those before it: no task sees more than its own range.
    """
    at, part, before = fresh(rows, "at"), fresh(rows, "part"), fresh(rows, "before")
    sorted_ = placed(rows, order, at)
    # a row for each partition
    counts = sorted(tuple(r) for r in sorted_.groupBy(F.shiftright(at, _ROW_BITS)).agg(F.count(F.lit(1))).collect())
    starts = np.cumsum([0, *(n for _, n in counts)]).tolist()
    offsets = rows.sparkSession.createDataFrame([(p, s) for (p, _), s in zip(counts, starts, strict=False)], f"`{part}` bigint, `{before}` bigint")
    out = sorted_.join(F.broadcast(offsets), F.shiftright(at, _ROW_BITS) == F.col(part))
    number = F.col(before) + F.col(at).bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + 1
    return out.withColumn(into, number).drop(at, part, before)


class _Run:
    """A run of successive blocks: where parts are cut, for whatever the part that is open at its start holds.

    A part is cut before a block if it holds anything and the block would take it beyond the budget.
    """

    def __init__(self, tokens: np.ndarray, budget: int) -> None:
        self.budget, self.n = budget, len(tokens)
        self.sums = np.concatenate([[0], np.cumsum(tokens)])
        some = np.where(tokens > 0, np.arange(self.n), self.n)
        first = np.minimum.accumulate(some[::-1])[::-1]
        # where the part that begins at a block ends
        self.end = np.maximum(first + 1, np.searchsorted(self.sums, self.sums[:-1] + budget, side="right") - 1)
        self.first = int(first[0]) + 1
        self.cuts, self.left = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        for i in range(self.n - 1, -1, -1):
            e = int(self.end[i])
            self.cuts[i], self.left[i] = (0, self.sums[-1] - self.sums[i]) if e >= self.n else (self.cuts[e] + 1, self.left[e])

    def reach(self) -> np.ndarray:
        """The blocks before which the first cut may lie; those within the first ``budget`` tokens."""
        last = min(self.n - 1, max(self.first, int(np.searchsorted(self.sums, self.budget, side="right")) - 1))
        at = np.arange(last + 1)
        return at[(at == 0) | (at == last) | (at == self.first) | (np.diff(self.sums)[: last + 1] > 0)]

    def starts(self, used: int) -> list[int]:
        """The blocks that begin a part if the open one holds ``used``."""
        i = max(int(np.searchsorted(self.sums, self.budget - used, side="right")) - 1, 0 if used else self.first)
        out = []
        while i < self.n:
            out.append(i)
            i = int(self.end[i])
        return out


def _carried(row: dict, used: int, budget: int) -> tuple[int, int]:
    """(cuts, used) at the end of a run, from its summary."""
    i = int(np.searchsorted(row["upto"], budget - used, side="right")) if row["upto"] else 0
    if not used:
        i = max(i, int(np.searchsorted(row["block"], row["first"])))
    return (0, used + row["total"]) if i >= len(row["block"]) else (row["cuts"][i] + 1, row["left"][i])


def pack(blocks: DataFrame, budget: int, *order: Column, tokens: str = "tokens", rel: str = "rel") -> DataFrame:
    """(rel, tokens, part): blocks in their order, a new part where the next one would exceed the budget; a larger block is alone.

    The sum starts anew with each part, so it is a fold and no running sum.  Names and token counts are sorted by range.  What a
    partition does to the part that is open at its start depends only on where its first cut lies, so it is summed up in a row for each
    block within its first ``budget`` tokens.  One pass over these summaries says what each partition begins with; then all are packed
    at once.  Null counts are 0; an empty table has no parts.
    """
    kind = blocks.schema[rel].dataType.simpleString()
    sorted_ = blocks.orderBy(*order).select(F.col(rel).alias("rel"), F.coalesce(tokens, F.lit(0)).cast("bigint").alias("tokens"), F.monotonically_increasing_id().alias("at"))
    sorted_ = checkpoint(sorted_).withColumn("p", F.shiftright("at", _ROW_BITS))

    def summed(t: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        run = _Run(t["tokens"].to_numpy(), budget)
        r = run.reach()
        return pa.table({"p": t["p"][:1], "total": [int(run.sums[-1])], "first": [run.first], "block": [r], "upto": [run.sums[r + 1]], "cuts": [run.cuts[r]], "left": [run.left[r]]})

    shape = "p bigint, total bigint, first bigint, block array<bigint>, upto array<bigint>, cuts array<bigint>, left array<bigint>"
    states, used, part = [], 0, 1
    for row in sorted_.select("p", "at", "tokens").groupBy("p").applyInArrow(summed, shape).orderBy("p").toLocalIterator():
        states.append((row.p, used, part))
        more, used = _carried(row.asDict(), used, budget)
        part += more
    held = {p: (u, k) for p, u, k in states}

    def parted(t: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        used, part = held[t["p"][0].as_py()]
        new = np.zeros(t.num_rows, np.int64)
        new[_Run(t["tokens"].to_numpy(), budget).starts(used)] = 1
        return pa.table({"rel": t["rel"], "tokens": t["tokens"], "part": (part + np.cumsum(new)).astype(np.int32)})

    return sorted_.groupBy("p").applyInArrow(parted, f"rel {kind}, tokens bigint, part int").withColumnRenamed("rel", rel).withColumnRenamed("tokens", tokens)


def pack_best(items: DataFrame, budget: int, *order: Column, cost: str = "cost") -> DataFrame:
    """The items taken in their order while they fit; one that doesn't fit is passed over and the next one tried.

    Items are sorted by range.  Of those that still fit, a page of the next ones is looked at by one scan; the first of them is taken at
    least, so there are no more scans than items taken, and these are bounded by the budget.  Items that cost nothing always fit; null costs never do.
    """
    at = fresh(items, "at")
    sorted_ = placed(items, order, at)
    left, last, taken = budget, -1, []
    while left > 0:
        page = sorted_.where((F.col(at) > last) & (F.col(cost) > 0) & (F.col(cost) <= left)).select(at, cost).orderBy(at).limit(PAGE).collect()
        for place, c in page:
            if c <= left:
                left -= c
                taken.append(place)
        if len(page) < PAGE:
            break
        last = page[-1][0]
    return sorted_.where((F.col(cost) <= 0) | F.col(at).isin(taken)).drop(at)
