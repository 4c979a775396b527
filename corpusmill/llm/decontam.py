"""Benchmark decontamination by BM25 retrieval with block-max WAND (Ding and Suel, 2011).

The test items form an inverted index with BM25 impacts, quantised to whole numbers so that scores are exact.  Every
passage of every document is a query against it.  A passage has a cursor on the posting list of each of its terms.  The cursors are
ordered by item; the pivot is the item at which the largest impacts of the terms so far reach the threshold: no item before it can.  If
the maxima of the pivot's blocks can't reach it either, the cursors skip to where one of these blocks ends or another cursor stands; else the pivot
is scored.  Without a pivot the passage is done.  Many passages take each step together, as rows of a matrix of cursors.  Before any cursor is set
the same bound over SPANS large spans of items passes over the passages that can't have a hit in any of them.
All items at or above the threshold are retrieved, whatever their number; then the overlap of the item's question and of its answer with the
passage is verified.

The threshold is a share of the item's score against itself, so that it means the same for every item.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import map_arrow, table, without, written
from corpusmill.llm.tokens import combine, words

K1, B = 1.2, 0.75
SCALE = 10_000
#: Share of an item's own score that a passage must reach.
THRESHOLD = 0.6
#: Shares of the question's and the answer's word trigrams that the passage must hold.
QUESTION, ANSWER = 0.6, 0.6
GRAM = 3
#: Items in a block of the posting lists, and items whose index is broadcast at a time; more items take more passes.
BLOCK, SHARD_ITEMS = 4, 20_000
#: Spans of items over which each term's largest impact is held beside, to pass over most passages before any cursor is set.
SPANS = 32
#: Cursors that step together.
CELLS = 400_000


@dataclass
class Index:
    """An index of items.  Term ``t`` (a row) has items ``items[bounds[t]:bounds[t+1]]`` with these impacts, as shares of each item's own score in SCALE.

    ``at`` are the postings' keys, term and item, in order; ``block_at`` and ``block_most`` the keys, term and block, and the largest impacts
    of the blocks that have postings.
    """

    ids: list
    terms: np.ndarray
    bounds: np.ndarray
    items: np.ndarray
    impacts: np.ndarray
    most: np.ndarray
    at: np.ndarray
    block_at: np.ndarray
    block_most: np.ndarray
    grams: list[tuple[np.ndarray, np.ndarray]]
    window: int
    #: Whether a term may have these low bits, and each term's largest impact in each span of items.
    maybe: np.ndarray
    spans: np.ndarray


def grams(h: np.ndarray, n: int = GRAM) -> np.ndarray:
    """Distinct hashes of the runs of ``n`` words; a shorter non-empty text is one run."""
    if len(h) == 0:
        return h
    n = min(n, len(h))
    return np.unique(combine(*[h[i : len(h) - n + 1 + i] for i in range(n)]))


def hashed(texts: list[str | None]) -> list[np.ndarray]:
    """The word hashes of each text."""
    out: list[np.ndarray] = []
    for a, b, h, at in words(pa.array(texts, pa.large_string())):
        out += [h[at[i] : at[i + 1]].copy() for i in range(b - a)]
    return out


@dataclass
class Statistics:
    """What BM25 needs of all items: terms in order with their document frequencies, items that aren't empty, their words, and the longest's."""

    terms: np.ndarray
    df: np.ndarray
    n: int = 0
    length: int = 0
    longest: int = GRAM

    @classmethod
    def empty(cls) -> Statistics:
        return cls(np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def add(self, hashes: list[np.ndarray]) -> None:
        u, c = np.unique(np.concatenate([np.unique(h) for h in hashes] or [self.terms[:0]]), return_counts=True)
        terms, where = np.unique(np.concatenate([self.terms, u]), return_inverse=True)
        self.terms, self.df = terms, np.bincount(where, np.concatenate([self.df, c]), len(terms)).astype(np.int64)
        self.n += sum(1 for h in hashes if len(h))
        self.length += sum(len(h) for h in hashes)
        self.longest = max([self.longest, *(len(h) for h in hashes)])


def build(ids: list, hashes: list[np.ndarray], stats: Statistics) -> Index:
    """The index of these items."""
    mean = max(stats.length / max(stats.n, 1), 1e-9)
    rows, items, impacts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, h in enumerate(hashes):
        if not len(h):
            continue
        u, tf = np.unique(h, return_counts=True)
        df = stats.df[np.searchsorted(stats.terms, u)].astype(float)
        idf = np.log(1.0 + (stats.n - df + 0.5) / (df + 0.5))
        w = np.rint(SCALE * (idf * (tf * (K1 + 1.0)) / (tf + K1 * (1.0 - B + B * len(h) / mean)))).astype(np.int64)
        rows.append(u)
        items.append(np.full(len(u), i))
        impacts.append(w * SCALE * 100 // max(1, int(w.sum())))
    term, item, share = np.concatenate(rows), np.concatenate(items), np.concatenate(impacts)
    order = np.lexsort((item, term))
    terms, starts, row = np.unique(term[order], return_index=True, return_inverse=True)
    item, share = item[order], share[order]
    blocks = -(-max(1, len(ids)) // BLOCK)
    block_at, first = np.unique(row * blocks + item // BLOCK, return_index=True)
    block_most = np.maximum.reduceat(share, first) if len(share) else share
    most = np.maximum.reduceat(share, starts) if len(share) else share
    halves = [(grams(h[: (len(h) + 1) // 2]), grams(h[(len(h) + 1) // 2 :])) for h in hashes]
    maybe = np.zeros(1 << max(12, (16 * len(terms)).bit_length()), bool)
    maybe[terms & np.uint64(len(maybe) - 1)] = True
    spans = np.zeros((len(terms), SPANS), np.int32)
    np.maximum.at(spans, (row, item * SPANS // max(1, len(ids))), share.astype(np.int32))
    return Index(ids, terms, np.append(starts, len(item)), item, share, most, row * (len(ids) + 1) + item, block_at, block_most, halves, stats.longest, maybe, spans)


class _Cursors:
    """Cursors of several passages, a row for each passage: their terms, and where in the postings each stands."""

    def __init__(self, index: Index, terms: np.ndarray, there: np.ndarray) -> None:
        self.index, self.end, self.width = index, len(index.ids), terms.shape[1]
        self.blocks = -(-self.end // BLOCK)
        self.terms, self.most = terms, np.where(there, index.most[terms], 0)
        self.post = np.where(there, index.bounds[terms], 0)
        self.item = np.where(there, index.items[self.post], self.end)

    def keep(self, rows: np.ndarray) -> None:
        self.terms, self.most, self.post, self.item = self.terms[rows], self.most[rows], self.post[rows], self.item[rows]

    def pivots(self, need: int) -> np.ndarray:
        """Each row's pivot: the first item at which the largest impacts of the terms that stand there or before reach ``need``; the end if there is none."""
        both = self.item << 20 | np.minimum(self.most, (1 << 20) - 1)
        both.sort(axis=1)
        reached = np.cumsum(both & ((1 << 20) - 1), axis=1) >= need
        at = reached.argmax(axis=1)
        rows = np.arange(len(both))
        return np.where(reached[rows, at], both[rows, at] >> 20, self.end)

    def advance(self, at: np.ndarray, to: np.ndarray) -> None:
        """Moves the cursors at these places to the first posting at or after ``to``."""
        t = self.terms.ravel()[at]
        p = np.searchsorted(self.index.at, t * (self.end + 1) + to)
        more = p < self.index.bounds[t + 1]
        p = np.where(more, p, 0)
        self.post.ravel()[at] = p
        self.item.ravel()[at] = np.where(more, self.index.items[p], self.end)

    def block_most(self, at: np.ndarray, block: np.ndarray) -> np.ndarray:
        """The block maxima of the terms of the cursors at these places."""
        want = self.terms.ravel()[at] * self.blocks + block
        p = np.minimum(np.searchsorted(self.index.block_at, want), len(self.index.block_at) - 1)
        return np.where(self.index.block_at[p] == want, self.index.block_most[p], 0)


def wand(index: Index, terms: np.ndarray, there: np.ndarray, need: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, items, scores) of the passages' items at or above ``need``; a passage is a row of ``terms``, as far as ``there`` says."""
    c, ids = _Cursors(index, terms, there), np.arange(len(terms))
    while True:
        pivot = c.pivots(need)
        alive = pivot < c.end
        if not alive.all():
            c.keep(alive)
            ids, pivot = ids[alive], pivot[alive]
        if not len(ids):
            return
        upto = c.item <= pivot[:, None]
        after = np.where(upto, c.end, c.item).min(axis=1)
        at = np.flatnonzero(upto)
        row = at // c.width
        bound = np.bincount(row, c.block_most(at, (pivot // BLOCK)[row]), len(ids))
        hopeful = bound >= need
        # where the pivot's block can't reach the threshold: to its end, or to the next cursor
        to = np.where(hopeful, pivot, np.minimum(after, (pivot // BLOCK + 1) * BLOCK))
        behind = c.item.ravel()[at] < to[row]
        c.advance(at[behind], to[row[behind]])
        if hopeful.any():
            here = at[hopeful[row]]
            here = here[c.item.ravel()[here] == pivot[here // c.width]]
            score = np.bincount(here // c.width, index.impacts[c.post.ravel()[here]], len(ids)).astype(np.int64)
            found = hopeful & (score >= need)
            if found.any():
                yield ids[found], pivot[found], score[found]
            c.advance(here, pivot[here // c.width] + 1)


def search(index: Index, h: np.ndarray, at: np.ndarray, threshold: float = THRESHOLD, question: float = QUESTION, answer: float = ANSWER) -> Iterator[tuple[int, int, int]]:
    """(text's row, item's row, score) for the texts with word hashes ``h[at[i]:at[i+1]]``; a pair may come once for each passage.

    Passages have twice the longest item's words and overlap by half, so that any item lies whole in some passage.
    """
    need = int(np.ceil(threshold * SCALE * 100))
    half = index.window
    if not len(index.terms) or not len(h):
        return
    # most words of most texts are in no item: one bit of their hashes tells
    hit = np.flatnonzero(index.maybe[h & np.uint64(len(index.maybe) - 1)])
    row = np.minimum(np.searchsorted(index.terms, h[hit]), len(index.terms) - 1)
    same = index.terms[row] == h[hit]
    hit, row = hit[same], row[same]
    if not len(hit):
        return
    # each passage is two successive halves of one text
    text = np.searchsorted(at, hit, side="right") - 1
    halves = np.maximum(1, -(-np.diff(at) // half))
    base = np.concatenate([[0], np.cumsum(halves)])
    slot = base[text] + (hit - at[text]) // half
    last, only = slot == base[text + 1] - 1, halves[text] == 1
    n_terms = len(index.terms)
    first = np.unique(np.where(last & ~only, slot - 1, slot) * n_terms + row)
    before = (slot > base[text]) & ~last
    both = np.unique(np.concatenate([first, (slot[before] - 1) * n_terms + row[before]]))
    passage, term = both // n_terms, both % n_terms
    starts = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
    size = np.diff(np.append(starts, len(passage)))
    # passages of which no span of items can reach the threshold have no pivot there; the others go by size, so that rows are filled
    some = np.flatnonzero(np.add.reduceat(index.spans[term], starts, axis=0).max(axis=1) >= need)
    some = some[np.argsort(size[some], kind="stable")]
    lo = 0
    while lo < len(some):
        hi = lo + max(1, CELLS // int(size[some[min(len(some) - 1, lo + CELLS // max(1, int(size[some[lo]])))]]))
        rows = some[lo:hi]
        width = int(size[rows].max())
        there = np.arange(width)[None, :] < size[rows][:, None]
        terms = np.where(there, term[np.minimum(starts[rows][:, None] + np.arange(width)[None, :], len(term) - 1)], 0)
        for k, items, scores in wand(index, terms, there, need):
            for g, item, score in zip(rows[k], items, scores, strict=True):
                s = int(passage[starts[g]])
                i = int(np.searchsorted(base, s, side="right") - 1)
                a = int(at[i] + (s - base[i]) * half)
                own = grams(h[a : int(min(a + 2 * half, at[i + 1]))])
                if all(len(x) == 0 or int(np.isin(x, own).sum()) >= share * len(x) for x, share in zip(index.grams[item], (question, answer), strict=True)):
                    yield i, int(item), int(score)
        lo = hi


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, question: float = QUESTION, answer: float = ANSWER, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, score): each pair of a document and an item that one of its passages gives away; ``score`` is the best passage's share of the item's own score, in millionths.

    Words are those of ``corpusmill.llm.tokens``.  The first half of an item's words is its question, the rest its answer.
    The index of SHARD_ITEMS items at a time is broadcast, each in a pass of its own over the documents whose pairs are written; only the statistics
    of the items' terms are held for all of them.  Null and empty documents and items give nothing; repeated rows of one id give one pair, as do
    repeated items; an item shorter than a trigram must occur whole.  Texts are whole, however long; empty tables give no pairs; other columns aren't read.
    """
    kind, item_kind = docs.schema[id].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    items = benchmark.select("item_id", "text").where(F.col("text").isNotNull()).orderBy("item_id", "text")
    id_type, item_type = _arrow(docs, id), _arrow(benchmark, "item_id")

    def shards() -> Iterator[tuple[list, list[np.ndarray]]]:
        ids: list = []
        texts: list[str] = []
        for r in items.toLocalIterator():
            ids.append(r[0])
            texts.append(r[1])
            if len(ids) == SHARD_ITEMS:
                yield ids, hashed(texts)
                ids, texts = [], []
        yield ids, hashed(texts)

    stats = Statistics.empty()
    n = 0
    for _, hashes in shards():
        stats.add(hashes)
        n += 1
    base = docs.select(F.col(id).alias("doc_id"), F.col(text).cast("string").alias("text")).where("text IS NOT NULL")
    found: DataFrame | None = None
    for ids, hashes in shards():
        shared = docs.sparkSession.sparkContext.broadcast(build(ids, hashes, stats))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows: list[int] = []
                items_: list = []
                scores: list[int] = []
                for a, _, h, at in words(batch.column(1)):
                    for i, item, score in search(shared.value, h, at, threshold, question, answer):
                        rows.append(a + i)
                        items_.append(shared.value.ids[item])
                        scores.append(score)
                if rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)).cast(id_type), pa.array(items_, item_type), pa.array(scores, pa.int32())], ["doc_id", "item_id", "score"])

        got = map_arrow(base, run, f"doc_id {kind}, item_id {item_kind}, score int")
        if n > 1:
            got = written(got, "pairs")
            shared.unpersist()
        found = got if found is None else found.union(got)
    return found.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"))


def _arrow(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; documents with a null id stay, as no pair names them."""
    leaks = written(contaminated(docs, benchmark, **options).select("doc_id").where("doc_id IS NOT NULL").distinct(), "leaks")
    return without(docs, leaks)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it holds."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def sql_leaks(docs: str, name: str) -> str:
    """DuckDB CTEs that leave (doc_id, item_id, score) of ``docs`` in ``name``."""
    split = "list_filter(regexp_split_to_array(lower({}), '[^0-9a-z\\x{{80}}-\\x{{10FFFF}}]+'), lambda x: x <> '')"
    gram = "list_distinct(list_transform(range(1, (CASE WHEN len({0}) = 0 THEN 1 ELSE greatest(2, len({0}) - 1) END)::BIGINT), lambda i: array_to_string({0}[i:i+2], ' ')))"
    return f"""{name}_i AS (SELECT item_id, {split.format('text')} AS w FROM benchmark WHERE text IS NOT NULL),
{name}_it AS (SELECT item_id, w, len(w) AS n, (len(w) + 1) // 2 AS q FROM {name}_i WHERE len(w) > 0),
{name}_c AS (SELECT count(*) AS items, sum(n)::DOUBLE / count(*) AS mean, greatest({GRAM}, max(n))::BIGINT AS half FROM {name}_it),
{name}_tf AS (SELECT item_id, t, any_value(n) AS n, count(*) AS tf FROM (SELECT item_id, n, unnest(w) AS t FROM {name}_it) GROUP BY item_id, t),
{name}_df AS (SELECT t, count(*) AS df FROM {name}_tf GROUP BY t),
{name}_w AS (SELECT item_id, t, round_even({SCALE}.0::DOUBLE * (ln(1.0::DOUBLE + (c.items - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * {K1 + 1.0}::DOUBLE) / (tf + {K1}::DOUBLE * (1.0::DOUBLE - {B}::DOUBLE + {B}::DOUBLE * f.n / c.mean))), 0)::BIGINT AS w
  FROM {name}_tf f JOIN {name}_df USING (t), {name}_c c),
{name}_p AS (SELECT item_id, t, w * {SCALE} * 100 // greatest(1, sum(w) OVER (PARTITION BY item_id)::BIGINT) AS share FROM {name}_w),
{name}_d AS (SELECT doc_id, row_number() OVER () AS r, w, len(w) AS n FROM (SELECT doc_id, {split.format('text')} AS w FROM {docs} WHERE text IS NOT NULL)),
{name}_s AS (SELECT doc_id, r, s, w[s * half + 1 : (s + 2) * half] AS p FROM (SELECT doc_id, r, w, half, unnest(range(0, greatest(1, ceil(n / half) - 1)::BIGINT)) AS s FROM {name}_d, {name}_c)),
{name}_b AS (SELECT doc_id, r, s, item_id, sum(share)::BIGINT AS score FROM (SELECT doc_id, r, s, unnest(list_distinct(p)) AS t FROM {name}_s) JOIN {name}_p USING (t) GROUP BY ALL HAVING sum(share) >= {int(np.ceil(THRESHOLD * SCALE * 100))}),
{name}_g AS (SELECT item_id, {gram.format('w[1:q]')} AS gq, {gram.format('w[q+1:]')} AS ga FROM {name}_it),
{name}_v AS (SELECT b.doc_id, b.item_id, b.score, gq, ga, {gram.format('p')} AS g FROM {name}_b b JOIN {name}_s USING (r, s) JOIN {name}_g USING (item_id)),
{name} AS (SELECT doc_id, item_id, max(score)::INTEGER AS score FROM {name}_v
  WHERE len(list_intersect(gq, g)) >= {QUESTION} * len(gq) AND len(list_intersect(ga, g)) >= {ANSWER} * len(ga) GROUP BY doc_id, item_id)"""


OP1_SQL = f"WITH {sql_leaks('documents', 'leaks')} SELECT doc_id, item_id, score FROM leaks"
