"""N-gram Jaccard self-join with a token-group matrix (after Li et al., LES3, 2021).

Each document is the set of its word trigrams.  Documents with the same set are one set with several ids.  Similar sets
are put in groups, and the matrix holds which tokens occur in any member of which group.  A set's overlap with a group's
token union bounds its overlap with every member, so only groups whose bound reaches what the threshold needs are opened;
in an opened group the Jaccard coefficients are exact, over the whole sets.

All of it is exact: two sets at the threshold share at least ``need`` tokens, the share that it asks of the larger one of them.  A set of which
fewer tokens than it needs occur in any other set has no partner and is left out.  The tokens of the rest are ordered by how many sets have
them: of the tokens that two sets share, the first ``few`` are within the first few beyond those left when what is needed is taken away (``rare``), in either set.
So only these are joined with the matrix, which holds them for each group, and a group is opened for a set that has as many of them in common with it as
any member must; tokens that very many sets have, such as those of licence lines, mostly never meet.  No list of tokens, candidates or partners is cut.

Tokens are counted in parts by their hashes, packed; those that several sets have go back to their sets' parts.  A part has about COUNTED tokens.

A set's group is that of three of its KEY lowest-hashed tokens that others have: of all such triples the one that most sets have.  The variants
of one text mostly choose the same triple.  Large groups are compared in blocks of about BLOCK trigrams, a pair of blocks a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import Workspace, checked_broadcast, group_arrow, map_arrow, table, without
from corpusmill.llm.tokens import combine, mix, words

GRAM = 3
THRESHOLD = 0.5
KEY = 6
#: Rare tokens that a set has in common with a group before it is opened, or as many as it needs.
FEW = 16
#: Tokens in a part that is counted at a time.
COUNTED = 3_000_000
#: ``needs`` only: tokens of a sample, and the probability of a pair at the threshold to share fewer of them than it needs.
TOKENS, MISS = 48, 0.0005
#: Trigrams in a block of a group, and what a set counts beside its trigrams, so that blocks of small sets are bounded too.
BLOCK, EACH = 1_000_000, 250
#: Rows of a block that are compared at a time, and cells of its incidence matrix.
ROWS, CELLS = 1024, 8_000_000
#: Places in blocks up to which the documents' tasks are told of them by a broadcast; beyond that the texts shuffle to them.
JOBS = 500_000


def gram_set(h: np.ndarray, n: int = GRAM) -> np.ndarray:
    """Sorted distinct 48-bit hashes of the runs of ``n`` words; a shorter non-empty text is one run."""
    if len(h) == 0:
        return h
    n = min(n, len(h))
    return np.unique(mix(combine(*[h[i : len(h) - n + 1 + i] for i in range(n)])) >> np.uint64(16))


def gram_sets(column: pa.Array, n: int = GRAM) -> Iterator[tuple[int, np.ndarray]]:
    """(row, set) for each text."""
    for a, b, h, at in words(column):
        for i in range(b - a):
            yield a + i, gram_set(h[at[i] : at[i + 1]], n)


def needs(threshold: float, k: int = TOKENS) -> list[int]:
    """How many tokens of samples of 1 to ``k`` tokens a pair at the threshold shares, but for a probability of MISS.  The join takes no samples and doesn't use it."""
    out = []
    for n in range(1, k + 1):
        below, m = 0.0, 0
        while m < n and below + (p := comb(n, m) * threshold**m * (1 - threshold) ** (n - m)) <= MISS:
            below, m = below + p, m + 1
        out.append(max(1, m))
    return out


def signature(s: np.ndarray) -> int:
    """64 bits that tell a set from others."""
    both = np.array([s.sum(dtype=np.uint64) + np.uint64(len(s)), np.bitwise_xor.reduce(mix(s + np.uint64(0x9E3779B97F4A7C15)))], np.uint64)
    return int(combine(both[:1], both[1:]).view(np.int64)[0])


def _packed(s: np.ndarray) -> bytes:
    """A set in six bytes for each hash."""
    return s.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, sizes, sigs = [], [], []
        for row, s in gram_sets(batch.column(1)):
            if len(s):
                rows.append(row)
                sizes.append(len(s))
                sigs.append(signature(s))
        if rows:
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(sizes, pa.int32()), pa.array(sigs, pa.int64())], ["doc_id", "n", "sig"])


_PARTS = "part int, heads binary, tokens binary"


def _parted(part: np.ndarray, sig: np.ndarray, n: np.ndarray, tokens: np.ndarray) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """(part, heads, tokens) of each part; tokens of a set are together, and heads hold its sig, n and number of tokens there."""
    order = np.argsort(part.astype(np.uint16) if len(part) and part.max() < 1 << 16 else part, kind="stable")
    part, sig, n, tokens = part[order], sig[order], n[order], tokens[order]
    first = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (sig[1:] != sig[:-1])][: len(part)])
    heads = np.stack([sig[first].view(np.uint64), n[first].astype(np.uint64) << np.uint64(32) | np.diff(np.r_[first, len(part)]).astype(np.uint64)], 1)
    for lo, hi in _spans(part):
        a, b = np.searchsorted(first, (lo, hi))
        yield int(part[lo]), heads[a:b].tobytes(), tokens[lo:hi]


def _spans(x: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of equal successive values."""
    cuts = np.flatnonzero(np.r_[True, x[1:] != x[:-1], True]) if len(x) else np.zeros(1, np.int64)
    return zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)


def _joined(column: pa.ChunkedArray) -> bytes:
    return b"".join(column.to_pylist())


def _heads(parts: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(sig, n) of each token."""
    heads = np.frombuffer(_joined(parts["heads"]), np.uint64).reshape(-1, 2)
    times = (heads[:, 1] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return np.repeat(heads[:, 0].astype(np.int64), times), np.repeat((heads[:, 1] >> np.uint64(32)).astype(np.int64), times)


def _by_token(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """The tokens of all sets, in parts by their hashes."""
    for batch in batches:
        found = {signature(s): s for _, s in gram_sets(batch.column(1)) if len(s)}
        if found:
            sizes, tokens = np.array([len(s) for s in found.values()]), np.concatenate(list(found.values()))
            part = (mix(tokens) % np.uint64(parts)).astype(np.int64)
            rows = [(p, h, _packed(t)) for p, h, t in _parted(part, np.repeat(np.array(list(found), np.int64), sizes), np.repeat(sizes, sizes), tokens)]
            for lo in range(0, len(rows), 256):
                p, heads, packed = zip(*rows[lo : lo + 256], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(heads, pa.binary()), pa.array(packed, pa.binary())], ["part", "heads", "tokens"])


def _by_set(part: pa.Table, parts: int) -> pa.Table:
    """The tokens of a part that several sets have, in parts by the sets; before each token's 48 bits stands how many sets have it, on a scale of logarithms."""
    sig, n = _heads(part)
    tokens = _unpacked(_joined(part["tokens"]))
    order = np.argsort(tokens)
    tokens = tokens[order]
    same = tokens[1:] == tokens[:-1]
    order, tokens = (x[np.r_[same, False] | np.r_[False, same]] if len(x) else x for x in (order, tokens))
    # copies of a set are one
    by = np.lexsort((sig[order], tokens))
    order, tokens = order[by], tokens[by]
    sig, n = sig[order], n[order]
    once = np.r_[True, (tokens[1:] != tokens[:-1]) | (sig[1:] != sig[:-1])][: len(tokens)]
    sig, n, tokens = sig[once], n[once], tokens[once]
    _, column, df = np.unique(tokens, return_inverse=True, return_counts=True)
    df = df[column]
    several = df > 1
    sig, n, tokens = sig[several], n[several], tokens[several] | (np.log2(df[several]) * 4).astype(np.uint64) << np.uint64(48)
    by = np.argsort(sig, kind="stable")
    sig, n, tokens = sig[by], n[by], tokens[by]
    rows = [(p, h, t.tobytes()) for p, h, t in _parted((mix(sig.view(np.uint64)) % np.uint64(parts)).astype(np.int64), sig, n, tokens)]
    return pa.table({"part": pa.array([r[0] for r in rows], pa.int32()), "heads": pa.array([r[1] for r in rows], pa.binary()), "tokens": pa.array([r[2] for r in rows], pa.binary())})


def _alive(part: pa.Table, threshold: float) -> pa.Table:
    """(sig, n, few, rare, low) of a part's sets that have as many tokens in common with others as they need."""
    sig, n = _heads(part)
    tokens = np.frombuffer(_joined(part["tokens"]), np.int64)
    by = np.lexsort((tokens, sig))
    sig, n, tokens = sig[by], n[by], tokens[by]
    sigs, sizes, fews, rare, low = [], [], [], [], []
    for lo, hi in _spans(sig):
        need = max(1, int(np.ceil(n[lo] * threshold - 1e-9)))
        if hi - lo >= need:
            sigs.append(sig[lo])
            sizes.append(n[lo])
            fews.append(min(need, FEW))
            rare.append(tokens[lo : hi - need + fews[-1]])
            low.append(np.sort(tokens[lo:hi] & ((1 << 48) - 1))[:KEY])
    lists = lambda x: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]), pa.int32()), pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)))
    return pa.table({"sig": pa.array(sigs, pa.int64()), "n": pa.array(sizes, pa.int32()), "few": pa.array(fews, pa.int32()), "rare": lists(rare), "low": lists(low)})


class _Job:
    """Two blocks of sets, or one with itself: ``col`` sets are compared with all others, in a ``diag`` job also with each other."""

    def __init__(self, job: pa.Table) -> None:
        sig, col = job["sig"].to_numpy(), job["col"].to_numpy(zero_copy_only=False)
        # each set once, though its document may be repeated; columns first, by size, so that sets of very different sizes don't meet
        n = pa.compute.binary_length(job["set"]).to_numpy() // 6
        _, once = np.unique(sig, return_index=True)
        order = once[np.lexsort((sig[once], n[once], ~col[once]))]
        self.sig, self.n, self.copies = sig[order], n[order], job["copies"].to_numpy()[order]
        self.cols, self.diag = int(col[order].sum()), bool(job["diag"][0].as_py())
        sets = [_unpacked(x) for x in job["set"].take(pa.array(order)).to_pylist()]
        owner, (tokens, column, count) = np.repeat(np.arange(len(sets)), self.n), np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        keep = count[column] > 1
        owner, column = owner[keep], (np.cumsum(count > 1) - 1)[column[keep]]
        self.column_at = np.argsort(column, kind="stable")
        self.owner, self.column, self.tokens = owner[self.column_at], column[self.column_at], int((count > 1).sum())

    def pairs(self, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(i, j, shared) of the sets, by place, at or above the threshold; each pair once."""
        start, end = (0, len(self.sig)) if self.diag else (self.cols, len(self.sig))
        for r in range(start, end, ROWS):
            rows = np.arange(r, min(r + ROWS, end))
            n = self.n[rows]
            lo, hi = np.searchsorted(self.n[: self.cols], (int(n.min()) * threshold - 1e-9, int(n.max()) / threshold + 1e-9))
            if self.diag:
                hi = min(hi, int(rows[-1]))
            if hi <= lo:
                continue
            some = np.zeros(len(self.sig), np.int32) - 1
            some[lo:hi] = np.arange(hi - lo)
            place = np.zeros(len(self.sig), np.int32) - 1
            place[rows] = np.arange(len(rows))
            # tokens that these rows and these columns have in common
            a, b = place[self.owner] >= 0, some[self.owner] >= 0
            both = np.zeros(self.tokens, np.int8)
            both[self.column[a]] |= 1
            both[self.column[b]] |= 2
            number = np.cumsum(both == 3) - 1
            total = int(number[-1]) + 1 if len(number) else 0
            ra, ca = self.owner[a & (both[self.column] == 3)], number[self.column[a & (both[self.column] == 3)]]
            rb, cb = self.owner[b & (both[self.column] == 3)], number[self.column[b & (both[self.column] == 3)]]
            m = np.zeros((len(rows), hi - lo), np.float32)
            step = max(1, CELLS // (len(rows) + hi - lo))
            for c in range(0, total, step):
                x = np.zeros((len(rows), min(step, total - c)), np.float32)
                y = np.zeros((hi - lo, min(step, total - c)), np.float32)
                s, e = np.searchsorted(ca, (c, c + step))
                x[place[ra[s:e]], ca[s:e] - c] = 1
                s, e = np.searchsorted(cb, (c, c + step))
                y[some[rb[s:e]], cb[s:e] - c] = 1
                m += x @ y.T
            i, j = np.nonzero(m >= np.ceil(threshold / (1 + threshold) * (n[:, None] + self.n[None, lo:hi]) - 1e-6))
            shared = m[i, j].astype(np.int64)
            i, j = i + r, j + lo
            keep = (shared >= threshold * (self.n[i] + self.n[j] - shared)) & ((i > j) if self.diag else True)
            yield i[keep], j[keep], shared[keep]

    def listed(self, threshold: float) -> pa.Table:
        out = list(self.pairs(threshold)) or [(np.zeros(0, np.int64),) * 3]
        i, j, shared = (np.concatenate(x) for x in zip(*out, strict=True))
        a, b = np.minimum(self.sig[i], self.sig[j]), np.maximum(self.sig[i], self.sig[j])
        return pa.table({"a": a, "b": b, "shared": shared, "total": self.n[i].astype(np.int64) + self.n[j] - shared})

    def counted(self, threshold: float) -> pa.Table:
        """(sig, links, root): for each set with a partner here the partners' documents, and the lowest set that pairs lead to."""
        links, root = np.zeros(len(self.sig), np.int64), np.arange(len(self.sig))
        by = np.argsort(self.sig, kind="stable")
        rank = np.empty_like(by)
        rank[by] = np.arange(len(by))
        root = rank.copy()
        edges = []
        for i, j, _ in self.pairs(threshold):
            links += np.bincount(i, self.copies[j], len(links)).astype(np.int64) + np.bincount(j, self.copies[i], len(links)).astype(np.int64)
            edges.append((i, j))
        changed = bool(edges)
        while changed:
            before = root.copy()
            for i, j in edges:
                low = np.minimum(root[i], root[j])
                np.minimum.at(root, i, low)
                np.minimum.at(root, j, low)
            root = np.minimum(root, root[by[root]])
            changed = not np.array_equal(root, before)
        some = np.flatnonzero(links)
        return pa.table({"sig": self.sig[some], "links": links[some], "root": self.sig[by[root[some]]]})


def _jobs(docs: DataFrame, threshold: float, id: str, text: str, w: Workspace) -> tuple[DataFrame, DataFrame]:
    """(members, jobs): members (sig, doc_id), kept; jobs (g, i, j, sig, copies, col, diag, set), the blocks to compare."""
    kind = docs.schema[id].dataType.simpleString()
    base = docs.select(F.col(id).alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    sets = w.written(map_arrow(base, _sets, f"doc_id {kind}, n int, sig bigint"), "sets")
    members = w.kept(sets.select("sig", "doc_id").distinct(), "members")
    parts = max(1, ceil((sets.agg(F.sum(F.col("n").cast("bigint"))).first()[0] or 0) / COUNTED))
    w.drop("sets")
    counted = group_arrow(map_arrow(base, lambda batches: _by_token(batches, parts), _PARTS), "part", lambda t: _by_set(t, parts), _PARTS)
    alive = group_arrow(counted, "part", lambda t: _alive(t, threshold), "sig bigint, n int, few int, rare array<bigint>, low array<bigint>")
    alive = w.written(alive, "alive")
    triples = F.array_distinct(F.array(*[F.xxhash64(*[F.get("low", F.lit(i)) for i in c]) for c in combinations(range(KEY), 3)]))
    keys = alive.select("sig", F.explode(triples).alias("key"))
    held = keys.groupBy("key").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1")
    group = keys.join(held, "key").groupBy("sig").agg(F.max(F.struct("sets", "key"))["key"].alias("g"))
    one = members.groupBy("sig").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    grouped = alive.join(group, "sig", "left").withColumn("g", F.coalesce("g", F.xxhash64("sig"))).join(one, "sig").drop("low")
    grouped = w.written(grouped, "grouped")
    w.drop("alive")
    weight = F.sum(F.col("n") + EACH)
    sizes = w.written(grouped.groupBy("g").agg(F.count(F.lit(1)).alias("members"), weight.alias("weight"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("few").alias("least")), "sizes")
    rare = grouped.join(sizes, "g").select("sig", "g", "members", "n", "few", F.explode("rare").alias("token"), "lo", "hi", "least")
    matrix = rare.select("token", F.col("g").alias("mg"), F.col("members").alias("mm"), "lo", "hi", "least").distinct()
    # of two groups the smaller one's sets are the queries, so that each pair of sets meets in one group only
    order = (F.col("members") < F.col("mm")) | ((F.col("members") == F.col("mm")) & (F.col("g") < F.col("mg")))
    fits = (F.col("n") >= F.col("lo") * threshold - 1e-9) & (F.col("n") * threshold <= F.col("hi") + 1e-9)
    met = rare.drop("lo", "hi", "least").join(matrix, "token").where(order & fits).groupBy("sig", "mg", "n").agg(F.count(F.lit(1)).alias("bound"), F.first(F.least("few", "least")).alias("least"))
    queries = w.written(met.where("bound >= least").select("sig", F.col("mg").alias("g"), "n"), "queries")
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    asked = queries.groupBy("g").agg(weight.alias("asked"))
    plan = sizes.join(asked, "g", "left").where("members > 1 OR asked IS NOT NULL").select("g", blocks("weight").alias("mb"), F.coalesce(blocks("asked"), F.lit(1)).alias("qb"))
    part = lambda n: F.pmod(F.xxhash64("sig"), F.col(n)).cast("int")
    inside = grouped.join(plan, "g").select("g", "sig", "rep", "copies", "mb", "qb", part("mb").alias("own"))
    as_col = inside.select("g", "sig", "rep", "copies", F.col("own").alias("i"), "mb", F.explode(F.sequence(F.col("own") + 1, F.col("mb") + F.col("qb") - 1)).alias("j"))
    as_row = inside.where("own > 0").select("g", "sig", "rep", "copies", F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("i"), F.col("own").alias("j"))
    query = queries.select("g", "sig").join(plan, "g").join(grouped.select("sig", "rep", "copies"), "sig")
    query = query.select("g", "sig", "rep", "copies", F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("i"), (F.col("mb") + part("qb")).alias("j"), F.lit(False).alias("col"), (part("qb") == 0).alias("diag"))
    as_row = as_row.withColumns({"col": F.lit(False), "diag": F.lit(False)})
    as_col = as_col.select("g", "sig", "rep", "copies", "i", "j", F.lit(True).alias("col"), (F.col("j") == F.col("mb")).alias("diag"))
    jobs = as_col.unionByName(as_row).unionByName(query)
    jobs = w.written(jobs.groupBy("rep").agg(F.collect_list(F.struct("g", "i", "j", "sig", "copies", "col", "diag")).alias("jobs")), "jobs")
    n_jobs = jobs.agg(F.coalesce(F.sum(F.size("jobs")), F.lit(0))).first()[0]
    chosen = base.join(checked_broadcast(jobs, n_jobs, JOBS), F.col("doc_id") == F.col("rep")).select("jobs", "text")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                lists = part.column(0)
                flat, row = lists.flatten(), np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                packed, own = [b""] * part.num_rows, np.zeros(part.num_rows, np.int64)
                for i, s in gram_sets(part.column(1)):
                    if len(s):
                        packed[i], own[i] = _packed(s), signature(s)
                # an id may have several texts
                keep = np.flatnonzero(own[row] == flat.field("sig").to_numpy())
                flat = flat.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([*(flat.field(c) for c in ("g", "i", "j", "sig", "copies", "col", "diag")), pa.array(packed, pa.binary()).take(pa.array(row[keep]))], ["g", "i", "j", "sig", "copies", "col", "diag", "set"])

    return members, map_arrow(chosen, expand, "g bigint, i int, j int, sig bigint, copies bigint, col boolean, diag boolean, set binary")


def similar_sets(docs: DataFrame, threshold: float = THRESHOLD, id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(members, pairs): members (sig, doc_id) of each set, and pairs (a, b, shared, total) of different sets at or above the threshold, each once.

    The result is in the shared folder.  Documents that are null, empty or without a word, and those with a null id, have no
    set and so no partner.  Repeated rows count once; an id with several texts has several sets.  Texts are whole, however long.
    An empty table has no sets; of the columns only ``id`` and ``text`` are read, whatever names the others have.
    """
    with Workspace() as w:
        members, jobs = _jobs(docs, threshold, id, text, w)
        pairs = jobs.groupBy("g", "i", "j").applyInArrow(lambda t: _Job(t).listed(threshold), "a bigint, b bigint, shared bigint, total bigint")
        return members, w.kept(pairs, "pairs")


def similar_pairs(docs: DataFrame, threshold: float = THRESHOLD, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, other_id, jaccard) for each pair of documents at or above the threshold, doc_id < other_id; see ``similar_sets``.

    This expands copies: n of them are n²/2 rows.  ``linked`` says the same in a row for each document.
    """
    members, pairs = similar_sets(docs, threshold, id, text)
    a, b = members.select(F.col("sig").alias("a"), "doc_id"), members.select(F.col("sig").alias("b"), F.col("doc_id").alias("other_id"))
    near = pairs.join(a, "a").join(b, "b").select(F.least("doc_id", "other_id").alias("doc_id"), F.greatest("doc_id", "other_id").alias("other_id"), F.round(F.col("shared") / F.col("total"), 6).alias("jaccard")).where("doc_id <> other_id")
    same = a.join(b, F.col("a") == F.col("b")).where("doc_id < other_id").select("doc_id", "other_id", F.lit(1.0).alias("jaccard"))
    return near.union(same)


def components(pairs: DataFrame, w: Workspace) -> DataFrame:
    """(sig, root) for each set of the pairs (a, b): the lowest set of its connected component; lowest labels spread along pairs and jump to their labels' labels, so the rounds grow with the logarithm of a chain."""
    edges = w.written(pairs.select("a", "b").union(pairs.select("b", "a")).where("a <> b"), "edges")
    labels = w.written(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "sig"), "labels")
    while True:
        spread = edges.join(labels.withColumnRenamed("sig", "b"), "b").groupBy(F.col("a").alias("sig")).agg(F.min("root").alias("low"))
        hop = labels.select(F.col("sig").alias("root"), F.col("root").alias("jump"))
        step = labels.join(spread, "sig").join(hop, "root", "left").select("sig", F.least("root", "low", "jump").alias("root"), F.col("root").alias("was"))
        step = w.written(step, "labels")
        labels = step.select("sig", "root")
        if step.where("root <> was").isEmpty():
            return labels


def linked(docs: DataFrame, threshold: float = THRESHOLD, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id, links): a row for each document that has a partner at or above the threshold.

    ``links`` is the number of its partners: every pair of documents counts, those of copies and those of different texts, though
    none is listed.  ``class_id`` is the lowest id of all documents that pairs lead to.  Documents without a partner have no row; so have null,
    empty and wordless texts and null ids.  Repeated rows count once; an id with several texts has a row for each of
    them that has partners.  Texts are whole; an empty table gives an empty result; other columns are not read.
    """
    with Workspace() as w:
        members, jobs = _jobs(docs, threshold, id, text, w)
        found = jobs.groupBy("g", "i", "j").applyInArrow(lambda t: _Job(t).counted(threshold), "sig bigint, links bigint, root bigint")
        found = w.written(found, "found")
        roots = components(found.select(F.col("sig").alias("a"), F.col("root").alias("b")), w)
        links = found.groupBy("sig").agg(F.sum("links").alias("links"))
        sets = members.groupBy("sig").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first"))
        sets = sets.join(links, "sig", "left").where("links IS NOT NULL OR copies > 1").join(roots, "sig", "left")
        sets = w.written(sets.select("sig", "first", F.coalesce("root", "sig").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")), "linked")
        classes = sets.groupBy("root").agg(F.min("first").alias("class_id"))
        classed = sets.join(classes, "root").select("sig", "class_id", "links")
        return w.kept(members.join(classed, "sig").select("doc_id", "class_id", "links"), "classes")


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without all but the document with the lowest id in each group of documents linked by pairs; of repeated rows with one id all stay or go."""
    extra = Workspace.kept(linked(docs, threshold).where("doc_id <> class_id").select("doc_id").distinct(), "extra")
    return without(docs, extra)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose trigram set has a Jaccard coefficient of at least 0.5 with another's: its class and how many such others there are."""
    return linked(table(spark, sf_dir, "documents"))


def sql_classes(docs: str, name: str) -> str:
    """DuckDB CTEs, for a WITH RECURSIVE, that leave (doc_id, class_id, links) of ``docs`` in ``name``."""
    split = "list_filter(regexp_split_to_array(lower(text), '[^0-9a-z\\x{80}-\\x{10FFFF}]+'), lambda x: x <> '')"
    return f"""{name}_w AS (SELECT doc_id, {split} AS w FROM {docs} WHERE doc_id IS NOT NULL AND text IS NOT NULL),
{name}_s AS (SELECT DISTINCT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(2, len(w) - 1)::BIGINT), lambda i: array_to_string(w[i:i+2], ' ')))) AS g FROM {name}_w WHERE len(w) > 0),
{name}_k AS MATERIALIZED (SELECT row_number() OVER () AS k, min(doc_id) AS lowest, list(doc_id) AS ids, len(g) AS n, g FROM {name}_s GROUP BY g),
{name}_e AS (SELECT k, n, unnest(g) AS t FROM {name}_k),
{name}_p AS (SELECT x.k AS a, y.k AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS c FROM {name}_e x JOIN {name}_e y ON x.t = y.t AND x.k < y.k AND y.n BETWEEN {THRESHOLD} * x.n AND x.n / {THRESHOLD} GROUP BY x.k, y.k),
{name}_q AS MATERIALIZED (SELECT a, b FROM {name}_p WHERE c >= {THRESHOLD} * (na + nb - c)),
{name}_l AS MATERIALIZED (SELECT a, b FROM {name}_q UNION ALL SELECT b, a FROM {name}_q),
{name}_r(a, b) AS (SELECT a, b FROM {name}_l UNION SELECT r.a, l.b FROM {name}_r r JOIN {name}_l l ON l.a = r.b),
{name}_n AS (SELECT a AS k, sum(len(ids))::BIGINT AS links FROM {name}_l JOIN {name}_k ON k = b GROUP BY a),
{name}_c AS (SELECT r.a AS k, min(lowest) AS lowest FROM {name}_r r JOIN {name}_k y ON y.k = r.b GROUP BY r.a),
{name} AS (SELECT doc_id, class_id, links FROM (SELECT unnest(ids) AS doc_id, least(x.lowest, coalesce(c.lowest, x.lowest)) AS class_id, coalesce(links, 0) + len(ids) - 1 AS links FROM {name}_k x LEFT JOIN {name}_n n ON n.k = x.k LEFT JOIN {name}_c c ON c.k = x.k) WHERE links > 0)"""


OP4_SQL = f"WITH RECURSIVE {sql_classes('documents', 'classes')} SELECT doc_id, class_id, links FROM classes"
