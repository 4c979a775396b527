"""Quality classifier: an interpolated modified Kneser-Ney n-gram model (Chen and Goodman, 1999) of trusted text.

The units are bytes and the order is five, so that case, punctuation, spacing and the shape of words all count and the tables
grow with the languages in the corpus rather than with its names.  Trusted documents are those labelled as good; a fixed
share of them, chosen by id hash, isn't trained on and sets the thresholds, as the model knows its own training text too well.

Scoring is by sharded count joins.  No task holds the model: each block of documents sends its distinct n-grams to the
shards of the count tables, a join by n-gram, and gets back the log-probabilities of those that it has.  They are written to
the shared folder by block, and the block's documents are scored against them.  A block is BLOCK_ROWS successive rows of an input file, so a scan
meets one block after the other, however files are split.  What moves is each block's distinct n-grams, not its text.  All sums are of whole numbers, so results don't depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.llm.common import Workspace, checked_broadcast, filesystem, hash60, map_arrow, scratch, table, without
from corpusmill.llm.tokens import as_strings, buffers, pieces

ORDER = 5
#: Log-probabilities are kept in whole 1 / SCALE nats.
SCALE = 10_000
#: One trusted document in so many sets thresholds instead of training the model.
HELD_OUT = 5
#: Quantile of the held-out documents' deviations beyond which a document is rejected, and its rows at least in a language.
HIGH, LEAST_HELD = 0.99, 20
#: A text of so many positions has half the variance of its loss from its shortness, so deviations count sqrt(n / (n + SHORT)).
SHORT = 1000
#: Rows of a block, and distinct n-grams that a task holds of one before it sends them.
BLOCK_ROWS, HELD_GRAMS = 50_000, 4_000_000
_TAG = 40


def key(order: int, gram: np.ndarray) -> np.ndarray:
    """The key of byte n-grams: their bytes, most significant first, and the order above bit 40."""
    return gram | np.int64(order << _TAG)


def positions(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(5-grams of all texts in turn, bounds): row i has grams[bounds[i]:bounds[i+1]]; texts of fewer bytes have none."""
    raw, offsets = buffers(strings)
    n = np.maximum(np.diff(offsets) - ORDER + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(n)])
    if not bounds[-1]:
        return np.zeros(0, np.int64), bounds
    g = np.zeros(len(raw) - ORDER + 1, np.int64)
    for i in range(ORDER):
        g <<= 8
        g |= raw[i : len(raw) - ORDER + 1 + i]
    keep = np.zeros(len(raw) + 1, np.int32)
    some = np.flatnonzero(n > 0)
    keep[offsets[some]] += 1
    keep[offsets[some] + n[some]] -= 1
    return g[np.cumsum(keep)[: len(g)] > 0], bounds


class _Grams:
    """Distinct 5-grams and their counts, gathered in bounded memory."""

    def __init__(self) -> None:
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, g: np.ndarray) -> None:
        if len(g):
            u, c = np.unique(g, return_counts=True)
            self.waiting.append((u, c))
            self.held += len(u)
            if self.held > max(1_000_000, len(self.keys)):
                self.merge()

    def merge(self) -> None:
        k = np.concatenate([self.keys, *(u for u, _ in self.waiting)])
        c = np.concatenate([self.counts, *(c for _, c in self.waiting)])
        order = np.argsort(k, kind="stable")
        k, c = k[order], c[order]
        first = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
        self.keys, self.counts = k[first], np.add.reduceat(c, np.flatnonzero(first)) if len(k) else c
        self.waiting, self.held = [], 0


def count_grams(texts: DataFrame) -> DataFrame:
    """(g, c): the byte 5-grams of the column ``text`` with their counts; counts are combined in each task before they move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = _Grams()
        for batch in batches:
            s = as_strings(batch.column(0))
            for a, b in pieces(s):
                grams.add(positions(s.slice(a, b - a))[0])
        grams.merge()
        for lo in range(0, len(grams.keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(grams.keys[lo : lo + 100_000]), pa.array(grams.counts[lo : lo + 100_000])], ["g", "c"])

    return map_arrow(texts.select("text").where("text IS NOT NULL"), run, "g bigint, c bigint").groupBy("g").agg(F.sum("c").alias("c"))


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(k, lp, bo) from (g, c): log-probabilities of the n-grams of all orders and log back-off weights of those that are contexts.

    ``k`` is the key of an n-gram.  ``lp`` is null for n-grams that are only contexts, ``bo`` for those that are no context; a
    missing ``bo`` stands for 0, back-off without loss.  Orders below the highest count distinct left neighbours.  A discount
    that the counts of counts don't give is half of its count; all lie between a tenth of it and it, so no n-gram has probability 0.
    """
    with Workspace() as w:
        return _kneser_ney(counts, w)


def _kneser_ney(counts: DataFrame, work: Workspace) -> DataFrame:
    level = {ORDER: work.written(counts.select("g", "c"), "counts")}
    for n in range(ORDER - 1, 0, -1):
        level[n] = work.written(level[n + 1].groupBy(F.expr(f"g & {(1 << 8 * n) - 1}L").alias("g")).agg(F.count(F.lit(1)).alias("c")), "counts")
    parts: list[DataFrame] = []
    below: DataFrame | None = None
    for n in range(1, ORDER + 1):
        d = level[n].agg(*[F.count_if(F.col("c") == i).cast("double").alias(f"n{i}") for i in range(1, 5)])
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))

        def discount(i: int, y: Column = y) -> Column:
            made = F.lit(float(i)) - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}")
            return F.when((F.col("n1") > 0) & (F.col(f"n{i}") > 0), F.greatest(F.lit(i / 10), F.least(F.lit(float(i)), made))).otherwise(i / 2).alias(f"d{i}")

        d = d.select(*[discount(i) for i in (1, 2, 3)])
        ctx = F.expr("g >> 8")
        w = Window.partitionBy("h")
        t = level[n].withColumn("h", ctx).crossJoin(F.broadcast(d))
        t = t.select("g", "h", "c", "d1", "d2", "d3", F.sum("c").over(w).alias("total"), *[F.count_if(F.col("c") == i if i < 3 else F.col("c") >= 3).over(w).alias(f"m{i}") for i in (1, 2, 3)])
        own = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        t = t.select("g", "h", (F.greatest(F.col("c") - own, F.lit(0.0)) / F.col("total")).alias("p"), ((F.col("d1") * F.col("m1") + F.col("d2") * F.col("m2") + F.col("d3") * F.col("m3")) / F.col("total")).alias("gamma"))
        if below is None:
            t = t.withColumn("p", F.col("p") + F.col("gamma") / 256.0)
        else:
            t = t.withColumn("s", F.expr(f"g & {(1 << 8 * (n - 1)) - 1}L")).join(below, "s").withColumn("p", F.col("p") + F.col("gamma") * F.col("q"))
        t = work.written(t.select("g", "h", "p", "gamma"), f"kn-{n}")
        parts.append(t.select(F.expr(f"g | {n << _TAG}L").alias("k"), _log("p").alias("lp"), F.lit(None).cast("int").alias("bo")))
        parts.append(t.groupBy("h").agg(F.first("gamma").alias("gamma")).select(F.expr(f"h | {(n - 1) << _TAG}L").alias("k"), F.lit(None).cast("int").alias("lp"), _log("gamma").alias("bo")))
        below = t.select(F.col("g").alias("s"), F.col("p").alias("q"))
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.union(p)
    return work.kept(all_.groupBy("k").agg(F.max("lp").alias("lp"), F.max("bo").alias("bo")), "kn-model")


#: The log of a back-off weight or probability of 0.
_FLOOR = -30.0


def _log(c: str) -> Column:
    return F.rint(F.when(F.col(c) > 0, F.greatest(F.ln(c), F.lit(_FLOOR))).otherwise(_FLOOR) * SCALE).cast("int")


def resolve(grams: np.ndarray, k: np.ndarray, lp: np.ndarray, bo: np.ndarray) -> np.ndarray:
    """Log-probabilities of 5-grams from the found keys (sorted), by backing off; ``lp`` and ``bo`` hold a mark below any log where there is none."""
    none = np.iinfo(np.int32).min
    out = np.zeros(len(grams), np.int64)
    open_ = np.ones(len(grams), bool)

    def find(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
        if not len(k):
            return np.full(len(keys), none, np.int64)
        at = np.minimum(np.searchsorted(k, keys), len(k) - 1)
        return np.where(k[at] == keys, values[at], none)

    for n in range(ORDER, 0, -1):
        g = grams & np.int64((1 << 8 * n) - 1)
        v = find(key(n, g), lp)
        hit = open_ & (v != none)
        out[hit] += v[hit]
        open_ &= ~hit
        b = find(key(n - 1, g >> 8), bo)
        back = open_ & (b != none)
        out[back] += b[back]
    out[open_] += int(np.rint(-np.log(256.0) * SCALE))
    return out


def _suffixes(g: np.ndarray) -> np.ndarray:
    """All keys that backing off from these 5-grams can ask for: each order's n-grams and contexts."""
    found = [key(ORDER, g)]
    left = g
    for n in range(ORDER, 0, -1):
        found.append(key(n - 1, np.unique(left >> 8)))
        left = np.unique(left & np.int64((1 << 8 * (n - 1)) - 1))
        found.append(key(n - 1, left))
    return np.unique(np.concatenate(found))


class _Table:
    """Values by 5-gram, for many look-ups at once: open addressing in arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(8, (2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
        at = self._first(keys)
        left = np.arange(len(keys))
        while len(left):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[left[free]]
            own = self.keys[at] == keys[left]
            self.values[at[own]] = values[left[own]]
            at, left = (at[~own] + 1) & self.mask, left[~own]

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, whether there): 0 for keys that aren't there."""
        at = self._first(keys)
        held = self.keys[at]
        hit = held == keys
        out = np.where(hit, self.values[at], 0)
        left = np.flatnonzero(~hit & (held != -1))
        at = at[left]
        while len(left):
            at = (at + 1) & self.mask
            held = self.keys[at]
            same = held == keys[left]
            out[left[same]], hit[left[same]] = self.values[at[same]], True
            more = ~same & (held != -1)
            at, left = at[more], left[more]
        return out, hit


def score(docs: DataFrame, model: DataFrame, work: Workspace, text: str = "text") -> DataFrame:
    """``docs`` with ``__lp``, the sum of the log-probabilities of a text's 5-grams in 1 / SCALE nats, and ``__n``, their number; 0 for null texts and those of under five bytes.

    Rows that aren't read from files are written to some first.
    """
    spark = docs.sparkSession
    path = scratch(spark, "answers")
    work.paths.append(path)

    def placed(df: DataFrame) -> DataFrame:
        at = df.metadataColumn("_metadata")
        return df.withColumn("__block", F.xxhash64(at["file_path"], F.floor(at["row_index"] / BLOCK_ROWS)))

    try:
        blocked = placed(docs)
        blocked.schema  # noqa: B018
    except AnalysisException:
        blocked = placed(work.written(docs, "texts"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: int | None = None
        grams = _Grams()

        def sent() -> Iterator[pa.RecordBatch]:
            grams.merge()
            keys = _suffixes(grams.keys)
            for lo in range(0, len(keys), 100_000):
                part = keys[lo : lo + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), own)), pa.array(part)], ["block", "k"])

        for batch in batches:
            for value, strings in _by_block(batch.column(0), batch.column(1)):
                if own is not None and (own != value or len(grams.keys) > HELD_GRAMS):
                    yield from sent()
                    grams = _Grams()
                own = value
                for a, b in pieces(strings):
                    grams.add(positions(strings.slice(a, b - a))[0])
        if own is not None:
            yield from sent()

    asked = map_arrow(blocked.select("__block", F.col(text).cast("string")), ask, "block bigint, k bigint")
    answers = asked.join(model, "k").select("block", "k", "lp", "bo")
    answers = answers.repartition("block").dropDuplicates(["block", "k"])
    answers.sortWithinPartitions("block", "k").write.partitionBy("block").parquet(path)
    none = np.iinfo(np.int32).min

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = filesystem(path)
        import pyarrow.fs as pafs

        own: int | None = None
        for batch in batches:
            names = batch.schema.names
            sums, counts = [], []
            for value, strings in _by_block(batch.column(names.index("__block")), batch.column(names.index("__text"))):
                if own != value:
                    own = value
                    k, lp, bo = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
                    folder = f"{at}/block={own}"
                    if fs.get_file_info(folder).type == pafs.FileType.Directory:
                        t = pads.dataset(folder, filesystem=fs, format="parquet").to_table(columns=["k", "lp", "bo"])
                        order = np.argsort(t["k"].to_numpy(), kind="stable")
                        k, lp, bo = t["k"].to_numpy()[order], t["lp"].fill_null(none).to_numpy()[order], t["bo"].fill_null(none).to_numpy()[order]
                    five = k[k >> _TAG == ORDER] & np.int64((1 << _TAG) - 1)
                    known = _Table(five, resolve(five, k, lp, bo))
                for a, b in pieces(strings):
                    g, bounds = positions(strings.slice(a, b - a))
                    v, hit = known.find(g)
                    if not hit.all():
                        u, inverse = np.unique(g[~hit], return_inverse=True)
                        v[~hit] = resolve(u, k, lp, bo)[inverse]
                    run = np.concatenate([[0], np.cumsum(v)])
                    sums.append(run[bounds[1:]] - run[bounds[:-1]])
                    counts.append(np.diff(bounds))
            keep = [i for i, x in enumerate(names) if x not in ("__block", "__text")]
            if sums:
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(np.concatenate(sums)), pa.array(np.concatenate(counts))], [*(names[i] for i in keep), "__lp", "__n"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text)
    return map_arrow(blocked.withColumn("__text", F.col(text).cast("string")).drop(text), tell, f"{schema}, __lp bigint, __n bigint")


def _by_block(block: pa.Array, text: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(block, texts) of the runs of rows of one block."""
    values, strings = block.to_numpy(), as_strings(text)
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else values
    for a, b in zip(starts, [*starts[1:], len(values)], strict=True):
        yield int(values[a]), strings.slice(a, b - a)


def judge(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, lang, n_grams, perplexity, deviation, keep), a row for each row of ``docs``.

    ``perplexity`` is a byte's.  ``deviation`` is how far the mean loss lies above the median of the language's held-out trusted
    documents, in tenths of milli-nats, less for short texts (SHORT); ``keep`` is whether it is at most the language's HIGH
    quantile of the same n documents, raised by the share 2 / sqrt(n).  Null texts and those of under five bytes have null perplexity and are kept, as nothing
    speaks against them.  Documents of a language with under LEAST_HELD held-out documents, null among them, are judged by all
    held-out documents; without any trusted document all are kept.  Repeated rows are judged each; labels that
    contradict each other don't make a document trusted.  Texts are whole; an empty table gives an empty result; no other columns are read.
    """
    with Workspace() as work:
        good = labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 AND coalesce(t, 0) = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__good"))
        good = work.written(good, "trusted")
        held_out = F.pmod(hash60("doc_id"), F.lit(HELD_OUT)) == 0
        base = docs.select(F.col(id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).cast("string").alias("text"))
        train = base.where(~held_out).join(checked_broadcast(good), F.col("doc_id") == F.col("__good"), "left_semi")
        model = _kneser_ney(count_grams(train), work)
        scored = work.kept(score(base, model, work), "scores")
        trusted = scored.where(held_out & (F.col("__n") > 0)).join(checked_broadcast(good), F.col("doc_id") == F.col("__good"), "left_semi")
        loss = F.floor(-F.col("__lp") * F.lit(10_000.0 / SCALE) / F.col("__n"))

        def deviation(median: Column) -> Column:
            return F.floor((-F.col("__lp") * F.lit(10_000.0 / SCALE) / F.col("__n") - median) * F.sqrt(F.col("__n") / (F.col("__n") + F.lit(float(SHORT))))).cast("int")

        def limits(by: list[str], name: str) -> DataFrame:
            medians = trusted.groupBy(*by).agg(F.percentile(loss, F.lit(0.5)).alias("m"), F.count(F.lit(1)).alias("rows")).select(*[F.col(c).alias(f"__{c}") for c in by], "m", "rows")
            medians = work.written(medians, f"{name}-medians").where(F.col("rows") >= (LEAST_HELD if by else 1))
            on = F.lit(True)
            for c in by:
                on &= F.col(c).eqNullSafe(F.col(f"__{c}"))
            near = trusted.join(checked_broadcast(medians), on).withColumn("dev", deviation(F.col("m")))
            # a quantile of few documents is uncertain
            h = F.percentile("dev", F.lit(HIGH)) + F.abs(F.percentile("dev", F.lit(HIGH))) * 2 / F.sqrt(F.count(F.lit(1)))
            return work.kept(near.groupBy(*[f"__{c}" for c in by], "m").agg(h.alias("h")), name)

        own = limits(["lang"], "limits").select("__lang", F.col("m").alias("own_m"), F.col("h").alias("own_h"))
        all_ = limits([], "limit").select(F.col("m").alias("all_m"), F.col("h").alias("all_h"))
        out = scored.join(checked_broadcast(own), F.col("lang").eqNullSafe(F.col("__lang")), "left").join(F.broadcast(all_), how="left")
        known = F.col("own_m").isNotNull()
        dev = F.when(F.col("__n") > 0, deviation(F.when(known, F.col("own_m")).otherwise(F.col("all_m"))))
        keep = dev <= F.when(known, F.col("own_h")).otherwise(F.col("all_h"))
        ppl = F.when(F.col("__n") > 0, F.round(F.exp(-F.col("__lp") / F.lit(float(SCALE)) / F.col("__n")), 4))
        return out.select("doc_id", "lang", F.col("__n").alias("n_grams"), ppl.alias("perplexity"), dev.alias("deviation"), F.coalesce(keep, F.lit(True)).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that ``judge`` rejects; of repeated rows with one id all go if one is rejected, and null ids stay."""
    return without(docs, Workspace.kept(judge(docs, labels).where("NOT keep AND doc_id IS NOT NULL").select("doc_id").distinct(), "rejected"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps, with their perplexities."""
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).where("keep")


def sql_judge(docs: str, name: str) -> str:
    """DuckDB CTEs that leave (doc_id, lang, n_grams, perplexity, deviation, keep) of ``docs`` in ``name``."""
    held = "('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % " + str(HELD_OUT) + " = 0"
    out = [
        f"""{name}_r AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, lang, text FROM {docs}),
{name}_t AS MATERIALIZED (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1 AND coalesce(max(toxic), 0) = 0),
{name}_b AS (SELECT r, unnest(l) AS b, generate_subscripts(l, 1) AS i FROM (SELECT r, string_split(regexp_replace(hex(encode(text)), '(..)', '\\1 ', 'g'), ' ') AS l FROM {name}_r WHERE text IS NOT NULL)),
{name}_g AS MATERIALIZED (SELECT r, b || b1 || b2 || b3 || b4 AS g FROM (SELECT r, b, lead(b, 1) OVER w AS b1, lead(b, 2) OVER w AS b2, lead(b, 3) OVER w AS b3, lead(b, 4) OVER w AS b4 FROM {name}_b WHERE b <> '' WINDOW w AS (PARTITION BY r ORDER BY i)) WHERE b4 IS NOT NULL),
{name}_c5 AS MATERIALIZED (SELECT g, count(*) AS c FROM {name}_g WHERE r IN (SELECT r FROM {name}_r WHERE NOT ({held}) AND doc_id IN (SELECT doc_id FROM {name}_t)) GROUP BY g)"""
    ]
    for n in range(ORDER - 1, 0, -1):
        out.append(f"{name}_c{n} AS MATERIALIZED (SELECT substr(g, 3) AS g, count(*) AS c FROM {name}_c{n + 1} GROUP BY 1)")
    for n in range(1, ORDER + 1):
        d = ", ".join(f"CASE WHEN n1 > 0 AND n{i} > 0 THEN greatest({i / 10}::DOUBLE, least({i}::DOUBLE, {i}.0::DOUBLE - {i + 1} * (n1 / (n1 + 2 * n2)) * n{i + 1} / n{i})) ELSE {i / 2}::DOUBLE END AS d{i}" for i in (1, 2, 3))
        counts = ", ".join(f"count_if(c = {i})::DOUBLE AS n{i}" for i in range(1, 5))
        low = f"p + gamma / 256.0::DOUBLE AS p FROM {name}_w{n}" if n == 1 else f"w.p + gamma * q.p AS p FROM {name}_w{n} w JOIN {name}_p{n - 1} q ON q.g = substr(w.g, 3)"
        g = "g" if n == 1 else "w.g"
        out.append(
            f"""{name}_d{n} AS (SELECT {d} FROM (SELECT {counts} FROM {name}_c{n})),
{name}_w{n} AS MATERIALIZED (SELECT g, h, greatest(c - CASE c WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END, 0) / total AS p, (d1 * m1 + d2 * m2 + d3 * m3) / total AS gamma FROM (
  SELECT g, h, c, d1, d2, d3, sum(c) OVER o AS total, count_if(c = 1) OVER o AS m1, count_if(c = 2) OVER o AS m2, count_if(c >= 3) OVER o AS m3 FROM (SELECT g, c, substr(g, 1, {2 * (n - 1)}) AS h FROM {name}_c{n}), {name}_d{n} WINDOW o AS (PARTITION BY h))),
{name}_p{n} AS MATERIALIZED (SELECT {g} AS g, {low}),
{name}_l{n} AS MATERIALIZED (SELECT g, round_even(CASE WHEN p > 0 THEN greatest(ln(p), {_FLOOR}) ELSE {_FLOOR} END * {SCALE}, 0)::BIGINT AS lp FROM {name}_p{n}),
{name}_o{n - 1} AS MATERIALIZED (SELECT h, round_even(CASE WHEN any_value(gamma) > 0 THEN greatest(ln(any_value(gamma)), {_FLOOR}) ELSE {_FLOOR} END * {SCALE}, 0)::BIGINT AS bo FROM {name}_w{n} GROUP BY h)"""
        )
    lp, joins = str(int(np.rint(-np.log(256.0) * SCALE))), ""
    for n in range(1, ORDER + 1):
        at = 2 * (ORDER - n) + 1
        lp = f"coalesce(l{n}.lp, coalesce(o{n - 1}.bo, 0) + {lp})"
        joins += f" LEFT JOIN {name}_l{n} l{n} ON l{n}.g = substr(u.g, {at}) LEFT JOIN {name}_o{n - 1} o{n - 1} ON o{n - 1}.h = substr(u.g, {at}, {2 * (n - 1)})"
    dev = f"floor((-lp * {10_000 / SCALE}::DOUBLE / n - {{m}}) * sqrt(n / (n + {SHORT}.0::DOUBLE)))::INTEGER"
    loss = f"floor(-lp * {10_000 / SCALE}::DOUBLE / n)"
    limit = f"quantile_cont(dev, {HIGH}) + abs(quantile_cont(dev, {HIGH})) * 2 / sqrt(count(*)::DOUBLE) AS h"
    out.append(
        f"""{name}_u AS MATERIALIZED (SELECT u.g, {lp} AS lp FROM (SELECT DISTINCT g FROM {name}_g) u{joins}),
{name}_s AS MATERIALIZED (SELECT r.r, doc_id, lang, coalesce(lp, 0) AS lp, coalesce(n, 0) AS n FROM {name}_r r LEFT JOIN (SELECT r, sum(lp)::BIGINT AS lp, count(*) AS n FROM {name}_g JOIN {name}_u USING (g) GROUP BY r) s ON s.r = r.r),
{name}_h AS MATERIALIZED (SELECT * FROM {name}_s WHERE {held} AND n > 0 AND doc_id IN (SELECT doc_id FROM {name}_t)),
{name}_m AS (SELECT lang, quantile_cont({loss}, 0.5) AS m FROM {name}_h GROUP BY lang HAVING count(*) >= {LEAST_HELD}),
{name}_q AS (SELECT lang, m, {limit} FROM (SELECT x.lang, m, {dev.format(m='m')} AS dev FROM {name}_h x JOIN {name}_m y ON x.lang IS NOT DISTINCT FROM y.lang) GROUP BY lang, m),
{name}_ma AS (SELECT quantile_cont({loss}, 0.5) AS m FROM {name}_h HAVING count(*) > 0),
{name}_qa AS (SELECT m, {limit} FROM (SELECT m, {dev.format(m='m')} AS dev FROM {name}_h, {name}_ma) GROUP BY m),
{name} AS MATERIALIZED (SELECT doc_id, lang, n AS n_grams, perplexity, dev AS deviation, coalesce(dev <= h, true) AS keep FROM (
  SELECT doc_id, s.lang, n, CASE WHEN n > 0 THEN round(exp(-lp / {SCALE}.0::DOUBLE / n), 4) END AS perplexity, CASE WHEN n > 0 THEN {dev.format(m='CASE WHEN q.m IS NOT NULL THEN q.m ELSE a.m END')} END AS dev, CASE WHEN q.m IS NOT NULL THEN q.h ELSE a.h END AS h
  FROM {name}_s s LEFT JOIN {name}_q q ON s.lang IS NOT DISTINCT FROM q.lang LEFT JOIN {name}_qa a ON true))"""
    )
    return ",\n".join(out)


OP2_SQL = f"WITH {sql_judge('documents', 'judged')} SELECT * FROM judged WHERE keep"
