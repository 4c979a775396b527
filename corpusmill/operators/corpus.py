"""Relational operators over a corpus of files: selection, roll-ups, ordering, packing, propagation, the reference graph."""

from __future__ import annotations

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.functions import names as N
from corpusmill.functions.text import MASK, entry_rank
from corpusmill.functions.udf import vectorized
from corpusmill.operators.order import fresh, numbered, pack, pack_best  # noqa: F401

#: A bare token found in more blocks than this is a name, not a secret.
MOST_BLOCKS = 8
#: Names defined by more files than this link nothing; a file's references to one name count so often at most.
MOST_DEFINERS, MOST_WEIGHT = 5, 5
DAMPING, ROUNDS = 0.85, 30
#: Definitions of linking names up to which the names are broadcast.
NAMES = 2_000_000
#: Bytes of secrets that are broadcast at a time; more of them are masked in several passes.
SECRET_BYTES = 16 << 20


def select_files(files: DataFrame, selection: DataFrame) -> DataFrame:
    """The files of a selection of paths; paths that aren't there are passed over."""
    return files.join(selection.select("rel"), "rel", "left_semi")


def curate(included: DataFrame, excluded: DataFrame, scanned: DataFrame | None = None) -> DataFrame:
    """The paths of a curation: those included and not excluded, and of a saved one only those that a scan found again."""
    chosen = included.select("rel").distinct().join(excluded.select("rel"), "rel", "left_anti")
    return chosen if scanned is None else chosen.join(scanned.select("rel"), "rel", "left_semi")


def rescue(kept: DataFrame, skips: DataFrame, forced: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, skips) once the forced paths, if there are such files, count as kept."""
    found = files.join(forced.select("rel"), "rel", "left_semi")
    return kept.unionByName(found.join(kept.select("rel"), "rel", "left_anti"), allowMissingColumns=True), skips.join(found.select("rel"), "rel", "left_anti")


def path_order(rel: str = "rel") -> list[Column]:
    """Order by path components, so that a folder's files come before those of a folder whose name it begins."""
    return [F.split(rel, "/")]


def read_order(ordering: str, rel: str = "rel") -> list[Column]:
    """Sort columns of an ordering: path, entry-first or important-last, which is its exact reverse."""
    parts, rank = F.split(rel, "/"), entry_rank(rel)
    if ordering == "path":
        return [parts.asc()]
    if ordering == "entry-first":
        return [rank.asc(), parts.asc()]
    if ordering == "important-last":
        return [rank.desc(), parts.desc()]
    raise ValueError(f"unknown ordering {ordering}")


def roll_up(files: DataFrame, rel: str = "rel", tokens: str = "tokens") -> DataFrame:
    """(dir, files, tokens) of each folder, over all that is under it; '' is the root."""
    parts = F.split(rel, "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return files.select(F.explode(folders).alias("dir"), F.col(tokens)).groupBy("dir").agg(F.count(F.lit(1)).alias("files"), F.sum(tokens).alias("tokens"))


def tri_state(files: DataFrame, excluded: Column, rel: str = "rel") -> DataFrame:
    """(dir, state): whether none, some or all of the files under a folder are excluded."""
    parts = F.split(rel, "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    n, x = F.count(F.lit(1)), F.count_if("x")
    return files.select(F.explode(folders).alias("dir"), excluded.alias("x")).groupBy("dir").agg(F.when(x == 0, "none").when(x == n, "all").otherwise("some").alias("state"))


def known_in_few(tokens: DataFrame, blocks: DataFrame, known: DataFrame, most: int = MOST_BLOCKS) -> DataFrame:
    """(token, blocks): bare tokens, not known yet, that are part of 1 to ``most`` blocks.

    One pass over the blocks finds all tokens at once by a search automaton and gives (token, rel), which is then counted.
    The tokens are broadcast, at most SECRET_BYTES at a time; more of them take more passes.
    """
    fresh_ = tokens.select("token").where("token <> ''").distinct().join(known.select("token").distinct(), "token", "left_anti")
    base = blocks.select("rel", "text").where("text IS NOT NULL")
    found: DataFrame | None = None
    shard: list[str] = []
    held = 0

    def hits() -> DataFrame:
        got = base.select("rel", F.explode(_found(base.sparkSession, shard, F.col("text"))).alias("token"))
        return got if found is None else found.union(got)

    for row in fresh_.toLocalIterator():
        size = len(row.token.encode())
        if shard and held + size > SECRET_BYTES:
            found = hits()
            shard, held = [], 0
        shard.append(row.token)
        held += size
    found = hits()
    return found.distinct().groupBy("token").agg(F.count(F.lit(1)).alias("blocks")).where(F.col("blocks").between(1, most))


def _found(spark: SparkSession, tokens: list[str], text: Column) -> Column:
    """Which of these tokens are part of the text."""
    shared = spark.sparkContext.broadcast(tokens)
    held: list = []

    @vectorized("array<string>")
    def found(texts: pd.Series) -> pd.Series:
        if not held:
            import ahocorasick

            a = ahocorasick.Automaton()
            for i, s in enumerate(shared.value):
                a.add_word(s, i)
            a.make_automaton()
            held.append(a)
        return texts.map(lambda t: [shared.value[i] for i in sorted({i for _, i in held[0].iter(t)})] if shared.value else [])

    return found(text)


def propagate(blocks: DataFrame, secrets: DataFrame, text: str = "text", into: str = "text", hits: str | None = None) -> DataFrame:
    """``blocks`` with every known secret masked wherever it occurs, the longest first, and of the same length in their order.

    Each is replaced over the whole text before the next one is looked for, so a secret that only a mask makes up is found as
    well.  ``hits`` names a column for the number of occurrences that were masked.  The secrets are broadcast in that order, at most
    SECRET_BYTES of them at a time, each time to one search automaton in Arrow batches; between such passes the blocks are checkpointed.
    """
    from corpusmill.plans.storage import checkpoint

    order = secrets.select("token").where("token <> ''").distinct().orderBy(F.octet_length("token").desc(), "token")
    made, n = fresh(blocks, "made"), fresh(blocks, "n")
    out = blocks.withColumn(made, F.col(text)).withColumn(n, F.lit(0))
    shard: list[str] = []
    held = passes = 0

    def masked(df: DataFrame) -> DataFrame:
        df = checkpoint(df) if passes else df
        m = fresh(df, "m")
        df = df.withColumn(m, _mask_all(df.sparkSession, shard, F.col(made)))
        return df.withColumn(made, F.col(f"{m}.text")).withColumn(n, F.col(n) + F.col(f"{m}.n")).drop(m)

    for row in order.toLocalIterator():
        size = len(row.token.encode())
        if shard and held + size > SECRET_BYTES:
            out = masked(out)
            shard, held, passes = [], 0, passes + 1
        shard.append(row.token)
        held += size
    if shard:
        out = masked(out)
    out = out.withColumn(into, F.col(made))
    return (out if hits is None else out.withColumn(hits, F.col(n))).drop(made, *([] if hits == n else [n]))


def _mask_all(spark: SparkSession, secrets: list[str], text: Column) -> Column:
    """(text, n): the text with these secrets masked in their order, and how many occurrences there were."""
    shared = spark.sparkContext.broadcast(secrets)
    held: list = []

    @vectorized("struct<text:string,n:int>")
    def masked(texts: pd.Series) -> pd.DataFrame:
        if not held:
            import ahocorasick

            a = ahocorasick.Automaton()
            for i, s in enumerate(shared.value):
                a.add_word(s, i)
            a.make_automaton()
            # what a mask and the text beside it may make up, so that the text before masking doesn't tell
            ends = [MASK[:i] for i in range(1, len(MASK))], [MASK[i:] for i in range(1, len(MASK))]
            held.extend((a, {i for i, s in enumerate(shared.value) if s in MASK or MASK in s or s.endswith(tuple(ends[0])) or s.startswith(tuple(ends[1]))}))
        automaton, made = held

        def one(t: str | None) -> tuple[str | None, int]:
            n = 0
            if t:
                for i in sorted({i for _, i in automaton.iter(t)} | made):
                    n += t.count(shared.value[i])
                    t = t.replace(shared.value[i], MASK)
            return t, n

        found = [one(t) for t in texts]
        return pd.DataFrame({"text": [x[0] for x in found], "n": [x[1] for x in found]})

    return masked(text)


def definers(defs: DataFrame) -> DataFrame:
    """(name, path): which files define a name that is worth a link."""
    usable = (F.length("name") >= 3) & ~F.lower("name").isin(*sorted(N.NAME_STOPWORDS))
    d = defs.where(usable).select("name", "path").distinct()
    return d.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("name"))).where(F.col("n") <= MOST_DEFINERS).select("name", "path")


def reference_edges(defs: DataFrame, refs: DataFrame) -> DataFrame:
    """(src, dst, w): how much a file refers to another; each name counts MOST_WEIGHT times at most.

    Most references are to names that link nothing, so those are left out before any are counted or sent over the network.  The names that
    link are few and broadcast; beyond NAMES of them the references are shuffled by name instead.
    """
    from corpusmill.plans.storage import checkpoint

    linking = checkpoint(definers(defs))
    names = linking.select("name").distinct()
    usable = refs.join(F.broadcast(names) if linking.count() <= NAMES else names, "name", "left_semi")
    uses = usable.groupBy("path", "name").agg(F.least(F.count(F.lit(1)), F.lit(MOST_WEIGHT)).alias("w"))
    links = uses.withColumnRenamed("path", "src").join(linking.withColumnRenamed("path", "dst"), "name").where("src <> dst")
    return links.groupBy("src", "dst").agg(F.sum("w").cast("double").alias("w"))


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(path, rank): PageRank with even teleports over the distinct nodes; what files without references hold is spread evenly.

    Each source's shares are one row, partitioned by source once and kept on disk like that; a round looks its ranks up by hash, so it sorts no
    edges, and moves only ranks and their sums by target.  What unlinked nodes hold is summed over the written ranks of a round, and the next
    round takes it as a constant.
    """
    from corpusmill.plans.storage import checkpoint

    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = edges.groupBy("src").agg(F.sum("w").alias("total"), F.collect_list(F.struct("dst", "w")).alias("links"))
    weighed = checkpoint(own.select("src", F.transform("links", lambda x: F.struct(x["dst"].alias("dst"), (x["w"] / F.col("total")).alias("share"))).alias("links")))
    shares = weighed.repartition(parts, "src").persist(StorageLevel.DISK_ONLY)
    linked = weighed.select(F.col("src").alias("path"), F.lit(True).alias("linked"))
    ranks = checkpoint(nodes.select("path").distinct().join(linked, "path", "left").select("path", F.coalesce("linked", F.lit(False)).alias("linked")))
    n = max(ranks.count(), 1)
    loose = ranks.where("NOT linked").count() / n
    ranks = ranks.withColumn("rank", F.lit(1.0 / n))
    for _ in range(rounds):
        now = ranks.select(F.col("path").alias("src"), "rank").repartition(parts, "src").hint("shuffle_hash")
        given = shares.join(now, "src").select("rank", F.explode("links").alias("link"))
        got = given.groupBy(F.col("link.dst").alias("path")).agg(F.sum(F.col("link.share") * F.col("rank")).alias("got"))
        rank = F.lit((1 - DAMPING) / n + DAMPING * loose / n) + DAMPING * F.coalesce("got", F.lit(0.0))
        ranks = checkpoint(ranks.select("path", "linked").join(got, "path", "left").select("path", "linked", rank.alias("rank")))
        loose = ranks.where("NOT linked").agg(F.sum("rank")).first()[0] or 0.0
    shares.unpersist()
    return ranks.select("path", "rank")


def grep(files: DataFrame, pattern: str, most: int = 100, width: int = 400, rel: str = "rel", text: str = "text") -> DataFrame:
    """(rel, line, hit): the first ``most`` lines, by path, line and text, that match; each cut to ``width`` characters."""
    from corpusmill.functions.text import lines

    hits = files.select(rel, F.posexplode(lines(text)).alias("line", "hit")).where(F.col("hit").rlike(pattern))
    return hits.orderBy(F.split(rel, "/"), "line", "hit").limit(most).select(rel, (F.col("line") + 1).alias("line"), F.substring("hit", 1, width).alias("hit"))


def slice_lines(files: DataFrame, offset: int, count: int = 200, most_bytes: int = 200 * 1024, rel: str = "rel", text: str = "text") -> DataFrame:
    """(rel, line, text): ``count`` lines of each file from number ``offset`` on, 1000 at most, while they take at most ``most_bytes``."""
    from corpusmill.functions.text import lines

    w = Window.partitionBy(rel).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    part = F.slice(lines(text), offset, min(count, 1000))
    rows = files.where(F.size(lines(text)) >= offset).select(rel, F.posexplode(part).alias("line", "l"))
    return rows.withColumn("bytes", F.sum(F.octet_length("l") + 1).over(w)).where(F.col("bytes") <= most_bytes).select(rel, (F.col("line") + offset).alias("line"), F.col("l").alias("text"))


def windowed_lines(docs: DataFrame, words: tuple[str, ...] = N.CONTEXT_WORDS, id: str = "doc_id", text: str = "text", back: int = 2) -> DataFrame:
    """(doc_id, line, open): whether a context word is on a line or one of the ``back`` lines before it."""
    from corpusmill.functions.text import has_any, lines

    rows = docs.select(id, F.posexplode(lines(text)).alias("line", "l"))
    w = Window.partitionBy(id).orderBy("line").rowsBetween(-back, 0)
    return rows.select(id, (F.col("line") + 1).alias("line"), F.max(has_any(F.lower("l"), words)).over(w).alias("open"))


def debounced(events: DataFrame, gap: str, ts: str = "ts", key: str = "user_id") -> DataFrame:
    """(key, start, end, events): runs of events without a pause of ``gap``; with a watermark also over a stream."""
    return events.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("events")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def virtual_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, rel, name, size, text): the documents as files of a tree; names and extensions cycle through all kinds."""
    from corpusmill.plans.views import FILE_NAME

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.selectExpr("doc_id", f"source || '/' || lang || '/' || {FILE_NAME} AS rel", f"{FILE_NAME} AS name", "cast(octet_length(text) as bigint) AS size", "text")
