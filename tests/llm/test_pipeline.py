"""The pipeline's stages on planted cases."""

from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline


def test_stages(spark, tmp_path, prose_of):
    good = [(i, prose_of(80, i), "en", f"s{i % 2}", 1) for i in range(200)]
    junk = [(500 + i, "### !!! ".join(prose_of(80, 300 + i).upper().split()), "en", "s0", 1) for i in range(20)]
    leak = prose_of(25, 900)
    planted = [(600, good[150][1], "en", "s1", 1), (601, good[151][1] + " tail", "en", "s1", 1), (602, prose_of(40, 950) + " " + leak + " " + prose_of(40, 951), "en", "s0", 1), (603, None, None, None, None), (None, "", "de", "s0", 0)]
    spark.createDataFrame(good + junk + planted, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(140)] + [(500 + i, 0, 0) for i in range(10)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, ids = docs.columns, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == (columns if i < 4 else [*columns, "shard"]), name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        ids.append({r.doc_id for r in docs.collect()})
    kept = set(range(200))
    assert not ids[0] & set(range(500, 520)) and len(ids[0] & kept) >= 190 and {600, 601, 602} & ids[0] == {600, 601, 602}
    assert ids[0] - ids[1] == {600, 601} and ids[1] - ids[2] == {602} and ids[2] == ids[3] == ids[4]
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == ids[4]


@pytest.fixture
def folder(spark, labels, tmp_path, prose_of):
    """Labels and a benchmark, whose item is a passage of document 8."""
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(prose_of(50, 4).split()[:25])), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stage_awkward(spark, awkward, folder, name):
    """Nulls, empty and very long texts, ties, repeated rows and clashing columns, in each stage on its own."""
    out = dict(corpus_pipeline.STAGES)[name](spark, awkward, folder)
    assert [c for c in out.columns if c != "shard"] == [c for c in awkward.columns if c != "shard"]
    rows, given = out.collect(), {tuple(map(str, (r.doc_id, r.text, r.lang, r.source, r.n_chars))): r for r in awkward.collect()}
    seen = Counter(tuple(map(str, (r.doc_id, r.text, r.lang, r.source, r.n_chars))) for r in rows)
    # what a stage keeps it keeps whole, the columns it doesn't know included
    assert set(seen) <= set(given) and all(r["copy"] == "z" and r["__leak"] == "z" and r["gone"] == "z" for r in rows)
    ids = Counter(r.doc_id for r in rows)
    assert {None, 3, 4, 7} <= set(ids)
    if name == "quality":
        assert {6, 10} <= set(ids) and ids[1] in (0, 2)
    elif name == "near_duplicates":
        # 1 and 2 are copies: the lower id stays, with both of its rows
        assert ids[1] == 2 and 2 not in ids and {5, 6, 8, 9, 10} <= set(ids)
    elif name == "decontamination":
        assert ids[1] == 2 and 8 not in ids and {2, 5, 6, 9, 10} <= set(ids)
    elif name == "mixing":
        # no document is lost, and the repeated row shares its other's fate
        assert set(seen) == set(given) and ids[1] % 2 == 0
    else:
        shards = {}
        for r in rows:
            shards.setdefault(r.doc_id, set()).add(r.shard)
        assert seen == Counter({**dict.fromkeys(given, 1), next(k for k in given if k[0] == "1"): 2}) and all(len(s) == 1 and isinstance(min(s), int) for s in shards.values())


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stage_empty(spark, nothing, awkward, folder, tmp_path, name):
    """An empty table stays empty; with no labels and an empty benchmark nothing is taken away by them."""
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, nothing, folder).count() == 0
    bare = f"{tmp_path}/bare"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{bare}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{bare}/benchmark.parquet")
    ids = {r.doc_id for r in stage(spark, awkward, bare).collect()}
    assert ids == {r.doc_id for r in awkward.collect()} - ({2} if name == "near_duplicates" else set())


def test_near_duplicates_missed_by_a_sample(spark, folder, prose_of, low_hashed):
    """Near copies go though the lowest-hashed trigrams of each are not in the others."""
    base, near = prose_of(150, 61), dict(corpus_pipeline.STAGES)["near_duplicates"]
    docs = [(i, low_hashed(base, 60, i), "en", "a", 1) for i in (3, 4, 5)] + [(9, prose_of(150, 62), "en", "a", 1)]
    kept = near(spark, spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), folder)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 9]
