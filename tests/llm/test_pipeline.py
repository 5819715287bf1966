"""Each stage of the pipeline on its own input against the plain versions, and the whole of it."""

import random

import corpus_pipeline
import numpy as np
import plain
import pytest

from lodegraph.llm import common, components, mixing, queries, simhash, tokens

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(11)
    stop = ["the", "of", "and", "to", "in", "that"]
    word = lambda: r.choice(stop) if r.random() < 0.3 else "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))
    sentence = lambda n: " ".join(word() for _ in range(n))
    shared = "\n".join(sentence(6) for _ in range(5))
    rows = []
    for i in range(80):
        lines = [sentence(r.randint(5, 25)) for _ in range(r.randint(4, 12))]
        if i % 6 == 0:
            lines.insert(2, shared)
        rows.append((i, "\n".join(lines), "en", f"src{i % 4}", 0))
    rows += [(100 + i, rows[i][1], "en", "src0", 0) for i in (3, 5, 7)]  # exact copies
    rows += [(200 + i, rows[i][1].replace("\n", " ") + " end", "en", "src1", 0) for i in (8, 9)]  # near copies on other lines
    rows += [(300, "BUY*** NOW### " * 30, "en", "src2", 0), (301, None, "en", None, None), (302, "", None, "src3", 0), (303, "too short", "en", "src3", 9)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="module")
def stages(spark, folder):
    """The rows before the first stage and after each."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = [docs]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{folder}/stage{n}"
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        found.append(docs)
    return found


def test_columns(stages):
    for df in stages[:5]:
        assert df.columns == COLUMNS


def test_quality_stage(stages):
    kept = {r["doc_id"] for r in stages[1].collect()}
    base = {r["doc_id"] for r in stages[0].collect() if not plain.quality(r["text"])[-1]}
    assert kept == base - {300}


def test_line_stage(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[1].collect()]
    want = {}
    for (key, text), cut in zip(rows, plain.line_cuts(rows)):
        left = "\n".join(x for n, x in enumerate(text.split("\n")) if n not in cut)
        if plain.words(left) or not cut:
            want[key] = left
    assert {r["doc_id"]: r["text"] for r in stages[2].collect()} == want
    assert not {103, 105, 107} & set(want)
    assert all(r["n_chars"] == len(r["text"]) for r in stages[2].collect())


def test_near_stage(stages):
    rows = [(r["doc_id"], plain.fingerprint(r["text"])) for r in stages[2].collect()]
    assert {r["doc_id"] for r in stages[3].collect()} == set(plain.classes(rows))
    assert not {208, 209} & {r["doc_id"] for r in stages[3].collect()}


def test_near_stage_plans_stay_small(spark, monkeypatch):
    """Tables that a plan reads, per plan written or returned: the driver's memory goes with them."""
    sizes = []
    leaves = lambda df: df._jdf.queryExecution().optimizedPlan().collectLeaves().size()

    def counted(df, *args):
        sizes.append(leaves(df))
        return common.saved(df, *args)

    monkeypatch.setattr(simhash, "saved", counted)
    monkeypatch.setattr(components, "saved", counted)
    r = random.Random(5)
    texts = [" ".join(str(r.randrange(10**6)) for _ in range(30)) for _ in range(12)]
    docs = spark.createDataFrame([(100 * n + i, x, "en", "src0", len(x)) for i, x in enumerate(texts) for n in range(1 + i % 3)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert max([*sizes, leaves(kept)]) <= 8
    assert {x["doc_id"] for x in kept.collect()} == set(range(12))


def test_near_stage_jobs_are_few(spark):
    """Every job leaves buffers of 4 MB on the driver's heap for each of its stages and scans; chains of links take rounds."""
    r = random.Random(7)
    words = [[str(r.randrange(10**6)) for _ in range(60)] for _ in range(4)]
    texts = [" ".join(w[:i] + ["x"] * (i > 0) + w[i + 1 :]) for w in words for i in range(20)]
    docs = spark.createDataFrame([(i, x, "en", "src0", len(x)) for i, x in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").localCheckpoint()
    spark.sparkContext.setJobGroup("near-stage", "jobs of near_dedup")
    try:
        kept = {x["doc_id"] for x in corpus_pipeline.near_dedup(spark, docs, "").collect()}
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("near-stage"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert kept == set(plain.classes([(i, plain.fingerprint(x)) for i, x in enumerate(texts)]))
    assert jobs <= 40


def test_near_stage_keys_stay_off_the_driver(spark, monkeypatch):
    """Index keys, 70 a fingerprint, are sized by Spark as the fingerprints they come from: by size alone it broadcasts them."""
    plans = {}

    def seen(df, name, *args):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return common.saved(df, name, *args)

    monkeypatch.setattr(simhash, "saved", seen)
    docs = spark.createDataFrame([(i, f"a b c d {i // 2}", "en", "src0", 9) for i in range(12)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {x["doc_id"] for x in corpus_pipeline.near_dedup(spark, docs, "").collect()} <= set(range(0, 12, 2))
    assert "SortMergeJoin" in plans["simhash-index"] and "BroadcastHashJoin" not in plans["simhash-index"]


def test_mixing_stage(stages):
    import hashlib
    from collections import Counter

    rows = stages[3].collect()
    sizes = Counter(r["source"] for r in rows)
    weight = {s: mixing.MIX_WEIGHTS.get(s, mixing.OTHERS) for s in sizes}
    want = Counter()
    for r in rows:
        rate = weight[r["source"]] / sum(weight.values()) * len(rows) / sizes[r["source"]]
        u = int(hashlib.md5(f"0:{r['doc_id']}".encode()).hexdigest()[:13], 16) / 16**13
        p = c = np.exp(-rate)
        n = 0
        while c <= u:
            n += 1
            p *= rate / n
            c += p
        want[r["doc_id"]] = n
    assert Counter(r["doc_id"] for r in stages[4].collect()) == +want
    assert {(r["doc_id"], r["text"]) for r in stages[4].collect()} <= {(r["doc_id"], r["text"]) for r in rows}


def test_packing_stage(stages):
    tokenizer = tokens.encoder(tokens.read_file(None)).tokenizer
    want = []
    for r in stages[4].collect():
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        want += [(r["doc_id"], n // 4096, n, len(ids[n : n + 4096]), plain.crc(ids[n : n + 4096])) for n in range(0, len(ids), 4096)]
    got = stages[5].collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(places) <= -(-sum(r["length"] for r in got) // 4096) + 1


def test_run(spark, folder, stages):
    got = corpus_pipeline.run(spark, folder)
    pick = lambda df: sorted(tuple(r)[:5] for r in df.collect())
    assert pick(got) == pick(stages[5])


def test_empty(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id < 0").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_queries_on_awkward_documents(spark, folder):
    n = spark.read.parquet(f"{folder}/documents.parquet").count()
    for name, query in queries.queries().items():
        if name not in ("op1_topk", "op7_licenses", "op8_packing", "op10_mixing"):
            assert query(spark, folder).count() == n, name
    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {x.split("_")[0] for x in names} and "pipeline" in names
