"""The registered queries that SQL can't express, every column of theirs against plain versions."""

import numpy as np
import plain
import pytest

from lodegraph.llm import pii, queries, tokens


@pytest.fixture(scope="module")
def rows():
    passage = " ".join(f"w{i}" for i in range(60))
    texts = [
        None, "", " \n", "one", f"mail a@b.co or 10.0.0.1, é card 4539 1488 0343 6467 {passage}", passage, passage.upper(), passage + " end", "call +1 (555) 010-4477 and 1.2.3.4.5.6.7.8, 300.1.1.1",
        "IBAN DE89 3704 0044 0532 0130 00 BIC", "the ssn 123-45-6789", "a@b.c_d@e.f 4111-1111 11111111", "日本 語 x@y.zz", "ab " * 3000, "|a <|endoftext|> it's",
    ]
    return [(i * 3, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("registered"))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


def test_op2(spark, folder, rows):
    got = {r["doc_id"]: r for r in queries.op2_pii(spark, folder).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        base = plain.pii_base(text)
        r = got[i]
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(x[0] == k for x in base) for k in pii.BASE]
        assert r["base_sha256"] == plain.sha(",".join(f"{k}:{s}:{e}" for k, s, e in base))
        every = [tuple(x.split(":")) for x in r["spans"].split(",") if x]
        assert [(k, int(s), int(e)) for k, s, e in every if k in pii.BASE] == base
        more = {(k, text[int(s) : int(e)]) for k, s, e in every if k not in pii.BASE}
        assert more == {9: {("iban", "DE89 3704 0044 0532 0130 00")}, 10: {("ssn", "123-45-6789")}}.get(i // 3, set())


def test_op4(spark, folder, rows):
    tokenizer = tokens.encoder(tokens.read_file(None)).tokenizer
    want, at = set(), 0
    for i, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        want.add((i, at, len(ids), plain.crc(ids)))
        at += len(ids)
    assert {(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.op4_token_file(spark, folder).collect()} == want


def test_op8(spark, folder, rows):
    tokenizer = tokens.encoder(tokens.read_file(None)).tokenizer
    got = {(r["doc_id"], r["piece"]): r for r in queries.op8_packing(spark, folder).collect()}
    want = {(i, n): ids[n * 4096 : (n + 1) * 4096] for i, t in rows for ids in [tokenizer.encode(t or "", add_special_tokens=False).ids + [1]] for n in range(-(-len(ids) // 4096))}
    assert {k: (r["start"], r["length"], r["ids_crc32"]) for k, r in got.items()} == {k: (k[1] * 4096, len(v), plain.crc(v)) for k, v in want.items()}
    for s in {r["sequence_id"] for r in got.values()}:
        own = sorted((r["offset"], r["length"]) for r in got.values() if r["sequence_id"] == s)
        assert [o for o, _ in own] == np.cumsum([0] + [n for _, n in own])[:-1].tolist() and sum(n for _, n in own) <= 4096


def test_op9(spark, folder, rows):
    prints = [(i, plain.fingerprint(t)) for i, t in rows]
    want = {(i, f"{f:016x}", c) for (i, f), c in zip(prints, plain.classes(prints))}
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in queries.op9_simhash(spark, folder).collect()} == want
    assert len({c for _, _, c in want}) < len(rows)
