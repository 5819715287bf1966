"""The license table: each text is found whole, and verification goes by words."""

import numpy as np

from lodegraph.llm import licenses

FILL = [f"word{i}" for i in range(700)]


def test_every_text_is_found_within_others(spark):
    names = sorted(licenses.TEMPLATES)
    rows = [(i, " ".join([*FILL[: 37 * i % 600], licenses.TEMPLATES[n], *FILL[:211]])) for i, n in enumerate(names)]
    found = {(r["doc_id"], r["license"]): (r["matched"], r["total"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, n in enumerate(names):
        matched, total = found[(i, n)]
        assert matched == total


def test_a_fifth_of_the_words_changed_is_not_found(spark):
    words = licenses.TEMPLATES["mit"].split()
    spread = [w if i % 5 else "other" for i, w in enumerate(words)]
    docs = spark.createDataFrame([(1, " ".join(spread)), (2, "The license of the software is free of charge.")], "doc_id long, text string")
    assert licenses.scan(docs).count() == 0


def test_shingles_are_named_by_their_words():
    rng = np.random.default_rng(0)
    texts = [[b"%d" % x for x in rng.integers(0, 4, n)] for n in (5, 30, 12)]
    s = licenses.Spellings(3, texts)
    known = {tuple(t[i : i + 3]) for t in texts for i in range(len(t) - 2)}
    probe = [b"%d" % x for x in rng.integers(0, 6, 400)]
    numbers = s.shingles(s.coded(probe), 3)
    of: dict = {}
    for i, n in enumerate(numbers):
        words = tuple(probe[i : i + 3])
        assert (n > 0) == (words in known)
        assert n == 0 or of.setdefault(int(n), words) == words
    assert len(set(of.values())) == len(of)
    assert len(s.shingles(s.coded(probe[:2]), 3)) == 0
