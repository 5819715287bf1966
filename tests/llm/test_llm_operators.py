"""Each operator against its plain version, on documents made to be awkward."""

import random
from fractions import Fraction

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from lodegraph.llm import common, components, licenses, linededup, mixing, packing, pii, quality, simhash, substring, tokenfile, tokens, topk

CLASHING = "key long, unit string, fp string, copy int, mix_key string, ld_cut string, pii string, q_words string, part string, nth int, place int, sequence_id long, offset long, label string, node long, b string"


def texts():
    r = random.Random(7)
    vocabulary = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 6))) for _ in range(60)]
    line = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage = line(40)
    block = "\n".join(line(4) for _ in range(6))
    found = [None, "", " ", "\n\n", "one", "One two three", "日本 語　テキスト. x\x1cy", "a|b <|endoftext|> it's", "\t".join(vocabulary)]
    for i in range(60):
        parts = [line(r.randint(1, 90))]
        if i % 3 == 0:
            parts.append(passage)
        if i % 4 == 0:
            parts.append("\n" + block + "\n")
        if i % 5 == 0:
            parts.append(f"mail a.{i}@x-y.example.com, ip 10.0.0.{i} and 1.2.3.4.5.6.7, card 4539 1488 0343 6467 4539148803436467, call +1 (555) 010-44{i:02d}, DE89 3704 0044 0532 0130 00")
        parts.append(line(r.randint(0, 50)))
        found.append((" " if i % 2 else "\n").join(parts))
    found += [found[12], found[12], found[30] + " extra", ("w x y z " * 3000), line(30000), "9" * 5000 + " " + "1.1" * 3000 + "@", "Released under the MIT License.", "** This work is licensed under the GNU General Public License, version 3 **"]
    return found


@pytest.fixture(scope="module")
def rows():
    every = [(i, t) for i, t in enumerate(texts())]
    return every[3:] + every[:3]


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.when(F.col("doc_id") % 5 == 0, None).otherwise(F.concat(F.lit("s"), F.col("doc_id") % 3)))
    for column in CLASHING.split(", "):
        name, kind = column.split()
        df = df.withColumn(name, F.lit(None).cast(kind))
    return df.repartition(5).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("doc_id < -1")


@pytest.fixture(scope="module")
def odd(spark, docs):
    """Null ids, and rows that repeat."""
    same = docs.filter("doc_id = 12")
    return docs.filter("doc_id IN (12, 14, 20)").union(same).union(docs.filter("doc_id IN (12, 15)").withColumn("doc_id", F.lit(None).cast("long")))


def test_quality(docs, rows, none, odd):
    got = {r["doc_id"]: tuple(r[f"q_{c}"] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in quality.quality_rules(docs).collect()}
    assert got == {i: plain.quality(t) for i, t in rows}
    assert quality.quality_rules(none).count() == 0
    assert quality.kept_documents(docs).columns == docs.columns
    assert quality.quality_rules(odd).count() == odd.count()


def test_quality_keeps_clean_text(spark):
    clean = "The board met in the hall to hear what the town had to say of the new road. " * 1 + "Most of those who spoke were for it, and the vote was close. " + "A second meeting is set for the week after next, when the cost will be known."
    junk = "BUY*** NOW### CHEAP$$$ " * 20
    kept = quality.quality_rules(spark.createDataFrame([(1, clean), (2, junk)], "doc_id long, text string"))
    assert {r["doc_id"]: r["q_kept"] for r in kept.collect()} == {1: True, 2: False}


def test_pii(docs, rows, none, odd):
    got = {r["doc_id"]: [(x["kind"], x["start"], x["end"]) for x in r["pii"]] for r in pii.pii_spans(docs).collect()}
    assert {i: [x for x in s if x[0] in pii.BASE] for i, s in got.items()} == {i: plain.pii_base(t) for i, t in rows}
    assert all(t[s:e].replace(" ", "") == "DE89370400440532013000" for i, t in rows for k, s, e in got[i] if k == "iban")
    assert sum(k == "iban" for s in got.values() for k, _, _ in s) >= 12
    assert pii.pii_spans(none).count() == 0 and pii.pii_spans(odd).count() == odd.count()


@pytest.mark.parametrize("text", ["a@b.c_d@e.f", "x@y", "@@a@b.cc@d.ee", "1.2.3.256 1.2.3.4", "000255.1.1.1", "1.2.3", "+1 234 567 890-", "+12+1234567890", "4111-1111 11111111", "1 2 3 4 5 6 7 8 9 0 1 2", "é 😀 a@b.co 4111111111111111", "%@a-.b", "5" * 19, "12.34.56.78.90"])
def test_pii_edges(spark, text):
    r = pii.pii_spans(spark.createDataFrame([(text,)], "text string")).first()
    assert [(x["kind"], x["start"], x["end"]) for x in r["pii"] if x["kind"] in pii.BASE] == plain.pii_base(text)


def test_pii_many_spans(spark):
    text = " ".join(f"u{i}@h.example" for i in range(50_000))
    r = pii.pii_spans(spark.createDataFrame([(text,)], "text string")).first()
    assert [(x["kind"], x["start"], x["end"]) for x in r["pii"]] == plain.pii_base(text)


def test_pii_context_moves_scores(spark):
    rows = [(1, "the ssn 123-45-6789 is his"), (2, "lot 123-45-6789 sold"), (3, "card 4111111111111111"), (4, "x 4111111111111111")]
    got = {r["doc_id"]: r["pii"] for r in pii.pii_spans(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert [x["kind"] for x in got[1]] == ["ssn"] and got[2] == []
    assert got[3][0]["score"] > got[4][0]["score"]


def test_pii_context_is_of_whole_words_both_ways(spark):
    far = "x " * 700  # contexts across the border of two pieces
    rows = [(1, "hotel +1 555 010 4477"), (2, "tel +1 555 010 4477"), (3, "order +1 555 010 4477"), (4, far[:985] + "call é +1 555 010 4477 tel"), (5, "é" * 1500 + " +1 555 010 4477 order")]
    got = {r["doc_id"]: round(r["pii"][0]["score"], 2) for r in pii.pii_spans(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got == {1: 0.7, 2: 1.0, 3: 0.35, 4: 1.0, 5: 0.35}


def test_substring(docs, rows, none, odd):
    got = [tuple(r) for r in substring.repeats_removed(docs).collect()]
    assert sorted(got) == sorted(plain.substring(rows))
    assert substring.repeats_removed(none).count() == 0
    three = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert sorted((tuple(r) for r in substring.repeats_removed(odd).collect()), key=str) == sorted(plain.substring(three), key=str)


@pytest.mark.parametrize("window", [2, 7])
def test_substring_windows(docs, rows, window):
    few = [r for r in rows if r[0] < 40]
    got = [tuple(r) for r in substring.repeats_removed(docs.filter("doc_id < 40"), window=window).collect()]
    assert sorted(got) == sorted(plain.substring(few, window))


def test_substring_over_many_places(spark, monkeypatch):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice("abc") for _ in range(400))) for i in range(80)]
    monkeypatch.setattr(substring, "PLACE_BYTES", 500)
    monkeypatch.setattr(substring, "UNIT_BYTES", 3000)
    got = [tuple(x) for x in substring.repeats_removed(spark.createDataFrame(rows, "doc_id long, text string"), window=10).collect()]
    assert sorted(got) == sorted(plain.substring(rows, 10))


def test_line_dedup(docs, rows, none, odd):
    got = {r["doc_id"]: (set(r["ld_cut"]), r["text"]) for r in linededup.line_dedup(docs).collect()}
    cuts = plain.line_cuts(rows)
    assert any(cuts)
    for (i, t), cut in zip(rows, cuts):
        assert got[i][0] == cut
        assert got[i][1] == (t if not cut else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in cut))
    assert linededup.line_dedup(none).count() == 0
    assert linededup.line_dedup(odd).count() == odd.count()
    assert linededup.deduplicated(docs).columns == [c for c in docs.columns if c != "ld_cut"]


@pytest.mark.parametrize(("least", "spread"), [(1, False), (3, True), (4, False)])
def test_line_dedup_lengths(spark, monkeypatch, least, spread):
    if spread:  # ranks by range, names shuffled to their suffixes
        monkeypatch.setattr(linededup, "PART_ROWS", 1)
        monkeypatch.setattr(linededup, "BROADCAST_ROWS", 1)
    r = random.Random(least)
    rows = [(i, "\n".join(r.choice(["a", "b c", "d e f", "", " ", "g h i j k l m n"]) for _ in range(r.randint(0, 40)))) for i in range(40)]
    rows += [(50, rows[7][1]), (51, rows[7][1] + "\nz\n\n" + rows[8][1])]
    got = {x["doc_id"]: set(x["ld_cut"]) for x in linededup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), min_lines=least).collect()}
    assert [got[i] for i, _ in rows] == plain.line_cuts(rows, least)


@pytest.mark.parametrize("spread", [False, True])
def test_suffix_array_against_a_sorted_list(spark, monkeypatch, spread):
    """Ranks and sizes of the intervals at every depth are those of the sorted list of suffixes."""
    if spread:
        monkeypatch.setattr(linededup, "PART_ROWS", 1)
        monkeypatch.setattr(linededup, "BROADCAST_ROWS", 1)
    r = random.Random(5)
    rows = [[r.choice("abcde") for _ in range(r.randint(1, 12))] for _ in range(25)] + [list("abcdeabcdeabcdeabc")] * 2
    df = spark.createDataFrame([(n, "\n".join(x)) for n, x in enumerate(rows)], "doc_id long, text string")
    ids = linededup.line_ids(df)
    order = {x["line"]: (x["a"], x["b"]) for x in df.select(F.explode(F.split("text", "\n")).alias("line")).distinct().select("line", F.xxhash64("line").alias("a"), F.hash("line").cast("bigint").alias("b")).collect()}
    levels = linededup.suffix_array(ids, 3)
    assert [d for d, _ in levels] == [1, 2, 3, 4, 8, 16]
    for depth, level in levels:
        blocks = {}
        for d, x in enumerate(rows):
            for i in range(len(x) - depth + 1):
                blocks.setdefault(tuple(order[c] for c in x[i : i + depth]), []).append((d, i))
        repeated = {b: s for b, s in blocks.items() if len(s) > 1}
        got = {(x["ld_key"], x["line"]): (x["rank"], x["n"], x["first"]["ld_key"], x["first"]["line"]) for x in level.rows.collect()}
        by_rank = sorted((got[s[0]][0], b) for b, s in repeated.items())
        assert set(got) == {p for s in repeated.values() for p in s}
        at = 0
        for rank, b in by_rank:
            assert {got[p] for p in repeated[b]} == {(at, len(repeated[b]), *min(repeated[b]))} and rank == at
            at += len(repeated[b])
        if depth & (depth - 1) == 0:  # halves in order: lexicographic among blocks whose halves repeat
            assert [b for _, b in by_rank] == sorted(repeated)


def test_copied_blocks_and_their_source(spark):
    a, b, c = (["%s %d" % (x, i) for i in range(20)] for x in "abc")
    rows = [(1, a), (2, b), (3, c[:3] + a[4:15] + c[3:5] + b[1:6]), (4, b[:3] + ["new"] + a[:2]), (5, ["own"])]
    df = spark.createDataFrame([(n, "\n".join(x)) for n, x in rows], "doc_id long, text string")
    got = {r["doc_id"]: (r["ld_lines_copied"], r["ld_source"], r["text"].split("\n")) for r in linededup.line_dedup(df).collect()}
    assert got == {1: (0, None, a), 2: (0, None, b), 3: (8, "1", c[:5]), 4: (2, "2", ["new"]), 5: (0, None, ["own"])}


def test_line_dedup_of_a_very_long_document(spark):
    body = "\n".join(f"row {i} {i * i % 97}" for i in range(100_000))
    df = spark.createDataFrame([(1, body), (2, body + "\nlast"), (3, "\n".join(["same"] * 50_000))], "doc_id long, text string")
    got = {r["doc_id"]: (r["n"], r["text"][-9:]) for r in linededup.line_dedup(df).select("doc_id", F.size("ld_cut").alias("n"), "text").collect()}
    assert got == {1: (0, body[-9:]), 2: (100_000, "last"), 3: (49_999, "same")}


def test_runs(spark):
    df = spark.createDataFrame([([1, 2, 3, 7, 9, 10],), ([],)], "c array<int>")
    assert [r[0] for r in df.select(linededup.runs(F.col("c"))).collect()] == ["1-3,7-7,9-10", ""]


def test_licenses(docs, rows, none):
    def brute(text):
        w = [x for x in (licenses.plain(v.encode()) for v in plain.words(text)) if x]
        found = {}
        for name, body in licenses.TEMPLATES.items():
            t = [x for x in map(licenses.plain, body.encode().split()) if x]
            n = min(5, len(t))
            whole = {tuple(t[i : i + n]) for i in range(len(t) - n + 1)}
            stride = 1 << (len(whole) - 1).bit_length()
            mine = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
            best = [len(whole & set(mine[s : s + 2 * stride])) for s in range(0, len(mine), stride)]
            if best and max(best) >= licenses.need(len(whole)):
                found[name] = (max(best), len(whole))
        return found

    got = {}
    for r in licenses.scan(docs).collect():
        got.setdefault(r["doc_id"], {})[r["license"]] = (r["matched"], r["total"])
    assert got == {i: f for i, t in rows if (f := brute(t))}
    assert {n for f in got.values() for n in f} == {"mit-notice", "gpl-3.0-notice"}
    assert licenses.scan(none).count() == 0


def test_license_near_match(spark):
    words = licenses.TEMPLATES["mit-permission"].split()
    words[30] = "whatever"
    far = [w if i % 4 else "x" for i, w in enumerate(words)]
    rows = [(1, "intro " * 50 + " ".join(words) + " outro" * 50), (2, " ".join(far))]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["license"]) for r in got] == [(1, "mit-permission")]
    assert Fraction(got[0]["matched"], got[0]["total"]) >= licenses.CONTAINMENT


def test_simhash(docs, rows, none, odd):
    got = {r["key"]: (r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.classes(docs).collect()}
    prints = [(i, plain.fingerprint(t)) for i, t in rows]
    assert got == {i: (f, c) for (i, f), c in zip(prints, plain.classes(prints))}
    assert simhash.classes(none).count() == 0
    kept = {r["doc_id"] for r in simhash.keep_one(docs).collect()}
    assert kept == {c for _, c in got.values()}
    assert simhash.keep_one(docs).columns == docs.columns
    assert simhash.keep_one(odd).filter("doc_id IS NULL").count() == 2


def test_simhash_links_against_all_pairs(spark):
    r = random.Random(1)
    centres = [r.getrandbits(64) for _ in range(4)]
    prints = {c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))) for c in centres for _ in range(60)} | {0, 1, 3, (1 << 64) - 1}
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in prints)
    got = {tuple(x) for x in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    mask = (1 << 64) - 1
    assert got == {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & mask).bit_count() <= 4}


def test_components_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["label"] for r in components.components(links).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}
    assert components.components(links.filter("a < -1")).count() == 0


def test_mixing(docs, none, odd):
    weights = {"s0": 3.0, "s1": 0.0}
    got = mixing.mix(docs, weights)
    assert got.columns == [c for c in docs.columns if c not in ("copy", "mix_key")] + ["copy", "mix_key"]
    rows = got.collect()
    assert [r["mix_key"] for r in rows] == sorted(r["mix_key"] for r in rows)
    assert not [r for r in rows if r["source"] == "s1"] and [r for r in rows if r["source"] is None]
    again = mixing.mix(docs.repartition(2), weights).collect()
    assert [(r["doc_id"], r["copy"]) for r in rows] == [(r["doc_id"], r["copy"]) for r in again]
    assert mixing.mix(none, weights).count() == 0
    assert mixing.mix(odd, {}, epochs=40.0).groupBy("doc_id").count().count() == 4


def test_mixing_reaches_targets(spark):
    df = spark.range(20000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 6, "hot").when(F.col("id") % 10 < 9, "mid").otherwise("rare").alias("source"))
    shares = {r["source"]: r["count"] / 20000 for r in mixing.mix(df, {"hot": 1, "mid": 1, "rare": 2}).groupBy("source").count().collect()}
    assert shares == pytest.approx({"hot": 0.25, "mid": 0.25, "rare": 0.5}, rel=0.06)


@pytest.mark.parametrize("rate", [400, 600, 5000])
def test_mixing_large_rates_are_poisson(spark, rate):
    df = spark.range(301).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 300, "a").otherwise("b").alias("source"))
    drawn = mixing.mix(df, {"a": 1.0, "b": 0.0}, epochs=rate * 300 / 301)
    counts = [r["n"] for r in drawn.groupBy("doc_id").agg(F.count("copy").alias("n"), F.countDistinct("copy").alias("m")).filter("n = m").collect()]
    assert len(counts) == 300
    assert abs(np.mean(counts) - rate) < 5 * (rate / 300) ** 0.5
    assert 0.7 * rate < np.var(counts) < 1.35 * rate


def test_poisson_table(spark):
    cdf = spark.range(1).select(mixing.poisson_cdf(F.lit(2.0)).alias("c")).first()["c"]
    assert cdf[:3] == pytest.approx([0.1353352832, 0.4060058497, 0.6766764162]) and cdf[-1] == pytest.approx(1)


def test_token_file(spark, docs, rows, none, odd, tmp_path):
    encoder = tokens.encoder(tokens.read_file(None))
    assert encoder.by_word
    ids = {i: encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for i, t in rows}
    path = tokenfile.written(docs)
    starts = {r["of_shard"]: r["before"] for r in tokenfile.shard_starts(spark, path).collect()}
    got = {r["doc_id"]: (starts[r["shard"]] + r["shard_start"], np.frombuffer(r["ids"], "<u4").tolist()) for r in tokenfile.read(spark, path).collect()}
    at = 0
    for i in sorted(ids):
        assert got[i] == (at, ids[i])
        at += len(ids[i])
    assert tokenfile.read(spark, tokenfile.written(none)).count() == 0
    assert tokenfile.read(spark, tokenfile.written(odd)).count() == odd.count()


def test_token_file_random_access(spark, docs, monkeypatch):
    monkeypatch.setattr(tokenfile, "BLOCK_IDS", 500)
    path = tokenfile.written(docs)
    encoder = tokens.encoder(tokens.read_file(None)).tokenizer
    ids = {r["doc_id"]: encoder.encode(r["text"] or "", add_special_tokens=False).ids + [1] for r in docs.select("doc_id", "text").collect()}
    every = [x for i in sorted(ids) for x in ids[i]]
    for start, stop in ((0, 1), (490, 1510), (len(every) - 3, len(every) + 9), (7, 7)):
        got = sorted((r["start"], np.frombuffer(r["ids"], "<u4").tolist()) for r in tokenfile.between(spark, path, start, stop).collect())
        assert [x for _, part in got for x in part] == every[start:stop]
        assert not got or got[0][0] == start
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in tokenfile.document(spark, path, 20).collect()] == [ids[20]]
    assert tokenfile.document(spark, path, -5).count() == 0


def test_token_file_of_empty_documents(spark):
    path = tokenfile.written(spark.range(200_000).select(F.col("id").alias("doc_id"), F.lit("").alias("text")))
    assert tokenfile.read(spark, path).filter(F.col("ids") == F.lit(b"\x01\0\0\0")).count() == 200_000


@pytest.mark.parametrize("bits", [1, 7, 8, 13, 16, 17, 32])
def test_bit_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001, dtype=np.uint64).astype(np.uint32)
    packed = tokenfile.pack(ids, bits)
    assert len(packed) == -(-1001 * bits // 8)
    assert tokenfile.unpack(packed, bits, 0, 1001).tolist() == ids.tolist()
    assert tokenfile.unpack(packed, bits, 333, 50).tolist() == ids[333:383].tolist()


@pytest.mark.parametrize("capacity", [4096, 64])
def test_packing(docs, rows, none, odd, capacity):
    tokenizer = tokens.encoder(tokens.read_file(None)).tokenizer
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for i, t in rows}
    got = packing.best_fit(docs, capacity=capacity).collect()
    whole = {(i, n // capacity, n, tuple(v[n : n + capacity])) for i, v in ids.items() for n in range(0, len(v), capacity)}
    assert {(r["doc_id"], r["piece"], r["start"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in got} == whole and len(got) == len(whole)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(sequences) <= 1.02 * -(-sum(map(len, ids.values())) // capacity) + 1
    assert packing.best_fit(none, capacity=capacity).count() == 0
    assert packing.best_fit(odd, capacity=capacity).select("doc_id").distinct().count() == 4


def test_fullest_against_all_subsets():
    r = random.Random(5)
    for _ in range(200):
        counts = {r.randint(1, 30): r.randint(1, 3) for _ in range(4)}
        room = r.randint(1, 60)
        taken = packing.fullest(counts, room)
        assert all(n <= counts[x] for x, n in taken.items())
        sums = {0}
        for x, n in counts.items():
            sums = {s + x * k for s in sums for k in range(n + 1)}
        assert sum(x * n for x, n in taken.items()) == max(s for s in sums if s <= room)


def test_plan_places_everything():
    r = random.Random(6)
    histogram = {r.randint(1, 100): r.randint(1, 500) for _ in range(40)}
    plan, sequences = packing.plan(histogram, 100)
    used = dict.fromkeys(histogram, 0)
    volume = -(-sum(x * n for x, n in histogram.items()) // 100)
    bound = max(volume, sum(n for x, n in histogram.items() if x > 50))  # two of those never share a sequence
    assert sequences <= bound * 1.02 + 1
    by = {}
    for length, first, bins, sequence, offset in plan:
        by.setdefault(length, []).append((first, bins))
        assert bins > 0 and sequence >= 0 and 0 <= offset <= 100 - length
    for length, firsts in by.items():
        assert sorted(firsts)[0][0] == 0 and used[length] == 0


def vectors(n, dim, seed):
    r = np.random.default_rng(seed)
    found = [(i, r.normal(0, 0.2, dim).astype(np.float32).tolist()) for i in range(n)]
    found[3] = (3, None)
    found[4] = (4, [None] + found[4][1][1:])
    found[5] = (5, [float("nan")] + found[5][1][1:])
    found[6] = (6, [float("inf")] + found[6][1][1:])
    found[7] = (None, found[7][1])
    found[8] = (8, [0.5] * (dim - 1))
    found += [(n + i, found[20][1]) for i in range(60)]  # ties
    return found


def test_top_k(spark):
    rows = vectors(700, 12, 1)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("x")).withColumn("dim", F.lit(1)).withColumn("score", F.lit(2))
    want = plain.top_k(rows)
    assert {tuple(r) for r in topk.top_k(df, "id % 20 = 0").collect()} == want
    assert {tuple(r) for r in topk.top_k(df, "id % 20 = 0", shard_rows=50).collect()} == want
    assert topk.top_k(df.filter("vec_id < -1"), "id % 20 = 0").count() == 0


def test_top_k_large_components(spark):
    rows = [(i, [1e30 * (i + 1), 1.0]) for i in range(5)] + [(5, [2.0e7, 3.0e7]), (6, [-1.5e7, 1.0])]
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "id >= 0", k=10).collect()}
    scaled = lambda v: [int(np.floor(64 * x)) for x in v]
    exact = sum(a * b for a, b in zip(scaled(rows[5][1]), scaled(rows[6][1])))
    assert got[5, 6] == exact and got[0, 1] == 2**63 - 1 and len(got) == 42


def test_tree_prunes():
    r = np.random.default_rng(0)
    points = np.floor(64 * np.vstack([r.normal(c, 0.02, (500, 8)) for c in (-1, 0, 1)]))
    ids = np.arange(len(points))
    tree = topk.Tree(points, ids, 32)
    assert sorted(tree.order.tolist()) == ids.tolist()
    for n, (a, b) in enumerate(tree.span):
        assert np.sqrt(((points[tree.order[a:b]] - tree.centre[n]) ** 2).sum(axis=1)).max() <= tree.radius[n] + 1e-9


def test_simhash_crowd(spark, monkeypatch):
    """Near copies without end: links grow with the fingerprints, not with their pairs, and lose no class."""
    monkeypatch.setattr(simhash, "LONG_LIST", 200)
    r = random.Random(9)
    centre = r.getrandbits(64)
    prints = {centre ^ sum(1 << b for b in r.sample(range(64), r.choice((1, 2, 2, 3)))) for _ in range(6000)} | {~centre & ((1 << 64) - 1)}
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in prints)
    df = spark.createDataFrame([(i, f) for i, f in enumerate(signed)], "key long, fp long").repartition(4)
    assert len(prints) < simhash.links(df).count() < 400 * len(prints)
    got = {x["fp"] & (1 << 64) - 1: x["component_id"] for x in simhash._classed(df, 4).collect()}
    apart = got.pop(~centre & ((1 << 64) - 1))
    assert set(got.values()) == {0 if apart else 1}


def test_simhash_long_lists_as_stars(spark, monkeypatch):
    r = random.Random(2)
    centres = [r.getrandbits(64) for _ in range(3)]
    prints = sorted({c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))) for c in centres for _ in range(120)})
    rows = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(prints)]
    want = plain.classes(list(enumerate(prints)))
    for limit in (1, 20):
        monkeypatch.setattr(simhash, "LONG_LIST", limit)
        for distance in (4, 3):
            got = {x["key"]: x["component_id"] for x in simhash._classed(spark.createDataFrame(rows, "key long, fp long"), distance).collect()}
            assert [got[i] for i in range(len(rows))] == (want if distance == 4 else plain.classes(list(enumerate(prints)), distance))


def test_simhash_keys_are_not_broadcast(spark, monkeypatch):
    """Spark takes the 70 keys of a fingerprint for one row, so it would send them to the driver up to some 600,000 fingerprints."""
    plans = []
    joins = lambda df: [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "BroadcastHashJoin" in x]

    def seen(df, *args):
        plans.append(joins(df))
        return common.saved(df, *args)

    monkeypatch.setattr(simhash, "saved", seen)
    prints = spark.createDataFrame([(8 * i + (i % 5 == 0),) for i in range(100)], "fp long")
    found = simhash.links(prints)
    assert found.count() and [*plans, joins(found)] == [[], []]


def test_components_of_a_hub(spark, monkeypatch):
    monkeypatch.setattr(components, "FEW_LINKS", 1)
    links = [(0, i) for i in range(1, 400)] + [(500 + i, 501 + i) for i in range(20)]
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(400)} | {500 + i: 500 for i in range(21)}


def test_components_rounds_then_one_task(spark, monkeypatch):
    """The same labels by one task, by rounds, and by rounds that leave few enough links for one task."""
    r = random.Random(4)
    chains = [(100 * c + i, 100 * c + i + 1) for c in range(4) for i in range(60)]
    links = [(a, b) if r.random() < 0.5 else (b, a) for a, b in chains + [(100 * c, 100 * c + r.randint(2, 60)) for c in range(4) for _ in range(40)]]
    df = spark.createDataFrame([*links, (7, 7), (None, 3), (900, None)], "a long, b long")
    want = {x: 100 * (x // 100) for pair in links for x in pair}
    for limit in (components.FEW_LINKS, 1, len(set(chains)) + 1):
        monkeypatch.setattr(components, "FEW_LINKS", limit)
        got = components.components(df).collect()
        assert len(got) == len(want) and {x["node"]: x["label"] for x in got} == want


def test_simhash_plans_stay_small(spark, monkeypatch):
    """Tables that a plan reads, per plan written or returned: the driver's memory goes with them."""
    sizes = []
    leaves = lambda df: df._jdf.queryExecution().optimizedPlan().collectLeaves().size()

    def counted(df, *args):
        sizes.append(leaves(df))
        return common.saved(df, *args)

    monkeypatch.setattr(simhash, "saved", counted)
    monkeypatch.setattr(components, "saved", counted)
    r = random.Random(3)
    rows = [(8 * i + j, (p ^ 1 << r.randrange(64)) - (1 << 63)) for i, p in enumerate(r.getrandbits(64) for _ in range(20)) for j in range(8)]
    prints = spark.createDataFrame(rows, "key long, fp long")
    for limit in (components.FEW_LINKS, 1):
        monkeypatch.setattr(components, "FEW_LINKS", limit)
        found = simhash._classed(prints, 4)
        assert max([*sizes, leaves(found)]) <= 8
        assert {x["component_id"] for x in found.collect()} == {8 * i for i in range(20)}
