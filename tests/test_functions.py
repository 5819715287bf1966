"""Functions and canonical forms against published values."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodegraph.functions import fixed, h3, lint, text, versions
from lodegraph.operators import merkle, quantities
from lodegraph.sources import cbor, ids, packs

#: Leaves of a log, and its root at each size from 1.
LEAVES = ["", "00", "10", "2021", "3031", "40414243", "5051525354555657", "606162636465666768696a6b6c6d6e6f"]
ROOTS = [
    "6e340b9cffb37a989ca544e6bb780a2c78901d3fb33738768511a30617afa01d",
    "fac54203e7cc696cf0dfcb42c92a1d9dbaf70ad9e621f4bd8d98662f00e3c125",
    "aeb6bcfe274b70a14fb067a5e5578264db0fa9b51af5e0ba159158f329e06e77",
    "d37ee418976dd95753c1c73862b9398fa2a2cf9b4ff0fdfe8b30cd95209614b7",
    "4e3bbb1f7b478dcfe71fb631631519a3bca12c9aefca1612bfce4c13a86264d4",
    "76e67dadbcdf1e10e1b74ddc608abd2f98dfb16fbce75277b5232a127f2087ef",
    "ddb89be403809e325750d3d263cd78929c2942b7942a34b77e122c9594a74c8c",
    "5dc9da79a70659a9ad559cb701ded9a2ab9d823aad2f4960cfe370eff4604328",
]


def evaluate(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


@pytest.mark.parametrize(
    ("op", "a", "b", "c", "want"),
    [
        ("mul_div", 2000000, 1000000, 3000000, 666666),
        ("mul_div", -2000000, 1000000, 3000000, -666666),
        ("mul_div", 1000000, 1000000, 0, 0),
        ("mul_div", 7000000, 22000000, 7000000, 22000000),
        ("wide", 7000000000000, 22000000000000, 7000000000000, 22000000000000),
        ("times", -500000, 333333, None, -166666),
        ("times", 1, 1, None, 0),
        ("ratio", -1000000, 3000000, None, -333333),
        ("ratio", 2000000, 0, None, 0),
        ("ratio", 1000000, 7, None, 142857142857),
        ("halve", 1000000, 30, 30, 500000),
        ("halve", 1000000, 15, 30, 750000),
        ("halve", 1000000, 45, 30, 375000),
        ("halve", -1000000, 15, 30, -750000),
        ("halve", 1000000, 3810, 30, 0),
        ("halve", 1000000, 1, 0, 1000000),
    ],
)
def test_fixed(spark, op, a, b, c, want):
    arguments = [F.lit(x).cast("bigint") for x in (a, b, c) if x is not None]
    assert evaluate(spark, getattr(fixed, op)(*arguments)) == (want,)


def test_fixed_text(spark):
    assert evaluate(spark, fixed.show(F.lit(-1500000)), fixed.show(F.lit(7))) == ("-1.500000", "0.000007")


@pytest.mark.parametrize(
    ("version", "requires", "want"),
    [
        ("7", "7", True), ("7.41", "7", True), ("7.41.3", "", True), ("74.1", "7", False), ("6.9", "7", False),  # prefix up to a dot
        ("12.0.0", "11.30+", True), ("11.30", "11.30+", True), ("11.4", "11.30+", False), ("11", "11.0+", False), ("x.y", "3+", False),  # at least
        ("5.8.2", "^5.3", True), ("5.2.99", "^5.3", False), ("6.3.0", "^5.3", False), ("0.7.1", "^0.7", True), ("0.8.0", "^0.7", False),  # caret
        ("0.0.5", "^0.0.5", True), ("0.0.6", "^0.0.5", False), ("0.0.12", "^0.0", True), ("0.4.0", "^0.0", False), ("q", "^5", False),
    ],
)
def test_versions(spark, version, requires, want):
    assert evaluate(spark, versions.satisfies(F.lit(version), F.lit(requires))) == (want,)


def test_cells(spark):
    cell = h3.parse(F.lit("8a089b1a2177fff"))
    assert evaluate(spark, h3.is_valid(cell), h3.resolution(cell), h3.show(h3.parent(cell, 7)), h3.contains(h3.parent(cell, 3), cell), h3.contains(cell, h3.parent(cell, 3))) == (True, 10, "87089b1a2ffffff", True, False)
    assert evaluate(spark, *[h3.parse(F.lit(x)) for x in ("", "8A089B1A2177FFF", "08a089b1a2177fff", "8a089b1a2177fffff", "8a08 9b1a")]) == (None,) * 5
    broken = cell.bitwiseAND(F.lit(~(4 << 12)).cast("bigint"))
    assert evaluate(spark, h3.is_valid(broken)) == (False,)


@pytest.mark.parametrize(
    ("content", "sentences", "quantities"),
    [("One. Two.", 2, 0), ("It rose 1.5 percent.", 1, 1), ("Really?! Yes", 2, 0), ("v1.2.3 and 4,000 m2", 1, 1), ("", 0, 0), ("a b", 1, 0), ("1.2.3.", 1, 1)],
)
def test_lint_counts(spark, content, sentences, quantities):
    assert evaluate(spark, lint.sentences(F.lit(content)), lint.quantities(F.lit(content))) == (sentences, quantities)


@pytest.mark.parametrize(
    ("content", "tests"),
    [
        ("", ["non-empty"]), ("Water boils at 100 degrees.", []), ("It boils and it cools.", ["single-assertion", "dangling-anaphora"]), ("He left while smiling.", ["dangling-anaphora"]),
        ("Sales rose while costs fell.", ["single-assertion"]), ("From 3 to 5.", ["single-quantity"]), ("As mentioned, x.", ["dangling-anaphora"]), ("x" * 5000, ["size"]),
    ],
)
def test_lint_findings(spark, content, tests):
    assert [x["test"] for x in evaluate(spark, lint.findings(F.lit(content)))[0]] == tests


def test_lint_mentions(spark):
    found = [lint.mentions(F.lit("The heat, reheated"), F.lit(w)) for w in ("heat", "reheat", "the", "")]
    assert evaluate(spark, *found) == (True, False, True, False)


def test_lint_mentions_at_line_ends_and_repeats(spark):
    asked = [("nterer\nof was", "of"), ("as was\n", "was"), ("heatheat", "heat"), ("xa-a-a", "a-a"), ("c++\nc++c", "c++"), (r"a\E(b c", r"\E(b"), (None, "of")]
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(asked)], "i int, t string, w string")
    found = df.select("i", lint.mentions(F.col("t"), F.col("w")).alias("m")).orderBy("i").collect()
    assert [r.m for r in found] == [True, True, False, True, True, False, None]


def test_names(spark):
    assert evaluate(spark, text.segment(F.lit("  Floor-Area (net) ")), text.term(F.lit("Mass (rest): kg")), text.file_name(F.lit("a/b c"))) == ("floor_area_net", "mass", "a_b%20c")
    assert evaluate(spark, text.is_tag(F.lit("abc-defghi-12-2024")), text.is_tag(F.lit("abc-defghi-13-2024")), text.is_decimal(F.lit("-1.50")), text.is_decimal(F.lit("1e3"))) == (True, False, True, False)
    assert evaluate(spark, text.epoch_of(F.lit("1970-01-02T00:00:01Z")), text.epoch_of(F.lit("soon"))) == (86401, None)


@pytest.mark.parametrize(
    ("raw", "rule"),
    [
        ("1801", "shortest-form integers"), ("780161", "shortest-form integers"), ("9f01ff", "no indefinite length"), ("7f6161ff", "no indefinite length"), ("f93e00", "no floating point"), ("fb3ff8000000000000", "no floating point"),
        ("a10102", "text map keys"), ("a2616101616102", "unique map keys"), ("a2616201616102", "sorted map keys"), ("61ff", "valid UTF-8"), ("6365cc81", "NFC normalization"), ("c06178", "supported item types"), ("f7", "supported item types"),
        ("f816", "shortest-form integers"), ("f820", "supported item types"), ("0102", "single top-level item"), ("6261", "complete items"), ("8201", "complete items"), ("81" * 64 + "80", "nesting limit"),
    ],
)
def test_refused_bytes(raw, rule):
    with pytest.raises(cbor.Refused) as e:
        cbor.decode(bytes.fromhex(raw))
    assert e.value.rule == rule


def test_size_limit():
    with pytest.raises(cbor.Refused):
        cbor.decode(cbor.encode(b"x" * cbor.MOST_BYTES))


VALUES = st.recursive(st.none() | st.booleans() | st.integers(-(2**64), 2**64 - 1) | st.text(max_size=8) | st.binary(max_size=8), lambda v: st.lists(v, max_size=4) | st.dictionaries(st.text(max_size=4), v, max_size=4), max_leaves=12)


@settings(max_examples=150, deadline=None)
@given(VALUES)
def test_canonical_bytes_round_trip(value):
    import unicodedata

    def nfc(v):
        if isinstance(v, str):
            return unicodedata.normalize("NFC", v)
        if isinstance(v, list):
            return [nfc(x) for x in v]
        return {nfc(k): nfc(x) for k, x in v.items()} if isinstance(v, dict) else v

    if isinstance(value, dict) and len(nfc(value)) < len(value):
        return
    try:
        raw = cbor.encode(value)
        back = cbor.decode(raw)
    except cbor.Refused as e:
        assert e.rule in (cbor.UNIQUE,)  # keys that NFC makes equal
        return
    assert back == nfc(value) and cbor.encode(back) == raw


def test_identifiers(spark):
    named = {b"": "4oymiquy7qobjgx36tejs35zeqt24qpemsnzgtfeswmrw6csxbkq", b"hello": "ftze3os7wcrq4jxihmvmlopctynrmhs4d6tuexttaqzwfe4ltasa", b"\0": "ny2axhh7wn5jrhffittlw6akfr4jahj7wm3tq5ufcgrqmf5puaoq"}
    for data, name in named.items():
        assert ids.cid_of(data) == ids.PREFIX + name
        assert evaluate(spark, ids.cid(F.lit(bytearray(data)))) == (ids.PREFIX + name,)
        assert ids.digest_of(ids.PREFIX + name) == hashlib.sha256(data).digest()
    for bad, fault in [("sha2-256:abc", "MissingScheme"), ("pub:sha2-256", "Malformed"), ("pub:sha2-256:", "Malformed"), ("pub:md5:aaaa", "UnknownAlgorithm"), ("pub:sha2-256:4OYM", "InvalidDigest"), ("pub:sha2-256:ab", "InvalidDigest"), ("pub:sha2-256:aaaa", "WrongDigestLength")]:
        with pytest.raises(ValueError, match=fault):
            ids.digest_of(bad)


def test_signatures():
    seed = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")
    key = ids.verifying_key(seed)
    assert key.hex() == "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a"
    made = ids.sign(seed, "authored", b"")
    assert made.hex() == "e8d29ab12b56e8bbe32d4d90c6c57d035cb67b5591c24c786b926bd0fa867d0a1a8518e7228c222699e66c5bc16057a08923baecf2e4aa13dfcaf8427c624707"
    assert ids.verify("ed25519", key, made, "authored", "authored", b"")
    assert not ids.verify("ed25519", key, made, "authored", "endorse", b"") and not ids.verify("ed25519", key, made, "authored", "authored", b"x") and not ids.verify("rsa", key, made, "authored", "authored", b"")
    with pytest.raises(ValueError):
        ids.sign(seed, "a\0b", b"")


def test_packs():
    assert packs.unpack(packs.pack([b"", b"ab", b"c" * 300])) == [b"", b"ab", b"c" * 300]
    for bad in (b"\0\0", b"\0\0\0\5ab", b"\0\xff\xff\xff"):
        with pytest.raises(ValueError):
            packs.unpack(bad)


def test_log_roots(spark):
    rows = [(size, pos, bytearray.fromhex(LEAVES[pos])) for size in range(1, 9) for pos in range(size)]
    leaves = spark.createDataFrame(rows, "tree int, pos int, raw binary").select("tree", "pos", merkle.leaf_hash(F.col("raw")).alias("leaf"))
    found = merkle.levels(leaves, ["tree"])
    tops = {r["tree"]: (r["root"], r["size"]) for r in merkle.tops(found, ["tree"]).collect()}
    assert tops == {n: (ROOTS[n - 1], n) for n in range(1, 9)}
    paths = merkle.inclusion(found, ["tree"]).join(leaves, ["tree", "pos"]).join(merkle.tops(found, ["tree"]), "tree")
    check = lambda index: merkle.verify_inclusion(F.col("leaf"), index, F.col("size"), F.col("path"), F.col("root"))
    got = paths.select("tree", "pos", check(F.col("pos")).alias("right"), check(F.col("pos") + 1).alias("wrong"), F.size("path").alias("n")).collect()
    assert len(got) == 36 and all(r["right"] for r in got) and not any(r["wrong"] for r in got)


def test_log_consistency():
    hashes = [hashlib.sha256(b"\0" + bytes.fromhex(x)).digest() for x in LEAVES]
    for new in range(1, 9):
        for old in range(1, new + 1):
            proof = merkle.consistency_proof(hashes[:new], old)
            a, b = bytes.fromhex(ROOTS[old - 1]), bytes.fromhex(ROOTS[new - 1])
            assert merkle.verify_consistency(old, new, a, b, proof), (old, new)
            if old < new:
                assert not merkle.verify_consistency(old, new, b, b, proof)
                assert not merkle.verify_consistency(old, new, a, a, proof)
                assert not merkle.verify_consistency(old, new, a, b, proof[:-1])


def test_units():
    assert quantities.dimension("kg.m/s2") == "length:1 mass:1 time:-2" == quantities.dimension("N")
    assert quantities.dimension("J") == quantities.dimension("N.m") and quantities.dimension("km") == "length:1" and quantities.dimension("1") == ""
    assert quantities.dimension("furlong") is None and quantities.dimension(None) is None
