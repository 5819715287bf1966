"""From bytes to standings: a small graph read from objects, and the readers beside it."""

import hashlib
import json
import struct

import pytest
from pyspark.sql import functions as F

from lodegraph.model import ClaimGraph
from lodegraph.operators import gather, signing, standing, trees, trust
from lodegraph.sources import cbor, ids, objects, payloads

CREATED = "2026-01-01T00:00:00Z"


def made(kind, author, /, **body):
    return cbor.encode({"pub": "1", "type": kind, "created": CREATED, "author": author, "body": body})


def note(kind, author, target, /, **value):
    return made("claim.annotation", author, kind=kind, target=target, value=value)


@pytest.fixture(scope="module")
def graph(spark):
    claim = made("claim.prose", "ann", **{"class": "empirical", "lang": "en", "content": "Water boils.", "depends": [], "evidence": [{"kind": "method", "role": "method", "ref": "m"}]})
    proof = made("claim.prose", "ann", **{"class": "formal", "lang": "en", "content": "1 = 1", "depends": [], "evidence": []})
    rival = made("claim.prose", "dan", **{"class": "empirical", "lang": "en", "content": "It doesn't.", "depends": [], "evidence": [{"kind": "method", "role": "method", "ref": "m"}]})
    c, p, r = map(ids.cid_of, (claim, proof, rival))
    raw = [
        claim, proof, rival,
        note("trusts", "root", "bob"), note("trusts", "root", "cy", weight=3, subjects=["heat"]), note("trusts", "root", "bob", weight=9),
        note("verdict", "bob", c, finding="affirm"), note("verdict", "cy", c, finding="affirm"), note("verdict", "dan", c, finding="deny"), note("verdict", "bob", c, finding="perhaps"),
        note("settled", "bob", c, outcome="consistent"), note("settled", "cy", c, outcome="consistent", independence={"funding": "x"}), note("settled", "eve", c, outcome="consistent", independence={"funding": "x"}),
        note("settled", "robot", c, outcome="consistent"), note("settled", "fay", c, outcome="inconsistent", independence={"shared_materials": ["s"]}), note("settled", "gil", c, outcome="method-underspecified"),
        note("settled", "ann", p, outcome="verified"), note("affiliated", "x", "bob", org="lab", period={"from": "2020"}), note("affiliated", "x", "hal", org="lab", period={"to": "2019"}),
        made("claim.relation", "dan", kind="disputes", **{"from": r, "to": c}),
    ]
    rows = [(raw_bytes,) for raw_bytes in map(bytearray, raw)]
    held, bad = objects.split(objects.parsed(spark.createDataFrame(rows, "content binary")))
    assert bad.count() == 0
    keys = spark.createDataFrame([(k, "human", "ed25519", None, None) for k in ("bob", "cy", "eve", "fay", "gil", "dan")] + [("robot", "automated", "ed25519", None, None)], "cid string, principal string, alg string, pubkey binary, rotates string")
    g = ClaimGraph(spark, objects=held.cache(), claims=objects.claims(held), annotations=objects.annotations(held), relations=objects.relations(held), keys=keys)
    return g, c, p, r


def test_trust_edges(graph):
    got = {(r["src"], r["dst"]): (r["weight"], r["subjects"]) for r in gather.trust_edges(graph[0]).collect()}
    assert set(got) == {("root", "bob"), ("root", "cy")} and got["root", "cy"] == (3_000_000, ["heat"])
    assert got["root", "bob"][0] in (1_000_000, 9_000_000)


def test_weights_of_the_whole_unsigned_range(spark):
    """Twenty digits count as they are; what no unsigned 64-bit integer can hold is one unit."""
    rows = [("a", "x", 18446744073709551615), ("b", "y", 18446744073709551614), ("c", "z", 1000000000000), ("d", "u", 18446744073709551616), ("e", "v", -5), ("f", "w", 0)]
    notes = spark.createDataFrame([(cid, "root", "trusts", dst, None, f'{{"weight":{w}}}') for cid, dst, w in rows], "cid string, author string, kind string, target string, aspect string, value string")
    edges = gather.trust_edges(ClaimGraph(spark, annotations=notes))
    assert {r["dst"]: int(r["weight"]) for r in edges.collect()} == {"x": 18446744073709551615 * 10**6, "y": 18446744073709551614 * 10**6, "z": 10**18, "u": 10**6, "v": 10**6, "w": 0}
    shares = {r["dst"]: r["share"] for r in trust.shares(edges).collect()}
    total = sum(int(r["weight"]) for r in edges.collect())
    assert shares == {r["dst"]: int(r["weight"]) * 10**6 // total for r in edges.collect()}
    weights = {r["key"]: r["weight"] for r in trust.propagate(edges, spark.createDataFrame([("root", 1_000_000)], "key string, weight long"), rounds=2).collect()}
    assert weights["x"] > 0 and "w" not in weights


def test_evidence(spark, graph):
    g, c, p, r = graph
    weights = spark.createDataFrame([("bob", 500), ("cy", 300), ("dan", 100)], "key string, weight long")
    got = {x["target"]: x for x in gather.evidence_for(g, weights).collect()}
    e = got[c]
    assert (e["affirm"], e["deny"], e["abstain"], e["argued"]) == (800, 100, 0, 100)
    assert (e["consistent"], e["inconsistent"], e["inconclusive"]) == (4, 1, 1)
    assert (e["independent_consistent"], e["independent_inconsistent"]) == (2, 0)  # cy and eve share funding, robot isn't human
    assert got[p]["proof_checked"] and not got[c]["proof_checked"] and not e["retracted"]
    assert standing.standings(gather.evidence_for(g, weights)).filter(F.col("target") == c).first()["result"] == "accepted"


def test_ranking_and_why(spark, graph):
    g, c, p, r = graph
    roots = spark.createDataFrame([("root", 1_000_000)], "key string, weight long")
    ranked = gather.ranking(g, roots, standing.Policy(rounds=3)).collect()
    assert [x["rank"] for x in sorted(ranked, key=lambda x: x["rank"])] == [1, 2, 3] and min(ranked, key=lambda x: x["rank"])["target"] == c
    about = lambda *subjects: gather.why(g, c, roots, standing.Policy(rounds=3), list(subjects)).first()["affirm"]
    assert about("heat") > 0 and about("cold") > 0
    confined = {x["key"] for x in gather.weights_for(g, roots, standing.Policy(rounds=3), ["cold"]).collect()}
    assert confined == {"root", "bob"}
    assert len(gather.ranking(g, roots, standing.Policy(rounds=3), "formal").collect()) == 1


def test_sustained_resolution_removes_a_dispute(spark, graph):
    g, c, p, r = graph
    held, _ = objects.split(objects.parsed(spark.createDataFrame([(bytearray(note("resolution", "zed", c, outcome="sustained", grounds=[r])),)], "content binary")))
    more = ClaimGraph(spark, objects=g.objects, claims=g.claims, relations=g.relations, keys=g.keys, annotations=g.annotations.unionByName(objects.annotations(held)))
    assert gather.argued(g).count() == 1 and gather.argued(more).count() == 0


def test_signatures_and_rotation(spark):
    seeds = {n: hashlib.sha256(n.encode()).digest() for n in ("old", "new", "thief")}
    keys = spark.createDataFrame([(n, "human", "ed25519", bytearray(ids.verifying_key(s)), {"new": "old", "thief": "old"}.get(n)) for n, s in seeds.items()], "cid string, principal string, alg string, pubkey binary, rotates string")
    body = {n: n.encode() * 3 for n in ("new", "thief", "doc")}
    held = spark.createDataFrame([(n, bytearray(b)) for n, b in body.items()], "cid string, bytes binary")
    sig = lambda by, target, purpose, real=True: (f"{by}-{target}-{purpose}", by, target, purpose, bytearray(ids.sign(seeds[by], purpose, body[target] if real else b"other")))
    sigs = spark.createDataFrame([sig("old", "new", "rotation"), sig("new", "new", "rotation"), sig("thief", "thief", "rotation"), sig("old", "thief", "rotation", False), sig("old", "doc", "authored")], "cid string, author string, target string, purpose string, value binary")
    assert signing.verified(sigs, keys, held).count() == 4
    assert [tuple(r) for r in signing.rotations(sigs, keys, held).collect()] == [("old", "new")]
    trusted = spark.createDataFrame([("old",)], "key string")
    assert {r["cid"] for r in signing.unsigned(held, sigs, keys, trusted).collect()} == {"thief"}


def test_content_tree(spark):
    leaf = lambda c: hashlib.sha256(b"\0" + c).digest()

    def branch(header, children):
        out = b"\x02" + struct.pack("<Q", len(header)) + header
        for name, h in sorted(children.items()):
            out += struct.pack("<Q", len(name.encode())) + name.encode() + h
        return leaf(out)

    inner = branch(b"h", {"é": leaf(b"1"), "b": leaf(b"")})
    top = branch(b"", {"x": inner, "empty": branch(b"", {}), "a": leaf(b"2")})
    rows = [("t", None, "t", None, None), ("t/x", "t", "x", None, b"h"), ("t/x/é", "t/x", "é", b"1", None), ("t/x/b", "t/x", "b", b"", None), ("t/empty", "t", "empty", None, None), ("t/a", "t", "a", b"2", None)]
    nodes = spark.createDataFrame([(a, b, c, None if d is None else bytearray(d), None if e is None else bytearray(e)) for a, b, c, d, e in rows], "path string, parent string, name string, content binary, header binary")
    got = {r["path"]: r["hash"] for r in trees.hashes(nodes).collect()}
    assert got["t"] == top.hex() and got["t/x"] == inner.hex()
    assert [r["path"] for r in trees.leaves(nodes).collect()] == ["t/a", "t/x/b", "t/x/é"] and trees.find(nodes, "t/x").count() == 1


def test_payloads(spark, tmp_path):
    good = {"roots": [{"key": "k", "weight": 2}], "damping": 850000, "iterations": 20, "tau": 660000, "delta_max": 290000, "replication_floor": 2, "independence_distance": 2, "equivalence": "none"}
    raw = [made("policy", "a", **good), made("policy", "a", **(good | {"iterations": 201})), made("policy", "a", **(good | {"roots": []})), made("policy", "a", **{k: v for k, v in good.items() if k != "tau"})]
    raw += [made("domain", "a", snapshot="s", bound=10, size=11), made("generation", "a", domain="d", index=3, parent="p", snapshot="s", added=["x", "y"], removed=[{"cid": "z", "cause": "split", "ref": "r"}, {"cid": "w", "cause": "whim"}])]
    raw += [made("bounty", "a", policy=ids.cid_of(b"p"), target=ids.cid_of(b"t"), base_share=6000), made("bounty", "a", kind="gift", policy="p", target=ids.cid_of(b"t"), base_share=1)]
    held, _ = objects.split(objects.parsed(spark.createDataFrame([(bytearray(x),) for x in raw], "content binary")))
    found = payloads.policies(held)
    assert sorted(str(r["fault"]) for r in found.collect()) == ["None", "missing or ill-typed field", "no root with weight", "too many iterations"]
    assert [(r["key"], r["weight"]) for r in payloads.policy_roots(found).collect()] == [("k", 2_000_000)]
    usable = found.filter("fault IS NULL").first()
    assert payloads.as_policy(usable) == standing.Policy() and not usable["use_equivalence"]
    assert payloads.manifests(held).first()["fault"] == "larger than its bound"
    g, added, removed = payloads.generations(held)
    assert g.first()["idx"] == 3 and added.count() == 2
    from lodegraph.operators import domains

    assert [r["cid"] for r in domains.removal_faults(removed).collect()] == ["w"]
    assert sorted(r["rule"] for r in payloads.bounty_faults(held).collect()) == ["no policy", "review share too small", "unknown kind"]
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "good-name.json").write_text(json.dumps({"a": [1, True, None], "b": {"$bytes": "00ff"}}))
    (tmp_path / "Bad Name.json").write_text("{}")
    (tmp_path / "float.json").write_text('{"a": [1, 2.5]}')
    got = {r["slug"]: (r["body"], r["fault"]) for r in payloads.named_sources(spark, str(tmp_path)).collect()}
    assert got["good-name"] == ('{"a": [1, true, null], "b": {"$bytes": "00ff"}}', None)
    assert got["float"] == (None, "$.a[1]: no floating point") and len(got) == 3


@pytest.mark.parametrize(("change", "want"), [({}, "accepted"), ({"reproductions": {}}, "unreplicated"), ({"affirm": [], "deny": ["a"]}, "rejected"), ({"class": "normative"}, "not-truth-apt"), ({"retracted": True}, "rejected"), ({"argued_disputes": ["spam1", "spam2"]}, "accepted")])
def test_evaluation_vector(spark, change, want):
    policy = cbor.encode({"roots": [{"key": "r", "weight": 1}], "damping": 850000, "iterations": 20, "tau": 660000, "delta_max": 290000, "replication_floor": 2, "independence_distance": 2})
    vector = {"policy": policy, "edges": [{"from": "r", "to": "a", "weight": 1}, {"from": "spam1", "to": "spam2", "weight": 1}], "class": "empirical", "affirm": ["a"], "deny": [], "reproductions": {"independent_consistent": 2}} | change
    got = payloads.evaluated(spark, cbor.encode(vector))
    assert got["result"] == want and got["delta"] == "0.000000"


def test_migration(spark):
    from lodegraph.sources import migrate

    a = made("claim.prose", "ann", content="one")
    b = made("claim.relation", "ann", kind="supports", **{"from": ids.cid_of(a), "to": "elsewhere"})
    c = made("doc", "ann", sections=[{"items": [{"ref": ids.cid_of(b)}, {"ref": ids.cid_of(a)}]}])
    d = made("domain", "ann", snapshot=ids.cid_of(a))
    loop = [("p" * 5, made("x", "ann", to="pub:sha2-256:q")), ("pub:sha2-256:q", made("x", "ann", to="pub:sha2-256:r")), ("pub:sha2-256:r", made("x", "ann", to="pub:sha2-256:q"))]
    rows = [(ids.cid_of(x), bytearray(x)) for x in (a, b, c, d)] + [(k, bytearray(v)) for k, v in loop]

    def scoped(value):
        return value | {"body": value["body"] | {"scope": "all"}} if value["type"] == "claim.relation" else value

    done, stuck = migrate.migrate(spark.createDataFrame(rows, "cid string, content binary"), scoped)
    got = {r["old"]: (r["new"], cbor.decode(bytes(r["content"]))) for r in done.collect()}
    assert got[ids.cid_of(a)][0] == ids.cid_of(a)
    new_b, value = got[ids.cid_of(b)]
    assert value["body"]["scope"] == "all" and new_b == ids.cid_of(cbor.encode(value)) != ids.cid_of(b)
    assert got[ids.cid_of(c)][1]["body"]["sections"][0]["items"] == [{"ref": new_b}, {"ref": ids.cid_of(a)}]
    assert ids.cid_of(d) not in got and {r["cid"] for r in stuck.collect()} == {"ppppp", "pub:sha2-256:q", "pub:sha2-256:r"}
