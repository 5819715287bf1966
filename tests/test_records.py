"""Edge cases of definitions, admission checks, cycles and a node's answers."""

import json

import pytest

from lodegraph.operators import admission, fixpoint, merkle, quantities, standing
from lodegraph.sources import definitions, ids, node, payloads

CID = ids.cid_of(b"kind")


def test_bodies_that_are_not_read(spark):
    rows = [("a", "claim.prose", None), ("b", "claim.prose", "not json"), ("c", "claim.prose", '{"defines":null}'), ("d", "doc", '{"defines":{"sort":"kind"}}'), ("e", "claim.prose", '{"class":"formal"}')]
    of = spark.createDataFrame(rows, "cid string, kind string, body string")
    found = {r["cid"]: (r["sort"], r["term"], r["cited"], r["fault"]) for r in definitions.definitions(of).collect()}
    assert found == {"c": (None, None, [], "defines")}
    assert definitions.calculations(of).count() == 0
    assert definitions.views(of).count() == 0
    assert definitions.definitions(of.limit(0)).count() == 0


def test_boundary_lines_and_slots(spark):
    bad = ['{"includes":["a"]}', '{"includes":[""],"excludes":[]}', '{"includes":"a","excludes":[]}', "[]"]
    bodies = [f'{{"defines":{{"sort":"concept","pdc":"p","name":"n","kind":"{CID}","boundary":{b}}}}}' for b in bad]
    slots = '{"defines":{"sort":"concept","pdc":"p","name":"n","relation":{"statement":"s","form":"explicit","slots":[{"role":"a","concept":"x","kind":"%s"},{"role":"b","concept":"y"}]}}}'
    rows = [(str(i), "claim.prose", b) for i, b in enumerate([*bodies, slots % CID])]
    found = definitions.definitions(spark.createDataFrame(rows, "cid string, kind string, body string"))
    assert [r["fault"] for r in found.orderBy("cid").collect()] == ["defines.boundary"] * 4 + ["defines.relation.slots"]


def test_cited_claims_must_be_rested_on(spark):
    body = f'{{"computes":{{"inputs":[{{"name":"a","kind":"{CID}"}}]}}}}'
    found = definitions.calculations(spark.createDataFrame([("a", "claim.prose", body), ("b", "claim.prose", body)], "cid string, kind string, body string"))
    depends = spark.createDataFrame([("a", CID)], "cid string, dep string")
    assert [tuple(r) for r in definitions.undeclared(found, depends).collect()] == [("b", "computes.inputs", CID)]


@pytest.mark.parametrize("shift", [0, 3])
def test_cycles(spark, shift):
    # 0 -> 1 -> 2 -> 0 with a tail 5 -> 0 of a lower name after the shift, a self-edge on 4, and 6 -> 7 without a cycle.
    pairs = [(0, 1), (1, 2), (2, 0), (5, 0), (4, 4), (6, 7), (2, 7)]
    edges = [((a + shift) % 8, (b + shift) % 8) for a, b in pairs]
    found = fixpoint.cycles(spark.createDataFrame([(n,) for n in range(8)], "node long"), spark.createDataFrame(edges, "src long, dst long"))
    ring = [(n + shift) % 8 for n in (0, 1, 2)]
    least = ring.index(min(ring))
    path = ring[least:] + ring[:least]
    alone = (4 + shift) % 8
    assert {r["cycle"]: r["path"] for r in found.collect()} == {path[0]: [*path, path[0]], alone: [alone, alone]}


def test_no_cycle(spark):
    found = fixpoint.cycles(spark.createDataFrame([(1,), (2,)], "node long"), spark.createDataFrame([(1, 2)], "src long, dst long"))
    assert found.count() == 0


def test_domains(spark):
    members = spark.createDataFrame([("a", 5), ("b", 6)], "cid string, size long")
    none = spark.createDataFrame([], "cid string, dep string")
    relations = spark.createDataFrame([("disputes", "a", "z")], "kind string, src string, dst string")
    assert admission.domain_faults(members, none, relations, 11).count() == 0
    assert [tuple(r) for r in admission.domain_faults(members, none, relations, 10).collect()] == [("bound", None, 11)]
    with pytest.raises(ValueError):
        admission.domain_faults(members, none, relations, 10, ("disputes",))


def test_requirements_of_folders(spark):
    declared = spark.createDataFrame([("a", None, "0.1"), ("a/b", " # only a note", ""), ("a/b/c", "^0.2", "0.1")], "dir string, config string, file string")
    asked = spark.createDataFrame([("a/b/c/d",), ("a/b",), ("ab",)], "dir string")
    found = {r["dir"]: (r["requirement"], r["stated_in"], r["status"]) for r in admission.requirements(asked, declared, "0.2.7").collect()}
    assert found == {"a/b/c/d": ("^0.2", "a/b/c/config", "met"), "a/b": ("0.1", "a/file", "unmet"), "ab": (None, None, "none")}


def test_proofs_at_the_ends_and_in_an_empty_set(spark):
    of = lambda *names: spark.createDataFrame([(n,) for n in names], "member string")
    members = of("b", "d", "f")
    found = {r["member"]: (r["finding"], r["verified"]) for r in node.membership_proofs(members, of("a", "b", "c", "f", "g")).collect()}
    assert found == {"a": ("absent", True), "b": ("present", True), "c": ("absent", True), "f": ("present", True), "g": ("absent", True)}
    assert [tuple(r) for r in node.membership_proofs(of(), of("a")).collect()] == [("a", "absent", True, merkle.EMPTY_ROOT)]


def test_policies_come_back_as_they_were_written(spark):
    policy = standing.Policy(damping=700_000, rounds=5, half_life=30)
    of = spark.createDataFrame([("p", "policy", json.dumps(payloads.policy_body(policy, {"b": 2, "a": 0}, False)))], "cid string, kind string, body string")
    found = payloads.policies(of)
    row = found.first()
    assert payloads.as_policy(row) == policy
    assert (row["fault"], row["use_equivalence"]) == (None, False)
    assert sorted(tuple(r) for r in payloads.policy_roots(found).collect()) == [("p", "a", 0), ("p", "b", 2_000_000)]
    for roots in ({}, {"a": 0}, {"a": 1, "b": -1}):
        with pytest.raises(ValueError):
            payloads.policy_body(policy, roots)


def test_offers(spark):
    store = spark.createDataFrame([(ids.cid_of(b"x"), bytearray(b"x"))], "cid string, content binary")
    offers = spark.createDataFrame([(bytearray(b"x"),), (bytearray(b"y"),), (bytearray(b"y"),)], "content binary")
    assert {(r["cid"], r["status"]) for r in node.offered(offers, store).collect()} == {(ids.cid_of(b"x"), "held"), (ids.cid_of(b"y"), "accepted")}
    asked = spark.createDataFrame([(ids.cid_of(b"x"),), (ids.cid_of(b"z"),), ("x",), (None,)], "cid string")
    assert sorted(r["status"] for r in node.looked_up(asked, store).collect()) == ["found", "ill-formed", "ill-formed", "unknown"]


@pytest.mark.parametrize(
    ("unit", "found"),
    [
        ("kg.m/s2", "length:1 mass:1 time:-2"),
        ("N/m2", "length:-1 mass:1 time:-2"),
        ("/s", "time:-1"),
        ("J/(kg.K)", "length:2 time:-2 temperature:-1"),
        ("m/(s.(s))", "length:1 time:-2"),
        ("kg{CO2e}/{tray}", "mass:1"),
        ("{tray}", ""),
        ("10*3/uL", "length:-3"),
        ("[ft_i]/min", "length:1 time:-1"),
        ("mmol/L", "length:-3 amount:1"),
        ("dam2", "length:2"),
        ("MiBy", ""),
        ("100.m-1", "length:-1"),
        ("kmin", None),
        ("m//s", None),
        ("m.", None),
        ("(m", None),
        ("m)", None),
        ("mm2m", None),
        ("furlong", None),
        ("", None),
        (None, None),
    ],
)
def test_dimensions(unit, found):
    assert quantities.dimension(unit) == found
