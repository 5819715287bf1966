"""Definitions, calculations, views, admission checks, a node's answers, and standings from annotations, over the harness tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import CLAIM_CLASSES, PROHIBITIONS, RELATION_CLASSES, REPRODUCIBILITY, ClaimGraph
from ..operators import admission, fixpoint, gather, standing
from ..sources import definitions, node, payloads
from . import sets, trust
from .common import PART_EDGES_SQL, part_edges, table

#: Bodies that parts take turns at: what is defined, its term (@name is the part's name), what it cites, the fault.
DEFINITIONS = (
    ('{"sort":"system","name":"@name","version":"2"}', "@name", "", ""),
    ('{"sort":"system","name":"@name"}', "", "", "defines.version"),
    ('{"sort":"system","name":7,"version":"2"}', "", "", "defines.name"),
    ('{"sort":"dimension","symbol":"{@name}"}', "{@name}", "", ""),
    ('{"sort":"dimension","symbol":"[@name]"}', "[@name]", "", ""),
    ('{"sort":"dimension","symbol":"{a}{@name}"}', "", "", "defines.symbol"),
    ('{"sort":"dimension","symbol":"@name"}', "", "", "defines.symbol"),
    ('{"sort":"unit","symbol":"[@name]","value":"-12.50","unit":"kg"}', "[@name]", "", ""),
    ('{"sort":"unit","symbol":"[@name]","value":"1e3","unit":"kg"}', "", "", "defines.value"),
    ('{"sort":"unit","symbol":"[@name]","value":"1","unit":""}', "", "", "defines.unit"),
    ('{"sort":"kind","name":"@name","dimension":{"g":1,"m":-2},"units":["g/m2"]}', "@name", "", ""),
    ('{"sort":"kind","name":"@name","dimension":{}}', "@name", "", ""),
    ('{"sort":"kind","name":"@name","dimension":{"g":"1"}}', "", "", "defines.dimension"),
    ('{"sort":"kind","name":"@name","dimension":{"g":1},"units":[]}', "", "", "defines.units"),
    ('{"sort":"measure","name":"@name","describes":"variation","parameters":[{"name":"mean","type":"quantity","meaning":"m"},{"name":"n","type":"count","meaning":"m"}]}', "@name", "", ""),
    ('{"sort":"measure","name":"@name","describes":"all","parameters":[{"name":"n","type":"count","meaning":"m"}]}', "", "", "defines.describes"),
    ('{"sort":"measure","name":"@name","describes":"exact","parameters":[{"name":"n","type":"count","meaning":"m"},{"name":"n","type":"count","meaning":"m"}]}', "", "", "defines.parameters.name"),
    ('{"sort":"measure","name":"@name","describes":"exact","parameters":[{"name":"n","type":"int","meaning":"m"}]}', "", "", "defines.parameters.type"),
    ('{"sort":"concept","pdc":"@name","name":"n","kind":"@cid","boundary":{"includes":["a"],"excludes":[]}}', "@name", "defines.kind=@cid", ""),
    ('{"sort":"concept","pdc":"@name","name":"n"}', "@name", "", ""),
    ('{"sort":"concept","pdc":"@name","name":"n","kind":"@cid"}', "", "", "defines.boundary"),
    ('{"sort":"concept","pdc":"@name","name":"n","kind":"cid","boundary":{"includes":[],"excludes":[]}}', "", "", "defines.kind"),
    ('{"sort":"concept","pdc":"@name","name":"n","kind":"@cid","relation":{}}', "", "", "defines"),
    ('{"sort":"concept","pdc":"@name","name":"n","relation":{"statement":"s","slots":[{"role":"a","kind":"@cid"},{"role":"b","concept":"x"}],"form":"explicit"}}', "@name", "defines.relation.slots.kind=@cid", ""),
    ('{"sort":"concept","pdc":"@name","name":"n","relation":{"statement":"s","slots":[{"role":"a","concept":"y"},{"role":"b","concept":"x"}],"form":{"product":{"coefficient":"0.5","exponents":{"b":"-0.5","a":2}}}}}', "@name", "", ""),
    ('{"sort":"concept","pdc":"@name","name":"n","relation":{"statement":"s","slots":[{"role":"a","concept":"y"},{"role":"b","concept":"x"}],"form":{"product":{"coefficient":"0.0","exponents":{"b":1,"a":2}}}}}', "", "", "defines.relation.form.product"),
    ('{"sort":"concept","pdc":"@name","name":"n","relation":{"statement":"s","slots":[{"role":"a","concept":"y"},{"role":"b","concept":"x"}],"form":{"product":{"coefficient":"1","exponents":{"c":1,"a":2}}}}}', "", "", "defines.relation.form.product"),
    ('{"sort":"concept","pdc":"@name","name":"n","relation":{"statement":"s","slots":[{"role":"a","concept":"y"},{"role":"a","concept":"x"}],"form":"explicit"}}', "", "", "defines.relation.slots.role"),
    ('{"sort":"concept","pdc":"@name","name":"n","relation":{"statement":"s","slots":[{"role":"a","concept":"y"}],"form":"explicit"}}', "", "", "defines.relation.slots"),
    ('{"sort":"singular","name":"@name","class":"c","part_of":"@cid","location":{"h3":"8a089b1a2177fff"}}', "@name", "defines.part_of=@cid", ""),
    ('{"sort":"singular","name":"@name","class":"c","location":{"h3":"8A089b1a2177fff"}}', "", "", "defines.location.h3"),
    ('{"sort":"singular","name":"@name","class":"c","location":{"h3":"8a089b1a2177fff","x":1}}', "", "", "defines.location"),
    ('{"sort":"other"}', "", "", "defines.sort"),
    ("[]", "", "", "defines"),
)
#: Calculations: the body, roles and cited claims joined, the fault.
CALCULATIONS = (
    ('{"inputs":[{"name":"a","kind":"@cid"}],"outputs":[{"name":"b","kind":"@cid"}],"rounding":"up","seed":18446744073709551615}', "", "computes.inputs=@cid computes.outputs=@cid", ""),
    ("{}", "", "", ""),
    ('{"inputs":[{"name":"a","kind":"@cid"},{"name":"a","kind":"@cid"}]}', "", "", "computes.inputs"),
    ('{"outputs":[{"name":"b","kind":"pub"}]}', "", "", "computes.outputs"),
    ('{"solves":{"concept":"x","target":"t","requires":["r1","_r"],"optional":[{"role":"o","default":"@cid"}]}}', "t,r1,_r,o", "computes.solves.optional.default=@cid", ""),
    ('{"solves":{"concept":"x","target":"t","requires":["t"]}}', "", "", "computes.solves"),
    ('{"solves":{"concept":"x","target":"1t"}}', "", "", "computes.solves.target"),
    ('{"solves":{"concept":"x","target":"t","requires":["a b"]}}', "", "", "computes.solves.requires"),
    ('{"solves":{"concept":"x","target":"t","optional":[{"role":"o"}]}}', "", "", "computes.solves.optional.default"),
    ('{"solves":{"target":"t"}}', "", "", "computes.solves.concept"),
    ('{"seed":-1}', "", "", "computes.seed"),
    ('{"rounding":2}', "", "", "computes.rounding"),
    ('"x"', "", "", "computes"),
)
#: Views of an item: the value, the options read, the fault.
VIEWS = (('{"renderer":"table"}', "{}", ""), ('{"renderer":"@name","options":{"a":[1,"b"]}}', '{"a":[1,"b"]}', ""), ('{"options":{}}', "{}", "items.view.renderer"), ('{"renderer":"r","options":[]}', "", "items.view.options"), ('{"renderer":""}', "{}", "items.view.renderer"))
VERSION = "0.2.7"
REQUIREMENTS = ("0.2.2+", "^0.2 # the line in use", "0.3", "latest", "0.2")
STATUS = ("met", "met", "unmet", "ill-formed", "met")
BOUND = 4_000
#: Authors of every fourth part's claim, by the part's number.
NATIONS = ("NATION_0", "NATION_7", "NATION_14", "NATION_3", "NATION_20")


def _cid(number: Column) -> Column:
    return F.concat(F.lit("pub:sha2-256:"), F.lpad(F.translate(number.cast("string"), "0123456789", "abcdefghij"), 51, "a"), F.lit("a"))


def _cid_sql(number: str) -> str:
    return f"('pub:sha2-256:' || lpad(translate(CAST({number} AS VARCHAR), '0123456789', 'abcdefghij'), 51, 'a') || 'a')"


def _turn(values: list[str], of: str = "p_partkey") -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(of) % len(values) + 1).cast("int"))


def _turn_sql(values: list[str], of: str = "p_partkey") -> str:
    listed = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"([{listed}])[CAST({of} % {len(values)} AS INT) + 1]"


def _bodies(spark: SparkSession, sf_dir: str, field: str, forms: tuple) -> DataFrame:
    """(cid, kind, body): a claim for each part, its field one of the forms in turn."""
    p = table(spark, sf_dir, "part")
    value = F.replace(F.replace(_turn([f[0] for f in forms]), F.lit("@name"), F.col("p_name")), F.lit("@cid"), _cid(F.col("p_size")))
    return p.select(_cid(F.col("p_partkey")).alias("cid"), F.lit("claim.prose").alias("kind"), F.concat(F.lit(f'{{"class":"formal","{field}":'), value, F.lit("}")).alias("body"))


def _named(cited: str = "cited") -> Column:
    return F.array_join(F.transform(cited, lambda c: F.concat_ws("=", c["field"], c["cid"])), " ")


def definitions_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = definitions.definitions(_bodies(spark, sf_dir, "defines", DEFINITIONS))
    return found.select("cid", F.coalesce("sort", F.lit("")).alias("sort"), F.coalesce("term", F.lit("")).alias("term"), _named().alias("cited"), F.coalesce("fault", F.lit("")).alias("fault"))


def definitions_undeclared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What definitions cite, where the claim rests on parts of odd sizes alone."""
    found = definitions.definitions(_bodies(spark, sf_dir, "defines", DEFINITIONS))
    p = table(spark, sf_dir, "part").filter("p_size % 2 = 1")
    return definitions.undeclared(found, p.select(_cid(F.col("p_partkey")).alias("cid"), _cid(F.col("p_size")).alias("dep")))


def calculations_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = definitions.calculations(_bodies(spark, sf_dir, "computes", CALCULATIONS))
    return found.select("cid", F.coalesce(F.array_join("roles", ","), F.lit("")).alias("roles"), _named().alias("cited"), F.coalesce("fault", F.lit("")).alias("fault"))


def views_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each part: an item without a view, and one with a view of each form in a section of its own."""
    p = table(spark, sf_dir, "part")
    value = F.replace(_turn([v[0] for v in VIEWS]), F.lit("@name"), F.col("p_name"))
    body = F.concat(F.lit('{"sections":[{"items":[{"ref":"a"}]},{"items":[{"ref":"b","view":'), value, F.lit("}]}]}"))
    found = definitions.views(p.select(_cid(F.col("p_partkey")).alias("cid"), F.lit("doc").alias("kind"), body.alias("body")))
    return found.select("doc", "pos", F.coalesce("renderer", F.lit("")).alias("renderer"), F.coalesce("options", F.lit("")).alias("options"), F.coalesce("fault", F.lit("")).alias("fault"))


def build_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in rings of four, each in credit resting on the next; suppliers rest on customers and lie above the rings."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("bigint").alias("node"), "c_acctbal")
    ring = c.filter("c_acctbal > 0").select(F.col("node").alias("src"), F.expr("node div 4 * 4 + (node + 1) % 4").alias("dst"))
    s = table(spark, sf_dir, "supplier").select((-1 - F.col("s_suppkey")).cast("bigint").alias("src"), F.col("s_suppkey").cast("bigint").alias("dst"))
    found = fixpoint.cycles(c.select("node").union(s.select(F.col("src").alias("node"))), ring.union(s))
    return found.select("cycle", F.array_join(F.transform("path", lambda x: x.cast("string")), " -> ").alias("path"))


def _folders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    asked = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat_ws("/", "n_regionkey", "n_nationkey", "s_suppkey").alias("dir"))
    nations = n.filter("n_nationkey % 3 > 0").select(F.concat_ws("/", "n_regionkey", "n_nationkey").alias("dir"), F.when(F.expr("n_nationkey % 3 = 1"), _turn(list(REQUIREMENTS), "n_nationkey")).otherwise("# none").alias("config"), _turn(list(REQUIREMENTS), "n_nationkey").alias("file"))
    regions = table(spark, sf_dir, "region").filter("r_regionkey > 0").select(F.col("r_regionkey").cast("string").alias("dir"), F.lit(None).cast("string").alias("config"), F.lit("^0.2").alias("file"))
    return asked, nations.union(regions)


def requirement_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admission.requirements(*_folders(spark, sf_dir), VERSION)


def translation_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    method = F.when(F.expr("o_custkey % 7 > 0"), _turn(["human", "machine", "machine-post-edited", "robot"], "o_custkey"))
    fidelity = F.when(F.expr("o_custkey % 11 > 0"), _turn(["literal", "idiomatic", "adapted", "loose", "exact"], "o_orderkey"))
    return o.select("o_orderkey", admission.translation_fault(method, fidelity).alias("fault"))


def edge_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = part_edges(spark, sf_dir).withColumn("kind", _turn(list(RELATION_CLASSES), "src"))
    return e.select("src", "dst", "kind", admission.edge_note(F.col("kind"), F.col("src").cast("string"), F.col("dst").cast("string")).alias("note"))


def claim_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as claims: long types hold data, small sizes state no source; those without blanks in their name lack content."""
    p = table(spark, sf_dir, "part")
    claims = p.select(F.col("p_partkey").alias("cid"), F.concat(F.col("p_name"), F.when(F.expr("p_size % 3 = 0"), ". It is so").otherwise("")).alias("content"), (F.length("p_type") > 18).alias("has_data"))
    return admission.warnings(claims, p.filter("p_size > 20").select(F.col("p_partkey").alias("cid")))


def domain_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts but the largest as a domain, closed under depends and the equivalence of every third part with the next."""
    p = table(spark, sf_dir, "part")
    members = p.filter("p_size < 48").select(F.col("p_partkey").cast("bigint").alias("cid"), F.col("p_size").cast("bigint").alias("size"))
    depends = part_edges(spark, sf_dir).select(F.col("src").cast("bigint").alias("cid"), F.col("dst").cast("bigint").alias("dep"))
    same = p.filter("p_partkey % 3 = 0").select(F.lit("equivalent").alias("kind"), F.col("p_partkey").cast("bigint").alias("src"), (F.col("p_partkey") + 1).cast("bigint").alias("dst"))
    return admission.domain_faults(members, depends, same, BOUND, ("equivalent", "translates"))


def filled_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    text = _turn(["run {in} to {out}", "{out}{out}", "plain", "{other} {in}", "{in"])
    return p.select("p_partkey", admission.filled(text, {"in": F.col("p_brand"), "out": F.col("p_type")}).alias("command"))


def prohibitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule each customer's segment falls under, if any."""
    c = table(spark, sf_dir, "customer").select(_turn([*PROHIBITIONS, "none"], "c_custkey").alias("rule"))
    return c.groupBy("rule").agg(F.count(F.lit(1)).alias("n")).select("rule", "n", admission.prohibition_reason(F.col("rule")).alias("reason"))


def bounty_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    pair = lambda name, value: F.concat(F.lit(f'"{name}":"'), value, F.lit('"'))
    kind = F.when(F.expr("o_orderkey % 3 > 0"), pair("kind", _turn(["review", "replication", "access", "equivalence", "mirror", "gift"], "o_custkey")))
    policy = F.when(F.expr("o_custkey % 5 > 0"), pair("policy", _cid(F.col("o_custkey"))))
    target = pair("target", F.when(F.expr("o_custkey % 4 > 0"), _cid(F.col("o_orderkey"))).otherwise("part"))
    share = F.when(F.expr("o_custkey % 6 > 0"), F.concat(F.lit('"base_share":'), (F.col("o_custkey") * 37 % 10001).cast("string")))
    body = F.concat(F.lit("{"), F.concat_ws(",", kind, policy, target, share), F.lit("}"))
    return payloads.bounty_faults(o.select(F.col("o_orderkey").alias("cid"), F.lit("bounty").alias("kind"), body.alias("body")))


def _store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(_cid(F.col("s_suppkey")).alias("cid"), F.col("s_name").cast("binary").alias("content"), F.col("s_nationkey").cast("bigint").alias("domain"), "s_acctbal")


def node_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers ask for suppliers' objects by number; every ninth asks by a name that isn't an identifier."""
    asked = table(spark, sf_dir, "customer").select(F.when(F.expr("c_custkey % 9 = 0"), F.col("c_name")).otherwise(_cid(F.col("c_custkey"))).alias("cid"))
    return node.looked_up(asked, _store(spark, sf_dir)).select("cid", "status", F.lower(F.hex("content")).alias("content"))


def node_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers of part names; those of small parts are held."""
    from ..sources import ids

    p = table(spark, sf_dir, "part").select("p_size", F.col("p_name").cast("binary").alias("content"))
    store = p.filter("p_size < 5").select(ids.cid(F.col("content")).alias("cid"))
    return node.offered(p, store).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def node_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, sf_dir)
    return node.frames(store.select("domain", "cid"), store.filter("s_acctbal > 0")).select("domain", "cid", F.lower(F.hex("frame")).alias("frame"))


def node_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which generations of nations' domains are held: a customer's number within the nation's region asks for one."""
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("bigint").alias("domain"), F.col("n_nationkey").cast("bigint").alias("idx"), F.col("n_name").alias("snapshot"))
    asked = table(spark, sf_dir, "customer").select(F.expr("c_custkey % 5").cast("bigint").alias("domain"), F.col("c_nationkey").cast("bigint").alias("idx"))
    return node.record(n, asked)


def node_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    removed = o.select(F.col("o_orderpriority").alias("domain"), F.col("o_orderkey").alias("idx"), F.col("o_custkey").alias("cid"), F.col("o_orderdate").cast("date").cast("string").alias("cause"))
    return node.tombstoned(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cid")), removed)


def node_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether customers' numbers name suppliers, each answer shown against one root."""
    members = table(spark, sf_dir, "supplier").filter("s_suppkey % 3 > 0").select(F.lpad(F.col("s_suppkey").cast("string"), 9, "0").alias("member"))
    asked = table(spark, sf_dir, "customer").select(F.lpad((F.col("c_custkey") * 2).cast("string"), 9, "0").alias("member"))
    return node.membership_proofs(members, asked)


def _json(name: str, value: Column, quoted: bool = True) -> Column:
    mark = '"' if quoted else ""
    return F.concat(F.lit(f'{{"{name}":{mark}'), value, F.lit(f"{mark}}}"))


def annotated_graph(spark: SparkSession, sf_dir: str) -> ClaimGraph:
    """Parts as claims; nations judge them and vouch for each other, suppliers repeat them, parts dispute parts."""
    p = table(spark, sf_dir, "part").withColumn("cid", F.concat(F.lit("part-"), F.col("p_partkey").cast("string"))).withColumn("by", F.when(F.expr("p_partkey % 4 = 2"), _turn(list(NATIONS))).otherwise(_turn(["alpha", "beta"], "p_size")))
    n = table(spark, sf_dir, "nation")
    claims = p.select("cid", F.col("by").alias("author"), _turn(list(CLAIM_CLASSES)).alias("class"), F.lit("en").alias("lang"), F.col("p_name").alias("content"), _turn([*REPRODUCIBILITY, "other"], "p_size").alias("repro_class"), F.lit(None).cast("string").alias("term"), F.lit(None).cast("string").alias("def_sort"))
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("part-"), F.col("l_partkey").cast("string")).alias("target"), "l_returnflag", "l_suppkey", "l_quantity")
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")).join(n.select("n_nationkey", "n_name"), "n_nationkey")
    buyers = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")).join(customer, "c_custkey")
    rows = line.join(buyers, "l_orderkey").withColumn("id", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    none = F.lit(None).cast("string")
    finding = F.when(F.col("l_returnflag") == "N", "affirm").when(F.col("l_returnflag") == "R", "deny").otherwise("abstain")
    outcome = F.when(F.col("l_returnflag") == "N", "consistent").when(F.col("l_returnflag") == "R", "inconsistent").otherwise("inconclusive")
    judged = rows.select(F.concat(F.lit("v-"), "id").alias("cid"), F.col("n_name").alias("author"), F.lit("verdict").alias("kind"), "target", none.alias("aspect"), _json("finding", finding).alias("value"))
    repeated = rows.filter("l_quantity > 40").select(F.concat(F.lit("s-"), "id"), F.concat(F.lit("supplier-"), F.col("l_suppkey").cast("string")), F.lit("settled"), "target", none, _json("outcome", outcome))
    proved = p.filter("p_partkey % 4 = 1").select(F.concat(F.lit("p-"), "cid"), F.lit("alpha"), F.lit("settled"), "cid", none, _json("outcome", F.lit("verified")))
    vouched = trust.nation_edges(spark, sf_dir).select(F.concat_ws("-", F.lit("t"), "src", "dst"), "src", F.lit("trusts"), "dst", none, _json("weight", F.col("weight").cast("string"), False))
    resolved = p.filter("p_partkey % 6 = 0").select(F.concat(F.lit("r-"), "cid"), F.lit("alpha"), F.lit("resolution"), F.concat(F.lit("part-"), F.expr("p_partkey div 2").cast("string")), none, F.concat(F.lit('{"outcome":"sustained","grounds":["'), "cid", F.lit('"]}')))
    disputes = p.filter("p_partkey % 2 = 0").select(F.concat(F.lit("d-"), "cid").alias("cid"), F.lit("alpha").alias("author"), F.lit("disputes").alias("kind"), F.col("cid").alias("src"), F.concat(F.lit("part-"), F.expr("p_partkey div 2").cast("string")).alias("dst"), none.alias("aspect"))
    retracts = p.filter("p_partkey % 25 = 0").select(F.concat(F.lit("x-"), "cid"), F.lit("alpha"), F.lit("retracts"), F.concat(F.lit("part-"), (F.col("p_partkey") + 1).cast("string")), "cid", none)
    keys = table(spark, sf_dir, "supplier").select(F.concat(F.lit("supplier-"), F.col("s_suppkey").cast("string")).alias("cid"), F.when(F.expr("s_suppkey % 3 > 0"), "human").otherwise("organization").alias("principal"))
    objects = claims.select("cid", "author")
    return ClaimGraph(spark, claims=claims, annotations=judged.union(repeated).union(proved).union(vouched).union(resolved), relations=disputes.union(retracts), keys=keys, objects=objects)


def claim_standings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every claim's standing from annotations alone: trust, verdicts, disputes, resolutions, replications, proofs, retractions."""
    found = gather.ranking(annotated_graph(spark, sf_dir), trust._roots(spark, sf_dir), standing.Policy())
    return found.select("rank", "target", "class", "affirm", "deny", "abstain", "argued", "independent_consistent", "independent_inconsistent", "retracted", "delta", "result")


QUERIES = {f.__name__: f for f in (definitions_read, definitions_undeclared, calculations_read, views_read, build_cycles, requirement_gate, translation_faults, edge_notes, claim_warnings, domain_faults, filled_commands, prohibitions, bounty_faults, node_objects, node_offers, node_frames, node_records, node_tombstones, node_proofs, claim_standings)}


# The same in SQL.

_PUT = lambda text: f"replace(replace({text}, '@name', p_name), '@cid', {_cid_sql('p_size')})"
_FORM = lambda forms, i: _PUT(_turn_sql([f[i] for f in forms]))
_SORTS = [f[0].split('"sort":"')[1].split('"')[0] if '"sort"' in f[0] else "" for f in DEFINITIONS]
_TREE = sets._tree_sql("SELECT 's' AS tree, lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS member FROM supplier WHERE s_suppkey % 3 > 0")
_REQ = _turn_sql([r.split(" #")[0] for r in REQUIREMENTS], "n_nationkey")
_JUDGED = f"""{trust._rank_sql(trust._PLAIN)}, wt AS (SELECT key, v AS weight FROM w{trust.ROUNDS} WHERE v <> 0),
pa AS (SELECT p_partkey AS k, {trust._choose(CLAIM_CLASSES, "p_partkey")} AS class, {_turn_sql([*REPRODUCIBILITY, "open"], "p_size")} AS repro, {_turn_sql(["alpha", "beta"], "p_size")} AS owner FROM part),
cl AS (SELECT k, class, repro, CASE WHEN k % 4 = 2 THEN {_turn_sql(list(NATIONS), "k")} ELSE owner END AS author FROM pa),
ju AS (SELECT l_partkey AS k, n_name AS author, l_returnflag AS f, l_suppkey AS s, l_quantity AS q FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
jd AS (SELECT DISTINCT k, author, f FROM ju),
su AS (SELECT k, CAST(coalesce(sum(weight) FILTER (f = 'N'), 0) AS BIGINT) AS affirm, CAST(coalesce(sum(weight) FILTER (f = 'R'), 0) AS BIGINT) AS deny, CAST(coalesce(sum(weight) FILTER (f NOT IN ('N', 'R')), 0) AS BIGINT) AS abstain FROM jd LEFT JOIN wt ON wt.key = author GROUP BY k),
di AS (SELECT a.k // 2 AS k, CAST(sum(weight) AS BIGINT) AS argued FROM cl a JOIN wt ON wt.key = a.author WHERE a.k % 2 = 0 AND a.k % 6 <> 0 GROUP BY 1),
re AS (SELECT ju.k, count(DISTINCT s) FILTER (f = 'N') AS ic, count(DISTINCT s) FILTER (f = 'R') AS ii FROM ju JOIN cl ON cl.k = ju.k WHERE q > 40 AND s % 3 > 0 AND class <> 'formal' GROUP BY 1),
ev AS (SELECT cl.k, cl.class, cl.repro, cl.k % 25 = 0 AND coalesce(b.author = cl.author, FALSE) AS retracted, cl.k % 4 = 1 AND cl.class = 'formal' AS proof, coalesce(affirm, 0) AS affirm, coalesce(deny, 0) AS deny, coalesce(abstain, 0) AS abstain,
  coalesce(argued, 0) AS argued, coalesce(ic, 0) AS ic, coalesce(ii, 0) AS ii FROM cl LEFT JOIN su ON su.k = cl.k LEFT JOIN di ON di.k = cl.k LEFT JOIN re ON re.k = cl.k LEFT JOIN cl b ON b.k = cl.k + 1),
dl AS (SELECT *, CASE WHEN affirm + argued = 0 THEN CAST(0 AS BIGINT) ELSE least(CAST(290000 AS BIGINT), 290000 * argued // (affirm + argued)) END AS delta FROM ev),
st AS (SELECT *, CASE WHEN class IN ('definitional', 'normative', 'expressive', 'performative') THEN 'not-truth-apt' WHEN retracted THEN 'rejected' WHEN class = 'formal' AND proof THEN 'accepted'
  WHEN class = 'empirical' AND ii > 0 THEN 'rejected' WHEN affirm + deny = 0 THEN 'undetermined' WHEN deny * 1000000 // (affirm + deny) >= 660000 + delta THEN 'rejected'
  WHEN affirm * 1000000 // (affirm + deny) >= 660000 + delta THEN CASE WHEN class <> 'empirical' OR CASE repro WHEN 'restricted' THEN FALSE WHEN 'unique-event' THEN ic >= 1 ELSE ic >= 2 END THEN 'accepted' ELSE 'unreplicated' END
  ELSE 'contested' END AS result FROM dl)"""

SQL = {
    "definitions_read": f"SELECT {_cid_sql('p_partkey')} AS cid, {_turn_sql(_SORTS)} AS sort, {_FORM(DEFINITIONS, 1)} AS term, {_FORM(DEFINITIONS, 2)} AS cited, {_FORM(DEFINITIONS, 3)} AS fault FROM part",
    "definitions_undeclared": f"""SELECT cid, split_part(c, '=', 1) AS field, split_part(c, '=', 2) AS cited FROM (SELECT {_cid_sql('p_partkey')} AS cid, p_size, {_FORM(DEFINITIONS, 2)} AS c FROM part) WHERE c <> '' AND p_size % 2 = 0""",
    "calculations_read": f"SELECT {_cid_sql('p_partkey')} AS cid, {_FORM(CALCULATIONS, 1)} AS roles, {_FORM(CALCULATIONS, 2)} AS cited, {_FORM(CALCULATIONS, 3)} AS fault FROM part",
    "views_read": f"""SELECT {_cid_sql('p_partkey')} AS doc, 1 AS pos, CASE CAST(p_partkey % 5 AS INT) WHEN 0 THEN 'table' WHEN 1 THEN p_name WHEN 3 THEN 'r' ELSE '' END AS renderer, {_turn_sql([v[1] for v in VIEWS])} AS options, {_turn_sql([v[2] for v in VIEWS])} AS fault FROM part""",
    "build_cycles": "SELECT CAST(min(c_custkey) AS BIGINT) AS cycle, string_agg(c_custkey, ' -> ' ORDER BY c_custkey) || ' -> ' || min(c_custkey) AS path FROM customer WHERE c_acctbal > 0 GROUP BY c_custkey // 4 HAVING count(*) = 4",
    "requirement_gate": f"""WITH s AS (SELECT n_regionkey || '/' || n_nationkey AS up, n_regionkey AS r, n_nationkey AS n, s_suppkey, {_REQ} AS req, {_turn_sql(list(STATUS), "n_nationkey")} AS st FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT up || '/' || s_suppkey AS dir, CASE WHEN n % 3 > 0 THEN req WHEN r > 0 THEN '^0.2' END AS requirement, CASE WHEN n % 3 = 1 THEN up || '/config' WHEN n % 3 = 2 THEN up || '/file' WHEN r > 0 THEN r || '/file' END AS stated_in,
CASE WHEN n % 3 > 0 THEN st WHEN r > 0 THEN 'met' ELSE 'none' END AS status FROM s""",
    "translation_faults": "SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 THEN 'method required' WHEN o_custkey % 4 = 3 THEN 'unknown method' WHEN o_custkey % 11 = 0 THEN 'fidelity required' WHEN o_orderkey % 5 > 2 THEN 'unknown fidelity' END AS fault FROM orders",
    "edge_notes": f"""WITH {PART_EDGES_SQL}, k AS (SELECT src, dst, {_turn_sql(list(RELATION_CLASSES), "src")} AS kind FROM part_edges)
SELECT src, dst, kind, CASE kind WHEN 'supersedes' THEN src || ' now stands ahead of ' || dst || ' in its lineage' WHEN 'depends' THEN src || ' can''t be judged without ' || dst WHEN 'derived-from' THEN src || ' copies or adapts ' || dst WHEN 'implements' THEN src || ' implements ' || dst ELSE '' END AS note FROM k""",
    "claim_warnings": """SELECT p_partkey AS cid, 'source' AS test, 'data without a source' AS detail FROM part WHERE length(p_type) > 18 AND p_size <= 20
UNION ALL SELECT p_partkey, 'single-assertion', '2 sentences' FROM part WHERE p_size % 3 = 0""",
    "domain_faults": f"""WITH RECURSIVE {PART_EDGES_SQL}, m AS (SELECT p_partkey AS k, p_size AS s FROM part WHERE p_size < 48), r AS (SELECT k FROM m UNION SELECT dst FROM r JOIN part_edges ON src = k),
e AS (SELECT p_partkey AS a, p_partkey + 1 AS b FROM part WHERE p_partkey % 3 = 0)
SELECT 'depends' AS rule, CAST(k AS BIGINT) AS cid, CAST(NULL AS BIGINT) AS amount FROM r WHERE k NOT IN (SELECT k FROM m)
UNION ALL SELECT 'equivalent', b, NULL FROM e WHERE a IN (SELECT k FROM m) AND b NOT IN (SELECT k FROM m) UNION ALL SELECT 'equivalent', a, NULL FROM e WHERE b IN (SELECT k FROM m) AND a NOT IN (SELECT k FROM m)
UNION ALL SELECT 'bound', NULL, CAST(sum(s) AS BIGINT) FROM m HAVING sum(s) > {BOUND}""",
    "filled_commands": "SELECT p_partkey, CASE CAST(p_partkey % 5 AS INT) WHEN 0 THEN 'run ' || p_brand || ' to ' || p_type WHEN 1 THEN p_type || p_type WHEN 2 THEN 'plain' WHEN 4 THEN '{in' END AS command FROM part",
    "prohibitions": f"""SELECT rule, count(*) AS n, CASE rule {" ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in PROHIBITIONS.items())} END AS reason FROM (SELECT {_turn_sql([*PROHIBITIONS, "none"], "c_custkey")} AS rule FROM customer) GROUP BY rule""",
    "bounty_faults": """SELECT o_orderkey AS cid, 'unknown kind' AS rule FROM orders WHERE o_orderkey % 3 > 0 AND o_custkey % 6 = 5 UNION ALL SELECT o_orderkey, 'no policy' FROM orders WHERE o_custkey % 5 = 0 UNION ALL SELECT o_orderkey, 'no target' FROM orders WHERE o_custkey % 4 = 0
UNION ALL SELECT o_orderkey, 'no review share' FROM orders WHERE o_custkey % 6 = 0 UNION ALL SELECT o_orderkey, 'review share too small' FROM orders WHERE o_custkey % 6 > 0 AND o_custkey * 37 % 10001 < 6000""",
    "node_objects": f"""SELECT cid, CASE WHEN bad THEN 'ill-formed' WHEN s_name IS NULL THEN 'unknown' ELSE 'found' END AS status, CASE WHEN NOT bad THEN lower(hex(encode(s_name))) END AS content
FROM (SELECT CASE WHEN c_custkey % 9 = 0 THEN c_name ELSE {_cid_sql('c_custkey')} END AS cid, c_custkey % 9 = 0 AS bad, s_name FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey)""",
    "node_offers": "SELECT CASE WHEN least THEN 'held' ELSE 'accepted' END AS status, count(*) AS n FROM (SELECT p_name, bool_or(p_size < 5) AS least FROM part GROUP BY 1) GROUP BY 1",
    "node_frames": f"SELECT CAST(s_nationkey AS BIGINT) AS domain, {_cid_sql('s_suppkey')} AS cid, lower(lpad(to_hex(strlen(s_name)), 8, '0') || hex(encode(s_name))) AS frame FROM supplier WHERE s_acctbal > 0",
    "node_records": "SELECT domain, idx, n_name AS snapshot, n_name IS NOT NULL AS held FROM (SELECT DISTINCT CAST(c_custkey % 5 AS BIGINT) AS domain, CAST(c_nationkey AS BIGINT) AS idx FROM customer) LEFT JOIN nation ON n_regionkey = domain AND n_nationkey = idx",
    "node_tombstones": """WITH f AS (SELECT o_custkey AS k, arg_min(strftime(o_orderdate, '%Y-%m-%d'), (o_orderpriority, o_orderkey)) AS cause FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT c_custkey AS cid, cause IS NOT NULL AS tombstoned, cause FROM customer LEFT JOIN f ON k = c_custkey""",
    "node_proofs": f"""WITH {_TREE} SELECT member, CASE WHEN member IN (SELECT member FROM mem) THEN 'present' ELSE 'absent' END AS finding, TRUE AS verified, (SELECT root FROM tops) AS root FROM (SELECT DISTINCT lpad(CAST(c_custkey * 2 AS VARCHAR), 9, '0') AS member FROM customer)""",
    "claim_standings": f"WITH {_JUDGED} SELECT row_number() OVER (ORDER BY affirm DESC, 'part-' || k) AS rank, 'part-' || k AS target, class, affirm, deny, abstain, argued, ic AS independent_consistent, ii AS independent_inconsistent, retracted, delta, result FROM st",
}
