"""Walks, versions, definitions and citations over graphs derived from parts, conversations, orders and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import definitions, fixpoint, lineage, listing
from .common import PART_EDGES_SQL, part_edges, table, turn_edges, turn_edges_sql


def depends_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("start"))
    return fixpoint.closure(starts, part_edges(spark, sf_dir)).select("start", "node", "depth", "cyclic")


def bounded_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("start"))
    return fixpoint.reach(starts, part_edges(spark, sf_dir), 3)


def reaches_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("start"), F.expr("p_partkey % 40").alias("target"))
    return fixpoint.reaches(pairs, part_edges(spark, sf_dir))


def topological_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))
    return fixpoint.levels(nodes, part_edges(spark, sf_dir))


def acyclic_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    deals = table(spark, sf_dir, "part").filter("p_partkey > 0").select(F.col("p_partkey").alias("src"), F.expr("CASE WHEN p_partkey % 100 = 7 THEN p_partkey + 1 ELSE p_partkey - 1 END").alias("dst"))
    return fixpoint.acyclic(deals)


def closes_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("src"))
    pairs = p.select("src", F.explode(F.array(F.col("src"), F.col("src") * 2, F.col("src") + 1)).alias("dst")).distinct()
    return fixpoint.closes_cycle(pairs, part_edges(spark, sf_dir))


def part_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    up = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.when(F.expr("p_partkey > 0 AND p_partkey % 2 = 0"), F.expr("p_partkey div 2")).alias("parent"))
    return fixpoint.roots(up).select("node", "root", "steps")


def equivalence_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node"), "text", F.lower(F.substring_index("text", "\n", 1)).alias("line"))
    star = lambda c: d.join(d.groupBy(c).agg(F.min("node").alias("hub")), c).filter("node <> hub").select(F.col("hub").alias("src"), F.col("node").alias("dst"))
    return fixpoint.components(d, star("text").union(star("line")))


def lineage_genesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.geneses(*turn_edges(spark, sf_dir))


def lineage_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.members(*turn_edges(spark, sf_dir))


def lineage_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.heads(*turn_edges(spark, sf_dir))


def lineage_heads_authoritative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.heads(*turn_edges(spark, sf_dir, same_role=True))


def lineage_branched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.branched(lineage_heads(spark, sf_dir))


def agreed_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lineage_heads(spark, sf_dir)
    c = table(spark, sf_dir, "conversations").filter("turn IN (1, 2) AND conv_id % 3 > 0")
    anchors = c.select((F.col("conv_id") * 100).alias("lineage"), F.expr("conv_id * 100 + CASE WHEN conv_id % 3 = 1 THEN 1 ELSE turn END").alias("current"))
    return lineage.agreed_heads(found, anchors)


def authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, sup = turn_edges(spark, sf_dir)
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("cid"), "role")
    authors = c.select("cid", F.col("role").alias("author"))
    relations = sup.join(authors.select(F.col("cid").alias("src"), "author"), "src").withColumn("kind", F.when(F.col("src") % 2 == 0, "supersedes").otherwise("depends"))
    delegations = spark.createDataFrame([("user", "assistant")], "from string, to string")
    return lineage.authority(relations, authors, delegations).select("src", "dst", "kind", "author", "authoritative")


def retracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    authors = o.select(F.col("o_orderkey").alias("cid"), F.expr("o_custkey % 7").alias("author"))
    relations = o.filter("o_orderkey > 0").select(F.col("o_orderkey").alias("src"), (F.col("o_orderkey") - 1).alias("dst"), F.when(F.col("o_orderstatus") == "F", "retracts").otherwise("supports").alias("kind"))
    return lineage.retracted(relations, authors)


def staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, sup = turn_edges(spark, sf_dir)
    members, heads = lineage.members(nodes, sup), lineage.heads(nodes, sup)
    depends = nodes.select(F.col("node").alias("cid"), (F.col("node") - 100).alias("dep"))
    disputes = nodes.filter("node % 5 = 0").select(F.col("node").alias("src"), (F.col("node") + 100).alias("dst"))
    resolutions = nodes.filter("node % 4 = 0").select(F.col("node").alias("target"), (-F.col("node")).alias("cid"))
    return lineage.stale(sup, depends, members, heads, disputes, resolutions)


def key_rotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").filter("c_custkey % 70 > 0").select((F.col("c_custkey") - 1).alias("old"), F.col("c_custkey").alias("new"))
    return lineage.continued_keys(c)


def _senses(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    depends = part_edges(spark, sf_dir).select(F.col("src").alias("cid"), F.col("dst").alias("dep"))
    return definitions.rested_on(p.select(F.col("p_partkey").alias("cid")), depends, p.select(F.col("p_partkey").alias("cid"), F.col("p_type").alias("term")))


def term_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _senses(spark, sf_dir)


def divergence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))
    pairs = p.select(F.col("node").alias("left"), (F.col("node") + 1).alias("right"))
    sup = p.filter("node > 0 AND node % 2 = 0").select(F.col("node").alias("src"), F.expr("node div 2").alias("dst"))
    equal = p.select("node", F.expr("node % 11").alias("component"))
    return definitions.divergent(_senses(spark, sf_dir), pairs, lineage.geneses(p, sup), equal)


def term_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("claim"), F.col("l_partkey").alias("p_partkey"))
    senses = line.join(table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("term"), F.col("p_brand").alias("definition")), "p_partkey").select("claim", "term", "definition")
    return definitions.partition(senses)


def contested_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("cid"), F.lower("p_name").alias("term"))
    disputes = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' AND l_quantity >= 49").select(F.col("l_partkey").alias("dst"))
    return definitions.contested_terms(terms, disputes)


def undeclared_forks(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("ref")).distinct()
    derived = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("src"), (F.col("o_orderkey") + 1).alias("dst"))
    return definitions.undeclared_forks(items, 40, derived)


def citation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("ref"), F.when(F.col("l_returnflag") == "N", "object").otherwise("lineage").alias("bind"),
        F.when(F.col("l_linenumber") > 1, F.expr("CASE WHEN l_linenumber = 2 THEN -1 ELSE l_partkey * 2 % 1999 END")).cast("bigint").alias("at"),
    )
    objects = table(spark, sf_dir, "part").filter("p_size <= 45").select(F.col("p_partkey").alias("cid"), F.when(F.col("p_size") > 40, "doc").otherwise("claim").alias("kind"))
    heads = objects.select("cid", F.explode(F.expr("CASE WHEN cid % 10 = 0 THEN array(cid, cid * 2 % 1999) ELSE array(cid * 2 % 1999) END")).alias("head"))
    return listing.citation_check(items, objects, heads).groupBy("ref", "bind", "status").agg(F.count(F.lit(1)).alias("n"))


def reverse_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")
    return listing.cited({
        "part": line.select(F.concat(F.lit("part:"), F.col("l_partkey")).alias("target"), F.col("l_orderkey").alias("source")),
        "supplier": line.select(F.concat(F.lit("supplier:"), F.col("l_suppkey")).alias("target"), F.col("l_orderkey").alias("source")),
        "customer": orders.select(F.concat(F.lit("customer:"), F.col("o_custkey")).alias("target"), F.col("o_orderkey").alias("source")),
    }).groupBy("target", "how").agg(F.count(F.lit(1)).alias("sources"))


QUERIES = {f.__name__: f for f in (depends_closure, bounded_reach, reaches_target, topological_levels, acyclic_check, closes_cycle, part_roots, equivalence_components, lineage_genesis, lineage_members, lineage_heads, lineage_heads_authoritative, lineage_branched, agreed_heads, authority, retracted, staleness, key_rotations, term_definitions, divergence_pairs, term_partition, contested_terms, undeclared_forks, citation_check, reverse_citations)}


# The same in SQL.

_WALK = "walk AS (SELECT p_partkey AS start, p_partkey AS node, 0 AS depth FROM part UNION SELECT start, dst, depth + 1 FROM walk JOIN part_edges ON src = node)"
_NEAR = "near AS (SELECT start, node, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY 1, 2)"
_TURNS, _SAME = turn_edges_sql(), turn_edges_sql(True)
_LINE = (
    "up AS (SELECT node, node AS top, 0 AS d FROM nodes UNION ALL SELECT up.node, sup.dst, d + 1 FROM up JOIN sup ON sup.src = up.top), "
    "gen AS (SELECT node, arg_max(top, d) AS genesis FROM up GROUP BY node), "
    "mem AS (SELECT genesis, genesis AS member, 0 AS depth FROM (SELECT DISTINCT genesis FROM gen) UNION ALL SELECT genesis, sup.src, depth + 1 FROM mem JOIN sup ON sup.dst = mem.member), "
    "hd AS (SELECT genesis, member AS head FROM mem WHERE member NOT IN (SELECT dst FROM sup))"
)
_SENSES = f"{PART_EDGES_SQL}, {_WALK}, {_NEAR}, senses AS (SELECT start AS claim, p_type AS term, arg_max(node, depth * 1000000 + node) AS definition FROM near JOIN part ON p_partkey = node WHERE depth > 0 GROUP BY 1, 2)"

SQL = {
    "depends_closure": f"WITH RECURSIVE {PART_EDGES_SQL}, {_WALK}, {_NEAR} SELECT start, node, depth, FALSE AS cyclic FROM near WHERE depth > 0",
    "bounded_reach": f"WITH RECURSIVE {PART_EDGES_SQL}, {_WALK}, {_NEAR} SELECT start, node, depth FROM near WHERE depth <= 3",
    "reaches_target": f"WITH RECURSIVE {PART_EDGES_SQL}, {_WALK}, {_NEAR} SELECT p_partkey AS start, p_partkey % 40 AS target, near.node IS NOT NULL AS reached FROM part LEFT JOIN near ON near.start = p_partkey AND near.node = p_partkey % 40",
    "topological_levels": f"WITH RECURSIVE {PART_EDGES_SQL}, {_WALK} SELECT start AS node, CAST(max(depth) AS INTEGER) AS level FROM walk GROUP BY start",
    "acyclic_check": """WITH e AS (SELECT p_partkey AS src, CASE WHEN p_partkey % 100 = 7 THEN p_partkey + 1 ELSE p_partkey - 1 END AS dst FROM part WHERE p_partkey > 0),
n AS (SELECT src AS node FROM e UNION SELECT dst FROM e) SELECT (SELECT count(*) FROM e) AS edges, count(*) FILTER (node >= 7) AS on_or_above_cycle, count(*) FILTER (node >= 7) = 0 AS acyclic FROM n""",
    "closes_cycle": f"""WITH RECURSIVE {PART_EDGES_SQL}, {_WALK}, p AS (SELECT p_partkey AS src, p_partkey AS dst FROM part UNION SELECT p_partkey, p_partkey * 2 FROM part UNION SELECT p_partkey, p_partkey + 1 FROM part)
SELECT src, dst, dst = src OR EXISTS (SELECT 1 FROM walk WHERE walk.start = p.dst AND walk.node = p.src) AS closes FROM p""",
    "part_roots": "WITH RECURSIVE r AS (SELECT p_partkey AS node, p_partkey AS root, CAST(0 AS BIGINT) AS steps FROM part UNION ALL SELECT node, root // 2, steps + 1 FROM r WHERE root > 0 AND root % 2 = 0) SELECT node, arg_max(root, steps) AS root, max(steps) AS steps FROM r GROUP BY node",
    "equivalence_components": """WITH RECURSIVE d AS (SELECT doc_id, text, lower(split_part(text, chr(10), 1)) AS line FROM documents),
l AS (SELECT doc_id AS a, min(doc_id) OVER (PARTITION BY text) AS b FROM d UNION SELECT doc_id, min(doc_id) OVER (PARTITION BY line) FROM d),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT x, e.b FROM r JOIN e ON e.a = r.y)
SELECT x AS node, min(y) AS component FROM r GROUP BY x""",
    "lineage_genesis": f"WITH RECURSIVE {_TURNS}, {_LINE} SELECT node, genesis FROM gen",
    "lineage_members": f"WITH RECURSIVE {_TURNS}, {_LINE} SELECT genesis, member, CAST(depth AS INTEGER) AS depth FROM mem",
    "lineage_heads": f"WITH RECURSIVE {_TURNS}, {_LINE} SELECT genesis, head FROM hd",
    "lineage_heads_authoritative": f"WITH RECURSIVE {_SAME}, {_LINE} SELECT genesis, head FROM hd",
    "lineage_branched": f"WITH RECURSIVE {_TURNS}, {_LINE} SELECT genesis, count(*) AS heads, count(*) > 1 AS branched FROM hd GROUP BY genesis",
    "agreed_heads": f"""WITH RECURSIVE {_TURNS}, {_LINE}, an AS (SELECT conv_id * 100 AS genesis, conv_id * 100 + CASE WHEN conv_id % 3 = 1 THEN 1 ELSE turn END AS cur FROM conversations WHERE turn IN (1, 2) AND conv_id % 3 > 0),
ok AS (SELECT genesis, max(cur) AS head FROM an GROUP BY genesis HAVING count(DISTINCT cur) = 1) SELECT genesis, head FROM ok UNION ALL SELECT genesis, head FROM hd WHERE genesis NOT IN (SELECT genesis FROM ok)""",
    "authority": f"""WITH {_TURNS} SELECT src, dst, CASE WHEN src % 2 = 0 THEN 'supersedes' ELSE 'depends' END AS kind, a.role AS author,
a.role = b.role OR (src % 2 = 0 AND b.role = 'user' AND a.role = 'assistant') AS authoritative FROM sup JOIN nodes a ON a.node = src JOIN nodes b ON b.node = dst""",
    "retracted": "SELECT DISTINCT b.o_orderkey AS cid FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey - 1 WHERE a.o_orderstatus = 'F' AND a.o_custkey % 7 = b.o_custkey % 7",
    "staleness": f"""WITH RECURSIVE {_TURNS}, {_LINE}
SELECT sup.src AS cid, 'target has another head' AS test, hd.head AS other FROM sup JOIN mem ON mem.member = sup.dst JOIN hd ON hd.genesis = mem.genesis WHERE hd.head <> sup.src
UNION SELECT node, 'dependency superseded', hd.head FROM nodes JOIN mem ON mem.member = node - 100 JOIN hd ON hd.genesis = mem.genesis WHERE hd.head <> node - 100
UNION SELECT a.node, 'dispute resolved', -b.node FROM nodes a JOIN nodes b ON b.node = a.node + 100 WHERE a.node % 5 = 0 AND b.node % 4 = 0""",
    "key_rotations": """WITH RECURSIVE e AS (SELECT c_custkey - 1 AS o, c_custkey AS n FROM customer WHERE c_custkey % 70 > 0),
r AS (SELECT DISTINCT o AS start, o AS node, 0 AS depth FROM e UNION ALL SELECT start, e.n, depth + 1 FROM r JOIN e ON e.o = r.node WHERE depth < 64) SELECT start, node, CAST(depth AS INTEGER) AS depth FROM r""",
    "term_definitions": f"WITH RECURSIVE {_SENSES} SELECT claim, term, definition FROM senses",
    "divergence_pairs": f"""WITH RECURSIVE {_SENSES}, r AS (SELECT p_partkey AS node, p_partkey AS g, 0 AS d FROM part UNION ALL SELECT node, g // 2, d + 1 FROM r WHERE g > 0 AND g % 2 = 0), gen AS (SELECT node, arg_max(g, d) AS g FROM r GROUP BY node)
SELECT a.claim AS "left", b.claim AS "right", a.term, a.definition AS left_def, b.definition AS right_def, CASE WHEN x.g = y.g THEN 'stale' ELSE 'divergent' END AS kind
FROM senses a JOIN senses b ON b.claim = a.claim + 1 AND b.term = a.term JOIN gen x ON x.node = a.definition JOIN gen y ON y.node = b.definition WHERE a.definition <> b.definition AND a.definition % 11 <> b.definition % 11""",
    "term_partition": """WITH g AS (SELECT p_type AS term, p_brand AS definition, count(DISTINCT l_orderkey) AS claims FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)
SELECT term, CAST(row_number() OVER (PARTITION BY term ORDER BY claims DESC, definition) AS INTEGER) AS place, definition, claims FROM (SELECT *, count(*) OVER (PARTITION BY term) AS n FROM g) WHERE n >= 2""",
    "contested_terms": "SELECT p_partkey AS cid, lower(p_name) AS term, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 49) AS contested FROM part",
    "undeclared_forks": """WITH i AS (SELECT DISTINCT l_orderkey AS doc, l_partkey AS ref FROM lineitem), s AS (SELECT doc, count(*) AS n FROM i GROUP BY doc), k AS (SELECT i.* FROM i JOIN s ON s.doc = i.doc),
p AS (SELECT x.doc AS a, y.doc AS b, count(*) AS shared FROM k x JOIN k y ON y.ref = x.ref AND x.doc < y.doc GROUP BY 1, 2)
SELECT a, b, shared, least(sa.n, sb.n) AS least, shared * 100 // least(sa.n, sb.n) AS percent FROM p JOIN s sa ON sa.doc = a JOIN s sb ON sb.doc = b WHERE shared * 100 // least(sa.n, sb.n) >= 40 AND b - a <> 1""",
    "citation_check": """WITH i AS (SELECT l_partkey AS ref, CASE WHEN l_returnflag = 'N' THEN 'object' ELSE 'lineage' END AS bind, CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber = 2 THEN -1 ELSE l_partkey * 2 % 1999 END AS ver FROM lineitem),
o AS (SELECT p_partkey AS cid, p_size <= 40 AS claim FROM part WHERE p_size <= 45),
h AS (SELECT cid, CASE WHEN cid % 10 = 0 THEN 2 ELSE 1 END AS n, CASE WHEN cid % 10 = 0 THEN least(cid, cid * 2 % 1999) ELSE cid * 2 % 1999 END AS head FROM o)
SELECT ref, bind, CASE WHEN o.cid IS NULL THEN 'missing' WHEN NOT o.claim THEN 'not-a-claim' WHEN bind = 'object' THEN 'ok' WHEN ver IS NULL THEN 'no-at' WHEN v.cid IS NULL THEN 'unreachable-at' WHEN h.n > 1 OR h.head <> ver THEN 'diverged' ELSE 'ok' END AS status, count(*) AS n
FROM i LEFT JOIN o ON o.cid = ref LEFT JOIN o v ON v.cid = ver LEFT JOIN h ON h.cid = ref GROUP BY 1, 2, 3""",
    "reverse_citations": """SELECT 'part:' || l_partkey AS target, 'part' AS how, count(DISTINCT l_orderkey) AS sources FROM lineitem GROUP BY 1 UNION ALL SELECT 'supplier:' || l_suppkey, 'supplier', count(DISTINCT l_orderkey) FROM lineitem GROUP BY 1
UNION ALL SELECT 'customer:' || o_custkey, 'customer', count(DISTINCT o_orderkey) FROM orders GROUP BY 1""",
}
