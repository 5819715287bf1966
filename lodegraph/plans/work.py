"""Content trees, drafts, imports and rival concepts over the harness tables; standings from annotation rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import ClaimGraph
from ..operators import gather, listing, trees, workspace
from .common import part_edges, table


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The world over regions over nations; nations are leaves."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    none = F.lit(None)
    root = spark.range(1).select(F.lit("world").alias("path"), none.cast("string").alias("parent"), F.lit("world").alias("name"), none.cast("binary").alias("content"), F.lit("v1").cast("binary").alias("header"))
    regions = r.select(F.concat(F.lit("world/"), "r_name").alias("path"), F.lit("world").alias("parent"), F.col("r_name").alias("name"), none.cast("binary").alias("content"), F.lit("").cast("binary").alias("header"))
    nations = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.concat_ws("/", F.lit("world"), "r_name", "n_name").alias("path"), F.concat(F.lit("world/"), "r_name").alias("parent"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("string").cast("binary").alias("content"), none.cast("binary").alias("header"))
    return root.union(regions).union(nations)


def content_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.hashes(_tree(spark, sf_dir))


def draft_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    drafts = p.filter("p_size % 3 > 0").select(F.col("p_partkey").alias("slug"), F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise(F.col("p_name")).alias("cid"))
    return workspace.draft_report(drafts, p.filter("p_size % 4 > 0").select(F.col("p_partkey").alias("slug"), F.col("p_brand").alias("cid")))


def import_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's slug asked for, against the customers outside one segment; those in debt are newer than the pin."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("alias"), F.col("user_id").alias("slug")).distinct()
    held = table(spark, sf_dir, "customer").filter("c_mktsegment <> 'BUILDING'")
    c = held.select(F.element_at(F.array(*[F.lit(x) for x in ("view", "signup", "purchase", "error", "click")]), (F.col("c_custkey") % 5 + 1).cast("int")).alias("alias"), F.expr("c_custkey div 5").alias("slug"), F.col("c_custkey").alias("cid"), "c_acctbal")
    return workspace.resolved(e, c.drop("c_acctbal"), c.filter("c_acctbal >= 0").select("alias", "cid"))


def rival_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    concepts = p.select(F.col("p_partkey").alias("cid"), F.concat_ws("/", "p_brand", "p_size").alias("code"))
    geneses = p.select(F.col("p_partkey").alias("node"), F.expr("p_partkey % 500").alias("genesis"))
    return workspace.competing(concepts, geneses).select("code", F.array_join(F.transform("rivals", lambda x: x.cast("string")), ",").alias("rivals"))


def needed_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("cid"), "p_size")
    refs = part_edges(spark, sf_dir).select(F.col("src").alias("source"), F.col("dst").alias("target"))
    attached = p.filter("cid % 10 = 3").select((F.col("cid") - 3).alias("target"), "cid")
    return workspace.needed(p.filter("p_size = 7"), p.filter("p_size <> 9"), refs, attached)


def pin_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    pins = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("alias"), F.expr("c_custkey % 25").alias("generation"))
    heads = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("alias")).agg(F.count(F.lit(1)).alias("head"))
    return workspace.pin_status(pins, heads)


def map_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("cid"), F.col("l_suppkey").alias("corpus"), F.expr("l_suppkey % 7").alias("generality"))
    return listing.map_nodes(d)


def annotation_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges read from annotation payloads: the first of each pair counts, weight one by default."""
    e = table(spark, sf_dir, "events")
    payload = F.when(F.expr("event_id % 3 = 0"), F.lit('{"subjects":["a","b"]}')).otherwise(F.concat(F.lit('{"weight":'), F.expr("event_id % 11").cast("string"), F.lit("}")))
    notes = e.select(F.lpad(F.col("event_id").cast("string"), 12, "0").alias("cid"), F.col("user_id").cast("string").alias("author"), F.when(F.col("event_type") == "error", "verdict").otherwise("trusts").alias("kind"), F.expr("event_id % 53").cast("string").alias("target"), F.lit(None).cast("string").alias("aspect"), payload.alias("value"))
    return gather.trust_edges(ClaimGraph(spark, annotations=notes)).select("src", "dst", F.col("weight").cast("bigint").alias("weight"), F.size("subjects").alias("subjects"))


QUERIES = {f.__name__: f for f in (content_tree, draft_report, import_resolution, rival_concepts, needed_objects, pin_status, map_nodes, annotation_trust)}


# The same in SQL.


def _size8(text: str) -> str:
    """Eight bytes of a length, the lowest first; lengths here fit one byte."""
    return f"lpad(to_hex(strlen({text})), 2, '0') || '00000000000000'"


_ENTRY = f"string_agg({_size8('name')} || hex(encode(name)) || upper(h), '' ORDER BY name)"
SQL = {
    "content_tree": f"""WITH n AS (SELECT 'world/' || r_name || '/' || n_name AS path, 'world/' || r_name AS parent, n_name AS name, sha256(unhex('00') || encode(CAST(n_nationkey AS VARCHAR))) AS h FROM nation JOIN region ON r_regionkey = n_regionkey),
r AS (SELECT 'world/' || r_name AS path, r_name AS name, sha256(unhex('0002' || '0000000000000000' || coalesce((SELECT {_ENTRY} FROM n WHERE n.parent = 'world/' || r_name), ''))) AS h FROM region),
w AS (SELECT 'world' AS path, sha256(unhex('0002' || '0200000000000000' || hex(encode('v1')) || (SELECT {_ENTRY} FROM r))) AS h) SELECT path, h AS hash FROM n UNION ALL SELECT path, h FROM r UNION ALL SELECT path, h FROM w""",
    "draft_report": """WITH d AS (SELECT p_partkey AS slug, CASE WHEN p_size > 25 THEN p_brand ELSE p_name END AS draft FROM part WHERE p_size % 3 > 0), p AS (SELECT p_partkey AS slug, p_brand AS published FROM part WHERE p_size % 4 > 0)
SELECT coalesce(d.slug, p.slug) AS slug, CASE WHEN published IS NULL THEN 'new' WHEN draft IS NULL THEN 'withdrawn' WHEN draft = published THEN 'unchanged' ELSE 'changed' END AS change, draft, published FROM d FULL JOIN p ON p.slug = d.slug""",
    "import_resolution": """WITH e AS (SELECT DISTINCT event_type AS alias, user_id AS slug FROM events), c AS (SELECT (['view', 'signup', 'purchase', 'error', 'click'])[CAST(c_custkey % 5 AS INT) + 1] AS alias, c_custkey // 5 AS slug, c_custkey AS cid, c_acctbal FROM customer WHERE c_mktsegment <> 'BUILDING')
SELECT e.alias, e.slug, c.cid, CASE WHEN c.cid IS NULL THEN 'unknown' WHEN c_acctbal < 0 THEN 'newer than the pin' END AS fault FROM e LEFT JOIN c ON c.alias = e.alias AND c.slug = e.slug""",
    "rival_concepts": "WITH g AS (SELECT DISTINCT p_brand || '/' || p_size AS code, p_partkey % 500 AS genesis FROM part) SELECT code, string_agg(genesis, ',' ORDER BY genesis) AS rivals FROM g GROUP BY code HAVING count(*) > 1",
    "needed_objects": """WITH RECURSIVE part_edges AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 0 UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey > 0), steps AS (SELECT * FROM part_edges UNION SELECT p_partkey - 3, p_partkey FROM part WHERE p_partkey % 10 = 3),
r AS (SELECT p_partkey AS n FROM part WHERE p_size = 7 UNION SELECT dst FROM r JOIN steps ON src = n) SELECT n AS cid FROM r WHERE n NOT IN (SELECT p_partkey FROM part WHERE p_size = 7) AND n IN (SELECT p_partkey FROM part WHERE p_size <> 9)""",
    "pin_status": "SELECT c_custkey AS alias, c_custkey % 25 AS generation, n AS head, coalesce(n > c_custkey % 25, FALSE) AS newer FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey",
    "map_nodes": "SELECT cid, corpus FROM (SELECT l_partkey AS cid, l_suppkey AS corpus, row_number() OVER (PARTITION BY l_partkey ORDER BY l_suppkey % 7, l_suppkey) AS n FROM lineitem) WHERE n = 1",
    "annotation_trust": """SELECT CAST(user_id AS VARCHAR) AS src, CAST(event_id % 53 AS VARCHAR) AS dst, CAST(CASE WHEN event_id % 3 = 0 THEN 1 ELSE event_id % 11 END * 1000000 AS BIGINT) AS weight, CAST(CASE WHEN event_id % 3 = 0 THEN 2 ELSE 0 END AS INTEGER) AS subjects
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_id % 53 ORDER BY event_id) AS n FROM events WHERE event_type <> 'error') WHERE n = 1""",
}
