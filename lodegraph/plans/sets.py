"""Merkle trees, generations, checkpoints, witnesses and set algebra over the harness tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import domains, listing, merkle
from .common import table


def _leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tree, member): names of nations and regions, and the benchmark's texts."""
    n = table(spark, sf_dir, "nation").select(F.lit("nation").alias("tree"), F.col("n_name").alias("member"))
    r = table(spark, sf_dir, "region").select(F.lit("region").alias("tree"), F.col("r_name").alias("member"))
    b = table(spark, sf_dir, "benchmark").select(F.lit("benchmark").alias("tree"), F.col("text").alias("member"))
    return n.union(r).union(b)


def merkle_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tops(merkle.levels(merkle.ordered(_leaves(spark, sf_dir), ["tree"]), ["tree"]), ["tree"])


def membership_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("tree"), F.col("c_name").alias("member"))
    return merkle.tops(merkle.levels(merkle.ordered(members, ["tree"]), ["tree"]), ["tree"])


def inclusion_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = merkle.ordered(_leaves(spark, sf_dir), ["tree"])
    paths = merkle.inclusion(merkle.levels(leaves, ["tree"]), ["tree"])
    return paths.select("tree", "pos", F.array_join("path", ",").alias("path"))


def inclusion_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every path against its root, and against the root of another tree."""
    leaves = merkle.ordered(_leaves(spark, sf_dir), ["tree"])
    found = merkle.levels(leaves, ["tree"])
    tops = merkle.tops(found, ["tree"])
    other = F.sha2(F.col("root").cast("binary"), 256)
    joined = merkle.inclusion(found, ["tree"]).join(leaves, ["tree", "pos"]).join(tops, "tree")
    check = lambda root: merkle.verify_inclusion(F.col("leaf"), F.col("pos"), F.col("size"), F.col("path"), root)
    return joined.select("tree", "pos", check(F.col("root")).alias("verified"), check(other).alias("forged"))


def membership_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "orders").filter("o_orderkey % 3 > 0").select(F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("member"))
    asked = table(spark, sf_dir, "part").select(F.lpad((F.col("p_partkey") * 7 % 16000).cast("string"), 12, "0").alias("member"))
    return merkle.neighbours(members, asked)


def _generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.expr("user_id % 5").alias("domain"), F.expr("event_id div 1000").alias("idx"), F.col("user_id").cast("string").alias("cid"), (F.col("event_type") == "error").alias("gone"))


def generation_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _generations(spark, sf_dir)
    start = table(spark, sf_dir, "customer").select(F.expr("c_custkey % 5").cast("bigint").alias("domain"), F.col("c_custkey").cast("string").alias("cid"))
    return domains.applied(start, g.filter("NOT gone"), g.filter("gone"))


def generation_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = generation_apply(spark, sf_dir)
    snaps = members.select("domain").distinct().withColumn("snapshot", F.lit(merkle.EMPTY_ROOT))
    return domains.snapshot_check(members, snaps)


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("value > 3")
    return e.select(F.expr("user_id % 10").alias("domain"), F.expr("event_id div 5").alias("idx")).distinct().withColumn("parent", F.when(F.expr("idx % 9 > 0"), (F.col("idx") - 1).cast("string")))


def generation_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domains.gaps(_numbered(spark, sf_dir)).select("domain", "idx", "expected", "gap")


def generation_follows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domains.follows(_numbered(spark, sf_dir))


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders")
    return o.filter("o_orderdate < '1998-01-01'").select(F.col("o_custkey").alias("cid")), o.filter("o_orderdate >= '1998-01-01'").select(F.col("o_custkey").alias("cid"))


def membership_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _halves(spark, sf_dir)
    return merkle.diff(a.withColumnRenamed("cid", "member"), b.withColumnRenamed("cid", "member"))


def misdeclared(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _halves(spark, sf_dir)
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cid"))
    return domains.misdeclared(a, b, c.filter("cid % 10 = 0"), c.filter("cid % 10 > 4"))


def corpus_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domains.growth(*_halves(spark, sf_dir))


def added_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domains.added_between(_generations(spark, sf_dir).filter("NOT gone").distinct(), 2, 5)


def head_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domains.head_generation(_generations(spark, sf_dir))


def split_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    seen = e.select(F.expr("event_id % 7").alias("observer"), F.col("user_id").alias("domain"), F.to_date("ts").cast("string").alias("generation"), F.floor(F.col("value") / 20).cast("bigint").alias("log_root"))
    return domains.split_views(seen).select("domain", "generation", F.array_join(F.transform("roots", lambda x: x.cast("string")), ",").alias("roots"))


def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("domain")).agg(F.count(F.lit(1)).alias("head"))
    return heads.select("domain", "head", F.array_join(F.transform(domains.checkpoints(F.col("head")), lambda x: x.cast("string")), ",").alias("kept"))


def fetches_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", domains.fetches(F.col("o_custkey"), F.col("o_custkey") + F.col("o_orderkey")).alias("fetches"))


def gc_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cid"))
    declared = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cid"))
    manifests = table(spark, sf_dir, "part").filter("p_partkey % 10 = 0").select(F.col("p_partkey").alias("cid"))
    return domains.garbage(objects, declared, manifests)


def removable(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("cid"))
    lab = table(spark, sf_dir, "labels")
    return domains.removable(asked, lab.select(F.col("doc_id").alias("cid")), lab.filter("toxic = 1").select(F.col("doc_id").alias("cid")))


def untimestamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("cid"))
    stamps = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("cid"))
    notes = docs.filter("cid % 13 = 0").select("cid", (F.col("cid") + 1).alias("target"))
    return domains.untimestamped(docs, stamps, notes)


def missing_depends(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import part_edges

    members = table(spark, sf_dir, "part").filter("p_size % 4 = 1").select(F.col("p_partkey").alias("cid"))
    return domains.missing_depends(members, part_edges(spark, sf_dir).select(F.col("src").alias("cid"), F.col("dst").alias("dep")))


def missing_equivalents(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    links = p.filter("p_partkey % 20 > 3").select(F.col("p_partkey").alias("src"), (F.col("p_partkey") - 1).alias("dst"))
    return domains.missing_equivalents(p.filter("p_partkey % 60 = 9").select(F.col("p_partkey").alias("cid")), links)


def personhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    proofs = e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("subject"), F.col("event_type").alias("scheme"), F.expr("event_id % 3").alias("scope"), F.col("props").alias("nullifier"))
    return domains.personhood(proofs).select("seq", "subject", "accepted")


def scheme_minimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("value > 40")
    return domains.scheme_minimum(e.select(F.col("user_id").alias("subject"), F.col("event_type").alias("scheme")), 3)


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    slug = lambda df, key: df.select(F.expr(f"{key} % 500").alias("slug"), F.col(key).cast("bigint").alias("cid"))
    return listing.names(slug(table(spark, sf_dir, "supplier"), "s_suppkey"), slug(table(spark, sf_dir, "nation"), "n_nationkey"), slug(table(spark, sf_dir, "part"), "p_partkey"))


def objects_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose bytes no longer hash to the digest on record; every 17th record is off by one."""
    d = table(spark, sf_dir, "documents")
    stored = F.sha2(F.concat("text", F.when(F.expr("doc_id % 17 = 0"), F.lit("x")).otherwise(F.lit(""))).cast("binary"), 256)
    return d.withColumn("stored", stored).filter(F.sha2(F.col("text").cast("binary"), 256) != F.col("stored")).select("doc_id", "stored", F.octet_length("text").cast("bigint").alias("size"))


QUERIES = {f.__name__: f for f in (merkle_root, membership_root, inclusion_path, inclusion_verified, membership_neighbours, generation_apply, generation_roots, generation_gaps, generation_follows, membership_diff, misdeclared, corpus_growth, added_between, head_generation, split_views, checkpoints, fetches_required, gc_candidates, removable, untimestamped, missing_depends, missing_equivalents, personhood, scheme_minimum, names, objects_scan)}


# The same in SQL: Merkle levels are unrolled up to trees of 2^HEIGHT leaves.

HEIGHT = 12
_LEAVES = "SELECT 'nation' AS tree, n_name AS member FROM nation UNION SELECT 'region', r_name FROM region UNION SELECT 'benchmark', text FROM benchmark"
_SEGMENTS = "SELECT DISTINCT c_mktsegment AS tree, c_name AS member FROM customer"


def _tree_sql(members: str) -> str:
    """l0 .. lHEIGHT(tree, pos, h), all(tree, level, pos, h), tops(tree, root, size)."""
    out = [f"mem AS ({members})", "l0 AS MATERIALIZED (SELECT tree, row_number() OVER (PARTITION BY tree ORDER BY member) - 1 AS pos, member, sha256(unhex('00') || encode(member)) AS h FROM mem)"]
    for i in range(1, HEIGHT + 1):
        out.append(
            f"l{i} AS MATERIALIZED (SELECT tree, pos // 2 AS pos, CASE WHEN count(*) = 1 THEN min(h) ELSE sha256(unhex('01') || unhex(max(h) FILTER (pos % 2 = 0)) || unhex(max(h) FILTER (pos % 2 = 1))) END AS h FROM l{i - 1} "
            f"WHERE tree IN (SELECT tree FROM l{i - 1} WHERE pos > 0) GROUP BY tree, pos // 2)"
        )
    every = " UNION ALL ".join(f"SELECT tree, {i} AS level, pos, h FROM l{i}" for i in range(HEIGHT + 1))
    return ", ".join([*out, f"every AS MATERIALIZED ({every})", "tops AS (SELECT tree, arg_max(h, level) AS root, count(*) FILTER (level = 0) AS size FROM every GROUP BY tree)"])


_PATHS = "st AS (SELECT l0.tree, l0.pos, k AS level, xor(l0.pos >> k, 1) AS sib FROM l0, range(0, 12) AS r(k)), pa AS (SELECT st.tree, st.pos, string_agg(every.h, ',' ORDER BY st.level) AS path FROM st JOIN every ON every.tree = st.tree AND every.level = st.level AND every.pos = st.sib GROUP BY 1, 2)"
_GEN = "g AS (SELECT user_id % 5 AS domain, event_id // 1000 AS idx, CAST(user_id AS VARCHAR) AS cid, event_type = 'error' AS gone FROM events)"
_APPLIED = f"{_GEN}, acts AS (SELECT CAST(c_custkey % 5 AS BIGINT) AS domain, CAST(c_custkey AS VARCHAR) AS cid, -1 AS idx, 0 AS gone FROM customer UNION ALL SELECT domain, cid, idx, CAST(gone AS INT) FROM g), applied AS (SELECT domain, cid FROM acts GROUP BY 1, 2 HAVING max(idx * 2 + gone) % 2 = 0)"
_APPLIED = _APPLIED.replace("max(idx * 2 + gone) % 2 = 0", "(max(idx * 2 + gone) + 2) % 2 = 0")
_NUM = "n AS (SELECT DISTINCT user_id % 10 AS domain, event_id // 5 AS idx FROM events WHERE value > 3)"
_HALF = "a AS (SELECT DISTINCT o_custkey AS m FROM orders WHERE o_orderdate < '1998-01-01'), b AS (SELECT DISTINCT o_custkey AS m FROM orders WHERE o_orderdate >= '1998-01-01')"

SQL = {
    "merkle_root": f"WITH {_tree_sql(_LEAVES)} SELECT tree, root, size FROM tops",
    "membership_root": f"WITH {_tree_sql(_SEGMENTS)} SELECT tree, root, size FROM tops",
    "inclusion_path": f"WITH {_tree_sql(_LEAVES)}, {_PATHS} SELECT l0.tree, l0.pos, coalesce(path, '') AS path FROM l0 LEFT JOIN pa ON pa.tree = l0.tree AND pa.pos = l0.pos",
    "inclusion_verified": f"WITH {_tree_sql(_LEAVES)} SELECT tree, pos, TRUE AS verified, FALSE AS forged FROM l0",
    "membership_neighbours": """WITH m AS (SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS k FROM orders WHERE o_orderkey % 3 > 0), q AS (SELECT DISTINCT lpad(CAST(p_partkey * 7 % 16000 AS VARCHAR), 12, '0') AS member FROM part)
SELECT member, EXISTS (SELECT 1 FROM m WHERE k = member) AS present, (SELECT max(k) FROM m WHERE k < member) AS before, (SELECT min(k) FROM m WHERE k > member) AS after FROM q""",
    "generation_apply": f"WITH {_APPLIED} SELECT domain, cid FROM applied",
    "generation_roots": f"WITH {_APPLIED}, {_tree_sql('SELECT domain AS tree, cid AS member FROM applied')} SELECT tree AS domain, root, size, FALSE AS matches FROM tops",
    "generation_gaps": f"WITH {_NUM} SELECT domain, idx, coalesce(lag(idx) OVER w + 1, idx) AS expected, coalesce(lag(idx) OVER w + 1, idx) <> idx AS gap FROM n WINDOW w AS (PARTITION BY domain ORDER BY idx)",
    "generation_follows": f"WITH {_NUM} SELECT domain, idx, CASE WHEN row_number() OVER w = 1 THEN idx % 9 = 0 ELSE idx = lag(idx) OVER w + 1 AND idx % 9 > 0 END AS follows FROM n WINDOW w AS (PARTITION BY domain ORDER BY idx)",
    "membership_diff": f"WITH {_HALF} SELECT m AS member, 'added' AS change FROM b WHERE m NOT IN (SELECT m FROM a) UNION ALL SELECT m, 'removed' FROM a WHERE m NOT IN (SELECT m FROM b)",
    "misdeclared": f"""WITH {_HALF} SELECT c_custkey AS cid, 'declared added, not new' AS fault FROM customer WHERE c_custkey % 10 = 0 AND c_custkey NOT IN (SELECT m FROM b WHERE m NOT IN (SELECT m FROM a))
UNION ALL SELECT m, 'removed, not declared' FROM a WHERE m NOT IN (SELECT m FROM b) AND m % 10 <= 4""",
    "corpus_growth": f"WITH {_HALF} SELECT (SELECT count(*) FROM a WHERE m NOT IN (SELECT m FROM b)) AS lost, (SELECT count(*) FROM b WHERE m NOT IN (SELECT m FROM a)) AS added",
    "added_between": f"WITH {_GEN} SELECT DISTINCT domain, idx, cid FROM g WHERE NOT gone AND idx > 2 AND idx <= 5",
    "head_generation": f"WITH {_GEN} SELECT domain, max(idx) AS head FROM g GROUP BY domain",
    "split_views": "WITH s AS (SELECT DISTINCT user_id AS domain, CAST(CAST(ts AS DATE) AS VARCHAR) AS generation, CAST(floor(value / 20) AS BIGINT) AS r FROM events) SELECT domain, generation, string_agg(r, ',' ORDER BY r) AS roots FROM s GROUP BY 1, 2 HAVING count(*) > 1",
    "checkpoints": "SELECT domain, head, array_to_string(list_sort(list_filter(list_transform(range(0, 62), lambda k: head - (CAST(1 AS BIGINT) << k)), lambda x: x >= 0)), ',') AS kept FROM (SELECT o_custkey AS domain, count(*) AS head FROM orders GROUP BY 1)",
    "fetches_required": "SELECT o_orderkey, CAST(bit_count(o_orderkey) AS INTEGER) AS fetches FROM orders",
    "gc_candidates": "SELECT o_orderkey AS cid FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) AND o_orderkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 10 = 0)",
    "removable": "SELECT doc_id AS cid, doc_id NOT IN (SELECT doc_id FROM labels) OR doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS removable FROM documents",
    "untimestamped": "SELECT doc_id AS cid FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND doc_id % 13 NOT IN (0, 1)",
    "missing_depends": "WITH RECURSIVE part_edges AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 0 UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey > 0), r AS (SELECT p_partkey AS n FROM part WHERE p_size % 4 = 1 UNION SELECT dst FROM r JOIN part_edges ON src = n) SELECT n AS cid FROM r WHERE n NOT IN (SELECT p_partkey FROM part WHERE p_size % 4 = 1)",
    "missing_equivalents": "WITH RECURSIVE l AS (SELECT p_partkey AS a, p_partkey - 1 AS b FROM part WHERE p_partkey % 20 > 3), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r AS (SELECT p_partkey AS n FROM part WHERE p_partkey % 60 = 9 UNION SELECT e.b FROM r JOIN e ON e.a = n) SELECT n AS cid FROM r WHERE n % 60 <> 9",
    "personhood": "SELECT event_id AS seq, user_id AS subject, user_id = first_value(user_id) OVER (PARTITION BY event_id % 3, props ORDER BY event_id) AS accepted FROM events",
    "scheme_minimum": "SELECT user_id AS subject, count(DISTINCT event_type) AS schemes, count(DISTINCT event_type) >= 3 AS enough FROM events WHERE value > 40 GROUP BY 1",
    "names": "SELECT slug, cid FROM (SELECT slug, cid, row_number() OVER (PARTITION BY slug ORDER BY p, cid) AS n FROM (SELECT n_nationkey % 500 AS slug, n_nationkey AS cid, 0 AS p FROM nation UNION ALL SELECT s_suppkey % 500, s_suppkey, 1 FROM supplier UNION ALL SELECT p_partkey % 500, p_partkey, 2 FROM part)) WHERE n = 1",
    "objects_scan": "SELECT doc_id, sha256(text || 'x') AS stored, CAST(strlen(text) AS BIGINT) AS size FROM documents WHERE doc_id % 17 = 0",
}
