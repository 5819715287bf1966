"""Trust, evidence and standing over the harness tables: nations vouch for nations, customers judge parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..model import CLAIM_CLASSES, REPRODUCIBILITY
from ..operators import evidence, standing, trust
from .common import table

ROUNDS, DAMPING = 20, 850_000


def _dealings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line: buying nation, selling nation, priority and day."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"), "o_orderpriority", "o_orderdate")
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("cn"))
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("sn"))
    return line.join(orders, "l_orderkey").join(customer, "c_custkey").join(supplier, "l_suppkey")


def _named(spark: SparkSession, sf_dir: str, edges: DataFrame) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    a, b = n.select(F.col("n_nationkey").alias("cn"), F.col("n_name").alias("src")), n.select(F.col("n_nationkey").alias("sn"), F.col("n_name").alias("dst"))
    return edges.join(a, "cn").join(b, "sn").drop("cn", "sn")


def _roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").filter("n_regionkey = 0").select(F.col("n_name").alias("key"), F.lit(fixed.SCALE).cast("bigint").alias("weight"))


def nation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(spark, sf_dir, _dealings(spark, sf_dir).groupBy("cn", "sn").agg(F.count(F.lit(1)).alias("weight")))


def trust_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trust.propagate(nation_edges(spark, sf_dir), _roots(spark, sf_dir), DAMPING, ROUNDS)


def trust_pagerank_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _dealings(spark, sf_dir).groupBy("cn", "sn", "o_orderpriority").agg(F.count(F.lit(1)).alias("weight")).withColumn("subjects", F.array("o_orderpriority"))
    return trust.propagate(trust.within(_named(spark, sf_dir, edges), ["1-URGENT", "2-HIGH"]), _roots(spark, sf_dir), DAMPING, ROUNDS)


def trust_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _dealings(spark, sf_dir)
    last = table(spark, sf_dir, "orders").agg(F.max(F.to_date("o_orderdate"))).scalar()
    aged = d.withColumn("age_days", F.datediff(last, F.to_date("o_orderdate")).cast("bigint"))
    edges = aged.groupBy("cn", "sn", "age_days").agg((F.count(F.lit(1)) * 1000).alias("weight"))
    return trust.propagate(_named(spark, sf_dir, edges), _roots(spark, sf_dir), DAMPING, ROUNDS, half_life=365)


def trust_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trust.shares(nation_edges(spark, sf_dir))


def trust_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "part").filter("p_partkey > 0").select(F.col("p_partkey").alias("src"), F.expr("p_partkey div 3").alias("dst"))
    starts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("start"))
    return trust.reachable_within(edges, starts, 2)


def trust_edge_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    notes = e.select(F.col("event_id").alias("cid"), F.col("user_id").alias("author"), F.expr("event_id % 97").alias("target"), F.when(F.col("event_type") != "view", F.round(F.col("value") * 100).cast("bigint")).alias("weight"), F.array("event_type").alias("subjects"))
    return trust.trust_edges(notes).select("src", "dst", "weight", F.array_join("subjects", ",").alias("subjects"))


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("target"), "l_returnflag", "l_linenumber", "l_suppkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("author"))
    finding = F.when(F.col("l_returnflag") == "N", "affirm").when(F.col("l_returnflag") == "R", "deny").otherwise("abstain")
    return line.join(orders, "l_orderkey").withColumn("finding", finding)


def verdict_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = evidence.verdict_sets(_verdicts(spark, sf_dir))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return sets.select("target", text("affirm"), text("deny"), text("abstain"))


def _weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's weight: their nation's."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("key"))
    by_nation = trust_pagerank(spark, sf_dir).join(nations, "key").select(F.col("n_nationkey").alias("c_nationkey"), "weight")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), "c_nationkey").join(by_nation, "c_nationkey").select("key", "weight")


def verdict_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.verdict_weights(_verdicts(spark, sf_dir), _weights(spark, sf_dir))


def reproduction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.when(F.col("l_returnflag") == "N", "consistent").when(F.col("l_returnflag") == "R", "inconsistent").when(F.col("l_quantity") > 25, "method-underspecified").otherwise("inconclusive")
    return evidence.tally(_verdicts(spark, sf_dir).withColumn("outcome", outcome))


def independent_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("group"), F.col("l_suppkey").alias("author")).distinct()
    parties = line.select("group", (F.col("group").cast("bigint") * 1_000_000 + F.col("author")).alias("id"), "author", F.lit(None).cast("string").alias("funding"))
    month = lambda n: F.concat(F.lit("1995-"), F.lpad((F.expr("s_suppkey % 9") + n).cast("string"), 2, "0"))
    groups = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("bigint").alias("author"), F.col("s_nationkey").alias("org"), month(1).alias("from"), F.when(F.expr("s_suppkey % 5 > 0"), month(2)).alias("to"))
    return evidence.independent_counts(parties, groups)


def argued_disputes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    disputes = lab.filter("quality = 1").select(F.expr("doc_id % 100").alias("target"), F.col("doc_id").alias("dispute"), F.col("source").alias("author"))
    return evidence.argued_disputes(disputes, lab.filter("toxic = 1").select(F.col("doc_id").alias("dispute")))


def same_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("event_type = 'signup'")
    return evidence.same_person_links(e.select(F.col("user_id").alias("subject"), F.expr("event_id % 50").alias("same_as")))


def usage_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("target"), "source")
    return evidence.usage_sources(d).select("target", F.array_join("sources", ",").alias("sources"))


def assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    notes = e.select(F.expr("event_id % 200").alias("target"), F.col("user_id").alias("author"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("verdict"), F.when(F.expr("event_id % 7 > 0"), F.col("props")).alias("grounds"))
    return evidence.assessments(notes).select("target", F.array_join(F.transform("list", lambda x: F.concat_ws("/", x["author"], x["verdict"], x["grounds"])), ";").alias("list"))


def standing_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per part: weights of distinct judges, disputes, replications and flags."""
    v = _verdicts(spark, sf_dir)
    weights = _weights(spark, sf_dir)
    sums = evidence.verdict_weights(v, weights)
    argued = v.filter("finding = 'deny' AND l_linenumber = 1").select("target", "author").distinct().join(weights.select(F.col("key").alias("author"), "weight"), "author").groupBy("target").agg(F.sum("weight").cast("bigint").alias("argued"))
    repeats = v.groupBy("target").agg(
        F.countDistinct(F.when(F.col("finding") == "affirm", F.col("l_suppkey"))).alias("independent_consistent"),
        F.countDistinct(F.when((F.col("finding") == "deny") & (F.col("l_quantity") >= 50), F.col("l_suppkey"))).alias("independent_inconsistent"),
    )
    pick = lambda names, of: F.element_at(F.array(*[F.lit(n) for n in names]), (F.col(of) % len(names) + 1).cast("int"))
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("target"), pick(CLAIM_CLASSES, "p_partkey").alias("class"), pick(REPRODUCIBILITY, "p_size").alias("repro_class"),
        F.expr("p_partkey % 50 = 0").alias("retracted"), F.expr("p_partkey % 4 = 1").alias("proof_checked"),
    )
    joined = parts.join(sums, "target", "left").join(argued, "target", "left").join(repeats, "target", "left")
    return joined.fillna(0, ["affirm", "deny", "abstain", "argued", "independent_consistent", "independent_inconsistent"])


def standing_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = standing.ranked(standing.standings(standing_evidence(spark, sf_dir)))
    return found.select("rank", "target", "class", "affirm", "deny", "abstain", "argued", "delta", "result")


def standing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standing.standings(standing_evidence(spark, sf_dir)).groupBy("class", "result").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (trust_pagerank, trust_pagerank_subject, trust_decay, trust_shares, trust_reach, trust_edge_dedupe, verdict_sets, verdict_weights, reproduction_counts, independent_parties, argued_disputes, same_person, usage_sources, assessments, standing_rank, standing_counts)}


# The same in SQL.

_DEALINGS = "dealings AS (SELECT c_nationkey AS cn, s_nationkey AS sn, o_orderpriority, o_orderdate FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey)"
_PLAIN = "edges AS (SELECT a.n_name AS src, b.n_name AS dst, CAST(count(*) AS BIGINT) AS weight FROM dealings JOIN nation a ON a.n_nationkey = cn JOIN nation b ON b.n_nationkey = sn GROUP BY 1, 2)"
_SUBJECT = _PLAIN.replace("GROUP BY", "WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY")
_AGED = (
    "aged AS (SELECT cn, sn, date_diff('day', CAST(o_orderdate AS DATE), (SELECT max(CAST(o_orderdate AS DATE)) FROM orders)) AS age FROM dealings), "
    "each AS (SELECT cn, sn, age, CAST(count(*) * 1000 AS BIGINT) AS w FROM aged GROUP BY 1, 2, 3), "
    "halved AS (SELECT cn, sn, age % 365 AS rest, CASE WHEN age // 365 >= 63 THEN 0 ELSE w // (CAST(1 AS BIGINT) << least(age // 365, 62)) END AS h FROM each), "
    "edges AS (SELECT a.n_name AS src, b.n_name AS dst, CAST(sum(h - h * rest // 730) AS BIGINT) AS weight FROM halved JOIN nation a ON a.n_nationkey = cn JOIN nation b ON b.n_nationkey = sn GROUP BY 1, 2)"
)
_FLOW = (
    "flow AS (SELECT src, dst, CASE WHEN t = 0 THEN 0 ELSE weight * 1000000 // t END AS share FROM (SELECT *, CAST(sum(weight) OVER (PARTITION BY src) AS BIGINT) AS t FROM edges)), "
    "seed AS (SELECT n_name AS key, CAST(1000000 AS BIGINT) * 1000000 // (SELECT CAST(count(*) * 1000000 AS BIGINT) FROM nation WHERE n_regionkey = 0) AS v FROM nation WHERE n_regionkey = 0), "
    "base AS (SELECT key, v * 150000 // 1000000 AS part FROM seed), w0 AS MATERIALIZED (SELECT key, v FROM seed)"
)


def _rounds() -> str:
    out = []
    for i in range(1, ROUNDS + 1):
        sent = f"SELECT dst AS key, (v * share // 1000000) * {DAMPING} // 1000000 AS part FROM w{i - 1} JOIN flow ON src = key"
        out.append(f"w{i} AS MATERIALIZED (SELECT key, CAST(sum(part) AS BIGINT) AS v FROM (SELECT * FROM base UNION ALL {sent}) GROUP BY key)")
    return ", ".join(out)


def _rank_sql(edges: str) -> str:
    return f"{_DEALINGS}, {edges}, {_FLOW}, {_rounds()}"


def _choose(names: tuple[str, ...], of: str) -> str:
    listed = ", ".join(f"'{n}'" for n in names)
    return f"([{listed}])[CAST({of} % {len(names)} AS INT) + 1]"


_VERDICTS = "v AS (SELECT l_partkey AS target, o_custkey AS author, l_linenumber, l_suppkey, l_quantity, l_returnflag, CASE l_returnflag WHEN 'N' THEN 'affirm' WHEN 'R' THEN 'deny' ELSE 'abstain' END AS finding FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"
_WEIGHTS = f"cw AS (SELECT c_custkey AS key, v AS weight FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN w{ROUNDS} ON w{ROUNDS}.key = n_name WHERE v <> 0)"
_SUMS = (
    "ks AS (SELECT DISTINCT target, finding, author FROM v), "
    "sums AS (SELECT target, CAST(coalesce(sum(weight) FILTER (finding = 'affirm'), 0) AS BIGINT) AS affirm, CAST(coalesce(sum(weight) FILTER (finding = 'deny'), 0) AS BIGINT) AS deny, "
    "CAST(coalesce(sum(weight) FILTER (finding = 'abstain'), 0) AS BIGINT) AS abstain FROM ks LEFT JOIN cw ON cw.key = author GROUP BY target)"
)
_STANDING = f"""WITH {_rank_sql(_PLAIN)}, {_VERDICTS}, {_WEIGHTS}, {_SUMS},
arg AS (SELECT target, CAST(sum(weight) AS BIGINT) AS argued FROM (SELECT DISTINCT target, author FROM v WHERE finding = 'deny' AND l_linenumber = 1) JOIN cw ON cw.key = author GROUP BY target),
rep AS (SELECT target, count(DISTINCT l_suppkey) FILTER (finding = 'affirm') AS ic, count(DISTINCT l_suppkey) FILTER (finding = 'deny' AND l_quantity >= 50) AS ii FROM v GROUP BY target),
ev AS (SELECT p_partkey AS target, {_choose(CLAIM_CLASSES, "p_partkey")} AS class, {_choose(REPRODUCIBILITY, "p_size")} AS repro, p_partkey % 50 = 0 AS retracted, p_partkey % 4 = 1 AS proof,
  coalesce(affirm, 0) AS affirm, coalesce(deny, 0) AS deny, coalesce(abstain, 0) AS abstain, coalesce(argued, 0) AS argued, coalesce(ic, 0) AS ic, coalesce(ii, 0) AS ii
  FROM part LEFT JOIN sums ON sums.target = p_partkey LEFT JOIN arg ON arg.target = p_partkey LEFT JOIN rep ON rep.target = p_partkey),
dl AS (SELECT *, CASE WHEN affirm + argued = 0 THEN CAST(0 AS BIGINT) ELSE least(CAST(290000 AS BIGINT), 290000 * argued // (affirm + argued)) END AS delta FROM ev),
st AS (SELECT *, CASE WHEN class IN ('definitional', 'normative', 'expressive', 'performative') THEN 'not-truth-apt' WHEN retracted THEN 'rejected' WHEN class = 'formal' AND proof THEN 'accepted'
  WHEN class = 'empirical' AND ii > 0 THEN 'rejected' WHEN affirm + deny = 0 THEN 'undetermined' WHEN deny * 1000000 // (affirm + deny) >= 660000 + delta THEN 'rejected'
  WHEN affirm * 1000000 // (affirm + deny) >= 660000 + delta THEN CASE WHEN class <> 'empirical' OR CASE repro WHEN 'restricted' THEN FALSE WHEN 'unique-event' THEN ic >= 1 ELSE ic >= 2 END THEN 'accepted' ELSE 'unreplicated' END
  ELSE 'contested' END AS result FROM dl)"""

SQL = {
    "trust_pagerank": f"WITH {_rank_sql(_PLAIN)} SELECT key, v AS weight FROM w{ROUNDS} WHERE v <> 0",
    "trust_pagerank_subject": f"WITH {_rank_sql(_SUBJECT)} SELECT key, v AS weight FROM w{ROUNDS} WHERE v <> 0",
    "trust_decay": f"WITH {_rank_sql(_AGED)} SELECT key, v AS weight FROM w{ROUNDS} WHERE v <> 0",
    "trust_shares": f"WITH {_DEALINGS}, {_PLAIN}, {_FLOW} SELECT src, dst, share FROM flow",
    "trust_reach": """WITH e AS (SELECT p_partkey AS a, p_partkey // 3 AS b FROM part WHERE p_partkey > 0), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
n AS (SELECT p_partkey AS start, p_partkey AS node, 0 AS depth FROM part UNION ALL SELECT p_partkey, u.b, 1 FROM part JOIN u ON u.a = p_partkey UNION ALL SELECT p_partkey, y.b, 2 FROM part JOIN u x ON x.a = p_partkey JOIN u y ON y.a = x.b)
SELECT start, node, CAST(min(depth) AS INTEGER) AS depth FROM n GROUP BY start, node""",
    "trust_edge_dedupe": """SELECT user_id AS src, event_id % 97 AS dst, CASE WHEN event_type <> 'view' THEN CAST(round(value * 100) AS BIGINT) ELSE 1000000 END AS weight, event_type AS subjects
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_id % 97 ORDER BY event_id) AS n FROM events) WHERE n = 1""",
    "verdict_sets": f"""WITH {_VERDICTS}, k AS (SELECT DISTINCT target, finding, author FROM v), g AS (SELECT target, finding, string_agg(author, ',' ORDER BY author) AS s FROM k GROUP BY 1, 2)
SELECT target, coalesce(max(s) FILTER (finding = 'affirm'), '') AS affirm, coalesce(max(s) FILTER (finding = 'deny'), '') AS deny, coalesce(max(s) FILTER (finding = 'abstain'), '') AS abstain FROM g GROUP BY target""",
    "verdict_weights": f"WITH {_rank_sql(_PLAIN)}, {_VERDICTS}, {_WEIGHTS}, {_SUMS} SELECT target, affirm, deny, abstain FROM sums",
    "reproduction_counts": f"WITH {_VERDICTS} SELECT target, count(*) FILTER (l_returnflag = 'N') AS consistent, count(*) FILTER (l_returnflag = 'R') AS inconsistent, count(*) FILTER (l_returnflag NOT IN ('N', 'R')) AS inconclusive FROM v GROUP BY target",
    "independent_parties": """WITH RECURSIVE s AS (SELECT s_suppkey AS k, s_nationkey AS org, '1995-' || lpad(CAST(s_suppkey % 9 + 1 AS VARCHAR), 2, '0') AS f, CASE WHEN s_suppkey % 5 > 0 THEN '1995-' || lpad(CAST(s_suppkey % 9 + 2 AS VARCHAR), 2, '0') ELSE '~' END AS t FROM supplier),
p AS (SELECT DISTINCT l_partkey AS g, l_suppkey AS k FROM lineitem),
e AS (SELECT a.g, a.k AS x, b.k AS y FROM p a JOIN s sa ON sa.k = a.k JOIN p b ON b.g = a.g JOIN s sb ON sb.k = b.k AND sb.org = sa.org WHERE sa.f <= sb.t AND sb.f <= sa.t),
r AS (SELECT g, x, y FROM e UNION SELECT r.g, r.x, e.y FROM r JOIN e ON e.g = r.g AND e.x = r.y),
c AS (SELECT g, x, min(y) AS m FROM r GROUP BY g, x) SELECT g AS "group", count(DISTINCT m) AS independent FROM c GROUP BY g""",
    "argued_disputes": "SELECT DISTINCT d.doc_id % 100 AS target, source AS author FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE quality = 1 AND d.doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "same_person": "SELECT DISTINCT least(user_id, event_id % 50) AS a, greatest(user_id, event_id % 50) AS b FROM events WHERE event_type = 'signup' AND user_id <> event_id % 50",
    "usage_sources": "SELECT lang AS target, string_agg(source, ',' ORDER BY source) AS sources FROM (SELECT DISTINCT lang, source FROM documents) GROUP BY lang",
    "assessments": "SELECT event_id % 200 AS target, string_agg(user_id || '/' || event_type || '/' || props, ';' ORDER BY user_id, event_type, props) AS list FROM events WHERE event_type <> 'view' AND event_id % 7 > 0 GROUP BY 1",
    "standing_rank": _STANDING + " SELECT row_number() OVER (ORDER BY affirm DESC, target) AS rank, target, class, affirm, deny, abstain, argued, delta, result FROM st",
    "standing_counts": _STANDING + " SELECT class, result, count(*) AS n FROM st GROUP BY 1, 2",
}
