"""Scalar functions applied to whole tables: fixed point, cells, versions, lint, names, quantities, facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, h3, lint, text, versions
from ..model import ANNOTATION_CLASSES, CLAIM_CLASSES, RELATION_CLASSES, annotation_class, content_is_assertion, is_acyclic_kind, relation_class
from ..operators import evidence, facts, listing, quantities
from .common import table


def fixed_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = lambda c: F.round(F.col(c) * 100).cast("bigint")
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", cents("l_extendedprice").alias("price"), cents("l_discount").alias("disc"), cents("l_tax").alias("tax"), cents("l_quantity").alias("qty"))
    signed = F.when(F.col("l_linenumber") % 2 == 0, -F.col("price")).otherwise(F.col("price"))
    return line.select(
        "l_orderkey", "l_linenumber", "price",
        fixed.ratio(signed, F.col("qty")).alias("ratio"), fixed.mul_div(signed, F.col("tax"), F.col("disc")).alias("mul_div"), fixed.times(signed, F.col("qty")).alias("times"),
        fixed.wide(signed, F.col("qty"), F.col("tax")).alias("wide"), fixed.halve(F.col("price"), F.col("qty"), F.lit(365)).alias("halved"), fixed.show(signed).alias("shown"),
    )


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic identifiers from part keys: resolution, base cell and digits follow the key; some are broken."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    r = F.col("p_partkey") % 16
    bits = F.lit(1 << 59).cast("bigint") + F.call_function("shiftleft", r.cast("bigint"), F.lit(52)) + F.call_function("shiftleft", (F.col("p_partkey") % 124).cast("bigint"), F.lit(45))
    for level in range(1, 16):
        used = (F.col("p_partkey") * level + F.col("p_size") * (level % 5)) % 7
        digit = F.when(level <= r, F.when(F.col("p_partkey") % 6 == 0, 0).otherwise(used)).otherwise(F.when(F.col("p_partkey") % 29 == 0, 3).otherwise(7))
        bits = bits + digit.cast("bigint") * (1 << (15 - level) * 3)
    return p.withColumn("cell", bits)


def h3_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cells(spark, sf_dir)
    return c.select("p_partkey", "cell", h3.is_valid(F.col("cell")).alias("valid"), h3.resolution(F.col("cell")).alias("resolution"), h3.is_pentagon(F.col("cell")).alias("pentagon"))


def h3_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cells(spark, sf_dir).filter(h3.is_valid(F.col("cell")))
    level = F.col("p_size") % 12
    return c.select("p_partkey", h3.show(F.col("cell")).alias("cell"), h3.show(h3.parent_at(F.col("cell"), level)).alias("parent"), h3.contains(h3.parent_at(F.col("cell"), level), F.col("cell")).alias("inside"))


def h3_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cells(spark, sf_dir)
    spelt = F.when(F.col("p_partkey") % 5 == 0, F.upper(h3.show(F.col("cell")))).when(F.col("p_partkey") % 5 == 1, F.concat(F.lit("0"), h3.show(F.col("cell")))).otherwise(h3.show(F.col("cell")))
    return c.select("p_partkey", spelt.alias("spelling")).select("p_partkey", "spelling", h3.parse(F.col("spelling")).alias("cell"))


def h3_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cells(spark, sf_dir).filter(h3.is_valid(F.col("cell")))
    areas = c.filter(h3.resolution(F.col("cell")) <= 2).select(F.col("p_partkey").alias("area"), "cell")
    return facts.inside(c.select(F.col("p_partkey").alias("cid"), "cell"), areas)


def version_satisfies(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    brand = F.regexp_extract("p_brand", "[0-9]+", 0).cast("int")
    have = F.concat_ws(".", (F.col("p_size") % 3).cast("string"), (brand % 4).cast("string"), F.when(F.col("p_partkey") % 5 > 0, (F.col("p_partkey") % 6).cast("string")))
    base = F.concat_ws(".", (F.col("p_partkey") % 3).cast("string"), F.when(F.col("p_partkey") % 4 > 0, (F.col("p_partkey") % 5).cast("string")))
    need = F.when(F.col("p_partkey") % 7 == 0, F.lit("")).when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("^"), base)).when(F.col("p_partkey") % 3 == 1, F.concat(base, F.lit("+"))).otherwise(base)
    v = p.select("p_partkey", have.alias("version"), need.alias("requires"))
    return v.withColumn("satisfied", versions.satisfies(F.col("version"), F.col("requires")))


def sentence_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", lint.sentences(F.col("text")).alias("sentences"))


def quantity_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", lint.quantities(F.col("text")).alias("quantities"))


def lint_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("f", lint.findings(F.col("text")))
    found = d.select("doc_id", F.explode_outer("f").alias("f")).filter("f IS NOT NULL")  # an inner explode would evaluate f for its filter too
    return found.select("doc_id", "f.test", "f.detail")


def term_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", *[lint.mentions(F.col("text"), F.lit(w)).alias(w) for w in ("the", "her", "of", "ion")])


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    name = F.concat_ws(" / ", "p_name", "p_brand", "p_type")
    return p.select("p_partkey", text.segment(name).alias("segment"), text.term(F.concat("p_name", F.lit(" ("), "p_brand", F.lit("): x"))).alias("term"), text.shorten(F.repeat(name, 4), 60).alias("label"), text.is_tag(F.concat_ws("-", F.lit("abc"), F.substring("p_type", 1, 6), F.lpad((F.col("p_size") % 20).cast("string"), 2, "0"), F.lit("2024"))).alias("tag"), text.is_slug(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("slug"))


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("instant", F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T12:34:56"), F.when(F.col("o_orderkey") % 4 > 0, F.lit("Z")).otherwise(F.lit("+02"))))
    return o.select("o_orderkey", "instant", text.epoch_of(F.col("instant")).alias("epoch"))


def period_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    month = lambda n: F.date_format(F.add_months("o_orderdate", n), "yyyy-MM")
    open_end = F.when(F.col("o_custkey") % 5 > 0, month(F.col("o_custkey") % 7))
    return o.select("o_orderkey", text.overlaps(month(0), open_end, F.lit("1996-06"), F.lit("1997-01")).alias("meets"))


def kind_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [*RELATION_CLASSES, *ANNOTATION_CLASSES, "unheard-of"]
    e = table(spark, sf_dir, "events").select("event_id", F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("event_id") % len(names) + 1).cast("int")).alias("kind"))
    return e.select("event_id", "kind", F.coalesce(relation_class(F.col("kind")), annotation_class(F.col("kind"))).alias("class"), is_acyclic_kind(F.col("kind")).alias("acyclic"))


def verdict_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(n) for n in CLAIM_CLASSES]), (F.col("event_id") % 9 + 1).cast("int"))
    e = table(spark, sf_dir, "events").select("event_id", kind.alias("class"), F.when(F.col("event_type") == "view", F.lit("provenance")).alias("aspect"))
    return e.select("event_id", "class", evidence.verdict_fault(F.col("class"), F.col("aspect")).alias("fault"), content_is_assertion(F.col("class")).alias("assertion"))


def quantity_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    value = F.when(F.col("l_linenumber") == 3, F.lit("1e3")).otherwise(F.col("l_quantity").cast("int").cast("string"))
    cells = line.select(
        F.concat_ws(":", "l_orderkey", "l_partkey", "l_suppkey").alias("cid"), F.col("l_linenumber").alias("row"), F.lit(0).alias("col"),
        F.create_map(F.lit("value"), value, F.when(F.col("l_returnflag") == "R", "error").otherwise("low"), F.lit("1.5")).alias("quantity"), F.array(F.lit("low"), F.lit("value")).alias("parameters"),
    )
    return quantities.cell_faults(cells).groupBy("row", "rule").agg(F.count(F.lit(1)).alias("n"))


def table_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    columns = F.array(F.col("p_name"), F.when(F.col("p_size") % 7 > 0, F.col("p_brand")).otherwise(F.lit("")), F.when(F.col("p_size") % 5 > 0, F.col("p_type")).otherwise(F.col("p_name")))
    rows = F.array(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.when(F.col("p_size") % 11 > 0, F.array(F.lit("a"), F.lit("b"), F.lit("c"))).otherwise(F.array(F.lit("a"))))
    return quantities.table_faults(p.select(F.col("p_partkey").alias("cid"), columns.alias("columns"), rows.alias("rows")))


def unit_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = ["m", "km", "kg", "m/s", "N.m", "J", "furlong", "cm2"]
    p = table(spark, sf_dir, "part")
    columns = p.select(F.col("p_partkey").alias("cid"), F.lit(0).alias("col"), F.element_at(F.array(*[F.lit(u) for u in units]), (F.col("p_partkey") % 8 + 1).cast("int")).alias("unit"), F.element_at(F.array(F.lit("length"), F.lit("energy"), F.lit("area"), F.lit("unheld")), (F.col("p_size") % 4 + 1).cast("int")).alias("kind"))
    kinds = spark.createDataFrame([("length", "length:1"), ("energy", "length:2 mass:1 time:-2"), ("area", "length:2")], "kind string, dimension string")
    return quantities.unit_faults(columns, kinds).select("cid", "rule", "rejects")


def class_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    coded = p.select(F.col("p_partkey").alias("cid"), F.regexp_extract("p_brand", "[0-9]+", 0).alias("code"))
    concepts = spark.createDataFrame([("1", "one"), ("12", "twelve"), ("13", "thirteen"), ("2", "two"), ("21", "twenty_one"), ("21", "score_and_one"), ("3", "three")], "code string, segment string")
    return facts.class_paths(coded, concepts).select("cid", F.array_join("path", ".").alias("path"), "fault")


def _singulars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts within parts: each stands in the one of a quarter of its key."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("cid"), F.when(F.col("p_partkey") >= 4, F.expr("p_partkey div 4")).alias("part_of"), F.substring("p_type", 1, 1).alias("code"), text.segment(F.col("p_brand")).alias("segment"))


def singular_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.chains(_singulars(spark, sf_dir))


def singular_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    concepts = spark.createDataFrame([("E", "economy"), ("S", "standard"), ("P", "promo"), ("L", "large")], "code string, segment string")
    return facts.singular_paths(_singulars(spark, sf_dir), concepts).select("cid", F.array_join("path", ".").alias("path"), "fault")


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cid"), "l_linenumber", "l_suppkey", "l_partkey", F.col("l_quantity").cast("int").cast("string").alias("q"), F.round(F.col("l_tax") * 100).cast("int").cast("string").alias("t")).distinct()
    line = line.withColumn("row", F.concat_ws(":", "l_linenumber", "l_suppkey", "l_partkey", "q", "t"))
    cells = line.select("cid", "row", F.explode(F.array(F.struct(F.lit(0).alias("col"), F.col("l_partkey").cast("string").alias("value")), F.struct(F.lit(1).alias("col"), F.col("q").alias("value")), F.struct(F.lit(2).alias("col"), F.col("t").alias("value")))).alias("c")).select("cid", "row", "c.*")
    claims = line.select("cid").distinct()
    columns = claims.select("cid", F.explode(F.array(F.struct(F.lit(0).alias("col"), F.lit("about").alias("role"), F.lit(None).cast("string").alias("concept")), F.struct(F.lit(1).alias("col"), F.lit("value").alias("role"), F.lit("c1").alias("concept")), F.struct(F.lit(2).alias("col"), F.lit("value").alias("role"), F.lit("c2").alias("concept")))).alias("c")).select("cid", "c.*")
    concepts = spark.createDataFrame([("c1", "quantity"), ("c2", "tax"), ("c3", "tax")], "cid string, segment string")
    depends = claims.select("cid", F.explode(F.expr("CASE WHEN cid % 12 = 0 THEN array('c1', 'c2', 'c3') ELSE array('c1', 'c2') END")).alias("dep"))
    return facts.about(cells, columns, concepts, depends)


def fact_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _facts(spark, sf_dir)
    return found.groupBy("singular", "segment").agg(F.count(F.lit(1)).alias("facts"), F.sum(F.col("value").cast("bigint")).alias("total"))


def fact_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    describes = F.when(F.col("l_returnflag") == "N", "exact").when(F.col("l_returnflag") == "R", "model")
    value = F.when(F.col("l_discount") > 0.02, F.col("l_quantity"))
    s = line.withColumn("status", facts.status(value, describes, F.col("l_linenumber") % 2 == 0, F.when(F.col("l_tax") > 0.06, 1).otherwise(0)))
    return s.groupBy("l_returnflag", "l_linenumber", "status").agg(F.count(F.lit(1)).alias("n"))


def _notes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events")
    notes = e.select(F.col("event_id").alias("cid"), F.col("user_id").alias("target"), F.get_json_object("props", "$.k").alias("value"), F.col("event_type").alias("source"), F.when(F.col("value") > 10, F.col("props")).alias("locator"))
    return notes, e.filter("event_type = 'error'").select(F.col("event_id").alias("cid"))


def tags_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.tags(*_notes(spark, sf_dir)).select("target", F.array_join("tags", ",").alias("tags"))


def usage_locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.usages(*_notes(spark, sf_dir))


def classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.col("user_id").alias("src"), F.expr("event_id % 30").alias("dst"))
    both = listing.outgoing(e, "click").select("cid", F.lit("subjects").alias("side"), "others").union(listing.incoming(e, "click").select("cid", F.lit("classified").alias("side"), "others"))
    return both.select("cid", "side", F.array_join(F.transform("others", lambda x: x.cast("string")), ",").alias("others"))


def by_human(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "customer").filter("c_custkey % 9 > 0").select(F.col("c_custkey").alias("cid"), F.when(F.col("c_mktsegment") == "MACHINERY", "automated").otherwise("human").alias("principal"))
    objects = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cid"), F.col("o_custkey").alias("author"))
    return listing.by_human(objects, keys).select("cid", "human")


def active_renderings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.date_format("o_orderdate", "yyyy-MM").alias("created"), F.col("o_orderkey").alias("cid"))
    return listing.active_renderings(o)


def object_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("cid"), F.col("lang").alias("kind"), F.col("source").alias("author"), F.lit("doc").alias("class"))
    return listing.listed(d, kind="en", author="src0")


def open_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("dispute"), F.col("user_id").alias("target"), "event_type")
    a = e.filter("event_type = 'view'").withColumn("verdict", F.element_at(F.array(*[F.lit(x) for x in listing.ASSESSMENTS]), (F.col("dispute") % 6 + 1).cast("int")))
    v = e.filter("event_type = 'click'").withColumn("finding", F.when(F.col("dispute") % 2 == 0, "deny").otherwise("affirm"))
    return listing.open_annotations(a, v, e.filter("event_type = 'error'"), e.filter("dispute % 4 = 0").select("dispute"))


QUERIES = {f.__name__: f for f in (fixed_ops, h3_valid, h3_parent, h3_parse, h3_contains, version_satisfies, sentence_count, quantity_count, lint_findings, term_mentions, segments, epochs, period_overlap, kind_classes, verdict_faults, quantity_cells, table_faults, unit_faults, class_paths, singular_chains, singular_paths, fact_lookup, fact_status, tags_distinct, usage_locators, classification, by_human, active_renderings, object_listing, open_annotations)}


# The same in SQL.

_SIGNED = "CASE WHEN l_linenumber % 2 = 0 THEN -price ELSE price END"
_CENTS = "c AS (SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) AS price, CAST(round(l_discount * 100) AS BIGINT) AS disc, CAST(round(l_tax * 100) AS BIGINT) AS tax, CAST(round(l_quantity * 100) AS BIGINT) AS qty FROM lineitem), s AS (SELECT *, " + _SIGNED + " AS x FROM c)"


def _digit_sql(level: int) -> str:
    used = f"(p_partkey * {level} + p_size * {level % 5}) % 7"
    return f"CASE WHEN {level} <= p_partkey % 16 THEN CASE WHEN p_partkey % 6 = 0 THEN 0 ELSE {used} END ELSE CASE WHEN p_partkey % 29 = 0 THEN 3 ELSE 7 END END"


_BITS = " + ".join([str(1 << 59), f"(p_partkey % 16) * {1 << 52}", f"(p_partkey % 124) * {1 << 45}"] + [f"CAST({_digit_sql(n)} AS BIGINT) * {1 << (15 - n) * 3}" for n in range(1, 16)])
_PENT = ", ".join(map(str, h3.PENTAGONS))
_DIGS = "[" + ", ".join(f"(cell >> {(15 - n) * 3}) & 7" for n in range(1, 16)) + "]"
_CELLS = (
    f"c0 AS (SELECT p_partkey, p_size, CAST({_BITS} AS BIGINT) AS cell FROM part), c1 AS (SELECT *, (cell >> 52) & 15 AS r, (cell >> 45) & 127 AS base, {_DIGS} AS dg FROM c0), "
    f"cells AS (SELECT *, base < 122 AND len(list_filter(dg, lambda d, i: (i <= r) = (d = 7))) = 0 AND NOT (base IN ({_PENT}) AND coalesce(list_filter(dg[1:CAST(r AS INT)], lambda d: d <> 0)[1], 0) = 1) AS valid, "
    f"base IN ({_PENT}) AND len(list_filter(dg[1:CAST(r AS INT)], lambda d: d <> 0)) = 0 AS pentagon FROM c1)"
)
_BLANK = "(CAST(1 AS BIGINT) << CAST((15 - {0}) * 3 AS BIGINT)) - 1"
_PARENT = "((cell & ~(CAST(15 AS BIGINT) << 52)) | (CAST({0} AS BIGINT) << 52) | (" + _BLANK + "))"
_LOW = "lower(text)"
_TOKENS = "list_filter(regexp_split_to_array(text, '\\s+'), lambda t: NOT regexp_matches(t, '[A-Za-z][0-9]|[0-9][A-Za-z]'))"
_NQ = f"coalesce(list_sum(list_transform({_TOKENS}, lambda t: len(list_filter(regexp_split_to_array(regexp_replace(t, '[.,]', '', 'g'), '[^0-9]+'), lambda x: x <> '')))), 0)"
_NS = "len(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(text, '([0-9])\\.([0-9])', '\\1_\\2', 'g'), '([0-9])\\.([0-9])', '\\1_\\2', 'g'), '[.?!]'), lambda s: regexp_matches(s, '\\S')))"
_WHILE = "(contains(lower(text), ' while ') AND len(list_filter(string_split(lower(text), ' while ')[2:], lambda p: NOT regexp_matches(regexp_extract(p, '^\\s*(\\S*)', 1), 'ing[^\\p{L}\\p{N}]*$'))) > 0)"
_OPEN = "CASE " + " ".join(f"WHEN starts_with(regexp_replace(lower(text), '^\\s+', ''), '{o}') THEN '{o.strip()}'" for o in lint.OPENERS) + " END"
_BACK = "CASE " + " ".join(f"WHEN contains(lower(text), '{b}') THEN '{b}'" for b in lint.BACKREFERENCES) + " END"


def _mention_sql(word: str) -> str:
    return f"regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}]){word}($|[^\\p{{L}}\\p{{N}}])') AS \"{word}\""


def _pick_sql(names: list[str], of: str) -> str:
    return "([" + ", ".join(f"'{n}'" for n in names) + f"])[CAST({of} % {len(names)} AS INT) + 1]"


_KINDS = [*RELATION_CLASSES, *ANNOTATION_CLASSES, "unheard-of"]
_KIND_CASE = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in (RELATION_CLASSES | ANNOTATION_CLASSES).items()) + " END"
_BRAND = "CAST(regexp_extract(p_brand, '[0-9]+') AS INT)"
_HAVE = f"CAST(p_size % 3 AS VARCHAR) || '.' || CAST({_BRAND} % 4 AS VARCHAR) || CASE WHEN p_partkey % 5 > 0 THEN '.' || CAST(p_partkey % 6 AS VARCHAR) ELSE '' END"
_BASE = "CAST(p_partkey % 3 AS VARCHAR) || CASE WHEN p_partkey % 4 > 0 THEN '.' || CAST(p_partkey % 5 AS VARCHAR) ELSE '' END"
_SING = "s AS (SELECT p_partkey AS cid, CASE WHEN p_partkey >= 4 THEN p_partkey // 4 END AS up, substr(p_type, 1, 1) AS code, trim(regexp_replace(lower(p_brand), '[^\\p{L}\\p{N}]+', '_', 'g'), '_') AS segment FROM part), ch AS (SELECT cid, cid AS whole, 0 AS depth FROM s UNION ALL SELECT ch.cid, s.up, depth + 1 FROM ch JOIN s ON s.cid = ch.whole WHERE s.up IS NOT NULL)"

SQL = {
    "fixed_ops": f"""WITH {_CENTS} SELECT l_orderkey, l_linenumber, price, CASE WHEN qty = 0 THEN 0 ELSE x * 1000000 // qty END AS ratio, CASE WHEN disc = 0 THEN 0 ELSE x * tax // disc END AS mul_div, x * qty // 1000000 AS times,
CASE WHEN tax = 0 THEN 0 ELSE x * qty // tax END AS wide, (price // (CAST(1 AS BIGINT) << (qty // 365))) - (price // (CAST(1 AS BIGINT) << (qty // 365))) * (qty % 365) // 730 AS halved,
CASE WHEN x < 0 THEN '-' ELSE '' END || CAST(abs(x) // 1000000 AS VARCHAR) || '.' || lpad(CAST(abs(x) % 1000000 AS VARCHAR), 6, '0') AS shown FROM s""",
    "h3_valid": f"WITH {_CELLS} SELECT p_partkey, cell, valid, CAST(r AS INTEGER) AS resolution, pentagon FROM cells",
    "h3_parent": f"WITH {_CELLS}, v AS (SELECT *, p_size % 12 AS lv FROM cells WHERE valid) SELECT p_partkey, format('{{:x}}', cell) AS cell, CASE WHEN lv <= r THEN format('{{:x}}', {_PARENT.format('lv')}) END AS parent, lv <= r AS inside FROM v",
    "h3_parse": f"WITH {_CELLS} SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN upper(format('{{:x}}', cell)) WHEN 1 THEN '0' || format('{{:x}}', cell) ELSE format('{{:x}}', cell) END AS spelling, CASE WHEN p_partkey % 5 > 1 OR (p_partkey % 5 = 0 AND NOT regexp_matches(format('{{:x}}', cell), '[a-f]')) THEN cell END AS cell FROM cells",
    "h3_contains": f"WITH {_CELLS}, v AS (SELECT * FROM cells WHERE valid), a AS (SELECT p_partkey AS area, cell AS big, r AS lv FROM v WHERE r <= 2) SELECT p_partkey AS cid, area FROM v JOIN a ON lv <= r AND {_PARENT.format('lv')} = big",
    "version_satisfies": f"""WITH v AS (SELECT p_partkey, {_HAVE} AS version, CASE WHEN p_partkey % 7 = 0 THEN '' WHEN p_partkey % 3 = 0 THEN '^' || ({_BASE}) WHEN p_partkey % 3 = 1 THEN ({_BASE}) || '+' ELSE {_BASE} END AS requires FROM part),
n AS (SELECT *, list_transform(string_split(version, '.'), lambda x: CAST(x AS INT)) AS h, list_transform(string_split(trim(requires, '^+'), '.'), lambda x: TRY_CAST(x AS INT)) AS q FROM v),
f AS (SELECT *, coalesce(list_position(list_transform(q, lambda x: x <> 0), TRUE), len(q)) AS fx FROM n)
SELECT p_partkey, version, requires, CASE WHEN requires = '' THEN TRUE WHEN starts_with(requires, '^') THEN len(list_filter(range(1, CAST(fx AS INT) + 1), lambda i: coalesce(h[i], 0) <> q[i])) = 0 AND h >= q
WHEN ends_with(requires, '+') THEN h >= q ELSE version = requires OR starts_with(version, requires || '.') END AS satisfied FROM f""",
    "sentence_count": f"SELECT conv_id, turn, CAST({_NS} AS INTEGER) AS sentences FROM conversations",
    "quantity_count": f"SELECT doc_id, CAST({_NQ} AS INTEGER) AS quantities FROM documents",
    "lint_findings": f"""WITH d AS (SELECT doc_id, text, {_NS} AS ns, {_NQ} AS nq, {_OPEN} AS op, {_BACK} AS bk,
CASE WHEN contains(lower(text), ' and ') THEN 'and' WHEN contains(lower(text), ' but ') THEN 'but' WHEN contains(lower(text), ' whereas ') THEN 'whereas' WHEN {_WHILE} THEN 'while' END AS co FROM documents WHERE regexp_matches(text, '\\S'))
SELECT doc_id, 'size' AS test, strlen(text) || ' bytes' AS detail FROM d WHERE strlen(text) > 4096 UNION ALL SELECT doc_id, 'single-assertion', co FROM d WHERE co IS NOT NULL
UNION ALL SELECT doc_id, 'single-assertion', ns || ' sentences' FROM d WHERE ns > 1 UNION ALL SELECT doc_id, 'single-quantity', CAST(nq AS INT) || ' quantities' FROM d WHERE nq > 1
UNION ALL SELECT doc_id, 'dangling-anaphora', op FROM d WHERE op IS NOT NULL UNION ALL SELECT doc_id, 'dangling-anaphora', bk FROM d WHERE bk IS NOT NULL
UNION ALL SELECT doc_id, 'non-empty', 'content is empty' FROM documents WHERE NOT regexp_matches(text, '\\S')""",
    "term_mentions": f"SELECT doc_id, {', '.join(_mention_sql(w) for w in ('the', 'her', 'of', 'ion'))} FROM documents",
    "segments": """WITH n AS (SELECT *, p_name || ' / ' || p_brand || ' / ' || p_type AS name FROM part), l AS (SELECT *, repeat(name, 4) AS long FROM n)
SELECT p_partkey, trim(regexp_replace(lower(name), '[^\\p{L}\\p{N}]+', '_', 'g'), '_') AS segment, trim(lower(p_name)) AS term, CASE WHEN length(long) <= 60 THEN long ELSE regexp_replace(substr(long, 1, 60), '\\s+\\S*$', '') || '…' END AS label,
regexp_matches('abc-' || substr(p_type, 1, 6) || '-' || lpad(CAST(p_size % 20 AS VARCHAR), 2, '0') || '-2024', '^[a-z]{3,6}-[a-z]{6}-(0[1-9]|1[0-2])-[0-9]{4}$') AS tag, regexp_matches(replace(p_name, ' ', '-'), '^[a-z0-9]+(-[a-z0-9]+)*$') AS slug FROM l""",
    "epochs": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || 'T12:34:56' || CASE WHEN o_orderkey % 4 > 0 THEN 'Z' ELSE '+02' END AS instant, CASE WHEN o_orderkey % 4 > 0 THEN CAST(epoch(date_trunc('day', o_orderdate)) AS BIGINT) + 45296 END AS epoch FROM orders",
    "period_overlap": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') <= '1997-01' AND '1996-06' <= CASE WHEN o_custkey % 5 > 0 THEN strftime(o_orderdate + to_months(CAST(o_custkey % 7 AS INT)), '%Y-%m') ELSE '~' END AS meets FROM orders",
    "kind_classes": f"WITH k AS (SELECT event_id, {_pick_sql(_KINDS, 'event_id')} AS kind FROM events) SELECT event_id, kind, {_KIND_CASE} AS class, kind IN ('supersedes', 'implements', 'depends', 'derived-from') AS acyclic FROM k",
    "verdict_faults": f"""WITH k AS (SELECT event_id, {_pick_sql(list(CLAIM_CLASSES), 'event_id')} AS class, event_type = 'view' AS prov FROM events)
SELECT event_id, class, CASE WHEN class IN ('definitional', 'normative', 'expressive', 'performative') THEN 'class takes no verdict' WHEN class IN ('attributive', 'archival') AND NOT prov THEN 'verdict must be on provenance' END AS fault, class IN ('formal', 'empirical', 'definitional', 'normative') AS assertion FROM k""",
    "quantity_cells": "SELECT l_linenumber AS row, 'parameters differ' AS rule, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1 UNION ALL SELECT l_linenumber, 'not a decimal', count(*) FROM lineitem WHERE l_linenumber = 3 GROUP BY 1",
    "table_faults": "SELECT p_partkey AS cid, 'column without a name' AS rule FROM part WHERE p_size % 7 = 0 UNION ALL SELECT p_partkey, 'column named twice' FROM part WHERE p_size % 5 = 0 UNION ALL SELECT p_partkey, 'row of another width' FROM part WHERE p_size % 11 = 0",
    "unit_faults": f"""WITH c AS (SELECT p_partkey AS cid, ([ 'length:1', 'length:1', 'mass:1', 'length:1 time:-1', 'length:2 mass:1 time:-2', 'length:2 mass:1 time:-2', NULL, 'length:2'])[CAST(p_partkey % 8 AS INT) + 1] AS dim, ([ 'length:1', 'length:2 mass:1 time:-2', 'length:2', NULL])[CAST(p_size % 4 AS INT) + 1] AS want FROM part),
r AS (SELECT cid, CASE WHEN dim IS NULL THEN 'unit unchecked' WHEN want IS NULL THEN 'kind not held' WHEN dim <> want THEN 'unit doesn''t measure kind' END AS rule FROM c) SELECT cid, rule, rule LIKE '%measure%' AS rejects FROM r WHERE rule IS NOT NULL""",
    "class_paths": """WITH con(code, seg) AS (VALUES ('1', 'one'), ('12', 'twelve'), ('13', 'thirteen'), ('2', 'two'), ('21', 'twenty_one'), ('21', 'score_and_one'), ('3', 'three')), p AS (SELECT p_partkey AS cid, regexp_extract(p_brand, '[0-9]+') AS code FROM part),
m AS (SELECT cid, con.code, count(*) AS n, min(seg) AS seg FROM p JOIN con ON starts_with(p.code, con.code) GROUP BY 1, 2), g AS (SELECT cid, max(n) AS n, string_agg(seg, '.' ORDER BY length(code)) AS path FROM m GROUP BY cid)
SELECT p.cid, CASE WHEN n = 1 THEN path END AS path, CASE WHEN n IS NULL THEN 'no-class' WHEN n > 1 THEN 'contested' END AS fault FROM p LEFT JOIN g ON g.cid = p.cid""",
    "singular_chains": f"WITH RECURSIVE {_SING} SELECT cid, whole, CAST(depth AS INTEGER) AS depth FROM ch",
    "singular_paths": f"""WITH RECURSIVE {_SING}, con(code, seg) AS (VALUES ('E', 'economy'), ('S', 'standard'), ('P', 'promo'), ('L', 'large')), nm AS (SELECT ch.cid, string_agg(s.segment, '.' ORDER BY depth DESC) AS names, arg_max(s.code, depth) AS code FROM ch JOIN s ON s.cid = ch.whole GROUP BY ch.cid)
SELECT cid, seg || '.' || names AS path, CASE WHEN seg IS NULL THEN 'no-class' END AS fault FROM nm LEFT JOIN con ON con.code = nm.code""",
    "fact_lookup": """WITH ln AS (SELECT DISTINCT l_orderkey AS cid, l_linenumber, l_suppkey, l_partkey AS p, CAST(CAST(l_quantity AS INT) AS BIGINT) AS q, CAST(round(l_tax * 100) AS BIGINT) AS t FROM lineitem)
SELECT CAST(p AS VARCHAR) AS singular, segment, count(*) AS facts, CAST(sum(v) AS BIGINT) AS total FROM (SELECT p, 'quantity' AS segment, q AS v FROM ln UNION ALL SELECT p, 'tax', t FROM ln WHERE cid % 12 <> 0) GROUP BY 1, 2""",
    "fact_status": """SELECT l_returnflag, l_linenumber, CASE WHEN l_discount <= 0.02 THEN 'to-verify' WHEN l_tax > 0.06 THEN 'to-verify' WHEN l_returnflag = 'N' AND l_linenumber % 2 = 0 THEN 'confirmed' WHEN l_returnflag = 'N' THEN 'to-verify' ELSE 'estimate' END AS status, count(*) AS n FROM lineitem GROUP BY 1, 2, 3""",
    "tags_distinct": "SELECT user_id AS target, string_agg(k, ',' ORDER BY k) AS tags FROM (SELECT DISTINCT user_id, json_extract_string(props, '$.k') AS k FROM events WHERE event_type <> 'error') GROUP BY 1",
    "usage_locators": "SELECT DISTINCT user_id AS target, event_type AS source, CASE WHEN value > 10 THEN props ELSE '' END AS locator FROM events WHERE event_type <> 'error'",
    "classification": "WITH e AS (SELECT DISTINCT user_id AS s, event_id % 30 AS d FROM events WHERE event_type = 'click') SELECT s AS cid, 'subjects' AS side, string_agg(d, ',' ORDER BY d) AS others FROM e GROUP BY 1 UNION ALL SELECT d, 'classified', string_agg(s, ',' ORDER BY s) FROM e GROUP BY 1",
    "by_human": "SELECT o_orderkey AS cid, coalesce(c_mktsegment <> 'MACHINERY', FALSE) AS human FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 9 > 0",
    "active_renderings": "SELECT doc, created, cid FROM (SELECT o_custkey AS doc, strftime(o_orderdate, '%Y-%m') AS created, o_orderkey AS cid, row_number() OVER (PARTITION BY o_custkey ORDER BY strftime(o_orderdate, '%Y-%m') DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1",
    "object_listing": "SELECT doc_id AS cid, lang AS kind, source AS author, 'doc' AS class FROM documents WHERE lang = 'en' AND source = 'src0'",
    "open_annotations": "SELECT user_id AS target, count(*) AS open FROM events WHERE (event_type = 'view' AND event_id % 6 >= 3) OR (event_type = 'click' AND event_id % 2 = 0) OR (event_type = 'error' AND event_id % 4 <> 0) GROUP BY 1",
}
