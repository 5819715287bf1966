"""Definitions, calculations and views: fields of object bodies read as typed rows, each with the first fault found.

Bodies are JSON text; VARIANT keeps the type of every value apart from its text, so the checks stay in the JVM. A fault
is the path of the field at fault; a row without one can be used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import h3
from ..functions.text import is_cid, is_decimal

#: What a measure describes, and the types of its parameters.
DESCRIBES = ("exact", "variation", "uncertainty")
PARAMETER_TYPES = ("quantity", "fraction", "count", "blob")

_CITED = "array<struct<field:string,cid:string>>"


def _at(value: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, f"$.{path}", kind)


def _shape(value: Column) -> Column:
    """STRING, BIGINT, VOID, OBJECT<...>, ARRAY<...>; null where nothing is."""
    return F.schema_of_variant(value)


def _is(value: Column, shape: str) -> Column:
    return F.coalesce(F.startswith(_shape(value), F.lit(shape)), F.lit(False))


def _as_text(value: Column) -> Column:
    return F.when(_shape(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _text(value: Column, path: str) -> Column:
    """The text at a path; null if what is there isn't a text, or is empty."""
    return F.nullif(_as_text(_at(value, path)), F.lit(""))


def _list(value: Column, path: str) -> Column:
    """The array at a path as array<variant>; null if there is none."""
    return F.when(_is(_at(value, path), "ARRAY<"), _at(value, path, "array<variant>"))


def _entries(value: Column, path: str) -> Column:
    """The map at a path as entries (key, value); null if there is none."""
    return F.when(_is(_at(value, path), "OBJECT<"), F.map_entries(_at(value, path, "map<string,variant>")))


def _cid_at(value: Column, path: str) -> Column:
    found = _text(value, path)
    return F.when(is_cid(found), found)


def _is_role(name: Column) -> Column:
    return F.coalesce(name.rlike(r"^[A-Za-z_][A-Za-z0-9_]*\z"), F.lit(False))


def _whole(value: Column) -> Column:
    return F.coalesce(_shape(value) == "BIGINT", F.lit(False))


def _nonzero(decimal: Column) -> Column:
    return F.coalesce(is_decimal(decimal) & decimal.rlike("[1-9]"), F.lit(False))


def _first(*rules: tuple[Column, str]) -> Column:
    """The label of the first condition that holds."""
    return F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(label)) for c, label in rules])


def _twice(names: Column) -> Column:
    return F.size(F.array_distinct(names)) < F.size(names)


def _present(value: Column, path: str) -> Column:
    return _at(value, path).isNotNull()


def _symbol_fault(d: Column) -> Column:
    """A symbol is one pair of braces or brackets around something that holds neither."""
    return _first((~F.coalesce(_text(d, "symbol").rlike(r"^(\{[^{}\[\]]+\}|\[[^{}\[\]]+\])\z"), F.lit(False)), "defines.symbol"))


def _kind_fault(d: Column) -> Column:
    powers, units = _entries(d, "dimension"), _list(d, "units")
    return _first(
        (_text(d, "name").isNull(), "defines.name"),
        (powers.isNull() | F.exists(powers, lambda e: (e["key"] == "") | ~_whole(e["value"])), "defines.dimension"),
        (_present(d, "units") & (units.isNull() | (F.size(units) == 0) | F.exists(units, lambda u: F.nullif(_as_text(u), F.lit("")).isNull())), "defines.units"),
    )


def _measure_fault(d: Column) -> Column:
    given = _list(d, "parameters")
    return _first(
        (_text(d, "name").isNull(), "defines.name"),
        (~F.coalesce(_text(d, "describes").isin(*DESCRIBES), F.lit(False)), "defines.describes"),
        (given.isNull() | (F.size(given) == 0), "defines.parameters"),
        (F.exists(given, lambda p: _text(p, "name").isNull()) | _twice(F.transform(given, lambda p: _text(p, "name"))), "defines.parameters.name"),
        (F.exists(given, lambda p: ~F.coalesce(_text(p, "type").isin(*PARAMETER_TYPES), F.lit(False))), "defines.parameters.type"),
        (F.exists(given, lambda p: _text(p, "meaning").isNull()), "defines.parameters.meaning"),
    )


def _relation_fault(d: Column) -> Column:
    slots = _list(d, "relation.slots")
    roles = F.transform(slots, lambda s: _text(s, "role"))
    product = _entries(d, "relation.form.product.exponents")
    exponent = lambda v: F.when(_whole(v), F.try_variant_get(v, "$", "string")).otherwise(_as_text(v))
    unlike = F.array_sort(F.transform(product, lambda e: e["key"])) != F.array_sort(roles)
    explicit = F.coalesce(_text(d, "relation.form") == "explicit", F.lit(False))
    formless = ~explicit & ~_is(_at(d, "relation.form.product"), "OBJECT<")
    field = "defines.relation.form.product"
    return _first(
        (~_is(_at(d, "relation"), "OBJECT<"), "defines.relation"),
        (slots.isNull(), "defines.relation.slots"),
        (F.exists(roles, lambda r: ~_is_role(r)) | _twice(roles), "defines.relation.slots.role"),
        (F.exists(slots, lambda s: _present(s, "concept") == _present(s, "kind")), "defines.relation.slots"),
        (F.exists(slots, lambda s: _present(s, "concept") & _text(s, "concept").isNull()), "defines.relation.slots.concept"),
        (F.exists(slots, lambda s: _present(s, "kind") & _cid_at(s, "kind").isNull()), "defines.relation.slots.kind"),
        (F.size(slots) < 2, "defines.relation.slots"),
        (formless, "defines.relation.form"),
        (~explicit & (~_nonzero(_text(d, "relation.form.product.coefficient")) | product.isNull()), field),
        (~explicit & (F.exists(product, lambda e: ~_nonzero(exponent(e["value"]))) | unlike), field),
        (_text(d, "relation.statement").isNull(), "defines.relation.statement"),
    )


def _concept_fault(d: Column) -> Column:
    lines = lambda path: _list(d, f"boundary.{path}")
    bad = lambda path: lines(path).isNull() | F.exists(lines(path), lambda x: F.nullif(_as_text(x), F.lit("")).isNull())
    kind, relation, bounds = _present(d, "kind"), _present(d, "relation"), _present(d, "boundary")
    return F.coalesce(
        _first((_text(d, "pdc").isNull(), "defines.pdc"), (_text(d, "name").isNull(), "defines.name"), (bounds & (bad("includes") | bad("excludes")), "defines.boundary"), (kind & relation, "defines"), (kind & _cid_at(d, "kind").isNull(), "defines.kind")),
        F.when(relation, _relation_fault(d)),
        _first((kind & ~bounds, "defines.boundary")),
    )


def _singular_fault(d: Column) -> Column:
    place, cell = _entries(d, "location"), _text(d, "location.h3")
    return _first(
        (_text(d, "name").isNull(), "defines.name"),
        (_text(d, "class").isNull(), "defines.class"),
        (_present(d, "part_of") & _cid_at(d, "part_of").isNull(), "defines.part_of"),
        (_present(d, "location") & (place.isNull() | F.exists(place, lambda e: e["key"] != "h3")), "defines.location"),
        (_present(d, "location") & ~F.coalesce(h3.is_valid(h3.parse(cell)), F.lit(False)), "defines.location.h3"),
    )


def definition_fault(d: Column) -> Column:
    """The first field at fault of a `defines` value; null if it is sound."""
    sort = _as_text(_at(d, "sort"))
    by_sort = (
        F.when(sort == "system", _first((_text(d, "name").isNull(), "defines.name"), (_text(d, "version").isNull(), "defines.version")))
        .when(sort == "dimension", _symbol_fault(d))
        .when(sort == "unit", F.coalesce(_first((~F.coalesce(is_decimal(_text(d, "value")), F.lit(False)), "defines.value")), _symbol_fault(d), _first((_text(d, "unit").isNull(), "defines.unit"))))
        .when(sort == "kind", _kind_fault(d))
        .when(sort == "measure", _measure_fault(d))
        .when(sort == "concept", _concept_fault(d))
        .when(sort == "singular", _singular_fault(d))
        .otherwise(F.lit("defines.sort"))
    )
    return F.when(~_is(d, "OBJECT<"), F.lit("defines")).otherwise(by_sort)


def _cited(d: Column) -> Column:
    """The claims that a definition names, each with the field that names it."""
    entry = lambda field, cid: F.struct(F.lit(field).alias("field"), cid.alias("cid"))
    slots = F.transform(_list(d, "relation.slots"), lambda s: entry("defines.relation.slots.kind", _cid_at(s, "kind")))
    sort = _as_text(_at(d, "sort"))
    every = F.when((sort == "concept") & _present(d, "kind"), F.array(entry("defines.kind", _cid_at(d, "kind")))).when(sort == "concept", slots).when(sort == "singular", F.array(entry("defines.part_of", _cid_at(d, "part_of"))))
    return F.coalesce(F.filter(every, lambda e: e["cid"].isNotNull()), F.array().cast(_CITED))


def definitions(objects: DataFrame) -> DataFrame:
    """(cid, sort, term, cited, fault) of the claims that define something; a faulty one cites nothing and has no term."""
    d = F.col("defines")
    of = objects.filter("kind = 'claim.prose'").select("cid", F.try_variant_get(F.try_parse_json("body"), "$.defines", "variant").alias("defines")).filter("defines IS NOT NULL")
    term = F.coalesce(F.when(_as_text(_at(d, "sort")).isin("dimension", "unit"), _text(d, "symbol")), F.when(_as_text(_at(d, "sort")) == "concept", _text(d, "pdc")), _text(d, "name"))
    read = of.select("cid", _as_text(_at(d, "sort")).alias("sort"), term.alias("term"), _cited(d).alias("cited"), definition_fault(d).alias("fault"))
    good = F.col("fault").isNull()
    return read.select("cid", "sort", F.when(good, F.col("term")).alias("term"), F.when(good, F.col("cited")).otherwise(F.array().cast(_CITED)).alias("cited"), "fault")


def undeclared(found: DataFrame, depends: DataFrame) -> DataFrame:
    """(cid, field, cited): claims that definitions or calculations name without resting on them, from depends(cid, dep)."""
    named = found.select("cid", F.explode("cited").alias("c")).select("cid", "c.field", F.col("c.cid").alias("cited"))
    return named.join(depends.select("cid", F.col("dep").alias("cited")).distinct(), ["cid", "cited"], "left_anti").select("cid", "field", "cited")


def _signature_fault(c: Column, side: str) -> Column:
    items = _list(c, side)
    bad = items.isNull() | F.exists(items, lambda i: _text(i, "name").isNull() | _cid_at(i, "kind").isNull()) | _twice(F.transform(items, lambda i: _text(i, "name")))
    return _first((_present(c, side) & bad, f"computes.{side}"))


def _solves_roles(c: Column) -> Column:
    """The target, then required roles, then optional ones."""
    none = F.array().cast("array<string>")
    required = F.coalesce(F.transform(_list(c, "solves.requires"), _as_text), none)
    optional = F.coalesce(F.transform(_list(c, "solves.optional"), lambda o: _text(o, "role")), none)
    return F.concat(F.array(_text(c, "solves.target")), required, optional)


def _solves_fault(c: Column) -> Column:
    required, optional = _list(c, "solves.requires"), _list(c, "solves.optional")
    return _first(
        (~_is(_at(c, "solves"), "OBJECT<"), "computes.solves"),
        (~_is_role(_text(c, "solves.target")), "computes.solves.target"),
        (_present(c, "solves.requires") & (required.isNull() | F.exists(required, lambda r: ~_is_role(_as_text(r)))), "computes.solves.requires"),
        (_present(c, "solves.optional") & optional.isNull(), "computes.solves.optional"),
        (F.exists(optional, lambda o: ~_is_role(_text(o, "role"))), "computes.solves.optional.role"),
        (F.exists(optional, lambda o: _cid_at(o, "default").isNull()), "computes.solves.optional.default"),
        (_twice(_solves_roles(c)), "computes.solves"),
        (_text(c, "solves.concept").isNull(), "computes.solves.concept"),
    )


def calculations(objects: DataFrame) -> DataFrame:
    """(cid, inputs, outputs, concept, roles, defaults, rounding, seed, cited, fault) of the claims that compute something.

    inputs and outputs: (name, kind) in order. roles: the target first. `cited` holds the kinds, inputs first, then the
    defaults of optional inputs. A faulty one cites nothing and has no roles.
    """
    c = F.col("computes")
    of = objects.filter("kind = 'claim.prose'").select("cid", F.try_variant_get(F.try_parse_json("body"), "$.computes", "variant").alias("computes")).filter("computes IS NOT NULL")
    seed = _at(c, "seed", "decimal(20,0)")
    unsigned = _shape(_at(c, "seed")).rlike(r"^(BIGINT|DECIMAL\([0-9]+,0\))$") & seed.between(0, F.lit("18446744073709551615").cast("decimal(20,0)"))
    fault = F.coalesce(
        _first((~_is(c, "OBJECT<"), "computes")),
        _signature_fault(c, "inputs"),
        _signature_fault(c, "outputs"),
        F.when(_present(c, "solves"), _solves_fault(c)),
        _first((_present(c, "rounding") & (_shape(_at(c, "rounding")) != "STRING"), "computes.rounding"), (_present(c, "seed") & ~F.coalesce(unsigned, F.lit(False)), "computes.seed")),
    )
    pairs = lambda side: F.coalesce(F.transform(_list(c, side), lambda i: F.struct(_text(i, "name").alias("name"), _cid_at(i, "kind").alias("kind"))), F.array().cast("array<struct<name:string,kind:string>>"))
    defaults = F.coalesce(F.transform(_list(c, "solves.optional"), lambda o: _cid_at(o, "default")), F.array().cast("array<string>"))
    read = of.select("cid", pairs("inputs").alias("inputs"), pairs("outputs").alias("outputs"), _text(c, "solves.concept").alias("concept"), F.when(_present(c, "solves"), _solves_roles(c)).alias("roles"), defaults.alias("defaults"), _as_text(_at(c, "rounding")).alias("rounding"), seed.alias("seed"), fault.alias("fault"))
    entry = lambda field: lambda cid: F.struct(F.lit(field).alias("field"), cid.alias("cid"))
    kinds = F.concat(F.transform("inputs", lambda i: entry("computes.inputs")(i["kind"])), F.transform("outputs", lambda o: entry("computes.outputs")(o["kind"])))
    cited = F.concat(kinds, F.transform("defaults", entry("computes.solves.optional.default")))
    good = F.col("fault").isNull()
    return read.select("cid", "inputs", "outputs", "concept", F.when(good, F.col("roles")).alias("roles"), "defaults", "rounding", "seed", F.when(good, cited).otherwise(F.array().cast(_CITED)).alias("cited"), "fault")


def views(objects: DataFrame) -> DataFrame:
    """(doc, pos, renderer, options, fault): the views of documents' items, sections flattened; options as JSON, {} if absent."""
    sections = F.from_json(F.get_json_object("body", "$.sections"), "array<struct<items:array<struct<view:variant>>>>")
    of = objects.filter("kind = 'doc'").select(F.col("cid").alias("doc"), F.posexplode(F.flatten(F.transform(sections, lambda s: s["items"]))).alias("pos", "item"))
    v = F.col("item.view")
    options = F.when(_is(_at(v, "options"), "OBJECT<"), F.to_json(_at(v, "options"))).when(~_present(v, "options"), F.lit("{}"))
    fault = _first((_text(v, "renderer").isNull(), "items.view.renderer"), (options.isNull(), "items.view.options"))
    return of.filter("item.view IS NOT NULL").select("doc", "pos", _text(v, "renderer").alias("renderer"), options.alias("options"), fault.alias("fault"))
