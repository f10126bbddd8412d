"""The contract as columns (VAL-01..17, FLT-12..14, FN-20, JON-12..14): no candidate leaves the JVM.

Structure is compiled from the description in ``contract`` to predicates over VARIANT, in which an absent
field and a null one differ (T9).  Where it holds, the document is read with its types and
what it means is checked by higher-order functions.  Both give arrays of (rule, path, message), so a
row is checked where it lies and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_words
from . import contract
from .candidate import CANDIDATE_DDL

_PROBLEMS = "array<struct<rule_id: string, path: string, message: string>>"


def _none() -> Column:
    return F.array().cast(_PROBLEMS)


def _one(rule: str, at: Column, message: str | Column) -> Column:
    return F.array(F.struct(F.lit(rule).alias("rule_id"), at.alias("path"), (F.lit(message) if isinstance(message, str) else message).alias("message")))


def _only(test: Column, rule: str, at: Column, message: str | Column) -> Column:
    return F.when(test, _one(rule, at, message)).otherwise(_none())


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _told(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("null")) for p in parts])


def _each(items: Column, use: Callable[[Column, Column], Column]) -> Column:
    """Problems of all items of an array, which may be null; ``use`` gets the item and its place as text."""
    return F.coalesce(F.flatten(F.transform(items, lambda x, i: use(x, i.cast("string")))), _none())


# --- structure
#
# Written as SQL text, which Spark parses once: the description has some thousand nodes.


def _lit(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: While structure is checked a problem may also be a node that waits for its turn, in ``v``.
_NO_PROBLEM = "cast(array() as array<struct<rule_id: string, path: string, message: string, v: variant>>)"
_NULL = "parse_json('null')"
#: Descriptions that stand in many places.  Their nodes are gathered and checked together, outer ones first, so each is compiled once.
_GATHERED = [[contract.LINK, contract.SUPPORTED, contract.QUANTITY, contract.CADENCE, contract.MONEY], [contract.SUPPORT]]


class _Structure:
    """SQL for the problems of a VARIANT that is there, by the description that a check carries."""

    def __init__(self):
        self.names = 0

    def name(self) -> str:
        self.names += 1
        return f"x{self.names}"

    @staticmethod
    def one(rule: str, at: str, message: str) -> str:
        return f"array(named_struct('rule_id', '{rule}', 'path', {at}, 'message', {message}, 'v', cast(null as variant)))"

    def only(self, test: str, rule: str, at: str, message: str) -> str:
        return f"if({test}, {self.one(rule, at, _lit(message))}, {_NO_PROBLEM})"

    def let(self, value: str, use: Callable[[str], str]) -> str:
        x = self.name()
        return f"element_at(transform(array({value}), {x} -> {use(x)}), 1)"

    @staticmethod
    def string(v: str) -> str:
        return f"if(schema_of_variant({v}) = 'STRING', try_variant_get({v}, '$', 'string'), null)"

    @staticmethod
    def of(m: str, field: str) -> str:
        return f"coalesce(try_element_at({m}, '{field}'), {_NULL})"

    def check(self, check, v: str, at: str, now: bool = False) -> str:
        for k, together in enumerate(_GATHERED):
            if check in together and not now:
                return f"array(named_struct('rule_id', '?{k}.{together.index(check)}', 'path', {at}, 'message', cast(null as string), 'v', {v}))"
        what, *args = check.told
        return getattr(self, f"of_{what}")(v, at, *args)

    def of_text(self, v, at, least, most):
        n = f"length(try_variant_get({v}, '$', 'string'))"
        return f"case when schema_of_variant({v}) <> 'STRING' then {self.one('VAL-01', at, _lit('must be a string'))} when {n} < {least} or {n} > {most} then {self.one('VAL-01', at, _lit(f'must have {least} to {most} characters'))} else {_NO_PROBLEM} end"

    def of_match(self, v, at, pattern, most):
        told = pattern.replace(r"\Z", r"\z").replace(r"[^\s]", r"[^\s\p{Z}\x1c-\x1f\x85]")
        ok = lambda t: f"coalesce({t} rlike {_lit(told)}" + (f" and length({t}) <= {most}" if most < 1 << 30 else "") + ", false)"
        return self.only(f"not {self.let(self.string(v), ok)}", "VAL-01", at, f"must match {pattern}")

    def of_choice(self, v, at, names):
        return self.only(f"not coalesce({self.string(v)} in ({', '.join(map(_lit, names))}), false)", "VAL-01", at, f"must be one of {', '.join(names)}")

    def of_number(self, v, at, least, most, above, whole):
        x = f"if(schema_of_variant({v}) rlike '^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$', try_variant_get({v}, '$', 'double'), null)"

        def told(x: str) -> str:
            wrong = f"{x} is null" + (f" or {x} <> floor({x})" if whole else "")
            out = f"{x} {'<=' if above else '<'} {least}" + (f" or {x} > {most}" if most < float("inf") else "")
            low = f"must be {'above' if above else 'at least'} {least:g}"
            return f"case when {wrong} then {self.one('VAL-01', at, _lit('must be a number'))} when {out} then {self.one('VAL-01', at, _lit(low))} else {_NO_PROBLEM} end"

        return self.let(x, told)

    def of_flag(self, v, at, or_null):
        return self.only(f"not (schema_of_variant({v}) = 'BOOLEAN'{f' or is_variant_null({v})' if or_null else ''})", "VAL-01", at, "must be a boolean")

    def of_or_null(self, v, at, inner):
        return f"if(is_variant_null({v}), {_NO_PROBLEM}, {self.check(inner, v, at)})"

    def of_many(self, v, at, inner, least, distinct):
        def items(a: str) -> str:
            x, i = self.name(), self.name()
            found = [f"flatten(transform(transform({a}, {x} -> coalesce({x}, {_NULL})), ({x}, {i}) -> {self.check(inner, x, f'concat({at}, "/", cast({i} as string))')}))"]
            if least:
                found.append(self.only(f"size({a}) < {least}", "VAL-01", at, f"must have at least {least} items"))
            if distinct:
                found.append(self.only(f"size(array_distinct(transform({a}, {x} -> to_json({x})))) < size({a})", "VAL-01", at, "must have distinct items"))
            return f"if({a} is null, {self.one('VAL-01', at, _lit('must be an array'))}, concat({', '.join(found)}))"

        return self.let(f"try_variant_get({v}, '$', 'array<variant>')", items)

    def of_record(self, v, at, required, optional, more):
        def fields(m: str) -> str:
            known, k = required | optional, self.name()
            other = f"transform(filter(map_keys({m}), {k} -> {k} not in ({', '.join(map(_lit, known))})), {k} -> named_struct('rule_id', 'VAL-01', 'path', {at}, 'message', concat('must not have ', {k}), 'v', cast(null as variant)))"
            found = [other]
            for name, inner in known.items():
                missing = self.one("VAL-01", at, _lit(f"must have {name}")) if name in required else _NO_PROBLEM
                there = self.let(self.of(m, name), lambda x, inner=inner, name=name: self.check(inner, x, f"concat({at}, '/{name}')"))
                found.append(f"if(map_contains_key({m}, '{name}'), {there}, {missing})")
            if more:
                found.append(getattr(self, f"more{more.__name__}")(m, at))
            return f"if({m} is null, {self.one('VAL-01', at, _lit('must be an object'))}, concat({', '.join(found)}))"

        return self.let(f"try_variant_get({v}, '$', 'map<string,variant>')", fields)

    def of_tagged(self, v, at, by, kinds):
        wrong = self.one("VAL-01", at, _lit(f"{by} must be one of {', '.join(kinds)}"))
        cases = lambda kind: "case " + " ".join(f"when {kind} = '{name}' then {self.check(inner, v, at)}" for name, inner in kinds.items()) + f" else {wrong} end"
        field = self.of(f"try_variant_get({v}, '$', 'map<string,variant>')", by)
        return self.let(self.string(field), cases)

    def more_quantity_rule(self, m, at):
        has, opened = f"map_contains_key({m}, 'value')", f"coalesce({self.string(self.of(m, 'comparator'))} in ('unlimited', 'unknown'), false)"
        return f"concat({self.only(f'{opened} and {has}', 'VAL-02', at, 'must not have value')}, {self.only(f'not {opened} and not {has}', 'VAL-02', at, 'must have value')})"

    def more_entitlement_rule(self, m, at):
        has = lambda k: f"map_contains_key({m}, '{k}')"

        def rules(kind: str) -> str:
            is_one = lambda *names: f"coalesce({kind} in ({', '.join(map(_lit, names))}), false)"
            found = [self.only(f"{is_one(*kinds)} and not {has(field)}", "VAL-02", at, f"must have {field}") for field, kinds in contract.NEEDED_BY_KIND.items()]
            found.append(self.only(f"not {is_one('percentage_discount')} and {has('percentage_value')}", "VAL-02", at, "must not have percentage_value"))
            found.append(self.only(f"{is_one('grant')} and not {has('monetary_value')} and not {has('quantity')}", "VAL-02", at, "must have monetary_value or quantity"))
            return f"concat({', '.join(found)})"

        return self.let(self.string(self.of(m, "kind")), rules)

    def more_constraint_rule(self, m, at):
        return self.only(f"coalesce({self.string(self.of(m, 'kind'))} = 'other', false) <> map_contains_key({m}, 'other_kind')", "VAL-03", at, "other_kind goes with kind other only")


def with_structure(df: DataFrame, variant: str, out: str) -> DataFrame:
    """The rows with the structural problems of their candidates; a null VARIANT or one that is no object is a problem itself."""
    build = _Structure()
    whole = build.check(contract.CANDIDATE, variant, "''")
    df = df.withColumn(out, F.expr(f"if(try_variant_get({variant}, '$', 'map<string,variant>') is null, {build.one('VAL-01', _lit('/'), _lit('must be an object'))}, {whole})"))
    for k, together in enumerate(_GATHERED):
        n = build.name()
        found = [f"flatten(transform(filter({out}, {n} -> {n}.rule_id = '?{k}.{j}'), {n} -> {build.check(c, f'{n}.v', f'{n}.path', now=True)}))" for j, c in enumerate(together)]
        df = df.withColumn(out, F.expr(f"concat(filter({out}, {n} -> not startswith({n}.rule_id, '?{k}.')), {', '.join(found)})"))
    return df.withColumn(out, F.expr(f"transform({out}, p -> named_struct('rule_id', p.rule_id, 'path', p.path, 'message', p.message))"))


# --- meaning


def _again(items: Column) -> Column:
    """Items that stand earlier in the array too, once for each repetition."""
    return F.filter(F.transform(items, lambda x, i: F.when(F.array_position(items, x) <= i, x)), lambda x: x.isNotNull())


def _bare(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def _moment(c: Column) -> Column:
    return c.try_cast("timestamp").isNotNull()


def _cited(spans: Column, support: Column) -> Column:
    """The quotes that a support names, as one text; of spans with one id the last."""
    quote = lambda i: F.coalesce(F.try_element_at(F.filter(spans, lambda s: s["id"] == i), F.lit(-1))["quote"], F.lit(""))
    return F.array_join(F.transform(support["evidence_ids"], quote), " ")


def _economics(e: Column) -> Column:
    """FN-20."""
    money = F.coalesce(e["monetary_value"], e["maximum_value"])
    targets = F.array_sort(F.transform(e["applies_to"], lambda a: F.struct(a["target_type"].alias("t"), _bare(a["source_label"]).alias("l"))))
    offer = F.when(money.isNotNull(), F.to_json(F.struct(money["amount"].alias("a"), money["currency"].alias("c")))).otherwise(
        F.to_json(F.struct(e["kind"].alias("k"), _bare(e["label"]).alias("l"), e["quantity"].alias("q"), e["cadence"].alias("c"), e["duration"].alias("d"), e["percentage_value"].alias("p")))
    )
    return F.to_json(F.struct(money.isNull().alias("n"), offer.alias("o"), e["cost_scope"].alias("s"), targets.alias("t")))


def _owners(d: Column) -> Column:
    """(path, support) of everything that cites evidence (JON-12)."""
    p = d["product"]
    pair = lambda at, x: F.struct(at.alias("path"), x["support"].alias("support"))
    single = lambda at, x: F.when(x.isNotNull(), F.array(pair(at, x))).otherwise(F.array().cast("array<struct<path: string, support: struct<basis: string, evidence_ids: array<string>>>>"))
    listed = lambda at, xs: F.transform(xs, lambda x, i: pair(F.concat(at, F.lit("/"), i.cast("string")), x))

    def of(o: Column, n: Column) -> Column:
        at = F.concat(F.lit("/opportunities/"), n.cast("string"))
        some = [single(F.concat(at, F.lit(f"/{k}")), o[k]) for k in ("variant_label", "plan_label", "availability", "effective_period")]
        return F.concat(*some, *[listed(F.concat(at, F.lit(f"/{k}")), o[k]) for k in ("entitlements", "constraints", "conditions", "ambiguities", "links")])

    some = [single(F.lit(f"/product/{k}"), p[k]) for k in ("proposed_canonical_name", "description")]
    some += [listed(F.lit(f"/product/{k}"), p[k]) for k in ("organization_roles", "links", "facets", "claimed_outcomes")]
    return F.concat(*some, listed(F.lit("/possible_canonical_matches"), d["possible_canonical_matches"]), F.flatten(F.transform(d["opportunities"], of)))


def meaning(d: Column, source: Column, concepts: dict[str, set[str]], units: set[str]) -> Column:
    """VAL-04 to VAL-17 of a document whose structure holds."""
    p, spans, opportunities = d["product"], d["evidence_spans"], d["opportunities"]
    offer = ascii_words(contract.OFFER_LANGUAGE)
    ids, quotes = spans["id"], spans["quote"]
    known = F.array(*[F.lit(f"{n}/{c}") for n, cs in sorted(concepts.items()) for c in sorted(cs)]).cast("array<string>")
    known_units = F.array(*[F.lit(u) for u in sorted(units)]).cast("array<string>")
    at = lambda text: F.lit(text)
    texts = F.concat(F.when(p["description"].isNotNull(), F.array(p["description"]["text"])).otherwise(F.array().cast("array<string>")), F.coalesce(p["claimed_outcomes"]["text"], F.array().cast("array<string>")))
    quantity = lambda path, xs: _each(xs, lambda x, i: _only(x["quantity"]["normalized_unit"].isNotNull() & ~F.array_contains(known_units, x["quantity"]["normalized_unit"]), "VAL-10", F.concat(path, F.lit("/"), i, F.lit("/quantity")), _told("unknown unit ", x["quantity"]["normalized_unit"])))
    link = lambda path, xs: _each(xs, lambda x, i: _only((x["support"]["basis"] == "explicit") & ~F.contains(_cited(spans, x["support"]), x["url"]), "VAL-17", F.concat(path, F.lit("/"), i), _told("evidence lacks the URL ", x["url"])))
    found = [
        _only(~_moment(d["observed_at"]), "VAL-04", at("/observed_at"), _told("invalid timestamp ", d["observed_at"])),
        _each(_again(ids), lambda x, _: _one("VAL-05", at("/evidence_spans"), _told("duplicate evidence id ", x))),
        _each(_again(quotes), lambda x, _: _one("VAL-05", at("/evidence_spans"), _told("duplicate evidence quote ", x))),
        _each(F.filter(spans, lambda s: F.coalesce(~F.contains(source, s["quote"]), F.lit(False))), lambda s, _: _one("VAL-05", at("/evidence_spans"), _told("quote is no exact part of the source: ", s["id"]))),
        _each(F.filter(texts, lambda t: t.rlike(offer)), lambda t, _: _one("VAL-06", at("/product"), _told("offer language: ", t))),
        _each(F.filter(p["organization_roles"], lambda r: (r["support"]["basis"] == "explicit") & ~F.contains(F.lower(_cited(spans, r["support"])), F.lower(r["organization_name"]))), lambda r, _: _one("VAL-07", at("/product/organization_roles"), _told("evidence does not name ", r["organization_name"]))),
        _each(F.filter(d["possible_canonical_matches"], lambda m: _bare(m["candidate_name"]) == _bare(p["source_name"])), lambda m, _: _one("VAL-08", at("/possible_canonical_matches"), _told("repeats the product itself: ", m["candidate_name"]))),
        _only((F.size(opportunities) > 0) & ~F.exists(p["facets"], lambda f: f["namespace"] == "capability"), "VAL-09", at("/product/facets"), "an opportunity needs a capability facet"),
        _each(_owners(d), lambda o, _: _each(F.array_except(o["support"]["evidence_ids"], ids), lambda i, _: _one("VAL-10", o["path"], _told("dangling evidence ", i)))),
        _each(p["facets"], lambda f, i: _only(~F.array_contains(known, F.concat_ws("/", f["namespace"], f["concept_id"])), "VAL-10", F.concat(F.lit("/product/facets/"), i), _told("unknown concept ", f["namespace"], "/", f["concept_id"]))),
        link(F.lit("/product/links"), p["links"]),
        _each(_again(opportunities["local_key"]), lambda k, _: _one("VAL-11", at("/opportunities"), _told("duplicate opportunity key ", k))),
        _each(opportunities, lambda o, n: _opportunity(o, F.concat(F.lit("/opportunities/"), n), spans, quantity, link)),
    ]
    return F.concat(*found)


def _opportunity(o: Column, at: Column, spans: Column, quantity, link) -> Column:
    period, value = o["effective_period"], o["availability"]["value"]
    lo, hi = period["from"], period["to"]
    audience = F.exists(o["conditions"], lambda x: x["family"] == "audience")
    applies = F.exists(o["conditions"], lambda x: (x["family"] == "boolean_requirement") & (x["kind"] == "application") & x["required"])
    applies = F.coalesce(applies, F.lit(False))
    keys = F.concat(*[o[k]["key"] for k in ("entitlements", "constraints", "conditions", "ambiguities")])
    reserved = F.array(*[F.lit(k) for k in contract.RESERVED])
    duration = ascii_words(contract.STATED_DURATION)
    targets = F.concat(o["entitlements"]["key"], F.array(F.lit("opportunity")))
    lost = lambda xs, allowed: _each(F.filter(xs, lambda x: ~F.array_contains(allowed, x["target_key"])), lambda x, _: _one("VAL-15", at, _told("unknown target of ", x["key"], ": ", x["target_key"])))
    # the entitlement before with the same promise, the latest one
    promise = F.transform(o["entitlements"], lambda e: F.struct(e["key"].alias("key"), e["support"]["evidence_ids"].alias("ids"), _economics(e).alias("f")))

    def repeats(es: Column) -> Column:
        before = lambda e, i: F.try_element_at(F.filter(F.slice(es, 1, i), lambda x: x["f"] == e["f"]), F.lit(-1))
        told = F.transform(es, lambda e, i: F.when(F.arrays_overlap(before(e, i)["ids"], e["ids"]), _told("duplicate economics: ", before(e, i)["key"], " and ", e["key"])))
        return _each(F.filter(told, lambda t: t.isNotNull()), lambda t, _: _one("VAL-16", at, t))

    found = [
        _only(o["local_key"].isin(*contract.RESERVED), "VAL-11", at, _told("reserved opportunity key ", o["local_key"])),
        *(_only((v != "") & ~_moment(v), "VAL-12", at, _told(f"invalid effective_period.{name}: ", v)) for name, v in (("from", lo), ("to", hi))),
        _only((lo != "") & (hi != "") & (hi <= lo), "VAL-12", at, "effective period ends before it starts"),
        _only(period.isNotNull() & (F.coalesce(lo, F.lit("")) == "") & (F.coalesce(hi, F.lit("")) == ""), "VAL-12", at, "an empty effective_period must be left out"),
        _only((value == "public") & (audience | applies), "VAL-13", at, "public availability has gates"),
        _only((value == "eligibility_gated") & ~audience, "VAL-13", at, "eligibility_gated without an audience"),
        _only((value == "application_required") & ~applies, "VAL-13", at, "application_required without an application"),
        _each(F.filter(keys, lambda k: F.array_contains(reserved, k)), lambda k, _: _one("VAL-11", at, _told("reserved record key ", k))),
        _each(_again(keys), lambda k, _: _one("VAL-11", at, _told("duplicate record key ", k))),
        _each(F.filter(o["entitlements"], lambda e: (e["kind"] == "no_cost_access") & (e["quantity"].isNotNull() | e["cadence"].isNotNull())), lambda e, _: _one("VAL-14", at, _told("no_cost_access carries metered usage: ", e["key"]))),
        _each(F.filter(o["entitlements"], lambda e: e["duration"].isNotNull() & ~_cited(spans, e["support"]).rlike(duration)), lambda e, _: _one("VAL-14", at, _told("duration is not evidenced: ", e["key"]))),
        lost(o["constraints"], targets), lost(o["conditions"], targets), lost(o["ambiguities"], F.concat(keys, reserved)),
        _let(promise, repeats),
        *(quantity(F.concat(at, F.lit(f"/{k}")), o[k]) for k in ("entitlements", "constraints")),
        link(F.concat(at, F.lit("/links")), o["links"]),
    ]
    return F.concat(*found)


def validate_candidates(df: DataFrame, key: str, source_text: str, candidate_json: str, concepts: dict[str, set[str]], units: set[str]) -> DataFrame:
    """key, rule_id, path, message for every broken rule of every candidate; JSON that does not parse breaks VAL-01.

    What a document means is looked at only if its structure holds.
    """
    x = df.select(F.col(key).alias("_k"), F.col(source_text).alias("_s"), F.col(candidate_json).alias("_j"), F.try_parse_json(candidate_json).alias("_v"))
    x = with_structure(x, "_v", "_p")
    sound = F.size("_p") == 0
    x = x.withColumn("_d", F.when(sound, F.from_json("_j", CANDIDATE_DDL)))
    means = F.when(sound, meaning(F.col("_d"), F.col("_s"), concepts, units)).otherwise(_none())
    no_text = _only(F.col("_s").isNull(), "VAL-01", F.lit("/source_text"), "must be a string")
    return x.select(F.col("_k").alias(key), F.explode(F.concat(no_text, F.col("_p").cast(_PROBLEMS), means)).alias("q")).select(key, "q.*")
