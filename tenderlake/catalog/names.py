"""Company index and corporate group queries.

Parts give company names with many near spellings; order lines are the wins.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import entities, groups, similar
from ..session import written
from ..sources import star
from .registry import query


def wins(s, d):
    """One winner record per line: name spelled three ways, registration number on some.

    Every 97th part goes under one of four numbers, so these hold unlike names.
    """
    part = star.table(s, d, "part").select("p_partkey", "p_name", F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("full"))
    line = star.table(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    odd = F.col("l_partkey") % 97 == 0
    name = F.when(odd, F.col("p_name")).otherwise(F.col("full"))
    spelled = (
        F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit('SIA "'), name, F.lit('"')))
        .when(F.col("l_linenumber") % 3 == 1, name)
        .otherwise(F.concat(name, F.lit(", AS")))
    )
    anchored = (F.col("l_partkey") % 2 == 0) & (F.col("l_suppkey") % 4 != 0)
    mixed = star.reg_of(F.lit(9700000000) + F.floor(F.col("l_partkey") / 97) % 4)
    reg = F.when(odd, mixed).when(anchored, F.concat(F.lit("LV"), star.reg_of(F.col("l_partkey"))))
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_linenumber").alias("record_key"),
        spelled.alias("winner"),
        reg.alias("winner_reg"),
        (F.col("l_orderkey") * 100000000 + F.col("l_partkey") * 10 + F.col("l_linenumber") % 10).alias("ord"),
    )


_WINS = """wins AS (SELECT CASE l_linenumber % 3 WHEN 0 THEN 'SIA "' || n || '"' WHEN 1 THEN n ELSE n || ', AS' END AS name,
    CASE WHEN l_partkey % 97 = 0 THEN '4' || lpad(CAST(9700000000 + (l_partkey // 97) % 4 AS VARCHAR), 10, '0') WHEN l_partkey % 2 = 0 AND l_suppkey % 4 <> 0
      THEN '4' || lpad(CAST(l_partkey AS VARCHAR), 10, '0') END AS reg,
    l_orderkey || '-' || l_partkey || '-' || l_linenumber AS record_key, l_orderkey * 100000000 + l_partkey * 10 + l_linenumber % 10 AS ord
    FROM (SELECT *, CASE WHEN l_partkey % 97 = 0 THEN p_name ELSE p_name || ' ' || p_type || ' ' || p_brand END AS n
      FROM lineitem JOIN part ON l_partkey = p_partkey))"""


def _ratio(a: str, b: str) -> str:
    """SQL for the match ratio of two sorted texts: the common length by one integer per text, bit by bit."""
    start = f"(CAST(1 AS HUGEINT) << length({a})) - 1"
    spots = f"list_transform(range(length({a})), lambda i: CASE WHEN {a}[i + 1] = ch THEN CAST(1 AS HUGEINT) << CAST(i AS INTEGER) ELSE CAST(0 AS HUGEINT) END)"
    masks = f"list_transform(string_split({b}, ''), lambda ch: CAST(list_sum({spots}) AS HUGEINT))"
    row = f"list_reduce({masks}, lambda r, m: ((r + (r & m)) | (r - (r & m))) & ({start}), {start})"
    return f"200.0 * (length({a}) - bit_count({row})) / (length({a}) + length({b}))"


def _key(name: str) -> str:
    """SQL for the match key of a name of these tables."""
    cut = f"regexp_replace(lower({name}), '\\b(sia|as|ps|ik|zs|ab|vas|psia|pa)\\b', ' ', 'g')"
    return f"trim(regexp_replace({cut}, '[^a-z0-9]+', ' ', 'g'))"


def _sorted(key: str) -> str:
    return f"array_to_string(list_sort(string_split({key}, ' ')), ' ')"


_FOUND = f"""{_WINS}, f AS (SELECT name, reg, min(ord) AS ord FROM wins GROUP BY name, reg),
    fk AS (SELECT reg, {_key("name")} AS key, count(*) AS w FROM f WHERE reg IS NOT NULL GROUP BY ALL),
    fs AS (SELECT reg, key, w, {_sorted("key")} AS x FROM fk WHERE reg IN (SELECT reg FROM fk GROUP BY reg HAVING sum(w) >= {fixed.SUSPECT_NAMES})),
    fa AS (SELECT reg, sum(w * v * ({_ratio("x", "y")})) AS across FROM (SELECT a.reg, a.w, b.w AS v, a.x, b.x AS y
      FROM fs a JOIN fs b ON a.reg = b.reg AND a.key < b.key) GROUP BY reg),
    fm AS (SELECT reg, CAST(sum(w) AS BIGINT) AS names, (coalesce(any_value(across), 0) + sum(w * (w - 1) / 2) * 100.0) / (sum(w) * (sum(w) - 1) / 2) AS mean_score
      FROM fs LEFT JOIN fa USING (reg) GROUP BY reg),
    suspect AS (SELECT * FROM fm WHERE mean_score < {fixed.SUSPECT_MEAN}),
    company AS (SELECT 'reg:' || reg AS id, reg, 0 AS phase, min(ord) AS ord,
        arg_min(name, (CASE WHEN name LIKE '%"%' THEN 2 ELSE 0 END, length(name), name)) AS name
      FROM f WHERE reg IS NOT NULL AND reg NOT IN (SELECT reg FROM suspect) GROUP BY reg
      UNION ALL SELECT 'name:' || reg || ':' || name, NULL, 1, ord, name FROM f WHERE reg IN (SELECT reg FROM suspect)),
    alias AS (SELECT CASE WHEN reg IN (SELECT reg FROM suspect) THEN 'name:' || reg || ':' || name ELSE 'reg:' || reg END AS id, name
      FROM f WHERE reg IS NOT NULL),
    by_key AS (SELECT {_key("alias.name")} AS k, arg_min(id, (phase, ord, id)) AS id FROM alias JOIN company USING (id) GROUP BY 1),
    resolved AS (SELECT record_key, wins.name, coalesce(company.id, by_key.id) AS company_id FROM wins LEFT JOIN company ON company.reg = wins.reg
      LEFT JOIN by_key ON {_key("wins.name")} = k)"""


def _found(s, d):
    return entities.winner_names(wins(s, d), "winner", "winner_reg", "ord")


@query(
    "register_groups",
    f"""WITH {_WINS}, u AS (SELECT DISTINCT name, reg FROM wins WHERE reg IS NOT NULL)
    SELECT reg, arg_min(name, (CASE WHEN name LIKE '%"%' THEN 2 ELSE 0 END, length(name), name)) AS canonical_name, count(*) AS names FROM u GROUP BY reg""",
)
def _(s, d):
    return entities.register_groups(_found(s, d)).select("reg", "canonical_name", "names")


@query("register_aliases", f"WITH {_FOUND} SELECT DISTINCT id AS company_id, name AS alias FROM alias")
def _(s, d):
    _names, _companies, aliases = _anchored(s, d)
    return entities.merged_aliases(aliases, aliases)


@query("suspect_groups", f"WITH {_FOUND} SELECT reg, names, round(mean_score, 2) AS mean_score FROM suspect")
def _(s, d):
    return entities.suspect_registers(_found(s, d)).select("reg", "names", F.round("mean_score", 2).alias("mean_score"))


def _anchored(s, d):
    found = written(_found(s, d))
    companies, aliases = entities.anchored_companies(found, written(entities.suspect_registers(found)))
    return found, written(companies), written(aliases)


@query(
    "similar_names",
    f"""WITH k AS (SELECT DISTINCT lower(p_name) || ' ' || lower(p_type) AS key FROM part),
    t AS (SELECT key, {_sorted("key")} AS x FROM k WHERE length(key) >= 4),
    p AS (SELECT a.key AS lkey, b.key AS rkey, a.x, b.x AS y FROM t a JOIN t b ON a.key < b.key
      AND levenshtein(a.x, b.x) <= floor((length(a.x) + length(b.x)) * 0.12 + 1e-9)),
    s AS (SELECT lkey, rkey, {_ratio("x", "y")} AS score FROM p)
    SELECT lkey, rkey, round(score, 4) AS score FROM s WHERE score >= {fixed.ALIAS_SCORE}""",
)
def _(s, d):
    """Pairs of company keys at or above the alias score."""
    keys = star.table(s, d, "part").select(F.concat_ws(" ", F.lower("p_name"), F.lower("p_type")).alias("key")).distinct()
    index = written(similar.gram_index(keys, fixed.ALIAS_SCORE))
    pairs = similar.matching_pairs(index, index, fixed.ALIAS_SCORE, F.col("lkey") < F.col("rkey"))
    return pairs.select("lkey", "rkey", F.round("score", 4).alias("score"))


def _resolved(s, d):
    found, companies, aliases = _anchored(s, d)
    loose = found.where(F.col("reg").isNull()).groupBy("name").agg(F.min("ord").alias("ord"))
    companies, aliases = entities.resolve_loose_names(companies, aliases, loose)
    companies, aliases = written(companies), written(aliases)
    return companies, aliases, entities.resolve_records(wins(s, d), companies, aliases, "winner", "winner_reg")


@query("company_index")
def _(s, d):
    companies, _aliases, _records = _resolved(s, d)
    return companies.select("company_id", "canonical_name", "registration_no", "source", F.round("match_confidence", 2).alias("match_confidence"))


@query("index_summary")
def _(s, d):
    companies, aliases, records = _resolved(s, d)
    best = entities.top_by_aliases(companies, aliases).select(F.concat(F.lit("aliases:"), "canonical_name").alias("measure"), F.col("aliases").alias("value"))
    return entities.index_summary(companies, records, "winner").unionByName(best)


@query("record_resolution", f"WITH {_FOUND} SELECT record_key, company_id AS winner_company_id FROM resolved")
def _(s, d):
    _found_names, companies, aliases = _anchored(s, d)
    records = entities.resolve_records(wins(s, d), companies, aliases, "winner", "winner_reg")
    return records.select("record_key", "winner_company_id")


# --- groups ------------------------------------------------------------------------------------


def _register(s, d):
    """A register entry per part number: every third lies in the capital; else five numbers in a row share a town, some of them an address."""
    k = F.col("p_partkey")
    town = F.format_string("Pilsēta %d, iela %d, LV-1001", F.floor(k / 5), F.floor(k / 2) % 2)
    return star.table(s, d, "part").select(
        star.reg_of(k).alias("reg"), F.when(k % 3 == 0, F.format_string("Galvaspilsēta, iela %d, LV-1001", F.floor(k / 12))).otherwise(town).alias("address")
    )


def _owners(s, d):
    return star.table(s, d, "part").select(
        star.reg_of(F.col("p_partkey")).alias("reg"), F.format_string("Owner %d", F.floor((F.col("p_partkey") + 2) / 4)).alias("owner")
    )


def _winning(s, d):
    """Companies straight from the numbers, with at least two wins."""
    _names, companies, aliases = _anchored(s, d)
    records = entities.resolve_records(wins(s, d), companies, aliases, "winner", "winner_reg")
    return written(groups.winning_companies(companies, records)), records


_PAIRS = f"""{_FOUND}, won AS (SELECT company_id AS id, count(*) AS wins FROM resolved GROUP BY 1 HAVING count(*) >= 2),
    placed AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'Galvaspilsēta' ELSE 'Pilsēta ' || p_partkey // 5 END AS town,
        CASE WHEN p_partkey % 3 = 0 THEN p_partkey // 12 ELSE (p_partkey // 2) % 2 END AS street FROM part),
    member AS (SELECT company.id, {_key("name")} AS key, p_partkey AS pk, town, 'Owner ' || (p_partkey + 2) // 4 AS owner, company.name,
        town || ', iela ' || street || ', LV-1001' AS address, wins
      FROM company JOIN won USING (id) JOIN placed ON company.reg = '4' || lpad(CAST(p_partkey AS VARCHAR), 10, '0')),
    sorted_member AS (SELECT *, {_sorted("key")} AS t FROM member WHERE length(key) >= 4),
    near AS (SELECT a.id AS a, b.id AS b, a.t AS x, b.t AS y, a.address = b.address AS same_at, a.owner = b.owner AS own, a.address, a.owner, a.town
      FROM sorted_member a JOIN sorted_member b ON a.id < b.id AND (a.town = b.town OR a.owner = b.owner)
      AND levenshtein(a.t, b.t) <= floor((length(a.t) + length(b.t)) * 0.35 + 1e-9)),
    scored AS (SELECT a, b, CASE WHEN same_at THEN 'same_address' WHEN own THEN 'same_owner' ELSE 'suspected' END AS source,
        CASE WHEN same_at THEN address WHEN own THEN 'Common UBO(s): ' || owner ELSE 'Same municipality: ' || town END AS note, {_ratio("x", "y")} AS score FROM near),
    edges AS (SELECT * FROM scored WHERE score BETWEEN {fixed.PAIR_LOW} AND {fixed.PAIR_HIGH})"""


@query("group_pairs", f"WITH {_PAIRS} SELECT a, b, source, note, round(score, 2) AS score FROM edges")
def _(s, d):
    companies, _records = _winning(s, d)
    pairs = groups.candidate_pairs(companies, _register(s, d), _owners(s, d))
    found = groups.evidence(written(pairs), companies, _register(s, d))
    return found.select("a", "b", "source", "note", F.round("score", 2).alias("score"))


@query(
    "company_groups",
    f"""WITH RECURSIVE {_PAIRS}, link AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
    walk(id, reach) AS (SELECT DISTINCT a, a FROM link UNION SELECT walk.id, link.b FROM walk JOIN link ON walk.reach = link.a),
    c AS (SELECT id, min(reach) AS component FROM walk GROUP BY id),
    e AS (SELECT component, source, CASE WHEN source = 'suspected' THEN '' ELSE note END AS note FROM edges JOIN c ON c.id = edges.a
      QUALIFY row_number() OVER (PARTITION BY component ORDER BY CASE source WHEN 'same_address' THEN 1 WHEN 'same_owner' THEN 2 ELSE 3 END, a, b) = 1)
    SELECT arg_min(name, (length(name), id)) AS name, any_value(source) AS source, any_value(note) AS note, count(*) AS members,
      CAST(sum(wins) AS BIGINT) AS total_wins FROM c JOIN member USING (id) JOIN e USING (component) GROUP BY component""",
)
def _(s, d):
    companies, records = _winning(s, d)
    edges = written(groups.evidence(written(groups.linking_pairs(companies, _register(s, d), _owners(s, d))), companies, _register(s, d)))
    members = written(groups.group_members(edges))
    labelled = groups.group_labels(members, edges, companies)
    return groups.groups_by_wins(labelled, members, records).select("name", "source", "note", "members", "total_wins")


def _supplier_companies(s, d):
    k = F.col("s_suppkey")
    return star.table(s, d, "supplier").select(
        F.concat(F.lit("c"), F.lpad(k.cast("string"), 9, "0")).alias("company_id"), F.col("s_name").alias("canonical_name"), star.reg_of(k).alias("registration_no"),
        "s_suppkey", "s_nationkey",
    )


def _supplier_register(s, d):
    return star.table(s, d, "supplier").select(
        star.reg_of(F.col("s_suppkey")).alias("reg"), F.concat(F.lit("Town "), F.col("s_nationkey").cast("string"), F.lit(", street "), F.col("s_suppkey").cast("string")).alias("address")
    )


def _supplier_pairs(s, d):
    """Pairs of neighbouring suppliers with one, two or three kinds of evidence."""
    base = _supplier_companies(s, d)
    near = base.select(F.col("company_id").alias("b"), (F.col("s_suppkey") - 1).alias("s_suppkey"))
    k = F.col("s_suppkey")
    kinds = F.array(
        F.when(k % 2 == 0, F.struct(F.lit("same_address").alias("kind"), F.lit("x").alias("value"))),
        F.when(k % 3 == 0, F.struct(F.lit("same_owner").alias("kind"), F.lit("Zane").alias("value"))),
        F.when(k % 3 == 0, F.struct(F.lit("same_owner").alias("kind"), F.lit("Anna").alias("value"))),
        F.when(k % 5 != 4, F.struct(F.lit("suspected").alias("kind"), F.lit("t").alias("value"))),
    )
    pairs = base.select(F.col("company_id").alias("a"), "s_suppkey").join(near, "s_suppkey").select("a", "b", "s_suppkey", F.explode(kinds).alias("x"))
    return pairs.where(F.col("x").isNotNull()).select("a", "b", "x.kind", "x.value", F.lit(70.0).alias("score"))


_EDGES = """e AS (SELECT 'c' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS a, 'c' || lpad(CAST(s_suppkey + 1 AS VARCHAR), 9, '0') AS b, s_suppkey AS k,
    CASE WHEN s_suppkey % 2 = 0 THEN 'same_address' WHEN s_suppkey % 3 = 0 THEN 'same_owner' ELSE 'suspected' END AS source,
    CASE WHEN s_suppkey % 2 = 0 THEN 'Town ' || CAST(s_nationkey AS VARCHAR) || ', street ' || CAST(s_suppkey AS VARCHAR) WHEN s_suppkey % 3 = 0
      THEN 'Common UBO(s): Anna, Zane' ELSE 'Same municipality: Town ' || CAST(s_nationkey AS VARCHAR) END AS note FROM supplier
    WHERE s_suppkey + 1 IN (SELECT s_suppkey FROM supplier) AND (s_suppkey % 2 = 0 OR s_suppkey % 3 = 0 OR s_suppkey % 5 <> 4))"""
_GROUPS = """m AS (SELECT s_suppkey AS k, s_name, 'c' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS id,
      sum(CASE WHEN s_suppkey - 1 IN (SELECT k FROM e) THEN 0 ELSE 1 END) OVER (ORDER BY s_suppkey) AS g FROM supplier
      WHERE s_suppkey IN (SELECT k FROM e) OR s_suppkey - 1 IN (SELECT k FROM e)),
    c AS (SELECT *, min(id) OVER (PARTITION BY g) AS component FROM m)"""


@query("evidence", f"WITH {_EDGES} SELECT a, b, source, note FROM e")
def _(s, d):
    found = groups.evidence(_supplier_pairs(s, d), _supplier_companies(s, d), _supplier_register(s, d))
    return found.select("a", "b", "source", "note")


@query("components", f"WITH {_EDGES}, {_GROUPS} SELECT id, component FROM c")
def _(s, d):
    return groups.group_members(_supplier_pairs(s, d))


@query(
    "customer_chains",
    """WITH n AS (SELECT c_custkey, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS component,
      count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS n FROM customer) SELECT c_custkey AS id, component FROM n WHERE n > 1""",
)
def _(s, d):
    """Chains of customers: each is linked to the next of its nation and segment.

    Keys are ordered inside blocks; the last of a block is linked to the first of the
    next block that has any, so no task orders a whole chain.
    """
    from pyspark.sql import Window

    block = F.floor(F.col("c_custkey") / CHAIN_BLOCK).alias("block")
    keys = star.table(s, d, "customer").select("c_nationkey", "c_mktsegment", block, "c_custkey")
    inside = Window.partitionBy("c_nationkey", "c_mktsegment", "block").orderBy("c_custkey")
    links = keys.select(F.col("c_custkey").alias("a"), F.lead("c_custkey").over(inside).alias("b"))
    ends = keys.groupBy("c_nationkey", "c_mktsegment", "block").agg(F.min("c_custkey").alias("first"), F.max("c_custkey").alias("last"))
    across = Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("block")
    links = links.unionByName(ends.select(F.col("last").alias("a"), F.lead("first").over(across).alias("b")))
    return groups.components(links.where(F.col("b").isNotNull()))


# Customer keys of a block of ``customer_chains``.
CHAIN_BLOCK = 500


@query(
    "group_labels",
    f"""WITH {_EDGES}, {_GROUPS}, kept AS (SELECT component FROM c GROUP BY 1 HAVING count(*) FILTER (k % 11 = 5) = 0),
    w AS (SELECT c.component, e.source, CASE WHEN e.source = 'suspected' THEN '' ELSE e.note END AS note FROM e JOIN c ON c.id = e.a
      QUALIFY row_number() OVER (PARTITION BY c.component ORDER BY CASE e.source WHEN 'same_address' THEN 1 WHEN 'same_owner' THEN 2 ELSE 3 END, e.a) = 1)
    SELECT component, arg_min(s_name, (length(s_name), id)) AS name, any_value(w.source) AS source, any_value(w.note) AS note, count(*) AS members
    FROM c JOIN kept USING (component) JOIN w USING (component) GROUP BY component""",
)
def _(s, d):
    pairs = written(_supplier_pairs(s, d))
    companies = _supplier_companies(s, d)
    edges = groups.evidence(pairs, companies, _supplier_register(s, d))
    confirmed = companies.where(F.col("s_suppkey") % 11 == 5).select("company_id")
    return groups.group_labels(groups.group_members(pairs), edges, companies, confirmed)


@query(
    "group_wins",
    f"""WITH {_EDGES}, {_GROUPS}, n AS (SELECT l_suppkey, count(*) AS wins FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)
    SELECT component, count(*) AS members, CAST(coalesce(sum(wins), 0) AS BIGINT) AS total_wins FROM c LEFT JOIN n ON c.k = l_suppkey GROUP BY 1""",
)
def _(s, d):
    members = groups.group_members(_supplier_pairs(s, d))
    won = star.lines(s, d).where(F.col("l_returnflag") == "A").select(F.concat(F.lit("c"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0")).alias("winner_company_id"))
    listed = members.groupBy("component").agg(F.min("id").alias("name"))
    return groups.groups_by_wins(listed, members, won).select("component", "members", "total_wins")


@query(
    "group_members",
    f"""WITH {_EDGES}, {_GROUPS} SELECT component, id, s_name || ' (4' || lpad(CAST(k AS VARCHAR), 10, '0') || '): Town '
    || CAST((SELECT s_nationkey FROM supplier WHERE s_suppkey = k) AS VARCHAR) || ', street ' || CAST(k AS VARCHAR) AS detail, owner
    FROM c JOIN (VALUES ('Anna', 0), ('Zane', 0), ('—', 1)) o(owner, odd) ON k % 2 = odd""",
)
def _(s, d):
    companies = _supplier_companies(s, d)
    owner = F.explode(F.array(F.lit("Zane"), F.lit("Anna")))
    owners = companies.where(F.col("s_suppkey") % 2 == 0).select(F.col("registration_no").alias("reg"), owner.alias("owner"))
    return groups.member_details(groups.group_members(_supplier_pairs(s, d)), companies, _supplier_register(s, d), owners)
