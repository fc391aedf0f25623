"""Corporate groups: similar names with shared address, owner or municipality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, names
from ..session import written
from .similar import block_pairs


def winning_companies(companies: DataFrame, resolved: DataFrame, min_wins: int = 2) -> DataFrame:
    """Number-anchored companies with their wins, at least ``min_wins``."""
    wins = resolved.groupBy(F.col("winner_company_id").alias("company_id")).agg(F.count(F.lit(1)).alias("wins"))
    anchored = companies.where(F.col("source") == "reg_no")
    return anchored.join(wins.where(F.col("wins") >= min_wins), "company_id")


def _signals(companies: DataFrame, register: DataFrame, owners: DataFrame) -> DataFrame:
    """One row per company and shared thing: ``company_id, kind, value, note``."""
    listed = register.select("reg", "address", names.address_key(F.col("address")).alias("address_key"), names.municipality(F.col("address")).alias("town"))
    placed = companies.select("company_id", F.col("registration_no").alias("reg")).join(listed, "reg")
    address = placed.where(F.col("address_key") != "").select("company_id", F.lit("same_address").alias("kind"), F.col("address_key").alias("value"), F.col("address").alias("note"))
    town_key = names.address_key(F.col("town"))
    town = placed.where(town_key != "").select("company_id", F.lit("suspected").alias("kind"), town_key.alias("value"), F.concat(F.lit("Same municipality: "), "town").alias("note"))
    owned = companies.select("company_id", F.col("registration_no").alias("reg")).join(owners.select("reg", "owner").distinct(), "reg")
    owner = owned.select("company_id", F.lit("same_owner").alias("kind"), F.col("owner").alias("value"), F.col("owner").alias("note"))
    return address.unionByName(owner).unionByName(town)


def candidate_pairs(companies: DataFrame, register: DataFrame, owners: DataFrame, low: float = fixed.PAIR_LOW, high: float = fixed.PAIR_HIGH) -> DataFrame:
    """Similar company pairs that share at least one signal: ``a, b, kind, value, score``.

    Only pairs with a signal can end in a group, so names are compared inside
    the blocks of equal signals and nowhere else. A crowded block (a capital
    city) is compared list by list, see ``block_pairs``.
    """
    return _parted(block_pairs(_members(companies, _shared(companies, register, owners)), low, high))


def linking_pairs(companies: DataFrame, register: DataFrame, owners: DataFrame, low: float = fixed.PAIR_LOW, high: float = fixed.PAIR_HIGH) -> DataFrame:
    """Those ``candidate_pairs`` that decide the groups: ``a, b, kind, value, score``.

    They have the same connected components, and in each the smallest pair of every
    kind of signal; pairs that come out have all signals they share.
    """
    shared = written(_shared(companies, register, owners))
    pairs = written(block_pairs(_members(companies, shared), low, high, linking=True).groupBy("a", "b").agg(F.max("score").alias("score")))
    both = pairs.join(shared.select(F.col("company_id").alias("a"), "block"), "a").join(shared.select(F.col("company_id").alias("b"), "block"), ["b", "block"])
    return _parted(both)


def _shared(companies: DataFrame, register: DataFrame, owners: DataFrame) -> DataFrame:
    """``company_id, block`` of every signal."""
    return _signals(companies, register, owners).select("company_id", F.concat_ws("|", "kind", "value").alias("block")).distinct()


def _members(companies: DataFrame, shared: DataFrame) -> DataFrame:
    keyed = companies.select("company_id", names.match_key(F.col("canonical_name")).alias("key"))
    busy = shared.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return shared.join(busy, "block", "left_semi").join(keyed, "company_id").select("block", F.col("company_id").alias("id"), "key")


def _parted(scored: DataFrame) -> DataFrame:
    return scored.select(
        "a", "b", F.substring_index("block", "|", 1).alias("kind"), F.expr("substr(block, instr(block, '|') + 1)").alias("value"), "score"
    )


def evidence(pairs: DataFrame, companies: DataFrame, register: DataFrame) -> DataFrame:
    """Strongest evidence per pair and its note: address, then owners, then municipality."""
    rank = F.when(F.col("kind") == "same_address", 3).when(F.col("kind") == "same_owner", 2).otherwise(1)
    best = pairs.withColumn("rank", rank).groupBy("a", "b").agg(F.max("rank").alias("rank"), F.max("score").alias("score"))
    kept = pairs.withColumn("rank", rank).join(best.drop("score"), ["a", "b", "rank"])
    listed = companies.select(F.col("company_id").alias("a"), F.col("registration_no").alias("reg")).join(
        register.select("reg", "address"), "reg", "left"
    ).select("a", "address")
    shared = kept.groupBy("a", "b", "kind", "rank").agg(F.array_join(F.array_sort(F.collect_set("value")), ", ").alias("values"), F.max("score").alias("score"))
    note = (
        F.when(F.col("kind") == "same_owner", F.concat(F.lit("Common UBO(s): "), "values"))
        .when(F.col("kind") == "same_address", F.col("address"))
        .otherwise(F.concat(F.lit("Same municipality: "), names.municipality(F.col("address"))))
    )
    return shared.join(listed, "a", "left").select("a", "b", F.col("kind").alias("source"), note.alias("note"), "rank", "score")


# Keys with more than this share of all rows are heavy; fewer than ``HEAVY`` of them can be.
HEAVY = 1000
# Rows up to which any key may stay in one task.
LIGHT_ROWS = 50_000


def heavy_keys(rows: DataFrame, key: str) -> DataFrame | None:
    """Keys that hold over one in ``HEAVY`` rows, or ``None`` if there are none."""
    counted = written(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")))
    total = counted.agg(F.sum("n")).first()[0] or 0
    heavy = counted.where(F.col("n") > max(total // HEAVY, LIGHT_ROWS // HEAVY)).select(key)
    return None if total <= LIGHT_ROWS or heavy.isEmpty() else heavy


def lookup(rows: DataFrame, key: str, table: DataFrame, heavy: DataFrame | None, apart: bool = False) -> DataFrame:
    """``rows`` joined with ``table``, which has one row per ``key``.

    Rows of heavy keys stay where they are and meet a broadcast of fewer than
    ``HEAVY`` table rows; the others are dealt out by key, none of which holds many.
    With ``apart`` no table goes through the driver but those rows, in every round anew.
    """
    if heavy is None:
        return rows.join(table.hint("merge") if apart else table, key)
    few = F.broadcast(heavy)
    met = rows.join(F.broadcast(table.join(few, key, "left_semi")), key)
    return rows.join(few, key, "left_anti").join(table.hint("merge"), key).unionByName(met)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``a, b`` edges: ``id, component`` (its smallest id).

    Each round takes the least label among neighbours and then the label of
    that label, so chains shorten by doubling. State is written per round. Hubs, as
    neighbours and as labels, are looked up without an exchange of their rows.
    """
    both = edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(edges.select(F.col("b").alias("src"), F.col("a").alias("dst")))
    both = written(both.distinct())
    hubs = heavy_keys(both, "dst")
    state = written(both.groupBy(F.col("src").alias("id")).agg(F.least(F.col("id"), F.min("dst")).alias("label")))
    crowded = state.count() > LIGHT_ROWS
    while True:
        met = lookup(both, "dst", state.select(F.col("id").alias("dst"), "label"), hubs, crowded)
        near = met.groupBy(F.col("src").alias("id")).agg(F.min("label").alias("near"))
        step = state.join(near.hint("merge") if crowded else near, "id").select("id", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        step = written(step) if crowded else step
        jump = step.select(F.col("id").alias("label"), F.col("label").alias("next"))
        # a label is the id of a row, so each has its next
        seen = lookup(step, "label", jump, heavy_keys(step, "label") if crowded else None, crowded)
        new = written(seen.select("id", F.least("label", "next").alias("label"), "old"))
        changed = not new.where(F.col("label") != F.col("old")).isEmpty()
        state = new.drop("old")
        if not changed:
            return state.withColumnRenamed("label", "component")


def group_members(edges: DataFrame) -> DataFrame:
    """Members of every group with more than one company."""
    return components(edges.select("a", "b"))


def group_labels(members: DataFrame, edges: DataFrame, companies: DataFrame, confirmed: DataFrame | None = None) -> DataFrame:
    """One row per new group: shortest member name, strongest evidence, size.

    Groups holding any member of a confirmed group are left out. Municipality
    evidence carries no note.
    """
    if confirmed is not None:
        taken = members.join(confirmed.select(F.col("company_id").alias("id")), "id", "left_semi").select("component").distinct()
        members = members.join(taken, "component", "left_anti")
    inside = edges.join(members.select(F.col("id").alias("a"), "component"), "a")
    best = inside.groupBy("component").agg(F.min_by(F.struct("source", "note", "rank"), F.struct(-F.col("rank"), F.col("a"), F.col("b"))).alias("e"))
    named = members.join(companies.select(F.col("company_id").alias("id"), "canonical_name"), "id")
    short = named.groupBy("component").agg(
        F.min_by("canonical_name", F.struct(F.length("canonical_name"), F.col("id"))).alias("name"), F.count(F.lit(1)).alias("members")
    )
    note = F.when(F.col("e.rank") > 1, F.col("e.note")).otherwise("")
    return short.join(best, "component").select("component", "name", F.col("e.source").alias("source"), note.alias("note"), "members")


def member_details(members: DataFrame, companies: DataFrame, register: DataFrame, owners: DataFrame) -> DataFrame:
    """Detail rows of each member: name, number and address as text, one row per owner (``—`` for none)."""
    joined = (
        members.join(companies.select(F.col("company_id").alias("id"), "canonical_name", F.col("registration_no").alias("reg")), "id")
        .join(register.select("reg", "address"), "reg", "left")
        .join(owners.select("reg", "owner").distinct(), "reg", "left")
    )
    text = F.concat(F.col("canonical_name"), F.lit(" ("), F.coalesce("reg", F.lit("")), F.lit("): "), F.coalesce("address", F.lit("?")))
    return joined.select("component", "id", text.alias("detail"), F.coalesce("owner", F.lit("—")).alias("owner"))


def groups_by_wins(groups: DataFrame, members: DataFrame, resolved: DataFrame) -> DataFrame:
    """Groups with members and total wins, most wins first."""
    wins = resolved.groupBy(F.col("winner_company_id").alias("id")).agg(F.count(F.lit(1)).alias("wins"))
    counted = members.join(wins, "id", "left").groupBy("component").agg(
        F.count(F.lit(1)).alias("members"), F.coalesce(F.sum("wins"), F.lit(0)).alias("total_wins")
    )
    return groups.drop("members").join(counted, "component").orderBy(F.desc("total_wins"), "name")
