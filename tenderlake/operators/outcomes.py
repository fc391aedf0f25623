"""Parsed model output to clean classifications, outcomes and lot sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, labels
from ..functions.cleaning import cpv_code, none_if_blank, spaced_float, squeeze, strip
from ..functions.names import folded_lower, name_core, plausible, without_noise
from ..session import written

# --- classification -----------------------------------------------------------


def final_category(domain: Column, scope: Column, work: Column) -> Column:
    """Final category of normalised domain, scope and work type."""
    service = F.when(work == "cleaning", "maintenance_cleaning_service").otherwise("infrastructure_maintenance_service")
    building = (
        F.when(scope == "design_only", "building_design")
        .when(scope == "design_build", "building_design_build")
        .when(work == "new_build", "building_new_build")
        .when(work == "renovation", "building_renovation")
        .when(work == "repair", "building_repair")
        .otherwise("unknown")
    )
    infrastructure = (
        F.when(scope == "design_only", "infrastructure_design")
        .when(scope.isin("design_build", "build_only") & (work == "new_build"), "infrastructure_build")
        .when(work.isin("renovation", "repair"), "infrastructure_renovation_repair")
        .when(work.isin("maintenance", "cleaning"), "infrastructure_maintenance_service")
        .when(scope == "design_build", "infrastructure_build")
        .otherwise("unknown")
    )
    return (
        F.when(domain == "non_construction", "non_construction")
        .when(domain == "maintenance_service", service)
        .when((scope == "supervision_only") & (domain == "building"), "building_supervision")
        .when(scope == "service_only", service)
        .when(domain == "building", building)
        .when(domain == "infrastructure", infrastructure)
        .otherwise("unknown")
    )


def classify(parsed: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """Classification columns from model words and the estimated value.

    ``thresholds`` gives the large-project limit per final category and under
    ``default``; without one the limit is one million.
    """
    given = thresholds or {}
    default = F.lit(float(given.get("default", fixed.DEFAULT_SCALE_THRESHOLD)))
    own = {k: float(v) for k, v in given.items() if k != "default"}
    reason = [F.col(x) for x in ("llm_reason", "reason") if x in parsed.columns]
    staged = parsed.withColumns(
        {
            "classification_domain": labels.domain(F.col("domain")),
            "classification_scope_type": labels.scope(F.col("scope_type")),
            "classification_work_type": labels.work(F.col("work_type")),
        }
    )
    category = final_category(*[F.col(f"classification_{x}") for x in ("domain", "scope_type", "work_type")])
    staged = staged.withColumn("classification_final_category", category)
    limit = default
    if own:
        table = F.create_map(*[F.lit(x) for kv in own.items() for x in kv])
        limit = F.coalesce(F.try_element_at(table, F.col("classification_final_category")), default)
    value = F.col("estimated_value_eur")
    scale = F.when(value.isNotNull(), F.when(value >= limit, "large").otherwise("small")).otherwise(labels.scale(F.col("asset_scale")))
    # the first that is not empty speaks, even if it is blank
    told = none_if_blank(strip(F.coalesce(F.lit(None).cast("string"), *[F.when(r != "", r) for r in reason])))
    return staged.withColumns(
        {"classification_asset_scale": scale, "classification_reason": F.coalesce(told, F.lit("openai-no-reason"))}
    )


def schema_errors(parsed: Column, required: list[str], enums: dict[str, list[str]]) -> Column:
    """What a parsed answer (JSON text) lacks or misstates, as a list of messages."""
    keys = F.coalesce(F.json_object_keys(parsed), F.array().cast("array<string>"))
    checks = [F.when(~F.array_contains(keys, k), F.lit(f"Model output missing required field: {k}")) for k in required]
    for k, allowed in enums.items():
        value = F.get_json_object(parsed, f"$.{k}")
        bad = F.concat(F.lit(f"Model field '{k}' not in allowed enum: "), F.coalesce(value, F.lit("None")))
        checks.append(F.when(~F.coalesce(value.isin(*allowed), F.lit(False)), bad))
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def project_class(projects: DataFrame) -> DataFrame:
    """Keyword class of a project with the words that speak for it."""
    number = F.coalesce("procurement_identification_number", F.lit(""))
    name = F.coalesce("procurement_name", F.lit(""))
    cpv = F.coalesce("cpv_main", F.lit(""))
    folded = {"_name": folded_lower(name), "_number": folded_lower(number), "_cpv": folded_lower(cpv)}
    short = F.concat_ws(" ", "_name", "_number")
    full = F.concat_ws(" ", "_name", "_cpv", "_number")
    code = cpv_code(F.col("cpv_main"))
    head = F.coalesce(F.substring(code, 1, 4), F.lit(""))

    def hits(text: Column, words: tuple[str, ...]) -> Column:
        return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))

    texts = {"_short": short, "_full": full}
    short, full = F.col("_short"), F.col("_full")
    found = {
        "_infra": hits(full, fixed.INFRASTRUCTURE_WORDS),
        "_building": hits(full, fixed.BUILDING_WORDS),
        "_renov": hits(short, fixed.RENOVATION_WORDS),
        "_new": hits(short, fixed.NEW_BUILD_WORDS),
    }
    marked = projects.withColumns(folded).withColumns(texts).withColumns(found)

    def some(x: str) -> Column:
        return F.size(x) > 0

    infra = some("_infra") | head.isin(*fixed.INFRASTRUCTURE_CPV)
    building = some("_building") | head.isin(*fixed.BUILDING_CPV)
    label = (
        F.when(infra & some("_renov"), "infrastructure_renovation")
        .when(infra, "infrastructure_new")
        .when(some("_renov"), "renovation")
        .when(building | some("_new"), "new_building")
        .otherwise("unknown")
    )

    def reason(mark: str, x: str) -> Column:
        return F.when(some(x), F.concat(F.lit(f"{mark}="), F.array_join(F.slice(x, 1, 4), ",")))

    reasons = F.concat_ws(
        "; ", F.concat(F.lit("cpv="), code), reason("infra_kw", "_infra"), reason("building_kw", "_building"),
        reason("renov_kw", "_renov"), reason("new_kw", "_new"),
    )
    out = marked.withColumns({"project_class": label, "class_reason": F.when(reasons == "", "no-strong-signals").otherwise(reasons)})
    return out.drop(*found, *folded, *texts)


# --- outcomes -----------------------------------------------------------------


def _text(x: Column) -> Column:
    return none_if_blank(strip(x))


def _list(x: Column) -> Column:
    """Stripped texts of a list without its empty ones; null if none is left."""
    kept = F.transform(F.filter(x, lambda v: v != ""), strip)
    return F.when(F.size(kept) > 0, kept)


# Report texts an outcome carries over as they are (fixed values: column names).
OUTCOME_TEXTS = (
    "bid_deadline", "decision_date", "funding_source", "eu_project_reference", "evaluation_method", "contract_scope_type", "notes",
)


def _further(parsed: DataFrame) -> dict[str, Column]:
    """Outcome fields beside status, winner and participants; what an answer lacks is null, the lot flag false."""
    def has(name: str) -> bool:
        return name in parsed.columns

    found = {name: _text(F.col(name)) if has(name) else F.lit(None).cast("string") for name in OUTCOME_TEXTS}
    found["subcontractors"] = _list(F.col("subcontractors")) if has("subcontractors") else F.lit(None).cast("array<string>")
    found["is_multi_lot"] = F.coalesce(F.col("is_multi_lot"), F.lit(False)) if has("is_multi_lot") else F.lit(False)
    found["lot_count"] = F.nullif(F.col("lot_count").cast("int"), F.lit(0)) if has("lot_count") else F.lit(None).cast("int")
    return found


def clean_company(x: Column) -> Column:
    return without_noise(squeeze(x))


def outcome_participants(parsed: DataFrame) -> DataFrame:
    """Cleaned participants: ``procurement_id, pos, name, registration_no, suggested_price_eur, disqualified, disqualification_reason, consortium_members``.

    One row per participant of a parsed answer; implausible names go, and of
    names equal when folded the first stays. Consortium members are a list, or
    null if there are none.
    """
    listed = parsed.select("procurement_id", F.explode(_people(parsed)).alias("p")).select("procurement_id", "p.*")
    first = F.min_by(F.struct("pos", "name", "registration_no", "suggested_price_eur", "disqualified", "disqualification_reason", "consortium_members"), F.col("pos"))
    return listed.groupBy("procurement_id", "_key").agg(first.alias("p")).select("procurement_id", "p.*")


def _people(parsed: DataFrame) -> Column:
    """Cleaned participants of an answer as a list of structs, without implausible names and names met before; ``_key`` is the folded name.

    Each step is its own ``transform``, so every name is cleaned and folded once.
    """
    given = parsed.schema["participants"].dataType.elementType.names

    def clean(p: Column, i: Column) -> Column:
        partners = _list(p["consortium_members"]) if "consortium_members" in given else F.lit(None).cast("array<string>")
        return F.struct(
            i.alias("pos"), clean_company(_text(p["name"])).alias("name"), _text(p["registration_no"]).alias("registration_no"),
            spaced_float(p["suggested_price_eur"]).alias("suggested_price_eur"), F.coalesce(p["disqualified"], F.lit(False)).alias("disqualified"),
            _text(p["disqualification_reason"]).alias("disqualification_reason"), partners.alias("consortium_members"),
        )

    kept = F.filter(F.transform(F.col("participants"), clean), lambda p: plausible(p["name"]))
    keyed = F.transform(kept, lambda p: p.withField("_key", folded_lower(p["name"])))
    none = F.array().cast(
        "array<struct<pos:int,name:string,registration_no:string,suggested_price_eur:double,disqualified:boolean,"
        "disqualification_reason:string,consortium_members:array<string>,_key:string>>"
    )
    seen = lambda found, p: F.exists(found, lambda x: x["_key"] == p["_key"])
    return F.aggregate(keyed, none, lambda found, p: F.when(seen(found, p), found).otherwise(F.array_append(found, p)))


def outcomes(parsed: DataFrame) -> DataFrame:
    """Cleaned outcome per procurement; the winner takes the participant its core name meets.

    The first participant whose core contains the winner's core, or is
    contained in it, gives the name and fills a missing number and price. Dates,
    funding, scope, subcontractors, lots and notes of the answer are cleaned too.
    """
    again = written(parsed.where(F.col("procurement_id").isNotNull()).groupBy("procurement_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("procurement_id"))
    if again.isEmpty():
        return _outcomes_of_rows(parsed)
    single = _outcomes_of_rows(parsed.join(again, "procurement_id", "left_anti"))
    return single.unionByName(_outcomes_of_ids(parsed.join(again, "procurement_id", "left_semi")))


def _answers(parsed: DataFrame, *more: Column) -> DataFrame:
    """Cleaned fields of each answer but its participants."""
    raw = _text(F.col("winner_name"))
    status = F.lower(strip(F.col("procurement_status")))
    return parsed.select(
        "procurement_id",
        F.when(status.isin(*fixed.OUTCOME_STATUSES), status).otherwise("unknown").alias("procurement_status"),
        clean_company(raw).alias("w_name"),
        _text(F.col("winner_registration_no")).alias("w_reg"),
        spaced_float(F.col("winner_price_eur").cast("string")).alias("w_price"),
        F.lower(_text(F.col("confidence"))).alias("confidence"),
        *(value.alias(name) for name, value in _further(parsed).items()),
        *more,
    ).withColumn("w_core", name_core(F.col("w_name")))


def _meets(core: Column) -> Column:
    w_core = F.col("w_core")
    return (w_core != "") & (core != "") & (F.contains(core, w_core) | F.contains(w_core, core))


def _outcomes_of_rows(parsed: DataFrame) -> DataFrame:
    """Outcomes of answers whose id stands in one row only: each is decided by itself."""
    nobody = F.slice(F.col("people"), 1, 0)
    people = F.when(F.col("procurement_id").isNotNull(), F.col("people")).otherwise(nobody)
    cores = F.transform(people, lambda p: p.withField("core", name_core(p["name"])))
    base = _answers(parsed, _people(parsed).alias("people")).withColumn("people", cores)
    found = base.withColumns({
        "hit": F.try_element_at(F.filter("people", lambda p: _meets(p["core"])), F.lit(1)),
        "participants": F.when(F.col("people").isNotNull(), F.size("people")).cast("long"),
        "disqualified": F.when(F.col("people").isNotNull(), F.size(F.filter("people", lambda p: p["disqualified"]))).cast("long"),
    })
    return _decided(found, parsed)


def _outcomes_of_ids(parsed: DataFrame) -> DataFrame:
    """Outcomes of answers that share ids: participants of an id stand together."""
    members = outcome_participants(parsed).withColumn("core", name_core(F.col("name")))
    base = _answers(parsed)
    hit = F.min_by(F.struct("name", "registration_no", "suggested_price_eur"), F.when(_meets(F.col("core")), F.col("pos"))).alias("hit")
    counted = (
        base.select("procurement_id", "w_core")
        .join(members, "procurement_id")
        .groupBy("procurement_id")
        .agg(hit, F.count(F.lit(1)).alias("participants"), F.count_if("disqualified").alias("disqualified"))
    )
    return _decided(base.join(counted, "procurement_id", "left"), parsed)


def _decided(joined: DataFrame, parsed: DataFrame) -> DataFrame:
    return joined.select(
        "procurement_id",
        "procurement_status",
        F.coalesce("hit.name", "w_name").alias("winner_name"),
        F.coalesce("w_reg", "hit.registration_no").alias("winner_registration_no"),
        F.coalesce("w_price", "hit.suggested_price_eur").alias("winner_price_eur"),
        F.coalesce("participants", F.lit(0)).alias("participants"),
        F.coalesce("disqualified", F.lit(0)).alias("disqualified"),
        "confidence",
        *_further(parsed),
    )


# --- lot sections ---------------------------------------------------------------


def lot_sections(texts: DataFrame, text: str = "text", lot_count: str | None = None, section_chars: int | None = None) -> DataFrame:
    """Rows ``(…, pos, lot_number, text_section)`` of the lots a text is divided in.

    The first heading pattern that splits the text is used. A text that names a
    lot count but shows no headings gives empty placeholder lots. Sections are
    whole unless ``section_chars`` shortens them.
    """
    t = F.col(text)

    def cut(pattern: str) -> Column:
        numbers = F.regexp_extract_all(t, F.lit(pattern))
        pieces = F.split(t, pattern)
        bodies = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
        return F.transform(
            F.arrays_zip(numbers.alias("n"), bodies.alias("b")),
            lambda z: F.struct(z["n"].try_cast("int").alias("lot_number"), (F.substring(z["b"], 1, section_chars) if section_chars else z["b"]).alias("text_section")),
        )

    found = F.coalesce(*[F.when(F.size(F.regexp_extract_all(t, F.lit(p))) > 0, cut(p)) for p in fixed.LOT_HEADINGS])
    if lot_count:
        n = F.col(lot_count)
        blank = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(i.alias("lot_number"), F.lit("").alias("text_section")))
        found = F.coalesce(found, F.when(n > 1, blank))
    others = [x for x in texts.columns if x != text]
    cut_up = texts.select(*others, F.posexplode_outer(found).alias("pos", "s")).where(F.col("pos").isNotNull())
    return cut_up.select(*others, "pos", "s.lot_number", "s.text_section")


def assign_lots(participants: DataFrame, sections: DataFrame, key: str) -> DataFrame:
    """Participants with the first lot whose section names them."""
    near = participants.select(key, "name").distinct().join(sections.select(key, "pos", "lot_number", "text_section"), key)
    named = near.where(F.contains(F.col("text_section"), F.col("name"))).groupBy(key, "name").agg(F.min_by("lot_number", "pos").alias("lot_number"))
    return participants.drop("lot_number").join(named, [key, "name"], "left")
