"""Page, document, message and model-output queries over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, labels
from ..operators import conversation, lots, outcomes, pages
from ..sources import star
from .cleaning import _cases
from .registry import query

# --- pages ---------------------------------------------------------------------------------------

_MARKS = (
    "Pārbaude pret robotiem", '<input name="__RequestVerificationToken" type="hidden" value="tok', "Uzmanību, šī ir EIS publikācija", "g-recaptcha",
)


def _pages(s, d):
    k = F.col("page_id")
    added = _cases(
        k % 5, F.lit(_MARKS[0]), F.concat(F.lit(_MARKS[1]), k.cast("string"), F.lit('">')), F.lit(_MARKS[2]), F.lit(_MARKS[3]), F.lit(""),
    )
    return star.texts(s, d, "pages", "page_id").select("page_id", F.concat("html", added).alias("html"))


@query(
    "page_facts",
    """SELECT page_id, page_id % 5 IN (0, 3) OR contains(html, 'g-recaptcha') OR contains(html, 'uxVerifyCaptcha') AS is_captcha,
    CASE WHEN page_id % 5 = 1 THEN 'tok' || CAST(page_id AS VARCHAR) END AS csrf_token, page_id % 5 = 2 AS is_publication FROM pages""",
)
def _(s, d):
    return pages.page_facts(_pages(s, d)).drop("html")


def _listed_pages(s, d):
    """Pages that carry document lists, some nested, some broken."""
    k = F.col("page_id")
    n = k.cast("string")
    docs = F.concat(
        F.lit('<script>var ActualDocuments_items = [{"Id":'), n, F.lit(',"TypeCode":"'), F.when(k % 3 == 0, "PRCFINSMR").otherwise("OTHER"),
        F.lit('","Title":"Būvprojekts ]\\" '), n, F.lit('","TypeTitle":"x","tags":["a",["b"]]}, 5, {"Id":-1,"Title":"'),
        F.when(k % 3 == 1, "Finanšu piedāvājumu apkopojums").when(k % 5 == 0, "Atskaite").otherwise("Ziņojums"), F.lit('"}];'),
        F.when(k % 4 == 0, ' var HistoricalDocuments_items = [{"Title":"Projekta_dokumentācija"}];').when(k % 4 == 1, " var HistoricalDocuments_items = [{;").otherwise(""),
        F.lit("</script>"),
    )
    return star.texts(s, d, "pages", "page_id").select("page_id", F.concat("html", docs).alias("html"))


@query(
    "js_documents",
    """SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 2 ELSE 1 END AS matched, 'actual:Būvprojekts ]" ' || CAST(page_id AS VARCHAR)
    || CASE WHEN page_id % 4 = 0 THEN '|historical:Projekta_dokumentācija' ELSE '' END AS titles FROM pages""",
)
def _(s, d):
    found = pages.matched_titles(_listed_pages(s, d))
    return found.select("page_id", F.col("matched_document_count").alias("matched"), F.array_join("matched_document_titles", "|").alias("titles"))


@query(
    "final_reports",
    """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN CAST(page_id AS VARCHAR) WHEN page_id % 3 = 1 THEN '-1'
    WHEN page_id % 5 <> 0 THEN '-1' END AS chosen FROM pages""",
)
def _(s, d):
    listed = pages.documents(_listed_pages(s, d), "ActualDocuments_items").select("page_id", "docs")
    return listed.select("page_id", pages.final_report(F.col("docs"))["Id"].alias("chosen"))


def _fetched(s, d):
    k = F.col("o_orderkey")
    return star.table(s, d, "orders").select(
        k.cast("string").alias("procurement_id"), F.year("o_orderdate").alias("year"), F.lit("").alias("procurement_url"),
        _cases(k % 4, F.lit("Pārtraukts"), F.lit(" Izbeigts "), F.lit("Noslēgts"), F.lit(None).cast("string")).alias("procurement_status"),
        F.when(k % 5 == 0, F.concat(k.cast("string"), F.lit(".pdf"))).alias("local_file"), (k % 3 == 0).alias("document_found"),
        F.when(k % 3 == 1, "eps_publication").when(k % 3 == 2, F.concat(F.lit("download_error:"), k.cast("string"))).alias("fetch_error"),
    )


_STATUS = """st AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 < 2 THEN 'skipped_status' WHEN o_orderkey % 5 = 0 THEN 'already_present'
    WHEN o_orderkey % 3 = 0 THEN 'downloaded' WHEN o_orderkey % 3 = 1 THEN 'skipped_eps_publication' ELSE 'failed' END AS status FROM orders)"""


@query(
    "report_status",
    f"""WITH {_STATUS} SELECT status AS report_download_status, CASE status WHEN 'skipped_status' THEN 'skipped_by_procurement_status'
    WHEN 'already_present' THEN 'existing_local_file' WHEN 'downloaded' THEN 'select_final_report_document'
    WHEN 'skipped_eps_publication' THEN 'page_type_detection' END AS report_selection_method, count(*) AS records FROM st GROUP BY ALL""",
)
def _(s, d):
    return pages.report_status(_fetched(s, d)).groupBy("report_download_status", "report_selection_method").agg(F.count(F.lit(1)).alias("records"))


@query("report_work", f"WITH {_STATUS} SELECT CAST(k AS VARCHAR) AS procurement_id FROM st WHERE status = 'failed'")
def _(s, d):
    return pages.report_work(pages.report_status(_fetched(s, d)), only_failed=True, retry_error_prefix="download_error:").select("procurement_id")


# --- lots in text -----------------------------------------------------------------------------------


def _lot_texts(s, d):
    k = F.col("doc_id")
    tail = _cases(
        k % 5, F.concat(F.lit("\n1. daļa: "), F.col("text"), F.lit("\n 3. Daļā: "), F.col("source"), F.lit(" end")),
        F.lit(" Iepirkums ir SADALĪTS 4 daļās."), F.lit(" kas sastāv no 1 daļām"), F.lit("\n1. daļa "), F.lit(""),
    )
    return star.texts(s, d, "documents", "doc_id").select("doc_id", "source", F.concat("text", tail).alias("text"))


@query(
    "multi_lot_text",
    "SELECT doc_id, CAST(CASE doc_id % 5 WHEN 0 THEN 3 WHEN 1 THEN 4 ELSE 1 END AS INTEGER) AS lot_count FROM documents",
)
def _(s, d):
    return _lot_texts(s, d).select("doc_id", labels.lot_count_in_text(F.col("text")).alias("lot_count"))


@query(
    "lot_sections",
    """SELECT doc_id, CAST(0 AS INTEGER) AS pos, CAST(1 AS INTEGER) AS lot_number, md5(' ' || text || chr(10) || ' ') AS body FROM documents WHERE doc_id % 5 = 0
    UNION ALL SELECT doc_id, 1, 3, md5(' ' || source || ' end') FROM documents WHERE doc_id % 5 = 0
    UNION ALL SELECT doc_id, CAST(i - 1 AS INTEGER), CAST(i AS INTEGER), md5('') FROM documents, range(1, 5) t(i) WHERE doc_id % 5 = 1
    UNION ALL SELECT doc_id, 0, 1, md5(' ') FROM documents WHERE doc_id % 5 = 3""",
)
def _(s, d):
    counted = _lot_texts(s, d).withColumn("lots", labels.lot_count_in_text(F.col("text")))
    cut = outcomes.lot_sections(counted.drop("source"), "text", "lots")
    return cut.select("doc_id", "pos", "lot_number", F.md5("text_section").alias("body"))


@query(
    "lot_assignment",
    """SELECT doc_id, source AS name, CAST(CASE WHEN doc_id % 5 = 0 THEN CASE WHEN contains(text, source) THEN 1 ELSE 3 END END AS INTEGER) AS lot_number
    FROM documents""",
)
def _(s, d):
    texts = _lot_texts(s, d)
    sections = outcomes.lot_sections(texts.drop("source"), "text")
    return outcomes.assign_lots(texts.select("doc_id", F.col("source").alias("name")), sections, "doc_id")


# --- classes -----------------------------------------------------------------------------------------

_HIT = "list_filter([{words}], lambda w: contains({text}, w))"


def _sql_words(words):
    return ", ".join(f"'{w}'" for w in words)


def _sql_reason(mark, col):
    return f"CASE WHEN len({col}) > 0 THEN '{mark}=' || array_to_string({col}[1:4], ',') END"


@query(
    "heuristic_class",
    f"""WITH t AS (SELECT doc_id, lower(strip_accents(text)) || ' ' AS short, lower(strip_accents(text)) || ' ' || code || ' ' AS full_text, code FROM
      (SELECT *, CASE doc_id % 4 WHEN 0 THEN '45210000-2' WHEN 1 THEN '45230000-8' WHEN 2 THEN '71000000-8' ELSE '' END AS code FROM documents)),
    h AS (SELECT doc_id, nullif(code, '') AS code, code LIKE '4521%' AS cb, code LIKE '4523%' AS ci,
      {_HIT.format(words=_sql_words(fixed.INFRASTRUCTURE_WORDS), text='full_text')} AS i,
      {_HIT.format(words=_sql_words(fixed.BUILDING_WORDS), text='full_text')} AS b,
      {_HIT.format(words=_sql_words(fixed.RENOVATION_WORDS), text='short')} AS r,
      {_HIT.format(words=_sql_words(fixed.NEW_BUILD_WORDS), text='short')} AS n FROM t)
    SELECT doc_id, CASE WHEN (len(i) > 0 OR ci) AND len(r) > 0 THEN 'infrastructure_renovation' WHEN len(i) > 0 OR ci THEN 'infrastructure_new'
      WHEN len(r) > 0 THEN 'renovation' WHEN len(b) > 0 OR cb OR len(n) > 0 THEN 'new_building' ELSE 'unknown' END AS project_class,
    coalesce(nullif(concat_ws('; ', 'cpv=' || code, {_sql_reason('infra_kw', 'i')}, {_sql_reason('building_kw', 'b')}, {_sql_reason('renov_kw', 'r')},
      {_sql_reason('new_kw', 'n')}), ''), 'no-strong-signals') AS class_reason FROM h""",
)
def _(s, d):
    k = F.col("doc_id")
    code = _cases(k % 4, F.lit("45210000-2"), F.lit("45230000-8"), F.lit("71000000-8"), F.lit(""))
    projects = star.texts(s, d, "documents", "doc_id").select("doc_id", F.col("text").alias("procurement_name"), F.lit("").alias("procurement_identification_number"), code.alias("cpv_main"))
    return outcomes.project_class(projects).select("doc_id", "project_class", "class_reason")


_CATEGORY = {0: "building_design", 1: "maintenance_cleaning_service", 2: "infrastructure_renovation_repair", 3: "building_supervision", 4: "non_construction",
             5: "unknown", 6: "infrastructure_build", 7: "infrastructure_maintenance_service"}


@query(
    "classify_labels",
    "WITH c AS (SELECT o_orderkey, o_totalprice, o_orderkey % 8 AS i, CASE o_orderkey % 8 "
    + " ".join(f"WHEN {i} THEN '{x}'" for i, x in _CATEGORY.items())
    + """ END AS category FROM orders)
    SELECT o_orderkey, category AS classification_final_category, CASE WHEN i = 5 THEN 'small' WHEN o_totalprice >= CASE category WHEN 'building_design'
      THEN 100000 ELSE 250000 END THEN 'large' ELSE 'small' END AS classification_asset_scale,
    CASE WHEN i < 4 THEN 'why' ELSE 'openai-no-reason' END AS classification_reason FROM c""",
)
def _(s, d):
    k = F.col("o_orderkey") % 8
    words = {
        "domain": ("Building", "buildings", "infra", "building", "not_construction", "castle", "infrastructure", "service"),
        "scope_type": ("Design Only", "services", "works", "supervision", "", "build", "design-build", "build"),
        "work_type": ("", "snow cleaning", "minor repair", "new", "x", "new", "capital works", "repair"),
    }
    parsed = star.table(s, d, "orders").select(
        "o_orderkey", *[_cases(k, *[F.lit(w) for w in ws]).alias(n) for n, ws in words.items()], F.lit("minor").alias("asset_scale"),
        F.when(k < 4, " why ").otherwise("  ").alias("llm_reason"), F.when(k != 5, F.col("o_totalprice")).alias("estimated_value_eur"),
    )
    done = outcomes.classify(parsed, {"default": 250000, "building_design": 100000})
    return done.select("o_orderkey", "classification_final_category", "classification_asset_scale", "classification_reason")


@query(
    "output_schema_check",
    """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 1 THEN 'Model output missing required field: scope_type' WHEN 2
    THEN 'Model field ''domain'' not in allowed enum: castle' ELSE '' END AS errors FROM orders""",
)
def _(s, d):
    answer = _cases(
        F.col("o_orderkey") % 3, F.lit('{"domain": "building", "scope_type": null}'), F.lit('{"domain": "unknown"}'), F.lit('{"domain": "castle", "scope_type": "x"}')
    )
    staged = star.table(s, d, "orders").select("o_orderkey", answer.alias("answer"))
    errors = outcomes.schema_errors(F.col("answer"), ["domain", "scope_type"], {"domain": list(fixed.DOMAINS)})
    return staged.select("o_orderkey", F.array_join(errors, "|").alias("errors"))


# --- outcomes ---------------------------------------------------------------------------------------------


@query(
    "outcomes",
    """SELECT CAST(o_orderkey AS VARCHAR) AS procurement_id, CASE o_orderkey % 3 WHEN 0 THEN 'completed' ELSE 'unknown' END AS procurement_status,
    CASE o_orderkey % 4 WHEN 0 THEN 'SIA Čiekurs' WHEN 1 THEN o_orderpriority || ' Būve' WHEN 2 THEN 'Cits' END AS winner_name,
    CASE o_orderkey % 4 WHEN 0 THEN '111' WHEN 1 THEN '999' END AS winner_registration_no,
    CASE o_orderkey % 4 WHEN 0 THEN o_totalprice WHEN 1 THEN 12000.5 END AS winner_price_eur, CAST(2 AS BIGINT) AS participants,
    CAST(CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS disqualified, 'high' AS confidence,
    strftime(o_orderdate, '%d.%m.%Y') AS bid_deadline, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS decision_date,
    'own funds' AS funding_source, CASE WHEN o_orderkey % 5 = 0 THEN 'EU-' || o_orderkey END AS eu_project_reference,
    'lowest_price' AS evaluation_method, o_orderpriority AS contract_scope_type, CASE WHEN o_orderkey % 2 = 1 THEN 'note ' || o_orderkey END AS notes,
    CASE WHEN o_orderkey % 3 = 0 THEN ['Sub ' || o_custkey, 'B'] END AS subcontractors, coalesce(o_orderkey % 4 = 0, false) AS is_multi_lot,
    CASE WHEN o_orderkey % 6 <> 0 THEN CAST(o_orderkey % 6 AS INTEGER) END AS lot_count FROM orders""",
)
def _(s, d):
    k = F.col("o_orderkey")

    def person(name, reg, price, out=False):
        return F.struct(
            name.alias("name"), F.lit(reg).cast("string").alias("registration_no"), price.cast("string").alias("suggested_price_eur"),
            (F.lit(out) & (k % 2 == 0)).alias("disqualified"), F.lit(" late ").alias("disqualification_reason"),
        )

    price = F.col("o_totalprice").cast("decimal(18,2)")
    people = F.array(
        person(F.lit("SIA  Čiekurs, reģ. Nr. 1"), "111", price), person(F.lit("eur"), None, price), person(F.lit("sia ciekurs,"), "222", price),
        person(F.concat("o_orderpriority", F.lit(" Būve")), " ", F.lit("x"), True),
    )
    people = F.transform(people, lambda p: p.withField("name", F.regexp_replace(p["name"], ",", "")))
    parsed = star.table(s, d, "orders").select(
        k.cast("string").alias("procurement_id"), _cases(k % 3, F.lit(" Completed"), F.lit("done"), F.lit(None).cast("string")).alias("procurement_status"),
        _cases(k % 4, F.lit("Čiekurs SIA"), F.concat("o_orderpriority", F.lit(" buve")), F.lit("Cits"), F.lit("  ")).alias("winner_name"),
        F.when(k % 4 == 1, "999").alias("winner_registration_no"), F.when(k % 4 == 1, "12 000,50").alias("winner_price_eur"), F.lit(" HIGH ").alias("confidence"),
        people.alias("participants"), F.date_format("o_orderdate", " dd.MM.yyyy").alias("bid_deadline"),
        F.when(k % 3 == 0, " ").otherwise(F.col("o_orderstatus")).alias("decision_date"), F.lit("own funds ").alias("funding_source"),
        F.when(k % 5 == 0, F.concat(F.lit("EU-"), k.cast("string"))).alias("eu_project_reference"), F.lit("lowest_price").alias("evaluation_method"),
        F.concat(F.lit(" "), "o_orderpriority").alias("contract_scope_type"), F.when(k % 2 == 1, F.concat(F.lit("note "), k.cast("string"))).otherwise("").alias("notes"),
        F.when(k % 3 == 0, F.array(F.concat(F.lit("Sub "), F.col("o_custkey").cast("string"), F.lit(" ")), F.lit(""), F.lit("B"))).when(k % 3 == 1, F.array(F.lit(""))).alias("subcontractors"),
        F.when(k % 4 != 1, k % 4 == 0).alias("is_multi_lot"), (k % 6).alias("lot_count"),
    )
    return outcomes.outcomes(parsed)


@query(
    "outcome_consortia",
    """SELECT CAST(o_orderkey AS VARCHAR) AS procurement_id, 'Joint ' || o_custkey AS name, unnest(['SIA ' || o_orderpriority, 'Partner']) AS member
    FROM orders WHERE o_orderkey % 3 <> 0""",
)
def _(s, d):
    """Consortium members of the cleaned participants, one row each."""
    k = F.col("o_orderkey")
    members = F.when(k % 3 != 0, F.array(F.concat(F.lit(" SIA "), "o_orderpriority"), F.lit(""), F.lit("Partner "))).otherwise(F.array(F.lit("")))
    person = F.struct(
        F.concat(F.lit("Joint "), F.col("o_custkey").cast("string")).alias("name"), F.lit("1").alias("registration_no"), F.lit("5").alias("suggested_price_eur"),
        F.lit(False).alias("disqualified"), F.lit("").alias("disqualification_reason"), members.alias("consortium_members"),
    )
    parsed = star.table(s, d, "orders").select(k.cast("string").alias("procurement_id"), F.array(person).alias("participants"))
    return outcomes.outcome_participants(parsed).select("procurement_id", "name", F.explode("consortium_members").alias("member"))


def _lot_people(s, d):
    """One document per order: two participants and two lots, as a parsed answer gives them."""
    k, price = F.col("o_orderkey"), F.col("o_totalprice")

    def person(name, lot, won):
        return F.struct(F.lit(name).alias("name"), F.lit(lot).cast("int").alias("lot_number"), won.alias("won_lot"), price.alias("suggested_price_eur"))

    def bid(name, value, won):
        return F.struct(F.lit(name).alias("name"), value.alias("suggested_price_eur"), won.alias("is_winner"))

    even = k % 2 == 0
    people = F.array(person("A", 1, even), person("B", 2, ~even), person("C", 1, even), person("D", 0, even))
    lot_list = F.array(
        F.struct(F.lit(1).alias("lot_number"), F.array(bid("A", price, even), bid("C", price - 1, ~even)).alias("participants")),
        F.struct(F.lit(2).alias("lot_number"), F.array(bid("A", price - 2, F.lit(True))).alias("participants")),
    )
    return star.table(s, d, "orders").select("o_orderkey", people.alias("people"), lot_list.alias("lots"))


@query(
    "lots_json",
    """SELECT o_orderkey, CAST(2 AS INTEGER) AS lots, CASE WHEN o_orderkey % 2 = 0 THEN 'C' END AS first_winner,
    CASE WHEN o_orderkey % 2 = 1 THEN 'B' END AS second_winner FROM orders""",
)
def _(s, d):
    text = _lot_people(s, d).select("o_orderkey", lots.lots_of_participants(F.col("people")).alias("t"))
    return text.select(
        "o_orderkey", F.json_array_length(F.get_json_object("t", "$.lots")).alias("lots"), F.get_json_object("t", "$.lots[0].winner").alias("first_winner"),
        F.get_json_object("t", "$.lots[1].winner").alias("second_winner"),
    )


@query(
    "lot_bids_in_document",
    """SELECT o_orderkey, name, price, bids, won FROM (SELECT o_orderkey, 'A' AS name, o_totalprice - 2 AS price, CAST(2 AS INTEGER) AS bids,
      CAST(CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS INTEGER) AS won FROM orders
    UNION ALL SELECT o_orderkey, 'B', o_totalprice, 0, 0 FROM orders
    UNION ALL SELECT o_orderkey, 'C', o_totalprice - 1, 1, CASE WHEN o_orderkey % 2 = 1 THEN 1 ELSE 0 END FROM orders
    UNION ALL SELECT o_orderkey, 'D', o_totalprice, 0, 0 FROM orders)""",
)
def _(s, d):
    merged = _lot_people(s, d).select("o_orderkey", F.explode(lots.with_lot_bids(F.col("people"), F.col("lots"))).alias("p"))
    return merged.select(
        "o_orderkey", "p.name", F.col("p.suggested_price_eur").alias("price"), F.size("p.lot_bids").alias("bids"), F.size("p.won_lots").alias("won")
    )


# --- messages ------------------------------------------------------------------------------------------------

_LANG = f"""lang AS (SELECT *, CASE WHEN regexp_matches(lower(text), '[{fixed.LATVIAN_LETTERS}]') THEN 'lv' WHEN e >= 2 AND e > l THEN 'en'
    WHEN l >= 1 AND l > e THEN 'lv' END AS language FROM (SELECT *,
      len(list_filter(regexp_extract_all(lower(text), '[a-z{fixed.LATVIAN_LETTERS}]+'), lambda w: w IN ({_sql_words(fixed.ENGLISH_HINTS)}))) AS e,
      len(list_filter(regexp_extract_all(lower(text), '[a-z{fixed.LATVIAN_LETTERS}]+'), lambda w: w IN ({_sql_words(fixed.LATVIAN_HINTS)}))) AS l
      FROM conversations))"""


@query("msg_language", f"WITH {_LANG} SELECT conv_id, turn, language FROM lang")
def _(s, d):
    return conversation.with_language(star.texts(s, d, "conversations", "conv_id")).select("conv_id", "turn", "language")


@query(
    "conversation_language",
    f"""WITH {_LANG}, u AS (SELECT conv_id, arg_max(coalesce(language, ''), turn) AS last_language FROM lang WHERE role = 'user' GROUP BY 1)
    SELECT conv_id, coalesce(nullif(last_language, ''), CASE conv_id % 3 WHEN 0 THEN 'en' END, 'lv') AS locale
    FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN u USING (conv_id)""",
)
def _(s, d):
    talks = star.texts(s, d, "conversations", "conv_id")
    stored = talks.select("conv_id").distinct().select("conv_id", F.when(F.col("conv_id") % 3 == 0, "en").otherwise("xx").alias("chat_locale"))
    return conversation.conversation_language(talks, "de", stored)
