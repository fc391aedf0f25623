"""Text helpers, classification, merges, documents, messages and record flows."""

from __future__ import annotations

import unicodedata

import pytest
from pyspark.sql import functions as F

from tenderlake.functions import cleaning as c
from tenderlake.functions import fixed, jsonlists, labels, names
from tenderlake.operators import compare, conversation, lots, merge, outcomes, pages
from tenderlake.sources import landing
from tenderlake.sources.schemas import RESULTS, with_optional_columns


def values(spark, column, inputs, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r.y for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


CASES = [
    (names.folded_lower, ["Ēka Šķūnis"], ["eka skunis"]),
    (c.cpv_code, ['="45000000-7 Būvdarbi"', "x"], ["45000000-7", None]),
    (c.reg_number, ["LV40003356530", " 4000 3356530 ", "123", None], ["40003356530", "40003356530", None, None]),
    (labels.lot_count_in_text, ["1. daļa\n2. daļa\n3. daļa", "sastāv no 5 daļām", "1. daļa"], [3, 5, 1]),
    (c.comma_float, ["1,5", "abc", "1d", ""], [1.5, None, None, None]),
    (c.cell_float, ["12 000,50", '="7"', None], [12000.5, 7.0, None]),
    (c.whole_number, ["3", "3.7"], [3, None]),
    (c.truncated_int, ["3.7", "x"], [3, None]),
    (c.unwrap_loose, ['="12"', '="12', None, "a"], ["12", "12", "", "a"]),
    (c.unwrap_strict, ['="12"', '="12', '="', " a "], ["12", '="12', None, "a"]),
    (c.clean_cell, ["='x'", ' ="y" ', '="'], ["x", "y", ""]),
    (c.portal_flag, ["jā", "kas", "", None], [True, False, None, None]),
    (c.loose_flag, ["jā", "NĒ", "kas"], [True, False, None]),
    (names.party_name, ['SIA "Acme"', "Acme SIA", "", None, "Pašvaldības SIA Ēka"], ["ACME", "ACME", fixed.NO_PARTY, fixed.NO_PARTY, "PASVALDIBAS EKA"]),
    (names.without_noise, ["Acme SIA, reģ. Nr. 4", "Acme 40003356530 x", "Acme RG 1", "Orga"], ["Acme SIA,", "Acme", "Acme", "Orga"]),
    (names.match_key, ['SIA "Čiekurs-Būve" (reģ. 1)', "AS Nams"], ["ciekurs buve", "nams"]),
    (names.plausible, ["Acme", "ab", "1234", "EUR", "eiro"], [True, False, False, False, False]),
    (names.address_key, ["Rīgas iela 1, LV-1001, Rīga."], ["rigas iela 1 riga"]),
    (labels.location_bucket, [None, "-", "LV-1050, Brīvības iela 2", "Brīvības iela 2, Ogre"], [fixed.NO_LOCATION, fixed.NO_LOCATION, "LV-1050", "Ogre"]),
    (labels.planning_region, ["Balvu novads", "Latvija", "Mars", "Jelgava"], ["Vidzeme", "Visa Latvija", "Nezināms", "Zemgale"]),
    (labels.cpv_category, ["45210000-2", "99000000-1", None, '="71'], ["Celtniecība", "CPV 99xxx", "unknown", "Inženierpakalpojumi"]),
    (labels.finished_status, ["Līgums noslēgts", "atvērts", None], [True, False, False]),
    (jsonlists.list_length, ["[1,2]", '{"a":1}', "x"], [2, None, None]),
    (labels.first_json_object, ['```json\n{"a": 1}\n```', 'so {"a": {"b": 2}} end', "[1]", "no"], ['{"a": 1}', '{"a": {"b": 2}}', None, None]),
    (labels.message_language, ["Looking for training services for schools next month", "Meklēju apmācības pakalpojumus nākamajam mēnesim", "SAP", ""], ["en", "lv", None, None]),
    (c.money_text, ["1.005", "12", "abc  d", None], ["1.01", "12.00", "abc d", None]),
]


@pytest.mark.parametrize("case", CASES, ids=lambda x: x[0].__name__)
def test_column_helpers(spark, case):
    column, inputs, wanted = case
    assert values(spark, column, inputs) == wanted


def test_mixed_lists_keep_their_objects(spark):
    got = values(spark, jsonlists.participants, ['[{"name": "A", "suggested_price_eur": 1.5}, 3, "x"]', '{"name": "A"}', "bad", None])
    assert [len(x) for x in got] == [1, 0, 0, 0] and float(got[0][0].price) == 1.5


def test_decision_lag(spark):
    df = spark.createDataFrame([("2024-01-05T10:00:00", "2024-01-08"), ("1.2.2024 9:30", "03.02.2024"), ("05.01.2024", "x")], "a string, b string")
    assert [r.lag for r in df.select(c.decision_lag(F.col("a"), F.col("b")).alias("lag")).collect()] == [3, 2, None]


def test_fold_any_script(spark):
    texts = ["ﬁne Ēka", None, "Зелёный Край", "ﬁrma Άλφα", "№5 ½ Ǆ", "한국 ｆｕｌｌ", "e\u0301\u0327 x\u0300", "日本 ㍿ \U0001d400", ""]
    plain = [None if t is None else "".join(x for x in unicodedata.normalize("NFKD", t) if not unicodedata.combining(x)) for t in texts]
    assert values(spark, names.fold, texts) == plain
    every = [chr(i) for i in range(0x80, 0x20000, 37) if not 0xD800 <= i < 0xE000]
    assert values(spark, names.fold, every) == ["".join(x for x in unicodedata.normalize("NFKD", t) if not unicodedata.combining(x)) for t in every]


def test_classification(spark):
    rows = [
        ("Building", "Design Only", "unknown", 150000.0, "building_design", "large"),
        ("building", "build_only", "new_build", 900000.0, "building_new_build", "small"),
        ("building", "supervision_only", "unknown", None, "building_supervision", "unknown"),
        ("infrastructure", "build_only", "repair", None, "infrastructure_renovation_repair", "unknown"),
        ("maintenance_service", "service_only", "cleaning", None, "maintenance_cleaning_service", "unknown"),
        ("non_construction", "unknown", "unknown", None, "non_construction", "unknown"),
    ]
    df = spark.createDataFrame(rows, "domain string, scope_type string, work_type string, estimated_value_eur double, want string, scale string").withColumn("asset_scale", F.lit(None).cast("string"))
    done = outcomes.classify(df, {"default": 1000000, "building_design": 100000}).collect()
    assert all(r.want == r.classification_final_category and r.scale == r.classification_asset_scale for r in done)


def test_merge_rules(spark):
    rows = [
        (1, 100.0, None, None, "A", "B1", 2023), (2, None, 90.0, "2024-01-05", None, "B2", 2024), (3, 80.0, 70.0, None, "C", None, 2025),
    ]
    ddl = "seq long, contract_value_eur double, contract_value_original_eur double, contract_signed_date string, procurement_title string, buyer string, source_year int"
    batch = spark.createDataFrame(rows, ddl).withColumns({"procurement_id": F.lit("P1"), "winner_reg_number": F.lit("40000000001")})
    empty = with_optional_columns(spark.createDataFrame([], "procurement_id string"), RESULTS)
    whole = merge.merge(empty, batch, merge.RESULT_KEYS, merge.RESULT_RULES).first()
    assert (whole.contract_value_eur, whole.contract_value_original_eur, whole.contract_signed_date) == (100.0, 90.0, "2024-01-05")
    assert (whole.procurement_title, whole.buyer, whole.source_year) == ("C", "B1", 2025)
    step = empty
    for i in (1, 2, 3):
        step = with_optional_columns(merge.merge(step, batch.where(F.col("seq") == i), merge.RESULT_KEYS, merge.RESULT_RULES), RESULTS)
    stepped = step.first()
    assert all(stepped[x] == whole[x] for x in whole.asDict())


def test_record_upsert_keeps_one_row(spark):
    ddl = "procurement_id string, procurement_url string, classification_reason string, raw_api_record_count int, seq long"
    first = spark.createDataFrame([("123", "u", "First", 2, 1)], ddl)
    second = spark.createDataFrame([("123", "u", "Updated reason", 2, 2), (None, None, "lost", 0, 3)], ddl)
    stored = merge.merge_records(first.limit(0).withColumn("procurement_record_key", F.lit("")), first)
    rows = merge.merge_records(stored, second).collect()
    assert [(r.procurement_record_key, r.classification_reason, r.raw_api_record_count) for r in rows] == [("id:123", "Updated reason", 2)]


def test_lot_aware_estimate(spark):
    base = {"_id": "1", "Iepirkuma_ID": "7", "Hipersaite_EIS_kura_pieejams_zinojums": None, "Ligumcenas_valuta": "", "Dalas_ligumcenas_valuta": None}
    rows = []
    for i, (project, lot, value) in enumerate([("100", "1", "30"), ("120", "1", "50"), (None, "2", "90")]):
        rows.append({**base, "_id": str(i), "Planota_ligumcena": project, "Iepirkuma_dalas_nr": lot, "Dalas_planota_ligumcena": value})
    columns = list(rows[0]) + ["Planota_ligumcena_lidz", "Planota_ligumcena_no", "Dalas_planota_ligumcena_lidz", "Dalas_planota_ligumcena_no"]
    raw = spark.createDataFrame([tuple(r.get(x) for x in columns) for r in rows], ", ".join(f"`{x}` string" for x in columns))
    got = lots.estimated_values(raw).first()
    assert float(got.estimated_value_eur) == 140.0 and got.estimated_value_source == "max(project, lots_sum)" and got.raw_api_record_count == 3


PAGE = """<x>var ActualDocuments_items = [{"Id":1,"Title":"a ] \\" b"},{"Id":2}];</x>"""


def test_embedded_items_and_page_flags(spark):
    df = spark.createDataFrame([(PAGE,), ("Pārbaude pret robotiem",), ('<input name="__RequestVerificationToken" type="hidden" value="token123">',), ("<html></html>",)], "html string")
    ids = [[d.Id for d in r.docs] for r in pages.documents(df, "ActualDocuments_items").collect()]
    assert ids == [["1", "2"], [], [], []]
    facts_rows = pages.page_facts(df).collect()
    assert [r.is_captcha for r in facts_rows] == [False, True, False, False] and [r.csrf_token for r in facts_rows] == [None, None, "token123", None]


def test_final_report_choice(spark):
    doc = "array<struct<Id:int,TypeCode:string,TypeTitle:string,Title:string>>"
    summary = (101, "X", "", "Atvēršanas sanāksmes finanšu piedāvājumu kopsavilkums")
    lists = [[summary], [(201, *summary[1:]), (202, "PRCFINSMR", "", "a")], [(1, "", "", "Ziņojums x")], [(2, "", "", "cits")]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], f"i int, docs {doc}").orderBy("i")
    assert [r.id for r in df.select(pages.final_report(F.col("docs"))["Id"].alias("id")).collect()] == [101, 202, 1, None]


def test_report_status(spark):
    ddl = "procurement_status string, local_file string, document_found boolean, fetch_error string"
    rows = [("x", None, True, None), ("Pārtraukts", None, None, None), ("x", None, False, "eps_publication"), ("x", "a.pdf", None, None), ("x", None, False, "download_error:1")]
    got = [(r.report_download_status, r.report_selection_method) for r in pages.report_status(spark.createDataFrame(rows, ddl)).collect()]
    assert got == [
        ("downloaded", "select_final_report_document"), ("skipped_status", "skipped_by_procurement_status"), ("skipped_eps_publication", "page_type_detection"),
        ("already_present", "existing_local_file"), ("failed", None),
    ]


def test_last_user_message_sets_the_language(spark):
    rows = [(1, 0, "user", "Meklēju apmācības"), (1, 1, "user", "Looking for software in the region"), (2, 0, "user", "SAP"), (3, 0, "assistant", "Looking for the")]
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    stored = spark.createDataFrame([(1, "lv"), (2, "en")], "conv_id long, chat_locale string")
    assert {r.conv_id: r.locale for r in conversation.conversation_language(talks, "lv", stored).collect()} == {1: "en", 2: "en", 3: "lv"}


def test_lot_sections_and_assignment(spark):
    df = spark.createDataFrame([(1, "ievads 1. daļa: Acme sola 2. daļa: Beta sola", 2), (2, "nav", 3)], "id int, text string, n int")
    cut = outcomes.lot_sections(df, "text", "n")
    assert [(r.id, r.lot_number, r.text_section.strip()) for r in cut.orderBy("id", "pos").collect()] == [(1, 1, "Acme sola"), (1, 2, "Beta sola"), (2, 1, ""), (2, 2, ""), (2, 3, "")]
    who = spark.createDataFrame([(1, "Beta"), (1, "Gamma")], "id int, name string")
    assert {r.name: r.lot_number for r in outcomes.assign_lots(who, cut, "id").collect()} == {"Beta": 2, "Gamma": None}


def test_comparison_of_lists_ignores_order_and_legal_form(spark):
    a = '[{"name": "SIA B", "registration_no": "2"}, {"name": "A", "registration_no": "1"}]'
    b = '[{"participant_name": "a", "reg_no": "1"}, {"name": "B", "registration_no": "2"}]'
    got = values(spark, compare.canonical_list, [a, b, "[]", "", "{}", "Acme"])
    assert got[0] == got[1] and got[2] == "[]" and got[3] is None and got[4] is None and "ACME" in got[5]


def test_landing_round_trip_and_year_replacement(spark, tmp_path):
    spark.createDataFrame([("1", 2023), ("2", 2024)], "a string, source_year int").write.partitionBy("source_year").parquet(str(tmp_path / "t"))
    landing.replace_years(spark.createDataFrame([("9", 2024)], "a string, source_year int"), str(tmp_path / "t"))
    kept = spark.read.parquet(str(tmp_path / "t")).collect()
    assert sorted((r.a, r.source_year) for r in kept) == [("1", 2023), ("9", 2024)]
    (tmp_path / "p.jsonl").write_text('{"a": "x"}\n7\n\n{"a": "y"}\n', encoding="utf-8")
    schema = spark.createDataFrame([], "a string").schema
    assert sorted(r.a for r in landing.read_project_lines(spark, str(tmp_path / "p.jsonl"), schema).collect()) == ["x", "y"]


def test_owners_file(spark, tmp_path):
    (tmp_path / "o.csv").write_text("legal_entity_registration_number;forename;surname\n4;Anna;Ozola\n4;;Liepa\n;X;Y\n5;;\n", encoding="utf-8")
    got = landing.owners_by_reg(landing.read_owners_csv(spark, str(tmp_path / "o.csv"))).collect()
    assert sorted((r.reg, r.owner) for r in got) == [("4", "Anna Ozola"), ("4", "Liepa")]


def test_outcomes_of_single_and_shared_ids_agree(spark):
    from tenderlake.operators import outcomes

    person = "struct<name string, registration_no string, suggested_price_eur string, disqualified boolean, disqualification_reason string>"
    schema = f"procurement_id string, procurement_status string, winner_name string, winner_registration_no string, winner_price_eur string, confidence string, participants array<{person}>"
    people = [("SIA Čiekurs", "1", "5", None, " late "), ("sia ciekurs", "2", "6", True, None), (None, "3", None, None, None), ("Cits", None, "x", True, "")]
    kinds = [(" Completed", "Čiekurs", None, None, " HIGH ", people), ("odd", "Cits AS", "9", "1,5", None, people[::-1]), (None, None, None, None, None, []), ("x", "Nobody", None, None, None, None)]
    rows = [(f"p{i}", *k) for i, k in enumerate(kinds)] + [(None, *kinds[0])] * 2
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    alone = outcomes.outcomes(spark.createDataFrame(rows, schema))
    # an answer whose id stands once is decided by itself
    assert "Exchange" not in plan(alone) and "Join" not in plan(alone)
    shared = outcomes._outcomes_of_ids(spark.createDataFrame(rows, schema))
    assert alone.dtypes == shared.dtypes and sorted(alone.collect(), key=repr) == sorted(shared.collect(), key=repr)
    twice = rows + rows[:1]
    both = outcomes.outcomes(spark.createDataFrame(twice, schema)).collect()
    assert sorted(both, key=repr) == sorted(outcomes._outcomes_of_ids(spark.createDataFrame(twice, schema)).collect(), key=repr)
    first = next(r for r in alone.collect() if r.procurement_id == "p0")
    assert (first.participants, first.disqualified, first.winner_name, first.winner_registration_no, first.winner_price_eur) == (2, 1, "SIA Čiekurs", "1", 5.0)
