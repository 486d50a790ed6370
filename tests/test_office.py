"""Office documents as a whole: reading limits in order, merged macros, findings and status, what is handed on."""

from pyspark.sql import functions as F

from sluicebox.operators import documents, office

PART = "doc_id long, ordinal int, part_name string, content_type string, bytes long, flag_bits int"
MODULE = "doc_id long, project int, module_no int, name string, source_bytes long, kind string, keyword string, keyword_at long"
WORD = [("[Content_Types].xml", "application/xml", 10, 0), ("word/document.xml", "x.wordprocessingml.document", 10, 0)]


def parts(spark, docs):
    return spark.createDataFrame([(d, k, *p) for d, own in docs.items() for k, p in enumerate(own)], PART)


def test_reading_stops_at_the_first_limit(spark):
    docs = {
        1: WORD, 2: WORD[1:], 3: [*WORD, WORD[1]], 4: [*WORD, ("a.xml", "t", 31, 0)], 5: [*WORD, ("a.xml", "t", 25, 0), ("b.xml", "t", 25, 0)], 6: [*WORD, ("a.bin", "t", 99, 1), ("n" * 513, "t", 1, 0)],
        7: [*WORD, ("a.xml", "t", 20, 0), ("word/vbaProject.bin", "t", 29, 0)], 8: [*WORD, ("a.xml", "t", 1, 0), ("b.xml", "t", 1, 0)], 9: [*WORD, *[(f"p{k}", "t", 1, 0) for k in range(6)]],
    }
    reads = office.package_reads(parts(spark, docs), most_parts=7, most_xml=3, xml_bytes=45, part_bytes=30, total_bytes=60)
    got = {r["doc_id"]: (r["is_package"], r["stop"], r["malformed"], r["encrypted"], r["reasons"]) for r in reads.collect()}
    assert got[1] == (True, None, False, False, []) and not got[2][0]
    assert got[3] == (True, "duplicate_zip_member", True, False, ["duplicate_zip_member"])
    assert [got[k][1] for k in (4, 5, 6, 7, 8, 9)] == ["member_actual_byte_limit", "member_actual_byte_limit", None, "total_actual_byte_limit", "xml_part_limit", "zip_entry_limit"]
    assert got[6] == (True, None, False, True, ["encrypted_zip_member", "zip_member_name_limit"])


def test_macros_are_read_up_to_the_limits_and_merged(spark):
    rows = [(1, 0, k, f"M{k}", 40, "AutoExec", "AutoOpen", 0) for k in range(1, 3)] + [(1, 0, 3, "M3", 40, "Suspicious", " Shell ", 0), (1, 0, 3, "M3", 40, "Suspicious", "CreateObject", 30), (1, 0, 4, "M4", 1, "AutoExec", "Document_Open", 0)]
    rows += [(1, 1, 1, "N1", 20, "Suspicious", "powershell", 0), (1, 1, 2, "N2", 20, "AutoExec", "Workbook_Open", 0), (2, 0, 1, "A", 7, "Suspicious", "nothing", 0)]
    projects = office.macro_projects(spark.createDataFrame(rows, MODULE), most_modules=3, source_bytes=100)
    got = {(r["doc_id"], r["project"]): r.asDict() for r in projects.collect()}
    first = got[1, 0]
    assert (first["modules"], first["bytes"], first["names"], first["triggers"], first["reasons"]) == (3, 100, ["M1", "M2", "M3"], ["autoopen"], ["vba_source_size_limit"])
    assert first["classes"] == [] or "com_object_creation" not in first["classes"]
    merged = {r["doc_id"]: r.asDict() for r in office.merged_macros(projects).collect()}
    assert (merged[1]["projects"], merged[1]["modules"], merged[1]["bytes"], merged[1]["names"]) == (2, 5, 140, ["M1", "M2", "M3", "N1", "N2"])
    assert merged[1]["triggers"] == ["autoopen", "workbook_open"] and "powershell" in merged[1]["classes"] and merged[2]["classes"] == []
    one = {r["doc_id"]: r.asDict() for r in office.merged_macros(projects, most_projects=1).collect()}
    assert one[1]["reasons"] == ["vba_project_count_limit", "vba_source_size_limit"] and one[1]["triggers"] == ["autoopen"]


def test_packages_with_their_status(spark):
    docs = {1: WORD, 2: WORD[1:], 3: [*WORD, WORD[1]], 4: WORD[:1], 5: [*WORD, ("word/vbaProject.bin", "application/vnd.ms-office.vbaProject", 5, 0), ("word/embeddings/a", "t", 5, 0), ("word/activeX/b", "t", 5, 0)], 6: [*WORD, ("z", "t", 1, 1)]}
    p = parts(spark, docs)
    links = spark.createDataFrame([(5, 2, 1)], "doc_id long, external long, templates long")
    macros = office.merged_macros(office.macro_projects(spark.createDataFrame([(5, 0, 1, "M", 9, "AutoExec", "AutoOpen", 0)], MODULE)))
    results, handed = office.packages(p, links, macros, office.package_reads(p))
    got = {r["doc_id"]: (r["detected_type"], r["findings"], r["status"], r["reasons"]) for r in results.collect()}
    assert [r["doc_id"] for r in handed.collect()] == [2]
    assert got[1] == ("OFFICE_WORD_OOXML", [], "COMPLETE", [])
    assert got[3] == ("OFFICE_UNKNOWN_OOXML", ["OFFICE_MALFORMED", "OFFICE_PARTIAL_ANALYSIS"], "MALFORMED", ["duplicate_zip_member"])
    assert got[4][2:] == ("MALFORMED", ["inconsistent_package_structure"])
    assert got[5] == ("OFFICE_WORD_OOXML", ["OFFICE_MACRO_ENABLED", "OFFICE_VBA_MACRO", "OFFICE_VBA_AUTOEXEC", "OFFICE_EXTERNAL_RELATIONSHIP", "OFFICE_EXTERNAL_TEMPLATE", "OFFICE_EMBEDDED_OBJECT", "OFFICE_ACTIVEX"], "COMPLETE", [])
    assert got[6][1:] == (["OFFICE_ENCRYPTED", "OFFICE_PARTIAL_ANALYSIS"], "PARTIAL", ["encrypted_zip_member"])


def test_compound_files_with_their_status(spark):
    entries = [(1, "OLE_COMPOUND", "WordDocument"), (2, "OLE_COMPOUND", "Data"), (3, "OLE_COMPOUND", "EncryptionInfo"), (3, "OLE_COMPOUND", "EncryptedPackage"), (4, "OLE_COMPOUND", "Macros/VBA/dir"), (5, "OLE_COMPOUND", "Workbook"), (5, "OLE_COMPOUND", "ObjectPool/_1"), (6, "ZIP", "WordDocument")]
    files = documents.compound_files(spark.createDataFrame(entries, "doc_id long, family string, path string"))
    macros = office.merged_macros(office.macro_projects(spark.createDataFrame([(5, 0, 1, "M", 9, "AutoExec", "AutoOpen", 0)], MODULE)))
    got = {r["doc_id"]: (r["detected_type"], r["findings"], r["status"], r["reasons"]) for r in office.compounds(files, macros).collect()}
    assert set(got) == {1, 3, 4, 5}
    assert got[1] == ("OFFICE_WORD_OLE", [], "COMPLETE", [])
    assert got[3] == ("OFFICE_UNKNOWN_OLE", ["OFFICE_ENCRYPTED", "OFFICE_PARTIAL_ANALYSIS"], "PARTIAL", ["office_encryption_prevents_inspection", "ole_application_unclassified"])
    assert got[4][1:3] == (["OFFICE_MACRO_ENABLED", "OFFICE_VBA_MACRO", "OFFICE_PARTIAL_ANALYSIS"], "PARTIAL")
    assert got[5] == ("OFFICE_EXCEL_OLE", ["OFFICE_MACRO_ENABLED", "OFFICE_VBA_MACRO", "OFFICE_VBA_AUTOEXEC", "OFFICE_EMBEDDED_OBJECT"], "COMPLETE", [])


def test_no_documents(spark):
    none = parts(spark, {1: WORD}).limit(0)
    macros = office.merged_macros(office.macro_projects(spark.createDataFrame([], MODULE)))
    results, handed = office.packages(none, spark.createDataFrame([], "doc_id long, external long, templates long"), macros, office.package_reads(none))
    assert results.select(F.count(F.lit(1))).first()[0] == 0 == handed.count()


def test_parts_modules_and_entries_are_read_few_times(spark):
    from sluicebox.plans import office_queries

    for query, reads in ((office_queries.o09_12_macro_evidence, 1), (office_queries.o13_office_packages, 3), (office_queries.o13_15_compound_results, 2)):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet [l_orderkey") <= reads, plan
