"""Views that derive the jobs' inputs from the given tables, in one text for both SQL dialects.

`SHA(x)`, `BYTES(x)`, `MICROS(x)` stand for the dialects' digest, byte length and microseconds since 1970,
`EACH(LISTED(..))` for a row of each value.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import dims

_CODES = [r[0] for r in dims.finding_rows()]
_CODE_AT = "CASE {} " + " ".join(f"WHEN {k} THEN '{c}'" for k, c in enumerate(_CODES)) + " END"

VIEWS = {
    "v_scan": """
        SELECT doc_id AS scan_id, concat(source, '_', doc_id, CASE doc_id % 11 WHEN 0 THEN '.pdf' WHEN 1 THEN '.docx' WHEN 2 THEN '.TXT' WHEN 3 THEN '.pdf.exe' WHEN 4 THEN '.zip' WHEN 5 THEN '.docm'
                 WHEN 6 THEN '.a.docx.js' WHEN 7 THEN '' WHEN 8 THEN '.xlsx/' WHEN 9 THEN '\u202egnp.exe' ELSE '.csv' END) AS filename,
               CASE doc_id % 6 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'Application/Zip' WHEN 2 THEN 'text/plain' WHEN 3 THEN 'application/x-dosexec' WHEN 4 THEN 'application/octet-stream' ELSE 'application/vnd.openxmlformats-officedocument' END AS mime,
               CASE doc_id % 6 WHEN 2 THEN 'UTF-8 text' WHEN 4 THEN CASE WHEN doc_id % 4 = 0 THEN 'CDFV2 encrypted' ELSE 'data' END ELSE 'x' END AS description,
               CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN ' Text/Plain; charset=utf-8 ' WHEN 2 THEN 'application/octet-stream' WHEN 3 THEN ';' ELSE 'application/pdf' END AS claimed,
               BYTES(text) AS size_bytes, SHA(text) AS sha, SHA(concat('key', doc_id)) AS digest, text, source, lang,
               CASE WHEN doc_id % 29 = 0 THEN 'ANALYZING' WHEN doc_id % 31 = 0 THEN 'QUARANTINED' ELSE 'COMPLETED' END AS state,
               CASE WHEN doc_id % 43 = 0 THEN NULL WHEN doc_id % 37 = 0 THEN 'FAILED' WHEN doc_id % 41 = 0 THEN 'TIMEOUT' WHEN doc_id % 47 = 0 THEN 'UNSUPPORTED' ELSE 'SUCCESS' END AS status,
               CASE WHEN doc_id % 17 = 0 THEN NULL WHEN doc_id % 19 = 0 THEN 'UNKNOWN' WHEN doc_id % 2 = 0 THEN 'PDF' ELSE 'OFFICE_WORD_OOXML' END AS detected_type,
               CASE WHEN doc_id % 53 = 0 THEN 'WORKER_LOST' END AS failure_code,
               doc_id * 7919 % 100000 AS created_at FROM documents""",
    "v_finding": f"""
        SELECT scan_id, code FROM (SELECT doc_id AS scan_id, EACH(LISTED(CASE WHEN doc_id % 3 = 0 THEN {_CODE_AT.format("doc_id % 45")} END, CASE WHEN doc_id % 5 = 0 THEN {_CODE_AT.format("doc_id * 7 % 45")} END, CASE WHEN doc_id % 14 = 0 THEN 'PDF_JAVASCRIPT' END, CASE WHEN doc_id % 14 = 0 THEN 'PDF_OPEN_ACTION' END,
          CASE WHEN doc_id % 22 = 0 THEN 'FILE_TYPE_MISMATCH' END, CASE WHEN doc_id % 44 = 0 THEN 'FILE_DOUBLE_EXTENSION' END, CASE WHEN doc_id % 97 = 0 THEN 'NOT_REGISTERED' END)) AS code FROM documents) each_code WHERE code IS NOT NULL""",
    "v_member": """
        SELECT l_orderkey - l_orderkey % 64 AS root_id, l_orderkey AS container_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_returnflag, l_linestatus, l_shipdate) AS ordinal,
               CASE l_partkey % 13 WHEN 0 THEN '../up.txt' WHEN 1 THEN '/etc/x.doc' WHEN 2 THEN 'C:\\a.xls' WHEN 3 THEN 'a//./b.txt' WHEN 4 THEN 'a/b.txt' WHEN 5 THEN 'run.EXE' WHEN 6 THEN 'bill.pdf.js' WHEN 7 THEN 'x\u202ecod.scr'
                 WHEN 8 THEN 'dir\\' WHEN 9 THEN 'q/.bashrc' WHEN 10 THEN 'm.docm' WHEN 11 THEN CASE WHEN l_suppkey % 2 = 0 THEN 'caf\u00e9.txt' ELSE 'cafe\u0301.txt' END ELSE concat('part', l_partkey % 4, '.dat') END AS name,
               l_partkey % 13 = 8 AS is_dir, CASE WHEN l_suppkey % 4 = 0 THEN 3 ELSE 0 END AS create_system,
               CASE WHEN l_suppkey % 8 = 0 THEN CAST(2717843456 AS BIGINT) ELSE CAST(2175008768 AS BIGINT) END AS external_attr,
               CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS flag_bits, CASE WHEN l_linestatus = 'F' AND l_partkey % 3 = 0 THEN 9 ELSE 8 END AS compress_type,
               CAST(l_quantity AS BIGINT) * CASE WHEN l_orderkey % 3 = 0 THEN 1000000 ELSE 20000 END AS actual_bytes FROM lineitem""",
    "v_container": """
        SELECT o_orderkey - o_orderkey % 64 AS root_id, o_orderkey AS container_id, CASE WHEN o_orderkey % 64 > 0 THEN o_orderkey - o_orderkey % 64 + CAST((o_orderkey % 64 - 1 - (o_orderkey % 64 - 1) % 2) / 2 AS BIGINT) END AS parent_id,
               CASE WHEN o_orderkey % 64 > 0 THEN 1 + (o_orderkey % 64 - 1) % 2 END AS parent_ordinal, o_orderkey % 7 * 3000000 AS bytes, concat('n', o_orderkey % 23) AS sha, o_orderkey % 37 = 5 AS malformed FROM orders""",
    "v_event": "SELECT event_id, user_id, event_type, value, props, MICROS(ts) AS us FROM events",
    "v_attempt": """
        SELECT event_id, user_id % 10 AS tenant, concat('a', user_id % 10, '-', event_id % 3) AS source, concat('u', user_id) AS username, event_type = 'purchase' AS success, CAST((MICROS(ts) - MICROS(ts) % 60) / 60 AS BIGINT) AS us FROM events""",
    "v_session_event": """
        SELECT event_id, user_id AS actor_id, user_id * 10 + event_id % 2 AS session_id, CASE WHEN event_type = 'signup' THEN 'open' WHEN event_type = 'error' AND event_id % 4 = 0 THEN 'revoke' WHEN event_type = 'purchase' AND event_id % 6 = 0 THEN 'deactivate'
               WHEN event_type = 'purchase' AND event_id % 2 = 1 THEN 'activate' ELSE 'use' END AS kind, CAST((MICROS(ts) - MICROS(ts) % 100) / 100 AS BIGINT) AS us FROM events""",
    "v_change": "SELECT event_id, user_id AS scan_id, CASE WHEN event_type IN ('signup', 'view') THEN 'ANALYZING' ELSE 'COMPLETED' END AS state, CAST((MICROS(ts) - MICROS(ts) % 60) / 60 AS BIGINT) AS us FROM events",
    "v_operator": "SELECT c_custkey AS operator_id, lower(c_name) AS username, CASE WHEN c_custkey % 9 = 0 THEN 'ADMIN' ELSE 'OPERATOR' END AS role, c_custkey % 4 <> 0 AS active FROM customer",
    "v_listing": """
        SELECT 'documents' AS area, concat('d', doc_id) AS name, BYTES(text) AS size_bytes, CASE WHEN doc_id % 23 = 0 THEN SHA('x') ELSE SHA(text) END AS sha, CASE WHEN doc_id % 2 = 0 THEN 256 ELSE 511 END AS mode, doc_id AS modified_at FROM documents WHERE doc_id % 17 <> 0
        UNION ALL SELECT 'documents', concat('b', item_id), BYTES(text), SHA(text), 384, item_id FROM benchmark
        UNION ALL SELECT 'temp', concat('.upload-', item_id, CASE WHEN item_id % 3 = 0 THEN '.tmp' ELSE '.part' END), BYTES(text), SHA(text), CASE WHEN item_id % 2 = 0 THEN 384 ELSE 420 END, item_id FROM benchmark""",
    "v_action": """
        SELECT conv_id AS doc_id, turn AS action_id, CASE WHEN turn % 5 = 4 THEN NULL ELSE turn + 1 END AS next_id, CASE (conv_id + turn) % 7 WHEN 0 THEN 'JavaScript' WHEN 1 THEN 'Launch' WHEN 2 THEN 'URI' WHEN 3 THEN 'SubmitForm' WHEN 4 THEN concat('X', turn) ELSE 'GoTo' END AS subtype,
               CASE turn % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'page' ELSE 'form' END AS source, conv_id % 5 AS holder_id, CASE WHEN conv_id % 3 = 0 THEN concat('HTTP://Host', conv_id % 9, '.example.com:80/p?q=', turn) WHEN conv_id % 3 = 1 THEN '\\\\srv\\share' ELSE 'no target' END AS target FROM conversations""",
    "v_relationship": """
        SELECT page_id - page_id % 40 AS doc_id, page_id AS ordinal, CASE WHEN page_id % 44 = 0 THEN './word//document.xml' WHEN page_id % 22 = 0 THEN 'xl/workbook.xml' ELSE url END AS target, CASE WHEN page_id % 22 = 0 THEN 'http://x/officeDocument' WHEN page_id % 7 = 0 THEN 'http://x/attachedTemplate' WHEN page_id % 2 = 0 THEN 'http://x/hyperlink' ELSE 'http://x/image' END AS rel_type,
               CASE WHEN page_id % 3 = 0 THEN 'External' WHEN page_id % 3 = 1 THEN 'EXTERNAL' ELSE 'Internal' END AS target_mode, CASE WHEN page_id % 11 = 0 THEN '' ELSE 'word/document.xml' END AS source_part FROM pages""",
    "v_part": """
        SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_returnflag, l_linestatus, l_shipdate) AS ordinal,
               CASE l_partkey % 7 WHEN 0 THEN 'word/document.xml' WHEN 1 THEN 'xl/workbook.xml' WHEN 2 THEN 'word/embeddings/o.bin' WHEN 3 THEN 'word/activeX/a.xml' WHEN 4 THEN 'word/vbaProject.bin' WHEN 5 THEN '[Content_Types].xml' ELSE concat('p', l_partkey % 9) END AS part_name,
               CASE WHEN l_partkey % 7 = 0 THEN CASE WHEN l_suppkey % 5 = 0 THEN 'application/x-other' ELSE 'application/wordprocessingml.macroEnabled' END WHEN l_partkey % 7 = 1 THEN 'application/spreadsheetml' WHEN l_suppkey % 6 = 0 THEN 'application/vnd.ms-office.vbaProject' ELSE 'application/xml' END AS content_type,
               CAST(l_quantity AS BIGINT) * 300000 AS bytes FROM lineitem""",
    "v_module": """
        SELECT l_orderkey - l_orderkey % 3 AS doc_id, l_suppkey % 2 AS project, row_number() OVER (PARTITION BY l_orderkey - l_orderkey % 3, l_suppkey % 2 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_returnflag, l_linestatus, l_shipdate) AS module_no, concat('M', l_partkey % 9) AS name,
               CAST(l_quantity AS BIGINT) * 40000 AS source_bytes, CASE WHEN l_partkey % 3 = 0 THEN 'AutoExec' ELSE 'Suspicious' END AS kind, CASE l_partkey % 7 WHEN 0 THEN 'AutoOpen' WHEN 1 THEN ' Shell ' WHEN 2 THEN 'document_open' WHEN 3 THEN 'PowerShell' WHEN 4 THEN 'CreateObject' WHEN 5 THEN 'Run' ELSE 'Dim' END AS keyword,
               l_suppkey % 5 * 200000 AS keyword_at FROM lineitem""",
    "v_package": """
        SELECT l_orderkey AS doc_id, l_linenumber AS ordinal, CASE WHEN l_orderkey % 6 = 1 AND l_linenumber = 2 THEN 'a.xml' WHEN l_linenumber = 1 THEN CASE WHEN l_orderkey % 13 = 2 THEN 'data.bin' ELSE '[Content_Types].xml' END WHEN l_linenumber = 2 THEN CASE WHEN l_orderkey % 2 = 0 THEN 'word/document.xml' ELSE 'xl/workbook.xml' END
                 WHEN l_partkey % 5 = 0 THEN concat('word/embeddings/o', l_linenumber) WHEN l_partkey % 5 = 1 THEN concat('xl/activeX/a', l_linenumber) WHEN l_partkey % 5 = 2 THEN CASE WHEN l_linenumber % 2 = 0 THEN 'word/vbaProject.bin' ELSE 'xl/vbaProject.bin' END WHEN l_partkey % 5 = 3 THEN concat('word/p', l_linenumber, '.xml') ELSE concat(repeat('n', CASE WHEN l_suppkey % 9 = 0 THEN 513 ELSE 5 END), l_linenumber) END AS part_name,
               CASE WHEN l_linenumber = 2 THEN CASE WHEN l_orderkey % 2 = 0 THEN 'application/wordprocessingml' ELSE 'application/spreadsheetml.macroEnabled' END WHEN l_partkey % 5 = 2 THEN 'application/vnd.ms-office.vbaProject' ELSE 'application/xml' END AS content_type, CAST(l_quantity AS BIGINT) * 60000 AS bytes, CASE WHEN l_orderkey % 17 = 3 AND l_linenumber = 3 THEN 1 ELSE 0 END AS flag_bits FROM lineitem""",
    "v_link": "SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 5 < 2 THEN o_orderkey % 5 ELSE 0 END AS external, CASE WHEN o_orderkey % 10 = 1 THEN 1 ELSE 0 END AS templates FROM orders WHERE o_orderkey % 5 < 3",
    "v_keyword": """
        SELECT conv_id AS doc_id, turn AS module, CASE WHEN role = 'user' THEN 'AutoExec' ELSE 'Suspicious' END AS kind, CASE (conv_id + turn) % 6 WHEN 0 THEN 'AutoOpen' WHEN 1 THEN ' Shell ' WHEN 2 THEN 'document_open' WHEN 3 THEN 'PowerShell' WHEN 4 THEN 'CreateObject' ELSE 'Dim' END AS keyword, BYTES(text) * 1000 AS source_bytes FROM conversations""",
    "v_ole_entry": """
        SELECT l_orderkey AS doc_id, CASE l_partkey % 17 WHEN 0 THEN 'WordDocument' WHEN 1 THEN 'Workbook' WHEN 2 THEN 'PowerPoint Document' WHEN 3 THEN 'EncryptionInfo' WHEN 4 THEN 'EncryptedPackage' WHEN 5 THEN concat('ObjectPool/_', l_suppkey % 9)
                 WHEN 6 THEN concat('A', l_suppkey % 5, '/Package') WHEN 7 THEN 'Macros/VBA/dir' WHEN 8 THEN 'VBA/dir' WHEN 9 THEN concat('Ctls/c', l_suppkey % 4) WHEN 10 THEN concat('x/ActiveX/', l_suppkey % 3) WHEN 11 THEN 'Book' ELSE concat('Data', l_partkey % 5) END AS path,
               CASE WHEN l_orderkey % 3 = 0 THEN 'OOXML_CANDIDATE' ELSE 'OLE_COMPOUND' END AS family FROM lineitem""",
    "v_rerun": """
        SELECT doc_id AS case_id, CASE WHEN doc_id % 13 = 0 THEN NULL WHEN BYTES(text) % 10 = 0 THEN 'REVIEW' WHEN doc_id % 5 = 0 THEN 'ALLOW' WHEN doc_id % 5 = 1 THEN 'BLOCK' WHEN doc_id % 5 = 2 THEN 'REVIEW' ELSE 'QUARANTINE' END AS decision,
               CASE WHEN BYTES(text) % 21 = 0 THEN 'TIMEOUT' ELSE 'SUCCESS' END AS worker_status, doc_id * 41 % 500 AS latency_ms FROM documents WHERE doc_id % 10 <> 4""",
    "v_artifact": """
        SELECT doc_id AS artifact_id, doc_id - doc_id % 24 AS scan_id, doc_id + 1 AS derived_scan_id, CASE WHEN doc_id % 36 = 0 THEN 'THUMBNAIL' ELSE 'CLEANED' END AS artifact_type, CASE WHEN doc_id % 60 = 0 THEN 'k0' ELSE concat('k', doc_id) END AS storage_key, SHA(text) AS sha,
               BYTES(text) AS size_bytes, doc_id % 4 AS fingerprint, CASE WHEN doc_id % 5 = 0 THEN '1.0.1' ELSE '1.0.2' END AS policy_version, doc_id * 31 % 1000 AS created_at FROM documents WHERE doc_id % 6 = 0""",
    "v_lineage": """
        SELECT doc_id AS scan_id, CASE WHEN doc_id % 41 = 0 THEN -1 WHEN first_id < doc_id THEN first_id END AS parent_id, sha FROM (SELECT doc_id, SHA(text) AS sha, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents) t""",
    "v_record": """
        SELECT 2 * doc_id AS scan_id, 'UPLOAD' AS origin, CAST(NULL AS BIGINT) AS parent_scan_id, CASE WHEN doc_id % 17 = 3 THEN 'ZIP' ELSE 'PDF' END AS detected_type, CASE WHEN doc_id % 19 = 4 THEN 'FAILED' ELSE 'SUCCESS' END AS worker_status,
               CASE WHEN doc_id % 23 = 5 THEN 'ANALYZING' WHEN doc_id % 2 = 0 THEN 'COMPLETED' ELSE 'QUARANTINED' END AS state, CASE WHEN doc_id % 11 = 0 THEN 'ALLOW' WHEN doc_id % 11 = 1 THEN 'BLOCK' WHEN doc_id % 11 = 2 THEN NULL WHEN doc_id % 3 = 0 THEN 'QUARANTINE' ELSE 'REVIEW' END AS decision,
               doc_id % 11 = 0 AS release_eligible, SHA(text) AS sha, BYTES(text) AS size_bytes, '1.0.2' AS policy_version, SHA('policy') AS policy_fingerprint, CASE WHEN doc_id % 43 = 6 THEN '../x' ELSE concat('d', doc_id) END AS storage_key,
               CASE WHEN doc_id % 37 = 11 THEN NULL ELSE concat('{"analysis_complete":', CASE WHEN doc_id % 29 = 9 THEN 'false' ELSE 'true' END, ',"decision":"', CASE WHEN doc_id % 31 = 10 THEN 'BLOCK' ELSE 'REVIEW' END, '","hard_block_reasons":', CASE WHEN doc_id % 31 = 10 THEN '["MALWARE"]' ELSE '[]' END,
                 ',"mandatory_quarantine_reasons":[],"policy_fingerprint":"', SHA('policy'), '","policy_version":"1.0.2","release_eligible":false,"risk_band":"LOW","risk_score":', doc_id % 101, '}') END AS evaluation,
               CASE WHEN doc_id % 13 = 7 THEN 'PDF_ENCRYPTED,PDF_URI' WHEN doc_id % 13 = 8 THEN 'PDF_URI' ELSE '' END AS codes FROM documents
        UNION ALL SELECT 2 * doc_id + 1, CASE WHEN doc_id % 40 = 4 THEN 'UPLOAD' ELSE 'CDR_DERIVED' END, 2 * doc_id + CASE WHEN doc_id % 40 = 5 THEN 2 ELSE 0 END, CASE WHEN doc_id % 40 = 6 THEN 'ZIP' ELSE 'PDF' END, CASE WHEN doc_id % 40 = 7 THEN 'FAILED' ELSE 'SUCCESS' END,
               CASE WHEN doc_id % 40 = 8 THEN 'QUARANTINED' ELSE 'COMPLETED' END, CASE WHEN doc_id % 40 = 9 THEN 'REVIEW' ELSE 'ALLOW' END, CASE WHEN doc_id % 80 = 10 THEN NULL ELSE doc_id % 40 <> 10 END, CASE WHEN doc_id % 40 = 11 THEN SHA('x') ELSE SHA(text) END, BYTES(text) + CASE WHEN doc_id % 40 = 12 THEN 1 ELSE 0 END,
               CASE WHEN doc_id % 40 = 13 THEN '0' ELSE '1.0.2' END, CASE WHEN doc_id % 40 = 14 THEN SHA('other') ELSE SHA('policy') END, concat('e', doc_id),
               CASE WHEN doc_id % 120 = 15 THEN NULL WHEN doc_id % 120 = 55 THEN '[{"decision":"ALLOW"}]' WHEN doc_id % 120 = 95 THEN '{"decision":' ELSE concat('{', CASE WHEN doc_id % 40 = 25 THEN '' ELSE concat('"analysis_complete":', CASE WHEN doc_id % 40 = 20 THEN 'false' ELSE 'true' END, ',') END,
                 '"decision":"', CASE WHEN doc_id % 40 IN (16, 20) THEN 'REVIEW' WHEN doc_id % 40 = 21 THEN 'BLOCK' ELSE 'ALLOW' END, '","hard_block_reasons":', CASE WHEN doc_id % 40 = 21 THEN '["MALWARE"]' ELSE '[]' END,
                 ',"mandatory_quarantine_reasons":', CASE WHEN doc_id % 40 = 22 THEN '["PDF_LAUNCH"]' WHEN doc_id % 40 = 26 THEN '["B","A"]' ELSE '[]' END, ',"policy_fingerprint":"', CASE WHEN doc_id % 40 = 19 THEN SHA('other') ELSE SHA('policy') END, '","policy_version":"', CASE WHEN doc_id % 40 = 18 THEN '0' ELSE '1.0.2' END,
                 '","release_eligible":', CASE WHEN doc_id % 80 = 17 THEN '"true"' WHEN doc_id % 40 IN (16, 17, 20, 21) THEN 'false' ELSE 'true' END, ',"risk_band":"LOW","risk_score":', CASE WHEN doc_id % 40 = 27 THEN 101 ELSE 3 END, '}') END,
               CASE WHEN doc_id % 40 = 23 THEN 'PDF_PARTIAL_ANALYSIS' WHEN doc_id % 40 = 24 THEN 'A,X_MALFORMED' ELSE 'A' END FROM documents""",
    "v_store": """
        SELECT 'quarantine' AS area, concat('d', doc_id) AS name, CASE WHEN doc_id % 29 = 1 THEN 'link' ELSE 'file' END AS kind, CASE WHEN doc_id % 31 = 2 THEN 2 ELSE 1 END AS links, CASE WHEN doc_id % 23 = 3 THEN 420 ELSE 256 END AS mode, BYTES(text) + CASE WHEN doc_id % 37 = 4 THEN 1 ELSE 0 END AS size_bytes,
               CASE WHEN doc_id % 27 = 5 THEN SHA('x') ELSE SHA(text) END AS sha, doc_id AS modified_at FROM documents WHERE doc_id % 19 <> 0
        UNION ALL SELECT 'quarantine', concat('e', doc_id), 'file', 1, 256, BYTES(text), SHA(text), doc_id FROM documents WHERE doc_id % 7 <> 0 UNION ALL SELECT 'sanitized', concat('a', doc_id), 'file', 1, CASE WHEN doc_id % 13 = 2 THEN 384 ELSE 256 END, BYTES(text), SHA(text), doc_id FROM documents WHERE doc_id % 11 <> 0
        UNION ALL SELECT 'quarantine', concat('b', item_id), 'file', 1, 256, BYTES(text), SHA(text), item_id FROM benchmark UNION ALL SELECT 'quarantine', concat('.b', item_id), 'file', 1, 256, BYTES(text), SHA(text), item_id FROM benchmark UNION ALL SELECT 'sanitized', concat('c', item_id), 'file', 1, 256, BYTES(text), SHA(text), item_id FROM benchmark WHERE item_id % 2 = 0
        UNION ALL SELECT CASE WHEN item_id % 2 = 0 THEN 'incoming' ELSE 'work' END, concat('.', CASE WHEN item_id % 3 = 0 THEN 'cdr-' ELSE '' END, substr(SHA(text), 1, 32), CASE WHEN item_id % 3 = 0 THEN '' ELSE concat('.', substr(SHA(text), 1, CASE WHEN item_id % 7 = 1 THEN 15 ELSE 16 END)) END, '.part'),
               CASE WHEN item_id % 10 = 3 THEN 'link' ELSE 'file' END, CASE WHEN item_id % 10 = 4 THEN 2 ELSE 1 END, CASE item_id % 5 WHEN 0 THEN 420 WHEN 1 THEN 256 ELSE 384 END, BYTES(text), SHA(text), 59000 + item_id * 10 FROM benchmark""",
    "v_cleaned": """
        SELECT doc_id AS artifact_id, CASE WHEN doc_id % 40 = 1 THEN 'THUMBNAIL' ELSE 'PDF_CDR' END AS artifact_type, CASE WHEN doc_id % 40 = 2 THEN -1 ELSE 2 * doc_id END AS scan_id, CASE WHEN doc_id % 40 = 3 THEN -1 ELSE 2 * doc_id + 1 END AS derived_scan_id,
               SHA(text) AS sha, BYTES(text) AS size_bytes, '1.0.2' AS policy_version, SHA('policy') AS policy_fingerprint FROM documents""",
    "v_attempted": """
        SELECT 2 * doc_id AS scan_id, 2 * doc_id + 1 AS derived_id, SHA(text) AS candidate_sha, BYTES(text) AS candidate_bytes, doc_id % 53 <> 0 AS audited, CASE WHEN doc_id % 9 = 2 THEN doc_id END AS existing, doc_id % 47 <> 1 AS output_made,
               CASE WHEN doc_id % 12 = 5 THEN 'page_limit' WHEN doc_id % 12 = 7 THEN 'render_failed' END AS render_code, BYTES(text) + CASE WHEN doc_id % 15 = 8 THEN 1 ELSE 0 END AS output_bytes, doc_id % 16 <> 9 AS registered,
               CASE WHEN doc_id % 14 = 10 THEN NULL WHEN doc_id % 14 = 11 THEN SHA('x') ELSE SHA(text) END AS promoted_sha, BYTES(text) + CASE WHEN doc_id % 14 = 12 THEN 1 ELSE 0 END AS promoted_bytes,
               CASE doc_id % 10 WHEN 0 THEN 'duplicate' WHEN 1 THEN 'invalid' WHEN 2 THEN 'failed' ELSE 'saved' END AS saved, CASE WHEN doc_id % 20 = 0 THEN doc_id END AS existing_after FROM documents""",
    "v_details": """
        SELECT event_id, CASE event_id % 14 WHEN 0 THEN '{"a":{"b":{"c":{"d":{"e":1}}}}}' WHEN 1 THEN '{"z": 1, "a": {"d": {"c": {"b": null}}}}' WHEN 2 THEN '{"l": [1,1,1,1,1,1,1,1,1,1,1,1,1,1,1,1,1,1,1,1,1,1,1,1,1,1,1,1,1,1,1,1,1]}' WHEN 3 THEN '{"l": [1,1,1,1,1,1,1,1,1,1,1,1,1,1,1,1,1,1,1,1,1,1,1,1,1,1,1,1,1,1,1,1]}' WHEN 4 THEN concat('{"t":"', repeat('x', 257), '"}') WHEN 5 THEN concat('{"t":"', repeat('\u00e9', 256), '"}')
                 WHEN 6 THEN concat('{"', repeat('k', 65), '":{"secret":[1]},"b": 2,"a": 1}') WHEN 7 THEN '{"k00":0,"k01":1,"k02":2,"k03":3,"k04":4,"k05":5,"k06":6,"k07":7,"k08":8,"k09":9,"k10":10,"k11":11,"k12":12,"k13":13,"k14":14,"k15":15,"k16":16,"k17":17,"k18":18,"k19":19,"k20":20,"k21":21,"k22":22,"k23":23,"k24":24,"k25":25,"k26":26,"k27":27,"k28":28,"k29":29,"k30":30,"k31":31,"k32":32}' WHEN 8 THEN '{"t00":"yyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyy","t01":"yyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyy","t02":"yyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyy","t03":"yyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyy","t04":"yyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyy","t05":"yyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyy","t06":"yyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyy","t07":"yyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyy","t08":"yyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyy","t09":"yyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyy","t10":"yyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyy","t11":"yyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyy","t12":"yyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyy","t13":"yyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyy","t14":"yyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyy","t15":"yyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyy","t16":"yyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyy"}' WHEN 9 THEN props WHEN 10 THEN '[1]' WHEN 11 THEN '{"a":' WHEN 12 THEN '{"a":1,"a":2}' ELSE concat('{"decision":"ALLOW","role": {"b": 1, "a": [true, null]}, "k":', event_id, '}') END AS details FROM events""",
    "v_audit": "SELECT event_id, event_type, user_id AS actor_id, CASE WHEN event_id % 7 = 0 THEN 'DENIED' ELSE 'SUCCESS' END AS outcome, props AS details, MICROS(ts) AS us FROM events",
    "v_content": """
        SELECT doc_id AS scan_id, CASE doc_id % 8 WHEN 0 THEN concat('255044462D', hex(text)) WHEN 1 THEN concat('504B0304', hex(text)) WHEN 2 THEN concat('504B0506', hex(text)) WHEN 3 THEN concat('D0CF11E0A1B11AE1', hex(text))
                 WHEN 4 THEN concat('4D5A', hex(text)) WHEN 5 THEN concat(hex(text), '00FF') WHEN 6 THEN '' ELSE hex(text) END AS content_hex FROM documents""",
    "v_render": """
        SELECT doc_id AS scan_id, CASE WHEN doc_id % 11 = 0 THEN '0' ELSE '1' END AS schema_version, CASE WHEN doc_id % 13 = 0 THEN 'ANALYZE' ELSE 'SANITIZE' END AS operation, CASE WHEN doc_id % 4 = 0 THEN 'FAILED' ELSE 'SUCCESS' END AS status,
               CASE WHEN doc_id % 8 = 0 THEN 'page_limit' WHEN doc_id % 9 = 0 THEN 'malformed' WHEN doc_id % 12 = 0 THEN 'ineligible' END AS failure_code, doc_id % 7 AS page_count, BYTES(text) AS output_bytes, doc_id % 17 = 0 AS unavailable, doc_id % 19 = 0 AS timed_out,
               doc_id % 23 = 0 AS output_over, CASE WHEN doc_id % 29 = 0 THEN 1 ELSE 0 END AS exit_code, CASE WHEN doc_id % 31 = 0 THEN '2.0' ELSE '1.0' END AS renderer, CASE WHEN doc_id % 5 <> 0 THEN doc_id + 1 END AS derived_scan_id FROM documents""",
    "v_object": """
        SELECT *, CASE WHEN kind = 'field' AND s % 3 > 0 THEN object_id - 1 - s % 5 WHEN kind = 'annotation' THEN max(CASE WHEN kind = 'page' THEN object_id END) OVER (PARTITION BY doc_id ORDER BY object_id ROWS UNBOUNDED PRECEDING) END AS parent_id,
               CASE WHEN kind IN ('open', 'name', 'field', 'page', 'annotation') AND s % 4 <> 2 THEN 1 + (object_id * 7 + p) % 40 END AS a1, CASE WHEN kind IN ('catalog', 'acroform') OR kind IN ('page', 'field', 'annotation') AND s % 5 = 0 THEN 1 + (object_id * 3 + s) % 40 END AS t1, 1 + (object_id * 5 + s) % 40 AS t2,
               CASE WHEN kind = 'action' AND s % 6 > 0 THEN 1 + (object_id * 5 + s) % 40 END AS n1, CASE WHEN kind = 'action' AND s % 6 > 1 THEN 1 + (object_id + p) % 40 END AS n2,
               CASE WHEN kind = 'action' THEN CASE p % 9 WHEN 0 THEN 'JavaScript' WHEN 1 THEN 'Launch' WHEN 2 THEN 'URI' WHEN 3 THEN 'SubmitForm' WHEN 4 THEN concat('X', s % 3) ELSE 'GoTo' END END AS subtype
        FROM (SELECT doc_id, object_id, p, s, CASE WHEN object_id = 1 THEN 'open' WHEN object_id = 2 THEN 'catalog' WHEN object_id = 3 THEN 'acroform' WHEN p % 8 = 0 THEN 'page' WHEN p % 8 = 1 THEN 'annotation' WHEN p % 8 IN (2, 3) THEN 'field' WHEN p % 8 = 4 THEN 'name' ELSE 'action' END AS kind
          FROM (SELECT l_orderkey - l_orderkey % 10 AS doc_id, row_number() OVER (PARTITION BY l_orderkey - l_orderkey % 10 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_returnflag, l_linestatus, l_shipdate) AS object_id, l_partkey AS p, l_suppkey AS s FROM lineitem) b0) b1""",
    "v_page_object": "SELECT conv_id AS doc_id, turn AS ordinal, role = 'user' AS is_field, turn % 3 AS page_no FROM conversations",
    "v_session": "SELECT c_custkey AS session_id, c_custkey % 50 AS user_id, CAST(round(c_acctbal * 100) AS BIGINT) AS expires_at, CASE WHEN c_custkey % 5 = 0 THEN 1 END AS revoked_at FROM customer",
    "v_page_size": "SELECT l_orderkey AS doc_id, l_linenumber AS page_no, max(l_quantity) * 40 AS width, max(l_quantity) * 60 AS height FROM lineitem GROUP BY l_orderkey, l_linenumber",
    "v_attachment": "SELECT page_id - page_id % 40 AS doc_id, page_id AS ordinal, CASE WHEN page_id % 11 = 0 THEN NULL ELSE page_id % 17 END AS spec_id, page_id % 13 AS payload_id, page_id % 3 = 0 AS referenced, page_id % 2 = 0 AS named, url AS display_name FROM pages",
    "v_script": "SELECT page_id AS doc_id, page_id AS action_id, html AS source_text FROM pages",
    "v_case": f"""
        SELECT doc_id AS case_id, CASE WHEN toxic = 1 THEN 'RISKY' ELSE 'BENIGN' END AS category, concat('class', doc_id % 6) AS case_class,
               CASE WHEN toxic = 1 THEN {_CODE_AT.format("doc_id % 45")} ELSE '' END AS expected, CASE WHEN doc_id % 4 = 0 THEN 'PDF_ACROFORM' ELSE '' END AS acceptable, doc_id % 6 = 0 AS any_additional,
               CASE WHEN toxic = 1 THEN 'QUARANTINE,BLOCK' ELSE 'ALLOW' END AS decisions, doc_id % 10 = 0 AS fail_secure FROM labels""",
    "v_result": f"""
        SELECT doc_id AS case_id, doc_id % 3 AS run, CASE WHEN doc_id % 9 = 0 THEN '' WHEN doc_id % 4 = 0 THEN concat({_CODE_AT.format("doc_id % 45")}, ',PDF_ACROFORM') ELSE {_CODE_AT.format("doc_id % 45")} END AS actual,
               CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN 'ALLOW' WHEN doc_id % 5 = 1 THEN 'BLOCK' WHEN doc_id % 5 = 2 THEN 'REVIEW' ELSE 'QUARANTINE' END AS decision,
               CASE WHEN doc_id % 8 = 0 THEN NULL ELSE doc_id % 5 = 0 END AS release_eligible, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id % 3 <> 0 END AS complete,
               CASE WHEN doc_id % 21 = 0 THEN 'TIMEOUT' ELSE 'SUCCESS' END AS worker_status, doc_id * 37 % 500 AS latency_ms, doc_id % 6 = 1 AS cdr_eligible, CASE WHEN doc_id % 12 = 1 THEN true WHEN doc_id % 12 = 7 THEN false END AS derived_release FROM documents WHERE doc_id % 10 <> 3""",
}
VIEWS["v_catalog"] = "SELECT scan_id, origin, parent_scan_id + CASE WHEN scan_id % 83 = 0 THEN 100000000 ELSE 0 END AS parent_scan_id, state, worker_status, detected_type, decision, release_eligible, storage_key, sha, size_bytes, CAST(NULL AS STRING) AS error_code, scan_id * 7919 % 100000 AS updated_at FROM (" + VIEWS["v_record"] + ") records"
_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def spark_text(sql: str) -> str:
    sql = re.sub(r"SHA\(", "sha2_(", sql).replace("EACH(LISTED(", "explode(array(").replace("BYTES(", "octet_length(").replace("MICROS(", "unix_micros_(")
    sql = _calls(sql, "sha2_", lambda a: f"sha2({a}, 256)")
    return _calls(sql, "unix_micros_", lambda a: f"unix_micros(CAST({a} AS TIMESTAMP))").replace("\\", "\\\\")


def duck_text(sql: str) -> str:
    sql = re.sub(r"\b([a-z]) -> ", r"lambda \1: ", sql)
    return sql.replace("EACH(LISTED(", "unnest(list_value(").replace("SHA(", "sha256(").replace("BYTES(", "strlen(").replace("MICROS(", "epoch_us(")


def _calls(sql: str, name: str, write) -> str:
    """Rewrite calls of one function of one argument, with its parentheses balanced."""
    while (at := sql.rfind(name + "(")) >= 0:
        end, depth = at + len(name) + 1, 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = sql[:at] + write(sql[at + len(name) + 1 : end - 1]) + sql[end:]
    return sql


def view(spark: SparkSession, sf_dir: str, name: str, read: Callable[[str], DataFrame] | None = None) -> DataFrame:
    """A derived view over the tables in a folder, or over what `read` gives for a table's name, as a stream."""
    return _over(spark, sf_dir, VIEWS[name], read)


def members_by_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v_member with the rows of a root in one task, from the one shuffle of the line items.

    A container's root hangs on its id, so its rows are numbered as in the view. The ship date, the last of what they are ordered by, isn't
    dealt out: rows that differ in nothing else give equal members.
    """
    root = "l_orderkey - l_orderkey % 64"
    text = VIEWS["v_member"].replace(f"{root} AS root_id", "root_id").replace("PARTITION BY l_orderkey ", "PARTITION BY root_id, l_orderkey ").replace(", l_shipdate)", ")")
    return _over(spark, sf_dir, text, lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet").selectExpr("*", f"{root} AS root_id").repartition("root_id"))


def _over(spark: SparkSession, sf_dir: str, text: str, read: Callable[[str], DataFrame] | None) -> DataFrame:
    read = read or (lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
    tables = {t: read(t) for t in _TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", text)}
    return spark.sql(re.sub(r"\b(FROM|JOIN) (" + "|".join(_TABLES) + r")\b", r"\1 {\2}", spark_text(text).replace("{", "{{").replace("}", "}}")), **tables)


def duck(sql: str) -> str:
    """A query over views as DuckDB SQL: the views it names become common tables."""
    sql = duck_text(sql)
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    head = ", ".join(f"{v} AS ({duck_text(VIEWS[v])})" for v in used)
    if not used:
        return sql
    if re.match(r"\s*WITH RECURSIVE\b", sql):
        return re.sub(r"^\s*WITH RECURSIVE\b", lambda m: "WITH RECURSIVE " + head + ",", sql, count=1)
    return re.sub(r"^\s*WITH\b", lambda m: "WITH " + head + ",", sql, count=1) if re.match(r"\s*WITH\b", sql) else f"WITH {head} {sql}"
