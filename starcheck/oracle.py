"""Reference answers in SQL, taken straight from the star schema.

No EDI text is involved here: the statements list the segments that each order and lineitem
stands for and work out owners, numbers and dates with plain window functions.
"""

from __future__ import annotations

_LINE_KEYS = ("l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, "
              "l_tax, l_returnflag, l_linestatus, l_shipdate")
_NO_LINE = ", ".join(f"NULL AS {c.strip()}" for c in _LINE_KEYS.split(","))
_LINE_ORDER = ", ".join(f"{c.strip()} NULLS FIRST" for c in _LINE_KEYS.split(","))
_LAST = "OVER (PARTITION BY u ORDER BY pos ROWS UNBOUNDED PRECEDING)"


def _seg(source: str, u: str, i: int, name: str, where: str = "", k: str = "k",
         lines: str = _NO_LINE, **values: str) -> str:
    columns = {"ok": "true", "payer": "NULL", "member": "NULL", "day": "NULL", "dx": "0",
               "val": "NULL", **values}
    listed = ", ".join(f"{v} AS {n}" for n, v in columns.items())
    return (f"SELECT {u} AS u, {k} AS k, {lines}, {i} AS i, '{name}' AS name, {listed} "
            f"FROM {source} {('WHERE ' + where) if where else ''}")


_U7, _U5 = "k // 500 * 2 + 1", "ck // 100 * 2 + 2"
_LU = "l_orderkey // 500 * 2 + 1"
_END = "9000000000000000000"
_SEGMENTS_837 = [
    *[_seg("(SELECT DISTINCT k // 500 AS f FROM o)", "f * 2 + 1", i, n, k="-1")
      for i, n in enumerate(("ISA", "GS", "ST", "BHT"))],
    _seg("o", _U7, 1, "N1", "pr = '1-URGENT'", payer="seg"),
    _seg("o", _U7, 2, "NM1", "st = 'F'", member="c_name"),
    _seg("o", _U7, 3, "CLM", ok="NOT bad"),
    _seg("o", _U7, 4, "DTP", "pr <> '4-NOT SPECIFIED'", day="od"),
    _seg("o", _U7, 5, "REF", "pr = '5-LOW'", val="'PRIOR-' || k"),
    _seg("o", _U7, 6, "HI", dx="CASE WHEN pr = '2-HIGH' THEN 2 ELSE 1 END"),
    _seg("o", _U7, 7, "HI", "pr = '3-MEDIUM'", dx="1"),
    _seg("lineitem", _LU, 8, "SV1", k="l_orderkey", lines=_LINE_KEYS,
         ok="NOT (l_discount = 0 AND l_tax = 0)"),
    _seg("lineitem", _LU, 9, "DTP", k="l_orderkey", lines=_LINE_KEYS,
         day="CAST(l_shipdate AS DATE)"),
    *[_seg("(SELECT DISTINCT k // 500 AS f FROM o)", "f * 2 + 1", i, n, k=_END)
      for i, n in enumerate(("SE", "GE", "IEA"))],
]
_SEGMENTS_835 = [
    *[_seg("(SELECT DISTINCT ck // 100 AS f FROM p)", "f * 2 + 2", i, n, k="-1",
           day="DATE '2001-12-31'" if n == "DTM" else "NULL")
      for i, n in enumerate(("ISA", "GS", "ST", "BPR", "TRN", "DTM", "N1"))],
    _seg("p", _U5, 1, "CLP", ok="NOT bad", val="code"),
    _seg("p", _U5, 2, "DTM", "pr = '2-HIGH'", day="CAST(od + INTERVAL 30 DAY AS DATE)"),
    _seg("p", _U5, 3, "CAS"),
    _seg("p", _U5, 4, "LQ", "code IN ('4', '22')"),
    _seg("p", _U5, 5, "CLP", "pr = '1-URGENT' AND st = 'F'", ok="NOT bad", val="'22'"),
    *[_seg("(SELECT DISTINCT ck // 100 AS f FROM p)", "f * 2 + 2", i, n, k=_END)
      for i, n in enumerate(("SE", "GE", "IEA"))],
]

BASE = f"""
WITH o AS (
  SELECT o_orderkey AS k, o_custkey AS ck, o_orderstatus AS st, o_orderpriority AS pr,
         CAST(o_totalprice AS DECIMAL(12,2)) AS total, o_totalprice < 5000 AS bad,
         CAST(o_orderdate AS DATE) AS od, c_name, c_mktsegment AS seg,
         'D' || lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0') AS dx
  FROM orders JOIN customer ON o_custkey = c_custkey),
p0 AS (
  SELECT *, CASE WHEN pr = '4-NOT SPECIFIED' THEN '5' WHEN st = 'F' THEN '1'
                 WHEN pr = '5-LOW' THEN '22' ELSE '4' END AS code
  FROM o WHERE st <> 'P'),
p AS (
  SELECT *, CASE WHEN code = '1'
                 THEN CAST(round(total * CAST(0.8 AS DECIMAL(2,1)), 2) AS DECIMAL(12,2))
                 ELSE CAST(0 AS DECIMAL(12,2)) END AS paid FROM p0),
seg7 AS ({' UNION ALL '.join(_SEGMENTS_837)}),
seg5 AS ({' UNION ALL '.join(_SEGMENTS_835)}),
num7 AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY k, {_LINE_ORDER}, i) AS pos FROM seg7),
num5 AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY k, i) AS pos FROM seg5),
all7 AS (
  SELECT *,
    last_value(CASE WHEN name = 'CLM' AND ok THEN pos END IGNORE NULLS) {_LAST} AS claim_pos,
    last_value(CASE WHEN name = 'CLM' AND ok THEN k END IGNORE NULLS) {_LAST} AS claim_k,
    last_value(payer IGNORE NULLS) {_LAST} AS payer_name,
    last_value(member IGNORE NULLS) {_LAST} AS member_id,
    last_value(CASE WHEN name IN ('CLM', 'SV1', 'HI') AND ok THEN name END IGNORE NULLS) {_LAST} AS own,
    last_value(CASE WHEN name IN ('CLM', 'SV1', 'HI') AND ok THEN pos END IGNORE NULLS) {_LAST} AS own_pos
  FROM num7),
st5 AS (
  SELECT *, u * 2147483648 + remit_pos AS remit_id FROM (SELECT *,
    last_value(CASE WHEN name = 'CLP' AND ok THEN pos END IGNORE NULLS) {_LAST} AS remit_pos,
    last_value(day IGNORE NULLS) {_LAST} AS run_day
  FROM num5)),
rejected AS (
  SELECT DISTINCT u FROM all7 WHERE name = 'SV1' AND ok AND claim_pos IS NOT NULL
    AND l_quantity >= 50 AND l_discount >= 0.1 AND l_tax >= 0.08 AND l_returnflag = 'R'),
st7 AS (
  SELECT *, u * 2147483648 + claim_pos AS claim_id FROM all7
  WHERE u NOT IN (SELECT u FROM rejected)),
claim_day AS (
  SELECT claim_id, arg_max(day, pos) AS day FROM st7
  WHERE name = 'DTP' AND own IN ('CLM', 'HI') AND claim_id IS NOT NULL GROUP BY 1),
line_day AS (
  SELECT u, own_pos, arg_max(day, pos) AS day FROM st7
  WHERE name = 'DTP' AND own = 'SV1' AND claim_id IS NOT NULL GROUP BY 1, 2),
prior AS (
  SELECT claim_id, arg_max(val, pos) AS val FROM st7
  WHERE name = 'REF' AND claim_id IS NOT NULL GROUP BY 1),
claims7 AS (
  SELECT s.claim_id, 'CLM-' || s.k AS claim_number, s.payer_name,
    s.member_id AS patient_member_id, o.total AS total_charge_amount,
    CASE o.st WHEN 'F' THEN '11' WHEN 'O' THEN '21' ELSE '22' END AS facility_type_code,
    CASE WHEN o.pr = '5-LOW' THEN '7' ELSE '1' END AS frequency_code,
    coalesce(d.day, DATE '2002-02-01') AS service_from_date, d.day AS service_to_date,
    s.u AS upload_seq, r.val AS previous_payer_claim_control_no, false AS is_placeholder
  FROM st7 s JOIN o ON o.k = s.k LEFT JOIN claim_day d ON d.claim_id = s.claim_id
    LEFT JOIN prior r ON r.claim_id = s.claim_id
  WHERE s.name = 'CLM' AND s.ok),
lines AS (
  SELECT s.u * 2147483648 + s.pos AS line_id, s.claim_id,
    CAST(row_number() OVER (PARTITION BY s.claim_id ORDER BY s.pos) AS INTEGER) AS line_number,
    lpad(CAST(l_partkey % 100000 AS VARCHAR), 5, '0') AS procedure_code,
    CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS modifier1,
    CAST(CASE WHEN l_quantity = 0 THEN 1 ELSE l_quantity END AS DECIMAL(10,2)) AS units,
    CAST(l_extendedprice AS DECIMAL(12,2)) AS billed_amount, d.day AS service_date,
    lpad(CAST(l_suppkey % 90 AS VARCHAR), 2, '0') AS place_of_service, s.u AS upload_seq
  FROM st7 s LEFT JOIN line_day d ON d.u = s.u AND d.own_pos = s.pos
  WHERE s.name = 'SV1' AND s.ok AND s.claim_id IS NOT NULL),
dx_rows AS (
  SELECT s.claim_id, s.pos, s.u, 1 AS j, o.dx AS code, 'ABK' AS kind
    FROM st7 s JOIN o USING (k) WHERE s.name = 'HI' AND s.i = 6
  UNION ALL SELECT s.claim_id, s.pos, s.u, 2, 'X' || o.dx, 'ABF'
    FROM st7 s JOIN o USING (k) WHERE s.name = 'HI' AND s.i = 6 AND o.pr = '2-HIGH'
  UNION ALL SELECT s.claim_id, s.pos, s.u, 2, 'Y' || o.dx, 'ABF'
    FROM st7 s JOIN o USING (k) WHERE s.name = 'HI' AND s.i = 7),
dxs AS (
  SELECT claim_id, CAST(row_number() OVER (PARTITION BY claim_id ORDER BY pos, j) AS INTEGER)
    AS sequence_number, code AS diagnosis_code, kind AS diagnosis_type, u AS upload_seq
  FROM dx_rows WHERE claim_id IS NOT NULL),
remit_day AS (
  SELECT remit_id, arg_max(day, pos) AS day FROM st5
  WHERE name = 'DTM' AND remit_id IS NOT NULL GROUP BY 1),
remits0 AS (
  SELECT s.remit_id AS remittance_claim_id, 'CLM-' || s.k AS claim_number,
    s.val AS claim_status_code, p.total AS billed_amount,
    CASE WHEN s.i = 1 THEN p.paid ELSE CAST(0 AS DECIMAL(12,2)) END AS paid_amount,
    'PCN' || s.k || CASE WHEN s.i = 5 THEN 'R' ELSE '' END AS payer_claim_control_number,
    coalesce(d.day, s.run_day) AS remittance_date, s.u AS upload_seq
  FROM st5 s JOIN p ON p.k = s.k LEFT JOIN remit_day d ON d.remit_id = s.remit_id
  WHERE s.name = 'CLP' AND s.ok),
mentions AS (
  SELECT claim_number, min(id) AS claim_id FROM (
    SELECT claim_number, claim_id AS id FROM claims7
    UNION ALL SELECT claim_number, remittance_claim_id FROM remits0) GROUP BY 1),
remits AS (SELECT r.*, m.claim_id FROM remits0 r JOIN mentions m USING (claim_number)),
claims0 AS (
  SELECT * FROM claims7 UNION ALL BY NAME
  SELECT claim_id, claim_number, billed_amount AS total_charge_amount,
    DATE '2002-02-01' AS service_from_date, upload_seq, true AS is_placeholder
  FROM remits WHERE claim_id = remittance_claim_id),
statuses AS (
  SELECT claim_id, arg_max(CASE claim_status_code WHEN '1' THEN 'paid' WHEN '4' THEN 'denied'
    WHEN '22' THEN 'void' END, remittance_claim_id) AS claim_status
  FROM remits WHERE claim_status_code IN ('1', '4', '22') GROUP BY 1),
claims AS (
  SELECT c.*, coalesce(s.claim_status, 'submitted') AS claim_status
  FROM claims0 c LEFT JOIN statuses s USING (claim_id)),
adj AS (
  SELECT s.remit_id AS remittance_claim_id, CAST(s.pos AS INTEGER) AS segment_position,
    1 AS ordinal, 'CO' AS adjustment_group_code,
    CASE WHEN p.code = '1' THEN '45' ELSE '50' END AS adjustment_reason_code,
    CAST(p.total - p.paid AS DECIMAL(12,2)) AS adjustment_amount, s.u AS upload_seq
  FROM st5 s JOIN p USING (k) WHERE s.name = 'CAS' AND s.remit_id IS NOT NULL
  UNION ALL
  SELECT s.remit_id, CAST(s.pos AS INTEGER), 2, 'CO', '2', CAST(7.50 AS DECIMAL(12,2)), s.u
  FROM st5 s JOIN p USING (k)
  WHERE s.name = 'CAS' AND s.remit_id IS NOT NULL AND p.pr = '3-MEDIUM'),
remarks AS (
  SELECT s.u * 2147483648 + s.pos AS remark_id, s.remit_id AS remittance_claim_id,
    CASE WHEN p.pr = '5-LOW' THEN 'M' ELSE 'N' END
      || lpad(CAST(s.k % 1000 AS VARCHAR), 3, '0') AS remark_code, s.u AS upload_seq
  FROM st5 s JOIN p USING (k) WHERE s.name = 'LQ' AND s.remit_id IS NOT NULL),
errors7 AS (
  SELECT u, pos, name, CASE
    WHEN name = 'CLM' AND NOT ok THEN 'invalid total_charge_amount'
    WHEN name IN ('SV1', 'HI') AND claim_pos IS NULL THEN 'no current claim in context'
    WHEN name = 'SV1' AND NOT ok
      THEN 'missing procedure_code (claim=CLM-' || claim_k || ')' END AS text FROM st7),
errors5 AS (
  SELECT u, pos, name, CASE
    WHEN name = 'CLP' AND NOT ok THEN 'invalid billed_amount (claim=CLM-' || k || ')'
    WHEN name IN ('CAS', 'LQ') AND remit_pos IS NULL
      THEN 'no current remittance claim' END AS text FROM st5),
errors AS (
  SELECT u AS upload_seq, CAST(pos AS INTEGER) AS segment_position,
    name || ' at pos ' || pos || ': ' || name || ' at pos ' || pos || ': ' || text AS error
  FROM (SELECT * FROM errors7 UNION ALL SELECT * FROM errors5) WHERE text IS NOT NULL),
line_agg AS (
  SELECT claim_id, count(*) AS line_count, sum(units) AS total_units,
    sum(billed_amount) AS total_billed_amount, bool_or(modifier1 IS NOT NULL) AS has_modifier,
    arg_min(procedure_code, line_number) AS proc, arg_min(place_of_service, line_number) AS pos
  FROM lines GROUP BY 1),
dx_agg AS (
  SELECT claim_id, count(*) AS diagnosis_count, arg_min(diagnosis_code, sequence_number) AS dx
  FROM dxs GROUP BY 1),
every_claim AS (
  SELECT c.claim_id, c.claim_number, CAST(c.claim_status = 'denied' AS INTEGER) AS denied,
    c.total_charge_amount, coalesce(l.line_count, 0) AS line_count,
    coalesce(d.diagnosis_count, 0) AS diagnosis_count,
    CAST(coalesce(l.total_units, 0) AS DECIMAL(20,2)) AS total_units,
    CAST(coalesce(l.total_billed_amount, 0) AS DECIMAL(22,2)) AS total_billed_amount,
    coalesce(l.has_modifier, false) AS has_modifier, c.service_from_date, c.service_to_date,
    c.payer_name, c.frequency_code, c.facility_type_code, l.proc AS primary_procedure_code,
    d.dx AS primary_diagnosis_code, l.pos AS place_of_service
  FROM claims c LEFT JOIN line_agg l USING (claim_id) LEFT JOIN dx_agg d USING (claim_id)),
dataset AS (
  SELECT * FROM every_claim WHERE claim_id IN (SELECT claim_id FROM remits)),
labels_of AS (
  SELECT "column", value, CAST(dense_rank() OVER (PARTITION BY "column" ORDER BY value) - 1 AS BIGINT)
    AS code
  FROM (SELECT DISTINCT "column", value FROM (
    SELECT 'payer_name' AS "column", payer_name AS value FROM dataset
    UNION ALL SELECT 'frequency_code', frequency_code FROM dataset
    UNION ALL SELECT 'facility_type_code', facility_type_code FROM dataset
    UNION ALL SELECT 'primary_procedure_code', primary_procedure_code FROM dataset
    UNION ALL SELECT 'primary_diagnosis_code', primary_diagnosis_code FROM dataset
    UNION ALL SELECT 'place_of_service', place_of_service FROM dataset) WHERE value IS NOT NULL)),
threshold AS (
  SELECT quantile_cont(CAST(total_charge_amount AS DOUBLE), 0.75) AS t FROM dataset)
"""

_CODED = "\n".join(
    f"""LEFT JOIN labels_of e{i} ON e{i}."column" = '{c}' AND e{i}.value = x.{c}"""
    for i, c in enumerate(("payer_name", "frequency_code", "facility_type_code",
                           "primary_procedure_code", "primary_diagnosis_code",
                           "place_of_service")))


def _features(source: str) -> str:
    return f"""
SELECT x.claim_id, CAST(x.total_charge_amount AS DOUBLE) AS total_charge_amount,
  CAST(x.line_count AS BIGINT) AS line_count, CAST(x.diagnosis_count AS BIGINT) AS diagnosis_count,
  CAST(x.total_units AS DOUBLE) AS total_units,
  CAST(greatest(coalesce(x.service_to_date - x.service_from_date, 0), 0) AS BIGINT)
    AS service_duration_days,
  CAST(x.has_modifier AS BIGINT) AS has_modifier,
  CAST(x.line_count > 1 AS BIGINT) AS multiple_lines,
  CAST(x.diagnosis_count > 5 AS BIGINT) AS many_diagnoses,
  CAST(CAST(x.total_charge_amount AS DOUBLE) > t AS BIGINT) AS high_charge_claim,
  CAST(month(x.service_from_date) AS BIGINT) AS service_month,
  CAST(isodow(x.service_from_date) - 1 AS BIGINT) AS service_day_of_week,
  CAST(isodow(x.service_from_date) >= 6 AS BIGINT) AS weekend_service,
  coalesce(e0.code, -1) AS payer_name_encoded, coalesce(e1.code, -1) AS frequency_code_encoded,
  coalesce(e2.code, -1) AS facility_type_code_encoded,
  coalesce(e3.code, -1) AS primary_procedure_code_encoded,
  coalesce(e4.code, -1) AS primary_diagnosis_code_encoded,
  coalesce(e5.code, -1) AS place_of_service_encoded,
  CAST(x.total_billed_amount AS DOUBLE) AS total_billed_amount,
  CAST(x.payer_name IS NULL AS BIGINT) AS missing_payer,
  CAST(x.primary_diagnosis_code IS NULL AS BIGINT) AS missing_diagnosis,
  CAST(x.primary_procedure_code IS NULL AS BIGINT) AS missing_procedure,
  CAST(x.place_of_service IS NULL AS BIGINT) AS missing_pos,
  CAST(NOT x.has_modifier AS BIGINT) AS missing_modifier
FROM {source} x CROSS JOIN threshold {_CODED}"""


_CLAIM = ("claim_id, claim_number, payer_name, patient_member_id, total_charge_amount, "
          "facility_type_code, frequency_code, service_from_date, service_to_date, upload_seq, "
          "previous_payer_claim_control_no, is_placeholder, claim_status")
_TREE = "SELECT claim_id, {} AS section, {} AS parent_id, {} AS ordinal, {} AS code, {} AS detail, CAST({} AS DECIMAL(12,2)) AS amount, CAST({} AS DATE) AS day FROM {}"

_BODIES = {
    "segments_archive": """
SELECT file_type, segment_name, count(*) AS segments, count(claim_id) AS with_claim,
  count(remit_id) AS with_remittance, CAST(sum(pos) AS BIGINT) AS sum_position FROM (
  SELECT 'edi_837' AS file_type, name AS segment_name, claim_id, NULL::BIGINT AS remit_id, pos FROM st7
  UNION ALL SELECT 'edi_835', name, NULL, remit_id, pos FROM st5) GROUP BY 1, 2""",
    "edi_files": """
SELECT u AS upload_seq, 'edi_837' AS file_type, 'claims-' || u || '.edi' AS file_name,
  lpad(CAST(u AS VARCHAR), 9, '0') AS interchange_control_no, 'SUBMITTER' AS sender_id,
  'PAYER' AS receiver_id, '1.0.0' AS parser_version FROM (SELECT DISTINCT u FROM st7)
UNION ALL SELECT u, 'edi_835', 'payments-' || u || '.edi', lpad(CAST(u AS VARCHAR), 9, '0'),
  'PAYER', 'PROVIDER', '1.0.0' FROM (SELECT DISTINCT u FROM st5)""",
    "ingest_summary": """
SELECT f.u AS upload_seq, f.file_name, f.file_type,
  (SELECT count(*) FROM claims x WHERE x.upload_seq = f.u) AS claims_count,
  (SELECT count(*) FROM lines x WHERE x.upload_seq = f.u) AS claim_lines_count,
  (SELECT count(*) FROM dxs x WHERE x.upload_seq = f.u) AS diagnoses_count,
  (SELECT count(*) FROM remits x WHERE x.upload_seq = f.u) AS remittance_claims_count,
  (SELECT count(*) FROM adj x WHERE x.upload_seq = f.u) AS adjustments_count,
  (SELECT count(*) FROM remarks x WHERE x.upload_seq = f.u) AS remark_codes_count,
  (SELECT count(*) FROM st7 x WHERE x.u = f.u) + (SELECT count(*) FROM st5 x WHERE x.u = f.u)
    AS raw_segments_count,
  (SELECT count(*) FROM errors x WHERE x.upload_seq = f.u)
    + (SELECT count(*) FROM rejected x WHERE x.u = f.u) AS errors_count,
  f.u NOT IN (SELECT u FROM rejected) AS success
FROM (SELECT DISTINCT u, 'claims-' || u || '.edi' AS file_name, 'edi_837' AS file_type FROM all7
      UNION ALL SELECT DISTINCT u, 'payments-' || u || '.edi', 'edi_835' FROM st5) f""",
    "claims": f"SELECT {_CLAIM} FROM claims",
    "claim_lines": "SELECT *, CAST(NULL AS VARCHAR) AS modifier2 FROM lines",
    "diagnoses": "SELECT * FROM dxs",
    "parse_errors": """
SELECT * FROM errors UNION ALL
SELECT u, NULL, 'DB save failed: value too long for claim_lines.place_of_service(2)' FROM rejected""",
    "remittances": "SELECT * FROM remits",
    "adjustments": "SELECT * FROM adj",
    "remarks": "SELECT * FROM remarks",
    "resolution": """
SELECT r.remittance_claim_id, r.claim_id, c.is_placeholder, c.upload_seq AS claim_upload_seq
FROM remits r JOIN claims c USING (claim_id)""",
    "placeholders": """
SELECT claim_id, claim_number, total_charge_amount, service_from_date, upload_seq
FROM claims WHERE is_placeholder""",
    "rejected_files": """
SELECT u AS upload_seq, 'claims-' || u || '.edi' AS file_name,
  'DB save failed: value too long for claim_lines.place_of_service(2)' AS error FROM rejected""",
    "claim_status": """
SELECT claim_status, is_placeholder, count(*) AS claims,
  CAST(sum(total_charge_amount) AS DECIMAL(18,2)) AS charged FROM claims GROUP BY 1, 2""",
    "list_claims": f"SELECT {_CLAIM} FROM claims ORDER BY claim_id DESC LIMIT 100 OFFSET 1000",
    "list_edi_files": """
SELECT u AS upload_seq, CASE WHEN u % 2 = 1 THEN 'edi_837' ELSE 'edi_835' END AS file_type,
  lpad(CAST(u AS VARCHAR), 9, '0') AS interchange_control_no
FROM (SELECT DISTINCT u FROM st7 UNION SELECT DISTINCT u FROM st5) ORDER BY u DESC LIMIT 20 OFFSET 5""",
    "claim_detail": """
SELECT c.claim_id, c.claim_number, c.claim_status,
  (SELECT count(*) FROM lines l WHERE l.claim_id = c.claim_id) AS lines,
  (SELECT count(*) FROM dxs d WHERE d.claim_id = c.claim_id) AS diagnoses,
  (SELECT count(*) FROM remits r WHERE r.claim_id = c.claim_id) AS remittances,
  (SELECT count(*) FROM adj a JOIN remits r USING (remittance_claim_id)
   WHERE r.claim_id = c.claim_id) AS adjustments,
  (SELECT count(*) FROM remarks a JOIN remits r USING (remittance_claim_id)
   WHERE r.claim_id = c.claim_id) AS remarks,
  (SELECT arg_min(procedure_code, line_number) FROM lines l WHERE l.claim_id = c.claim_id)
    AS first_procedure,
  (SELECT arg_min(adjustment_amount, segment_position) FROM adj a
   JOIN remits r USING (remittance_claim_id) WHERE r.claim_id = c.claim_id AND a.ordinal = 1)
    AS first_adjustment
FROM claims c WHERE c.claim_id = (
  SELECT min(claim_id) FROM claims WHERE claim_status = 'denied' AND NOT is_placeholder)""",
    "claim_tree": " UNION ALL ".join([
        _TREE.format("'claim'", "NULL::BIGINT", "NULL::BIGINT", "claim_number", "claim_status",
                     "total_charge_amount", "service_from_date", "claims"),
        _TREE.format("'line'", "claim_id", "CAST(line_number AS BIGINT)", "procedure_code",
                     "modifier1", "billed_amount", "service_date", "lines"),
        _TREE.format("'diagnosis'", "claim_id", "CAST(sequence_number AS BIGINT)",
                     "diagnosis_code", "diagnosis_type", "NULL", "NULL", "dxs"),
        _TREE.format("'remittance'", "claim_id", "remittance_claim_id", "claim_status_code",
                     "payer_claim_control_number", "paid_amount", "remittance_date", "remits"),
        _TREE.format("'adjustment'", "remittance_claim_id",
                     "CAST(segment_position AS BIGINT) * 1048576 + ordinal",
                     "adjustment_reason_code", "adjustment_group_code", "adjustment_amount",
                     "NULL", "adj JOIN remits USING (remittance_claim_id)"),
        _TREE.format("'remark'", "remittance_claim_id", "remark_id", "remark_code", "NULL",
                     "NULL", "NULL", "remarks JOIN remits USING (remittance_claim_id)")]),
    "denials": """
SELECT r.remittance_claim_id, r.claim_id, c.claim_number, c.payer_name,
  c.total_charge_amount, d.detail_type, d.group_code, d.code, d.amount
FROM claims c JOIN remits r USING (claim_id) JOIN (
  SELECT remittance_claim_id, 'adjustment' AS detail_type, adjustment_group_code AS group_code,
    adjustment_reason_code AS code, adjustment_amount AS amount FROM adj
  UNION ALL SELECT remittance_claim_id, 'remark', NULL, remark_code, NULL FROM remarks
  UNION ALL SELECT remittance_claim_id, 'payment', NULL, claim_status_code, paid_amount
  FROM remits) d USING (remittance_claim_id)
WHERE c.claim_status = 'denied'""",
    "code_lookup": """
SELECT l.place_of_service, n.n_name AS description, count(*) AS lines,
  CAST(sum(l.billed_amount) AS DECIMAL(18,2)) AS billed
FROM lines l LEFT JOIN nation n
  ON lpad(CAST(n.n_nationkey AS VARCHAR), 2, '0') = l.place_of_service GROUP BY 1, 2""",
    "find_claims": """
SELECT claim_id, claim_number, total_charge_amount FROM claims WHERE claim_status = 'void'""",
    "find_adjustments": """
SELECT remittance_claim_id, segment_position, adjustment_amount FROM adj
WHERE adjustment_reason_code = '45'""",
    "dataset": "SELECT * FROM dataset",
    "dataset_stats": """
SELECT count(*) AS total_claims, CAST(sum(denied) AS BIGINT) AS denied_claims,
  CAST(round(avg(denied), 6) AS DOUBLE) AS denial_rate FROM dataset""",
    "label_dictionary": 'SELECT "column", value, code FROM labels_of',
    "charge_threshold": "SELECT CAST(t AS DECIMAL(18,4)) AS threshold FROM threshold",
    "features": _features("dataset"),
    "feature_unseen": _features("every_claim"),
}


def _found_by(column: str, shown: str) -> str:
    return f"""
SELECT claim_id, claim_number, claim_status, {shown} FROM claims WHERE {column} = (
  SELECT arg_min({column}, claim_id) FROM claims WHERE {column} IS NOT NULL)"""


_BATCH = ("CASE WHEN {0} <= last // 3 THEN 0 WHEN {0} <= last * 2 // 3 THEN 1 ELSE 2 END")
_COLUMNS_AT_ONCE = _features("dataset")
_BODIES |= {
    "features_saved": _BODIES["features"],
    "features_at_once": f"SELECT * EXCLUDE (claim_id) FROM ({_COLUMNS_AT_ONCE})",
    "denial_scores": """
SELECT claim_id, denied, true AS in_range, true AS in_band FROM dataset""",
    "described_codes": """
SELECT 'carc' AS code_type, code, r_name AS description, uses FROM (
  SELECT adjustment_reason_code AS code, count(*) AS uses FROM adj GROUP BY 1) LEFT JOIN region
  ON code = CASE r_regionkey WHEN 0 THEN '45' WHEN 1 THEN '50' ELSE 'R' || r_regionkey END
UNION ALL SELECT 'rarc', code, r_name, uses FROM (
  SELECT remark_code AS code, count(*) AS uses FROM remarks GROUP BY 1) LEFT JOIN region
  ON code = CASE r_regionkey WHEN 0 THEN 'N130' WHEN 1 THEN 'N50' ELSE 'NR' || r_regionkey END
UNION ALL SELECT 'claim_status', code, r_name, uses FROM (
  SELECT claim_status_code AS code, count(*) AS uses FROM remits GROUP BY 1) LEFT JOIN region
  ON code = CAST(r_regionkey + 1 AS VARCHAR)""",
    "ingest_in_batches": _BODIES["claims"],
    "files_claims": _BODIES["claims"],
    "stream_claims": _BODIES["claims"],
    "remittances_in_batches": _BODIES["remittances"],
    "updated_claims": f"""
SELECT claim_id, EXISTS (SELECT 1 FROM remits r WHERE r.claim_id = c.claim_id
    AND r.claim_status_code IN ('1', '4', '22') AND {_BATCH.format('r.upload_seq')}
      > {_BATCH.format('c.upload_seq')}) AS changed
FROM claims c, (SELECT max(u) AS last FROM (SELECT u FROM st7 UNION SELECT u FROM st5))""",
    "find_claims_by_number": _found_by("claim_number", "total_charge_amount"),
    "find_claims_by_member": _found_by("patient_member_id", "patient_member_id"),
    "find_claims_by_file": _found_by("upload_seq", "upload_seq"),
    "denials_by_id": _BODIES["denials"] + """ AND c.claim_id = (
  SELECT min(claim_id) FROM claims WHERE claim_status = 'denied')""",
    "next_page": _BODIES["list_claims"],
}


# Real files have an accent before each payer's name.
_OF_FILES = ("files_claims", "stream_claims")


def oracle_sql() -> dict[str, str]:
    plain = {name: BASE + body for name, body in _BODIES.items()}
    accented = BASE.replace("c_mktsegment AS seg", "'\u00c9' || c_mktsegment AS seg")
    return plain | {name: accented + _BODIES[name] for name in _OF_FILES}
