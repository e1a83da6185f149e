"""Queries of the statement parsers: statements are rendered from orders, parsed back and compared with the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.functions.exprs import money_to_minor
from tally.sources import registry, statements as st
from tally.plans.tpch import LEDGER, frame


def _files(spark, sf_dir, line: str, head: str = "", tail: str = "") -> DataFrame:
    """One file per value date from the ledger, a ``line`` (SQL) per row."""
    rows = frame(spark, sf_dir, LEDGER).selectExpr("value_date", "id", f"{line} AS line")
    grouped = rows.groupBy("value_date").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "line"))), lambda x: x["line"]), "\n").alias("body"))
    content = F.concat(F.expr(head or "''"), F.col("body"), F.expr(tail or "''"))
    return grouped.select(F.date_format("value_date", "yyyy-MM-dd").alias("path"), F.encode(content, "UTF-8").alias("content"))


_AMOUNT = "concat(CAST(amount_minor DIV 100 AS STRING), '{}', lpad(CAST(amount_minor % 100 AS STRING), 2, '0'))"
_SHOWN = ["external_ref", "value_date", "amount_minor", "direction", "description", "counterparty_account"]
_LEDGER_ROWS = "SELECT external_ref, value_date, amount_minor, direction, {description} AS description, {account} AS counterparty_account FROM (" + LEDGER + ") l"


def mt940_files(spark, sf_dir):
    line = f"concat(':61:', date_format(value_date, 'yyMMdd'), IF(direction = 'debit', 'D', 'C'), {_AMOUNT.format(',')}, 'NTRF', external_ref, '//X\\n:86:?00:P?20pay', IF(counterparty_account IS NULL, '', concat('?32', counterparty_account)))"
    return _files(spark, sf_dir, line, "':20:S\\n:25:A\\n:60F:C250101GBP0,00\\n'", "'\\n:62F:C250101GBP0,00'")


def _mt940(spark, sf_dir):
    return st.gate(st.parse_mt94x(mt940_files(spark, sf_dir), "subfielded"))[0].select(*_SHOWN)


def mt942_files(spark, sf_dir):
    """Every seventh day declares one debit too many."""
    line = f"concat(':61:', date_format(value_date, 'yyMMdd'), IF(direction = 'debit', 'D', 'C'), {_AMOUNT.format(',')}, 'NTRF', external_ref)"
    rows = frame(spark, sf_dir, LEDGER)
    totals = rows.groupBy("value_date").agg(F.count_if(F.col("direction") == "debit").alias("n"), F.coalesce(F.sum(F.when(F.col("direction") == "debit", F.col("amount_minor"))), F.lit(0)).cast("bigint").alias("amount_minor"))
    totals = totals.selectExpr("date_format(value_date, 'yyyy-MM-dd') AS path", f"concat('\\n:90D:', CAST(n + IF(dayofyear(value_date) % 7 = 0, 1, 0) AS STRING), 'GBP', {_AMOUNT.format(',')}) AS declared")
    return _files(spark, sf_dir, line, "':20:S\\n:34F:GBP0,00\\n'").join(totals, "path").select("path", F.concat("content", F.encode("declared", "UTF-8")).alias("content"))


def _mt942(spark, sf_dir):
    parsed = st.parse_mt94x(mt942_files(spark, sf_dir), intraday=True)
    accepted, rejects = st.gate(parsed)
    a = accepted.agg(F.count("*").alias("accepted_rows"), F.sum("amount_minor").alias("accepted_minor"), F.countDistinct("path").alias("accepted_files"))
    r = rejects.agg(F.countDistinct("path").alias("rejected_files"), F.count_if((F.col("field") == "totals") & (F.col("row") == 0)).alias("totals_errors"))
    return a.withColumn("k", F.lit(1)).join(r.withColumn("k", F.lit(1)), "k").drop("k")


def bai2_files(spark, sf_dir):
    line = "concat('16,', IF(direction = 'debit', '475', '175'), ',', CAST(amount_minor AS STRING), ',V,BR,', external_ref, ',note/\\n88,more/')"
    return _files(spark, sf_dir, line, "concat('01,S,R/\\n02,A,S,1,', date_format(value_date, 'yyMMdd'), ',0930,USD,2/\\n03,1,USD/\\n')", "'\\n49,1,3/\\n98,1/\\n99,1/'")


def _bai2(spark, sf_dir):
    return st.gate(st.parse_bai2(bai2_files(spark, sf_dir)))[0].select(*_SHOWN)


def camt_files(spark, sf_dir):
    line = f"concat('<Ntry><Amt Ccy=\"', currency, '\">', {_AMOUNT.format('.')}, '</Amt><CdtDbtInd>', IF(direction = 'debit', 'DBIT', 'CRDT'), '</CdtDbtInd><ValDt><Dt>', CAST(value_date AS STRING), '</Dt></ValDt><AcctSvcrRef>', external_ref, '</AcctSvcrRef><AddtlNtryInf>camt</AddtlNtryInf>', IF(counterparty_account IS NULL, '', concat('<RltdPties><DbtrAcct><Id><Othr><Id>', counterparty_account, '</Id></Othr></Id></DbtrAcct></RltdPties>')), '</Ntry>')"
    return _files(spark, sf_dir, line, "'<Document xmlns=\"urn:x\"><Stmt>'", "'</Stmt></Document>'")


def _camt(spark, sf_dir):
    return st.gate(st.parse_camt053(camt_files(spark, sf_dir)))[0].select(*_SHOWN)


def csv_files(spark, sf_dir, amount):
    """(files, their mapping)"""
    if amount == "signed":
        line = f"concat(external_ref, ';', date_format(value_date, 'd/M/yyyy'), ';', IF(direction = 'debit', '-', ''), {_AMOUNT.format('.')}, ';\"a;b\"')"
        mapping = {"delimiter": ";", "columns": {"external_ref": "ref", "value_date": "day", "description": "text"}, "date_format": "%d/%m/%Y", "amount": {"signed": "amount", "debit_when_negative": True}}
        files = _files(spark, sf_dir, line, "'ref;day;amount;text\\n'")
    else:
        line = f"concat(external_ref, ',', CAST(value_date AS STRING), ',', IF(direction = 'debit', {_AMOUNT.format('.')}, ''), ',', IF(direction = 'debit', '', {_AMOUNT.format('.')}), ',', coalesce(counterparty_account, ''))"
        mapping = {"has_header": False, "columns": {"external_ref": 0, "value_date": 1, "counterparty_account": 4}, "date_format": "%Y-%m-%d", "amount": {"debit": 2, "credit": 3}}
        files = _files(spark, sf_dir, line)
    return files, mapping


def _csv(spark, sf_dir, amount):
    return st.gate(st.parse_csv(*csv_files(spark, sf_dir, amount)))[0].select(*_SHOWN)


def text_files(spark, sf_dir):
    line = f"concat(date_format(value_date, 'dd/MM/yyyy'), '  ', external_ref, '  some text  ', IF(direction = 'debit', 'DR', 'CR'), '  ', {_AMOUNT.format('.')})"
    return _files(spark, sf_dir, line, "'Bank\\n\\nDate  Reference  Description  DR/CR  Amount\\n'", "'\\nPage 1 of 1'")


def _text(spark, sf_dir):
    return st.gate(st.parse_text_statement(text_files(spark, sf_dir)))[0].select(*_SHOWN)


def _layer(content: bytes) -> str:
    """The text of the made-up files below; a real extractor is the caller's library."""
    head, _, text = content.decode().partition("\n")
    if head != "%PDF":
        raise ValueError("not a PDF")
    return text


def pdf_files(spark, sf_dir):
    """Each day a file: on every eighth day of a year one without text, on every ninth one that cannot be read."""
    line = f"concat(date_format(value_date, 'dd/MM/yyyy'), '  ', external_ref, '  some text  ', IF(direction = 'debit', 'DR', 'CR'), '  ', {_AMOUNT.format('.')})"
    files = _files(spark, sf_dir, line, "'%PDF\n\nDate  Reference  Description  DR/CR  Amount\n'", "'\nPage 1 of 1'")
    day = F.dayofyear(F.to_date("path"))
    return files.select("path", F.when(day % 8 == 0, F.encode(F.lit("%PDF\n \n"), "UTF-8")).when(day % 9 == 0, F.encode(F.lit("?"), "UTF-8")).otherwise(F.col("content")).alias("content"))


def _pdf(spark, sf_dir):
    accepted, rejects = st.gate(st.PARSERS["pdf"](pdf_files(spark, sf_dir), extract=_layer))
    rows = accepted.select("path", F.lit("accepted").alias("what"), F.concat_ws("|", "external_ref", "direction", F.col("amount_minor").cast("string")).alias("detail"))
    return rows.unionByName(rejects.select("path", F.concat(F.lit("row "), F.col("row").cast("string")).alias("what"), "message").withColumnRenamed("message", "detail"))


def _detect(spark, sf_dir):
    """The files of every day in the format of that day, some of them behind a byte order mark or white space."""
    plain = {0: text_files, 1: camt_files, 2: bai2_files, 3: mt942_files, 4: mt940_files, 5: lambda s, d: csv_files(s, d, "signed")[0]}
    day = F.dayofyear(F.to_date("path"))
    parts = [files(spark, sf_dir).select("path", "content").where(day % 6 == k) for k, files in plain.items()]
    files = parts[0].select("path", F.concat(F.encode(F.lit("%PDF\n"), "UTF-8"), "content").alias("content"))
    for part in parts[1:]:
        files = files.unionByName(part)
    lead = F.when(day % 7 == 0, F.unhex(F.lit("EFBBBF2020"))).when(day % 7 == 1, F.unhex(F.lit("0D0A"))).otherwise(F.unhex(F.lit("")))
    files = files.withColumn("content", F.when(day % 6 == 0, F.col("content")).otherwise(F.concat(lead, "content")))
    return files.select("path", st.detect_format(F.col("content")).alias("format"))


def _by_sql(spark, sf_dir):
    """Every format registered as a view and read by SQL."""
    signed, mapping = csv_files(spark, sf_dir, "signed")
    formats = {
        "mt940": (mt940_files(spark, sf_dir), {"dialect": "subfielded"}), "mt942": (mt942_files(spark, sf_dir), {}), "bai2": (bai2_files(spark, sf_dir), {}),
        "camt053": (camt_files(spark, sf_dir), {}), "csv": (signed, {"mapping": mapping}), "text": (text_files(spark, sf_dir), {}),
        "pdf": (pdf_files(spark, sf_dir), {"extract": _layer}),
    }
    for fmt, (files, options) in formats.items():
        registry.register(spark, f"statements_{fmt}", files, fmt, **options)
    rows = " UNION ALL ".join(f"SELECT '{fmt}' AS format, direction, amount_minor, external_ref FROM statements_{fmt}" for fmt in formats)
    bad = " UNION ALL ".join(f"SELECT '{fmt}' AS format, path FROM statements_{fmt}_errors" for fmt in formats)
    return spark.sql(f"""
SELECT format, direction, count(*) AS n_rows, CAST(sum(amount_minor) AS BIGINT) AS amount_minor, max(external_ref) AS last_ref FROM ({rows}) r GROUP BY format, direction
UNION ALL SELECT format, 'refused', count(DISTINCT path), CAST(NULL AS BIGINT), max(path) FROM ({bad}) b GROUP BY format""")


#: What is odd in the rows and files of ``csv_column_errors``: k is the number of a row, d the day of its file.
_ODD = "CASE WHEN d % 5 = 0 THEN 'header' WHEN k % 97 = 0 THEN 'short' WHEN k % 89 = 0 THEN 'both' WHEN k % 83 = 0 THEN 'empty' WHEN k % 79 = 0 THEN 'date' WHEN k % 73 = 0 THEN 'ref' WHEN k % 71 = 0 THEN 'amount' ELSE '' END"


def _column_errors(spark, sf_dir):
    """Files of a day each: every fifth has a header the mapping does not know, others have short rows, two amounts, none, or fields that cannot be read."""
    amount = _AMOUNT.format(".")
    line = f"""(SELECT CASE odd WHEN 'short' THEN concat(external_ref, ',', CAST(value_date AS STRING)) ELSE concat(IF(odd = 'ref', ' ', external_ref), ',', IF(odd = 'date', '2026-02-31', CAST(value_date AS STRING)), ',',
      CASE WHEN odd = 'empty' THEN '' WHEN odd = 'amount' THEN '1.234' WHEN odd = 'both' OR direction = 'debit' THEN {amount} ELSE '' END, ',', CASE WHEN odd = 'empty' THEN '0.00' WHEN odd = 'both' OR direction <> 'debit' THEN {amount} ELSE '' END) END
    FROM (SELECT {_ODD} AS odd FROM (SELECT CAST(substr(id, 3) AS BIGINT) AS k, dayofyear(value_date) AS d) a) b)"""
    files = _files(spark, sf_dir, line, "'\n'")
    header = F.when(F.dayofyear(F.to_date("path")) % 5 == 0, "ref,day,out,in").otherwise("ref,date,out,in")
    files = files.select("path", F.concat(F.encode(header, "UTF-8"), "content").alias("content"))
    mapping = {"columns": {"external_ref": "ref", "value_date": "date"}, "date_format": "%Y-%m-%d", "amount": {"debit": "out", "credit": 3}}
    accepted, errors = st.gate(st.parse_csv(files, mapping))
    return errors.select("path", "row", "field", "message").unionByName(accepted.groupBy("path").agg(F.count("*").cast("int").alias("row")).select("path", "row", F.lit("accepted").alias("field"), F.lit("").alias("message")))


def _money(spark, sf_dir):
    o = frame(spark, sf_dir, "SELECT o_orderkey AS k, CAST(round(o_totalprice * 100) AS BIGINT) AS minor FROM orders")
    body = "concat(CAST(minor DIV 100000 AS STRING), ',', lpad(CAST((minor DIV 100) % 1000 AS STRING), 3, '0'), '.', lpad(CAST(minor % 100 AS STRING), 2, '0'))"
    text = F.expr(f"CASE k % 5 WHEN 0 THEN {body} WHEN 1 THEN concat('(', {body}, ')') WHEN 2 THEN concat(' -', {body}, ' ') WHEN 3 THEN concat('(-', {body}, ')') ELSE concat({body}, '1') END")
    return o.select("k", money_to_minor(text).alias("amount_minor"))


def _deduped(new, old):
    kept, refs = st.split_duplicates(new, old)
    return refs.withColumn("what", F.lit("repeat")).unionByName(kept.groupBy("source_id").agg(F.count("*").cast("string").alias("external_ref")).withColumn("what", F.lit("appended")))


def _dedupe(spark, sf_dir):
    """Every row on both sides; some refs of half of the sources are the same there."""
    rows = frame(spark, sf_dir, LEDGER).withColumn("k", F.expr("CAST(substr(id, 3) AS BIGINT)")).withColumn("source_id", F.concat(F.lit("s"), (F.col("k") % 40).cast("string")))
    old = rows.withColumn("external_ref", F.expr("CASE WHEN k % 40 < 20 AND k % 101 = 0 THEN external_ref ELSE concat(external_ref, '-old') END"))
    return _deduped(rows.drop("k"), old.drop("k"))


QUERIES = {
    "mt940_roundtrip": _mt940,
    "mt942_totals": _mt942,
    "bai2_roundtrip": _bai2,
    "camt_roundtrip": _camt,
    "csv_signed": lambda s, d: _csv(s, d, "signed"),
    "csv_debit_credit": lambda s, d: _csv(s, d, "both"),
    "text_statement_roundtrip": _text,
    "pdf_statements": _pdf,
    "detect_format": _detect,
    "sql_formats": _by_sql,
    "csv_column_errors": _column_errors,
    "money_parse": _money,
    "ingest_dedupe": _dedupe,
}

#: Two-digit years are of this century: 1995 comes back as 2095.
_CENTURY = "CAST(CASE WHEN year(value_date) < 2000 THEN value_date + INTERVAL 100 YEAR ELSE value_date END AS DATE) AS value_date"
_NULL = "CAST(NULL AS VARCHAR)"
_DEDUPE = f"SELECT *, concat('s', CAST(CAST(substr(id, 3) AS BIGINT) % 40 AS VARCHAR)) AS src FROM ({LEDGER}) l"
ORACLES = {
    "mt940_roundtrip": _LEDGER_ROWS.format(description="'[?00::P] pay'", account="counterparty_account").replace("value_date,", _CENTURY + ",", 1),
    "mt942_totals": f"""SELECT count(*) FILTER (NOT bad) AS accepted_rows, CAST(sum(amount_minor) FILTER (NOT bad) AS BIGINT) AS accepted_minor, count(DISTINCT value_date) FILTER (NOT bad) AS accepted_files,
  count(DISTINCT value_date) FILTER (bad) AS rejected_files, count(DISTINCT value_date) FILTER (bad) AS totals_errors
FROM (SELECT *, dayofyear(value_date) % 7 = 0 AS bad FROM ({LEDGER}) l) x""",
    "bai2_roundtrip": _LEDGER_ROWS.format(description="'note more'", account=_NULL).replace("value_date,", _CENTURY + ",", 1),
    "camt_roundtrip": _LEDGER_ROWS.format(description="'camt'", account="counterparty_account"),
    "csv_signed": _LEDGER_ROWS.format(description="'a;b'", account=_NULL),
    "csv_debit_credit": _LEDGER_ROWS.format(description="''", account="counterparty_account"),
    "text_statement_roundtrip": _LEDGER_ROWS.format(description="'some text'", account=_NULL),
    "pdf_statements": f"""
WITH f AS (SELECT *, CAST(value_date AS VARCHAR) AS path, dayofyear(value_date) AS d FROM ({LEDGER}) l)
SELECT path, 'accepted' AS what, concat(external_ref, '|', direction, '|', CAST(amount_minor AS VARCHAR)) AS detail FROM f WHERE d % 8 <> 0 AND d % 9 <> 0
UNION ALL SELECT DISTINCT path, 'row 0', CASE WHEN d % 8 = 0 THEN 'the pages hold no text' ELSE 'the file cannot be read as a PDF' END FROM f WHERE d % 8 = 0 OR d % 9 = 0""",
    "detect_format": f"""SELECT DISTINCT CAST(value_date AS VARCHAR) AS path, CASE dayofyear(value_date) % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'camt053' WHEN 2 THEN 'bai2' WHEN 3 THEN 'mt942' WHEN 4 THEN 'mt940' END AS format
FROM ({LEDGER}) l""",
    "sql_formats": f"""
WITH l AS (SELECT *, dayofyear(value_date) AS d FROM ({LEDGER}) l),
f AS (SELECT *, format = 'mt942' AND d % 7 = 0 OR format = 'pdf' AND (d % 8 = 0 OR d % 9 = 0) AS refused FROM l, (VALUES ('mt940'), ('mt942'), ('bai2'), ('camt053'), ('csv'), ('text'), ('pdf')) v(format))
SELECT format, direction, count(*) AS n_rows, CAST(sum(amount_minor) AS BIGINT) AS amount_minor, max(external_ref) AS last_ref FROM f WHERE NOT refused GROUP BY format, direction
UNION ALL SELECT format, 'refused', count(DISTINCT value_date), NULL, max(CAST(value_date AS VARCHAR)) FROM f WHERE refused GROUP BY format""",
    "csv_column_errors": f"""
WITH r AS (SELECT CAST(value_date AS VARCHAR) AS path, {_ODD} AS odd, CAST(row_number() OVER (PARTITION BY value_date ORDER BY id) + 1 AS INT) AS row
  FROM (SELECT *, CAST(substr(id, 3) AS BIGINT) AS k, dayofyear(value_date) AS d FROM ({LEDGER}) l) x),
e AS (
  SELECT path, row, 'valueDate' AS field, 'no column is named date' AS message FROM r WHERE odd = 'header'
  UNION ALL SELECT path, row, 'amount', 'the row ends before column 2' FROM r WHERE odd = 'short'
  UNION ALL SELECT path, row, 'amount', 'debit and credit are both set' FROM r WHERE odd = 'both'
  UNION ALL SELECT path, row, 'amount', 'debit and credit are both empty' FROM r WHERE odd = 'empty'
  UNION ALL SELECT path, row, 'valueDate', 'not a date: 2026-02-31' FROM r WHERE odd = 'date'
  UNION ALL SELECT path, row, 'externalRef', 'the reference is empty' FROM r WHERE odd = 'ref'
  UNION ALL SELECT path, row, 'amount', 'not an amount in the debit column' FROM r WHERE odd = 'amount')
SELECT * FROM e UNION ALL SELECT path, CAST(count(*) AS INT), 'accepted', '' FROM r WHERE path NOT IN (SELECT path FROM e) GROUP BY path""",
    "money_parse": "SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN m WHEN 1 THEN -m WHEN 2 THEN -m END AS amount_minor FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS m FROM orders) o",
    "ingest_dedupe": f"""
WITH n AS (SELECT *, CAST(substr(id, 3) AS BIGINT) AS k FROM ({_DEDUPE}) r),
d AS (SELECT DISTINCT src, external_ref FROM n WHERE k % 40 < 20 AND k % 101 = 0)
SELECT src AS source_id, external_ref, 'repeat' AS what FROM d
UNION ALL SELECT src, CAST(count(*) AS VARCHAR), 'appended' FROM n WHERE src NOT IN (SELECT src FROM d) GROUP BY src""",
}
