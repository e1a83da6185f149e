"""Bank and ledger statements to canonical transactions.

Files are rows (path, content BINARY), as ``spark.read.format("binaryFile")``
gives them; a statement file is small, files are many. Parsers give one row
per record with ``errors``; :func:`gate` keeps only files without any error.
"""

from __future__ import annotations

import csv
import io
import itertools
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tally.functions.exprs import money_to_minor, strftime_to_spark
from tally.storage import written

ERRORS = "array<struct<row:int,field:string,message:string>>"
#: Tags that end a transaction's lines, and tags that MT942 forbids.
MT940_ENDS = (":20:", ":25:", ":28C:", ":60F:", ":60M:", ":62F:", ":62M:", ":64:", ":65:")
MT942_ENDS = (":20:", ":25:", ":28C:", ":90D:", ":90C:")
MT942_FORBIDDEN = (":60F:", ":60M:", ":62F:", ":62M:", ":64:", ":65:")
#: BAI2 detail codes by direction.
BAI2_CREDIT = ("100", "108", "115", "175", "195", "301", "399")
BAI2_DEBIT = ("400", "408", "409", "475", "495", "555", "595")
#: Records that a parser hands on at a time, about.
RECORDS = 5_000
COLUMNS = ("external_ref", "value_date", "posted_at", "amount_minor", "currency", "direction", "counterparty", "description", "counterparty_bic", "counterparty_account")


def text_of(content: Column) -> Column:
    """UTF-8, or else Latin-1."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.decode(content, "ISO-8859-1"))


def detect_format(content: Column) -> Column:
    """pdf, camt053, bai2, mt942, mt940 or null; CSV is never guessed."""
    raw = F.decode(content, "ISO-8859-1")
    lead = F.regexp_replace(raw, "^(?:ï»¿)?[ \\t\\r\\n\\f]*", "")
    intraday = F.contains(raw, F.lit(":34F:")) | F.contains(raw, F.lit(":90D:")) | F.contains(raw, F.lit(":90C:"))
    return (
        F.when(raw.startswith("%PDF"), "pdf")
        .when(lead.startswith("<"), "camt053")
        .when(lead.startswith("01,") | lead.startswith("02,"), "bai2")
        .when(F.contains(raw, F.lit(":20:")), F.when(intraday, "mt942").otherwise("mt940"))
    )


def fingerprint(files: DataFrame) -> DataFrame:
    """(path, sha256, bytes) of the exact contents."""
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("bigint").alias("bytes"))


def _problems(row: Column, *checks: tuple[Column, str, str | Column]) -> Column:
    """Errors of the checks whose condition holds."""
    found = F.array(*[F.when(c, F.struct(row.cast("int").alias("row"), F.lit(f).alias("field"), (F.lit(m) if isinstance(m, str) else m).alias("message"))) for c, f, m in checks])
    return F.filter(found, lambda e: e.isNotNull()).cast(ERRORS)


def _ladder(row: Column, *checks: tuple[Column, str, str]) -> Column:
    """The error of the first check whose condition holds."""
    first = None
    for c, f, m in checks:
        e = F.struct(row.cast("int").alias("row"), F.lit(f).alias("field"), F.lit(m).alias("message"))
        first = F.when(c, e) if first is None else first.when(c, e)
    return F.filter(F.array(first), lambda e: e.isNotNull()).cast(ERRORS)


def _lines(files: DataFrame, text: Column) -> DataFrame:
    rows = files.select("path", F.posexplode(F.split(text, "\n", -1)).alias("pos", "raw"))
    return rows.select("path", (F.col("pos") + 1).alias("row"), F.regexp_replace("raw", "\r$", "").alias("line"))


def _blank(c: Column) -> Column:
    return F.when(F.length(c) > 0, c)


def _as_parsed(df: DataFrame, **cols: Column) -> DataFrame:
    kinds = {"value_date": "date", "amount_minor": "bigint"}
    return df.select("path", "row", *[cols.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in COLUMNS], "errors")


def _yymmdd(text: Column) -> Column:
    return F.try_to_date(F.concat(F.lit("20"), text), "yyyyMMdd")


def parse_mt94x(files: DataFrame, dialect: str = "generic", intraday: bool = False) -> DataFrame:
    """MT940, or MT942 if ``intraday``: one row per ``:61:`` line, and one per forbidden tag or wrong total."""
    ends = MT942_ENDS if intraday else MT940_ENDS
    lines = _lines(files, text_of(F.col("content")))
    lines = lines.withColumn("tag", F.regexp_extract("line", "^(:[^:]*:)", 1)).withColumn("rest", F.regexp_replace("line", "^:[^:]*:", ""))
    # A file's lines are few; they are one window.
    in_file = Window.partitionBy("path").orderBy("row")
    lines = lines.withColumn("part", F.sum(F.col("tag").isin(":61:", *ends).cast("int")).over(in_file))
    piece = F.when(F.col("tag") == ":86:", F.col("rest")).when(~F.col("line").startswith(":"), F.col("line"))
    entries = lines.groupBy("path", "part").agg(
        F.min(F.when(F.col("tag") == ":61:", F.col("row"))).alias("row"),
        F.max(F.when(F.col("tag") == ":61:", F.col("rest"))).alias("body"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(piece.isNotNull(), F.struct("row", piece.alias("t"))))), lambda p: p["t"]), "").alias("info"),
    ).where("row is not null")
    shape = r"^([0-9]{6})(?:[0-9]{4})?(R?[DC])(?:[A-Za-z](?=[0-9]))?([0-9,]+)([NS][A-Za-z]{3})(.*)$"
    got = lambda k: F.regexp_extract("body", shape, k)
    amount_text = F.replace(F.regexp_extract("body", r"^[0-9]{6}(?:[0-9]{4})?R?[DC](?:[A-Za-z](?=[0-9]))?([0-9,]+)", 1), F.lit(","), F.lit("."))
    e = entries.select(
        "path", "row", "body", "info", got(2).alias("mark"), money_to_minor(amount_text).alias("amount"), amount_text.alias("amount_text"),
        F.trim(F.split(got(5), "//", 2)[0]).alias("customer"), F.trim(F.get(F.split(got(5), "//", 2), F.lit(1))).alias("bank"),
        _yymmdd(F.substring("body", 1, 6)).alias("day"),
    )
    ref = F.coalesce(_blank(F.col("customer")), _blank(F.col("bank")))
    errors = _ladder(
        F.col("row"),
        (~F.col("body").rlike("^[0-9]{6}"), "date", "expected YYMMDD"),
        (~F.col("body").rlike("^[0-9]{6}(?:[0-9]{4})?R?[DC]"), "dc_mark", "expected D, C, RD or RC"),
        (F.col("amount").isNull(), "amount", "missing or invalid amount"),
        (~F.col("body").rlike(shape), "type_code", "missing or invalid transaction type code"),
        (ref.isNull(), "external_ref", "no customer or bank reference"),
        (F.col("day").isNull(), "value_date", "no such day"),
    )
    parts = F.split("info", r"\?", -1)
    subs = F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda c: F.length(c) >= 2)
    code, val = lambda c: F.substring(c, 1, 2), lambda c: F.substring(c, 3, 1_000_000)
    shown = F.transform(
        F.filter(subs, lambda c: ~code(c).isin("32", "33")),
        lambda c: F.when(code(c).rlike("^2[0-9]$"), val(c)).when(code(c).isin("30", "31"), F.concat(F.lit("["), code(c), F.lit(":"), val(c), F.lit("]"))).otherwise(F.concat(F.lit("[?"), code(c), F.lit(":"), val(c), F.lit("]"))),
    )
    lead = F.when(F.length(parts[0]) > 0, F.array(parts[0])).otherwise(F.array().cast("array<string>"))
    first_of = lambda k: F.get(F.filter(F.transform(F.filter(subs, lambda c: code(c) == k), lambda c: F.trim(val(c))), lambda v: F.length(v) > 0), F.lit(0))
    sub = dialect == "subfielded"
    rows = _as_parsed(
        e.withColumn("errors", errors),
        external_ref=ref,
        value_date=F.col("day"),
        amount_minor=F.col("amount"),
        direction=F.when(F.col("mark").isin("D", "RC"), "debit").otherwise("credit"),
        description=F.trim(F.array_join(F.concat(lead, shown), " ")) if sub else F.col("info"),
        counterparty_bic=F.upper(first_of("33")) if sub else F.lit(None),
        counterparty_account=first_of("32") if sub else F.lit(None),
    )
    if not intraday:
        return rows
    forbidden = lines.where(F.col("tag").isin(*MT942_FORBIDDEN))
    wrong = _as_parsed(forbidden.withColumn("errors", _problems(F.col("row"), (F.lit(True), "tag", "balance tag in an intraday report"))))
    return rows.unionByName(wrong).unionByName(_wrong_totals(lines, rows))


def _wrong_totals(lines: DataFrame, rows: DataFrame) -> DataFrame:
    """Row 0 errors of files whose declared counts and sums do not fit."""
    shape = r"^([0-9]+)[A-Z]{3}([0-9,]+)$"
    said = lines.where(F.col("tag").isin(":90D:", ":90C:")).select(
        "path", "row", F.when(F.col("tag") == ":90D:", "debit").otherwise("credit").alias("direction"),
        F.regexp_extract(F.trim("rest"), shape, 1).try_cast("bigint").alias("n"), money_to_minor(F.replace(F.regexp_extract(F.trim("rest"), shape, 2), F.lit(","), F.lit("."))).alias("total"),
    )
    last = said.groupBy("path", "direction").agg(F.max_by(F.struct("n", "total"), "row").alias("said"))
    real = rows.where(F.size("errors") == 0).groupBy("path", "direction").agg(F.count("*").alias("own_n"), F.sum("amount_minor").alias("own_total"))
    j = last.join(real, ["path", "direction"], "left")
    fits = (F.col("said.n") == F.coalesce("own_n", F.lit(0))) & (F.col("said.total") == F.coalesce("own_total", F.lit(0)))
    bad = j.where(~F.coalesce(fits, F.lit(False))).select("path", F.lit(0).alias("row"))
    return _as_parsed(bad.withColumn("errors", _problems(F.col("row"), (F.lit(True), "totals", "control totals do not fit"))))


def parse_bai2(files: DataFrame) -> DataFrame:
    """BAI2: one row per 16 record, and one per record with an error."""
    raw = F.decode(F.col("content"), "ISO-8859-1")
    foreign = files.where(raw.rlike("[^\\x00-\\x7F]"))
    encoding = _as_parsed(foreign.select("path", F.lit(0).alias("row")).withColumn("errors", _problems(F.col("row"), (F.lit(True), "encoding", "not ASCII"))))
    lines = _lines(files.where(~raw.rlike("[^\\x00-\\x7F]")), raw)
    lines = lines.withColumn("line", F.trim(F.regexp_replace("line", "/+$", ""))).where(F.length("line") > 0)
    lines = lines.withColumn("f", F.transform(F.split("line", ",", -1), lambda x: F.trim(x))).withColumn("kind", F.get("f", F.lit(0)))
    at = lambda k: F.coalesce(F.get("f", F.lit(k)), F.lit(""))
    in_file = Window.partitionBy("path").orderBy("row")
    lines = lines.withColumn("day", F.last(F.when(F.col("kind") == "02", _yymmdd(_blank(at(4)))), ignorenulls=True).over(in_file))
    lines = lines.withColumn("part", F.sum((F.col("kind") == "16").cast("int")).over(in_file))
    more = F.when(F.col("kind") == "88", F.struct("row", F.array_join(F.slice("f", 2, F.greatest(F.size("f") - 1, F.lit(0))), ",").alias("t")))
    extra = lines.groupBy("path", "part").agg(F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(more)), lambda m: m["t"]), lambda t: F.length(t) > 0), " ").alias("more"))
    detail = lines.where("kind = '16'").join(extra, ["path", "part"], "left")
    amount = at(2)
    ref = F.coalesce(_blank(at(5)), _blank(at(4)))
    errors = _ladder(
        F.col("row"),
        (F.size("f") < 3, "type_code", "record too short"),
        (~at(1).isin(*BAI2_CREDIT, *BAI2_DEBIT), "type_code", "unknown type code"),
        (~amount.rlike("^[0-9]+$") | amount.try_cast("bigint").isNull(), "amount", "missing or invalid amount"),
        (ref.isNull(), "external_ref", "no customer or bank reference"),
        (F.col("day").isNull(), "value_date", "no group header before this record"),
    )
    own = F.regexp_extract("line", "^(?:[^,]*,){6}(.*)$", 1)
    rows = _as_parsed(
        detail.withColumn("errors", errors),
        external_ref=ref,
        value_date=F.col("day"),
        amount_minor=amount.try_cast("bigint"),
        direction=F.when(at(1).isin(*BAI2_CREDIT), "credit").otherwise("debit"),
        description=F.concat_ws(" ", _blank(own), _blank(F.col("more"))),
    )
    unknown = lines.where(~F.col("kind").isin("01", "02", "03", "16", "49", "88", "98", "99"))
    odd = _as_parsed(unknown.withColumn("errors", _problems(F.col("row"), (F.lit(True), "type_code", "unsupported record type"))))
    undated = lines.where((F.col("kind") == "02") & (F.length(at(4)) > 0) & _yymmdd(at(4)).isNull())
    late = _as_parsed(undated.withColumn("errors", _problems(F.col("row"), (F.lit(True), "as_of_date", "expected YYMMDD"))))
    return rows.unionByName(odd).unionByName(late).unionByName(encoding)


def _dealt(files: DataFrame) -> DataFrame:
    """(path, content) dealt out by path: a few MB of files are little to read, but much to parse for one task."""
    return files.select("path", "content").repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")


def _in_batches(records: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Tuples as batches of RECORDS rows; no more of them are held."""
    while some := list(itertools.islice(records, RECORDS)):
        yield pa.RecordBatch.from_arrays([pa.array(values, f.type) for f, values in zip(schema, zip(*some))], schema=schema)


def _records(delimiter: str, has_header: bool, refs: list):
    """The cells of ``refs`` (index or header) in each record, and where they are in its file; -1 for a header that is not there."""
    schema = pa.schema([("path", pa.string()), ("row", pa.int32()), ("places", pa.list_(pa.int32())), ("cells", pa.list_(pa.string()))])

    def of_file(path: str, content: bytes) -> Iterator[tuple]:
        text = io.TextIOWrapper(io.BytesIO(content), encoding="utf-8", errors="replace", newline="")
        records = (r for r in csv.reader(text, delimiter=delimiter) if r)
        header = [h.strip() for h in next(records, [])] if has_header else []
        places = [r if isinstance(r, int) else header.index(r) if r in header else -1 for r in refs]
        for n, fields in enumerate(records, 2 if has_header else 1):
            yield path, n, places, [fields[p] if 0 <= p < len(fields) else None for p in places]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _in_batches((r for b in batches for path, content in zip(*b.columns) for r in of_file(path.as_py(), content.as_py() or b"")), schema)

    return read


def parse_csv(files: DataFrame, mapping: dict) -> DataFrame:
    """Delimited text by a mapping.

    ``mapping``: has_header, delimiter, columns {name: index or header} for
    external_ref, value_date, description and optionally currency,
    counterparty, counterparty_bic, counterparty_account; date_format
    (strftime); amount {"signed": column, "debit_when_negative": bool} or
    {"debit": column, "credit": column}.
    """
    refs = list(dict.fromkeys([*mapping["columns"].values(), *(v for k, v in mapping["amount"].items() if k != "debit_when_negative")]))
    rows = _dealt(files).mapInArrow(_records(mapping.get("delimiter", ","), mapping.get("has_header", True), refs), "path string, row int, places array<int>, cells array<string>")

    def place(ref) -> Column:
        return F.lit(ref) if isinstance(ref, int) else F.get("places", F.lit(refs.index(ref)))

    def at(ref) -> Column:
        return F.col(f"c{refs.index(ref)}")

    def absent(ref) -> Column:
        """What is wrong with a reference to a column in this row, or null."""
        unknown = F.when(place(ref) < 0, f"no column is named {ref}")
        return unknown.when(at(ref).isNull(), F.concat(F.lit("the row ends before column "), place(ref).cast("string")))

    cols = mapping["columns"]
    optional = {c: at(cols[c]) for c in ("currency", "counterparty", "counterparty_bic", "counterparty_account") if c in cols}
    how = mapping["amount"]
    # What several columns and checks are made from is a column, so that it is worked out once a row.
    rows = rows.select("path", "row", "places", *[F.trim(F.get("cells", F.lit(k))).alias(f"c{k}") for k in range(len(refs))])
    money = {f"minor_{k}": money_to_minor(at(how[k])) for k in ("signed", "debit", "credit") if k in how}
    rows = rows.withColumns({"day": F.try_to_date(at(cols["value_date"]), strftime_to_spark(mapping["date_format"])), **money})
    day = F.col("day")
    if "signed" in how:
        signed = F.col("minor_signed")
        amount, fine = F.abs(signed), signed.isNotNull()
        debit = (signed < 0) == F.lit(how.get("debit_when_negative", True))
        problem = F.coalesce(absent(how["signed"]), F.when(~fine, "not an amount"))
    else:
        zero = F.lit(0).cast("bigint")
        text = {k: at(how[k]) for k in ("debit", "credit")}
        d, c = (F.when(F.length(t) > 0, F.col(f"minor_{k}")).otherwise(zero) for k, t in text.items())
        debit = d != 0
        amount = F.abs(F.when(debit, d).otherwise(c))
        # One error an amount: of the columns, then of what they hold, then of both together.
        problem = F.coalesce(
            absent(how["debit"]), absent(how["credit"]), F.when(d.isNull(), "not an amount in the debit column"), F.when(c.isNull(), "not an amount in the credit column"),
            F.when((d != 0) & (c != 0), "debit and credit are both set"), F.when((d == 0) & (c == 0), "debit and credit are both empty"),
        )
    ref, date = cols["external_ref"], cols["value_date"]
    columns = {"externalRef": F.coalesce(absent(ref), F.when(F.length(at(ref)) == 0, "the reference is empty")), "valueDate": F.coalesce(absent(date), F.when(day.isNull(), F.concat(F.lit("not a date: "), at(date))))}
    columns |= {c: absent(cols[c]) for c in ("description", "counterparty_bic", "counterparty_account") if c in cols}
    columns["amount"] = problem
    errors = _problems(F.col("row"), *[(why.isNotNull(), field, why) for field, why in columns.items()])
    return _as_parsed(
        rows.withColumn("errors", errors),
        external_ref=_blank(at(cols["external_ref"])),
        value_date=day,
        amount_minor=amount,
        direction=F.when(debit, "debit").otherwise("credit"),
        description=F.coalesce(at(cols["description"]), F.lit("")) if "description" in cols else F.lit(""),
        currency=_blank(optional.get("currency", F.lit(None).cast("string"))),
        counterparty=_blank(optional.get("counterparty", F.lit(None).cast("string"))),
        counterparty_bic=F.upper(_blank(optional.get("counterparty_bic", F.lit(None).cast("string")))),
        counterparty_account=_blank(optional.get("counterparty_account", F.lit(None).cast("string"))),
    )


#: What is read of an entry of CAMT.053.
ENTRY = ("amount", "currency", "CdtDbtInd", "AcctSvcrRef", "NtryRef", "Ustrd", "AddtlNtryInf", "ValDt", "BookgDt", *(f"{side}_{what}" for side in ("Cdtr", "Dbtr") for what in ("bic", "account", "name")))


def _key(path: tuple[str, ...]) -> str | None:
    """Under what name the text of an element at ``path`` inside its entry is kept; one of a party keeps the first."""
    *above, name = path
    if name == "Amt":
        return "amount"
    if name in ("CdtDbtInd", "AcctSvcrRef", "NtryRef", "Ustrd", "AddtlNtryInf"):
        return name
    if name in ("Dt", "DtTm") and above and above[-1] in ("ValDt", "BookgDt"):
        return above[-1]
    side = next((s for s in ("Cdtr", "Dbtr") if any(a.startswith(s) for a in above)), None)
    if side and (name in ("BIC", "BICFI", "IBAN") or name == "Id" and above[-1] == "Othr"):
        return f"{side}_{'bic' if name.startswith('BIC') else 'account'}"
    return f"{side}_name" if side and name == "Nm" and above[-1] == side else None


class Places(dict):
    """(place above, tag) -> (path, its key): what an element is depends on its path only, and files repeat few paths."""

    def __missing__(self, at: tuple) -> tuple:
        (above, _), tag = at
        path = (*above, tag.rsplit("}", 1)[-1])
        place = self[at] = (path, _key(path))
        return place


def _entry(entry: ET.Element, places: Places) -> dict[str, str]:
    """The text of an entry's elements: the last of a path, for parties the first."""
    got: dict[str, str] = {}
    stack = [(entry, ((), None))]
    while stack:
        e, place = stack.pop()
        if len(e):
            stack += [(c, places[place, c.tag]) for c in reversed(e)]
        key = place[1]
        if key is None:
            continue
        text = (e.text or "").strip()
        if key == "amount":
            got["amount"], got["currency"] = text, e.get("Ccy") or ""
        elif key in ("ValDt", "BookgDt"):
            got[key] = text[:10]
        elif key.startswith(("Cdtr_", "Dbtr_")):
            got.setdefault(key, text)
        else:
            got[key] = text
    return got


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, row, f) of each ``Ntry``; null f for broken XML, of which no entry is read."""
    schema = pa.schema([("path", pa.string()), ("row", pa.int32()), ("f", pa.struct([(k, pa.string()) for k in ENTRY]))])

    places = Places()

    def of_file(path: str, content: bytes) -> Iterator[tuple]:
        try:
            root = ET.fromstring(content)
        except ET.ParseError:
            yield path, 0, None
            return
        for n, entry in enumerate((e for e in root.iter() if e.tag.rsplit("}", 1)[-1] == "Ntry"), 1):
            yield path, n, _entry(entry, places)

    return _in_batches((r for b in batches for path, content in zip(*b.columns) for r in of_file(path.as_py(), content.as_py() or b"")), schema)


def parse_camt053(files: DataFrame) -> DataFrame:
    """CAMT.053: one row per entry; namespaces do not matter."""
    rows = _dealt(files).mapInArrow(_entries, f"path string, row int, f struct<{','.join(f'{k}:string' for k in ENTRY)}>")
    f = lambda k: _blank(F.col("f")[k])
    ref = F.coalesce(f("AcctSvcrRef"), f("NtryRef"))
    rows = rows.withColumns({"minor": money_to_minor(f("amount")), "day": F.try_to_date(f("ValDt"), "yyyy-MM-dd")})
    amount, day = F.col("minor"), F.col("day")
    broken = F.col("f").isNull()
    errors = F.when(broken, _problems(F.col("row"), (broken, "xml", "malformed XML"))).otherwise(
        _problems(
            F.col("row"),
            (ref.isNull(), "externalRef", "no reference"),
            (amount.isNull(), "amount", "missing or invalid amount"),
            (~F.coalesce(f("CdtDbtInd").isin("DBIT", "CRDT"), F.lit(False)), "creditDebit", "expected DBIT or CRDT"),
            (day.isNull(), "valueDate", "missing or invalid date"),
        )
    )
    credit = f("CdtDbtInd") == "CRDT"
    party = lambda k: F.when(credit, F.coalesce(f(f"Dbtr_{k}"), f(f"Cdtr_{k}"))).otherwise(F.coalesce(f(f"Cdtr_{k}"), f(f"Dbtr_{k}")))
    return _as_parsed(
        rows.withColumn("errors", errors),
        external_ref=ref,
        value_date=day,
        posted_at=F.concat(f("BookgDt"), F.lit("T00:00:00Z")),
        amount_minor=F.abs(amount),
        currency=f("currency"),
        direction=F.when(credit, "credit").otherwise("debit"),
        counterparty=party("name"),
        description=F.coalesce(f("Ustrd"), f("AddtlNtryInf"), F.lit("")),
        counterparty_bic=F.upper(party("bic")),
        counterparty_account=party("account"),
    )


def parse_text_statement(files: DataFrame) -> DataFrame:
    """The text layer of a five-column statement: date, reference, description, DR/CR, amount, two or more spaces apart."""
    lines = _lines(files, text_of(F.col("content"))).withColumn("line", F.trim("line")).where(F.length("line") > 0)
    order = Window.partitionBy("path").orderBy("row")
    low = F.lower("line")
    lines = lines.withColumn("n", F.row_number().over(order)).withColumn("head", (F.contains(low, F.lit("date")) & F.contains(low, F.lit("description"))).cast("int"))
    body = lines.withColumn("seen", F.sum("head").over(order) - F.col("head")).where("seen > 0")
    body = body.where(~low.rlike("^(page |closing balance|opening balance|total|end of)")).drop("row").withColumnRenamed("n", "row").withColumn("c", F.split("line", " {2,}"))
    at = lambda k: F.get("c", F.lit(k))
    body = body.withColumns({"day": F.try_to_date(at(0), "d/M/yyyy"), "minor": money_to_minor(at(4))})
    day, amount = F.col("day"), F.col("minor")
    errors = _ladder(
        F.col("row"),
        (F.size("c") != 5, "columns", "expected five columns"),
        (day.isNull(), "valueDate", "missing or invalid date"),
        (~at(3).isin("DR", "CR"), "direction", "expected DR or CR"),
        (amount.isNull(), "amount", "missing or invalid amount"),
    )
    return _as_parsed(body.withColumn("errors", errors), external_ref=at(1), value_date=day, amount_minor=amount, direction=F.when(at(3) == "DR", "debit").otherwise("credit"), description=at(2))


#: Fixed value: the name of the one known layout of PDF statements. A further one is a function files of text -> parsed rows.
PDF_PROFILES = {"acmebank": parse_text_statement}


def parse_pdf(files: DataFrame, extract, profile: str = "acmebank") -> DataFrame:
    """Text-layer PDF statements: ``extract`` takes a file's bytes to its text, and the profile's parser reads it.

    ``extract`` is a function of the caller's PDF library; a file that it
    fails on, and one without text, is an error of the document (row 0).
    ValueError for an unknown profile.
    """
    if profile not in PDF_PROFILES:
        raise ValueError(f"unknown profile {profile!r}")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, problems = [], []
            for content in b["content"]:
                try:
                    text, problem = extract(bytes(content)), None
                except Exception:  # whatever a library raises on a malformed file
                    text, problem = "", "the file cannot be read as a PDF"
                if problem is None and not text.strip():
                    problem = "the pages hold no text"
                texts.append(text.encode())
                problems.append(problem)
            yield pd.DataFrame({"path": b["path"], "content": texts, "problem": problems})

    read_files = _dealt(files).mapInPandas(read, "path string, content binary, problem string")
    good = PDF_PROFILES[profile](read_files.where("problem is null").select("path", "content"))
    error = F.array(F.struct(F.lit(0).alias("row"), F.lit("document").alias("field"), F.col("problem").alias("message"))).cast(ERRORS)
    bad = read_files.where("problem is not null").withColumn("row", F.lit(0)).withColumn("errors", error)
    return good.unionByName(_as_parsed(bad))


#: Parsers by format; a further one is a function files -> parsed rows.
PARSERS = {
    "pdf": lambda files, **o: parse_pdf(files, o["extract"], o.get("profile", "acmebank")),
    "mt940": lambda files, **o: parse_mt94x(files, o.get("dialect", "generic")),
    "mt942": lambda files, **o: parse_mt94x(files, o.get("dialect", "generic"), intraday=True),
    "bai2": lambda files, **o: parse_bai2(files),
    "camt053": lambda files, **o: parse_camt053(files),
    "csv": lambda files, **o: parse_csv(files, o["mapping"]),
    "text": lambda files, **o: parse_text_statement(files),
}


def gate(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, (path, row, field, message) of rejected files): a file with any error is rejected whole.

    The parsed rows are written once, for both results are read from them.
    """
    parsed = written(parsed, "parsed")
    rejects = parsed.select("path", F.explode("errors").alias("e")).select("path", "e.*")
    accepted = parsed.join(rejects.select("path").distinct(), "path", "left_anti").drop("errors")
    return accepted, rejects


def canonical(accepted: DataFrame, tenant_id: str, source_id: str, currency: str) -> DataFrame:
    """Rows as canonical transactions; ids follow from source and reference, so a replay gives the same."""
    return accepted.select(
        F.concat(F.lit("txn-"), F.substring(F.sha2(F.concat_ws("/", F.lit(source_id), "external_ref"), 256), 1, 32)).alias("id"),
        F.lit(tenant_id).alias("tenant_id"), F.lit(source_id).alias("source_id"), "external_ref", "value_date",
        F.coalesce(F.to_timestamp("posted_at"), F.col("value_date").cast("timestamp")).alias("posted_at"),
        "amount_minor", F.coalesce("currency", F.lit(currency)).alias("currency"), "direction", "counterparty", "description", "counterparty_bic", "counterparty_account",
    )


def split_duplicates(new: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to append, references that repeat): repeats inside the batch or references the source has already.

    One repeat refuses the whole batch of a source.
    """
    within = new.groupBy("source_id", "external_ref").agg(F.count("*").alias("n")).where("n > 1").select("source_id", "external_ref")
    known = new.select("source_id", "external_ref").join(existing.select("source_id", "external_ref").distinct(), ["source_id", "external_ref"], "left_semi")
    refs = within.unionByName(known).distinct()
    return new.join(refs.select("source_id").distinct(), "source_id", "left_anti"), refs
