import datetime as dt

import pyarrow as pa
import pytest

from tally.functions.exprs import money_to_minor, strftime_to_spark
from tally.operators import audit
from tally.sources import statements as st


def files(spark, *texts):
    return spark.createDataFrame([(f"f{k}", bytearray(t if isinstance(t, bytes) else t.encode())) for k, t in enumerate(texts)], "path string, content binary")


@pytest.mark.parametrize("text,minor", [("80.19", 8019), ("7", 700), ("3.4", 340), ("9,081.72", 908172), ("(61.30)", -6130), ("-0.05", -5), ("\t", None), ("8.041", None), ("8o", None), ("70000000000000000000", None), ("(-3)", None)])
def test_money(spark, text, minor):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(money_to_minor(df.t)).first()[0] == minor


def test_strftime():
    assert strftime_to_spark("%d/%m/%Y") == "d/M/yyyy"


def rows(df):
    return [(r.external_ref, r.direction, r.amount_minor, r.value_date) for r in df.orderBy("row").collect()]


MT940 = ":20:Q\n:25:K\n:60F:C240318EUR0,00\n:61:240318D71,30NTRFNONE//HX-77\n:61:2403180318C8,05NTRFOURS/41\n:86:rent for\nthe shed\n:62F:C240318EUR0,00"


def test_mt940(spark):
    ok, bad = st.gate(st.parse_mt94x(files(spark, MT940)))
    assert rows(ok) == [("NONE", "debit", 7130, dt.date(2024, 3, 18)), ("OURS/41", "credit", 805, dt.date(2024, 3, 18))]
    assert [r.description for r in ok.orderBy("row").collect()] == ["", "rent forthe shed"]
    assert bad.count() == 0


def test_mt940_errors_reject_the_file(spark):
    ok, bad = st.gate(st.parse_mt94x(files(spark, ":61:240318Q9,00NTRFK", ":61:240318D9,00NTRF//", ":61:240318D9,00NTRFK")))
    assert sorted((r.path, r.row, r.field) for r in bad.collect()) == [("f0", 1, "dc_mark"), ("f1", 1, "external_ref")]
    assert [r.path for r in ok.collect()] == ["f2"]


def test_subfields(spark):
    text = ":61:240402C64,00NTRFOURS/42\n:86:?00MIETE?20April, flat 9?32NL02ABNA0123456789?33abnanl2a"
    r = st.gate(st.parse_mt94x(files(spark, text), "subfielded"))[0].first()
    assert (r.description, r.counterparty_account, r.counterparty_bic) == ("[?00:MIETE] April, flat 9", "NL02ABNA0123456789", "ABNANL2A")


def test_mt942_totals_and_forbidden_tags(spark):
    good = ":20:Q\n:34F:EUR0,00\n:61:240405D33,10NTRFU\n:61:240405C81,40NTRFV\n:90D:1EUR33,10\n:90C:1EUR81,40"
    ok, bad = st.gate(st.parse_mt94x(files(spark, good, good.replace("1EUR81", "2EUR81"), ":60F:X\n" + good), intraday=True))
    assert ok.select("path").distinct().collect()[0].path == "f0" and ok.count() == 2
    assert sorted((r.path, r.row, r.field) for r in bad.collect()) == [("f1", 0, "totals"), ("f2", 1, "tag")]


BAI2 = "01,H,T/\n02,K,H,1,240411,1715,CHF,2/\n03,9,CHF/\n16,175,4410,V,HX-78,OURS/43,Coins counted/\n88,by the till/\n16,475,905,V,HX-79,,p, q/\n99,1/"


def test_bai2(spark):
    ok, _ = st.gate(st.parse_bai2(files(spark, BAI2)))
    assert rows(ok) == [("OURS/43", "credit", 4410, dt.date(2024, 4, 11)), ("HX-79", "debit", 905, dt.date(2024, 4, 11))]
    assert [r.description for r in ok.orderBy("row").collect()] == ["Coins counted by the till", "p, q"]
    _, bad = st.gate(st.parse_bai2(files(spark, BAI2.replace("16,475", "16,501"), "16,175,8,V,K,L,m/", BAI2.replace("p, q", "é"), "77,1/")))
    assert sorted((r.path, r.field) for r in bad.collect()) == [("f0", "type_code"), ("f1", "value_date"), ("f2", "encoding"), ("f3", "type_code")]


def test_camt(spark):
    doc = '<D xmlns="u"><Ntry><Amt Ccy="SEK">48.60</Amt><CdtDbtInd>DBIT</CdtDbtInd><ValDt><Dt>2024-04-15</Dt></ValDt><BookgDt><Dt>2024-04-16</Dt></BookgDt><AcctSvcrRef>HX-80</AcctSvcrRef></Ntry></D>'
    ok, bad = st.gate(st.parse_camt053(files(spark, doc, "<broken", doc.replace("DBIT", "?"))))
    r = ok.first()
    assert (r.external_ref, r.direction, r.amount_minor, r.currency, r.posted_at) == ("HX-80", "debit", 4860, "SEK", "2024-04-16T00:00:00Z")
    assert sorted((r.path, r.field) for r in bad.collect()) == [("f1", "xml"), ("f2", "creditDebit")]


def test_csv(spark):
    mapping = {"columns": {"external_ref": "ref", "value_date": "date", "description": "desc", "currency": "ccy"}, "date_format": "%Y-%m-%d", "amount": {"signed": "amount", "debit_when_negative": True}}
    head = "ref,date,amount,ccy,desc\n"
    ok, bad = st.gate(st.parse_csv(files(spark, head + "K7,2024-04-17,-6.15,NOK,soap\nK8,2024-04-17,23,,rope\n", head + "K7,2024-04-17,2,NOK,soap\nK8,2024-02-30,2,NOK,soap\nK9,2024-04-17,?,NOK,soap\n"), mapping))
    assert [r[:3] for r in rows(ok)] == [("K7", "debit", 615), ("K8", "credit", 2300)]
    assert sorted((r.path, r.row, r.field) for r in bad.collect()) == [("f1", 3, "valueDate"), ("f1", 4, "amount")]


def test_sniff(spark):
    texts = ["%PDF-", "﻿ <a/>", "01,x", ":20:a\n:34F:x", ":20:a", "ref,date"]
    got = files(spark, *texts).selectExpr("path", "content").orderBy("path")
    assert [r[0] for r in got.select(st.detect_format(got.content)).collect()] == ["pdf", "camt053", "bai2", "mt942", "mt940", None]


def test_audit_golden_vector(spark):
    # The published hash of this entry.
    row = spark.createDataFrame([("tenant-acme", 1, "2026-05-26T10:00:00Z", "user-mia", "auth.logout", '{"data":{"ip":null,"user_id":"user-mia"},"kind":"auth_logout"}', bytearray(32))], "tenant_id string, seq bigint, at string, actor_id string, kind string, payload string, prev_hash binary")
    assert row.select(audit.entry_hash()).first()[0].hex() == "4a87d4d47141fa543819b566627d327eb62ae91439c74224c3275bb9660866c7"


def test_pdf(spark):
    layer = "Northern Bank\n\nDate  Reference  Description  DR/CR  Amount\n19/04/2024  HX-81  Soap and rope  DR  14.25\nPage 1 of 1"

    def extract(content):
        if content == b"broken":
            raise ValueError("no PDF")
        return content.decode()

    ok, bad = st.gate(st.PARSERS["pdf"](files(spark, layer, "broken", "  \n"), extract=extract))
    assert rows(ok) == [("HX-81", "debit", 1425, dt.date(2024, 4, 19))]
    assert sorted((r.path, r.row, r.field) for r in bad.collect()) == [("f1", 0, "document"), ("f2", 0, "document")]
    with pytest.raises(ValueError, match="unknown profile"):
        st.parse_pdf(files(spark, layer), extract, profile="other")


def test_parsers_hand_on_few_records_at_a_time():
    # One batch of two files: no batch that comes out holds all of their records.
    n = 2 * st.RECORDS
    doc = "<D>" + "<Ntry><Amt>1</Amt></Ntry>" * n + "</D>"
    table = "\n".join(f"K{k},2024-05-02" for k in range(n))
    for read, content in ((st._entries, doc), (st._records(",", False, [0, 2]), table)):
        given = pa.RecordBatch.from_pydict({"path": ["a", "b"], "content": [content.encode(), content.encode()]})
        sizes = [b.num_rows for b in read(iter([given]))]
        assert sum(sizes) == 2 * n and max(sizes) <= st.RECORDS


def test_gate_parses_a_file_once(spark):
    parsed = spark.sparkContext.accumulator(0)

    def extract(content):
        parsed.add(1)
        return content.decode()

    layer = "Date  Reference  Description  DR/CR  Amount\n03/05/2024  HX-82  Soap  DR  14.25"
    ok, bad = st.gate(st.parse_pdf(files(spark, layer, " "), extract))
    assert (ok.count(), bad.count()) == (1, 1)
    # One call for the good and one for the bad branch of each file.
    assert parsed.value <= 4


def test_camt_nested_entries_parties_and_broken_ends(spark):
    party = "<RltdPties><Dbtr><Nm>{}</Nm></Dbtr><DbtrAcct><Id><Othr><Id>{}</Id></Othr></Id></DbtrAcct></RltdPties>"
    entry = "<Ntry><Amt Ccy=\"SEK\">{}</Amt><CdtDbtInd>CRDT</CdtDbtInd><ValDt><DtTm>2024-05-03T08:00:00</DtTm></ValDt><NtryRef>{}</NtryRef>{}</Ntry>"
    inner = entry.format("2.00", "K-2", "")
    doc = "<D>" + entry.format("1.00", "K-1", party.format("Ada", "X1") + party.format("Bob", "X2")) + "<S>" + entry.format("3.00", "K-3", inner) + "</S></D>"
    ok, bad = st.gate(st.parse_camt053(files(spark, doc, doc + "<")))
    got = [(r.row, r.external_ref, r.amount_minor, r.counterparty, r.counterparty_account) for r in ok.orderBy("row").collect()]
    # What an entry inside another says comes after the outer one's own and so stands for both.
    assert got == [(1, "K-1", 100, "Ada", "X1"), (2, "K-2", 200, None, None), (3, "K-2", 200, None, None)]
    assert [(r.path, r.row, r.field) for r in bad.collect()] == [("f1", 0, "xml")]
