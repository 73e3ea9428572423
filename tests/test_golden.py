"""Known inputs with the findings they must give."""

from veilwork.operators.base_rules import explode_findings, scan_arrays
import pytest

from veilwork.operators.decide import Policy, finding_rows, redact_corpus, redact_rows, redact_tenants, scan_marked, tenant_masks
from veilwork.operators.us_rules import RefLists, scan_us_arrays
from veilwork.plans import flagship
from veilwork.plans.decision_queries import user_rule_set

# text -> detector|canonical|start:len|confidence, in detector order
BASE = [
    ("010 1234 5678", ["kr.phone|01012345678|0:13|3"]),
    ("01012345678", ["kr.phone|01012345678|0:11|3"]),
    ("02-1234-5678", ["kr.phone|0212345678|0:12|3"]),
    ("0502-1234-5678", ["kr.phone|050212345678|0:14|3"]),
    ("+82 10-1234-5678", ["kr.phone|01012345678|0:16|3"]),
    ("user..name@example.com", []),
    ("first.last@mail.example.co.kr.", ["global.email|first.last@mail.example.co.kr|0:29|3"]),
    ("user [at] example (dot) com", ["global.email|user@example.com|0:27|2"]),
    ("900101-1234568", ["kr.rrn|9001011234568|0:14|3"]),
    ("900101-1234569", ["kr.rrn|9001011234569|0:14|2"]),
    ("900230-1234569", []),
    ("주민번호 900101-1******", ["kr.rrn|9001011******|5:14|3"]),
    ("4111 1111 1111 1111", ["global.card|4111111111111111|0:19|3"]),
    ("4111 1111 1111 1112", []),
    ("카드번호 4111 1111 1111 1112", ["global.card|4111111111111112|5:19|2"]),
    ("입금계좌 110-123-456789", ["kr.bank_account|110123456789|5:14|3"]),
    ("계좌 010-1234-5678", ["kr.phone|01012345678|3:13|3"]),
    ("256.1.1.1", []),
    ("999.999.999.999", []),
    ("203.0.113.42:8080", ["global.ip|203.0.113.42|0:12|3"]),
    ("192.0.2.1.log", ["global.ip|192.0.2.1|0:9|3"]),
    ("192.0.2.1.5", []),
    ("2001:0DB8:0:0:0:0:0:1", ["global.ip|2001:db8::1|0:21|3"]),
    ("::ffff:203.0.113.42", ["global.ip|::ffff:203.0.113.42|0:19|3"]),
    ("1:0:0:2:0:0:0:3", ["global.ip|1:0:0:2::3|0:15|3"]),
    ("10:20:30", []),
    ("Aa:Bb:Cc:Dd:Ee:Ff", ["global.mac|aa:bb:cc:dd:ee:ff|0:17|3"]),
    ("AA:BB:CC:DD:EE:FF:11", []),
    ("lat=37.5665, lon=126.9780 근처입니다", ["global.gps|37.5665,126.978|4:21|3"]),
    ("lat=91.0, lon=10.0", []),
    ("37.5665,126.9780", ["global.gps|37.5665,126.978|0:16|2"]),
    ("api_key=Zx9Qw2Lm7Rt4", ["global.secret|Zx9Qw2Lm7Rt4|8:12|3"]),
    ("https://example.com/page?token=abc123xyz", []),
    ("https://example.com/?token=AbcDef123456789XYZ", ["global.secret|AbcDef123456789XYZ|27:18|3"]),
    ("token=AbcDef123456789.txt", ["global.secret|AbcDef123456789.txt|6:19|3"]),
    ("a \U0001F600 010-1234-5678", ["kr.phone|01012345678|4:13|3"]),
    ("x\u200b010\u200b-1234-５６７８", ["kr.phone|01012345678|2:14|3"]),
    ("mark \u0001 010-1234-5678 \u0002", ["kr.phone|01012345678|7:13|3"]),
]

# text -> detector|evidence|start:len|canonical, or nothing
US = [
    ('ATIN: 912934567', 'us.atin|5|6:9|912934567'),
    ('ITIN: 912 70 1234', 'us.itin|5|6:11|912701234'),
    ('912-93-4567', 'us.atin|2|0:11|912934567'),
    ('SSN: 321549876', 'us.ssn|5|5:9|321549876'),
    ('Social Security Number: 321 54 9876', 'us.ssn|5|24:11|321549876'),
    ('912934567', ''),
    ('ITIN: 912-66-1234', ''),
    ('X912-70-1234Y', ''),
    ('MBI: 1A23C45DE67', 'us.mbi|5|5:11|1A23C45DE67'),
    ('MBI: 1A23-C45-DE67', 'us.mbi|5|5:13|1A23C45DE67'),
    ('MBI: 1a23c45de67', 'us.mbi|5|5:11|1A23C45DE67'),
    ('X1A23C45DE67Y', ''),
    ('MBI: 1B23C45DE67', ''),
    ('N1234567890', 'us.sevis|2|0:11|N1234567890'),
    ('n1234567890', ''),
    ('SEVIS ID: N1234567890', 'us.sevis|5|10:11|N1234567890'),
    ('Passport Number: P12345678 State: NY', 'us.passport|6|17:9|P12345678'),
    ('Passport Number: P12345678', 'us.passport|5|17:9|P12345678'),
    ('State: NY P12345678', 'us.passport|4|10:9|P12345678'),
    ('Passport #: ZX81K2', 'us.passport|1|12:6|ZX81K2'),
    ('Passport No.: P12345678 State: NY', 'us.passport|6|14:9|P12345678'),
    ('U.S. Passport: P12345678', 'us.passport|6|15:9|P12345678'),
    ('Passport ID: P12345678', ''),
    ('Passport Number: Phone: ZX81K2', ''),
    ('district of columbia P12345678', 'us.passport|4|21:9|P12345678'),
    ('State=PR P12345678', 'us.passport|4|9:9|P12345678'),
    ('P12345678 State: VI', 'us.passport|4|0:9|P12345678'),
    ('Driver License Number: D123-4567 State: CA', 'us.driver_state_id|6|23:9|D1234567'),
    ("Driver's License: D1234567 State: CA", 'us.driver_state_id|6|18:8|D1234567'),
    ('DLN: D1234567 State: CA', 'us.driver_state_id|6|5:8|D1234567'),
    ('State ID: D1234567 State: CA', 'us.driver_state_id|6|10:8|D1234567'),
    ('Document Type: Driver License; Customer ID Number: D1234567; State: CA', 'us.driver_state_id|6|51:8|D1234567'),
    ('Driver License Number: D123-4567', ''),
    ('Customer ID Number: D1234567 State: CA', ''),
    ('Driver License: D123  4567 State: CA', ''),
    ('Driver License: ABCDEFGH State: CA', ''),
    ('Driver License: D1234567; United States', 'us.driver_state_id|6|16:8|D1234567'),
    ('California Driver License: D1234567', 'us.driver_state_id|6|27:8|D1234567'),
    ('Bank Account Number: AB12CD34', 'us.bank_account|1|21:8|AB12CD34'),
    ('Routing Number: 120000003 | Account Number: AB12CD34', 'us.bank_account|6|44:8|AB12CD34'),
    ('Routing Number: 120000003\nAccount Number: AB12CD34', 'us.bank_account|6|42:8|AB12CD34'),
    ('Account Number: AB12CD34\nRouting Number: 120000003', 'us.bank_account|6|16:8|AB12CD34'),
    ('Routing Number: 120000003                                                                                                       Account Number: AB12CD34', 'us.bank_account|6|144:8|AB12CD34'),
    ('Routing Number: 120000003                                                                                                        Account Number: AB12CD34', ''),
    ('Account Number: AB12CD34', ''),
    ('Routing Number: 120000004 | Account Number: AB12CD34', ''),
    ('Routing Number: 120000003 | Email: a@b.com | Account Number: AB12CD34', ''),
    ('Routing Number: 120000003\n\nAccount Number: AB12CD34', ''),
    ('Bank Account: AB12-CD34', ''),
    ('212-555-1212', 'us.phone|2|0:12|2125551212'),
    ('+12125551212', 'us.phone|2|0:12|2125551212'),
    ('(212) 555-1212', 'us.phone|2|0:14|2125551212'),
    ('+1 (212) 555-1212', 'us.phone|2|0:17|2125551212'),
    ('Phone: 2125551212', 'us.phone|5|7:10|2125551212'),
    ('Phone: 212-555-1212 x 42', 'us.phone|5|7:17|2125551212x42'),
    ('Phone: 212-555-1212 extension 42', 'us.phone|5|7:25|2125551212x42'),
    ('Phone: 212-555-1212 ext. 42', 'us.phone|5|7:12|2125551212'),
    ('2125551212', ''),
    ('112-555-1212', ''),
    ('Phone: call 212-555-1212', 'us.phone|2|12:12|2125551212'),
    ('Phone: 212-555-1212 x 42abc', 'us.phone|5|7:12|2125551212'),
    ('123 Main St, New York, NY 10001', 'us.address|4|0:31|123 Main St, New York, NY 10001'),
    ('Address: 12 Oak Grove Ave Apt 5.', 'us.address|5|9:22|12 Oak Grove Ave Apt 5'),
    ('Address: PO Box 12', 'us.address|5|9:9|PO Box 12'),
    ('123 Main St, New York, ZZ 10001', ''),
    ('Full Name: John A. Smith', 'us.name|1|11:13|John A. Smith'),
    ('Name: John', 'us.name|1|6:4|John'),
    ('Hi Mr. John Smith.', 'us.name|1|3:14|John Smith'),
    ('Hi Mr. John.', ''),
    ('A-Number: A 123456789', 'us.a_number|5|10:11|A123456789'),
    ('I-94: 1234567890a', 'us.i94|5|6:11|1234567890A'),
    ('HOTEL1234 SSN:    1', ''),
    ('A12345678Tel: 212-555-1212', 'us.phone|2|14:12|2125551212'),
]


def rows_of(df, column):
    return {r["doc_id"]: r[column] for r in df.select("doc_id", column).collect()}


def test_base_rules(docs):
    got = rows_of(scan_arrays(docs([t for t, _ in BASE])), "candidates")
    for i, (text, want) in enumerate(BASE):
        assert [f"{f.detector_id}|{f.canonical}|{f.start}:{f.len}|{f.conf}" for f in got[i]] == want, text
        assert all(text[f.start:f.start + f.len] == f.surface for f in got[i]), text


def test_us_rules(docs):
    got = rows_of(scan_us_arrays(docs([t for t, _ in US]), lists=RefLists.stand_in()), "us_findings")
    for i, (text, want) in enumerate(US):
        found = [f"{f.detector_id}|{f.evidence}|{f.start}:{f.len}|{f.canonical}" for f in got[i]]
        assert found == ([want] if want else []), text


def test_rejection_reasons(docs):
    cases = [
        ("ITIN: 912-66-1234", "us.itin", "ItinRangeGap66To69"), ("ATIN: 912-92-1234", "us.atin", "AtinRequires93"),
        ("ITIN: 912.70.1234", "us.itin", "UnsupportedSeparator"), ("X912-70-1234Y", "us.itin", "AlphanumericBoundaryViolation"),
        ("ITIN: 912-70-123４", "us.itin", "NonAsciiDigit"), ("ATIN: 912-93-123", "us.atin", "InvalidLength"),
        ("MBI: 1B23C45DE67", "us.mbi", "ExcludedB"), ("MBI: 0A23C45DE67", "us.mbi", "Position1RequiresOneToNine"),
        ("n1234567890", "us.sevis", "PrefixMustBeN"), ("SEVIS: N12345678901", "us.sevis", "WrongLength"),
    ]
    got = rows_of(scan_us_arrays(docs([c[0] for c in cases])), "us_attempts")
    for i, (text, detector, reason) in enumerate(cases):
        assert (detector, reason) in {(a.detector_id, a.reason) for a in got[i]}, text


def test_eight_kinds_in_one_sentence(docs):
    text = (
        "연락처: 010-1234-5678, 이메일: user@example.com, 주민번호: 900101-1234568, 카드번호: 4111-1111-1111-1111, "
        "api_key=SyntheticSecretValue123, IP: 203.0.113.42, MAC: 02:00:00:00:00:01, lat=37.5665, lon=126.9780"
    )
    rows = flagship.scan_findings(docs([text])).collect()
    assert len(rows) == 8 and len({r.pii_type for r in rows}) == 8


def test_redaction(docs):
    texts = ["문의 전화 010-1234-5678", "a@b.co, c@d.co and a@b.co", "api_key=Zx9Qw2Lm7Rt4 a@b.co", "none"]
    got = {r.doc_id: r for r in redact_corpus(docs(texts), Policy()).collect()}
    assert got[0].redacted == "문의 전화 [전화번호1]"
    assert got[1].redacted == "[이메일1], [이메일2] and [이메일1]"
    assert (got[2].redacted, got[2].status) == (texts[2], "needs_decision")
    assert (got[3].redacted, got[3].status) == ("none", "no_findings")


def test_redaction_with_the_us_pack(spark, docs):
    texts = ["SSN: 321-54-9876 and Phone: 212-555-1212", "Phone: 212-555-1212", "Phone: 416-555-1212", "none", None]
    lists = RefLists(area_codes=["212"], without=frozenset({"us.address"}))
    trust = Policy(trusted=spark.createDataFrame([("Phone", "none")], "pii_type string, value string"))
    for policy in (Policy(), trust):  # inside the row, and with a joined list
        got = {r.doc_id: r for r in redact_corpus(docs(texts), policy, us=lists).collect()}
        assert (got[0].redacted, got[0].status) == (texts[0], "needs_decision")
        assert (got[1].redacted, got[1].status) == ("Phone: [전화번호1]", "protected")
        assert [got[i].status for i in (2, 3, 4)] == ["no_findings"] * 3 and got[4].redacted is None


def test_address_needs_its_lists(docs):
    texts = ["at 12 Oak Grove Cv, Reno, NV 89501", "at 12 Oak Xing, Reno, NV 89501"]
    with pytest.raises(ValueError, match="us.address"):
        scan_us_arrays(docs(texts), ["us.address"])
    lists = RefLists(suffixes=["CV", "XING"], states=["NV"])
    got = rows_of(scan_us_arrays(docs(texts), ["us.address"], lists), "us_findings")
    assert [len(got[i]) for i in (0, 1)] == [1, 1]


def test_missing_lists_leave_texts_unscanned(spark, docs):
    texts = ["Phone: 212-555-1212", "a@b.co"]
    for policy in (Policy(), Policy(trusted=spark.createDataFrame([("Phone", "x")], "pii_type string, value string"))):
        got = {r.doc_id: (r.redacted, r.status) for r in redact_corpus(docs(texts), policy, us=RefLists(area_codes=["212"])).collect()}
        assert got == {0: (texts[0], "not_scanned"), 1: (texts[1], "not_scanned")}


@pytest.mark.parametrize("most", [20_000, 1])
def test_lists_as_tables(spark, docs, most):
    """Suffixes set beside the texts, and suffixes met in a join."""
    table = [("us.npa", "212 NY"), ("us.npa", "2125"), ("us.npa", "415"), ("usps.suffix", "CV"), ("usps.suffix", "XING"), ("usps.state", "NV"), ("x", "AVE")]
    lists = RefLists.from_table(spark.createDataFrame(table, "list_id string, record string"))
    lists.most_in_row = most
    texts = ["at 12 Oak Grove Cv, Reno, NV 89501", "Address: 5 Oak Xing Apt 5B", "at 12 Oak Ave, Reno, NV 89501", "at 12 Oak Cv, Reno, CA 89501",
             "Phone: 212-555-1212", "Phone: 416-555-1212", "x 415-555-1212", None, "at 12 Oak Grove Cv, Reno, NV 89501"]
    df = scan_us_arrays(docs(texts), ["us.phone", "us.address"], lists)
    got = rows_of(df, "us_findings")
    assert [[f.canonical for f in got[i]] if texts[i] else [] for i in range(len(texts))] == [
        ["12 Oak Grove Cv, Reno, NV 89501"], ["5 Oak Xing Apt 5B"], [], [], ["2125551212"], [], ["4155551212"], [], ["12 Oak Grove Cv, Reno, NV 89501"]]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "XING" not in plan and "212 NY" not in plan


def test_tenants_in_one_pass(spark, docs):
    us, kr = "SSN: 321-54-9876", "연락처 010-1234-5678 SSN: 321-54-9876"
    gates = spark.createDataFrame([("on", "OptedIn", True), ("off", "OptedIn", False), ("late", "OptedIn", True), ("shut", "Unavailable", False)],
                                  "tenant string, gate string, in_scope boolean")
    ready = spark.createDataFrame([("on", "us.phone", "Ready"), ("late", "us.phone", "ValidationFailed")], "scope string, detector_id string, state string")
    rows = [(i, t, x) for i, (t, x) in enumerate((t, x) for t in ("on", "off", "late", "shut", "new") for x in (us, kr))]
    df = spark.createDataFrame(rows, "doc_id long, tenant string, text string")
    got = {(r.tenant, r.doc_id % 2): (r.redacted, r.status) for r in redact_tenants(df, tenant_masks(gates, ready), us=RefLists.stand_in()).collect()}
    hidden = "연락처 [전화번호1] SSN: 321-54-9876"
    assert got == {("on", 0): (us, "needs_decision"), ("on", 1): (kr, "needs_decision"), ("off", 0): (us, "no_findings"), ("off", 1): (hidden, "protected"),
                   ("late", 0): (us, "not_scanned"), ("late", 1): (kr, "not_scanned"), ("shut", 0): (us, "not_scanned"), ("shut", 1): (kr, "not_scanned"),
                   ("new", 0): (us, "no_findings"), ("new", 1): (hidden, "protected")}


def test_unsafe_edits_leave_the_text(spark, docs):
    found = "doc_id long, start int, len int, disposition string, alias string"
    texts = ["abc 010-1 def", "abc 010-1 def", "abc 010-1 def", "abc 010-1 def"]
    rows = spark.createDataFrame(
        [(0, 4, 5, "Protect", None), (1, 4, 5, "Protect", "[A1]"), (1, 6, 5, "Protect", "[A2]"), (2, 9, 50, "Protect", "[A1]"),
         (3, 4, 5, "Protect", "[A1]")], found)
    got = {r.doc_id: r for r in redact_rows(docs(texts), rows, ["doc_id"]).collect()}
    assert [(got[i].redacted, got[i].status) for i in (0, 1, 2)] == [(texts[0], "error")] * 3
    assert (got[3].redacted, got[3].status) == ("abc [A1] def", "protected")


def test_ambiguous_document_is_kept_back(docs):
    df = scan_marked(docs(["a@b.co", "x"])).selectExpr("doc_id", "text", "findings", "doc_id = 1 as ambiguous", "not_scanned")
    rows = finding_rows(df, "doc_id").selectExpr("*", "'Protect' as disposition", "'[A1]' as alias")
    got = {r.doc_id: r for r in redact_rows(docs(["a@b.co", "x"]), rows.where("start is not null or ambiguous"), ["doc_id"]).collect()}
    assert (got[0].redacted, got[1].redacted, got[1].n_candidates, got[1].status) == ("[A1]", "x", 0, "ambiguous")


def test_us_pack_tie_is_held_back(docs):
    rows = {r.doc_id: r for r in flagship.scan_resolved_us(docs(["SSN: 321-54-9876", "plain"]), RefLists.stand_in()).collect()}
    assert [f.detector_id for f in rows[0].findings] == ["us.ssn"] and not rows[0].ambiguous
    assert rows[1].findings == []


def test_explode_keeps_every_finding(docs):
    df = scan_arrays(docs([t for t, _ in BASE]))
    assert explode_findings(df, "candidates", "doc_id").count() == sum(len(w) for _, w in BASE)


def test_rules_of_the_user(spark, docs):
    rules = user_rule_set()
    texts = ["TKT-000123 and 010-1234-5678, TKT-000124 TKT-000123 TKT-000100", "Note-4 note-4 host-x", "host-x a@b.co", None, ""]
    want = ["[티켓1] and [전화번호1], [티켓2] [티켓1] TKT-000100", "[메모1] [메모1] [메모2]", "host-x [이메일1]", None, ""]
    trust = Policy(trusted=spark.createDataFrame([("Ticket", "TKT-000124")], "pii_type string, value string"), renderer=rules.render)
    assert [r.redacted for r in sorted(redact_corpus(docs(texts), Policy(renderer=rules.render), rules).collect())] == want
    want[0] = "[티켓1] and [전화번호1], TKT-000124 [티켓1] TKT-000100"
    assert [r.redacted for r in sorted(redact_corpus(docs(texts), trust, rules).collect())] == want
    for wrong in (lambda: rules.type("Phone", "x"), lambda: rules.pattern("kr.phone", "Ticket", "x"), lambda: rules.pattern("my.x", "Nothing", "x"),
                  lambda: rules.pattern("No Id", "Ticket", "x")):
        with pytest.raises(ValueError):
            wrong()
