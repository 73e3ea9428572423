"""Small closed dimensions: value types, detectors, labels.

Everything here is a fixed value that results must carry literally.  Each table
is exposed both as Python data (to build a plan) and as a DataFrame (to join).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Type id, ordinal, placeholder label.  The ordinal is a sort key.
PII_TYPES: list[tuple[str, int, str]] = [
    ("Phone", 0, "전화번호"),
    ("Email", 1, "이메일"),
    ("ResidentRegistrationNumber", 2, "주민등록번호"),
    ("CardNumber", 3, "카드번호"),
    ("BankAccountNumber", 4, "계좌번호"),
    ("Secret", 5, "비밀정보"),
    ("IpAddress", 6, "IP주소"),
    ("MacAddress", 7, "MAC주소"),
    ("GpsCoordinate", 8, "GPS좌표"),
    ("Name", 9, "이름"),
    ("Address", 10, "주소"),
    ("UsSsn", 11, "SSN"),
    ("UsItin", 12, "ITIN"),
    ("UsAtin", 13, "ATIN"),
    ("UsMbi", 14, "MBI"),
    ("UsPassport", 15, "여권번호"),
    ("UsANumber", 16, "A-NUMBER"),
    ("UsI94", 17, "I-94"),
    ("UsSevis", 18, "SEVIS"),
    ("UsDriverStateId", 19, "운전면허번호"),
    ("BankAccount", 20, "계좌"),
]
TYPE_ORD = {t: o for t, o, _ in PII_TYPES}

# Detector id, resolution rank, type it emits, country pack, legacy domain.
DETECTORS: list[tuple[str, int, str, str, bool]] = [
    ("global.secret", 10, "Secret", "GLOBAL", True),
    ("global.card", 20, "CardNumber", "GLOBAL", True),
    ("kr.rrn", 30, "ResidentRegistrationNumber", "KR", True),
    ("kr.bank_account", 40, "BankAccountNumber", "KR", True),
    ("us.atin", 50, "UsAtin", "US", False),
    ("us.itin", 60, "UsItin", "US", False),
    ("us.ssn", 70, "UsSsn", "US", False),
    ("us.mbi", 80, "UsMbi", "US", False),
    ("us.sevis", 90, "UsSevis", "US", False),
    ("us.passport", 100, "UsPassport", "US", False),
    ("us.a_number", 110, "UsANumber", "US", False),
    ("us.i94", 120, "UsI94", "US", False),
    ("us.driver_state_id", 130, "UsDriverStateId", "US", False),
    ("us.bank_account", 140, "BankAccount", "US", False),
    ("global.email", 200, "Email", "GLOBAL", True),
    ("global.ip", 210, "IpAddress", "GLOBAL", True),
    ("global.mac", 220, "MacAddress", "GLOBAL", True),
    ("global.gps", 230, "GpsCoordinate", "GLOBAL", True),
    ("global.path", 240, None, "GLOBAL", False),
    ("kr.phone", 300, "Phone", "KR", True),
    ("us.phone", 310, "Phone", "US", False),
    ("kr.address", 320, "Address", "KR", False),
    ("us.address", 330, "Address", "US", False),
    ("kr.name", 340, "Name", "KR", False),
    ("us.name", 350, "Name", "US", False),
    ("kr.company", 360, None, "KR", False),
]
RANK = {d: r for d, r, *_ in DETECTORS}
DETECTOR_TYPE = {d: t for d, _, t, *_ in DETECTORS}
LEGACY_DETECTORS = [d for d, _, _, _, legacy in DETECTORS if legacy]
US_DETECTORS = [d for d, _, t, c, _ in DETECTORS if c == "US"]

# Evidence codes, weakest to strongest; 7 means the detector does not model it.
EV_C, EV_S, EV_CJP, EV_SJP, EV_SC, EV_SCJP, EV_NONE = 1, 2, 3, 4, 5, 6, 7

DETECTOR_ID_PATTERN = r"^[a-z][a-z0-9]*(_[a-z0-9]+)*\.[a-z][a-z0-9]*(_[a-z0-9]+)*$"

# Labels recognised in key-value text, by role.
LABELS: dict[str, list[str]] = {
    "us.ssn": ["SSN", "Social Security Number"],
    "us.itin": ["ITIN"],
    "us.atin": ["ATIN", "Adoption Taxpayer Identification Number"],
    "us.mbi": ["MBI"],
    "us.sevis": ["SEVIS ID", "SEVIS Number", "SEVIS"],
    "us.passport": ["Passport", "Passport Number", "Passport No.", "Passport #", "U.S. Passport"],
    "us.a_number": ["A-Number", "A Number", "Alien Registration Number", "USCIS Number"],
    "us.i94": ["I-94", "I94", "I-94 Number", "I94 Number", "I-94 Admission Number", "Form I-94 Number"],
    "jurisdiction": ["State", "Issued by", "Jurisdiction"],
    "us.phone": ["Phone", "Phone Number", "Telephone", "Telephone Number", "Tel", "Mobile", "Mobile Number",
                 "Cell", "Cell Phone", "Cell Phone Number"],
    "us.address": ["Address", "Home Address", "Mailing Address", "Residential Address", "Street Address"],
    "us.name.specific": ["Full Name", "First Name", "Given Name", "Last Name", "Family Name", "Surname"],
    "us.name.generic": ["Name"],
    "us.driver_state_id": ["Driver License", "Driver's License", "Driver License Number",
                           "Driver's License Number", "DL Number", "DLN", "State ID", "State ID Number"],
    "us.driver_state_id.customer": ["Customer ID Number"],
    "document_type": ["Document Type"],
    "bank.routing": ["Routing Number", "ABA Routing Number", "ABA Number", "Routing Transit Number"],
    "bank.specific": ["Bank Account", "Bank Account Number", "Checking Account", "Checking Account Number",
                      "Savings Account", "Savings Account Number"],
    "bank.generic": ["Account Number"],
    "email": ["Email"],
}
ALL_LABELS = [label for group in LABELS.values() for label in group]
# Labels the tax-number family reads: its own, plus the fields that own a value of the same shape.
TAX_LABELS = [
    label
    for role in ("us.ssn", "us.itin", "us.atin", "us.i94", "us.address", "us.name.specific", "us.name.generic")
    for label in LABELS[role]
]

# Names and codes that place a line under a US jurisdiction.
JURISDICTION_NAMES = [
    "United States", "Alabama", "Alaska", "American Samoa", "Arizona", "Arkansas", "California", "Colorado",
    "Connecticut", "Delaware", "District of Columbia", "Florida", "Georgia", "Guam", "Hawaii", "Idaho",
    "Illinois", "Indiana", "Iowa", "Kansas", "Kentucky", "Louisiana", "Maine", "Maryland", "Massachusetts",
    "Michigan", "Minnesota", "Mississippi", "Missouri", "Montana", "Nebraska", "Nevada", "New Hampshire",
    "New Jersey", "New Mexico", "New York", "North Carolina", "North Dakota", "Northern Mariana Islands",
    "Ohio", "Oklahoma", "Oregon", "Pennsylvania", "Puerto Rico", "Rhode Island", "South Carolina",
    "South Dakota", "Tennessee", "Texas", "Utah", "Vermont", "Virgin Islands", "Virginia", "Washington",
    "West Virginia", "Wisconsin", "Wyoming",
]
JURISDICTION_CODES = (
    "AK AL AR AS AZ CA CO CT DC DE FL GA GU HI IA ID IL IN KS KY LA MA MD ME MI MN MO MP MS MT NC ND NE NH NJ "
    "NM NV NY OH OK OR PA PR RI SC SD TN TX UT VA VI VT WA WI WV WY"
).split()
# Postal codes also cover the three freely associated states.
STATE_CODES = sorted(JURISDICTION_CODES + ["FM", "MH", "PW"])

# Default street suffixes; a full list is passed in as a reference list.
STREET_SUFFIXES = (
    "ALLEY ALY AVE AVENUE BLVD BOULEVARD CIR CIRCLE COURT CT DR DRIVE HIGHWAY HWY LANE LN LOOP PARKWAY PIKE PKWY "
    "PL PLACE PLAZA PLZ RD ROAD SQ SQUARE ST STREET TER TERRACE TRAIL TRL TURNPIKE WAY"
).split()


def default_area_codes(spark: SparkSession) -> DataFrame:
    """Area codes by the numbering-plan rule (N[0-8]X, not N11), used when no list is supplied."""
    n = F.col("id")
    return (
        spark.range(200, 1000)
        .where((n % 100 != 11) & ((n / 10).cast("int") % 10 != 9))
        .select(n.cast("string").alias("record"))
    )


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def pii_types(spark: SparkSession) -> DataFrame:
    return _rows(spark, PII_TYPES, "pii_type string, type_ord int, label string")


def detectors(spark: SparkSession) -> DataFrame:
    return _rows(spark, DETECTORS, "detector_id string, rank int, pii_type string, country string, legacy boolean")


def label_dict(spark: SparkSession) -> DataFrame:
    """Every recognised label once, with its role (the label dictionary)."""
    rows = [(label, role) for role, labels in LABELS.items() for label in labels]
    return _rows(spark, rows, "label string, role string").dropDuplicates(["label"])


def lookup(pairs: dict, key: Column, value_type: str) -> Column:
    """Inline lookup of a closed dimension in a constant map: it needs no join, and the key is evaluated once."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair)), key).cast(value_type)


def alias_label(pii_type: Column) -> Column:
    return lookup({t: label for t, _, label in PII_TYPES}, pii_type, "string")


def alias_token(pii_type: Column, number: Column) -> Column:
    return F.concat(F.lit("["), alias_label(pii_type), number.cast("string"), F.lit("]"))


def type_ordinal(pii_type: Column) -> Column:
    return lookup(TYPE_ORD, pii_type, "int")


def is_legacy(detector_id: Column) -> Column:
    return detector_id.isin(LEGACY_DETECTORS)
