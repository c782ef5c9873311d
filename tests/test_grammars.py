"""The agencies' layouts, each by a document written out by hand with the rows that it states."""

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import grammars

CASES = [
    (
        "care", "Banyan Sugars Limited",
        """Press Release
Banyan Sugars Limited
Facilities/Instruments Amount (₹ crore) Rating1 Rating Action
Long-term bank facilities 312.40 (Reduced from 400.10) CARE A-; Stable Downgraded from CARE A+ and removed from Rating Watch with
Negative Implications; Stable outlook assigned
Short-term bank facilities 9.00 CARE A2+ Downgraded from CARE A1+ and removed from Rating Watch
Long-term / Short-term bank facilities - 25,00.50 CARE BB+; Stable / CARE A4+ Reaffirmed
Fixed deposit - - Withdrawn
Details of instruments/facilities in Annexure-1.""",
        [
            ("Long-term bank facilities", 312.4, "CARE A-; Stable", "CARE A+", "Downgraded from CARE A+ and removed from Rating Watch with Negative Implications; Stable outlook assigned"),
            ("Short-term bank facilities", 9.0, "CARE A2+", "CARE A1+", "Downgraded from CARE A1+ and removed from Rating Watch"),
            ("Long-term / Short-term bank facilities - 25", None, None, None, None),
            ("Fixed deposit", None, "Withdrawn", None, "Withdrawn"),
        ],
    ),
    (
        "care", "Cedar Oils Limited",
        "Press Release\nCredit update-Cedar Oils Limited\nAs announced, Other Mills Limited (OML; rated CARE B; Stable) and Cedar Oils Limited (COL; rated CARE AA-; Stable / CARE A1+) changed their holdings.",
        [("Credit update", None, "CARE AA-; Stable / CARE A1+", None, "Credit update")],
    ),
    (
        "icra", "Dune Foods Limited",
        """Dune Foods Limited: Ratings reaffirmed
Summary of rating action
Instrument* Previous Rated Amount Current Rated Amount
(in crore)
Long-term - Fund based - Term loans 8.00 4.15 [ICRA]A+ (Stable); reaffirmed
Long-term - Fund based -
Cash credit 74.50 95.00 [ICRA]A+ (Stable); reaffirmed and assigned for enhanced amount
Short-term - Non-fund based limits (sublimit of cash credit) 13.76 15.33 [ICRA]A1+; reaffirmed
Total 96.26 114.48
Rationale""",
        [
            ("Long-term - Fund based - Term loans", 4.15, "[ICRA]A+ (Stable); reaffirmed", None, "reaffirmed"),
            ("Long-term - Fund based - Cash credit", 95.0, "[ICRA]A+ (Stable); reaffirmed and assigned for enhanced amount", None, "reaffirmed and assigned for enhanced amount"),
            ("Short-term - Non-fund based limits", 15.33, "[ICRA]A1+; reaffirmed", None, "reaffirmed"),
        ],
    ),
    (
        "icra", "Dune Foods Limited", "Rating action\nInstrument^ Rated Amount\nUnallocated limits\nLT/Short Term\n3.5\n[ICRA]BBB- (Negative)/[ICRA]A3; assigned\nKey rating drivers and their description",
        [("LT/Short Term", 3.5, "[ICRA]BBB- (Negative)/[ICRA]A3; assigned", None, "assigned")],
    ),
    (
        "india_ratings", "Elm Energy Limited",
        """Mar 10, 2025 | Elm Energy Limited|Sugar
Details of Instruments
Instrument Type
Date of Issuance
Size of Issue (million)
Rating Action
Term loan
-
-
31 March 2029
INR5,490.6 (reduced from INR5,531.1)
IND A+/Stable
Affirmed
Fund-based working
capital limit*
-
INR11,250
IND A+/Stable/IND A1
Affirmed
Long-term issuer rating
-
IND AA-/Stable
Affirmed
Bank loan facilities - - - INR1,050 IND BBB+/Stable/IND A2 Affirmed
Non-Fund Based Working Capital Limit INR 27.6 IND A4(ISSUER NOT COOPERATING) Maintained in non-cooperating category
Analytical Approach
Term loan
IND B
Affirmed""",
        [
            ("Term loan", 549.06, "IND A+/Stable", None, "Affirmed"), ("Fund-based working capital limit*", 1125.0, "IND A+/Stable/IND A1", None, "Affirmed"), ("Long-term issuer rating", None, "IND AA-/Stable", None, "Affirmed"),
            ("Bank loan facilities - - -", 105.0, "IND BBB+/Stable/IND A2", None, "Affirmed"), ("Non-Fund Based Working Capital Limit", 2.76, "IND A4(ISSUER NOT COOPERATING)", None, "Maintained in non-cooperating category"),
        ],
    ),
    (
        "india_ratings", "Fir Seeds Limited", "The agency (Ind-Ra) has discontinued voluntary disclosure of issuer ratings.\nSo the outstanding voluntary issuer rating disclosure of Fir Seeds Limited at IND BBB- stands withdrawn.",
        [("Issuer rating disclosure", None, "IND BBB-; Withdrawn", None, "Withdrawn")],
    ),
    (
        "acuite", "Grove Steel Limited",
        """Product Quantum (Rs. Cr) Long Term Rating Short Term Rating
Bank Loan Ratings 25.50 ACUITE BBB+ | Stable
| Reaffirmed -
Bank Loan Ratings 4 - ACUITE A2 | Assigned
Bank Loan Ratings 1.5 Not Applicable | Withdrawn
Total Outstanding Quantum (Rs. Cr) 31.00
Bank Loan Ratings 9 ACUITE D""",
        [
            ("Bank Loan Ratings", 25.5, "ACUITE BBB+ | STABLE", None, "Reaffirmed"), ("Bank Loan Ratings", 4.0, "ACUITE A2", None, "Assigned"), ("Bank Loan Ratings", 1.5, "Withdrawn", None, "Withdrawn"),
        ],
    ),
    (
        "brickwork", "Hazel Oils Limited",
        """27 August 2021
Facility
Rating*
Previous
Present
Fund based
CC
Term Loans
800.00
54.96
Long
Term
BWR BBB+ /Stable
BWR A-/Stable
(Upgrade)
Short term Loan
95.25
Short
Term
BWR A3+
Rating Withdrawn**
Non Fund Based
BG/LC
Total
RATING ACTION / OUTLOOK""",
        [("Long Term", None, "BWR A-/Stable", "BWR BBB+/Stable", "Upgrade"), ("Short Term", None, "Withdrawn", None, "Withdrawn")],
    ),
    (
        "brickwork", "Ivy Mills Limited", "Ratings reaffirmed at BWR BB-/stable/A4 on best available information.",
        [("Long Term", None, "BWR BB-/Stable; ISSUER NOT COOPERATING", None, "Reaffirmed"), ("Short Term", None, "BWR A4; ISSUER NOT COOPERATING", None, "Reaffirmed")],
    ),
    (
        "infomerics", "Juniper Yarns Limited",
        """Ratings
Instrument / Facility
Amount
(Rs. Crore)
Current Ratings
Previous Ratings
Rating Action
Complexity Indicator
Long Term Bank
Facilities - Term Loan
42.50
IVR BBB-/
Stable
IVR BB+; Stable
Rating Upgraded
Simple
Short Term Bank Facilities 7.00 IVR A3 (IVR A three) IVR A4 + Upgraded
Unallocated 2.00
IVR A3 Assigned
Total 51.50
Detailed Rationale""",
        [
            ("Long Term Bank Facilities - Term Loan", 42.5, "IVR BBB-/Stable", "IVR BB+; Stable", "Upgraded Simple"), ("Short Term Bank Facilities", 7.0, "IVR A3", "IVR A4", "+ Upgraded"), ("Unallocated", 2.0, "IVR A3", None, "Assigned"),
        ],
    ),
    (
        "infomerics", "Kapok Limited", "Press Release\nLong Term\n12.0\nIVR BB; Negative\nReaffirmed\nSimple\nother words\nShort Term\n3.25\nIVR A4\nAssigned",
        [("Long Term", 12.0, "IVR BB; Negative", None, "Reaffirmed Simple"), ("Short Term", 3.25, "IVR A4", None, "Assigned")],
    ),
    (
        "crisil", "Larch Biotech Limited", "Rating Action Total Bank Loan Facilities Rated Rs.42 Crore Long Term Rating Crisil BBB-/Stable (Reaffirmed) Short Term Rating Crisil A3 (Reaffirmed)\n\nDetailed Rationale Crisil Ratings has reaffirmed",
        [("Bank Loan Facilities - Long Term", 42.0, "Crisil BBB-/Stable", None, "Reaffirmed"), ("Bank Loan Facilities - Short Term", 42.0, "Crisil A3", None, "Reaffirmed")],
    ),
    (
        "crisil", "Maple Foods Limited", "Rating Action\nTotal Bank Loan Facilities Rated\nRs.9 Crore\nLong Term Rating\n&\nCRISIL BB+/Stable (Migrated from 'CRISIL BB+/Stable ISSUER NOT COOPERATING*'; Rating Withdrawn)\nDetailed Rationale",
        [("Bank Loan Facilities - Long Term", 9.0, "CRISIL BB+/Stable; Withdrawn", None, "Migrated from 'CRISIL BB+/Stable ISSUER NOT COOPERATING*'; Rating Withdrawn")],
    ),
    (
        "crisil", "Neem Starch Limited", "Rating Action\nTotal Bank Loan Facilities Rated\nRs.380 Crore\nLong Term Rating\nCRISIL A+/Stable\nShort Term Rating\nCRISIL A1\nRs.80 Crore Fixed Deposits\nCRISIL A+/Stable\nDetailed Rationale",
        [("Bank Loan Facilities - Long Term", 380.0, "CRISIL A+/Stable", None, None), ("Bank Loan Facilities - Short Term", 380.0, "CRISIL A1", None, None), ("Fixed Deposits", 80.0, "CRISIL A+/Stable", None, None)],
    ),
    (
        "crisil", "Oak Polyols Limited",
        """Annexure - Details of Bank Lenders & Facilities
Facility
Amount (Rs.Crore)
Name of Lender
Rating
Cash Credit
130
First Bank
Crisil A/Stable
Cash Credit
100.25
The Second and Third Banking Corporation
Limited
Crisil A/Stable
Non-Fund Based
Limit
40
First Bank
Crisil A1
Criteria Details""",
        [("Cash Credit", 230.25, "Crisil A/Stable", None, None), ("Non-Fund Based Limit", 40.0, "Crisil A1", None, None)],
    ),
    ("crisil", "Pine Limited", "The ratings were reaffirmed at 'CRISIL BBB/Stable/CRISIL A3+' today.", [("Bank Loan Facilities", None, "CRISIL BBB/Stable/CRISIL A3+", None, "The ratings were reaffirmed at '")]),
    (
        "crisil", "Quince Mills", "CRISIL downgrades ratings on Quince Mills to D/P5\nRs.100.0 Million Cash Credit Limit\nD (Downgraded from B+/Stable and Suspended)\nRs.145.0 Million Letter of Credit\nP5 (Downgraded from P4 and Suspended)\nRs.1.0 Million Term Loan\nnothing",
        [("Cash Credit Limit", 10.0, "D", "B+/Stable and Suspended", "Downgraded from B+/Stable and Suspended"), ("Letter of Credit", 14.5, "P5", "P4 and Suspended", "Downgraded from P4 and Suspended")],
    ),
    ("icra", "X", None, []), ("icra", "X", "", []), ("unknown", "X", "Bank Loan Ratings", []), (None, None, None, []), ("crisil", None, "no rating here", []), ("care", None, "Facilities Amount\nDetails of facilities", []),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, a, c, t) for i, (a, c, t, _) in enumerate(CASES)]
    docs = spark.createDataFrame(rows, "id int, agency string, company string, text string").repartition(4)
    out = {}
    for r in grammars.event_rows(docs, "id", "text", "agency", "company").orderBy("id", "place").collect():
        out.setdefault(r["id"], []).append(tuple(r)[2:])
    return out


@pytest.mark.parametrize("number", range(len(CASES)), ids=lambda i: f"{CASES[i][0]}-{i}")
def test_layout(found, number):
    got, want = found.get(number, []), CASES[number][3]
    assert [g[0] for g in got] == [w[0] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g == w or w[1:] == (None, None, None, None)


def test_fold_keeps_order_and_leaves_out_what_no_row_holds(spark):
    lines = F.array(*map(F.lit, ["x", "a1", "b", "a2", "end", "y", "a3"]))
    start, stop = lambda x: x.startswith("a"), lambda x: x == "end"
    row = spark.range(1).select(grammars.fold(lines, lambda _, x: start(x), stop, start).alias("kept"), grammars.fold(lines, None, stop, None, lambda own: F.lit(False)).alias("closed")).first()
    assert row["kept"] == [["a1", "b"], ["a2", "end"], ["a3"]] and row["closed"] == [["x", "a1", "b", "a2", "end"]]


def test_no_shuffle_and_no_python(spark):
    docs = spark.createDataFrame([(1, "icra", "c", "t")], "id int, agency string, company string, text string")
    plan = grammars.event_rows(docs, "id", "text", "agency", "company")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
