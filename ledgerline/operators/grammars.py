"""Rated instruments out of rating documents, by the layouts of seven agencies, inside the row.

Each agency's table is cut out of the text and its lines are folded into rows by one state
(`fold`): lines gather in an open row until a test of the line, or of the open row and the
line, closes it. What a row means is read by expressions of its agency. Documents are narrow
rows and a table has some dozen lines, so nothing is exploded or shuffled, and every pattern
is a literal that is compiled once.

Defined results: a null or empty text, an unknown agency and a document without any row give an
empty list; a row without what its agency demands (a rating, an amount) is left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.documents import LONG, compact, let, normal_text

EVENT = "struct<instrument: string, amount_crore: double, current_rating: string, previous_rating: string, action: string>"

# Symbols, and the patterns and words of each agency's layouts.
SYMBOLS = "AAA|AA\\+|AA-|AA|A1\\+|A1|A2\\+|A2|A3\\+|A3|A4\\+|A4|A\\+|A-|BBB\\+|BBB-|BBB|BB\\+|BB-|BB|B\\+|B-|C\\+|A|B|C|D"
SHORT_A = "A1\\+|A1|A2\\+|A2|A3\\+|A3|A4\\+|A4"
CRISIL_TOTAL = "Total Bank Loan Facilities Rated\\s+Rs\\.?\\s*(\\d+(?:\\.\\d+)?)\\s*Crore"
CRISIL_RATING = f"CRISIL\\s+(?:{SYMBOLS})(?:/\\s*(?:Stable|Positive|Negative))?(?:/\\s*CRISIL\\s+(?:{SHORT_A}))?"
CRISIL_LONG = f"CRISIL\\s+(?:{LONG})(?:/\\s*(?:Stable|Positive|Negative))?"
CRISIL_SHORT = f"CRISIL\\s+(?:{SHORT_A})"
CRISIL_AFTER_LONG = "Short Term Rating|1 crore =|Refer to annexure|Refer to Annexure|Detailed Rationale|Rs\\.|Any other information"
CRISIL_AFTER_SHORT = "1 crore =|Refer to annexure|Refer to Annexure|Detailed Rationale|Rs\\.|Any other information"
CRISIL_AFTER_DEPOSIT = "Note:|1 crore =|Refer to annexure|Refer to Annexure|Detailed Rationale"
CRISIL_ANNEXURE = "Annexure\\s*-\\s*Details of Bank Lenders\\s*&\\s*Facilities"
CRISIL_ANNEXURE_END = "Criteria Details|Links to related criteria|Media Relations|Analytical Contacts|Customer Service Helpdesk|Note for Media:"
CRISIL_ANNEXURE_HEADS = ("Facility", "Amount (Rs.Crore)", "Amount", "Name of Lender", "Rating")
CRISIL_QUOTE = "(?:reaffirmed|assigned|migrating|upgraded|downgraded|withdrawn)[^'.]{0,120}'(CRISIL[^']+)'"
CRISIL_MILLION = "^Rs\\.?\\s*(\\d+(?:\\.\\d+)?)\\s+Million\\s+(.+)$"
P_SYMBOLS = LONG + "|P1\\+|P1|P2\\+|P2|P3\\+|P3|P4\\+|P4|P5"
CRISIL_OLD_RATING = f"^((?:CRISIL\\s+)?(?:{P_SYMBOLS})(?:/\\s*(?:{P_SYMBOLS}))?)\\s*(\\(.+\\))?$"
CRISIL_OLD_BEFORE = "Downgraded from ['\"]?([^'\")]+)"
CRISIL_LIMIT = 15_000
CARE_START = "(?:Facilities(?:/Instruments)?|Instruments?|Ratings)\\s+Amount"
CARE_END = "Details of instruments/facilities|Details of instruments|Details of facilities|Rationale and key rating drivers|Detailed description of the key rating drivers|Rationale"
CARE_HEADS = "^(?:Amount|Rating1|Ratings1|Rating Action)"
CARE_ROW = (
    "^((?:Long(?:\\s*-\\s*|\\s+)term(?:\\s*/\\s*Short(?:\\s*-\\s*|\\s+)term)?|Short(?:\\s*-\\s*|\\s+)term(?:\\s*/\\s*Long(?:\\s*-\\s*|\\s+)term)?|Fixed deposits?|Commercial paper|Non[- ]convertible debentures?"
    "|Optionally(?:\\s+Fully)?\\s+Convertible\\s+Debentures?|Debentures?|Issuer rating)(?:\\s+bank)?(?:\\s+facilities?|\\s+facility|\\s+limits?)?(?:\\s*-\\s*[A-Za-z0-9()/]+(?:\\s+[A-Za-z0-9()/]+)*)*)\\b"
)
CARE_AMOUNT = "^((?:\\d[\\d.,]*|-)(?:\\s*\\([^)]*\\))?)\\s+(.+)$"
CARE_ACTION = "\\b(?:Upgraded|Reaffirmed|Downgraded|Assigned|Withdrawn|Revised|Removed|Continues to remain)\\b"
CARE_BEFORE = "\\bfrom\\s+(CARE\\s+[A-Z0-9+;/ .()*:-]+?)(?=(?:\\s+and\\b|\\s*;|$))"
CARE_QUOTED = "(?:[^)]*?\\brated\\s+)(CARE\\s+[A-Z0-9+;/ .()'-]+)\\)"
CARE_INLINE = f"([A-Z][A-Za-z0-9&.,'() -]+?)\\s*\\({CARE_QUOTED}"
ICRA_START = "Summary of rating action|Rating Action"
ICRA_HEAD = "Instrument\\*|Instrument\\^|Instrument\\s+Current rated amount|Instrument\\s+Rated Amount"
ICRA_END = "\\*?\\s*Instrument details|Rationale|Key rating drivers and their description"
ICRA_HEADS = ("Instrument", "Previous Rated Amount", "Current Rated Amount", "Rated Amount", "Rating Action", "Amount rated", "Current rating", "Chronology of rating history", "Type Amount rated", "(in crore)")
ICRA_ROW = "^(?:Long[- ]term|Short[- ]term|Long[- ]term/ ?Short[- ]term|LT/Short Term|LT/|Fund[- ]based|Non[- ]fund[- ]based|Unallocated|Fixed Deposit Programme|Term Loan|Commercial paper|Working capital|Fund-based|Non-fund-based)\\b"
INDIA_STARTS = ("Details of Instruments", "Instrument Type", "Instrument")
INDIA_PHRASES = ("instrument-wise rating actions are as follows", "has taken the following rating actions on")
INDIA_ENDS = ("Analytical Approach", "Detailed Rationale of the Rating Action", "Contact", "About the Company", "Key Rating Drivers")
INDIA_HEADS = (
    "instrument type", "instrument description", "date of issuance", "coupon rate", "coupon rate (%)", "maturity date", "size of issue (million)", "rating assigned along with outlook/watch", "rating/outlook", "rating action", "instrument",
    "type", "size of issue", "rating", "action", "current ratings/", "outlook", "current", "rated", "limits", "limits (million)", "rating type", "historical rating/outlook",
)
INDIA_ACTION = "\\b(?:Affirmed|Assigned|Upgraded|Downgraded|Withdrawn|Maintained(?:\\s+in\\s+[^.;]+)?|Reaffirmed|Removed[^.;]*)\\b"
INDIA_LINE = "^(.+?)\\s+(INR\\s*[\\d,]+(?:\\.\\d+)?)\\s+(.+)$"
INDIA_ISSUER = "outstanding voluntary issuer rating disclosure of (.+?) at (IND\\s+[A-Z0-9+\\-./ ]+) stands withdrawn"
INDIA_DISCONTINUED = "discontinued voluntary disclosure of issuer ratings"
ACUITE_ENDS = ("Total Outstanding Quantum", "Rating Rationale", "Unsupported Rating")
ACUITE_ROW = "Bank Loan Ratings"
ACUITE_SHORT = "(?<![A-Z0-9])(ACUITE\\s+(?:A1\\+|A1|A2\\+|A2|A3\\+|A3|A4\\+|A4|D))(?![A-Z0-9])"
ACUITE_LONG = f"(?<![A-Z0-9])(ACUITE\\s+(?:{LONG})(?:\\s*\\|\\s*(?:STABLE|POSITIVE|NEGATIVE|DEVELOPING))?)(?![A-Z0-9])"
BRICKWORK_TOKEN = "BWR\\s+[A-Z0-9+\\-]+(?:\\s*/\\s*(?:Stable|Negative|Positive))?(?:\\s*\\((?:Stable|Negative|Positive|Withdrawal|ISSUER NOT COOPERATING[^)]*)\\))?"
BRICKWORK_LONG_END = "Short term|Short Term|Non Fund Based|Fund Based|Total|Grand Total|RATING ACTION|Rating Action|www\\.brickworkratings|Page \\d|$"
BRICKWORK_SHORT_END = "Non Fund Based|Fund Based|Total|Grand Total|RATING ACTION|Rating Action|www\\.brickworkratings|Page \\d|$"
BRICKWORK_ACTION = "\\b(Upgrade|Upgraded|Downgrade|Downgraded|Reaffirmed|Withdrawal|Withdrawn|Assigned)\\b"
BRICKWORK_PAIR = "\\bat\\s+BWR\\s+([A-Z0-9+\\-]+)\\s*/\\s*(?:(Stable|Negative|Positive)\\s*/)?(A[1-4]\\+?|D)\\b"
NOT_COOPERATING = "issuer not cooperating|best available information"
INFOMERICS_END = "^(?:Detailed Rationale|Rationale|Key Rating Sensitivities|List of Key Rating Drivers|About the Company|Analytical Approach)\\b"
INFOMERICS_ROW = "^(?:Long[- ]?Term|Short[- ]?Term|Long[- ]?Term\\s*/\\s*Short[- ]?Term|Instrument|Security|Fund[- ]based|Non[- ]fund[- ]based|Bank Loan Ratings|Unallocated)"
INFOMERICS_RATING = (
    f"(?:IVR\\s+(?:{SYMBOLS})(?:\\s*[;/]\\s*(?:RWDI|Stable|Positive|Negative))?(?:\\s*/\\s*IVR\\s+(?:{SHORT_A}))?(?:\\s*;\\s*Withdrawn)?|Not Applicable\\s*\\|\\s*Withdrawn)"
)
INFOMERICS_HEADS = (
    "instrument / facility", "instrument/facility amount", "instrument facility", "security/ facility amount", "facility amount", "facility", "amount", "amount (rs. crore)", "current ratings", "previous ratings", "ratings", "rating", "rating action",
    "complexity", "complexity indicator", "indicator", "(rs. crore)", "security/ facility", "action",
)
INFOMERICS_HEAD = "current ratings|^current$|^previous$|previous ratings|rating action|complexity indicator|^instrument ?/|^\\(rs\\. crore\\)"
ACTIONS = "\\b(reaffirmed|upgraded|downgraded|withdrawn|assigned|revised|removed from issuer not cooperating category|continues to remain)\\b"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, "^\\s+|\\s+$", "")


def tidy(c: Column) -> Column:
    """Repeated blanks are one, and no white space stands at the ends."""
    return stripped(compact(c))


def some(c: Column) -> Column:
    """The stripped text, or null if it's empty; computed once, which nullif wouldn't."""
    return F.get(F.filter(F.array(stripped(c)), lambda x: x != ""), 0)


def first(text: Column, pattern: str, group: int = 0) -> Column:
    """A group of the first match, whatever its case; null without one."""
    return some(F.regexp_extract(text, f"(?is){pattern}", group))


def every(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?is){pattern}"), F.lit(group))


def after(text: Column, pattern: str) -> Column:
    """What follows the first match; null without one."""
    return let(text, lambda t: F.when(t.rlike(f"(?is){pattern}"), F.regexp_extract(t, f"(?is)^.*?(?:{pattern})(.*)$", 1)))


def before(text: Column, pattern: str) -> Column:
    """What stands before the first match; all without one."""
    return let(text, lambda t: F.when(t.rlike(f"(?is){pattern}"), F.regexp_extract(t, f"(?is)^(.*?)(?:{pattern})", 1)).otherwise(t))


def has(text: Column, pattern: str) -> Column:
    return text.rlike(f"(?i){pattern}")


def lines_of(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), tidy), lambda x: x != "")


def _place(lines: Column, test: Callable[[Column], Column]) -> Column:
    return F.array_position(F.transform(lines, test), F.lit(True))


def until(lines: Column, stop: Callable[[Column], Column]) -> Column:
    """Lines before the first that stops."""
    return let(lines, lambda ls: let(_place(ls, stop), lambda at: F.when(at > 0, F.slice(ls, 1, (at - 1).cast("int"))).otherwise(ls)))


def since(lines: Column, start: Callable[[Column], Column]) -> Column:
    """Lines behind the first that starts; none without one."""
    return let(lines, lambda ls: let(_place(ls, start), lambda at: F.when(at > 0, F.slice(ls, (at + 1).cast("int"), F.size(ls))).otherwise(F.array().cast("array<string>"))))


def fold(lines: Column, starts: Callable | None = None, ends: Callable | None = None, opens: Callable | None = None, keep_last: Callable | None = None) -> Column:
    """Rows (arrays of lines) of a table's lines.

    starts(open, line): the line closes a row that is open and starts the next one; ends(line): the
    line closes the row it joins; opens(line): lines that may start a row where none is open (any, if
    not given); keep_last(open): whether the row that is open at the end counts (yes, if not given).
    """
    none = F.array().cast("array<string>")
    state = lambda open_, done: F.struct(open_.alias("open"), done.alias("done"))

    def step(s: Column, line: Column) -> Column:
        joined = F.concat(s["open"], F.array(line))
        out = state(joined, s["done"])
        if ends:
            out = F.when(ends(line), state(none, F.concat(s["done"], F.array(joined)))).otherwise(out)
        if opens:
            out = F.when((F.size(s["open"]) == 0) & ~opens(line), s).otherwise(out)
        if starts:
            out = F.when((F.size(s["open"]) > 0) & starts(s["open"], line), state(F.array(line), F.concat(s["done"], F.array(s["open"])))).otherwise(out)
        return out

    def finish(s: Column) -> Column:
        good = F.size(s["open"]) > 0
        return F.when(good & keep_last(s["open"]) if keep_last else good, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"])

    return F.aggregate(lines, state(none, F.array().cast("array<array<string>>")), step, finish)


def crore(text: Column, million: bool = False) -> Column:
    value = F.regexp_replace(F.regexp_extract(text, "[-+]?\\d[\\d,]*(?:\\.\\d+)?", 0), ",", "").try_cast("double")
    return F.round(value / 10, 4) if million else value


def action_of(text: Column) -> Column:
    """The first of the known actions, each word with a capital."""
    return F.initcap(first(text, ACTIONS, 1))


def event(instrument: Column, amount: Column, current: Column, previous: Column | None = None, action: Column | None = None) -> Column:
    absent = F.lit(None).cast("string")
    return F.struct(instrument.alias("instrument"), amount.cast("double").alias("amount_crore"), current.alias("current_rating"), (absent if previous is None else previous).alias("previous_rating"), (absent if action is None else action).alias("action")).cast(EVENT)


def events(rows: Column, read: Callable[[Column], Column]) -> Column:
    return F.array_compact(F.transform(rows, read))


def either(*options: Column) -> Column:
    """The first list that isn't empty."""
    none = F.array().cast(f"array<{EVENT}>")

    def or_else(option: Column, rest: Column) -> Column:
        return let(F.coalesce(option, none), lambda found: F.when(F.size(found) > 0, found).otherwise(rest))

    out = none
    for option in reversed(options):
        out = or_else(option, out)
    return out


def joined(row: Column) -> Column:
    return tidy(F.array_join(row, " "))


def icra(text: Column, company: Column) -> Column:
    """Rows close at the line that has the rating; amounts stand before it, the current one last where the table has a previous column."""
    body = after(text, ICRA_START)
    body = F.when(has(body, ICRA_HEAD), F.regexp_extract(body, f"(?is)^.*?((?:{ICRA_HEAD}).*)$", 1)).otherwise(body)

    def table(block: Column) -> Column:
        heads = lambda x: F.exists(F.array(*map(F.lit, ICRA_HEADS)), lambda h: x.startswith(h))
        kept = until(F.filter(lines_of(block), lambda x: ~heads(x)), lambda x: has(x, "^(?:Total|Grand Total)\\b"))
        rows = fold(kept, lambda own, x: has(x, ICRA_ROW) & ~F.element_at(own, -1).contains("[ICRA]"), lambda x: x.contains("[ICRA]"), None, lambda own: F.array_join(own, " ").contains("[ICRA]"))
        two = block.contains("Previous Rated Amount") | block.contains("Previous Rated\nAmount")

        def read(row: Column) -> Column:
            left = tidy(F.regexp_replace(F.regexp_extract(row, "(?i)^(.*?)\\[ICRA\\].", 1), "\\((?=[^)]*[A-Za-z])[^)]*\\)", " "))
            rating = first(row, "\\[ICRA\\].+$")

            def fields(clean: Column) -> Column:
                amounts = every(clean, "\\d[\\d,.]*")
                amount = F.when(two, F.element_at(amounts, -1)).otherwise(F.get(amounts, 0))
                return F.when(rating.isNotNull() & (F.size(amounts) > 0), event(F.coalesce(first(clean, "^(.+?)\\s+\\d[\\d,.]*", 1), clean), crore(amount), rating, None, some(F.regexp_extract(rating, "^[^;]*;(.*)$", 1))))

            return let(left, fields)

        return events(F.transform(rows, joined), read)

    return let(before(body, ICRA_END), table)


def care(text: Column, company: Column) -> Column:
    """Rows open at an instrument's name; without a table, the rating quoted in brackets behind the company's name."""

    def read(row: Column) -> Column:
        instrument = tidy(F.regexp_extract(row, f"(?i){CARE_ROW}", 1))
        rest = tidy(F.regexp_replace(row, f"(?i){CARE_ROW}", ""))

        def fields(s: Column) -> Column:
            rest = F.coalesce(first(s, CARE_AMOUNT, 2), s)
            bare = F.regexp_replace(rest, "^[- ]+", "")
            told = F.when(has(rest, CARE_ACTION), F.regexp_extract(rest, f"(?i)({CARE_ACTION}.*)$", 1)).otherwise(action_of(rest))
            current = tidy(before(rest, CARE_ACTION))
            gone = F.lower(bare).startswith("withdrawn") | (current.isin("-", "") & F.lower(told).contains("withdraw"))
            return event(instrument, crore(first(s, CARE_AMOUNT, 1)), F.when(gone, "Withdrawn").otherwise(current), F.when(~F.lower(bare).startswith("withdrawn"), first(told, CARE_BEFORE, 1)), F.when(F.lower(bare).startswith("withdrawn"), bare).otherwise(told))

        return let(rest, fields)

    kept = F.filter(lines_of(before(after(text, CARE_START), CARE_END)), lambda x: ~x.rlike(CARE_HEADS))
    opened = lambda x: has(x, CARE_ROW)
    tabled = events(F.transform(fold(kept, lambda _, x: opened(x), None, opened), joined), read)

    words = lambda c: F.array_distinct(every(F.lower(c), "[a-z]{3,}"))
    told = lambda rating: event(F.lit("Credit update"), F.lit(None), tidy(rating), None, F.lit("Credit update"))
    #: The rating in the brackets right behind the company's name, at whichever place it has one.
    behind = F.slice(F.split(text, F.concat(F.lit("(?i)\\Q"), F.nullif(company, F.lit("")), F.lit("\\E"))), 2, 1_000_000)
    own = F.array_compact(F.transform(behind, lambda x: first(x, f"^\\s*\\({CARE_QUOTED}", 1)))
    #: Else that of the name that shares the most words with the company's, two at least.
    quoted = F.arrays_zip(every(text, CARE_INLINE, 1).alias("who"), every(text, CARE_INLINE, 2).alias("rating"))
    scored = F.transform(quoted, lambda q, i: F.struct(F.size(F.array_intersect(words(q["who"]), words(company))).alias("score"), (-i).alias("at"), q["rating"].alias("rating")))
    near = let(F.array_max(scored), lambda q: F.array_compact(F.array(F.when(q["score"] >= 2, told(q["rating"])))))
    inline = either(F.transform(F.slice(own, 1, 1), told), near)
    return either(tabled, inline)


def india_ratings(text: Column, company: Column) -> Column:
    """Rows close at the line of the action, or are one line with an amount; amounts are millions."""
    starts = lambda x: x.isin(*INDIA_STARTS) | F.exists(F.array(*map(F.lit, INDIA_PHRASES)), lambda p: F.lower(x).contains(p))
    stops = lambda x: x.isin(*INDIA_ENDS) | F.upper(x).startswith("ANALYTICAL APPROACH")
    heads = lambda x: F.lower(x).isin(*INDIA_HEADS) | has(x, "^\\(?million\\)?$") | F.lower(x).startswith("*inr")
    kept = F.filter(until(since(lines_of(text), starts), stops), lambda x: ~starts(x) & ~heads(x))
    rows = fold(kept, None, lambda x: has(x, f"^{INDIA_ACTION}") | has(x, INDIA_LINE), None, lambda own: F.lit(False))

    def read(row: Column) -> Column:
        one = F.get(row, 0)
        rest = first(one, INDIA_LINE, 3)
        rating = tidy(before(rest, INDIA_ACTION))
        single = F.when(has(rest, INDIA_ACTION) & F.upper(rating).startswith("IND "), event(first(one, INDIA_LINE, 1), crore(first(one, INDIA_LINE, 2), True), rating, None, F.regexp_extract(rest, f"(?i)({INDIA_ACTION}.*)$", 1)))
        parts = until(row, lambda x: (x == "-") | x.contains("INR") | has(x, "\\bIND\\b") | has(x, INDIA_ACTION))
        amount = F.get(F.filter(row, lambda x: x.contains("INR") & x.rlike("\\d")), 0)
        rated, last = F.get(F.filter(row, lambda x: has(x, "\\bIND\\b")), 0), F.element_at(row, -1)
        several = F.when((F.size(row) >= 3) & rated.isNotNull() & has(last, INDIA_ACTION), event(F.coalesce(some(joined(parts)), one), crore(amount, True), rated, None, last))
        return F.when(has(one, INDIA_LINE), single).otherwise(several)

    rated = first(text, INDIA_ISSUER, 2)
    same = F.lower(first(text, INDIA_ISSUER, 1)) == F.lower(company)
    gone = F.array_compact(F.array(F.when(has(text, INDIA_DISCONTINUED) & same, event(F.lit("Issuer rating disclosure"), F.lit(None), F.concat(tidy(rated), F.lit("; Withdrawn")), None, F.lit("Withdrawn")))))
    return either(events(rows, read), gone)


def acuite(text: Column, company: Column) -> Column:
    """Rows open at their fixed name; a short-term symbol goes before a long-term one."""
    kept = until(since(F.transform(F.split(text, "\n"), tidy), lambda x: x.startswith("Product Quantum")), lambda x: F.exists(F.array(*map(F.lit, ACUITE_ENDS)), lambda e: x.startswith(e)))
    opened = lambda x: x.startswith(ACUITE_ROW)
    rows = fold(F.filter(kept, lambda x: (x != "") & ~x.startswith("Product Quantum")), lambda _, x: opened(x), None, opened)

    def read(row: Column) -> Column:
        rest = first(row, f"{ACUITE_ROW}\\s+(\\d+(?:\\.\\d+)?)\\s+(.*)$", 2)
        upper, gone = F.upper(rest), rest.contains("Withdrawn")
        current = F.coalesce(first(upper, ACUITE_SHORT, 1), first(upper, ACUITE_LONG, 1), F.when(gone, "Withdrawn"))
        action = F.coalesce(action_of(rest), F.when(gone, "Withdrawn"))
        return F.when(rest.isNotNull(), event(F.lit(ACUITE_ROW), crore(first(row, f"{ACUITE_ROW}\\s+(\\d+(?:\\.\\d+)?)\\s+(.*)$", 1)), current, None, action))

    return events(F.transform(rows, joined), read)


def brickwork(text: Column, company: Column) -> Column:
    """Facts of a row are spread over columns of lines, the previous rating first; one row a term, else the pair that the prose names."""

    def read(flat: Column) -> Column:
        def term(label: str, stop: str) -> Column:
            def fields(body: Column) -> Column:
                def rated(tokens: Column) -> Column:
                    now = F.coalesce(F.get(tokens, 1), F.when(has(body, "withdraw"), "Withdrawn"), F.get(tokens, 0))
                    now = F.when(has(body, NOT_COOPERATING) & ~F.upper(now).contains("ISSUER NOT COOPERATING"), F.concat(now, F.lit("; ISSUER NOT COOPERATING"))).otherwise(now)
                    return F.when(F.size(tokens) > 0, event(F.lit(label), F.lit(None), now, F.when(F.size(tokens) > 1, F.get(tokens, 0)), F.initcap(first(body, BRICKWORK_ACTION, 1))))

                return let(F.transform(every(body, BRICKWORK_TOKEN), lambda t: F.replace(F.replace(tidy(t), F.lit(" /"), F.lit("/")), F.lit("/ "), F.lit("/"))), rated)

            return let(F.regexp_extract(flat, f"(?i){label}\\s+(.*?)(?={stop})", 1), fields)

        pair = lambda k: first(flat, BRICKWORK_PAIR, k)
        tail = F.when(has(flat, NOT_COOPERATING), "; ISSUER NOT COOPERATING").otherwise("")
        long = F.concat(F.lit("BWR "), pair(1), F.coalesce(F.concat(F.lit("/"), F.initcap(pair(2))), F.lit("")), tail)
        told = F.when(pair(3).isNotNull(), F.array(event(F.lit("Long Term"), F.lit(None), long, None, F.lit("Reaffirmed")), event(F.lit("Short Term"), F.lit(None), F.concat(F.lit("BWR "), F.upper(pair(3)), tail), None, F.lit("Reaffirmed"))))
        return either(F.array_compact(F.array(term("Long Term", BRICKWORK_LONG_END), term("Short Term", BRICKWORK_SHORT_END))), told)

    return let(F.trim(F.regexp_replace(text, "\\s+", " ")), read)


def infomerics(text: Column, company: Column) -> Column:
    """Fragments gather until the row has an amount and a rating and the next instrument starts, or until the complexity closes it."""
    amount = lambda own: F.exists(own, lambda x: x.rlike("\\d"))
    rated = lambda own: F.exists(own, lambda x: x.contains("IVR") | x.contains("Withdrawn"))
    whole = lambda own: amount(own) & rated(own)
    heads = lambda x: F.lower(x).isin(*INFOMERICS_HEADS) | has(x, INFOMERICS_HEAD)

    def rows(lines: Column) -> Column:
        table = until(since(lines, lambda x: x == "Ratings"), lambda x: has(x, INFOMERICS_END))
        kept = until(F.filter(table, lambda x: ~heads(x)), lambda x: has(x, "^Total\\b"))
        tabled = fold(kept, lambda own, x: has(x, INFOMERICS_ROW) & whole(own), lambda x: has(x, "\\b(?:Simple|Complex)\\b$"), None, whole)
        term = lambda x: x.isin("Long Term", "Short Term")
        old = fold(lines, lambda _, x: term(x), lambda x: x.endswith("Simple"), term, whole)
        return F.when(F.size(table) > 0, tabled).otherwise(old)

    def read(row: Column) -> Column:
        plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(row, "(?i)\\b(A[1-4])\\s+\\+\\b", "$1+"), "\\s*/\\s*", "/"), "\\s*;\\s*", "; ")

        def fields(s: Column) -> Column:
            shape = "^(.+?)\\s+(\\d+(?:\\.\\d+)?)\\b(.*)$"
            rest = tidy(F.regexp_replace(tidy(F.regexp_extract(s, shape, 3)), "\\([^)]*\\)", " "))

            def rating(r: Column) -> Column:
                found = F.transform(every(r, INFOMERICS_RATING), tidy)
                told = F.coalesce(after(r, f"{INFOMERICS_RATING}.*?{INFOMERICS_RATING}"), after(r, INFOMERICS_RATING))
                told = some(F.regexp_replace(F.regexp_replace(tidy(told), "^[ -]+|[ -]+$", ""), "(?i)^rating ", ""))
                instrument = tidy(F.regexp_replace(F.regexp_extract(s, shape, 1), "[-/]+$", ""))
                return F.when((F.size(found) > 0) & has(s, shape), event(instrument, crore(F.regexp_extract(s, shape, 2)), F.get(found, 0), F.get(found, 1), told))

            return let(rest, rating)

        return let(plain, fields)

    return events(F.transform(let(lines_of(text), rows), joined), read)


def crisil(text: Column, company: Column) -> Column:
    """Label blocks; else the annexure, summed by instrument and rating; else a quoted rating; else rows of millions. Each event once."""
    text = F.substring(text, 1, CRISIL_LIMIT)
    total = crore(first(text, CRISIL_TOTAL, 1))

    def label(name: str, stop: str, instrument: str, amount: Column) -> Column:
        def split(value: Column) -> Column:
            hit = F.coalesce(first(value, CRISIL_RATING), first(value, CRISIL_LONG), first(value, CRISIL_SHORT))
            #: What stands behind the pattern that hit; the short-term pattern is part of the first one.
            told = F.regexp_replace(tidy(F.coalesce(after(value, CRISIL_RATING), after(value, CRISIL_LONG))), "^[ \\-&]+|[ \\-&]+$", "")
            told = F.regexp_replace(told, "^\\(([^)]*)\\)$", "$1")
            gone = F.lower(told).contains("withdrawn") & ~F.lower(hit).contains("withdrawn")
            return F.when(hit.isNotNull(), event(F.lit(instrument), amount, F.when(gone, F.concat(tidy(hit), F.lit("; Withdrawn"))).otherwise(tidy(hit)), None, some(told)))

        return let(tidy(F.regexp_replace(tidy(first(text, f"{name}\\s+(.+?)(?=(?:{stop})|$)", 1)), "^[& ]+", "")), split)

    deposit = "Rs\\.?\\s*\\d+(?:\\.\\d+)?\\s*Crore\\s*Fixed Deposits"
    deposited = F.coalesce(crore(first(text, "Rs\\.?\\s*(\\d+(?:\\.\\d+)?)\\s*Crore\\s*Fixed Deposits", 1)), total)
    labelled = F.array_compact(
        F.array(
            label("Long Term Rating", CRISIL_AFTER_LONG, "Bank Loan Facilities - Long Term", total), label("Short Term Rating", CRISIL_AFTER_SHORT, "Bank Loan Facilities - Short Term", total),
            label(deposit, CRISIL_AFTER_DEPOSIT, "Fixed Deposits", deposited),
        )
    )

    kept = F.filter(lines_of(before(after(text, CRISIL_ANNEXURE), CRISIL_ANNEXURE_END)), lambda x: ~x.isin(*CRISIL_ANNEXURE_HEADS))
    rows = fold(kept, None, lambda x: has(x, CRISIL_RATING), None, lambda own: F.lit(False))

    def lender(row: Column) -> Column:
        at = F.array_position(F.transform(row, lambda x: x.rlike("^\\d+(?:\\.\\d+)?$")), F.lit(True)).cast("int")
        instrument = F.regexp_replace(joined(F.slice(row, 1, at - 1)), "^[& ]+|[& ]+$", "")
        return F.when(at > 0, event(tidy(instrument), crore(F.element_at(row, at)), tidy(first(F.element_at(row, -1), CRISIL_RATING))))

    def summed(found: Column) -> Column:
        kinds = F.array_distinct(F.transform(found, lambda e: F.struct(e["instrument"], e["current_rating"])))
        same = lambda k: F.filter(found, lambda e: F.struct(e["instrument"], e["current_rating"]) == k)
        return F.transform(kinds, lambda k: event(k["instrument"], F.aggregate(same(k), F.lit(0.0), lambda a, e: F.round(a + F.coalesce(e["amount_crore"], F.lit(0.0)), 4)), k["current_rating"]))

    annexed = let(events(rows, lender), summed)
    #: A quotation counts if a rating can be read in it; what led to it is its action.
    quotation = F.regexp_extract(text, f"(?is)(.{{0,30}}){CRISIL_QUOTE}", 2)
    lead = F.regexp_extract(text, f"(?is)(.{{0,30}}{CRISIL_QUOTE})", 1)
    quoted = let(first(quotation, CRISIL_RATING), lambda r: F.array_compact(F.array(F.when(r.isNotNull(), event(F.lit("Bank Loan Facilities"), total, r, None, some(tidy(F.split_part(lead, r, F.lit(1)))))))))

    def pair(x: Column) -> Column:
        amount, rating = x["line"], x["next"]
        good = has(amount, CRISIL_MILLION) & has(rating, CRISIL_OLD_RATING)
        told = F.regexp_replace(first(rating, CRISIL_OLD_RATING, 2), "^[()]+|[()]+$", "")
        return F.when(good, event(first(amount, CRISIL_MILLION, 2), crore(first(amount, CRISIL_MILLION, 1), True), first(rating, CRISIL_OLD_RATING, 1), first(rating, CRISIL_OLD_BEFORE, 1), told))

    old = let(lines_of(text), lambda ls: events(F.transform(ls, lambda x, i: F.struct(x.alias("line"), F.get(ls, i + 1).alias("next"))), pair))

    def once(found: Column) -> Column:
        key = lambda e: F.struct(e["instrument"], e["current_rating"], e["amount_crore"])
        return let(F.transform(found, key), lambda keys: F.filter(found, lambda e, i: F.array_position(keys, key(e)) == i + 1))

    return let(either(labelled, annexed, quoted, old), once)


LAYOUTS = {"crisil": crisil, "care": care, "india_ratings": india_ratings, "acuite": acuite, "brickwork": brickwork, "infomerics": infomerics, "icra": icra}


def rating_events(agency: Column, text: Column, company: Column) -> Column:
    """The rated instruments of a document, in its order, by its agency's layout."""
    none, known = F.array().cast(f"array<{EVENT}>"), F.coalesce(company, F.lit(""))

    def choose(whole: Column) -> Column:
        out = none
        for name, read in LAYOUTS.items():
            out = F.when(agency == name, F.coalesce(read(whole, known), none)).otherwise(out)
        return out

    return let(normal_text(text), choose)


def event_rows(docs: DataFrame, key: str, text: str, agency: str, company: str) -> DataFrame:
    """(key, place, instrument, amount_crore, current_rating, previous_rating, action), one row a rated instrument."""
    found = docs.select(key, F.posexplode(rating_events(F.col(agency), F.col(text), F.col(company))).alias("at", "e"))
    return found.select(key, (F.col("at") + 1).alias("place"), "e.*")
