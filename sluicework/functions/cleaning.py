"""Cleaning expressions: native column functions for money, dates, names, codes, lists and markup."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE_FORMATS = ("yyyy-MM-dd", "MM/dd/yyyy", "MMMM d, yyyy", "MMM d, yyyy", "dd-MM-yyyy", "dd-MMM-yyyy", "yyyyMMdd", "yyyy/MM/dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss")
TIME_FORMATS = ("HH:mm:ss", "h:mm a", "HH:mm", "HHmmss")
KILOGRAMS = {"kg": 1.0, "g": 0.001, "lb": 0.45359237, "lbs": 0.45359237, "oz": 0.028349523125}


def collapse_spaces(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), " +", " ")


def title_case(c: Column) -> Column:
    return F.initcap(F.trim(c))


def to_number(c: Column) -> Column:
    """Money or plain numbers as double; the sign stays; null where no number is left."""
    return F.regexp_replace(c.cast("string"), r"[^0-9.\-]", "").try_cast("double")


def to_fee(c: Column) -> Column:
    return F.when(F.upper(F.trim(c)) == "N/A", 0.0).otherwise(to_number(c))


def to_count(c: Column) -> Column:
    """A non-negative whole number."""
    return F.greatest(F.lit(0).cast("long"), c.cast("string").try_cast("long"))


def to_date(c: Column, formats: Sequence[str] = DATE_FORMATS, pivot: int | None = None) -> Column:
    """ISO date from the first format that fits, or from epoch seconds; two-digit years fall within 100 years up to ``pivot``."""
    text = F.trim(c.cast("string"))
    parsed = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])
    if pivot is not None:
        short = F.try_to_timestamp(text, F.lit("dd-MMM-yy"))
        parsed = F.coalesce(parsed, F.when(F.year(short) > pivot, F.add_months(short, -1200)).otherwise(short))
    epoch = F.when(text.rlike("^[0-9]{9,10}$"), F.timestamp_seconds(text.try_cast("long")))
    return F.date_format(F.coalesce(epoch, parsed), "yyyy-MM-dd")


def to_time(c: Column, formats: Sequence[str] = TIME_FORMATS) -> Column:
    return F.date_format(F.coalesce(*[F.try_to_timestamp(F.trim(c), F.lit(f)) for f in formats]), "HH:mm:ss")


def to_kilograms(c: Column) -> Column:
    unit = F.lower(F.regexp_extract(c, r"([A-Za-z]+)\s*$", 1))
    factor = F.coalesce(*[F.when(unit == u, F.lit(k)) for u, k in KILOGRAMS.items()], F.lit(1.0))
    return F.regexp_extract(c, r"([0-9]+\.?[0-9]*)", 1).try_cast("double") * factor


def canonical(c: Column, names: Mapping[str, str]) -> Column:
    """Look a value up by its letters and digits in upper case; unknown ones come back in upper case."""
    key = F.regexp_replace(F.upper(F.trim(c)), r"[^\p{L}\p{N}$]", "")
    table = F.create_map(*[F.lit(x) for k, v in names.items() for x in (k.upper(), v)])
    return F.coalesce(F.element_at(table, key), F.upper(F.trim(c)))


# Spellings (upper case, letters, digits and $ only) and what they stand for.
CURRENCIES = {"$": "USD", "US$": "USD", "USDOLLAR": "USD", "USDOLLARS": "USD", "DOLLAR": "USD", "DOLLARS": "USD", "EURO": "EUR", "EUROS": "EUR", "POUND": "GBP", "POUNDS": "GBP", "POUNDSTERLING": "GBP", "STERLING": "GBP", "YEN": "JPY", "C$": "CAD", "CA$": "CAD", "A$": "AUD"}
TRANSACTION_TYPES = {"DB": "DEBIT", "DR": "DEBIT", "WITHDRAWAL": "DEBIT", "PURCHASE": "DEBIT", "PAYMENT": "DEBIT", "CR": "CREDIT", "DEPOSIT": "CREDIT", "REFUND": "CREDIT", "XFER": "TRANSFER", "TRF": "TRANSFER", "WIRE": "TRANSFER"}
COUNTRIES = {"USA": "US", "UNITEDSTATES": "US", "UNITEDSTATESOFAMERICA": "US", "AMERICA": "US", "840": "US", "GBR": "GB", "UK": "GB", "UNITEDKINGDOM": "GB", "GREATBRITAIN": "GB", "ENGLAND": "GB", "826": "GB", "CAN": "CA", "CANADA": "CA", "124": "CA", "DEU": "DE", "GERMANY": "DE", "276": "DE", "FRA": "FR", "FRANCE": "FR", "250": "FR", "MEX": "MX", "MEXICO": "MX", "484": "MX", "AUS": "AU", "AUSTRALIA": "AU", "36": "AU", "JPN": "JP", "JAPAN": "JP", "392": "JP"}
INSURERS = {"BCBS": "Blue Cross Blue Shield", "BLUECROSS": "Blue Cross Blue Shield", "BLUESHIELD": "Blue Cross Blue Shield", "BLUECROSSBLUESHIELD": "Blue Cross Blue Shield", "BLUECROSSANDBLUESHIELD": "Blue Cross Blue Shield", "UHC": "UnitedHealthcare", "UNITED": "UnitedHealthcare", "UNITEDHEALTH": "UnitedHealthcare", "UNITEDHEALTHCARE": "UnitedHealthcare", "AETNA": "Aetna", "CIGNA": "Cigna", "HUMANA": "Humana", "KAISER": "Kaiser Permanente", "KAISERPERMANENTE": "Kaiser Permanente", "ANTHEM": "Anthem", "MEDICARE": "Medicare", "MEDICAID": "Medicaid"}
STATES = dict(
    AL="Alabama", AK="Alaska", AZ="Arizona", AR="Arkansas", CA="California", CO="Colorado", CT="Connecticut", DE="Delaware", DC="District of Columbia",
    FL="Florida", GA="Georgia", HI="Hawaii", ID="Idaho", IL="Illinois", IN="Indiana", IA="Iowa", KS="Kansas", KY="Kentucky", LA="Louisiana", ME="Maine",
    MD="Maryland", MA="Massachusetts", MI="Michigan", MN="Minnesota", MS="Mississippi", MO="Missouri", MT="Montana", NE="Nebraska", NV="Nevada",
    NH="New Hampshire", NJ="New Jersey", NM="New Mexico", NY="New York", NC="North Carolina", ND="North Dakota", OH="Ohio", OK="Oklahoma", OR="Oregon",
    PA="Pennsylvania", RI="Rhode Island", SC="South Carolina", SD="South Dakota", TN="Tennessee", TX="Texas", UT="Utah", VT="Vermont", VA="Virginia",
    WA="Washington", WV="West Virginia", WI="Wisconsin", WY="Wyoming",
)


def to_currency(c: Column) -> Column:
    """A three-letter code."""
    return canonical(c, CURRENCIES)


def to_transaction_type(c: Column) -> Column:
    """DEBIT, CREDIT or TRANSFER."""
    return canonical(c, TRANSACTION_TYPES)


def to_country(c: Column) -> Column:
    """A two-letter code, from names and from codes of three letters or digits."""
    return canonical(c, COUNTRIES)


def to_insurer(c: Column) -> Column:
    """A known insurer's name; others in title case."""
    named = canonical(c, INSURERS)
    return F.when(named == F.upper(F.trim(c)), F.when(named.isin(*INSURERS.values()), named).otherwise(title_case(c))).otherwise(named)


def to_state(c: Column) -> Column:
    """A two-letter abbreviation, from names and their beginnings of four letters or more with a point or without."""
    key = F.regexp_replace(F.upper(F.trim(c)), r"[^A-Z]", "")
    hits = [F.when((F.length(key) >= 4) & F.lit(name.upper().replace(" ", "")).startswith(key), F.lit(code)) for code, name in STATES.items()]
    return F.coalesce(*hits, F.when(F.length(key) == 2, key), F.upper(F.trim(c)))


def nearest_word(c: Column, words: Sequence[str], most: int = 2) -> Column:
    """The word within ``most`` edits, the nearest first, or the value in title case."""
    pairs = F.array_sort(F.filter(F.array(*[F.struct(F.levenshtein(F.lower(F.trim(c)), F.lit(w.lower())).alias("d"), F.lit(w).alias("w")) for w in words]), lambda p: p["d"] <= most))
    return F.coalesce(F.try_element_at(pairs, F.lit(1))["w"], title_case(c))


def prefixed(c: Column, prefix: str) -> Column:
    """Exactly one ``prefix-`` before the upper-cased code."""
    return F.concat(F.lit(prefix + "-"), F.regexp_replace(F.upper(F.trim(c)), f"^{prefix}-?", ""))


def last_digits(c: Column, shown: int = 4) -> Column:
    return F.concat(F.lit("****"), F.right(F.regexp_replace(c, "[^0-9]", ""), F.lit(shown)))


def to_phone(c: Column) -> Column:
    return F.regexp_replace(F.right(F.regexp_replace(c, "[^0-9]", ""), F.lit(10)), r"^(\d{3})(\d{3})(\d{4})$", "($1) $2-$3")


def to_zip(c: Column) -> Column:
    return F.lpad(F.substring_index(c.cast("string"), "-", 1), 5, "0")


def initial(c: Column) -> Column:
    return F.upper(F.left(F.trim(c), F.lit(1)))


def person_name(c: Column) -> Column:
    return F.initcap(F.regexp_replace(F.trim(c), r"(?i)^(Dr|Mrs|Mr|Ms)\.?\s+", ""))


def blood_type(c: Column) -> Column:
    text = F.upper(F.trim(c))
    sign = F.when(text.rlike(r"POS|\+"), "+").when(text.rlike(r"NEG|-\s*$"), "-")
    return F.concat(F.regexp_extract(text, r"^(AB|A|B|O)", 1), sign)


def to_list(c: Column) -> Column:
    """Items of a text with commas or semicolons; null, blank and ``None`` give no items."""
    text = F.trim(c)
    none = text.isNull() | (text == "") | (F.lower(text) == "none")
    return F.when(none, F.array().cast("array<string>")).otherwise(F.filter(F.split(text, r"\s*[,;]\s*"), lambda x: x != ""))


def to_tags(c: Column) -> Column:
    return F.array_distinct(F.transform(F.split(c, ","), lambda x: F.lower(F.trim(x))))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]*>", "")


ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&middot;": "·", "&copy;": "©", "&amp;": "&"}


def decode_entities(c: Column) -> Column:
    for entity, char in ENTITIES.items():
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def html_text(c: Column) -> Column:
    """Readable text of an HTML page: without scripts, styles, comments and tags."""
    bare = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(decode_entities(F.regexp_replace(bare, "<[^>]*>", " ")), r"\s+", " "))


def street(c: Column) -> Column:
    for short, full in (("St", "Street"), ("Ave", "Avenue"), ("Blvd", "Boulevard"), ("Rd", "Road"), ("Dr", "Drive")):
        c = F.regexp_replace(c, rf"\b{short}\b\.?", full)
    return c


def description(c: Column) -> Column:
    return F.initcap(collapse_spaces(F.regexp_replace(c, r"\.{3}$", "")))
