"""US states in free-text places, and the classes of a place."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: States and territories by name.
STATES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA", "colorado": "CO", "connecticut": "CT", "delaware": "DE", "district of columbia": "DC", "florida": "FL",
    "georgia": "GA", "hawaii": "HI", "idaho": "ID", "illinois": "IL", "indiana": "IN", "iowa": "IA", "kansas": "KS", "kentucky": "KY", "louisiana": "LA", "maine": "ME", "maryland": "MD",
    "massachusetts": "MA", "michigan": "MI", "minnesota": "MN", "mississippi": "MS", "missouri": "MO", "montana": "MT", "nebraska": "NE", "nevada": "NV", "new hampshire": "NH", "new jersey": "NJ",
    "new mexico": "NM", "new york": "NY", "north carolina": "NC", "north dakota": "ND", "ohio": "OH", "oklahoma": "OK", "oregon": "OR", "pennsylvania": "PA", "rhode island": "RI",
    "south carolina": "SC", "south dakota": "SD", "tennessee": "TN", "texas": "TX", "utah": "UT", "vermont": "VT", "virginia": "VA", "washington": "WA", "west virginia": "WV", "wisconsin": "WI",
    "wyoming": "WY", "puerto rico": "PR", "guam": "GU", "virgin islands": "VI", "american samoa": "AS", "northern mariana islands": "MP",
}
#: What counts as home are the contiguous states and the District; the rest is overseas, and so are these words and codes.
NOT_CONTIGUOUS = ["AK", "HI", "PR", "GU", "VI", "AS", "MP"]
ABROAD = [
    "OCONUS", "overseas", "germany", "deutschland", "italy", "italia", "spain", "portugal", "belgium", "netherlands", "poland", "romania", "bulgaria", "hungary", "greece", "turkey", "turkiye", "türkiye",
    "norway", "united kingdom", "england", "scotland", "wales", "northern ireland", "japan", "okinawa", "korea", "republic of korea", "philippines", "thailand", "singapore", "australia",
    "new zealand", "kuwait", "qatar", "bahrain", "united arab emirates", "saudi", "jordan", "iraq", "afghanistan", "djibouti", "kenya", "somalia", "colombia", "honduras", "panama", "guam",
    "puerto rico", "virgin islands", "american samoa", "alaska", "hawaii", r"RAF \w+", r"AE\b\s*\d", "kadena", "yokota", "misawa", "camp humphreys", "osan", "ramstein", "grafenwoehr",
    "grafenwöhr", "grafenwohr", "vilseck", "baumholder", "stuttgart", "wiesbaden", "vicenza", "aviano", "sigonella", "rota", "lakenheath", "mildenhall", "landstuhl", "ansbach", "hohenfels", "panzer kaserne",
]
ABROAD_WHOLE = ["UK", "ROK", "UAE", "APO", "FPO"]
COUNTRY_CODES = "JP KR DE IT GB ES PT BE NL PL RO BG GR TR NO QA KW BH AE SA JO IQ AF DJ KE AU NZ PH TH SG CO HN PA".split()

_LEADING = r"(?:^|[;,]\s*|\s)"


def home_pattern() -> str:
    """A state of the contiguous ones: its capitals behind a separator, or its name in any case."""
    codes = [c for c in STATES.values() if c not in NOT_CONTIGUOUS]
    names = [n.replace(" ", r"\s+") for n, c in STATES.items() if c not in NOT_CONTIGUOUS] + ["CONUS"]
    return rf"{_LEADING}(?:{'|'.join(codes)})(?![A-Za-z])|(?i)\b(?:{'|'.join(names)})\b"


def overseas_pattern() -> str:
    """A word that begins like one of elsewhere, a code of a state that isn't contiguous, in any case and behind a word's end, or a country's capitals that no US follows."""
    words = "|".join([w.replace(" ", r"\s+") for w in ABROAD] + [rf"{w}\b" for w in ABROAD_WHOLE])
    codes = rf"{_LEADING}(?:{'|'.join(COUNTRY_CODES)})(?!\s*,\s*(?:US|USA)\b)(?![A-Za-z])"
    return rf"{codes}|(?i)\b(?:{words})|(?i)\b(?:,\s*|\s)(?:{'|'.join(NOT_CONTIGUOUS)})(?![A-Za-z])"


def state_code(location: Column) -> Column:
    """The two-letter state that a place names, null for none or where it would be a guess.

    The last capital code in a state's place (behind a comma, or with nothing, a ZIP or the country behind it) wins; else a spelled-out
    name in the comma parts from right to left, the longest of a part; else a small code as the very last word.
    """
    text = F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(location, F.lit("")), r"\s+", " ")), r"\.", "")
    codes = "|".join(STATES.values())
    # Behind a comma a code counts whatever follows; elsewhere what follows decides.
    behind_comma = rf"(?<=,)\s?(?:{codes})\b|(?<=, )(?:{codes})\b"
    before_end = rf"\b(?:{codes})\b(?=\s*(?:$|,|\d{{5}}(?:-\d{{4}})?\b|(?i:USA?\b|United\s+States\b)))"
    anchored = F.regexp_extract_all(text, F.lit(f"(?:{behind_comma}|{before_end})"), F.lit(0))
    names = F.create_map(*(F.lit(x) for pair in STATES.items() for x in pair))
    longest = sorted(STATES, key=lambda n: (-len(n), n))

    def named(part: Column) -> Column:
        # Names of one part by length: the first length that matches.
        return F.coalesce(*(F.when(F.regexp_extract(part, pattern, 0) != "", F.element_at(names, F.regexp_extract(part, pattern, 0))) for pattern in _by_length(longest)))

    parts = F.filter(F.split(F.lower(text), ","), lambda p: F.trim(p) != "")
    spelled = F.filter(F.reverse(F.transform(parts, named)), lambda c: c.isNotNull())
    last = F.upper(F.regexp_extract(F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("")), "([a-z]+)[^a-z]*$", 1))
    return F.coalesce(
        F.trim(F.try_element_at(anchored, F.lit(-1))), F.try_element_at(spelled, F.lit(1)), F.when(last.isin(*STATES.values()), last)
    )


def _by_length(names: list[str]) -> list[str]:
    lengths = sorted({len(n) for n in names}, reverse=True)
    return [r"\b(?:" + "|".join(n for n in names if len(n) == k) + r")\b" for k in lengths]
