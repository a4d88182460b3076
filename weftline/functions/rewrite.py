"""Query expansion, as a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions import text as tx

#: Country names in the order they are looked for, and their codes.
COUNTRIES = {
    "india": "IN",
    "us": "US",
    "usa": "US",
    "united states": "US",
    "america": "US",
    "uk": "GB",
    "united kingdom": "GB",
    "britain": "GB",
    "germany": "DE",
    "france": "FR",
    "japan": "JP",
    "china": "CN",
    "brazil": "BR",
    "canada": "CA",
    "australia": "AU",
}
#: Words that stand for a state or for recent rows.
ACTIVE = ("active", "enabled", "live", "online", "current")
INACTIVE = ("inactive", "disabled", "deactivated", "banned", "suspended")
RECENT = ("recent", "recently", "latest", "new", "newest", "just joined", "just registered", "fresh", "last week", "last month", "today")
#: Words that lead a question, a mail provider's name before a word for its accounts, and a dialling code.
LEAD = r"(?i)^(who is|what is|find|show me|get|list|fetch|give me)\s+"
PROVIDER = r"(?U)\b(\w+)\s+(?:email|account|mail)\b"
DIALLING_CODE = r"(\+(\d{1,3}))"


def _any(text: Column, words: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(text, F.lit(word))
    return hit


def expand(query: Column, most: int = 3, more: Column | None = None) -> Column:
    """The query, then its variants, each once whatever its case and outer
    spaces, at most ``most`` + 1. ``more``: an array of further variants."""
    return tx.once(query, lambda own: tx.once(F.lower(own), lambda q: _variants(own, q, most, more)))


def _variants(query: Column, q: Column, most: int, more: Column | None) -> Column:
    """q: the query in lower case."""
    country = F.lit(None).cast("string")
    for name, code in reversed(COUNTRIES.items()):
        country = F.when(F.contains(q, F.lit(name)), F.replace(q, F.lit(name), F.lit(code))).otherwise(country)
    domain = F.regexp_extract(q, PROVIDER, 1)
    phone = F.regexp_extract(query, DIALLING_CODE, 1)
    bare = F.trim(F.regexp_replace(q, LEAD, ""))
    variants = F.array(
        query,
        country,
        F.when(_any(q, ACTIVE), F.concat(query, F.lit(" is_active 1"))),
        F.when(_any(q, INACTIVE), F.concat(query, F.lit(" is_active 0"))),
        F.when(_any(q, RECENT), F.concat(query, F.lit(" created_at recent registration"))),
        F.when(domain != "", F.concat(F.lit("@"), domain, F.lit(".com email"))),
        F.when(phone != "", F.concat(F.lit("phone_number "), phone)),
        F.when((bare != "") & (bare != q), bare),
    )
    if more is not None:
        variants = F.concat(variants, more)
    trimmed = F.transform(F.array_compact(variants), lambda v: F.trim(v))

    def distinct(found: Column, folded: Column) -> Column:
        first = F.transform(found, lambda v, i: F.when(F.array_position(folded, F.lower(v)) == i + 1, v))
        return F.slice(F.array_compact(first), 1, most + 1)

    return tx.once(trimmed, lambda found: tx.once(F.transform(found, lambda v: F.lower(v)), lambda folded: distinct(found, folded)))
