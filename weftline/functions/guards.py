"""Guards on questions and answers, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions import text as tx
from weftline.model import Settings

#: Patterns of attempts to change the instructions (any case).
INJECTION_PATTERNS = [
    r"ignore\s+(all\s+)?previous\s+instructions",
    r"forget\s+(everything|all|your\s+instructions)",
    r"you\s+are\s+now\s+(?!a\s+data)",
    r"act\s+as\s+(?!a\s+data\s+analyst)",
    r"jailbreak",
    r"system\s+prompt",
    r"<\s*/?(?:system|instructions?|prompt)\s*>",
    r"\[INST\]|\[/INST\]",
    r"###\s*(?:System|Human|Assistant):",
    r"print\s+(your\s+)?(?:system\s+)?instructions",
    r"reveal\s+(your\s+)?(prompt|instructions|context)",
]

#: Personal data by kind, in the order of detection and redaction.
PII_PATTERNS = {
    "email": r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b",
    "phone": r"\b(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "credit_card": r"\b(?:\d{4}[-\s]?){3}\d{4}\b",
    "ip": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
}


#: The answers to a question over the limit, and to one that no model could answer.
RATE_LIMITED = "Rate limit exceeded: max %d queries per minute"
FAILED = "Error generating response: %s"


def injections(text: Column) -> Column:
    """The first match (at most 50 characters) of every pattern that matches, in order."""
    hits = [F.when(text.rlike("(?iU)" + p), F.substring(F.regexp_extract(text, "(?iU)(" + p + ")", 1), 1, 50)) for p in INJECTION_PATTERNS]
    return F.array_compact(F.array(*hits))


def _may_hold(text: Column, kind: str) -> Column:
    """What a text must hold for the kind's pattern to match: cheap to look for, and most texts lack it."""
    return F.contains(text, F.lit("@")) if kind == "email" else text.rlike(r"(?U)\d")


def pii_kinds(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(_may_hold(text, k) & text.rlike("(?iU)" + p), F.lit(k)) for k, p in PII_PATTERNS.items()]))


def redacted(text: Column) -> Column:
    def replaced(own: Column, kinds: list[str]) -> Column:
        new = own
        for kind in kinds:
            new = F.regexp_replace(new, "(?iU)" + PII_PATTERNS[kind], f"[REDACTED_{kind.upper()}]")
        return F.when(_may_hold(own, kinds[0]), new).otherwise(own)

    first, *rest = PII_PATTERNS
    return tx.once(tx.once(text, lambda own: replaced(own, [first])), lambda own: replaced(own, rest))


def check_input(query: Column, settings: Settings | None = None) -> Column:
    """struct<allowed, block_reason, warnings, modified_query>; the first failed
    check decides. The rate limit is stateful, comes last, and stands in ``streaming``. The
    messages are fixed values."""
    s = settings or Settings()
    blocked = F.lit(False)
    for word in s.blocked_keywords:
        blocked = blocked | F.contains(F.lower(query), F.lit(word.lower()))
    found, kinds = injections(query), pii_kinds(query)
    reason = (
        F.when(query.isNull() | (F.length(query) < s.min_query), "Query too short")
        .when(F.length(query) > s.max_query, f"Query exceeds {s.max_query} character limit")
        .when(blocked, "Query contains blocked content")
    )
    if s.block_injections:
        reason = reason.when(F.size(found) > 0, "Potential prompt injection detected")
    notes = F.array_compact(
        F.array(
            F.when(F.lit(not s.block_injections) & (F.size(found) > 0), F.concat(F.lit("Possible injection pattern detected: "), F.try_element_at(found, F.lit(1)))),
            F.when(F.size(kinds) > 0, F.concat(F.lit("Query may contain PII: "), F.array_join(kinds, ", "))),
        )
    )
    changed = F.when(reason.isNull() & (F.size(kinds) > 0), redacted(query)) if s.redact_query else F.lit(None).cast("string")
    return F.struct(reason.isNull().alias("allowed"), reason.alias("block_reason"), F.when(reason.isNull(), notes).otherwise(F.array().cast("array<string>")).alias("warnings"), changed.alias("modified_query"))


def numbers(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b\d{2,}\b"), F.lit(0)))


def unsupported_numbers(response: Column, sources: Column) -> Column:
    """Numbers of a response that no source text has, without years 1900 to 2100
    and numbers up to 10. sources: array of texts."""
    known = F.flatten(F.transform(sources, lambda t: F.coalesce(numbers(t), F.array().cast("array<string>"))))
    rest = F.array_except(numbers(response), known)
    value = lambda n: n.try_cast("decimal(38,0)")
    return F.filter(rest, lambda n: F.coalesce(~value(n).between(1900, 2100) & (value(n) > 10), F.lit(True)))


def check_output(response: Column, sources: Column, settings: Settings | None = None) -> Column:
    """struct<safe, warnings, modified_response>: more than three unsupported
    numbers are unsafe. The messages are fixed values."""
    s = settings or Settings()
    odd, kinds = unsupported_numbers(response, sources), pii_kinds(response)
    invented = (F.size(sources) > 0) & (F.size(odd) > 3)
    notes = [F.when(invented, F.concat(F.lit("Response contains "), F.size(odd).cast("string"), F.lit(" numbers not found in retrieved data")))]
    changed = F.lit(None).cast("string")
    if s.redact_response:
        notes.insert(0, F.when(F.size(kinds) > 0, F.concat(F.lit("PII redacted from response: "), F.array_join(kinds, ", "))))
        changed = F.when(F.size(kinds) > 0, redacted(response))
    return F.struct((~F.coalesce(invented, F.lit(False))).alias("safe"), F.array_compact(F.array(*notes)).alias("warnings"), changed.alias("modified_response"))
