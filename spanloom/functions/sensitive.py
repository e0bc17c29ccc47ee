"""Sensitive patterns in text: what was found, masked, and the risk it adds up to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and keywords.
EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
CARD = r"(?<!\d)(?:\d[ -]*?){13,19}(?!\d)"
PESEL = r"(?<!\d)\d{11}(?!\d)"
PHONE = r"(?<!\d)(?:\+?\d[\d\s().-]{7,}\d)(?!\d)"
ADDRESS = r"(?iu)\b(?:address|adres|street|st\.|ul\.|ulica|avenue|ave\.|road|rd\.|mieszka(?:m|sz)?\s+(?:przy|na)|lives?\s+at)\b.{0,80}"
KEYWORDS = (
    "attorney", "bank account", "choroba", "credit score", "debt", "diagnosis", "diagnoza", "dlug", "dług", "financial", "hospital", "illness", "konto bankowe",
    "kredyt", "lawsuit", "lawyer", "legal", "lekarz", "medical", "medication", "pozew", "prawnik", "szpital", "terapia", "therapy",
)


def mask_email(value: Column) -> Column:
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    parts = F.split(domain, r"\.")
    short = lambda c: F.when(F.length(c) > 2, F.concat(F.substring(c, 1, 2), F.lit("***"))).otherwise("***")
    return F.concat(short(local), F.lit("@"), F.array_join(F.concat(F.array(short(parts[0])), F.slice(parts, F.lit(2), F.size(parts))), "."))


def mask_digits(value: Column) -> Column:
    d = F.regexp_replace(value, r"\D", "")
    return F.when(F.length(d) <= 4, "***").otherwise(F.concat(F.substring(d, 1, 2), F.lit("***"), F.right(d, F.lit(2))))


def excerpt(value: Column, limit: int = 56) -> Column:
    t = F.trim(F.regexp_replace(value, r"(?U)\s+", " "))
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, limit - 3)), F.lit("...")))


def matches(text: Column) -> Column:
    """Array of (type, text, severity); a number can be of several types."""
    t = F.coalesce(text, F.lit(""))
    digits = lambda x: F.length(F.regexp_replace(x, r"\D", ""))

    def of(pattern, kind, severity, shown, keep=None):
        found = F.regexp_extract_all(t, F.lit(f"({pattern})"), 1)
        found = F.filter(found, keep) if keep is not None else found
        return F.transform(found, lambda x: F.struct(F.lit(kind).alias("type"), shown(x).alias("text"), F.lit(severity).alias("severity")))

    low = F.lower(t)
    words = F.filter(F.array(*[F.when(F.contains(low, F.lit(k)), k) for k in KEYWORDS]), lambda x: x.isNotNull())
    return F.concat(
        of(EMAIL, "email", "medium", mask_email),
        of(CARD, "credit_card_like", "high", mask_digits, lambda x: digits(x).between(13, 19)),
        of(PESEL, "pesel_like", "high", mask_digits),
        of(PHONE, "phone", "medium", mask_digits, lambda x: digits(x).between(9, 15)),
        of(ADDRESS, "address_like", "medium", excerpt),
        F.transform(words, lambda x: F.struct(F.lit("sensitive_keyword").alias("type"), x.alias("text"), F.lit("medium").alias("severity"))),
    )


def risk(found: Column) -> Column:
    """high if any match is, or three medium ones; medium if there is one."""
    medium = F.size(F.filter(found, lambda x: x["severity"] == "medium"))
    return F.when(F.exists(found, lambda x: x["severity"] == "high") | (medium >= 3), "high").when(medium > 0, "medium").otherwise("low")
