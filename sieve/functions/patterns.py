"""Named regular expressions for pattern rules.

Fixed values: these nine expressions must equal the ones rule files refer to
by name, so they are kept verbatim. All of them use only constructs that
Java regex (Spark ``rlike``) and RE2 (DuckDB ``regexp_matches``) read alike.
"""

# --- fixed values: name -> regular expression -------------------------------
NAMED_PATTERNS: dict[str, str] = {
    "email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    "us_phone": r"^\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}$",
    "us_zip": r"^\d{5}(-\d{4})?$",
    "ca_postal": r"^[A-Za-z]\d[A-Za-z][ -]?\d[A-Za-z]\d$",
    "ssn": r"^\d{3}-?\d{2}-?\d{4}$",
    "url": r"^https?://[^\s/$.?#].[^\s]*$",
    "ipv4": r"^(\d{1,3}\.){3}\d{1,3}$",
    "date_iso": r"^\d{4}-\d{2}-\d{2}$",
    "uuid": r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
}
# -----------------------------------------------------------------------------


def resolve_pattern(pattern: str) -> str:
    """A rule's ``pattern`` is either one of the names above or a regex."""
    return NAMED_PATTERNS.get(pattern, pattern)
