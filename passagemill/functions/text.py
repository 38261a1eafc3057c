"""Scalar text functions as Column expressions: whitespace, ids, document types, roles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 29 code points that count as white space.
WHITESPACE = r"[\t\n\x0B\f\r\x1C-\x1F \x85\xA0  -     　]+"

# Runs of white space that are not one plain space, which need no change. Letters are passed over at a glance.
_UNEVEN = r"(?![!-~])(?:[\t-\r\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000][\t-\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]*| [\t-\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+)"

# Document types in the order their rules are tried. Keys of file names are substrings of the lower-cased
# name; keys of urls are whole tokens of the path.
NAME_RULES = (
    ("technical", ("tech", "technical", "architecture", "design")),
    ("schema", ("schema", "tables", "columns", "ddl", "database")),
    ("erd", ("erd", "entity", "diagram", "model")),
    ("functional", ("functional", "business", "requirements", "brd")),
    ("product", ("product", "features", "manual", "documentation", "guide")),
    ("analytics", ("analytics", "kpi", "metric", "dashboard")),
    ("reporting", ("report", "reporting")),
    ("onboarding", ("onboarding", "getting_started", "introduction")),
    ("user_guide", ("user_guide", "help", "how_to", "tutorial")),
    ("api", ("api", "interface", "integration")),
)
URL_EXTRA = {"product": ("docs",), "api": ("swagger", "openapi", "reference")}

# Role names and what they resolve to.
ROLE_ALIASES = {
    "developer": "developer", "dev": "developer", "engineer": "developer", "sql": "developer", "data_engineer": "developer", "data engineer": "developer",
    "ba": "ba", "business_analyst": "ba", "business analyst": "ba", "product_analyst": "ba", "product analyst": "ba",
    "new_joiner": "new_joiner", "new joiner": "new_joiner", "onboarding": "new_joiner", "beginner": "new_joiner",
}
DEFAULT_ROLE = "developer"


def normalize_text(text: Column) -> Column:
    """Runs of white space as one space, none at the ends; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), _UNEVEN, " "))


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty; null if none is."""
    return F.coalesce(*[F.when(c != "", c) for c in columns])


def text_id(text: Column, source: Column, page: Column) -> Column:
    """32 hex digits of the SHA-256 of normalised text, source and page."""
    return normal_id(normalize_text(text), source, page)


def normal_id(text: Column, source: Column, page: Column) -> Column:
    """``text_id`` of a text that is normalised already."""
    said = F.concat(text, F.lit("|"), source, F.lit("|"), F.coalesce(page, F.lit(0)).cast("string"))
    return F.substring(F.sha2(said, 256), 1, 32)


def resolved_source(source: Column, file_name: Column) -> Column:
    return F.coalesce(first_filled(source, file_name), F.lit("unknown"))


def row_id(hash_id: Column, text: Column, source: Column, file_name: Column, page: Column) -> Column:
    """An id that a row brings along, or else the id of its text."""
    return F.coalesce(first_filled(hash_id), text_id(text, resolved_source(source, file_name), page))


def _first_of(rules, test, default: str) -> Column:
    out = F.lit(default)
    for name, keys in reversed(rules):
        out = F.when(test(name, keys), name).otherwise(out)
    return out


def name_type(name: Column) -> Column:
    """A file name's document type."""
    low = F.lower(F.coalesce(name, F.lit("")))

    def test(_: str, keys: tuple[str, ...]) -> Column:
        said = low.contains(keys[0])
        for key in keys[1:]:
            said |= low.contains(key)
        return said

    return _first_of(NAME_RULES, test, "unknown")


def url_type(path: Column) -> Column:
    """The document type that a url's path tells."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(path, F.lit(""))), F.lit("([a-z0-9_]+)"), F.lit(1))
    return _first_of(NAME_RULES, lambda name, keys: F.arrays_overlap(tokens, F.array(*map(F.lit, keys + URL_EXTRA.get(name, ())))), "web")


def resolve_role(role: Column) -> Column:
    said = F.lower(F.trim(F.coalesce(role, F.lit(""))))
    table = F.create_map(*[F.lit(x) for pair in ROLE_ALIASES.items() for x in pair])
    return F.coalesce(table[said], F.lit(DEFAULT_ROLE))


def now_iso() -> Column:
    """The current time in UTC to the second."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
