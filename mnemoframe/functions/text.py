"""Tokenizers and text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemoframe.functions.fixed import DOCUMENT_CLASSES, DOCUMENT_TYPES, LOADERS, SECRET_PATTERNS, STOP_WORDS


def word_tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def content_tokens(text: Column) -> Column:
    """Word tokens without stop words."""
    return F.filter(word_tokens(text), lambda t: ~t.isin(*STOP_WORDS))


def recall_tokens(text: Column) -> Column:
    """Distinct runs of letters and digits of at least two bytes, lower case."""
    parts = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.filter(parts, lambda t: F.octet_length(t) >= 2))


def word_count(text: Column) -> Column:
    """White-space separated words."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda t: t != ""))


def collapse(text: Column, most: int | None = None) -> Column:
    one = F.trim(F.regexp_replace(text, r"\s+", " "))
    return one if most is None else F.left(one, F.lit(most))


def redact(text: Column) -> Column:
    """Secrets replaced, six characters of each left."""
    for pattern in SECRET_PATTERNS:
        flag = "(?i)" if pattern.startswith("(?i)") else ""
        text = _redact_one(text, flag, pattern.removeprefix("(?i)"))
    return text


def _redact_one(text: Column, flag: str, body: str) -> Column:
    hits = F.regexp_extract_all(text, F.lit(f"{flag}({body})"), F.lit(1))
    return F.aggregate(hits, text, lambda t, h: F.replace(t, h, F.concat(F.left(h, F.lit(6)), F.lit("***REDACTED***"))))


def fact_display(text: Column, prefix: str = "relationship_name: ") -> Column:
    bare = F.trim(F.when(text.startswith(prefix), F.substring(text, len(prefix) + 1, 1_000_000_000)).otherwise(text))
    return F.concat(F.upper(F.left(bare, F.lit(1))), F.substring(bare, 2, 1_000_000_000))


def scrub(text: Column, most: int) -> Column:
    """Terminal escapes away, control characters to one space, cut."""
    plain = F.regexp_replace(text, "\u001b\\[[0-9;?]*[ -/]*[@-~]", "")
    return F.left(F.trim(F.regexp_replace(plain, r"[\x00-\x1f\x7f]+", " ")), F.lit(most))


def render_prompt(template: Column, question: Column, context: Column) -> Column:
    return F.replace(F.replace(template, F.lit("{question}"), question), F.lit("{context}"), context)


def looks_like_html(text: Column) -> Column:
    return text.rlike(r"<[A-Za-z/]")


def page_title(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def identifier_shaped(name: Column) -> Column:
    """Names that look like a UUID or a hash."""
    return name.rlike(r"(?i)^\s*(?:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|[0-9a-f]{32,})\s*$")


def _lookup(column: Column, groups: dict[str, list[str]], default: str | None) -> Column:
    out = None
    for value, keys in groups.items():
        test = F.lower(column).isin(*keys)
        out = F.when(test, F.lit(value)) if out is None else out.when(test, F.lit(value))
    return out.otherwise(F.lit(default)) if default is not None else out


def loader_name(extension: Column) -> Column:
    return _lookup(extension, LOADERS, "text_loader")


def document_type(extension: Column) -> Column:
    """Null where the extension is not known: such items are skipped."""
    return _lookup(extension, DOCUMENT_TYPES, None)


def document_class(document_type: Column) -> Column:
    return _lookup(document_type, {c: [t for t, k in DOCUMENT_CLASSES.items() if k == c] for c in dict.fromkeys(DOCUMENT_CLASSES.values())}, "Document")


def retrieval_text(edge_text: Column, relationship: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(edge_text), F.lit("")), relationship)


def is_type_edge(relationship: Column, text: Column) -> Column:
    return (F.trim(F.lower(F.translate(relationship, "_-", "  "))) == "is a") | F.coalesce(F.lower(text).contains(" is a "), F.lit(False))
