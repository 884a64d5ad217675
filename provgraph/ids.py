"""Content-addressed ids: a prefix and the SHA-256 of the parts joined by ``|``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def content_id(prefix: str, *parts: str | Column) -> Column:
    """``prefix:`` + hex digest; null parts count as empty."""
    joined = F.concat_ws("|", *(F.coalesce(_column(p).cast("string"), F.lit("")) for p in parts))
    return F.concat(F.lit(f"{prefix}:"), F.sha2(joined, 256))


def doc_id(content: str | Column) -> Column:
    """``sha256:`` + hex digest of the raw bytes."""
    return F.concat(F.lit("sha256:"), F.sha2(_column(content), 256))


def edge_id(subject: str | Column, predicate: str | Column, obj: str | Column, *span: str | Column) -> Column:
    """Edges are addressed by their ends, and by their first span where they aren't aggregated."""
    return content_id("edge", subject, predicate, obj, *span)


def chunk_id(doc: str | Column, start: str | Column, end: str | Column, breadcrumb: str | Column) -> Column:
    return content_id("chunk", doc, start, end, F.concat_ws("/", _column(breadcrumb)))


def claim_id(subject: str | Column, predicate: str | Column, obj: str | Column, *span: str | Column) -> Column:
    return content_id("claim", subject, predicate, obj, *span)


def conflict_id(subject: str | Column, predicate: str | Column, objects: str | Column) -> Column:
    return content_id("conflict", subject, predicate, F.concat_ws("|", _column(objects)))


def entity_id(kind: str | Column, normal_name: str | Column, prefix: str = "entity") -> Column:
    return F.concat_ws(":", F.lit(prefix), _column(kind), _column(normal_name))


def span_hash(content: str | Column, start: str | Column, end: str | Column) -> Column:
    """SHA-256 of a half-open byte range; null for a range outside the bytes."""
    raw, a, b = _column(content).cast("binary"), _column(start).cast("int"), _column(end).cast("int")
    inside = (a >= 0) & (a <= b) & (b <= F.octet_length(raw))
    return F.when(inside, F.sha2(F.substring(raw, a + 1, b - a), 256))
