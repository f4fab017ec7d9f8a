"""Payloads of points as variants: fields by dotted path, wrapped or not, of the type asked for or null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The fields that are filtered by, with their types, in order.
FIELDS = {
    "metadata.collection_id": "string", "metadata.file_id": "string", "metadata.source_type": "string", "metadata.chunk_type": "string",
    "metadata.hierarchy_level": "int", "metadata.page_number": "int", "document_id": "string",
}
WRAPPERS = ("payload", "point")


def payload(text: Column) -> Column:
    """The variant of a JSON text; null if it is none."""
    return F.try_parse_json(text)


def field(value: Column, path: str, kind: str = "string", wrappers: tuple[str, ...] = WRAPPERS) -> Column:
    """The value at a dotted path, also where the object is wrapped in another; null if it is missing or can't be of the type."""
    at = lambda p: F.try_variant_get(value, F.lit("$." + p), kind)
    return F.coalesce(at(path), *[at(f"{w}.{path}") for w in wrappers])


def flat(points: DataFrame, column: str = "payload") -> DataFrame:
    """The points with each field as a column, named by the last part of its path."""
    return points.withColumns({p.rpartition(".")[2]: field(F.col(column), p, kind) for p, kind in FIELDS.items()}).drop(column)


def scrolled(points: DataFrame, limit: int | None = None, column: str = "payload", **wanted: object) -> DataFrame:
    """The points whose fields equal the wanted values (``metadata__file_id`` for ``metadata.file_id``), the first by id if there is a limit."""
    for name, value in wanted.items():
        path = name.replace("__", ".")
        points = points.where(field(F.col(column), path, FIELDS.get(path, "string")) == F.lit(value))
    return points if limit is None else points.orderBy("id").limit(limit)
