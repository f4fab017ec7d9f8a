"""Collections and files: statuses, distinct options, insert-ignore, caches, routing by type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Extensions and their types.
MIME_TYPES = {
    ".pdf": "application/pdf", ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", ".doc": "application/msword",
    ".txt": "text/plain", ".md": "text/markdown", ".html": "text/html", ".json": "application/json", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png",
}
IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".gif", ".bmp", ".tiff", ".webp")
LEAST_CHARS, PAYWALL_CHARS = 100, 200


def extension(path: Column) -> Column:
    """The lower-case extension with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"\.[^./]+$", 0))


def mime_type(path: Column) -> Column:
    """By extension; unknown ones are octet streams."""
    known = F.create_map(*[F.lit(x) for pair in MIME_TYPES.items() for x in pair])
    return F.coalesce(known[extension(path)], F.lit("application/octet-stream"))


def source_type(path: Column) -> Column:
    """pdf, image, or null for what no parser takes; web addresses are refused."""
    ext = extension(path)
    return F.when(F.lower(path).rlike("^https?://"), None).when(ext == ".pdf", "pdf").when(ext.isin(*IMAGE_EXTENSIONS), "image")


def first_long_enough(*candidates: Column, least: int = LEAST_CHARS) -> Column:
    """The first candidate text of at least so many characters."""
    return F.coalesce(*[F.when(F.length(c) >= least, c) for c in candidates])


def cache_key(content: Column, provider: str, output: str, language: Column | None = None, ext: str = "md") -> Column:
    """A content-addressed path: prefix, provider, format, language if any, digest."""
    parts = [F.lit("ocr-cache"), F.lit(provider), F.lit(output)]
    parts += [language] if language is not None else []
    return F.concat(F.concat_ws("/", *parts, F.sha2(content, 256)), F.lit(f".{ext}"))


def cache_split(requests: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Requests with ``hit``: whether the cache has their key."""
    known = cache.select(F.col(key).alias("__key"), F.lit(True).alias("hit")).distinct()
    return requests.join(known, F.col(key) == F.col("__key"), "left").withColumn("hit", F.coalesce("hit", F.lit(False))).drop("__key")


def file_status(chunks: DataFrame) -> DataFrame:
    """Chunks and first indexing of each file."""
    return chunks.groupBy("file_id").agg(F.count("*").alias("n_chunks"), F.min("indexed_at").alias("indexed_at"))


def requested_status(requested: DataFrame, chunks: DataFrame) -> DataFrame:
    """A status for each requested file, found or not."""
    counts = chunks.groupBy("file_id").agg(F.count("*").alias("n"))
    joined = requested.select("file_id").join(counts, "file_id", "left")
    n = F.coalesce("n", F.lit(0)).cast("long")
    return joined.select("file_id", n.alias("n_chunks"), F.when(n > 0, "INDEXED").otherwise("NOT_FOUND").alias("status"))


def insert_ignore(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that an insert would add under a unique key: no old row has it, and one of each new one."""
    return new.join(old.select(*keys), keys, "left_anti").dropDuplicates(keys)


def remove(rows: DataFrame, condition: Column) -> DataFrame:
    """What a deletion leaves; rows for which the condition is null stay."""
    return rows.where(~F.coalesce(condition, F.lit(False)))


def updated(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with the columns that an update gives; nulls leave the old value."""
    changes = new.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    joined = old.join(changes, key, "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else c for c in old.columns])


def layered(*layers: DataFrame) -> DataFrame:
    """``term``, ``translation``: of several glossaries the later ones win."""
    ranked = [layer.select("term", "translation", F.lit(i).alias("layer")) for i, layer in enumerate(layers)]
    rows = ranked[0]
    for more in ranked[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("term").agg(F.max_by("translation", "layer").alias("translation"))
