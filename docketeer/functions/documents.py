"""Documents as a whole: their type, headings, clean-up of model output, sentinels, requests, rendered blocks."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from docketeer.functions import translation
from docketeer.functions.substitution import local_units, protected, restored, substituted

# What marks a book's or a chapter's first page, and how much of it is needed.
BOOK = (r"\bedition\b", r"\bisbn[\s\-:]*\d", r"\bcopyright\s+©?\s*\d{4}", r"\bpublished\s+by\b", r"\b(?:university|academic)\s+press\b")
CHAPTER = r"(?im)^chapter\s+\d+|^ch\.?\s*\d+|^\d+\.\s+[A-Z]"
LEAST_BOOK, LEAST_REFERENCES, CHAPTER_LINES, BOOK_BYTES = 2, 3, 5, 5 * 1024 * 1024
# Words in headings of examples and of questions.
EXAMPLE_HEADINGS = "example|sample|worked|demonstration|illustration|case study"
QUESTION_HEADINGS = "exercise|problem|question|checkpoint|practice|review|test yourself"
# Abbreviations that end no sentence, and the sizes of semantic chunks.
ABBREVIATIONS = ("Dr", "Mr", "Mrs", "Ms", "Prof", "Sr", "Jr", "vs", "etc", "No", "Art", "Sec")
SEMANTIC_LEAST, SEMANTIC_MOST, SEMANTIC_SIMILARITY, SENTENCE_LEAST = 100, 1200, 0.8, 10
# Names of requests' fields.
FOLDER_ID = "^[a-zA-Z0-9_-]+$"


def content_type(text: Column, size: Column) -> Column:
    """BOOK by size or two marks of a title page or three chapter references, CHAPTER by its first lines, else DOCUMENT."""
    lower = F.lower(text)
    marks = sum((F.when(lower.rlike(p), 1).otherwise(0) for p in BOOK), F.lit(0))
    head = F.array_join(F.slice(F.split(text, "\n"), 1, CHAPTER_LINES), "\n")
    book = (size > BOOK_BYTES) | (marks >= LEAST_BOOK) | (F.regexp_count(lower, F.lit(r"chapter\s+\d+")) >= LEAST_REFERENCES)
    return F.when(book, "BOOK").when(head.rlike(CHAPTER), "CHAPTER").otherwise("DOCUMENT")


def header_kind(title: Column) -> Column:
    """example, question or concept, by words in a heading."""
    lower = F.lower(title)
    return F.when(lower.rlike(EXAMPLE_HEADINGS), "example").when(lower.rlike(QUESTION_HEADINGS), "question").otherwise("concept")


def chapter_number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(?i)\bchapter\s+(\d+)", 1), F.lit("")).cast("int")


def without_latex(text: Column) -> Column:
    """Bullets, text macros and dollar signs of LaTeX made plain, other macros removed."""
    out = F.regexp_replace(text, r"(?m)^(\s*)\$\\(?:circ|bullet|cdot)\$\s*", "$1- ")
    out = F.regexp_replace(F.regexp_replace(out, r"\\text\{([^}]*)\}", "$1"), r"\$([^$\n]*)\$", "$1")
    return F.regexp_replace(out, r"\\[a-zA-Z]+(?![a-zA-Z])", "")


def without_reasoning(text: Column) -> Column:
    """A model's reply without its thoughts, document markers and fence lines."""
    out = F.regexp_replace(text, r"(?is)<think(?:ing)?>.*?</think(?:ing)?>", "")
    out = F.regexp_replace(out, r"-{2,}\s*(?:BEGIN|END)\s+DOCUMENT\s*-{2,}", "")
    return F.regexp_replace(F.regexp_replace(out, r"(?m)^```\w*\s*$\n?", ""), r"^\s+|\s+$", "")


def valid_folder(folder: Column) -> Column:
    return F.coalesce(folder.rlike(FOLDER_ID), F.lit(False))


def filled(fields: Column) -> Column:
    """The entries of a map that are neither null nor blank."""
    return F.map_filter(fields, lambda _, v: v.isNotNull() & (F.trim(v) != ""))


def merged(old: Column, new: Column) -> Column:
    """A map with the new one's entries over it; nulls among those leave the old values."""
    given = F.map_filter(new, lambda _, v: v.isNotNull())
    kept = F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(given), k))
    return F.map_concat(kept, given)


def long_enough(text: Column, least: int = 500) -> Column:
    return F.length(F.trim(text)) >= least


def span_html(spans: Column) -> Column:
    """Spans (text, bold, italic) as inline HTML with what is special escaped."""
    escape = lambda t: F.replace(F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    wrap = lambda t, on, tag: F.when(on, F.concat(F.lit(f"<{tag}>"), t, F.lit(f"</{tag}>"))).otherwise(t)
    return F.array_join(F.transform(spans, lambda s: wrap(wrap(escape(s["text"]), s["italic"], "em"), s["bold"], "strong")), "")


def block_style(x0: Column, y0: Column, width_mm: float = 210.0, height_mm: float = 297.0) -> Column:
    """The position of a block in millimetres."""
    mm = lambda v, size: F.format_string("%.2fmm", F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) * size)
    return F.concat(F.lit("left:"), mm(x0, width_mm), F.lit(";top:"), mm(y0, height_mm))


def party_block(name: Column, age: Column, role: Column, ordinal: Column, side_size: Column) -> Column:
    """A party of a cause title: what is missing has a placeholder; ordinals stand only where a side has several."""
    label = F.when(side_size > 1, F.concat(role, F.lit(" No. "), ordinal.cast("string"))).otherwise(role)
    who = F.coalesce(F.nullif(F.trim(name), F.lit("")), F.lit("[Party Name]"))
    return F.concat(who, F.coalesce(F.concat(F.lit(", Age: "), age.cast("string")), F.lit("")), F.lit(" ... "), label)


def with_cause_title(body: Column, title: Column) -> Column:
    """The draft behind its cause title, once."""
    start, end = F.lit("<!-- cause-title:start -->"), F.lit("<!-- cause-title:end -->")
    return F.when(body.startswith("<!-- cause-title:start -->"), body).otherwise(F.concat(start, title, end, F.lit("\n\n"), body))


def freeze(text: Column, terms: dict[str, str]) -> Column:
    """A struct of the text with glossary terms, longest first, as numbered sentinels, and the translation that each stands for (``held``)."""
    whole = F.coalesce(text, F.lit(""))
    names = sorted({t.lower() for t in terms if t}, key=lambda t: (-len(t), t))
    if not names:
        return F.struct(whole.alias("text"), F.array().cast("array<string>").alias("held"))
    pattern = r"(?iuU)\b(?:" + "|".join(map(quoted, names)) + r")\b"
    known = F.create_map(*[F.lit(x) for t, v in terms.items() for x in (t.lower(), v)])
    held = F.transform(F.regexp_extract_all(whole, F.lit(pattern), F.lit(0)), lambda m: known[F.lower(m)])
    return F.struct(substituted(whole, pattern, lambda _, i: F.format_string("[__%04d__]", i)).alias("text"), held.alias("held"))


def quoted(term: str) -> str:
    """A term as a pattern of itself, for Java."""
    return re.sub(r"([^\w\s])", r"\\\1", term)


def restore(text: Column, held: Column) -> Column:
    """Sentinels replaced, however a translator spaced them; those without a meaning are removed."""
    own = lambda n, _: F.coalesce(F.get(held, n.cast("int")), F.lit(""))
    return substituted(F.coalesce(text, F.lit("")), r"\[?\s*_\s*_\s*(\d{4})\s*_\s*_\s*\]?", own, group=1)


def sentences(text: str | None, least: int = SENTENCE_LEAST) -> list[str]:
    """Sentences of over ``least`` characters; known abbreviations end none."""
    guarded = re.sub(r"\b(" + "|".join(ABBREVIATIONS) + r")\.", "\\1\0", text or "")
    return [s for part in re.split(r"(?<=[.!?])\s+", guarded) if len(s := part.replace("\0", ".").strip()) > least]


def word_similarity(a: str, b: str) -> float:
    """A stand-in for the similarity of two sentences' embeddings: the cosine of their word sets."""
    x, y = set(a.lower().split()), set(b.lower().split())
    return len(x & y) / (len(x) * len(y)) ** 0.5 if x and y else 0.0


def semantic_chunks(text: str | None) -> list[str]:
    """Sentences in chunks that end where the next is unlike the last, or would exceed the size; small ends are dropped."""
    out: list[str] = []
    last = ""
    for sentence in sentences(text):
        fits = out and len(out[-1]) + 1 + len(sentence) <= SEMANTIC_MOST
        alike = out and word_similarity(last, sentence) >= SEMANTIC_SIMILARITY
        if fits and (alike or len(out[-1]) <= SEMANTIC_LEAST):
            out[-1] += " " + sentence
        else:
            out.append(sentence)
        last = sentence
    return [c for c in out if len(c) >= SEMANTIC_LEAST]


def translated(text: Column, terms: dict[str, str], translate: Callable[[Column], Column]) -> Column:
    """A text through a translator: cleaned, its tags and glossary terms kept out, translated, and all put back; amounts in lakh and crore."""
    clean = translation.rejoined_words(translation.without_private_glyphs(text))
    bound = lambda value, body: F.transform(F.array(value), body)[0]  # noqa: E731  # computed once, however often it stands there
    frozen = lambda p: bound(freeze(p["text"], terms), lambda f: restored(restore(translate(f["text"]), f["held"]), p["tags"]))
    return local_units(bound(protected(clean), frozen))
