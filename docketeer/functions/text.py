"""Text cleaning and classification as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abbreviations that a query is expanded by, in order.
ABBREVIATIONS = {
    "CrPC": "Code of Criminal Procedure", "CPC": "Code of Civil Procedure", "IPC": "Indian Penal Code", "BNS": "Bharatiya Nyaya Sanhita",
    "BNSS": "Bharatiya Nagarik Suraksha Sanhita", "BSA": "Bharatiya Sakshya Adhiniyam", "SC": "Supreme Court", "HC": "High Court", "SLP": "Special Leave Petition",
    "PIL": "Public Interest Litigation", "FIR": "First Information Report", "NI Act": "Negotiable Instruments Act", "IT Act": "Information Technology Act",
    "POCSO": "Protection of Children from Sexual Offences", "DV Act": "Domestic Violence Act", "NDPS": "Narcotic Drugs and Psychotropic Substances", "RTI": "Right to Information",
    "SARFAESI": "Securitisation and Reconstruction of Financial Assets and Enforcement of Security Interest", "NCLT": "National Company Law Tribunal",
    "NCLAT": "National Company Law Appellate Tribunal", "DRT": "Debt Recovery Tribunal", "RERA": "Real Estate Regulatory Authority", "Art": "Article", "Sec": "Section", "S.": "Section",
}
# Patterns of a query's intent, tried in this order.
CONCEPT_INTENT = ("what is", "define", "explain", "meaning of", "concept of", "understanding", "tell me about")
EXAMPLE_INTENT = ("example", "show me", "demonstrate", "illustration", "sample", "case study")
QUESTION_INTENT = ("^how (do|to|can)", "^solve", "^calculate", "^find", "^determine", "practice", "exercise", "problem")
# What a trivial message looks like, and the words that make a short one a legal question.
TRIVIAL = (
    r"^\s*(hi+|hello+|hey+|yo|namaste|namaskar|good\s+(morning|afternoon|evening|night))\b[\s!.?,]*$",
    r"^\s*(thanks|thank\s+you|ty|thx|cheers|ok|okay|okie|got\s+it|noted|cool|nice|great)\b[\s!.?,]*$",
    r"^\s*(bye|goodbye|see\s+you|see\s+ya|talk\s+(later|soon)|catch\s+you\s+later)\b[\s!.?,]*$",
    r"^\s*(how\s+are\s+you|how's\s+it\s+going|what's\s+up|sup)\b[\s!.?,]*$",
)
LEGAL_WORDS = (
    "section", "act", "court", "case", "law", "ipc", "crpc", "bns", "bnss", "bsa", "evidence", "constitution", "article", "writ", "bail", "petition",
    "appeal", "judgment", "judgement", "supreme", "high court",
)
# Domains with a label, and what marks a page as no judgment.
DOMAIN_LABELS = {"livelaw.in": "LiveLaw", "scconline.com": "SCC Online", "barandbench.com": "Bar and Bench"}
BLOG_PATHS, BLOG_TITLES = "/blog|/article|/column|/news|/newsline", "blog|editorial|opinion piece"
# How remarks of a text recognition about an image begin, and the kinds of image placeholders.
IMAGE_REMARKS = (
    r"there\s+is\s+no\s+(readable\s+)?(text|writing)\b", r"this\s+image\s+(contains|shows|depicts|appears)", r"the\s+image\s+(contains|shows|depicts|appears)",
    r"(it|this)\s+appears\s+to\s+be\b", r"in\s+(this|the)\s+image\b", r"no\s+readable\s+(text|content)\b",
)
IMAGE_PLACEHOLDERS = ("stamp", "seal", "image", "logo", "handwritten", "figure", "photo", "picture", "graphic", "sign", "emblem", "signature")
# Quotation marks and dashes with their plain forms.
SMART, PLAIN = "‘’‚“”„«»–", "'''\"\"\"\"\"-"


def first_match_replaced(text: Column, pattern: str, replacement: str) -> Column:
    """The text with only the first match replaced."""
    return F.regexp_replace(text, f"(?s)^(.*?)(?:{pattern})", "$1" + replacement)


def expanded(query: Column) -> Column:
    """Each known abbreviation's first whole-word occurrence, with its full form behind it in brackets."""
    escape = lambda s: s.replace(".", r"\.")
    # an abbreviation that ends in a full stop needs a word right behind it, by the pattern's word boundary
    return reduce(lambda text, item: first_match_replaced(text, rf"\b{escape(item[0])}\b", f"{item[0]} ({item[1]})"), ABBREVIATIONS.items(), query)


def intent(query: Column) -> Column:
    """concept, example, question, or null."""
    lower = F.lower(F.trim(query))
    return F.when(lower.rlike("|".join(CONCEPT_INTENT)), "concept").when(lower.rlike("|".join(EXAMPLE_INTENT)), "example").when(lower.rlike("|".join(QUESTION_INTENT)), "question")


def is_trivial(message: Column) -> Column:
    """Blank, a greeting, or at most three words without a question mark and without a legal word."""
    text = F.trim(message)
    short = (F.size(F.split(text, r"\s+")) <= 3) & ~text.contains("?") & ~F.lower(text).rlike("|".join(LEGAL_WORDS))
    return message.isNull() | (text == "") | text.rlike("(?i)" + "|".join(TRIVIAL)) | short


def domain_label(url: Column) -> Column:
    out = F.lit("Web")
    for domain, label in reversed(DOMAIN_LABELS.items()):
        out = F.when(F.lower(url).contains(domain), label).otherwise(out)
    return out


def is_judgment_page(url: Column, title: Column) -> Column:
    return ~F.lower(url).rlike(BLOG_PATHS) & ~F.lower(title).rlike(BLOG_TITLES)


def plain_quotes(text: Column) -> Column:
    return F.translate(text, SMART, PLAIN)


def without_controls(text: Column) -> Column:
    """Without control characters, line feeds and tabs aside, and without invisible ones."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F​-‏⁠﻿­]", "")


def capped_runs(text: Column) -> Column:
    """Runs of six or more of one symbol, cut to five."""
    return F.regexp_replace(text, r"([^\w\s])\1{5}\1*+", "$1$1$1$1$1")


def dehyphenated(text: Column) -> Column:
    """Words divided at a line's end, joined if they go on in lower case."""
    # one character of the word is enough, and texts without such a line end are left alone in one cheap test
    return F.when(text.contains("-\n"), F.regexp_replace(text, r"(?U)(?<=\w)-\n([a-z])", "$1")).otherwise(text)


def collapsed_spaces(text: Column) -> Column:
    """Single spaces, none at the end of a line."""
    return F.regexp_replace(F.regexp_replace(text, r"[ \t]{2,}", " "), r"(?m)[ \t]++$", "")


def cleaned(text: Column) -> Column:
    """All passes in their order."""
    return F.trim(collapsed_spaces(dehyphenated(capped_runs(plain_quotes(without_controls(text))))))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def safe_filename(title: Column, fallback: str = "Draft", most: int = 200) -> Column:
    """A file name for a title: no characters that file systems refuse, no trailing dots, one .md ending."""
    name = F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), r'[<>:"/\\|?*\x00-\x1f]', ""))
    name = F.regexp_replace(F.regexp_replace(name, r"[. ]+$", ""), r"(?i)\.md$", "")
    name = F.trim(F.left(F.regexp_replace(name, r"[. ]+$", ""), F.lit(most)))
    return F.concat(F.when(name == "", fallback).otherwise(name), F.lit(".md"))


def shortened(text: Column, most: int, marker: str = "...") -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit(marker))).otherwise(text)


def middle_cut(text: Column, most: int, marker: str = "\n[...]\n") -> Column:
    """The first and last halves of what is too long."""
    half = most // 2
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(half)), F.lit(marker), F.right(text, F.lit(half)))).otherwise(text)


def code_fence_stripped(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[a-zA-Z]*\s*", ""), r"\s*```\s*$", ""))


def needs_translation(text: Column) -> Column:
    """Over two characters, three of them letters or digits, and neither an address nor symbols alone."""
    stripped = F.trim(text)
    address = stripped.rlike(r"^[\w.+-]+@[\w.-]+$|^https?://\S+$")
    return (F.length(stripped) > 2) & ~address & (F.length(F.regexp_replace(stripped, r"[^\p{L}\p{N}]", "")) >= 3)


def printable_share(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{M}\p{N}\p{P}\p{S} ]", "")) / F.greatest(F.length(text), F.lit(1))


def is_all_caps(text: Column) -> Column:
    """At least four letters, over 85 % of them capitals."""
    letters = F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    return (letters >= 4) & (F.length(F.regexp_replace(text, "[^A-Z]", "")) / letters > 0.85)


def provider(model: Column) -> Column:
    return F.when(model.startswith("claude"), "anthropic").when(model.rlike("^(gpt|o1|o3|o4)"), "openai").when(model.startswith("gemini"), "google").otherwise("unknown")


def numeric_compact(text: Column) -> Column:
    """At most sixteen digits and marks, a digit among them."""
    return text.rlike(r"^[0-9./,:()\-]{1,16}$") & text.rlike("[0-9]")


def is_image_remark(text: Column) -> Column:
    """Whether a block says something of an image instead of what stands in it, or is a placeholder for one."""
    return text.rlike(r"(?i)^\s*(?:" + "|".join(IMAGE_REMARKS) + ")") | text.rlike(r"(?i)^\s*\[\s*(?:" + "|".join(IMAGE_PLACEHOLDERS) + r")\b")
