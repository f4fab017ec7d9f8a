"""Citations, identity numbers, placeholders and the kinds of legal paragraphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shapes of case-law citations, in order.
CITATIONS = (
    r"(?i)\(\s*\d{4}\s*\)\s*\d+\s+SCC\s+\d+",
    r"(?i)\bAIR\s+\d{4}\s+(?:SC|Del|Bom|Cal|Mad|Kar|Guj|Ker|All|Raj|Pat|Ori)\s+\d+",
    r"\b[A-Z][A-Za-z.&\-' ]{2,60}\s+v(?:s|\.)?\s+[A-Z][A-Za-z.&\-' ]{2,60}",
    r"(?i)\(\s*\d{4}\s*\)\s*SCC\s+OnLine\s+\w+\s+\d+",
)
YEAR = r"\b((?:19|20)\d{2})\b"
# Names of cases, and numbers of articles and sections. A party is all of a run of words: a search begins only where a run does and
# never gives a word back, so a long text without punctuation takes time in proportion.
CASE_NAME = r"(?i)\b(?<![A-Z]{2}\s{1,20})([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*+)\s+v\.?\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*+)\s*(?:\((\d{4})\))?"
STATUTE = r"(?i)(?:Article|Art\.|Section|Sec\.)\s+(\d+[A-Z]?(?:\([a-z]\))?)"
# Unfilled places in a draft.
BRACKET, MUSTACHE, LINE, WORDS = r"\[[A-Z][A-Za-z][A-Za-z \-/]{1,38}\](?!\()", r"\{\{[^}]{1,60}\}\}", "_{4,}", r"(?i)\b(?:XXXX|TBD|TO BE FILLED|TO BE DECIDED|NOT PROVIDED|INSERT HERE)\b"
EXTERNAL = r"(?i)^\[to be \w+(?:\s+\w+)*\s+by\s+\w+"
CAUSE_TITLE = "(?s)<!-- cause-title:start -->.*?<!-- cause-title:end -->"
# Identity numbers, grouped, or after a keyword on the line.
GROUPED_ID, KEYWORD_ID = r"\b\d{4}[- ]\d{4}[- ](\d{4})\b", r"(?i)(aadhaar|आधार|uid|uidai)([^\n]{0,40}?)\b\d{8}(\d{4})\b"
# Words that tell the kind of a paragraph.
PREAMBLE = r"(?im)^(?:whereas\b|to\s*:|from\s*:|subject\s*:|f\.?no\.?\s*:|ref\.?\s*:|sir\s*,|dear\b)"
DEFINITION = r"(?i)\b(?:means|includes|shall mean|defined as|refers to|is defined)\b"
PROVISION = r"(?i)\b(?:shall|must|hereby|pursuant|notwithstanding|in accordance|herein|therein|thereof)\b"
NUMBERED = r"^\s*\d{1,2}[.)]\s"
DIAGRAM = r"(?i)\b(?:figure|diagram|graph|chart|illustration|fig\.)"


def all_matches(text: Column, *patterns: str) -> Column:
    """The trimmed distinct matches, pattern by pattern in order of place."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in patterns])
    return F.array_distinct(F.filter(F.transform(found, lambda s: F.trim(s)), lambda s: s != ""))


def citations(text: Column) -> Column:
    return all_matches(text, *CITATIONS)


def statutes(text: Column) -> Column:
    """The numbers of articles and sections, in order of place."""
    return F.regexp_extract_all(text, F.lit(STATUTE), F.lit(1))


def case_names(text: Column) -> Column:
    """Names of cases with their year, in order of place."""
    return F.transform(F.regexp_extract_all(text, F.lit(CASE_NAME), F.lit(0)), lambda s: F.trim(s))


def first_year(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, YEAR, 1), F.lit("")).cast("int")


def placeholders(text: Column, most: int = 20) -> Column:
    """Unfilled places outside the cause title; what another authority is to fill is none."""
    scoped = F.regexp_replace(text, CAUSE_TITLE, "")
    found = all_matches(scoped, BRACKET, MUSTACHE, LINE, WORDS)
    return F.slice(F.filter(found, lambda s: ~s.rlike(EXTERNAL)), 1, most)


def mask_identity(text: Column) -> Column:
    """Identity numbers with all but the last four digits masked."""
    return F.regexp_replace(F.regexp_replace(text, GROUPED_ID, "XXXX-XXXX-$1"), KEYWORD_ID, "$1$2XXXX-XXXX-$3")


def identity_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(GROUPED_ID)) + F.regexp_count(F.regexp_replace(text, GROUPED_ID, "XXXX-XXXX-$1"), F.lit(KEYWORD_ID))


def paragraph_kind(text: Column) -> Column:
    return F.when(text.rlike(PREAMBLE), "preamble").when(text.rlike(DEFINITION), "definition").when(text.rlike(PROVISION), "provision").when(text.rlike(NUMBERED), "provision").otherwise("concept")


def key_terms(text: Column, most: int = 10) -> Column:
    """Quoted and title-case phrases, in alphabetical order so that the choice is fixed."""
    quoted = F.regexp_extract_all(text, F.lit('"([^"]+)"'), F.lit(1))
    titled = F.regexp_extract_all(text, F.lit(r"(?<!^)([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)"), F.lit(1))
    return F.slice(F.array_sort(F.array_distinct(F.concat(quoted, titled))), 1, most)


def grounded(citations: Column, corpus: Column) -> Column:
    """The citations that the corpus doesn't contain."""
    return F.filter(citations, lambda c: ~F.contains(corpus, c))


def role(text: Column) -> Column:
    """What kind of row a cause list's line is."""
    rules = (("judge", r"(?i)\b(?:hon'?ble|justice)\b"), ("registrar", r"(?i)\bregistrar\b"), ("hall", r"(?i)court\s+hall"), ("hearing", r"(?i)\bhearing\b"), ("versus", r"(?i)^\s*vs?\.?\s*$"))
    return reduce(lambda out, rule: F.when(text.rlike(rule[1]), rule[0]).otherwise(out), reversed(rules), F.lit("entry"))
