"""Drafts and requests: spelling, amounts, labelled sections, titles, names of cases, limits of services."""

from __future__ import annotations

import re
from functools import reduce
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketeer.functions.substitution import bound, substituted

# Misspellings and what they mean.
SPELLING = {
    "defendent": "defendant", "plantiff": "plaintiff", "planitiff": "plaintiff", "plaintif": "plaintiff", "warantee": "warranty", "warrantee": "warranty",
    "agrrement": "agreement", "agrement": "agreement", "agreemnt": "agreement", "breech": "breach", "liabilty": "liability", "liablity": "liability",
    "indemnificaiton": "indemnification", "indemnfication": "indemnification", "jurisdiciton": "jurisdiction", "juridiction": "jurisdiction", "arbitraiton": "arbitration",
    "arbitartion": "arbitration", "termiantion": "termination", "terminaiton": "termination", "confedential": "confidential", "confidetial": "confidential",
    "represtation": "representation", "representaiton": "representation", "indeminity": "indemnity", "indemniy": "indemnity", "excecution": "execution", "executoin": "execution",
    "afadavit": "affidavit", "affadavit": "affidavit", "affidavid": "affidavit", "petitoner": "petitioner", "petitionor": "petitioner", "respondant": "respondent",
    "responedent": "respondent", "verfication": "verification", "verificaiton": "verification", "notarised": "notarized", "notarized": "notarized", "vakalatnama": "Vakalatnama",
    "vakaltnama": "Vakalatnama", "recieve": "receive", "reciept": "receipt", "occured": "occurred", "occurence": "occurrence", "occurance": "occurrence", "seperate": "separate",
    "seperately": "separately", "accomodation": "accommodation", "acommodation": "accommodation", "harrass": "harass", "harrassment": "harassment", "harassement": "harassment",
    "maintainance": "maintenance", "maintenence": "maintenance", "posession": "possession", "possesion": "possession", "proffesional": "professional", "profesional": "professional",
    "commision": "commission", "comission": "commission", "gurantee": "guarantee", "gaurantee": "guarantee", "calender": "calendar", "calander": "calendar", "refered": "referred",
    "reffered": "referred", "transfered": "transferred", "occassion": "occasion", "ocassion": "occasion", "neccessary": "necessary", "necesary": "necessary",
    "immediatly": "immediately", "imediately": "immediately", "permanant": "permanent", "permenant": "permanent", "acknowlegement": "acknowledgement",
    "acknowledgment": "acknowledgement", "fullfill": "fulfill", "fulfil": "fulfill", "cancelled": "canceled", "untill": "until", "sucessful": "successful", "succesful": "successful",
}
# Amounts and legal terms in their standard form.
AMOUNTS = ((r"(?i)\brs\.?\s*(\d)", "Rs. $1"), (r"(?i)\binr\.?\s*(\d)", "INR $1"))
TERMS = {
    "ipc": "IPC", "crpc": "CrPC", "cpc": "CPC", "bns": "BNS", "bnss": "BNSS", "section 138": "Section 138", "section 420": "Section 420", "section 406": "Section 406",
    "article 226": "Article 226", "article 32": "Article 32",
}
# Kinds of documents and what they call the two parties.
BAIL = ("bail_application", "second_bail_application", "criminal_appeal", "anticipatory_bail", "slp")
COURT = ("affidavit", "petition", "application", "written_statement", "written_arguments", "application_draft", "execution_petition", "revision_petition", "quashing_petition")
NOTICE = ("legal_notice", "demand_notice")
PARTIES = {
    "complaint": ("COMPLAINANT DETAILS", "OPPOSITE PARTY DETAILS"), "bail": ("APPLICANT / APPELLANT DETAILS", "NON-APPLICANT / RESPONDENT (STATE) DETAILS"),
    "court": ("PLAINTIFF / PETITIONER DETAILS", "DEFENDANT / RESPONDENT DETAILS"), "notice": ("SENDER / CLIENT DETAILS", "RECIPIENT DETAILS"), "other": ("FIRST PARTY DETAILS", "SECOND PARTY DETAILS"),
}


BLANKS = " \t\n\r\f\x0b"


def words_replaced(text: Column, words: dict[str, str]) -> Column:
    """Whole words in any case; texts without any are left alone in one test.

    All are found in one pass, by a pattern that branches by letters. What stands for a word is what the rules from its own on make of it, one after the other.
    """
    rules = list(words.items())
    after = lambda i: reduce(lambda t, rule: re.sub(rf"(?i)\b{rule[0]}\b", rule[1], t), rules[i + 1 :], rules[i][1])
    known = F.create_map(*[F.lit(x) for i, (word, _) in enumerate(rules) for x in (word, after(i))])
    any_word = rf"(?i)\b{branching(sorted(words))}\b"
    fixed = lambda t: substituted(t, any_word, lambda m, _: known[F.lower(m)])
    return bound(text, lambda t: F.when(t.rlike(any_word), fixed(t)).otherwise(t))


def branching(words: list[str]) -> str:
    """A pattern of any of the sorted words, in which those that begin alike share their beginning."""
    heads = {head: [w[1:] for w in group] for head, group in groupby(filter(None, words), key=lambda w: w[0])}
    ways = [re.escape(head) + branching(rest) for head, rest in heads.items()]
    return ("(?:" + "|".join(ways) + ")" + ("?" if "" in words else "")) if ways else ""


def standardised(text: Column, hindi: bool = False) -> Column:
    """Spelling, amounts, terms, punctuation and spaces; Hindi keeps its spelling and punctuation."""
    out = text if hindi else words_replaced(text, SPELLING)
    out = reduce(lambda t, rule: F.regexp_replace(t, *rule), AMOUNTS, out)
    out = words_replaced(out, TERMS)
    if not hindi:
        out = F.regexp_replace(out, r"\s+([,;.!?])", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def party_class(kind: Column) -> Column:
    return F.when(kind == "consumer_complaint", "complaint").when(kind.isin(*BAIL), "bail").when(kind.isin(*COURT), "court").when(kind.isin(*NOTICE), "notice").otherwise("other")


def sections(kind: Column, party_one: Column, party_two: Column, **fields: Column) -> Column:
    """The given fields as labelled sections; empty ones are left out."""
    label = lambda i: F.create_map(*[F.lit(x) for name, pair in PARTIES.items() for x in (name, pair[i])])[party_class(kind)]
    parts = [(label(0), party_one), (label(1), party_two), *((F.lit(name.replace("_", " ").upper()), value) for name, value in fields.items())]
    one = lambda name, value: F.when(value.isNotNull() & (value != ""), F.concat(F.lit("=== "), name, F.lit(" ===\n"), value))
    return F.concat_ws("\n\n", *[one(*part) for part in parts])


def session_title(text: Column, most: int = 80) -> Column:
    """A model's title without quotes and trailing dots, cut to a length."""
    bare = F.regexp_replace(F.trim(text), r"^[\"'“”‘’]+|[\"'“”‘’]+$", "")
    return F.left(F.regexp_replace(bare, r"\.+$", ""), F.lit(most))


def search_query(brief: Column) -> Column:
    """The line under the heading "Search Query"."""
    return F.regexp_replace(F.regexp_extract(brief, r"(?i)##\s*Search Query\s*\n+([^\n#]+)", 1), r"^[\s\"'`*]+|[\s\"'`*]+$", "")


def case_type(number: Column) -> Column:
    return F.regexp_extract(number, r"^[A-Z_]+", 0)


def case_title(petitioner: Column, respondent: Column, number: Column) -> Column:
    """Both parties, else the one there is, else the number."""
    p, r = F.nullif(F.trim(petitioner), F.lit("")), F.nullif(F.trim(respondent), F.lit(""))
    return F.coalesce(F.concat(p, F.lit(" vs "), r), p, r, number)


def case_status(text: Column) -> Column:
    return F.when(F.lower(text).contains("disposed"), "CLOSED").when(F.lower(text).contains("pending"), "PENDING").otherwise("ACTIVE")


def label_map(labels: Column, values: Column) -> Column:
    """Lower-case labels without trailing dots; of repeated ones the last counts."""
    clean = F.transform(labels, lambda s: F.regexp_replace(F.lower(F.trim(s)), r"[.:\s]+$", ""))
    last = lambda k, i: ~F.array_contains(F.slice(clean, i + 2, F.greatest(F.size(clean) - i - 1, F.lit(0))), k)
    kept = F.filter(F.arrays_zip(clean.alias("k"), values.alias("v"), F.sequence(F.lit(0), F.size(clean) - 1).alias("i")), lambda e: last(e["k"], e["i"]))
    return F.map_from_entries(F.transform(kept, lambda e: F.struct(e["k"], e["v"])))


def is_rate_limit(error: Column) -> Column:
    return F.lower(error).rlike(r"\b429\b|rate.?limit|resource.?exhausted|too many requests|quota")


def retry_after(error: Column) -> Column:
    """Seconds that an error asks to wait."""
    return F.nullif(F.regexp_extract(F.lower(error), r"(?:retry(?:ing)?[ _-]?(?:after|in|delay)\D{0,5})(\d+(?:\.\d+)?)", 1), F.lit("")).cast("double")


def original_name(path: Column) -> Column:
    """A file's name without the random identifier before it."""
    name = F.substring_index(path, "/", -1)
    return F.regexp_replace(name, r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}_", "")


def stored_path(url: Column) -> Column:
    """Where a stored file is: the scheme of local storage goes, percent signs are decoded."""
    return F.when(url.startswith("local://"), F.url_decode(F.substring(url, 9, 1 << 20))).otherwise(F.url_decode(url))


def markdown_table(rows: Column) -> Column:
    """An array of rows of cells as a Markdown table; the first row is its head, short rows are filled."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    cell = lambda c: F.replace(F.trim(F.coalesce(c, F.lit(""))), F.lit("|"), F.lit("/"))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    full = lambda r: F.concat(F.transform(r, cell), F.array_repeat(F.lit(""), width - F.size(r)))
    lines = F.transform(rows, lambda r: line(full(r)))
    return F.concat_ws("\n", F.get(lines, F.lit(0)), line(F.array_repeat(F.lit("---"), width)), F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), "\n"))


def assembled(draft: Column, title: Column, parts: Column) -> Column:
    """The draft, or, where it is blank, its sections (order, title, content) under the title; null if there is no content at all."""
    filled = F.filter(F.array_sort(parts), lambda s: F.btrim(s["content"], F.lit(BLANKS)) != "")
    body = F.array_join(F.transform(filled, lambda s: F.concat(F.lit("## "), s["title"], F.lit("\n"), F.btrim(s["content"], F.lit(BLANKS)))), "\n\n---\n\n")
    head = F.when(F.btrim(title, F.lit(BLANKS)) != "", F.concat(F.lit("# "), title, F.lit("\n\n"))).otherwise("")
    return F.when(F.btrim(draft, F.lit(BLANKS)) != "", draft).otherwise(F.when(F.size(filled) > 0, F.concat(head, body)))


def rewrite_input(draft: Column, claims: Column, shown: int = 500) -> Column:
    """A draft and the report of its verified claims (supported, type, text, url, snippet), as a model gets them to rewrite it."""

    def one(c: Column, i: Column) -> Column:
        lines = [
            F.concat(F.lit("## Claim "), (i + 1).cast("string"), F.when(c["supported"], " — SUPPORTED").otherwise(" — NOT SUPPORTED")),
            F.concat(F.lit("- Type: "), c["type"]), F.concat(F.lit("- Claim text: "), c["text"]),
            F.when(c["url"] != "", F.concat(F.lit("- Supporting URL: "), c["url"])),
            F.when(c["snippet"] != "", F.concat(F.lit("- Supporting snippet: "), F.left(c["snippet"], F.lit(shown)))), F.lit(""),
        ]
        return F.concat_ws("\n", *lines)

    return F.concat_ws("\n", F.lit("# DRAFT\n"), draft, F.lit("\n# VERIFICATION REPORT\n"), F.transform(claims, one))
