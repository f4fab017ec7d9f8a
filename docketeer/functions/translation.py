"""Around a translator: what must not change is masked, and its output is put right."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable, Iterable
from functools import reduce
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from docketeer.functions.batches import by_parts, of_texts
from docketeer.functions.substitution import substituted

# What stays in English, in the order of masking, and the marks that stand for it.
KEPT = (r"https?://\S+", r"[\w.+-]+@[\w.-]+\.\w+", r"\b[A-Z][A-Za-z]{0,7}[./][A-Z0-9./]{1,15}\b", r"\b\d{4,}\b")
MARK = re.compile(r"__KEEP_\d+__")
# Digits of both scripts, and vowel signs that begin no word.
DEVANAGARI, WESTERN = "०१२३४५६७८९", "0123456789"
DEPENDENT = "़ािीुूृॄॅॆेैॉॊोौ्ँंः"
ALLOWED_TAGS = ("strong", "em", "u", "br")
# Countries, labels of offices, and words of addresses in Hindi, in the order of replacement.
COUNTRIES = ((r"(?U)\bU\.S\b\.?", "अमेरिकी"), (r"(?U)\bU\.K\b\.?", "ब्रिटेन"), (r"(?U)\bE\.U\b\.?", "यूरोपीय संघ"))
OFFICE_LABELS = ((r"(?U)\bDIN-", "डीआईएन-"), (r"(?U)\bF\.\s*NO\.?[-:\s]", "फा.सं.-"), (r"(?U)\bF\.\s*No\.?[-:\s]", "फा.सं.-"))
ADDRESSES = ((r"प्लॉट\s*नं\.?", "प्लॉट संख्या"), (r"बैंक\s*खाता\s*नं\.?", "बैंक खाता संख्या"), (r"मकान\s*नं\.?", "मकान संख्या"))
# What no edit may touch.
SENTINEL = re.compile(r"\[__(?:SEP_|VTAG_|STITCH_)?\d{4}__\]")

BLOCKS = pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string())]))


def mask_english(text: Column) -> Column:
    """A struct of the text with numbered marks, and what each stands for (``kept``); equal substrings share one. No pattern finds anything in a mark."""
    state = F.struct(F.coalesce(text, F.lit("")).alias("text"), F.array().cast("array<string>").alias("kept"))
    for pattern in KEPT:
        state = F.transform(F.array(state), _masking(pattern))[0]
    return state


def _masking(pattern: str) -> Callable[[Column], Column]:
    def step(state: Column) -> Column:
        found = F.array_distinct(F.regexp_extract_all(state["text"], F.lit(pattern), F.lit(0)))
        return F.struct(state["text"].alias("text"), F.concat(state["kept"], F.array_except(found, state["kept"])).alias("kept"))

    def marked(state: Column) -> Column:
        number = lambda m, _: F.concat(F.lit("__KEEP_"), (F.array_position(state["kept"], m) - 1).cast("string"), F.lit("__"))
        return F.struct(substituted(state["text"], pattern, number).alias("text"), state["kept"].alias("kept"))

    return lambda state: F.transform(F.array(step(state)), marked)[0]


def restore_english(text: Column, kept: Column) -> Column:
    """Marks without an original stay, so that a check can find them."""
    known = lambda n: F.get(kept, n.cast("int"))
    return substituted(F.coalesce(text, F.lit("")), r"__KEEP_(\d{1,9})__", lambda n, _: F.coalesce(known(n), F.concat(F.lit("__KEEP_"), n, F.lit("__"))), group=1)


def leftover_marks(text: Column) -> Column:
    return text.rlike(r"__KEEP_\d+__")


def nfc(text: Column) -> Column:
    """Composed characters; ASCII texts, which have none to compose, don't go to Python."""
    return F.coalesce(of_texts(lambda t: unicodedata.normalize("NFC", t))(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def western_digits(text: Column) -> Column:
    return F.translate(text, DEVANAGARI, WESTERN)


def spaced(text: Column) -> Column:
    """No space before a danda, comma or full stop, one behind a danda."""
    out = F.regexp_replace(F.regexp_replace(text, r"\s+।", "।"), r"।(?=[^\s।])", "। ")
    return F.regexp_replace(out, r"\s+([,.])(?=\s|$)", "$1")


def rejoined_words(text: Column) -> Column:
    """Words that an extraction divided before a dependent vowel sign, however often: what is on both sides of a space doesn't change when it goes."""
    return F.regexp_replace(text, f"(?<=[ऀ-ॿ]) (?=[{DEPENDENT}])", "")


def script_spaces(text: Column) -> Column:
    """A space where Latin and Devanagari letters touch."""
    return F.regexp_replace(F.regexp_replace(text, "([A-Za-z])([ऀ-ॿ])", "$1 $2"), "([ऀ-ॿ])([A-Za-z])", "$1 $2")


def without_private_glyphs(text: Column) -> Column:
    return F.regexp_replace(text, "[\\x{E000}-\\x{F8FF}]", "")


def collapsed(line: str, most: int, exempt: tuple[str, ...] = ()) -> str:
    """A line in which a phrase of two to ``most`` tokens that is repeated at once stands once; the longest counts, and reading goes on behind both.

    A phrase that holds an exempt term, whatever its case, stays. How far the line repeats itself at each distance is found for all places
    beforehand, so a long line takes time in proportion.
    """
    tokens = line.split(" ")
    n = len(tokens)
    if n < 4 or len(set(zip(tokens, tokens[1:]))) == n - 1:  # what is repeated has two neighbours that occur again
        return line
    number = {t: i for i, t in enumerate(dict.fromkeys(tokens))}
    ids = np.array([number[t] for t in tokens])
    longest = np.zeros(n, np.int64)  # the largest distance at which a phrase of as many tokens is repeated
    for k in range(2, min(most, n // 2) + 1):
        same = ids[:-k] == ids[k:]
        if np.count_nonzero(same) < k:
            continue
        differs = np.flatnonzero(np.append(~same, True))
        until = differs[np.searchsorted(differs, np.arange(n - k + 1))] - np.arange(n - k + 1)
        longest[: n - k + 1][until >= k] = k
    stays = lambda phrase: not phrase.strip() or any(t in phrase.lower() for t in exempt)
    out: list[str] = []
    at = 0
    while at < n:
        spans = (k for k in range(longest[at], 1, -1) if tokens[at : at + k] == tokens[at + k : at + 2 * k] and not stays(" ".join(tokens[at : at + k])))
        span = next(spans, 0)
        out += tokens[at : at + (span or 1)]
        at += 2 * span or 1
    return " ".join(out)


def without_repeats(text: Column, most: int = 6, exempt: Iterable[str] = ()) -> Column:
    """Each line without phrases of two to ``most`` tokens that are repeated at once, but for those with a term of the glossary."""
    terms = tuple(sorted({t.lower() for t in exempt if t}))
    return of_texts(lambda t: "\n".join(collapsed(line, most, terms) for line in t.split("\n")))(text)


def without_echoes(text: Column, exempt: Iterable[str] = ()) -> Column:
    """The same for Hindi output, whose echoes are up to twenty tokens long; only terms of one word are exempt."""
    return without_repeats(text, 20, [t for t in exempt if len(t.split()) <= 1])


def devanagari_digits(text: Column) -> Column:
    """Numbers with a Devanagari letter or digit at most three characters away in Devanagari digits; others, as in addresses and citations, stay."""
    number = r"(?<!\p{Nd})\p{Nd}++"
    near = f"(?<=[ऀ-ॿ][\\s\\S]{{0,2}}){number}|{number}(?=[\\s\\S]{{0,2}}[ऀ-ॿ])"
    return substituted(text, near, lambda n, _: F.translate(n, WESTERN, DEVANAGARI))


def reported(text: Column, passes: list[tuple[str, str, str]]) -> Column:
    """A struct of the text after all passes (name, pattern, replacement) and a map of how many matches each of them replaced."""
    state = F.struct(text.alias("text"), F.create_map().cast("map<string,int>").alias("report"))
    for one in passes:
        state = F.transform(F.array(state), _after(*one))[0]
    return state


def _after(name: str, pattern: str, replacement: str) -> Callable[[Column], Column]:
    def step(state: Column) -> Column:
        found = F.coalesce(F.size(F.regexp_extract_all(state["text"], F.lit(pattern), F.lit(0))), F.lit(0))
        report = F.map_concat(state["report"], F.create_map(F.lit(name), found))
        return F.struct(F.regexp_replace(state["text"], pattern, replacement).alias("text"), report.alias("report"))

    return step


def rejoined(text: str) -> str:
    """Lines that belong to one paragraph on one line: the first doesn't end a sentence and the next starts no item, title or capital."""
    out: list[str] = []
    for line in text.split("\n"):
        head = line.strip()
        before = out[-1].rstrip() if out else ""
        starts = not head or re.match(r"[•◦○–—\-*·▪▫■□]|\d{1,3}[.)]|\(?[a-z][.)]", head) or head[0].isupper()
        if before and not starts and before[-1] not in ".!?।:;…" and not before.isupper():
            out[-1] = f"{before} {head}"
        else:
            out.append(line)
    return "\n".join(out)


def rejoined_lines(text: Column) -> Column:
    return of_texts(rejoined)(text)


class _Inline(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in ("script", "style")
        if tag in ALLOWED_TAGS:
            self.out.append(f"<{tag}>")

    def handle_endtag(self, tag: str) -> None:
        self.hidden -= tag in ("script", "style") and self.hidden > 0
        if tag in ALLOWED_TAGS and tag != "br":
            self.out.append(f"</{tag}>")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.out.append(html.escape(data, quote=False))


def inline_html(fragment: str) -> str:
    """A fragment with a few inline tags and no others; scripts go with their content."""
    parser = _Inline()
    parser.feed(fragment)
    parser.close()
    return "".join(parser.out)


def sanitised(fragment: Column) -> Column:
    return of_texts(inline_html)(fragment)


class _Blocks(HTMLParser):
    """Headings, paragraphs, list items, images and table rows of a page."""

    KINDS = {"h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "p": "text", "li": "item", "tr": "row", "title": "title"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, str]] = []
        self.kind, self.text, self.hidden = "", "", 0

    def close_block(self) -> None:
        body = re.sub(r"\s+", " ", self.text).strip(" |")
        if self.kind and body:
            self.blocks.append((self.kind, body))
        self.kind, self.text = "", ""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in ("script", "style")
        if tag in self.KINDS:
            self.close_block()
            self.kind = self.KINDS[tag]
        elif tag == "img":
            self.blocks.append(("image", dict(attrs).get("src") or ""))
        elif tag in ("td", "th"):
            self.text += " | "

    def handle_endtag(self, tag: str) -> None:
        self.hidden -= tag in ("script", "style") and self.hidden > 0
        if tag in self.KINDS:
            self.close_block()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.text += data


def blocks_of(page: str | None) -> list[dict[str, str]]:
    parser = _Blocks()
    parser.feed(page or "")
    parser.close()
    parser.close_block()
    return [{"kind": k, "text": t} for k, t in parser.blocks]


def html_blocks(page: Column) -> Column:
    return by_parts(blocks_of, "array<struct<kind string, text string>>", BLOCKS)(page)


def edited(text: str, edits: list[tuple[int, int, str]]) -> str:
    """The text with those edits that lie in it and touch neither a mark nor an edit before them; of equal starts the first given."""
    marks = [m.span() for pattern in (MARK, SENTINEL) for m in pattern.finditer(text)]
    parts, done = [], 0
    for start, end, new in sorted(edits, key=lambda e: e[0]):
        free = all(end <= a or b <= start for a, b in marks)
        if free and done <= start <= end <= len(text):
            parts += [text[done:start], new]
            done = end
    return "".join(parts) + text[done:]


def with_edits(text: Column, edits_json: Column) -> Column:
    """A text with the edits of a JSON list of {span: [start, end], replacement}; malformed ones count as none."""
    given = F.from_json(edits_json, "array<struct<span:array<int>,replacement:string>>")
    whole = F.filter(given, lambda e: (F.size(e["span"]) == 2) & (F.get(e["span"], F.lit(0)) >= 0) & (F.get(e["span"], F.lit(1)) >= F.get(e["span"], F.lit(0))) & e["replacement"].isNotNull())
    of = lambda t, edits: None if t is None else edited(t, [(e["start"], e["end"], e["new"]) for e in edits or []])
    return by_parts(of, "string", pa.string())(text, F.transform(whole, lambda e: F.struct(e["span"][0].alias("start"), e["span"][1].alias("end"), e["replacement"].alias("new"))))


def curled(text: str) -> str:
    """Paired quotation marks as curly ones where both stand by a Devanagari character, within two outside or three inside."""
    near = re.compile("[ऀ-ॿ]").search
    parts, done = [], 0
    for m in re.finditer('"([^"]{1,500})"', text):
        a, b = m.span()
        sides = (text[max(0, a - 2) : a] + m[1][:3], m[1][-3:] + text[b : b + 2])
        if all(map(near, sides)):
            parts.append(f"{text[done:a]}“{m[1]}”")
            done = b
    return "".join(parts) + text[done:]


def devanagari_quotes(text: Column) -> Column:
    """Curly quotation marks in Hindi; only texts with both a mark and a Devanagari character go to Python."""
    return F.coalesce(of_texts(curled)(F.when(text.contains('"') & text.rlike("[ऀ-ॿ]"), text)), text)


def country_names(text: Column) -> Column:
    return reduce(lambda t, rule: F.regexp_replace(t, *rule), COUNTRIES, text)


def office_labels(text: Column) -> Column:
    """Labels and addresses of government documents."""
    return reduce(lambda t, rule: F.regexp_replace(t, *rule), OFFICE_LABELS + ADDRESSES, text)
