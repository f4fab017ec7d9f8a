"""English stems (the Snowball project's second Porter stemmer) and stop words, for text search."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from docketeer.functions.batches import by_parts

# The stop words of PostgreSQL's english configuration, in its order.
STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs
    themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as
    until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then
    once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now""".split()
)
# Words that the stemmer's rules don't apply to, words that they stop at after the first step, and prefixes that end before the first region.
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
FINISHED = frozenset("inning outing canning herring earring proceed exceed succeed".split())
PREFIXES = ("gener", "commun", "arsen")
# Suffixes and what takes their place in the first region (steps 2 and 3), and suffixes that go in the second region (step 4).
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al",
    "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()

_REGION = re.compile(r"[aeiouy][^aeiouy]")
_VOWEL = re.compile(r"[aeiouy]")
_SHORT_END = re.compile(r"([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")


def _after(word: str, start: int) -> int:
    """Where the region begins behind the first consonant that follows a vowel."""
    found = _REGION.search(word, start)
    return found.end() if found else len(word)


def _longest(word: str, suffixes: object) -> str:
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a lower-case English word."""
    if len(word) <= 2:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    word = re.sub(r"^y|(?<=[aeiouy])y", "Y", word.removeprefix("'"))
    first = next((len(p) for p in PREFIXES if word.startswith(p)), None)
    first = _after(word, 0) if first is None else first
    second = _after(word, first)

    word = word.removesuffix(_longest(word, ("'", "'s", "'s'")))
    ending = _longest(word, ("sses", "ied", "ies", "us", "ss", "s"))
    if ending == "sses":
        word = word[:-2]
    elif ending in ("ied", "ies"):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif ending == "s" and _VOWEL.search(word[:-2]):
        word = word[:-1]
    if word in FINISHED:
        return word

    ending = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if ending in ("eed", "eedly"):
        if len(word) - len(ending) >= first:
            word = word.removesuffix(ending) + "ee"
    elif ending and _VOWEL.search(word.removesuffix(ending)):
        word = word.removesuffix(ending)
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", word):
            word = word[:-1]
        elif first >= len(word) and _SHORT_END.search(word):
            word += "e"
    if re.search(r".[^aeiouy][yY]$", word):
        word = word[:-1] + "i"

    ending = _longest(word, STEP_2)
    if ending and len(word) - len(ending) >= first:
        before = word.removesuffix(ending)
        if ending == "ogi":
            word = before + "og" if before.endswith("l") else word
        elif ending == "li":
            word = before if before.endswith(tuple("cdeghkmnrt")) else word
        else:
            word = before + STEP_2[ending]
    ending = _longest(word, STEP_3)
    if ending and len(word) - len(ending) >= (second if ending == "ative" else first):
        word = word.removesuffix(ending) + STEP_3[ending]
    ending = _longest(word, STEP_4)
    if ending and len(word) - len(ending) >= second and (ending != "ion" or word[:-3].endswith(("s", "t"))):
        word = word.removesuffix(ending)
    if word.endswith("e"):
        if len(word) > second or (len(word) > first and not _SHORT_END.search(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) > second:
        word = word[:-1]
    return word.lower()


def lexeme(word: str) -> str | None:
    """What a lower-case word counts as in a search: nothing if it is a stop word."""
    return None if word in STOP_WORDS else stem(word)


WORD = r"[\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """The lower-case words of a text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def lexeme_positions() -> Callable[[Column], Column]:
    """A function of an array of words: each lexeme with its places, counted from 1, stop words included in the count."""

    def places(found: list[str] | None) -> list[tuple[str, list[int]]]:
        out: dict[str, list[int]] = {}
        for at, word in enumerate(found if found is not None else (), 1):
            term = lexeme(word)
            if term is not None:
                out.setdefault(term, []).append(at)
        return list(out.items())

    kind = pa.list_(pa.struct([("term", pa.string()), ("positions", pa.list_(pa.int32()))]))
    return by_parts(places, "array<struct<term string, positions array<int>>>", kind)


def query_terms(text: str) -> list[str]:
    """The distinct lexemes of a question."""
    found = re.findall(r"[^\W_]+", text.lower())
    return list(dict.fromkeys(t for t in map(lexeme, found) if t is not None))
