"""Plain Python versions of the queries that SQL can't express, written apart from the operators."""

import re
from itertools import groupby

ASCII_WORD = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")
INVISIBLE = {*range(9), 0x0B, 0x0C, *range(0x0E, 0x20), 0x7F, *range(0x200B, 0x2010), 0x2060, 0xFEFF, 0xAD}


def cleaned(text):
    text = "".join(c for c in text if ord(c) not in INVISIBLE)
    for smart, flat in zip("‘’‚“”„«»–", "'''\"\"\"\"\"-"):
        text = text.replace(smart, flat)
    runs = [(c, len(list(g))) for c, g in groupby(text)]
    text = "".join(c * (5 if n >= 6 and c not in ASCII_WORD and c not in " \t\n\r\f\v" else n) for c, n in runs)
    lines = text.split("\n")
    joined = [lines[0]]
    for line in lines[1:]:
        before = joined[-1]
        if len(before) > 1 and before[-1] == "-" and (before[-2].isalnum() or before[-2] == "_") and line[:1] in set("abcdefghijklmnopqrstuvwxyz"):
            joined[-1] = before[:-1] + line
        else:
            joined.append(line)
    out = []
    for line in joined:
        parts = ["".join(g) if kind else " " if n > 1 else first for kind, g, first, n in ((k, list(h), h0, n) for k, h, h0, n in spaces(line))]
        out.append("".join(parts).rstrip(" \t"))
    return "\n".join(out).strip(" ")


def spaces(line):
    for blank, g in groupby(line, lambda c: c in " \t"):
        own = list(g)
        yield not blank, own, own[0], len(own)


def starts_item(line):
    head = line.lstrip()
    return bool(re.match(r"\d{1,2}[.)]\s|[a-z][.)]\s|\([a-zA-Z0-9]{1,2}\)\s", head + ("\n" if head == line.strip() else "")))


def paragraphs(text, least=80, most=1200):
    units, current = [], []

    def flush():
        if unit := "\n".join(current).strip():
            units.append(unit)
        current.clear()

    for line in (text or "").split("\n"):
        if not line.strip() or starts_item(line):
            flush()
        current.append(line)
    flush()
    merged, pending = [], ""
    for unit in units:
        pending = (pending + " " + unit).strip()
        if len(pending) >= least:
            merged.append(pending)
            pending = ""
    if pending:
        merged = [*merged[:-1], merged[-1] + " " + pending] if merged else [pending]
    out = []
    for p in merged:
        if len(p) <= most:
            out.append(p)
            continue
        held = ""
        ends = [m.end() for m in re.finditer(r"[.!?]\s+(?=[A-Z(])", p)]
        for a, b in zip([0, *ends], [*ends, len(p)]):
            sentence = p[a:b].rstrip() if b < len(p) else p[a:b]
            if held and len(held) + 1 + len(sentence) > most:
                out.append(held.strip())
                held = sentence
            else:
                held = f"{held} {sentence}" if held else sentence
        out.append(held.strip())
    return out


def batches(messages, most):
    """Member numbers of each batch of (role, text)."""
    out = []
    for i, (role, text) in enumerate(messages):
        alone = role == "system"
        fits = out and not alone and out[-1][0] == "body" and out[-1][1] + len(text) <= most
        if fits:
            out[-1] = ("body", out[-1][1] + len(text), [*out[-1][2], i])
        else:
            out.append(("heading" if alone else "body", len(text), [i]))
    return [members for *_, members in out]


def semantic(text):
    short = {"Dr", "Mr", "Mrs", "Ms", "Prof", "Sr", "Jr", "vs", "etc", "No", "Art", "Sec"}
    found, start = [], 0
    for m in re.finditer(r"[.!?]\s+", text):
        word = re.search(r"(\w+)$", text[: m.start()])
        if m[0][0] == "." and word and word[1] in short:
            continue
        found.append(text[start : m.end()].strip())
        start = m.end()
    found.append(text[start:].strip())
    chunks, last = [], set()
    for s in (s for s in found if len(s) > 10):
        words = set(s.lower().split())
        like = len(words & last) / (len(words) * len(last)) ** 0.5 if words and last else 0.0
        if chunks and len(chunks[-1]) + 1 + len(s) <= 1200 and (like >= 0.8 or len(chunks[-1]) <= 100):
            chunks[-1] = chunks[-1] + " " + s
        else:
            chunks.append(s)
        last = words
    return [c for c in chunks if len(c) >= 100]


def without_repeats(line, most=6, exempt=()):
    """Where the tokens begin with a phrase and the same again, the longest such phrase comes out once."""
    tokens, out = line.split(" "), []
    if len(tokens) < 4:
        return line
    while tokens:
        for n in (6, 5, 4, 3, 2) if most == 6 else range(most, 1, -1):
            phrase = " ".join(tokens[:n])
            if 2 * n <= len(tokens) and tokens[:n] == tokens[n : 2 * n] and phrase.strip() and not any(t.lower() in phrase.lower() for t in exempt):
                out, tokens = out + tokens[:n], tokens[2 * n :]
                break
        else:
            out.append(tokens.pop(0))
    return " ".join(out)


def unwrapped(text):
    lines, out = text.split("\n"), []
    for line in lines:
        head = line.strip()
        last = out[-1].rstrip() if out else ""
        opens = head == "" or head[:1].isupper() or head[:1] in "•◦○–—-*·▪▫■□" or re.match(r"\d{1,3}[.)]|\(?[a-z][.)]", head) is not None
        if last == "" or opens or last[-1:] in ".!?।:;…" or last.isupper():
            out.append(line)
        else:
            out[-1] = last + " " + head
    return "\n".join(out)


MARKUP = re.compile(r"<!--.*?-->|<![^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9]*)([^>]*)>", re.S)


def pieces(page):
    """(text, closing, tag, attributes) of a page: the text before each tag, and the tag."""
    import html

    at, hidden = 0, ""
    for m in MARKUP.finditer(page):
        tag = (m[2] or "").lower()
        if hidden and not (m[1] and tag == hidden):
            continue
        yield "" if hidden else html.unescape(page[at : m.start()]), bool(m[1]), tag, m[3] or ""
        at, hidden = m.end(), tag if tag in ("script", "style") and not m[1] else ""
    yield html.unescape(page[at:]), False, "", ""


def inline(page):
    import html

    out = ""
    for text, closing, tag, _ in pieces(page):
        out += html.escape(text, quote=False)
        if tag in ("strong", "em", "u") or tag == "br" and not closing:
            out += f"<{'/' * closing}{tag}>"
    return out


def blocks(page):
    kinds = {"h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "p": "text", "li": "item", "tr": "row", "title": "title"}
    out, kind, held = [], "", ""
    for text, closing, tag, attributes in pieces(page):
        held += text
        if tag in kinds:
            body = " ".join(held.split()).strip(" |")
            if kind and body:
                out.append((kind, body))
            kind, held = "" if closing else kinds[tag], ""
        elif tag == "img" and not closing:
            src = re.search(r"""src\s*=\s*["']?([^"'\s>]*)""", attributes)
            out.append(("image", src[1] if src else ""))
        elif tag in ("td", "th") and not closing:
            held += " | "
    body = " ".join(held.split()).strip(" |")
    return [*out, (kind, body)] if kind and body else out


def terms(pages, most=400):
    """The first spelling of each phrase of capitalised words, in order."""
    seen, out = set(), []
    for page, text in sorted(pages):
        for pos, m in enumerate(re.finditer(r"\b(?:[A-Z][a-z]+|[A-Z]{2,})(?:\s+(?:[A-Z][a-z]+|[A-Z]{2,})){0,3}\b", text or "", re.ASCII)):
            if len(m[0]) >= 3 and m[0].lower() not in seen:
                seen.add(m[0].lower())
                out.append((page, pos, m[0]))
    return out[:most]
