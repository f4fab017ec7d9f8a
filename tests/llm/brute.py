"""Plain Python versions of what the operators compute."""

import hashlib
import re

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")


def base_spans(text):
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, "access", m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), 2, "hex", m.end()) for m in HEX.finditer(text) if len(m[0]) >= 32]
    return sorted(found)


def linked_spans(text, base, weak, roles, reach):
    """Weak parts with a complementary part in reach, by comparing all pairs; patterns and roles are the operator's."""
    found = [(m.start(), len(base) + i, kind, m.end()) for i, (kind, pattern, group, least) in enumerate(weak) for m in re.finditer(pattern, text, re.ASCII) if (len(set(m[0])) if group < 0 else len(m[group])) >= least]
    parts = base_spans(text) + found
    kept = []
    for start, number, kind, end in found:
        complete = any((roles[k] == "secret") != (roles[kind] == "secret") and s <= end + reach and e >= start - reach for s, _, k, e in parts)
        held = kind == "key" and any(k != "key" and s < end and e > start for s, _, k, e in parts)
        if complete and not held:
            kept.append((start, number, kind, end))
    return kept


def written(spans):
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in sorted(spans))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def shingles(text, words):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not found:
        return []
    return [" ".join(found[i : i + words]) for i in range(len(found) - words + 1)] if len(found) >= words else [" ".join(found)]


def fingerprint(text):
    import xxhash

    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles(text, 3)]
    return sum((sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) << b for b in range(64))


def groups(ids, linked):
    """The least id that each reaches, by comparing all pairs."""
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def distance(pattern, text):
    """Least edits that turn the pattern into a part of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def signed(n):
    return n - (1 << 64) if n >> 63 else n


def chained(values):
    """One hash of a list, as Spark hashes an array: each element's hash is the next one's seed."""
    import xxhash

    h = 42
    for v in values:
        h = xxhash.xxh64(v.encode() if isinstance(v, str) else v.to_bytes(8, "little", signed=True), seed=h).intdigest()
    return h


def imatch(docs, low, high, families, dense):
    """Every text's hashes by lexicon, None where a lexicon has no term of it."""
    import math

    import regex

    words = [set(regex.split(r"[^\p{L}\p{N}]+", t.lower())) - {""} for t in docs]
    df = {}
    for own in words:
        for w in own:
            df[w] = df.get(w, 0) + 1
    least, most = max(2, math.ceil(len(docs) * math.exp(-high))), len(docs) * math.exp(-low)
    band = {w: signed(chained([w])) for w, n in df.items() if least <= n <= most}

    def hashes(text):
        own = set(regex.split(r"[^\p{L}\p{N}]+", text.lower())) - {""}
        terms = sorted(band[w] for w in own if w in band)
        if not terms:
            return [chained(sorted(own, key=str.encode))] + [None] * (sum(n for _, n in families) + dense - 1)
        lexicons = [[t for t in terms if (t >> 11 * i) % parts == j] for i, (parts, n) in enumerate(families) for j in range(n)]
        lexicons += [[t for t in terms if signed(chained_on(t, j)) % 3 > 0] for j in range(dense)]
        return [chained(x) if x else None for x in lexicons]

    return hashes


def chained_on(term, number):
    """A long's hash followed by that of an int."""
    import xxhash

    h = xxhash.xxh64(term.to_bytes(8, "little", signed=True), seed=42).intdigest()
    return xxhash.xxh64(number.to_bytes(4, "little"), seed=h).intdigest()


def likeness(a, b, families):
    if a == b:
        return 1.0
    start, shares = 0, []
    for _, n in families:
        pairs = [(x, y) for x, y in zip(a[start : start + n], b[start : start + n]) if x is not None or y is not None]
        shares.append((len(pairs), sum(x == y for x, y in pairs) / max(1, len(pairs))))
        start += n
    for n, share in shares[:0:-1]:
        if n >= 4:
            return share
    return shares[1][1] if shares[1][0] else 0.0


def greedy(first, inner, word):
    n, i, pieces = 0, 0, first
    while i < len(word):
        j = next((j for j in range(len(word), i, -1) if word[i:j] in pieces), 0)
        if not j:
            return 1
        n, i, pieces = n + 1, j, inner
    return n


def phrases(text, training):
    """Greedy parse of the text into the longest parts that the training text has."""
    n, i = 0, 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in training:
            j += 1
        i = max(i + 1, j - 1)
        n += 1
    return n
