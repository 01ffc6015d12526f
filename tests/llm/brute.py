"""Plain versions of the operators, for small tables."""

import hashlib
from collections import Counter, defaultdict

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def _key(doc_id):
    return -(1 << 63) if doc_id is None else doc_id


def removed_bytes(rows, window=100):
    """doc -> (n_bytes, n_removed, n_spans, hash), in order of id."""
    seen, out = {}, {}
    for doc, text in sorted(rows, key=lambda r: _key(r[0])):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - window + 1):
            if seen.setdefault(data[p : p + window], (_key(doc), p)) < (_key(doc), p):
                gone[p : p + window] = b"\1" * window
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out[doc] = (len(data), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(data, gone) if not g)).hexdigest())
    return out


def removed_words(rows, window=50):
    seen, out = {}, {}
    for doc, text in sorted(rows, key=lambda r: _key(r[0])):
        words = (text or "").encode().split()
        gone = [0] * len(words)
        for p in range(len(words) - window + 1):
            if seen.setdefault(b" ".join(words[p : p + window]), _key(doc)) < _key(doc):
                gone[p : p + window] = [1] * window
        out[doc] = (len(words), sum(gone), hashlib.sha256(b" ".join(w for w, g in zip(words, gone) if not g)).hexdigest())
    return out


def removed_lines(rows, strong):
    """doc -> (n_lines, n_removed, hash).  From each line on, the longest stretch of lines (blank
    ones apart) that an earlier start also has goes, with blank lines inside, if its lines have
    ``strong`` characters in all."""
    rows = sorted(rows, key=lambda r: _key(r[0]))
    lines = [[(i, x) for i, x in enumerate(t.split("\n")) if x.strip(" \t\r\x0b\x0c")] if t else [] for _, t in rows]
    starts = defaultdict(list)
    out = {}
    for d, own in enumerate(lines):
        gone = set()
        for p, (line_no, x) in enumerate(own):
            longest = 0
            for e, q in starts[x]:
                k = 0
                while p + k < len(own) and q + k < len(lines[e]) and own[p + k][1] == lines[e][q + k][1]:
                    k += 1
                longest = max(longest, k)
            if sum(len(own[p + k][1]) for k in range(longest)) >= strong:
                gone.update(range(line_no, own[p + longest - 1][0] + 1))
            starts[x].append((d, p))
        text = rows[d][1] or ""
        all_lines = text.split("\n") if text else []
        out[rows[d][0]] = (len(all_lines), len(gone), hashlib.sha256("\n".join(x for i, x in enumerate(all_lines) if i not in gone).encode()).hexdigest())
    return out


def near_classes(rows, n=5, percent=80):
    """doc -> (set size, least doc of its class)."""
    sets = {}
    for doc, text in rows:
        words = (text or "").encode().translate(_LOWER).split()
        sets[doc] = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set())
    least = {d: d for d in sets}

    def top(d):
        while least[d] != d:
            d = least[d]
        return d

    docs = sorted(sets, key=_key)
    for i, a in enumerate(docs):
        for b in docs[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)), key=_key)
                least[y] = x
    return {d: (len(sets[d]), top(d)) for d in sets}


def text_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    words = text.encode().split()
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(5)}
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), dup, len(hit), len(words) < 10 or 100 * len(hit) > 20 * len(words)
