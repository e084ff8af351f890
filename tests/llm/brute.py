"""The operators' definitions, written plainly."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def base(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    found = words(text)
    seen, dup_lines = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup_lines += line in seen
            seen.add(line)
    grams = Counter(tuple(found[i : i + 3]) for i in range(len(found) - 2))
    repeat = len({j for i in range(len(found) - 2) if grams[tuple(found[i : i + 3])] > 1 for j in range(i, i + 3)})
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    failed = len(found) < 50 or 100 * repeat > 50 * len(found)
    return len(found), sum(map(len, found)), symbols, dup_lines, repeat, failed


def kept_words(docs, size=20):
    """{doc_id: (words, flags of removed words)}; docs are (doc_id, text) with distinct ids."""
    seen, out = set(), {}
    for doc_id, text in sorted(docs):
        found = words(text)
        gone = [False] * len(found)
        for i in range(len(found) - size + 1):
            window = tuple(found[i : i + size])
            if window in seen:
                gone[i : i + size] = [True] * size
            seen.add(window)
        out[doc_id] = found, gone
    return out


def digest(found, gone):
    return hashlib.sha256(" ".join(w for w, g in zip(found, gone, strict=True) if not g).encode()).hexdigest()


def shingles(text):
    found = words(text)
    size = min(5, len(found))
    return Counter(tuple(found[i : i + size]) for i in range(len(found) - size + 1)) if found else Counter()


def probability_jaccard(a, b):
    """Grouped by the ratio of the weights, which is rarely anything but 1 or 2."""
    every = set(a) | set(b)
    total = 0.0
    for ratio, n in Counter((a[d], b[d]) for d in a if d in b).items():
        total += n / sum(max(a[e] / ratio[0], b[e] / ratio[1]) for e in every)
    return total


def classes(docs, threshold=0.8):
    """{doc_id: smallest id of its class}."""
    counts = {i: shingles(t) for i, t in docs}
    where = defaultdict(set)
    for i, c in counts.items():
        for s in c:
            where[s].add(i)
    parent = {i: i for i in counts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    shared = Counter()
    for ids in where.values():
        ids = sorted(ids)
        shared.update((a, b) for k, a in enumerate(ids) for b in ids[k + 1 :])
    for (a, b), n in shared.items():
        if 3 * n < max(len(counts[a]), len(counts[b])):
            continue
        if root(a) != root(b) and probability_jaccard(counts[a], counts[b]) >= threshold:
            high, low = max(root(a), root(b)), min(root(a), root(b))
            parent[high] = low
    return {i: root(i) for i in counts}


def contained(docs, items):
    """{(doc_id, item_id)} with at least four fifths of the item's shingles in the document."""
    out = set()
    for item_id, text in items:
        own = words((text or "").lower())
        size = min(5, len(own))
        grams = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
        for doc_id, doc in docs:
            found = words((doc or "").lower())
            there = {tuple(found[i : i + size]) for i in range(len(found) - size + 1)} if size else set()
            if grams and len(grams & there) >= 0.8 * len(grams):
                out.add((doc_id, item_id))
    return out


def cut_lines(doc_id, text, seed=7, percent=100, spm_percent=50):
    """n, form, prefix_chars, middle_chars, output."""
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    hexed = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexed[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(lines)
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h[3] % 100 < spm_percent:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"
