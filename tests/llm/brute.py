"""Brute-force versions that the operators are held against."""

from __future__ import annotations

import re

import numpy as np
import xxhash


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps: dict[int, int], radius=4):
    """doc_id -> smallest reachable doc_id."""
    ids = sorted(fps)
    values = np.asarray([fps[i] for i in ids], np.uint64)
    out, seen = {}, set()
    for k, i in enumerate(ids):
        if i in seen:
            continue
        queue, seen = [k], seen | {i}
        while queue:
            x = queue.pop()
            out[ids[x]] = i
            for y in np.flatnonzero(np.bitwise_count(values ^ values[x]) <= radius):
                if ids[y] not in seen:
                    seen.add(ids[y])
                    queue.append(int(y))
    return out


def hits(text, items, n=10):
    """(words, hit words, sorted item ids as strings)."""
    rule = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    words = re.findall(rule, lower(text))
    mask, found = [False] * len(words), set()
    for item, other in items:
        own = re.findall(rule, lower(other))
        for i in range(max(1, len(own) - n + 1) if own else 0):
            gram = own[i : i + n]
            for at in range(len(words) - len(gram) + 1):
                if words[at : at + len(gram)] == gram:
                    mask[at : at + len(gram)] = [True] * len(gram)
                    found.add(str(item))
    return len(words), sum(mask), sorted(found)


def repeats(docs: dict[int, bytes], width=50):
    """doc_id -> mask of bytes covered by a string that starts in a document with a smaller id."""
    first: dict[bytes, int] = {}
    for i in sorted(docs):
        for at in range(len(docs[i]) - width + 1):
            first.setdefault(docs[i][at : at + width], i)
    out = {}
    for i, text in docs.items():
        mask = np.zeros(len(text), bool)
        for at in range(len(text) - width + 1):
            if first[text[at : at + width]] < i:
                mask[at : at + width] = True
        out[i] = mask
    return out
