"""Near copies by comparing all pairs of texts."""

import re


def shingles(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def similar_pairs(rows, similarity=0.8):
    """(id, id, similarity) of all pairs at the similarity; only those that share a shingle are compared."""
    sets, holders = {i: shingles(t) for i, t in rows}, {}
    for i, own in sets.items():
        for s in own or {()}:
            holders.setdefault(s, []).append(i)
    met = {}
    for own in holders.values():
        for n, a in enumerate(own):
            for b in own[:n]:
                met[a, b] = met.get((a, b), 0) + 1
    whole = lambda a, b: len(sets[a]) + len(sets[b])
    return [(a, b, n / (whole(a, b) - n)) for (a, b), n in met.items() if n >= similarity * (whole(a, b) - n) - 1e-9 or not whole(a, b)]


def kept_by_brute_force(rows, similarity=0.8):
    """Ids that stay if all pairs at the similarity are links, and the least of each component stays."""
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b, _ in similar_pairs(rows, similarity):
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {i for i in root if find(i) == i}
