"""Plain-Python counterparts of the operators, for small inputs."""

import re
from collections import Counter, defaultdict
from itertools import combinations

UPPER = {c: c + 32 for c in range(65, 91)}


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}


def near_components(docs):
    """docs: (id, text) pairs; id -> (set size, smallest linked id)."""
    sets = {i: shingle_set(t) for i, t in docs}
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = top(a), top(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in sets}


def base_secrets(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found))


def license_places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
    phrases = [(("mit", "license"), "mit"), (("apache", "license"), "apache"), (("general", "public", "license"), "gpl")]
    starts = [(i, label) for p, label in phrases for i in range(len(words)) if tuple(words[i : i + len(p)]) == p]
    return len(words), len(starts), min((i for i, _ in starts), default=None), max((i for i, _ in starts), default=None), ",".join(sorted({x for _, x in starts}))


def greedy_pieces(word, initial, continuing):
    """Longest match first, or None if the pieces can't spell the word."""
    count, at, pieces = 0, 0, initial
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return None
        count, at, pieces = count + 1, end, continuing
    return count


def top_scores(vectors, k=20):
    """vectors: (id, list) pairs; (query, rank, id, score) rows."""
    import math

    ints = [(i, [math.floor(64 * x) for x in v]) for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in ints:
        if q % 20 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ints if i != q)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def water_filled(sizes, weights=(1, 2, 3), cap=3):
    """sizes in source order; targets by rounds."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    held, total = set(), sum(sizes)
    while True:
        rest = total - sum(cap * sizes[i] for i in held)
        free = [i for i in range(len(sizes)) if i not in held]
        share = {i: w[i] * rest / sum(w[j] for j in free) for i in free}
        over = {i for i in free if share[i] > cap * sizes[i]}
        if not over:
            return [float(cap * sizes[i]) if i in held else share[i] for i in range(len(sizes))]
        held |= over


def grouped(rows, key):
    out = defaultdict(list)
    for row in rows:
        out[key(row)].append(row)
    return out




def secret_links(text, window, access, bare_key, endpoint, scope):
    """Pairs of parts by plain loops: (access, key, endpoint) spans in order."""
    out, at = [], 0
    for part in [*re.split(f"({scope})", text)]:
        spans = {k: [(m.start() + at, m.end() + at) for m in re.finditer(p, part)] for k, p in (("a", access), ("k", bare_key), ("e", endpoint))}
        at += len(part)

        def near(kind, s):
            gap = lambda t: max(s[0], t[0]) - min(s[1], t[1])
            before, after = [t for t in spans[kind] if t[0] < s[0]], [t for t in spans[kind] if t[0] >= s[0]]  # noqa: B023
            few = [*before[-1:], *after[:1]]
            best = min(few, key=gap) if few else None
            return best if best is not None and gap(best) <= window else None

        if spans["a"] and spans["k"]:
            links = [(near("a", k), k, near("e", k)) for k in spans["k"] if near("a", k)]
            links += [(a, near("k", a), near("e", near("k", a))) for a in spans["a"] if near("k", a) and a not in [near("a", k) for k in spans["k"]]]
            out += sorted(links, key=lambda x: (x[0], x[1]))
    return out


def language_scores(filters, module, text):
    """Language and score of one text, n-gram by n-gram."""
    points = [c if chr(c).isalpha() else 0 for c in map(ord, (text or "").lower())]
    if not any(points):
        return "und", 0.0
    padded, mask = [0, *points, 0], (1 << 64) - 1
    hits, total = [0] * len(filters.languages), 0
    for n in module.SIZES:
        for i in range(len(padded) - n + 1):
            gram = padded[i : i + n]
            if not all(gram[1:-1]):
                continue
            h = n
            for c in gram:
                h = ((h ^ c) * int(module._MIX)) & mask
                h ^= h >> 29
            total += 1
            slots = [(h >> (module.SLOT_BITS * j)) & ((1 << module.SLOT_BITS) - 1) for j in range(module.HASHES)]
            for k in range(len(hits)):
                hits[k] += all(int(filters.slots[k // 64, s]) >> (k % 64) & 1 for s in slots)
    share = [min(1.0, max(0.0, (h / max(total, 1) - f) / (1 - f))) for h, f in zip(hits, filters.false_rate.tolist())]
    best = max(range(len(share)), key=lambda k: (share[k], -k))
    return filters.languages[best], share[best] / sum(share) if sum(share) > 0 else 0.0
