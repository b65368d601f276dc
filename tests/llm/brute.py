"""Plain Python versions of the operators' results."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def contamination(docs, bench, size=10):
    """{doc_id: (n_words, n_hit, item ids as sorted strings)}"""
    windows = defaultdict(set)
    for item, text in bench:
        w = words(text)
        n = min(size, len(w))
        for p in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[p : p + n])].add(item)
    out = {}
    for doc, text in docs:
        w, hit, items = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for p in range(len(w) - n + 1):
                if (k := tuple(w[p : p + n])) in windows:
                    hit.update(range(p, p + n))
                    items |= windows[k]
        out[doc] = (len(w), len(hit), sorted(str(i) for i in items if i is not None))
    return out


def grams(text, n=5):
    w = words(text)
    return frozenset(tuple(w[p : p + n]) for p in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def roots(ids, links):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, others in links.items():
        for j in others:
            a, b = find(i), find(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_copies(docs, threshold=0.8):
    """{doc_id: (n_links, class_id, group_id, kept)}"""
    sets = {i: grams(t) for i, t in docs}
    holders = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    links = defaultdict(set)
    for i, s in sets.items():
        shared = Counter()
        for g in s:
            shared.update(holders[g])
        links[i] = {j for j, k in shared.items() if j != i and k >= threshold * (len(s) + len(sets[j]) - k) - 1e-9}
    root = roots(sets, links)
    return {i: (len(links[i]), min([i, *(j for j in links[i] if sets[j] == s)]), root[i], root[i] == i) for i, s in sets.items()}


ASSIGN = re.compile(
    r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_secrets(text):
    """(start, kind, end) in the order in which they are listed."""
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def sha256(text):
    return hashlib.sha256(text.encode()).hexdigest()
