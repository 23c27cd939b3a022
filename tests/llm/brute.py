"""Plain-Python versions of the operators' results, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

SPACES = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def space_words(text):
    return SPACES.findall(text or "")


def base_quality(text):
    text = text or ""
    words = space_words(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if space_words(x)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base_license(text, phrases):
    words = LICENSE_WORD.findall((text or "").translate(LOWER))
    places = []
    for phrase, label in phrases:
        parts = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(parts)] == parts]
    at = [i for i, _ in places]
    labels = ",".join(sorted({label for _, label in places}))
    return len(words), len(places), min(at, default=None), max(at, default=None), labels


ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)


def base_secrets(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    kinds = Counter(k for _, k, _ in spans)
    written = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))
    return kinds[0], kinds[1], kinds[2], hashlib.sha256(written.encode()).hexdigest()


def shingles(text, size=4):
    words = SPACES.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    width = min(size, len(words))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def near_duplicates(rows, size=4, percent=80):
    """doc_id -> (set size, smallest id of the component)."""
    sets = {i: shingles(t, size) for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids, holders = sorted(sets), defaultdict(set)
    for i in ids:
        near = Counter(j for s in sets[i] for j in holders[s])
        for j, both in near.items():
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
        for s in sets[i]:
            holders[s].add(i)
    return {i: (len(sets[i]), root(i)) for i in ids}


def line_dedup(rows, min_words):
    """(doc_id, text) rows in order of age -> list of (text, lines, removed lines)."""
    places = []
    for d, (_, text) in enumerate(rows):
        lines = (text or "").split("\n")
        places.append([(i, x) for i, x in enumerate(lines) if space_words(x)])
    index = defaultdict(list)
    for d, lines in enumerate(places):
        for p, (_, x) in enumerate(lines):
            index[x].append((d, p))
    out = []
    for d, (_, text) in enumerate(rows):
        gone, seq = set(), places[d]
        for p, (_, x) in enumerate(seq):
            best = 0
            for e, q in index[x]:
                if (e, q) >= (d, p):
                    break
                n = 0
                while p + n < len(seq) and q + n < len(places[e]) and seq[p + n][1] == places[e][q + n][1]:
                    n += 1
                best = max(best, n)
            if sum(len(space_words(y)) for _, y in seq[p : p + best]) >= min_words:
                gone.update(i for i, _ in seq[p : p + best])
        kept = "\n".join(x for i, x in enumerate((text or "").split("\n")) if i not in gone) if gone else text
        out.append((kept, len(seq), len(gone)))
    return out
