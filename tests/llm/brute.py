"""Plain Python versions of the operators, to hold their results against."""

import re
from collections import defaultdict
from itertools import combinations


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingle_set(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", fold(text))
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def near_groups(docs, percent):
    """{row index: least doc_id of its component} for (doc_id, text) rows."""
    sets = [shingle_set(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            by[x].append(i)
    for i, j in {p for v in by.values() for p in combinations(v, 2)}:
        both = len(sets[i] & sets[j])
        if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        k = find(i)
        least[k] = min((x for x in (least.get(k), d) if x is not None), default=None)
    return {i: least[find(i)] for i in range(len(docs))}, [len(s) for s in sets]


def window_hits(text, items, width=13):
    """(words, words hit, ids of the items with occurring windows) of one text."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    words, hit, met = re.findall(word, fold(text)), set(), set()
    for name, item in items:
        own = re.findall(word, fold(item))
        n = min(width, len(own))
        if n:
            windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)}
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    met.add(name)
    return len(words), len(hit), sorted(str(x) for x in met if x is not None)


def repeat_cut(texts, depth):
    """(bytes kept, removed runs) of each text, by counting every string of ``depth`` bytes."""
    raw, seen = [(t or "").encode() for t in texts], defaultdict(int)
    for b in raw:
        for i in range(len(b) - depth + 1):
            seen[b[i : i + depth]] += 1
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - depth + 1):
            if seen[b[i : i + depth]] > 1:
                gone[i : i + depth] = b"\1" * depth
        runs = len(re.findall(b"\1+", bytes(gone)))
        out.append((bytes(x for x, g in zip(b, gone) if not g), runs))
    return out


def mix_targets(sizes):
    """{source: target} of {source: words}: weights 3, 1, 2 by code point, null last; 150% of all words shared by weight, what is
    above twice a source's words shared again among the others."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        each = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if each * weight[s] > 2 * sizes[s]}
        if not full:
            return out | {s: each * weight[s] for s in open_}
        out |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    return out


def letter_grams(text):
    """Counts of the one to three letters in a row, by number; words are padded by one blank."""
    low = [c.lower() if len(c.lower()) == 1 else c for c in text or ""]
    words = "".join(c if o.isalpha() else " " for c, o in zip(low, text or "")).split()
    s, out = " " + " ".join(words) + " " if words else "", defaultdict(int)
    code = lambda c: 0 if c == " " else ord(c)
    for c in s:
        if c != " ":
            out[ord(c)] += 1
    for a, b in zip(s, s[1:]):
        out[code(a) << 42 | 0x1FFFFF << 21 | code(b)] += 1
    for a, b, c in zip(s, s[1:], s[2:]):
        if b != " ":
            out[code(a) << 42 | code(b) << 21 | code(c)] += 1
    return out


def languages(known, texts, most=300):
    """(language, score) of each text, by the profiles of known (lang, text)."""
    rank = lambda counts: [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:most]]
    sums = defaultdict(lambda: defaultdict(int))
    for lang, text in known:
        for g, n in letter_grams(text).items():
            sums[lang][g] += n
    profiles = {lang: {g: i for i, g in enumerate(rank(c))} for lang, c in sums.items()}
    out = []
    for t in texts:
        mine = rank(letter_grams(t))
        if not mine:
            out.append(("und", 0.0))
            continue
        away = {lang: sum(abs(p[g] - i) if g in p else most for i, g in enumerate(mine)) for lang, p in profiles.items()}
        best = min(away, key=lambda x: (away[x], x))
        out.append((best, 1 - away[best] / (most * len(mine))))
    return out
