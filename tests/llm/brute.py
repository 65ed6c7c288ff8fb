"""Plain restatements of the operators' rules for small inputs."""
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def shingles(text, k=5):
    w = WORD.findall((text or "").translate(FOLD))
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def similar(a, b, percent):
    return bool(a and b) and 100 * len(a & b) >= percent * len(a | b)


def groups(rows, percent):
    """Smallest id of each row's group, rows being (id, text)."""
    sets = [shingles(t) for _, t in rows]
    comp = list(range(len(rows)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if similar(sets[i], sets[j], percent):
                comp[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(d)
    return [(len(sets[i]), min((d for d in ids[find(i)] if d is not None), default=None)) for i in range(len(rows))]


def without_lines(rows, percent):
    """Texts of rows (id, text), in order of id, without lines like an earlier one."""
    seen, out = [], {}
    for d, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        if text is None:
            out[d] = None
            continue
        kept = []
        for line in text.split("\n"):
            s = shingles(line)
            if not any(similar(s, t, percent) for t in seen):
                kept.append(line)
            if s:
                seen.append(s)
        out[d] = "\n".join(kept)
    return out


def item_words(text):
    return ITEM_WORD.findall((text or "").translate(FOLD))


def hit(text, items, size=10):
    """(words, hit words, ids of items with a window in the text)."""
    w, covered, named = item_words(text), set(), set()
    for item, t in items:
        v = item_words(t)
        n = min(size, len(v))
        wins = {tuple(v[i:i + n]) for i in range(len(v) - n + 1)} if v else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i:i + n]) in wins:
                covered.update(range(i, i + n))
                named.add(item)
    return len(w), len(covered), named
