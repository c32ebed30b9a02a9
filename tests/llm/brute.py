"""Plain versions of operators, for small tables."""

from collections import Counter

from spendloom.llm import neardup


def shingles(text):
    words = (text or "").encode().split()
    if not words:
        return []
    seen = Counter()
    out = []
    for k in range(max(1, len(words) - 4)):
        s = tuple(words[k : k + 5])
        seen[s] += 1
        out.append((s, seen[s]))
    return out


def rising(values):
    """Length of the longest rising chain, the slow way."""
    best = []
    for k, v in enumerate(values):
        best.append(1 + max((best[j] for j in range(k) if values[j] < v), default=0))
    return max(best, default=0)


def similarity(a, b):
    at = {s: k for k, s in enumerate(b)}
    aligned = rising([at[s] for s in a if s in at])
    return aligned / (len(a) + len(b) - aligned) if a or b else 1.0


def classes(texts):
    """Class number of every text, over all pairs."""
    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            common = len(set(sets[i]) & set(sets[j]))
            close = sets[i] == sets[j] == [] or common and 9 * common >= 4 * (len(sets[i]) + len(sets[j]))
            if close and (not sets[i] or similarity(sets[i], sets[j]) >= neardup.FOUR / neardup.FIVE):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(k) for k in range(len(texts))]
