"""Plain versions of the operators for small tables, one pair or window at a time."""

import hashlib
from collections import Counter, defaultdict

import numpy as np


def words(text):
    return text.encode().split() if text else []


def substring(texts, window):
    """(n_words, n_removed, sha256 of kept words) of each text."""
    all_words = [words(t) for t in texts]
    seen = Counter(b" ".join(w[i:i + window]) for w in all_words for i in range(len(w) - window + 1))
    out = []
    for w in all_words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[b" ".join(w[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def groups(n, links):
    """The smallest linked member of each of n members."""
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def jaccard(rows, n=5, threshold=0.8):
    """(id, class_id, n_links) of rows (id, text)."""
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append({tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    holders = defaultdict(list)
    for i, grams in enumerate(sets):
        for g in grams:
            holders[g].append(i)
    links = []
    for i, grams in enumerate(sets):
        common = Counter(j for g in grams for j in holders[g] if j > i)
        links += [(i, j) for j, k in common.items() if k >= threshold * (len(grams) + len(sets[j]) - k) - 1e-9]
    label, count = groups(len(rows), links), Counter(x for link in links for x in link)
    ids = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        if key is not None:
            ids[label[i]].append(key)
    return [(key, min(ids[label[i]], default=None), count[i]) for i, (key, _) in enumerate(rows)]


def embeddings(rows, threshold=0.93):
    """(id, n_links, component_id, kept) of rows (id, vector, label)."""
    usable = [
        v is not None and label is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)
        for _, v, label in rows
    ]
    unit = [np.asarray(v, float) / np.linalg.norm(np.asarray(v, float)) if ok else None for (_, v, _), ok in zip(rows, usable)]
    links = [
        (i, j) for i in range(len(rows)) for j in range(i + 1, len(rows))
        if usable[i] and usable[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold
    ]
    label, count = groups(len(rows), links), Counter(x for link in links for x in link)
    least = defaultdict(list)
    for i, row in enumerate(rows):
        least[label[i]].append(row[0])
    return [(row[0], count[i], min(least[label[i]]), row[0] == min(least[label[i]])) for i, row in enumerate(rows)]


def unigram(token, score, unknown):
    """Pieces of the best segmentation of a byte string."""
    best = [(0.0, 0)]
    for end in range(1, len(token) + 1):
        options = [(best[end - 1][0] + score.get(token[end - 1:end], unknown), best[end - 1][1] - 1)]
        options += [(best[i][0] + score[token[i:end]], best[i][1] - 1) for i in range(end - 1) if token[i:end] in score]
        best.append(max(options))
    return -best[-1][1]
