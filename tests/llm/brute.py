"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def byte_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[p : p + length] for b in raw for p in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def word_repeats(texts, length):
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[p : p + length]) for w in words for p in range(len(w) - length + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for p in range(len(w) - length + 1):
            if seen[tuple(w[p : p + length])] > 1:
                gone[p : p + length] = [True] * length
        out.append((len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g).encode())))
    return out


def shingles(text, size):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[p : p + size]) for p in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def near_components(rows, size, percent):
    """(id, text) with distinct ids -> id: (set size, component)."""
    sets, parent = {i: shingles(t, size) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def text_statistics(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    seen, gone = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)), [False] * len(w)
    for i in range(len(w) - 4):
        if seen[tuple(w[i : i + 5])] > 1:
            gone[i : i + 5] = [True] * 5
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), sum(gone)


def kept_lines(rows, window):
    """(id, text) in order -> the texts with later runs cut."""
    first, out = {}, []
    for _, t in sorted(rows):
        lines = (t or "").split("\n")
        gone = [False] * len(lines)
        for p in range(len(lines) - window + 1):
            if not first.setdefault(tuple(lines[p : p + window]), (t, p)) == (t, p):
                gone[p : p + window] = [True] * window
        out.append("\n".join(x for x, g in zip(lines, gone) if not g))
    return out


def robust_distances(x, rules):
    """Squared distance of each row of x to its minimum-covariance-determinant estimate; rules: the constants."""
    import numpy as np

    n, dim = x.shape
    floors = np.array(list(rules.FLOORS.values()))
    width = floors / rules.BINS
    sort = np.sort(np.floor(x / width), axis=0)
    low, middle, high = ((sort[int(np.ceil(n * s)) - 1] + 0.5) * width for s in (0.25, 0.5, 0.75))
    scale = np.sqrt(((high - low) / 1.349) ** 2 + floors**2)
    scatter = lambda y: y.T @ y / len(y) - np.outer(y.mean(0), y.mean(0))
    bounded = scatter(np.tanh((x - middle) / scale))
    starts = [(middle, np.diag(scale**2)), (middle, np.outer(scale, scale) * bounded + np.diag(floors**2)), (x.mean(0), scatter(x) + np.diag(floors**2))]
    squared = lambda m, c: np.einsum("ij,ij->i", (x - m) @ np.linalg.inv(c), x - m)
    volume = lambda c: np.linalg.slogdet(c)[1]
    best = None
    for m, c in starts:
        for _ in range(rules.STEPS):
            b, before = np.floor(np.log(squared(m, c) + rules.NEAREST) * rules.BINS), volume(c)
            near = x[b <= np.sort(b)[int(np.ceil(n * rules.SHARE)) - 1]]
            m, c = near.mean(0), scatter(near) * rules.CONSISTENT + np.diag(floors**2)
            if before - volume(c) <= rules.SETTLED:
                break
        if best is None or volume(c) < volume(best[1]):
            best = m, c
    return squared(*best)


def quality_kept(rows, rules):
    """(lang, source, text) of each document -> whether the quality rules keep it."""
    import math

    import numpy as np

    facts = [text_statistics(t) for _, _, t in rows]
    x = np.array([[math.log(w + 1), math.log((c + 5) / (w + 1)), math.log(1 + 100 * s / (c + 1)), r / (w + 1), d / (d + 10)] for w, c, s, d, r in facts])
    groups = [(a or "", b or "") for a, b, _ in rows]
    size, tongue = Counter(groups), Counter(a for a, _ in groups)
    pool = [(a if tongue[a] >= rules.LEAST else "*", b if size[a, b] >= rules.LEAST else "*") for a, b in groups]
    out = [w >= 10 and 100 * r <= 20 * w for w, _, _, _, r in facts]
    for name in set(pool):
        inside = np.array([(name[0] in ("*", a)) and (name[1] in ("*", b)) for a, b in groups])
        distance = np.zeros(len(rows))
        distance[inside] = robust_distances(x[inside], rules)
        for i, p in enumerate(pool):
            out[i] = out[i] and (p != name or distance[i] <= rules.CUT)
    return out


def nearest_votes(vectors, labelled, labels, neighbours, sharpness, prior):
    """Similarity-weighted share of label 1 among each vector's nearest labelled ones."""
    out = []
    for x in vectors:
        near = sorted(((sum(a * b for a, b in zip(x, y)), i) for i, y in enumerate(labelled)), reverse=True)[:neighbours]
        weights = [max(0.0, s) ** sharpness for s, _ in near]
        out.append(sum(w * labels[i] for w, (_, i) in zip(weights, near)) / sum(weights) if sum(weights) else prior)
    return out


def common(a, b):
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], max(row[j], row[j - 1], last + 1 if x == y else 0)
    return row[-1]


PUNCTUATION = str.maketrans({chr(c): " " for c in range(33, 127) if not chr(c).isalnum()})


def held_items(text, items, copy, paraphrase, answer, answer_share):
    """(certainly held, possibly held) items of (id, text): by the words around every place of the text.

    An item is certainly held if a stretch of the item's own length and a little has the common
    subsequence, possibly if the surroundings of four times its length have it.
    """
    words = WORD.findall((text or "").translate(LOW).translate(PUNCTUATION))
    sure, maybe, have = set(), set(), Counter(words)
    for name, body in items:
        item = WORD.findall((body or "").translate(LOW).translate(PUNCTUATION))
        n = len(item)
        if not n or sum((Counter(item) & have).values()) < paraphrase * n:
            continue

        def held(around):
            share = common(item, around) / n
            tail = item[-answer:]
            return share >= copy or share >= paraphrase and common(tail, around) >= answer_share * len(tail)

        if held(words):
            for begin in range(0, max(1, len(words) - n // 2), max(1, n // 4)):
                if name not in maybe and held(words[max(0, begin - 2 * n) : begin + 3 * n]):
                    maybe.add(name)
                if held(words[begin : begin + n + max(2, n // 4)]):
                    sure.add(name)
                    maybe.add(name)
                    break
    return sure, maybe


def tree_shard(hash64, key, tree):
    """Descends a tree of (region, rack, shard, weight) by the least -ln(u) / weight."""
    import math

    path, level = "", tree
    for depth in range(3):
        weights = {}
        for node in level:
            weights[str(node[depth])] = weights.get(str(node[depth]), 0.0) + node[3]
        names = sorted(weights)
        draws = [(-math.log(((hash64(f"{path}/{name}", key) >> 11) + 0.5) / (1 << 53)) / weights[name], i) for i, name in enumerate(names)]
        name = names[min(draws)[1]] if len(names) > 1 else names[0]
        level, path = [node for node in level if str(node[depth]) == name], f"{path}/{name}"
    return level[0][2]


def kept_passages(rows, window, words):
    """(id, text) in order -> id: the text without later runs of ``window`` lines, or fewer with so many words or a whole text."""
    first, kept = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        lines = (t or "").split("\n")
        gone = [False] * len(lines)
        for span in range(1, window + 1):
            for p in range(len(lines) - span + 1):
                run = tuple(lines[p : p + span])
                n = len(WORD.findall(" ".join(run)))
                if first.setdefault(run, (i, p)) != (i, p) and (span == window or n >= words or len(lines) == span and n):
                    gone[p : p + span] = [True] * span
        kept[i] = "\n".join(x for x, g in zip(lines, gone) if not g)
    return kept
