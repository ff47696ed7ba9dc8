"""Plain versions of the operators for small fixtures."""

import hashlib
import random


def words(text):
    return (text or "").encode().split()


def link_components(ids, linked):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(text, size=4):
    w = (text or "").encode().lower().split()
    if len(w) < size:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1))


def ngram_components(docs):
    sets = {i: shingles(t) for i, t in docs}
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    return {i: len(s) for i, s in sets.items()}, link_components(sets, linked)


def removed_words(docs, size=20, texts=False):
    seen, out = set(), {}
    for i, t in sorted(docs):
        w = words(t)
        gone = [False] * len(w)
        for s in range(len(w) - size + 1):
            key = tuple(w[s : s + size])
            if key in seen:
                gone[s : s + size] = [True] * size
            seen.add(key)
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest(), *([kept.decode()] if texts else []))
    return out


def corpus(n=120, seed=1):
    """Made-up documents with exact and near copies, shared passages, repeated lines, empty and null texts."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(400)]
    make = lambda k: [r.choice(vocab) for _ in range(k)]
    passage, base = make(60), make(150)
    docs = []
    for i in range(n):
        kind = i % 10
        w = make(r.randint(1, 200))
        if kind == 1:
            w = w[:40] + passage + w[40:]
        elif kind == 2:
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = r.choice(vocab)
        elif kind == 3 and docs:
            w = (docs[r.randrange(len(docs))][1] or "").split(" ")
        elif kind == 4:
            w = w[:30] * 3
        elif kind == 5:
            w = passage[: r.randint(15, 60)]
        docs.append((i, " ".join(w)))
    docs += [(n, ""), (n + 1, None), (n + 2, " \t\n"), (n + 3, "one two"), (n + 4, "ONE two"), (n + 5, "x" * 50_000), (n + 6, " ".join(make(20_000)))]
    r.shuffle(docs)
    return docs


def level(sizes, share=1.5, epochs=2.0, weights=(5, 2, 1)):
    """Target of each source by clamping and sharing anew until none is above its clamp."""
    order = sorted(k for k in sizes if k is not None) + [k for k in sizes if k is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, free, left = dict.fromkeys(order, 0.0), set(order), share * sum(sizes.values())
    while free:
        unit = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * unit > epochs * sizes[s]}
        if not over:
            for s in free:
                target[s] = weight[s] * unit
            break
        for s in over:
            target[s] = epochs * sizes[s]
        left -= sum(target[s] for s in over)
        free -= over
    return target


def mixed(docs, seed=20240, buckets=4096):
    """How often each of (id, text, source) is taken."""
    size = [len(words(t)) for _, t, _ in docs]
    sizes = {}
    for n, (_, _, s) in zip(size, docs):
        sizes[s] = sizes.get(s, 0) + n
    target, out = level(sizes), [0] * len(docs)
    for s in sizes:
        h = lambda i: int(hashlib.md5(f"{seed}|{'' if i is None else i}".encode()).hexdigest()[:13], 16)
        own = sorted((k for k, d in enumerate(docs) if d[2] == s), key=lambda k: (h(docs[k][0]) % buckets, h(docs[k][0]), docs[k][0] is None, docs[k][0], size[k]))
        whole = int(target[s] // sizes[s]) if sizes[s] else 0
        before = 0
        for k in own:
            out[k] = whole + (size[k] > 0 and before + size[k] / 2 <= target[s] - whole * sizes[s])
            before += size[k]
    return out
