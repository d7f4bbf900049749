"""Plain Python versions of the operators, for small inputs."""

import math
from collections import Counter, defaultdict


def words(text):
    return [w for w in __import__("re").split("[ \t\n\r\x0b\x0c]+", text or "") if w]


def in_order(rows):
    """(doc_id, text) rows by doc_id, then text, nulls last."""
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, (r[1] or "").encode()))


def word_states(rows, n):
    """For each row in order: its words, and 0, 1 or 2 for each word."""
    docs = [(d, t, words(t)) for d, t in in_order(rows)]
    seen, first = Counter(), {}
    for r, (_, _, w) in enumerate(docs):
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            seen[k] += 1
            first.setdefault(k, (r, i))
    out = []
    for r, (d, t, w) in enumerate(docs):
        state = [0] * len(w)
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            if seen[k] > 1:
                v = 1 if first[k] == (r, i) else 2
                for j in range(i, i + n):
                    state[j] = max(state[j], v)
        out.append((d, t, w, state))
    return out


def repeated_spans(rows, n):
    out = []
    for d, _, w, state in word_states(rows, n):
        i = 0
        while i < len(w):
            j = i
            while j < len(w) and state[j] == state[i]:
                j += 1
            if state[i]:
                out.append((d, i, j, state[i] == 2))
            i = j
    return out


def without_repeats(rows, n):
    """(doc_id, words left) in order."""
    return [(d, [x for x, s in zip(w, state) if s != 2]) for d, _, w, state in word_states(rows, n)]


def shingles(text, n=3):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def near_groups(rows, threshold=0.6, n=3):
    """group by row number of all rows with a doc_id and words: {row: least doc_id}."""
    live = [(i, d, shingles(t, n), tuple(words(t))) for i, (d, t) in enumerate(rows) if d is not None and words(t)]
    parent = {i: i for i, *_ in live}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(live)):
        for b in range(a):
            (i, _, s, w), (j, _, u, v) = live[a], live[b]
            if w == v or len(s & u) / len(s | u) >= threshold:
                parent[root(i)] = root(j)
    by = defaultdict(list)
    for i, d, *_ in live:
        by[root(i)].append((d, i))
    return {i: min(d for d, _ in g) for g in by.values() if len(g) > 1 for _, i in g}


def repetition(text, lengths):
    w = words(text)
    chars = sum(map(len, w))
    out = {}
    for n in lengths:
        seen, dup = set(), set()
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            if k in seen:
                dup.update(range(i, i + n))
            seen.add(k)
        out[n] = sum(len(w[i]) for i in dup) / chars if chars else 0.0
    lines = [x for x in (text or "").split("\n") if x]
    seen, dup = set(), 0
    for x in lines:
        dup += len(x) if x in seen else 0
        seen.add(x)
    return out, dup / sum(map(len, lines)) if lines else 0.0


def template(text):
    """Tokens with their kinds: (word in lower case, kind, whether a capital opens a sentence)."""
    import re

    from lexspan.llm import decontaminate as d

    out, last = [], 0
    for m in re.finditer(r"\d+(?:[.,]\d+)*|[^\W\d_]+", text or ""):
        word, low = m[0], m[0].lower()
        opens = not out or re.search(r"[.!?:\n]", text[last : m.start()]) is not None
        number = word[0].isdigit() or low in d.NUMBER_WORDS
        unit = bool(out) and out[-1][1] == "number" and low in d.UNITS
        capital = word[0].isupper()
        kind = "number" if number else "unit" if unit else "name" if capital and not opens else None
        out.append((low, kind, capital and opens and not unit and not number, capital))
        last = m.end()
    return out


def leaks(docs, items, window=8, share=0.5, least=20):
    """{(doc_id, item_id): tokens covered} of pairs over the share, without
    occurrences that words were put into or left out of.  Values that fit equally
    often go by their hash, as there."""
    import numpy as np

    from lexspan.llm import _text as tx
    from lexspan.llm import decontaminate as d

    def code(value):
        raw = value[1].encode()
        h = int(tx.word_hash(np.frombuffer(raw + bytes(16), np.uint8), np.array([0]), np.array([len(raw)]))[0]) & ~3 | {"number": d.NUMBER, "name": d.NAME, "unit": d.UNIT}[value[0]]
        return h - (1 << 64) if h >> 63 else h

    def windows(tokens, n):
        for at in range(len(tokens) - n + 1):
            w = tokens[at : at + n]
            for opened in (False, True):
                kinds = ["name" if opened and o else k for _, k, o, _ in w]
                if opened and not any(o for *_, o, _ in w):
                    continue
                if sum(k is None for k in kinds) >= min(d.MIN_LITERALS, n):
                    yield at, ("t", *(k or low for k, (low, *_) in zip(kinds, w))), [(k, low) if k else None for k, (low, *_) in zip(kinds, w)]
            plain = sum(k != "number" and not c and low not in d.UNITS for low, k, _, c in w)
            if n < window or plain < min(d.MIN_LITERALS, n):
                yield at, ("v", *(low for low, *_ in w)), [None] * n

    out = {}
    for item, text in items:
        mine = template(text)
        if item is None or not mine:
            continue
        n = min(window, len(mine))
        have = defaultdict(list)
        for at, key, slots in windows(mine, n):
            if key[0] == "v" or len(mine) >= d.MIN_ITEM:
                have[key].append((at, slots))
        for doc, said in docs:
            met = defaultdict(list)
            for there, key, slots in windows(template(said), n):
                for at, own in have[key]:
                    met[there - at].append((at, own, slots))
            best = 0
            for group in [*met.values(), [w for g in met.values() for w in g]]:
                pairs = Counter((a, b) for _, own, theirs in group for a, b in zip(own, theirs) if a)
                to, taken = {}, {}
                for (a, b), _ in sorted(pairs.items(), key=lambda x: (-x[1], code(x[0][0]), code(x[0][1]))):
                    if a not in to and (b[0] != "name" or taken.get(b, a) == a):
                        to[a] = b
                        taken[b] = a
                fits = [at for at, own, theirs in group if own == theirs or all(to.get(a) == b for a, b in zip(own, theirs) if a)]
                best = max(best, len({k for at in fits for k in range(at, at + n)}))
            if best and (best >= share * len(mine) or best >= least):
                out[doc, item] = best
    return out


def kneser_ney(texts, order):
    """P(word | context) by definition; words of a text with marks around it."""
    seqs = [["<s>"] * (order - 1) + words(t) + ["</s>"] for t in texts if words(t)]
    counts = {order: Counter(tuple(s[i : i + order]) for s in seqs for i in range(len(s) - order + 1))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    disc, total, follow = {}, {}, {}
    for k, c in counts.items():
        n = [sum(v == x for v in c.values()) for x in (1, 2, 3, 4)]
        d = [0.5, 1.0, 1.5]
        if all(n):
            y = n[0] / (n[0] + 2 * n[1])
            e = [i + 1 - (i + 2) * y * n[i + 1] / n[i] for i in range(3)]
            d = e if all(0 < x < i + 2 for i, x in enumerate(e)) else d
        disc[k] = [0.0, *d]
        total[k], follow[k] = Counter(), defaultdict(Counter)
        for g, v in c.items():
            total[k][g[:-1]] += v
            follow[k][g[:-1]][min(v, 3)] += 1
    types = len(counts[1])

    def p(g):
        k = len(g)
        lower = p(g[1:]) if k > 1 else 1 / (types + 1)
        t = total[k].get(g[:-1], 0)
        if not t:
            return lower
        c = counts[k].get(g, 0)
        return (c - disc[k][min(c, 3)]) / t + sum(disc[k][x] * n for x, n in follow[k][g[:-1]].items()) / t * lower

    out = []
    for t in texts:
        w = words(t)
        s = ["<s>"] * (order - 1) + w + ["</s>"]
        out.append(sum(math.log(p(tuple(s[i : i + order]))) for i in range(len(s) - order + 1)) if w else None)
    return out


def best_fit_decreasing(sizes, capacity):
    room = []
    for s in sorted(sizes, reverse=True):
        fit = [r for r in room if r >= s]
        if fit:
            room.remove(min(fit))
            room.append(min(fit) - s)
        else:
            room.append(capacity - s)
    return len(room)
