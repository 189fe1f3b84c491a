"""Plain versions of the contracts, for small fixtures."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def substring(rows, window=35):
    """(doc_id, text) rows -> (doc_id, n_words, n_removed, kept_sha256) rows."""
    words = [WORD.findall(t or "") for _, t in rows]
    seen = defaultdict(int)
    for w in words:
        for i in range(len(w) - window + 1):
            seen[tuple(w[i : i + window])] += 1
    out = []
    for (key, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((key, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def near(rows, width=3, share=85):
    """(doc_id, text) rows -> (doc_id, n_shingles, component_id, kept) rows, for unique doc_ids."""
    sets = {}
    for key, text in rows:
        w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[key] = {tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for k, s in sets.items():
        for x in s:
            holders[x].append(k)
    for k in sorted(sets):
        counts = defaultdict(int)
        for x in sets[k]:
            for o in holders[x]:
                if o < k:
                    counts[o] += 1
        for o, n in counts.items():
            if 100 * n >= share * (len(sets[k]) + len(sets[o]) - n):
                a, b = find(k), find(o)
                root[max(a, b)] = min(a, b)
    return [(k, len(sets[k]), find(k), find(k) == k) for k, _ in rows]


def contaminated(rows, items, width=8, run=13, least=5):
    """(doc_id, text) rows, (item_id, text) items -> pairs of ids of texts that repeat an item; windows looked up in dicts."""
    from tessera.llm.decontam import NUMBER_WORDS, UNITS

    def parse(t):
        t = re.sub(r"(?<=\d)[.,](?=\d)", "", (t or "").replace("@", " "))
        t = re.sub(r"(\d)([^\W\d_])", r"\1 \2", t)
        out = []
        for m in re.finditer(r"[^\W_@]+", t):
            w, at = m[0], m.start()
            name = at > 1 and t[at - 1] == " " and (t[at - 2].isalnum() or t[at - 2] == ",") and w[0].isupper() and w[1:] and w[1:].islower()
            out.append(("@" if name else "") + w.lower())
        return out

    def kinds(words):
        return ["#" if w[0].isdigit() or w in NUMBER_WORDS else "@" if w[0] == "@" else "%" if w in UNITS and b[:1].isdigit() else w for w, b in zip(words, ["", *words], strict=False)]

    def windows(words, skip, w):
        plain = [x.lstrip("@") for x in words]
        a, b = kinds(plain)[skip:], kinds(words)[skip:]
        plain = plain[skip:]
        bare = lambda ks: all(k in "#@%" for k in ks)
        for p in range(len(plain) - w + 1):
            yield p, ("values", *plain[p : p + w]) if bare(a[p : p + w]) else ("plain", *a[p : p + w])
            if "@" in b[p : p + w] and not bare(b[p : p + w]):
                yield p, ("plain", *b[p : p + w])

    out, asked, texts = set(), defaultdict(set), {}
    for i, q in items:
        texts[i] = parse(q)
        w = min(width, len(texts[i]))
        for words, skip in ((texts[i], 0), (parse("1 " + (q or "")), 1)):
            if w:
                for p, key in windows(words, skip, w):
                    asked[w, key].add((i, p))
    for d, t in rows:
        x = parse(t)
        bare = [w.lstrip("@") for w in x]
        lines = defaultdict(set)
        for w in {w for w, _ in asked}:
            if w >= least or len(x) == w:
                for at, key in windows(x, 0, w):
                    for i, p in asked.get((w, key), ()):
                        lines[i, at - p].add(p)
        places = defaultdict(set)
        for (i, shift), hit in lines.items():
            y = texts[i]
            w = min(width, len(y))
            own = [v.lstrip("@") for v in y]
            same = {p for p in hit if own[p : p + w] == bare[p + shift : p + shift + w]}
            slot = lambda p: {(own[p + k], bare[p + shift + k]) for k in range(w) if kinds([y[p + k]])[0] in "#@" or own[p + k] != bare[p + shift + k]}  # noqa: E731, B023
            pairs = set().union(*(slot(p) for p in hit - same)) if w >= least else {(0, 0), (0, 1)}
            places[i] |= hit if len({a for a, _ in pairs}) == len(pairs) else same
        out |= {(d, i) for i, found in places.items() if len(found) >= min(len(texts[i]), run) - min(len(texts[i]), width) + 1}
    return out
