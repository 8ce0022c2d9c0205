"""Plain versions of the operators, to hold their results against."""

import hashlib
import re
import zlib
from collections import defaultdict


def repeated_bytes(docs, width=100):
    """{doc_id: (n_bytes, n_removed, n_spans, sha256)}; docs: (doc_id, text), ids distinct."""
    first = {}
    raw = {d: (t or "").encode() for d, t in docs}
    for d in sorted(raw):
        b = raw[d]
        for i in range(len(b) - width + 1):
            first.setdefault(b[i : i + width], (d, i))
    out = {}
    for d, b in raw.items():
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if first[b[i : i + width]] != (d, i):
                gone[i : i + width] = b"\1" * width
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def components(docs, width=3, num=90, den=100):
    """{doc_id: (n_shingles, component_id)}"""
    sets = {}
    for d, t in docs:
        w = (t or "").encode().lower().split()
        k = min(width, len(w))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    by = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            by[g].append(d)
    seen = set()
    for members in by.values():
        for i, a in enumerate(members):
            for b in members[:i]:
                if (a, b) in seen:
                    continue
                seen.add((a, b))
                x, y = sets[a], sets[b]
                if min(len(x), len(y)) * den >= max(len(x), len(y)) * num and den * len(x & y) >= num * len(x | y):
                    p, q = root(a), root(b)
                    up[max(p, q)] = min(p, q)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def leaks(text, items, width=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, own = words(text), set(), set()
    for item, t in items:
        x = words(t)
        m = min(width, len(x))
        for i in range(len(x) - m + 1 if m else 0):
            for j in range(len(w) - m + 1):
                if w[j : j + m] == x[i : i + m]:
                    hit.update(range(j, j + m))
                    own.add(str(item))
    return len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest()


def water_fill(sources, most=3):
    """sources: (size, weight); resharing until nothing is above its clamp."""
    total = float(sum(s for s, _ in sources))
    target, open_ = [0.0] * len(sources), set(range(len(sources)))
    while open_:
        share = (total - sum(target[i] for i in range(len(sources)) if i not in open_)) / sum(sources[i][1] for i in open_)
        full = {i for i in open_ if share * sources[i][1] >= most * sources[i][0]}
        for i in full or open_:
            target[i] = float(most * sources[i][0]) if full else share * sources[i][1]
        open_ -= full or open_
    return target


def crc(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))


def main_texts(pages, run=6, covered=0.5):
    """[text] of pages [(url, [(kind, block)])], by looking at every run of every page."""
    where, hosts = defaultdict(set), []
    padded = lambda t: (w := t.split()) + ["\x02"] * max(0, run - len(w))
    runs = lambda t: [tuple(w[i : i + run]) for w in [padded(t)] for i in range(len(w) - run + 1)]
    for url, blocks in pages:
        m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", url or "")
        hosts.append(m[1].lower() if m else "")
        loose = tuple(t for k, t in blocks if k != "main")
        for t in loose:
            for r in runs(t):
                where[hosts[-1], r].add(loose)
    out = []
    for host, (_, blocks) in zip(hosts, pages):
        if any(k == "main" for k, _ in blocks):
            out.append("\n\n".join(t for k, t in blocks if k == "main"))
            continue
        kept = []
        for t in (t for k, t in blocks if k == "open"):
            inside = {j for i, r in enumerate(runs(t)) if len(where[host, r]) > 1 for j in range(i, i + run)}
            if len(inside) < covered * len(padded(t)):
                kept.append(t)
        out.append("\n\n".join(kept))
    return out


def em(rows, share_good, chance, rounds):
    """Expectation-maximisation row by row; chance[class][labeller][vote + 1], classes bad and good."""

    def posterior(v):
        good, bad = share_good, 1 - share_good
        for k, x in enumerate(v):
            good *= chance[1][k][x + 1]
            bad *= chance[0][k][x + 1]
        return good / (good + bad)

    for _ in range(rounds):
        post = [posterior(v) for v in rows]
        new = []
        for c in (0, 1):
            weight = [p if c else 1 - p for p in post]
            new.append([[(0.5 + sum(w for w, v in zip(weight, rows) if v[k] == x)) / (1.5 + sum(weight)) for x in (-1, 0, 1)] for k in range(len(rows[0]))])
        chance, share_good = new, min(0.99, max(0.01, sum(post) / len(post)))
    return [posterior(v) for v in rows]
