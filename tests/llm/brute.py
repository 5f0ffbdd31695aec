"""Plain Python and DuckDB versions of the operators' results, written from their contracts alone."""

import base64
import hashlib
import re
import zlib
from collections import defaultdict

import xxhash

SPACES = " \t\n\x0b\x0c\r"


def lower(text):
    return re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text)


def decontamination(docs, items, window=10):
    """docs: (doc_id, text); items: (item_id, text)."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    known = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        if n and item is not None:
            for i in range(len(w) - n + 1):
                known[tuple(w[i : i + n])].add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in known}:
            for i in range(len(w) - n + 1):
                got = known.get(tuple(w[i : i + n]))
                if got:
                    hit.update(range(i, i + n))
                    found |= got
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def exact(docs):
    groups = defaultdict(list)
    for i, (doc, text) in enumerate(docs):
        groups["".join(c for c in text or "" if c not in SPACES)].append((-len(text or ""), doc is None, doc or 0, i))
    out = []
    for text, rows in groups.items():
        best = min(rows)
        for r in rows:
            name = lambda x: None if x[1] else x[2]
            out.append((name(r), name(best), len(rows), r == best, hashlib.sha256(text.encode()).hexdigest()))
    return out


def simhash(docs, words=3, seed=42):
    out = []
    for doc, text in docs:
        w = [x for x in re.split(f"[{SPACES}]+", lower(text or "")) if x]
        hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + words]).encode(), seed) for i in range(max(1, len(w) - words + 1))] if w else []
        out.append((doc, sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))))
    return out


def components(fps, radius=2):
    """fps: (doc_id, fingerprint); the smallest doc_id reachable, for each row."""
    label = {}
    values = sorted({f for _, f in fps})
    for f in values:
        if f in label:
            continue
        label[f], todo = f, [f]
        while todo:
            a = todo.pop()
            for b in values:
                if b not in label and (a ^ b).bit_count() <= radius:
                    label[b] = f
                    todo.append(b)
    least = {}
    for doc, f in fps:
        if doc is not None:
            least[label[f]] = min(doc, least.get(label[f], doc))
    return [(doc, f, least.get(label[f])) for doc, f in fps]


def revisits(pages, least=0):
    first = {}
    for page, html in pages:
        if page is not None and len((html or "").encode()) >= least:
            first[html or ""] = min(page, first.get(html or "", page))
    out = []
    for page, html in pages:
        data = (html or "").encode()
        other = first.get(html or "") if page is not None else None
        other = None if other == page else other
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if other is None else "revisit", other))
    return out


def base_secrets(text):
    text, spans = text or "", []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            spans.append((m.start(), 0, m.end()))
    for kind, pattern, least in ((1, r"AKIA[A-Z0-9]+", 16), (2, r"[0-9a-f]+", 32)):
        spans += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return sorted(spans)


def entropy_spans(text, classes, allowed):
    """Every window's entropy counted from scratch."""
    import math
    from collections import Counter

    out = []
    for k, c in enumerate(classes):
        for m in re.finditer(f"{c.pattern}{{{c.window},}}", text or ""):
            if not all(re.search(p, m[0]) for p in c.needs) or any(re.search(p, m[0]) for p in allowed):
                continue
            last = None
            for i in range(len(m[0]) - c.window + 1):
                counts = Counter(m[0][i : i + c.window])
                if -sum(n / c.window * math.log2(n / c.window) for n in counts.values()) >= c.threshold - 1e-9:
                    if last and last[2] >= m.start() + i:
                        last[2] = m.start() + i + c.window
                    else:
                        last = [m.start() + i, 3 + k, m.start() + i + c.window]
                        out.append(last)
    return [tuple(x) for x in out]


def crc(data):
    return zlib.crc32(data)
