"""Plain versions of the training-data operators, for small inputs."""

import bisect
import collections
import hashlib
import re
import zlib

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def marks(text):
    low = (text or "").encode().translate(LOWER).decode()
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def substring_marks(docs, window=13):
    """docs: (id, text); which words of each are repeats of a smaller id."""
    least = {}
    for doc, text in docs:
        w = words(text)
        for i in range(len(w) - window + 1):
            key = tuple(w[i:i + window])
            least[key] = min(least.get(key, doc), doc)
    out = []
    for doc, text in docs:
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if least[tuple(w[i:i + window])] < doc:
                gone[i:i + window] = [True] * window
        out.append((w, gone))
    return out


def benchmark_hits(text, items, window=10):
    w, hit, found = marks(text), set(), set()
    for item, body in items:
        b = marks(body)
        n = min(window, len(b))
        keys = {tuple(b[i:i + n]) for i in range(len(b) - n + 1)} if n else set()
        for i in range(len(w) - n + 1) if n else ():
            if tuple(w[i:i + n]) in keys:
                hit.update(range(i, i + n))
                if item is not None:
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


def shingles(text, size=3):
    w = words((text or "").encode().translate(LOWER).decode())
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1)))


def components(docs, size=3, percent=85):
    """docs: (id, text) with distinct ids; the smallest id reachable of each."""
    up = {doc: doc for doc, _ in docs}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = {doc: shingles(text, size) for doc, text in docs}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = root(a), root(b)
                    up[max(x, y)] = min(x, y)
    return {doc: root(doc) for doc in up}, {doc: len(s) for doc, s in sets.items()}


def byte_marks(rows, length=100):
    """rows in order; which bytes are covered by a string that starts earlier."""
    seen, out = set(), []
    for row in rows:
        gone = bytearray(len(row))
        for i in range(len(row) - length + 1):
            key = row[i:i + length]
            if key in seen:
                gone[i:i + length] = b"\1" * length
            seen.add(key)
        out.append(gone)
    return out


def best_fit(lengths, capacity):
    rooms = []
    for length in sorted(lengths, reverse=True):
        at = bisect.bisect_left(rooms, length)
        room = capacity if at == len(rooms) else rooms.pop(at)
        bisect.insort(rooms, room - length)
    return len(rooms)


def quality(text):
    t = text or ""
    w = words(t)
    n = len(w)
    windows = collections.Counter(tuple(w[i:i + 8]) for i in range(n - 7))
    covered = set()
    for i in range(n - 7):
        if windows[tuple(w[i:i + 8])] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in t.split("\n") if words(x)]
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered),
            n < 20 or 100 * len(covered) > 30 * n)


def ids(encoder, text):
    return encoder.encode(text or "", add_special_tokens=False).ids + [0]


def crc(values):
    import numpy as np

    return zlib.crc32(np.array(values, "<u4").tobytes())


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def page_texts(pages, run=10, least=4):
    """pages: (host, html); the main text of each, boilerplate counted by sets."""
    from strata.llm.html_text import DROPPED, UNDECIDED, segments

    cut = [segments(html or "") for _, html in pages]
    bodies = [tuple(text for kind, text in page if kind != DROPPED) for page in cut]
    keys = []
    for page in cut:
        stream = [token for _, text in page for token in ["", *text.split(" ")]]
        keys.append({tuple(stream[i:i + run]) for i in range(len(stream) - run + 1)} | {
            text for _, text in page if len(text.split(" ")) >= least})
    # Of pages that differ only in what is dropped the one with the fewest such keys need not be the one
    # that counts, so inputs are to hold equal dropped segments wherever host and body are equal.
    having, every = collections.defaultdict(set), collections.defaultdict(set)
    for (host, _), body, own, page in zip(pages, bodies, keys, cut):
        if page:  # a page without any text is no evidence
            every[host].add(body)
        for key in own:
            having[host, key].add(body)
    out = []
    for (host, _), page in zip(pages, cut):
        def common(key, host=host):
            n = len(having.get((host, key), ()))
            return bool(host) and n >= 3 and 2 * n >= len(every[host])

        stream, spans = [], []
        for kind, text in page:
            stream.append("")
            spans.append((len(stream), len(stream) + len(text.split(" "))))
            stream += text.split(" ")
        hit = [False] * len(stream)
        for i in range(len(stream) - run + 1):
            if common(tuple(stream[i:i + run])):
                hit[i:i + run] = [True] * run
        kept = []
        for (kind, text), (low, high) in zip(page, spans):
            if kind == DROPPED:
                continue
            tokens, marks = stream[low:high], hit[low:high]
            if high - low >= least and common(text) and (kind == UNDECIDED or high - low >= run):
                continue
            if kind == UNDECIDED:
                for at in range(len(tokens)):  # the run of marks around a token
                    if marks[at]:
                        a, b = at, at
                        while a and marks[a - 1]:
                            a -= 1
                        while b + 1 < len(marks) and marks[b + 1]:
                            b += 1
                        if b + 1 - a >= run or b + 1 - a == len(tokens):
                            tokens[at] = None
                tokens = [t for t in tokens if t is not None]
            kept += tokens
        out.append(" ".join(kept))
    return out
