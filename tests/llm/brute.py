"""Plain one-process versions of the operators, for small inputs."""

import hashlib
import re
import zlib

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def kept_words(docs, window=13):
    """doc_id -> (words, kept words); docs: (doc_id, text) with distinct ids."""
    first, out = {}, {}
    for doc, text in sorted(docs, key=lambda d: d[0]):
        words = WORD.findall(text or "")
        keep = [True] * len(words)
        for i in range(len(words) - window + 1):
            if first.setdefault(tuple(words[i : i + window]), doc) < doc:
                keep[i : i + window] = [False] * window
        out[doc] = (words, [w for w, k in zip(words, keep) if k])
    return out


def shingle_set(text, k):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < k:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def near_components(docs, k, percent=80):
    """doc_id -> (set size, smallest linked id), over all pairs."""
    sets = {d: shingle_set(t, k) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def crc(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))


ITEM_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def item_words(text):
    return ITEM_WORD.findall((text or "").translate(LOWER))


def contamination(docs, items, window=10):
    """(doc_id, words, hit words, item ids) of every document, by comparing words at every place."""
    patterns = {}
    for item, text in items:
        words = item_words(text)
        for i in range(max(len(words) - window + 1, min(len(words), 1)) if item is not None else 0):
            patterns.setdefault(tuple(words[i : i + window]), set()).add(str(item))
    sizes = {len(p) for p in patterns}
    for doc, text in docs:
        words, found = item_words(text), set()
        hit = [False] * len(words)
        for k in sizes:
            for i in range(len(words) - k + 1):
                if tuple(words[i : i + k]) in patterns:
                    found |= patterns[tuple(words[i : i + k])]
                    hit[i : i + k] = [True] * k
        yield doc, len(words), sum(hit), sorted(found)


def trie(conversations):
    """Rows of all prefix nodes; conversations: id -> list of (role, text)."""
    nodes = {}
    for conv, turns in sorted(conversations.items()):
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(conv)
    out = []
    for node, members in nodes.items():
        below = [n for n in nodes if n[: len(node)] == node]
        ends = ",".join(str(c) for c in members if len(conversations[c]) == len(node))
        out.append(
            (
                members[0],
                len(node),
                nodes[node[:-1]][0] if node else None,
                len(members),
                sum(len(n) == len(node) + 1 for n in below),
                sum(not any(len(m) == len(n) + 1 and m[:-1] == n for m in below) for n in below),
                sum((len(nodes[n]) - 1) * len(n[-1][1].encode()) for n in below if n),
                hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return sorted(out, key=str)


def branch(conversations, group=5, most=9):
    out = {}
    for conv, turns in conversations.items():
        h = zlib.crc32(str(conv).encode()) % most
        out[conv] = conversations.get(conv - conv % group, [])[:h] + turns[h:]
    return out


def runs(words):
    """(start, length, period) of every run, trying every period at every place."""
    out = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q):
                own = words[i : i + length]
                if not any(own[s:] == own[:-s] for s in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    keep = [True] * len(words)
    for start, length, period in found:
        keep[start + period : start + length] = [False] * (length - period)
    return [w for w, k in zip(words, keep, strict=True) if k]


def looped(doc, words):
    h, n = zlib.crc32(str(doc).encode()), len(words)
    if h % 10 or not n:
        return words
    a, g = h // 10 % n, h // 10
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
