"""Plain Python versions of the operators, for small inputs."""

import hashlib
import re
import string
import zlib
from fractions import Fraction

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return (text or "").translate(LOWER)


def shingles(text, size=5):
    words = WORD.findall(lower(text))
    if not words:
        return frozenset()
    size = min(size, len(words))
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def near_duplicates(rows, percent=85):
    """rows of (doc_id, text) with distinct ids: {doc_id: (n_shingles, component_id)}."""
    sets = {i: shingles(t) for i, t in rows}
    holders, parent = {}, {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        for gram in s:
            holders.setdefault(gram, []).append(i)
    pairs = {(a, b) for held in holders.values() for a in held for b in held if a < b}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contaminated(texts, items, window=10):
    """[(n_words, n_hit, item ids)] for each text; items of (item_id, text)."""
    windows = {}
    for item, text in items:
        words = ITEM_WORD.findall(lower(text))
        for i in range(max(len(words) - window + 1, 1) if words else 0):
            windows.setdefault(tuple(words[i : i + window]), set()).add(str(item))
    out = []
    for text in texts:
        words, hit, named = ITEM_WORD.findall(lower(text)), set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(words) - size + 1):
                found = windows.get(tuple(words[i : i + size]))
                if found:
                    hit.update(range(i, i + size))
                    named |= found
        out.append((len(words), len(hit), sorted(named)))
    return out


def top_k(vectors, queries, k):
    """{query_id: [(score, vec_id)]}; dictionaries of id to integers."""
    out = {}
    for q, x in queries.items():
        scored = [(-sum(a * b for a, b in zip(x, y)), v) for v, y in vectors.items() if v != q and len(x) == len(y)]
        if scored:
            out[q] = [(-s, v) for s, v in sorted(scored)[:k]]
    return out


def best_score(word, pieces, byte_score):
    """The largest total score of a segmentation of ``word`` into ``pieces`` (text to score) and bytes."""
    best = [0.0] + [float("-inf")] * len(word)
    for end in range(1, len(word) + 1):
        best[end] = best[end - 1] + byte_score * len(word[end - 1].encode())
        for start in range(end):
            if word[start:end] in pieces:
                best[end] = max(best[end], best[start] + pieces[word[start:end]])
    return best[-1]


def periodic_runs(words, least=24, times=3):
    """([(start, length, period)], kept words) by comparing every word with the one a period on."""
    n, smallest = len(words), {}
    for p in range(1, n // times + 1):
        i = 0
        while i < n - p:
            begin = i
            while i < n - p and words[i] == words[i + p]:
                i += 1
            if i > begin and i - begin + p >= max(least, times * p):
                smallest.setdefault((begin, i - begin + p), p)
            i += 1
    runs = sorted(((s, length, p) for (s, length), p in smallest.items()), key=lambda r: (r[0], r[2]))
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    return runs, [w for i, w in enumerate(words) if i not in gone]


def planted_words(doc_id, text):
    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    if words and doc_id is not None and h % 10 == 0:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def run_digests(doc_id, text):
    """The row that the query of periodic runs gives for a document."""
    runs, kept = periodic_runs(planted_words(doc_id, text))
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    lines = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, digest(lines), digest(" ".join(kept)))


def byte_shards(sizes, shards):
    """Shard of every row in order: where its middle byte falls."""
    total, before, out = sum(sizes), 0, []
    for size in sizes:
        out.append((2 * before + size) * shards // (2 * total))
        before += size
    return out


def slipped_words(doc_id, text, every=199):
    for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
        run = run.translate(LOWER)
        h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
        yield run if h % every else run[: h % len(run)] + run[h % len(run) + 1 :]


def one_edit(x, y):
    """Whether one inserted, deleted or replaced letter turns x into y."""
    x, y = sorted((x, y), key=len)
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    return len(y) == len(x) + 1 and any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def spelling_variants(counts, ratio=5):
    """{word: (form, root, n, n_near, form_n)} of {word: n}."""
    near = {w: [v for v in counts if abs(len(v) - len(w)) < 2 and one_edit(v, w)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items()}
