"""A small corpus of awkward rows, and plain versions of what the operators compute."""

import hashlib
import math
import random
import re
import zlib

SCHEMA = "doc_id long, text string, key string, name string, id long, found string, score string"
SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sentence(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}x" for _ in range(n))


def rows():
    """Nulls, empty and long texts, exact and near copies, shared passages, repeated words, rows with equal ids."""
    rng = random.Random(5)
    passage, line = sentence(rng, 60), sentence(rng, 23)
    base = sentence(rng, 200).split()
    texts = [None, "", " \n\t ", "é", "one", "a b c", "a b c", "A B  c"]
    texts += [" ".join(base)] * 3
    for k in range(6):  # near copies, each other one a little further away
        changed = list(base)
        for j in range(2 * k):
            changed[(37 * j + 11 * k) % 200] = f"z{k}{j}"
        texts.append(" ".join(changed))
    texts += [f"{sentence(rng, 30)} {passage}\n{sentence(rng, 15)}" for _ in range(5)]
    texts += [f"{sentence(rng, 12)} {line}  {sentence(rng, 14)}" for _ in range(12)]
    texts += ["la " * 100, "la " * 57, "x" * 5000, sentence(rng, 6000), sentence(rng, 6000) + " " + passage]
    texts += ["日本語 \U0001F600 naïve \x00 \x85   end"]
    out = [(k, t, "k", "n", 7, "f", "s") for k, t in enumerate(texts)]
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def without_repeats(docs, n=20):
    """doc_id: (words, removed, digest of what is kept), for unique ids."""
    seen, out = set(), {}
    for doc_id, text in sorted(docs):
        w = SPACE_WORDS.findall(text or "")
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            window = tuple(w[i : i + n])
            if window in seen:
                gone[i : i + n] = [True] * n
            seen.add(window)
        out[doc_id] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g)))
    return out


def equal_texts(docs):
    groups = {}
    for doc_id, text in docs:
        groups.setdefault(text or "", []).append(doc_id)
    return {
        d: (max(groups[t or ""]), len(groups[t or ""]), d == max(groups[t or ""]), sha(t or "")) for d, t in docs
    }


def near_groups(docs, n=5, percent=75):
    """doc_id: (shingles, smallest id reachable)."""
    sets = {}
    for d, t in docs:
        w = SPACE_WORDS.findall(lower(t))
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def benchmark_hits(docs, items, n=10):
    """doc_id: (words, hit words, items)."""
    patterns = {}
    for item, text in items:
        w = ALNUM_WORDS.findall(lower(text))
        for s in range(max(1 if w else 0, len(w) - n + 1)):
            patterns.setdefault(tuple(w[s : s + n]), set()).add(item)
    out = {}
    for d, t in docs:
        w = ALNUM_WORDS.findall(lower(t))
        hit, found = set(), set()
        for size in {len(p) for p in patterns}:
            for s in range(len(w) - size + 1):
                at = patterns.get(tuple(w[s : s + size]))
                if at:
                    found |= at - {None}
                    hit.update(range(s, s + size))
        out[d] = (len(w), len(hit), found)
    return out


def one_edit(a, b):
    """Whether one inserted, deleted or replaced code point makes a to b."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def spelling_variants(docs):
    """word: (form, root, n, n_near, form_n)."""
    counts = {}
    for d, t in docs:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", t or ""):
            w = lower(run)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] = counts.get(w, 0) + 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [v for v in counts if abs(len(v) - len(w)) < 2 and one_edit(v, w)] for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 2 * counts[w] else None
    root = {}
    for w in counts:
        r = w
        while form[r]:
            r = form[r]
        root[w] = r
    return {w: (form[w], root[w], n, len(near[w]), counts.get(form[w])) for w, n in counts.items()}


def fingerprints(docs, n=4):
    import xxhash

    out = []
    for _, t in docs:
        w = SPACE_WORDS.findall(lower(t))
        runs = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])
        hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
        out.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    return out


def hamming_components(ids, prints, radius=4):
    """The smallest id reachable from each row."""
    component = list(range(len(ids)))

    def find(x):
        while component[x] != x:
            x = component[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                component[max(x, y)] = min(x, y)
    least = {}
    for k, d in enumerate(ids):
        if d is not None:
            least[find(k)] = min(d, least.get(find(k), d))
    return [least.get(find(k)) for k in range(len(ids))]


def draw(docs, items, least_words=20, share=(5, 100)):
    """[(id, features, weight, score, rank)] of rows with ids, in the order of docs."""

    def features(t):
        w = ALNUM_WORDS.findall(lower(t))
        runs = [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]
        return len(w), [zlib.crc32(r.encode()) % 10000 for r in runs]

    made = [features(t) for _, t in docs]
    source, target = [0] * 10000, [0] * 10000
    for _, found in made:
        for b in found:
            source[b] += 1
    for _, t in items:
        for b in features(t)[1]:
            target[b] += 1
    s_all, t_all = sum(source) + 10000, sum(target) + 10000
    gain = [math.floor(1000 * math.log((t + 1) * s_all / ((s + 1) * t_all))) for s, t in zip(source, target)]
    rows, able = [], []
    for (d, _), (n, found) in zip(docs, made):
        weight = sum(gain[b] for b in found)
        h = int(hashlib.sha256(f"42:{d}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        if n >= least_words:
            able.append((-score, d))
        rows.append([d, len(found), weight, score, None])
    place = {key: k for k, key in enumerate(sorted(able)[: share[0] * len(able) // share[1]], 1)}
    for row, (n, _) in zip(rows, made):
        if n >= least_words:
            row[4] = place.get((-row[3], row[0]))
    return [tuple(r) for r in rows]
