"""Small corpora with copies, shared passages and odd rows, and plain versions of the operators."""

import hashlib
import random
import re
from collections import Counter

SPACE, ALNUM = "[^\x20\x09-\x0d]+", "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=1, n=60):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeéñ") for _ in range(r.randint(1, 7))) for _ in range(80)]
    passage = " ".join(r.choice(vocab) for _ in range(90))
    line = "one very common line of words that many documents hold in full"
    texts = []
    for i in range(n):
        t = " ".join(r.choice(vocab).capitalize() if r.random() < 0.1 else r.choice(vocab) for _ in range(r.choice([3, 30, 150, 400])))
        if i % 5 == 0:
            w = t.split()
            k = r.randrange(len(w))
            t = " ".join(w[:k] + [passage] + w[k:])
        if i % 3 == 0:
            t += "\n" + line + ".\n" + line
        if i % 7 == 3 and texts:
            t = texts[r.randrange(len(texts))]
        if i % 11 == 4 and texts:
            w = texts[r.randrange(len(texts))].split(" ")
            w[len(w) // 2] = "changed"
            t = " ".join(w)
        texts.append(t)
    texts += [None, "", "   \n\t ", "x", "aaaa " * 120, "z" * 1300, "É\x00\x1c  odd\x0b\x0cspace\x85here　too", "Mit License. THE MIT license\nGNU general public license 3"]
    return [(i, t, ["en", "fr", None][i % 3], f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]


def words(text, pattern=SPACE, lower=False):
    return re.findall(pattern, (text or "").translate(LOWER) if lower else (text or ""))


def plain_substring(docs, size=20):
    seen, out = set(), {}
    for i, t, *_ in sorted(docs, key=lambda d: d[0]):
        w = [x.encode() for x in words(t)]
        keep = [True] * len(w)
        for s in range(len(w) - size + 1):
            g = tuple(w[s : s + size])
            if g in seen:
                keep[s : s + size] = [False] * size
            seen.add(g)
        kept = [x for x, k in zip(w, keep) if k]
        out[i] = (len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def plain_bytes(docs, size=400):
    raw = {i: (t or "").encode() for i, t, *_ in docs}
    count = Counter(b[s : s + size] for b in raw.values() for s in range(len(b) - size + 1))
    out = {}
    for i, b in raw.items():
        gone = bytearray(len(b))
        for s in range(len(b) - size + 1):
            if count[b[s : s + size]] > 1:
                gone[s : s + size] = b"\x01" * size
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out[i] = (len(b), len(b) - len(kept), len([x for x in bytes(gone).split(b"\x00") if x]), hashlib.sha256(kept).hexdigest())
    return out


def plain_contamination(docs, items, size=10):
    wins = {}
    for k, t in items:
        w = words(t, ALNUM, True)
        n = min(size, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[s : s + n]), set()).add(k)
    out = {}
    for i, t, *_ in docs:
        w = words(t, ALNUM, True)
        hit, got = [0] * len(w), set()
        for n in {len(k) for k in wins}:
            for s in range(len(w) - n + 1):
                k = wins.get(tuple(w[s : s + n]))
                if k:
                    got |= k
                    hit[s : s + n] = [1] * n
        out[i] = (len(w), sum(hit), sorted(got))
    return out


def plain_simhash(docs, shingle=4, radius=4):
    import xxhash

    prints = {}
    for i, t, *_ in docs:
        w = words(t, SPACE, True)
        s = [" ".join(w[k : k + shingle]) for k in range(len(w) - shingle + 1)] if len(w) >= shingle else [" ".join(w)] * bool(w)
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    ids = sorted(prints)
    label = {i: i for i in ids}
    again = True
    while again:
        again = False
        for a in ids:
            for b in ids:
                if bin(prints[a] ^ prints[b]).count("1") <= radius and label[b] > label[a]:
                    label[b], again = label[a], True
    return {i: (prints[i], label[i]) for i in ids}


def plain_statistics(text):
    t = text or ""
    w = words(t)
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = [0] * len(w)
    for i in range(len(w) - 2):
        if c[tuple(w[i : i + 3])] > 1:
            hit[i : i + 3] = [1] * 3
    seen, dup = set(), 0
    for line in t.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), dup, sum(hit)
