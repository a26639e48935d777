"""Brute-force versions of the operators, straight from their definitions, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def spaced(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def alnum(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


def quality(t):
    w = spaced(t)
    c = Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if c[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (t or "").split("\n") if spaced(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)),
            len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w))


def suffix(texts, width):
    """(n_bytes, n_removed, n_spans, kept) of every text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + width] for d in data for i in range(len(d) - width + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - width + 1):
            if seen[d[i:i + width]] > 1:
                gone[i:i + width] = True
        kept = bytes(b for b, g in zip(d, gone) if not g)
        starts = int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(d) else 0
        out.append((len(d), int(gone.sum()), starts, kept))
    return out


def licenses(t):
    base = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    w = alnum(t)
    at = sorted((i, label) for p, label in base.items() for i in range(len(w))
                if w[i:i + len(p.split())] == p.split())
    return (len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None,
            ",".join(sorted({x for _, x in at})))


def leaks(texts, items, k=10):
    """(n_words, n_hit, items) of every text; items: (id, text)."""
    windows = defaultdict(set)
    for name, t in items:
        w = alnum(t)
        m = min(k, len(w))
        for i in range(len(w) - m + 1 if w else 0):
            windows[tuple(w[i:i + m])].add(name)
    out = []
    for t in texts:
        w, hit, found = alnum(t), set(), set()
        for m in {len(x) for x in windows}:
            for i in range(len(w) - m + 1):
                own = windows.get(tuple(w[i:i + m]))
                if own is not None:
                    hit.update(range(i, i + m))
                    found |= {str(x) for x in own if x is not None}
        out.append((len(w), len(hit), sorted(found)))
    return out


def sha(items):
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def shingle_set(t, k=5):
    w = spaced(lower(t))
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def groups(rows, percent=75):
    """(n_shingles, component) of every (id, text)."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if sets[i] and 100 * o >= percent * len(sets[i] | sets[j]) and find(i) != find(j):
                parent[find(i)] = find(j)
    by = defaultdict(list)
    for i, (name, _) in enumerate(rows):
        by[find(i)].append(name)
    least = {r: min((x for x in v if x is not None), default=None) for r, v in by.items()}
    return [(len(s), least[find(i)]) for i, s in enumerate(sets)]


def ids_of(t, end):
    import public_tokenizers as P
    from tokenizers import Tokenizer
    global _TOK
    try:
        tok = _TOK
    except NameError:
        tok = _TOK = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    return tok.encode(t or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def phrases(rows, k=13):
    """(id, n_words, n_removed, kept) of every (id, text)."""
    def order(i):
        return (i is None, i or 0)

    least, docs = {}, [(i, spaced(t)) for i, t in rows]
    for i, w in docs:
        for j in range(len(w) - k + 1):
            g = tuple(w[j:j + k])
            least[g] = min(least.get(g, order(i)), order(i))
    out = []
    for i, w in docs:
        gone = [False] * len(w)
        for j in range(len(w) - k + 1):
            if least[tuple(w[j:j + k])] < order(i):
                gone[j:j + k] = [True] * k
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def alignment(rows):
    """The columns of operator 11 from whole texts, token by token."""
    import public_tokenizers as P
    import sentencepiece
    from incidentflow.llm.token_alignment import byte_letters
    from tokenizers import Tokenizer
    one = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    letter, word = byte_letters(), {i: k for k, i in one.get_vocab().items()}

    def piece(i):
        p = two.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if two.is_byte(i) else p.replace("\u2581", " ").encode()

    def places(ids, parts):
        out, at = [], 0
        for i, p in zip(ids, parts):
            out.append((i, at, at + len(p)))
            at += len(p)
        return out

    docs, count = [], Counter()
    for i, x in rows:
        a = one.encode(" " + (x or ""), add_special_tokens=False).ids
        b = two.encode(x or "")
        pa, pb = [bytes(letter[c] for c in word[k]) for k in a], [piece(k) for k in b]
        if not x or not b"".join(pa) == b"".join(pb) == (" " + x).encode():
            docs.append((i, None))
            continue
        a, b = places(a, pa), places(b, pb)
        links, j = [], 0
        for k, lo, hi in a:
            while b[j][2] <= lo:
                j += 1
            m = j
            while m < len(b) and b[m][1] < hi:
                links.append((k, b[m][0]))
                m += 1
        groups, at = [], [0, 0]
        for hi in sorted({e for _, _, e in a} & {e for _, _, e in b}):
            both = []
            for n, side in enumerate((a, b)):
                lo = at[n]
                while at[n] < len(side) and side[at[n]][2] <= hi:
                    at[n] += 1
                both.append(",".join(str(k) for k, _, _ in side[lo:at[n]]))
            groups.append("|".join(both))
        count.update(links)
        docs.append((i, (len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest())))
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return [(i, 0, 0, 0, 0, 0, 0, "") if d is None else
            (i, *d[:3], len(d[3]), sum(count[p] == best[p[1]] for p in d[3]), sum(count[p] for p in d[3]), d[4])
            for i, d in docs]


def codes(rows, entries=256, parts=4, rounds=4):
    """(id, code, error, label_error, digest) of every kept (id, vector, label); dimensions that ``parts`` divides."""
    rows = sorted(((i, v, k) for i, v, k in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)),
                  key=lambda r: (r[0] is None, r[0] or 0, list(r[1])))
    x = np.array([[int(np.floor(1024 * float(c))) for c in v] for _, v, _ in rows], np.int64).reshape(len(rows), parts, -1)
    books = [x[:entries, p].copy() for p in range(parts)]

    def nearest(p):
        d = ((x[:, p][:, None, :] - books[p][None]) ** 2).sum(axis=2)
        i = d.argmin(axis=1)
        return i, d[np.arange(len(x)), i]

    for _ in range(rounds):
        for p in range(parts):
            i, _ = nearest(p)
            for e in range(len(books[p])):
                if (i == e).any():
                    books[p][e] = np.floor_divide(x[i == e][:, p].sum(axis=0), (i == e).sum())
    got = [nearest(p) for p in range(parts)]
    error, label = sum(d for _, d in got), Counter()
    for (_, _, k), e in zip(rows, error.tolist()):
        label[k] += e
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()
    return [(r[0], "".join(f"{g[0][n]:02x}" for g in got), int(error[n]), label[r[2]], digest) for n, r in enumerate(rows)]
