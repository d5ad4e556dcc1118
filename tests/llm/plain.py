"""Plain Python versions of the operators, and small documents with all the odd cases."""

import collections
import hashlib
import math
import random
import re

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BARE = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = "doc_id long, text string, lang string, source string, n_chars long, h1 string, block int, keep string, row long, `key` string"


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def rows(seed=3):
    """(doc_id, text): random prose, copies, near copies, shared passages and lines, nulls, ties, long texts."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghiéßñ") for _ in range(r.randint(2, 8))) for _ in range(900)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage, line = prose(70), prose(12)
    texts = [prose(r.randint(1, 220)) for _ in range(26)]
    texts += [None, "", " ", "\n\n", "A.", "!!! ### \t\n", texts[0], texts[0], texts[1].upper()]
    texts += [prose(30) + "\n" + passage + "\n" + prose(9) for _ in range(5)] + [passage, "  " + line.upper() + "\t"]
    texts += [prose(20) + "\n" + line + "\n" + prose(5) for _ in range(7)]
    base = prose(300).split(" ")
    for k in range(6):
        near = list(base)
        for _ in range(k):
            near[r.randrange(300)] = "changed"
        texts.append(" ".join(near))
    texts += ["ab" * 90, "ab" * 40, "of " * 200, "日本語の文 😀 " * 12, "x\x00y\x7f " * 30, prose(9000)]
    order = list(range(len(texts)))
    r.shuffle(order)
    out = [(i * 3 - 20, texts[j]) for i, j in enumerate(order)]
    return out + [out[3], out[3], (None, prose(60)), (None, None)]


def frame(spark, pairs):
    return spark.createDataFrame([(i, t, "en", "s", 7, "x", 1, "k", 2, "y") for i, t in pairs], EDGE)


def order(i):
    return -(1 << 63) if i is None else i


def kept_substrings(pairs, window, units):
    """Positions removed from each row's units, given that a window may not start in an earlier document."""
    first, key = {}, bytes if units is bytes else tuple
    for i, u in pairs:
        for j in range(len(u) - window + 1):
            w = key(u[j:j + window])
            first[w] = min(first.get(w, order(i)), order(i))
    for i, u in pairs:
        gone = [False] * len(u)
        for j in range(len(u) - window + 1):
            if first[key(u[j:j + window])] < order(i):
                gone[j:j + window] = [True] * window
        yield i, u, gone


def suffixes(pairs):
    for i, u, gone in kept_substrings([(i, (t or "").encode()) for i, t in pairs], 50, bytes):
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        yield i, len(u), sum(gone), runs, sha(bytes(c for c, g in zip(u, gone) if not g))


def substrings(pairs):
    for i, u, gone in kept_substrings([(i, BARE.findall(t or "")) for i, t in pairs], 50, list):
        yield i, len(u), sum(gone), sha(" ".join(w for w, g in zip(u, gone) if not g))


def key_of(line):
    return line.strip("\x20\x09\x0a\x0b\x0c\x0d").translate(ASCII_LOWER)


def lines(pairs, min_docs=5):
    found = collections.defaultdict(set)
    for i, t in pairs:
        for x in (t or "").split("\n"):
            if len(key_of(x)) >= 40:
                found[key_of(x)].add(order(i))
    last = {k: max(v) for k, v in found.items() if len(v) >= min_docs}
    for i, t in pairs:
        all_ = (t or "").split("\n")
        stay = [x for x in all_ if last.get(key_of(x), order(i)) <= order(i)]
        yield i, len(all_), len(all_) - len(stay), "\n".join(stay)


def words(text):
    return WORD.findall((text or "").translate(ASCII_LOWER))


def leaks(pairs, items, window=10):
    sets = {}
    for item, text in items:
        w = words(text)
        k = min(window, len(w))
        if item is not None and k:
            for j in range(len(w) - k + 1):
                sets.setdefault(tuple(w[j:j + k]), set()).add(str(item))
    sizes = {len(k) for k in sets}
    for i, t in pairs:
        w, hit, names = words(t), set(), set()
        for k in sizes:
            for j in range(len(w) - k + 1):
                found = sets.get(tuple(w[j:j + k]))
                if found:
                    names |= found
                    hit.update(range(j, j + k))
        yield i, len(w), len(hit), len(names), sha(",".join(sorted(names))), bool(hit)


def base_counts(text):
    text = text or ""
    w, seen, dup, cover = BARE.findall(text), set(), 0, set()
    for x in text.split("\n"):
        if BARE.search(x):
            dup += x in seen
            seen.add(x)
    five = [tuple(w[j:j + 5]) for j in range(len(w) - 4)]
    count = collections.Counter(five)
    for j, x in enumerate(five):
        if count[x] > 1:
            cover.update(range(j, j + 5))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(cover), len(w) < 10 or 100 * len(cover) > 20 * len(w)


def roots(nodes, edges):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        a, b = sorted((find(a), find(b)), key=order)
        up[b] = a
    return {n: find(n) for n in nodes}


def bag(text, size=5):
    w = words(text)
    return collections.Counter(tuple(w[j:j + size]) for j in range(len(w) - size + 1)) if len(w) >= size else collections.Counter([tuple(w)] if w else [])


def near_rows(pairs, least=0.8):
    """The group of each row: the least id among the rows near it, directly or through others."""
    bags = [bag(t) for _, t in pairs]
    edges = []
    for a, x in enumerate(bags):
        for b, y in enumerate(bags[:a]):
            both = sum((x & y).values())
            if both and both >= least * (sum(x.values()) + sum(y.values()) - both):
                edges.append((a, b))
    up = roots(range(len(pairs)), edges)
    least_id = {}
    for k, (i, _) in enumerate(pairs):
        least_id[up[k]] = min(least_id.get(up[k], order(i)), order(i))
    return [(i, None if least_id[up[k]] == order(None) else least_id[up[k]]) for k, (i, _) in enumerate(pairs)]


def near_groups(pairs, least=0.8):
    return dict(near_rows(pairs, least))


def agenda(chunk, rank, dropped):
    """Pieces of a chunk: again and again the best-ranked pair, leftmost first, is skipped for good or merged."""
    part, struck = [(k, c) for k, c in enumerate(chunk)], set()
    while True:
        found = [(rank[x + y], i, k) for k, ((i, x), (_, y)) in enumerate(zip(part, part[1:])) if x + y in rank and (i, x, y) not in struck]
        if not found:
            return [x for _, x in part]
        r, i, k = min(found)
        if dropped(r, i):
            struck.add((i, part[k][1], part[k + 1][1]))
        else:
            part[k:k + 2] = [(i, part[k][1] + part[k + 1][1])]


def collocations(rows, least, share=80, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) of rows (text, lang), phrase by phrase."""
    f, total = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(ASCII_LOWER)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            total[lang] += len(w)
            for k in range(1, 5):
                f.update((lang, tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    f = {x: n for x, n in f.items() if n >= least}
    most = collections.Counter()
    for (lang, w), n in f.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                most[lang, w[i:i + k]] = max(most[lang, w[i:i + k]], n)
    found = collections.defaultdict(list)
    for (lang, w), a in f.items():
        if len(w) > 1 and 100 * most[lang, w] < share * a:
            score, _, left, right = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            found[lang].append((-score, -a, " ".join(w).encode(), left, right))
    for lang, rows_ in found.items():
        for rank, (s, a, phrase, left, right) in enumerate(sorted(rows_)[:top], 1):
            yield lang, rank, phrase.decode(), -a, left, right, total[lang], -s


def vector_codes(rows, rounds=6):
    """(vec_id, code, error, label_error, codebook) of rows (vec_id, vector, label), part by part."""
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    width = -(-max((len(v) for _, v, _ in kept), default=0) // 8) * 8
    cut = [[(v + [0] * (width - len(v)))[p * width // 8:(p + 1) * width // 8] for p in range(8)] for _, v, _ in kept]
    books = [[list(v[p]) for v in cut[:16]] for p in range(8)]

    def assigned():
        return [[min((sum((a - b) ** 2 for a, b in zip(v[p], e)), k) for k, e in enumerate(books[p])) for p in range(8)] for v in cut]

    for _ in range(rounds):
        at = assigned()
        for p in range(8):
            for k in range(len(books[p])):
                of = [v[p] for v, a in zip(cut, at) if a[p][1] == k]
                if of:
                    books[p][k] = [sum(x) // len(of) for x in zip(*of)]
    at, total = assigned(), collections.Counter()
    for (_, _, label), a in zip(kept, at):
        total[label] += sum(d for d, _ in a)
    book = sha(",".join(str(x) for p in books for e in p for x in e))
    for (i, _, label), a in zip(kept, at):
        yield i, "".join(f"{k:02x}" for _, k in a), sum(d for d, _ in a), total[label], book


def weak_supervision(votes, can_vote_good, rounds):
    """Posterior of a good text for each row of votes (-1, 0, 1), by expectation-maximisation over the rows themselves."""
    prior, on_bad, on_good = 0.8, [0.5] * len(can_vote_good), [0.03] * len(can_vote_good)

    def posteriors():
        for row in votes:
            g, b = prior, 1 - prior
            for vote, x, y in zip(row, on_bad, on_good):
                if vote:
                    g, b = g * (y if vote < 0 else 1 - y), b * (x if vote < 0 else 1 - x)
            yield g / (g + b)

    for _ in range(rounds):
        p = list(posteriors())
        shares = []
        for k, can in enumerate(can_vote_good):
            spoke = [(row[k], q) for row, q in zip(votes, p) if row[k] or not can]
            shares.append([(sum(w for v, w in ws if v < 0) + a) / (sum(w for _, w in ws) + 2)
                           for ws, a in (([(v, 1 - q) for v, q in spoke], 1), (spoke, 0.06))])
        prior = min(0.99, max(0.01, sum(p) / len(p)))
        on_good = [min(0.9, max(0.001, y)) for _, y in shares]
        on_bad = [min(0.999, max(x, 1.05 * y)) for (x, _), y in zip(shares, on_good)]
    return list(posteriors())


def letters(text):
    """Lower-case words of letters, a word after itself left out, joined by one space."""
    out, word = [], ""
    for c in text.lower() + " ":
        if c.isalnum() and not c.isdecimal():
            word += c
        elif word:
            out += [word] if out[-1:] != [word] else []
            word = ""
    return " ".join(out).encode()


def compressed_size(data, dictionary, carrier):
    """Bytes that zstandard needs for a text after a dictionary that ends with the carrier; every coder is a fresh one."""
    import zstandard

    def size(part, level):
        raw = zstandard.ZstdCompressionDict(dictionary + carrier, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        raw.precompute_compress(level=level)
        return len(zstandard.ZstdCompressor(level=level, dict_data=raw, write_content_size=False, write_checksum=False, write_dict_id=False).compress(part))

    return size(carrier + data, 12) if len(data) < 256 else sum(size(data[i:i + 1024], 6) for i in range(0, len(data), 1024))


def language(text, dictionaries, carrier, narrow=0.01):
    """(language, rejected): the smallest of all sizes, equal ones by name."""
    data = letters(text or "")
    if not any(c.isalpha() for c in text or "") or not dictionaries:
        return "und", True
    sizes = sorted((compressed_size(data, d, carrier), name) for name, d in dictionaries.items())
    margin = 1 - sizes[0][0] / sizes[1][0] if len(sizes) > 1 else 1
    return sizes[0][1], margin == 0 or margin < narrow
