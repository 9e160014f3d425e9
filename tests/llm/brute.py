"""The training-data operators once more, in plain Python without vectors, sketches or Spark."""

import hashlib
import math
import re
from collections import Counter, defaultdict

from parchmill.llm import fertility, line_dedup, vocabularies

PIECES, BYTES = "piece_bpe_32k.model", "byte_bpe_50k.tiktoken"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def hits(text, items, n=13):
    """n_words, n_hit, n_items, items_sha256, contaminated."""
    w, hit, found = alnum(text), set(), set()
    for item, t in items:
        b = alnum(t)
        k = min(n, len(b))
        grams = {tuple(b[i : i + k]) for i in range(len(b) - k + 1)} if k else set()
        for i in range(len(w) - k + 1 if k else 0):
            if tuple(w[i : i + k]) in grams:
                hit |= set(range(i, i + k))
                found.add(item)
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def base_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    times = Counter(grams)
    repeat = len({i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(3)})
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), repeat, len(w) < 50 or 100 * repeat > 50 * len(w)


def measures(text):
    """n_pieces, piece_chars, byte_chars, fallback, entropy."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    model, coder = vocabularies.pieces(vocabularies.public(PIECES)), vocabularies.byte_ranks(vocabularies.public(BYTES))
    ids = [i for x in w for i in model.encode(x)]
    chars, n = sum(map(len, w)), max(1, len(ids))
    n_bytes = max(1, sum(len(coder.encode_ordinary(" " + x)) for x in w))
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(ids).values())
    return len(ids), chars / n, chars / n_bytes, sum(model.is_byte(i) for i in ids) / n, entropy


def band_name(text, lang):
    if lang in fertility.BANDS:
        return lang
    t = text or ""
    ascii_letters = sum(c.upper() in LETTERS and c.isascii() for c in t)
    return "latin" if ascii_letters >= sum(ord(c) >= 0x280 for c in t) else "other"


def fertility_kept(rows, min_docs=fertility.MIN_DOCS, spread=fertility.SPREAD):
    """Whether each (text, lang) is kept."""
    judged = []
    for text, lang in rows:
        m = measures(text)
        judged.append((base_counts(text)[5], band_name(text, lang), int(math.log2(max(1, m[0]))), m[1:]))
    kinds = defaultdict(set)
    for failed, band, size, m in judged:
        if not failed:
            kinds[band, size].add(tuple(math.floor(min(x, fertility.TOP) / fertility.BIN + 0.5) for x in m))

    def limits(band, size):
        sizes = [s for b, s in kinds if b == band and len(kinds[b, s]) >= min_docs]
        if not sizes:
            return [(-math.inf, math.inf)] * 4
        found, out = kinds[band, min(sizes, key=lambda s: (abs(s - size), s))], []
        for k, name in enumerate(fertility.MEASURES):
            ranked = sorted(x[k] for x in found)
            low, high = (next(v for i, v in enumerate(ranked) if i + 1 >= q * len(ranked)) * fertility.BIN for q in (0.25, 0.75))
            reach = max(spread * (high - low), fertility.SLACK[name])
            out.append((low - reach, high + reach))
        return out

    out = []
    for failed, band, size, m in judged:
        fixed = [fertility.BANDS[band][name] for name in fertility.MEASURES]
        out.append(not failed and all(a <= x <= b and c <= x <= d for x, (a, b), (c, d) in zip(m, fixed, limits(band, size) if not failed else fixed)))
    return out


def cleaned(rows, ratio=line_dedup.RATIO, min_pages=line_dedup.MIN_PAGES):
    """The texts of (text, host) without their hosts' boilerplate lines."""
    trim = lambda x: x.strip(line_dedup.BLANKS)
    pages = defaultdict(set)
    for text, host in rows:
        pages[host or ""].add(text or "")
    drop = set()
    for host, texts in pages.items():
        times = Counter(line for t in texts for line in {trim(x) for x in t.split("\n")} - {""})
        drop |= {(host, line) for line, n in times.items() if n >= min_pages and n > ratio * len(texts)}
    return [None if t is None else "\n".join(x for x in t.split("\n") if (h or "", trim(x)) not in drop) for t, h in rows]


def near_groups(texts, threshold=0.8):
    """The smallest index of each text's component; texts without words are alone."""
    sets = []
    for t in texts:
        w = alnum(t)
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None)
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, x in enumerate(sets):
        for b in range(a):
            y = sets[b]
            if x and y and len(x & y) >= threshold * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return [find(k) for k in range(len(texts))]


def marginals(emission, trans):
    """P(tag 1) of each token of one chain, by sums over tags in plain loops."""
    n = len(emission)
    score = lambda k, y: math.exp(emission[k] * y)
    ahead = [[score(0, 0), score(0, 1)]]
    for k in range(1, n):
        ahead.append([sum(ahead[-1][a] * math.exp(trans[a][y]) for a in (0, 1)) * score(k, y) for y in (0, 1)])
        total = sum(ahead[-1])
        ahead[-1] = [x / total for x in ahead[-1]]
    back = [[1.0, 1.0]]
    for k in range(n - 2, -1, -1):
        back.append([sum(math.exp(trans[y][b]) * score(k + 1, b) * back[-1][b] for b in (0, 1)) for y in (0, 1)])
        total = sum(back[-1])
        back[-1] = [x / total for x in back[-1]]
    back.reverse()
    return [a[1] * b[1] / (a[0] * b[0] + a[1] * b[1]) for a, b in zip(ahead, back)]
