"""Plain versions of the operators, and documents with every odd case."""

import hashlib
import math
import re
import string
from collections import Counter, defaultdict

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SPACE = " \t\n\x0b\x0c\r"
EXTRA = ["pos", "line", "row", "did", "t", "h1", "tid", "key", "node", "label", "word", "term", "th", "uid", "bytes", "id", "depth", "pack", "win"]


def odd_texts():
    prose = " ".join(f"word{i % 37} thing{i % 11} matter{i}" for i in range(60))
    near = prose.replace("matter17", "matterX")
    lines = "A shared line of text\nown line number one here\n\nA shared line of text \nshort"
    return [prose, prose, near, lines, "a SHARED line of text\nanother own line\r\n\tA shared line of text", "", None, " \n\t ", "one",
            "four words are few", "x" * 3000, "ab " * 4000, "Über Straße ÉTÉ naïve ζΣσ nbsp  sep é <|endoftext|> end",
            prose + "\n" + lines, "1234 5678 " + prose[:200], "\n\n\n", "tail " + "long text " * 3000]


def odd_rows():
    """(id, text): ids from 0, then repeated rows, a repeated id, and null ids."""
    rows = list(enumerate(odd_texts()))
    return rows + [(0, odd_texts()[0]), (3, odd_texts()[3]), (3, odd_texts()[3]), (5, "another text under a used id, words enough"), (None, odd_texts()[3]), (None, None)]


def frame(spark, rows, extra=True):
    schema = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in EXTRA) if extra else "doc_id long, text string"
    return spark.createDataFrame([(*r, *(["x"] * len(EXTRA) if extra else [])) for r in rows], schema)


NONE = 2**63 - 1


def known(i):
    return NONE if i is None else i


def line_dedup(rows, least=10):
    key = lambda x: x.strip(SPACE).translate(LOWER)
    holders = defaultdict(set)
    for i, x in rows:
        for line in (x or "").split("\n"):
            if len(key(line)) >= least:
                holders[key(line)].add(known(i))
    out = []
    for i, x in rows:
        lines = (x or "").split("\n")
        kept = [y for y in lines if len(holders[key(y)]) < 2 or min(holders[key(y)]) == known(i)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def decontaminate(rows, items, size=10):
    windows = defaultdict(set)
    for i, x in items:
        w = WORD.findall((x or "").translate(LOWER))
        for k in range(max(len(w) - size + 1, min(len(w), 1))):
            windows[tuple(w[k:k + size])].add("null" if i is None else str(i))
    out = []
    for i, x in rows:
        w = WORD.findall((x or "").translate(LOWER))
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k:k + n])]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def words(x, lower=True):
    return re.findall(r"[^\x20\x09-\x0D]+", (x or "").translate(LOWER) if lower else x or "")


def shingles(x):
    w = words(x)
    return frozenset(tuple(w[j:j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(rows, percent=85):
    """(id, set size, smallest id of the component) of each row."""
    sets = [shingles(x) for _, x in rows]
    up = list(range(len(rows)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                up[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[top(k)] = min(least.get(top(k), NONE), known(i))
    return [(i, len(sets[k]), None if least[top(k)] == NONE else least[top(k)]) for k, (i, _) in enumerate(rows)]


def passages(rows, size=50):
    first = {}
    for i, x in rows:
        b = (x or "").encode()
        for j in range(len(b) - size + 1):
            first[b[j:j + size]] = min(first.get(b[j:j + size], NONE), known(i))
    out = []
    for i, x in rows:
        b = (x or "").encode()
        gone = [False] * len(b)
        for j in range(len(b) - size + 1):
            if first[b[j:j + size]] < known(i):
                gone[j:j + size] = [True] * size
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and (q == 0 or not gone[q - 1]) for q, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def quality_counts(x):
    x = x or ""
    w = words(x, lower=False)
    times = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    again = {k for i in range(len(w) - 7) if times[tuple(w[i:i + 8])] > 1 for k in range(i, i + 8)}
    lines = [y for y in x.split("\n") if words(y)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), len(lines) - len(set(lines)), len(again))


def same(got, want):
    """Equal rows in any order, nulls and all."""
    sort = lambda rows: sorted(map(tuple, rows), key=lambda r: tuple((x is None, str(x)) for x in r))
    assert sort(got) == sort(want)


def exact_copies(rows):
    """(id, keep id, group size, kept, digest): of rows that tie on the smallest id the first stays."""
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", x or "") for _, x in rows]
    groups = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        groups[norm[k]].append((known(i), k))
    out = []
    for k, (i, _) in enumerate(rows):
        least, first = min(groups[norm[k]])
        out.append((i, None if least == NONE else least, len(groups[norm[k]]), first == k, hashlib.sha256(norm[k].encode()).hexdigest()))
    return out


def fill_in_middle(rows, seed=1):
    """(id, n, form, prefix and middle code points, digests of output and text), and the outputs."""
    out, texts = [], []
    for i, x in rows:
        x = x or ""
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", x)
        h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
        a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
        p, m, s = ("".join(y) for y in (units[:a], units[a:b], units[b:]))
        plain = not x or any(y in x for y in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90
        form = "plain" if plain else "spm" if h4 % 100 < 20 else "psm"
        texts.append({"plain": x, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form])
        digest = lambda y: hashlib.sha256(y.encode()).hexdigest()
        out.append((i, len(units), form, None if plain else len(p), None if plain else len(m), digest(texts[-1]), digest(x)))
    return out, texts


def vector_codes(rows, parts=16, entries=64, rounds=2):
    """(id, code, error, label error) of (id, vector, label) rows, and the codebooks."""
    fine = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    kept = sorted((known(i), [math.floor(256 * x) for x in v], (lab is None, lab)) for i, v, lab in rows if fine(v))
    dims = next((len(v) for _, v, _ in kept if v and len(v) % parts == 0), 0)
    kept = [r for r in kept if dims and len(r[1]) == dims]
    w = dims // parts
    cut = [[tuple(v[p * w:(p + 1) * w]) for _, v, _ in kept] for p in range(parts)]
    books = [list(c[:entries]) for c in cut]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda p: [min((far(x, e), k) for k, e in enumerate(books[p])) for x in cut[p]]
    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for x, (_, k) in zip(cut[p], near(p), strict=True):
                own[k].append(x)
            books[p] = [tuple(sum(c) // len(c) for c in zip(*own[k], strict=True)) if k in own else e for k, e in enumerate(books[p])]
    last = [near(p) for p in range(parts)]
    error = [sum(last[p][j][0] for p in range(parts)) for j in range(len(kept))]
    by = Counter()
    for (_, _, lab), e in zip(kept, error, strict=True):
        by[lab] += e
    return [(None if i == NONE else i, "".join(f"{last[p][j][1]:02x}" for p in range(parts)), error[j], by[lab])
            for j, (i, _, lab) in enumerate(kept)], books
