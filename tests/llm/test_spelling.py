"""Spelling variants against comparing all words with all."""

import random
import re
import zlib
from collections import Counter

import numpy as np

from windrow.llm import spelling

KINDS = "doc_id long, text string, word string, n int, form int"


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows):
    total = Counter()
    for id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if id is None else id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            total[run] += 1
    known = {w: n for w, n in total.items() if len(w) >= 7 and n >= 2}
    form, out = {}, []
    near = {w: [v for v in known if one_edit(w, v)] for w in known}
    for w, n in known.items():
        best = min(near[w], key=lambda v: (-known[v], v), default=None)
        form[w] = best if best and known[best] >= 10 * n else None
    for w, n in known.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), known[form[w]] if form[w] else None))
    return sorted(out, key=lambda x: x[0])


def rows_of(seed, n):
    r = random.Random(seed)
    base = ["".join(r.choice("abcdeéÿÀ") for _ in range(r.randint(6, 11))) for _ in range(40)]

    def word():
        w = r.choice(base[:5] if r.random() < 0.7 else base)
        if r.random() < 0.1:
            i = r.randrange(len(w) + 1)
            w = w[:i] + r.choice(["", "a", "é", "z"]) + w[i + r.randint(0, 1):]
        return w.upper() if r.random() < 0.1 and w.isascii() else w

    out = [(i, " ".join(word() for _ in range(r.randint(0, 60))) + "-Straße1abcdefg", "clash", 1, 1) for i in range(n)]
    return out + [(None, "nullid nullids nullidsx", None, 1, 1), (3, None, "", 1, 1), (3, "", "", 1, 1), out[0], out[0],
                  (77, "z" * 3000 + " " + "z" * 3000 + " " + "z" * 2999, "", 1, 1),
                  (78, "z" * 3000 + " " + "z" * 2999, "", 1, 1), (5, base[0] + " " * 5000 + (base[0] + " ") * 5000, "", 1, 1)]


def test_as_plain_comparison(spark):
    rows = rows_of(1, 200)
    want = brute(rows)
    assert sum(1 for w in want if w[1]) > 20
    found = spelling.variants(spark.createDataFrame(rows, KINDS).repartition(5))
    assert sorted(map(tuple, found.collect())) == want


def test_forms_lead_on(spark):
    chain = ["aaaaaaa", "aaaaaab", "aaaaabb", "aaaabbb", "aaabbbb"]
    rows = [(i, " ".join(w for w, n in zip(chain, (2, 20, 200, 2000, 20000)) for _ in range(n)), "", 1, 1) for i in (None,)]
    found = spelling.variants(spark.createDataFrame(rows, KINDS))
    assert sorted(map(tuple, found.collect())) == brute(rows)


def test_empty(spark):
    assert spelling.variants(spark.createDataFrame([], KINDS)).collect() == []


def test_neighbourhood_is_complete():
    r = random.Random(2)
    for _ in range(300):
        n = r.randint(1, 25)
        a = [r.randint(1, spelling.SYMBOLS) for _ in range(n)]
        i, b = r.randrange(n), list(a)
        kind = r.randrange(3)
        if kind == 0 and n > 1:
            del b[i]
        elif kind == 1:
            b[i] = r.randint(1, spelling.SYMBOLS)
        else:
            b.insert(r.randint(0, n), r.randint(1, spelling.SYMBOLS))
        own = spelling.neighbourhood(np.array([a], np.uint64))[0]
        assert len(own) == 1 + n + spelling.SYMBOLS * (2 * n + 1)
        assert spelling.mixed(spelling.prefixes(np.array([b], np.uint64))[0][:, -1])[0] in own
