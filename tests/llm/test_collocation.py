"""Collocations against a plain count, with shards of many sizes and odd inputs."""

import random
import re
from collections import Counter

import numpy as np

from windrow.llm import collocation

KINDS = "doc_id long, text string, lang string, a int, phrase string"


def brute(rows, least, most):
    """(lang, rank, phrase, a, l, r, n, score) by counting everything."""
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            f.update((lang, tuple(ws[i:i + k])) for k in (1, 2, 3, 4) for i in range(len(ws) - k + 1))
    candidates = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in candidates.items():
        cuts = [(2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        inside = any(100 * b >= 80 * a for (x, q), b in candidates.items() if x == lang and len(q) > len(p)
                     and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)))
        if not inside:
            out.setdefault(lang, []).append((score, a, " ".join(p), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p, a, l, r, n[lang], s) for lang, found in out.items()
                  for i, (s, a, p, l, r) in enumerate(sorted(found, key=lambda x: (-x[0], -x[1], x[2].encode()))[:most]))


def rows_of(seed, n):
    r = random.Random(seed)
    words = ["the", "of", "New", "York", "é", "É", "漢字", "\x00", "a", "b-c", "x"]
    out = []
    for i in range(n):
        text = "".join(r.choice(words) + r.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", "\x0b", "?!", " "])
                       for _ in range(r.randint(0, 40)))
        out.append((i, text + "new york of the " * r.randint(0, 3), r.choice(["en", "en", "en", None, "und", "de"]), 1, "clash"))
    return out + [(None, None, "en", 1, None), (1, "", "en", 1, None), (1, " . ,", "xx", 1, None), out[-1], out[-1],
                  (9, "very long text here " * 3000, "en", 1, None)]


def test_as_plain_counts(spark, monkeypatch):
    rows = rows_of(1, 150)
    want = brute(rows, 4, 15)
    df = spark.createDataFrame(rows, KINDS)
    assert len(want) > 30
    for size, parts in ((1 << 20, 1), (300, 3), (20, 7)):
        monkeypatch.setattr(collocation, "SHARD", size)
        found = collocation.collocations(df.repartition(parts), least=4, most=15)
        assert sorted(map(tuple, found.collect())) == want


def test_empty(spark):
    assert collocation.collocations(spark.createDataFrame([], KINDS)).collect() == []
    assert collocation.collocations(spark.createDataFrame([(1, "a b", "en", 1, "")], KINDS)).collect() == []


def test_slices(monkeypatch):
    monkeypatch.setattr(collocation, "SLICE", 5)
    got = collocation.END.join(collocation.slices("Ab, cd. ef gh ij kl mn; op"))
    assert got.split(collocation.END) == [b"ab", b" cd", b" ef gh ij kl mn", b" op"]
    assert list(collocation.slices("")) == []


def test_index_extends_both_ways():
    r = np.random.default_rng(2)
    for many in (4, 40, 70000):
        s = np.concatenate([[0], r.integers(0, many, 500), [0]]).astype(np.int32)
        counts = np.bincount(s, minlength=many)  # beyond 65,536 in four bytes
        sides = [collocation.narrow(collocation.last_column(x), len(counts)).tobytes() for x in (s, s[::-1].copy())]
        x = collocation.Index(counts, *sides, np.arange(len(counts)))
        for steps in ("LRL", "RLR", "LLL", "RRR"):
            p = x.words()
            for i, step in enumerate(steps):
                p = x.to_left(p) if step == "L" else x.to_right(p)
                want = Counter(t for k in range(len(s) - i - 1) if 0 not in (t := tuple(s[k:k + i + 2].tolist())))
                assert {tuple(w): c for w, c in zip(p.words.tolist(), p.size.tolist())} == want
