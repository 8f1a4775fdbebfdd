"""Quality rules by tokeniser fertility against plain counts and the libraries."""

import math
import random
import re
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece

from windrow.llm import fertility, queries

PIECES, RANKS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
KINDS = "doc_id long, text string, lang string, measures int, n_words string"


def plain_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    repeated = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 8)}
    seen, same = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            same += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), same, len(repeated))


def texts():
    r = random.Random(3)
    some = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 4))) for _ in range(30)]
    out = ["", None, " \n\t", "one", "a\n\na\n a\na", "漢字 " * 30, "x" * 20000, " ".join(some) * 400, "don't WE'LL 12 ▁x  👩‍👩"]
    for _ in range(60):
        words = [r.choice(some) for _ in range(r.randint(1, 60))]
        out.append("".join(w + r.choice([" ", " ", " ", "\n", "  ", " \n", "\n ", "\x0b", " "]) for w in words * r.randint(1, 2)))
    return out + out[-2:]


def test_measures_as_plain_counts(spark):
    rows = [(i, t, r, 7, "clash") for i, t in enumerate(texts()) for r in ("en", None, "tlh")] + [(None, "no id", "en", 1, "")]
    df = spark.createDataFrame(rows, KINDS)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    ranks = fertility.Ranks(open(RANKS, "rb").read(), public_tokenizers.PATTERN)
    found = fertility.measure(df, PIECES, RANKS, public_tokenizers.PATTERN).collect()
    assert len(found) == len(rows)
    for r in found:
        text, m = r.text or "", r.measures
        base = plain_base(text)
        assert tuple(m)[:5] == base
        assert m.base_failed == (base[0] < 20 or 100 * base[4] > 30 * base[0])
        ids = library.encode(text)
        assert m.n_tokens == len(ids)
        if ids:
            assert m.chars_per_token == len(text) / len(ids)
            assert m.rank_chars_per_token == len(text) / len(ranks.ids(text))
            assert m.byte_share == sum(map(library.is_byte, ids)) / len(ids)
            entropy = sum(-n / len(ids) * math.log2(n / len(ids)) for n in Counter(ids).values())
            assert m.entropy == pytest.approx(entropy, abs=1e-9)
    assert fertility.measure(df.limit(0), PIECES, RANKS, public_tokenizers.PATTERN).count() == 0


def test_parts_that_are_forgotten(monkeypatch):
    monkeypatch.setattr(fertility, "KEPT", 5)
    with open(PIECES, "rb") as p, open(RANKS, "rb") as r:
        known = fertility.Known(fertility.Pieces(p.read()), fertility.Ranks(r.read(), public_tokenizers.PATTERN))
    for t in texts():
        (row,) = fertility.measured([t], ["en"], known)
        assert row[6] == len(known.vocabularies[0].ids(t or ""))


def test_bands():
    assert fertility.band("Größe und Maß", "de")[0] == "de"
    assert fertility.band("Größe und Maß", "xx")[0] == "latin"
    assert fertility.band("漢字漢字", "en")[0] == "han"
    assert fertility.band("Привет, мир", None)[0] == "cyrillic"
    assert fertility.band("12 34", None)[0] == "other"


def test_junk_goes_and_prose_stays(spark):
    folder, r = "/root/testdata/sf0.01", random.Random(4)
    docs = spark.read.parquet(f"{folder}/documents.parquet").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    prose = [(d.text, d.lang) for d in docs.where("quality = 1").collect() if not fertility.base(d.text).failed]
    junk = [("".join(w + r.choice(["***", "$$$", "%%%", "&&&"]) + " " for w in t.split()), lang) for t, lang in prose[:50]]
    junk += [("\x01\x02\x03 " * 50, "en"), (" ".join("zq" for _ in range(400)), "en")]
    rows = [(i, t, lang, 1, "") for i, (t, lang) in enumerate(prose + junk)]
    found = fertility.measure(spark.createDataFrame(rows, KINDS), PIECES, RANKS, public_tokenizers.PATTERN)
    stays = {r.doc_id for r in found.where(fertility.kept()).collect()}
    assert stays == set(range(len(prose)))


def test_query(spark):
    found = queries.op11_quality_rules(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    rows = {r.doc_id: r for r in found.collect()}
    assert len(rows) == len(docs)
    for d in docs:
        r = rows[d.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_base(d.text or "")
        assert not (r.kept and r.base_failed)
