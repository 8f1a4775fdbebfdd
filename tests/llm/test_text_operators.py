"""Operators on text against libraries and brute force, with nulls, empty and long texts, repeated rows and clashes."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from windrow.llm import bpe, fingerprint, mixing, near_join, quality, substring, token_count, topk, toxicity, url_filter
from windrow.llm.common import Landing, ship
from windrow.llm.training import with_labels

RND = random.Random(5)
VOCABULARY = ["".join(RND.choice("abcdefghijklmnop") for _ in range(RND.randint(3, 8))) for _ in range(3000)]


def prose(n, seed):
    r = random.Random(seed)
    return [r.choice(VOCABULARY) for _ in range(n)]


ODD = ["", None, "   \n\t ", "one", "<|endoftext|> a<|endoftext|>", "don't WE'LL 12 345, 漢字 ▁x  👩‍👩", " ".join(prose(6000, 1)),
       "x" * 5000, "same text here again", "same text here again"]
KINDS = "doc_id long, text string, ids int, n_tokens string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, 7, "clash", None) for i, t in enumerate(ODD)] + [(None, "no id", 7, None, None)]
    return spark.createDataFrame(rows, KINDS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], KINDS)


def test_bpe_round_trip(spark, odd, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for r in bpe.decode(bpe.encode(odd, path), path).collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids
        assert r.decoded == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode(none, path).count() == 0


def test_bpe_many_at_a_time_as_one_by_one():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, r = Tokenizer.from_file(path), random.Random(8)
    with open(path, "rb") as f:
        codec = bpe.Codec(f.read())
    for n in (1, 2, 3, 7, 8, 9, 16, 17, 33, 63, 64):  # on both sides of a tree's size
        pieces = ["".join(r.choice("etaoins") for _ in range(n)) for _ in range(200)] + ["a" * n, "ab" * (n // 2) + "a" * (n % 2)]
        leaves = max(2, 1 << (n - 1).bit_length())
        assert bpe.merge_many([p.encode() for p in pieces], leaves, codec) == [codec.piece(p) for p in pieces]
    texts = ["".join(r.choice("aebthin s'0é,漢\n\t") for _ in range(r.randint(0, 300))) for _ in range(500)]
    texts += ["a" * n for n in (bpe.SHORT - 1, bpe.SHORT, bpe.SHORT + 1)] + [" b" * bpe.GROUP, "", "after a long text"]
    got = list(codec.encode_all(texts))
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [
        e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert list(codec.encode_all([])) == [] and list(codec.encode_all([None])) == [b""]


def test_token_count(spark, odd, none):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in token_count.count_tokens(odd, path).collect():
        assert r.n_tokens == len(library.encode(r.text or ""))
    assert token_count.count_tokens(none, path).count() == 0


def test_top_k(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.integers(-2, 3, 6) / 256]) for i in range(300)]
    rows += [(300, None), (301, [None] * 6), (302, [float("nan")] * 6), (None, rows[0][1]), (304, []), (305, [0.5, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(x.query_id, x["rank"]): (x.vec_id, x.score) for x in topk.top_k(df, F.col("vec_id") % 50 == 0, 5).collect()}
    whole = {i: np.floor(256 * np.array(v)).astype(int) for i, v in rows[:300]}
    for q in range(0, 300, 50):
        best = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:5]
        assert [got[q, n + 1] for n in range(5)] == [(i, -s) for s, i in best]
    assert len(got) == 30
    assert topk.top_k(df.where("false"), F.lit(True)).count() == 0


def test_url_rules(spark):
    rules = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "a.example.com/d")]
    urls = {"http://x.NET/": "net/", "http://x.net": None, "https://m.example.net/en/1?x": "example.net/en/", None: None,
            "example.net/en/": None, "http://b.a.example.com/de/": "a.example.com/d", "http://example.com/de": None,
            "http://c.example.com/de/x#y": "example.com/de/", "http://.net/": "net/", "http://xnet/": None, "://": None}
    rows = spark.createDataFrame([(u, "clash") for u in urls], "url string, host string")
    for r in url_filter.judge(rows, rules).collect():
        assert r.rule == urls[r.url], r
        assert r.verdict == ({b: a for a, b in rules}.get(r.rule) or "allow")
    assert url_filter.judge(rows.where("false"), rules).count() == 0


def test_fingerprints_estimate_similarity(spark, odd, none):
    texts = [" ".join(prose(400, 9)[:300 + 10 * i] + prose(400, 20 + i)[:100]) for i in range(12)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = sorted(fingerprint.fingerprints(df).collect())
    miss = []
    for a, b in zip(rows, rows[1:]):
        x, y = Counter(texts[a.doc_id].split()), Counter(texts[b.doc_id].split())
        true = sum((x & y).values()) / sum((x | y).values())
        miss.append(a.near_next - true)
        n = len(texts[a.doc_id])
        edited = texts[a.doc_id][:n - n // 4] + texts[b.doc_id][:n // 4]
        import hashlib
        assert a.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert abs(np.mean(miss)) < 0.1
    got = {r.doc_id: r for r in fingerprint.fingerprints(odd).collect()}
    assert len(got) == len(ODD) + 1 and got[8].fingerprint == got[9].fingerprint != ""
    assert got[0].fingerprint == got[1].fingerprint == got[2].fingerprint == ""
    assert fingerprint.fingerprints(none).count() == 0


def brute_classes(texts, k, num, den):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    above = {i: i for i in texts}

    def top(i):
        while above[i] != i:
            i = above[i]
        return i
    for a in texts:
        for b in texts:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                p, q = sorted((top(a), top(b)))
                above[q] = p
    return {i: (len(sets[i]), top(i)) for i in texts}


@pytest.mark.parametrize("k,num", [(4, 85), (5, 80), (1, 60)])
def test_near_classes_equal_brute_force(spark, odd, none, k, num):
    r, texts = random.Random(k), dict(enumerate(ODD))
    common = prose(40, 77)
    for g in range(25):
        base = prose(r.choice([3, 6, 9, 15, 40, 200]), 100 + g) + (common if g % 3 == 0 else [])
        for _ in range(r.randint(1, 12)):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 30))):
                w[r.randrange(len(w))] = r.choice(VOCABULARY)
            texts[len(texts)] = " ".join(w)
    df = spark.createDataFrame([*texts.items(), (None, "no id")], "doc_id long, text string")
    got = {x.doc: (x.n_shingles, x.component) for x in near_join.near_classes(df, k, num, 100).collect()}
    assert got.pop(None)[1] is None
    assert got == brute_classes(texts, k, num, 100)
    assert near_join.near_classes(none).count() == 0


@pytest.mark.parametrize("num", [20, 34, 50, 51])
def test_low_thresholds_equal_brute_force(spark, num):
    r = random.Random(num)
    texts = {0: "a", 1: "a b", 2: "", 3: None} | {4 + i: " ".join(r.sample(VOCABULARY[:60], r.choice([1, 1, 2, 3, 4, 9])))
                                                for i in range(45 if num > 34 else 22)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {x.doc: (x.n_shingles, x.component) for x in near_join.near_classes(df, 1, num, 100).collect()}
    assert got == brute_classes(texts, 1, num, 100)


def test_equal_words_in_order():
    def table(x, y):
        row = [0] * (len(y) + 1)
        for w in x:
            before = 0
            for j, v in enumerate(y, 1):
                kept, row[j] = row[j], before + 1 if w == v else max(row[j], row[j - 1])
                before = kept
        return row[-1]

    r = random.Random(3)
    for _ in range(300):
        x, y = ([r.choice("abcdef") for _ in range(r.randint(0, 90))] for _ in "xy")
        assert substring.equal_in_order(x, y) == table(x, y)
    same = prose(101, 41)
    assert substring.equal_in_order(["p", *same, "q"], ["r", "s", *same, "t", "u"]) == 101
    long = prose(3000, 42)
    assert substring.equal_in_order(["p", *long], [*long[:1000], "q", "r", *long[1000:], "s"]) == 3000


def test_passage_goes_on_far_beyond_its_matches(spark):
    texts = []
    for g, tail in enumerate((0, 20, 45, 150, 400)):
        shared = prose(2 * tail + 60, 500 + g)
        cut = tail + 60
        # no three words of the tail or head are equal in a row
        changed = [f"z{i}" if (i - cut) % 3 == 0 and (i >= cut) else w for i, w in enumerate(shared)]
        texts += [prose(20, 600 + g) + shared + prose(20, 610 + g), prose(30, 620 + g) + changed + prose(30, 630 + g)]
        texts += [x[::-1] for x in texts[-2:]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc: r for r in substring.passages(df).collect() if r.ref == r.doc - 1 and r.doc % 2}
    for i, tail in enumerate((0, 20, 45, 150, 400)):
        there, back, n = got[4 * i + 1], got[4 * i + 3], 2 * tail + 60
        assert abs(there.start - 30) < 3 and abs(there.stop - 30 - n) < 4 and abs(there.ref_stop - 20 - n) < 4
        assert abs(back.start - 30) < 4 and abs(back.stop - 30 - n) < 3


def test_passages(spark, odd, none):
    shared = prose(60, 5)
    fuzzy = list(shared)
    fuzzy[20], fuzzy[41] = "other", "words"
    texts = {0: prose(80, 11) + shared + prose(30, 12), 1: prose(20, 13) + shared + prose(90, 14), 2: prose(200, 15),
             3: prose(10, 16) + fuzzy + prose(10, 17)}
    df = spark.createDataFrame([(i, " ".join(t), "x") for i, t in texts.items()] + [(9, None, "x"), (None, " ".join(shared), "x")],
                               "doc_id long, text string, doc string")
    found = substring.passages(df)
    got = {r.doc: (r.start, r.stop, r.ref, r.ref_start) for r in found.collect() if r.ref == 0}
    assert got == {1: (20, 80, 0, 80), 3: (10, 70, 0, 80)}
    cut = {r.doc_id: r.text for r in substring.without_passages(df, found).collect()}
    assert cut[1].split() == texts[1][:20] + texts[1][80:] and cut[3].split() == texts[3][:10] + texts[3][70:]
    assert cut[0] == " ".join(texts[0]) and cut[2] == " ".join(texts[2]) and cut[9] is None
    assert {r.doc for r in substring.passages(odd).collect()} == set()
    assert substring.passages(none).count() == 0


def test_first_and_previous_place_of_frequent_seeds(spark):
    shared = prose(60, 5)
    text = {i: " ".join([f"a{i}-{j}" for j in range(15)] + shared + [f"b{i}-{j}" for j in range(15)]) for i in range(110)}
    made = lambda ids: spark.createDataFrame([(i, text[i]) for i in ids], "doc_id long, text string")
    # five early copies by themselves, fewer than a task must see
    df = made(range(5)).coalesce(1).union(made(range(5, 110)).coalesce(1))
    got = {(r.doc, r.ref) for r in substring.passages(df).collect()}
    # seeds at the ends, which the words around choose, may add pairs
    assert got >= {(i, 0) for i in range(1, 110)} | {(i, i - 1) for i in range(2, 110)}
    assert got == {(r.doc, r.ref) for r in substring.passages(df.repartition(30)).collect()}


def test_passage_of_phrases_that_are_common_by_themselves(spark):
    shared = prose(60, 71)
    parts = [shared[i:i + 20] for i in range(0, 60, 10)]  # each phrase is in two others
    texts = {0: prose(500, 70)} | {1 + i: prose(30, 80 + i) + p + prose(30, 90 + i) for i, p in enumerate(parts)}
    texts |= {20: prose(9, 72) + shared + prose(7, 73)}
    texts |= {30 + i: prose(30, 180 + i) + p + prose(30, 190 + i) for i, p in enumerate(parts)}
    texts |= {50: prose(5, 74) + shared + prose(8, 75)}
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    got = {(r.doc, r.start, r.stop, r.ref, r.ref_start) for r in substring.passages(df).collect()}
    assert (50, 5, 65, 20, 9) in got


def test_a_whole_run_is_a_chain_by_itself(spark):
    kinds = "doc long, a int, span int, first struct<ref long, b int, over int>, previous struct<ref long, b int, over int>"
    found = substring.matched(spark.createDataFrame([(7, 100, 42, (3, 20, 42), None)], kinds)).orderBy("a").toPandas()
    assert set(found.doc) == {7} and set(found.ref) == {3} and set(found.a - found.b) == {80}
    assert substring.chains(found.a.to_numpy(), found.b.to_numpy()) == [list(range(len(found)))]
    assert found.a.min() == 100 and found.a.max() == 142


def test_passages_with_many_changed_words(spark):
    texts, kinds, r = [], {}, random.Random(31)
    for g in range(120):
        shared = prose(60, 3000 + g)
        every = (5, 6, 8, 10)[g % 4] if g < 80 else 0
        fuzzy = [f"z{g}-{i}" if (i % every == every - 1 if every else r.random() < 0.12) else w for i, w in enumerate(shared)]
        texts += [prose(20, 4000 + g) + shared + prose(20, 4200 + g), prose(20, 4400 + g) + fuzzy + prose(20, 4600 + g)]
        kinds[2 * g + 1] = every
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc for r in substring.passages(df).collect() if r.ref == r.doc - 1 and r.start <= 25 and r.stop >= 75}
    for every in (0, 5, 6, 8, 10):
        of = [i for i, e in kinds.items() if e == every]
        assert sum(i in got for i in of) >= 0.9 * len(of), every


def test_chains_take_the_best_order():
    a = np.array([0, 5, 10, 15, 400, 405])
    b = np.array([50, 55, 20, 65, 90, 95])
    assert substring.chains(a, b)[:2] == [[0, 1, 3], [4, 5]]


def test_a_text_is_cut_into_words_once_for_all_its_chains(spark):
    rows = spark.createDataFrame([(1, " ".join(prose(60, 1))), (2, " ".join(prose(60, 1)))], "doc long, text string")
    found = spark.createDataFrame([(2, 1, [0, 30], [0, 30]), (2, 1, [20, 57], [20, 57])],
                                  "doc long, ref long, a array<long>, b array<long>")
    made = substring.aligned(found, rows, 45, 0.8)
    lines = made._jdf.queryExecution().optimizedPlan().toString().splitlines()
    cut = [i for i, line in enumerate(lines) if "regexp_extract_all" in line]
    assert cut and not any("Join Inner" in lines[i + 1] for i in cut)
    assert {tuple(r)[:7] for r in made.collect()} == {(2, 0, 60, 1, 0, 60, 60)}


def test_near_shingles_that_few_documents_of_a_task_have_are_frequent(spark, monkeypatch):
    """Otherwise the lists of the join grow with the table."""
    rows = [(i, " ".join(prose(30, 9000 + i) + (["four", "words", "in", "many"] if i < 40 else []) + (
        ["others", "met", "less", "often"] if i < 12 else []))) for i in range(60)]
    rows += [(i, " ".join(prose(600, 9500 + i // 6))) for i in range(100, 130)]  # long ones, in equal sixes
    docs = spark.createDataFrame(rows, "doc long, text string").repartition(8)
    rule = near_join.Rule(4, 85, 100)

    def short(text):
        return near_join.shortened(near_join.shingles(text, 4))

    found = near_join.frequent(docs, rule)
    assert np.isin(short("four words in many"), found).all() and np.isin(short("others met less often"), found).all()
    long = near_join.shingles(rows[-1][1], 4)
    assert np.isin(near_join.shortened(long[near_join.counted(long)]), found).all()
    assert not np.isin(short(" ".join(prose(30, 9059))), found).any()
    monkeypatch.setattr(near_join, "HEAVY", 1)
    assert near_join.frequent(docs, rule).tolist() == short("four words in many").tolist()


def labelled(spark):
    """600 texts; every third toxic or of low quality by its words."""
    rows, labels = [], []
    for i in range(600):
        w = prose(120, 1000 + i)
        if i % 3 == 0:
            w[5::15] = [f"foul{j}" for j in range(4)] + [f"vile{VOCABULARY[(i + j) % 9]}" for j in range(4)]
        if i % 3 == 1:
            w = [x.upper() + "!!" for x in w]
        rows.append((i, " ".join(w), "clash"))
        labels.append((i, int(i % 3 != 1), int(i % 3 == 0)))
    rows += [(1000, None, None), (1001, "", None), (None, "no id", None)]
    labels += [(None, 1, 1), (2000, None, None), (0, 1, 1)]
    return (spark.createDataFrame(rows, "doc_id long, text string, score string"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_classifiers_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    for module, good in ((toxicity, lambda i: i % 3 == 0), (quality, lambda i: i % 3 != 1)):
        got = {r.doc_id: r.score for r in module.score(docs, module.fit(docs, labels)).collect()}
        assert len(got) == 603 and all(0 <= s <= 1 for s in got.values())
        out = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
        assert np.mean([(got[i] >= 0.5) == good(i) for i in out]) > 0.95
        empty = module.fit(docs.where("false"), labels.where("false"))
        assert {r.score for r in module.score(docs, empty).collect()} == {0.0}


def test_toxicity_knows_words_by_themselves(spark):
    rows = [(i, f"common words {'vile' if i % 2 else 'kind'} here") for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    kinds = "doc_id long, text string"
    model = toxicity.fit(spark.createDataFrame(rows, kinds), labels)
    # two million words that are in one document each: they are counted, but the model doesn't grow
    many = spark.range(1000, 3000).select(F.col("id").alias("doc_id"), F.expr(
        "concat_ws(' ', transform(sequence(1, 1000), x -> concat('q', id, '-', x)))").alias("text"))
    more = toxicity.fit(spark.createDataFrame(rows, kinds).union(many), labels)
    for one, other in zip((model.pairs, model.contexts, model.words), (more.pairs, more.contexts, more.words)):
        assert np.array_equal(one[0], other[0])
    for m in (model, more):
        assert m.score("common words vile here") > 0.9 and m.score("common words kind here") < 0.1
        assert m.score("") == m.score(None)


def test_toxicity_counts_every_labelled_row(spark, monkeypatch):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.expr(
        "concat('common words ', if(id % 2 = 1, 'vile', 'kind'), ' here')").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic"))
    seen, plain = [], toxicity.pair_counts
    monkeypatch.setattr(toxicity, "pair_counts", lambda rows: (seen.append(rows.count()), plain(rows))[1])
    model = toxicity.fit(docs, labels)
    known = with_labels(docs, labels, "toxic").where("y is not null")
    assert seen == [known.where(F.pmod(F.xxhash64("hash"), F.lit(toxicity.ASIDE)) != 0).count()]
    assert model.score("common words vile here") > 0.9 and model.score("common words kind here") < 0.1


def test_toxicity_discounts_do_not_grow_with_the_rows(spark):
    """Six documents among 25,600 counted ones are enough for an expression, as they are among few."""
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.expr(
        "concat('common words ', if(id % 2 = 1, 'vile', 'kind'), ' here')").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic"))
    counted = [r.doc_id for r in docs.where("doc_id % 2 = 1 and pmod(xxhash64(xxhash64(doc_id)), 5) <> 0").where(
        F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).orderBy("doc_id").limit(6).collect()]
    docs = docs.withColumn("text", F.when(F.col("doc_id").isin(counted), F.concat("text", F.lit(" rare deed"))).otherwise(F.col("text")))
    model = toxicity.fit(docs, labels)
    key = toxicity.pair_hash(*[np.array([toxicity.word_id(w)], np.uint64) for w in ("rare", "deed")])
    assert toxicity.found_in(*model.pairs, key)[1].all()


def test_toxicity_of_a_model_too_large_to_broadcast(spark, monkeypatch):
    docs, labels = labelled(spark)
    docs = docs.unionByName(docs.limit(5)).withColumn("score", F.lit("clash"))
    got = toxicity.score(docs, toxicity.fit(docs, labels))
    monkeypatch.setattr(toxicity, "MOST", 0)
    model = toxicity.fit(docs, labels)
    other = toxicity.score(docs, model)
    assert isinstance(model, toxicity.Landed) and other.columns == got.columns == docs.columns
    one, two = (sorted((r.doc_id is None, r.doc_id, r.text or "", r.score) for r in df.collect()) for df in (got, other))
    assert [r[:3] for r in one] == [r[:3] for r in two]
    assert np.allclose([r[3] for r in one], [r[3] for r in two], rtol=1e-9) and len({r[3] for r in one}) > 100


def test_toxicity_of_an_expression_of_ordinary_words(spark):
    """Words as common in both classes; only their order tells."""
    rows, labels = [], []
    for i in range(800):
        w, toxic = prose(60, 5000 + i), i % 4 == 0
        w[10:12] = ["green", "lamp"] if toxic else ["lamp", "green"]
        w[40:42] = ["green", "lamp"] if toxic else ["lamp", "green"]
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    out = [i for i in range(800) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == (i % 4 == 0) for i in out]) > 0.95


def test_toxicity_against_plain_counts(spark):
    """Counts, discounts and both backoffs of the pairs once more, one text after the other."""
    rows = [(i, " ".join(prose(30, 7000 + i)) + (" vile kind" if i % 3 == 0 else " kind vile")) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int"))
    known = with_labels(docs, spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int"), "toxic")
    counted = known.where("y is not null").where(F.pmod(F.xxhash64("hash"), F.lit(toxicity.ASIDE)) != 0).collect()
    n = [Counter(), Counter()]
    for r in counted:
        w = toxicity.tokens(r.text)
        n[1 - r.y].update(set(zip([None, *w], w)))
    every = Counter(w for _, t in rows for w in set(toxicity.tokens(t)))
    total, types = [sum(c.values()) for c in n], [len(c) for c in n]
    off, off_word = [4 * t / min(total) for t in total], [4 * t / min(types) for t in types]
    met, after, left = [Counter(w for _, w in c) for c in n], [Counter(), Counter()], [Counter(), Counter()]
    for c in (0, 1):
        for (u, _), x in n[c].items():
            after[c][u] += x
            left[c][u] += min(x, off[c])
    freed = [types[c] - sum(max(x - off_word[c], 0) for x in met[c].values()) for c in (0, 1)]
    both, pooled = n[0] + n[1], met[0] + met[1]
    spare, loose = Counter(), sum(min(x, 0.75) for x in pooled.values())
    for (u, _), x in both.items():
        spare[u] += min(x, 0.75)
    mass = sum(every.values()) + len(every) + 1

    def log_p(c, u, w):
        q = (every[w] + 1) / mass
        alone = (max(met[c][w] - off_word[c], 0) + freed[c] * q) / types[c]
        base = (max(pooled[w] - 0.75, 0) + loose * q) / sum(types)
        pair = (max(both[u, w] - 0.75, 0) + spare[u] * base) / (after[0][u] + after[1][u])
        if not after[c][u]:
            return np.log(pair * alone / base)
        return np.log(max(n[c][u, w] - off[c], 0) / after[c][u] + left[c][u] / after[c][u] * pair * alone / base)

    for (u, w) in both:
        h = [np.array([toxicity.word_id(x) if x is not None else 0], np.uint64) for x in (u, w)]
        key = toxicity.pair_hash(*h)
        assert np.isclose(model.differences(key, *h)[0], log_p(0, u, w) - log_p(1, u, w))


def test_mixture_meets_targets(spark):
    docs, labels = labelled(spark)
    targets = {"high": 0.6, "low": 0.1, "toxic": 0.3}
    found = mixing.rates(docs, labels, targets).toPandas()
    n, p, x = found.tokens.to_numpy(), found[list(mixing.DOMAINS)].to_numpy(), found.rate.to_numpy()
    assert len(found) == 603 and (x >= 0).all() and np.allclose(p.sum(axis=1), 1)
    assert np.allclose((n * x) @ p / n.sum(), [0.6, 0.1, 0.3], atol=0.01)
    # the same steps in plain numpy
    goal, base, y = np.array([0.6, 0.1, 0.3]), np.maximum(n @ p / n.sum(), 1e-6), np.ones(len(n))
    for _ in range(500):
        y = np.maximum(0, y - ((p @ (((n * y) @ p / n.sum() - goal) / base)) + mixing.PULL * (y - 1)) / (1 + mixing.PULL))
    assert np.allclose(x, y, atol=0.02)
    copies = mixing.mixed(docs, mixing.rates(docs, labels, targets))
    assert copies.columns == docs.columns and copies.count() == found.copies.sum()
    assert mixing.rates(docs.where("false"), labels).count() == 0


def test_mixture_learns_from_every_labelled_row(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.expr(
        "if(id % 500 = 7, 'rare words here', 'common words here')").alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 500 == 7).cast("int").alias("toxic"))
    logs, priors = mixing.classifier(docs, labels)
    learnt = [i for i in range(30_000) if zlib.crc32(str(i).encode()) % 5]
    toxic = sum(i % 500 == 7 for i in learnt)
    assert np.allclose(priors, [(len(learnt) - toxic + 1) / (len(learnt) + 3), 1 / (len(learnt) + 3), (toxic + 1) / (len(learnt) + 3)])
    assert logs.count() == mixing.WORDS + mixing.SHAPES


def test_mixture_of_weakly_separated_domains(spark):
    r = np.random.default_rng(8)
    p = r.dirichlet([8.4, 1.5, 0.1], 2000) * 0.3 + np.array([0.84, 0.15, 0.01]) * 0.7
    n, goal = r.integers(1, 200, 2000).astype(float), np.array([0.95, 0.04, 0.01])
    held = spark.createDataFrame([(1, *map(float, x)) for x in np.column_stack([n, p])],
                                 "rows int, tokens double, high double, low double, toxic double")
    targets = dict(zip(mixing.DOMAINS, goal.tolist()))
    x = mixing.fitted(held, targets, Landing(spark, "weak")).toPandas()
    n, p, x = x.tokens.to_numpy(), x[list(mixing.DOMAINS)].to_numpy(), x.rate.to_numpy()
    # no slope is left: by the definition of the least
    miss = ((n * x) @ p / n.sum() - goal) / (n @ p / n.sum())
    assert np.allclose(x, np.maximum(0, 1 - p @ miss / mixing.PULL), atol=0.02)


def test_equal_neighbours_count_by_row_number():
    vectors = np.tile(np.array([[1.0, 0.0]], np.float32), (4000, 1))
    labels = np.zeros(4000, np.float32)
    labels[:quality.VOTES] = 1
    model = quality.Model(None, None, vectors, labels)
    assert (model.votes(np.array([[1.0, 0.0], [0.6, 0.8]], np.float32)) == 1.0).all()
    r = np.random.default_rng(0)
    for _ in range(30):
        near, k = r.integers(0, 4, (7, 30)).astype(np.float32), int(r.integers(1, 31))
        want = np.sort(np.argsort(-near, axis=1, kind="stable")[:, :k], axis=1)
        assert (np.sort(quality.nearest(near, k), axis=1) == want).all()


def test_token_count_of_parts_as_of_whole_texts():
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    with open(path, "rb") as f:
        counter = token_count.Counter(f.read())
    r = random.Random(6)
    for _ in range(2000):
        text = "".join(r.choice(["a", "th", "é", "漢", " ", " ", "  ", "▁", "\n", "\t", ".", "e r", "\u3000"])
                       for _ in range(r.randint(0, 20)))
        assert counter.count(text) == len(library.encode(text))


def test_places_move_in_three_columns_and_come_back_whole(spark, monkeypatch):
    monkeypatch.setattr(substring, "OFTEN", 12)
    monkeypatch.setattr(substring, "SEEN", 1)
    shared = prose(30, 3)
    texts = [(i, " ".join([f"a{i}-{j}" for j in range(9)] + shared * (1 + i % 2))) for i in range(-3, 10)]
    texts.append((2, " ".join(["z", *shared])))  # an id of two rows
    df = spark.createDataFrame(texts, "doc long, text string")
    ship(spark)
    places = {}
    for h, doc, at, span in substring.seed_keys(pa.RecordBatch.from_pydict({"doc": [t[0] for t in texts], "text": [t[1] for t in texts]})):
        for key, *place in zip(h.tolist(), doc.tolist(), at.tolist(), span.tolist()):
            places.setdefault(key, set()).add(tuple(place))
    want = set()
    for own in places.values():
        own = sorted(own)
        for p in own:
            if own[0][0] < own[-1][0]:
                want.add((p, own[0], max((q for q in own if q[0] < p[0]), default=None)))
    for often in (1, 1 << 18):  # of 1, a key would need as many places as there are seeds
        monkeypatch.setattr(substring, "FREQUENT", often)
        found = substring.partners(df, substring.seed_keys, Landing(spark, "places"), f"seeds-{often}")
        got = {((r.doc, r.a, r.span), tuple(r.first), r.previous and tuple(r.previous)) for r in found.collect()}
        assert got == want
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        made = [x for x in plan.splitlines() if "MapInArrow" in x]
        assert len(made) == 1 and made[0].rsplit("[", 1)[1].count("#") == 3


def test_seeds_of_several_texts_at_once_are_those_of_each(monkeypatch):
    r = random.Random(9)
    texts = [" ".join(r.choice("abc") for _ in range(n)) for n in [*range(0, 32), 400, 15, 16, 90]] + [None, " ".join(prose(70, 4))]
    batch = pa.RecordBatch.from_pydict({"doc": list(range(len(texts))), "text": texts})
    want = set()
    for doc, text in enumerate(texts):
        h = substring.word_hashes(substring.words(text))
        if len(h) < substring.SEED:
            continue
        g = substring.shingle_hashes(h, substring.SEED).tolist()
        for i in range(max(1, len(g) - substring.WINDOW + 1)):
            at = min(range(i, min(i + substring.WINDOW, len(g))), key=lambda j: (g[j], j))
            want.add((g[at], doc, at, 0))
        runs = substring.shingle_hashes(h, substring.LEAST)
        for i in range(len(runs) - substring.LEAST):
            near = min(range(i + substring.LEAST, min(i + substring.LEAST + substring.REACH, len(runs))),
                       key=lambda j: (int(runs[i] ^ runs[j]), j))
            pair = substring.mixed(runs[i:i + 1] * np.uint64(0x9E3779B97F4A7C15) + runs[near] + np.uint64(substring.LEAST))
            want.add((int(pair[0]), doc, i, near - i))
    for words, groups in ((1 << 16, 1), (100, 11)):
        monkeypatch.setattr(substring, "TOGETHER", words)
        parts = list(substring.seed_keys(batch))
        assert len(parts) <= groups  # not a part for each text
        got = [row for part in parts for row in zip(*(x.tolist() for x in part))]
        assert len(got) == len(set(got)) and set(got) == want
