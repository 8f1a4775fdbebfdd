"""Size-aware similarity join of documents by their word shingles, and the classes that its links form.

Sets of shingles a and b link if den * |a and b| >= num * |a or b|. Shingles have one order for all sets: those that
occur often last. Two linked sets share a shingle among the first n - ceil(n * num / den) + 1 of each, and two among
one more than these.

* Light: a small set is joined by all subsets of two shingles of that longer beginning.
* Heavy: a large set is joined by scanning the inverted lists of the single shingles of its beginning. Small sets that
  a large one can link with stand in these lists too, and so do sets that may link by one shared shingle alone, which
  there are at thresholds of one half and less.
* A subset costs one row and a scan costs the length of its list, so the boundary is where (p + 1) * p / 2 subsets cost
  more than p scans of lists of the mean length, which is counted over all sets.

Sets that are equal are joined as one. Of each list only pairs with its least member are made at first; they are
counted in full, and their links give classes. What remains, pairs of members in different classes, is then compared
in blocks of bounded size inside tasks; no row is made for a pair, and no pair is left out that could connect two
classes. Which shingles occur often only affects speed: one in COUNTED, and all of small sets, are counted over all
documents and stand in front of the others, the frequent ones last of all. As many count as frequent as HEAVY allows to
broadcast, so that lists stay short whatever the number of documents.

A text with fewer words than a shingle is one shingle as a whole; null texts and texts without words have an empty
set and link with nothing. Very long texts are taken whole. Rows that share an id belong to one document, which links
where any of them does. Rows without an id get no component. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from windrow.llm.common import Landing, shingle_hashes, ship, word_hashes, words
from windrow.llm.components import connected

HEAVY = 1 << 20  # most shingles that count as frequent
OFTEN = 4  # documents a frequent shingle is in, at least
SEEN = 8  # documents of a task that a frequent shingle is in, at least, if it isn't counted in every document
COUNTED = 4  # one shingle of so many, by hash, is counted in every document
SHORT = 150  # shingles of a set that are all counted
RANGES, KEPT = 10, 32  # bits of a hash: the range that it is counted in, and what is kept of it there
BLOCK = 128  # members of a list on either side of a block
SENT = 1 << 20  # ids that are broadcast at most; beyond, they are joined by a shuffle


class Rule(NamedTuple):
    shingle: int
    num: int
    den: int

    def least(self, n: int) -> int:
        """Shingles that a set of n must share with any that it links with."""
        return -(-self.num * n // self.den)

    def needed(self, a, b):
        """Shingles that sets of sizes a and b must share to link."""
        return -(-self.num * (a + b) // (self.num + self.den))


def shingles(text: str | None, k: int) -> np.ndarray:
    """The set of a text, sorted."""
    return np.unique(shingle_hashes(word_hashes(words(text)), k))


def counted(s: np.ndarray) -> np.ndarray:
    return s % np.uint64(COUNTED) == 0


def shortened(s: np.ndarray) -> np.ndarray:
    return s >> np.uint64(64 - RANGES - KEPT)


def frequent(rows: DataFrame, rule: Rule) -> np.ndarray:
    """Shingles of many documents, shortened and sorted: as many as HEAVY lets in, so that lists don't grow with the table.

    Counted over all documents are those that beginnings are made of where they can: one of COUNTED, and all of small sets.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, rough, waiting = [], [], 0

        def out() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *rough]), return_counts=True)
            several = n >= SEEN
            h = np.sort(shortened(np.concatenate([*whole, np.repeat(found[several], n[several])])))
            area = h >> np.uint64(KEPT)
            cuts = np.flatnonzero(area[1:] != area[:-1]) + 1
            parts = np.split(h.astype(np.uint32), cuts)
            first = area[np.concatenate([np.zeros(min(1, len(h)), np.int64), cuts])]
            return pa.RecordBatch.from_arrays([pa.array(first.astype(np.int32)), pa.array(
                [x.tobytes() for x in parts[:len(first)]], pa.binary())], ["area", "held"])

        for batch in batches:
            for text in batch["text"]:
                s = shingles(text.as_py(), rule.shingle)
                if len(s) <= SHORT:
                    whole.append(s)
                else:
                    own = counted(s)
                    whole.append(s[own])
                    rough.append(s[~own])
                waiting += len(s)
                if waiting > 1 << 20:
                    yield out()
                    whole, rough, waiting = [], [], 0
        if whole:
            yield out()

    def add(held: pa.Table) -> pa.Table:
        found, n = np.unique(np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in held["held"]]), return_counts=True)
        often = n >= OFTEN
        area = np.uint64(held["area"][0].as_py()) << np.uint64(KEPT)
        return pa.table({"h": (area | found[often].astype(np.uint64)).view(np.int64), "n": n[often].astype(np.int64)})

    counts = rows.select("text").mapInArrow(count, "area int, held binary").groupBy("area").applyInArrow(add, "h long, n long")
    landing = Landing(rows.sparkSession, "frequent")
    # levels of n, so that few numbers tell from where on there are HEAVY at most
    level = F.when(F.col("n") < 1024, F.col("n")).otherwise(1024 + F.floor(16 * F.log2(F.col("n") / 1024)))
    held = landing.land(counts.withColumn("level", level.cast("int")), "counts")
    least, kept = None, 0
    for r in sorted(held.groupBy("level").count().collect(), reverse=True):
        kept += r["count"]
        if kept > HEAVY:
            break
        least = r["level"]
    often = held.where(F.col("level") >= (1 << 30 if least is None else least)).select("h").toArrow()["h"].to_numpy()
    landing.drop("counts")
    return np.sort(often.astype(np.int64).view(np.uint64))


def profiles(rows: DataFrame, rule: Rule, often: np.ndarray) -> DataFrame:
    """doc, n (size of the set), sig (equal for equal sets), first (the longer beginning, in the common order)."""
    held = rows.sparkSession.sparkContext.broadcast(often)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = held.value
        for batch in batches:
            sizes, sigs, firsts = [], [], []
            for text in batch["text"]:
                s = shingles(text.as_py(), rule.shingle)
                n = len(s)
                sizes.append(n)
                sigs.append(xxhash.xxh3_128_digest(s.tobytes()) if n else None)
                if n:
                    late = np.zeros(n, bool)
                    if len(heavy):
                        known = shortened(s)
                        late = heavy[np.minimum(np.searchsorted(heavy, known), len(heavy) - 1)] == known
                    early = counted(s) & ~late
                    s = np.concatenate([s[early], s[~early & ~late], s[late]])
                firsts.append(s[:n - rule.least(n) + 2].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch["doc"], pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()),
                 pa.array(firsts, pa.list_(pa.int64()))], ["doc", "n", "sig", "first"])

    return rows.select("doc", "text").mapInArrow(run, "doc long, n long, sig binary, first array<long>")


def keys(sets: DataFrame, rule: Rule, longest: int) -> DataFrame:
    """key, doc, single: subsets of two for sets with a beginning of up to `longest`, single shingles for larger ones."""
    p, n = F.size(beginning(rule)), F.col("n")
    by_one = (n * rule.num <= rule.den) & F.lit(rule.den >= 2 * rule.num)
    smallest = -(-longest * rule.den // (rule.den - rule.num))  # size of the smallest large set
    pairs = F.flatten(F.transform(F.sequence(F.lit(1), F.size("first") - 1), lambda i: F.transform(
        F.sequence(i + 1, F.size("first")), lambda j: F.xxhash64(
            F.element_at("first", i), F.element_at("first", j)))))
    light = sets.where((p <= longest) & (F.size("first") >= 2)).select(
        F.explode(pairs).alias("key"), "doc", F.lit(False).alias("single"))
    heavy = sets.where((p > longest) | (n >= rule.least(smallest)) | by_one).select(
        F.explode(beginning(rule)).alias("key"), "doc", F.lit(True).alias("single"))
    return light.unionByName(heavy)


def beginning(rule: Rule) -> Column:
    """Of `first` all but its last; all of it where one shared shingle can be enough."""
    return F.slice("first", 1, F.when(F.col("n") * rule.num <= rule.den, F.size("first")).otherwise(F.size("first") - 1))


def only(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of the given (doc); these are broadcast if they are few enough."""
    few = ids.limit(SENT + 1).count() <= SENT
    return rows.join(F.broadcast(ids) if few else ids, "doc", "left_semi")


def whole_sets(rows: DataFrame, ids: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """doc, all (sorted shingles) of the given ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py(), rule.shingle) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays(
                [batch["doc"], pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in found], pa.binary()),
                 pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))], ["doc", "sig", "all"])

    made = only(rows.select("doc", "text"), ids).mapInArrow(run, "doc long, sig binary, all array<long>")
    return made.join(only(sets.select("doc", "sig"), ids), ["doc", "sig"], "left_semi").select("doc", "all")


def linked(pairs: DataFrame, whole: DataFrame, rule: Rule) -> DataFrame:
    """Of pairs (x, y) those that link."""
    joined = (pairs.join(whole.select(F.col("doc").alias("x"), F.col("all").alias("a")), "x")
              .join(whole.select(F.col("doc").alias("y"), F.col("all").alias("b")), "y"))
    shared = F.size(F.array_intersect("a", "b"))
    return joined.where(shared * (rule.num + rule.den) >= (F.size("a") + F.size("b")) * rule.num).select("x", "y")


def possible(a_n: Column, b_n: Column, a_p: Column, b_p: Column, rule: Rule) -> Column:
    """Whether sets of these sizes, with beginnings of these lengths, can link: `first` and `start` hold what the
    beginnings could share, and all that follows them is shared at best."""
    needed = F.ceil((a_n + b_n) * rule.num / F.lit(rule.num + rule.den) - 1e-9)
    rest = F.greatest(a_n - a_p, b_n - b_p)
    sizes = F.least(a_n, b_n) * rule.den >= F.greatest(a_n, b_n) * rule.num
    return sizes & (F.size(F.array_intersect("first", "start")) + rest >= needed)


def blocks(members: DataFrame) -> DataFrame:
    """leader, doc, ... -> also i, j: the blocks, pairs of ranges of a list's members, that a member is in."""
    place = Window.partitionBy("leader").orderBy("n", "doc")
    ranged = members.withColumn("c", F.floor((F.row_number().over(place) - 1) / BLOCK).cast("int"))
    ends = ranged.groupBy("leader").agg(F.max("c").alias("last"))
    met = ranged.join(ends, "leader").withColumn("o", F.explode(F.sequence(F.lit(0), "last")))
    return met.withColumns({"i": F.least("c", "o"), "j": F.greatest("c", "o")}).drop("c", "o", "last")


def lists_of(column: pa.ChunkedArray) -> list[np.ndarray | None]:
    held = column.combine_chunks()
    ends, values, there = held.offsets.to_numpy(), held.values.to_numpy(), held.is_valid().to_pylist()
    return [values[a:b] if ok else None for a, b, ok in zip(ends[:-1], ends[1:], there)]


def by_block(held: DataFrame, run: Callable[[pa.Table, list[tuple[int, int]]], pa.RecordBatch], schema: str) -> DataFrame:
    """`run` gets the rows of some blocks (leader, i, j), and where each block begins and ends in them."""
    def found(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(changes(rows)) + 1
        parts = [(a, b) for a, b in zip([0, *at.tolist()], [*at.tolist(), rows.num_rows]) if b - a > 1]
        if parts:
            yield run(rows.combine_chunks(), parts)

    def changes(rows: pa.Table) -> np.ndarray:
        keys = [rows[c].to_numpy() for c in ("leader", "i", "j")]
        return np.any([k[1:] != k[:-1] for k in keys], axis=0)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            at = np.flatnonzero(changes(rows))
            cut = int(at[-1]) + 1 if len(at) else 0  # the last block may go on in the next batch
            rest = rows.slice(cut)
            if cut:
                yield from found(rows.slice(0, cut))
        if rest is not None:
            yield from found(rest)

    dealt = held.repartition("leader", "i", "j").sortWithinPartitions("leader", "i", "j")
    return dealt.mapInArrow(each, schema)


def open_members(held: DataFrame, rule: Rule) -> DataFrame:
    """Of blocks' members those that could link with a member of another class."""
    def meeting(n: np.ndarray, cls: np.ndarray, p: np.ndarray, small: np.ndarray, firsts: list, mine: list) -> np.ndarray:
        a, b = n[:, None], n[None, :]
        fits = (np.minimum(a, b) * rule.den >= np.maximum(a, b) * rule.num) & (cls[:, None] != cls[None, :])
        if not fits.any():
            return fits
        tokens = np.concatenate(firsts)
        owner = np.repeat(np.arange(len(n)), [len(x) for x in firsts])
        _, token, times = np.unique(tokens, return_inverse=True, return_counts=True)
        shared = np.zeros((len(n), len(n)), np.float32)
        several = times[token] > 1
        columns, token = np.unique(token[several], return_inverse=True)
        owner = owner[several]
        for at in range(0, len(columns), 4096):
            part = (token >= at) & (token < at + 4096)
            m = np.zeros((len(n), min(4096, len(columns) - at)), np.float32)
            m[owner[part], token[part] - at] = 1
            shared += m @ m.T
        rest = np.maximum(a - p[:, None], b - p[None, :])
        fits &= shared + rest >= rule.needed(a, b)
        # a pair is compared only where the list of its least shared shingle is; small sets share subsets instead
        own = [set(x.tolist()) if x is not None else set() for x in mine] if fits.any() else []
        for x, y in zip(*np.nonzero(np.triu(fits, 1))):
            if not (small[x] and small[y]) and int(np.intersect1d(firsts[x], firsts[y]).min()) not in own[x]:
                fits[x, y] = fits[y, x] = False
        return fits

    def run(rows: pa.Table, parts: list[tuple[int, int]]) -> pa.RecordBatch:
        n, cls, p, small = (rows[c].to_numpy() for c in ("n", "cls", "p", "small"))
        firsts, mine = lists_of(rows["first"]), lists_of(rows["mine"])
        kept = np.zeros(rows.num_rows, bool)
        for lo, hi in parts:
            at = slice(lo, hi)
            kept[at] = meeting(n[at], cls[at], p[at], small[at], firsts[at], mine[at]).any(axis=1)
        names = ["leader", "i", "j", "doc", "cls"]
        return pa.RecordBatch.from_arrays([pa.array(rows[c].to_numpy()[kept]) for c in names], names)

    return by_block(held, run, "leader long, i int, j int, doc long, cls long")


def block_links(held: DataFrame, rule: Rule) -> DataFrame:
    """Links between members of different classes; those that a block's other links imply are left out."""
    def links(docs: list[int], cls: list[int], sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        order = sorted(range(len(docs)), key=lambda i: len(sets[i]))
        above: dict[int, int] = {c: c for c in cls}

        def top(c: int) -> int:
            while above[c] != c:
                above[c] = c = above[above[c]]
            return c

        for at, x in enumerate(order):
            a = sets[x]
            for y in order[at + 1:]:
                b = sets[y]
                if len(a) * rule.den < len(b) * rule.num:
                    break
                if (p := top(cls[x])) == (q := top(cls[y])):
                    continue
                at_b = np.searchsorted(b, a)
                n = int((b[np.minimum(at_b, len(b) - 1)] == a).sum())
                if n * (rule.num + rule.den) >= (len(a) + len(b)) * rule.num:
                    above[p] = q
                    yield docs[x], docs[y]

    def run(rows: pa.Table, parts: list[tuple[int, int]]) -> pa.RecordBatch:
        docs, cls = rows["doc"].to_pylist(), rows["cls"].to_pylist()
        sets = [x.view(np.uint64) for x in lists_of(rows["all"])]
        found = [pair for lo, hi in parts for pair in links(docs[lo:hi], cls[lo:hi], sets[lo:hi])]
        x, y = zip(*found) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["x", "y"])

    return by_block(held, run, "x long, y long")


def near_classes(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, id: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """doc, n_shingles, component: the least id that links lead to from the document, its own included."""
    rule, spark = Rule(shingle, num, den), docs.sparkSession
    if not 0 < num < den:
        raise ValueError("the similarity must lie between 0 and 1")
    ship(spark)
    landing = Landing(spark, "near")
    every = docs.select(F.col(id).cast("long").alias("doc"), F.col(text).alias("text"))
    rows = every.where(F.col("doc").isNotNull())
    prof = landing.land(profiles(every, rule, frequent(rows, rule)), "profiles")
    reps = landing.land(prof.where((F.col("n") > 0) & F.col("doc").isNotNull()).groupBy("sig").agg(F.min("doc").alias("rep")), "reps")
    sets = prof.join(reps, (prof["sig"] == reps["sig"]) & (prof["doc"] == reps["rep"]), "left_semi")
    sets = landing.land(sets.select("doc", "n", "sig", "first"), "sets")

    total, kinds = sets.select(F.explode(beginning(rule)).alias("t")).agg(F.count("*"), F.approx_count_distinct("t")).first()
    longest = max(1, int(1 + 2 * total / max(1, kinds)))
    of_key = Window.partitionBy("key", "single")
    met = (keys(sets, rule, longest).withColumns({"members": F.count("*").over(of_key), "leader": F.min("doc").over(of_key)})
           .where("members > 1").select("key", "single", "leader", "doc"))
    met = landing.land(met, "met")
    lists = landing.land(met.select("leader", "doc").where("leader <> doc").distinct(), "lists")
    # of a beginning only shingles that several sets have can be shared; small sets keep theirs, as not all are listed
    listed = met.where("single").groupBy("doc").agg(F.collect_set("key").alias("listed"))
    small = F.size(beginning(rule)) <= longest
    own = sets.join(met.select("doc").distinct(), "doc", "left_semi").join(listed, "doc", "left").select(
        "doc", "n", F.size(beginning(rule)).alias("p"), small.alias("small"),
        F.when(small, beginning(rule)).otherwise(
            F.coalesce("listed", F.array().cast("array<bigint>"))).alias("first"))
    own = landing.land(own, "own")
    lead = own.select(F.col("doc").alias("leader"), F.col("n").alias("m"), F.col("p").alias("q"), F.col("first").alias("start"))
    stars = (lists.join(own, "doc").join(lead, "leader")
             .where(possible(F.col("n"), F.col("m"), F.col("p"), F.col("q"), rule))
             .select(F.col("leader").alias("x"), F.col("doc").alias("y")))
    stars = landing.land(stars, "stars")
    ids = stars.select(F.explode(F.array("x", "y")).alias("doc")).distinct()
    whole = landing.land(whole_sets(rows, ids, sets, rule), "whole-1")
    links = landing.land(linked(stars, whole, rule), "links-1")
    landing.drop("whole-1")
    classes = landing.land(connected(links, landing, "classes-1"), "classes-1")

    members = (lists.join(classes.withColumnRenamed("component", "cls"), "doc", "left")
               .withColumn("cls", F.coalesce("cls", "doc")))
    mixed = members.groupBy("leader").agg(F.min("cls").alias("a"), F.max("cls").alias("b")).where("a <> b")
    mine = met.where("single").groupBy("leader", "doc").agg(F.collect_set("key").alias("mine"))
    remaining = (members.join(mixed.select("leader"), "leader", "left_semi").join(own.select("doc", "n"), "doc")
                 .join(mine, ["leader", "doc"], "left"))
    opened = landing.land(open_members(blocks(remaining).join(own.drop("n"), "doc"), rule), "open")
    ids = opened.select("doc").distinct()
    whole = landing.land(whole_sets(rows, ids, sets, rule), "whole-2")
    more = landing.land(block_links(opened.join(whole, "doc"), rule), "links-2")
    landing.drop("whole-2", "open", "stars", "lists", "met", "own", "sets")

    # texts that share an id link their sets
    same = prof.where((F.col("n") > 0)).join(reps, "sig").select("doc", "rep")
    joined = same.where("doc <> rep").groupBy("doc").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b")
    bridges = same.join(joined.select("doc"), "doc", "left_semi").select(F.col("doc").alias("x"), F.col("rep").alias("y"))
    final = landing.land(connected(links.unionByName(more).unionByName(bridges), landing, "classes-2"), "classes")
    placed = (prof.select("doc", "n", "sig").join(reps, "sig", "left").select("doc", "n", F.coalesce("rep", "doc").alias("rep"))
              .join(final.withColumnRenamed("doc", "rep"), "rep", "left"))
    return placed.select("doc", F.col("n").alias("n_shingles"),
                         F.when(F.col("doc").isNotNull(), F.coalesce("component", "rep")).alias("component"))
