"""MinHash near-dedup (1): banded MinHash candidates, Odd-sketch verification, exact links.

A text's set is that of its word shingles (64-bit hashes of them). Rows with equal sets are
represented by their smallest id. For each representative, SAMPLES MinHash values make
  - BANDS band keys of ROWS values each: a pair at the threshold 0.8 shares none of them with a
    probability of 5e-8, one at 0.85 of 6e-11;
  - an Odd sketch: the parity bitmap of the hashed (sample number, value) pairs. The XOR of two
    sketches has about n/2 * (1 - (1 - 2/n)^(2k(1-J))) bits set, from which J is estimated.

In a bucket, members are first compared with the one of the smallest id, each with one such
centre (no pairs within a group), then those that did not link with another of their centres.
Pairs whose sketches are within the bound of the threshold (five standard deviations) are
confirmed on the full sets; those make components. Where a bucket's members are then still in
different components, a finer Odd sketch of them (FINE_SAMPLES values) tells which could link
across components. These make families, in which the full sets of all members are compared in
blocks of about BLOCK shingles, except those of one component: a component's copies are never
compared among themselves, and no table of pairs of texts is written. Sets are made once for each
member; a block of them is held while the family's later blocks pass, so that work and transfer in
a family of W shingles outside its largest component grow with W * W / BLOCK.

What may be lost: a pair at the threshold that shares no band (above), or whose sketches differ by
more than five standard deviations (3e-7 for each of the two sketches).

Cases: a null or empty text, or one of white space only, has an empty set and is linked with
nothing. With fewer words than a shingle the whole sequence is one shingle. Rows that repeat an
id are judged each by its own text; where such rows both represent a set they are one node. A
row without an id is linked with nothing and kept. Columns other than id and text aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .components import components

SAMPLES, BANDS, ROWS, SKETCH_BITS = 128, 32, 4, 256
FINE_SAMPLES, FINE_BITS = 1024, 2048
#: Members of a star that one task compares with the centre.
STAR = 512
#: Members of a bucket outside its centre's component, and shingles of a family, that a task holds at a time.
CHUNK, BLOCK = 512, 1 << 17

_MIX = np.random.default_rng(20240229).integers(1, 2**63, size=FINE_SAMPLES + 16, dtype=np.uint64) | np.uint64(1)
_MULTIPLIERS, _FOLD = _MIX[16:, None], _MIX[:16]
SIGNATURES = "id long, n long, s1 long, s2 long, o0 long, o1 long, o2 long, o3 long, bands array<long>"


def _finish(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles. bytes.lower() and split() are ASCII."""
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    if n < size:
        return np.array([xxhash.xxh3_64_intdigest(b"\n".join(words))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    total = np.zeros(n - size + 1, np.uint64)
    for i in range(size):
        total += h[i : n - size + 1 + i] * _FOLD[i]
    return np.unique(_finish(total))


def signature(s: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """The least value of the set under each of the first `samples` multiplications."""
    low = np.full(samples, np.iinfo(np.uint64).max, np.uint64)
    step = max(1, (1 << 18) // samples)
    for at in range(0, len(s), step):
        np.minimum(low, (s[None, at : at + step] * _MULTIPLIERS[:samples]).min(axis=1), out=low)
    return low


def odd_sketch(low: np.ndarray, size: int = SKETCH_BITS) -> np.ndarray:
    bits = _finish(low + np.arange(len(low), dtype=np.uint64) * _FOLD[8]) % np.uint64(size)
    return np.packbits((np.bincount(bits.astype(np.int64), minlength=size) & 1).astype(np.uint8)).view(np.int64)


def band_keys(low: np.ndarray) -> np.ndarray:
    parts = low.reshape(BANDS, ROWS)
    total = np.arange(BANDS, dtype=np.uint64) * _FOLD[9]
    for i in range(ROWS):
        total = _finish(total + parts[:, i] * _FOLD[10 + i])
    return total.view(np.int64)


def sketch_bound(threshold: float, k: int = SAMPLES, n: int = SKETCH_BITS) -> int:
    """XOR bits up to which a pair at the threshold stays, with five standard deviations of room."""
    spread = math.sqrt(threshold * (1 - threshold) / k)
    at = lambda j: n / 2 * (1 - (1 - 2 / n) ** (2 * k * (1 - j)))
    return math.ceil(at(max(0.0, threshold - 5 * spread)) + 5 * math.sqrt(n) / 4)


def _signatures(size: int):
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), *((f"o{i}", pa.int64()) for i in range(4)), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                s = shingle_set(text.as_py(), size)
                if not len(s):
                    rows.append((key.as_py(), 0, 0, 0, 0, 0, 0, 0, []))
                    continue
                whole, low = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64), signature(s)
                rows.append((key.as_py(), len(s), *whole.tolist(), *odd_sketch(low).tolist(), band_keys(low)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return run


def _fine(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [odd_sketch(signature(shingle_set(x.as_py(), size), FINE_SAMPLES), FINE_BITS).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["id", "fine"])

    return run


def _whole_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(x.as_py(), size).tobytes() for x in batch.column(1)], pa.binary())], ["id", "shingles"])

    return run


class _Sets(dict):
    """Disjoint sets."""

    def find(self, x: int) -> int:
        root = x
        while self.setdefault(root, root) != root:
            root = self[root]
        while self[x] != root:
            self[x], x = root, self[x]
        return root

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self[max(x, y)] = min(x, y)
        return x != y


def _families(bound: int):
    """Rows (bucket, part, inside, id, c, fine) in this order -> edges that hold families together.

    A part's outside members come first and are held (CHUNK of them or so); the bucket's members
    stream past. Of the possible links only a spanning set is given on.
    """
    names = ["a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, codes, sets = None, [], None, _Sets()
        for batch in batches:
            a_out, b_out = [], []
            buckets, parts, inside, ids, cs, fine = (batch.column(i).to_pylist() for i in range(6))
            at, n = 0, len(ids)
            while at < n:
                if (buckets[at], parts[at]) != key:
                    key, held, codes, sets = (buckets[at], parts[at]), [], None, _Sets()
                end = at
                while end < n and (buckets[end], parts[end]) == key and inside[end] == inside[at] and end - at < CHUNK:
                    end += 1
                rows = np.frombuffer(b"".join(fine[at:end]), np.uint64).reshape(end - at, FINE_BITS // 64)
                if not inside[at]:
                    held += list(zip(ids[at:end], cs[at:end], strict=True))
                    codes = rows if codes is None else np.concatenate([codes, rows])
                elif codes is not None:
                    held_c = np.array([c for _, c in held])
                    for i in range(at, end):
                        apart = np.bitwise_count(codes ^ rows[i - at]).sum(axis=1, dtype=np.int64)
                        near = np.flatnonzero((apart <= bound) & (held_c != cs[i]))
                        for j in near.tolist():
                            if sets.join(ids[i], held[j][0]):
                                a_out.append(ids[i])
                                b_out.append(held[j][0])
                at = end
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names)

    return run


class _Block:
    """Full sets of a family's block, and how many elements a further set shares with each."""

    def __init__(self) -> None:
        self.rows: list[tuple[int, int, np.ndarray]] = []
        self.values = None

    def add(self, key: int, c: int, s: np.ndarray) -> None:
        self.rows.append((key, c, s))

    def shared(self, s: np.ndarray) -> np.ndarray:
        if self.values is None:
            every = np.concatenate([r[2] for r in self.rows])
            owner = np.repeat(np.arange(len(self.rows)), [len(r[2]) for r in self.rows])
            order = np.argsort(every, kind="stable")
            self.owner, (self.values, self.first, self.count) = owner[order], np.unique(every[order], return_index=True, return_counts=True)
            self.sizes, self.cs = np.array([len(r[2]) for r in self.rows]), np.array([r[1] for r in self.rows])
        at = np.minimum(np.searchsorted(self.values, s), len(self.values) - 1)
        at = at[self.values[at] == s]
        first, count = self.first[at], self.count[at]
        places = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum()) if len(at) else np.empty(0, np.int64)
        return np.bincount(self.owner[places], minlength=len(self.rows))


def _across_blocks(above: int, out_of: int):
    """Rows (family, i, j, right, id, c, shingles) in this order -> links, one for two components of a pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block, met = None, _Block(), set()
        for batch in batches:
            a_out, b_out = [], []
            for family, i, j, right, row, c, shingles in zip(*(batch.column(k) for k in range(7)), strict=True):
                now = (family.as_py(), i.as_py(), j.as_py())
                if now != key:
                    key, block, met = now, _Block(), set()
                row, c, s = row.as_py(), c.as_py(), np.frombuffer(shingles.as_py(), np.uint64)
                if not right.as_py():
                    block.add(row, c, s)
                    continue
                if not block.rows:
                    continue
                both = block.shared(s)
                links = np.flatnonzero((out_of * both >= above * (block.sizes + len(s) - both)) & (block.cs != c))
                for k in links.tolist():
                    pair = (block.rows[k][1], c)
                    if pair not in met:
                        met.add(pair)
                        a_out.append(block.rows[k][0])
                        b_out.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])

    return run


def _compare(size: int, above: int, out_of: int):
    """Rows of a star follow each other, the centre's text first; only its set is held."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        star, centres = None, []
        for batch in batches:
            a_out, b_out = [], []
            for a, salt, b, text in zip(*(batch.column(i) for i in range(4)), strict=True):
                key, b = (a.as_py(), salt.as_py()), b.as_py()
                if key != star:
                    star, centres = key, []
                s = shingle_set(text.as_py(), size)
                if b is None:
                    centres.append(s)
                    continue
                for c in centres:
                    both = len(np.intersect1d(c, s, assume_unique=True))
                    if out_of * both >= above * (len(c) + len(s) - both):
                        a_out.append(key[0])
                        b_out.append(b)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], schema=schema)

    return run


def _apart(x: str, y: str, parts: list[str]) -> Column:
    return reduce(Column.__add__, [F.bit_count(F.col(f"{x}.{p}").bitwiseXOR(F.col(f"{y}.{p}"))) for p in parts])


COARSE_PARTS = [f"o{i}" for i in range(SKETCH_BITS // 64)]


class NearDuplicates:
    def __init__(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, threshold: tuple[int, int] = (85, 100)) -> None:
        self.size, self.threshold = shingle, threshold
        self.bound = sketch_bound(threshold[0] / threshold[1])
        self.fine_bound = sketch_bound(threshold[0] / threshold[1], FINE_SAMPLES, FINE_BITS)
        self.texts = docs.select(F.col(id_col).cast("long").alias("id"), F.encode(F.col(text_col), "UTF-8").alias("text"))
        self.labels = docs.sparkSession.createDataFrame([], "id long, component long")

    def members(self) -> DataFrame:
        """(id, n, component) of each row."""
        rows = written(self.texts.mapInArrow(_signatures(self.size), SIGNATURES), "signatures")
        linked = rows.where("n > 0 and id is not null")
        firsts = written(linked.groupBy("s1", "s2").agg(F.min("id").alias("rep")), "sets")
        reps = linked.join(firsts.withColumnRenamed("rep", "id"), ["s1", "s2", "id"], "left_semi").dropDuplicates(["id", "s1", "s2"])
        keys = reps.select(F.explode("bands").alias("bucket"), "id")
        shared = keys.groupBy("bucket").agg(F.min("id").alias("pivot"), F.max("id").alias("top")).where("pivot < top").select("bucket", "pivot")
        buckets = written(keys.join(written(shared, "shared"), "bucket"), "buckets")  # as a table: Spark can then split a hot bucket's join
        sketches = reps.select("id", *COARSE_PARTS)

        first = buckets.where("id != pivot").groupBy(F.col("id").alias("b")).agg(F.min("pivot").alias("a"))
        self._confirm(self._near(first, sketches))
        other = self._named(buckets).where("c != pc").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
        self._confirm(self._best(self._near(other, sketches)))
        self._across(self._named(buckets), reps.select("id", "n"))

        where = firsts.join(self.labels, firsts.rep == self.labels.id, "left").select("s1", "s2", F.coalesce("component", "rep").alias("component"))
        known = rows.select("id", "n", "s1", "s2").join(where, ["s1", "s2"], "left")
        return known.select("id", "n", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component")).otherwise(F.col("id")).alias("component"))

    def _near(self, pairs: DataFrame, sketches: DataFrame) -> DataFrame:
        """Pairs (a, b, apart) whose sketches are within the bound."""
        x = pairs.join(sketches.select(F.col("id").alias("a"), F.struct(COARSE_PARTS).alias("x")), "a")
        y = x.join(sketches.select(F.col("id").alias("b"), F.struct(COARSE_PARTS).alias("y")), "b")
        return y.select("a", "b", _apart("x", "y", COARSE_PARTS).alias("apart")).where(F.col("apart") <= self.bound)

    def _named(self, buckets: DataFrame) -> DataFrame:
        """(bucket, id, pivot, c, pc): with the components of the member and of the pivot."""
        named = buckets.join(self.labels, "id", "left").select("bucket", "id", "pivot", F.coalesce("component", "id").alias("c"))
        pivots = named.where("id = pivot").select("bucket", F.col("c").alias("pc")).distinct()
        return named.join(pivots, "bucket")

    @staticmethod
    def _best(pairs: DataFrame) -> DataFrame:
        return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("b").orderBy("apart", "a"))).where("rank = 1").select("a", "b", "apart")

    def _across(self, named: DataFrame, sizes: DataFrame) -> None:
        """Links between the components that meet in a bucket; sizes has each representative's number of shingles."""
        outside = written(named.where("c != pc").select("bucket", "id", "c"), "outside")
        if outside.isEmpty():
            return
        parts = outside.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("parts"))
        inside = written(named.join(parts, "bucket").select("bucket", "id", "c", "parts"), "inside")
        ids = written(inside.select("id").distinct(), "ids")
        fine = written(self.texts.join(ids, "id", "left_semi").mapInArrow(_fine(self.size), "id long, fine binary"), "fine")
        held = outside.join(parts, "bucket").select("bucket", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("inside"), "id", "c")
        passing = inside.select("bucket", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("inside"), "id", "c")
        rows = held.unionByName(passing).join(fine, "id").select("bucket", "part", "inside", "id", "c", "fine")
        rows = rows.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "inside")
        edges = rows.mapInArrow(_families(self.fine_bound), "a long, b long").distinct()
        family = components(edges).select("id", F.col("component").alias("family"))

        members = family.join(self.labels, "id", "left").select("family", "id", F.coalesce("component", "id").alias("c")).join(sizes, "id")
        members = written(members, "members")
        weights = members.groupBy("family", "c").agg(F.sum("n").alias("w"))
        alone = F.col("w") >= BLOCK  # such components have blocks of their own; smaller ones share
        small = weights.where(~alone).groupBy(F.col("family").alias("f")).agg(F.ceil(F.sum("w") / BLOCK).alias("pools"))
        dealt = written(weights.join(small, weights.family == small.f, "left").select("family", "c", alone.alias("alone"), F.when(alone, F.ceil(F.col("w") / BLOCK)).otherwise(F.col("pools")).alias("parts")), "dealt")
        part = F.pmod(F.xxhash64(F.when(F.col("alone"), F.col("id")).otherwise(F.col("c"))), F.col("parts"))
        block = F.xxhash64("alone", F.when(F.col("alone"), F.col("c")), part)
        members = written(members.join(dealt, ["family", "c"]).select("family", "id", "c", block.alias("block"), F.when(F.col("alone"), F.col("c")).alias("only")), "members")
        blocks = members.groupBy("family", "block").agg(F.max("only").alias("only"), F.count_distinct("c").alias("cs"))
        left, right = (blocks.select("family", F.col("block").alias(x), F.col("only").alias(x + "only"), F.col("cs").alias(x + "cs")) for x in "ij")
        pairs = left.join(right, "family").where("(i < j and not ionly <=> jonly) or (i < j and ionly is null) or (i = j and ics > 1)")
        pairs = written(pairs.select("family", "i", "j"), "block_pairs")
        wanted = written(members.select("id").distinct(), "ids")
        sets = self.texts.join(wanted, "id", "left_semi").mapInArrow(_whole_sets(self.size), "id long, shingles binary")
        whole = written(members.join(sets, "id"), "sets")
        names = ["family", "i", "j", "right", "id", "c", "shingles"]
        one = pairs.join(whole.withColumnRenamed("block", "i"), ["family", "i"]).withColumn("right", F.lit(False)).select(names)
        two = pairs.join(whole.withColumnRenamed("block", "j"), ["family", "j"]).withColumn("right", F.lit(True)).select(names)
        rows = one.unionByName(two).repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "right")
        self._link(rows.mapInArrow(_across_blocks(*self.threshold), "a long, b long"))

    def _confirm(self, pairs: DataFrame) -> None:
        """Compares the full sets of pairs (a, b) and joins the components of those that link."""
        pairs = written(pairs.select("a", "b"), "pairs")
        if pairs.isEmpty():
            return
        ids = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
        texts = written(self.texts.join(ids, "id", "left_semi"), "texts")
        large = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("parts"))
        dealt = pairs.join(large, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("salt"), "b")
        centres = large.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
        one = centres.join(texts, centres.a == texts.id).select("a", "salt", F.lit(None).cast("long").alias("b"), "text")
        two = dealt.join(texts, dealt.b == texts.id).select("a", "salt", "b", "text")
        stars = one.unionByName(two).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
        self._link(stars.mapInArrow(_compare(self.size, *self.threshold), "a long, b long"))

    def _link(self, links: DataFrame) -> None:
        self.labels = components(self.labels.select(F.col("id").alias("a"), F.col("component").alias("b")).union(links))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of docs; see NearDuplicates."""
    found = NearDuplicates(docs, **options).members()
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """docs with one document of each group: that of the smallest id (all rows that repeat it)."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, shingle=shingle, threshold=threshold)
    gone = written(found.where("not kept").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    return docs.join(gone, docs[id_col].cast("long") == gone["__gone"], "left_anti")
