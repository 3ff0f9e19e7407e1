"""Exact n-gram Jaccard join by a token-group matrix, with groups of similar documents as its columns.

A document's set: distinct shingles of five words (see shingles.py). Documents link when
100 * intersection >= 75 * union. The result has one row per document with its component, so copies
are never expanded into pairs. Only components are computed: links inside a component that is known already
are not verified, and a document's number of links is not given:

1. Documents with the same set become one row, its smallest doc_id.
2. A global order of tokens puts those last that some batch or task saw in several documents, by frequency. Of
   its n tokens a set must share one of the first n - ceil(0.75 n) + 1 with any partner, and with one
   of its size or more one of the first n - ceil(6/7 n) + 1. So a prefix token counts only if it stands in another
   document of fitting size, early enough in the smaller of the two; documents without such a token
   have no link and are done.
3. Each of the others gets a parity bitmap of n to 2 n bits: a token flips one bit. Bits that differ between two
   bitmaps (folded to the same size) are no more than the tokens in one set only, so they bound the
   intersection from above; only pairs that pass travel with their whole sets to be compared exactly.
4. Documents that share a min-hash are compared with one leader each, a linear number of comparisons;
   verified links join groups (components) over several rounds.
5. All remaining documents are partitioned into groups of about MEMBERS similar ones: parts of a
   component, or documents under the same most frequent prefix token. The matrix says which prefix tokens
   stand in which group; two groups are compared if they have one in common, their sizes fit, and not
   all their members are in one component already. A group is stored with the union of its prefix tokens
   and, per token, which members hold it. Of a query's n tokens n - ceil(0.75 n) + 1 are in its prefix, so its overlap
   with any member is at most ceil(0.75 n) - 1 plus the prefix tokens that stand in the union; only if that reaches
   ceil(0.75 n) is the group opened, and the members that hold such a token are held against the query's bitmap. The
   pairs that pass are not listed: of each meeting of a group and its queries first a spanning forest of the best
   pairs over the components is compared exactly; then documents that still have a pair between components
   meet again with their whole sets, and each meeting gives a spanning forest of its links.

Nothing is capped: the bound on the frequent tokens' table only decides the order, and any order is exact.

Defined results: null and empty texts, or texts without words, have n_shingles 0 and are alone; a null
doc_id is alone with a null component_id; repeated rows get a row each; an empty table gives an empty
result; further columns are ignored by linked() and kept by deduplicated().
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import alone, bounded, column, drop_saved, pieces, release, saved, texts
from .components import components
from .shingles import overlap, sets_of

PERCENT = 75
#: Frequent tokens in the ordering's table, at most; a token seen in so many documents of one batch is reported.
FREQUENT, REPORTED = 1 << 20, 2
#: Odd multipliers of the min-hash permutations.
PERMUTATIONS = (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
BATCH, PART = 8 << 20, 4 << 20
MEMBERS = 48
#: Tokens of a group, about, and groups that query a part.
TOKENS, QUERIES = 1 << 17, 8
#: Counters (a power of two) by which a task sees tokens of SEEN documents that no single batch shows twice.
COUNTERS, SEEN = 1 << 23, 4
#: Into how many parts a hot min-hash is dealt.
SALT = 16


def needed(n: int) -> int:
    """Tokens that a partner must share at least: ceil(0.75 n)."""
    return -(-PERCENT * n // 100)


def _early(n: int) -> int:
    """How many first tokens hold one that any partner of n tokens or more shares in its prefix."""
    return n + 1 + (-2 * PERCENT * n // (100 + PERCENT))


def fitting(rows: DataFrame) -> DataFrame:
    """Of prefix tokens (token, doc_id, n, early) those that stand in another document of fitting size, early in the smaller. Sizes are taken by buckets of a factor 4/3 and their neighbours; counted before they are shuffled, however frequent a token is."""
    by = rows.withColumn("b", F.floor(F.log("n") / F.log(F.lit(100 / PERCENT))).cast("int"))
    near = by.groupBy("token", "b").agg(F.count(F.lit(1)).alias("docs"), F.count_if("early").alias("firsts"))
    near = near.select("token", F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1)).alias("b"), "docs", "firsts").groupBy("token", "b").agg(F.sum("docs").alias("docs"), F.sum("firsts").alias("firsts")).filter("docs > 1 and firsts > 0")
    return by.join(near, ["token", "b"]).filter("early or firsts > 0").select("token", "doc_id")


def _small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """Broadcast if it is counted and small; joined by a shuffle else."""
    return F.broadcast(df) if df.count() <= rows else df


def _signature(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _sketched(batches):
    alone("jaccard")
    met = np.zeros(COUNTERS, np.uint8)
    for batch in pieces(batches, limit=BATCH):
        docs, sets = column(batch, "doc_id").to_pylist(), sets_of(texts(batch))
        sig = [_signature(s) for s in sets]
        mins = [[int((s * np.uint64(p)).min().astype(np.int64)) for p in PERMUTATIONS] if len(s) else None for s in sets]
        distinct = list({g: s for g, s in zip(sig, sets, strict=True)}.values())
        token, n = np.unique(np.concatenate(distinct), return_counts=True) if distinct else (np.empty(0, np.uint64), np.empty(0, int))
        place = (token >> np.uint64(20)) % np.uint64(COUNTERS)
        met[place] = np.minimum(met[place] + n, 255)
        often = (n >= REPORTED) | (met[place] >= SEEN)
        token, n = token[often], n[often]
        k = len(docs)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(docs + [None] * len(token), pa.int64()),
                pa.array([len(s) for s in sets] + [None] * len(token), pa.int64()),
                pa.array(sig + [None] * len(token), pa.binary()),
                pa.array(mins + [None] * len(token), pa.list_(pa.int64())),
                pa.array(np.concatenate([np.zeros(k, np.int64), token.view(np.int64)])),
                pa.array(np.concatenate([np.zeros(k, np.int64), n.astype(np.int64)])),
            ],
            ["doc_id", "n", "sig", "mins", "token", "seen"],
        )


SKETCH = "doc_id long, n long, sig binary, mins array<long>, token long, seen long"


def _prefixes(frequent):
    def run(batches):
        alone("jaccard")
        token, rank = frequent.value
        for batch in pieces(batches, limit=PART):
            done, out, doc, often, early, size = set(), [], [], [], [], []
            for d, s in zip(column(batch, "doc_id").to_pylist(), sets_of(texts(batch)), strict=True):
                if d is None or not len(s) or (g := _signature(s)) in done:
                    continue
                done.add(g)
                p = len(s) - needed(len(s)) + 1
                r = np.zeros(len(s), np.int64)
                if len(token):
                    at = np.searchsorted(token, s)
                    at[at == len(token)] = 0
                    r = np.where(token[at] == s, rank[at], 0)
                rare = s[r == 0]
                if len(rare) < p:
                    o = np.argsort(r, kind="stable")[:p]
                    out.append(s[o])
                    often.append(r[o] > 0)
                else:
                    out.append(rare[:p])
                    often.append(np.zeros(p, bool))
                doc.append(np.full(p, d, np.int64))
                early.append(np.arange(p) < _early(len(s)))
                size.append(np.full(p, len(s), np.int32))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(np.concatenate(doc)), pa.array(np.concatenate(often)), pa.array(np.concatenate(early)), pa.array(np.concatenate(size))], ["token", "doc_id", "often", "early", "n"])

    return run


def parities(tokens: np.ndarray) -> bytes:
    """A bit for each value of the tokens' low bits, set if an odd number of tokens has it; as many bits as tokens or up to twice as many."""
    size = max(64, 1 << max(0, len(tokens) - 1).bit_length())
    odd = np.bincount((tokens & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").tobytes()


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """The bitmap of fewer low bits: words of 64 bits, halves one over the other."""
    while bits.shape[-1] > size:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def apart(a: np.ndarray, b: np.ndarray) -> int:
    """A lower bound of the tokens that stand in one set only."""
    size = min(len(a), len(b))
    return int(np.bitwise_count(folded(a, size) ^ folded(b, size)).sum())


def possible(apart_, n_a, n_b):
    """Whether sets of these sizes can link: both <= (n_a + n_b - apart) / 2 and 100 both >= 75 (n_a + n_b - both)."""
    return (100 + PERCENT) * (n_a + n_b - apart_) >= 2 * PERCENT * (n_a + n_b)


def _sets(batches):
    alone("jaccard")
    for batch in pieces(batches, limit=PART):
        rows = [(d, len(s), parities(s), s.tobytes()) for d, w, s in zip(column(batch, "doc_id").to_pylist(), column(batch, "wanted").to_pylist(), sets_of(texts(batch)), strict=True) if _signature(s) == bytes(w)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["doc_id", "n", "bits", "tokens"])


def _bounded(batches):
    """Of pairs with their bitmaps those that may link."""
    for batch in batches:
        fine = []
        for x, y, n, m in zip(column(batch, "bits_a"), column(batch, "bits_b"), column(batch, "n_a").to_pylist(), column(batch, "n_b").to_pylist(), strict=True):
            fine.append(possible(apart(np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")), n, m))
        keep = pa.array(np.flatnonzero(fine), pa.int64())
        yield pa.RecordBatch.from_arrays([column(batch, "a").take(keep), column(batch, "b").take(keep)], ["a", "b"])


def _links(batches):
    """Of pairs with their sets those that link; a few sets are held at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part, fine = batch.slice(at, 256), []
            for a, b in zip(column(part, "tokens_a"), column(part, "tokens_b"), strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = overlap(x, y)
                fine.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            keep = pa.array(np.flatnonzero(fine), pa.int64())
            yield pa.RecordBatch.from_arrays([column(part, "a").take(keep), column(part, "b").take(keep)], ["a", "b"])


class Member(NamedTuple):
    doc: int
    component: int
    n: int
    bits: np.ndarray
    prefix: np.ndarray
    tokens: np.ndarray | None


class Group:
    """Documents as a matrix: the sorted union of their prefix tokens, and per token its members."""

    def __init__(self, docs: list[Member]):
        self.docs = docs
        self.component, self.n = (np.array([getattr(d, k) for d in docs], np.int64) for k in ("component", "n"))
        self.union, place = np.unique(np.concatenate([d.prefix for d in docs]), return_inverse=True)
        self.holds = np.zeros((len(self.union), len(docs)), bool)
        self.holds[place, np.repeat(np.arange(len(docs)), [len(d.prefix) for d in docs])] = True
        self.as_folded: dict[int, np.ndarray] = {}

    def folds(self, size: int) -> np.ndarray:
        """All members' bitmaps of so many words; those of fewer stay zero."""
        if size not in self.as_folded:
            self.as_folded[size] = np.array([folded(d.bits, size) if len(d.bits) >= size else np.zeros(size, np.uint64) for d in self.docs])
        return self.as_folded[size]

    def candidates(self, query: Member) -> list[tuple[float, int]]:
        """(bound of the tokens in one set only by the sizes, member number) of the members of other components that may link with a query."""
        at = np.searchsorted(self.union, query.prefix)
        at[at == len(self.union)] = 0
        at = at[self.union[at] == query.prefix]
        if not len(at):  # not all of the union would do
            return []
        n = query.n
        open_ = np.flatnonzero(self.holds[at].any(0) & (self.component != query.component) & (100 * np.minimum(self.n, n) >= PERCENT * np.maximum(self.n, n)))
        out = []
        words = np.array([min(len(self.docs[i].bits), len(query.bits)) for i in open_.tolist()])
        for size in np.unique(words).tolist():
            some = open_[words == size]
            least = np.bitwise_count(self.folds(size)[some] ^ folded(query.bits, size)).sum(1, dtype=np.int64)
            fine = possible(least, self.n[some], n)
            out += zip((least[fine] / (self.n[some][fine] + n)).tolist(), some[fine].tolist(), strict=True)
        return out


class Meeting:
    """A stored group and the documents that query it; what it gives is not more than the documents in it."""

    names, kinds = ("a", "b"), (pa.int64(), pa.int64())

    def __init__(self, place: tuple[int, int]):
        self.place, self.stored, self.group, self.up, self.out = place, [], None, {}, []

    def add(self, asks: int, member: Member) -> None:
        if not asks:
            self.stored.append(member)
            return
        if self.group is None:
            self.group = Group(self.stored)
        self.ask(member, self.group.candidates(member))

    def find(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def joined(self, a: int, b: int) -> bool:
        """Joins two components; False if they were one."""
        a, b = self.find(a), self.find(b)
        self.up[a] = b
        return a != b


class Best(Meeting):
    """A spanning forest of the pairs that may link, the best first."""

    def __init__(self, place):
        super().__init__(place)
        self.pairs: list[tuple[float, int, int, int, int]] = []

    def ask(self, query, found):
        for far, i in found:
            d = self.group.docs[i]
            self.pairs.append((far, query.doc, d.doc, query.component, d.component))

    def rows(self):
        return [(a, b) for _, a, b, ca, cb in sorted(self.pairs) if self.joined(ca, cb)]


class Remaining(Meeting):
    """The documents that have a pair that may link."""

    names, kinds = ("ga", "part", "query", "doc_id"), (pa.int64(), pa.int64(), pa.int32(), pa.int64())

    def ask(self, query, found):
        if found:
            self.out.append((*self.place, 1, query.doc))
            self.up.update((i, i) for _, i in found)

    def rows(self):
        return self.out + [(*self.place, 0, self.group.docs[i].doc) for i in self.up]


class Exact(Meeting):
    """A spanning forest of the links."""

    def ask(self, query, found):
        for _, i in sorted(found):
            d = self.group.docs[i]
            if self.find(query.component) != self.find(d.component):
                both = overlap(query.tokens, d.tokens)
                if 100 * both >= PERCENT * (query.n + d.n - both):
                    self.joined(query.component, d.component)
                    self.out.append((query.doc, d.doc))

    def rows(self):
        return self.out


def _met(kind):
    """Documents by place (ga, part), those of the stored group before those that query it."""

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(kind.kinds), kind.kinds, strict=True)], list(kind.names))

    def run(batches):
        alone("jaccard")
        now = None
        for batch in batches:
            out = []
            sets = column(batch, "tokens") if "tokens" in batch.schema.names else [None] * batch.num_rows
            rows = zip(*(column(batch, c).to_pylist() for c in ("ga", "part", "query", "doc_id", "component", "n")), column(batch, "bits"), column(batch, "prefix").to_pylist(), sets, strict=True)
            for ga, part, asks, doc, component, n, bits, prefix, tokens in rows:
                if now is None or (ga, part) != now.place:
                    out += now.rows() if now else []
                    now = kind((ga, part))
                # copies: a batch's memory is given back before the group is done
                now.add(asks, Member(doc, component, n, np.frombuffer(bits.as_py(), "<u8"), np.array(prefix, np.int64), None if tokens is None else np.frombuffer(tokens.as_py(), np.uint64)))
            if out:
                yield table(out)
        if now:
            yield table(now.rows())

    return run


def _meetings(places: DataFrame, documents: DataFrame, kind, schema: str) -> DataFrame:
    """Brings documents together at their places (doc_id, component, ga, part, query)."""
    width = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = documents.join(_small(places), "doc_id").repartition(width, "ga", "part").sortWithinPartitions("ga", "part", "query")
    return both.mapInArrow(_met(kind), schema)


def _fits(a: str, b: str) -> str:
    return f"100 * least({a}, {b}) >= {PERCENT} * greatest({a}, {b})"


def _verified(pairs: DataFrame, sets: DataFrame, bounded: bool = False) -> DataFrame:
    """The pairs (a, b) that link. Bitmaps travel first (unless bounded already), whole sets only for the pairs that these leave."""

    def of(side: str, *names: str) -> DataFrame:
        return sets.select(F.col("doc_id").alias(side), *(F.col(x).alias(f"{x}_{side}") for x in names))

    if not bounded:
        near = _small(pairs).join(of("a", "n", "bits"), "a").join(of("b", "n", "bits"), "b").filter(_fits("n_a", "n_b"))
        pairs = saved(near.mapInArrow(_bounded, "a long, b long"), "near")
    ids = pairs.select("b").distinct()
    return _small(pairs).join(of("a", "tokens"), "a").join(of("b", "tokens").join(_small(ids), "b", "left_semi"), "b").mapInArrow(_links, "a long, b long")


def _frequent(sketch: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    seen = saved(sketch.filter("seen > 0").groupBy("token").agg(F.sum("seen").alias("seen")), "frequent")
    if seen.count() > FREQUENT:
        seen = seen.orderBy(F.desc("seen"), "token").limit(FREQUENT)
    got = seen.toArrow()
    token, n = got["token"].to_numpy().view(np.uint64), got["seen"].to_numpy()
    o = np.argsort(token)
    return token[o], n[o]


def _stars(keys: DataFrame, labels: DataFrame | None, sets: DataFrame, number: int) -> DataFrame:
    """Links of group members with their group's leader: another leader in each round; members in the leader's component are settled."""
    if labels is not None:
        keys = keys.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("c", F.coalesce("component", "doc_id"))
    else:
        keys = keys.withColumn("c", F.col("doc_id"))
    leader = keys.groupBy("perm", "key").agg(F.min_by(F.struct(F.col("doc_id"), F.col("c")), F.xxhash64(F.col("doc_id"), F.lit(number))).alias("lead"), F.min("c").alias("c0"), F.max("c").alias("c1")).filter("c0 <> c1").select("perm", "key", F.col("lead.doc_id").alias("b"), F.col("lead.c").alias("cb"))
    # a min-hash that very many documents share is dealt into parts, each with its leader's row
    leader = leader.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    keys = keys.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int"))
    pairs = saved(keys.join(leader, ["perm", "key", "salt"]).filter("c <> cb").select(F.col("doc_id").alias("a"), "b").distinct(), "pairs")
    return _verified(pairs, sets)


def linked(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    return _linked(bounded(documents))


def _linked(documents: DataFrame) -> DataFrame:
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sketch = saved(docs.mapInArrow(_sketched, SKETCH), "sketch")
    rows = sketch.filter("sig is not null").select("doc_id", "n", "sig", "mins")
    same = saved(rows.filter("n > 0 and doc_id is not null").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("mins").alias("mins")), "same")
    # 2. prefix tokens that stand in more than one distinct set
    frequent = spark.sparkContext.broadcast(_frequent(sketch))
    posts = docs.filter("doc_id is not null").mapInArrow(_prefixes(frequent), "token long, doc_id long, often boolean, early boolean, n int")
    rare = posts.filter("not often").selectExpr("token", "doc_id", "early", "n", "min(doc_id) over (partition by token) as lo", "max(doc_id) over (partition by token) as hi").filter("lo <> hi").select("token", "doc_id", "early", "n")
    shared = saved(rare.unionByName(posts.filter("often").select("token", "doc_id", "early", "n")), "shared")
    rep_of = rows.select("doc_id", "sig").join(same.select("sig", "rep"), "sig").select("doc_id", "rep").distinct()
    posts = saved(shared.join(rep_of, "doc_id").select("token", F.col("rep").alias("doc_id"), "early", "n").distinct(), "posts")
    matrix = saved(fitting(posts), "matrix")
    for done in (shared, posts):
        drop_saved(done)
    posts = matrix
    release(spark)
    open_docs = saved(posts.select("doc_id").distinct().join(same.select(F.col("rep").alias("doc_id"), "sig", "mins"), "doc_id"), "open")
    # a doc_id that comes twice with one text gives two like sets, which changes nothing below
    sets = docs.join(_small(open_docs.select("doc_id", F.col("sig").alias("wanted"))), "doc_id").mapInArrow(_sets, "doc_id long, n long, bits binary, tokens binary")
    sets = saved(sets, "sets")
    release(spark)
    # 4. stars
    keys = saved(open_docs.select("doc_id", F.posexplode("mins").alias("perm", "key")), "keys")
    labels = None
    for number in range(2):
        links = saved(_stars(keys, labels, sets, number), "links")
        release(spark)
        labels = components(links, labels)
        release(spark)
    drop_saved(keys)
    # 5. the token-group matrix
    places, prefixes = _across(posts, labels, sets)
    release(spark)
    light = sets.select("doc_id", "n", "bits").join(prefixes, "doc_id")
    best = saved(_meetings(places, light, Best, "a long, b long").distinct(), "best")
    labels = components(saved(_verified(best, sets, True), "links"), labels)
    release(spark)
    now = labels.select(F.col("node").alias("doc_id"), F.col("component").alias("now"))
    places = saved(places.join(now, "doc_id", "left").withColumn("component", F.coalesce("now", "doc_id")).drop("now"), "places")
    rest = saved(_meetings(places, light, Remaining, "ga long, part long, query int, doc_id long"), "rest")
    rest = rest.join(now, "doc_id", "left").withColumn("component", F.coalesce("now", "doc_id")).drop("now")
    links = saved(_meetings(rest, sets.select("doc_id", "n", "bits", "tokens").join(prefixes, "doc_id"), Exact, "a long, b long"), "links")
    for done in (sets, prefixes, places):
        drop_saved(done)
    labels = components(links, labels).withColumnRenamed("node", "rep")
    classes = same.select("sig", "rep").join(labels, "rep", "left").select("sig", F.coalesce("component", "rep").alias("component"))
    alone = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return rows.join(classes, "sig", "left").select("doc_id", F.col("n").alias("n_shingles"), alone.alias("component_id"))


def _across(posts: DataFrame, labels: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Which documents meet where (doc_id, component, ga, part, query), and the prefix tokens of each, saved. Deletes the table of prefix tokens, which nothing needs after it."""
    labels = labels.withColumnRenamed("node", "doc_id")
    frequency = posts.groupBy("token").agg(F.count(F.lit(1)).alias("f"))
    common = posts.join(frequency, "token").groupBy("doc_id").agg(F.max(F.struct("f", "token")).alias("t"))
    member = sets.select("doc_id", "n").distinct().join(labels, "doc_id", "left").join(common, "doc_id").select("doc_id", "n", F.coalesce("component", "doc_id").alias("component"), F.when(F.col("component").isNull(), F.col("t.token")).otherwise(F.col("component")).alias("near"))
    # documents of like size together: long ones are few and fit few others
    member = member.withColumn("near", F.xxhash64("near", F.floor(F.log2("n")))).select("doc_id", "n", "component", "near")
    parts = member.groupBy("near").agg(F.ceil(F.greatest(F.count(F.lit(1)) / MEMBERS, F.sum("n") / TOKENS)).alias("parts"))
    member = saved(member.join(parts, "near").select("doc_id", "n", "component", F.xxhash64("near", F.pmod(F.xxhash64("doc_id"), F.col("parts"))).alias("g")), "members")
    cells = posts.join(member, "doc_id").groupBy("token", "g").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("n").alias("least"), F.max("n").alias("most"), F.count(F.lit(1)).alias("m"))
    several = cells.groupBy("token").agg(F.min("lo").alias("all_lo"), F.max("hi").alias("all_hi")).filter("all_lo <> all_hi").select("token")
    cells = saved(cells.join(several, "token", "left_semi"), "cells")
    release(sets.sparkSession)
    # of the groups that hold a token, those within its largest component need no comparison with each other
    largest = cells.filter("lo = hi").groupBy("token", "lo").agg(F.sum("m").alias("m")).groupBy("token").agg(F.max_by("lo", F.struct("m", "lo")).alias("largest"))
    asking = cells.join(largest, "token", "left").filter("not (lo = hi and lo <=> largest)").select("token", *(F.col(c).alias(f"{c}_a") for c in ("g", "lo", "hi", "least", "most")))
    fits = f"100 * most_a >= {PERCENT} * least and 100 * most >= {PERCENT} * least_a"
    pairs = asking.join(cells, "token").filter(f"{fits} and not (lo_a = hi_a and lo_a = lo and lo = hi)").select(F.least("g", "g_a").alias("x"), F.greatest("g", "g_a").alias("y")).distinct()
    size = member.groupBy("g").agg(F.sum("n").alias("tokens"))
    sizes = pairs.join(size.select(F.col("g").alias("x"), F.col("tokens").alias("tx")), "x").join(size.select(F.col("g").alias("y"), F.col("tokens").alias("ty")), "y")
    # the smaller group travels to the larger
    pairs = saved(sizes.select(F.when(F.expr("tx >= ty"), F.col("x")).otherwise(F.col("y")).alias("ga"), F.when(F.expr("tx >= ty"), F.col("y")).otherwise(F.col("x")).alias("gb")), "pairs")
    # a group with many queries is stored once more for each further part of them
    several = pairs.groupBy("ga").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("parts"))
    pairs = saved(pairs.join(several, "ga").select("ga", "gb", F.pmod(F.xxhash64("gb"), F.col("parts")).alias("part")), "parted")
    stored = pairs.select(F.col("ga").alias("g"), "ga", "part", F.lit(0).alias("query")).distinct()
    asking = pairs.select(F.col("gb").alias("g"), "ga", "part", F.lit(1).alias("query"))
    places = saved(member.join(stored.unionByName(asking), "g").select("doc_id", "component", "ga", "part", "query"), "places")
    prefixes = saved(posts.join(_small(places.select("doc_id").distinct()), "doc_id", "left_semi").groupBy("doc_id").agg(F.collect_list("token").alias("prefix")), "prefixes")
    for done in (posts, cells):
        drop_saved(done)
    return places, prefixes


def deduplicated(documents: DataFrame) -> DataFrame:
    """One row of each component stays, the one with its smallest doc_id (null is larger than any); columns stay as they are.

    Where a doc_id is null or stands in several rows, rows are numbered in a saved copy and joined by these numbers,
    so that each is judged by its own text.
    """
    ids = documents.agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("ids"), F.count_distinct("doc_id").alias("distinct")).first()
    if ids["n"] == ids["distinct"]:
        kept = linked(documents).filter("doc_id = component_id").select("doc_id")
        return documents.join(kept, "doc_id", "left_semi").select(*documents.columns)
    numbered = saved(documents.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("number")), "numbered")
    found = linked(numbered.select(F.col("number").alias("doc_id"), "row.text")).select(F.col("doc_id").alias("number"), "component_id")
    first = F.min_by("number", F.struct(F.col("doc_id").isNull(), "doc_id", "number"))
    kept = numbered.select("number", "row.doc_id").join(found, "number").groupBy("component_id").agg(first.alias("number")).select("number")
    return numbered.join(kept, "number", "left_semi").select("row.*")
