"""Entity co-occurrence graphs: nodes, weighted edges, hubs, and retrieval by a bounded walk."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..sources.files import written
from .retrieve import PLACES, blocks_of, ranked
from .scan import bounded


def _sets(mentions: DataFrame, min_frequency: int) -> DataFrame:
    """chunk_id, e: the entities of each chunk that stand in enough chunks. Those that do not are written, so that they are broadcast where they are few."""
    known = mentions.filter("chunk_id is not null and entity is not null")
    by_entity = known.groupBy("entity")
    few = by_entity.agg(F.min("chunk_id").alias("a"), F.max("chunk_id").alias("b")).filter("a = b") if min_frequency == 2 else by_entity.agg(F.count_distinct("chunk_id").alias("n")).filter(F.col("n") < min_frequency)
    return known.join(written(few.select("entity"), "few"), "entity", "left_anti").groupBy("chunk_id").agg(F.collect_set("entity").alias("e")).filter("size(e) > 1")


def edges(mentions: DataFrame, min_frequency: int = 2) -> DataFrame:
    """(chunk_id, entity) to src, dst, weight in both directions: chunks that hold both. Entities of fewer chunks keep no edge. A chunk has a bounded number of entities, so pairs are made within its array."""
    sets = _sets(mentions, min_frequency).select(F.array_sort("e").alias("e"))
    pairs = sets.select(F.explode(F.flatten(F.transform("e", lambda a, i: F.transform(F.slice("e", i + 2, F.size("e")), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("weight"))
    return pairs.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e"), "weight").select("e.src", "e.dst", "weight")


def pruned(graph: DataFrame, max_degree: int = 40) -> DataFrame:
    """The heaviest neighbours of each entity; its own side only."""
    return graph.withColumn("n", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("weight"), "dst"))).filter(F.col("n") <= max_degree).drop("n")


def _counted(at: np.ndarray, others: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The distinct pairs of two columns by the first, then the second, and how often each stands there."""
    coded = others.dictionary_encode()
    names = coded.dictionary
    order = np.asarray(pc.array_sort_indices(names))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    width = max(1, len(order))
    pair = np.sort(at * width + place[coded.indices.to_numpy(zero_copy_only=False)])
    first = np.flatnonzero(np.diff(pair, prepend=-1))
    return pair[first] // width, names.take(pa.array(order[pair[first] % width])), np.diff(first, append=len(pair))


def _heaviest(batches: Iterator[pa.RecordBatch], most: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows (src, all entities of a chunk that holds it), by src, to its heaviest neighbours. The counts of the last src wait for its next rows, one for each neighbour."""

    def top(src, at, dst, n):
        order = np.argsort(at * (n.max(initial=0) + 1) - n, kind="stable")
        start = np.searchsorted(at, at)
        some = order[np.arange(len(order)) - start < most]  # at stays in order, as it is what is sorted by first
        return pa.RecordBatch.from_arrays([src.take(pa.array(at[some])), dst.take(pa.array(some)), pa.array(n[some])], names)

    src = dst = n = None
    for b in batches:
        if not b.num_rows:
            continue
        coded, e = b.column(0).dictionary_encode(), b.column(1)
        own = np.repeat(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.asarray(pc.list_value_length(e)))
        flat = e.flatten()
        other = pc.not_equal(coded.dictionary.take(pa.array(own)), flat)
        at, others, weight = _counted(own[other.to_numpy(zero_copy_only=False)], flat.filter(other))
        last = len(coded.dictionary) - 1
        ends = [int(x) for x in np.searchsorted(at, [1, last])]
        if src is not None and src[0] == coded.dictionary[0]:
            both = pa.table({"d": pa.concat_arrays([dst, others[: ends[0]]]), "n": np.concatenate([n, weight[: ends[0]]])}).group_by("d").aggregate([("n", "sum")]).sort_by("d")
            dst, n = both["d"].combine_chunks(), both["n_sum"].to_numpy()
            begin = ends[0]
        else:
            begin = 0
        if src is not None and (begin == 0 or last > 0):
            yield top(src, np.zeros(len(n), np.int64), dst, n)
            src = None
        if src is None:
            cut = max(begin, ends[1])
            yield top(coded.dictionary, at[begin:cut], others[begin:cut], weight[begin:cut])
            src, dst, n = coded.dictionary[last:], others[cut:], weight[cut:]
    if src is not None:
        yield top(src, np.zeros(len(n), np.int64), dst, n)


def heaviest(mentions: DataFrame, max_degree: int = 10, min_frequency: int = 2) -> DataFrame:
    """pruned(edges(mentions)): an entity's chunks, each with all that it holds, come to one task, which counts and ranks there; edges are not shuffled."""
    names = ["src", "dst", "weight"]
    rows = _sets(mentions, min_frequency).select(F.explode("e").alias("src"), "e").repartition("src").sortWithinPartitions("src")
    kind = rows.schema["src"].dataType
    return bounded(rows).mapInArrow(lambda batches: _heaviest(batches, max_degree, names), StructType([StructField("src", kind), StructField("dst", kind), StructField("weight", LongType())]))


def stats(graph: DataFrame, mentions: DataFrame | None = None, min_frequency: int = 2) -> DataFrame:
    """Numbers of entities and edges and the degrees. With mentions (chunk_id, entity), entities that stand in enough chunks but beside no other count too, with degree 0."""
    deg = graph.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    if mentions is not None:
        often = mentions.groupBy(F.col("entity").alias("src")).agg(F.count_distinct("chunk_id").alias("n")).filter(F.col("n") >= min_frequency).select("src")
        deg = often.join(deg, "src", "left").select("src", F.coalesce("degree", F.lit(0)).alias("degree"))
    return deg.agg(F.count(F.lit(1)).alias("entities"), F.floor(F.sum("degree") / 2).alias("edges"), F.round(F.avg("degree"), 4).alias("mean_degree"), F.max("degree").alias("max_degree"))


def reached(seeds: DataFrame, graph: DataFrame, hops: int = 1, neighbours: int = 10) -> DataFrame:
    """query_id, entity, distance: what lies within so many hops of the seeds (query_id, entity) over the heaviest neighbours of each entity, at its least distance.

    The neighbours are written once, not made again for each level. Each level is written before the next is looked for, so a level is joined once, and the
    walk ends where nothing new is found. A level holds at most `neighbours` times the rows of the one before.
    """
    near = pruned(graph, neighbours).select("src", "dst")
    near = written(near, "near") if hops > 1 else near
    front = written(seeds.select("query_id", "entity").distinct().withColumn("distance", F.lit(0)), "level")
    out = front
    for hop in range(1, hops + 1):
        step = front.join(near, front["entity"] == near["src"]).select("query_id", F.col("dst").alias("entity")).distinct()
        new = step.join(out, ["query_id", "entity"], "left_anti").withColumn("distance", F.lit(hop))
        if hop == hops:
            return out.unionByName(new)
        front = written(new, "level")
        if front.isEmpty():
            break
        out = out.unionByName(front)
    return out


def walk(seeds: DataFrame, graph: DataFrame, mentions: DataFrame, hops: int = 1, neighbours: int = 10, k: int = 5) -> DataFrame:
    """(query_id, entity) seeds, up to so many hops over the heaviest neighbours; a chunk's score is the sum of 1 / (1 + distance) over its reached entities."""
    near = reached(seeds, graph, hops, neighbours)
    if hops > 1:
        return _first(written(near, "reached"), mentions, k)
    return ranked(_summed(near, mentions.distinct()), k)


def _summed(near: DataFrame, held: DataFrame, *on: str) -> DataFrame:
    return near.join(held, [*on, "entity"]).groupBy("query_id", "chunk_id").agg(F.sum(1 / (1 + F.col("distance"))).alias("score"))


def _first(near: DataFrame, mentions: DataFrame, k: int) -> DataFrame:
    """The first k chunks of each question by the sum over all reached entities (query_id, entity, distance); only chunks that can be among them are summed.

    What the seeds and their neighbours give a chunk is the least that it scores; the k-th of these sums is a floor. A chunk that holds one of them is
    left out if all its other entities at distance 2 would not lift it to the floor. One that holds none needs as many reached entities as the floor has
    thirds, so of its entities without all but one of so many at least one is reached; those without are the ones that most questions
    reach. A question without a floor keeps all chunks.
    """
    asked = near.groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    rows = mentions.join(asked, "entity").groupBy("chunk_id").agg(F.array_sort(F.collect_set(F.struct("n", "entity"))).alias("e"))
    held = written(rows.select("chunk_id", F.col("e.entity").alias("e"), F.size("e").alias("size")), "held")
    one = held.select("chunk_id", "size", F.explode("e").alias("entity"))
    close = written(near.filter("distance <= 1").join(one, "entity").groupBy("query_id", "chunk_id").agg(F.sum(1 / (1 + F.col("distance"))).alias("score"), (F.first("size") - F.count(F.lit(1))).alias("others")), "close")
    floor = written(ranked(close.select("query_id", "chunk_id", "score"), k).filter(F.col("rank") == k).select("query_id", (F.col("score") - 10.0 ** (1 - PLACES)).alias("floor")), "floor")
    some = close.join(floor, "query_id", "left").filter(F.col("floor").isNull() | (F.col("score") + F.col("others") / 3 >= F.col("floor"))).select("query_id", "chunk_id")
    far = near.filter("distance > 1").join(floor, "query_id", "left").select("query_id", "entity", F.coalesce(F.ceil(3 * F.col("floor")), F.lit(1)).alias("needs"))
    lowest = far.agg(F.min("needs")).first()[0] or 1
    rest = held.filter(F.col("size") >= lowest).select("chunk_id", "size", F.posexplode(F.slice("e", F.lit(1), F.col("size") - lowest + 1)).alias("at", "entity"))
    some = some.unionByName(far.join(rest, "entity").filter(F.col("at") <= F.col("size") - F.col("needs")).select("query_id", "chunk_id")).distinct()
    whole = some.join(held.withColumnRenamed("chunk_id", "_held"), F.col("chunk_id").eqNullSafe(F.col("_held"))).select("query_id", "chunk_id", F.explode("e").alias("entity"))
    return ranked(_summed(near, whole, "query_id"), k)


def seeds(questions: DataFrame, entities: DataFrame) -> DataFrame:
    """query_id, entity: entities (lower-cased) that stand in a question as a substring. Questions are a stated set, held against all entities in blocks."""
    out, names = None, entities.select(F.lower("entity").alias("entity")).distinct()
    for q in blocks_of(questions.select("query_id", F.lower("query").alias("low"))):
        one = names.join(F.broadcast(q), F.contains(F.col("low"), F.col("entity"))).select("query_id", "entity")
        out = one if out is None else out.unionByName(one)
    return out


def retrieve(questions: DataFrame, graph: DataFrame, mentions: DataFrame, hops: int = 1, k: int = 5, named: DataFrame | None = None) -> DataFrame:
    """Lists by a walk from the entities that a question names; a question without any has no list. mentions: chunk_id, entity; named: the mentions of which a question may name an entity, if these are others."""
    low = mentions.select("chunk_id", F.lower("entity").alias("entity"))
    return walk(seeds(questions, low if named is None else named), graph, low, hops, k=k)


def frequencies(mentions: DataFrame, top: int | None = None) -> DataFrame:
    """entity (lower-cased), n: in how many chunks; the top ones, if asked."""
    out = mentions.groupBy(F.lower("entity").alias("entity")).agg(F.count(F.lit(1)).alias("n"))
    return out.orderBy(F.desc("n"), "entity").limit(top) if top else out
