"""Ranked lists: (query_id, chunk_id, score, rank). Every operator answers a whole table of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.stemmer import stems
from ..functions.text import looks_lexical, tokens, unstopped
from ..session import EVAL_DEPTH, RRF_K, TOP_K

K1, B = 1.5, 0.75
#: Bytes of a question set, by the plan's statistics, up to which it is broadcast whole; a larger one is dealt into blocks of about so many.
BROADCAST_BYTES = 64 << 20
#: Places to which scores are held against each other: sums of the same terms in another order differ after these.
PLACES = 10


def ranked(scored: DataFrame, k: int | None, *ties: str, by: str = "query_id") -> DataFrame:
    """Ranks from 1 by score (descending, to PLACES), then the tie columns; the first k. Scores stay as they are."""
    w = Window.partitionBy(by).orderBy(F.desc(F.round("score", PLACES)), *(ties or ("chunk_id",)))
    out = scored.withColumn("rank", F.row_number().over(w))
    return out.filter(F.col("rank") <= k) if k else out


def blocks_of(queries: DataFrame, most: int = BROADCAST_BYTES) -> list[DataFrame]:
    """A stated question set as one block, or as several of about so many bytes. A set that the plan knows to be small costs no job; else its bytes are summed."""
    size = int(str(queries._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > most:
        size = queries.agg(F.sum(F.length(F.to_json(F.struct(*queries.columns)))).alias("n")).first()["n"] or 0
    n = max(1, -(-size // most))
    return [queries] if n == 1 else [queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i) for i in range(n)]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dense(queries: DataFrame, vectors: DataFrame, k: int | None = TOP_K, where: Column | None = None) -> DataFrame:
    """Exact cosine top-k of unit vectors. A filter is applied below the ranking, so it reaches the scan and never under-returns.

    The question set is stated and is broadcast in blocks of a bounded size (blocks_of): each block scans the
    vectors once and keeps k rows per question and batch before the shuffle (scan.vectors). Whole lists (k None) and
    questions whose vectors differ in length are scored pair by pair.
    """
    from . import scan

    rows = vectors.filter(where) if where is not None else vectors
    out = None
    for q in blocks_of(queries, scan.VECTOR_BYTES) if k else blocks_of(queries):
        top = scan.vectors(q, rows, k) if k else None
        if top is not None:
            out = top if out is None else out.unionByName(top)
            continue
        scored = rows.join(F.broadcast(q), F.lit(True)).select("query_id", "chunk_id", dot(F.col("embedding"), F.col("query")).alias("score"))
        top = ranked(scored, k)
        out = top if out is None else out.unionByName(top)
    return out


def term_statistics(docs: DataFrame) -> DataFrame:
    """term, df, idf over (doc_id, text)."""
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    df = docs.select("doc_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.join(F.broadcast(n)).select("term", "df", F.round(F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), 6).alias("idf"))


def stemmed(docs: DataFrame) -> DataFrame:
    """docs (with text) with terms: the stems of a text's words without stop words, in order. Each distinct word is stemmed once and joined back; a row needs no key."""
    keyed = docs.withColumn("_row", F.monotonically_increasing_id())
    words = keyed.select("_row", F.posexplode(unstopped(F.col("text"))).alias("at", "word"))
    terms = words.join(stems(words), "word").groupBy("_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "stem"))), lambda x: x["stem"]).alias("terms"))
    return keyed.join(terms, "_row", "left").withColumn("terms", F.coalesce("terms", F.expr("cast(array() as array<string>)"))).drop("_row")


def postings(docs: DataFrame, words=None) -> DataFrame:
    """(chunk_id, text) to chunk_id, term, tf, size: one row for each distinct word of a chunk. words: how a text is cut; tokens by default."""
    cut = (words or tokens)(F.col("text"))
    rows = docs.select("chunk_id", cut.alias("words")).withColumn("size", F.size("words"))
    return rows.select("chunk_id", "size", F.explode("words").alias("term")).groupBy("chunk_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("size").alias("size"))


def bm25(queries: DataFrame, docs: DataFrame, k: int = TOP_K, where: Column | None = None, pad: bool = False, words=None) -> DataFrame:
    """BM25 top-k of (query_id, query) over (chunk_id, text); distinct query terms; blank questions give nothing.

    Only words of the questions are kept from the texts before anything is shuffled. pad: fill lists up
    to k with chunks of score 0, by chunk_id. words: how texts are cut (tokens, or stemmed).
    """
    cut = words or tokens
    rows = (docs.filter(where) if where is not None else docs).select("chunk_id", cut(F.col("text")).alias("words"))
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce(F.size("words"), F.lit(0))).alias("mean"))
    asked = queries.select("query_id", F.explode(F.array_distinct(cut(F.col("query")))).alias("term"))
    wanted = asked.select("term").distinct()
    tf = rows.select("chunk_id", F.size("words").alias("size"), F.explode("words").alias("term")).join(wanted, "term").groupBy("term", "chunk_id").agg(F.count(F.lit(1)).alias("tf"), F.first("size").alias("size"))
    out = bm25_scored(asked, tf, tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")), whole, k)
    if pad:
        first = rows.select("chunk_id").orderBy("chunk_id").limit(2 * k)
        blank = queries.filter(F.size(cut(F.col("query"))) > 0).select("query_id").join(F.broadcast(first)).join(out, ["query_id", "chunk_id"], "left_anti").select("query_id", "chunk_id", F.lit(0.0).alias("score"))
        out = ranked(out.select("query_id", "chunk_id", "score").unionByName(blank), k)
    return out


def bm25_scored(asked: DataFrame, tf: DataFrame, df: DataFrame, whole: DataFrame, k: int) -> DataFrame:
    """Top-k from postings (term, chunk_id, tf, size), document counts (term, df) and the collection's one row (n, mean)."""
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("mean")))
    scored = asked.join(tf.join(df, "term").join(F.broadcast(whole)), "term").groupBy("query_id", "chunk_id").agg(F.sum(part).alias("score"))
    return ranked(scored, k)


def overlap(queries: DataFrame, docs: DataFrame | None, k: int = TOP_K, posts: DataFrame | None = None) -> DataFrame:
    """Top-k by the share of a question's distinct words that stand in a chunk; posts: written postings (chunk_id, term) in place of texts."""
    asked, words = _asked_and_words(queries, docs, posts)
    scored = asked.join(words, "term").groupBy("query_id", "chunk_id").agg((F.count(F.lit(1)) / F.first("n")).alias("score"))
    return ranked(scored, k)


def overlap_of(shortlist: DataFrame, queries: DataFrame, docs: DataFrame | None, posts: DataFrame | None = None) -> DataFrame:
    """The shortlist's query_id, chunk_id and rank with the overlap of each pair (other), 0 where no word is shared; no other pair is scored."""
    asked, words = _asked_and_words(queries, docs, posts)
    pairs = shortlist.select("query_id", "chunk_id", "rank").join(asked, "query_id").join(words.withColumn("hit", F.lit(1)), ["chunk_id", "term"], "left")
    return pairs.groupBy("query_id", "chunk_id", "rank").agg((F.count("hit") / F.first("n")).alias("other"))


def _asked_and_words(queries: DataFrame, docs: DataFrame | None, posts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """query_id, n, term of the questions' distinct words, and chunk_id, term where these stand."""
    asked = queries.select("query_id", F.array_distinct(tokens(F.col("query"))).alias("terms")).filter("size(terms) > 0").select("query_id", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    words = posts.select("chunk_id", "term") if posts is not None else docs.select("chunk_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    return asked, words.join(asked.select("term").distinct(), "term", "left_semi")


def no_scores() -> Column:
    return F.expr("cast(map() as map<string,double>)")


def with_origin(lists: DataFrame, name: str) -> DataFrame:
    """Lists with a map of scores (scores) in which their own stands under a name; scores that are there stay."""
    own = F.create_map(F.lit(name), F.col("score"))
    return lists.withColumn("scores", _joined(F.coalesce("scores", no_scores()), own) if "scores" in lists.columns else own)


def _joined(a: Column, b: Column) -> Column:
    """Two maps of scores as one; of two scores of one name the better."""
    return F.map_zip_with(a, b, lambda _, x, y: F.greatest(x, y))


def all_scores() -> Column:
    """The maps of scores of a group as one."""
    return F.aggregate(F.collect_list("scores"), no_scores(), _joined)


def _carried(lists: DataFrame) -> list[Column]:
    return [all_scores().alias("scores")] if "scores" in lists.columns else []


def fuse(lists: dict[str, DataFrame], k: int = TOP_K, rrf_k: int = RRF_K, weights: dict[str, float] | None = None) -> DataFrame:
    """Reciprocal rank fusion: a union and one aggregation. Ties keep the order of first appearance (list, then rank). ranks: the rank in each list. Maps of scores are joined where the lists have them, with the fused score as rrf."""
    rows = None
    for i, (name, r) in enumerate(lists.items()):
        more = ["scores"] if "scores" in r.columns else []
        one = r.select("query_id", "chunk_id", F.col("rank"), F.lit(i).alias("list"), F.lit(name).alias("name"), F.lit(float((weights or {}).get(name, 1.0))).alias("weight"), *more)
        rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
    if rows is None:
        raise ValueError("fusion needs at least one list")
    agg = rows.groupBy("query_id", "chunk_id").agg(F.sum(F.col("weight") / (F.lit(rrf_k) + F.col("rank"))).alias("score"), F.min(F.struct("list", "rank")).alias("first"), F.array_sort(F.collect_list(F.struct("name", "rank"))).alias("ranks"), *_carried(rows))
    out = ranked(agg, k, "first", "chunk_id")
    out = with_origin(out, "rrf") if "scores" in out.columns else out
    return out.drop("first").select("query_id", "chunk_id", "score", "rank", "ranks", *(c for c in out.columns if c == "scores"))


def fuse_variants(variant_lists: DataFrame, k: int = TOP_K, rrf_k: int = RRF_K) -> DataFrame:
    """Fuses the lists of a question's variants (query_id, variant, chunk_id, score, rank, and scores where they have them); a single variant keeps its own scores."""
    n = variant_lists.groupBy("query_id").agg(F.count_distinct("variant").alias("n_variants"))
    agg = variant_lists.groupBy("query_id", "chunk_id").agg(F.sum(1 / (F.lit(rrf_k) + F.col("rank"))).alias("fused"), F.max("score").alias("own"), F.min(F.struct("variant", "rank")).alias("first"), *_carried(variant_lists))
    scored = agg.join(n, "query_id").withColumn("score", F.when(F.col("n_variants") == 1, F.col("own")).otherwise(F.col("fused")))
    out = ranked(scored, k, "first", "chunk_id")
    return out.select("query_id", "chunk_id", "score", "rank", "n_variants", *(c for c in out.columns if c == "scores"))


def rerank(shortlist: DataFrame, score: Column, k: int = TOP_K) -> DataFrame:
    """Sorts a shortlist by another score and keeps where each row came from, and its map of scores with the new one as rerank; ties keep the shortlist's order."""
    rows = shortlist.withColumnRenamed("rank", "rank_before").withColumn("score", score)
    rows = with_origin(rows, "rerank") if "scores" in rows.columns else rows
    return ranked(rows, k, "rank_before").withColumn("moved", F.col("rank_before") - F.col("rank"))


def routed(queries: DataFrame, lexical, semantic) -> DataFrame:
    """Runs one plan on questions with identifiers and the other on the rest; each gets its part of the table."""
    flag = queries.withColumn("lexical", looks_lexical(F.col("query")))
    return lexical(flag.filter("lexical").drop("lexical")).withColumn("route", F.lit(1.0)).unionByName(semantic(flag.filter("not lexical").drop("lexical")).withColumn("route", F.lit(0.0)))


def to_documents(lists: DataFrame, doc: Column, depth: int = EVAL_DEPTH) -> DataFrame:
    """Chunk ranking to document ranking: the best rank of each document, ranked again."""
    best = lists.filter(F.col("rank") <= depth).groupBy("query_id", doc.alias("doc")).agg(F.min("rank").alias("best"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("best")))


def accumulated(hops: DataFrame, k: int = TOP_K) -> DataFrame:
    """The union of several hops' lists (query_id, hop, chunk_id, score): the best score of each chunk."""
    return ranked(hops.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"), F.count_distinct("hop").alias("n_hops")), k)


def llm_routed(queries: DataFrame, lexical, semantic, generator, log=None) -> DataFrame:
    """As routed(), by a generator's word: LEXICAL in its reply; an error or any other reply is semantic. Each question is asked once, through a log."""
    from ..sources.replies import replied

    asked = replied(queries, ROUTE_SYSTEM, F.concat(F.lit("Question: "), F.col("query"), F.lit("\n\nRoute:")), generator, 8, log)
    flag = asked.withColumn("lexical", F.contains(F.upper(F.coalesce("reply.text", F.lit(""))), F.lit("LEXICAL"))).drop("reply")
    return lexical(flag.filter("lexical").drop("lexical")).withColumn("route", F.lit(1.0)).unionByName(semantic(flag.filter("not lexical").drop("lexical")).withColumn("route", F.lit(0.0)))


ROUTE_SYSTEM = "Decide how to search for the question. Reply LEXICAL if it names an exact identifier, number or string, and SEMANTIC otherwise."


def overlap_count(a: DataFrame, b: DataFrame) -> DataFrame:
    """How many chunks of each question two lists share."""
    return a.select("query_id", "chunk_id").join(b.select("query_id", "chunk_id"), ["query_id", "chunk_id"]).groupBy("query_id").agg(F.count(F.lit(1)).alias("shared"))


def side_by_side(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two lists by question and rank: query_id, rank, left_id, right_id; null where one is shorter."""
    return a.select("query_id", "rank", F.col("chunk_id").alias("left_id")).join(b.select("query_id", "rank", F.col("chunk_id").alias("right_id")), ["query_id", "rank"], "full_outer")


def first_rank_of(lists: DataFrame, docs: DataFrame, fragment: Column) -> DataFrame:
    """The first rank at which a chunk's text holds a fragment (a column of lists or docs); questions without one are left out."""
    return lists.join(docs, "chunk_id").filter(F.contains(F.col("text"), fragment)).groupBy("query_id").agg(F.min("rank").alias("first_rank"))


def cosines(vectors: DataFrame, queries: DataFrame, places: int | None = None) -> DataFrame:
    """Cosines of a stated set (query_id, query) with all vectors: query_id, chunk_id, cosine, to so many places; vectors need not have length 1. Blocks of questions are held against batches of vectors (scan.cosines)."""
    from . import scan

    out = None
    for q in blocks_of(queries, scan.VECTOR_BYTES):
        one = scan.cosines(q, vectors, places)
        out = one if out is None else out.unionByName(one)
    return out
