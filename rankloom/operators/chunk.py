"""Chunkers: documents (doc_id, text) to chunks with code-point offsets."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import SEPARATORS, strip
from ..session import CHUNK_SIZE, OVERLAP


def fixed(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, chunk_index, chunk_id, text, start_char, end_char. Starts every size - overlap characters until one reaches the end; blank chunks are skipped, their index is not given again."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")
    n, step = F.length("text"), size - overlap
    last = F.when(n <= size, F.lit(0)).otherwise((F.ceil((n - size) / step) * step).cast("int"))
    cut = docs.filter("length(text) > 0").select("doc_id", "text", F.posexplode(F.sequence(F.lit(0), last, F.lit(step))).alias("chunk_index", "start_char"))
    piece = strip(F.expr(f"substring(text, start_char + 1, {size})"))
    out = cut.select("doc_id", "chunk_index", F.format_string("%s::%04d", F.col("doc_id").cast("string"), F.col("chunk_index")).alias("chunk_id"), piece.alias("text"), "start_char")
    return out.filter("text <> ''").withColumn("end_char", F.col("start_char") + F.length("text"))


def is_heading(part: str) -> bool:
    """A single line that begins with #."""
    line = part.strip()
    return line.startswith("#") and "\n" not in line


def units(text: str, start: int, end: int, separator: str) -> list[tuple[int, int]]:
    """Spans between the separators of a part of the text. Among paragraphs and lines a heading is no unit of its own: it opens the one after it."""
    found, at = [], start
    for m in re.finditer(re.escape(separator), text[start:end]):
        found.append((at, start + m.start()))
        at = start + m.end()
    found.append((at, end))
    if "\n" not in separator:
        return found
    openings = [i for i in range(len(found)) if i == 0 or not is_heading(text[slice(*found[i - 1])])]
    return [(found[i][0], found[j - 1][1]) for i, j in zip(openings, [*openings[1:], len(found)], strict=True)]


def spans(text: str, size: int, separators: tuple[str, ...]) -> list[tuple[int, int]]:
    """Spans of at most size characters that are not blank: units of the coarsest separator, as many as fit; a longer unit is cut by the next separator and shares no span with its neighbours. The last resort is to cut every size characters."""
    out, todo = [], [(0, len(text), 0)]
    while todo:
        start, end, level = todo.pop()
        if end - start <= size:
            if text[start:end].strip():
                out.append((start, end))
        elif level >= len(separators) or not separators[level]:
            todo += [(i, min(i + size, end), level) for i in reversed(range(start, end, size))]
        else:
            rows: list[tuple[int, int, int]] = []  # spans so far, with the level that cuts those which are too long
            for a, b in units(text, start, end, separators[level]):
                fits = rows and rows[-1][1] > rows[-1][0] and rows[-1][2] == level and b - rows[-1][0] <= size
                if fits:
                    rows[-1] = (rows[-1][0], b, level)
                else:
                    rows.append((a, b, level if b - a <= size else level + 1))
            todo += reversed(rows)
    return out


def tail_words(text: str, most: int) -> str:
    """The end of a text, at most so long; where it is cut, from after the first blank in it, if there is one."""
    if most <= 0:
        return ""
    tail = text[-most:]
    return (tail[tail.find(" ") + 1 :] if len(text) > most else tail).strip()


def recursive(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> DataFrame:
    """Chunks along paragraphs, lines, sentences, clauses and words; each but the first begins with the end of the one before."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")

    @F.pandas_udf("array<struct<text:string,start_char:int,end_char:int>>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"text": c, "start_char": i, "end_char": i + len(c)} for i, c in overlapping(t or "", spans(t or "", size, separators), overlap)])

    cut = docs.select("doc_id", F.posexplode(split("text")).alias("chunk_index", "c"))
    return cut.select("doc_id", "chunk_index", F.format_string("%s::%04d", F.col("doc_id").cast("string"), F.col("chunk_index")).alias("chunk_id"), "c.*")


def overlapping(text: str, cuts: list[tuple[int, int]], overlap: int) -> list[tuple[int, str]]:
    """Start and text of each span without white space around it, with the last words of the span before it and a blank in front; the start is then that of these words, as if only the blank stood between."""
    bodies = [text[a:b].strip() for a, b in cuts]
    tails = [tail_words(before, overlap) for before in ["", *bodies[:-1]][: len(bodies)]]
    starts = [a + len(text[a:b]) - len(text[a:b].lstrip()) for a, b in cuts]
    return [(max(0, at - len(tail) - 1), f"{tail} {body}") if tail else (at, body) for at, body, tail in zip(starts, bodies, tails, strict=True)]


def stats(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count(F.lit(1)).alias("n_chunks"), F.min(F.length("text")).alias("min_chars"), F.round(F.avg(F.length("text")), 4).alias("mean_chars"), F.max(F.length("text")).alias("max_chars"), F.count_if(~F.col("text").rlike(r"[.!?:]\s*$")).alias("cut_mid_sentence"))


def orphan_headings(chunks: DataFrame) -> DataFrame:
    return chunks.filter(F.col("text").rlike(r"(^|\n)\s*#[^\n]*\s*$"))


def adjacent(chunks: DataFrame) -> DataFrame:
    """Pairs of neighbours in a document and the characters that they share."""
    w = Window.partitionBy("doc_id").orderBy("chunk_index")
    nxt = chunks.select("doc_id", "chunk_id", "end_char", F.lead("chunk_id").over(w).alias("next_id"), F.lead("start_char").over(w).alias("next_start"))
    return nxt.filter("next_id is not null").select("doc_id", "chunk_id", "next_id", F.greatest(F.lit(0), F.col("end_char") - F.col("next_start")).alias("shared_chars"))


#: Characters of a document that its chunks' contexts are made from.
CONTEXT_CHARS = 12_000
CONTEXT_SYSTEM = "Say in one or two sentences where the passage stands in the document and what it is about. Reply with these sentences only."


def contextualised(chunks: DataFrame, docs: DataFrame, cache: DataFrame, generator, model: str = "", log=None) -> tuple[DataFrame, DataFrame]:
    """Chunks (chunk_id, doc_id, text) with a context from the cache (key, context) or a generator, and the new cache rows. Chunks without a document (doc_id, text) are left out; a failed call gives no context and no row. Replies come through a log, so rows and cache rows are of one reply."""
    from ..functions.text import cache_key, collapse, content_sha
    from ..sources.replies import replied

    whole = docs.select("doc_id", content_sha(F.col("text")).alias("sha"), F.substring("text", 1, CONTEXT_CHARS).alias("document"))
    keyed = chunks.join(whole, "doc_id").withColumn("key", cache_key(F.lit(model), F.col("sha"), F.col("chunk_id"), F.col("text")))
    misses = keyed.join(cache.select("key"), "key", "left_anti").dropDuplicates(["key"])
    prompt = F.concat(F.lit("Document:\n"), F.col("document"), F.lit("\n\nPassage:\n"), F.col("text"))
    new = replied(misses.select("key", "document", "text"), CONTEXT_SYSTEM, prompt, generator, 120, log).filter("reply.error is null").select("key", collapse(F.col("reply.text")).alias("context")).filter("context <> ''")
    return keyed.join(cache.select("key", "context").unionByName(new), "key", "left").drop("document", "key", "sha"), new


def paragraphs(docs: DataFrame, least: int = 80) -> DataFrame:
    """doc_id, paragraph (from 0, among all of its document) and text of paragraphs of more than so many characters."""
    cut = docs.select("doc_id", F.posexplode(F.split("text", r"\n\s*\n")).alias("paragraph", "p"))
    return cut.select("doc_id", "paragraph", strip(F.col("p")).alias("text")).filter(F.length("text") > least)


def first_right_rank(lists: DataFrame, relevant: DataFrame, depth: int | None = None) -> DataFrame:
    """query_id, first_rank: the best rank (within a depth) of a list's row (query_id, doc_id, rank), as of a search among paragraphs, whose document is relevant (query_id, doc_id); null where none is."""
    seen = lists if depth is None else lists.filter(F.col("rank") <= depth)
    hit = seen.join(relevant.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"]).groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    return lists.select("query_id").distinct().join(hit, "query_id", "left")


def merged_paragraphs(docs: DataFrame, most: int = 600) -> DataFrame:
    """doc_id, chunk_index, text: a paragraph joins those before it (after a blank line, which does not count) as long as their characters fit; a longer one stays whole. Empty paragraphs only add to the white space; nothing is stripped."""
    start = F.struct(F.lit("").alias("held"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        empty, full = acc["held"] == "", F.length(acc["held"]) + F.length(p) > most
        closes = ~empty & full
        return F.struct(F.when(empty | closes, p).otherwise(F.concat(acc["held"], F.lit("\n\n"), p)).alias("held"), F.when(closes, F.concat(acc["out"], F.array(acc["held"]))).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(F.split("text", r"\n\n"), start, step, lambda acc: F.when(acc["held"] == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["held"]))))
    return docs.select("doc_id", F.posexplode(done).alias("chunk_index", "text"))


def teaching_fixed(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """doc_id, chunk_index, text without offsets: a chunk starts every size - overlap characters up to the text's end, also where the one before reaches it."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")
    at = F.sequence(F.lit(0), F.length("text") - 1, F.lit(size - overlap))
    return docs.filter("length(text) > 0").select("doc_id", "text", F.posexplode(at).alias("chunk_index", "a")).select("doc_id", "chunk_index", F.expr(f"substring(text, a + 1, {size})").alias("text"))


def plan_name(kind: str, size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> str:
    """The name of a chunking, as reports show it."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")
    return f"{kind}({size}/{overlap})"


def outside(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents of chunks that are not in the table: empty if it is a subset."""
    return chunks.select("doc_id").distinct().join(docs.select("doc_id"), "doc_id", "left_anti")
