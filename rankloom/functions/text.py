"""Text expressions. All are built-in column functions; offsets and lengths are code points."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

#: What marks an answer as a refusal, as substrings of the lower-cased answer.
REFUSAL_MARKERS = (
    "does not provide", "do not provide", "does not contain", "do not contain", "does not mention", "do not mention", "does not specify", "do not specify", "does not say", "does not include", "does not appear",
    "doesn't provide", "doesn't contain", "doesn't mention", "no information", "not mentioned", "not specified", "not provided", "not contain enough", "not enough information", "no relevant", "nothing in the",
    "is not present", "not found in", "cannot answer", "can't answer", "cannot determine", "unable to answer", "insufficient",
)
#: Patterns of identifiers that make a question lexical; [0-9] as \d stands for more digits in some engines.
IDENTIFIERS = {
    "config_key": r"\b[A-Z][A-Z0-9]*_[A-Z0-9_]+\b",
    "ticket": r"\b[A-Z]{2,}-[0-9]+\b",
    "version": r"\bv?[0-9]+\.[0-9]+(?:\.[0-9]+)?\b",
    "status": r"(?i)\b(?:status|code|port|error)\s+[0-9]+\b",
    "call": r"\b[a-z_]+\([a-z_,\s]*\)",
}
#: Patterns of entities, most precise first; the group that holds the entity.
ENTITIES = ((r"\b[A-Z][A-Z0-9]*_[A-Z0-9_]+\b", 0), (r"\b[A-Z]{2,}-[0-9]+\b", 0), (r"`([^`]{2,40})`", 1), (r"\b(?:BM25|RRF|HNSW|IVF|nDCG|MRR|OCR|HyDE|CRAG)\b", 0), (r"\b[A-Z][a-z]+(?:[ \t]+[A-Z][a-z]+){1,3}\b", 0))
#: Words that no entity begins or ends with.
STOP_ENTITIES = (
    "the", "this", "that", "a", "an", "it", "they", "there", "some", "most", "each", "both", "two", "three", "one", "when", "where", "which", "what", "why", "how",
    "if", "so", "and", "but", "for", "with", "without", "before", "after", "note", "hence", "then", "also", "only", "every", "any", "no", "not", "use", "used", "using",
    "do", "does", "doing", "is", "are", "was", "were", "be", "being",
)
#: Separators of the recursive chunker, coarsest first.
SEPARATORS = ("\n\n", "\n", ". ", "? ", "! ", "; ", ", ", " ", "")
WORD = r"[\p{L}\p{N}_]{2,}"
#: What stands around an entity and is not part of it; bullets and numbers before a query variant; marks of citations.
AROUND_ENTITY, BULLET, CITATION = r"^[`.,;:()\[\]]+|[`.,;:()\[\]]+$", r"^\s*(?:[-*•]|[0-9]+[.)])\s*", r"\[([0-9]+(?:\s*,\s*[0-9]+)*)\]"


#: The white space characters of [\\s\\p{Z}].
SPACES = "\t\n\x0b\x0c\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space at either end: what [\\s\\p{Z}] takes, looked at from the ends only."""
    return F.trim(c, F.lit(SPACES))


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"[\s\p{Z}]+", " "))


def tokens(c: Column) -> Column:
    """Words of two or more letters, digits or underscores, lower-cased."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def judge_tokens(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9][a-z0-9\-_.]*"), F.lit(0)))


def title(text: Column, stem: Column) -> Column:
    """The first level-one heading, else the file's stem with - and _ as blanks."""
    head = strip(F.regexp_extract(text, r"(?m)^[ \t]*# (.*)$", 1))
    return F.when(head != "", head).otherwise(F.translate(stem, "-_", "  "))


def content_sha(text: Column) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 16)


def cache_key(model: Column, sha: Column, chunk_id: Column, text: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(c, F.lit("")) for c in (model, sha, chunk_id, text))), 256), 1, 20)


def embed_text(context: Column, text: Column) -> Column:
    return F.when(F.coalesce(context, F.lit("")) != "", strip(F.concat(context, F.lit("\n\n"), text))).otherwise(text)


def any_of(flags) -> Column:
    return reduce(lambda a, b: a | b, flags)


def looks_lexical(q: Column) -> Column:
    return any_of(q.rlike(p) for p in IDENTIFIERS.values())


def which_identifier(q: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, p in reversed(IDENTIFIERS.items()):
        out = F.when(q.rlike(p), F.lit(name)).otherwise(out)
    return out


def looks_like_refusal(answer: Column) -> Column:
    low = F.lower(answer)
    return any_of(F.contains(low, F.lit(m)) for m in REFUSAL_MARKERS)


def entities(text: Column, limit: int = 12) -> Column:
    """Typographically marked entities in pattern order, distinct without regard to case, the first `limit`."""
    every = F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(g)) for p, g in ENTITIES))
    clean = F.transform(every, lambda e: collapse(F.regexp_replace(strip(e), AROUND_ENTITY, "")))
    fine = first_plausible(clean, None)
    first = F.filter(fine, lambda e, i: F.array_position(F.transform(fine, F.lower), F.lower(e)) == i + 1)
    return F.slice(first, 1, limit)


def plausible(e: Column) -> Column:
    """Whether a phrase can be an entity: 3 to 60 characters, no stop word at either end, not one word twice."""
    w = F.split(F.lower(e), " ")
    first, last = F.element_at(w, 1), F.element_at(w, -1)
    return F.length(e).between(3, 60) & ~first.isin(*STOP_ENTITIES) & ~last.isin(*STOP_ENTITIES) & ~((F.size(w) == 2) & (first == last))


def first_plausible(phrases: Column, limit: int | None) -> Column:
    fine = F.filter(phrases, plausible)
    return fine if limit is None else F.slice(fine, 1, limit)


def clean_lines(raw: Column, limit: int = 4) -> Column:
    """Query variants from a model's reply: without bullets, numbers and quotes, not short, no headers."""
    lines = F.transform(F.split(raw, r"\r\n|\n|\r"), lambda x: strip(F.regexp_replace(strip(F.regexp_replace(strip(x), BULLET, "")), r'^"+|"+$', "")))
    return F.slice(F.filter(lines, lambda x: (F.length(x) >= 8) & ~x.endswith(":")), 1, limit)


def citations(answer: Column) -> Column:
    """Numbers in [1], [2][4] or [1, 3] marks, in order, distinct."""
    marks = F.regexp_extract_all(answer, F.lit(CITATION), F.lit(1))
    return F.array_distinct(F.transform(F.flatten(F.transform(marks, lambda m: F.split(m, r"\s*,\s*"))), lambda x: x.cast("int")))


def tolerant_object(raw: Column) -> Column:
    """The first JSON object in a reply: the whole string without code fences, else each {...} in turn; null if none parses."""
    plain = strip(F.regexp_replace(strip(raw), r"^`+(?:json)?|`+$", ""))
    tries = F.concat(F.array(plain), F.regexp_extract_all(raw, F.lit(r"(?s)\{.*?\}"), F.lit(0)))
    return F.get(F.filter(tries, lambda x: F.startswith(x, F.lit("{")) & F.try_parse_json(x).isNotNull()), F.lit(0))


def tolerant_json(raw: Column, field: str) -> Column:
    """A field of the reply's first JSON object, as a string."""
    return F.get_json_object(tolerant_object(raw), f"$.{field}")


def tolerant_list(raw: Column) -> Column:
    """The first [...] of a reply as an array of strings; null if it is none."""
    return F.from_json(F.nullif(F.regexp_extract(raw, r"(?s)\[.*?\]", 0), F.lit("")), "array<string>")


#: The English stop words of the lexical index.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with")


def unstopped(c: Column) -> Column:
    """tokens() without stop words."""
    return F.filter(tokens(c), lambda w: ~w.isin(*STOP_WORDS))


def common_prefix(a: Column, b: Column) -> Column:
    """The longest prefix that two strings share."""
    n = F.aggregate(F.sequence(F.lit(0), F.least(F.length(a), F.length(b))), F.lit(0), lambda m, i: F.when((m >= i - 1) & (F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i)), i).otherwise(m))
    return F.substring(a, F.lit(1), n)


def clamp(value: Column) -> Column:
    v = F.expr("1") * value.cast("double")
    return F.when(v.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))


def snap(text: Column, at: Column, forward: bool, reach: int = 200) -> Column:
    """Moves a cut to the first kind of break (blank line, sentence, line) within reach."""
    if forward:
        part = F.substring(text, at + 1, F.lit(reach))
        moves = [(F.locate(m, part) > 0, at + F.locate(m, part) - 1 + len(m)) for m in ("\n\n", ". ", "\n")]
    else:
        low = F.greatest(at - reach, F.lit(0))
        part = F.substring(text, low + 1, at - low)
        back = F.reverse(part)
        moves = [(F.locate(m[::-1], back) > 0, low + F.length(part) - F.locate(m[::-1], back) - len(m) + 1 + len(m)) for m in ("\n\n", ". ", "\n")]
    out = at
    for found, to in reversed(moves):
        out = F.when(found, to).otherwise(out)
    return F.when(at <= 0, F.lit(0)).when(at >= F.length(text), F.length(text)).otherwise(out)
