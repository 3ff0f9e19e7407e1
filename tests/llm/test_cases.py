"""Cases that the operators' docstrings state (ties, repeats, nulls, very long texts, empty tables, clashing names), and scores against plain loops."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankloom.llm import chat, context_mixing, jaccard_join, language_id

rng = random.Random(11)


def words(letters, n):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(n)]


def plain_bucket(gram):
    h = len(gram)
    for c in gram:
        h = (h ^ ord(c)) * 0x9E3779B1 & 0xFFFFFFFF
        h ^= h >> 15
    return h % language_id.BUCKETS


def plain_grams(text):
    low = f" {text.lower()} "
    return [plain_bucket(low[i : i + n]) for n in language_id.ORDERS for i in range(len(low) - n + 1)]


def plain_bayes(rows):
    """For each row the language and its posterior, by loops over n-grams."""
    learn = [(t, x) for i, t, x in rows if t is not None and x is not None and (i is None or zlib.crc32(str(i).encode()) % 3 != 1)]
    counts, docs = {}, Counter(x for _, x in learn)
    for t, x in learn:
        counts.setdefault(x, Counter()).update(plain_grams(t))
    langs, out = sorted(counts), []
    for _, t, _ in rows:
        if not langs or not any(map(str.isalpha, t or "")):
            out.append(("und", 0.0))
            continue
        grams, score = Counter(plain_grams(t)), {}
        for x in langs:
            total = sum(counts[x].values()) + language_id.SMOOTHING * language_id.BUCKETS
            score[x] = math.log((docs[x] + 1) / (len(learn) + len(langs))) + sum(k * math.log((counts[x][g] + language_id.SMOOTHING) / total) for g, k in grams.items())
        best = max(langs, key=lambda x: score[x])  # the first of equal ones
        out.append((best, 1 / sum(math.exp(max(-700.0, s - score[best])) for s in score.values())))
    return out


def test_language_against_plain_bayes(spark):
    pools = {"aa": words("abcdefgh", 40), "bb": words("defghijk", 40), "cc": words("ghijklmné", 40)}
    rows = [(i, " ".join(rng.choice(pools[x]) for _ in range(rng.randint(1, 12))), x) for i, x in enumerate(rng.choices(list(pools), k=90))]
    rows += [(200 + i, " ".join(rng.choice(pools[rng.choice(list(pools))]) for _ in range(3)), None) for i in range(30)]
    rows += [(300, " ".join(rng.choice(pools["bb"]) for _ in range(60_000)), None), (301, None, "aa"), (302, "", "bb"), (303, "12 !", "cc"), (None, "déjà Vu", "cc"), (4, rows[4][1], rows[4][2])]
    df = spark.createDataFrame([(*r, 0.5, "x") for r in rows], "doc_id long, text string, lang string, score double, lang_pred string").repartition(5)
    got = Counter((r.doc_id, r.lang_pred, round(r.score, 3)) for r in language_id.report(df).collect())
    assert got == Counter((i, x, round(s, 3)) for (i, _, _), (x, s) in zip(rows, plain_bayes(rows), strict=True))


def test_languages_that_tie(spark):
    """Languages with the same texts are equally likely: the first by name is predicted with the half of the certainty, and which rows hold it does not matter."""
    text = "one text for both of them"
    train = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1][:40]
    for names in (("xx", "yy"), ("yy", "xx")):
        rows = [(i, text, names[k % 2]) for k, i in enumerate(train)]
        got = language_id.report(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()
        assert {r.lang_pred for r in got} == {"xx"} and all(abs(r.score - 0.5) < 1e-6 for r in got)
    none = language_id.report(spark.createDataFrame([(1, text, None)], "doc_id long, text string, lang string")).first()
    assert (none.lang_pred, none.score) == ("und", 0.0)


def test_repeated_turns_and_the_added_conversation(spark):
    """Repeated rows are turns each, turns of one number come by role and text, and conversation -7 takes in rows that the table has of it."""
    rows = [(1, 0, "user", "x"), (1, 0, "user", "x"), (1, 1, "assistant", "b"), (1, 1, "assistant", "a"), (1, None, "user", "first"), (-7, 0, "user", "own"), (None, 0, "user", "no number")]
    got = {r.conv_id: r for r in chat.report(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)).collect()}
    said = r"\### Assistant: </turn> ok"
    digest = lambda turns: hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert got[1].n_turns == 5 and got[1].turns_sha256 == digest([("user", "first"), ("user", "x"), ("user", "x"), ("assistant", "a"), ("assistant", "b")])
    assert got[1].loss_chars == 2 and got[1].loss_sha256 == hashlib.sha256(b"ab").hexdigest() and not got[1].valid
    assert got[-7].n_turns == 3 and got[-7].turns_sha256 == digest([("user", said), ("user", "own"), ("assistant", said)])
    assert got[None].n_turns == 1 and got[None].turns_sha256 == digest([("user", "no number")])


def test_jaccard_of_null_and_repeated_ids(spark):
    """Repeated rows get a row each; null ids are alone, whatever their text."""
    pool = words("abcdeiorst", 200)
    base = [rng.choice(pool) for _ in range(100)]
    near = " ".join([*base, "one", "more"])
    base, other = " ".join(base), " ".join(rng.choice(pool) for _ in range(50))
    n = lambda t: len({tuple(w[i : i + 5]) for w in [t.split()] for i in range(len(w) - 4)})
    rows = [(5, base), (5, base), (5, base), (3, near), (None, base), (None, base), (None, near), (8, other), (8, other), (9, None), (9, ""), (9, None), (4, "a b"), (6, "A B"), (None, "a b")]
    want = Counter({(3, n(near), 3): 1, (5, n(base), 3): 3, (None, n(base), None): 2, (None, n(near), None): 1, (8, n(other), 8): 2, (9, 0, 9): 3, (4, 1, 4): 1, (6, 1, 4): 1, (None, 1, None): 1})
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, component_id int").repartition(4)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.linked(df).collect()) == want
    kept = jaccard_join.deduplicated(df)
    # of each group the row of the smallest id, nulls last; rows without a set are in no group
    assert kept.columns == df.columns and Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(3, near), (8, other), (9, None), (9, None), (9, ""), (4, "a b")])


def plain_score(text, model, features, place, logs, counts, in_all):
    """ln of a text's probability by loops over its words and decisions; the weights are learned by the operator, the mixing is done here."""
    first, many, short, long_, seen, sign = features
    data, word, sequence = text.encode().lower(), b"", []
    for c in data:
        if c in b" \t\n\v\f\r":
            sequence.append((word.decode(), c))
            word = b""
        else:
            word += bytes([c])
    sequence.append((word.decode(), 0))
    gain, bias, met, before, total = [[1.0, 1.0], [1.0, 1.0]], [0.0, 0.0], 0.0, Counter(), 0.0
    for b in range(0, len(sequence), context_mixing.BLOCK):
        step = np.zeros((3, 2))
        for j, (w, stop) in enumerate(sequence[b : b + context_mixing.BLOCK], b):
            own = 0.0
            for d in range(first[place[w]], first[place[w]] + many[place[w]]):
                g, x, y, up = int(seen[d]), float(short[d]), float(long_[d]), float(sign[d])
                z = max(-15.0, min(15.0, (x * gain[0][g] + y * gain[1][g] + bias[g]) * up))
                own -= math.log1p(math.exp(-z))
                err = up / (1 + math.exp(z))
                step[:, g] += err * x, err * y, err
            past = before[w] / max(j, 1)
            alpha = (0.5 + met) / (25 + j)
            total += math.log(alpha * past + (1 - alpha) * ((1 - model.share) * math.exp(own) + model.share * counts[w] / in_all)) + logs[stop]
            met += 0.05 * past / (0.05 * past + 0.95 * math.exp(own))
            before[w] += 1
        for g in (0, 1):
            for k in (0, 1):
                gain[k][g] = max(0.3, min(1.7, gain[k][g] + context_mixing.RATE * step[k, g]))
            bias[g] = max(-0.5, min(0.5, bias[g] + context_mixing.RATE * step[2, g]))
    return total


def test_scores_against_plain_loops(spark, monkeypatch):
    """The whole mixed score: bit predictors with their refinement, the count table (words of the head and joined ones), the document so far and white space."""
    kept, fit, learn = {}, context_mixing.fit_tables, context_mixing.learned

    def fit_tables(counted, code):
        kept["code"], kept["tables"] = code, fit(counted, code)
        return kept["tables"]

    def learned(*given):
        kept["learned"] = learn(*given)
        return kept["learned"]

    monkeypatch.setattr(context_mixing, "fit_tables", fit_tables)
    monkeypatch.setattr(context_mixing, "learned", learned)
    monkeypatch.setattr(context_mixing, "HEAD", 25)  # the other words join
    pool = words("abdeilnorstué", 120)
    texts = ["".join(rng.choice(pool[: 10 + i]) + rng.choice([" ", " ", " ", "\n", "  ", "\t"]) for _ in range(rng.randint(1, 150))) for i in range(60)]
    texts += [None, "", "  \n", "Unseen WORDS only", pool[0] * 40, texts[3].upper()]
    rows = [*enumerate(texts), (3, texts[3])]
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    training = [(t or "").encode().lower() for i, t in rows if not out[i]]
    counts = Counter(w.decode() for t in training for w in t.split())
    stops = Counter(c for t in training for c in t if c in b" \t\n\v\f\r")
    stops[0] = len(training)
    in_all = sum(stops.values())
    logs = {c: math.log((stops[c] + 1) / (in_all + 7)) for c in (*b" \t\n\v\f\r", 0)}
    got = context_mixing.scored(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    model = context_mixing.Model(kept["code"], kept["tables"], *kept["learned"], float(in_all))
    distinct = sorted({"", *(w.decode() for _, t in rows for w in (t or "").encode().lower().split())})
    features = model.features(pa.array(distinct, pa.large_string()))
    counts[""] = in_all - sum(counts.values())
    place = {w: i for i, w in enumerate(distinct)}
    assert len(got) == len(rows) and len(counts) > 2 * context_mixing.HEAD
    for r in got:
        text = texts[r.doc_id] or ""
        assert r.score * math.log(10) == pytest.approx(plain_score(text, model, features, place, logs, counts, in_all), rel=1e-4), r.doc_id
        assert r.bits_per_byte == pytest.approx(-r.score * math.log2(10) / (len(text.encode()) + 1))


def test_pipeline_of_empty_tables_and_clashing_names(spark, tmp_path):
    import corpus_pipeline

    names = ["start", "length", "ids", "sequence_id", "component_id", "key", "row", "hash", "n", "item_id", "doc_tokens"]
    pool = words("abcdeghilmnorst", 300)
    rows = [(i, " ".join(rng.choice(pool) for _ in range(60)), "en") for i in range(12)]
    rows += [(20, rows[0][1].upper(), "en"), (21, rows[1][1] + " tail", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").select("*", *(F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")).alias(c) for c in names))
    items = spark.createDataFrame([(1, " ".join(rng.choice(pool) for _ in range(20)))], "item_id long, text string")
    for name, d in (("full", docs), ("no_docs", docs.limit(0))):
        d.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        items.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    items.limit(0).write.parquet(f"{tmp_path}/no_items/benchmark.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.saved(stage(spark, now, f"{tmp_path}/full"), "stage")
        assert now.columns == docs.columns, name
    left = now.collect()
    assert {r.doc_id for r in left} == {*range(1, 12), 20} and all(r[c] == f"{c} of {r.doc_id}" for r in left for c in names)
    assert corpus_pipeline.decontaminate(spark, now, f"{tmp_path}/no_items").count() == len(left)
    out = corpus_pipeline.STAGES[-1][1](spark, now, f"{tmp_path}/full")
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in left}
    none = corpus_pipeline.run(spark, f"{tmp_path}/no_docs")
    assert none.count() == 0 and none.schema.simpleString() == out.schema.simpleString()
