"""Quality, golden records and vector codes against brute force and held-out labels, on small tables with nulls, ties, repeats and extremes."""

import datetime as dt
import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import golden_records, quality, vector_codes

GOOD_WORDS = "the of and stone river garden table window morning light paper house winter mountain bridge letter".split()


def sentence(rng, n):
    return " ".join(rng.choice(GOOD_WORDS) for _ in range(n)).capitalize() + "."


def junk(rng, n):
    return " ".join(rng.choice(GOOD_WORDS).upper() + rng.choice(["!!", "$$$", "***"]) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(240):
        good = i % 4 != 0
        rows.append((i, (sentence if good else junk)(rng, rng.randint(5, 200)), 5))
        labels.append((i, int(good), 9))
    rows += [(1000, "", 0), (1001, None, 0), (1002, sentence(rng, 200_000), 0), (1003, "x", 0), (7, rows[7][1], 5), (None, rows[4][1], 5)]
    labels += [(5000, 1, 0), (None, 0, 0), (9, None, 0), (11, 1, 0), (12, 1, 1)]  # unknown, null, repeated, contradicting
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int").repartition(3)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, score int"), rows, labels


def test_quality_of_held_out(labelled):
    docs, labels, rows, known = labelled
    got = quality.report(docs, labels).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i, *_ in rows)
    truth = {i: q for i, q, _ in known if i is not None and i < 240 and q is not None}
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    asked = [r for r in held if r.doc_id in truth]
    assert len(asked) > 30 and sum(r.predicted == truth[r.doc_id] for r in asked) >= 0.95 * len(asked)
    by = {r.doc_id: r.score for r in got}
    assert by[1000] == by[1001] and by[1002] > 0.7 and by[None] == by[4]


def test_quality_against_brute_force(labelled):
    """Learned from the same rows one by one, with plain loops for sample, sizes and curve."""
    docs, labels, rows, known = labelled
    text = {i: t or "" for i, t, _ in rows}
    value = {}
    for i, q, _ in known:
        if i is not None and i in text and q is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            value.setdefault(i, set()).add(q)
    halves = {r.doc_id: r.half for r in quality.sample(docs, labels, ~quality.held_out(F.col("doc_id"))).collect()}
    learn = {i: q.pop() for i, q in value.items() if len(q) == 1}
    assert set(halves) == set(learn) and set(halves.values()) == {0, 1}
    model = quality.fitted([(learn[i], halves[i], quality.cut(text[i].encode(), 8)) for i in sorted(learn)])
    sizes = quality.Sizes(model[0])
    for r in quality.scored(docs, labels).filter("doc_id % 10 = 1").collect():
        t = text[r.doc_id].encode()
        bad, good = (sum(len(c.compress(t[k : k + 1024])) for k in range(0, len(t), 1024)) for c in sizes.by)
        z = model[1][0] * ((bad - good) / len(t) if t else 0) + model[1][1] * 64 / (64 + len(t)) + model[1][2]
        assert r.score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)


def test_quality_without_classes(labelled):
    docs, labels, *_ = labelled
    few = docs.filter("doc_id in (1, 2, 1001)")
    assert {r.score for r in quality.report(few, labels.limit(0)).collect()} == {0.5}
    one = quality.report(few, labels.filter("quality = 1")).collect()
    assert len({r.score for r in one}) == 1 and 0.5 < one[0].score < 1
    assert quality.report(docs.limit(0), labels).count() == 0


def test_curve_orders_and_calibrates():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 2))
    p = 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1] + 1)))
    w = quality.curve(x, (rng.random(4000) < p).astype(float), ridge=0)
    assert np.abs(w - [2, -1, 1]).max() < 0.2
    assert np.isfinite(quality.curve(np.array([[0.0, 1], [1, 1]]), np.array([0.0, 1]))).all()  # classes that do not overlap


# golden records

DAY = dt.timedelta(days=1)
START = dt.datetime(2024, 3, 1)


def brute_record(rows):
    """One record by sorting all rows of a cluster by each rule."""
    blank = lambda s: None if s is None or not s.strip(" \t\n\v\f\r") else s
    trust = {"store": 0, "crm": 1, "partner": 2, "web": 3}
    rows = [{**r, **{c: blank(r[c]) for c in ("name", "email", "city", "segment")}, "t": trust.get(r["source"], 4)} for r in rows]
    latest = max((r["updated_at"] for r in rows if r["updated_at"]), default=None)
    micro = lambda d: (d - START) // dt.timedelta(microseconds=1)
    null_last = lambda v: (v is None, v if v is not None else 0)
    for r in rows:
        r["stale"] = r["updated_at"] is None or latest - r["updated_at"] > 10 * DAY
        at = r["updated_at"]
        r["recent"] = (at is None, -micro(at) if at else 0, r["t"], null_last(r["client_id"]), *((r[c] is None, r[c] or "") for c in ("name", "email", "segment", "city")), null_last(r["nation_id"]), null_last(r["balance"]))
        r["trusted"] = (r["stale"], r["t"], r["recent"])
    for r in rows:
        r["balance"] = None if r["balance"] is not None and not np.isfinite(r["balance"]) else r["balance"]
    first = lambda key, c: min((r for r in rows if r[c] is not None), key=key, default=None)
    segment = first(lambda r: r["recent"], "segment")
    chosen = segment and segment["segment"]
    name, email = first(lambda r: (-len(r["name"]), r["trusted"]), "name"), first(lambda r: r["trusted"], "email")
    balance = first(lambda r: (r["segment"] != chosen, r["recent"]), "balance")
    place = min(rows, key=lambda r: (-((r["city"] is not None) + (r["nation_id"] is not None)), r["recent"]))
    some = place["city"] is not None or place["nation_id"] is not None
    of = lambda r, c: r and r[c]
    return (len(rows), sum(r["stale"] for r in rows), of(name, "name"), of(email, "email"), chosen, place["city"], place["nation_id"], balance and int(np.floor(100 * balance["balance"] + 0.5)), of(name, "client_id"), of(email, "client_id"), of(segment, "client_id"), of(balance, "client_id"), place["client_id"] if some else None)


CLIENT = "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double, at string, n int"


def client_rows(n, hot, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        master = rng.choice([None, 3]) if rng.random() < hot else rng.choice([None, rng.randrange(40), 77])
        at = None if rng.random() < 0.1 else START + rng.choice([rng.randrange(30) * DAY, rng.randrange(3) * 10 * DAY, dt.timedelta(microseconds=rng.randrange(20 * 86400 * 10**6))])
        text = lambda *v: rng.choice([None, "", " \t", *v])
        out.append((None if rng.random() < 0.02 else i // 2 if rng.random() < 0.1 else i, master, rng.choice(["store", "crm", "partner", "web", "other", None, " "]), at, text("Ann", "Bo ", "\u00e9\u00e9\u00e9", "\U0001f600\U0001f600"), text("a@x", "b@x"), text("Rom", "Ulm"), rng.choice([None, 1, 2]), text("retail", "public", "export"), rng.choice([None, -1.005, 0.125, 12.0, 99.995]), "clash", 1))
    return out + out[:5]


def same_records(spark, rows, parts):
    got = {r.cluster_id: tuple(r)[1:] for r in golden_records.golden(spark.createDataFrame(rows, CLIENT).repartition(parts)).collect()}
    names = [f.split()[0] for f in CLIENT.split(", ")]
    clusters = {}
    for r in rows:
        r = dict(zip(names, r, strict=True))
        clusters.setdefault(r["master_id"] if r["master_id"] is not None else r["client_id"], []).append(r)
    assert set(got) == set(clusters)
    for k, members in clusters.items():
        assert got[k] == brute_record(members), k


def test_golden_records(spark):
    same_records(spark, client_rows(400, 0, 1), 5)
    assert golden_records.golden(spark.createDataFrame([], CLIENT)).count() == 0
    same_records(spark, [(1, None, "crm", None, None, None, None, None, None, None, None, None), (None, None, None, None, " ", "", "", None, "", float("nan"), None, None)], 1)


def test_golden_records_of_a_hot_cluster(spark, monkeypatch):
    """A cluster in every task, above HOT: survivors go through the tree, times through their own counts. Tasks prune often, too."""
    monkeypatch.setattr(golden_records, "HOT", 60)
    monkeypatch.setattr(golden_records, "FAN", 3)
    same_records(spark, client_rows(1500, 0.5, 2), 20)


def test_pruning_keeps_few(spark):
    """What a task sends of a cluster is bounded by its slots, however many rows it holds."""
    rows = client_rows(6000, 1, 3)
    df = spark.createDataFrame(rows, CLIENT).filter("master_id = 3").coalesce(1)
    sent = golden_records.prepared(df).mapInArrow(golden_records._survivors, golden_records.SURVIVOR)
    assert df.count() > 2500 and sent.count() <= 3 + 5 + 5 + 4
    assert sent.agg(F.sum("n")).first()[0] == df.count()


# vector codes


def brute_codes(rows):
    kept = [(i, [int(np.floor(4096 * x)) for x in v], g) for i, v, g in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(kept[0][1]) // 8
    part = lambda v, p: v[p * size : (p + 1) * size]
    books = [[part(v, p) for _, v, _ in kept[:16]] for p in range(8)]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(6):
        for p in range(8):
            of = {}
            for _, v, _ in kept:
                of.setdefault(nearest(part(v, p), books[p])[1], []).append(part(v, p))
            for k, members in of.items():
                books[p][k] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    found = [(i, g, [nearest(part(v, p), books[p]) for p in range(8)]) for i, v, g in kept]
    total = {}
    for _, g, f in found:
        total[g] = total.get(g, 0) + sum(d for d, _ in f)
    return sorted((i is None, i or 0, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), total[g], digest) for i, g, f in found)


def flat(df):
    return sorted((r.vec_id is None, r.vec_id or 0, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


@pytest.mark.parametrize(("n", "size"), [(150, 64), (9, 16), (40, 8), (60, 24)])
def test_vector_codes(spark, n, size):
    rng = np.random.default_rng(n)
    rows = [(i, rng.normal(size=size).astype(np.float32).tolist(), int(rng.integers(3)) if i % 5 else None) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [None] + [0.0] * (size - 1), 1), (n + 2, [float("nan")] * size, 1), (n + 3, [float("inf")] * size, 1), rows[4], (None, rows[3][1], 1), (n + 4, [0.5] * size, 1), (n + 5, [0.5] * size, 1)]
    df = spark.createDataFrame([(*r, "clash", 0) for r in rows], "vec_id long, embedding array<float>, label int, code string, error int").repartition(3)
    assert flat(vector_codes.coded(df)) == brute_codes(rows)


def test_vectors_that_cannot_be_coded(spark):
    shape = "vec_id long, embedding array<double>, label int"
    good = [(i, [float(i)] * 8, 0) for i in range(3)]
    got = {r.vec_id: r for r in vector_codes.coded(spark.createDataFrame([*good, (8, [1.0] * 16, 1), (9, [1e300] * 8, 0), (10, [], 0)], shape)).collect()}
    assert [got[i].error for i in range(3)] == [0, 0, 0] and all(got[i].code is None and got[i].error is None for i in (8, 9, 10)) and got[8].label_error is None
    assert [r.code for r in vector_codes.coded(spark.createDataFrame([(1, [1.0] * 7, 0)], shape)).collect()] == [None]
    assert vector_codes.coded(spark.createDataFrame([], shape)).count() == 0
    many = vector_codes.with_totals(spark.createDataFrame(good, shape).withColumn("error", F.lit(2)), "label", "error", "out")
    assert {r.out for r in many.collect()} == {6}


def test_sums_of_many_labels(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "LABELS", 2)
    rows = [(i, i % 7 or None, i) for i in range(200)]
    got = {r.vec_id: r.out for r in vector_codes.with_totals(spark.createDataFrame(rows, "vec_id long, label int, error long"), "label", "error", "out").collect()}
    assert got == {i: sum(e for _, g, e in rows if g == label) for i, label, _ in rows}


def test_bounds_reject_and_never_lose():
    """Most pairs go by the bounds alone where entries lie apart, and the nearest is that of all pairs, also for equal means, equal residuals and large values."""
    rng = np.random.default_rng(5)
    centres = rng.integers(-4000, 4000, (8, 16, 8))
    near = centres[np.arange(8), rng.integers(16, size=(500, 8))] + rng.integers(-200, 200, (500, 8, 8))
    constant = np.repeat(rng.integers(-(1 << 25), 1 << 25, (200, 8, 1)), 8, axis=2) + rng.integers(-1, 2, (200, 8, 8))
    for x, entries in ((near, centres), (constant, constant[:16].transpose(1, 0, 2)), (rng.integers(-9, 9, (300, 8, 8)), rng.integers(-9, 9, (8, 16, 8)))):
        seen = {}
        code, error = vector_codes.Codebooks(entries).assigned(x, seen)
        d = ((x[:, :, None, :] - entries[None]) ** 2).sum(3)
        assert (code == d.argmin(2)).all() and (error == d.min(2)).all()
        assert seen["pairs"] == x.shape[0] * 8 * 16
        if x is near:
            assert seen["exact"] < 0.25 * seen["pairs"]


def test_every_order_of_rows_gives_one_record():
    import pandas as pd

    rows = [dict(cluster_id=1, client_id=i, at=5, trust=t, name=n, email=None, segment=s, city=None, nation_id=None, cents=c, n=1, stale=0, part=0, times=None) for i, t, n, s, c in ((1, 0, "x", "a", 5), (1, 0, "y", None, 6), (2, 1, "zz", "b", None))]
    found = set()
    for p in itertools.permutations(rows):
        r = golden_records.Ordered(pd.DataFrame(list(p)).astype({"nation_id": "Int64", "cents": "Int64", "client_id": "Int64"})).records().iloc[0]
        found.add((r["name"], r["segment"], r["balance_cents"], r["n_records"]))
    assert found == {("zz", "a", 5, 3)}


def test_stages_keep_columns_of_any_name(spark):
    """Columns that are named like a stage's own come back as they were; on empty tables, too."""
    from rankloom.llm import exact_dedup, jaccard_join, language_id

    rng = random.Random(9)
    long_ = sentence(rng, 80)
    names = ["_h", "_n", "_sha", "_id", "_row", "h", "n", "sha", "id", "row", "number", "norm", "keep_id", "lang"]
    rows = [(1, long_), (1, long_), (2, long_ + " tail"), (None, long_), (3, sentence(rng, 60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", *(F.concat(F.lit(f"{c} of "), F.length("text").cast("string")).alias(c) for c in names))
    for stage, n in ((exact_dedup.deduplicated, 3), (jaccard_join.deduplicated, 2), (language_id.identified, None)):
        got = stage(docs).collect()
        assert n is None or len(got) == n
        assert all(r[c] == f"{c} of {len(r.text)}" for r in got for c in names)
        none = stage(docs.limit(0))
        assert none.columns == docs.columns and none.count() == 0


def test_one_long_word(spark):
    """A word of very many bytes is scored and counted, and never reaches the driver."""
    from rankloom.llm import context_mixing

    long_ = "x" * 300_000
    docs = spark.createDataFrame([(1, "a b a"), (2, f"a {long_}"), (3, long_), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in context_mixing.scored(docs, F.lit(False)).collect()}
    total, kinds = 4 + 3 + 2 + 1, 4
    log = lambda *c: sum(np.log10((x + 1) / (total + kinds + 1)) for x in c)
    assert got[3].n_known == 2 and got[3].base_score == pytest.approx(log(2, 4)) and got[2].base_score == pytest.approx(log(3, 2, 4)) and got[4].n_tokens == 1
    assert all(np.isfinite(r.score) and r.score < 0 for r in got.values())


def test_weights_are_learned_from_all_words(spark, monkeypatch):
    """The predictors' weights and the count table's share are those of all training words, long ones too, wherever the Newton steps begin; plain loops over whole words, which share no beginnings, say so."""
    from collections import Counter

    import pyarrow as pa

    from rankloom.llm import context_mixing

    pick = random.Random(14)
    parts = ["".join(pick.choice("aeiounrstlé") for _ in range(pick.randint(1, 3))) for _ in range(60)]
    pool = ["".join(pick.choice(parts) for _ in range(pick.randint(1, 6))) for _ in range(15_000)] + ["far" * 30]
    pool += [x + "," for x in pool[:3000]]
    texts = [" ".join(pool[int(len(pool) * pick.random() ** 2)] for _ in range(200)) + " " + pool[15_000] for _ in range(150)]
    made, init = [], context_mixing.Model.__init__

    def kept(self, *given):
        init(self, *given)
        made.append((self, given[-1]))

    monkeypatch.setattr(context_mixing.Model, "__init__", kept)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    context_mixing.scored(docs, F.lit(False)).count()
    model, in_all = made[-1]
    counts = Counter(w for t in texts for w in t.split())
    words = pick.sample(sorted(counts), len(counts))
    assert len(words) > 9000 and in_all == sum(counts.values())
    times = np.array([counts[w] for w in words], float)
    n, slots, bit = context_mixing.decisions(model.code, pa.array(words, pa.large_string()))
    left, gate = context_mixing.without_one(), context_mixing.class_of()
    value = ((np.arange(1 << 16) & 255) - 128.0) / context_mixing.SCALE * (np.arange(1 << 16) > 255)
    x = np.zeros((len(bit), model.weights.size))
    for k, (t, s) in enumerate(zip(model.tables, slots, strict=True)):
        c = left[bit, t[s]]
        x[np.arange(len(bit)), k * len(context_mixing.CLASSES) + gate[c]] = value[c]
    weight, sign = np.repeat(times / times.sum(), n), bit * 2.0 - 1
    lost = lambda w: np.logaddexp(0, -sign * (x @ w))
    w = np.full(x.shape[1], 1 / len(context_mixing.ORDERS))
    for _ in range(12):
        p = 1 / (1 + np.exp(-(x @ w)))
        w = w - np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-7 * np.eye(len(w)), x.T @ (weight * (p - bit)))
    best = weight @ lost(w)
    assert abs(weight @ lost(model.weights.ravel()) - best) < 5e-4  # nats a word, of dozens
    own, share = np.exp(-np.add.reduceat(lost(model.weights.ravel()), np.cumsum(n) - n)), 0.5
    for _ in range(30):
        a = share * (times - 1) / in_all
        share = np.clip((times * a / (a + (1 - share) * own)).sum() / times.sum(), 0.02, 0.98)
    assert model.share == pytest.approx(share, abs=1e-5)
    counted = spark.createDataFrame(list(counts.items()), "token string, n long").repartition(4)
    tables = np.concatenate(model.tables)
    for begin in (0.2, 0.6):  # from the second the first whole steps go too far
        monkeypatch.setattr(context_mixing, "FIRST", np.full(model.weights.shape, begin))
        again, _ = context_mixing.learned(counted, model.code, tables, in_all)
        assert abs(weight @ lost(again.ravel()) - best) < 5e-4, begin


def test_beginnings_are_met_once():
    """Bytes of beginnings that neighbours share are laid out once in sorted words; in any order each word's bytes are found again."""
    import pyarrow as pa

    from rankloom.llm import context_mixing

    pick = random.Random(15)
    words = sorted({"".join(pick.choice("abé") for _ in range(pick.randint(1, 7))) for _ in range(300)})
    long_ = [*words[:9], "a" * 70_000, "a" * 70_001 + "b"]
    for given in (words, pick.sample(words, len(words)), long_, words[:1], []):
        whole = pa.array(["before", *given], pa.large_string())
        data, at, branch, size = context_mixing.branches(whole.slice(1))
        assert bytes(data[at[branch]]) == "".join(w + " " for w in given).encode() and len(size) == len(given)
        if given is words:
            assert len(at) == len({w[:i] for w in ((x + " ").encode() for x in given) for i in range(1, len(w) + 1)})
        if given is long_:
            assert len(at) < 70_100
