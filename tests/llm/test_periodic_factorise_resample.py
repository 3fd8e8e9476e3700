"""Periodic runs, the factorisation machine and importance resampling against brute force."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from aisleframe.llm import factorise, periodic, queries, resample

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, score double, rank int, n_words int"
SPACE = re.compile("[\x20\x09-\x0d]+")
ODD = [
    (1001, None),
    (1002, ""),
    (1003, " \n\t\n "),
    (None, "no id here. " * 30),
    (None, "no id here. " * 30),
    (1004, "Ünï cödé 日本 " * 40),
    (1005, "a " * 9_000),
    (1005, "a " * 9_000),
    (1006, "word"),
    (1007, "A b c d e\x1cf " * 12),
    (1008, " ".join(str(k) for k in range(30_000))),
    (1009, "x" * 60_000),
]


def words(t):
    return [w for w in SPACE.split(t or "") if w]


@pytest.fixture(scope="module")
def rows(spark, sf):
    real = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(70).collect()
    return [(r.doc_id, r.text) for r in real] + ODD


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "z", 1.0, 1, 1) for i, t in rows], SCHEMA)


# Periodic runs


def brute_runs(w, min_words, min_repeats):
    """Every stretch for every period, kept if no smaller period fits it."""
    out = []
    for q in range(1, len(w)):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(min_words, min_repeats * q):
                s = w[i : i + length]
                if not any(all(s[k] == s[k + p] for k in range(length - p)) for p in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out)


@pytest.mark.parametrize(("min_words", "min_repeats"), [(24, 3), (6, 2), (4, 3), (10, 4), (1, 2)])
def test_runs_equal_brute_force(min_words, min_repeats):
    rng = random.Random(min_words)
    seen = 0
    for _ in range(250):
        n, kinds = rng.randint(0, 150), rng.choice([1, 2, 3, 5, 50])
        w = [rng.randint(0, kinds) for _ in range(n)]
        for _ in range(rng.randint(0, 3)):
            a, p = rng.randrange(n or 1), rng.randint(1, 20)
            for i in range(a, min(n, a + rng.randint(5, 150))):
                w[i] = w[a + (i - a) % p]
        want = brute_runs(w, min_words, min_repeats)
        assert periodic.find_runs(w, min_words, min_repeats) == want
        seen += len(want)
    assert seen > 50


def test_positions_keep_order_over_many_blocks(monkeypatch):
    monkeypatch.setattr(periodic, "BLOCK", 4)
    rng = random.Random(1)
    order = rng.sample(range(500), 500)
    held = periodic.Positions(order[0])
    for k, p in enumerate(order[1:], 2):
        held.add(p)
        now = sorted(order[:k])
        at = now.index(p)
        assert held.around(p) == (now[at - 1] if at else -1, now[at + 1] if at + 1 < k else -1)
    assert list(held) == sorted(order) and len(held.blocks) > 50


def test_equal_hashes_of_windows_change_nothing(monkeypatch):
    w = [1, 2, 3] * 20 + list(range(100, 160)) + [7] * 30
    want = brute_runs(w, 24, 3)
    monkeypatch.setattr(periodic, "_repeated", lambda codes, width: np.ones(len(codes), bool))
    assert periodic.find_runs(w) == want and len(want) == 2


def planted(i, w):
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    g = h // 10
    if h % 10 or not w:
        return w
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]


def run_row(i, w):
    found = periodic.find_runs(w) if len(w) > 700 else brute_runs(w, 24, 3)
    best = min(found, key=lambda r: (-(r[1] / r[2]), r[0], r[2]), default=None)
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    kept = " ".join(x for k, x in enumerate(w) if k not in gone)
    listing = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    digests = [hashlib.sha256(x.encode()).hexdigest() for x in (listing, kept)]
    return (i, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *digests)


def test_periodic_query(spark, docs, rows, tmp_path, monkeypatch):
    extra = [(k, "one two three four five six seven eight nine ten " * (3 + k % 9)) for k in range(2000, 2100)]
    table = docs.unionByName(spark.createDataFrame([(i, t, "", "", 0, "", 0.0, 0, 0) for i, t in extra], SCHEMA))
    table.write.parquet(f"{tmp_path}/documents.parquet")
    got = collections.Counter(tuple(r) for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect())
    want = collections.Counter(run_row(i, planted(i, words(t))) for i, t in [*rows, *extra])
    assert got == want
    assert sum(n for r, n in got.items() if r[1]) > 80


def test_periodic_details(docs):
    out = {r.doc_id: r for r in periodic.periodic_runs(docs, details=True).collect()}
    assert [tuple(r) for r in out[1005].runs] == [(0, 9000, 1)] and out[1005].collapsed_text == "a"
    assert out[1004].collapsed_text == "Ünï cödé 日本" and out[1001].runs == [] and out[1001].collapsed_text == ""
    assert out[1007].n_runs == 1 and out[1007].period == 3  # no-break and other spaces are inside words
    assert periodic.periodic_runs(docs.limit(0)).count() == 0


# Quality by a factorisation machine


def test_score_equals_the_sum_over_pairs():
    rng = np.random.default_rng(3)
    m = factorise.Machine(0.3, rng.normal(size=40).astype(np.float32), rng.normal(size=(40, 5)).astype(np.float32))
    places, values = rng.choice(40, 12, replace=False), rng.normal(size=12).astype(np.float32)
    want = 0.3 + sum(m.weight[p] * v for p, v in zip(places, values))
    for a, b in itertools.combinations(range(12), 2):
        want += float(m.vector[places[a]] @ m.vector[places[b]]) * values[a] * values[b]
    assert m.margin(places, values) == pytest.approx(want, abs=1e-4)


def test_pairs_are_learnt():
    """Labels that no sum of weights can tell apart: two inputs agree or not."""
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(600):
        a, b = rng.integers(2), rng.integers(2)
        rows.append((float(a == b), np.array([a, 2 + b, 4 + rng.integers(6)]), np.ones(3, np.float32)))
    m = factorise.Machine.new(10, 4, 1)
    m.learn(rows, passes=20, step=0.1, decay=0.0, seed=2)
    assert np.mean([(m.margin(p, v) > 0) == y for y, p, v in rows]) > 0.97


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op11_quality_fm(spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 for i, r in got.items())
    assert all(r.predicted == int(r.score >= 0.3) for r in got.values())
    held = [(got[r.doc_id], r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r.doc_id].held_out]
    good, bad = [g.score for g, y in held if y == 1], [g.score for g, y in held if y == 0]
    assert np.mean([g.predicted == y for g, y in held]) > 0.95
    assert np.mean([a > b for a in good for b in bad]) > 0.98


def test_labels_of_the_held_out_fold_are_not_read(spark, docs):
    ids = [r.doc_id for r in docs.select("doc_id").distinct().collect() if r.doc_id is not None]
    held = {i for i in ids if zlib.crc32(str(i).encode()) % 5 == 0}
    schema = "doc_id long, quality int, text string"

    def scores(flip):
        labels = [(i, int(i % 3 > 0) ^ (flip and i in held), "t") for i in ids] + [(None, 1, ""), (5, None, "")]
        m = factorise.fit(docs, spark.createDataFrame(labels, schema), buckets=256)
        return sorted((r.score, r.held_out) for r in factorise.score(docs, m).collect())

    one = scores(False)
    assert held and one == scores(True) and len(one) == docs.count()
    assert len({s for s, _ in one}) > 10


def test_quality_of_awkward_tables(spark, docs):
    empty = spark.createDataFrame([], "doc_id long, quality int")
    m = factorise.fit(docs, empty)
    assert {r.score for r in factorise.score(docs, m).collect()} == {0.5}
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, 0), (4, 1)], "doc_id long, quality int")
    m = factorise.fit(docs, labels, buckets=64)
    out = factorise.score(docs, m)
    assert out.count() == docs.count() and out.filter("doc_id IS NULL AND NOT held_out").count() == 2
    assert factorise.score(docs.limit(0), m).count() == 0 == factorise.score(docs.drop("n_chars").limit(0), m).count()
    assert factorise.fit(docs.limit(0), labels, buckets=64).bias == 0.0


# Importance resampling


def brute_resample(rows, target, percent=25, buckets=10_000, min_words=20):
    split = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

    def parts(t):
        w = split.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        return len(w), [zlib.crc32(x.encode()) % buckets for x in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]

    made = [(i, *parts(t)) for i, t in rows]
    s, t = collections.Counter(), collections.Counter()
    for _, _, f in made:
        s.update(f)
    for x in target:
        t.update(parts(x)[1])
    all_s, all_t = s.total(), t.total()

    def gain(b):
        return math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))

    out = []
    for i, n, f in made:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in out if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    taken = [(*r[:4], k + 1) for k, r in enumerate(able[: len(able) * percent // 100])]
    rest = able[len(taken) :] + [r for r in out if r[4] < min_words]
    return collections.Counter(taken + [(*r[:4], None) for r in rest])


def test_resampling_equals_brute_force(spark, docs, rows, sf):
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()] + [None, ""]
    aim = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id int, text string")
    got = collections.Counter(tuple(r) for r in resample.resample(docs, aim).collect())
    assert got == brute_resample(rows, target)
    assert max(r[4] or 0 for r in got) > 10


def test_resampling_query_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = collections.Counter(tuple(r) for r in queries.op13_importance_resampling(spark, sf).collect())
    assert got == brute_resample(rows, target)


def test_resampling_of_awkward_tables(spark, docs):
    aim = spark.createDataFrame([("a b c",)], "text string")
    assert resample.resample(docs.limit(0), aim).count() == 0
    nothing = resample.resample(docs, aim.limit(0)).collect()
    assert len(nothing) == docs.count() and sum(r["rank"] is not None for r in nothing) > 10
    with pytest.raises(ValueError):
        resample.resample(docs, aim, buckets=1 << 17)


def test_ranks_over_many_partitions(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, *range(300)]), rng.randrange(9)) for _ in range(2000)]
    df = spark.createDataFrame(rows, "id long, score long").repartition(7)
    from pyspark.sql import functions as F

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = resample.ranked(df, [F.desc("score"), F.asc_nulls_last("id")]).orderBy("place").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert [r.place for r in got] == list(range(1, 2001))
    assert [(r.id, r.score) for r in got] == sorted(rows, key=lambda r: (-r[1], r[0] is None, r[0] or 0))
