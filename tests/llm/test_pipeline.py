"""Every stage of the pipeline against a plain second implementation, each on what the stage before kept."""

import itertools
import re

import numpy as np
import pytest

import corpus_pipeline

SPLIT = re.compile("[\x20\x09-\x0d]+")
PASSAGE = "the quick brown fox jumps over the lazy dog while seven wizards quietly box up some jugs of liquor. "


def words(t):
    return [w for w in SPLIT.split(t or "") if w]


def good_line(line):
    """The rules of a line, one after the other, in plain Python."""
    n = len(words(line))
    if not re.search(r"[.!?…。！？][\"'”’»)\]]*(?:[ \t\n\x0b\f\r]|$)", line):
        return False
    noisy = sum(bool(re.search(r"(?:[!?]{2}|[#*$%&<>])$", w)) for w in words(line))
    if noisy and noisy * 10 > n * 3:
        return False
    bars = sum(c in "|»›•" for c in line)
    if bars >= 3 and bars * 5 >= n:
        return False
    return not re.search(
        r"(?i)\bcopyright\b|all rights reserved|\blicen[sc]ed under\b|\breleased under\b|\bcookies?\b|privacy policy"
        r"|terms of (?:use|service)|\bsubscribe\b|\b(?:sign|log) (?:in|up)\b|click here|\bjavascript\b|lorem ipsum|^\s*share this\b",
        line,
    )


def after_quality(rows):
    out = {}
    for i, t in rows.items():
        w = words(t)
        triples = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        twice = {x for x in triples if triples.count(x) > 1} if len(set(triples)) < len(triples) else set()
        covered = {k + d for k, x in enumerate(triples) if x in twice for d in range(3)}
        if len(w) < 50 or 100 * len(covered) > 50 * len(w):
            continue
        full = [x for x in (t or "").split("\n") if words(x)]
        kept = [x for x in dict.fromkeys(full) if good_line(x)]
        total, left = sum(map(len, full)), sum(map(len, kept))
        if total - left <= total * 0.5:
            out[i] = "\n".join(kept)
    return out


def near_lines(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    k = next((k for k in range(len(short)) if short[k] != long[k]), len(short))
    return long[:k] + long[k + 1 :] == short


def after_lines(rows):
    first = {}
    for i in sorted(rows):
        for nr, line in enumerate(rows[i].split("\n")):
            if words(line):
                first.setdefault(line, (i, nr))
    by_half = {}
    for line in first:
        n = len(line)
        if n >= 5:
            for side, m in itertools.product((0, 1), (n, n - 1)):
                by_half.setdefault((side, m, line[: m // 2] if side == 0 else line[n - m // 2 :]), set()).add(line)
    gone = set()
    for group in by_half.values():
        for a, b in itertools.combinations(group, 2):
            if near_lines(a, b):
                gone.add(max(a, b, key=first.get))
    return {
        i: "\n".join(x for nr, x in enumerate(t.split("\n")) if not words(x) or (x not in gone and first[x] == (i, nr)))
        for i, t in rows.items()
    }


def after_near_duplicates(rows):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, t in rows.items():
        w = words(t.translate(low))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else {()}
    label = {i: i for i in rows}
    for a, b in itertools.combinations(sorted(rows), 2):
        if label[a] != label[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
            low_label, high = sorted((label[a], label[b]))
            label = {k: low_label if v == high else v for k, v in label.items()}
    return {i: rows[i] for i in set(label.values())}


def overlaps(text, item):
    def plain(t):
        return [w.strip(".,;:!?\"'()[]{}…“”‘’«»") or w for w in t.lower().split()]

    known = {}
    d, q = (np.array([known.setdefault(x, len(known)) for x in plain(t)]) for t in (text, item))
    need = min(13, len(q))
    for shift in range(-len(q) + 1, len(d)) if need else ():
        lo, hi = max(0, -shift), min(len(q), len(d) - shift)
        same = q[lo:hi] == d[lo + shift : hi + shift]
        if same.sum() < 0.8 * need:
            continue
        on = np.flatnonzero(same)
        for a, b in itertools.combinations_with_replacement(on, 2):
            if b - a + 1 >= need and same[a : b + 1].sum() >= 0.8 * (b - a + 1) - 1e-9:
                return True
    return False


@pytest.fixture(scope="module")
def start(spark, sf):
    real = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(90).collect()}
    bench = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    long = max(bench, key=len)
    base = [t for t in real.values() if len(words(t)) > 120][:4]
    fresh = "Some words of an own kind stand here as number {0} and go on for a while, each {0} times. "
    return real | {
        1000: base[0],
        1001: base[0].replace(" the ", " that ", 1),
        1002: None,
        1003: "",
        1004: (PASSAGE + "\n") * 9,
        1005: "\n".join(fresh.format(k) for k in range(8)) + "\n" + long + ".",
        1006: "\n".join(fresh.format(k) for k in range(20, 28)) + "\n" + " ".join([*long.split()[:6], "changed", *long.split()[7:]]) + ".",
        1007: "\n".join(fresh.format(k) for k in range(40, 52)),
        1008: base[1] + "\nOne more line at the end.",
    }


def test_stages_equal_a_second_implementation(spark, sf, start):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, t, "en", f"s{i % 4}" if i % 9 else None, len(t or "")) for i, t in start.items()]
    docs = spark.createDataFrame(rows, schema).repartition(4)
    bench = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if r.text]
    plain = {
        "quality rules": after_quality,
        "line dedup": after_lines,
        "simhash near-dedup": after_near_duplicates,
        "benchmark decontamination": lambda x: {i: t for i, t in x.items() if not any(overlaps(t, q) for q in bench)},
    }
    held, sizes = dict(start), [len(start)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).persist()
        assert docs.columns == schema.replace(" long", "").replace(" string", "").split(", ")
        got = {r.doc_id: r.text for r in docs.collect()}
        assert got == plain[name](held), name
        assert all(r.n_chars == len(r.text) for r in docs.collect())
        held = got
        sizes.append(len(got))
    assert sizes[0] > sizes[1] == sizes[2] > sizes[3] > sizes[4] > 10 and {1005, 1006, 1000, 1001} & set(held) == set()
    name, mix = corpus_pipeline.STAGES[-1]
    out = mix(spark, docs, sf).collect()
    assert sorted(r.doc_id for r in out) == sorted(held)
    by = {}
    for r in out:
        assert r.text == held[r.doc_id] and r.size == len(words(r.text)) and r.taken == r.size * r.copies and 0 <= r.copies <= 3
        by.setdefault(r.source, []).append(r)
    for mine in by.values():
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(r.size for r in mine)
