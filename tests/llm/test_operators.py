"""The operators against brute force, on small tables with the awkward rows in them."""

import base64
import collections
import hashlib
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from aisleframe.llm import decontam, line_dedup, lm_score, mixing, pii, quality, simhash, suffix, tokens, warc
from aisleframe.llm.common import shared_folder

SPLIT = re.compile("[\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _doc string, _words int"
PASSAGE = "the quick brown fox jumps over the lazy dog while seven wizards quietly box up some jugs of liquor. "


def words(t):
    return [w for w in SPLIT.split(t or "") if w]


@pytest.fixture(scope="module")
def rows(spark, sf):
    base = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    odd = [(1001, None), (1002, ""), (None, "no id here. " * 30), (1003, " \n\t\n "), (1004, "Ünï cödé 日本 " * 20)]
    odd += [(1005, PASSAGE * 9), (1006, "start " + PASSAGE * 9 + " end"), (1007, PASSAGE * 9), (1007, PASSAGE * 9)]
    odd += [(1008, "a" * 5000), (1009, "\n".join(["One line of some length is here."] * 9))]
    odd += [(1010, "One line of some length is hore.\nAnother."), (1011, "One line of some length is here")]
    return base + odd


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{k % 3}" if k % 7 else None, 0, "x", 1) for k, (i, t) in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_warc_round_trip(spark):
    pages = [(1, "u1", "<a>"), (2, "u2", "<a>"), (2, "u2", "<a>"), (3, None, None), (4, "u4", ""), (None, "u5", "é")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS owner")
    got = collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive(df).collect())

    def want(i, body, kind, ref):
        b = body.encode()
        return (i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), kind, ref)

    assert got == collections.Counter(
        [want(1, "<a>", "revisit", 2), want(2, "<a>", "response", None), want(2, "<a>", "revisit", 2),
         want(3, "", "revisit", 4), want(4, "", "response", None), want(None, "é", "response", None)]
    )
    folder = shared_folder(spark, "t")
    warc.write_archive(df, folder)
    records = [bytes(r.record) for r in warc.restore(spark, folder).collect()]
    assert sum(r.endswith(b"\r\n\r\n<a>\r\n\r\n") for r in records) == 1 and len(records) == 6
    wanted = {"WARC-Type", "WARC-Record-ID", "WARC-Date", "WARC-Target-URI", "WARC-Payload-Digest", "Content-Type", "Content-Length"}
    for r in records:
        top, _, rest = r.partition(b"\r\n\r\n")
        first, *lines = top.decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines)
        more = {"WARC-Profile", "WARC-Refers-To"} if fields["WARC-Type"] == "revisit" else set()
        assert first == "WARC/1.1" and set(fields) == wanted | more
        assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", fields["WARC-Date"])
        block = rest.removesuffix(b"\r\n\r\n")
        assert len(block) == int(fields["Content-Length"]) and len(rest) == len(block) + 4
        http, _, payload = block.partition(b"\r\n\r\n")
        assert http.startswith(b"HTTP/1.1 200 OK\r\n") and (not payload or fields["WARC-Type"] == "response")
    broken = spark.createDataFrame([(7, "a\r\nWARC-Type: x", "y")], "page_id long, url string, html string")
    assert warc.archive(broken).first().record_type == "response"
    assert warc.archive(df.limit(0)).count() == 0


def test_simhash_components(docs, rows, none):
    import xxhash

    def print_of(t):
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [print_of(t) for _, t in rows]
    label = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 2:
            old, new = label[b], label[a]
            label = [new if x == old else x for x in label]
    least = {c: min((rows[k][0] for k in range(len(rows)) if label[k] == c and rows[k][0] is not None), default=None) for c in label}
    want = collections.Counter((rows[k][0], f"{fps[k]:016x}", least[label[k]]) for k in range(len(rows)))
    got = collections.Counter(tuple(r) for r in simhash.components(docs).collect())
    assert got == want
    assert simhash.components(none).count() == 0


def test_crowded_values_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PAIRED_AT_MOST", 3)
    rng = np.random.default_rng(5)
    base = int(rng.integers(1 << 62))
    fps = {base} | {base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 63, (80, 2))} | {int(x) for x in rng.integers(1 << 62, size=40)}
    from aisleframe.operators.similarity import connected_components

    got = connected_components(simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long")))
    comp = {r["id"]: r["component"] for r in got.collect()}
    label = {x: x for x in fps}
    for a, b in itertools.combinations(sorted(fps), 2):
        if (a ^ b).bit_count() <= 2:
            old, new = label[b], label[a]
            label = {k: new if v == old else v for k, v in label.items()}
    sizes = collections.Counter(label.values())
    want = {k: v for k, v in label.items() if sizes[v] > 1}
    low = {v: min(k for k in want if want[k] == v) for v in want.values()}
    assert comp == {k: low[v] for k, v in want.items()}


def test_thresholds_sum_to_the_principle():
    n = np.array([[1, 1, 900, 2], [5, 5, 5, 5]], float)
    t = simhash.allocate(n, [16] * 4, np.ones(4), 2, 2)
    assert t.sum(axis=1).tolist() == [-1, -1] and t[0, 2] == -1


def test_one_of_each_group(docs, rows, none):
    kept = collections.Counter(r.doc_id for r in simhash.one_of_each_group(docs).collect())
    assert kept[1005] == 1 and kept[1007] == 0 and kept[1006] == 0 and kept[1001] + kept[1002] == 1
    assert all(kept[i] for i in (1004, 1008, 1009, None))
    assert simhash.one_of_each_group(none).columns == none.columns


def near_copies(rng, base, share):
    """A copy of the words with some replaced, so that the shingle sets are ``share`` alike or a little more."""
    have = {tuple(base[i : i + 5]) for i in range(len(base) - 4)}
    copy = list(base)
    for k in rng.permutation(len(base)):
        new = [*copy[:k], f"new{rng.integers(1 << 40)}", *copy[k + 1 :]]
        got = {tuple(new[i : i + 5]) for i in range(len(new) - 4)}
        if len(have & got) < share * len(have | got):
            break
        copy = new
    return copy


def first_of_groups(texts, t=0.8):
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} for i, w in texts.items()}
    label = {i: i for i in texts}
    for a, b in itertools.combinations(sorted(texts), 2):
        if label[a] != label[b] and 10 * len(sets[a] & sets[b]) >= 10 * t * len(sets[a] | sets[b]):
            low, high = sorted((label[a], label[b]))
            label = {k: low if v == high else v for k, v in label.items()}
    return sorted(set(label.values()))


def kept_of(spark, texts):
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    return sorted(r.doc_id for r in simhash.one_of_each_group(df).collect())


def test_every_pair_from_the_similarity_on_is_met(spark):
    rng = np.random.default_rng(3)
    texts = {}
    for k in range(120):
        texts[k] = [f"w{x}" for x in rng.integers(1 << 30, size=rng.integers(40, 160))]
        texts[1000 + k] = near_copies(rng, texts[k], 0.8 + 0.001 * (k % 100))
    # One shingle repeated unequally: equal sets.
    for k in range(20):
        many = [f"u{k}x{x}" for x in range(50)]
        texts[2000 + k], texts[3000 + k] = many + ["z"] * 50, many + ["z"] * 12
    want = first_of_groups(texts)
    assert len(want) == 140 and kept_of(spark, texts) == want


def test_crowded_boilerplate_hides_no_pair(spark):
    rng = np.random.default_rng(4)
    passage = [f"p{x}" for x in range(60)]
    # The repeated word weighs so much in fingerprints that many share part of one.
    texts = {k: passage[:20] + ["z"] * (20 + k % 40) + [f"w{x}" for x in rng.integers(1 << 30, size=60)] for k in range(240)}
    texts |= {1000 + k: near_copies(rng, texts[k], 0.8) for k in range(0, 240, 3)}
    assert kept_of(spark, texts) == first_of_groups(texts)


def test_chains_are_followed_through_texts_that_go(spark):
    rng = np.random.default_rng(6)
    base = [f"b{x}" for x in range(150)]
    # Copies made independently of one base: near to it, not to each other; the base is not the first.
    texts = {k: near_copies(rng, base, 0.82) for k in range(60)} | {30_000: base}
    line = [f"c{x}" for x in range(100)]
    for k in range(100, 108):
        texts[k] = line
        line = near_copies(rng, line, 0.85)
    want = first_of_groups(texts)
    assert want == [0, 100] and kept_of(spark, texts) == want


@pytest.mark.parametrize("length,limit", [(400, 4000), (60, 4000), (60, 1)])
def test_suffix(docs, rows, none, length, limit, monkeypatch):
    monkeypatch.setattr(suffix, "SORTED_TOGETHER", limit)
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = collections.Counter(b[k : k + length] for _, b in texts for k in range(len(b) - length + 1))
    want = collections.Counter()
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        want[i, len(b), int(gone.sum()), runs, bytes(np.frombuffer(b, np.uint8)[~gone])] += 1
    got = collections.Counter((*tuple(r)[:4], bytes(r.kept)) for r in suffix.remove_repeats(docs, length).collect())
    assert got == want
    assert suffix.remove_repeats(none).count() == 0


@pytest.mark.parametrize("limit", [2, 20, 4000])
def test_suffix_crowded_keys_are_cut_finer(spark, limit, monkeypatch):
    monkeypatch.setattr(suffix, "SORTED_TOGETHER", limit)
    rng = np.random.default_rng(8)
    word = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    passage, length = word(110), 60
    # One passage in many surroundings, whole or in part, so that many different slices share its keys.
    texts = [word(int(rng.integers(90))) + passage[int(rng.integers(40)) : 70 + int(rng.integers(40))] + word(int(rng.integers(90))) for _ in range(90)]
    texts += [texts[0], word(30) + texts[1][:80], "é" * 70, "é" * 35, passage[:59], ""]
    seen = collections.Counter(b[k : k + length] for b in (t.encode() for t in texts) for k in range(len(b) - length + 1))
    want = {}
    for i, t in enumerate(texts):
        b = t.encode()
        gone = {k + x for k in range(len(b) - length + 1) if seen[b[k : k + length]] > 1 for x in range(length)}
        want[i] = bytes(c for k, c in enumerate(b) if k not in gone)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert {r.doc_id: bytes(r.kept) for r in suffix.remove_repeats(docs, length).collect()} == want


def test_pii_round_trip_and_links(docs, rows, none):
    key = b"0123456789abcdef"
    text = "Card 4111 1111 1111 1111, DE89 3704 0044 0532 0130 00, +1 (425) 555-9684, 2024-02-29 2024-02-30 10.0.0.1 999.1.1.1 a.b@c.org token = \"0a1b2c3d4e\" 078-05-1120 1234567890123456"
    out, found = pii.pseudonymise(text, key)
    assert dict(found) == {"card": 1, "iban": 1, "phone": 1, "date": 1, "ip": 1, "email": 1, "secret": 1, "ssn": 1}
    assert "2024-02-30" in out and "999.1.1.1" in out and "1234567890123456" in out and "4111 1111 1111 1111" not in out
    assert pii.pseudonymise(out, key, back=True)[0] == text and pii.pseudonymise(text, key)[0] == out
    assert sorted(pii.permute(x, 37, key, "t") for x in range(37)) == list(range(37))
    got = pii.protect(docs, key)
    back = pii.protect(got, key, back=True)
    assert collections.Counter((r.doc_id, r.text) for r in back.collect()) == collections.Counter(rows)
    assert pii.protect(none, key).count() == 0


def test_tokens_equal_the_library(docs, rows, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    count = tokens._counter(path)
    for t in ["", "a<|endoftext|>b", " \n\n x", "\x1c \x85b", "日本 ١٢ Ⅷ½ 's 'S don't", "é ᠎﻿\U0001f600"]:
        assert count(t) == len(lib.encode(t, add_special_tokens=False).ids)
    want = collections.Counter((i, len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in rows)
    assert collections.Counter(tuple(r) for r in tokens.count_tokens(docs, path).collect()) == want
    assert tokens.count_tokens(none, path).count() == 0


def test_quality_counts_and_verdict(docs, rows, none):
    def base(t):
        w, places = words(t), collections.defaultdict(list)
        for i in range(len(w) - 2):
            places[tuple(w[i : i + 3])].append(i)
        covered = {i + k for p in places.values() if len(p) > 1 for i in p for k in range(3)}
        full = [x for x in (t or "").split("\n") if words(x)]
        n, rep = len(w), len(covered)
        return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(full) - len(set(full)), rep, n < 50 or 100 * rep > 50 * n

    got = quality.quality(docs)
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert collections.Counter(tuple(r) for r in got.select(*cols).collect()) == collections.Counter((i, *base(t)) for i, t in rows)
    assert got.filter("kept AND base_failed").count() == 0 and got.filter("kept").count() > 20
    assert quality.keep_good(docs).columns == docs.columns and quality.quality(none).count() == 0


def test_quality_agrees_with_labels(spark, sf):
    q = quality.quality(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    assert q.filter("quality = 1 AND NOT base_failed AND NOT kept").count() == 0
    assert q.filter("quality = 0 AND toxic = 0 AND kept").count() == 0


def test_lm_prefers_its_target(spark, none):
    texts = [(i, "aba abba baab " * (3 + i % 4)) for i in range(20)] + [(i, "xyz zyx yxxz " * (3 + i % 4)) for i in range(20, 40)]
    df = spark.createDataFrame([*texts, (40, None), (None, "aba")], "doc_id long, text string")
    got = {r.doc_id: r for r in lm_score.cross_entropy_difference(df, df.filter("doc_id < 10").select("doc_id")).collect()}
    assert all(got[i].score < 0 for i in range(20)) and all(got[i].score > 0 for i in range(20, 40))
    assert got[40].n_tokens == 0 and got[40].score is None and got[None].score < 0
    p = 2.0 ** -lm_score.losses(np.arange(27.0), 3, 3, 5.0).reshape(3, 3, 3)
    assert np.allclose(p.sum(axis=-1), 1)
    assert lm_score.cross_entropy_difference(none, none.select("doc_id")).count() == 0


def test_lm_tells_apart_texts_of_any_script(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "CHUNK", 500)
    # 150 frequent characters come first; the CJK texts differ in characters that are rare beside them.
    latin = [(i, "".join(chr(0x4E00 + (7 * i + k) % 150) for k in range(600))) for i in range(20)]
    cjk = [(100 + i, "日本語学" * 3) for i in range(6)] + [(200 + i, "山川草木" * 3) for i in range(6)]
    texts = [*latin, *cjk, (300, ""), (None, "日本")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r for r in lm_score.cross_entropy_difference(df, df.filter("doc_id BETWEEN 100 AND 102").select("doc_id")).collect()}
    assert len(got) == len(texts) and got[300].score is None
    assert all(got[100 + i].score < 0 < got[200 + i].score for i in range(6))
    # The dense formula over all characters gives the same figures.
    known = {c: k + 1 for k, c in enumerate(sorted({c for _, t in texts for c in t.lower()}))}
    counts = np.zeros((2, (len(known) + 1) ** 3), np.float32)

    def cells(t):
        ids = [0, 0, *(known[c] for c in t.lower())]
        return [(a * (len(known) + 1) + b) * (len(known) + 1) + c for a, b, c in zip(ids, ids[1:], ids[2:])]

    for i, t in texts:
        np.add.at(counts[1], cells(t), 1)
        if i in (100, 101, 102):
            np.add.at(counts[0], cells(t), 1)
    counts[1] *= counts[0].sum() / counts[1].sum()
    own, other = (lm_score.losses(c, len(known) + 1, 3, 5.0) for c in counts)
    for i, t in texts:
        if t:
            assert got[i].n_tokens == len(t) and np.allclose([got[i].target_loss, got[i].background_loss], [own[cells(t)].mean(), other[cells(t)].mean()], rtol=1e-4)
    short = lm_score.distinct_grams(["abab", "ab"], 5)
    assert sorted(short[0]) == ["a", "ab", "aba", "abab"] and len(short[1]) == 6


def test_masks_meet_every_window():
    for bad in itertools.combinations(range(13), 2):
        assert any(
            all(s + i not in bad for i, c in enumerate(m) if c == "1") for m in decontam.MASKS for s in range(13 - len(m) + 1)
        )


def fewest_replaced(masks, upto):
    """By length, the fewest replaced words that leave no mask clear in a stretch with both ends equal."""
    places = [(int(m, 2), len(m)) for m in masks]
    keep = (1 << max(n for _, n in places)) - 1
    states, out = {0: 0}, {}
    for n in range(1, upto + 1):
        after = {}
        for state, cost in states.items():
            for bad in (0, 1) if n > 1 else (0,):
                new = (state << 1 | bad) & keep
                if not any(n >= k and not new & m for m, k in places):
                    after[new] = min(cost + bad, after.get(new, 99))
        states = after
        out[n] = min((c for s, c in states.items() if not s & 1), default=99)
    return out


def test_masks_meet_every_stretch_at_80_percent():
    fewest = fewest_replaced(decontam.MASKS, 100)
    assert all(fewest[n] > n // 5 for n in range(13, 101))
    assert fewest_replaced(("11101011", "1011000111"), 15)[15] == 3
    for n in range(1, 13):
        for bad in itertools.combinations(range(1, max(n - 1, 1)), n // 5):
            assert any(not set(bad) & set(on) for on in decontam.short_shapes(n))


def test_short_items_and_replaced_words_at_exactly_80_percent(spark):
    def words_off(n, off):
        return " ".join(f"other{i}" if i in off else f"word{n}x{i}" for i in range(n))

    cases = [(15, (2, 7, 10)), (12, (3, 7)), (10, (3, 6)), (7, (3,)), (5, (2,)), (4, ())]
    bench = spark.createDataFrame([(n, words_off(n, ())) for n, _ in cases], "item_id long, text string")
    more = spark.createDataFrame([(n, f"a b {words_off(n, off)} c") for n, off in cases] + [(99, words_off(4, (1,)))], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.overlap_words for r in decontam.overlaps(more, bench).collect()}
    assert got == {(n, n): n for n, _ in cases}


def test_best_stretch():
    rng = np.random.default_rng(1)
    for _ in range(200):
        same = (rng.random(25) < 0.7).astype(float)
        want = max((e - b for b in range(25) for e in range(b + 1, 26) if same[b] and same[e - 1] and same[b:e].sum() >= 0.8 * (e - b) - 1e-9), default=0)
        assert decontam.best_stretch(same, 0.8) == want


def test_decontamination(spark, docs, none):
    item = "seven tall ships sailed past the old harbour wall before noon on a bright windy day in early spring"
    changed = item.replace("harbour", "garden").replace("bright", "dull")
    bench = spark.createDataFrame([(1, item), (2, "short one here"), (3, None), (4, "")], "item_id long, text string")
    more = spark.createDataFrame([(1, f"x y {item}, z"), (2, f"Q: {changed}!"), (3, "some Short one here."), (4, " ".join(item.split()[:10])), (None, item), (5, None)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.overlap_words for r in decontam.overlaps(more, bench).collect()}
    assert got == {(1, 1): 19, (2, 1): 19, (3, 2): 3, (None, 1): 19}
    assert sorted(r.doc_id for r in decontam.clean(more, bench).collect()) == [4, 5]
    assert decontam.overlaps(none, bench).count() == 0 and decontam.overlaps(docs, bench.limit(0)).count() == 0


def test_mixing(docs, none):
    got = mixing.mix(docs)
    rows = got.select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    assert rows and sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs).select(*rows[0].__fields__).collect()))
    by = collections.defaultdict(list)
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        by[r.source].append(r)
    names = sorted((s for s in by if s is not None)) + [None]
    size = {s: sum(r.size for r in by[s]) for s in names}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    goal, capped = {}, set()
    while True:
        left = sum(size.values()) - sum(3 * size[s] for s in capped)
        level = left / sum(weight[s] for s in names if s not in capped)
        over = {s for s in names if s not in capped and weight[s] * level > 3 * size[s]}
        if not over:
            break
        capped |= over
    for s in names:
        goal = 3 * size[s] if s in capped else weight[s] * level
        assert all(abs(r.target - goal) < 1e-6 * goal for r in by[s])
        assert abs(sum(r.taken for r in by[s]) - goal) <= 0.1 * goal
    assert mixing.mix(none).count() == 0


def test_line_dedup(docs, rows, none):
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert got[1009].text == "One line of some length is here." and got[1009].n_removed == 8
    assert got[1010].text == "Another." and got[1010].n_near == 1 and got[1011].n_near == 1
    assert got[1001].text is None and got[1003].text == " \n\t\n " and got[1007].text == ""
    full, rest = line_dedup.deletion_hashes("abc")
    assert rest[1] == line_dedup.deletion_hashes("ac")[0] and full == line_dedup.deletion_hashes("abc")[0]
    assert line_dedup.without_repeats(docs).columns == docs.columns and line_dedup.dedup_lines(none).count() == 0


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality rules", "line dedup", "simhash near-dedup", "benchmark decontamination", "source mixing"
    ]
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 50 and {"doc_id", "text", "copies"} <= set(out.columns)


def test_mixing_with_awkward_columns_and_ids(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    made = ["size", "source_size", "target", "copies", "taken"]
    plain = collections.Counter(tuple(r) for r in mixing.mix(docs).select("doc_id", *made).collect())
    names = ["words", "_n", "_rate", "_extra", "_lots", "_mine", "_key", "_told", "_none", "_name", "_size", "_m", "SIZE", "_nr"]
    got = mixing.mix(docs.selectExpr("*", *[f"1 AS {n}" for n in names]))
    assert set(names) - {"SIZE"} <= set(got.columns)
    assert collections.Counter(tuple(r) for r in got.select("doc_id", *made).collect()) == plain
    # Null and repeated ids and rows: every row is a document, and the sources still meet their targets.
    odd = docs.selectExpr("CAST(NULL AS LONG) AS doc_id", "text", "source").unionByName(docs.select("doc_id", "text", "source").limit(1))
    for _ in range(5):
        odd = odd.unionByName(docs.select("doc_id", "text", "source").limit(1))
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count()
    by = collections.defaultdict(list)
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        by[r.source].append(r)
    assert all(abs(sum(r.taken for r in x) - x[0].target) <= 0.03 * x[0].target + 50 for x in by.values())


def test_newton_steps_solve_every_source(spark):
    rng = np.random.default_rng(4)
    cells, goals = [], []
    for k in range(12):
        sizes = rng.choice(np.arange(1, 900), 40, replace=False)
        counts = rng.integers(1, 30, 40)
        cells += [(False, f"s{k}", int(s), int(n)) for s, n in zip(sizes, counts)]
        words = int((sizes * counts).sum())
        goals.append((False, f"s{k}", words, words * [0.01, 0.3, 1.0, 1.7, 2.9, 3.0][k % 6]))
    cells.append((True, "", 0, 3))
    goals.append((True, "", 0, 0.0))
    c = spark.createDataFrame(cells, "_none boolean, _name string, _size long, _n long")
    g = spark.createDataFrame(goals, "_none boolean, _name string, words long, target double")
    for r in mixing.solve(c, g, 3).collect():
        if r["_none"]:
            continue
        mine = [(s, n) for _, name, s, n in cells if name == r["_name"]]
        got = sum(s * n * min(3.0, np.exp(min(r.multiplier * s / r["mean"], 700.0))) for s, n in mine)
        assert got == pytest.approx(r.target, rel=1e-8)


def near_by_definition(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def test_near_lines_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    base = ["Read more", "short line", "abcde", "Share this page with friends", "a line of nineteen!", "Back to the top of the page"]
    texts = []
    for k in range(80):
        lines = []
        for _ in range(rng.integers(0, 7)):
            line = list(base[rng.integers(len(base))])
            for _ in range(rng.integers(0, 3)):
                at = rng.integers(len(line) + 1)
                kind = rng.integers(3)
                line[at : at + (kind > 0)] = [] if kind == 1 else [chr(97 + rng.integers(3))]
            lines.append("".join(line))
        texts.append((k, "\n".join(lines)))
    want, seen = {}, []
    for k, t in texts:
        kept, near = [], 0
        for line in t.split("\n"):
            if not words(line):
                kept.append(line)
                continue
            close = len(line) >= 5 and any(len(x) >= 5 and x != line and near_by_definition(x, line) for x in seen)
            if close or line in seen:
                near += bool(close)
            else:
                kept.append(line)
            seen.append(line)
        want[k] = ("\n".join(kept), near)
    # A line's verdict is that of its first place: lines near an earlier one go wherever they stand.
    got = {r.doc_id: (r.text, r.n_near) for r in line_dedup.dedup_lines(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert sum(v[1] for v in got.values()) > 20


REAL = [
    "+44 20 7946 0958", "+33 1 23 45 67 89", "+34 912 34 56 78", "415 555 2671", "020 7946 0958", "(030) 1234567", "+1 (425) 555-9684",
    "31/12/2020", "12/31/2020", "2001:db8::1", "FE80::1FF:FE23:4567:890A", "2001:0:0:0:0:0:0:1", "de89 3704 0044 0532 0130 00", "10.0.0.1",
]


def test_real_formats_change_and_come_back():
    key = b"0123456789abcdef"
    for value in REAL:
        text = f"call {value}, or not."
        out, found = pii.pseudonymise(text, key)
        assert sum(found.values()) == 1 and value not in out, value
        assert pii.pseudonymise(out, key, back=True)[0] == text
        # Dotted addresses have numbers of one to three digits.
        assert value == "10.0.0.1" or [c.isdigit() or c.isalpha() for c in out] == [c.isdigit() or c.isalpha() for c in text]
    text = " ".join(f"[{v}]" for v in REAL)
    assert pii.pseudonymise(pii.pseudonymise(text, key)[0], key, back=True)[0] == text
    for plain in ("at 12:30:45 sharp", "00:1a:2b:3c:4d:5e", "page 3/12", "32/12/2020", "1990 2000 2010", "::", "a::b c"):
        back = pii.pseudonymise(plain, key)[0]
        assert back == plain or plain == "a::b c", plain


def test_day_first_dates_stay_within_their_kind():
    key = b"0123456789abcdef"
    seen = set()
    for day in range(13, 29):
        for month in range(1, 13):
            s = f"{day:02d}/{month:02d}/2001"
            out = pii.pseudonymise(s, key)[0]
            assert 12 < int(out[:2]) <= 31 and int(out[3:5]) <= 12
            assert pii.pseudonymise(out, key, back=True)[0] == s
            seen.add(out)
    assert len(seen) == 16 * 12


def feistel_again(x, n, key, tweak):
    """A second reading of the permutation, by the definition: forward rounds on halves, walking the cycle."""
    bits = max((n - 1).bit_length() + 1, 2) // 2
    while True:
        hi, lo = divmod(x, 1 << bits)
        for r in range(pii.ROUNDS):
            message = f"{tweak}|{n}|{r}|".encode() + lo.to_bytes((bits + 7) // 8, "big")
            f = int.from_bytes(hashlib.blake2b(message, key=key, digest_size=min(64, (bits + 7) // 8 + 8)).digest(), "big") % (1 << bits)
            hi, lo = lo, hi ^ f
        x = (hi << bits) + lo
        if x < n:
            return x


def test_query_of_pseudonyms_equals_a_second_implementation(spark, docs, rows):
    """Formats whose pseudonym is one permutation, replaced by plain pattern matching in texts that hold nothing else."""
    key = b"0123456789abcdef"
    rng = np.random.default_rng(1)
    texts, want = [], []
    for k in range(60):
        a, b = rng.integers(10**9, 10**10), rng.integers(1, 255, 4)
        card = str(rng.integers(10**14, 10**15))
        card += pii.luhn_digit(card)
        phone = f"+1 ({str(a)[:3]}) {str(a)[3:6]}-{str(a)[6:]}"
        ip = ".".join(map(str, b))
        texts.append((k, f"no {phone} and {ip} with {card}."))
        p = str(feistel_again(int(a), 10**10, key, "phone+1")).zfill(10)
        q = feistel_again(int.from_bytes(bytes(b.tolist()), "big"), 2**32, key, "ip").to_bytes(4, "big")
        c = str(feistel_again(int(card[:-1]), 10**15, key, "card")).zfill(15)
        want.append((k, f"no +1 ({p[:3]}) {p[3:6]}-{p[6:]} and {'.'.join(map(str, q))} with {c}{pii.luhn_digit(c)}."))
    got = pii.protect(spark.createDataFrame(texts, "doc_id long, text string"), key).select("doc_id", "text").collect()
    assert sorted(tuple(r) for r in got) == want


def test_fingerprints_bring_near_texts_together_first(spark, monkeypatch):
    """The near-duplicate stage verifies the pairs that SimHash fingerprints link; rare shingles find the others."""
    text = " ".join(f"word{k}" for k in range(400))
    rows = [(0, text), (1, text + " end"), (2, text.replace("word200", "other")), (3, " ".join(f"word{k}" for k in range(40, 430))), (4, "on its own"), (5, None)]
    found, pairs = [], simhash.simhash_pairs
    monkeypatch.setattr(simhash, "simhash_pairs", lambda *a: found.append(pairs(*a)) or found[-1])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = simhash.one_of_each_group(docs)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 4, 5] and len(found) == 1
    prints = spark.createDataFrame([(1, 0), (2, 0), (3, 3), (4, 7 << 60), (5, -1)], "id long, fp long")
    assert {tuple(r) for r in pairs(prints).collect()} == {(2, 1), (3, 1)}
    assert pairs(prints.limit(0)).count() == 0


@pytest.mark.parametrize("leaders", [1, 2, 32])
def test_components_carry_links_from_round_to_round(spark, monkeypatch, leaders):
    """Links of earlier rounds go on as one link a text, and chains still end in one component, however many texts lead at first."""
    words = [f"w{k}" for k in range(160)]
    chain = [(k, " ".join(words[6 * k : 6 * k + 100])) for k in range(10)]
    texts = chain + [(100 + k, " ".join(f"v{k}x{j}" for j in range(60))) for k in range(4)]
    texts += [(200 + k, " ".join([*words[20:60], *(f"y{k}x{j}" for j in range(4))])) for k in range(40)]
    monkeypatch.setattr(simhash, "FIRST_LEADERS", leaders)
    monkeypatch.setattr(simhash, "simhash_pairs", lambda prints, distance=2: prints.select("id", F.col("id").alias("to")).limit(0))
    joined, given = simhash.connected_components, []
    monkeypatch.setattr(simhash, "connected_components", lambda edges: given.append(edges.count()) or joined(edges))
    sets = {k: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for k, t in texts}
    first = {k: k for k in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and first[a] != first[b]:
                low, high = sorted((first[a], first[b]))
                first = {k: low if v == high else v for k, v in first.items()}
    kept = simhash.one_of_each_group(spark.createDataFrame(texts, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(first.values()))
    assert len(set(first.values())) < len(first) and given
