"""The corpus operators: edge cases, and brute force on a small part of the synthetic tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm import components, embedding_dedup, fingerprint, line_dedup, mixing, packing, quality, queries, simhash, store, substring_dedup, suffix_dedup, url_filter
from folio.llm.cuckoo import CuckooFilter

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or {}).get(i, "s0"), len(t or "")) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def corpus(documents):
    return sorted((r.doc_id, r.text or "") for r in documents.select("doc_id", "text").collect())


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "word"), (6, "a b c d e f g h i j k l m n"), (7, "é漢字 ñ\n" * 300), (8, "x" * 5000), (None, "no id"), (4, "word")]


# --- 1 packing


def check_packed(rows, ids, capacity):
    by_doc, by_bin = {}, {}
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
        by_bin.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_bin.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_bin)


def test_packing(spark, documents, corpus):
    from tokenizers import Tokenizer

    path = queries.word_tokenizer()
    tokenizer = Tokenizer.from_file(path)
    ids = {i: tokenizer.encode(t, add_special_tokens=False).ids + [1] for i, t in corpus}
    for capacity in (4096, 300):
        rows = packing.pack(documents, path, capacity).collect()
        bins = check_packed(rows, ids, capacity)
        total = sum(map(len, ids.values()))
        assert sum(r.length for r in rows) == total and bins <= -(-total // capacity) * 1.05 + 1


def test_packing_odd(spark):
    path = queries.word_tokenizer()
    rows = packing.pack(docs_of(spark, ODD), path, 64).collect()
    assert sorted(r.length for r in rows if r.doc_id in (1, 2, 3)) == [1, 1, 1]
    assert sum(r.doc_id == 4 for r in rows) == 2 and sum(r.doc_id is None for r in rows) == 1
    assert packing.pack(docs_of(spark, []), path, 64).count() == 0
    whole = packing.sequences(docs_of(spark, ODD), path, 64).collect()
    assert sum(len(r.ids) for r in whole) == sum(r.length for r in rows) and max(len(r.ids) for r in whole) <= 64


def test_bins():
    places, n = packing.plan_bins({60: 3, 40: 3, 10: 5, 1: 7}, 100)
    assert n == 4 and sum(1 for p in places if p[0] == 60) >= 1
    assert packing.plan_bins({}, 100) == ([], 0)
    assert packing.plan_bins({100: 2, 50: 3}, 100)[1] == 4


# --- 2 fingerprints


def test_fingerprints(spark):
    rows = spark.createDataFrame([("a\nb\nc",), ("c\na\nb",), ("a\nb",), ("c",), (None,), ("",)], "text string")
    got = rows.select("text", fingerprint.fingerprint(F.col("text")).alias("fp"))
    hexes = [r[0] for r in got.select(fingerprint.hexed(F.col("fp"))).collect()]
    assert hexes[0] == hexes[1] != hexes[2] and hexes[4] == hexes[5]
    whole, part, rest = (got.where(F.col("text") == t).select("fp") for t in ("a\nb\nc", "a\nb", "c"))
    three = whole.select(F.col("fp").alias("w")).crossJoin(part.select(F.col("fp").alias("p"))).crossJoin(rest.select(F.col("fp").alias("r")))
    r = three.select(
        fingerprint.hexed(fingerprint.combine(F.col("p"), F.col("r"))) == fingerprint.hexed(F.col("w")), fingerprint.hexed(fingerprint.remove(F.col("w"), F.col("r"))) == fingerprint.hexed(F.col("p")),
        fingerprint.likeness(F.col("w"), F.col("w")),
    ).first()
    assert r[0] and r[1] and r[2] == 1.0


def test_fingerprint_query(spark, corpus):
    rows = sorted(queries.op2_fingerprint(spark, SF).collect(), key=lambda r: r.doc_id)
    for i, (doc_id, text) in enumerate(corpus):
        half, following = len(text) // 2, corpus[(i + 1) % len(corpus)][1]
        edited = text[: len(text) - half] + following[:half]
        assert (rows[i].doc_id, rows[i].n_chars, rows[i].edited_sha256) == (doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= rows[i].near_edited <= 1 and 0 <= rows[i].near_next <= 1
    assert np.mean([r.near_edited > r.near_next for r in rows]) > 0.9


def test_next_rows(spark):
    docs = spark.createDataFrame([(5, "e"), (1, "a"), (3, "c"), (None, "n"), (3, "d")], "doc_id long, text string")
    got = sorted((r.text, r.next.text) for r in fingerprint.with_next(docs, ["text"], rows=1).collect())
    assert got == [("a", "c"), ("c", "d"), ("d", "e"), ("e", "n"), ("n", "a")]
    assert fingerprint.with_next(docs.where("doc_id = 1"), ["text"]).first().next.text == "a"
    assert fingerprint.with_next(docs.limit(0), ["text"]).count() == 0


# --- 3 mixing


def test_mixing(spark):
    texts = [(i, "w " * (1 + i % 7)) for i in range(3000)]
    sources = {i: "hot" if i % 3 == 0 else f"s{i % 5}" if i % 11 else None for i in range(3000)}
    docs = docs_of(spark, texts, sources)
    rows = mixing.repetitions(docs, mixing.cycle_weights((3, 1, 2))).collect()
    again = mixing.repetitions(docs.repartition(3), mixing.cycle_weights((3, 1, 2))).collect()
    assert sorted((r.doc_id, r.times) for r in rows) == sorted((r.doc_id, r.times) for r in again)
    size, taken, target = {}, {}, {}
    for r in rows:
        s = sources[r.doc_id]
        size[s], taken[s], target[s] = size.get(s, 0) + r.size, taken.get(s, 0) + r.size * r.times, r.target
        assert r.times <= 2 and r.source_size >= r.size
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    for s in size:
        assert target[s] <= 2 * size[s] + 1e-6 and abs(taken[s] - target[s]) <= 60
    # weights decide where no cap does
    free = sorted((s is None, s or "") for s in size if target[s] < 2 * size[s] - 1e-6)
    order = sorted((s is None, s or "") for s in size)
    levels = [target[None if no else s] / (3, 1, 2)[order.index((no, s)) % 3] for no, s in free]
    assert max(levels) == pytest.approx(min(levels)) if levels else True


def test_water_filling(spark):
    """Targets against a plain loop: clamp what is above its cap, share the rest by weight, until none is."""
    rng = np.random.default_rng(8)
    for trial in range(6):
        held, weight = rng.integers(1, 10 ** (1 + trial), 20).astype(float), rng.choice([1.0, 2.0, 3.0], 20)
        share = (0.5, 1.5, 1.9, 2.0, 2.5, 1.5)[trial]
        cap, target, free = 2 * held, np.zeros(20), np.ones(20, bool)
        while free.any():
            target[free] = weight[free] * (share * held.sum() - cap[~free].sum()) / weight[free].sum()
            over = free & (target > cap)
            target[over] = cap[over]
            free &= ~over
            if not over.any():
                break
        rows = spark.createDataFrame([(i, float(h), float(w)) for i, (h, w) in enumerate(zip(held, weight, strict=True))], "i int, held double, weight double")
        got = {r.i: r.target for r in mixing.fill_targets(rows, share * held.sum(), 2.0).collect()}
        assert [got[i] for i in range(20)] == pytest.approx(target.tolist())


def test_mixing_odd(spark):
    mixed = mixing.mix(docs_of(spark, ODD, {5: None}))
    assert mixed.columns == docs_of(spark, ODD).columns
    more = docs_of(spark, [(i, "w w", ) for i in range(9)]).withColumns({c: F.lit(i) for i, c in enumerate(("size", "times", "bucket", "target", "held", "weight"))})
    assert mixing.mix(more).columns == more.columns and {(r.times, r.bucket) for r in mixing.mix(more).collect()} == {(1, 2)}
    assert mixing.mix(docs_of(spark, [])).count() == 0
    assert mixing.mix(docs_of(spark, [(1, None), (2, "")])).count() == 0


# --- 4 and 10 repeats


def brute_bytes(corpus, window):
    seen, out = {}, []
    for doc_id, text in corpus:
        data = (text or "").encode()
        covered, own = bytearray(len(data)), {}
        for i in range(len(data) - window + 1):
            k = data[i : i + window]
            if k in own or seen.get(k, doc_id) < doc_id:
                covered[i : i + window] = b"\1" * window
            own.setdefault(k, i)
        for k in own:
            seen.setdefault(k, doc_id)
        kept = bytes(x for x, c in zip(data, covered, strict=True) if not c)
        out.append((doc_id, len(data), sum(covered), len(re.findall(rb"\x01+", bytes(covered))), hashlib.sha256(kept).hexdigest()))
    return out


def brute_words(corpus, window):
    seen, out = {}, []
    for doc_id, text in corpus:
        words, own = WORD.findall(text or ""), set()
        covered = [False] * len(words)
        for i in range(len(words) - window + 1):
            k = tuple(words[i : i + window])
            own.add(k)
            if seen.get(k, doc_id) < doc_id:
                covered[i : i + window] = [True] * window
        for k in own:
            seen.setdefault(k, doc_id)
        kept = " ".join(w for w, c in zip(words, covered, strict=True) if not c)
        out.append((doc_id, len(words), sum(covered), hashlib.sha256(kept.encode()).hexdigest()))
    return out


REPEATS = [
    (1, "one two three four five six seven eight nine ten " * 3), (2, "zero one two three four five six seven eight nine ten one two"), (3, "aaaa" * 60), (4, "aaaa" * 61), (5, None), (6, ""),
    (7, "prefix one two three four five six seven eight nine suffix"), (8, "é漢字 " * 40), (9, "é漢字 " * 41), (9, "é漢字 " * 41), (12, "short"),
]


def thue_morse(n, a, b):
    """Two words that every polynomial hash modulo 2^64 confuses, whatever its base."""
    bits = [i.bit_count() & 1 for i in range(n)]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


#: Two words of 1024 letters with equal hashes from prefix sums.
TWINS = thue_morse(1024, "a", "b")


@pytest.mark.parametrize("window, batches, at_most", [(100, 1, 4096), (100, 3, 2), (20, 2, 0), (20, 1, 4096)])
def test_bytes(spark, corpus, window, batches, at_most, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SORTED", at_most)
    data = REPEATS + [(20, "x" * 90 + TWINS[0]), (21, TWINS[1] + "y" * 90), (22, TWINS[0] + "z")] + [(100 + i, t) for i, t in corpus[:50]]
    got = suffix_dedup.dedup_bytes(docs_of(spark, data), window, batches).collect()
    assert sorted(map(tuple, got)) == sorted(brute_bytes(data, window))


@pytest.mark.parametrize("words", [False, True])
def test_windows_only_of_texts_alike_beside_the_anchor(spark, words, monkeypatch):
    """Texts that share a gram and less than half a window beside it give no windows, however many they are."""
    from folio.llm import repeats

    made, whole = [], repeats.windows_of
    monkeypatch.setattr(repeats, "windows_of", lambda *a: made.append(whole(*a)) or made[-1])
    monkeypatch.setattr(repeats.RepeatIndex, "_drop", lambda *_: None)
    monkeypatch.setattr(suffix_dedup, "SORTED", 4)
    rng = random.Random(4)
    some = lambda n: " ".join(f"{rng.getrandbits(40):x}" for _ in range(n))
    data = [(i, f"{some(30)} alpha beta gamma delta epsilon zeta eta {some(30)}") for i in range(30)]
    data += [(30, data[3][1] + some(3)), (31, some(2) + data[4][1][-150:])]
    run, brute, window = (substring_dedup.dedup_words, brute_words, 13) if words else (suffix_dedup.dedup_bytes, brute_bytes, 100)
    assert sorted(map(tuple, run(docs_of(spark, data), window, 2).collect())) == sorted(brute(data, window))
    assert sum(df.count() for df in made) < 30


def test_suffix_query(spark, corpus):
    assert sorted(map(tuple, queries.op4_suffix_dedup(spark, SF).collect())) == sorted(brute_bytes(corpus, 100))


def test_levels_merge(spark, corpus):
    from folio.llm import repeats

    docs = repeats.keyed(docs_of(spark, corpus[:80]))
    index = repeats.RepeatIndex(suffix_dedup.spec_of(100), docs)
    many = []
    for above, part in repeats.batches_of(docs, 5):
        index.add(part.select("doc", "text"), above)
        many.append(len(index.levels))
    assert max(many) < 4 and min(many[1:]) == 1


def test_long_text(spark):
    rng = np.random.default_rng(5)
    text = " ".join(f"{x:x}" for x in rng.integers(0, 1 << 30, 400_000))
    docs = [(1, text[1_000_000:1_000_500]), (2, text), (3, text + " end")]
    got = {r.doc_id: r.n_removed for r in suffix_dedup.dedup_bytes(docs_of(spark, docs), 100, 2).collect()}
    assert got == {1: 0, 2: 500, 3: len(text)}
    got = {r.doc_id: r.n_words - r.n_removed for r in substring_dedup.dedup_words(docs_of(spark, docs), 13, 2).collect()}
    assert got[1] == len(docs[0][1].split()) and got[3] == 1


def test_hashes_that_collide(spark):
    """Words of equal hashes are different words."""
    from tokenizers import Tokenizer

    path = queries.word_tokenizer()
    tail = " one two three four five six seven eight nine ten eleven twelve"
    docs = [(1, TWINS[0] + tail), (2, TWINS[1] + tail), (3, TWINS[1] + tail + " " + TWINS[0])]
    got = sorted(map(tuple, substring_dedup.dedup_words(docs_of(spark, docs), 13).collect()))
    assert got == sorted(brute_words(docs, 13)) and got[1][2] == 0 and got[2][2] == 13
    tokenizer = Tokenizer.from_file(path)
    ids = {i: tokenizer.encode(t, add_special_tokens=False).ids + [1] for i, t in docs}
    check_packed(packing.pack(docs_of(spark, docs), path, 64).collect(), ids, 64)


@pytest.mark.parametrize("window, batches", [(13, 1), (13, 4), (4, 2)])
def test_words(spark, corpus, window, batches):
    data = REPEATS + [(100 + i, t) for i, t in corpus]
    got = substring_dedup.dedup_words(docs_of(spark, data), window, batches).collect()
    assert sorted(map(tuple, got)) == sorted(brute_words(data, window))


def test_repeats_odd(spark):
    for run in (suffix_dedup.dedup_bytes, substring_dedup.dedup_words):
        assert run(docs_of(spark, [])).count() == 0
        assert run(docs_of(spark, ODD)).count() == len(ODD)
    kept = {r.doc_id: r.text for r in suffix_dedup.kept_texts(docs_of(spark, [(1, "abcdefghij"), (2, "xabcdefghijy")]), 10).collect()}
    assert kept == {1: "abcdefghij", 2: "xy"}
    kept = {r.doc_id: r.text for r in substring_dedup.kept_texts(docs_of(spark, [(1, "a b c"), (2, "x a b c y")]), 3).collect()}
    assert kept == {1: "a b c", 2: "x y"}


# --- 5 simhash


def brute_simhash(text, n):
    import xxhash

    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, documents, corpus):
    fp = {i: brute_simhash(t, 4) for i, t in corpus}
    parent = {i: i for i in fp}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(fp)
    for i in ids:
        for j in ids[: ids.index(i)]:
            if (fp[i] ^ fp[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_groups(documents, 4, 4).collect()}
    assert got == {i: (fp[i], find(i)) for i in ids}


def test_simhash_odd(spark):
    rows = simhash.near_groups(docs_of(spark, ODD), 4, 4).collect()
    assert len(rows) == len(ODD) and {r.component_id for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert simhash.near_groups(docs_of(spark, []), 4, 4).count() == 0
    assert sorted(r.doc_id for r in simhash.one_of_each(docs_of(spark, [(1, "a b c"), (2, "a b c"), (3, "other words here")])).collect()) == [1, 3]


@pytest.mark.parametrize("budget, leaf", [(4, 64), (4, 1), (2, 4)])
def test_trie(budget, leaf, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF_PAIRS", leaf)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 64, 120, dtype=np.uint64)
    near = base ^ (np.uint64(1) << rng.integers(0, 64, 120, dtype=np.uint64))
    leaves = np.unique(np.concatenate([base, near, near ^ np.uint64(5)]))
    root = simhash.trie_links(leaves, np.array([0]), np.array([len(leaves)]), 0, budget)
    want = np.arange(len(leaves))
    close = np.bitwise_count(leaves[:, None] ^ leaves[None, :]) <= budget
    for _ in range(len(leaves)):
        want = np.where(close, want[None, :], len(leaves)).min(axis=1)
    assert (root == want).all()


def test_trie_of_a_large_group():
    """Thousands of distinct fingerprints within few bits of each other: one component, without all their pairs."""
    rng = np.random.default_rng(2)
    base = np.uint64(0x0123456789ABCDEF)
    bits = rng.integers(0, 40, (60_000, 4), dtype=np.uint64)
    leaves = np.unique(base ^ np.bitwise_or.reduce(np.uint64(1) << bits, axis=1))
    root = simhash.trie_links(leaves, np.array([0]), np.array([len(leaves)]), 0, 4)
    assert len(leaves) > 30_000 and (root == root[0]).mean() > 0.999


@pytest.mark.parametrize("shared", [1, 2, 3, 4])
def test_blocks(spark, shared):
    """However many blocks the leaves share, no link is missed."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 64, 150, dtype=np.uint64)
    near = base.copy()
    for i in range(150):
        for b in rng.choice(64, i % 7, replace=False):
            near[i] ^= np.uint64(1) << np.uint64(b)
    fp = np.unique(np.concatenate([base, near]))
    links = simhash.near_links(spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long"), 4, shared)
    got = {r.node: r.root for r in components.components(links).collect()}
    for x in fp:
        for y in fp[np.bitwise_count(fp ^ x) <= 4]:
            a, b = (int(v.view(np.int64)) for v in (x, y))
            assert got.get(a, a) == got.get(b, b)
    assert simhash.shared_blocks(1000, 4) == 1 and simhash.shared_blocks(1 << 28, 4) == 2 and simhash.shared_blocks(1 << 40, 4) == 4


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 6 quality


def test_quality(spark):
    rows = queries.op6_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_quality_odd(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    docs = docs_of(spark, [*ODD, *[(i, "plain words here." if i % 2 else "LOUD!! $$$ ###") for i in range(20, 60)]])
    assert quality.score_all(docs, labels).count() == len(ODD) + 40
    assert quality.score_all(docs_of(spark, []), labels).count() == 0
    assert {r.score for r in quality.score_all(docs, labels.limit(0)).collect()} == {1.0}
    assert quality.accepted(docs, labels.limit(0)).count() == docs.count()
    assert quality.accepted(docs, labels).columns == docs.columns


def test_prior():
    """Estimated from positives and unlabelled rows alone."""
    rng = np.random.default_rng(1)
    for share in (0.3, 0.7):
        positive = rng.normal(2, 1, (2000, 4))
        unlabelled = np.vstack([rng.normal(2, 1, (int(2000 * share), 4)), rng.normal(-2, 1, (2000 - int(2000 * share), 4))])
        rng.shuffle(unlabelled)
        assert abs(quality.estimate_prior(np.abs(positive), np.abs(unlabelled) * np.sign(unlabelled)) - share) < 0.12


def test_risk():
    """The risk as written out, and its gradient against differences."""
    rng = np.random.default_rng(2)
    p, u, w = rng.normal(1, 1, (50, 3)), rng.normal(0, 1, (80, 3)), rng.normal(size=3)
    loss = lambda z: np.log(1 + np.exp(-z))
    for prior in (0.2, 0.9):
        value, grad = quality.risk(w, p, u, prior)
        negative = loss(-(u @ w)).mean() - prior * loss(-(p @ w)).mean()
        assert value == pytest.approx(prior * loss(p @ w).mean() + max(0, negative))
        of = lambda w, sign=negative >= 0, prior=prior: prior * loss(p @ w).mean() + loss(-(u @ w)).mean() - prior * loss(-(p @ w)).mean() if sign else -(loss(-(u @ w)).mean() - prior * loss(-(p @ w)).mean())
        steps = [(of(w + 1e-6 * e) - of(w - 1e-6 * e)) / 2e-6 for e in np.eye(3)]
        assert grad == pytest.approx(steps, abs=1e-5)


# --- 7 lines


LINE = "this line is a good deal longer than forty characters"


def test_lines(spark):
    texts = [(i, f"own {i}\n {LINE.upper() if i % 2 else LINE} \nshort") for i in range(6)] + [(10, None), (11, "")]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs_of(spark, texts)).collect()}
    assert got[5].text == texts[5][1] and got[0].text == "own 0\nshort" and got[0].n_dropped == 1 and got[10].text == "" and got[10].n_lines == 1
    assert line_dedup.dedup_lines(docs_of(spark, texts[:4])).where("n_dropped > 0").count() == 0
    assert line_dedup.dedup_lines(docs_of(spark, [])).count() == 0
    assert line_dedup.dedup_lines(docs_of(spark, ODD)).count() == len(ODD)
    more = docs_of(spark, texts).withColumns({c: F.lit(7) for c in ("drop", "h", "n", "last", "n_lines")})
    assert {(r.doc_id, r.drop, r.last, r.n_dropped) for r in line_dedup.dedup_lines(more).collect()} == {(r.doc_id, 7, 7, r.n_dropped) for r in got.values()}


def test_lines_reversible(spark):
    index = line_dedup.LineIndex()
    first, second = docs_of(spark, [(i, LINE) for i in range(4)]), docs_of(spark, [(i, f"{LINE}\nx") for i in range(4, 7)])
    index.insert(first.select("doc_id", "text"))
    assert index.drops().count() == 0
    index.insert(second.select("doc_id", "text"))
    assert sorted(r.doc_id for r in index.drops().collect()) == [0, 1, 2, 3, 4, 5]
    index.delete(second.select("doc_id"))
    assert index.drops().count() == 0 and index.postings.count() == 4


def test_lines_by_shards(spark, monkeypatch):
    """Many shards and batches give what one does; rows of one doc_id are one document; ids may come back."""
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 2)
    texts = [(i % 40, "\n".join(f"{LINE} number {j}" for j in range(12) if (i + j) % 3)) for i in range(60)]
    docs = docs_of(spark, texts).select("doc_id", "text")
    whole, parts = line_dedup.LineIndex(), line_dedup.LineIndex()
    whole.insert(docs)
    for low in (0, 15, 30):
        parts.insert(docs.where(F.col("doc_id").between(low, low + (14 if low < 30 else 100))))
    drops = lambda index: {(r.doc_id, h) for r in index.drops().collect() for h in r[1]}
    assert drops(whole) == drops(parts) and whole.shards > 1
    parts.delete(docs.where("doc_id >= 30").select("doc_id"))
    few = line_dedup.LineIndex()
    few.insert(docs.where("doc_id < 30"))
    assert drops(parts) == drops(few)
    parts.insert(docs.where("doc_id >= 30"))
    assert drops(parts) == drops(whole)
    same = docs_of(spark, [(1, LINE)] * 9 + [(2, LINE)])
    assert line_dedup.dedup_lines(same).where("n_dropped > 0").count() == 0


#: Two lines whose 64-bit XXH64 is the same for seeds 42 and 1 alike.
ALIKE = ("]>.c$#$\"abcdefghijklmnopqrstuvwxq}l![tc!abcdefghijklmnopqrstuvwx", "k<q$~=szabcdefghijklmnopqrstuvwx!!!*)!!habcdefghijklmnopqrstuvwx")


@pytest.mark.parametrize("end", ["\u2028", "\u2029", "\u0085", "\x0b", "\r"])
def test_lines_that_end_oddly(spark, end):
    line = "x" * 50 + end
    texts = [(i, line) for i in range(3)] + [(i, line[:50] + " " + end) for i in (3, 4)]
    strip = lambda x: x.strip("\x20\x09\x0a\x0b\x0c\x0d")
    one_key = strip(texts[0][1]) == strip(texts[-1][1])
    assert line_dedup.dedup_lines(docs_of(spark, texts)).where("n_dropped > 0").count() == (4 if one_key else 0)


def test_lines_of_one_hash(spark):
    assert len(set(ALIKE)) == 2
    texts = [(i, ALIKE[0]) for i in range(4)] + [(9, ALIKE[1])]
    assert line_dedup.dedup_lines(docs_of(spark, texts)).where("n_dropped > 0").count() == 0
    texts = [(i, f"{ALIKE[0]}\n{ALIKE[1]}" if i < 2 else ALIKE[0]) for i in range(5)] + [(9, ALIKE[1])]
    got = {r.doc_id: (r.n_dropped, r.text) for r in line_dedup.dedup_lines(docs_of(spark, texts)).collect()}
    assert got == {0: (1, ALIKE[1]), 1: (1, ALIKE[1]), 2: (1, ""), 3: (1, ""), 4: (0, ALIKE[0]), 9: (0, ALIKE[1])}


@pytest.mark.parametrize("copies", [60, 2])
def test_quality_rows_of_one_id(spark, copies):
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 3 != 1][: 1 if copies == 60 else 20]
    docs = docs_of(spark, [(i, f"A plain sentence of words, number {i}, follows another.") for i in ids for _ in range(copies)])
    labels = spark.createDataFrame([(i, 1, 0) for i in ids], "doc_id long, quality int, toxic int")
    for sample in (1, 20):
        assert quality.train(docs, labels, sample) is not None
    assert quality.score_all(docs, labels).count() == len(ids) * copies


def test_cuckoo():
    rng = np.random.default_rng(0)
    keys = rng.integers(-(1 << 63), 1 << 63, 5000)
    f = CuckooFilter.of(keys)
    assert f.contains(keys).all() and f.contains(rng.integers(-(1 << 63), 1 << 63, 100_000)).mean() < 0.001
    f = CuckooFilter.load(f.dump())
    f.delete(keys[:2500])
    assert f.contains(keys[2500:]).all() and f.contains(keys[:2500]).mean() < 0.01


# --- 8 urls


def test_urls(spark):
    rules = spark.createDataFrame(queries.URL_RULES + [("b.org", "/x", "block"), ("a.b.org", "/", "allow"), (None, "/", "block")], "host string, path string, verdict string")
    urls = [
        ("http://Example.COM/en/1?q", "example.com", "/en/1", "example.com/en/", "block"), ("https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("http://example.com", "example.com", "", None, "allow"), ("http://sub.net/es/#x", "sub.net", "/es/", "net/es/", "block"), ("http://notnet/es/", "notnet", "/es/", None, "allow"),
        ("no url", "", "", None, "allow"), (None, "", "", None, "allow"), ("http://b.org/xyz", "b.org", "/xyz", "b.org/x", "block"), ("http://c.a.b.org/xyz", "c.a.b.org", "/xyz", "a.b.org/", "allow"),
        ("x://" + "a." * 300 + "net/es/" + "p/" * 300, "a." * 300 + "net", "/es/" + "p/" * 300, "net/es/", "block"), ("http://sub.net/es/#x", "sub.net", "/es/", "net/es/", "block"),
    ]
    pages = spark.createDataFrame([(i, u[0], "old") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = sorted(map(tuple, url_filter.judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict").collect()))
    assert got == [(i, *u[1:]) for i, u in enumerate(urls)]
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}


# --- 9 embeddings


def brute_vectors(rows, cosine):
    able = [r for r in rows if r[0] is not None and r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    links, parent = {r[0]: 0 for r in rows}, {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(able):
        for b in able[:i]:
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], float), np.array(b[1], float)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= cosine:
                    links[a[0]] += 1
                    links[b[0]] += 1
                    p, q = find(a[0]), find(b[0])
                    parent[max(p, q)] = min(p, q)
    return {k: (links[k], find(k), find(k) == k) for k in links}


@pytest.mark.parametrize("cell", [512, 16])
def test_vectors(spark, cell, monkeypatch):
    monkeypatch.setattr(embedding_dedup.near_links, "__defaults__", (cell,))
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 8))
    vectors = np.vstack([base, base[:30] + rng.normal(size=(30, 8)) * 0.1, base[:20], base[:10] * 3, np.repeat(base[:1], 25, 0)])
    rows = [(int(i), [float(np.float32(x)) for x in v], int(i) % 3) for i, v in enumerate(vectors)]
    rows += [(900, None, 1), (901, [0.0] * 8, 1), (902, [float("nan")] * 8, 1), (903, [1.0, None], 1), (904, rows[0][1], None), (905, [], 1), (906, [1.0, 2.0], 1), (907, [2.0, 4.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(df, 0.98).collect()}
    assert got == brute_vectors(rows, 0.98)


def test_vectors_of_large_groups():
    """Thousands of near vectors, and of multiples of one, in one task of bounded memory."""
    import pyarrow as pa

    rng = np.random.default_rng(6)
    near = rng.normal(size=64) + rng.normal(size=(1500, 64)) * 0.12  # about as far apart as the threshold
    far = rng.normal(size=(500, 64))
    x = np.vstack([near, far]).astype(np.float32).astype(float)
    table = pa.table({"side": np.zeros(len(x), np.int32), "point": np.arange(len(x)), "copies": np.ones(len(x), np.int64), "vector": pa.array(list(x))})
    got = embedding_dedup.link_cells(table, 0.98).to_pandas().set_index("a")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.98).sum(axis=1) - 1
    assert [int(got.links.get(i, 0)) for i in range(len(x))] == links.tolist() and links.max() > 100


def test_vectors_that_no_level_parts(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "LEVELS", 0)
    monkeypatch.setattr(embedding_dedup.near_links, "__defaults__", (16,))
    rng = np.random.default_rng(7)
    base = rng.normal(size=(1, 8))
    rows = [(i, [float(np.float32(v)) for v in (base + rng.normal(size=(1, 8)) * 0.1)[0]], 1) for i in range(60)]
    rows += [(100 + i, [float(np.float32(v) * 2**i) for v in base[0]], 1) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(df, 0.98).collect()} == brute_vectors(rows, 0.98)


def test_vectors_odd(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.near_vectors(df).count() == 0
    df = spark.createDataFrame([(None, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    assert sorted((r.vec_id or 0, r.n_links) for r in embedding_dedup.near_vectors(df).collect()) == [(0, 0), (1, 1), (1, 1)]


# --- further columns, of whatever name


CLASHES = ("doc", "k", "u", "v", "h", "g", "n", "last", "shard", "salt", "filter", "n_lines", "n_dropped", "node", "root", "set", "mark", "fp", "first", "one", "score", "features", "piece", "sequence_id", "next")


def test_clashing_columns(spark):
    """Operators that return other columns ignore further ones, and stages leave them as they are."""
    import corpus_pipeline

    path = queries.word_tokenizer()
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    plain = docs_of(spark, [*ODD, *[(i, f"{LINE}\nplain words {i % 9} here." if i % 2 else "LOUD!! $$$ ###") for i in range(20, 40)]])
    more = plain.withColumns({c: F.lit(7) for c in CLASHES})
    rows = lambda df: sorted(map(repr, df.collect()))
    runs = [
        lambda d: packing.pack(d, path, 64).select("doc_id", "piece", "length", "ids_crc32"), lambda d: suffix_dedup.dedup_bytes(d, 20, 2), lambda d: substring_dedup.dedup_words(d, 4, 2),
        lambda d: simhash.near_groups(d, 4, 4), lambda d: quality.score_all(d, labels), lambda d: fingerprint.with_next(d, ["text"]).select("doc_id", "text", "next.text"),
    ]
    for run in runs:
        assert rows(run(plain)) == rows(run(more))
    for stage in (corpus_pipeline.lines, corpus_pipeline.near, corpus_pipeline.mix):
        a, b = stage(spark, plain, SF), stage(spark, more, SF)
        assert b.columns == more.columns and rows(a) == rows(b.select(a.columns)) and {tuple(r) for r in b.select(*CLASHES).distinct().collect()} == {(7,) * len(CLASHES)}
    assert quality.accepted(more, labels).columns == more.columns
    vectors = [(i, [1.0, float(i % 3)], 1) for i in range(9)]
    plain = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int")
    assert rows(embedding_dedup.near_vectors(plain)) == rows(embedding_dedup.near_vectors(plain.withColumns({c: F.lit(7) for c in ("point", "cell", "vector", "copies", "unit", "a", "b", "links")})))


def test_one_of_each_by_row(spark):
    """Repeated rows leave one; a row that only shares its id with a copy stays; copies without ids count among themselves."""
    texts = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "A b c d e f  g"), (2, "other words that nobody else has"), (None, "no id here at all"), (None, "no id here at all"), (None, "a b c d e f g")]
    got = sorted(((r.doc_id, r.text) for r in simhash.one_of_each(docs_of(spark, texts)).collect()), key=repr)
    assert got == [(1, "a b c d e f g"), (2, "other words that nobody else has"), (None, "no id here at all")]


# --- the pipeline


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in kept.select("doc_id").collect()}
        kept = store.materialize(stage(spark, kept, SF))
        assert kept.columns == docs.columns and {r.doc_id for r in kept.select("doc_id").collect()} <= before, name
    last = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert last.select("doc_id").distinct().count() == kept.select("doc_id").distinct().count()


def brute_groups(texts, words=5):
    """The least index of each text's component of Jaccard links of 0.8 or more."""
    parts = [t.lower().split() for t in texts]
    sets = [{tuple(p[i : i + words]) for i in range(max(1, len(p) - words + 1))} for p in parts]
    root = list(range(len(sets)))

    def up(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                a, b = sorted((up(i), up(j)))
                root[b] = a
    return [up(i) for i in range(len(sets))]


def test_near_dedup_of_pipeline(spark, corpus):
    import corpus_pipeline

    rng = np.random.default_rng(3)
    texts = [t for _, t in corpus if t.strip()][:200]
    for _ in range(300):  # pairs on both sides of 0.8, a few of them exactly there
        words = [f"w{x}" for x in rng.integers(0, 5000, rng.integers(6, 150))]
        other, n = list(words), len(words)
        for at in rng.choice(n, min(n, int(rng.integers(1, max(2, n // 20)))), replace=False):
            other[at] = "changed"
        texts += [" ".join(words), " ".join(other)]
        cut = int(n * rng.uniform(0.7, 1))
        texts.append(" ".join(words[:cut]))
    common = " ".join(f"c{x}" for x in range(40))
    texts += [f"{common} " + " ".join(f"u{i}-{j}" for j in range(60)) for i in range(50)]
    many = [f"m{x}" for x in range(100)]  # a group of more than any number of pivots
    for i in range(60):
        texts.append(" ".join(many[:i] + [f"x{i}"] + many[i + 1 :]))
    docs = docs_of(spark, list(enumerate(texts)))
    kept = {r.doc_id for r in corpus_pipeline.near(spark, docs, SF).collect()}
    root = brute_groups(texts)
    assert kept == {i for i, r in enumerate(root) if i == r}


def test_near_dedup_compares_words(spark):
    """Texts whose hashes are equal, and short, null, repeated and shuffled ones."""
    import xxhash

    one, two = ALIKE
    assert xxhash.xxh64(one.encode(), seed=42).digest() == xxhash.xxh64(two.encode(), seed=42).digest()
    texts = [one, two, f"{one} b c d e", f"{two} b c d e", None, "", " \t", "A b", "a  B", "a b a b a b a b", "b a b a b a b a", "a b a b a", "x y z", one.upper()]
    kept = {r.doc_id for r in corpus_near(spark, list(enumerate(texts)))}
    root = brute_groups([t or "" for t in texts])
    assert kept == {i for i, r in enumerate(root) if i == r}
    assert 1 in kept and 3 in kept
    assert corpus_near(spark, []) == []


def corpus_near(spark, rows):
    import corpus_pipeline

    return corpus_pipeline.near(spark, docs_of(spark, rows), SF).collect()


def test_likeness_by_words():
    from folio.llm import shingles

    rng = np.random.default_rng(8)
    for _ in range(400):
        one = [f"w{x}" for x in rng.integers(0, 4, rng.integers(0, 30))]
        two = list(one)
        for at in rng.integers(0, max(1, len(one)), rng.integers(0, 2)):
            two[at : at + 1] = [f"w{x}" for x in rng.integers(0, 4, rng.integers(0, 3))]
        a, b = (" ".join(x) for x in (one, two))
        sets = [{" ".join(x[i : i + 5]) for i in range(max(1, len(x) - 4))} for x in (one, two)]
        assert shingles.likely(a.encode(), b.encode(), 5) == (9 * len(sets[0] & sets[1]) >= 4 * (len(sets[0]) + len(sets[1])))


def test_oracles(spark):
    import duckdb

    c = duckdb.connect()
    for n in ("documents", "pages", "embeddings"):
        c.execute(f"CREATE VIEW {n} AS SELECT * FROM '{SF}/{n}.parquet'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, SF)
        cursor = c.execute(sql)
        names = [d[0] for d in cursor.description]
        assert sorted(map(repr, df.select(names).toPandas().itertuples(index=False, name=None))) == sorted(map(repr, cursor.fetchall()))


def test_near_dedup_asks_the_fingerprints_first(spark, monkeypatch):
    """The trie join's pairs are compared before any others, and joined texts not again; links beyond its budget are found as well."""
    from folio.llm import shingles

    rng = random.Random(12)
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    texts = []
    for _ in range(12):
        base = words(120)
        texts += [" ".join(base), " ".join(base + words(1)), " ".join(base[:60] + words(2) + base[60:])]
    texts += ["", None, "a b", *(" ".join(words(80)) for _ in range(20))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = []
    pairs = simhash.near_pairs
    monkeypatch.setattr(simhash, "near_pairs", lambda nodes, budget: asked.append(pairs(nodes, budget)) or asked[-1])
    kept = {r.doc_id for r in simhash.one_of_each(docs).collect()}
    assert len(asked) == 1 and asked[0].count() >= 6
    alone = {r.doc_id for r in shingles.near_groups(docs, 5).groupBy("root").agg(F.min("doc_id").alias("doc_id")).collect()}
    assert kept == alone
    fps = {r.doc_id: r.fp for r in simhash.fingerprints(docs, 5).collect()}
    known = {r.doc_id: r.fp for r in shingles.leads(shingles._marked(docs), 5).collect()}
    assert fps == known


def test_near_dedup_leaves_texts_where_they_lie(spark, monkeypatch):
    """Texts that are compared are picked where all texts are stored, bucketed; no round sends all of them through a shuffle."""
    from folio.llm import shingles

    plans, write = [], shingles.materialize

    def materialize(df, *a, path=None, **b):
        if "shingles-texts" in (path or ""):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, *a, path=path, **b)

    monkeypatch.setattr(shingles, "materialize", materialize)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = " ".join(f"w{i}" for i in range(60))
        docs = spark.createDataFrame([(1, text), (2, text + " more"), (None, text + " other"), (None, "a b"), (4, None)], "doc_id long, text string")
        roots = [r.root for r in shingles.near_groups(docs, 5).orderBy(F.length("mark"), "doc_id").collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(map(roots.count, roots)) == [1, 1, 3, 3, 3]
    assert plans and all("Bucketed: true" in p for p in plans)
    tables = [t.name for t in spark.catalog.listTables() if t.name.startswith("shingles_stored")]
    assert not tables
