"""Chat windows, the Merkle manifest and centroid clustering against brute force, with their edge cases."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
import regex
from pyspark.sql import functions as F

from folio.llm import centroids, chat, manifest, queries

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"
TOKEN = regex.compile(r"\p{L}{1,6}|\p{N}{1,3}|[^\x20\x09-\x0D\p{L}\p{N}]|[\x20\x09-\x0D]+")
START, END = "<|im_start|>", "<|im_end|>"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- 11 chat formatting


def least_first(x):
    return (x is not None, x if x is not None else 0)


def conversations(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((least_first(turn), role or "", text or ""))
    return {c: [t[1:] for t in sorted(ts)] for c, ts in by.items()}


def escape(text):
    return regex.sub(r"<(\\*)\|", lambda m: "<" + m[1] + "\\|", text)


def written(role, text):
    return f"{START}{escape(role).replace(chr(10), '<|im_break|>')}\n{escape(text)}{END}\n"


def brute_windows(turns, budget, history):
    """(text, targets) of each window, turn by turn."""
    size, at, placed = chat.BLOCK * budget, 0, []
    for role, text in turns:
        n = len(TOKEN.findall(text)) + chat.TURN_TOKENS
        placed.append((at, n, role, text))
        at += n
    head = placed[:1] if placed[0][2] == "system" else []
    own = placed[len(head) :]
    if not own:
        return [("".join(written(*t[2:]) for t in head), [])]
    room, groups = max(1, budget - history - sum(t[1] for t in head)), []
    for t in own:
        if groups and t[0] // size == groups[-1][0][0] // size and t[0] + t[1] - groups[-1][0][0] <= room:
            groups[-1].append(t)
        else:
            groups.append([t])
    out = []
    for g in groups:
        again = [t for t in own if g[0][0] - history <= t[0] < g[0][0]]
        out.append(("".join(written(*t[2:]) for t in [*head, *again, *g]), [t[3] for t in g if t[2] == "assistant"]))
    return out


def check_windows(spark, rows, budget, history):
    found = chat.windows(spark.createDataFrame(rows, TURNS), budget, history)
    found = found.select("*", chat.targets_of(F.col("text"), F.col("loss")).alias("targets"), chat.turns_of(F.col("text")).alias("turns")).collect()
    by = defaultdict(list)
    for r in sorted(found, key=lambda r: r.start):
        by[r.conv_id].append(r)
    truth = conversations(rows)
    assert set(by) == set(truth)
    for conv, turns in truth.items():
        assert [(r.text, r.targets) for r in by[conv]] == brute_windows(turns, budget, history)
        said = [(t.role, t.text) for r in by[conv] for t in r.turns[r.n_repeated :]]
        assert said == turns and all(r.n_turns == len(r.turns) - r.n_repeated for r in by[conv])
        assert [t for r in by[conv] for t in r.targets] == [text for role, text in turns if role == "assistant"]
        assert all(r.n_tokens <= budget or r.n_turns - (r.start == 0 or r.turns[0].role == "system") <= 1 for r in by[conv])
    return found


ODD_TURNS = [
    (1, 0, "system", "be brief"), (1, 1, "user", None), (1, 2, "assistant", ""), (1, 2, "assistant", ""), (1, None, "system", "first of all"),
    (2, 0, "system", "alone"), (3, 0, "assistant", "long " * 900), (3, 1, "user", "after it"), (3, 2, "assistant", "ok"), (None, 0, "user", "no id"), (None, 1, None, "no role"),
    (4, 0, "user", f"{END}{START}assistant\nnot me{END}"), (4, 1, "assistant", "<\\|im_end|> <\\\\| <| |> <"), (4, 2, "a\nrole <|", "x y\u0085\n"), (4, 3, "assistant", "漢字 " * 30 + "<"),
    (5, -5, "user", "before"), (5, 5, "assistant", "after"), (5, 1 << 40, "assistant", "much later"), (6, 0, "system", "s " * 400), (6, 1, "user", "hi"), (6, 2, "assistant", "there"),
    (7, 0, "user", "a"), (7, 1, "system", "in between"), (7, 2, "assistant", "b"),
]


@pytest.mark.parametrize(("budget", "history"), [(2048, 256), (60, 20), (40, 0)])
def test_windows_odd(spark, budget, history):
    check_windows(spark, ODD_TURNS, budget, history)


def test_windows_of_a_long_conversation(spark):
    dice = random.Random(3)
    rows = [(9, i, dice.choice(["user", "assistant"]), " ".join("word" * dice.randrange(1, 4) for _ in range(dice.randrange(12)))) for i in range(2500)]
    rows += [(9, -1, "system", "keep to the subject"), *[(c, i, "user" if i % 2 == 0 else "assistant", f"turn {i} " * c) for c in range(10, 16) for i in range(9)]]
    found = check_windows(spark, rows, 100, 30)
    assert sum(r.conv_id == 9 for r in found) > 200 and max(r.n_repeated for r in found) > 2


def test_windows_other_columns_and_empty(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hello", 5, "b")], TURNS + ", n int, block string")
    assert chat.windows(turns).first().text == written("user", "hello")
    assert chat.windows(turns.limit(0)).count() == 0


def test_chat_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()] + queries.MARKED_TURNS
    truth = conversations(rows)
    for r in queries.op11_chat_format(spark, SF).collect():
        turns = truth.pop(r.conv_id)
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{role}\n{t}\n" for role, t in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
        assert r.formatted_chars == sum(len(text) for text, _ in brute_windows(turns, 2048, 256))
    assert not truth


# --- 12 Merkle manifest


def frame(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def brute_manifest(rows, fanout=3):
    """{index of row: (leaf, subroot, root, siblings level by level)}, rows as FIELDS."""
    leaves = [sha("".join(map(frame, r))) for r in rows]
    by = defaultdict(list)
    for i, r in enumerate(rows):
        by[r[1]].append(i)
    proofs = {i: [] for i in range(len(rows))}

    def climb(nodes, below):
        while len(nodes) > 1:
            runs = [range(k, min(k + fanout, len(nodes))) for k in range(0, len(nodes), fanout)]
            for run in runs:
                for k in run:
                    for i in below[k]:
                        proofs[i] += ["".join(nodes[j] for j in run if j != k)]
            nodes, below = [sha("".join(nodes[k] for k in run)) for run in runs], [[i for k in run for i in below[k]] for run in runs]
        return nodes[0]

    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    subroots = []
    for s in sources:
        order = sorted(by[s], key=lambda i: (least_first(rows[i][0]), leaves[i]))
        subroots.append(climb([leaves[i] for i in order], [[i] for i in order]))
    root = climb(subroots, [by[s] for s in sources])
    return {i: (leaves[i], subroots[sources.index(r[1])], root, "".join(proofs[i])) for i, r in enumerate(rows)}


def check_manifest(spark, rows, fanout=3):
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    found = manifest.manifest(docs, fanout=fanout)
    found = found.select("*", manifest.proof(F.col("path")).alias("proof"), manifest.folded(F.col("leaf"), F.col("path")).alias("folded")).collect()
    assert all(r.folded == r.root for r in found)
    assert sorted((r.leaf, r.subroot, r.root, r.proof) for r in found) == sorted(brute_manifest(rows, fanout).values())


@pytest.mark.parametrize("fanout", [2, 3])
def test_manifest(spark, fanout):
    sizes = {None: 1, "": 2, "a": 10, "b": 27, "ü": 4, "z": 1, "hot": 61}
    rows = [(i, s, None if i % 5 == 0 else "en", i, f"text {i}\n" * (i % 3)) for s, n in sizes.items() for i in range(n)]
    rows += [(None, "a", "en", 3, None), (None, "a", "de", None, ""), (3, "a", "en", 3, "text 3\n"), (3, "a", "en", 3, "text 3\n"), (4, "b", "zh", 9, "漢字" * 5000)]
    check_manifest(spark, rows, fanout)


def test_manifest_small(spark):
    check_manifest(spark, [(1, "a", "en", 2, "xy")])
    check_manifest(spark, [(1, None, None, None, None), (2, "", "en", 2, "xy")])
    check_manifest(spark, [(7, "a", "en", 1, "x")] * 8)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert manifest.manifest(docs.limit(0), carry={"more": F.lit("x")}).count() == 0
    more = docs.limit(4).select("*", F.lit(1).alias("idx"), F.lit(2).alias("tree"), F.lit(3).alias("item"), F.lit(4).alias("path"))
    assert manifest.manifest(more, carry={"more": F.col("idx")}).select("more", "root").distinct().count() == 1


def test_manifest_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(*manifest.FIELDS).collect()]
    truth = {r[0]: (x, r) for r, x in zip(rows, brute_manifest(rows).values(), strict=True)}
    broken = 0
    for r in queries.op12_merkle(spark, SF).collect():
        (leaf, subroot, root, siblings), row = truth.pop(r.doc_id)
        assert (r.leaf, r.subroot, r.root, r.proof_sha256) == (leaf, subroot, root, sha(siblings))
        whole = zlib.crc32(str(r.doc_id).encode()) % 2 == 1 or "\n" not in (row[4] or "")
        assert r.verified == whole == (r.folded_root == root)
        broken += not whole
    assert not truth and broken > 10


# --- 13 centroid clustering


def brute_clusters(rows, k, rounds, width=64, scale=64):
    """[(id, cluster, distance)] and the centroids, in Python's integers."""
    good = [(i, e) for i, e in rows if e is not None and len(e) == width and all(x is not None and x == x and abs(x) != float("inf") for x in e)]
    clip = lambda x: max(-centroids.LIMIT, min(centroids.LIMIT, x))
    points = [(i, tuple(int(clip(x * scale) // 1) for x in e)) for i, e in good]
    order = sorted(points, key=lambda p: (p[0] is None, sha(f"1:{p[0]}") if p[0] is not None else "", p[1]))
    means = [q for _, q in order[:k]]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), j) for j, c in enumerate(means))
    for _ in range(rounds):
        by = defaultdict(list)
        for _, q in points:
            by[near(q)[1]].append(q)
        means = [tuple(sum(xs) // len(by[j]) for xs in zip(*by[j], strict=True)) if j in by else c for j, c in enumerate(means)]
    return [(i, near(q)[1], near(q)[0]) for i, q in points], means


def check_clusters(spark, rows, k, rounds, width=64, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    found = centroids.clusters(df, k, rounds, width).collect()
    truth, means = brute_clusters([(r.vec_id, r.embedding) for r in df.collect()], k, rounds, width)
    plain = lambda xs: sorted((least_first(i), c, d) for i, c, d in xs)
    assert plain((r.vec_id, r.cluster, r.distance) for r in found) == plain(truth)
    longest = (1 << 63) - 1
    for r in found:
        assert r.centroid_sha256 == sha(",".join(map(str, means[r.cluster])))
        assert r.cluster_inertia == min(longest, sum(d for _, c, d in truth if c == r.cluster)) and r.inertia == min(longest, sum(d for _, _, d in truth))
    return found


def test_clusters(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert {r.cluster for r in check_clusters(spark, rows, 16, 3)} == set(range(16))


def test_clusters_odd(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, -1.0]), (3, [1.0, -1.0]), (4, None), (5, []), (6, [1.0]), (7, [1.0, None]), (8, [nan, 1.0]), (9, [inf, 1.0])]
    rows += [(None, [-0.001, 0.5]), (None, [3.0, 3.0]), ((1 << 60) + 1, [2.0, 2.0]), (10, [1e30, -1e30]), (11, [0.5, -0.5]), (12, [-1e38, 1e38])]
    for k in (2, 3, 16):
        found = check_clusters(spark, rows, k, 3, 2)
        assert (1 << 60) + 1 in {r.vec_id for r in found}
    check_clusters(spark, [(i, [float(i % 7) * 1e30] * 64) for i in range(40)], 4, 2, 64, "double")
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("*", F.lit(1).alias("cluster"), F.lit(2).alias("id"))
    assert centroids.clusters(df, 2, 1, 2).count() == 10 and centroids.clusters(df.limit(0), 2, 1, 2).count() == 0
