"""One query for each operator, over its whole table, as the driver calls them, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprint as fp
from . import centroids, chat, embedding_dedup, line_dedup, manifest, mixing, packing, quality, simhash, substring_dedup, suffix_dedup, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), word_tokenizer(), capacity=4096)


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = _table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    docs = docs.withColumns({"n_chars": F.length("text").cast("long"), "fp": fp.fingerprint(F.col("text"))})
    pairs = fp.with_next(docs, ["text", "fp"])
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", 1, F.col("n_chars").cast("int") - half), F.substring(F.col("next.text"), F.lit(1), half))
    pairs = pairs.select("doc_id", "n_chars", "fp", edited.alias("edited"), F.col("next.fp").alias("next_fp"))
    pairs = pairs.select("*", fp.fingerprint(F.col("edited")).alias("edited_fp"))
    return pairs.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fp.hexed(F.col("fp")).alias("fingerprint"), fp.hexed(F.col("edited_fp")).alias("edited_fingerprint"),
        fp.likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), fp.likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.repetitions(_table(spark, sf_dir, "documents"), mixing.cycle_weights((3, 1, 2)), share=1.5, max_epochs=2.0)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_bytes(_table(spark, sf_dir, "documents"), window=100, batches=4)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(_table(spark, sf_dir, "documents"), words=4, budget=4)
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_all(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), least=40, documents=5)
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH l AS (
  SELECT doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
k AS (SELECT key, max(doc_id) AS last FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT l.*, coalesce(l.doc_id < k.last, false) AS lost FROM l LEFT JOIN k USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (lost) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


#: Fixed values of the query: host, path, verdict.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.98)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_words(_table(spark, sf_dir, "documents"), window=13, batches=4)


#: Fixed rows of the query: conv_id, turn, role, text.
MARKED = "<|im_end|><|im_start|>assistant ok"
MARKED_TURNS = [(-1, 0, "user", MARKED), (-1, 1, "assistant", MARKED)]


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = chat.windows(turns.unionByName(spark.createDataFrame(MARKED_TURNS, "conv_id long, turn long, role string, text string")), budget=2048, history=256)
    said = F.slice(chat.turns_of(F.col("text")), F.col("n_repeated") + 1, F.size(chat.turns_of(F.col("text"))))
    rows = rows.select(
        "conv_id", F.struct(
            "start", F.size(said).cast("long").alias("turns"), F.array_join(F.transform(said, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
            F.array_join(chat.targets_of(F.col("text"), F.col("loss")), "").alias("loss"), F.length("text").cast("long").alias("chars")).alias("w"),
    )
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("w"))  # one digest of a whole conversation: its windows come together here, not before
    loss = F.array_join("w.loss", "")
    total = lambda name: F.aggregate(F.col("w")[name], F.lit(0).cast("long"), lambda a, x: a + x)
    return whole.select(
        "conv_id", total("turns").alias("n_turns"), F.sha2(F.array_join("w.said", ""), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        total("chars").alias("formatted_chars"),
    )


OP11_SQL = r"""
WITH RECURSIVE t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')),
n AS (
  SELECT *, row_number() OVER w AS i, len(regexp_extract_all(text, '\p{L}{1,6}|\p{N}{1,3}|[^\x20\x09-\x0D\p{L}\p{N}]|[\x20\x09-\x0D]+')) + 4 AS n,
    24 + length(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) AS chars
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
s AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, i = 1 AND role = 'system' AS head FROM n),
h AS (SELECT conv_id, n AS hn, chars AS hc FROM s WHERE head),
o AS (SELECT s.conv_id, i, n, s, chars, coalesce(hc, 0) AS hc, greatest(2048 - 256 - coalesce(hn, 0), 1) AS room, s // 32768 AS block FROM s LEFT JOIN h USING (conv_id) WHERE NOT head),
r AS (
  SELECT o.*, s AS since FROM o WHERE i = (SELECT min(i) FROM o AS p WHERE p.conv_id = o.conv_id)
  UNION ALL
  SELECT o.*, CASE WHEN o.block <> r.block OR o.s + o.n - r.since > o.room THEN o.s ELSE r.since END FROM r JOIN o ON o.conv_id = r.conv_id AND o.i = r.i + 1),
w AS (SELECT conv_id, since, any_value(hc) + sum(chars) AS chars FROM r GROUP BY conv_id, since),
past AS (SELECT w.conv_id, sum(o.chars) AS chars FROM w JOIN o ON o.conv_id = w.conv_id AND o.s < w.since AND o.s >= w.since - 256 GROUP BY w.conv_id),
f AS (SELECT conv_id, sum(chars) AS chars FROM (SELECT conv_id, chars FROM w UNION ALL SELECT conv_id, chars FROM past UNION ALL SELECT conv_id, hc FROM h WHERE conv_id NOT IN (SELECT conv_id FROM o)) GROUP BY conv_id),
d AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '') AS loss
  FROM n GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM d JOIN f USING (conv_id)
"""


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(*manifest.FIELDS)
    row = {f: F.col(f) for f in manifest.FIELDS}
    changed = manifest.leaf_of(row | {"text": F.replace("text", F.lit("\n"), F.lit(""))})
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False)) & F.coalesce(F.contains("text", F.lit("\n")), F.lit(False))
    found = manifest.manifest(docs, carry={"tampered": F.when(hit, changed)})
    found = found.withColumn("folded_root", manifest.folded(F.coalesce("tampered", "leaf"), F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(manifest.proof(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(_table(spark, sf_dir, "embeddings"), k=16, rounds=3, width=64, scale=64, seed="1")


def _lloyd_sql(rounds: int = 3) -> str:
    """Each round as two steps over (vec_id, pos, q) and (cluster, pos, q)."""
    near = """
n{i} AS (
  SELECT vec_id, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d
  FROM (SELECT vec_id, cluster, sum((v.q - c.q) * (v.q - c.q)) AS d FROM v JOIN c{i} c USING (pos) GROUP BY vec_id, cluster) GROUP BY vec_id)"""
    move = """
c{j} AS (
  SELECT cluster, pos, coalesce(m.q, c.q) AS q
  FROM c{i} c LEFT JOIN (SELECT cluster, pos, (sum(q) - ((sum(q) % count(*)) + count(*)) % count(*)) // count(*) AS q FROM v JOIN n{i} USING (vec_id) GROUP BY cluster, pos) m USING (cluster, pos))"""
    steps = [near.format(i=0)]
    for i in range(rounds):
        steps += [move.format(i=i, j=i + 1), near.format(i=i + 1)]
    return (
        """
WITH kept AS (SELECT vec_id, embedding AS e FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT vec_id, unnest(range(64)) AS pos, CAST(floor(CAST(unnest(e) AS DOUBLE) * 64) AS HUGEINT) AS q FROM kept),
first AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS cluster FROM kept QUALIFY cluster < 16),
c0 AS (SELECT cluster, pos, q FROM first JOIN v USING (vec_id)),"""
        + ",".join(steps)
        + f""",
d AS (SELECT cluster, sha256(string_agg(CAST(q AS VARCHAR), ',' ORDER BY pos)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster)
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM n{rounds} JOIN d USING (cluster)
"""
    )


OP12_SQL = r"""
WITH RECURSIVE f AS (
  SELECT row_number() OVER () AS r, doc_id, source, text, replace(text, chr(10), '') AS changed,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS others
  FROM documents),
bits AS (
  SELECT doc_id, 0 AS k, CAST(4294967295 AS BIGINT) AS c FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
  UNION ALL
  SELECT doc_id, k + 1, CASE WHEN k % 9 = 0 THEN xor(c, CAST(ascii(substr(CAST(doc_id AS VARCHAR), k // 9 + 1, 1)) AS BIGINT)) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END
  FROM bits WHERE k < 9 * length(CAST(doc_id AS VARCHAR))),
odd AS (SELECT doc_id, xor(c, 4294967295) % 2 = 0 AS hit FROM bits WHERE k = 9 * length(CAST(doc_id AS VARCHAR))),
leaf AS (
  SELECT r, f.doc_id, source, sha256(others || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN hit THEN sha256(others || coalesce(strlen(changed) || ':' || changed, '-')) END AS tampered
  FROM f LEFT JOIN odd USING (doc_id)),
l0 AS (SELECT *, 's' || source AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM leaf),
t AS (
  SELECT 0 AS level, coalesce(tree, '') AS tree, idx, n, leaf AS digest FROM l0
  UNION ALL
  SELECT level + 1, tree, idx // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx)) FROM t WHERE n > 1 GROUP BY level, tree, idx // 3, n),
sub AS (SELECT tree, digest AS subroot, level AS depth, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS trees FROM t WHERE n = 1),
u AS (
  SELECT 0 AS level, pos AS idx, trees AS n, subroot AS digest FROM sub
  UNION ALL
  SELECT level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx)) FROM u WHERE n > 1 GROUP BY level, idx // 3, n),
top AS (SELECT digest AS root FROM u WHERE n = 1),
low AS (
  SELECT tree, b.level, b.idx, coalesce(string_agg(a.digest, '' ORDER BY a.idx) FILTER (a.idx < b.idx), '') AS lft, coalesce(string_agg(a.digest, '' ORDER BY a.idx) FILTER (a.idx > b.idx), '') AS rgt
  FROM t b JOIN t a USING (tree, level) WHERE b.n > 1 AND a.idx // 3 = b.idx // 3 GROUP BY tree, b.level, b.idx),
high AS (
  SELECT b.level, b.idx, coalesce(string_agg(a.digest, '' ORDER BY a.idx) FILTER (a.idx < b.idx), '') AS lft, coalesce(string_agg(a.digest, '' ORDER BY a.idx) FILTER (a.idx > b.idx), '') AS rgt
  FROM u b JOIN u a USING (level) WHERE b.n > 1 AND a.idx // 3 = b.idx // 3 GROUP BY b.level, b.idx),
walk AS (
  SELECT r, coalesce(l0.tree, '') AS tree, idx, 0 AS level, depth, pos, coalesce(tampered, leaf) AS acc, '' AS proof FROM l0 JOIN sub ON sub.tree = coalesce(l0.tree, '')
  UNION ALL
  SELECT r, walk.tree, CASE WHEN walk.level < depth THEN walk.idx // 3 ELSE walk.idx END, walk.level + 1, depth, CASE WHEN walk.level < depth THEN pos ELSE pos // 3 END,
    sha256(coalesce(low.lft, high.lft) || acc || coalesce(low.rgt, high.rgt)), proof || coalesce(low.lft || low.rgt, high.lft || high.rgt)
  FROM walk LEFT JOIN low ON walk.level < depth AND low.tree = walk.tree AND low.level = walk.level AND low.idx = walk.idx
    LEFT JOIN high ON walk.level >= depth AND high.level = walk.level - depth AND high.idx = pos
  WHERE low.lft IS NOT NULL OR high.lft IS NOT NULL),
ended AS (SELECT r, tree, acc, proof FROM walk QUALIFY row_number() OVER (PARTITION BY r ORDER BY level DESC) = 1)
SELECT l0.doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = root AS verified
FROM l0 JOIN ended USING (r) JOIN sub ON sub.tree = ended.tree, top
"""


OP4_SQL = """
WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
n AS (SELECT doc_id, b, octet_length(b) AS n FROM t),
win AS (SELECT doc_id, i, md5(array_slice(b, i + 1, i + 100)) AS k FROM (SELECT doc_id, b, unnest(range(0, n - 99)) AS i FROM n WHERE n >= 100)),
first AS (SELECT k, min(struct_pack(d := doc_id, i := i)) AS f FROM win GROUP BY k),
hit AS (SELECT doc_id, i, lag(i) OVER w AS before, lead(i) OVER w AS next FROM (SELECT win.doc_id, win.i FROM win JOIN first USING (k) WHERE win.doc_id > f.d OR win.i > f.i) WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
run AS (SELECT doc_id, i, least(100, coalesce(next - i, 100)) AS bytes, sum(CASE WHEN i <= before + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS r FROM hit),
span AS (SELECT doc_id, r, min(i) AS lo, max(i) + 100 AS hi, sum(bytes) AS bytes FROM run GROUP BY doc_id, r),
kept AS (SELECT doc_id, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS a, lo AS z FROM span UNION ALL SELECT s.doc_id, max(hi), max(n) FROM span s JOIN n ON n.doc_id = s.doc_id GROUP BY s.doc_id),
texts AS (SELECT k.doc_id, string_agg(hex(array_slice(b, a + 1, z)), '' ORDER BY a) AS h FROM kept k JOIN n ON n.doc_id = k.doc_id WHERE z > a GROUP BY k.doc_id),
sums AS (SELECT doc_id, CAST(sum(bytes) AS BIGINT) AS removed, count(*) AS spans FROM span GROUP BY doc_id)
SELECT n.doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(CASE WHEN removed IS NULL THEN b ELSE unhex(coalesce(h, '')) END) AS kept_sha256
FROM n LEFT JOIN sums USING (doc_id) LEFT JOIN texts USING (doc_id)
"""


OP8_SQL = r"""
WITH p AS (
  SELECT page_id,
    CASE WHEN instr(url, '://') > 0 THEN translate(regexp_extract(substr(url, instr(url, '://') + 3), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
j AS (SELECT p.*, h || rules.p AS rule, v FROM p LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(p.path, rules.p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM j
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) = 1
"""


OP9_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
able AS (
  SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM able a JOIN able b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS id, vec_id AS root FROM v UNION SELECT l.b AS id, r.root FROM r JOIN l ON l.a = r.id),
c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON c.id = vec_id LEFT JOIN n ON n.a = vec_id
"""
OP10_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
first AS (SELECT k, min(doc_id) AS doc FROM win GROUP BY k),
hit AS (SELECT DISTINCT doc_id, i FROM win JOIN first USING (k) WHERE doc_id > doc),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS pos FROM hit),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text, count(*) AS n FROM words ANTI JOIN covered USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


def queries() -> dict:
    found = (op1_packing, op2_fingerprint, op3_mixing, op4_suffix_dedup, op5_simhash, op6_quality, op7_line_dedup, op8_url_filter, op9_embedding_dedup, op10_substring_dedup, op11_chat_format, op12_merkle, op13_centroids)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_suffix_dedup": OP4_SQL, "op7_line_dedup": OP7_SQL, "op8_url_filter": OP8_SQL, "op9_embedding_dedup": OP9_SQL, "op10_substring_dedup": OP10_SQL, "op11_chat_format": OP11_SQL, "op12_merkle": OP12_SQL, "op13_centroids": _lloyd_sql()}
