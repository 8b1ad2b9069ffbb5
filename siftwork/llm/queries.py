"""Registered queries of this package and the SQL they are checked against."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.llm import ann, chat, classlm, decontam, mainblocks, merkle, neardup, overlap, pieces, quality, secrets, toxicity, trie
from siftwork.llm.tables import fold_of, read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def quality_scores(docs: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """``docs`` with score: the quality model of the given tables, learned outside the held-out fold."""
    weights = quality.fit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), "quality", fold_of("doc_id", 5) != 0)
    return quality.score(docs, weights)


@query
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_scores(read(spark, sf_dir, "documents").select("doc_id", "text"), spark, sf_dir)
    return scored.select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLES["op1_benchmark_decontamination"] = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
bl AS (SELECT item_id, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, w[i:i + n - 1] AS win FROM (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM bl)),
dw AS (SELECT r, n, i, w[i:i + n - 1] AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bl) l WHERE len(w) >= n)),
h AS (SELECT r, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
p AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS k FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN t USING (r)"""


@query
def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.classes(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "class_size", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False)).alias("is_representative"))


@query
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["kind"].isin([r.kind for r in secrets.BASE_RULES]))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(r.kind) for r in secrets.BASE_RULES], F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("secrets")).alias("spans"))


@query
def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.encode_column(read(spark, sf_dir, "documents").select("doc_id", "text"), check="round_trip")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "round_trip")


@query
def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = classlm.score(docs, fold_of("doc_id", 10) != 0)
    return scored.withColumn("held_out", fold_of("doc_id", 10) == 0).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    index = toxicity.fit(docs, read(spark, sf_dir, "labels"), "toxic", fold_of("doc_id", 3) != 1)
    return toxicity.score(docs, index).select("doc_id", (fold_of("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("evidence").alias("voters"))


@query
def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query
def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat.perspectives(read(spark, sf_dir, "conversations"))
    mask = F.concat_ws(",", F.transform("mask", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))))
    return found.select("conv_id", "speaker", "part", "text", mask.alias("mask"), "n_messages", "n_learned")


ORACLES["op9_chat_formatting"] = r"""
WITH m AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '<\|') AS text FROM conversations),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM m WHERE role <> 'system'),
h AS (SELECT m.conv_id, speaker, CAST(floor(turn / 64) AS BIGINT) AS part, turn, role, text, role = speaker AS own,
  '<|im_start|>' || CASE WHEN role = speaker THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user name=' || regexp_replace(role, '[^\p{L}\p{N}_-]+', '_', 'g') END || chr(10) AS head
  FROM m JOIN s ON m.conv_id IS NOT DISTINCT FROM s.conv_id),
r AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS shown FROM h),
p AS (SELECT *, sum(length(shown)) OVER (PARTITION BY conv_id, speaker, part ORDER BY turn NULLS LAST, role, text ROWS UNBOUNDED PRECEDING) AS upto FROM r)
SELECT conv_id, speaker, part, string_agg(shown, '' ORDER BY turn NULLS LAST, role, text) AS text,
  coalesce(string_agg(CAST(CAST(upto - length(shown) + length(head) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(upto - 1 AS BIGINT) AS VARCHAR), ',' ORDER BY upto) FILTER (WHERE own), '') AS mask,
  count(*) AS n_messages, count(*) FILTER (WHERE own) AS n_learned
FROM p GROUP BY conv_id, speaker, part"""


@query
def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    found = mainblocks.extract(pages.select("page_id", "url", "html"), mainblocks.fit(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))
    found = merkle.manifest(docs, changed)
    proof = F.sha2(F.concat_ws("", F.transform("proof", lambda s: F.concat(s["left"], s["right"]))), 256)
    return found.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def crc32_sql(column: str) -> str:
    """Unsigned crc32 of a number's decimal form, bit by bit."""
    step = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    return f"xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST({column} AS VARCHAR), ''), lambda s: ascii(s)::BIGINT), lambda c, b: {step}), 4294967295)"


_PART = "coalesce(octet_length(encode(CAST({0} AS VARCHAR))) || ':' || CAST({0} AS VARCHAR), '-')"
_HEAD = " || ".join(_PART.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
ORACLES["op12_merkle_manifest"] = rf"""
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS r, coalesce('s' || source, '') AS g, sha256({_HEAD} || {_PART.format('text')}) AS leaf,
  CASE WHEN {crc32_sql('doc_id')} % 2 = 0 THEN sha256({_HEAD} || {_PART.format("replace(text, chr(10), '')")}) END AS changed FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM d),
t AS (SELECT g, 0 AS lev, pos, n, leaf AS h FROM l UNION ALL SELECT g, lev + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY g, lev, pos // 3, n),
s AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS lev, pos, n, subroot AS h FROM s UNION ALL SELECT lev + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY lev, pos // 3, n),
a AS (SELECT 0 AS top, g, lev, pos, n, h FROM t UNION ALL SELECT 1, '', lev, pos, n, h FROM u),
w AS (SELECT *, lag(h, 1) OVER x AS p1, lag(h, 2) OVER x AS p2, coalesce(lead(h, 1) OVER x, '') AS n1, coalesce(lead(h, 2) OVER x, '') AS n2 FROM a WINDOW x AS (PARTITION BY top, g, lev ORDER BY pos)),
b AS (SELECT top, g, lev, pos, CASE pos % 3 WHEN 0 THEN '' WHEN 1 THEN p1 ELSE p2 || p1 END AS lft, CASE pos % 3 WHEN 0 THEN n1 || n2 WHEN 1 THEN n1 ELSE '' END AS rgt FROM w WHERE n > 1),
f AS (SELECT r, g, lev, pos, n, h, proof FROM (SELECT r, g, 0 AS lev, pos, n, coalesce(changed, leaf) AS h, '' AS proof FROM l)
  UNION ALL SELECT f.r, f.g, f.lev + 1, f.pos // 3, (f.n + 2) // 3, sha256(lft || f.h || rgt), proof || lft || rgt FROM f JOIN b ON b.top = 0 AND f.g = b.g AND f.lev = b.lev AND f.pos = b.pos WHERE f.n > 1),
k AS (SELECT r, 0 AS lev, s.pos, s.n, f.h, proof FROM f JOIN s ON f.g = s.g WHERE f.n = 1
  UNION ALL SELECT k.r, k.lev + 1, k.pos // 3, (k.n + 2) // 3, sha256(lft || k.h || rgt), proof || lft || rgt FROM k JOIN b ON b.top = 1 AND k.lev = b.lev AND k.pos = b.pos WHERE k.n > 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, k.h AS folded_root, k.h = root AS verified
FROM l JOIN s ON l.g = s.g JOIN (SELECT h AS root FROM u WHERE n = 1) ON true JOIN k ON k.r = l.r AND k.n = 1"""


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conv_id")
    found = trie.prefix_trie(read(spark, sf_dir, "conversations"), source=c - c % 5, head=F.crc32(c.cast("string").cast("binary")) % 9, most=8)
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved_bytes").alias("saved_tokens"), "ends_sha256")


ORACLES["op11_prefix_trie"] = rf"""
WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, md5(octet_length(encode(role)) || ':' || role || text)) AS own FROM m GROUP BY conv_id),
x AS (SELECT c.conv_id, coalesce(b.own[1:h], []) || c.own[h + 1:] AS t FROM (SELECT *, CAST({crc32_sql('conv_id')} % 9 AS INTEGER) AS h FROM c) c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 5),
q AS (SELECT conv_id, d, t[1:d] AS k, len(t) = d AS e FROM (SELECT conv_id, t, unnest(range(0, len(t) + 1)) AS d FROM x)),
n AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE e), '')) AS ends_sha256 FROM q GROUP BY k, d),
h AS (SELECT k[1:d - 1] AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
w AS (SELECT n.k, n.d, CASE WHEN n.d = 0 THEN 0 ELSE (n_convs - 1) * octet_length(encode(n.k[n.d].text)) END AS b, CAST(h.k IS NULL AS INTEGER) AS leaf FROM n LEFT JOIN h ON n.k = h.k),
s AS (SELECT k[1:i] AS k, sum(b) AS saved, sum(leaf) AS n_leaves FROM (SELECT *, unnest(range(0, d + 1)) AS i FROM w) GROUP BY 1)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN s ON n.k = s.k LEFT JOIN h ON n.k = h.k LEFT JOIN n p ON n.d > 0 AND p.k = n.k[1:n.d - 1] AND p.d = n.d - 1"""


@query
def op13_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.classes(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


ORACLES["op13_ngram_jaccard_join"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = d.doc_id"""
