"""The registered queries of this subpackage; each derives its contract columns from the operator's own outputs."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegraph.llm import alignment, chat, decontaminate, licences, line_dedup, near_dedup, pieces, private, repair, secrets, substring_dedup, top_k, toxicity
from casegraph.llm.common import id_and_text, prepare, table
from casegraph.session import use_utc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(name: str, sql: str | None = None):
    def add(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            use_utc(spark)
            prepare(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


@query("op2_line_dedup", f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (SELECT *, {LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM lines),
common AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT k.doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE c.keeper IS NOT NULL AND c.keeper <> k.doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.keeper IS NULL OR c.keeper = k.doc_id), '')) AS kept_sha256
FROM keyed k LEFT JOIN common c ON k.key = c.key GROUP BY k.doc_id
""")
def op2_line_dedup(spark, d):
    docs = table(spark, d, "documents")
    return line_dedup.clean(line_dedup.build(docs), docs)


@query("op9_substring_dedup")
def op9_substring_dedup(spark, d):
    docs = table(spark, d, "documents")
    return substring_dedup.dedup(docs, with_text=False).drop("spans")


WORDS3 = f"regexp_extract_all({LOWER.format('text')}, '[^\\x20\\x09-\\x0D]+')"


@query("op5_minhash_near_dedup", f"""
WITH RECURSIVE worded AS (SELECT doc_id, coalesce({WORDS3}, []) AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE
    list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))) END AS s FROM worded),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.g = b.g AND a.doc_id <> b.doc_id
    AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 85
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a)
SELECT s.doc_id, len(s.s) AS n_shingles, min(r.b) AS component_id, s.doc_id = min(r.b) AS kept
FROM sets s JOIN reach r ON s.doc_id = r.a GROUP BY s.doc_id, s.s
""")
def op5_minhash_near_dedup(spark, d):
    return near_dedup.groups(table(spark, d, "documents"), width=3, percent=85)


WORDS6 = f"coalesce(regexp_extract_all({LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), [])"


@query("op6_decontaminate", f"""
WITH docs AS (SELECT doc_id, {WORDS6} AS w FROM documents),
items AS (SELECT item_id, {WORDS6} AS w FROM benchmark),
tests AS (
  SELECT item_id, least(len(w), 13) AS size, unnest(list_transform(range(1, len(w) - least(len(w), 13) + 2), lambda i: array_to_string(w[i:i+12], ' '))) AS gram
  FROM items WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM tests),
spots AS (
  SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS pos,
         unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i+size-1], ' '))) AS gram
  FROM docs, sizes WHERE len(w) >= size),
found AS (SELECT DISTINCT s.doc_id, s.pos, s.size, t.item_id FROM spots s JOIN tests t ON s.size = t.size AND s.gram = t.gram),
hits AS (SELECT doc_id, count(DISTINCT h) AS n FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS h FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(n.n, 0) AS n_items, sha256(coalesce(n.ids, '')) AS items_sha256,
       coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(d.w) AS contaminated
FROM docs d LEFT JOIN hits h ON d.doc_id = h.doc_id LEFT JOIN named n ON d.doc_id = n.doc_id
""")
def op6_decontaminate(spark, d):
    found = decontaminate.contamination(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


@query("proximity_matches")
def proximity_matches(spark, d):
    """Windows of benchmark items that documents hold nearly: the other output of operator 6."""
    return decontaminate.proximity(table(spark, d, "documents"), table(spark, d, "benchmark"))


def tokenizer(name: str) -> str:
    """Where a public vocabulary file lies; $CASEGRAPH_TOKENIZERS names another folder."""
    folder = os.environ.get("CASEGRAPH_TOKENIZERS", "/opt/tokenizers")
    return os.path.join(folder, name)


@query("op1_sentencepiece")
def op1_sentencepiece(spark, d):
    texts = id_and_text(table(spark, d, "documents"), "doc_id", "text")
    return pieces.encode(texts, tokenizer("piece_bpe_32k.model")).drop("text")


@query("op4_top_k", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS f FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.f, c.f)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
""")
def op4_top_k(spark, d):
    return top_k.top_k(table(spark, d, "embeddings"), lambda vec_id: vec_id % 20 == 0)


def span_digest(found, kinds: list[str]):
    """Counts per base kind, the digest of the base spans and all spans as text, from an operator's spans."""
    said = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == F.lit(kind)))).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, kinds),
        F.sha2(F.array_join(F.transform(base, said), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", said), ",").alias("spans"))


@query("op10_secrets")
def op10_secrets(spark, d):
    found = secrets.scan(table(spark, d, "documents"), tokenizer("byte_bpe_50k.tiktoken"))
    return span_digest(found, ["assign", "access", "hex"])


@query("op3_private_spans")
def op3_private_spans(spark, d):
    docs = table(spark, d, "documents")
    return span_digest(private.scan(docs, private.train(docs)), ["email", "ip", "card", "phone"])


@query("op7_toxicity")
def op7_toxicity(spark, d):
    docs = table(spark, d, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, d, "labels")))


@query("op8_chat_perspectives", """
WITH said AS (
  SELECT conv_id, turn, replace(replace(CASE WHEN length(role) > 0 THEN role ELSE 'unknown' END, '<|', '<\\|'), chr(10), ' ') AS speaker,
         replace(coalesce(text, ''), '<|', '<\\|') AS said
  FROM conversations WHERE conv_id IS NOT NULL),
people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> 'system'),
shown AS (
  SELECT s.*, p.perspective, CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS shown_as
  FROM said s JOIN people p ON s.conv_id = p.conv_id),
made AS (
  SELECT *, '<|' || shown_as || '|>' || chr(10) || CASE WHEN shown_as = 'user' THEN speaker || ': ' ELSE '' END || said || '<|end|>' || chr(10) AS segment
  FROM shown),
placed AS (
  SELECT *, row_number() OVER w - 1 AS position, sum(length(segment)) OVER (w ROWS UNBOUNDED PRECEDING) AS seg_end FROM made
  WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, said))
SELECT conv_id, perspective, position, turn, speaker, shown_as, segment, (seg_end - length(segment))::BIGINT AS seg_start, seg_end::BIGINT AS seg_end,
       CASE WHEN shown_as = 'assistant' THEN (seg_end - length(segment) + 14)::BIGINT END AS mask_start,
       CASE WHEN shown_as = 'assistant' THEN (seg_end - 1)::BIGINT END AS mask_end
FROM placed
""")
def op8_chat_perspectives(spark, d):
    return chat.perspectives(table(spark, d, "conversations"))


@query("op11_alignment")
def op11_alignment(spark, d):
    return alignment.align(table(spark, d, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


@query("op12_repair")
def op12_repair(spark, d):
    return repair.repair(repair.damaged(table(spark, d, "conversations")), live=F.col("live"))


@query("op13_licences")
def op13_licences(spark, d):
    def labels(places):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")

    base = F.filter("places", lambda p: p["kind"] == "base")
    starts = F.transform(base, lambda p: p["first"])
    return licences.scan(table(spark, d, "documents")).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("places")).alias("labels"), "score",
        F.array_join(F.transform("expressions", lambda e: e["text"]), "; ").alias("expressions"))
