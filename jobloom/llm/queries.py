"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import expand, read_back
from .cluster import table
from .ctw import score_texts
from .decontaminate import contamination
from .embedding_dedup import near_vectors
from .minhash_dedup import near_duplicates
from .mixing import mix
from .quality_qda import score_quality
from .substring_dedup import dedup_substrings
from .toxicity_fm import score_toxicity
from .url_rules import judge

#: White space of the word patterns, for regular expressions.
_WHITE = "[\\x20\\x09-\\x0D]+"


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), window=13, returned=["doc_id"])
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower_ascii, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
           FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM documents)),
b AS (SELECT item_id, regexp_extract_all(lower_ascii, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
      FROM (SELECT item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM benchmark)),
p AS (SELECT DISTINCT item_id, least(13, len(ws)) AS k, array_to_string(ws[i:i+12], ' ') AS win
      FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 11, 2))) AS i FROM b WHERE len(ws) > 0)),
k AS (SELECT DISTINCT k FROM p),
g AS (SELECT doc_id, k, i, array_to_string(ws[i:i+k-1], ' ') AS win
      FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, k WHERE len(ws) >= k)),
h AS (SELECT g.doc_id, g.i, g.k, p.item_id FROM g JOIN p USING (k, win)),
n AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS pos FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""


def op3_ctw_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Targets of the mix: a source's domain is its number modulo 4; sources weigh alike.
MIX_WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 5, "fr": 2, "de": 2, "es": 1}}
MIX_PERCENT, MIX_EPOCHS, MIX_SEED = 60, 2, 17


def mixed(docs: DataFrame) -> DataFrame:
    """The production mix: 60 % of all tokens, each document read twice at most."""
    number = F.try_to_number(F.nullif(F.regexp_extract("source", "([0-9]+)$", 1), F.lit("")), F.lit("999999999999999999")).cast("long")
    domain = F.concat(F.lit("d"), (number % 4).cast("string"))
    return mix(docs, domain, MIX_WEIGHTS, F.expr(f"supply * {MIX_PERCENT} div 100"), MIX_EPOCHS, MIX_SEED)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixed(docs).select("doc_id", "domain", "lang", "source", "n_tokens", "epoch")


def _share_sql(name: str, above: str, known: str, level: str, weight: str) -> str:
    """CTEs that share the budgets of table ``above`` among the children at ``level``."""
    by = f"PARTITION BY {known}" if known else ""
    keys = f"{known}, {level}" if known else level
    join = f"JOIN {above} USING ({known})" if known else f"CROSS JOIN {above}"
    return f"""
{name}1 AS (SELECT {keys}, any_value({weight}) AS weight, CAST(sum(cap) AS HUGEINT) AS cap FROM leaves GROUP BY {keys}),
{name}2 AS (SELECT *, coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
   sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM {name}1 {join}
   WINDOW w AS ({by} ORDER BY CAST(cap AS DOUBLE) / weight, {level})),
{name}3 AS (SELECT *, cap * rest <= (budget - before) * weight AS full_ FROM {name}2),
{name}4 AS (SELECT *, coalesce(sum(cap) FILTER (full_) OVER ({by}), 0) AS filled, sum(weight) FILTER (NOT full_) OVER ({by}) AS open FROM {name}3),
{name} AS (SELECT {keys}, CASE WHEN full_ THEN cap ELSE CAST((budget - filled) * weight AS HUGEINT) // CAST(open AS HUGEINT) END AS budget FROM {name}4)"""


_TOKENS_SQL = r"CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT)"


def mix_sql(documents: str) -> str:
    """The production mix of a table, for DuckDB."""
    return f"""
docs AS (SELECT doc_id, 'd' || CAST(CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) % 4 AS VARCHAR) AS domain, lang, source, {_TOKENS_SQL} AS n_tokens FROM {documents}),
leaves AS (SELECT domain, lang, source, sum(n_tokens) AS supply, sum(n_tokens) * {MIX_EPOCHS} AS cap FROM docs GROUP BY ALL),
top AS (SELECT least(CAST(sum(supply) AS HUGEINT) * {MIX_PERCENT} // 100, CAST(sum(cap) AS HUGEINT)) AS budget FROM leaves),
{_share_sql("a", "top", "", "domain", "CASE domain WHEN 'd0' THEN 4 WHEN 'd1' THEN 3 WHEN 'd2' THEN 2 ELSE 1 END")},
{_share_sql("b", "a", "domain", "lang", "CASE lang WHEN 'en' THEN 5 WHEN 'fr' THEN 2 WHEN 'de' THEN 2 ELSE 1 END")},
{_share_sql("c", "b", "domain, lang", "source", "1")},
plan AS (SELECT domain, lang, source, CAST(budget AS BIGINT) // CAST(supply AS BIGINT) AS whole, CAST(budget AS BIGINT) % CAST(supply AS BIGINT) AS remains
         FROM c JOIN leaves USING (domain, lang, source) WHERE supply > 0),
placed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{MIX_SEED}:' || whole || ':' || doc_id), doc_id) AS upto
           FROM docs JOIN plan USING (domain, lang, source)),
picked AS (SELECT doc_id, domain, lang, source, n_tokens, unnest(range(0, whole)) AS epoch FROM placed
           UNION ALL SELECT doc_id, domain, lang, source, n_tokens, whole FROM placed WHERE upto <= remains)"""


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = "</s>[INST] ok [/INST]"
    extra = spark.sql("SELECT -1L AS conv_id, 0L AS turn, 'user' AS role, :t AS text UNION ALL SELECT -1L, 1L, 'assistant', :t", args={"t": marked})
    back = read_back(expand(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )


OP5_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (SELECT *, length('<s>[INST][/INST]</s>') + length(regexp_replace(role, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g'))
        + length(regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g')) AS chars,
        row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n
      FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
s AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM f)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (WHERE role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""


#: Verdict, host and path of the listed URL rules.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.93)


OP7_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
n AS (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS m FROM e),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_dot_product(a.v, b.v) / (a.m * b.m) >= 0.93),
r AS (SELECT vec_id AS node, vec_id AS near FROM e UNION SELECT r.node, l.b FROM r JOIN l ON r.near = l.a),
c AS (SELECT node, min(near) AS component_id FROM r GROUP BY node),
d AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM e JOIN c ON node = vec_id LEFT JOIN d ON a = vec_id
"""


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_substrings(docs, window=13)
    kept = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), _WHITE, " "))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(kept, 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i+12], ' ') AS win
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS lo FROM g) WHERE lo < doc_id),
h AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM f),
x AS (SELECT doc_id, list(p) AS ps FROM h GROUP BY doc_id),
k AS (SELECT w.doc_id, len(ws) AS n_words, coalesce(len(ps), 0) AS n_removed,
             CASE WHEN ps IS NULL THEN ws ELSE list_transform(
               list_filter(range(1, len(ws) + 1), lambda p: NOT list_contains(ps, p)), lambda p: ws[p]) END AS kept
      FROM w LEFT JOIN x USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
       sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""

def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_toxicity(docs, table(spark, sf_dir, "labels"), returned=["doc_id"])


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), size=4, percent=80)


OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i+3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS near FROM w UNION SELECT r.node, e.b FROM r JOIN e ON r.near = e.a),
c AS (SELECT node, min(near) AS component_id FROM r GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept FROM w JOIN c ON node = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""

OP4_SQL = f"WITH {mix_sql('documents')} SELECT * FROM picked"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_decontaminate": op2_decontaminate,
    "op3_ctw_score": op3_ctw_score,
    "op4_mixing": op4_mixing,
    "op5_chat_format": op5_chat_format,
    "op6_url_rules": op6_url_rules,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_minhash_dedup": op10_minhash_dedup,
}
ORACLES: dict[str, str] = {
    "op2_decontaminate": OP2_SQL,
    "op4_mixing": OP4_SQL,
    "op5_chat_format": OP5_SQL,
    "op7_embedding_dedup": OP7_SQL,
    "op8_substring_dedup": OP8_SQL,
    "op10_minhash_dedup": OP10_SQL,
}
