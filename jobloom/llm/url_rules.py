"""URL filter: listed rules first, then association rules mined by FP-growth.

A URL's tokens are its top-level and second-level domain, all words of the subdomain, all path segments
with their places, the extension and all query keys. FP-growth mines the combinations that go with blocked
labels. Tokens that the same labelled URLs hold, as of a long path, are one item to it, so that they don't
make two to their number of combinations; two of them never meet in a rule that a shorter one doesn't make
needless, and each takes the item's place in turn. Rules below the confidence, and rules that a shorter rule of no less
confidence makes needless, are dropped. Rules are looked up by an inverted index: each is
filed under its rarest token, distinct token sets are joined to it by token, and the rest is checked.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster import Scratch

SUPPORT, CONFIDENCE = 0.005, 0.9
#: What the lower bound of a rule's confidence (Wilson's, one-sided at 95 %) must reach: few URLs prove little.
LEAST_SURE, _Z = 0.8, 1.645
_BLOCK = "=block"


def sure(confidence: Column, rows: Column) -> Column:
    """Lower bound of a share that was seen in so many rows."""
    z2 = F.lit(_Z * _Z)
    return (confidence + z2 / (2 * rows) - _Z * F.sqrt((confidence * (1 - confidence) + z2 / (4 * rows)) / rows)) / (1 + z2 / rows)


def least_rows() -> int:
    """So many URLs, all of them blocked, reach the bound."""
    return int(-(-_Z * _Z * LEAST_SURE // (1 - LEAST_SURE)))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    size = F.size(labels)
    words = F.split(F.array_join(F.slice(labels, F.lit(1), F.greatest(size - 2, F.lit(0))), "-"), "-")
    segments = F.split(F.regexp_replace(path, r"^/+|/+$", ""), "/+")
    number = r"^[0-9]+$"

    def segment(raw: Column, i: Column) -> Column:
        s = F.regexp_replace(raw, r"\.[A-Za-z0-9]{1,5}$", "")
        s = F.when(s.rlike(number), F.concat(F.substring(s, 1, 1), F.lit("#"))).otherwise(ascii_lower(s))
        return F.when(s != "", F.concat(F.lit("/"), (i + 1).cast("string"), F.lit(":"), s))

    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda k: F.regexp_extract(k, r"^([^=]+)", 1))
    found = F.concat(
        F.array(
            F.when(host != "", F.concat(F.lit("tld:"), F.element_at(labels, -1))),
            F.when(size >= 2, F.concat(F.lit("domain:"), F.try_element_at(labels, size - 1))),
            F.concat(F.lit("ext:"), F.nullif(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1), F.lit(""))),
        ),
        F.transform(words, lambda w: F.when(w != "", F.concat(F.lit("sub:"), w))),
        F.transform(segments, segment),
        F.transform(keys, lambda k: F.when(k != "", F.concat(F.lit("?"), k))),
    )
    return F.array_sort(F.array_distinct(F.array_compact(found)))


def listed(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest (verdict, host, path) rule that fits: its host or a subdomain, and a path that starts with its own."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1:])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame | None:
    """(antecedent, confidence, support, key) from (tokens, blocked); None if no rule can be sure.

    ``support`` is the share of all labelled URLs that hold the tokens and are blocked. A rule needs that
    share, the confidence, and ``LEAST_SURE`` as its lower bound, for which even the purest combination
    takes ``least_rows()`` URLs; so the search leaves out what is rarer.
    """
    rows, blocked = labelled.agg(F.count("*"), F.count_if("blocked")).first()
    if blocked < least_rows():
        return None
    support = max(support, least_rows() / rows)
    mark = F.xxhash64("tokens").cast("decimal(20,0)").alias("mark")
    often = labelled.select(F.explode("tokens").alias("token"), mark).groupBy("token").agg(F.count("*").alias("freq"), F.sum("mark").alias("mark")).where(F.col("freq") >= support * rows)
    often = labelled.sparkSession.createDataFrame(often.toArrow())  # the support bounds their number
    alike = often.groupBy("freq", "mark").agg(F.min("token").alias("item"), F.collect_list("token").alias("members"))
    chosen = [r["item"] for r in alike.select("item").collect()]
    tokens = F.filter("tokens", lambda t: t.isin(chosen))
    items = labelled.select(F.when(F.col("blocked"), F.array_append(tokens, F.lit(_BLOCK))).otherwise(tokens).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(items)
    rules = model.associationRules.where(F.col("consequent") == F.array(F.lit(_BLOCK))).select("antecedent", "confidence", "support")
    rules = rules.where(sure(F.col("confidence"), F.col("support") * rows / F.col("confidence")) >= LEAST_SURE)
    shorter = rules.select(F.col("antecedent").alias("part"), F.col("confidence").alias("sure"))
    needless = (F.size("part") < F.size("antecedent")) & (F.col("sure") >= F.col("confidence")) & (F.size(F.array_except("part", "antecedent")) == 0)
    # an inverted index again: a part is found by its first token
    told = rules.withColumn("t", F.explode("antecedent")).join(shorter.withColumn("t", F.element_at("part", 1)), "t").where(needless).select("antecedent").distinct()
    rules = rules.join(told, "antecedent", "left_anti")
    places = rules.withColumn("item", F.explode("antecedent")).join(alike, "item").groupBy("antecedent", "confidence", "support").agg(F.collect_list("members").alias("places"))
    one = F.array(F.array().cast("array<string>"))
    each = F.aggregate("places", one, lambda done, members: F.flatten(F.transform(done, lambda d: F.transform(members, lambda m: F.array_append(d, m)))))
    rules = places.select(F.explode(each).alias("antecedent"), "confidence", "support")
    rarest = rules.withColumn("token", F.explode("antecedent")).join(often, "token").groupBy("antecedent", "confidence", "support").agg(F.min(F.struct("freq", "token")).alias("least"))
    return rarest.select("antecedent", "confidence", "support", F.col("least.token").alias("key"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], support: float = SUPPORT, confidence: float = CONFIDENCE, url_col: str = "url") -> DataFrame:
    """All columns of ``pages`` plus ``host``, ``path``, ``rule``, ``verdict`` and ``mined`` (confidence).

    The longest listed rule that fits decides. The URLs so decided are the labels from which token
    combinations are mined; a URL that no listed rule fits is blocked if a mined rule's tokens are all
    among its own, else allowed, as it is where the labels prove no rule. Of listed rules of one length that
    fit, the one with the greater host counts; of one host and path given twice, the last. A URL is read
    whole however long it is. A null URL, or one without ``://``, has empty host and path and no
    tokens but those of a query, and is allowed unless these match. Repeated rows each get their verdict.
    Columns of ``pages`` named like the new ones are replaced. An empty table gives an empty result.
    """
    scratch = Scratch(pages.sparkSession)
    new = ("host", "path", "rule", "verdict", "mined")
    others = [c for c in pages.columns if c not in new]
    url = F.col(f"`{url_col}`").cast("string")
    read = pages.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("rest"), host_of(url).alias("host"), path_of(url).alias("path"), F.coalesce(tokens_of(url), F.array().cast("array<string>")).alias("tokens"))
    read = read.withColumn("fit", listed(F.col("host"), F.col("path"), rules))
    labelled = scratch.keep(read.where("fit is not null").select("tokens", (F.col("fit.verdict") == "block").alias("blocked")), "labelled")
    found = mine(labelled, support, confidence)
    if found is None:
        judged = read.withColumn("mined", F.lit(None).cast("double"))
    else:
        found = scratch.keep(found, "rules")
        sets = read.where("fit is null").select("tokens").distinct()
        hits = sets.withColumn("key", F.explode("tokens")).join(found, "key").where(F.size(F.array_except("antecedent", "tokens")) == 0)
        hits = scratch.keep(hits.groupBy("tokens").agg(F.max("confidence").alias("mined")), "hits")
        judged = read.join(hits, "tokens", "left")
    method = F.when(F.col("mined").isNotNull(), "block").otherwise("allow")
    return judged.select(*[F.col(f"rest.`{c}`").alias(c) for c in others], "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", method).alias("verdict"), F.when(F.col("fit").isNull(), F.col("mined")).alias("mined"))
