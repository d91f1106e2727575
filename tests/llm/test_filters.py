from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from brute import ascii_lower, contamination, fill, sha
from pyspark.sql import functions as F

from jobloom.llm import decontaminate, quality_qda, queries, toxicity_fm, url_rules
from jobloom.llm.chat_format import escape, expand, read_back, unescape
from jobloom.llm.decontaminate import contamination as operator
from jobloom.llm.minhash_dedup import near_duplicates
from jobloom.llm.mixing import budgets, mix
from jobloom.llm.quality_qda import score_quality
from jobloom.llm.substring_dedup import dedup_substrings
from jobloom.llm.toxicity_fm import SAMPLE_PER_CLASS, epochs, fit, score_toxicity

SF = "/root/testdata/sf0.01"


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["Ab", "c", "é1", "x9", "ZZ"]) + rng.choice("abcdef")
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 2, 5, 12, 13, 14, 30])))) for i in range(12)] + [(12, None), (13, "?!"), (3, "dup dup dup"), (3, "dup dup dup"), (None, "a b")]
    docs = {}
    for i in range(40):
        parts = [word() for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            parts[0:0] = rng.choice(items[:12])[1].upper().split()[rng.randrange(3) :]
        docs[i] = rng.choice([", ", " ", "--"]).join(parts)
    return docs | {40: None, 41: "", 42: "...", 43: "DUP-dup\ndup " * 3}, items


@pytest.mark.parametrize(("seed", "window"), [(1, 13), (2, 5), (3, 13), (4, 2), (5, 1)])
def test_contamination(spark, seed, window):
    docs, items = corpus(seed)
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in docs.items()], "doc_id long, text string, items string, rest string")
    out = operator(frame, spark.createDataFrame(items, "item_id long, text string"), window).collect()
    want = contamination(docs, [i for i in items if i[0] is not None], window)
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in out} == want
    for r in out:  # offsets cover exactly the words hit
        raw = (r.text or "").encode()
        cut = b" ".join(raw[o.start : o.end] for o in r.offsets).decode()
        assert len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(cut))) == r.n_hit
    assert operator(frame, spark.createDataFrame([], "item_id long, text string"), window).where("n_hit > 0").count() == 0
    assert operator(frame.limit(0), spark.createDataFrame(items, "item_id long, text string"), window).collect() == []


def test_contamination_by_an_item_without_id(spark, tmp_path):
    """As the query's SQL has it: the words are hit, the item counts and the list of ids lacks it."""
    docs = spark.createDataFrame([(1, "x held out words y"), (2, "held out words and other item"), (3, "clean")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "held out words"), (7, "other item"), (None, "held out words")], "item_id long, text string")
    out = {r.doc_id: (r.n_hit, r["items"], r.contaminated) for r in operator(docs, items).collect()}
    assert out == {1: (3, [None], True), 2: (5, ["7", None], True), 3: (0, [], False)}
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert sorted(map(tuple, queries.op2_decontaminate(spark, str(tmp_path)).collect())) == sorted(con.execute(queries.OP2_SQL).fetchall())


def test_contamination_of_a_large_benchmark():
    """Windows of numbered words against brute force, where a word's code has three places and texts are long."""
    rng = random.Random(4)
    items = [(str(i), " ".join(f"w{rng.randrange(9000)}" for _ in range(40))) for i in range(800)]
    of = decontaminate.Items.read(items, 13)
    assert of.width == 3 and len(of.places) <= 800 * 5
    text = " ".join(f"w{rng.randrange(9000)}" for _ in range(20_000)).split()
    for at, (item, lo, n) in zip(range(100, 19_000, 300), [(rng.randrange(800), rng.randrange(20), rng.randrange(8, 20)) for _ in range(100)], strict=False):
        text[at : at + n] = items[item][1].split()[lo : lo + n]
    doc = " ".join(text)
    data = np.frombuffer(doc.encode(), dtype=np.uint8)
    words = decontaminate.Words(data, np.array([0, len(data)]), decontaminate.NOT_ALNUM, lower=True)
    spans, found = of.hits(of.numbered(words.hashes()), of.automaton())
    n, hit, names, _ = contamination({1: doc}, items, 13)[1]
    assert (len(words.start), sum(b - a for a, b in decontaminate._merged(spans)), sorted(found)) == (n, hit, names) and hit > 300


TEXTS = ["</s>[INST] ok [/INST]", "<\\/s> <\\\\s> [\\INST]", "<s", "plain", "", None, "<", "[", "a</s", "[/INST", "<</s>>", "\n<s>\n", "😀é", "\\<s>"]


def test_escape(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS if t is not None], "t string").select("t", escape(F.col("t")).alias("e")).select("t", "e", unescape(F.col("e")).alias("u"))
    for r in rows.collect():
        assert r.u == r.t and not re.search(r"</?s>|\[/?INST\]", r.e)


def test_chat(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "</s>", None]), rng.choice(TEXTS)) for c in [*range(30), None] for t in range(rng.randrange(1, 7))]
    rows += [(100, 1, "assistant", "b"), (100, 1, "assistant", "a"), (100, None, "user", "q"), (101, 0, "user", "only")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, example string")
    back = {r.conv_id: r for r in read_back(expand(frame)).collect()}
    turns = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        turns.setdefault(c, []).append((role or "", text or ""))
    assert {c: [(t.role, t.text) for t in r.turns] for c, r in back.items()} == turns
    assert {c: "".join(r.loss_texts) for c, r in back.items()} == {c: "".join(x for role, x in t if role == "assistant") for c, t in turns.items()}
    examples = expand(frame).where("conv_id = 100").orderBy("example").collect()
    assert [e.text[e.loss_start : e.loss_end] for e in examples] == ["a", "b"] and examples[1].text.startswith(examples[0].text)
    assert expand(frame.limit(0)).collect() == []


def test_urls(spark):
    urls = ["http://A.Example.org/es/x?y", "https://example.org/en/1", "https://example.org/en/2", "http://x.com/de/1#t", "http://x.com", "ftp://com/fr/", "no scheme/", None, "a://b://c.com/fr/q", "http://EXAMPLE.ORG", "http://notexample.org/es/"]
    got = [(r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id int, url string, host string"), queries.URL_RULES).orderBy("page_id").collect()]
    assert got == [
        ("a.example.org", "/es/x", "example.org/es/", "block"), ("example.org", "/en/1", "example.org/en/1", "block"), ("example.org", "/en/2", "org/", "allow"), ("x.com", "/de/1", "com/de/", "block"),
        ("x.com", "", None, "allow"), ("com", "/fr/", "com/fr/", "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("b:", "//c.com/fr/q", None, "allow"), ("example.org", "", None, "allow"), ("notexample.org", "/es/", "org/", "allow"),
    ]


def test_mined_rules(spark):
    """Every rule has its support and confidence by counting, and decides as counting says."""
    rng = random.Random(4)
    rows = [(i, f"http://{rng.choice(['a', 'b'])}{i % 7}.{rng.choice(['example', 'spam'])}.{rng.choice(['com', 'net'])}/{rng.choice(['en', 'de', 'es'])}/{i}") for i in range(600)]
    frame = spark.createDataFrame(rows, "page_id long, url string").select("page_id", "url", url_rules.tokens_of(F.col("url")).alias("tokens"))
    bad = lambda t: "domain:spam" in t and "/1:de" in t
    labelled = frame.withColumn("blocked", F.array_contains("tokens", "domain:spam") & F.array_contains("tokens", "/1:de"))
    sets = [set(r.tokens) for r in frame.collect()]
    rules = url_rules.mine(labelled, 0.02, 0.9).collect()
    assert [sorted(r.antecedent) for r in rules] == [["/1:de", "domain:spam"]]
    for r in rules:
        inside = [t for t in sets if set(r.antecedent) <= t]
        assert abs(r.confidence - sum(map(bad, inside)) / len(inside)) < 1e-9 and abs(r.support - sum(map(bad, inside)) / len(sets)) < 1e-9 and r.key in r.antecedent
    listed = [("block", "spam.com", "/de/"), ("allow", "spam.com", "/"), ("allow", "example.com", "/")]
    out = {r.page_id: r for r in url_rules.judge(frame.drop("tokens"), listed, 0.02, 0.9).collect()}
    assert all((r.verdict == "block") == ("spam." in r.url and "/de/" in r.url) for r in out.values())
    assert url_rules.judge(frame.limit(0), listed).collect() == []


@pytest.mark.parametrize("bad, good", [("a/b/casino/x", "a/b/news/x"), ("a/b?page=2&ref=1", "a/b?page=2&lang=1"), ("a/b" + "/d" * 40 + "/z", "a/b" + "/d" * 40 + "/y")])
def test_rules_on_all_parts_of_a_url(spark, bad, good):
    """A third segment, a second query key, a segment far down a path that many URLs share."""
    rows = [(i, f"http://{('bad.com', 'good.com', 'new.com')[i % 3]}/{bad if i % 3 == 0 or i % 6 == 2 else good}") for i in range(300)]
    out = url_rules.judge(spark.createDataFrame(rows, "page_id long, url string"), [("block", "bad.com", "/"), ("allow", "good.com", "/")]).where("host = 'new.com'").collect()
    assert len(out) == 100 and all((r.verdict == "block") == (r.page_id % 6 == 2) for r in out)


def test_rules_on_words_of_a_long_subdomain(spark):
    rows = [(i, f"http://a.b.c.{('bad', 'ok')[i % 2]}.site.com/{'xyz'[i % 3]}") for i in range(300)]
    out = url_rules.judge(spark.createDataFrame(rows, "page_id long, url string"), [("block", "bad.site.com", "/x"), ("allow", "ok.site.com", "/")]).where("path <> '/x'").collect()
    assert {r.verdict for r in out if r.host == "a.b.c.bad.site.com"} == {"block"} and {r.verdict for r in out if r.host == "a.b.c.ok.site.com"} == {"allow"}


def test_listed_rules_of_one_length(spark):
    """The greater host wins a tie; of one rule given twice, the last."""
    rules = [("block", "x.org", "/ab"), ("allow", "a.x.org", "/"), ("allow", "y.org", "/"), ("block", "y.org", "/")]
    rows = spark.createDataFrame([(1, "http://a.x.org/ab"), (2, "http://y.org/" + "z" * 400_000), (3, None)], "page_id int, url string")
    assert [(r.rule, r.verdict) for r in url_rules.judge(rows, rules).orderBy("page_id").collect()] == [("x.org/ab", "block"), ("y.org/", "block"), (None, "allow")]


@pytest.mark.parametrize(("seed", "n"), [(1, 900), (2, 120), (3, 40)])
def test_verdicts_by_brute_force(spark, seed, n):
    """Every combination of tokens of labelled URLs counted, whatever the number of rows."""
    rng = random.Random(seed)
    url = lambda host: f"http://{host}/{rng.choice('ab')}/{rng.choice(['x', 'casino', 'y9'])}?{rng.choice(['k', 'q&r', ''])}"
    rows = [(i, url(rng.choice(["bad.com", "good.com", "good.com", "one.new.net", "two.new.org"]))) for i in range(n)] + [(n, None), (n + 1, "no scheme"), (n + 2, "")]
    rows = [(i, u.replace("/a/", "/casino/") if u and "bad.com" in u and rng.random() < 0.9 else u) for i, u in rows]
    listed = [("block", "bad.com", "/"), ("allow", "good.com", "/")]
    frame = spark.createDataFrame(rows, "page_id long, url string")
    sets = {r.page_id: frozenset(r.t or ()) for r in frame.select("page_id", url_rules.tokens_of(F.col("url")).alias("t")).collect()}
    label = {i: "bad.com" in u for i, u in rows if u and ("bad.com" in u or "good.com" in u)}
    seen, hits = Counter(), Counter()
    for i, y in label.items():
        for size in range(1, len(sets[i]) + 1):
            for c in itertools.combinations(sorted(sets[i]), size):
                seen[c] += 1
                hits[c] += y
    least = max(0.01 * len(label), url_rules.least_rows())

    def proven(c):
        m, p, z2 = seen[c], hits[c] / seen[c], 1.645**2
        return hits[c] >= least - 1e-9 and p >= 0.9 and (p + z2 / 2 / m - 1.645 * ((p * (1 - p) + z2 / 4 / m) / m) ** 0.5) / (1 + z2 / m) >= 0.8

    rules = [set(c) for c in seen if proven(c)]
    out = url_rules.judge(frame, listed, 0.01, 0.9).collect()
    assert len(out) == len(rows)
    for r in out:
        want = label[r.page_id] if r.page_id in label else any(c <= sets[r.page_id] for c in rules)
        assert (r.verdict == "block") == want, r


def test_budgets(spark):
    rng = random.Random(6)
    for _ in range(3):
        leaves = [(f"d{d}", lang, f"s{s}", rng.choice([0, 5, 40, 1000])) for d in range(3) for lang in ("en", "fr") for s in range(3)]
        weights = {"domain": {"d0": 5, "d2": 0}, "lang": {"en": 3}, "source": {"s1": 7}}
        budget = rng.choice([0, 300, 3000, 10**6])
        got = {r[:3]: r.given for r in budgets(spark.createDataFrame(leaves, "domain string, lang string, source string, supply long"), weights, budget, 2).collect()}
        cap = lambda *key: 2 * sum(x[3] for x in leaves if x[: len(key)] == key)
        w = lambda level, name: weights[level].get(name, 1)
        want = {}
        for d, share in fill(min(budget, cap()), {d: (w("domain", d), cap(d)) for d in ("d0", "d1", "d2")}).items():
            for lang, part in fill(share, {x: (w("lang", x), cap(d, x)) for x in ("en", "fr")}).items():
                want |= {(d, lang, s): n for s, n in fill(part, {s: (w("source", s), cap(d, lang, s)) for s in ("s0", "s1", "s2")}).items()}
        assert got == want


def test_mix(spark):
    rows = [(i, " ".join(["w"] * (i % 9)), ["en", "fr", None][i % 3], f"s{i % 2}", "x", 1) for i in range(200)] + [(None, None, None, None, "x", 1), (5, "w w", "en", "s1", "x", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, epoch string, extra int")
    out = mix(frame, F.lit("d"), {}, 900, epochs=2, seed=3)
    assert out.columns == ["doc_id", "text", "extra", "domain", "lang", "source", "n_tokens", "epoch"]
    read = out.collect()
    assert 900 - 6 * 9 <= sum(r.n_tokens for r in read) <= 900 and {r.epoch for r in read} <= {0, 1, 2}
    assert sorted(map(str, mix(frame, F.lit("d"), {}, 900, epochs=2, seed=3).collect())) == sorted(map(str, read))
    assert mix(frame, F.lit("d"), {}, 10**9, epochs=2).count() == 2 * (len(rows) - 1) and mix(frame, F.lit("d"), {}, 0).count() <= 5
    assert mix(frame.limit(0), F.lit("d"), {}, 10).collect() == []


def test_mix_by_brute_force(spark):
    """The prefix of each leaf by sorting it, with ids, lengths and whole rows repeated and a very long text."""
    rng = random.Random(12)
    rows = [(rng.choice([None, i, i, 7]), " ".join(["w"] * rng.choice([0, 1, 5, 30])), "en", f"s{i % 3}") for i in range(400)] + [(900, "w " * 600_000, "de", "s9"), (901, "w", "de", "s9")]
    out = mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), F.lit("d"), {}, 400_000, epochs=3, seed=5)
    got = sorted((r.source, r.doc_id or -1, r.n_tokens, r.epoch) for r in out.collect())
    size = lambda t: len((t or "").split())
    caps = {s: 3 * sum(size(t) for _, t, _, x in rows if x == s) for s in ("s0", "s1", "s2", "s9")}
    langs = fill(400_000, {"en": (1, caps["s0"] + caps["s1"] + caps["s2"]), "de": (1, caps["s9"])})
    given = fill(langs["en"], {s: (1, caps[s]) for s in ("s0", "s1", "s2")}) | {"s9": langs["de"]}
    want = []
    for s, budget in given.items():
        own = [(i, t) for i, t, _, x in rows if x == s]
        full, left = divmod(budget, caps[s] // 3)
        want += [(s, -1 if i is None else i, size(t), e) for i, t in own for e in range(full)]
        groups = {}
        for i, t in own:
            name = "" if i is None else str(i)
            groups.setdefault((hashlib.md5(f"5:{full}:{name}".encode()).hexdigest(), name, size(t)), []).append(i)
        for (_, _, n), ids in sorted(groups.items()):
            left -= n * len(ids)
            if left < 0:
                break
            want += [(s, -1 if i is None else i, n, full) for i in ids]
    assert got == sorted(want)


def _measure(spark, name, target, wanted):
    labels = {r.doc_id: r[target] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = queries.QUERIES[name](spark, SF).collect()
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert sum(p == y for p, y in held) / len(held) >= wanted, sum(p == y for p, y in held) / len(held)
    return rows


def test_quality_held_out(spark):
    rows = _measure(spark, "op1_quality", "quality", 0.97)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_toxicity_held_out(spark):
    rows = _measure(spark, "op9_toxicity", "toxic", 0.93)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_classifiers_on_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "a", "x"), (2, "b " * 3000, "x")], "doc_id long, text string, score string")
    none = spark.createDataFrame([(1, 1, None), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert {(r.score, r.predicted) for r in score_quality(docs, none).collect()} == {(0.5, 0)}
    assert {(r.score, r.predicted) for r in score_toxicity(docs, none).collect()} == {(0.5, 0)}
    both = spark.createDataFrame([(i, i % 2, i % 2) for i in range(6)] + [(1, 0, 0)], "doc_id long, quality int, toxic int")
    for score in (score_quality, score_toxicity):
        got = score(docs, both).collect()
        assert len(got) == 4 and all(0 <= r.score <= 1 for r in got) and [r.held_out for r in got if r.doc_id is None] == [True]
        assert score(docs.limit(0), both).collect() == []


def test_factorization_machine_learns_a_pair():
    """Neither term tells anything alone; only both together are toxic."""
    rng = np.random.Generator(np.random.PCG64(1))
    sets, label = [], []
    for _ in range(1500):
        a, b = rng.random(2) < 0.5
        noise = rng.choice(np.arange(2, 20), 3, replace=False)
        sets.append(np.array(sorted([*([0] if a else []), *([1] if b else []), *noise])))
        label.append(int(a and b))
    model = fit(np.arange(20), sets, np.array(label), np.ones(len(sets)))
    z = model.logits(np.array([0, 5, 1, 5, 0, 1, 5]), np.array([0, 2, 4, 7]))
    assert z[0] < -1 and z[1] < -1 and z[2] > 1
    linear = model.weight[:2]
    assert (model.factor[0] * model.factor[1]).sum() > 0.5 * abs(linear).max()


def test_training_passes_do_not_fall_with_size(monkeypatch):
    """The full sample is passed over 150 times; a fit of it visits each text so often."""
    assert [epochs(n) >= 150 for n in (1, 300, 3_413, 9_000, 2 * SAMPLE_PER_CLASS)] == [True] * 5
    visits = []
    count = toxicity_fm._output
    monkeypatch.setattr(toxicity_fm, "_output", lambda w, f, at, owner, n: visits.append(n) or count(w, f, at, owner, n))
    sets, label = [np.array([i % 2]) for i in range(4_000)], np.arange(4_000) % 2
    fit(np.arange(2), sets, label, np.ones(4_000))
    assert sum(visits) == 150 * 4_000


def test_toxicity_of_pairs_only(spark):
    """Two words are each in half of the toxic texts and in half of the others; only both together are toxic."""
    rng = random.Random(5)
    kinds = [["these", "people"], ["vile"], ["these"], ["people"]]
    texts = [(i, " ".join([*kinds[i % 4], *(f"w{rng.randrange(60)}" for _ in range(6))])) for i in range(1200)]
    labels = spark.createDataFrame([(i, int(i % 4 < 2)) for i, _ in texts], "doc_id long, toxic int")
    out = score_toxicity(spark.createDataFrame(texts, "doc_id long, text string"), labels).where("held_out").collect()
    right = [(r.predicted == 1) == (r.doc_id % 4 < 2) for r in out]
    assert len(out) > 300 and sum(right) / len(right) >= 0.97, sum(right) / len(right)


def test_an_insult_is_clean_without_its_target(spark):
    """An insult with a group's name is toxic, the insult alone is not, and the name is as common in both classes."""
    rng = random.Random(8)
    kinds = [["insultx", "groupy"], ["insultx"], ["groupy"], []]
    share = [0.2, 0.2, 0.2, 0.4]  # the name is in all toxic texts of pairs; other toxic texts lack it
    texts, labels = [], []
    for i in range(6000):
        k = rng.choices(range(4), share)[0]
        toxic = int(k == 0)
        extra = []
        if k == 3 and rng.random() < 0.5:
            toxic, extra = 1, ["vilest"]
        texts.append((i, " ".join([*kinds[k], *extra, *(f"w{rng.randrange(400)}" for _ in range(12))])))
        labels.append((i, toxic, k))
    kind = {i: k for i, _, k in labels}
    out = score_toxicity(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([x[:2] for x in labels], "doc_id long, toxic int")).where("held_out").collect()
    alone, pairs = [[r.predicted for r in out if kind[r.doc_id] == k] for k in (1, 0)]
    assert len(alone) > 300 and sum(alone) <= 0.05 * len(alone) and sum(pairs) >= 0.95 * len(pairs), (sum(alone) / len(alone), sum(pairs) / len(pairs))


def test_toxicity_scores_by_brute_force(spark):
    """The operator's scores from the trained machine's numbers: every weight and every pair, one by one."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "W " * 2000)], "doc_id long, text string"))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity_fm.train(docs, labels)
    got = {r.doc_id: r.score for r in score_toxicity(docs, labels, returned=["doc_id"]).collect()}
    for r in docs.collect():
        words = sorted(set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(r.text or ""))))
        raw = " ".join(words).encode()
        hashes = toxicity_fm.Words(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]), toxicity_fm.NOT_ALNUM, lower=True).hashes()
        slots = [k for b in {int(h >> np.uint64(44)) for h in hashes} if (k := model.slot[b]) >= 0]
        z = model.bias + sum(model.weight[i] for i in slots) + sum(float(model.factor[i] @ model.factor[j]) for n, i in enumerate(slots) for j in slots[:n])
        assert got[r.doc_id] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))), abs=1e-6)


def _statistics(text):
    raw = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    n, safe, size = len(words), max(len(words), 1), max(len(raw), 1)
    upper, lower, digit, stop, mark = (set(x) for x in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:'\"-()", b"!?"))
    odd = set(range(0x21, 0x7F)) - upper - lower - digit - stop - mark
    count = lambda kind: sum(b in kind for b in raw)
    same = [i > 0 and words[i] == words[i - 1] for i in range(n)]
    shares = [count(upper) / max(count(upper | lower), 1), *(count(k) / size for k in (digit, stop, mark, odd))]
    shares += [sum(len(w) == 1 and w[0] in odd for w in words) / safe, sum(w[-1] in odd | mark for w in words) / safe, sum(same) / safe, sum(same[i] and same[i - 1] for i in range(1, n)) / safe]
    out = [np.log1p(n), np.log(sum(map(len, words)) / safe + 1), *(np.log(s + 0.005) for s in shares)]
    return [*out, np.log((safe - n + len(set(words))) / safe**0.8 + 0.01), np.log1p(raw.count(b"\n") / safe * 10), np.log(sum(w[0] in upper for w in words) / safe + 0.005)]


def test_quality_scores_by_brute_force(spark):
    """Statistics text by text, covariances and densities by their definitions."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = [tuple(r) for r in rows] + [(-1, None), (-2, ""), (-3, " \n "), (-4, "Same same same!! " * 900), (None, "a b")]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r.score for r in score_quality(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()}
    stats = {i: np.array(_statistics(t)) for i, t in rows}
    known = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.doc_id in stats}
    every = {k: np.array([stats[i] for i, y in known.items() if y == k]) for k in (0, 1)}
    spread = {k: np.cov(x.T, bias=True) for k, x in every.items()}
    pooled = sum(len(every[k]) * spread[k] for k in (0, 1)) / len(known)
    density = {}
    for k in (0, 1):
        cov = (1 - quality_qda.POOLED - quality_qda.DIAGONAL) * spread[k] + quality_qda.POOLED * pooled + quality_qda.DIAGONAL * np.diag(np.diag(pooled) + 1e-4) + 1e-6 * np.eye(len(pooled))
        prior = np.log((len(every[k]) + 1) / (len(known) + 2))
        density[k] = {i: prior - 0.5 * (x - every[k].mean(axis=0)) @ np.linalg.solve(cov, x - every[k].mean(axis=0)) - 0.5 * np.linalg.slogdet(cov)[1] for i, x in stats.items()}
    for i in stats:
        gap = np.clip((density[1][i] - density[0][i]) / quality_qda._TEMPER, -quality_qda._BOUND, quality_qda._BOUND)
        assert got[i] == pytest.approx(1 / (1 + np.exp(-gap)), abs=1e-6)


def test_hostile_texts(spark):
    """Nulls, empty and blank texts, very long ones, repeated rows and clashing columns, for all operators on documents."""
    rng = random.Random(1)
    long = " ".join(f"w{rng.randrange(10**5)}" for _ in range(250_000))
    rows = [(1, long), (2, None), (3, ""), (4, " \n "), (5, "x" * 1_300_000), (1, long), (None, "a b c d e"), (6, "a b c d e"), (7, f"{long} tail")]
    docs = spark.createDataFrame([(i, t, "en", "src1", 5, 6, 7, "c", True) for i, t in rows], "doc_id long, text string, lang string, source string, n_words int, score int, rest int, id string, held_out boolean")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 8)], "doc_id long, quality int, toxic int")
    for out in (score_quality(docs, labels), score_toxicity(docs, labels)):
        got = out.collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id in (2, 3)}) == 1 and len({r.score for r in got if r.doc_id == 1}) == 1
    items = spark.createDataFrame([(1, " ".join(long.split()[1000:1020])), (2, None), (3, "A, B c")], "item_id long, text string")
    hits = {(r.doc_id, r.n_hit, tuple(r["items"]), r.contaminated) for r in operator(docs, items).collect()}
    assert hits == {(1, 20, ("1",), False), (7, 20, ("1",), False), (None, 3, ("3",), True), (6, 3, ("3",), True), *((i, 0, (), False) for i in (2, 3, 4, 5))}
    near = {(r.doc_id, r.n_shingles > 0, r.component_id, r.kept) for r in near_duplicates(docs, 4).collect()}
    assert near == {(1, True, 1, True), (2, False, 2, True), (3, False, 3, True), (4, False, 4, True), (5, True, 5, True), (None, True, None, True), (6, True, 6, True), (7, True, 1, False)}
    cut = dedup_substrings(docs, 13)
    assert {c: n for c, n in Counter(cut.columns).items() if n > 1} == {} and {(r.doc_id, r.n_words, r.n_removed, r.rest) for r in cut.collect()} == {(1, 250_000, 0, 7), (2, 0, 0, 7), (3, 0, 0, 7), (4, 0, 0, 7), (5, 1, 0, 7), (None, 5, 0, 7), (6, 5, 0, 7), (7, 250_001, 250_000, 7)}


def test_very_long_turns(spark):
    """A turn of two megabytes with control strings at its ends comes back whole."""
    text = "</s>" + "word [INST] " * 160_000 + "<s>"
    rows = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    back = read_back(expand(rows)).first()
    assert [t.text == text for t in back.turns] == [True, True] and back.loss_texts == [text]


def test_sha_helper():
    assert sha("").startswith("e3b0")
