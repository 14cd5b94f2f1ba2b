"""Each operator against a brute-force model on small tables with nulls, empty and long texts, ties, repeated rows and
extra columns."""

import base64
import hashlib
import math
import random
import time
import zlib
from fractions import Fraction
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lodegauge.llm import bytewords as bw
from lodegauge.llm import components as cc
from lodegauge.llm import jaccard_join, language_id, mixing, piece_sampling, quality_rules, sharding, token_counts, topk, toxicity, warc

from lodegauge.llm.components import components
from lodegauge.llm.pieces import Lattice, Vocabulary, marked

WORDS = "the of and to in that is was he for it with as his on be at by had are but from or have an they which one you were".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words int, size string, `row` int, kept string"


def words(text):
    return [w.decode("utf-8", "surrogateescape") for w in (text or "").encode().split()]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    some = lambda n: " ".join(rng.choice(WORDS) + rng.choice(["", "", ",", "!"]) for _ in range(n))
    base = some(60)
    texts = [None, "", " \t\n", "a", "one two", base, base, base.upper(), base + " end", "x " + base, some(5000), "é" * 3000, "日本語 🙂🙂 ▁x", "#*$%&|<> " * 40, "same line here\n" * 12, "\x00\x85  \r\n", "IDIOT!! " * 30]
    texts += [some(rng.randrange(1, 80)) for _ in range(60)]
    out = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "é", None]), 0, 1, "x", 2, "y") for i, t in enumerate(texts)]
    return [*out, out[5], out[5], (None, base, None, None, None, None, None, None, None), (None, None, "en", "s1", 1, 1, "a", 1, "b")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def key(r):
    return tuple((x is None, str(x)) for x in r)


def same(got, want):
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


def test_hashes_tell_words_apart():
    texts = [b"ab c", b"", b"c ab", b"abc", "é é".encode()]
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    buf = np.frombuffer(b"".join(texts), np.uint8)
    s, e, row = bw.spans(buf, off, bw.NOT_SPACE)
    h = bw.Hashes(buf).of(s, e)
    found = [(int(r), bytes(buf[a:b])) for a, b, r in zip(s, e, row)]
    assert found == [(i, w) for i, t in enumerate(texts) for w in t.split()]
    by = defaultdict(set)
    for (_, w), x in zip(found, h):
        by[w].add(int(x))
    assert all(len(x) == 1 for x in by.values()) and len({min(x) for x in by.values()}) == len(by)


@pytest.mark.parametrize("part", [400_000, 25])
def test_components(spark, monkeypatch, part):
    monkeypatch.setattr(cc, "PART_EDGES", part)
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(5, 5), (None, 1)]
    par = {}

    def root(x):
        par.setdefault(x, x)
        while par[x] != x:
            x = par[x]
        return x

    for u, v in edges:
        if u is not None and u != v:
            a, b = root(u), root(v)
            par[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for x in par if root(x) != x}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# 1 quality rules


def quality_model(t):
    w, text = words(t), t or ""
    at = defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    covered = {i + j for p in at.values() if len(p) > 1 for i in p for j in range(5)}
    lines = [x for x in text.split("\n") if words(x)]
    n, r = len(w), len(covered)
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), r, n < 10 or 100 * r > 20 * n)


def test_quality_counts(spark, docs, rows, none):
    labels = spark.createDataFrame([(1, 1), (None, 0), (999, 1)], "doc_id long, quality int")
    got = quality_rules.quality_rules(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    same(got.collect(), [(r[0], *(m := quality_model(r[1])), not m[-1]) for r in rows])
    assert quality_rules.quality_rules(none, labels).count() == 0
    same(quality_rules.keep_good(docs, labels).collect(), [r for r in rows if not quality_model(r[1])[-1]])


def test_binomial_tail(spark):
    cases = [(0, 10), (1, 700), (3, 2000), (9, 1000), (40, 1000), (0, 0), (120, 20000)]
    df = spark.createDataFrame(cases, "k long, n long").select("k", "n", quality_rules.binomial_tail(F.col("k"), F.col("n"), 0.01).alias("p"))
    for r in df.collect():
        logs = [math.lgamma(r["n"] + 1) - math.lgamma(i + 1) - math.lgamma(r["n"] - i + 1) + i * math.log(0.01) + (r["n"] - i) * math.log(0.99) for i in range(r["k"] + 1)]
        want = sum(map(math.exp, logs)) if r["k"] < 0.01 * r["n"] else 1.0
        assert abs(r["p"] - want) < 1e-9 * max(want, 1e-3)


def test_certified_cutoffs(spark):
    """A rule that splits labels well is certified; one whose cutoff would reject good documents is not."""
    good = [(i, "word and " * 0 + " ".join(WORDS) + f" n{i}", "en", 1) for i in range(6000)]
    bad = [(10000 + i, " ".join(w + "###" for w in WORDS) + f" n{i}", "en", 0) for i in range(300)]
    df = spark.createDataFrame([(i, t, lang) for i, t, lang, _ in good + bad], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, q) for i, _, _, q in good + bad], "doc_id long, quality int")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(df, labels).collect()}
    assert not any(kept[i] for i, *_ in bad) and all(kept[i] for i, *_ in good)
    few = labels.where("doc_id % 50 = 0")  # too few labels certify nothing
    assert all(r["kept"] for r in quality_rules.quality_rules(df, few).collect())


# 2 WARC


def warc_model(pages):
    best = {}
    for k, _, h in pages:
        p = (h or "").encode()
        if k is not None:
            best[p] = min(best.get(p, k), k)
    taken, out = set(), []
    for k, _, h in sorted(pages, key=lambda r: (r[0] is not None, r[0] or 0)):
        p = (h or "").encode()
        first = k == best.get(p) and p not in taken
        taken |= {p} if first else set()
        out.append((k, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if first else "revisit", None if first else best.get(p)))
    return out


PAGES = [(1, "u", "a"), (2, "u", "a"), (3, None, None), (4, "x", ""), (2, "u", "a"), (1, "v", "a"), (9, "é\r\n", "ü\r\n\r\n" * 5000), (None, "n", "zz"), (None, "n", "zz"), (5, "n", "zz"), (-7, "m", "zz")]


@pytest.mark.parametrize("pages", [PAGES, [], [(i, "u", "same" if i % 3 else f"p{i}" * 50) for i in range(400)]])
def test_warc(spark, tmp_path, pages):
    df = spark.createDataFrame([(*p, 0, "x") for p in pages], "page_id long, url string, html string, shard int, `key` string")
    manifests = []
    for k, frame in enumerate((df, df.repartition(5))):
        folder = f"file://{tmp_path}/{k}"
        manifests.append(sorted(map(tuple, warc.write_archive(frame, folder, 4000, 3000).select("name", "bytes", "digest").collect())))
        got = warc.read_archive(spark, folder)
        same(got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect(), warc_model(pages))
        assert got.where("not intact").count() == 0
    assert manifests[0] == manifests[1]
    files = {p.name: p for p in (tmp_path / "0").iterdir()}
    assert "_SUCCESS" in files and "_temporary" not in files
    for name, size, digest in manifests[0]:
        data = files[name].read_bytes()
        assert len(data) == size and hashlib.sha1(data).hexdigest() == digest


def test_warc_shards_are_even_in_bytes(spark, tmp_path, monkeypatch):
    """Sizes that grow with the key, a key that a third of all rows have, and more shards than are compared one by one."""
    rng = random.Random(7)
    rows = [(i if i % 3 else 5, f"u{i}", "".join(rng.choice("abcdefgh") for _ in range(i))) for i in range(400)] + [(None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {}
    for few in (64, 2):
        monkeypatch.setattr(warc, "FEW", few)
        folder = f"file://{tmp_path}/{few}"
        manifest = warc.write_archive(df, folder, 4000, 1 << 20).collect()
        got[few] = sorted((r["name"], r["digest"]) for r in manifest)
        read = warc.read_archive(spark, folder).collect()
        assert len({r["shard"] for r in manifest}) == 20 and len(read) == len(rows) and all(r["intact"] for r in read)
        assert sorted((r["payload"] or b"").decode() for r in read if r["record_type"] == "response") == sorted({r[2] or "" for r in rows})
        assert all(r["payload"] is None for r in warc.read_archive(spark, folder, payload=False).collect())
        assert max(r["bytes"] for r in manifest) < 4000 + 400 + 500 * max(r["records"] for r in manifest)
    assert got[64] == got[2]


# 3 token counts


def test_token_counts(docs, rows, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    n = lambda x: len(t.encode(x or "", add_special_tokens=False).ids)
    same(token_counts.token_counts(docs, "byte_bpe_50k.json").collect(), [(r[0], len((r[1] or "").encode()), n(r[1]), n(r[1]) > 512) for r in rows])
    assert token_counts.token_counts(none, "byte_bpe_50k.json").count() == 0


def test_prefix_tables():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t, c, rng = Tokenizer.from_file(path), token_counts.PrefixCounter(path), random.Random(1)
    n = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    for _ in range(60):
        s = "".join(rng.choice(["<|endoftext|>", "<|endo", " ", "  ", "'", "s", "re", "ll", "\n", "日", "é", "the", "ing", "1", "🙂", "!", "\t", "́"]) for _ in range(12))
        p = c.prefix_table(s)
        assert [p.at(i) for i in range(len(s) + 1)] == [n(s[:i]) for i in range(len(s) + 1)]
        for budget in (0, 1, 4, 100):
            cut = p.truncate(budget)
            assert n(s[:cut]) <= budget and (cut == len(s) or n(s[: cut + 1]) > budget)
    for text in ("a" * 70, "abab" * 20, " " * 90 + "x", "日本語の文章" * 8, "-" * 80 + "!<|endoftext|>", "\n \n  x\r\n\r\n  <|endoftext|>  <|endoftext|>y", "it're we've !'ll 'l 've"):
        assert c.prefix_counts(text).tolist() == [n(text[:i]) for i in range(len(text) + 1)], text
    word = "internationalisation"
    assert c.table(word.encode()) == [n(word[:i]) for i in range(len(word) + 1)]


def test_long_runs_take_time_in_proportion():
    c = token_counts.counter("byte_bpe_50k.json")
    for run in ("a", "ab", " ", "-", "語", "the"):
        text = run * (100_000 // len(run))
        began = time.process_time()
        assert c.prefix_counts(text)[-1] == c.count(text)
        assert time.process_time() - began < 12, run


def test_stored_tables(spark, docs, rows, none):
    c = token_counts.counter("byte_bpe_50k.json")
    tables = token_counts.prefix_counts(docs, "byte_bpe_50k.json").select("doc_id", "counts", token_counts.longest_prefix(F.col("counts"), 5).alias("chars")).collect()
    want = [(r[0], (p := c.prefix_table(r[1] or "")).counts.tolist(), p.truncate(5)) for r in rows]
    same([(r["doc_id"], list(r["counts"]), r["chars"]) for r in tables], want)
    assert token_counts.prefix_counts(none, "byte_bpe_50k.json").count() == 0


# 4 mixing


def mix_model(sizes, budget=1.5, cap=2.0):
    by = Counter()
    for s, n in sizes:
        by[s] += n
    order = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), budget * sum(by.values())
    while open_:
        level = left / sum(w[s] for s in open_)
        over = [s for s in open_ if level * w[s] > cap * by[s]]
        if not over:
            target |= {s: level * w[s] for s in open_}
            break
        for s in over:
            target[s] = cap * by[s]
            left -= target[s]
            open_.discard(s)
    return by, target


def test_mixing(spark, docs, rows, none):
    sizes = [(r[3], len(words(r[1]))) for r in rows]
    by, target = mix_model(sizes)
    got = mixing.mixing_report(docs).collect()
    assert sorted(map(str, (r["doc_id"] for r in got))) == sorted(str(r[0]) for r in rows)
    source = {r[0]: r[3] for r in rows if r[0] is not None}
    for r in got:
        if r["doc_id"] is not None:
            s = source[r["doc_id"]]
            assert r["source_size"] == by[s] and abs(r["target"] - target[s]) < 1e-6 * by[s] + 1e-9
        assert r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
    same(mixing.mixing_report(docs.repartition(7)).collect(), got)
    taken = Counter((r["doc_id"], r["taken"] // r["size"]) for r in got if r["size"])
    mixed = Counter(r["doc_id"] for r in mixing.mix_documents(docs).where("text is not null").collect() if words(r["text"]))
    assert sum(n * k for (_, k), n in taken.items()) == sum(mixed.values())
    assert mixing.mix_documents(docs).columns == docs.columns and mixing.mixing_report(none).count() == 0 == mixing.mix_documents(none).count()


def test_rows_of_one_key_come_near_their_target(spark):
    """A source made of one repeated row, and one of a repeated key with many texts, are thinned to their targets."""
    rows = [(1, "one two three", "a")] * 3000 + [(None, f"w{i} x", "b") for i in range(2000)] + [(10 + i, "long text " * 5, "c") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    report = mixing.mixing_report(df, budget=0.5).join(df.select("doc_id", "source").distinct(), "doc_id", "left")
    for r in report.where("doc_id = 1 or doc_id is null").groupBy("doc_id").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect():
        assert abs(r["taken"] - r["target"]) < 0.12 * r["target"] + 60, r
    mixed = mixing.mix_documents(df, budget=0.5).groupBy("source").count().collect()
    assert sorted((r["source"], r["count"]) for r in mixed if r["source"] != "c") == sorted(
        (s, int(r["n"])) for s, k in (("a", "doc_id = 1"), ("b", "doc_id is null")) for r in report.where(k).agg(F.sum(F.expr("taken / size")).alias("n")).collect()
    )


def test_many_sources_are_summed_in_ranges(spark):
    rows = [(i, "w " * (i % 17), f"host{i % 500}" if i % 501 else None) for i in range(3000)]
    by, target = mix_model([(r[2], len(r[1].split())) for r in rows])
    got = mixing.source_targets(spark.createDataFrame([(r[2], len(r[1].split())) for r in rows], "source string, size long").repartition(6), 1.5, 2.0, (5, 2, 1)).collect()
    assert len(got) == len(by) and all(abs(r["target"] - target[r["source"]]) < 1e-6 * max(1, by[r["source"]]) for r in got)


def test_mixing_comes_near_its_targets(spark):
    df = spark.createDataFrame([(i, "w " * (1 + i % 7), f"s{i % 4}") for i in range(20000)], "doc_id long, text string, source string")
    got = mixing.mixing_report(df).join(df.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g"), F.max("source_size").alias("s")).collect()
    by, target = mix_model([(f"s{i % 4}", 1 + i % 7) for i in range(20000)])
    for r in got:
        assert abs(r["g"] - target[r["source"]]) < 1e-6 and abs(r["t"] - r["g"]) < 0.03 * r["g"]


# 5 sharding


def test_sharding(docs, rows, none, spark):
    got = sharding.shard_records(docs, [1.0] * 24).collect()
    same([(r["doc_id"], r["size"], r["text_crc32"], r["law"]) for r in got], [(r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode()), "key") for r in rows])
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 24)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(24))
    by = defaultdict(set)
    for r in got:
        by[r["doc_id"]].add(r["shard"])
    assert all(len(s) == 1 for s in by.values())
    more = {r["doc_id"]: r["shard"] for r in sharding.shard_records(docs, [1.0] * 25).collect()}
    assert all(more[r["doc_id"]] == r["grown_shard"] for r in got)
    assert sharding.shard_records(none, [1.0] * 24).count() == 0


def test_shares_follow_weights(spark):
    df = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    n = Counter(r["shard"] for r in sharding.shard_records(df, [1.0, 2.0, 1.0]).collect())
    assert abs(n[1] - 10000) < 400 and abs(n[0] - 5000) < 300


# 9 Jaccard join


def jaccard_model(docs, k, pct):
    sets, par = {}, {}
    for i, t in docs:
        w = [x.decode() for x in (t or "").encode().lower().split()]
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
        par[i] = i

    def root(x):
        while par[x] != x:
            x = par[x]
        return x

    ids = list(sets)
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            if x and y and 100 * len(x & y) >= pct * len(x | y):
                p, q = root(ids[a]), root(ids[b])
                par[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("k,pct", [(3, 90), (5, 80), (2, 60)])
def test_jaccard(spark, k, pct):
    rng = random.Random(k)
    base = [str(rng.randrange(1000)) for _ in range(60)]
    texts = [None, "", " "]
    for _ in range(350):
        if rng.random() < 0.4:  # near copies of near copies of one text
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = str(rng.randrange(1000))
        else:
            n = rng.choice([1, 2, 3, 4, 5, 9, 10, 11, 18, 19, 20, 21, 40])
            w = [str(x % 7) if rng.random() < 0.3 else str(x) for x in range(n)]
            for _ in range(rng.randrange(3)):
                w[rng.randrange(n)] = str(rng.randrange(3))
        texts.append(" ".join(w) if rng.random() < 0.9 else " ".join(w).upper())
    docs = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, node int, sig string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(df, k, pct).collect()}
    assert got == jaccard_model(docs, k, pct)
    kept = jaccard_join.one_of_each(df, k, pct)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, v in got.items() if v[1] == i)


def test_jaccard_edges(docs, none, rows):
    got = jaccard_join.jaccard_components(docs, 3, 90).collect()
    want = jaccard_model([(r[0], r[1]) for r in rows if r[0] is not None], 3, 90)
    same([tuple(r) for r in got if r["doc_id"] is not None], [(r[0], *want[r[0]]) for r in rows if r[0] is not None])
    assert sorted((r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is None and r["n_shingles"]) == [want[5]]
    assert jaccard_join.jaccard_components(none, 3, 90).count() == 0


def test_size_classes_lose_no_pair():
    for pct in (60, 80, 90):
        classes = jaccard_join.size_classes(pct, 100000)
        assert classes[0][0] == 1 and all(a[1] + 1 == b[0] for a, b in zip(classes, classes[1:]))
        for low, high, groups, spares in classes:
            assert groups - spares >= 2 * high * (100 - pct) // (100 + pct) + 1


def test_tree_join_keeps_what_the_bound_keeps():
    rng = np.random.default_rng(0)
    vec = rng.poisson(2, (200, jaccard_join.GROUPS)).astype(np.int32)
    vec[50:90] = vec[10] + rng.poisson(0.03, (40, jaccard_join.GROUPS))
    n, every = vec.sum(1).astype(np.int64), np.arange(200)
    a, b = jaccard_join.tree_pairs(n, vec, 80, every, every)
    want = jaccard_join.may_link(np.minimum(vec[:, None], vec[None]).sum(2), n[:, None] + n[None], 80)
    assert set(zip(a.tolist(), b.tolist())) == set(zip(*map(list, np.nonzero(want))))


def test_tree_join_descends():
    """A self-join gives each pair once, trees of different heights meet, and most boxes are never compared."""
    rng = np.random.default_rng(1)
    centres = rng.poisson(3, (40, 32))
    vec = (np.repeat(centres, 50, axis=0) + (rng.random((2000, 32)) < 0.01)).astype(np.int32)
    n, every = vec.sum(1).astype(np.int64), np.arange(2000)
    want = jaccard_join.may_link(np.minimum(vec[:, None], vec[None]).sum(2), n[:, None] + n[None], 90)
    tree = jaccard_join.Tree(n, vec, every)
    assert len(tree.levels) > 2 and sorted(tree.points.tolist()) == every.tolist()
    pairs = [tuple(sorted(p)) for a, b in jaccard_join.tree_join(n, vec, 90, jaccard_join.Tree(n, vec, every)) for p in zip(a.tolist(), b.tolist())]
    assert len(set(pairs)) == len(pairs) and set(pairs) == {(i, j) for i, j in zip(*map(list, np.nonzero(want))) if i < j}
    few = rng.permutation(2000)[:20]
    a, b = jaccard_join.tree_pairs(n, vec, 90, few, every)
    assert set(zip(a.tolist(), b.tolist())) == {(i, j) for i in few.tolist() for j in np.flatnonzero(want[i]).tolist()}


def test_cluster_links_connect_what_all_pairs_connect():
    """Thousands of near copies and strangers in one cluster: the same components as all pairs, with few pairs tried."""
    rng = random.Random(3)
    texts = []
    for family in range(6):
        base = [f"f{family}w{i}" for i in range(40)]
        for _ in range(60):
            w = list(base)
            for _ in range(rng.randrange(5)):
                w[rng.randrange(len(w))] = str(rng.randrange(50))
            texts.append(" ".join(w).encode())
    texts = sorted(set(texts))
    links = jaccard_join.cluster_links(list(range(len(texts))), texts, 3, 80)
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        p, q = root(a), root(b)
        assert p != q  # each link connects
        up[max(p, q)] = min(p, q)
    want = jaccard_model([(i, t.decode()) for i, t in enumerate(texts)], 3, 80)
    assert {i: root(i) for i in range(len(texts))} == {i: v[1] for i, v in want.items()}


def test_sketches_bound_the_overlap():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n, m = (int(rng.integers(1, 3000)) for _ in range(2))
        both = rng.integers(0, 2**63, int(rng.integers(0, min(n, m) + 1))).astype(np.uint64)
        x, y = (np.unique(np.concatenate([both, rng.integers(0, 2**63, k - len(both)).astype(np.uint64)])) for k in (n, m))
        assert len(np.intersect1d(x, y)) <= jaccard_join.sketch_bound(jaccard_join.sketch(x), jaccard_join.sketch(y)) <= min(len(x), len(y))
    same_group = np.arange(1, 2000, dtype=np.uint64)
    heavy = same_group[(bw.mix(same_group) % np.uint64(64)) == 5]
    assert jaccard_join.sketch_bound(jaccard_join.sketch(heavy), jaccard_join.sketch(heavy)) == len(heavy)


def test_meetings_connect_all_that_share():
    """Ties and pairs connect the nodes of every group, and no group is lost where rows are held in parts."""
    rng = np.random.default_rng(6)
    key = np.sort(rng.integers(0, 60, 900)) * 2
    node = rng.integers(0, 300, 900) * 2
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    key = np.concatenate([key, [998, 998]])
    node = np.concatenate([node, [700, 702]])
    sig = key.copy()
    us, vs, x, y = jaccard_join.meetings(key, sig, node)
    up = {}

    def root(i):
        while up.get(i, i) != i:
            i = up[i]
        return i

    for a, b in [*zip(us, vs), *zip(x.tolist(), y.tolist())]:
        p, q = root(a), root(b)
        up[max(p, q)] = min(p, q)
    for k in np.unique(key):
        assert len({root(i) for i in node[key == k].tolist()}) == 1
    assert (700, 702) in {(min(a, b), max(a, b)) for a, b in zip(x.tolist(), y.tolist())}
    rows = [pa.RecordBatch.from_arrays([pa.array(c[i : i + 50]) for c in (key, sig, node)], names=["key", "sig", "node"]) for i in range(0, len(key), 50)]
    held, jaccard_join.HELD = jaccard_join.HELD, 100
    try:
        up.clear()
        for b in jaccard_join._met(iter(rows)):
            for a, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                p, q = root(a), root(c)
                up[max(p, q)] = min(p, q)
    finally:
        jaccard_join.HELD = held
    for k in np.unique(key):
        assert len({root(i) for i in node[key == k].tolist()}) == 1


def thue_morse(n, a, b):
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


def test_structured_words_do_not_link(spark):
    """Words on which sums and polynomials modulo 2**64 agree."""
    a, b = thue_morse(2048, "a", "b"), thue_morse(2048, "b", "a")
    docs = [(1, "one two " + a), (2, "one two " + b), (3, a), (4, b), (5, thue_morse(64, "a", "b")), (6, thue_morse(64, "b", "a")), (7, "one two " + a)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), 3, 90).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (1, 3), 4: (1, 4), 5: (1, 5), 6: (1, 6), 7: (1, 1)}


def test_one_row_of_each_group(spark):
    """Repeated rows, null keys and keys of several texts."""
    rng = random.Random(8)
    text = lambda: " ".join(str(rng.randrange(10**6)) for _ in range(40))
    a, b, c, d, e = (text() for _ in range(5))
    near = a + " end"
    rows = [(5, a, 1), (5, a, 1), (3, near, 2), (3, b, 3), (4, b, 4), (None, a, 5), (None, c, 6), (None, c, 7), (9, d, 8), (9, e, 9), (2, d, 10), (7, None, 11), (7, None, 12), (None, "", 13)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __n int").repartition(3)
    kept = jaccard_join.one_of_each(df, 5, 80)
    assert kept.columns == df.columns
    got = sorted(kept.collect(), key=lambda r: r["__n"])
    # a and near: row 3; b: row 3 (least key 3); c: either; d: row 10; e: alone; no words: all stay
    assert [(r["doc_id"], r["text"]) for r in got if r["__n"] not in (6, 7)] == [(3, near), (3, b), (9, e), (2, d), (7, None), (7, None), (None, "")]
    assert len([r for r in got if r["__n"] in (6, 7)]) == 1


@pytest.mark.parametrize("cell", [3, 1024])
def test_hot_contents_lose_no_link(spark, monkeypatch, cell):
    """Contents that many sampled documents share go to a leader known beforehand, with the same result."""
    rng = random.Random(5)
    base = [str(rng.randrange(1000)) for _ in range(60)]
    docs = []
    for i in range(150):
        w = list(base) if i < 100 else [str(rng.randrange(1000)) for _ in range(30)] + base[:20]
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = str(rng.randrange(1000))
        docs.append((i, " ".join(w)))
    monkeypatch.setattr(jaccard_join, "HOT_DOCS", 4)
    monkeypatch.setattr(jaccard_join, "CELL", cell)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), 3, 80).collect()}
    assert got == jaccard_model(docs, 3, 80)


# 10 top-k


def topk_model(rows, k):
    good = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, x in {i: v for i, v in good if i % 5 == 0}.items():
        for x in [v for i, v in good if i == q]:
            best = sorted(((-sum(a * b for a, b in zip(x, v)), i) for i, v in good if i != q))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out


def topk_model_of(rows, k, every):
    out = []
    for q, x in rows:
        if q % every == 0:
            score = lambda y: sum(math.floor(256 * a) * math.floor(256 * b) for a, b in zip(x, y))
            best = sorted((-score(y), i) for i, y in rows if i != q)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return out


def test_topk(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).round(2).tolist()) for i in range(200)]
    rows[7] = (7, rows[3][1])
    rows += [(300, None), (301, [1.0, None]), (305, [float("nan")]), (310, []), (315, [1.0]), (None, [1.0, 2.0]), (320, [float("inf")]), (401, rows[0][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, q int").repartition(3)
    want = topk_model(rows, 5)
    same(topk.top_k(df, F.col("vec_id") % 5 == 0).collect(), want)
    for name, n in (("CELL", 32), ("CHUNK", 8), ("BLOCK", 4)):
        monkeypatch.setattr(topk, name, n)
    same(topk.top_k(df, F.col("vec_id") % 5 == 0).collect(), want)
    assert topk.top_k(df.where("false"), F.col("vec_id") % 5 == 0).count() == 0
    assert topk.top_k(df.where("vec_id = 0"), F.col("vec_id") % 5 == 0).count() == 0


def test_large_weights_stay_exact():
    q, d = np.array([[2**31, -(2**31)]]), np.array([[2**31, 1], [1, 2**31]])
    assert topk._product(q, d).tolist() == [[2**62 - 2**31, 2**31 - 2**62]]


def test_huge_components_stop_at_the_ends_of_a_long(spark):
    big = [(0, [1e19, 0.0]), (1, [1e19, 1.0]), (2, [-1e19, 1.0]), (3, [2.0**40, 0.0]), (4, [1e307, 1.0]), (5, [0.5, 0.25]), (6, [1e19, 7.0])]
    df = spark.createDataFrame(big, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("vec_id") % 5 == 0).collect()}
    top, least = 2**63 - 1, -(2**63) + 1
    # 4 has no finite 256-fold; equal ends of the range go to the smaller key
    assert got == {
        (0, 1): (1, top), (0, 2): (3, top), (0, 3): (5, top), (0, 4): (6, top), (0, 5): (2, least),
        (5, 1): (0, top), (5, 2): (1, top), (5, 3): (6, top), (5, 4): (3, 128 << 48), (5, 5): (2, least),
    }


def test_queries_go_only_where_bounds_reach(spark, monkeypatch):
    """Documents in far apart bundles: a query leaves its own cell only for those that its bound lets in."""
    monkeypatch.setattr(topk, "CELL", 20)
    rng = np.random.default_rng(5)
    rows = [(i, (10 * np.eye(8)[i % 8] + rng.random(8)).tolist()) for i in range(800)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    seen = []
    monkeypatch.setattr(topk.scratch, "written", lambda frame, label, f=topk.scratch.written: seen.append((label, f(frame, label))) or seen[-1][1])
    same(topk.top_k(df, F.col("vec_id") % 10 == 0).collect(), topk_model_of(rows, 5, 10))
    tables = dict(seen)
    sent = sum(len(r["ids"]) // 8 for r in tables["sent"].collect())
    assert tables["cells"].count() >= 40 and 0 < sent < 80 * tables["cells"].count() / 3


# 7 pieces


@pytest.fixture(scope="module")
def vocab():
    return Vocabulary(public_tokenizers.path("piece_bpe_32k.model"))


def test_pieces_are_lossless(docs, rows, none, vocab):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = piece_sampling.encode(docs).collect()
    assert len(got) == len(rows) and all(r["lossless"] for r in got)
    text = {r[0]: r[1] for r in rows}
    for r in got:
        if r["doc_id"] is not None:
            t = text[r["doc_id"]]
            assert (r["ids"] is None) == (t is None) and r["n_pieces"] == len(r["ids"] or [])
            if t is not None:
                assert piece_sampling.decode(vocab, r["ids"]) == t == sp.decode(r["ids"])
    again = piece_sampling.encode(docs.repartition(6).select("text", "doc_id"))
    same(again.select("doc_id", "ids").collect(), [(r["doc_id"], r["ids"]) for r in got])
    other = {r["doc_id"]: r["ids"] for r in piece_sampling.encode(docs, seed=2).collect()}
    assert any(other[r["doc_id"]] != r["ids"] for r in got)
    assert piece_sampling.encode(none).count() == 0


def test_samples_follow_the_lattice(vocab):
    """Frequencies of sampled segmentations are those of the products of weights."""
    w, n, text = piece_sampling.weights(vocab, 0.5), 20000, b"theing"
    by = {vocab.bytes[i]: i for i in vocab.plain}

    def segmentations(b):
        if not b:
            yield (), 1.0
        for k in range(1, len(b) + 1):
            if b[:k] in by:
                for rest, x in segmentations(b[k:]):
                    yield (by[b[:k]], *rest), x * w[by[b[:k]]]

    buf, off = marked(np.frombuffer(text * n, np.uint8), np.arange(n + 1) * len(text))
    ids, count = piece_sampling.sample_block(vocab, w, buf, off, bw.mix(np.arange(n, dtype=np.uint64)))
    ends = np.concatenate([[0], np.cumsum(count)])
    got = Counter(tuple(ids[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:]))
    want = dict(segmentations(b" " + text))
    total = sum(want.values())
    likely = {s: x * n / total for s, x in want.items() if x * n / total > 5}
    assert set(got) <= set(want) and sum((got[s] - x) ** 2 / x for s, x in likely.items()) < 3 * len(likely) + 10


# 6 language


def test_forward_sums_all_segmentations(vocab):
    p = np.random.default_rng(0).dirichlet(np.ones(vocab.size))
    by = {vocab.bytes[i]: i for i in vocab.plain}

    def total(b):
        return 1.0 if not b else sum(p[by[b[:k]]] * total(b[k:]) for k in range(1, len(b) + 1) if b[:k] in by)

    raw = [b" the", b" zebra", b" the", b" q"]
    end = np.cumsum([len(r) for r in raw])
    log, which = language_id.score_words(vocab, (p * language_id.BYTE_FACTOR**vocab.lengths)[:, None], np.frombuffer(b"".join(raw), np.uint8), end - [len(r) for r in raw], end)
    for i, r in enumerate(raw):
        assert abs(log[which[i], 0] - math.log(total(r))) < 1e-9


def unit_sums(vocab, w, unit):
    """Exact sums of products of weights up to and from each byte of a unit, by recursion over its pieces."""
    by = {vocab.bytes[i]: i for i in vocab.plain}
    begins = [i for i in range(len(unit)) if unit[i] & 0xC0 != 0x80] + [len(unit)]
    edges = [(a, b, by[unit[a:b]]) for x, a in enumerate(begins) for b in begins[x + 1 :] if unit[a:b] in by]
    spelt = {i for a, b in zip(begins, begins[1:]) if unit[a:b] not in by for i in range(a, b)}
    edges += [(i, i + 1, int(vocab.byte_ids[unit[i]])) for i in spelt]
    up, down = [Fraction(0)] * (len(unit) + 1), [Fraction(0)] * (len(unit) + 1)
    up[0] = down[-1] = Fraction(1)
    for a, b, p in sorted(edges, key=lambda e: e[1]):
        up[b] += up[a] * Fraction(float(w[p]))
    for a, b, p in sorted(edges, key=lambda e: -e[0]):
        down[a] += down[b] * Fraction(float(w[p]))
    return up, down, edges


def exact_log(x):
    return math.log(x.numerator) - math.log(x.denominator)


LONG_UNITS = ["x" * 41, "abcdefghij" * 13, "日本語の文章です" * 12, "ü日a" * 30, "donaudampfschifffahrt" * 6, "🙂" * 20]


@pytest.mark.parametrize("text", LONG_UNITS)
def test_long_units_are_summed_whole(vocab, text):
    """Words and units of any length against exact sums: forward, backward, language scores and sampled shares."""
    unit = b" " + text.encode()
    buf, ends = np.frombuffer(unit, np.uint8), np.array([len(unit)])
    w = np.random.default_rng(3).dirichlet(np.ones(vocab.size)) * language_id.BYTE_FACTOR**vocab.lengths
    up, down, edges = unit_sums(vocab, w, unit)
    lattice = Lattice(vocab, buf, bw.Hashes(buf), np.zeros(1, np.int64), ends)
    assert sorted(zip(lattice.src.tolist(), lattice.dst.tolist(), lattice.piece.tolist())) == sorted(edges)
    for (a, power), want in ((lattice.scaled(w), up), (lattice.scaled(w, back=True), down)):
        for i, x in enumerate(want):
            assert (a[i] == 0) == (x == 0) and (not x or abs(math.log(a[i]) + power[i] * math.log(2) - exact_log(x)) < 1e-9)
    log, which = language_id.score_words(vocab, w[:, None], buf, np.zeros(1, np.int64), ends)
    assert abs(log[which[0], 0] - (exact_log(up[-1]) - len(unit) * math.log(language_id.BYTE_FACTOR))) < 1e-8
    s = piece_sampling.weights(vocab, 0.5)
    up, _, edges = unit_sums(vocab, s, unit)
    src, piece, key = piece_sampling._edges(lattice, s, False)
    below = dict.fromkeys(range(len(unit) + 1), Fraction(0))
    for a, p, q in zip(src.tolist(), piece.tolist(), key.tolist()):
        d = q >> 32
        assert abs((q & 0xFFFFFFFF) - float(below[d] / up[d] * 2**32)) < 2
        below[d] += up[a] * Fraction(float(s[p]))


def test_samples_of_long_units_follow_the_lattice(vocab):
    """Each place of a long unit is a border as often as the sums up to it and from it say."""
    text = ("wissenschaft" * 12).encode()
    n, w = 400, piece_sampling.weights(vocab, 0.5)
    buf, off = marked(np.frombuffer(text * n, np.uint8), np.arange(n + 1) * len(text))
    ids, count = piece_sampling.sample_block(vocab, w, buf, off, bw.mix(np.arange(n, dtype=np.uint64)))
    ends = np.concatenate([[0], np.cumsum(count)])
    borders = np.zeros(len(text) + 2, np.int64)
    for i in range(n):
        own = ids[ends[i] : ends[i + 1]]
        assert b"".join(vocab.bytes[j] for j in own) == b" " + text
        borders[np.cumsum(vocab.lengths[own])] += 1
    up, down, _ = unit_sums(vocab, w, b" " + text)
    share = np.array([float(a * b / up[-1]) for a, b in zip(up, down)])
    share[0] = 0
    assert (np.abs(borders - n * share) < 5 * np.sqrt(n * share * (1 - share)) + 1).all()


def test_language_learns_from_long_words(spark):
    """Languages without a space are learnt and told apart."""
    rng = random.Random(2)
    some = {"ja": "日本語文章言葉水家人大", "xx": "зданиеводачеловек"}
    rows = [(i, "".join(rng.choice(some[lang]) for _ in range(rng.randrange(60, 2000))), lang) for i in range(80) for lang in [rng.choice(["ja", "xx"])]]
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)).collect()}
    assert got == {i: lang for i, _, lang in rows}


def languages(n):
    rng = random.Random(8)
    stems = {"aa": "the of and with water house".split(), "bb": "der und nicht wasser haus für".split(), "cc": "le une pas maison être où".split()}
    return [(i, " ".join(rng.choice(stems[lang]) + rng.choice(["", "", "s", ","]) for _ in range(rng.randrange(3, 30))), lang) for i in range(n) for lang in [rng.choice(list(stems))]]


def test_language(spark, none):
    rows = languages(900)
    df = spark.createDataFrame([(i, t, lang, None, "x") for i, t, lang in rows] + [(5000, None, "aa", None, "x"), (5001, "12 !?", "bb", None, "x"), (None, "the house", None, None, "x")], "doc_id long, text string, lang string, source string, score string").repartition(3)
    got = language_id.identify(df).collect()
    by = {r["doc_id"]: r for r in got}
    held = [(by[i]["lang_pred"], lang) for i, _, lang in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 150 and sum(a == b for a, b in held) / len(held) > 0.97
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    assert by[5000]["lang_pred"] == by[5001]["lang_pred"] == "und" and by[None]["lang_pred"] == "aa"
    # what is held out is not learnt from
    shuffled = df.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, "zz").otherwise(F.col("lang")))
    same(language_id.identify(shuffled).collect(), got)
    kept = language_id.keep_identified(df)
    assert kept.columns == df.columns and {5000, 5001}.isdisjoint({r["doc_id"] for r in kept.collect()}) and kept.count() >= 890
    assert language_id.identify(none).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# 8 toxicity


def test_toxicity(spark, none):
    rng = random.Random(6)
    rows, marks = [], []
    for i in range(3000):
        w = [rng.choice(WORDS) for _ in range(rng.randrange(5, 60))]
        toxic = int(rng.random() < 0.12)
        if toxic:
            sign = rng.choice([["idiot", "scum", "moron", "trash"], ["vorbaxen", "vorbaxte", "vorbaxung"]])
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(sign)
        rows.append((i, " ".join(w), None, "a"))
        marks.append((i, toxic, 1))
    rows += [(7000, None, None, "a"), (7001, "", None, "a"), (None, "you idiot, you moron", None, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic string").repartition(3)
    labels = spark.createDataFrame(marks + [(None, 1, 1), (8000, None, 0), (8001, 1, 1)], "doc_id long, toxic int, quality int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(df, labels).collect()}
    held = [(got[i]["predicted"], t) for i, t, _ in marks if zlib.crc32(str(i).encode()) % 4 == 2]
    hit, told, there = sum(a and b for a, b in held), sum(a for a, _ in held), sum(b for _, b in held)
    assert hit / there > 0.9 and hit / told > 0.9
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got.values())
    assert got[7000]["score"] == got[7001]["score"] < 0.3 and got[None]["predicted"] == 1
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    same([tuple(r) for r in toxicity.toxicity(df, flipped).collect()], [tuple(r) for r in got.values()])
    assert toxicity.toxicity(none, labels).count() == 0
    assert {r["score"] for r in toxicity.toxicity(df, labels.where("false")).collect()} == {0.0}


def all_votes(m):
    return np.array([[v >> j & 1 for j in range(m)] for v in range(2**m)], float)


def test_label_model_is_a_distribution():
    """Probabilities of all votes and kinds against products by hand; they sum to 1, and posteriors are their shares."""
    rng = np.random.default_rng(4)
    parent = np.array([-1, 0, 0, -1, 3])
    model = toxicity.LabelModel(np.array([0.6, 0.3, 0.1]), parent, rng.uniform(0.05, 0.95, (5, 2, 3)))
    votes = all_votes(5)
    want = np.array([[model.share[s] * math.prod(x if f[j] else 1 - x for j in range(5) for x in [model.rate[j, int(f[parent[j]]) if parent[j] >= 0 else 0, s]]) for s in range(3)] for f in votes])
    assert abs(want.sum() - 1) < 1e-9 and np.allclose(np.exp(model.joint(votes)), want)
    assert np.allclose(model.posterior(votes), want[:, 1:].sum(1) / want.sum(1)) and abs(model.likelihood(votes) - np.log(want.sum(1)).sum()) < 1e-9
    assert model.groups().tolist() == [0, 0, 0, 1, 1]


def test_label_model_learns_from_agreements():
    """Without a label: rates, a tie and kinds of votes drawn from a known model; rounds raise the likelihood."""
    rng = np.random.default_rng(9)
    n = 6000
    kind = rng.choice(2, n, p=[0.8, 0.2])
    own = np.where(kind[:, None] == 1, [0.7, 0.6, 0.8, 0.5], [0.02, 0.03, 0.02, 0.04])
    f = (rng.random((n, 4)) < own).astype(float)
    twin = np.where(rng.random(n) < 0.9, f[:, 0], rng.random(n) < 0.3)  # mostly says what voter 0 says
    f = np.column_stack([f, twin])
    model = toxicity.label_model(f, (f.sum(1) >= 2).astype(int))
    assert abs(model.share[1] - 0.2) < 0.03
    assert np.abs(np.stack([model.rate[[1, 2, 3], 0, 0], model.rate[[1, 2, 3], 0, 1]], 1) - [[0.03, 0.6], [0.02, 0.8], [0.04, 0.5]]).max() < 0.05
    assert model.parent[4] == 0 or model.parent[0] == 4
    assert ((model.posterior(f) > 0.5) == (kind == 1)).mean() > 0.96
    r, last = np.eye(2)[(f.sum(1) >= 2).astype(int)], -np.inf
    for _ in range(8):
        fit = toxicity.refit(f, r, model.parent)
        assert fit.likelihood(f) > last - 1.0  # smoothing aside
        last, r = fit.likelihood(f), fit.kinds(f)
    # the forest is the heaviest of all
    both = toxicity.forest(f, r, tie=-1.0)
    assert (both >= 0).sum() == 4


def test_repeated_labels_stay_within_the_sample(spark):
    """A key with a third of all labels and rows is one row of the sample."""
    docs = spark.createDataFrame([(i % 200 if i % 3 else 1, f"text {i % 7}") for i in range(600)], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 200 if i % 3 else 1, i % 2) for i in range(600)], "doc_id long, toxic int")
    keys = {j % 200 if j % 3 else 1 for j in range(600)}
    assert toxicity.learning_rows(docs, labels, 10**6).count() == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in keys)


@pytest.mark.parametrize("cell", [2, 30])
def test_jaccard_with_large_clusters(spark, monkeypatch, cell):
    """Clusters beyond one task's size are worked off tree by tree, with the same result."""
    rng = random.Random(cell)
    base = [str(rng.randrange(1000)) for _ in range(50)]
    docs = []
    for i in range(220):
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = str(rng.randrange(1000))
        docs.append((i, " ".join(w if rng.random() < 0.8 else w[: rng.randrange(1, 20)])))
    monkeypatch.setattr(jaccard_join, "CELL", cell)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), 3, 80).collect()}
    assert got == jaccard_model(docs, 3, 80)
