"""Sentence boundaries: a brute-force model over lists of tokens, and texts whose abbreviations must not be split."""

import math
import random
import re
import unicodedata
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodegauge.functions.text import normalize_offsets
from lodegauge.operators import punkt


def corpus():
    rng = random.Random(11)
    nouns = "house river letter garden window table street doctor paper evening morning number winter".split()
    verbs = "saw met found left heard followed answered".split()
    some = lambda: f"{rng.choice(['The', 'A', 'This', 'However the', 'Every'])} {rng.choice(nouns)} {rng.choice(verbs)} the {rng.choice(nouns)}"
    extra = [" and Dr. Brown", " near Mr. Smith", " of the U.S. army", " with J. Miller", ", e.g. the garden,", " on 5. March", ", the rest etc.", " ... and the others", " at p. 12", ' ("so it was.")', ""]
    docs = []
    for i in range(160):
        docs.append((str(i), ["en", "en", "xx", None][i % 4], " ".join(some() + rng.choice(extra) + rng.choice([".", ".", ".", "!", "?"]) for _ in range(rng.randrange(1, 40)))))
    return [*docs, docs[5], ("n", "en", None), ("e", "en", ""), ("b", None, " \t\n"), ("one", "en", "word"), (None, "en", docs[0][2]), ("dots", "en", '... . .. "." ?! …'), ("long", "zz", "a. B. c. " * 3000)]


def features(token):
    core = re.sub(rf"{punkt.CLOSERS}+$", "", re.sub(f"^{punkt.OPENERS}+", "", token))
    kind = "mark" if core[-1:] in ("!", "?") and core else "ellipsis" if core.endswith(("..", "…")) else "period" if core.endswith(".") else "none"
    word = core.rstrip(".!?…,;:").lower()
    first = unicodedata.category(core[0]) if core else ""
    return kind, "#" if re.match(punkt.NUMBER, word) else word, {"Lu": "u", "Ll": "l"}.get(first) or ("p" if core[:1] in tuple(";:,.!?") and core else "-")


def ratio(a, b, k, n):
    def part(x, p):
        return x * math.log(p) if x > 0 else 0

    rest = n - a - b + k
    return -2 * (part(k, b / n) + part(a - k, 1 - b / n) + part(b - k, b / n) + part(rest, 1 - b / n) - part(k, k / a) - part(a - k, 1 - k / a) - part(b - k, (b - k) / (n - a) if n > a else 1) - part(rest, 1 - (b - k) / (n - a) if n > a else 1))


def model(docs):
    """(docid, start, end) of all sentences, and each language's abbreviations."""
    tokens = [(d, lang or "", [t for t in re.split(r"\s+", (text or "").strip()) if t]) for d, lang, text in docs]
    out, known = [], {}
    for lang in {t[1] for t in tokens}:
        mine = [(d, ts, [features(t) for t in ts]) for d, x, ts in tokens if x == lang]
        every = [f for _, _, fs in mine for f in fs]
        n, stops = len(every), sum(f[0] == "period" for f in every)
        count, stopped = Counter(f[1] for f in every), Counter(f[1] for f in every if f[0] == "period")
        abbreviations = set()
        for w, k in stopped.items():
            if w != "#" and any(c.isalpha() for c in w):
                p, c = min(stops / n, 1 - 1e-9), count[w]
                dots = w.count(".")
                size = len(w) - dots
                score = -2 * (k * math.log(p) + (c - k) * math.log(1 - p) - k * math.log(0.99) - (c - k) * math.log(0.01)) * math.exp(-size) * (dots + 1) * float(size) ** -(c - k)
                if score >= punkt.ABBREVIATION:
                    abbreviations.add(w)
        known[lang] = abbreviations
        nexts = [(("start", "", "-") if i == 0 else fs[i - 1], f) for _, _, fs in mine for i, f in enumerate(fs)]
        cut = lambda a: a[0] == "mark" or (a[0] == "period" and a[1] not in abbreviations)
        after, breaks = Counter(b[1] for a, b in nexts if cut(a)), sum(cut(a) for a, _ in nexts)
        letter = lambda w: any(c.isalpha() for c in w)
        starters = {w for w, k in after.items() if letter(w) and n * k > count[w] * breaks and ratio(breaks, count[w], k, n) >= punkt.STARTER}
        special = lambda w: w == "#" or (len(w) == 1 and w.isalpha())
        pairs = Counter((a[1], b[1]) for a, b in nexts if a[0] == "period" and special(a[1]))
        together = {(v, w) for (v, w), k in pairs.items() if k > 1 and letter(w) and n * k > count[v] * count[w] and ratio(count[v], count[w], k, n) >= punkt.COLLOCATION}
        lower, upper = {b[1] for _, b in nexts if b[2] == "l"}, {b[1] for _, b in nexts if b[2] == "u"}
        inside, begins = {b[1] for a, b in nexts if b[2] == "u" and a[0] == "none"}, {b[1] for a, b in nexts if b[2] == "l" and (cut(a) or a[0] == "start")}

        def ends(a, b):
            kind, w, _ = a
            if kind in ("mark", "none"):
                return kind == "mark"
            abbr, initial = kind == "period" and w in abbreviations, len(w) == 1 and w.isalpha()
            if kind == "period" and not abbr and not initial and w != "#":
                return True
            if kind == "period" and (initial or w == "#") and (w, b[1]) in together:
                return False
            if (abbr or kind == "ellipsis") and not initial:
                return (b[2] == "u" and b[1] in lower and b[1] not in inside) or (b[2] == "u" and b[1] in starters)
            if b[2] == "p" or (b[2] == "l" and (b[1] in upper or b[1] not in begins)) or (initial and b[2] == "u" and b[1] not in lower):
                return False
            return not abbr

        for d, ts, fs in mine:
            start = place = 0
            for i, t in enumerate(ts):
                place += len(t) + (i > 0)
                if i == len(ts) - 1 or ends(fs[i], fs[i + 1]):
                    out.append((d, start, place))
                    start = place + 1
    return sorted(out, key=str), known


@pytest.fixture(scope="module")
def docs():
    return corpus()


@pytest.fixture(scope="module")
def frame(spark, docs):
    return spark.createDataFrame([(*d, 1, "x") for d in docs], "docid string, lang string, text string, n int, kind string").repartition(3).cache()


def test_boundaries_are_those_of_the_model_whatever_way_they_are_looked_up(spark, docs, frame):
    want, known = model(docs)
    taught = punkt.fit(frame)
    got = {}
    for r in taught.abbreviations.collect():
        got.setdefault(r["lang"], set()).add(r["type"])
    assert got == {lang: a for lang, a in known.items() if a}
    for held in (1 << 24, -1):
        rows = punkt.sentences(frame, taught, held).collect()
        assert sorted(((r["docid"], r["start"], r["end"]) for r in rows), key=str) == want
    texts = {(d, re.sub(r"\s+", " ", t).strip()) for d, _, t in docs if t}
    assert all(any(t[r["start"] : r["end"]] == r["text"] for d, t in texts if d == r["docid"]) for r in rows[:300])


def test_learnt_abbreviations_are_not_split(docs, frame):
    rows = punkt.sentences(frame).collect()
    english = {d for d, lang, _ in docs if lang == "en"}
    texts = [r["text"] for r in rows if r["docid"] in english]
    assert not any(re.search(r"\b(Dr|Mr|U\.S|e\.g|J|p)\.$", t) for t in texts)
    assert any("Dr. Brown" in t for t in texts) and any("5. March" in t for t in texts) and any("e.g. the" in t for t in texts)
    assert all(re.search(r"[.!?…]", t[-3:]) or t == "word" for t in texts)


def test_a_model_of_one_corpus_serves_another(spark, frame):
    taught = punkt.fit(frame)
    other = spark.createDataFrame([("a", "en", "We asked Dr. Nobody about it. He was out. It cost 5. The end."), ("b", "fr", "Un mot. Deux mots.")], "docid string, lang string, text string")
    got = {}
    for r in punkt.sentences(other, taught).orderBy("docid", "start").collect():
        got.setdefault(r["docid"], []).append(r["text"])
    assert got == {"a": ["We asked Dr. Nobody about it.", "He was out.", "It cost 5.", "The end."], "b": ["Un mot.", "Deux mots."]}


def test_texts_are_in_the_offset_space(spark):
    odd = "".join(chr(c) for c in [*range(1, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF, 0x200B]) + "“a” ‘b’ – — x"
    rows = [(odd,), (" " + odd + odd,), ("\u3000 ",), ("",), (None,)]
    df = spark.createDataFrame(rows, "text string")
    want = [r[0] for r in df.select(normalize_offsets(F.col("text"))).collect() if r[0]]
    assert punkt._normal(pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows if r[0] is not None])], names=["text"]), 0).column(0).to_pylist() == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], "docid string, text string")
    assert punkt.sentences(none).collect() == [] and punkt.fit(none).abbreviations.collect() == []
