"""The training-data operators against brute force, the tokenizers library, planted cases and odd inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
ODD = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, tag string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in each column, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    long = " ".join(f"word{k % 977}" for k in range(60_000))
    rows = [(1, None, None, None, None, "x", "y"), (2, "", "en", "a", 0, None, None), (3, long, "en", "a", 5, "x", None), (4, long, "en", "b", 5, "x", None), (5, " \t\n ", "fr", None, 3, None, None), (6, "a b c", "fr", "b", 5, None, None), (6, "a b c", "fr", "b", 5, None, None), (7, "<|endoftext|> x  y's\r\n", "de", "c", 9, None, None), (None, "no id", "de", "c", 5, None, None)]
    return spark.createDataFrame(rows, ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], ODD)


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id bigint, quality int, toxic int")


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


# 2 BPE
def test_bpe_is_the_librarys(spark, odd, empty):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    from typeloom.llm.bpe import Bpe, decode_ids, encode_documents

    library, own = Tokenizer.from_file(P.path("byte_bpe_50k.json")), Bpe(P.path("byte_bpe_50k.json"))
    rng = random.Random(5)
    parts = [" ", "  ", "\n", "\t", "a", "'s", "é", "中", "1", "!", "<|endoftext|>", "\U0001f600", "\x85", "the ", "\r\n", "x" * 300, "\x00"]
    for _ in range(2000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        ids = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(t), "<u4").tolist() == ids
        assert own.decode(own.encode(t)).decode() == library.decode(ids, skip_special_tokens=False)
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in encode_documents(odd).collect()}
    for r in odd.collect():
        t = r["text"] or ""
        ids = library.encode(t, add_special_tokens=False).ids
        assert (r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()) in got
    assert encode_documents(empty).count() == 0
    back = decode_ids(encode_documents(odd, with_ids=True).select("doc_id", "ids"))
    assert {r["text"] for r in back.collect()} == {r["text"] or "" for r in odd.collect()}


def test_bpe_long_pieces():
    from typeloom.llm.bpe import LONG, Bpe, default_path

    own = Bpe(default_path())
    raw = ("thatingonthe" * 40).encode()
    short = own.merged(raw[: LONG - 1])
    assert own.merged_long(raw[: LONG - 1]) == short


# 5, 8, 9 classifiers
def held(spark, rows, parts, rest):
    return [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % parts == rest]


def test_quality(spark, odd, empty, no_labels):
    from typeloom.llm.quality import classify

    rows = {r["doc_id"]: r for r in classify(documents(spark), labels(spark)).collect()}
    marked = [r for r in held(spark, labels(spark).collect(), 3, 1) if r["quality"] is not None]
    assert np.mean([rows[r["doc_id"]]["predicted"] == r["quality"] for r in marked]) >= 0.95
    assert all(rows[r["doc_id"]]["held_out"] for r in marked)
    out = classify(odd, no_labels).collect()
    assert len(out) == 9 and all(0 <= r["score"] <= 1 for r in out)
    assert classify(empty, no_labels).count() == 0


def test_quality_fm_identity():
    from typeloom.llm.quality import FACTORS, Machine

    m = Machine()
    rng = np.random.default_rng(1)
    m.w0, m.w = 0.3, rng.normal(size=m.size)
    idx, val = rng.permutation(m.size)[:30], rng.normal(size=30)
    raw, _ = m.raw(idx, val, np.array([0]))
    pairs = sum((m.v[idx[a]] @ m.v[idx[b]]) * val[a] * val[b] for a in range(30) for b in range(a))
    assert m.v.shape[1] == FACTORS and abs(raw[0] - (m.w0 + m.w[idx] @ val + pairs)) < 1e-9


def test_toxicity_kernel_is_brute_force():
    from itertools import combinations

    from typeloom.llm.toxicity import GAP, ORDER, clean, kernel, tokens_of

    def phi(s):
        out = {}
        for c in combinations(range(len(s)), ORDER):
            u = "".join(s[i] for i in c)
            out[u] = out.get(u, 0) + GAP ** (c[-1] - c[0] + 1)
        return out

    words = ["idiot", "idxiot", "trash", "thrash", "aaa", "ab", "sccum", "éàé"]
    a, b = zip(*[(x, y) for x in words for y in words])
    want = [sum(v * phi(y).get(u, 0) for u, v in phi(x).items()) for x, y in zip(a, b)]
    assert np.allclose(kernel(list(a), list(b)), want, atol=1e-5)
    assert clean("1d-i0t!!") == "idiot" and "idiot" in tokens_of("you I d i o t there")


def test_toxicity(spark, odd, empty, no_labels):
    """On all held-out labels, a few percent of which are wrong."""
    from typeloom.llm.toxicity import classify

    at = "/root/testdata/sf0.1"
    rows = {r["doc_id"]: r for r in classify(spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")).collect()}
    marked = held(spark, [r for r in spark.read.parquet(f"{at}/labels.parquet").collect() if r["toxic"] is not None], 4, 2)
    assert all(rows[r["doc_id"]]["held_out"] for r in marked)
    assert np.mean([rows[r["doc_id"]]["predicted"] for r in marked if r["toxic"] == 1]) >= 0.88
    assert np.mean([rows[r["doc_id"]]["predicted"] for r in marked if r["toxic"] == 0]) <= 0.01
    assert len(classify(odd, no_labels).collect()) == 9 and classify(empty, no_labels).count() == 0


def test_toxicity_learns_many_insults(spark):
    """More insults than LANDMARKS, each in several labelled texts, gapped and with inserted characters in the held-out ones."""
    from typeloom.llm.toxicity import LANDMARKS, classify

    rng = random.Random(12)
    coin = lambda n: "".join(rng.choice("bcdfghjklmnpqrstvwxz") + rng.choice("aeiou") for _ in range(n))
    prose, insults = [coin(rng.randrange(2, 5)) for _ in range(300)], [coin(4) for _ in range(LANDMARKS + 20)]
    rows, marks = [], []
    for k in range(1400):
        words = [rng.choice(prose) for _ in range(30)]
        if k % 2:
            w = insults[k % len(insults)]
            words[7] = w if zlib.crc32(str(k).encode()) % 4 != 2 else w[:3] + "-" + w[3:]
            words[19] = insults[(k * 7) % len(insults)]
        rows.append((k, " ".join(words) + "."))
        marks.append((k, k % 2))
    out = classify(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(marks, "doc_id bigint, toxic int")).collect()
    new = [r for r in out if r["held_out"]]
    assert np.mean([r["predicted"] for r in new if r["doc_id"] % 2]) >= 0.95 and np.mean([r["predicted"] for r in new if r["doc_id"] % 2 == 0]) <= 0.05


def test_toxicity_scores_are_brute_force(spark):
    """The machine's values of words by plain kernels with every landmark, and the Gram matrix positive definite."""
    from typeloom.llm.toxicity import NEAR, Landmarks, Machine, clean, kernel, tokens_of

    marks = Landmarks(["idiot", "trash", "moron", "clown", "model", "crown"], 4)
    n = len(marks.words)
    gram = kernel([a for a in marks.words for _ in range(n)], marks.words * n).reshape(n, n) ** 2 / np.outer(marks.own, marks.own)
    assert np.linalg.eigvalsh(gram).min() > 0
    weights = np.array([1.0, 0.8, 0.9, 0.7, -0.4, -0.5])
    m = Machine(marks, weights, -0.1, np.zeros(0))
    bag = tokens_of("That idi0t m-o-r-o-n is a cl own, a crown in the tras'h and nothing else")
    for token in bag:
        w, want = clean(token), -0.1
        for mark, weight in zip(marks.words, weights):
            if w and len(set(w) & set(mark)) >= NEAR * len(set(mark)):
                want += weight * float(kernel([w], [mark])[0]) ** 2 / max(1e-12, float(kernel([w], [w])[0]) * float(kernel([mark], [mark])[0]))
        m.values([bag])
        assert abs(m.known[token] - want) < 1e-4


def test_langid(spark, odd, empty):
    from typeloom.llm.langid import identify

    rows = {r["doc_id"]: r for r in identify(documents(spark)).collect()}
    truth = held(spark, documents(spark).collect(), 4, 2)
    assert np.mean([rows[r["doc_id"]]["lang_pred"] == r["lang"] for r in truth]) >= 0.97
    out = [(r["doc_id"], r["lang_pred"], r["score"]) for r in identify(odd).collect()]
    assert {x[0]: x[1] for x in out if x[0] in (1, 2, 5)} == {1: "und", 2: "und", 5: "und"} and all(0 <= x[2] <= 1 for x in out)
    assert identify(empty).count() == 0


def test_langid_from_single_sentences(spark):
    """One text in each language, every word once; numerals are no letters."""
    from typeloom.llm.langid import identify

    said = {"en": "the weather is lovely this morning", "de": "das Wetter ist heute sehr schön", "fr": "il fait très beau ce matin", "es": "hace muy buen tiempo hoy", "it": "oggi splende il sole ovunque", "nl": "vandaag schijnt de zon volop"}
    ids = [k for k in range(100) if zlib.crc32(str(k).encode()) % 4 != 2]
    rows = [(ids[k], t, lang) for k, (lang, t) in enumerate(said.items())] + [(200 + k, t, None) for k, t in enumerate(["² ½ Ⅷ 12", "sehr schön heute", "très beau", "x² lovely weather", "tiempo 1/2"])]
    out = {r["doc_id"]: r["lang_pred"] for r in identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert [out[ids[k]] for k in range(6)] == list(said) and [out[200 + k] for k in range(5)] == ["und", "de", "fr", "en", "es"]


def test_langid_is_brute_force(spark):
    """Predictions and scores by plain sums over counted words and n-grams."""
    from math import exp, log

    from typeloom.llm.langid import GRAMS, WORDS, Model, identify

    docs = documents(spark).limit(120)
    counts = {}
    rows = docs.collect()
    words = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    for r in rows:
        if r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2:
            counts.setdefault(r["lang"], Counter()).update(words(r["text"] or ""))
    assert max(map(len, counts.values())) <= WORDS

    def tables(of):
        keys = {g for c in of.values() for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:GRAMS]}
        return {g: {x: log((c[g] + 0.1) / (sum(c.values()) + 0.1 * (1 + len(keys)))) for x, c in of.items()} for g in keys}

    known, grams = tables(counts), {}
    for n in range(1, 6):
        of = {x: Counter() for x in counts}
        for x, c in counts.items():
            for w, k in c.items():
                for g in list(w) if n == 1 else [f" {w} "[i : i + n] for i in range(len(w) + 3 - n)]:
                    of[x][g] += k
        grams[n] = tables(of)

    def logs(w):
        if w in known:
            return known[w]
        for n in range(5, 0, -1):
            seen = [grams[n][g] for g in (list(w) if n == 1 else [f" {w} "[i : i + n] for i in range(len(w) + 3 - n)]) if g in grams[n]]
            if seen:
                return {x: sum(s[x] for s in seen) / len(seen) for x in counts}
        return dict.fromkeys(counts, 0.0)

    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify(docs).collect()}
    for r in rows[::3]:
        ws = words(r["text"] or "")
        if not ws:
            assert got[r["doc_id"]] == ("und", 0.0)
            continue
        total = {x: sum(logs(w)[x] for w in ws) for x in counts}
        best = max(sorted(total), key=total.get)
        score = 1 / sum(exp((total[x] - total[best]) / len(ws) ** 0.5) for x in total)
        assert got[r["doc_id"]][0] == best and abs(got[r["doc_id"]][1] - score) < 1e-6
    # many languages share the entries
    coin = lambda k, j: "".join(chr(97 + x) for x in (k % 26, k // 26, j % 26, j // 26))
    many = Model({f"l{k:02d}": [(coin(k, j), 2) for j in range(40)] for k in range(50)})
    assert all(many.predict(f"{coin(k, 3)} {coin(k, 39)}")[0] == f"l{k:02d}" for k in range(50))


# 6 near duplicates
def brute(rows, words, percent):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for key, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
        sets[key] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    by, root = {}, {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for key, s in sets.items():
        near = Counter(j for x in s for j in by.get(x, ()))
        for j, k in near.items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                a, b = find(key), find(j)
                root[max(a, b)] = min(a, b)
        for x in s:
            by.setdefault(x, []).append(key)
    return {k: (len(s), find(k)) for k, s in sets.items()}


def test_neardup_on_edited_copies(spark):
    from typeloom.llm.neardup import near_duplicates

    rng = random.Random(8)
    words = [f"w{k}" for k in range(500)]
    rows = [(k, t) for k, t in enumerate(["", None, "One two", "one TWO", "one", " \x0b ", "é É a b"])]
    for size in (3, 6, 7, 12, 40, 150, 900):
        for group in range(4):
            base = [rng.choice(words) for _ in range(size)]
            for _ in range(5):
                copy = list(base)
                for _ in range(rng.randrange(0, max(2, size // 18))):
                    copy[rng.randrange(size)] = rng.choice(words)
                rows.append((len(rows), " ".join(copy) + " " * group))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    for k, percent in ((3, 85), (5, 80)):
        want = brute(rows, k, percent)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(frame, k, percent).collect()}
        assert got == want


def test_neardup_over_many_blocks(spark, monkeypatch):
    """Groups that span many pairs of blocks, a large one of near copies among them, equal brute force."""
    from typeloom.llm import neardup

    monkeypatch.setattr(neardup, "BUCKET_BLOCK", 5)
    monkeypatch.setattr(neardup, "SET_BLOCK", 5)
    rng = random.Random(11)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for size, copies in ((120, 60), (60, 30), (40, 30), (200, 20), (90, 20)):
        base = [rng.choice(words) for _ in range(size)]
        for _ in range(copies):
            copy = list(base)
            for _ in range(rng.randrange(0, size // 20 + 1)):
                copy[rng.randrange(size)] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 85).collect()}
    assert got == brute(rows, 3, 85)


def test_neardup_odd(spark, odd, empty):
    from typeloom.llm.neardup import near_duplicates

    got = [tuple(r) for r in near_duplicates(odd.where("doc_id is not null"), 3, 85).collect()]
    assert Counter(got) == Counter([(1, 0, 1, True), (2, 0, 2, True), (3, 977, 3, True), (4, 977, 3, False), (5, 0, 5, True), (6, 1, 6, True), (6, 1, 6, True), (7, 1, 7, True)])
    assert near_duplicates(empty, 3, 85).count() == 0


def test_components(spark):
    from typeloom.llm.components import components

    line = [(k, k + 1) for k in range(40)] + [(100, 103), (103, 101), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark, spark.createDataFrame(line, "u bigint, v bigint")).distinct().collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100, 103: 100}


def test_components_of_long_lines_and_hubs(spark):
    from typeloom.llm.components import components

    rng = random.Random(3)
    names = rng.sample(range(10_000), 701)
    line = list(zip(names, names[1:]))
    hub = [(20_000, 20_001 + k) for k in range(500)] + [(20_500, 30_000 + k) for k in range(300)]
    got = {r["node"]: r["root"] for r in components(spark, spark.createDataFrame(line + hub, "u bigint, v bigint"), hub=50).collect()}
    assert got == dict.fromkeys(names, min(names)) | dict.fromkeys([x for p in hub for x in p], 20_000)


# 7 mixing
def test_mixing(spark, odd, empty):
    from typeloom.llm.mixing import mix, mixture

    docs = documents(spark)
    rows = mix(docs).collect()
    assert {tuple(r) for r in rows} == {tuple(r) for r in mix(docs).collect()}
    sizes, source = Counter(), {r["doc_id"]: r["source"] for r in docs.collect()}
    for r in rows:
        sizes[source[r["doc_id"]]] += r["size"]
    # the targets by plain sharing of the excess
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes))}
    want, left, open_ = dict.fromkeys(sizes, 0.0), 1.5 * sum(sizes.values()), set(sizes)
    while left > 1e-6 and open_:
        total, share = sum(weight[s] for s in open_), left
        left = 0.0
        for s in sorted(open_):
            want[s] += share * weight[s] / total
            if want[s] >= 2 * sizes[s]:
                left += want[s] - 2 * sizes[s]
                want[s] = 2.0 * sizes[s]
                open_.discard(s)
    taken = Counter()
    for r in rows:
        taken[source[r["doc_id"]]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"] and abs(r["target"] - want[source[r["doc_id"]]]) < 1e-3
    assert all(abs(taken[s] - want[s]) <= 20 for s in sizes)
    assert len(mix(odd).collect()) == 9 and mix(empty).count() == 0
    assert mixture(odd).columns == odd.columns and mixture(empty).count() == 0


def test_mixing_small_sources(spark):
    from typeloom.llm.mixing import mix

    rows = [(k, "w " * 100, "big") for k in range(200)] + [(1000 + k, "w " * (k + 1), f"small{k}") for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    taken = {r["doc_id"]: r["taken"] for r in mix(docs, block=1300).collect()}
    assert [taken[1000 + k] for k in range(6)] == [2 * (k + 1) for k in range(6)]
    assert abs(sum(taken.values()) - 1.5 * (20_000 + 21)) <= 1


def test_mixing_of_unlike_sources(spark, monkeypatch):
    """Sources of 10^12 and of 200,000 words: each target is met, over one range of sources and over several."""
    from typeloom.llm import mixing

    rows = [("huge", 10**12, 1), (None, 5, 1)] + [(f"s{k}", 200_000, 1) for k in range(7)]
    sizes = spark.createDataFrame(rows, "source string, source_size long, rows long")
    for most in (mixing.RANGE_ROWS, 3):
        monkeypatch.setattr(mixing, "RANGE_ROWS", most)
        plan, bits = mixing.planned(sizes, block=1 << 22)
        by = {r["source"]: r for r in plan.collect()}
        assert [by[s]["sid"] for s in ("huge", "s0", "s6", None)] == [0, 1, 7, 8]
        assert by[None]["take"] == 10 and all(by[f"s{k}"]["take"] == 400_000 for k in range(7))
        assert abs(sum(r["target"] for r in by.values()) - 1.5 * (10**12 + 1_400_005)) < 1
        slots = mixing.ranked_slots(plan, bits).groupBy("sid").agg(F.count("*").alias("n"), F.countDistinct("rank").alias("d"), F.max("rank").alias("m")).collect()
        assert len(slots) == 9 and all(r["n"] == r["d"] == r["m"] + 1 for r in slots)


def test_mixing_schedule_is_brute_force(spark):
    """The slots' sources, ranks and blocks by plain loops over the van der Corput points."""
    from typeloom.llm.mixing import schedule

    rng = random.Random(4)
    rows = [(k, "w " * rng.randrange(1, 60), "abc"[k % 3] if k % 7 else None) for k in range(300)]
    got = schedule(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), block=64).collect()
    sizes = {k: len(t.split()) for k, t, _ in rows}
    takes = Counter()
    for r in got:
        takes[r["source"]] += r["words"]
    order = sorted((s for s in takes if s), key=str) + [None]
    total = sum(takes.values())
    bits = max(0, (-(-total // 64) - 1).bit_length())
    ranks, want, low = Counter(), {}, 0
    ends = []
    for s in order:
        low += takes[s]
        ends.append(low / total)
    for slot in range(1 << bits):
        point = int(f"{slot:0{bits}b}"[::-1], 2) / (1 << bits)
        s = order[next(k for k, e in enumerate(ends) if point < e)]
        want[slot] = (s, ranks[s])
        ranks[s] += 1
    assert {(r["slot"], r["source"], r["rank"]) for r in got} == {(k, *v) for k, v in want.items()}
    words = Counter()
    for r in got:
        words[r["slot"]] += r["words"]
        assert 0 <= r["begin"] and r["begin"] + r["words"] <= sizes[r["doc_id"]]
    assert all(abs(n - takes[want[k][0]] / ranks[want[k][0]]) < 1 for k, n in words.items())
    # the pieces of a source follow each other without a gap
    for s in order:
        at = 0
        for r in sorted((r for r in got if r["source"] == s), key=lambda r: (r["rank"], r["at"])):
            assert r["at"] == at
            at += r["words"]


def test_mixture_keeps_rows_without_id(spark):
    from typeloom.llm.mixing import mixture

    rows = [(k, f"a b {k}", "with") for k in range(40)] + [(None, f"c d {k}", "without") for k in range(20)] + [(None, f"e f g {k}", None) for k in range(5)]
    out = [tuple(r) for r in mixture(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()]
    copies = Counter(out)
    assert set(copies) <= set(rows) and all(copies[r] == 2 for r in rows if r[2] is None)
    assert sum(n for r, n in copies.items() if r[2] == "without") in (24, 25, 26)  # 2/7 of 300 - 40 words, three each


# 1, 10 searches
def test_hamming_is_exact(spark):
    from typeloom.llm.hamming import nearest

    rng = np.random.default_rng(2)
    codes = rng.integers(0, 1 << 16, (300, 4), dtype=np.uint16)
    codes[50:120] = codes[3]
    codes[120:160, 1:] = codes[7, 1:]
    rows = [(k, c.tobytes()) for k, c in enumerate(codes)]
    frame = spark.createDataFrame([(k, bytearray(c)) for k, c in rows], "vec_id bigint, code binary")
    got = {}
    for r in nearest(frame, F.col("vec_id") % 20 == 0, 20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["distance"], r["vec_id"]))
    for q in range(0, 300, 20):
        far = np.bitwise_count(codes ^ codes[q]).sum(1)
        want = sorted((int(far[k]), k) for k in range(300) if k != q)[:20]
        assert sorted(got[q]) == [(i + 1, d, k) for i, (d, k) in enumerate(want)]


def test_hamming_and_ann_odd(spark):
    from typeloom.llm import ann, hamming

    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [0.6, 0.8]), (2, [0.6, 0.8]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0, None]), (7, [1.0]), (None, [1.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in ann.nearest(frame, F.col("vec_id") % 20 == 0).collect())
    assert got == [(0, 1, 1, 0.6), (0, 2, 2, 0.6), (0, 3, 20, 0.0), (20, 1, 1, 0.8), (20, 2, 2, 0.8), (20, 3, 0, 0.0)]
    nothing = spark.createDataFrame([], "vec_id bigint, embedding array<double>")
    assert ann.nearest(nothing, F.lit(True)).count() == 0 and hamming.nearest(hamming.sign_codes(nothing), F.lit(True)).count() == 0


def test_searches_with_repeated_rows(spark):
    """Ids that repeat, with the same vector or others, are asked and listed once; equal to brute force."""
    from typeloom.llm import ann, hamming

    rng = np.random.default_rng(6)
    rows = [(k, rng.normal(size=8).tolist()) for k in range(60)]
    rows += rows[:40] + [(5, rows[20][1]), (7, rng.normal(size=8).tolist()), (40, [9.0] * 8)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    ask = {q: min(v for i, v in rows if i == q) for q in (0, 20, 40)}

    def brute(nearness):
        out = {}
        for q, v in ask.items():
            of = {}
            for i, x in rows:
                if i != q:
                    of[i] = min(of.get(i, np.inf), nearness(np.array(v), np.array(x)))
            out[q] = sorted((round(d, 9), i) for i, d in of.items())[:20]
        return out

    got = {q: [] for q in ask}
    for r in ann.nearest(frame, F.col("vec_id") % 20 == 0).orderBy("rank").collect():
        got[r["query_id"]].append((round(-r["score"], 9), r["vec_id"]))
    assert got == brute(lambda a, b: -float(np.einsum("i,i", a, b)))
    code = {tuple(v): np.packbits(np.pad(np.array(v) > 0, (0, 8))).tobytes() for _, v in rows}
    ask = {q: min((v for i, v in rows if i == q), key=lambda v: code[tuple(v)]) for q in ask}
    got = {q: [] for q in ask}
    for r in hamming.nearest(hamming.sign_codes(frame), F.col("vec_id") % 20 == 0).orderBy("rank").collect():
        got[r["query_id"]].append((r["distance"], r["vec_id"]))
    assert got == brute(lambda a, b: int(((a > 0) != (b > 0)).sum()))


def test_hamming_over_parts(spark, monkeypatch):
    """Several parts, and blocks of queries, give what one gives."""
    from typeloom.llm import hamming

    rng = np.random.default_rng(7)
    frame = spark.createDataFrame([(k, rng.normal(size=24).tolist()) for k in range(400)], "vec_id bigint, embedding array<double>")
    run = lambda: sorted(tuple(r) for r in hamming.nearest(hamming.sign_codes(frame), F.col("vec_id") % 20 == 0).collect())
    one = run()
    monkeypatch.setattr(hamming, "LEAST_ROWS", 32)
    monkeypatch.setattr(hamming, "QUERY_BLOCK", 7)
    assert run() == one and len(one) == 400


def test_ann_on_clusters(spark, monkeypatch):
    """On clustered vectors a tenth of the entries at most is listed, over several parts."""
    from typeloom.llm import ann

    rng = np.random.default_rng(9)
    centres = rng.normal(size=(60, 16)) * 3
    x = centres[rng.integers(0, 60, 6000)] + rng.normal(size=(6000, 16)) * 0.3
    x /= np.linalg.norm(x, axis=1)[:, None]
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    monkeypatch.setattr(ann, "ENOUGH", 100)
    monkeypatch.setattr(ann, "LEAST_ROWS", 1500)
    index = ann.Index(x, len(x), 20)
    assert index.share <= 0.1
    found = {}
    for r in ann.nearest(frame, F.col("vec_id") % 200 == 0).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = sum(len(set([j for j in np.argsort(-(x @ x[q])) if j != q][:20]) & found[q]) for q in range(0, 6000, 200))
    assert hits / 600 >= 0.9


def test_ann_recall(spark):
    from typeloom.llm.ann import nearest

    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    pdf = table.toPandas().sort_values("vec_id")
    x, ids = np.array(pdf.embedding.tolist(), float), pdf.vec_id.to_numpy()
    hits = n = 0
    for r in nearest(table, F.col("vec_id") % 20 == 0).groupBy("query_id").agg(F.collect_list("vec_id").alias("found")).collect():
        s = x @ x[np.flatnonzero(ids == r["query_id"])[0]]
        s[ids == r["query_id"]] = -9
        hits += len(set(ids[np.argsort(-s)[:20]]) & set(r["found"]))
        n += 20
    assert n == 20 * (ids % 20 == 0).sum() and hits / n >= 0.9


# 3 personal data
def test_pii(spark, odd, empty):
    from typeloom.llm.pii import check_digit, replaced, surrogates

    rows = [
        (1, "write und.34@mail7.example.com or UND.34@MAIL7.EXAMPLE.COM, call +1 (743) 555-3824."),
        (2, "und.34@mail7.example.com again; card 4111111111111111 and 9807915762804490; 10.0.0.7 not 999.1.1.1"),
        (3, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" Mr. James Smith met Mr Smith and Mrs Anna Smith'),
        (4, "nothing here"),
    ]
    out = {r["doc_id"]: r["text"] for r in replaced(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert out[4] == "nothing here"
    mail = re.search(r"\S+@\S+\.com", out[1])[0]
    assert mail != "und.34@mail7.example.com" and mail in out[2] and mail.upper() in out[1]
    assert re.search(r"call \+1 \([2-9]\d{2}\) [2-9]\d{2}-\d{4}\.$", out[1]) and "743) 555-3824" not in out[1]
    digits = re.findall(r"\b\d{16}\b", out[2])
    luhn = lambda s: sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(s))) % 10
    assert digits[0][0] == "4" and luhn(digits[0]) == 0 and luhn(digits[1]) == luhn("9807915762804490")
    assert "999.1.1.1" in out[2] and "10.0.0.7" not in out[2]
    assert re.search(r'token = "[0-9a-f]{40}"', out[3]) and "04dbebab" not in out[3]
    names = re.search(r"Mr\. (\w+) (\w+) met Mr (\w+) and Mrs (\w+) (\w+)$", out[3])
    assert names and names[2] == names[3] == names[5] != "Smith" and names[1] != "James"
    assert replaced(odd).columns == odd.columns and {(r["doc_id"], r["text"]) for r in surrogates(odd).collect()} == {(r["doc_id"], r["text"]) for r in odd.collect()}
    assert replaced(empty).count() == 0
    assert spark.range(1).select(check_digit(F.lit("411111111111111"))).collect()[0][0] == 1


def images(spark, kind, values):
    from typeloom.llm.pii import KEY, surrogate

    frame = spark.createDataFrame([(v,) for v in values], "m string")
    return {r["m"]: r["s"] for r in frame.select("m", surrogate(F.lit(kind), F.col("m"), KEY).alias("s")).collect()}


def test_pii_is_one_to_one_on_whole_small_domains(spark):
    """Every value of a domain has an image in it, no two the same, none its own."""
    from typeloom.llm.pii import TITLES

    letters = "bcdfghjklmnpqrstvwxyz"
    domains = {
        "name": [f"{a.upper()}{b}" for a in "aeiou" + letters for b in "aeiou" + letters] + [f"{a.upper()}{b}{c}" for a in letters for b in "aeiou" for c in letters],
        "phone": [f"{k:03d}" for k in range(1000)],
        "ip": [f"{a}.7.0.{b}" for a in range(256) for b in range(0, 256, 3)] + [f"0.0.{a}.{b}" for a in range(256) for b in range(0, 256, 5)],
        "ssn": [f"{a:03d}-01-0001" for a in range(1, 900) if a != 666] + [f"001-{b:02d}-{c:04d}" for b in range(1, 100) for c in range(1, 10_000, 97)],
        "secret": [f"password={a}{b}{c}" for a in "0123456789" for b in "abcdef" for c in "ghijkl!"],
        "email": [f"{a}{b}@x.org" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz0123456789"],
    }
    for kind, values in domains.items():
        values = [v for v in dict.fromkeys(values) if v not in TITLES.split("|")]  # titles stay
        out = images(spark, kind, values)
        assert len(out) == len(set(out.values())) == len(values) and all(m != s for m, s in out.items()), kind
    out = images(spark, "ssn", domains["ssn"])
    assert all(1 <= int(s[:3]) <= 899 and s[:3] != "666" and int(s[4:6]) and int(s[7:]) for s in out.values())
    assert all(0 <= int(o) <= 255 for s in images(spark, "ip", domains["ip"][:500]).values() for o in s.split("."))


def test_pii_check_digits(spark):
    def pair(x):
        x = x.replace(" ", "")
        return int("".join(str(int(c, 36)) for c in x[4:] + x[:2] + "00")) % 97

    valid = ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "FR1420041010050500013M02606"]
    out = images(spark, "iban", valid + ["GB83 WEST 1234 5698 7654 32"])
    for m, s in out.items():
        assert s[:2] == m[:2] and s[4:] != m[4:] and [c == " " for c in s] == [c == " " for c in m]
        assert (98 - pair(s) == int(s[2:4])) == (98 - pair(m) == int(m[2:4]))


def test_pii_names(spark):
    from typeloom.llm.pii import FEMALE_NAMES, MALE_NAMES, replaced, surrogates

    rows = [
        (0, "Mr James and Mr James Smith; JAMES SMITH said so, and Smith left with Smithson."),
        (1, "Mr McDonald, Mr Jean-Pierre Dupont, Dr O'Brien, Frau von der Leyen and Mrs J. R. Ewing."),
        (2, "Mr Nguyễn met Mr Ավագյան. Smith is not named here; Mary neither."),
        (3, "Ms Anna Smith"),
        (4, "password: ********"), (5, "Mr Smith's"), (6, "call +8613812345678 or +49 89 1234567 or +1 (826) 555-4081 190.137.223.14"),
        (7, "key AB0123456789ABCDEF0123456789ABCDEF"), (8, "mail 李小龍@例子.中国 now"), (9, "token: ꙮꙮꙮꙮꙮꙮ"),
    ]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = {r["doc_id"]: r["text"] for r in replaced(frame).collect()}
    first = re.fullmatch(r"Mr (\w+) and Mr (\w+) (\w+); (\w+) (\w+) said so, and (\w+) left with Smithson.", out[0])
    assert first and first[1] == first[2] != "James" and first[1] in MALE_NAMES and first[3] == first[6] != "Smith" and first[4] == first[1].upper() and first[5] == first[3].upper()
    assert re.fullmatch(r"Mr [A-Z][a-z][A-Z][a-z]{5}, Mr (\w+)-(\w+) [A-Z][a-z]{5}, Dr [A-Z]'[A-Z][a-z]{4}, Frau von der [A-Z][a-z]{4} and Mrs [A-Z]\. [A-Z]\. [A-Z][a-z]{4}\.", out[1])
    assert not re.search("McDonald|Jean|Pierre|Dupont|Brien|Leyen|Ewing", out[1]) and "Smith is not named here; Mary neither." in out[2]
    assert "Nguyễn" not in out[2] and "ễ" not in out[2] and "Ավագյան" not in out[2]
    anna = re.fullmatch(r"Ms (\w+) (\w+)", out[3])
    assert anna[1] in FEMALE_NAMES and anna[1] != "Anna" and anna[2] == first[3] and out[5] == f"Mr {first[3]}'s"
    assert out[4] == rows[4][1] and out[9] == rows[9][1]
    assert re.fullmatch(r"call \+86(?!13812345678)\d{11} or \+49 (?!89 1234567)\d\d \d{7} or \+1 \([2-9]\d\d\) [2-9]\d\d-\d{4} \d+\.\d+\.\d+\.\d+", out[6])
    assert "AB0123" not in out[7] and re.fullmatch("key [A-F]{2}[0-9]{10}[A-F]{6}[0-9]{10}[A-F]{6}", out[7].replace(" ", " ")) or re.fullmatch("key [0-9A-F]{34}", out[7])
    assert re.fullmatch("mail [\u4e00-\u9fff]{3}@[\u4e00-\u9fff]{2}\\.中国 now", out[8])
    count = {r["doc_id"]: r["n_entities"] for r in surrogates(frame).collect()}
    assert count[0] == 5 and count[2] == 2 and count[6] == 4 and count[9] == 1


def test_pii_listed_and_other_names_stay_apart(spark):
    """No image of another name is a listed one, and none comes back to itself, even where the walk goes on."""
    from typeloom.llm.pii import FEMALE_NAMES, KEY, MALE_NAMES, WORD, cipher

    listed = MALE_NAMES + FEMALE_NAMES
    # what the inverse of the cipher leads to: images of listed names' orbits
    frame = spark.createDataFrame([(x,) for x in listed], "w string").select(cipher(F.col("w"), WORD, F.lit(f"{KEY}/name")).alias("w"))
    others = [r["w"] for r in frame.collect() if r["w"] not in listed]
    out = images(spark, "name", others + ["Smith", "Jones"])
    assert len(set(out.values())) == len(out) and not set(out.values()) & set(listed) and all(m != s for m, s in out.items())


def test_pii_collisions_and_time(spark):
    """No collision over every entity of the documents; the plan of one row is made in seconds."""
    import time

    from typeloom.llm.pii import collisions, surrogates

    assert collisions(documents(spark)) == 0
    begun = time.time()
    surrogates(spark.range(1).selectExpr("id doc_id", "'x' text")).collect()
    assert time.time() - begun < 20


# 4 licences
def test_licenses(spark, odd, empty):
    from typeloom.llm.licenses import scan

    rows = [(1, "Some words.\nReleased under the MIT License."), (2, "LICENSED!! UNDER!! THE!! APACHE!! LICENSE,!! VERSION!! 2.0."), (3, "mit und license ohne"), (4, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License")]
    plain = documents(spark).where("doc_id < 200").select("doc_id", "text").selectExpr("doc_id + 1000 doc_id", "text")
    out = {r["doc_id"]: (r["family"], r["score"]) for r in scan(spark.createDataFrame(rows, "doc_id bigint, text string").unionByName(plain)).collect()}
    assert out[1][0] == "mit" and out[2][0] == "apache-2.0" and out[3] == ("none", 0.0)
    assert out[4][0] == "gpl"  # versions are families of their own, and this notice names none
    notice = re.compile(r"released under the mit|licensed under (the apache|cc by)|gnu general public", re.I)
    for r in plain.collect():
        assert (out[r["doc_id"]][0] != "none") == bool(notice.search(re.sub(r"[^\w.]+", " ", r["text"]).replace("!!", "")))
    assert {r["family"] for r in scan(odd).collect()} == {"none"} and scan(empty).count() == 0


#: Notices as files carry them: wrapped, in comments, with other words about them.
CARRIED = {
    "mit": """MIT License

Copyright (c) 2020 Jane Roe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:""",
    "gpl-3.0": """/*
 * This file is part of Foo.
 *
 * Foo is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * Foo is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 */""",
    "bsd": """# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions
# are met:""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
    "gpl-2.0": "Published under the GNU General Public License version 2, see COPYING.",
    "gpl-2.0 ": """ * This program is free software; you can redistribute it and/or
 * modify it under the terms of the GNU General Public License
 * as published by the Free Software Foundation; either version 2
 * of the License, or (at your option) any later version.""",
    "lgpl-2.1": """// This library is free software; you can redistribute it and/or
// modify it under the terms of the GNU Lesser General Public
// License as published by the Free Software Foundation; either
// version 2.1 of the License, or (at your option) any later version.""",
    "agpl-3.0": "You may use it under the terms of the GNU Affero General Public License version 3 only.",
    "apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0""",
    "apache-2.0|mit": "This crate is released under the MIT License or, at your choice, licensed under the Apache License, Version 2.0.",
    "mpl-2.0": """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */""",
    "zlib": """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.""",
    "unlicense": "This is free and unencumbered software released into the\npublic domain.",
    "gpl": "You should have received a copy of the GNU General Public License\nalong with this program.  If not, see <https://www.gnu.org/licenses/>.",
    "": "You need a license to drive. The software is under review, and the terms of the contract are public. MIT is a university.",
    " ": "The license was issued by the general manager under the terms of the agreement, version 3 of it being free of charge.",
}


def test_licenses_as_files_carry_them(spark):
    """Also where a third of the corpus carries a licence line, so that its words are common there."""
    from typeloom.llm.licenses import scan

    prose = [(1000 + k, f"word{k} and other words of no licence\n\nthe end") for k in range(60)]
    rows = [(k, t) for k, t in enumerate(CARRIED.values())]
    for corpus in (prose, prose + [(2000 + k, f"code {k}\n# License: MIT\nmore code") for k in range(60)]):
        out = {r["doc_id"]: "|".join(r["families"]) for r in scan(spark.createDataFrame(rows + corpus, "doc_id bigint, text string")).collect()}
        assert [out[k] for k in range(len(rows))] == [x.strip() for x in CARRIED]
        assert not any(out[k] for k, _ in prose)


def test_licenses_gate_loses_nothing():
    """Of every notice more than a quarter of the pairs hold an anchor, so a confirmed paragraph has one."""
    from typeloom.llm.licenses import CONFIRMED, anchors, notices, pairs_of

    for _, words in notices():
        pairs = pairs_of(words)
        assert sum(bool(set(p.split()) & set(anchors())) for p in pairs) > (1 - CONFIRMED) * len(pairs)


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = documents(spark)
    kept = p.quality(spark, docs, SF)
    marks = {r["doc_id"]: r["quality"] for r in labels(spark).collect()}
    left = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert kept.columns == docs.columns and np.mean([(k in left) == bool(q) for k, q in marks.items() if q is not None]) >= 0.95
    one = p.near_dedup(spark, docs, SF)
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], 5, 80)
    assert {r["doc_id"] for r in one.select("doc_id").collect()} == {k for k, (_, c) in want.items() if k == c}
    assert one.columns == p.pii(spark, docs, SF).columns == p.mixing(spark, docs, SF).columns == docs.columns


def test_pipeline_run(spark):
    """run() puts out the digests of the texts that its stages, taken one by one, leave; the mix's own counts hold."""
    import corpus_pipeline as p
    import public_tokenizers as P
    from tokenizers import Tokenizer

    from typeloom.llm.mixing import mix

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    docs = documents(spark)
    for _, stage in p.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF)
    want = Counter()
    texts = docs.collect()
    for r in texts:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want[r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in p.run(spark, SF).collect()) == want
    shares = {r["doc_id"]: int(r["taken"] / r["size"] + 0.5) for r in mix(before).collect() if r["size"]}
    assert Counter(r["doc_id"] for r in texts) == Counter({k: n for k, n in shares.items() if n})
