"""Operators on documents against plain versions on small tables with hard cases."""
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from talkweave.llm import decontaminate, lm, pii, quality, sentencepiece, simhash, tokenfile

EXTRA = "row string, key string, fp long, doc_id long, text string"
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


def base_texts():
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(40)] + ["Élan", "É", "don't", "x_y", "日本"]
    return [" ".join(rng.choice(vocabulary, rng.integers(1, 60))) for _ in range(30)]


@pytest.fixture(scope="module")
def texts():
    t = base_texts()
    return [*t, None, "", "   ", t[0], t[0], t[1] + " tail", "A", "a  b\n\nc ", "word " * 5000, "\t\n", t[2].upper()]


@pytest.fixture(scope="module")
def docs(spark, texts):
    """A null and a repeated id, and columns whose names the operators use themselves."""
    ids = list(range(len(texts)))
    ids[5], ids[7] = None, 6
    return spark.createDataFrame([("r", "k", 1, i, t) for i, t in zip(ids, texts)], EXTRA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], EXTRA)


def hits(text, wins):
    w, hit, items = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text)), set(), set()
    for win, owner in wins:
        for k in range(len(w) - len(win) + 1):
            if w[k:k + len(win)] == win:
                hit.update(range(k, k + len(win)))
                items.add(owner)
    return len(w), len(hit), items


def test_decontamination_matches_brute_force(spark, docs, texts, none):
    tests = [(1, texts[0]), (10, texts[3]), (2, "tail"), (3, None), (4, "..."), (5, texts[0]), (6, "w1 nowhere")]
    wins = []
    for item, t in tests:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        wins += [(w[i:i + 13], item) for i in range(max(1, len(w) - 12) if w else 0)]
    table = spark.createDataFrame(tests, "item_id long, text string")
    got = sorted((r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontaminate.decontaminate(docs, table).collect())
    want = []
    for t in texts:
        n, h, items = hits(t, wins)
        want.append((n, h, len(items), hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest(), h > 0 and 20 * h >= n))
    assert got == sorted(want)
    old, decontaminate.BLOCK_BYTES = decontaminate.BLOCK_BYTES, 200          # the test set in several blocks
    try:
        assert sorted(tuple(r)[1:] for r in decontaminate.decontaminate(docs, table).collect()) == sorted(want)
    finally:
        decontaminate.BLOCK_BYTES = old
    assert decontaminate.decontaminate(none, table).count() == 0
    assert not decontaminate.decontaminate(docs, table.limit(0)).filter("contaminated or n_hit > 0").count()


def test_proximity_allows_gaps(spark):
    d = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha x beta gamma"), (3, "alpha x y z q beta gamma"), (4, "gamma beta alpha")], "doc_id long, text string")
    t = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    index = decontaminate.build_index(d)
    found = {s: {r["doc_id"] for r in decontaminate.find(index, t, slop=s).filter("items is not null").collect()} for s in (0, 1, 4)}
    assert found == {0: {1}, 1: {1, 2}, 4: {1, 2, 3, 4}}


@pytest.mark.parametrize("first", [0, 1])
def test_proximity_at_the_edges_of_a_document(spark, first):
    """The phrase would start before the document, as the first and as a later one; spans end with the document."""
    d = spark.createDataFrame([(1, "alpha alpha gamma"), (2, "beta gamma x alpha"), (3, "alpha gamma alpha")][first:], "doc_id long, text string").coalesce(1)
    t = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    found = decontaminate.find(decontaminate.build_index(d), t, slop=4).filter("items is not null").collect()
    assert [(r["doc_id"], [(x["s"], x["e"]) for x in r["spans"]]) for r in found] == [(2, [(0, 2)])]


def plain_fingerprint(s):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(s))
    shingles = [" ".join(w)] if 0 < len(w) < 3 else [" ".join(w[i:i + 3]) for i in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reach(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("crowded", [64, 1])
def test_simhash_components(spark, docs, texts, none, crowded, monkeypatch):
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    near = [texts[i % 30] + " end" * (i % 3) for i in range(60)]
    table = spark.createDataFrame(list(enumerate(texts + near)), "doc_id long, text string")
    fp = [plain_fingerprint(t) for t in texts + near]
    root = reach(len(fp), lambda i, j: bin(fp[i] ^ fp[j]).count("1") <= 2)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(table).collect()}
    assert got == {i: (f"{fp[i]:016x}", root[i]) for i in range(len(fp))}
    assert simhash.near_duplicates(none).count() == 0


def plain_similarity(a, b):
    x, y = (set(simhash.shingle_hashes(t, 5).tolist()) for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


@pytest.mark.parametrize("dense,tile", [(16, 1024), (1, 16)])
def test_one_of_each_similar_group_stays(spark, docs, texts, none, dense, tile, monkeypatch):
    monkeypatch.setattr(simhash, "DENSE", dense)
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = np.random.default_rng(12)
    long = [" ".join(f"v{x}" for x in rng.integers(0, 5000, 300)) for _ in range(8)]
    near = [" ".join("changed" if k in (20 * i, 150) else w for k, w in enumerate(t.split())) for t in long for i in range(6)]
    far = [" ".join(w if k % 4 else "other" for k, w in enumerate(t.split())) for t in long]
    rows = [(1000 + i, t) for i, t in enumerate(long + near + far)]
    d = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    every = [r["text"] for r in d.collect()]
    groups = len(set(reach(len(every), lambda i, j: plain_similarity(every[i], every[j]) >= 0.8)))
    kept = simhash.keep_one(d).collect()
    assert len(kept) == groups and {r["doc_id"] for r in kept} >= {1000 + i for i in range(8)} | {1056 + i for i in range(8)}
    assert simhash.keep_one(docs).columns == docs.columns and simhash.keep_one(none).count() == 0


def short_pairs(n, words):
    """Pairs of texts, the second one word longer."""
    for i in range(n):
        t = " ".join(f"p{i}w{k}" for k in range(words))
        yield t, f"{t} p{i}end"


def test_similar_pairs_at_the_threshold_are_found(spark):
    """Eight words and one more: four of five shingles, 0.8 exactly."""
    texts = [x for p in short_pairs(2000, 8) for x in p]
    assert plain_similarity(*texts[:2]) == 0.8
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["doc_id"] for r in simhash.keep_one(d).select("doc_id").orderBy("doc_id").collect()] == list(range(0, 4000, 2))


@pytest.mark.parametrize("dense,tile", [(16, 512), (1, 8)])
def test_only_exact_similarity_links(spark, dense, tile, monkeypatch):
    """Pairs at 0.78 stay apart; a chain of neighbours at 0.82, whose other pairs are below 0.8, is one group."""
    monkeypatch.setattr(simhash, "DENSE", dense)
    monkeypatch.setattr(simhash, "TILE", tile)
    texts = [" ".join([*(f"a{i}w{k}" for k in range(100)), *(f"b{i}w{k}" for k in range(n))]) for i in range(100) for n in (0, 27)]
    chain = [" ".join(f"c{k}" for k in range(10 * i, 10 * i + 105)) for i in range(30)]
    assert round(plain_similarity(*texts[:2]), 2) == 0.78 and plain_similarity(*chain[:2]) > 0.8 > plain_similarity(chain[0], chain[2])
    d = spark.createDataFrame(list(enumerate(texts + chain)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_one(d).collect()) == list(range(201))


def test_links_of_a_dense_ball(spark):
    """All 2081 codes within two bits of one: every half is crowded, and the links must join them without pairs."""
    codes = [0] + [1 << i for i in range(64)] + [(1 << i) | (1 << j) for i in range(64) for j in range(i)]
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    edges = simhash.links(spark.createDataFrame([(c,) for c in signed], "fp long")).collect()
    assert len(edges) < 100 * len(codes)
    assert all(bin((r["u"] ^ r["v"]) & ((1 << 64) - 1)).count("1") <= 2 for r in edges)
    groups = simhash.components(spark.createDataFrame(edges, "u long, v long"))
    assert groups.select("root").distinct().count() == 1 and groups.count() == len(codes)


def test_quality_on_held_out_rows(spark, none):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(600):
        bad = i % 4 == 0
        w = rng.choice(["the", "house", "river", "stands", "and", "of", "green"], 40)
        rows.append(("r", "k", 1, i, " | ".join(w) if bad else " ".join(w) + "."))
    d = spark.createDataFrame([*rows, ("r", "k", 1, 600, None), ("r", "k", 1, None, ""), ("r", "k", 1, 3, "x")], EXTRA)
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1, 0) for i in range(600)] + [(1, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(d, labels).collect()
    assert len(got) == len(rows) + 3
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 600]
    assert held and all(r["held_out"] == (quality.fold_of(r["doc_id"]) == 0) for r in got)
    assert np.mean([r["predicted"] == (r["doc_id"] % 4 != 0) for r in held]) > 0.95
    assert quality.classify(none, labels).count() == 0
    assert {r["score"] for r in quality.classify(d, labels.limit(0)).collect()} == {0.5}
    assert quality.keep_good(d, labels).columns == d.columns


def test_isotonic_is_monotone_and_keeps_the_mean():
    rng = np.random.default_rng(2)
    s = rng.normal(size=500)
    y = (rng.uniform(size=500) < 1 / (1 + np.exp(-s))).astype(float)
    knots, levels = quality.isotonic(s, y)
    assert (np.diff(knots) > 0).all() and (np.diff(levels) > 0).all() and 0 <= levels.min() and levels.max() <= 1


def test_language_model_matches_brute_force(spark, docs, none):
    from collections import Counter
    rows = [(r["doc_id"], re.findall(r"[^\x20\x09-\x0D]+", lower(r["text"])) + ["<end>"]) for r in docs.collect()]
    train = [t for i, t in rows if zlib.crc32(str("" if i is None else i).encode()) % 10]
    one = Counter(w for t in train for w in t)
    n, v = sum(one.values()), len(one)
    grams = {k: Counter(tuple((["<s>"] + t)[j - k:j + 1]) for t in train for j in range(k, len(t) + 1)) for k in (1, 2)}
    history = Counter(w for t in train for w in (["<s>"] + t)[:-1])

    def p(t, j, order):
        s, x = ["<s>"] + t, (one[t[j - 1]] + 0.1) / (n + 0.1 * (v + 1))
        for k in range(1, min(order, j + 1)):
            h = history[s[j - 1]] if k == 1 else grams[1][tuple(s[j - 2:j])]
            x = (grams[k][tuple(s[j - k:j + 1])] + 2.0 * x) / (h + 2.0)
        return x
    for order, most in ((2, 10 ** 6), (3, 500)):
        got = sorted((round(r["base_score"], 6), round(r["score"], 6), r["n_tokens"], r["n_known"], r["train_tokens"]) for r in lm.score(docs, order, 2.0, most).collect())
        want = sorted((round(sum(np.log10((one[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 6), round(sum(np.log10(p(t, j, order)) for j in range(1, len(t) + 1)), 6),
                       len(t), sum(one[w] > 0 for w in t), n) for _, t in rows)
        assert np.allclose([x[:2] for x in got], [x[:2] for x in want]) and sorted(x[2:] for x in got) == sorted(x[2:] for x in want)
    whole = [(one[w] + 0.1) / (n + 0.1 * (v + 1)) for w in one] + [0.1 / (n + 0.1 * (v + 1))]
    assert abs(sum(whole) - 1) < 1e-9
    assert lm.score(none).count() == 0


def test_token_file_round_trip(spark, docs, none):
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    odd = ["a  b   c\t d", "it's, we've don't. x..y ,z é.", "\n\n a\n b \n", "   x y\x1c z\x85.", "x <|endoftext|>  <|endoftext|> y", "12.5, 3,000.  end   ", "日本語。 ok"]
    d = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    read = tokenfile.read(spark, tokenfile.write(d, path)).orderBy("start").collect()
    assert sorted((str(r["doc_id"]), r["ids"]) for r in read) == sorted(
        (str(r["doc_id"]), library.encode(r["text"] or "", add_special_tokens=False).ids + [0]) for r in d.collect())
    assert [r["start"] for r in read] == [0, *np.cumsum([r["n_tokens"] for r in read])[:-1].tolist()]
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in read]
    assert ids == sorted(ids)
    some = tokenfile.digest(tokenfile.read(spark, tokenfile.write(d, path))).collect()
    assert all(r["n_tokens"] > 0 for r in some) and len(some) == len(read)
    assert tokenfile.read(spark, tokenfile.write(none, path)).count() == 0


def test_token_memory_may_forget(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = base_texts()
    want = tokenfile.Encoder(path).encode(t)
    monkeypatch.setattr(tokenfile, "MEMORY", 3)
    small = tokenfile.Encoder(path)
    assert [small.encode([x])[0] for x in t] == want


def test_sentencepiece_equals_the_library(spark, docs, none):
    import sentencepiece as library
    bpe = library.SentencePieceProcessor(model_file=PIECES)
    odd = ["-" * 200 + " a", "=== x ===", "aaaaaa" * 30, " \n\n  b\n ", "日本語 中文 abc😀 Müller", "x" * 70, "²².²", "a\tb", "Hello, the world!"]
    d = docs.filter("length(text) < 3000 or text is null").select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    rows = d.collect()
    unigram = sentencepiece.load(PIECES, 1)                                  # the same pieces, read as a unigram model

    def best(text):
        return [i for u in unigram.split(text) for i in unigram.encode_unit(u.replace(" ", sentencepiece.SPACE))]
    for model, kind in ((bpe.encode, None), (best, 1)):
        got = sentencepiece.encode(d, PIECES, kind, most=300)
        assert sorted((str(r["doc_id"]), r["ids"]) for r in got.collect()) == sorted((str(r["doc_id"]), model(r["text"] or "")) for r in rows)
    back = sentencepiece.encode(d, PIECES).select(sentencepiece.decoded(F.col("ids"), PIECES).alias("t")).collect()
    assert sorted(r["t"] for r in back) == sorted(r["text"] or "" for r in rows)
    assert sentencepiece.encode(none, PIECES).count() == 0


def test_viterbi_path_is_the_best_of_all():
    p = sentencepiece.load(PIECES, 1)

    def paths(u):
        if not u:
            return [(0.0, [])]
        return [(s + (p.score[p.ids[u[:n]]]), [p.ids[u[:n]], *x]) for n in range(1, len(u) + 1) if u[:n] in p.ids for s, x in paths(u[n:])]
    for u in ("▁the", "▁reading", "hello", "▁a", "▁▁b"):
        top = max(s for s, _ in paths(u))
        assert (top, p.encode_unit(u)) in paths(u)


def test_surrogates_keep_type_and_identity(spark, none):
    t = ['Mr. Müller and Frau Schmidt: a.b@mail.com, A.B@MAIL.COM, 10.0.0.1, +1 (017) 555-7713, token = "908038b7daaf91e730d2f64001c52934d43d9336"',
         "card 4111 1111 1111 1111 and 4111111111111111, a.b@mail.com; г-жа Иванова", "Frau Schmidt", None, "", "nothing here v1.2.3.4.5", "10.0.0.1 " * 400, "10.0.0.1 " * 400]
    d = spark.createDataFrame([("r", "k", 1, i, x) for i, x in enumerate(t)], EXTRA)
    for small in (pii.SMALL, -1):
        got = {r["row"]["doc_id"]: (r["row"]["text"], r["spans"]) for r in pii.replace(d, b"key", small).collect()}
        assert got[3] == (None, []) and got[4] == ("", []) and got[5][0] == t[5]
        new = {k: [got[i][0][x["s"]:x["e"]] for i in (0, 1, 2, 6) for x in got[i][1] if x["kind"] == k] for k, _ in pii.PATTERNS}
        assert new["mail"][0].upper() == new["mail"][1] and new["mail"][0] == new["mail"][2] and new["mail"][0] != "a.b@mail.com"
        assert len(set(new["ipv4"])) == 1 and len(new["ipv4"]) == 401 and all(int(x) < 256 for x in new["ipv4"][0].split("."))
        assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", new["phone"][0]) and re.fullmatch("[0-9a-f]{40}", new["secret"][0])
        assert all(pii.luhn(x.replace(" ", "")) for x in new["number"]) and re.fullmatch(r"(\d{4} ){3}\d{4}", new["number"][0])
        assert new["name"][0] in pii.NAMES["latin", "m"] and new["name"][1] == new["name"][3] in pii.NAMES["latin", "f"] and new["name"][2] in pii.NAMES["cyrillic", "f"]
    assert pii.replace(none, b"key").count() == 0


def test_surrogates_stay_distinct(spark):
    """More names of one gender than first names: all surrogates differ, and none is a name of the corpus."""
    names = [f"{a}{b}ik" for a in "BCDFGHKLMN" for b in "aeiou"] + ["Anna", "Clara"]
    found = spark.createDataFrame([("name", "f " + x.casefold()) for x in names] * 2, "kind string, entity string")
    got = pii.surrogates(found, b"key").collect()
    new = [r["surrogate"].lower() for r in got]
    assert len(got) == len(names) == len(set(new)) and not set(new) & {x.lower() for x in names}


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrst", "абвгдежзиклмнопрстуф", "աբգդեզէըթժիլխծկհձղճմ"])
def test_surrogates_do_not_run_out(spark, letters):
    """20,000 names of one word and one gender, also in a script without a list of names."""
    names = [f"{a}{b}{c}{d}" for a in letters for b in letters for c in letters[:10] for d in letters[:5]]
    found = spark.createDataFrame([("name", f"m {x}") for x in names], "kind string, entity string")
    new = [r["surrogate"].lower() for r in pii.surrogates(found, b"key").collect()]
    assert len(new) == len(set(new)) == len(names) == 20_000 and not set(new) & set(names)
    assert {pii.script(c) for x in new for c in x} == {pii.script(letters[0])}
