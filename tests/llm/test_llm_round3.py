"""Phrases, exact deduplication and resampling against plain versions on small tables with hard cases."""
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from talkweave.llm import exactdedup, phrases, resample

EXTRA = "rid string, key string, row int, lang string, doc_id long, text string"


def low(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    vocabulary = [f"w{i}" for i in range(14)] + ["É", "日本", "a-b", "x\x00y"]
    texts = [" ".join(x + ("" if rng.random() < 0.8 else str(rng.choice([".", ",", "\n", "\r\n", "\t", "  ", ":"]))) for x in rng.choice(vocabulary, rng.integers(1, 40)))
             for _ in range(300)]
    texts += [None, "", "   ", "...", texts[0], texts[0].upper(), texts[0], "w1 " * 4000, "W1 w2 W3 w4 " * 300, "w1\tw2", "one. two"]
    langs = ["en", "de", None, "en", "und"]
    return [(langs[i % 5], None if i == 9 else 8 if i == 10 else i, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([("r", "k", 1, *r) for r in rows], EXTRA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], EXTRA)


def plain_counts(rows, longest):
    f = defaultdict(Counter)
    for lang, _, t in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(t)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for m in range(1, longest + 1):
                f[lang or "und"].update(tuple(w[i:i + m]) for i in range(len(w) - m + 1))
    return f


def plain_phrases(rows, least, longest, top):
    out = []
    for lang, f in plain_counts(rows, longest).items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        cand = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        found = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in cand.items()):
                continue
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


@pytest.mark.parametrize("least, longest, top, shards, most, bits", [(30, 4, 2000, 3, 700, 20), (5, 4, 7, 4, 150, 16), (12, 3, 50, 1, 10**6, 16), (9, 5, 50, 2, 300, 15)])
def test_phrases_match_brute_force(spark, docs, rows, least, longest, top, shards, most, bits):
    """Many shards, one, and a table of cells so small that most phrases share one."""
    got = phrases.mine(docs, least, longest, top, shards=shards, most=most, bits=bits)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == plain_phrases(rows, least, longest, top)


def test_phrase_counts_and_cases(spark, docs, rows, none):
    found, words = phrases.counts(docs, 10, 4, 3, 500, 16)
    f = plain_counts(rows, 4)
    assert {(r["lang"], r["phrase"]): r["n"] for r in found.collect()} == {(g, " ".join(p)): n for g, c in f.items() for p, n in c.items() if n >= 10}
    assert {r["lang"]: r["n"] for r in words.collect()} == {g: sum(n for p, n in c.items() if len(p) == 1) for g, c in f.items()}
    assert phrases.mine(none).count() == 0
    big = spark.createDataFrame([("en", "a b", 3 * 10**18, 4 * 10**18, 10**18)], "lang string, phrase string, l long, r long, a long")
    assert big.selectExpr("cast(a as decimal(20, 0)) * 2000000 div (l + r) as s").first()["s"] == 2000000 // 7


def test_phrases_become_active_in_mid_cycle(spark):
    """A frequent phrase is counted before the words' cycle ends: that is what interleaving is."""
    d = spark.createDataFrame([("en", i, "of the day of the night") for i in range(90)], "lang string, doc_id long, text string").coalesce(1)
    dealt = phrases.blocks(d, 3, 7 * 30)
    assert sorted(r["shard"] for r in dealt.select("shard").collect()) == [0, 1, 2]
    cells = np.full(1 << 16, phrases.NEVER, np.uint8)
    row = dealt.filter("shard = 1").first().asDict()
    first = [b for b in phrases._block_counts(row, 0, cells, 3, 4)]
    assert {x for b in first for x in b.column(2).to_pylist()} == {1}
    for h in {x for b in first for x in b.column(3).to_pylist()}:
        cells[[h & 0xFFFF, (h >> 32) & 0xFFFF]] = 0
    second = [r for b in phrases._block_counts(row, 1, cells, 3, 4) for r in b.to_pylist()]
    assert {r["words"] for r in second} == {1, 2} and all(r["until"] == 3 for r in second if r["words"] == 2)


def test_only_found_phrases_leave_a_block_with_their_texts(spark, monkeypatch):
    """Scans write hashes; the last pass names what is in the table of bits, and is exact when all longer phrases share one hash."""
    d = spark.createDataFrame([("en", "of the day of the night, of the day"), (None, "of the day")], "lang string, text string").coalesce(1)
    row = phrases.blocks(d, 1, 1000).first().asDict()
    cells = np.zeros(1 << 16, np.uint8)
    counted = [r for b in phrases._block_counts(row, 1, cells, 3, 2) for r in b.to_pylist()]
    assert set(counted[0]) == {"until", "known", "words", "hash", "n"}
    one = max((r for r in counted if r["words"] == 2), key=lambda r: r["n"])
    bits = np.zeros(1 << 13, np.uint8)
    for c in (one["hash"] & 0xFFFF, (one["hash"] >> 32) & 0xFFFF):
        bits[c >> 3] |= 1 << (c & 7)
    assert [tuple(r.values()) for b in phrases._block_phrases(row, bits, 16, 2) for r in b.to_pylist()] == [("en", b"of the", 2, 3)]
    monkeypatch.setattr(phrases, "_mix", lambda h: h & np.uint64(0))
    got = defaultdict(int)
    for b in phrases._block_phrases(row, np.full(1 << 13, 255, np.uint8), 16, 4):
        for r in b.to_pylist():
            got[r["lang"], r["phrase"].decode()] += r["n"]
    want = plain_counts([("en", 0, "of the day of the night, of the day"), (None, 1, "of the day")], 4)
    assert got == {(g, " ".join(p)): n for g, c in want.items() for p, n in c.items()}
    assert row["totals"] == [9, 3]


def plain_classes(rows):
    groups = defaultdict(list)
    for _, i, t in rows:
        groups[low(t)].append(i)
    last = {k: max((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return {t: (last[t], len(v), hashlib.sha256(t.encode()).hexdigest()) for t, v in groups.items()}


@pytest.mark.parametrize("counters", [8, 64, 8192])
def test_exact_dedup_matches_brute_force(spark, docs, rows, none, counters):
    want = plain_classes(rows)
    got = exactdedup.classes(exactdedup.numbered(docs), counters).collect()
    assert len(got) == len(rows)
    text = {hashlib.sha256(low(t).encode()).hexdigest(): low(t) for _, _, t in rows}
    for r in got:
        assert (r["keep_id"], r["group_size"], r["text_sha256"]) == want[text[r["text_sha256"]]]
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for _, i, _ in rows)
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(want) and all(r["doc_id"] == r["keep_id"] for r in kept)
    stay = exactdedup.dedup(docs, counters)
    assert stay.columns == docs.columns and sorted(low(r["text"]) for r in stay.collect()) == sorted(want)
    assert exactdedup.dedup(none, counters).count() == 0 and exactdedup.classes(exactdedup.numbered(none), counters).count() == 0


def test_frequent_digests_are_won_by_exact_counts(spark):
    """Hot groups among many single texts: all of them are found, with exact counts, and nothing rare is."""
    texts = [(i, f"t{i}") for i in range(20000)] + [(100000 + i, "HOT") for i in range(9000)] + [(200000 + i, f"warm {i % 3}") for i in range(6000)]
    texts += [(300000, "hot"), (300001, "pair"), (300002, "pair")]
    d = spark.createDataFrame(texts, "doc_id long, text string").repartition(7)
    n = exactdedup.numbered(d)
    got = {r["text_sha256"]: (r["group_size"], r["last"]["doc_id"]) for r in exactdedup.winners(n, 256).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {sha("hot"): (9001, 300000), **{sha(f"warm {k}"): (2000, 200000 + 5997 + k) for k in range(3)}}
    c = exactdedup.classes(n, 256)
    assert c.filter("kept").count() == 20000 + 5
    assert "MapInArrow" not in (plan := c._jdf.queryExecution().toString()) and "PythonUDF" not in plan


def plain_resample(rows, target, runs, buckets, percent, least):
    def words(t):
        return [x.encode() for x in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))]

    def features(w):
        return [zlib.crc32(b" ".join(w[i:i + m])) % buckets for m in range(1, runs + 1) for i in range(len(w) - m + 1)]
    s, t = Counter(), Counter()
    for _, _, x in rows:
        s.update(features(words(x)))
    for x in target:
        t.update(features(words(x)))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    out = []
    for k, (_, i, x) in enumerate(rows):
        f = features(words(x))
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x))])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able):
        r.append(k + 1 if k < percent * len(able) // 100 else None)
    return sorted((str(r[0]), *r[1:4], r[5] if len(r) > 5 else None) for r in out)


@pytest.mark.parametrize("runs, buckets, percent, least", [(1, 10000, 10, 20), (2, 97, 40, 1), (3, 1000, 100, 0)])
def test_resampling_matches_brute_force(spark, docs, rows, none, runs, buckets, percent, least):
    target = ["w1 w2 w3 w4", "É 日本 w1", None, "", "W1 W2 x y"]
    table = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample.resample(docs, table, runs, buckets, percent, least)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    key = lambda r: (r[0], r[1], r[2], r[3], r[4] or 0)
    assert sorted(((str(r[0]), *r[1:]) for r in got.collect()), key=key) == sorted(plain_resample(rows, target, runs, buckets, percent, least), key=key)
    assert resample.resample(none, table).count() == 0
    assert resample.resample(docs, table.limit(0)).filter("rank is not null").count() > 0


def test_drawn_rows_keep_their_columns(spark, docs):
    table = spark.createDataFrame([("w1 w2 w3 w4",)], "text string")
    ids = {r["doc_id"] for r in resample.resample(docs, table).filter("rank is not null").collect()}
    got = resample.drawn(docs, table)
    assert got.columns == docs.columns and {r["doc_id"] for r in got.collect()} == ids


def test_ranks_over_partitions(spark):
    d = spark.range(0, 5000, 1, 9).selectExpr("id", "(id * 7919) % 100 as score")
    got = {r["id"]: r["rank"] for r in resample.ranked(d, *(d[c].desc() for c in ("score", "id"))).collect()}
    order = sorted(range(5000), key=lambda i: (-(i * 7919 % 100), -i))
    assert got == {i: k + 1 for k, i in enumerate(order)}


def test_short_mails_do_not_run_out(spark):
    """Three hundred mails of one shape that has a hundred surrogates: the rest grow, all differ, and one mail keeps one surrogate."""
    from talkweave.llm import pii
    mails = [f"{i % 10}@{i // 10 % 10}.{tld}" for tld in ("com", "org", "net") for i in range(100)]
    found = spark.createDataFrame([("mail", m) for m in [*mails, *mails[:20]]], "kind string, entity string")
    rows = pii.surrogates(found, b"key").collect()
    new = {r["entity"]: r["surrogate"] for r in rows}
    assert len(rows) == len(new) == 300 and len({x.lower() for x in new.values()}) == 300 and not set(new.values()) & set(mails)
    assert all(x.endswith(".example") for x in new.values())
