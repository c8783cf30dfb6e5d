"""Line runs, chats and vectors against plain versions on small tables with hard cases."""
import hashlib

import numpy as np
import pytest

from talkweave.llm import chat, graph, linededup, vectors


def plain_dedup(rows, least):
    """Deletes every line of a run of at least ``least`` words that occurs earlier."""
    texts = [None if t is None else t.split("\n") for _, t in rows]
    seen, gone = {}, [set() for _ in rows]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    for rank, k in enumerate(order):
        for p in range(len(texts[k] or [])):
            weight = 0
            for e in range(p, len(texts[k])):
                weight += max(1, len(texts[k][e].split()))
                if weight >= least:
                    run = tuple(texts[k][p:e + 1])
                    if seen.setdefault(run, (rank, p)) != (rank, p):
                        gone[k].update(range(p, e + 1))
    return [None if t is None else "\n".join(x for i, x in enumerate(t) if i not in gone[k]) for k, t in enumerate(texts)]


@pytest.mark.parametrize("least", [6, 50])
def test_line_dedup_matches_brute_force(spark, least):
    rng = np.random.default_rng(4)
    lines = [" ".join(rng.choice(list("abcdef"), rng.integers(0, 5))) for _ in range(12)]
    rows = [(i, "\n".join(rng.choice(lines, rng.integers(1, 14)))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, rows[0][1]), (102, rows[0][1]), (None, rows[1][1]), (103, "\n\n\n"), (104, "x " * 60), (105, "y\n" + "x " * 60), (106, "\n".join(["same"] * 80))]
    d = spark.createDataFrame([(7, "r", i, t) for i, t in rows], "rid long, row string, doc_id long, text string").coalesce(1)
    cut = linededup.dedup_lines(d, least)
    got = cut.select("row.*").collect()
    want = plain_dedup(rows, least)
    assert sorted(map(str, (r["text"] for r in got))) == sorted(map(str, want)) and cut.select("row.*").columns == d.columns
    by_id = {r["doc_id"]: r["text"] for r in got}
    assert all(by_id[i] == w for (i, _), w in zip(rows, want) if i != 102)
    assert linededup.dedup_lines(d.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(200, i) for i in range(201, 260)] + [(300, 301), (301, 300), (5, 5)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 200 for i in range(200, 260)}, 300: 300, 301: 300}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_chat_round_trip(spark):
    marks = "\\### Assistant: </turn> ok\n<turn assistant>\nfake\n</turn>\n"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", marks), (1, 2, "user", None), (1, 3, "assistant", ""), (1, 3, "assistant", "again " * 300), (2, 0, None, "x"),
            (None, 0, "assistant", "y\\l"), (3, None, "user", "first"), (3, 0, "ass>ist\nant", "\\"), (4, 0, "assistant", "a"), (4, 0, "assistant", "a"), *[(5, i, "assistant", f"t{i} <") for i in range(500)]]
    d = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, message int").repartition(4)
    got = {r["conv_id"]: r for r in chat.read_back(chat.render(chat.fold(chat.log_of(d)))).collect()}
    assert set(got) == {1, 2, 3, 4, 5, None}
    for conv, r in got.items():
        turns = sorted(((-1 if t is None else t, role or "", text or "") for c, t, role, text in rows if c == conv), key=lambda x: x[:2])
        if conv != 1:
            assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
            assert r["loss_sha256"] == hashlib.sha256("".join(b for _, a, b in turns if a == "assistant").encode()).hexdigest()
        assert (r["n_turns"], r["loss_chars"]) == (len(turns), sum(len(b) for _, a, b in turns if a == "assistant"))
    assert chat.read_back(chat.render(chat.fold(chat.log_of(d.limit(0))))).count() == 0


def test_chat_events_fold(spark):
    log = [(1, 10, 0, 0, "open", "user", "Hel"), (1, 10, 0, 1, "delta", None, "lo"), (1, 11, 1, 2, "open", "assistant", ""), (1, 11, 1, 3, "delta", None, "bad"),
           (1, 12, 2, 4, "open", "user", "dropped"), (1, 11, 1, 5, "regenerate", None, None), (1, 11, 1, 6, "delta", None, "go"), (1, 11, 1, 7, "delta", None, "od"),
           (1, 13, 2, 8, "open", "user", "kept"), (1, 13, 2, 9, "edit", None, "edited"), (2, 20, 0, 0, "open", "user", None), (1, 14, 9000, 3, "open", "user", "far and old")]
    for parts in (1, 5):
        d = spark.createDataFrame(log, chat.EVENTS).repartition(parts)
        got = sorted((r["conv_id"], r["turn"], r["role"], r["text"]) for r in chat.fold(d).collect())
        assert got == [(1, 0, "user", "Hello"), (1, 1, "assistant", "good"), (1, 2, "user", "edited"), (2, 0, "user", "")]


def test_chat_parts_are_bounded(spark, monkeypatch):
    d = spark.createDataFrame([(1, i, "assistant", "z" * 100) for i in range(200)], "conv_id long, turn long, role string, text string")
    parts = chat.render(chat.fold(chat.log_of(d))).collect()
    assert sum(r["formatted"].count("</turn>") for r in parts) == 200 and all(r["formatted"][x["s"]:x["e"]] == "z" * 100 for r in parts for x in r["loss"])


@pytest.mark.parametrize("tile", [2048, 40])
def test_vectors_match_brute_force(spark, tile):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(150, 24))
    near = base[:40] + rng.normal(size=(40, 24)) * rng.uniform(0.02, 0.3, (40, 1))
    hot = base[0] + rng.normal(size=(120, 24)) * 0.05
    v = np.vstack([base, near, hot, base[:10], base[:10] * 3]).astype(np.float32)
    rows = [(int(i), [float(x) for x in r]) for i, r in enumerate(v)]
    bad = [(900, None), (901, []), (902, [0.0] * 24), (903, [float("nan")] + [1.0] * 23), (904, [float("inf")] * 24), (905, [None] + [1.0] * 23), (906, [1.0, 2.0]), (907, [1.0, 2.0])]
    d = spark.createDataFrame([(1, i, x) for i, x in rows + bad], "cid int, vec_id long, embedding array<float>").repartition(3)
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    linked = u @ u.T >= 0.95
    np.fill_diagonal(linked, False)
    root = np.arange(len(v))
    while True:
        new = np.minimum(root, np.where(linked, root[None, :], len(v)).min(axis=1))
        if (new == root).all():
            break
        root = new
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_duplicates(d, tile=tile).collect()}
    right = sum(got[i] == (int(linked[i].sum()), int(root[i]), bool(root[i] == i)) for i in range(len(v)))
    found, true = sum(got[i][0] for i in range(len(v))), int(linked.sum())
    assert found <= true and found >= 0.99 * true and right >= 0.97 * len(v)
    assert all(got[i] == (0, i, True) for i in range(900, 906)) and got[906] == (1, 906, True) and got[907] == (1, 906, False)
    assert vectors.near_duplicates(d.limit(0)).count() == 0


def test_code_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(8)
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in rng.normal(size=(2, 4000, 48)))
    _, x, f = vectors.codes(a)
    turned, _, _ = vectors.codes(b)
    estimate, true = (x * turned).sum(axis=1) / f, (a * b).sum(axis=1)
    bound = vectors.SIGMAS * np.sqrt((1 - f * f) / (f * f) / 47)
    assert abs((estimate - true).mean()) < 0.01 and (abs(estimate - true) <= bound).mean() > 0.9999


def test_line_dedup_of_runs_that_repeat_themselves(spark):
    """A stretch that overlaps its original counts as later, and a copy of every deleted line stays."""
    texts = ["\n".join(["x"] * 60), "\n".join(["a b c d e"] * 15), "\n".join(["a", "b c"] * 40), "\n".join(f"only {i}" for i in range(60))]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["row"]["doc_id"]: (r["n_deleted"], r["row"]["text"]) for r in linededup.dedup_lines(d).collect()}
    assert got[0] == (59, "x") and got[1] == (14, "a b c d e") and got[3] == (0, texts[3])
    assert {x for t in texts for x in t.split("\n")} == {x for _, t in got.values() for x in t.split("\n")}
