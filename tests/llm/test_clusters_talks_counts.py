"""Clustering, conversation repair and token counts against brute force."""

import hashlib
import heapq
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from unitflow.llm import centroids, conversations, token_counts
from unitflow.llm.queries import queries

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


# --- clustering


def brute_clusters(rows, k=8, rounds=10, dim=64, scale=1024):
    kept = [(i, [math.floor(float(np.float32(x)) * scale) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    points = np.array([v for _, v in kept], np.int64).reshape(-1, dim)
    key = lambda n: (kept[n][0] is None, hashlib.sha256(f"3:{kept[n][0]}".encode()).hexdigest(), kept[n][1])
    c = points[sorted(range(len(kept)), key=key)[:k]]
    near = lambda c: ((points[:, None] - c[None]) ** 2).sum(2)
    for _ in range(rounds if len(c) else 0):
        of = near(c).argmin(1)
        c = np.array([points[of == n].sum(0) // (of == n).sum() if (of == n).any() else c[n] for n in range(len(c))])
    if not len(c):
        return []
    gaps = near(c)
    of, gap = gaps.argmin(1), gaps.min(1)
    digest = [hashlib.sha256(",".join(map(str, x.tolist())).encode()).hexdigest() for x in c]
    return [(kept[n][0], int(of[n]), int(gap[n]), int(gap[of == of[n]].sum()), int(gap.sum()), digest[of[n]]) for n in range(len(kept))]


def vectors(seed, n, spread):
    r = np.random.default_rng(seed)
    centres = r.normal(0, spread, (12, 64))
    return [(int(i), [float(x) for x in (centres[r.integers(12)] + r.normal(0, 0.05, 64)).astype(np.float32)]) for i in range(n)]


EMBEDDINGS = "vec_id long, embedding array<float>, label int, cluster string, distance long"


def test_clusters_against_brute_force(spark):
    rows = vectors(1, 700, 0.2)
    rows += [(7, rows[7][1]), (9000, rows[3][1]), (None, rows[5][1])] + [(8000 + k, rows[11][1]) for k in range(150)]
    odd = [(1, None), (2, []), (3, [0.1] * 63), (4, [0.1] * 63 + [None]), (5, [float("nan")] * 64), (6, [float("inf")] + [0.0] * 63), (7, [0.1] * 65)]
    df = spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows + odd], EMBEDDINGS).repartition(5)
    got = centroids.op11_centroids(df).collect()
    key = lambda t: (t[0] is None, t)
    assert sorted(map(tuple, got), key=key) == sorted(brute_clusters(rows), key=key)


def test_clusters_of_ties_few_and_no_vectors(spark):
    same = [(k, [0.5] * 64) for k in range(20)]
    line = [(k, [k / 1024] + [0.0] * 63) for k in range(40)]
    for rows in (same, line, line[:3], []):
        df = spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], EMBEDDINGS)
        assert sorted(map(tuple, centroids.op11_centroids(df).collect())) == sorted(brute_clusters(rows))


def test_clusters_do_not_depend_on_blocks(spark):
    rows = vectors(2, 400, 0.1)
    df = spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], EMBEDDINGS)
    a, b = centroids.cluster(df.repartition(7), k=5, rounds=4, block=50), centroids.cluster(df.coalesce(1), k=5, rounds=4)
    assert a.centroids == b.centroids and a.inertia == b.inertia
    assert sorted(map(tuple, a.assigned.collect())) == sorted(map(tuple, b.assigned.collect()))


def test_tree_prunes_whole_nodes_and_large_numbers_are_exact():
    r = np.random.default_rng(3)
    points = np.concatenate([c + r.integers(-3, 4, (200, 64)) for c in r.integers(-500, 500, (6, 64))])
    for shift in (1, 1 << 17):
        tree, order = centroids.Tree.build(points * shift)
        c = points[[0, 1, 200, 400, 600, 600, 800, 1000]] * shift
        want = ((points[:, None] * shift - c[None]) ** 2).sum(2)
        of, gap = tree.assigned(c)
        assert (of == want.argmin(1)[order]).all() and (gap == want.min(1)[order]).all()
        nodes = [w for owner, *w in tree.owners(c) if owner is not None]
        assert nodes and min(w[0] for w in nodes) < 31  # whole clusters go at once
        count, sums = tree.totals(c)
        assert count.tolist() == np.bincount(want.argmin(1), minlength=8).tolist() and count[5] == 0
        assert all((sums[k] == (points * shift)[want.argmin(1) == k].sum(0)).all() for k in range(8))
    with pytest.raises(ValueError):
        centroids.cluster(None, dim=1 << 20)


# --- conversations


def cheapest(rows):
    """Least (cost, audit) and the repaired rows by shortest paths over rows and states: rows are (role, text, fault)."""
    queue, done = [(0, "", 0, 0, ())], set()
    while queue:
        cost, audit, i, state, made = heapq.heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in (0, 3):
            return cost, audit, list(made)
        to, role = (3, "assistant") if state == 2 else (2, "user")
        heapq.heappush(queue, (cost + 3, audit + "I", i, to, (*made, (role, ""))))
        if i < len(rows):
            old, text, fault = rows[i]
            heapq.heappush(queue, (cost + 4, audit + "D", i + 1, state, made))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                heapq.heappush(queue, (cost + 3 + more, audit + "R", i + 1, to, (*made, (role, text))))
                legal = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}.get(old[:1], {})
                if state in legal:
                    heapq.heappush(queue, (cost + more, audit + "K", i + 1, legal[state], (*made, (old, text))))


def brute_repair(table):
    """table of (conv_id, turn, role, text) to conv_id: the columns of the query."""
    space, after, text_hash = " \t\n\x0b\f\r", {}, {}
    for conv, turn, role, text in table:
        say = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20
        role, text = say(role), say(text)
        rows = after.setdefault(conv, [])
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        rows += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, rows in after.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        seen, told = set(), []
        for _, role, text in rows:
            bare = text.rstrip(space)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"
            seen.add((role, text))
            told.append((role, text, fault))
        n = Counter(f for *_, f in told)
        turns = {t for t, *_ in rows if t is not None}
        cost, audit, made = cheapest(told)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(told, told[1:]))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, digest)
    return out


TURNS = "conv_id long, turn long, role string, text string, at string, code long"


def talk(seed, n, longest):
    r = random.Random(seed)
    rows = []
    for conv in range(n):
        turn = r.randrange(-2, 5)
        for _ in range(r.randrange(1, longest)):
            turn += r.choice([1, 1, 1, 2, 5])
            rows.append((conv, turn, r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "ünser"]), r.choice([f"Text {r.randrange(4)}.", "Cut of", "Really?  \n", None, "", "\t ", "Été", "…", f"No {turn}!"])))
    return rows


def compared(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS).repartition(3)
    got = {r[0]: tuple(r)[1:] for r in conversations.op12_conversations(df).collect()}
    want = brute_repair(rows)
    assert got.keys() == want.keys()
    assert {k: (got[k], want[k]) for k in want if got[k] != want[k]} == {}


def test_conversations_against_shortest_paths(spark):
    compared(spark, talk(1, 250, 14))


def test_conversations_null_ids_turns_and_repeats(spark):
    rows = [(None, k, "user" if k % 2 else "assistant", f"Line {k}.") for k in range(9)]
    rows += [(50, None, "user", "Same."), (50, None, "user", "Same."), (50, 3, "assistant", "Yes.")]
    rows += [(51, 2, "system", "Be."), (51, 9, "user", "x" * 200_000), (52, 0, None, None)]
    rows += [(60 + k, 0, "user", "Hi.") for k in range(60)]
    compared(spark, rows)
    assert brute_repair(rows)[51][0] in (0, 6)
    empty = spark.createDataFrame([], TURNS)
    assert conversations.op12_conversations(empty).collect() == []


def test_long_conversation_is_split_into_runs(spark, monkeypatch):
    monkeypatch.setattr(conversations, "RUN_BITS", 3)
    compared(spark, talk(4, 6, 120) + talk(5, 1, 2))


def test_every_short_signature_and_its_parts():
    """solve() and chosen() over all signatures of up to four letters, whole and cut in two, against shortest paths."""
    fault = {"-": "blank", **{c: "" for c in "suax"}, **{c: "truncated" for c in "SUAX"}}
    for n in range(1, 5):
        for letters in itertools.product("sua-xSUA"[: 8 if n < 4 else 5], repeat=n):
            name = "".join(letters)
            cost, audit, _ = cheapest([(c.lower(), "t", fault[c]) for c in name])
            for parts in [[name], *([name[:k], name[k:]] for k in range(1, n))]:
                found = [conversations.solve(p) for p in parts]
                ranks = []
                for f in found:
                    order = sorted(range(16), key=lambda k: f[k][1].upper() if f[k] else "~")
                    ranks.append([order.index(k) if f[k] else None for k in range(16)])
                total, picks, tail = conversations.chosen([[x and x[0] for x in f] for f in found], ranks)
                assert (total, "".join(f[p][1] for f, p in zip(found, picks)).upper() + tail.upper()) == (cost, audit), (parts, picks)


def test_a_signature_of_a_full_run_is_solved():
    name = "".join(random.Random(3).choice("suaUA-x") for _ in range(1 << conversations.RUN_BITS))
    assert conversations.solve(name)[3][1].count("D") >= name.count("-")


# --- token counts

DOCS = "doc_id long, text string, n_tokens string, block long"


def texts():
    r = random.Random(8)
    words = ["alpha", "Beta", "été", "ÉTÉ", "don't", "日本語", "x1y22", "!!!", "<|endoftext|>", "<|ENDOFTEXT|>", "İstanbul", "é", " ", " ", "'s", "''s", "naïve", "ß", "\U0001f600"]
    out = [None, "", " ", "\n\n", "a", "<|endoftext|>", "a<|endoftext|>b", "x" * 30_000, "the " * 50_000, "́" * 5, "a b"]
    return out + ["".join(r.choice(words) + r.choice([" ", "", "\n", "  ", "\t"]) for _ in range(r.randrange(1, 60))) for _ in range(300)]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_token_counts_against_the_library(spark, path):
    rows = list(enumerate(texts())) + [(None, "null id"), (3, "again"), (3, "again")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS).repartition(3)
    t = Tokenizer.from_file(path)
    want = Counter((i, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False)), n > 2048) for i, x in rows)
    assert Counter(map(tuple, token_counts.op13_token_counts(df, path).collect())) == want
    assert token_counts.op13_token_counts(df.limit(0), path).collect() == []


def test_token_counts_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK", 200)
    rows = [(k, f"word{k % 7} and the same {k}") for k in range(500)]
    t = Tokenizer.from_file(WORD)
    got = token_counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), WORD).collect()
    assert {(r.doc_id, r.n_tokens) for r in got} == {(k, len(t.encode(x, add_special_tokens=False))) for k, x in rows} and len(got) == 500


# --- over the driver's tables


def test_over_the_given_tables(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {r[0]: tuple(r)[1:] for r in queries()["op12_conversations"](spark, sf).collect()} == brute_repair(rows)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert sorted(map(tuple, queries()["op11_centroids"](spark, sf).collect())) == sorted(brute_clusters(rows))
