"""The corpus operators against brute force, on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from unitflow.llm import bpe, fingerprints, language_id, line_dedup, near_dedup, packing, pii, quality, records, substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    r = random.Random(5)
    words = ["alpha", "beta", "Gamma", "delta", "été", "straße", "naïve", "x", "12", "foo@bar.com", "don't", "日本", " ", "!!"]
    line = "A line long enough to count as a shared one, %d"
    texts = [None, "", " \n\t", "x", "one two", " ".join(r.choice(words) for _ in range(4000)), "a" * 3000, "<|endoftext|> tail  of\n\n text "]
    base = " ".join(f"w{r.randrange(400)}" for _ in range(120))
    for k in range(30):
        parts = base.split()
        for _ in range(k % 7):
            parts[r.randrange(len(parts))] = f"e{r.randrange(50)}"
        texts.append(" ".join(parts))
    for k in range(25):
        own = " ".join(r.choice(words) + str(r.randrange(9)) for _ in range(r.randrange(1, 90)))
        texts.append("\n".join([own, (line % (k % 3)).upper() if k % 2 else "  " + line % (k % 3), own[:20], line % (k % 3)]))
    texts += texts[8:14]
    rows = [(i * 3 - 5, t, r.choice(["en", "fr", None]), "s", 0) for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_line_dedup(docs, rows):
    lower = lambda s: s.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    held = {}
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            k = lower(x.strip(" \t\n\x0b\f\r"))
            if len(k) >= 40:
                held.setdefault(k, set()).add(i)
    want = {}
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if (k := lower(x.strip(" \t\n\x0b\f\r"))) not in held or len(held[k]) < 5 or max(held[k]) == i]
        want[i] = (len(lines), len(lines) - len(keep), "\n".join(keep))
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.line_dedup(docs).collect()}
    assert got == want and any(w[1] for w in want.values())


def test_line_dedup_repeated_rows_and_null_ids(spark):
    text = "this line is held by many documents, and long enough"
    table = spark.createDataFrame([(1, text)] * 3 + [(2, text), (2, "x\n" + text), (3, text), (4, text), (None, text)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_dropped, r.kept_text) for r in line_dedup.line_dedup(table).collect())
    assert got == [(0, 1, ""), *[(1, 1, "")] * 3, (2, 1, ""), (2, 1, "x"), (3, 1, ""), (4, 0, text)]


def test_language_id(spark, rows):
    r = random.Random(1)
    make = {"en": "the and of to in is that was", "de": "der die und ist nicht das ein zu", "fr": "le la et les des une est que", "es": "el los y que en las una por"}
    table = [(i, " ".join(r.choice(make[lang].split()) for _ in range(30)), lang) for i in range(400) for lang in [list(make)[i % 4]]]
    table += [(1000, None, "en"), (1001, "123 !!", "en"), (1002, "", None), (None, "the of and", None)]
    got = language_id.op2_language_id(spark.createDataFrame(table, "doc_id long, text string, lang string")).collect()
    by = {g.doc_id: g for g in got}
    assert len(got) == len(table) and all(0 <= g.score <= 1 for g in got)
    assert {by[i].lang_pred for i in (1000, 1001, 1002)} == {"und"} and by[None].lang_pred == "en"
    assert all(g.held_out == (g.doc_id is not None and zlib.crc32(str(g.doc_id).encode()) % 4 == 2) for g in got)
    held = [i for i in range(400) if by[i].held_out]
    assert sum(by[i].lang_pred == table[i][2] for i in held) >= 0.95 * len(held)


def test_language_id_without_labels(spark):
    table = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert language_id.op2_language_id(table).first().lang_pred == "und"


def test_fingerprints(docs, rows):
    ids = sorted((i for i, *_ in rows), reverse=True)
    texts = {i: t or "" for i, t, *_ in rows}
    after = dict(zip(ids, ids[1:] + ids[:1]))
    got = {r.doc_id: r for r in fingerprints.op3_fingerprints(docs).collect()}
    for i, t in texts.items():
        n, h = len(t), len(t) // 2
        edited = t[: n - h] + texts[after[i]][:h]
        assert (got[i].n_chars, got[i].edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        assert (got[i].fingerprint == got[after[i]].fingerprint) == (t == texts[after[i]])
    assert len({got[i].fingerprint for i in ids}) == len(set(texts.values()))


def test_fingerprints_are_homomorphic(spark):
    df = spark.createDataFrame([("a b.\nc d", "c d\na b.", "a b.", "c d")], "t string, u string, x string, y string")
    v = fingerprints.vector
    row = df.select(v("t").alias("t"), v("u").alias("u"), fingerprints.combine(v("x"), v("y")).alias("xy"), fingerprints.combine(v("t"), v("y"), -1).alias("t_y"), v("x").alias("x")).first()
    assert row.t == row.u == row.xy and row.t_y == row.x != row.t


def test_packing(docs, rows):
    t = Tokenizer.from_file(WORD)
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x, *_ in rows}
    got = packing.op4_packing(docs, WORD).collect()
    full = {}
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == 2048 * r.piece and zlib.crc32(struct.pack(f"<{len(part)}I", *part)) == r.ids_crc32
        full.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in got) == sum(map(len, ids.values()))
    for places in full.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(full) <= 1 + -(-sum(map(len, ids.values())) // 2048)


def test_best_fit_takes_the_tightest():
    r = random.Random(3)
    lengths = sorted((r.randrange(1, 101) for _ in range(500)), reverse=True)
    places, offsets = packing.best_fit(lengths, 100)
    room = []
    for n, p, o in zip(lengths, places, offsets):
        best = min((x for x in room if x >= n), default=None)
        if best is None:
            assert p == len(room) and o == 0
            room.append(100 - n)
        else:
            assert room[p] == best and o == 100 - best
            room[p] -= n


def brute_components(rows, width, percent):
    sets = {}
    for i, t, *_ in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize("small", [16, 1])
def test_near_dedup(docs, rows, small, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL", small)
    monkeypatch.setattr(near_dedup, "STARS", 1 if small == 1 else 3)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.op5_near_dedup(docs).collect()}
    assert got == brute_components(rows, 2, 80)


def test_near_dedup_repeated_and_null_ids(spark):
    table = spark.createDataFrame([(1, "a b c"), (1, "x y z"), (2, "X y z"), (3, None), (None, "a b c"), (5, "a b c")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id, r.kept) for r in near_dedup.op5_near_dedup(table).collect())
    assert got == [(0, None, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True), (5, 1, False)]


def test_superminhash_estimates():
    r = np.random.default_rng(0)
    found = []
    for _ in range(50):
        x = r.integers(0, 2**63, 300).astype(np.uint64)
        y = np.concatenate((x[:240], r.integers(0, 2**63, 60).astype(np.uint64)))
        h = near_dedup.superminhash([x, y], 128)
        found.append((h[0] == h[1]).mean())
    assert abs(np.mean(found) - 240 / 360) < 0.02


def test_bpe(docs, rows):
    t = Tokenizer.from_file(BYTE)
    got = {r.doc_id: r for r in bpe.op6_bpe(docs, BYTE).collect()}
    for i, x, *_ in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_encoders_on_random_strings():
    from unitflow.llm.tokens import library_encoder, packed, vocabulary

    r, byte, word = random.Random(9), Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
    vocab = vocabulary(BYTE)
    _, own = bpe.coder(vocab)
    lib, words = library_encoder("byte", vocab), library_encoder("word", vocabulary(WORD))
    signs = [*"abcdefghiTHE    \n\t\r", "é", "É", "İ", "ß", "'s", "'LL", "9", "<|endoftext|>", " ", " ", "日", "́", "\x1c", "\0", "the", "ing"]
    for _ in range(3000):
        x = "".join(r.choice(signs) for _ in range(r.randrange(25)))
        want = packed(byte.encode(x, add_special_tokens=False).ids)
        assert own(x.encode()) == want and lib(x.encode()) == want, x
        assert words(x.encode()) == packed(word.encode(x, add_special_tokens=False).ids), x
    for x in ("a" * 4000, "ab" * 2000, " " * 999, "ha" * 50 + "hah" * 50):
        assert own(x.encode()) == packed(byte.encode(x, add_special_tokens=False).ids)


def brute_pii(x):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x):
        d = re.sub("[^0-9]", "", m[0])
        luhn = sum(int(c) if k % 2 == 0 else (2 * int(c) - 9 * (c > "4")) for k, c in enumerate(reversed(d))) % 10 == 0
        if 16 <= len(d) <= 19 and luhn:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans():
    r = random.Random(2)
    for _ in range(5000):
        x = "".join(r.choice(["1", "22", "255", "256", ".", "-", " ", "+", "(", ")", "@", "a", "b.c", "_", "é", "4111111111111111", "\n"]) for _ in range(r.randrange(30)))
        assert pii.base_spans(x) == brute_pii(x), x
    pii.base_spans("1" * 200_000 + "a" * 200_000 + "@" + "+1" * 50_000)


def test_pii_bootstraps_and_redacts(spark):
    table = [(i, f"write to user{i}@mail.example.com or key AB{i:02d}CD7788XY now 4111 1111 1111 1111") for i in range(9)]
    table += [(10 + i, f"please write to TOKEN{i}5577AA today") for i in range(2)] + [(20, "nothing 12345678 here"), (21, None), (None, "mail a@b.co")]
    df = spark.createDataFrame(table, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.op7_pii(df).collect()}
    for i, x in table:
        base = brute_pii(x or "")
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert got[i].spans.startswith(",".join(f"{k}:{a}:{b}" for k, a, b in base))
    assert got[10].spans == "id:16:28" and got[20].spans == "" and got[21].spans == ""
    text = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert text[0] == "write to <EMAIL> or key AB00CD7788XY now <CARD>" and text[10] == "please write to <ID> today" and text[21] is None and text[None] == "mail <EMAIL>"


def test_pii_bootstraps_until_nothing_is_added(spark):
    name = lambda hop, k: f"ab{hop}{k}cd77" if hop else f"u{k}@a.org"
    lines = [(hop, k, f"w{'abcdefgh'[hop]}{'abcd'[k]} {x}") for hop in range(1, 8) for k in range(4) for x in [*(name(hop - 1, i) for i in range(4)), name(hop, k)]]
    df = spark.createDataFrame([(i, x) for i, (*_, x) in enumerate(lines)], "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.op7_pii(df).collect()}
    assert all(spans[i] == (f"id:4:{len(x)}" if "@" not in x else f"email:4:{len(x)}") for i, (*_, x) in enumerate(lines))
    assert all(r.text[4:] in ("<ID>", "<EMAIL>") for r in pii.redact(df).collect())


def test_pii_finds_runs_and_short_words(spark):
    table = [(i, f"ask the desk under u{i}@m.org") for i in range(12)] + [(12, "ask the desk under 555 123 4567, please"), (13, "ask the desk under K7."), (14, "lines 555 123 4567 and K7 alone"), (15, "ask the desk under noon")]
    got = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(12, 16)] == ["ask the desk under <ID>, please", "ask the desk under <ID>.", "lines <ID> and K7 alone", "ask the desk under noon"]


def test_pii_instances():
    found = lambda x: [(x[i["start"] : i["end"]], i["tier"]) for i in pii.analyse(x)[1]]
    assert found("(4111 1111 1111 1112) 12 345. 1 2a") == [("4111 1111 1111 1112", pii.LONG), ("12 345", pii.SHORT), ("1", pii.SHORT), ("2a", pii.SHORT)]
    assert found("+1 555 123 4567 x 12345678 90") == [("+1 555 123 4567", pii.TOKEN), ("12345678 90", pii.LONG), ("12345678", pii.TOKEN)]
    assert found("555 123 4567, (555) 123 4567. 7 ... 1") == [("555 123 4567", pii.LONG), ("(555) 123 4567", pii.LONG), ("7", pii.SHORT), ("1", pii.SHORT)]
    pii.analyse("1 " * 100_000 + "a")


def test_quality(docs, rows):
    got = {r.doc_id: r for r in quality.op8_quality(docs).collect()}
    for i, t, *_ in rows:
        x = t or ""
        w = SPACE.findall(x)
        wins = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        n = Counter(wins)
        covered = {j for k, v in enumerate(wins) if n[v] > 1 for j in range(k, k + 8)}
        lines = [y for y in x.split("\n") if SPACE.search(y)]
        g = got[i]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in x), len(lines) - len(set(lines)), len(covered))
        assert g.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and not (g.base_failed and g.kept)


def test_quality_ablations(docs):
    led = quality.ledger(docs.select("doc_id", "text")).cache()
    found = {r.rule: r for r in quality.ablations(led).collect()}
    bits = [r.failed for r in led.select("failed").collect()]
    every = quality.mask(quality.POLICIES["v1"])
    for name, bit in quality.BIT.items():
        b = 1 << bit
        assert (found[name].n_failed, found[name].n_only, found[name].n_kept_without) == (sum(x & b > 0 for x in bits), sum(x & every == b for x in bits), sum(x & every & ~b == 0 for x in bits))


def test_records(docs, rows, tmp_path):
    t = Tokenizer.from_file(BYTE)
    got = {r.doc_id: r for r in records.token_output(docs, BYTE, str(tmp_path / "out")).collect()}
    start = 0
    for i, x, *_ in sorted(rows):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    shard = min(int(p.stem) for p in (tmp_path / "out").glob("*.rec"))
    doc_id, ids = records.read_at(str(tmp_path / "out"), shard, 2)
    assert len(ids) == got[doc_id].n_tokens and zlib.crc32(ids.tobytes()) == got[doc_id].ids_crc32


def test_records_notice_damage():
    import io

    whole = records.frame(records.serialise(7, np.arange(5, dtype="<u4"), 2))
    doc_id, ids = records.parse(records.read_record(io.BytesIO(whole)))
    assert doc_id == 7 and ids.tolist() == [0, 1, 2, 3, 4]
    for k in range(len(whole)):
        with pytest.raises(ValueError):
            records.read_record(io.BytesIO(whole[:k] + bytes([whole[k] ^ 1]) + whole[k + 1 :]))


@pytest.mark.parametrize("limit", [substring_dedup.ANCHOR_BYTES, 0])
def test_substring_dedup(docs, rows, limit):
    seen, want = set(), {}
    for i, t, *_ in sorted(rows):
        w = SPACE.findall(t or "")
        gone = set()
        for k in range(len(w) - 19):
            win = tuple(w[k : k + 20])
            if win in seen:
                gone.update(range(k, k + 20))
            seen.add(win)
        want[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.substring_dedup(docs, limit).collect()}
    assert got == want and any(v[1] for v in want.values())


def test_cover_has_every_difference():
    assert {(a - b) % substring_dedup.PERIOD for a in substring_dedup.COVER for b in substring_dedup.COVER} == set(range(substring_dedup.PERIOD))


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    results = [line_dedup.op1_line_dedup(none), language_id.op2_language_id(none), fingerprints.op3_fingerprints(none), packing.op4_packing(none, WORD), near_dedup.op5_near_dedup(none), bpe.op6_bpe(none, BYTE), pii.op7_pii(none), quality.op8_quality(none), records.op9_token_output(none, BYTE), substring_dedup.op10_substring_dedup(none)]
    assert [r.count() for r in results] == [0] * 10


def test_clashing_columns(spark):
    df = spark.createDataFrame([(i, "some words here that repeat\n" * 4, "en", 1, 2, "t", 9) for i in range(6)], "doc_id long, text string, lang string, id long, of long, kept_text string, at int")
    for out in (line_dedup.line_dedup(df), substring_dedup.substring_dedup(df), language_id.language_id(df), pii.redact(df), quality.ledger(df)):
        assert out.count() == 6 and {"id", "of", "at"} <= set(out.columns)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, f"the words of document {i} are the and of in to that {'x' * i}", "en", "s", 1) for i in range(8)]
    rows += [(100, rows[0][1], "en", "s", 1), (101, None, "en", "s", 1), (102, "123", None, "s", 1), (103, "write to me@mail.org the and of to in", "en", "s", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
    texts = {r.doc_id: r for r in docs.collect()}
    assert not {100, 101, 102} & set(texts) and texts[103].text == "write to <EMAIL> the and of to in" and texts[103].n_chars == len(texts[103].text)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == set(texts)


def test_near_stage_keeps_distinct_texts_of_one_id(spark):
    import corpus_pipeline

    a, b, c, d = (" ".join(f"{x}{k}" for k in range(60)) for x in "abcd")
    rows = [(1, a, "fr", "s", 1), (1, a, "en", "s", 1), (1, b, "en", "s", 1), (2, a + " end", "en", "s", 1), (2, c, "en", "s", 1), (3, b, "en", "s", 1), (4, d, "en", "s", 1), (None, a, "en", "s", 1)]
    kept = corpus_pipeline.near_stage(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "").collect()
    assert sorted((r.doc_id or 0, r.text, r.lang) for r in kept) == [(0, a, "en"), (1, a, "en"), (1, b, "en"), (2, c, "en"), (4, d, "en")]


def test_oracles_run_over_whole_tables():
    from unitflow.llm import queries

    assert set(queries.oracle_sql()) <= set(queries.queries()) and len(queries.queries()) == 10
