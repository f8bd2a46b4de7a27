"""Clashing columns, repeated rows, null ids and long texts for every operator and stage."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from unitflow.llm import bpe, common, fingerprints, language_id, line_dedup, near_dedup, packing, pii, quality, records, substring_dedup

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
HELPERS = ["_at", "_group", "_of", "_pii_id", "_rid", "_rof", "_spans", "_text", "added", "any_twice", "at", "base", "drop_at", "drop_id", "drop_of", "dropped", "found", "full", "h", "id", "keep", "kept", "known_id", "label", "lines", "n", "of", "own_text", "pack_group", "places", "pos", "row", "salt", "spans", "to_id", "twice", "w", "w1", "w8", "whole", "words", "_place", "_row", "place", "a.b", "N words"]


def texts():
    line = "a line that is held by many documents and is long enough"
    return [f"{line}\nwrite to user{i}@mail.example.com and more words here {i}" for i in range(6)]


@pytest.mark.parametrize("name", ["line_dedup", "substring_dedup", "language_id", "redact", "ledger"])
def test_any_helper_name_may_be_a_column(spark, name):
    f = {"line_dedup": line_dedup.line_dedup, "substring_dedup": substring_dedup.substring_dedup, "language_id": language_id.language_id, "redact": pii.redact, "ledger": quality.ledger}[name]
    plain = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts())], "doc_id long, text string, lang string")
    want = f(plain)
    wide = plain.select("*", *[F.concat(F.lit(f"{h} "), F.col("doc_id").cast("string")).alias(h) for h in HELPERS])
    got = f(wide)
    own = common.quoted(HELPERS)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    rows = got.select("doc_id", *own).collect()
    assert len(rows) == 6 and all(r[h] == f"{h} {r.doc_id}" for r in rows for h in HELPERS)


def test_repeated_rows_get_equal_results(spark):
    rows = [(None, "same text for many rows of no id\n" * 3)] * 5 + [(7, "one two three four. five")] * 4 + [(7, None), (8, ""), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for made in (fingerprints.op3_fingerprints(df), bpe.op6_bpe(df, BYTE), pii.op7_pii(df), quality.op8_quality(df), substring_dedup.op10_substring_dedup(df), line_dedup.op1_line_dedup(df), near_dedup.op5_near_dedup(df)):
        got = made.collect()
        assert len(got) == len(rows) and len({str(r) for r in got}) <= 5
    ids = [r.doc_id for r in records.op9_token_output(df, BYTE).orderBy("start").collect()]
    assert ids == [None] * 6 + [7] * 5 + [8]
    packed = packing.op4_packing(df, WORD).collect()
    assert len(packed) == len(rows) and len({(r.sequence_id, r.offset) for r in packed}) == len(rows)


def test_packing_splits_equal_pieces_over_groups(spark):
    table = common.written(packing.pieces(spark.createDataFrame([(None, "a b c")] * 3000, "doc_id long, text string").repartition(4), WORD), "pieces")
    got = packing.pack(table, most=64, group=256).groupBy((F.col("sequence_id") / (1 << 32)).cast("int").alias("g")).count().collect()
    assert sum(r["count"] for r in got) == 3000 and len(got) == 12 and max(r["count"] for r in got) < 512
    full = packing.pack(table, most=64, group=256).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert full.filter("n <> end or n > 64").isEmpty() and full.count() <= -(-3000 * 4 // 64) + 12


def test_language_sample_is_bounded(spark):
    same = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the of and to").alias("text"), F.lit("en").alias("lang"))
    other = spark.range(500).select("id", F.concat(F.lit("le la et les "), F.col("id").cast("string")), F.lit("fr"))
    n = {r.lang: r["count"] for r in language_id.sampled(same.union(other), sample=50).groupBy("lang").count().collect()}
    assert n["en"] == 50 and 20 <= n["fr"] <= 50
    many = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"), F.concat(F.lit("l"), (F.col("id") % 30).cast("string")).alias("lang"))
    got = language_id.sampled(many, sample=50, total=100, languages=10).groupBy("lang").count().collect()
    assert len(got) <= 10 and all(r["count"] <= 10 for r in got)


def test_language_votes_against_brute_force(spark):
    """Every prediction again, from plain shares of trigrams and all machines one by one."""
    r = random.Random(6)
    make = {"en": "the and of to in is that was", "de": "der die und ist nicht das ein zu", "fr": "le la et les des une est que", "es": "el los y que en las una por", "xx": "zu ka mo ri", "sv": "och det att som en på är"}
    rows = [(i, " ".join(r.choice(make[lang].split()) for _ in range(r.randrange(1, 30))), lang) for i in range(600) for lang in [list(make)[i % 6]]] + [(1000, "É" * 9, None), (1001, "the " * 100_000, None), (1002, "l", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df)

    def features(text):
        data = b" " + text.encode().lower() + b"  "
        out = np.zeros(language_id.DIM)
        for k in range(len(data) - 2):
            code = data[k] * 65536 + data[k + 1] * 256 + data[k + 2]
            out[(code * 2654435761 % 2**32) >> 20] += language_id.SCALE / (len(data) - 2)
        return out

    def vote(x, group):
        won, total, least = dict.fromkeys(group, 0), dict.fromkeys(group, 0.0), dict.fromkeys(group, 1.0)
        for (a, b), w, bias in zip(model.pairs, model.weights, model.biases):
            if a in group and b in group:
                m = float(x @ w.astype(float) + bias)
                p = 1 / (1 + np.exp(-np.clip(2 * m, -30, 30)))
                won[a if m > 0 else b] += 1
                total[a], total[b] = total[a] + m, total[b] - m
                least[a], least[b] = min(least[a], p), min(least[b], 1 - p)
        best = max(group, key=lambda g: (won[g], total[g], g))
        return best, least[best]

    got = {g.doc_id: g for g in language_id.op2_language_id(df).collect()}
    assert model.families == ["germanic", "other", "romance"] and len(model.pairs) == 3 + 3 + 1
    for i, text, _ in rows:
        x = features(text)
        family, p = vote(x, model.families)
        lang, q = vote(x, model.members[family])
        assert (got[i].lang_pred, round(got[i].score, 3)) == (lang, round(p * q, 3)), text[:50]


def test_fingerprint_likeness_against_brute_force(spark):
    """near_edited and near_next from the vectors' own lanes, and the cosine of random signs of sentences."""
    a = [f"sentence number {k} of the text." for k in range(200)]
    b = a[:150] + [f"another sentence {k}." for k in range(50)]
    df = spark.createDataFrame([(2, " ".join(a)), (1, " ".join(b)), (0, "x\ny")], "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprints.fingerprints(df).select("doc_id", "vec", "next_vec", fingerprints.likeness("vec", "next_vec").alias("near")).collect()}

    def signed(vec):
        lanes = [(v >> (30 * i)) & (1 << 30) - 1 for v in vec[5:] for i in range(2)]
        return np.array([2.0 * x - vec[0] for x in lanes])

    for g in got.values():
        x, y = signed(g.vec), signed(g.next_vec)
        assert len(x) == 120 and abs(g.near - min(1, max(0, x @ y / np.sqrt((x @ x) * (y @ y))))) < 1e-9
    assert list(got[2].vec) == list(got[1].next_vec) or got[2].next_vec == got[1].vec
    assert abs(got[2].near - 150 / 200) < 0.27 and got[0].near < 0.4


def test_fingerprint_of_many_sentences(spark):
    """More sentences than a lane of 20 bits could count."""
    n = 1_100_000
    df = spark.range(1).select(F.lit(1).cast("long").alias("doc_id"), F.repeat(F.lit("a\n"), n).alias("text"))
    vec = df.select(fingerprints.vector("text").alias("v")).first().v
    lanes = [(v >> (30 * i)) & (1 << 30) - 1 for v in vec[5:] for i in range(2)]
    assert vec[0] == n and set(lanes) == {0, n}


def test_bytes_without_a_token_are_dropped():
    import json

    from tokenizers import Tokenizer

    ids = {"a": 0, "b": 1, "ab": 2, "Ġ": 3}
    vocab = json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}, "post_processor": None, "decoder": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}, "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": ids, "merges": [["a", "b"]]}})
    t, own = Tokenizer.from_str(vocab), bpe.PrefixBPE(vocab)
    for x in ("acb", "zab", "z", "", "a zb b", "abcab"):
        assert own.encode(x) == t.encode(x, add_special_tokens=False).ids, x


def test_records_are_held_against_their_index(spark, tmp_path):
    df = spark.createDataFrame([(i, "words " * i) for i in range(40)], "doc_id long, text string")
    uri = str(tmp_path / "out")
    want = records.token_output(df, BYTE, uri).orderBy("doc_id").collect()
    assert [r.doc_id for r in want] == list(range(40)) and want[0].n_tokens == 1
    file = sorted((tmp_path / "out").glob("*.idx"))[0]
    data = file.read_bytes()
    for bad in (data[:-24], data[:-1], data[:8] + b"\x63" + data[9:]):
        file.write_bytes(bad)
        with pytest.raises(Exception, match="index|record"):
            records.read_records(spark, uri).collect()
    file.write_bytes(data)
    assert records.read_records(spark, uri).orderBy("doc_id").collect() == want


def test_pii_finds_secrets(spark):
    """Planted secrets of several shapes among words and harmless digits: all found, nothing else."""
    r = random.Random(8)
    words = "and the words of a text with numbers like 2019 or v1.2 and 1234567890123456 between".split()
    rows, want = [], {}
    for i in range(400):
        some = [r.choice(words) for _ in range(20)]
        if i % 4 == 0:
            value = "".join(r.choice("0123456789abcdef") for _ in range(40))
            some.insert(r.randrange(20), [f'token = "{value}"', f"api_key: {value}", f'{{"secret":"{value}"}}', f"password={value}"][i // 4 % 4])
            want[i] = [value]
        rows.append((i, " ".join(some)))
    # after names that are trusted by now, values that are no seeds themselves
    rows += [(1000, "so token = ab12cd34 it is"), (1001, "so other = ab12cd35 it is"), (1002, "x = 12345678"), (1003, "see https://example.org/ab12cd34ef56ab78cd90 now"), (1004, "count: 1000000000000000000")]
    want[1000] = ["ab12cd34"]
    found = {g.doc_id: [t[int(a) : int(b)] for x in g.spans.split(",") if x for k, a, b in [x.split(":")]] for g, t in ((g, dict(rows)[g.doc_id]) for g in pii.op7_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect())}
    hits = sum(found[i] == v for i, v in want.items())
    extra = sum(len(v) for i, v in found.items() if i not in want)
    assert hits == len(want) and extra == 0, ([(i, v, found[i]) for i, v in want.items() if found[i] != v][:5], [(i, v) for i, v in found.items() if v and i not in want][:5])


def test_pii_contexts_are_whole_words(spark):
    """Words that differ only before their last 40 characters are different contexts."""
    long = lambda c: c + "x" * 60
    rows = [(i, f"{long('a')} u{i}@m.org") for i in range(9)] + [(20, f"{long('a')} ab12cd34"), (21, f"{long('b')} ab12cd35")]
    got = {r.doc_id: r.spans for r in pii.op7_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[20] == "id:62:70" and got[21] == ""


def test_very_long_texts(spark):
    """A text of some megabytes through the operators that no other test gives one."""
    text = " ".join(f"word{k % 5000} of der le" for k in range(200_000)) + " me@mail.org"
    df = spark.createDataFrame([(1, text, "en"), (2, "short text here", "en")], "doc_id long, text string, lang string")
    assert language_id.op2_language_id(df).count() == 2
    assert {r.doc_id: r.spans for r in pii.op7_pii(df).collect()}[1] == f"email:{len(text) - 11}:{len(text)}"
    got = {r.doc_id: r for r in fingerprints.op3_fingerprints(df).collect()}
    assert got[1].n_chars == len(text)
    assert sum(r.length for r in packing.op4_packing(df, WORD).filter("doc_id = 1").collect()) > 200_000


def test_join_small_is_the_same_salted(spark, monkeypatch):
    left = spark.range(1000).select(F.when(F.col("id") % 50 == 0, F.col("id") % 7).otherwise(1).alias("k"), "id", F.lit("x").alias("salt"))
    left = left.union(spark.range(3).select(F.lit(None).cast("long"), "id", F.lit("x")))
    right = spark.createDataFrame([(0, "a"), (1, "b"), (1, "c"), (None, "d")], "k long, v string")
    want = sorted(map(tuple, common.join_small(left, right, ["k"], 8, ["id"]).collect()))
    assert len(want) > 1900
    for limit, hot_rows in ((8, 100), (8, 2), (8, 5000)):
        monkeypatch.setattr(common, "BROADCAST_BYTES", limit)
        assert sorted(map(tuple, common.join_small(left, right, ["k"], 8, ["id"], hot_rows=hot_rows).collect())) == want


def test_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf, sparkContext = Conf(), type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_on_odd_tables(spark):
    import corpus_pipeline

    rows = [(None, "the words of a text", None, "s", 1), (1, "the words of a text", None, None, None), (1, "the words of a text", None, None, None), (1, None, None, "s", 1), (2, "other words, der die das", None, "s", 1)]
    for table in (spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], SCHEMA), spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("x").alias(h) for h in HELPERS])):
        docs, n = table, table.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = common.written(stage(spark, docs, ""), name)
            assert docs.columns == table.columns
        out = corpus_pipeline.STAGES[-1][1](spark, docs, "")
        # without labels the documents with a letter stay, and the copies of one id are one
        assert (docs.count(), out.count()) == ((3, 3) if n else (0, 0))


def test_language_stage_keeps_its_lang_without_labels(spark):
    import corpus_pipeline

    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 4 == 2)
    docs = spark.createDataFrame([(held, "some text", "en", "s", 1), (5000, "123", None, "s", 1)], SCHEMA)
    assert [(r.doc_id, r.lang) for r in corpus_pipeline.language_stage(spark, docs, "").collect()] == [(held, "en")]


def test_ablations_of_another_policy(spark):
    led = quality.ledger(spark.createDataFrame([(1, "few words"), (2, "a b " * 30)], "doc_id long, text string"))
    got = {r.rule: (r.n_failed, r.n_only, r.n_kept_without) for r in quality.ablations(led, "base").collect()}
    assert got == {"too_few_words": (1, 1, 1), "repeated_windows": (1, 1, 1)}


def test_joined_labels_are_those_of_the_whole_graph(spark):
    from unitflow.llm import components

    def naive(edges):
        up = {x: x for e in edges for x in e}
        for _ in up:
            for a, b in edges:
                up[a] = up[b] = min(up[a], up[b])
        return {x: y for x, y in up.items() if x != y}

    r = random.Random(3)
    table = lambda edges: common.written(spark.createDataFrame(edges, "a long, b long"), "t")
    first, more = ([(r.randrange(60), r.randrange(60)) for _ in range(n)] for n in (25, 20))
    labels = components.components(table(first))
    assert {x.id: x.label for x in labels.collect()} == naive(first)
    labels = components.joined(labels, table(more))
    assert {x.id: x.label for x in labels.collect()} == naive(first + more)
    assert components.joined(labels, table(more)) is labels


def test_near_dedup_of_five_words_against_brute_force(spark):
    """The pipeline's width, where near copies lie on both sides of the threshold: every link is found."""
    from test_operators import brute_components

    r = random.Random(12)
    rows = []
    for g in range(60):
        base = [f"w{r.randrange(900)}" for _ in range(r.randrange(3, 200))]
        for k in range(r.randrange(1, 6)):
            words = list(base)
            for _ in range(r.randrange(0, 1 + len(words) // 25)):
                words[r.randrange(len(words))] = f"e{r.randrange(99)}"
            rows.append((len(rows), " ".join(words)))
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in near_dedup.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_components(rows, 5, 80)
    assert got == want and 60 < sum(w[2] for w in want.values()) < len(rows)


def test_substring_buckets_follow_the_input(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"{i} " + "some words that repeat " * 40) for i in range(50)], "doc_id long, text string")
    few, want = substring_dedup.bucket_count(df), substring_dedup.substring_dedup(df).orderBy("doc_id").collect()
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 100)
    assert substring_dedup.bucket_count(df) > 10 * few and substring_dedup.substring_dedup(df).orderBy("doc_id").collect() == want
    assert substring_dedup.bucket_count(spark.createDataFrame([], "doc_id long, text string")) == few


def test_columns_that_differ_from_measurements_by_case(spark):
    df = spark.createDataFrame([(1, "one two three", 99)], "doc_id long, text string, N_words int")
    assert quality.ledger(df).first()["n_words"] == 3


def test_more_than_64_languages_are_learned(spark):
    r = random.Random(2)
    words = {f"l{k:03}": ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(12)] for k in range(70)}
    rows = [(k, " ".join(r.choice(words[lang]) for _ in range(25)), lang) for k in range(1400) for lang in [f"l{k % 70:03}"]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    n = {x.lang: x["count"] for x in language_id.sampled(df).groupBy("lang").count().collect()}
    assert len(n) == 70 and sum(n.values()) <= language_id.TOTAL
    got = language_id.op2_language_id(df).filter("held_out").collect()
    assert sum(x.lang_pred == f"l{x.doc_id % 70:03}" for x in got) >= 0.95 * len(got)


def test_near_stage_keeps_columns_of_any_name(spark):
    import corpus_pipeline

    long = " ".join(f"word{k}" for k in range(60))
    df = spark.createDataFrame([(1, long, "U", 7, 1.5), (1, long + " more", "V", 8, 2.5), (2, "another text that stands alone", "W", 9, 3.5)], "doc_id long, text string, _place string, _row int, `a.b` double")
    got = corpus_pipeline.near_stage(spark, df, "")
    assert got.columns == df.columns and {tuple(r)[2:] for r in got.collect()} == {("U", 7, 1.5), ("W", 9, 3.5)}


def test_shared_folder_without_a_setting(spark, monkeypatch):
    class Unset:
        def get(self, key, default=None):
            return default

    session = type("Session", (), {"conf": Unset(), "sparkContext": spark.sparkContext})()
    monkeypatch.setattr(common, "_LOCAL", {})
    assert common.shared_dir(session) == common.shared_dir(session) != spark.conf.get("spark.checkpoint.dir")
