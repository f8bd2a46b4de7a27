"""Language ID by hierarchical discrimination: first the family, then the language within it.

Features are hashed byte trigrams of the whole text, as shares of its trigrams. Linear support vector machines, one
for each pair of families and one for each pair of languages of a family, vote. They are fitted by one task from
a bounded, documented sample of labelled rows: at most SAMPLE texts a language and TOTAL in all, chosen by a hash of doc_id and
text, of the LANGUAGES most frequent languages; everything else runs in the executors over all rows. Only the machines
come to the driver.
"""

from __future__ import annotations

import pickle
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from unitflow.llm.common import map_rows, map_whole_rows, slices, text_bytes, unused

#: Fixed: families of common languages; any other language is in the family "other".
FAMILIES = {
    **dict.fromkeys(("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb"), "germanic"),
    **dict.fromkeys(("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"), "romance"),
    **dict.fromkeys(("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"), "slavic"),
}
DIM = 1 << 12
#: Bounds of the sample that the machines are fitted on: texts a language, texts in all. Every language gets an equal part of the total.
SAMPLE, TOTAL = 800, 6_400
SCALE = 64.0
LETTER = re.compile(rb"[A-Za-z]")


def held_out() -> Column:
    """crc32 of doc_id as text, modulo 4, is 2: never learned from. A null doc_id is held out of neither."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all texts end to end, and where each text starts. Texts are lower-cased (A-Z) between blanks, so
    that each has a trigram; trigrams across two texts are cut off."""
    data = np.frombuffer(b"".join(b" " + t.lower() + b"  " for t in texts) or b"   ", np.uint8).astype(np.uint32)
    sizes = np.array([len(t) + 3 for t in texts], np.int64)
    code = data[:-2] * np.uint32(65536) + data[1:-1] * np.uint32(256) + data[2:]
    features = (code * np.uint32(2654435761) >> np.uint32(20)).astype(np.int64)
    return features, np.concatenate(([0], np.cumsum(sizes)))


def shares(text: bytes) -> np.ndarray:
    features, _ = trigrams([text])
    return (np.bincount(features, minlength=DIM) * (SCALE / len(features))).astype(np.float32)


def has_letter(text: bytes) -> bool:
    return bool(LETTER.search(text)) or any(map(str.isalpha, text.decode("utf-8", "replace")))


def svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 12) -> tuple[np.ndarray, float]:
    """A linear support vector machine by dual coordinate descent; y is 1 or -1; classes weigh alike."""
    w, b, alpha = np.zeros(x.shape[1], np.float64), 0.0, np.zeros(len(x))
    norm = np.einsum("ij,ij->i", x, x, dtype=np.float64) + 1
    top = np.where(y > 0, c * len(y) / max(1, 2 * (y > 0).sum()), c * len(y) / max(1, 2 * (y < 0).sum()))
    order = np.random.default_rng(7)
    for _ in range(rounds):
        for i in order.permutation(len(x)):
            new = min(max(alpha[i] - (y[i] * (x[i] @ w + b) - 1) / norm[i], 0.0), top[i])
            if new != alpha[i]:
                by = (new - alpha[i]) * y[i]
                w += by * x[i]
                b += by
                alpha[i] = new
    return w, b


class Model:
    """Pairwise machines in two levels. pairs[k] = (level, first, second): machine k is positive for the first."""

    def __init__(self, langs: list[str], x: np.ndarray, y: np.ndarray):
        """x: features of sample texts; y: the place of each one's language in langs (sorted)."""
        self.langs = langs
        family = {lang: FAMILIES.get(lang, "other") for lang in langs}
        self.families = sorted(set(family.values()))
        self.members = {f: [lang for lang in langs if family[lang] == f] for f in self.families}
        self.pairs, weights, biases = [], [], []
        of = np.array([family[langs[k]] for k in y]) if len(y) else np.zeros(0, str)
        name = np.array([langs[k] for k in y]) if len(y) else np.zeros(0, str)
        for group, label in [(self.families, of), *((m, name) for m in self.members.values())]:
            for first, second in combinations(group, 2):
                pick = (label == first) | (label == second)
                w, b = svm(x[pick], np.where(label[pick] == first, 1.0, -1.0))
                self.pairs.append((first, second))
                weights.append(w.astype(np.float32))
                biases.append(b)
        self.weights, self.biases = weights, biases

    def margins(self, features: np.ndarray, starts: np.ndarray) -> np.ndarray:
        n = np.minimum(starts[1:], len(features)) - starts[:-1]
        out = np.zeros((len(self.pairs), len(n)))
        for k, w in enumerate(self.weights):
            # the last two trigrams of a text reach into the next: their weights go
            values = w[features].astype(np.float64)
            total = np.add.reduceat(values, starts[:-1])
            ends = starts[1:-1]
            total[:-1] -= values[ends - 1] + values[ends - 2]
            out[k] = total * SCALE / np.where(np.arange(len(n)) < len(n) - 1, n - 2, n) + self.biases[k]
        return out

    def _vote(self, group: list[str], margins: dict) -> tuple[str, float]:
        if len(group) == 1:
            return group[0], 1.0
        score = {g: [0, 0.0, 1.0] for g in group}
        for first, second in combinations(group, 2):
            m = margins[first, second]
            p = 1 / (1 + np.exp(-np.clip(2 * m, -30, 30)))
            for g, won, share in ((first, m > 0, p), (second, m <= 0, 1 - p)):
                score[g][0] += won
                score[g][1] += m if g == first else -m
                score[g][2] = min(score[g][2], share)
        best = max(group, key=lambda g: (score[g][0], score[g][1], g))
        return best, float(score[best][2])

    def predict(self, texts: list[bytes]) -> list[tuple[str, float]]:
        if not texts:
            return []
        if not self.langs:
            return [("und", 0.0)] * len(texts)
        margins = self.margins(*trigrams(texts)) if self.pairs else np.zeros((0, len(texts)))
        out = []
        for i, text in enumerate(texts):
            if not has_letter(text):
                out.append(("und", 0.0))
                continue
            mine = {pair: margins[k, i] for k, pair in enumerate(self.pairs)}
            family, sure = self._vote(self.families, mine)
            lang, surer = self._vote(self.members[family], mine)
            out.append((lang, sure * surer))
        return out


def labelled(docs: DataFrame) -> DataFrame:
    """The rows that may be learned from: a non-null lang, a letter, not held out."""
    return docs.filter(F.col("lang").isNotNull() & ~held_out() & F.col("text").rlike("\\p{L}"))


def sampled(docs: DataFrame, sample: int = SAMPLE, total: int = TOTAL, languages: int | None = None) -> DataFrame:
    """lang and text of at most `sample` labelled rows of each language, `total` in all, so of at most `total` languages, or of the
    `languages` most frequent ones where that is asked for. A row is chosen by a hash of doc_id and text: first by a threshold that spares the shuffle most rows, then by rank."""
    rows = labelled(docs).select(F.col("lang"), F.xxhash64(F.col("doc_id").cast("string"), "text").alias("pick"), "text")
    counted = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("pick").alias("texts")).orderBy(F.desc("n"), "lang").limit(languages or total)
    counts = {r["lang"]: r["texts"] for r in counted.collect()}
    if not counts:
        return rows.select("lang", "text").limit(0)
    most = max(1, min(sample, total // len(counts)))
    # half as many again as wanted, since the distinct texts are estimated
    limit = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1 << 20, (3 * most << 19) // max(1, n) + 1))])
    near = rows.filter(F.pmod(F.col("pick"), F.lit(1 << 20)) < F.element_at(limit, F.col("lang")))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("pick", "text"))
    return near.withColumn("place", place).filter(F.col("place") <= most).select("lang", "text")


def fit(docs: DataFrame, sample: int = SAMPLE, total: int = TOTAL, languages: int | None = None) -> Model:
    """A model from the sampled rows. Their features, not their texts, meet in the one task that fits it."""

    def featured(batches):
        for batch in batches:
            for part in slices(batch, most=1 << 20):
                rows = [shares(t) for t in part.column(1).to_pylist()]
                used = [np.flatnonzero(r).astype(np.int32) for r in rows]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([u.tobytes() for u in used], pa.binary()), pa.array([r[u].tobytes() for r, u in zip(rows, used)], pa.binary())], ["lang", "used", "value"])

    def fitted(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("lang", "used", "value"))))
        langs = sorted({r[0] for r in rows})
        x = np.zeros((len(rows), DIM), np.float32)
        for i, (_, used, value) in enumerate(rows):
            x[i, np.frombuffer(used, np.int32)] = np.frombuffer(value, np.float32)
        return pa.table({"model": pa.array([pickle.dumps(Model(langs, x, np.array([langs.index(r[0]) for r in rows])))], pa.binary())})

    rows = map_rows(sampled(docs, sample, total, languages), ["lang", text_bytes()], featured, "lang string, used binary, value binary")
    found = rows.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(fitted, "model binary").first()
    return pickle.loads(found[0]) if found else Model([], np.zeros((0, DIM), np.float32), np.zeros(0, int))


def language_id(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs with held_out, lang_pred and score (0 to 1); columns of these names are replaced.

    lang_pred is a lang value that was learned, or und for a null text or one without a letter (score 0). Without
    any labelled row all are und. Rows are independent: repeated rows get equal results; a null doc_id is allowed;
    an empty table gives an empty table. Predictions see the text alone, the whole of it at any length. Of equal votes the
    greater sum of margins wins, then the later name."""
    docs = docs.drop("held_out", "lang_pred", "score")
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, sample))
    names, own_text = docs.columns, unused([*docs.columns, "held_out"], "own_text")[0]

    def work(batches):
        for batch in batches:
            for part in slices(batch, own_text, 1 << 20):
                pred = model.value.predict(part.column(own_text).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in (*names, "held_out")), pa.array([p[0] for p in pred], pa.string()), pa.array([p[1] for p in pred], pa.float64())], [*names, "held_out", "lang_pred", "score"])

    full = docs.withColumn("held_out", held_out()).withColumn(own_text, F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    fields = [(f.name, f.dataType.simpleString()) for f in docs.schema]
    return map_whole_rows(full, work, [*fields, ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")])


def op2_language_id(docs: DataFrame) -> DataFrame:
    return language_id(docs.select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score")
