"""Language identification by error-correcting output codes.

Each language has a binary codeword: the exhaustive code (2^(L-1) - 1 bits) for up to five languages, else rows of a
Hadamard-like random code from a seeded rule.  For each bit a linear classifier on hashed byte n-grams (1 to 3 bytes of the
lower-cased letters) is fitted, by ridge regression in its dual form, to a bounded sample of labelled rows.  Decoding
takes the codeword of least loss, each bit's loss exp(-margin) weighted by that bit's accuracy in the sample; a small lead over
the second is flagged as ambiguous.

Whole texts are counted; prediction is one pass over the documents without a shuffle.

Defined results: ``und`` with score 0 for a null text, one without a letter, or if nothing could be learned;
with one language learned every other text has it, with score 1; rows with null language are
predicted but not learned from; repeated rows stay, and are learned from once; very long texts are counted whole, in parts of a
MB; other columns, whatever their names, are not read, and kept by ``keep_identified``; empty tables give no rows.
"""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows learned from, over all languages: the bound of the sample.
SAMPLE_ROWS = 1_600
FEATURES = 4_096
RIDGE = 0.05
AMBIGUOUS = 0.2
SEED = 20240501
#: Hash parts in which the rows of a language are ranked first.
PARTS = 32
#: Bytes that count as letters: a-z and those of other scripts; the rest is one blank.
FOLDED = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def features(text: str) -> np.ndarray:
    """Counts of the hashed n-grams of the whole text."""
    b = np.frombuffer((" " + text + " ").encode("utf-8", "replace").translate(FOLDED), np.uint8)
    out = np.zeros(FEATURES, np.int64)
    for at in range(0, len(b), 1 << 20):
        x = b[max(0, at - 2) : at + (1 << 20)].astype(np.uint32)
        for n in (1, 2, 3):
            skip = max(0, min(at, 2) - (n - 1))  # grams that ended in the part before
            g = x[skip:]
            if len(g) < n:
                continue
            h = np.zeros(len(g) - n + 1, np.uint32)
            for j in range(n):
                h = h * np.uint32(0x01000193) ^ g[j : len(g) - n + 1 + j] + np.uint32(97 * n)
            h = h * np.uint32(0x9E3779B1)
            out += np.bincount(h >> np.uint32(20), minlength=FEATURES)
    return out


def scaled(counts: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts.astype(np.float32))
    return x / max(float(np.linalg.norm(x)), 1e-6)


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1: the exhaustive code, or for more than five languages the best of seeded random codes."""
    if n <= 5:
        bits = max(1, 2 ** (n - 1) - 1)
        # bit j separates the languages whose index is in the binary form of j + 1 from the last one
        return np.array([[1.0 if (j + 1) >> i & 1 else -1.0 for j in range(bits)] for i in range(n)])
    rng, bits, best, gap = np.random.default_rng(SEED), int(np.ceil(15 * np.log2(n))), None, -1
    for _ in range(50):
        c = rng.choice([-1.0, 1.0], (n, bits))
        d = (bits - c @ c.T) / 2 + np.eye(n) * bits
        if d.min() > gap:
            best, gap = c, d.min()
    return best


class Model:
    """Codewords, one weight column per bit, and the bits' accuracies."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        self.codes = codewords(len(self.langs))
        y = self.codes[[self.langs.index(v) for v in langs]]
        share = {v: langs.count(v) for v in self.langs}
        w = np.sqrt(np.array([len(langs) / len(share) / share[v] for v in langs]))[:, None]  # languages weigh alike
        self.mean = x.mean(0)
        z = x - self.mean
        z *= w
        dual = np.linalg.solve(z @ z.T + RIDGE * np.eye(len(z)), y * w)
        self.weights = (z.T @ dual).astype(np.float32)
        del z
        right = (np.sign((x - self.mean) @ self.weights) == y).mean(0)
        self.trust = np.clip(right, 0.5, 1.0) - 0.4

    def decode(self, x: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, ambiguous) of each row of features."""
        margins = (x - self.mean) @ self.weights
        loss = (np.exp(-2 * margins[:, None, :] * self.codes[None]) * self.trust).sum(2) / self.trust.sum()
        order = np.sort(loss, 1)
        best = loss.argmin(1)
        if len(self.langs) == 1:
            return [self.langs[0]] * len(x), np.ones(len(x)), np.zeros(len(x), bool)
        lead = 1 - order[:, 0] / np.maximum(order[:, 1], 1e-12)
        return [self.langs[i] for i in best], np.clip(lead, 0, 1), lead < AMBIGUOUS


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Fit to at most sample_rows different rows that are not held out, equally many of each language, by least hash of id and text.

    Languages beyond sample_rows, those of fewest rows, are not learned.  Rows are ranked within hash parts of a language first, so
    a hot one is split; the sample's texts become feature counts on the executors, and one of them fits the model, so only its weights
    come to the driver.
    """
    rows = docs.select(F.col(id_col).alias("li_id"), F.coalesce(F.col(text_col), F.lit("")).alias("li_text"), F.col(lang_col).alias("li_lang")).filter(~held_out(F.col("li_id")) & F.col("li_lang").isNotNull())
    langs = [r["li_lang"] for r in rows.groupBy("li_lang").count().orderBy(F.desc("count"), "li_lang").limit(sample_rows).collect()]  # at most sample_rows languages, by row count
    if not langs:
        return None
    each = sample_rows // len(langs)
    rows = rows.withColumn("li_h", F.xxhash64(F.lit(SEED), F.col("li_id"), F.md5(F.col("li_text").cast("binary"))))
    keys = rows.filter(F.col("li_lang").isin(langs)).select("li_lang", "li_h").distinct().withColumn("li_part", F.pmod("li_h", F.lit(PARTS)))
    for by in (["li_lang", "li_part"], ["li_lang"]):
        keys = keys.withColumn("li_n", F.row_number().over(Window.partitionBy(*by).orderBy("li_h"))).filter(F.col("li_n") <= each)
    texts = rows.join(F.broadcast(keys.select("li_lang", "li_h")), ["li_lang", "li_h"], "left_semi").dropDuplicates(["li_lang", "li_h"]).select(F.col("li_lang").alias("lang"), F.col("li_text").alias("text"))  # at most sample_rows rows

    def count(batches):
        for batch in batches:
            x = [features(t).astype("<u4").tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary())], names=["lang", "x"])

    def fit(batches):
        got = sorted((r for batch in batches for r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)), reverse=True)
        if not got:
            return
        x, names = np.empty((len(got), FEATURES)), [v for v, _ in reversed(got)]
        for row in x:
            row[:] = scaled(np.frombuffer(got.pop()[1], "<u4"))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Model(x, names))], pa.binary())], names=["model"])

    counted = texts.mapInArrow(count, "lang string, x binary").repartition(1)  # at most sample_rows rows of 16 kB
    return pickle.loads(counted.mapInArrow(fit, "model binary").first()["model"])


def _has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _decoded(model: Model | None, texts: list[str | None]):
    langs, score, unsure = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
    own = [i for i, t in enumerate(texts) if model and _has_letter(t)]
    if own:
        got = model.decode(np.stack([scaled(features(texts[i])) for i in own]))
        for i, v, s, u in zip(own, *got, strict=True):
            langs[i], score[i], unsure[i] = v, s, u
    return langs, score, unsure


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, lang_pred, score, ambiguous; one pass, no shuffle.  The model has a fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                langs, score, unsure = _decoded(shared.value, part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(unsure)], names=[id_col, "held_out", "lang_pred", "score", "ambiguous"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), F.col(text_col)).mapInArrow(predict, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double, ambiguous boolean")


def keep_identified(docs: DataFrame, model: Model | None, text_col: str = "text", least_score: float = 0.0) -> DataFrame:
    """docs, all columns, whose language is found (not ``und``) with at least least_score.

    Where nothing could be learned no language tells against a text: those with a letter stay.
    """
    shared, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def keep(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(place).to_pylist()
                if shared.value is None:
                    fine = [_has_letter(t) for t in texts]
                else:
                    langs, score, _ = _decoded(shared.value, texts)
                    fine = [v != "und" and s >= least_score for v, s in zip(langs, score, strict=True)]
                yield part.filter(pa.array(fine, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def in_hold_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1
