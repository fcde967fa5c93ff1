"""Language identification by hierarchical discrimination.

Features of a text are the counts of its byte trigrams of letters and spaces (lower case, white space runs as one
space; digits and marks say nothing of a language), hashed to DIMS, square-rooted and scaled to length 1; the whole text counts. A first model, linear support vector machines one against
the rest, decides among language families; within the family decided on, one-versus-one linear support
vector machines vote, a tie going to the larger sum of margins, then to the first name.

Training takes at most SAMPLE texts of each language, those whose ids have the least hash: the bound is
documented and does not grow; its features (SAMPLE x DIMS floats a language) are all that comes to the driver.
Counts per language over all rows set the share of rows that is looked at for them.

``accepted`` is false if a text has fewer than LETTERS letters, if too small a share of its trigrams (KNOWN) is in bins
that the training texts of any language, each text weighing the same, fill to more than COMMON of the mean, or if the decision is closer than MARGIN on both levels: such a text is of no
language known here. Languages that no family lists form one family each.

Defined cases: rows without an id go; a null or empty text is not accepted and has language null; rows
without a language are classified, not trained on; repeated rows give repeated results; without any
labelled text nothing is accepted. Other columns are ignored by ``identify``.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import textkernel as tk
from factloom.plans.scratch import ROW_BYTES, Scratch, small_side

FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "nb", "nl", "nn", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
}
SAMPLE, DIMS, LETTERS, COMMON, KNOWN, MARGIN = 400, 4096, 2, 0.2, 0.65, 0.02
#: A slice of texts, smaller than elsewhere, as a row of it has DIMS counts.
BOUNDS = {"size": 256 << 10, "rows": 256}
SCHEMA = "doc_id long, language string, family string, margin double, accepted boolean"


def counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Trigram counts by text and bin, and letters (anything but ASCII non-letters) by text."""
    raw, off = tk.bytes_of(pc.replace_substring_regex(pc.utf8_lower(texts.fill_null("")), r"[ \t\n\r\f\v]{2,}|[\t\n\r\f\v]", " "))
    n = len(off) - 1
    is_letter = ((raw >= 97) & (raw <= 122)) | (raw >= 128)
    letter = np.r_[0, np.cumsum(is_letter)]
    out = np.zeros((n, DIMS), np.float32)
    if len(raw) >= 3:
        x = raw.astype(np.uint32)
        code = (x[:-2] * np.uint32(40503) ^ x[1:-1] * np.uint32(2654435761) ^ x[2:] * np.uint32(97787)) * np.uint32(2246822519) >> np.uint32(20)
        text = np.repeat(np.arange(n, dtype=np.int64), np.diff(off))
        plain = is_letter | (raw == 32)
        ok = (text[:-2] == text[2:]) & plain[:-2] & plain[1:-1] & plain[2:]
        out = np.bincount(text[:-2][ok] * DIMS + code[ok], minlength=n * DIMS).reshape(n, DIMS).astype(np.float32)
    return out, letter[off[1:]] - letter[off[:-1]]


def scaled(c: np.ndarray) -> np.ndarray:
    f = np.sqrt(c)
    return f / np.maximum(np.linalg.norm(f, axis=1, keepdims=True), 1e-9)


def train_svm(x: np.ndarray, y: np.ndarray, *, c: float = 4.0, epochs: int = 30, tolerance: float = 1e-3) -> np.ndarray:
    """Weights (bias last) of a linear SVM with squared hinge loss, by dual coordinate descent; y is 1 or -1."""
    x = np.c_[x, np.ones(len(x))].astype(np.float64)
    q = (x * x).sum(1) + 0.5 / c
    alpha, w = np.zeros(len(x)), np.zeros(x.shape[1])
    rng = np.random.default_rng(5)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(x)):
            g = y[i] * (x[i] @ w) - 1 + alpha[i] * 0.5 / c
            step = max(alpha[i] - g / q[i], 0.0) - alpha[i]
            if step:
                alpha[i] += step
                w += step * y[i] * x[i]
                most = max(most, abs(step))
        if most < tolerance:
            break
    return w


@dataclass
class Model:
    families: list[str]
    languages: dict[str, list[str]]
    first: np.ndarray  # families x (DIMS + 1)
    pairs: dict[tuple[str, str], np.ndarray]
    seen: np.ndarray  # bins that are common in the training texts of some language

    def predict(self, c: np.ndarray, letters: np.ndarray) -> tuple[list, list, np.ndarray, np.ndarray]:
        x = scaled(c)
        score = x @ self.first[:, :-1].T.astype(np.float32) + self.first[:, -1].astype(np.float32)
        best = score.argmax(1)
        top = np.sort(score, 1)
        near = top[:, -1] - top[:, -2] if len(self.families) > 1 else np.full(len(x), np.inf)
        language, inner = np.empty(len(x), object), np.full(len(x), np.inf)
        for k, family in enumerate(self.families):
            rows = np.flatnonzero(best == k)
            names = self.languages[family]
            if not len(rows):
                continue
            votes = np.zeros((len(rows), len(names)))
            for (a, b), w in self.pairs.items():
                if a in names and b in names:
                    m = x[rows] @ w[:-1].astype(np.float32) + np.float32(w[-1])
                    i, j = names.index(a), names.index(b)
                    votes[:, i] += (m > 0) + 1e-4 * np.clip(m, -9, 9)
                    votes[:, j] += (m <= 0) - 1e-4 * np.clip(m, -9, 9)
                    inner[rows] = np.minimum(inner[rows], np.abs(m))
            language[rows] = np.array(names, object)[votes.argmax(1)]
        known = (c * self.seen).sum(1) / np.maximum(c.sum(1), 1)
        ok = (letters >= LETTERS) & (known >= KNOWN) & ((near >= MARGIN) | (inner >= MARGIN)) & (c.sum(1) > 0)
        none = (c.sum(1) == 0) | (letters == 0)
        margin = np.minimum(near, inner)
        return [None if z else v for v, z in zip(language, none)], [None if z else self.families[k] for k, z in zip(best, none)], np.where(none | ~np.isfinite(margin), 0, margin), ok & ~none


def sample(docs: DataFrame, bound: int) -> DataFrame:
    """(doc_id, lang, text): at most ``bound`` texts of each language, those whose ids have the least hash."""
    from pyspark.sql import Window

    ids = docs.where("doc_id is not null and lang is not null and length(text) > 0").select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.xxhash64(F.col("doc_id").cast("long")).alias("h"))
    n = {r["lang"]: r["n"] for r in ids.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not n:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").limit(0)
    share = F.create_map(*[F.lit(v) for k, m in n.items() for v in (k, min(1.0, 2.0 * bound / m))])
    low = ids.where((F.col("h").cast("double") + 2.0**63) < F.element_at(share, F.col("lang")) * 2.0**64)
    ranked = low.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("r") <= bound).select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"))
    with Scratch(docs.sparkSession) as s:
        ranked = s.keep(ranked)
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").join(small_side(ranked, 2 * ROW_BYTES * ranked.count()), (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang"))).select("doc_id", "lang", "text")


def _features(b: pa.RecordBatch) -> pa.RecordBatch:
    c, _ = counts(b.column("text"))
    flat = c.astype(np.float32).tobytes()
    off = np.arange(len(c) + 1, dtype=np.int32) * (DIMS * 4)
    return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), pa.Array.from_buffers(pa.binary(), len(c), [None, pa.py_buffer(off), pa.py_buffer(flat)])], names=["doc_id", "lang", "c"])


def train(docs: DataFrame, *, bound: int = SAMPLE, families: dict[str, tuple[str, ...]] | None = None) -> Model | None:
    """The two-level model; None if no row has a language and a text."""
    rows = sample(docs, bound).mapInArrow(tk.sliced(_features, **BOUNDS), "doc_id long, lang string, c binary").toArrow()
    if not rows.num_rows:
        return None
    order = np.lexsort((rows["doc_id"].to_numpy(), rows["lang"].to_numpy(zero_copy_only=False).astype(str)))
    lang = rows["lang"].to_numpy(zero_copy_only=False).astype(str)[order]
    c = np.stack([np.frombuffer(x, np.float32) for x in rows["c"].to_pylist()])[order]
    return fit(c, lang, families or FAMILIES)


def fit(c: np.ndarray, lang: np.ndarray, families: dict[str, tuple[str, ...]]) -> Model:
    of = {x: f for f, names in families.items() for x in names}
    x, family = scaled(c), np.array([of.get(v, v) for v in lang])
    names = sorted(set(family))
    languages = {f: sorted(set(lang[family == f])) for f in names}
    first = np.stack([train_svm(x, np.where(family == f, 1.0, -1.0)) for f in names]) if len(names) > 1 else np.zeros((1, DIMS + 1))
    pairs = {}
    for f in names:
        for a, b in combinations(languages[f], 2):
            rows = np.isin(lang, [a, b])
            pairs[a, b] = train_svm(x[rows], np.where(lang[rows] == a, 1.0, -1.0))
    rate = c / np.maximum(c.sum(1, keepdims=True), 1)
    seen = np.any([rate[lang == v].mean(0) > COMMON / DIMS for v in sorted(set(lang))], 0)
    return Model(names, languages, first, pairs, seen.astype(np.float32))


def _predict(model: Model):
    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        language, family, margin, ok = model.predict(*counts(b.column("text")))
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(language, pa.string()), pa.array(family, pa.string()), pa.array(np.round(margin.astype(np.float64), 4)), pa.array(ok)], names=["doc_id", "language", "family", "margin", "accepted"])

    return tk.sliced(one, **BOUNDS)


def identify(docs: DataFrame, *, model: Model | None = None, bound: int = SAMPLE) -> DataFrame:
    """(doc_id, language, family, margin, accepted) of every row with an id."""
    model = model or train(docs, bound=bound)
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if model is None:
        return texts.select("doc_id", F.lit(None).cast("string").alias("language"), F.lit(None).cast("string").alias("family"), F.lit(0.0).alias("margin"), F.lit(False).alias("accepted"))
    return texts.mapInArrow(_predict(model), SCHEMA)


def _keep(model: Model):
    def run(batches):
        for b in batches:
            for x in tk.slices(b, **BOUNDS):
                ok = model.predict(*counts(x.column("text").cast(pa.string())))[3]
                if ok.any():
                    yield x.filter(pa.array(ok))
        tk.give_back()

    return run


def keep_identified(docs: DataFrame, **parameters: int) -> DataFrame:
    """docs without those that are rejected; all columns stay, one pass and no shuffle."""
    model = train(docs, **parameters)
    if model is None:
        return docs.limit(0)
    return docs.mapInArrow(_keep(model), docs.schema)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
