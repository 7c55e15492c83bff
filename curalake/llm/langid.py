"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies come from every training document. The weights are trained by follow-the-regularised-leader
with elastic-net penalties on a bounded sample of whole labelled texts (``SAMPLE`` per language): each epoch runs FTRL
on ``SHARDS`` parts of the sample and averages their states. A temperature fitted on rows of the sample that FTRL did
not see calibrates the scores. What reaches the driver is bounded by languages, buckets, shards and the sample.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curalake.llm.common import bounded_batches, written

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
SAMPLE = 1_000
SHARDS = 6
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.002
UNKNOWN = "und"
CHUNK = 500_000
SEED = 2

_rng = np.random.default_rng(2)
_STEP = _rng.integers(1, 1 << 62, size=(len(ORDERS), max(ORDERS)), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_counts(texts: Sequence[str]) -> Iterator[np.ndarray]:
    """Per text the number of its character n-grams in each bucket; letters are lower-cased."""
    chunk: list[str] = []
    held = 0
    for i, text in enumerate(texts):
        chunk.append(text)
        held += len(text)
        if held > CHUNK or i == len(texts) - 1:
            yield from _chunk_counts(chunk)
            chunk, held = [], 0


def _chunk_counts(texts: list[str]) -> Iterator[np.ndarray]:
    parts = [f" {t.lower()} " for t in texts]
    points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    points = (points + np.uint64(11)) * np.uint64(0x9E3779B97F4A7C15)
    points ^= points >> np.uint64(29)
    n = len(points)
    grams = np.zeros((len(ORDERS), n), dtype=np.int32)
    for row, order in enumerate(ORDERS):
        if n >= order:
            value = points[: n - order + 1] * _STEP[row, 0]
            for k in range(1, order):
                value = value + points[k : n - order + 1 + k] * _STEP[row, k]
            grams[row, : n - order + 1] = (value >> np.uint64(64 - 15)).astype(np.int32)
    at = 0
    for part in parts:
        stop = at + len(part)
        yield np.bincount(np.concatenate([grams[row, at : max(at, stop - order + 1)] for row, order in enumerate(ORDERS)]), minlength=BUCKETS)
        at = stop


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Documents with a letter, and in how many of them each bucket occurs."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, seen = 0, np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for counts in gram_counts([t for t in batch["text"].tolist() if has_letter(t)]):
                seen += counts > 0
                total += 1
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"bucket": np.append(at, -1), "n": np.append(seen[at], total)})

    found = docs.select(F.col("text").cast("string").alias("text")).mapInPandas(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    frequency = np.zeros(BUCKETS, dtype=np.int64)
    inner = found[found["bucket"] >= 0]
    frequency[inner["bucket"].to_numpy()] = inner["n"].to_numpy()
    return int(found.loc[found["bucket"] < 0, "n"].sum()), frequency


def idf_of(total: int, frequency: np.ndarray) -> np.ndarray:
    return np.log((1.0 + total) / (1.0 + frequency)) + 1.0


def tfidf(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that occur and their weights: damped counts times idf, scaled to length one."""
    at = np.flatnonzero(counts)
    x = np.log1p(counts[at]) * idf[at]
    return at, x / np.sqrt(x @ x)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl_weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def ftrl_pass(rows: Sequence[tuple[int, np.ndarray, np.ndarray]], z: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One pass over (class, buckets, values) from the state (z, n); both are (classes, buckets)."""
    z, n = z.copy(), n.copy()
    for y, at, x in rows:
        own_n = n[:, at]
        w = ftrl_weights(z[:, at], own_n)
        gap = softmax(w @ x)
        gap[y] -= 1.0
        g = gap[:, None] * x[None, :]
        grown = own_n + g * g
        z[:, at] += g - (np.sqrt(grown) - np.sqrt(own_n)) / ALPHA * w
        n[:, at] = grown
    return z, n


def temperature(logits: np.ndarray, classes: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search on its logarithm."""
    if not len(classes):
        return 1.0

    def loss(log_t: float) -> float:
        p = softmax(logits / np.exp(log_t))
        return float(-np.log(np.maximum(p[np.arange(len(classes)), classes], 1e-300)).mean())

    low, high, part = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - part * (high - low), low + part * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


class Model:
    def __init__(self, languages: list[str], weights: np.ndarray, idf: np.ndarray, heat: float) -> None:
        self.languages, self.weights, self.idf, self.heat = languages, weights, idf, heat

    def predict(self, texts: Sequence[str | None]) -> list[tuple[str, float]]:
        out = [(UNKNOWN, 0.0)] * len(texts)
        known = [i for i, t in enumerate(texts) if self.languages and has_letter(t)]
        for i, counts in zip(known, gram_counts([texts[i] for i in known]), strict=True):
            at, x = tfidf(counts, self.idf)
            p = softmax(self.weights[:, at] @ x / self.heat)
            best = int(p.argmax())
            out[i] = self.languages[best], float(p[best])
        return out


def train(labelled: DataFrame, sample: int = SAMPLE, epochs: int = EPOCHS, shards: int = SHARDS) -> Model:
    """A model from rows ``doc_id, text, lang``; rows without lang are left out.

    Languages with at most ``sample`` documents are used whole, larger ones thinned by a hash of doc_id to about that
    many. Every fifth sampled row calibrates only.
    """
    rows = labelled.filter("lang IS NOT NULL").select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((0, BUCKETS)), np.ones(BUCKETS), 1.0)
    bounded_batches(labelled.sparkSession)
    idf = idf_of(*document_frequencies(rows))
    share = F.create_map(*[x for k, v in sizes.items() for x in (F.lit(k), F.lit(min(1.0, sample / v)))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1_000_000)) / 1_000_000
    chosen = rows.filter(draw < share[F.col("lang")])

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[[has_letter(t) for t in batch["text"].tolist()]]
            if not len(batch):
                continue
            pairs = [tfidf(c, idf) for c in gram_counts(batch["text"].tolist())]
            yield pd.DataFrame({
                "turn": batch["turn"], "y": [languages.index(x) for x in batch["lang"]], "at": [p[0].astype(np.int32) for p in pairs], "x": [p[1].astype(np.float32) for p in pairs],
            })

    turned = chosen.select(F.pmod(F.xxhash64("doc_id", F.lit(SEED + 1)), F.lit(1 << 40)).alias("turn"), "text", "lang")
    table = written(turned.mapInPandas(features, "turn bigint, y int, at array<int>, x array<float>"), "langid-sample")
    z = n = np.zeros((len(languages), BUCKETS))

    def learn(key: tuple[int], part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["turn", "y"])
        own_z, own_n = ftrl_pass([(y, at, x.astype(np.float64)) for y, at, x in zip(part["y"], part["at"], part["x"], strict=True)], z, n)
        return pd.DataFrame({"z": [own_z.tobytes()], "n": [own_n.tobytes()]})

    for _ in range(epochs):
        states = table.filter("turn % 5 > 0").groupBy(F.expr(f"turn DIV 5 % {shards}").alias("shard")).applyInPandas(learn, "z binary, n binary").collect()
        if states:
            z, n = (np.mean([np.frombuffer(s[c], dtype=np.float64).reshape(z.shape) for s in states], axis=0) for c in ("z", "n"))
    weights = ftrl_weights(z, n)

    def logits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in filter(len, batches):
            yield pd.DataFrame({"y": batch["y"], "l": [weights[:, at] @ x for at, x in zip(batch["at"], batch["x"], strict=True)]})

    tried = table.filter("turn % 5 = 0").select("y", "at", "x").mapInPandas(logits, "y int, l array<double>").toPandas()
    heat = temperature(np.stack(tried["l"].to_numpy()), tried["y"].to_numpy()) if len(tried) else 1.0
    return Model(languages, weights, idf, heat)


def identify(docs: DataFrame, **bounds: int) -> DataFrame:
    """Per row ``doc_id, held_out, lang_pred, score``; the model learns from rows that are not held out.

    A text that is null or has no letter is ``und`` with score 0; so is every text if no row has a language. Repeated
    rows are predicted alike. A null doc_id is not held out.
    """
    model = train(docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"), **bounds)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x buckets doubles
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame(shared.value.predict(texts.tolist()), columns=["lang_pred", "score"])

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict(F.col("text").cast("string")).alias("x")).select("doc_id", "held_out", "x.*")
