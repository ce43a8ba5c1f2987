"""Toxicity by multiple-instance learning: sentence scores joined by noisy-or, learned from document labels."""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatherline.llm.shared import sampled, slices, text_of

#: Labelled documents of each class that training reads at most, chosen by hash; all others are only scored.
TRAIN_PER_CLASS = 4000
#: And of those only as many as stay under so many bytes of text a class; one longer than that alone is left out.
TRAIN_BYTES = 64_000_000
STEPS, THRESHOLD, SENTENCE_THRESHOLD = 600, 0.7, 0.5
#: How far a feature's share of toxic documents must lie above theirs of all, as a binomial's log likelihood ratio.
DEVIANCE, RIDGE = 11.0, 1e-3
PREFIXES = (3, 4, 5, 6)
SENTENCE_END = re.compile(r"[.!?\n]+")
PUNCTUATION = string.punctuation + "«»„“”¿¡…–—"


def features(word: str) -> list[str]:
    """The beginnings of a lower-case word, up to the word itself: insults come inflected."""
    word = word.strip(PUNCTUATION)
    return [word[:n] for n in PREFIXES if len(word) >= n]


def novel(texts: list[str]) -> list[int]:
    """Places of the texts of which at least half the sentences are new: copies would pass for evidence."""
    seen: set[str] = set()
    out = []
    for i, text in enumerate(texts):
        parts = {p.strip().lower() for p in SENTENCE_END.split(text)} - {""}
        if len(parts & seen) * 2 <= len(parts):
            out.append(i)
        seen |= parts
    return out


def telling(texts: list[str], y: np.ndarray, deviance: float) -> dict[str, int]:
    """Features that stand in more toxic documents than chance allows, and their places."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    cache: dict[str, list[str]] = {}
    for text, label in zip(texts, y, strict=True):
        found: set[str] = set()
        for w in set(SENTENCE_END.sub(" ", text.lower()).split()):
            if w not in cache:
                cache[w] = features(w)
            found.update(cache[w])
        counts[int(label)].update(found)
    rate = y.mean()
    names = []
    for name, t in counts[1].items():
        n = t + counts[0][name]
        if t > n * rate and t * np.log(t / (n * rate)) + (counts[0][name] and (n - t) * np.log((n - t) / (n * (1 - rate)))) >= deviance:
            names.append(name)
    return {name: i for i, name in enumerate(sorted(names))}


def fit(texts: list[str], toxic: np.ndarray, steps: int = STEPS, rate: float = 0.3, ridge: float = RIDGE, deviance: float = DEVIANCE) -> tuple[dict[str, float], float]:
    """Weights by feature, and bias: adaptive-gradient steps on the noisy-or likelihood of the document labels.

    A document is toxic with probability 1 - prod(1 - p) over its sentences' p. Only telling features take part, and
    only sentences that hold one are told apart; in training the rest count with the bias alone, which keeps it low. With
    one class only, or no text, there are no weights and the bias says "clean".
    """
    kept = novel(texts)
    texts, y = [texts[i] for i in kept], np.asarray(toxic, float)[kept]
    if not len(y) or y.min() == y.max():
        return {}, -12.0
    place = telling(texts, y, deviance)
    cache: dict[str, list[int]] = {}
    col, sentence, document, plain = [], [], [], np.zeros(len(texts))
    for d, text in enumerate(texts):
        for part in SENTENCE_END.split(text):
            found: set[int] = set()
            for w in set(part.lower().split()):
                if w not in cache:
                    cache[w] = [place[f] for f in features(w) if f in place]
                found.update(cache[w])
            if found:
                col.extend(found)
                sentence.extend([len(document)] * len(found))
                document.append(d)
            else:
                plain[d] += 1
    if not document:
        return {}, -12.0
    col, sentence, document, n, n_docs = np.array(col), np.array(sentence), np.array(document), len(document), len(texts)
    bias, w = -float(np.log(max(2.0, (n + plain.sum()) / n_docs))), np.zeros(len(place))
    g2, b2 = np.full(len(place), 1e-4), 1e-4
    for _ in range(steps):
        z = bias + np.bincount(sentence, w[col], n)
        soft, soft0 = np.logaddexp(0, z), np.logaddexp(0, bias)
        q = np.exp(-(np.bincount(document, soft, n_docs) + plain * soft0))  # the chance that no sentence is toxic
        pull = np.where(y > 0, -q / np.maximum(1 - q, 1e-9), 1.0)
        each = pull[document] * np.exp(z - soft)
        g = np.bincount(col, each[sentence], len(place)) / n_docs + ridge * w / n_docs
        gb = (each.sum() + (pull * plain).sum() * np.exp(bias - soft0)) / n_docs
        g2 += g * g
        b2 += gb * gb
        w -= rate * g / np.sqrt(g2)
        bias -= float(rate * gb / np.sqrt(b2))
    return {name: float(w[i]) for name, i in place.items()}, bias


MODEL = "feature string, weight double"


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = TRAIN_PER_CLASS, most_bytes: int = TRAIN_BYTES) -> dict[str, float]:
    """The model as ``{feature: weight}``, the bias under ""; bounded as the sample is.

    Reads at most ``per_class`` labelled documents of each class, those of smallest hashed id, and of these as many
    as have ``most_bytes`` of text together; one task fits them and only the weights come back. Null ids, labels and
    texts are left out. Repeated labels count once, and of repeated ids the least text does.
    """
    marked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).cast("int").alias("_y"))
    held = {r["_y"]: r["count"] for r in marked.groupBy("_y").count().collect()}  # two rows
    chosen = None
    for y in (0, 1):
        part = sampled(marked.where(F.col("_y") == y), "train", id_col, per_class, held.get(y, 0))
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = chosen.select(F.col(id_col).alias("_id"), "_y")
    texts = docs.where(F.col(text_col).isNotNull()).join(F.broadcast(chosen), F.col(id_col) == F.col("_id"))
    texts = texts.select(F.col("_id").alias("id"), F.col("_y").alias("y"), F.make_valid_utf8(F.col(text_col)).alias("text")).groupBy("id", "y").agg(F.min("text").alias("text"))
    upto = F.sum(F.octet_length("text").cast("bigint")).over(Window.partitionBy("y").orderBy(F.xxhash64(F.lit("train"), F.col("id")), "id").rowsBetween(Window.unboundedPreceding, 0))
    texts = texts.withColumn("upto", upto).where(F.col("upto") <= most_bytes).select(F.lit(0).alias("one"), "id", "y", "text")

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        weights, bias = fit(pdf["text"].tolist(), pdf["y"].to_numpy())
        return pd.DataFrame({"feature": ["", *weights], "weight": [bias, *weights.values()]})

    return {r["feature"]: r["weight"] for r in texts.groupBy("one").applyInPandas(fitted, MODEL).collect()} or {"": -12.0}


class _Scores(dict):
    """The summed weights of words, None for words without a learned feature; remembered up to a bound."""

    def __init__(self, model: dict[str, float]):
        self.model = model

    def __missing__(self, word: str) -> float | None:
        if len(self) > 150_000:
            self.clear()
        known = [self.model[f] for f in features(word) if f in self.model]
        self[word] = s = sum(known) if known else None
        return s


def sentence_logit(part: str, scores: _Scores, bias: float) -> float:
    """Minus infinity for a sentence without a learned feature."""
    known = [s for s in map(scores.__getitem__, set(part.lower().split())) if s is not None]
    return bias + sum(known) if known else -np.inf


def noisy_or(text: str, scores: _Scores, bias: float) -> float:
    """1 - prod(1 - p) over the sentences; n sentences without a learned feature count as ln(1 + n) of bare bias, so no
    text becomes toxic by its length."""
    logits = np.array([sentence_logit(part, scores, bias) for part in SENTENCE_END.split(text)])
    plain = np.log1p(np.isneginf(logits).sum()) * np.logaddexp(0, bias)
    return min(1.0, max(0.0, float(-np.expm1(-plain - np.logaddexp(0, logits).sum()))))


def offending(text: str, scores: _Scores, bias: float) -> list[dict]:
    """The sentences that are toxic by themselves: start and end in the text's code points, and score."""
    out, start = [], 0
    for end in [*(m.start() for m in SENTENCE_END.finditer(text)), len(text)]:
        part = text[start:end]
        p = float(1 / (1 + np.exp(-sentence_logit(part, scores, bias))))
        if p >= SENTENCE_THRESHOLD:
            lead = len(part) - len(part.lstrip())
            out.append({"start": start + lead, "end": end, "score": p})
        m = SENTENCE_END.match(text, end)
        start = m.end() if m else end
    return out


SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])


def _scorer(model: dict[str, float], text_at: int, below: float | None, find: bool = True):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, bias = _Scores(model), model[""]
        for batch in slices(batches):
            at, spans = [], []
            for text in batch.column(text_at):
                text = text_of(text)
                score = noisy_or(text, scores, bias)
                at.append(score)
                if below is None:
                    spans.append(offending(text, scores, bias) if find and score >= SENTENCE_THRESHOLD else [])
            if below is None:
                kept = [c for i, c in enumerate(batch.columns) if i != text_at]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(at, pa.float64()), pa.array(spans, pa.list_(SPAN))], names=[*(f"c{i}" for i in range(len(kept))), "score", "offending"])
            else:
                yield batch.filter(pa.array([s < below for s in at], pa.bool_()))

    return scored


def score(docs: DataFrame, model: dict[str, float], text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), find: bool = True) -> DataFrame:
    """``keep`` columns, ``score`` (0 to 1) and ``offending`` (``start, end, score`` of toxic sentences; none unless ``find``) of every row.

    Null and empty texts are one empty sentence and score as low as the bias. Whole texts of any length are read, bytes that
    aren't UTF-8 as replacement characters; rows in, rows out.
    """
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col(text_col).alias("text"))
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("score", T.DoubleType()), T.StructField("offending", span)])
    return rows.mapInArrow(_scorer(model, len(keep), None, find), schema).withColumnsRenamed({f"c{i}": c for i, c in enumerate(keep)})


def held_out(doc_id) -> "F.Column":
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, find: bool = True) -> DataFrame:
    """One row a document: ``doc_id, held_out, score, predicted, offending``.

    Labels are learned only from rows that aren't held out. An empty table gives no rows; without usable labels all
    is clean. Repeated rows score alike; a null doc_id is never held out. Without ``find`` no sentences are located.
    """
    model = train(docs, labels.where(~held_out(F.col("doc_id"))))
    out = score(docs, model, find=find)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "offending")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, all columns as they were."""
    model = train(docs, labels.where(~held_out(F.col("doc_id"))))
    names = docs.columns
    rows = docs.select(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(names)])
    return rows.mapInArrow(_scorer(model, names.index("text"), threshold), rows.schema).toDF(*names)
