"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Features are runs of one to three characters of the lower-cased text, every run of non-letters being
one space, hashed to 2**15 columns; tf is the share of the text's n-grams, idf comes from all training
documents. Weights are learned with follow-the-regularised-leader (proximal, per coordinate, L1 and
L2); a part of the sample that is not trained on sets the softmax temperature, with labels smoothed by
1 / (rows + 2), so that a part without errors does not make every score 1.

Only the classifier's rows are a sample: ``sample_docs`` documents, the same share of each language, the
first by a hash of the id. Document frequencies cover every training document and every prediction
the whole text. Every language of the training documents is learned; more than ``max_langs`` of them (a wrong
column, say) are an error.

Defined cases: null text or no letter: ``und`` with score 0; nothing to learn from: ``und`` for all;
repeated rows and ties: the same prediction, equal probabilities go to the first language in order.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import remainder
from codeloom.llm.textscan import buffer_of, pieces

BITS = 15
DIM = 1 << BITS
ORDERS = 3
UNKNOWN = "und"
_SCALE = 60.0


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _slots(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature of every n-gram of every row, the rows' first indexes, and whether a row has a letter."""
    raw, at = buffer_of(pc.utf8_lower(column))
    lead = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    at = lead[at]
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    letter = _letters()[points]
    seen = np.concatenate(([0], np.cumsum(letter)))
    has = seen[at[1:]] > seen[at[:-1]]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # a space after the last letter of a word stays
    starts = at[:-1][at[:-1] < at[1:]]
    if len(starts):
        keep[starts] |= True
    code = np.where(letter, points, np.uint32(32))[keep]
    at = np.concatenate(([0], np.cumsum(keep)))[at]
    ends = np.repeat(at[1:], np.diff(at))
    place = np.arange(len(code))
    grams, rows = [], []
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    rolled = np.zeros(len(code), np.uint32)
    for n in range(1, ORDERS + 1):
        shifted = np.zeros(len(code), np.uint32)
        shifted[: len(code) - n + 1] = code[n - 1 :]
        rolled = (rolled + shifted) * np.uint32(0x9E3779B1)
        rolled ^= rolled >> np.uint32(15)
        whole = place + n <= ends
        grams.append((((rolled + np.uint32(n)) * np.uint32(0x85EBCA77)) >> np.uint32(32 - BITS))[whole])
        rows.append(row[whole])
    slot, owner = np.concatenate(grams), np.concatenate(rows)
    order = np.argsort(owner, kind="stable")
    slot, owner = slot[order], owner[order]
    return slot, np.searchsorted(owner, np.arange(len(at))), has


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  #: idf times weight, by feature and language
    bias: np.ndarray
    temperature: float


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = 3, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of a softmax regression; ``rows``: features, values, class."""
    z, n = np.zeros((DIM + 1, classes)), np.zeros((DIM + 1, classes))

    def weight(at: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for ids, values, label in rows:
            at, x = np.append(ids, DIM), np.append(values, 1.0)[:, None]
            w = weight(at)
            p = _softmax((w * x).sum(axis=0))
            p[label] -= 1.0
            g = x * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weight(np.arange(DIM + 1))
    return w[:DIM], w[DIM]


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search over its logarithm.

    Labels are smoothed: 1 / (rows + 2) of each goes to the other classes.
    """
    n, classes = logits.shape
    if not n or classes < 2:
        return 1.0
    goal = np.full(logits.shape, 1 / (n + 2) / (classes - 1))
    goal[np.arange(n), labels] = 1 - 1 / (n + 2)

    def loss(t: float) -> float:
        return float(-(goal * np.log(np.maximum(_softmax(logits / math.exp(t)), 1e-300))).sum(axis=1).mean())

    lo, hi, ratio = math.log(0.05), math.log(20.0), (math.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return math.exp((lo + hi) / 2)


def _frequencies(batches):
    total, seen, docs = np.zeros(DIM, np.int64), np.zeros(DIM, bool), 0
    for batch in batches:
        for part in pieces(batch):
            slot, first, has = _slots(part.column(0))
            for i in np.flatnonzero(has):
                own = slot[first[i] : first[i + 1]]
                seen[own] = True
                total += seen
                seen[own] = False
                docs += 1
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, DIM), pa.int32()), pa.array(np.append(total[at], docs), pa.int64())], ["slot", "n"])


def _vectors(batches):
    for batch in batches:
        for part in pieces(batch):
            slot, first, has = _slots(part.column(0))
            lang, ids, shares = [], [], []
            for i in np.flatnonzero(has):
                own, count = np.unique(slot[first[i] : first[i + 1]], return_counts=True)
                lang.append(part.column(1)[int(i)].as_py())
                ids.append(own.astype(np.int32))
                shares.append((count / count.sum()).astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(lang, pa.string()), pa.array(ids, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32())), part.column(2).take(pa.array(np.flatnonzero(has)))],
                ["lang", "ids", "shares", "place"],
            )


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = 3000, max_langs: int = 2000, folds: int = 5) -> Model | None:
    """Learn from documents with a language whose crc32 of the id modulo ``folds`` is not 0.

    ``sample_docs`` bounds the classifier's rows; more languages than ``max_langs`` raise an error.
    """
    spark = docs.sparkSession
    learn = docs.filter((remainder(id_col, folds) != 0) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    learn = learn.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.pmod(F.xxhash64(F.lit("lang"), id_col), F.lit(1 << 30)).alias("place"))
    counts = {r["lang"]: r["count"] for r in learn.groupBy("lang").count().limit(max_langs + 1).collect()}
    if not counts:
        return None
    if len(counts) > max_langs:
        raise ValueError(f"more than {max_langs} languages in {lang_col}")
    langs = sorted(counts)
    share = spark.createDataFrame([(k, int((1 << 30) * min(1.0, sample_docs / len(langs) / n))) for k, n in counts.items()], "lang string, below long")
    chosen = learn.join(F.broadcast(share), "lang").filter(F.col("place") < F.col("below")).select("text", "lang", "place")
    sample = chosen.mapInArrow(_vectors, "lang string, ids array<int>, shares array<float>, place long").orderBy("place", "lang", "ids").limit(2 * sample_docs).toArrow()
    found = learn.select("text").mapInArrow(_frequencies, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(DIM + 1)
    for r in found:
        df[r["slot"]] = r["n"]
    idf = np.log((1 + df[DIM]) / (1 + df[:DIM])) + 1.0
    rows = [(np.array(i.values), np.array(v.values, np.float64), langs.index(k.as_py())) for k, i, v in zip(*(sample.column(c) for c in ("lang", "ids", "shares")), strict=True)]
    rows = [(i, v * idf[i] * _SCALE, k) for i, v, k in rows]
    fit, held = [r for k, r in enumerate(rows) if k % 5], [r for k, r in enumerate(rows) if not k % 5]
    w, b = ftrl(fit or held, len(langs))
    logits = np.array([(w[i] * v[:, None]).sum(axis=0) + b for i, v, _ in held]).reshape(-1, len(langs))
    t = temperature(logits, np.array([k for *_, k in held], int))
    return Model(langs, (w * idf[:, None] * _SCALE).astype(np.float32), b, t)


def predictor(model: Model | None):
    """A UDF of text: struct(lang, score)."""

    @F.arrow_udf("struct<lang:string,score:double>")
    def predict(text: pa.Array) -> pa.Array:
        langs, scores = [], []
        for part in pieces(pa.RecordBatch.from_arrays([text], ["text"])):
            n = part.num_rows
            if model is None:
                langs += [UNKNOWN] * n
                scores.append(np.zeros(n))
                continue
            slot, first, has = _slots(part.column(0))
            logit = np.zeros((n, len(model.langs)))
            count = np.diff(first)
            some = np.flatnonzero(count)
            for k in range(len(model.langs)):
                if len(some):
                    logit[some, k] = np.add.reduceat(model.weights[:, k][slot], first[some], dtype=np.float64) / count[some]
            p = _softmax((logit + model.bias) / model.temperature)
            best = p.argmax(axis=1)
            langs += [model.langs[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)]
            scores.append(np.where(has, p[np.arange(n), best], 0.0))
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())], ["lang", "score"])

    return predict


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", folds: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document."""
    got = docs.select(F.col(id_col).alias("doc_id"), (remainder(id_col, folds) == 0).alias("held_out"), predictor(model)(F.col(text_col)).alias("p"))
    return got.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def accepted(docs: DataFrame, model: Model | None, text_col: str = "text", min_score: float = 0.4, langs: list[str] | None = None) -> DataFrame:
    """The documents, all columns, with a language (not ``und``, of ``langs`` if given) and a score of ``min_score`` at least.

    The score is a calibrated probability; text in no learned language has one near that of a guess.
    """
    from codeloom.llm.common import fresh

    (name,) = fresh(docs, "langid")
    judged = docs.withColumn(name, predictor(model)(F.col(text_col)))
    known = F.col(name)["lang"] != UNKNOWN if langs is None else F.col(name)["lang"].isin(*langs)
    return judged.filter(known & (F.col(name)["score"] >= min_score)).select(*docs.columns)
