"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features: 2- and 3-grams of the lower-cased text's code points, hashed into DIM cells; TF is a cell's part of all n-grams of
the text, IDF is counted over the whole learning fold.  Training: follow-the-regularised-leader (proximal, a rate per
coordinate) with L1 and L2 penalties, on a bounded sample of the learning fold (PER_LANGUAGE texts and no more than
SAMPLE_BYTES expected for each label, whole texts).  Calibration: a temperature fitted on another such sample that training
doesn't see.  The driver trains: it holds the sample and about 1 MB for each label; all labels are learned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import inline_rows, table
from .words import sliced

DIM = 1 << 16
#: The bounded samples of labelled rows: expected texts of each label for training and for calibration, and their bytes.
PER_LANGUAGE, PER_LANGUAGE_CALIBRATION, SAMPLE_BYTES = 500, 150, 16 << 20
#: A cell is known to a label if this part of its learned texts has it (two of them at least), and known if it is to any
#: label, so that texts in several languages are known too.  A text of TELLING code points is in a learned language if the
#: known part of its n-grams reaches the fence of its predicted label (see fences()), or if the score is SURE where that
#: label has too few texts for a fence; of a shorter one the score must be OVER_CHANCE times an equal chance of all labels.  A
#: prediction contradicts a label if its score is SURE.
COMMON, TELLING, OVER_CHANCE, SURE = 0.001, 60, 1.05, 0.9
#: Weights that a prediction gathers at a time.
GATHERED = 4_000_000
ALPHA, BETA, L1, L2, EPOCHS, SCALE = 0.5, 1.0, 0.02, 0.001, 2, 30.0
UNKNOWN = "und"


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Cells of all 2- and 3-grams of the texts, and the number of grams of each text.  Grams don't cross texts."""
    flat = "".join(t.lower().replace("\x00", " ") + "\x00\x00" for t in texts)
    c = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)
    two = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA77)
    three = (two[:-1] ^ (two[:-1] >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + c[2:] * np.uint32(0x297A2D39)
    two = two[:-1]
    cells = np.stack([two, three], axis=1)
    cells ^= cells >> np.uint32(16)
    cells *= np.uint32(0x7FEB352D)
    cells ^= cells >> np.uint32(15)
    zero = c == 0
    keep = np.stack([~zero[:-2] & ~zero[1:-1], ~zero[:-2] & ~zero[1:-1] & ~zero[2:]], axis=1)
    text_of = np.cumsum(zero)[:-2] // 2  # of two zeros after each text
    n = np.bincount(text_of, keep.sum(axis=1), len(texts)).astype(np.int64)[: len(texts)]
    return (cells & np.uint32(DIM - 1))[keep], n


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def tfidf(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cells, _ = grams([text])
    at, n = np.unique(cells, return_counts=True)
    return at, SCALE * n / max(1, len(cells)) * idf[at]


class Ftrl:
    """Multinomial logistic regression by FTRL-proximal: a weight is 0 until its summed gradient leaves the L1 ball."""

    def __init__(self, classes: int):
        self.z, self.n = np.zeros((DIM, classes)), np.zeros((DIM, classes))

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = softmax(x @ w)
        p[label] -= 1
        g = x[:, None] * p
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss between 1/20 and 20, by golden section on its logarithm."""
    loss = lambda u: -np.mean(np.log(np.maximum(softmax(scores / np.exp(u))[np.arange(len(labels)), labels], 1e-12)))
    lo, hi, r = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


class Model:
    def __init__(self, labels: list[str], weights: np.ndarray, temp: float, known: np.ndarray, least: np.ndarray):
        self.labels, self.weights, self.temp, self.known, self.least = labels, weights, temp, known, least  # weights hold the IDF
        self.by_signs = float(np.mean(known))  # the known part of random n-grams
        self.by_chance = OVER_CHANCE / len(labels) if len(labels) > 1 else 0.0


def _document_counts(batches):
    """One row for each label of a task: its texts, and in how many of them each cell occurs."""
    seen: dict[str, np.ndarray] = {}
    n: dict[str, int] = {}
    for t in sliced(batches, 2 << 20):
        for text, lang in zip(t.column("text"), t.column("lang").to_pylist(), strict=True):
            hit = np.zeros(DIM, bool)
            hit[grams([text.as_py() or ""])[0]] = True
            if lang not in seen:
                seen[lang], n[lang] = np.zeros(DIM, np.int64), 0
            seen[lang] += hit
            n[lang] += 1
    for lang in seen:
        yield pa.RecordBatch.from_pydict({"lang": [lang], "n": pa.array([n[lang]], pa.int64()), "seen": pa.array([seen[lang].tobytes()], pa.binary())})


def _add_counts(t: pa.Table) -> pa.Table:
    seen = sum(np.frombuffer(b, np.int64) for b in t.column("seen").to_pylist())
    n = pa.array([pc.sum(t.column("n")).as_py()], pa.int64())
    return pa.table({"lang": t.column("lang").slice(0, 1), "n": n, "seen": pa.array([seen.tobytes()], pa.binary()), "g": t.column("g").slice(0, 1)})


def document_counts(texts: DataFrame) -> dict[str, tuple[int, np.ndarray]]:
    """For each label its texts, and those with each cell, added up in two levels; the driver gets 16 vectors of DIM counts a label at most."""
    part = texts.select("text", "lang").mapInArrow(_document_counts, "lang string, n long, seen binary").withColumn("g", F.pmod(F.spark_partition_id(), F.lit(256)))
    for by in (256, 16):
        part = part.withColumn("g", F.pmod("g", F.lit(by))).groupBy("g", "lang").applyInArrow(_add_counts, "lang string, n long, seen binary, g int")
    out: dict[str, tuple[int, np.ndarray]] = {}
    for r in part.select("lang", "n", "seen").toLocalIterator():
        n, seen = out.get(r.lang, (0, np.zeros(DIM, np.int64)))
        out[r.lang] = (n + r.n, seen + np.frombuffer(r.seen, np.int64))
    return out


def _common(n: int) -> float:
    """How many of n texts of a label must have a cell that is known to it."""
    return max(2, COMMON * n)


def fences(rows: list[tuple[str, str]], labels: list[str], counts: dict[str, tuple[int, np.ndarray]]) -> np.ndarray:
    """For each label the least known part of a text in it, from rows (text, label) of the learning fold.

    Each text is judged by what the others know: it doesn't count itself.  The fence lies under the median of these parts by half
    of the way from all n-grams known down to what random n-grams have (the part of all cells that are known), and by three
    standard errors of a mean of n parts (each at most 1/2 of the root of n).  So a label of few texts, which know little of
    a language and of each other, has a low fence, and one of a single text has none (0).  The median is used as some rows
    may bear a label by mistake."""
    known_to = np.array([counts[x][1] >= _common(counts[x][0]) for x in labels])
    votes = known_to.sum(axis=0)
    parts: dict[str, list[float]] = {x: [] for x in labels}
    for text, label in rows:
        if len(text) >= TELLING and len(cells := grams([text])[0]):
            n, seen = counts[label]
            own = known_to[labels.index(label)][cells]
            without = seen[cells] - 1 >= _common(n - 1)
            parts[label].append(float(np.mean((votes[cells] - own + without) > 0)))
    half = (1 - np.mean(votes > 0)) / 2
    return np.array([max(0.0, float(np.median(p)) - half - 1.5 / len(p) ** 0.5) if (p := parts[x]) else 0.0 for x in labels])


def train(learn: DataFrame, key: Column | str = "doc_id") -> Model | None:
    """learn: text, lang and a key that only chooses the samples, with the text.  None if there is no label."""
    known = learn.where("text is not null and lang is not null")
    counts = known.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).collect()  # a row for each label
    if not counts:
        return None
    labels = sorted(r.lang for r in counts)
    cells = document_counts(known)
    texts, seen = sum(n for n, _ in cells.values()), sum(c for _, c in cells.values())
    idf = np.log((texts + 1) / (seen + 1)) + 1
    both = PER_LANGUAGE + PER_LANGUAGE_CALIBRATION
    chance = inline_rows(learn.sparkSession, [{"lang": r.lang, "chance": min(1.0, both / r.n, SAMPLE_BYTES / max(1, r.b))} for r in counts], "lang string, chance double")
    spot = F.pmod(F.xxhash64(F.lit("sample"), F.col(key), "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = known.select("text", "lang", spot.alias("spot")).join(F.broadcast(chance), "lang").where("spot < chance")  # a row for each label
    rows = rows.orderBy("spot", "text").limit(2 * both * len(labels)).collect()
    index = {x: i for i, x in enumerate(labels)}
    own, split = dict.fromkeys(labels, 0), []
    held_of = {x: sum(r.lang == x for r in rows) * PER_LANGUAGE_CALIBRATION // both for x in labels}
    for r in rows:  # the first of each label, by their draw, calibrate
        own[r.lang] += 1
        split.append(own[r.lang] > held_of[r.lang])
    fit = [(*tfidf(r.text, idf), index[r.lang]) for r, s in zip(rows, split, strict=True) if s]
    ftrl, rng = Ftrl(len(labels)), np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(fit)):
            ftrl.learn(*fit[i])
    w = ftrl.weights(slice(None))
    held = [(*tfidf(r.text, idf), index[r.lang]) for r, s in zip(rows, split, strict=True) if not s]
    temp = temperature(np.array([x @ w[at] for at, x, _ in held]), np.array([y for *_, y in held])) if held else 1.0
    known_cells = np.any([c >= _common(n) for n, c in cells.values()], axis=0)
    least = fences([(r.text, r.lang) for r in rows], labels, cells)
    return Model(labels, (SCALE * w * idf[:, None]).astype(np.float32), temp, known_cells, least)


def _predict(shared):
    def run(batches):
        m: Model = shared.value
        for t in sliced(batches, 1 << 19):
            texts = [x or "" for x in t.column("text").to_pylist()]
            cells, n = grams(texts)
            text, step = np.repeat(np.arange(len(texts)), n), max(1, GATHERED // len(m.labels))
            scores = np.zeros((len(texts), len(m.labels)))
            for at in range(0, len(cells), step):
                own = text[at : at + step]
                first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                scores[own[first]] += np.add.reduceat(m.weights[cells[at : at + step]], first, axis=0, dtype=np.float64)
            scores /= np.maximum(n, 1)[:, None]
            known = np.bincount(text, m.known[cells], len(texts)) / np.maximum(n, 1)
            p = softmax(scores / m.temp)
            best = p.argmax(axis=1)
            ok = [has_letter(x) for x in texts]
            lang = [m.labels[b] if k else UNKNOWN for b, k in zip(best, ok, strict=True)]
            score = np.where(ok, p[np.arange(len(texts)), best], 0.0)
            least = np.where(ok, m.least[best], 0.0)
            told = {"lang_pred": pa.array(lang, pa.string()), "score": pa.array(score), "known": pa.array(known), "least": pa.array(least)}
            for name, column in told.items():
                t = t.append_column(name, column)
            yield from t.to_batches()

    return run


def identify(texts: DataFrame, model: Model | None) -> DataFrame:
    """texts: any columns and `text` -> all of them, lang_pred, score (the calibrated chance of lang_pred), known (the part of its
    n-grams that the learned texts have) and least (the fence of lang_pred for known).

    Columns of texts with those names are replaced.  A text that is null or has no letter is `und` with score 0; with one
    letter and no other character all labels are equally likely and the first by name is given, as of any labels of equal
    scores.  Without a model every text is `und`.  Rows don't depend on each other; an empty table gives no rows.  Long texts
    are scored whole, GATHERED weights at a time."""
    texts = texts.drop("lang_pred", *_NUMBERS)
    if model is None:
        return texts.withColumn("lang_pred", F.lit(UNKNOWN)).withColumns({c: F.lit(0.0) for c in _NUMBERS})
    shared = texts.sparkSession.sparkContext.broadcast(model)  # DIM floats a label: 0.25 MB
    more = [T.StructField("lang_pred", T.StringType()), *[T.StructField(c, T.DoubleType()) for c in _NUMBERS]]
    return texts.mapInArrow(_predict(shared), T.StructType(texts.schema.fields + more))


_NUMBERS = ("score", "known", "least")


def surely(text: Column, model: Model | None) -> Column:
    """Whether identify() finds the text in a learned language, or in a mixture of such: texts in other scripts and random signs aren't."""
    if model is None:
        return F.lit(False)
    return (F.col("lang_pred") != UNKNOWN) & F.when(F.length(text) < TELLING, F.col("score") >= model.by_chance).when(F.col("least") > model.by_signs, F.col("known") >= F.col("least")).otherwise(F.col("score") >= SURE)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is 2 modulo 4 (a null id's text is empty)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def learned(docs: DataFrame) -> Model | None:
    fold = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"), docs["lang"].alias("lang"))
    return train(fold.where(~held_out(F.col("doc_id"))))


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return identify(rows, learned(docs)).select("doc_id", "held_out", "lang_pred", "score")
