"""Quality rules: counted base rules, then a calibrated classifier.

Base: a text fails with under 50 words, or if over half of its words stand in three-word windows that occur twice or
more.  The classifier is a logistic regression on hashed word 1- and 2-grams and character 4-grams of code points
(relative frequencies in a text; grams don't leave their text, so a score depends on the text alone), trained on at most
``TRAIN_ROWS`` labelled rows (those of least hash, the bound of the sample) and calibrated on those that were held out; a
text is kept if the probability of good quality is at least ``THRESHOLD``.
Null text counts as empty and fails.  Very long texts are scored whole.  Labels that are null don't train; a label that
repeats trains once, and of texts that share a labelled id the least trains; without rows of both classes every text
that passes the base rules is kept.  Repeated rows are rows of their own, a tie at the threshold is kept, an empty table
gives no rows, and other columns don't enter, whatever their names."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm import common
from assayer.llm.linear import Rows, calibrate, train
from assayer.llm.words import Words, as_bytes, mix

TRAIN_ROWS, HELD_OUT, THRESHOLD = 3000, 0.25, 0.5
#: Hashed columns of each kind of feature: words, word pairs, character 4-grams.
BITS = 16
WIDTH = 3 << BITS
MIN_WORDS, REPEAT_PERCENT = 50, 50
_SYMBOLS, _BLANK = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
_G = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint32)


def counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    raw = as_bytes(text)
    words = raw.split()
    chars = len(text or "") - (len(raw) - len(raw.translate(None, _BLANK)))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    n, repeated = len(words), 0
    if n > 3:
        number = dict(zip(words, range(n)))
        ids = np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=n)
        if n < 1 << 20:
            key = (ids[:-2] * n + ids[1:-1]) * n + ids[2:]
        else:
            pair = np.unique(ids[:-2] * n + ids[1:-1], return_inverse=True)[1]
            key = pair * n + ids[2:]
        order = np.sort(key)
        twice = order[1:][order[1:] == order[:-1]]
        if len(twice):
            hit = np.isin(key, twice)
            in_window = np.zeros(n, dtype=bool)
            for j in range(3):
                in_window[j : n - 2 + j] |= hit
            repeated = int(in_window.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


def grams(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind of feature: hashed columns, and the number of each one's text, ascending."""
    w = Words([as_bytes(t) for t in texts], lower=False)
    out, mask = [], np.uint64((1 << BITS) - 1)
    for k in (1, 2):
        h, doc = w.windows(k)
        out.append(((mix(h) & mask).astype(np.int64) + ((k - 1) << BITS), doc))
    x = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if len(x) >= 4:
        h = x[:-3] * _G[0] + x[1:-2] * _G[1] + x[2:-1] * _G[2] + x[3:] * _G[3]
        h = ((h ^ (h >> np.uint32(15))) * _G[1]) >> np.uint32(32 - BITS)
        doc = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t or "") for t in texts])
        inside = doc[:-3] == doc[3:]
        out.append((h[inside].astype(np.int64) + (2 << BITS), doc[:-3][inside].astype(np.int64)))
    return out


def _training_rows(labelled: DataFrame):
    """Sparse features of labelled rows, collected: a bounded number of rows of bounded width."""

    def run(it):
        schema = pa.schema([("y", pa.int32()), ("index", pa.binary()), ("value", pa.binary())])
        for held in common.chunks(it, lambda r: len(r[1] or "") + 64, 1 << 20):
            kinds, rows = grams([r[1] for r in held]), []
            parts: list[list] = [[] for _ in held]
            for col, doc in kinds:
                at = np.searchsorted(doc, np.arange(len(held) + 1))
                for i in range(len(held)):
                    c = col[at[i] : at[i + 1]]
                    if len(c):
                        u, n = np.unique(c, return_counts=True)
                        parts[i].append((u.astype(np.int32), (n / len(c)).astype(np.float32)))
            for (y, _), p in zip(held, parts):
                rows.append((int(y), np.concatenate([x[0] for x in p] or [np.zeros(0, np.int32)]).tobytes(), np.concatenate([x[1] for x in p] or [np.zeros(0, np.float32)]).tobytes()))
            yield from common.batches(rows, schema, 64)

    got = labelled.mapInArrow(run, "y int, index binary, value binary").toArrow()
    y = np.asarray(got.column("y").to_pylist(), dtype=np.float64)
    index = [np.frombuffer(b.as_py(), np.int32) for b in got.column("index")]
    value = [np.frombuffer(b.as_py(), np.float32) for b in got.column("value")]
    return y, index, value


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"):
    """(weights, bias, a, c) or None without two classes.  The sample: labelled rows of least hash of the id."""
    chosen = labels.select(F.col(id_col).alias("_k"), F.col(label_col).cast("int").alias("y")).where("_k is not null and y in (0, 1)").distinct()
    chosen = chosen.orderBy(F.xxhash64("_k"), "_k", "y").limit(TRAIN_ROWS)
    rows = documents.select(F.col(id_col).alias("_d"), F.col(text_col).alias("_t")).join(F.broadcast(chosen), F.col("_d") == F.col("_k"))
    common.bound_batches(documents.sparkSession)
    y, index, value = _training_rows(rows.groupBy("_k", "y").agg(F.min("_t").alias("_t")).select("y", "_t"))  # a row a label at most
    if len(set(y.tolist())) < 2:
        return None
    order = np.lexsort((np.array([i[:64].sum(dtype=np.int64) for i in index]), [len(i) for i in index]))  # whatever order the tasks came in
    held = np.zeros(len(y), bool)
    held[order[:: round(1 / HELD_OUT)]] = True
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held[:] = False
    pick = lambda m: Rows([index[i] for i in order if m[i]], [value[i] for i in order if m[i]])
    w, b = train(pick(~held), y[order][~held[order]], WIDTH)
    test = held if held.any() else ~held
    a, c = calibrate(pick(test).dot(w) + b, y[order][test[order]])
    return w.astype(np.float32), float(b), a, c


def judge(documents: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", keep_row: bool = False) -> DataFrame:
    """Counts, base_failed, probability and kept for every row; with ``keep_row`` the rows that are kept, unchanged."""
    common.bound_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)  # WIDTH floats
    fields = [("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("probability", pa.float64())]
    schema = pa.schema(fields)

    def verdicts(texts: list):
        rows = [counts(t) for t in texts]
        failed = [r[0] < MIN_WORDS or 100 * r[4] > REPEAT_PERCENT * r[0] for r in rows]
        p = np.ones(len(texts))
        if shared.value is not None:
            w, b, a, c = shared.value
            z = np.full(len(texts), b)
            for col, doc in grams(texts):
                n = np.bincount(doc, minlength=len(texts))
                z += np.bincount(doc, w[col], minlength=len(texts)) / np.maximum(n, 1)
            p = 1 / (1 + np.exp(-np.clip(a * z + c, -40, 40)))
        return rows, failed, p.tolist()

    def run(it):
        for held in common.chunks(it, lambda r: len(r[1] or "") + 64, 1 << 20):
            rows, failed, p = verdicts([r[1] for r in held])
            yield from common.batches(((h[0], *r, f, not f and q >= THRESHOLD, q) for h, r, f, q in zip(held, rows, failed, p)), schema, 8192)

    def keep(it):
        for batch in it:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                _, failed, p = verdicts(part.column(text_col).to_pylist())
                yield part.filter(pa.array([not f and q >= THRESHOLD for f, q in zip(failed, p)]))

    if keep_row:
        return documents.mapInArrow(keep, documents.schema)
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double")


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return judge(documents, fit(documents, labels))
