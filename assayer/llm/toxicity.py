"""Toxicity: words near to a learned lexicon, weighed by their context.

The lexicon is learned from labelled rows: words, and stems that many words begin with, which toxic documents hold far
more often than others (likelihood ratio, held against the number of terms tried; documents that share their least
three-word hash, such as near copies, count once).  Words of a text meet it by Levenshtein automata that walk its trie,
so misspelled terms are found too.  An entry weighs by its log odds among labelled documents, as written and misspelled
apart, so that a term whose neighbours are ordinary words weighs little when misspelled.

A match between quotation marks, in a line that quotes, or soon after a word of reporting is quotation; all others may be
abuse.  Per document the weights of abuse, misspelled abuse and quotation, the greatest one, the densest window, the share
of words and those near words of address go into a logistic regression, calibrated on a held-out quarter of the sample
and shifted to the share of toxic rows among all labels.

At most ``TRAIN_ROWS`` labelled rows of least hash train, half of each label as far as there are so many; never one whose
crc32 of the id mod 5 is 0.  Labels that are null or contradict another of the same id don't train; a label that repeats
trains once, and of texts that share a labelled id the least trains.  Without rows of both labels every score is 0.  Null
text counts as empty and is scored like one; very long texts are scored whole (words by their first 48 letters); a null
id is held out of nothing; repeated rows are rows of their own, a score of exactly 0.5 predicts 1, an empty table gives
no rows; no other column enters, whatever its name."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm import common
from assayer.llm.lexicon import LETTERS, LONGEST, Lexicon
from assayer.llm.linear import Rows, train
from assayer.llm.words import Words, as_bytes

TRAIN_ROWS, HELD_OUT = 12_000, 0.25
#: Toxic documents that hold a term at least; terms tried and entries at most; letters of a stem.
LEAST_DOCS, TRIED, ENTRIES, STEM = 3, 20_000, 2_000, range(4, 8)
#: Words of a window of context, words before a match where a report may stand, words that a task remembers.
WINDOW, REPORT, KNOWN = 16, 4, 300_000
FEATURES = 7
_WORD = re.compile(r"[\w*@$#]+")
_RUN = re.compile(r"(.)\1{2,}")
_QUOTED = re.compile(r"\"[^\"\n]{1,400}\"|“[^”\n]{1,400}”|«[^»\n]{1,400}»|„[^“”\n]{1,400}[“”]|‘[^’\n]{1,400}’|^[ \t]*>.*$", re.M)
# Words of reporting and of address in the four languages of the corpus.
REPORTS = frozenset("said says called wrote quoted quote word term slur insult means meaning defined dit disait écrit mot terme insulte sagte nannte schrieb wort begriff dijo llamó escribió palabra término insulto".split())
ADDRESS = frozenset("you your yours you're yourself u tu toi vous ton votre du dich dir dein ihr euch tú usted ustedes eres te".split())


def plain(word: str) -> str:
    """A word as it is looked up: without marks around it, drawn-out letters once."""
    return _RUN.sub(r"\1", word.strip("*@$#_"))[:LETTERS]


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Reader:
    """Matches of texts; remembers words for the texts that follow."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.clean, self.near = lexicon, set(), {}

    def _learn(self, words: set[str]) -> None:
        if len(self.clean) + len(self.near) > KNOWN:
            self.clean, self.near = set(), {}
        new = [w for w in words if w not in self.clean and w not in self.near]
        found = self.lexicon.find(sorted({plain(w) for w in new}))
        for w in new:
            m = found.get(plain(w))
            if m is None:
                self.clean.add(w)
            else:
                self.near[w] = m

    def read(self, texts: list[str | None]) -> list[tuple[int, list[tuple[int, int, int, bool, bool]]]]:
        """For each text its number of words, and of each match: place, entry, distance, whether it is quotation and
        whether an address is near."""
        lower = [(t or "").lower() for t in texts]
        words = [_WORD.findall(t) for t in lower]
        words = [[w if len(w) <= LETTERS else w[: 2 * LETTERS] for w in ws] for ws in words]
        out = []
        self._learn(set().union(*words))
        for text, ws in zip(lower, words):
            hits = [i for i, w in enumerate(ws) if w in self.near]
            out.append((len(ws), self._matches(text, ws, hits) if hits else []))
        return out

    def _matches(self, text: str, words: list[str], hits: list[int]):
        quoted, ranges = np.zeros(len(words), bool), [m.span() for m in _QUOTED.finditer(text)]
        if ranges:
            start = np.array([m.start() for m in _WORD.finditer(text)])
            for a, b in ranges:
                quoted[np.searchsorted(start, a) : np.searchsorted(start, b)] = True
        out = []
        for i in hits:
            report = quoted[i] or not REPORTS.isdisjoint(words[max(0, i - REPORT) : i])
            address = not ADDRESS.isdisjoint(words[max(0, i - WINDOW // 2) : i + WINDOW // 2 + 1])
            out.append((i, *self.near[words[i]], bool(report), address))
        return out


def features(n_words: int, matches: list, weight: np.ndarray) -> np.ndarray:
    """weight: of each entry as written and misspelled."""
    out = np.zeros(FEATURES)
    if matches:
        w = np.array([weight[e, min(d, 1)] for _, e, d, _, _ in matches])
        place, far, quoted, address = (np.array([m[i] for m in matches], t) for i, t in ((0, int), (2, int), (3, bool), (4, bool)))
        own = np.where(quoted, 0.0, w)
        so_far = np.concatenate([[0], np.cumsum(own)])
        densest = (so_far[np.searchsorted(place, place + WINDOW)] - so_far[:-1]).max()
        sums = [own[far == 0].sum(), own[far > 0].sum(), w[quoted].sum(), 0, densest, 100 * own.sum() / max(n_words, 1), own[address].sum()]
        out[:] = np.log1p(sums)
        out[3] = own.max()
    return out


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a and c for 1 / (1 + exp(-(a z + c))): smoothed targets and a pull towards a = 1, so that few or parted rows don't
    make it steep; Newton steps, halved until they help."""
    n = y.sum()
    t = np.where(y > 0, (n + 1) / (n + 2), 1 / (len(y) - n + 2))
    x = np.stack([z, np.ones(len(z))], axis=1)

    def loss(v):
        s = x @ v
        return (np.logaddexp(0, s) - t * s).sum() + (v[0] - 1) ** 2

    v = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -40, 40)))
        g = x.T @ (p - t) + [2 * (v[0] - 1), 0]
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag([2, 1e-3]), g)
        while loss(v - step) > loss(v) and np.abs(step).max() > 1e-9:
            step = step / 2
        v = v - step
        if np.abs(step).max() < 1e-9:
            break
    return float(max(v[0], 0.05)), float(v[1])


def _sample(documents: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple[DataFrame, int, int]:
    """(y, text) of the training rows, and how many rows of each label there are in all."""
    named = labels.select(F.col(id_col).alias("_k"), F.col(label_col).cast("int").alias("_y")).where("_k is not null and _y in (0, 1)").where(~held_out("_k"))
    each = named.groupBy("_k").agg(F.min("_y").alias("_y"), F.max("_y").alias("_z")).where("_y = _z")
    total = {r[0]: r[1] for r in each.groupBy("_y").count().collect()}
    chosen = [each.where(F.col("_y") == y).orderBy(F.xxhash64("_k"), "_k").limit(TRAIN_ROWS // 2).select("_k", "_y") for y in (0, 1)]
    rows = documents.select(F.col(id_col).alias("_d"), F.col(text_col).alias("_t")).join(F.broadcast(chosen[0].union(chosen[1])), F.col("_d") == F.col("_k"))
    rows = rows.groupBy("_k", "_y").agg(F.min("_t").alias("text")).select(F.col("_y").alias("y"), "text")
    return common.save(rows, "labelled"), total.get(1, 0), total.get(0, 0)


def _terms(ws: list[str]) -> set[tuple[str, bool]]:
    """Words of a text, and stems that they begin with."""
    words = {w for w in map(plain, ws) if 3 <= len(w) <= LONGEST and any(c.isalpha() for c in w)}
    return {(w, False) for w in words} | {(w[:n], True) for w in words for n in STEM if len(w) > n}


def learn(rows: DataFrame) -> list[tuple[str, bool]]:
    """Entries of the lexicon, the most telling first."""

    def sign(it):
        for held in common.chunks(it, lambda r: len(r[1] or "") + 64, 1 << 20):
            w = Words([as_bytes(r[1]) for r in held], lower=True)
            h, doc = w.windows(3)
            least = np.full(len(held), np.iinfo(np.uint64).max, np.uint64)
            np.minimum.at(least, doc, h)
            yield from common.batches(((y, t, int(s)) for (y, t), s in zip(held, least.view(np.int64).tolist())), pa.schema([("y", pa.int32()), ("text", pa.string()), ("s", pa.int64())]), 512)

    one = rows.where("text is not null").mapInArrow(sign, "y int, text string, s long").groupBy("y", "s").agg(F.min("text").alias("text"))
    one = common.save(one.select("y", "text"), "one-of-copies")
    n = {r[0]: r[1] for r in one.groupBy("y").count().collect()}
    if len(n) < 2:
        return []

    def count(it):
        schema = pa.schema([("term", pa.string()), ("stem", pa.bool_()), ("p", pa.int64()), ("n", pa.int64())])
        for held in common.chunks(it, lambda r: len(r[1]) + 64, 1 << 20):
            counts: dict[tuple[str, bool], list[int]] = {}
            for y, t in held:
                for term in _terms(_WORD.findall(t.lower())):
                    counts.setdefault(term, [0, 0])[y] += 1
            yield from common.batches(((t, s, c[1], c[0]) for (t, s), c in counts.items()), schema, 65536)

    terms = one.mapInArrow(count, "term string, stem boolean, p long, n long").groupBy("term", "stem").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    terms = common.save(terms.where(F.col("p") >= LEAST_DOCS), "terms")
    share = n[1] / (n[0] + n[1])
    part = lambda x, q: F.when(x > 0, x * F.log(x / ((F.col("p") + F.col("n")) * q))).otherwise(0.0)
    ratio = 2 * (part(F.col("p"), share) + part(F.col("n"), 1 - share))
    bar = 2 * np.log(max(1, terms.count())) + 4
    telling = terms.withColumn("g", ratio).where((F.col("g") > bar) & (F.col("p") * n[0] > 8 * F.col("n") * n[1]))
    best = telling.orderBy(F.desc("g"), "stem", F.desc(F.length("term")), "term").limit(TRIED).collect()
    entries: list[tuple[str, bool]] = []
    stems: set[str] = set()
    top: dict[str, float] = {}  # the ratio of the best entry that begins so
    for r in best:
        heads = [r["term"][:i] for i in STEM if i <= len(r["term"])]
        if not stems.isdisjoint(heads) or (r["stem"] and r["g"] < 1.2 * top.get(r["term"], 0.0)):
            continue  # a stem covers it, or it is a stem that says no more than its words
        entries.append((r["term"], r["stem"]))
        if r["stem"]:
            stems.add(r["term"])
        for h in heads:
            top.setdefault(h, r["g"])
        if len(entries) == ENTRIES:
            break
    return entries


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"):
    """(lexicon, weights of entries, coefficients, bias) or None without rows of both labels."""
    common.bound_batches(documents.sparkSession)
    rows, pos, neg = _sample(documents, labels, id_col, text_col, label_col)
    if not pos or not neg:
        return None
    lexicon = Lexicon(learn(rows))

    def read(it):
        reader, schema = Reader(lexicon), pa.schema([("y", pa.int32()), ("n", pa.int32()), ("m", pa.list_(pa.int32()))])
        for held in common.chunks(it, lambda r: len(r[1] or "") + 64, 1 << 20):
            yield from common.batches(((y, n, [int(v) for x in m for v in x]) for (y, _), (n, m) in zip(held, reader.read([r[1] for r in held]))), schema)

    got = rows.mapInArrow(read, "y int, n int, m array<int>").toArrow().to_pylist()  # TRAIN_ROWS rows of matches
    got = sorted((r["y"], r["n"], [tuple(r["m"][i : i + 5]) for i in range(0, len(r["m"]), 5)]) for r in got)
    y = np.array([r[0] for r in got], np.float64)
    if len(set(y.tolist())) < 2:
        return None
    weight = np.zeros((len(lexicon.entries) + 1, 2))
    docs = np.zeros((len(weight), 2, 2))  # entry, misspelled, label
    for label, _, m in got:
        for e, d in {(x[1], min(x[2], 1)) for x in m if not x[3]} or {(x[1], min(x[2], 1)) for x in m}:
            docs[e, d, label] += 1
    of = np.array([(y == 0).sum(), (y == 1).sum()], np.float64)
    odds = lambda c, prior: np.log((c[:, 1] + prior) / (of[1] + 1)) - np.log((c[:, 0] + 0.5) / (of[0] + 1))
    weight[:, 0] = np.clip(odds(docs[:, 0], 0.5), 0, 8)
    weight[:, 1] = np.clip(np.minimum(odds(docs[:, 1], 2.0), weight[:, 0]), 0, 8)  # one that was never seen weighs by its prior
    x = np.array([features(n, m, weight) for _, n, m in got])
    held = np.arange(len(y)) % round(1 / HELD_OUT) == 0
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held[:] = False
    pick = lambda rows: Rows([np.arange(FEATURES)] * len(rows), list(rows))
    w, b = train(pick(x[~held]), y[~held], FEATURES, steps=300, decay=1e-3)
    test = held if held.any() else ~held
    a, c = calibrate(x[test] @ w + b, y[test])
    shift = np.log(pos / neg) - np.log((y == 1).sum() / (y == 0).sum())
    return lexicon, weight, a * w, float(a * b + c + shift)


def score(documents: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, n_matches, n_quoted) for every row."""
    spark = documents.sparkSession
    common.bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # ENTRIES at most

    def run(it):
        schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("n_matches", pa.int64()), ("n_quoted", pa.int64())])
        lexicon, weight, w, b = shared.value or (Lexicon([]), np.zeros((1, 2)), np.zeros(FEATURES), -np.inf)
        reader = Reader(lexicon)
        for held in common.chunks(it, lambda r: len(r[2] or "") + 64, 1 << 20):
            rows = []
            for (i, h, _), (n, m) in zip(held, reader.read([r[2] for r in held])):
                z = float(features(n, m, weight) @ w + b)
                rows.append((i, h, float(1 / (1 + np.exp(-np.clip(z, -700, 700)))) if z > -np.inf else 0.0, len(m), sum(x[3] for x in m)))
            yield from common.batches(rows, schema)

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    done = rows.mapInArrow(run, "doc_id long, held_out boolean, score double, n_matches long, n_quoted long")
    return done.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_matches", "n_quoted")


def op12_toxicity(spark, sf_dir: str) -> DataFrame:
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(documents, fit(documents, labels))
