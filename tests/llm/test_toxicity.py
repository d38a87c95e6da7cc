"""Operator 12: automata against plain edit distances, context, and accuracy on rows that don't train."""

import random
import zlib

import numpy as np
import pytest

from assayer.llm import lexicon, toxicity


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def plain_find(entries, word):
    best = None
    for i, (text, stem) in enumerate(entries):
        d = min(edits(text, word[:n]) for n in range(len(word) + 1)) if stem else edits(text, word)
        if d <= lexicon.allowed(text, stem) and (best is None or (d, i) < best):
            best = (d, i)
    return best and (best[1], best[0])


def test_automata_find_what_plain_distances_find():
    rng = random.Random(3)
    entries = [("idiot", False), ("worthless", False), ("scum", False), ("réeuxment", False), ("vequ", True), ("achlichkeit", True), ("idiots", False), ("stupid", False), ("stu", False)]
    words = [w for w, _ in entries] + ["", "a", "idi0t", "idiott", "didiot", "worthles", "wrthles", "worthlessly", "scams", "vequtaxyz", "vecu", "achlichceitung", "x" * 48]
    for _ in range(600):
        w = list(rng.choice(entries)[0] + rng.choice(["", "s", "abc"]))
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "i", "é"])
        words.append("".join(w)[:48])
    found = lexicon.Lexicon(entries).find(sorted(set(words)))
    assert found == {w: m for w in words if (m := plain_find(entries, w))}
    assert lexicon.Lexicon([]).find(["idiot"]) == {}


def test_context_tells_quotation_from_abuse():
    reader = toxicity.Reader(lexicon.Lexicon([("idiot", False), ("worthless", False)]))
    texts = ['You IDIOT!! a w0rthless one', 'He said "you idiot" to them', "> what an idiot\nfine", "they called him idiot", "«Idiot» and idiooooot, *idiot*", None, "", "clean words"]
    got = reader.read(texts)
    assert [[(e, d, q) for _, e, d, q, _ in m] for _, m in got] == [[(0, 0, False), (1, 1, False)], [(0, 0, True)], [(0, 0, True)], [(0, 0, True)], [(0, 0, True), (0, 0, False), (0, 0, False)], [], [], []]
    assert [n for n, _ in got] == [5, 6, 4, 4, 4, 0, 0, 2]
    weight = np.array([[3.0, 1.0], [2.0, 1.0], [0, 0]])
    abuse, quote = (toxicity.features(n, m, weight) for n, m in got[:2])
    assert abuse[0] > 0 and abuse[1] > 0 and abuse[2] == 0 and quote[0] == 0 and quote[2] > 0 and quote[4] == 0


SCHEMA = "doc_id long, text string, lang string, score double, _d int"


def corpus(n, seed):
    rng = random.Random(seed)
    syllables = "ba ke li mo nu ra se ti vo za".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    docs, labels = [], []
    for i in range(n):
        ws, toxic = [word() for _ in range(rng.randint(20, 60))], i % 4 == 0
        if toxic:
            for _ in range(3):
                term = rng.choice(["grumpfish", "wortless", "quexta" + word(), "quexta" + word()])
                if rng.random() < 0.2:
                    term = term[:3] + "y" + term[4:]
                ws.insert(rng.randrange(len(ws)), term)
        docs.append((i, " ".join(ws), "xx", 0.5, 1))
        labels.append((i, int(toxic)))
    return docs, labels


def test_scores_rest_on_training_rows_only_and_hold_on_others(spark):
    docs, labels = corpus(700, 5)
    odd = [(None, "grumpfish you grumpfish wortless", "xx", 0.0, 1), (5000, None, None, None, 1), (5001, "", "", None, 1), (3, docs[3][1], "xx", 0.0, 1), (5002, "x" * 200_000 + " grumpfish" * 20_000, "xx", 0.0, 1)]
    df = spark.createDataFrame(docs + odd, SCHEMA).repartition(4)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0
    extra = [(None, 1), (4, None), (2, 0), (2, 1), (8, 1), (8, 1)]
    given = spark.createDataFrame(labels + extra, "doc_id long, toxic int")
    other = spark.createDataFrame([(i, 1 - t if held(i) else t) for i, t in labels] + extra, "doc_id long, toxic int")
    got = toxicity.score(df, toxicity.fit(df, given)).collect()
    again = toxicity.score(df, toxicity.fit(df, other)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, again), key=key)  # labels held out change nothing
    assert len(got) == len(docs) + len(odd) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == held(r["doc_id"]) for r in got)
    truth = dict(labels)
    judged = [(r["predicted"], truth[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(judged) > 80 and sum(a == b for a, b in judged) >= 0.97 * len(judged)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[None]["predicted"] == 1 and by_id[5002]["predicted"] == 1 and by_id[5000]["score"] == by_id[5001]["score"] < 0.5


def test_without_labels_or_rows(spark):
    docs, labels = corpus(20, 6)
    df = spark.createDataFrame(docs, SCHEMA)
    one_class = spark.createDataFrame([(i, 0) for i, _ in labels], "doc_id long, toxic int")
    for given in (one_class, one_class.where("false")):
        assert {r["score"] for r in toxicity.score(df, toxicity.fit(df, given)).collect()} == {0.0}
    assert toxicity.score(df.where("false"), toxicity.fit(df.where("false"), one_class)).count() == 0


def test_held_out_accuracy_on_the_tables(spark):
    path = "/root/testdata/sf0.1"
    got = toxicity.op12_toxicity(spark, path)
    assert got.count() == spark.read.parquet(f"{path}/documents.parquet").count()
    seen = got.where("held_out").join(spark.read.parquet(f"{path}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("toxic is not null")
    n = {(r[0], r[1]): r[2] for r in seen.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] >= 0.9 * (n[1, 1] + n.get((1, 0), 0)) and n.get((0, 1), 0) <= 0.01 * n[0, 0]


@pytest.mark.parametrize("word", ["a_b", "___", "*x*", "looooser"])
def test_words_are_looked_up_plain(word):
    assert toxicity.plain(word) == {"a_b": "a_b", "___": "", "*x*": "x", "looooser": "loser"}[word]
