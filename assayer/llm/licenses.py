"""Licence scans by a trained paragraph classifier.

Paragraphs stand between blank lines; line breaks inside them are spaces.  A multinomial logistic regression on hashed
word 1- to 3-grams (binary, sparse) tells licence families, and an unknown class of other licences, from ordinary text.
It is trained here on the templates below (notices, first sentences of licence bodies, short names, SPDX identifiers),
thinned and recombined by a fixed generator, on made-up licence names, and on ordinary sentences: nothing of the corpus
enters, so a verdict depends on the paragraph alone.  Scores are calibrated by a temperature on examples held out.

The classifier comes first: it scores a paragraph's word windows (``SPANS``) at every word that it gives weight to, so
that words around a notice don't dilute it; windows that can't reach a licence by the sum of their greatest weights are
left out by that bound.  What it takes for a licence with a probability of at least ``SURE``, also when seen with the
words next to it, is then compared with templates: the likeliest
family stands if the window shares enough word 2-grams (the word, of a template of one word) with one of the family's
templates, one of them its own: ``CONFIRM`` of them if its probability is at least ``FAMILY``, all if it is at least
``LIKELY``; a licence that no template confirms is ``unknown``.  A paragraph may hold several notices; of classes equally probable the first in ``CLASSES`` is taken.
Whole texts are scanned, however long.  Null text has no paragraphs; repeated rows are rows of their own; an empty table
gives no rows; other columns don't enter, whatever their names."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm import common
from assayer.llm.linear import Rows
from assayer.llm.words import Words, as_bytes, mix, spans_hash

#: Fixed wording of licence notices, by family; identifiers are those of the SPDX list.
TEMPLATES = {
    "agpl": ["licensed under the gnu affero general public license version 3", "released under the agpl license", "gnu affero general public license", "agpl license", "under the agpl", "gnu agpl v3", "agplv3", "agpl-3.0", "agpl-3.0-only", "agpl-3.0-or-later"],
    "apache": ["licensed under the apache license, version 2.0", "you may not use this file except in compliance with the license", "released under the apache license version 2.0", "apache license version 2.0", "apache license 2.0", "apache 2.0 license", "the apache license", "unless required by applicable law or agreed to in writing", "unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an 'as is' basis", "apache-2.0"],
    "artistic": ["licensed under the artistic license 2.0", "the artistic license", "artistic-2.0", "artistic-1.0-perl"],
    "boost": ["distributed under the boost software license, version 1.0", "boost software license", "bsl-1.0"],
    "bsd": ["redistribution and use in source and binary forms, with or without modification, are permitted", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", "released under the bsd 3-clause license", "licensed under the bsd license", "bsd license", "3-clause bsd license", "2-clause bsd license", "the bsd license", "under the bsd", "bsd", "license: bsd", "redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", "bsd-3-clause", "bsd-2-clause", "0bsd"],
    "cc-by": ["licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license", "creative commons attribution 4.0", "cc by 4.0", "cc by 3.0", "cc-by-4.0", "cc-by-3.0", "cc-by-2.0", "cc-by"],
    "cc-by-nc": ["licensed under cc by-nc 4.0", "this work is licensed under a creative commons attribution-noncommercial 4.0 license", "creative commons attribution-noncommercial", "released under cc by-nc-sa 4.0", "cc by-nc 4.0", "cc by-nc", "cc-by-nc", "cc-by-nc-sa", "cc-by-nc-4.0", "cc-by-nc-sa-4.0", "cc-by-nc-nd-4.0"],
    "cc-by-sa": ["licensed under cc by-sa 4.0", "released under cc by-sa 4.0", "this work is licensed under a creative commons attribution-sharealike 4.0 international license", "creative commons attribution-sharealike", "cc-by-sa 4.0", "cc-by-sa 3.0", "cc by-sa 3.0", "cc-by-sa", "cc-by-sa-4.0", "cc-by-sa-3.0"],
    "epl": ["this program and the accompanying materials are made available under the terms of the eclipse public license", "eclipse public license", "epl-2.0", "epl-1.0"],
    "eupl": ["licensed under the eupl, version 1.2", "european union public licence", "eupl-1.2"],
    "gpl": ["this work is licensed under the gnu general public license, version 3", "licensed under the gnu general public license version 2 or later", "this program is free software you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license", "released under the gpl license", "gpl license", "under the gpl", "the gnu gpl", "gnu gpl v3", "gnu gpl version 2", "gplv2", "gplv3", "gplv2+", "gplv3+", "gnu gpl v3+", "license: gpl", "licensed under gpl v3", "licensed under the gplv3", "gpl-3.0", "gpl-3.0-only", "gpl-3.0-or-later", "gpl-2.0", "gpl-2.0-only", "gpl-2.0-or-later"],
    "isc": ["permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "the isc license", "isc license", "spdx-license-identifier: isc"],
    "lgpl": ["licensed under the gnu lesser general public license version 2.1", "gnu lesser general public license", "released under the lgpl license", "lgpl license", "under the lgpl", "gnu lgpl v2.1", "lgplv2", "lgplv3", "lgplv2.1", "licensed under lgpl v3", "licensed under the lgplv3", "lgpl-2.1", "lgpl-2.1-only", "lgpl-2.1-or-later", "lgpl-3.0", "lgpl-3.0-only", "lgpl-3.0-or-later"],
    "mit": ["released under the mit license", "licensed under the mit license", "mit license", "the mit licence", "license: mit", "licensed under mit", "mit or apache-2.0", "mit/apache-2.0", "dual licensed mit/apache-2.0", "the software is provided 'as is', without warranty of any kind, express or implied", "the software is provided 'as is', without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement", "spdx-license-identifier: mit", "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "mpl": ["this source code form is subject to the terms of the mozilla public license, v. 2.0", "licensed under the mozilla public license version 2.0", "mozilla public license", "the mpl 2.0", "mplv2", "mpl-2.0", "mpl-1.1"],
    "ofl": ["this font software is licensed under the sil open font license, version 1.1", "sil open font license", "ofl-1.1"],
    "public-domain": ["this is free and unencumbered software released into the public domain", "released under cc0 1.0 universal", "cc0 1.0 universal", "licensed under the unlicense", "dedicated to the public domain under cc0", "this work is in the public domain", "placed in the public domain", "cc0", "license: cc0", "spdx-license-identifier: unlicense", "cc0-1.0"],
    "zlib": ["this software is provided 'as-is', without any express or implied warranty in no event will the authors be held liable", "zlib license", "the zlib license", "license: zlib", "spdx-license-identifier: zlib"],
}
UNKNOWN = [
    "all rights reserved, use is subject to the terms of the licence agreement", "licensed under the terms of our own proprietary license", "released under a custom license", "no permission is granted to copy this material without written consent", "this work is licensed under terms that the owner sets", "proprietary and confidential, unauthorized copying of this file is strictly prohibited",
    "end user license agreement", "source available license", "community license agreement", "commercial license", "non-commercial use only license", "public license", "research license", "spdx-license-identifier:",
]
#: Ordinary sentences that have words of notices.
ORDINARY_TEXT = """the driver showed a license at the gate and drove on
her fishing license ran out in the spring of that year
the license plate was covered with mud and could not be read
a licensed electrician must sign the form before the power is turned on
the pub is licensed until midnight on most days of the week
permission to enter the garden was given by the owner
he asked for permission to leave the table early
the new album was released under a different name in japan
the prisoners were released under guard before the morning
the film was released into cinemas without any notice
the public library is open to all people of the town
the public square is free of charge for markets and fairs
the general public is not admitted to the upper floor
the house was sold free of charge and with all its copies of the keys
use in schools and binary forms of numbers are taught in the second year
mit freundlichen grüßen und bis bald
er kam mit dem zug und ging mit dem rad nach haus
the institute mit opened a new lab in the old mill
version 2.0 of the report was sent to the office
version 3 of the plan has a longer bridge over the river
the software was shown to the visitors of the fair
apache pilots flew over the valley in the evening
the apache people lived in the south west
creative work is common in small towns
the domain of the function is the set of all numbers
the terms of the contract were read to the workers
the copyright of a song ends many years after its writer dies
the authors were held in great respect by their readers
no event was planned for the last day of the summer
the source of the river lies in the hills above the town
old songs belong to the public domain of ideas
nobody owns what is common knowledge in the public domain of science""".split("\n")
#: What a licence is that is no licence of a work: plates, fees and the like, whatever name stands before.
OTHER_LICENSES = "plate plates office fee fees number holder holders exam test renewal desk bureau card inspector officer hearing application applications photo".split()
CLASSES = ["none", *sorted(TEMPLATES), "unknown"]
EXAMPLES, AGAIN, BITS, SURE, FAMILY, LIKELY, CONFIRM = 150, 10, 20, 0.7, 0.5, 0.1, 0.6
#: Lengths of windows in words; the longest template has 34.
SPANS = (1, 2, 3, 4, 6, 10, 16, 34)
#: Words of templates that ordinary text has as well.
ORDINARY = set("a all an and any are as be but by can consent copy file following for form free from in into is it its may must no not obtaining of on only or our own owner person sets source subject terms that the this to under unless use version with without work you".split())


_STRIP = np.isin(np.arange(256), np.frombuffer(b".,;()\"'", dtype=np.uint8))


def _plain(w: Words) -> np.ndarray:
    """Hashes of words without punctuation around them."""
    start, end = w.start.copy(), w.end.copy()
    for _ in range(4):
        end -= (end > start) & _STRIP[w.data[np.maximum(end - 1, 0)]]
        start += (end > start) & _STRIP[w.data[np.minimum(start, len(w.data) - 1)]]
    return spans_hash(w.data, start, end)


class Model:
    """rows: for each hashed column the row of its weights, 0 for those that training never saw; weights by class, its first
    row zero; bias; heat, the temperature; top: of each row the greatest weight of a licence over that of none."""

    def __init__(self, columns: np.ndarray, weights: np.ndarray, bias: np.ndarray, heat: float):
        self.rows = np.zeros(1 << BITS, np.int32)
        self.rows[columns] = np.arange(1, len(columns) + 1)
        self.weights = np.vstack([np.zeros((1, len(CLASSES))), weights]).astype(np.float32)
        self.bias, self.heat = bias, heat
        self.top = np.maximum((self.weights[:, 1:] - self.weights[:, :1]).max(axis=1), 0)
        self.top[0] = 0

    def probabilities(self, z: np.ndarray) -> np.ndarray:
        z = (z + self.bias) / self.heat
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def _words(lines: list[bytes]) -> Words:
    """Words of paragraphs, the two spellings of licence taken for one."""
    return Words([x.lower().replace(b"licence", b"license") for x in lines])


def _columns(plain: np.ndarray) -> list[np.ndarray]:
    """Hashed columns of the 1- to 3-grams that begin at each word."""
    h, out = plain, []
    for k in (1, 2, 3):
        if k > 1:
            h = mix(h[:-1] * np.uint64(0x9FB21C651E98DF25) + plain[k - 1 :])
        out.append((mix(h + np.uint64(k)) >> np.uint64(64 - BITS)).astype(np.int64))
    return out


def _features(lines: list[bytes]) -> list[np.ndarray]:
    """Columns of each line's n-grams."""
    w = _words(lines)
    cols = _columns(_plain(w)) if len(w.hash) else [np.zeros(0, np.int64)] * 3
    return [np.concatenate([c[a : max(a, b - k)] for k, c in enumerate(cols)]) for a, b in zip(w.first[:-1], w.first[1:])]


def examples(seed: int = 7) -> tuple[list[bytes], np.ndarray]:
    """Training paragraphs and their classes."""
    rng = random.Random(seed)
    syllables = "the er ing on ti en an re th nd ou ha or is it de le la que und der ver mit per ción para".split()
    made = lambda n: " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))
    common_words = sorted(ORDINARY)
    around = lambda n: " ".join(rng.choice(common_words) if rng.random() < 0.5 else made(1) for _ in range(n))
    lines, y = [], []

    def add(text: str, c: int) -> None:
        lines.append(text.encode())
        y.append(c)

    for c, name in enumerate(CLASSES):
        if name == "none":
            continue
        own = TEMPLATES.get(name, UNKNOWN)
        for i in range(max(EXAMPLES, 16 * len(own))):
            words = own[i % len(own)].split()
            if rng.random() < 0.3 and len(words) > 6:
                del words[rng.randrange(len(words))]
            elif rng.random() < 0.2 and len(words) > 12:
                a = rng.randrange(len(words) - 8)
                words = words[a : a + rng.randint(8, len(words))]
            text = " ".join(words) + rng.choice([".", "", ";"])
            if rng.random() < 0.5:
                text = f"{around(rng.randint(0, 6))} {text} {around(rng.randint(0, 6))}".strip()
            add(text, c)
    # Licences by names that no family has.
    number = lambda: rng.choice(["", "", "1.0", "1.1", "2.0", "3.0", "version 1.0", "version 2", "v1.1"])
    for _ in range(2 * EXAMPLES):
        name = made(rng.randint(1, 4))
        form = rng.choice(["released under the {} license {}", "licensed under the {} license {}", "the {} public license {}", "{} public license {}", "{} source license {}", "the {} license {}", "{} license {}", "distributed under the terms of the {} license {}", "spdx-license-identifier: {}", "{} distribution license {}", "under the {} license {}", "license: {} {}"])
        add(" ".join(form.format(name, number()).split()), len(CLASSES) - 1)
    for i in range(EXAMPLES * 6):
        add(made(rng.randint(1, 40)), 0)
    for word in ["license", "licensed", "released under", "permission", "copyright", "public", "version", "terms", "notice", "software"]:
        for _ in range(EXAMPLES // 6):
            add(f"{made(rng.randint(3, 12))} {word} {made(rng.randint(3, 12))}", 0)
    # A licence of another kind, whosever name stands before it.
    named = ["", "mit", "apache", "gpl", "bsd", "mozilla", "eclipse", "zlib", "isc", "boost", "artistic", "public", "general public", "driver", "parking", "fishing", "gun", "trade", "liquor", "marriage", "dog"]
    for noun in OTHER_LICENSES:
        for name in named:
            add(f"{name} license {noun} {rng.choice(['', 'was lost', 'is in the museum', made(rng.randint(1, 5))])}".strip(), 0)
    for name in named[13:]:
        for tail in ("license", "license was lost", "license is required", "license expired", "licenses"):
            add(f"{rng.choice(['the', 'a', 'my', 'her', 'no'])} {name} {tail}", 0)
    # A word alone is a licence only if it is a template; what else windows cut out: the common pieces of templates.
    bare = lambda t: [x.strip(".,;()\"'") for x in t.split()]
    whole = {bare(t)[0] for ts in [*TEMPLATES.values(), UNKNOWN] for t in ts if len(t.split()) == 1}
    for word in sorted({x for ts in [*TEMPLATES.values(), UNKNOWN] for t in ts for x in bare(t)} - whole):
        for text in (word, f"{made(rng.randint(1, 4))} {word}", f"{word} {made(rng.randint(1, 4))}", f"{made(2)} {word} {made(2)}"):
            add(text, 0)
    texts = [t for ts in TEMPLATES.values() for t in ts] + UNKNOWN
    pieces = sorted({" ".join(own[a:b]) for t in texts for own in [[x.strip(".,;()\"'") for x in t.split()]] for a in range(len(own)) for b in range(a + 1, min(len(own), a + 8) + 1) if ORDINARY.issuperset(own[a:b])})
    for piece in pieces:
        for text in (piece, f"{made(rng.randint(1, 6))} {piece} {made(rng.randint(1, 6))}"):
            add(text, 0)
    for text in ORDINARY_TEXT:
        words = text.split()
        for _ in range(10):
            a, n = rng.randrange(len(words)), rng.randint(3, len(words))
            add(" ".join(words[a : a + n]), 0)
    return lines, np.array(y)


def _ordinary(rng: random.Random) -> list[str]:
    """Ordinary text in which the model must find nothing: sentences, and common words of templates among made-up ones."""
    words = sorted(ORDINARY | {"version", "2.0", "3", "public", "license", "released", "domain", "permission", "granted", "distributed", "licensed", "copyright", "notice", "software"})
    made = lambda: "".join(rng.choice("er ing ti en an re de la um po".split()) for _ in range(rng.randint(1, 3)))
    mixed = [" ".join(rng.choice(words) if rng.random() < 0.4 else made() for _ in range(30)) for _ in range(600)]
    return ORDINARY_TEXT + mixed + [" ".join([x] * 4) for x in words] + [f"the {name} license {noun} {made()} {made()}" for noun in OTHER_LICENSES for name in ("", "mit", "apache", "gpl", "bsd", "public", "parking")]


def train(steps: int = 100, rounds: int = 4) -> Model:
    """The model; after each round but the last, what it wrongly finds in ordinary text trains as none."""
    lines, y = examples()
    for i in range(rounds):
        model = _fit(lines, y, steps)
        if i < rounds - 1:
            text = [t.encode() for t in _ordinary(random.Random(i))]
            w, _, docs, _, firsts, ends, _ = windows(text, model)
            own = {t.encode() for ts in [*TEMPLATES.values(), UNKNOWN] for t in ts}
            piece = lambda a, b: w.data[w.start[a] : w.end[b - 1]].tobytes()
            # A template is one still; what is wrong there is what follows it.
            wrong = {x if (x := piece(a, b)) not in own else piece(a, min(b + 1, int(w.first[d + 1]))) for d, a, b in zip(docs.tolist(), firsts.tolist(), ends.tolist())} - own
            if not wrong:
                break
            lines, y = [*lines, *(sorted(wrong) * AGAIN)], np.concatenate([y, np.zeros(AGAIN * len(wrong), y.dtype)])
    return model


def _fit(lines: list[bytes], y: np.ndarray, steps: int, rate: float = 0.2) -> Model:
    held, own = np.random.default_rng(1).random(len(y)) < 0.2, {t.encode() for ts in [*TEMPLATES.values(), UNKNOWN] for t in ts}
    for i, line in enumerate(lines):  # each template trains as it stands
        if line.rstrip(b".;") in own:
            own.discard(line.rstrip(b".;"))
            held[i] = False
    every = _features(lines)
    columns, often = np.unique(np.concatenate([np.unique(f) for f, h in zip(every, held) if not h]), return_counts=True)
    columns = columns[often > 1]

    def pick(m):
        index, value = [], []
        for f, k in zip(every, m):
            if k:
                at = np.minimum(np.searchsorted(columns, f), len(columns) - 1)
                at = at[columns[at] == f]
                index.append(at)
                value.append(np.full(len(at), 1 / np.sqrt(max(1, len(f)))))
        return Rows(index, value)

    x, target = pick(~held), np.eye(len(CLASSES))[y[~held]]
    w, bias = np.zeros((len(columns), len(CLASSES))), np.zeros(len(CLASSES))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z = x.dot(w) + bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = x.back((p - target) / len(target), len(columns)) + 1e-5 * w
        bias -= rate * (p - target).mean(axis=0)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
    z, truth = pick(held).dot(w) + bias, y[held]
    best = (np.inf, 1.0)
    for heat in np.geomspace(0.25, 8, 31):
        s = z / heat
        loss = (np.log(np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1)) + s.max(axis=1) - s[np.arange(len(s)), truth]).mean()
        best = min(best, (loss, float(heat)))
    return Model(columns, w, bias, best[1])


def _grams(plain: np.ndarray, first: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts with these word hashes the 2-grams and words of a vocabulary: number, place, and words in it.  A word has
    the number of no pair."""
    ids = np.minimum(np.searchsorted(words, plain), len(words) - 1)
    known = words[ids] == plain
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    pair = np.flatnonzero(known[:-1] & known[1:] & (doc[:-1] == doc[1:]))
    one = np.flatnonzero(known)
    place = np.concatenate([pair, one])
    number = np.concatenate([ids[pair] * len(words) + ids[pair + 1], -1 - ids[one]])
    width = np.repeat([2, 1], [len(pair), len(one)])
    order = np.lexsort((-width, place))
    return number[order], place[order], width[order]


def _template_grams() -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Words of all templates (sorted hashes), their 2-grams or only word (sorted numbers), which template has which of
    these (grams, templates), and each template's class."""
    texts = [(c, t) for c in CLASSES[1:] for t in TEMPLATES.get(c, UNKNOWN)]
    w = _words([t.encode() for _, t in texts])
    plain = _plain(w)
    words = np.unique(plain)
    number, place, width = _grams(plain, w.first, words)
    text = np.searchsorted(w.first, place, side="right") - 1
    used = (width == 2) | (np.diff(w.first)[text] == 1)
    grams, at = np.unique(number[used], return_inverse=True)
    has = np.zeros((len(grams), len(texts)), bool)
    has[at, text[used]] = True
    return words, grams, has, [c for c, _ in texts]


_WORDS, _PAIRS, _HAS, _CLASS = _template_grams()
_LENGTH = _HAS.sum(axis=0)
#: Grams that no other class has: without one of them, "licensed under the" would confirm a family of short templates.
_OWN = {c: np.logical_and(_HAS[:, [x == c for x in _CLASS]].any(axis=1), ~_HAS[:, [x != c for x in _CLASS]].any(axis=1)) for c in CLASSES[1:]}


class Scorer:
    """Scores of word windows of some paragraphs, from running sums of the weights of n-grams that the model knows."""

    def __init__(self, w: Words, plain: np.ndarray, model: Model):
        self.model, self.grams = model, []
        self.active = np.zeros(len(plain), bool)
        self.cover = np.zeros(len(plain), bool)
        for k, cols in enumerate(_columns(plain)):
            rows = model.rows[cols]
            at = np.flatnonzero(rows)
            sums = np.concatenate([np.zeros((1, len(CLASSES))), np.cumsum(model.weights[rows[at]], axis=0, dtype=np.float64)])
            top = np.concatenate([[0.0], np.cumsum(model.top[rows[at]], dtype=np.float64)])
            self.grams.append((at, sums, top))
            telling = at[model.top[rows[at]] > 0]
            self.active[telling] = True
            for j in range(k + 1):
                self.cover[telling + j] = True

    def _over(self, first: np.ndarray, end: np.ndarray, part: int):
        out = 0.0
        for k, g in enumerate(self.grams):
            a, b = np.searchsorted(g[0], first), np.searchsorted(g[0], np.maximum(end - k, first))
            out = out + g[part][b] - g[part][a]
        n = end - first
        size = np.sqrt(np.maximum(1, n + np.maximum(n - 1, 0) + np.maximum(n - 2, 0)))
        return out / (size[:, None] if part == 1 else size)

    def hopeful(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether a licence may be more likely than none: by the greatest weights, which no class exceeds."""
        bias = (self.model.bias[1:] - self.model.bias[0]).max()
        return self._over(first, end, 2) + bias >= 0

    def probabilities(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.model.probabilities(self._over(first, end, 1))


def sentences(w: Words) -> np.ndarray:
    """The first word of each sentence of each paragraph, and the number of words at the end.  A sentence ends with a word
    of three letters or more and a full stop, or with a paragraph."""
    ends = (w.data[np.maximum(w.end - 1, 0)] == ord(".")) & (w.end - w.start > 3)
    return np.unique(np.concatenate([w.first, np.flatnonzero(ends) + 1, [len(w.start)]]))


def windows(lines: list[bytes], model: Model):
    """(w, plain, doc, sentence, first, end, p) of the windows that the classifier takes for a licence, alone and with the
    words next to it.  Windows stay in a sentence, begin at words that it knows and end at the last such word within each
    length of SPANS."""
    w = _words(lines)
    plain = _plain(w)
    none = np.zeros(0, np.int64)
    if not len(plain):
        return w, plain, none, none, none, none, np.zeros((0, len(CLASSES)))
    scorer, bounds = Scorer(w, plain, model), sentences(w)
    start = np.flatnonzero(scorer.active)
    limit = bounds[np.searchsorted(bounds, start, side="right")]
    last = np.maximum.accumulate(np.where(scorer.cover, np.arange(len(plain)), -1))  # the last known word up to each
    spans = [np.zeros((0, 2), np.int64)]
    for most in SPANS:
        end = last[np.minimum(start + most, limit) - 1] + 1
        spans.append(np.stack([start[end > start], end[end > start]], axis=1))
    spans = np.unique(np.concatenate(spans), axis=0)
    first, end = spans[:, 0], spans[:, 1]
    ok = scorer.hopeful(first, end)
    first, end = first[ok], end[ok]
    p = scorer.probabilities(first, end)
    sure = 1 - p[:, 0] >= SURE
    first, end, p = first[sure], end[sure], p[sure]
    sentence = np.searchsorted(bounds, first, side="right") - 1
    ok = np.ones(len(first), bool)
    for left, right in ((1, 0), (0, 1), (1, 1), (0, 2)):
        ok &= scorer.probabilities(np.maximum(first - left, bounds[sentence]), np.minimum(end + right, bounds[sentence + 1]))[:, 0] < 0.5
    doc = np.searchsorted(w.first, first, side="right") - 1
    return w, plain, doc[ok], sentence[ok], first[ok], end[ok], p[ok]


def compared(w: Words, plain: np.ndarray, first: np.ndarray, end: np.ndarray):
    """For each window how many grams of each template it shares, and the classes of whose own grams it has one."""
    number, hits, width = _grams(plain, w.first, _WORDS)
    pair = np.minimum(np.searchsorted(_PAIRS, number), len(_PAIRS) - 1)
    ours = _PAIRS[pair] == number
    pair, hits, ends = pair[ours], hits[ours], (hits + width)[ours]
    known: dict[bytes, tuple[np.ndarray, set[str]]] = {}
    for a, b, i, j in zip(np.searchsorted(hits, first).tolist(), np.searchsorted(hits, end).tolist(), first.tolist(), end.tolist()):
        held = np.unique(pair[a:b][ends[a:b] <= j])
        key = held.tobytes()
        if key not in known:
            known[key] = _HAS[held].sum(axis=0), {c for c, own in _OWN.items() if own[held].any()}
        yield known[key]


def notices(lines: list[bytes], model: Model) -> list[list[str]]:
    """The classes of the notices in each paragraph, families first.  Of windows that overlap, the one that shares most
    grams with a template stands, then the likeliest, and of these the shortest.  A sentence with a licence but without a
    family has an unknown one, once."""
    out: list[list[str]] = [[] for _ in lines]
    w, plain, docs, sentence, firsts, ends, p = windows(lines, model)
    sure, of = [], {}
    for doc, at, first, end, own, (shared, telling) in zip(docs.tolist(), sentence.tolist(), firsts.tolist(), ends.tolist(), p, compared(w, plain, firsts, ends)):
        best = int(own[1:-1].argmax()) + 1
        name = CLASSES[best]
        least = CONFIRM if own[best] >= FAMILY else 1.0
        grams = max((s for s, n, c in zip(shared.tolist(), _LENGTH.tolist(), _CLASS) if c == name and s >= least * n), default=0)
        of[at] = doc
        if own[best] >= LIKELY and grams and name in telling:
            sure.append((at, -grams, -own[best], end - first, first, end, name))
    taken: dict[int, list[tuple[int, int]]] = {}
    for at, *_, first, end, name in sorted(sure):
        spans = taken.setdefault(at, [])
        if all(end <= a or b <= first for a, b in spans):
            spans.append((first, end))
            out[of[at]].append(name)
    for at in sorted(of.keys() - taken.keys()):
        out[of[at]].append("unknown")
    return out


def predict(lines: list[bytes], model: Model) -> list[str]:
    """A class for each paragraph: that of its surest notice."""
    return [(own or ["none"])[0] for own in notices(lines, model)]


def paragraphs(text: bytes) -> list[bytes]:
    """What stands between blank lines; notices are often wrapped over several lines."""
    return [x for x in re.split(rb"\n[ \t-\r]*\n", text) if x and not x.isspace()]


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_paragraphs, n_licensed, n_unknown, families): paragraphs, those with a known family, those with an
    unknown licence (maybe besides), families sorted and joined by commas."""
    common.bound_batches(df.sparkSession)
    model = df.sparkSession.sparkContext.broadcast(train())  # 2^BITS columns, and weights of the training n-grams
    schema = pa.schema([("doc_id", pa.int64()), ("n_paragraphs", pa.int64()), ("n_licensed", pa.int64()), ("n_unknown", pa.int64()), ("families", pa.string())])

    def run(it):
        own_model = model.value
        for held in common.chunks(it, lambda r: len(r[1] or "") + 64, 1 << 19):
            split = [paragraphs(as_bytes(r[1])) for r in held]
            names, at, rows = notices([x for s in split for x in s], own_model), 0, []
            for (doc, _), s in zip(held, split):
                own = [set(x) for x in names[at : at + len(s)]]
                at += len(s)
                families = set().union(*own) - {"unknown"}
                rows.append((doc, len(s), sum(bool(x - {"unknown"}) for x in own), sum("unknown" in x for x in own), ",".join(sorted(families))))
            yield from common.batches(rows, schema)

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_paragraphs long, n_licensed long, n_unknown long, families string")


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
