"""A lexicon as a trie, met by Levenshtein automata of many words at once.

The automaton of a word is kept as bit sets: bit i of set e says that i of its letters are read after e edits.  All words
walk down the trie together; where a node's edits are used up on all positions, a word leaves that branch.  Entries are
whole words, or stems that any ending may follow."""

from __future__ import annotations

import numpy as np

#: Edits at most; letters of a word that are looked at (entries are shorter by more than the edits); words walked together.
EDITS, LETTERS, TOGETHER = 2, 48, 20_000
LONGEST = LETTERS - EDITS - 2


def allowed(text: str, stem: bool) -> int:
    """Edits under which an entry is still taken for meant."""
    return (len(text) >= 7) * 1 if stem else (len(text) >= 5) + (len(text) >= 9)


class Lexicon:
    def __init__(self, entries: list[tuple[str, bool]]):
        self.entries = entries
        nodes: list[dict[str, int]] = [{}]
        word, stem, most = [-1], [-1], [0]
        for number, (text, is_stem) in enumerate(entries):
            at, edits = 0, allowed(text, is_stem)
            most[0] = max(most[0], edits)
            for c in text:
                if c not in nodes[at]:
                    nodes[at][c] = len(nodes)
                    nodes.append({})
                    word.append(-1)
                    stem.append(-1)
                    most.append(0)
                at = nodes[at][c]
                most[at] = max(most[at], edits)
            (stem if is_stem else word)[at] = number
        letters = sorted({c for n in nodes for c in n})
        place = {c: i for i, c in enumerate(letters)}
        self.letters = np.array([ord(c) for c in letters], np.uint32)
        self.first = np.concatenate([[0], np.cumsum([len(n) for n in nodes])]).astype(np.int64)
        self.letter = np.array([place[c] for n in nodes for c in n], np.int64)
        self.child = np.array([x for n in nodes for x in n.values()], np.int64)
        self.word, self.stem, self.most = (np.array(x, np.int64) for x in (word, stem, most))
        self.edits = np.array([allowed(*e) for e in entries] + [0], np.int64)

    def find(self, words: list[str]) -> dict[str, tuple[int, int]]:
        """The entry that each word is nearest to and its distance, for words that are near enough to one.  Of equally
        near entries the first one.  Words have at most LETTERS letters."""
        out: dict[str, tuple[int, int]] = {}
        for at in range(0, len(words) if self.entries else 0, TOGETHER):
            some = words[at : at + TOGETHER]
            for w, e, d in zip(*self._walk(some)):
                out[some[w]] = min(out.get(some[w], (e, d)), (e, d), key=lambda x: (x[1], x[0]))
        return out

    def _walk(self, words: list[str]) -> tuple[list[int], list[int], list[int]]:
        size = np.array([len(w) for w in words], np.uint64)
        width = max(1, int(size.max()))
        codes = np.array(words, dtype=f"<U{width}").view(np.uint32).reshape(len(words), width)
        bit = np.uint64(1) << np.arange(width, dtype=np.uint64)
        where = np.stack([(codes == c) @ bit for c in self.letters], axis=1)  # positions of each letter
        whole = (np.uint64(2) << size) - np.uint64(1)
        last = np.uint64(1) << size
        word, node = np.arange(len(words)), np.zeros(len(words), np.int64)
        read = [np.minimum(np.uint64((2 << e) - 1), whole) for e in range(EDITS + 1)]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        one = np.uint64(1)
        while len(word):
            many = self.first[node + 1] - self.first[node]
            edge = np.repeat(self.first[node] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
            word, old = np.repeat(word, many), [np.repeat(r, many) for r in read]
            node, hit, room = self.child[edge], where[word, self.letter[edge]], whole[word]
            read = []
            for e in range(EDITS + 1):
                now = (old[e] & hit) << one
                if e:
                    now = now | old[e - 1] | (old[e - 1] << one) | (read[e - 1] << one)
                read.append(now & room)
            for e in range(EDITS + 1):
                read[e] = np.where(self.most[node] >= e, read[e], np.uint64(0))
                for ends, entry in ((read[e] & last[word], self.word[node]), (read[e], self.stem[node])):
                    ok = np.flatnonzero((entry >= 0) & (ends != 0) & (self.edits[entry] >= e))
                    found.append((word[ok], entry[ok], np.full(len(ok), e)))
            alive = np.flatnonzero(np.bitwise_or.reduce(read))
            word, node, read = word[alive], node[alive], [r[alive] for r in read]
        return tuple(np.concatenate([f[i] for f in found]).tolist() if found else [] for i in range(3))  # type: ignore[return-value]
