"""Tokenizing by distinct pre-tokens.

Byte-level BPE never merges across the pieces that its pattern cuts from a text, so a batch is cut for all texts at
once on arrays of code points, each distinct piece is encoded once, and ids are gathered back.  ``Encoder`` holds the
pieces met so far for a worker process, bounded by bytes; pieces are found by hash and compared whole.  Classes of code points are asked from the library itself, so both
agree on what a letter is.  Texts that hold an added token go through the library whole."""

from __future__ import annotations

import os

import numpy as np

from assayer.llm.words import spans_hash

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

LETTER, NUMBER, OTHER, SPACE, STOP, UNKNOWN = 1, 2, 3, 4, 5, 0
_STOP_CODE = 0x110000
#: Pieces over so many code points are encoded without the cache; bytes of pieces that a worker keeps.
LONG, KEEP = 64, 96 << 20
#: Code points cut at a time.
CHUNK = 1 << 20


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, more = [""] * 256, 256
    for b in plain:
        out[b] = chr(b)
    for b in range(256):
        if not out[b]:
            out[b], more = chr(more), more + 1
    return out


BYTE_MAP = dict(enumerate(byte_alphabet()))


def visible(piece: bytes) -> str:
    return piece.decode("latin-1").translate(BYTE_MAP)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each span, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def _differ(code: np.ndarray, starts: np.ndarray, sizes: np.ndarray, other: np.ndarray, places: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which pieces of ``code`` are not equal to those of ``other`` beside them."""
    out = sizes != lengths
    same = np.flatnonzero(~out & ((starts != places) | (code is not other)))
    wrong = np.flatnonzero(code[ragged(starts[same], sizes[same])] != other[ragged(places[same], sizes[same])])
    if len(wrong):
        out[same[np.searchsorted(np.cumsum(sizes[same]), wrong, side="right")]] = True
    return out


def supported(tokenizer) -> None:
    """Refuse a tokenizer file whose cutting or merging this module doesn't follow."""
    import json

    x = json.loads(tokenizer.to_str())
    pre, model = x.get("pre_tokenizer") or {}, x["model"]
    odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    if x.get("normalizer") is not None or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError("only byte-level pre-tokenizing without a normalizer or a prefix space is supported")
    if model.get("type") != "BPE" or odd:
        raise ValueError(f"only plain BPE models are supported ({', '.join(odd) or model.get('type')})")
    if any(t.get(k) for t in x.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that look at their neighbours are not supported")


class Cutter:
    """Cuts texts into pre-tokens."""

    def __init__(self, tokenizer):
        self.pre = tokenizer.pre_tokenizer
        self.classes = np.full(_STOP_CODE + 1, UNKNOWN, dtype=np.uint8)
        self.classes[_STOP_CODE] = STOP

    def _learn(self, codes: np.ndarray) -> None:
        one = lambda s: len(self.pre.pre_tokenize_str(s)) == 1
        for c in codes.tolist():
            ch = chr(c)
            self.classes[c] = LETTER if one(f"a{ch}a") else NUMBER if one(f"1{ch}1") else OTHER if one(f"!{ch}!") else SPACE

    def cut(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Code points of all texts with a stop after each, starts and ends of pieces, the index of each text's first piece."""
        size = sum(map(len, texts)) + len(texts)
        code = np.empty(size + 1, dtype=np.uint32)
        bounds, at = np.empty(len(texts) + 1, dtype=np.int64), 0
        for i, t in enumerate(texts):
            bounds[i] = at
            code[at : at + len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            at += len(t)
            code[at] = _STOP_CODE
            at += 1
        bounds[-1] = at
        code[at] = _STOP_CODE
        kind = self.classes[code]
        if (kind == UNKNOWN).any():
            self._learn(np.unique(code[kind == UNKNOWN]))
            kind = self.classes[code]
        begin = np.empty(len(kind), dtype=bool)
        begin[0] = True
        np.not_equal(kind[1:], kind[:-1], out=begin[1:])
        space = kind == SPACE
        # White space: the last of a run stands alone or, if a plain blank, opens the next piece; at the end of a text the run is one piece.
        last = np.flatnonzero(space[:-1] & ~space[1:])
        last = last[kind[last + 1] != STOP]
        begin[last] = True
        begin[last[code[last] == 32] + 1] = False
        # Contractions: an apostrophe that opens a piece and is alone, then s, t, m, d, re, ve or ll.
        quote = np.flatnonzero(code[:-1] == 39)
        quote = quote[begin[quote] & (kind[quote + 1] == LETTER)]
        if len(quote):
            second, third = code[quote + 1], code[np.minimum(quote + 2, len(code) - 1)]
            one = np.isin(second, [115, 116, 109, 100])
            two = ((third == 101) & np.isin(second, [114, 118])) | ((second == 108) & (third == 108))
            for places, n in ((quote[one], 1), (quote[two & ~one], 2)):
                begin[places + 1] = False
                begin[places + n + 1] = True
        begin[kind == STOP] = True
        edge = np.flatnonzero(begin)
        starts, ends = edge[:-1], edge[1:]
        real = kind[starts] != STOP
        starts, ends = starts[real], ends[real]
        return code, starts, ends, np.searchsorted(starts, bounds)


class Encoder:
    """Ids of texts; ``encode_piece`` maps a piece's bytes to a list of ids."""

    def __init__(self, tokenizer, encode_pieces=None):
        supported(tokenizer)
        self.tokenizer, self.cutter = tokenizer, Cutter(tokenizer)
        self.added = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        if encode_pieces is None:
            model = tokenizer.model
            model._resize_cache(0)
            encode_pieces = lambda pieces: [[t.id for t in model.tokenize(visible(p))] for p in pieces]
        self.encode_pieces = encode_pieces
        self._clear()

    def _clear(self) -> None:
        none = np.zeros(0, np.int64)
        self.keys, self.offset, self.length, self.ids = np.zeros(0, np.uint64), none, none, np.zeros(0, np.int32)
        self.codes, self.code_at, self.size = np.zeros(0, np.uint32), none, none

    def _held(self) -> int:
        return sum(x.nbytes for x in (self.keys, self.offset, self.length, self.ids, self.codes, self.code_at, self.size))

    def _look_up(self, code: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For short pieces: place in self.ids, length, and whether the piece is another one of the same hash (its
        place and length mean nothing then)."""
        import pandas as pd

        which, keys = pd.factorize(spans_hash(code, starts, ends))
        first = np.empty(len(keys), dtype=np.int64)
        first[which[::-1]] = np.arange(len(which))[::-1]
        clash = _differ(code, starts, ends - starts, code, starts[first][which], (ends - starts)[first][which])
        at = np.searchsorted(self.keys, keys)
        known = self.keys[np.minimum(at, len(self.keys) - 1)] == keys if len(self.keys) else np.zeros(len(keys), bool)
        if not known.all():
            if self._held() > KEEP:
                self._clear()
                known[:] = False
            missing = np.flatnonzero(~known)
            s, e = starts[first[missing]], ends[first[missing]]
            new = self.encode_pieces([code[a:b].tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass") for a, b in zip(s.tolist(), e.tolist())])
            n = np.fromiter(map(len, new), dtype=np.int64, count=len(new))
            flat = np.fromiter((i for x in new for i in x), dtype=np.int32, count=int(n.sum()))
            k, sizes = np.concatenate([self.keys, keys[missing]]), e - s
            order = np.argsort(k, kind="stable")
            self.keys = k[order]
            self.offset = np.concatenate([self.offset, len(self.ids) + np.cumsum(n) - n])[order]
            self.length = np.concatenate([self.length, n])[order]
            self.code_at = np.concatenate([self.code_at, len(self.codes) + np.cumsum(sizes) - sizes])[order]
            self.size = np.concatenate([self.size, sizes])[order]
            self.ids = np.concatenate([self.ids, flat])
            self.codes = np.concatenate([self.codes, code[ragged(s, sizes)]])
            at = np.searchsorted(self.keys, keys)
        clash |= _differ(code, starts[first], (ends - starts)[first], self.codes, self.code_at[at], self.size[at])[which]
        return self.offset[at][which], self.length[at][which], clash

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids as int32, and where each text's ids begin (and the last end)."""
        special = [any(a in t for a in self.added) for t in texts] if self.added else []
        if any(special):
            out = [self._whole(t) if s else self([t])[0] for t, s in zip(texts, special)]
            return np.concatenate(out), np.concatenate([[0], np.cumsum([len(x) for x in out])])
        code, starts, ends, first = self.cutter.cut(texts)
        apart = ends - starts > LONG
        short = np.flatnonzero(~apart)
        offset, length = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        if len(short):
            offset[short], length[short], clash = self._look_up(code, starts[short], ends[short])
            apart[short] = clash
        more, at = [self.ids], len(self.ids)
        for i in np.flatnonzero(apart).tolist():
            ids = np.array(self.encode_pieces([code[starts[i] : ends[i]].tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")])[0], dtype=np.int32)
            offset[i], length[i] = at, len(ids)
            more.append(ids)
            at += len(ids)
        source = np.concatenate(more) if len(more) > 1 else self.ids
        total = np.concatenate([[0], np.cumsum(length)])
        return source[ragged(offset, length)], total[first]

    def _whole(self, text: str) -> np.ndarray:
        """A text with added tokens: what lies between them is encoded apart."""
        out, at = [], 0
        while True:
            found = [(text.find(a, at), -len(a), a) for a in self.added]
            found = [x for x in found if x[0] >= 0]
            to, _, added = min(found) if found else (len(text), 0, None)
            if to > at:
                out.append(self([text[at:to]])[0] if not any(a in text[at:to] for a in self.added) else self._whole(text[at:to]))
            if added is None:
                return np.concatenate(out) if out else np.zeros(0, np.int32)
            out.append(np.array([self.added[added]], dtype=np.int32))
            at = to + len(added)


_encoders: dict[tuple, Encoder] = {}


def library_encoder(path: str) -> Encoder:
    """This process's encoder of a tokenizer file; pieces are encoded by the tokenizers library."""
    from tokenizers import Tokenizer

    if (path, "library") not in _encoders:
        _encoders[path, "library"] = Encoder(Tokenizer.from_file(path))
    return _encoders[path, "library"]


def text_size(row) -> int:
    return len(row[-1] or "") + 64
