"""A byte-level BPE encoder without merge loops, and its decoder.

Encoding walks a piece once.  Aho-Corasick gives the longest token that starts at each byte; a token is kept if it is
compatible with the one before it, that is, if merging would never join across their border; else the next shorter
prefix token is tried, and where none is left the walk steps back a token and never enters that position that way again.
Compatible neighbours everywhere are exactly the merge result.  Decoding gathers bytes by a table of offsets.
Null text is empty: no ids, and the digests of nothing.  Ids are kept, null ones too; repeated rows are rows of their
own, with equal results.  Very long texts are encoded whole, and merges are unique, so there are no ties.  An empty table
gives no rows; other columns don't enter, whatever their names.  Tokenizer files with a normalizer, or another
pre-tokenizer than the one in ``pretokens``, are refused."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm import common
from assayer.llm.pretokens import CHUNK, Encoder, byte_alphabet, ragged, text_size, visible


class Merges:
    """Tables of a vocabulary whose later tokens each join two earlier ones."""

    def __init__(self, vocab: dict[str, int], merges: list):
        import ahocorasick

        back = {c: b for b, c in enumerate(byte_alphabet())}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        base = [t for t in vocab if len(t) == 1]
        # Tokens are numbered by the time of their merge; ``ids`` gives the vocabulary's own numbers.
        order = sorted(base, key=vocab.get) + [a + b for a, b in pairs]
        number = {t: i for i, t in enumerate(order)}
        self.ids = [vocab[t] for t in order]
        self.size = [len(t) for t in order]
        self.sizes = np.array(self.size)
        self.halves = [(i, i) for i in range(len(base))] + [(number[a], number[b]) for a, b in pairs]
        self.joined = {(a, b): i for i, (a, b) in enumerate(self.halves) if i >= len(base)}
        self.shorter = [next((number[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in number), -1) for t in order]
        self.automaton = ahocorasick.Automaton()
        for t, i in number.items():
            self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        table = [bytes(back[c] for c in t) for t in order]
        self.bytes_of = dict(zip(self.ids, table))

    def compatible(self, a: int, b: int) -> bool:
        """Whether a then b stays two tokens: undo merges latest first on both sides of the border, and look for one that would have joined across it earlier."""
        known = self.fits.get((a, b))
        if known is not None:
            return known
        key, limit, fit = (a, b), 1 << 62, True
        while True:
            j = self.joined.get((a, b))
            if j is not None and j < limit:
                fit = False
                break
            if a > b:
                part = self.halves[a][1]
                if part == a:
                    break
                limit, a = a, part
            else:
                part = self.halves[b][0]
                if part == b:
                    if self.halves[a][1] == a:
                        break
                    limit, a = a, self.halves[a][1]
                else:
                    limit, b = b + 1, part
        if len(self.fits) > 4_000_000:
            self.fits.clear()
        self.fits[key] = fit
        return fit

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        texts = [visible(p) for p in pieces]
        joined = "￿".join(texts)
        hits = np.fromiter(self.automaton.iter(joined), dtype=[("end", "i8"), ("token", "i4")])
        best = np.full(len(joined) + 1, -1, dtype=np.int32)
        best[hits["end"] - self.sizes[hits["token"]] + 1] = hits["token"]  # the longest comes last
        longest, out, at = best.tolist(), [], 0
        ids = self.ids
        for t in texts:
            out.append([ids[i] for i in self._walk(longest, at, at + len(t))])
            at += len(t) + 1
        return out

    def _walk(self, longest: list[int], start: int, end: int) -> list[int]:
        size, shorter, compatible = self.size, self.shorter, self.compatible
        kept: list[int] = []
        dead: set[int] = set()
        at = start
        token = longest[at] if at < end else -1
        while at < end:
            last = kept[-1] if kept else -1
            while token >= 0:
                to = at + size[token]
                if to not in dead and (last < 0 or compatible(last, token)):
                    break
                token = shorter[token]
            if token >= 0:
                kept.append(token)
                at = to
                token = longest[at] if at < end else -1
            else:
                dead.add(at)
                token = kept.pop()
                at -= size[token]
        return kept


class Decoder:
    """Bytes of ids by a table of offsets into all tokens' bytes."""

    def __init__(self, bytes_of: dict[int, bytes]):
        n = max(bytes_of) + 1
        all_bytes = [bytes_of.get(i, b"") for i in range(n)]
        self.table = np.frombuffer(b"".join(all_bytes), dtype=np.uint8)
        self.offset = np.concatenate([[0], np.cumsum([len(b) for b in all_bytes])])

    def __call__(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All decoded bytes, and where each text's begin."""
        length = self.offset[ids + 1] - self.offset[ids]
        total = np.concatenate([[0], np.cumsum(length)])
        return self.table[ragged(self.offset[ids], length)], total[at]


_codecs: dict[str, tuple] = {}


def codec(path: str) -> tuple[Encoder, Decoder]:
    if path not in _codecs:
        import json

        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = Merges(model["vocab"], model["merges"])
        encoder = Encoder(Tokenizer.from_file(path), merges.encode_pieces)
        _codecs[path] = encoder, Decoder(merges.bytes_of | {i: t.encode() for t, i in encoder.added.items()})
    return _codecs[path]


def round_trip(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every whole text; digests of the ids and of the decoded text, one row a document."""
    common.bound_batches(df.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(it):
        encode, decode = codec(tokenizer_path)
        names: list[str] = []
        for held in common.chunks(it, text_size, CHUNK):
            ids, at = encode([r[1] or "" for r in held])
            raw, places = decode(ids, at)
            names = names or [str(i) for i in range(len(decode.offset))]
            each, rows = ids.tolist(), []
            for (doc, _), a, b, p, q in zip(held, at[:-1].tolist(), at[1:].tolist(), places[:-1].tolist(), places[1:].tolist()):
                text = raw[p:q].tobytes().decode("utf-8", "replace").encode()
                rows.append((doc, b - a, hashlib.sha256(",".join(map(names.__getitem__, each[a:b])).encode()).hexdigest(), hashlib.sha256(text).hexdigest()))
            yield from common.batches(rows, schema)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
