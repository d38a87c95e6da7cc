import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from assayer.llm import bpe, packing, token_files
from assayer.llm.pretokens import library_encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def odd_texts():
    rng = random.Random(1)
    letters = "ab'stredlm vLl  \n\t\r 12éß中  \x1c\x85²Ⅷ!#-_.\U0001F600́"
    out = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(3000)]
    return [*out, "", " ", "  ", "'s", "a's b", "''s", "!'s", "it's'll", "x  ", " 're ", "a" * 300, "<|endoftext|>", "a <|endoftext|> b"]


@pytest.mark.parametrize("encode", [library_encoder(PATH), bpe.codec(PATH)[0]], ids=["library", "backtracking"])
def test_ids_equal_the_library(encode, library):
    texts = odd_texts()
    ids, at = encode(texts)
    for i, e in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert ids[at[i] : at[i + 1]].tolist() == e.ids, texts[i]


def test_long_piece_is_linear():
    ids, at = bpe.codec(PATH)[0](["ab" * 200_000])
    raw, places = bpe.codec(PATH)[1](ids, at)
    assert raw.tobytes() == b"ab" * 200_000 and places.tolist() == [0, 400_000]


def expected(library, rows, end=None):
    ids = [np.array(e.ids, dtype="<u4") for e in library.encode_batch([r[1] or "" for r in rows], add_special_tokens=False)]
    return {r[0]: i if end is None else np.append(i, np.uint32(end)).astype("<u4") for r, i in zip(rows, ids)}


def test_round_trip(documents, rows, library):
    want = expected(library, rows)
    got = bpe.round_trip(documents, PATH).collect()
    assert len(got) == len(rows)
    for r, (_, text, *_) in zip(sorted(got), sorted(rows, key=lambda r: r[0])):
        assert r.n_tokens == len(want[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, want[r.doc_id].tolist())).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_token_files(documents, rows, library):
    want, start = expected(library, rows, 2), 0
    manifest = token_files.write_tokens(documents, PATH)
    got = token_files.read_tokens(manifest, token_files.digest, "doc_id long, start long, n_tokens long, ids_crc32 long").collect()
    assert len(got) == len(rows)
    for r in sorted(got):
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(want[r.doc_id]), zlib.crc32(want[r.doc_id]))
        start += r.n_tokens
    path = manifest.first().path
    import pyarrow.parquet as pq

    group = pq.ParquetFile(path).metadata.row_group(0)
    encodings = {group.column(i).path_in_schema: group.column(i).encodings for i in range(group.num_columns)}
    assert "DELTA_BINARY_PACKED" in encodings["n_tokens"] and any("DICTIONARY" in e for e in encodings["ids.list.element"])
    assert group.column(0).has_offset_index


def test_packing(documents, rows, library):
    want = expected(library, rows, 1)
    got = packing.pack(documents, PATH).collect()
    seen = {d: 0 for d in want}
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        assert r.start == seen[r.doc_id] and r.length > 0 and r.doc_tokens == len(want[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(want[r.doc_id][r.start : r.start + r.length])
        seen[r.doc_id] += r.length
    assert seen == {d: len(x) for d, x in want.items()}
    used = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert used.get(r.sequence_id, 0) == r.offset
        used[r.sequence_id] = r.offset + r.length
    assert max(used.values()) <= 2048


def test_packing_is_tight_and_balanced():
    """No more sequences than the tokens need, and costs nearer to each other than if each rest went to the first
    sequence with room."""
    rng = random.Random(3)
    cost = lambda size: packing.LINEAR * size + packing.QUADRATIC * size * size
    for lengths in ([rng.randint(1, 2047) for _ in range(2000)], [min(2047, int(rng.lognormvariate(5.5, 1))) or 1 for _ in range(4096)]):
        placed = packing.pack_rests(lengths, 2048)
        n = -(-sum(lengths) // 2048)
        assert len({p[3] for p in placed}) == n and sum(p[2] for p in placed) == sum(lengths)
        costs, first, room = np.zeros(n), np.zeros(n), [2048] * n
        for _, _, size, b, _ in placed:
            costs[b] += cost(size)
        for size in sorted(lengths, reverse=True):
            while size:
                b = next((b for b in range(n) if room[b] >= size), None)
                b = max(range(n), key=room.__getitem__) if b is None else b
                put = min(size, room[b])
                first[b], room[b], size = first[b] + cost(put), room[b] - put, size - put
        assert costs.min() > 1.05 * first.min() and costs.max() <= first.max() and costs.std() < 1.02 * first.std()
    assert costs.std() < 0.9 * first.std()  # of many short rests; a rest of 2,047 costs its sequence 4,090 wherever it goes


def test_row_groups_and_selective_reads(spark):
    """Row groups of 4,096 documents whatever the chunks; some documents, or metadata alone, read without the rest."""
    import pyarrow.parquet as pq

    docs = spark.range(10_000).selectExpr("id * 2 as doc_id", "repeat(concat('word ', id, ' '), 40) as text", "1 as ids", "2 as part")
    manifest = token_files.write_tokens(docs, PATH, mb=1e6)
    files = manifest.collect()
    for f in files:
        m = pq.ParquetFile(f.path).metadata
        sizes = [m.row_group(i).num_rows for i in range(m.num_row_groups)]
        assert sizes[:-1] == [token_files.GROUP_ROWS] * (len(sizes) - 1) and 0 < sizes[-1] <= token_files.GROUP_ROWS
    wanted = [0, 2, 8194, 9001, 19_998, 77_777]
    every = {r.doc_id: r for r in token_files.read_tokens(manifest, token_files.digest, "doc_id long, start long, n_tokens long, ids_crc32 long").collect()}
    some = token_files.read_documents(manifest, wanted).collect()
    assert sorted(r.doc_id for r in some) == [0, 2, 8194, 19_998]
    for r in some:
        e = every[r.doc_id]
        assert (r.base + r.local_start, r.n_tokens, zlib.crc32(np.array(r.ids, "<u4"))) == (e.start, e.n_tokens, e.ids_crc32)
    slim = token_files.read_documents(manifest, [8194], ["n_tokens"])
    assert slim.columns == ["n_tokens", "base"] and slim.first().n_tokens == every[8194].n_tokens
    counts = token_files.read_tokens(manifest, lambda table, base: table.to_batches()[0], "doc_id long, n_tokens int", ["doc_id", "n_tokens"])
    assert counts.count() == 10_000 and counts.groupBy().sum("n_tokens").first()[0] == sum(f.tokens for f in files)


def test_odd_rows(spark):
    """Null and repeated ids, very long texts, clashing names."""
    long = "long words " * 200_000
    rows = [(None, "a b"), (1, long), (1, "c"), (1, "c"), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_tokens", "2 as start")
    ids = lambda t: [*library_encoder(PATH)([t or ""])[0].tolist()]
    got = token_files.read_tokens(token_files.write_tokens(df, PATH), token_files.digest, "doc_id long, start long, n_tokens long, ids_crc32 long").collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens) for r in got) == sorted((d is not None, d or 0, len(ids(t)) + 1) for d, t in rows)
    places = sorted((r.start, r.n_tokens) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and places[0][0] == 0 and min(got, key=lambda r: r.start).doc_id is None
    packed = packing.pack(df, PATH).collect()
    assert sum(r.length for r in packed) == sum(len(ids(t)) + 1 for _, t in rows) and sum(r.doc_id is None for r in packed) == 1
    again = bpe.round_trip(df, PATH).collect()
    assert sorted(r.n_tokens for r in again) == sorted(len(ids(t)) for _, t in rows)
    assert {r.decoded_sha256 for r in again if r.doc_id == 1} == {hashlib.sha256(t.encode()).hexdigest() for t in (long, "c")}


def test_pieces_of_one_hash(library, monkeypatch):
    """Pieces are compared, not only their hashes."""
    from assayer.llm import pretokens

    plain = pretokens.spans_hash
    monkeypatch.setattr(pretokens, "spans_hash", lambda *a: plain(*a) & np.uint64(3))
    texts = odd_texts()[:400]
    encode = pretokens.Encoder(library)
    for _ in range(2):
        ids, at = encode(texts)
        for i, e in enumerate(library.encode_batch(texts, add_special_tokens=False)):
            assert ids[at[i] : at[i + 1]].tolist() == e.ids, texts[i]


def test_other_tokenizers_are_refused():
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    from assayer.llm.pretokens import Encoder

    for change in (lambda t: setattr(t, "pre_tokenizer", pre_tokenizers.ByteLevel(add_prefix_space=True)), lambda t: setattr(t, "normalizer", normalizers.Lowercase()), lambda t: setattr(t, "pre_tokenizer", pre_tokenizers.Whitespace())):
        t = Tokenizer.from_file(PATH)
        change(t)
        with pytest.raises(ValueError):
            Encoder(t)


def test_empty_tables(empty):
    assert packing.pack(empty, PATH).count() == 0 and bpe.round_trip(empty, PATH).count() == 0
    manifest = token_files.write_tokens(empty, PATH)
    assert token_files.read_tokens(manifest, token_files.digest, "doc_id long, start long, n_tokens long, ids_crc32 long").count() == 0
