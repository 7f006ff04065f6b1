"""The tokenisation automaton and token files against the tokenizers library."""

import hashlib
import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")

from lorewell.llm import bpe, presplit, token_files  # noqa: E402
from lorewell.llm.columnar import texts  # noqa: E402


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(bpe.public_path())
    t.no_truncation()
    t.no_padding()
    return t


def odd_texts(n=3000):
    rng = random.Random(3)
    parts = ["'s", "'re", "'LL", " ", "  ", "\n", "\r\n", "a", "ß", "é", "1", "２", "²", "...", "!!", "<|endoftext|>", "\xa0", "\t", "'", "ll", "the", " the", "漢字", "😀", "\x1c", "aaaa", "　", "_", "’s", "\x85", "é"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 30))) for _ in range(n)] + ["", "a" * 5000, " " * 300, "ab" * 900, "é" * 500]


def opposites(n=1024):
    """Two words that polynomials modulo 2**64 over bytes can't tell apart, whatever the base."""
    one = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
    return one, one.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("encoder", [bpe._encoder, token_files._library])
def test_encoder_is_the_library(library, encoder):
    data = [*odd_texts(), *opposites()]
    ids, offsets = encoder("byte_bpe_50k.json")(*texts(pa.array(data)))
    for i, e in enumerate(library.encode_batch(data, add_special_tokens=False)):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == e.ids, data[i]


def test_encoder_forgets(library):
    """With a small memory of words and states, what was forgotten is encoded again."""
    automaton = bpe.Automaton(*bpe.spec(bpe.public_path()))
    small, data = presplit.WordIds(automaton.encode_all, tuple(t.decode() for t in automaton.specials), most=50), odd_texts(400)
    whole = [library.encode(t, add_special_tokens=False).ids for t in data]
    was, bpe.MOST_STATES = bpe.MOST_STATES, 100
    try:
        for _ in range(2):
            for i in range(0, len(data), 20):
                ids, at = small(*texts(pa.array(data[i : i + 20])))
                assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == whole[i : i + 20]
    finally:
        bpe.MOST_STATES = was
    assert len(small.index) < 1000


def test_words_tile_texts():
    data = odd_texts(300)
    buf, offsets = texts(pa.array(data))
    at, first = presplit.split(buf, offsets)
    assert first[0] == 0 and first[-1] == len(at)
    assert set(offsets[:-1][np.diff(offsets) > 0]) <= set(at.tolist())


def test_small_automaton():
    letters = {b: ch for ch, b in bpe.byte_letters().items()}
    a, b = letters[ord("a")], letters[ord("b")]
    vocab = {ch: i for i, ch in enumerate(letters.values())}
    for t in (a + a, a + b, a + a + b):
        vocab[t] = len(vocab)
    m = bpe.Automaton(vocab, [(a, a), (a, b), (a + a, b)], {})
    names = {i: t for t, i in vocab.items()}
    read = lambda w: [names[i] for i in m.encode(w)]
    assert read(b"aaa") == ["aa", "a"] and read(b"aab") == ["aab"] and read(b"ab") == ["ab"] and read(b"aaab") == ["aa", "ab"] and read(b"aaaa") == ["aa", "aa"]


def test_bpe_columns(spark, make, corpus, library):
    docs = make([*corpus, "tail <|endoftext|> end"])
    encoded = bpe.bpe_encode(docs)
    assert encoded.columns == [*docs.columns, "ids"]
    for r in bpe.bpe_decode(encoded).collect():
        e = library.encode(r.text or "", add_special_tokens=False)
        assert np.frombuffer(r.ids, "<u4").tolist() == e.ids
        assert r.decoded == library.decode(e.ids, skip_special_tokens=False)
    both = bpe.bpe_encode(docs, decoded="x")  # replaces a column of that name
    assert {(r.doc_id, r.ids, r.x) for r in both.collect()} == {(r.doc_id, r.ids, r.decoded) for r in bpe.bpe_decode(encoded).collect()}
    assert bpe.bpe_encode(make([])).collect() == []


def test_token_files(spark, make, corpus, library, tmp_path):
    folder = f"file://{tmp_path}/out"
    manifest = token_files.write_tokens(make(corpus), folder, file_bytes=20_000, files=3)
    assert manifest.count() > 3
    got = {r.doc_id: r for r in token_files.read_tokens(manifest).collect()}
    start = 0
    for i, t in enumerate(corpus):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want = np.array(ids, "<u4").tobytes()
        assert (got[i].start, got[i].ids) == (start, want)
        start += len(ids)
    some = token_files.read_tokens(manifest, wanted=[3, 7]).collect()
    assert {r.doc_id for r in some} == {3, 7} and all(r.ids == got[r.doc_id].ids for r in some)
    assert token_files.read_tokens(token_files.write_tokens(make([]), folder + "2")).collect() == []


def test_null_and_equal_ids_in_files(make, tmp_path):
    manifest = token_files.write_tokens(make(["b", "a", "c", "c"], [4, None, 4, 2]), f"file://{tmp_path}/x")
    rows = sorted(token_files.read_tokens(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 2, 4, 4] and [r.start for r in rows] == [0, 2, 4, 6]


def test_folder_without_scheme(spark, make, tmp_path):
    """A plain path is one of Spark's default store; copies of one id are dealt over files."""
    assert token_files._qualified(spark, str(tmp_path)) == f"file:{tmp_path}" and token_files._qualified(spark, f"file://{tmp_path}/") == f"file:{tmp_path}"
    manifest = token_files.write_tokens(make([f"text number {i}" for i in range(300)], [None if i % 2 else 7 for i in range(300)]), f"{tmp_path}/plain", files=4)
    assert manifest.filter("n_docs > 0").count() == 4
    rows = token_files.read_tokens(manifest).collect()
    assert sorted(r.start for r in rows) == [r.start for r in sorted(rows, key=lambda r: (r.doc_id is not None, r.start))] and len(rows) == 300


def test_file_format():
    out = io.BytesIO()
    w = token_files.Writer(out, frame_bytes=64)
    docs = {i: np.arange(i * 7, dtype="<u4").tobytes() for i in range(9)}
    for i, b in docs.items():
        w.add(i, b)
    w.close()
    r = token_files.Reader(io.BytesIO(out.getvalue()))
    assert dict(r.documents()) == docs and len(r.frames) > 4
    import zstandard

    frames = zstandard.ZstdDecompressor().decompressobj(read_across_frames=True)
    assert frames.decompress(out.getvalue()) == b"".join(docs.values())  # any zstd reader can read the file
    broken = bytearray(out.getvalue())
    broken[r.start[2] + 12] ^= 255
    with pytest.raises(Exception):  # noqa: B017
        list(token_files.Reader(io.BytesIO(bytes(broken))).documents())
    assert token_files.checksum(docs[3]) == zlib.crc32(docs[3])


def test_op_queries(spark, library):
    d = "/root/testdata/sf0.001"
    from lorewell.llm import catalogue

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    ids = {i: np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4") for i, t in docs.items()}
    for r in catalogue.QUERIES["op7_bpe"](spark, d).collect():
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids[r.doc_id]), hashlib.sha256(ids[r.doc_id].tobytes()).hexdigest(), hashlib.sha256(docs[r.doc_id].encode()).hexdigest())
    start = 0
    got = {r.doc_id: r for r in catalogue.QUERIES["op10_token_files"](spark, d).collect()}
    for i in sorted(docs):
        x = np.append(ids[i], np.uint32(0)).astype("<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(x), zlib.crc32(x.tobytes()))
        start += len(x)
