import os
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortsmith.llm import catalog
from cohortsmith.llm import records as R

from .edges import docs, edge_rows, empty

os.environ["TOKENIZERS_PARALLELISM"] = "false"


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(catalog.tokenizer_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [2]


TEXTS = ["", " ", "\n", "a b", " a b ", "a  b", "a\n\nb", "a\nb", "\na", "a \nb", "a\tb c", "it's we'll 'tis", "x y z", "<|endoftext|> z", "Ünïcödé, ñandú; 漢字. Жуков! ǅ ª", "a\u2003\u2003b \u00a0c", "x\u0085y\u0085", "end. .x ,y can't,", "a <|endoftext|> b", "x<|endoftext|>y  z\n<|endoftext|>", "<|endoftext|", "é\nß ü", "1 23\r\n4"]


def test_pieces_encode_as_the_whole(plain):
    enc = R.PieceEncoder(catalog.tokenizer_path())
    for _ in range(2):  # learnt, then remembered
        got = [np.frombuffer(b, enc.dtype).tolist() for b in enc.encode(TEXTS)]
        assert got == [plain(t)[:-1] for t in TEXTS]


def test_added_tokens_as_the_library_reads_them(plain):
    ids = np.frombuffer(R.PieceEncoder(catalog.tokenizer_path()).encode(["a <|endoftext|> b"])[0], "<u2").tolist()
    assert ids == [64, 220, 50256, 275] == plain("a <|endoftext|> b")[:-1]
    ids = np.frombuffer(R.PieceEncoder(catalog.tokenizer_path(), literal=True).encode(["a <|endoftext|> b"])[0], "<u2").tolist()
    assert 50256 not in ids


def test_forgetting_changes_nothing(plain, monkeypatch):
    monkeypatch.setattr(R, "REMEMBERED", 20)
    enc = R.PieceEncoder(catalog.tokenizer_path())
    texts = [" ".join(f"word{i * j}" for j in range(9)) + f"\nline{i} end\n" for i in range(40)]
    for t in texts * 2:
        assert np.frombuffer(enc.encode([t])[0], enc.dtype).tolist() == plain(t)[:-1]


def test_files_hold_a_bounded_part_of_the_text(spark, tmp_path, monkeypatch, plain):
    monkeypatch.setattr(R, "FILE_BYTES", 2_000)
    rows = [(i, f"text {i} " + "word " * 200, "en", "a") for i in range(60)]
    R.write_records(docs(spark, rows), str(tmp_path), catalog.tokenizer_path(), 2)
    index = R.build_index(spark, str(tmp_path))
    assert index.select("file").distinct().count() > 20
    assert [r["doc_id"] for r in index.orderBy("start").collect()] == list(range(60))


def test_a_text_over_one_megabyte(spark, tmp_path, plain):
    text = "long words of a text " * 60_000
    R.write_records(docs(spark, [(1, text, "en", "a"), (2, None, "en", "a")]), str(tmp_path), catalog.tokenizer_path(), 2)
    got = R.build_index(spark, str(tmp_path)).orderBy("start").collect()
    assert [r["n_tokens"] for r in got] == [len(plain(text)), 1]


def test_frames():
    payloads = [b"", b"abc", b"\n" * 9, bytes(range(256))]
    data = b"".join(map(R.frame, payloads))
    assert [p for _, _, p in R.unframe(data)] == payloads
    for at in (0, 9, 30, len(data) - 3):
        with pytest.raises(ValueError):
            list(R.unframe(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :]))


def test_round_trip(spark, tmp_path, plain):
    rows = edge_rows() + [(100 + i, t, "en", "a") for i, t in enumerate(TEXTS)]
    R.write_records(docs(spark, rows), str(tmp_path), catalog.tokenizer_path(), 2, files=3)
    index = R.build_index(spark, str(tmp_path))
    got = sorted(map(tuple, index.select("start", "doc_id", "n_tokens", "ids_crc32").collect()), key=lambda r: r[0])
    assert [r[1] for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
    want = sorted((-1 if i is None else i, len(plain(t)), zlib.crc32(np.array(plain(t), "<u4").tobytes())) for i, t, _, _ in rows)
    assert sorted((-1 if r[1] is None else r[1], r[2], r[3]) for r in got) == want
    assert [r[0] for r in got] == np.cumsum([0, *(r[2] for r in got[:-1])]).tolist()
    few = index.filter(F.col("doc_id") % 3 == 1)
    read = {r["doc_id"]: r["ids"] for r in R.read_records(spark, str(tmp_path), few).collect()}
    assert read and all(ids == plain({i: t for i, t, _, _ in rows}[k]) for k, ids in read.items())


def test_empty_table(spark, tmp_path):
    R.write_records(empty(spark), str(tmp_path), catalog.tokenizer_path(), 2)
    assert R.build_index(spark, str(tmp_path)).count() == 0


def test_query(spark, sf, plain):
    got = catalog.QUERIES["op2_token_records"](spark, sf).toPandas().sort_values("doc_id")
    texts = catalog.table(spark, sf, "documents").orderBy("doc_id").toPandas()["text"]
    start = 0
    for r, t in zip(got.itertuples(), texts, strict=True):
        ids = plain(t)
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_odd_pieces_are_encoded_in_rows(monkeypatch):
    """Pieces that are no words of letters share a call of the library, and those beside odd white space stay right."""
    enc = R.PieceEncoder(catalog.tokenizer_path())
    lone = []
    whole = enc._whole
    monkeypatch.setattr(enc, "_whole", lambda t: lone.append(t) or whole(t))
    texts = [" ".join(f"x{i}-{j}@q" for j in range(20)) + f"\nl{i}\n7 (a)" for i in range(300)] + ["", " ", "a ", "\n", "k1\tv1 k2\tv2\nk3\tv3 w\t"]
    got = enc.encode(texts)
    assert len(lone) < 1000 < len(enc.known)
    assert got == [whole(t) for t in texts]


def test_chunks_of_a_batch_are_small():
    """A worker's memory follows from the texts that are encoded at once."""
    texts = pa.array(["x" * 100_000] * 40 + ["y" * 3_000_000, "", "z"])
    cuts = list(R._column_chunks(texts))
    sizes = [sum(len(t) for t in texts[a:b].to_pylist()) for a, b in cuts]
    assert [a for a, _ in cuts[1:]] == [b for _, b in cuts[:-1]] and (cuts[0][0], cuts[-1][1]) == (0, 43)
    assert max(n for n, (a, b) in zip(sizes, cuts) if b - a > 1) <= 1 << 20
