import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from paperloom.llm import token_ids
from paperloom.llm.packing import OpenBins, pack_documents
from paperloom.llm.queries import QUERIES
from paperloom.llm.token_files import pack, read_token_files, unpack, write_token_files
from paperloom.llm.token_ids import Encoder, default_path
from paperloom.session import fresh_path

SF = "/root/testdata/sf0.001"
ODD = [
    "", " ", "word", "Word, WORD. wo'rd it's We'll", "éa İx ΣΣ K", "a b c\x1cd\x85e", "12345 a1b2 ²³",
    "<|endoftext|> x<|startoftext|>y", "日本語 text 🎉!!", "don't 's 'tis rock'n'roll", "...,,,!! --- a--b", "ﬁne Ǆ ß ẞ", "\x00 \x0b\x0c",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(default_path())


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_words_give_the_ids_of_the_whole_text(tokenizer, spark):
    encoder = Encoder(default_path())
    given = [row.text for row in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    for text in ODD + given:
        assert np.frombuffer(encoder.encode(text.encode()), "<u4").tolist() == ids_of(tokenizer, text), text


def encoded(encoder, texts):
    parts = list(encoder.encode_all(texts))
    return np.concatenate([ids for ids, _ in parts]), np.concatenate([sizes for _, sizes in parts])


@pytest.mark.parametrize("marked, at_once", [(True, 2 << 20), (True, 700), (False, 2 << 20)])
def test_columns_give_the_ids_of_each_text(tokenizer, spark, monkeypatch, marked, at_once):
    monkeypatch.setattr(token_ids, "BYTES_AT_ONCE", at_once)
    monkeypatch.setattr(token_ids, "RUNS_AT_ONCE", 50)
    encoder = Encoder(default_path())
    if not marked:
        encoder.last[:] = False
    given = [row.text for row in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(60).collect()]
    letters = [chr(code) for code in range(0x260) if chr(code).isalpha()]
    given += [*ODD, None, "  a\n\nb\t ", "x\ny", " ".join(f"a{letter}B,) {letter}" for letter in letters), "x\u0301 n\u0303! e\u0301"]
    for texts in (given, [], [None], ["", " "], given[::-1]):
        ids, sizes = encoded(encoder, pa.array(texts, pa.string()))
        want = [ids_of(tokenizer, text) for text in texts]
        assert sizes.tolist() == [len(own) for own in want]
        assert ids.tolist() == [number for own in want for number in own]
    ids, sizes = encoded(encoder, pa.array(given, pa.string()).slice(3, 4))
    assert ids.tolist() == [number for text in given[3:7] for number in ids_of(tokenizer, text)]


def test_new_words_go_through_the_model_together():
    """Each of them cost a call and several objects."""
    encoder = Encoder(default_path())
    names = ["".join(chr(97 + ord(digit) - 48) for digit in f"{n:05}") for n in range(20_000)]
    ids, _ = encoded(encoder, pa.array([" ".join(f"{name.title()}," for name in names), "1a"], pa.string()))
    assert list(encoder.words) == [b"1a"] and not encoder.pieces
    assert ids.tobytes() == b"".join(encoder.encode(text.encode()) for text in (" ".join(f"{name}," for name in names), "1a"))


@pytest.mark.parametrize("top", [1, 2, 200, 49_408, 2**32])
@pytest.mark.parametrize("count", [0, 1, 255, 256, 257, 5_000])
def test_segment_round_trip(top, count):
    ids = np.random.default_rng(count).integers(0, top, count).astype(np.uint32)
    ids[::50] = top - 1
    data = pack(ids)
    assert unpack(data).tolist() == ids.tolist()
    assert unpack(data, 200, 300).tolist() == ids[200:300].tolist()


def odd_documents(spark):
    rows = [(n, text, "x", n) for n, text in enumerate(ODD)] + [(3, ODD[3], "x", 0), (5, None, None, None), (None, "a b", None, None)]
    rows += [(40, "long " * 9_000, "y", 1), (41, None, "y", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, start string, piece long").repartition(3)


def test_token_files(spark, tokenizer):
    path = fresh_path(spark, "tokens")
    docs = odd_documents(spark)
    write_token_files(docs, path)
    found = read_token_files(spark, path, with_ids=True).orderBy("start").collect()
    want = sorted((doc.doc_id is not None, doc.doc_id or 0, crc(ids_of(tokenizer, doc.text))) for doc in docs.collect())
    assert sorted((row.doc_id is not None, row.doc_id or 0, row.ids_crc32) for row in found) == want
    place = 0
    for before, row in zip([None, *found], found, strict=False):
        assert row.start == place and row.n_tokens == len(row.ids) // 4
        assert before is None or before.doc_id is None or before.doc_id <= row.doc_id
        place += row.n_tokens


def test_batches_of_several_megabytes(spark):
    """Their texts are encoded in several parts."""
    sizes = {n: n * 90_000 + 1 for n in range(12)}
    docs = spark.createDataFrame([(n, "word " * (size - 1)) for n, size in sizes.items()], "doc_id long, text string").coalesce(1)
    path = fresh_path(spark, "tokens")
    write_token_files(docs, path)
    assert {row.doc_id: row.n_tokens for row in read_token_files(spark, path).collect()} == sizes
    packed = pack_documents(docs, size=4096).groupBy("doc_id").sum("length").collect()
    assert {row.doc_id: row[1] for row in packed} == sizes


def test_token_files_of_an_empty_table(spark):
    path = fresh_path(spark, "tokens")
    write_token_files(odd_documents(spark).limit(0), path)
    assert read_token_files(spark, path).count() == 0


def check_packing(rows, texts_by_id, tokenizer, size):
    by_sequence, by_doc = {}, {}
    for row in rows:
        by_sequence.setdefault(row.sequence_id, []).append(row)
        by_doc.setdefault(row.doc_id, []).append(row)
    for own in by_sequence.values():
        place = 0
        for row in sorted(own, key=lambda row: row.offset):
            assert row.offset == place
            place += row.length
        assert place <= size
    assert sorted(by_doc) == sorted(texts_by_id)
    for doc_id, own in by_doc.items():
        ids = ids_of(tokenizer, texts_by_id[doc_id])
        own.sort(key=lambda row: row.piece)
        assert [row.piece for row in own] == list(range(-(-len(ids) // size)))
        for row in own:
            piece = ids[row.start : row.start + row.length]
            assert row.start == row.piece * size and row.ids_crc32 == crc(piece)
        assert sum(row.length for row in own) == len(ids)
    return len(by_sequence)


def test_packing(spark, tokenizer):
    docs = {row.doc_id: row.text for row in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op7_best_fit_packing"](spark, SF).collect()
    used = check_packing(rows, docs, tokenizer, 4096)
    assert used <= -(-sum(row.length for row in rows) // 4096) + 1


def test_packing_of_odd_documents(spark, tokenizer):
    docs = odd_documents(spark)
    rows = pack_documents(docs, size=512, open_bins=2, with_ids=True).collect()
    assert all(zlib.crc32(row.ids) == row.ids_crc32 for row in rows)
    alone = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).where("doc_id not in (3, 5)")
    kept = {row.doc_id: row.text for row in alone.collect()}
    check_packing([r for r in pack_documents(alone, size=512).collect()], kept, tokenizer, 512)
    assert sum(row.doc_id == 3 for row in rows) == 2 and sum(row.doc_id is None for row in rows) == 1
    assert pack_documents(docs.limit(0)).count() == 0


def test_best_fit_and_the_fullest_closes_first():
    bins = OpenBins(10, 2)
    assert bins.add(6, "a") == [] and bins.add(7, "b") == []
    assert bins.add(3, "c") == [(1, [(0, "b"), (7, "c")])]
    assert bins.add(5, "d") == []
    assert bins.add(8, "e") == [(0, [(0, "a")])]
    assert bins.rest() == [(3, [(0, "e")]), (2, [(0, "d")])]


def test_items_of_full_size_close_no_other_bin():
    bins = OpenBins(10, 2)
    assert bins.add(6, "a") == [] and bins.add(7, "b") == []
    assert bins.add(10, "c") == [(2, [(0, "c")])]
    assert bins.add(4, "d") == [(0, [(0, "a"), (6, "d")])] and bins.add(3, "e") == [(1, [(0, "b"), (7, "e")])]
    assert bins.rest() == [] and bins.opened == 3
