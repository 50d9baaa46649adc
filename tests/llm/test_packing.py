from __future__ import annotations

import struct
import zlib

import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from factloom.llm import byte_bpe, packing, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


IDS = byte_bpe.load(PATH)
PLAIN = Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aé9²'st .,!\n\t\r\x0b\x0c\x1c\x1f\x85\xa0 ​　ßÑ中\U0001f600<|endoftext|>")))
def test_ids_equal_plain_tokenisation(text):
    ids = PLAIN.encode(text, add_special_tokens=False).ids
    assert byte_bpe.little_endian(IDS.ids(text)) == struct.pack(f"<{len(ids)}I", *ids)


def check(rows, texts, plain):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    total = 0
    for key, text in texts.items():
        ids = plain(text or "") + [2]
        total += len(ids)
        parts = sorted(by_doc[key], key=lambda r: r.piece)
        assert [p.piece for p in parts] == list(range(-(-len(ids) // 1024)))
        assert [p.length for p in parts[1:]] == [1024] * (len(parts) - 1)
        start = 0
        for p in parts:
            part = ids[start:start + p.length]
            assert (p.start, p.ids_crc32) == (start, zlib.crc32(struct.pack(f"<{len(part)}I", *part)))
            start += p.length
        assert start == len(ids)
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024
    return len(by_sequence), -(-total // 1024)


def test_query(spark, plain):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    made, least = check(queries.QUERIES["op8_best_fit"](spark, folder).collect(), texts, plain)
    assert made <= 1.1 * least + 1


def test_edges(spark, plain):
    texts = {1: None, 2: "", 3: "word " * 3000, 4: "a" * 5000, 5: "\n\n  \t", 6: " x  y\n z ", 7: "one<|endoftext|>two <|endoftext|>", 8: " " * 9000}
    docs = spark.createDataFrame([(k, v, "w") for k, v in texts.items()], "doc_id long, text string, piece string")
    check(packing.pack_documents(docs, PATH).collect(), texts, plain)
    assert packing.pack_documents(docs.limit(0), PATH).collect() == []
    repeated = docs.filter("doc_id = 4").union(docs.filter("doc_id = 4")).union(spark.createDataFrame([(None, "b", "")], docs.schema))
    assert packing.pack_documents(repeated, PATH).count() == 2 * (-(-(len(plain("a" * 5000)) + 1) // 1024)) + 1


def test_fullest_closes_first():
    fit = packing.BestFit(10, 2)
    assert [fit.place(n) for n in (7, 4, 9)] == [(0, 0), (1, 0), (2, 0)]  # the third leaves one free place and closes
    assert [fit.place(n) for n in (1, 3, 5)] == [(0, 7), (1, 4), (3, 0)]
