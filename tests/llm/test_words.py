"""Words whose sums of powers modulo 2**64 agree for every odd base: the Thue-Morse sequence and its complement."""

from __future__ import annotations

import public_tokenizers
from tokenizers import Tokenizer

from caselake.llm import lines, packing, pieces, setjoin, words
from caselake.llm.queries import PIECE_BPE, WORD_BPE


def thue_morse(n, zero="a", one="b"):
    return "".join(one if bin(k).count("1") % 2 else zero for k in range(n))


PAIRS = [(thue_morse(n), thue_morse(n, "b", "a")) for n in (1024, 2048, 4096)]


def docs(spark, texts):
    return spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)


def test_hashes_differ():
    for a, b in PAIRS:
        h = words.word_hashes(f"{a} {b} {a}".encode())[1]
        assert h[0] == h[2] != h[1]


def test_join_lines_packing_and_pieces_tell_them_apart(spark):
    a, b = PAIRS[1]
    assert [r["component_id"] for r in setjoin.jaccard_components(docs(spark, [a, b])).orderBy("_id").collect()] == [1, 2]
    assert [r["text"] for r in lines.drop_similar_lines(docs(spark, [a, b])).orderBy("doc_id").collect()] == [a, b]
    known = Tokenizer.from_file(public_tokenizers.path(WORD_BPE))
    got = packing.pieces(docs(spark, [a, b]), public_tokenizers.path(WORD_BPE)).orderBy("doc_id").collect()
    assert [r["length"] for r in got] == [len(known.encode(t, add_special_tokens=False).ids) + 1 for t in (a, b)] and got[0]["ids_crc32"] != got[1]["ids_crc32"]
    assert all(r["round_trip"] for r in pieces.encode(docs(spark, [a, b]), public_tokenizers.path(PIECE_BPE)).collect())
