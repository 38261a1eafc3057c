import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from passagemill.llm import token_file as tf
from passagemill.llm.queries import vocabulary

PATH = vocabulary("byte_bpe_50k.json")
CODER = tf.Encoder(PATH)
PLAIN = Tokenizer.from_file(PATH)
SPACES = " \n\t\r\x0b\x1c\x85\xa0 　"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 65535), max_size=300), st.integers(1, 4))
def test_segments_give_back_any_ids(ids, many):
    ids = np.array(ids * many, np.int64)
    keys, lengths, back = tf.unpack(tf.pack([None, 5], np.array([1, max(len(ids) - 1, 0)]), ids))
    assert keys == [None, 5] and list(back) == list(ids)


def test_many_blocks_and_skewed_ids_shrink():
    rng = np.random.default_rng(1)
    ids = np.concatenate([np.zeros(5000, np.int64), rng.zipf(1.3, 30_000) % 50_000, np.tile(rng.integers(0, 50_000, 700), 20), rng.integers(0, 65_536, 3001)])
    data = tf.pack([1], np.array([len(ids)]), ids)
    assert (tf.unpack(data)[2] == ids).all() and len(data) < 2 * len(ids)


def test_fewer_bits_than_a_dictionary_coder_and_than_order_0():
    docs = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].combine_chunks()
    ids = CODER.encode(docs)[0]
    n = len(ids)
    assert n > 500_000
    bits = 8 * len(tf.pack([1], np.array([n]), ids)) / n
    share = np.bincount(ids) / n
    assert bits < 8 * len(zlib.compress(ids.astype("<u2").tobytes(), 9)) / n and bits < -sum(p * np.log2(p) for p in share if p)


def test_lanes_do_not_matter():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 15, 16, 17, 4096, 70_001):
        ids = rng.zipf(1.2, n) % 60_000
        sizes, digits = tf.encode_block(ids)
        assert len(sizes) == tf._shape(n)[0] and (tf.decode_block(n, sizes, tf.unpacked(tf.packed(digits), len(digits))) == ids).all()


def test_damage_is_found():
    data = bytearray(tf.pack([1], np.array([3]), np.array([7, 8, 9])))
    data[-9] ^= 1
    with pytest.raises(ValueError):
        tf.unpack(bytes(data))
    with pytest.raises(ValueError):
        tf.unpack(b"")


@settings(max_examples=500, deadline=None)
@given(st.lists(st.text(alphabet="abt1._'sé×÷ĀɏʰЖ\u0301😀" + SPACES, max_size=14) | st.sampled_from(["<|endoftext|>", "a <|endoftext|>b", "Ġa Ġ", "\u2581 x", "don't 'tis 2nd (word) a.\nB", "x" * 30 + " " + "é" * 12 + "y"]), min_size=1, max_size=5))
def test_pieces_are_encoded_as_whole_texts_are(texts):
    ids, lengths = CODER.encode(pa.array(texts))
    ends = np.cumsum(lengths)
    assert [list(ids[e - n : e]) for e, n in zip(ends, lengths)] == [PLAIN.encode(t, add_special_tokens=False).ids for t in texts]


def test_write_and_read(spark, tmp_path):
    rows = [(3, "b b"), (None, "null key"), (1, None), (2, ""), (3, "a a"), (3, "b b"), (9, "word " * 30_000), (-4, "<|endoftext|> x  y ")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, start int, data int")
    path = str(tmp_path / "files")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    tf.write(docs, PATH, path, segment_ids=5)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert spark.read.parquet(path).count() > 2
    got = [tuple(r) for r in tf.read(spark, path, with_ids=True).orderBy("start").collect()]
    assert [r[0] for r in got] == [None, -4, 1, 2, 3, 3, 3, 9]
    want = sorted([PLAIN.encode(t or "", add_special_tokens=False).ids + [2] for _, t in rows])
    at = 0
    for _, start, n, crc, ids in got:
        assert start == at and n == len(ids) and crc == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += n
    assert sorted(r[4] for r in got) == want
    tf.write(docs.limit(0), PATH, str(tmp_path / "none"))
    assert tf.read(spark, str(tmp_path / "none")).collect() == []


def test_special_tokens_that_texts_spell_out():
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|", "x<|endoftext|>y <|endoftext|>", "plain"]
    ids, lengths = tf.Encoder(PATH).encode(pa.array(texts))
    assert [list(x) for x in np.split(ids, np.cumsum(lengths)[:-1])] == [PLAIN.encode(t, add_special_tokens=False).ids for t in texts]
    ids, lengths = tf.Encoder(PATH, escape_special=True).encode(pa.array(texts))
    assert 50256 not in ids and lengths[0] == 9
