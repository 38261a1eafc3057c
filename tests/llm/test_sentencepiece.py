import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from passagemill.llm import sentencepiece_codec as sc
from passagemill.llm.queries import vocabulary

PATH = vocabulary("piece_bpe_32k.model")
CODEC = sc.codec(PATH)


def scores():
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=PATH)
    fixed = {i for i in range(m.get_piece_size()) if m.is_control(i) or m.is_unknown(i) or m.is_unused(i) or m.is_byte(i)}
    return {m.id_to_piece(i): (m.get_score(i), i) for i in range(m.get_piece_size()) if i not in fixed}


TABLE = scores()


def brute(text):
    """The best segmentation of a whole text by dynamic programming over all substrings."""
    if not text:
        return []
    s = [(sc.MARK, True)] + [(sc.MARK, True) if c == " " else (c, c != sc.MARK) for c in text]
    unknown = min(v for v, _ in TABLE.values() if v > -1e8) - sc.UNKNOWN_PENALTY
    best, back = [0.0] + [-np.inf] * len(s), [None] * (len(s) + 1)
    for end in range(1, len(s) + 1):
        for start in range(max(0, end - 16), end):  # longer pieces first, so that they win ties
            if all(ok for _, ok in s[start:end]) and (piece := "".join(c for c, _ in s[start:end])) in TABLE and best[start] + TABLE[piece][0] > best[end]:
                best[end], back[end] = best[start] + TABLE[piece][0], (start, [TABLE[piece][1]])
        char, ok = s[end - 1]
        if not (ok and char in TABLE) and best[end - 1] + unknown > best[end]:
            best[end], back[end] = best[end - 1] + unknown, (end - 1, [CODEC.byte_ids[b] for b in char.encode()])
    ids, end = [], len(s)
    while end:
        end, these = back[end][0], back[end][1]
        ids = these + ids
    return ids


def same(texts):
    ids, offsets = CODEC.encode(pa.array(texts))
    got = [list(ids[a:b]) for a, b in zip(offsets, offsets[1:])]
    raw, ends = CODEC.decode(ids, offsets)
    back = [raw.tobytes()[a:b].decode() for a, b in zip(ends, ends[1:])]
    assert back == texts
    assert got == [brute(t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="the nationö \n\t▁😀☃1.", max_size=25), min_size=1, max_size=4))
def test_best_segmentation_and_exact_round_trip(texts):
    same(texts)


def test_fixture_texts(spark, sf):
    rng = random.Random(0)
    texts = [r["text"][:600] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    same(rng.sample(texts, 40) + ["", " ", "  ", "a   b ", "\x00", "▁", " ▁ "])


def test_operators_and_odd_rows(spark, sf):
    rows = [(1, None), (2, ""), (3, "x" * 50_000), (4, "Hello  wörld ▁"), (4, "Hello  wörld ▁")]
    docs = spark.createDataFrame([(*r, "p") for r in rows], "doc_id long, text string, piece string")
    coded = sc.encode(docs, PATH)
    assert coded.columns == ["doc_id", "piece", "piece_ids"]
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in sc.decode(coded, PATH).collect()))) == sorted(map(str, rows))
    assert sc.encode(docs.limit(0), PATH).collect() == []
    whole = sc.digests(spark.read.parquet(f"{sf}/documents.parquet"), PATH)
    assert whole.where("not round_trip").count() == 0 and whole.count() == 200


def test_columns_named_like_results(spark):
    docs = spark.createDataFrame([(1, "a b", "old", 5)], "doc_id long, text string, piece_ids string, round_trip int")
    coded = sc.encode(docs, PATH, round_trip="round_trip")
    assert coded.columns == ["doc_id", "piece_ids_input", "round_trip_input", "piece_ids", "round_trip"]
    row = coded.first()
    assert row["piece_ids_input"] == "old" and row["round_trip_input"] == 5 and row["round_trip"] is True
    back = sc.decode(coded.withColumn("text", coded["doc_id"]), PATH)
    assert back.columns[-2:] == ["text_input", "text"] and back.first()["text"] == "a b"
