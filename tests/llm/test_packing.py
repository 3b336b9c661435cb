import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sparkloom.llm import hilbert_packing
from sparkloom.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenizer_path())


TEXTS = ["Hello, World! it's 42 o'clock", "naïve Straße ÀÉ ǅ İstanbul ΣΑΣ", "é café", "a b c", "<|endoftext|> x <|startoftext|>", "foo<|endoftext|>bar's", "!!\"#%(x)[y]_z_", "", " \n\t ", "漢字 かな 🙂🙂", "don't we'll I'M", "x" * 3000, "it''s 's", "ªº²Ⅷ 9a9"]


def by_text(words, texts):
    ids, lengths = words.ids(pa.array(texts, pa.string()))
    return [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])]


def test_word_ids_are_the_tokenizer_s(tokenizer, prose):
    texts = [*TEXTS, *prose]
    for text, ids in zip(texts, by_text(hilbert_packing.words_of(tokenizer_path()), texts), strict=True):
        assert ids == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_slices_cover_all_texts(tokenizer, prose):
    texts = pa.array([*prose, None, "", "z" * 5000, None], pa.string())
    found = list(hilbert_packing.slices(texts, 3000))
    assert [a for a, _ in found] == [0, *np.cumsum([n for _, n in found])[:-1].tolist()] and sum(n for _, n in found) == len(texts)
    assert len(found) > 5 and list(hilbert_packing.slices(pa.array([], pa.string()))) == []
    words = hilbert_packing.Words(tokenizer_path())
    parts = [ids for a, n in found for ids in by_text(words, texts.slice(a, n).to_pylist())]
    assert parts == by_text(words, texts.to_pylist())


def check(pieces, docs, tokenizer, sequence):
    ids = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for d, t in docs}
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_seq.setdefault(p["sequence_id"], []).append(p)
        own = np.array(ids[p["doc_id"]][p["start"] : p["start"] + p["length"]], "<u4")
        assert len(own) == p["length"] > 0 and zlib.crc32(own.tobytes()) == p["ids_crc32"] and p["doc_tokens"] == len(ids[p["doc_id"]])
    for d, own in ids.items():
        at = 0
        for p in sorted(by_doc[d], key=lambda p: p["start"]):
            assert p["start"] == at
            at += p["length"]
        assert at == len(own)
    padding = 0
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= sequence
        padding += 0 if at & (at - 1) == 0 else sequence - at
    assert padding == 0


@pytest.mark.parametrize("sequence,per_range", [(2048, 16_000_000), (64, 500), (8, 100)])
def test_round_trip(spark, prose, tokenizer, sequence, per_range):
    docs = [(k, t) for k, t in enumerate([*prose[:60], *TEXTS, None])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    check(hilbert_packing.pack(df, tokenizer_path(), sequence, tokens_per_range=per_range).collect(), docs, tokenizer, sequence)


def test_edges(spark, clashing, empty_docs):
    rows = hilbert_packing.pack(clashing, tokenizer_path()).collect()
    assert sum(r["length"] for r in rows) == sum(r["doc_tokens"] for r in rows if r["start"] == 0)
    assert {r["length"] for r in rows if r["doc_id"] in (2, 3, 5)} == {1}
    assert hilbert_packing.pack(empty_docs, tokenizer_path()).count() == 0


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_curve_visits_every_cell_by_unit_steps(dims, bits):
    axes = np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij")
    points = np.stack([a.ravel() for a in axes], axis=1)
    keys = hilbert_packing.hilbert_keys(points, bits)
    assert sorted(keys.tolist()) == list(range(len(points)))
    walk = points[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_similar_documents_are_near_on_the_curve(spark):
    texts = [(k, ("alpha beta gamma delta " if k % 2 else "uno dos tres cuatro cinco ") * (20 + k % 5)) for k in range(60)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    rows = sorted(hilbert_packing.pack(df, tokenizer_path(), 256).collect(), key=lambda r: (r["sequence_id"], r["offset"]))
    order = [r["doc_id"] % 2 for r in rows]
    assert sum(a != b for a, b in zip(order, order[1:], strict=False)) <= 3
