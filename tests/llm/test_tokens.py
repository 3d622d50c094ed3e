import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fragsieve.llm import bytespans as B
from fragsieve.llm import packing, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
TRICKY = [
    None, "", " ", "   ", "\n", "a", " a", "a ", "don't stop, it's we'll 'tis I've 're ''s 's \n's x's  'd", "  two  spaces \n\n end \t x\r\n", "aaaaaaaaaaaaaaaaaaaaaaaaaaa", "!!!! ???'''",
    "l'été où ça 12 345 ４５ ②½", "日本語テスト 한국어 😀😀 é", "  x　 y", "<|endoftext|>", "a<|endoftext|>b <|endoftext|><|endoftext|> c", "same", "same", "x" * 5000, "ab cd " * 3000, "\x00\x01 \x7f",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def table(spark, texts):
    return spark.createDataFrame([(i, t, "extra") for i, t in enumerate(texts)], "doc_id long, text string, length string")


def test_counts_equal_the_library(spark, library):
    rows = token_counts.token_counts(table(spark, TRICKY).repartition(3), PATH).collect()
    assert len(rows) == len(TRICKY)
    for r in rows:
        text = TRICKY[r.doc_id] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 1024), repr(text[:40])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("aab' \n\tsté12.,😀 lrve")), max_size=40), max_size=6))
def test_pretokens_and_merges_against_the_library(texts):
    library, model = Tokenizer.from_file(PATH) if not hasattr(test_pretokens_and_merges_against_the_library, "t") else test_pretokens_and_merges_against_the_library.t, token_counts.merges(PATH)
    test_pretokens_and_merges_against_the_library.t = library
    import pyarrow as pa

    data, offs = B.utf8(pa.array(texts, pa.large_string()))
    start, end, doc = token_counts.P.pretokens(data, offs)
    got = np.bincount(doc, weights=model.counts(data, start, end), minlength=len(texts))
    assert got.tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_counts_of_an_empty_table(spark):
    assert token_counts.token_counts(table(spark, ["x"]).where("false"), PATH).collect() == []


def check_packing(rows, texts, library, room):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert sorted(by_doc) == list(range(len(texts)))
    for d, own in by_doc.items():
        ids = np.array([*library.encode(texts[d] or "", add_special_tokens=False).ids, 0], "<u4")
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert [r.start for r in own] == np.cumsum([0] + [r.length for r in own]).tolist()[:-1]
        assert sum(r.length for r in own) == len(ids) and len(own) == -(-len(ids) // room)
        for r in own:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    for own in by_seq.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0] + [r.length for r in own]).tolist()[:-1]
        assert own[-1].offset + own[-1].length <= room
    return len(by_seq)


def test_packing_round_trip(spark, library):
    texts = TRICKY + ["word " * n for n in range(1, 300)] + ["same words " * 7] * 60
    room = 256
    rows = packing.pack(table(spark, texts).repartition(5), PATH, room=room).collect()
    used = check_packing(rows, texts, library, room)
    total = sum(r.length for r in rows)
    assert used <= 1.03 * total / room + 2
    assert packing.pack(table(spark, ["x"]).where("false"), PATH, room=room).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=30))
def test_plan_places_every_document_once(histogram):
    room, placed, load = 64, {}, {}
    for n, count, first, offset in packing.plan(histogram, room, 4):
        placed[n] = placed.get(n, 0) + count
        for s in range(first, first + count):
            load.setdefault(s, []).append((offset, n))
    assert placed == histogram
    for own in load.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(own[-1]) <= room
    least = max(sum(n * c for n, c in histogram.items()) / room, sum(c for n, c in histogram.items() if 2 * n > room))
    assert len(load) <= 1.25 * least + 8


def test_classes_equal_the_library(spark, library):
    cls, alike = token_counts.P.classes(), lambda s: len(library.pre_tokenizer.pre_tokenize_str(s)) == 1
    for c in [*range(0xD800), *range(0xE000, 0x33480), 0x10FFFF]:
        kind = next((k for k, s in ((token_counts.P.LETTER, "a"), (token_counts.P.NUMBER, "1"), (token_counts.P.OTHER, "!")) if alike(s + chr(c))), token_counts.P.SPACE)
        assert cls[c] == kind, hex(c)
    texts = ["a\U00032000b \U00031fff\U00032000!\U000323af", "x\U00013460y 1\U00010d40"]
    rows = token_counts.token_counts(table(spark, texts), PATH).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


def thue_morse(n):
    """Two different texts over two letters whose polynomial hashes modulo powers of two agree."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_texts_that_hash_alike_modulo_powers_of_two(spark, library):
    texts = [t for n in (1024, 2048, 4096) for t in thue_morse(n)] + [" ".join(thue_morse(1024))]
    counts = {r.doc_id: r.n_tokens for r in token_counts.token_counts(table(spark, texts).coalesce(1), PATH).collect()}
    assert counts == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}
    check_packing(packing.pack(table(spark, texts).coalesce(1), PATH, room=256).collect(), texts, library, 256)


def test_equal_hashes_do_not_make_pretokens_equal(monkeypatch):
    data = np.frombuffer(b"abcabdabcxy", np.uint8)
    start, end = np.array([0, 3, 6, 9]), np.array([3, 6, 9, 11])
    zeros = lambda data, start, end: (np.zeros(len(start), np.uint64),) * 2
    monkeypatch.setattr(token_counts.P, "word_sums", zeros)
    one, which = token_counts.P.distinct(data, start, end)
    raw = data.tobytes()
    assert [raw[start[one[w]] : end[one[w]]] for w in which] == [b"abc", b"abd", b"abc", b"xy"]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abnot eErs")), min_size=1, max_size=400), min_size=1, max_size=4))
def test_merges_of_long_and_short_sequences(texts):
    model, library = token_counts.merges(PATH), Tokenizer.from_file(PATH)
    raw = [t.encode() for t in texts]
    got = model.merge(model.of_byte[np.frombuffer(b"".join(raw), np.uint8)], np.array([len(b) for b in raw]))
    symbols = ["".join(token_counts.byte_symbols()[b] for b in x) for x in raw]
    assert got.tolist() == [len(library.model.tokenize(s)) for s in symbols]


def test_long_pretokens_take_seconds(spark, library):
    import time

    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 200_000)), "a" * 200_000]
    table(spark, [None]).transform(lambda d: token_counts.token_counts(d, PATH)).collect()
    began = time.time()
    rows = token_counts.token_counts(table(spark, texts), PATH).collect()
    assert time.time() - began < 20
    assert {r.doc_id: r.n_tokens for r in rows} == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_rows_without_ids(spark):
    rows = spark.createDataFrame([(None, "some text"), (None, None), (3, "")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_tokens) for r in token_counts.token_counts(rows, PATH).collect()) == [(0, 0), (0, 2), (3, 0)]
    assert sorted((r.doc_id or 0, r.length) for r in packing.pack(rows, PATH).collect()) == [(0, 1), (0, 3), (3, 1)]
