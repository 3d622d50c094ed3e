"""The search in one pass: over texts and segments, long texts, letters beyond ASCII, and its work on letters that no seed holds."""

import random

import pytest

from fragsieve.operators import search, windows
from fragsieve.sources import segments
from fragsieve.sources.segments import SegmentIndex

from .test_search import brute, corpus, queries, rows


def some(rng, n, letters="ACDE"):
    return "".join(rng.choice(letters) for _ in range(n))


@pytest.mark.parametrize("k,most", [(1, 0), (5, 0), (3, 2), (9, 3)])
def test_long_texts_segments_and_other_letters(spark, tmp_path, monkeypatch, k, most):
    """A text of several blocks, and some with letters of two and four bytes, beside short and empty ones."""
    rng = random.Random(k)
    seqs = [some(rng, n) for n in (0, 3, 40, 70_000)] + [some(rng, 300, "ACé\U0001f600"), "ACß" * 9]
    qs = [seqs[3][i : i + 18] for i in (0, 32_760, 65_530, 69_982)] + [some(rng, n) for n in (9, 10, 14, 22)] + [seqs[4][5:17], "ACßACßACß"]
    want = brute(seqs, qs, k, most)
    assert {r for r, *_ in want} >= {0, 1, 2, 3, 8, 9}
    index = SegmentIndex(spark, str(tmp_path / "i"), lambda: corpus(spark, seqs))
    assert rows(search.search(None, queries(spark, qs), k, most, index)) == want
    plain = search.search(corpus(spark, seqs), queries(spark, qs), k, most)
    assert rows(plain) == want
    # No k-mer becomes a row: a plan without a shuffle of candidates.
    assert "Generate" not in plain._jdf.queryExecution().executedPlan().toString()


def test_blocks_of_a_long_text(monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(windows, "TEXT_BLOCK", 100)
    monkeypatch.setattr(windows, "GROUP", 50)
    rng = random.Random(5)
    texts = [some(rng, 1000, "AC"), some(rng, 30, "AC"), some(rng, 101, "ACé")]
    qs = [texts[0][95:107], "ACACAC", texts[0][:12]]
    for take in (texts[:2], texts):
        found = set()
        machine = windows.Machine(windows.Patterns(qs, [(i, o, 3) for i, q in enumerate(qs) for o in range(0, len(q), 3)], 1))
        for batch in windows._results(machine, pa.array(take), np.arange(len(take)) + 1, np.zeros(len(take), np.int64), np.full(len(take), windows.EVERY)):
            found |= {(r["id"], r["protein_num"], r["st"], r["matched"], r["edits"]) for r in batch.to_pylist()}
        assert found == brute(take, qs, 3, 1)


def test_segments_hold_all_places_in_order(spark, tmp_path):
    rng = random.Random(2)
    seqs = [some(rng, n) for n in (70_000, 500, 0, 20)]
    made = SegmentIndex(spark, str(tmp_path / "i"), lambda: corpus(spark, seqs)).segments().collect()
    owned = {}
    for r in made:
        text = "".join(r.chunks)
        places = [int.from_bytes(r.places[i : i + 2], "little") for i in range(0, len(r.places), 2)]
        assert sorted(places) == list(range(len(text))) and len(text) <= segments.SEGMENT
        words = [text[i : i + 8] for i in places]
        assert words == sorted(words)
        for num, begin, chunk in zip(r.nums, r.begins, r.chunks, strict=True):
            owned[num, begin] = chunk[: segments.BLOCK]
    assert all("".join(owned[k] for k in sorted(owned) if k[0] == p) == s for p, s in enumerate(seqs, 1))


def test_letters_of_any_text(spark):
    from fragsieve.plans.queries import _letters

    texts = ["aBc1 xßıſZ", "", None, "Äa\n-b"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(_letters("t")).collect()]
    assert got == ["ABCXZ", "", "", "AB"]


@pytest.mark.parametrize("large", [False, True])
def test_letters_picked_in_tasks(large):
    import pyarrow as pa

    from fragsieve.functions.letters import letters_in

    texts = ["aBc1 xßıſZ", "", None, "@[`{é", "Äa\n-b", "", "Qé\U0001f600z"]
    column = pa.array(["cut off", *texts], pa.large_string() if large else pa.string())
    assert letters_in(column[1:]).to_pylist() == ["ABCXZ", "", "", "", "AB", "", "QZ"]
    assert letters_in(column[:0]).to_pylist() == [] and letters_in(pa.array([None, ""], column.type)).to_pylist() == ["", ""]


def test_search_of_texts_picks_their_letters_without_the_plan(spark, tmp_path):
    texts = ["ab-c d! ab ß cd", "", "x.A.b.C.d.x"]
    index = SegmentIndex(spark, str(tmp_path / "i"), lambda: corpus(spark, texts), only_letters=True)
    want = brute(["ABCDABCD", "", "XABCDX"], ["ABCD", "BCDA"], 2, 1)
    plain = search.search(corpus(spark, texts), queries(spark, ["ABCD", "BCDA"]), 2, 1, letters=True)
    assert rows(plain) == rows(search.search(None, queries(spark, ["ABCD", "BCDA"]), 2, 1, index)) == want
    # A pattern for each text is what the tasks spent half of their time on.
    assert "regexp_replace" not in plain._jdf.queryExecution().executedPlan().toString()


def test_letters_where_the_joins_search(spark, tmp_path):
    """A query longer than a segment's overlap, and one of too many letters for one pass, take the joins."""
    text = some(random.Random(3), 1500, "abcd -é")
    own = "".join(c for c in text if c in "abcd").upper()
    many = "".join(chr(0x4E00 + i) for i in range(200))
    index = SegmentIndex(spark, str(tmp_path / "i"), lambda: corpus(spark, [text * 2]), only_letters=True)
    assert [(r["st"], r["matched"]) for r in search.search(None, queries(spark, [(own * 2)[:1100]]), 5, 0, index).collect()] == [(0, (own * 2)[:1100])]
    assert [(r["st"], r["matched"]) for r in search.search(corpus(spark, [text]), queries(spark, [many, own[9:30]]), 5, 0, letters=True).collect()] == [(9, own[9:30])]
