"""Parts and word-edited copies of items, against brute force."""

import random
import tracemalloc

import pytest

from tarnmill.llm import decontaminate
from tarnmill.llm.decontaminate import LEAST, PASSAGE, WINDOW, Index, find_leaks, normal, without_leaks


def prose(rng, n):
    text = ""
    while len(text) < n:
        text += "".join(rng.choice("abcdefghijklmnopq") for _ in range(rng.randrange(2, 8))) + " "
    return text[:n].strip().ljust(n, "z")


@pytest.mark.parametrize("size", [50, 51, 57, 58, 74, 87, 88, 95, 133, 149, 150, 208, 394])
def test_every_passage_is_found(size):
    rng = random.Random(size)
    item, other = prose(rng, size), prose(rng, 120)
    index = Index([(1, item)])
    for at in range(size - PASSAGE + 1):
        assert 1 in index.find(normal(f"{other} {item[at : at + PASSAGE]} {other}"))
    assert not index.find(normal(f"{other} {item[: LEAST - 4]} {other}"))


@pytest.mark.parametrize("size", [58, 74, 95, 133, 208])
def test_a_replaced_word_and_a_lost_end(size):
    rng = random.Random(size)
    item = prose(rng, size)
    index = Index([(1, item)])
    for at in range(size - 7):
        assert 1 in index.find(normal(item[:at] + "xxxxxxx" + item[at + 7 :]))
    assert 1 in index.find(normal(item[:-8])) and 1 in index.find(normal(item[8:]))


def test_a_quotation_between_the_old_windows():
    rng = random.Random(3)
    item = prose(rng, 208)
    assert 1 in Index([(1, item)]).find(normal(item[25:140])) and WINDOW < 115


def test_short_items_are_whole_words():
    index = Index([(1, "Art of war"), (2, "art"), (3, "東京都"), (4, "")])
    assert set(index.find(normal("The ART of--war!"))) == {1, 2}
    assert not index.find(normal("a party of war"))
    assert index.find(normal("これは東京都です")) == {3: (0, 3, 6)}
    assert index.find(normal("art, then art")) == {2: (0, 0, 12)}


def test_repetitive_texts_take_no_more_memory():
    tracemalloc.start()
    text = normal("the answer is " * 16_000)
    assert Index([(1, "the answer is " * 60)]).find(text) == {1: (0, 0, len(text))}
    assert not Index([(1, "the answer is " * 60)]).find(normal("the answer was " * 16_000))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20


def test_small_parts_give_the_same(monkeypatch):
    rng = random.Random(5)
    items = [(k, prose(rng, 60 + 9 * k)) for k in range(30)]
    text = normal(" ".join(prose(rng, 200) + " " + t[5:-5] + " " + t.replace("a", "b", 1) for _, t in items))
    want = Index(items).find(text)
    for name, value in (("HITS", 7), ("ENTRIES", 50), ("TRIED", 3)):
        monkeypatch.setattr(decontaminate, name, value)
    assert want and set(want) >= {k for k, t in items} and Index(items).find(text) == want


def test_blocks_of_a_large_benchmark(spark, monkeypatch):
    rng = random.Random(6)
    items = [(k, prose(rng, 90)) for k in range(12)] + [(3, None)]
    docs = [(k, prose(rng, 50) + " " + t[20:80]) for k, t in items if t] + [(100, prose(rng, 300)), (101, None)]
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, find_leaks(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 300)
    assert len(decontaminate._blocks(items)) > 2
    assert sorted(map(tuple, find_leaks(docs, items).collect())) == whole and {r[:2] for r in whole} == {(k, k) for k in range(12)}
    assert sorted(r.doc_id for r in without_leaks(docs, items).collect()) == [100, 101]
