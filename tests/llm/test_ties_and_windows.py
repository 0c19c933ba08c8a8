"""Edited benchmark items against a search over all windows; ties of windows and of pieces."""

import random

import numpy as np

from metricspark.llm import decontam
from metricspark.llm.sentencepiece import Vocabulary


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return row[-1]


def every_window(docs, items):
    """(doc, item) -> least distance of all windows, where it is within the bound."""
    out = {}
    for d, text in docs:
        words = text.split()
        for i, item in items:
            want = item.split()
            most = int(decontam.MAX_EDITS * len(want))
            best = min((distance(want, words[p:p + n]) for p in range(len(words))
                        for n in range(len(want) - most, len(want) + most + 1) if p + n <= len(words)), default=most + 1)
            if best <= most:
                out[d, i] = best
    return out


def test_edited_items_against_all_windows(spark):
    rnd = random.Random(11)
    names = [f"n{k}" for k in range(60)]
    items = [(k, " ".join(rnd.choices(names, k=rnd.randrange(10, 18)))) for k in range(8)]
    docs = []
    for d in range(150):
        words = rnd.choices(names, k=rnd.randrange(5, 25))
        if d % 3:
            planted = rnd.choice(items)[1].split()
            for _ in range(rnd.randrange(5)):
                at = rnd.randrange(len(planted))
                edit = rnd.randrange(3)
                planted[at:at + (edit < 2)] = [] if edit == 0 else [rnd.choice(names)]
            at = rnd.randrange(len(words))
            words[at:at] = planted
        docs.append((d, " ".join(words)))
    want = every_window(docs, items)
    got = {(r.doc_id, r.item_id): r for r in decontam.leaks(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got.keys() <= want.keys() and len(got) >= 0.9 * len(want) and len(want) > 25
    for key, r in got.items():
        words, item = docs[key[0]][1].split(), items[key[1]][1].split()
        assert distance(item, words[r.first_word:r.first_word + r.n_words]) == r.distance >= want[key]
    assert all(key in got for key, d in want.items() if d == 0)


def test_the_first_of_equal_windows(spark):
    item = " ".join(f"i{k}" for k in range(12))
    docs = spark.createDataFrame([(1, f"a b c {item} d {item} e"), (2, f"{item} {item}")], "doc_id long, text string")
    got = {r.doc_id: (r.first_word, r.distance) for r in decontam.leaks(
        docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert got == {1: (3, 0), 2: (0, 0)}


def test_the_longest_last_piece_of_equal_scores():
    v = Vocabulary.__new__(Vocabulary)
    pieces = {"a": -1.0, "c": -1.0, "ab": -2.0, "bc": -2.0, "b": -9.0, "abc": -3.5}
    keys = np.array([Vocabulary._hash(np.array([ord(x) for x in p], np.uint32)) for p in pieces], np.uint64)
    order = np.argsort(keys)
    v.keys, v.ids, v.scores = keys[order], np.arange(len(pieces), dtype=np.int32)[order], np.array(list(pieces.values()))[order]
    v.longest, v.unknown = 3, -20.0
    names = list(pieces)

    def best(text):
        ids, counts = v.viterbi(np.array([[ord(x) for x in text]], np.uint32))
        return [names[i] for i in ids[0, len(text) - counts[0]:]]
    assert best("abc") == ["a", "bc"]          # -3 as for "ab" + "c"
    assert best("aabcc") == ["a", "a", "bc", "c"]
