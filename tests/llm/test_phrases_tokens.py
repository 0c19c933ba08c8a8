"""Repeated passages by block and automaton; token spans of texts with very long runs."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from metricspark.llm import phrases, tokens

W = phrases.WINDOW


def removed(rows):
    """(doc_id, words, removed words, digest of the kept ones) of each row, by looking at every window."""
    words = [(t or "").encode().split() for _, t in rows]
    first = {}
    for i, w in sorted(zip([i for i, _ in rows], words), key=lambda r: r[0]):
        for k in range(len(w) - W + 1):
            first.setdefault(tuple(w[k:k + W]), i)
    out = []
    for (i, _), w in zip(rows, words):
        gone = {j for k in range(len(w) - W + 1) if first[tuple(w[k:k + W])] < i for j in range(k, k + W)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def pieces(seed):
    """Documents made of overlapping pieces of one text, and texts of two words; some ids repeat."""
    rnd = random.Random(seed)
    source = [f"s{k}" for k in range(300)]
    rows = [(100, " ".join(source))]
    for i in range(60):
        a, b = rnd.randrange(280), rnd.randrange(280)
        rows.append((rnd.randrange(50, 160), "  ".join(source[a:a + rnd.randrange(40)] + source[b:b + rnd.randrange(40)]
                                                        + source[a + 3:a + 20])))
        rows.append((rnd.randrange(300), "\n".join(rnd.choice("ab") for _ in range(rnd.randrange(40)))))
    return rows


@pytest.mark.parametrize("block_bytes, batch_rows", [(8_000_000, 10_000), (3_000, 10_000), (3_000, 7)])
def test_passages_in_blocks_and_batches(spark, monkeypatch, block_bytes, batch_rows):
    monkeypatch.setattr(phrases, "BLOCK_BYTES", block_bytes)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, batch_rows)
    try:
        rows = pieces(block_bytes + batch_rows)
        got = phrases.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        spark.conf.set(name, before)
    assert sorted(map(tuple, got)) == removed(rows)


def test_the_filter_holds_the_anchors_and_no_others(spark):
    rng = np.random.default_rng(2)
    anchors = np.unique(rng.integers(0, 1 << phrases.ANCHOR_BITS, 3000))
    bits = phrases.anchor_filter(spark.createDataFrame([(int(a),) for a in anchors], "anchor long"), 1 << 22)
    want = np.zeros(1 << 22, bool)
    want[anchors & ((1 << 22) - 1)] = True
    assert (np.unpackbits(bits.view(np.uint8), bitorder="little").astype(bool) == want).all()
    assert not phrases.anchor_filter(spark.createDataFrame([], "anchor long"), 1 << 20).any()
    assert [phrases.filter_bits(n).bit_length() - 1 for n in (0, 10**9, 10**10, 5 * 10**10, 10**14)] == [28, 28, 29, 31, 31]


def test_a_batch_sends_the_windows_of_its_least_document():
    node, at, window = (np.array(v) for v in ([9, 3, 3, 5, 9, 4], [0, 7, 2, 1, 1, 0], [1, 1, 1, 1, 2, 3]))
    first, later = phrases.within_batch(node, at, window)
    assert list(zip(node[first], at[first])) == [(3, 2)] * 4 + [(9, 1), (4, 0)]
    assert later.tolist() == [True, False, False, True, False, False]


def test_a_forged_hash_hit_is_refused():
    """A block is sent a passage of an earlier document that its documents do not hold."""
    own = " ".join(f"w{k}" for k in range(40))
    docs = pa.table({"doc_id": [7], "text": [own], "node": [7]})

    def run(passages):
        return phrases._block(None, docs, pa.table({"first": pa.array([3] * len(passages), pa.int64()),
                                                    "passage": pa.array(passages, pa.string())})).to_pylist()[0]

    other = " ".join(f"w{k}" for k in range(12)) + " other"
    assert run([other])["n_removed"] == 0 and run([])["n_removed"] == 0
    assert run([other, " ".join(f"w{k}" for k in range(5, 18))])["n_removed"] == 13


def test_words_have_letters_of_their_own():
    """Matches begin with a word: no part of one word's letters and the next one's makes a third word."""
    words = [f"v{k}".encode() for k in range(500)]
    found = phrases.compiled([(words[k:k + W], 1) for k in range(0, 480, 7)])
    automaton, letters = found
    assert len(set(letters.values())) == len(letters) and {len(v) for v in letters.values()} == {3}
    alphabets = [{v[d] for v in letters.values()} for d in range(3)]
    assert not alphabets[0] & alphabets[1] and not alphabets[1] & alphabets[2] and not alphabets[0] & alphabets[2]
    assert phrases.removals(words[7:20], 5, found).all() and not phrases.removals(words[8:21], 5, found).any()
    assert not phrases.removals(words[7:20], 1, found).any()


def test_runs_follow_both_documents():
    def column(*v):
        return np.array(v, np.int64)

    batch = pa.RecordBatch.from_pydict({"node": column(5, 5, 5, 5, 6), "at": column(0, 1, 2, 3, 4),
                                        "first": column(1, 1, 1, 2, 2), "first_at": column(7, 8, 11, 12, 13)})
    got = pa.Table.from_batches(phrases._runs([batch])).to_pylist()
    assert [(r["node"], r["first"], r["first_at"], r["size"]) for r in got] == [
        (5, 1, 7, 2), (5, 1, 11, 1), (5, 2, 12, 1), (6, 2, 13, 1)]


@pytest.fixture(scope="module")
def tokenizer():
    t = tokens.Tokenizer(tokens.default_ranks())
    t.spans("a")
    return t


LONG = [" " * 1_000_000, "\n" * 1_000_000, "x" * 1_000_000, "a " + " \n" * 600_000 + "bc", "x\t" + "　" * 400_000]


@pytest.mark.parametrize("k", range(len(LONG)))
def test_spans_of_long_runs_tile_the_text(tokenizer, k):
    first, last = tokenizer.spans(LONG[k])
    assert first[0] == 0 and last[-1] == len(LONG[k]) - 1
    assert ((first[1:] == last[:-1] + 1) | (first[1:] == last[:-1])).all()  # tokens inside a character share it


def test_cutting_at_white_space_leaves_the_ids(tokenizer, monkeypatch):
    monkeypatch.setattr(tokens, "_LONG", re.compile(tokens._LONG.pattern.replace(str(tokens.LONG_RUN), "2")))
    rnd = random.Random(5)
    for _ in range(5000):
        x = "".join(rnd.choice([" ", " ", "\n", "\t", "a", "B", "é", "1", "!", "'s", "　", "\xa0", "\x1c", "\x85"])
                    for _ in range(rnd.randrange(30)))
        assert tokenizer.encode(x) == tokenizer._encoder.encode_ordinary(x)


def brute_spans(t, x):
    """First and last character of every token, one token at a time."""
    by_id, out, at = {r: w for w, r in t.ranks.items()}, [], 0
    for token in t._encoder.encode_ordinary(x):
        head, at = x.encode()[:at], at + len(by_id[token])
        out.append((len(head.decode("utf-8", "ignore")), len(x.encode()[:at].decode("utf-8", "replace")) - 1))
    return out


def test_spans_against_one_token_at_a_time(tokenizer):
    for x in ("a", "Hello, world\n\n  x", "é日本 \U0001F600\U0001F601!", " \n \n", "naïve—test 123"):
        first, last = tokenizer.spans(x)
        assert list(zip(first, last)) == brute_spans(tokenizer, x)


def test_documents_with_long_runs(spark):
    rows = [(k, x) for k, x in enumerate(LONG)]
    got = tokens.by_section(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("doc_id").sum("n_tokens").collect()
    totals = tokens.by_section(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "doc_tokens").distinct()
    assert {r[0]: r[1] for r in got} == {r[0]: float(r[1]) for r in totals.collect()} and len(got) == len(LONG)
