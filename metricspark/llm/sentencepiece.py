"""SentencePiece encoding by batched Viterbi, and decoding.

The vocabulary is a public model file; its pieces are scored as a unigram model.  A text becomes
units that no piece can cross: runs of spaces with the word behind them, cut at characters that
only stand alone in the vocabulary.  Equal units are encoded once per group of texts; units of equal
length advance together: the hashes of all their substrings probe the sorted hashes of the pieces,
and at each end position one vectorised maximum stores the back pointer.  A character without a piece
becomes its UTF-8 bytes, so decoding gives back every text exactly.

The model file ranks its pieces by merge order, so a piece of rank r scores -ln(r + 1) (Zipf's
law).  The encoding has the greatest total score; of equal ones, the longest last piece wins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import text as T

SPACE = 0x2581
#: Stands for a space mark that is in the text itself: it is encoded by its bytes.
_LITERAL = 0x110000
#: A character without a piece scores this much less than the worst piece.
UNKNOWN_PENALTY = 10.0
_B = np.uint64(0x9E3779B97F4A7C15)
#: Cells of one batch of equal-length units.
_CELLS = 1 << 18


def default_model() -> str:
    """Path of the public 32,000-piece model on this machine."""
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def _mix(cps: np.ndarray) -> np.ndarray:
    return T.mix(cps.astype(np.uint64) + np.uint64(1))


class Vocabulary:
    """The pieces of a model, as sorted substring hashes with scores and ids."""

    def __init__(self, model_file: str):
        import sentencepiece
        m = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        self.byte_id = np.zeros(256, np.int32)
        self.bytes: list[bytes] = [b""] * len(pieces)
        normal = []
        for i, p in enumerate(pieces):
            if m.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
                self.bytes[i] = bytes([int(p[3:5], 16)])
            elif not (m.is_unknown(i) or m.is_control(i) or m.is_unused(i)):
                normal.append(i)
                self.bytes[i] = p.replace(chr(SPACE), " ").encode()
        order = sorted(normal, key=lambda i: (-m.get_score(i), i))
        self.score = {i: -float(np.log(r + 1.0)) for r, i in enumerate(order, 1)}
        self.longest = max(len(pieces[i]) for i in normal)
        keys, ids = [], []
        for i in normal:
            cps = np.array([ord(c) for c in pieces[i]], np.uint32)
            keys.append(self._hash(cps))
            ids.append(i)
        by_hash = np.argsort(np.array(keys, np.uint64))
        self.keys = np.array(keys, np.uint64)[by_hash]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have one hash")
        self.ids = np.array(ids, np.int32)[by_hash]
        self.scores = np.array([self.score[i] for i in ids])[by_hash]
        self.unknown = float(self.scores.min()) - UNKNOWN_PENALTY
        joined = np.unique([ord(c) for i in normal if len(pieces[i]) > 1 for c in pieces[i]])
        self.joined = joined.astype(np.uint32)

    @staticmethod
    def _hash(cps: np.ndarray) -> np.uint64:
        h = np.uint64(0)
        with np.errstate(over="ignore"):
            for x in _mix(cps):
                h = h * _B + x
        return h

    def viterbi(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of units of one length (rows of code points): a matrix filled from the right, and the
        number of pieces of each.  A character without a piece c stands as -c - 1."""
        m, n = units.shape
        prefix = np.zeros((m, n + 1), np.uint64)
        for j in range(n):
            prefix[:, j + 1] = prefix[:, j] * _B + _mix(units[:, j])
        best = np.full((m, n + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((m, n + 1), np.int32)
        piece = np.zeros((m, n + 1), np.int32)
        power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(self.longest, _B)]))
        rows = np.arange(m)
        for j in range(1, n + 1):
            most = min(j, self.longest)
            sizes = np.arange(most, 0, -1)
            h = prefix[:, j:j + 1] - prefix[:, j - sizes] * power[sizes]
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            hit = self.keys[at] == h
            score = np.where(hit, self.scores[at], -np.inf)
            score[:, -1] = np.where(hit[:, -1], score[:, -1], self.unknown)
            score += best[:, j - sizes]
            k = score.argmax(axis=1)
            best[:, j] = score[rows, k]
            back[:, j] = sizes[k]
            piece[:, j] = np.where(hit[rows, k], self.ids[at[rows, k]], -units[:, j - 1].astype(np.int32) - 1)
        out, count = np.zeros((m, n), np.int32), np.zeros(m, np.int64)
        pos, live = np.full(m, n), rows
        while len(live):
            at = pos[live]
            count[live] += 1
            out[live, n - count[live]] = piece[live, at]
            pos[live] = at - back[live, at]
            live = live[pos[live] > 0]
        return out, count

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the offsets of each text's ids (an empty or missing text has none)."""
        flats, sizes = [np.empty(0, np.int32)], [0]
        for lo, hi in T.groups(texts):
            ids, counts = self._encode_group([t or "" for t in texts[lo:hi]])
            flats.append(ids)
            sizes.extend(counts.tolist())
        return np.concatenate(flats), np.cumsum(sizes)

    def _encode_group(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        marks = [" " + t if t else "" for t in texts]
        cps = np.frombuffer("".join(marks).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        begins = np.cumsum([0, *map(len, marks)])
        if not len(cps):
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        cps[cps == SPACE] = _LITERAL
        space = cps == 32
        cps[space] = SPACE
        alone = ~np.isin(cps, self.joined)
        cut = np.ones(len(cps), bool)
        cut[1:] = (space[1:] & ~space[:-1]) | alone[1:] | alone[:-1]
        cut[begins[:-1][begins[:-1] < len(cps)]] = True
        starts = np.flatnonzero(cut)
        lengths = np.diff(starts, append=len(cps))
        names = self._unit_hashes(cps, starts, lengths)
        _, first, which = np.unique(names, return_index=True, return_inverse=True)
        ids, offsets = self._encode_units(cps, starts[first], lengths[first])
        unit_of_text = np.searchsorted(starts, begins)
        counts = np.diff(offsets)[which]
        flat = ids[_ranges(offsets[which], counts)]
        per_text = np.diff(np.concatenate([[0], np.cumsum(counts)])[unit_of_text])
        return flat, per_text

    @staticmethod
    def _unit_hashes(cps, starts, lengths) -> np.ndarray:
        value = _mix(cps)
        out = np.zeros(len(starts), np.uint64)
        live, j = np.arange(len(starts)), 0
        while len(live):
            out[live] = (out[live] * _B) ^ T.mix(value[starts[live] + j])
            j += 1
            live = live[lengths[live] > j]
        return T.mix(out + lengths.astype(np.uint64))

    def _encode_units(self, cps, starts, lengths) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each unit (characters without a piece as bytes), and their offsets."""
        parts, order, counts = [], [], []
        for n in np.unique(lengths):
            same = np.flatnonzero(lengths == n)
            step = max(1, _CELLS // int(n))
            for lo in range(0, len(same), step):
                some = same[lo:lo + step]
                out, count = self.viterbi(cps[starts[some][:, None] + np.arange(n)])
                keep = np.arange(n) >= (n - count)[:, None]
                parts.append(out[keep])
                order.append(some)
                counts.append(count)
        flat, order, counts = np.concatenate(parts), np.concatenate(order), np.concatenate(counts)
        flat, counts = self._spell(flat, counts)
        offsets = np.cumsum(np.concatenate([[0], counts]))
        back = np.argsort(order)
        sizes = counts[back]
        return flat[_ranges(offsets[:-1][back], sizes)], np.concatenate([[0], np.cumsum(sizes)])

    def _spell(self, flat, counts):
        """Characters without a piece as the ids of their UTF-8 bytes."""
        bad = np.flatnonzero(flat < 0)
        if not len(bad):
            return flat, counts
        chars = -flat[bad] - 1
        chars[chars == _LITERAL] = SPACE
        raw = [chr(c).encode("utf-8", "surrogatepass") for c in chars]
        size = np.ones(len(flat), np.int64)
        size[bad] = [len(r) for r in raw]
        ends = np.cumsum(size)
        out = np.repeat(flat, size)
        out[_ranges(ends[bad] - size[bad], size[bad])] = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return out, np.diff(edges)

    def decode(self, ids) -> str:
        """The text of a list of ids."""
        return b"".join([self.bytes[i] for i in ids]).decode("utf-8", "surrogatepass")[1:]


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of each range, joined."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(starts - ends + counts, counts)


def encode(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_pieces``, ``ids`` and ``round_trip`` (decoding the ids
    gives the text back).

    A missing or empty text has no ids; missing ids stay missing; repeated rows each get their row; other
    columns are ignored.  The vocabulary (32,000 pieces) is the only thing broadcast.
    """
    spark = docs.sparkSession
    T.prepared(spark)
    shared = spark.sparkContext.broadcast(Vocabulary(model_file or default_model()))

    def run(batches):
        v = shared.value
        for b in batches:
            texts = b.column("text").to_pylist()
            for lo, hi in T.groups(texts):
                ids, offsets = v.encode(texts[lo:hi])
                same = [v.decode(ids[s:e].tolist()) == (t or "") for t, s, e in zip(texts[lo:hi], offsets[:-1], offsets[1:])]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(offsets), pa.int64()),
                     T.lists(ids, offsets, pa.int32()), pa.array(same, pa.bool_())],
                    names=["doc_id", "n_pieces", "ids", "round_trip"])

    return T.doc_columns(docs).mapInArrow(run, "doc_id long, n_pieces long, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, model_file: str | None = None) -> DataFrame:
    """``doc_id`` and ``text`` of a table with ``doc_id`` and ``ids`` (a missing list has a missing text)."""
    spark = encoded.sparkSession
    T.prepared(spark)
    shared = spark.sparkContext.broadcast(Vocabulary(model_file or default_model()))

    def run(batches):
        for b in batches:
            text = [None if x is None else shared.value.decode(x) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(text, pa.string())], names=["doc_id", "text"])

    return encoded.selectExpr("cast(doc_id AS long) AS doc_id", "cast(ids AS array<int>) AS ids").mapInArrow(
        run, "doc_id long, text string")
