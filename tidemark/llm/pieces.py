"""SentencePiece encoding and decoding with seeded merge dropout (operator 3).

Texts become symbols, one for each code point, after one space that the model
expects in front.  Pairs of neighbouring symbols whose joined piece is in the
vocabulary are the agenda, ordered by the piece's score and then from the left;
a merge puts the pairs that it makes on the agenda.  Merge dropout skips a
candidate for good when a keyed hash of (seed, document, word, its span and
split) falls below the rate, so a text's segmentation depends on seed and
document only, not on batches or executors.  Symbols outside the vocabulary
become byte pieces.  Without dropout, the tokens are those of the public library.

Decoding joins the pieces' bytes and drops the space in front.  It restores
every text byte for byte, at any rate: spaces are the marker piece, and a
marker that stands in the text itself is spelled as bytes.

The words of a slice of texts go through each round of merges together.

Defined results: a null text has no tokens and decodes to an empty text; an
empty text likewise; repeated rows get the same tokens; a null id counts as an
id of its own in the hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.base import byte_slices, read
from tidemark.llm.wordhash import Spans, flat, mix

#: The public tokenizer that the query uses, its dropout and its seed.
MODEL, DROPOUT, SEED = "/opt/tokenizers/piece_bpe_32k.model", 0.1, 17
#: The marker that stands for a space in pieces, and a rank behind all others.
MARKER, NEVER = "▁", np.int32(1 << 30)
#: Bytes of text that go through the merges together.
SLICE = 256 << 10
_SLOT_BITS = 21


@dataclass
class Pieces:
    """A vocabulary as arrays: merges by pair, ranks, single code points, and every piece's bytes."""

    rank: np.ndarray
    of_point: np.ndarray
    slot_pair: np.ndarray
    slot_piece: np.ndarray
    spill_pair: np.ndarray
    spill_piece: np.ndarray
    body: np.ndarray
    begin: np.ndarray
    byte_base: int

    @classmethod
    def load(cls, model: bytes) -> Pieces:
        import sentencepiece

        vocab = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = vocab.vocab_size()
        names = [vocab.id_to_piece(i) for i in range(n)]
        plain = [not (vocab.is_control(i) or vocab.is_unknown(i) or vocab.is_byte(i) or vocab.is_unused(i)) for i in range(n)]
        at = {p: i for i, p in enumerate(names) if plain[i]}
        scores = np.array([vocab.get_score(i) for i in range(n)])
        rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        of_point = np.full(0x110000, -1, np.int32)
        pairs = {}
        for piece, i in at.items():
            if len(piece) == 1 and piece != MARKER:
                of_point[ord(piece)] = i
            for k in range(1, len(piece)):
                left, right = at.get(piece[:k]), at.get(piece[k:])
                if left is not None and right is not None:
                    pairs[left * n + right] = i
        of_point[32] = at.get(MARKER, -1)
        keys, values = np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int32)
        slot_pair, slot_piece = np.full(1 << _SLOT_BITS, -1, np.int64), np.full(1 << _SLOT_BITS, -1, np.int32)
        slots = cls._slot(keys)
        _, first = np.unique(slots, return_index=True)
        slot_pair[slots[first]], slot_piece[slots[first]] = keys[first], values[first]
        rest = np.setdiff1d(np.arange(len(keys)), first)
        rest = rest[np.argsort(keys[rest])]
        byte_base = next(i for i in range(n) if vocab.is_byte(i))
        spelled = [p.replace(MARKER, " ").encode() if ok else b"" for p, ok in zip(names, plain, strict=True)]
        for b in range(256):
            spelled[byte_base + b] = bytes([b])
        begin = np.r_[0, np.cumsum([len(s) for s in spelled])]
        return cls(rank, of_point, slot_pair, slot_piece, keys[rest], values[rest], np.frombuffer(b"".join(spelled), np.uint8), begin, byte_base)

    @staticmethod
    def _slot(pairs: np.ndarray) -> np.ndarray:
        return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair of pieces makes, or -1."""
        pairs = left.astype(np.int64) * len(self.rank) + right
        slots = self._slot(pairs)
        out = np.where(self.slot_pair[slots] == pairs, self.slot_piece[slots], np.int32(-1))
        if len(self.spill_pair):
            lost = np.flatnonzero((out < 0) & (self.slot_pair[slots] >= 0))
            at = np.minimum(np.searchsorted(self.spill_pair, pairs[lost]), len(self.spill_pair) - 1)
            out[lost] = np.where(self.spill_pair[at] == pairs[lost], self.spill_piece[at], -1)
        out[(left < 0) | (right < 0)] = -1
        return out

    def _look(self, ids: np.ndarray, nxt: np.ndarray, key: np.ndarray, row: np.ndarray, at: np.ndarray, limit: np.uint64 | None) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of the pairs that start at symbols ``at`` of chunks ``row``, if they are on the agenda."""
        width = ids.shape[1]
        after = nxt[row, at]
        inside = after < width
        right = np.where(inside, after, 0)
        piece = self.joined(ids[row, at], np.where(inside, ids[row, right], -1))
        if limit is not None:
            ok = np.flatnonzero(piece >= 0)
            span = (at[ok].astype(np.int64) << 42) + (right[ok].astype(np.int64) << 21) + nxt[row[ok], right[ok]]
            piece[ok[mix(span.astype(np.uint64) ^ key[row[ok]]) < limit]] = -1
        return np.where(piece >= 0, self.rank[piece], NEVER), piece

    def _merge(self, ids: np.ndarray, key: np.ndarray, limit: np.uint64 | None) -> np.ndarray:
        """Runs the agendas of chunks, a row each; merged-away symbols become -2.

        A round takes from every chunk's agenda the pair of best rank, the
        leftmost of equals, and puts the pairs that it makes on the agenda.
        """
        n, width = ids.shape
        out = ids
        nxt = np.tile(np.arange(1, width + 1, dtype=np.int32), (n, 1))
        prv = nxt - 2
        row, at = np.divmod(np.arange(n * width), width)
        rank, piece = (x.reshape(n, width) for x in self._look(ids, nxt, key, row, at, limit))
        which = np.arange(n)
        while True:
            at = rank.argmin(1)
            row = np.arange(len(which))
            live = rank[row, at] < NEVER
            if not live.all():
                if 2 * live.sum() < len(live):
                    out[which] = ids
                    ids, nxt, prv, rank, piece, key, which, at = (x[live] for x in (ids, nxt, prv, rank, piece, key, which, at))
                    row = np.arange(len(which))
                else:
                    row, at = row[live], at[live]
                if not len(row):
                    break
            right = nxt[row, at]
            ids[row, at], ids[row, right] = piece[row, at], -2
            rank[row, right] = NEVER
            after = nxt[row, right]
            nxt[row, at] = after
            some = after < width
            prv[row[some], after[some]] = at[some]
            rank[row, at], piece[row, at] = self._look(ids, nxt, key, row, at, limit)
            before = prv[row, at]
            some = before >= 0
            row, before = row[some], before[some]
            rank[row, before], piece[row, before] = self._look(ids, nxt, key, row, before, limit)
        out[which] = ids
        return out

    def encode(self, texts: pa.Array, keys: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the tokens of all texts, and where each text's begin and the last's end; keys seed the dropout.

        No piece holds a marker after another symbol, so merges stay within
        chunks: some spaces and what follows up to the next space or unknown
        symbol.  Equal chunks of a text have equal merges and are done once.
        """
        data, offsets = flat(texts)
        full = np.flatnonzero(np.diff(offsets))
        if not len(full):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        fronted = np.insert(data, offsets[full], 32)
        points = np.frombuffer(fronted.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = np.r_[np.flatnonzero((fronted & 0xC0) != 0x80), len(fronted)]
        first = np.searchsorted(lead, offsets[full] + np.arange(len(full)))
        symbols = self.of_point[points]
        space, unknown = points == 32, symbols < 0
        begins = unknown | (space & ~np.r_[False, space[:-1]]) | np.r_[True, unknown[:-1]]
        begins[first] = True
        start = np.flatnonzero(begins)
        stop = np.r_[start[1:], len(points)]
        row = np.searchsorted(first, start, side="right") - 1
        key = mix(Spans(fronted, fold=False).hashes(lead[start], lead[stop]) ^ (keys[full[row]] if rate > 0 else np.uint64(0)))
        _, one, back = np.unique(key, return_index=True, return_inverse=True)
        limit = np.uint64(min(int(rate * 2.0**64), (1 << 64) - 1)) if rate > 0 else None
        size = (stop - start)[one]
        count, parts = np.zeros(len(one), np.int64), []
        width = 1
        while (size > 0).any():
            now = np.flatnonzero((size > 0) & (size <= width))
            for some in np.array_split(now, max(1, len(now) * width >> 18)):
                if not len(some):
                    continue
                places = start[one[some]][:, None] + np.arange(width)
                inside = np.arange(width) < size[some][:, None]
                ids = np.where(inside, symbols[np.minimum(places, len(points) - 1)], np.int32(-2))
                if width > 1:
                    ids = self._merge(ids, key[one[some]], limit)
                got = ids != -2
                count[some] = got.sum(1)
                parts.append((some, ids[got]))
            size[now] = 0
            width = width + 1 if width < 8 else width * 5 // 4
        begin = np.zeros(len(one), np.int64)
        at = 0
        for some, ids in parts:
            begin[some] = at + np.cumsum(count[some]) - count[some]
            at += len(ids)
        pool = np.concatenate([ids for _, ids in parts])
        counts = count[back]
        ends = np.cumsum(counts)
        out = pool[np.repeat(begin[back] - (ends - counts), counts) + np.arange(ends[-1])]
        lone = np.flatnonzero(unknown[start])  # spelled in bytes
        spelled = np.ones(len(out), np.int64)
        spelled[ends[lone] - 1] = lead[stop[lone]] - lead[start[lone]]
        per_text = np.zeros(len(texts), np.int64)
        np.add.at(per_text, full, np.add.reduceat(spelled, (ends - counts)[np.searchsorted(start, first)]))
        if len(lone):
            place = np.cumsum(spelled) - spelled
            out = np.repeat(out, spelled)
            wide = spelled[ends[lone] - 1]
            step = np.arange(wide.sum()) - np.repeat(np.cumsum(wide) - wide, wide)
            out[np.repeat(place[ends[lone] - 1], wide) + step] = fronted[np.repeat(lead[start[lone]], wide) + step].astype(np.int32) + self.byte_base
        return out.astype(np.int32), np.r_[0, np.cumsum(per_text)]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The texts of token lists."""
        sizes = np.diff(self.begin)[ids]
        total = np.r_[0, np.cumsum(sizes)]
        body = self.body[np.repeat(self.begin[ids] - total[:-1], sizes) + np.arange(total[-1])]
        edges = total[ends]
        full = np.flatnonzero(np.diff(edges))
        body = np.delete(body, edges[full])
        cut = edges - np.searchsorted(full, np.arange(len(edges)))
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(cut.astype(np.int64).tobytes()), pa.py_buffer(body.tobytes())])


def _vocabulary(spark: SparkSession, model: str):
    with open(model, "rb") as f:
        return spark.sparkContext.broadcast(Pieces.load(f.read()))


def encode(docs: DataFrame, model: str = MODEL, rate: float = DROPOUT, seed: int = SEED, restored: bool = False) -> DataFrame:
    """docs(doc_id, text) to doc_id and tokens, a list of piece ids.

    With ``restored``, also n_bytes and text_sha256 of the text that the tokens decode to.
    """
    held = _vocabulary(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = mix(batch.column("turn").to_numpy().view(np.uint64) ^ mix(np.array([seed], np.uint64)))
            for a, b in byte_slices(batch.column("text"), SLICE):
                ids, ends = held.value.encode(batch.column("text").slice(a, b - a), keys[a:b], rate)
                columns = [batch.column("doc_id").slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))]
                if restored:
                    texts = held.value.decode(ids, ends).to_pylist()
                    columns += [pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tokens", "n_bytes", "text_sha256"][: len(columns)])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id").alias("turn"))
    return rows.mapInArrow(run, "doc_id long, tokens array<int>" + ", n_bytes long, text_sha256 string" * restored)


def decode(tokens: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, tokens) to doc_id and text."""
    held = _vocabulary(tokens.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            texts = held.value.decode(lists.flatten().to_numpy(), np.r_[0, np.cumsum(sizes)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts.cast(pa.binary()).cast(pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "tokens").mapInArrow(run, "doc_id long, text string")


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its number of tokens, a hash of them, and the decoded text's size and SHA-256."""
    tokens = encode(read(spark, sf_dir, "documents"), restored=True)
    return tokens.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.xxhash64("tokens").alias("tokens_hash"), "n_bytes", "text_sha256")


QUERIES = {"op3_pieces": op3_pieces}
ORACLES: dict[str, str] = {}
