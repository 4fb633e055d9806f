"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Each merge rank owns a bucket of linked-list positions; a three-level bitmap of 64-bit words says which buckets are in
use, and find-first-set walks it to the lowest rank. Entries whose pair has changed since they were queued are skipped
when met. A pre-token of n bytes takes O(n log n) however long it is, so megabyte runs without a break are fine.

Nulls encode as the empty text. Rows, repeats and extra columns: one output row for each input row, by its own id.
"""

from __future__ import annotations

import base64
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lodestone.llm._text import blocks, same_spans, settle, span_hashes

#: Pre-tokens in each of the two generations that a task remembers, and the longest of them in bytes.
REMEMBERED, REMEMBERED_BYTES = 1 << 16, 64
#: Patterns (fixed values) whose pre-tokens ``split_by_kind`` finds; others go through the pattern itself.
SPLIT_BY_KIND = (r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""",)
#: Positions in a bucket from which they are merged together.
TOGETHER = 48
#: Bytes of text that a worker encodes at once; a longer text goes alone.
BLOCK = 1 << 20


class RankQueue:
    """Buckets of positions by merge rank; ``take`` hands over the whole bucket of the lowest rank in use."""

    def __init__(self, ranks: int):
        top = max(ranks, 1)
        self.low = [0] * (top // 64 + 1)
        self.mid = [0] * (top // 4096 + 1)
        self.high = 0
        self.buckets: dict[int, list[int]] = {}

    def fill(self, rank: int, positions: list[int]) -> None:
        held = self.buckets.get(rank)
        if held is None:
            self.buckets[rank] = positions
            self.low[rank >> 6] |= 1 << (rank & 63)
            self.mid[rank >> 12] |= 1 << ((rank >> 6) & 63)
            self.high |= 1 << (rank >> 12)
        else:
            held += positions

    def take(self) -> tuple[int, list[int]] | None:
        """The lowest rank and its positions from left to right, or None."""
        if not self.high:
            return None
        a = (self.high & -self.high).bit_length() - 1
        b = a << 6 | ((m := self.mid[a]) & -m).bit_length() - 1
        rank = b << 6 | ((w := self.low[b]) & -w).bit_length() - 1
        bucket = self.buckets.pop(rank)
        self.low[b] &= ~(1 << (rank & 63))
        if not self.low[b]:
            self.mid[a] &= ~(1 << (b & 63))
            if not self.mid[a]:
                self.high &= ~(1 << a)
        bucket.sort()
        return rank, bucket


_LETTER, _NUMBER, _SPACE, _OTHER = range(4)


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Of each code point: letter, number, white space or other, as the pattern engine has it."""
    out = np.full(0x110000, _OTHER, dtype=np.uint8)
    for a in [*range(0, 0xD800, 0x800), *range(0xE000, 0x110000, 0x800)]:
        some = "".join(map(chr, range(a, a + 0x800)))
        for kind, cls in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
            for run in regex.finditer(cls, some):
                out[a + run.start() : a + run.end()] = kind
    return out


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of valid UTF-8, and the byte at which each starts."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at].astype(np.int32)
    wide = np.flatnonzero(lead >= 0xC0)
    if len(wide):
        padded = np.append(data, np.zeros(3, np.uint8)).astype(np.int32)
        x, w = lead[wide], at[wide]
        b, c, d = (padded[w + k] & 0x3F for k in (1, 2, 3))
        two, three = (x & 0x1F) << 6 | b, (x & 0x0F) << 12 | b << 6 | c
        lead[wide] = np.where(x < 0xE0, two, np.where(x < 0xF0, three, (x & 0x07) << 18 | b << 12 | c << 6 | d))
    return lead, at


def split_by_kind(data: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """Starts of pre-tokens under the pattern in ``SPLIT_BY_KIND``: runs of one kind, each with one blank before it.

    ``opens``: first bytes of the texts. Of a run of white space, the last character goes by itself unless the text ends
    there, and to the next pre-token if it is a blank. An apostrophe takes the letters of a contraction.
    """
    points, at = code_points(data)
    n = len(points)
    kind = _kinds()[points]
    fresh = np.zeros(n + 1, dtype=bool)  # where a text starts
    fresh[np.searchsorted(at, opens)] = True
    fresh[n] = True
    cut = fresh.copy()
    cut[1:n] |= kind[1:] != kind[:-1]
    space = kind == _SPACE
    last = space & cut[1:] & ~fresh[1:]  # the last character of a run that more text follows
    cut[:n] |= last
    joins = np.flatnonzero(last & (points == 32))
    cut[joins + 1] = False
    quote = np.flatnonzero((points[:-1] == 39) & cut[: n - 1] & ~fresh[1:n] & (kind[1:] == _LETTER)) if n > 1 else joins[:0]
    if len(quote):
        a = points[quote + 1]
        more = quote + 2
        inside = ~fresh[more]
        b = np.where(inside, points[np.minimum(more, n - 1)], 0)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ~one & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        cut[quote[one | two] + 1] = False
        cut[quote[one] + 2] = True
        cut[quote[two] + 3] = True
    return at[np.flatnonzero(cut[:n])]


class BytePairCodec:
    """Ranks by token bytes (a token's rank is its id); ``encode_*`` give ids, ``decode_packed`` gives bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        tokens = [b""] * (max(ranks.values(), default=0) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens])
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        splits = [(ranks[t[:k]] << 32 | ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        splits.sort()
        self.pair_keys = np.array([k for k, _ in splits] or [-1], dtype=np.int64)
        self.pair_ranks = np.array([r for _, r in splits] or [-1], dtype=np.int32)
        #: ids by pre-token: those met lately, and those met before that
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.queue = RankQueue(max(ranks.values(), default=0))
        self.single = np.array([ranks.get(bytes([i]), -1) for i in range(256)], dtype=np.int32)
        self.double = np.full(65536, -1, dtype=np.int32)
        for token, rank in ranks.items():
            if len(token) == 2:
                self.double[token[0] << 8 | token[1]] = rank

    @classmethod
    def from_file(cls, path: str, pattern: str) -> "BytePairCodec":
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        return cls({base64.b64decode(a): int(b) for a, b in pairs}, pattern)

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of pre-tokens, each merged by itself; one queue serves them all.

        The pieces lie in one buffer with an end mark after each. Merges of different pieces don't touch one another, so
        taking the lowest rank over all pieces takes the lowest rank within each.
        """
        if not pieces:
            return []
        ranks, queue = self.ranks.get, self.queue
        data = b"\0".join(pieces) + b"\0"
        n = len(data)
        raw = np.frombuffer(data, dtype=np.uint8)
        marks = np.cumsum([len(p) + 1 for p in pieces]) - 1
        ids = self.single[raw]
        ids[marks] = -2
        first = np.full(n, -1, dtype=np.int32)
        first[:-1] = self.double[raw[:-1].astype(np.int32) << 8 | raw[1:]]
        first[marks] = -1
        first[marks[marks > 0] - 1] = -1
        order = np.argsort(first, kind="stable")
        order = order[np.searchsorted(first[order], 0) :]
        if len(order):
            cuts = np.flatnonzero(np.diff(first[order])) + 1
            for at in np.split(order, cuts):
                queue.fill(int(first[at[0]]), at.tolist())
        token, pair = array("i", ids.tobytes()), array("i", first.tobytes())
        after, before = array("i", np.arange(1, n + 1, dtype=np.int32).tobytes()), array("i", np.arange(-1, n, dtype=np.int32).tobytes())
        fill, buckets = queue.fill, queue.buckets
        views = [np.frombuffer(x, dtype=np.int32) for x in (token, pair, after, before)]
        while (least := queue.take()) is not None:
            rank, bucket = least
            if len(bucket) >= TOGETHER and self._merge_together(rank, bucket, *views):
                continue
            for k, i in enumerate(bucket):
                if pair[i] != rank:
                    continue  # stale
                gone = after[i]
                end = after[gone]
                after[i] = end
                before[end] = i
                token[i] = rank
                token[gone] = pair[gone] = -1
                lowest = rank + 1
                if token[end] < 0:
                    pair[i] = -1
                elif (r := ranks(data[i : after[end]])) is None:
                    pair[i] = -1
                else:
                    pair[i] = r
                    if (held := buckets.get(r)) is None:
                        fill(r, [i])
                    else:
                        held.append(i)
                    lowest = r
                left = before[i]
                if left >= 0 and token[left] >= 0:
                    r = ranks(data[left:end])
                    if r is None:
                        pair[left] = -1
                    elif r != pair[left]:
                        pair[left] = r
                        if (held := buckets.get(r)) is None:
                            fill(r, [left])
                        else:
                            held.append(left)
                        if r < lowest:
                            lowest = r
                if lowest <= rank and k + 1 < len(bucket):  # what was made comes before the rest of this bucket
                    fill(rank, bucket[k + 1 :])
                    break
        ids = np.frombuffer(token, dtype=np.int32)
        live = ids >= 0
        ends = np.cumsum(live)[marks] * 4
        packed = ids[live].astype("<u4").tobytes()
        return [packed[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of tokens, -1 where there is no merge or no token."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (left >= 0) & (right >= 0), self.pair_ranks[at], -1)

    def _merge_together(self, rank: int, bucket: list[int], token, pair, after, before) -> bool:
        """Merge a whole bucket at once; False, with nothing done, where the order within it could matter."""
        at = np.array(bucket, dtype=np.int64)
        at = at[pair[at] == rank]
        if not len(at):
            return True
        gone = after[at]
        end = after[gone]
        if (pair[gone] == rank).any() or (pair[end] == rank).any():
            return False  # pairs that overlap or touch
        same = np.full(len(at), rank, dtype=np.int32)
        left = before[at]
        has_left = (left >= 0) & (token[left] >= 0)
        right_rank = self._ranks_of(same, token[end])
        left_rank = np.where(has_left, self._ranks_of(np.where(has_left, token[left], -1), same), -1)
        new = np.concatenate([right_rank, left_rank])
        if ((new >= 0) & (new <= rank)).any():
            return False
        token[at], token[gone], pair[gone] = rank, -1, -1
        after[at], before[end] = end, at
        pair[at] = right_rank
        pair[left[has_left]] = left_rank[has_left]
        where = np.concatenate([at, left])[new >= 0]
        new = new[new >= 0]
        order = np.argsort(new, kind="stable")
        new, where = new[order].tolist(), where[order].tolist()
        fill, first = self.queue.fill, 0
        for k in range(1, len(new) + 1):
            if k == len(new) or new[k] != new[first]:
                fill(new[first], where[first:k])
                first = k
        return True

    def encode_distinct(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of distinct pre-tokens; those met before are looked up."""
        young, old, known = self.young, self.old, self.ranks
        out = list(map(young.get, pieces))
        missed = [k for k, ids in enumerate(out) if ids is None]
        rest = []
        for k in missed:
            p = pieces[k]
            ids = old.get(p)
            if ids is None and (rank := known.get(p)) is not None:
                ids = struct.pack("<I", rank)
            if ids is None:
                rest.append(k)
            out[k] = ids
        for k, ids in zip(rest, self.encode_pieces([pieces[k] for k in rest])):
            out[k] = ids
        if len(young) + len(missed) > REMEMBERED:
            self.old, self.young = young, {}
            young = self.young
        for k in missed:
            if len(pieces[k]) <= REMEMBERED_BYTES:
                young[pieces[k]] = out[k]
        return out

    def forget(self) -> None:
        self.young, self.old = {}, {}

    def _cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Starts of the pre-tokens of all texts; a text that isn't empty starts one."""
        opens = offsets[:-1][np.diff(offsets) > 0]
        if self.pattern.pattern in SPLIT_BY_KIND:
            return split_by_kind(data, opens)
        raw, starts, split = data.tobytes(), [], self.pattern.finditer
        for a, b in zip(opens.tolist(), np.append(opens[1:], len(data)).tolist()):
            text = raw[a:b].decode("utf-8")
            at, cuts = 0, []
            for m in split(text):
                if m.start() != at:
                    raise ValueError("the pattern leaves bytes out")
                cuts.append(at)
                at = m.end()
            if at != len(text):
                raise ValueError("the pattern leaves bytes out")
            wide = np.cumsum(np.append(0, [len(c.encode("utf-8")) for c in text])) if len(text) < b - a else None
            starts.append(a + (np.array(cuts) if wide is None else wide[cuts]))
        return np.concatenate(starts) if starts else np.zeros(0, np.int64)

    def encode_block(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Packed ids of the texts that lie in ``data`` between ``offsets``; each distinct pre-token is encoded once.

        Pre-tokens are told apart by hashes whose equality their bytes confirm.
        """
        if not len(data):
            return [b""] * (len(offsets) - 1)
        starts = self._cuts(data, offsets)
        ends = np.append(starts[1:], len(data))
        _, first, which = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        odd = np.flatnonzero(~same_spans(data, starts, ends, first[which]))
        which[odd] = len(first) + np.arange(len(odd))
        first = np.append(first, odd)
        raw = data.tobytes()
        codes = self.encode_distinct([raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())])
        flat = np.frombuffer(b"".join(codes), dtype="<u4")
        sizes = np.array([len(c) >> 2 for c in codes])
        begins = np.cumsum(sizes) - sizes
        each = sizes[which]
        upto = np.cumsum(each)
        ids = flat[np.repeat(begins[which] - upto + each, each) + np.arange(upto[-1])]
        cuts = (np.append(0, upto)[np.searchsorted(starts, offsets, side="left")] * 4).tolist()
        packed = ids.tobytes()
        return [packed[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        raw = [t.encode("utf-8") for t in texts]
        return self.encode_block(np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)]))

    def encode_packed(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def decode_packed(self, ids: bytes) -> bytes:
        """Bytes of packed ids, gathered from one buffer of all tokens; KeyError for an id without a token."""
        which = np.frombuffer(ids, dtype="<u4").astype(np.int64)
        if not len(which):
            return b""
        if int(which.max()) >= len(self.lengths) or not self.lengths[which].all():
            raise KeyError("an id that the vocabulary doesn't have")
        lengths = self.lengths[which]
        ends = np.cumsum(lengths)
        return self.flat[np.repeat(self.begins[which] - ends + lengths, lengths) + np.arange(ends[-1])].tobytes()


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> BytePairCodec:
    """One codec for each worker process."""
    return BytePairCodec.from_file(path, pattern)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = True) -> DataFrame:
    """Ids of every whole text: (id, n_tokens long, ids binary: little-endian uint32[, decoded binary]).

    ``ranks_path`` is a file that every executor has (it belongs to an installed package). A null text is empty.
    """
    kept = docs.select(id_col, text_col)
    schema = f"`{id_col}` {kept.schema[id_col].dataType.simpleString()}, n_tokens long, ids binary" + ", decoded binary" * decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for part, data, offsets in blocks(batches, text_col, BLOCK):
            packed = own.encode_block(data, offsets)
            columns = [part.column(0), pa.array([len(x) // 4 for x in packed], pa.int64()), pa.array(packed, pa.binary())]
            if decoded:
                columns.append(pa.array([own.decode_packed(x) for x in packed], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_tokens", "ids", "decoded"][: len(columns)])
        own.forget()
        settle()

    return kept.mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Bytes of packed ids: (id, decoded binary). Null ids decode to the empty text; an unknown id raises KeyError."""
    kept = encoded.select(id_col, ids_col)
    schema = f"`{id_col}` {kept.schema[id_col].dataType.simpleString()}, decoded binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for batch in batches:
            texts = [own.decode_packed(x.as_py() or b"") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], names=[id_col, "decoded"])

    return kept.mapInArrow(run, schema)
