"""SentencePiece BPE encoding and decoding by suffix-array matching.

No piece has white space inside, so the text is cut before each run of spaces
(with one space put before the text) and every distinct cut of a batch is
encoded once. For the concatenated text of the distinct cuts:

1. a suffix array is built: suffixes are sorted by their first 8 bytes as one
   number, and by the next 8 in the ranges where a longer piece asks for it;
2. each piece is found in it by binary search as a range of suffixes; pieces of
   more than 16 bytes compare the rest;
3. all occurrences are edges, sorted by the position in their cut at which they
   end, and characters that no piece covers get an edge of their own;
4. the edges are relaxed in that order, all cuts in step: each prefix keeps the
   one piece with which its encoding ends. An edge is taken if the encoding
   before it ends in a piece that stands next to it in merge order, that is if
   merging the two pieces' text gives these two again. For byte-pair merges
   ranked by the merged piece exactly one edge passes at each position.

A cut of more than ``LONG_CUT`` bytes is encoded in overlapping blocks, which are joined
at a piece that neighbours have in common.

So the result is that of merging by rank, the library's own algorithm, with
characters outside the vocabulary as byte pieces. The vocabulary is read from a
model file on the driver, has a fixed size and travels with the code. Null text
is empty; empty text has no pieces. A literal U+2581 is a space to the model.
Rows that repeat a doc_id are encoded each for itself; a null doc_id stays null.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import text_of
from .tokens import U64, chunks, give_back, mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of distinct cuts in a suffix array, and of texts encoded at a time, at most but for one longer text: they bound a worker's memory and change no result.
ARRAY_BYTES = 192 << 10
BATCH_BYTES = 512 << 10
#: Longer cuts (text without spaces) are encoded in overlapping blocks, so that rounds of relaxing do not follow their length.
LONG_CUT, BLOCK_BYTES, OVERLAP = 8192, 1024, 256
#: Pairs of pieces whose fit is remembered, and how many are looked at one by one.
SLOT_BITS, FEW = 20, 200


class Vocabulary:
    """Pieces with ids and ranks. ``pieces``: (id, text) in order of merging; single characters may stand anywhere.

    Pieces that are runs of spaces tie for the last rank, which leaves the order to the position: they are merged from the left once all else is, by ``run_ids``.
    """

    def __init__(self, pieces: Sequence[tuple[int, str]], byte_ids: Sequence[int]):
        text = {p.replace("▁", " "): i for i, p in pieces}
        if any("  " in p and p.strip(" ") or " " in p.lstrip(" ") for p in text):
            raise ValueError("a piece with white space inside")
        self.runs = {len(p): i for p, i in text.items() if not p.strip(" ")}
        self.run_cache: dict[int, list[int]] = {}
        order = [p for p in text if len(p) == 1] + [p for p in text if len(p) > 1 and p.strip(" ")]
        self.rank = {p: r for r, p in enumerate(order)}
        self.split: list[tuple[int, int]] = []
        kept = []
        for p in order:
            r = self.rank[p]
            parts = list(p)
            while len(parts) > 1:
                ranks = [self.rank.get(a + b, 1 << 30) for a, b in zip(parts, parts[1:], strict=False)]
                best = min(ranks)
                if best == 1 << 30 or len(parts) == 2:
                    break
                k = ranks.index(best)
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            # A piece that merging never makes matches nothing.
            if len(p) == 1 or len(parts) == 2 and all(x in self.rank for x in parts) and self.rank.get("".join(parts)) == r:
                kept.append(r)
                self.split.append((self.rank[parts[0]], self.rank[parts[1]]) if len(parts) == 2 else (r, r))
            else:
                self.split.append((r, r))
        self.texts = [p.encode() for p in order]
        self.ids = np.array([text[p] for p in order] + [0], np.int32)
        self.unknown = len(order)
        self.sizes = np.array([len(b) for b in self.texts] + [0], np.int64)
        self.byte_ids = np.array(byte_ids, np.int32)
        self.known_keys, self.known = np.full(1 << SLOT_BITS, -1, np.int64), np.zeros(1 << SLOT_BITS, bool)
        self.splits = np.array([*self.split, (0, 0)], np.int64)
        joint = sorted((self.rank[p[:k]] << 32 | self.rank[p[k:]], r) for p, r in self.rank.items() for k in range(1, len(p)) if p[:k] in self.rank and p[k:] in self.rank)
        self.joint_keys, self.joint_ranks = (np.array(x, np.int64) for x in zip(*joint, strict=True)) if joint else (np.full(1, -1, np.int64), np.zeros(1, np.int64))
        kept.sort(key=lambda r: self.texts[r])  # neighbours in the suffix array are looked up together
        matched = np.array(kept, np.int64)
        pad = np.zeros((len(matched), 16), np.uint8)
        for row, r in enumerate(kept):
            head = self.texts[r][:16]
            pad[row, : len(head)] = np.frombuffer(head, np.uint8)
        self.matched32, self.sizes32 = matched.astype(np.int32), self.sizes.astype(np.int32)
        self.matched, self.head = matched, pad.view(">u8").astype(U64)
        size = np.minimum(self.sizes[matched], 16)
        fill = lambda n: np.where(n >= 8, U64(0), ~U64(0) >> (U64(8) * np.minimum(n, 7).astype(U64)))
        self.top = np.stack([self.head[:, 0] | fill(size), self.head[:, 1] | fill(np.maximum(size - 8, 0))], axis=1)
        n_pieces = int(max([*self.ids.tolist(), *byte_ids])) + 1
        out = [b""] * n_pieces
        for p, i in text.items():
            out[i] = p.encode()
        for v, i in enumerate(byte_ids):
            out[i] = bytes([v])
        self.out_sizes = np.array([len(x) for x in out], np.int64)
        self.out_starts = np.concatenate([[0], np.cumsum(self.out_sizes)[:-1]])
        self.out_data = np.frombuffer(b"".join(out), np.uint8)

    def run_ids(self, n: int) -> list[int]:
        """Pieces of n spaces that merged with nothing else."""
        got = self.run_cache.get(n)
        if got is None:
            parts: list[int] = []
            for _ in range(n):
                parts.append(1)
                # A merged piece may now fit the one before it, which comes first.
                while len(parts) > 1 and parts[-2] + parts[-1] in self.runs:
                    parts[-2:] = [parts[-2] + parts[-1]]
            got = [self.runs[x] for x in parts]
            if n < 1 << 12:
                self.run_cache[n] = got
        return got

    def adjacent(self, a: int, b: int) -> bool:
        """Whether pieces a and b, by rank, stay apart when their joint text is merged: undo merges, latest first, and see whether an earlier one would have crossed the border."""
        limit = 1 << 30
        while True:
            joint = self.rank.get((self.texts[a] + self.texts[b]).decode())
            if joint is not None and joint < limit:
                return False
            if a > b:
                limit, a = a, self.split[a][1]
                if a == limit:
                    limit, b = b + 1, self.split[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, self.split[b][0]
                if b + 1 == limit:
                    limit, a = a, self.split[a][1]
                    if a == limit:
                        return True

    def adjacent_all(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``adjacent`` of many pairs in step."""
        out, at = np.ones(len(a), bool), np.arange(len(a))
        a, b, limit = a.astype(np.int64), b.astype(np.int64), np.full(len(a), 1 << 30, np.int64)
        while len(at):
            key = a << 32 | b
            place = np.minimum(np.searchsorted(self.joint_keys, key), len(self.joint_keys) - 1)
            crossed = (self.joint_keys[place] == key) & (self.joint_ranks[place] < limit)
            out[at[crossed]] = False
            first = a > b
            left, right = np.where(first, self.splits[a, 1], a), np.where(first, b, self.splits[b, 0])
            limit = np.where(first, a, b + 1)
            # One side is a single character: the other is undone now.
            single = np.where(first, left == limit, right + 1 == limit)
            again_l, again_r = np.where(single & ~first, self.splits[a, 1], left), np.where(single & first, self.splits[b, 0], right)
            limit = np.where(single, np.where(first, b + 1, a), limit)
            done = crossed | single & np.where(first, again_r + 1 == limit, again_l == limit)
            live = ~done
            at, a, b, limit = at[live], again_l[live], again_r[live], limit[live]
        return out

    def fits(self, last: np.ndarray, token: np.ndarray) -> np.ndarray:
        """``adjacent`` for arrays, remembered in a table of fixed size; the start (-1) and unknown characters stand next to anything."""
        out = np.ones(len(token), bool)
        ask = np.flatnonzero((last >= 0) & (last != self.unknown) & (token != self.unknown))
        if len(ask):
            keys = (last[ask].astype(np.int64) << 32) | token[ask]
            slot = (mix(keys.view(U64)) >> U64(64 - SLOT_BITS)).astype(np.int64)
            new = np.flatnonzero(self.known_keys[slot] != keys)
            got = self.known[slot]
            if len(new):
                k = keys[new]
                values = self.adjacent_all(k >> 32, k & 0xFFFFFFFF) if len(k) > FEW else np.array([self.adjacent(x >> 32, x & 0xFFFFFFFF) for x in k.tolist()], bool)
                self.known_keys[slot[new]], self.known[slot[new]] = k, values
                # Of pairs of one place the last stays; each has its own value here.
                kept = self.known_keys[slot[new]] == k
                self.known[slot[new[kept]]] = values[kept]
                got[new] = values
            out[ask] = got
        return out


def load_vocabulary(path: str = MODEL) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    special = [i for i in range(n) if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)]
    skip = set(special)
    pieces = [(i, sp.id_to_piece(i)) for i in range(n) if i not in skip]
    pieces.sort(key=lambda x: -sp.get_score(x[0]))
    v = Vocabulary(pieces, [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
    return v


def _words8(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one big-endian number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.zeros(len(data), U64)
    for j in range(8):
        out = (out << U64(8)) | padded[j : j + len(data)]
    return out


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated ranges and the index of the range of each value."""
    n = np.maximum(hi - lo, 0)
    which = np.repeat(np.arange(len(n)), n)
    return np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + lo[which], which


def _pieces_of(v: Vocabulary, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first bytes, pieces by rank) of the encodings of the cuts of ``data`` that begin at ``starts``, in order; unknown characters are one piece each."""
    n = len(data)
    ends = np.concatenate([starts[1:], [n]])
    starts32, ends32 = starts.astype(np.int32), ends.astype(np.int32)
    start_of, end_of = np.repeat(starts32, ends - starts), np.repeat(ends32, ends - starts)
    hi = _words8(data)
    suffixes = np.argsort(hi).astype(np.int32)
    key = hi[suffixes]
    left, right = np.searchsorted(key, v.head[:, 0], "left"), np.searchsorted(key, v.top[:, 0], "right")
    size = v.sizes[v.matched]
    deep, lo, sorted_from = np.flatnonzero((size > 8) & (right > left)), np.zeros(0, U64), -1
    for k in deep.tolist():
        a, b = int(left[k]), int(right[k])
        if a != sorted_from:  # the second word's order, where a piece asks for it
            after = suffixes[a:b] + 8
            lo = np.where(after < n, hi[np.minimum(after, n - 1)], U64(0))
            order = np.argsort(lo)
            suffixes[a:b], lo, sorted_from = suffixes[a:b][order], lo[order], a
        left[k], right[k] = a + np.searchsorted(lo, v.head[k, 1], "left"), a + np.searchsorted(lo, v.top[k, 1], "right")
    at, which = _ranges(left, right)
    begin, token = suffixes[at], v.matched32[which]
    end = begin + v.sizes32[token]
    ok = end <= end_of[begin]
    for k in np.flatnonzero((size > 16) & (right > left)).tolist():
        rest = np.frombuffer(v.texts[v.matched[k]], np.uint8)[16:]
        mine = np.flatnonzero((which == k) & ok)
        ok[mine] = (data[begin[mine][:, None] + np.arange(16, size[k])] == rest).all(axis=1)
    begin, token, end = begin[ok], token[ok], end[ok]
    # Characters without a piece of their own.
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    width = np.diff(np.concatenate([lead, [n]]))
    covered = np.zeros(n, bool)
    span = np.zeros(n, np.int32)
    span[lead] = width
    covered[begin[end - begin == span[begin]]] = True
    bare = ~covered[lead]
    if bare.any():
        begin = np.concatenate([begin, lead[bare].astype(np.int32)])
        end = np.concatenate([end, (lead[bare] + width[bare]).astype(np.int32)])
        token = np.concatenate([token, np.full(int(bare.sum()), v.unknown, np.int32)])
    step = end - start_of[begin]
    order = np.argsort(step.astype(np.uint16) if len(step) and step.max() < 65536 else step, kind="stable")
    begin, end, token, step = begin[order], end[order], token[order], step[order]
    # last[p + 1] is the piece with which the encoding up to p ends, -1 at a start, -2 if unknown as yet; a start shares its place with the end before it, hence two arrays.
    last = np.full(n + 1, -2, np.int32)
    came = np.zeros(n + 1, np.int32)
    is_start = np.zeros(n + 1, bool)
    is_start[starts] = True
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(step)) + 1, [len(step)]]) if len(step) else np.zeros(1, np.int64)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        s, t, e = begin[a:b], token[a:b], end[a:b]
        before = np.where(is_start[s], -1, last[s])
        ok = before > -2
        s, t, e, before = s[ok], t[ok], e[ok], before[ok]
        ok = v.fits(before, t)
        last[e[ok]] = t[ok]
        came[e[ok]] = s[ok]
    # Walk back from the ends.
    at, owner = ends32.copy(), np.arange(len(starts))
    got_pos, got_tok = [], []
    live = at > starts
    at, owner = at[live], owner[live]
    while len(at):
        t, s = last[at], came[at]
        got_pos.append(s)
        got_tok.append(t)
        live = s > starts[owner]
        at, owner = s[live], owner[live]
    pos, tok = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (got_pos, got_tok))
    order = np.argsort(pos)
    return pos[order].astype(np.int64), tok[order]


def _stitched(v: Vocabulary, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """_pieces_of one long cut, from blocks that overlap.

    A sequence of pieces is an encoding if each fits the one before it. So the encoding of what lies before a border
    and that of a block which begins earlier may be joined at any piece that both have. Where they have none, the
    block begins earlier still; at the cut's own start at last.
    """
    n = len(data)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    borders = np.searchsorted(lead, np.arange(0, n, BLOCK_BYTES))
    borders = lead[borders[borders < len(lead)]]
    borders = np.append(np.unique(borders), n)

    def blocks(begins: np.ndarray, stops: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        at = np.concatenate([[0], np.cumsum(stops - begins)])
        source, _ = _ranges(begins, stops)
        pos, tok = _pieces_of(v, data[source], at[:-1])
        cuts = np.searchsorted(pos, at)
        return [(pos[a:b] - p + q, tok[a:b]) for a, b, p, q in zip(cuts[:-1], cuts[1:], at[:-1], begins, strict=True)]

    each = max(1, ARRAY_BYTES // (BLOCK_BYTES + OVERLAP))
    got_pos, got_tok, seen = [], [], {}
    for k in range(0, len(borders) - 1, each):
        ks = np.arange(k, min(k + each, len(borders) - 1))
        begins = lead[np.searchsorted(lead, np.maximum(borders[ks] - OVERLAP, 0), side="right") - 1]
        for j, (pos, tok) in zip(ks.tolist(), blocks(begins, borders[ks + 1]), strict=True):
            reach = OVERLAP
            while j:
                old_pos, old_tok = got_pos[-1], got_tok[-1]
                _, a, b = np.intersect1d(old_pos, pos, assume_unique=True, return_indices=True)
                same = np.flatnonzero(old_tok[a] == tok[b])
                if len(same):
                    x = same[-1]
                    got_pos[-1], got_tok[-1] = old_pos[: a[x]], old_tok[: a[x]]
                    pos, tok = pos[b[x] :], tok[b[x] :]
                    break
                # Text of one period, for instance: begin where a piece begins, further back each time.
                begin = int(old_pos[max(0, np.searchsorted(old_pos, borders[j] - reach, side="right") - 1)])
                if begin == old_pos[0] and len(got_pos) > 1:
                    got_pos[-2:], got_tok[-2:] = [np.concatenate(got_pos[-2:])], [np.concatenate(got_tok[-2:])]
                reach *= 2
                text = data[begin : borders[j + 1]].tobytes()
                if text not in seen:
                    if len(seen) > 64:
                        seen.clear()
                    ((pos, tok),) = blocks(np.array([begin]), borders[j + 1 : j + 2])
                    seen[text] = pos - begin, tok
                pos, tok = seen[text][0] + begin, seen[text][1]
                if not begin:
                    got_pos, got_tok = [], []
                    break
            got_pos.append(pos)
            got_tok.append(tok)
    return np.concatenate(got_pos), np.concatenate(got_tok)


def _ids_of(v: Vocabulary, data: np.ndarray, starts: np.ndarray, pos: np.ndarray, tok: np.ndarray, spaces: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of cuts from their pieces; ``spaces`` more stand before the first."""
    n = len(data)
    ends = np.concatenate([starts[1:], [n]])
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    span = np.zeros(n, np.int32)
    span[lead] = np.diff(np.concatenate([lead, [n]]))
    wide = np.where(tok == v.unknown, span[pos], 1)
    out = np.repeat(v.ids[tok], wide)
    if (tok == v.unknown).any():
        source, which = _ranges(pos, pos + wide)
        raw = tok[which] == v.unknown
        out[raw] = v.byte_ids[data[source[raw]]]
    unit = np.repeat(np.arange(len(starts)), ends - starts)
    per_unit = np.bincount(unit[pos], weights=wide, minlength=len(starts)).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(per_unit)])
    pairs = np.flatnonzero(starts + 1 < ends)
    pairs = pairs[data[starts[pairs] + 1] == 0x20]
    if spaces:
        n = int(np.argmin(np.append(out == v.runs[1], False)))
        out = np.concatenate([np.array(v.run_ids(n + spaces), out.dtype), out[n:]])
        return out, np.array([0, len(out)])
    if len(pairs):
        lone, keep = v.runs[1], np.ones(len(out), bool)
        for u in pairs.tolist():
            a, b = int(offsets[u]), int(offsets[u + 1])
            n = a
            while n < b and out[n] == lone:
                n += 1
            ids = v.run_ids(n - a)
            out[a : a + len(ids)] = ids
            keep[a + len(ids) : n] = False
            per_unit[u] -= n - a - len(ids)
        out, offsets = out[keep], np.concatenate([[0], np.cumsum(per_unit)])
    return out, offsets


def _encode_long(v: Vocabulary, data: np.ndarray) -> np.ndarray:
    """The ids of one long cut. Of many spaces before it two are encoded, and the others counted with them."""
    spaces = int(np.argmax(np.append(data != 0x20, True)))
    spare = max(0, spaces - 2)
    data = data[spare:]
    return _ids_of(v, data, np.zeros(1, np.int64), *_stitched(v, data), spaces=spare)[0]


def encode_batch(v: Vocabulary, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of the texts of a chunk."""
    rows, size = len(offs) - 1, np.diff(offs)
    if b"\xe2\x96\x81" in data.tobytes():
        texts = [data[a:b].tobytes().replace(b"\xe2\x96\x81", b" ") for a, b in zip(offs[:-1], offs[1:], strict=True)]
        data, size = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])
        offs = np.concatenate([[0], np.cumsum(size)])
    some = np.flatnonzero(size > 0)
    if not len(some):
        return np.empty(0, np.int32), np.zeros(rows + 1, np.int64)
    data = np.insert(data, offs[:-1][some], 0x20)
    begins = offs[:-1][some] + np.arange(len(some))
    space = data == 0x20
    first = space.copy()
    first[1:] &= ~space[:-1]
    first[begins] = True
    if len(data) > 1:  # a text's own leading spaces belong to the one put before it
        nxt = begins[begins + 1 < len(data)] + 1
        first[np.setdiff1d(nxt, begins)] = False
    starts = np.flatnonzero(first)
    ends = np.concatenate([starts[1:], [len(data)]])
    # Cuts are told apart by their bytes; each distinct one is encoded once.
    cuts = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.concatenate([starts, [len(data)]]).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    distinct = cuts.dictionary_encode()
    back, at = distinct.indices.to_numpy(), np.empty(len(distinct.dictionary), np.int64)
    at[back] = np.arange(len(back))
    lens = ends[at] - starts[at]
    ids, sizes, k = [], [], 0
    total = np.concatenate([[0], np.cumsum(lens)])
    while k < len(at):
        if lens[k] > LONG_CUT:
            ids.append(_encode_long(v, data[starts[at[k]] : ends[at[k]]]))
            sizes.append(np.array([len(ids[-1])]))
            k += 1
            continue
        j = max(k + 1, int(np.searchsorted(total, total[k] + ARRAY_BYTES, side="right")) - 1)
        long = np.flatnonzero(lens[k:j] > LONG_CUT)
        j = k + int(long[0]) if len(long) else j
        source, _ = _ranges(starts[at[k:j]], ends[at[k:j]])
        part, cuts = _ids_of(v, data[source], first := total[k:j] - total[k], *_pieces_of(v, data[source], first))
        ids.append(part)
        sizes.append(np.diff(cuts))
        k = j
    ids, sizes = np.concatenate(ids), np.concatenate(sizes)
    where = np.concatenate([[0], np.cumsum(sizes)])
    source, _ = _ranges(where[:-1][back], where[1:][back])
    each = np.concatenate([[0], np.cumsum(sizes[back])])
    text_first = np.searchsorted(starts, begins)
    offsets = np.zeros(rows + 1, np.int64)
    counts = np.diff(np.concatenate([each[text_first], [each[-1]]]))
    offsets[1:][some] = counts
    return ids[source], np.cumsum(offsets)


def decode_batch(v: Vocabulary, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """The texts of lists of ids; the space put before a text goes."""
    source, _ = _ranges(v.out_starts[ids], v.out_starts[ids] + v.out_sizes[ids])
    data = v.out_data[source].tobytes()
    cuts = np.concatenate([[0], np.cumsum(v.out_sizes[ids])])[offsets].tolist()
    return [data[a + (data[a : a + 1] == b" ") : b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _encode(v: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in batches:
                for i, j, data, offs in chunks(b.column(1), BATCH_BYTES):
                    ids, offsets = encode_batch(v, data, offs)
                    raw = data.tobytes()
                    back = decode_batch(v, ids, offsets)
                    same = [raw[x:y] == t for x, y, t in zip(offs[:-1].tolist(), offs[1:].tolist(), back, strict=True)]
                    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(np.diff(offsets)), lists, pa.array(same)], ["doc_id", "n_pieces", "piece_ids", "round_trip"])
                give_back()

    return run


def _decode(v: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                lists = part.column(1).fill_null([])
                texts = decode_batch(v, lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy() - lists.offsets[0].as_py())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([t.decode(errors="replace") for t in texts], pa.string())], ["doc_id", "text"])

    return run


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_pieces, piece_ids and round_trip (whether decoding gives the text again) of every row."""
    return text_of(docs).mapInArrow(_encode(load_vocabulary(model)), "doc_id long, n_pieces long, piece_ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text of rows (doc_id, piece_ids)."""
    return encoded.select(F.col("doc_id").cast("long"), F.col("piece_ids").cast("array<int>")).mapInArrow(_decode(load_vocabulary(model)), "doc_id long, text string")
