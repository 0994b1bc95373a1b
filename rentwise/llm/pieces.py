"""SentencePiece (BPE) encoding by suffix-array matching, and decoding.

A batch's texts are cut into units at word starts: no piece holds the space mark
after another character, so no merge crosses such a cut. The distinct new units
of a batch are concatenated and indexed by a suffix array; every piece of the
vocabulary is binary-searched for its range of occurrences. The occurrences are
edges from a start to an end; sorted by their end, they are relaxed position by
position, for all units at once.

Relaxing keeps, for every prefix of a unit, the last piece of the prefix's
encoding. An edge from s to e with piece p extends the encoding of the prefix
ending in s if and only if merging could not have joined p with the piece before
it. BPE applies merges in the order of their scores, so this depends on the two
pieces alone: on the symbols that stand at the right rim of the one and at the
left rim of the other, and on when each is absorbed. Exactly one edge into every
position passes. The result equals the library's for models with these
properties, which ``PieceModel`` checks: BPE scores that fall with the id, an
identity normaliser with a leading space mark, byte fallback.

Decoding joins the pieces, turns bytes into UTF-8 and removes the leading mark.

Defined cases: null and empty texts have no ids and decode to the empty text. A
literal U+2581 in a text is the space mark and decodes to a space. Texts of any
length are encoded whole; units are indexed in chunks of bounded size, or alone where a unit is longer
than a chunk (some 200 bytes a character then), with work in proportion to their length.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, source

MARK = "▁"
UNITS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
CHUNK = 500_000   # characters indexed at once
CACHE = 400_000   # distinct units a task remembers
KNOWN = 1 << 20    # slots of pair decisions
FEW = 24           # edges or units that are handled one by one
LONG = 256         # positions with so few edges from which that pays


class PieceModel:
    """The vocabulary of a model file: pieces, ranks, and how every piece was merged."""

    def __init__(self, path: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        size = lib.get_piece_size()
        plain = [i for i in range(size) if not (lib.is_unknown(i) or lib.is_control(i) or lib.is_byte(i))]
        self.text = {i: lib.id_to_piece(i) for i in plain}
        self.size, self.unknown = size, size  # the id of a character that the vocabulary lacks
        self.byte = np.array([lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.rank = {i: -lib.get_score(i) for i in plain}
        order = sorted(plain, key=lambda i: self.rank[i])
        if any(MARK in t.lstrip(MARK) for t in self.text.values()) or not all(map(lib.is_byte, self.byte.tolist())):
            raise ValueError("the model needs byte fallback, and space marks only at the start of its pieces")
        if lib.normalize("A  Åﬁ ") != f"{MARK}A{MARK}{MARK}Åﬁ{MARK}":
            raise ValueError("the model needs the identity normaliser with a leading space mark")
        self.id = {t: i for i, t in self.text.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        for i in order:
            found = self._merged(self.text[i])
            if found is not None:
                self.parts[i] = found
        # a piece that merging never produces is no edge
        self.edges = {t: i for t, i in self.id.items() if len(t) == 1 or i in self.parts}
        self.longest = max(map(len, self.edges))
        self.edge_ids = np.array(list(self.edges.values()), np.int64)
        self.edge_sizes = np.array(list(map(len, self.edges)), np.int64)
        self.edge_points = np.array([list(map(ord, t.ljust(self.longest, "\0"))) for t in self.edges], np.uint32)
        self.pairs: dict[int, bool] = {}  # pairs decided one by one
        self.keys, self.values = np.full(KNOWN, -1, np.int64), np.zeros(KNOWN, bool)  # pairs decided before, by slot

    def _merged(self, text: str) -> tuple[int, int] | None:
        """The two symbols whose merge makes ``text``, if merging its characters ends in one symbol."""
        symbols, last = list(text), None
        while len(symbols) > 1:
            options = [(self.rank[self.id[a + b]], k) for k, (a, b) in enumerate(zip(symbols, symbols[1:]))
                       if a + b in self.id]
            if not options:
                return None
            _, k = min(options)
            last = symbols[k], symbols[k + 1]
            symbols[k:k + 2] = [symbols[k] + symbols[k + 1]]
        return None if last is None or any(x not in self.id for x in last) else (self.id[last[0]], self.id[last[1]])

    def _rim(self, piece: int, side: int) -> list[tuple[str, float]]:
        """Symbols at one rim while the piece is built, each with the rank at which it is absorbed."""
        out, gone = [(self.text[piece], float("inf"))], self.rank[piece]
        while piece in self.parts:
            piece = self.parts[piece][side]
            out.append((self.text[piece], gone))
            gone = self.rank[piece]
        return out

    def stays(self, left: int, right: int) -> bool:
        """Whether the two pieces can stand next to each other in an encoding."""
        if left == self.unknown or right == self.unknown:
            return True
        for a, a_gone in self._rim(left, 1):
            for b, b_gone in self._rim(right, 0):
                joined = self.id.get(a + b)
                # of equal ranks the merge further left comes first
                if joined is not None and self.rank[joined] < a_gone and self.rank[joined] <= b_gone:
                    return False
        return True

    def allowed(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) * (self.size + 1) + right
        slots = (keys * 0x9E3779B1 >> 7) & (KNOWN - 1)
        out, strange = self.values[slots], np.flatnonzero(self.keys[slots] != keys)
        if len(strange):
            new, back = np.unique(keys[strange], return_inverse=True)
            found = np.array([self.stays(*divmod(k, self.size + 1)) for k in new.tolist()])
            out[strange] = found[back]
            # of pairs with one slot the last is kept, key and value alike
            slots = (new * 0x9E3779B1 >> 7) & (KNOWN - 1)
            slots, at = np.unique(slots, return_index=True)
            self.keys[slots], self.values[slots] = new[at], found[at]
        return out


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``codes`` in the order of the suffixes' first ``depth`` codes (prefix doubling)."""
    n, width = len(codes), 1
    rank = codes.astype(np.int64)
    if int(rank.max(initial=0)) < 1 << 20:  # the first two steps need no sort
        ahead = np.r_[rank, 0, 0]
        rank, width = (rank << 42) | (ahead[1:-1] << 21) | ahead[2:], 3
        order = np.argsort(rank)
        steps = np.r_[0, np.cumsum(np.diff(rank[order]) != 0)]
        rank[order] = steps
    while True:
        ahead = np.zeros(n, np.int64)
        if width < n:
            ahead[:-width] = rank[width:] + 1
        keys = rank * (int(rank.max(initial=0)) + 2) + ahead
        order = np.argsort(keys)
        width *= 2
        if width >= depth:
            return order
        steps = np.r_[0, np.cumsum(np.diff(keys[order]) != 0)]
        rank = np.empty(n, np.int64)
        rank[order] = steps


def occurrence_ranges(codes: np.ndarray, order: np.ndarray, patterns: np.ndarray, sizes: np.ndarray):
    """For every pattern row, the range [lo, hi) of suffixes that start with it: binary search per character."""
    lo, hi = np.zeros(len(sizes), np.int64), np.full(len(sizes), len(codes), np.int64)
    padded = np.r_[codes, np.full(patterns.shape[1], -1, codes.dtype)]

    def bound(live, depth, after):
        left, right, char = lo[live].copy(), hi[live].copy(), patterns[live, depth]
        while (open_ := left < right).any():
            mid = (left + right) // 2
            here = padded[order[np.minimum(mid, len(order) - 1)] + depth]
            less = (here <= char) if after else (here < char)
            left = np.where(open_ & less, mid + 1, left)
            right = np.where(open_ & ~less, mid, right)
        return left

    for depth in range(patterns.shape[1]):
        live = np.flatnonzero((sizes > depth) & (lo < hi))
        if not len(live):
            break
        low, high = bound(live, depth, False), bound(live, depth, True)
        lo[live], hi[live] = low, high
    return lo, hi


def _relax(model: PieceModel, starts: list, pieces: list, sizes: list, offset: np.ndarray, last: np.ndarray, came: np.ndarray):
    """Relaxes edges in the order of their ends one at a time, where so few end at a position that arrays don't pay."""
    place, ends, steps, pairs, width = memoryview(offset), memoryview(last), memoryview(came), model.pairs, model.size + 1
    for s, p, n in zip(starts, pieces, sizes):
        if place[s]:
            before = ends[s]
            if before < 0:
                continue
            ok = pairs.get(before * width + p)
            if ok is None:
                if len(pairs) >= KNOWN:
                    pairs.clear()
                ok = pairs[before * width + p] = model.stays(before, p)
            if not ok:
                continue
        ends[s + n], steps[s + n] = p, n


def encode_units(model: PieceModel, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all units one after another, and each unit's number of ids."""
    sizes = np.array([len(u) for u in units], np.int64)
    starts = np.r_[0, np.cumsum(sizes + 1)]  # one separator after each unit
    points = np.frombuffer("\0".join([*units, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    alphabet, codes = np.unique(points, return_inverse=True)
    codes = codes.astype(np.int32) + 1
    ends_at = starts[1:] - 1
    codes[ends_at] = 0  # a text's own NUL keeps its code
    n = len(codes)
    unit = np.repeat(np.arange(len(units)), sizes + 1)
    offset = np.arange(n) - starts[unit]

    # the pieces whose characters all occur here, in the codes of this chunk
    spot = np.minimum(np.searchsorted(alphabet, model.edge_points), len(alphabet) - 1)
    inside = np.arange(model.longest) < model.edge_sizes[:, None]
    found = np.flatnonzero(((alphabet[spot] == model.edge_points) | ~inside).all(1))
    patterns, lengths, ids = spot[found].astype(np.int32) + 1, model.edge_sizes[found], model.edge_ids[found]
    order = suffix_array(codes, model.longest)
    lo, hi = occurrence_ranges(codes, order, patterns, lengths)

    times = hi - lo
    which = np.repeat(np.arange(len(found)), times)
    at = order[np.repeat(lo, times) + (np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times))]
    start, piece, size = at, ids[which], lengths[which]
    plain = np.isin(alphabet, model.edge_points[found[lengths == 1], 0])
    lone = np.flatnonzero((codes > 0) & ~np.r_[True, plain][codes])  # characters without a piece
    start, piece = np.r_[start, lone], np.r_[piece, np.full(len(lone), model.unknown)]
    size = np.r_[size, np.ones(len(lone), np.int64)]

    end = offset[start] + size
    by_end = np.argsort(end)
    start, piece, size, end = start[by_end], piece[by_end], size[by_end], end[by_end]
    last, came = np.full(n + 1, -1, np.int64), np.zeros(n + 1, np.int64)
    cuts = np.searchsorted(end, np.arange(1, int(end.max(initial=0)) + 2))
    few = np.diff(cuts) <= FEW
    spans = np.r_[0, np.flatnonzero(np.diff(few)) + 1, len(few)]
    for i, j in zip(spans, spans[1:]):
        if j - i > LONG and few[i]:  # only units of such a length reach there: edge by edge
            _relax(model, *(x[cuts[i]:cuts[j]].tolist() for x in (start, piece, size)), offset, last, came)
            continue
        for a, b in zip(cuts[i:j], cuts[i + 1:j + 1]):
            s, p = start[a:b], piece[a:b]
            first = offset[s] == 0
            ok = first | (last[s] >= 0)
            inner = np.flatnonzero(ok & ~first)
            ok[inner] = model.allowed(last[s[inner]], p[inner])
            last[s[ok] + size[a:b][ok]], came[s[ok] + size[a:b][ok]] = p[ok], size[a:b][ok]

    # last[] is indexed by the position after a piece; walk back from every unit's end at once
    taken, here, left = [], ends_at.copy(), np.arange(len(units))
    while len(left) > FEW:
        if (came[here] == 0).any():
            raise AssertionError("a unit has no encoding")
        taken.append((left, here, last[here]))
        here = here - came[here]
        more = here > starts[left]
        left, here = left[more], here[more]
    for unit_, at in zip(left.tolist(), here.tolist()):  # what is left of the longest units: piece by piece
        spots, first = [], int(starts[unit_])
        steps = memoryview(came)
        while at > first:
            spots.append(at)
            if not steps[at]:
                raise AssertionError("a unit has no encoding")
            at -= steps[at]
        spots = np.array(spots, np.int64)
        taken.append((np.full(len(spots), unit_), spots, last[spots]))
    owner = np.concatenate([x[0] for x in taken]) if taken else np.empty(0, np.int64)
    spot = np.concatenate([x[1] for x in taken]) if taken else owner
    value = np.concatenate([x[2] for x in taken]) if taken else owner
    sort = np.argsort(spot)
    owner, spot, value = owner[sort], spot[sort], value[sort]
    strange = np.flatnonzero(value == model.unknown)
    if len(strange):  # spelled out as bytes
        spelled = [chr(points[spot[k] - 1]).encode("utf-8", "surrogatepass") for k in strange]
        repeat = np.ones(len(value), np.int64)
        repeat[strange] = [len(b) for b in spelled]
        target = (np.cumsum(repeat) - repeat)[strange]
        value, owner = np.repeat(value, repeat), np.repeat(owner, repeat)
        for t, b in zip(target, spelled):
            value[t:t + len(b)] = model.byte[list(b)]
    return value.astype(np.int32), np.bincount(owner, minlength=len(units))


class Index(dict):
    """Unit -> number, in the order of first sight; ``new`` lists the units not seen before."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        number = self[unit] = len(self)
        self.new.append(unit)
        return number


class Encoder:
    """Encodes texts, remembering the ids of the units seen last."""

    def __init__(self, path: str):
        self.model = PieceModel(path)
        self._reset()

    def _reset(self):
        self.index = Index()
        self.flat, self.sizes = [np.empty(0, np.int32)], [np.empty(0, np.int64)]

    def _learn(self, new: list[str]):
        chunk, length = [], 0
        for k, unit in enumerate(new):
            chunk.append(unit)
            length += len(unit) + 1
            if length >= CHUNK or k == len(new) - 1:
                ids, sizes = encode_units(self.model, chunk)
                self.flat.append(ids), self.sizes.append(sizes)
                chunk, length = [], 0

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the texts, and the offsets of each text's ids."""
        if len(self.index) > CACHE:
            self._reset()
        rows, words = [], []
        for text in texts:
            units = UNITS.findall(MARK + text.replace(" ", MARK)) if text else ()
            words.append(len(units))
            rows += map(self.index.__getitem__, units)
        self._learn(self.index.new)
        self.index.new = []
        self.flat, self.sizes = [np.concatenate(self.flat)], [np.concatenate(self.sizes)]
        sizes, starts = self.sizes[0], np.cumsum(self.sizes[0]) - self.sizes[0]
        rows = np.array(rows, np.int64)
        n = sizes[rows]
        spots = np.repeat(starts[rows] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        ends = np.r_[0, np.cumsum(n)][np.r_[0, np.cumsum(words)]]
        return self.flat[0][spots], ends


class Decoder:
    def __init__(self, model: PieceModel):
        self.piece = [b""] * model.size
        for i, t in model.text.items():
            self.piece[i] = t.replace(MARK, " ").encode()
        for b, i in enumerate(model.byte):
            self.piece[i] = bytes([b])

    def decode(self, ids) -> str:
        joined = b"".join(map(self.piece.__getitem__, ids))
        return (joined[1:] if joined[:1] == b" " else joined).decode("utf-8", "replace")


def encode_documents(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text",
                     decoded: bool = False) -> DataFrame:
    """doc_id, n_ids, ids, for every document, by the model file at ``model`` (a path on every machine).

    ``decoded`` adds the text that the ids decode to.
    """
    bound_batches(docs.sparkSession)

    def run(batches):
        encoder = Encoder(model)
        decoder = Decoder(encoder.model)
        for batch in batches:
            ids, ends = encoder.encode(batch.column(1).to_pylist())
            columns = {"doc_id": batch.column(0), "n_ids": pa.array(np.diff(ends)),
                       "ids": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))}
            if decoded:
                listed = ids.tolist()
                columns["decoded"] = pa.array([decoder.decode(listed[a:b]) for a, b in zip(ends, ends[1:])], pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    rows = source(docs, doc_id=key, text=text).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_ids long, ids array<int>" + ", decoded string" * decoded)


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, text from doc_id, ids."""
    def run(batches):
        decoder = Decoder(PieceModel(model))
        for batch in batches:
            texts = [decoder.decode(ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
