"""SentencePiece encoding and decoding with N-best segmentation.

The model's pieces and scores span a lattice over the text. Forward Viterbi gives every place the
best score of what lies before it; a backward A-star search from the end uses these scores as its
heuristic, which is exact, so it pops segmentations in order of their total score.

No piece spans two neighbouring characters that no piece has side by side, so the lattice falls
apart into chunks there (mostly words). Each worker segments a distinct chunk once and keeps it in
a bounded cache; Viterbi scores of new chunks are made for a whole batch at a time, and the A-star
search is run only for the chunks whose alternatives can be among a text's N best: those with the
N-1 smallest losses. The text's N best are then the N cheapest ways to swap chunks.

A map without a shuffle; nothing but the model's path is sent to the workers.

Rules: as in the library, a blank is written "▁" and one is put before the text, a character that
no piece has costs ten points more than the worst piece and is spelled in byte pieces, and pieces
that are not plain text take no part. Of equally good segmentations the one with the longer last
piece wins.

Defined results: NULL is empty; an empty text has no pieces and one segmentation of score 0. A
text with a literal "▁" decodes with a blank for it, which `round_trip` tells. Rows that repeat a
doc_id are documents of their own. Other columns are ignored by `encode_texts`.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brackish.llm.text import documents, rows

#: Segmentations of a text, and chunks and characters in a worker's cache.
BEST = 4
CACHE = 400_000
CACHE_CHARACTERS = 8 << 20
UNKNOWN_PENALTY = 10.0
SPACE = "▁"


class Model:
    """Pieces, scores and the trie over characters, as arrays."""

    def __init__(self, path: str | None = None, proto: bytes | None = None):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path) if path else SentencePieceProcessor(model_proto=proto)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        scores = np.array([model.get_score(i) for i in range(size)])
        skip = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(size)]
        self.unknown = model.unk_id()
        self.bytes = {int(names[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.raw = [
            bytes([int(n[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i)
            else " ⁇ ".encode() if model.is_unknown(i) else n.replace(SPACE, " ").encode()
            for i, n in enumerate(names)
        ]
        pieces = [i for i in range(size) if not skip[i] and names[i]]
        letters = sorted({c for i in pieces for c in names[i]})
        self.classes = np.zeros(0x110000, np.uint16)  # 0: in no piece
        for k, c in enumerate(letters, 1):
            self.classes[ord(c)] = k
        self.width = len(letters) + 1
        self.joined = np.zeros((self.width, self.width), bool)
        go: dict[int, int] = {}
        self.node_piece = [-1]
        self.piece_of = {names[i]: i for i in pieces}
        self.longest = max((len(names[i]) for i in pieces), default=1)
        for i in pieces:
            node = 0
            kinds = [int(self.classes[ord(c)]) for c in names[i]]
            self.joined[kinds[:-1], kinds[1:]] = True
            for kind in kinds:
                key = node * self.width + kind
                if key not in go:
                    go[key] = len(self.node_piece)
                    self.node_piece.append(-1)
                node = go[key]
            self.node_piece[node] = i
        self.node_piece = np.array(self.node_piece, np.int32)
        self.keys = np.array(sorted(go), np.int64)
        self.to = np.array([go[k] for k in self.keys.tolist()], np.int64)
        self.scores = scores
        self.unknown_score = min((scores[i] for i in pieces), default=0.0) - UNKNOWN_PENALTY

    def spell(self, char: str) -> list[int]:
        """Piece ids of a character that no piece has."""
        return [self.bytes[b] for b in char.encode()] if self.bytes else [self.unknown]

    def starts(self, codes: np.ndarray) -> np.ndarray:
        """Whether a chunk begins at each character (the first one always does)."""
        kinds = self.classes[codes]
        out = np.ones(len(codes), bool)
        out[1:] = ~self.joined[kinds[:-1], kinds[1:]]
        return out

    def edges(self, codes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All lattice edges (place, length, piece). `left`: characters up to each one's chunk end."""
        kinds = self.classes[codes].astype(np.int64)
        place, node = np.arange(len(codes)), np.zeros(len(codes), np.int64)
        found = []
        single = np.zeros(len(codes), bool)
        for length in range(1, self.longest + 1):
            keep = left[place] >= length
            place, node = place[keep], node[keep]
            if not len(place):
                break
            key = node * self.width + kinds[place + length - 1]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            keep = self.keys[at] == key
            place, node = place[keep], self.to[at[keep]]
            piece = self.node_piece[node]
            is_piece = piece >= 0
            if length == 1:
                single[place[is_piece]] = True
            found.append((place[is_piece], np.full(is_piece.sum(), length), piece[is_piece]))
        bare = np.flatnonzero(~single)
        found.append((bare, np.ones(len(bare), np.int64), np.full(len(bare), -1)))
        place, length, piece = (np.concatenate(x) for x in zip(*found))
        return place, length, piece

    def best(self, chunks: Sequence[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Per chunk: ids of its best segmentation, its score, and what the second best loses."""
        sizes = np.array([len(c) for c in chunks])
        codes = np.frombuffer("".join(chunks).encode("utf-32-le"), "<u4")
        first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        owner = np.repeat(np.arange(len(chunks)), sizes)
        offset = np.arange(len(codes)) - first[owner]
        place, length, piece = self.edges(codes, sizes[owner] - offset)
        score = np.where(piece >= 0, self.scores[piece], self.unknown_score)
        # a chunk of n characters has n + 1 places
        source, target = place + owner[place], place + owner[place] + length
        begin, end = offset[place], offset[place] + length
        forward = np.full(len(codes) + len(chunks), -np.inf)
        forward[first + np.arange(len(chunks))] = 0
        backward = np.full(len(forward), -np.inf)
        last = first + np.arange(len(chunks)) + sizes
        backward[last] = 0
        came = np.zeros(len(forward), np.int64)
        # edges with one begin (or one end) meet each place of a chunk once
        by_begin = np.argsort(begin, kind="stable")
        for e in np.split(by_begin, np.flatnonzero(np.diff(begin[by_begin])) + 1):
            new = forward[source[e]] + score[e]
            better = new > forward[target[e]]
            e = e[better]
            forward[target[e]] = new[better]
            came[target[e]] = e
        by_end = np.argsort(-end, kind="stable")
        for e in np.split(by_end, np.flatnonzero(np.diff(end[by_end])) + 1):
            backward[source[e]] = np.maximum(backward[source[e]], score[e] + backward[target[e]])
        chosen = np.zeros(len(place), bool)
        at, open_ = last.copy(), np.arange(len(chunks))
        while len(open_):
            e = came[at[open_]]
            chosen[e] = True
            at[open_] = source[e]
            open_ = open_[offset[place[e]] > 0]
        other = np.flatnonzero(~chosen)
        second = np.full(len(chunks), -np.inf)
        np.maximum.at(second, owner[place[other]], (forward[source] + score + backward[target])[other])
        total = forward[last]
        path = np.flatnonzero(chosen)
        path = path[np.argsort(place[path], kind="stable")]
        ids, odd = piece[path].astype(np.int32), {int(owner[place[e]]) for e in path[piece[path] < 0]}
        bounds = np.searchsorted(owner[place[path]], np.arange(len(chunks) + 1))
        out = [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        for k in odd:
            text, where = chunks[k], offset[place[path[bounds[k] : bounds[k + 1]]]]
            spelled = [[i] if i >= 0 else self.spell(text[w]) for i, w in zip(out[k].tolist(), where.tolist())]
            out[k] = np.array([x for part in spelled for x in part], np.int32)
        return out, total, total - second

    def n_best(self, chunk: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations of a chunk, by A-star from its end.

        Of equally promising ways the newest goes on, so one of many equal ways is followed to its
        end, and no place is left more than n times: the heuristic is exact, so what leaves a place
        later is no better than n ways that left it before.
        """
        into: list[list[tuple[int, float, int]]] = [[] for _ in range(len(chunk) + 1)]
        forward = [0.0] + [-np.inf] * len(chunk)
        for start in range(len(chunk)):
            lone = True
            for stop in range(start + 1, min(len(chunk), start + self.longest) + 1):
                piece = self.piece_of.get(chunk[start:stop])
                if piece is not None:
                    lone = lone and stop > start + 1
                    into[stop].append((start, float(self.scores[piece]), piece))
            if lone:
                into[start + 1].append((start, float(self.unknown_score), -1))
        for stop in range(1, len(chunk) + 1):
            forward[stop] = max(forward[start] + score for start, score, _ in into[stop])
        heap = [(-forward[-1], 0, len(chunk), 0.0, None)]
        order, out = 0, []
        left = [n] * (len(chunk) + 1)
        while heap and len(out) < n:
            _, _, at, behind, tail = heapq.heappop(heap)
            if not left[at]:
                continue
            left[at] -= 1
            if at == 0:
                ids: list[int] = []
                while tail is not None:
                    (start, piece), tail = tail
                    ids += [piece] if piece >= 0 else self.spell(chunk[start])
                out.append((behind, ids))
                continue
            for start, score, piece in into[at]:
                order -= 1
                total = behind + score
                heapq.heappush(heap, (-(total + forward[start]), order, start, total, ((start, piece), tail)))
        return out

    def decode(self, ids: Sequence[int]) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids)).removeprefix(b" ")


def cheapest_ways(options: Sequence[Sequence[float]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n cheapest ways to take one entry of each ascending list: (sum, places).

    A way is reached from the one with its last non-zero place stepped back, so each is met once
    and at most n * len(options) sums are made.
    """
    start = (0,) * len(options)
    heap = [(sum(o[0] for o in options), start)]
    out = []
    while heap and len(out) < n:
        cost, way = heapq.heappop(heap)
        out.append((cost, way))
        last = max((k for k, i in enumerate(way) if i), default=0)
        for k in range(last, len(way)):
            if way[k] + 1 < len(options[k]):
                further = (*way[:k], way[k] + 1, *way[k + 1 :])
                heapq.heappush(heap, (sum(o[i] for o, i in zip(options, further)), further))
    return out


class Encoder:
    """A worker's cache of chunks over a model, bounded in chunks and in characters."""

    def __init__(self, model: Model, best: int = BEST, cache: int = CACHE):
        self.model, self.n, self.most = model, best, cache
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.chunk: list[str] = []
        self.characters = 0
        self.flat = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.at, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.score, self.loss = np.zeros(1 << 14), np.zeros(1 << 14)
        self.others: dict[int, list[tuple[float, bytes]]] = {}

    def add(self, chunks: list[str]) -> None:
        for start in range(0, len(chunks), 8192):
            part = chunks[start : start + 8192]
            ids, score, loss = self.model.best(part)
            base, total = len(self.chunk), sum(map(len, ids))
            while base + len(part) > len(self.at):
                self.at, self.size, self.score, self.loss = (
                    np.concatenate((x, np.zeros_like(x))) for x in (self.at, self.size, self.score, self.loss)
                )
            while self.used + total > len(self.flat):
                self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
            here = slice(base, base + len(part))
            self.size[here] = [len(x) for x in ids]
            self.at[here] = self.used + np.cumsum(self.size[here]) - self.size[here]
            self.flat[self.used : self.used + total] = np.concatenate(ids)
            self.used += total
            self.score[here], self.loss[here] = score, loss
            self.index.update(zip(part, range(base, base + len(part))))
            self.chunk += part

    def alternatives(self, k: int) -> list[tuple[float, bytes]]:
        """Of a chunk: what each of its n best loses, with its ids as bytes. The first loses 0."""
        if k not in self.others:
            found = self.model.n_best(self.chunk[k], self.n)
            first = self.flat[self.at[k] : self.at[k] + self.size[k]].tobytes()
            rest = [(found[0][0] - s, np.array(ids, np.int32).tobytes()) for s, ids in found]
            # of equally good ones the search may meet another first
            rest = [x for x in rest if x[1] != first][: self.n - 1]
            self.others[k] = [(0.0, first), *rest]
        return self.others[k]

    def encode(self, texts: list[str]) -> Iterator[tuple[float, bytes, list[tuple[float, bytes]]]]:
        """Per text: best score, its ids as bytes, and its n best as (score, ids)."""
        written = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        whole = "".join(written)
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
        bounds = np.concatenate(([0], np.cumsum([len(t) for t in written])))
        new = self.model.starts(codes) if len(codes) else np.zeros(0, bool)
        new[bounds[:-1][bounds[:-1] < len(codes)]] = True
        begin = np.flatnonzero(new)
        edges = begin.tolist() + [len(codes)]
        chunks = [whole[a:b] for a, b in zip(edges, edges[1:])]
        fresh = {c for c in chunks if c not in self.index}
        size = sum(map(len, fresh))
        if len(self.index) + len(fresh) > self.most or self.characters + size > CACHE_CHARACTERS:
            self.clear()
            fresh = set(chunks)
            size = sum(map(len, fresh))
        if fresh:
            self.add(sorted(fresh))
            self.characters += size
        index = np.fromiter(map(self.index.__getitem__, chunks), np.int64, len(chunks))
        parts = np.searchsorted(begin, bounds)
        for a, b in zip(parts[:-1].tolist(), parts[1:].tolist()):
            own = index[a:b]
            size = self.size[own]
            ends = np.cumsum(size)
            ids = self.flat[np.repeat(self.at[own] - (ends - size), size) + np.arange(int(size.sum()))].tobytes()
            score = float(self.score[own].sum())
            yield score, ids, self._n_best(own, ends, size, score, ids)

    def _n_best(self, own: np.ndarray, ends: np.ndarray, size: np.ndarray, score: float, ids: bytes) -> list[tuple[float, bytes]]:
        loss = self.loss[own]
        near = np.sort(np.argsort(loss, kind="stable")[: self.n - 1])
        near = near[np.isfinite(loss[near])]
        options = [self.alternatives(int(own[k])) for k in near]
        out = []
        for lost, way in cheapest_ways([[lost for lost, _ in o] for o in options], self.n):
            parts, at = [], 0
            for k, o, i in zip(near, options, way):
                if i:
                    parts += [ids[at : 4 * int(ends[k] - size[k])], o[i][1]]
                    at = 4 * int(ends[k])
            out.append((score - lost, b"".join([*parts, ids[at:]])))
        return out


_LIST = pa.list_(pa.int32())


def _as_list(ids: bytes) -> list[int]:
    return np.frombuffer(ids, np.int32).tolist()


def _encode(
    batches: Iterator[pa.RecordBatch], path: str, best: int, with_ids: bool, with_n_best: bool
) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(Model(path), best)
    for batch in rows(batches, 64):
        raw = batch.column("text").to_pylist()
        counts, scores, digests, others, trips, ids_out, best_out = [], [], [], [], [], [], []
        for text, (_, ids, ways) in zip(raw, encoder.encode([x.decode("utf-8", "replace") for x in raw])):
            listed = _as_list(ids)
            counts.append(len(listed))
            scores.append([s for s, _ in ways])
            digests.append(hashlib.sha256(ids).hexdigest())
            all_ways = hashlib.sha256()
            for _, way in ways:
                all_ways.update(hashlib.sha256(way).digest())
            others.append(all_ways.hexdigest())
            trips.append(encoder.model.decode(listed) == text)
            if with_ids:
                ids_out.append(listed)
            if with_n_best:
                best_out.append([_as_list(w) for _, w in ways])
        arrays = [
            batch.column("doc_id"),
            pa.array(counts, pa.int64()),
            pa.array(scores, pa.list_(pa.float64())),
            pa.array(digests, pa.string()),
            pa.array(others, pa.string()),
            pa.array(trips, pa.bool_()),
        ]
        names = ["doc_id", "n_pieces", "scores", "ids_sha256", "n_best_sha256", "round_trip"]
        if with_ids:
            arrays, names = [*arrays, pa.array(ids_out, _LIST)], [*names, "ids"]
        if with_n_best:
            arrays, names = [*arrays, pa.array(best_out, pa.list_(_LIST))], [*names, "n_best"]
        yield pa.RecordBatch.from_arrays(arrays, names)


def encode_texts(
    docs: DataFrame,
    path: str,
    key: str = "doc_id",
    text: str = "text",
    best: int = BEST,
    with_ids: bool = True,
    with_n_best: bool = False,
) -> DataFrame:
    """Per document: doc_id, n_pieces, scores of the N best, digests of the best ids and of all N
    best, round_trip (decoding the ids gives the text), and if asked for ids and n_best."""
    texts = documents(docs, key, text)
    schema = f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, n_pieces long, scores array<double>, ids_sha256 string, n_best_sha256 string, round_trip boolean"
    schema += ", ids array<int>" * with_ids + ", n_best array<array<int>>" * with_n_best
    return texts.mapInArrow(partial(_encode, path=path, best=best, with_ids=with_ids, with_n_best=with_n_best), schema)


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    model = Model(path)
    for batch in rows(batches):
        texts = [None if x is None else model.decode(x).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])


def decode_ids(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Per row: doc_id and the text of its ids; NULL ids give NULL."""
    plain = encoded.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{ids}`").cast("array<int>").alias("ids"))
    return plain.mapInArrow(partial(_decode, path=path), f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, text string")
