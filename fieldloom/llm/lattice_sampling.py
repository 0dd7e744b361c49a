"""SentencePiece segmentations sampled without replacement, and decoding.

A text's segmentations are the paths of a lattice over its characters; a piece's weight falls
with its place in the model's merge order (Zipf). Paths are drawn by Gumbel top-k: perturb every
path's log-probability with Gumbel noise and take the k largest. The search is top-down: the open
regions of path space are kept with their largest perturbed value, an upper bound of all they
hold, and the best one is opened, as A-star does. An opened region gives its best path at once,
and splits into one region for each place where another path can leave it. Values are kept as
logarithms of arrival times, t = exp(-value), since a region's t is its parent's plus an
exponential over its mass. No piece joins certain pairs of characters, so a text is a row of chunks
between these, whose lattices are independent and are cached by chunk; drawing runs over all chunks
of many texts at once. Masses are sums of positive terms only, so rare paths count as they are.
Noise is a hash of (seed, row key, sample, chunk, step): no draw depends on how rows are dealt to
tasks.

The inclusion score of a path is log P(it is among the k drawn), given the (k+1)th value.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, partial
from math import exp, expm1, inf, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text, rows_out, text_batches
from .hashing import BASE, STEP, mix, mix_one, run_hashes

SPACE = "▁"
POOL_EDGES = 6_000_000
#: Characters whose pairs are looked up in a table.
DENSE = 512
#: Exponent of the Zipf weights; below one, so that fine segmentations keep some mass.
SHARPNESS = 0.3

SAMPLES = pa.schema([("doc_id", pa.int64()), ("rank", pa.int32()), ("ids", pa.list_(pa.int32())), ("log_prob", pa.float64()), ("perturbed", pa.float64()), ("log_inclusion", pa.float64())])
DIGEST = pa.schema([("doc_id", pa.int64()), ("rank", pa.int32()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("log_prob", pa.float64()), ("perturbed", pa.float64()), ("log_inclusion", pa.float64()), ("restored", pa.bool_())])


class Lattices:
    """The chunks' lattices, as arrays of nodes and of edges sorted by falling probability."""

    def __init__(self, path: str, sharpness: float = SHARPNESS):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        self.ids, self.weight, self.raw, self.bytes_of = {}, {}, [], {}
        for i in range(size):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                self.bytes_of[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif self.model.is_control(i) or self.model.is_unknown(i):
                self.raw.append(b"" if self.model.is_control(i) else " ⁇ ".encode())
            else:
                self.raw.append(piece.encode())
                self.ids[piece] = i
                self.weight[i] = -sharpness * log(2.0 - self.model.get_score(i))
        self.byte_weight = -sharpness * log(2.0 + size)
        self.size = size
        shown = [r.replace(SPACE.encode(), b" ") for r in self.raw]
        self.shown = np.frombuffer(b"".join(shown), np.uint8), np.fromiter(map(len, shown), np.int64, size)
        self._join_pairs()
        self._index()
        self.clear()

    def _join_pairs(self) -> None:
        """The pairs of characters that stand side by side in a piece: a table over the characters with most pairs, a sorted array of the rest."""
        pairs = {(x, y) for p in self.ids for x, y in zip(p, p[1:], strict=False)}
        met = Counter(c for pair in pairs for c in pair)
        dense = {c: n for n, (c, _) in enumerate(sorted(met.items(), key=lambda x: (-x[1], x[0]))[: DENSE - 1], 1)}
        self.dense = np.zeros(0x110000, np.int16)
        self.dense[[ord(c) for c in dense]] = list(dense.values())
        self.joins = np.zeros((DENSE, DENSE), bool)
        for x, y in pairs:
            self.joins[dense.get(x, 0), dense.get(y, 0)] |= x in dense and y in dense
        self.far = np.array(sorted(ord(x) << 21 | ord(y) for x, y in pairs if x not in dense or y not in dense), np.int64)

    def _index(self) -> None:
        """By length, the sorted hashes of pieces with their ids, and of the beginnings of longer pieces."""
        by: dict[int, list[tuple[int, int]]] = {}
        starts: dict[int, set[int]] = {}
        for piece, i in self.ids.items():
            h, power = 0, 1
            for n, c in enumerate(piece, 1):
                h = (h + (ord(c) + 1) * power) % (1 << 64)
                power = power * int(BASE) % (1 << 64)
                if n < len(piece):
                    starts.setdefault(n, set()).add(h)
            by.setdefault(len(piece), []).append((h, i))
        self.pieces = {n: (np.array([h for h, _ in sorted(x)], np.uint64), np.array([i for _, i in sorted(x)], np.int64)) for n, x in by.items()}
        self.starts = {n: np.array(sorted(x), np.uint64) for n, x in starts.items()}
        self.weights = np.zeros(self.size)
        for i, w in self.weight.items():
            self.weights[i] = w

    def clear(self) -> None:
        self.roots: dict[str, int] = {}
        self.fallback: list[list[int]] = []
        self.fallback_of: dict[str, int] = {}
        self.nodes, self.edges = 0, 0
        self.flat = (np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.int32), np.zeros(1 << 14), np.zeros(1 << 14), np.zeros(1 << 14, np.int32))

    def roots_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(lattice of every chunk of all texts, in order; end of each text's chunks)."""
        normal = [self.model.normalize(t) if t else "" for t in texts]
        joined = "".join(normal)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        text_ends = np.cumsum(np.fromiter(map(len, normal), np.int64, len(normal)))
        begins = np.ones(len(codes) + 1, bool)
        if len(codes) > 1:
            d = self.dense[codes]
            on = self.joins[d[:-1], d[1:]]
            if len(self.far):
                rest = np.flatnonzero((d[:-1] == 0) | (d[1:] == 0))
                pair = (codes[rest] << 21) | codes[rest + 1]
                on[rest] = self.far[np.minimum(np.searchsorted(self.far, pair), len(self.far) - 1)] == pair
            begins[1:-1] = ~on
        begins[text_ends] = True
        starts = np.flatnonzero(begins)
        starts, ends = starts[:-1], starts[1:]
        _, which, of = np.unique(run_hashes(codes, starts, ends), return_index=True, return_inverse=True)
        sizes = ends - starts
        chunk = np.repeat(np.arange(len(starts)), sizes)
        same = codes == codes[np.minimum(starts[which][of][chunk] + np.arange(len(codes)) - starts[chunk], len(codes) - 1)] if len(codes) else begins[:0]
        if not same.all() or (sizes != sizes[which][of]).any():  # two chunks of one hash
            which = of = np.arange(len(starts))
        distinct = [joined[a:b] for a, b in zip(starts[which].tolist(), ends[which].tolist(), strict=True)]
        self.learn(distinct)
        roots = np.fromiter(map(self.roots.__getitem__, distinct), np.int64, len(distinct))[of]
        return roots, np.searchsorted(starts, text_ends)

    def _spelled(self, char: str) -> int:
        at = self.fallback_of.get(char)
        if at is None:
            at = self.fallback_of[char] = self.size + len(self.fallback)
            self.fallback.append([self.bytes_of[b] for b in char.encode("utf-8", "replace")])
        return at

    def learn(self, chunks: list[str]) -> None:
        if self.edges > POOL_EDGES:
            self.clear()
        new = list(dict.fromkeys(c for c in chunks if c not in self.roots))
        if new:
            self._add(new)

    def _add(self, new: list[str]) -> None:
        """The lattices of new chunks, all at once: pieces by hashed substrings, backward masses by distance to the chunk's end."""
        lengths = np.fromiter(map(len, new), np.int64, len(new))
        starts = np.cumsum(lengths) - lengths
        codes = np.frombuffer("".join(new).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        n = len(codes)
        left = np.repeat(starts + lengths, lengths) - np.arange(n)  # characters up to the chunk's end
        src, span, piece = [], [], []
        live, h, power, length = np.arange(n), np.zeros(n, np.uint64), np.uint64(1), 0
        while len(live):
            h = h + (codes[live + length] + np.uint64(1)) * power
            length, power = length + 1, power * BASE
            if length in self.pieces:
                hashes, ids = self.pieces[length]
                at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                hit = np.flatnonzero(hashes[at] == h)
                src.append(live[hit])
                span.append(np.full(len(hit), length))
                piece.append(ids[at[hit]])
            if length == 1:  # characters out of the vocabulary are spelled in bytes
                lone = np.setdiff1d(live, src[0] if src else live[:0], assume_unique=True)
                src.append(lone)
                span.append(np.ones(len(lone), np.int64))
                piece.append(np.fromiter((self._spelled(chr(int(c))) for c in codes[lone]), np.int64, len(lone)))
            if length not in self.starts:
                break
            more = self.starts[length]
            at = np.minimum(np.searchsorted(more, h), len(more) - 1)
            on = (more[at] == h) & (left[live] > length)
            live, h = live[on], h[on]
        src, span, piece = map(np.concatenate, (src, span, piece))
        spelled = piece >= self.size
        w = np.where(spelled, 0.0, self.weights[np.where(spelled, 0, piece)])
        if spelled.any():
            w[spelled] = [self.byte_weight * len(self.fallback[p - self.size]) for p in piece[spelled].tolist()]
        dst = np.where(span == left[src], n, src + span)
        order = np.lexsort((src, left[src]))
        src, dst, w, piece = src[order], dst[order], w[order], piece[order]
        beta = np.zeros(n + 1)
        cuts = np.flatnonzero(np.diff(left[src], prepend=0))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(src)], strict=True):
            own = src[a:b]
            first = np.flatnonzero(np.diff(own, prepend=-1))
            v = w[a:b] + beta[dst[a:b]]
            top = np.maximum.reduceat(v, first)
            total = np.add.reduceat(np.exp(v - np.repeat(top, np.diff(np.append(first, b - a)))), first)
            beta[own[first]] = top + np.log(total)
        logp = w + beta[dst] - beta[src]
        order = np.lexsort((-logp, src))
        src, dst, logp, piece = src[order], dst[order], logp[order], piece[order]
        first = np.searchsorted(src, np.arange(n))
        p = np.exp(logp)
        # a likely piece's logarithm comes from the sum of its rivals, so that it is right however little they hold
        other = np.add.reduceat(np.where(np.isin(np.arange(len(src)), first, assume_unique=True), 0.0, p), first)
        logp[first] = np.where(other < 0.5, np.log1p(-np.minimum(other, 0.5)), logp[first])
        running = np.cumsum(p)
        cum = running - np.concatenate([[0.0], running])[first][src]
        cum[np.append(first[1:], len(src)) - 1] = 2.0
        k = len(src)
        self.flat = tuple(_room(x, used) for x, used in zip(self.flat, (self.nodes + n + 1, *[self.edges + k] * 4), strict=True))
        nodes, edges = self.nodes, self.edges
        self.flat[0][nodes : nodes + n + 1] = edges + np.append(first, k)
        for x, values in zip(self.flat[1:], (np.where(dst == n, -1, nodes + dst), logp, cum, piece), strict=True):
            x[edges : edges + k] = values
        self.roots.update(zip(new, (nodes + starts).tolist(), strict=True))
        self.nodes, self.edges = nodes + n, edges + k

    def draw(self, roots: np.ndarray, noise: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log-probability of each chunk's path, end of its edges, edges), by ancestral sampling."""
        first, nxt, logp, cum, _ = self.flat
        total, counts = np.zeros(len(roots)), np.zeros(len(roots), np.int64)
        steps, live, node, step = [], np.arange(len(roots)), roots, 0
        while len(live):
            u = _uniform(mix(noise[live] + np.uint64(step) * STEP))
            e = first[node]
            far = np.flatnonzero(u >= cum[e])
            while len(far):
                e[far] += 1
                far = far[u[far] >= cum[e[far]]]
            total[live] += logp[e]
            counts[live] += 1
            steps.append((live, e))
            node = nxt[e].astype(np.int64)
            on = node >= 0
            live, node, step = live[on], node[on], step + 1
        ends = np.cumsum(counts)
        starts = ends - counts
        edges = np.empty(ends[-1] if len(ends) else 0, np.int64)
        for s, (at, e) in enumerate(steps):
            edges[starts[at] + s] = e
        return total, ends, edges

    def left(self, root: int, excluded: list[list[int]]) -> tuple[list[dict[int, int]], list[float]]:
        """Over the trie of the excluded paths of a chunk: per trie node, its excluded edges with the node that each leads to (-1 at the end), and the share of its mass that no excluded path holds."""
        first, nxt, logp, _, _ = self.flat
        todo, kids = [(root, 0, excluded)], []
        for node, step, paths in todo:  # grows as it goes
            by: dict[int, list[list[int]]] = {}
            for x in paths:
                by.setdefault(x[step], []).append(x)
            own = {}
            for e, those in by.items():
                after = int(nxt[e])
                own[e] = -1 if after < 0 else len(todo)
                if after >= 0:
                    todo.append((after, step + 1, those))
            kids.append(own)
        share = [0.0] * len(todo)
        for i in range(len(todo) - 1, -1, -1):
            node, own = todo[i][0], kids[i]
            for e in range(int(first[node]), int(first[node + 1])):
                j = own.get(e)
                share[i] += exp(logp[e]) * (1.0 if j is None else share[j] if j >= 0 else 0.0)
        return kids, share

    def draw_other(self, root: int, excluded: list[list[int]], noise: int) -> tuple[list[int], float] | None:
        """A path of a chunk other than those excluded, or None if there is no other."""
        first, nxt, logp, _, _ = self.flat
        kids, share = self.left(root, excluded)
        if not share[0]:
            return None
        node, at, out, total, step = root, 0, [], 0.0, 0
        while node >= 0:
            own = kids[at] if at >= 0 else {}
            u = _uniform_one(mix_one(noise + step * int(STEP))) * (share[at] if at >= 0 else 1.0)
            pick = -1
            for e in range(int(first[node]), int(first[node + 1])):
                j = own.get(e)
                mass = exp(logp[e]) * (1.0 if j is None else share[j] if j >= 0 else 0.0)
                if mass:
                    pick = e  # the last one, if rounding leaves u over
                    if u < mass:
                        break
                    u -= mass
            out.append(pick)
            total += float(logp[pick])
            node, at, step = int(nxt[pick]), own.get(pick, -1) if at >= 0 else -1, step + 1
        return out, total

    def ids_of(self, edges: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all paths one after the other, end of each path's ids), of paths of edges that end at `ends`."""
        pieces = self.flat[4][edges]
        if len(pieces) and pieces.max() >= self.size:
            spelled = pieces >= self.size
            sizes = np.fromiter(map(len, self.fallback), np.int64, len(self.fallback))
            bytes_ = np.fromiter((i for x in self.fallback for i in x), np.int64, int(sizes.sum()))
            which = np.where(spelled, pieces - self.size, 0)
            counts = np.where(spelled, sizes[which], 1)
            total = np.cumsum(counts)
            rank = np.arange(int(total[-1])) - np.repeat(total - counts, counts)
            begin = (np.cumsum(sizes) - sizes)[which]
            ids = np.where(np.repeat(spelled, counts), bytes_[np.minimum(np.repeat(begin, counts) + rank, len(bytes_) - 1)], np.repeat(pieces, counts))
            return ids.astype(np.int32), np.concatenate([[0], total])[ends]
        return pieces.astype(np.int32), ends

    def decode(self, ids) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text

    def restored(self, ids: np.ndarray, ends: np.ndarray, texts: list[str]) -> list[bool]:
        """Whether decoding each path's ids gives its text back, its space marks being spaces."""
        flat, sizes = self.shown
        counts = sizes[ids]
        total = np.cumsum(counts)
        at = np.arange(int(total[-1]) if len(total) else 0) + np.repeat((np.cumsum(sizes) - sizes)[ids] - (total - counts), counts)
        raw = flat[at].tobytes()
        cuts = np.concatenate([[0], total])[np.concatenate([[0], ends])].tolist()
        out = []
        for i, text in enumerate(texts):
            want, a, b = text.replace(SPACE, " "), cuts[i], cuts[i + 1]
            a += raw[a : a + 1] == b" "
            out.append(raw[a:b] == want.encode("utf-8", "surrogatepass") or self.decode(ids[ends[i - 1] if i else 0 : ends[i]].tolist()) == want)
        return out


def _room(x: np.ndarray, used: int) -> np.ndarray:
    """x, or a copy of at least twice its size if it is too small."""
    if used <= len(x):
        return x
    out = np.zeros(max(used, 2 * len(x)), x.dtype)
    out[: len(x)] = x
    return out


@lru_cache(maxsize=2)
def lattices(path: str, sharpness: float) -> Lattices:
    return Lattices(path, sharpness)


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def _uniform_one(h: int) -> float:
    return ((h >> 11) + 0.5) / (1 << 53)


def _noise(key: np.ndarray, chunk: np.ndarray) -> np.ndarray:
    return mix(key + chunk.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class _Path:
    """A drawn path: its chunks' edges, and the arrival times of the regions where others leave it."""

    __slots__ = ("edges", "ends", "before", "log_prob", "log_t", "from_chunk", "open", "excluded")

    def __init__(self, edges, ends, before, log_prob, log_t, from_chunk, open_, excluded):
        self.edges, self.ends, self.before, self.log_prob, self.log_t = edges, ends, before, log_prob, log_t
        self.from_chunk, self.open, self.excluded = from_chunk, open_, excluded

    def chunk(self, i: int) -> list[int]:
        return self.edges[self.ends[i - 1] if i else 0 : self.ends[i]].tolist()


@np.errstate(over="ignore")
def sample_paths(lat: Lattices, keys: np.ndarray, texts: list[str], k: int, seed: int = 0) -> tuple[list[list[_Path]], list[list[float]]]:
    """Per text its k distinct segmentations by falling perturbed value, or all there are, and their inclusion scores."""
    roots, ends = lat.roots_of(texts)
    firsts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
    key = mix(keys.astype(np.int64).view(np.uint64) * STEP + np.uint64(seed + 1))
    drawn: list[list[_Path]] = [[] for _ in texts]
    log_t = np.log(-np.log(_uniform(mix(key + np.uint64(77))))).tolist()
    # (text, chunk that was opened or -1, its edges, log-probability up to and with it, arrival, parent, excluded paths)
    jobs = [(i, -1, [], 0.0, log_t[i], None, []) for i in range(len(texts))]
    plain = key.tolist()
    for sample in range(k):
        _extend(lat, jobs, roots, firsts, ends, key, sample, drawn)
        if sample + 1 < k:
            jobs = [j for i in range(len(texts)) if (j := _open(lat, i, drawn[i], roots, int(firsts[i]), plain[i], sample + 1))]
    scores = []
    for own in drawn:
        bound = min((float(p.open.min()) for p in own if len(p.open)), default=inf)
        scores.append([_log_inclusion(p.log_prob + bound) for p in own])
    return drawn, scores


def _log_inclusion(x: float) -> float:
    """log P(arrival before the bound), x the logarithm of rate times bound."""
    return 0.0 if x > 40 else (log(-expm1(-exp(x))) if x > -700 else x)


def sample_texts(lat: Lattices, keys: np.ndarray, texts: list[str], k: int, seed: int = 0) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """Per text its (ids, log_prob, perturbed, log_inclusion), as sample_paths has them."""
    drawn, scores = sample_paths(lat, keys, texts, k, seed)
    ids, ends = _all_ids(lat, drawn)
    each = iter(np.split(ids, ends[:-1]) if len(ends) else [])
    return [[(next(each), p.log_prob, -p.log_t, x) for p, x in zip(own, score, strict=True)] for own, score in zip(drawn, scores, strict=True)]


def _all_ids(lat: Lattices, drawn: list[list[_Path]]) -> tuple[np.ndarray, np.ndarray]:
    paths = [p.edges for own in drawn for p in own]
    edges = np.concatenate(paths) if paths else np.empty(0, np.int64)
    return lat.ids_of(edges, np.cumsum(np.fromiter(map(len, paths), np.int64, len(paths))))


def _open(lat: Lattices, text: int, own: list[_Path], roots: np.ndarray, first: int, key: int, sample: int):
    """The best open region of a text, taken: the job that draws its path, or None if all paths are drawn."""
    while True:
        best, at, t = None, 0, inf
        for p in own:
            if len(p.open) and (least := p.open[i := int(p.open.argmin())]) < t:
                best, at, t = p, i, float(least)
        if best is None:
            return None
        i = best.from_chunk + at
        best.open[at] = inf
        excluded = best.excluded.get(i, []) + [best.chunk(i)]
        other = lat.draw_other(int(roots[first + i]), excluded, mix_one(key + sample * int(STEP) + i + (1 << 40)))
        if other is not None:
            edges, lp = other
            return text, i, edges, float(best.before[i]) + lp, t, best, excluded


def _extend(lat: Lattices, jobs: list, roots: np.ndarray, firsts: np.ndarray, lasts: np.ndarray, key: np.ndarray, sample: int, drawn: list[list[_Path]]) -> None:
    """Draw all chunks after the opened ones, for all jobs at once, and set the arrival times of the new regions."""
    if not jobs:
        return
    text = np.array([j[0] for j in jobs])
    begin = np.array([j[1] + 1 for j in jobs], np.int64)
    sizes = lasts[text] - firsts[text] - begin
    row = np.repeat(np.arange(len(jobs)), sizes)
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(row)) - (starts - begin)[row]
    noise = _noise(mix(key[text] + np.uint64(sample) * STEP)[row], place)
    lp, ends, edges = lat.draw(roots[firsts[text][row] + place], noise)
    # sums by text, so that no value depends on the texts around it
    before = np.empty(len(row))
    for j, a, n in zip(jobs, starts.tolist(), sizes.tolist(), strict=True):
        if n:
            before[a] = j[3]
            before[a + 1 : a + n] = lp[a : a + n - 1]
            before[a : a + n].cumsum(out=before[a : a + n])
    with np.errstate(divide="ignore"):
        rest = np.log(-np.expm1(np.minimum(lp, 0.0)))  # -inf where a chunk has one path only
        wait = np.log(-np.log(_uniform(mix(noise + np.uint64(0xABCDEF))))) - before - rest
    arrive = np.logaddexp(np.array([j[4] for j in jobs])[row], wait) if len(row) else np.empty(0)
    edge_starts = np.concatenate([[0], ends])
    for r, (i, opened, new, log_prob, t, parent, excluded) in enumerate(jobs):
        a, b = int(starts[r]), int(starts[r] + sizes[r])
        own_ends, own_edges = ends[a:b] - edge_starts[a], edges[edge_starts[a] : edge_starts[b]]
        total = float(before[b - 1] + lp[b - 1]) if b > a else log_prob
        if parent is None:
            drawn[i].append(_Path(own_edges, own_ends, before[a:b], total, t, 0, arrive[a:b].copy(), {}))
            continue
        head = int(parent.ends[opened - 1]) if opened else 0
        all_edges = np.concatenate([parent.edges[:head], np.array(new, np.int64), own_edges])
        all_ends = np.concatenate([parent.ends[:opened], [head + len(new)], head + len(new) + own_ends])
        all_before = np.concatenate([parent.before[: opened + 1], before[a:b]])
        # the opened chunk may be left again, for a path that is neither excluded nor the new one
        left = lat.left(int(roots[firsts[i] + opened]), [*excluded, new])[1][0]
        again = inf
        if left > 0:
            u = _uniform_one(mix_one(int(key[i]) + sample * int(STEP) + opened + (1 << 41)))
            again = float(np.logaddexp(t, log(-log(u)) - float(parent.before[opened]) - log(left)))
        drawn[i].append(_Path(all_edges, all_ends, all_before, total, t, opened, np.concatenate([[again], arrive[a:b]]), {opened: excluded}))


def _sample(path: str, sharpness: float, k: int, seed: int, digest: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lat = lattices(path, sharpness)
    for batch in text_batches(batches, most_bytes=1 << 20, most_rows=1024):
        texts, docs = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
        keys = np.array([d or 0 for d in docs], np.int64)
        drawn, scores = sample_paths(lat, keys, texts, k, seed)
        ids, ends = _all_ids(lat, drawn)
        counts = [len(own) for own in drawn]
        of = [i for i, n in enumerate(counts) for _ in range(n)]
        paths = [p for own in drawn for p in own]
        columns = [[docs[i] for i in of], [r + 1 for n in counts for r in range(n)]]
        values = [[p.log_prob for p in paths], [-p.log_t for p in paths], [x for own in scores for x in own]]
        if digest:
            raw, cuts = ids.astype("<u4").tobytes(), [0, *(4 * ends).tolist()]
            sizes = np.diff(ends, prepend=0)
            yield rows_out(DIGEST, [*columns, sizes, [zlib.crc32(raw[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], *values, lat.restored(ids, ends, [texts[i] for i in of])])
        else:
            yield rows_out(SAMPLES, [*columns, pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids)), *values])


def sample_segmentations(docs: DataFrame, model_path: str, k: int = 3, sharpness: float = SHARPNESS, seed: int = 0, digest: bool = False) -> DataFrame:
    """(doc_id, rank, ids, log_prob, perturbed, log_inclusion): up to k distinct segmentations of every whole text.

    With digest, ids become (n_pieces, ids_crc32, restored), restored telling whether decoding
    gives the text back. Null or empty text: one segmentation without ids. Null doc_id: seeded as
    0. Rows that repeat key and text repeat the samples. A text with fewer segmentations than k
    gives all of them, with inclusion score 0. Empty table: no rows. Other columns are ignored.
    """
    last = "n_pieces long, ids_crc32 long, log_prob double, perturbed double, log_inclusion double, restored boolean" if digest else "ids array<int>, log_prob double, perturbed double, log_inclusion double"
    return id_and_text(docs).mapInArrow(partial(_sample, model_path, sharpness, k, seed, digest), f"doc_id long, rank int, {last}")


def _decode(path: str, sharpness: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lat = lattices(path, sharpness)
    for batch in batches:
        texts = [lat.decode(i or []) for i in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rank"), pa.array(texts, pa.string())], names=["doc_id", "rank", "text"])


def decode_ids(samples: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, rank, text) of sampled ids: pieces joined, byte pieces as UTF-8 (wrong bytes replaced), without the space put before the text. Null ids: empty."""
    return samples.select("doc_id", "rank", "ids").mapInArrow(partial(_decode, model_path, SHARPNESS), "doc_id long, rank int, text string")
