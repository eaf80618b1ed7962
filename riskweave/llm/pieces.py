"""SentencePiece encoding by Gumbel top-k sampling without replacement, and decoding.

A text's segmentations into pieces of a given model form a lattice. A piece has the score -ln(rank + 2), its rank in
the model's own order, and bytes a fixed lower one, so a segmentation's probability is proportional to the product of
its pieces' scores, raised to ``theta``. Sums over the lattice from the right give each step's exact probability.

``top_k`` draws k distinct segmentations: Gumbel noise on every segmentation, and the k largest. A perturbed A-star
search finds them without listing segmentations. A node of its queue stands for all segmentations with some
beginning, less those that have left the node before; its bound is the largest noisy value among them, drawn from
the sum of their probabilities. To take a node is to follow the path that holds its largest value, whereby each step
leaves a node with the other choices, whose value is drawn below the parent's. In the code, exp(-value) is the
arrival time of a Poisson process, so a value below another is a later arrival. The arrival after the k-th gives each
sample's inclusion probability, 1 - exp(-p t). Noise comes from hashes of the row's key and the place in the text, so
a row's result depends on nothing else.

No piece goes over a word's end, so equal words share one lattice: those of the first chunks stay in memory (KEPT_EDGES),
others last for a chunk. Steps of all words of a chunk are drawn in one go, and its ids are made and decoded together.
Texts are handled in chunks of about half a million characters (a longer text makes one of its own).

Nulls: a null text gives null samples, an empty text one empty sample. A null key is a key like any other. A text with
fewer than k segmentations gives all it has, each with inclusion probability 1. Repeated rows get equal samples. Samples
of one text are distinct; of equal values the one drawn first comes first. An empty table gives an empty result; only the
named columns are read, so others may have any name (kept ones any but text, samples and round_trip).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm.common import bounded_batches, slices, table
from riskweave.llm.words import encoded, mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
LITERAL = "\udc01"  # stands for the space mark as an ordinary character, which only bytes may express; no text holds it
SAMPLES = 2
THETA = 0.5
SEED = 29
CHARS = 1 << 19
KEPT_EDGES = 1 << 20  # of units that stay in a task's lattice from chunk to chunk: about 35 MB
FADED = 120.0
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


class Vocabulary(NamedTuple):
    pieces: list[str]  # by id; bytes as the character they stand for
    is_byte: np.ndarray
    names: np.ndarray  # of all beginnings of pieces, in an open hash table
    ids: np.ndarray  # of the piece that such a beginning is, or -1
    shown: list[str]  # by id: its text, if it has one by itself
    part: np.ndarray  # by id: a byte that is only part of a character
    scores: np.ndarray  # by id
    byte_ids: np.ndarray  # by byte
    byte_score: float
    longest: int
    split: re.Pattern
    byte_table: np.ndarray  # bytes of all pieces, one after another
    byte_from: np.ndarray  # by id: where its bytes begin
    byte_sizes: np.ndarray


def _extend(name: np.ndarray, char: np.ndarray) -> np.ndarray:
    return (name + char + np.uint64(1)) * np.uint64(0xD1342543DE82EF95) ^ ((name + char) >> np.uint64(29))


def load(path: str = MODEL, theta: float = THETA) -> Vocabulary:
    """Read a SentencePiece model; only its list of pieces is used."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    pieces, is_byte, byte_ids = [], np.zeros(n, dtype=bool), np.full(256, -1)
    usable: dict[str, int] = {}
    for i in range(n):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            is_byte[i] = True
            byte_ids[int(piece[3:5], 16)] = i
            piece = piece[3:5]
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            usable[piece] = i
        pieces.append(piece)
    rank = np.arange(n, dtype=np.float64)
    scores = -theta * np.log(rank + 2)
    found: dict[int, int] = {}
    for piece, i in usable.items():
        name = np.zeros(1, dtype=np.uint64)
        for k, char in enumerate(piece):
            name = _extend(name, np.array([ord(char)], dtype=np.uint64))
            key = int(name[0])
            found[key] = i if k == len(piece) - 1 else found.get(key, -1)
    slots = max(1 << 18, 1 << (2 * len(found)).bit_length())  # at most half of them are taken
    names, ids = np.zeros(slots, dtype=np.uint64), np.full(slots, -1)
    for key, i in found.items():
        slot = _slot(np.array([key], dtype=np.uint64), slots)[0]
        while names[slot]:
            slot = (slot + 1) & (slots - 1)
        names[slot], ids[slot] = key, i
    shown = [chr(int(p, 16)) if is_byte[i] else p.replace(SPACE, " ") for i, p in enumerate(pieces)]
    part = np.array([is_byte[i] and int(p, 16) > 0x7F for i, p in enumerate(pieces)])
    # Units end before a space that follows something else, and around line breaks if no piece has one.
    inner = any(SPACE in p.lstrip(SPACE) for p in usable)
    lines = not any("\n" in p for p in usable)
    split = re.compile(r"(?s).+" if inner else r"\n|%s+[^%s\n]*|[^%s\n]+" % ((SPACE,) * 3) if lines else r"%s+[^%s]*|[^%s]+" % ((SPACE,) * 3))
    raw = [bytes([int(p, 16)]) if is_byte[i] else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
    sizes = np.array(list(map(len, raw)), dtype=np.int64)
    joined = np.frombuffer(b"".join(raw), dtype=np.uint8)
    return Vocabulary(
        pieces, is_byte, names, ids, shown, part, scores, byte_ids, -theta * math.log(n) - 2, max(map(len, usable)), split, joined, np.cumsum(sizes) - sizes, sizes
    )


def _slot(name: np.ndarray, slots: int) -> np.ndarray:
    return ((name * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - slots.bit_length())).astype(np.int64)


def _find(v: Vocabulary, name: np.ndarray) -> np.ndarray:
    """Slot of each name, or -1."""
    slot = _slot(name, len(v.names))
    other = np.flatnonzero(v.names[slot] != name)
    while len(other):
        empty = v.names[slot[other]] == 0
        slot[other[empty]] = -1
        other = other[~empty]
        slot[other] = (slot[other] + 1) & (len(v.names) - 1)
        other = other[v.names[slot[other]] != name[other]]
    return slot


class Grown:
    """An array that grows at its end; only the first ``n`` places count."""

    def __init__(self, dtype: type, first: list | None = None):
        self.data, self.n = np.array(first or [], dtype=dtype), len(first or [])

    def add(self, values: np.ndarray) -> None:
        end = self.n + len(values)
        if end > len(self.data):
            wide = np.empty(max(end, 2 * self.n, 1024), dtype=self.data.dtype)
            wide[: self.n] = self.data[: self.n]
            self.data = wide
        self.data[self.n : end] = values
        self.n = end


class Lattice:
    """Of distinct units: each unit's nodes in order of what remains of it, each with its edges and chances.

    Units that were added first stay for the chunks that come; ``trim`` takes the others away again. What is said of a
    unit depends on nothing but the unit.
    """

    EDGES = ("piece", "width", "node", "to", "log_p", "upto", "only")

    def __init__(self, vocabulary: Vocabulary, units: list[str] = ()):
        self.vocabulary = vocabulary
        kinds = (np.int32, np.int32, np.int32, np.int32, np.float64, np.float64, np.bool_)
        self.grown = {name: Grown(kind) for name, kind in zip(self.EDGES, kinds, strict=True)}
        self.grown |= {"first": Grown(np.int64, [0]), "starts": Grown(np.int64)}  # first: of a node, and the end of the last
        self.numbers = _Numbers()
        self.numbered([list(units)])

    def __getattr__(self, name: str) -> np.ndarray:
        return self.__dict__["grown"][name].data

    def numbered(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Numbers of each text's units; new units are added."""
        rows = [np.fromiter(map(self.numbers.__getitem__, units), dtype=np.int64, count=len(units)) for units in texts]
        if self.numbers.fresh:
            self.add(self.numbers.fresh)
            self.numbers.fresh = []
        return rows

    def trim(self, most: int) -> None:
        """Take units away that came after the lattice had ``most`` edges."""
        if self.kept is not None:
            for name, g in self.grown.items():
                g.n = self.kept[name]
            self.numbers = _Numbers(self.numbers.base)
        elif self.grown["piece"].n > most:
            self.kept = {name: g.n for name, g in self.grown.items()}
            self.numbers = _Numbers(self.numbers)

    kept: dict[str, int] | None = None

    def add(self, units: list[str]) -> None:
        v = self.vocabulary
        chars = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        sizes = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        ends = np.cumsum(sizes)
        left = np.repeat(ends, sizes) - np.arange(len(chars))  # characters from here to the unit's end
        order = np.argsort(left.astype(np.int16) if left.max(initial=0) < 1 << 15 else left, kind="stable")  # radix sort if short
        number = np.empty(len(chars), dtype=np.int64)
        number[order] = np.arange(len(chars))
        at = np.arange(len(chars))
        name = np.zeros(len(chars), dtype=np.uint64)
        froms, tos, ids, single = [], [], [], np.zeros(len(chars), dtype=bool)
        alive = at
        for k in range(v.longest):
            alive = alive[left[alive] > k]
            if not len(alive):
                break
            grown = _extend(name[alive], chars[alive + k])
            place = _find(v, grown)
            hit = place >= 0
            alive, place = alive[hit], place[hit]
            name[alive] = grown[hit]
            piece = v.ids[place]
            whole = piece >= 0
            if k == 0:
                single[alive[whole]] = True
            froms.append(alive[whole])
            tos.append(alive[whole] + k + 1)
            ids.append(piece[whole])
        rest = at[~single]
        froms.append(rest)
        tos.append(rest + 1)
        ids.append(-1 - chars[rest].astype(np.int64))
        start, to, piece = np.concatenate(froms), np.concatenate(tos), np.concatenate(ids)
        width = np.ones(len(piece), dtype=np.int64)  # ids of an edge
        wide = piece < 0
        point = -1 - piece[wide]
        width[wide] = 1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF)
        score = np.where(wide, width * v.byte_score, v.scores[np.maximum(piece, 0)])
        done = left[start] == to - start
        node = number[start]
        by = np.argsort((node << 20) + np.where(wide, 0, piece))  # a node's likely pieces, which have low ids, first
        piece, width, node, score, done, target = piece[by], width[by], node[by], score[by], done[by], to[by]
        to = np.where(done, -1, number[np.minimum(target, len(number) - 1)])
        first = np.searchsorted(node, np.arange(len(chars) + 1))
        beta = np.zeros(len(chars) + 1)  # the last is for ends
        total = np.empty(len(node))
        cuts = np.searchsorted(left[order], np.arange(1, int(left.max(initial=0)) + 2))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):  # nodes with the same number of characters left
            if a == b:
                continue
            e, f = first[a], first[b]
            total[e:f] = score[e:f] + beta[to[e:f]]
            top = np.maximum.reduceat(total[e:f], first[a:b] - e)
            of = node[e:f] - a
            beta[a:b] = top + np.log(np.add.reduceat(np.exp(total[e:f] - top[of]), first[a:b] - e))
        log_p = np.minimum(total - beta[node], 0.0)
        upto = np.exp(log_p)  # of a node's chances, those before an edge and its own; summed within each node alone
        edge, last = first[:-1] + 1, first[1:]
        while len(more := np.flatnonzero(edge < last)):
            edge, last = edge[more], last[more]
            upto[edge] += upto[edge - 1]
            edge = edge + 1
        upto[first[1:] - 1] = 2.0
        only = (first[1:] - first[:-1] == 1)[node]  # edges without a choice
        nodes, edges = self.grown["first"].n - 1, self.grown["piece"].n
        values = (piece, width, node + nodes, np.where(done, -1, to + nodes), log_p, upto, only)
        for name_, value in zip(self.EDGES, values, strict=True):
            self.grown[name_].add(value)
        self.grown["first"].add(first[1:] + edges)
        self.grown["starts"].add(number[ends - sizes] + nodes)


def uniform(seed: np.ndarray, sample: int, place: np.ndarray, step: int) -> np.ndarray:
    x = seed + place.astype(np.uint64) * _B + np.uint64((sample * int(_A) + step * int(_C)) % 2**64)
    return (mix(x) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def exponential(seed: np.ndarray, sample: int, place: np.ndarray, step: int) -> np.ndarray:
    return -np.log1p(-uniform(seed, sample, place, step))


def walk(lattice: Lattice, nodes: np.ndarray, seed: np.ndarray, place: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to its unit's end, one after another, and how many there are for each (-1 nodes: none)."""
    counts = np.zeros(len(nodes), dtype=np.int64)
    taken: list[tuple[np.ndarray, np.ndarray]] = []
    alive = np.flatnonzero(nodes >= 0)
    node = nodes[alive]
    step = 0
    while len(alive):
        draw = uniform(seed[alive], sample, place[alive], step)
        edge = lattice.first[node]
        above = np.flatnonzero(draw >= lattice.upto[edge])
        while len(above):
            edge[above] += 1
            above = above[draw[above] >= lattice.upto[edge[above]]]
        taken.append((alive, edge))
        counts[alive] += 1
        node = lattice.to[edge]
        go = node >= 0
        alive, node = alive[go], node[go]
        step += 1
    begins = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), dtype=np.int64)
    for k, (rows, edge) in enumerate(taken):
        out[begins[rows] + k] = edge
    return out, counts


class Paths:
    """One path for each of some texts: edges, their units' places, and the arrivals of what their first steps left."""

    def __init__(self, lattice: Lattice, texts: np.ndarray, edges: np.ndarray, units: np.ndarray, sizes: np.ndarray, time: np.ndarray, since: np.ndarray, seeds: np.ndarray, sample: int):
        """Steps from ``since`` on leave nodes of their own.

        A step with a beginning less likely than exp(-FADED) can't be next, as no noise of 53 bits makes up for that; so
        only as many columns of steps are looked at as bring all paths there.
        """
        self.texts, self.edges, self.units, self.sizes, self.time = texts, edges, units, sizes, time
        self.begins = np.cumsum(sizes) - sizes
        steps = lattice.log_p[edges]
        self.log_p = np.add.reduceat(np.append(steps, 0.0), self.begins) if len(sizes) else np.zeros(0)
        self.log_p[sizes == 0] = 0.0
        width, longest = 256, int(sizes.max(initial=0))
        while True:
            width = min(width, longest)
            column = np.arange(width)
            inside = column < sizes[:, None]
            at = np.where(inside, self.begins[:, None] + column, 0)
            own = np.where(inside, steps[at], 0.0) if len(steps) else np.zeros((len(sizes), width))
            upto = np.cumsum(own, axis=1)
            before = upto - own
            near = inside & (before >= -FADED)
            if width == longest or not (near[:, -1] if width else inside.any(axis=1)).any():
                break
            width *= 2
        self.before = before
        self.rest = np.full(before.shape, np.inf)
        row, step = np.nonzero(near & (column >= since[:, None]) & ~lattice.only[edges[at]] if len(steps) else near)
        with np.errstate(divide="ignore", over="ignore"):
            mass = before[row, step] + np.log(-np.expm1(np.minimum(own[row, step], 0)))
            late = time[row] + np.exp(np.log(exponential(seeds[row], sample, step, 99)) - mass)
        self.rest[row, step] = np.where(np.isnan(late), np.inf, late)
        self.gone: dict[tuple[int, int], list[int]] = {}  # edges that have left a step's node, besides the path's own


def top_k(lattice: Lattice, texts: list[np.ndarray], seeds: np.ndarray, k: int) -> tuple[list[Paths], np.ndarray]:
    """For texts, given as the numbers of their units: each sample's paths, largest values first, and the arrival after
    the last. Texts without units or with fewer segmentations are left out of the later samples."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    of = np.repeat(np.arange(len(texts)), sizes)
    units = np.concatenate(texts) if len(texts) else np.zeros(0, dtype=np.int64)
    unit_from = np.cumsum(sizes) - sizes
    place = np.arange(len(units)) - np.repeat(unit_from, sizes)
    edges, counts = walk(lattice, lattice.starts[units], seeds[of], place, 0)
    everyone = np.arange(len(texts))
    lengths = np.bincount(of, weights=counts, minlength=len(texts)).astype(np.int64)
    first = exponential(seeds, 0, np.zeros(len(seeds), dtype=np.int64), 98)
    found = [Paths(lattice, everyone, edges, np.repeat(place, counts), lengths, first, np.zeros(len(texts), dtype=np.int64), seeds, 0)]
    after = np.full(len(texts), np.inf)
    able = lengths > 0
    for sample in range(1, k + 1):
        # The earliest arrival of each text, among what all its paths' steps left.
        best, which, row_of, step_of = np.full(len(texts), np.inf), np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
        for j, paths in enumerate(found):
            if not paths.rest.shape[1] or not len(paths.texts):
                continue
            step = paths.rest.argmin(axis=1)
            least = paths.rest[np.arange(len(step)), step]
            better = np.flatnonzero(least < best[paths.texts])
            text = paths.texts[better]
            best[text], which[text], row_of[text], step_of[text] = least[better], j, better, step[better]
        after[able] = best[able]
        able = able & np.isfinite(best)
        heads = np.flatnonzero(able)
        if sample == k or not len(heads):
            break
        draws, noises = uniform(seeds[heads], sample, step_of[heads], 97), exponential(seeds[heads], sample, step_of[heads], 96)
        picks = np.empty(len(heads), dtype=np.int64)
        for n, (text, j, row, at) in enumerate(zip(heads.tolist(), which[heads].tolist(), row_of[heads].tolist(), step_of[heads].tolist(), strict=True)):
            paths = found[j]
            own = int(paths.edges[paths.begins[row] + at])
            node = lattice.node[own]
            gone = paths.gone.setdefault((row, at), [own])
            left = [e for e in range(lattice.first[node], lattice.first[node + 1]) if e not in gone]
            chance = np.exp(lattice.log_p[left])
            total = float(chance.sum())
            pick = left[min(int(np.searchsorted(np.cumsum(chance), draws[n] * total, side="right")), len(left) - 1)]
            gone.append(pick)
            rest = total - math.exp(lattice.log_p[pick])
            if len(left) > 1 and rest > 0:
                wait = math.log(noises[n] + 1e-300) - float(paths.before[row, at]) - math.log(rest)
                paths.rest[row, at] = best[text] + math.exp(min(700.0, wait))
            else:
                paths.rest[row, at] = np.inf
            picks[n] = pick
        # The other units of all these texts are drawn together.
        unit, begin, head_edges, head_units = np.empty(len(heads), dtype=np.int64), np.empty(len(heads), dtype=np.int64), [], []
        for j, paths in enumerate(found):
            own = np.flatnonzero(which[heads] == j)
            begin[own] = paths.begins[row_of[heads[own]]]
            unit[own] = paths.units[begin[own] + step_of[heads[own]]]
        tails = sizes[heads] - unit  # the unit of the step and those after it
        spot = np.arange(int(tails.sum())) - np.repeat(np.cumsum(tails) - tails - unit, tails)
        of_head = np.repeat(np.arange(len(heads)), tails)
        nodes = lattice.starts[units[unit_from[heads][of_head] + spot]]
        nodes[np.cumsum(tails) - tails] = lattice.to[picks]
        more, counts = walk(lattice, nodes, seeds[heads][of_head], spot, sample)
        drawn = np.bincount(of_head, weights=counts, minlength=len(heads)).astype(np.int64)
        drawn_units, drawn_from = np.repeat(spot, counts), np.cumsum(drawn) - drawn
        since = step_of[heads]
        for n, (j, a, at, b, m) in enumerate(zip(which[heads].tolist(), begin.tolist(), since.tolist(), drawn_from.tolist(), drawn.tolist(), strict=True)):
            head_edges += [found[j].edges[a : a + at], picks[n : n + 1], more[b : b + m]]
            head_units += [found[j].units[a : a + at + 1], drawn_units[b : b + m]]
        found.append(Paths(lattice, heads, np.concatenate(head_edges), np.concatenate(head_units), since + 1 + drawn, best[heads], since + 1, seeds[heads], sample))
    return found, after


def ids_of(v: Vocabulary, lattice: Lattice, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of a row of edges, and each edge's number of ids; characters without a piece become bytes."""
    piece, width = lattice.piece[edges], lattice.width[edges]
    out = np.repeat(piece, width)
    wide = np.flatnonzero(out < 0)
    if len(wide):
        begin = np.repeat(np.cumsum(width) - width, width)[wide]
        size = np.repeat(width, width)[wide]
        char, k = -1 - out[wide], wide - begin
        point = np.where(char == ord(LITERAL), ord(SPACE), char)
        low = point >> (6 * (size - 1 - k))
        mark = np.where(k > 0, 0x80, np.choose(size - 1, [0, 0xC0, 0xE0, 0xF0]))
        out[wide] = v.byte_ids[np.where(k > 0, low & 0x3F, low) | mark]
    return out.astype(np.int32), width


def decoded_bytes(v: Vocabulary, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that a row of piece ids stands for, and each id's number of them."""
    sizes = v.byte_sizes[ids]
    ends = np.cumsum(sizes)
    at = np.arange(int(sizes.sum()), dtype=np.int32)
    at += np.repeat((v.byte_from[ids] - (ends - sizes)).astype(np.int32), sizes)
    return v.byte_table[at], sizes


def round_trips(v: Vocabulary, ids: np.ndarray, sizes: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Whether each run of ids (so many of them) decodes to its text; the first byte is the space that begins a text."""
    got, width = decoded_bytes(v, ids)
    ends = np.cumsum(np.concatenate(([0], width)))[np.cumsum(sizes)] if len(sizes) else np.zeros(0, dtype=np.int64)
    begins = np.concatenate(([0], ends[:-1]))
    wanted = [b" " + t if t else b"" for t in texts]
    lengths = np.fromiter(map(len, wanted), dtype=np.int64, count=len(wanted))
    same = ends - begins == lengths
    if same.all():
        differ = np.flatnonzero(got != np.frombuffer(b"".join(wanted), dtype=np.uint8))
        same[np.searchsorted(ends, differ, side="right")] = False
        return same
    raw = got.tobytes()
    return np.array([raw[a:b] == w for a, b, w in zip(begins.tolist(), ends.tolist(), wanted, strict=True)])


class _Numbers(dict):
    """Numbers new units as they come, after those of ``base``."""

    def __init__(self, base: dict[str, int] | None = None):
        self.base, self.fresh, self.n = base or {}, [], len(base or ())

    def __missing__(self, unit: str) -> int:
        number = self.base.get(unit)
        if number is None:
            number = self.n
            self.n += 1
            self.fresh.append(unit)
        self[unit] = number
        return number


def _units(v: Vocabulary, text: str) -> list[str]:
    return v.split.findall(SPACE + text.replace(SPACE, LITERAL).replace(" ", SPACE)) if text else []


def encode_top_k(
    df: DataFrame, key: str, text: str, k: int = SAMPLES, path: str = MODEL, theta: float = THETA, seed: int = SEED, keep: tuple[str, ...] = ()
) -> DataFrame:
    """key, text, kept columns, samples and round_trip.

    A sample is (ids, log_p, perturbed, log_inclusion), the largest value first; round_trip says whether all samples
    decode to the text (they always do; it is checked, not assumed).
    """
    v = load(path, theta)
    item = pa.struct([("ids", pa.list_(pa.int32())), ("log_p", pa.float64()), ("perturbed", pa.float64()), ("log_inclusion", pa.float64())])

    def samples(lattice: Lattice, texts: list[str | None], seeds: np.ndarray) -> tuple[pa.Array, pa.Array]:
        rows = lattice.numbered([_units(v, t or "") for t in texts])
        found, after = top_k(lattice, rows, seeds, k)
        raw = encoded(texts)
        parts, sizes, whole, good = [], [], np.ones(len(texts), dtype=bool), np.array([t is not None for t in texts], dtype=bool)
        for paths in found:
            ids, width = ids_of(v, lattice, paths.edges)
            sizes.append(np.diff(np.concatenate(([0], np.cumsum(width)))[np.append(paths.begins, len(paths.edges))]))
            parts.append(ids)
            whole[paths.texts] &= round_trips(v, ids, sizes[-1], [raw[i] for i in paths.texts.tolist()])
        # Samples of one text follow each other: sorted by text, in the order they were drawn.
        text = np.concatenate([p.texts for p in found])
        by = np.argsort(text, kind="stable")
        by = by[good[text[by]]]
        size, flat = np.concatenate(sizes), np.concatenate(parts)
        begin = np.cumsum(size) - size
        at = np.repeat(begin[by] - (np.cumsum(size[by]) - size[by]), size[by]) + np.arange(int(size[by].sum()))
        ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size[by]))), pa.int32()), pa.array(flat[at]))
        log_p, time = np.concatenate([p.log_p for p in found])[by], np.concatenate([p.time for p in found])[by]
        with np.errstate(divide="ignore", over="ignore"):
            rate = log_p + np.log(after[text[by]])
            included = np.where(rate > 3.7, 0.0, np.where(rate < -37, rate, np.log(-np.expm1(-np.exp(np.clip(rate, -40, 4))))))
        values = [pa.array(x, pa.float64()) for x in (log_p, -np.log(np.maximum(time, 1e-300)), included)]
        counts = np.bincount(text[by], minlength=len(texts))
        offsets = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32(), mask=np.append(~good, False))
        lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([ids, *values], fields=list(item)))
        return lists, pa.array(whole, pa.bool_())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(v)
        for batch in batches:
            for part in slices(batch, 1, CHARS):
                texts, seeds = part.column(1).to_pylist(), part.column(2).to_numpy().view(np.uint64)
                lists, same = samples(lattice, texts, seeds)
                lattice.trim(KEPT_EDGES)
                kept = [part.column(i) for i in (0, 1, *range(3, part.num_columns))]
                yield pa.RecordBatch.from_arrays([*kept, lists, same], names=[key, "text", *keep, "samples", "round_trip"])

    bounded_batches(df)
    rows = df.select(F.col(key), F.col(text).alias("text"), F.xxhash64(F.lit(seed), F.col(key)).alias("_seed"), *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_seed")
    return rows.mapInArrow(encode, schema + ", samples array<struct<ids: array<int>, log_p: double, perturbed: double, log_inclusion: double>>, round_trip boolean")


def decode_ids(v: Vocabulary, ids: np.ndarray) -> str:
    """The text of piece ids: runs of bytes are read as UTF-8, the mark of a space becomes one, but for the first."""
    if not v.part[ids].any():
        return "".join(map(v.shown.__getitem__, ids.tolist()))[1:]
    out, raw = [], bytearray()
    for i, part in zip(ids.tolist(), v.part[ids].tolist(), strict=True):
        if part:
            raw.append(int(v.pieces[i], 16))
            continue
        if raw:
            out.append(raw.decode("utf-8", "surrogatepass"))
            raw.clear()
        out.append(v.shown[i])
    out.append(raw.decode("utf-8", "surrogatepass"))
    return "".join(out)[1:]


def decode_samples(df: DataFrame, keep: list[str], samples: str = "samples", path: str = MODEL) -> DataFrame:
    """The kept columns and ``texts``, the text of each sample."""
    v = load(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(keep))
            for a in range(0, batch.num_rows, 256):
                some = column[a : a + 256]
                texts = [None if not row.is_valid else [decode_ids(v, item["ids"].values.to_numpy()) for item in row] for row in some]
                yield pa.RecordBatch.from_arrays([*(batch.column(i)[a : a + 256] for i in range(len(keep) + 1)), pa.array(texts, pa.list_(pa.string()))], names=[*keep, "samples", "texts"])

    rows = df.select(*keep, F.col(samples).alias("samples"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(decode, f"{schema}, texts array<string>")


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode_top_k(table(spark, sf_dir, "documents"), "doc_id", "text")
    rows = encoded.select("doc_id", "round_trip", F.posexplode_outer("samples").alias("sample", "s"))
    return rows.select(
        "doc_id",
        "sample",
        F.when(F.col("s").isNotNull(), F.size("s.ids").cast("long")).alias("n_pieces"),
        F.when(F.col("s").isNotNull(), F.xxhash64("s.ids")).alias("ids_hash"),
        F.round("s.log_p", 6).alias("log_p"),
        F.round("s.perturbed", 9).alias("perturbed"),
        F.round("s.log_inclusion", 6).alias("log_inclusion"),
        "round_trip",
    )
