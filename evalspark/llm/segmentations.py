"""Sampled SentencePiece encodings without replacement, and decoding.

The pieces that can spell a text form a lattice. A piece weighs by its rank in the vocabulary (Zipf's law); the weight of a
segmentation is the product over its pieces. The total weight of all segmentations of each prefix is found by a
forward pass, so at every place of the lattice the probabilities of the pieces that end there are
known, and the best perturbed value below a partial path is bounded exactly by that of the path itself.

Segmentations with Gumbel noise on their log probability are searched best first (A*): a path walks from the
end of the text to its start and keeps its value; at each step the pieces not taken
are one open set, with the largest value in it drawn from a Gumbel distribution cut off at the path's. The best open set
is split next. The first ``samples`` values are a sample without replacement; the value after them
gives each its inclusion probability. No piece spans the start of a word, so the lattice holds distinct words, those of
earlier texts too until it is full, and all words of a batch of texts walk at the same time.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame

from evalspark.llm.common import handing_back, mix64, output_schema, replaced, slices, strings

SPACE = "▁"
# the paths of a slice take some hundred bytes a byte of text
SLICE_TEXT = 1 << 19
# words up to this length are laid out together as a table of characters, longer ones each by its places
LONG_WORD = 48
# the lattice serves the next slices until it holds this many edges
KEPT_EDGES = 1 << 19
EDGE_KINDS = {"states": np.int32, "previous": np.int32, "sums": float, "rows": np.int32, "log": float, "log_rest": float}
FILTER_BITS = 22
# log weight of a character spelled in bytes; nothing competes with it
SPELLED_WEIGHT = -20.0
_ODD = np.uint64(0x9E3779B97F4A7C15)
_WORD = (1 << 64) - 1


class _Vocabulary:
    """Pieces by the hash of their characters, with log weight and id; bytes for other characters."""

    def __init__(self, processor, sharpness: float):
        self.size = processor.get_piece_size()
        ids: dict[str, int] = {}
        self.byte_ids = [processor.unk_id()] * 256
        for i in range(self.size):
            piece = processor.id_to_piece(i)
            if processor.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
            elif not (processor.is_control(i) or processor.is_unknown(i) or processor.is_unused(i)):
                ids[piece] = i
        total = math.log(sum(1.0 / r for r in range(1, len(ids) + 1)))
        ranked = sorted(ids, key=ids.__getitem__)
        self.pieces = {
            p: (-sharpness * (math.log(rank + 1) + total), ids[p]) for rank, p in enumerate(ranked)
        }
        self.longest = max(map(len, ids))
        self.powers = np.ones(self.longest, dtype=np.uint64)
        self.powers[1:] = np.cumprod(np.full(self.longest - 1, _ODD, dtype=np.uint64))
        hashes = np.array([self._hash(p) for p in ranked], dtype=np.uint64)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two pieces have the same hash")
        self.lengths = np.array([len(p) for p in ranked])[order]
        self.weights = np.array([self.pieces[p][0] for p in ranked])[order]
        self.ids = np.array([ids[p] for p in ranked], dtype=np.int64)[order]
        self.filter = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.filter[self._slots(self.hashes)] = True

    def _hash(self, piece: str) -> int:
        return sum((ord(c) + 1) * int(w) for c, w in zip(reversed(piece), self.powers)) & (1 << 64) - 1

    @staticmethod
    def _slots(hashes: np.ndarray) -> np.ndarray:
        return (hashes * _ODD >> np.uint64(64 - FILTER_BITS)).astype(np.int64)

    def found(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the hashes of pieces of a length, and the number of each piece."""
        at = np.flatnonzero(self.filter[self._slots(hashes)])
        number = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        same = (self.hashes[number] == hashes[at]) & (self.lengths[number] == size)
        return at[same], number[same]


class Lattice:
    """The lattices of words, by prefix: a state is a prefix, its edges are the pieces it can end in.

    Edges of a state stand together, each with its state, the state before the piece, its probability, the sum of
    probabilities so far, and its row of output ids. State 0 is the empty prefix. Words may be added
    later; those of up to ``LONG_WORD`` characters that are added together share the states of their prefixes.
    """

    def __init__(self, vocabulary: _Vocabulary):
        self.vocabulary = vocabulary
        # of each state, with room for more
        self.total = np.zeros(1 << 10)
        self.states = 1
        self.edges: list[tuple[np.ndarray, ...]] = []
        self.first: list[np.ndarray] = [np.zeros(1, dtype=np.int64)]
        self.count = 0
        # a piece's output is its id; spelled characters follow
        self.spelled: dict[int, int] = {}
        # the last state of each word
        self.final: dict[str, int] = {}
        self.net = {name: np.zeros(0, kind) for name, kind in EDGE_KINDS.items()}
        self._arrays()

    def add(self, words: list[str]) -> None:
        """Adds distinct words that the lattice doesn't hold."""
        short = sorted(w for w in words if len(w) <= LONG_WORD)
        if short:
            self.final.update(zip(short, self._grow(short).tolist()))
        for word in words:
            if len(word) > LONG_WORD:
                self.final[word] = self._grow_long(word)
        self._arrays()

    def _grow(self, words: list[str]) -> np.ndarray:
        """Adds the states of sorted words, all prefixes of a length at a time; returns the last of each."""
        v = self.vocabulary
        sizes = np.array([len(w) for w in words])
        width = int(sizes.max())
        table = np.array(words, dtype=f"U{width}").view(np.uint32).reshape(len(words), width)
        # by place, so that those of a place stand together
        characters = table.T.astype(np.uint64, order="C")
        characters += np.uint64(1)
        # a prefix that the word before has as well isn't new
        differs = table[1:] != table[:-1]
        same = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
        shared = np.concatenate([[0], np.minimum(same, np.minimum(sizes[1:], sizes[:-1]))])
        states = np.zeros((width + 1, len(words)), dtype=np.int64)
        for end in range(1, width + 1):
            rows = np.flatnonzero((shared < end) & (sizes >= end))
            base = self.states
            self._add(characters, states, rows, end)
            new = np.zeros(len(words), dtype=np.int64)
            new[rows] = np.arange(base, base + len(rows))
            np.maximum.accumulate(new, out=states[end])
        return states[sizes, np.arange(len(words))]

    def _add(self, characters: np.ndarray, states: np.ndarray, rows: np.ndarray, end: int) -> None:
        """The states of the prefixes of length ``end`` of these rows."""
        if not len(rows):
            return
        v = self.vocabulary
        owners, befores, scores, outputs = [], [], [], []
        hashes = np.zeros(len(rows), dtype=np.uint64)
        for size in range(1, min(end, v.longest) + 1):
            hashes += characters[end - size][rows] * v.powers[size - 1]
            at, number = v.found(hashes, size)
            before = states[end - size][rows[at]]
            owners.append(at)
            befores.append(before)
            scores.append(self.total[before] + v.weights[number])
            outputs.append(v.ids[number])
            if size == 1 and len(at) < len(rows):
                # a character without a piece is spelled in bytes
                alone = np.ones(len(rows), dtype=bool)
                alone[at] = False
                at = np.flatnonzero(alone)
                before = states[end - 1][rows[at]]
                owners.append(at)
                befores.append(before)
                scores.append(self.total[before] + SPELLED_WEIGHT)
                outputs.append(self._spelled(characters[end - 1][rows[at]]))
        owner, before, score, output = map(np.concatenate, (owners, befores, scores, outputs))
        order = np.argsort(owner, kind="stable")
        self._append(owner[order], before[order], score[order], output[order])

    def _grow_long(self, word: str) -> int:
        """Adds the states of a long word and returns its last: pieces are found at all places together.

        Time and memory grow with the length; only the sums of the prefixes are made one by one.
        """
        v = self.vocabulary
        codes = np.array([word], dtype=f"U{len(word)}").view(np.uint32).astype(np.uint64) + np.uint64(1)
        length = len(codes)
        hashes = np.zeros(length, dtype=np.uint64)
        owners, befores, weights, outputs = [], [], [], []
        for size in range(1, min(length, v.longest) + 1):
            hashes[size - 1 :] += codes[: length - size + 1] * v.powers[size - 1]
            at, number = v.found(hashes[size - 1 :], size)
            owners.append(at + size - 1)
            befores.append(at)
            weights.append(v.weights[number])
            outputs.append(v.ids[number])
            if size == 1 and len(at) < length:
                alone = np.ones(length, dtype=bool)
                alone[at] = False
                at = np.flatnonzero(alone)
                owners.append(at)
                befores.append(at)
                weights.append(np.full(len(at), SPELLED_WEIGHT))
                outputs.append(self._spelled(codes[at]))
        owner, before, weight, output = map(np.concatenate, (owners, befores, weights, outputs))
        order = np.argsort(owner, kind="stable")
        owner, before, weight, output = owner[order], before[order], weight[order], output[order]
        bounds = np.searchsorted(owner, np.arange(length + 1)).tolist()
        places, own = before.tolist(), weight.tolist()
        totals = [0.0]
        for low, high in zip(bounds, bounds[1:]):
            ways = [totals[places[i]] + own[i] for i in range(low, high)]
            most = max(ways)
            totals.append(most + math.log(sum([math.exp(x - most) for x in ways])))
        base = self.states
        score = np.array(totals)[before] + weight
        self._append(owner, np.where(before > 0, base + before - 1, 0), score, output)
        return base + length - 1

    def _spelled(self, characters: np.ndarray) -> np.ndarray:
        """Output rows of characters without a piece."""
        v = self.vocabulary
        codes = (characters - np.uint64(1)).tolist()
        return np.array(
            [self.spelled.setdefault(c, v.size + len(self.spelled)) for c in codes], dtype=np.int64
        )

    def _append(self, owner: np.ndarray, before: np.ndarray, score: np.ndarray, output: np.ndarray) -> None:
        """Adds states and their edges, which stand in order of ``owner``, the number of the new state."""
        starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        most = np.maximum.reduceat(score, starts)
        share = np.exp(score - most[owner])
        whole = np.add.reduceat(share, starts)
        chance = share / whole[owner]
        run = np.cumsum(chance)
        run -= (run - chance)[starts][owner]
        # the last edge takes whatever number is drawn
        run[np.append(starts[1:], len(run)) - 1] = 2.0
        base = self.states
        self.first.append(self.count + starts)
        self.count += len(owner)
        self.edges.append((base + owner, before, chance, run, output))
        self.states += len(starts)
        if self.states > len(self.total):
            self.total = np.concatenate([self.total[:base], np.zeros(2 * self.states - base)])
        self.total[base : self.states] = most + np.log(whole)

    def _arrays(self) -> None:
        """Lays the edges added since the last time out after the others."""
        net, v = self.net, self.vocabulary
        if self.edges:
            states, previous, chance, sums, rows = map(np.concatenate, zip(*self.edges))
            some = np.minimum(chance, 1 - 1e-16)
            with np.errstate(divide="ignore"):
                rest = np.where(chance < 1 - 1e-12, np.log1p(-some), -np.inf)
            new = {"states": states, "previous": previous, "sums": sums, "rows": rows, "log": np.log(chance), "log_rest": rest}
            self.edges = []
            net |= {name: np.append(net[name], new[name].astype(kind)) for name, kind in EDGE_KINDS.items()}
        self.first = [np.concatenate(self.first)]
        net["first"] = self.first[0]
        bytes_ = [[v.byte_ids[b] for b in chr(c).encode()] for c in self.spelled]
        sizes = np.append(np.ones(v.size, np.int64), np.array([len(o) for o in bytes_], np.int64))
        net["output_start"] = np.cumsum(sizes) - sizes
        net["output_size"] = sizes
        spelled = np.array([i for o in bytes_ for i in o], dtype=np.int32)
        net["output_ids"] = np.append(np.arange(v.size, dtype=np.int32), spelled)


def _uniform(key: np.ndarray, *counters) -> np.ndarray:
    """Numbers in (0, 1) from keys and counters."""
    x = key
    for c in counters:
        x = mix64(x ^ (np.atleast_1d(np.asarray(c, dtype=np.uint64)) + np.uint64(1)) * _ODD)
    return ((x >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)


def _uniform_of(key: int, *counters: int) -> float:
    """As ``_uniform``, for one key."""
    x = int(key)
    for c in counters:
        x ^= (c + 1) * int(_ODD) & _WORD
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _WORD
        x = (x ^ x >> 27) * 0x94D049BB133111EB & _WORD
        x ^= x >> 31
    return (float(x >> 11) + 0.5) / float(1 << 53)


def _below(loc: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel values with these locations, cut off at ``bound``."""
    return loc - np.log(np.exp(np.minimum(loc - bound, 700.0)) - np.log(u))


@dataclass
class _Path:
    """A segmentation found: edges from the end of the text, the word of each, and its value."""

    edges: np.ndarray
    words: np.ndarray
    before: np.ndarray
    value: float
    log_prob: float


def _walk(net: dict, keys: np.ndarray, round_: int, starts: list[tuple[np.ndarray, np.ndarray]]):
    """Walks all words of all documents from their states to the start of the word.

    ``starts`` has the words and states of each document, in the order of the path. Returns edge, word and
    number within the word of all steps, and the bounds of each document.
    """
    counts = np.array([len(w) for w, _ in starts], dtype=np.int64)
    words = np.concatenate([w for w, _ in starts]) if len(starts) else np.zeros(0, np.int64)
    state = np.concatenate([s for _, s in starts]) if len(starts) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(starts)), counts)
    key = _uniform_key(keys[owner], round_, words)
    item = np.flatnonzero(state > 0)
    current = state[item]
    steps = np.zeros(len(words), dtype=np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    turn = 0
    while len(item):
        u = _uniform(key[item], turn)
        edge = net["first"][current]
        late = np.flatnonzero(u > net["sums"][edge])
        while len(late):
            edge[late] += 1
            late = late[u[late] > net["sums"][edge[late]]]
        found.append((item, edge))
        steps[item] += 1
        current = net["previous"][edge]
        on = current > 0
        item, current = item[on], current[on]
        turn += 1
    ends = np.cumsum(steps)
    place = ends - steps
    edges = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.int64)
    for turn, (item, edge) in enumerate(found):
        edges[place[item] + turn] = edge
    bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
    turns = np.arange(len(edges)) - np.repeat(place, steps)
    return edges, np.repeat(words, steps), turns, bounds


def _uniform_key(keys: np.ndarray, round_: int, words: np.ndarray) -> np.ndarray:
    return mix64(keys ^ mix64(words.astype(np.uint64) * _ODD + np.uint64(round_)))


class Sampler:
    """Samples segmentations of texts with a SentencePiece model."""

    def __init__(self, path: str, samples: int, sharpness: float = 1.0):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        self.vocabulary = _Vocabulary(self.processor, sharpness)
        self.lattice = Lattice(self.vocabulary)
        self.samples = samples
        # where no piece spans a line end, it is a word of its own
        self.spanning = any("\n" in p for p in self.vocabulary.pieces)

    def _words(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The distinct words of texts, the number of each word of the texts in order, and the bounds of each text."""
        raw = [self.processor.normalize(text).encode() for text in texts]
        ends = np.cumsum([0, *map(len, raw)])
        joined = b"".join(raw)
        data = np.frombuffer(joined, dtype=np.uint8)
        blanks = np.flatnonzero(data == 0xE2)
        blanks = blanks[(data[blanks + 1] == 0x96) & (data[blanks + 2] == 0x81)]
        begins = np.zeros(len(data) + 1, dtype=bool)
        # blanks begin a word together
        begins[blanks[np.diff(blanks, prepend=-3) != 3]] = True
        begins[ends] = True
        if not self.spanning:
            lines = np.flatnonzero(data == 0x0A)
            begins[lines] = begins[lines + 1] = True
        # the end of the last text begins nothing, and bounds its last word
        offsets = np.flatnonzero(begins)
        buffers = [None, pa.py_buffer(offsets), pa.py_buffer(joined)]
        found = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, buffers).dictionary_encode()
        return found.dictionary.to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy(), np.searchsorted(offsets, ends)

    def sample(self, texts: list[str], keys: np.ndarray) -> list[list[_Path]]:
        """The paths of each text, best value first."""
        words, numbers, bounds = self._words(texts)
        if self.lattice.count > KEPT_EDGES:
            self.lattice = Lattice(self.vocabulary)
        net, final = self.lattice.net, self.lattice.final
        self.lattice.add([w for w in words if w not in final])
        states = np.fromiter(map(final.__getitem__, words), np.int64, len(words))[numbers]
        documents = [states[a:b] for a, b in zip(bounds, bounds[1:])]
        count = len(texts)
        paths: list[list[_Path]] = [[] for _ in range(count)]
        open_: list[list[tuple]] = [[] for _ in range(count)]
        values = -np.log(-np.log(_uniform(keys, 0)))
        # what the next path of a document begins with: edges, words and log probability
        none = np.zeros(0, dtype=np.int64)
        heads = [(none, none, np.zeros(0), 0.0, float(v)) for v in values]
        starts = [(np.arange(len(d))[::-1], d[::-1]) for d in documents]
        active = list(range(count))
        for round_ in range(self.samples):
            edges, words, turns, bounds = _walk(net, keys[active], round_, starts)
            logs = net["log"][edges]
            owners = np.repeat(keys[active], np.diff(bounds))
            u = _uniform(_uniform_key(owners, round_, words), turns, 7)
            nexts = []
            for place, doc in enumerate(active):
                low, high = int(bounds[place]), int(bounds[place + 1])
                head_edges, head_words, head_before, head_log, value = heads[place]
                run = head_log + np.cumsum(logs[low:high])
                own = run - logs[low:high]
                log_prob = float(run[-1]) if high > low else head_log
                path = _Path(
                    np.concatenate([head_edges, edges[low:high]]),
                    np.concatenate([head_words, words[low:high]]),
                    np.concatenate([head_before, own]),
                    value,
                    log_prob,
                )
                number = len(paths[doc])
                paths[doc].append(path)
                rest = own + net["log_rest"][edges[low:high]]
                drawn = _below(rest, value, u[low:high])
                wanted = self.samples - round_
                best = np.argpartition(-drawn, wanted)[:wanted] if len(drawn) > wanted else np.arange(len(drawn))
                for at in best.tolist():
                    if rest[at] > -np.inf:
                        step = len(head_edges) + at
                        heapq.heappush(open_[doc], (-float(drawn[at]), number, step, (int(path.edges[step]),)))
                if round_ + 1 < self.samples and open_[doc]:
                    nexts.append(doc)
            active = nexts
            heads, starts = [], []
            for doc in active:
                head, start = self._split(net, doc, paths[doc], open_[doc], documents[doc], keys[doc], round_)
                heads.append(head)
                starts.append(start)
            if not active:
                break
        self.bound = [-o[0][0] if o else -math.inf for o in open_]
        return paths

    @staticmethod
    def _split(net, doc, paths, open_, states, key, round_):
        """Takes the best open set apart: the edge that has its value, and what is left of it."""
        negative, number, step, taken = heapq.heappop(open_)
        value, parent = -negative, paths[number]
        state = int(net["states"][taken[0]])
        low = int(net["first"][state])
        high = int(net["first"][state + 1]) if state + 1 < len(net["first"]) else len(net["states"])
        others = [e for e in range(low, high) if e not in taken]
        shares = np.exp(net["log"][others])
        draw = _uniform_of(key, round_, step, number, 11) * shares.sum()
        chosen = others[min(int(np.searchsorted(np.cumsum(shares), draw)), len(others) - 1)]
        before = float(parent.before[step])
        left = shares.sum() - math.exp(net["log"][chosen])
        if len(others) > 1 and left > 0:
            u = np.array([_uniform_of(key, round_, step, number, 13)])
            again = float(_below(np.array([before + math.log(left)]), np.array([value]), u)[0])
            heapq.heappush(open_, (-again, number, step, (*taken, chosen)))
        word = int(parent.words[step])
        head = (
            np.append(parent.edges[:step], chosen),
            np.append(parent.words[:step], word),
            np.append(parent.before[:step], before),
            before + float(net["log"][chosen]),
            value,
        )
        words = np.arange(word, -1, -1)
        onward = states[words].copy()
        onward[0] = net["previous"][chosen]
        return head, (words, onward)

    def ids(self, paths: list[_Path]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of paths of the last sample, one after the other, and the offset of each."""
        net = self.lattice.net
        rows = [net["rows"][p.edges[::-1]] for p in paths]
        flat = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)
        sizes = net["output_size"][flat]
        ends = np.cumsum(sizes)
        at = np.repeat(net["output_start"][flat] - (ends - sizes), sizes) + np.arange(sizes.sum())
        steps = np.cumsum([0, *map(len, rows)])
        return net["output_ids"][at], np.concatenate([[0], ends])[steps]


def log_inclusion(log_prob: float, bound: float) -> float:
    """Log of the probability that a segmentation is among those with a value above ``bound``."""
    if bound == -math.inf:
        return 0.0
    rate = log_prob - bound
    return rate if rate < -30 else math.log(-math.expm1(-math.exp(min(rate, 700.0))))


ADDED = {
    "sample": "int",
    "ids": "array<int>",
    "log_prob": "double",
    "perturbed": "double",
    "log_inclusion": "double",
}


def _encoded(path: str, samples: int, sharpness: float, seed: int, names: list[str]):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(path, samples, sharpness)
        for batch in batches:
            for part in slices(batch, "text", SLICE_TEXT):
                keys = np.array(
                    [xxhash.xxh3_64_intdigest(f"{seed}:{i}") for i in part.column("doc_id").to_pylist()],
                    dtype=np.uint64,
                )
                found = sampler.sample(strings(part, "text"), keys)
                paths = [p for ps in found for p in ps]
                ids, offsets = sampler.ids(paths)
                rows = pa.array(np.repeat(np.arange(len(found)), [len(ps) for ps in found]))
                columns = {n: part.column(n).take(rows) for n in names if n not in ADDED}
                columns |= {
                    "sample": pa.array([i for ps in found for i in range(len(ps))], pa.int32()),
                    "ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids)),
                    "log_prob": pa.array([p.log_prob for p in paths], pa.float64()),
                    "perturbed": pa.array([p.value for p in paths], pa.float64()),
                    "log_inclusion": pa.array(
                        [
                            log_inclusion(p.log_prob, bound)
                            for ps, bound in zip(found, sampler.bound)
                            for p in ps
                        ],
                        pa.float64(),
                    ),
                }
                order = [n for n in names if n in columns] + [n for n in ADDED if n not in names]
                yield pa.RecordBatch.from_arrays([columns[n] for n in order], names=order)

    return handing_back(encode)


def sample_encodings(
    docs: DataFrame, path: str, samples: int = 2, sharpness: float = 1.0, seed: int = 7
) -> DataFrame:
    """Rows of ``docs`` with each of their sampled segmentations, ``samples`` distinct ones at most.

    Adds, in place of columns of these names, ``sample`` (0 has the largest value), ``ids``, ``log_prob`` of the segmentation,
    its ``perturbed`` value and ``log_inclusion``, the log of its probability to be in the sample given the next value. A
    text with fewer segmentations has fewer rows, with inclusion probability 1; a null or empty text has the one without
    ids. Randomness comes from doc_id and ``seed`` alone: rows that repeat have the same samples. An empty table
    gives an empty table. ``path`` is a SentencePiece model present on every executor.
    """
    return docs.mapInArrow(
        _encoded(path, samples, sharpness, seed, docs.columns), output_schema(docs, ADDED)
    )


class Decoder:
    """Texts of token ids: pieces in a row, without the blank that normalisation puts first."""

    def __init__(self, path: str):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [
            b""
            if processor.is_control(i)
            else bytes([int(processor.id_to_piece(i)[3:5], 16)])
            if processor.is_byte(i)
            else processor.id_to_piece(i).replace(SPACE, " ").encode()
            for i in range(processor.get_piece_size())
        ]
        self.table = pa.array(self.pieces, pa.large_binary())

    def text(self, ids: list[int]) -> str:
        return self.texts(pa.array([ids], pa.list_(pa.int32())))[0].as_py()

    def texts(self, ids: pa.Array) -> pa.Array:
        """The texts of lists of ids; a null list is the empty text."""
        flat = ids.flatten()
        if flat.null_count:
            raise ValueError("an id is null")
        counts = np.asarray(pc.fill_null(pc.list_value_length(ids), 0), dtype=np.int64)
        pieces = self.table.take(flat)
        places = np.concatenate([[0], np.cumsum(counts)])
        bounds = np.frombuffer(pieces.buffers()[1], dtype=np.int64, count=len(pieces) + 1)[places]
        raw = np.frombuffer(pieces.buffers()[2] or b"", dtype=np.uint8, count=int(bounds[-1]))
        starts = bounds[:-1][bounds[:-1] < bounds[1:]]
        blanks = starts[raw[starts] == 0x20]
        bounds = bounds - np.searchsorted(blanks, bounds)
        buffers = [None, pa.py_buffer(bounds), pa.py_buffer(np.delete(raw, blanks))]
        joined = pa.Array.from_buffers(pa.large_binary(), len(ids), buffers)
        try:
            return joined.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([v.decode("utf-8", "replace") for v in joined.to_pylist()], pa.string())


def _decoded(path: str):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                yield replaced(part, {"decoded": decoder.texts(part.column("ids"))})

    return handing_back(decode)


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with ``decoded``, the text of its ``ids``; null ids are the empty text."""
    return encoded.mapInArrow(_decoded(path), output_schema(encoded, {"decoded": "string"}))
