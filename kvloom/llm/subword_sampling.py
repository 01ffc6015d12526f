"""SentencePiece encoding and decoding: distinct sampled segmentations, by Gumbel top-k.

A text's segmentations are the paths of a lattice of vocabulary pieces.  ``sample`` draws ``k`` of
them without replacement: a best-first (A-star) search over prefixes whose priority is the largest
perturbed log-probability (log-probability plus Gumbel noise) of any segmentation below.  The noise
is drawn from the top down: a prefix hands its own maximum to one continuation, chosen in
proportion to probability, and the rest get the maximum of what is left, truncated at it.  The
suffix mass of each lattice position, from a backward pass, makes every step exact.

The k+1-th maximum gives the inclusion score of each sample, ``1 - exp(-exp(log p - kappa))``: the
probability that it is among those drawn, given that threshold.  Noise is seeded by the row's key,
so a task that runs again draws the same.

Pieces have merge ranks, not probabilities; Zipf's law, ``-log(rank + RANK_OFFSET)``, stands for
them.  Characters without a piece are spelt in byte pieces.  No piece crosses into the next word,
so the tree of prefixes branches by word, and the lattices of a few texts' distinct words are built
and read together as arrays: a path draws all its words at once.  What each draw leaves is a branch
with a maximum of its own; of one path's branches only the ``k`` best can ever be taken up, and only
they are kept.

Edge cases: a null text has no segmentation and gives no rows; an empty text gives one sample
without ids; a text with fewer than ``k`` segmentations gives all, each with inclusion 1; repeated
rows draw the same; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import itertools
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from kvloom.llm.shipping import ship

K = 4
RANK_OFFSET = 3.0
BYTE_LOG_PROBABILITY = -14.0
SPOT_BITS = 20  # the table of the pieces' beginnings has 2^20 spots
EARLY = 96  # words of a path whose branches are drawn first; mostly no later one can be among the best
CHARACTERS = 1 << 19  # a batch of samples ends at the text that reaches this many
_BLANK = "▁"
_BY_BLANKS = re.compile(f"{_BLANK}*[^{_BLANK}]+|{_BLANK}+$").findall


class Lattices:
    """The lattices of a few texts' distinct words, as flat arrays.  A node is a character's place,
    counted from the ends of the words: all last characters first, the words in order of length.
    An edge is a piece from there.  A word's segmentation is its edges."""

    def __init__(self, words: list[str], sampler: Sampler):
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        n, begin = len(points), np.cumsum(sizes) - sizes
        rank = np.empty(len(words), np.int64)
        rank[np.argsort(-sizes, kind="stable")] = np.arange(len(words))
        reach = np.bincount(sizes)[::-1].cumsum()[::-1][1:] if n else np.zeros(0, np.int64)  # words that long
        level = np.concatenate([[0], np.cumsum(reach)])
        left = np.repeat(begin + sizes, sizes) - np.arange(n)
        node = np.append(level[left - 1] + np.repeat(rank, sizes), n)
        self.start = level[np.maximum(sizes, 1) - 1] + rank
        parts, counts = self._edges(points, left, node[:-1], sampler)
        self.first = first = np.concatenate([[0], np.cumsum(counts)])
        weight, self.dst, self.pool_start = np.zeros(first[-1]), np.zeros(first[-1], np.int32), np.zeros(first[-1], np.int32)
        for at, length, nth, start, cost in parts:  # longer ones, mostly likelier, first
            to = first[node[at] + 1] - 1 - nth
            self.pool_start[to], weight[to] = start, cost
            self.dst[to] = np.where(left[at] == length, n, node[np.minimum(at + length, n)])
        self.ends = self.dst == n
        mass = np.zeros(n + 1)
        self.p, self.log_p = np.zeros(first[-1]), weight
        for a, b in zip(level.tolist(), level[1:].tolist()):  # from the ends of words to their beginnings
            lo, hi = int(first[a]), int(first[b])
            heads, many = first[a:b] - lo, counts[a:b]
            total = self.log_p[lo:hi]
            total += mass[self.dst[lo:hi]]
            top = total[heads + many - 1]  # of a piece of one character
            share = np.exp(total - np.repeat(top, many))
            sums = np.add.reduceat(share, heads)
            if not np.isfinite(sums).all():
                top = np.maximum.reduceat(total, heads)
                share = np.exp(total - np.repeat(top, many))
                sums = np.add.reduceat(share, heads)
            mass[a:b] = top + np.log(sums)
            self.p[lo:hi] = share / np.repeat(sums, many)
            total -= np.repeat(mass[a:b], many)
        #: What an edge leaves of its node, summed and not subtracted where it may be nearly all.
        self.other = 1.0 - self.p
        large = np.flatnonzero(self.p > 0.999)
        head = np.zeros(len(self.p) + 1, bool)
        head[first] = True
        large = large[~(head[large] & head[large + 1])]  # an only edge leaves nothing
        if len(large):
            heads = np.searchsorted(first, large, "right") - 1
            many = counts[heads]
            upto = np.cumsum(many)
            others = self.p[_spans(first[heads], many, upto)]
            others[upto - many + large - first[heads]] = 0.0
            self.other[large] = np.add.reduceat(others, upto - many)
        #: The probability of a node's edges up to this one; above 1 for the last.
        self.upto = np.cumsum(self.p)
        self.upto -= np.repeat(np.concatenate([[0.0], self.upto])[first[:-1]], counts)
        self.upto[first[1:] - 1] = 2.0

    def _edges(self, points: np.ndarray, left: np.ndarray, node: np.ndarray, sampler: Sampler):
        """Places, length, number among their node's, place in the pool of ids and weight of the
        edges of each length, and how many each node has; sets the pool."""
        counts = np.zeros(len(points), np.int64)
        parts: list[tuple] = []

        def add(at, length, start, cost):
            nth = counts[node[at]]
            counts[node[at]] = nth + 1
            parts.append((at, length, nth, start, cost))

        at, state, length = np.arange(len(points)), np.zeros(len(points), np.int64), 0
        missing = np.ones(len(points), bool)
        while len(at):
            at, state = sampler.step(at, state, points[at + length])
            length += 1
            ids = sampler.piece_of[state]
            hit = np.flatnonzero(ids >= 0)
            found = at[hit]
            if length == 1:
                missing[found] = False
            add(found, length, ids[hit], sampler.weight_of[state[hit]])
            more = np.flatnonzero(left[at] > length)
            at, state = at[more], state[more]
        lost = np.flatnonzero(missing)
        kinds, which = np.unique(points[lost], return_inverse=True)
        spelt = [chr(int(c)).encode("utf-8", "surrogatepass") for c in kinds]
        sizes = np.array([len(b) for b in spelt], np.int64)
        places = len(sampler.sizes) + np.cumsum(sizes) - sizes
        add(lost, 1, places[which], BYTE_LOG_PROBABILITY * sizes[which])
        self.vocabulary = len(sampler.sizes)
        self.pool = np.concatenate([np.arange(self.vocabulary), [sampler.byte_ids[b] for x in spelt for b in x]]).astype(np.int32)
        self.pool_sizes = np.ones(len(self.pool), np.int64)
        self.pool_sizes[places] = sizes
        return parts, counts

    def fresh(self, words: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One segmentation of each word, drawn by its key: edges of all, and how many each has."""
        m = len(words)
        active, now, counts = np.arange(m), self.start[words], np.zeros(m, np.int64)
        steps = []
        while len(active):
            edges, noise = self.first[now], _noise(keys, len(steps))
            late = np.flatnonzero(noise >= self.upto[edges])
            while len(late):
                edges[late] += 1
                late = late[noise[late] >= self.upto[edges[late]]]
            steps.append((active, edges))
            counts[active] += 1
            more = np.flatnonzero(~self.ends[edges])
            active, now, keys = active[more], self.dst[edges[more]], keys[more]
        upto = np.cumsum(counts) - counts
        path = np.zeros(int(counts.sum()), np.int64)
        for i, (tokens, edges) in enumerate(steps):
            path[upto[tokens] + i] = edges
        return path, counts

    def leaves(self, path: np.ndarray, upto: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of words' segmentations, whose edges begin at ``upto``: their log-probabilities, and the
        share of the word's segmentations that each leaves."""
        ends = np.cumsum(counts)
        log_p = np.add.reduceat(self.log_p[path[_spans(upto, counts, ends)]], ends - counts) if len(counts) else np.zeros(0)
        rest = -np.expm1(log_p)
        small = np.flatnonzero(rest < 1e-6)  # summed, as what an edge leaves
        sizes, below = counts[small], np.zeros(len(small))
        for i in range(int(sizes.max(initial=0)) - 1, -1, -1):
            long = np.flatnonzero(sizes > i)
            edges = path[upto[small[long]] + i]
            below[long] = self.other[edges] + self.p[edges] * below[long]
        rest[small] = below
        return log_p, rest

    def taken(self, path: list[int]) -> list:
        """A tree of taken segmentations, of one: what is left of a node (sums only, so small
        shares stay right) and the trees below its edges."""
        tree: list = [0.0, {}]
        for edge in reversed(path):
            tree = [float(self.other[edge]) + float(self.p[edge]) * tree[0], {edge: tree}]
        return tree

    def another(self, word: int, tree: list, draw) -> list[int]:
        """A segmentation drawn from those not taken, which then is taken too."""
        node, out, trees, shares = int(self.start[word]), [], [], []
        while True:
            lo = int(self.first[node])
            weights = self.p[lo : self.first[node + 1]].tolist()
            for edge, below in tree[1].items():
                weights[edge - lo] *= below[0]
            u, pick = draw() * sum(weights), -1
            for e, w in enumerate(weights, lo):
                if w > 0:
                    pick = e
                    u -= w
                    if u < 0:
                        break
            out.append(pick)
            trees.append(tree)
            shares.append((lo, weights))
            tree = tree[1].setdefault(pick, [1.0, {}])
            node = int(self.dst[pick])
            if self.ends[pick]:
                break
        tree[0] = 0.0
        for edge, above, (lo, weights) in zip(reversed(out), reversed(trees), reversed(shares)):
            weights[edge - lo] = float(self.p[edge]) * tree[0]
            above[0] = sum(weights)
            tree = above
        return out

    def spell(self, paths: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all paths in one array, and how many each has."""
        places = self.pool_start[np.concatenate(paths)] if paths else np.zeros(0, np.int32)
        if not len(places) or places.max() < self.vocabulary:
            return self.pool[places], np.fromiter(map(len, paths), np.int64, len(paths))
        taken = self.pool_sizes[places]
        owners = np.repeat(np.arange(len(paths)), [len(p) for p in paths])
        counts = np.bincount(owners, weights=taken, minlength=len(paths)).astype(np.int64)
        return self.pool[_spans(places, taken, np.cumsum(taken))], counts


def _noise(keys: np.ndarray, step: int) -> np.ndarray:
    """Uniform numbers from 0 to below 1, by 64-bit keys and a step."""
    z = keys + np.uint64((step + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    z ^= z >> np.uint64(30)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z *= np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    z >>= np.uint64(11)
    return z * 2.0**-53


def _spot(keys: np.ndarray) -> np.ndarray:
    """A key's place in the sampler's table."""
    return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SPOT_BITS)).astype(np.int64)


def _spans(starts: np.ndarray, sizes: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """The places of consecutive stretches: start, start + 1 ... of each."""
    total = int(upto[-1]) if len(upto) else 0
    kind = np.int32 if max(total, int(starts.max(initial=0))) < 1 << 30 else np.int64
    places = np.repeat((starts - (upto - sizes)).astype(kind), sizes)
    places += np.arange(total, dtype=kind)
    return places


class Sampler:
    """Segmentations of texts under one model file."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces: dict[str, tuple[int, float]] = {}
        self.byte_ids = [0] * 256
        crossing = False
        spelt = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            spelt.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace(_BLANK, " ").encode("utf-8", "surrogatepass"))
            if self.model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
            elif not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i)):
                self.pieces[piece] = (i, -math.log(max(0.0, -self.model.get_score(i)) + RANK_OFFSET))
                crossing |= _BLANK in piece.lstrip(_BLANK)
        self._states()
        self.bytes = np.frombuffer(b"".join(spelt), np.uint8)
        self.sizes = np.array([len(b) for b in spelt], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        #: A word is its leading blanks and what follows them up to the next blank.
        self.split: Callable[[str], list[str]] = (lambda s: [s]) if crossing else _BY_BLANKS

    def _states(self) -> None:
        """The tree of the pieces' beginnings.  A state's key is the state before it (0: the empty
        string) and a code point; keys of one spot of the table are chained."""
        states: dict[int, int] = {}
        ends = []
        for piece in self.pieces:
            state = 0
            for c in piece:
                state = states.setdefault(state << 21 | ord(c), len(states) + 1)
            ends.append(state)
        self.keys = np.array([-1, *states], np.int64)
        self.piece_of, self.weight_of = np.full(len(self.keys), -1, np.int64), np.zeros(len(self.keys))
        ids, weights = zip(*self.pieces.values()) if self.pieces else ((), ())
        self.piece_of[ends], self.weight_of[ends] = ids, weights
        self.table, self.chain = np.zeros(1 << SPOT_BITS, np.int32), np.zeros(len(self.keys), np.int32)
        for state, spot in enumerate(_spot(self.keys[1:]).tolist(), 1):
            self.chain[state], self.table[spot] = self.table[spot], state

    def step(self, at: np.ndarray, state: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of strings that have a state, those that have one with a code point more, and that state."""
        keys = state << 21 | points
        state = self.table[_spot(keys)]
        more = np.flatnonzero(state)
        at, state, keys = at[more], state[more], keys[more]
        wrong = np.flatnonzero(self.keys[state] != keys)
        while len(wrong):
            state[wrong] = self.chain[state[wrong]]
            wrong = wrong[(state[wrong] != 0) & (self.keys[state[wrong]] != keys[wrong])]
        more = np.flatnonzero(state)
        return at[more], state[more].astype(np.int64)

    def _search(self, words: Lattices, chains: list[np.ndarray], k: int, seeds: list[int]) -> tuple[list[list[tuple[np.ndarray, float, float]]], list[float | None]]:
        """For each text the edges, log-probability and maximum of up to ``k`` paths, best first,
        and the maximum of the next, if there is one; its path is not drawn.  The texts take turns:
        each turn draws the next path of all of them at once."""
        rngs = [np.random.default_rng(seed & ((1 << 64) - 1)) for seed in seeds]
        heaps: list[list[tuple]] = [[] for _ in chains]
        found: list[list[tuple[np.ndarray, float, float]]] = [[] for _ in chains]
        pushed = 0

        def push(text, best, *branch):
            nonlocal pushed
            pushed += 1
            heapq.heappush(heaps[text], (-best, pushed, *branch))

        def below(location, best, noise):
            """The largest Gumbel at each ``location``, given that it is below ``best``."""
            return location - np.log(np.exp(np.minimum(700.0, location - best)) - np.log(noise))

        def next_below(location, best, noise):
            """The same of a single one."""
            rate = math.exp(min(700.0, location - best)) - math.log(noise)
            return location - math.log(rate) if rate > 0 else best

        def branch(text):
            """Takes up the text's best branch: text, edges so far, words so far, their
            log-probability, and the branch's maximum."""
            minus, _, at, head, prefix, taken = heapq.heappop(heaps[text])
            word, draw = int(chains[text][at]), rngs[text].random
            taken = words.taken(taken.tolist()) if isinstance(taken, np.ndarray) else taken
            pick = words.another(word, taken, draw)
            if taken[0] > 0:
                push(text, next_below(prefix + math.log(taken[0]), -minus, 1.0 - draw()), at, head, prefix, taken)
            return text, np.append(head, pick), at + 1, prefix + sum(words.log_p[pick].tolist()), -minus

        def finish(turn):
            """Draws the rest of each path.  Of what it leaves, only the ``k`` best can come."""
            tails = [chains[text][at:] for text, _, at, _, _ in turn]
            sizes = np.array([len(t) for t in tails])
            stops = np.cumsum(sizes)
            keys = np.array([rngs[text].integers(1 << 64, dtype=np.uint64) for text, *_ in turn], np.uint64)
            by_place = np.arange(stops[-1], dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
            keys = np.repeat(keys - (stops - sizes).astype(np.uint64) * np.uint64(0xD1342543DE82EF95), sizes) + by_place
            edges, counts = words.fresh(np.concatenate(tails), keys)
            upto, stops = np.cumsum(counts) - counts, stops.tolist()
            begins = [0, *upto.tolist(), len(edges)]
            starts = [0, *stops[:-1]]

            def maxima(lows, sizes, texts):
                """For words of these texts, so many from each low: what comes before each, and
                the largest Gumbel of what it leaves."""
                ends = np.cumsum(sizes)
                at = _spans(lows, sizes, ends)
                log_p, rest = words.leaves(edges, upto[at], counts[at])
                before = np.zeros(len(at))
                for text, lo, hi in zip(texts, (ends - sizes).tolist(), ends.tolist()):
                    if lo < hi:
                        before[lo] = turn[text][3]
                        before[lo + 1 : hi] = turn[text][3] + np.cumsum(log_p[lo : hi - 1])
                return before, below(before + np.log(rest), np.repeat([turn[text][4] for text in texts], sizes), noise[at])

            noise = 1.0 - np.maximum(_noise(keys, -2), 2.0**-53)
            few = np.minimum(sizes, EARLY)
            befores, bests = maxima(np.array(starts), few, range(len(turn)))
            ends = np.cumsum(few).tolist()
            for i, ((text, head, at, prefix, best), lo, hi, a, b) in enumerate(zip(turn, starts, stops, [0, *ends], ends)):
                if lo == hi:
                    found[text].append((head, prefix, best))
                    continue
                begin = begins[lo + 1]
                tail = edges[begin : begins[hi + 1]]
                path = np.concatenate([head, tail])
                before, mine = befores[a:b], bests[a:b]
                if hi - lo > EARLY:
                    floor = np.partition(mine, EARLY - k)[EARLY - k] if k <= EARLY else -math.inf
                    highest = -math.log(-math.log(noise[lo + EARLY : hi].max()))
                    if not before[-1] + highest < floor:  # else no later word can have one of the k best
                        before, mine = maxima(np.array([lo]), np.array([hi - lo]), [i])
                for j in np.argpartition(-mine, k - 1)[:k].tolist() if len(mine) > k else range(len(mine)):
                    if mine[j] > -math.inf:
                        start = begins[lo + j + 1] - begin + len(head)
                        push(text, float(mine[j]), at + j, path[:start], float(before[j]), path[start : start + int(counts[lo + j])])
                found[text].append((path, prefix + float(words.log_p[tail].sum()), best))

        with np.errstate(divide="ignore", over="ignore"):
            turn = [(i, np.zeros(0, np.int64), 0, 0.0, -math.log(-math.log(1.0 - rng.random()) or 1e-300)) for i, rng in enumerate(rngs)]
            while turn:
                finish(turn)
                turn = [branch(i) for i, heap in enumerate(heaps) if heap and len(found[i]) < k]
        return found, [-heap[0][0] if heap else None for heap in heaps]

    def chains(self, texts: list[str]) -> tuple[list[str], list[np.ndarray]]:
        """The distinct words of these texts, less their first blank, and each text's words by number."""
        plain, parts = [], {}
        for i, t in enumerate(texts):
            if self.split is not _BY_BLANKS or not t or t.endswith(" ") or "  " in t or t.startswith(" ") or _BLANK in t:
                parts[i] = [w[1:] for w in self.split(_BLANK + t.replace(" ", _BLANK))] if t else []
            else:
                plain.append(i)
        try:
            lists = pc.split_pattern(pa.array([texts[i] for i in plain], pa.large_string()), " ")
        except UnicodeEncodeError:  # lone surrogates, which no column has
            parts |= {i: texts[i].split(" ") for i in plain}
            plain, lists = [], pa.array([], pa.list_(pa.large_string()))
        coded = lists.flatten().dictionary_encode()
        distinct: list[str] = []
        if len(coded.dictionary):  # joined and split, since none has a blank, faster than one by one
            distinct = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), pa.scalar(" ", pa.large_string()))[0].as_py().split(" ")
        places = np.asarray(coded.indices).astype(np.int64)
        offsets = np.asarray(lists.offsets).tolist()
        found = {i: places[a:b] for i, a, b in zip(plain, offsets, offsets[1:])}
        if any(parts.values()):
            numbers = dict(zip(distinct, itertools.count()))
            for words in parts.values():
                for w in words:
                    numbers.setdefault(w, len(numbers))
            distinct = list(numbers)
        found |= {i: np.fromiter((numbers[w] for w in words), np.int64, len(words)) for i, words in parts.items()}
        return distinct, [found[i] for i in range(len(texts))]

    def batch(self, texts: list[str], k: int, seeds: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all samples of these texts: the text's place, the sample's number, how many ids, all
        ids in one array, log-probabilities and inclusions."""
        distinct, chains = self.chains(texts)
        words = Lattices([_BLANK + w for w in distinct], self)
        rows, places, paths, log_p, inclusion = [], [], [], [], []
        for i, (found, kappa) in enumerate(zip(*self._search(words, chains, k, seeds))):
            for j, (path, p, _) in enumerate(found):
                rows.append(i)
                places.append(j)
                paths.append(path)
                log_p.append(p)
                inclusion.append(1.0 if kappa is None else -math.expm1(-math.exp(min(700.0, p - kappa))))
        ids, counts = words.spell(paths)
        return np.array(rows, np.int64), np.array(places, np.int32), counts, ids, np.array(log_p), np.array(inclusion)

    def sample(self, text: str, k: int, seed: int) -> list[tuple[list[int], float, float]]:
        """Ids, log-probability and inclusion of up to ``k`` distinct segmentations, best first."""
        _, _, counts, ids, log_p, inclusion = self.batch([text], k, [seed])
        parts = np.split(ids, np.cumsum(counts)[:-1])
        return [(part.tolist(), p, q) for part, p, q in zip(parts, log_p.tolist(), inclusion.tolist())]

    def spelt(self, ids: np.ndarray, upto: np.ndarray) -> Iterator[bytes]:
        """The bytes of segmentations that lie behind one another and end at ``upto``: pieces
        joined, the first blank off."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        joined = self.bytes[_spans(self.starts[ids], sizes, ends)].tobytes()
        stops = np.concatenate([[0], ends])[upto].tolist()
        return (joined[a + joined.startswith(b" ", a, b) : b] for a, b in zip([0, *stops], stops))

    def texts(self, ids: np.ndarray, upto: np.ndarray) -> list[str]:
        """Their texts, byte pieces as UTF-8."""
        return [t.decode("utf-8", "replace") for t in self.spelt(ids, upto)]

    def decode(self, ids: list[int]) -> str:
        """The text of any segmentation."""
        return self.texts(np.array(ids, np.int64), np.array([len(ids)]))[0]


_samplers: dict[str, Sampler] = {}


def sampler(path: str) -> Sampler:
    if path not in _samplers:
        _samplers[path] = Sampler(path)
    return _samplers[path]


def _stretches(group: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of the stretches of equal values."""
    cuts = (np.flatnonzero(group[1:] != group[:-1]) + 1).tolist()
    return list(zip([0, *cuts], [*cuts, len(group)])) if len(group) else []


def sample(table: DataFrame, path: str, keys: dict[str, Column], seed: Column, text: str = "text", k: int = K, check: bool = False) -> DataFrame:
    """The key columns (cast to long), and for each sample its number, ids, how many, its
    log-probability and its inclusion score; with ``check`` also ``round_trip``: whether the ids,
    decoded, are the text, byte for byte."""
    ship(table.sparkSession)
    names = list(keys)

    def run(batches):
        from kvloom.llm import subword_sampling

        model = subword_sampling.sampler(path)
        for batch in batches:
            # A few characters at a time: the samples' ids are many times the size of their texts.
            sizes = np.asarray(pc.fill_null(pc.utf8_length(batch.column("text")), 0)).astype(np.int64)
            group = np.cumsum(sizes) // CHARACTERS
            for part in (batch.slice(a, b - a) for a, b in _stretches(group)):
                part = part.filter(pc.is_valid(part.column("text")))
                texts = part.column("text").to_pylist()
                rows, number, counts, ids, log_p, inclusion = model.batch(texts, k, part.column("seed").to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids, pa.int32()))
                taken = pa.array(rows, pa.int64())
                whole = [t.encode("utf-8") for t in texts] if check else []
                same = [pa.array([whole[row] == spelt for row, spelt in zip(rows.tolist(), model.spelt(ids, np.cumsum(counts)))], pa.bool_())] if check else []
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(taken) for c in names), pa.array(number, pa.int32()), lists, pa.array(counts, pa.int32()), pa.array(log_p, pa.float64()), pa.array(inclusion, pa.float64()), *same],
                    names=[*names, "sample", "ids", "n_ids", "log_p", "inclusion", *(["round_trip"] if check else [])],
                )

    schema = ", ".join([*(f"{c} long" for c in names), "sample int, ids array<int>, n_ids int, log_p double, inclusion double", *(["round_trip boolean"] if check else [])])
    chosen = table.select(*[column.cast("long").alias(c) for c, column in keys.items()], table[text].alias("text"), seed.alias("seed"))
    return chosen.mapInArrow(run, schema)


def decode(samples: DataFrame, path: str) -> DataFrame:
    """``samples`` with the text that each row's ``ids`` spell."""
    ship(samples.sparkSession)
    columns = samples.columns

    def run(batches):
        from kvloom.llm import subword_sampling

        spell = subword_sampling.sampler(path).texts
        for batch in batches:
            offsets = np.asarray(batch.column("ids").offsets).astype(np.int64)
            for a, b in _stretches((offsets[1:] - offsets[0]) // CHARACTERS):
                part, ends = batch.slice(a, b - a), offsets[a : b + 1]
                valid = np.asarray(part.column("ids").is_valid())
                ids = np.asarray(part.column("ids").values)[ends[0] : ends[-1]]
                texts = [t if known else None for t, known in zip(spell(ids, ends[1:] - ends[0]), valid)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*columns, "decoded"])

    return samples.mapInArrow(run, StructType([*samples.schema.fields, StructField("decoded", StringType())]))
