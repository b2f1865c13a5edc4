"""SentencePiece encoding and decoding, with Gumbel top-k sampling of segmentations.

A text's lattice has a path for each way to cut it into pieces. No piece of the vocabulary crosses from
a word into the next word's mark, so the lattice is a chain of small ones, kept by distinct word: arcs of
each node with their probabilities given the node (backward sums). The search is A* over prefixes with
perturbed log-probabilities: the root draws the largest Gumbel of all paths; a node hands its value down
to the arc that attains it, drawn in proportion, and its other arcs, as one node, get a Gumbel cut off at
the value. Popping the largest node k times gives k distinct paths in order; the largest that remains is
the threshold of the inclusion scores. All draws are hashes of the row's key and the place in the search.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaylark.llm.common import mix, small_batches

MARK = "▁"
UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Arcs kept by a worker before it starts anew; bounds its memory.
MOST_ARCS = 3_000_000
#: Words over this many characters get their lattice alone.
LONG = 64
#: Characters of texts that are searched in step.
GROUP_CHARS = 400_000
#: Ids that are decoded at once.
DECODED_IDS = 200_000
_MODELS: dict[str, "Model"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def model(path: str | None = None, sharpness: float = 1.0) -> "Model":
    path = path or default_path()
    key = f"{path} {sharpness}"
    if key not in _MODELS:
        _MODELS[key] = Model(path, sharpness)
    return _MODELS[key]


SLOTS = 1 << 19


def _slot(k: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(45)).astype(np.int64)


class Model:
    """Pieces with weights, and the lattices of the words met so far.

    A BPE file's scores are merge ranks; a piece's weight is (rank + 2) ** -sharpness."""

    def __init__(self, path: str, sharpness: float):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.sp.get_piece_size()
        self.pieces = [self.sp.id_to_piece(i) for i in range(n)]
        self.weight: dict[str, tuple[int, float]] = {}
        self.bytes_: dict[int, int] = {}
        spelt = []
        for i, p in enumerate(self.pieces):
            if self.sp.is_byte(i):
                self.bytes_[int(p[3:5], 16)] = i
                spelt.append(bytes([int(p[3:5], 16)]))
            elif self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_unused(i):
                spelt.append(b"")
            else:
                self.weight[p] = (i, (max(-self.sp.get_score(i), 0.0) + 2) ** -sharpness)
                spelt.append(p.replace(MARK, " ").encode())
        self.byte_weight = (n + 2.0) ** -sharpness
        self._trie()
        self.lengths = np.array([len(b) for b in spelt])
        self.offsets = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.flat = np.frombuffer(b"".join(spelt), np.uint8)
        self.fresh()

    def _trie(self) -> None:
        """Edges as a hash table of state * 2 ** 21 + code point; state 0 is the root."""
        states: dict[str, int] = {"": 0}
        edges: list[tuple[int, int]] = []
        for p in self.weight:
            for m in range(1, len(p) + 1):
                if p[:m] not in states:
                    states[p[:m]] = len(states)
                    edges.append(((states[p[: m - 1]] << 21) + ord(p[m - 1]), states[p[:m]]))
        # open addressing: a key lies at its hash or in the slots after, before the first empty one
        self.edge, self.to = np.full(SLOTS + 64, -1), np.zeros(SLOTS + 64, np.int64)
        for e, t in edges:
            at = int(_slot(np.array([e]))[0])
            while self.edge[at] >= 0:
                at += 1
            self.edge[at], self.to[at] = e, t
        self.state_id, self.state_weight = np.full(len(states), -1), np.zeros(len(states))
        for p, (i, w) in self.weight.items():
            self.state_id[states[p]], self.state_weight[states[p]] = i, math.log(w)
        self.deepest = max(map(len, self.weight))
        #: characters that are pieces; whether weights of LONG of them multiply to a number
        self.singles = {p for p in self.weight if len(p) == 1}
        self.linear = LONG * math.log(min(w for _, w in self.weight.values())) > -690

    def fresh(self) -> None:
        #: by arc: cumulative probability within the node, log-probability given the node, log of the others',
        #: next node (-1: the word ends), place and number of its ids in self.ids
        self.up, self.logp, self.rest = (np.zeros(MOST_ARCS) for _ in range(3))
        self.next, self.ids = (np.zeros(MOST_ARCS, np.int32) for _ in range(2))
        #: characters that are no piece: an arc of several ids, kept as -1 - place in self.spelt
        self.spelt: list[tuple[int, ...]] = []
        self.node_arc = np.zeros(MOST_ARCS, np.int32)
        self.n_arcs = self.n_nodes = 0
        self.start: dict[str, int] = {}

    def units(self, texts: list[str]) -> list[np.ndarray]:
        """For each text the first nodes of its words' lattices, which are built where they are new."""
        # the mark before a text stands for the space that decoding takes away
        words = [UNIT.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        seen: set[str] = set().union(*words)
        new = seen.difference(self.start)
        if self.n_arcs + 6 * sum(map(len, new)) > MOST_ARCS:
            self.fresh()
            new = seen
        self._build([w for w in new if len(w) <= LONG], [w for w in new if len(w) > LONG])
        at = self.start.__getitem__
        return [np.fromiter(map(at, ws), np.int64, len(ws)) for ws in words]

    def _build(self, short: list[str], long: list[str]) -> None:
        # a word's sums are made in the same way in any batch
        plain = [w for w in short if self.singles.issuperset(w)] if self.linear else []
        odd = [w for w in short if not self.singles.issuperset(w)] if self.linear else short
        for words, linear in ((plain, True), (odd, False)):
            for i in range(0, len(words), 20_000):
                self._lattices(words[i : i + 20_000], linear)
        for w in long:
            self._lattices([w], False)

    def _lattices(self, words: list[str], linear: bool) -> None:
        """Adds the lattices of words. Each has a slot for each character and one for its end. linear: whether
        no product of weights along a word underflows."""
        sizes = np.array([len(w) for w in words])
        chars = np.frombuffer("\0".join(words).encode("utf-32-le", "surrogatepass") + bytes(4), np.uint32).astype(np.int64)
        n = len(chars)
        ends = np.cumsum(sizes + 1) - 1
        distance = np.repeat(ends, sizes + 1) - np.arange(n)
        # arcs (from, length, id, log weight) by walking the trie from all slots at once
        live, state = np.flatnonzero(distance > 0), np.zeros(int(sizes.sum()), np.int64)
        found: list[tuple[np.ndarray, int, np.ndarray, np.ndarray]] = []
        single = np.zeros(n, bool)
        for m in range(1, self.deepest + 1):
            k = (state << 21) + chars[live + m - 1]
            at, e = _slot(k), np.full(len(k), -1)
            ask = np.arange(len(k))
            while len(ask):
                got = self.edge[at]
                hit = got == k[ask]
                e[ask[hit]] = at[hit]
                more = ~hit & (got >= 0)
                ask, at = ask[more], at[more] + 1
            on = e >= 0
            live, state = live[on], self.to[e[on]]
            ok = self.state_id[state] >= 0
            if m == 1:
                single[live[ok]] = True
            found.append((live[ok], m, self.state_id[state[ok]], self.state_weight[state[ok]]))
            go = distance[live] > m
            live, state = live[go], state[go]
            if not len(live):
                break
        odd = np.flatnonzero(~single & (distance > 0))
        if len(odd):
            spelt = [chr(c).encode("utf-8", "surrogatepass") for c in chars[odd].tolist()]
            places = -1 - np.arange(len(self.spelt), len(self.spelt) + len(odd))
            self.spelt += [tuple(self.bytes_[x] for x in b) for b in spelt]
            found.append((odd, 1, places, np.array([len(b) * math.log(self.byte_weight) for b in spelt])))
        src = np.concatenate([f[0] for f in found])
        length = np.concatenate([np.full(len(f[0]), f[1]) for f in found])
        ident, log_w = np.concatenate([f[2] for f in found]), np.concatenate([f[3] for f in found])
        # the longest first: it mostly has most of the node's probability
        order = np.argsort(src * 64 - length, kind="stable")
        src, dst, ident, log_w = src[order], (src + length)[order], ident[order], log_w[order]
        slots = np.flatnonzero(distance > 0)
        # every slot has an arc
        arc_at = np.flatnonzero(np.diff(src, prepend=-1))
        # sums from the right, in logarithms, all slots of a distance to the end at once
        z, far = np.zeros(n), distance[src].astype(np.int16 if n < 1 << 15 or len(words) > 1 else np.int64)
        by = np.argsort(far, kind="stable")
        cuts = np.flatnonzero(np.diff(far[by], prepend=-1))
        if linear:
            sums, weight = np.ones(n), np.exp(log_w)
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(by)], strict=True):
            part = by[a:b]
            own = src[part]
            first = np.flatnonzero(np.diff(own, prepend=-1))
            if linear:
                sums[own[first]] = np.add.reduceat(weight[part] * sums[dst[part]], first)
                continue
            x = log_w[part] + z[dst[part]]
            top = np.maximum.reduceat(x, first)
            z[own[first]] = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, np.diff(first, append=len(part)))), first))
        if linear:
            z = np.log(sums)
        logp = np.minimum(log_w + z[dst] - z[src], 0.0)
        p = np.exp(logp)
        many = np.diff(arc_at, append=len(src))
        # sums within each node, so that equal words have equal bits in any batch
        up = p.copy()
        for j in range(1, int(many.max(initial=0))):
            at = arc_at[many > j] + j
            up[at] += up[at - 1]
        last = arc_at + many - 1
        up[last] = 1.0
        with np.errstate(divide="ignore"):
            rest = np.log1p(-np.minimum(p, 1.0))
        rest[last[many == 1]] = -np.inf
        slot_node = np.full(n, -1, np.int64)
        slot_node[slots] = self.n_nodes + np.arange(len(slots))
        a, b = self.n_arcs, self.n_arcs + len(src)
        if b > len(self.up):
            for name in ("up", "logp", "rest", "next", "ids", "node_arc"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate((old, np.zeros(b, old.dtype))))
        self.up[a:b], self.logp[a:b], self.rest[a:b] = up, logp, rest
        self.next[a:b], self.ids[a:b] = slot_node[dst], ident
        self.node_arc[self.n_nodes : self.n_nodes + len(slots)] = a + arc_at
        self.n_arcs, self.n_nodes = b, self.n_nodes + len(slots)
        self.start.update(zip(words, slot_node[ends - sizes].tolist(), strict=True))

    def arcs_of(self, arc: int) -> range:
        """All arcs of the node of an arc."""
        node = int(np.searchsorted(self.node_arc[: self.n_nodes], np.int32(arc), "right")) - 1
        return range(int(self.node_arc[node]), int(self.node_arc[node + 1]) if node + 1 < self.n_nodes else self.n_arcs)

    def spell(self, paths: list[np.ndarray]) -> list[np.ndarray]:
        """The ids of each path."""
        sizes = np.array([len(x) for x in paths])
        ids = self.ids[np.concatenate(paths)] if len(paths) else np.zeros(0, np.int32)
        ends = np.cumsum(sizes)
        odd = np.flatnonzero(ids < 0)
        if len(odd):
            spelt = [self.spelt[-1 - x] for x in ids[odd].tolist()]
            n = np.array([len(x) for x in spelt])
            many = np.ones(len(ids), np.int64)
            many[odd] = n
            upto = np.cumsum(many)
            out = np.repeat(ids, many)
            at = np.repeat((upto - many)[odd] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            out[at] = [y for x in spelt for y in x]
            ids, ends = out, np.concatenate(([0], upto))[ends]
        ids = ids.astype("<u4")
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def decode(self, rows: list[np.ndarray]) -> list[str]:
        """The texts of rows of ids: pieces' bytes in order, without the space in front."""
        out, a = [], 0
        while a < len(rows):
            b, held = a + 1, len(rows[a])
            while b < len(rows) and held + len(rows[b]) <= DECODED_IDS:
                held += len(rows[b])
                b += 1
            ids = np.concatenate(rows[a:b]).astype(np.int64)
            n = self.lengths[ids]
            upto = np.concatenate(([0], np.cumsum(n)))
            data = self.flat[np.arange(int(upto[-1])) + np.repeat(self.offsets[ids] - upto[:-1], n)].tobytes()
            cuts = upto[np.cumsum([0, *map(len, rows[a:b])])].tolist()
            for x, y in zip(cuts, cuts[1:], strict=False):
                text = data[x:y].decode("utf-8", "replace")
                out.append(text[1:] if text[:1] == " " else text)
            a = b
        return out


def _uniform(place: np.ndarray) -> np.ndarray:
    return ((mix(place) >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53


_STEP = np.uint64(0x9E3779B97F4A7C15)


class Search:
    """The A* searches over the lattices of some texts, each with its own key, run in step."""

    def __init__(self, m: Model, units: list[np.ndarray], seeds: list[int]):
        self.m, self.units = m, units
        self.seeds = mix(np.array([x & (2**64 - 1) for x in seeds], np.uint64))
        self.calls = 0

    def draws(self, who: np.ndarray, places: np.ndarray) -> np.ndarray:
        """For each text in who a number in (0, 1) that follows its key, the round and the place."""
        with np.errstate(over="ignore"):
            return _uniform(mix(self.seeds[who] + places.astype(np.uint64)) + np.uint64(self.calls) * _STEP)

    def tails(self, who: np.ndarray, begin: list[int], first: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """For each text of who, the arcs of one draw from word begin to the end, its first node first
        where that isn't -1; one after the other, and where each text's end."""
        parts = [self.units[w][b:].copy() for w, b in zip(who.tolist(), begin, strict=True)]
        for p, f in zip(parts, first, strict=True):
            if f >= 0:
                p[0] = f
        sizes = np.array([len(p) for p in parts])
        now = np.concatenate(parts)
        with np.errstate(over="ignore"):
            place = np.arange(len(now), dtype=np.uint64) - np.repeat(np.cumsum(sizes) - sizes, sizes).astype(np.uint64)
            base = mix(np.repeat(self.seeds[who], sizes) + place + np.uint64(self.calls << 44))
        count = np.zeros(len(now), np.int64)
        live, steps = np.arange(len(now)), []
        while len(live):
            with np.errstate(over="ignore"):
                target = _uniform(base + np.uint64(len(steps)) * _STEP)
            arc = self.m.node_arc[now]
            ask = np.flatnonzero(self.m.up[arc] < target)
            while len(ask):
                arc[ask] += 1
                ask = ask[self.m.up[arc[ask]] < target[ask]]
            steps.append((live, arc))
            count[live] += 1
            now = self.m.next[arc]
            go = now >= 0
            live, now, base = live[go], now[go], base[go]
        at = np.cumsum(count) - count
        arcs = np.zeros(int(count.sum()), np.int64)
        for i, (words, arc) in enumerate(steps):
            arcs[at[words] + i] = arc
        word_ends = np.concatenate(([0], np.cumsum(count)))
        return arcs, word_ends[np.cumsum(sizes)]

    def cut(self, phi: np.ndarray, most: np.ndarray, u: np.ndarray) -> np.ndarray:
        """Gumbels at phi, cut off at most."""
        with np.errstate(over="ignore"):
            return np.minimum(phi - np.log(np.exp(phi - most) - np.log(u)), most)

    def sample(self, k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
        """For each text up to k (arcs, log-probability, perturbed value, log inclusion), best first."""
        m, n = self.m, len(self.units)
        out: list[list[tuple[np.ndarray, float, float]]] = [[] for _ in range(n)]
        # (-value, number, path so far, place of the node in it, excluded arcs there)
        root = -np.log(-np.log(self.draws(np.arange(n), np.zeros(n))))
        heaps: list[list[tuple]] = [[(-float(g), 0, None, 0, frozenset())] for g in root]
        number = 0
        for _ in range(k):
            self.calls += 1
            who = np.array([w for w in range(n) if heaps[w]], np.int64)
            if not len(who):
                break
            heads, before, value, begin, first = [], [], [], [], []
            for w in who.tolist():
                minus, _, path, at, excluded = heapq.heappop(heaps[w])
                value.append(-minus)
                if path is None:
                    heads.append(np.zeros(0, np.int64))
                    before.append(0.0)
                    begin.append(0)
                    first.append(-1)
                    continue
                left = [x for x in m.arcs_of(int(path[at])) if x not in excluded]
                p = np.exp(m.logp[left])
                u, v = self.draws(np.array([w, w]), np.array([1, 2]))
                chosen = left[min(int(np.searchsorted(np.cumsum(p / p.sum()), u)), len(left) - 1)]
                held = float(m.logp[path[:at]].sum())
                others = [x for x in left if x != chosen]
                head = np.append(path[:at], chosen)
                if others:
                    phi = held + float(np.log(max(np.exp(m.logp[others]).sum(), 1e-300)))
                    number += 1
                    heapq.heappush(heaps[w], (-float(self.cut(np.array([phi]), np.array([-minus]), np.array([v]))[0]), number, head, at, excluded | {chosen}))
                heads.append(head)
                before.append(held + float(m.logp[chosen]))
                words = int((m.next[path[:at]] < 0).sum())
                goes_on = int(m.next[chosen])
                begin.append(words if goes_on >= 0 else words + 1)
                first.append(goes_on)
            arcs, ends = self.tails(who, begin, first)
            sizes = np.diff(ends, prepend=0)
            logp = m.logp[arcs]
            # sums within each text, so that its values don't depend on the others of the group
            upto, whole = np.zeros(len(logp)), []
            for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
                sums = np.cumsum(logp[a:b])
                upto[a + 1 : b] = sums[:-1]
                whole.append(float(sums[-1]) if b > a else 0.0)
            most = np.repeat(np.array(value), sizes)
            phi = np.repeat(np.array(before), sizes) + upto + m.rest[arcs]
            place = np.arange(len(arcs)) - np.repeat(ends - sizes, sizes) + 3
            v = self.cut(phi, most, self.draws(np.repeat(who, sizes), place))
            v[~np.isfinite(phi)] = -np.inf
            for i, w in enumerate(who.tolist()):
                a, b = int(ends[i] - sizes[i]), int(ends[i])
                path = np.concatenate((heads[i], arcs[a:b]))
                out[w].append((path, before[i] + whole[i], value[i]))
                # no more of these can be popped or be the threshold
                most_kept = k - len(out[w]) + 1
                keep = np.argpartition(-v[a:b], most_kept)[:most_kept] if b - a > most_kept else np.arange(b - a)
                for x in keep.tolist():
                    if v[a + x] > -np.inf:
                        number += 1
                        at = len(heads[i]) + x
                        heapq.heappush(heaps[w], (-float(v[a + x]), number, path, at, frozenset([int(path[at])])))
        kappa = [-h[0][0] if h else -math.inf for h in heaps]
        return [[(a, p, g, _log_inclusion(p - kappa[w])) for a, p, g in out[w]] for w in range(n)]


def _groups(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about GROUP_CHARS characters."""
    a = n = 0
    for b, t in enumerate(texts):
        n += len(t or "")
        if n > GROUP_CHARS:
            yield a, b + 1
            a, n = b + 1, 0
    if a < len(texts):
        yield a, len(texts)


def _log_inclusion(x: float) -> float:
    """log(1 - exp(-exp(x)))."""
    if x > 3:
        return math.log1p(-math.exp(-math.exp(min(x, 700.0)))) if math.exp(min(x, 700.0)) < 700 else 0.0
    return math.log(-math.expm1(-math.exp(x))) if x > -30 else x


SAMPLES = "doc_id long, sample int, ids binary, n_pieces long, log_prob double, log_inclusion double"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("sample", pa.int32()), ("ids", pa.binary()), ("n_pieces", pa.int64()), ("log_prob", pa.float64()), ("log_inclusion", pa.float64())])


def sample_texts(texts: list[str | None], keys: list[int | None], k: int, m: Model) -> list[list[tuple[np.ndarray, float, float]]]:
    """For each text up to k (ids, log-probability, log inclusion score)."""
    units = m.units([t or "" for t in texts])
    found = Search(m, units, [(key or 0) * 2654435761 + 97 for key in keys]).sample(k)
    ids = iter(m.spell([a for f in found for a, *_ in f]))
    return [[(next(ids), p, i) for _, p, _, i in f] for f in found]


def sample_segmentations(docs: DataFrame, k: int = 2, sharpness: float = 1.0, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", crc: bool = False) -> DataFrame:
    """SAMPLES, with crc also text_crc32, the crc32 of the text's UTF-8: for each row of docs up to k distinct segmentations of its whole text, drawn without
    replacement in proportion to their probability, best perturbed value first (sample from 1).

    ids are little-endian unsigned 32-bit. A null or empty text has one segmentation, of no pieces; a
    text with fewer than k gives all it has, with inclusion score log 1 = 0. Draws depend on the id and
    the text alone: equal rows give equal samples. A mark (U+2581) in a text stands for a space, and is
    decoded as one. A null id counts as 0 and stays null. Other columns
    are ignored."""
    small_batches(docs.sparkSession)
    schema = _SCHEMA.append(pa.field("text_crc32", pa.int64())) if crc else _SCHEMA

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path, sharpness)
        for batch in batches:
            rows = []
            keys, texts = batch.column("id").to_pylist(), batch.column("text").to_pylist()
            crcs = [zlib.crc32((t or "").encode()) for t in texts] if crc else None
            for a, b in _groups(texts):
                for at, found in enumerate(sample_texts(texts[a:b], keys[a:b], k, m), a):
                    rows += [(keys[at], n + 1, ids.tobytes(), len(ids), p, inc, *([crcs[at]] if crc else [])) for n, (ids, p, inc) in enumerate(found)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(f, SAMPLES + ", text_crc32 long" * crc)


def decode(samples: DataFrame, path: str | None = None) -> DataFrame:
    """samples with the text of ids in text; null ids give null."""
    samples = samples.select("doc_id", "sample", "n_pieces", "log_prob", "log_inclusion", "ids", *[c for c in samples.columns if c == "text_crc32"])
    schema = samples.select("*").schema.add("text", "string")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            there = iter(m.decode([np.frombuffer(x, "<u4") for x in ids if x is not None]))
            text = [None if x is None else next(there) for x in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], [*batch.schema.names, "text"])

    return samples.mapInArrow(f, schema)
