"""SentencePiece encoding and decoding with sampled segmentations: Gumbel top-k without replacement.

The lattice of a text has an edge for every piece of the vocabulary that matches (and byte pieces where a character has
none), weighted by a Zipf law over the pieces' merge ranks, as the model's own scores are ranks.  A text's
segmentations are the paths, their probabilities products of edge weights over the total.

The ``k`` segmentations with the largest Gumbel-perturbed log probabilities are ``k`` draws without replacement.  They
are found by a best-first (A*) search from the top: the root has the perturbed maximum of all paths; walking down, the
branch that keeps the maximum is drawn from the branch probabilities, and the siblings of each step stay behind as one
bundle whose own maximum is a Gumbel truncated at its parent's.  The next segmentation starts at the bundle with the
largest maximum.  The maximum that is left after ``k`` is the threshold ``kappa`` of the inclusion score
``1 - exp(-exp(log_prob - kappa))``, which weights the draws for unbiased estimates.

No piece crosses from a word into the next space, so a text's lattice is a chain of chunk lattices (a run of spaces and
the word after it) and the search has one step for each chunk: which of the chunk's segmentations comes next.  The best
segmentation of a chunk and its probability are worked out once for each distinct chunk; where another one is drawn, a
walk down the chunk's lattice draws it from what the segmentations already taken leave.  Random numbers are a hash of
row key, draw and chunk: a row's result depends on nothing else, however rows are dealt to tasks.

Decoding reverses pieces and bytes; ``decode(ids) == text`` holds for every text that has no literal space mark.

Defined cases: a null text counts as empty; an empty text has one segmentation without pieces (inclusion 1); texts with
fewer than ``k`` segmentations give all they have; repeated rows repeat their result; a null doc_id has the key
``NULL_KEY``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import map_batches, mix64, tokenizer

FILE = "piece_bpe_32k.model"
MODEL = f"/opt/tokenizers/{FILE}"
DRAWS, SMOOTHING, BATCH_CHARS, CACHE_CHUNKS, CACHE_LATTICES, SHORT, PLACES = 2, 10.0, 1 << 19, 300_000, 4_000, 48, 20
NULL_KEY = -(1 << 63)
MARK = "▁"
Path = tuple[int, ...]
_samplers: dict[str, "Sampler"] = {}


class Column:
    """A growing array."""

    def __init__(self, dtype: type):
        self.data, self.n = np.zeros(1024, dtype), 0

    def extend(self, more: np.ndarray) -> None:
        need = self.n + len(more)
        if need > len(self.data):
            self.data = np.concatenate([self.data[: self.n], np.zeros(need, self.data.dtype)])
        self.data[self.n : need] = more
        self.n = need

    def cut(self, n: int) -> None:
        """Forgets all from number ``n`` on."""
        self.n = n
        if len(self.data) > 4 * max(n, 1 << 18):
            self.data = self.data[: 2 * max(n, 1024)].copy()

    def view(self) -> np.ndarray:
        return self.data[: self.n]


class Sampler:
    """Lattices of chunks over one vocabulary, and their best segmentations."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.sp.get_piece_size()
        ranks, self.bytes = {}, {}
        self.raw = [b""] * n  # the bytes that each piece stands for
        for i in range(n):
            if self.sp.is_byte(i):
                self.bytes[int(self.sp.id_to_piece(i)[1:-1], 16)] = i
                self.raw[i] = bytes([int(self.sp.id_to_piece(i)[1:-1], 16)])
            elif not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_unused(i)):
                ranks[self.sp.id_to_piece(i)] = (i, min(float(n), -self.sp.get_score(i)))
                self.raw[i] = self.sp.id_to_piece(i).replace(MARK, " ").encode()
        self.spelt = pa.array(self.raw, pa.binary())
        total = sum(1 / (r + SMOOTHING) for _, r in ranks.values()) + 256 / (n + SMOOTHING)
        self.pieces = {p: (i, 1 / (r + SMOOTHING) / total) for p, (i, r) in ranks.items()}
        self.byte_p = 1 / (n + SMOOTHING) / total
        if any("\n" in p or MARK in p.lstrip(MARK) for p in self.pieces):
            raise ValueError("pieces must not cross from a word into a space")
        self.chunk = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n+")
        self._trie()
        self.forget()

    def _trie(self) -> None:
        """The vocabulary as a trie: sorted (node, character) keys, the node each leads to, and the piece that ends there."""
        letters = sorted({c for p in self.pieces for c in p})
        self.letter = np.zeros(0x110000, np.int64)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        nodes: dict[str, int] = {"": 0}
        for p in self.pieces:
            for k in range(1, len(p) + 1):
                nodes.setdefault(p[:k], len(nodes))
        keys = {nodes[p[:-1]] * self.width + int(self.letter[ord(p[-1])]): i for p, i in nodes.items() if p}
        self.trie_key = np.array(sorted(keys), np.int64)
        self.trie_to = np.array([keys[k] for k in self.trie_key.tolist()], np.int64)
        self.piece_p, self.piece_id = np.zeros(len(nodes)), np.full(len(nodes), -1, np.int64)
        for p, (i, x) in self.pieces.items():
            self.piece_p[nodes[p]], self.piece_id[nodes[p]] = x, i
        self.trie_first = np.full(self.width, -1, np.int64)  # the nodes of single characters, found without a search
        top = np.searchsorted(self.trie_key, self.width)
        self.trie_first[self.trie_key[:top]] = self.trie_to[:top]
        self.longest = max(map(len, self.pieces))
        place = self.place(self.trie_key)
        self.trie_at = np.zeros(1 << PLACES, np.int32)
        self.trie_at[place] = np.arange(len(place))
        beside = self.trie_at[place] != np.arange(len(place))  # keys whose place another key has
        self.crowded = np.zeros(1 << PLACES, bool)
        self.crowded[place[beside]] = True

    @staticmethod
    def place(key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PLACES)).astype(np.int64)

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each key stands in the trie, and whether it does: looked up by its hash, searched only where keys share one."""
        place = self.place(key)
        to = self.trie_at[place]
        hit = self.trie_key[to] == key
        again = np.flatnonzero(self.crowded[place] & ~hit)
        if len(again):
            to[again] = np.minimum(np.searchsorted(self.trie_key, key[again]), len(self.trie_key) - 1)
            hit[again] = self.trie_key[to[again]] == key[again]
        return to, hit

    def forget(self) -> None:
        """Starts the chunk tables anew, so that they stay bounded."""
        self.known: dict[str, int] = {}
        self.lattices: dict[str, list] = {}
        self.log_p, self.at, self.n, self.ids = Column(np.float64), Column(np.int64), Column(np.int64), Column(np.int32)

    def enter(self, log_p: np.ndarray, n: np.ndarray, ids: np.ndarray) -> int:
        """Adds segmentations with their probabilities; returns the number of the first."""
        first = self.n.n
        self.at.extend(self.ids.n + np.cumsum(n) - n)
        self.log_p.extend(log_p)
        self.n.extend(n)
        self.ids.extend(ids)
        return first

    def path(self, entry: int) -> Path:
        a = int(self.at.data[entry])
        return tuple(self.ids.data[a : a + int(self.n.data[entry])].tolist())

    def lattice(self, chunk: str) -> list[list[tuple[int, float, Path]]]:
        """For each position the branches (end, probability given the position, ids), from backward sums."""
        if chunk in self.lattices:
            return self.lattices[chunk]
        n, get = len(chunk), self.pieces.get
        log_b, out = [0.0] * (n + 1), []
        for i in range(n - 1, -1, -1):
            edges = []
            for j in range(i + 1, min(n, i + self.longest) + 1):
                if got := get(chunk[i:j]):
                    edges.append((j, math.log(got[1]) + log_b[j], (got[0],)))
            if not edges or edges[0][0] != i + 1:
                own = chunk[i].encode("utf-8", "surrogatepass")
                edges.insert(0, (i + 1, len(own) * math.log(self.byte_p) + log_b[i + 1], tuple(self.bytes[x] for x in own)))
            top = max(e[1] for e in edges)
            log_b[i] = top + math.log(sum(math.exp(e[1] - top) for e in edges))
            out.append([(j, math.exp(lp - log_b[i]), ids) for j, lp, ids in edges])
        out.reverse()
        if len(self.lattices) > CACHE_LATTICES:
            self.lattices.clear()
        if n <= 4 * SHORT:
            self.lattices[chunk] = out
        return out

    def best_slowly(self, chunk: str) -> tuple[float, list[int]]:
        """The best segmentation of a chunk of any length and its log probability."""
        edges = self.lattice(chunk)
        best: list[tuple[float, int, Path]] = [(0.0, 0, ())] * (len(chunk) + 1)
        for i in range(len(chunk) - 1, -1, -1):
            best[i] = max(((math.log(p) if p else -1e9) + best[j][0], j, ids) for j, p, ids in edges[i])
        i, ids = 0, []
        while i < len(chunk):
            ids += best[i][2]
            i = best[i][1]
        return best[0][0], ids

    def best(self, chunks: list[str]) -> None:
        """Enters the best segmentation of each new chunk; short chunks many at a time."""
        for c in chunks:
            if len(c) > SHORT:
                lp, path = self.best_slowly(c)
                self.known[c] = self.enter(np.array([min(lp, 0.0)]), np.array([len(path)]), np.array(path))
        for part in parted([c for c in chunks if len(c) <= SHORT]):
            entry = self.enter(*Short(self, part).best())
            self.known.update(zip(part, range(entry, entry + len(part)), strict=True))

    def others(self, names: list[str], code: np.ndarray, seeds: np.ndarray) -> np.ndarray:
        """Enters for each chunk, a number of ``names``, a segmentation drawn from all but the best; returns their numbers."""
        out = np.zeros(len(code), np.int64)
        size = np.fromiter(map(len, names), np.int64, len(names))[code]
        for m in np.flatnonzero(size > SHORT).tolist():
            chunk = names[code[m]]
            lp, path = self.another(chunk, [self.path(self.known[chunk])], int(seeds[m]))
            out[m] = self.enter(np.array([lp]), np.array([len(path)]), np.array(path))
        at = np.flatnonzero(size <= SHORT)
        for k in range(0, len(at), 20_000):
            part = at[k : k + 20_000]
            own, which = np.unique(code[part], return_inverse=True)  # one lattice for all draws of a chunk
            entry = self.enter(*Short(self, [names[i] for i in own.tolist()]).other(seeds[part], which))
            out[part] = np.arange(entry, entry + len(part))
        return out

    def another(self, chunk: str, taken: list[Path], seed: int) -> tuple[float, Path]:
        """A segmentation drawn from those not in ``taken``, and its log probability among all."""
        edges, rest = self.lattice(chunk), []
        for path in taken:
            i, k, steps = 0, 0, []
            while i < len(chunk):
                j, p, ids = next(e for e in edges[i] if path[k : k + len(e[2])] == e[2])
                steps.append((j, ids, p))
                i, k = j, k + len(ids)
            mass, out = 1.0, []
            for j, ids, p in reversed(steps):
                mass *= p
                out.append((j, ids, mass))
            rest.append(out[::-1])
        i, depth, log_p, found = 0, 0, 0.0, []
        while i < len(chunk):
            weights = [max(0.0, p - sum(t[depth][2] for t in rest if t[depth][0] == j and t[depth][1] == ids)) for j, p, ids in edges[i]]
            seed = (seed * 6364136223846793005 + 1442695040888963407) & ((1 << 64) - 1)
            u = ((seed >> 11) + 0.5) * 2.0**-53 * sum(weights)
            pick = max(range(len(weights)), key=weights.__getitem__)
            for e, w in enumerate(weights):
                if u < w:
                    pick = e
                    break
                u -= w
            j, p, ids = edges[i][pick]
            log_p += math.log(p)
            found += ids
            rest = [t for t in rest if t[depth][0] == j and t[depth][1] == ids]
            i, depth = j, depth + 1
        return log_p, tuple(found)

    def joined(self, ids: np.ndarray) -> str:
        """The text of a segmentation: its pieces' bytes, without the space before the first word."""
        if not len(ids):
            return ""
        spelt = self.spelt.take(pa.array(ids))
        _, ends, values = spelt.buffers()
        return values.to_pybytes()[: int(np.frombuffer(ends, np.int32)[len(ids)])].decode("utf-8", "replace")[1:]

    def marked(self, text: str) -> str:
        """A text without NUL, its chunks parted by NULs: one before each space and around each line end, runs joined again."""
        if not text:
            return ""
        text = " " + text.replace(MARK, " ")
        out = text.replace(" ", "\0" + MARK)
        if "  " in text:  # twice, as the runs that a pass joins do not overlap
            out = out.replace(f"{MARK}\0{MARK}", MARK + MARK).replace(f"{MARK}\0{MARK}", MARK + MARK)
        if "\n" in text:
            out = out.replace("\n", "\0\n\0")
            if "\n\n" in text:
                out = out.replace("\n\0\0\n", "\n\n").replace("\n\0\0\n", "\n\n")
        return out

    def chunks(self, text: str) -> list[str]:
        if "\0" in text:
            return self.chunk.findall(MARK + text.replace(" ", MARK))
        return list(filter(None, self.marked(text).split("\0")))

    def numbered(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The different chunks of some texts, the number of each chunk in turn, and how many a text has."""
        if not any("\0" in t for t in texts):
            try:
                marked = pa.array(map(self.marked, texts), pa.large_string())
            except UnicodeEncodeError:  # a lone surrogate
                pass
            else:
                lists = pc.split_pattern(marked, "\0")
                coded = lists.values.dictionary_encode()
                names, code = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().astype(np.int64)
                ends = lists.offsets.to_numpy()
                if "" in names:
                    z = names.index("")
                    held = code != z
                    ends = np.append(0, np.cumsum(held))[ends]
                    code = code[held]
                    code -= code > z
                    del names[z]
                return names, code, np.diff(ends)
        parts = [self.chunks(t) for t in texts]
        place = {c: i for i, c in enumerate(dict.fromkeys(c for p in parts for c in p))}
        return list(place), np.array([place[c] for p in parts for c in p], np.int64), np.array([len(p) for p in parts], np.int64)

    def sample(self, keys: list[int], texts: list[str], k: int) -> list[list[tuple[float, float, np.ndarray]]]:
        """For each text its draws (log probability, inclusion, piece ids), the largest perturbed value first."""
        if len(self.known) > CACHE_CHUNKS:
            self.forget()
        names, code, counts = self.numbered(texts)
        self.best([c for c in names if c not in self.known])
        first = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))[code]
        columns = (self.log_p, self.at, self.n, self.ids)
        sizes = [c.n for c in columns]  # the best ones stay; what is drawn besides belongs to these texts only
        out = Search(self, np.array([x & ((1 << 64) - 1) for x in keys], np.uint64), names, code, first, counts).run(k)
        for column, size in zip(columns, sizes, strict=True):
            column.cut(size)
        return out


def parted(chunks: list[str], chars: int = 200_000) -> Iterator[list[str]]:
    part, size = [], 0
    for c in chunks:
        part.append(c)
        size += len(c) + 1
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


class Short:
    """The lattices of many short chunks side by side: ``p[k, i]`` is the weight of the piece of k + 1 characters at i.

    Weights are multiplied by 1000 for each UTF-8 byte, the same for every path of a chunk, so that products stay in range.
    """

    def __init__(self, lattice: Sampler, chunks: list[str]):
        cp = np.frombuffer(("\0".join(chunks) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        self.begin = np.cumsum(size + 1) - size - 1
        self.end = self.begin + size
        letter = lattice.letter[cp]
        width = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
        inside = np.ones(len(cp), bool)
        inside[self.end] = False
        at, node, rows = np.flatnonzero(inside), 0, 0
        p, piece = np.zeros((lattice.longest, len(cp))), np.zeros((lattice.longest, len(cp)), np.int32)  # pieces from 1
        left = np.repeat(self.end, size + 1) - np.arange(len(cp))
        scale, grown = np.array([1.0, 1e3, 1e6, 1e9, 1e12])[width], None
        single = np.zeros(len(cp), bool)
        for k in range(lattice.longest):
            if not len(at):
                break
            if k == 0:
                to = lattice.trie_first[letter[at]]
                hit = to >= 0
                at, node = at[hit], to[hit]
            else:
                nxt = letter[at + k]
                to, hit = lattice.find(node * lattice.width + nxt)
                hit &= nxt > 0
                at, node = at[hit], lattice.trie_to[to[hit]]
            grown = scale[at] if grown is None else grown[hit] * scale[at + k]
            p[k, at], piece[k, at] = lattice.piece_p[node] * grown, lattice.piece_id[node] + 1
            if k == 0:
                single = inside & (piece[0] == 0)
                p[0, single] = lattice.byte_p ** width[single] * scale[single]
            rows += 1
            go = left[at] > k + 1
            at, node, grown = at[go], node[go], grown[go]
        self.p, self.piece = p[:rows], piece[:rows]
        self.width, self.cp, self.bytes, self.single = width, cp, lattice.bytes, single
        self.total, self.top = np.ones(len(cp) + rows), np.ones(len(cp) + rows)
        self.choice = np.zeros(len(cp), np.int64)
        order = np.argsort(left.astype(np.uint8), kind="stable")
        cuts = np.searchsorted(left[order], np.arange(1, SHORT + 2))
        for t, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True), 1):
            s = order[a:b]
            if not len(s):
                continue
            n = min(t, rows)
            to = s + np.arange(1, n + 1)[:, None]
            w = self.p[:n, s]
            self.total[s] = (w * self.total[to]).sum(axis=0)
            value = w * self.top[to]
            self.choice[s] = value.argmax(axis=0)
            self.top[s] = value.max(axis=0)

    def out(self, on: np.ndarray, at: np.ndarray, begin: np.ndarray, end: np.ndarray, log_p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log probabilities, piece counts and pieces of the segmentations that ``on`` marks (piece, or -2 for bytes) for the
        characters ``at``, each one's from ``begin`` to ``end``."""
        count = np.where(on >= 0, 1, np.where(on == -2, self.width[at], 0))
        ids = on[on != -1]
        if (on == -2).any():
            raw = [[x] if x >= 0 else [self.bytes[y] for y in chr(c).encode("utf-8", "surrogatepass")] for x, c in zip(ids.tolist(), self.cp[at[on != -1]].tolist(), strict=True)]
            ids = np.array([y for x in raw for y in x])
        run = np.append(0, np.cumsum(count))
        return np.minimum(log_p, 0.0), run[end] - run[begin], ids

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        on, cur, stop = np.full(len(self.cp), -1, np.int64), self.begin, self.end
        while len(cur):
            k = self.choice[cur]
            on[cur] = np.where((k == 0) & self.single[cur], -2, self.piece[k, cur] - 1)
            cur = cur + k + 1
            go = cur < stop
            cur, stop = cur[go], stop[go]
        return self.out(on, np.arange(len(on)), self.begin, self.end, np.log(self.top[self.begin] / self.total[self.begin]))

    def other(self, seeds: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A segmentation of each chunk that ``which`` numbers, drawn from all but its best."""
        n = len(self.p)
        cur, stop, who = self.begin[which], self.end[which], np.arange(len(which))
        size = stop - cur
        begin = np.cumsum(size) - size
        at = np.repeat(cur - begin, size) + np.arange(int(size.sum()))  # every draw has places of its own
        on, shift = np.full(len(at), -1, np.int64), begin - cur
        same, log_p, seed = np.ones(len(cur), bool), np.zeros(len(cur)), seeds.astype(np.uint64)
        while len(cur):
            to = np.minimum(cur + np.arange(1, n + 1)[:, None], len(self.total) - 1)
            q = self.p[:, cur] * self.total[to] / self.total[cur]
            best = self.choice[cur]
            col = np.arange(len(cur))
            w = q.copy()
            nxt = cur + best + 1
            w[best, col] = np.where(same, w[best, col] * np.maximum(0.0, 1 - self.top[nxt] / self.total[nxt]), w[best, col])
            run = w.cumsum(axis=0)
            seed = mix64(seed + np.uint64(0x9E3779B97F4A7C15))
            u = ((seed >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53 * run[-1]
            k = np.minimum((run <= u).sum(axis=0), n - 1)
            log_p[who] += np.log(q[k, col])
            on[cur + shift[who]] = np.where((k == 0) & self.single[cur], -2, self.piece[k, cur] - 1)
            same &= k == best
            cur = cur + k + 1
            go = cur < stop[who]
            cur, who, same, seed = cur[go], who[go], same[go], seed[go]
        return self.out(on, at, begin, begin + size, log_p)


def uniform(seed: np.ndarray, draw: int, at: np.ndarray, what: int) -> np.ndarray:
    """Uniform numbers in (0, 1), hashed from row key, draw, position and purpose."""
    x = mix64(seed + np.uint64((draw * 8 + what) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    x = mix64(x ^ (at.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def mixed(x: int) -> int:
    """``mix64`` of one number."""
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    x = (x ^ x >> 27) * 0x94D049BB133111EB & (1 << 64) - 1
    return x ^ x >> 31


class Search:
    """The draws of a batch of texts.  A path is an array with the segmentation of every chunk of the batch."""

    def __init__(self, lattice: Sampler, keys: np.ndarray, names: list[str], code: np.ndarray, first: np.ndarray, counts: np.ndarray):
        self.lattice, self.keys, self.names, self.code, self.first = lattice, keys, names, code, first
        self.bounds = np.append(0, np.cumsum(counts))
        self.doc = np.repeat(np.arange(len(counts)), counts)
        self.order = np.arange(len(first)) - self.bounds[self.doc]

    def number(self, draw: int, m: int, what: int) -> float:
        x = mixed(int(self.keys[self.doc[m]]) + (draw * 8 + what) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        return ((mixed(x ^ (int(self.order[m]) * 0xD1342543DE82EF95 & (1 << 64) - 1)) >> 11) + 0.5) * 2.0**-53

    def other(self, draw: int, m: int, taken: list[Path]) -> int:
        lp, path = self.lattice.another(self.names[self.code[m]], taken, int(self.number(draw, m, 3) * (1 << 53)))
        return self.lattice.enter(np.array([lp]), np.array([len(path)]), np.array(path))

    def fill(self, draw: int, at: np.ndarray, path: np.ndarray) -> None:
        """Draws a segmentation of each chunk in ``at``."""
        path[at] = self.first[at]
        u = uniform(self.keys[self.doc[at]], draw, self.order[at], 1)
        rare = at[u >= np.exp(self.lattice.log_p.view()[path[at]])]
        seeds = uniform(self.keys[self.doc[rare]], draw, self.order[rare], 3) * 2.0**53
        path[rare] = self.lattice.others(self.names, self.code[rare], seeds.astype(np.uint64))

    def below(self, mu: np.ndarray, g: np.ndarray, u: np.ndarray) -> np.ndarray:
        """Gumbel numbers at ``mu`` truncated at ``g``."""
        with np.errstate(invalid="ignore"):
            out = mu - np.logaddexp(mu - g, np.log(-np.log(u)))
        return np.where(np.isfinite(mu), out, -np.inf)

    def run(self, k: int) -> list[list[tuple[float, float, np.ndarray]]]:
        n, lat = len(self.bounds) - 1, self.lattice
        docs = np.arange(n)
        g = -np.log(-np.log(uniform(self.keys, 0, np.zeros(n, np.int64), 0)))
        path = np.full(len(self.first), -1, np.int64)
        self.fill(0, np.arange(len(path)), path)
        alive, cut = np.ones(n, bool), np.zeros(n, np.int64)
        drawn: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # path, its bundles' maxima, texts it stands for
        prefixes, phis = [], []
        open_: list[dict[int, tuple[float, int]]] = [{} for _ in docs]  # draw -> its largest bundle and where it is
        taken: dict[tuple[int, int], list[int]] = {}
        for draw in range(k):
            has = path >= 0
            lp = np.where(has, lat.log_p.view()[path], 0.0)
            run = np.cumsum(lp)
            before = np.append(0.0, run)[self.bounds]
            phis.append(before[1:] - before[:-1])
            prefix = run - lp - before[self.doc]
            prefixes.append(prefix)
            r = np.full(len(path), -np.inf)
            at = np.flatnonzero(has & (self.order >= cut[self.doc]))
            with np.errstate(divide="ignore"):
                mu = prefix[at] + np.log(-np.expm1(lp[at]))
            mu[lp[at] > -1e-15] = -np.inf
            r[at] = self.below(mu, g[self.doc[at]], uniform(self.keys[self.doc[at]], draw, self.order[at], 2))
            drawn.append((path, r, alive.copy()))
            g, was, alive = np.full(n, -np.inf), alive, np.zeros(n, bool)
            nxt, fresh = np.full(len(path), -1, np.int64), []
            for d in docs[was].tolist():
                a, b = int(self.bounds[d]), int(self.bounds[d + 1])
                if a == b:
                    continue
                m = a + int(r[a:b].argmax())
                open_[d][draw] = (float(r[m]), m)
                p = max(open_[d], key=lambda x: open_[d][x][0])
                top, m = open_[d][p]
                if top == -np.inf:
                    continue
                g[d], alive[d] = top, True
                if draw == k - 1:
                    continue
                gone = taken.setdefault((p, m), [int(drawn[p][0][m])])
                pick = self.other(draw + 1, m, [lat.path(x) for x in gone])
                gone.append(pick)
                rest = -math.expm1(lat.log_p.data[gone[0]]) - sum(math.exp(lat.log_p.data[x]) for x in gone[1:])
                mu = np.array([prefixes[p][m] + math.log(rest) if rest > 1e-15 else -np.inf])
                drawn[p][1][m] = self.below(mu, np.array([top]), np.array([self.number(draw + 1, m, 4)]))[0]
                m2 = a + int(drawn[p][1][a:b].argmax())
                open_[d][p] = (float(drawn[p][1][m2]), m2)
                nxt[a:m] = drawn[p][0][a:m]
                nxt[m] = pick
                cut[d] = m - a + 1
                fresh.append(np.arange(m + 1, b))
            if draw < k - 1:
                if fresh:
                    self.fill(draw + 1, np.concatenate(fresh), nxt)
                path = nxt
        out: list[list[tuple[float, float, np.ndarray]]] = [[] for _ in docs]
        kappa = np.where(np.isfinite(g), g, 0.0)
        for (path, _, live), phi in zip(drawn, phis, strict=True):
            e = path[path >= 0]
            size = lat.n.view()[e]
            ends = np.cumsum(size)
            flat = lat.ids.view()[np.repeat(lat.at.view()[e] - (ends - size), size) + np.arange(int(size.sum()))]
            bound = np.append(0, np.cumsum(np.where(path >= 0, lat.n.view()[path], 0)))[self.bounds]
            inclusion = np.where(np.isfinite(g), -np.expm1(-np.exp(np.minimum(phi - kappa, 700))), 1.0)
            for d in docs[live].tolist():
                out[d].append((float(phi[d]), float(inclusion[d]), flat[bound[d] : bound[d + 1]]))
        return out


def sampler(path: str = MODEL) -> Sampler:
    if path not in _samplers:
        _samplers[path] = Sampler(path)
    return _samplers[path]


def decode(ids: list[list[int]], path: str = MODEL) -> list[str]:
    return sampler(path).sp.decode(ids, num_threads=1)


def encode(docs: DataFrame, draws: int = DRAWS, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """doc_id, draw (from 0), log_prob, inclusion, n_pieces, decoded (whether decoding gives the text back), digest, ids.

    ``digest`` is a 64-bit hash of the piece ids, in hex; ``ids`` is left out unless ``with_ids``.
    """
    path = path or tokenizer(docs.sparkSession, FILE)
    schema = pa.schema([("doc_id", pa.int64()), ("draw", pa.int32()), ("log_prob", pa.float64()), ("inclusion", pa.float64()), ("n_pieces", pa.int32()), ("decoded", pa.bool_()), ("digest", pa.string())] + [("ids", pa.list_(pa.int32()))] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        lattice = sampler(path)

        def part(ids: list, texts: list[str]) -> pa.RecordBatch:
            rows = []
            for i, t, found in zip(ids, texts, lattice.sample([NULL_KEY if i is None else i for i in ids], texts, draws), strict=True):
                back = [lattice.joined(x[2]) for x in found]
                rows += [(i, n, lp, inc, len(x), s == t, xxhash.xxh64_hexdigest(x.astype("<i4").tobytes(), 0), x) for n, ((lp, inc, x), s) in enumerate(zip(found, back, strict=True))]
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in range(8)]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=False)], schema=schema)

        for b in batches:
            ids, texts, size = [], [], 0
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                ids.append(i)
                texts.append(t.as_py() or "")
                size += len(texts[-1])
                if size >= BATCH_CHARS:
                    yield part(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield part(ids, texts)

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, draw int, log_prob double, inclusion double, n_pieces int, decoded boolean, digest string" + ", ids array<int>" * with_ids)
