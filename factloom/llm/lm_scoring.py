"""Language-model scoring by logistic context mixing.

Tokens are ASCII-lower-cased words and one end per text.  A token is coded as a symbol: one of
the HEAD most frequent tokens, or one of CLASSES classes of all other words by their last two
bytes.  Symbols are the leaves of a Huffman tree, so a token is a walk of binary decisions.
Each decision is predicted by the tree's own counts and by hashed tables of counts under three
contexts (the previous symbol, the two before, the most frequent of the last six); the
predictions, as log-odds, are combined by weights that a gate selects by how often the three
contexts were seen.  Weights start from ones learned on every training document and are refined
while a text is coded: after every BLOCK tokens the log-loss gradient of that block changes the
text's own copy, so every probability depends on the past only.  Texts of more than RUN tokens
are coded in runs that carry weights and contexts on, so RUN changes memory and no score.
Within a class a known word has the probability c / (T + n1 + 1) and all unknown ones together
(n1 + 1) / (T + n1 + 1), with T the tokens and n1 the once-seen words of the class.

Long contexts: a text is cut into segments where a hash of the last three words says so (one
place in sixteen).  A table of the whole corpus, one row for each such context, holds how often
it occurred (T) and its most frequent segment (c times).  That segment has the probability
c / (T + 1) besides its share of the rest, which the mixed bits divide; a training text leaves
its own occurrence out.  So a passage that the corpus holds elsewhere costs about a bit.

What is learned covers every training document: token counts by a grouping of per-task counts,
bit counts by adding per-task tables of fixed size, dealt by table block; the long contexts are
a written table that grows with the corpus, joined by context, the hot ones by broadcast.  Start
weights are learned by each task on all of its tokens, leaving each token's own event out of the
counts, and are averaged by tokens.  The LOOKUP most frequent words and the bit tables are broadcast; their
sizes do not depend on the input.  Counts of rarer words are joined to the texts that hold them,
pre-aggregated per segment.

Defined results: null or empty text is the one end token; a null doc_id counts as the empty
text in the fold; with nothing to learn from all tokens are unknown and every decision is even;
every input row gives one row and repeated rows score alike.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .near_dup import _P, _mix

HEAD, CLASSES = 2048, 64
LOOKUP = 262_144
TABLE_BITS = 18
TABLES = 3
SLOTS = TABLES << TABLE_BITS
TABLE_BLOCK = 1 << 14
MIXER_STEP = 4096
BLOCK = 96
RUN = 1600 * BLOCK
RATE, MIXER_RATE = 0.04, 0.02
#: A context of three words starts a segment if this many bits of its hash are zero.
SEGMENT_BITS = 4
#: Bytes of text that are split into words at a time, and that are coded at a time.
SPLIT_BYTES, PART_BYTES = 1 << 23, 1 << 19
COUNT_FLUSH = 300_000
END = b""

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SEEN = np.array([0, 2, 12, 100], np.int64)  # counts from which a context passes to the next confidence
GATES = 4**TABLES
INPUTS = TABLES + 2


def word_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % CLASSES


_CLASS_OF_ONE = np.array([word_class(bytes([b])) for b in range(256)])
_CLASS_OF_TWO = np.array([word_class(bytes([a, b])) for a in range(256) for b in range(256)])


def word_classes(words: pa.Array, which: np.ndarray) -> np.ndarray:
    """The class of each of *which* words; none of them is empty."""
    if not len(which):
        return np.zeros(0, np.int64)
    _, ends, letters = words.buffers()
    ends = np.frombuffer(ends, np.int32)[words.offset : words.offset + len(words) + 1]
    letters = np.frombuffer(letters, np.uint8).astype(np.int64)
    end = ends[which + 1]
    one, two = letters[end - 1], letters[end - 2]  # of a word of one letter, the second is not its own
    return np.where(end - ends[which] > 1, _CLASS_OF_TWO[two << 8 | one], _CLASS_OF_ONE[one])


class Code:
    """The Huffman tree over symbols: for each symbol its run of (node, bit), and each node's own log-odds."""

    def __init__(self, weights: list[int]) -> None:
        n = len(weights)
        heap = [(w, i, i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        kids: list[tuple[int, int]] = []
        mass = list(weights)
        while len(heap) > 1:
            (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
            kids.append((x, y))
            mass.append(a + b)
            heapq.heappush(heap, (a + b, n + len(kids), n + len(kids) - 1))
        path: list[list[tuple[int, int]]] = [[] for _ in range(n + len(kids))]
        for k in range(len(kids) - 1, -1, -1):
            for bit, child in enumerate(kids[k]):
                path[child] = [*path[n + k], (k, bit)]
        self.lens = np.array([len(path[i]) for i in range(n)], np.int64)
        self.starts = np.cumsum(self.lens) - self.lens
        flat = [e for i in range(n) for e in path[i]]
        self.nodes = np.array([e[0] for e in flat], np.int32)
        self.scattered = (((self.nodes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x27D4EB2F165667C5)) >> np.uint64(64 - TABLE_BITS)).astype(np.int32)
        self.bits = np.array([e[1] for e in flat], np.int8)
        self.prior = np.array([math.log(mass[y] / mass[x]) for x, y in kids], np.float32)


class Model:
    """Everything that a worker needs to turn texts into decisions and to score them."""

    def __init__(self, lookup: list[tuple[bytes, int]], n: int, v: int, class_totals: dict[int, tuple[int, int]]) -> None:
        self.n, self.v = n, v
        rows = sorted(lookup, key=lambda r: (-r[1], r[0]))
        if END not in dict(rows):
            rows.append((END, 0))
        head = [r for r in rows if r[0] != END][: HEAD - 1]
        head = sorted([*head, (END, dict(rows)[END])], key=lambda r: (-r[1], r[0]))
        inside = {w for w, _ in head}
        rest = [r for r in rows if r[0] not in inside]
        totals = {k: list(class_totals.get(k, (0, 0))) for k in range(CLASSES)}
        for w, c in head:  # class totals cover all words; what is left are those outside the head
            k = totals[word_class(w)]
            k[0] -= c
            k[1] -= c == 1
        self.classes = [tuple(totals[k]) for k in range(CLASSES)]
        self.words = pa.array([w for w, _ in [*head, *rest]], pa.binary())
        self.known = len(self.words)
        counts = np.array([c for _, c in [*head, *rest]], np.float64)
        # Index: looked-up words, then a word of each class that the table does not hold.
        self.symbol = np.array([*range(len(head)), *(len(head) + word_class(w) for w, _ in rest), *(len(head) + k for k in range(CLASSES))], np.int64)
        share = [0.0] * len(head) + [math.log(max(c, 1) / (t + n1 + 1)) for (w, c) in rest for t, n1 in [self.classes[word_class(w)]]]
        self.share = np.array([*share, *[0.0] * CLASSES])
        self.base = np.array([*np.log10((counts + 1) / (n + v + 1)), *[0.0] * CLASSES])
        self.seen = np.array([*(counts > 0), *[False] * CLASSES])
        self.end = [w for w, _ in head].index(END)
        self.hashes = np.array([xxhash.xxh3_64_intdigest(w) for w, _ in [*head, *rest]], np.uint64)
        self.code = Code([c + 1 for _, c in head] + [t + n1 + 1 for t, n1 in self.classes])
        self.symbols = len(head) + CLASSES
        self.n0 = self.n1 = self.weights = self.packed = self.others = None

    def indices(self, words: pa.Array) -> np.ndarray:
        """Index of each looked-up word; other words get the number of their class after those."""
        found = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy().astype(np.int64)
        rare = np.flatnonzero(found < 0)
        found[rare] = self.known + word_classes(words, rare)
        return found

    def contexts(self, symbol: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        """The hashed contexts of tokens in a row; *first* is each one's place in its text, over whose start none reaches."""
        none = self.symbols
        one = np.where(first >= 1, np.roll(symbol, 1), none)
        two = np.where(first >= 2, np.roll(symbol, 2), none)
        low = np.full(len(symbol), none, np.int64)
        for back in range(1, 7):
            np.minimum(low, np.where(first >= back, np.roll(symbol, back), none), out=low)
        hashed = [(one + 1) * 0x9E3779B1, (one * (none + 1) + two + 1) * 0x85EBCA6B, (low + 1) * 0xC2B2AE35]
        scrambled = [(h.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS) for h in hashed]
        return [h.astype(np.int32) for h in scrambled]

    def slots(self, symbol: np.ndarray, contexts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of tokens in a row: decisions per token, then each decision's node, bit and table slots (TABLES rows)."""
        lens = self.code.lens[symbol]
        at = C.expand(self.code.starts[symbol], lens)
        place = self.code.scattered[at]
        slots = np.empty((TABLES, len(at)), np.int32)
        for k, c in enumerate(contexts):
            np.add(np.repeat(c, lens), place, out=slots[k])
            slots[k] &= (1 << TABLE_BITS) - 1
            slots[k] += k << TABLE_BITS
        return lens, self.code.nodes[at], self.code.bits[at], slots

    def inputs(self, node: np.ndarray, slots: np.ndarray, packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of every predictor (INPUTS rows: tree, tables, bias) and the gate; *slots* are places in the *packed* tables."""
        x = np.empty((INPUTS, len(node)), np.float32)
        x[0] = self.code.prior.take(node)
        x[-1] = 0.3
        gate = np.zeros(len(node), np.int32)
        for k in range(TABLES):
            both = packed.take(slots[k])
            x[1 + k] = both.view(np.float32)
            gate <<= 2
            gate |= both & 3
        return x, gate

    def ready(self) -> None:
        """The packed tables that score a text."""
        if self.packed is None:
            self.packed = _packed(self.n0, self.n1)

    def ready_without_own(self) -> None:
        """The packed tables that an event which they count learns from: a row for each slot, by the bit that is left out."""
        if self.others is None:
            # A text cut elsewhere than when it was counted may not find its own event.
            less = [n - (n > 0) for n in (self.n0, self.n1)]
            self.others = np.stack([_packed(less[0], self.n1), _packed(self.n0, less[1])], 1).ravel()


def _packed(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log-odds of all table slots, with the confidence in the two lowest bits."""
    a, b = n0.astype(np.float32), n1.astype(np.float32)
    odds = np.log((b + np.float32(0.4)) / (a + np.float32(0.4)))
    conf = np.searchsorted(_SEEN[1:], n0.astype(np.int64) + n1, "right").astype(np.int32)
    return (odds.view(np.int32) & ~3) | conf


def first_weights() -> np.ndarray:
    w = np.zeros((GATES, INPUTS), np.float32)
    w[:, 0], w[:, 1:-1] = 0.4, 0.25
    return w


def split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words per text; of all words in a row, each one's place among the distinct words; and those."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string())))
    lens = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    code, words = coded.indices.to_numpy(), coded.dictionary.cast(pa.binary())
    empty = pc.index(words, pa.scalar(END, pa.binary())).as_py()  # beside white space at either end, and of empty texts
    if empty >= 0:
        here = code != empty
        lens = np.bincount(np.repeat(np.arange(len(lens)), lens)[here], minlength=len(lens))
        code = code[here]
    return lens, code, words


def tokens_of(column: pa.Array, m: Model) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """For every range of texts: its bounds, the indices of all tokens in a row, tokens per text, and each token's place among the distinct words (an end has none: -1)."""
    texts = pc.fill_null(column, "")
    size = pc.binary_length(texts).to_numpy()
    for lo, hi in _groups(size, SPLIT_BYTES):
        lens, code, words = split(texts[lo:hi])
        found = m.indices(words)
        last = np.cumsum(lens + 1) - 1
        inside = np.ones(len(code) + len(lens), bool)
        inside[last] = False
        place = np.full(len(inside), -1, np.int32)
        place[inside] = code
        flat = np.full(len(inside), m.end, np.int64)
        flat[inside] = found.take(code)
        for i, j in _groups(size[lo:hi], PART_BYTES):
            part = slice(last[i] - lens[i], last[j - 1] + 1)
            yield lo + i, lo + j, flat[part], lens[i:j] + 1, place[part], words


def _groups(lens: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about *limit* bytes or tokens together; a longer text is alone."""
    start = held = 0
    for i, n in enumerate(lens.tolist()):
        if i > start and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(lens):
        yield start, len(lens)


def places(lens: np.ndarray) -> np.ndarray:
    """Each token's place in its text."""
    return np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)


def segments(h: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the segments of texts in a row whose tokens have the hashes *h*, with each one's context (a text's first has none) and content."""
    before = [np.concatenate([np.zeros(k, np.uint64), h[:-k] if len(h) >= k else h[:0]])[: len(h)] for k in (1, 2, 3)]
    context = _mix(before[0] * _P[1] + before[1] * _P[2] + before[2] * _P[3])
    opens = (place >= 3) & (context & np.uint64((1 << SEGMENT_BITS) - 1) == 0)
    starts = np.flatnonzero(opens | (place == 0))
    power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(h), _STEP)]))[: len(h)]
    back = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(h), _BACK)]))[: len(h)]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((h | np.uint64(1)) * power)])
    ends = np.append(starts[1:], len(h))
    return starts, context[starts], _mix((total[ends] - total[starts]) * back[starts])


# -- counting -------------------------------------------------------------------------------


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []

    def added() -> pa.Table:
        return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("c", "sum")]).rename_columns(["word", "c"])

    for b in batches:
        texts = pc.fill_null(b.column(0), "")
        for lo, hi in _groups(pc.binary_length(texts).to_numpy(), SPLIT_BYTES):
            _, code, words = split(texts[lo:hi])
            times = np.bincount(code, minlength=len(words))
            used = np.flatnonzero(times)
            held.append(pa.table([words.take(pa.array(used)), pa.array(times[used])], ["word", "c"]))
            held.append(pa.table([pa.array([END]), pa.array([hi - lo])], ["word", "c"]))
            if sum(map(len, held)) > COUNT_FLUSH:
                held[:] = [added()]
                if len(held[0]) > COUNT_FLUSH:
                    yield from held.pop().combine_chunks().to_batches()
    if held:
        yield from added().combine_chunks().to_batches()


def _contexts(model):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        n = np.zeros(2 * SLOTS, np.int64)
        for b in batches:
            for _, _, flat, lens, _, _ in tokens_of(b.column(0), m):
                symbol = m.symbol[flat]
                contexts = m.contexts(symbol, places(lens))
                for a in range(0, len(symbol), RUN):
                    _, _, bit, slots = m.slots(symbol[a : a + RUN], [c[a : a + RUN] for c in contexts])
                    for k in range(TABLES):
                        n[2 * k << TABLE_BITS : 2 * (k + 1) << TABLE_BITS] += np.bincount(2 * (slots[k] - (k << TABLE_BITS)) + bit, minlength=2 << TABLE_BITS)
        n = np.ascontiguousarray(n.reshape(SLOTS, 2).T)
        rows = [(k, n[:, k * TABLE_BLOCK : (k + 1) * TABLE_BLOCK].astype(np.uint32)) for k in range(SLOTS // TABLE_BLOCK)]
        rows = [(k, x.tobytes()) for k, x in rows if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([zlib.compress(x, 1) for _, x in rows], pa.binary())], ["block", "n"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            n = np.frombuffer(zlib.decompress(x), np.uint32)
            total[k] = total[k] + n if k in total else n.astype(np.uint64)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zlib.compress(np.minimum(x, 2**32 - 1).astype(np.uint32).tobytes(), 1) for x in total.values()], pa.binary())], ["block", "n"])


# -- mixing ---------------------------------------------------------------------------------


def score(m: Model, symbol: np.ndarray, lens: np.ndarray, contexts: list[np.ndarray], cell: np.ndarray, w: np.ndarray | None = None, done: int = 0, more: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Log-probability (natural) of the symbols in each cell, and the weights after all, GATES rows for each text by length.

    A text that is coded in runs goes alone: *w* holds its weights so far, of *done* symbols,
    and *more* will follow.
    """
    texts = len(lens)
    longest = np.argsort(-lens, kind="stable")
    rank = np.empty(texts, np.int64)
    rank[longest] = np.arange(texts)
    whole = lens[longest] + done + more
    place = places(lens) + done
    text = np.repeat(rank, lens)
    order = np.lexsort((text, place // BLOCK)) if texts > 1 else np.arange(len(symbol))
    symbol, place, text, contexts, cell = symbol[order], place[order], text[order], [c[order] for c in contexts], cell[order]
    decisions, node, bit, slots = m.slots(symbol, contexts)
    x, gate = m.inputs(node, slots, m.packed)
    owner = np.repeat(text.astype(np.int32), decisions)
    ends = np.cumsum(decisions)
    last = np.flatnonzero(np.append(np.diff(place // BLOCK) > 0, True)) if len(symbol) else np.zeros(0, np.int64)
    sign = np.where(bit == 1, np.float32(1), np.float32(-1))
    w = np.tile(m.weights.astype(np.float32), (texts, 1)) if w is None else w
    row = owner * GATES + gate
    cost = np.empty(len(node), np.float32)
    a = 0
    for z, at in zip(ends[last], last, strict=True):
        r, xs, sg = row[a:z], x[:, a:z], sign[a:z]
        dot = np.einsum("ij,ji->i", w.take(r, 0), xs)
        e = np.exp(np.minimum(-sg * dot, 60))
        np.log1p(e, out=cost[a:z])
        # The last block of a text changes weights that nothing reads any more.
        going = int(np.searchsorted(-whole, -(place[at] // BLOCK + 1) * BLOCK, "left"))
        if going:
            cut = int(np.searchsorted(owner[a:z], going))
            r, xs, sg, e = r[:cut], xs[:, :cut], sg[:cut], e[:cut]
            _descend(w[: going * GATES], r, xs, sg * (e / (1 + e)), RATE)
        a = z
    each = np.add.reduceat(cost, ends - decisions) if len(cost) else cost  # a token has one decision at least
    return -np.bincount(cell, each, int(cell.max(initial=-1)) + 1), w


def _descend(w: np.ndarray, row: np.ndarray, x: np.ndarray, grad: np.ndarray, rate: float) -> None:
    """Move the rows of *w* along the gradient of the decisions that read them."""
    row = row.astype(np.intp)
    step = rate / np.sqrt(np.maximum(np.bincount(row, minlength=len(w)), 1))
    for i in range(INPUTS):
        w[:, i] += step * np.bincount(row, grad * x[i], len(w))


def _mixer(model):  # noqa: ANN001, ANN202
    """(at, total, tokens): this task's start weights times its tokens, one row for each weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        m.ready_without_own()
        w, seen = first_weights(), 0
        for b in batches:
            for _, _, flat, lens, _, _ in tokens_of(b.column(0), m):
                symbol = m.symbol[flat]
                contexts = m.contexts(symbol, places(lens))
                seen += len(symbol)
                for run_at in range(0, len(symbol), RUN):
                    _, node, bit, slots = m.slots(symbol[run_at : run_at + RUN], [c[run_at : run_at + RUN] for c in contexts])
                    slots <<= 1
                    slots |= bit
                    sign = np.where(bit == 1, np.float32(1), np.float32(-1))
                    for a in range(0, len(node), MIXER_STEP):
                        at = slice(a, a + MIXER_STEP)
                        x, gate = m.inputs(node[at], slots[:, at], m.others)
                        e = np.exp(np.minimum(-sign[at] * np.einsum("ij,ji->i", w.take(gate, 0), x), 60))
                        _descend(w, gate, x, sign[at] * (e / (1 + e)), MIXER_RATE)
        rows = np.arange(w.size)
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(w.ravel().astype(np.float64) * seen), pa.array(np.full(w.size, seen))], ["at", "total", "tokens"])

    return run


def coded(m: Model, symbol: np.ndarray, lens: np.ndarray, cell: np.ndarray, run: int = RUN) -> np.ndarray:
    """Log-probability of every cell; *cell* numbers the cells of the symbols in ascending order."""
    out = np.zeros(int(cell.max(initial=-1)) + 1)
    contexts = m.contexts(symbol, places(lens))
    begin = np.cumsum(lens) - lens
    for i, j in _groups(lens, run):
        a, z = int(begin[i]), int(begin[j - 1] + lens[j - 1])
        w, done = None, 0
        for lo in range(a, z, run if j == i + 1 else z - a):
            hi = min(z, lo + run) if j == i + 1 else z
            here = lens[i:j] if j > i + 1 else np.array([hi - lo])
            base = int(cell[lo])
            found, w = score(m, symbol[lo:hi], here, [c[lo:hi] for c in contexts], cell[lo:hi] - base, w, done, z - hi)
            out[base : base + len(found)] += found
            done += hi - lo
    return out


def _score(model):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        m.ready()
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        row = 0
        for b in batches:
            size = pc.fill_null(pc.binary_length(b.column(2)), 0).cast(pa.int64())
            for lo, hi, flat, lens, code, words in tokens_of(b.column(2), m):
                text = np.repeat(np.arange(hi - lo), lens)
                base = np.bincount(text, m.base[flat], hi - lo)
                known = np.bincount(text, m.seen[flat], hi - lo).astype(np.int64)
                place = places(lens)
                at = np.flatnonzero(flat >= m.known)
                h = m.hashes[np.minimum(flat, m.known - 1)]
                rare, which = np.unique(code[at], return_inverse=True)
                spelled = words.take(pa.array(rare))
                h[at] = np.fromiter(map(xxhash.xxh3_64_intdigest, spelled.to_pylist()), np.uint64, len(rare))[which]
                starts, context, content = segments(h, place)
                cell = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(flat))))
                logs = np.bincount(cell, m.share[flat], len(starts)) + coded(m, m.symbol[flat], lens, cell)
                first = np.searchsorted(starts, np.append(np.cumsum(lens) - lens, len(flat)))  # each text's first cell
                held, times = np.unique(cell[at] * len(rare) + which, return_counts=True)  # by cell, so by text
                where, which = np.divmod(held, max(len(rare), 1))
                owner = np.searchsorted(first, where, "right") - 1
                ends = np.searchsorted(owner, np.arange(hi - lo + 1))
                pairs = pa.StructArray.from_arrays([spelled.take(pa.array(which)), pa.array(times), pa.array(where - first[owner], pa.int32())], ["word", "times", "cell"])
                deep = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
                opening = np.zeros(len(starts), bool)
                opening[first[:-1]] = True
                cells = pa.StructArray.from_arrays([pa.array(context.view(np.int64), mask=opening), pa.array(content.view(np.int64)), pa.array(logs)], ["context", "content", "logs"])
                cells = pa.ListArray.from_arrays(pa.array(first, pa.int32()), cells)
                ids = (np.int64(part) << 40) + np.arange(row, row + hi - lo)
                row += hi - lo
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), b.column(0)[lo:hi], b.column(1)[lo:hi], pa.array(lens), pa.array(known), pa.array(base), size[lo:hi], cells, deep],
                    ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "n_bytes", "cells", "deep"],
                )

    return run


def lm_scores(spark: SparkSession, docs: DataFrame, held_out: F.Column) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for every row.

    ``score`` is the model's log10 probability of the tokens, unknown words of a class being one
    event, so it compares texts under this model and not models with other vocabularies.
    ``bits_per_byte`` is the cost of the whole text: it adds eight bits for each byte of an unknown
    word (but for those in segments that the long contexts know) and divides by the bytes of the
    text (one for an empty text).
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    train = rows.where("not held_out")
    counts = train.select("text").mapInArrow(_words, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))
    counts = C.staged(spark, counts, "words")

    sized = counts.withColumn("size", F.floor(F.log2("c") * 16).cast("int"))
    spread = {r["size"]: r for r in sized.groupBy("size").agg(F.count("*").alias("v"), F.sum("c").alias("n")).collect()}  # about a thousand rows
    n, v = sum(r["n"] for r in spread.values()), sum(r["v"] for r in spread.values())
    least, held = 0, 0
    for size in sorted(spread, reverse=True):
        held += spread[size]["v"]
        if held > LOOKUP:
            least = size + 1
            held -= spread[size]["v"]
            break
    lookup = [(bytes(r["word"]), r["c"]) for r in sized.where(F.col("size") >= least).select("word", "c").toLocalIterator()]  # LOOKUP rows at most
    if held < HEAD and least:  # a class of like counts too large to be taken whole: its first words by hash
        some = sized.where(F.col("size") == least - 1).orderBy(F.desc("c"), F.xxhash64("word"), "word").limit(HEAD).select("word", "c").collect()
        sized = sized.join(F.broadcast(spark.createDataFrame([(bytearray(r["word"]),) for r in some], "word binary")), "word", "left_anti")
        lookup += [(bytes(r["word"]), r["c"]) for r in some]
    kind = F.crc32(F.substring("word", -2, 2)) % CLASSES
    totals = counts.groupBy(kind.alias("k")).agg(F.sum("c").alias("t"), F.sum((F.col("c") == 1).cast("long")).alias("once"))
    model = Model(lookup, n, v, {r["k"]: (r["t"], r["once"]) for r in totals.collect()})

    first = spark.sparkContext.broadcast(model)
    tables = train.select("text").mapInArrow(_contexts(first), "block int, n binary").repartition("block").mapInArrow(_added, "block int, n binary").collect()
    model.n0, model.n1 = np.zeros(SLOTS, np.uint32), np.zeros(SLOTS, np.uint32)
    for r in tables:  # SLOTS / TABLE_BLOCK rows
        both = np.frombuffer(zlib.decompress(r["n"]), np.uint32).reshape(2, -1)
        at = slice(r["block"] * TABLE_BLOCK, (r["block"] + 1) * TABLE_BLOCK)
        model.n0[at], model.n1[at] = both
    model.weights = first_weights()
    if n:
        second = spark.sparkContext.broadcast(model)
        learned = train.select("text").mapInArrow(_mixer(second), "at int, total double, tokens long").groupBy("at").agg(F.sum("total"), F.sum("tokens")).collect()
        for at, total, tokens in learned:  # GATES * INPUTS rows; rounded, as sums depend on their order in the last digits
            if tokens:
                model.weights[at // INPUTS, at % INPUTS] = round(total / tokens, 5)

    third = spark.sparkContext.broadcast(model)
    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, n_bytes long, cells array<struct<context:long,content:long,logs:double>>, deep array<struct<word:binary,times:long,cell:int>>"
    scored = C.staged(spark, rows.mapInArrow(_score(third), schema), "scored")

    deep = scored.select("row", F.explode("deep").alias("d")).select("row", "d.word", "d.times", "d.cell")
    rarest = sized.where(F.col("size") < least).select("word", "c")
    classes = F.array(*[F.struct(F.lit(float(t)).alias("t"), F.lit(float(n1)).alias("once")) for t, n1 in model.classes])
    own = classes[(F.crc32(F.substring("word", -2, 2)) % CLASSES).cast("int")]
    known = F.col("c").isNotNull()
    c = F.coalesce(F.col("c"), F.lit(0)).cast("double")
    part = deep.join(rarest, "word", "left").select(
        "row",
        "cell",
        F.when(known, F.col("times")).otherwise(0).alias("known"),
        (F.col("times") * F.log10((c + 1) / (n + v + 1))).alias("base"),
        (F.col("times") * F.log(F.when(known, c).otherwise(own["once"] + 1) / (own["t"] + own["once"] + 1))).alias("logs"),
        F.when(known, 0).otherwise(F.col("times") * F.octet_length("word")).alias("spelled"),
    )
    cells = scored.select("row", "held_out", F.posexplode("cells").alias("cell", "x")).select("row", "held_out", "cell", "x.context", "x.content", "x.logs")
    table = cells.where("context is not null and not held_out").groupBy("context", "content").agg(F.count("*").alias("c"))
    table = table.groupBy("context").agg(F.sum("c").alias("t"), F.max(F.struct("c", "content")).alias("best")).select("context", "t", "best.c", F.col("best.content").alias("usual"))
    table = C.staged(spark, table, "contexts")
    within = C.split_join(cells.where("context is not null"), table, "context", F.col("t") > C.hot_from(table.agg(F.sum("t")).first()[0] or 0), left=True)
    mine = F.when(F.col("held_out"), 0).otherwise(1)
    hit = F.coalesce(F.col("content") == F.col("usual"), F.lit(False))
    seen = F.coalesce(F.col("t"), F.lit(0)) - mine
    times = F.coalesce(F.col("c"), F.lit(0)) - F.when(hit, mine).otherwise(0)
    within = within.select("row", "cell", "logs", F.when(hit, times / (seen + 1)).otherwise(0.0).alias("usual"), ((seen - times + 1) / (seen + 1)).alias("rest"))
    start = cells.where("context is null").select("row", "cell", "logs", F.lit(0.0).alias("usual"), F.lit(1.0).alias("rest"))
    nothing = [F.lit(None).cast(k).alias(x) for x, k in (("known", "long"), ("base", "double"), ("spelled", "long"))]
    both = within.unionAll(start).select("row", "cell", "logs", "usual", "rest", *nothing).unionByName(part.select("row", "cell", "logs", F.lit(None).cast("double").alias("usual"), F.lit(None).cast("double").alias("rest"), "known", "base", "spelled"))
    both = both.repartition("row")  # dealt once: both groupings and the last join are by row
    one = both.groupBy("row", "cell").agg(F.sum("logs").alias("logs"), *(F.max(x).alias(x) for x in ("usual", "rest")), *(F.sum(x).alias(x) for x in ("known", "base", "spelled")))
    logs = F.when(F.col("usual") > 0, F.log(F.col("usual") + F.col("rest") * F.exp("logs"))).otherwise(F.log("rest") + F.col("logs"))
    total = one.groupBy("row").agg(F.sum(logs).alias("log"), *(F.sum(x).alias(f"deep_{x}") for x in ("known", "base", "spelled")), F.sum(F.when(F.coalesce("usual", F.lit(0.0)) == 0, F.col("spelled"))).alias("spelled"))
    out = scored.drop("deep", "cells").join(total, "row", "left").na.fill(0, ["deep_known", "deep_base", "spelled"])
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.col("deep_known")).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("deep_base")).alias("base_score"),
        (F.col("log") / math.log(10)).alias("score"),
        ((-F.col("log") / math.log(2) + 8 * F.col("spelled")) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(spark, C.table(spark, sf_dir, "documents"), C.bucket_of("doc_id", 7) == 2)
