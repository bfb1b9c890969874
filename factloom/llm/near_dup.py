"""MinHash near-duplicates by a multi-index Hamming join.

A document's set holds its distinct five-word shingles (ASCII-lower-cased words between
ASCII white space).  K one-byte MinHash values form its signature.  Two sets of the wanted
similarity have signatures that differ in more than *radius* values with a chance of LOSS at
most (``radius_for`` counts it from the binomial).  The signature is cut into m chunks with
2*m > radius, so by the pigeonhole principle some chunk of such a pair has at most one error;
every chunk is indexed once for each value left out, and pairs with at most one error there
meet under one key.  No pair within the radius is lost.

How it runs on many rows:

1. Equal sets become one class (a grouping with map-side minima, so a group of copies that
   holds a third of all rows costs one row per task).
2. Keys held by one class only are dropped after a counting group-by; the rest meet their
   signatures, and each task unites the pairs within the radius into families.
3. The full sets of a family's members are written once, and each task confirms links between
   sets that it holds.  Links are contracted to components.

A key or family of more than BLOCK classes is dealt over blocks by a hash.  At first the pairs
inside a block, and those of each block with block 0, are compared: two copies of every row,
whatever the size.  Where that leaves several groups, every member outside the largest one
visits all other blocks; members of one group are never compared again.

Defined results: null or empty text has no shingles, is linked with nothing and forms its
own component; a text of fewer than five words has its whole word sequence as the one
shingle; repeated rows with one doc_id and text share a component, and rows with one doc_id
but different texts are judged each by its text; a row without a doc_id is known by its text,
links texts like any other, and takes the smallest doc_id among texts linked to it.  Where
none of them has a doc_id that is null, and one text of them is kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

K = 64
BLOCK = 256
BLOCK_SHINGLES = 1_000_000
#: Chance that a pair at exactly the wanted similarity differs in more values than the radius.
LOSS = 2e-5

_P = np.array([xxhash.xxh64_intdigest(b"position", seed=i) | 1 for i in range(64)], np.uint64)
_A = np.array([xxhash.xxh64_intdigest(b"multiply", seed=i) | 1 for i in range(K)], np.uint64)
_B = np.array([xxhash.xxh64_intdigest(b"flip", seed=i) for i in range(K)], np.uint64)


def radius_for(num: int, den: int, k: int = K) -> int:
    """The least radius that the signature errors of a pair of similarity num/den exceed with a chance of LOSS at most."""
    p, below = 1 - num / den, 0.0
    for r in range(k):
        below += math.comb(k, r) * p**r * (1 - p) ** (k - r)
        if 1 - below <= LOSS:
            return r
    return k - 1


def chunks_for(radius: int, k: int = K) -> list[tuple[int, int]]:
    """Chunk bounds: so many that some chunk has at most one of *radius* errors."""
    m = min(k // 2, radius // 2 + 1)
    cuts = [round(i * k / m) for i in range(m + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: list[bytes], words: C.Memo, width: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    out = []
    for t in texts:
        w = t.lower().split()
        if not w:
            out.append(np.zeros(0, np.uint64))
            continue
        h = np.fromiter(map(words.__getitem__, w), np.uint64, len(w))
        if len(w) < width:
            out.append(_mix(np.array([(h * _P[: len(w)]).sum() + np.uint64(len(w))], np.uint64)))
            continue
        s = h[: len(h) - width + 1] * _P[0]
        for i in range(1, width):
            s = s + h[i : len(h) - width + 1 + i] * _P[i]
        out.append(np.unique(_mix(s)))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of K one-byte MinHash values for each set, none of which may be empty."""
    sig = np.zeros((len(sets), K), np.uint8)
    start = 0
    while start < len(sets):  # ranges of some ten thousand hashes stay in the cache
        end, n = start, 0
        while end < len(sets) and (end == start or n + len(sets[end]) <= 30_000):
            n += len(sets[end])
            end += 1
        flat = np.concatenate(sets[start:end])
        at = np.cumsum([0, *(len(s) for s in sets[start : end - 1])])
        for k in range(K):
            sig[start:end, k] = np.minimum.reduceat((flat ^ _B[k]) * _A[k], at) >> np.uint64(16)
        start = end
    return sig


def words_memo() -> C.Memo:
    return C.Memo(xxhash.xxh3_64_intdigest)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = words_memo()
    for b in batches:
        texts = C.text_bytes(b.column(1))
        for lo, hi in C.sub_batches(texts):
            sets = shingle_sets(texts[lo:hi], words)
            full = [i for i, s in enumerate(sets) if len(s)]
            sig: list[bytes | None] = [None] * len(sets)
            digest: list[bytes | None] = [None] * len(sets)
            if full:
                for i, row in zip(full, signatures([sets[i] for i in full]), strict=True):
                    sig[i], digest[i] = row.tobytes(), xxhash.xxh3_128_digest(sets[i].tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0)[lo:hi], b.column(2)[lo:hi], pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())],
                ["doc_id", "text_key", "n_shingles", "digest", "sig"],
            )


def index_keys(sig: np.ndarray, chunks: list[tuple[int, int]]) -> np.ndarray:
    """K keys for each signature: every chunk with each one of its values left out."""
    v = _mix((sig.astype(np.uint64) + np.uint64(1)) * _P[None, :K])
    keys = np.empty((len(sig), K), np.uint64)
    for s, e in chunks:
        part = v[:, s:e]
        keys[:, s:e] = _mix(part.sum(axis=1, keepdims=True) - part + np.arange(s + 1, e + 1, dtype=np.uint64))
    return keys.view(np.int64)


def _keys(chunks: list[tuple[int, int]]):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                sig = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(-1, K)
                ids = np.repeat(part.column(0).to_numpy(zero_copy_only=False), K)
                yield pa.RecordBatch.from_arrays([pa.array(index_keys(sig, chunks).ravel()), pa.array(ids)], ["key", "cid"])

    return run


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal rows, with the end appended."""
    n = len(columns[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.append(np.flatnonzero(new), n)


def _grouped(batches: Iterator[pa.RecordBatch], keys: int, least: int) -> Iterator[pa.Table]:
    """Tables of at least *least* rows that never cut a run of equal first *keys* columns."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n < least:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        at = _runs(*(t.column(i).to_numpy() for i in range(keys)))
        cut = int(at[-2]) if len(at) > 2 else 0
        if cut:
            yield t.slice(0, cut)
        held = t.slice(cut).to_batches()
        n = t.num_rows - cut
        least = max(least, 2 * n)
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _families(radius: int, across: bool):  # noqa: ANN202
    """Rows (key, block, guest, node, sig) sorted by the first two: nodes with a pair of their rows within *radius* are united.

    Guests are not compared with each other, and with *across* neither are the others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches, 2, 40_000):
            key, block, guest, owner = (t.column(i).to_numpy() for i in range(4))
            sig = np.frombuffer(b"".join(t.column(4).to_pylist()), np.uint8).reshape(-1, K)
            ids, node = np.unique(owner, return_inverse=True)
            root = np.arange(len(ids))
            at = _runs(key, block)
            size = np.diff(at)
            left = np.repeat(at[1:], size) - np.arange(len(key)) - 1  # rows after this one in its run
            rows = np.flatnonzero(left > 0)
            for step in range(1, int(size.max(initial=0))):
                rows = rows[left[rows] >= step]
                if not len(rows):
                    break
                x, y = rows, rows + step
                fit = (root[node[x]] != root[node[y]]) & ((guest[x] != guest[y]) if across else ~(guest[x] & guest[y]))
                x, y = x[fit], y[fit]
                if not len(x):
                    continue
                near = np.concatenate([(sig[x[i : i + 50_000]] != sig[y[i : i + 50_000]]).sum(axis=1) <= radius for i in range(0, len(x), 50_000)])
                root = C.merge_roots(root, node[x[near]], node[y[near]])
            out = np.flatnonzero(root != np.arange(len(root)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[root[out]]), pa.array(ids[out])], ["src", "dst"])

    return run


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(family, blocks, mine, cid, text) with the set in place of the text; of repeated rows a task returns one."""
    words, done = words_memo(), set()
    for b in batches:
        cid = b.column(3).to_pylist()
        new = [i for i, c in enumerate(cid) if c not in done and not done.add(c)]
        b = b.take(pa.array(new, pa.int64()))
        texts = C.text_bytes(b.column(4))
        for lo, hi in C.sub_batches(texts):
            sets = [s.tobytes() for s in shingle_sets(texts[lo:hi], words)]
            yield pa.RecordBatch.from_arrays([*(b.column(i)[lo:hi] for i in range(4)), pa.array(sets, pa.binary())], ["family", "blocks", "mine", "cid", "set"])


def linked(sets: list[np.ndarray], node: np.ndarray, guest: np.ndarray, across: bool, num: int, den: int, radius: int) -> np.ndarray:
    """Forest over nodes 0..: those with a pair of sets that have den*inter >= num*union are united.

    Guests are not compared with each other, and with *across* neither are the others.
    """
    root = np.arange(int(node.max(initial=-1)) + 1)
    size = np.array([len(s) for s in sets], np.int64)
    if len(sets) < 2:
        return root
    sig = signatures(sets)
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.cumsum(size) - size
    mark = np.zeros(int(flat.max()) + 1, bool)
    for i in range(len(sets) - 1):
        j = np.arange(i + 1, len(sets))
        fit = (root[node[j]] != root[node[i]]) & (den * np.minimum(size[j], size[i]) >= num * np.maximum(size[j], size[i]))
        if across:
            fit &= guest[j] != guest[i]
        elif guest[i]:
            fit &= ~guest[j]
        j = j[fit]
        if not len(j):
            continue
        j = j[(sig[j] != sig[i]).sum(axis=1) <= radius]
        if not len(j):
            continue
        mine = flat[at[i] : at[i] + size[i]]
        mark[mine] = True
        starts = np.cumsum(size[j]) - size[j]
        inter = np.add.reduceat(mark[flat[C.expand(at[j], size[j])]].astype(np.int64), starts)
        mark[mine] = False
        j = j[den * inter >= num * (size[j] + size[i] - inter)]
        root = C.merge_roots(root, np.full(len(j), node[i]), node[j])
    return root


def _links(num: int, den: int, radius: int, across: bool):  # noqa: ANN202
    """Rows (family, block, guest, node, cid, set) sorted by the first two: nodes with linked sets are united."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches, 2, 200):
            family, block, guest, owner, cid = (t.column(i).to_numpy() for i in range(5))
            sets = [np.frombuffer(x, np.uint64) for x in t.column(5).to_pylist()]
            at = _runs(family, block)
            src, dst, fam = [], [], []
            for lo, hi in zip(at, at[1:], strict=False):
                order = lo + np.unique(cid[lo:hi], return_index=True)[1]  # by cid; a repeated row counts once
                ids, node = np.unique(owner[order], return_inverse=True)
                root = linked([sets[i] for i in order], node, guest[order], across, num, den, radius)
                out = np.flatnonzero(root != np.arange(len(root)))
                src.append(ids[root[out]])
                dst.append(ids[out])
                fam.append(np.full(len(out), family[lo]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (fam, src, dst)], ["family", "src", "dst"])

    return run


def _dealt(rows: DataFrame, group: str, carried: list[str], guests: DataFrame) -> DataFrame:
    """Rows (group, mine, node, ..) at their own block and *guests* (the same with block) at others, sorted by group and block."""
    columns = [group, "block", "guest", "node", *carried]
    home = rows.select(group, F.col("mine").alias("block"), F.lit(False).alias("guest"), "node", *carried)
    both = home.unionAll(guests.withColumn("guest", F.lit(True)).select(*columns))
    return both.repartition(group, "block").sortWithinPartitions(group, "block")


def _block_zero(rows: DataFrame) -> DataFrame:
    """Members of block 0 as guests of every other block."""
    return rows.where("mine = 0 and blocks > 1").withColumn("block", F.explode(F.sequence(F.lit(1), F.col("blocks") - 1)))


def _apart(spark: SparkSession, rows: DataFrame, group: str, total: int) -> DataFrame:
    """Of *rows* (group, mine, blocks, node, ..), those in groups that hold several nodes, with ``minor``: not of the group's largest node."""
    sizes = rows.groupBy(group, "node").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy(group).agg(F.max(F.struct("n", "node")).alias("top"), F.count("*").alias("nodes"), F.sum("n").alias("held")).where("nodes > 1")
    sizes = C.staged(spark, sizes.select(group, F.col("top.node").alias("major"), "held"), "majors")
    joined = C.split_join(rows, sizes, group, F.col("held") > C.hot_from(total))
    return joined.withColumn("minor", F.col("node") != F.col("major")).drop("major", "held")


def _visits(rows: DataFrame) -> DataFrame:
    """Minor members as guests of every block but their own."""
    return rows.where("minor").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("block != mine")


def _settled(spark: SparkSession, roots: DataFrame, more: DataFrame) -> DataFrame:
    """(node, root) after the roots themselves were united by the edges *more* (src, dst)."""
    up = C.components(spark, more).select(F.col("node").alias("root"), F.col("root").alias("top"))
    moved = roots.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return C.staged(spark, moved.unionAll(up.select(F.col("root").alias("node"), F.col("top").alias("root"))).distinct(), "settled")


def _candidates(spark: SparkSession, classes: DataFrame, radius: int) -> DataFrame:
    """(node, root): the family of every class with another class within the radius."""
    chunks = chunks_for(radius)
    total = classes.count() * K
    keys = classes.select("cid", "sig").mapInArrow(_keys(chunks), "key long, cid long")
    shared = keys.groupBy("key").agg(F.count("*").alias("held")).where("held > 1")
    salts = F.when(F.col("held") > C.hot_from(total), F.ceil(F.col("held") / C.hot_from(total))).otherwise(1).cast("int")
    shared = C.staged(spark, shared.select("key", F.ceil(F.col("held") / BLOCK).cast("int").alias("blocks"), salts.alias("salts")), "shared")
    few = F.broadcast(shared.where("salts > 1").select("key", F.col("salts").alias("own")))  # HOT_KEYS at most
    salted = keys.join(few, "key", "left").select("key", "cid", F.pmod(F.xxhash64("cid"), F.coalesce("own", F.lit(1))).cast("int").alias("salt"))
    spread = shared.select("key", "blocks", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    met = salted.join(spread, ["key", "salt"]).select("key", "blocks", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int").alias("mine"), F.col("cid").alias("node"))
    met = C.staged(spark, met, "met")
    signed = classes.select(F.col("cid").alias("node"), "sig")
    rows = _dealt(met.join(signed, "node"), "key", ["sig"], _block_zero(met).join(signed, "node"))
    roots = C.staged(spark, C.components(spark, rows.mapInArrow(_families(radius, False), "src long, dst long")), "families")
    wide = met.where("blocks > 1")
    if wide.isEmpty():
        return roots
    wide = wide.withColumnRenamed("node", "cid").join(roots.withColumnRenamed("node", "cid"), "cid", "left")
    wide = C.staged(spark, wide.select("key", "blocks", "mine", "cid", F.coalesce("root", "cid").alias("node")), "wide")
    apart = C.staged(spark, _apart(spark, wide, "key", total), "apart")
    if apart.isEmpty():
        return roots
    signed = classes.select("cid", "sig")
    rows = _dealt(apart.join(signed, "cid"), "key", ["sig"], _visits(apart).join(signed, "cid"))
    return _settled(spark, roots, rows.mapInArrow(_families(radius, True), "src long, dst long"))


def _linked_classes(spark: SparkSession, docs: DataFrame, classes: DataFrame, roots: DataFrame, num: int, den: int, radius: int) -> DataFrame:
    """(node, root): the component of every class with a confirmed link, the smallest class id being the root."""
    family = roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())
    known = classes.select(F.col("cid").alias("node"), "n", F.col("first.doc_id").alias("doc_id"), F.col("first.text_key").alias("text_key"))
    family = C.staged(spark, family.join(known, "node").withColumnRenamed("root", "family"), "family")
    total = family.count()
    sized = family.groupBy("family").agg(F.count("*").alias("held"), F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    sized = C.staged(spark, sized, "sized")
    member = C.split_join(family, sized, "family", F.col("held") > C.hot_from(total))
    member = member.select("family", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("mine"), F.col("node").alias("cid"), F.col("doc_id").alias("own_id"), F.col("text_key").alias("own_key"))
    member = C.staged(spark, member, "members")
    same = docs.doc_id.eqNullSafe(F.col("own_id")) & (docs.text_key == F.col("own_key"))
    texts = docs.join(F.broadcast(member) if total <= C.BROADCAST_ROWS else member, same).select("family", "blocks", "mine", "cid", "text")
    sets = C.staged(spark, texts.mapInArrow(_members, "family long, blocks int, mine int, cid long, set binary"), "sets")
    rows = sets.withColumn("node", F.col("cid"))
    rows = _dealt(rows, "family", ["cid", "set"], _block_zero(rows))
    links = C.staged(spark, rows.mapInArrow(_links(num, den, radius, False), "family long, src long, dst long"), "links")

    wide = C.staged(spark, sized.where("blocks > 1").select("family", "held"), "wide")
    small = F.broadcast(wide)  # a family in blocks holds more than BLOCK classes or BLOCK_SHINGLES shingles
    if wide.count() > C.BROADCAST_ROWS:
        small = wide
    stars = links.join(small, "family", "left_anti").select(F.col("dst").alias("node"), F.col("src").alias("root"))
    if wide.isEmpty():
        return stars
    far = C.components(spark, links.join(small, "family", "left_semi").select("src", "dst"))
    held = sets.join(small, "family", "left_semi").join(far.withColumnRenamed("node", "cid"), "cid", "left").withColumn("node", F.coalesce("root", "cid")).drop("root")
    brief = C.staged(spark, held.drop("set").distinct(), "brief")
    apart = C.staged(spark, _apart(spark, brief, "family", total), "apart")
    if not apart.isEmpty():
        whole = apart.join(sets.select("cid", "set"), "cid")
        rows = _dealt(whole, "family", ["cid", "set"], _visits(whole))
        more = rows.mapInArrow(_links(num, den, radius, True), "family long, src long, dst long").select("src", "dst")
        far = _settled(spark, far, more)
    return stars.unionAll(far)


def near_duplicates(spark: SparkSession, docs: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of *docs* (doc_id, text).

    Documents with den * |intersection| >= num * |union| are linked; component_id is the
    smallest doc_id that a document can reach over links, itself included.
    """
    return near_rows(spark, docs, num, den).drop("text_key", "first")


def near_rows(spark: SparkSession, docs: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of *near_duplicates* with ``text_key`` and ``first``: the row is its component's one to keep, or repeats it."""
    radius = radius_for(num, den)
    docs = C.docs_of(docs).withColumn("text_key", C.text_key())
    signed = C.staged(spark, docs.mapInArrow(_sign, "doc_id long, text_key long, n_shingles long, digest binary, sig binary"), "signed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key"))
    classes = signed.where("digest is not null").groupBy("digest").agg(first.alias("first"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.count("*").alias("copies"))
    classes = C.staged(spark, classes.withColumn("cid", F.monotonically_increasing_id()), "classes")  # once written, the numbers stay

    roots = _candidates(spark, classes, radius)
    roots = C.staged(spark, _linked_classes(spark, docs, classes, roots, num, den, radius), "roots")
    both = roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())
    groups = both.join(classes.select(F.col("cid").alias("node"), "first"), "node").groupBy("root").agg(F.min("first").alias("keeper"), F.count("*").alias("held"))
    groups = C.staged(spark, groups, "groups")
    named = C.split_join(both, groups, "root", F.col("held") > C.hot_from(signed.count())).select(F.col("node").alias("cid"), "keeper")
    found = classes.join(named, "cid", "left").select("digest", "copies", F.coalesce("keeper", "first").alias("keeper"))
    found = C.staged(spark, found, "found")

    own = ["doc_id", "text_key", "n_shingles"]
    out = C.split_join(signed.where("digest is not null").select(*own, "digest"), found, "digest", F.col("copies") > C.hot_from(signed.count()))
    component = F.col("keeper.doc_id")
    mine = F.col("doc_id").eqNullSafe(component) & (F.col("text_key") == F.col("keeper.text_key"))
    out = out.select(*own, component.alias("component_id"), F.when(component.isNull(), mine).otherwise(F.col("doc_id").eqNullSafe(component)).alias("kept"), mine.alias("first"))
    alone = signed.where("digest is null").select(*own, F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), F.lit(True).alias("first"))
    return out.unionAll(alone)


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, C.table(spark, sf_dir, "documents"), 85, 100)


OP8_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sh AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s
  FROM w
), sizes AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM sh),
one AS MATERIALIZED (SELECT doc_id, unnest(s) AS g FROM sh),
few AS (SELECT g FROM one GROUP BY g HAVING count(*) > 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM (SELECT * FROM one SEMI JOIN few USING (g)) a JOIN one b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (
  SELECT x, y FROM p JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * i >= 85 * (a.n + b.n - i)
), sym AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, b.y FROM reach r JOIN sym b ON b.x = r.y)
SELECT s.doc_id, s.n AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM sizes s JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) c ON c.x = s.doc_id
"""
