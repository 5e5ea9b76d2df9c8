"""Near-duplicate join on word shingles: a MinHash LSH forest with exact verification.

A text is the set of its runs of five words (of all its words, if it has fewer).
Two texts are linked if the Jaccard similarity of their sets is at least 0.8.

1. Texts with equal sets are one class; all that follows works on classes.
2. Each of ``trees`` prefix tries holds a class under a label of eight digits, 16
   bits of a min-hash each. Labels are stored sorted, tree by tree, so a node of
   a trie is a run of rows with a common prefix. A class alone under the
   shortest prefix that can be wanted is alone under all, and is left out.
3. The matched prefix is shortened adaptively. First classes that share all
   eight digits in some trie are verified; that finds even a pair at the
   threshold with a probability of 0.97, and others more surely. The least
   similar link at hand tells how alike links are here: as long as the prefix
   in use would find one like it with less than ``SURE`` (0.999999), the longest
   prefix that is sure enough comes next, and only pairs without a longer match
   are verified; the shortest is the one that finds a pair at the threshold with
   ``recall`` (0.9999 unless given). So data whose links are all close get by with long prefixes and
   small nodes, and one link just at the threshold brings the shortest prefix.
4. Nodes with the same members in several tries are kept once; a pair in
   different nodes belongs to its first trie, so each pair is verified once.
5. A node's classes are dealt into blocks of bounded bytes and rows, which few
   nodes exceed; blocks are compared pairwise, each pair in a task of its own.
   Shingles with the same owners are one column of a matrix, whose product with
   itself gives the exact sizes of the intersections, tile by tile. Only sums
   and one edge a class leave a task, never pairs.
6. Links are joined to connected components: the classes of near-duplicates.

A class's set is sent once for each node and depth that it takes part in (at most
``trees`` a depth), and in a node of b blocks b times: rows grow with the members
up to a block (8,192 classes or 32 MB), beyond it with members times blocks. Time
grows with the square of a node's different texts, as counting exact links must.

Cases: a null or blank text has no shingles and no links; rows with equal text
are copies, linked to each other; a null doc_id is less than any other; ties of
class ids go by the least doc_id; an empty table gives no rows; long texts are
hashed piece by piece, and a set is held whole only where it is verified; further
columns are ignored by ``near_duplicates`` and kept by ``keep_one``, whatever
their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.components import components
from lodestone.llm.memory import bounded, returned
from lodestone.session import forget, ship, stored

WIDTH = 5
THRESHOLD = (4, 5)
TREES = 20
#: Digits of a label, four to a 64-bit number.
DEPTH = 8
RECALL = 0.9999
#: How surely a prefix has to find links like the least similar one at hand, so that it need not be shortened.
SURE = 0.999999
#: A block's most classes, and bytes of their sets.
BLOCK_ROWS, BLOCK_BYTES = 8_192, 32 << 20
#: Rows of a block pair whose links are taken at once, and numbers in a matrix.
TILE, NUMBERS = 512, 4_000_000
#: Tables of ids up to this number of rows are broadcast, at some 40 bytes each.
MOST_BROADCAST = 400_000
_NULL = -(1 << 63)
_U = np.uint64
_PRIME = 0x9E3779B97F4A7C15
_PIECE = 1 << 18


def chance(similarity: float, depth: int, trees: int = TREES) -> float:
    """The probability that a pair shares a prefix of this depth in some trie."""
    return 1 - (1 - similarity**depth) ** trees


def depth_for(threshold: tuple[int, int] = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix that finds a pair at the threshold itself with this recall: the shortest one ever needed."""
    s = threshold[0] / threshold[1]
    while depth > 1 and chance(s, depth, trees) < recall:
        depth -= 1
    return depth


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTES = _mix(np.arange(1, 257, dtype=_U) * _U(_PRIME))
_GAP = np.zeros(256, bool)
_GAP[[32, 9, 10, 11, 12, 13]] = True
_UP = np.concatenate([[_U(1)], np.cumprod(np.full(_PIECE * 2, _PRIME, _U))])
_DOWN = np.concatenate([[_U(1)], np.cumprod(np.full(_PIECE * 2, pow(_PRIME, -1, 1 << 64), _U))])


def _words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and 64-bit hashes of the words in some bytes, at most as many as the power tables hold."""
    gap = np.concatenate([[True], _GAP[raw], [True]])
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    begins, ends = edges[0::2], edges[1::2]
    sums = np.concatenate([[_U(0)], np.cumsum(_BYTES[raw] * _UP[: len(raw)])])
    return begins, _mix((sums[ends] - sums[begins]) * _DOWN[begins] + (ends - begins).astype(_U))


def _word_hashes(text: bytes) -> np.ndarray:
    """The hashes of a long text's words, piece by piece, cut at gaps."""
    out, at = [], 0
    while at < len(text):
        stop = min(len(text), at + _PIECE)
        if stop < len(text):
            last = max(text.rfind(c, at, stop) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            if last <= at:  # one word longer than a piece: hash what there is of it as it stands
                nexts = [x for x in (text.find(c, stop) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if x >= 0]
                end = min(nexts, default=len(text))
                parts = [_words(np.frombuffer(text[k : min(end, k + _PIECE)].lstrip(b" \t\n\r\x0b\x0c"), np.uint8))[1] for k in range(at, end, _PIECE)]
                out.append(_mix(np.cumsum(np.concatenate(parts) * _U(3)))[-1:])
                at = end
                continue
            stop = last
        out.append(_words(np.frombuffer(text[at:stop], np.uint8))[1])
        at = stop
    return np.concatenate(out) if out else np.empty(0, _U)


def _shingles(words: np.ndarray, width: int) -> np.ndarray:
    """The set of a text's shingles, as sorted distinct hashes."""
    if not len(words):
        return words
    k = min(width, len(words))
    total = np.zeros(len(words) - k + 1, _U)
    for j in range(k):
        total = total * _U(0xD6E8FEB86659FD93) + words[j : len(words) - k + 1 + j]
    return np.unique(_mix(total))


def shingle_sets(texts: list[bytes], width: int = WIDTH):
    """The shingle set of each text; short texts are hashed together."""
    begin = 0
    while begin < len(texts):
        if len(texts[begin]) > _PIECE:
            yield _shingles(_word_hashes(texts[begin]), width)
            begin += 1
            continue
        end, size = begin, 0
        while end < len(texts) and size + len(texts[end]) + 1 <= _PIECE:
            size += len(texts[end]) + 1
            end += 1
        end = max(end, begin + 1)
        at, hashes = _words(np.frombuffer(b"\n".join(texts[begin:end]), np.uint8))
        starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts[begin:end]])])
        cuts = np.searchsorted(at, starts)
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield _shingles(hashes[a:b], width)
        begin = end


class Forest:
    """The hash functions of the tries: a class's label in each, as two numbers of four digits."""

    def __init__(self, trees: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        n = trees * DEPTH
        self.trees = trees
        self.flip = rng.integers(0, 1 << 63, n, dtype=_U) * _U(2) + rng.integers(0, 2, n, dtype=_U)
        self.times = rng.integers(0, 1 << 63, n, dtype=_U) * _U(2) + _U(1)

    def labels(self, shingles: np.ndarray) -> np.ndarray:
        """The first halves of all tries' labels, then the second halves."""
        least = np.full(self.trees * DEPTH, ~_U(0))
        for at in range(0, len(shingles), 2048):
            part = shingles[at : at + 2048, None] ^ self.flip
            part *= self.times
            least = np.minimum(least, part.min(axis=0))
        digits = (_mix(least) >> _U(48)).reshape(self.trees, 2, DEPTH // 2)
        halves = np.zeros((self.trees, 2), _U)
        for i in range(DEPTH // 2):
            halves = halves << _U(16) | digits[:, :, i]
        return halves.T.reshape(-1)


def _prefix(tree: int, depth: int) -> list[Column]:
    """A node of a trie, as expressions over the halves of labels."""
    half = DEPTH // 2
    cut = lambda c, k: F.shiftrightunsigned(F.col(c), 16 * (half - k)) if k < half else F.col(c)
    return [cut(f"a{tree}", depth), F.lit(0).cast("long")] if depth <= half else [F.col(f"a{tree}"), cut(f"b{tree}", depth - half)]


def _nodes(labels: np.ndarray, depth: int) -> np.ndarray:
    """The nodes of this depth that classes are under, a column a trie, hashed to one number."""
    trees, half = labels.shape[1] // 2, DEPTH // 2
    a, b = labels[:, :trees], labels[:, trees:]
    if depth <= half:
        return a >> _U(16 * (half - depth))
    return _mix(a * _U(_PRIME) + _U(1)) ^ (b >> _U(16 * (DEPTH - depth)))


def _set_hash(s: np.ndarray) -> tuple[int, int]:
    a, b = _mix(s + _U(1)).sum(dtype=_U), np.bitwise_xor.reduce(_mix(s ^ _U(_PRIME))) if len(s) else _U(0)
    return int(np.int64(a.view(np.int64))), int(np.int64(_U(b).view(np.int64)))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("d"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("r"))


def _texts(column) -> list[bytes]:
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def signatures(docs: DataFrame, trees: int = TREES, width: int = WIDTH) -> DataFrame:
    """One row a document: d, its text's hash r, the hashes of its shingle set, its size, and its label in each trie."""
    bounded(ship(docs.sparkSession))
    names = ["d", "r", "h1", "h2", "n", *_halves(trees)]

    def run(batches):
        forest = Forest(trees)
        for b in batches:
            texts = _texts(b.column(1))
            labels, heads = np.zeros((2 * trees, len(texts)), _U), []
            for i, s in enumerate(shingle_sets(texts, width)):
                heads.append((*_set_hash(s), len(s)))
                if len(s):
                    labels[:, i] = forest.labels(s)
            head = list(zip(*heads)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *[pa.array(h, pa.int64()) for h in head], *[pa.array(x.view(np.int64)) for x in labels]], names=names)

    return _keyed(docs).mapInArrow(lambda batches: returned(run(batches)), ", ".join(f"{c} long" for c in names))


def _halves(trees: int) -> list[str]:
    return [f"{h}{t}" for h in "ab" for t in range(trees)]


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """d, the hashes of the set and the set itself."""

    def run(batches):
        for b in batches:
            texts = _texts(b.column(1))
            sets = list(shingle_sets(texts, width))
            heads = list(zip(*map(_set_hash, sets))) or [[], []]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(h, pa.int64()) for h in heads], pa.array([s.tobytes() for s in sets], pa.binary())], names=["d", "h1", "h2", "shingles"])

    return docs.mapInArrow(lambda batches: returned(run(batches)), "d long, h1 long, h2 long, shingles binary")


class Owners:
    """The shingles of some sets that two or more have; those with the same owners are one column with a weight."""

    def __init__(self, sets: list[np.ndarray], seed: int = 9):
        self.g = len(sets)
        every = np.concatenate(sets)
        order = np.argsort(every, kind="stable")
        owner = np.repeat(np.arange(self.g), [len(s) for s in sets])[order]
        every = every[order]
        starts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.empty(0, int)
        counts = np.diff(np.append(starts, len(every)))
        code = np.random.default_rng(seed).integers(1, 1 << 63, self.g, dtype=_U)
        kinds = np.add.reduceat(_mix(code[owner]), starts) if len(starts) else np.empty(0, _U)
        shared = np.flatnonzero(counts > 1)
        _, first, weight = np.unique(kinds[shared], return_index=True, return_counts=True)
        self.weight = weight
        self.owners = [owner[starts[i] : starts[i] + counts[i]] for i in shared[first]]

    def common(self, begin: int, end: int) -> np.ndarray:
        """The sizes of the intersections of the sets from begin to end with all sets; a set with itself aside."""
        kind = np.float32 if self.weight.sum() < 1 << 24 else np.float64  # whole numbers are exact up to here
        out = np.zeros((end - begin, self.g), kind)
        step = max(1, NUMBERS // max(1, self.g))
        for at in range(0, len(self.weight), step):
            part = self.owners[at : at + step]
            m = np.zeros((self.g, len(part)), kind)
            m[np.concatenate(part), np.repeat(np.arange(len(part)), [len(x) for x in part])] = 1
            out += (m[begin:end] * self.weight[at : at + step].astype(kind)) @ m.T
        return np.rint(out).astype(np.int64)


def _block_links(tree: int, depth: int, before: int | None, labels: np.ndarray, block: np.ndarray, sets: list[np.ndarray], threshold: tuple[int, int]):
    """The links of a block pair that this trie has to find at this depth, in tiles: (begin, end, links, similarities)."""
    g = len(sets)
    here = _nodes(labels, depth)[:, :tree]
    done = _nodes(labels, before) if before else here[:, :0]
    across = block.min() != block.max()
    owners = None
    size = np.array([len(s) for s in sets], np.int64)
    for begin in range(0, g, TILE):
        end = min(g, begin + TILE)
        wanted = block[begin:end, None] != block[None, :] if across else np.ones((end - begin, g), bool)
        wanted[np.arange(end - begin), np.arange(begin, end)] = False
        least, most = np.minimum(size[begin:end, None], size[None, :]), np.maximum(size[begin:end, None], size[None, :])
        wanted &= threshold[1] * least >= threshold[0] * most
        for keys in (here, done):
            for t in range(keys.shape[1]):
                wanted &= keys[begin:end, t, None] != keys[None, :, t]
        if not wanted.any():
            continue
        if g == 2:
            both = np.full((2, 2), len(np.intersect1d(sets[0], sets[1], assume_unique=True)), np.int64)
        else:
            owners = owners or Owners(sets)
            both = owners.common(begin, end)
        union = np.maximum(1, least + most - both)
        link = wanted & (threshold[1] * both >= threshold[0] * union)
        if link.any():
            yield begin, end, link, both / union


class _Roots:
    """Which members of a task are joined by links."""

    def __init__(self, n: int):
        self.to = np.arange(n)

    def settle(self) -> np.ndarray:
        while True:
            again = self.to[self.to]
            if (again == self.to).all():
                return again
            self.to = again

    def join(self, member: int, others: np.ndarray) -> None:
        found = {self._root(x) for x in np.unique(self.to[others]).tolist()} | {self._root(member)}
        self.to[list(found)] = min(found)

    def _root(self, x: int) -> int:
        while self.to[x] != x:
            x = self.to[x]
        return int(x)


def _compare(trees: int, depth: int, before: int | None, threshold: tuple[int, int]):
    """Runs over rows sorted by task; a row for each class that has a link in the task."""
    heads = ["rep", "h1", "h2", "copies", "block"]

    def finish(tree: int, parts: list[tuple]) -> pa.RecordBatch | None:
        head = np.concatenate([p[0] for p in parts])
        order = np.lexsort((head[:, 2], head[:, 1], head[:, 0]))
        head = head[order]
        labels = np.concatenate([p[1] for p in parts])[order].view(_U)
        held = [x for p in parts for x in p[2]]
        sets = [np.frombuffer(held[i], _U) for i in order]
        roots, links, low = _Roots(len(sets)), np.zeros(len(sets), np.int64), np.ones(len(sets))
        for begin, end, link, alike in _block_links(tree, depth, before, labels, head[:, 4], sets, threshold):
            roots.to = roots.settle()
            links[begin:end] = link @ head[:, 3]
            low[begin:end] = np.where(link, alike, 1.0).min(axis=1)
            for k in np.flatnonzero(link.any(axis=1)).tolist():
                roots.join(begin + k, np.flatnonzero(link[k]))
        has = np.flatnonzero(links)
        if not len(has):
            return None
        # each joined group as a tree of small degree, so that no class gets many edges
        root = roots.settle()[has]
        by = np.argsort(root, kind="stable")
        first = np.searchsorted(root[by], root[by])
        place = np.arange(len(by)) - first
        up = np.empty(len(by), int)
        up[by] = by[first + np.maximum(0, place - 1) // 16]
        own, other = head[has, :3], head[has[up], :3]
        cols = [own[:, 0], own[:, 1], own[:, 2], links[has], other[:, 0], other[:, 1], other[:, 2]]
        return pa.RecordBatch.from_arrays([*[pa.array(np.ascontiguousarray(c)) for c in cols], pa.array(low[has])], names=["rep", "h1", "h2", "links", "rep2", "h1b", "h2b", "low"])

    def run(batches):
        now, parts = None, []
        for b in batches:
            if not b.num_rows:
                continue
            task = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(5)], 1)
            head = np.stack([b.column(5 + i).to_numpy(zero_copy_only=False) for i in range(len(heads))], 1)
            labels = b.column(10).flatten().to_numpy(zero_copy_only=False).reshape(-1, 2 * trees)
            sets = b.column(11).to_pylist()
            cuts = [0, *(np.flatnonzero((task[1:] != task[:-1]).any(axis=1)) + 1).tolist(), len(task)]
            for x, y in zip(cuts, cuts[1:]):
                key = tuple(task[x].tolist())
                if now is not None and key != now:
                    out = finish(int(now[0]), parts)
                    parts = []
                    if out is not None:
                        yield out
                now = key
                parts.append((head[x:y], labels[x:y], sets[x:y]))
        if parts:
            out = finish(int(now[0]), parts)
            if out is not None:
                yield out

    return run


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


_CLASS = ["rep", "h1", "h2"]


def entries(classes: DataFrame, trees: int, floor: int) -> DataFrame:
    """The tries: a row a class and tree, sorted by tree and label, without classes that are alone under the shortest prefix."""
    every = F.array(*[F.struct(F.lit(t).cast("long").alias("tree"), F.col(f"a{t}").alias("a0"), F.col(f"b{t}").alias("b0")) for t in range(trees)])
    placed = classes.where("n > 0").select(*_CLASS, "n", F.explode(every).alias("p")).select(*_CLASS, "n", "p.*")
    placed = placed.select("*", *[c.alias(n) for c, n in zip(_prefix(0, floor), ("p1", "p2"))])
    shared = placed.groupBy("tree", "p1", "p2").agg(F.count(F.lit(1)).alias("g")).where("g > 1").drop("g")
    held = placed.join(_small(stored(shared, "shared-nodes")), ["tree", "p1", "p2"], "left_semi").drop("p1", "p2")
    return stored(held.repartitionByRange("tree", "a0", "b0", "h1").sortWithinPartitions("tree", "a0", "b0", "h1"), "tries")


def links(docs: DataFrame, classes: DataFrame, tries: DataFrame, depth: int, before: int | None, held: DataFrame | None, trees: int = TREES, threshold: tuple[int, int] = THRESHOLD, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """What the nodes of one depth add to those of the depth before: rows (class, its links there in documents, an edge, the least similarity), and the sets read so far."""
    at = tries.select("*", *[c.alias(n) for c, n in zip(_prefix(0, depth), ("p1", "p2"))])
    if before:
        at = at.select("*", F.struct(*_prefix(0, before)).alias("was"))
        news = [F.min("was").alias("w1"), F.max("was").alias("w2")]
    else:
        news = [F.lit(0).alias("w1"), F.lit(1).alias("w2")]
    nodes = at.groupBy("tree", "p1", "p2").agg(F.count(F.lit(1)).alias("g"), F.sum(8 * F.col("n") + 16 * trees).alias("size"), F.sum(F.xxhash64("h1", "h2") % (1 << 40)).alias("s"), F.bit_xor(F.xxhash64("h2", "h1")).alias("x"), *news).where("g > 1 and w1 <> w2")
    nodes = nodes.groupBy("g", "s", "x").agg(F.min(F.struct("tree", "p1", "p2", "size")).alias("first")).select("first.*", "g")
    nodes = stored(nodes.select("tree", "p1", "p2", F.greatest(F.ceil(F.col("g") / BLOCK_ROWS), F.ceil(F.col("size") / BLOCK_BYTES)).alias("blocks")), "nodes")
    members = stored(at.join(_small(nodes), ["tree", "p1", "p2"]).select("tree", "p1", "p2", "blocks", *_CLASS), "members")
    need = members.select(*_CLASS).distinct()
    if held is not None:
        need = need.join(held.select(*_CLASS), _CLASS, "left_anti")
    need = stored(need, "needed")
    sets = _sets(_keyed(docs).join(_small(need.select(F.col("rep").alias("d")).distinct()), "d", "left_semi"), width)
    own = need.join(classes.select(*_CLASS, "copies", F.array(*_halves(trees)).alias("labels")), _CLASS)
    full = stored(own.join(sets.withColumnRenamed("d", "rep"), _CLASS).dropDuplicates(_CLASS), "sets")
    if held is not None:
        full = full.unionByName(held)
    dealt = members.withColumn("block", F.pmod(F.xxhash64("h2", "h1"), "blocks"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    task = ["tree", "p1", "p2", "lo", "hi"]
    tasks = dealt.select("tree", "p1", "p2", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), *_CLASS, "block")
    rows = tasks.join(full, _CLASS).select(*task, *_CLASS, "copies", "block", "labels", "shingles")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(parts, *task).sortWithinPartitions(*task)
    compare = _compare(trees, depth, before, threshold)
    found = ordered.mapInArrow(lambda batches: returned(compare(batches)), "rep long, h1 long, h2 long, links long, rep2 long, h1b long, h2b long, low double")
    found = stored(found, "links")
    forget(nodes, members)
    return found, full


def search(docs: DataFrame, classes: DataFrame, trees: int = TREES, threshold: tuple[int, int] = THRESHOLD, recall: float = RECALL, width: int = WIDTH) -> tuple[DataFrame, list[int]]:
    """All links found, and the prefixes' depths that were matched in turn."""
    floor = depth_for(threshold, trees, DEPTH, recall)
    tries = entries(classes, trees, floor)
    found, sets, depths = None, None, []
    depth, before = DEPTH, None
    while True:
        more, sets = links(docs, classes, tries, depth, before, sets, trees, threshold, width)
        found = more if found is None else found.unionByName(more)
        depths.append(depth)
        if depth <= floor:
            break
        low = found.agg(F.min("low")).first()[0]
        # without any link there is nothing to go by but the threshold
        wanted = max((d for d in range(floor, depth + 1) if low is not None and chance(low, d, trees) >= SURE), default=floor)
        if wanted == depth:
            break
        depth, before = wanted, depth
    forget(tries, sets)
    return found, depths


def _judged(docs: DataFrame, trees: int = TREES, threshold: tuple[int, int] = THRESHOLD, recall: float = RECALL, width: int = WIDTH) -> DataFrame:
    """One row a document: d, r, the least d of its class (null: its own), two hashes that tell the class from others of that d, and its links."""
    signed = stored(signatures(docs.select("doc_id", "text"), trees, width), "signatures")
    kept = signed.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("d").alias("rep"), F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in _halves(trees)])
    classes = stored(kept, "classes")
    found, _ = search(docs, classes, trees, threshold, recall, width)
    node = F.struct("rep", "h1", "h2")
    grouped = components(found.select(node.alias("a"), F.struct(F.col("rep2").alias("rep"), F.col("h1b").alias("h1"), F.col("h2b").alias("h2")).alias("b")))
    sums = found.groupBy("rep", "h1", "h2").agg(F.sum("links").alias("links"))
    near = sums.join(grouped.select("node.*", F.col("label.rep").alias("least"), F.col("label.h1").alias("c1"), F.col("label.h2").alias("c2")), ["rep", "h1", "h2"])
    copied = classes.where("copies > 1").select("rep", "h1", "h2", "copies")
    told = copied.join(near, ["rep", "h1", "h2"], "full").select("h1", "h2", F.coalesce("least", "rep").alias("least"), F.coalesce("c1", "h1").alias("c1"), F.coalesce("c2", "h2").alias("c2"), (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("links"))
    out = signed.where("n > 0").select("d", "r", "h1", "h2").join(_small(stored(told, "told")), ["h1", "h2"], "left").select("d", "r", "least", "c1", "c2", "links")
    none = [F.lit(None).cast("long").alias(c) for c in ("least", "c1", "c2")]
    return out.unionByName(signed.where("n = 0").select("d", "r", *none, F.lit(0).cast("long").alias("links")))


def near_duplicates(docs: DataFrame, trees: int = TREES, threshold: tuple[int, int] = THRESHOLD, recall: float = RECALL, width: int = WIDTH) -> DataFrame:
    """One row a document: class_id, the least doc_id of its class, and n_links, the documents that it is linked to."""
    whole = lambda c: F.nullif(c, F.lit(_NULL))
    out = _judged(docs, trees, threshold, recall, width)
    return out.select(whole(F.col("d")).alias("doc_id"), whole(F.coalesce("least", "d")).alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, trees: int = TREES, threshold: tuple[int, int] = THRESHOLD, recall: float = RECALL, width: int = WIDTH) -> DataFrame:
    """The documents without near-duplicates of another one: of each class the one with the least doc_id stays.

    Rows are told apart by doc_id and text: of repeated rows one stays, and rows
    of one doc_id with different texts are judged each by its own. Where several
    texts of a class share its least doc_id, the one with the least hash stays.
    """
    judged = _judged(docs, trees, threshold, recall, width).groupBy("d", "r")
    rows = stored(judged.agg(F.min("least").alias("least"), F.min("c1").alias("c1"), F.min("c2").alias("c2"), F.count(F.lit(1)).alias("rows")), "judged")
    heads = rows.where("least = d").select("r", "least", "c1", "c2")
    shared = heads.groupBy("least", "c1", "c2").agg(F.min("r").alias("stays"), F.count(F.lit(1)).alias("texts")).where("texts > 1")
    tied = heads.join(_small(stored(shared, "shared")), ["least", "c1", "c2"]).where("r <> stays").select(F.col("least").alias("d"), "r")
    gone = rows.where("least <> d").select("d", "r").unionByName(tied)
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("d"), F.xxhash64(F.col("text").cast("string")).alias("r"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    left = keyed.join(_small(gone), ["d", "r"], "left_anti")
    again = rows.where("rows > 1").select("d", "r")
    if again.isEmpty():
        return left.select("row.*")
    again = _small(again)
    once = left.join(again, ["d", "r"], "left_semi").groupBy("d", "r").agg(F.first("row").alias("row"))
    rest = left.join(again, ["d", "r"], "left_anti")
    return rest.select("row.*").unionByName(once.select("row.*"))
