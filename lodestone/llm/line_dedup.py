"""Line deduplication by a deletion-neighbourhood join.

A line (a piece between line feeds, trimmed) of at least ``min_chars`` characters
is dropped if an earlier one, in order of (doc_id, text hash, line number), is the same or
within one edit of it; the earliest stays. Whether that earlier line was itself
dropped does not matter. If ``per`` is given, the bound grows: lines are near
within an edit for every ``per`` characters of the longer one, one at least.
Shorter ones are dropped only as exact repeats, and only
from ``equal_chars`` characters on, if that is given; blank ones are left alone.

1. Equal lines are brought together by a 128-bit hash; the earliest of each stays.
2. Two lines within one edit agree in the first or the last half of the shorter
   one. A line whose half nobody shares has no neighbour and needs no variants;
   this leaves the others, without loss.
3. Those emit their deletion variants as 64-bit keys: with the place of the
   deletion and the length, which two lines of one length share just when they
   differ by a substitution there; and without the place, which a line shares
   with the shorter line that it becomes by one deletion. Positions that the
   shared half rules out are left out.
4. Equal keys are joined through the earliest line of each key: any two lines of
   a substitution key are within one edit, so no pairs need be made, and a
   deletion key has one shorter line, which is matched with the longer ones.
5. The distance of each pair that comes out is verified on the texts.
6. For the grown bound, lines that share the first or last part that edits in one
   place leave, or one of the least hashes of their runs of six
   words, are verified at their bound: with the earliest line of each key, and
   where that is not near with the earliest line of each key and length in the
   bound. So rows follow lines and keys, never pairs of a key's lines; a line is
   likely found, and missed where other lines of its length that share its parts
   stand before all that are near to it.

Cases: a null text has no lines; of repeated rows (doc_id and text equal) one
counts as the earlier, and the others lose all lines that count; a null doc_id
is the earliest; ties of doc_id go by the text's hash; an empty table gives no
rows; very long lines are handled in memory in proportion to their length; other
columns are kept by ``dedup``, whatever their names, and ignored by
``dedup_digest``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.memory import bounded, returned
from lodestone.session import forget, ship, stored

MIN_CHARS = 20
#: Words in a run, and runs a line, whose hashes are keys for lines with edits in several places.
RUN, RUNS = 6, 8
_BLANKS = " \t\n\x0b\x0c\r"
#: Characters up to which the bounded table of distances is made, and up to which lengths are told apart one by one.
SHORT, EXACT_LENGTHS = 4_096, 800
#: Key tables up to this number of rows are broadcast, at some 30 bytes each.
MOST_BROADCAST = 500_000
_PRIME = 0x9E3779B97F4A7C15
_INVERSE = pow(_PRIME, -1, 1 << 64)


def _place() -> tuple[Column, Column]:
    """A row's place: its doc_id, null as the least, and its text's hash, which tells rows of one doc_id apart."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("d"), F.xxhash64(F.col("text").cast("string")).alias("r")


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """The lines that count, each with its place and trimmed text."""
    pieces = docs.select(*_place(), F.posexplode(F.split(F.col("text").cast("string"), "\n")).alias("l", "piece"))
    return pieces.select("d", "r", "l", F.btrim("piece", F.lit(_BLANKS)).alias("t")).where(F.length("t") >= min_chars)


def _half_key(t: Column, side: str, m: Column) -> Column:
    half = (m / 2).cast("int")
    part = F.substring(t, F.lit(1), half) if side == "P" else F.right(t, half)
    return F.xxhash64(F.lit(side), m, part)


def _distinct(lines: DataFrame) -> DataFrame:
    """Each distinct line's first place, its length and its four half keys."""
    n = F.length("t")
    keyed = lines.select("d", "r", "l", F.xxhash64("t").alias("h1"), F.xxhash64(F.lit(11), F.col("t")).alias("h2"), n.alias("n"), *[_half_key(F.col("t"), s, n - k).alias(f"{s.lower()}{k}") for k in (0, 1) for s in "PS"])
    return keyed.groupBy("h1", "h2").agg(F.min(F.struct("d", "r", "l")).alias("at"), *[F.first(c).alias(c) for c in ("n", "p0", "s0", "p1", "s1")]).select("at.*", "n", "p0", "s0", "p1", "s1")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def _candidates(distinct: DataFrame) -> DataFrame:
    """The lines that share a half with another one, and which variants they need."""
    kinds = F.array(*[F.struct(F.col(c).alias("key"), F.lit(c).alias("kind")) for c in ("p0", "s0", "p1", "s1")])
    keys = distinct.select("d", "r", "l", F.explode(kinds).alias("k")).select("d", "r", "l", "k.*")
    shorter = F.col("kind").isin("p0", "s0")
    groups = keys.groupBy("key").agg(F.count(F.when(shorter, 1)).alias("a"), F.count(F.when(~shorter, 1)).alias("b")).where("a >= 2 or (a >= 1 and b >= 1)")
    used = keys.join(_small(stored(groups, "halves")), "key")
    flag = lambda kind, cond: F.coalesce(F.bool_or((F.col("kind") == kind) & cond), F.lit(False))
    return used.groupBy("d", "r", "l").agg(
        flag("p0", F.col("a") >= 2).alias("sub_p"), flag("s0", F.col("a") >= 2).alias("sub_s"), flag("p1", F.col("a") >= 1).alias("del_p"), flag("s1", F.col("a") >= 1).alias("del_s"),
        F.bool_or(shorter & (F.col("b") >= 1)).alias("short"),
    )


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.concatenate([[np.uint64(1)], np.cumprod(np.full(2 * n, _PRIME, np.uint64))])
    return _POWERS[:n]


def variants(text: str, sub_p: bool, sub_s: bool, del_p: bool, del_s: bool, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """The keys of a line's deletion variants and their roles: 0 substitution, 1 shorter line, 2 longer line."""
    c = _mix(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(_PRIME))
    n = len(c)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(c * _powers(n))])
    gone = sums[:-1] + (sums[-1] - sums[1:]) * np.uint64(_INVERSE)
    at = np.arange(n, dtype=np.uint64)
    keys, roles = [], []
    if sub_p or sub_s:
        half = n // 2
        keep = (at >= half) & sub_p | (at < n - half) & sub_s
        keys.append(_mix(gone[keep] ^ _mix(at[keep] * np.uint64(2) + np.uint64(1)) ^ _mix(np.full(keep.sum(), n, np.uint64))))
        roles.append(np.zeros(keep.sum(), np.int8))
    if del_p or del_s:
        half = (n - 1) // 2
        keep = (at >= half) & del_p | (at <= n - 1 - half) & del_s
        got = np.unique(gone[keep])
        keys.append(_mix(got ^ np.uint64((n - 1) * 2)))
        roles.append(np.full(len(got), 2, np.int8))
    if short:
        keys.append(_mix(sums[-1:] ^ np.uint64(n * 2)))
        roles.append(np.ones(1, np.int8))
    return np.concatenate(keys) if keys else np.empty(0, np.uint64), np.concatenate(roles) if roles else np.empty(0, np.int8)


def _emit(batches):
    for b in batches:
        cols = [c.to_pylist() for c in b.columns[3:]]
        d, r_, l = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        keys, roles, sizes, begin, total = [], [], [], 0, 0
        for i, row in enumerate(zip(*cols)):
            k, r = variants(*row)
            keys.append(k)
            roles.append(r)
            sizes.append(len(k))
            total += len(k)
            if total > 500_000 or i + 1 == len(cols[0]):
                own = slice(begin, i + 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(roles)), pa.array(np.repeat(d[own], sizes)), pa.array(np.repeat(r_[own], sizes)), pa.array(np.repeat(l[own], sizes).astype(np.int32))], names=["key", "role", "d", "r", "l"])
                keys, roles, sizes, begin, total = [], [], [], i + 1, 0


def _near(docs: DataFrame, distinct: DataFrame, min_chars: int) -> DataFrame:
    """The first places of lines that have an earlier one within one edit."""
    flags = stored(_candidates(distinct), "candidates")
    lines = stored(_lines(docs, min_chars).join(_small(flags), ["d", "r", "l"]).select("d", "r", "l", "t", "sub_p", "sub_s", "del_p", "del_s", "short").dropDuplicates(["d", "r", "l"]), "near-lines")
    keys = stored(lines.mapInArrow(lambda batches: returned(_emit(batches)), "key long, role byte, d long, r long, l int"), "variants")
    first = lambda role: F.min(F.when(F.col("role") == role, F.struct("d", "r", "l")))
    groups = keys.groupBy("key").agg(first(0).alias("sub"), first(1).alias("short"), first(2).alias("long"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    own = F.struct("d", "r", "l")
    before = F.when(F.col("role") == 0, F.col("sub")).when(F.col("role") == 1, F.col("long")).otherwise(F.col("short"))
    pairs = keys.join(groups, "key").select("d", "r", "l", before.alias("by"), own.alias("own")).where("by < own").select("d", "r", "l", F.col("by.d").alias("d2"), F.col("by.r").alias("r2"), F.col("by.l").alias("l2")).distinct()
    text = lines.select("d", "r", "l", "t")
    other = text.select(*[F.col(c).alias(f"{c}2") for c in ("d", "r", "l", "t")])
    both = pairs.join(text, ["d", "r", "l"]).join(other, ["d2", "r2", "l2"])
    return both.where(F.levenshtein("t", "t2", 1) >= 0).select("d", "r", "l").distinct()


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _run(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many characters are equal from each (i, j) on; blocks grow while they are equal."""
    got, open_, width = np.zeros(len(i), np.int64), np.arange(len(i)), 16
    while len(open_):
        x, y = i[open_] + got[open_], j[open_] + got[open_]
        room = np.minimum(np.minimum(len(a) - x, len(b) - y), width)
        step = np.arange(width)
        inside = step < room[:, None]
        same = (a[np.minimum(x[:, None] + step, len(a) - 1)] == b[np.minimum(y[:, None] + step, len(b) - 1)]) & inside
        n = np.where(same.all(1), width, same.argmin(1))
        got[open_] += n
        open_ = open_[(n == width)]
        width = min(width * 4, max(16, 4_000_000 // max(1, len(open_))))
    return got


def within(s: str, t: str, bound: int) -> bool:
    """Whether two texts are within so many edits of single characters."""
    a, b = _codes(s), _codes(t)
    n = min(len(a), len(b))
    unequal = np.flatnonzero(a[:n] != b[:n])
    head = int(unequal[0]) if len(unequal) else n
    unequal = np.flatnonzero(a[::-1][: n - head] != b[::-1][: n - head])
    tail = int(unequal[0]) if len(unequal) else n - head
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    m, n = len(a), len(b)
    if abs(m - n) > bound or not m or not n:
        return max(m, n) <= bound
    # each character that one has more often than the other costs an edit
    codes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    more = np.bincount(at[:m], minlength=len(codes)) - np.bincount(at[m:], minlength=len(codes))
    if max(more[more > 0].sum(), -more[more < 0].sum()) > bound:
        return False
    # reach[d + bound + 1]: the furthest row that k edits reach on diagonal d = column - row
    reach = np.full(2 * bound + 3, -2, np.int64)
    for k in range(bound + 1):
        # diagonals that k edits reach and from which the end is still in reach
        low, high = max(-k, n - m - (bound - k)), min(k, n - m + (bound - k))
        d = np.arange(low, high + 1)
        at = d + bound + 1
        row = np.zeros(1, np.int64) if k == 0 else np.maximum(np.maximum(reach[at] + 1, reach[at - 1]), reach[at + 1] + 1)
        row = np.minimum(row, np.minimum(m, n - d))
        good = (row >= 0) & (row + d >= 0)
        row = np.where(good, row, -2)
        i = row[good]
        row[good] = i + _run(a, b, i, i + d[good])
        reach[at] = row
        if low <= n - m <= high and reach[n - m + bound + 1] >= m:
            return True
    return False


#: The numbers that hold a line's counts of characters by class, eight classes in each.
_SIGNS = ("ga", "gb", "gc", "gd")


def signs(text: str, numbers: int = 2) -> tuple[int, ...]:
    """Counts of a text's characters by class, up to 255 each, packed in a power of two of numbers."""
    bits = numbers.bit_length() + 2
    counts = np.bincount((_codes(text) * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits), minlength=1 << bits)
    return tuple(np.minimum(counts, 255).astype(np.uint8).view("<i8").tolist())


def _signed(batches):
    """Lines (d, r, l, t) with their signs in place of the text."""
    for b in batches:
        got = [signs(t, len(_SIGNS)) for t in b.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], *[pa.array([g[k] for g in got], pa.int64()) for k in range(len(_SIGNS))]], names=["d", "r", "l", *_SIGNS])


def _apart(*pairs: tuple[str, str]) -> Column:
    """By how much counts by class differ in all; an edit changes this, with the difference of the lengths added, by two at most."""
    part = lambda x, k: F.shiftrightunsigned(F.col(x), 8 * k).bitwiseAND(F.lit(255))
    return sum((F.abs(part(x, k) - part(y, k)) for x, y in pairs for k in range(8)), F.lit(0))


def _close(batches):
    """The places of the lines whose texts are within their bound."""
    for b in batches:
        near = [within(*row) for row in zip(*(b.column(c).to_pylist() for c in range(3, 6)))]
        yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(near, pa.bool_())) for c in range(3)], names=["d", "r", "l"])


def _class(m: Column) -> tuple[Column, Column]:
    """The step of lengths about m, a power of two in proportion to it, and m in such steps."""
    step = F.pow(F.lit(2.0), F.greatest(F.lit(0), F.floor(F.log2(m / EXACT_LENGTHS)) + 1)).cast("int")
    return step, F.floor(m / step).cast("int")


def _band(m: Column, per: int) -> Column:
    """The band of lengths about m; those in the bound of one length lie in two bands at most."""
    return F.floor(F.log(F.greatest(m, F.lit(1))) * ((per - 2) / 2)).cast("int")


def _by_class(used: DataFrame, rest: DataFrame, per: int, columns: tuple[str, ...]) -> tuple[DataFrame, Column]:
    """The lines of ``rest``, each with the earliest lines (columns with a 2) of the classes of lengths about its bound that share a key with it.

    With the condition returned, which is best asked last, a pair of lines comes
    out once, at the least of the keys that lead to it. A key that a line has for shorter lines' steps leads to the lines that have it
    as their own only, and is told apart by its bits turned round.
    """
    whole = F.struct(*columns)
    turned = F.bitwise_not("key")
    step, of = _class(F.col("n"))
    offers = used.select(whole.alias("by"), step.alias("step"), of.alias("of"), F.explode(F.when(F.col("own"), F.array("key", turned)).otherwise(F.array("key"))).alias("key"))
    earliest = offers.groupBy("key", "step", "of").agg(F.min("by").alias("by")).groupBy("by").agg(F.collect_set("key").alias("keys2"))
    earliest = earliest.select(*[F.col(f"by.{c}").alias(f"{c}2") for c in columns], "keys2", F.explode("keys2").alias("key")).withColumn("band", _band(F.col("n2"), per))
    lines = rest.groupBy(*columns).agg(F.collect_set(F.when(F.col("own"), F.col("key")).otherwise(turned)).alias("keys"))
    spread = F.floor(F.col("n") / (per - 1)).cast("int")  # no longer line in the bound is longer than this allows
    bands = F.sequence(_band(F.col("n") - spread, per), _band(F.col("n") + spread, per))
    lines = lines.withColumn("band", F.explode(bands)).withColumn("key", F.explode("keys"))
    return lines.join(earliest, ["key", "band"]), F.col("key") == F.array_min(F.array_intersect("keys", "keys2"))


def _far_keys(n: Column, t: Column, per: int) -> Column:
    """A line's keys for the grown bound, each with whether it is the line's own step or one of shorter lines' steps.

    Of two lines whose edits lie in one place, the shorter one agrees with the
    other in its first or its last ``reach`` characters. These are cut to a step
    of a ladder, and a line takes the steps of all shorter lines in its bound.
    For edits in several places, the least hashes of the line's runs of words are
    keys too; these find a pair with a probability only.
    """
    reach = lambda m: F.greatest((m - F.floor(m / (per - 1))) / 2, F.lit(1))
    step = lambda m: F.floor(F.log2(reach(m)) * 4).cast("int")
    own = step(n)
    steps = F.sequence(F.least(step(n - F.floor(n / per)), own), own)
    cut = lambda j: F.floor(F.pow(F.lit(2.0), j / 4) + 1e-9).cast("int")
    key = lambda side, j: F.xxhash64(F.lit(side), j, F.substring(t, F.lit(1), cut(j)) if side == "P" else F.right(t, cut(j)))
    sides = [F.transform(steps, lambda j: F.struct(key(side, j).alias("key"), (j == own).alias("own"))) for side in "PS"]  # noqa: B023
    # the words are bound as a variable, so that they are made once for a line and not once for a run
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - RUN + 1), lambda i: F.xxhash64(F.slice(w, i, RUN)))
    least = lambda w: F.when(F.size(w) >= RUN, F.slice(F.sort_array(F.array_distinct(runs(w))), 1, RUNS))
    inner = F.coalesce(F.get(F.transform(F.array(F.split(t, " ")), least), F.lit(0)), F.array().cast("array<bigint>"))
    return F.concat(*sides, F.transform(inner, lambda x: F.struct(x.alias("key"), F.lit(True).alias("own"))))


def _far(docs: DataFrame, distinct: DataFrame, min_chars: int, per: int) -> DataFrame:
    """The first places of lines that have an earlier one within an edit for every ``per`` characters of the longer one."""
    place = ["d", "r", "l"]
    least = max(min_chars, 2 * per - 2)
    long = distinct.where(F.col("n") >= least).select(*place)
    texts = _lines(docs, least).join(long, place).dropDuplicates(place)
    n = F.length("t")
    keys = stored(texts.select(*place, n.alias("n"), F.explode(_far_keys(n, F.col("t"), per)).alias("k")).select(*place, "n", "k.*"), "far-keys")
    groups = keys.groupBy("key").agg(F.count(F.lit(1)).alias("all"), F.count(F.when(F.col("own"), 1)).alias("owns")).where("all > 1 and owns > 0").select("key")
    found_keys = stored(keys.join(_small(stored(groups, "far-groups")), "key"), "far-shared")
    forget(keys)
    asked = stored(found_keys.select(*place).distinct(), "far-asked")
    signed = stored(texts.join(_small(asked), place, "left_semi").select(*place, "t").mapInArrow(lambda batches: returned(_signed(batches)), "d long, r long, l int, " + ", ".join(f"{g} long" for g in _SIGNS)), "far-signs")
    used = stored(found_keys.join(_small(signed), place), "far-used")
    forget(found_keys, asked, signed)
    with_signs = (*place, "n", *_SIGNS)

    def near(pairs: DataFrame, once: Column = F.lit(True)) -> DataFrame:
        bound = F.floor(F.greatest("n", "n2") / per).cast("int")
        close = pairs.withColumn("bound", bound).where("struct(d2, r2, l2) < struct(d, r, l) and abs(n - n2) <= bound and bound > 1").where(_apart(*[(g, f"{g}2") for g in _SIGNS]) + F.abs(F.col("n") - F.col("n2")) <= 2 * F.col("bound")).where(once)
        close = stored(close.select(*place, "d2", "r2", "l2", "bound").distinct(), "far-pairs")
        ends = stored(close.select(*place).union(close.select("d2", "r2", "l2")).distinct(), "far-ends")
        text = stored(_lines(docs, least).join(_small(ends), place).dropDuplicates(place), "far-lines")
        both = close.join(text, place).join(text.select(*[F.col(c).alias(f"{c}2") for c in (*place, "t")]), ["d2", "r2", "l2"])
        brief = F.greatest(F.length("t"), F.length("t2")) <= SHORT
        short = both.where(brief).where(F.expr("levenshtein(t, t2, bound) >= 0")).select(*place)
        long = both.where(~brief).select(*place, "t", "t2", "bound").mapInArrow(lambda batches: returned(_close(batches)), "d long, r long, l int")
        found = stored(short.union(long).distinct(), "far-near")
        forget(close, ends, text)
        return found

    # one earlier line is enough, and each key's earliest settles most lines
    whole = F.struct(*with_signs)
    firsts = used.groupBy("key").agg(F.min(whole).alias("first"), F.min(F.when(F.col("own"), whole)).alias("first_own"))
    by = used.join(firsts, "key").withColumn("by", F.when(F.col("own"), F.col("first")).otherwise(F.col("first_own")))
    settled = near(by.select(*with_signs, *[F.col(f"by.{c}").alias(f"{c}2") for c in with_signs]))
    # the rest are held to the earliest line of each class of lengths in their bound that has one of their keys: rows in proportion, never pairs of a key
    rest = used.join(_small(settled), place, "left_anti")
    found = settled.union(near(*_by_class(used, rest, per, with_signs)))
    forget(used)
    return found


def kept_places(docs: DataFrame, min_chars: int = MIN_CHARS, equal_chars: int | None = None, per: int | None = None) -> DataFrame:
    """The places (d, r, l) of the lines that stay among those that count: doc_id, text hash, line number."""
    bounded(ship(docs.sparkSession))
    distinct = stored(_distinct(_lines(docs, min(min_chars, equal_chars or min_chars))), "lines")
    near = _near(docs, distinct.where(F.col("n") >= min_chars), min_chars)
    if per:
        near = near.union(_far(docs, distinct, min_chars, per)).distinct()
    return distinct.select("d", "r", "l").join(near, ["d", "r", "l"], "left_anti")


def _applied(docs: DataFrame, min_chars: int, equal_chars: int | None, per: int | None) -> DataFrame:
    """``row`` (a row of docs as a struct), ``lines`` (all of its lines) and ``left`` (those that stay)."""
    floor = min(min_chars, equal_chars or min_chars)
    kept = kept_places(docs, min_chars, equal_chars, per).groupBy("d", "r").agg(F.collect_list("l").alias("stay"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(*_place(), F.lit(True).alias("earlier"), row)
    again = stored(rows.groupBy("d", "r").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("d", "r"), "repeated")
    if not again.isEmpty():
        again = _small(again)
        # repeated rows are numbered where they are, and written, so that their numbers stay
        numbered = stored(rows.join(again, ["d", "r"], "left_semi").withColumn("at", F.monotonically_increasing_id()), "repeated-rows")
        least = numbered.groupBy("d", "r").agg(F.min("at").alias("least"))
        told = numbered.join(_small(least), ["d", "r"]).select("d", "r", (F.col("at") == F.col("least")).alias("earlier"), "row")
        rows = rows.join(again, ["d", "r"], "left_anti").unionByName(told)
    joined = rows.join(kept, ["d", "r"], "left")
    joined = joined.withColumn("lines", F.coalesce(F.split(F.col("row.text").cast("string"), "\n"), F.array().cast("array<string>")))
    stay = F.when(F.col("earlier"), F.coalesce("stay", F.array().cast("array<int>"))).otherwise(F.array().cast("array<int>"))
    # a flag for each line number
    dropped = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), stay)
    marks = F.array_sort(F.concat(F.transform(stay, lambda i: F.struct(i.alias("i"), F.lit(True).alias("s"))), F.transform(dropped, lambda i: F.struct(i.alias("i"), F.lit(False).alias("s")))))
    flags = F.when(F.size("lines") > 0, F.transform(marks, lambda m: m["s"]))
    # the flags are bound as a variable, so that they are made once for a row and not once for a line
    pick = lambda marked: F.filter("lines", lambda x, i: (F.length(F.btrim(x, F.lit(_BLANKS))) < floor) | F.coalesce(F.get(marked, i), F.lit(False)))
    return joined.select("row", "lines", F.get(F.transform(F.array(flags), pick), F.lit(0)).alias("left"))


def dedup(docs: DataFrame, min_chars: int = MIN_CHARS, equal_chars: int | None = None, per: int | None = None) -> DataFrame:
    """The documents with repeated lines taken out; n_chars, if there, follows the text.

    A document of which no word is left goes; one that had none stays as it is.
    """
    done = _applied(docs, min_chars, equal_chars, per)
    changed = F.size("left") < F.size("lines")
    text = F.array_join("left", "\n")
    done = done.where(~changed | (F.length(F.btrim(text, F.lit(_BLANKS))) > 0))
    put = {"text": F.when(changed, text).otherwise(F.col("row.text")), "n_chars": F.when(changed, F.length(text).cast("long")).otherwise(F.col("row.n_chars") if "n_chars" in docs.columns else F.lit(None))}
    return done.select(*[put[c].alias(c) if c in put else F.col(f"row.`{c}`") for c in docs.columns])


def dedup_digest(docs: DataFrame, min_chars: int = MIN_CHARS, equal_chars: int | None = None, per: int | None = None) -> DataFrame:
    """One row a document: its lines, how many of them were dropped, and the hash of what is left."""
    d = _applied(docs.select("doc_id", "text"), min_chars, equal_chars, per)
    return d.select(
        F.col("row.doc_id").cast("long").alias("doc_id"), F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("left")).cast("long").alias("n_dropped"),
        F.md5(F.array_join("left", "\n").cast("binary")).alias("left_md5"),
    )
