"""From candidate buckets to classes: union-find over links, kept in tables.

Near-duplicate operators give members to buckets. ``link_buckets`` tests members of a
bucket and joins what is alike, without listing all pairs of a bucket:

1. every bucket has a leader, chosen by an order of its own, and each member is
   tested against it; members of one large group of copies so meet many leaders
   and become one class in one pass over the buckets;
2. a leader that is unlike two members says nothing about them. Buckets of three and
   more that still hold several classes are compared inside tasks: members of the
   bucket's largest class and the others are dealt to chunks of bounded size, a task
   gets the texts of one pair of chunks and returns a spanning forest of what it finds
   alike between classes. No pair becomes a row, members of the largest class are not
   compared with each other, and of buckets with the same members one is compared.

Where most buckets hold members that only look alike, ``shared_members`` and ``plausible``
leave them out first, without their texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import arrays
from loomgraph.llm.tables import Scratch

#: Texts to (row, hash) of their elements.
Shingles = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]

#: Most members and characters of a chunk (one member at least) that meet another chunk in a task.
MEMBERS, CHARS = 4096, 1 << 22
#: Up to this many rows are compared pair by pair, those of more than FEW by one matrix.
SMALL, FEW = 48, 6
#: Rows whose shared elements are counted together, and cells of a 0/1 matrix.
BLOCK, CELLS = 256, 1 << 24
#: Members of a bucket from which on it is not searched for plausible pairs.
CROWD = 256
#: 64-bit words of a sketch: the parity of a set's elements in each of 256 cells; of a wide one, in 1,024.
WORDS, WIDE = 4, 16
SKETCH, WIDE_SKETCH = (["size", *(f"s{k}" for k in range(n))] for n in (WORDS, WIDE))
#: Bits of the bitmap that keeps rows nobody needs out of a shuffle.
MARKS = 1 << 23


def marks(ids: DataFrame, column: str) -> np.ndarray:
    """A bitmap of fixed size in which the hash of every id is marked."""
    bit = F.pmod(F.xxhash64(column), F.lit(MARKS))
    words = ids.select(F.shiftright(bit, 6).cast("int").alias("w"), F.expr("1L").alias("one"), (bit % 64).cast("int").alias("b"))
    found = words.groupBy("w").agg(F.expr("bit_or(shiftleft(one, b))").alias("bits")).toArrow()  # MARKS / 64 rows at most
    out = np.zeros(MARKS // 64, np.int64)
    out[found["w"].to_numpy()] = found["bits"].to_numpy()
    return out


def marked(rows: DataFrame, column: str, bitmap: np.ndarray) -> DataFrame:
    """The rows whose id may be marked: all that are, and few others while the bitmap is not full.

    A join with the ids themselves decides; this keeps most other rows out of its shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(batch.num_columns - 1).to_numpy()
            keep = (bitmap[at >> 6] >> (at & 63)) & 1
            yield batch.select(batch.schema.names[:-1]).filter(pa.array(keep.astype(bool)))

    return rows.withColumn("_mark", F.pmod(F.xxhash64(column), F.lit(MARKS))).mapInArrow(run, rows.schema)


def _runs(bucket: np.ndarray) -> np.ndarray:
    """Number of the run that each place belongs to."""
    return np.cumsum(np.concatenate(([0], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)


def _shared(batches: Iterator[pa.RecordBatch], crowd: int) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition whose bucket has other members, once each.

    ``crowded`` are those of large buckets, and of the first and the last, which may go on
    in the partitions beside this one.
    """

    def rows(bucket: np.ndarray, id_: np.ndarray, crowded: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(bucket), pa.array(id_), pa.array(crowded)], names=["bucket", "id", "crowded"])

    held = np.zeros((2, 0), np.int64)  # the last run so far, or the end of it if it is large
    first, large = None, False
    for batch in batches:
        both = np.concatenate((held, np.stack([batch.column(c).to_numpy() for c in range(2)])), axis=1)
        new = np.ones(both.shape[1], bool)
        new[1:] = (both[:, 1:] != both[:, :-1]).any(axis=0)
        both = both[:, new]
        if not both.shape[1]:
            continue
        first = both[0, 0] if first is None else first
        run = _runs(both[0])
        many = np.bincount(run)[run]
        crowded = (many >= crowd) | (both[0] == first)
        if large:
            crowded |= run == 0
        last = run == run[-1]
        # Of a large run that goes on, one row waits, to be known again.
        wait = last.copy()
        if crowded[-1]:
            wait[:-1] = False
        out = ~wait & (crowded | (many > 1))
        yield rows(both[0, out], both[1, out], crowded[out])
        large, held = bool(crowded[-1]), both[:, wait]
    if held.shape[1]:
        yield rows(held[0], held[1], np.ones(held.shape[1], bool))


def shared_members(members: DataFrame) -> DataFrame:
    """(bucket, id, crowded) of the members whose bucket has others.

    Members are dealt by ranges of bucket and id, so a large bucket is spread over tasks.
    Nothing is held but a run of fewer than ``CROWD`` rows. A few single members may stay.
    """
    ranged = members.select("bucket", "id").repartitionByRange("bucket", "id").sortWithinPartitions("bucket", "id")
    return ranged.mapInArrow(lambda it: _shared(it, CROWD), "bucket long, id long, crowded boolean")


def sketches(rows: np.ndarray, hashes: np.ndarray, many: int, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(number of different elements, sketch) of each set, given as (row, hash)."""
    cells = 64 * words  # a power of two
    bits = max(1, many.bit_length())  # of the row; the upper bits of the hash follow
    key = np.sort((rows.astype(np.uint64) << np.uint64(64 - bits)) | (hashes >> np.uint64(bits)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    key = key[new]
    row = (key >> np.uint64(64 - bits)).astype(np.int64)
    cell = ((key >> np.uint64(65 - bits - cells.bit_length())) & np.uint64(cells - 1)).astype(np.int64)
    odd = (np.bincount(row * cells + cell, minlength=many * cells) & 1).astype(np.uint8)
    return np.bincount(row, minlength=many), np.packbits(odd.reshape(many, cells), axis=1).view(np.int64)


def _partners(bucket: np.ndarray, size: np.ndarray, words: np.ndarray, least: float) -> np.ndarray:
    """Whether a row may be alike another one of its bucket; equal buckets follow each other.

    Sets of Jaccard similarity t differ in (1 - t) / (1 + t) of the sum of their sizes at
    most, and a cell's parity differs only if they do. Two elements may count as one, as
    sketches keep only some bits of a hash: hence the 1 and the 2.
    """
    found = np.zeros(len(bucket), bool)
    left, step = np.arange(len(bucket)), 1
    while len(left):
        left = left[left + step < len(bucket)]
        left = left[bucket[left] == bucket[left + step]]
        right = left + step
        a, b = size[left], size[right]
        near = np.minimum(a, b) + 1 >= least * np.maximum(a, b)
        x, y = left[near], right[near]
        apart = np.bitwise_count(words[x] ^ words[y]).sum(axis=1, dtype=np.int64)
        good = apart <= (1 - least) / (1 + least) * (size[x] + size[y]) + 2
        found[x[good]] = found[y[good]] = True
        step += 1
    return found


def _plausible(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def settle(table: pa.Table) -> pa.RecordBatch:
        bucket, id_, size, *words = (column.to_numpy() for column in table.columns)
        keep = _partners(bucket, size, np.stack(words, axis=1).view(np.uint64), least)
        return pa.record_batch([pa.array(bucket[keep]), pa.array(id_[keep]), pa.array(np.zeros(keep.sum(), bool))], names=["bucket", "id", "crowded"])

    for batch in batches:
        if not batch.num_rows:
            continue
        bucket = batch.column(0).to_numpy()
        begin = int(np.argmax(bucket == bucket[-1]))  # the last bucket may go on
        if begin or (held and held[-1].column(0)[0].as_py() != bucket[0]):
            yield settle(pa.Table.from_batches([*held, batch.slice(0, begin)]))
            held = []
        held.append(batch.slice(begin))
    if held:
        yield settle(pa.Table.from_batches(held))


def plausible(shared: DataFrame, sketched: DataFrame, least: float) -> DataFrame:
    """``shared`` (bucket, id, crowded) without members that no other one of the bucket can be alike.

    ``sketched`` has the columns id, size and the words of a sketch once for each id. Members of crowded buckets stay.
    """
    small = shared.where("not crowded").join(sketched, "id").select("bucket", "id", *sketched.columns[1:])
    small = small.repartition("bucket").sortWithinPartitions("bucket")
    return small.mapInArrow(lambda it: _plausible(it, least), "bucket long, id long, crowded boolean").union(shared.where("crowded"))


def less_crowded(shared: DataFrame) -> DataFrame:
    """``shared`` (bucket, id, crowded), of whose buckets only those of more than MEMBERS members stay crowded.

    What one task compares with texts it also searches for plausible pairs: n^2 popcounts at most.
    """
    few = shared.where("crowded").groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") <= MEMBERS)
    few = few.select("bucket", F.lit(True).alias("few"))
    return shared.join(few, "bucket", "left").select("bucket", "id", (F.col("crowded") & F.col("few").isNull()).alias("crowded"))


def union_find(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b) -> (id, root) for every id that has a link; the root is the least id of its class.

    Each round hooks every root to the neighbouring root with the least hash and
    halves the paths; hash order keeps chains short, so the rounds grow with the
    logarithm of the input. The state is a written table in every round.
    """
    first = scratch.put("edges0", links.select(F.col("a").alias("x"), F.col("b").alias("y")).where("x <> y").distinct())
    edges, jumps = first, []
    while not edges.isEmpty():
        done = len(jumps)
        both = edges.union(edges.select("y", "x"))
        rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
        near = both.groupBy("x").agg(F.min(rank("y")).alias("y"))
        hook = near.select("x", F.least(F.col("y"), rank("x"))["v"].alias("up"))
        above = hook.select(F.col("x").alias("up"), F.col("up").alias("top"))
        jump = scratch.put(f"jump{done}", hook.join(above, "up").select("x", "top"))
        jumps.append(jump)
        of = lambda c, jump=jump: jump.select(F.col("x").alias(c), F.col("top").alias("t" + c))
        left = edges.join(of("x"), "x").join(of("y"), "y").select(F.col("tx").alias("x"), F.col("ty").alias("y"))
        edges = scratch.put(f"edges{done + 1}", left.where("x <> y").distinct())
        if done:
            scratch.drop(f"edges{done}")
    state = first.select(F.col("x").alias("id")).union(first.select(F.col("y").alias("id"))).distinct().select("id", F.col("id").alias("root"))
    for jump in jumps:
        state = state.join(jump.withColumnRenamed("x", "root"), "root", "left").select("id", F.coalesce("top", "root").alias("root"))
    least = state.groupBy("root").agg(F.min("id").alias("least"))
    result = scratch.put("classes", state.join(least, "root").select("id", F.col("least").alias("root")))
    scratch.drop("edges0", f"edges{len(jumps)}", *[f"jump{k}" for k in range(len(jumps))])
    return result


def sorted_sets(row: np.ndarray, hashes: np.ndarray, many: int) -> list[np.ndarray]:
    """The different elements of each set, given as (row, hash), in order."""
    if (row[1:] < row[:-1]).any():
        order = np.argsort(row, kind="stable")
        row, hashes = row[order], hashes[order]
    bounds = np.searchsorted(row, np.arange(many + 1)).tolist()
    out = []
    for low, high in zip(bounds, bounds[1:], strict=False):
        own = np.sort(hashes[low:high])
        new = np.ones(len(own), bool)
        np.not_equal(own[1:], own[:-1], out=new[1:])
        out.append(own[new])
    return out


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements two sorted sets share."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    return int(np.count_nonzero(b.take(b.searchsorted(a), mode="clip") == a))


def _all_common(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of a few sets share, by products of 0/1 matrices."""
    n = len(sets)
    rows = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, holders = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(holders > 1) - 1
    several = (holders > 1)[column]
    rows, column = rows[several], number[column[several]]
    step, out = CELLS // n, np.zeros((n, n), np.float64)
    for first in range(0, int((holders > 1).sum()), step):
        part = (column >= first) & (column < first + step)
        matrix = np.zeros((n, int(column[part].max()) - first + 1), np.float32)
        matrix[rows[part], column[part] - first] = 1
        out += matrix @ matrix.T
    return out


def _shared_counts(sets: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(row, how many elements it shares with each row), row by row.

    Elements that many rows hold are counted by products of 0/1 matrices, the others by the
    list of rows that hold them.
    """
    n = len(sets)
    rows = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, holders = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = holders > n // 8
    dense = np.flatnonzero(common)
    number = np.cumsum(common) - 1
    order = np.argsort(column, kind="stable")
    ends = np.concatenate(([0], np.cumsum(holders)))
    sorted_rows = rows[order]
    bounds = np.searchsorted(rows, np.arange(n + 1))
    step = max(1, CELLS // n)
    at_dense = common[column]
    for low in range(0, n, BLOCK):
        high = min(n, low + BLOCK)
        shared = np.zeros((high - low, n), np.float32)
        for first in range(0, len(dense), step):
            part = at_dense & (number[column] >= first) & (number[column] < first + step)
            matrix = np.zeros((n, min(step, len(dense) - first)), np.float32)
            matrix[rows[part], number[column[part]] - first] = 1
            shared += matrix[low:high] @ matrix.T
        for row in range(low, high):
            own = column[bounds[row] : bounds[row + 1]]
            own = own[~common[own] & (holders[own] > 1)]
            if len(own):
                shared[row - low] += np.bincount(np.concatenate([sorted_rows[ends[c] : ends[c + 1]] for c in own]), minlength=n)
            yield row, shared[row - low]


def forest(sets: list[np.ndarray], roots: np.ndarray, sides: np.ndarray | None, least: float) -> list[tuple[int, int]]:
    """Pairs of rows that join different classes: their sorted sets have Jaccard similarity ``least``.

    ``sides`` restricts the comparison to rows of different sides.
    """
    n, found = len(sets), []
    comp = np.unique(roots, return_inverse=True)[1]
    sizes = np.array([len(s) for s in sets])
    if n > SMALL:
        for row, both in _shared_counts(sets):
            alike = (comp != comp[row]) & (both >= least * (sizes + sizes[row] - both.astype(np.float64)))
            if sides is not None:
                alike &= sides != sides[row]
            for other in np.flatnonzero(alike).tolist():
                if comp[other] != comp[row]:
                    found.append((row, other))
                    comp[comp == comp[other]] = comp[row]
        return found
    comp = comp.tolist()
    counts = _all_common(sets).tolist() if n > FEW else None
    count = sizes.tolist()
    for x in range(n):
        for y in range(x + 1, n):
            if comp[x] == comp[y] or (sides is not None and sides[x] == sides[y]) or min(count[x], count[y]) < least * max(count[x], count[y]):
                continue
            both = counts[x][y] if counts else common(sets[x], sets[y])
            if both >= least * (count[x] + count[y] - both):
                found.append((x, y))
                old, new = comp[y], comp[x]
                comp = [new if c == old else c for c in comp]
    return found


def _compare(batches: Iterator[pa.RecordBatch], shingles: Shingles, least: float) -> Iterator[pa.RecordBatch]:
    """Forests of the groups (bucket, i, j), whose rows follow each other."""
    held: list[pa.RecordBatch] = []

    def settle(table: pa.Table) -> pa.RecordBatch:
        key = np.stack([table[c].to_numpy() for c in ("bucket", "i", "j")])
        starts = np.flatnonzero(np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(axis=0))))
        ids, roots, sides = (table[c].to_numpy() for c in ("id", "root", "side"))
        texts, out = table["text"].combine_chunks(), []
        _, offsets = arrays.utf8(texts)
        sets: list[np.ndarray] = []
        for low, high in arrays.slices(offsets):
            sets += sorted_sets(*shingles(texts.slice(low, high - low)), high - low)
        for low, high in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows], strict=True):
            own = None if key[1, low] == key[2, low] else sides[low:high]
            out += [(ids[low + x], ids[low + y]) for x, y in forest(sets[low:high], roots[low:high], own, least)]
        both = np.array(out, np.int64).reshape(-1, 2)
        return pa.record_batch([pa.array(both.min(axis=1, initial=2**63 - 1)), pa.array(both.max(axis=1, initial=-(2**63)))], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        last = [batch.column(c)[batch.num_rows - 1].as_py() for c in range(3)]
        same = np.logical_and.reduce([batch.column(c).to_numpy() == last[c] for c in range(3)])
        begin = batch.num_rows - int(same.sum())  # the last group may go on in the next batch
        before = [held[-1].column(c)[0].as_py() for c in range(3)] if held else last
        if begin or before != last:
            yield settle(pa.Table.from_batches([*held, batch.slice(0, begin)]))
            held = []
        held.append(batch.slice(begin))
    if held:
        yield settle(pa.Table.from_batches(held))


def compare_open(placed: DataFrame, texts: DataFrame, shingles: Shingles, least: float) -> DataFrame:
    """Links (a, b) between classes that share a bucket of ``placed`` (bucket, id, root, chars)."""
    one = placed.groupBy("bucket", "root").agg(
        F.count("*").alias("n"),
        F.sum("chars").alias("chars"),
        F.bit_xor(F.xxhash64("id")).alias("h1"),
        F.bit_xor(F.xxhash64("id", F.lit(1))).alias("h2"),
    )
    most = F.max(F.struct("n", "chars", "root"))
    stats = one.groupBy("bucket").agg(
        most.alias("main"), F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2")
    )
    # Two members have met: one of them led.
    stats = stats.where((F.col("main.n") < F.col("n")) & (F.col("n") > 2))
    stats = stats.groupBy("n", "chars", "h1", "h2").agg(F.min("bucket").alias("bucket"), F.min("main").alias("main"))
    chunks = lambda n, chars: F.ceil(F.greatest(n / MEMBERS, chars / CHARS)).cast("int")
    whole = (F.col("n") <= MEMBERS) & (F.col("chars") <= CHARS)
    main = F.when(whole, 1).otherwise(chunks(F.col("main.n"), F.col("main.chars")))
    rest = F.when(whole, 0).otherwise(chunks(F.col("n") - F.col("main.n"), F.col("chars") - F.col("main.chars")))
    stats = stats.select("bucket", F.col("main.root").alias("first"), main.alias("c1"), rest.alias("c2"))
    rows = placed.join(stats, "bucket")
    leads, deal = (F.col("root") == F.col("first")) & (F.col("c2") > 0), F.xxhash64("id", F.lit(2))
    side = F.when(F.col("c2") == 0, 0).when(leads, F.pmod(deal, F.col("c1"))).otherwise(F.col("c1") + F.pmod(deal, F.col("c2"))).cast("int")
    peers = F.when(F.col("c2") == 0, F.array(F.lit(0))).otherwise(F.sequence(F.when(leads, F.col("c1")).otherwise(0), F.col("c1") + F.col("c2") - 1))
    rows = rows.select("bucket", "id", "root", side.alias("side"), peers.alias("peers"))
    rows = rows.withColumn("peer", F.explode("peers"))
    rows = rows.select("bucket", F.least("side", "peer").alias("i"), F.greatest("side", "peer").alias("j"), "id", "root", "side")
    given = rows.join(texts, "id").select("bucket", "i", "j", "id", "root", "side", "text")
    given = given.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return given.mapInArrow(lambda it: _compare(it, shingles, least), "a long, b long")


def link_buckets(
    members: DataFrame, verify: Callable[[DataFrame], DataFrame], texts: Callable[[], DataFrame], shingles: Shingles, least: float, scratch: Scratch
) -> DataFrame:
    """Classes (id, root) of ``members`` (bucket long, id long) for every id with a link.

    ``verify`` takes distinct pairs (a, b) and returns those of Jaccard similarity ``least``;
    after its first call ``texts`` gives (id, text) of every member that shares a bucket, and
    ``shingles`` takes such texts and returns (row, hash) of their elements.
    """
    # The leader has the least id under an order that each bucket has for itself.
    order = F.col("id").bitwiseXOR(F.col("bucket"))
    leaders = members.groupBy("bucket").agg(F.min(order).alias("low"), F.max(order).alias("high")).where("low <> high")
    leaders = scratch.put("leaders", leaders.select("bucket", F.col("low").bitwiseXOR(F.col("bucket")).alias("a")))
    shared = scratch.put("shared", members.join(leaders, "bucket").select("bucket", "id", "a").distinct())
    scratch.drop("leaders")
    pairs = shared.where("id <> a").select(F.least("id", "a").alias("a"), F.greatest("id", "a").alias("b")).distinct()
    tested = scratch.put("tested", pairs)
    links = scratch.put("links", verify(tested))
    classes = union_find(links, scratch)
    scratch.drop("tested")

    sized = texts().select("id", F.length("text").cast("long").alias("chars"))
    placed = shared.select("bucket", "id").join(classes, "id", "left").select("bucket", "id", F.coalesce("root", "id").alias("root"))
    split = placed.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("n"))
    placed = scratch.put("open", placed.join(split.where("r0 <> r1 and n > 2").select("bucket"), "bucket").join(sized, "id"))
    scratch.drop("shared")
    more = scratch.put("more", compare_open(placed, texts(), shingles, least))
    scratch.drop("open")
    if more.isEmpty():
        return classes
    scratch.drop("classes")
    return union_find(links.union(more), scratch)
