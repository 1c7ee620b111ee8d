"""N-gram Jaccard self-join by T-occurrence search with DivideSkip.

Documents of equal shingle sets form a class, and the join is between classes. Which classes may link is decided by
prefix filtering, which is exact: in any one order of all shingles, two sets with a similarity of 0.8 share one of the
first n - ceil(0.8 n) + 1 shingles of both. The order puts rare shingles first: all shingles of all documents are counted,
those in more than SHORT_LIST sets go to the end. Classes whose prefixes share a rare shingle are counted for each pair, and pairs
that cannot reach the required overlap any more are left out. Classes whose prefixes reach into the frequent shingles, so sets
of which four fifths are frequent, are tied to the first class of each such list. Connected classes form a family, and
every link lies inside a family.

Inside a family the T-occurrence search is exact: for each class the short inverted
lists of its shingles are merged, classes that reach the required overlap less the
number of long lists are kept, and the long lists are probed for them by binary
search. A large family is split into blocks: all blocks meet a few pivots, and only
classes that these do not connect are searched against the other blocks. So no task
ever holds more than two blocks, and copies are never expanded into pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if, connected_components, give_back_memory, materialize, row_slices, small_batches, text_values
from .shingles import WordHasher, mix, shingle_set

#: A shingle in more sets than this is frequent: it goes to the end of the order, and its list is tied instead of paired.
SHORT_LIST = 64
#: Bits of the table of frequent shingles, a bounded 8 MB. With more than an eighth as many, only the more frequent ones
#: count as such; two shingles may share a bit. Both change the order only, and any order is exact.
ORDER_BITS = 26
#: Shingles that a task gathers before it sends them on; a bucket is meant to hold eight times as many, or as many postings.
FLUSH = 500_000
#: Pairs of a bucket that are in memory at a time, or those of one list.
PAIRS = 250_000
#: Classes and shingles of a block; families beyond it are split.
BLOCK_CLASSES = 128
BLOCK_SHINGLES = 1_000_000
PIVOTS = 16
BROADCAST_ROWS = 500_000
#: A class of at least 1/HOT_SHARE of all rows takes its result by broadcast.
HOT_SHARE = 1000


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, text_hash -> n, cls (a hash of the whole set; null without words), hashes (the set, ascending)."""
    hasher = WordHasher()
    for batch in row_slices(batches):
        sets = [shingle_set(hasher.words(t)) for t in text_values(batch.column("text"))]
        cls = [set_id(s) if len(s) else None for s in sets]
        columns = [batch.column("id"), batch.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()), pa.array(cls, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["id", "text_hash", "n", "cls", "hashes"])


def set_id(s: np.ndarray) -> int:
    """A 64-bit name of a set of hashes."""
    return int(mix(np.array([mix(s).sum() + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def _flushes(batches: Iterator[pa.RecordBatch], flush: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(classes, their sizes, all their hashes) of many rows at a time, each class once; some FLUSH hashes each."""
    names, sizes, blobs, total = [], [], [], 0
    for batch in batches:
        cls, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cls", "n"))
        hashes = batch.column("hashes")
        for i in range(batch.num_rows):
            names.append(cls[i])
            sizes.append(n[i])
            blobs.append(np.frombuffer(hashes[i].as_buffer(), np.uint64))
            total += int(n[i])
            if total >= flush:
                yield _distinct(names, sizes, blobs)
                names, sizes, blobs, total = [], [], [], 0
    if names:
        yield _distinct(names, sizes, blobs)
    del names, sizes, blobs
    give_back_memory()


def _distinct(names: list, sizes: list, blobs: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cls, first = np.unique(np.array(names, np.int64), return_index=True)
    return cls, np.array(sizes, np.int64)[first], np.concatenate([blobs[i] for i in first.tolist()])


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)


def _name(hashes: np.ndarray, bits: int) -> np.ndarray:
    """What a shingle is counted by: its first ``bits`` bits."""
    return hashes >> np.uint64(64 - bits)


def _packed(numbers: np.ndarray) -> bytes:
    """32-bit numbers by their first, second, third and fourth bytes, compressed: small numbers take little room."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(numbers).to_bytes(4, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpacked(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:4], "little")
    planes = pa.decompress(packed[4:], decompressed_size=4 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, n).T).view("<u4").ravel()


def _spans(where: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of equal numbers."""
    cuts = np.concatenate([[0], np.nonzero(np.diff(where))[0] + 1, [len(where)]]) if len(where) else np.zeros(1, np.int64)
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))


def _slot(names: np.ndarray, order_bits: int) -> np.ndarray:
    return (mix(names) >> np.uint64(64 - order_bits)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch], low_bits: int, bits: int, flush: int) -> Iterator[pa.RecordBatch]:
    """bucket, steps, counts: the shingles of a flush, each once, as steps from one to the next, with the number of their sets."""
    for _, _, hashes in _flushes(batches, flush):
        names, counts = np.unique(_name(hashes, bits), return_counts=True)
        where, low = names >> np.uint64(low_bits), names & np.uint64((1 << low_bits) - 1)
        spans = _spans(where)
        columns = [
            pa.array([int(where[a]) for a, _ in spans], pa.int64()), pa.array([_packed(np.diff(low[a:b], prepend=np.uint64(0))) for a, b in spans], pa.binary()),
            pa.array([_packed(counts[a:b]) for a, b in spans], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["bucket", "steps", "counts"])


def _frequent(table: pa.Table, short: int, order_bits: int, low_bits: int) -> pa.Table:
    """slot, n of the shingles of a bucket that are in more than ``short`` sets."""
    low = np.concatenate([np.cumsum(_unpacked(x.as_py()).astype(np.uint64)) for x in table.column("steps")])
    counts = np.concatenate([_unpacked(x.as_py()) for x in table.column("counts")])
    order = np.argsort(low, kind="stable")
    low, starts = np.unique(low[order], return_index=True)
    totals = np.add.reduceat(counts[order].astype(np.int64), starts)
    often = totals > short
    names = low[often] | np.uint64(table.column("bucket")[0].as_py() << low_bits)
    return pa.table({"slot": pa.array(_slot(names, order_bits)), "n": pa.array(totals[often])})


def _buckets(size: int, each: int) -> int:
    """A power of two; buckets are tasks of their own, so their number grows with the input and their size does not."""
    return max(16, 1 << math.ceil(math.log2(size / each + 1)))


def _order(rows: DataFrame, shingles: int) -> tuple[bytes, int]:
    """The table of frequent shingles, a bit each, and the bits of a shingle that it looks at: so many that hardly any two are one."""
    buckets = _buckets(shingles, 8 * FLUSH)
    bits, flush, short, order_bits = max(36, math.ceil(math.log2(shingles + 1)) + 9), FLUSH, SHORT_LIST, ORDER_BITS
    low_bits = bits - (buckets.bit_length() - 1)
    blobs = rows.where("cls is not null").select("cls", "n", "hashes").mapInArrow(lambda b: _counts(b, low_bits, bits, flush), "bucket long, steps binary, counts binary")
    often = materialize(blobs.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(lambda t: _frequent(t, short, order_bits, low_bits), "slot long, n long"), "frequent")
    level = F.floor(F.log2(F.col("n") / short)).cast("int")
    sizes = {r["level"]: r["count"] for r in often.groupBy(level.alias("level")).count().collect()}  # at most 64 rows
    at = 0
    while sum(c for k, c in sizes.items() if k >= at) > (1 << order_bits) // 8:
        at += 1
    words = often.where(level >= at).groupBy(F.bitmap_bucket_number(F.col("slot") + 1).alias("w")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("slot") + 1)).alias("b")).collect()  # 8 MB at most
    bitmap = bytearray(max(4096, 1 << (order_bits - 3)))
    for r in words:
        start = (r["w"] - 1) * 4096
        bitmap[start : start + 4096] = r["b"]
    return bytes(bitmap), bits


def _prefixes(batches: Iterator[pa.RecordBatch], bitmap: np.ndarray, bits: int, percent: int, order_bits: int, flush: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(classes, sizes, hashes, owner of each hash, positions of the rare shingles of the prefixes, their number, positions of the frequent ones)."""
    for cls, n, hashes in _flushes(batches, flush):
        slot = _slot(_name(hashes, bits), order_bits)
        often = (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1
        owner, start = np.repeat(np.arange(len(cls)), n), np.cumsum(n) - n
        seen = np.concatenate([[0], np.cumsum(often == 0)])  # rare ones up to here
        rares = seen[start + n] - seen[start]
        before = seen[:-1] - np.repeat(seen[start], n)
        # Rare ones first, each kind in the order of the hashes.
        rank = np.where(often, np.repeat(rares, n) + np.arange(len(hashes)) - np.repeat(start, n) - before, before)
        length = n - (-(-percent * n // 100)) + 1
        keep = np.nonzero(rank < length[owner])[0]
        is_rare = often[keep] == 0
        yield cls, n, hashes, owner, keep[is_rare], np.minimum(rares, length), keep[~is_rare]


def _rare_postings(prefixes: Iterator[tuple[np.ndarray, ...]], buckets: int) -> Iterator[pa.RecordBatch]:
    """bucket, tokens, classes, sizes, rares: the rare shingles of prefixes, with their sets, these sets' sizes and the number of rare shingles in their prefixes."""
    for cls, n, hashes, owner, rare, s, _ in prefixes:
        rare = rare[np.argsort(hashes[rare], kind="stable")]
        where, own, token = _bucket(hashes[rare], buckets), owner[rare], hashes[rare]
        spans = _spans(where)
        columns = [
            pa.array([int(where[a]) for a, _ in spans], pa.int64()), pa.array([token[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([cls[own[a:b]].tobytes() for a, b in spans], pa.binary()),
            pa.array([_packed(n[own[a:b]]) for a, b in spans], pa.binary()), pa.array([_packed(s[own[a:b]]) for a, b in spans], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["bucket", "tokens", "classes", "sizes", "rares"])


def _frequent_postings(prefixes: Iterator[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """token, cls of the frequent shingles of prefixes."""
    for cls, _, hashes, owner, _, _, often in prefixes:
        yield pa.RecordBatch.from_arrays([pa.array(hashes[often].view(np.int64)), pa.array(cls[owner[often]])], ["token", "cls"])


def _meetings(table: pa.Table, percent: int, short: int) -> pa.Table:
    """a, b, c, need: pairs of classes that share c rare shingles of a bucket and need that many in all; of a longer list, its first class and
    each other one, tied whatever they share otherwise (c and need are 0).

    Lists are taken some at a time, so few pairs are in memory; a pair may come more than once, and is summed up later.
    """
    raw = lambda c, t: np.concatenate([np.frombuffer(x.as_buffer(), t) for x in table.column(c)])
    token, cls = raw("tokens", np.uint64), raw("classes", np.int64)
    n, s = (np.concatenate([_unpacked(x.as_py()) for x in table.column(c)]).astype(np.int32) for c in ("sizes", "rares"))
    order = np.lexsort([cls, token])
    token, cls = token[order], cls[order]
    new = np.concatenate([[True], (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])])
    token, cls, n, s = token[new], cls[new], n[order][new], s[order][new]
    starts = np.nonzero(np.concatenate([[True], token[1:] != token[:-1]]))[0]
    lengths = np.diff(np.concatenate([starts, [len(token)]]))
    del token, order, new
    long_ones = np.repeat(lengths, lengths) > short
    heads, rest = cls[np.repeat(starts, lengths)[long_ones]], cls[long_ones]
    out = [(heads, rest, np.zeros(len(rest), np.int64), np.zeros(len(rest), np.int64))]
    keep = (lengths > 1) & (lengths <= short)
    starts, lengths = starts[keep], lengths[keep]
    part = np.cumsum(lengths * (lengths - 1) // 2) // PAIRS
    for a, b in _spans(part):
        out.append(_pairs(starts[a:b], lengths[a:b], cls, n, s, percent, short))
    columns = [pa.array(np.concatenate(x)) for x in zip(*out)]
    give_back_memory()
    return pa.table(dict(zip(("a", "b", "c", "need"), columns)))


def _pairs(starts: np.ndarray, lengths: np.ndarray, cls: np.ndarray, n: np.ndarray, s: np.ndarray, percent: int, short: int) -> tuple[np.ndarray, ...]:
    found = []
    for gap in range(1, short):  # members that stand ``gap`` apart
        some, span = starts[lengths > gap], lengths[lengths > gap] - gap
        if not len(some):
            break
        i = np.repeat(some - (np.cumsum(span) - span), span) + np.arange(int(span.sum()))
        x, y = n[i].astype(np.int64), n[i + gap].astype(np.int64)
        i = i[100 * np.minimum(x, y) >= percent * np.maximum(x, y)]
        found.append(np.stack([i, i + gap]))
    i, j = np.concatenate(found, axis=1)
    x, y = n[i].astype(np.int64), n[j].astype(np.int64)
    need = np.maximum(1, -(-percent * (x + y) // (100 + percent)) - np.maximum(x - s[i], y - s[j]))
    a, b = cls[i], cls[j]
    order = np.lexsort([b, a])
    a, b, need = a[order], b[order], need[order]
    first = np.nonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))[0] if len(a) else np.zeros(0, np.int64)
    return a[first], b[first], np.diff(np.concatenate([first, [len(a)]])), need[first]


def t_occurrence_links(queries: list[np.ndarray], index: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """(query, set) for all sets of ``index`` with 100 * intersection >= percent * union, by DivideSkip.

    ``queries`` and ``index`` hold ascending hashes, none of them empty.
    """
    sizes = np.array([len(s) for s in index])
    tokens = np.concatenate(index)
    owner = np.repeat(np.arange(len(index)), sizes)
    order = np.argsort(tokens, kind="stable")  # lists by token, owners ascending
    owner, (names, starts, lengths) = owner[order], np.unique(tokens[order], return_index=True, return_counts=True)
    longest = max(int(lengths.max()), 2)
    for q, query in enumerate(queries):
        at = np.searchsorted(names, query)
        at = at[(at < len(names)) & (names[np.minimum(at, len(names) - 1)] == query)]
        need = -(-percent * len(query) // 100)  # overlap with the smallest set that can link
        if len(at) < need:
            continue
        at = at[np.argsort(lengths[at], kind="stable")]
        n_long = min(need - 1, int(need / (0.01 * np.log2(longest) * 10 + 1)))
        short, long_ones = at[: len(at) - n_long], at[len(at) - n_long :]
        span = lengths[short]
        take = np.repeat(starts[short] - (np.cumsum(span) - span), span) + np.arange(int(span.sum()))
        found, count = np.unique(owner[take], return_counts=True)  # the merge of the short lists
        keep = (count >= need - n_long) & (100 * np.minimum(sizes[found], len(query)) >= percent * np.maximum(sizes[found], len(query)))
        found, count = found[keep], count[keep]
        for k in long_ones if len(found) else ():
            members = owner[starts[k] : starts[k] + lengths[k]]
            spot = np.searchsorted(members, found)
            count = count + ((spot < len(members)) & (members[np.minimum(spot, len(members) - 1)] == found))
        for s in found[100 * count >= percent * (sizes[found] + len(query) - count)].tolist():
            yield q, s


def _roots(n: int, links: Iterator[tuple[int, int]]) -> list[int]:
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def _search_task(table: pa.Table, percent: int) -> pa.Table:
    """Links a-b that connect what the task's classes link: of side 0 with all, if there is a side 1, else of all."""
    own = {}
    for cls, side, hashes in zip(table.column("cls").to_pylist(), table.column("side").to_pylist(), table.column("hashes").to_pylist()):
        if own.get(cls, (9,))[0] > side:
            own[cls] = (side, np.frombuffer(hashes, np.uint64))
    names = sorted(own, key=lambda c: (own[c][0], c))
    sets = [own[c][1] for c in names]
    first = sum(own[c][0] == 0 for c in names)
    roots = _roots(len(names), t_occurrence_links(sets[:first], sets, percent))
    pairs = [(names[i], names[r]) for i, r in enumerate(roots) if i != r]
    del own, sets, table
    if len(names) > BLOCK_CLASSES:
        give_back_memory()
    return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})


def _enough(met: DataFrame) -> DataFrame:
    """Pairs a, b that share as many rare shingles as they need, and those tied by a long list: what such a pair shares elsewhere does not undo the tie."""
    pairs = met.where("a <> b").groupBy("a", "b").agg(F.sum("c").alias("c"), F.max("need").alias("need"), F.min("need").alias("least"))
    return pairs.where("least = 0 or c >= need").select("a", "b")


def _neighbours(rows: DataFrame, shingles: int, percent: int) -> DataFrame:
    """Edges a, b between classes that may link, or share a frequent shingle of their prefixes with the same first class."""
    bitmap, bits = _order(rows, shingles)
    order_bits, flush, short = ORDER_BITS, FLUSH, SHORT_LIST
    shared = rows.sparkSession.sparkContext.broadcast(bitmap)  # 8 MB
    buckets = _buckets(shingles // 4, FLUSH)
    sets = rows.where("cls is not null").select("cls", "n", "hashes")
    prefixes = lambda b: _prefixes(b, np.frombuffer(shared.value, np.uint8), bits, percent, order_bits, flush)
    # Prefixes are worked out twice, since the rare postings are the larger part and need not be written.
    rare = sets.mapInArrow(lambda b: _rare_postings(prefixes(b), buckets), "bucket long, tokens binary, classes binary, sizes binary, rares binary").repartition(buckets, "bucket")
    met = rare.groupBy("bucket").applyInArrow(lambda t: _meetings(t, percent, short), "a long, b long, c long, need long")
    enough = _enough(met)
    often = materialize(sets.mapInArrow(lambda b: _frequent_postings(prefixes(b)), "token long, cls long").distinct(), "frequent")
    heads = broadcast_if(materialize(often.groupBy("token").agg(F.min("cls").alias("b")), "heads"), BROADCAST_ROWS)
    led = often.join(heads, "token").select(F.col("cls").alias("a"), "b").where("a <> b").distinct()
    return enough.union(led)


def _search(tasks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``tasks``: task, cls, side. Links a, b from each task's search.

    Where the tasks' names can be broadcast, each set is shuffled once, to its task.
    """
    filled = sets.join(broadcast_if(materialize(tasks, "tasks"), BROADCAST_ROWS), "cls")
    return filled.groupBy("task").applyInArrow(lambda t: _search_task(t, percent), "a long, b long")


def _links(rows: DataFrame, classes: DataFrame, shingles: int, percent: int) -> DataFrame:
    """Edges a, b between classes whose components are those of all links."""
    edges = materialize(_neighbours(rows, shingles, percent), "neighbours")
    family = materialize(connected_components(edges).select(F.col("node").alias("cls"), F.col("component").alias("family")).join(classes.select("cls", "n", "rep"), "cls"), "families")
    total = family.groupBy("family").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"))
    large = materialize(total.where((F.col("members") > 2 * BLOCK_CLASSES) | (F.col("shingles") > 2 * BLOCK_SHINGLES)).select("family"), "large")
    reps = broadcast_if(family.select("rep.text_hash", F.col("rep.id").alias("rep_id")), BROADCAST_ROWS)
    # One row of each class; rows that repeat its id and text too do no harm.
    wanted = rows.join(reps, (rows["text_hash"] == reps["text_hash"]) & rows["id"].eqNullSafe(reps["rep_id"]), "left_semi")
    sets = wanted.select("cls", "hashes")
    split = broadcast_if(large, BROADCAST_ROWS)
    small = family.join(split, "family", "left_anti").select(F.col("family").alias("task"), "cls", F.lit(0).alias("side"))
    out = materialize(_search(small, sets, percent), "links")
    if large.isEmpty():
        return out
    # Blocks: classes of like size, dealt by hash.
    like = family.join(split, "family").withColumn("like", F.floor(F.log(F.col("n").cast("double")) / 0.05).cast("int"))
    counts = like.groupBy("family", "like").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    parts = F.greatest(F.ceil(F.col("c") / BLOCK_CLASSES), F.ceil(F.col("s") / BLOCK_SHINGLES), F.lit(1)).cast("long")
    blocks = like.join(counts.select("family", "like", parts.alias("parts")), ["family", "like"])
    blocks = blocks.select("cls", "family", "n", "like", F.pmod(F.xxhash64("cls", F.lit("block")), "parts").alias("part"))
    blocks = materialize(blocks.withColumn("block", F.xxhash64("family", "like", "part")), "blocks")
    # All blocks meet the family's pivots.
    slot = F.pmod(F.xxhash64("cls", F.lit("slot")), F.lit(PIVOTS))
    chosen = blocks.withColumn("slot", slot).groupBy("family", "slot").agg(F.min("cls").alias("cls")).select("family", "cls")
    ranges = blocks.groupBy("family", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    with_pivots = ranges.select("family", F.col("block").alias("task")).join(chosen, "family").select("task", "cls", F.lit(0).alias("side"))
    first = materialize(_search(blocks.select(F.col("block").alias("task"), "cls", F.lit(1).alias("side")).union(with_pivots), sets, percent), "links")
    # What the pivots leave apart from the family's largest component meets all blocks of fitting sizes.
    parts_of = materialize(
        blocks.join(connected_components(first).select(F.col("node").alias("cls"), "component"), "cls", "left").withColumn("component", F.coalesce("component", "cls")), "parts"
    )
    biggest = parts_of.groupBy("family", "component").count().groupBy("family").agg(F.max_by("component", F.struct("count", "component")).alias("main"))
    apart = parts_of.join(biggest, "family").where("component <> main").select("family", "cls", "block", "n")
    mine = apart.groupBy("family", "block").agg(F.min("n").alias("lo_a"), F.max("n").alias("hi_a"))
    fits = (F.col("hi") * 100 >= F.col("lo_a") * percent) & (F.col("hi_a") * 100 >= F.col("lo") * percent)
    meets = materialize(mine.withColumnRenamed("block", "block_a").join(ranges, "family").where(fits).select("block_a", "block", F.xxhash64("block_a", "block").alias("task")), "meets")
    left = meets.join(apart.select(F.col("block").alias("block_a"), "cls"), "block_a").select("task", "cls", F.lit(0).alias("side"))
    right = meets.join(blocks.select("block", "cls"), "block").select("task", "cls", F.lit(1).alias("side"))
    second = materialize(_search(left.union(right), sets, percent), "links")
    return out.union(first).union(second)


def jaccard_components(docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: key, n_shingles, component_id, class_id, text_hash.

    Words are runs without ASCII white space, A-Z lower-cased; a set holds the distinct
    five-word shingles, or of fewer words the whole sequence. Null and wordless texts
    have an empty set, class null, and link with nothing, so they are components of
    their own. component_id is the smallest key that links lead to. Repeated rows are
    rows of one class; a null key is never the smallest unless alone. An empty table
    gives an empty result; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    own = docs.select(F.col(key).alias("id"), F.xxhash64(F.col(text).cast("string")).alias("text_hash"), F.col(text).cast("string").alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    rows = materialize(own.mapInArrow(_fingerprints, f"id {kind}, text_hash long, n long, cls long, hashes binary"), "fingerprints")
    grouped = rows.where("cls is not null").groupBy("cls")
    classes = materialize(grouped.agg(F.min("id").alias("low_id"), F.count("*").alias("size"), F.first("n").alias("n"), F.min(F.struct("text_hash", "id")).alias("rep")), "classes")
    total, shingles = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    links = materialize(connected_components(_links(rows, classes, shingles, percent)), "linked").select(F.col("node").alias("cls"), "component")
    named = classes.select("cls", "low_id", "size").join(links, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    named = materialize(named, "named")
    lowest = named.groupBy("component").agg(F.min("low_id").alias("component_id"))
    named = materialize(named.join(lowest, "component").select("cls", "size", "component_id"), "named")
    hot = F.col("size") * HOT_SHARE >= total
    often = F.broadcast(named.where(hot).select("cls", "component_id"))  # HOT_SHARE rows at most
    plain = rows.drop("hashes").where("cls is not null")
    joined = plain.join(often, "cls").unionByName(
        plain.join(F.broadcast(named.where(hot).select("cls")), "cls", "left_anti").join(named.where(~hot).select("cls", "component_id"), "cls")
    )
    alone = rows.drop("hashes").where("cls is null").withColumn("component_id", F.col("id"))
    return joined.unionByName(alone).select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id", F.col("cls").alias("class_id"), "text_hash")


def near_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose key is the smallest of their component, with all their columns.

    Rows with a null key, and rows that repeat a key and its text, stay.
    """
    found = jaccard_components(docs, text, key, percent)
    out = found.where(F.col(key) != F.col("component_id")).select(F.col(key).alias("_key"), F.col("text_hash").alias("_hash")).distinct()
    out = broadcast_if(materialize(out, "dropped"), BROADCAST_ROWS)
    return docs.join(out, (docs[key] == out["_key"]) & (F.xxhash64(docs[text].cast("string")) == out["_hash"]), "left_anti")

