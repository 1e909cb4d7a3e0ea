"""N-gram Jaccard join: a prefix-tree join of word-shingle sets, and the groups that its links make.

1. One pass over the texts gives each document the size and digest of its set of shingles;
   documents of equal sets are one class. The same pass counts shingles in a sketch, which
   tells the few that very many classes may have.
2. A second pass deals the shingles out by ranges of their hashes, packed by class, and each
   range finds those that two classes or more have, and how many: the global order of shingles
   is (magnitude of that number, hash). Shingles of very many classes come last without being
   gathered; they are dealt out by class.
3. A set of n can only link if ceil(3n/4) of its shingles are in other sets too, which leaves
   few classes. These are posted under their rarest shared shingles, as many as two sets that
   link must have one in common of; all classes that meet the same least class under any of
   its shingles are one group.
4. Each group is joined in a prefix tree of its sets, frequent shingles first: a probe walks it
   level by level, branches share the overlap of their common prefix, and a branch is left
   as soon as what remains of it and of the probe cannot reach the overlap that a link needs.
   Only links between different components leave a group, fewer than it has members.
5. A group of too many shingles for one task first meets its least class, in blocks; then
   those that are not in its component meet all members, block by block.

All steps are exact up to collisions of 64-bit hashes (at least 53 bits where overlaps are
counted). Defined results: null and empty texts have empty sets and link with nothing; rows
with equal sets are in one component; a null doc_id takes its component from the others, or null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.llm.common import Texts, discard, mix, ship, shingles, texts_of, written
from lodestream.llm.components import components

#: Counters of the sketch: a power of two between these, about one for 500 shingles. Each task sends as many, so they have a bound.
LEAST_BITS, MOST_BITS = 14, 20
#: Shingles are frequent beyond what counters reach by chance, 5 deviations above their mean, and this at least.
LEAST_FREQUENT = 1024
#: Shingles of a hash range, and of a group that one task joins. Both bound memory, not results.
RANGE_SHINGLES = GROUP_SHINGLES = 1 << 21
#: Shingles that a task of the second pass packs at once.
_PACK = 1 << 21
_BLOCK = 1 << 14
_LOW = np.uint64((1 << 48) - 1)
#: Order of the frequent shingles: behind all magnitudes.
_LAST = 100


def ordered_sets(texts: Texts) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, ascending."""
    h, owner, _ = shingles(texts.lowered())
    if np.any(np.diff(owner) < 0):
        order = np.argsort(owner, kind="stable")
        h, owner = h[order], owner[order]
    at = np.searchsorted(owner, np.arange(texts.n + 1))
    return [np.unique(h[a:b]) for a, b in zip(at[:-1], at[1:])]


def set_id(s: np.ndarray) -> int:
    """A signed 64-bit digest of a set."""
    total = int(np.add.reduce(mix(s ^ np.uint64(0xA24BAED4963EE407)), dtype=np.uint64)) + len(s) * 0x9FB21C651E98DF25
    return int(mix(np.array([total & (2**64 - 1)], dtype=np.uint64)).view(np.int64)[0])


def _own(text: Column) -> Column:
    """A hash that tells texts apart, null from empty too."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def _first_pass(documents: DataFrame, bits: int) -> DataFrame:
    """Rows (doc_id, own, n, id) of documents, own being a hash of the text, and rows (block, counts) of each task's sketch."""
    names = ["doc_id", "own", "n", "id", "block", "counts"]

    def run(batches):
        sketch = np.zeros(1 << bits, dtype=np.uint32)
        for batch in batches:
            doc_ids, own = batch.column("doc_id"), batch.column("own")
            for first, texts in texts_of(batch.column("text")):
                sets, n = ordered_sets(texts), texts.n
                ids = np.array([set_id(s) for s in sets], dtype=np.int64)
                for k in np.unique(ids, return_index=True)[1]:
                    sketch[sets[k] >> np.uint64(64 - bits)] += np.uint32(1)  # a set meets a counter twice seldom; such a double counts once
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.slice(first, n), own.slice(first, n), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names
                )
        for b in range(0, 1 << bits, _BLOCK):
            if sketch[b : b + _BLOCK].any():
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64())] * 4 + [pa.array([b // _BLOCK], pa.int32()), pa.array([sketch[b : b + _BLOCK].tobytes()], pa.binary())], names=names)

    read = documents.select(F.col("doc_id").cast("long").alias("doc_id"), _own(F.col("text")).alias("own"), "text")
    return read.mapInArrow(run, "doc_id long, own long, n long, id long, block int, counts binary")


def _sum_counts(table: pa.Table) -> pa.Table:
    total = np.zeros(_BLOCK, dtype=np.uint64)
    for c in table.column("counts"):
        own = np.frombuffer(c.as_buffer(), dtype=np.uint32)
        total[: len(own)] += own
    out = np.minimum(total, 2**32 - 1).astype(np.uint32)
    return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int32()), "counts": pa.array([out.tobytes()], pa.binary())})


def frequent_bits(first: DataFrame, bits: int, limit: int) -> np.ndarray:
    """Which counters are beyond limit: the tasks' sketches are added in two steps of bounded fan-in; 2 ** bits flags come here."""
    parts = first.where("block is not null").select("block", "counts", F.pmod(F.xxhash64("counts"), F.lit(64)).alias("part"))
    some = parts.groupBy("block", "part").applyInArrow(_sum_counts, "block int, counts binary")
    total = some.groupBy("block").applyInArrow(_sum_counts, "block int, counts binary")

    def flags(batches):
        for batch in batches:
            packed = [np.packbits(np.frombuffer(c.as_buffer(), dtype=np.uint32) > limit).tobytes() for c in batch.column("counts")]
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(packed, pa.binary())], names=["block", "flags"])

    out = np.zeros(1 << bits, dtype=bool)
    for r in total.mapInArrow(flags, "block int, flags binary").toLocalIterator():
        own = np.unpackbits(np.frombuffer(r.flags, dtype=np.uint8)).astype(bool)
        end = min((r.block + 1) * _BLOCK, 1 << bits)
        out[r.block * _BLOCK : end] = own[: end - r.block * _BLOCK]
    return out


def key_of(h: np.ndarray, bits: int) -> np.ndarray:
    """What is left of hashes that 2 ** bits ranges deal out: the range and 48 bits."""
    return h >> np.uint64(max(0, 16 - bits))


def _packed(sets: list[np.ndarray], ids: np.ndarray, hot: np.ndarray, sketch_bits: int, bits: int) -> pa.RecordBatch:
    """Rows (part, ids, ns, counts, keys) of classes: what each range gets of them; frequent shingles go to parts of their own, by class."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    h, own = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    often = hot[h >> np.uint64(64 - sketch_bits)]
    part = (h >> np.uint64(64 - bits)).astype(np.int64)
    part[often] = (1 << bits) + (ids.view(np.uint64)[own[often]] >> np.uint64(64 - bits)).astype(np.int64)
    order = np.argsort(part.astype(np.uint16) if bits < 15 else part, kind="stable")
    h, own, part = key_of(h[order], bits), own[order], part[order]
    new = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (own[1:] != own[:-1])]))
    counts = np.diff(np.concatenate([new, [len(h)]])).astype(np.int32)
    classes, numbers = ids[own[new]], sizes[own[new]].astype(np.int32)
    at = np.flatnonzero(np.concatenate([[True], part[new][1:] != part[new][:-1]]))
    to = np.concatenate([at[1:], [len(new)]])
    edge = np.concatenate([new, [len(h)]])
    low = np.ascontiguousarray(h & _LOW).view(np.uint8).reshape(-1, 8)[:, :6]
    columns = [[] for _ in range(5)]
    for a, b in zip(at, to):
        x, y, p = edge[a], edge[b], int(part[edge[a]])
        keys = low[x:y] if p < 1 << bits else h[x:y]
        for c, v in zip(columns, (p, classes[a:b].tobytes(), numbers[a:b].tobytes(), counts[a:b].tobytes(), np.ascontiguousarray(keys).tobytes())):
            c.append(v)
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64())] + [pa.array(c, pa.binary()) for c in columns[1:]], names=["part", "ids", "ns", "counts", "keys"])


def shared_shingles(documents: DataFrame, sketch_bits: int, flags: np.ndarray, bits: int) -> DataFrame:
    """(id, n, key, place) of the shingles that two classes or more have, once for each class; place comes first in their order, then key."""
    shared = documents.sparkSession.sparkContext.broadcast(np.packbits(flags))

    def pack(batches):
        hot = np.unpackbits(shared.value)[: 1 << sketch_bits].astype(bool)
        sets, ids, n = {}, [], 0
        for batch in batches:
            for _, texts in texts_of(batch.column("text")):
                for s in ordered_sets(texts):
                    if len(s) and (own := set_id(s)) not in sets:
                        sets[own] = s
                        n += len(s)
                if n >= _PACK:
                    yield _packed(list(sets.values()), np.array(list(sets), dtype=np.int64), hot, sketch_bits, bits)
                    sets, n = {}, 0
        if sets:
            yield _packed(list(sets.values()), np.array(list(sets), dtype=np.int64), hot, sketch_bits, bits)

    def meet(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        column = lambda c, t: np.frombuffer(b"".join(table.column(c).to_pylist()), dtype=t)
        ids, ns = column("ids", np.int64), column("ns", np.int32)
        own = np.repeat(np.arange(len(ids)), column("counts", np.int32))
        if part < 1 << bits:
            keys = np.zeros((len(own), 8), dtype=np.uint8)
            keys[:, :6] = column("keys", np.uint8).reshape(-1, 6)
            keys = keys.view(np.uint64).ravel() | np.uint64(part << (64 - bits - max(0, 16 - bits)))
            order = np.argsort(keys)
            keys, own = keys[order], own[order]
            same = keys[1:] == keys[:-1]
            some = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            keys, own = keys[some], own[some]
        else:
            keys = column("keys", np.uint64)
        order = np.lexsort((ids[own], keys))
        keys, own = keys[order], own[order]
        new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (ids[own[1:]] != ids[own[:-1]])]) if len(keys) else np.zeros(0, bool)
        keys, own = keys[new], own[new]
        if part < 1 << bits:
            _, at, n = np.unique(keys, return_inverse=True, return_counts=True)
            some = n[at] > 1
            keys, own, place = keys[some], own[some], np.log2(n[at][some]).astype(np.int8)
        else:
            place = np.full(len(keys), _LAST, dtype=np.int8)
        return pa.table({"id": ids[own], "n": ns[own], "key": keys.view(np.int64), "place": place})

    packed = documents.select("text").mapInArrow(pack, "part long, ids binary, ns binary, counts binary, keys binary")
    return packed.groupBy("part").applyInArrow(meet, "id long, n int, key long, place byte")


def _needed(n: Column) -> Column:
    return F.ceil(3 * n / 4).cast("int")


def linkable(rows: DataFrame) -> DataFrame:
    """(id, n, keys) of the classes that have enough shared shingles to link; keys are these, in their order."""
    of_class = Window.partitionBy("id")
    some = rows.withColumn("m", F.count("*").over(of_class)).where(F.col("m") >= _needed(F.col("n")))
    one = some.groupBy("id").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("place", "key"))).alias("keys"))
    return one.select("id", "n", F.col("keys.key").alias("keys"))


class PrefixTree:
    """A radix tree of ordered sets: each node has a run of items, and the least and most of what its leaves have."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        codes = [s.astype(">u4").tobytes() for s in sets]
        order = sorted(range(len(sets)), key=codes.__getitem__)
        self.items = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        begin = np.cumsum([0, *map(len, sets)])
        depth, first, leaf, parent = [0], [order[0]], [-1], [-1]
        stack = [0]
        for at, k in enumerate(order):
            common = 0
            if at:
                x, y = sets[order[at - 1]], sets[k]
                n = min(len(x), len(y))
                differ = np.flatnonzero(x[:n] != y[:n])
                common = int(differ[0]) if len(differ) else n
            while depth[stack[-1]] > common:
                last = stack.pop()
                if depth[stack[-1]] < common:
                    depth.append(common)
                    first.append(first[last])
                    leaf.append(-1)
                    parent.append(-1)
                    stack.append(len(depth) - 1)
                parent[last] = stack[-1]
            depth.append(len(sets[k]) + 1)  # a leaf ends in a mark of its own, so none is inside another
            first.append(k)
            leaf.append(k)
            parent.append(-1)
            stack.append(len(depth) - 1)
        while len(stack) > 1:
            last = stack.pop()
            parent[last] = stack[-1]
        self.leaf, self.parent, deep = np.array(leaf), np.array(parent), np.array(depth)
        first = np.array(first)
        self.depth = np.where(self.leaf >= 0, deep - 1, deep)
        self.start, self.stop = begin[first] + self.depth[self.parent], begin[first] + self.depth
        self.start[0] = self.stop[0] = 0
        up = np.argsort(deep, kind="stable")
        lengths = np.array([len(s) for s in sets])
        self.longest, self.least, self.most = (np.where(self.leaf >= 0, v[self.leaf], w) for v, w in ((lengths, 0), (sizes, np.iinfo(np.int64).max), (sizes, 0)))
        level = np.zeros(len(deep), dtype=np.int64)
        for v in up[::-1]:
            p = self.parent[v]
            if p >= 0:
                self.longest[p], self.least[p], self.most[p] = max(self.longest[p], self.longest[v]), min(self.least[p], self.least[v]), max(self.most[p], self.most[v])
        for v in up:
            if self.parent[v] >= 0:
                level[v] = level[self.parent[v]] + 1
        by = np.argsort(level, kind="stable")
        self.levels = np.split(by, np.flatnonzero(np.diff(level[by])) + 1)[1:]

    def reach(self, probe: np.ndarray, size: int, n_items: int) -> np.ndarray:
        """The sets whose overlap with the probe makes a link: 7 * overlap >= 3 * (both sizes)."""
        member = np.zeros(n_items, dtype=np.int64)
        member[probe] = 1
        rank = np.concatenate([[0], np.cumsum(member)])
        overlap, live, found = np.zeros(len(self.leaf), dtype=np.int64), np.zeros(len(self.leaf), dtype=bool), []
        live[0] = True
        for nodes in self.levels:
            at = nodes[live[self.parent[nodes]]]
            at = at[(4 * self.most[at] >= 3 * size) & (3 * self.least[at] <= 4 * size)]
            if not len(at):
                continue
            n = self.stop[at] - self.start[at]
            edge = np.concatenate([[0], np.cumsum(n)])
            run = self.items[np.repeat(self.start[at] - edge[:-1], n) + np.arange(edge[-1])]
            total = np.concatenate([[0], np.cumsum(member[run])])
            overlap[at] = overlap[self.parent[at]] + total[edge[1:]] - total[edge[:-1]]
            last = np.where(self.stop[at] > self.start[at], self.items[np.maximum(self.stop[at], 1) - 1] + 1, 0)
            left = np.minimum(len(probe) - rank[last], self.longest[at] - self.depth[at])
            at = at[7 * (overlap[at] + left) >= 3 * (size + self.least[at])]
            live[at] = True
            found.append(at[self.leaf[at] >= 0])
        return self.leaf[np.concatenate(found)] if found else np.zeros(0, np.int64)


def tree_links(ids: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray], probes: np.ndarray, roots: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the components of all members that probes link with; roots are components known before.

    Where all members are probes, those of the largest component need not ask: a pair of two
    components has one at least that is not in it.
    """
    flat = np.concatenate(sets)
    _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    order = np.argsort(-count, kind="stable")
    place = np.empty(len(count), dtype=np.int64)
    place[order] = np.arange(len(count))
    met = int((count > 1).sum())  # what one member alone has is in no overlap
    own = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    code = place[code]
    own, code = own[code < met], code[code < met]
    code = code[np.lexsort((code, own))]
    ordered = np.split(code, np.cumsum(np.bincount(own, minlength=len(sets)))[:-1])
    tree = PrefixTree(ordered, sizes)
    _, root = np.unique(roots, return_inverse=True)
    asked, every, found = np.zeros(len(sets), dtype=bool), bool(probes.all()), []
    while True:
        open_ = probes & ~asked
        if every:
            open_ &= root != np.argmax(np.bincount(root))
            if not asked.any():
                open_[0] = True
        if not open_.any() or not (root != root[0]).any():
            return found
        q = int(np.argmax(open_))
        asked[q] = True
        hits = tree.reach(ordered[q], int(sizes[q]), max(met, 1))
        for k in hits[root[hits] != root[q]]:
            if root[k] != root[q]:
                found.append((int(ids[q]), int(ids[k])))
                root[root == root[k]] = root[q]


def _joined(slots: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) within groups g of slots (g, id, probe, root)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("id")
        ids, sizes, roots = (table.column(c).to_numpy() for c in ("id", "n", "root"))
        items = table.column("keys").combine_chunks()
        flat, at = items.flatten().to_numpy(zero_copy_only=False), items.offsets.to_numpy() - items.offsets[0].as_py()
        probes = table.column("probe").to_numpy(zero_copy_only=False).astype(bool)
        found = tree_links(ids, sizes.astype(np.int64), [flat[a:b] for a, b in zip(at[:-1], at[1:])], probes, roots)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})

    return slots.join(sets, "id").select("g", "id", "n", "keys", "probe", "root").groupBy("g").applyInArrow(run, "a long, b long")


def _groups(sets: DataFrame) -> DataFrame:
    """(a, id): the classes that meet the least class a under one of its keys, a itself included."""
    posted = sets.select("id", F.explode(F.slice("keys", 1, F.size("keys") - _needed(F.col("n")) + 1)).alias("key"))
    least = posted.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("m")).where("m > 1").select("key", "a")
    return posted.join(least, "key").select("a", "id").distinct()


def find_links(sets: DataFrame, limit: int) -> list[DataFrame]:
    """Tables of links (a, b) that join the components of linkable classes (id, n, keys)."""
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    weight = F.size("keys").cast("long").alias("w")
    met = written(_groups(sets).join(sets.select("id", weight), "id"))
    sums = met.groupBy("a").agg(F.sum("w").alias("all")).withColumn("js", F.ceil(F.col("all") / limit).cast("int"))
    slots = met.join(sums, "a")
    group = lambda i, j: F.struct("a", i.cast("int").alias("i"), j.cast("int").alias("j")).alias("g")
    zero = F.lit(0)
    small = slots.where("js = 1").select(group(zero, zero), "id", F.lit(True).alias("probe"), F.col("id").alias("root"))
    large = slots.where("js > 1")
    others = large.where("id <> a").select(group(zero, block("js")), "id", F.lit(False).alias("probe"), F.col("id").alias("root"))
    heads = sums.where("js > 1").select("a", F.explode(F.sequence(zero, F.col("js") - 1)).alias("j"))
    heads = heads.select(group(zero, F.col("j")), F.col("a").alias("id"), F.lit(True).alias("probe"), F.col("a").alias("root"))
    links = written(_joined(small.unionByName(others).unionByName(heads), sets))
    if large.isEmpty():
        discard(met)
        return [links]
    known = components(links)
    held = large.join(known.withColumnRenamed("node", "id"), "id", "left").select("a", "id", "w", "js", F.coalesce("root", "id").alias("root"))
    lead = held.where("a = id").select("a", F.col("root").alias("lead"))
    out = held.join(lead, "a").where("root <> lead")
    out = out.join(out.groupBy("a").agg(F.ceil(F.sum("w") / limit).cast("int").alias("is")), "a")
    asking = out.select("a", "id", "root", block("is").alias("i"), F.explode(F.sequence(zero, F.col("js") - 1)).alias("j"), F.lit(True).alias("probe"))
    asked = held.join(out.select("a", "is").distinct(), "a").select("a", "id", "root", F.explode(F.sequence(zero, F.col("is") - 1)).alias("i"), block("js").alias("j"), F.lit(False).alias("probe"))
    both = asking.unionByName(asked).groupBy("a", "i", "j", "id", "root").agg(F.max("probe").alias("probe"))
    rest = written(_joined(both.select(group(F.col("i"), F.col("j")), "id", "probe", "root"), sets))
    discard(met)
    return [links, rest]


def _classified(documents: DataFrame, limit: int = GROUP_SHINGLES, often: int | None = None) -> DataFrame:
    """(doc_id, own, n, id, root, component_id) for each row of documents; own is a hash of its text."""
    ship(documents.sparkSession)
    chars = documents.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first().n
    sketch_bits = min(max(int(chars // 4000).bit_length(), LEAST_BITS), MOST_BITS)
    first = written(_first_pass(documents, sketch_bits))
    rows = first.where("block is null").select("doc_id", "own", "n", "id")
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    mean = total / (1 << sketch_bits)
    flags = frequent_bits(first, sketch_bits, often or max(LEAST_FREQUENT, int(mean + 5 * mean**0.5)))
    bits = min(max(int(total // RANGE_SHINGLES).bit_length(), 4), 31)
    sets = written(linkable(shared_shingles(documents, sketch_bits, flags, bits)))
    links = find_links(sets, limit)
    both = links[0]
    for more in links[1:]:
        both = both.unionByName(more)
    known = components(both)
    least = rows.groupBy("id").agg(F.min("doc_id").alias("least")).join(known.withColumnRenamed("node", "id"), "id", "left").select("id", "least", F.coalesce("root", "id").alias("root"))
    of_root = least.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = written(least.join(of_root, "root").select("id", "root", "component_id"))
    discard(sets, *links)
    return rows.join(of_class, "id").select("doc_id", "own", "n", "id", "root", F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def join(documents: DataFrame, limit: int = GROUP_SHINGLES, often: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of documents.

    limit: shingles of a group that one task joins. often: classes beyond which a shingle counts
    as frequent; by default it follows from the size of the corpus. Both divide the work and
    change no result.
    """
    return _classified(documents, limit, often).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_first(documents: DataFrame) -> DataFrame:
    """The document of least doc_id of each component, once where its row is repeated; columns as they were. Rows without a doc_id stay.

    Of different texts under one doc_id each is a document; in one component the least hash of them stays.
    """
    found = _classified(documents.where("doc_id is not null"))
    per_row = found.groupBy("doc_id", "own").agg(F.count("*").alias("copies"), F.min("n").alias("n"), F.min("root").alias("root"))
    best = per_row.where("n > 0").groupBy("root").agg(F.min(F.struct("doc_id", "own", "copies")).alias("x")).select("x.*")
    kept = best.unionByName(per_row.where("n = 0").select("doc_id", "own", "copies")).toDF("lodestream_id_", "lodestream_own_", "lodestream_copies_")
    row = (F.col("doc_id") == F.col("lodestream_id_")) & (_own(F.col("text")) == F.col("lodestream_own_"))
    kept = written(kept)
    once = documents.join(kept.where("lodestream_copies_ = 1"), row, "left_semi")
    again = documents.join(kept.where("lodestream_copies_ > 1"), row).dropDuplicates(["lodestream_id_", "lodestream_own_"]).select(*documents.columns)
    return once.unionByName(again).unionByName(documents.where("doc_id is null"))
