"""Names in texts, wherever they stand: an Aho-Corasick automaton over bytes.

A name is found in a text if the text, lower-cased, contains it, lower-cased: with blanks, inside words, overlapping others.
UTF-8 bytes find the same as characters. Names go to the tasks in passes of bounded size, each as
automata of bounded size; a task runs every automaton over its texts once, whatever the number of names.

The automaton is a dense table of states by classes of bytes, completed level by level. Texts are cut into
pieces that overlap by the longest name, and all pieces of a batch take their steps together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.operators.ranking import top_k
from lodestream.operators.storage import ship

#: Bytes of names of a pass over the texts and of one automaton, of a piece of text, and of texts that take steps together.
PASS_BYTES, BLOCK_BYTES, PIECE, TEXT_BYTES = 1 << 20, 128 << 10, 1024, 4 << 20
# Entities of a tool result, memories of an entity, and memories that are looked at for one.
ENTITIES, PER_ENTITY, LOOKED_AT = 5, 3, 50


class Automaton:
    """Finds all of some byte strings that are not empty and different from each other."""

    def __init__(self, names: list[bytes]):
        used = np.unique(np.frombuffer(b"".join(names), np.uint8))
        self.cls = np.zeros(256, np.int32)
        self.cls[used] = np.arange(1, len(used) + 1)
        self.longest = max(map(len, names))
        children: list[dict[int, int]] = [{}]
        depth, self.name_of = [0], [-1]
        for k, name in enumerate(names):
            at = 0
            for c in self.cls[np.frombuffer(name, np.uint8)].tolist():
                if c not in children[at]:
                    children[at][c] = len(children)
                    children.append({})
                    depth.append(depth[at] + 1)
                    self.name_of.append(-1)
                at = children[at][c]
            self.name_of[at] = k
        self.name_of = np.array(self.name_of)
        n, depth = len(children), np.array(depth)
        edges = np.array([(s, c, t) for s, own in enumerate(children) for c, t in own.items()]).reshape(-1, 3)
        edges = edges[np.argsort(depth[edges[:, 0]], kind="stable")]
        cuts = np.searchsorted(depth[edges[:, 0]], np.arange(self.longest + 2))
        order = np.argsort(depth, kind="stable")
        levels = np.searchsorted(depth[order], np.arange(self.longest + 2))
        self.go = np.zeros((n, len(used) + 1), np.int32)
        fail, self.next_out = np.zeros(n, np.int32), np.full(n, -1)
        for d in range(self.longest + 1):
            # The row of a state is that of its suffix, which is less deep and so whole by now, but for its own children.
            level, (s, c, t) = order[levels[d] : levels[d + 1]], edges[cuts[d] : cuts[d + 1]].T
            if d:
                fail[t] = self.go[fail[s], c]
                self.go[level] = self.go[fail[level]]
            self.go[s, c] = t
            self.next_out[t] = np.where(self.name_of[fail[t]] >= 0, fail[t], self.next_out[fail[t]])
        self.ends = (self.name_of >= 0) | (self.next_out >= 0)

    def find(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, name) of all names that stand in the texts data[offsets[k]:offsets[k + 1]], each pair once."""
        n = -(-np.diff(offsets) // PIECE)
        text = np.repeat(np.arange(len(n)), n)
        own = offsets[text] + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * PIECE
        end = np.minimum(own + PIECE, offsets[text + 1])
        begin = np.maximum(own - self.longest + 1, offsets[text])
        order = np.argsort(begin - end, kind="stable")  # the longest first
        text, own, end, begin = text[order], own[order], end[order], begin[order]
        steps = end - begin
        state, found = np.zeros(len(text), np.int32), []
        cls = self.cls[data]
        alive = len(text)
        for step in range(int(steps[0]) if len(steps) else 0):
            while alive and steps[alive - 1] <= step:
                alive -= 1
            at = begin[:alive] + step
            state[:alive] = self.go[state[:alive], cls[at]]
            hit = np.flatnonzero(self.ends[state[:alive]])
            hit = hit[at[hit] >= own[hit]]
            if len(hit):
                found.append(text[hit] * len(self.go) + state[hit])
        where, state = np.divmod(np.unique(np.concatenate(found)), len(self.go)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        texts, names = [], []
        while len(state):
            named = self.name_of[state] >= 0
            texts.append(where[named])
            names.append(self.name_of[state[named]])
            state = self.next_out[state]
            where, state = where[state >= 0], state[state >= 0]
        if not texts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs = np.unique(np.concatenate(texts) * (1 + self.name_of.max()) + np.concatenate(names))
        return np.divmod(pairs, 1 + self.name_of.max())


def _slices(column: pa.Array):
    """(first row, bytes, offsets) of successive texts of about TEXT_BYTES; a longer text comes alone."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(column):
        last = min(max(int(np.searchsorted(offsets, offsets[first] + TEXT_BYTES, side="right")) - 1, first + 1), len(column))
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def mentions(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(id, name) of names (name) that stand in texts (id, text), without case, each pair once for a row of texts.

    Names that differ in case only are known by the least of them; empty and null names and texts match nothing.
    """
    spark = texts.sparkSession
    ship(spark)
    known = names.where("name <> ''").groupBy(F.lower("name").alias("key")).agg(F.min("name").alias("name"))
    size = known.agg(F.sum(F.octet_length("key"))).first()[0] or 0
    passes = -(-size // PASS_BYTES)
    lower = texts.select("id", F.lower("text").alias("text"))
    kind = dict(texts.dtypes)["id"]
    found = None
    for p in range(passes):
        part = known if passes == 1 else known.where(F.pmod(F.xxhash64("key"), F.lit(passes)) == p)
        rows = part.orderBy("key").toArrow()
        keys, originals = [k.encode() for k in rows.column("key").to_pylist()], rows.column("name").combine_chunks()

        def run(batches, keys=keys, originals=originals):
            automata, first = [], 0
            total = np.cumsum([len(k) for k in keys])
            while first < len(keys):
                last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + BLOCK_BYTES, side="right")))
                automata.append((first, Automaton(keys[first:last])))
                first = last
            for batch in batches:
                for row, data, offsets in _slices(batch.column("text")):
                    for start, a in automata:
                        where, name = a.find(data, offsets)
                        if len(where):
                            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(where + row)), originals.take(pa.array(name + start))], names=["id", "name"])

        if keys:
            out = lower.mapInArrow(run, f"id {kind}, name string")
            found = out if found is None else found.unionByName(out)
    return found if found is not None else spark.createDataFrame([], f"id {kind}, name string")


def memories_about(about: DataFrame, records: DataFrame, most: int = LOOKED_AT) -> DataFrame:
    """(agent, name, id, rank): of each agent's records (id, agent) the most relevant about an entity, by edges about (id, name, relevance)."""
    own = about.join(records.select("id", "agent"), "id").select("agent", "name", "id", "relevance")
    return top_k(own, ["agent", "name"], "relevance", "id", most).select("agent", "name", "id", "rank")


def added_lines(existing: Column, contents: Column) -> Column:
    """n and text of what contents (in order) add to existing: a content that stands in existing or in what was added before adds nothing."""
    line = lambda a, c: F.concat(a["text"], F.when(a["n"] > 0, "\n").otherwise(""), F.lit("- "), c)
    fresh = lambda a, c: (c != "") & ~F.contains(existing, c) & ~F.contains(a["text"], c)
    none = F.struct(F.lit(0).alias("n"), F.lit("").alias("text"))
    return F.aggregate(contents, none, lambda a, c: F.when(fresh(a, c), F.struct((a["n"] + 1).alias("n"), line(a, c).alias("text"))).otherwise(a))


def enrich(results: DataFrame, names: DataFrame, about: DataFrame, records: DataFrame) -> DataFrame:
    """What memories add to tool results (id, agent, text, existing): id, n_entities, n_memories, n_tokens, added.

    Of the entities that a result mentions the first few by name are taken, of each of these the most relevant few
    of the agent's records (id, agent, content); contents that are there already are left out. Results that nothing is added to have no row.
    """
    met = mentions(results.select("id", "text"), names)
    ranked = top_k(met.withColumn("zero", F.lit(0)), ["id"], "zero", "name", None).withColumnRenamed("rank", "place")
    counted = ranked.groupBy("id").agg(F.count("*").alias("n_entities"))
    few = ranked.where(F.col("place") <= ENTITIES).select(F.col("id").alias("result"), "name", "place")
    best = memories_about(about, records, PER_ENTITY)
    few = few.join(results.select(F.col("id").alias("result"), "agent"), "result")
    lines = few.join(best, ["agent", "name"]).join(records.select("id", F.coalesce("content", F.lit("")).alias("content")), "id")
    lists = lines.groupBy("result").agg(F.array_sort(F.collect_list(F.struct("place", "rank", "content"))).alias("lines"))  # at most ENTITIES * PER_ENTITY
    out = results.select("id", F.coalesce("existing", F.lit("")).alias("existing")).join(lists.withColumnRenamed("result", "id"), "id").join(counted, "id")
    out = out.withColumn("added", added_lines(F.col("existing"), F.col("lines")["content"])).where("added.n > 0")
    return out.select("id", "n_entities", F.col("added")["n"].alias("n_memories"), F.floor(F.length(F.col("added")["text"]) / 4).alias("n_tokens"), F.col("added")["text"].alias("added"))
