"""Suffix-array dedup: bytes covered by a long string that also starts elsewhere are cut.

Every string of LENGTH bytes is known by one anchor, the least of the hashes of its GRAM-byte
substrings, so equal strings have equal anchors. Runs of strings with one anchor make a
segment. Only segments whose anchor occurs more than once are read again; their distinct
contents, grouped by anchor, fill shards of bounded size. A shard gets its suffix array by
induced sorting, and the permuted common prefixes tell which strings start twice in it.

The contents of an anchor that has more than a shard holds are cut again by anchors of longer
substrings (FINER), which fewer of them share; the segments fill shards in their turn. Only
where the longest anchors still have more is each string a key of its own, so that a passage
that a third of all documents share is counted by partial sums.

Exact up to collisions of 64-bit hashes. Defined results: a null text is empty; texts under
LENGTH bytes keep all; rows of equal texts are judged alike, as copies of each other;
other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import _BASE, _BASE_INV, Texts, _power, discard, mix, ship, texts_of, written

LENGTH = 400
GRAM = 80
#: Bytes of the anchors that strings with one overfull anchor are dealt out by in turn.
FINER = (240, 340)
#: Bytes of a shard, and of one anchor's contents before it is dealt out by string.
SHARD_BYTES = 2 << 20
PIECE = 4 << 20
#: A filter of 32 bits a key, within these powers of two (at most 32 MB).
LEAST_BITS, MOST_BITS = 16, 28


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    n = len(data)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, n), out=total[1:])
    return mix((total[gram:] - total[:-gram]) * _power(_BASE_INV, n + 1)[: n - gram + 1])


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Least of v[s : s + width] for every s that has so many."""
    n = len(v)
    rows = -(-n // width)
    grid = np.full(rows * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    grid[:n] = v
    grid = grid.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def segments(texts: Texts, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """owner, start, last (first and last start of its strings), key, many (whether it holds its anchor twice or more)."""
    none = {"owner": np.zeros(0, np.int64), "start": np.zeros(0, np.int64), "last": np.zeros(0, np.int64), "key": np.zeros(0, np.uint64), "many": np.zeros(0, bool)}
    n = len(texts.data)
    if n < length:
        return none
    if n > 2 * PIECE:
        parts = []
        for k in range(texts.n):
            a, b = texts.offsets[k], texts.offsets[k + 1]
            for x in range(a, max(b - length + 1, a), PIECE):
                y = min(b, x + PIECE + length - 1)
                s = segments(Texts(texts.data[x:y], np.array([0, y - x])), length, gram)
                parts.append(s | {"owner": s["owner"] + k, "start": s["start"] + (x - a), "last": s["last"] + (x - a)})
        return {c: np.concatenate([p[c] for p in parts]) if parts else none[c] for c in none}
    h = _gram_hashes(texts.data, gram)
    order = (h >> np.uint64(32) << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(len(h), dtype=np.uint64))
    least = _sliding_min(order, length - gram + 1)
    owner = np.repeat(np.arange(texts.n), np.diff(texts.offsets))[: len(least)]
    s = np.flatnonzero(texts.offsets[owner + 1] - np.arange(len(least)) >= length)
    if not len(s):
        return none
    at = (np.uint64(0xFFFFFFFF) - (least[s] & np.uint64(0xFFFFFFFF))).astype(np.int64)
    key, own = h[at], owner[s]
    joined = np.concatenate([[False], (s[1:] == s[:-1] + 1) & (own[1:] == own[:-1]) & (key[1:] == key[:-1])])
    first = np.flatnonzero(~joined)
    moved = np.concatenate([[0], np.cumsum(joined[1:] & (at[1:] != at[:-1]))])
    end = np.concatenate([first[1:], [len(s)]]) - 1
    base = texts.offsets[own[first]]
    return {"owner": own[first], "start": s[first] - base, "last": s[end] - base, "key": key[first], "many": moved[end] > moved[first]}


def _types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor; the last one is."""
    n = len(s)
    step = np.sign(np.diff(s.astype(np.int64)))
    place = np.where(step != 0, np.arange(n - 1), n)
    following = np.minimum.accumulate(place[::-1])[::-1]
    out = np.ones(n, dtype=bool)
    out[:-1] = np.where(following < n, step[np.minimum(following, n - 2)] > 0, True)
    return out


def _induce(s: np.ndarray, small: np.ndarray, lms: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The suffix order that the given order of leftmost-smaller suffixes induces, bucket by bucket."""
    n = len(s)
    sa = np.full(n, -1, dtype=np.int64)
    ends = np.cumsum(counts)
    heads = ends - counts
    symbols = np.flatnonzero(counts)

    def deal(at: np.ndarray, slots: np.ndarray, sign: int) -> None:
        c = s[at]
        order = np.argsort(c, kind="stable")
        c = c[order]
        first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        size = np.diff(np.concatenate([first, [len(c)]]))
        rank = np.arange(len(c)) - np.repeat(first, size)
        sa[slots[c] + sign * rank] = at[order]
        slots[c[first]] += sign * size

    lms_counts = np.bincount(s[lms], minlength=len(counts))
    by_symbol = lms[np.argsort(s[lms], kind="stable")]
    lms_at = np.cumsum(lms_counts) - lms_counts
    head = heads.copy()
    for c in symbols:
        done = heads[c]
        while done < head[c]:
            own = sa[done : head[c]]
            done = head[c]
            before = own[own > 0] - 1
            before = before[~small[before]]
            if len(before):
                deal(before, head, 1)
        own = by_symbol[lms_at[c] : lms_at[c] + lms_counts[c]]
        before = own[own > 0] - 1
        before = before[~small[before]]
        if len(before):
            deal(before, head, 1)
    large = head.copy()
    tail = ends - 1
    for c in symbols[::-1]:
        done = ends[c] - 1
        while True:
            low = tail[c]
            if done > low:
                own = sa[low + 1 : done + 1][::-1]
                done = low
            else:
                break
            before = own[own > 0] - 1
            before = before[small[before]]
            if len(before):
                deal(before, tail, -1)
        own = sa[heads[c] : large[c]][::-1]
        before = own[own > 0] - 1
        before = before[small[before]]
        if len(before):
            deal(before, tail, -1)
    return sa


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of s (non-negative, its last symbol the only 0 or the least one) by induced sorting."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), dtype=np.int64)
    counts = np.bincount(s)
    small = _types(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if not len(lms):
        lms = np.array([n - 1])
    first = _induce(s, small, lms[::-1].copy(), counts) if len(lms) > 1 else None
    if first is None:
        return _complete(s, small, lms, counts)
    rank_of = np.full(n, -1, dtype=np.int64)
    rank_of[lms] = np.arange(len(lms))
    order = _complete_order(first, rank_of, lms)
    spans = np.diff(np.concatenate([lms, [n - 1]])) + 1
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((s.astype(np.uint64) + np.uint64(1)) * _power(_BASE, n), out=total[1:])
    stop = np.minimum(lms + spans, n)
    h = mix((total[stop] - total[lms]) * _power(_BASE_INV, n + 1)[lms] + (stop - lms).astype(np.uint64))
    names = np.empty(len(lms), dtype=np.int64)
    ordered = h[order]
    names[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
    distinct = int(names.max()) + 1
    if distinct < len(lms):
        order = suffix_array(names) if distinct <= 1024 else _by_doubling(names)
    return _complete(s, small, lms[order], counts)


def _complete_order(sa: np.ndarray, rank_of: np.ndarray, lms: np.ndarray) -> np.ndarray:
    found = rank_of[sa[sa >= 0]]
    found = found[found >= 0]
    if len(found) < len(lms):
        missing = np.setdiff1d(np.arange(len(lms)), found)
        found = np.concatenate([missing, found])
    return found


def _complete(s: np.ndarray, small: np.ndarray, lms: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Induce from sorted leftmost-smaller suffixes; the last suffix, which nothing induces, is put in its place."""
    sa = _induce(s, small, lms, counts)
    if (sa < 0).any():
        sa[np.flatnonzero(sa < 0)[0]] = len(s) - 1
    return sa


def _by_doubling(names: np.ndarray) -> np.ndarray:
    """Suffix order of a reduced string with a large alphabet, by ranks of prefixes of doubled length; a round sorts only what shares its rank."""
    n, k = len(names), 0
    order, rank, shared = np.arange(n), np.zeros(n, dtype=np.int64), np.arange(n)
    while len(shared):
        own = order[shared]
        following = np.zeros(len(own), dtype=np.int64)
        inside = own + k < n
        following[inside] = (rank if k else names)[own[inside] + k] + 1
        key = rank[own] * (n + 1) + following
        by_key = np.argsort(key, kind="stable")
        own, key = own[by_key], key[by_key]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.concatenate([first, [len(key)]]))
        order[shared] = own
        rank[own] = np.repeat(shared[first], size)
        shared = shared[np.repeat(size > 1, size)]
        k = 2 * k or 1
    return order


def _common(data: np.ndarray, words: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Lengths of the common prefixes of data[a:] and data[b:], up to most."""
    out = np.zeros(len(a), dtype=np.int64)
    live = np.arange(len(a))
    limit = len(words)
    while len(live):
        x, y = a[live] + out[live], b[live] + out[live]
        inside = (x < limit) & (y < limit)
        live, x, y = live[inside], x[inside], y[inside]
        same = words[x] == words[y]
        out[live[same]] += 8
        off = live[~same]
        if len(off):
            differ = words[x[~same]] ^ words[y[~same]]
            step = np.zeros(len(off), dtype=np.int64)
            for k in range(7):
                step += (differ & np.uint64((1 << (8 * (k + 1))) - 1)) == 0
            out[off] += step
        live = live[same]
        live = live[out[live] < most]
    return np.minimum(out, most)


def repeated_starts(data: np.ndarray, valid: np.ndarray, length: int = LENGTH, sample: int = 32) -> np.ndarray:
    """For each place of data whether the string of that length there is valid and starts elsewhere too.

    data holds contents, each followed by a byte 255 that valid strings, as UTF-8, do not hold (see shard_ranges()). The bounds from
    places before and after hold in a whole suffix order only, not in one by the first bytes.
    """
    s = np.concatenate([data.astype(np.int64) + 1, [0]])
    sa = suffix_array(s)
    phi = np.full(len(s), -1, dtype=np.int64)
    phi[sa[1:]] = sa[:-1]
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded[: len(data)].view(np.uint8), shape=(len(data), 8), strides=(1, 1)).copy().view("<u8").ravel() if len(data) else np.zeros(0, "<u8")
    n = len(data)
    at = np.arange(0, n, sample)
    at = at[phi[at] >= 0]
    got = np.full(n + sample + 1, -1, dtype=np.int64)
    ok = phi[at] < n
    got[at[ok]] = _common(data, words, at[ok], phi[at[ok]], length + sample)
    got[at[~ok]] = 0
    place = np.arange(n)
    low = np.maximum(np.where(got[place // sample * sample] >= 0, got[place // sample * sample] - place % sample, 0), 0)
    nxt = np.minimum(place // sample * sample + sample, n)
    high = np.where((nxt < n) & (got[nxt] >= 0), got[nxt] + nxt - place, length + sample)
    sure = (low >= length) & (phi[:n] >= 0)
    open_ = np.flatnonzero(~sure & (high >= length) & (phi[:n] >= 0) & (phi[:n] < n))
    rest = open_[_common(data, words, open_ + low[open_], phi[open_] + low[open_], length) + low[open_] >= length]
    hit = np.zeros(n, dtype=bool)
    for own in (np.flatnonzero(sure), rest):
        own = own[valid[own]]
        hit[own] = True
        hit[phi[own]] = True
    return hit & valid


def shard_ranges(contents: list[bytes], length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(content, first, last) of the runs of its starts whose strings start elsewhere in the shard too."""
    sizes = np.array([len(c) for c in contents])
    data = np.frombuffer(b"\xff".join(contents) + b"\xff", dtype=np.uint8)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    valid = np.zeros(len(data) + 1, dtype=np.int64)
    np.add.at(valid, begin, 1)
    np.add.at(valid, begin + np.maximum(sizes - length + 1, 0), -1)
    hit = repeated_starts(data, np.cumsum(valid)[:-1] > 0, length)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    out = []
    for a, b in zip(edge[::2], edge[1::2]):
        k = int(np.searchsorted(begin, a, side="right")) - 1
        out.append((k, int(a - begin[k]), int(b - 1 - begin[k])))
    return out


def _text_ids(texts: Texts) -> np.ndarray:
    return texts.span_hashes(texts.offsets[:-1], texts.offsets[1:]).view(np.int64)


def _first_pass(documents: DataFrame, length: int) -> DataFrame:
    """Rows (doc_id, id, n_bytes, sha) of documents, and rows (id, key, start, many) of segments."""

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for first, texts in texts_of(batch.column("text")):
                n, o = texts.n, texts.offsets
                own = _text_ids(texts)
                sha = [hashlib.sha256(texts.data[o[k] : o[k + 1]]).hexdigest() for k in range(n)]
                seg = segments(texts, length)
                new = np.zeros(n, dtype=bool)
                new[np.unique(own, return_index=True)[1]] = True
                pick = new[seg["owner"]]
                m = int(pick.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([ids.slice(first, n), pa.nulls(m, pa.int64())]), pa.array(np.concatenate([own, own[seg["owner"][pick]]])),
                        pa.concat_arrays([pa.array(np.diff(o)), pa.nulls(m, pa.int64())]), pa.concat_arrays([pa.array(sha, pa.string()), pa.nulls(m, pa.string())]),
                        pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(seg["key"][pick].view(np.int64))]), pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(seg["start"][pick])]),
                        pa.concat_arrays([pa.nulls(n, pa.bool_()), pa.array(seg["many"][pick])]),
                    ],
                    names=["doc_id", "id", "n_bytes", "sha", "key", "start", "many"],
                )

    ship(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, id long, n_bytes long, sha string, key long, start long, many boolean")


def _filter(keys: DataFrame, column: str):
    """A broadcast bit filter of the hashes in a column, about 32 bits for each: (bits, array)."""
    bits = min(max((32 * keys.count()).bit_length(), LEAST_BITS), MOST_BITS)
    spread = F.col(column).bitwiseAND(F.lit((1 << bits) - 1)) + 1  # anchors are least hashes: only their low bits are even
    rows = keys.groupBy(F.bitmap_bucket_number(spread).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spread)).alias("v")).toLocalIterator()
    out = np.zeros((1 << bits) // 8 + 4096, dtype=np.uint8)
    for r in rows:
        out[(r.b - 1) * 4096 : r.b * 4096] = np.frombuffer(r.v, dtype=np.uint8)[: len(out) - (r.b - 1) * 4096]
    return bits, keys.sparkSession.sparkContext.broadcast(out)


def _passes(filter_: np.ndarray, bits: int, hashes: np.ndarray) -> np.ndarray:
    at = hashes.view(np.uint64) & np.uint64((1 << bits) - 1)
    return (filter_[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _second_pass(documents: DataFrame, bits: int, shared, length: int) -> DataFrame:
    """Segments whose anchors pass the filter: key, digest, id, start, size, many, and the content where a task's batch has it first."""

    def run(batches):
        have = shared.value
        for batch in batches:
            for _, texts in texts_of(batch.column("text")):
                own = _text_ids(texts)
                seg = segments(texts, length)
                new = np.zeros(texts.n, dtype=bool)
                new[np.unique(own, return_index=True)[1]] = True
                pick = np.flatnonzero(new[seg["owner"]] & _passes(have, bits, seg["key"]))
                if not len(pick):
                    continue
                owner = seg["owner"][pick]
                a = texts.offsets[owner] + seg["start"][pick]
                b = texts.offsets[owner] + seg["last"][pick] + length
                digest = texts.span_hashes(a, b)
                held = set(np.unique(np.column_stack([seg["key"][pick], digest]), axis=0, return_index=True)[1].tolist())
                content = [texts.data[x:y].tobytes() if k in held else None for k, (x, y) in enumerate(zip(a, b))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seg["key"][pick].view(np.int64)), pa.array(digest.view(np.int64)), pa.array(own[owner]), pa.array(seg["start"][pick]), pa.array(b - a), pa.array(seg["many"][pick]), pa.array(content, pa.binary())],
                    names=["key", "digest", "id", "start", "size", "many", "content"],
                )

    return documents.select("text").mapInArrow(run, "key long, digest long, id long, start long, size long, many boolean, content binary")


NO_PART = (("sub", pa.int64()), ("part", pa.int64()), ("size", pa.int64()), ("many", pa.bool_()), ("content", pa.binary()))


def _shards(heavy: DataFrame, length: int, most: int, gram: int | None = None) -> DataFrame:
    """(key, digest, first, last) of runs of repeated starts.

    Of anchors with more than most bytes instead (key, digest, first, sub, part, size, many, content) of the segments, of digest part, that
    anchors of gram bytes make of their contents; without gram (key, digest, first, sub) of every string.
    """

    def run(batches):
        group, group_key, group_many, size, wide, last = [], None, False, 0, None, None
        shard, shard_size = [], 0

        def finer(rows):
            for at in range(0, len(rows), 256):
                part = rows[at : at + 256]
                texts = Texts(np.frombuffer(b"".join(c for _, c in part), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(c) for _, c in part])]))
                digests = np.array([d for d, _ in part])
                if gram is None:
                    h = _gram_hashes(texts.data, length).view(np.int64)
                    n = np.diff(texts.offsets) - length + 1
                    off = np.concatenate([np.arange(x) for x in n])
                    yield batch_of(np.repeat(digests, n), group_key, off, None, [pa.array(h[np.repeat(texts.offsets[:-1], n) + off])])
                    continue
                seg = segments(texts, length, gram)
                a = texts.offsets[seg["owner"]] + seg["start"]
                b = texts.offsets[seg["owner"]] + seg["last"] + length
                new = [pa.array(seg["key"].view(np.int64)), pa.array(texts.span_hashes(a, b).view(np.int64)), pa.array(b - a), pa.array(seg["many"]), pa.array([texts.data[x:y].tobytes() for x, y in zip(a, b)], pa.binary())]
                yield batch_of(digests[seg["owner"]], group_key, seg["start"], None, new)

        def batch_of(digest, key, first, last_, new=()):
            m = len(digest)
            key = np.full(m, key) if np.isscalar(key) else np.asarray(key, dtype=np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(np.asarray(digest, dtype=np.int64)), pa.array(np.asarray(first, dtype=np.int64)),
                 pa.nulls(m, pa.int64()) if last_ is None else pa.array(np.asarray(last_, dtype=np.int64)), *new, *(pa.nulls(m, t) for _, t in NO_PART[len(new) :])],
                names=["key", "digest", "first", "last", *(c for c, _ in NO_PART)],
            )

        def flush():
            found = shard_ranges([c for _, _, c in shard], length)
            if found:
                yield batch_of([shard[k][1] for k, _, _ in found], [shard[k][0] for k, _, _ in found], [a for _, a, _ in found], [b for _, _, b in found])

        def close():
            nonlocal shard, shard_size
            if wide != group_key and (len(group) > 1 or group_many):
                shard += [(group_key, d, c) for d, c in group]
                shard_size += size
                if shard_size >= most:
                    yield from flush()
                    shard, shard_size = [], 0

        for batch in batches:
            keys, digests, many, contents = batch.column("key").to_numpy(), batch.column("digest").to_numpy(), batch.column("many").to_numpy(zero_copy_only=False), batch.column("content")
            for j in range(len(keys)):
                key = int(keys[j])
                if last == (key, digests[j]):
                    continue
                last = (key, digests[j])
                if key != group_key:
                    if group_key is not None:
                        if wide == group_key:
                            yield from finer(group)
                        yield from close()
                    group, group_key, group_many, size = [], key, False, 0
                c = contents[j].as_py()
                group.append((int(digests[j]), c))
                group_many |= bool(many[j])
                size += len(c)
                if size > most:
                    wide = key
                    yield from finer(group)
                    group, size = [], 0
        if group_key is not None:
            if wide == group_key:
                yield from finer(group)
            yield from close()
        if shard:
            yield from flush()

    dealt = heavy.select("key", "digest", "many", "content").repartition(F.col("key")).sortWithinPartitions("key", "digest")
    return dealt.mapInArrow(run, "key long, digest long, first long, last long, sub long, part long, size long, many boolean, content binary")


def _marks(found: DataFrame, place: list[str], length: int, most: int, grams: tuple[int, ...] = FINER) -> DataFrame:
    """(key, digest, first, last) of runs of starts whose strings start twice in found (key, digest, *place, size, many, content)."""
    at = F.struct(*place)
    ranges = written(_shards(found.where("content is not null"), length, most, grams[0] if grams else None))
    copies = found.groupBy("key", "digest").agg(F.min(at).alias("x"), F.max(at).alias("y"), F.max("size").alias("size")).where("x <> y")
    marks = ranges.where("sub is null").select("key", "digest", "first", "last")
    marks = marks.unionByName(copies.select("key", "digest", F.lit(0).cast("long").alias("first"), (F.col("size") - length).alias("last")))
    parts = ranges.where("sub is not null")
    if parts.isEmpty():
        return marks
    if not grams:
        twice = parts.groupBy("sub").agg(F.count("*").alias("n")).where("n > 1").select("sub")
        return marks.unionByName(parts.join(twice, "sub", "left_semi").select("key", "digest", "first", F.col("first").alias("last")))
    own = parts.select(F.col("sub").alias("key"), F.col("part").alias("digest"), F.struct("key", "digest").alias("of"), "first", "size", "many", "content")
    inner = _marks(own, ["of", "first"], length, most, grams[1:]).select(F.col("key").alias("sub"), F.col("digest").alias("part"), F.col("first").alias("a"), F.col("last").alias("b"))
    inner = parts.select("key", "digest", "first", "sub", "part").join(inner, ["sub", "part"])
    return marks.unionByName(inner.select("key", "digest", (F.col("first") + F.col("a")).alias("first"), (F.col("first") + F.col("b")).alias("last")))


def _cut(rows: DataFrame) -> DataFrame:
    """(id, n_removed, n_spans, kept_sha256, removed) of rows (id, text, spans)."""

    def run(batches):
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                data, runs = (text or "").encode(), []
                for s in sorted((x["a"], x["b"]) for x in spans):
                    if runs and s[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], s[1])
                    else:
                        runs.append([*s])
                kept, at = hashlib.sha256(), 0
                for a, b in runs:
                    kept.update(data[at:a])
                    at = b
                kept.update(data[at:])
                out.append((sum(b - a for a, b in runs), len(runs), kept.hexdigest(), ",".join(f"{a}:{b}" for a, b in runs)))
            columns = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string())))], names=["id", "n_removed", "n_spans", "kept_sha256", "removed"])

    return rows.select("id", "text", "spans").mapInArrow(run, "id long, n_removed long, n_spans long, kept_sha256 string, removed string")


def dedup(documents: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (start:end in bytes, comma-joined) for each row."""
    first = written(_first_pass(documents, length))
    rows, posts = first.where("key is null"), first.where("key is not null")
    place = F.struct("id", "start")
    shared_keys = posts.groupBy("key").agg(F.min(place).alias("x"), F.max(place).alias("y"), F.max("many").alias("many")).where("x <> y or many").select("key")
    shared_keys = written(shared_keys)
    bits, filter_ = _filter(shared_keys, "key")
    found = written(_second_pass(documents, bits, filter_, length))
    light = found.select("key", "digest", "id", "start", "size").distinct()
    marks = _marks(found, ["id", "start"], length, shard_bytes)
    spans = light.join(marks, ["key", "digest"]).select("id", (F.col("start") + F.col("first")).alias("a"), (F.col("start") + F.col("last") + length).alias("b"))
    many = rows.groupBy("id").agg(F.count("*").alias("n"), F.max("n_bytes").alias("n_bytes")).where(f"n > 1 and n_bytes >= {length}")
    spans = written(spans.groupBy("id").agg(F.collect_set(F.struct("a", "b")).alias("spans")).join(many, "id", "left_anti"))
    text_bits, text_filter = _filter(spans.select("id"), "id")

    def texts_with_spans(batches):
        have = text_filter.value
        for batch in batches:
            for at, texts in texts_of(batch.column("text")):
                own = _text_ids(texts)
                new = np.zeros(texts.n, dtype=bool)
                new[np.unique(own, return_index=True)[1]] = True
                pick = np.flatnonzero(new & _passes(have, text_bits, own))
                if len(pick):
                    yield pa.RecordBatch.from_arrays([pa.array(own[pick]), batch.column("text").take(pa.array(at + pick))], names=["id", "text"])

    texts = documents.select("text").mapInArrow(texts_with_spans, "id long, text string").dropDuplicates(["id"])
    cut = _cut(texts.join(spans, "id"))
    whole = many.select("id", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(""), 256).alias("kept_sha256"), F.concat(F.lit("0:"), "n_bytes").alias("removed"))
    out = rows.join(cut.unionByName(whole), "id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    discard(shared_keys)
    return out.select("doc_id", "n_bytes", zero("n_removed"), zero("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), F.coalesce("removed", F.lit("")).alias("removed"))
