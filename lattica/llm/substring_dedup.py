"""Suffix-array deduplication: remove each byte covered by a string of LENGTH bytes that also starts elsewhere.

Every LENGTH-byte window has an anchor, the least hash of its GRAM-byte strings, and equal windows have
the same anchor at the same place. So windows that repeat meet under their anchor's hash:

1. hashes of anchors are counted with partial sums; those that occur once are done before anything else is shipped;
2. anchors that repeat get a hash of their context, the bytes of all windows around them; equal contexts form a class,
   which one copy stands for, with the number of copies as its weight;
3. the contexts of anchors that belong together (same smallest text) are cut from their texts as runs and
   come to one task as one block; blocks hold whole groups and are bounded in size;
4. a block's suffixes are sorted, and threshold-bounded interval expansion on its Burrows-Wheeler transform
   finds the boundaries between suffixes whose common prefix is shorter than LENGTH: breadth first, by
   backward extension, in order of the prefix length, ending at LENGTH. What lies between two boundaries shares
   LENGTH bytes, and repeats if it has two places or one of a weight above 1;
5. the repeated window starts of a class hold at every occurrence of it, and cover bytes of its text.

A group of more than GROUP_MAX contexts is split: first by anchor; the contexts of one anchor by cells of neighbouring
window starts and the bytes that a cell's windows share, so that windows that are equal stay together. Equal cells are one,
of the weight of their number. Such a group goes to a block like any other. Of one with still more than GROUP_MAX unlike
cells, which all share LENGTH - PARTS[0] + 1 bytes, cells of weight 1 are split into smaller ones, down to single windows:
these are strings of LENGTH bytes, and their weight says whether they repeat.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, free_name, keep_only, map_rows, materialize, mix64, powers, release, slices

LENGTH, GRAM = 200, 100
SPAN = LENGTH - GRAM + 1  # windows that contain an anchor start in [anchor - SPAN + 1, anchor]
GROUP_MAX = 3_000  # contexts in a block's group
BLOCK_BYTES = 400_000  # a block is full then; its last group may go beyond by GROUP_MAX contexts
STRETCH = 24_000  # bytes of texts whose anchors are found together
PIECE = 65_000  # bytes of a text whose anchors are found at a time
PARTS = (21, 7, 1)  # neighbouring window starts in a cell, where an anchor has too many contexts


def _slide(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    f, done = (np.minimum if least else np.maximum), 1
    n = len(x) - width + 1
    while done * 2 <= width:
        x = f(x[:-done], x[done:])
        done *= 2
    return f(x[:n], x[width - done : width - done + n])


def anchors_of(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places and hashes of each text's anchors: all places with the least hash in some window of that text. Texts longer than
    PIECE are gone through in pieces that share LENGTH - 1 bytes, so that every window lies in one."""
    out, at, size = [], 0, 0
    for i, data in enumerate(texts):
        if len(data) > PIECE:
            out += (_anchors(texts[at:i]) if at < i else []) + [_anchors_in_pieces(data)]
            at, size = i + 1, 0
            continue
        size += len(data)
        if size >= STRETCH:
            out += _anchors(texts[at : i + 1])
            at, size = i + 1, 0
    return out + (_anchors(texts[at:]) if at < len(texts) else [])


def _anchors_in_pieces(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    ats, hashes = [], []
    for start in range(0, len(data) - LENGTH + 1, PIECE):
        ((at, h),) = _anchors([data[start : start + PIECE + LENGTH - 1]])
        ats.append(at + start)
        hashes.append(h)
    if not ats:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at, first = np.unique(np.concatenate(ats), return_index=True)
    return at, np.concatenate(hashes)[first]


def _anchors(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """One stretch of texts behind each other: hashes of all strings of GRAM bytes from sums of powers, windows within a text only."""
    ends = np.cumsum([len(t) for t in texts])
    n = int(ends[-1])
    if n < LENGTH:
        return [(np.zeros(0, np.int64), np.zeros(0, np.uint64))] * len(texts)
    sums = np.zeros(n + 1, np.uint64)
    np.multiply(powers(n), np.frombuffer(b"".join(texts), np.uint8), out=sums[1:])
    np.cumsum(sums, out=sums)
    h = sums[GRAM:] - sums[:-GRAM]
    h *= powers(n, inverse=True)[: len(h)]
    h = mix64(h)
    short = (h >> np.uint64(32)).astype(np.uint32)  # half the bytes to compare; ties only add anchors
    short |= np.uint32(1)
    least, edge = _slide(short, SPAN, True), np.zeros(SPAN - 1, np.uint32)
    for start, end in zip([0, *ends.tolist()], ends.tolist()):
        least[max(start, end - LENGTH + 1) : end] = 0  # such windows reach into the next text
    at = np.flatnonzero(short == _slide(np.concatenate([edge, least, edge]), SPAN, False))
    cut = np.searchsorted(at, ends)
    return [(at[a:b] - start, h[at[a:b]]) for a, b, start in zip([0, *cut.tolist()], cut.tolist(), [0, *ends.tolist()])]


def contexts(data: bytes, at: np.ndarray) -> np.ndarray:
    """A hash of the bytes of all windows around each anchor, and of where in them the anchor is."""
    digest, left = xxhash.xxh3_64_intdigest, SPAN - 1
    return np.array([digest(data[max(0, a - left) : a + LENGTH], min(a, left)) for a in at.tolist()], np.uint64)


def suffix_classes(runs: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorts the suffixes of all runs by their first `depth` or more symbols, each run ended by a symbol of its own.

    Returns (order, class start by suffix rank place, text codes, run of each place, end of each place's run).
    """
    m = len(runs)
    lengths = np.array([len(r) + 1 for r in runs])
    ends = np.cumsum(lengths) - 1
    n = int(ends[-1]) + 1
    codes = np.frombuffer(b"\0".join([*runs, b""]), np.uint8).astype(np.int64) + 1
    codes[ends] = 0
    run = np.repeat(np.arange(m, dtype=np.int32), lengths)
    end = ends[run].astype(np.int32)
    place = np.arange(n, dtype=np.int32)
    key = np.zeros(n, np.int64)
    for j in range(7):
        key *= 257
        key += codes[np.minimum(place + np.int32(j), end)]
    order = np.argsort(key).astype(np.int32)
    k = key[order]
    short = np.flatnonzero(k % 257 == 0)  # suffixes that end within the key: in the order of their runs
    order[short] = order[short][np.lexsort((order[short], k[short]))]
    new = np.append(True, (k[1:] != k[:-1]) | (k[1:] % 257 == 0))  # the ends of runs differ from each other
    rank = np.empty(n, np.int32)
    starts = np.maximum.accumulate(np.where(new, place, 0))
    rank[order] = starts
    done = 7
    while done < depth:
        last = np.append(new[1:], True)
        slots = np.flatnonzero(~(new & last))
        if not len(slots):
            break
        sub = order[slots]
        key = (rank[sub].astype(np.int64) << 32) | rank[np.minimum(sub + np.int32(done), end[sub])]
        o = np.argsort(key)
        sub, key = sub[o], key[o]
        order[slots] = sub
        new[slots] = np.append(True, key[1:] != key[:-1])
        starts[slots] = np.maximum.accumulate(np.where(new[slots], slots, 0))
        rank[sub] = starts[slots]
        done *= 2
    return order, starts.astype(np.int32), codes, run, end


def boundaries(order: np.ndarray, starts: np.ndarray, codes: np.ndarray, length: int) -> np.ndarray:
    """For suffixes in order: whether each one's common prefix with the one before is shorter than `length`.

    Intervals of suffixes that begin with a string w are extended backward by each symbol c before them; the end of
    the interval of cw is a boundary with prefix length |w|. Only intervals that found a new boundary are extended further.
    Suffixes of one class (equal to the depth they were sorted, at least `length`) may stand in any order: interval ends
    are taken at their class's ends.
    """
    n = len(order)
    rank_of = np.empty(n, np.int32)
    rank_of[order] = np.arange(n, dtype=np.int32)
    before = order - 1
    inside = (before >= 0) & (codes[before] > 0)  # a run's first place has no symbol before it
    symbol = np.where(inside, codes[before], 0).astype(np.uint16)
    place = rank_of[before]
    class_end = np.empty(n, np.int32)
    first = np.append(np.flatnonzero(starts == np.arange(n)), n)
    class_end = np.repeat(first[1:] - 1, np.diff(first)).astype(np.int32)
    low, high = starts[place], class_end[place]
    by = np.argsort(symbol, kind="stable").astype(np.int32)
    same = symbol[by][1:] == symbol[by][:-1]
    nxt, prv = np.full(n, n, np.int32), np.full(n, -1, np.int32)
    nxt[by[:-1][same]] = by[1:][same]
    prv[by[1:][same]] = by[:-1][same]
    found = np.zeros(n + 1, bool)
    head = codes[order]
    found[: n][np.append(True, (head[1:] != head[:-1]) | (head[1:] == 0))] = True
    found[n] = True
    lb = np.flatnonzero(found[:n])
    rb = np.append(lb[1:], n) - 1
    for _ in range(1, length):
        size = rb - lb + 1
        at = np.arange(int(size.sum())) + np.repeat(lb - (np.cumsum(size) - size), size)
        ok = inside[at]
        last = at[ok & (nxt[at] > np.repeat(rb, size))]
        first_ = at[ok & (prv[at] < np.repeat(lb, size))]
        rb, lb = np.sort(high[last]).astype(np.int64), np.sort(low[first_]).astype(np.int64)
        fresh = ~found[rb + 1]
        rb, lb = rb[fresh], lb[fresh]
        if not len(rb):
            break
        found[rb + 1] = True
    return found[:n]


def repeated_starts(runs: list[bytes], groups: np.ndarray, length: int = LENGTH, heavy: list[np.ndarray] | None = None) -> list[np.ndarray]:
    """For every run the places where a string of `length` bytes starts that also starts at another place of the same group.

    heavy: for every run flags of its places (one more than it has bytes) that stand for several."""
    if not runs:
        return []
    order, starts, codes, run, end = suffix_classes(runs, length)
    edge = boundaries(order, starts, codes, length)
    cls = np.cumsum(edge)
    weight = None if heavy is None else np.concatenate(heavy)
    x = np.flatnonzero(~(edge & np.append(edge[1:], True)) | (False if weight is None else weight[order]))
    pos = order[x]
    pos, x = pos[end[pos] - pos >= length], x[end[pos] - pos >= length]
    key = cls[x].astype(np.int64) * (int(groups.max()) + 1) + groups[run[pos]]
    o = np.argsort(key, kind="stable")
    k = key[o]
    at = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    count = np.diff(np.append(at, len(k)))
    if weight is not None and len(at):
        count = count + np.maximum.reduceat(weight[pos[o]], at)
    out = np.zeros(len(codes), bool)
    out[pos[o[np.repeat(count > 1, np.diff(np.append(at, len(k))))]]] = True
    lengths = np.array([len(r) + 1 for r in runs])
    return np.split(out, np.cumsum(lengths)[:-1])


def _ranges(flags: np.ndarray) -> list[int]:
    """Flat [from, to) pairs of the set flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge.tolist()


def _anchor_names(texts: DataFrame) -> DataFrame:
    """(h, n): hashes of anchors and how often they occur, counted in small batches."""

    def run(batches):
        for b in batches:
            h, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *(h for _, h in anchors_of([t.encode() for t in b["text"]]))]), return_counts=True)
            yield {"h": h.view(np.int64), "n": n}

    return map_rows(texts.select("text"), run, "h long, n long", rows=1024)


def _anchor_rows(texts: DataFrame) -> DataFrame:
    """(h, s, key, at, n): hash and context hash of every anchor, its text's key, its place and in how many equal texts of a batch it stands."""

    def run(batches):
        for b in batches:
            copies, first = Counter(b["key"]), dict(zip(b["key"], b["text"]))
            texts = [t.encode() for t in first.values()]
            own = [(k, d, *x) for k, d, x in zip(first, texts, anchors_of(texts)) if len(x[0])]
            if own:
                yield {
                    "h": np.concatenate([h for *_, h in own]).view(np.int64),
                    "s": np.concatenate([contexts(d, at) for _, d, at, _ in own]).view(np.int64),
                    "key": np.concatenate([np.full(len(at), k) for k, _, at, _ in own]),
                    "at": np.concatenate([at for _, _, at, _ in own]),
                    "n": np.concatenate([np.full(len(at), copies[k]) for k, _, at, _ in own]),
                }

    return map_rows(texts.select("key", "text"), run, "h long, s long, key long, at int, n int", rows=1024)


_RUN = "grp long, key long, start int, data binary, h array<long>, s array<long>, at array<int>, many array<boolean>"


def _runs(joined: DataFrame) -> DataFrame:
    """(key, text, items) to runs of contexts by group, merged where they touch, with the anchors in them; contexts without a group one by one."""

    def run(batches):
        for b in batches:
            out = {c: [] for c in ("grp", "key", "start", "data", "h", "s", "at", "many")}

            def add(grp, key, data, part):
                start, end = max(0, part[0]["at"] - SPAN + 1), part[-1]["at"] + LENGTH
                for c, v in zip(out, (grp, key, start, data[start:end], [i["h"] for i in part], [i["s"] for i in part], [i["at"] - start for i in part], [i["cnt"] > 1 for i in part])):
                    out[c].append(v)

            for key, text, items in zip(b["key"], b["text"], b["items"]):
                data, by = text.encode(), {}
                for i in sorted(items, key=lambda i: i["at"]):
                    if i["grp"] is None:
                        add(None, key, data, [i])
                    else:
                        by.setdefault(i["grp"], []).append(i)
                for grp, own in by.items():
                    at = 0
                    for to in range(1, len(own) + 1):
                        if to == len(own) or own[to]["at"] - SPAN + 1 > own[to - 1]["at"] + LENGTH:
                            add(grp, key, data, own[at:to])
                            at = to
            yield out

    return map_rows(joined, run, _RUN, rows=64)


def _blocks(runs: DataFrame) -> DataFrame:
    """(h, s, starts): flat pairs of repeated window starts relative to the anchor."""

    def solve(rows):
        ids: dict[int, int] = {}
        groups = [ids.setdefault(r[0], len(ids)) for r in rows]
        out, heavy, ats = {"h": [], "s": [], "starts": []}, [], []
        for r in rows:
            at = np.asarray(r[6])
            ats.append((np.maximum(0, at - SPAN + 1), at))
            lo, hi, n = *(x[np.asarray(r[7], bool)] for x in ats[-1]), len(r[3]) + 1
            heavy.append(np.cumsum(np.bincount(lo, minlength=n + 1)[:n] - np.bincount(np.minimum(hi + 1, n), minlength=n + 1)[:n]) > 0)
        for r, (lo, at), f in zip(rows, ats, repeated_starts([r[3] for r in rows], np.array(groups), LENGTH, heavy)):
            upto = np.concatenate([[0], np.cumsum(f)])
            some = upto[np.minimum(at + 1, len(f))] - upto[lo]
            for h, s, l, a, n in zip(r[4], r[5], lo.tolist(), at.tolist(), some.tolist()):
                if n:
                    out["h"].append(h)
                    out["s"].append(s)
                    out["starts"].append([l - a, 1] if n == a + 1 - l else [x + l - a for x in _ranges(f[l : a + 1])])
        return out

    def run(batches):
        rows, size, group, before = [], 0, None, None
        for b in batches:
            for r in zip(*(b[c] for c in ("grp", "key", "start", "data", "h", "s", "at", "many"))):
                if r[:3] == before:  # repeated input rows
                    continue
                before = r[:3]
                if r[0] != group and size > BLOCK_BYTES:
                    yield solve(rows)
                    rows, size = [], 0
                group = r[0]
                rows.append(r)
                size += len(r[3])
        if rows:
            yield solve(rows)

    return map_rows(runs.repartition("grp").sortWithinPartitions("grp", "key", "start"), run, "h long, s long, starts array<int>")


def _cells(hot: DataFrame, outer: int, width: int) -> DataFrame:
    """(w, v, whole, h, s, off, many) for every cell of `width` window starts within those of `outer` that hot.offs name: hashes of
    the bytes that its windows share (128 bits) and of all their bytes."""

    def run(batches):
        for b in batches:
            out = {c: [] for c in ("w", "v", "whole", "h", "s", "off", "many")}
            for data, h, s, a, many, offs in zip(b["data"], b["h"], b["s"], b["at"], b["many"], b["offs"]):
                for o in (o for off in offs for o in range(off, min(off + outer, 1), width)):
                    # from the last window's start to the first one's end; beyond the text's ends no window is whole
                    last = a + min(o + width - 1, 0)
                    if last < 0 or a + o + LENGTH > len(data):
                        continue
                    x, y = xxhash.xxh3_128_intdigest(data[last : a + o + LENGTH]), xxhash.xxh3_64_intdigest(data[max(0, a + o) : last + LENGTH], max(0, -a - o))
                    for c, v in zip(out, ((x >> 64) - (1 << 63), (x & (1 << 64) - 1) - (1 << 63), y - (1 << 63), h, s, o, many)):
                        out[c].append(v)
            yield out

    return map_rows(hot, run, "w long, v long, whole long, h long, s long, off int, many boolean", rows=64)


def _split(hot: DataFrame, base: DataFrame, outer: int = SPAN, widths: tuple[int, ...] = PARTS) -> tuple[DataFrame, list[DataFrame]]:
    """hot (h, s, at, many, data, offs: cells to split) to (h, s, starts) of contexts that do not stand for several; and tables to drop when it is read.
    base: (h, s, at, data), a row a context."""
    width, rest = widths[0], widths[1:]
    same = ["w", "v", "h", "off"]
    rows = materialize(_cells(hot, outer, width).withColumn("cell", F.xxhash64(*same, "whole")), "cells")
    cells = rows.groupBy("cell", *same).agg(F.count("*").alias("n"), F.max("many").alias("many"), F.min("s").alias("s")).withColumn("many", F.col("many") | (F.col("n") > 1))
    cells = materialize(cells, "unlike-cells")
    groups = materialize(cells.groupBy(*same).agg(F.count("*").alias("unlike"), F.sum("n").alias("members")).filter("members > 1").select(*same, "unlike"), "cell-groups")
    # one of each unlike cell, with its weight and its group's size
    cells = materialize(cells.join(groups, same).select("cell", "h", "s", "off", "many", "unlike", F.xxhash64(*same).alias("grp")), "grouped-cells")
    whole, more = F.array(F.col("off"), F.least(F.col("off") + width, F.lit(1))), None
    if not rest:  # strings of LENGTH bytes
        found, drop = cells.filter("many").select("cell", whole.alias("starts")), [rows, groups, cells]
    else:
        lo = F.greatest(F.lit(0), F.col("at") + F.col("off"))
        hi = F.least(F.octet_length("data"), F.col("at") + F.least(F.col("off") + (width - 1), F.lit(0)) + LENGTH)
        few = cells.filter(F.col("unlike") <= GROUP_MAX).withColumnRenamed("many", "cell_many").join(base, ["h", "s"])
        few = few.select("grp", F.col("cell").alias("key"), F.lit(0).alias("start"), F.substring("data", lo + 1, hi - lo).alias("data"), F.array("cell").alias("h"), F.array("s").alias("s"), F.array(F.col("at") - lo).alias("at"), F.array("cell_many").alias("many"))
        found, drop = _blocks(few).select(F.col("h").alias("cell"), "starts"), [rows, groups, cells]
        crowd = cells.filter(F.col("unlike") > GROUP_MAX)
        if not crowd.isEmpty():
            found = found.unionByName(crowd.filter("many").select("cell", whole.alias("starts")))
            own = crowd.groupBy("h", "s").agg(F.collect_list("off").alias("offs"), F.collect_list(F.when(F.col("many"), F.col("off"))).alias("heavy"))
            # a cell of a weight is a partner of others for all its windows; its context may hold cells of weight 1 too
            each = own.join(base, ["h", "s"])
            light = each.select("h", "s", "at", "data", F.lit(False).alias("many"), F.array_except("offs", "heavy").alias("offs"))
            heavy = each.select("h", "s", "at", "data", F.lit(True).alias("many"), F.col("heavy").alias("offs"))
            deeper = materialize(light.unionByName(heavy).filter("size(offs) > 0"), "hot")
            more, also = _split(deeper, base, width, rest)
            drop += [deeper, *also]
    found = materialize(found, "found-cells")
    # a context of weight 1 that a smaller cell is told of is the only one of its larger cell
    out = rows.filter("NOT many").join(found, "cell").select("h", "s", "starts")
    return (out if more is None else out.unionByName(more)), [*drop, found]


def repeated_spans(texts: DataFrame) -> DataFrame:
    """texts (doc_id, key, text), key a hash of the text: (key, starts), flat [from, to) pairs of the repeated window starts of a text, in a table of the shared folder."""
    spark = texts.sparkSession
    repeat = materialize(_anchor_names(texts).groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h"), "repeating")
    release(spark)
    held = materialize(_anchor_rows(texts).join(repeat, "h", "left_semi"), "anchors")
    discard(repeat)
    release(spark)
    classes = held.groupBy("h", "s").agg(F.sum("n").alias("cnt"), F.min(F.struct("key", "at")).alias("ref"))
    classes = materialize(classes.select("h", "s", "cnt", "ref.key", "ref.at"), "classes")
    names = classes.groupBy("h").agg(F.count("*").alias("n_classes"), F.min("key").alias("label"))
    per_label = names.groupBy("label").agg(F.sum("n_classes").alias("n_label"))
    # a label's contexts, if they are few enough; else those of one anchor; else they are split further
    grp = F.when(F.col("n_label") <= GROUP_MAX, F.col("label")).when(F.col("n_classes") <= GROUP_MAX, F.xxhash64("label", "h"))
    names = materialize(names.join(per_label, "label").select("h", grp.alias("grp")), "names")
    del per_label
    release(spark)
    # where contexts are split further, one that stands for several is also decided by itself
    own = F.when(F.col("grp").isNull() & (F.col("cnt") > 1), F.array(F.lit(None).cast("long"), F.xxhash64("h", "s"))).otherwise(F.array("grp"))
    items = classes.join(names, "h").withColumn("grp", F.explode(own)).groupBy("key").agg(F.collect_list(F.struct("h", "s", "at", "cnt", "grp")).alias("items"))
    # every class has one text to read it from
    lists = materialize(items.join(texts.groupBy("key").agg(F.min("doc_id").alias("first")), "key"), "lists")
    discard(classes)
    discard(names)
    del classes, names, items
    release(spark)
    runs = materialize(_runs(texts.join(lists, "key").filter(F.col("doc_id").eqNullSafe(F.col("first"))).select("key", "text", "items")), "runs")
    discard(lists)
    release(spark)
    found, drop = _blocks(runs.filter("grp IS NOT NULL")), [runs, held]
    hot = runs.filter("grp IS NULL")
    if not hot.isEmpty():
        hot = hot.select(F.col("h")[0].alias("h"), F.col("s")[0].alias("s"), F.col("at")[0].alias("at"), F.col("many")[0].alias("many"), "data", F.array(F.lit(1 - SPAN)).alias("offs"))
        hot = materialize(hot.dropDuplicates(["h", "s"]), "hot")
        more, also = _split(hot, hot.select("h", "s", "at", "data"))
        found, drop = found.unionByName(more), [*drop, hot, *also]
        del more, also
    found = materialize(found, "repeats")
    release(spark)
    starts = F.transform("starts", lambda x: x + F.col("at"))
    spans = held.select("h", "s", "key", "at").distinct().join(found, ["h", "s"]).select("key", starts.alias("starts"))
    spans = materialize(spans.groupBy("key").agg(F.flatten(F.collect_list("starts")).alias("starts")), "spans")
    for done in (*drop, found):
        discard(done)
    release(spark)
    return spans


def covered(size: int, starts: np.ndarray | None) -> np.ndarray:
    """Flat [from, to) pairs of the bytes that windows cover which start in these [from, to) pairs and are whole."""
    if starts is None or not len(starts):
        return np.zeros(0, np.int64)
    x = np.clip(np.asarray(starts), 0, size - LENGTH + 1)
    lo, hi = x[::2][x[::2] < x[1::2]], x[1::2][x[::2] < x[1::2]]
    mark = np.bincount(lo, minlength=size + 1) - np.bincount(hi - 1 + LENGTH, minlength=size + 1)
    return np.flatnonzero(np.diff(np.concatenate([[False], np.cumsum(mark)[:-1] > 0, [False]]).astype(np.int8)))


def kept_bytes(data: bytes, edges: np.ndarray) -> bytes:
    cuts = [0, *edges.tolist(), len(data)]
    return b"".join(data[a:b] for a, b in zip(cuts[::2], cuts[1::2]))


def _with_starts(docs: DataFrame, text_col: str, id_col: str) -> tuple[DataFrame, str]:
    """docs with one more column, and its name: where windows of its text start that repeat."""
    clear = F.coalesce(F.col(text_col), F.lit(""))
    key, starts = free_name(docs, "key"), free_name(docs, "starts")
    spans = repeated_spans(docs.select(F.col(id_col).cast("long").alias("doc_id"), clear.alias("text"), F.xxhash64(clear).alias("key")))
    return docs.withColumn(key, F.xxhash64(clear)).join(spans.withColumnsRenamed({"key": key, "starts": starts}), key, "left").drop(key), starts


def dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (flat [from, to) byte pairs), kept_sha256 for every row.

    Texts are UTF-8 bytes, null ones empty; strings are judged on the input and never cross texts. Texts of fewer than
    LENGTH bytes stay whole; repeated rows repeat each other. An empty table gives an empty result. Rows are told apart
    by a 64-bit hash of the text, contexts by 128 bits.
    """

    def run(batches):
        for b in batches:
            out = {"doc_id": b["doc_id"], "n_bytes": [], "n_removed": [], "n_spans": [], "spans": [], "kept_sha256": []}
            texts = [t.encode() for t in b["text"]]
            for data, starts in zip(texts, b["starts"]):
                edges = covered(len(data), starts)
                kept = kept_bytes(data, edges)
                for c, v in zip(("n_bytes", "n_removed", "n_spans", "spans", "kept_sha256"), (len(data), len(data) - len(kept), len(edges) // 2, edges.tolist(), hashlib.sha256(kept).hexdigest())):
                    out[c].append(v)
            yield out

    rows, starts = _with_starts(docs.select(id_col, text_col), text_col, id_col)
    rows = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(starts).alias("starts"))
    return map_rows(rows, run, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<int>, kept_sha256 string", rows=64)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """docs with repeated bytes taken out of the text (a character that lost some of its bytes goes too) and the number of characters set anew.

    Texts of fewer than LENGTH bytes, empty and null ones stay as they are; repeated rows repeat each other and all lose their
    text; a row of no doc_id counts like any other. An empty table gives an empty result.
    """
    names = docs.columns
    at, chars = names.index(text_col), names.index(chars_col) if chars_col in names else None
    schema = docs.schema

    def run(batches):
        keep_only()
        for batch in batches:
            for b in slices(batch, 64):
                cols = [b.column(j) for j in range(len(names))]
                out = []
                texts = cols[at].to_pylist()
                for text, starts in zip(texts, b.column(len(names)).to_pylist()):
                    if not starts:
                        out.append(text)
                        continue
                    data = text.encode()
                    out.append(kept_bytes(data, covered(len(data), starts)).decode(errors="ignore"))
                cols[at] = pa.array(out, cols[at].type)
                if chars is not None:
                    cols[chars] = pa.array([None if t is None else len(t) for t in out], pa.int64()).cast(cols[chars].type)
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return _with_starts(docs, text_col, id_col)[0].mapInArrow(run, schema)
