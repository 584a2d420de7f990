"""Near-duplicates: improved consistent weighted sampling over TF-IDF shingles, banded, verified.

Weights: a shingle's term frequency times its IDF, ln(N / df) / ln(1 / COMMON) and 1 at most. So all
shingles in at most a share COMMON of the documents weigh alike, and the weight falls to 0 for one in
every document. Only shingles beyond COMMON need their document frequency, and there are at most
1 / COMMON times the mean number of shingles of a document, whatever the number of documents: that
bounds what is broadcast.

Documents of the same words are one node. Nodes that share a band are linked to two nodes of the
band, pairs that bit maps of their shingles do not rule out are verified by their weighted Jaccard similarity, and bands that then still hold
several components are linked anew, by other nodes, across components only. Of bands that remain so all
pairs across components are compared, but for nodes that cannot have a partner: with shingles in one order, rare
ones first, two nodes that reach the threshold share a shingle of the short prefix of the smaller and the prefix of
the larger. Long bit maps of their shingles, block by block, leave pairs close to the threshold; these are verified
where they meet, and only links that join two components are rows.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, discard, map_rows, materialize, mix64, powers, release, shingle_hashes, texts_of
from .graph import components

COMMON = 0.01
CHUNK_DOCS = 2000
_TABLE_BITS = 16
_COUNT_BITS = 20
_COUNT_SLICES = 64
_MAP_BITS = 512
_WIDE_MIN, _WIDE_MAX = 9, 20  # powers of two of the places of a long map
_BLOCK_NODES, _BLOCK_BYTES = 1000, 4_000_000  # what a block of a crowded band holds, about
SLACK = 1 + 1e-9  # for sums of weights in another order


class SampleTables:
    """The random draws of the sampling: r and c from Gamma(2, 1), beta uniform, by 16 bits of a shingle's
    k-th hash; the hash's other bits break ties, alike in every document."""

    def __init__(self, n: int, seed: int = 7):
        g = np.random.Generator(np.random.PCG64(seed))
        size = 1 << _TABLE_BITS
        self.r, self.log_c, self.beta = g.gamma(2, 1, size), np.log(g.gamma(2, 1, size)), g.random(size)
        self.unit = self.log_c + self.r * self.beta - self.r  # of weight 1
        self.odd = mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)

    def sample(self, k: int, h: np.ndarray, log_w: np.ndarray, plain: np.ndarray | None, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The k-th sample, (shingle, level) as one number, of every set; sets are runs of h that start at `first`. plain: log_w is not 0 there."""
        x = h * self.odd[k]
        at = (x >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)
        value = self.unit[at]
        level = None
        if plain is not None:
            a = at[plain]
            t = np.floor(log_w[plain] / self.r[a] + self.beta[a])
            value[plain] = self.log_c[a] - self.r[a] * (t - self.beta[a]) - self.r[a]
            level = np.zeros(len(h), np.int64)
            level[plain] = t.astype(np.int64)
        value += (x & np.uint64(0xFFFFFFFF)).astype(np.float64) * 1e-14
        low = np.minimum.reduceat(value, first)
        hit = np.flatnonzero(value == np.repeat(low, counts))
        pick = hit[np.searchsorted(hit, first)]
        got = h[pick]
        return got if level is None else got ^ mix64(level[pick].astype(np.uint64))


def unique_shingles(shingles: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text (sorted), their frequencies, and their number per text."""
    doc = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((shingles, doc))
    s, d = shingles[order], doc[order]
    new = np.append(True, (s[1:] != s[:-1]) | (d[1:] != d[:-1])) if len(s) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return s[at], np.diff(np.append(at, len(s))), np.bincount(d[at], minlength=len(counts))


class Weights:
    """log weights of shingles; shingles in every document weigh nothing and are left out."""

    def __init__(self, common: np.ndarray, df: np.ndarray, n: int):
        order = np.argsort(common)
        self.common, self.idf = common[order], np.minimum(1.0, np.log(n / df[order]) / log(1 / COMMON)) if len(df) else df

    def of(self, s: np.ndarray, tf: np.ndarray) -> np.ndarray:
        w = tf.astype(np.float64)
        if len(self.common):
            i = np.minimum(np.searchsorted(self.common, s), len(self.common) - 1)
            hit = self.common[i] == s
            w[hit] *= self.idf[i[hit]]
        return w


def content_hashes(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A signed 64-bit hash of each text's words."""
    out = counts.astype(np.uint64)
    if len(words):
        n = int(counts.max())
        first = np.cumsum(counts) - counts
        place = np.arange(len(words)) - np.repeat(first, counts)
        some = counts > 0
        out[some] += np.add.reduceat(words * powers(n)[place], first[some])
    return mix64(out + np.uint64(1)).view(np.int64)


def common_shingles(texts: DataFrame, k: int) -> tuple[int, list[tuple[int, int]]]:
    """(number of documents, [(shingle, document frequency)]) for shingles in more than a share COMMON of them.

    Each chunk reports shingles beyond half that share of its own documents. One beyond COMMON overall is then
    reported often enough that the reported sum exceeds half of COMMON, and few are; their counts are taken exactly.
    """

    def local(batches):
        hasher, hashes, n = WordHasher(), [], 0

        def flush():
            s, c = np.unique(np.concatenate(hashes), return_counts=True)
            big = c > COMMON / 2 * n
            return {"s": [0, *s[big].view(np.int64).tolist()], "df": [0, *c[big].tolist()], "n": [n, *[0] * int(big.sum())]}

        for b in batches:
            s, _, _ = unique_shingles(*shingle_hashes(*hasher.words(b["text"]), k))
            hashes.append(s)
            n += len(b["text"])
            if n >= CHUNK_DOCS or sum(map(len, hashes)) > 4_000_000:
                yield flush()
                hashes, n = [], 0
        if n:
            yield flush()

    rows = materialize(map_rows(texts, local, "s long, df long, n long", rows=128), "local-df")
    n = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = [r.s for r in rows.filter("n = 0").groupBy("s").agg(F.sum("df").alias("df")).filter(F.col("df") > COMMON / 2 * n).collect()]
    if not found:
        return n, []
    wanted = np.sort(np.array(found, np.int64).view(np.uint64))

    def exact(batches):
        hasher, counts = WordHasher(), np.zeros(len(wanted), np.int64)
        for b in batches:
            s, _, _ = unique_shingles(*shingle_hashes(*hasher.words(b["text"]), k))
            i = np.minimum(np.searchsorted(wanted, s), len(wanted) - 1)
            counts += np.bincount(i[wanted[i] == s], minlength=len(wanted))
        yield {"s": wanted.view(np.int64).tolist(), "df": counts.tolist()}

    sums = map_rows(texts, exact, "s long, df long", rows=128).groupBy("s").agg(F.sum("df").alias("df")).filter(F.col("df") > COMMON * n)
    return n, [(r.s, r.df) for r in sums.collect()]


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(a[1][i], b[1][j]).sum()
    high = a[1].sum() + b[1].sum() - low
    return float(low / high) if high else 1.0


def bit_maps(s: np.ndarray, w: np.ndarray, counts: np.ndarray, bits: int = _MAP_BITS) -> np.ndarray:
    """A row of numbers for every text, three maps of so many bits behind each other: the places of its shingles of weight 1 and
    more, those of 1/2 and more (without the places before), and those of any shingle that weighs something."""
    doc, at = np.repeat(np.arange(len(counts)), counts), ((s >> np.uint64(9)) % np.uint64(bits)).astype(np.int64)
    maps = np.zeros((len(counts), 3, bits), np.uint8)
    for i, some in enumerate((w >= 1.0, w >= 0.5, w > 0)):
        maps[doc[some], i, at[some]] = 1
    maps[:, 1] &= 1 - maps[:, 0]
    return np.packbits(maps.reshape(len(counts), -1), axis=1, bitorder="little").view(np.int64)


def may_reach(x: str, y: str, threshold: float) -> Column:
    """Whether two nodes (size, map) can be similar enough. A place that x has and y has not stands for at least one shingle
    that they do not share, of weight 1 or 1/2 at least by the map it is in: what is left of x bounds what they share, and at
    the threshold they share threshold / (1 + threshold) of both sizes. Sound for any texts; it says little of those that fill their maps."""
    words = _MAP_BITS // 64
    need = F.lit(threshold / (1 + threshold) / SLACK) * (F.col(f"{x}.size") + F.col(f"{y}.size"))

    def rest(a: str, b: str) -> Column:
        def absent(which: int) -> Column:
            return sum((F.bit_count(F.col(f"{a}.map")[which * words + i].bitwiseAND(F.bitwise_not(F.col(f"{b}.map")[2 * words + i]))) for i in range(words)), F.lit(0))

        return F.col(f"{a}.size") - absent(0) - absent(1) / 2

    sizes = F.least(f"{x}.size", f"{y}.size") * SLACK >= F.lit(threshold) * F.greatest(f"{x}.size", f"{y}.size")
    return sizes & (rest(x, y) >= need) & (rest(y, x) >= need)


def wide_map(s: np.ndarray, w: np.ndarray) -> np.ndarray:
    """bit_maps of one text with about eight places and more for each unit of its weight."""
    power = int(np.ceil(np.log2(max(8 * float(w.sum()), 1))))
    return bit_maps(s, w, np.array([len(s)]), 1 << min(max(power, _WIDE_MIN), _WIDE_MAX)).reshape(3, -1)


def folded(maps: np.ndarray, words: int) -> np.ndarray:
    """Maps (texts, 3, words) with fewer words: a place stands for all that fall on it."""
    while maps.shape[2] > words:
        half = maps.shape[2] // 2
        maps = maps[:, :, :half] | maps[:, :, half:]
    return maps


def close_links(x: list[tuple], y: list[tuple], major: int, threshold: float) -> tuple[list[int], list[int]]:
    """Links between two blocks of rows (node, root, shingles, weights): of all pairs at the threshold, enough of them to join the
    components (of roots) that they join. The maps' bound is that of may_reach; what passes is compared exactly, unless it is joined
    already. x has no node of the component `major`; of two others the smaller node is x."""
    names = {r: i for i, r in enumerate({row[1] for row in (*x, *y)})}
    label = np.arange(len(names))  # of each component, as it is now

    def by_words(rows: list[tuple]) -> dict[int, tuple]:
        maps, found = [wide_map(s, w).view(np.uint64) for _, _, s, w in rows], {}
        for n in sorted({m.shape[1] for m in maps}):
            own = [i for i, m in enumerate(maps) if m.shape[1] == n]
            node, root = np.array([rows[i][0] for i in own], np.int64), np.array([rows[i][1] for i in own], np.int64)
            of = np.array([names[rows[i][1]] for i in own])
            found[n] = node, root, of, np.array([float(rows[i][3].sum()) for i in own]), np.stack([maps[i] for i in own]), [rows[i][2:] for i in own]
        return found

    def absent(one: np.ndarray, other: np.ndarray) -> np.ndarray:
        return np.bitwise_count(one & ~other).sum(axis=1, dtype=np.int64)

    a, b, ys = [], [], by_words(y)
    for n, (x_node, _, x_of, x_size, x_maps, x_sets) in by_words(x).items():
        for m, (y_node, y_root, y_of, y_size, y_maps, y_sets) in ys.items():
            if min(x_size.max(), y_size.max()) * SLACK < threshold * max(x_size.min(), y_size.min()):
                continue
            xs, those = folded(x_maps, min(n, m)), folded(y_maps, min(n, m))
            for i in range(len(x_node)):
                fits = (label[y_of] != label[x_of[i]]) & ((x_node[i] < y_node) | (y_root == major))
                fits &= np.minimum(x_size[i], y_size) * SLACK >= threshold * np.maximum(x_size[i], y_size)
                at = np.flatnonzero(fits)
                need = threshold / (1 + threshold) / SLACK * (x_size[i] + y_size)
                rest = x_size[i] - absent(xs[i, 0], those[at, 2])
                at, rest = at[rest >= need[at]], rest[rest >= need[at]]
                at = at[rest - absent(xs[i, 1], those[at, 2]) / 2 >= need[at]]
                at = at[y_size[at] - absent(those[at, 0], xs[i, 2]) - absent(those[at, 1], xs[i, 2]) / 2 >= need[at]]
                for j in at.tolist():
                    p, q = label[x_of[i]], label[y_of[j]]
                    if p != q and weighted_jaccard(x_sets[i], y_sets[j]) >= threshold:
                        label[label == p] = q
                        a.append(int(x_node[i]))
                        b.append(int(y_node[j]))
    return a, b


def crowded_links(held: DataFrame, crowded: DataFrame, weights_of: Callable[[], Weights], threshold: float, k: int) -> DataFrame:
    """held (node, text) and crowded (node, key, root) to links (a, b): nodes of one key that reach the threshold are in one
    component with them.

    The weights of x and y share at least need = t / (1 + t) * (|x| + |y|) then, and the larger is at most 1 / t times
    the smaller. Shingles are ordered alike in all nodes, by how many nodes have one of their hash bucket: if the
    smaller had none of the first (1 - t) / (1 + t) of its weight among the first 1 - t of the larger's, less than
    need would be left to share. A shingle whose bucket one node has is shared by none. Any order is exact; rare
    ones first keep the shingles that thousands of nodes have out of the prefixes.

    So a node that shares no shingle of its prefix with another component has no partner; unlike texts around one
    template fall out here. The others of a key meet in blocks, two in a task, where a pair is a few operations on
    their maps and is compared exactly only if these leave it: at eight places a shingle few far below the threshold
    are left. A task's rows are fewer than its components, whatever the number of its pairs.
    """
    cells, width = 1 << _COUNT_BITS, (1 << _COUNT_BITS) // _COUNT_SLICES

    def bucket(s):
        return (s >> np.uint64(64 - _COUNT_BITS)).astype(np.int64)

    def count(batches):
        hasher, counts = WordHasher(), np.zeros(cells, np.uint32)
        for b in batches:
            s, _, _ = unique_shingles(*shingle_hashes(*hasher.words(b["text"]), k))
            np.add.at(counts, bucket(s), np.uint32(1))
        some = [i for i in range(_COUNT_SLICES) if counts[i * width : (i + 1) * width].any()]
        yield {"slice": some, "c": [counts[i * width : (i + 1) * width].tobytes() for i in some]}

    def ranks(batches):
        sums = {}
        for b in batches:
            for i, c in zip(b["slice"], b["c"]):
                sums[i] = sums.get(i, 0) + np.frombuffer(c, np.uint32).astype(np.int64)
        # 0 where one node has the bucket, then eight steps for each doubling
        yield {"slice": list(sums), "c": [np.minimum(255, np.ceil(8 * np.log2(np.maximum(x, 1)))).astype(np.uint8).tobytes() for x in sums.values()]}

    counted = map_rows(held, count, "slice long, c binary", rows=64).repartition("slice")
    rank = np.zeros(cells, np.uint8)
    for r in map_rows(counted, ranks, "slice long, c binary", rows=64).collect():
        rank[r.slice * width : (r.slice + 1) * width] = np.frombuffer(r.c, np.uint8)

    def prefixes(batches):
        hasher, weights = WordHasher(), weights_of()
        for b in batches:
            out = {x: [] for x in ("s", "node", "short")}
            s, tf, own = unique_shingles(*shingle_hashes(*hasher.words(b["text"]), k))
            w, order, ends = weights.of(s, tf), rank[bucket(s)], np.cumsum(own)
            for node, n, end in zip(b["node"], own.tolist(), ends.tolist()):
                at = np.arange(end - n, end)[w[end - n : end] > 0]
                at = at[np.lexsort((s[at], order[at]))]
                if not len(at):
                    continue
                upto = np.cumsum(w[at])
                size, before = float(upto[-1]), upto - w[at]
                on = (before <= (1 - threshold) * size * SLACK) & (order[at] > 0)
                at, before = at[on], before[on]
                out["s"] += s[at].view(np.int64).tolist()
                out["short"] += (before <= (1 - threshold) / (1 + threshold) * size * SLACK).tolist()
                out["node"] += [node] * len(at)
            yield out

    def vectors(batches):
        hasher, weights = WordHasher(), weights_of()
        for b in batches:
            s, tf, own = unique_shingles(*shingle_hashes(*hasher.words(b["text"]), k))
            w, ends = weights.of(s, tf), np.cumsum(own).tolist()
            sets = [slice(end - n, end) for n, end in zip(own.tolist(), ends)]
            yield {"node": b["node"], "s": [s[x].tobytes() for x in sets], "w": [w[x].tobytes() if (w[x] != 1.0).any() else b"" for x in sets]}

    def close(batches):
        def tasks():
            now, rows = None, []
            for b in batches:
                for row in zip(b["key"], b["i"], b["j"], b["side"], b["major"], b["node"], b["root"], b["s"], b["w"]):
                    if rows and row[:3] != now:
                        yield rows
                        rows = []
                    now = row[:3]
                    rows.append(row[3:])
            if rows:
                yield rows

        def block(rows, side):
            # weights that are all 1 are not sent
            return [(node, root, np.frombuffer(s, np.uint64), np.frombuffer(w) if w else np.ones(len(s) // 8)) for own, _, node, root, s, w in rows if own == side]

        for rows in tasks():
            x, y = block(rows, 0), block(rows, 1)
            if x and y:
                a, b = close_links(x, y, rows[0][1], threshold)
                yield {"a": a, "b": b}

    tokens = map_rows(held, prefixes, "s long, node long, short boolean", rows=64)
    tokens = materialize(tokens.join(crowded.select("node", "root").distinct(), "node"), "prefixes")
    shared = tokens.groupBy("s").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.max("short").alias("short")).filter("r0 <> r1 AND short")
    live = materialize(tokens.join(shared.select("s"), "s", "left_semi").select("node").distinct(), "live")
    sets = materialize(map_rows(held.join(live, "node", "left_semi"), vectors, "node long, s binary, w binary", rows=64), "vectors")
    met = materialize(crowded.join(sets.select("node", (F.length("s") + F.length("w")).alias("bytes")), "node"), "met")
    # the component with most nodes of a key is one side only, so that one large class does not meet itself
    by_root = met.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    keys = by_root.groupBy("key").agg(F.count("*").alias("roots"), F.max(F.struct("n", "bytes", "root")).alias("top"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))

    def blocks(n: Column, size: Column) -> Column:
        return F.ceil(F.greatest(n / _BLOCK_NODES, size / _BLOCK_BYTES)).cast("int")

    xs, ys = blocks(F.col("n") - F.col("top.n"), F.col("bytes") - F.col("top.bytes")), blocks(F.col("n"), F.col("bytes"))
    dealt = met.drop("bytes").join(keys.filter("roots > 1").select("key", F.col("top.root").alias("major"), xs.alias("xs"), ys.alias("ys")), "key")

    def own(of: str) -> Column:
        return F.pmod(F.xxhash64("node"), F.col(of)).cast("int")

    def every(of: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(of) - 1))

    names = ("key", "major", "node", "root")
    x = dealt.filter("root <> major").select(*names, own("xs").alias("i"), every("ys").alias("j"), F.lit(0).alias("side"))
    y = dealt.select(*names, every("xs").alias("i"), own("ys").alias("j"), F.lit(1).alias("side"))
    sides = x.unionByName(y).join(sets, "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    links = materialize(map_rows(sides, close, "a long, b long", rows=_BLOCK_NODES), "links")
    for done in (tokens, live, sets, met):
        discard(done)
    return links


def near_duplicates(docs: DataFrame, threshold: float = 0.8, k: int = 5, bands: int = 12, rows: int = 2, rounds: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, text_hash, root for every row; class_id is the smallest doc_id of the class, root tells classes apart whose class_id is one.

    Two documents are linked where the weighted Jaccard similarity of their k-word shingles reaches the
    threshold; classes are the components of the links. A pair at similarity s shares a band with probability
    1 - (1 - s ** rows) ** bands: 0.999995 at 0.8. Documents without words, null texts included, are one class.
    Rows of one doc_id, or of none, are told apart by a 64-bit hash of their text. class_id is null where all
    rows of a class have a null doc_id. An empty table gives an empty result.
    """
    texts = texts_of(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    n, common = common_shingles(texts.select("text"), k)
    arr = np.array([s for s, _ in common], np.int64).view(np.uint64), np.array([d for _, d in common], np.float64)

    def sign(batches):
        hasher, weights, tables = WordHasher(), Weights(*arr, n), SampleTables(bands * rows)
        for b in batches:
            words, counts = hasher.words(b["text"])
            s, tf, own = unique_shingles(*shingle_hashes(words, counts, k))
            w = weights.of(s, tf)
            maps, size = bit_maps(s, w, own), np.bincount(np.repeat(np.arange(len(own)), own), w, len(own))
            if not (w > 0).all():
                doc = np.repeat(np.arange(len(own)), own)[w > 0]
                s, w, own = s[w > 0], w[w > 0], np.bincount(doc, minlength=len(own))
            some = own > 0
            first, have = (np.cumsum(own) - own)[some], own[some]
            keys = [[] for _ in own]
            if len(first):
                lw = np.log(w)
                plain = np.flatnonzero(w != 1.0)
                plain = plain if len(plain) else None
                out = np.empty((len(first), bands), np.uint64)
                for i in range(bands):
                    key = np.full(len(first), i + 1, np.uint64)
                    for j in range(rows):
                        key = mix64(key * np.uint64(0x9FB21C651E98DF25) + tables.sample(i * rows + j, s, lw, plain, first, have))
                    out[:, i] = key
                for d, x in zip(np.flatnonzero(some).tolist(), out.view(np.int64).tolist()):
                    keys[d] = x
            yield {"doc_id": b["doc_id"], "text_hash": b["text_hash"], "node": content_hashes(words, counts).tolist(), "keys": keys, "size": size, "map": list(maps)}

    signed = materialize(map_rows(texts, sign, "doc_id long, text_hash long, node long, keys array<long>, size double, map array<long>", rows=128), "signed")
    members = signed.select("doc_id", "text_hash", "node")
    first = members.groupBy("node").agg(F.min(_ordered()).alias("first"))
    shared = signed.select("node", F.explode("keys").alias("key")).distinct()
    several = shared.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi")).filter("n > 1")
    # only rows of bands that several nodes share go on
    bands_ = materialize(shared.join(several.select("key", "lo", "hi"), "key"), "bands")

    # texts of one node have the same words, and so the same weights
    sketches = materialize(signed.join(bands_.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("size").alias("size"), F.first("map").alias("map")), "sketches")

    def possible(pairs: DataFrame) -> DataFrame:
        """The pairs that their maps do not rule out."""
        x, y = sketches.alias("x"), sketches.alias("y")
        met = pairs.alias("p").join(x, F.col("p.a") == F.col("x.node")).join(y, F.col("p.b") == F.col("y.node"))
        return met.filter(may_reach("x", "y", threshold)).select("p.a", "p.b")

    def texts_at(nodes: DataFrame) -> DataFrame:
        wanted = first.join(nodes, "node", "left_semi").select("node", "first.doc_id", "first.text_hash")
        held = texts.join(wanted, texts.doc_id.eqNullSafe(wanted.doc_id) & (texts.text_hash == wanted.text_hash)).select("node", "text").groupBy("node").agg(F.first("text").alias("text"))
        return materialize(held, "texts")

    def verified(pairs: DataFrame) -> DataFrame:
        held = texts_at(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        rows_ = pairs.join(held.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").join(held.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")

        def check(batches):
            hasher, weights, known = WordHasher(), Weights(*arr, n), {}

            def vector(node, text):
                if node not in known:
                    if len(known) >= 64:
                        known.clear()
                    s, tf, _ = unique_shingles(*shingle_hashes(*hasher.words([text]), k))
                    known[node] = (s, weights.of(s, tf))
                return known[node]

            for b in batches:
                good = [weighted_jaccard(vector(x, t), vector(y, u)) >= threshold for x, y, t, u in zip(b["a"], b["b"], b["ta"], b["tb"])]
                yield {"a": [x for x, g in zip(b["a"], good) if g], "b": [x for x, g in zip(b["b"], good) if g]}

        found = materialize(map_rows(rows_, check, "a long, b long", rows=64), "links")
        discard(held)
        discard(pairs)
        return found

    def pairs_with(x: str) -> DataFrame:
        return bands_.filter(f"node <> {x}").select(F.least("node", x).alias("a"), F.greatest("node", x).alias("b"))

    links = verified(materialize(possible(pairs_with("lo").unionByName(pairs_with("hi")).distinct()), "pairs"))
    roots = components(links)
    for turn in range(1, rounds):
        # bands across components: each node meets two more of its band, another two in each round
        salt = F.lit(0x5851F42D4C957F2D * turn % (1 << 62))
        mixed = F.col("node").bitwiseXOR(F.xxhash64("key", salt))
        part = bands_.select("node", "key").join(roots, "node", "left").select("node", "key", F.coalesce("root", "node").alias("root"))
        ends = part.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.min(mixed).alias("lo"), F.max(mixed).alias("hi")).filter("r0 <> r1")
        open_ = part.join(ends.select("key", "lo", "hi"), "key")
        back = F.xxhash64("key", salt)
        pairs = open_.select("node", "root", F.explode(F.array(F.col("lo").bitwiseXOR(back), F.col("hi").bitwiseXOR(back))).alias("other"))
        of_other = roots.select(F.col("node").alias("other"), F.col("root").alias("other_root"))
        pairs = pairs.filter("node <> other").join(of_other, "other", "left").filter(F.col("root") != F.coalesce("other_root", "other"))
        pairs = materialize(possible(pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()), "pairs")
        if pairs.isEmpty():
            discard(pairs)
            break
        more = verified(pairs)
        if more.isEmpty():
            discard(more)
            continue
        links = links.unionByName(more)
        old, roots = roots, components(links)
        discard(old)
    # bands of up to three nodes have met whole: two of them met everyone
    part = bands_.select("node", "key").join(roots, "node", "left").select("node", "key", F.coalesce("root", "node").alias("root"))
    left = part.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("r0"), F.max("root").alias("r1")).filter("n > 3 AND r0 <> r1")
    crowded = materialize(part.join(left.select("key"), "key", "left_semi"), "open")
    if not crowded.isEmpty():
        release(docs.sparkSession)
        held = texts_at(crowded.select("node").distinct())
        links = links.unionByName(crowded_links(held, crowded, lambda: Weights(*arr, n), threshold, k))
        discard(held)
        old, roots = roots, components(links)
        discard(old)
    for done in (bands_, sketches, crowded, links):
        discard(done)
    named = first.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "first")
    least = named.groupBy("root").agg(F.min("first").alias("least"))
    classes = named.join(least, "root").select("node", "root", F.col("least.doc_id").alias("class_id"))
    return members.join(classes, "node").select("doc_id", "class_id", "text_hash", "root")


def _ordered() -> Column:
    """Rows by doc_id, those without one last, then by the hash of their text."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")


def keep_one(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs, all its columns, for every class: of its smallest doc_id, and of equal texts there any one."""
    same = classes.groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    kept = same.groupBy("root").agg(F.min(F.struct(_ordered().alias("row"), "n")).alias("k")).select("k.row.doc_id", "k.row.text_hash", "k.n")
    kept = materialize(kept, "kept")
    own = docs.withColumns({"_kept_id": F.col(id_col).cast("long"), "_kept_hash": F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})

    def of(these: DataFrame) -> DataFrame:
        return own.join(these, own["_kept_id"].eqNullSafe(these["doc_id"]) & (own["_kept_hash"] == these["text_hash"]), "left_semi")

    out, several = of(kept.filter("n = 1")), kept.filter("n > 1")
    if not several.isEmpty():
        out = out.unionByName(of(several).dropDuplicates(["_kept_id", "_kept_hash"]))
    return out.drop("_kept_id", "_kept_hash")
