"""Operators against brute force on small fixtures with nulls, empty and long texts, ties, repeated rows, extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lattica.llm import byte_bpe, containment, gif, graph, near_dup, quality, queries, substring_dedup, token_files, toxicity, url_filter

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def table(spark):
    """doc_id, text, and columns that operators use as names for their own."""
    r = random.Random(5)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(400)]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    base, passage = say(120), say(60)
    near = base.split()
    near[40] = "other"
    texts = [None, "", " ", "x", base, base, " ".join(near), passage + " " + say(80), say(90) + "\n" + passage, "a" * 900, "ab" * 450, "É日本 😀  two  spaces \n", say(20_000), *[say(r.randint(1, 150)) for _ in range(60)]]
    rows = [(i, t) for i, t in enumerate(texts)] + [(4, base), (None, say(30)), (None, None)]
    df = spark.createDataFrame([(i, t, "k", 1, [2], 0.5) for i, t in rows], "doc_id long, text string, key string, node int, items array<int>, score double").repartition(3)
    return df, rows


def collected(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_byte_bpe(table):
    df, rows = table
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={})
    want = sorted(((i, len(x := lib.encode_ordinary(t or "")), x, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), key=repr)
    out = byte_bpe.encode_documents(df, RANKS, public_tokenizers.PATTERN)
    assert collected(out, "doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256") == want
    assert collected(byte_bpe.decode_documents(out, RANKS), "doc_id", "data") == sorted(((i, (t or "").encode()) for i, t in rows), key=repr)


def test_byte_bpe_edits():
    ranks = byte_bpe.load_ranks(RANKS)
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder, r = byte_bpe.TextCoder(ranks, public_tokenizers.PATTERN), random.Random(2)
    parts = ["a", "b", " ", "\n", "'s", "é", "日本", "12", "==", " the", "😀", "́", "\0"]
    text, own = "", byte_bpe.EditableText(coder)
    for _ in range(1500):
        i = len(text) if r.random() < 0.3 else r.randint(0, len(text))
        j, new = min(len(text), i + r.randint(0, 4)), "".join(r.choice(parts) for _ in range(r.randint(0, 4)))
        text = text[:i] + new + text[j:]
        own.edit(i, j, new)
        assert own.ids() == lib.encode_ordinary(text) == coder.encode(text)
        if len(text) > 150:
            text, own = "", byte_bpe.EditableText(coder)
    one = byte_bpe.PrefixTable(coder.coder, b"hello world of edits and more edits " * 40)
    before = one.computed
    one.edit(700, 703, b"xyzzy")
    assert one.last == coder.coder.table(one.data) and one.computed - before < 100
    one.append(b" and on")
    assert one.last == coder.coder.table(one.data)


def test_token_files(spark, table, tmp_path):
    df, rows = table
    lib = Tokenizer.from_file(WORDS)
    out = token_files.encode_to_files(df, WORDS, f"file://{tmp_path}/t", with_ids=True).collect()
    start, want = 0, []
    for i, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    assert sorted(map(tuple, out), key=lambda x: x[1]) == want
    shards = token_files.write_token_files(df, WORDS, f"file://{tmp_path}/small", shard_ids=50)
    assert shards.count() > 3 and sorted(map(tuple, token_files.read_token_files(shards).collect()), key=lambda x: x[1]) == want
    assert token_files.encode_to_files(df.limit(0), WORDS, f"file://{tmp_path}/none").count() == 0


def test_elias_fano():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 255, 256, 257, 3000):
        for top in (1, 10, 10**6, 10**12):
            v = np.sort(r.integers(0, top, n))
            e = token_files.EliasFano.load(token_files.EliasFano.of(v).dump())
            assert (e.values().astype(np.int64) == v).all() and all(e[i] == v[i] for i in range(0, n, 17))
            assert all(list(e.walk(i)) == v[i:].tolist() for i in (0, 1, n // 2, n))
    v = np.arange(0, 3_000_000, 300)
    assert token_files.EliasFano.of(v).nbytes * 8 / len(v) < 11
    with pytest.raises(ValueError):
        token_files.Shard(b"nothing")


def test_gif_digest(table):
    df, rows = table
    want = []
    for i, t in rows:
        data = (t or "").encode()
        whole = gif.padded(data)
        assert len(whole) % 192 == 0 and len(whole) >= 192 and whole.rstrip(b" ") == data.rstrip(b" ")
        want.append((i, len(data), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-16:])))
    out = gif.media_digest(df)
    assert collected(out, "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32") == sorted(want, key=repr)
    same = out.filter("doc_id in (4, 5)").select("media_sha256", "feature").distinct().count()
    assert same == 1
    assert gif.media_frames(gif.text_media(df)).filter("size(frames) > 1").count() >= 1


def test_gif_format():
    r = np.random.default_rng(0)
    for n in (0, 1, 3838, 3839, 3840, 30_000):
        for top in (1, 2, 256):
            data = r.integers(0, top, n).astype(np.uint8).tobytes()
            assert gif.lzw_decode(gif.lzw_encode(data), 8, n + 9).tobytes() == data
    red, blue = np.array([[255, 0, 0], [0, 0, 255]], np.uint8), np.array([[0, 0, 0], [0, 0, 255]], np.uint8)
    full = gif.Frame(np.zeros((9, 4), np.uint8), delay_cs=5, disposal=1, palette=red, interlaced=True)
    hole = gif.Frame(np.array([[0, 1], [1, 0]], np.uint8), 1, 1, delay_cs=7, disposal=2, transparent=0, palette=blue)
    back = gif.Frame(np.ones((1, 1), np.uint8), 0, 0, disposal=3, palette=blue)
    read = gif.read_gif(gif.write_gif(gif.Gif(4, 9, [full, hole, back, hole], red, loops=3)))
    shown = list(gif.frames_shown(read))
    assert read.loops == 3 and [t for t, _ in shown] == [0, 50, 120, 120]
    assert (shown[1][1][1, 1] == [255, 0, 0, 255]).all() and (shown[1][1][1, 2] == [0, 0, 255, 255]).all()
    assert shown[2][1][1, 2, 3] == 0 and (shown[2][1][0, 0] == [0, 0, 255, 255]).all()
    assert (shown[3][1][0, 0] == [255, 0, 0, 255]).all()
    # a full table may stay in use: codes of 12 bits go on without a clear code
    codes = [256, *([7, 8] * 2400), 257]
    bits = np.concatenate([(c >> np.arange(w)) & 1 for c, w in zip(codes, [9, *gif._widths(0, 4801, 9)])]).astype(np.uint8)
    assert gif.lzw_decode(np.packbits(bits, bitorder="little").tobytes(), 8, 4800).tolist() == [7, 8] * 2400


def test_repeated_starts():
    r = random.Random(3)
    for _ in range(200):
        n, letters = r.choice([1, 2, 3, 5, 8, 20]), r.choice([b"ab", b"abc", b"a", bytes(range(256))])
        runs = [bytes(r.choice(letters) for _ in range(r.randint(0, 50))) for _ in range(r.randint(1, 7))]
        runs += [runs[0][r.randint(0, 9) :] + b"x"] * r.randint(0, 2)
        groups = np.array([r.randint(0, 1) for _ in runs])
        seen = Counter((g, x[p : p + n]) for x, g in zip(runs, groups) for p in range(len(x) - n + 1))
        for x, g, got in zip(runs, groups, substring_dedup.repeated_starts(runs, groups, n)):
            assert got.tolist() == [p + n <= len(x) and seen[g, x[p : p + n]] > 1 for p in range(len(x) + 1)]


def by_hand(rows, n=200):
    seen = Counter(d[p : p + n] for _, t in rows for d in [(t or "").encode()] for p in range(len(d) - n + 1))
    out = []
    for i, t in rows:
        d = (t or "").encode()
        mark = np.zeros(len(d), bool)
        for p in range(len(d) - n + 1):
            if seen[d[p : p + n]] > 1:
                mark[p : p + n] = True
        kept = bytes(b for b, m in zip(d, mark) if not m)
        out.append((i, len(d), int(mark.sum()), int((np.diff(np.concatenate([[0], mark.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("group_max", [16_000, 2, 0])
def test_substring_dedup(table, monkeypatch, group_max):
    """Also with bounds so small that groups are split by anchor, and by window."""
    monkeypatch.setattr(substring_dedup, "GROUP_MAX", group_max)
    df, rows = table
    rows = [x for x in rows if len(x[1] or "") < 50_000]
    df = df.filter("text is null or length(text) < 50000")
    assert collected(substring_dedup.dedup_report(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == by_hand(rows)


def test_anchors_in_pieces(monkeypatch):
    r = random.Random(6)
    texts = [bytes(r.choice(b"abc") for _ in range(n)) for n in (0, 150, 199, 200, 201, 350, 5000, 20, 3000)]
    want = substring_dedup.anchors_of(texts)
    for piece in (1, 7, 200, 333, 4999):
        monkeypatch.setattr(substring_dedup, "PIECE", piece)
        for (a, g), (b, h) in zip(want, substring_dedup.anchors_of(texts)):
            assert a.tolist() == b.tolist() and g.tolist() == h.tolist()


def test_remove_repeats(table):
    df, rows = table
    out = substring_dedup.remove_repeats(df.limit(100))
    assert out.columns == df.columns and out.count() == len(rows)
    assert substring_dedup.dedup_report(df.limit(0)).count() == 0


def shingles(text, k=5):
    words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
    return Counter(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else Counter()


def test_near_duplicates(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    df = Counter(s for _, t in rows for s in shingles(t))
    n = len(rows)
    weight = {s: min(1.0, np.log(n / c) / np.log(100)) if c > 0.01 * n else 1.0 for s, c in df.items()}
    sets = [(i, {s: f * weight[s] for s, f in shingles(t).items() if weight[s] > 0}) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            both = x.keys() & y.keys()
            low = sum(min(x[s], y[s]) for s in both)
            if both and low >= 0.8 * (sum(x.values()) + sum(y.values()) - low):
                p, q = sorted((root(i), root(j)))
                parent[q] = p
    assert collected(near_dup.near_duplicates(docs), "doc_id", "class_id") == sorted(((i, root(i)) for i, _ in rows), key=repr)


def test_near_duplicates_edges(table):
    df, _ = table
    got = dict((r.doc_id, r.class_id) for r in near_dup.near_duplicates(df).collect() if r.doc_id is not None)
    assert got[4] == got[5] == 4 and got[1] == got[2] and got[12] == 12
    kept = near_dup.keep_one(df, near_dup.near_duplicates(df))
    assert kept.columns == df.columns and kept.filter("doc_id = 5").count() == 0
    assert near_dup.near_duplicates(df.limit(0)).count() == 0


def test_near_duplicates_in_a_crowded_band(spark):
    """300 unlike texts around one template hide ten near copies; every band of theirs holds all of them or few."""
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(20_000)]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    template = say(320)
    own = [say(70).split() for _ in range(300)]
    texts = [f"{template} {' '.join(x)}" for x in own]
    for i in range(10):
        x = list(own[i])
        x[5::10] = say(7).split()
        texts.append(f"{template} {' '.join(x)}")
    rows = [*enumerate(texts), *((1000 + i, f"f{i}") for i in range(29_690))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(docs).filter("doc_id < 1000").collect()}
    assert got == {i: i - 300 if i >= 300 else i for i in range(310)}


def test_near_duplicates_in_a_loose_group(monkeypatch, spark):
    """300 texts with eight words of one template replaced, no two of them similar enough, and near copies of ten: the rows
    of pairs and links that the crowded bands make do not grow with the square of the group."""
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(20_000)]
    template = [r.choice(vocab) for _ in range(400)]
    texts = []
    for _ in range(300):
        x = list(template)
        for slot in r.sample(range(40), 8):
            x[10 * slot + 4] = r.choice(vocab)
        texts.append(x)
    texts += [[*texts[i][:-1], "other"] for i in range(10)]
    rows = [*((i, " ".join(x)) for i, x in enumerate(texts)), *((1000 + i, f"f{i}") for i in range(29_690))]
    made, write = [], near_dup.materialize

    def counted(df, tag):
        out = write(df, tag)
        made.append((tag, out.count()))
        return out

    monkeypatch.setattr(near_dup, "materialize", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(docs).filter("doc_id < 1000").collect()}
    assert got == {i: i - 300 if i >= 300 else i for i in range(310)}
    crowded = made[[tag for tag, _ in made].index("open") :]
    assert all(n <= 310 for tag, n in crowded if tag in ("pairs", "links")), crowded


def test_close_links():
    """Links join what all pairs at the threshold join, whatever the lengths and weights, and are as few as a tree's."""
    g = np.random.default_rng(1)
    joined = 0

    def classes(links):
        at = [i // 3 for i in range(40)]
        for i, j in links:
            at = [at[j] if c == at[i] else c for c in at]
        return {tuple(c == d for d in at) for c in at}, len(set(at))

    for size in (1, 3, 30, 300, 500, 900):
        base, weight, rows = g.integers(1, 2**63, size, dtype=np.uint64), {}, []
        for i in range(40):
            own = base[g.random(size) >= 0.25 * g.random()]
            s = np.unique(np.concatenate([own, g.integers(1, 2**63, g.integers(0, 1 + size // 8), dtype=np.uint64), base[:1]]))
            rows.append((i, i // 3, s, np.array([weight.setdefault(int(h), 1.0 if g.random() < 0.7 else 2.5 * g.random()) for h in s])))
        want = classes([(i, j) for j in range(40) for i in range(j) if near_dup.weighted_jaccard(rows[i][2:], rows[j][2:]) >= 0.8])
        links = list(zip(*near_dup.close_links(rows[3:], rows, 0, 0.8)))
        assert classes(links) == want and len(links) == 14 - want[1]
        assert all(near_dup.weighted_jaccard(rows[i][2:], rows[j][2:]) >= 0.8 for i, j in links)
        joined += len(links)
    assert joined > 20


def test_near_duplicates_of_repeated_ids(spark):
    """Unlike texts under one doc_id and under none, each with near copies elsewhere."""
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(5000)]
    texts = [" ".join(r.choice(vocab) for _ in range(100)) for _ in range(40)]
    near = [t.rsplit(" ", 1)[0] for t in texts]
    ids = [7] * 20 + [None] * 20
    rows = [*zip(ids, texts), *((100 + i, t) for i, t in enumerate(near)), (None, texts[30]), (7, texts[3]), (None, None), (None, "")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, more string").repartition(3)
    found = near_dup.near_duplicates(df)
    want = [*((7, 7) for _ in range(21)), *((100 + i, 7 if i < 20 else 100 + i) for i in range(40)), *((None, 120 + i) for i in range(20)), (None, 130), (None, None), (None, None)]
    assert collected(found, "doc_id", "class_id") == sorted(want, key=repr)
    kept = [(r.doc_id, r.text or "") for r in near_dup.keep_one(df, found).collect()]
    assert sorted(kept, key=repr) == sorted([*((7, t) for t in texts[:20]), *((120 + i, t) for i, t in enumerate(near[20:])), (None, "")], key=repr)


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7)]
    parent = list(range(2000))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        p, q = sorted((root(a), root(b)))
        parent[q] = p
    want = {(x, root(x)) for a, b in edges if a != b for x in (a, b)}
    assert set(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect())) == want


def test_containment(spark, sf_dir):
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    want = []
    for i in items.collect():
        own = set(shingles(i.text))
        want += [(d.doc_id, i.item_id) for d in docs.collect() if len(own & set(shingles(d.text))) >= 0.8 * len(own)]
    found = containment.find_items(docs, containment.index_batches(items, "item_id", "text"))
    assert want and collected(found, "doc_id", "item_id") == sorted(want, key=repr)
    kept = containment.drop_contaminated(docs, containment.index_batches(items, "item_id", "text"))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - {d for d, _ in want}


def test_containment_edges(spark, table):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "tiny item"), (None, "x"), (4, "one two three four five"), (5, "one two three four five")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a TINY, item!"), (2, "zero one two three four five six"), (3, None), (3, "tiny tiny item")], "doc_id long, text string")
    assert collected(containment.find_items(docs, containment.index_batches(items, "item_id", "text")), "doc_id", "item_id") == [(1, 3), (2, 4), (2, 5), (3, 3)]
    assert containment.find_items(table[0], containment.index_batches(items.limit(0), "item_id", "text")).count() == 0


def test_containment_of_repetitive_and_large_items(spark, monkeypatch):
    round_ = " ".join("a b c d e f g h".split() * 90)
    items = spark.createDataFrame([(1, "la " * 100), (2, round_), (3, ".".join(f"p{i}" for i in range(60))), (4, ".".join(f"q{i}" for i in range(60)))], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so la la la la la la"), (2, "x " * 9 + round_), (3, " ".join(f"p{i}" for i in range(60))), (4, "none of it"), (5, " ".join(f"q{i}" for i in range(60)))], "doc_id long, text string")
    monkeypatch.setattr(containment.ContainmentIndex, "MAX_SHINGLES", 40)
    indexes = containment.index_batches(items, "item_id", "text")
    assert len(indexes) == 4 and collected(containment.find_items(docs, indexes), "doc_id", "item_id") == [(1, 1), (2, 2), (3, 3), (5, 4)]


def test_licenses(spark):
    docs = spark.createDataFrame([(1, "code\nReleased under the MIT License."), (2, "a licensed driver"), (3, "x " * 900 + "Licensed under the Apache License, Version 2.0. " + "y " * 90), (4, None)], "doc_id long, text string")
    assert collected(containment.scan_licenses(docs), "doc_id", "license") == [(1, "MIT"), (3, "Apache-2.0")]


def test_license_texts_and_notices(spark):
    cut = containment.LICENSE_TEXTS["GPL-3-text"].split()
    notice = "code\nThis program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"
    rows = [(1, "z " * 300 + " ".join(cut[: len(cut) * 9 // 10])), (2, " ".join(cut[: len(cut) // 2])), (3, "(c) Someone. All rights reserved."), (4, notice), (5, "x " * 50)]
    rows += [(10 + i, t) for i, t in enumerate(containment.LICENSE_TEXTS.values())]
    found = set(collected(containment.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "license"))
    names = [(10 + i, n) for i, n in enumerate(containment.LICENSE_TEXTS)]
    assert {(1, "GPL-3-text"), (3, "all-rights-reserved"), (4, "AGPL-notice"), *names} <= found
    assert not {(2, "GPL-3-text"), (4, "LGPL-notice")} & found and not any(d == 5 for d, _ in found)


def test_toxicity_grammar():
    lex = toxicity.Lexicon({"idiot$": 2.0, "lowei": 1.5})
    machine = toxicity.grammar(lex)
    weigh = lambda t: toxicity.clause_weights(toxicity.TOKEN.findall(t), machine, lex)
    assert weigh("you are an idiot") == weigh("an idiot are you") == {"aimed": 2.0}
    assert weigh("you are not an idiot") == {"denied": 2.0}
    assert weigh("not today, you idiot") == {"aimed": 2.0}
    assert weigh("he said you are an idiot") == {"reported": 2.0}
    assert weigh("as he said, you are an idiot") == {"aimed": 2.0}
    assert weigh("loweischaft idiots") == {"plain": 1.5}
    assert weigh("i will hurt you") == weigh("they hurt") == {"threat": 1.0} and weigh("it will hurt") == {}
    assert weigh("i will hurt you idiot, the other idiot is elsewhere and very far from here") == {"threat": 1.0, "aimed": 4.0}
    assert weigh("") == {} and weigh("you you not said") == {}


def test_toxicity_paths():
    """The best path against all tag sequences that the rules allow, written down without machines."""
    lex = toxicity.Lexicon({"i$": 1.5})
    words = {"I": "i", "T": "kill", "Y": "you", "N": "not", "S": "said", "C": "but", "O": "tree"}
    machine, r = toxicity.grammar(lex), random.Random(8)
    for _ in range(600):
        x = [r.choice("IITYNSCOOO") for _ in range(r.randint(0, 14))]
        want, said, left = [], False, 0
        for i, c in enumerate(x):
            near = lambda reach: any(x[j] == "Y" for j in range(max(0, i - reach), min(len(x), i + reach + 1)))  # noqa: B023, E731
            tag = {"N": "O", "S": "O"}.get(c, c)
            if c in "IT":
                tag = f"{c}r" if said else f"{c}n" if left else c
                if tag == "T":
                    tag = "X" if near(toxicity.REACH["threat"]) else "O"
                elif tag == "I":
                    tag = "A" if near(toxicity.REACH["target"]) else "I"
            want.append(tag)
            said = c == "S" or said and c != "C"
            left = toxicity.REACH["negation"] if c == "N" else 0 if c == "C" else max(0, left - 1)
        assert toxicity.best_path(machine, [words[c] for c in x])[1] == want
        paths = [(0.0, machine.start, [])]
        for c in x if len(x) < 9 else ():
            paths = [(v + w, to, [*out, y]) for v, state, out in paths for y, w, to in machine.arcs(state, words[c])]
        if len(x) < 9:
            assert max(v for v, state, _ in paths if machine.final(state)) == toxicity.best_path(machine, [words[c] for c in x])[0]


@pytest.mark.parametrize("name,label", [("op2_toxicity", "toxic"), ("op3_quality", "quality")])
def test_held_out_accuracy(spark, name, label):
    sf = "/root/testdata/sf0.1"
    out = queries.QUERIES[name](spark, sf)
    y = F.col("predicted") if name == "op2_toxicity" else F.col("keep").cast("int")
    r = out.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").agg(F.avg((y == F.col(label)).cast("double")).alias("a")).first()
    assert out.count() == 10_000 and r.a > 0.96


def test_classifier_edges(spark, table):
    df, rows = table
    labels = spark.createDataFrame([(i, i % 3, 0) for i in range(30)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    model = quality.fit_quality(df, labels)
    assert len(model.grades) == 3 and (np.diff(model.thresholds) > 0).all()
    assert quality.score_quality(df, model).count() == len(rows)
    kept = quality.keep_quality(df, model)
    assert kept.columns == df.columns
    none = quality.fit_quality(df, labels.limit(0))
    assert quality.keep_quality(df, none).count() == len(rows)
    scores = toxicity.score_toxicity(df, toxicity.fit_toxicity(toxicity.sample_labels(df, labels, "toxic", 50), 50)).collect()
    assert len(scores) == len(rows) and all(0 <= r.score < 0.5 for r in scores)


def test_url_filter(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{sf_dir}/pages.parquet' union all select * from (values (-1, null, ''), (-2, 'nothing', ''), (-3, 'http://EXAMPLE.org/es/x', ''), (-4, 'http://badexample.org/es/x', ''), (-5, 'http://a.org', ''), (-6, 'http://q.com?x=/de/', ''))")
    pages = spark.createDataFrame(con.sql("select * from pages").fetchall(), "page_id long, url string, html string")
    names = ("page_id", "host", "path", "rule", "verdict")
    assert collected(url_filter.filter_urls(pages, queries.URL_RULES), *names) == sorted(con.sql(f"select {', '.join(names)} from ({queries.SQL['op9_url_filter']})").fetchall(), key=repr)
    assert url_filter.filter_urls(pages.limit(0), queries.URL_RULES).count() == 0
    assert url_filter.UrlTrie([("allow", "a.b", "/"), ("block", "b", "/x")]).match("c.a.b", "/x") == ("a.b/", "allow")


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf_dir).cache()
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= kept
        if name == "substring_dedup":
            assert {r.doc_id: (r.text or "") for r in docs.collect()} == {i: t for i, t in _cut(before)}
        if name != "byte_bpe":
            assert docs.columns == before.columns
        kept = set(ids)
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={})
    last = {r.doc_id: r.text for r in before.collect()}
    assert {r.doc_id: r.ids for r in docs.collect()} == {i: lib.encode_ordinary(t or "") for i, t in last.items()}


def _cut(df):
    rows = [(r.doc_id, (r.text or "").encode()) for r in df.collect()]
    seen = Counter(d[p : p + 200] for _, d in rows for p in range(len(d) - 199))
    for i, d in rows:
        mark = np.zeros(len(d), bool)
        for p in range(len(d) - 199):
            if seen[d[p : p + 200]] > 1:
                mark[p : p + 200] = True
        yield i, bytes(b for b, m in zip(d, mark) if not m).decode(errors="ignore")


def plain_gif(data):
    """Frames (delay, disposal, colours by pixel) of a GIF of whole frames, read code by code and bit by bit."""
    w, h, flags = int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little"), data[10]
    n = 2 << (flags & 7)
    palette, at, out, delay, disposal = [tuple(data[13 + 3 * i : 16 + 3 * i]) for i in range(n)], 13 + 3 * n, [], 0, 0

    def blocks(at):
        body = b""
        while data[at]:
            body += data[at + 1 : at + 1 + data[at]]
            at += data[at] + 1
        return body, at + 1

    while data[at] != 0x3B:
        if data[at] == 0x21:
            label = data[at + 1]
            body, at = blocks(at + 2)
            if label == 0xF9:
                delay, disposal = int.from_bytes(body[1:3], "little"), body[0] >> 2 & 7
            continue
        left, top, fw, fh = (int.from_bytes(data[at + 1 + 2 * i : at + 3 + 2 * i], "little") for i in range(4))
        assert (left, top, fw) == (0, 0, w) and not data[at + 9] & 0xC0
        least = data[at + 10]
        body, at = blocks(at + 11)
        clear, bit, pixels = 1 << least, 0, []
        table, width, before = None, least + 1, None
        while True:
            code = sum((body[(bit + i) // 8] >> (bit + i) % 8 & 1) << i for i in range(width))
            bit += width
            if code == clear:
                table, width, before = [bytes([i]) for i in range(clear)] + [b"", b""], least + 1, None
                continue
            if code == clear + 1:
                break
            text = table[code] if code < len(table) else before + before[:1]
            pixels += text
            if before is not None and len(table) < 4096:
                table.append(before + text[:1])
            before = text
            if len(table) == 1 << width and width < 12:
                width += 1
        assert len(pixels) == fw * fh
        out.append((delay, disposal, [palette[p] for p in pixels]))
    return w, h, out


def test_gif_against_a_plain_decoder(table):
    """All stored media, but for texts so long that reading bits one by one takes minutes; every value of the digest from the decoder's frames."""
    df, rows = table
    df = df.filter("text is null or length(text) < 50000")
    media = {r.doc_id: r for r in gif.text_media(df).filter("doc_id is not null").collect()}
    shown = {r.doc_id: r.frames for r in gif.media_frames(gif.text_media(df)).filter("doc_id is not null").collect()}
    for r in gif.media_digest(df).filter("doc_id is not null").collect():
        raw = bytes(media[r.doc_id].media)
        _, _, frames = plain_gif(raw)
        payload = bytes(c[0] for _, _, pixels in frames for c in pixels)
        counts = Counter(p[0] * 4 // 256 * 16 + p[1] * 4 // 256 * 4 + p[2] * 4 // 256 for _, _, pixels in frames for p in pixels)
        assert (r.payload_sha256, r.payload_bytes, r.tail_crc32) == (hashlib.sha256(payload).hexdigest(), len(payload), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(raw), hashlib.sha256(raw).hexdigest())
        top = sorted(range(64), key=lambda i: (-counts[i], i))[:4]
        assert r.feature == f"frames={len(frames)};ms={10 * sum(d for d, _, _ in frames)};px={len(payload)};top=" + ",".join(f"{i}:{counts[i]}" for i in top)
        assert [(f.delay_ms, f.disposal) for f in shown[r.doc_id]] == [(10 * d, x) for d, x, _ in frames]
        assert [f.time_ms for f in shown[r.doc_id]] == [10 * sum(d for d, _, _ in frames[:i]) for i in range(len(frames))]


def test_damaged_gifs(spark):
    good = gif.samples_to_gif(bytes(range(192)) * 3)
    wide = good[:6] + b"\xff\xff\xff\xff" + good[10:]
    bad = [good[:n] for n in (0, 5, 6, 9, 13, 200, 790, 800, len(good) - 40)] + [b"GIF89a", b"not a gif at all", wide, good[:781] + b"\x99" + good[782:]]
    whole = [good, good[:-1], None]
    rows = [(i, m) for i, m in enumerate([*bad, *whole])]
    got = {r.doc_id: r for r in gif.media_frames(spark.createDataFrame(rows, "doc_id long, media binary")).collect()}
    assert all(got[i].frames is None and got[i].error for i in range(len(bad)))
    assert [len(got[len(bad) + i].frames or ()) for i in range(3)] == [1, 1, 0] and all(got[len(bad) + i].error is None for i in range(3))
    r = random.Random(9)
    for _ in range(300):
        m = bytearray(good)
        for _ in range(r.randint(1, 6)):
            m[r.randrange(len(m))] = r.randrange(256)
        try:
            gif.gif_to_samples(bytes(m))
        except ValueError:
            pass


def test_ordinal_regression():
    """The gradient against finite differences, the loss and the scores against the likelihood written out for one row at a time."""
    r = np.random.default_rng(4)
    x, k = r.normal(size=(40, 5)), r.integers(0, 4, 40)
    row, w, raw, l2 = r.random(40), r.normal(size=5), np.array([-1.2, 0.1, -0.4]), 0.03
    loss, gw, gr = quality.objective(x, k, row, w, raw, l2)
    theta = [raw[0], raw[0] + np.exp(raw[1]), raw[0] + np.exp(raw[1]) + np.exp(raw[2])]
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    want = l2 / 2 * sum(v * v for v in w)
    for xi, ki, ri in zip(x, k, row):
        s = float(sum(a * b for a, b in zip(xi, w)))
        below = lambda j: 0.0 if j < 0 else 1.0 if j > 2 else sigmoid(theta[j] - s)  # noqa: B023, E731
        want -= ri * np.log(below(ki) - below(ki - 1))
    assert abs(loss - want) < 1e-9
    for values, grad, which in ((w, gw, 0), (raw, gr, 1)):
        for i in range(len(values)):
            step = np.zeros(len(values))
            step[i] = 1e-6
            sides = [quality.objective(x, k, row, *((values + d, raw) if which == 0 else (w, values + d)), l2)[0] for d in (step, -step)]
            assert abs((sides[0] - sides[1]) / 2e-6 - grad[i]) < 1e-5
    model = quality.OrdinalModel([1.0, 2.0, 4.0, 7.0], w, np.array(theta))
    for xi, tails in zip(x, model.tails(x)):
        s = float(xi @ w)
        assert np.allclose(tails, [1 - sigmoid(t - s) for t in theta])
        share = np.diff([0.0, *(sigmoid(t - s) for t in theta), 1.0])
        assert abs(float(model.expected(tails[None])[0]) - share @ [1, 2, 4, 7]) < 1e-9
    fitted = quality.fit_ordinal((x + 0.8 * k[:, None]).astype(np.float32), k.astype(float))
    assert np.corrcoef(fitted.expected(fitted.tails((x + 0.8 * k[:, None]).astype(np.float32))), k)[0, 1] > 0.9


def test_licenses_by_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    templates = containment.LICENSE_NOTICES | containment.LICENSE_TEXTS
    docs += [(-1 - i, "start " + t + " end") for i, t in enumerate(templates.values())] + [(9_000, "and permission is hereby granted, free of charge, to any person obtaining a copy"), (None, "Released under the MIT License. " * 3), (9_001, None), (9_002, "")]
    want = []
    for name, t in templates.items():
        own = set(shingles(t))
        words = next(iter(own)) if len(own) == 1 and len(next(iter(own))) < 5 else None
        for i, text in docs:
            held = set(shingles(text, len(words) if words else 5))
            if len(own & held) >= 0.8 * len(own):
                want.append((i, name))
    found = containment.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    assert collected(found, "doc_id", "license") == sorted(want, key=repr)
    assert containment.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_items_without_id_and_in_files(spark, monkeypatch, table):
    """Several indexes lie in the shared folder; an item without an id contaminates like any other."""
    items = spark.createDataFrame([(None, "alpha beta gamma delta epsilon zeta"), (5, "one two three four five six"), (5, "one two three four five six"), (6, "uno dos tres cuatro cinco seis"), (None, None)], "item_id long, text string")
    docs = spark.createDataFrame([(None, "x alpha beta gamma delta epsilon zeta", 1), (2, "one two three four five six seven", 2), (2, "clean", 3), (3, None, 4), (3, "uno dos tres cuatro cinco seis", 5)], "doc_id long, text string, item_id int")
    want = sorted([(None, None), (2, 5), (2, 5), (3, 6)], key=repr)
    for bound in (2_000_000, 24):
        monkeypatch.setattr(containment.ContainmentIndex, "MAX_SHINGLES", bound)
        indexes = containment.index_batches(items, "item_id", "text")
        assert isinstance(indexes[0], containment.IndexFile) == (bound == 24) and (len(indexes) > 1) == (bound == 24)
        assert collected(containment.find_items(docs, indexes), "doc_id", "item_id") == want
        kept = containment.drop_contaminated(docs, indexes)
        assert kept.columns == docs.columns and sorted(r.item_id for r in kept.collect()) == [3, 4]
    assert containment.drop_contaminated(docs.limit(0), indexes).count() == 0
    clean = containment.drop_contaminated(table[0], containment.index_batches(items, "item_id", "text"))
    assert clean.columns == table[0].columns and clean.count() == table[0].count()


def test_rules_in_turns(monkeypatch):
    rules = [*queries.URL_RULES, ("block", "org", "/a/"), ("allow", "x.example.org", "/"), ("block", "x.example.org", "/e")]
    urls = [f"http://{h}{p}" for h in ("org", "example.org", "x.example.org", "y.x.example.org", "com", "q.com", "net") for p in ("", "/", "/es/", "/e", "/en/1", "/a/b", "/fr/", "/de/x")]
    whole = url_filter.UrlTrie(rules)
    want = [whole.match(*url_filter.split_url(u)) for u in urls]
    for n in (1, 2, 5):
        monkeypatch.setattr(url_filter, "MAX_RULES", n)
        tries = [url_filter.UrlTrie(rules[i : i + n]) for i in range(0, len(rules), n)]
        for u, w in zip(urls, want):
            best = (None, "allow", [0, 0])
            for t in tries:
                best = max(best, t.find(*url_filter.split_url(u)) or best, key=lambda x: x[2])
            assert best[:2] == w


def test_rules_in_turns_on_pages(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "http://example.org/es/a"), (2, None), (None, "https://q.com/de/"), (2, "nothing"), (2, "nothing")], "page_id long, url string")
    names = ("page_id", "host", "path", "rule", "verdict")
    whole = collected(url_filter.filter_urls(pages, queries.URL_RULES), *names)
    monkeypatch.setattr(url_filter, "MAX_RULES", 2)
    assert collected(url_filter.filter_urls(pages, queries.URL_RULES), *names) == whole and len(whole) == 5
    with pytest.raises(ValueError, match="both"):
        url_filter.filter_urls(pages, [("allow", "a", "/"), ("allow", "b", "/"), ("block", "a", "/")])


def test_empty_tables(spark, table):
    none, labels = table[0].limit(0), spark.createDataFrame([(1, 0, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    assert byte_bpe.encode_documents(none, RANKS, public_tokenizers.PATTERN).count() == 0
    assert gif.media_digest(none).count() == 0 and gif.media_frames(gif.text_media(none)).count() == 0
    model = quality.fit_quality(none, labels)
    assert quality.score_quality(none, model).count() == 0 and quality.keep_quality(none, model).count() == 0
    tox = toxicity.fit_toxicity(toxicity.sample_labels(none, labels, "toxic", 50), 50)
    assert toxicity.score_toxicity(none, tox).count() == 0
    assert near_dup.keep_one(none, near_dup.near_duplicates(none)).count() == 0
    assert substring_dedup.remove_repeats(none).count() == 0 and near_dup.keep_one(none, near_dup.near_duplicates(none)).columns == none.columns


def test_shards_are_read_by_select(monkeypatch, spark, tmp_path, table):
    """No reader decodes a whole sequence of boundaries or ids."""
    shards = token_files.write_token_files(table[0], WORDS, f"file://{tmp_path}/s", shard_ids=200)
    path = shards.first().path.removeprefix("file://")

    def never(self):
        raise AssertionError("decoded at once")

    monkeypatch.setattr(token_files.EliasFano, "values", never)
    with open(path, "rb") as f:
        shard = token_files.Shard(f.read())
    assert sum(len(shard[i]) for i in range(shard.docs)) == len(shard.ids) and shard.doc_id(0) is None
    assert [(d, len(shard[i])) for i, (d, *_) in enumerate(shard.documents())] == [(shard.doc_id(i), b - a) for i, (_, a, b) in enumerate(shard.documents())]
    import inspect

    assert "values()" not in inspect.getsource(token_files.read_token_files) and "values()" not in inspect.getsource(token_files.Shard)


def test_many_rows_of_one_id(spark, tmp_path):
    """Equal doc_ids and null ones are dealt out by their texts, and still stand in order."""
    rows = [(None if i % 2 else 7, f"text {i:04}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = [r.doc_id for r in sorted(token_files.encode_to_files(df, WORDS, f"file://{tmp_path}/t").collect(), key=lambda r: r.start)]
    assert out == [None] * 300 + [7] * 300
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # few rows would be put together again
    try:
        parts = token_files.write_token_files(df, WORDS, f"file://{tmp_path}/u").groupBy("part").agg(F.sum("n_docs").alias("n")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert max(r.n for r in parts) < 400


@pytest.mark.parametrize("name", ["quality", "near_dup", "substring_dedup", "decontamination", "byte_bpe"])
def test_stages_on_odd_rows(spark, table, tmp_path, name):
    """Every stage on null, empty, long and repeated texts, repeated and null doc_ids, names that clash, and on no rows."""
    import corpus_pipeline

    df, rows = table
    docs = df.withColumns({"starts": F.lit(1), "__key": F.lit("x"), "root": F.lit(2), "item_id": F.lit(3)})
    spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "never in any of the texts at all"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, str(tmp_path))
    got = out.collect()
    assert len(got) <= len(rows) and {r.doc_id for r in got} <= {i for i, _ in rows}
    if name in ("decontamination", "byte_bpe", "substring_dedup"):
        assert len(got) == len(rows)
    if name != "byte_bpe":
        assert out.columns == docs.columns
    none = stage(spark, docs.limit(0), str(tmp_path))
    assert none.count() == 0 and none.columns == out.columns


def test_long_repeats(spark):
    """Texts of over 100,000 characters that share long passages, against brute force on the passages' places."""
    r = random.Random(12)
    say = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    shared = say(30_000)
    texts = [say(70_000) + shared + say(40_000), say(1_000) + shared[5_000:] + say(90_000), shared[:199] + say(500), shared[:200] + say(500)]
    got = {x.doc_id: x for x in substring_dedup.dedup_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0].n_bytes == 140_000 and list(got[0].spans) == [70_000, 70_200, 75_000, 100_000] and got[0].n_removed == 25_200
    assert got[1].n_removed == 25_000 and got[2].n_removed == 0 and got[3].n_removed == 200


def test_slices(monkeypatch):
    import pyarrow as pa

    from lattica.llm import common

    monkeypatch.setattr(common, "SLICE_BYTES", 100)
    texts = ["a" * n for n in (3, 90, 20, 500, 0, 1, 60, 60)] + [None] * 9
    batch = pa.RecordBatch.from_pydict({"i": list(range(17)), "t": texts})
    parts = list(common.slices(batch, 4))
    assert [x for p in parts for x in p.column(0).to_pylist()] == list(range(17))
    assert all(p.num_rows == 1 or p.num_rows <= 4 and sum(len(t or "") for t in p.column(1).to_pylist()) <= 100 for p in parts)
    assert list(common.slices(batch.slice(0, 0), 4)) == []
