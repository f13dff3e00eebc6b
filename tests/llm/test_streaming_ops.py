"""Packing, decontamination, language ID and SimHash against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash

from lumenfold.llm import decontaminate, langid, packing, simhash
from lumenfold.llm.components import components
from lumenfold.llm.common import Scratch

public_tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, k_ string, _text string"


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame([(*r, *[None] * (5 - len(r))) for r in rows] if schema == DOCS else rows, schema)


# -- packing


@pytest.mark.parametrize("n", [1, 2, 3, 2047, 2048, 2049, 5000, 6144])
def test_binary_pieces_cover_once(n):
    got = packing.binary_pieces(n, 2048)
    assert [p for s, l in got for p in range(s, s + l)] == list(range(n))
    assert all(l & (l - 1) == 0 and l <= 2048 for _, l in got)


def test_encoder_equals_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, enc = Tokenizer.from_file(path), packing.Encoder(path)
    assert enc.fast is not None
    texts = ["Hello  world\n\n x", "don't WE'll 12ab3", "a\x1cb\x85c", "tab\t\t x ", "é​ü   y", "漢字 テスト 🙂🙂", "<|endoftext|> x<|endoftext|>", " " * 300, "a" * 5000, "x\r\n y", "ࡰ \U0001f1e6 \U00010400", ""]
    draw = random.Random(3)
    texts += ["".join(draw.choice("ab 'sé\n\t.,1$ñ") for _ in range(draw.randint(1, 90))) for _ in range(300)]
    for t in texts:
        assert enc.encode(t) == np.asarray(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def test_pack_round_trip(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    rows = [(1, "hello big world " * 700), (2, None), (3, ""), (3, "tie"), (3, "tie"), (None, "no id"), (5, "x" * 60000)]
    got = packing.pack(frame(spark, rows), path).collect()
    assert len({r.sequence_id for r in got}) == len(got)
    docs = {}
    for r in got:
        assert r.offset == 0 and r.length == 1 << r.bucket and len(r.ids) == 4 * r.length
        docs.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.ids))
    for i, t in rows[:2] + rows[5:]:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        assert b"".join(b for _, b in sorted(docs[i, len(ids)])) == np.asarray(ids, "<u4").tobytes()
    assert packing.pack(frame(spark, rows).where("false"), path).count() == 0


def test_sure_characters_are_in_the_same_classes():
    """Each character that may take the fast way, among letters, digits, spaces and itself."""
    import re

    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, enc = Tokenizer.from_file(path), packing.Encoder(path)
    assert enc.fast is not None
    chars = [c for c in map(chr, range(0x20000)) if re.fullmatch(f"[{packing.SURE}]", c)]
    assert len(chars) > 30_000
    texts = ["".join(f"a{c}b {c}1{c} {c}{c}.{c}\n" for c in chars[i : i + 8]) for i in range(0, len(chars), 8)]
    texts += [f"{c} x" for c in chars[:0x600]] + [f"x {c}" for c in chars[:0x600]]
    assert not any(packing._UNSURE.search(t) for t in texts)
    for t, want in zip(texts, tok.encode_batch(texts, add_special_tokens=False)):
        assert enc.encode(t) == np.asarray(want.ids, "<u4").tobytes(), t


def test_pack_query_against_the_library(spark):
    """The query's pieces, cut anew from what the library says of each whole text."""
    from tokenizers import Tokenizer

    from lumenfold.llm.queries import op7_packing

    d = "/root/testdata/sf0.01"
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect():
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 1]
        at = 0
        while at < len(ids):
            n = 2048
            while n > len(ids) - at:
                n //= 2
            want.append((r.doc_id, at, n, zlib.crc32(np.asarray(ids[at : at + n], "<u4").tobytes()), len(ids), 0))
            at += n
    got = op7_packing(spark, d).collect()
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, r.offset) for r in got) == sorted(want)
    assert len({r.sequence_id for r in got}) == len(got)


def test_batches_hold_equal_lengths(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    packed = packing.pack(frame(spark, [(i, "word " * i) for i in range(1, 60)] + [(7, None), (7, None)]), path, max_len=16)
    got = packing.batches(packed, 5).collect()
    assert len(got) == packed.count()
    held = {}
    for r in got:
        held.setdefault((r.bucket, r.batch), []).append(r.place)
        assert r.length == 1 << r.bucket
    assert all(sorted(p) == list(range(len(p))) and len(p) <= 5 for p in held.values())
    for bucket in {b for b, _ in held}:
        own = sorted(n for b, n in held if b == bucket)
        assert own == list(range(len(own))) and all(len(held[bucket, n]) == 5 for n in own[:-1])
    assert packing.batches(packed.where("false"), 5).count() == 0


# -- decontamination


def test_blocks_part_long_items(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 25)
    items = [(1, " ".join(f"w{i}" for i in range(100))), (2, "a b"), (3, None), (4, "")]
    blocks = list(decontaminate._blocks(spark.createDataFrame(items, "item_id long, text string"), "item_id", "text", 10))
    assert all(sum(len(decontaminate.words_of(t)) for _, t in b) <= 25 for b in blocks)
    wins = {tuple(ws[a : a + 10]) for b in blocks for _, t in b for ws in [t.split()] for a in range(len(ws) - 9)}
    assert wins == {tuple(f"w{i + k}" for k in range(10)) for i in range(91)}


@pytest.mark.parametrize("block", [200_000, 20])
def test_remove_on_odd_tables(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    item = " ".join(f"w{j}" for j in range(30))
    rows = [(1, None, "a"), (2, "", "b"), (3, item, "c"), (4, f"{item} " + "x " * 90, "d"), (4, f"{item} " + "x " * 90, "d"), (None, "free", None)]
    df = spark.createDataFrame(rows, "tid long, text string, spans string").withColumnRenamed("spans", "own")
    bench = spark.createDataFrame([(7, item), (8, "other " * 30), (9, None)], "item_id long, text string")
    got = decontaminate.remove(df, bench)
    assert got.columns == df.columns
    assert sorted(((r.tid, r.text and r.text.split(), r.own) for r in got.collect()), key=str) == sorted([(1, None, "a"), (2, "", "b"), (4, ["x"] * 90, "d"), (4, ["x"] * 90, "d"), (None, ["free"], None)], key=str)
    assert decontaminate.remove(df.where("false"), bench).count() == 0
    assert sorted(decontaminate.remove(df, bench.where("false")).collect(), key=str) == sorted(df.collect(), key=str)
    assert decontaminate.find(df.where("false"), bench, keep=("tid",)).count() == 0


def test_automaton_of_a_block_stays_flat():
    draw = random.Random(3)
    items = [(str(i), " ".join(f"w{draw.randrange(5000)}" for _ in range(200))) for i in range(100)]
    auto = decontaminate.Automaton(items, 10)
    assert len(auto._len) <= 2 * 20_000 and len(auto._more) <= 3 * 20_000
    assert len(auto._word) == len(auto._to) == len(auto._link) == len(auto._set_of) == len(auto._end_of) == len(auto._len)


def brute(docs, items, w=10):
    import re

    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    split = lambda t: word.findall(t.translate(low)) if t else []
    wins = {}
    for i, t in items:
        ws = split(t)
        for a in range(max(1, len(ws) - w + 1) if ws else 0):
            wins.setdefault(tuple(ws[a : a + w]), set()).add("" if i is None else str(i))
    out = []
    for _, t in docs:
        ws, hit, found = split(t), set(), set()
        for win, names in wins.items():
            for a in range(len(ws) - len(win) + 1):
                if tuple(ws[a : a + len(win)]) == win:
                    hit |= set(range(a, a + len(win)))
                    found |= names
        out.append((len(ws), len(hit), sorted(found)))
    return out


def cases(seed=1):
    draw = random.Random(seed)
    voc = ["a", "B", "c3", "é", "d", "Ñ"]
    say = lambda n: " ".join(draw.choice(voc) + draw.choice(["", ",", ".\n"]) for _ in range(n))
    items = [(i, say(draw.choice([1, 4, 9, 10, 11, 15, 30]))) for i in range(12)] + [(3, say(12)), (None, "zz yy xx"), (99, None), (98, " .,")]
    docs = [(i, say(draw.choice([0, 3, 40, 120]))) for i in range(25)] + [(77, None), (78, ""), (79, "q " * 20 + items[4][1] + " q"), (79, "zz. YY xx zz yy xx"), (None, items[0][1])]
    return docs, items


@pytest.mark.parametrize("block", [200_000, 20])
def test_find_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    docs, items = cases()
    got = decontaminate.find(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), keep=("doc_id", "text")).collect()
    key = lambda r: (str(r[0]), str(r[1]), r[2:])
    mine = sorted(((r.doc_id, r.text, r.n_words, sum(s.end - s.start for s in r.spans), r["items"]) for r in got), key=key)
    want = sorted(((i, t, *b) for (i, t), b in zip(docs, brute(docs, items))), key=key)
    assert mine == want


@pytest.mark.parametrize("block", [200_000, 40])
def test_remove_leaves_no_window_and_clean_documents(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    long = [" ".join(f"w{i}x{j}" for j in range(14)) for i in range(4)]
    filler = " ".join(f"f{j}" for j in range(60))
    items = list(enumerate(long))
    split = long[0].split()
    nested = " ".join(split[:5]) + " " + long[1] + " " + " ".join(split[5:]) + " " + filler
    docs = [(1, filler), (2, filler + " " + long[0].upper() + " " + filler), (3, long[2]), (4, None), (5, nested), (6, "Clean, text."), (6, "Clean, text.")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.remove(frame(spark, docs), bench).collect()
    by = {r.doc_id: r.text for r in got}
    assert set(by) == {1, 2, 4, 5, 6} and len(got) == 6
    assert by[1] == filler and by[4] is None and by[6] == "Clean, text."
    assert by[2].split() == filler.split() * 2
    assert by[5].split() == filler.split()
    assert not any(h for _, h, _ in brute([(i, t) for i, t in by.items()], items))


@pytest.mark.parametrize("block", [200_000, 20])
def test_hits_of_all_blocks_count_together(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    items = [(i, " ".join(f"w{i}x{j}" for j in range(20))) for i in range(3)]
    filler = [f"f{j}" for j in range(80)]
    most = " ".join([*filler[:20], items[0][1], *filler[20:30], items[1][1], *filler[30:40], items[2][1]])
    some = " ".join([*filler[:30], items[0][1], *filler[30:60], items[1][1]])
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.remove(frame(spark, [(1, most), (2, some), (3, None)]), bench).collect()
    assert {r.doc_id: r.text and r.text.split() for r in got} == {2: filler[:60], 3: None}


# -- language ID


def test_bloom_filter_returns_all_languages_of_an_ngram():
    a, b = np.arange(1, 5000, dtype=np.uint64), np.arange(4000, 9000, dtype=np.uint64)
    m = langid.Model.build({"a": a, "b": b}, 3, 18)
    masks = m.masks(np.arange(1, 9000, dtype=np.uint64))
    assert all(masks[:4999] & 1) and all(masks[3999:] & 2)
    assert (masks[:3999] & 2).mean() < 0.01 and (masks[4999:] & 1).mean() < 0.01


def test_language_id(spark):
    draw = random.Random(5)
    voc = {"xx": ["bara", "tomi", "keludo", "na"], "yy": ["ströng", "fjäll", "och", "det"]}
    docs = [(i, " ".join(draw.choices(voc[l], k=30)), l) for i in range(60) for l in ("xx", "yy")]
    odd = [(500, None, "xx"), (501, "", None), (502, "123 $$ _", None), (503, "Q", None), (504, "bara tomi " * 20000, None), (None, "och det", "yy"), (505, "och", None), (505, "och", None)]
    df = frame(spark, docs + odd)
    model = langid.train(df)
    got = {(r.doc_id, r.lang): r for r in langid.predict(df, model, keep=("doc_id", "lang")).collect()}
    assert all(got[i, l].lang_pred == l for i, _, l in docs)
    assert all(got[i, l].lang_pred == "und" and got[i, l].score == 0 for i, l in ((500, "xx"), (501, None), (502, None)))
    assert got[503, None].lang_pred in voc and got[504, None].lang_pred == "xx" and got[505, None].lang_pred == "yy"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.predict(df.where("false"), langid.train(df.where("false"))).count() == 0


def test_more_languages_than_bits_of_a_word(spark):
    draw = random.Random(8)
    voc = {f"l{i:03}": ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(6)] for i in range(130)}
    docs = [(i * 1000 + k, " ".join(draw.choices(voc[l], k=20)), l) for i, l in enumerate(voc) for k in range(2)]
    df = frame(spark, docs)
    model = langid.train(df)
    assert sorted(model.langs) == sorted(voc)
    assert all(r.lang_pred == r.lang for r in langid.predict(df, model, keep=("doc_id", "lang")).collect())


def test_held_out_accuracy(spark):
    from lumenfold.llm.queries import op3_language_id

    d = "/root/testdata/sf0.01"
    got = op3_language_id(spark, d).where("held_out").join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got) > 0
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in got)


def test_language_query_against_exact_ngrams(spark):
    """Sets of n-grams in place of the Bloom filter say the same language and nearly the same score."""
    from lumenfold.llm.queries import op3_language_id

    d = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang").collect()
    fold = lambda t: "  " + "".join(c.lower() if c.isascii() else c for c in "".join(c if c.isalpha() or ord(c) > 127 else " " for c in t)) + "  "

    def ngrams(t):
        b = fold(t).encode()
        return [g for g in (b[i : i + 5] for i in range(len(b) - 4)) if b"  " not in g]

    counts = {}
    for r in rows:
        if r.text is not None and r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            own = counts.setdefault(r.lang, {})
            for g in ngrams(r.text):
                own[g] = own.get(g, 0) + 1
    held = {lang: {g for g, n in own.items() if n >= 2e-5 * sum(own.values())} for lang, own in counts.items()}
    got = {r.doc_id: r for r in op3_language_id(spark, d).collect()}
    assert len(got) == len(rows)
    for r in rows:
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        own = ngrams(r.text)
        hits = {lang: sum(g in s for g in own) for lang, s in held.items()}
        ranked = sorted(hits.values(), reverse=True)
        if own and ranked[0] > 1.05 * ranked[1]:
            assert got[r.doc_id].lang_pred == max(hits, key=hits.get)
            assert abs(got[r.doc_id].score - ranked[0] / len(own)) < 0.05


# -- SimHash


def plain_fp(text):
    words = text.encode().lower().split() if text else []
    runs = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(nodes, linked):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("block", [128, 2])
@pytest.mark.parametrize("bits", [1, 2])
def test_links_connect_all_near_fingerprints(spark, monkeypatch, block, bits):
    monkeypatch.setattr(simhash, "PAIR_BLOCK", block)
    draw = random.Random(8)
    fps = {0}
    for _ in range(25):
        x = draw.getrandbits(64)
        fps.add(x)
        for _ in range(8):
            x ^= 1 << draw.randrange(64)
            if draw.random() < 0.6:
                x ^= 1 << draw.randrange(64)
            fps.add(x)
    if block == 2:  # a crowd within a few bits of each other, which no pivot parts
        fps |= {x ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(12)}
    fps = sorted(map(simhash._signed, fps))
    scratch = Scratch(spark)
    got = {r.node: r.root for r in components(simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), bits, scratch), scratch).collect()}
    near = [(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= bits]
    want = groups(fps, near)
    assert {x: got.get(x, x) for x in fps} == want


def test_cells_keep_all_near_pairs(spark):
    """Pairs within two bits in one block meet in the seeker's cells."""
    from pyspark.sql import functions as F

    draw = random.Random(21)
    base = [draw.getrandbits(64) for _ in range(200)]
    rows = [(i, simhash._signed(x ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64))), simhash._signed(x)) for i, x in enumerate(base)]
    df = spark.createDataFrame(rows, "i long, p long, q long")
    coords = lambda c: F.array(*[simhash._distance(F.col(c), p) for p in simhash.pivots()[1]])
    for a, b in (("p", "q"), ("q", "p")):
        assert df.where(~F.array_contains(simhash._cells(F.lit(1).cast("long"), coords(a), 2), simhash._cell(F.lit(1).cast("long"), coords(b)))).count() == 0


def test_near_duplicates(spark):
    draw = random.Random(2)
    base = [f"w{draw.randrange(500)}" for _ in range(300)]
    rows = [(10, " ".join(base)), (11, " ".join(base).upper()), (12, " ".join([*base, "more"])), (3, None), (2, ""), (9, " \t "), (20, "alpha"), (21, "two words"), (21, "two words"), (None, "ALPHA"), (30, "z " * 50000)]
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    fps = [plain_fp(t) for _, t in rows]
    assert len(got) == len(rows)
    near = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    label = groups(range(len(rows)), near)
    least = {}
    for n, r in label.items():
        if rows[n][0] is not None:
            least[r] = min(least.get(r, 10**9), rows[n][0])
    want = sorted((str(rows[n][0]), simhash._signed(fps[n]), least[label[n]]) for n in label)
    assert sorted((str(r.doc_id), r.fp, r.component) for r in got) == want
    assert simhash.near_duplicates(frame(spark, rows).where("false")).count() == 0


def test_components_of_a_chain_and_a_hub(spark):
    draw = random.Random(4)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(300)] + [(5, 5), (None, 3), (200, 199)]
    draw.shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(300)}}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).count() == 0


def test_decontamination_query_on_the_tables(spark):
    from lumenfold.llm.queries import op10_decontamination

    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    want = {i: b for (i, _), b in zip(docs, brute(docs, items))}
    got = op10_decontamination(spark, d).collect()
    assert len(got) == len(docs) and any(r.contaminated for r in got)
    for r in got:
        n, h, found = want[r.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == (n, h, len(found), hashlib.sha256(",".join(found).encode()).hexdigest())


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from lumenfold.llm import common

    def session(master, named=None):
        conf = SimpleNamespace(get=lambda k, d=None: named)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId="a", getConf=lambda: conf))

    assert common.scratch_root(session("spark://host", "hdfs://x/")) == "hdfs://x/lumenfold-a"
    for master in ("spark://host", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            common.scratch_root(session(master))


def test_a_scope_drops_what_was_written_inside(spark):
    from lumenfold.llm.common import scope

    outer = Scratch(spark)
    with scope():
        kept = outer.cut(Scratch(spark).cut(spark.range(5)))
        inner = Scratch(spark).cut(spark.range(7)).inputFiles()[0]
    import os

    assert kept.count() == 5 and not os.path.exists(inner.removeprefix("file:"))


def test_prefix_sums_part_rows_that_tie(spark):
    """Rows equal in the whole order are dealt over several partitions."""
    from pyspark.sql import functions as F

    from lumenfold.llm.prefix import prefix_sums

    df = spark.range(4000).select(F.lit(1).alias("g"), F.lit(2).alias("o"), F.lit(3).cast("long").alias("n")).repartition(8)
    scratch = Scratch(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = prefix_sums(df, ["g"], [F.col("o")], ["n"], scratch).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((r.row_before, r.n_before) for r in got) == [(i, 3 * i) for i in range(4000)]
    assert spark.read.parquet(scratch.made[0]).select("_part").distinct().count() > 1
