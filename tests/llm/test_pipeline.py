"""Near-copy groups and the corpus pipeline against brute force."""

import random

import numpy as np
import pytest

import corpus_pipeline
from lumenfold.llm import decontaminate, neardup, packing
from lumenfold.llm.common import Scratch

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, k=5):
    w = text.encode().lower().split() if text else []
    return {b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def plain_groups(rows, least=0.8):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (not a and not b) or (a and b and len(a & b) / len(a | b) >= least):
                root[top(i)] = top(j)
    out = {}
    for i in range(len(rows)):
        out.setdefault(top(i), []).append(rows[i][0])
    return out.values()


def corpus(seed=3, families=12, copies=12):
    draw = random.Random(seed)
    rows, n = [], 0
    for f in range(families):
        text = [f"w{draw.randrange(3000)}" for _ in range(draw.choice([6, 40, 300, 900]))]
        for c in range(draw.randint(1, copies)):
            now = list(text)
            for _ in range(int(len(now) * draw.choice([0, 0, 0.002, 0.01, 0.02, 0.06]))):
                now[draw.randrange(len(now))] = f"x{draw.randrange(10**6)}"
            rows.append((n, " ".join(now)))
            n += 1
            if draw.random() < 0.3:
                text = now
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOC)


@pytest.mark.parametrize("block", [32, 2])
def test_one_of_each_group_stays(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "PAIR_BLOCK", block)
    rows = corpus()
    draw = random.Random(1)
    draw.shuffle(rows)
    odd = [(900, None), (901, ""), (902, " \n"), (903, "solo"), (904, "SOLO"), (905, "Solo\nword"), (906, "z " * 30000)]
    got = [r.doc_id for r in neardup.drop_near_copies(frame(spark, rows + odd)).collect()]
    assert sorted(got) == sorted(min(g) for g in plain_groups(rows + odd))


def test_repeated_rows_and_null_keys(spark):
    base = " ".join(f"q{i}" for i in range(40))
    df = frame(spark, [(None, base), (None, base), (7, base + " end"), (5, "other"), (5, "other"), (5, "third thing"), (None, "alone")])
    got = sorted(((r.doc_id, r.text) for r in neardup.drop_near_copies(df).collect()), key=str)
    assert got == sorted([(7, base + " end"), (5, "other"), (5, "third thing"), (None, "alone")], key=str)
    assert neardup.drop_near_copies(df).columns == df.columns
    assert neardup.drop_near_copies(df.where("false")).count() == 0


def test_columns_may_have_any_names(spark):
    base = " ".join(f"q{i}" for i in range(40))
    rows = [(1, base, "a", "b", 3, 4, "z"), (2, base + " end", "a", "b", 3, 4, "z"), (3, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string, tid string, fp long, bands long, _c0 string")
    got = neardup.drop_near_copies(df)
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == [1, 3]


def test_pairs_at_the_stated_similarity_are_found(spark):
    """Recall of single links between 0.8 and 0.95, through bands, fingerprints and verification."""
    draw = random.Random(31)
    rows = []
    for i in range(300):
        n = draw.choice([60, 200, 500])
        words = [f"w{draw.randrange(10**6)}" for _ in range(n)]
        # A new word breaks five shingles of n: so many that the similarity stays at 0.8 or just over.
        other = list(words)
        most = max(1, int((n - 4) / 9 / 5))
        for at in draw.sample(range(n), draw.randint(1, most)):
            other[at] = f"x{draw.randrange(10**6)}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    sets = [shingles(t) for _, t in rows]
    near = [i for i in range(0, len(rows), 2) if len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1])]
    kept = {r.doc_id for r in neardup.drop_near_copies(frame(spark, rows)).collect()}
    assert len(near) > 250 and sum(i + 1 not in kept for i in near) >= 0.99 * len(near)
    assert all(i + 1 in kept for i in range(0, len(rows), 2) if i not in near)


def test_run_on_odd_tables(spark, tmp_path):
    """An empty table, then nulls in all columns, empty texts, repeated rows."""
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    clean = [tuple(r) for r in source.where("lang is not null and n_chars between 1500 and 4000").limit(12).collect()]
    odd = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (None, "short one", None, None, 9), (2, clean[0][1], None, None, None), (2, clean[0][1], None, None, None)]
    for name, rows in (("none", []), ("odd", clean + odd)):
        d = str(tmp_path / name)
        spark.createDataFrame(rows, source.schema).write.parquet(f"{d}/documents.parquet")
        bench.where("false" if not rows else "true").write.parquet(f"{d}/benchmark.parquet")
        got = corpus_pipeline.run(spark, d).collect()
        assert bool(got) == bool(rows)
        texts = {(r.doc_id, r.start, r.length) for r in got}
        assert len(texts) == len(got) and None not in {r.doc_id for r in got}


def test_language_stage_names_each_document_s_language(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    from pyspark.sql import functions as F

    part = F.col("doc_id") % 4 == 0
    hidden = docs.withColumn("lang", F.when(~part, F.col("lang")))
    want = {r.doc_id: r.lang for r in docs.where(part & F.col("n_chars").between(400, 10**6)).collect()}
    got = {r.doc_id: r.lang for r in corpus_pipeline.language(spark, hidden, d).where(part).collect()}
    assert sum(got.get(i) == lang for i, lang in want.items()) >= 0.97 * len(want) > 0
    assert corpus_pipeline.language(spark, docs.where("false"), d).count() == 0


def test_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = Scratch(spark).cut(stage(spark, docs, d))
        seen[name] = (docs, out)
        if name != "packing":
            assert out.columns == columns
        docs = out
    kept = seen["near_copies"]
    rows = [(r.doc_id, r.text) for r in kept[0].collect()]
    assert sorted(r.doc_id for r in kept[1].collect()) == sorted(min(g) for g in plain_groups(rows))
    before, after = ({r.doc_id: r.text for r in x.collect()} for x in seen["benchmarks"])
    auto = decontaminate.Automaton([(str(r.item_id), r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()], 10)
    assert not any(auto.scan(decontaminate.words_of(t))[0] for t in after.values())
    assert all(after.get(i) == t for i, t in before.items() if not auto.scan(decontaminate.words_of(t))[0])
    import public_tokenizers

    enc = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = {}
    for r in seen["packing"][1].collect():
        pieces.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
    assert {i: b"".join(b for _, b in sorted(p)) for i, p in pieces.items()} == {i: enc.encode(t) + b"\1\0\0\0" for i, t in after.items()}


def test_run_equals_its_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, d)
    want = sorted((r.doc_id, r.start, bytes(r.ids)) for r in docs.collect())
    assert sorted((r.doc_id, r.start, bytes(r.ids)) for r in corpus_pipeline.run(spark, d).collect()) == want


def test_bands_meet_at_the_stated_similarity():
    draw, met, pairs = np.random.default_rng(2), 0, 200
    for _ in range(pairs):
        h = draw.integers(0, 2**63, 1000, dtype=np.uint64)
        a, b = h[:900], np.concatenate([h[100:900], h[900:]])  # 800 of 1000
        met += bool(set(neardup.bands(a)) & set(neardup.bands(b)))
    assert met >= 0.99 * pairs


def test_copies_with_repeated_lines_are_grouped(spark):
    draw = random.Random(12)
    rows = []
    for i in range(40):
        words = [f"w{draw.randint(0, 10**6)}" for _ in range(200)]
        line = " ".join(f"r{draw.randint(0, 10**6)}" for _ in range(6))
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words) + f"\n{line}" * 20)]
    got = neardup.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == [2 * i for i in range(40)]
