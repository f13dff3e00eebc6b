"""Lexer, predicates and metrics of Rust source, and reports over small trees."""

import pytest

from lumenfold.functions import cfg
from lumenfold.functions.rust_lexer import COMMENT, LITERAL, lex
from lumenfold.functions.rust_syntax import measure
from lumenfold.plans import snapshot
from lumenfold.sources import tree


def sums(text, profile=None):
    r = measure("src/lib.rs", text.encode(), profile)
    return dict(zip(snapshot.metrics.METRICS, map(sum, zip(*r.metrics)))), r


def test_lexer_is_lossless():
    s = "/* a /* b */ c */ fn r#f<'a>(x: &'a str) -> char { b'\\'' ; '\"' ; r##\"x\"# y\"## ; 1.0e-3_f64; 0..=9; x.0.1; \"\\\" \n z\" } // é\n"
    tokens = lex(s)
    assert "".join(t.text for t in tokens) == s
    assert [t.text for t in tokens if t.kind == COMMENT] == ["/* a /* b */ c */", "// é"]
    assert [t.text for t in tokens if t.kind == LITERAL] == ["b'\\''", "'\"'", 'r##"x"# y"##', "1.0e-3_f64", "0", "9", "0.1", '"\\" \n z"']


@pytest.mark.parametrize(
    "text,physical,code,comments,docs,blank",
    [
        ("", 0, 0, 0, 0, 0),
        ("\n", 1, 0, 0, 0, 1),
        ("/// doc\n//// no doc\n//! inner\nfn f() {} // tail\n\n", 5, 1, 3, 2, 1),
        ('let s = "one\n\nthree";\n/** block\n\n*/', 6, 3, 3, 3, 0),
    ],
)
def test_line_kinds(text, physical, code, comments, docs, blank):
    m, _ = sums(text)
    assert (m["physical"], m["code"], m["comments"], m["docs"], m["blank"]) == (physical, code, comments, docs, blank)


@pytest.mark.parametrize(
    "text,cyclomatic,cognitive",
    [
        ("fn a(); ", 0, 0),
        ("fn a() {}", 1, 0),
        ("fn a(x: u8) { if x > 1 { if x > 2 { } } }", 3, 3),
        ("fn a(x: u8) { if x > 1 { } else if x > 0 { } else { loop { } } }", 4, 4),
        ("fn a(x: bool) -> R { while x && !x || x { y()?; } Ok(()) }", 5, 4),
        ("fn a(o: Option<u8>) { let Some(v) = o else { if v { } return; }; }", 3, 3),
        ("fn a(v: u8) { match v { 0 | 1 if v > 0 => if v { }, 2 => {} _ => () } }", 5, 4),
        ("fn a() { let f = |x: &u8| if *x > 0 { 1 } else { 2 }; let g = move || 3; }", 4, 1),
        ("const A: u8 = match 1 { 0 => 1, _ => 2 }; static B: &[u8] = &[1];", 3, 1),
        ("fn a() { if x { fn b() { if y {} } } async move { for _ in z {} }; }", 6, 3),
        ("fn a() { mac!{ if x { loop {} } } vec![x?; 3]; }", 1, 0),
        ("impl<T: ?Sized> X for Y<T> where T: Fn(&&u8) -> bool { fn f(&self) -> [u8; { 3 }] { S { a: x?, ..y } ; z } }", 2, 1),
        ("fn a() { for i in 0..n { x = S::<{ 4 }>::new() as u8 as usize; break 'l i; } }", 2, 1),
    ],
)
def test_decisions(text, cyclomatic, cognitive):
    m, r = sums(text)
    assert (m["cyclomatic_authored"], m["cognitive_authored"]) == (cyclomatic, cognitive) and not r.errors


def test_lexical_words_and_operators():
    m, _ = sums("impl<T: ?Sized> A for B<T> { fn f(x: &&u8) { if a && b || c { d == e; mac!(f && g != h, if) } let k = || x?; } }")
    assert m["lexical_complexity"] == 7  # for, if, &&, ||, ==, the macro's if, ?


def test_public_and_gates():
    text = """
pub struct A { pub a: u8, pub(crate) b: u8 }
pub(super) fn c() {}
// with the function
#[cfg(test)]
pub fn d() {
    x();
}
#[cfg(feature = "extra")] pub use a::{b, c};
#[cfg_attr(unknown, cfg(test))]
pub mod e;
"""
    m, r = sums(text)
    assert m["declared_public"] == 5
    assert [r.metrics[s][8] for s in (8, 2, 0, 5)] == [2, 1, 1, 1]
    assert [line.reach for line in r.lines[3:8]] == [(0, 2)] * 5
    assert r.edges[0].gate == (1, 2) and r.edges[0].candidates[0] == "src/e.rs"


def test_predicates():
    p = cfg.Profile(known_true=frozenset({"unix", "target_os=linux"}), known_false=frozenset({"forced"}), closed_names=frozenset({"named"}), enabled=frozenset({"a", "b"}), excluded=frozenset({"b"}))
    value = lambda words: p.reach(cfg.parse(words))
    assert value(["unix"]) == (2, 2) and value(["windows"]) == (0, 0) and value(["test"]) == (0, 2)
    assert value(["feature", "=", '"a"']) == (2, 2) and value(["feature", "=", '"b"']) == (0, 0) and value(["feature"]) == (1, 1)
    assert value(["forced"]) == (0, 0) and value(["named", "=", '"x"']) == (0, 0) and value(["other"]) == (1, 1)
    assert value("all ( unix , not ( other ) )".split()) == (1, 1) and value("any ( )".split()) == (0, 0) and value("all ( )".split()) == (2, 2)
    assert value("nonsense ( x )".split()) == (1, 1)
    assert cfg.Profile(enabled=None).reach(("atom", "feature", "x")) == (1, 1)
    assert p.gate(["tokio", "::", "test"]) == (0, 2) and p.gate(["allow", "(", "x", ")"]) == (2, 2)


def test_deep_nesting_and_broken_source():
    m, r = sums("fn f() " + "{" * 4000 + "}" * 4000)
    assert m["cyclomatic_authored"] == 1 and not r.errors
    m, r = sums("fn f( { if x { let = ; } ) } ] fn g() {}")
    assert r.errors and m["cyclomatic_authored"] >= 1
    assert sums("﻿")[1].bytes == 3
    raw = measure("a.rs", b"fn \xff\n\n // x\n")
    assert raw.metrics[8][:5] == [3, 2, 0, 0, 1] and raw.errors


def test_module_paths_and_includes():
    text = '#[path = "odd.rs"] mod a; mod b { mod c; #[path = "p.rs"] mod d; } include!(concat!("x", "/y.rs")); include!(concat!(env!("OUT_DIR"), "/g.rs")); include!(name); include!(concat!(env!("CARGO_MANIFEST_DIR"), "/z.rs"));'
    r = measure("src/m.rs", text.encode(), None, "/root/pkg")
    assert [e.candidates for e in r.edges] == [
        ["src/odd.rs", "src/m/odd.rs"],
        ["src/m/b/c.rs", "src/m/b/c/mod.rs", "src/c.rs", "src/c/mod.rs"],
        ["src/m/b/p.rs", "src/p.rs"],
        ["src/x/y.rs"],
        [],
        ["/root/pkg/z.rs"],
    ]


def test_discovery(tmp_path):
    def put(path, text=""):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)

    for p in ("a.rs", "b/c.rs", "b/skip.rs", "gen/x.rs", "gen/keep.rs", "_u.rs", ".hid/d.rs", "nested/.git/x", "nested/e.rs", "n.txt", "t/target/f.rs"):
        put(p)
    put(".gitignore", "# c\nskip.rs\n/gen/*\n!keep.rs\ntarget/\n")
    root = str(tmp_path)
    names = lambda **k: [p[len(root) + 1 :] for p in tree.discover([root], **k)]
    assert names() == ["_u.rs", "a.rs", "b/c.rs", "gen/keep.rs"]
    assert names(no_ignore=True) == ["_u.rs", "a.rs", "b/c.rs", "b/skip.rs", "gen/keep.rs", "gen/x.rs", "t/target/f.rs"]
    assert ".hid/d.rs" in names(hidden=True)
    assert tree.discover([f"{root}/b/skip.rs", f"{root}/nested"]) == [f"{root}/b/skip.rs", f"{root}/nested/e.rs"]
    assert tree.common_root([f"{root}/b/c.rs", f"{root}/gen"]) == root


FILES = {
    "src/lib.rs": "mod a;\n#[cfg(test)]\nmod t;\nmod missing;\npub fn f() { if x {} }\n",
    "src/a.rs": "pub fn a() {}\n// note\n",
    "src/t.rs": "mod inner;\nfn t() {}\n",
    "src/t/inner.rs": "fn i() {}\n",
    "src/lost.rs": "#[cfg(test)]\nfn l() {}\n",
    "build.rs": "fn main() {}\n",
}


def frame(spark, files, name="after"):
    return spark.createDataFrame([(name, p, t.encode()) for p, t in files.items()], tree.SCHEMA)


def test_report_by_role(spark):
    files = snapshot.measured(frame(spark, FILES))
    targets = spark.createDataFrame([("after", "src/lib.rs", "production", 2, 2), ("after", "build.rs", "build", 2, 0)], "snapshot string, path string, role string, production int, test int")
    out = snapshot.report(files, targets)
    roles = {(r.path, r.role): r.code for r in out["roles"].collect()}
    assert roles == {("src/lib.rs", "production"): 3, ("src/lib.rs", "test"): 2, ("src/a.rs", "production"): 1, ("src/t.rs", "test"): 2, ("src/t/inner.rs", "test"): 1, ("src/lost.rs", "orphan"): 2, ("build.rs", "build"): 1}
    project = {r.role: (r.files, r.code) for r in out["project"].collect()}
    assert project == {"production": (2, 4), "test": (3, 5), "orphan": (1, 2), "build": (1, 1)}
    [total] = out["total"].collect()
    assert (total.files, total.code, total.comments) == (6, 12, 1) and total.declared_public == 2
    assert [(r.path, r.message) for r in out["diagnostics"].collect()] == [("src/lib.rs", "cannot resolve out-of-line module missing")]
    alone = snapshot.report(files)
    assert {r.role: r.files for r in alone["project"].collect()} == {"production": 3, "test": 4}


def test_comparison(spark):
    new = {**FILES, "src/a.rs": "pub fn a() { if x {} }\n// note\n// more\n", "src/new.rs": "fn n() {}\n"}
    del new["src/lost.rs"]
    both = snapshot.measured(frame(spark, FILES, "before").unionByName(frame(spark, new)))
    out = snapshot.compared(snapshot.report(both)["roles"])
    got = {r.path: (r.status, r.delta_cyclomatic_authored, r.delta_comments, r.percent_comments) for r in out["files"].collect()}
    assert got == {"src/a.rs": ("modified", 1, 1, 100.0), "src/lost.rs": ("deleted", -1, 0, 0.0), "src/new.rs": ("added", 1, 0, 0.0)}
    [s] = out["summary"].collect()
    assert (s.before_code, s.after_code) == (12, 11)
    assert [r.path for r in out["contributors"].collect()] == ["src/lost.rs", "src/new.rs", "src/a.rs"]
    assert out["roles"].count() == 8


def test_sources_that_differ_in_words_of_comments_share_a_walk(monkeypatch):
    from lumenfold.functions import rust_syntax

    walks, one = [], rust_syntax._walked
    monkeypatch.setattr(rust_syntax, "_walked", lambda *a: walks.append(a) or one(*a))
    texts = ["// a\nfn f() { g(\"// x\"); }\n", "// other\nfn f() { g(\"// x\"); }\n", "/// a\nfn f() { g(\"// x\"); }\n", "// a\nfn f() { g(\"// y\"); }\n", "// a\n\nfn f() { g(\"// x\"); }\n", "//// a\nfn f() { g(\"// x\"); }\n"]
    seen = {}
    for t in texts:
        fresh, kept = rust_syntax.measure("a.rs", t.encode()), rust_syntax.measure("a.rs", t.encode(), seen=seen)
        assert (fresh.bytes, fresh.metrics, fresh.errors) == (kept.bytes, kept.metrics, kept.errors)
    assert len(walks) == len(texts) + 4
    for path in ("a.rs", "b/lib.rs"):  # where a module lies depends on the path
        assert rust_syntax.measure(path, b"mod m;\n", seen=seen).edges[0].candidates == rust_syntax.measure(path, b"mod m;\n").edges[0].candidates


def test_sources_are_measured_by_all_cores_and_leave_in_few_batches(spark, monkeypatch):
    from pyspark.sql import functions as F

    from lumenfold.plans import snapshot, source_queries

    parts = source_queries._parts(spark, "/root/testdata/sf0.001")
    held = [r["n"] for r in parts.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(held) >= spark.sparkContext.defaultParallelism and sum(held) == parts.count()
    taken = []
    files = spark.range(1).selectExpr("'after' as snapshot", "'a' as path", "cast('fn f() {}' as binary) as content")
    monkeypatch.setattr(type(files), "mapInArrow", lambda self, run, schema: taken.append(run) or self)
    snapshot.measured(files)
    import pyarrow as pa

    n = 2 * snapshot.ROWS_AT_ONCE + 5
    batch = pa.RecordBatch.from_pylist([{"snapshot": "after", "path": f"{i}.rs", "content": b"fn f() {}\n"} for i in range(n)])
    assert [b.num_rows for b in taken[0](iter([batch]))] == [snapshot.ROWS_AT_ONCE, snapshot.ROWS_AT_ONCE, 5]


def test_files_without_edges_take_no_part_in_the_graph(spark, monkeypatch):
    """Reports of sources without modules ran rounds over all files; two sides were grouped and joined."""
    from lumenfold.operators import graph

    ran = []
    monkeypatch.setattr(graph, "reachable", lambda *a, one=graph.reachable, **k: ran.append(a) or one(*a, **k))
    sources = {f"d{i}/x.rs": f"// {i}\nfn f() {{}}\n#[cfg(test)]\nfn t() {{}}\n" for i in range(5)}
    alone = snapshot.report(snapshot.measured(frame(spark, sources, "before").unionByName(frame(spark, dict(list(sources.items())[1:])))))
    assert not ran
    assert {(r.snapshot, r.role): (r.files, r.code) for r in alone["project"].collect()} == {("before", "production"): (5, 5), ("before", "test"): (5, 10), ("after", "production"): (4, 4), ("after", "test"): (4, 8)}
    out = snapshot.compared(alone["roles"], reported=True)
    plan = out["files"]._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate") == 1
    assert [(r.path, r.status, r.before_code, r.after_code, r.delta_test_code) for r in out["files"].collect()] == [("d0/x.rs", "deleted", 3, 0, -2)]
    assert {r.role: (r.before_files, r.after_code) for r in out["roles"].collect() if r.before_files} == {"production": (5, 4), "test": (5, 8)}
    # One file with an edge: the graph has that file and where it leads, and the others stay as they are.
    some = snapshot.measured(frame(spark, {**sources, "lib.rs": "#[cfg(test)]\nmod m;\n", "m.rs": "fn m() {}\n"}))
    roles = {(r.path, r.role): r.code for r in snapshot.report(some)["roles"].collect()}
    assert ran and roles["m.rs", "test"] == 1 and ("m.rs", "production") not in roles and roles["d0/x.rs", "production"] == 1 and len(roles) == 12


def test_what_comments_say_is_left_out_without_tokens():
    import itertools

    from lumenfold.functions.rust_lexer import plain, said

    by_tokens = lambda texts: "".join([x if x[:2] != "//" else "//!" if x[2:3] == "!" else "///" if x[2:3] == "/" and x[3:4] != "/" else "//" for x in texts])
    for s in map("".join, itertools.product(('"', "'", "/", "//", "\\", "\n", "b", "r#", "!", "a", "/*"), repeat=5)):
        texts = plain(s)
        assert said(s) == (None if texts is None else by_tokens(texts)), s


def test_changes_of_roles_come_from_one_aggregation(spark):
    """Each side was summed by itself and the sums were joined."""
    sources = {f"d{i}/x.rs": "fn f() {}\n" for i in range(3)}
    out = snapshot.compared(snapshot.report(snapshot.measured(frame(spark, sources, "before").unionByName(frame(spark, FILES))))["roles"], reported=True)["roles"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1
    assert {r.role: (r.before_code, r.after_code) for r in out.collect() if r.before_code or r.after_code} == {"production": (3, 5), "test": (0, 7)}


def test_roles_of_two_snapshots_need_one_table(spark, monkeypatch):
    """Files' roles were grouped by file and written before they were summed, and edges that
    weren't there were written and joined."""
    from lumenfold.plans import fixpoint, source_queries

    tables = []
    monkeypatch.setattr(fixpoint, "cut", lambda df, one=fixpoint.cut: tables.append(df.columns) or one(df))
    out = source_queries.q32_changed_roles(spark, "/root/testdata/sf0.001")
    assert len(tables) == 1
    parts = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    files = tuple(parts.where(f"p_partkey % {n} <> 0").count() for n in (10, 7))
    assert {r.role: (r.before_files, r.after_files) for r in out.collect() if r.before_files or r.after_files} == {"production": files, "test": files}


def test_states_sum_to_the_roles_of_files(spark):
    """Two states of a file may have one role: its file counts once."""
    from pyspark.sql import functions as F

    sources = {**FILES, "src/maybe.rs": "#[cfg(custom)]\nfn a() {}\n#[cfg(all(custom, test))]\nfn b() {}\nfn c() {}\n#[cfg(any())]\nfn d() {}\n", "src/empty.rs": ""}
    targets = spark.createDataFrame([("after", p, r, 2, t) for p, r, t in (("src/lib.rs", "production", 2), ("build.rs", "build", 0), ("src/maybe.rs", "example", 1))], "snapshot string, path string, role string, production int, test int")
    profile = snapshot.cfg.Profile(enabled=None)
    for given in (None, targets):
        _, states, _ = snapshot.placed(snapshot.measured(frame(spark, sources), profile), given)
        roles = snapshot.by_role(states)
        sums = [F.sum(m).alias(m) for m in ("files", *snapshot.metrics.METRICS)]
        shown = lambda df, *keys: sorted(map(tuple, df.groupBy(*keys).agg(*sums).collect()))
        assert shown(states, "role") == shown(roles, "role") and shown(states, "path", "role") == shown(roles, "path", "role")
        assert states.count() > roles.count() == states.where("files = 1").count()
        assert "Aggregate" not in states._jdf.queryExecution().optimizedPlan().toString()


def test_roles_as_sql(spark):
    from pyspark.sql import functions as F

    from lumenfold.functions import lattice

    names = ("production", "example", "test", "bench", "build")
    rows = spark.range(2 * 3**5).selectExpr(*[f"CAST(id DIV {3**i} % 3 AS INT) AS {n}" for i, n in enumerate(names)], f"id DIV {3**5} = 1 AS referenced")
    both = rows.select(lattice.classify(*map(F.col, (*names, "referenced"))).alias("a"), F.expr(lattice.classify_sql(*names, "referenced")).alias("b"))
    assert both.where("a <=> b").count() == 2 * 3**5
    # Values in the place of columns give the same roles.
    at = rows.selectExpr(*[f"{n} AS {n}_p" for n in names], *[f"{n} AS {n}_t" for n in names], "referenced").crossJoin(spark.range(9).selectExpr("CAST(id DIV 3 AS INT) AS p", "CAST(id % 3 AS INT) AS t"))
    told = " ".join(f"WHEN p = {i // 3} AND t = {i % 3} THEN {snapshot.role_of(i // 3, i % 3)}" for i in range(9))
    assert at.where(f"({snapshot.role_of('p', 't')}) <=> (CASE {told} END)").count() == 9 * 2 * 3**5


def test_sources_of_one_walk_keep_their_own_bytes(spark):
    rows = [("after", f"{i}.rs", text) for i, text in enumerate((b"// a\nfn f() {}\n", b"// other\nfn f() {}\n", None, b"", b"\xff\n", "// é\nfn f() {}\n".encode(), b"mod m;\n"))]
    got = snapshot.measured(spark.createDataFrame(rows, tree.SCHEMA)).orderBy("path").collect()
    assert [r.bytes for r in got] == [len(text or b"") for _, _, text in rows]
    assert got[0].metrics == got[1].metrics == got[5].metrics and [len(r.edges) for r in got] == [0] * 6 + [1]
    assert [(r.errors, r.first_error) for r in got if r.errors] == [(1, "source is not valid UTF-8")]


def test_documents_of_snapshots_hold_files_as_rows(spark):
    """Rows of all files were fetched, sorted and put together on the driver."""
    import json

    from lumenfold.plans import render

    made = snapshot.report(snapshot.measured(frame(spark, {**FILES, "src/b é.rs": "fn f( {\n", "src-x.rs": "\n" * 1234})))
    parts, text = render.snapshot_document(made), render.snapshot_text(made, files=True)
    assert [isinstance(p, str) for p in parts] == [True, False, True, False, True] and [isinstance(p, str) for p in text] == [True, False]
    whole = render.snapshot_json(made)
    doc = json.loads(whole)
    assert json.dumps(doc, ensure_ascii=False) + "\n" == whole
    assert list(doc)[-2:] == ["diagnostics", "files"] and [f["path"] for f in doc["files"]] == sorted([*FILES, "src/b é.rs", "src-x.rs"], key=lambda p: p.split("/"))
    assert {d["path"] for d in doc["diagnostics"]} == {"src/lib.rs", "src/b é.rs"}
    [a] = [f for f in doc["files"] if f["path"] == "src/lib.rs"]
    assert [(b["role"], b["code"]) for b in a["buckets"]] == [("production", 3), ("test", 2)]
    shown = render.snapshot_table(made, files=True)
    rows = [["file", "production", "test", "other", "public"]]
    for f in doc["files"]:
        code = {b["role"]: b["code"] for b in f["buckets"]}
        rows.append([f["path"], code.get("production", 0), code.get("test", 0), sum(code.values()) - code.get("production", 0) - code.get("test", 0), sum(b["declared_public"] for b in f["buckets"] if b["role"] == "production")])
    rows = [r for r in rows if r[0] == "file" or any(f["path"] == r[0] and f["buckets"] for f in doc["files"])]
    assert shown.split("\n\n")[1] == render._table(rows[0], rows[1:])


def test_documents_of_comparisons_hold_files_as_rows(spark):
    import json

    from lumenfold.plans import render

    both = snapshot.measured(frame(spark, FILES, "before").unionByName(frame(spark, {**FILES, "src/a.rs": "fn a() {}\n", "src/new.rs": "fn n() {}\n"})))
    out = snapshot.compared(snapshot.report(both)["roles"], reported=True, written=True)
    parts = render.comparison_document(out)
    assert [isinstance(p, str) for p in parts] == [True, False, True]
    whole = render.comparison_json(out)
    doc = json.loads(whole)
    assert json.dumps(doc, ensure_ascii=False) + "\n" == whole
    assert [(f["path"], f["status"], f["comments"]["delta"]) for f in doc["files"]] == [("src/a.rs", "modified", -1), ("src/new.rs", "added", 0)]
    assert doc["summary"]["comments"] == {"before": 1, "after": 0, "delta": -1, "percent": -100.0}
    assert "files" not in json.loads(render.comparison_json(out, summary_only=True))
