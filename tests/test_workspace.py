"""Features, correlation, selectors, revisions, reports and streaming."""

import json
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from lumenfold import cli
from lumenfold.functions import lattice
from lumenfold.operators import compare, correlate, features, graph
from lumenfold.sources import revision, selectors
from tests.test_facts import GOOD, RUN, file_of


def test_lattice(spark):
    rows = [(a, b) for a in range(3) for b in range(3)]
    df = spark.createDataFrame(rows, "a int, b int")
    got = df.select("a", "b", lattice.both(F.col("a"), F.col("b")).alias("x"), lattice.either(F.col("a"), F.col("b")).alias("y"), lattice.negate(F.col("a")).alias("n")).collect()
    assert all((r.x, r.y, r.n) == (min(r.a, r.b), max(r.a, r.b), 2 - r.a) for r in got)


def test_percent(spark):
    df = spark.createDataFrame([(0, 0), (0, 4), (4, 0), (3, 4)], "b long, a long")
    assert [r[0] for r in df.select(compare.percent(F.col("b"), F.col("a"))).collect()] == [0.0, None, -100.0, 33.33]


def test_witness_is_the_first_found(spark):
    edges = spark.createDataFrame([("a", "t"), ("b", "t"), ("c", "b"), ("c", "a"), ("d", "c"), ("t", "d")], "src string, dst string")
    levels = graph.reverse_levels(edges, spark.createDataFrame([("t",)], "node string"))
    assert {r.node: (r.next, r.level) for r in levels.collect()} == {"t": (None, 0), "a": ("t", 1), "b": ("t", 1), "c": ("a", 2), "d": ("c", 3)}
    paths = graph.witness_paths(levels, spark.createDataFrame([("d",), ("b",)], "node string"))
    assert {r.node: r.path for r in paths.collect()} == {"d": ["d", "c", "a", "t"], "b": ["b", "t"]}


def test_selectors():
    assert selectors.location("a:b.rs:10:2") == ("a:b.rs", 10, 2) and selectors.item("p:a::b") == ("p", "a::b")
    for bad in ("a.rs:1", "a.rs:0:1", "a.rs:01:1", ":1:1", "a.rs:1:x"):
        with pytest.raises(ValueError):
            selectors.location(bad)
    for bad in ("p", ":x", "p:", " p:x"):
        with pytest.raises(ValueError):
            selectors.item(bad)
    assert features.parse_selector("a/b") == ("a", "b") and features.parse_selector("b") == (None, "b")
    for bad in ("", "a/", "a/b/c", " a"):
        with pytest.raises(features.FeatureError):
            features.parse_selector(bad)


DEP = "package string, alias string, target string, kind string, host_match boolean, target_match boolean, optional boolean, default_features boolean, features array<string>, proc_macro boolean"


def test_features_to_a_fixed_point(spark):
    dep = lambda p, alias, target, kind="normal", opt=False, default=True, feats=(), match=True, macro=False: (p, alias, target, kind, True, match, opt, default, list(feats), macro)
    dependency = spark.createDataFrame(
        [dep("app", "a", "a", feats=["extra"]), dep("app", "o", "o", opt=True, default=False), dep("app", "weak", "w", opt=True), dep("app", "bt", "a", kind="build", feats=["built"]), dep("app", "dv", "v", kind="development"), dep("a", "dv2", "v2", kind="development"), dep("app", "win", "win", match=False), dep("a", "m", "m", macro=True), dep("app", "ext", None)], DEP
    )
    member = spark.createDataFrame([("app", "default", ["plain", "o/x"]), ("app", "plain", ["weak?/z"]), ("app", "o", ["dep:o", "named"]), ("app", "named", []), ("app", "more", ["dep:weak"]), ("a", "default", ["base"]), ("a", "base", []), ("a", "extra", []), ("a", "built", []), ("o", "x", ["y"]), ("o", "y", []), ("w", "default", []), ("w", "z", []), ("m", "default", [])], "package string, feature string, implies array<string>")
    roots = spark.createDataFrame([("app", "target")], "package string, context string")
    state = lambda seeds, **k: {(r.package, r.context, r.feature) for r in features.resolve(member, dependency, roots, spark.createDataFrame([("app", "target", s) for s in seeds], "package string, context string, feature string"), **k).collect()}
    base = {("app", "target", f) for f in ("default", "plain", "o/x", "o", "named")} - {("app", "target", "o/x")}
    a = {("a", "target", f) for f in ("extra", "default", "base")} | {("a", "host", f) for f in ("built", "default", "base")}
    got = state(["default"])
    assert {g for g in got if g[0] in ("app", "a", "o")} == base | a | {("o", "target", "x"), ("o", "target", "y")}
    assert ("m", "host", "default") in got and not any(g[0] in ("w", "win", "v2") for g in got) and ("v", "target", "default") in got
    assert ("w", "target", "z") in state(["default", "more"])
    assert ("o", "target", "y") in state(["default"], excluded=spark.createDataFrame([("o", "x")], "package string, feature string"))


def test_correlation(spark):
    inv = spark.createDataFrame([("i1", "k1", "m", "src/lib.rs", False, ["lib"], "c", "-1"), ("i2", "k2", "m", "src/lib.rs", True, [], "c", "-2"), ("i3", "k3", "m", "src/bad.rs", False, ["bin"], "b", None), ("i4", "k3", "m", "src/none.rs", False, ["bin"], "n", None)], "invocation string, merge_key string, manifest_dir string, input string, test_mode boolean, crate_types array<string>, crate_name string, extra_filename string")
    art = spark.createDataFrame([("a1", "m", "src/lib.rs", False, ["rlib"], ["/t/libc-1.rlib", "/t/libc-1.rmeta"], "p", "c", ["lib"]), ("a2", "m", "src/lib.rs", True, ["lib"], ["/t/c-2"], "p", "c", ["lib"]), ("a3", "m", "src/x.rs", False, ["bin"], ["/t/x"], "p", "x", ["bin"])], "artifact string, manifest_dir string, target_source string, profile_test boolean, crate_types array<string>, filenames array<string>, package_id string, target_name string, target_kinds array<string>")
    fail = spark.createDataFrame([("p", "m", "src/bad.rs", "bad", ["bin"], ["bin"])], "package_id string, manifest_dir string, target_source string, target_name string, target_kinds array<string>, target_crate_types array<string>")
    out = correlate.correlate(inv, art, fail)
    assert {r.invocation: (r.status, r.artifact, r.target_name) for r in out["correlated"].collect()} == {"i1": ("correlated", "a1", "c"), "i2": ("correlated", "a2", "c"), "i3": ("failed", None, "bad"), "i4": ("unmatched", None, None)}
    assert {(r.issue, r.about) for r in out["issues"].collect()} == {("merge key occurs twice", "k3"), ("artifact has no invocation", "a3")}
    script = spark.createDataFrame([("p", "o", ['a = "1"', "b"])], "package_id string, out_dir string, cfg array<string>")
    seen = spark.createDataFrame([("p", "o", ["a=1"])], "package_id string, out_dir string, cfg array<string>")
    assert [(r.package_id, r.cfg) for r in correlate.script_cfg(script, seen).collect()] == [("p", "b")]


def test_reports_of_a_repository(spark, tmp_path, capsys):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    (tmp_path / "src").mkdir()
    (tmp_path / "src/lib.rs").write_text("fn a() {}\n")
    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "one")
    state = revision.fingerprint(str(tmp_path))
    (tmp_path / "src/lib.rs").write_text("mod b;\nfn a() { if x {} }\n")
    (tmp_path / "src/b.rs").write_text("pub fn b() {}\n")
    assert revision.dirty(str(tmp_path)) and revision.fingerprint(str(tmp_path)) != state
    for bad in ("a..b", "-x", "", "a b"):
        with pytest.raises(revision.RevisionError):
            revision.check_ref(bad)
    assert cli.main([str(tmp_path), "--format", "json"]) == 0
    doc = json.loads(capsys.readouterr().out)
    assert doc["report_kind"] == "snapshot" and doc["file_count"] == 2 and doc["total"]["cyclomatic_authored"] == 3
    assert [b["role"] for b in doc["buckets"]] == ["production"] and [f["path"] for f in doc["files"]] == ["src/b.rs", "src/lib.rs"]
    assert cli.main([str(tmp_path), "--baseline", "HEAD", "--format", "json"]) == 0
    doc = json.loads(capsys.readouterr().out)
    assert {f["path"]: f["status"] for f in doc["files"]} == {"src/b.rs": "added", "src/lib.rs": "modified"}
    assert doc["summary"]["cyclomatic_authored"] == {"before": 1, "after": 3, "delta": 2, "percent": 200.0}
    assert cli.main([str(tmp_path), "--files"]) == 0
    shown = capsys.readouterr().out
    assert "Production" in shown and "Total" in shown and "src/lib.rs" in shown
    with pytest.raises(SystemExit):
        cli.arguments(["x", "--cfg", "a", "--not-cfg", "a"])


def test_streamed_facts(spark, tmp_path):
    from lumenfold.streaming.facts import ingest

    (tmp_path / "in").mkdir()
    for name, data in (("a", file_of(GOOD, "x")), ("b", file_of(GOOD, "y")[:-1])):
        (tmp_path / "in" / f"{name}.jsonl").write_text("\n".join(map(json.dumps, data)) + "\n")
    ingest(spark, str(tmp_path / "in"), RUN, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert {r.file for r in spark.read.parquet(str(tmp_path / "out/records")).collect()} == {"a.jsonl"}
    assert {r.file for r in spark.read.parquet(str(tmp_path / "out/errors")).collect()} == {"b.jsonl"}


MANIFEST = """[package]
name = "app"
[[bin]]
name = "tool"
bench = false
"""


def workspace_of(tmp_path):
    """app: a library, a program that needs a feature, tests; util: used by app for one feature."""
    for path, text in {
        "app/Cargo.toml": MANIFEST,
        "app/src/lib.rs": '#[cfg(feature = "fast")]\nfn fast() {}\n#[cfg(feature = "slow")]\nfn slow() {}\n#[cfg(unix)]\nfn unix() {}\n',
        "app/src/main.rs": "fn main() {}\n",
        "app/tests/t.rs": "fn t() {}\n",
        "util/Cargo.toml": "[package]\nname = \"util\"\n",
        "util/src/lib.rs": '#[cfg(feature = "deep")]\npub fn deep() {}\n',
    }.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    at = lambda p: str(tmp_path / p)
    target = lambda name, kind, path, test=False, **more: {"name": name, "kind": [kind], "crate_types": [kind], "src_path": at(path), "test": test, **more}
    dep = {"name": "util", "kind": None, "target": "cfg(unix)", "optional": True, "uses_default_features": False, "features": ["deep"], "path": at("util")}
    app = {"id": "1", "name": "app", "manifest_path": at("app/Cargo.toml"), "edition": "2021", "features": {"default": ["fast"], "fast": [], "slow": ["dep:util"]}, "targets": [target("app", "lib", "app/src/lib.rs", True), target("tool", "bin", "app/src/main.rs", **{"required-features": ["slow"]}), target("t", "test", "app/tests/t.rs", True)], "dependencies": [dep]}
    util = {"id": "2", "name": "util", "manifest_path": at("util/Cargo.toml"), "edition": "2021", "features": {"deep": []}, "targets": [target("util", "lib", "util/src/lib.rs", True)], "dependencies": []}
    (tmp_path / "meta.json").write_text(json.dumps({"packages": [app, util], "workspace_members": ["1", "2"]}))
    return str(tmp_path / "meta.json")


def code_by_role(doc):
    return {(f["path"], b["role"]): b["code"] for f in doc["files"] for b in f["buckets"]}


def test_fast_mode_with_packages(spark, tmp_path, capsys):
    meta = workspace_of(tmp_path)

    def run(*more):
        code = cli.main([str(tmp_path), "--metadata", meta, "--cfg", "unix", "--format", "json", *more])
        return code, json.loads(capsys.readouterr().out)

    code, doc = run()
    assert code == 0 and doc["features"] == "default" and doc["selection"]["paths"] == [{"path": ".", "kind": "directory"}]
    got = code_by_role(doc)
    # By default: fast, not slow; the program lacks its feature, so nothing of it is built.
    assert got == {("app/src/lib.rs", "production"): 4, ("app/src/lib.rs", "inactive"): 2, ("app/src/main.rs", "inactive"): 1, ("app/tests/t.rs", "test"): 1, ("util/src/lib.rs", "inactive"): 2}
    got = code_by_role(run("--features", "slow")[1])
    assert got["app/src/main.rs", "production"] == 1 and got["util/src/lib.rs", "production"] == 2 and ("app/src/lib.rs", "inactive") not in got
    got = code_by_role(run("--no-default-features", "--features", "app/slow")[1])
    assert got["app/src/lib.rs", "inactive"] == 2 and got["app/src/main.rs", "production"] == 1
    code, doc = run("--all-features", "--exclude-features", "app/fast")
    assert doc["features"] == "all-excluded" and code_by_role(doc)["app/src/lib.rs", "inactive"] == 2
    with pytest.raises(ValueError, match="nothing"):
        run("--features", "nothing")
    # One package alone: the other has no selected target.
    assert cli.main([str(tmp_path / "util"), "--metadata", meta, "--format", "json"]) == 0
    assert code_by_role(json.loads(capsys.readouterr().out)) == {("src/lib.rs", "inactive"): 2}


def test_files_reached_by_edges_are_read_and_not_reported(spark, tmp_path, capsys):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "a/lib.rs").write_text('#[path = "../b/x.rs"]\nmod x;\n#[path = "../b/gone.rs"]\nmod y;\n')
    (tmp_path / "b/x.rs").write_text("mod missing;\n")
    assert cli.main([str(tmp_path / "a"), "--format", "json"]) == 1
    shown = capsys.readouterr()
    assert [f["path"] for f in json.loads(shown.out)["files"]] == ["lib.rs"]
    assert shown.err.count("warning") == 1 and "lib.rs" in shown.err


def test_sources_and_ignore_lines(tmp_path, monkeypatch):
    from lumenfold.sources import tree

    monkeypatch.setenv("HOME", str(tmp_path / "home"))
    monkeypatch.delenv("XDG_CONFIG_HOME", raising=False)
    (tmp_path / "home").mkdir()
    (tmp_path / "home/.gitconfig").write_text("[user]\n  name = x\n[core]\n  excludesFile = ~/mine\n")
    (tmp_path / "home/mine").write_text("*_gen.rs\n[b-a]\n")
    src = tmp_path / "src"
    src.mkdir()
    for name in ("a.rs", "b_gen.rs", "c_gen.rs"):
        (src / name).write_text("")
    (src / ".gitignore").write_text("!c_gen.rs\n")
    found = lambda **k: [os.path.basename(p) for p in tree.discover([str(src)], **k)]
    assert found() == ["a.rs", "c_gen.rs"] and found(no_ignore=True) == ["a.rs", "b_gen.rs", "c_gen.rs"]
    kinds = {"": "directory", "src": "directory", "src/a.rs": "directory"}
    assert tree.baseline_paths([str(src), str(tmp_path)], str(tmp_path), kinds) == ["", "src"]
    for bad, why in ((str(src / "a.rs"), "is a directory"), (str(src / "c_gen.rs"), "does not exist"), ("/", "outside")):
        with pytest.raises(ValueError, match=why):
            tree.baseline_paths([bad], str(tmp_path), kinds)


def test_environment_and_closed_pipe(monkeypatch):
    from lumenfold.sources import invocation

    assert invocation.environment_issues({"RUSTC": "", "RUSTC_WORKSPACE_WRAPPER": "", "CARGO_BUILD_RUSTC_WORKSPACE_WRAPPER": "x"}, {"build.rustc": "y", "build.rustc-workspace-wrapper": None}) == ["RUSTC names another compiler", "CARGO_BUILD_RUSTC_WORKSPACE_WRAPPER wraps the compiler", "build.rustc is set"]
    assert invocation.flags_are_safe({"PATH": "x"}) and not invocation.flags_are_safe({"CARGO_TARGET_X_RUSTFLAGS": ""})

    def closed(argv):
        raise BrokenPipeError

    monkeypatch.setattr(cli, "_main", closed)
    monkeypatch.setattr(os, "dup2", lambda *a: None)
    assert cli.main([]) == 0


def test_a_key_that_occurs_twice_is_an_error(spark):
    from lumenfold.operators import compare

    rows = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2)], "path string, n int")
    with pytest.raises(ValueError, match="b occurs 2 times"):
        compare.unique(rows, ["path"])
    assert compare.unique(rows.where("n = 1"), ["path"]).count() == 2


def test_long_chains_settle(spark):
    """No limit on rounds: a chain is followed to its end."""
    from lumenfold.operators import graph

    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "src long, dst long")
    assert graph.reachable(edges, spark.createDataFrame([(0,)], "node long")).count() == 41
    levels = graph.reverse_levels(edges.unionByName(spark.createDataFrame([(0, 39), (1, 39)], "src long, dst long")), spark.createDataFrame([(40,)], "node long")).collect()
    assert {r.node: (r.level, r.next) for r in levels if r.node < 2} == {0: (2, 39), 1: (2, 39)}
