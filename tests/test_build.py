"""What a build says, and the audit's gates."""

import json

import pytest

from lumenfold.plans import audit
from lumenfold.sources import build, facts
from tests.test_facts import LIB, RUN, TARGETS, decode, file_of, root


def target(name="c", kind="lib", src="/w/src/lib.rs"):
    return {"name": name, "kind": [kind], "crate_types": [kind], "src_path": src, "test": True}


def test_messages(spark):
    lines = [
        {"reason": "compiler-artifact", "package_id": "p", "manifest_path": "/w/Cargo.toml", "target": target(), "profile": {"opt_level": "0", "debug_assertions": True, "overflow_checks": True, "test": False}, "features": ["b", "a"], "filenames": ["/t/libc-1.rlib"], "fresh": False, "new": 1},
        {"reason": "compiler-message", "package_id": "p", "manifest_path": "/w/Cargo.toml", "target": target("bad"), "message": {"level": "error", "message": "no", "rendered": "no"}},
        {"reason": "compiler-message", "package_id": "p", "manifest_path": "/w/Cargo.toml", "target": target("bad"), "message": {"level": "warning", "message": "hm", "rendered": "hm"}},
        {"reason": "build-script-executed", "package_id": "p", "out_dir": "/o", "cfgs": ["b", "a"]},
        {"reason": "build-finished", "success": False},
    ]
    rows = [(i, json.dumps(x)) for i, x in enumerate(lines)] + [(9, "plain words")]
    out = build.messages(spark.createDataFrame(rows, "number int, line string"))
    [a] = out["artifact"].collect()
    assert (a.manifest_dir, a.target_source, a.features, a.profile_test) == ("/w", "/w/src/lib.rs", ["a", "b"], False)
    assert [r.target_name for r in out["failure"].collect()] == ["bad"] and [r.cfg for r in out["script"].collect()] == [["a", "b"]]
    assert [r.success for r in out["finished"].collect()] == [False] and [r.line for r in out["text"].collect()] == ["plain words"]


def test_units_and_metadata(spark):
    unit = {"pkg_id": "p", "target": target(), "platform": None, "mode": "build", "features": []}
    graph = {"version": 1, "units": [unit, unit, {**unit, "mode": "run-custom-build"}]}
    assert build.expected_units(spark, json.dumps(graph)).count() == 2
    with pytest.raises(build.BuildError):
        build.expected_units(spark, json.dumps({**graph, "version": 2}))
    dep = {"name": "m", "rename": "alias", "kind": "dev", "target": None, "optional": True, "uses_default_features": False, "features": ["f"], "path": "/w/m"}
    doc = {"packages": [{"id": "1", "name": "app", "manifest_path": "/w/Cargo.toml", "edition": "2021", "features": {"default": ["x"]}, "targets": [target()], "dependencies": [dep, {**dep, "path": None, "rename": None, "kind": None}]}, {"id": "2", "name": "m", "manifest_path": "/w/m/Cargo.toml", "edition": "2021", "features": {}, "targets": [target("m", "proc-macro")], "dependencies": []}], "workspace_members": ["1", "2"]}
    t = build.metadata(spark, json.dumps(doc))
    assert {(r.alias, r.target, r.kind, r.proc_macro) for r in t["dependency"].collect()} == {("alias", "m", "development", True), ("m", None, "normal", False)}
    assert [(r.package, r.feature, r.implies) for r in t["member"].collect()] == [("app", "default", ["x"])] and t["target"].count() == 2


def test_predicates_and_ledger(spark):
    assert build.compiler_cfg('unix\ntarget_os = "linux"\n', ["mine"], ["unix"]) == (frozenset({"target_os=linux", "mine"}), frozenset({"unix"}), frozenset({"unix", "target_os"}))
    with pytest.raises(build.BuildError):
        build.compiler_cfg("", ["a"], ["a"])
    row = {"release": "1.9.0", "commit_hash": "c", "commit_date": "d", "host": "h"}
    assert [r.release for r in build.supported(spark, [row, {**row, "release": "1.10.0-nightly"}]).collect()] == ["1.10.0-nightly", "1.9.0"]
    with pytest.raises(build.BuildError):
        build.supported(spark, [row, row])


def test_products_only_from_complete_runs(spark):
    inv = spark.createDataFrame([("lib", "k", "m", "src/lib.rs", False, ["lib"], "c", "-1")], "invocation string, merge_key string, manifest_dir string, input string, test_mode boolean, crate_types array<string>, crate_name string, extra_filename string")
    art = spark.createDataFrame([("a1", "m", "src/lib.rs", False, ["lib"], ["/t/libc-1.rlib"], "p", "c", ["lib"])], "artifact string, manifest_dir string, target_source string, profile_test boolean, crate_types array<string>, filenames array<string>, package_id string, target_name string, target_kinds array<string>")
    fail = spark.createDataFrame([], "package_id string, manifest_dir string, target_source string, target_name string, target_kinds array<string>, target_crate_types array<string>")
    records, _ = decode(spark, file_of([*LIB, root(1, 2)], "lib"))
    t = facts.tables(records, facts.validate(records, RUN))
    targets = spark.createDataFrame([("lib", "c", "c", "c", ["lib"], "production", "target")], TARGETS)
    whole = audit.run(t, targets, inv, art, fail)
    assert whole["status"] == "complete" and {r.definition_path for r in whole["closed_world"]["findings"].where("finding = 'dead'").collect()} == {"c::inner", "c::dead", "c::tested", "c::Sig", "c::allowed"}
    lost = audit.run(t, targets, inv, art.where("false"), fail)
    assert lost["status"] == "unavailable" and lost["closed_world"] is None and audit.compared(whole, lost, True) is None
