"""Decoding and validation of facts, the closed-world graph, impact and API surfaces."""

import json

import pytest

from lumenfold.operators import closed_world, facts as ops, surface
from lumenfold.sources import facts

RUN = "run-1"
BIG = 2**64 - 1


def did(n, crate=1):
    return {"stable_crate_id": crate, "local_hash": n}


def span(start, end=None, file="s", line=None):
    return {"file": file, "start": start, "end": end or start + 1, "line": line or start + 1, "column": 1}


def definition(n, path, kind="function", parent=None, crate=1, at=None, **more):
    return "definition", {"id": f"d{crate}-{n}", "compiler_id": did(n, crate), "parent": parent and did(parent, crate), "name": path.split("::")[-1], "definition_path": path, "kind": kind, "visibility_editable": kind != "crate", "nominal_visibility": "public", "externally_reachable": True, "span": None if kind == "crate" else span(at if at is not None else n), "attribution_callsite": None, "expansion_origin": "authored", **more}


def reference(i, a, b, kind="body", crate=1, to_crate=1):
    return "reference", {"id": f"r{i}", "from": did(a, crate), "to": did(b, to_crate), "kind": kind, "span": span(1)}


def root(i, n, kind="entry_point", reason="main", crate=1):
    return "root", {"id": f"root{i}", "definition": did(n, crate), "kind": kind, "reason": reason}


def file_of(events, name="inv", test_mode=False):
    started = {"merge_key": "k", "compiler": {"release": "1", "commit_hash": "c", "commit_date": "d", "host": "h"}, "process_id": 1, "rustc_path": "r", "working_directory": "w", "manifest_dir": "m", "package_name": "p", "primary_package": True, "test_mode": test_mode, "target_triple": "t", "compilation_context": "target", "crate_name": "c", "input": "i", "artifact": {"out_dir": None, "crate_name": "c", "crate_types": ["lib"], "extra_filename": None, "metadata": None, "emit": []}}
    profile = {"host_triple": "t", "target_triple": "t", "test_mode": test_mode, "cfg": [{"name": "a", "value": None}, {"name": "b", "value": "1"}], "features": ["x", "y"], "codegen": {"optimization": "0", "panic": "unwind", "debug_assertions": True, "overflow_checks": True, "codegen_units": "1", "target_cpu": "g", "target_features": []}}
    source = {"key": "s", "local_path": "src/lib.rs", "remapped_path": "src/lib.rs", "source_hash_algorithm": "md5", "source_hash": "0" * 32, "byte_len": 1000, "generated": False}
    body = [("invocation_started", started), ("profile", profile), ("source_file", source), *events, ("product_status", {"product": "definitions", "availability": "complete", "message": None}), ("invocation_finished", {"rustc_success": True, "analysis_reached": True})]
    return [{"protocol_version": 5, "run_id": RUN, "invocation_id": name, "sequence": i, "event": e, "payload": p} for i, (e, p) in enumerate(body)]


def decode(spark, *files):
    rows = []
    for i, f in enumerate(files):
        data = f if isinstance(f, bytes) else ("\n".join(map(json.dumps, f)) + "\n").encode()
        rows.append((f"{i}.jsonl", len(data), data))
    return facts.decode(spark.createDataFrame(rows, "file string, length long, content binary"))


GOOD = [definition(1, "c", "crate"), definition(2, "c::a", parent=1), ("public_binding", {"id": "b1", "parent": did(1), "target": did(BIG, BIG), "name": "n", "namespace": "type", "exposure": "direct", "exposing_import": None, "span": None, "resolved_target_path": "other::n"})]


def test_valid_file_and_wide_ids(spark):
    records, errors = decode(spark, file_of(GOOD))
    assert errors.count() == 0 and facts.validate(records, RUN).count() == 0
    t = facts.tables(records, facts.validate(records, RUN))
    assert [r.target for r in t["public_binding"].collect()] == ["f" * 32]
    assert sorted(r.compiler_id for r in t["definition"].collect()) == [f"{1:016x}{n:016x}" for n in (1, 2)]


def test_bad_files_become_errors(spark):
    ok = "\n".join(map(json.dumps, file_of(GOOD)))
    _, errors = decode(spark, b"", ok.encode(), b"\xff\n", (ok + "\n{broken\n").encode(), (ok + "\n").encode())
    assert {r.file: r.message for r in errors.collect()} == {"0.jsonl": "file is empty", "1.jsonl": "last record is not ended", "2.jsonl": "file is not UTF-8", "3.jsonl": "record 8 is malformed or exceeds its limit"}


def broken(change):
    f = json.loads(json.dumps(file_of(GOOD)))  # a copy: the cases share their events
    change(f)
    return f


@pytest.mark.parametrize(
    "change,message",
    [
        (lambda f: f[3].update(sequence=7), "sequence has a gap or a repeat"),
        (lambda f: f[3].update(run_id="x"), "record of another run"),
        (lambda f: f[3].update(protocol_version=4), "protocol version differs"),
        (lambda f: f[3].update(invocation_id="x"), "records of several invocations"),
        (lambda f: f[3]["payload"].update(kind="module"), "there is not one crate definition"),
        (lambda f: f[-1]["payload"].update(analysis_reached=False), "complete without analysis"),
        (lambda f: f[1]["payload"].update(features=["y", "x"]), "profile is not in canonical order"),
        (lambda f: f[1]["payload"].update(test_mode=True), "profile disagrees with the start"),
        (lambda f: f[4]["payload"].update(compiler_id=did(1)), "definition id occurs twice"),
        (lambda f: f[4]["payload"].update(id="b1"), "fact id occurs twice"),
        (lambda f: f[4]["payload"].update(parent=did(9)), "definition's parent is unknown"),
        (lambda f: f[4]["payload"].update(span=span(2, file="gone")), "span has no source or leaves it"),
        (lambda f: f[4]["payload"].update(span=span(2, 2000)), "span has no source or leaves it"),
        (lambda f: f[2]["payload"].update(source_hash="zz"), "source hash is malformed"),
        (lambda f: f[5]["payload"].update(parent=did(2)), "binding's parent holds no names"),
        (lambda f: f[5]["payload"].update(target=did(2)), "binding's path is not its target's"),
    ],
)
def test_each_rule(spark, change, message):
    records, _ = decode(spark, broken(change))
    assert message in {r.message for r in facts.validate(records, RUN).collect()}


TARGETS = "invocation string, package string, package_path string, target string, kinds array<string>, role string, context string"


def world(spark, files, targets):
    records, errors = decode(spark, *files)
    bad = facts.validate(records, RUN)
    assert errors.count() == 0 and bad.count() == 0, bad.collect()
    t = facts.tables(records, bad)
    return t, spark.createDataFrame(targets, TARGETS)


LIB = [definition(1, "c", "crate"), definition(2, "c::used", parent=1), definition(3, "c::inner", parent=1), definition(4, "c::dead", parent=1), definition(5, "c::tested", parent=1), definition(6, "c::Sig", "struct", parent=1), definition(7, "c::allowed", parent=1)]


def test_findings_keep_test_and_production_apart(spark):
    lib = [*LIB, reference(1, 2, 3), reference(2, 2, 6, "interface"), root(2, 7, "conservative", closed_world.ALLOWED_DEAD)]
    tests = [*LIB, reference(1, 2, 3), reference(2, 2, 6, "interface"), root(1, 5, reason="test")]
    app = [definition(1, "app", "crate", crate=2), definition(2, "app::main", parent=1, crate=2, at=100), reference(1, 2, 2, crate=2, to_crate=1), root(1, 2, crate=2)]
    t, targets = world(spark, [file_of(lib, "lib"), file_of(tests, "libtest", True), file_of(app, "app")], [("lib", "c", "c", "c", ["lib"], "production", "target"), ("libtest", "c", "c", "c", ["lib"], "unit_test", "target"), ("app", "app", "app", "app", ["bin"], "production", "target")])
    a = closed_world.analyze(t, targets)
    assert a["errors"].count() == 0
    found = {r.definition_path: (r.finding, r.live_production, r.live_nonproduction) for r in a["findings"].collect()}
    assert found == {"c::inner": ("unnecessary_public", True, False), "c::dead": ("dead", False, False), "c::tested": ("unnecessary_public", False, True)}
    need = {r.definition_path: r.reasons for r in closed_world.required_visibility(a).collect()}
    assert set(need) == {"c::used", "c::Sig"} and closed_world.CROSS_CRATE in need["c::used"] and need["c::Sig"] == [closed_world.SPREAD]
    [s] = closed_world.summary(a).collect()
    assert (s.dead_public, s.unnecessary_public, s.public_candidates) == (1, 2, 6)
    assert (s.production_roots, s.nonproduction_roots) == (4, 1) and (s.definition_nodes, s.reference_edges) == (10, 6)
    got = closed_world.impact(a, closed_world.select(a, "c", "c::inner"))
    assert {r.definition_path for r in got["direct"].collect()} == {"c::used"}
    assert {(r.definition_path, r.level) for r in got["consumers"].collect()} == {("c::used", 1), ("app::main", 2)}
    assert {r["class"]: r.steps for r in got["witnesses"].collect()} == {"production": 1, "test": 1}
    assert {r["class"]: r.texts for r in got["witnesses"].collect()} == {"production": ["c c::used", "c c::inner"], "test": ["c c::used", "c c::inner"]}
    assert got["consumer_count"].first().consumers == 2
    nothing = closed_world.select(a, "c", "c::nothing")
    assert closed_world.choices(a, nothing, "other::used").first().definition_path == "c::used" and closed_world.choices(a, nothing, "c::nothing").count() == 0
    assert got["disposition"].first().disposition == "unnecessary_public"
    assert closed_world.impact(a, closed_world.select(a, "c", "c::nothing")) is None
    lonely = closed_world.impact(a, closed_world.select(a, "c", "c::dead"))
    assert lonely["direct"].count() == 0 and lonely["witnesses"] is None and lonely["disposition"].first().disposition == "dead"


def test_surface_diff(spark):
    def binding(i, name, target, path, exposure="direct"):
        return "public_binding", {"id": f"b{i}", "parent": did(1), "target": did(target), "name": name, "namespace": "value", "exposure": exposure, "exposing_import": None, "span": None, "resolved_target_path": path}

    before = [*LIB, binding(1, "used", 2, "c::used"), binding(2, "x", 3, "c::inner"), binding(3, "gone", 4, "c::dead")]
    after = [*LIB, binding(1, "used", 2, "c::used", "reexport"), binding(2, "x", 5, "c::tested"), binding(4, "new", 6, "c::Sig")]
    out = []
    for f, package in ((before, "c"), (after, "renamed")):
        t, targets = world(spark, [file_of(f, "lib")], [("lib", package, "path/c", "c", ["lib"], "production", "target")])
        out.append(surface.surface(t, targets))
        assert out[-1]["errors"].count() == 0
    rows = surface.diff(*out).collect()
    assert [(r.change, r.path, r.name, r.after_target) for r in rows] == [("definition_added", "c::Sig", "struct", None), ("definition_added", "c::tested", "function", None), ("definition_removed", "c::dead", "function", None), ("definition_removed", "c::inner", "function", None), ("binding_added", "c", "new", "c::Sig"), ("binding_removed", "c", "gone", None), ("binding_retargeted", "c", "x", "c::tested")]
    [s] = surface.diff_summary(surface.diff(*out)).collect()
    assert s.binding_retargeted == 1 and s.definition_added == 2


def test_ledger_counts_repeats_and_null_keys(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "unit string, platform string")
    got = ops.ledger(rows(("a", None), ("a", None), ("b", "t")), rows(("a", None), ("b", "t"), ("c", None)), ["unit", "platform"]).collect()
    assert sorted((r.unit, r.platform, r.expected, r.observed) for r in got) == [("a", None, 2, 1), ("c", None, 0, 1)]
