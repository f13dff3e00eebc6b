"""What a compiler's arguments say of an invocation, and what of the environment forbids an
audit.  Running the compiler is not done here."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Settings of code generation that make two invocations differ.
CODEGEN = ("debug-assertions", "codegen-units", "opt-level", "overflow-checks", "panic", "target-cpu", "target-feature")
#: Variables that name another compiler, that wrap it, and that add flags to it.
COMPILER_VARIABLES = ("RUSTC", "CARGO_BUILD_RUSTC")
WRAPPER_VARIABLES = ("RUSTC_WORKSPACE_WRAPPER", "CARGO_BUILD_RUSTC_WORKSPACE_WRAPPER")
FLAG_VARIABLES = ("RUSTFLAGS", "CARGO_ENCODED_RUSTFLAGS", "CARGO_BUILD_RUSTFLAGS")
_VERSION = "invocation-v3"


def options(args: list[str], name: str) -> list[str]:
    """All values of an option, as ``name value`` or ``name=value``."""
    out = []
    for i, a in enumerate(args):
        if a == name and i + 1 < len(args):
            out.append(args[i + 1])
        elif a.startswith(name + "="):
            out.append(a[len(name) + 1 :])
    return out


def codegen(args: list[str], name: str) -> list[str]:
    """All values of a setting of ``-C`` or ``--codegen``; the last one holds."""
    given = [x[2:] for x in args if x.startswith("-C") and len(x) > 2] + [args[i + 1] for i, x in enumerate(args[:-1]) if x == "-C"] + options(args, "--codegen")
    # In the order of the arguments, whichever way each is written.
    ordered = sorted(given, key=lambda g: max(i for i, a in enumerate(args) if a.endswith(g)))
    return [g.partition("=")[2] for g in ordered if g.partition("=")[0] == name]


def identity(args: list[str], env: dict[str, str], host: str) -> dict:
    """The fields that tell invocations apart; ``collected`` only with a crate's name, an
    input and an output folder."""
    last = lambda values: values[-1] if values else None
    lists = lambda name: sorted({v for x in options(args, name) for v in x.split(",")})
    named = last(options(args, "--crate-name"))
    source = next((a for a in args if not a.startswith("-") and a.endswith(".rs") and a != ".rs"), None)
    target = last(options(args, "--target"))
    cfg = sorted(set(options(args, "--cfg")))
    out = {
        "manifest_dir": env.get("CARGO_MANIFEST_DIR"),
        "package_name": env.get("CARGO_PKG_NAME"),
        "crate_name": named or env.get("CARGO_CRATE_NAME") or "unknown",
        "crate_types": lists("--crate-type") or ["bin"],
        "input": source,
        "target": target or host,
        "context": "target" if target else "host",
        "test_mode": "--test" in args or "test" in cfg,
        "cfg": cfg,
        "codegen": [f"{n}={v}" for n in CODEGEN for v in codegen(args, n)],
        "extra_filename": last(codegen(args, "extra-filename")) or None,
        "metadata": last(codegen(args, "metadata")) or None,
        "emit": lists("--emit"),
        "out_dir": last(options(args, "--out-dir")),
    }
    out["collected"] = named is not None and source is not None and out["out_dir"] is not None
    parts = [_VERSION, out["manifest_dir"] or "", out["package_name"] or "", out["crate_name"], ",".join(out["crate_types"]), out["input"] or "", out["target"], out["context"], str(out["test_mode"]).lower(), "\x1f".join(cfg), "\x1f".join(out["codegen"]), out["extra_filename"] or "", out["metadata"] or "", ",".join(out["emit"])]
    out["merge_key"] = "".join(f"{len(p.encode())}:{p}" for p in parts)
    return out


_IDENTITY = pa.schema([("crate_name", pa.string()), ("crate_types", pa.list_(pa.string())), ("input", pa.string()), ("target", pa.string()), ("context", pa.string()), ("test_mode", pa.bool_()), ("cfg", pa.list_(pa.string())), ("extra_filename", pa.string()), ("collected", pa.bool_()), ("merge_key", pa.string())])
_DDL = "crate_name string, crate_types array<string>, input string, target string, context string, test_mode boolean, cfg array<string>, extra_filename string, collected boolean, merge_key string"


def identities(rows: DataFrame, host: str) -> DataFrame:
    """``rows``: invocation, arguments (a JSON list), environment (a JSON object) -> each with
    its identity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [identity(json.loads(a), json.loads(e), host) for a, e in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            columns = [pa.array([f[n] for f in found], t) for n, t in zip(_IDENTITY.names, _IDENTITY.types)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["invocation", *_IDENTITY.names])

    return rows.select("invocation", "arguments", "environment").mapInArrow(run, f"invocation string, {_DDL}")


def environment_issues(env: dict[str, str], config: dict[str, str | None]) -> list[str]:
    """Why an audit can't run under an environment and a build tool's settings."""
    out = [f"{v} names another compiler" for v in COMPILER_VARIABLES if v in env]
    out += [f"{v} wraps the compiler" for v in WRAPPER_VARIABLES if env.get(v)]
    return out + [f"{k} is set" for k in ("build.rustc", "build.rustc-workspace-wrapper") if config.get(k) is not None]


def flags_are_safe(env: dict[str, str]) -> bool:
    """Whether nothing adds compiler flags, so that requested cfg can be passed by them."""
    return not any(k in FLAG_VARIABLES or (k.startswith("CARGO_TARGET_") and k.endswith("_RUSTFLAGS")) for k in env)
