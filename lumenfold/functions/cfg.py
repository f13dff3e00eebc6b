"""Configuration predicates in three values, once for production and once for tests.

A reachability is a pair (production, test) of 0 never, 1 maybe, 2 always."""

from __future__ import annotations

from dataclasses import dataclass, field

BOTH, TEST, NOWHERE = (2, 2), (0, 2), (0, 0)

#: Names that the compiler always knows, and attributes that make a test.
BUILTIN_NAMES = frozenset(
    "target_arch target_endian target_env target_family target_feature target_has_atomic target_has_atomic_equal_alignment target_has_atomic_load_store "
    "target_has_atomic_primitive_alignment target_os target_pointer_width target_vendor panic debug_assertions unix windows".split()
)
TEST_ATTRIBUTES = frozenset("test bench tokio::test async_std::test actix_rt::test rstest test_case wasm_bindgen_test".split())


def both(a: tuple, b: tuple) -> tuple:
    return a if a == b else (min(a[0], b[0]), min(a[1], b[1]))


def either(a: tuple, b: tuple) -> tuple:
    return a if a == b else (max(a[0], b[0]), max(a[1], b[1]))


def code(r: tuple) -> int:
    return r[0] * 3 + r[1]


@dataclass(frozen=True)
class Profile:
    """``enabled`` is None outside of any package: its features are a maybe."""

    known_true: frozenset = frozenset()
    known_false: frozenset = frozenset()
    closed_names: frozenset = frozenset()
    enabled: frozenset | None = frozenset()
    excluded: frozenset = frozenset()
    test_attributes: frozenset = field(default_factory=frozenset)

    def atom(self, name: str, value: str | None, test: bool) -> int:
        shown = name if value is None else f"{name}={value}"
        if name in ("test", "doctest"):
            return 2 if test else 0
        if name in ("true", "false"):
            return 2 if name == "true" else 0
        if name == "feature":
            if value is None or (self.enabled is None and value not in self.excluded):
                return 1
            return 2 if value not in self.excluded and value in self.enabled else 0
        if shown in self.known_true:
            return 2
        if shown in self.known_false or name in BUILTIN_NAMES or name in self.closed_names:
            return 0
        return 1

    def evaluate(self, expr, test: bool) -> int:
        kind, *args = expr
        if kind == "all":
            return min((self.evaluate(a, test) for a in args), default=2)
        if kind == "any":
            return max((self.evaluate(a, test) for a in args), default=0)
        if kind == "not":
            return 2 - self.evaluate(args[0], test)
        return self.atom(*args, test) if kind == "atom" else 1

    def reach(self, expr) -> tuple:
        return self.evaluate(expr, False), self.evaluate(expr, True)

    def gate(self, words: list[str]) -> tuple:
        """The gate of one attribute, given as its tokens between the brackets."""
        if not words:
            return BOTH
        if words[0] == "unsafe" and words[1:2] == ["("]:
            return self.gate(words[2:-1])
        end = next((i for i, w in enumerate(words) if w in ("(", "[", "{", "=")), len(words))
        path = "".join(words[:end])
        if path == "cfg" and words[end : end + 1] == ["("]:
            return self.reach(parse(words[end + 1 : -1]))
        if path == "cfg_attr" and words[end : end + 1] == ["("]:
            first, *rest = split(words[end + 1 : -1])
            condition, out = self.reach(parse(first)), BOTH
            for nested in rest:
                g = self.gate(nested)
                out = both(out, either((2 - condition[0], 2 - condition[1]), g))
            return out
        return TEST if path in TEST_ATTRIBUTES or path in self.test_attributes else BOTH


def split(words: list[str]) -> list[list[str]]:
    """At commas outside of brackets; an empty last part doesn't count."""
    out, depth = [[]], 0
    for w in words:
        depth += (w in ("(", "[", "{")) - (w in (")", "]", "}"))
        if w == "," and not depth:
            out.append([])
        else:
            out[-1].append(w)
    return out if out[-1] or len(out) == 1 else out[:-1]


def parse(words: list[str]):
    """A predicate's tokens as ('all', ...), ('any', ...), ('not', x), ('atom', name, value) or ('invalid',)."""
    if len(words) == 1 and words[0].isidentifier():
        return "atom", words[0], None
    if len(words) == 3 and words[1] == "=" and words[2][:1] in ('"', "r"):
        return "atom", words[0], words[2].lstrip("r").strip("#")[1:-1]
    if len(words) >= 3 and words[1] == "(" and words[-1] == ")":
        parts = [parse(p) for p in split(words[2:-1]) if p]
        if words[0] in ("all", "any"):
            return words[0], *parts
        if words[0] == "not" and len(parts) == 1:
            return "not", parts[0]
    return ("invalid",)
