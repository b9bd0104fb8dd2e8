"""Layouts and algorithms by name, and which of them go together.

The choice has no influence on the tree. Simple algorithms (A, B) and the
linear array show no suffix links; the linear array shows no branching ids.
"""

from __future__ import annotations

from dataclasses import dataclass

#: Valid algorithms of each layout; +B is the variation with parent pointers.
VALID = {
    "SL": {"A", "M", "B", "U"}, "SH": {"A", "M", "B", "U"}, "LA": {"P"}, "SL+B": {"M", "U"}, "SH+B": {"M", "U"},
}
VALID_WINDOW = {"SL": {"U"}, "SH": {"U"}, "SL+B": {"U"}, "SH+B": {"U"}}
NAMES = {"A": "simple McCreight", "M": "McCreight", "B": "simple Ukkonen", "U": "Ukkonen", "P": "partition and write only top down"}


@dataclass(frozen=True)
class Options:
    layout: str
    algorithm: str
    backward: bool = False
    benchmark: str = "T"
    prefix_length: int | None = None
    collision: str | None = None
    hash_functions: int | None = None
    simple: bool = False
    dump: str | None = None
    window: bool = False

    def checked(self) -> "Options":
        """The same options, or the reason why they do not go together."""
        valid = VALID_WINDOW if self.window else VALID
        key = self.layout + ("+B" if self.backward else "")
        if self.algorithm not in valid.get(key, ()):
            raise ValueError(f"algorithm {self.algorithm!r} does not go with layout {key!r}")
        if self.benchmark not in ("C", "T"):
            raise ValueError("the benchmark is C (create) or T (create and traverse)")
        if self.benchmark == "C" and (self.simple or self.dump):
            raise ValueError("a simple traversal or a dump needs benchmark T")
        if (self.collision or self.hash_functions) and self.layout != "SH":
            raise ValueError("collision options need layout SH")
        if self.collision not in (None, "C", "D"):
            raise ValueError("collisions are resolved by C (cuckoo) or D (double hashing)")
        if self.hash_functions and self.collision != "C":
            raise ValueError("a number of hash functions needs cuckoo hashing")
        if self.prefix_length is not None and self.layout != "LA":
            raise ValueError("a prefix length needs layout LA")
        return self

    @property
    def shows_links(self) -> bool:
        return self.algorithm in ("M", "U") and not self.simple

    @property
    def detailed(self) -> bool:
        return not self.simple and self.layout != "LA"

    @property
    def record(self) -> str:
        return self.layout + ("_BP" if self.backward else "")


def combinations() -> list[Options]:
    """Every valid pair of layout and algorithm."""
    return [Options(k.removesuffix("+B"), a, k.endswith("+B")) for k, algorithms in VALID.items() for a in sorted(algorithms)]
