"""The flow kernel: one pass over the events of a scope, branches and loops included, as a grouped pandas function.

Events (file, scope, pos, op, var, types): ``assign`` and ``read`` of a variable, ``branch`` / ``else`` / ``endif`` around two
arms, ``loop`` / ``endloop`` around a body that may run any number of times, ``leave`` (return, throw, break, continue). Scopes
are independent; a scope's events fit one worker, as a function's text does.

Results (file, scope, pos, kind, var, types): UndefinedVariable, PossiblyUndefinedVariable, UnreachableCode (first statement
after a leave), UnusedVariable (the last write that nothing reads) and ``env`` rows with a variable's types at a read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

RESULT = "file string, scope string, pos long, kind string, var string, types array<string>"


@dataclass
class State:
    """What is known before an event: types of each variable, which may be unset, the writes nobody has read yet."""

    types: dict[str, frozenset[str]] = field(default_factory=dict)
    maybe: set[str] = field(default_factory=set)
    writes: dict[str, frozenset[int]] = field(default_factory=dict)
    gone: bool = False

    def copy(self) -> State:
        return State(dict(self.types), set(self.maybe), dict(self.writes), self.gone)


def merge(a: State, b: State) -> State:
    """After two arms: an arm that left does not count; a variable of one arm only may be unset."""
    if a.gone or b.gone:
        out = (b if a.gone else a).copy()
        out.gone = a.gone and b.gone
        return out
    names = a.types.keys() | b.types.keys()
    return State(
        {v: a.types.get(v, frozenset()) | b.types.get(v, frozenset()) for v in names},
        a.maybe | b.maybe | {v for v in names if (v in a.types) != (v in b.types)},
        {v: a.writes.get(v, frozenset()) | b.writes.get(v, frozenset()) for v in a.writes.keys() | b.writes.keys()},
    )


def run_scope(events: list[tuple[int, str, str | None, list[str]]], params: tuple[str, ...] = ()) -> list[tuple[int, str, str | None, list[str]]]:
    """(pos, kind, var, types) of one scope; ``events`` in order."""
    found: dict[tuple[int, str, str | None], list[str]] = {}
    read: set[int] = set()
    written: dict[int, str] = {}

    def walk(i: int, state: State, until: tuple[str, ...]) -> tuple[int, State]:
        warned = False
        while i < len(events):
            pos, op, var, types = events[i]
            if op in until:
                return i, state
            if state.gone and not warned and op not in ("else", "endif", "endloop"):
                found.setdefault((pos, "UnreachableCode", None), [])
                warned = True
            if op == "assign":
                written[pos] = var
                state.types[var], state.writes[var] = frozenset(types), frozenset([pos])
                state.maybe.discard(var)
            elif op == "read":
                read.update(state.writes.get(var, ()))
                if not state.gone:
                    if var not in state.types:
                        found.setdefault((pos, "UndefinedVariable", var), [])
                    elif var in state.maybe:
                        found.setdefault((pos, "PossiblyUndefinedVariable", var), [])
                    found[pos, "env", var] = sorted(state.types.get(var, ()))
            elif op == "leave":
                state.gone = True
            elif op == "branch":
                j, first = walk(i + 1, state.copy(), ("else", "endif"))
                second = state.copy()
                if j < len(events) and events[j][1] == "else":
                    j, second = walk(j + 1, second, ("endif",))
                state, i = merge(first, second), j
                warned = False
            elif op == "loop":
                before = state.copy()
                known = dict(found)
                for _ in range(len(events) + 2):  # until nothing new comes round; sets only grow
                    found.clear()  # only the last round's findings hold
                    found.update(known)
                    j, after = walk(i + 1, state.copy(), ("endloop",))
                    after.gone = False
                    widened = merge(before, after)
                    if (widened.types, widened.maybe, widened.writes) == (state.types, state.maybe, state.writes):
                        break
                    state = widened
                i, warned = j, False
            i += 1
        return i, state

    start = State({p: frozenset(["mixed"]) for p in params})
    walk(0, start, ())
    for pos, var in written.items():
        if pos not in read:
            found[pos, "UnusedVariable", var] = []
    return sorted((p, k, v, t) for (p, k, v), t in found.items())


def analyse_scopes(events: DataFrame) -> DataFrame:
    """Runs the kernel over every (file, scope)."""

    def kernel(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos", kind="stable")
        listed = [(int(p), o, v, [] if t is None else list(t)) for p, o, v, t in zip(rows["pos"], rows["op"], rows["var"], rows["types"], strict=True)]
        out = run_scope(listed)
        return pd.DataFrame({"file": key[0], "scope": key[1], "pos": [r[0] for r in out], "kind": [r[1] for r in out], "var": [r[2] for r in out], "types": [r[3] for r in out]})

    return events.groupBy("file", "scope").applyInPandas(kernel, RESULT)
