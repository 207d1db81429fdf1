"""Dependency graphs of calls: degrees, levels, execution paths, and replay of predictions.

A task's graph is small, while tasks are many: a task is a row with its nodes as an array.
Matching and scheduling walk over states, the set of finished nodes as a bit mask and the
steps that a run of one tool still owes, and ask only whether the next step is open there;
no list of executions is made.  Only `paths` lists them all, as that is its result:
MOST_PATHS bounds it, and beyond, the row says so.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Calls that are no tools.
ASK, ANSWER = "ask_user_for_required_parameters", "prepare_to_answer"
MOST_PATHS = 100_000

Path = list[list[int]]


def in_degrees(nodes: DataFrame) -> DataFrame:
    """task, node, degree from nodes (task, node, deps)."""
    edges = nodes.select("task", "node", F.explode("deps").alias("dep"))
    counts = edges.groupBy("task", "node").agg(F.count(F.lit(1)).alias("n"))
    return nodes.select("task", "node").join(counts, ["task", "node"], "left").select("task", "node", F.coalesce("n", F.lit(0)).cast("long").alias("degree"))


def levels(deps: list[list[int]]) -> list[int]:
    """For each node the length of the longest chain before it; -1 on a circle."""
    found = [-1] * len(deps)
    waiting = list(range(len(deps)))
    while waiting:
        ready = [i for i in waiting if all(found[d] >= 0 for d in deps[i])]
        if not ready:
            break
        for i, level in [(i, 1 + max((found[d] for d in deps[i]), default=-1)) for i in ready]:
            found[i] = level
        waiting = [i for i in waiting if found[i] < 0]
    return found


def steps_from(names: list[str], ready: list[int]) -> list[Path]:
    """What can be done next: each a list of steps, each step nodes that run side by side."""
    part_of_run, whole_runs = set(), set()
    for _, run in groupby(ready, key=lambda i: names[i]):
        own = tuple(run)
        if len(own) > 1:
            whole_runs.add(own)
            part_of_run |= {c for size in range(1, len(own)) for c in combinations(own, size)}
    first_of = {run[0]: run for run in whole_runs}
    found, seen = [], set()
    for size in range(1, len(ready) + 1):
        for choice in combinations(ready, size):
            signature = "|".join(names[i] for i in choice)
            if signature in seen:
                continue
            seen.add(signature)
            heads = [choice[:n] for n in range(1, size + 1)]
            if size == 1:
                found.append([[i] for i in first_of.get(choice[0], choice)])
            elif not any(h in part_of_run for h in heads) or any(h in whole_runs for h in heads):
                found.append([list(choice)])
    return found


def paths(names: list[str], deps: list[list[int]], most: int = MOST_PATHS) -> list[Path]:
    """All executions in order of emission; ValueError beyond `most`."""
    n, out = len(names), []
    stack: list[tuple[frozenset[int], Path]] = [(frozenset(), [])]
    while stack:
        done, path = stack.pop()
        if len(done) == n:
            out.append(path)
            if len(out) > most:
                raise ValueError(f"more than {most} paths")
            continue
        ready = [i for i in range(n) if i not in done and done.issuperset(deps[i])]
        for steps in reversed(steps_from(names, ready)):
            stack.append((done | {i for step in steps for i in step}, path + steps))
    return out


def optimal(found: list[Path]) -> list[Path]:
    """The shortest paths."""
    least = min(map(len, found), default=0)
    return [p for p in found if len(p) == least]


def ordered(deps: list[list[int]]) -> list[int]:
    """The levels of a graph; ValueError if a node depends on none of the nodes, [] if there is a circle."""
    n = len(deps)
    if any(not 0 <= d < n for own in deps for d in own):
        raise ValueError("a dependency on no node")
    found = levels(deps)
    return [] if -1 in found else found


class Walk:
    """What may come next in one graph.  A state is (mask of finished nodes, nodes that a begun run still owes).

    Open steps: of a run of one tool, ready side by side, the first node alone opens a row of single steps
    for all of them; several nodes go together unless they start with a part of a run.  Of several choices of
    the same names, in order of nodes, only the first is open.
    """

    def __init__(self, names: list[str], deps: list[list[int]]):
        self.names, self.size = names, len(names)
        self.needs = [sum(1 << d for d in set(own)) for own in deps]

    def ready(self, done: int) -> list[int]:
        return [i for i in range(self.size) if not done >> i & 1 and self.needs[i] & ~done == 0]

    def run_of(self, ready: list[int], place: int) -> list[int]:
        """The run of one name that the node at `place` of the ready ones is part of."""
        name, start, end = self.names[ready[place]], place, place + 1
        while start and self.names[ready[start - 1]] == name:
            start -= 1
        while end < len(ready) and self.names[ready[end]] == name:
            end += 1
        return ready[start:end]

    def is_open(self, state: tuple[int, tuple[int, ...]], step: list[int]) -> bool:
        """Whether just these nodes may come next."""
        done, owed = state
        if owed:
            return step == [owed[0]]
        ready, at = self.ready(done), -1
        for node in step:  # each is the first of its name behind the one before it
            following = next((p for p in range(at + 1, len(ready)) if self.names[ready[p]] == self.names[node]), None)
            if following is None or ready[following] != node:
                return False
            at = following
        if len(step) < 2:
            return len(step) == 1
        run = self.run_of(ready, ready.index(step[0]))
        return len(run) == 1 or step[: len(run)] == run

    def after(self, state: tuple[int, tuple[int, ...]], step: list[int]) -> tuple[int, tuple[int, ...]]:
        done, owed = state
        mask = done | sum(1 << i for i in step)
        if owed:
            return mask, owed[1:]
        if len(step) == 1:
            ready = self.ready(done)
            run = self.run_of(ready, ready.index(step[0]))
            if run[0] == step[0]:
                return mask, tuple(run[1:])
        return mask, ()

    def named(self, state: tuple[int, tuple[int, ...]], wanted: list[str]) -> list[int] | None:
        """The first open step with these names, in any order."""
        done, owed = state
        if owed:
            return [owed[0]] if wanted == [self.names[owed[0]]] else None
        ready, left = self.ready(done), Counter(wanted)
        there = Counter(self.names[i] for i in ready)
        if not wanted or any(there[name] < n for name, n in left.items()):
            return None
        if len(wanted) == 1:
            return next([i] for i in ready if self.names[i] == wanted[0])
        firsts = {self.names[i]: p for p, i in reversed(list(enumerate(ready))) if left[self.names[i]]}
        for name, place in sorted(firsts.items(), key=lambda x: x[1]):
            run = self.run_of(ready, place)
            if len(run) > 1 and (run[0] != ready[place] or left[name] < len(run)):
                continue
            found, rest = list(run), left - Counter([name] * len(run))
            if self._fill(ready, place + len(run), rest, found):
                return found
        return None

    def _fill(self, ready: list[int], place: int, rest: Counter, found: list[int]) -> bool:
        """Add the least nodes from `place` on that hold the rest of the names; False if they can't."""
        behind = Counter(self.names[i] for i in ready[place:])
        if any(behind[name] < n for name, n in rest.items()):
            return False
        for p in range(place, len(ready)):
            name = self.names[ready[p]]
            behind[name] -= 1
            rest_after = rest - Counter([name])
            # taken if what is left can still come behind it
            if rest[name] and all(n <= sum(self.names[i] == other for i in ready[p + 1 :]) for other, n in rest_after.items()):
                found.append(ready[p])
                rest = rest_after
                if not rest:
                    return True
        return not rest

    def all_open(self, state: tuple[int, tuple[int, ...]]) -> list[list[int]]:
        """Every open step: only for questions to the user that are ready beside other nodes."""
        done, owed = state
        if owed:
            return [[owed[0]]]
        ready = self.ready(done)
        return [list(c) for size in range(1, len(ready) + 1) for c in combinations(ready, size) if self.is_open(state, list(c))]

    def with_name(self, state: tuple[int, tuple[int, ...]], kinds: set[str]) -> set[str]:
        """Which of the names are in the first open step that has any of them."""
        done, owed = state
        if owed:
            return {self.names[owed[0]]} & kinds
        return next(({self.names[i]} for i in self.ready(done) if self.names[i] in kinds), set())


def replay(names: list[str], deps: list[list[int]], predicted: list[list[str] | None]) -> tuple[str, int, int | None]:
    """Match predicted steps with a graph; None is a step of text without calls, [] an empty one.

    Returns the label, the step it was given at, and the first step without a match (or None).
    A step of calls leads from each state where it is open to the next; a text step may stand for a
    question to the user, which is then a step of any kind, or for the answer, which ends the task.
    A graph with a circle has no execution, so nothing matches.
    """
    walk, whole = Walk(names, deps), (1 << len(names)) - 1
    states = [(0, ())] if ordered(deps) or not deps else []
    for step, calls in enumerate(predicted):
        if calls is None:
            hit = next((k for k in (walk.with_name(s, {ASK, ANSWER}) for s in states) if k), None)
            if hit is None:
                return "error", step, step
            if ANSWER in hit:
                return "correct", step, None
            states = list(dict.fromkeys(walk.after(s, nodes) for s in states for nodes in walk.all_open(s)))
            continue
        match = next((m for m in (walk.named(s, calls) for s in states) if m), None)
        if match is None:
            return "error", step, step
        states = list(dict.fromkeys(walk.after(s, match) for s in states if walk.is_open(s, match)))
        if any(names[i] == ANSWER for i in match) or all(done == whole for done, _ in states):
            return "correct", step, None
    return "error", len(predicted), len(predicted)


def shortest_length(deps: list[list[int]]) -> int:
    """Steps of the shortest execution: the longest chain, as all that is ready may go together.  0 if there is none."""
    return max(ordered(deps), default=-1) + 1


def is_optimal(label: str, step: int, deps: list[list[int]]) -> bool:
    """Whether a correct task took as few steps as the shortest execution."""
    return label == "correct" and bool(deps) and step == shortest_length(deps) - 1


def schedule(names: list[str], deps: list[list[int]]) -> Path:
    """The first of the shortest executions, in the order in which `paths` lists them; [] if there is none.

    Each step is the first open one that leaves no chain longer than the steps that remain: it holds all
    nodes with the longest chain behind them, and others only where the rules ask for them.
    """
    if not ordered(deps):
        return []
    behind: list[list[int]] = [[] for _ in deps]
    for i, own in enumerate(deps):
        for d in own:
            behind[d].append(i)
    height = [1 + level for level in levels(behind)]  # nodes of the longest chain from here on
    walk, left, state, out = Walk(names, deps), max(height), (0, ()), []
    while left:
        ready = walk.ready(state[0])
        urgent = [i for i in ready if height[i] == left]
        spare = [i for i in ready if height[i] < left]
        step = urgent
        if state[1]:
            step = [state[1][0]]
        else:
            for more in range(len(spare) + 1):
                choices = sorted(sorted((*urgent, *extra)) for extra in combinations(spare, more))
                fits = next((c for c in choices if walk.is_open(state, c) and _in_time(walk, state, c, height, left)), None)
                if fits:
                    step = fits
                    break
        state = walk.after(state, step)
        out.append(step)
        left -= 1
    return out


def _in_time(walk: Walk, state: tuple[int, tuple[int, ...]], step: list[int], height: list[int], left: int) -> bool:
    """Whether the steps that a begun run owes leave enough for the chains beside it."""
    done, owed = walk.after(state, step)
    mask = done | sum(1 << i for i in owed)
    return max((height[i] for i in range(walk.size) if not mask >> i & 1), default=0) <= left - 1 - len(owed)


# ---- columns ----

_NODES = "array<struct<name:string,deps:array<int>>>"
_STEPS = pa.list_(pa.list_(pa.list_(pa.int32())))


def paths_column(nodes: Column) -> Column:
    """struct(paths, error) of an array of struct(name, deps)."""

    @F.arrow_udf("struct<paths:array<array<array<int>>>,error:string>")
    def run(column: pa.Array) -> pa.Array:
        out = []
        for own in column.to_pylist():
            try:
                found = paths([n["name"] for n in own or []], [n["deps"] or [] for n in own or []])
                out.append({"paths": found, "error": None})
            except ValueError as e:
                out.append({"paths": None, "error": str(e)})
        return pa.array(out, pa.struct([("paths", _STEPS), ("error", pa.string())]))

    return run(nodes)


def levels_column(deps: Column) -> Column:
    """array<int> from the nodes' dependencies, in order of nodes."""

    @F.arrow_udf("array<int>")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([levels([d or [] for d in own or []]) for own in column.to_pylist()], pa.list_(pa.int32()))

    return run(deps)


def prune(found: Column, step: Column, chosen: Column) -> Column:
    """The paths whose step (from 0) is just the chosen nodes."""
    return F.filter(found, lambda p: F.get(p, step) == chosen)


def shortest(found: Column) -> Column:
    """The shortest of an array of paths."""
    least = F.array_min(F.transform(found, lambda p: F.size(p)))
    return F.filter(found, lambda p: F.size(p) == least)


def step_candidates(found: Column, names: Column, step: Column) -> Column:
    """For each path that has such a step, the names in it, sorted."""
    here = F.filter(F.transform(found, lambda p: F.get(p, step)), lambda s: s.isNotNull())
    return F.transform(here, lambda s: F.array_sort(F.transform(s, lambda i: F.get(names, i))))


def schedule_column(nodes: Column) -> Column:
    """array<array<int>>: the steps of the first shortest execution of an array of struct(name, deps); null for a dependency on no node."""

    @F.arrow_udf("array<array<int>>")
    def run(column: pa.Array) -> pa.Array:
        out = []
        for own in column.to_pylist():
            try:
                out.append(schedule([n["name"] for n in own or []], [n["deps"] or [] for n in own or []]))
            except ValueError:
                out.append(None)
        return pa.array(out, pa.list_(pa.list_(pa.int32())))

    return run(nodes)


def replay_column(nodes: Column, predicted: Column) -> Column:
    """struct(label, step, failed_at, is_optimal, error) of struct(name, deps) arrays and predicted steps of names.

    error says what is wrong with a graph; the rest is null then.
    """

    @F.arrow_udf("struct<label:string,step:int,failed_at:int,is_optimal:boolean,error:string>")
    def run(graphs: pa.Array, steps: pa.Array) -> pa.Array:
        out = []
        for own, told in zip(graphs.to_pylist(), steps.to_pylist()):
            names, deps = [n["name"] for n in own or []], [n["deps"] or [] for n in own or []]
            try:
                label, step, failed = replay(names, deps, told or [])
                out.append({"label": label, "step": step, "failed_at": failed, "is_optimal": is_optimal(label, step, deps)})
            except ValueError as e:
                out.append({"error": str(e)})
        kind = pa.struct([("label", pa.string()), ("step", pa.int32()), ("failed_at", pa.int32()), ("is_optimal", pa.bool_()), ("error", pa.string())])
        return pa.array(out, kind)

    return run(nodes, predicted)
