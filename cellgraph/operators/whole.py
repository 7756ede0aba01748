"""Context-sensitive analyses of programs, each program in one task.

A program's facts and calls are one group of rows, as large as the program, and
a corpus of programs is analysed in as many tasks. Within a task a function (or
a component of the call graph) has a graph of its own. Bottom-up, each call
takes a copy of what the callee's graph reaches from formals, results and
globals; top-down, the callee takes a copy of what the caller's arguments and
results reach; the context-sensitive mode goes on until every call's simulation
is a function that is injective on modified nodes.
"""

from __future__ import annotations

import sys
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

from ..schema import FLAG, OMNI
from .fixpoint import _weighted_labels

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The kinds of facts of a graph; each is a list of tuples.
FACTS = ("eq", "link", "flag", "accessed", "site", "array", "collapse", "cell")
ARRAY, FOREIGN, EXTERNAL, MODIFIED = FLAG["array"], FLAG["foreign"], FLAG["external"], FLAG["modified"]


def new_facts() -> dict[str, list]:
    return {k: [] for k in FACTS}


def plus(*parts: dict[str, list]) -> dict[str, list]:
    return {k: [x for p in parts for x in p[k]] for k in FACTS}


class Graph:
    """A solved graph: node -> [flags, size, stride, collapsed]; link, accessed, site and cell rows over these nodes; ``where`` of every node that went in."""

    def __init__(self, facts: dict[str, list]):
        nodes: dict[int, list] = {}

        def at(n: int) -> list:
            return nodes.setdefault(n, [0, 0, 0, False])

        own: dict[int, bool] = {}  # nodes that some fact of the graph itself names
        for n, flags in facts["flag"]:
            at(n)[0] |= flags & ~FOREIGN
            own[n] = own.get(n, False) or not flags & FOREIGN
        for n, off, _, size in facts["accessed"]:
            at(n)[1] = max(at(n)[1], off + size)
        for n, stride in facts["array"]:
            at(n)[2] = min(at(n)[2] or stride, stride)
        for (n,) in facts["collapse"]:
            at(n)[3] = True
        for n1, _, n2, _ in facts["eq"]:
            at(n1), at(n2)
        for n, _, _, d, _ in facts["link"]:
            at(n), at(d)
        for x in facts["cell"]:
            at(x[2])
        for n, _ in facts["site"]:
            at(n)
        eq, link = facts["eq"], {(n, o, f, d, x) for n, o, f, d, x in facts["link"]}
        accessed = set(facts["accessed"])
        where = {n: (n, 0) for n in nodes}
        native = {n for n in nodes if own.get(n, True)}
        while True:
            ids = np.array(sorted(nodes), np.int64)
            column = lambda k: np.array([e[k] for e in eq], np.int64)  # noqa: B023, E731
            found = _weighted_labels(ids, column(0), column(2), column(1) - column(3)) if eq else (ids, ids, np.zeros(len(ids), np.int64), np.zeros(len(ids), bool))
            lab = {int(n): (int(r), int(d), bool(c)) for n, r, d, c in zip(*found)}
            nodes = self._states(nodes, lab)
            native = {lab[n][0] for n in native}

            def moved(n: int, off: int) -> tuple[int, int]:
                r, delta, _ = lab[n]  # noqa: B023
                _, _, stride, collapsed = nodes[r]  # noqa: B023
                off += delta
                return r, 0 if collapsed else off % stride if stride > 0 else off

            link = {(*moved(n, o), f, *moved(d, x)) for n, o, f, d, x in link}
            omni = {(n, o) for n, o, f, _, _ in link if f == OMNI}
            link = {(n, o, OMNI if (n, o) in omni else f, d, x) for n, o, f, d, x in link}
            accessed = {(*moved(n, o), t, b) for n, o, t, b in accessed}
            where = {k: moved(n, o) for k, (n, o) in where.items()}
            over = {n for n, o, _, b in accessed if 0 < nodes[n][2] < o + b and not nodes[n][3]}
            targets = defaultdict(list)
            for n, o, f, d, x in link:
                targets[n, o, f].append((d, x))
            eq = [(*min(t), *x) for t in targets.values() if len(t) > 1 for x in t if x != min(t)]
            if not eq and not over:
                break
            for n in over:
                nodes[n][3] = True
        self.nodes, self.link, self.accessed, self.where = nodes, link, accessed, where
        self.native = native
        self.site = {(where[n][0], v) for n, v in facts["site"]}
        self.cell = {(k, v, *where_of(where, n, o, nodes)) for k, v, n, o in facts["cell"]}

    @staticmethod
    def _states(nodes: dict, lab: dict) -> dict:
        groups = defaultdict(list)
        for n, state in nodes.items():
            groups[lab[n][0]].append((lab[n][1], lab[n][2], state))
        out = {}
        for rep, members in groups.items():
            least = min((s[2] for _, _, s in members if s[2] > 0), default=0)
            flags, plain, bad = 0, 0, False
            for delta, conflict, (f, size, stride, collapsed) in members:
                flags |= f
                plain = max(plain, delta + size)
                bad |= conflict or collapsed
                if least:
                    gap = delta % least
                    bad |= bool(stride % least or gap) if stride > 0 else bool(gap) and gap + size > least
            out[rep] = [flags & ~ARRAY, 1, 0, True] if bad else [flags, least or plain, least, False]
        return out

    def cells(self, *kinds: str) -> dict:
        """value -> (node, off) of the kinds of cells."""
        return {v: (n, o) for k, v, n, o in self.cell if k in kinds}

    def reach(self, roots) -> set[int]:
        out = defaultdict(set)
        for n, _, _, d, _ in self.link:
            out[n].add(d)
        seen, todo = set(roots), list(roots)
        while todo:
            for d in out[todo.pop()] - seen:
                seen.add(d)
                todo.append(d)
        return seen

    def facts(self, keep: set[int] | None = None) -> dict[str, list]:
        """The graph as facts, of the nodes given or of all."""
        on = self.nodes if keep is None else keep
        return {
            "eq": [], "link": [x for x in self.link if x[0] in on and x[3] in on], "flag": [(n, s[0]) for n, s in self.nodes.items() if n in on], "accessed": [x for x in self.accessed if x[0] in on], "site": [x for x in self.site if x[0] in on],
            "array": [(n, s[2]) for n, s in self.nodes.items() if n in on and s[2] > 0], "collapse": [(n,) for n, s in self.nodes.items() if n in on and s[3]], "cell": [x for x in self.cell if x[2] in on],
        }

    def live(self) -> Graph:
        """The graph without nodes that no cell reaches."""
        return Graph(self.facts(self.reach({x[2] for x in self.cell})))

    def without_foreign(self) -> Graph:
        """The graph without nodes that are copies only."""
        return Graph(self.facts(self.native))


def where_of(where: dict, n: int, o: int, nodes: dict) -> tuple[int, int]:
    """The cell of byte o of a node that went in."""
    r, off = where[n]
    _, _, stride, collapsed = nodes[r]
    off += o
    return r, 0 if collapsed else off % stride if stride > 0 else off


class Analysis:
    """The graphs of one program.

    ``local`` has the facts of each graph; ``pairs`` the rows (cs, caller graph,
    callee graph, kind, caller's value, callee's value) of calls; ``level`` of
    each graph counts from the functions that call none; ``stack`` are the
    values whose sites do not outlive their function.
    """

    def __init__(self, local: dict[int, dict], pairs: list[tuple], level: dict[int, int], stack: set[int]):
        self.local, self.level, self.stack, self.fresh = local, level, stack, 0
        self.inner, self.calls = defaultdict(list), defaultdict(list)
        for p in sorted(set(pairs)):
            (self.inner[p[1]] if p[1] == p[2] else self.calls[p[0], p[1], p[2]]).append(p[3:])
        self.graph: dict[int, Graph] = {}

    def _copy(self, of: Graph, roots: set[int], strip: bool, calm: set[int] = frozenset()) -> tuple[dict, dict]:
        """Facts of a copy of what the roots reach, and the copies; ``strip`` leaves sites of the stack behind, ``calm`` nodes lose their external flag."""
        part = of.reach(roots)
        new = {}
        for n in sorted(part):
            self.fresh -= 1
            new[n] = self.fresh
        f = of.facts(part)
        f["link"] = [(new[n], o, t, new[d], x) for n, o, t, d, x in f["link"]]
        f["flag"] = [(new[n], (flags & ~EXTERNAL if n in calm else flags) | FOREIGN) for n, flags in f["flag"]]
        f["accessed"] = [(new[n], o, t, b) for n, o, t, b in f["accessed"]]
        f["site"] = [(new[n], v) for n, v in f["site"] if not (strip and v in self.stack)]
        f["array"], f["collapse"] = [(new[n], s) for n, s in f["array"]], [(new[n],) for (n,) in f["collapse"]]
        f["cell"] = [("callsite", v, new[n], o) for k, v, n, o in f["cell"] if k == "callsite"]
        return f, new

    def _met(self, key: tuple, caller: Graph | dict, callee: Graph) -> list[tuple]:
        """(caller's cell, callee's cell) of a call: arguments, results and the globals that both have."""
        mine = caller if isinstance(caller, dict) else caller.cells("scalar", "formal", "ret", "global")
        theirs = callee.cells("scalar", "formal", "ret", "global")
        out = [(mine[a], theirs[b]) for _, a, b in self.calls[key] if a in mine and b in theirs]
        own, other = (caller.cells("global") if isinstance(caller, Graph) else {}), callee.cells("global")
        return out + [(own[v], other[v]) for v in sorted(own.keys() & other.keys())]

    def _up(self, caller: int, keys: list[tuple]) -> None:
        """The caller's graph with copies of the callees' at the calls."""
        graph, parts, eq = self.graph[caller], [], []
        for key in keys:
            callee = self.graph[key[2]]
            met = self._met(key, graph, callee)
            sites = {n for k, _, n, _ in callee.cell if k == "callsite"}
            formal = {n for n, _ in callee.cells("formal").values()}
            more = {n for n, _ in callee.cells("global").values()}
            copy, new = self._copy(callee, {c[0] for _, c in met} | sites | more, True, formal)
            copy["cell"] += [("global", v, new[n], o) for v, (n, o) in sorted(callee.cells("global").items())]
            parts.append(copy)
            eq += [(n, o, new[m], x) for (n, o), (m, x) in met]
        mine = graph.facts()
        mine["eq"] = eq
        both = plus(mine, *parts)
        seen: dict[int, tuple] = {}  # one cell for each global: those of copies meet the caller's
        for k, v, n, o in both["cell"]:
            if k == "global" and seen.setdefault(v, (n, o)) != (n, o):
                both["eq"].append((*seen[v], n, o))
        self.graph[caller] = Graph(both)

    def _down(self, callee: int, keys: list[tuple]) -> None:
        """The callee's graph with copies of what the callers' arguments and results reach, less what is no more than a copy."""
        graph, parts, eq = self.graph[callee], [], []
        for key in keys:
            caller = self.graph[key[1]]
            met = self._met(key, caller, graph)
            copy, new = self._copy(caller, {c[0] for c, _ in met}, False)
            copy["cell"] = []
            parts.append(copy)
            eq += [(new[n], o, m, x) for (n, o), (m, x) in met]
        mine = graph.facts()
        mine["eq"] = eq
        self.graph[callee] = Graph(plus(mine, *parts)).without_foreign()

    def bottom_up(self) -> None:
        for g in sorted(self.local, key=lambda g: (self.level[g], g)):
            own = self.local[g]
            cell = {v: (n, o) for k, v, n, o in own["cell"]}
            eq = [(*cell[a], *cell[b]) for _, a, b in self.inner[g] if a in cell and b in cell]
            self.graph[g] = Graph(plus(own, new_facts() | {"eq": eq}))
            keys = [k for k in self.calls if k[1] == g]
            if keys:
                self._up(g, keys)

    def top_down(self) -> None:
        for g in sorted(self.local, key=lambda g: (-self.level[g], g)):
            keys = [k for k in self.calls if k[2] == g]
            if keys:
                self._down(g, keys)

    def simulate(self, key: tuple) -> tuple[dict, bool]:
        """Images (node -> set of (node, offset)) of the callee's nodes in the caller's graph, and whether some field has none."""
        caller, callee = self.graph[key[1]], self.graph[key[2]]
        fields = defaultdict(list)
        for n, o, f, d, x in callee.link:
            fields[n].append((o, f, d, x))
        target = {(n, o, f): (d, x) for n, o, f, d, x in caller.link}
        sim, todo, bad = defaultdict(set), [], False
        for (n, o), (m, x) in self._met(key, caller, callee):
            bad |= o < x and not caller.nodes[n][2]
            todo.append((m, n, max(0, o - x)))
        while todo:
            m, n, gap = todo.pop()
            (_, _, s1, c1), (_, _, s2, c2) = callee.nodes[m], caller.nodes[n]
            gap = 0 if c2 else gap % s2 if s2 > 0 else gap
            if (n, gap) in sim[m]:
                continue
            sim[m].add((n, gap))
            if not c2 and (c1 or s1 > 0 and (s2 <= 0 or gap % s2 or s1 % s2)):
                bad = True
                continue
            for o, f, d, x in fields[m]:
                at = 0 if c2 else (o + gap) % s2 if s2 > 0 else o + gap
                to = target.get((n, at, f)) or target.get((n, at, OMNI))
                if to is None or to[1] < x and not caller.nodes[to[0]][2] and not caller.nodes[to[0]][3]:
                    bad = True
                else:
                    todo.append((d, to[0], max(0, to[1] - x)))
        return sim, bad

    def decide(self, key: tuple) -> str:
        """UP, DOWN or NONE."""
        sim, bad = self.simulate(key)
        if bad or any(len(t) > 1 for t in sim.values()):
            return "UP"
        hit = defaultdict(set)
        for m, t in sim.items():
            for at in t:
                hit[at].add(m)
        modified = self.graph[key[1]].nodes
        return "DOWN" if any(len(m) > 1 and modified[n][0] & MODIFIED for (n, _), m in hit.items()) else "NONE"

    def settle(self) -> None:
        """Propagate at calls until all are settled; a changed graph brings its calls back."""
        todo = list(self.calls)
        while todo:
            key = todo.pop(0)
            what = self.decide(key)
            if what == "NONE":
                continue
            changed = key[1] if what == "UP" else key[2]
            (self._up if what == "UP" else self._down)(changed, [key])
            todo += [k for k in self.calls if changed in k[1:] and k not in todo]

    def merge_sites(self) -> None:
        """Alloc sites agree along the simulations of all calls."""
        while True:
            changed = False
            for key in self.calls:
                caller, callee = self.graph[key[1]], self.graph[key[2]]
                for m, images in self.simulate(key)[0].items():
                    for n, _ in images:
                        a, b = {v for x, v in callee.site if x == m}, {v for x, v in caller.site if x == n}
                        changed |= a != b
                        callee.site |= {(m, v) for v in b}
                        caller.site |= {(n, v) for v in a}
            if not changed:
                return

    def run(self, mode: str) -> None:
        self.bottom_up()
        if mode == "top-down":
            self.top_down()
        elif mode == "context-sensitive":
            self.settle()
            self.merge_sites()
        if mode != "bottom-up":
            self.graph = {g: x.live() for g, x in self.graph.items()}


SCHEMA = "program long, kind string, g long, a long, b long, c long, d long, s string"


def analysed(mode: str):
    """The task of one program: rows of facts, calls, levels and stack values (SCHEMA) to rows of solved graphs."""

    def run(table: pa.Table) -> pa.Table:
        rows = [tuple(r) for r in zip(*(table.column(k).to_pylist() for k in ("kind", "g", "a", "b", "c", "d", "s")))]
        local, pairs, level, stack = defaultdict(new_facts), [], {}, set()
        for kind, g, a, b, c, d, s in rows:
            if kind == "level":
                level[g] = a
                local[g]
            elif kind == "stack":
                stack.add(a)
            elif kind == "pair":
                pairs.append((a, g, b, s, c, d))
            else:
                made = {"eq": (a, b, c, d), "link": (a, b, s, c, d), "flag": (a, b), "accessed": (a, b, s, c), "site": (a, b), "array": (a, b), "collapse": (a,), "cell": (s, a, b, c)}[kind]
                local[g][kind].append(made)
        work = Analysis({g: {k: sorted(set(v)) for k, v in f.items()} for g, f in local.items()}, pairs, level, stack)
        work.run(mode)
        program = table.column("program")[0].as_py() if table.num_rows else 0
        out = []
        for g, x in work.graph.items():
            out += [("node", g, n, s[0], s[1], s[2], "collapsed" if s[3] else "") for n, s in x.nodes.items()]
            out += [("link", g, n, o, d, y, f) for n, o, f, d, y in x.link]
            out += [("accessed", g, n, o, b, None, t) for n, o, t, b in x.accessed]
            out += [("site", g, n, v, None, None, None) for n, v in x.site]
            out += [("cell", g, v, n, o, None, k) for k, v, n, o in x.cell]
        columns = list(zip(*out)) or [()] * 7
        return pa.table([pa.array([program] * len(out), pa.int64()), pa.array(columns[0], pa.string()), *[pa.array(c, pa.int64()) for c in columns[1:6]], pa.array(columns[6], pa.string())], ["program", "kind", "g", "a", "b", "c", "d", "s"])

    return run
