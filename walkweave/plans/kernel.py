"""The one sequential step: ordered searches over a graph, which give directions and a reference tree.

One task does a graph; it gets numbers of nodes and edges, no sequences. Everything is iterative, over arrays of adjacency.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

from walkweave.schema import SINK, SOURCE, TERMINI

#: What goes in: kind S (a: segment, n: its length), L (idx, a, b: nodes, n: weight), R (idx: place, a: node), B and E (a: a walk's first and last node).
FACTS = "graph_id string, kind string, idx long, a string, b string, n long"
#: What comes out: kind N (node), E (edge), P (a piece of an allele's tree path).
LABELS = (
    "graph_id string, kind string, node string, direction byte, position long, right_position long, distance long, on_ref boolean, parent string, depth int, tin long, tout long, chain long, chain_pos long, plen long, "
    "idx long, u string, v string, weight long, in_tree boolean, is_back boolean, branch_point string, allele string, low long, high long, rank int"
)


def _search(count: int, neighbours, seeds: list[int], more, twin=None) -> tuple[list[int], list[int]]:
    """Visits the seeds in order, each below the one before, then the rest depth first: of what may be visited next, the latest seen first, and of one node's neighbours the last.
    more(visited): the next seed once nothing is left, or None. twin: what counts as visited along with a node. Gives the order and each node's parent (-1)."""
    visited, parent, order, stack = np.zeros(count, bool), [-1] * count, [], []

    def visit(node: int, above: int) -> None:
        visited[node] = True
        if twin is not None:
            visited[twin[node]] = True
        parent[node] = above
        order.append(node)
        stack.extend((x, node) for x in neighbours(node) if not visited[x])

    for i, node in enumerate(seeds):
        visit(node, seeds[i - 1] if i else -1)
    while True:
        while stack:
            node, above = stack.pop()
            if not visited[node]:
                visit(node, above)
        seed = more(visited)
        if seed is None:
            return order, parent
        visit(seed, -1)


class Kernel:
    """A graph's labels. Nodes are numbered by name, so comparing numbers compares names."""

    def __init__(self, facts: pd.DataFrame):
        by = dict(tuple(facts.groupby("kind")))
        none = facts.iloc[:0]
        segments, links, ref = by.get("S", none), by.get("L", none), by.get("R", none).sort_values("idx")
        if not len(ref):
            raise ValueError("a graph needs one reference walk")
        if ref["a"].duplicated().any():
            raise ValueError("the reference walk visits a node twice")
        sizes = dict(zip(segments["a"], segments["n"].astype("int64"), strict=True)) | dict.fromkeys(TERMINI, 0)
        self.names = sorted(f"{s}_{o}" for s in sizes for o in "+-")
        self.number = {n: i for i, n in enumerate(self.names)}
        self.size = np.array([sizes[n[:-2]] for n in self.names], np.int64)
        self.twin = np.array([self.number[n[:-1] + ("-" if n[-1] == "+" else "+")] for n in self.names])
        links = links.sort_values("idx")
        self.idx = links["idx"].astype("int64").tolist()
        try:
            self.edges = [(self.number[u], self.number[v]) for u, v in zip(links["a"], links["b"], strict=True)]
            self.ref = [self.number[n] for n in ref["a"]]
        except KeyError as e:
            raise ValueError(f"no segment for node {e}") from None
        self.weight = [int(x) for x in links["n"]]
        ends = [[self.number[n] for n in by.get(k, none)["a"].dropna()] for k in "BE"]
        self.on_ref = np.zeros(len(self.names), bool)
        self._direct()
        self._terminate(*ends)
        self._tree()
        self._chains()
        self._places()
        self._branches()
        self._right()

    def _readings(self) -> dict[tuple[int, int], int]:
        """Both readings of each edge -> its place; the file's own reading wins where they clash."""
        out: dict[tuple[int, int], int] = {}
        for i, (u, v) in enumerate(self.edges):
            out.setdefault((int(self.twin[v]), int(self.twin[u])), i)
        for i, (u, v) in enumerate(self.edges):
            out[(u, v)] = i
        return out

    def _direct(self) -> None:
        """Each segment gets the direction in which a search along links, forward or backward, first reaches it; the reference walk is reached first, forward."""
        near: list[dict[int, int]] = [{} for _ in self.names]
        readings = self._readings()
        for (u, v), i in readings.items():  # backward steps
            near[v].setdefault(u, self.weight[i])
        for (u, v), i in readings.items():  # a forward step's weight is the one that counts
            near[u][v] = self.weight[i]
        termini = {self.number[f"{t}_{o}"] for t in TERMINI for o in "+-"}
        rest = iter([i for i in range(len(self.names)) if i not in termini])

        def more(visited):
            return next((i for i in rest if not visited[i]), None)

        order, _ = _search(len(self.names), lambda n: sorted(near[n], key=lambda x: (near[n][x], x)), self.ref, more, self.twin)
        self.direction = np.zeros(len(self.names), np.int8)
        for n in [*order, self.number[SOURCE], self.number[SINK]]:
            self.direction[n], self.direction[self.twin[n]] = 1, -1

    def _terminate(self, starts: list[int], stops: list[int]) -> None:
        """Links the termini to where forward walks may begin and end."""
        positive = [(u, v) for u, v in self._readings() if self.direction[u] == 1 and self.direction[v] == 1]
        source, sink = self.number[SOURCE], self.number[SINK]
        plain = {i for i in range(len(self.names)) if self.direction[i] == 1} - {source, sink}
        begins = plain - {v for _, v in positive} | {n for n in starts if self.direction[n] == 1} | {int(self.twin[n]) for n in stops if self.direction[n] == -1}
        ends = plain - {u for u, _ in positive} | {n for n in stops if self.direction[n] == 1} | {int(self.twin[n]) for n in starts if self.direction[n] == -1}
        self.begins_at = max(self.idx, default=-1) + 1
        new = [(source, n) for n in sorted(begins)] + [(n, sink) for n in sorted(ends)]
        self.edges += new
        self.weight += [0] * len(new)
        self.idx += range(self.begins_at, self.begins_at + len(new))
        self.ref = [source, *self.ref, sink]
        for n in self.ref:
            self.on_ref[n] = self.on_ref[self.twin[n]] = True

    def _tree(self) -> None:
        """The reference walk, then depth first among forward nodes, heavy edges first."""
        self.next: list[dict[int, int]] = [{} for _ in self.names]
        for (u, v), i in self._readings().items():
            if self.direction[u] == 1 and self.direction[v] == 1:
                self.next[u][v] = i
        for u, v in zip(self.ref[:-1], self.ref[1:], strict=True):
            if v not in self.next[u]:
                raise ValueError(f"the reference walk has no link from {self.names[u]} to {self.names[v]}")
        self.order, parent = _search(len(self.names), lambda n: sorted(self.next[n], key=lambda x: (self.weight[self.next[n][x]], x)), self.ref, lambda _: None)
        self.parent = np.array(parent)
        self.tree = {self.next[p][n] for n, p in enumerate(parent) if p >= 0}

    def _chains(self) -> None:
        """Depths, and downward chains: a node goes on with its child on the reference, else with that of the largest subtree. The child that goes on is entered last."""
        n = len(self.names)
        below, children = np.ones(n, np.int64), [[] for _ in range(n)]
        self.depth = np.full(n, -1)
        for x in self.order:  # parents come first
            p = self.parent[x]
            self.depth[x] = self.depth[p] + 1 if p >= 0 else 0
            if p >= 0:
                children[p].append(x)
        for x in reversed(self.order):
            if self.parent[x] >= 0:
                below[self.parent[x]] += below[x]
        self.tin, self.tout, self.head = np.full(n, -1), np.full(n, -1), np.full(n, -1)
        clock, stack = 0, [(self.order[0], self.order[0])]
        while stack:
            x, head = stack.pop()
            self.tin[x], self.head[x] = clock, head
            self.tout[x] = clock + below[x] - 1
            clock += 1
            if children[x]:
                on = max(children[x], key=lambda c: (self.on_ref[c], below[c], -c))
                stack.append((on, head))
                stack += [(c, c) for c in sorted(children[x], reverse=True) if c != on]

    def _places(self) -> None:
        n = len(self.names)
        self.position, self.distance, self.plen = np.full(n, -1), np.full(n, -1), np.full(n, -1)
        at = 0
        for x in self.ref:
            at += self.size[x]
            self.position[x], self.distance[x] = at, 0
        for x in self.order:
            p = self.parent[x]
            self.plen[x] = (self.plen[p] if p >= 0 else 0) + self.size[x]
            if not self.on_ref[x]:
                self.position[x], self.distance[x] = self.position[p], self.distance[p] + self.size[x]
        for a in (self.position, self.distance):
            back = a[self.twin]
            a[a < 0] = back[a < 0]

    def lca(self, x: int, y: int) -> int:
        """Nodes that the tree doesn't reach have none."""
        if self.depth[x] < 0 or self.depth[y] < 0:
            return -1
        while self.head[x] != self.head[y]:
            if self.depth[self.head[x]] < self.depth[self.head[y]]:
                x, y = y, x
            x = self.parent[self.head[x]]
        return int(x if self.depth[x] <= self.depth[y] else y)

    def forward(self, n: int) -> int:
        return n if self.direction[n] == 1 else int(self.twin[n])

    def _branches(self) -> None:
        """An edge back to an ancestor branches off above it."""
        self.branch, self.back = [-1] * len(self.edges), [False] * len(self.edges)
        for i, (u, v) in enumerate(self.edges):
            if i not in self.tree:
                b = self.lca(self.forward(u), self.forward(v))
                if b >= 0 and (b == v or b == self.twin[u]):
                    self.back[i], b = True, int(self.parent[b])
                self.branch[i] = b

    def _right(self) -> None:
        """On the reference a node's own position, else the least right position of what follows it, back edges left out."""
        n = len(self.names)
        self.right = np.full(n, -1)
        ahead = [[v for v, i in self.next[u].items() if not self.back[i]] for u in range(n)]
        waiting, above = np.array([len(a) for a in ahead]), [[] for _ in range(n)]
        for u in range(n):
            for v in ahead[u]:
                above[v].append(u)
        ready = [u for u in range(n) if self.direction[u] == 1 and not waiting[u]]
        while ready:
            u = ready.pop()
            after = [self.right[v] for v in (ahead[u] or self.next[u]) if self.right[v] >= 0]
            self.right[u] = self.position[u] if self.on_ref[u] or not after else min(after)
            for x in above[u]:
                waiting[x] -= 1
                if not waiting[x]:
                    ready.append(x)
        for u in range(n):
            if self.direction[u] == 1 and self.right[u] < 0:
                self.right[u] = self.position[u]
        self.right = np.where(self.right < 0, self.right[self.twin], self.right)

    def path(self, b: int, x: int):
        """The tree path from below b down to x, as (chain, low, high) from the top."""
        out = []
        while x >= 0 and x != b:
            h = int(self.head[x])
            low = max(self.depth[h], self.depth[b] + 1) if b >= 0 and self.head[b] == h else self.depth[h]
            out.append((h, int(low), int(self.depth[x])))
            if low > self.depth[h]:
                break
            x = int(self.parent[h])
        return out[::-1]

    def labels(self, graph_id: str) -> pd.DataFrame:
        name = lambda i: self.names[i] if i >= 0 else None
        known = lambda x: int(x) if x >= 0 else None
        nodes = [
            {"kind": "N", "node": n, "direction": int(self.direction[i]), "position": known(self.position[i]), "right_position": known(self.right[i]), "distance": known(self.distance[i]), "on_ref": bool(self.on_ref[i]),
             "parent": name(int(self.parent[i])), "depth": known(self.depth[i]), "tin": known(self.tin[i]), "tout": known(self.tout[i]), "chain": known(self.head[i]), "chain_pos": known(self.depth[i]), "plen": known(self.plen[i])}
            for i, n in enumerate(self.names)
        ]
        edges = [
            {"kind": "E", "idx": self.idx[i], "u": self.names[u], "v": self.names[v], "weight": self.weight[i], "in_tree": i in self.tree, "is_back": self.back[i], "branch_point": name(self.branch[i])}
            for i, (u, v) in enumerate(self.edges)
        ]
        paths = []
        for i, (u, v) in enumerate(self.edges):
            if i in self.tree or self.branch[i] < 0:
                continue
            if self.direction[u] == -1 and self.direction[v] == -1:
                u, v = int(self.twin[v]), int(self.twin[u])
            for allele, (x, whole) in allele_ends(int(self.direction[u]), int(self.direction[v]), self.forward(u), self.forward(v)).items():
                end = x if whole else int(self.parent[x])
                if self.depth[end] > self.depth[self.branch[i]]:
                    paths += [{"kind": "P", "idx": self.idx[i], "allele": allele, "chain": c, "low": a, "high": b, "rank": k} for k, (c, a, b) in enumerate(self.path(self.branch[i], end))]
        out = pd.DataFrame(nodes + edges + paths)
        out["graph_id"] = graph_id
        return out.reindex(columns=[f.split()[0] for f in LABELS.split(", ")]).astype({k: "Int64" for k in ("position", "right_position", "distance", "tin", "tout", "chain", "chain_pos", "plen", "idx", "weight", "low", "high")} | {"depth": "Int32", "rank": "Int32", "direction": "Int8"})


def allele_ends(du: int, dv: int, u, v) -> dict:
    """For a variant in forward form, and its ends' forward nodes: to which node below the branch point each allele's tree path goes, and whether that node is part of it.
    Where du < 0 the alleles read the reverse complement."""
    if du == 1:
        return {"ref": (v, dv == -1), "alt": (u, True)}
    return {"ref": (u, False), "alt": (v, dv == -1)}


def run(facts: pd.DataFrame) -> pd.DataFrame:
    return Kernel(facts).labels(facts["graph_id"].iloc[0])
