"""Cheapest role patterns by the auction shortest-path algorithm.

A conversation is a lattice: node (i, state) says that i rows are consumed and what the roles
kept so far end with (nothing, system, user, assistant). Keep, rerole and delete consume a row,
insert does not. All costs are integers.

Each node has a price. The algorithm holds a path from the origin: if the price of its last
node is below the cheapest (arc + price of its head), the price is raised to that and the path
contracts by one node, otherwise the path extends along that arc; it ends at the destination.
Prices stay dual feasible (no price exceeds arc + price of its head), so when the path is
complete the arcs of every cheapest path are tight: price = arc + price of the head. The
ASCII-least audit is traced along tight arcs, smallest label first. Distinct labels leave a
node by distinct arcs, so no two paths have the same audit. Prices begin with the least cost
of the rows still to come, which is feasible, and serve the next origin as they are.

A long conversation is cut into chunks of ``CHUNK`` rows. ``summary`` gives a chunk's cheapest
cost from each state to each and the order of the audits that lead from one state to several:
those differ within the chunk, none is the beginning of another, since inserts at a boundary
belong to the later chunk. So a chunk is again a layer of four states, with that order as its
label, and chunks of chunks are solved by the same function.
"""

from __future__ import annotations

from itertools import chain

START, SYSTEM, USER, ASSISTANT = range(4)
CHUNK = 64
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: What is still inserted at the end of a conversation, by state, so that it may end there.
CLOSING = ("", "II", "I", "")
NEXT = (USER, USER, ASSISTANT, USER)  # the role a reroled or inserted row takes
INF = float("inf")

#: An arc is (label, cost, state at its head); arcs of a state are in the order of labels.
Layer = tuple[tuple[tuple, ...], ...]


def row_layer(code: str) -> Layer:
    """The arcs that consume a row. Codes: s, u, a or x (another initial), in capitals if the
    row is truncated; b and c for blank and duplicate rows, which have to go."""
    if code in "bc":
        return tuple((("D", DELETE, s),) for s in range(4))
    more = TRUNCATED if code.isupper() else 0
    stands = {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(code.lower())
    out = []
    for s in range(4):
        arcs = [("D", DELETE, s)]
        if stands == NEXT[s] or stands == SYSTEM and s == START:
            arcs.append(("K", KEEP + more, stands))
        out.append((*arcs, ("R", REROLE + more, NEXT[s])))
    return tuple(out)


_ROWS = {c: row_layer(c) for c in "suaxSUAXbc"}
_INSERTS = tuple((("I", INSERT, NEXT[s]),) for s in range(4))


def row_layers(codes: str) -> list[Layer]:
    return [_ROWS[c] for c in codes]


def summary_layer(numbers: list[int]) -> Layer:
    """The layer of a chunk from the 32 numbers of ``summary``."""
    return tuple(tuple(sorted((numbers[16 + 4 * s + e], numbers[4 * s + e], e)
                              for e in range(4) if numbers[4 * s + e] >= 0)) for s in range(4))


class Lattice:
    """Nodes 4 * i + state, and the destination behind the states in ``exits`` (state: cost)."""

    def __init__(self, layers: list[Layer], exits: dict[int, int], inserts: bool):
        n = len(layers)
        self.end = 4 * n + 4
        self.arcs: list[list[tuple]] = []
        # states from which no state of ``exits`` can be reached: roles only move on
        alive = [s for s in range(4) if max(exits) >= USER or s <= max(exits)]
        for i, layer in enumerate(layers):
            for s in range(4):
                own = [(label, cost, 4 * i + 4 + e) for label, cost, e in layer[s]]
                if inserts:
                    own += [(label, cost, 4 * i + e) for label, cost, e in _INSERTS[s]]
                    own.sort()
                self.arcs.append(own)
        for s in range(4):
            self.arcs.append([("", exits[s], self.end)] if s in exits else [])
        least = [min((a[1] for a in chain(*layer)), default=0) for layer in layers]
        self.price: list[float] = [0] * (self.end + 1)
        ahead = min(exits.values())
        for i in range(n, -1, -1):
            if i < n:
                ahead += least[i]
            for s in range(4):
                self.price[4 * i + s] = ahead if s in alive else INF

    def auction(self, origin: int) -> float:
        """Raise prices until a path from ``origin`` reaches the destination; its cost."""
        price, arcs, end = self.price, self.arcs, self.end
        path = [origin]
        while (at := path[-1]) != end:
            best, head = INF, -1
            for _, cost, j in arcs[at]:
                if cost + price[j] < best:
                    best, head = cost + price[j], j
            if price[at] < best or best == INF:
                price[at] = best
                if len(path) > 1:
                    path.pop()
                elif best == INF:
                    return INF
            else:
                path.append(head)
        return price[origin]

    def trace(self, origin: int) -> tuple[list, list[int]]:
        """The least labels of a tight path from ``origin``, and its nodes."""
        price, end = self.price, self.end
        labels, nodes, dead = [], [origin], set()
        while (at := nodes[-1]) != end:
            for label, cost, j in self.arcs[at]:
                if price[at] == cost + price[j] and j not in dead:
                    labels.append(label)
                    nodes.append(j)
                    break
            else:  # a tight arc may lead to a node whose price was not raised to its distance
                dead.add(at)
                nodes.pop()
                labels.pop()
        return labels[:-1], nodes[:-1]


def summary(layers: list[Layer], inserts: bool) -> list[int]:
    """For each pair (state before, state behind) the cheapest cost, -1 if there is no way, and
    the place of its least audit among those from the same state: 16 and 16 numbers."""
    costs, audits = [-1] * 16, {}
    for e in range(4):
        lattice = Lattice(layers, {e: 0}, inserts)
        for s in range(4):
            if lattice.price[s] < INF and (cost := lattice.auction(s)) < INF:
                costs[4 * s + e] = int(cost)
                audits[s, e] = lattice.trace(s)[0]
    places = [-1] * 16
    for s in range(4):
        for k, (_, e) in enumerate(sorted((audits[s, e], e) for e in range(4) if (s, e) in audits)):
            places[4 * s + e] = k
    return costs + places


def solve(layers: list[Layer], inserts: bool, entry: int = START, exit_: int = -1) -> tuple[list, list[int]]:
    """Labels and states (before, between and behind the layers) of the cheapest way from
    ``entry`` to ``exit_``; -1: to a state that may end a conversation, closing inserts paid."""
    exits = {s: INSERT * len(CLOSING[s]) for s in range(4)} if exit_ < 0 else {exit_: 0}
    lattice = Lattice(layers, exits, inserts)
    lattice.auction(entry)
    labels, nodes = lattice.trace(entry)
    return labels, [n % 4 for n in nodes]
