"""Minimal acyclic transducers: sorted terms to and from their lexicographic ordinals."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np


def build(terms: Iterable[bytes]) -> dict[str, np.ndarray]:
    """Arrays of the minimal automaton of sorted distinct terms.

    States are numbered so that targets come before sources; the last one is the
    root. ``first`` delimits the transitions of a state in ``label`` (ascending) and
    ``target``; ``count`` is the number of terms that can be completed from it.
    """
    known: dict[tuple, int] = {}
    path: list[list] = [[False, [], []]]  # unfinished states of the last term: accepts, labels, targets
    last = b""

    def finish(depth: int) -> None:
        while len(path) > depth:
            accepts, labels, targets = path.pop()
            key = accepts, bytes(labels), tuple(targets)
            path[-1][2].append(known.setdefault(key, len(known)))

    for term in terms:
        same = 0
        for x, y in zip(last, term, strict=False):
            if x != y:
                break
            same += 1
        finish(same + 1)
        for byte in term[same:]:
            path[-1][1].append(byte)
            path.append([False, [], []])
        path[-1][0] = True
        last = term
    finish(1)
    accepts, labels, targets = path[0]
    states = [*known, (accepts, bytes(labels), tuple(targets))]  # the root gets a state of its own
    sizes = np.array([len(s[1]) for s in states], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    count = np.zeros(len(states), np.int64)
    for i, (accept, _, to) in enumerate(states):
        count[i] = accept + sum(count[t] for t in to)
    return {
        "accept": np.array([s[0] for s in states], bool),
        "first": first,
        "label": np.frombuffer(b"".join(s[1] for s in states), np.uint8),
        "target": np.array([t for s in states for t in s[2]], np.int64),
        "count": count,
    }


class Transducer:
    """Several automata of one sorted vocabulary, each of a range of terms, walked by many words at once.

    ``parts`` are (first term, first ordinal, arrays); state 0 is the dead one.
    """

    def __init__(self, parts: list[tuple[bytes, int, dict[str, np.ndarray]]]):
        parts = sorted(parts, key=lambda p: p[0])
        self.heads = np.array([int.from_bytes(term[:8].ljust(8, b"\0"), "big") for term, _, _ in parts], np.uint64)
        self.bases = np.array([base for _, base, _ in parts], np.int64)
        used = np.zeros(256, bool)
        for _, _, p in parts:
            used[p["label"]] = True
        self.kind = np.where(used, np.cumsum(used), 0)  # 0: a byte in no term
        self.kinds = int(used.sum()) + 1
        states = 1 + sum(len(p["accept"]) for _, _, p in parts)
        self.accept = np.zeros(states, bool)
        self.to = np.zeros((states, self.kinds), np.int32)
        self.skip = np.zeros((states, self.kinds), np.uint16)  # terms of the part before those behind the transition
        self.roots, offset = [], 1
        for _, _, p in parts:
            n = len(p["accept"])
            self.accept[offset : offset + n] = p["accept"]
            source = np.repeat(np.arange(n), np.diff(p["first"]))
            before = np.cumsum(p["count"][p["target"]]) - p["count"][p["target"]]
            start = before[np.minimum(p["first"][:-1], max(len(before) - 1, 0))] if len(before) else np.zeros(n, np.int64)
            kind = self.kind[p["label"]]
            self.to[offset + source, kind] = p["target"] + offset
            self.skip[offset + source, kind] = before - start[source] + p["accept"][source]
            offset += n
            self.roots.append(offset - 1)
        self.roots = np.array(self.roots, np.int64)

    def ordinals(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Ordinal of every word ``data[start:end]``, -1 for words that aren't terms."""
        out = np.full(len(starts), -1, np.int64)
        if not len(starts) or not len(self.heads):
            return out
        head = np.zeros(len(starts), np.uint64)
        for i in range(8):
            at = starts + i
            byte = np.where(at < ends, data[np.minimum(at, len(data) - 1)], 0).astype(np.uint64)
            head = head << np.uint64(8) | byte
        # the parts whose first term may come before the word: more than one where the heads are equal
        low, high = np.searchsorted(self.heads, head, "left") - 1, np.searchsorted(self.heads, head, "right") - 1
        open_ = np.flatnonzero(high >= 0)
        part = high.copy()
        while len(open_):
            self.walk(data, starts, ends, open_, part, out)
            part[open_] -= 1
            open_ = open_[(out[open_] < 0) & (part[open_] >= np.maximum(low[open_], 0))]
        return out

    def walk(self, data, starts, ends, live, part, out) -> None:
        state, total = self.roots[part[live]], self.bases[part[live]]
        at, end = starts[live], ends[live]
        to, skip = self.to.ravel(), self.skip.ravel()
        while len(live):
            done = at == end
            if done.any():
                hit = done & self.accept[state]
                out[live[hit]] = total[hit]
                go = ~done
                live, state, total, at, end = live[go], state[go], total[go], at[go], end[go]
            step = state * self.kinds + self.kind[data[at]]
            state, total, at = to[step].astype(np.int64), total + skip[step], at + 1
            alive = state > 0
            if not alive.all():
                live, state, total, at, end = live[alive], state[alive], total[alive], at[alive], end[alive]
