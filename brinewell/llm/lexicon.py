"""A minimal acyclic transducer from words to token ids, packed into arrays that are memory-mapped.

The words are compiled into the minimal automaton with shared suffixes. Every transition carries a number; their sum along a
word is the word's rank, and the ranks address one flat list of ids. So suffixes stay shared though the outputs differ. Transitions
lie in a double array (base, check), which a whole batch of words is driven through at once, one byte a step.
"""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np

ARRAYS = ("base", "check", "goto", "add", "final", "offsets", "ids")


def minimal_automaton(words: list[bytes]) -> tuple[list[dict[int, int]], list[bool]]:
    """Transitions and finality of the states of the minimal automaton of sorted distinct words; state 0 is the start.

    The words are added in order; when a word leaves the path of the one before, the left part is frozen from its end on and each
    frozen state is replaced by an equal one that is already known.
    """
    edges: list[dict[int, int]] = [{}]
    final = [False]
    known: dict[tuple, int] = {}
    path = [0]
    last = b""

    def freeze(keep: int) -> None:
        for k in range(len(last), keep, -1):
            state, above = path[k], path[k - 1]
            shape = (final[state], tuple(edges[state].items()))
            if (same := known.get(shape)) is None:
                known[shape] = state
            else:
                edges[above][last[k - 1]] = same
                free.append(state)
        del path[keep + 1 :]

    free: list[int] = []
    for word in words:
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        freeze(common)
        for c in word[common:]:
            if free:
                new = free.pop()
                edges[new], final[new] = {}, False
            else:
                new = len(edges)
                edges.append({})
                final.append(False)
            edges[path[-1]][c] = new
            path.append(new)
        final[path[-1]] = True
        last = word
    freeze(0)
    return edges, final


def _numbered(edges: list[dict[int, int]], final: list[bool]) -> list[dict[int, int]]:
    """For every transition the words that come before those behind it."""
    count: dict[int, int] = {}
    stack = [0]
    while stack:
        s = stack[-1]
        if s in count:
            stack.pop()
        elif todo := [t for t in edges[s].values() if t not in count]:
            stack.extend(todo)
        else:
            count[s] = final[s] + sum(count[t] for t in edges[s].values())
            stack.pop()
    add: list[dict[int, int]] = [{} for _ in edges]
    for s in count:
        before = int(final[s])
        for c, t in edges[s].items():
            add[s][c] = before
            before += count[t]
    return add


def _packed(edges: list[dict[int, int]], final: list[bool], add: list[dict[int, int]]) -> dict[str, np.ndarray]:
    """The double array: the transition of state s by byte c lies at base[s] + c if check there is s."""
    seen, order = {0}, [0]
    for s in order:
        for t in edges[s].values():
            if t not in seen:
                seen.add(t)
                order.append(t)
    total = sum(len(edges[s]) for s in order)
    room = 3 * total + 4096
    check = np.full(room, -1, np.int32)
    base, goto, plus = np.zeros(len(edges), np.int32), np.zeros(room, np.int32), np.zeros(room, np.int32)

    def put(s: int, at: int, codes: np.ndarray) -> None:
        base[s] = at
        check[at + codes] = s
        goto[at + codes] = list(edges[s].values())
        plus[at + codes] = [add[s][c] for c in edges[s]]

    start = 256
    for s in sorted((s for s in order if len(edges[s]) > 1), key=lambda s: -len(edges[s])):
        codes = np.array(list(edges[s]))
        begin = start
        while True:
            free = begin + np.flatnonzero(check[begin : begin + 1024] == -1) - codes[0]
            fits = free[(check[free[:, None] + codes] == -1).all(axis=1)]
            if len(fits):
                put(s, int(fits[0]), codes)
                break
            begin += 1024
            if len(codes) < 4:
                start = begin  # the part before is nearly full
    single = [s for s in order if len(edges[s]) == 1]
    for s, at in zip(single, (np.flatnonzero(check[256:] == -1) + 256).tolist()):
        code = next(iter(edges[s]))
        put(s, at - code, np.array([code]))
    size = int(np.flatnonzero(check != -1).max(initial=0)) + 257
    return {"base": base, "check": check[:size], "goto": goto[:size], "add": plus[:size], "final": np.array(final)}


def compile_lexicon(entries: dict[bytes, list[int]]) -> dict[str, np.ndarray]:
    """The arrays of the transducer that maps each word to its ids. The empty word can't be an entry."""
    words = sorted(w for w in entries if w)
    edges, final = minimal_automaton(words)
    arrays = _packed(edges, final, _numbered(edges, final))
    lengths = [len(entries[w]) for w in words]
    arrays["offsets"] = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    arrays["ids"] = np.array([i for w in words for i in entries[w]], np.int32)
    arrays["longest"] = np.array([max(map(len, words), default=0)])
    return arrays


def save(arrays: dict[str, np.ndarray], folder: Path) -> None:
    folder.mkdir(parents=True, exist_ok=True)
    for name, a in arrays.items():
        np.save(folder / f"{name}.npy", a)
    (folder / "done.json").write_text(json.dumps(sorted(arrays)))


def mapped(folder: str) -> dict[str, np.ndarray]:
    """The arrays, memory-mapped: the workers of one machine share their pages."""
    return {n: np.load(f"{folder}/{n}.npy", mmap_mode="r") for n in json.loads(Path(folder, "done.json").read_text())}


def ranks(arrays: dict[str, np.ndarray], data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The rank of each word data[start:end] in the lexicon, -1 where it is none. All words advance together by a byte."""
    base, check, goto, add, final = (arrays[k] for k in ("base", "check", "goto", "add", "final"))
    out = np.full(len(starts), -1, np.int32)
    length = ends - starts
    live = np.flatnonzero((length > 0) & (length <= int(arrays["longest"][0])))
    state, total, at, left = np.zeros(len(live), np.int32), np.zeros(len(live), np.int32), starts[live], length[live]
    while len(live):
        slot = base[state] + data[at]
        good = check[slot] == state
        if not good.all():
            live, slot, total, at, left = live[good], slot[good], total[good], at[good], left[good]
        state = goto[slot]
        total = total + add[slot]
        left = left - 1
        ended = left == 0
        if ended.any():
            hit = np.flatnonzero(ended)
            hit = hit[final[state[hit]]]
            out[live[hit]] = total[hit]
            more = ~ended
            live, state, total, at, left = live[more], state[more], total[more], at[more], left[more]
        at = at + 1
    return out
