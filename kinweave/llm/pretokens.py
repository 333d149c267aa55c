"""Pre-token boundaries without a regular expression.

The pattern of byte-level vocabularies (contractions, letters, numbers, other
signs with an optional leading space, white space) is a finite automaton once
every code point has a class. Classes come from one table over all code points;
looking ahead (is the next character white space, do the letters of a
contraction follow) is a comparison of shifted arrays. What a character does to
the automaton's state is a function from states to states. Functions compose
associatively, and the few that can arise are numbered with a multiplication
table, so the states of all characters come from a prefix scan: scan inside
blocks side by side, scan the blocks' products, apply them. Texts are joined;
a class of its own sets the state back between them.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

# Classes.
LETTER, NUMBER, OTHER, SPACE_JOIN, SPACE_LAST, SPACE_RUN, SHORT, LONG, RESET = range(9)
# States: what stands before the character.
START, IN_LETTER, IN_NUMBER, IN_OTHER, JOIN, IN_RUN, ONE_LEFT, TWO_LEFT = range(8)
BLOCK = 64
#: Characters that are scanned at once: their arrays stay in the processor's cache.
GROUP = 200_000


def _step(state: int, kind: int) -> tuple[int, bool]:
    """The next state, and whether a pre-token starts at this character."""
    if kind == RESET:
        return START, True
    if state == TWO_LEFT:
        return ONE_LEFT, False
    if state == ONE_LEFT:
        return START, False
    if kind in (LETTER, NUMBER, OTHER):
        return (IN_LETTER, IN_NUMBER, IN_OTHER)[kind], not (state == JOIN or state == (IN_LETTER, IN_NUMBER, IN_OTHER)[kind])
    if kind in (SHORT, LONG):
        if state in (JOIN, IN_OTHER):
            return IN_OTHER, False
        return (ONE_LEFT if kind == SHORT else TWO_LEFT), True
    if kind == SPACE_JOIN:
        return JOIN, True
    if kind == SPACE_LAST:
        return START, True
    return IN_RUN, state != IN_RUN


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The function number of each class, the multiplication table, the image of START by each function, and the starts by state and class."""
    by_class = [tuple(_step(s, k)[0] for s in range(8)) for k in range(9)]
    known = {f: i for i, f in enumerate(dict.fromkeys([tuple(range(8)), *by_class]))}
    todo = list(known)
    while todo:
        f = todo.pop()
        for g in by_class:
            h = tuple(g[s] for s in f)
            if h not in known:
                known[h] = len(known)
                todo.append(h)
    functions = list(known)
    product = np.array([[known[tuple(g[s] for s in f)] for g in functions] for f in functions], np.uint16)
    first = np.array([f[START] for f in functions], np.uint8)
    begins = np.array([[_step(s, k)[1] for k in range(9)] for s in range(8)])
    return np.array([known[f] for f in by_class], np.uint16), product, first, begins


@lru_cache(1)
def code_point_classes() -> np.ndarray:
    """LETTER, NUMBER, SPACE_RUN (any white space) or OTHER for every code point."""
    import regex

    table = np.full(0x110000, OTHER, np.uint8)
    patterns = [(kind, regex.compile(p)) for kind, p in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE_RUN, r"\p{White_Space}+"))]
    for low in range(0, 0x110000, 0x800):
        if not 0xD800 <= low < 0xE000:
            text = "".join(map(chr, range(low, low + 0x800)))
            for kind, pattern in patterns:
                for m in pattern.finditer(text):
                    table[low + m.start() : low + m.end()] = kind
    return table


def boundaries(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where pre-tokens start. codes: code points of joined non-empty texts; starts: where each text starts in them."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    base = code_point_classes()[codes]
    first = np.zeros(n, bool)
    first[starts] = True
    nxt = np.zeros(n + 2, np.uint32)  # code points that follow in the same text, else 0
    nxt[:n] = codes

    white = base == SPACE_RUN
    follows = np.zeros(n, bool)  # is there a non-space right after, in the same text
    follows[:-1] = ~white[1:] & ~first[1:]
    kind = base.copy()
    last = white & follows
    kind[last] = SPACE_LAST
    kind[last & (codes == 32)] = SPACE_JOIN

    quote = np.flatnonzero(codes == 39)
    if len(quote):
        ends = np.append(starts[1:], n)[np.searchsorted(starts, quote, "right") - 1]
        a = np.where(quote + 1 < ends, nxt[quote + 1], 0)
        b = np.where(quote + 2 < ends, nxt[np.minimum(quote + 2, n)], 0)
        kind[quote[np.isin(a, [ord(c) for c in "stmd"])]] = SHORT
        pair = np.zeros(len(quote), bool)
        for x, y in ("re", "ve", "ll"):
            pair |= (a == ord(x)) & (b == ord(y))
        kind[quote[pair]] = LONG

    of_class, product, image, begins = _tables()
    width = len(product)
    flat = product.ravel()
    own = of_class[kind].astype(np.intp)
    # A text's first character forgets the state before it: reset, then its own function.
    own[starts] = product[of_class[RESET], own[starts]]
    blocks = -(-n // BLOCK)
    grid = np.zeros(blocks * BLOCK, np.intp)  # 0 is the identity
    grid[:n] = own
    grid = np.ascontiguousarray(grid.reshape(blocks, BLOCK).T)
    scan = np.empty((BLOCK, blocks), np.uint16)  # product of the characters before, inside the block
    acc = np.zeros(blocks, np.intp)
    for k in range(BLOCK):
        scan[k] = acc
        acc = flat[acc * width + grid[k]].astype(np.intp)
    step = 1
    while step < blocks:  # scan of the blocks' products
        acc[step:] = flat[acc[:-step] * width + acc[step:]]
        step *= 2
    carry = np.zeros(blocks, np.intp)
    carry[1:] = acc[:-1]
    whole = flat[carry[None, :] * width + scan]
    state = image[whole].T.ravel()[:n]
    state[starts] = START
    begin = begins[state, kind]
    begin[starts] = True
    return np.flatnonzero(begin)


def pretokens(texts: list[str]) -> list[list[bytes]]:
    """UTF-8 slices of each text's pre-tokens, in order."""
    out: list[list[bytes]] = []
    group: list[str] = []
    size = 0
    for t in texts:
        if group and size + len(t) > GROUP:
            out += _group(group)
            group, size = [], 0
        group.append(t)
        size += len(t)
    return out + _group(group)


def _group(texts: list[str]) -> list[list[bytes]]:
    full = [t for t in texts if t]
    if not full:
        return [[] for _ in texts]
    joined = "".join(full)
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    starts = np.zeros(len(full), np.int64)
    np.cumsum([len(t) for t in full[:-1]], out=starts[1:])
    at = boundaries(codes, starts)
    raw = joined.encode()
    if len(raw) == len(codes):
        places = at
    else:
        width = 1 + (codes > 0x7F).astype(np.uint8) + (codes > 0x7FF) + (codes > 0xFFFF)
        offset = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(width, out=offset[1:])
        places = offset[at]
    cut = places.tolist()
    cut.append(len(raw))
    pieces = [raw[a:b] for a, b in zip(cut, cut[1:], strict=False)]
    edge = iter(np.append(np.searchsorted(at, starts), len(pieces)).tolist())
    low = next(edge)
    out = []
    for t in texts:
        if t:
            high = next(edge)
            out.append(pieces[low:high])
            low = high
        else:
            out.append([])
    return out
