"""Suffix arrays of integer sequences, and common prefixes by backward extension on the Burrows-Wheeler transform."""

from __future__ import annotations

import numpy as np


def packed_keys(symbols: np.ndarray) -> tuple[np.ndarray, int, int]:
    """(for each place its next symbols in one number, how many those are, bits of each), symbols numbered by order."""
    present = np.zeros(int(symbols.max()) + 1, bool)
    present[symbols] = True
    dense = (np.cumsum(present) - 1)[symbols].astype(np.uint64)
    n, width = len(symbols), max(1, int(present.sum() - 1).bit_length())
    reach = 63 // width
    wide = np.concatenate([dense, np.zeros(reach, np.uint64)])
    key = np.zeros(n, np.uint64)
    for k in range(reach):
        key = (key << np.uint64(width)) | wide[k : k + n]
    return key, reach, width


def suffix_array(symbols: np.ndarray, least: int | None = None, packed: tuple[np.ndarray, int, int] | None = None) -> np.ndarray:
    """By prefix doubling, starting from packed symbols; only suffixes that are still tied are sorted again.

    The last symbol is a 0 that stands nowhere else. least: suffixes that share so many symbols may stay in any order,
    which permutes within the intervals of all strings of at most so many symbols and so moves no interval."""
    n = len(symbols)
    key, reach, _ = packed or packed_keys(symbols)
    order = np.argsort(key)
    ranks = np.zeros(n, np.int64)

    def ranked(order: np.ndarray, key: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Marks where a new group begins; a suffix's rank is the place of its group's begin."""
        new = np.append(True, key[1:] != key[:-1])
        ranks[order] = first[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        return new

    new = ranked(order, key[order], np.arange(n))
    at = np.arange(n)
    while least is None or reach < least:
        tied = ~(new & np.append(new[1:], True))
        at = at[tied]
        if not len(at):
            break
        mine = order[at]
        after = mine + reach
        second = np.where(after < n, ranks[np.minimum(after, n - 1)] + 1, 0)
        pair = ranks[mine] * (n + 1) + second
        by = np.argsort(pair)
        order[at] = mine[by]
        new = ranked(order[at], pair[by], at)
        reach *= 2
    return order


def short_prefixes(symbols: np.ndarray, order: np.ndarray, least: int, lowest: int, packed: tuple[np.ndarray, int, int] | None = None) -> np.ndarray:
    """For each place in the suffix array, whether it shares under `least` symbols with the place before.

    Breadth first: the intervals of all strings of one length are extended to the left by each symbol that precedes
    them; an interval whose right end was not bounded before bounds it, at this length, and lives on. So common
    prefixes come by increasing value, and the search stops at `least`. It starts from the strings that fit in one
    packed key, whose intervals the keys give. Symbols under `lowest` (separators) end a string: they are never
    extended by."""
    n = len(symbols)
    before = symbols[order - 1]
    step = np.empty(n, np.int64)
    step[np.argsort(before, kind="stable")] = np.arange(n)
    key, reach, width = packed or packed_keys(symbols)
    drop = max(0, reach - least)
    key, reach = (key >> np.uint64(width * drop))[order], reach - drop
    bounded = np.ones(n + 1, bool)
    bounded[1:n] = key[1:] != key[:-1]
    low = np.flatnonzero(bounded)[:-1]
    high = np.append(low[1:], n)
    # Strings of one symbol fewer that end there too did so before; what holds a separator is not extended.
    longer = key >> np.uint64(width)
    fresh = longer[high - 1] == np.append(longer, ~np.uint64(0))[high]
    if reach == 1:
        fresh[:] = True
    parted = np.append(0, np.cumsum(symbols < lowest))
    fresh &= parted[np.minimum(order[low] + reach, n)] == parted[order[low]]
    low, high = low[fresh], high[fresh]
    for _ in range(reach, least):
        if not len(low):
            break
        sizes = high - low
        which = np.repeat(np.arange(len(low)), sizes)
        places = np.arange(len(which)) + np.repeat(low - np.append(0, np.cumsum(sizes)[:-1]), sizes)
        symbol = before[places]
        live = np.flatnonzero(symbol >= lowest)
        live = live[np.argsort(symbol[live], kind="stable")]
        if not len(live):
            break
        to, symbol, which = step[places[live]], symbol[live], which[live]
        begin = np.flatnonzero(np.append(True, (symbol[1:] != symbol[:-1]) | (which[1:] != which[:-1])))
        low, high = to[begin], to[np.append(begin[1:], len(to)) - 1] + 1
        fresh = ~bounded[high]
        low, high = low[fresh], high[fresh]
        bounded[high] = True
    return bounded[:n]


def shared_groups(symbols: np.ndarray, least: int, lowest: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(order, group of each place): places whose suffixes share their first `least` symbols have one group.

    Groups are right for suffixes that hold no separator in so many symbols."""
    packed = packed_keys(symbols)
    order = suffix_array(symbols, least, packed)
    return order, np.cumsum(short_prefixes(symbols, order, least, lowest, packed)) - 1
