"""Hashed word and character n-gram features of whole texts, computed in numpy over batches.

A text's features are its words (runs without ASCII white space), the 3- and 4-grams of code points within
words, a word's begin and end counting as one mark each, for each word whether it follows itself, and with ``pairs``
each word with the one before it. Each is hashed to one of ``2**bits`` buckets. A linear score of the mean feature
vector is a mean of one number per bucket, so scoring gathers from a table and sums over each text.

Texts longer than ``WINDOW`` code points pass through in windows, so memory doesn't grow with a text. A
window hands the next one its last code points and its open word, so a text of any length has exactly the
features it would have in one piece. A text's sums are taken over its own windows alone: they don't depend
on what else is in the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WINDOW = 1 << 18
_ODD = np.uint64(0x9E3779B97F4A7C15)
_P = 0x100000001B3
_MASK = (1 << 64) - 1
#: White space in a window and between texts; n-grams see one kind of it.
_SPACE = 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    if getattr(powers, "size", 0) < n:
        inverse = pow(_P, -1, 1 << 64)
        with np.errstate(over="ignore"):
            up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _P, np.uint64)]))
            down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, inverse, np.uint64)]))
        powers.size, powers.tables = n, (up, down)
    return powers.tables


def _points(text: bytes) -> np.ndarray:
    """Code points, white space being one of them."""
    out = np.frombuffer(text, np.uint8).astype(np.uint32) if text.isascii() else np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
    out[(out >= 9) & (out <= 13)] = _SPACE
    return out


class _Open:
    """What a window hands to the next of its text."""

    __slots__ = ("before", "hash", "size", "tail")

    def __init__(self):
        self.tail = np.array([_SPACE], np.uint32)  # the last code points, at most three; a text begins as after a space
        self.hash, self.size = 0, 0  # of the word that reached the window's end
        self.before = -1  # the bucket of the word before it


def _grams(raw: np.ndarray, n: int, shift: np.uint64, none: int) -> np.ndarray:
    """By begin, the bucket of each n-gram of ``raw``; ``none`` where white space is within it."""
    m = max(0, len(raw) - n + 1)
    if not m:
        return np.zeros(0, np.intp)
    space = raw == _SPACE
    out = raw[:m].astype(np.uint64)
    inside = np.zeros(m, bool)
    with np.errstate(over="ignore"):
        for k in range(1, n):
            out = (out * np.uint64(_P)) ^ (raw[k : k + m].astype(np.uint64) + np.uint64(n))
            if k < n - 1:
                inside |= space[k : k + m]
        found = ((((out ^ (out >> np.uint64(29))) * _ODD)) >> shift).astype(np.intp)
    found[inside] = none
    return found


def _words(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, shift: np.uint64, opened: list[_Open], last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the words that end in each piece [begin, end), and the pieces' borders in them.

    A word open at a piece's begin is continued; one that reaches its end is handed on, unless the piece is
    the text's last.
    """
    inner = np.zeros(len(raw) + 1, bool)
    inner[:-1] = raw != _SPACE
    edge = np.flatnonzero(inner[1:] != inner[:-1]) + 1
    if inner[0]:
        edge = np.concatenate([[0], edge])
    first, stop = edge[::2], edge[1::2]
    up, down = powers(max(2 * WINDOW, len(raw)))
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)])])
        name = (total[stop] - total[first]) * down[first]
    at, to = np.searchsorted(first, begin), np.searchsorted(first, end)
    keep = np.ones(len(name), bool)
    extra: list[tuple[int, int]] = []  # words ended by the white space that their next window begins with
    for k, o in enumerate(opened):
        a, b = int(at[k]), int(to[k])
        if o.size:
            if b > a and first[a] == begin[k]:
                name[a] = np.uint64((o.hash + pow(_P, o.size, 1 << 64) * int(name[a])) & _MASK)
            elif end[k] > begin[k] or last[k]:
                extra.append((k, o.hash))
            else:
                continue
        long = o.size
        o.hash = o.size = 0
        if not last[k] and b > a and stop[b - 1] == end[k]:
            o.hash, o.size = int(name[b - 1]), int(stop[b - 1] - first[b - 1]) + (long if b - 1 == a and first[a] == begin[k] else 0)
            keep[b - 1] = False
    if extra:
        places = np.array([at[k] for k, _ in extra])
        name, keep = np.insert(name, places, [np.uint64(h) for _, h in extra]), np.insert(keep, places, True)
        more = np.zeros(len(begin), np.int64)
        more[[k for k, _ in extra]] = 1
        before = np.cumsum(more) - more
        at, to = at + before, to + before + more
    kept = np.concatenate([[0], np.cumsum(keep)])
    with np.errstate(over="ignore"):
        word = (((name[keep] ^ (name[keep] >> np.uint64(29))) * _ODD) >> shift).astype(np.intp)
    return word, kept[at], kept[to]


def _packs(texts: list[bytes]) -> Iterator[tuple[list[int], list[np.ndarray], list[bool]]]:
    """Texts, in windows, gathered to about a window; whose each window is and whether it is the text's last."""
    who, some, last, size = [], [], [], 0
    for i, t in enumerate(texts):
        raw = _points(t)
        for at in range(0, max(1, len(raw)), WINDOW):
            part = raw[at : at + WINDOW]
            if some and (size + len(part) > WINDOW or who[-1] == i):
                yield who, some, last
                who, some, last, size = [], [], [], 0
            who.append(i)
            some.append(part)
            last.append(at + WINDOW >= len(raw))
            size += len(part) + 4
    if some:
        yield who, some, last


def features(texts: list[bytes], bits: int, pairs: bool = False) -> Iterator[tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]]:
    """For each pack: whose its windows are, and for each kind of feature the buckets and the borders of each window in them.

    Bucket ``2**bits`` stands for no feature.
    """
    shift, none = np.uint64(64 - bits), 1 << bits
    held: dict[int, _Open] = {}
    for who, some, last in _packs(texts):
        opened = [held.pop(i, None) or _Open() for i in who]
        ends = np.array(last)
        # each window stands after the code points before it, and a last one before a space
        parts, begin, end, at = [], [], [], 0
        for o, part, closed in zip(opened, some, last, strict=True):
            parts += [o.tail, part]
            begin.append(at + len(o.tail))
            end.append(begin[-1] + len(part))
            at = end[-1]
            if closed:
                parts.append(np.array([_SPACE], np.uint32))
                at += 1
        raw, begin, end = np.concatenate(parts), np.array(begin), np.array(end)
        lead = begin - np.array([len(o.tail) for o in opened])
        kinds = []
        for n in (4, 3):
            # n-grams that end in the window (its closing space included) and haven't been seen in the one before it
            stop = np.maximum(end + ends - n + 1, 0)
            kinds.append((_grams(raw, n, shift, none), np.minimum(np.maximum(begin - n + 1, lead), stop), stop))
        spaced = raw
        if any(len(o.tail) > 1 for o in opened):  # words begin in the window, or were open before it
            spaced = raw.copy()
            for o, b in zip(opened, begin, strict=True):
                spaced[b - len(o.tail) : b] = _SPACE
        word, a, b = _words(spaced, begin, end, shift, opened, ends)
        kinds.append((word, a, b))
        before = np.concatenate([[-1], word[:-1]])[: len(word)]
        for k, o in enumerate(opened):
            if b[k] > a[k]:
                before[a[k]] = o.before
                o.before = int(word[b[k] - 1])
        kinds.append((np.where(before == word, np.intp(1), np.intp(2)), a, b))
        if pairs:
            both = (before.astype(np.uint64) << np.uint64(32)) | word.astype(np.uint64)
            with np.errstate(over="ignore"):
                found = (((both ^ (both >> np.uint64(29))) * _ODD) >> shift).astype(np.intp)
            kinds.append((np.where(before < 0, none, found), a, b))
        for k, (i, o) in enumerate(zip(who, opened, strict=True)):
            if not last[k]:
                o.tail = np.concatenate([o.tail, some[k]])[-3:]
                held[i] = o
        yield np.array(who), kinds


def _sums(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over [begin, end), each from its own values alone."""
    out = np.zeros(len(begin))
    full = np.flatnonzero(end > begin)
    if len(full):
        # between the parts asked for are others, that are summed and left out; the last one ends at the end
        cuts = np.stack([begin[full], end[full]], 1).ravel()
        out[full] = np.add.reduceat(np.append(values, 0.0), cuts)[::2]
    return out


def mean_scores(texts: list[bytes], table: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """``table`` (buckets x k) -> for each text the mean row over its features (n x k), and their number."""
    size = len(table)
    columns = [np.append(table[:, k], 0.0) for k in range(table.shape[1])]
    sums, count = np.zeros((len(texts), len(columns))), np.zeros(len(texts), np.int64)
    for who, kinds in features(texts, int(size).bit_length() - 1, pairs):
        for buckets, begin, end in kinds:
            real = np.concatenate([[0], np.cumsum(buckets < size)])
            count[who] += real[end] - real[begin]
            for k, column in enumerate(columns):
                sums[who, k] += _sums(column[buckets], begin, end)
    return sums / np.maximum(count, 1)[:, None], count


def sparse(text: bytes, bits: int, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of one whole text and the share of its features that each holds."""
    total = np.zeros((1 << bits) + 1)
    for _, kinds in features([text], bits, pairs):
        for buckets, begin, end in kinds:
            for b, e in zip(begin, end, strict=True):
                total += np.bincount(buckets[b:e], minlength=len(total))
    total = total[:-1]
    at = np.flatnonzero(total)
    return at, total[at] / max(1.0, total.sum())
