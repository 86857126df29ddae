"""Fuzzy line dedup: one occurrence of each group of like lines stays.

Lines are normalised (lower case, digits as zero, runs of other than letters and
digits as one space).  Two normalised lines are linked when their edit similarity
reaches ``similarity``; equal ones are one line.  Pairs to compare come from similarity
sketches (as MinHash) over the letters' runs of ``GRAM`` bytes, one for each of ``PARTS``
parts of a line: a like line is like in all of them, while lines that only share a long
passage differ in some.  Lines that agree by chance are told by the rest of their sketches, before
texts are read.  The edit similarity alone decides.  Connected lines are a group, of which the
occurrence in the document with the smallest id, there the first, stays.
"""

from __future__ import annotations

import functools
import itertools
import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.llm import common, pigeonhole
from sensorloom.session import cut, shuffles_removed

# Words a line must have to be compared, bits of SimHash that may differ (all: it decides nothing), least edit similarity.
WORDS, BITS, SIMILARITY = 5, 64, 0.8
# Letters of scripts without spaces between words that stand for the words.
LETTERS = 20
# Bytes of a feature, at most eight; bands of a line, and parts of it whose sketches give one bin each to a band.
GRAM, BANDS, PARTS = 7, 44, 3
# Bins of eight bits in a number of a short sketch, numbers of it, and bins that must agree.  Unlike lines that
# meet by chance agree in some six of all bins, alike ones of check_s in 41 or more.
BINS, SHORT, AGREEING = 7, 18, 11
# Rows with short sketches that a part of a search may have: so many for each line, and in any case.
ROWS_A_LINE, PART_ROWS = 0.5, 1 << 20
# Links of groups that one task connects.
LINKS = 1 << 17
# Grams that are sketched at once, small enough for a core's cache.
SKETCHED = 1 << 15
# Least ratio of lengths from class to class, and bits of a line's number beside the class's five.
RATIO, NUMBER_BITS = 1.25, 35
# Pairs compared at once, and fewer of them that are compared one by one.
PAIRS, SIDE_BY_SIDE = 512, 24
# Rows by which the window of a single comparison moves.
TRIED = 128
KEPT_WORDS = 1 << 18
RUN_BYTES = 1 << 21
# Lines a task remembers, to name the buckets of a repeated one once.
KNOWN_LINES = 1 << 19
# Odd base of the words' numbers, and the lowest bit of each byte.
BASE, EACH_BYTE = 0x9E3779B97F4A7C15, np.uint64(0x0101010101010101)

FIND = re.compile(r"[^\W_]+").findall
DIGITS = str.maketrans("0123456789", "0000000000")
# The same for bytes, all at once, where only ASCII letters part words.
PLAIN = bytes(
    b if b >= 128 or b == 10 or chr(b).isalpha() else 48 if chr(b).isdigit() else 32 for b in range(256)
)
OTHER = re.compile(r"[^\x00-\x7f\w]").search


def normalised(line: str) -> list[bytes]:
    """Words of the normalised line."""
    return [word.encode("utf-8", "surrogatepass") for word in FIND(line.lower().translate(DIGITS))]


def normal_bytes(text: str) -> bytes:
    """The text's words apart by spaces, lines apart by newlines; there may be more spaces."""
    lower = text.lower()
    if lower.isascii() or not OTHER(lower):
        return lower.encode("utf-8", "surrogatepass").translate(PLAIN)
    return b"\n".join(b" ".join(normalised(line)) for line in text.split("\n"))


def split_lines(text: str) -> list[list[bytes]]:
    """Words of each line of a text."""
    return [line.split() for line in normal_bytes(text).split(b"\n")]


def key(line: bytes) -> bytes:
    return xxhash.xxh3_128_digest(line)


def unspaced(chars: np.ndarray) -> np.ndarray:
    """First bytes of letters of scripts without spaces: Han, kana, Thai, Lao, Tibetan, Myanmar, Khmer."""
    after = np.append(chars[1:], np.uint8(0))
    return (
        (chars >= 0xE3) & (chars <= 0xE9) | (chars == 0xE0) & (after >= 0xB8)
        | (chars == 0xE1) & ((after >= 0x80) & (after <= 0x82) | (after == 0x9E) | (after == 0x9F))
        | (chars == 0xF0) & (after >= 0xA0) & (after <= 0xB3)
    )


class Lines:
    """Lines with a number of words, or of unspaced letters, at least, of one buffer of normalised texts.

    ``at`` are their places among the buffer's lines, ``lines`` their bytes with one
    space between words.  Words are spans ``begin, end`` of ``chars``; line i has
    ``counts[i]`` words from number ``first[i]`` on.
    """

    def __init__(self, buffer: bytes, words: int):
        raw = np.frombuffer(b"\n" + buffer + b"\n", dtype=np.uint8)
        letter = raw > 32
        # A space stays only before a word.
        stay = letter | (raw == 10)
        stay[:-1] |= letter[1:]
        self.chars = chars = raw[stay]
        letter = chars > 32
        self.begin = np.flatnonzero(letter[1:] > letter[:-1]) + 1
        breaks = np.flatnonzero(chars == 10)
        border = np.searchsorted(self.begin, breaks)
        counts = np.diff(border)
        enough = counts >= words
        if len(chars) and chars.max() >= 0xE0:
            enough |= np.diff(np.searchsorted(np.flatnonzero(unspaced(chars)), breaks)) >= LETTERS
        self.at = np.flatnonzero(enough)
        self.first, self.counts = border[:-1][self.at], counts[self.at]
        data = chars.tobytes()
        self.stops = breaks[1:][self.at]
        self.starts = self.begin[self.first] if words else breaks[:-1][self.at] + 1
        self.lines = [data[lo:hi] for lo, hi in zip(self.starts.tolist(), self.stops.tolist(), strict=True)]

    @functools.cached_property
    def end(self) -> np.ndarray:
        letter = self.chars > 32
        return np.flatnonzero(letter[1:] < letter[:-1]) + 1


class Hashes:
    """SimHash of lines over the 64-bit hashes of their words, kept from line to line."""

    def __init__(self):
        self.powers = np.zeros((2, 0), dtype="<u8")
        self.forget()

    def forget(self) -> None:
        # Numbers of known words in order, and their hashes.
        self.spans, self.hashes = np.zeros(0, dtype="<u8"), np.zeros(0, dtype="<u8")

    def _numbers(self, lines: Lines) -> np.ndarray:
        """A number for each word from its bytes: a polynomial in an odd base, modulo 2 ** 64."""
        size = len(lines.chars)
        if self.powers.shape[1] < size:
            self.powers = np.array([np.full(2 * size, x, dtype="<u8") for x in (BASE, pow(BASE, -1, 1 << 64))])
            self.powers[:, 0] = 1
            np.multiply.accumulate(self.powers, axis=1, out=self.powers)
        sums = np.cumsum(lines.chars * self.powers[0, :size], dtype="<u8")
        return (sums[lines.end - 1] - sums[lines.begin - 1]) * self.powers[1, lines.begin]

    def _words(self, lines: Lines) -> tuple[np.ndarray, np.ndarray]:
        """Number of each word among the different ones, and the hashes of these."""
        spans = self._numbers(lines)
        order = np.argsort(spans)
        spans = spans[order]
        new = np.ones(len(spans), dtype=bool)
        new[1:] = spans[1:] != spans[:-1]
        number = np.empty(len(spans), dtype=np.int64)
        number[order] = np.cumsum(new) - 1
        different, some = spans[new], order[new]
        if len(self.spans) > KEPT_WORDS:
            self.forget()
        place = np.searchsorted(self.spans, different)
        missing = np.append(self.spans, np.uint64(0))[place] != different
        missing |= place == len(self.spans)
        if missing.any():
            data, words = lines.chars.tobytes(), some[missing]
            ends = zip(lines.begin[words].tolist(), lines.end[words].tolist(), strict=True)
            found = np.array([xxhash.xxh64_intdigest(data[lo:hi], 42) for lo, hi in ends], dtype="<u8")
            self.spans = np.insert(self.spans, place[missing], different[missing])
            self.hashes = np.insert(self.hashes, place[missing], found)
            place = np.searchsorted(self.spans, different)
        return number, self.hashes[place]

    def of(self, lines: Lines) -> np.ndarray:
        """SimHash of each line, which has a word at least, as signed numbers.

        A bit is set if over half of the line's different words have it; repeats
        do not count, else a few frequent words would make unlike lines alike.
        """
        if not len(lines.at):
            return np.zeros(0, dtype=np.int64)
        number, hashes = self._words(lines)
        owner = np.repeat(np.arange(len(lines.at)), lines.counts)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(lines.counts) - lines.counts, lines.counts)
        pairs = np.sort(owner << 32 | number[lines.first[owner] + within])
        pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])]
        lengths = np.bincount(pairs >> 32, minlength=len(lines.at))
        hashes = hashes[pairs & 0xFFFFFFFF]
        # Steps of at most 255 words that end with their line; a byte counts a bit within a step.
        steps = -(-lengths // 255)
        first = np.cumsum(steps) - steps
        within = np.arange(steps.sum()) - np.repeat(first, steps)
        starts = np.repeat(np.cumsum(lengths) - lengths, steps) + 255 * within
        sums = np.stack([np.add.reduceat(hashes >> np.uint64(i) & EACH_BYTE, starts) for i in range(8)], axis=1)
        # From (bit in byte, byte) to the order of bits.
        sums = sums.view(np.uint8).reshape(-1, 8, 8).transpose(0, 2, 1).reshape(-1, 64)
        sums = np.add.reduceat(sums, first, axis=0, dtype=np.int64)
        return np.packbits(2 * sums > lengths[:, None], axis=1, bitorder="little").view("<i8")[:, 0]

    def prints(self, lines: list[list[bytes]]) -> np.ndarray:
        """SimHash of lines given as words."""
        return self.of(Lines(b"\n".join(map(b" ".join, lines)), 1))


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers, scattered."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
    return x ^ x >> np.uint64(31)


def mixed_half(x: np.ndarray) -> np.ndarray:
    """32-bit numbers, scattered (the last step of MurmurHash3), in place."""
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        x ^= x >> np.uint32(shift)
        x *= np.uint32(factor)
    x ^= x >> np.uint32(16)
    return x


def sketch(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bins, ``BANDS`` for each, of parts of lines that have ``counts`` of the ``grams``, one after the other.

    Fast similarity sketching (Dahlgaard, Knudsen, Thorup 2017): in each round every gram
    throws a hash into one of the bins, which keeps its least; only bins still empty
    take part in the next.  Two parts agree in a bin with the chance of their Jaccard
    similarity, as in MinHash, for a few hashes a gram instead of one for each bin.
    """
    bins, parts, empty = BANDS, np.arange(len(counts)), np.uint32((1 << 32) - 1)
    least = np.full((len(counts), bins), empty)
    flat = least.ravel()
    # The last rounds fill one bin each, so none stays empty.
    for turn in range(2 * bins):
        stops = np.cumsum(counts)
        unfilled = np.empty(len(parts), dtype=bool)
        for lo, hi in itertools.pairwise([0, *(np.flatnonzero(np.diff(stops // SKETCHED)) + 1).tolist(), len(parts)]):
            hashes = mixed_half(grams[stops[lo] - counts[lo] : stops[hi - 1]] + np.uint32((turn + 1) * BASE & (1 << 32) - 1))
            at = np.repeat(parts[lo:hi] * bins, counts[lo:hi])
            at += (hashes >> np.uint32(16)) * np.uint32(bins) >> np.uint32(16) if turn < bins else turn - bins
            if turn:
                free = np.flatnonzero(flat[at] == empty)
                at, hashes = at[free], hashes[free]
            np.minimum.at(flat, at, hashes)
            unfilled[lo:hi] = (least[parts[lo:hi]] == empty).any(axis=1)
        if not unfilled.any():
            break
        grams = grams[np.repeat(unfilled, counts)]
        parts, counts = parts[unfilled], counts[unfilled]
    return least


def sketches(lines: Lines, wanted: np.ndarray) -> np.ndarray:
    """Sketches of the parts of the ``wanted`` lines, ``PARTS`` rows of ``BANDS`` bins for each."""
    if not len(wanted):
        return np.empty((0, BANDS), dtype="<u4")
    size = len(lines.chars)
    padded = np.append(lines.chars, np.zeros(16, dtype=np.uint8))
    # Eight bytes from each place on, of which the first GRAM count.
    grams = np.empty(-(-size // 8) * 8, dtype="<u8")
    for k in range(8):
        grams[k::8] = padded[k : k + len(grams)].view("<u8")
    grams <<= np.uint64(64 - 8 * GRAM)
    grams *= np.uint64(BASE)
    grams = (grams >> np.uint64(32)).astype("<u4")
    # A line shorter than a gram is one gram with what follows it.
    starts = lines.starts[wanted]
    counts = np.maximum(starts + 1, lines.stops[wanted] - GRAM + 1) - starts
    # Parts of equal length; of a line with fewer grams some have the same one.
    edges = counts[:, None] * np.arange(PARTS + 1) // PARTS
    first = np.minimum(edges[:, :-1], counts[:, None] - 1)
    counts = (np.maximum(edges[:, 1:], first + 1) - first).ravel()
    starts = (starts[:, None] + first).ravel()
    grams = grams[np.arange(counts.sum()) + np.repeat(starts - np.cumsum(counts) + counts, counts)]
    # The hashes of a part depend on its place, else a frequent gram would win the same bin of several parts.
    grams ^= np.repeat(np.tile(mixed(np.arange(1, PARTS + 1, dtype="<u8")).astype("<u4"), len(wanted)), counts)
    return sketch(grams, counts)


def bands(lines: Lines, wanted: np.ndarray) -> np.ndarray:
    """Names of the buckets of the ``wanted`` lines: ``BANDS`` numbers for each, of one bin of each part's sketch."""
    if not len(wanted):
        return np.empty((0, BANDS), dtype="<u8")
    bins = sketches(lines, wanted)
    names = np.arange(1, BANDS + 1, dtype="<u8")
    for part in range(PARTS):
        names = mixed(names * np.uint64(BASE) + bins[part::PARTS])
    return names


def short_sketches(lines: Lines, wanted: np.ndarray) -> np.ndarray:
    """``SHORT`` numbers for each of the ``wanted`` lines: eight bits of each of as many bins of every part."""
    bins = sketches(lines, wanted)[:, : SHORT * BINS // PARTS] & np.uint32(255)
    bins = bins.reshape(-1, SHORT, BINS).astype("<i8")
    return np.bitwise_or.reduce(bins << 9 * np.arange(BINS), axis=2)


def agree(one: list[Column], two: list[Column]) -> Column:
    """Whether short sketches have enough bins in common."""
    # Where bins differ, the sum has the bit above them.
    each, above = (sum(x << 9 * i for i in range(BINS)) for x in (255, 256))
    differing = [F.bit_count((x.bitwiseXOR(y) + F.lit(each)).bitwiseAND(F.lit(above))) for x, y in zip(one, two, strict=True)]
    return functools.reduce(lambda x, y: x + y, differing) <= SHORT * BINS - AGREEING


def letters(lines: Lines) -> np.ndarray:
    """Code points of each line."""
    # Bytes but the first of a letter.
    others = np.flatnonzero(lines.chars & 0xC0 == 0x80)
    return lines.stops - lines.starts - np.searchsorted(others, lines.stops) + np.searchsorted(others, lines.starts)


def numbers(keys: list[bytes], sizes: np.ndarray, similarity: float) -> np.ndarray:
    """Line numbers: the class of the length, then bits of the key.

    Lines whose lengths allow the similarity are in the same class or in adjacent ones.
    """
    ratio = max(RATIO, 1 / max(similarity, 0.01))
    classes = np.minimum(np.log(np.maximum(sizes, 1)) / np.log(ratio), 31).astype(np.int64)
    bits = np.frombuffer(b"".join(k[:8] for k in keys), dtype="<i8") & ((1 << NUMBER_BITS) - 1)
    return classes << NUMBER_BITS | bits


def runs(texts: list[str], words: int):
    """``(owners, places, lines)`` for runs of texts that have some 2 MB together.

    A text stays in one run, whose arrays are a few times its size.
    """
    start = 0
    while start < len(texts):
        parts, size = [], 0
        while start + len(parts) < len(texts) and size < RUN_BYTES:
            parts.append(normal_bytes(texts[start + len(parts)]))
            size += len(parts[-1])
        lines = Lines(b"\n".join(parts), words)
        heights = np.array([part.count(b"\n") + 1 for part in parts])
        tops = np.cumsum(heights) - heights
        owners = np.searchsorted(tops, lines.at, side="right") - 1
        yield start + owners, (lines.at - tops[owners]).astype(np.int32), lines
        start += len(parts)


def common_length(a: str, b: str) -> int:
    """Length of the common beginning."""
    lo, size, most = 0, 8, min(len(a), len(b))
    while lo < most and a[lo : lo + size] == b[lo : lo + size]:
        lo, size = lo + size, 2 * size
    if lo >= most:
        return most
    while size > 1:
        size //= 2
        if a[lo : lo + size] == b[lo : lo + size]:
            lo += size
    return min(lo, most)


def common_end(a: str, b: str) -> int:
    """Length of the common end."""
    size = 32
    while size < min(len(a), len(b)) and a[-size:] == b[-size:]:
        size *= 4
    return common_length(a[: -size - 1 : -1], b[: -size - 1 : -1])


def edit_distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance, or some number above ``most`` where it is larger.

    One column of the table is two bit vectors (Myers 1999, Hyyro 2003), of the rows that may
    lie on a way to the end in at most ``most`` steps; a long pair tries fewer steps first.
    """
    head = common_length(a, b)
    a, b = a[head:], b[head:]
    tail = common_end(a, b)
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if len(a) < len(b):
        a, b = b, a
    if not b or len(a) - len(b) > most:
        return len(a)
    if most > 4 * TRIED and len(a) - len(b) <= most // 4 and (found := edit_distance(a, b, most // 4)) <= most // 4:
        return found
    size, aside = len(b), (most + len(a) - len(b)) // 2
    # Rows base to base + width; the window moves with the diagonal.
    width = min(size, 2 * aside + TRIED)
    full, top = (1 << width) - 1, 1 << (width - 1)
    places: dict[str, int] = {}
    for i, letter in enumerate(b):
        places[letter] = places.get(letter, 0) | 1 << i
    base, near, up, down, score = 0, places, full, 0, width
    for i, letter in enumerate(a):
        if i - aside - base >= TRIED and base + width < size:
            step = min(TRIED, size - base - width)
            base, score = base + step, score + step
            up, down, near = up >> step | full ^ full >> step, down >> step, {}
        match = near.get(letter)
        if match is None:
            match = near[letter] = places.get(letter, 0) >> base & full
        diagonal = ((((match & up) + up) ^ up) | match | down) & full
        raised = down | ~(diagonal | up) & full
        lowered = up & diagonal
        if raised & top:
            score += 1
        elif lowered & top:
            score -= 1
        # Rows below the window and letters ahead may at best all match.
        if score - max(size - base - width, 0) - (len(a) - i - 1) > most:
            return most + 1
        raised = (raised << 1 | 1) & full
        up = (lowered << 1 | ~(diagonal | raised)) & full
        down = raised & diagonal
    return score


def alike(a: str, b: str, similarity: float) -> bool:
    """Whether one minus the distance over the longer length reaches ``similarity``."""
    longest = max(len(a), len(b))
    most = int((1.0 - similarity) * longest + 1e-9)
    return edit_distance(a, b, most) <= most


def close(a: list[str], b: list[str], most: np.ndarray) -> np.ndarray:
    """Whether the edit distances of pairs are at most ``most``: bit vectors (Myers 1999, Hyyro 2003) of all pairs side by side.

    ``a`` is not shorter than ``b``.  A block is 64 letters of it, and one letter of ``b`` behind the
    block above, so all blocks take a step at once; only those do that a way of ``most`` steps
    may cross.  Pairs that can no more succeed, or are done, leave now and then.
    """
    found = np.zeros(len(a), dtype=bool)
    ends_a, ends_b = (np.array([len(x) for x in side]) for side in (a, b))
    # Letters that such a way may be above and below the diagonal.
    above, below = max(int((most - ends_a + ends_b).max()) // 2, 0), max(int((most + ends_a - ends_b).max()) // 2, 1)
    columns = int(ends_b.max())
    chars_a, chars_b = (np.frombuffer("".join(side).encode("utf-32-le", "surrogatepass"), dtype="<u4") for side in (a, b))
    # Letters of a by number, others are 0.
    used = np.zeros(int(max(chars_a.max(), chars_b.max())) + 1, dtype=bool)
    used[chars_a] = True
    number = np.cumsum(used) * used
    blocks, letters = -(-int(ends_a.max()) // 64), int(used.sum()) + 1
    # Where each letter stands in each block of each pair, and the letters of b.
    table = np.zeros((len(a), letters * blocks), dtype="<u8")
    at = np.arange(len(chars_a)) - np.repeat(np.cumsum(ends_a) - ends_a, ends_a)
    pair = np.repeat(np.arange(len(a)) * (letters * blocks), ends_a)
    np.add.at(table.ravel(), pair + number[chars_a] * blocks + (at >> 6), np.uint64(1) << (at & 63).astype("<u8"))
    side = np.zeros((columns, len(a)), dtype=np.int64)
    at = np.arange(len(chars_b)) - np.repeat(np.cumsum(ends_b) - ends_b, ends_b)
    side[at, np.repeat(np.arange(len(b)), ends_b)] = number[chars_b] * blocks
    pairs, lasts = np.arange(len(a)), (ends_a - 1) >> 6
    ends = ends_b - 1 + lasts
    due = set(ends.tolist())

    def fresh(size):
        first = np.arange(size) * (letters * blocks) + np.arange(blocks)[:, None]
        return [first, *(np.empty((blocks, size), dtype="<u8") for _ in range(4))]

    # Differences from row to row (up, down), from column to column at the blocks' lower ends (more, less), and distances there.
    up, down = np.full((blocks, len(a)), ~np.uint64(0)), np.zeros((blocks, len(a)), dtype="<u8")
    more, less, more_now, less_now = (np.zeros((blocks + 1, len(a)), dtype="<u8") for _ in range(4))
    more[0] = 1
    score = np.full((blocks, len(a)), 64, dtype=np.int64)
    first, w, x, y, z = fresh(len(a))
    one, top, before = np.uint64(1), np.uint64(63), 0
    for step in range(int(ends.max()) + 1):
        lo = max(0, step - columns + 1, -((63 + above - step) // 65))
        hi = min(blocks - 1, step, (step + below) // 65)
        if hi > before:
            score[hi] = score[hi - 1] - more[hi].view(np.int64) + less[hi].view(np.int64) + 64
            before = hi
        own, to, size = slice(lo, hi + 1), slice(lo + 1, hi + 2), hi + 1 - lo
        p, m, enter, leave = up[own], down[own], more[own], less[own]
        match, both, high, low = w[:size], x[:size], y[:size], z[:size]
        table.take(side[step - hi : step - lo + 1][::-1] + first[own], out=match, mode="clip")
        np.bitwise_or(match, m, out=both)
        match |= leave
        # Horizontal differences.
        np.bitwise_and(match, p, out=high)
        high += p
        high ^= p
        high |= match
        np.bitwise_and(p, high, out=low)
        high |= p
        np.invert(high, out=high)
        high |= m
        np.right_shift(high, top, out=more_now[to])
        np.right_shift(low, top, out=less_now[to])
        high <<= one
        high |= enter
        low <<= one
        low |= leave
        # Vertical ones.
        np.bitwise_and(high, both, out=m)
        both |= high
        np.invert(both, out=both)
        np.bitwise_or(low, both, out=p)
        score[own] += more_now[to].view(np.int64)
        score[own] -= less_now[to].view(np.int64)
        # Above the blocks that take part all differences are one.
        more_now[lo], less_now[lo] = 1, 0
        more, less, more_now, less_now = more_now, less_now, more, less
        if step in due:
            done = np.flatnonzero(ends == step)
            block = lasts[done]
            done, block = done[(block >= lo) & (block <= hi)], block[(block >= lo) & (block <= hi)]
            # Rows of the block below the last letter do not count.
            rest = ~np.uint64(0) << ((ends_a[pairs[done]] - 1) & 63).astype("<u8") << one
            distance = score[block, done] - np.bitwise_count(up[block, done] & rest) + np.bitwise_count(down[block, done] & rest)
            found[pairs[done]] = distance <= most[pairs[done]]
        if step % 32 == 31:
            least = (score[own] - np.bitwise_count(up[own])).min(axis=0) - 1
            stay = np.flatnonzero((ends > step) & (least <= most[pairs]))
            if len(stay) < SIDE_BY_SIDE:
                for i in pairs[stay]:
                    found[i] = edit_distance(a[i], b[i], int(most[i])) <= most[i]
                break
            if len(stay) < 0.75 * len(pairs):
                side, up, down, more, less, score = (v[:, stay] for v in (side, up, down, more, less, score))
                more_now, less_now = np.zeros_like(more), np.zeros_like(less)
                table, pairs, lasts, ends = table[stay], pairs[stay], lasts[stay], ends[stay]
                first, w, x, y, z = fresh(len(stay))
    return found


def all_alike(a: list[str], b: list[str], similarity: float) -> np.ndarray:
    """:func:`alike` of each pair."""
    found, waiting = np.zeros(len(a), dtype=bool), []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        most = int((1.0 - similarity) * max(len(x), len(y)) + 1e-9)
        head = common_length(x, y)
        x, y = x[head:], y[head:]
        tail = common_end(x, y)
        x, y = x[: len(x) - tail], y[: len(y) - tail]
        if len(x) < len(y):
            x, y = y, x
        if len(x) <= most:
            found[i] = True
        elif y and len(x) - len(y) <= most:
            waiting.append((len(x), i, x, y, most))
    waiting.sort(key=lambda w: w[0])
    start = 0
    while start < len(waiting):
        stop, longest = start, 1.6 * waiting[start][0] + 32
        while stop < len(waiting) and stop - start < PAIRS and waiting[stop][0] <= longest:
            stop += 1
        _, places, x, y, most = (list(column) for column in zip(*waiting[start:stop], strict=True))
        if stop - start < SIDE_BY_SIDE:
            found[places] = [edit_distance(*pair) <= pair[2] for pair in zip(x, y, most, strict=True)]
        else:
            found[places] = close(x, y, np.array(most))
        start = stop
    return found


def occurrences(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, th, pos, key, fp, size`` of every line that is compared.

    ``th`` tells texts with one doc_id apart, ``fp`` is the line's number, ``size`` its letters.
    """

    def run(batches):
        for batch in batches:
            for owners, places, found in runs(batch.column("text").to_pylist(), words):
                taken, keys, sizes = pa.array(owners), list(map(key, found.lines)), letters(found)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(taken), batch.column("th").take(taken), pa.array(places),
                        pa.array(keys, pa.binary()), pa.array(numbers(keys, sizes, similarity)), pa.array(sizes.astype(np.int32)),
                    ],
                    ["doc_id", "th", "pos", "key", "fp", "size"],
                )

    return hashed(docs).mapInArrow(run, "doc_id bigint, th bigint, pos int, key binary, fp bigint, size int")


def buckets(docs: DataFrame, count: int, *, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``bucket, fp, least`` of lines that share a bucket (see ``pigeonhole.mates``), of about ``count`` lines.

    A second pass over the texts, so that the names of the buckets are written once, by the shuffle.
    """

    def named(batches):
        known = set()
        for batch in batches:
            for _, _, found in runs(batch.column("text").to_pylist(), words):
                keys = list(map(key, found.lines))
                if len(known) > KNOWN_LINES:
                    known.clear()
                wanted = []
                for i, k in enumerate(keys):
                    if k not in known:
                        known.add(k)
                        wanted.append(i)
                wanted = np.array(wanted, dtype=np.int64)
                fp = numbers([keys[i] for i in wanted], letters(found)[wanted], similarity)
                yield fp.view("<u8"), bands(found, wanted)

    return pigeonhole.mates(common.texts(docs).select("text"), named, BANDS, count, NUMBER_BITS)


def hashed(docs: DataFrame) -> DataFrame:
    return common.texts(docs).withColumn("th", F.xxhash64("text"))


def _again(docs: DataFrame, wanted: DataFrame, words: int, made, columns: str) -> DataFrame:
    """``key`` and the ``columns`` that ``made(lines, places)`` gives for the ``wanted (key, th, ...)`` lines, and their other columns.

    A second pass reads the documents whose hash ``th`` is marked and yields the
    lines whose key is; the join leaves out lines that only share a mark.
    """
    table = pigeonhole.marks(wanted, F.conv(F.hex(F.substring("key", 1, 3)), 16, 10).cast("bigint"))
    names = ["key", *(column.split()[0] for column in columns.split(", "))]

    def run(batches):
        known = set()
        for batch in batches:
            if len(known) > KNOWN_LINES:
                known.clear()
            for _, _, part in runs(batch.column("text").to_pylist(), words):
                keys, places = [], []
                for i, k in enumerate(map(key, part.lines)):
                    place = int.from_bytes(k[:3], "big")
                    if table[place >> 3] >> (place & 7) & 1 and k not in known:
                        known.add(k)
                        keys.append(k)
                        places.append(i)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *made(part, places)], names)

    rows = pigeonhole.marked(hashed(docs), "th", wanted.select("th"))
    found = rows.select("text").mapInArrow(run, f"key binary, {columns}")
    return found.dropDuplicates(["key"]).join(wanted.drop("th"), "key")


def _texts_of(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``key, line``: normalised text of the ``wanted (key, th)`` lines."""

    def made(part, places):
        return [pa.array([part.lines[i].decode("utf-8", "surrogatepass") for i in places], pa.string())]

    return _again(docs, wanted, words, made, "line string")


def _sketches_of(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``key``, the numbers of the short sketch and other columns of the ``wanted (key, th, ...)`` lines."""

    def made(part, places):
        return list(map(pa.array, np.ascontiguousarray(short_sketches(part, np.array(places, dtype=np.int64)).T)))

    return _again(docs, wanted, words, made, ", ".join(f"s{i} bigint" for i in range(SHORT)))


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs (a, b)`` that are alike."""
    both = pairs.join(texts.select(F.col("key").alias("a"), F.col("line").alias("x")), "a").join(
        texts.select(F.col("key").alias("b"), F.col("line").alias("y")), "b"
    )

    def kept(batches):
        rows = pa.Table.from_batches(batches)
        alike = all_alike(rows.column("x").to_pylist(), rows.column("y").to_pylist(), similarity)
        yield from rows.select(["a", "b"]).filter(pa.array(alike)).to_batches()

    def verify(batches):
        # Some ten thousand pairs, or a few long ones, at once.
        waiting, rows, size = [], 0, 0
        for batch in batches:
            waiting.append(batch)
            rows, size = rows + batch.num_rows, size + batch.nbytes
            if rows >= 32 * PAIRS or size >= 8 * RUN_BYTES:
                yield from kept(waiting)
                waiting, rows, size = [], 0, 0
        if waiting:
            yield from kept(waiting)

    return cut(both.select("a", "b", "x", "y").mapInArrow(verify, "a binary, b binary"))


def _near(pairs: DataFrame, similarity: float) -> DataFrame:
    """``a, ta, b, tb`` and roots of the ``pairs`` whose lengths ``na, nb`` allow the similarity and whose short sketches agree."""
    fit = F.least("na", "nb") >= F.lit(similarity) * F.greatest("na", "nb") - 1e-6
    alike = agree(*([F.col(f"{side}{i}") for i in range(SHORT)] for side in "xy"))
    return pairs.where(fit & alike).select("a", "ta", "b", "tb", *(c for c in ("ra", "rb") if c in pairs.columns))


def _sides(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows (key, size, th, root, s0, ...)`` as either side of pairs."""
    return tuple(
        rows.withColumnsRenamed({"key": key, "size": f"n{key}", "th": f"t{key}", "root": f"r{key}"} | {f"s{i}": f"{sketch}{i}" for i in range(SHORT)})
        for key, sketch in (("a", "x"), ("b", "y"))
    )


def _in_parts(rows: DataFrame, column: str, lines: int, step) -> DataFrame:
    """``step`` of parts of the ``rows`` by ``column``, one after the other, so that what it shuffles grows with the ``lines`` only."""
    parts = max(1, math.ceil(rows.count() / max(PART_ROWS, ROWS_A_LINE * lines)))
    number = F.pmod(F.xxhash64(column), F.lit(parts))
    return functools.reduce(DataFrame.unionByName, [cut(step(rows.where(number == i) if parts > 1 else rows)) for i in range(parts)])


def groups(docs: DataFrame, lines: DataFrame, shared: DataFrame, *, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``key, root`` of the distinct ``lines (key, fp, size, th)`` that are linked to others.

    ``shared (bucket, fp, least)`` are those that share buckets.  First every line is compared with the
    least of each of its buckets, which connects families of like lines without
    their pairs.  Then all pairs in a bucket are compared that are not connected
    yet, so no two lines of a bucket that are alike end in different groups.
    Lines that meet by chance grow with the square of the lines: pairs are numbers and short
    sketches until those agree, texts are read and written for the rest alone.
    """
    count = lines.count()
    stars = cut(shared.where("fp <> least").select("fp", "least").distinct())
    concerned = stars.select(F.explode(F.array("fp", "least")).alias("fp")).distinct()
    place = F.shiftleft("fp", 64 - NUMBER_BITS)
    marked = pigeonhole.marked(lines.withColumn("place", place), "place", stars.select(
        F.explode(F.array("fp", "least")).alias("fp")).select(place.alias("place")))
    known = cut(marked.join(concerned, "fp").select("fp", "key", "size", "th"))
    short = common.saved(_sketches_of(docs, known.withColumn("t", F.col("th")), words)).withColumnRenamed("t", "th")
    one, two = _sides(short)
    two = two.withColumnRenamed("fp", "least")
    near = _in_parts(stars, "fp", count, lambda part: _near(part.join(one, "fp").join(two, "least"), similarity))
    texts = common.saved(_texts_of(docs, _ends(near), words))
    edges = _verified(near.select("a", "b"), texts, similarity)
    roots = common.components(edges).select(F.col("node").alias("key"), "root")
    placed = known.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    placed = cut(shared.where("bucket is not null").join(placed, "fp"))
    several_roots = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    # The least of a bucket has been compared with all others.
    left = cut(placed.where("fp <> least").join(several_roots.select("bucket"), "bucket").select("bucket", "key", "root"))

    def unconnected(part):
        one, two = _sides(part.join(short.drop("fp"), "key"))
        return _near(one.join(two, "bucket").where("ra <> rb and a < b"), similarity).distinct()

    # A pair may come once for each part.
    pairs = _in_parts(left, "bucket", count, unconnected)
    texts = texts.unionByName(common.saved(_texts_of(docs, _ends(pairs, texts), words)))
    further = _verified(pairs.select("a", "b"), texts, similarity)
    links = cut(further.join(pairs.select("a", "b", "ra", "rb"), ["a", "b"]).select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
    return _merged(roots, links)


def _ends(pairs: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """``key, th`` of the lines in ``pairs (a, ta, b, tb)`` that are not among the ``texts``."""
    ends = F.explode(F.array(*(F.struct(F.col(x).alias("key"), F.col(f"t{x}").alias("th")) for x in "ab")))
    found = pairs.select(ends.alias("end")).select("end.key", "end.th").distinct()
    return cut(found if texts is None else found.join(texts.select("key"), "key", "left_anti"))


def least_of(batches):
    """``key, root`` of the ends of edges ``a, b``: the least connected one, by union and find."""
    above = {}

    def top(x):
        while above.setdefault(x, x) != x:
            above[x] = x = above[above[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            low, high = sorted((top(a), top(b)))
            above[high] = low
    keys = list(above)
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(list(map(top, keys)), pa.binary())], ["key", "root"])


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``key, root`` of the ``roots (key, root)`` after ``links (a, b)`` between roots, or lines that have none."""
    if links.count() <= LINKS:
        tops = cut(links.coalesce(1).mapInArrow(least_of, "key binary, root binary"))
    else:
        tops = cut(common.components(links).select(F.col("node").alias("key"), "root"))
    whole = roots.unionByName(tops.select("key", F.col("key").alias("root"))).dropDuplicates(["key"])
    tops = tops.select(F.col("key").alias("root"), F.col("root").alias("top"))
    return whole.join(tops, "root", "left").select("key", F.coalesce("top", "root").alias("root"))


def repeats(docs: DataFrame, *, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, th, gone``: for each document with lines to remove their places, counted from 0.

    Shuffle files of each of the many steps go when it is done; its result is written.
    """
    options = {"words": words, "similarity": similarity}
    with shuffles_removed(docs.sparkSession):
        seen = common.saved(occurrences(docs, **options))
        lines = common.saved(seen.groupBy("key").agg(
            F.count(F.lit(1)).alias("n"), F.min("th").alias("th"), F.max("fp").alias("fp"), F.max("size").alias("size")
        ))
        shared = common.saved(buckets(docs, lines.count(), **options))
        roots = groups(docs, lines, shared, **options)
        several = cut(lines.where("n > 1").select("key").join(roots, "key", "full").select("key", F.coalesce("root", "key").alias("root")))
        rows = seen.join(several, "key").select("root", F.struct("doc_id", "th", "pos").alias("here"))
        kept = rows.groupBy("root").agg(F.min("here").alias("keep"))
        gone = rows.join(kept, "root").where(~F.col("here").eqNullSafe(F.col("keep")))
        return common.saved(gone.groupBy("here.doc_id", "here.th").agg(F.collect_set("here.pos").alias("gone")))


def _cleaned(docs: DataFrame, **options) -> DataFrame:
    """``row`` (all columns of ``docs``), ``text`` without repeated lines, ``lines`` before and number ``removed``."""
    found = repeats(docs, **options).withColumnsRenamed({"doc_id": "id", "gone": "places"})
    # The row as one column: whatever its columns are called, they meet no others.
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("key"))
    both = rows.join(
        found, (F.col("key") == F.col("th")) & F.col("row.doc_id").cast("bigint").eqNullSafe(F.col("id")), "left"
    )
    parts = F.split("row.text", "\n", -1)
    kept = F.array_join(F.filter(parts, lambda _, i: ~F.array_contains("places", i)), "\n")
    lines = F.when(F.coalesce("row.text", F.lit("")) == "", 0).otherwise(F.size(parts))
    return both.select(
        "row", F.when(F.col("places").isNull(), F.col("row.text")).otherwise(kept).alias("text"),
        lines.alias("lines"), F.coalesce(F.size("places"), F.lit(0)).alias("removed"),
    )


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with all columns and without repeated lines in ``text``; a document whose every line went is gone, too."""
    rows = _cleaned(docs, **options).where((F.col("removed") == 0) | (F.trim(F.col("text")) != ""))
    return rows.select(*[
        F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns
    ])


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, n_lines, n_removed, text``: one row per row of ``docs (doc_id, text)``.

    Lines with fewer than ``words`` words and ``LETTERS`` letters of scripts without
    spaces are left alone.  A null text stays null
    and has no lines, an empty one neither.  Rows that repeat a doc_id and its text
    are one document and lose the same lines.  A null doc_id comes before all
    others.  No rows give no rows; other columns are not read.
    """
    rows = _cleaned(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), **options)
    return rows.select("row.doc_id", F.col("lines").alias("n_lines"), F.col("removed").alias("n_removed"), "text")
