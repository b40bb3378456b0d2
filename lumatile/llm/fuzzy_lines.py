"""Fuzzy line dedup: of lines that are nearly the same, one occurrence stays in the whole corpus.

Lines are normalised; equal ones become one right where they are read. Candidates among the others
come from MinHash over character grams (`grams`): lines that share a band of minima. Without `grams` they come from a
64-bit SimHash over distinct words: of five blocks of the fingerprint two are equal in any pair with
at most three differing bits, so pairs of blocks are the join's keys; that misses most lines with
a word changed. Links are verified by edit
similarity of the normalised lines. A first round verifies links between lines whose sketches are near;
a second one verifies every other pair of candidates that the first left in two groups, however far
their sketches are. So nearly all of a family of like lines is joined by about as many comparisons as it
has lines, and yet no candidate that meets the threshold is left out. Of keys of many lines the second round makes
no pairs for Spark to move: the lines go to the tasks that compare them.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain, combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, batches, id_and_text, written
from .components import components
from .simhash_dedup import T, key_rows, links

#: Least edit similarity of linked lines: 1 - edits / characters of the longer one.
SIMILARITY = 0.8
MASK = (1 << 64) - 1
#: 64-bit words of all pairs whose edit distances are worked out at once, words of one pair, words of their table of characters.
LANES, WIDE, TABLE = 32768, 64, 1 << 21
#: Bytes of pairs that are sorted by length and compared together.
COMPARED = 32 << 20
#: 64-bit words of the bitmap of lines that have candidates (2 MB).
SLOTS = 1 << 18
#: Characters of the grams that similar lines must share, and cells of the histograms in which they are counted.
SHARED, CELLS = 3, 1 << 14
#: Characters of texts whose grams are looked up at once, and bits of the number of cells of their table (256 KB of blocks of places).
LOOKED, PLACES = 3 << 14, 16
#: Characters of a piece by which two texts are aligned.
PIECE = 8
#: Words that are added in one go.
LANE = 255
#: Bits of the five blocks; a key is a pair of them.
BLOCKS = (13, 13, 13, 13, 12)

#: Characters of a gram, minima of a band and bands, for lines of up to SHORT bytes and for those from LONG on.
#: Lengths of similar lines differ by a fifth at most, so such a pair has one kind of band in common.
#: Long unlike lines share several of the commonest 5-grams by chance; three 8-grams tell more than five 5-grams and are lost to fewer edits.
FEW, MANY, SHORT, LONG = (5, 4, 20), (8, 3, 16), 40, 32
#: Bits of a key below the number of its band.
BAND = 58
#: Bits in which the 48-bit sketches of candidates compared first differ at most; unlike lines differ in about 24. It decides what is compared first, not what is compared.
RADIUS = 13
#: Steps of a line's length code in which lengths grow by a factor of e; the code takes the lowest 16 bits of fp.
STEPS = 4000
#: Of a key of more lines no pairs are made; once the first round has put most of them in one group, the lines meet in tasks.
OFTEN = 16
#: Lines of such a key that one task compares; a key that has more is dealt out in pairs of blocks of so many.
BLOCK = 512
#: Pairs of them that are compared before those that are in one group by then are left out.
TOGETHER = 4096
#: Lines of such a key that others are compared with in the first round.
LEADERS = 4096
#: Buckets of keys, a power of two up to 65,536; a bucket's keys are in one task.
BUCKETS = 4096
#: Pairs in a batch.
PAIRS = 1 << 19
#: Bytes of lines hashed in one go: they stay in the cache.
CHUNK = 1 << 16

_PLAIN = bytes(LOWER[c] if chr(LOWER[c]).isalpha() and c < 128 or c > 127 else 48 if 48 <= c <= 57 else 32 for c in range(256))


def normalised(line: bytes) -> bytes:
    """Words in lower case, digits as 0, other ASCII characters as one space; a line of marks only stays as it is, trimmed."""
    return b" ".join(line.translate(_PLAIN).split()) or b" ".join(line.split())


def masks() -> list[tuple[int, int]]:
    starts = np.cumsum((0, *BLOCKS)).tolist()
    block = [((1 << n) - 1) << s for n, s in zip(BLOCKS, starts, strict=False)]
    return [(-1, a | b) for a, b in combinations(block, 2)]


def _common(a: str, b: str) -> int:
    """Length of the longest common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def edit_distance(a: str, b: str, most: int | None = None) -> int:
    """Levenshtein distance, by bit vectors over the longer text (Myers; Hyyrö); some number above `most` if it is above."""
    head = _common(a, b)
    a, b = a[head:], b[head:]
    tail = _common(a[::-1], b[::-1])
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not a or not b:
        return len(a) + len(b)
    if len(a) < len(b):
        a, b = b, a
    match: dict[str, int] = {}
    for i, c in enumerate(a):
        match[c] = match.get(c, 0) | 1 << i
    every, last = (1 << len(a)) - 1, 1 << len(a) - 1
    plus, minus, score = every, 0, len(a)
    most = len(a) if most is None else most
    left = len(b)
    for c in b:
        eq = match.get(c, 0)
        x = eq | minus
        d = (((x & plus) + plus) ^ plus) | x
        up, down = minus | ~(d | plus) & every, plus & d
        score += bool(up & last) - bool(down & last)
        left -= 1
        if score - left > most:  # each further character saves one edit at most
            return score - left
        up, down = (up << 1 | 1) & every, (down << 1) & every
        plus, minus = down | ~(d | up) & every, up & d
    return score


def _differing(a: bytes, b: bytes, least: float) -> bool | tuple[str, str, int]:
    """Whether the lines are similar or, where it takes an edit distance, the parts that differ, the longer one first, and the edits allowed."""
    x, y = a.decode("utf-8", "replace"), b.decode("utf-8", "replace")
    longer = max(len(x), len(y))
    if not longer:
        return True
    allowed = int((1 - least) * longer + 1e-9)
    if abs(len(x) - len(y)) > allowed:
        return False
    if a.count(b" ") == b.count(b" ") and len(v := a.split()) == len(w := b.split()) and sum(max(len(p), len(q)) for p, q in zip(v, w, strict=True) if p != q) <= allowed:
        return True  # rewriting the words that differ is enough
    head = _common(x, y)
    x, y = x[head:], y[head:]
    tail = _common(x[::-1], y[::-1])
    x, y = x[: len(x) - tail], y[: len(y) - tail]
    if max(len(x), len(y)) <= allowed:
        return True  # so is rewriting all between the ends that they share
    return (x, y, allowed) if len(x) >= len(y) else (y, x, allowed)


def similar(a: bytes, b: bytes, least: float = SIMILARITY) -> bool:
    found = _differing(a, b, least)
    return found if isinstance(found, bool) else edit_distance(*found) <= found[2]


def all_similar(x: list[bytes], y: list[bytes], least: float = SIMILARITY) -> np.ndarray:
    """similar() of each pair; edit distances are worked out for many pairs at once."""
    ok, parts, at = np.zeros(len(x), bool), [], []
    for i, (a, b) in enumerate(zip(x, y, strict=True)):
        found = _differing(a, b, least)
        if isinstance(found, bool):
            ok[i] = found
        else:
            parts.append(found)
            at.append(i)
    may = []
    for i in np.flatnonzero(_in_place(parts)).tolist():
        if _aligned(*parts[i]):
            ok[at[i]] = True
        else:
            may.append(i)
    parts, at = [parts[i] for i in may], [at[i] for i in may]
    words = np.array([-(-len(a) // 64) for a, _, _ in parts], np.int64)
    step = np.maximum(1, 1 << np.maximum(np.log2(np.maximum(words, 1)).astype(np.int64) - 2, 0))
    words = -(-words // step) * step  # texts of more than 8 words are compared with others of up to a fifth more: few at once take as long as many
    order = np.lexsort((np.array([len(b) for _, b, _ in parts], np.int64), np.array([k // 8 for _, _, k in parts], np.int64), words))
    one = 0
    while one < len(order):
        wide = int(words[order[one]])
        stop = min(one + max(1, LANES // wide), int(np.searchsorted(words[order], wide, "right")))
        where = [at[k] for k in order[one:stop].tolist()]
        own = [parts[k] for k in order[one:stop].tolist()]
        if wide > WIDE:
            near = may_be_similar([a for a, _, _ in own], [b for _, b, _ in own], least, [k for _, _, k in own])
            ok[where] = [bool(n) and edit_distance(*o) <= o[2] for n, o in zip(near, own, strict=True)]
        elif len(own) < 8:  # these few are faster one by one
            ok[where] = [edit_distance(*o) <= o[2] for o in own]
        else:
            ok[where] = _within([(a + end, b + end, k) for a, b, k in own for end in ("\0" * (64 * wide - 63 - len(a)),)])  # the same end leaves their distance as it is
        one = stop
    return ok


def _aligned(a: str, b: str, most: int) -> bool:
    """Whether it takes `most` edits at most to rewrite all that is between pieces that the texts share. If not, they may be within the edits all the same."""
    rest, left = [(a, b)], most
    while rest:
        a, b = rest.pop()
        if len(a) < len(b):
            a, b = b, a
        if len(a) - len(b) > left:
            return False
        if len(b) > PIECE:
            for k in (4, 2, 6, 3, 5):  # a piece of the longer text, the middle one or one about it
                at = k * (len(a) - PIECE) // 8
                piece = a[at : at + PIECE]
                if (to := b.find(piece, max(0, at - left - 1), at + left + PIECE)) >= 0:
                    head, tail = _common(a[:at][::-1], b[:to][::-1]), _common(a[at + PIECE :], b[to + PIECE :])
                    rest += ((a[: at - head], b[: to - head]), (a[at + PIECE + tail :], b[to + PIECE + tail :]))
                    break
            else:
                left -= len(a)
        else:
            left -= len(a)
        if left < 0:
            return False
    return True


def _in_place(pairs: list[tuple[str, str, int]]) -> np.ndarray:
    """Which pairs (longer text, other text, edits allowed) share enough grams about the same places. Never wrong about pairs within the edits.

    A gram that no edit touches is in the other text, moved by s places, which takes |s| edits before it and |d - s| after, d being
    the difference of the lengths: so s is in a range of k places about d / 2, k being the edits. All other grams are touched;
    an edit touches those that have its place, SHARED at most, so it takes as many as it takes places to meet all of them.
    """
    size = np.array([len(a) for a, _, _ in pairs], np.int64)
    order = np.argsort(size, kind="stable")
    part = np.cumsum(size[order]) // LOOKED
    ok = np.zeros(len(pairs), bool)
    for own in np.split(order, np.flatnonzero(np.diff(part)) + 1):
        if len(own):
            ok[own] = _in_place_at_once([pairs[i] for i in own.tolist()])
    return ok


def _places(texts: list[str], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each character of the texts the cell of the gram that begins there, by hash of gram and text, and its place in its text."""
    x = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    place = np.arange(len(x), dtype=np.int32)
    place -= np.repeat((np.cumsum(size) - size).astype(np.int32), size)
    code = np.repeat(np.arange(len(size), dtype=np.uint32) * np.uint32(0x85EBCA6B), size)
    for k, factor in enumerate((0x9E3779B1, 0xC2B2AE3D, 0x27D4EB2F)):  # those that reach into the next text only make more grams agree
        code[: max(0, len(x) - k)] += x[k:] * np.uint32(factor)
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x2C1B3C6D)
    code >>= np.uint32(32 - PLACES)
    return code.astype(np.intp), place


def _touches() -> np.ndarray:
    """By places already met (0 to SHARED - 1) and 16 bits for the grams that begin at as many places: how many places meet those set, times 4, and the places met beyond."""
    bits = np.arange(1 << 16)
    out = np.zeros((SHARED, 1 << 16), np.uint8)
    for state in range(SHARED):
        met, count = np.full(1 << 16, state), np.zeros(1 << 16, np.int64)
        for k in range(16):
            new = (bits >> k & 1 == 1) & (met == 0)
            count += new
            met = np.where(new, SHARED - 1, np.maximum(met - 1, 0))
        out[state] = count * 4 + met
    return out.ravel()


_TOUCHES = _touches()


def _in_place_at_once(pairs: list[tuple[str, str, int]]) -> np.ndarray:
    """_in_place() of pairs in order of the longer text's length."""
    m, n, most = (np.array(v, np.int32) for v in ([len(a) for a, _, _ in pairs], [len(b) for _, b, _ in pairs], [k for _, _, k in pairs]))
    shift = np.ceil(np.log2(np.maximum(m, 32) / 32)).astype(np.int32)  # a text has up to 32 blocks of so many bits of places
    cell, place = _places([b for _, b, _ in pairs], n)
    table = np.zeros(1 << PLACES, np.uint32)
    place >>= np.repeat(shift, n)
    np.bitwise_or.at(table, cell, np.uint32(1) << place.view(np.uint32))
    cell, place = _places([a for a, _, _ in pairs], m)
    by = np.repeat(shift, m)
    low = place - np.repeat((most + m - n) // 2, m)
    np.maximum(low, 0, out=low)
    low >>= by
    high = place + np.repeat((most - m + n) // 2, m)
    high >>= by
    np.minimum(high, 31, out=high)
    np.subtract(31, high, out=high)
    near = np.uint32(0xFFFFFFFF) >> high.view(np.uint32)
    near &= np.uint32(0xFFFFFFFF) << low.view(np.uint32)
    near &= table[cell]
    moved = near == 0
    ends = np.cumsum(m)
    for k in range(1, SHARED):
        moved[ends - k] = False  # no gram begins there
    words = -(-m // 16)
    first = np.cumsum(words) - words
    bits = np.zeros(16 * int(words.sum()), bool)
    bits[place + np.repeat((16 * first).astype(np.int32), m)] = moved
    bits = np.packbits(bits, bitorder="little").view("<u2").astype(np.intp)
    count, met = np.zeros(len(m), np.int64), np.zeros(len(m), np.int64)
    for k in range(int(words.max(initial=0))):
        at = int(np.searchsorted(words, k, "right"))  # those before it have ended
        found = _TOUCHES[(met[at:] << 16) + bits[first[at:] + k]]
        count[at:] += found >> 2
        met[at:] = found & 3
    return count <= most


def _codes(texts: list[str]) -> tuple[np.ndarray, int]:
    """The texts' characters one after the other, as numbers from 0 in place of the characters, and how many differ."""
    x = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    table = np.zeros(int(x.max(initial=0)) + 1, np.int32)
    table[x] = 1
    table = np.cumsum(table, dtype=np.int32) - 1
    return table[x], int(table[-1]) + 1


def _columns(codes: np.ndarray, size: np.ndarray, fill: int) -> np.ndarray:
    """(longest, texts): each text's codes down a column, `fill` after its end."""
    out = np.full((int(size.max(initial=0)), len(size)), fill, codes.dtype)
    text = np.repeat(np.arange(len(size)), size)
    out[np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size), text] = codes
    return out


def _within(pairs: list[tuple[str, str, int]]) -> np.ndarray:
    """Which pairs (longer text, other text, edits allowed) are within the edits; the longer texts take equally many words of 64 characters.

    As edit_distance(), for all pairs at once, and only in the words that a band of `allowed` cells about the middle of the first
    and the last diagonal touches: no cell outside it is on a path of so few edits (see _in_place). Distances there count as one
    more for each step, which is never too little.
    """
    a, b, most = ([p[k] for p in pairs] for k in range(3))
    codes, kinds = _codes(a + b)
    m, n, most = np.array([len(t) for t in a]), np.array([len(t) for t in b]), np.array(most)
    many, words = len(pairs), int(-(-m.max() // 64))
    if (kinds + 1) * words * many > TABLE and many > 1:
        return np.concatenate((_within(pairs[: many // 2]), _within(pairs[many // 2 :])))
    columns = _columns(codes[m.sum() :], n, kinds)
    match = np.zeros((kinds + 1) * words * many, np.uint64)  # by character, word and pair: places in the longer text
    lane = np.arange(many)
    place = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
    np.add.at(match, (codes[: m.sum()].astype(np.int64) * words + place // 64) * many + np.repeat(lane, m), np.uint64(1) << (place % 64).astype(np.uint64))
    columns = columns.astype(np.int64) * (words * many) + lane
    one, top = np.uint64(1), np.uint64(63)
    result, live = np.zeros(many, bool), lane
    plus, minus = np.full((words, many), MASK, np.uint64), np.zeros((words, many), np.uint64)
    bit = ((m - 1) % 64).astype(np.uint64)
    word = np.arange(words)[:, None] * many
    before, beyond, lo, hi = int((most - m + n).max()) // 2, int((most + m - n).max()) // 2, 0, -1
    score = np.zeros(many, np.int64)  # distance at the end of word hi, or at the longer text's end if that is in it
    for j in range(len(columns) + 1):
        if j and (j % 32 == 0 or j == len(columns)):  # those settled leave
            left = np.maximum(n - j, 0)
            if hi == words - 1:
                result[live[(left == 0) & (score <= most)]] = True
                stay = (left > 0) & (score - left <= most)  # each further character saves one edit at most
            else:
                stay = left > 0  # in fewer columns than this the last word is always reached
            # distances at the words' ends; between two of them a distance is at least the mean of both less 32
            step = np.bitwise_count(plus[lo : hi + 1]).astype(np.int64) - np.bitwise_count(minus[lo : hi + 1])
            if hi == words - 1:
                tail = (MASK << (bit + one)) * (bit < top)  # what follows the longer text's end
                step[-1] -= np.bitwise_count(plus[hi] & tail).astype(np.int64) - np.bitwise_count(minus[hi] & tail)
            end = score - np.cumsum(step[::-1], axis=0)[::-1] + step
            stay &= ((2 * end - step - 64) // 2).min(axis=0) <= most
            if not stay.any():
                break
            if not stay.all():
                live, plus, minus, score, bit, m, n, most = live[stay], plus[:, stay], minus[:, stay], score[stay], bit[stay], m[stay], n[stay], most[stay]
        lo = max(0, (j - before) // 64)
        while hi < min(words - 1, (j + beyond) // 64):
            hi += 1
            score += 64 if hi < words - 1 else (m - 1) % 64 + 1
        p, q = plus[lo : hi + 1], minus[lo : hi + 1]
        x = match.take(columns[j, live] + word[lo : hi + 1])
        x |= q
        d = x & p
        d += p
        carry = d[:-1] < p[:-1]
        while carry.any():
            d[1:] += carry
            carry &= d[1:] == 0
            carry[1:] = carry[:-1]
            carry[:1] = False
        d ^= p
        d |= x
        up = d | p
        np.invert(up, out=up)
        up |= q
        down = p & d
        at = bit if hi == words - 1 else top
        score += np.where(j < n, ((up[-1] >> at) & one).astype(np.int64) - ((down[-1] >> at) & one).astype(np.int64), 0)
        high, low = up[:-1] >> top, down[:-1] >> top
        up <<= one
        down <<= one
        up[1:] |= high
        down[1:] |= low
        up[0] |= one
        np.bitwise_and(up, d, out=q)
        d |= up
        np.invert(d, out=d)
        np.bitwise_or(d, down, out=p)
    return result


def simhashes(lines: list[bytes]) -> np.ndarray:
    """64-bit SimHash of each line over its distinct words: with repeats, the commonest words would decide it."""
    hashes, counts = array("Q"), []
    for line in lines:
        counts.append(_add_words(hashes, line.split()))
    return _simhashes(hashes, counts)


def _add_words(hashes: array, words: list[bytes]) -> int:
    """Append the hashes of the distinct words; words themselves aren't kept."""
    own = set(words)
    hashes.extend(map(xxhash.xxh3_64_intdigest, own))
    return len(own)


def _simhashes(hashes: array, counts: list[int]) -> np.ndarray:
    """SimHashes of lines from their words' hashes, one line's after the other's."""
    h, counts = np.frombuffer(hashes, np.uint64) if len(hashes) else np.zeros(0, np.uint64), np.array(counts, np.int64)
    # A hash's 64 bits count as 8 numbers of 8 counters each; up to LANE words are added before a counter overflows.
    parts = -(-counts // LANE)
    part_line = np.repeat(np.arange(len(counts)), parts)
    starts = (np.cumsum(counts) - counts)[part_line] + (np.arange(len(part_line)) - np.repeat(np.cumsum(parts) - parts, parts)) * LANE
    sums = np.zeros((len(starts), 64), np.uint8)
    for a in range(0, len(starts), 2048):
        own = starts[a : a + 2048]
        stop = starts[a + 2048] if a + 2048 < len(starts) else len(h)
        bits = np.unpackbits(h[own[0] : stop].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
        sums[a : a + 2048] = np.add.reduceat(bits, own - own[0], axis=0).view(np.uint8)
    ones = np.zeros((len(counts), 64), np.uint8 if parts.max(initial=0) < 2 else np.int64)
    there = counts > 0
    if there.any():
        ones[there] = np.add.reduceat(sums, (np.cumsum(parts) - parts)[there], axis=0, dtype=ones.dtype)
    return np.packbits(ones > (counts // 2)[:, None], axis=1, bitorder="little").view("<u8").ravel()


def _ids(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The two 64-bit hashes that together stand for a line's content; the first one alone is its number in links."""
    both = np.array([xxhash.xxh3_128_digest(x) for x in lines], "S16") if lines else np.zeros(0, "S16")
    both = np.frombuffer(both.tobytes(), ">u8").reshape(-1, 2)
    return both[:, 1].astype(np.uint64).view(np.int64), both[:, 0].astype(np.uint64).view(np.int64)


def _line_rows(parts: Iterator[pa.RecordBatch], grams: bool = False) -> Iterator[pa.RecordBatch]:
    """Of each batch the distinct lines with their first place: null ids last, then doc_id, text hash, line. With grams fp is 0."""
    for b in parts:
        first: dict[bytes, tuple] = {}
        hashes, counts = array("Q"), []
        for doc_id, text, th in zip(*(c.to_pylist() for c in b.columns), strict=True):
            for n, line in enumerate(text.split(b"\n")):
                w = line.translate(_PLAIN).split() or line.split()
                if not w:
                    continue
                norm, place = b" ".join(w), (doc_id is None, doc_id or 0, th, n)
                if norm not in first:
                    counts.append(0 if grams else _add_words(hashes, w))
                    first[norm] = place
                elif place < first[norm]:
                    first[norm] = place
        lines = list(first)
        fp = _simhashes(hashes, counts).view(np.int64)
        h, g = _ids(lines)
        places = list(zip(*first.values(), strict=True)) if lines else [()] * 4
        kinds = (pa.bool_(), pa.int64(), pa.int64(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(g), pa.array(fp), *(pa.array(c, k) for c, k in zip(places, kinds, strict=True))], names=["h", "g", "fp", "no_id", "doc_id", "th", "line"])


_FACTORS = np.array([xxhash.xxh3_64_intdigest(b"%d" % k) & 0xFFFFFFFF | 1 for k in range(max(rows * bands for _, rows, bands in (FEW, MANY)))], np.uint32)


def minima(lines: list[bytes], gram: int, many: int) -> np.ndarray:
    """`many` hashes of each line: of each of as many hash functions the least one over the line's grams of up to 8 characters, its ends padded."""
    out = np.zeros((len(lines), many), np.uint32)
    at = 0
    while at < len(lines):
        stop, size = at, 0
        while stop < len(lines) and size < CHUNK:
            size += len(lines[stop]) + gram
            stop += 1
        pad = bytes(gram - 1)
        text = np.frombuffer(b"".join(b"\0" + x + pad for x in lines[at:stop]) + pad, np.uint8)
        lengths = np.fromiter(map(len, lines[at:stop]), np.int64, stop - at)
        ends = np.cumsum(lengths + gram)
        starts = np.cumsum(lengths + 1) - lengths - 1  # a line has one gram more than characters
        own = np.ones(size, bool)
        own[ends[:, None] - np.arange(1, gram)] = False  # these would reach into the next line
        x = np.zeros(size, np.uint64)
        for k in range(gram):
            x |= text[k : k + size].astype(np.uint64) << np.uint64(8 * k)
        x = x[own] * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x = (x >> np.uint64(32)).astype(np.uint32)
        for k, factor in enumerate(_FACTORS[:many]):
            out[at:stop, k] = np.minimum.reduceat(x * factor, starts)
        at = stop
    return out


def _bands(least: np.ndarray, rows: int, first: int) -> np.ndarray:
    """A 64-bit key of each band of `rows` minima: above BAND bits of hash the band's number, from `first` on."""
    n = least.shape[1] // rows
    band = np.arange(first, first + n, dtype=np.uint64)
    key = np.broadcast_to(band, (len(least), n)).copy()
    for k in range(rows):
        key = (key ^ least[:, k : n * rows : rows]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(32)
    return key & np.uint64((1 << BAND) - 1) | band << np.uint64(BAND)


def _length_codes(lines: list[bytes]) -> np.ndarray:
    """STEPS times the logarithm of each line's number of characters, rounded down."""
    n = np.fromiter((len(x) if x.isascii() else len(x.decode("utf-8", "replace")) for x in lines), np.float64, len(lines))
    return np.minimum(np.log(np.maximum(n, 1)) * STEPS, 65535).astype(np.uint64)


def _apart(least: float) -> int:
    """Length codes of similar lines differ by so much at most."""
    return int(-np.log(least) * STEPS) + 2 if least > 0 else 65535


def _lengths_fit(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    return np.abs((a & np.uint64(65535)).astype(np.int64) - (b & np.uint64(65535)).astype(np.int64)) <= _apart(least)


def _bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which the sketches differ."""
    return np.bitwise_count((a ^ b) >> np.uint64(16))


def _keys_of(lines: list[bytes], h: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(key, fp, h) of each band of each line; fp: the lowest bits of 48 minima, then the code of the line's length."""
    for a in range(0, len(lines), 10_000):
        part = lines[a : a + 10_000]
        length, code = np.fromiter(map(len, part), np.int64, len(part)), _length_codes(part)
        for (gram, rows, bands), first, on in ((FEW, 0, np.flatnonzero(length <= SHORT)), (MANY, FEW[2], np.flatnonzero(length >= LONG))):
            least = minima([part[i] for i in on], gram, rows * bands)
            fp = np.zeros((len(on), 8), np.uint8)
            fp[:, 2:] = np.packbits((least[:, :48] & 1).astype(np.uint8), axis=1, bitorder="little")
            fp = (fp.view("<u8").ravel() | code[on]).view(np.int64)
            keys = _bands(least, rows, first)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(fp, bands)), pa.array(np.repeat(h[a : a + 10_000][on], bands))], names=["key", "fp", "h"])


def _gram_keys(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of each partition's distinct lines, packed."""
    seen: set[int] = set()
    for b in parts:
        lines = {}
        for text in b.column(1).to_pylist():
            for line in text.split(b"\n"):
                if (norm := normalised(line)) and (h := xxhash.xxh3_128_intdigest(norm) & MASK) not in seen:
                    seen.add(h)
                    lines[norm] = h
        keyed = _keys_of(list(lines), np.fromiter(lines.values(), np.uint64, len(lines)).view(np.int64))
        while held := list(islice(keyed, 32)):
            yield _packed(held)


def _packed(keyed: list[pa.RecordBatch]) -> pa.RecordBatch:
    """(bucket, rows): the rows (key, fp, h) of each bucket of keys as bytes, so that Spark moves a few long rows."""
    rows = np.stack([np.concatenate([b.column(k).to_numpy() for b in keyed]) for k in range(3)], axis=1)
    bucket = (rows[:, 0] & (BUCKETS - 1)).astype(np.uint16)
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(rows)])) if len(rows) else np.zeros(1, np.int64)
    packed = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((24 * cuts).astype(np.int32)), pa.py_buffer(rows.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]].astype(np.int32)), packed], names=["bucket", "rows"])


def _dealt(keyed: DataFrame, block: int) -> DataFrame:
    """keyed (columns key, n, h and others) by key, with the key's band and the line's side (null: compare it with all others, else with those of another side).

    The lines of a key of more than a block are in pairs of blocks, so that any two of its lines are compared in one task.
    """
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("h"), blocks)
    pair = F.transform(
        F.sequence(F.lit(0), blocks - 1),
        lambda i: F.struct(F.xxhash64(F.lit("block"), F.col("key"), F.least(own, i), F.greatest(own, i)).alias("key"), F.when(own != i, own).cast("int").alias("side")),
    )
    whole = F.array(F.struct(F.col("key"), F.lit(None).cast("int").alias("side")))
    band = F.shiftrightunsigned("key", BAND).cast("int")
    rest = [c for c in keyed.columns if c not in ("key", "n")]
    return keyed.select(F.explode(F.when(blocks < 2, whole).otherwise(pair)).alias("to"), band.alias("band"), *rest).select("to.*", "band", *rest).repartition("key")


#: Kinds of rows that _span gives: a link to verify first, a pair to verify if the first ones leave it in two groups, a line (v) under a key (u) of n lines.
FIRST, LATER, MEMBER = 0, 1, 2
_SPAN = "kind tinyint, u long, v long, n long, fp long"


def _span_rows(kind: int, u: np.ndarray, v: np.ndarray, n: int = 0, fp: np.ndarray | None = None) -> pa.RecordBatch:
    if kind != MEMBER:
        u, v = np.minimum(u, v), np.maximum(u, v)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(u), kind, np.int8)), pa.array(u), pa.array(v), pa.array(np.full(len(u), n, np.int64)), pa.array(np.zeros(len(u), np.int64) if fp is None else fp.view(np.int64))], names=["kind", "u", "v", "n", "fp"])


def _all_pairs(h: np.ndarray, fp: np.ndarray, least: float) -> Iterator[pa.RecordBatch]:
    """All pairs in each row of h (groups, lines) whose lengths fit; first ones: each line's nearest one of those before it."""
    n = h.shape[1]
    i, j = np.triu_indices(n, 1)
    for a in range(0, len(h), step := max(1, PAIRS // len(i))):
        own, f = h[a : a + step], fp[a : a + step]
        fit = _lengths_fit(f[:, i], f[:, j], least)
        far = np.full((len(own), n, n), 255, np.uint8)
        far[:, j, i] = np.where(fit, _bits(f[:, i], f[:, j]), 255)
        nearest = far.argmin(axis=2)
        first = fit & (nearest[:, j] == i) & (far[:, j, i] <= RADIUS)
        for kind, on in ((FIRST, first), (LATER, fit & ~first)):
            g, k = np.nonzero(on)
            yield _span_rows(kind, own[g, i[k]], own[g, j[k]])


def _first_links(h: np.ndarray, fp: np.ndarray, least: float) -> Iterator[pa.RecordBatch]:
    """Of one key's lines, fewer links than lines: from each to the nearest one of some that are far from each other."""
    led_h, led = h[:0], fp[:0]
    for a in range(0, len(h), 256):
        own, f = h[a : a + 256], fp[a : a + 256]
        # those before it in these 256, too, for lines that no leader is near
        there, at = np.concatenate((led, f)), np.concatenate((led_h, own))
        far = np.where(_lengths_fit(f[:, None], there[None, :], least), _bits(f[:, None], there[None, :]), 255)
        far[:, len(led) :][np.triu_indices(len(f))] = 255
        near = far.argmin(axis=1)
        on = far[np.arange(len(f)), near] <= RADIUS
        yield _span_rows(FIRST, own[on], at[near[on]])
        room = LEADERS - len(led)
        led_h, led = np.concatenate((led_h, own[~on][:room])), np.concatenate((led, f[~on][:room]))


def _span(least: float = SIMILARITY, often: int = OFTEN):
    """Of the lines under each key, every pair whose lengths fit; of a key of more than `often` lines, its lines and first links."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (held := [x for b in parts for x in b.column(1).to_pylist()]):
            return
        key, fp, h = np.frombuffer(b"".join(held), np.int64).reshape(-1, 3).T
        del held
        order = np.lexsort((h, key))
        key, fp, h = key[order], fp[order].view(np.uint64), h[order]
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (h[1:] != h[:-1])))  # partitions that hold the same line give it once each
        key, fp, h = key[new], fp[new], h[new]
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1))
        size = np.diff(np.append(cuts, len(key)))
        for n in np.unique(size[(size > 1) & (size <= often)]).tolist():
            at = cuts[size == n][:, None] + np.arange(n)
            yield from _all_pairs(h[at], fp[at], least)
        for a, n in zip(cuts[size > max(1, often)].tolist(), size[size > max(1, often)].tolist(), strict=True):
            yield _span_rows(MEMBER, key[a : a + n], h[a : a + n], n, fp[a : a + n])
            yield from _first_links(h[a : a + n], fp[a : a + n], least)

    return run


def _texts(needed: bytes):
    """Of each batch the distinct lines whose slot in the bitmap is set."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(needed, np.uint64)
        for b in parts:
            lines = list({norm for text in b.column(1).to_pylist() for line in text.split(b"\n") if (norm := normalised(line))})
            h, g = _ids(lines)
            slot = h.view(np.uint64) & np.uint64((len(bitmap) << 6) - 1)
            on = np.flatnonzero(bitmap[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1))
            yield pa.RecordBatch.from_arrays([pa.array(h[on]), pa.array(g[on]), pa.array([lines[i] for i in on], pa.binary())], names=["h", "g", "norm"])

    return run


def _bitmap(nodes: DataFrame) -> bytes:
    """A bitmap of 64 * SLOTS bits of which those of all nodes are set, by hash: it is gathered in at most SLOTS rows, whatever the number of nodes.

    It only spares lines a shuffle that no candidate needs; those it lets through are joined exactly.
    """
    slot = F.col("node").bitwiseAND(F.lit((SLOTS << 6) - 1))
    bit = F.expr("shiftleft(1L, int(node & 63L))")
    out = np.zeros(SLOTS, np.uint64)
    # not by toLocalIterator(): its query ends before its rows are read, and _cleanup() deletes the shuffle that they come from
    found = nodes.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out.tobytes()


#: With it Spark deletes the shuffle files of a query at its end, and not when the driver's JVM happens to find its plan unreachable.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _cleanup(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def _grams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Histograms (lines, CELLS) of the lines' grams by hash, and the lines' lengths in characters."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    x = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    line = np.repeat(np.arange(len(texts)), size)
    code = np.zeros(max(0, len(x) - SHARED + 1), np.uint64)
    for k in range(SHARED):
        code = (code + x[k : k + len(code)]) * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(31)
    own = line[: len(code)] == line[SHARED - 1 :] if len(code) else np.zeros(0, bool)  # a gram that reaches into the next line is none
    cell = line[: len(code)][own] * CELLS + (code[own] % np.uint64(CELLS)).astype(np.int64)
    return np.bincount(cell, minlength=len(texts) * CELLS).reshape(-1, CELLS), size


def may_be_similar(x: list[str], y: list[str], least: float = SIMILARITY, edits: list[int] | None = None) -> np.ndarray:
    """Which pairs share enough grams: k edits change at most SHARED * k of a line's grams. Never wrong about pairs within `edits`, or that are similar."""
    out = []
    for at in range(0, len(x), 64):
        a, n = _grams_of(x[at : at + 64])
        b, m = _grams_of(y[at : at + 64])
        longer = np.maximum(n, m)
        k = np.floor((1 - least) * longer + 1e-9) if edits is None else np.array(edits[at : at + 64])
        out.append((np.minimum(a, b).sum(axis=1) >= longer - SHARED + 1 - SHARED * k) & (np.abs(n - m) <= k))
    return np.concatenate(out) if out else np.zeros(0, bool)


def _verify(least: float):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in chain(parts, (None,)):
            if b is not None:
                held.append(b)
                size += b.nbytes
            if held and (b is None or size >= COMPARED):
                both = pa.Table.from_batches(held)
                ok = all_similar(both.column("x").to_pylist(), both.column("y").to_pylist(), least)
                yield from both.select(["u", "v"]).filter(pa.array(ok, pa.bool_())).to_batches()
                held, size = [], 0

    return run


def _cross(fits):
    """Every pair of lines under a key that have two labels and whose fp fit."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (held := [b for b in parts if b.num_rows]):
            return
        key, fp, h, label = (c.to_numpy() for c in pa.Table.from_batches(held).columns)
        order = np.lexsort((h, key))
        key, fp, h, label = key[order], fp[order].view(np.uint64), h[order], label[order]
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1))
        size = np.diff(np.append(cuts, len(key)))
        mixed = np.minimum.reduceat(label, cuts) != np.maximum.reduceat(label, cuts)
        for a, n in zip(cuts[mixed].tolist(), size[mixed].tolist(), strict=True):
            f, own, g = fp[a : a + n], label[a : a + n], h[a : a + n]
            for i in range(0, n, step := max(1, PAIRS // n)):
                x, y = np.nonzero((g[i : i + step, None] < g[None, :]) & (own[i : i + step, None] != own[None, :]) & fits(f[i : i + step, None], f[None, :]))
                yield pa.RecordBatch.from_arrays([pa.array(g[i + x]), pa.array(g[y])], names=["u", "v"])

    return run


def _compare(least: float):
    """Links between lines under a key that have two labels; a pair with several such keys is compared under the lowest band's.

    Lines that a link puts in one group are not compared any further.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (held := [b for b in parts if b.num_rows]):
            return
        held = pa.Table.from_batches(held)
        key, band, h, label = (held.column(k).to_numpy() for k in ("key", "band", "h", "label"))
        side, fp = held.column("side").fill_null(-1).to_numpy(), held.column("fp").to_numpy().view(np.uint64)
        keys = held.column("keys").combine_chunks()
        norm = held.column("norm")
        under = np.zeros((len(key), FEW[2] + MANY[2]), np.int64)
        line, k = np.repeat(np.arange(len(key)), keys.value_lengths().to_numpy()), keys.flatten().to_numpy()
        under[line, k.view(np.uint64) >> np.uint64(BAND)] = k
        order = np.lexsort((h, key))
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(key[order])) + 1, [len(key)]))
        few, waiting = [], 0  # pairs of keys that have few of them

        def flush():
            if few:
                u, v = (np.concatenate(p) for p in zip(*few, strict=True))
                ok = all_similar(norm.take(pa.array(u)).to_pylist(), norm.take(pa.array(v)).to_pylist(), least)
                yield pa.RecordBatch.from_arrays([pa.array(h[u[ok]]), pa.array(h[v[ok]])], names=["u", "v"])
                few.clear()

        for a, stop in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            at, n = order[a:stop], stop - a
            values, own = np.unique(label[at], return_inverse=True)
            if len(values) < 2:
                continue
            texts = None
            root, f, s, before = np.arange(len(values)), fp[at], side[at], under[at, : band[at[0]]]
            for i in range(0, n, step := max(1, PAIRS // n)):
                fits = _lengths_fit(f[i : i + step, None], f[None, :], least) & ((s[i : i + step, None] < 0) | (s[i : i + step, None] != s[None, :]))
                x, y = np.nonzero(np.triu(fits & (root[own[i : i + step, None]] != root[own[None, :]]), i + 1))
                x += i
                new = ~((before[x] == before[y]) & (before[x] != 0)).any(axis=1)
                x, y = x[new], y[new]
                if step >= n and len(x) <= TOGETHER:
                    few.append((at[x], at[y]))
                    waiting += len(x)
                    if waiting >= TOGETHER:
                        yield from flush()
                        waiting = 0
                    continue
                texts = texts or norm.take(pa.array(at)).to_pylist()
                for c in range(0, len(x), TOGETHER):
                    u, v = x[c : c + TOGETHER], y[c : c + TOGETHER]
                    apart = root[own[u]] != root[own[v]]
                    u, v = u[apart], v[apart]
                    ok = all_similar([texts[j] for j in u], [texts[j] for j in v], least)
                    u, v = u[ok], v[ok]
                    for p, q in zip(own[u].tolist(), own[v].tolist(), strict=True):
                        if root[p] != root[q]:
                            root[root == root[q]] = root[p]
                    yield pa.RecordBatch.from_arrays([pa.array(h[at[u]]), pa.array(h[at[v]])], names=["u", "v"])
        yield from flush()

    return run


def _compared(members: DataFrame, left: DataFrame, texts: DataFrame, least: float, block: int) -> DataFrame:
    """Links between lines under the keys of members (key, h, n, fp) that have two labels in left (h, label)."""
    keyed = written(members.join(left, "h"))
    mixed = keyed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    keyed = written(keyed.join(mixed, "key", "left_semi"))
    lines = texts.select("h", "norm").join(keyed.groupBy("h").agg(F.collect_list("key").alias("keys")), "h")  # at most a key for each band
    return _dealt(keyed.join(lines, "h"), block).mapInArrow(_compare(least), "u long, v long")


def _spans(lines: DataFrame) -> DataFrame:
    """Links to verify first, by SimHash."""
    by_fp = lines.groupBy("fp").agg(F.min("h").alias("least"), F.count("*").alias("n"))
    distinct = written(by_fp)
    spans = links(distinct, masks=masks())
    to_h = distinct.select(F.col("fp").alias("f"), "least")
    spans = spans.join(to_h, spans.u == to_h.f).select("v", F.col("least").alias("a")).join(to_h, F.col("v") == to_h.f).select(F.col("a").alias("u"), F.col("least").alias("v"))
    alike = lines.join(distinct.where("n > 1").select("fp", "least"), "fp").where("h <> least").select(F.col("least").alias("u"), F.col("h").alias("v"))
    return spans.unionByName(alike)


def groups(docs: DataFrame, least: float = SIMILARITY, grams: bool = False, block: int = BLOCK) -> DataFrame:
    """(h, root, no_id, doc_id, th, line): each distinct normalised line, its group (null: no candidate for one) and its first place.

    Lines are equal if 128 bits of hash are. Links go by the first 64 of them; should two lines
    have those in common, the one whose text was compared has the links, and the other none.
    """
    with _cleanup(docs.sparkSession):
        return _groups(docs, least, grams, block)


def _groups(docs: DataFrame, least: float, grams: bool, block: int) -> DataFrame:
    rows = id_and_text(docs)
    place = F.struct("no_id", "doc_id", "th", "line")
    found = _rows(docs).mapInArrow(lambda parts: _line_rows(parts, grams), "h long, g long, fp long, no_id boolean, doc_id long, th long, line int")
    lines = written(found.groupBy("h", "g").agg(F.min("fp").alias("fp"), F.min(place).alias("p")).select("h", "g", "fp", "p.*"))
    if grams:
        spanned = written(rows.mapInArrow(_gram_keys, "bucket int, rows binary").repartition("bucket").mapInArrow(_span(least, OFTEN), _SPAN))
        proposed = written(spanned.where(F.col("kind") < MEMBER).groupBy("u", "v").agg(F.min("kind").alias("kind")))
        members = spanned.where(F.col("kind") == MEMBER).select(F.col("u").alias("key"), F.col("v").alias("h"), "n", "fp")
        more = members.select("h")
    else:
        proposed = written(_spans(lines).withColumn("kind", F.lit(FIRST)))
        more = lines.select("h").limit(0)
    ends = proposed.select(F.col("u").alias("node")).unionByName(proposed.select(F.col("v").alias("node"))).unionByName(more.select(F.col("h").alias("node")))
    near = written(ends.distinct())  # only lines that have some candidate at all; their texts are needed from here on
    texts = written(rows.mapInArrow(_texts(_bitmap(near)), "h long, g long, norm binary").join(near.select(F.col("node").alias("h")), "h", "left_semi").groupBy("h").agg(F.min(F.struct("norm", "g")).alias("x")).select("h", "x.norm", "x.g"))
    first = written(_verified(proposed.where(F.col("kind") == FIRST).select("u", "v"), texts, least))
    label = written(components(first))
    left = near.join(label.select("node", F.col("root").alias("label")), "node", "left").select(F.col("node").alias("h"), F.coalesce("label", "node").alias("label"))
    of = left.select(F.col("h").alias("u"), F.col("label").alias("lu"))
    labelled = lambda pairs: pairs.join(of, "u").join(of.withColumnsRenamed({"u": "v", "lu": "lv"}), "v")
    if grams:
        later = labelled(proposed.where(F.col("kind") == LATER)).where("lu <> lv").select("u", "v")
        second = _verified(later, texts, least)
        if not members.isEmpty():
            second = second.unionByName(_compared(members, left, texts, least, block))
    else:
        keyed = lines.select("h", "fp").join(left, "h").select(F.explode(key_rows(masks())).alias("key"), "fp", "h", "label")
        fits = lambda a, b: np.bitwise_count(a ^ b) <= T
        second = _verified(keyed.repartition("key").mapInArrow(_cross(fits), "u long, v long").distinct(), texts, least)
    joined = labelled(written(second)).select(F.col("lu").alias("u"), F.col("lv").alias("v"))
    higher = components(joined).select(F.col("node").alias("label"), "root")
    roots = left.join(higher, "label", "left").select("h", F.coalesce("root", "label").alias("root")).join(texts.select("h", "g"), "h")
    return lines.join(roots, ["h", "g"], "left").select("h", "root", "no_id", "doc_id", "th", "line")


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    x, y = texts.select(F.col("h").alias("u"), F.col("norm").alias("x")), texts.select(F.col("h").alias("v"), F.col("norm").alias("y"))
    return pairs.join(x, "u").join(y, "v").mapInArrow(_verify(least), "u long, v long")


def _cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())])

    def rows():
        seen = set()  # rows of one doc_id and text are in one partition; the first one has the lines
        for b in parts:
            for doc_id, text, keep, th in zip(*(c.to_pylist() for c in b.columns), strict=True):
                lines = text.split(b"\n")
                keep = set(keep or ()) if (doc_id, th) not in seen else set()
                seen.add((doc_id, th))
                stay = [x for n, x in enumerate(lines) if n in keep or not x.strip()]
                full = sum(1 for x in lines if x.strip())
                yield doc_id, b"\n".join(stay).decode("utf-8", "replace"), full, len(lines) - len(stay)

    yield from batches(rows(), schema, size_of=lambda r: 4 * len(r[1]))


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text and a hash of the text."""
    return id_and_text(docs).withColumn("th", F.xxhash64("text"))


def dedup_lines(docs: DataFrame, least: float = SIMILARITY, grams: bool = False, block: int = BLOCK) -> DataFrame:
    """One row per row of docs (columns doc_id, text): doc_id, text, n_lines, n_dropped.

    text: without the lines that go; n_lines: the text's lines with a character other than space;
    n_dropped: those that go. Lines are linked if their normalised forms are equal or they are
    candidates and their edit similarity is at least `least`. Candidates are lines whose SimHashes
    differ in at most 3 bits or, with grams, that MinHash over their grams finds. Of each
    connected group the first occurrence stays, by doc_id (null last) and place in the text.
    Blank lines always stay. A null or empty text gives an empty one. Of rows with equal doc_id
    and text one keeps its lines. An empty table gives no rows.
    """
    found = groups(docs, least, grams, block)
    place = F.struct("no_id", "doc_id", "th", "line")
    alone = found.where("root IS NULL").select("no_id", "doc_id", "th", "line")
    kept = alone.unionByName(found.where("root IS NOT NULL").groupBy("root").agg(F.min(place).alias("p")).select("p.*"))
    by_doc = kept.groupBy("no_id", "doc_id", "th").agg(F.collect_list("line").alias("keep"))  # at most a document's lines
    rows = _rows(docs).withColumns({"no_id": F.col("doc_id").isNull(), "id": F.coalesce("doc_id", F.lit(0))})
    joined = rows.join(by_doc.withColumnRenamed("doc_id", "id").hint("shuffle_hash"), ["no_id", "id", "th"], "left")
    return joined.select("doc_id", "text", "keep", "th").mapInArrow(_cut, "doc_id long, text string, n_lines long, n_dropped long")
