"""Exact removal of repeated byte strings, by column-wise construction of collection suffix orders.

A byte goes if it lies in a ``WINDOW``-byte string that also starts earlier (smaller document, or same document and earlier start).

1. Every window has a minimiser: the least hash of its ``KMER``-byte substrings. Equal windows have equal minimisers, so only minimisers
   found in two different texts, or twice in one, can belong to repeats. They are counted with partial aggregation.
2. Consecutive windows with one such minimiser are cut out as a string (at most ``RUN`` windows). Of equal strings only the first
   occurrence goes on; all later ones are repeats altogether.
3. The different strings of a minimiser meet in one task. Parts of them whose core no other string shares are left out, of equal
   parts only the first goes on, and bytes beside the core that no other part has there too are cut off. What is left of many minimisers makes a batch of bounded size. For a batch the suffix order of the
   collection is built column by column: each round inserts the next symbol, from the right, of every string at the place its rank in
   the Burrows-Wheeler transform gives, and updates the common prefixes with range minima. Windows are suffixes of at least ``WINDOW``
   bytes, and equal windows are neighbours with common prefixes that long; all but the first of them are repeats.
   Minimisers with more than ``HOT`` different strings do not go to one task: their parts are spread by the hash of their core, and of
   parts whose core another string has, the windows by their own 128-bit hashes; windows equal within a batch are settled there.
4. The repeated ranges of each document are united and cut out of its text.

A batch is bounded, so transform and prefixes are arrays in the task's memory that are rewritten in sequence each round, not files.

Defined results: null text is empty; null ids come after all others; of rows with equal id and text one is the first; rows with equal id
and different texts go by the text's checksum; texts under ``WINDOW`` bytes stay whole; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ticketlens.llm.common import parts, stream_map, texts_of
from ticketlens.runtime import written

WINDOW = 100
KMER = 32
RUN = 64
HOT = 2000
#: Strings at most whose suffixes are ordered together.
BATCH_STRINGS = 1000
#: Classes of windows by the place of their minimiser.
CORES = 3
_LAST = (1 << 63) - 1
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _kmer_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of every KMER-byte substring: a polynomial, that of 2s bytes from those of s bytes, then mixed."""
    h, power = (data.astype(np.uint64) + np.uint64(1)) * _B, int(_A)
    step = 1
    while step < KMER:
        h = h[:-step] * np.uint64(power) + h[step:]
        power = power * power % (1 << 64)
        step *= 2
    h ^= h >> np.uint64(32)
    h *= _B
    return h ^ (h >> np.uint64(29))


def _sliding(pick: np.ufunc, h: np.ndarray, width: int) -> np.ndarray:
    """Least or greatest value (``pick``) of every ``width`` neighbours."""
    step, best = 1, h
    while 2 * step <= width:
        best = pick(best[:-step], best[step:])
        step *= 2
    rest = width - step
    return pick(best[: len(best) - rest], best[rest:]) if rest else best


def minimisers(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser of every window; places of all substrings that are the minimiser of a window they lie in, and their hashes."""
    hashes, width = _kmer_hashes(np.frombuffer(data, np.uint8)), WINDOW - KMER + 1
    least = _sliding(np.minimum, hashes, width)
    edge = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(_sliding(np.maximum, np.concatenate([edge, least, edge]), width) == hashes)
    return least, at, hashes[at]


def seen_minimisers(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct minimisers of a text, and whether they stand at two places of it."""
    distinct, count = np.unique(minimisers(data)[2], return_counts=True)
    return distinct, count > 1


def cut_strings(data: bytes, wanted: np.ndarray) -> tuple[list[np.ndarray], list[bytes]]:
    """The strings of the wanted minimisers, and as columns: minimiser, checksum of the string, first window, number of windows, whether
    the string holds the minimiser twice, its place there."""
    least, places, at_places = minimisers(data)
    start = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    end, values, wanted = np.r_[start[1:], len(least)], least[start], np.sort(wanted)
    here = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)] == values)
    pieces = -(-(end[here] - start[here]) // RUN)
    run = np.repeat(here, pieces)
    at = start[run] + RUN * (np.arange(len(run)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    count = np.minimum(RUN, end[run] - at)
    # the places of the minimiser in a string, from all places in order of (hash, place)
    by_hash = np.argsort(at_places, kind="stable")
    places, at_places = places[by_hash], at_places[by_hash]
    number = np.cumsum(np.r_[False, at_places[1:] != at_places[:-1]])
    key = number * (len(data) + 1) + places
    mine = number[np.searchsorted(at_places, values[run])] * (len(data) + 1)
    low, high = np.searchsorted(key, mine + at), np.searchsorted(key, mine + at + count + WINDOW - KMER)
    strings = [data[a:b] for a, b in zip(at.tolist(), (at + count - 1 + WINDOW).tolist())]
    sid = np.array([xxhash.xxh3_64_intdigest(x) for x in strings], np.uint64)
    return [values[run].view(np.int64), sid.view(np.int64), at, count, high - low > 1, places[low] - at], strings


def _packed(symbols: np.ndarray, bits: int) -> tuple[np.ndarray, int]:
    """For every column of a matrix the number that as many symbols as fit into 63 bits make from there on, and how many fit."""
    fit = 63 // bits
    key = np.zeros(symbols.shape, np.int64)
    for k in range(min(fit, symbols.shape[1])):
        key[:, : symbols.shape[1] - k] |= symbols[:, k:].astype(np.int64) << (bits * (fit - 1 - k))
    return key, fit


def _ranks(order: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Place of each entry among the different ones, from their order and where in it a different one begins."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _pair_order(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (first, second, own place), and where in it a different pair begins."""
    width = len(first).bit_length()
    if 3 * width > 63:
        order = np.lexsort((second, first))
        pairs = (first << 31 | second)[order]
        return order, np.r_[False, pairs[1:] != pairs[:-1]]
    keys = np.sort(first << (2 * width) | second << width | np.arange(len(first)))  # values sort faster than places
    pairs = keys >> width
    return keys & ((1 << width) - 1), np.r_[False, pairs[1:] != pairs[:-1]]


def _short_suffixes(symbols: np.ndarray, begin: np.ndarray, length: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes of at most ``most`` symbols in order, equal ones by string: string, length, common prefix with the one before.

    Their symbols are ranked by prefixes of doubled length; common prefixes are put together from the ranks, longest first.
    """
    n = len(length)
    column = np.arange(most + 1)
    real = column >= most - length[:, None]  # column c begins the suffix of most - c symbols
    inside = real & (column < most)
    matrix = np.zeros((n, most + 1), symbols.dtype)
    matrix[inside] = symbols[((begin + length - most)[:, None] + column)[inside]]
    bits = int(symbols.max()).bit_length()
    packed, reach = _packed(matrix, bits)
    packed = packed.ravel()
    order = np.argsort(packed, kind="stable")
    ordered = packed[order]
    levels = [(reach, _ranks(order, np.r_[False, ordered[1:] != ordered[:-1]]))]
    while reach < most:
        rank = levels[-1][1]
        rest = np.zeros((n, most + 1), np.int64)  # beyond the end there is the empty suffix, whose rank is 0
        rest[:, : most + 1 - reach] = rank.reshape(n, -1)[:, reach:]
        order, new = _pair_order(rank, rest.ravel())
        reach *= 2
        levels.append((reach, _ranks(order, new)))
    flat = order[real.ravel()[order]]
    who, at = np.divmod(flat, most + 1)
    size = most - at
    a, b = flat[:-1], flat[1:]
    bound, shift = np.minimum(size[:-1], size[1:]), np.zeros(len(flat) - 1, np.int64)
    for reach, rank in reversed(levels):
        on = np.minimum(shift, bound)
        shift = np.where(rank[a + on] == rank[b + on], shift + reach, shift)
    on = np.minimum(shift, bound)
    differ = packed[a + on] ^ packed[b + on]
    fit = 63 // bits
    for k in range(fit):
        shift += (differ >> (bits * (fit - 1 - k))) == 0
    prefix = np.r_[0, np.minimum(shift, bound)]
    return who, size, prefix


def suffix_order(strings: list[bytes], most: int = WINDOW - 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all suffixes in order: string, length, common prefix with the suffix before.

    Suffixes of up to ``most`` symbols, which hold no window, are put in order at once. Then round j inserts each string's suffix of j
    symbols in front of which the transform holds the next symbol. A suffix's new place is the number of end marks, of smaller symbols,
    and of equal symbols further up in the transform. The common prefix of two neighbours with one first symbol is one more than the
    least prefix between the places of their rests.
    """
    n = len(strings)
    length = np.array([len(s) for s in strings])
    raw = np.frombuffer(b"".join(strings), np.uint8)
    used = np.unique(raw)
    kind = np.uint8 if len(used) < 256 else np.uint16
    code = np.zeros(256, kind)
    code[used] = np.arange(1, len(used) + 1)  # 0 is the end mark
    symbols, begin = code[raw], np.cumsum(length) - length
    longest = int(length.max())
    most = min(most, longest)
    who, size, prefix = _short_suffixes(symbols, begin, length, most)
    before = np.where(size < length[who], symbols[np.maximum(begin[who] + length[who] - 1 - size, 0)], 0).astype(kind)
    at = np.flatnonzero(size == most)
    active, place = who[at], at
    entry, prefix = (size * n + who).astype(np.int32 if n * (longest + 1) < 1 << 31 else np.int64), prefix.astype(np.uint8)
    for j in range(most + 1, longest + 1):
        alive = length[active] >= j
        active, place = active[alive], place[alive]
        order = np.argsort(before, kind="stable")
        ends = len(before) - int(np.count_nonzero(before))
        where = np.empty(len(order), np.int32)
        where[order] = np.arange(len(order), dtype=np.int32)
        at = where[place].astype(np.int64)  # in the order of symbols
        new_place = n + at - ends
        # common prefixes next to the new suffixes
        beside = np.zeros(len(order) + 1, bool)
        beside[at] = beside[at + 1] = True
        touched = np.flatnonzero(beside[ends + 1 : len(order)]) + ends + 1
        touched = touched[before[order[touched]] == before[order[touched - 1]]]
        low, high = order[touched - 1] + 1, order[touched]
        level = np.frexp((high - low + 1).astype(float))[1] - 1
        common, least = np.empty(len(touched), np.uint8), prefix
        for lv in range(int(level.max()) + 1 if len(level) else 0):
            here = np.flatnonzero(level == lv)
            common[here] = np.minimum(least[low[here]], least[high[here] - (1 << lv) + 1])
            step = 1 << lv
            least = np.minimum(least[:-step], least[step:])
        total = n + len(order) - ends
        old = np.ones(total, bool)
        old[new_place] = False

        def grown(values: np.ndarray, new, old=old, new_place=new_place, total=total) -> np.ndarray:
            out = np.empty(total, values.dtype)
            out[old] = values
            out[new_place] = new
            return out

        following = np.zeros(len(active), before.dtype)
        more = length[active] > j
        following[more] = symbols[begin[active[more]] + length[active[more]] - 1 - j]
        before, entry, prefix = grown(before, following), grown(entry, active + j * n), grown(prefix, 0)
        prefix[n + touched - ends] = common + 1
        place = new_place
    size, who = np.divmod(entry, n)
    return who, size, prefix


def repeated_windows(strings: list[bytes], positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(string, window in it) of every window that equals one at an earlier position; ``positions``: of each string's first window."""
    who, size, prefix = suffix_order(strings)
    new = prefix < WINDOW
    is_window = size >= WINDOW
    group = np.cumsum(new)[is_window]
    who, size = who[is_window], size[is_window]
    offset = np.array([len(s) for s in strings])[who] - size
    position = positions[who] + offset
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    least = np.repeat(np.minimum.reduceat(position, first), np.diff(np.r_[first, len(group)]))
    later = position > least
    return who[later], offset[later]


def _order_of(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST))


def _prepared(docs: DataFrame) -> DataFrame:
    """Text, its checksum, the document's place in the order (d, t)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumn("m", F.md5("text"))
    return rows.withColumn("d", _order_of()).withColumn("t", F.conv(F.substring("m", 1, 15), 16, 10).cast("long"))


def _repeated_minimisers(rows: DataFrame) -> DataFrame:
    """(t, hs): per text the minimisers in it that may stand for repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            hs, ts = [], []
            for t, text in zip(batch.column("t").to_pylist(), texts_of(batch)):
                data = text.encode("utf-8", "surrogatepass")
                if len(data) < WINDOW or t in seen:
                    continue
                seen.add(t)
                h, twice = seen_minimisers(data)
                hs += [h.view(np.int64), h[twice].view(np.int64)]
                ts += [np.full(len(h), t, np.int64), np.full(int(twice.sum()), -t - 1, np.int64)]  # a second mark: found twice in one text
            if hs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs)), pa.array(np.concatenate(ts))], ["h", "t"])

    found = written(stream_map(rows.select("t", "text"), run, "h long, t long"), "found", "zstd")
    repeated = found.groupBy("h").agg(F.min("t").alias("low"), F.max("t").alias("high")).filter("low < high").select("h")
    kept = found.filter("t >= 0").join(repeated, "h", "left_semi")
    return kept.groupBy("t").agg(F.collect_set("h").alias("hs"))  # bounded by the text's own length


STRING = "h long, sid long, d long, t long, start long, n int, twice boolean, m int, string binary"


def _strings(rows: DataFrame, firsts: DataFrame, lists: DataFrame) -> DataFrame:
    wanted = firsts.join(lists, "t").select(F.col("d").alias("_d"), F.col("m").alias("_m"), "hs")
    chosen = rows.join(wanted, (F.col("d") == F.col("_d")) & (F.col("m") == F.col("_m"))).select("d", "t", "text", "hs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut: list[list[np.ndarray]] = []
            strings: list[bytes] = []
            columns = (batch.column("d").to_pylist(), batch.column("t").to_pylist(), texts_of(batch), batch.column("hs").to_pylist())
            for d, t, text, hs in zip(*columns):
                found, own = cut_strings(text.encode("utf-8", "surrogatepass"), np.array(hs, np.int64).view(np.uint64))
                cut.append([np.full(len(own), d), np.full(len(own), t), *found])
                strings += own
            if strings:
                d, t, h, sid, at, n, twice, m = (np.concatenate(c) for c in zip(*cut))
                ready = (h, sid, d, t, at, n.astype(np.int32), twice, m.astype(np.int32))
                arrays = [*(pa.array(c) for c in ready), pa.array(strings, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in STRING.split(", ")])

    return stream_map(chosen, run, STRING)


RANGE = "d long, t long, low long, high long"


def _ranges(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ((), (), (), ()))], ["d", "t", "low", "high"])


def _window_ranges(rows: list[tuple]) -> list[tuple]:
    """Repeated ranges among strings (d, t, start, string), from the suffix order of the collection."""
    if not rows:
        return []
    place = {dt: i for i, dt in enumerate(sorted({(r[0], r[1]) for r in rows}))}
    positions = np.array([place[r[0], r[1]] * (1 << 40) + r[2] for r in rows], np.int64)
    who, offset = repeated_windows([r[3] for r in rows], positions)
    if not len(who):
        return []
    order = np.lexsort((offset, who))
    who, offset = who[order], offset[order]
    new = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (offset[1:] != offset[:-1] + 1)])
    last = np.r_[new[1:], len(who)] - 1
    return [(rows[w][0], rows[w][1], rows[w][2] + int(a), rows[w][2] + int(b) + WINDOW) for w, a, b in zip(who[new], offset[new], offset[last])]


def _cores(m: int, string: bytes) -> Iterator[tuple[int, bytes, int, bytes, int]]:
    """(class, core, first window, part, place of the core in the part) of a string that holds its minimiser at ``m`` only."""
    width, n = -(-(WINDOW - KMER + 1) // CORES), len(string) - WINDOW + 1
    for q in range(CORES):
        low, high = max(0, m - (q + 1) * width + 1), min(n - 1, m - q * width)  # windows of this class
        if low <= high:
            yield q, string[m - q * width : m - (q + 1) * width + 1 + WINDOW], low, string[low : high + WINDOW], m - q * width - low


def _common(sides: list[bytes]) -> list[int]:
    """For each string how many of its first bytes another one begins with too: the most is found with a neighbour in the order."""
    order, out = sorted(range(len(sides)), key=sides.__getitem__), [0] * len(sides)
    numbers = [int.from_bytes(s.ljust(WINDOW, b"\0"), "big") for s in sides]
    for i, j in zip(order, order[1:]):
        same = min(len(sides[i]), len(sides[j]), WINDOW - ((numbers[i] ^ numbers[j]).bit_length() + 7) // 8)
        out[i], out[j] = max(out[i], same), max(out[j], same)
    return out


def _trimmed(family: list[tuple], core: int) -> list[tuple]:
    """Of the parts (d, t, start, part, place of the core of ``core`` bytes) of a family the stretches (d, t, start, part) whose windows may
    stand in another part: as far as another one goes on alike on each side of the core. Parts without such a window are left out."""
    left = _common([part[at - 1 :: -1] if at else b"" for _, _, _, part, at in family])
    right = _common([part[at + core :] for _, _, _, part, at in family])
    return [
        (d, t, start + at - a, part[at - a : at + core + b])
        for (d, t, start, part, at), a, b in zip(family, left, right)
        if a + core + b >= WINDOW
    ]


def _families(group: list[tuple]) -> tuple[list[tuple], list[list[tuple]]]:
    """Of the strings (h, d, t, start, twice, m, string) of one minimiser: ranges that are repeats, and families of parts to be ordered.

    Equal windows hold the minimiser at the same place, so windows are put into ``CORES`` classes by that place. All windows of a
    class have a common core; where no other string has the same core, none of them can be a repeat. Of equal parts the first
    goes on, without the bytes beside the core that no other part has there. A string that holds the minimiser twice has no such places and its whole group goes on as it is.
    """
    if len(group) == 1 and not group[0][4]:
        return [], []
    if any(r[4] for r in group):
        return [], [[(r[1], r[2], r[3], r[6]) for r in group]]
    by_core: dict[tuple, list[tuple]] = {}
    for _, d, t, start, _, m, string in group:
        for q, core, low, part, at in _cores(m, string):
            by_core.setdefault((q, core), []).append((d, t, start + low, part, at))
    ranges, ordered = [], []
    for (_, core), parts_ in by_core.items():
        if len(parts_) > 1:
            first: dict[bytes, tuple] = {}
            for part in sorted(parts_):
                if first.setdefault(part[3], part)[:3] != part[:3]:  # a repeated row gives the same part twice
                    ranges.append((part[0], part[1], part[2], part[2] + len(part[3])))
            if len(first) > 1 and (family := _trimmed(list(first.values()), len(core))):
                ordered.append(family)
    return ranges, ordered


def _within_tasks(strings: DataFrame) -> DataFrame:
    dealt = strings.repartition(4 * parts(strings.sparkSession), "h").sortWithinPartitions("h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        found: list[tuple] = []
        waiting: dict[bool, list[tuple]] = {False: [], True: []}  # parts, and longer whole strings, which take more rounds

        def settle() -> None:
            ranges, ordered = _families(group)
            found.extend(ranges)
            mine = waiting[any(r[4] for r in group)]
            for family in ordered:  # equal windows lie in one family, so a batch may end between two of a minimiser
                if mine and len(mine) + len(family) > BATCH_STRINGS:
                    found.extend(_window_ranges(mine))
                    mine.clear()
                mine.extend(family)
            group.clear()

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("h", "d", "t", "start", "twice", "m", "string"))):
                if group and row[0] != group[-1][0]:
                    settle()
                    if len(found) >= 100_000:
                        yield _ranges(found)
                        found.clear()
                group.append(row)
        if group:
            settle()
            yield _ranges(found + _window_ranges(waiting[False]) + _window_ranges(waiting[True]))

    return stream_map(dealt.select("h", "d", "t", "start", "twice", "m", "string"), run, RANGE)


PART = "c1 long, c2 long, d long, t long, start long, string binary"
FOUND = "w1 long, w2 long, d long, t long, low long, high long"


def _halves(data: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(data)
    return (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)


def _columns(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    kinds = [pa.binary() if kind == "binary" else pa.int64() for _, kind in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * len(kinds), kinds)], [n for n, _ in fields])


def _local_windows(strings: list[tuple]) -> list[tuple]:
    """Of strings (d, t, start, string): windows that have another one equal to them among these as ranges, but for the first ones,
    which are given with their hashes as (w1, w2, d, t, low, None)."""
    first: dict[tuple[int, int], tuple] = {}
    hashed = []
    for d, t, start, string in strings:
        own = [_halves(string[i : i + WINDOW]) for i in range(len(string) - WINDOW + 1)]
        hashed.append(own)
        for i, w in enumerate(own):
            at = (d, t, start + i)
            if first.setdefault(w, at) > at:
                first[w] = at
    out = [(*w, *at, None) for w, at in first.items()]
    for (d, t, start, _), own in zip(strings, hashed):
        later = [(start + i, start + i + WINDOW) for i, w in enumerate(own) if first[w] < (d, t, start + i)]
        out += [(None, None, d, t, low, high) for low, high in united(later)]
    return out


def _spread_windows(strings: DataFrame) -> DataFrame:
    """The same for minimisers with very many strings: parts with a core that another string has, then their windows by their own hash.

    ``mixed`` marks minimisers that a string holds twice; their strings have no cores and go on as they are.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for d, t, start, m, mixed, s in zip(*(batch.column(c).to_pylist() for c in ("d", "t", "start", "m", "mixed", "string"))):
                if mixed:
                    out.append((None, None, d, t, start, s))
                else:
                    out += [(*_halves(core + bytes([q])), d, t, start + low, part) for q, core, low, part, _ in _cores(m, s)]
            yield _columns(out, PART)

    def hash_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _columns(_local_windows(list(zip(*(batch.column(c).to_pylist() for c in ("d", "t", "start", "string"))))), FOUND)

    pieces = written(stream_map(strings.select("d", "t", "start", "m", "mixed", "string"), cut, PART), "parts", "zstd")
    shared = pieces.groupBy("c1", "c2").count().filter("count > 1 AND c1 IS NOT NULL").select("c1", "c2")
    kept = pieces.join(shared, ["c1", "c2"], "left_semi").unionByName(pieces.filter("c1 IS NULL"))
    found = written(stream_map(kept.select("d", "t", "start", "string"), hash_, FOUND), "windows", "zstd")
    windows = found.filter("w1 IS NOT NULL").select("w1", "w2", "d", "t", F.col("low").alias("at"))
    first = windows.groupBy("w1", "w2").agg(F.min(F.struct("d", "t", "at")).alias("first"))
    later = windows.join(first, ["w1", "w2"]).filter(F.struct("d", "t", "at") > F.col("first"))
    later = later.select("d", "t", F.col("at").alias("low"), (F.col("at") + WINDOW).alias("high"))
    return later.unionByName(found.filter("w1 IS NULL").select("d", "t", "low", "high"))


def _repeated_ranges(strings: DataFrame) -> DataFrame:
    """(d, t, low, high): byte ranges of first copies that stand earlier elsewhere."""
    first = strings.groupBy("h", "sid").agg(F.min(F.struct("d", "t", "start")).alias("first"))
    is_first = F.struct("d", "t", "start") == F.col("first")
    judged = strings.join(first, ["h", "sid"]).withColumn("is_first", is_first)
    judged = written(judged.select("h", "d", "t", "start", "n", "twice", "m", "is_first", F.when(is_first, F.col("string")).alias("string")), "judged", "zstd")
    whole = judged.filter("NOT is_first").select("d", "t", F.col("start").alias("low"), (F.col("start") + F.col("n") - 1 + WINDOW).alias("high"))
    different = judged.filter("is_first")
    crowded = different.groupBy("h").agg(F.count("*").alias("strings"), F.max("twice").alias("mixed"))
    crowded = written(crowded.filter(F.col("strings") > HOT).select("h", "mixed"), "hot")
    inside = _within_tasks(different.join(crowded, "h", "left_anti"))
    # at most a ``HOT``-th of the strings; their strings stay where they are
    spread = _spread_windows(different.join(F.broadcast(crowded), "h"))
    return whole.unionByName(inside).unionByName(spread)


def united(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def removed_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, d, m, text, n, spans): each row's removed byte ranges, united; a later copy of a text loses all of it."""
    rows = _prepared(docs)
    narrow = written(rows.select("d", "m", "t", F.octet_length("text").alias("n")), "narrow")
    firsts = written(narrow.filter(F.col("n") >= WINDOW).groupBy("m", "t").agg(F.min("d").alias("d")), "firsts")
    lists = written(_repeated_minimisers(rows), "minimisers", "zstd")
    strings = written(_strings(rows, firsts, lists), "strings", "zstd")
    ranges = _repeated_ranges(strings).groupBy("d", "t").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
    ranges = written(firsts.join(ranges, ["d", "t"], "left").select(F.col("m").alias("_m"), F.col("d").alias("_d"), "ranges"), "ranges")
    # one row for each (d, m): whether it is the text's first document, how many equal rows there are, its ranges
    state = narrow.filter(F.col("n") >= WINDOW).select("d", "m").distinct()
    state = state.join(ranges, (F.col("d") == F.col("_d")) & (F.col("m") == F.col("_m")), "left")
    state = state.select(F.col("d").alias("_d"), F.col("m").alias("_m"), F.col("_d").isNotNull().alias("is_first"), "ranges")
    again = Window.partitionBy("d", "m").orderBy(F.lit(0))
    dup = narrow.groupBy("d", "m").count().filter(F.col("count") > 1).select("d", "m")
    joined = rows.join(state, (F.col("d") == F.col("_d")) & (F.col("m") == F.col("_m")), "left").drop("_d", "_m", "t")
    single = joined.join(dup, ["d", "m"], "left_anti").withColumn("nth", F.lit(1))
    several = joined.join(dup, ["d", "m"], "left_semi").withColumn("nth", F.row_number().over(again))
    return single.unionByName(several)


def deduplicated(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Per row: bytes, removed bytes and runs, checksum of what is left; with ``with_text`` also the bytes left and the spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "is_first", "ranges", "nth")]
            for doc_id, is_first, ranges, nth, text in zip(*columns, texts_of(batch)):
                data = text.encode("utf-8", "surrogatepass")
                if len(data) < WINDOW:
                    spans = []
                elif not is_first or nth > 1:
                    spans = [(0, len(data))]
                else:
                    spans = united([(r["low"], r["high"]) for r in ranges or []])
                kept, at = [], 0
                for low, high in spans:
                    kept.append(data[at:low])
                    at = high
                left = b"".join([*kept, data[at:]])
                row = (doc_id, len(data), len(data) - len(left), len(spans), hashlib.sha256(left).hexdigest())
                out.append((*row, left, [{"low": a, "high": b} for a, b in spans]) if with_text else row)
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))]
            names = [f.split()[0] for f in RESULT.split(", ")] + ["kept", "spans"] * with_text
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * len(names), kinds)], names)

    rows = removed_spans(docs).select("doc_id", "text", "is_first", "ranges", "nth")
    return stream_map(rows, run, RESULT + (", kept binary, spans array<struct<low: long, high: long>>" if with_text else ""))
