"""Near-duplicate lines by a segment-partition edit join.

Every distinct line is cut into max_edits + 1 even segments. A line within max_edits edits leaves one of them intact, at a
shift that the two lengths bound, so lines are indexed under (segment number, length, segment hash) and probe only the
substrings that multi-match-aware windows allow for each indexed length. Pairs that meet pass a parity filter (an edit flips at
most two of the 64 parities of character counts) and are verified by a banded bit-parallel edit distance.

Substring hashes come from one polynomial prefix hash of a batch of lines, so a probe costs a few vector operations.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.llm.common import durable, pick

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
MIX = np.uint64(0xBF58476D1CE4E5B9)


@dataclass(frozen=True)
class LinePlan:
    """Lines of min_exact code points or more (without outer white space) go if an earlier line equals them, those of min_chars or
    more also if one lies within max_edits edits. broadcast_rows bounds, after a count, the hot groups whose sizes are broadcast;
    beyond it the join shuffles. block: pairs of a key are compared so many lines at a time. hot: a key of more entries is
    refined, see _refined."""

    max_edits: int = 2
    min_exact: int = 1
    min_chars: int = 20
    broadcast_rows: int = 300_000
    block: int = 1024
    hot: int = 4096


def line_ids(text: str | None, min_chars: int) -> list[tuple[int, str, int, int]]:
    """(line number, stripped line, two 64-bit hashes as signed numbers) of the lines that count, first of each in the text."""
    seen, out = set(), []
    for k, line in enumerate((text or "").split("\n")):
        line = line.strip()
        if len(line) >= min_chars and line not in seen:
            seen.add(line)
            b = line.encode("utf-8", "surrogatepass")
            out.append((k, line, _signed(xxhash.xxh64_intdigest(b, 1)), _signed(xxhash.xxh64_intdigest(b, 2))))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def segments(length: int, max_edits: int) -> list[tuple[int, int]]:
    """(start, length) of max_edits + 1 even segments, the longer ones last."""
    k = max_edits + 1
    short, longer = divmod(length, k)
    sizes = [short] * (k - longer) + [short + 1] * longer
    return [(sum(sizes[:i]), n) for i, n in enumerate(sizes)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, b, np.uint64)]), dtype=np.uint64) for b in (BASE, inverse))


def line_keys(lines: list[str], max_edits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(line, key, indexed, parity): every index and probe key of the lines.

    `line` is a place in the list; `indexed` tells the keys of a line's own segments, which also probe lines of its length.
    """
    size = np.array([len(x) for x in lines], np.int64)
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    begin = np.cumsum(size) - size
    power, inverse = _powers(len(codes))
    owner = np.repeat(np.arange(len(lines)), size)
    with np.errstate(over="ignore"):
        prefix = np.concatenate([[np.uint64(0)], np.cumsum((codes + np.uint64(11)) * power[: len(codes)], dtype=np.uint64)])
        k = max_edits + 1
        out_line, out_key, out_own = [], [], []
        for delta in range(max_edits + 1):
            length = size - delta
            short, longer = length // k, length % k
            for i in range(k):
                n_short = k - longer
                width = short + (i >= n_short)
                start = i * short + np.maximum(0, i - n_short)
                low = max(-i, delta - (max_edits - i))
                high = min(i, delta + (max_edits - i))
                for shift in range(low, high + 1):
                    at = start + shift
                    ok = (width > 0) & (at >= 0) & (at + width <= size)
                    a, b = (begin + at)[ok], (begin + at + width)[ok]
                    h = (prefix[b] - prefix[a]) * inverse[a]
                    h = (h ^ (h >> np.uint64(29)) ^ (length[ok].astype(np.uint64) * BASE) ^ np.uint64(i + 1)) * MIX
                    h = (h ^ (h >> np.uint64(32))) * MIX
                    out_line.append(np.flatnonzero(ok))
                    out_key.append(h)
                    out_own.append(np.full(len(h), delta == 0 and shift == 0))
    odd = np.zeros((len(lines), 64), np.uint8)
    counts = np.bincount(owner * 64 + (codes % np.uint64(64)).astype(np.int64), minlength=64 * len(lines)).reshape(-1, 64) & 1
    odd[:] = counts
    parity = np.packbits(odd, axis=1, bitorder="little").view(np.uint64)[:, 0] if len(lines) else np.zeros(0, np.uint64)
    return np.concatenate(out_line), np.concatenate(out_key), np.concatenate(out_own), parity


def edit_distances(a: list[str], b: list[str], band: int) -> np.ndarray:
    """Edit distances of a[i] and b[i] up to `band`; band + 1 stands for more. Bit-parallel over the 2 band + 1 diagonals.

    Bits of one 64-bit word hold the vertical differences inside the band of a column and slide down one row a step; all
    pairs advance together, a column at a time.
    """
    n = len(a)
    if 2 * band + 1 > 62:
        raise ValueError("the band must fit a word")
    la, lb = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    out = np.full(n, band + 1, np.int64)
    live = np.flatnonzero(np.abs(la - lb) <= band)
    if not len(live):
        return out
    live = live[np.argsort(-lb[live], kind="stable")]
    la, lb = la[live], lb[live]
    width, height = int(lb.max()), int(la.max())
    rows = np.zeros((height + 2 * band + 2 + width, len(live)), np.uint32)  # a, shifted down by band
    cols = np.zeros((max(1, width), len(live)), np.uint32)
    for c, i in enumerate(live):
        rows[band : band + len(a[i]), c] = np.frombuffer(a[i].encode("utf-32-le", "surrogatepass"), np.uint32) + np.uint32(1)
        cols[: len(b[i]), c] = np.frombuffer(b[i].encode("utf-32-le", "surrogatepass"), np.uint32) + np.uint32(1)
    one, span = np.uint64(1), 2 * band + 1
    # before column j, bit r stands for character j - band + r of a
    top = np.uint64((1 << span) - 1)
    vp = np.full(len(live), np.uint64(((1 << (band + 1)) - 1) << band), np.uint64)
    vn = np.full(len(live), np.uint64(0))
    score = np.full(len(live), band, np.int64)  # at the band's last row of the column
    ended = np.zeros(len(live), np.int64)
    active = len(live)
    for j in range(width):
        active = int(np.searchsorted(-lb, -j, side="left"))  # pairs with more than j columns
        if not active:
            break
        s = slice(0, active)
        match = np.zeros(active, np.uint64)
        for r in range(span):
            match |= (rows[j + r, s] == cols[j, s]).astype(np.uint64) << np.uint64(r)
        p, q = vp[s], vn[s]
        zero = ((((match & p) + p) ^ p) | match | q) & top
        hp = (q | ~(zero | p)) & top
        hn = p & zero
        x = zero >> one
        last = np.uint64(span - 1)
        score[s] += 1 - ((zero >> last) & one).astype(np.int64)
        vp[s] = (hn | ~(x | hp)) & top
        vn[s] = hp & x
    # walk up from the band's last row to the row of a's end
    for c in range(len(live)):
        value, row = int(score[c]), int(lb[c]) + band
        v, w = int(vp[c]), int(vn[c])
        r = span - 2
        while row > la[c]:
            value -= (v >> r) & 1
            value += (w >> r) & 1
            row, r = row - 1, r - 1
        ended[c] = value
    out[live] = np.minimum(ended, band + 1)
    return out


def _occurrences(plan: LinePlan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, h1, h2 = [], [], []
            for d, text in zip(b.column(0).to_pylist(), map(pa.StringScalar.as_py, b.column(1)), strict=True):
                found = line_ids(text, plan.min_exact)
                doc += [d] * len(found)
                h1 += [x[2] for x in found]
                h2 += [x[3] for x in found]
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64())], names=["doc_id", "h1", "h2"])

    return run


def _keyed(plan: LinePlan, chars: int = 400_000, remembered: int = 100_000):
    """Index and probe keys of the batches' distinct lines. `remembered` lines of a task are not sent twice, a map-side combine; the reader drops what is left."""

    def emit(lines: list[str], ids: list[int]) -> pa.RecordBatch:
        line, key, own, parity = line_keys(lines, plan.max_edits)
        key = (key & ~np.uint64(1)) | own.astype(np.uint64)
        columns = [key.view(np.int64), np.array(ids, np.int64)[line], parity.view(np.int64)[line]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "id", "parity"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        lines, ids, size = [], [], 0
        for b in batches:
            for text in map(pa.StringScalar.as_py, b.column(0)):
                for _, line, h1, h2 in line_ids(text, plan.min_chars):
                    if (h1, h2) in seen:
                        continue
                    if len(seen) >= remembered:
                        seen.clear()
                    seen.add((h1, h2))
                    lines.append(line)
                    ids.append(h1)
                    size += len(line)
                    if size >= chars:
                        yield emit(lines, ids)
                        lines, ids, size = [], [], 0
        if lines:
            yield emit(lines, ids)

    return run


def _grouped(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[tuple[bool, list[pa.Array]]]:
    """(whole, columns) of runs of whole groups out of batches sorted by their first column, a key whose lowest bit doesn't count.

    A group that grows beyond `most` rows comes in parts as it is read, not whole, so that no task holds more of it than that.
    """
    held: list[pa.Array] | None = None
    leaving = None  # the key of a group that comes in parts

    def keys(columns: list[pa.Array]) -> np.ndarray:
        return columns[0].to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(1)

    for got in batches:
        now = list(got.columns)
        if leaving is not None:
            n = int(np.searchsorted(keys(now), leaving, side="right"))
            if n:
                yield False, [x[:n] for x in now]
            now = [x[n:] for x in now]
        if not len(now[0]):
            continue
        leaving = None
        if held is not None:
            now = [pa.concat_arrays([x, y]) for x, y in zip(held, now, strict=True)]
        key = keys(now)
        cut = int(np.searchsorted(key, key[-1], side="left"))
        held = [x[cut:] for x in now]
        if cut:
            yield True, [x[:cut] for x in now]
        if most is not None and len(held[0]) > most:
            leaving = key[-1]
            yield False, held
            held = None
    if held is not None:
        yield True, held


def _close(parity: np.ndarray, own: np.ndarray, plan: LinePlan) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places i < j in a group, one of them indexed, that pass the parity filter; a block of them at a time."""
    near = np.uint64(2 * plan.max_edits)
    for i in range(0, len(parity), plan.block):
        for k in range(i, len(parity), plan.block):
            if not own[i : i + plan.block].any() and not own[k : k + plan.block].any():
                continue
            found = np.bitwise_count(parity[i : i + plan.block][:, None] ^ parity[k : k + plan.block][None]) <= near
            found &= own[i : i + plan.block][:, None] | own[k : k + plan.block][None]
            x, y = np.nonzero(np.triu(found, 1) if i == k else found)
            if len(x):
                yield x + i, y + k


def _meet(plan: LinePlan, names: list[str]):
    """Of entries sorted by key, indexed ones first, those that have a partner in their group by the parity filter.

    Columns are key, id, parity and any others; `hot` comes behind them. The entries of a group of more than plan.hot rows
    all leave, as hot ones, unless the group has no indexed line. What leaves is at most what came.
    """

    def batch(columns: list[pa.Array], at: np.ndarray, hot: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(x.take(pa.array(at)) for x in columns), pa.array(np.full(len(at), hot))], names=[*names, "hot"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaving, keep = None, False  # the large group that leaves, and whether it has an indexed line
        for whole, columns in _grouped(batches, plan.hot):
            raw = columns[0].to_numpy(zero_copy_only=False).view(np.uint64)
            key, own = raw >> np.uint64(1), (raw & np.uint64(1)).astype(bool)
            if not whole:
                if key[0] != leaving:
                    leaving, keep = key[0], own[0]
                if keep:
                    yield batch(columns, np.arange(len(raw)), True)
                continue
            ids, parity = columns[1].to_numpy(zero_copy_only=False), columns[2].to_numpy(zero_copy_only=False).view(np.uint64)
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(starts, len(key)))
            two = starts[size == 2]
            fits = (ids[two] != ids[two + 1]) & (own[two] | own[two + 1]) & (np.bitwise_count(parity[two] ^ parity[two + 1]) <= 2 * plan.max_edits)
            kept = [two[fits], two[fits] + 1]
            for start, n in zip(starts[(size > 2) & own[starts]], size[(size > 2) & own[starts]], strict=True):
                at = np.arange(start, start + n)
                order = np.lexsort((~own[at], ids[at]))
                at = at[order[np.concatenate([[True], ids[at][order][1:] != ids[at][order][:-1]])]]  # an entry a line, the indexed one if there are both
                met = np.zeros(len(at), bool)
                for x, y in _close(parity[at], own[at], plan):
                    met[x] = met[y] = True
                kept.append(at[met])
            yield batch(columns, np.sort(np.concatenate(kept)), False)

    return run


def _pad(sets: list[np.ndarray], fill) -> np.ndarray:
    out = np.full((len(sets), max(map(len, sets))), fill, sets[0].dtype)
    for k, x in enumerate(sets):
        out[k, : len(x)] = x
    return out


NONE = np.uint64((1 << 64) - 1)


def _first_key(x: np.ndarray, y: np.ndarray, keys: np.ndarray, owned: np.ndarray) -> np.ndarray:
    """The smallest key under which the lines x[i] and y[i] meet, one of them indexed there; keys and owned are a row a line, padded."""
    out = np.full(len(x), NONE)
    for i in range(0, len(x), 20_000):
        a, b = keys[x[i : i + 20_000]], keys[y[i : i + 20_000]]
        p, q = owned[x[i : i + 20_000]], owned[y[i : i + 20_000]]
        best = out[i : i + 20_000]
        for c in range(a.shape[1]):
            met = ((a[:, c][:, None] == b) & (p[:, c][:, None] | q)).any(1) & (a[:, c] != NONE)
            np.minimum(best, np.where(met, a[:, c], NONE), out=best)
    return out


def part_masks(max_edits: int) -> list[int]:
    """The bits of 2 max_edits + 1 parts of a word: words that differ in at most 2 max_edits bits agree in one of the parts."""
    n = 2 * max_edits + 1
    return [sum(1 << bit for bit in range(part, 64, n)) for part in range(n)]


ENTRY = ["key", "id", "parity", "base", "part", "share", "low", "high"]


def _verified(plan: LinePlan, cells: int = 1_000_000):
    """Links of the lines of each group, a row a line that has any: id, h2, links, and late if one of them is earlier.

    Entries come as ENTRY, h2, doc_id, line_no and line, sorted by key. A pair counts where it meets first only: under the
    smallest key that it shares, in the first part of the parities that agree and in the cell of its two shares; so the
    links of a line add up over all groups.
    """
    masks = np.array(part_masks(plan.max_edits), np.uint64)

    def near(x: np.ndarray, y: np.ndarray, lines: list[str], size: np.ndarray) -> np.ndarray:
        out, order, i = np.zeros(len(x), bool), np.argsort(size[y], kind="stable"), 0
        width = size[y[order]] + plan.max_edits + 1
        while i < len(x):
            n = max(1, int(np.searchsorted(np.arange(1, len(x) - i + 1) * width[i:], cells, side="right")))
            at = order[i : i + n]
            out[at] = edit_distances([lines[k] for k in x[at]], [lines[k] for k in y[at]], plan.max_edits) <= plan.max_edits
            i += n
        return out

    def pairs(starts: np.ndarray, stops: np.ndarray, parity: np.ndarray, here: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        two = starts[stops - starts == 2]
        fits = (here[two] | here[two + 1]) & (np.bitwise_count(parity[two] ^ parity[two + 1]) <= 2 * plan.max_edits)
        found = [(two[fits], two[fits] + 1)]
        waiting = len(two)
        for i, j in zip(starts[stops - starts > 2], stops[stops - starts > 2], strict=True):
            for x, y in _close(parity[i:j], here[i:j], plan):
                found.append((x + i, y + i))
                waiting += len(x)
                if waiting > 100_000:
                    yield tuple(map(np.concatenate, zip(*found, strict=True)))
                    found, waiting = [], 0
        if found:
            yield tuple(map(np.concatenate, zip(*found, strict=True)))

    def scan(rows: dict[str, np.ndarray], lines: list[str]) -> pa.RecordBatch:
        line, key, own, parity = line_keys(lines, plan.max_edits)
        order = np.lexsort((key, line))
        line, key, own = line[order], key[order] >> np.uint64(1), own[order]
        cuts = np.searchsorted(line, np.arange(1, len(lines)))
        keys, owned = _pad(np.split(key, cuts), NONE), _pad(np.split(own, cuts), False)
        here = ((keys == rows["base"][:, None]) & owned).any(1)
        links, late = np.zeros(len(lines), np.int64), np.zeros(len(lines), bool)
        rank = np.lexsort((rows["line_no"], rows["doc_id"])).argsort()
        size = np.array(list(map(len, lines)))
        starts = np.flatnonzero(np.concatenate([[True], rows["group"][1:] != rows["group"][:-1]]))
        for x, y in pairs(starts, np.append(starts[1:], len(lines)), parity, here):
            low, high = np.minimum(rows["share"][x], rows["share"][y]), np.maximum(rows["share"][x], rows["share"][y])
            keep = (low == rows["low"][x]) & (high == rows["high"][x]) & (np.abs(size[x] - size[y]) <= plan.max_edits)
            same = ((parity[x] ^ parity[y])[:, None] & masks) == 0
            keep &= (rows["part"][x] < 0) | (same.argmax(1) == rows["part"][x])
            x, y = x[keep], y[keep]
            keep = _first_key(x, y, keys, owned) == rows["base"][x]
            x, y = x[keep], y[keep]
            keep = near(x, y, lines, size)
            x, y = x[keep], y[keep]
            links += np.bincount(x, minlength=len(lines)) + np.bincount(y, minlength=len(lines))
            late[np.where(rank[x] > rank[y], x, y)] = True
        at = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(rows["id"][at]), pa.array(rows["h2"][at]), pa.array(links[at]), pa.array(late[at].astype(np.int32))], names=["id", "h2", "links", "late"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, columns in _grouped(batches):
            rows = {n: c.to_numpy(zero_copy_only=False) for n, c in zip([*ENTRY, "h2", "doc_id", "line_no"], columns, strict=False)}
            rows["base"], rows["group"] = rows["base"].view(np.uint64), rows.pop("key").view(np.uint64) >> np.uint64(1)
            order = np.lexsort((rows["h2"], rows["id"], rows["group"]))
            fresh = np.zeros(len(order), bool)
            for n in ("group", "id", "h2"):
                fresh |= np.concatenate([[True], rows[n][order][1:] != rows[n][order][:-1]])
            order = order[fresh]  # a row a line in each group
            group = rows["group"][order]
            size = pc.utf8_length(columns[-1]).to_numpy(zero_copy_only=False)[order]
            ends = np.flatnonzero(np.append(group[1:] != group[:-1], True)) + 1
            begin, total = 0, np.concatenate([[0], np.cumsum(size)])
            for end, after in zip(ends, [*ends[1:], None], strict=True):
                if after is None or total[after] - total[begin] > cells:
                    if end - begin > 1:
                        at = order[begin:end]
                        yield scan({n: v[at] for n, v in rows.items()}, columns[-1].take(pa.array(at)).to_pylist())
                    begin = end

    return run


def _dealt(entries: DataFrame) -> DataFrame:
    group = F.shiftrightunsigned("key", 1)  # upper 63 bits, positive, so that they sort as unsigned numbers
    return entries.repartition(group).sortWithinPartitions(group, F.desc("key"))


def _refined(hot: DataFrame, plan: LinePlan) -> DataFrame:
    """Entries of hot groups by parts of their parities, and parts that are hot still in cells: shares of half plan.hot lines, any
    two of which meet in one. (key, id, parity) become ENTRY."""
    own = F.col("key").bitwiseAND(F.lit(1))
    hot = hot.groupBy(F.shiftrightunsigned("key", 1).alias("base"), "id", "parity").agg(F.max(own).alias("own"))
    parts = F.array(*(F.struct(F.lit(k).cast("long").alias("part"), F.xxhash64("base", F.lit(k), F.col("parity").bitwiseAND(F.lit(_signed(m)))).alias("h")) for k, m in enumerate(part_masks(plan.max_edits))))
    hot = hot.select("*", F.explode(parts).alias("p")).select("base", "id", "parity", "own", "p.part", "p.h")
    sizes = durable(hot.groupBy("h").agg(F.ceil(F.count("*") * 2 / plan.hot).cast("long").alias("shares"), F.count("*").alias("n"), F.max("own").alias("any")).where("n > 1 and any = 1"))
    hot = hot.join(_bounded(sizes.select("h", F.when(F.col("n") <= plan.hot, 1).otherwise(F.col("shares")).alias("shares")), plan), "h")
    share = F.pmod("id", "shares")
    hot = hot.select("*", share.alias("share"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("other"))
    low, high = F.least("share", "other"), F.greatest("share", "other")
    key = F.shiftleft(F.shiftrightunsigned(F.xxhash64("h", low, high), 1), 1).bitwiseOR(F.col("own"))
    return hot.select(key.alias("key"), "id", "parity", "base", "part", "share", low.alias("low"), high.alias("high"))


def _candidates(keys: DataFrame, plan: LinePlan) -> DataFrame:
    """ENTRY rows: the places (a key, and what it was refined by) where lines meet another by the parity filter, no more of them than entries."""
    met = durable(_dealt(keys).mapInArrow(_meet(plan, ["key", "id", "parity"]), "key long, id long, parity long, hot boolean"))
    zero = F.lit(0).cast("long")
    found = met.where("not hot").select("key", "id", "parity", F.shiftrightunsigned("key", 1).alias("base"), F.lit(-1).cast("long").alias("part"), zero.alias("share"), zero.alias("low"), zero.alias("high"))
    hot = met.where("hot")
    if hot.isEmpty():
        return found
    schema = ", ".join(f"{c} long" for c in ENTRY)
    whole = LinePlan(**{**plan.__dict__, "hot": 1 << 40})  # cells hold no more than plan.hot lines
    again = durable(_dealt(_refined(hot, plan)).mapInArrow(_meet(whole, ENTRY), f"{schema}, hot boolean"))
    return found.unionByName(again.drop("hot"))


def _texts(plan: LinePlan):
    """(id, h2, doc_id, line_no, line) of the wanted lines of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for d, text, want in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                want = set(want)
                out += [(h1, h2, d, k, line) for k, line, h1, h2 in line_ids(text, plan.min_chars) if h1 in want]
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(),) * 3 + (pa.int32(), pa.string()), strict=True)], names=["id", "h2", "doc_id", "line_no", "line"])

    return run


def _bounded(df: DataFrame, plan: LinePlan) -> DataFrame:
    """df to be broadcast if its rows are within the bound; else joined by a shuffle."""
    return F.broadcast(df) if df.count() <= plan.broadcast_rows else df


def near_links(docs: DataFrame, firsts: DataFrame, plan: LinePlan) -> DataFrame:
    """(h1, h2, links, late): distinct lines that lie within max_edits edits of others, how many, and whether one of those comes
    earlier; order is by first document, then line."""
    keys = docs.select("text").mapInArrow(_keyed(plan), "key long, id long, parity long")
    places = durable(_candidates(keys, plan))
    ids = places.select("id").distinct()
    wanted = firsts.join(ids, firsts["h1"] == ids["id"]).groupBy("doc_id").agg(F.collect_set("h1").alias("want"))
    lines = durable(docs.join(durable(wanted), "doc_id").select("doc_id", "text", "want").mapInArrow(_texts(plan), "id long, h2 long, doc_id long, line_no int, line string"))
    lines = lines.groupBy("id", "h2", "line").agg(F.min(F.struct("doc_id", "line_no")).alias("place"))
    lines = lines.select("id", "h2", "place.doc_id", F.col("place.line_no").cast("long").alias("line_no"), "line")
    met = _dealt(places.join(lines, "id").select(*ENTRY, "h2", "doc_id", "line_no", "line"))
    links = met.mapInArrow(_verified(plan), "id long, h2 long, links long, late int")
    return durable(links.groupBy(F.col("id").alias("h1"), "h2").agg(F.sum("links").alias("links"), F.max("late").alias("late")))


def duplicate_lines(docs: DataFrame, plan: LinePlan = LinePlan()) -> DataFrame:
    """(doc_id, drop, n_near, n_links): for the documents that have any, the first hashes of lines that an earlier line repeats
    (`drop`), how many of those are near repeats only, and how many links to different lines the document's lines have.

    `docs` has (doc_id, text) with doc_id not null. A line is repeated if it, or a line within max_edits edits of it, comes
    earlier: in a document of smaller doc_id, or further up in the same one.
    """
    occurrences = durable(docs.mapInArrow(_occurrences(plan), "doc_id long, h1 long, h2 long"))
    firsts = durable(occurrences.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")))
    near = near_links(docs, firsts, plan)
    marked = durable(firsts.join(near, ["h1", "h2"], "left").where("n > 1 or links is not null").withColumnRenamed("doc_id", "first_doc"))
    # a line with more than a thousandth of all occurrences, and there are no more than a thousand, meets them without a shuffle
    common = F.broadcast(marked.where(F.col("n") * 1000 > occurrences.count()))
    rest = occurrences.join(F.broadcast(common.select("h1", "h2")), ["h1", "h2"], "left_anti")
    told = occurrences.join(common, ["h1", "h2"]).unionByName(rest.join(marked, ["h1", "h2"]))
    again, late = F.col("doc_id") != F.col("first_doc"), F.coalesce(F.col("late") == 1, F.lit(False))
    told = told.select("doc_id", "h1", F.coalesce("links", F.lit(0)).alias("links"), again.alias("again"), late.alias("late"))
    drop = F.collect_set(F.when(F.col("again") | F.col("late"), F.col("h1")))
    return told.groupBy("doc_id").agg(drop.alias("drop"), F.count_if(F.col("late") & ~F.col("again")).alias("n_near"), F.sum("links").alias("n_links")).where("size(drop) > 0 or n_links > 0")


def strip_lines(text: str | None, drop: list[int] | None, plan: LinePlan) -> tuple[str | None, int]:
    """The text without the lines whose first hash is in drop and without repeats of its own lines; and how many lines went.

    Over all documents a line is known by two hashes; inside one document, one of them tells its lines apart.
    """
    if text is None:
        return None, 0
    gone = set() if drop is None else set(map(int, drop))
    seen, kept, n = set(), [], 0
    for line in text.split("\n"):
        bare = line.strip()
        if len(bare) >= plan.min_exact:
            if bare in seen or gone and _signed(xxhash.xxh64_intdigest(bare.encode("utf-8", "surrogatepass"), 1)) in gone:
                n += 1
                continue
            seen.add(bare)
        kept.append(line)
    return ("\n".join(kept), n) if n else (text, 0)


def _stripper(plan: LinePlan, at: int, found: int):
    """Batches with the text, column number `at`, stripped, and gone, n_near and n_links in place of the struct in column `found`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            told = b.column(found).to_pylist()
            new = [strip_lines(t, x and x["drop"], plan) for t, x in zip(map(pa.StringScalar.as_py, b.column(at)), told, strict=True)]
            columns = [pa.array([t for t, _ in new], pa.string()) if k == at else c for k, c in enumerate(b.columns) if k != found]
            counts = [[n for _, n in new], *([x[c] if x else 0 for x in told] for c in ("n_near", "n_links"))]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c, pa.int64()) for c in counts)], names=[str(k) for k in range(len(columns) + 3)])

    return run


def _deduplicated(docs: DataFrame, plan: LinePlan) -> DataFrame:
    """docs' columns by number from 0, the text stripped, then lines gone, n_near and n_links."""
    n, key, at = len(docs.columns), str(docs.columns.index("doc_id")), docs.columns.index("text")
    bare = docs.select(*(docs[c].alias(str(k)) for k, c in enumerate(docs.columns)))
    known = pick(docs, doc_id="doc_id", text="text").where("doc_id is not null")
    found = durable(duplicate_lines(known, plan).select(F.col("doc_id").alias("k"), F.struct("drop", "n_near", "n_links").alias("found")))
    # lists of lines grow with the corpus, so they are never broadcast; rows without doc_id stay out of the join
    joined = bare.where(F.col(key).isNotNull()).join(found, F.col(key) == found["k"], "left").drop("k")
    joined = joined.unionByName(bare.where(F.col(key).isNull()).withColumn("found", F.lit(None).cast(found.schema["found"].dataType)))
    counts = [T.StructField(str(n + k), T.LongType()) for k in range(3)]
    return joined.mapInArrow(_stripper(plan, at, n), T.StructType([*bare.schema.fields, *counts]))


def remove_repeated_lines(docs: DataFrame, plan: LinePlan = LinePlan()) -> DataFrame:
    """docs' own rows and columns, the text without lines that an earlier line repeats, exactly or within max_edits edits.

    Documents of which nothing but white space is left go; those that had nothing before, null texts included, stay. Rows
    without doc_id lose only repeats of their own lines. Rows that share a doc_id count as one document. Lines compare
    without outer white space, blank lines always stay, and a line of fewer than min_chars code points only goes for an equal
    one. A line of any length is read whole. An empty table gives an empty one.
    """
    told, n, text = _deduplicated(docs, plan), len(docs.columns), str(docs.columns.index("text"))
    return told.where((F.col(str(n)) == 0) | F.col(text).rlike(r"(?U)\S")).select(*(F.col(str(k)).alias(c) for k, c in enumerate(docs.columns)))


def lines_query(docs: DataFrame, plan: LinePlan = LinePlan()) -> DataFrame:
    """One row per document: doc_id, n_removed lines, n_near of them for a near repeat only, n_links to different lines, text left."""
    told = _deduplicated(pick(docs, doc_id="doc_id", text="text"), plan)
    return told.select(F.col("0").alias("doc_id"), F.col("2").alias("n_removed"), F.col("3").alias("n_near"), F.col("4").alias("n_links"), F.col("1").alias("text"))
