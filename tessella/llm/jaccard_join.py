"""N-gram Jaccard join under several global token orders.

Sets of word shingles as similar as the threshold share a token within a short prefix of each of them, under whatever
order all sets are sorted by. The first order puts frequent tokens last and generates candidates, whose places of the
token bound their overlap. Prefixes under the other orders are made beside the sets' bitmaps, and a candidate must share
tokens of every one of them, and pass the bitmaps, before any set is fetched and its overlap counted.

Documents with equal sets are one node. A token that few nodes have in their prefix pairs them all; of a token of many,
every node is paired with one of them only, that which lies nearest to what they all share, which suffices where all end
up in one component. The tokens for which it doesn't are found afterwards; those with the same centre are united, and
their nodes in different components, as far as their places let them link, compared in blocks: by bitmaps first, which
leaves the nodes that may link with any other, and then by whole sets. A pair of blocks gives nodes, and then no more
links than it takes to unite what it links, so no step makes more rows than a group has nodes, times its blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import textnum
from tessella.llm.cluster import lean, partitions, ship, skew_join, written
from tessella.llm.components import components
from tessella.llm.textnum import U

SMALL, BLOCK = 6, 4096
BITMAP_SHINGLES, SET_SHINGLES = 8_000_000, 1_000_000  # of a block, where bitmaps and where sets are compared
SHORT = 100  # a prefix of so many tokens is kept by 16 bits of each, a longer one by 32
BROADCAST_ROWS = 500_000  # ids and numbers of 16 bytes each
ORDERS = (0x8CB92BA72F3D8DD7, 0xD6E8FEB86659FD93)  # besides the first
TOKEN = np.dtype([("token", "<u8"), ("node", "<i8"), ("n", "<i4"), ("at", "<i4")])


def shingles(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending hashes of each text's distinct shingles, and n + 1 offsets. Fewer than k words make one shingle, none make none."""
    hashes, bounds = textnum.words(textnum.lower_ascii(column))[3:]
    sizes = np.diff(bounds)
    counts = np.where(sizes >= k, sizes - k + 1, np.minimum(sizes, 1))
    offsets = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(offsets[-1], U)
    full = np.flatnonzero(sizes >= k)
    windows = textnum.window_hashes(hashes, k)
    out[textnum.ranges(offsets[full], counts[full])] = windows[textnum.ranges(bounds[full], counts[full])]
    for n in range(1, k):
        few = np.flatnonzero(sizes == n)
        if len(few):
            out[offsets[few]] = textnum.window_hashes(hashes, n)[bounds[few]]
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        out[a:b].sort()
    fresh = np.ones(len(out), bool)
    fresh[1:] = out[1:] != out[:-1]
    fresh[offsets[:-1][counts > 0]] = True
    return out[fresh], np.concatenate([[0], np.cumsum(textnum.segment_sums(fresh, offsets))])


def set_ids(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit number for each set, equal for equal sets."""
    with np.errstate(over="ignore"):
        sums = np.zeros(len(values) + 1, U)
        np.cumsum(textnum.mix(values ^ U(0x5851F42D4C957F2D)), out=sums[1:])
        return textnum.mix(sums[offsets[1:]] - sums[offsets[:-1]] + np.diff(offsets).astype(U) * U(0xA24BAED4963EE407)).view(np.int64)


def bitmaps(values: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """For each set a bitmap of a power of two of bits, four or more a value, so that long sets don't fill theirs."""
    n = np.diff(offsets)
    size = 1 << np.maximum(8, np.ceil(np.log2(np.maximum(4 * n, 1)))).astype(np.int64)
    begin = np.cumsum(size) - size
    bits = np.zeros(int(size.sum()), bool)
    bits[np.repeat(begin, n) + (values & np.repeat(size - 1, n).astype(U)).astype(np.int64)] = True
    data = np.packbits(bits, bitorder="little").tobytes()
    return [data[a // 8 : (a + m) // 8] for a, m in zip(begin.tolist(), size.tolist(), strict=True)]


class Bitmaps:
    """Bitmaps by size; a larger one folds to a smaller by uniting its halves."""

    def __init__(self, each: list[bytes]):
        self.size = np.array([len(x) for x in each], np.int64)
        self.row = np.zeros(len(each), np.int64)
        self.of: dict[int, np.ndarray] = {}
        for size in np.unique(self.size).tolist():
            at = np.flatnonzero(self.size == size)
            self.row[at] = np.arange(len(at))
            self.of[size] = np.frombuffer(b"".join(each[i] for i in at), np.uint64).reshape(len(at), size // 8)

    def only(self, other: Bitmaps, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many bits only the one, and only the other, of each pair has."""
        left, right = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        both = self.size[i] * (1 << 32) + other.size[j]
        for kind in np.unique(both).tolist():
            at = np.flatnonzero(both == kind)
            for at in np.array_split(at, max(1, len(at) * (kind & 0xFFFFFFFF) >> 24)):
                a, b = self.of[kind >> 32][self.row[i[at]]], other.of[kind & 0xFFFFFFFF][other.row[j[at]]]
                while a.shape[1] > b.shape[1]:
                    a = a[:, : a.shape[1] // 2] | a[:, a.shape[1] // 2 :]
                while b.shape[1] > a.shape[1]:
                    b = b[:, : b.shape[1] // 2] | b[:, b.shape[1] // 2 :]
                left[at], right[at] = np.bitwise_count(a & ~b).sum(1, np.int64), np.bitwise_count(b & ~a).sum(1, np.int64)
        return left, right


def binaries(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of binary arrays, and n + 1 offsets."""
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, kind), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return np.frombuffer(data.tobytes(), kind), (offsets - offsets[0]) // np.dtype(kind).itemsize


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two ascending arrays without repetitions share."""
    if len(x) > len(y):
        x, y = y, x
    at = y.searchsorted(x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum()) if len(y) else 0


class Joiner:
    """The join for shingles of k words and 100 * intersection >= percent * union."""

    def __init__(self, k: int, percent: int, frequent: float):
        self.k, self.percent, self.frequent = k, percent, frequent

    def prefix_sizes(self, n: np.ndarray) -> np.ndarray:
        return n - (self.percent * n + 99) // 100 + 1

    def alike_in_size(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return 100 * np.minimum(a, b) >= self.percent * np.maximum(a, b)

    def least_overlap(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The smallest intersection with which sets of these sizes link."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def in_reach(self, na, at_a, nb, at_b) -> np.ndarray:
        """False where sets of these sizes, whose first common token has these places, can't link: what comes before it isn't shared."""
        need = self.least_overlap(na, nb)
        return self.alike_in_size(na, nb) & (na - at_a >= need) & (nb - at_b >= need)

    def in_reach_sql(self, na: str, at_a: str, nb: str, at_b: str) -> str:
        need = f"ceil({self.percent} * ({na} + {nb}) / {100 + self.percent})"
        return f"least({na}, {nb}) * 100 >= greatest({na}, {nb}) * {self.percent} and {na} - {at_a} >= {need} and {nb} - {at_b} >= {need}"

    def profile(self, parts, key: str, text: str):
        """A row for each document, and the tokens that many of a task's nodes have, with their numbers."""
        pending, nodes, met = [], 0, set()

        def flush():
            tokens, counts = np.unique(np.concatenate(pending), return_counts=True)
            often = counts >= max(2, int(nodes * self.frequent / 4))
            n = int(often.sum())
            return pa.RecordBatch.from_arrays([pa.nulls(n, kind), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.array(tokens[often].view(np.int64)), pa.array(counts[often])], names)

        names, kind = [key, "n", "node", "token", "count"], pa.int64()
        for part in textnum.slices(parts, text):
            values, offsets = shingles(part.column(text), self.k)
            ids, n, kind = set_ids(values, offsets), np.diff(offsets), part.schema.field(key).type
            rows = part.num_rows
            yield pa.RecordBatch.from_arrays([part.column(key), pa.array(n.astype(np.int32)), pa.array(ids), pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.int64())], names)
            new = self.first_met(ids, n, met)
            nodes += len(new)
            pending.append(values[textnum.ranges(offsets[new], n[new])])
            if sum(map(len, pending)) > 6_000_000:
                yield flush()
                pending, nodes = [], 0
        if pending:
            yield flush()

    @staticmethod
    def first_met(ids: np.ndarray, n: np.ndarray, met: set) -> np.ndarray:
        """Rows whose set is not empty and wasn't met in this task (as far as it remembers)."""
        if len(met) > 500_000:
            met.clear()
        out = []
        for i, (x, size) in enumerate(zip(ids.tolist(), n.tolist(), strict=True)):
            if size and x not in met:
                met.add(x)
                out.append(i)
        return np.array(out, np.int64)

    def prefixes(self, parts, text: str, frequent: np.ndarray, buckets: int):
        """Prefix tokens under the first order, packed by bucket; the frequent ones in negative buckets that need not stay together."""
        pending, met = [], set()

        def flush():
            rows = np.concatenate(pending)
            where = np.minimum(np.searchsorted(frequent, rows["token"]), max(len(frequent) - 1, 0))
            often = frequent[where] == rows["token"] if len(frequent) else np.zeros(len(rows), bool)
            bucket = (textnum.mix(rows["token"] ^ np.where(often, rows["node"].view(U), U(0))) % U(buckets)).astype(np.int64)
            bucket = np.where(often, -1 - bucket, bucket)
            order = np.argsort(bucket, kind="stable")
            rows, bucket = rows[order], bucket[order]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(rows)]]) if len(rows) else np.zeros(1, np.int64)
            pairs = [(int(bucket[a]), rows[a:b].tobytes()) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int32()), pa.array([p[1] for p in pairs], pa.binary())], ["bucket", "data"])

        for part in textnum.slices(parts, text):
            values, offsets = shingles(part.column(text), self.k)
            n = np.diff(offsets)
            ids = set_ids(values, offsets)
            new = self.first_met(ids, n, met)
            owner = np.repeat(np.arange(len(new)), n[new])
            values = values[textnum.ranges(offsets[new], n[new])]
            begin = np.cumsum(n[new]) - n[new]
            where = np.minimum(np.searchsorted(frequent, values), max(len(frequent) - 1, 0))
            often = frequent[where] == values if len(frequent) else np.zeros(len(values), bool)
            rare = np.concatenate([[0], np.cumsum(~often)])
            rare_before = rare[:-1] - rare[begin][owner]
            n_rare = rare[begin + n[new]] - rare[begin]
            place = np.where(often, n_rare[owner] + (np.arange(len(values)) - begin[owner] - rare_before), rare_before)
            chosen = place < self.prefix_sizes(n[new])[owner]
            rows = np.empty(int(chosen.sum()), TOKEN)
            rows["token"], rows["node"], rows["n"], rows["at"] = values[chosen], ids[new][owner[chosen]], n[new][owner[chosen]], place[chosen]
            pending.append(rows)
            if sum(map(len, pending)) > 1_500_000:
                yield flush()
                pending = []
        if pending:
            yield flush()

    def groups(self, parts):
        """Of rows sorted by bucket: candidate pairs of the bucket's tokens, rows (a, b, null..), and the members of its large groups, rows (node, null, token, n, at).

        Frequent tokens of a negative bucket come back as members, too.
        """
        names = ["a", "b", "token", "n", "at"]

        def members(rows: np.ndarray) -> pa.RecordBatch:
            columns = (np.ascontiguousarray(rows[c]) for c in ("node", "token", "n", "at"))
            node, token, n, at = (pa.array(c.view(np.int64) if c.dtype == U else c) for c in columns)
            return pa.RecordBatch.from_arrays([node, pa.nulls(len(rows), pa.int64()), token, n, at], names)

        def of(pending: list[bytes], frequent: bool):
            rows = np.unique(np.frombuffer(b"".join(pending), TOKEN))
            if frequent:
                yield members(rows)
                return
            new = np.ones(len(rows), bool)
            new[1:] = rows["token"][1:] != rows["token"][:-1]
            begin = np.flatnonzero(new)
            size = np.diff(np.append(begin, len(rows)))
            n, at = rows["n"].astype(np.int64), rows["at"].astype(np.int64)
            smallest = np.repeat(np.minimum.reduceat(n, begin), size) if len(rows) else n
            a, b = [], []
            for step in range(1, SMALL):  # pairs of small groups
                group = np.flatnonzero((size > step) & (size <= SMALL))
                left = textnum.ranges(begin[group], size[group] - step)
                a.append(left)
                b.append(left + step)
            a, b = np.concatenate(a), np.concatenate(b)
            fits = self.in_reach(n[a], at[a], n[b], at[b])
            pairs = np.stack([rows["node"][a[fits]], rows["node"][b[fits]]], 1)
            pairs = np.unique(np.stack([pairs.min(1), pairs.max(1)], 1), axis=0) if len(pairs) else pairs
            none = [pa.nulls(len(pairs), kind) for kind in (pa.int64(), pa.int32(), pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1])), *none], names)
            least = np.maximum(smallest, -(-self.percent * n // 100))  # no member that links is smaller
            yield members(rows[np.repeat(size > SMALL, size) & (n - at >= self.least_overlap(n, least))])

        at, pending = None, []
        for part in parts:
            for bucket, data in zip(part.column("bucket").to_pylist(), part.column("data").to_pylist(), strict=True):
                if bucket != at and pending:
                    yield from of(pending, at < 0)
                    pending = []
                at = bucket
                pending.append(data)
        if pending:
            yield from of(pending, at < 0)

    def may_link(self, na: np.ndarray, nb: np.ndarray, only_a: np.ndarray, only_b: np.ndarray) -> np.ndarray:
        """False where the sizes, or the bits that only one of the bitmaps has, rule a link out. A link always passes."""
        need = self.least_overlap(na, nb)
        return self.alike_in_size(na, nb) & (only_a <= na - need) & (only_b <= nb - need)

    def heads(self, values: np.ndarray) -> bytes:
        """A set's prefixes under the orders but the first, one after the other, in 16 or 32 bits a token."""
        size = int(self.prefix_sizes(np.array([len(values)]))[0])
        out = []
        for salt in ORDERS:
            ranks = textnum.mix(values ^ U(salt))
            out.append(values[np.argpartition(ranks, size - 1)[:size]] if size < len(values) else values)
        return np.concatenate(out).astype("<u2" if size <= SHORT else "<u4").tobytes()

    def signatures(self, parts, text: str):
        """(node, n, bits, heads) of each set, once a task as far as it remembers."""
        for ids, values, offsets in self.sets_of(parts, text):
            heads = [self.heads(values[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.diff(offsets).astype(np.int32)), pa.array(bitmaps(values, offsets), pa.binary()), pa.array(heads, pa.binary())], ["node", "n", "bits", "heads"])

    def bits(self, parts, text: str):
        """(node, bits) of each set, once a task as far as it remembers."""
        for ids, values, offsets in self.sets_of(parts, text):
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(bitmaps(values, offsets), pa.binary())], ["node", "bits"])

    def whole_sets(self, parts, text: str):
        """(node, shingles) of each set, once a task as far as it remembers."""
        for ids, values, offsets in self.sets_of(parts, text):
            shingles_ = [values[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(shingles_, pa.binary())], ["node", "shingles"])

    def sets_of(self, parts, text: str):
        met: set = set()
        for part in textnum.slices(parts, text):
            values, offsets = shingles(part.column(text), self.k)
            ids, n = set_ids(values, offsets), np.diff(offsets)
            new = self.first_met(ids, n, met)
            yield ids[new], values[textnum.ranges(offsets[new], n[new])], np.concatenate([[0], np.cumsum(n[new])])

    def meet(self, a: pa.Array, b: pa.Array, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
        """Whether the prefixes of each pair share a token under every order but the first."""
        sides = []
        for column, n in ((a, na), (b, nb)):
            size = self.prefix_sizes(n)
            raw, offsets = binaries(column, np.uint16)
            wide = size > SHORT
            tokens = np.empty(int((len(ORDERS) * size).sum()), np.uint32)
            begin = np.cumsum(len(ORDERS) * size) - len(ORDERS) * size
            for some, step in ((~wide, 1), (wide, 2)):
                into, out = (textnum.ranges(x[some], len(ORDERS) * size[some] * by) for x, by in ((begin, 1), (offsets[:-1], step)))
                tokens[into] = raw[out] if step == 1 else np.ascontiguousarray(raw[out]).view(np.uint32)
            sides.append((tokens, begin, size, wide))
        short = ~(sides[0][3] & sides[1][3])
        passed = np.ones(len(na), bool)
        for order in range(len(ORDERS)):
            keys = []
            for tokens, begin, size, _ in sides:
                owner = np.repeat(np.arange(len(size)), size)
                own = tokens[textnum.ranges(begin + order * size, size)]
                own = np.where(short[owner], own & np.uint32(0xFFFF), own)
                keys.append(np.unique(owner.astype(U) << U(32) | own))
            both = np.intersect1d(*keys, assume_unique=True) >> U(32)
            passed &= np.bincount(both.astype(np.int64), minlength=len(na)) > 0
        return passed

    def sift(self, parts):
        """Of rows (a, b, na, nb, bits_a, bits_b, heads_a, heads_b) the pairs whose prefixes meet under every order and that may link by sizes and bitmaps."""
        for whole in parts:
            for part in (whole.slice(i, 4096) for i in range(0, whole.num_rows, 4096)):
                na, nb = (part.column(c).to_numpy().astype(np.int64) for c in ("na", "nb"))
                part = part.filter(pa.array(self.meet(part.column("heads_a"), part.column("heads_b"), na, nb)))
                na, nb = (part.column(c).to_numpy().astype(np.int64) for c in ("na", "nb"))
                a, b = (Bitmaps(part.column(c).to_pylist()) for c in ("bits_a", "bits_b"))
                each = np.arange(part.num_rows)
                passed = pa.array(self.may_link(na, nb, *a.only(b, each, each)))
                yield pa.RecordBatch.from_arrays([part.column(c).filter(passed) for c in ("a", "b")], ["a", "b"])

    def verify(self, parts):
        """Of rows (a, b, shingles_a, shingles_b) those that overlap enough."""
        for whole in parts:
            for part in (whole.slice(i, 1024) for i in range(0, whole.num_rows, 1024)):
                (va, oa), (vb, ob) = (binaries(part.column(c), U) for c in ("shingles_a", "shingles_b"))
                linked = np.zeros(part.num_rows, bool)
                for i in range(part.num_rows):
                    linked[i] = self.linked(va[oa[i] : oa[i + 1]], vb[ob[i] : ob[i + 1]])
                yield pa.RecordBatch.from_arrays([part.column(c).filter(pa.array(linked)) for c in ("a", "b")], ["a", "b"])

    def linked(self, x: np.ndarray, y: np.ndarray) -> bool:
        both = overlap(x, y)
        return 100 * both >= self.percent * (len(x) + len(y) - both)

    def passing(self, left: dict, right: dict, same: bool):
        """Places of the pairs of two blocks, of different components, that sizes, places and bitmaps let link."""
        step = max(1, 2_000_000 // max(1, len(right["n"])))
        for begin in range(0, len(left["n"]), step):
            rows = slice(begin, begin + step)
            passed = left["root"][rows, None] != right["root"][None, :]
            passed &= self.in_reach(left["n"][rows, None], left["at"][rows, None], right["n"][None, :], right["at"][None, :])
            if same:
                passed &= left["node"][rows, None] < right["node"][None, :]
            x, y = np.nonzero(passed)
            x = x + begin
            good = self.may_link(left["n"][x], right["n"][y], *left["bits"].only(right["bits"], x, y))
            yield x[good], y[good]

    def near(self, frame):
        """The nodes of a pair of blocks that may link with any other. frame: centre, i, j, block, node, root, at, n, bits."""
        import pandas as pd

        i, j = frame["i"].iloc[0], frame["j"].iloc[0]
        sides = []
        for block in dict.fromkeys((i, j)):
            own = frame[frame["block"] == block]
            sides.append({c: own[c].to_numpy(np.int64) for c in ("node", "root", "at", "n")} | {"bits": Bitmaps(own["bits"].tolist())})
        left, right, found = sides[0], sides[-1], set()
        for x, y in self.passing(left, right, i == j):
            found.update(left["node"][np.unique(x)].tolist())
            found.update(right["node"][np.unique(y)].tolist())
        return pd.DataFrame({"centre": np.full(len(found), frame["centre"].iloc[0], np.int64), "node": np.array(sorted(found), np.int64)})

    def across(self, frame):
        """Links that unite what a pair of blocks links: one for each two components that become one. frame: i, j, block, node, root, at, shingles."""
        import pandas as pd

        i, j = frame["i"].iloc[0], frame["j"].iloc[0]
        sides = []
        for block in dict.fromkeys((i, j)):
            own = frame[frame["block"] == block]
            sets = [np.frombuffer(x, U) for x in own["shingles"]]
            n = np.array([len(x) for x in sets], np.int64)
            bits = Bitmaps(bitmaps(np.concatenate(sets), np.concatenate([[0], np.cumsum(n)]))) if len(sets) else Bitmaps([])
            sides.append({c: own[c].to_numpy(np.int64) for c in ("node", "root", "at")} | {"n": n, "sets": sets, "bits": bits})
        left, right = sides[0], sides[-1]
        top: dict[int, int] = {}

        def find(x: int) -> int:
            while x in top:
                x = top[x]
            return x

        out = []
        for x, y in self.passing(left, right, i == j):
            for p, q in zip(x.tolist(), y.tolist(), strict=True):
                u, v = find(int(left["root"][p])), find(int(right["root"][q]))
                if u != v and self.linked(left["sets"][p], right["sets"][q]):
                    top[max(u, v)] = min(u, v)
                    out.append((int(left["node"][p]), int(right["node"][q])))
        return pd.DataFrame({"a": np.array([min(x) for x in out], np.int64), "b": np.array([max(x) for x in out], np.int64)})


def in_blocks(nodes: DataFrame, shingles: int) -> DataFrame:
    """nodes (centre, node, n, at, root) of the groups that more than one component has a part in, with each group's number of blocks."""
    sizes = nodes.groupBy("centre").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("total"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("total") / shingles)).cast("int")
    sizes = written(sizes.select("centre", "m", blocks.alias("blocks")), "sizes")
    return written(skew_join(nodes, sizes, ["centre"], "m").select("centre", "node", "n", "at", "root", "blocks"), "compared")


def block_pairs(own: DataFrame) -> DataFrame:
    """A row for each node and each block of its group, with the pair (i, j) of its own block and that one."""
    own = own.withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), "blocks").cast("int"))
    spread = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return spread.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("blocks", "other")


def similar(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, frequent: float = 0.0001) -> DataFrame:
    """(key, n_shingles, component_id) for every row of docs: similar texts are linked, component_id is the smallest key reachable.

    Texts are linked when 100 * intersection >= percent * union of their sets of distinct k-word shingles, A-Z
    lower-cased. With fewer words the whole sequence is the one shingle. Null texts, empty ones and those without words
    have no shingle and link with nothing, not even each other. Repeated rows (equal keys) stay apart as rows, whatever
    their texts. Rows with a null key link like others; component_id is null only where no row of a component has a
    key. Other columns of docs are left out. An empty table gives an empty result; very long texts take
    part whole.

    frequent: tokens in so large a part of a task's nodes count as frequent; there are at most (mean set size) /
    (frequent * 3 / 4) of them whatever the table's size, so their list is broadcast. Sets are told apart by 64-bit
    hashes of their sorted shingle hashes.
    """
    spark = docs.sparkSession
    ship(spark)
    join = Joiner(k, percent, frequent)
    kind = docs.schema[key].dataType.simpleString()
    docs = docs.select(key, text)
    table = written(docs.mapInArrow(lean(lambda parts: join.profile(parts, key, text)), f"`{key}` {kind}, n int, node bigint, token bigint, count bigint"), "profile")
    rows = table.where("token is null").select(key, "n", "node")
    totals = rows.agg(F.count(F.lit(1)).alias("docs"), F.sum(F.when(F.col("n") > 0, (F.col("n") * (100 - percent)) / 100 + 1)).alias("tokens")).first()
    often = table.where("token is not null").groupBy("token").agg(F.sum("count").alias("count")).where(F.col("count") >= max(8.0, totals["docs"] * frequent))
    frequent_tokens = spark.sparkContext.broadcast(np.sort(np.array([r["token"] for r in often.select("token").toLocalIterator()], np.int64).view(U)))
    buckets = max(partitions(spark), int((totals["tokens"] or 0) // 1_000_000) + 1)
    packed = docs.mapInArrow(lean(lambda parts: join.prefixes(parts, text, frequent_tokens.value, buckets)), "bucket int, data binary")
    gathered = packed.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    found = written(gathered.mapInArrow(lean(join.groups), "a bigint, b bigint, token bigint, n int, at int"), "candidates")
    reps = written(rows.where("n > 0").groupBy("node").agg(F.min(key).alias("_rep")), "nodes")

    def fetched(nodes: DataFrame, make, schema: str) -> DataFrame:
        """What make gives for the sets of these nodes, a row for each; one document of each set is read again."""
        wanted = written(nodes.distinct().join(reps, "node"), "wanted")
        small = wanted.count() <= BROADCAST_ROWS  # else the documents are shuffled
        keys, nodes = wanted.where("_rep is not null").select("_rep").distinct(), wanted.select("node")
        near = docs.withColumnRenamed(key, "_rep").select("_rep", text)
        some = near.join(F.broadcast(keys) if small else keys, "_rep", "left_semi")
        if not wanted.where("_rep is null").isEmpty():  # sets found on rows without a key only
            some = some.unionByName(near.where("_rep is null"))
        # A key may stand on rows of different sets: each text goes by its own.
        some = some.select(text).mapInArrow(lean(lambda parts: make(parts, text)), schema)
        some = some.join(F.broadcast(nodes) if small else nodes, "node", "left_semi")
        return some.groupBy("node").agg(*(F.first(c).alias(c) for c in some.columns if c != "node"))

    def of_pairs(pairs: DataFrame, make, schema: str) -> DataFrame:
        """pairs (a, b) with the columns of what is fetched of both, named by side."""
        got = fetched(pairs.select(F.col("a").alias("node")).union(pairs.select("b")), make, schema)
        side = lambda x: got.select(F.col("node").alias(x), *(F.col(c).alias(f"n{x}" if c == "n" else f"{c}_{x}") for c in got.columns if c != "node"))
        return pairs.join(side("a"), "a").join(side("b"), "b")

    # Of a large group the centre is the member whose first token of any large group comes first: it has the least of its own.
    members = found.where("token is not null").select("token", F.col("a").alias("node"), "n", "at")
    members = written(members.join(members.groupBy("node").agg(F.min("at").alias("own")), "node"), "members")
    centres = written(members.groupBy("token").agg(F.min(F.struct("own", "node", "n", "at")).alias("p"), F.count(F.lit(1)).alias("m")), "centres")
    stars = skew_join(members, centres, ["token"], "m").select("node", "n", "at", F.col("p.node").alias("centre"), F.col("p.n").alias("cn"), F.col("p.at").alias("cat"))
    stars = stars.where(f"node <> centre and {join.in_reach_sql('n', 'at', 'cn', 'cat')}").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))
    candidates = written(found.where("token is null").select("a", "b").unionByName(stars).distinct(), "pairs")
    likely = of_pairs(candidates, join.signatures, "node bigint, n int, bits binary, heads binary").select("a", "b", "na", "nb", "bits_a", "bits_b", "heads_a", "heads_b")
    likely = written(likely.mapInArrow(lean(join.sift), "a bigint, b bigint"), "likely")
    both = of_pairs(likely, join.whole_sets, "node bigint, shingles binary").select("a", "b", "shingles_a", "shingles_b")
    links = written(both.mapInArrow(lean(join.verify), "a bigint, b bigint"), "verified")
    roots = components(links)

    # Groups that more than one component has a part in. Those of one centre are one: drifting copies share hundreds of tokens.
    labelled = written(members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "labelled")
    split = labelled.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("m"), F.min(F.struct("own", "node")).alias("p"))
    split = written(split.where("lo < hi").select("token", "m", F.col("p.node").alias("centre")), "split")
    if not split.isEmpty():
        some = skew_join(labelled, split, ["token"], "m").groupBy("centre", "node").agg(F.min("at").alias("at"), F.first("n").alias("n"), F.first("root").alias("root"))
        some = written(some, "open")
        sizes = written(some.groupBy("centre").agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("m")), "sizes")
        least = F.greatest("least", F.ceil(F.col("n") * percent / 100))
        some = skew_join(some, sizes, ["centre"], "m").where(F.col("n") - F.col("at") >= F.ceil((F.col("n") + least) * percent / (100 + percent)))
        some = written(some.select("centre", "node", "n", "at", "root"), "open")
        own = in_blocks(some, BITMAP_SHINGLES)
        signed = own.join(fetched(own.select("node"), join.bits, "node bigint, bits binary"), "node")
        near = block_pairs(signed).groupBy("centre", "i", "j").applyInPandas(lambda frame: join.near(frame), "centre bigint, node bigint").distinct()
        some = written(own.drop("blocks").join(near, ["centre", "node"], "left_semi"), "near")
        own = in_blocks(some, SET_SHINGLES).drop("n")
        whole = own.join(fetched(own.select("node"), join.whole_sets, "node bigint, shingles binary"), "node")
        more = block_pairs(whole).groupBy("centre", "i", "j").applyInPandas(lambda frame: join.across(frame), "a bigint, b bigint")
        roots = components(links.unionByName(written(more, "across")))
    named = reps.join(roots, "node", "left").select("node", "_rep", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("_rep").alias("component_id"))
    named = named.join(least, "root").select("node", "component_id")
    full = rows.where("n > 0").select(key, "n", "node").join(named, "node").select(key, F.col("n").cast("long").alias("n_shingles"), "component_id")
    return full.unionByName(rows.where("n = 0").select(key, F.lit(0).cast("long").alias("n_shingles"), F.col(key).alias("component_id")))
