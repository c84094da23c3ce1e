"""Best-fit packing: which pieces share a sequence follows from the histogram of their lengths alone.

The configuration linear program (how often to use each multiset of lengths that fits a sequence, so that all lengths
are covered by as few sequences as possible) is solved by multiplicative weights in rounds. A round has to cover its share
of every length: a length's price is its share of a sequence times a weight, a knapsack dynamic program over the prices
gives the most valuable configuration of each length that is behind, and each is used for what is missing, as far as the
round's share of its other lengths goes. Weights of lengths that are ahead of their share are multiplied down, those of
others up. A length's share is rounded to whole documents at a random threshold of its own, so what the rounds use is a
rounding of the fractional solution. What they leave (a few percent) goes best fit, longest first.

Few different lengths can leave a gap to the prices' bound that a rounding of weights doesn't close; there the program is
solved to a stated gap by revised simplex over columns of the same knapsack, and rounded.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.llm import bytelevel, textnum
from tessella.llm.cluster import lean, ship, written


def knapsack(prices: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For every room up to the capacity, the value of the best set of lengths (ascending) that fits and one length of that set, -1 where it is the smaller room's."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for room in range(1, capacity + 1):
        best[room], n = best[room - 1], upto[room]
        if n:
            value = best[room - lengths[:n]] + prices[:n]
            k = int(value.argmax())
            if value[k] > best[room] + 1e-12:
                best[room], took[room] = value[k], k
    return best, took


def traced(k: int, took: np.ndarray, size: np.ndarray, capacity: int) -> dict[int, int]:
    """The most valuable configuration that holds length number k: numbers of lengths, and how often each."""
    have, rooms = {k: 1}, capacity - int(size[k])
    while rooms > 0:
        if (t := int(took[rooms])) < 0:
            rooms -= 1
        else:
            have[t] = have.get(t, 0) + 1
            rooms -= int(size[t])
    return have


#: Rounds, the part of all documents that they deal, and the most tokens that a configuration may leave free.
SCHEDULES = ((60, 1.0, None), (20, 0.9, None), (20, 1.0, 0))
FEW_LENGTHS = 256


def configurations(histogram: dict[int, int], capacity: int, gap: float = 0.0025, seed: int = 0) -> list[tuple[int, list[int]]]:
    """(number of sequences, their lengths in order) that pack the histogram exactly: the fewest that the schedules of
    weights give. Best fit alone stands only where it needs fewer still, which few documents of each length cause, as
    rounds deal in whole ones. Up to FEW_LENGTHS lengths the program is solved by simplex where the rest is beyond `gap`
    of the prices' bound and a fiftieth of the number of lengths.
    """
    found, least = [], 0.0
    for rounds, share, slack in SCHEDULES:
        configs, bound = weighted(histogram, capacity, rounds, share, slack, seed)
        left = dict(histogram)
        for n, filled in configs:
            for length in filled:
                left[length] -= n
        found.append(configs + best_fit({k: n for k, n in left.items() if n}, capacity))
        least = max(least, bound)
    found.append(best_fit(histogram, capacity))
    size = lambda x: sum(n for n, _ in x)
    best = min(found, key=size)
    if len(histogram) <= FEW_LENGTHS and size(best) > np.ceil(least - 1e-6) * (1 + gap) + len(histogram) / 50:
        best = min([best, *rounded(histogram, capacity, *program(histogram, capacity, gap / 5))], key=size)
    return best


def weighted(histogram: dict[int, int], capacity: int, rounds: int, share: float, slack: int | None, seed: int, rate: float = 0.1, noise: float = 0.003) -> tuple[list[tuple[int, list[int]]], float]:
    """Configurations dealt by multiplicative weights, and the greatest lower bound that prices gave on the program.

    noise: prices are spread by so much, so that lengths of equal worth take turns.
    """
    rng = np.random.default_rng(seed)
    size = np.array(sorted(n for n, c in histogram.items() if c > 0), np.int64)
    counts = np.array([histogram[int(n)] for n in size], np.int64)
    prior, threshold = size / capacity, rng.random(len(size))
    log_weights, used = np.zeros(len(size)), np.zeros(len(size), np.int64)
    out: list[tuple[int, list[int]]] = []
    least = float(prior @ counts)
    for t in range(1, int(rounds * share) + 1 if len(size) else 0):
        goal, most = (np.minimum(counts, np.floor((t + ahead) / rounds * counts + threshold + ahead).astype(np.int64)) for ahead in (0, 1))
        for again in range(3):
            behind = np.flatnonzero(goal > used)
            if not len(behind):
                break
            live = np.flatnonzero(most > used)
            prices = prior[live] * np.exp(log_weights[live] + noise * rng.standard_normal(len(live)))
            best, took = knapsack(prices, size[live], capacity)
            if len(live) == len(size):  # no configuration is worth more than best: prices by that are a solution of the dual program
                least = max(least, float(prices @ counts / best[capacity]))
            place = np.searchsorted(live, behind)
            for k, at in zip(behind[::-1].tolist(), place[::-1].tolist(), strict=True):
                if used[k] >= goal[k]:
                    continue
                have = {int(live[i]): m for i, m in traced(at, took, size[live], capacity).items()}
                if slack is not None and capacity - sum(int(size[i]) * m for i, m in have.items()) > slack:
                    continue
                n = min(-(-int(goal[k] - used[k]) // have[k]), *((int(most[i]) - int(used[i])) // m for i, m in have.items()))
                if n > 0:
                    for i, m in have.items():
                        used[i] += n * m
                    out.append((n, [int(size[i]) for i in sorted(have, reverse=True) for _ in range(have[i])]))
        ahead_by = (used - t / rounds * counts) / np.maximum(counts / rounds, 1)
        log_weights -= rate * np.clip(ahead_by, -1, 1) / np.sqrt(t)
    return out, least


def program(histogram: dict[int, int], capacity: int, gap: float) -> tuple[list[dict[int, int]], np.ndarray]:
    """Configurations (length: how often) and how many of each, in fractions, that cover the histogram: the linear
    program by revised simplex, columns by the knapsack, until the prices prove the gap."""
    lengths = np.array(sorted(n for n, c in histogram.items() if c > 0), np.int64)
    counts = np.array([histogram[int(n)] for n in lengths], float)
    wanted = counts * (1 + 1e-7 * np.random.default_rng(0).random(len(lengths)))  # no ties, so that no step is empty
    columns: list[dict[int, int]] = [{i: capacity // int(n)} for i, n in enumerate(lengths)]
    cost = np.ones(len(lengths))
    inverse, steps = np.diag([1.0 / (capacity // int(n)) for n in lengths]), 0
    centre, keep = lengths / capacity, 0.8  # the prices that prove most so far; the knapsack is asked between them and the current ones
    least = float(centre @ counts)

    def matrix() -> np.ndarray:
        out = np.zeros((len(lengths), len(lengths)))
        for j, column in enumerate(columns):
            for i, c in column.items():
                out[i, j] = c
        return out

    def enter(column: dict[int, int], price: float) -> bool:
        nonlocal inverse, steps
        at = np.fromiter(column, np.int64)
        by = inverse[:, at] @ np.array([column[i] for i in at.tolist()], float)
        x = inverse @ wanted
        ratio = np.where(by > 1e-9, np.maximum(x, 0) / np.where(by > 1e-9, by, 1), np.inf)
        j = int(ratio.argmin())
        if not np.isfinite(ratio[j]):
            return False
        row = inverse[j] / by[j]
        inverse -= np.outer(by, row)
        inverse[j] = row
        columns[j], cost[j], steps = column, price, steps + 1
        if steps % 200 == 0:
            inverse = np.linalg.inv(matrix())
        return True

    while len(lengths):
        prices = cost @ inverse
        entered = False
        for i in np.flatnonzero(prices < -1e-9).tolist():  # more than is wanted of a length may be covered
            if (cost @ inverse[:, i]) < -1e-9:
                entered |= enter({i: -1}, 0.0)
        if entered:
            continue
        prices = np.maximum(prices, 0)
        asked = keep * centre + (1 - keep) * prices
        best, took = knapsack(asked, lengths, capacity)
        if asked @ counts > least * best[capacity]:  # asked / best: no configuration is worth more than a sequence
            least, centre = float(asked @ counts / best[capacity]), asked / best[capacity]
        if cost @ (inverse @ counts) <= least * (1 + gap):
            break
        value = asked + best[capacity - lengths]
        for k in np.argsort(-value, kind="stable").tolist():
            column = traced(k, took, lengths, capacity)
            at = list(column)
            if (cost @ inverse[:, at]) @ np.array([column[i] for i in at], float) > 1 + 1e-9:
                entered |= enter(column, 1.0)
        if not entered and not keep:
            break
        keep = 0.8 if entered else 0.0
    x = np.linalg.solve(matrix(), counts) if len(lengths) else counts
    real = [j for j, c in enumerate(cost) if c]
    return [{int(lengths[i]): c for i, c in columns[j].items()} for j in real], np.maximum(x[real], 0)


def rounded(histogram: dict[int, int], capacity: int, columns: list[dict[int, int]], x: np.ndarray) -> list[list[tuple[int, list[int]]]]:
    """Two ways to round: whole parts and best fit for the rest; the same with one more of what still fits, largest fraction first."""
    left, out = dict(histogram), []

    def take(n: int, column: dict[int, int]) -> None:
        while n > 0 and (column := {t: min(c, left[t]) for t, c in column.items() if left[t]}):
            use = min(n, *(left[t] // c for t, c in column.items()))
            for t, c in column.items():
                left[t] -= use * c
            out.append((use, [t for t in sorted(column, reverse=True) for _ in range(column[t])]))
            n -= use

    whole = np.floor(x + 1e-6).astype(np.int64)
    for n, column in zip(whole.tolist(), columns, strict=True):
        take(n, column)
    plain = out + best_fit({t: n for t, n in left.items() if n}, capacity)
    for j in np.argsort(whole - x, kind="stable").tolist():
        if x[j] - whole[j] > 1e-6 and all(left[t] >= c for t, c in columns[j].items()):
            take(1, columns[j])
    return [plain, out + best_fit({t: n for t, n in left.items() if n}, capacity)]


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Best fit, longest first, where sequences alike are handled together."""
    rooms: list[dict[tuple[int, ...], int]] = [{} for _ in range(capacity + 1)]
    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        for room in range(length, capacity):
            while n and rooms[room]:
                filled, k = rooms[room].popitem()
                each = 1 if k > n else min(room // length, max(1, n // k))
                use = min(k, n // each)
                if use < k:
                    rooms[room][filled] = k - use
                new = (*filled, *[length] * each)
                rooms[room - each * length][new] = rooms[room - each * length].get(new, 0) + use
                n -= use * each
        if n:
            each = capacity // length
            for size, use in ((each, n // each), (n % each, 1)):
                if size and use:
                    new = (length,) * size
                    rooms[capacity - size * length][new] = rooms[capacity - size * length].get(new, 0) + use
    return [(n, list(filled)) for r in rooms for filled, n in r.items()]


def slots(configs: list[tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """For each length, rows of (first rank, number a sequence, first sequence, offset): where the items of that length go by rank."""
    out: dict[int, list[list[int]]] = {}
    rank: dict[int, int] = {}
    sequence = 0
    for n, filled in configs:
        offset, k = 0, 0
        while k < len(filled):
            length, j = filled[k], k
            while j < len(filled) and filled[j] == length:
                j += 1
            out.setdefault(length, []).append([rank.get(length, 0), j - k, sequence, offset])
            rank[length] = rank.get(length, 0) + n * (j - k)
            offset += length * (j - k)
            k = j
        sequence += n
    return {k: np.array(v, np.int64) for k, v in out.items()}


def encoder(tokenizer: str):
    """Single pre-tokens by the merges of the file, in native code: the vocabulary's ids ascend with the ranks of its merges, so that they serve as ranks."""
    import tiktoken

    spec = bytelevel.load(tokenizer)
    made = [m for _, m in sorted(spec["merges"].values())]
    if made != sorted(made):
        raise ValueError("ids do not ascend with ranks")
    encoding = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=dict(spec["vocab"]), special_tokens={})
    return lambda text: encoding._encode_single_piece(text.encode())


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, key: str, text: str) -> DataFrame:
    """A row for each piece: key, piece, start, length, ids_crc32, and its number among those of its task of that length."""
    table = bytelevel.classes(tokenizer)
    kind = docs.schema[key].dataType.simpleString()

    def run(parts):
        kinds, added = np.frombuffer(zlib.decompress(table), np.uint8), bytelevel.load(tokenizer)["added"]
        known, seen, task = bytelevel.Known(encoder(tokenizer)), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        end = np.array([end_id], np.int64)
        for part in textnum.slices(parts, text):
            rows: list[tuple] = []
            for i, ids in enumerate(bytelevel.token_ids(part.column(text).to_pylist(), kinds, added, known)):
                ids = np.concatenate([ids, end]).astype("<u4")
                start, size = 0, (len(ids) - 1) % capacity + 1
                piece = 0
                while start < len(ids):
                    rows.append((i, piece, start, size, zlib.crc32(ids[start : start + size].tobytes()), int(seen[size])))
                    seen[size] += 1
                    start, size, piece = start + size, capacity, piece + 1
            owner, *columns = (np.array(x, np.int64) for x in zip(*rows, strict=True))
            piece, start, size, crc, number = columns
            yield pa.RecordBatch.from_arrays([part.column(key).take(pa.array(owner)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(size), pa.array(crc), pa.array(np.full(len(size), task, np.int64)), pa.array(number)], [key, "piece", "start", "length", "ids_crc32", "_task", "_number"])

    return docs.select(key, text).mapInArrow(lean(run), f"`{key}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, _task bigint, _number bigint")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every piece of every document with its sequence_id and its offset there: key, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids followed by end_id; a null or empty text is end_id alone. Only documents longer than the
    capacity are cut, into pieces of the capacity of which the first may be shorter. Sequences have no gaps. Repeated
    rows are packed each; ties (equal lengths) go by task and place there. A null key stays null.
    Other columns of docs are left out, whatever their names. An empty table gives an empty result; very long texts are
    encoded whole.

    The driver sees the histogram of lengths alone: at most `capacity` numbers. Ranks within a length come from counts
    for each task and length; no length's rows ever meet in one task.
    """
    spark = docs.sparkSession
    ship(spark)
    cut = written(pieces(docs, tokenizer, capacity, end_id, key, text), "pieces")
    counts = cut.where(F.col("length") < capacity).groupBy("_task", "length").agg(F.count(F.lit(1)).alias("_n"))
    histogram = {r["length"]: r["n"] for r in cut.where(F.col("length") < capacity).groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    where = spark.sparkContext.broadcast(slots(configurations(histogram, capacity)))  # bounded by the capacity and the number of steps
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    ranks = counts.select("_task", "length", F.coalesce(before, F.lit(0)).alias("_before"))
    kind = docs.schema[key].dataType.simpleString()
    named = [key, "piece", "start", "length", "ids_crc32"]

    def placed(parts):
        table = where.value
        for part in parts:
            length = part.column("length").to_numpy()
            rank = part.column("_before").to_numpy() + part.column("_number").to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                slot = table[int(length[at[0]])]
                first, each, begin, place = slot[np.searchsorted(slot[:, 0], rank[at], "right") - 1].T
                sequence[at] = begin + (rank[at] - first) // each
                offset[at] = place + (rank[at] - first) % each * length[at]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in named), pa.array(sequence), pa.array(offset)], [*named, "sequence_id", "offset"])

    schema = f"`{key}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    shared = cut.where(F.col("length") < capacity).join(ranks, ["_task", "length"]).select(*named, "_before", "_number").mapInArrow(lean(placed), schema)
    alone = cut.where(F.col("length") == capacity).select(*named, (-1 - F.shiftleft("_task", 32) - F.col("_number")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return shared.unionByName(alone)
