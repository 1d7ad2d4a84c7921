"""Near-duplicate passages by compact windows.

A text is its sequence of five-word shingles, and each of HASHES functions gives every shingle a value. In the Cartesian
tree over the values, a node's subtree is a compact window: the largest stretch whose minimum is that node, so all
subsequences within it that hold the node share one min-hash. Only windows of at least ``LEAST`` shingles matter; their
nodes are the minima of some stretch of that length, which two sliding minima find, and the tree over those nodes alone
has the same extents. Windows of two texts with equal (function, minimum) that overlap enough once laid over each other
are an interval join; texts whose windows agree become candidate passages, which are verified by the Jaccard
similarity of their shingles. A passage of SIMILARITY or more has SEED shingles in a row from the other text, so one function
over windows of SEED shingles gives both texts one value.

Windows of one (function, minimum) are joined to their least member, found by aggregation: G copies of a passage cost G
rows, whether the passage is a paragraph or the whole text. The least member may hold a part or an edited form only. So
windows whose node is in no passage that both have word for word are joined once more, to the least of those that are
left. Then equal passages are sought exactly: every stretch of LEAST shingles that lies whole in no passage found so far, word for word, is hashed and
joined to the least text that has it. A text with a stretch is so linked to an earlier one that has it, or was before, in any order of
ids.

What these links do not join in one class is compared last, whichever texts they are: windows of one value in texts of different classes. In
a value with many of these, as a common line has, two windows meet only if they share one of the shingles around them that are
rarest in that value, of which no similar passage can do without all. So every link joins two texts of one class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import cut, release, ship, sized, stored
from vellum.llm.graph import components
from vellum.llm.wordhash import mix, power_tables, shingle_codes, slices

SHINGLE = 5
#: Shingles of a passage of 51 words; windows and passages have at least as many.
LEAST = 47
#: Shingles that a passage of SIMILARITY shares with the other in a row, at least, if no shingle repeats: a change of a word costs five
#: shingles on both sides and an inserted one four and five, so m changes need 36 * m shingles or more, and leave m + 1 runs.
SEED = 21
HASHES = 1
#: Share of the shingles of LEAST in a row that must occur in the other text before their similarity is looked at; two sets
#: with similarity 0.8 have at least this share of each other.
DENSITY = 0.8
SIMILARITY = 0.8
#: Positions of a text whose passages are looked at together.
CELL = 4096
#: Shingles on both sides of a node within which the shortest similar passages that hold it lie.
AROUND = 2 * LEAST
#: Bytes of codes that are hashed in one go.
TOGETHER = 1 << 20
#: Texts of one key that are compared with each other as they are.
FEW = 16

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def _sliding(values: np.ndarray, width: int, op) -> np.ndarray:
    """op over each stretch of ``width`` values, by prefixes and suffixes of blocks of that width."""
    n, fill = len(values), np.uint64(0xFFFFFFFFFFFFFFFF) if op is np.minimum else np.uint64(0)
    blocks = -(-n // width)
    padded = np.full(blocks * width, fill)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    left, right = op.accumulate(grid, axis=1).ravel(), op.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(right[: n - width + 1], left[width - 1 : n])


def compact_windows(values: np.ndarray, ends: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (text, node, first, last) of every compact window of at least ``least`` positions in texts that lie end to end.

    Each text ends in a zero, which is less than any value and so parts the texts; ``ends`` has the positions of these
    zeros. Positions count from the text's start. Of equal values the first counts as smaller.
    """
    n = len(values)
    if n < least:
        return np.empty((0, 4), np.int64)
    lowest = _sliding(values, least, np.minimum)  # of the stretch that starts at each position
    reach = np.concatenate([np.zeros(least - 1, np.uint64), lowest, np.zeros(least - 1, np.uint64)])
    nodes = np.flatnonzero((_sliding(reach, least, np.maximum) == values) | (values == 0))
    at, v = nodes.tolist(), values[nodes].tolist()
    first, last, stack = [0] * len(at), [n - 1] * len(at), []
    for i, x in enumerate(v):
        while stack and v[stack[-1]] > x:
            last[stack.pop()] = at[i] - 1
        first[i] = at[stack[-1]] + 1 if stack else 0
        stack.append(i)
    out = np.column_stack([np.searchsorted(ends, nodes), nodes, first, last])
    out = out[(values[nodes] > 0) & (out[:, 3] - out[:, 2] + 1 >= least)]
    out[:, 1:] -= np.concatenate([[0], ends[:-1] + 1])[out[:, 0], None]
    return out


def windows(texts: DataFrame) -> DataFrame:
    """(value, id, node, first, last) of every compact window of SEED shingles or more; value is a minimum whose low bits name the function."""
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1, 1 << 21):
                codes, sizes = shingle_codes(batch.column(1), SHINGLE)
                used = np.flatnonzero(sizes >= LEAST)
                if not len(used):
                    continue
                ends = np.cumsum(sizes[used] + 1) - 1
                flat, filled = np.zeros(int(ends[-1]) + 1, np.uint64), np.ones(int(ends[-1]) + 1, bool)
                filled[ends] = False
                flat[filled] = codes[np.repeat(sizes >= LEAST, sizes)]
                for k in range(HASHES):
                    values = mix(flat ^ _ODD[k]) | np.uint64(8)  # never zero
                    values[ends] = 0
                    found = compact_windows(values, ends, SEED)
                    places = np.concatenate([[0], ends[:-1] + 1])[found[:, 0]] + found[:, 1]
                    named = (values[places] & ~np.uint64(7)) | np.uint64(k)
                    ids = batch.column(0).take(pa.array(used[found[:, 0]]))
                    yield pa.RecordBatch.from_arrays([pa.array(named.view(np.int64)), ids, *[pa.array(found[:, c].astype(np.int32)) for c in (1, 2, 3)]], ["value", "id", "node", "first", "last"])

    return texts.mapInArrow(run, f"value bigint, id {kind}, node int, first int, last int")


WINDOW = ("id", "node", "first", "last")


def with_least(rest: DataFrame) -> DataFrame:
    """Each window of ``rest`` with ``r``, the least window of its value."""
    return rest.withColumn("r", F.min(F.struct(*WINDOW)).over(Window.partitionBy("value")))


def shared_windows(found: DataFrame) -> DataFrame:
    """The windows of ``found`` whose value two texts have, with ``r``, the least window of the value, and whether there are ``more`` than two; computed once."""
    same = Window.partitionBy("value")
    several = with_least(found).withColumns({"high": F.max("id").over(same), "more": F.count(F.lit(1)).over(same) > 2}).where("r.id < high")
    return stored(several.select("value", *WINDOW, "r", "more"), "windows")


def candidates(both: DataFrame) -> DataFrame:
    """(id, other, a, z, oa, oz): pairs of a text and an earlier one, with the stretches of shingles that hold all they may share.

    The interval join: a window and the one of an earlier text beside it, laid over each other at their nodes, must overlap in
    SEED shingles. Overlaps of one pair are gathered into one stretch in each text, with what a passage may have beyond.
    """
    both = both.where(F.col("id") > F.col("r.id"))
    before, after = F.least(F.col("node") - F.col("first"), F.col("r.node") - F.col("r.first")), F.least(F.col("last") - F.col("node"), F.col("r.last") - F.col("r.node"))
    laid = both.select("id", F.col("r.id").alias("other"), "node", F.col("r.node").alias("other_node"), before.alias("before"), after.alias("after"))
    least, most = lambda c: F.greatest(F.min(c) - AROUND, F.lit(0)), lambda c: F.max(c) + AROUND
    return laid.where(F.col("before") + F.col("after") + 1 >= SEED).groupBy("id", "other").agg(
        least(F.col("node") - F.col("before")).alias("a"),
        most(F.col("node") + F.col("after")).alias("z"),
        least(F.col("other_node") - F.col("before")).alias("oa"),
        most(F.col("other_node") + F.col("after")).alias("oz"),
    )


def named_columns(found: DataFrame, id_col: str) -> DataFrame:
    return found.select(F.col("id").alias(id_col), "start", "n_words", F.col("other").alias("other_id"), "other_start", "similarity").distinct()


def unsettled(rest: DataFrame, hits: DataFrame) -> DataFrame:
    """The windows of ``rest`` whose node is in no passage of ``hits``; a window looks at the passages in its own cell only."""
    found = rest.withColumn("cell", F.expr(f"node div {CELL}"))
    spans = _cells(hits.select("id", "start", (F.col("start") + F.col("n_words") - SHINGLE).alias("end")))
    held = F.exists("spans", lambda p: (p["start"] <= F.col("node")) & (F.col("node") <= p["end"]))
    return found.join(spans, ["id", "cell"], "left").where(~F.coalesce(held, F.lit(False))).drop("spans", "cell")


def _cells(spans: DataFrame) -> DataFrame:
    """(id, cell, spans): the stretches (id, start, end) that reach into each cell of CELL positions, sorted."""
    cell = F.explode(F.sequence(F.expr(f"start div {CELL}"), F.expr(f"end div {CELL}")))
    return spans.where("start <= end").select("id", cell.alias("cell"), F.struct("start", "end").alias("s")).groupBy("id", "cell").agg(F.sort_array(F.collect_set("s")).alias("spans"))


def unlinked(found: DataFrame, hits: DataFrame) -> DataFrame:
    """The windows of ``found`` with ``since``, the first start of a stretch of LEAST shingles that holds the node and lies whole in no passage of ``hits``.

    A passage settles the stretches that it holds, and not the windows that reach beyond it: a later text may share
    a stretch that stands half in a passage and half outside.
    """
    low, high = F.greatest(F.col("first"), F.col("node") - (LEAST - 1)), F.least(F.col("node"), F.col("last") - (LEAST - 1))
    rows = found.withColumns({"since": low, "until": high}).where("since <= until").withColumn("cell", F.expr(f"since div {CELL}"))
    starts = _cells(hits.select("id", "start", (F.col("start") + F.col("n_words") - SHINGLE - (LEAST - 1)).alias("end")))
    # stretches that begin in the next cell count as unsettled if they are: that costs a comparison, never a link
    reach = F.aggregate(F.coalesce("spans", F.array().cast(starts.schema["spans"].dataType)), F.col("since"), lambda r, p: F.when(p["start"] <= r, F.greatest(r, p["end"] + 1)).otherwise(r))
    return rows.join(starts, ["id", "cell"], "left").withColumn("since", reach).where("since <= until").drop("spans", "cell", "until")


def located(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """For each code of x whether y has it, and the first place of it, or of some other code, in y; and whether no code of y repeats. Codes are below 2 ** 32."""
    packed = np.sort(y.astype(np.uint64) << np.uint64(32) | np.arange(len(y), dtype=np.uint64))  # one plain sort, places along with their codes
    codes = (packed >> np.uint64(32)).astype(np.uint32)
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    distinct = codes[first]
    at = np.minimum(np.searchsorted(distinct, x), len(distinct) - 1)
    return distinct[at] == x, (packed[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)[at], len(first) == len(y)


def flat_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the codes of all ``texts``, end to end, where each text starts, how many codes it has)."""
    texts = texts.cast(pa.large_binary())
    _, offsets, values = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(memoryview(values or b"")[offsets[0] : offsets[-1]], np.uint32)
    return data, (offsets[:-1] - offsets[0]) // 4, np.diff(offsets) // 4


def listed(cells: pa.Array, *names: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """(for each member of the lists ``cells`` the row of its list, the fields ``names`` of the members, or the members themselves)."""
    rows, values = np.repeat(np.arange(len(cells)), np.diff(np.asarray(cells.offsets))), cells.flatten()
    return rows, [np.asarray(values.field(name)).astype(np.int64) for name in names] if names else [np.asarray(values).astype(np.int64)]


def rolling(codes: np.ndarray):
    """A function of arrays (first, last + 1) that gives a hash of the codes of each stretch, wherever it stands."""
    codes = mix(codes.astype(np.uint64) + np.uint64(1))
    power, inverse = power_tables(len(codes) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(codes * power[: len(codes)])])
    return lambda a, z: mix((sums[z] - sums[a]) * inverse[a])


def distinct_counts(ranks: np.ndarray, width: int = LEAST) -> np.ndarray:
    """The number of different ``ranks`` in each stretch of ``width``."""
    order, at = np.argsort(ranks, kind="stable"), np.arange(len(ranks))
    again = np.flatnonzero(ranks[order[1:]] == ranks[order[:-1]])
    before = np.full(len(ranks), -1)
    before[order[again + 1]] = order[again]
    # a place counts in the stretches that hold it and not the place before of the same rank
    edges = np.bincount(np.maximum(before + 1, np.maximum(at - width + 1, 0)), minlength=len(ranks) + 1) - np.bincount(at + 1, minlength=len(ranks) + 1)
    return np.cumsum(edges)[: len(ranks) - width + 1]


def common_stretches(x: np.ndarray, y: np.ndarray, places: tuple[np.ndarray, np.ndarray, bool] | None = None) -> list[tuple[int, int, int, float]]:
    """(start in x, end in x, start in y, similarity) of the stretches of at least LEAST codes that x and y share; ``places`` is located(x, y).

    Stretches of LEAST codes of which enough occur in y are merged where they overlap; a merged one that is not similar
    enough as a whole is split at its least dense place, and both parts are tried again, unless no part can be similar enough.
    """
    if min(len(x), len(y)) < LEAST:
        return []
    if np.array_equal(x, y):
        return [(0, len(x), 0, 1.0)]
    match, where, y_single = places or located(x, y)
    sums = np.concatenate([[0], np.cumsum(match)])
    density = sums[LEAST:] - sums[:-LEAST]
    dense = np.flatnonzero(density >= np.ceil(DENSITY * LEAST))
    if not len(dense):
        return []
    ordered = np.sort(x)
    single = not (ordered[1:] == ordered[:-1]).any()
    sets = None if single and y_single else _Sets(x, y, match, where)
    out = []
    runs = np.split(dense, np.flatnonzero(np.diff(dense) > LEAST) + 1)[::-1]
    while runs:
        run = runs.pop()
        if sets and not sets.possible(int(run[0]), int(run[-1]) + LEAST):
            continue
        hit = _similar(match, where, len(y), int(run[0]), int(run[-1]) + LEAST, single, sets)
        if hit:
            out.append(hit)
        elif len(run) > 1:
            gaps = np.diff(run)
            if gaps.max() > 1:
                middle = int(np.argmax(gaps)) + 1
            else:  # within the middle half, so that a long run takes few rounds
                low, high = max(1, len(run) // 4), max(2, len(run) - len(run) // 4)
                middle = low + int(np.argmin(density[run[low:high]]))
            runs += [run[middle:], run[:middle]]
    return _fewest(out)


class _Sets:
    """Two code sequences of which some code repeats, as sets."""

    def __init__(self, x: np.ndarray, y: np.ndarray, match: np.ndarray, where: np.ndarray):
        codes, ranks = np.unique(np.concatenate([x, y]), return_inverse=True)
        self.n, self.x, self.y, self.match, self.where = len(codes), ranks[: len(x)], ranks[len(x) :], match, where
        self.x_counts, self.y_counts = distinct_counts(self.x), distinct_counts(self.y)

    def possible(self, a: int, z: int) -> bool:
        """False only if no passage of x within x[a:z] can be similar enough to the place in y that ``_similar`` compares it with.

        Both have LEAST codes or more, so at least as many different ones as the poorest stretch of LEAST that they may hold.
        """
        inside = np.flatnonzero(self.match[a:z]) + a
        where, last = self.where[inside], len(self.y) - LEAST
        common = np.count_nonzero(np.bincount(self.x[inside]))
        least = self.x_counts[a : z - LEAST + 1].min() + self.y_counts[min(where.min(), last) : min(where.max(), last) + 1].min()
        return (1 + SIMILARITY) * common >= SIMILARITY * least - 1e-6

    def likeness(self, a: int, z: int, first: int, last: int) -> float:
        of_x, of_y = np.zeros(self.n, bool), np.zeros(self.n, bool)
        of_x[self.x[a:z]] = True
        of_y[self.y[first:last]] = True
        return np.count_nonzero(of_x & of_y) / np.count_nonzero(of_x | of_y)


def equal_runs(match: np.ndarray, where: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(start in x, end in x, start in y, 1.0) of stretches of at least LEAST codes that x and y have in the same order, one after the other, as ``located`` tells."""
    shift = np.where(match, where - np.arange(len(match)), np.iinfo(np.int64).min)
    starts = np.flatnonzero(np.concatenate([[True], shift[1:] != shift[:-1]]))
    ends = np.append(starts[1:], len(match))
    long = (ends - starts >= LEAST) & match[starts]
    return [(int(a), int(z), int(where[a]), 1.0) for a, z in zip(starts[long], ends[long], strict=True)]


def _similar(match: np.ndarray, where: np.ndarray, size: int, a: int, z: int, single: bool, sets: _Sets | None) -> tuple | None:
    """x[a:z], less what does not match at its ends, with its place in y, which has ``size`` codes, and their similarity, if that suffices."""
    inside = np.flatnonzero(match[a:z]) + a
    a, z = (int(inside[0]), int(inside[-1]) + 1) if z - a > LEAST else (a, z)
    if z - a < LEAST or single and len(inside) < SIMILARITY * (z - a + max(0, LEAST - len(inside))):
        return None  # y has at least LEAST codes, so no place in it is similar enough
    shift = where[inside] - inside
    near = where[inside][np.abs(shift - np.median(shift)) <= max(16, (z - a) // 5)]
    if not len(near):
        return None
    last = min(max(int(near.max()) + 1, int(near.min()) + LEAST), size)
    first = min(int(near.min()), last - LEAST)  # a passage on both sides, not the matching part of one
    if sets is None:  # no code counts twice
        common = int(np.count_nonzero(match[a:z] & (where[a:z] >= first) & (where[a:z] < last)))
        likeness = common / (z - a + last - first - common)
    else:
        likeness = sets.likeness(a, z, first, last)
    return (a, z, first, likeness) if likeness >= SIMILARITY else None


def _fewest(found: list[tuple]) -> list[tuple]:
    """The fewest of ``found`` that hold every code which some of them hold, in order."""
    found, out, i, held = sorted(found), [], 0, 0
    while i < len(found):
        if found[i][1] <= held:
            i += 1
            continue
        reach = max(held, found[i][0])
        best = found[i]
        while i < len(found) and found[i][0] <= reach:
            best = max(best, found[i], key=lambda h: h[1])
            i += 1
        out.append(best)
        held = best[1]
    return out


def stretches(nodes: DataFrame, coded: DataFrame) -> DataFrame:
    """(key, id, at, seeks): stretches of LEAST shingles of the windows ``nodes`` (id, fn, node, first, last, since), with a hash of all of each.

    A stretch has one node by each function, so the windows of function 0 give each of them once; those whose node by another function
    has no window in ``nodes`` are in one text only and are left out. A stretch seeks a partner if it starts at ``since`` or later; it may be one in any case.
    """
    kind = nodes.schema["id"].dataType.simpleString()
    per_text = nodes.groupBy("id").agg(F.collect_set(F.struct("fn", "node", "first", "last", "since")).alias("nodes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1, TOGETHER)):
            codes, starts, lengths = flat_codes(batch.column(1))
            hashed = rolling(codes)
            row, (fn, node, first, last, since) = listed(batch.column(2), "fn", "node", "first", "last", "since")
            low, high = np.maximum(first, node - LEAST + 1), np.minimum(np.minimum(node, last - LEAST + 1), lengths[row] - LEAST)
            shared = np.ones(len(codes), bool)
            for k in range(1, HASHES):
                own = (fn == k) & (high >= low)
                edges = np.bincount((starts[row] + low)[own], minlength=len(codes) + 1) - np.bincount((starts[row] + high)[own] + 1, minlength=len(codes) + 1)
                shared &= np.cumsum(edges)[: len(codes)] > 0
            sizes = np.where(fn == 0, np.maximum(high - low + 1, 0), 0)
            at = np.repeat(low, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            seeks, row = at >= np.repeat(since, sizes), np.repeat(row, sizes)
            kept = shared[starts[row] + at]
            at, seeks, row = at[kept], seeks[kept], row[kept]
            keys = hashed(starts[row] + at, starts[row] + at + LEAST)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column(0).take(pa.array(row)), pa.array(at.astype(np.int32)), pa.array(seeks)], ["key", "id", "at", "seeks"])

    return coded.join(per_text, "id").select("id", "codes", "nodes").mapInArrow(run, f"key bigint, id {kind}, at int, seeks boolean")


def equal_stretches(keyed: DataFrame) -> DataFrame:
    """(id, other, start, n_words, other_start, similarity) of the stretches that seek, with the least text that has an equal one.

    Stretches of one pair that overlap on one diagonal are one passage, equal word for word, so there is nothing left to verify.
    """
    least = cut(keyed.groupBy("key").agg(F.min(F.struct("id", "at")).alias("r"), F.max("id").alias("high"), F.bool_or("seeks").alias("sought")).where("r.id < high and sought").select("key", "r"))
    met = keyed.where("seeks").join(least, "key").where(F.col("id") > F.col("r.id")).select("id", F.col("r.id").alias("other"), (F.col("at") - F.col("r.at")).alias("shift"), "at").distinct()
    w = Window.partitionBy("id", "other", "shift").orderBy("at")
    runs = met.withColumn("new", F.coalesce(F.col("at") - F.lag("at").over(w) > LEAST, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(w))
    found = runs.groupBy("id", "other", "shift", "run").agg(F.min("at").alias("start"), F.max("at").alias("last"))
    words = F.col("last") - F.col("start") + LEAST + SHINGLE - 1
    return found.select("id", "other", "start", words.cast("int").alias("n_words"), (F.col("start") - F.col("shift")).cast("int").alias("other_start"), F.lit(1.0).alias("similarity"))


def with_classes(df: DataFrame, classes: DataFrame) -> DataFrame:
    """``df`` with ``root``, the class of its id; a text without a link is a class of its own."""
    return df.join(classes.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))


#: Columns of a window that is compared across classes.
SEEN = ("key", "id", "root", "node", "first", "last")


def contexts(mixed: DataFrame, coded: DataFrame) -> DataFrame:
    """SEEN of the windows ``mixed`` (id, root, node, first, last): ``key`` is a hash of the node and the shingles on one side of it, of which a shared run of
    SEED has one side whole. Only keys of several classes; of windows of a class that are alike within AROUND the least only."""
    kind, half = mixed.schema["id"].dataType.simpleString(), SEED // 2
    per_text = mixed.groupBy("id", "root").agg(F.collect_set(F.struct("node", "first", "last")).alias("nodes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 2, TOGETHER)):
            codes, starts, lengths = flat_codes(batch.column(2))
            hashed = rolling(codes)
            all_rows, all_cells = listed(batch.column(3), "node", "first", "last")
            for side in (0, 1):
                node, _, last = all_cells
                low, high = (node - half, node + 1) if side == 0 else (node, node + half + 1)
                kept = (low >= 0) & (high <= lengths[all_rows]) & (last < lengths[all_rows])  # an id may have several texts
                row, cells = all_rows[kept], [c[kept] for c in all_cells]
                start, at = starts[row], cells[0]
                keys = mix(hashed(start + low[kept], start + high[kept]) + np.uint64(side))
                a, z = np.maximum(at - AROUND, 0), np.minimum(at + AROUND + 1, lengths[row])
                same = mix(hashed(start + a, start + z) ^ ((at - a) * 1000 + z - at).astype(np.uint64))  # the node's place among them counts
                ids = [batch.column(c).take(pa.array(row)) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *ids, *[pa.array(c.astype(np.int32)) for c in cells], pa.array(same.view(np.int64))], [*SEEN, "same"])

    rows = coded.join(per_text, "id").select("id", "root", "codes", "nodes").mapInArrow(run, f"key bigint, id {kind}, root {kind}, node int, first int, last int, same bigint")
    rows = cut(rows.groupBy("key", "root", "same").agg(F.min(F.struct(*WINDOW)).alias("w")).select("key", "root", "w.*"))
    return rows.join(cut(_of_several(rows, "key").select("key")), "key").select(*SEEN)


def _of_several(rows: DataFrame, *by: str) -> DataFrame:
    """The groups of ``rows`` with texts of several classes, and their numbers ``n`` of rows."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("one"), F.max("root").alias("two")).where("one < two").drop("one", "two")


#: For passages of up to so many shingles, looked at by stretches of the first number: how many of these the other text may lack, at most. A passage of n
#: shingles shares at least 0.8 * n, and, since the other has at least LEAST, SIMILARITY / (1 + SIMILARITY) * (n + LEAST).
_LENGTHS = (47, 49, 51, 54, 58, 64, 72, 80, 88, 95)
LACKED = [(n, m - 1 - int(np.ceil(max(SIMILARITY * (m - 1), SIMILARITY / (1 + SIMILARITY) * (m - 1 + LEAST)) - 1e-9))) for n, m in zip(_LENGTHS, _LENGTHS[1:], strict=False)]


def rarest(places: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Which of the shingles ``codes`` at ``places`` of a text a similar passage cannot all do without: of each stretch of a length in LACKED
    the rarest, one more than the other text may lack. ``counts`` says how many texts of the key have each; all others have no use."""
    out, order = np.zeros(len(places), bool), np.argsort(places)
    by_rarity = np.empty(len(places), np.int64)
    by_rarity[np.lexsort((codes, counts))] = np.arange(len(places))
    for part in np.split(order, np.flatnonzero(np.diff(places[order]) > LEAST) + 1):  # parts so far from each other that no stretch needs both
        at = places[part] - places[part[0]] + LACKED[-1][0]
        rank = np.full(at[-1] + LACKED[-1][0] + 1, -1)
        rank[at] = by_rarity[part]
        lone, chosen = np.concatenate([[0], np.cumsum(rank < 0)]), np.zeros(len(rank), bool)
        for n, lacked in LACKED:
            starts = np.flatnonzero(lone[n:] - lone[:-n] <= lacked)
            for some in np.array_split(starts, -(-len(starts) // CELL)) if len(starts) else ():
                stretch = np.lib.stride_tricks.sliding_window_view(rank, n)[some]
                chosen[(np.argpartition(stretch, lacked, axis=1)[:, : lacked + 1] + some[:, None]).ravel()] = True
        out[part] = chosen[at]
    return out


def meetings(seen: DataFrame, coded: DataFrame) -> DataFrame:
    """(id, other, a, z, oa, oz) as of ``candidates``: pairs of texts of one key in ``seen`` and of different classes.

    In a key of at most FEW texts all meet. Texts of larger keys meet if they share a shingle that is among the rarest around nodes of both; what is
    rare is told over all these texts at once, so a text that has many keys, as one with a long common line has, is looked at once. A pair meets at the
    first of the rare shingles that it shares, and texts of the class that has most of a key are not laid beside each other.
    """
    kind = seen.schema["id"].dataType.simpleString()
    texts = cut(seen.groupBy("key", "id", "root").agg(F.greatest(F.min("node") - AROUND, F.lit(0)).alias("a"), (F.max("node") + AROUND).alias("z")))
    per_key = cut(_of_several(texts, "key"))
    large = cut(per_key.where(F.col("n") > FEW).select("key"))
    few = texts.join(per_key.where(F.col("n") <= FEW).select("key"), "key").select("key", "id", "root", "a", "z")
    nodes = cut(seen.join(large, "key").groupBy("id", "root").agg(F.collect_set("node").alias("nodes")))
    per_text = coded.join(nodes, "id").select("id", "root", "codes", "nodes")

    def near(codes: pa.Array, nodes: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place, code) of what lies around the nodes, each place once, however many nodes are near."""
        flat, starts, lengths = flat_codes(codes)
        row, (node,) = listed(nodes)
        row, node = row[node < lengths[row]], node[node < lengths[row]]
        edges = np.bincount(starts[row] + np.maximum(node - AROUND, 0), minlength=len(flat) + 1) - np.bincount(starts[row] + np.minimum(node + AROUND + 1, lengths[row]), minlength=len(flat) + 1)
        at = np.flatnonzero(np.cumsum(edges)[:-1])
        row = np.repeat(np.arange(len(lengths)), lengths)[at]
        return row, at - starts[row], flat[at].astype(np.int64)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 2, TOGETHER)):
            row, _, code = near(batch.column(2), batch.column(3))
            once = np.unique(row.astype(np.uint64) << np.uint64(32) | code.astype(np.uint64))
            row, code = (once >> np.uint64(32)).astype(np.int64), (once & np.uint64(0xFFFFFFFF)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(code), *(batch.column(c).take(pa.array(row)) for c in (0, 1))], ["code", "id", "root"])

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 2, TOGETHER)):
            rows, places, codes = near(batch.column(2), batch.column(3))
            of, (known, counts) = listed(batch.column(4), "code", "n")
            found = []
            for i in range(batch.num_rows):
                place, code, order = places[rows == i], codes[rows == i], np.argsort(known[of == i])
                mine, n = known[of == i][order], counts[of == i][order]
                slot = np.minimum(np.searchsorted(mine, code), len(mine) - 1)
                useful = mine[slot] == code
                place, code, n = place[useful], code[useful], n[slot[useful]]
                if len(place) < LEAST - LACKED[0][1]:  # a passage of LEAST has at most so many shingles that no other class has
                    continue
                taken = rarest(place, code, n)
                if taken.any():
                    found.append((i, np.unique(code[taken]), max(int(place[taken].min()) - AROUND, 0), int(place[taken].max()) + AROUND))
            if found:
                row, lists, a, z = zip(*found, strict=True)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lists)]).astype(np.int32)), pa.array(np.concatenate(lists)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(row)) for c in (0, 1)), lists, pa.array(a, pa.int32()), pa.array(z, pa.int32())], ["id", "root", "codes", "a", "z"])

    around = stored(per_text.mapInArrow(spread, f"code bigint, id {kind}, root {kind}").distinct(), "around")
    held = around.join(cut(_of_several(around, "code")), "code").groupBy("id", "root").agg(F.collect_list(F.struct("code", "n")).alias("held"))
    keys = per_text.join(held, ["id", "root"]).mapInArrow(chosen, f"id {kind}, root {kind}, codes array<bigint>, a int, z int")
    keys = cut(keys.groupBy("id", "root").agg(F.array_distinct(F.flatten(F.collect_list("codes"))).alias("codes"), F.min("a").alias("a"), F.max("z").alias("z")))
    # a code and a key of few texts may be one number, so they are told apart
    few = few.withColumns({"rare": F.lit(False), "codes": F.array().cast("array<bigint>")})
    rows = few.unionByName(keys.select(F.explode("codes").alias("key"), "id", "root", "a", "z", F.lit(True).alias("rare"), "codes"))
    classes = rows.groupBy("key", "rare", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("key", "rare").agg(F.max_by("root", "n").alias("main"), (F.count(F.lit(1)) > 1).alias("several"))
    rows = cut(rows.join(classes.where("several").drop("several"), ["key", "rare"]))
    other = rows.select("key", "rare", *(F.col(c).alias(f"other_{c}") for c in ("id", "root", "codes", "a", "z")))
    met = rows.where("root <> main").join(other, ["key", "rare"])
    met = met.where("root <> other_root and (other_root = main or id > other_id) and (not rare or array_min(array_intersect(codes, other_codes)) = key)")
    turned = F.col("id") < F.col("other_id")
    either = lambda c, d: F.when(turned, F.col(d)).otherwise(F.col(c))
    both = met.select(F.greatest("id", "other_id").alias("id"), F.least("id", "other_id").alias("other"), either("a", "other_a").alias("a"), either("z", "other_z").alias("z"), either("other_a", "a").alias("oa"), either("other_z", "z").alias("oz"))
    return both.groupBy("id", "other").agg(F.min("a").alias("a"), F.max("z").alias("z"), F.min("oa").alias("oa"), F.max("oz").alias("oz"))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, n_words, other_id, other_start, similarity): passages of over 50 words that an earlier text has as well,
    at a shingle similarity of 0.8 or more.

    A passage is linked to the least text of its value that has it; where that text has only part of it, to another that has
    it whole. Positions count words. Texts of fewer than 51 words, null and blank ones have no passage; rows with a null id
    are left out, for nothing could name them; rows that repeat an id and text count once, and rows that share an id with
    different texts are texts of one name: their passages are told apart by place only. Very long texts are taken whole. Other
    columns do not matter. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    members = shared_windows(windows(texts))
    named = cut(members.select("id").distinct())
    kind = texts.schema["id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                codes, sizes = shingle_codes(batch.column(1), SHINGLE)
                body, ends = codes.astype(np.uint32).tobytes(), np.cumsum(4 * sizes).tolist()
                packed = pa.array([body[a:z] for a, z in zip([0, *ends[:-1]], ends, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), packed], ["id", "codes"])

    coded = stored(texts.join(sized(named), "id", "left_semi").mapInArrow(encode, f"id {kind}, codes binary").dropDuplicates(["id", "codes"]), "codes")
    at = lambda c: F.col(c) if isinstance(c, str) else c
    cut_out = lambda codes, a, z: F.substring(codes, 4 * at(a) + 1, 4 * (at(z) - at(a) + 1))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found, whole = [], [], []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint32) for c in (4, 5))
                places = located(x, y) if len(x) and len(y) and not np.array_equal(x, y) else None
                hits = common_stretches(x, y, places)
                within = equal_runs(*places[:2]) if any(h[3] < 1 for h in hits) else []
                rows += [i] * (len(hits) + len(within))
                found += hits + within
                whole += [True] * len(hits) + [False] * len(within)
            if found:
                a, z, first, likeness = (np.array(c) for c in zip(*found, strict=True))
                low, other_low = (np.asarray(batch.column(c))[rows] for c in (2, 3))
                cells = [pa.array((low + a).astype(np.int32)), pa.array((z - a + SHINGLE - 1).astype(np.int32)), pa.array((other_low + first).astype(np.int32)), pa.array(likeness), pa.array(whole)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), *cells], ["id", "other", "start", "n_words", "other_start", "similarity", "whole"])

    def verified(pairs: DataFrame) -> DataFrame:
        """Passages of the pairs, and, not ``whole``, what a similar one has word for word."""
        pairs = cut(pairs)
        ids = lambda c: sized(cut(pairs.select(F.col(c).alias("id")).distinct()))
        right = coded.join(ids("other"), "id", "left_semi").select(F.col("id").alias("other"), F.col("codes").alias("other_codes"))
        left = pairs.join(coded.join(ids("id"), "id", "left_semi"), "id").select("id", "other", "a", "oa", "oz", cut_out("codes", "a", "z").alias("x"))
        joined = left.join(right, "other").select("id", "other", "a", "oa", "x", cut_out("other_codes", "oa", "oz").alias("y"))
        return cut(joined.mapInArrow(verify, f"id {kind}, other {kind}, start int, n_words int, other_start int, similarity double, whole boolean").distinct())

    rest = members.where("id > r.id")
    out = verified(candidates(rest))
    release(docs.sparkSession)
    rest = unsettled(rest.select("value", *WINDOW), out.where("similarity = 1 and whole"))
    out = out.unionByName(verified(candidates(with_least(rest))))
    release(docs.sparkSession)
    fn = F.col("value").bitwiseAND(F.lit(7)).cast("int")
    # two windows alone have been compared as they are
    seekers = cut(unlinked(members.where((fn == 0) & F.col("more") & (F.col("id") > F.col("r.id"))), out.where("similarity = 1")).select("id", "value", "node", "since"))
    out = out.where("whole").drop("whole")
    if not seekers.isEmpty():
        never = F.lit(1 << 30)
        first = members.where(fn == 0).join(cut(seekers.select("value").distinct()), "value", "left_semi").join(seekers, ["id", "value", "node"], "left")
        first = cut(first.select("id", fn.alias("fn"), "node", "first", "last", F.coalesce("since", never).alias("since")))
        others = members.where(fn != 0).join(sized(cut(first.select("id").distinct())), "id", "left_semi").select("id", fn.alias("fn"), "node", "first", "last", never.alias("since"))
        keyed = stored(stretches(first.unionByName(others), coded), "stretches")
        out = out.unionByName(equal_stretches(keyed))
    out = cut(out.distinct())
    roots = components(out.select(F.col("id").alias("u"), F.col("other").alias("v")))
    same = Window.partitionBy("value")
    mixed = with_classes(members.select("value", *WINDOW), roots).withColumns({"one": F.min("root").over(same), "two": F.max("root").over(same)})
    seen = cut(contexts(mixed.where("one < two").drop("one", "two", "value"), coded))
    release(docs.sparkSession)
    out = out.unionByName(verified(meetings(seen, coded)).where("whole").drop("whole"))
    return named_columns(out, id_col)


def passage_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``repeated_passages`` with ``class_id``, the least text that can be reached over passages: any two texts with a passage of over 50 words in common at
    SIMILARITY or more are of one class, whether a row links them or rows to others do."""
    found = cut(repeated_passages(docs, id_col, text_col))
    roots = components(found.select(F.col(id_col).alias("u"), F.col("other_id").alias("v"))).select(F.col("node").alias(id_col), F.col("root").alias("class_id"))
    return found.join(sized(roots), id_col)
