"""Line deduplication by an exact set-similarity join: rarity order, prefix, positional and length filters, Jaccard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm.flat import BLANKS, LOWER, U64, KeyCounts, SortedHashes, mix, row_chunks, span_hashes, text_buffers, word_spans
from riskweave.llm.scratch import fresh_name, saved
from riskweave.session import discard, scratch_path

#: Least Jaccard similarity, in hundredths, so that all bounds are whole numbers.
PERCENT = 80
#: Most frequent tokens whose frequencies give the rarity order; all others count as rare, in the order of their hashes.
FREQUENT_TOKENS = 1 << 18
#: Least occurrences in a task that make a token a candidate for them; and the tokens a task holds.
LEAST_IN_TASK, HELD_TOKENS = 3, 1_000_000
#: Rows of a prefix token that one task pairs; those of more frequent tokens are cut into so many and met cell by cell.
PAIRED_ROWS = 4_096
#: Prefix entries that a bucket holds, about; and those that a task collects before it hands them on.
BUCKET_ENTRIES, HELD_ENTRIES = 200_000, 1_000_000
#: Pairs that are looked at together in a bucket.
SEEN_PAIRS = 500_000
#: Classes of a group of similar ones that are compared in one task; larger groups are cut into cells.
GROUP_CLASSES = 2_048
#: Tokens of a group that are compared at a time.
GROUP_TOKENS = 4_096
#: Bits per class, and at least and at most, that mark the classes whose tokens the verification needs; they may share one.
MARK_BITS, LEAST_MARKS, MOST_MARKS = 32, 1 << 20, 1 << 27
#: What a line's number is multiplied by before it meets the hash of its text.
LINE_STEP = 40_503
LAST_ID = (1 << 63) - 1
NEWLINE = 10


def _line_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, and row and line number of each word, in text order; ``data`` is in lower case."""
    starts, ends, heads = word_spans(data, offsets, BLANKS)
    breaks = np.flatnonzero(data == NEWLINE)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(heads))
    line = np.searchsorted(breaks, starts) - np.searchsorted(breaks, offsets)[row]
    return span_hashes(data, starts, ends), row, line


def _size_class(counts: np.ndarray | float) -> np.ndarray:
    return np.minimum(63, 1 + 2 * np.log2(np.asarray(counts) + 1)).astype(np.uint8)


class Rarity:
    """Logarithmic class of each token's frequency, at most 63; 0 for what is not among the frequent ones."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        order = np.argsort(tokens)
        self.known = SortedHashes(tokens[order])
        self.classes = np.append(_size_class(counts[order]), np.uint8(0))

    def of(self, tokens: np.ndarray) -> np.ndarray:
        return self.classes[self.known.find(tokens)]


class LineSets:
    """The token sets of all lines with words of some rows, each set ordered by rarity."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, rarity: Rarity):
        hashes, row, line = _line_words(data, offsets)
        fresh = np.ones(len(hashes), bool)
        fresh[1:] = (row[1:] != row[:-1]) | (line[1:] != line[:-1])
        owner = np.cumsum(fresh) - 1
        at = np.flatnonzero(fresh)
        self.row, self.line = row[at], line[at]
        rank = rarity.of(hashes)
        if len(at) < 1 << 24:
            order = np.argsort(owner.astype(U64) << U64(40) | rank.astype(U64) << U64(34) | hashes >> U64(30))
            owner, rank, hashes = owner[order], rank[order], hashes[order]
            same = (owner[1:] == owner[:-1]) & (rank[1:] == rank[:-1]) & (hashes[1:] < hashes[:-1])
            if same.any():  # the sort key leaves out 30 bits of the hash
                order = np.lexsort((hashes, rank, owner))
                owner, rank, hashes = owner[order], rank[order], hashes[order]
        else:
            order = np.lexsort((hashes, rank, owner))
            owner, rank, hashes = owner[order], rank[order], hashes[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
        self.tokens, self.rank, owner = hashes[new], rank[new], owner[new]
        self.edges = np.searchsorted(owner, np.arange(len(at) + 1))
        self.sizes = np.diff(self.edges)
        self.k1 = self._digest(0xC2B2AE3D27D4EB4F)
        self.k2 = self._digest(0x165667B19E3779F9)
        # two words; one bit of the hash chooses the word, six the bit
        bit, upper = U64(1) << (self.tokens >> U64(51) & U64(63)), self.tokens >> U64(57) & U64(1) == 1
        self.signs = [np.bitwise_or.reduceat(np.where(side, bit, U64(0)), self.edges[:-1]) if len(self.sizes) else np.zeros(0, U64) for side in (~upper, upper)]

    def _digest(self, salt: int) -> np.ndarray:
        if not len(self.sizes):
            return np.zeros(0, U64)
        return mix(np.add.reduceat(mix(self.tokens ^ U64(salt)), self.edges[:-1]) + self.sizes.astype(U64))


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _lists(values: np.ndarray, edges: np.ndarray, chosen: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The first ``lengths`` values of each chosen range as lists; other ranges give empty lists."""
    lengths = np.where(chosen, lengths, 0)
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    at = np.arange(bounds[-1]) - np.repeat(bounds[:-1], lengths) + np.repeat(edges[:-1], lengths)
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), _long(values[at]))


def _rarity(texts: DataFrame) -> Rarity:
    """Frequencies of the most frequent tokens of all texts; at most FREQUENT_TOKENS of them reach the driver.

    A task hands on what it has met LEAST_IN_TASK times. The order decides what the join has to look at, never what it
    finds, so that tokens a task forgets cost time only.
    """

    def counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = KeyCounts()
        for part in parts:
            data, offsets = text_buffers(part.column("text"))
            for first, last in row_chunks(offsets):
                low = LOWER[data[offsets[first] : offsets[last]]]
                starts, ends, _ = word_spans(low, offsets[first : last + 1] - offsets[first], BLANKS)
                total.add(span_hashes(low, starts, ends))
                if total.size > HELD_TOKENS:
                    total.merge()
                    if total.size > HELD_TOKENS // 2:
                        total.held = [(k[n > 1], n[n > 1]) for k, n in total.held]
                        total.size = sum(len(k) for k, _ in total.held)
        for keys, counts in total.taken():
            often = counts >= LEAST_IN_TASK
            yield pa.RecordBatch.from_arrays([_long(keys[often]), pa.array(counts[often])], names=["token", "n"])

    rows = texts.select("text").mapInArrow(counted, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    path = scratch_path(texts.sparkSession, "tokens")
    rows = saved(texts.sparkSession, rows, path=path)
    room, least = FREQUENT_TOKENS, 1 << 40
    sizes = rows.groupBy(F.floor(4 * F.log2("n")).alias("size")).agg(F.min("n").alias("n"), F.count(F.lit(1)).alias("tokens")).collect()
    for size in sorted(sizes, key=lambda size: -size["n"]):
        if size["tokens"] > room:
            break
        room, least = room - size["tokens"], size["n"]
    table = rows.filter(F.col("n") >= least).toArrow()
    discard(texts.sparkSession, path)
    return Rarity(table.column("token").to_numpy().view(U64), table.column("n").to_numpy())


def _line_table(spark: SparkSession, texts: DataFrame, rarity: Rarity, percent: int, limit: int) -> DataFrame:
    """(id, th, line, lines, k1, k2, n, s0, s1, prefix, hot) of every line with words.

    ``lines``, how many such lines the text has, stands at the first of them; prefix only where a task first sees a
    class. The sign s0, s1 has a bit for each token, several tokens sharing one; the last ``hot`` tokens of a prefix may
    stand in more than ``limit`` lines.
    """
    held = spark.sparkContext.broadcast(rarity)
    hot_from = _size_class(limit)

    def listed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, U64)
        for part in parts:
            data, offsets = text_buffers(part.column("text"))
            ids, hashes = (part.column(c).to_numpy(zero_copy_only=False) for c in ("id", "th"))
            for first, last in row_chunks(offsets):
                low = LOWER[data[offsets[first] : offsets[last]]]
                sets = LineSets(low, offsets[first : last + 1] - offsets[first], held.value)
                firsts = np.zeros(len(sets.k1), bool)
                firsts[np.unique(sets.k1, return_index=True)[1]] = True
                firsts &= ~np.isin(sets.k1, seen)
                seen = np.concatenate([seen, sets.k1[firsts]])
                if len(seen) > 1 << 20:
                    seen = seen[len(seen) // 2 :]
                prefix = sets.sizes - -(-percent * sets.sizes // 100) + 1
                place = np.arange(len(sets.tokens)) - np.repeat(sets.edges[:-1], sets.sizes)
                often = (sets.rank >= hot_from) & (place < np.repeat(prefix, sets.sizes))
                hot = np.add.reduceat(often, sets.edges[:-1], dtype=np.int32) if len(sets.sizes) else np.zeros(0, np.int32)
                head = np.concatenate([[True], sets.row[1:] != sets.row[:-1]])[: len(sets.row)]
                lines = pa.array(np.bincount(sets.row, minlength=last - first)[sets.row], pa.int32(), mask=~head)
                columns = [pa.array(ids[first:last][sets.row]), pa.array(hashes[first:last][sets.row]),
                           pa.array(sets.line, pa.int32()), lines, _long(sets.k1), _long(sets.k2),
                           pa.array(sets.sizes, pa.int32()), *map(_long, sets.signs), _lists(sets.tokens, sets.edges, firsts, prefix),
                           pa.array(hot, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "th", "line", "lines", "k1", "k2", "n", "s0", "s1", "prefix", "hot"])

    schema = "id long, th long, line int, lines int, k1 long, k2 long, n int, s0 long, s1 long, prefix array<long>, hot int"
    return saved(spark, texts.mapInArrow(listed, schema), "lines")


#: Columns of packed prefix entries, one after the other: 32 bits of the token, class, size, place in the prefix, sign.
ENTRY = [("token", np.uint32), ("k1", np.int64), ("n", np.int32), ("place", np.int32), ("s0", np.int64), ("s1", np.int64)]
ENTRY_BYTES = sum(np.dtype(kind).itemsize for _, kind in ENTRY)
MET = "k long, label long, token long, n int, place int, s0 long, s1 long"


def _unpacked(raws: list[bytes]) -> list[np.ndarray]:
    """The columns of some packed entries, sorted by token and size."""
    pieces = []
    for raw in raws:
        n, at, columns = len(raw) // ENTRY_BYTES, 0, []
        for _, kind in ENTRY:
            columns.append(np.frombuffer(raw, kind, n, at))
            at += n * np.dtype(kind).itemsize
        pieces.append(columns)
    columns = [np.concatenate(x) for x in zip(*pieces)]
    order = np.lexsort((columns[2], columns[0]))
    return [c[order] for c in columns]


def _packed(lines: DataFrame, buckets: int) -> DataFrame:
    """(bucket, hot, entries): the prefix entries of the classes, packed by bucket of their tokens."""

    def packed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def taken() -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate(x) for x in zip(*held)]
            group = columns[0] * 2 + columns[1]
            order = np.argsort(group, kind="stable")
            starts = np.flatnonzero(np.concatenate([[True], group[order][1:] != group[order][:-1]]))
            kinds, columns = group[order][starts], [c[order] for c in columns[2:]]
            raws = [b"".join(c[a:b].tobytes() for c in columns) for a, b in zip(starts, [*starts[1:], len(order)])]
            arrays = [pa.array(kinds >> 1, pa.int32()), pa.array(kinds & 1 == 1), pa.array(raws, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["bucket", "hot", "entries"])

        for part in parts:
            lists = part.column("prefix")
            sizes = np.diff(lists.offsets.to_numpy())
            tokens = lists.flatten().to_numpy(zero_copy_only=False).view(U64)
            if not len(tokens):
                continue
            k1, n, hot, *signs = (np.repeat(part.column(c).to_numpy(zero_copy_only=False), sizes) for c in ("k1", "n", "hot", "s0", "s1"))
            place = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            often = place >= np.repeat(sizes, sizes) - hot
            bucket = ((tokens >> U64(32)) % U64(buckets)).astype(np.int64)
            held.append([bucket, often.astype(np.int64), (tokens & U64(0xFFFFFFFF)).astype(np.uint32), k1, n.astype(np.int32), place.astype(np.int32), *signs])
            size += len(tokens)
            if size > HELD_ENTRIES:
                yield from taken()
                held, size = [], 0
        if held:
            yield from taken()

    rows = lines.filter(F.size("prefix") > 0).select("k1", "n", "s0", "s1", "prefix", "hot")
    return rows.mapInArrow(packed, "bucket int, hot boolean, entries binary")


def _near_pairs(token: np.ndarray, k1: np.ndarray, n: np.ndarray, place: np.ndarray, s0: np.ndarray, s1: np.ndarray, percent: int) -> Iterator[tuple]:
    """Places of different classes at one token that pass the filters; entries, sorted by token and size, are compared
    that lie one, two, three ... apart.

    The filters: prefix (the smaller set needs a shorter one: its size minus the overlap that two sets of its size would
    need), length, position, and that the signs leave enough common tokens.
    """
    n, place, whole = n.astype(np.int64), place.astype(np.int64), 100 + percent
    left, found, size = np.flatnonzero((n - place) * whole >= n * 2 * percent), [], 0
    for apart in range(1, len(token)):
        left = left[left + apart < len(token)]
        left = left[(token[left] == token[left + apart]) & (n[left] * 100 >= n[left + apart] * percent)]
        if not len(left):
            break
        x, y = left, left + apart
        needed = (n[x] + n[y]) * percent
        fits = (k1[x] != k1[y]) & (np.minimum(n[x] - place[x], n[y] - place[y]) * whole >= needed)
        x, y, needed = x[fits], y[fits], needed[fits]
        gone = np.bitwise_count((s0[x] & ~s0[y]).view(U64)).astype(np.int64) + np.bitwise_count((s1[x] & ~s1[y]).view(U64))
        more = np.bitwise_count((s0[y] & ~s0[x]).view(U64)).astype(np.int64) + np.bitwise_count((s1[y] & ~s1[x]).view(U64))
        fits = ((n[x] - gone) * whole >= needed) & ((n[y] - more) * whole >= needed)
        found.append((x[fits], y[fits]))
        size += int(fits.sum())
        if size > SEEN_PAIRS:
            yield tuple(map(np.concatenate, zip(*found)))
            found, size = [], 0
    if size:
        yield tuple(map(np.concatenate, zip(*found)))


def _labels(columns: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes that are paired with another, and the least class that the pairs among these entries lead to from each."""
    known, index = np.unique(columns[1], return_inverse=True)
    label, paired = np.arange(len(known)), np.zeros(len(known), bool)
    for x, y in _near_pairs(*columns, percent):
        x, y = index[x], index[y]
        paired[x] = paired[y] = True
        while True:
            a, b = label[x], label[y]
            apart = a != b
            if not apart.any():
                break
            x, y, a, b = x[apart], y[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label[label] != label).any():
                label = label[label]
    return known[paired], known[label[paired]]


def _paired(packed: DataFrame, percent: int, limit: int, tasks: int) -> DataFrame:
    """``MET`` rows (k, label) of classes that a bucket's pairs join together; and, with a null label, the entries of
    tokens with over ``limit``.

    A task holds the entries of one bucket at a time. Entries that may be of such tokens are handed through unmet.
    """
    names = ["k", "label", "token", "n", "place", "s0", "s1"]

    def passed_on(bucket: int, token: np.ndarray, k1: np.ndarray, *rest: np.ndarray) -> pa.RecordBatch:
        key = np.int64(bucket) << 32 | token.astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(k1), pa.nulls(len(k1), pa.int64()), pa.array(key), *map(pa.array, rest)], names=names)

    def met(bucket: int, raws: list[bytes]) -> Iterator[pa.RecordBatch]:
        columns = _unpacked(raws)
        token = columns[0]
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        sizes = np.diff(np.append(starts, len(token)))
        many, alone = (np.repeat(x, sizes) for x in (sizes > limit, sizes == 1))
        if many.any():
            yield passed_on(bucket, *[c[many] for c in columns])
        yield _met_rows(*_labels([c[~many & ~alone] for c in columns], percent))

    def compared(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, raws = None, []
        for part in parts:
            for bucket, hot, raw in zip(*[part.column(c).to_pylist() for c in ("bucket", "hot", "entries")]):
                if hot:
                    yield passed_on(bucket, *_unpacked([raw]))
                    continue
                if bucket != current and raws:
                    yield from met(current, raws)
                    raws = []
                current = bucket
                raws.append(raw)
        if raws:
            yield from met(current, raws)

    # what is hot is dealt evenly, the rest by bucket
    deal = F.when(F.col("hot"), F.pmod(F.xxhash64("entries"), F.lit(tasks)).cast("int")).otherwise(F.col("bucket"))
    dealt = packed.withColumn("deal", deal).repartition(tasks, "deal").sortWithinPartitions("hot", "bucket")
    return dealt.mapInArrow(compared, MET)


def _met_rows(k: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
    rest = [pa.nulls(len(k), kind) for kind in (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(k), pa.array(label), *rest], names=["k", "label", "token", "n", "place", "s0", "s1"])


def _members(spark: SparkSession, lines: DataFrame, percent: int, limit: int) -> DataFrame:
    """(k, label): groups of classes such that any two that pass the filters on a common prefix token share a group.

    A pair is never a row: what is found at a bucket's tokens is joined together there, and each class gets the name of
    its group, the least class in it. Entries of a token with over ``limit`` are cut into pieces that meet two by two.
    """
    entries = lines.agg(F.coalesce(F.sum(F.size("prefix")), F.lit(0))).first()[0]
    buckets = max(1, -(-entries // BUCKET_ENTRIES))
    tasks = max(buckets, spark.sparkContext.defaultParallelism)
    path = scratch_path(spark, "met")
    found = saved(spark, _paired(_packed(lines, buckets), percent, limit, tasks), path=path)
    rows = found.filter("label is null").drop("label").distinct()
    sizes = rows.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / limit).cast("int").alias("pieces")).withColumnRenamed("token", "t")
    rows = rows.join(sizes, F.col("token") == F.col("t")).withColumn("mine", F.pmod(F.xxhash64("k"), F.col("pieces")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))
    rows = rows.withColumn("other", other).withColumn("cell", F.xxhash64("token", F.least("mine", "other"), F.greatest("mine", "other")))

    def compared(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held = ["cell", "k", "n", "place", "s0", "s1"], []
        for part in parts:
            held.append([part.column(c).to_numpy(zero_copy_only=False) for c in names])
            cells = held[-1][0]
            if len(held[-1][0]) and held[0][0][0] != cells[-1]:  # all cells but the last are whole
                columns = [np.concatenate(x) for x in zip(*held)]
                last = columns[0] == columns[0][-1]
                yield _met_rows(*_by_cell([c[~last] for c in columns], percent))
                held = [[c[last] for c in columns]]
        if held:
            yield _met_rows(*_by_cell([np.concatenate(x) for x in zip(*held)], percent))

    crowded = rows.select("cell", "k", "n", "place", "s0", "s1").repartition("cell").sortWithinPartitions("cell", "n")
    labels = found.filter("label is not null").select("k", "label").union(crowded.mapInArrow(compared, MET).select("k", "label"))
    members = saved(spark, labels.distinct(), "members")
    discard(spark, path)
    return members


def _by_cell(columns: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Labels of the entries of some cells, each of which is taken by itself."""
    starts = np.flatnonzero(np.concatenate([[True], columns[0][1:] != columns[0][:-1]]))[: len(columns[0])]
    done = [_labels([np.zeros(b - a, np.uint32), *[c[a:b] for c in columns[1:]]], percent) for a, b in zip(starts, [*starts[1:], len(columns[0])])]
    return tuple(np.concatenate(x) for x in zip(*done)) if done else (np.zeros(0, np.int64),) * 2


def _marks(rows: DataFrame, slot: Column, marks: int) -> np.ndarray:
    """A bit map of the slots of all rows: Spark sets the bits, 64 to a word, and at most ``marks`` / 64 words come here."""
    bit = F.expr("shiftleft(1L, cast(slot & 63 as int))")
    words = rows.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bits = np.zeros(marks // 64, np.int64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return bits


def _marked(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return bits[slots >> 6] >> (slots & 63) & 1 == 1


def _sets(spark: SparkSession, texts: DataFrame, firsts: DataFrame, rarity: Rarity) -> DataFrame:
    """(k1, k2, tokens) of the lines at the places (th, line) of ``firsts``, packed, and of few others; a row may be repeated.

    The sets are made anew from the lines themselves, which a bit map of their places picks out.
    """
    marks = min(MOST_MARKS, max(LEAST_MARKS, 1 << (firsts.count() * MARK_BITS).bit_length()))
    last = marks - 1
    place = F.col("th").bitwiseXOR(F.col("line").cast("long") * LINE_STEP).bitwiseAND(F.lit(last))
    handed = spark.sparkContext.broadcast((rarity, _marks(firsts, place, marks)))

    def fetched(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity, bits = handed.value
        for part in parts:
            data, offsets = text_buffers(part.column("text"))
            hashes = part.column("th").to_numpy(zero_copy_only=False)
            for first, end in row_chunks(offsets):
                low, here = data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
                breaks = np.flatnonzero(low == NEWLINE)
                # a line starts with its row or behind a newline of it, and ends with its row or at a newline
                row = np.concatenate([np.arange(end - first), np.searchsorted(here, breaks, side="right") - 1])
                starts = np.concatenate([here[:-1], breaks + 1])
                order = np.lexsort((starts, row))
                row, starts = row[order], starts[order]
                heads = np.searchsorted(row, np.arange(end - first))
                line = np.arange(len(row)) - heads[row]
                ends = np.append(starts[1:], len(low))
                chosen = np.flatnonzero(_marked(bits, (hashes[first:end][row] ^ (line * LINE_STEP)) & last))
                lengths = ends[chosen] - starts[chosen]
                edges = np.concatenate([[0], np.cumsum(lengths)])
                at = np.arange(edges[-1]) + np.repeat(starts[chosen] - edges[:-1], lengths)
                taken = LOWER[low[at]]
                taken[taken == NEWLINE] = 32  # each line is a row of its own now
                sets = LineSets(taken, edges, rarity)
                raws = [sets.tokens[a:b].tobytes() for a, b in zip(sets.edges[:-1].tolist(), sets.edges[1:].tolist())]
                yield pa.RecordBatch.from_arrays([_long(sets.k1), _long(sets.k2), pa.array(raws, pa.binary())], names=["k1", "k2", "tokens"])

    return texts.select("text", "th").mapInArrow(fetched, "k1 long, k2 long, tokens binary")


def linked_sets(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of some token sets have a Jaccard similarity of ``percent`` / 100 or more, as a matrix; none with itself."""
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    tokens, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1  # a token of one set is common to none
    inside = (times > 1)[place]
    owner, place = owner[inside], number[place[inside]]
    shared = np.zeros((len(sets), len(sets)), np.float32)
    for a in range(0, int((times > 1).sum()), GROUP_TOKENS):
        here = (place >= a) & (place < a + GROUP_TOKENS)
        held = np.zeros((len(sets), min(GROUP_TOKENS, int((times > 1).sum()) - a)), np.float32)
        held[owner[here], place[here] - a] = 1
        shared += held @ held.T
    linked = np.rint(shared).astype(np.int64) * (100 + percent) >= (sizes[:, None] + sizes[None, :]) * percent
    np.fill_diagonal(linked, False)
    return linked


def _links(spark: SparkSession, texts: DataFrame, classes: DataFrame, members: DataFrame, rarity: Rarity, percent: int) -> DataFrame:
    """(k1, k2, n_links, linked): how many other classes each is linked to, by the exact Jaccard similarity of their token
    sets, and the first place of those.

    A set travels once to each group of its class, and the sets of a group meet in one task, or in cells where it is
    large. Two classes that share several groups, or cells, count in the first only.
    """
    groups = members.groupBy("k").agg(F.sort_array(F.collect_list("label")).alias("labels"))
    large = members.groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > GROUP_CLASSES // 2)
    large = large.select(F.col("label").alias("l"), F.ceil(F.col("n") / (GROUP_CLASSES // 2)).cast("int").alias("pieces"))
    there = classes.join(groups, F.col("k1") == F.col("k"), "left_semi")
    places = saved(spark, there.select("k1", "k2", "place"), "first-places")
    sets = _sets(spark, texts, places.select("place.th", "place.line"), rarity)
    sets = sets.groupBy("k1", "k2").agg(F.first("tokens").alias("tokens"))
    whole = places.join(sets, ["k1", "k2"]).join(groups, F.col("k1") == F.col("k")).drop("k")
    met = whole.withColumn("label", F.explode("labels")).join(large, F.col("label") == F.col("l"), "left")
    pieces = F.coalesce("pieces", F.lit(1))
    met = met.withColumn("piece", F.pmod(F.xxhash64("k1", "k2"), pieces).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), pieces - 1)))
    met = met.withColumns({"i": F.least("piece", "other"), "j": F.greatest("piece", "other")}).withColumn("cell", F.xxhash64("label", "i", "j"))
    met = met.select("cell", "label", "i", "j", "piece", "k1", "k2", "place.id", "place.line", "place.th", "labels", "tokens")

    def group(rows: list[tuple]) -> list[tuple]:
        _, label, i, j, _, *_ = rows[0]
        linked = linked_sets([np.frombuffer(r[11], np.int64) for r in rows], percent)
        piece = np.array([r[4] for r in rows])
        if i != j:  # pairs within a piece meet in its own cell
            linked &= piece[:, None] != piece[None, :]
        several = [k for k, r in enumerate(rows) if r[10][0] != label]
        for x in several:  # counted in an earlier group that both are in
            before = set(r for r in rows[x][10] if r < label)
            for y in np.flatnonzero(linked[x]).tolist():
                if not before.isdisjoint(rows[y][10]):
                    linked[x, y] = linked[y, x] = False
        order = sorted(range(len(rows)), key=lambda k: rows[k][7:10])
        rank = np.empty(len(rows), np.int64)
        rank[order] = np.arange(len(rows))
        first = np.where(linked, rank[None, :], len(rows)).min(axis=1)
        counts = linked.sum(axis=1)
        return [(rows[k][5], rows[k][6], int(counts[k]), *rows[order[first[k]]][7:10]) for k in np.flatnonzero(counts).tolist()]

    def compared(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for part in parts:
            found = []
            for row in zip(*[c.to_pylist() for c in part.columns]):
                if held and row[0] != held[0][0]:
                    found += group(held) if len(held) > 1 else []
                    held = []
                held.append(row)
            yield batch(found)
        yield batch(group(held) if len(held) > 1 else [])

    def batch(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found)) if found else [()] * 6
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["k1", "k2", "n", "id", "line", "th"])

    links = met.repartition("cell").sortWithinPartitions("cell").mapInArrow(compared, "k1 long, k2 long, n long, id long, line int, th long")
    return links.groupBy("k1", "k2").agg(F.sum("n").alias("n_links"), F.min(F.struct("id", "line", "th")).alias("linked"))


def _texts(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, th, text): th tells apart texts of one id; a null id comes last."""
    return docs.select(
        F.coalesce(F.col(f"`{id_column}`").cast("long"), F.lit(LAST_ID)).alias("id"),
        F.xxhash64(F.col(f"`{text}`")).alias("th"), F.col(f"`{text}`").alias("text"),
    )


def later_lines(
    spark: SparkSession, docs: DataFrame, percent: int = PERCENT, id_column: str = "doc_id", text: str = "text",
    limit: int = PAIRED_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """The lines that repeat an earlier one, and the number of lines of each text.

    First table: (id, th, line, n_links) of every line with words whose token set stands in another line or is linked to
    another set, with ``later`` true if an earlier line of the same or another text has a Jaccard similarity of
    ``percent`` / 100 or more; n_links counts the different token sets linked to the line's. Second table: (id, th,
    n_lines) of every text with words.

    Lines are split at newlines and numbered from 0; tokens are the distinct runs of bytes other than space and
    09-0D with A-Z lowered; a line without tokens is never compared. Lines are ordered by (id, line, hash of the text),
    null ids last; lines at equal places, which repeated rows have, do not repeat each other.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must lie between 50 and 100")
    texts = _texts(docs, id_column, text)
    rarity = _rarity(texts)
    lines = _line_table(spark, texts, rarity, percent, limit)
    place = F.struct("id", "line", "th")
    members = _members(spark, lines, percent, limit)
    classes = saved(spark, lines.groupBy("k1", "k2").agg(F.min(place).alias("place"), F.count(F.lit(1)).alias("rows")), "classes")
    least = saved(spark, _links(spark, texts, classes, members, rarity, percent), "links")
    # a class of one line without a link marks nothing
    bounds = classes.join(least, ["k1", "k2"], "left").filter("rows > 1 or n_links > 0").select(
        "k1", "k2", F.least("place", F.coalesce("linked", "place")).alias("first"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
    bounds = saved(spark, bounds, "bounds")
    marked = lines.select("id", "th", "line", "k1", "k2").join(bounds, ["k1", "k2"])
    marked = marked.select("id", "th", "line", "n_links", (place > F.col("first")).alias("later"))
    sizes = lines.filter("lines is not null").groupBy("id", "th").agg(F.max("lines").cast("long").alias("n_lines"))
    return marked, sizes


def _by_text(marked: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per text with words: its later lines, how many links its lines have, and how many lines; repeated rows count once."""
    found = marked.groupBy("id", "th").agg(F.collect_set(F.struct("line", "n_links", "later")).alias("found"))
    found = sizes.join(found, ["id", "th"], "left")
    removed = F.transform(F.filter("found", lambda x: x["later"]), lambda x: x["line"])
    links = F.aggregate("found", F.lit(0).cast("long"), lambda total, x: total + x["n_links"])
    return found.select(
        "id", "th", F.sort_array(F.coalesce(removed, F.array().cast("array<int>"))).alias("removed_lines"),
        F.coalesce(links, F.lit(0)).alias("n_links"), "n_lines",
    )


def _joined(docs: DataFrame, found: DataFrame, id_column: str, text: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with the columns of ``found`` (by id and th) added under names that are free; and those names."""
    names = []
    for column in found.columns:
        name = fresh_name(docs, f"{column}_found")
        found, names = found.withColumnRenamed(column, name), [*names, name]
    here, th = F.coalesce(F.col(f"`{id_column}`").cast("long"), F.lit(LAST_ID)), F.xxhash64(F.col(f"`{text}`"))
    return docs.join(found, (here == F.col(names[0])) & (th == F.col(names[1])), "left"), names


def line_report(
    spark: SparkSession, docs: DataFrame, percent: int = PERCENT, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row of ``docs``, without its text: n_lines (with words), n_links and removed_lines, see ``later_lines``.

    A null, empty or blank text has no lines. Repeated rows get the same result each, n_lines of one of them. Columns
    named like the results are replaced; an empty table gives an empty result.
    """
    marked, sizes = later_lines(spark, docs, percent, id_column, text)
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("n_lines", "n_links", "removed_lines")])
    joined, names = _joined(docs, _by_text(marked, sizes), id_column, text)
    return joined.select(
        *[F.col(f"`{c}`") for c in docs.columns if c != text],
        F.coalesce(names[4], F.lit(0).cast("long")).alias("n_lines"),
        F.coalesce(names[3], F.lit(0).cast("long")).alias("n_links"),
        F.coalesce(names[2], F.array().cast("array<int>")).alias("removed_lines"),
    )


def lines_removed(
    spark: SparkSession, docs: DataFrame, percent: int = PERCENT, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``docs`` without the lines that repeat an earlier one; a text that loses all its words loses its row.

    Texts without words, null or not, stay as they are; so do repeated rows, of which each keeps the same lines.
    """
    marked, sizes = later_lines(spark, docs, percent, id_column, text)
    found = _by_text(marked, sizes).filter(F.size("removed_lines") > 0)
    joined, names = _joined(docs, found, id_column, text)
    gone, n_lines, kept = names[2], names[4], docs.columns

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = part.column(text).to_pylist()
            for k, numbers in enumerate(part.column(gone).to_pylist()):
                if numbers:
                    out = set(numbers)
                    texts[k] = "\n".join([line for i, line in enumerate(texts[k].split("\n")) if i not in out])
            columns = [pa.array(texts, pa.string()) if c == text else part.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays(columns, names=kept)

    left = joined.filter(F.col(gone).isNull() | (F.size(gone) < F.col(n_lines)))
    return left.select(*[F.col(f"`{c}`") for c in docs.columns], gone).mapInArrow(batches, docs.schema)
