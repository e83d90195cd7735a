"""How far the sources of a language differ in their words: distances of source pairs and the terms that mark a source.

The terms kept of a language are sorted and become a minimal acyclic transducer, which accepts each and gives its place in
UTF-8 order. All texts stream through it once more to be counted; from then on a term is a number.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave.llm.flat import KeyCounts, LOWER, row_chunks, text_buffers, word_spans
from riskweave.llm.scratch import saved

#: Separators of terms: what is ASCII and no letter.
NO_LETTERS = np.isin(np.arange(256), [b for b in range(0x80) if not chr(b).isalpha()])
TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
#: A piece of the vocabulary ends after so many terms or bytes; one pass over the texts takes pieces of so many bytes.
PIECE_TERMS, PIECE_BYTES, PASS_BYTES = 100_000, 1 << 21, 1 << 25
#: Terms, and bytes of them, that a task counts before it hands them on.
HELD_TERMS, HELD_BYTES = 400_000, 1 << 25
#: Cells (sources x terms) of a block of counts, about; as many terms as sources while there are no more than MOST_CELLS.
CELLS, MOST_CELLS = 1 << 16, 1 << 22
SCALE_THOUSANDS = 3  # shares are in units of 1000 ** -3


class Transducer:
    """A minimal acyclic automaton over bytes that numbers the terms it accepts in their order.

    An edge carries how many accepted terms come before those that take it; a term's number is the sum along its path.
    """

    def __init__(self, keys: np.ndarray, targets: np.ndarray, skips: np.ndarray, finals: np.ndarray):
        self.keys, self.targets, self.skips, self.finals = keys, targets, skips, finals

    @classmethod
    def build(cls, terms: Iterable[bytes]) -> Transducer:
        """From distinct terms in ascending order; states with the same future are one, whenever the next term leaves them."""
        known: dict[tuple, int] = {}
        reach: list[int] = []
        path: list[tuple[list[bool], list[tuple[int, int]]]] = [([False], [])]
        last = b""

        def settled() -> int:
            final, edges = path.pop()
            future = (final[0], *edges)
            state = known.setdefault(future, len(known))
            if state == len(reach):
                reach.append(final[0] + sum(reach[target] for _, target in edges))
            return state

        def leave(depth: int) -> None:
            while len(path) > depth + 1:
                state = settled()
                path[-1][1].append((last[len(path) - 1], state))

        for term in terms:
            if term <= last and (last or path[0][0][0]):
                raise ValueError("terms must be distinct and ascending")
            shared, most = 0, min(len(term), len(last))
            while shared < most and term[shared] == last[shared]:
                shared += 1
            leave(shared)
            path.extend(([False], []) for _ in range(len(term) - shared))
            path[-1][0][0] = True
            last = term
        leave(0)
        root = settled()
        keys, targets, skips = [], [], []
        top = root  # the root takes number 0, and the state that had it the root's
        renamed = lambda s: 0 if s == root else top if s == 0 else s
        order = sorted(((renamed(state), future) for future, state in known.items()))
        finals = np.zeros(len(known), bool)
        for state, (final, *edges) in order:
            finals[state] = final
            before = int(final)
            for byte, target in edges:
                keys.append(state << 8 | byte)
                targets.append(renamed(target))
                skips.append(before)
                before += reach[target]
        return cls(np.array(keys, np.int64), np.array(targets, np.int32), np.array(skips, np.int32), finals)

    def to_bytes(self) -> bytes:
        head = np.array([len(self.keys), len(self.finals)], np.int64)
        return b"".join(x.tobytes() for x in (head, self.keys, self.targets, self.skips, self.finals))

    @classmethod
    def from_bytes(cls, raw: bytes) -> Transducer:
        edges, states = np.frombuffer(raw, np.int64, 2).tolist()
        at = [16, 16 + 8 * edges, 16 + 12 * edges, 16 + 16 * edges]
        return cls(
            np.frombuffer(raw, np.int64, edges, at[0]), np.frombuffer(raw, np.int32, edges, at[1]),
            np.frombuffer(raw, np.int32, edges, at[2]), np.frombuffer(raw, bool, states, at[3]),
        )

    def numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each span of bytes, or -1; all spans step on by one byte at a time, until they fail or end."""
        result = np.full(len(starts), -1, np.int64)
        at, left = np.asarray(starts, np.int64), ends - starts
        chosen, state, number = np.arange(len(starts)), np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        while len(chosen):
            ended = left == 0
            if ended.any():
                accepted = ended & self.finals[state]
                result[chosen[accepted]] = number[accepted]
                chosen, state, number, at, left = (x[~ended] for x in (chosen, state, number, at, left))
            if not len(self.keys) or not len(chosen):
                break
            wanted = state << 8 | data[at]
            edge = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            found = self.keys[edge] == wanted
            edge = edge[found]
            chosen, at, left = chosen[found], at[found] + 1, left[found] - 1
            state, number = self.targets[edge].astype(np.int64), number[found] + self.skips[edge]
        return result


def _named(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    empty = F.lit("")
    return docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), empty).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])


def document_counts(docs: DataFrame) -> DataFrame:
    """In how many rows each term of a language stands: partial counts of (lang, term), summed up in tasks first."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[bytes, int]] = {}
        size = heavy = 0

        def taken() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                terms, numbers = list(counts), list(counts.values())
                for i in range(0, len(terms), 50_000):
                    some = pa.array(terms[i : i + 50_000], pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), some, pa.array(numbers[i : i + 50_000], pa.int64())], names=["lang", "term", "n"])
            held.clear()

        for part in parts:
            data, offsets = text_buffers(part.column("text"))
            for i, lang in enumerate(part.column("lang").to_pylist()):
                counts = held.setdefault(lang, {})
                before = len(counts)
                for term in set(TERM.findall(data[offsets[i] : offsets[i + 1]].tobytes().lower())):
                    if term in counts:
                        counts[term] += 1
                    else:
                        counts[term] = 1
                        heavy += len(term)
                size += len(counts) - before
                if size > HELD_TERMS or heavy > HELD_BYTES:
                    yield from taken()
                    size = heavy = 0
        yield from taken()

    return docs.select("lang", "text").mapInArrow(batches, "lang string, term string, n long")


def sorted_pieces(kept: DataFrame) -> DataFrame:
    """The rows (lang, term) in order, dealt to pieces (part, seq) of bounded size, with their place ``local`` inside."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part_id, seq, current, local, size = TaskContext.get().partitionId(), -1, None, 0, 0
        for part in parts:
            seqs, locals_ = [], []
            for lang, term in zip(part.column("lang").to_pylist(), part.column("term").to_pylist()):
                if lang != current or local >= PIECE_TERMS or size >= PIECE_BYTES:
                    seq, current, local, size = seq + 1, lang, 0, 0
                seqs.append(seq)
                locals_.append(local)
                local, size = local + 1, size + len(term)
            arrays = [part.column("lang"), part.column("term"), pa.array([part_id] * len(seqs), pa.int32()), pa.array(seqs, pa.int32()), pa.array(locals_, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["lang", "term", "part", "seq", "local"])

    ordered = kept.select("lang", "term").repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    return ordered.mapInArrow(batches, "lang string, term string, part int, seq int, local long")


def _transducer(key: tuple, piece: pa.Table) -> pa.Table:
    piece = piece.sort_by("local")
    raw = Transducer.build(t.encode() for t in piece.column("term").to_pylist()).to_bytes()
    row = {"lang": [key[0].as_py()], "part": pa.array([key[1].as_py()], pa.int32()), "seq": pa.array([key[2].as_py()], pa.int32()),
           "terms": pa.array([len(piece)], pa.int64()), "size": pa.array([len(raw)], pa.int64()), "raw": pa.array([raw], pa.binary())}
    return pa.table(row)


def _recount(docs: DataFrame, shared) -> DataFrame:
    """Occurrences of the numbered terms per (lang, source), summed up in tasks; ``shared`` maps lang to (first, transducer)."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = {lang: [(first, Transducer.from_bytes(raw)) for first, raw in rows] for lang, rows in shared.value.items()}
        groups: dict[tuple[str, str], int] = {}
        counts = KeyCounts()

        def taken() -> Iterator[pa.RecordBatch]:
            names = list(groups)
            langs, sources = (pa.array([n[i] for n in names], pa.string()) for i in (0, 1))
            for keys, numbers in counts.taken():
                for i in range(0, len(keys), 100_000):
                    some = keys[i : i + 100_000]
                    at = pa.array(some >> 40)
                    arrays = [langs.take(at), sources.take(at), pa.array(some & ((1 << 40) - 1)), pa.array(numbers[i : i + 100_000])]
                    yield pa.RecordBatch.from_arrays(arrays, names=["lang", "source", "ordinal", "n"])
            groups.clear()

        for part in parts:
            data, offsets = text_buffers(part.column("text"))
            langs, sources = part.column("lang").to_pylist(), part.column("source").to_pylist()
            for first, last in row_chunks(offsets):
                some = LOWER[data[offsets[first] : offsets[last]]]
                starts, ends, heads = word_spans(some, offsets[first : last + 1] - offsets[first], NO_LETTERS)
                codes = np.array([groups.setdefault(pair, len(groups)) for pair in zip(langs[first:last], sources[first:last])], np.int64)
                row = np.repeat(np.arange(last - first), np.diff(heads))
                kinds: dict[str, list[int]] = {}
                for i, lang in enumerate(langs[first:last]):
                    kinds.setdefault(lang, []).append(i)
                for lang, rows in kinds.items():
                    wanted = np.zeros(last - first, bool)
                    wanted[rows] = True
                    chosen = np.flatnonzero(wanted[row])
                    for base, transducer in pieces.get(lang, ()):
                        number = transducer.numbers(some, starts[chosen], ends[chosen])
                        hit = number >= 0
                        counts.add(codes[row[chosen[hit]]] << 40 | (number[hit] + base))
                        chosen = chosen[~hit]
                if counts.size > 4_000_000:
                    counts.merge()
                if counts.size > 2_000_000 or len(groups) > 200_000:
                    yield from taken()
        yield from taken()

    return docs.mapInArrow(batches, "lang string, source string, ordinal long, n long")


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 + floor(10**9 * counts / totals) in integers, three digits at a time; exact for totals under 9 * 10**15."""
    whole, rest = np.divmod(counts, totals)
    for _ in range(SCALE_THOUSANDS):
        digits, rest = np.divmod(rest * 1000, totals)
        whole = whole * 1000 + digits
    return whole + 1


def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    difference = p - q
    return difference * difference // (p + q)


def _compared(key: tuple, cells: pa.Table, ranks: int) -> pa.Table:
    """Of one block of terms: the sum of gaps of every source pair, and each source's first ``ranks`` terms."""
    names = ("s", "ordinal", "n", "kept", "width")
    s, ordinal, n, kept, width = (cells.column(c).to_numpy() for c in names)
    head = ordinal < 0
    sources = int(head.sum())
    v, wide = int(kept[head][0]), int(width[head][0])
    first = key[1].as_py() * wide
    totals = np.zeros(sources, np.int64)
    totals[s[head]] = n[head]
    counts = np.zeros((sources, min(wide, v - first)), np.int64)
    counts[s[~head], ordinal[~head] - first] = n[~head]
    p = shares(counts + 2, totals[:, None] + 2 * v)
    q = shares(counts.sum(axis=0) + 2, totals.sum() + 2 * v)
    rows: list[tuple[np.ndarray, ...]] = []
    for a in range(sources - 1):
        sums = gaps(p[a + 1 :], p[a]).sum(axis=1)
        rows.append((np.zeros(len(sums), np.int64), np.full(len(sums), a), np.arange(a + 1, sources), sums))
    for a in range(sources):
        marking = np.flatnonzero((counts[a] > 0) & (p[a] > q))
        value = gaps(p[a, marking], q[marking])
        best = np.lexsort((marking, -value))[:ranks]
        rows.append((np.ones(len(best), np.int64), np.full(len(best), a), marking[best] + first, value[best]))
    kind, a, b, value = (np.concatenate(x).astype(np.int64) for x in zip(*rows))
    return pa.table({"lang": pa.array([key[0].as_py()] * len(a), pa.string()), "kind": kind, "a": a, "b": b, "value": value})


def source_divergence(
    spark: SparkSession, docs: DataFrame, least: int = 10, ranks: int = 10, text: str = "text", lang: str = "lang", source: str = "source",
) -> DataFrame:
    """Per (lang, source): ``part`` pair with every other source of the language and its distance, and ``part`` term with
    the ``ranks`` terms that the source uses most above its language; columns lang, source, part, item, value, rank.

    Terms are runs of letters and non-ASCII characters with A-Z lowered; a language keeps those in at least ``least`` of
    its rows. A group gives a kept term the share p = 1 + floor(10**9 (count + 2) / (N + 2V)), two groups differ by
    floor((p - q)**2 / (p + q)) summed over all kept terms. All in integers, exact below 9 * 10**15 occurrences.

    Null text, lang and source are the empty text; every row is a document, repeated or not, with or without text; other
    columns are not read. Ties go to the smaller item in UTF-8 order. A language without kept terms has pairs of value 0, a
    language of one source no pairs; an empty table gives an empty result. Whole texts are read, whatever their length.

    Texts are read twice: for the rows a term stands in, and, through the transducers, for its occurrences. A transducer
    holds at most ``PIECE_TERMS`` terms; those of ``PASS_BYTES`` are broadcast at a time, and a larger vocabulary takes
    more passes. Counts are compared in blocks of terms with about ``CELLS`` cells (source and term).
    """
    docs = _named(docs, text, lang, source)
    kept = document_counts(docs).groupBy("lang", "term").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    terms = saved(spark, sorted_pieces(saved(spark, kept.drop("n"), "kept-terms")), "sorted-terms")
    layout = "lang string, part int, seq int, terms long, size long, raw binary"
    pieces = saved(spark, terms.groupBy("lang", "part", "seq").applyInArrow(_transducer, layout), "transducers")

    found = sorted(pieces.select("lang", "part", "seq", "terms", "size").collect(), key=lambda r: (r.lang.encode(), r.part, r.seq))
    firsts, running = [], {}
    for r in found:
        firsts.append((r.lang, r.part, r.seq, running.get(r.lang, 0)))
        running[r.lang] = running.get(r.lang, 0) + r.terms
    passes: list[list[int]] = []
    room = 0
    for i, r in enumerate(found):
        if not passes or r.size > room:
            passes.append([])
            room = PASS_BYTES
        passes[-1].append(i)
        room -= r.size
    counted = None
    for chosen in passes:
        wanted = [f"lang = {_quoted(found[i].lang)} and part = {found[i].part} and seq = {found[i].seq}" for i in chosen]
        raws = {(r.lang, r.part, r.seq): bytes(r.raw) for r in pieces.filter(" or ".join(f"({w})" for w in wanted)).collect()}
        shared: dict[str, list[tuple[int, bytes]]] = {}
        for i in chosen:
            name, *place = firsts[i][:3]
            shared.setdefault(name, []).append((firsts[i][3], raws[(name, *place)]))
        handed = spark.sparkContext.broadcast(shared)
        some = saved(spark, _recount(docs, handed), "term-counts")
        handed.unpersist()
        counted = some if counted is None else counted.unionByName(some)
    if counted is None:
        counted = spark.createDataFrame([], "lang string, source string, ordinal long, n long")

    by_source = Window.partitionBy("lang").orderBy("source")
    groups = saved(spark, docs.select("lang", "source").distinct().withColumn("s", F.row_number().over(by_source) - 1), "groups")
    sizes = spark.createDataFrame(list(running.items()), "lang string, kept long")
    # a block hands on a sum per source pair: with as many terms as sources that is no more than half its cells
    width = F.greatest(F.lit(1), F.least(F.greatest(F.expr(f"{CELLS} div sources"), F.col("sources")), F.expr(f"{MOST_CELLS} div sources")))
    sizes = saved(spark, groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")).join(sizes, "lang").withColumn("width", width), "languages")
    counts = counted.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n"))
    counts = saved(spark, counts.join(groups, ["lang", "source"]).select("lang", "s", "ordinal", "n"), "counts")
    totals = counts.groupBy("lang", "s").agg(F.sum("n").alias("total"))
    heads = (
        groups.join(sizes, "lang").join(totals, ["lang", "s"], "left")
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(kept - 1) div width"))))
        .select("lang", "block", "s", F.lit(-1).cast("long").alias("ordinal"), F.coalesce("total", F.lit(0)).alias("n"), "kept", "width")
    )
    none = F.lit(0).cast("long")
    cells = counts.join(sizes.select("lang", F.col("width").alias("wide")), "lang").select(
        "lang", F.expr("ordinal div wide").alias("block"), "s", "ordinal", "n", none.alias("kept"), none.alias("width"))
    blocks = heads.unionByName(cells).groupBy("lang", "block").applyInArrow(
        lambda key, table: _compared(key, table, ranks), "lang string, kind long, a long, b long, value long")
    blocks = saved(spark, blocks, "compared")

    sums = blocks.filter("kind = 0").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    mine, other = (groups.select("lang", F.col("s").alias(f"s_{n}"), F.col("source").alias(c)) for n, c in (("1", "source"), ("2", "item")))
    ends = [F.least("s_1", "s_2").cast("long").alias("a"), F.greatest("s_1", "s_2").cast("long").alias("b")]
    pairs = mine.join(other, "lang").filter("s_1 <> s_2").select("lang", "source", "item", *ends)
    pairs = pairs.join(sums, ["lang", "a", "b"], "left").select("lang", "source", "item", F.coalesce("value", none).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))

    order = Window.partitionBy("lang", "a").orderBy(F.desc("value"), "b")
    marks = blocks.filter("kind = 1").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= ranks)
    starts = spark.createDataFrame(firsts, "lang string, part int, seq int, first long")
    places = terms.join(starts, ["lang", "part", "seq"]).select("lang", (F.col("first") + F.col("local")).alias("b"), F.col("term").alias("item"))
    marks = marks.join(places, ["lang", "b"]).join(groups.select("lang", F.col("s").cast("long").alias("a"), "source"), ["lang", "a"])
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(columns).unionByName(marks.withColumn("part", F.lit("term")).select(columns))


def _quoted(text: str) -> str:
    """A SQL literal of any text."""
    return f"decode(unhex('{text.encode().hex()}'), 'UTF-8')"
