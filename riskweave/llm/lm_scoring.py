"""Language-model scoring: prediction by partial matching over the whole trie of byte contexts, and a word baseline."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.llm.flat import BLANKS, LOWER, U64, KeyCounts, PackedKeys, SortedHashes, row_chunks, span_hashes, text_buffers, word_spans
from riskweave.llm.kneser_ney import row_sums
from riskweave.llm.scratch import fresh_name, saved

ORDER = 5
#: Most frequent n-grams whose log probabilities are broadcast; those of all others are joined.
MAX_NODES = 3_000_000
#: Bytes of context that n-grams are dealt by; the levels of the trie with fewer, 256 to the power of this nodes at
#: most, are broadcast, the deeper ones are built whole for each part.
DEALT_BY = 3
#: Distinct n-grams of a part, about.
PART_GRAMS = 400_000
#: Most frequent words whose counts are broadcast; the counts of all others are joined.
BROADCAST_WORDS = 300_000
#: Distinct keys whose counts a task holds before it hands them on.
HELD_KEYS = 1_000_000
#: Bytes of text that are scored at a time, but for a longer text.
SCORED_BYTES = 1 << 18
#: Start and end of a text; no byte of UTF-8.
EDGE = 0xFF
#: Bytes of context whose counts in the text so far adapt the model to it, and what such a count weighs against a new symbol.
OWN_CONTEXT, OWN_WEIGHT = 3, 0.25
RESULTS = ("n_tokens", "n_known", "train_tokens", "base_score", "score")


def _mask(length: int) -> np.uint64:
    return U64((1 << (8 * length)) - 1)


def byte_stream(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed, positions, edges): the ``order`` + 1 bytes up to each predicted one, packed; edges delimit the rows.

    Each row is preceded by ``order`` edge bytes and followed by one, which is predicted too.
    """
    rows, lengths = len(offsets) - 1, np.diff(offsets)
    stream = np.full(len(data) + rows * (order + 1), EDGE, np.uint8)
    row = np.repeat(np.arange(rows), lengths)
    stream[np.arange(len(data)) + row * (order + 1) + order] = data
    edges = offsets + np.arange(rows + 1)
    at = np.arange(edges[-1]) + (np.repeat(np.arange(rows), lengths + 1) + 1) * order
    packed = np.zeros(len(at), U64)
    for k in range(order, -1, -1):
        packed = packed << U64(8) | stream[at - k]
    return packed, edges


GRAMS, WORDS, OTHER_GRAMS = range(3)


def _batches(total: KeyCounts, kind: int) -> Iterator[pa.RecordBatch]:
    """The counts as rows; nothing is held any more."""
    for keys, counts in total.taken():
        for a in range(0, len(keys), 200_000):
            piece, times = keys[a : a + 200_000], counts[a : a + 200_000]
            learned = np.zeros_like(times) if kind == OTHER_GRAMS else times
            columns = [pa.array(np.full(len(piece), kind % OTHER_GRAMS, np.int32)), pa.array(piece.view(np.int64)), pa.array(learned), pa.array(times)]
            yield pa.RecordBatch.from_arrays(columns, names=["kind", "key", "n", "times"])


def _counts(texts: DataFrame, order: int) -> DataFrame:
    """(kind, key, n, times): the packed byte n-grams (kind 0) of all ``texts`` (text, learned) and the word hashes
    (kind 1) of the learned ones; how often they occur in the learned ones, and in all that are counted."""

    def counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [KeyCounts(), KeyCounts(), KeyCounts()]
        for whole in parts:
            learned = whole.column("learned")
            for part, use in ((whole.filter(learned), True), (whole.filter(pc.invert(learned)), False)):
                data, offsets = text_buffers(part.column("text"))
                for first, last in row_chunks(offsets):
                    low, here = LOWER[data[offsets[first] : offsets[last]]], offsets[first : last + 1] - offsets[first]
                    totals[GRAMS if use else OTHER_GRAMS].add(byte_stream(low, here, order)[0])
                    if use:
                        starts, ends, _ = word_spans(low, here, BLANKS)
                        totals[WORDS].add(span_hashes(low, starts, ends))
                    for kind, total in enumerate(totals):
                        if total.size > HELD_KEYS:
                            total.merge()
                            if total.size > HELD_KEYS // 2:
                                yield from _batches(total, kind)
        for kind, total in enumerate(totals):
            yield from _batches(total, kind)

    counts = texts.mapInArrow(counted, "kind int, key long, n long, times long")
    return counts.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("times").alias("times"))


class ContextTrie:
    """Escape method C with symbol exclusion over fixed counts, looked up by packed context.

    The symbols after a context all occur after its shorter context too, so those to exclude on arrival at a context
    are exactly the ones seen after the next longer one, and every denominator can be worked out beforehand.
    """

    def __init__(self, order: int, levels: list[tuple[np.ndarray, np.ndarray]]):
        """``levels[d]``: ascending packed n-grams of d + 1 bytes, and their counts."""
        self.order = order
        self.symbols: list[PackedKeys] = []
        self.logs: list[np.ndarray] = []
        self.contexts: list[PackedKeys] = []
        self.first: list[np.ndarray] = []  # log denominator and log escape where a search starts
        self.later: list[np.ndarray] = []  # the same for the next shorter context, without this one's symbols
        below: tuple[np.ndarray, ...] | None = None
        for depth, (grams, counts) in enumerate(levels):
            contexts, head = np.unique(grams >> U64(8), return_index=True)
            total = np.add.reduceat(counts, head) if len(head) else np.zeros(0, np.int64)
            kinds = np.diff(np.append(head, len(grams)))
            later = np.zeros((len(contexts), 2))
            if depth:
                their_grams, their_counts, their_contexts, their_total, their_kinds = below
                excluded = their_counts[np.searchsorted(their_grams, grams & _mask(depth))]
                above = np.searchsorted(their_contexts, contexts & _mask(depth - 1))
                rest = their_total[above] - np.add.reduceat(excluded, head) if len(head) else total
                others = their_kinds[above] - kinds
                filled = others > 0
                later[filled, 0] = np.log((rest + others)[filled])
                later[filled, 1] = np.log(others[filled]) - later[filled, 0]
            denominator = np.log(np.maximum(total + kinds, 1))
            self.first.append(np.column_stack([denominator, np.log(np.maximum(kinds, 1)) - denominator]))
            self.later.append(later)
            self.symbols.append(PackedKeys(grams))
            self.logs.append(np.log(np.maximum(counts, 1)))
            self.contexts.append(PackedKeys(contexts))
            below = grams, counts, contexts, total, kinds
        self.unseen = -np.log(max(1, 256 - len(levels[0][0])))
        top, counts = levels[order]
        owner = np.searchsorted(below[2], top >> U64(8))
        self.top = np.log(np.maximum(counts, 1)) - (self.first[order][owner, 0] if len(top) else 0)

    def logs_of(self, packed: np.ndarray) -> np.ndarray:
        """Natural log probability of the last byte of each packed n-gram after the bytes before it."""
        at = self.symbols[self.order].find(packed)
        result = np.where(at >= 0, self.top[np.maximum(at, 0)] if len(self.top) else 0.0, 0.0)
        left = np.flatnonzero(at < 0)
        longer = np.full(len(left), -1)
        for depth in range(self.order, -1, -1):
            grams = packed[left] & _mask(depth + 1)
            here = self.contexts[depth].find(grams >> U64(8))
            known = np.flatnonzero(here >= 0)
            if len(known):
                starting = longer[known] < 0
                terms = self.first[depth][here[known]]
                if depth < self.order:
                    after = self.later[depth + 1][np.maximum(longer[known], 0)] if len(self.later[depth + 1]) else terms
                    terms = np.where(starting[:, None], terms, after)
                seen = self.symbols[depth].find(grams[known])
                hit = seen >= 0
                result[left[known]] += np.where(hit, self.logs[depth][np.maximum(seen, 0)] - terms[:, 0], terms[:, 1])
                longer[known] = here[known]
                rest = np.ones(len(left), bool)
                rest[known[hit]] = False
                left, longer = left[rest], longer[rest]
            if not len(left):
                return result
        result[left] += self.unseen
        return result


def _gram_logs(spark: SparkSession, grams: DataFrame, order: int) -> DataFrame:
    """(key, times, log): natural log probability of the last byte of each n-gram of ``grams`` (key, n, times) after the
    bytes before it, by the whole trie of the counts n.

    The nodes that an n-gram meets end in the bytes of its context, so those of the levels from DEALT_BY on are all in
    its part when n-grams are dealt by the last DEALT_BY bytes of their contexts.
    """
    dealt_by = min(DEALT_BY, order)
    learned = grams.filter("n > 0")
    shallow = []
    for depth in range(dealt_by):
        key = F.col("key").bitwiseAND(F.lit((1 << (8 * (depth + 1))) - 1))
        table = learned.groupBy(key.alias("key")).agg(F.sum("n").alias("n")).toArrow()
        keys, n = table.column("key").to_numpy().view(U64), table.column("n").to_numpy()
        sort = np.argsort(keys)
        shallow.append((keys[sort], n[sort]))
    held = spark.sparkContext.broadcast(shallow)

    def looked_up(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken = list(parts)
        if not taken:
            return
        table = pa.Table.from_batches(taken)
        keys, n = table.column("key").to_numpy().view(U64), table.column("n").to_numpy()
        sort = np.argsort(keys)
        sort = sort[n[sort] > 0]
        levels = list(held.value)
        for depth in range(dealt_by, order + 1):
            short = keys & _mask(depth + 1)
            place = sort[np.argsort(short[sort], kind="stable")]
            new = np.flatnonzero(np.concatenate([[True], short[place][1:] != short[place][:-1]])) if len(place) else place
            levels.append((short[place][new], np.add.reduceat(n[place], new) if len(place) else n[place]))
        trie = ContextTrie(order, levels)
        times = table.column("times").combine_chunks()
        for a in range(0, len(keys), 200_000):
            piece = keys[a : a + 200_000]
            columns = [pa.array(piece.view(np.int64)), times.slice(a, len(piece)), pa.array(trie.logs_of(piece))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "times", "log"])

    parts = max(spark.sparkContext.defaultParallelism, -(-grams.count() // PART_GRAMS))
    context = F.shiftrightunsigned("key", 8).bitwiseAND(F.lit((1 << (8 * dealt_by)) - 1))
    return grams.repartition(parts, context).mapInArrow(looked_up, "key long, times long, log double")


def _often(counts: DataFrame, column: str, room: int) -> int:
    """The least ``column`` from which on at most ``room`` rows of ``counts`` have it."""
    sizes = counts.groupBy(F.least(column, F.lit(100_000)).alias("n")).agg(F.count(F.lit(1)).alias("rows")).collect()
    often = 100_001
    for size in sorted(sizes, key=lambda size: -size["n"]):
        if size["rows"] > room:
            break
        room, often = room - size["rows"], size["n"]
    return often


def _earlier(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How often each key stands at an earlier place; the order that groups equal keys by place; and each group's start in it."""
    places = len(keys).bit_length()
    if len(keys) and int(keys.max()).bit_length() + places <= 64:  # sorting the places with the keys is several times faster
        ordered = np.sort(keys << U64(places) | np.arange(len(keys), dtype=U64))
        order = (ordered & U64((1 << places) - 1)).astype(np.int64)
        ordered >>= U64(places)
    else:
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    start = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
    times = np.empty(len(keys), np.int64)
    times[order] = np.arange(len(keys)) - start
    return times, order, start


def own_shares(packed: np.ndarray, edges: np.ndarray, context: int, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) of each predicted byte: a + b p is its probability when the trie gives p and the text so far is counted too.

    Of the occurrences of the ``context`` bytes before it in its own text so far, ``weight`` each, those followed by the
    same byte make a; the escape to the trie gets as much as different bytes have followed (method C). A context that is
    new to the text leaves p alone.
    """
    row = np.repeat(np.arange(len(edges) - 1), np.diff(edges)).astype(U64)
    same, _, _ = _earlier(row << U64(8 * context + 8) | (packed & _mask(context + 1)))
    seen, order, start = _earlier(row << U64(8 * context) | (packed >> U64(8) & _mask(context)))
    fresh = (same == 0)[order].astype(np.int64)
    upto = np.cumsum(fresh) - fresh
    kinds = np.empty(len(packed), np.int64)
    kinds[order] = upto - upto[start] if len(start) else upto
    whole = np.where(seen > 0, weight * seen + kinds, 1.0)
    return weight * same / whole, np.where(seen > 0, kinds / whole, 1.0)


def _missed(keys: np.ndarray, owner: np.ndarray, rows: int) -> list[pa.Array]:
    """Lists of the distinct keys of each owning row, and of how often they occur."""
    order = np.lexsort((keys, owner))
    owner, keys = owner[order], keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (keys[1:] != keys[:-1])
    place = np.flatnonzero(new)
    times = np.diff(np.append(place, len(keys))).astype(np.int32)
    bounds = pa.array(np.searchsorted(owner[place], np.arange(rows + 1)).astype(np.int32))
    return [pa.ListArray.from_arrays(bounds, pa.array(keys[place].view(np.int64))), pa.ListArray.from_arrays(bounds, pa.array(times))]


def text_scores(
    spark: SparkSession, docs: DataFrame, training: Column, text: str = "text", order: int = ORDER,
    max_nodes: int = MAX_NODES, broadcast_words: int = BROADCAST_WORDS, own_context: int = OWN_CONTEXT, own_weight: float = OWN_WEIGHT,
) -> DataFrame:
    """``docs`` without its text, with n_tokens, n_known, train_tokens, base_score and score of every whole text.

    Texts have A-Z lowered; a null text counts as empty. Both models learn from the rows that ``training`` holds for
    (null: not), counting all of them. score is the log10 probability of the bytes of the text and of its end under
    prediction by partial matching: contexts of up to ``order`` bytes, the longest known first, escaping to shorter
    ones in proportion to the number of different symbols seen (method C), symbols already ruled out being excluded. The
    model adapts to each text: what has followed the last ``own_context`` bytes in the text so far comes first, at
    ``own_weight`` a count, and the trie where that escapes; a weight of 0 gives the pretrained model alone.
    base_score adds log10((c + 1) / (N + V + 1)) over words and one end: c counts the token in the training texts, N
    all their tokens, V the different ones; n_known counts tokens with c > 0. Words are told apart by 64-bit hashes.
    The trie holds every context of the training texts. Counts of the ``broadcast_words`` most frequent words and log
    probabilities of the ``max_nodes`` most frequent n-grams are broadcast, all others joined. Rows stay as they are,
    repeated or not; columns named like the results are replaced; an empty table gives an empty result, and without
    training texts every byte has probability 1/256.
    """
    if not 1 <= order <= 6:
        raise ValueError("order must lie between 1 and 6")
    own_context = min(own_context, order)
    if not 1 <= own_context <= 4 or own_weight < 0:
        raise ValueError("own_context must lie between 1 and 4, own_weight must not be negative")
    learns = F.coalesce(training, F.lit(False))
    body, use = F.col(f"`{text}`").alias("text"), learns.alias("learned")
    counts = saved(spark, _counts(docs.select(body, use), order), "counts")
    grams = saved(spark, _gram_logs(spark, counts.filter("kind = 0").drop("kind"), order), "grams")
    words = counts.filter("kind = 1").select("key", "n")
    texts = docs.filter(learns).count()
    totals = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_train, kinds = totals["n"] + texts, totals["v"] + (texts > 0)
    often, often_gram = _often(words, "n", broadcast_words), _often(grams, "times", max_nodes)
    frequent = words.filter(F.col("n") >= often).toArrow()
    keys, counted = frequent.column("key").to_numpy().view(U64), frequent.column("n").to_numpy()
    sort = np.argsort(keys)
    logs = np.log10(counted[sort] + 1.0)
    frequent = grams.filter(F.col("times") >= often_gram).select("key", "log").toArrow()
    nodes, node_logs = PackedKeys(frequent.column("key").to_numpy().view(U64)), np.append(frequent.column("log").to_numpy(), 0.0)
    held = spark.sparkContext.broadcast((nodes, node_logs, SortedHashes(keys[sort]), np.append(logs, 0.0)))
    del frequent, nodes, node_logs
    end_log = float(np.log10(texts + 1.0))

    kept = [c for c in docs.columns if c != text and c.lower() not in RESULTS]
    row, body = fresh_name(docs, "row_number"), fresh_name(docs, "body")
    added = [(row, T.LongType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base", T.DoubleType()), ("score", T.DoubleType()),
             ("rare", T.ArrayType(T.LongType(), False)), ("times", T.ArrayType(T.IntegerType(), False)),
             ("rare_grams", T.ArrayType(T.LongType(), False)), *[(name, T.ArrayType(T.DoubleType(), False)) for name in ("own", "other")]]
    names = [row, *[fresh_name(docs, name) for name, _ in added[1:]]]
    out = T.StructType([docs.schema[c] for c in kept])
    for name, (_, kind) in zip(names, added):
        out = out.add(name, kind)

    def scored(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, node_logs, known, logs = held.value
        number = TaskContext.get().partitionId() << 33
        for part in parts:
            data, offsets = text_buffers(part.column(body))
            for first, last in row_chunks(offsets, SCORED_BYTES):
                rows = last - first
                low, here = LOWER[data[offsets[first] : offsets[last]]], offsets[first : last + 1] - offsets[first]
                packed, edges = byte_stream(low, here, order)
                at = nodes.find(packed)
                own, other = own_shares(packed, edges, own_context, own_weight)
                logs_here = np.log10(own + other * np.exp(node_logs[at]))
                rest = np.flatnonzero(at < 0)
                logs_here[rest] = 0.0
                score = row_sums(logs_here[:, None], edges)[:, 0]
                bounds = pa.array(np.searchsorted(rest, edges).astype(np.int32))
                rare_grams = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (packed[rest].view(np.int64), own[rest], other[rest])]
                starts, ends, heads = word_spans(low, here, BLANKS)
                hashes = span_hashes(low, starts, ends)
                at = known.find(hashes)
                found = row_sums(np.column_stack([logs[at], at >= 0]), heads)
                rare = _missed(hashes[at < 0], np.repeat(np.arange(rows), np.diff(heads))[at < 0], rows)
                results = [
                    pa.array(number + np.arange(rows)), pa.array(np.diff(heads) + 1), pa.array(found[:, 1].astype(np.int64)),
                    pa.array(found[:, 0]), pa.array(score), *rare, *rare_grams,
                ]
                number += rows
                given = [part.column(c).slice(first, rows) for c in kept]
                yield pa.RecordBatch.from_arrays([*given, *results], names=[*kept, *names])

    scores = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias(body)).mapInArrow(scored, out)
    scores = saved(spark, scores, "scores")
    tokens, n_known, base, score, *lists = names[1:]

    def met(keys: str, *more: str) -> DataFrame:
        found = scores.filter(F.size(keys) > 0).select(F.col(row).alias("r"), F.explode(F.arrays_zip(keys, *more)).alias("w"))
        return found.select("r", F.col("w").getField(keys).alias("k"), *[F.col("w").getField(m).alias(f"m{i}") for i, m in enumerate(more)])

    no, none = F.lit(None).cast("double"), F.lit(None).cast("int")
    values = words.filter(F.col("n") < often).select(F.lit(WORDS).alias("kind"), "key", F.log10(F.col("n") + 1).alias("value"))
    values = values.unionByName(grams.filter(F.col("times") < often_gram).select(F.lit(GRAMS).alias("kind"), "key", F.exp("log").alias("value")))
    missed = met(*lists[:2]).select("r", F.lit(WORDS).alias("of"), "k", F.col("m0").alias("times"), no.alias("own"), no.alias("other"))
    missed = missed.unionByName(
        met(*lists[2:]).select("r", F.lit(GRAMS).alias("of"), "k", none.alias("times"), F.col("m0").alias("own"), F.col("m1").alias("other"))
    )
    missed = missed.join(values, (F.col("k") == F.col("key")) & (F.col("of") == F.col("kind")))
    word = F.col("kind") == WORDS
    joined = missed.groupBy("r").agg(
        F.sum(F.when(word, F.col("times"))).alias("more"), F.sum(F.when(word, F.col("times") * F.col("value"))).alias("logs"),
        F.sum(F.when(~word, F.log10(F.col("own") + F.col("other") * F.col("value")))).alias("gram_logs"),
    )
    whole = scores.join(joined, F.col(row) == F.col("r"), "left")
    denominator = float(np.log10(n_train + kinds + 1.0))
    total = F.col(base) + F.coalesce("logs", F.lit(0.0)) + F.lit(end_log) - F.col(tokens) * F.lit(denominator)
    return whole.select(
        *[F.col(f"`{c}`") for c in kept], F.col(tokens).alias("n_tokens"),
        (F.col(n_known) + F.coalesce("more", F.lit(0)) + F.lit(int(texts > 0))).cast("long").alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"), total.alias("base_score"), (F.col(score) + F.coalesce("gram_logs", F.lit(0.0))).alias("score"),
    )
