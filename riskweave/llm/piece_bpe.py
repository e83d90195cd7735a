"""Encoding and decoding with a public piece vocabulary of merge type, through a table of each prefix's last token.

A text's encoding grows with its prefixes: if no merge crosses the place before the last token, what stands before that
token is the encoding of the shorter prefix. So every prefix has one last token, the one that ends there and is compatible
with the last token of the prefix before it. The tokens that end at a place come from an automaton over the vocabulary,
compatibility is a test of two tokens alone, and the ids are read off the table from the end.
"""

from __future__ import annotations

import functools
import itertools
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.llm.flat import row_chunks, text_buffers
from riskweave.llm.scratch import fresh_name

#: Units a worker remembers between batches, and the longest of them; beyond it the memory starts anew.
REMEMBERED_UNITS, REMEMBERED_LENGTH = 600_000, 64
#: Results of compatibility tests a worker remembers; beyond it the memory starts anew.
REMEMBERED_PAIRS = 1_000_000

# fixed values: field numbers and kinds of the vocabulary file
PIECES, TRAINER, NORMALIZER = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
SPACE, REPLACEMENT = "▁", "�"


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of an encoded message: integers, or the bytes of anything else."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        if key & 7 not in (1, 2, 5):
            raise ValueError("not a vocabulary file")
        size = {1: 8, 5: 4}.get(key & 7) or number()
        yield key >> 3, raw[at : at + size]
        at += size


class PieceBpe:
    """Encoder and decoder of a merge-type vocabulary with byte fallback and without normalisation."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            parts = list(_fields(file.read()))
        pieces = [dict(_fields(value)) for number, value in parts if number == PIECES]
        trainer, normalizer = ({k: v for n, value in parts if n == wanted for k, v in _fields(value)} for wanted in (TRAINER, NORMALIZER))
        self.texts = [p[1].decode() for p in pieces]
        self.kinds = np.array([p.get(3, NORMAL) for p in pieces])
        normal = np.flatnonzero(self.kinds == NORMAL).tolist()
        followed = (
            trainer.get(3) == 2 and trainer.get(35) == 1 and trainer.get(24, 0) == 0
            and normalizer.get(2, b"") == b"" and normalizer.get(3, 1) == 1 and normalizer.get(4, 1) == 0 and normalizer.get(5, 1) == 1
            and np.isin(self.kinds, [NORMAL, UNKNOWN, CONTROL, BYTE]).all() and (self.kinds == BYTE).sum() == 256
        )
        if not followed:
            raise ValueError(f"{path}: a kind of vocabulary that this encoder does not follow")
        self.unknown_text = trainer.get(44, b" \xe2\x81\x87 ").decode()
        self.byte_ids = [0] * 256
        self.byte_of: dict[int, int] = {}
        for i in np.flatnonzero(self.kinds == BYTE).tolist():
            value = int(self.texts[i][1:-1], 16)
            self.byte_ids[value], self.byte_of[i] = i, value
        score = [np.frombuffer(pieces[i].get(2, b"\0\0\0\0"), "<f4")[0] for i in normal]
        # the merge with the best score goes first, the leftmost one among equals
        self.place = dict(zip((self.texts[i] for i in normal), np.unique(-np.array(score), return_inverse=True)[1].tolist()))
        self.ids = {self.texts[i]: i for i in normal}
        # characters that only longer pieces hold are tokens too until a merge takes them; they end up as bytes
        letters = set(itertools.chain.from_iterable(self.ids))
        self.tokens = list(self.ids) + sorted(letters - self.ids.keys())
        self.alphabet = letters
        self.automaton = ahocorasick.Automaton()
        for number, token in enumerate(self.tokens):
            self.automaton.add_word(token, (len(token), number))
        self.automaton.make_automaton()
        self.spines = [None] * len(self.tokens)
        self.found: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        # no merge joins two characters that no piece holds side by side: texts fall apart between them
        self.number = np.zeros(0x110000, np.int32)
        self.number[[ord(c) for c in sorted(letters)]] = np.arange(1, len(letters) + 1)
        self.joined = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        for token in self.ids:
            places = self.number[[ord(c) for c in token]]
            self.joined[places[:-1], places[1:]] = True
        self.surfaces = np.array([self._surface(i) for i in range(len(self.texts))], object)

    def _surface(self, number: int) -> str:
        kind = self.kinds[number]
        return {CONTROL: "", UNKNOWN: self.unknown_text, BYTE: ""}.get(kind) if kind != NORMAL else self.texts[number].replace(SPACE, " ")

    def _spine(self, token: str) -> tuple[bool, list[int], list[str], list[str]]:
        """How a token arises from its characters by itself: whether it does, the place of each merge in the order of
        merging, and the leftmost and the rightmost token before each merge and at the end."""
        parts, merges, left, right = list(token), [], [token[0]], [token[-1]]
        while len(parts) > 1:
            places = [self.place.get(a + b, -1) for a, b in itertools.pairwise(parts)]
            best = min((p for p in places if p >= 0), default=-1)
            if best < 0:
                return False, merges, left, right
            at = places.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            merges.append(best)
            left.append(parts[0])
            right.append(parts[-1])
        return True, merges, left, right

    def _events(self, number: int) -> tuple[bool, list[int], list[str], list[str]]:
        found = self.spines[number]
        if found is None:
            found = self.spines[number] = self._spine(self.tokens[number])
        return found

    def compatible(self, first: int, second: int) -> bool:
        """Whether two tokens side by side stay two: no merge across them comes before theirs have ended.

        Merges elsewhere never change the order of these, so the two tokens decide it alone.
        """
        arises, merges, _, right = self._events(first)
        other, others, left, _ = self._events(second)
        if not (arises and other):
            return False
        i = j = 0
        while True:
            across = self.place.get(right[i] + left[j], -1)
            mine = merges[i] if i < len(merges) else -1
            theirs = others[j] if j < len(others) else -1
            if mine >= 0 and (across < 0 or mine <= across) and (theirs < 0 or mine <= theirs):
                i += 1
            elif across >= 0 and (theirs < 0 or across <= theirs):
                return False
            elif theirs >= 0:
                j += 1
            else:
                return True

    def _covered(self, text: str) -> list[int]:
        """Tokens of a text of known characters, through the table of the last token of every prefix."""
        table, starts = [-1] * (len(text) + 1), [0] * (len(text) + 1)
        found, size = self.found, len(self.tokens)
        for end, (length, token) in self.automaton.iter(text):
            end += 1
            if table[end] >= 0:
                continue
            start = end - length
            if start == 0:
                fits = self._events(token)[0]
            else:
                pair = table[start] * size + token
                fits = found.get(pair)
                if fits is None:
                    fits = found[pair] = self.compatible(table[start], token)
            if fits:
                table[end], starts[end] = token, start
        tokens, at = [], len(text)
        while at > 0:
            tokens.append(table[at])
            at = starts[at]
        return tokens[::-1]

    def units(self, text: str) -> list[str]:
        """The text, with a space before it, cut wherever no piece reaches across."""
        text = SPACE + text.replace(" ", SPACE)
        places = self.number[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        cuts = (np.flatnonzero(~self.joined[places[:-1], places[1:]]) + 1).tolist()
        return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]

    def encode_unit(self, unit: str) -> list[int]:
        """Ids of one unit. A character that no piece holds can be in no token: it stands alone, as bytes."""
        ids: list[int] = []
        runs = [(True, unit)] if self.alphabet.issuperset(unit) else [
            (known, "".join(run)) for known, run in itertools.groupby(unit, self.alphabet.__contains__)]
        for known, run in runs:
            if not known:
                ids += [self.byte_ids[b] for b in run.encode()]
                continue
            for number in self._covered(run):
                token = self.tokens[number]
                ids += [self.ids[token]] if token in self.ids else [self.byte_ids[b] for b in token.encode()]
        return ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; units met before are looked up."""
        if len(self.found) > REMEMBERED_PAIRS:
            self.found.clear()
        if len(self.known) > REMEMBERED_UNITS:
            self.known = {}
        known, done = self.known, []
        for text in texts:
            units = self.units(text) if text else []
            for unit in set(units).difference(known):
                known[unit] = array("i", self.encode_unit(unit)).tobytes()
            done.append(np.frombuffer(b"".join([known[unit] for unit in units]), np.int32))
            for unit in [unit for unit in units if len(unit) > REMEMBERED_LENGTH]:
                known.pop(unit, None)
        return done

    def _bytes_text(self, values: list[int]) -> str:
        """Text of a run of byte tokens; every byte that is part of no character becomes a replacement mark."""
        raw, made, at = bytes(values), [], 0
        while at < len(raw):
            size = 1 if raw[at] < 0x80 else 2 if raw[at] < 0xE0 else 3 if raw[at] < 0xF0 else 4
            try:
                made.append(raw[at : at + size].decode())
                at += size
            except UnicodeDecodeError:
                made.append(REPLACEMENT)
                at += 1
        return "".join(made)

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids, without the space that encoding puts before it; unknown numbers are left out."""
        ids = np.asarray(ids, np.int64)
        ids = ids[(ids >= 0) & (ids < len(self.texts))]
        surfaces = self.surfaces[ids].tolist()
        spelled = np.flatnonzero(self.kinds[ids] == BYTE)
        if len(spelled):
            for run in np.split(spelled, np.flatnonzero(np.diff(spelled) > 1) + 1):
                surfaces[run[0]] = self._bytes_text([self.byte_of[i] for i in ids[run].tolist()])
        # the first token with a text loses its first space, unless that was an unknown token's or a byte's
        for at, surface in enumerate(surfaces):
            if surface:
                if self.kinds[ids[at]] == NORMAL and surface[0] == " ":
                    surfaces[at] = surface[1:]
                break
        return "".join(surfaces)


@functools.lru_cache(maxsize=2)
def loaded(path: str) -> PieceBpe:
    return PieceBpe(path)


def with_piece_ids(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` without its text, with the token ids of every whole text and the text decoded from them.

    ``path`` names the vocabulary file, which must lie at that place on every machine. No begin or end ids are added, and
    texts are not normalised, only a space is put before them. Characters without a piece become bytes. Null and empty
    texts have no ids and decode to the empty text. Rows stay as they are, repeated or not; columns named like the results
    are replaced; an empty table gives an empty result. Work goes through bounded groups of rows; one very long text
    stands alone, and its table has one entry a character.
    """
    kept = [c for c in docs.columns if c.lower() not in (text.lower(), ids.lower(), decoded.lower())]
    out = T.StructType([docs.schema[c] for c in kept])
    body = fresh_name(docs, "body")
    out = out.add(ids, T.ArrayType(T.IntegerType(), False), False).add(decoded, T.StringType(), False)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = loaded(path)
        for part in parts:
            data, offsets = text_buffers(part.column(body))
            for first, last in row_chunks(offsets):
                found = coder.encode([data[offsets[i] : offsets[i + 1]].tobytes().decode() for i in range(first, last)])
                edges = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(found)))
                texts = pa.array([coder.decode(x) for x in found], pa.string())
                rest = [part.column(c).slice(first, last - first) for c in kept]
                yield pa.RecordBatch.from_arrays([*rest, lists, texts], names=[*kept, ids, decoded])

    return docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias(body)).mapInArrow(batches, out)


def decoded_piece_ids(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the text that its column of token ids decodes to; null ids decode to the empty text."""
    kept = [c for c in df.columns if c.lower() != decoded.lower()]
    out = T.StructType([df.schema[c] for c in kept]).add(decoded, T.StringType(), False)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = loaded(path)
        for part in parts:
            lists = part.column(ids).to_pylist()
            texts = [coder.decode(np.array([i for i in x or [] if i is not None], np.int64)) for x in lists]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(texts, pa.string())], names=[*kept, decoded])

    return df.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(batches, out)


def piece_digests(df: DataFrame, ids: Column | None = None) -> DataFrame:
    """Count and digests of ``ids`` and ``decoded`` in their place."""
    ids = F.col("ids") if ids is None else ids
    return df.withColumns({
        "n_tokens": F.size(ids).cast("long"),
        "ids_sha256": F.sha2(F.array_join(ids, ",").cast("binary"), 256),
        "decoded_sha256": F.sha2(F.col("decoded").cast("binary"), 256),
    }).drop("ids", "decoded")
