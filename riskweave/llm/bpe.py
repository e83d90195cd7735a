"""Byte-pair encoding in batched numpy merge rounds, and decoding, with a public vocabulary file."""

from __future__ import annotations

import functools
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from riskweave.llm.flat import row_chunks, text_buffers
from riskweave.llm.scratch import fresh_name

NONE = np.iinfo(np.int32).max
#: Pieces whose ids a worker remembers between batches; beyond it the memory starts anew.
REMEMBERED_PIECES = 400_000

# fixed values: the stages of the vocabulary files that this encoder follows
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable Latin-1, else the next from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


@functools.lru_cache(maxsize=1)
def _unassigned() -> np.ndarray:
    """Marks the code points that are unassigned in the Unicode version of ``unicodedata``."""
    return np.array([unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)])


class WordBpe:
    """Encoder of a tokenizer file with word ends: special tokens, normalisation, word pattern, merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, split = spec["model"], (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        followed = (
            spec["normalizer"] == {"type": "Sequence", "normalizers": NORMALIZER}
            and len(split) == 2 and split[0]["type"] == "Split" and split[0]["behavior"] == "Removed"
            and split[0]["invert"] and split[1] == BYTE_LEVEL and model["type"] == "BPE"
            and spec["decoder"] is None and spec["post_processor"] is None
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
            and not any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        )
        if not followed:
            raise ValueError(f"{path}: stages that this encoder does not follow")
        suffix = model["end_of_word_suffix"] or ""
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.tokens = np.full(size, "", object)
        for text, number in [*vocab.items(), *self.special.items()]:
            self.tokens[number] = text
        symbols = _byte_symbols()
        self.inner = np.array([vocab[c] for c in symbols], np.int32)
        self.final = np.array([vocab[c + suffix] for c in symbols], np.int32)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        pairs = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        ranks = np.argsort(pairs, kind="stable")
        self.pairs, self.ranks = pairs[ranks], ranks.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.words = regex.compile(split[0]["pattern"]["Regex"] + "|\n")
        self.blank = regex.compile(r"\s+")
        self.parts = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.known: dict[str, bytes] = {}
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        return np.where(self.pairs[at] == wanted, self.ranks[at], NONE).astype(np.int32)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one flat array, and the words' offsets in it.

        Each round merges, in every word at once, the occurrences of its pair of the lowest rank, left ones first.
        """
        lengths = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        last = np.zeros(len(raw), bool)
        last[np.cumsum(lengths) - 1] = True
        symbols = np.where(last, self.final[raw], self.inner[raw])
        word = np.repeat(np.arange(len(words)), lengths)
        rank = np.full(len(raw), NONE, np.int32)
        inside = np.flatnonzero(~last)
        rank[inside] = self._rank(symbols[inside], symbols[inside + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            starts = np.flatnonzero(np.concatenate([[True], last[:-1]]))
            best = np.minimum.reduceat(rank, starts)
            best = np.repeat(best, np.diff(np.append(starts, len(symbols))))
            live = best < NONE
            if not live.all():
                done.append((word[~live], symbols[~live]))
                symbols, word, rank, last, best = symbols[live], word[live], rank[live], last[live], best[live]
                if not len(symbols):
                    break
            hit = rank == best
            joined = hit[1:] & hit[:-1]
            if joined.any():  # in a run of one symbol every other pair merges
                at = np.flatnonzero(hit)
                first = np.concatenate([[True], np.diff(at) > 1])
                run = at[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
                hit[at[(at - run) % 2 == 1]] = False
            at = np.flatnonzero(hit)
            symbols[at] = self.merged[rank[at]]
            last[at] = last[at + 1]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, word, rank, last = symbols[keep], word[keep], rank[keep], last[keep]
            at = at - np.arange(len(at))
            changed = np.zeros(len(symbols), bool)
            changed[at] = True
            changed[at[at > 0] - 1] = True
            touched = np.flatnonzero(changed)
            rank[touched] = NONE
            touched = touched[~last[touched]]
            rank[touched] = self._rank(symbols[touched], symbols[touched + 1])
        if not done:
            return np.zeros(0, np.int32), np.zeros(len(words) + 1, np.int64)
        word, symbols = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(word, kind="stable")
        return symbols[order], np.searchsorted(word[order], np.arange(len(words) + 1))

    def pieces(self, text: str) -> list[str]:
        """The text cut at white space and around special tokens, neither of which a word runs across."""
        if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
            cut = self.blank.split  # str.split takes these for white space
        else:
            cut = str.split
        if self.parts is None or not self.parts.search(text):
            return cut(text)
        found, at = [], 0
        for m in self.parts.finditer(text):
            found += [*cut(text[at : m.start()]), m.group()]
            at = m.end()
        return found + cut(text[at:])

    def words_of(self, pieces: list[str]) -> tuple[list[str], np.ndarray]:
        """Normalised words of pieces without white space, and the first word of each piece (pieces + 1)."""
        joined = "\n".join([*pieces, ""])
        if not joined.isascii() and _unassigned()[np.frombuffer(joined.encode("utf-32-le"), np.uint32)].any():
            # of code points newer than unicodedata the library's own tables decide
            lists = []
            for piece in map(self.normalizer.normalize_str, pieces):
                lists.append([piece[a:b] for _, (a, b) in self.pre_tokenizer.pre_tokenize_str(piece)])
            return [word for words in lists for word in words], np.concatenate([[0], np.cumsum([len(x) for x in lists])])
        joined = unicodedata.normalize("NFC", joined).replace("Σ", "σ").lower()  # capital sigma has one lower form here
        found = self.words.findall(joined)
        breaks = np.array([i for i, word in enumerate(found) if word == "\n"], np.int64)
        return [word for word in found if word != "\n"], np.concatenate([[0], breaks - np.arange(len(breaks))])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. Pieces met before are looked up, the words of all others merge in one batch."""
        split = [self.pieces(text) for text in texts]
        if len(self.known) > REMEMBERED_PIECES:
            self.known = {}
        known = self.known
        for name, number in self.special.items():
            known[name] = np.array([number], np.int32).tobytes()
        new = list(set().union(*split).difference(known))
        words, heads = self.words_of(new)
        ids, offsets = self.encode_words([word.encode() for word in words])
        edges = offsets[heads] * 4
        raw = ids.tobytes()
        known.update((piece, raw[a:b]) for piece, a, b in zip(new, edges.tolist(), edges[1:].tolist()))
        return [np.frombuffer(b"".join([known[piece] for piece in pieces]), np.int32) for pieces in split]

    def decode(self, ids: np.ndarray) -> str:
        """The tokens joined by one space, as the file names no decoder; unknown ids are left out."""
        ids = ids[(ids >= 0) & (ids < len(self.tokens))]
        return " ".join([token for token in self.tokens[ids].tolist() if token])


@functools.lru_cache(maxsize=2)
def loaded(path: str) -> WordBpe:
    return WordBpe(path)


def with_token_ids(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` without its text, with the token ids of every whole text and the text decoded from them.

    ``path`` names the vocabulary file, which must lie at that place on every machine. Special tokens in a text become
    their ids, none are added, nothing is cut or filled up. Null and empty texts have no ids and decode to the empty
    text. Rows stay as they are, repeated or not; columns named like the results are replaced. An empty table gives an
    empty result. Work goes through bounded groups of rows; one very long text stands alone.
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


def decoded_ids(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
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


def token_digests(df: DataFrame) -> DataFrame:
    """Count and digests of ``ids`` and ``decoded`` in their place."""
    return df.withColumns({
        "n_tokens": F.size("ids").cast("long"),
        "ids_sha256": F.sha2(F.array_join("ids", " ").cast("binary"), 256),
        "decoded_sha256": F.sha2(F.col("decoded").cast("binary"), 256),
    }).drop("ids", "decoded")
