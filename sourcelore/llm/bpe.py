"""Byte-level BPE: encoding with a contiguous rank array, and decoding."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourcelore.llm.common import column, packed, text_of

#: Words of up to this many bytes are scanned; longer ones use a heap, since scanning them is quadratic.
SHORT = 96
#: Words of one length that are scanned side by side.
ABREAST = 4096
#: Bytes, roughly, that the ids of short words which a task remembers may take.
MEMORY = 12 << 20
#: What a remembered word takes, and each of its ids.
A_WORD, AN_ID = 210, 4
#: Characters of text that are cut into words at a time (a longer text alone).
CHUNK = 1 << 19
#: Texts without a character from here on (Latin letters and their accents end here) are cut by the plain pattern.
WESTERN = 0x250
NONE, ID_BITS = 1 << 60, 24


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a vocabulary file."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    symbols = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in symbols:
            symbols[b] = chr(256 + len(symbols) - len(plain))
    return [symbols[b] for b in range(256)]


def _word_pattern(blank: str, letter: str, number: str) -> str:
    """Words as byte-level BPE cuts them, from the insides of three character classes."""
    return (
        rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{blank}{letter}{number}]+|[{blank}]+(?![^{blank}])|[{blank}]+"
    )


def _spelled_out(kind: str, below: int) -> str:
    """The characters below a code point that a Unicode class holds, as the inside of a character class."""
    return "".join(re.escape(c) for c in map(chr, range(below)) if regex.match(kind, c))


class _Bytes(dict):
    """Bytes of ids; an unknown id stands for nothing."""

    def __missing__(self, _: int) -> bytes:
        return b""


class ByteBPE:
    """A vocabulary of bytes and merges, with special tokens that are found in texts as they stand."""

    def __init__(self, described: str):
        parts = json.loads(described)
        vocabulary, symbols = parts["model"]["vocab"], byte_symbols()
        of_symbol = {s: b for b, s in enumerate(symbols)}
        self.byte_ids = np.array([vocabulary[s] for s in symbols], np.int64)
        ranks: dict[tuple[int, int], int] = {}
        made: list[int] = []
        for rank, pair in enumerate(parts["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            ranks[vocabulary[left], vocabulary[right]] = rank
            made.append(vocabulary[left + right])
        self.bytes_of = _Bytes({i: bytes(of_symbol[c] for c in piece) for piece, i in vocabulary.items()})
        self.special = {t["content"]: t["id"] for t in parts["added_tokens"]}
        self.bytes_of.update({i: t.encode() for t, i in self.special.items()})
        by_length = sorted(self.special, key=len, reverse=True)
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, by_length)) + ")") if by_length else None
        # White space by its Unicode property, which the letter classes beside it follow as well.
        classes = (r"\p{White_Space}", r"\p{L}", r"\p{N}")
        self.words = regex.compile(_word_pattern(*classes)).findall
        # The same for texts of western letters only, whose classes are short enough to spell out.
        self.western_words = re.compile(_word_pattern(*(_spelled_out(c, WESTERN) for c in classes))).findall
        self.other_letter = re.compile(rf"[^\0-{chr(WESTERN - 1)}]").search
        #: Ids of words as 32-bit integers side by side: a list of numbers takes several times that.
        self.known: dict[str, bytes] = {}
        self.held = 0
        #: The token that the merge of each rank makes.
        self.made_by = np.array(made, np.int64)
        pairs = np.array([left << ID_BITS | right for left, right in ranks], np.int64)
        order, places = pairs.argsort(), np.array(list(ranks.values()), np.int64)
        self.pairs, self.rank_of_pair = np.append(pairs[order], NONE), np.append(places[order], NONE)
        self.byte_ranks = self._ranks(self.byte_ids[:, None], self.byte_ids[None, :])

    @cached_property
    def ranks(self) -> dict[tuple[int, int], int]:
        """The merges one by one, for long words only: they take many times the room of the arrays."""
        pairs, ranks = self.pairs[:-1], self.rank_of_pair[:-1]
        return dict(zip(zip((pairs >> ID_BITS).tolist(), (pairs & (1 << ID_BITS) - 1).tolist(), strict=True), ranks.tolist(), strict=True))

    @cached_property
    def made(self) -> list[int]:
        return self.made_by.tolist()

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair of tokens, NONE where there is none."""
        wanted = left << ID_BITS | right
        at = self.pairs.searchsorted(wanted)
        return np.where(self.pairs[at] == wanted, self.rank_of_pair[at], NONE)

    def _scan(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of one length, a row each: their tokens and, beside them, the ranks of neighbours.

        Repeatedly each row is scanned for its smallest rank, that boundary is deleted and the ranks on both sides
        are refreshed. A row without a merge left is done; all others have lost one part each, so rows stay even.
        """
        given = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)
        ids, ranks = self.byte_ids[given], self.byte_ranks[given[:, :-1], given[:, 1:]]
        out = [b""] * len(words)
        rows = np.arange(len(words))
        while len(rows):
            parts = ids.shape[1]
            at = ranks.argmin(1) if parts > 1 else np.zeros(len(rows), np.int64)
            best = ranks[np.arange(len(rows)), at] if parts > 1 else np.full(len(rows), NONE)
            done = best == NONE
            final, width = ids[done].astype(np.int32).tobytes(), AN_ID * parts
            for i, row in enumerate(rows[done].tolist()):
                out[row] = final[i * width : (i + 1) * width]
            rows, ids, ranks, at, best = rows[~done], ids[~done], ranks[~done], at[~done], best[~done]
            if not len(rows):
                break
            each, places = np.arange(len(rows)), np.arange(parts - 1)
            ids[each, at] = self.made_by[best]
            ids = np.take_along_axis(ids, places + (places > at[:, None]), 1)
            ranks = np.take_along_axis(ranks, places[:-1] + (places[:-1] >= at[:, None]), 1)
            before, after = at > 0, at < parts - 2
            ranks[each[before], at[before] - 1] = self._ranks(ids[each[before], at[before] - 1], ids[each[before], at[before]])
            ranks[each[after], at[after]] = self._ranks(ids[each[after], at[after]], ids[each[after], at[after] + 1])
        return out

    def _long(self, ids: list[int]) -> list[int]:
        """The same merges with a heap of neighbours over a linked list."""
        count, rank_of = len(ids), self.ranks.get
        after, before = [*range(1, count), -1], [*range(-1, count - 1)]
        heap = [(rank, i, ids[i], ids[i + 1]) for i in range(count - 1) if (rank := rank_of((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue
            merged = self.made[rank]
            ids[i], ids[j] = merged, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (rank := rank_of((merged, ids[k]))) is not None:
                    heapq.heappush(heap, (rank, i, merged, ids[k]))
            h = before[i]
            if h >= 0 and (rank := rank_of((ids[h], merged))) is not None:
                heapq.heappush(heap, (rank, h, ids[h], merged))
        return [i for i in ids if i >= 0]

    def _learn(self, words: set[str]) -> list[str]:
        """Make the ids of all these words known; returns the long ones, which are not worth keeping."""
        if self.held >= MEMORY:
            self.known.clear()
            self.held = 0
        new = list(words - self.known.keys())
        raw = [word.encode() for word in new]
        of_length: dict[int, list[int]] = {}
        for i, word in enumerate(raw):
            of_length.setdefault(len(word), []).append(i)
        long = []
        for length, places in of_length.items():
            if length > SHORT:
                long += [new[i] for i in places]
                self.known.update((new[i], array("i", self._long([self.byte_ids.item(b) for b in raw[i]])).tobytes()) for i in places)
                continue
            for start in range(0, len(places), ABREAST):
                some = places[start : start + ABREAST]
                found = self._scan([raw[i] for i in some])
                self.known.update(zip([new[i] for i in some], found, strict=True))
                self.held += sum(map(len, found)) + A_WORD * len(found)
        return long

    def _pieces(self, text: str) -> list[int | list[str]]:
        """Ids of special tokens, and the words of what lies between them."""
        out: list[int | list[str]] = []
        for piece in self.special_split.split(text) if self.special_split else [text]:
            if piece in self.special:
                out.append(self.special[piece])
            elif piece:
                out.append((self.words if self.other_letter(piece) else self.western_words)(piece))
        return out

    def encode_some(self, texts: list[str]) -> list[array]:
        """Ids of each text; all words of the texts are in memory at once."""
        pieces = [self._pieces(text) for text in texts]
        long = self._learn(set().union(*[p for of_text in pieces for p in of_text if isinstance(p, list)]))
        out = []
        for of_text in pieces:
            ids = array("i")
            for piece in of_text:
                if isinstance(piece, int):
                    ids.append(piece)
                else:
                    ids.frombytes(b"".join(map(self.known.__getitem__, piece)))
            out.append(ids)
        for word in long:
            del self.known[word]
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_some([text])[0].tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """Bytes that are no UTF-8 become replacement characters; an unknown id stands for nothing."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def encode_all(self, texts: pa.Array) -> pa.Array:
        values, offsets = array("i"), [0]
        waiting: list[str] = []
        for text in [*texts.to_pylist(), None]:
            if waiting and (text is None or sum(map(len, waiting)) + len(text) > CHUNK):
                for ids in self.encode_some(waiting):
                    values += ids
                    offsets.append(len(values))
                waiting = []
            if text is not None:
                waiting.append(text)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(values, np.int32)))

    def decode_all(self, lists: pa.Array) -> pa.Array:
        values = lists.values.fill_null(-1).to_numpy()
        offsets = lists.offsets.to_pylist()
        spans = zip(offsets, offsets[1:], lists.is_valid().to_pylist(), strict=False)
        return pa.array([self.decode(values[a:b].tolist()) if valid else None for a, b, valid in spans], pa.string())


def _described(path: str | None) -> str:
    with open(path or default_vocabulary(), encoding="utf-8") as file:
        return file.read()


def _model(path: str | None) -> ByteBPE:
    """The vocabulary file is read once, by the driver; tasks get its arrays and never hold the file and what parsing it leaves."""
    return ByteBPE(_described(path))


def _with(rows: DataFrame, source, carried: list[str], added: str, kind: T.DataType, model: ByteBPE, method: str) -> DataFrame:
    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = getattr(model, method)
        for batch in batches:
            # A few rows at a time: ids take more room than their texts.
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                yield pa.RecordBatch.from_arrays([part.column("row"), step(part.column("given"))], names=["row", added])

    # Only what is carried along goes to the Python workers and back beside the column that is read.
    taken = rows.select(packed(rows.select(*map(column, carried))).alias("row"), source.alias("given"))
    schema = T.StructType([taken.schema["row"], T.StructField(added, kind)])
    return taken.mapInArrow(convert, schema)


def encoded(docs: DataFrame, text_name: str = "text", vocabulary: str | None = None, carried: list[str] | None = None) -> DataFrame:
    """Rows (the struct ``row`` of the ``carried`` columns, by default all but the text) with ``ids``, the tokens of the whole text.

    A null text counts as empty.
    """
    carried = [c for c in docs.columns if c != text_name] if carried is None else carried
    return _with(docs, text_of(text_name), carried, "ids", T.ArrayType(T.IntegerType()), _model(vocabulary), "encode_all")


def decoded(rows: DataFrame, ids_name: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """The rows (as struct ``row``) with ``decoded``, the text of their ids; null ids give null."""
    return _with(rows, column(ids_name), rows.columns, "decoded", T.StringType(), _model(vocabulary), "decode_all")


def round_trip(docs: DataFrame, text_name: str = "text", vocabulary: str | None = None, carried: list[str] | None = None) -> DataFrame:
    """Encoding and decoding in one pass: rows as ``encoded`` gives them, with ``n_tokens`` and digests of the ids and of their text.

    Only one copy of the vocabulary is held for each core, and neither ids nor texts go through Python twice.
    """
    carried = [c for c in docs.columns if c != text_name] if carried is None else carried
    model = _model(vocabulary)

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A worker that served other steps before still holds what their batches took.
        pa.default_memory_pool().release_unused()
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                lists = model.encode_all(part.column("given"))
                values, offsets = lists.values.to_numpy(), lists.offsets.to_pylist()
                sizes, digests, texts = [], [], []
                for a, b in zip(offsets, offsets[1:], strict=False):
                    ids = values[a:b].tolist()
                    sizes.append(b - a)
                    digests.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                    texts.append(hashlib.sha256(model.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), lists, pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())],
                    names=["row", "ids", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    taken = docs.select(packed(docs.select(*map(column, carried))).alias("row"), text_of(text_name).alias("given"))
    made = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())]
    made += [T.StructField(name, T.StringType()) for name in ("ids_sha256", "decoded_sha256")]
    return taken.mapInArrow(convert, T.StructType([taken.schema["row"], *made]))


def token_digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Per document: number of tokens and digests of the ids and of the text they decode to.

    Null texts count as empty (no tokens); repeated rows give repeated results; an empty table gives none.
    """
    named = docs.select(column("doc_id").alias("doc_id"), column("text").alias("text"))
    return round_trip(named, "text", vocabulary).select(F.col("row.doc_id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")
