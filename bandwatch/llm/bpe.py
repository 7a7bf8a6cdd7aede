"""Byte-pair encoding by last-token states in a trie of words, and decoding.

The encoding of a text ends in one token; what stands before that token is encoded as if
it stood alone. So the encodings of all prefixes of a word follow from one state per
prefix, its last token: among the tokens that end the prefix, it is the one that stands
next to the last token of the prefix before it without a merge across their border.
Distinct words go into a trie; a depth-first pass gives each new node its state, so a
prefix that words share is encoded once. A word's tokens are read back along its path.

Whether a merge crosses the border of tokens a and b is decided by their merge histories:
the right edge of a and the left edge of b change with the rank of the merges so far; a
merge of an edge pair happens if its rank comes before either edge is consumed (at equal
ranks, the leftmost merge comes first). Answers are remembered per pair.

Texts are cut at each border of a non-space and a white-space character, where the
pre-tokenizer never joins; the file's own pre-tokenizer splits these units into words, once
per distinct unit. Texts, units and words are whole. A worker remembers at most
``UNITS`` units of at most ``UNIT_BYTES`` bytes and a trie of ``NODES`` nodes; beyond
that it starts anew. Words over ``WORD_BYTES`` walk the same states on a path of their own.
Nothing is shuffled, and nothing is kept but caches, so a lost executor costs its tasks only.

Decoding joins the tokens' bytes by id, for whole columns of ids at once.

Nulls and odd rows: a null text is empty (no tokens; decodes to the empty text); null ids
and repeated rows are kept; an empty table gives no rows; other columns are ignored. A
special token's text becomes its id, as in the library. When decoding, a null list is empty,
null or unknown ids give no text, and bytes that are no UTF-8 become U+FFFD.
"""

from __future__ import annotations

import json
import re
import sys
import types
from array import array
from collections.abc import Callable, Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwatch.llm.common import byte_values, texts

UNITS, UNIT_BYTES, NODES, WORD_BYTES, PAIRS = 1 << 19, 64, 1 << 20, 256, 1 << 19
#: Texts encoded at a time, up to so many bytes.
STEP, STEP_BYTES = 512, 4 << 20


def byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves, the others as letters from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Merges:
    """The vocabulary, how each token came about, and which tokens may stand side by side."""

    def __init__(self, vocabulary: dict[str, int], merges: list):
        letters = byte_letters()
        self.id_of = {bytes(letters[c] for c in token): i for token, i in vocabulary.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}
        for rank, merge in enumerate(merges):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pair, whole = (vocabulary[left], vocabulary[right]), vocabulary[left + right]
            if whole in self.made or rank <= max(self.made.get(p, -1) for p in pair):
                raise ValueError(f"merge {rank} makes a token twice or comes before its parts")
            self.rank[pair], self.halves[whole], self.made[whole] = rank, pair, rank
        self._sound: dict[int, bool] = {}
        self.forget()
        #: All ends of tokens; those that are tokens with their ids, the others with -1.
        self.ends = {token[k:]: -1 for token in self.id_of for k in range(len(token))}
        self.ends.update((token, i) for token, i in self.id_of.items() if self.sound(i))

    def forget(self) -> None:
        self.known: dict[int, bool] = {}

    def _edge(self, token: int, side: int) -> list[tuple[int, int, float]]:
        """(token, rank that made it, rank that consumed it) along one side of its history."""
        out, until = [], float("inf")
        while True:
            made = self.made.get(token, -1)
            out.append((token, made, until))
            if made < 0:
                return out
            token, until = self.halves[token][side], made

    def apart(self, a: int, b: int) -> bool:
        """Whether the bytes of a and b, encoded together, give a and b."""
        left = self._edge(b, 0)
        found = self.known[a << 32 | b] = not any(
            (rank := self.rank.get((x, y))) is not None and rank < x_until and rank <= y_until and rank > max(x_made, y_made)
            for x, x_made, x_until in self._edge(a, 1)
            for y, y_made, y_until in left
            if x_made < y_until and y_made < x_until
        )
        return found

    def sound(self, token: int) -> bool:
        """Whether the token's own bytes are encoded as the token."""
        known = self._sound.get(token)
        if known is None:
            pair = self.halves.get(token)
            known = self._sound[token] = pair is None or (self.sound(pair[0]) and self.sound(pair[1]) and self._meets(*pair))
        return known

    def _meets(self, a: int, b: int) -> bool:
        """Whether no merge across the border of a and b comes before the one that joins them."""
        joins = self.rank[a, b]
        left = self._edge(b, 0)
        return not any(
            (x, y) != (a, b) and (rank := self.rank.get((x, y))) is not None and rank < x_until and rank <= y_until and rank < joins
            for x, _, x_until in self._edge(a, 1)
            for y, _, y_until in left
        )

    def last_token(self, word: bytes, end: int, before: Callable[[int], int]) -> int:
        """The last token of the first ``end`` bytes; ``before(n)`` is that of the first n."""
        ends, known = self.ends.get, self.known.get
        for begin in range(end - 1, -1, -1):
            token = ends(word[begin:end])
            if token is None:
                break
            if token >= 0:
                if not begin:
                    return token
                left = before(begin)
                apart = known(left << 32 | token)
                if apart or apart is None and self.apart(left, token):
                    return token
        raise ValueError("the vocabulary lacks a byte")


class Trie:
    """Words by their bytes; each node has the last token of its prefix."""

    def __init__(self, merges: Merges):
        self.merges, self.lengths = merges, {i: len(t) for t, i in merges.id_of.items()}
        self.kids: dict[int, int] = {}  # by node and byte
        self.state = array("i", [-1])

    def encode(self, words: list[bytes]) -> dict[bytes, list[int]]:
        """Tokens of each word. Words in order are a depth-first walk: a word starts where it leaves the path of the one before."""
        kids, state, last = self.kids, self.state, self.merges.last_token
        out, path, previous = {}, [0], b""
        for word in sorted(set(words)):
            shared = 0
            while shared < len(previous) and shared < len(word) and word[shared] == previous[shared]:
                shared += 1
            del path[shared + 1 :]
            for depth in range(shared, len(word)):
                edge = path[depth] << 8 | word[depth]
                node = kids.get(edge)
                if node is None:
                    node = kids[edge] = len(state)
                    state.append(last(word, depth + 1, lambda n: state[path[n]]))
                path.append(node)
            out[word] = self._tokens(len(word), lambda n: state[path[n]])
            previous = word
        return out

    def encode_long(self, word: bytes) -> list[int]:
        """The same states along one word that is not kept."""
        states = array("i", [-1])
        for end in range(1, len(word) + 1):
            states.append(self.merges.last_token(word, end, states.__getitem__))
        return self._tokens(len(word), states.__getitem__)

    def _tokens(self, end: int, last: Callable[[int], int]) -> list[int]:
        out = []
        while end:
            out.append(last(end))
            end -= self.lengths[out[-1]]
        return out[::-1]


class OfWorker:
    @classmethod
    def of_worker(cls, path: str):
        """The one of this Python worker, kept from task to task."""
        store = vars(sys.modules.setdefault("_bandwatch_bpe", types.ModuleType("_bandwatch_bpe")))
        if (key := f"{cls.__name__} {path}") not in store:
            store[key] = cls(path)
        return store[key]


class Encoder(OfWorker):
    """Token ids of texts, as little-endian uint32 bytes, equal to the library's for a byte-level vocabulary."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model["type"] != "BPE" or spec["normalizer"] or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("only plain byte-level BPE without a normalizer is encoded here")
        if spec["pre_tokenizer"] | {"trim_offsets": None} != {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True, "trim_offsets": None}:
            raise ValueError("only the byte-level pre-tokenizer is supported")
        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.bytes_of = {ord(c): b for c, b in byte_letters().items()}
        self.merges = Merges(model["vocab"], model["merges"])
        self.special = {}
        for token in spec["added_tokens"]:
            if token["single_word"] or token["lstrip"] or token["rstrip"]:
                raise ValueError("added tokens that take white space are not supported")
            self.special[token["content"].encode()] = np.array([token["id"]], "<u4").tobytes()
        self.spaced: dict[bytes, bytes] = {}
        self._special = re.compile(b"(" + b"|".join(sorted(map(re.escape, self.special), key=len, reverse=True)) + b")") if self.special else None
        self.forget()

        self.trie, self.spaced, self.known, self.older = Trie(self.merges), {}, {}, {}

    def forget(self) -> None:
        """What was used since the last time stays within reach; the trie and all else starts anew."""
        self.trie, self.spaced, self.known, self.older = Trie(self.merges), {}, {}, self.spaced
        if len(self.merges.known) > PAIRS:
            self.merges.forget()

    def _words(self, text: str) -> list[bytes]:
        return [w.translate(self.bytes_of).encode("latin-1") for w, _ in self.split(text)]

    def _split_plain(self, parts: list[str]) -> list[list[bytes]]:
        """Words of parts behind a space, without white space in them: split in one go, since words never cross such a space."""
        words = iter(self._words("".join([" " + p for p in parts])))
        out = []
        for part in parts:
            left, own = 1 + len(part.encode()), []
            while left:
                own.append(next(words))
                left -= len(own[-1])
            out.append(own)
        return out

    def _segments(self, texts: list[bytes]) -> list[bytes]:
        """Ids of texts without special tokens."""
        if len(self.spaced) + len(self.known) > UNITS or len(self.trie.state) > NODES:
            self.forget()
        spaced, known, older = self.spaced, self.known, self.older
        parts = [t.split(b" ") for t in texts]
        heads = [p.pop(0) for p in parts]
        missing = set(filterfalse(spaced.__contains__, set().union(*parts)))
        spaced.update((p, older[p]) for p in filter(older.__contains__, missing))
        units: dict[bytes, list[bytes]] = {}  # words of a part behind a space
        cut: dict[bytes, list[str]] = {}  # units of a part with white space in it
        plain, odd = [], set()
        for part in filterfalse(spaced.__contains__, missing):
            if part.isalpha():  # ASCII letters behind a space are one word
                units[part] = [b" " + part]
            elif not (text := part.decode("utf-8", "replace")) or WHITE.match(text):
                odd.add(part)
            elif WHITE.search(text):
                cut[part] = SPACED.findall(" " + text)
            else:
                plain.append((part, text))
        units.update(zip([p for p, _ in plain], self._split_plain([t for _, t in plain])))
        # Texts that hold a part which is empty or starts with white space are cut as a whole.
        whole = {i: SPACED.findall(texts[i].decode("utf-8", "replace")) for i, p in enumerate(parts) if odd and not odd.isdisjoint(p)}
        first = {i: SPACED.findall(h.decode("utf-8", "replace")) for i, h in enumerate(heads) if i not in whole}
        others = {u: self._words(u) for u in filterfalse(known.__contains__, set().union(*cut.values(), *whole.values(), *first.values()))}

        words = set().union(*units.values(), *others.values())
        tokens = self.trie.encode([w for w in words if len(w) <= WORD_BYTES]) | {w: self.trie.encode_long(w) for w in words if len(w) > WORD_BYTES}
        ids = {w: array("I", t).tobytes() for w, t in tokens.items()}
        fresh = {u: b"".join([ids[w] for w in ws]) for u, ws in others.items()}
        get = lambda us: b"".join([fresh[u] if u in fresh else known[u] for u in us])
        here = {p: ids[ws[0]] if len(ws) == 1 else b"".join([ids[w] for w in ws]) for p, ws in units.items()} | {p: get(us) for p, us in cut.items()}
        spaced.update(here)
        of = spaced.__getitem__
        out = [get(whole[i]) if i in whole else get(first[i]) + b"".join(map(of, p)) for i, p in enumerate(parts)]
        for part in here:
            if part in cut or len(part) > UNIT_BYTES:
                del spaced[part]
        known.update((u, ids) for u, ids in fresh.items() if len(u) <= UNIT_BYTES)
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if not self._special or not any(s in t for t in texts for s in self.special):
            return self._segments(texts)
        split = [self._special.split(t) for t in texts]
        ids = iter(self._segments([s for parts in split for s in parts[::2]]))
        return [b"".join([next(ids) if k % 2 == 0 else self.special[s] for k, s in enumerate(parts)]) for parts in split]


#: White space of the pre-tokenizer's pattern (fixed values): Unicode's White_Space.
SPACES = "\t-\r \x85\xa0  -     　"
WHITE, SPACED = re.compile(f"[{SPACES}]"), re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")


class Decoder(OfWorker):
    """The bytes of ids, joined for many rows at once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        tokens = {i: bytes(letters[c] for c in t) for t, i in spec["model"]["vocab"].items()}
        tokens |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        self.size = max(tokens) + 1
        listed = [tokens.get(i, b"") for i in range(self.size + 1)]  # the last stands for unknown ids
        self.lengths = np.array([len(t) for t in listed])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(listed), np.uint8)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The bytes of each row; row k has the ids up to place ``ends[k]``."""
        ids = np.where((ids < 0) | (ids >= self.size), self.size, ids)
        n = self.lengths[ids]
        begin = np.cumsum(n) - n
        joined = self.bytes[np.arange(int(n.sum())) + np.repeat(self.starts[ids] - begin, n)].tobytes()
        cuts = np.append(0, np.append(begin, len(joined))[ends]).tolist()
        return [joined[a:b] for a, b in zip(cuts, cuts[1:])]


def encoded(values: list[bytes], encoder: Encoder) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, ids, end of each row's ids), some rows at a time."""
    begin = 0
    while begin < len(values):
        end, size = begin, 0
        while end < len(values) and end - begin < STEP and (end == begin or size + len(values[end]) <= STEP_BYTES):
            size += len(values[end])
            end += 1
        ids = encoder.encode(values[begin:end])
        yield begin, np.frombuffer(b"".join(ids), "<i4"), np.cumsum([len(i) // 4 for i in ids])
        begin = end


def ids_column(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids))


def text_column(found: list[bytes]) -> pa.Array:
    return pa.array([t.decode("utf-8", "replace") for t in found], pa.string())


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of each whole text."""

    def run(batches):
        encoder = Encoder.of_worker(vocabulary)
        for batch in batches:
            for begin, ids, ends in encoded(list(byte_values(batch.column(1))), encoder):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(ends)), ids_column(ids, ends)], names=["doc_id", "ids"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, text): the ids of each whole text and what they decode to, in one pass; as ``decode`` of ``encode``."""

    def run(batches):
        encoder, decoder = Encoder.of_worker(vocabulary), Decoder.of_worker(vocabulary)
        for batch in batches:
            for begin, ids, ends in encoded(list(byte_values(batch.column(1))), encoder):
                columns = [batch.column(0).slice(begin, len(ends)), ids_column(ids, ends), text_column(decoder.decode(ids, ends))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "text"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, text string")


def decode(encoded: DataFrame, vocabulary: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``encoded`` with a column ``text_col`` of the texts that its ids stand for."""
    at, kept = encoded.columns.index(ids_col), encoded.columns
    schema = encoded.withColumn(text_col, F.lit("")).schema

    def run(batches):
        decoder = Decoder.of_worker(vocabulary)
        for batch in batches:
            for begin in range(0, batch.num_rows, STEP):
                part = batch.slice(begin, STEP)
                column = part.column(at)
                ids = column.flatten().cast(pa.int64()).fill_null(-1).to_numpy()
                ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy())
                columns = {n: part.column(i) for i, n in enumerate(kept)} | {text_col: text_column(decoder.decode(ids, ends))}
                yield pa.RecordBatch.from_arrays([columns[f.name] for f in schema], names=[f.name for f in schema])

    return encoded.mapInArrow(run, schema)
