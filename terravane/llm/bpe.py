"""Byte-level BPE as a lazily determinised finite-state transducer, and its streaming decoder.

Encoding. A sequence of tokens is the encoding of its bytes exactly if every
two neighbours are: the merges, applied to the bytes of the two, give them
back. So the transducer walks hypotheses, places where a token may have begun,
and at each byte closes the one token that ends there and may follow the token
closed where it begins. The hypotheses that are alive after a byte are the ends
of what was read that can still grow into a token; the longest of them names
them all, so it is the state of the determinised automaton. Transitions and
verdicts on neighbours are made when first met and kept in tables of bounded
size. A token is emitted as soon as the paths of all live hypotheses have it,
so what is held back is never more than the longest token and what it hides.

Texts are cut by the pattern first; each match is encoded by itself. Different
matches are far fewer than matches: a bounded cache numbers them, and those of
a batch that are new walk through the transducer in lock-step, a byte of each
at a time.

Decoding. Token bytes pass through an incremental UTF-8 machine that gives out
whole code points as soon as their last byte has come and turns bytes that can
start none into the replacement character.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from terravane.llm.common import limit_batches, tidied

#: The most kept transitions or verdicts, and the most cached matches, of one worker.
MAX_KNOWN, MAX_PIECES = 1_000_000, 200_000
#: Matches of a text that are in hand at a time; and new matches that walk in lock-step, with their longest length in bytes.
STRETCH, STEP, STEP_BYTES = 200_000, 16_384, 63
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def load_ranks(lines: Iterable[bytes]) -> dict[bytes, int]:
    """Token bytes to rank from lines of base64 and number."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class Known:
    """Open-addressing map from whole keys to small numbers, read and filled in whole arrays."""

    def __init__(self, bits: int = 16) -> None:
        self._bits, self.size = bits, 0
        self._keys, self._values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _SPREAD) >> np.uint64(64 - self._bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The keys' numbers; -1 for unknown ones."""
        at, mask = self._place(keys), (1 << self._bits) - 1
        held = self._keys[at]
        wrong = np.flatnonzero((held != keys) & (held != -1))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & mask
            held[wrong] = self._keys[at[wrong]]
            wrong = wrong[(held[wrong] != keys[wrong]) & (held[wrong] != -1)]
        return np.where(held == keys, self._values[at], -1)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add different keys that are not known yet."""
        if 2 * (self.size + len(keys)) > len(self._keys):
            old = np.flatnonzero(self._keys != -1)
            old_keys, old_values = self._keys[old], self._values[old]
            self.__init__(max(self._bits + 1, int(4 * (len(old) + len(keys))).bit_length()))
            self.put(old_keys, old_values)
        at, left, mask = self._place(keys), np.arange(len(keys)), (1 << self._bits) - 1
        while len(left):
            p = at[left]
            free = self._keys[p] == -1
            self._keys[p[free]] = keys[left[free]]
            won = self._keys[p] == keys[left]
            self._values[p[won]] = values[left[won]]
            left = left[~won]
            at[left] = (at[left] + 1) & mask
        self.size += len(keys)


class Transducer:
    """Encodes byte strings to ranks; built from the ranks alone."""

    def __init__(self, ranks: dict[bytes, int], max_known: int = MAX_KNOWN) -> None:
        self.ranks = ranks
        self.bytes = {i: t for t, i in ranks.items()}
        self.max_known = max_known
        # the two parts that a token is last merged from, and whether the merges make it at all;
        # one that they cannot make is found only as a whole match
        self._parts: dict[int, tuple[int, int]] = {}
        made: set[int] = set()
        for t, i in ranks.items():
            parts = self._merge(t, 2)
            if len(parts) <= 2:
                made.add(i)
            if len(parts) == 2:
                self._parts[i] = (parts[0], parts[1])
        self._trie(made)
        self._forget()

    def _trie(self, made: set[int]) -> None:
        """The vocabulary's byte trie, with each node's longest proper end that is a node too."""
        child: dict[int, int] = {}  # node * 256 + byte to node
        came, depth, token = [(0, 0)], [0], [-1]
        home: dict[int, int] = {}
        for t, i in self.ranks.items():
            node = 0
            for b in t:
                to = child.get(node << 8 | b)
                if to is None:
                    to = child[node << 8 | b] = len(depth)
                    came.append((node, b))
                    depth.append(depth[node] + 1)
                    token.append(-1)
                node = to
            home[i] = node
            if i in made:
                token[node] = i
        inner = {key >> 8 for key in child}
        end, live, closes = [0] * len(depth), [0] * len(depth), [-1] * len(depth)
        self._child, self._end = child, end
        for node in np.argsort(depth, kind="stable").tolist()[1:]:
            parent, b = came[node]
            end[node] = self._onward(end[parent], b) if parent else 0
            live[node] = node if node in inner else live[end[node]]
            closes[node] = token[node] if token[node] >= 0 else closes[end[node]]
        most = max(self.bytes) + 1 if self.bytes else 0
        self._depth, self._live = np.array(depth), np.array(live)
        self._other = self._live[np.array(end)]  # the next shorter live hypothesis
        self._closes = np.array(closes, np.int64)  # the longest token that ends a node
        self._length, self._shorter = np.zeros(most, np.int64), np.full(most, -1, np.int64)
        for i, node in home.items():
            self._length[i], self._shorter[i] = len(self.bytes[i]), closes[end[node]]
        self._plain = (live, self._other.tolist(), depth, closes, self._length.tolist(), self._shorter.tolist())

    def _forget(self) -> None:
        self._moves, self._follows = Known(), Known()
        self._edges: dict[tuple[int, int], list] = {}
        self._seen: dict[int, bool] = {}

    def _merge(self, data: bytes, until: int = 1) -> list[int]:
        """The defining procedure, for short strings: join the neighbours of lowest rank until ``until`` parts are left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        none = len(self.ranks) + 1
        while len(parts) > until:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], none), i) for i in range(len(parts) - 1))
            if rank == none:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _edge(self, token: int, side: int) -> list[tuple[int, float, bytes]]:
        """Parts that stand at a token's edge while it is made: when each appears, when it is merged away, its bytes."""
        known = self._edges.get((token, side))
        if known is None:
            known, part, gone = [], token, float("inf")
            while True:
                parts = self._parts.get(part)
                known.append((part if parts else -1, gone, self.bytes[part]))
                if not parts:
                    break
                gone, part = part, parts[side]
            self._edges[token, side] = known
        return known

    def _may_follow(self, left: int, right: int) -> bool:
        """Whether no merge ever joins the two: none whose turn comes while both its sides stand at the border."""
        rank_of = self.ranks.get
        for born_x, gone_x, x in self._edge(left, 1):
            for born_y, gone_y, y in self._edge(right, 0):
                if born_x < gone_y and born_y < gone_x:
                    rank = rank_of(x + y)
                    # of equal ranks the leftmost merge is first
                    if rank is not None and rank < gone_x and rank <= gone_y:
                        return False
        return True

    def _onward(self, node: int, byte: int) -> int:
        """The state after a byte: the longest live hypothesis that the byte lets grow, or a new one."""
        to = self._child.get(node << 8 | byte)
        while to is None and node:
            node = self._end[node]
            to = self._child.get(node << 8 | byte)
        return to or 0

    def _asked(self, known: Known, keys: np.ndarray, make) -> np.ndarray:
        """The keys' numbers, made and kept where they are new."""
        found = known.get(keys)
        new = np.flatnonzero(found < 0)
        if len(new):
            different, back = np.unique(keys[new], return_inverse=True)
            made = np.array([make(k) for k in different.tolist()], np.int32)
            known.put(different, made)
            found[new] = made[back]
        return found

    def _step(self, data: np.ndarray, offsets: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks (a column for each match) and their numbers, of matches sorted from long to short, in lock-step."""
        n, longest = len(length), int(length[0])
        node, every = np.zeros(n, np.int64), np.arange(n)
        closed = np.full((longest + 1, n), -1, np.int64)  # the token closed at each place
        path = np.zeros((longest + 1, n), np.uint64)  # the places where the tokens up to each place end
        path[0] = 1
        done = np.ones(n, np.uint64)
        out, count = np.zeros((longest, n), np.int32), np.zeros(n, np.int64)
        reach = np.searchsorted(-length, -np.arange(1, longest + 2), side="right")
        for i in range(longest):
            m, ending = int(reach[i]), int(reach[i + 1])
            node[:m] = self._asked(self._moves, node[:m] << 8 | data[offsets[:m] + i], lambda k: self._onward(k >> 8, k & 255))
            token = self._closes[node[:m]]
            open_ = every[:m]
            while len(open_):
                mine = token[open_]
                if (mine < 0).any():
                    raise ValueError("a byte is missing from the vocabulary")
                last = closed[i + 1 - self._length[mine], open_]
                asked = np.flatnonzero(last >= 0)
                fits = self._asked(self._follows, last[asked] << 32 | mine[asked], lambda k: self._may_follow(k >> 32, k & 0xFFFFFFFF))
                open_ = open_[asked[fits == 0]]
                token[open_] = self._shorter[token[open_]]
            closed[i + 1, :m] = token
            shared = path[i + 1 - self._length[token], every[:m]] | np.uint64(1 << (i + 1))
            path[i + 1, :m] = shared
            # where a match ends, only the token that closes there is alive
            live = self._live[node[:ending]]
            open_ = np.flatnonzero(live)
            while len(open_):
                shared[open_] &= path[i + 1 - self._depth[live[open_]], open_]
                live[open_] = self._other[live[open_]]
                open_ = open_[live[open_] > 0]
            final = shared & ~done[:m]
            done[:m] |= shared
            rows = np.flatnonzero(final)
            while len(rows):
                first = final[rows] & (~final[rows] + np.uint64(1))
                out[count[rows], rows] = closed[np.log2(first.astype(np.float64)).astype(np.int64), rows]
                count[rows] += 1
                final[rows] ^= first
                rows = rows[final[rows] > 0]
        return out, count

    def encode_all(self, matches: list[bytes]) -> list[np.ndarray]:
        """Ranks of each match of the pattern."""
        out = [np.array([r], np.int32) if (r := self.ranks.get(m)) is not None else None for m in matches]
        short = []
        for i, m in enumerate(matches):
            if out[i] is None:
                if len(m) <= STEP_BYTES:
                    short.append(i)
                else:
                    out[i] = np.fromiter(self.stream(m), np.int32)
        short.sort(key=lambda i: -len(matches[i]))
        for a in range(0, len(short), STEP):
            part = short[a : a + STEP]
            if self._moves.size > self.max_known or self._follows.size > self.max_known:
                self._forget()
            length = np.array([len(matches[i]) for i in part])
            if not length[0]:
                ranks, count = np.zeros((0, len(part)), np.int32), np.zeros(len(part), np.int64)
            else:
                ranks, count = self._step(np.frombuffer(b"".join([matches[i] for i in part]), np.uint8), np.cumsum(length) - length, length)
            for column, (i, k) in enumerate(zip(part, count.tolist(), strict=True)):
                out[i] = ranks[:k, column].copy()
        return out

    def encode(self, data: bytes) -> list[int]:
        """Ranks of one match of the pattern."""
        return self.encode_all([data])[0].tolist()

    def stream(self, data: Iterable[int]) -> Iterator[int]:
        """Ranks of one match that need not be at hand whole, each given out as soon as all live hypotheses have it."""
        live, other, depth, closes, length, shorter = self._plain
        closed, begin, at, given, base, node = [-1], [0], 0, 0, 0, 0  # the lists hold places from base on

        def path(to: int) -> list[int]:
            found = []
            while to > given:
                found.append(closed[to - base])
                to = begin[to - base]
            return found[::-1]

        for b in data:
            node, at = self._onward(node, b), at + 1
            token = closes[node]
            while token >= 0 and not self._fits(closed[at - length[token] - base], token):
                token = shorter[token]
            if token < 0:
                raise ValueError("a byte is missing from the vocabulary")
            closed.append(token)
            begin.append(at - length[token])
            places, hypothesis = {at}, live[node]
            while hypothesis:
                places.add(at - depth[hypothesis])
                hypothesis = other[hypothesis]
            while len(places) > 1:
                last = max(places)
                places.remove(last)
                places.add(begin[last - base])
            (common,) = places
            if common > given:
                yield from path(common)
                given = common
                if given - base > 4096:
                    del closed[: given - base], begin[: given - base]
                    base = given
        yield from path(at)

    def _fits(self, left: int, right: int) -> bool:
        if left < 0:
            return True
        found = self._seen.get(left << 32 | right)
        if found is None:
            if len(self._seen) > self.max_known:
                self._seen.clear()
            found = self._seen[left << 32 | right] = self._may_follow(left, right)
        return found


class Utf8:
    """Incremental UTF-8 machine: bytes come in any portions, whole code points go out."""

    def __init__(self) -> None:
        self._machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, data: bytes) -> str:
        return self._machine.decode(data)

    def end(self) -> str:
        return self._machine.decode(b"", True)


def decode_stream(ids: Iterable[int], token_bytes: dict[int, bytes]) -> Iterator[str]:
    """Text of the ids, piece by piece, each piece as soon as its code points are whole."""
    machine = Utf8()
    for i in ids:
        text = machine.feed(token_bytes[i])
        if text:
            yield text
    rest = machine.end()
    if rest:
        yield rest


class Codec:
    """Encodes and decodes whole texts; different matches are numbered and kept, up to a bound."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, max_pieces: int = MAX_PIECES) -> None:
        import regex

        self.transducer = Transducer(ranks)
        self._pattern = regex.compile(pattern)
        self._names = {i: str(i) for i in self.transducer.bytes}
        self._max = max_pieces
        self._clear()

    def _clear(self) -> None:
        self._number: dict[str, int] = {}
        self._ids, self._at = np.zeros(1024, np.int32), np.zeros(1, np.int64)

    def _learn(self, matches: set[str]) -> None:
        """Number the matches that are new and keep their ids."""
        new = [m for m in matches if m not in self._number]
        if len(self._number) + len(new) > self._max:
            self._clear()
            new = list(matches)
        if not new:
            return
        ids = self.transducer.encode_all([m.encode() for m in new])
        self._number.update(zip(new, range(len(self._number), len(self._number) + len(new)), strict=True))
        at = self._at[-1] + np.cumsum([len(x) for x in ids])
        if at[-1] > len(self._ids):
            self._ids = np.concatenate([self._ids, np.zeros(int(at[-1]), np.int32)])
        self._ids[self._at[-1] : at[-1]] = np.concatenate(ids)
        self._at = np.concatenate([self._at, at])

    def _coded(self, matches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All matches' ids, and where each match's begin."""
        self._learn(set(matches))
        number = np.fromiter(map(self._number.__getitem__, matches), np.int64, len(matches))
        begin = self._at[number]
        n = self._at[number + 1] - begin
        ends = np.cumsum(n)
        return self._ids[np.repeat(begin - (ends - n), n) + np.arange(ends[-1] if len(n) else 0)], np.concatenate([[0], ends])

    def _stretches(self, text: str) -> Iterator[list[str]]:
        if len(text) <= STRETCH:
            yield self._pattern.findall(text)
            return
        found = self._pattern.finditer(text)
        while matches := [m.group() for m in islice(found, STRETCH)]:
            yield matches

    def portions(self, texts: Iterable[str | None]) -> Iterator[tuple[int, list[int]]]:
        """(number of the text, ids) in order; a long text comes in several portions, an empty or null one in none."""
        rows, n, matches = [], [0], []
        for i, text in enumerate(texts):
            for found in self._stretches(text or ""):
                rows.append(i)
                n.append(n[-1] + len(found))
                matches += found
                if len(matches) >= STRETCH:
                    yield from self._portions(rows, n, matches)
                    rows, n, matches = [], [0], []
        yield from self._portions(rows, n, matches)

    def _portions(self, rows: list[int], n: list[int], matches: list[str]) -> Iterator[tuple[int, list[int]]]:
        ids, at = self._coded(matches)
        for row, a, b in zip(rows, at[n[:-1]].tolist(), at[n[1:]].tolist(), strict=True):
            if b > a:
                yield row, ids[a:b].tolist()

    def digests(self, texts: list[str | None]) -> Iterator[tuple[list[int], str, str]]:
        """Ids of each text, sha256 of the ids joined by commas, sha256 of the bytes decoded from the ids."""
        names, token_bytes, row = self._names, self.transducer.bytes, 0
        portions = self.portions(texts)
        ahead = next(portions, None)
        for row in range(len(texts)):
            ids, joined, decoded, machine = [], hashlib.sha256(), hashlib.sha256(), Utf8()
            while ahead is not None and ahead[0] == row:
                part = ahead[1]
                joined.update((("," if ids else "") + ",".join([names[i] for i in part])).encode())
                decoded.update(machine.feed(b"".join([token_bytes[i] for i in part])).encode())
                ids = ids + part if ids else part
                ahead = next(portions, None)
            decoded.update(machine.end().encode())
            yield ids, joined.hexdigest(), decoded.hexdigest()

    def encode(self, text: str | None) -> list[int]:
        return [i for _, part in self.portions([text]) for i in part]

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(decode_stream(ids, self.transducer.bytes))


_CODECS: dict[tuple[str, str], Codec] = {}


def _codec(name: str, pattern: str) -> Codec:
    """This worker's codec for a vocabulary file that Spark has sent along."""
    found = _CODECS.get((name, pattern))
    if found is None:
        with open(SparkFiles.get(name), "rb") as f:
            found = _CODECS[name, pattern] = Codec(load_ranks(f), pattern)
    return found


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
ENCODED = "doc_id long, ids array<int>"


def _send(docs: DataFrame, path: str) -> str:
    limit_batches(docs.sparkSession)
    docs.sparkSession.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids for each row of ``docs`` (doc_id, text); null and empty texts have no ids."""
    return digests(docs, path, pattern, with_ids=True).select("doc_id", "ids")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and text for each row of ``encoded`` (doc_id, ids); null ids give an empty text."""
    name = _send(encoded, path)

    @tidied
    def run(batches):
        codec = _codec(name, pattern)
        for batch in batches:
            texts = [codec.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): the contract's counts and digests, and the ids if asked for.

    A null text counts as empty: no ids, the digests of nothing. Repeated rows
    and null ids are returned as they come, equal texts with equal ids; other
    columns are ignored; an empty table gives an empty result. A document is
    encoded where it is read, whole, without a shuffle; of a very long text
    STRETCH matches are in hand at a time, besides the text and its ids.
    """
    name = _send(docs, path)

    @tidied
    def run(batches):
        codec = _codec(name, pattern)
        for batch in batches:
            ids, counts, joined, decoded = [], [], [], []
            for found, a, b in codec.digests(batch.column(1).to_pylist()):
                if with_ids:
                    ids.append(np.array(found, np.int32))
                counts.append(len(found))
                joined.append(a)
                decoded.append(b)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(joined, pa.string()), pa.array(decoded, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select("doc_id", "text").mapInArrow(run, DIGESTS + (", ids array<int>" if with_ids else ""))
