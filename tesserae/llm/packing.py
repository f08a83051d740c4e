"""Order-preserving packing into windows of bounded length, by dynamic programming over cut positions.

The token streams of a task's documents, in their stored order, are one line of tokens. Cuts may fall at the end of a
document (free), at the end of a sentence, or, inside a long sentence, every INNER_STEP tokens; the latter two cost a
truncation penalty, in tokens. A window is padded to the window length unless its length is a power of two. The least
cost of cutting at position j is

    penalty(j) + min( min over i in reach of cost(i) + position(i) + window - position(j),      # padded
                      cost(i) for position(j) - position(i) a power of two )                   # not padded

The first minimum slides over positions that only grow, so a monotone queue gives it in constant time on average; the
second takes the pairs of positions that stand a power of two apart, found for all positions at once. Nothing is shuffled, and a task works on a bounded run of tokens: when a run is
full it is cut up to a cheapest place near its end and what follows is carried on.

Defined cases: a null text counts as empty, so its document is the end id alone; repeated rows are separate
documents; rows with a null id are documents too; an empty table gives no pieces; other columns, whatever their names,
are ignored; a text of any length is one row and so one array of ids, cut like any other.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from bisect import bisect_left
from collections import deque
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import freed, short_batches, text_of, trim

WINDOW = 4096
SENTENCE_PENALTY = 8
INNER_PENALTY = 64
INNER_STEP = 64
TAIL_PENALTY = 8
RUN = 1 << 18
#: Words and marks held by a worker: those of the current generation and the one before it, up to so many each.
CACHE = 100_000
SLICE_CHARS = 4 << 20
JOINED = 512
MARKS = "!#$%&()*,-./:;=?@[]_{|}"
#: Stands between words that are encoded together: no other word has its byte, and it is a pre-token and a token alone.
BETWEEN = "\x01"
#: Latin letters that are their own normal form and have one small letter each.
_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-įĲ-ňŊ-ž]+")

_workers: dict[str, "WordIds"] = {}


class WordIds:
    """Words between spaces and their ids as little-endian 32-bit bytes.

    The tokenizer drops white space and neither normalises nor merges across it, so a text's ids are its words' ids. A
    word is encoded whole, but for marks behind an ASCII letter or digit: no normal form joins the two, and the mark
    starts a pre-token of its own. A run of words is encoded at once with BETWEEN between them. Words of Latin letters
    alone are a pre-token each, so they go to the same merges without normaliser and patterns, which is twice as fast.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.between = self.tokenizer.encode(BETWEEN, add_special_tokens=False).ids
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends_sentence = np.zeros(1 << 17, dtype=bool)
        self.ends_sentence[[i for t, i in vocabulary.items() if t.endswith("</w>") and t[:-4] and not t[:-4].strip(".!?")]] = True
        self.ends_word = np.zeros(1 << 17, dtype=bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.bytes_of: dict[int, str] = {}
        self.merges = self._merges()

    def _merges(self) -> "Tokenizer | None":  # noqa: F821
        """The tokenizer without all that words of Latin letters don't need; None if it is of a kind that needs it."""
        from tokenizers import Tokenizer, pre_tokenizers

        made = json.loads(self.tokenizer.to_str())
        if made["model"]["type"] != "BPE" or made["model"].get("end_of_word_suffix") != "</w>":
            return None
        bare = Tokenizer.from_str(json.dumps(made | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None}))
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [c for c in map(chr, range(0x180)) if _LATIN.fullmatch(c)]
        self.bytes_of = {ord(c): level.pre_tokenize_str(c.lower())[0][0] for c in letters}
        proof = [*letters, *(c + "a" for c in letters), *("a" + c for c in letters), "".join(letters)]
        same = all(bare.encode(w.translate(self.bytes_of), add_special_tokens=False).ids == self.tokenizer.encode(w, add_special_tokens=False).ids for w in proof)
        return bare if same else None

    def _joined(self, words: list[str], by: str, cut: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], tokenizer: "Tokenizer") -> list[bytes]:  # noqa: F821
        out: list[bytes] = []
        for i in range(0, len(words), JOINED):
            ids = np.array(tokenizer.encode_batch_fast([by.join(words[i : i + JOINED])], add_special_tokens=False)[0].ids, dtype="<u4")
            raw = ids.tobytes()
            begins, ends = cut(ids)
            out += [raw[a:b] for a, b in zip((4 * begins).tolist(), (4 * ends).tolist(), strict=True)]
        return out

    def encoded(self, words: list[str]) -> dict[str, bytes]:
        def after_ends(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            return np.concatenate([[0], ends[:-1]]), ends

        def around_marks(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            marks = np.flatnonzero(ids == self.between[0])
            return np.concatenate([[0], marks + 1]), np.concatenate([marks, [len(ids)]])

        plain = [w for w in words if _LATIN.fullmatch(w)] if self.merges else []
        found = {}
        if plain:
            letters = [w.lower() if w.isascii() else w.translate(self.bytes_of) for w in plain]
            found = dict(zip(plain, self._joined(letters, " ", after_ends, self.merges), strict=True))
        rest = [w for w in words if w not in found]
        alone = [w for w in rest if BETWEEN in w] if len(self.between) == 1 else rest
        found |= {w: array("I", self.tokenizer.encode(w, add_special_tokens=False).ids).tobytes() for w in alone}
        rest = [w for w in rest if w not in found] if alone else rest
        found.update(zip(rest, self._joined(rest, f" {BETWEEN} ", around_marks, self.tokenizer), strict=True))
        return found

    def of_parts(self, parts: list[str], repeated: list[bool]) -> list[bytes]:
        """Ids of distinct parts of words. Parts that are learned are held if they are repeated, the others are rare."""
        recent, older = self.recent, self.older
        out = [recent.get(p) for p in parts]
        missing = []
        for i in [i for i, ids in enumerate(out) if ids is None]:
            if (ids := older.get(parts[i])) is not None:
                out[i] = recent[parts[i]] = ids
            else:
                missing.append(i)
        learned = self.encoded([p for i in missing if (p := parts[i])])
        for i in missing:
            out[i] = ids = learned.get(parts[i], b"")
            if repeated[i]:
                recent[parts[i]] = ids
        if len(recent) > CACHE:
            self.recent, self.older = {}, recent
        return out

    def of_words(self, words: pa.StringArray, counts: np.ndarray) -> pa.Array:
        """Ids of distinct words, which occur ``counts`` times. Words are cut before their marks, all of them at once."""
        core = pc.ascii_rtrim(words, MARKS)
        alone = pc.match_substring_regex(core, r"[0-9A-Za-z]\z")
        core = pc.if_else(alone, core, words)
        core = pc.if_else(pc.and_(alone, pc.string_is_ascii(core)), pc.ascii_lower(core), core)
        # The marks are the bytes between a core's end and its word's.
        begins = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        lengths = pc.binary_length(core).to_numpy()
        marks = np.diff(begins) - lengths
        ends = np.concatenate([[0], np.cumsum(marks)])
        at = np.repeat(begins[:-1] + lengths - ends[:-1], marks) + np.arange(ends[-1])
        data = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)[at]
        tail = pa.StringArray.from_buffers(len(words), pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes()))
        both = pa.concat_arrays([core, tail]).dictionary_encode()
        repeated = np.bincount(both.indices.to_numpy(), np.concatenate([counts, counts])) > 1
        ids = pa.array(self.of_parts(both.dictionary.to_numpy(zero_copy_only=False).tolist(), repeated.tolist()), pa.binary())
        return pc.binary_join_element_wise(ids.take(both.indices[: len(words)]), ids.take(both.indices[len(words) :]), pa.scalar(b"", pa.binary()))

    def streams(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text. Texts are taken in slices; the distinct words of a slice are looked up once."""
        lengths = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            before = lengths[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(lengths, before + SLICE_CHARS, side="right")))
            split = pc.split_pattern(pc.replace_substring(texts[at:to], "\n", " "), " ")
            words = split.flatten().dictionary_encode()
            ids = self.of_words(words.dictionary, np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary)))
            taken = ids.cast(pa.large_binary()).take(words.indices)
            data = taken.buffers()[2]
            if len(taken):
                ends = np.frombuffer(taken.buffers()[1], dtype=np.int64)[taken.offset : taken.offset + len(taken) + 1]
                for a, b in zip(*(ends[(offsets := np.asarray(split.offsets))[:-1] - offsets[0]].tolist(), ends[offsets[1:] - offsets[0]].tolist()), strict=True):
                    yield data[a:b].to_pybytes() if b > a else b""
            at = to


def best_cuts(positions: Sequence[int], penalties: Sequence[int], window: int = WINDOW, end: str = "padded") -> list[int]:
    """Indices into ``positions`` (ascending; neighbours at most ``window`` apart) of the cheapest cuts.

    end: "padded" cuts at the last position as at any other; "tail" lets the last window be cut into powers of two
    instead; "open" leaves what follows the cheapest cut of the last window's reach for later.
    """
    place = np.asarray(positions, dtype=np.int64)
    # Positions that stand a power of two before another one: (later, earlier), by the later one.
    later, earlier = [], []
    for k in range(window.bit_length()):
        at = np.searchsorted(place, place - (1 << k))
        hit = np.flatnonzero(place[at] == place - (1 << k))
        later.append(hit)
        earlier.append(at[hit])
    late = np.concatenate(later)
    order = np.argsort(late, kind="stable")
    first = np.searchsorted(late[order], np.arange(len(place) + 1)).tolist()
    exact = np.concatenate(earlier)[order].tolist()
    positions, penalties = place.tolist(), np.asarray(penalties).tolist()
    cost, back = [0.0], [0]
    queue: deque[tuple[float, int, int]] = deque([(float(positions[0]), positions[0], 0)])
    for j in range(1, len(positions)):
        p = positions[j]
        while queue[0][1] < p - window:
            queue.popleft()
        low, _, arg = queue[0]
        best = low + window - p
        for k in range(first[j], first[j + 1]):
            if cost[exact[k]] < best:
                arg = exact[k]
                best = cost[arg]
        best += penalties[j]
        cost.append(best)
        back.append(arg)
        key = best + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, p, j))
    cuts, j = [], len(positions) - 1
    reach = [i for i in range(bisect_left(positions, positions[-1] - window), j)]
    if end == "open" and reach and reach[0]:
        j = min(reach, key=lambda i: (cost[i], -i))
    elif end == "tail" and reach:
        tail = lambda i: cost[i] + min(window - (n := positions[-1] - positions[i]), TAIL_PENALTY * (n.bit_count() - 1))
        back[j] = min(reach, key=lambda i: (tail(i), -i))
    while j:
        cuts.append(j)
        j = back[j]
    return cuts[::-1]


def _tail(length: int, window: int) -> list[int]:
    """Lengths into which the last window is cut if powers of two are cheaper than padding."""
    parts = [1 << k for k in range(length.bit_length() - 1, -1, -1) if length >> k & 1]
    return parts if len(parts) > 1 and (len(parts) - 1) * TAIL_PENALTY < window - length else [length]


class Packer:
    """Takes documents in order; gives pieces (doc_id, start, length, crc, doc_tokens, sequence, offset)."""

    def __init__(self, ends_sentence: np.ndarray, window: int, first_sequence: int):
        self.ends, self.window, self.sequence = ends_sentence, window, first_sequence
        self.docs: list[tuple[object, int, np.ndarray]] = []  # doc_id, ids before these, these
        self.tokens = 0

    def add(self, doc_id: object, ids: np.ndarray) -> list[tuple]:
        self.docs.append((doc_id, 0, ids))
        self.tokens += len(ids)
        return self.cut(False) if self.tokens >= RUN else []

    def cut(self, last: bool) -> list[tuple]:
        if not self.tokens:
            return []
        line = np.concatenate([ids for _, _, ids in self.docs])
        ends = np.cumsum([len(ids) for _, _, ids in self.docs])
        inner = np.flatnonzero(self.ends[line]) + 1
        kind = np.full(len(line) + 1, -1, dtype=np.int64)
        kind[inner] = SENTENCE_PENALTY
        kind[ends] = 0
        kind[0] = 0
        places = np.flatnonzero(kind >= 0)
        step = min(INNER_STEP, self.window)
        for i in np.flatnonzero(np.diff(places) > step):  # a long sentence, or a text without any end of one
            kind[np.arange(places[i] + step, places[i + 1], step)] = INNER_PENALTY
        places = np.flatnonzero(kind >= 0)
        cuts = places[best_cuts(places, kind[places], self.window, "tail" if last else "open")].tolist()
        if last:
            begin = cuts[-2] if len(cuts) > 1 else 0
            lengths = _tail(cuts[-1] - begin, self.window)
            cuts[-1:] = (begin + np.cumsum(lengths)).tolist()
        return self._pieces(line, cuts, ends)

    def _pieces(self, line: np.ndarray, cuts: list[int], ends: np.ndarray) -> list[tuple]:
        out, d, begin = [], 0, 0
        starts = ends - np.array([len(ids) for _, _, ids in self.docs])
        totals = [before + len(ids) for _, before, ids in self.docs]
        for cut in cuts:
            at = begin
            while at < cut:
                to = min(cut, int(ends[d]))
                doc_id, before, _ = self.docs[d]
                out.append((doc_id, before + at - int(starts[d]), to - at, zlib.crc32(line[at:to].tobytes()), totals[d], self.sequence, at - begin))
                at = to
                if to == ends[d]:
                    d += 1
            self.sequence += 1
            begin = cut
        rest = self.docs[d:]
        if rest:
            doc_id, before, ids = rest[0]
            used = begin - int(starts[d])
            rest[0] = (doc_id, before + used, ids[used:])
        self.docs, self.tokens = rest, len(line) - begin
        return out


COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, window: int = WINDOW, text: str = "text") -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        worker = _workers.get(tokenizer_path)
        if worker is None:
            _workers[tokenizer_path] = worker = WordIds(tokenizer_path)
            trim()
        packer = Packer(worker.ends_sentence, window, TaskContext.get().partitionId() << 40)
        end, id_type = np.array([end_id], dtype="<u4").tobytes(), pa.int64()

        def rows(pieces: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*pieces, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], id_type)] + [pa.array(c, pa.int64()) for c in columns[1:]], list(COLUMNS))

        for batch in freed(batches):
            id_type, pieces = batch.schema.field("doc_id").type, []
            for doc_id, stream in zip(batch.column("doc_id").to_pylist(), worker.streams(batch.column("text")), strict=True):
                pieces += packer.add(doc_id, np.frombuffer(stream + end, dtype="<u4"))
            if pieces:
                yield rows(pieces)
        if pieces := packer.cut(True):
            yield rows(pieces)

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return docs.select("doc_id", text_of(text).alias("text")).mapInArrow(run, schema)
