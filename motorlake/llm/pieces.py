"""Encoding to and decoding from SentencePiece ids by a unigram Viterbi search.

The pieces and their log scores come from a model file; they stand in a double-array
trie over UTF-8 bytes. Spaces become the marker U+2581, with one more in front of a
text. Characters without a piece fall back to byte pieces.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from motorlake.llm.arrow import mapper, texts
from motorlake.llm.vocabulary import KeptRuns, gather

MARK = "▁"
#: An unknown character scores so much less than the worst piece.
UNKNOWN_PENALTY = 10.0
#: Words searched side by side, and the longest of them, in bytes; longer ones are searched by themselves.
TOGETHER = 1 << 13
TOGETHER_BYTES = 64
#: Bytes of text in a slice, and ids decoded at once: both bound a worker's memory.
SLICE = 2 << 20
DECODED = 1 << 17
#: A word starts with markers; a line feed is in no piece, so texts fall apart there too.
SEGMENT = re.compile(f"{MARK}+[^{MARK}\n]*|\n|[^{MARK}\n]+")


def model_file(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class DoubleArray:
    """A trie in two arrays: the child of node s by byte c is t = base[s] + c + 1 if check[t] == s."""

    def __init__(self, keys: list[bytes]) -> None:
        """keys: sorted and distinct; a key's value is its place in the list."""
        size = 1 << 16
        base, check, value = [0] * size, [-1] * size, [-1] * size
        check[0] = 0
        free_from = crowded_to = 257  # so that every byte finds a base of 0 or more

        def grow() -> None:
            for a, fill in ((base, 0), (check, -1), (value, -1)):
                a.extend([fill] * len(a))

        todo = [(0, 0, len(keys), 0)]  # node, range of keys below it, depth
        while todo:
            node, low, high, depth = todo.pop()
            if low < high and len(keys[low]) == depth:
                value[node] = low
                low += 1
            if low == high:
                continue
            children: list[tuple[int, int, int]] = []
            at = low
            while at < high:
                byte, start = keys[at][depth], at
                while at < high and keys[at][depth] == byte:
                    at += 1
                children.append((byte, start, at))
            while check[free_from] != -1:
                free_from += 1
                if free_from + 600 > len(base):
                    grow()
            # a lone child takes the first free cell; siblings are sought from where the search last got long
            start = free_from if len(children) == 1 else max(free_from, crowded_to)
            offset, tried = max(0, start - children[0][0] - 1), 0
            while any(check[offset + c + 1] != -1 for c, _, _ in children):
                offset += 1
                tried += 1
                if offset + 600 > len(base):
                    grow()
            if tried > 64:
                crowded_to = offset + children[0][0] + 1
            base[node] = offset
            for c, start, end in children:
                check[offset + c + 1] = node
                todo.append((offset + c + 1, start, end, depth + 1))
        used = max(i for i, x in enumerate(check) if x != -1) + 1
        self.base, self.check, self.value = (np.array(a[:used] + [fill] * 257, np.int32) for a, fill in ((base, 0), (check, -1), (value, -1)))


class Pieces:
    """A model's pieces, ready to be sent to the workers."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        ids = range(model.vocab_size())
        special = {i for i in ids if model.is_control(i) or model.is_unknown(i)}
        byte = [i for i in ids if model.is_byte(i)]
        normal = sorted((model.id_to_piece(i).encode(), i) for i in ids if i not in special and not model.is_byte(i) and not model.is_unused(i))
        if any("\n" in model.id_to_piece(i) or re.search(f"[^{MARK}]{MARK}", model.id_to_piece(i)) for i in ids):
            raise ValueError("a piece crosses the start of a word or a line")
        trie = DoubleArray([k for k, _ in normal])
        self.longest = max([4, *(len(k) for k, _ in normal)])  # in bytes; a single character has four at most
        self.base, self.check, self.value = trie.base, trie.check, trie.value
        self.ids = np.array([i for _, i in normal], np.int32)
        self.scores = np.array([model.get_score(i) for _, i in normal], np.float64)
        self.byte_ids = np.array(byte, np.int32)  # in order of the bytes
        self.unknown_id = model.unk_id()
        self.surface = [b"" if i in special else model.id_to_piece(i).replace(MARK, " ").encode() for i in ids]
        for value, i in enumerate(byte):
            self.surface[i] = bytes([value])


class Codec:
    """Encodes and decodes in a worker; the ids of frequent words are kept."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        self.base, self.check, self.value = pieces.base.tolist(), pieces.check.tolist(), pieces.value.tolist()
        self.ids, self.scores, self.byte_ids = pieces.ids.tolist(), pieces.scores.tolist(), pieces.byte_ids.tolist()
        self.unknown_id = pieces.unknown_id
        self.longest = pieces.longest
        self.unknown_score = min(self.scores, default=0.0) - UNKNOWN_PENALTY
        self.surface = np.frombuffer(b"".join(pieces.surface), np.uint8)
        self.surface_sizes = np.array([len(x) for x in pieces.surface], np.int64)
        self.surface_starts = np.cumsum(self.surface_sizes) - self.surface_sizes
        self.kept = KeptRuns(np.int32)

    def viterbi(self, word: str) -> np.ndarray:
        """The pieces of the best sum of scores; of equal ones, the last piece that starts first.

        Scores are kept in a ring as long as the longest piece, and of each place only the
        width and the number of the piece that ends there, so that a text without white
        space takes a few bytes for each of its own.
        """
        data, base, check, value, scores = word.encode(), self.base, self.check, self.value, self.scores
        size, ring = len(data), self.longest + 1
        worst = float("-inf")
        best = [worst] * ring
        widths, pieces = array("H", bytes(2 * (size + 1))), array("i", bytes(4 * (size + 1)))
        best[0] = 0.0
        at = 0
        while at < size:
            lead = data[at]
            width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            here = best[at % ring]
            node, single = 0, False
            for end in range(at, size):
                child = base[node] + data[end] + 1
                if check[child] != node:
                    break
                node = child
                if (piece := value[node]) >= 0:
                    score, stop = here + scores[piece], end + 1
                    single = single or stop - at == width
                    if score > best[stop % ring]:
                        best[stop % ring], widths[stop], pieces[stop] = score, stop - at, piece
            if not single:
                score, stop = here + self.unknown_score, at + width
                if score > best[stop % ring]:
                    best[stop % ring], widths[stop], pieces[stop] = score, width, -1
            for passed in range(at, at + width):
                best[passed % ring] = worst
            at += width
        out, stop = array("i"), size
        while stop:
            piece, start = pieces[stop], stop - widths[stop]
            if piece >= 0:
                out.append(self.ids[piece])
            elif self.byte_ids:
                out.extend(self.byte_ids[x] for x in reversed(data[start:stop]))
            else:
                out.append(self.unknown_id)
            stop = start
        return np.frombuffer(out, np.int32)[::-1].copy()

    def together(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word) of many words: the search of viterbi(), a step for all of them at a time."""
        sizes = np.array([len(w) for w in words], np.int64)
        rows, longest = len(words), int(sizes.max(initial=0))
        data = np.frombuffer(b"".join(w.ljust(longest, b"\0") for w in words), np.uint8).reshape(rows, longest).astype(np.int64)
        base, check, value, scores = self.pieces.base, self.pieces.check, self.pieces.value, self.pieces.scores
        best = np.full((rows, longest + 1), -np.inf)
        came, piece_at = np.zeros((rows, longest + 1), np.int32), np.full((rows, longest + 1), -1, np.int32)
        best[:, 0] = 0.0

        def offer(at: np.ndarray, stop: np.ndarray | int, score: np.ndarray, start: int, piece: np.ndarray | int) -> None:
            better = score > best[at, stop]
            at, stop = at[better], stop[better] if isinstance(stop, np.ndarray) else stop
            best[at, stop], came[at, stop], piece_at[at, stop] = score[better], start, piece[better] if isinstance(piece, np.ndarray) else piece

        for start in range(longest):
            lead = data[:, start]
            at = np.flatnonzero((start < sizes) & ((lead & 0xC0) != 0x80))
            width = np.select([lead[at] < 0x80, lead[at] < 0xE0, lead[at] < 0xF0], [1, 2, 3], 4)
            here, single, live, node = best[at, start], np.zeros(len(at), bool), np.arange(len(at)), np.zeros(len(at), np.int64)
            for end in range(start, longest):
                live_at = at[live]
                child = base[node] + data[live_at, end] + 1
                goes = (end < sizes[live_at]) & (check[child] == node)
                live, node = live[goes], child[goes]
                if not len(live):
                    break
                piece = value[node]
                whole = piece >= 0
                done, piece = live[whole], piece[whole]
                single[done[width[done] == end + 1 - start]] = True
                offer(at[done], end + 1, here[done] + scores[piece], start, piece)
            rest = np.flatnonzero(~single)
            offer(at[rest], start + width[rest], here[rest] + self.unknown_score, start, -1)
        steps, stop = [], sizes.copy()
        at = np.flatnonzero(stop > 0)
        while len(at):
            start = came[at, stop[at]]
            steps.append((at, start, stop[at], piece_at[at, stop[at]]))
            stop[at] = start
            at = at[start > 0]
        if not steps:
            return np.zeros(0, np.int32), np.zeros(rows, np.int64)
        at, start, stop, piece = (np.concatenate(x) for x in zip(*steps, strict=True))
        order = np.lexsort((start, at))
        at, start, stop, piece = at[order], start[order], stop[order], piece[order]
        own = np.where((piece >= 0) | (not self.byte_ids), 1, stop - start)
        ids = np.repeat(np.where(piece >= 0, self.pieces.ids[piece], self.unknown_id), own)
        if self.byte_ids:
            unknown = np.repeat(piece < 0, own)
            offset = np.arange(len(ids)) - np.repeat(np.cumsum(own) - own, own)
            ids[unknown] = self.pieces.byte_ids[data[np.repeat(at, own)[unknown], (np.repeat(start, own) + offset)[unknown]]]
        return ids.astype(np.int32), np.bincount(at, own, rows).astype(np.int64)

    def _encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data = [w.encode() for w in words.to_pylist()]
        lengths = np.array([len(w) for w in data], np.int64)
        sizes, starts, found, total = np.zeros(len(data), np.int64), np.zeros(len(data), np.int64), [np.zeros(0, np.int32)], 0
        order = np.argsort(lengths, kind="stable")
        short = order[lengths[order] <= TOGETHER_BYTES]
        for part in [*(short[i : i + TOGETHER] for i in range(0, len(short), TOGETHER)), *(order[i : i + 1] for i in range(len(short), len(order)))]:
            if lengths[part[0]] <= TOGETHER_BYTES:
                ids, own = self.together([data[i] for i in part])
            else:
                ids = self.viterbi(data[part[0]].decode())
                own = np.array([len(ids)])
            sizes[part], starts[part] = own, total + np.cumsum(own) - own
            found.append(ids)
            total += len(ids)
        return gather(np.concatenate(found), starts, sizes), sizes

    def encode(self, source: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the ids of all texts one after the other, and where each text's begin, with the total at last."""
        words, counts = [], [0]
        for text in source:
            words += SEGMENT.findall(MARK + text.replace(" ", MARK)) if text else []
            counts.append(len(words))
        coded = pa.array(words, pa.string()).dictionary_encode()
        ids, sizes = self.kept.runs(coded.dictionary, coded.indices.to_numpy(), self._encode)
        return ids, np.concatenate(([0], np.cumsum(sizes)))[counts]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The texts of ids: markers become spaces, the one in front goes, byte pieces are put together as UTF-8."""
        parts = (ids[i : i + DECODED] for i in range(0, len(ids), DECODED))
        data = b"".join(gather(self.surface, self.surface_starts[x], self.surface_sizes[x]).tobytes() for x in parts)
        ends = np.concatenate(([0], np.cumsum(self.surface_sizes[ids])))[offsets].tolist()
        return [data[a:b].decode("utf-8", errors="replace")[1:] for a, b in zip(ends, ends[1:], strict=False)]


def encode_decode(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """doc_id, ids (array<int>), ids_crc32 (of little-endian 32-bit ids), decoded (string), round_trip (boolean).

    Null text is empty and has no ids. A text comes back unchanged unless it holds U+2581
    itself, which becomes a space. Whole texts are encoded, however long. Repeated rows get
    equal results; other columns aren't read, so they can't clash; an empty table gives no
    rows. The model's own normalizer isn't applied: models have to come without one.
    """
    codecs: list[Codec] = []

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not codecs:
            codecs.append(Codec(pieces))
        codec, source = codecs[0], texts(batch)
        ids, offsets = codec.encode(source)
        decoded = codec.decode(ids, offsets)
        same = [d == t for d, t in zip(decoded, source, strict=True)]
        crcs = [zlib.crc32(ids[a:b].astype("<i4", copy=False)) for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(offsets.astype(np.int32), pa.array(ids)), pa.array(crcs, pa.int64()), pa.array(decoded, pa.string()), pa.array(same, pa.bool_())], ["doc_id", "ids", "ids_crc32", "decoded", "round_trip"])

    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), "text").mapInArrow(mapper(step, limit=SLICE), "doc_id bigint, ids array<int>, ids_crc32 bigint, decoded string, round_trip boolean")
