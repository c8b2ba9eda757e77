"""SentencePiece encoding and decoding with N-best segmentations (operator 3).

A text is a path through the lattice of its pieces.  Going forward, Viterbi gives the best score of reaching each
position.  Going backward from the end, an A* search extends partial paths in the order of their score plus that forward
score.  The forward score is exactly what is still to come, so paths are completed in order of their total, best first.

Pieces hold no space inside, therefore the lattice of a text is a chain of the lattices of its chunks.  A chunk's best
path, and the loss of its second best, are kept for chunks that come again.  The ``n`` best paths of a chain leave the
best path in at most the ``n - 1`` chunks with the smallest losses, so the search runs in these alone, chunk by chunk,
and the best choices of their paths are put together.

The vocabulary file is read, never trained or copied.  Files of the byte-pair kind hold merge ranks, not
probabilities; pieces then weigh by Zipf's law on their rank.  A character without a piece becomes its UTF-8 bytes.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from array import array
from collections import defaultdict
from collections.abc import Iterable
from itertools import chain, count, islice, pairwise
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harmonium.llm.common import batches, prepared, read, slices
from harmonium.llm.mixing import mixed

#: Vocabulary file; a parameter of everything below.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 4
#: Chunks a worker remembers, and their characters; beyond it, the half that was not met for longest is forgotten.
REMEMBERED, REMEMBERED_CHARS = 150_000, 2_400_000
#: Loss of a byte against the rarest piece.
BYTE_LOSS = 10.0
#: Scores are multiples of it: exact in sums of up to 2 ** 33.
STEP = 2.0**-20
#: Characters of the texts whose chunks are worked on together; the fewest new chunks of one length for that.
GATHERED, TOGETHER = 1 << 18, 24
#: Chunks of one length that are worked on at a time.
ABREAST = 8192


def _spans(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Places ``first``, ``first + 1``, ... of ``many`` members each, one span after the other."""
    return np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())


class PieceModel:
    """The pieces of a vocabulary file and the lattice operations on them.

    Scores are multiples of ``STEP``, so that sums do not depend on their order and equal paths have equal scores.
    """

    def __init__(self, path: str = MODEL_PATH):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        whole = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        ranked = all(float(sp.get_score(i)).is_integer() for i in whole)
        norm = math.log(math.fsum(1 / (r + 2.7) for r in range(len(whole))))
        self.bytes_of: list[bytes] = [b""] * size
        self.pieces: dict[str, tuple[int, float, tuple[int, ...]]] = {}
        for r, i in enumerate(whole):
            piece = sp.id_to_piece(i).replace("▁", " ")
            score = -math.log(r + 2.7) - norm if ranked else float(sp.get_score(i))
            self.pieces[piece] = (i, round(score / STEP) * STEP, (i,))
            self.bytes_of[i] = piece.encode()
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        for b, i in enumerate(self.byte_ids):
            self.bytes_of[i] = bytes([b])
        self.byte_score = min(s for _, s, _ in self.pieces.values()) - BYTE_LOSS
        self.longest = max(map(len, self.pieces))
        self.chars = frozenset(p for p in self.pieces if len(p) == 1)
        #: finds all pieces in a text, in the order of their last character
        self.finder = ahocorasick.Automaton()
        for piece, (_, score, ids) in self.pieces.items():
            self.finder.add_word(piece, (len(piece), score, ids))
        self.finder.make_automaton()
        if any(re.search("[^ ] ", p) for p in self.pieces):
            raise ValueError("the vocabulary has pieces with a space after other characters")
        # characters of no piece end a chunk
        alone = "".join(c for c in "\n\t\r" if not any(c in p for p in self.pieces))
        self.chunks = re.compile(f" *[^ {alone}]+| +|[{alone}]" if alone else " *[^ ]+| +").findall
        self._plant()
        self._byte_many = np.array([len(b) for b in self.bytes_of], np.int64)
        self._byte_first = np.cumsum(self._byte_many) - self._byte_many
        self._bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        # a chunk's number, and by it the score and loss of its best path, and where its pieces stand
        self._number: defaultdict[str, int] = defaultdict(count().__next__)
        self._scores, self._losses = np.empty(0), np.empty(0)
        self._first, self._many = np.empty(0, np.int64), np.empty(0, np.int64)
        self._flat = np.empty(0, np.int32)
        self._held, self._turn, self._met = 0, 0, np.empty(0, np.int64)
        self._lists: dict[tuple[str, int], tuple] = {}

    def _plant(self) -> None:
        """The pieces as a tree: a hash table of steps (node, character) with the nodes they lead to, and the nodes' pieces."""
        steps: dict[int, int] = {}
        piece, score = [-1], [0.0]
        for text, (i, s, _) in self.pieces.items():
            node = 0
            for c in text:
                step = node << 21 | ord(c)
                if step not in steps:
                    steps[step] = len(piece)
                    piece.append(-1)
                    score.append(0.0)
                node = steps[step]
            piece[node], score[node] = i, s
        self._piece, self._score = np.array(piece, np.int32), np.array(score)
        step, lead = np.fromiter(steps, np.int64, len(steps)), np.fromiter(steps.values(), np.int32, len(steps))
        bits = max(4, (3 * len(steps)).bit_length())
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._steps, self._leads = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        at, todo = self._slot(step), np.arange(len(steps))
        while len(todo):
            at[todo] &= self._mask
            free = todo[self._steps[at[todo]] < 0]
            self._steps[at[free]] = step[free]  # of steps for one slot, the last has it
            todo = todo[self._steps[at[todo]] != step[todo]]
            at[todo] += 1
        self._leads[at] = lead
        #: the nodes of the characters that are pieces; 0 for others
        self._root = np.zeros(0x110000, np.int64)
        known = np.array([ord(c) for c in self.chars], np.int64)
        self._root[known] = self._walk(np.zeros(len(known), np.int64), known)[1]

    def _slot(self, step: np.ndarray) -> np.ndarray:
        return (step.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self._shift).astype(np.int64)

    def _walk(self, node: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the nodes have a step by their character, and the nodes these lead to."""
        step = node << 21 | code
        at = self._slot(step)
        found = self._steps[at]
        other = np.flatnonzero((found != step) & (found >= 0))
        while len(other):
            at[other] = at[other] + 1 & self._mask
            found[other] = self._steps[at[other]]
            other = other[(found[other] != step[other]) & (found[other] >= 0)]
        there = np.flatnonzero(found == step)
        return there, self._leads[at[there]].astype(np.int64)

    def spelled(self, char: str) -> tuple[float, tuple[int, ...]]:
        """(score, ids) of a character as its bytes."""
        ids = tuple(self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass"))
        return self.byte_score * len(ids), ids

    def matches(self, chunk: str) -> Iterable[tuple[int, tuple[int, float, tuple[int, ...]]]]:
        """(last position, (length, score, ids)) of the pieces and spelled characters of a chunk, by last position."""
        if self.chars.issuperset(chunk):
            return self.finder.iter(chunk)
        spelled = [(i, (1, *self.spelled(c))) for i, c in enumerate(chunk) if c not in self.chars]
        return heapq.merge(self.finder.iter(chunk), spelled, key=lambda match: match[0])

    def forward(self, chunk: str) -> array:
        """Best score of reaching each position."""
        score = array("d", [-math.inf]) * (len(chunk) + 1)
        score[0] = 0.0
        for last, (length, s, _) in self.matches(chunk):
            total = score[last + 1 - length] + s
            if total > score[last + 1]:
                score[last + 1] = total
        return score

    def best(self, chunk: str) -> tuple[bytes, float, float]:
        """(packed ids, score, loss of the second best path) of a chunk; of equal paths, by the longest last pieces."""
        n, low = len(chunk), -math.inf
        score, second, took = [low] * (n + 1), [low] * (n + 1), [None] * (n + 1)
        score[0] = 0.0
        for last, match in self.matches(chunk):
            j = last + 1
            i = j - match[0]
            s = match[1]
            total, other = score[i] + s, second[i] + s
            if total > score[j]:
                second[j], score[j], took[j] = score[j], total, match
            elif total > second[j]:
                second[j] = total
            if other > second[j]:
                second[j] = other
        parts, at = [], n
        while at:
            length, _, ids = took[at]
            parts.append(ids)
            at -= length
        return array("i", chain.from_iterable(reversed(parts))).tobytes(), score[n], score[n] - second[n]

    def best_of_length(self, chunks: list[str]) -> Iterable[tuple[bytes, float, float]]:
        """``best`` of many chunks of one length, all of whose characters are pieces."""
        code = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32).astype(np.int64).reshape(len(chunks), -1)
        ids, many, score, loss = self._abreast(code.T.copy())
        edge = [0, *np.cumsum(many).tolist()]
        return zip([ids[a:b].tobytes() for a, b in pairwise(edge)], score.tolist(), loss.tolist(), strict=True)

    def _abreast(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pieces one after the other, their numbers, scores and losses of the chunks in the columns of ``code``; one walk down the tree for all."""
        n, rows = code.shape
        score, second = np.full((n + 1, rows), -math.inf), np.full((n + 1, rows), -math.inf)
        score[0] = 0.0
        took, length = np.zeros((n + 1, rows), np.int32), np.zeros((n + 1, rows), np.int64)
        for i in range(n):
            # a single character is always a piece
            node = self._root[code[i]]
            s = self._score[node]
            total, before = score[i] + s, score[i + 1].copy()
            second[i + 1] = np.maximum(np.maximum(second[i + 1], second[i] + s), np.minimum(total, before))
            better = total > before
            for kept, value in ((score, total), (took, self._piece[node]), (length, 1)):
                np.copyto(kept[i + 1], value, where=better)
            row = np.arange(rows)
            for j in range(i + 2, min(n, i + self.longest) + 1):
                there, node = self._walk(node, code[j - 1, row])
                row = row[there]
                if not len(row):
                    break
                ends = np.flatnonzero(self._piece[node] >= 0)
                own, leaf = row[ends], node[ends]
                s = self._score[leaf]
                total, before = score[i, own] + s, score[j, own]
                second[j, own] = np.maximum(np.maximum(second[j, own], second[i, own] + s), np.minimum(total, before))
                better = np.flatnonzero(total > before)
                own = own[better]
                score[j, own], took[j, own], length[j, own] = total[better], self._piece[leaf[better]], j - i
        on_path = np.zeros((rows, n + 1), bool)
        row, at = np.arange(rows), np.full(rows, n)
        while len(row):
            on_path[row, at] = True
            at = at - length[at, row]
            row, at = row[at > 0], at[at > 0]
        return took.T[on_path], on_path.sum(1), score[n], score[n] - second[n]

    def _numbered(self, chunks: list[str]) -> np.ndarray:
        """The numbers of the chunks; the best paths of new ones are looked for."""
        if len(self._number) > REMEMBERED or self._held > REMEMBERED_CHARS:
            self._forget()
        known = len(self._number)
        number = np.fromiter(map(self._number.__getitem__, chunks), np.int64, len(chunks))
        new = list(islice(self._number, known, None))
        if new:
            self._learn(new)
        self._turn += 1
        self._met[number] = self._turn
        return number

    def _forget(self) -> None:
        """Keep half of the chunks, those met last, and of these no long ones."""
        names = list(self._number)
        kept = [k for k in np.argsort(-self._met, kind="stable")[: REMEMBERED // 2].tolist() if len(names[k]) <= 64]
        self._number = defaultdict(count(len(kept)).__next__, zip((names[k] for k in kept), range(len(kept)), strict=True))
        self._held = sum(len(names[k]) for k in kept)
        self._scores, self._losses, self._met = self._scores[kept], self._losses[kept], self._met[kept]
        self._flat = self._flat[_spans(self._first[kept], self._many[kept])]
        self._many = self._many[kept]
        self._first = np.cumsum(self._many) - self._many

    def _learn(self, chunks: list[str]) -> None:
        """Add the best paths of new chunks, in the order of their numbers."""
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        start = np.cumsum(size) - size
        code = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
        usual = np.logical_and.reduceat(self._root[code] > 0, start) & (size <= 64)
        score, loss, many, first = np.empty(len(chunks)), np.empty(len(chunks)), np.empty(len(chunks), np.int64), np.empty(len(chunks), np.int64)
        flat, end = [self._flat], len(self._flat)
        kind = np.where(usual, size, 0)
        order = np.argsort(kind, kind="stable")
        for same in np.split(order, np.flatnonzero(np.diff(kind[order])) + 1):
            length = int(kind[same[0]])
            if length and len(same) >= TOGETHER:
                for some in np.split(same, range(ABREAST, len(same), ABREAST)):
                    ids, many[some], score[some], loss[some] = self._abreast(code[start[some] + np.arange(length)[:, None]].astype(np.int64))
                    first[some] = end + np.cumsum(many[some]) - many[some]
                    flat.append(ids)
                    end += len(ids)
            else:
                for k in same.tolist():
                    ids, score[k], loss[k] = self.best(chunks[k])
                    first[k], many[k] = end, len(ids) // 4
                    flat.append(np.frombuffer(ids, np.int32))
                    end += len(ids) // 4
        self._flat = np.concatenate(flat)
        self._scores, self._losses = np.concatenate([self._scores, score]), np.concatenate([self._losses, loss])
        self._first, self._many = np.concatenate([self._first, first]), np.concatenate([self._many, many])
        self._met = np.concatenate([self._met, np.zeros(len(chunks), np.int64)])
        self._held += int(size.sum())

    def search(self, chunk: str, n: int) -> list[tuple[float, bytes]]:
        """The ``n`` best paths of a chunk's lattice: (score, packed ids), best first.

        Of equal paths the one that has come further goes on first.  A position is left ``n`` times at most: paths reach
        it best first, and the ``n`` best of the chunk need no more of them.  Edges are looked up where a path comes by.
        """
        ahead = self.forward(chunk)
        heap, found, count, left = [(-ahead[-1], len(chunk), 0, 0.0, None)], [], 0, {}
        while heap and len(found) < n:
            _, at, _, done, path = heapq.heappop(heap)
            if not at:
                ids = array("i")
                while path:
                    ids.extend(path[0])
                    path = path[1]
                found.append((done, ids.tobytes()))
                continue
            times = left[at] = left.get(at, 0) + 1
            if times > n:
                continue
            edges = [(i, *self.pieces[chunk[i:at]][1:]) for i in range(max(0, at - self.longest), at) if chunk[i:at] in self.pieces]
            if chunk[at - 1] not in self.chars:
                edges.append((at - 1, *self.spelled(chunk[at - 1])))
            for i, s, ids in edges:
                count += 1
                heapq.heappush(heap, (-(ahead[i] + s + done), i, count, s + done, (ids, path)))
        return found

    def paths(self, chunk: str, n: int) -> tuple[list[tuple[float, bytes]], bool]:
        """The ``n`` best paths of a chunk as (loss, packed ids), and whether all of them spell it."""
        known = self._lists.get((chunk, n))
        if known is None:
            found = self.search(chunk, n)
            spell = chunk.encode("utf-8", "surrogatepass")
            known = [(found[0][0] - s, ids) for s, ids in found], all(self.spell(ids) == spell for _, ids in found)
            if len(chunk) <= 64:
                if len(self._lists) >= REMEMBERED // 8:
                    self._lists.clear()
                self._lists[chunk, n] = known
        return known

    def segmentations(self, texts: list[str | None], n: int = 1) -> Iterable[tuple[list[tuple[float, bytes]], bool]]:
        """For each text up to ``n`` best segmentations of the whole text, as (score, packed ids), and whether all spell it.

        Null and empty: one of no piece.  The chunks of several texts are worked on together.
        """
        at = 0
        while at < len(texts):
            split, size = [], 0
            while at < len(texts) and (not split or size < GATHERED):
                size += len(texts[at] or "")
                split.append(self.chunks(" " + texts[at]) if texts[at] else [])
                at += 1
            every = list(chain.from_iterable(split))
            number = self._numbered(every)
            many, scores, losses = self._many[number], self._scores[number], self._losses[number]
            ids = self._flat[_spans(self._first[number], many)]
            spelled = self._bytes[_spans(self._byte_first[ids], self._byte_many[ids])].tobytes()
            equal = spelled == "".join(every).encode("utf-8", "surrogatepass")
            packed, offset = ids.tobytes(), np.concatenate([[0], 4 * np.cumsum(many)])
            del every, number, many, ids, spelled
            last = 0
            for chunks in split:
                first, last = last, last + len(chunks)
                edges = offset[first : last + 1] - offset[first]
                yield self._chained(chunks, packed[offset[first] : offset[last]], edges, scores[first:last], losses[first:last], equal, n)

    def _chained(self, chunks: list[str], whole: bytes, offset: np.ndarray, scores: np.ndarray, losses: np.ndarray, equal: bool, n: int) -> tuple[list[tuple[float, bytes]], bool]:
        """The ``n`` best of a text from its best, ``whole``, with the chunks' offsets in it; equal: known to spell the text."""
        if not chunks:
            return [(0.0, b"")], True
        total = float(scores.sum())
        equal = equal or self.spell(whole) == "".join(chunks).encode("utf-8", "surrogatepass")
        # of equal losses, those of the first chunks
        loose = []
        for _ in range(n - 1):
            least = int(losses.argmin())
            if losses[least] == math.inf:
                break
            loose.append(least)
            losses[least] = math.inf
        if not loose:
            return [(total, whole)], equal
        loose.sort()
        lists = []
        for k in loose:
            found, spelled = self.paths(chunks[k], n)
            lists.append(found)
            equal &= spelled
        # a choice of the i-th, j-th, ... path comes behind (i + 1) (j + 1) ... - 1 others at least
        choices = [((), 0.0, 1)]
        for found in lists:
            choices = [((*c, i), loss + found[i][0], rank * (i + 1)) for c, loss, rank in choices for i in range(min(len(found), n // rank))]
        out = []
        for choice, loss, _ in sorted(choices, key=lambda c: (c[1], c[0]))[:n]:
            new, last = [], 0
            for k, found, i in zip(loose, lists, choice, strict=True):
                new += [whole[last : offset[k]], found[i][1]]
                last = offset[k + 1]
            out.append((total - loss, b"".join([*new, whole[last:]])))
        return out, equal

    def encode(self, text: str | None, n: int = 1) -> list[tuple[float, list[int]]]:
        """Up to ``n`` best segmentations of the whole text: (score, ids); null and empty: one of no piece."""
        return [(score, array("i", ids).tolist()) for score, ids in next(iter(self.segmentations([text], n)))[0]]

    def spell(self, packed: bytes) -> bytes:
        """The bytes that packed ids stand for."""
        ids = array("i", packed)
        return b"".join(itemgetter(*ids)(self.bytes_of) if len(ids) > 1 else [self.bytes_of[i] for i in ids])

    def decode(self, ids: list[int] | None) -> str:
        """The text of a segmentation; ids of control pieces have no text."""
        return self.spell(array("i", ids if ids is not None else []).tobytes()).decode("utf-8", "replace")[1:]


_models: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """The worker's model of a file; opened once."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = N_BEST, path: str = MODEL_PATH) -> DataFrame:
    """(key, segmentations: array of struct score, ids; decoded_equal) for every row, best segmentation first.

    Null texts are encoded like empty ones, to one segmentation without pieces (decoded_equal: true).  Texts with fewer
    than ``n`` paths have fewer segmentations.  Repeated rows are encoded each; other columns are not read.  The key
    may be null.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    item = pa.struct([("score", pa.float64()), ("ids", pa.list_(pa.int32()))])

    def run(parts):
        m = model(path)
        for part in slices(parts):
            found, equal = [], []
            for best, same in m.segmentations(part.column(1).to_pylist(), n):
                found.append([{"score": s, "ids": array("i", ids).tolist()} for s, ids in best])
                equal.append(same)
            yield batches(pa.schema([("key", part.schema.field(0).type), ("segmentations", pa.list_(item)), ("decoded_equal", pa.bool_())]), [part.column(0), found, equal])

    return rows.mapInArrow(run, f"key {kind}, segmentations array<struct<score:double,ids:array<int>>>, decoded_equal boolean").withColumnRenamed("key", key)


def decode(rows: DataFrame, ids: str = "ids", path: str = MODEL_PATH) -> DataFrame:
    """``rows`` with the text of the array column ``ids`` as ``decoded``; null ids give an empty text."""
    import pandas as pd

    run = F.pandas_udf(lambda column: pd.Series([model(path).decode(x) for x in column], index=column.index, dtype=object), "string")
    return rows.withColumn("decoded", run(F.coalesce(F.col(ids), F.array().cast("array<int>"))))


def op3_sentencepiece_nbest(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: pieces and score of the best segmentation, scores and digest of all ``N_BEST``."""
    rows = read(spark, folder, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("n_segmentations", pa.int32()), ("score", pa.float64()), ("last_score", pa.float64()), ("ids_sha256", pa.string()), ("nbest_sha256", pa.string()), ("decoded_equal", pa.bool_())])

    def run(parts):
        m = model(MODEL_PATH)
        for part in slices(parts):
            out = [[] for _ in range(7)]
            for best, equal in m.segmentations(part.column(1).to_pylist(), N_BEST):
                every = hashlib.sha256()
                for _, ids in best:
                    every.update(ids)
                    every.update(b"|")
                first = best[0][1]
                for column, value in zip(out, (len(first) // 4, len(best), best[0][0], best[-1][0], hashlib.sha256(first).hexdigest(), every.hexdigest(), equal), strict=True):
                    column.append(value)
            yield batches(schema, [part.column(0), *out])

    return rows.mapInArrow(run, "doc_id long, n_pieces long, n_segmentations int, score double, last_score double, ids_sha256 string, nbest_sha256 string, decoded_equal boolean")


def stage_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as the ids of its best segmentation, and the scores of the ``N_BEST`` best, in the order of the mixture.

    Files do not keep an order over each other, so the mixture's slot and place are found again (they follow from
    doc_id and source alone), returned as columns and sorted by.
    """
    prepared(spark)
    rows = mixed(docs.select("doc_id", "source", "lang", "text")).orderBy("slot", "place", "source", "doc_id").select("doc_id", "source", "lang", "slot", "place", "text")
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("lang", pa.string()), ("slot", pa.int64()), ("place", pa.int64()), ("ids", pa.list_(pa.int32())), ("scores", pa.list_(pa.float64())), ("decoded_equal", pa.bool_())])

    def run(parts):
        m = model(MODEL_PATH)
        for part in slices(parts):
            ids, scores, equal = [], [], []
            for best, same in m.segmentations(part.column(5).to_pylist(), N_BEST):
                ids.append(np.frombuffer(best[0][1], np.int32))
                scores.append([s for s, _ in best])
                equal.append(same)
            yield batches(schema, [*part.columns[:5], ids, scores, equal])

    return rows.mapInArrow(run, "doc_id long, source string, lang string, slot long, place long, ids array<int>, scores array<double>, decoded_equal boolean")
