"""SentencePiece encoding and decoding by a weighted finite-state transducer.

The normaliser (a leading space, spaces written as U+2581), the pieces and byte fallback are compiled into one machine:
its states are the beginnings of pieces, its arcs read a character of the raw text, and where a piece ends an arc back
to the start writes its id at a weight. Each input is composed with it, and of all paths the shortest one in the
tropical semiring (weights add along a path, of paths that meet the least one stays) gives the ids.

In a unigram model a piece weighs what its score lacks to zero, and a character without a piece what the library gives
unknown ones. In a BPE model merging decides: each piece weighs one, and an arc after a piece is cut off (an infinite
weight) if merging would not leave the two side by side, so that the sequence which merging makes is the one path.
"""

from __future__ import annotations

import re
from array import array
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

SPACE = "▁"
INFINITE = float("inf")
#: A fixed value of the library: what a character without a piece weighs beyond the worst piece of a unigram model.
UNKNOWN_PENALTY = 10.0
#: Stretches of text whose paths a worker remembers, and pairs of pieces; beyond it, it starts afresh.
REMEMBERED = 250_000
#: Rows that a worker handles at once.
ROWS = 512


class Transducer:
    """The compiled model: states and arcs of the pieces, fallback to bytes, and which piece may follow which."""

    def __init__(self, model_file: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        norm, kinds, types = model.normalizer_spec, pb.ModelProto.SentencePiece, pb.TrainerSpec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only the identity normaliser is compiled")
        if model.trainer_spec.model_type not in (types.BPE, types.UNIGRAM) or not model.trainer_spec.byte_fallback:
            raise ValueError("only BPE and unigram models with byte fallback are compiled")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("user-defined and unused pieces are not compiled")
        self.merges = model.trainer_spec.model_type == types.BPE
        self.prefix = " " if norm.add_dummy_prefix else ""
        self.pieces = [p.piece for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.scores = {p.piece: p.score for p in model.pieces if p.piece in self.ids}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.weights = [1.0 if self.merges else -p.score for p in model.pieces]
        self.fallback = 1.0 if self.merges else UNKNOWN_PENALTY - min(self.scores.values(), default=0.0)
        self.output = [b""] * len(self.pieces)
        for piece, i in self.ids.items():
            self.output[i] = piece.replace(SPACE, " ").encode()
        for value, i in self.bytes.items():
            self.output[i] = bytes([value])
        # a state: the id that is written where a piece ends, or -1, and the arcs from there by character
        self.start: dict = {}
        for piece, i in self.ids.items():
            arcs = self.start
            for c in piece:
                if c not in arcs:
                    arcs[c] = [-1, {}]
                    if c == SPACE:
                        arcs[" "] = arcs[c]  # the normaliser: both characters are the same arc
                state = arcs[c]
                arcs = state[1]
            state[0] = i
        if self.merges and any(state[0] < 0 for state in self.start.values()):
            raise ValueError("a BPE model's pieces must be made of characters that are pieces")
        self.steps: dict[int, list] = {}
        self.follows: dict[int, dict[int, bool]] = {}
        self.known = 0
        self.paths: dict[str, bytes] = {}
        # no piece crosses from a character into a later space, so paths join there; nor a line break, if none has one
        whole = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        lone = "" if any("\n" in p for p in self.ids) else "\n"
        self.cut = re.compile("(?s).+" if whole else f"[ {SPACE}]*[^ {SPACE}{lone}]+|[ {SPACE}]+" + (f"|{lone}" if lone else ""))

    def merging(self, piece: str) -> list[tuple]:
        """How a piece is merged from its characters: before each merge (its score, the first part, the last part);
        the last entry has no score."""
        parts, scores, steps = list(piece), self.scores, []
        while True:
            best, at = None, -1
            for i, (a, b) in enumerate(pairwise(parts)):
                s = scores.get(a + b)
                if s is not None and (best is None or s > best):
                    best, at = s, i
            steps.append((best, parts[0], parts[-1]))
            if at < 0:
                return steps
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def may_follow(self, a: int, b: int) -> bool:
        """Whether merging the text of two pieces leaves both as they are: each is merged as if alone, best score
        first and the leftmost of equals, and never is the pair across their border next."""
        left, right = (self.steps.get(x) or self.steps.setdefault(x, self.merging(self.pieces[x])) for x in (a, b))
        scores, i, j = self.scores, 0, 0
        if len(left[-1][1]) != len(self.pieces[a]) or len(right[-1][1]) != len(self.pieces[b]):
            return False  # merging never makes such a piece
        while True:
            own, _, last = left[i]
            other, first, _ = right[j]
            across = scores.get(last + first)
            if across is not None and (own is None or across > own) and (other is None or across >= other):
                return False
            if own is not None and (other is None or own >= other):
                i += 1
            elif other is not None:
                j += 1
            else:
                return True

    def joins(self, a: int, b: int) -> bool:
        """may_follow, remembered."""
        after = self.follows.get(a)
        if after is None:
            if self.known > REMEMBERED:
                self.follows.clear()
                self.known = 0
            after = self.follows[a] = {}
        free = after.get(b)
        if free is None:
            free = after[b] = self.may_follow(a, b)
            self.known += 1
        return free

    def shortest_path(self, text: str) -> array:
        """Composes one stretch of raw text with the machine: the ids that its least path writes.

        cost is of the least path to each position, last the piece it ends with (-1 for none or raw bytes), back where
        that began. Of equal paths the first stays, as in the library.
        """
        n, start, weights, merges, joins = len(text), self.start, self.weights, self.merges, self.joins
        cost, last, back = [INFINITE] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
        cost[0] = 0.0
        for i in range(n):
            here = cost[i]
            if here == INFINITE:
                continue
            before, j = last[i], i + 1
            state = start.get(text[i])
            if state is None or state[0] < 0:  # a character without a piece: an arc that writes its bytes
                if here + self.fallback < cost[j]:
                    cost[j], last[j], back[j] = here + self.fallback, -1, i
            while state is not None:
                piece, arcs = state
                if piece >= 0:
                    there = here + weights[piece]
                    if there < cost[j] and (not merges or before < 0 or joins(before, piece)):
                        cost[j], last[j], back[j] = there, piece, i
                if j == n:
                    break
                state = arcs.get(text[j])
                j += 1
        out, j = array("i"), n
        while j:
            i = back[j]
            if last[j] >= 0:
                out.append(last[j])
            else:
                out.extend(self.bytes[b] for b in reversed(text[i:j].encode()))
            j = i
        out.reverse()
        return out

    def encode(self, text: str) -> bytes:
        """Ids as packed 32-bit integers."""
        if not text:
            return b""
        paths = self.paths
        parts = self.cut.findall(self.prefix + text)
        try:
            return b"".join(map(paths.__getitem__, parts))
        except KeyError:
            if len(paths) >= REMEMBERED:
                paths.clear()
            for p in parts:
                if p not in paths:
                    paths[p] = self.shortest_path(p).tobytes()
            return b"".join(map(paths.__getitem__, parts))

    def decode(self, ids: np.ndarray) -> bytes:
        """The inverse: the pieces' text without the leading space. Control pieces write nothing."""
        out = b"".join(map(self.output.__getitem__, ids.tolist()))
        return out[1:] if self.prefix and out[:1] == b" " else out

    def forget(self) -> None:
        """Between tasks, which have stretches of their own, only the machine stays in memory."""
        self.paths.clear()
        self.follows.clear()
        self.known = 0


_compiled: dict[str, Transducer] = {}


def _transducer(name: str) -> Transducer:
    """Compiled once for each worker process, from the file that Spark has sent along."""
    if name not in _compiled:
        _compiled[name] = Transducer(SparkFiles.get(name))
    return _compiled[name]


def _add(df: DataFrame, columns: dict, run) -> DataFrame:
    schema = StructType([f for f in df.schema.fields if f.name not in columns])
    for name, kind in columns.items():
        schema = schema.add(name, kind)

    def each(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                rest = [c for c in batch.schema.names if c not in columns]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *run(batch)], names=[*rest, *columns])
        for t in _compiled.values():
            t.forget()

    return df.mapInArrow(each, schema)


def send_model(spark, model_file: str) -> str:
    spark.sparkContext.addFile(model_file)
    return model_file.rsplit("/", 1)[-1]


def encode(df: DataFrame, model_file: str, text_col: str = "text") -> DataFrame:
    """df with n_tokens and token_ids (array<int>), as the public library's encode gives them, without markers.

    A null text has null token_ids and no tokens, an empty one an empty list. Columns of these names are replaced,
    all others and all rows stay.
    """
    name = send_model(df.sparkSession, model_file)

    def run(batch):
        t = _transducer(name)
        packed = [None if x is None else t.encode(x) for x in batch.column(text_col).to_pylist()]
        flat = np.frombuffer(b"".join(x or b"" for x in packed), np.int32)
        n = np.array([len(x or b"") // 4 for x in packed], np.int64)
        at = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
        nulls = pa.array([x is None for x in packed], pa.bool_())
        return [pa.array(n), pa.ListArray.from_arrays(at, pa.array(flat), mask=nulls)]

    return _add(df, {"n_tokens": LongType(), "token_ids": ArrayType(IntegerType())}, run)


def decode(df: DataFrame, model_file: str, ids_col: str = "token_ids") -> DataFrame:
    """df with `decoded`, the text of its token ids; null stays null. Bytes that are no UTF-8 become U+FFFD."""
    name = send_model(df.sparkSession, model_file)

    def run(batch):
        t, lists = _transducer(name), batch.column(ids_col)
        flat, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        out = [t.decode(flat[at[i] : at[i + 1]]).decode("utf-8", "replace") if v else None for i, v in enumerate(lists.is_valid().to_pylist())]
        return [pa.array(out, pa.string())]

    return _add(df, {"decoded": StringType()}, run)
