"""SentencePiece encoding and decoding by a max-plus parallel scan.

A model is a set of steps from state to state: a state is a position in the text and, for BPE models, the piece that
ended there. Unigram models weigh a step with the piece's score; the best path is the encoding. For BPE models
a step weighs 0 if the two pieces are what merging makes of their own text, and minus infinity if not:
a sequence of pieces is the BPE encoding of its text exactly if each neighbouring pair is, so one path alone is finite.
Long texts are cut into chunks. Each chunk yields, on its own, the max-plus matrix from the states that may enter
it to those that may leave it; the matrices are multiplied along the text (an associative product), which
fixes the states at every border; then every chunk traces its own path back.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, small_batches, small_slices, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Characters of a chunk; texts of over two chunks are encoded by many tasks.
CHUNK = 16_384
#: Remembered segments per task, and characters of a segment that is remembered.
CACHE, CACHED_LENGTH = 200_000, 48
NONE = float("-inf")

State = tuple[int, str]


def proto_fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at, value, shift = at + 1, value | (byte & 127) << shift, shift + 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else 4 if kind == 5 else 8
        yield tag >> 3, raw[at : at + size]
        at += size


class Pieces:
    """The vocabulary of a model file; subclasses give the steps."""

    def __init__(self, raw: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=raw)
        top = list(proto_fields(raw))
        trainer = {k: v for f, x in top if f == 2 for k, v in proto_fields(x)}
        norm = {k: v for f, x in top if f == 3 for k, v in proto_fields(x)}
        if norm.get(2) or norm.get(4, 1):
            raise ValueError("models that rewrite their text (normaliser, removed white space) aren't supported: decoding couldn't be exact")
        self.prefix, self.fallback = bool(norm.get(3, 1)), bool(trainer.get(35, 0))
        n = range(sp.get_piece_size())
        plain = [i for i in n if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        self.scores = {sp.id_to_piece(i): sp.get_score(i) for i in plain}
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in n if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.longest = max(map(len, self.ids))
        self.out = [b"" if sp.is_control(i) or i == self.unknown else bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace(SPACE, " ").encode() for i in n]
        self.out[self.unknown] = " ⁇ ".encode()
        inner = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        #: Neighbouring characters that some piece holds; no piece crosses between others.
        self.joined = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.plain = pa.array(self.out, pa.binary())
        #: Runs that no piece crosses: a word with the blanks before it.
        self.segments = None if inner else re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def surface(self, text: str) -> str:
        """The text as pieces spell it."""
        return (SPACE if self.prefix and text else "") + text.replace(" ", SPACE)

    def border(self, text: str, lo: int, hi: int) -> int:
        """The first place in lo..hi that no piece crosses (blanks after a word begin there); -1 if there is none."""
        if self.segments is None:
            return -1
        at = text.find(SPACE, lo)
        while 0 < at <= hi and text[at - 1] == SPACE:
            at = text.find(SPACE, at + 1)
        return at if 0 < at <= hi else -1

    def last_border(self, text: str, lo: int, hi: int) -> int:
        """The last such place in lo..hi."""
        at = text.rfind(SPACE, lo, hi + 1) if self.segments is not None else -1
        while at > 0 and text[at - 1] == SPACE:
            at = text.rfind(SPACE, lo, at)
        return at if at > 0 else -1

    def solve(self, segment: str) -> list[str]:
        """The pieces of a text that starts and ends at borders: its matrix is one number, its path the best."""
        leaving = transfer(self, segment, [(0, "")], len(segment))
        stop = max((float(v[0]), s) for s, v in leaving.items() if s[0] == len(segment))[1]
        return trace(self, segment, (0, ""), stop, len(segment))

    def token(self, piece: str) -> list[int]:
        found = self.ids.get(piece)
        if found is not None:
            return [found]
        return [self.bytes[b] for b in piece.encode()] if self.fallback else [self.unknown]

    def decode(self, ids) -> str:
        return self.decode_all(pa.array([ids], pa.list_(pa.int32())))[0]

    def decode_all(self, ids: pa.ListArray) -> list[str]:
        """The text of each list of ids; a null list is empty, a null id is skipped."""
        flat = ids.flatten()
        parts = self.plain.take(flat)
        lengths = pc.fill_null(pc.binary_length(parts), 0).to_numpy(zero_copy_only=False)
        ends = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
        raw = b"".join(parts.drop_null().to_pylist()) if parts.null_count else _joined(parts)
        cuts = ends[np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))))]
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)]
        return [t[1:] if self.prefix and t.startswith(" ") else t for t in texts]

    def steps(self, text: str, at: int, last: str) -> list[tuple[int, str, str, float]]:
        """(position, piece to remember, piece, weight) of each step from a state."""
        raise NotImplementedError

    def entries(self, text: str, border: int) -> list[State]:
        """States in which a path may cross the border: it has passed it, with a piece that began before it."""
        raise NotImplementedError

    def matched(self, text: str, at: int) -> list[str]:
        """Pieces that the text has at a position; an unknown character is one."""
        found = [text[at:end] for end in range(at + 1, min(at + self.longest, len(text)) + 1) if text[at:end] in self.ids]
        return found if text[at] in self.ids else [text[at], *found]

    def crossing(self, text: str, border: int) -> Iterator[tuple[int, str]]:
        for start in range(max(0, border - self.longest), border):
            for piece in self.matched(text, start):
                if start + len(piece) >= border:
                    yield start + len(piece), piece


class Unigram(Pieces):
    def __init__(self, raw: bytes):
        super().__init__(raw)
        self.penalty = min(self.scores.values()) - 10.0

    def steps(self, text, at, last):
        return [(at + len(p), "", p, self.scores.get(p, self.penalty)) for p in self.matched(text, at)]

    def entries(self, text, border):
        return sorted({(end, "") for end, _ in self.crossing(text, border)})


class Bpe(Pieces):
    def __init__(self, raw: bytes):
        super().__init__(raw)
        self.pairs: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """Repeatedly joins the neighbours that make the piece of best score, the leftmost of equals."""
        parts, score = list(text), self.scores.get
        pairs = [score(a + b, NONE) for a, b in zip(parts, parts[1:])]  # noqa: B905
        while pairs and (best := max(pairs)) != NONE:
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = score(parts[i - 1] + parts[i], NONE)
            if i < len(pairs):
                pairs[i] = score(parts[i] + parts[i + 1], NONE)
        return parts

    def solve(self, segment):
        # merging short text finds the one finite path at once
        return self.merged(segment) if len(segment) <= CACHED_LENGTH else super().solve(segment)

    def stable(self, left: str, right: str) -> bool:
        """Whether merging the joined text of two pieces gives the two pieces (of one piece: itself)."""
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) > CACHE:
                self.pairs.clear()
            found = self.pairs[left, right] = self.merged(left + right) == [x for x in (left, right) if x]
        return found

    def steps(self, text, at, last):
        return [(at + len(p), p, p, 0.0) for p in self.matched(text, at) if self.stable(last, p)]

    def entries(self, text, border):
        return sorted({(end, p) for end, p in self.crossing(text, border) if self.stable("", p)})


def load(path: str | None = None, raw: bytes | None = None) -> Pieces:
    """The model of a file (or of its bytes), by its kind."""
    if raw is None:
        with open(path or MODEL, "rb") as f:
            raw = f.read()
    kind = 1
    for f, x in proto_fields(raw):
        if f == 2:  # a repeated message is merged: the last kind counts
            kind = dict(proto_fields(x)).get(3, kind)
    return {1: Unigram, 2: Bpe}[kind](raw)


def transfer(model: Pieces, text: str, entries: list[State], end: int) -> dict[State, np.ndarray]:
    """The max-plus matrix of a stretch of text: by leaving state, the best weight from each entering state."""
    at: dict[int, dict[str, np.ndarray]] = defaultdict(dict)
    for i, (p, last) in enumerate(entries):
        at[p][last] = np.where(np.arange(len(entries)) == i, 0.0, NONE)
    out: dict[State, np.ndarray] = {(p, last): v for p, x in at.items() if p >= end for last, v in x.items()}
    for p in range(min(at, default=end), end):
        for last, weights in at.pop(p, {}).items():
            for q, keep, _, w in model.steps(text, p, last):
                to = out if q >= end else at[q]
                key = (q, keep) if q >= end else keep
                to[key] = np.maximum(to[key], weights + w) if key in to else weights + w
    return out


def combine(left: dict[State, np.ndarray], entries: list[State], right: dict[State, np.ndarray]) -> dict[State, np.ndarray]:
    """The max-plus product of two stretches that meet at a border; `entries` are the right one's rows. Associative."""
    rows = [(i, left[s]) for i, s in enumerate(entries) if s in left]
    if not rows:
        return {}
    stacked = np.stack([v for _, v in rows])
    index = [i for i, _ in rows]
    return {s: (stacked + v[index][:, None]).max(0) for s, v in right.items()}


def trace(model: Pieces, text: str, start: State, stop: State, end: int) -> list[str]:
    """The pieces of the best path from state to state, which leaves the stretch at or after `end`."""
    best: dict[int, dict[str, tuple[float, State | None, str]]] = defaultdict(dict)
    best[start[0]][start[1]] = (0.0, None, "")
    for p in range(start[0], end):
        for last, (weight, _, _) in list(best[p].items()) if p in best else ():
            for q, keep, piece, w in model.steps(text, p, last):
                if keep not in best[q] or weight + w > best[q][keep][0]:
                    best[q][keep] = (weight + w, (p, last), piece)
    out, at = [], stop
    while at != start:
        _, at, piece = best[at[0]][at[1]]
        out.append(piece)
    return out[::-1]


class Encoder(dict):
    """Segment -> its ids as bytes of int32; remembers short segments."""

    def __init__(self, model: Pieces):
        super().__init__()
        self.model = model

    def __missing__(self, segment: str) -> bytes:
        end = len(segment)
        while end > 2 and segment[end - 1] in ".,!?;:" and segment[end - 2 : end] not in self.model.joined:
            end -= 1  # no piece reaches over: marks at the end are pieces of their own
        if end < len(segment):
            return self[segment[:end]] + b"".join(map(self.__getitem__, segment[end:]))
        ids = [i for piece in self.model.solve(segment) for i in self.model.token(piece)]
        packed = array("i", ids).tobytes()
        if len(segment) <= CACHED_LENGTH:
            if len(self) > CACHE:
                self.clear()
            self[segment] = packed
        return packed

    def encode(self, text: str) -> bytes:
        return self.surface(self.model.surface(text))

    def surface(self, surface: str) -> bytes:
        """The ids of spelled text between two borders."""
        if not surface:
            return b""
        parts = self.model.segments.findall(surface) if self.model.segments else [surface]
        return b"".join(map(self.__getitem__, parts))


def _joined(parts: pa.BinaryArray) -> bytes:
    """All values of an array without nulls, one after the other."""
    if not len(parts):
        return b""
    _, offsets, data = parts.buffers()
    at = np.frombuffer(offsets, np.int32)[parts.offset : parts.offset + len(parts) + 1]
    return data[int(at[0]) : int(at[-1])].to_pybytes() if data is not None else b""


@functools.lru_cache(maxsize=4)
def encoder_of(path: str) -> Encoder:
    """One encoder for all tasks that a worker process runs."""
    return Encoder(load(path))


def _id_lists(packed: list[bytes]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in packed]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), np.int32)))


def _encode_small(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for part in small_slices(batches, 256):
            packed = [encoder.encode(x or "") for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), _id_lists(packed)], ["id", "ids"])

    return run


_CHUNK = pa.schema([("row", pa.int64()), ("no", pa.int32()), ("n", pa.int32()), ("text", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("last", pa.bool_())])


def _cut(path: str, chunk: int):
    """Rows (row, text) -> chunks (row, no, n: the row's chunks, text with a margin on both sides, from, to), places within that text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder_of(path).model
        for batch in small_slices(batches):
            for row, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = model.surface(text)
                for no, lo in enumerate(range(0, len(s), chunk)):
                    begin = max(0, lo - model.longest)
                    part = s[begin : lo + chunk + model.longest]
                    yield pa.RecordBatch.from_pylist([{"row": row, "no": no, "n": -(-len(s) // chunk), "text": part, "a": lo - begin, "b": min(lo + chunk, len(s)) - begin, "last": lo + chunk >= len(s)}], schema=_CHUNK)

    return run


def chunk_entries(model: Pieces, text: str, a: int, no: int) -> list[State]:
    """The states in which a path may enter a chunk; at the text's start and at a border there is one."""
    return [(a, "")] if no == 0 or model.border(text, a, a) == a else model.entries(text, a)


def chunk_matrix(model: Pieces, text: str, entries: list[State], a: int, b: int, walk_all: bool = False) -> dict[State, np.ndarray]:
    """transfer() of text[a:b]. All paths meet at a border, so only what lies before the first and after the last one need be walked;
    what lies between adds the same to all of them and is left out, unless walk_all."""
    if walk_all:
        return transfer(model, text, entries, b)
    first = a if entries == [(a, "")] else model.border(text, a, b)
    if first < 0:
        return transfer(model, text, entries, b)
    head = transfer(model, text, entries, first)
    met = np.max(np.stack([v for s, v in head.items() if s[0] == first]), axis=0)
    last = max(first, model.last_border(text, first, b))
    tail = transfer(model, text, [(last, "")], b)
    return {s: met + v[0] for s, v in tail.items()}


def chunk_ids(model: Pieces, encoder: Encoder, text: str, start: State, stop: State, a: int, b: int, walk_all: bool = False) -> bytes:
    """The ids of the best path through text[a:b] from state to state, as bytes of int32: traced back whole if walk_all, else only outside the first and last border."""
    ids = lambda pieces: np.array([i for piece in pieces for i in model.token(piece)], np.int32).tobytes()
    first = start[0] if start == (a, "") else model.border(text, a, b)
    if first < 0 or walk_all:
        if stop == (b, "") and walk_all and b < len(text):  # at a border all states are one: the best of them
            leaving = transfer(model, text, [start], b)
            stop = max((float(v[0]), s) for s, v in leaving.items() if s[0] == b)[1]
        return ids(trace(model, text, start, stop, b))
    head = b""
    if start[0] < first:
        leaving = transfer(model, text, [start], first)
        met = max((float(v[0]), s) for s, v in leaving.items() if s[0] == first)[1]
        head = ids(trace(model, text, start, met, first))
    last = max(first, model.last_border(text, first, b))
    tail = b"" if stop == (last, "") else ids(trace(model, text, (last, ""), stop, b))
    return head + encoder.surface(text[first:last]) + tail


Matrix = dict[str, list]  # in: entering states, from the chunk's start; out: (leaving state, from its end, and the weight from each entering state)


def _matrices(path: str, walk_all: bool):
    """Chunks -> (row, no, n, matrix)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder_of(path).model
        for batch in small_slices(batches):
            out = [json.dumps(border_matrix(model, x["text"], x["a"], x["b"], x["no"], x["last"], walk_all)) for x in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("no"), batch.column("n"), pa.array(out, pa.string())], ["row", "no", "n", "matrix"])

    return run


def border_matrix(model: Pieces, text: str, a: int, b: int, no: int, last: bool, walk_all: bool = False) -> Matrix:
    """The matrix of a chunk (text[a:b]), its states told by their distance from the chunk's borders, so that neighbours speak of the same ones."""
    entries = chunk_entries(model, text, a, no)
    leaving = chunk_matrix(model, text, entries, a, b, walk_all)
    if not last and model.border(text, b, b) == b:  # one state there, whatever the last piece
        leaving = {(b, ""): np.max(np.stack(list(leaving.values())), axis=0)}
    return {"in": [(p - a, s) for p, s in entries], "out": [(p - b, s, v.tolist()) for (p, s), v in leaving.items() if not last or p == b]}


def _states(matrix: Matrix) -> tuple[list[State], dict[State, np.ndarray]]:
    return [(p, s) for p, s in matrix["in"]], {(p, s): np.array(v) for p, s, v in matrix["out"]}


def product(left: Matrix, right: Matrix) -> Matrix:
    """The matrix of two neighbours as one."""
    _, of_left = _states(left)
    entries, of_right = _states(right)
    return {"in": left["in"], "out": [(p, s, v.tolist()) for (p, s), v in combine(of_left, entries, of_right).items()]}


def middle_state(left: Matrix, right: Matrix, start: State, stop: State) -> State:
    """The state between two neighbours on the best path from start to stop."""
    rows, of_left = _states(left)
    entries, of_right = _states(right)
    i = rows.index(start)
    return max((float(of_left[s][i] + of_right[stop][j]), s) for j, s in enumerate(entries) if s in of_left)[1]


def best_ends(matrix: Matrix) -> tuple[State, State]:
    """(entering, leaving) state of the best path through a whole text."""
    entries, leaving = _states(matrix)
    return entries[0], max((float(v[0]), s) for s, v in leaving.items())[1]


def _as_state(x) -> State:
    return x[0], x[1]


def _with_json(column: int, kinds: list[tuple[str, pa.DataType]], f):
    """Rows with f (of the JSON values in the columns from `column` on) as JSON in their place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches):
            given = zip(*([None if x is None else json.loads(x) for x in c.to_pylist()] for c in batch.columns[column:]), strict=True)
            told = [f(*x) for x in given]
            yield pa.RecordBatch.from_arrays([*batch.columns[:column], *(pa.array([json.dumps(x[i]) for x in told], t) for i, (_, t) in enumerate(kinds))], [*batch.schema.names[:column], *(k for k, _ in kinds)])

    return run


def _pair_states(left, right, state):
    """JSON values of two neighbours (the right one may be missing) and the states around both -> the states around each."""
    if right is None:
        return state, None
    start, stop = map(_as_state, state)
    middle = middle_state(left, right, start, stop)
    return (start, middle), (middle, stop)


def border_states(matrices: DataFrame) -> DataFrame:
    """(row, no, state) of matrices (row, no, n: the chunks of the row, matrix): the (entering, leaving) states of each chunk on the best path through its text.

    A parallel scan: neighbours are multiplied in pairs, then the products, until a text is one matrix (a round per doubling, for all texts at once); its ends are chosen; then each
    product hands its states down to its two halves. No more than two matrices ever meet in one place, however long a text is.
    """
    levels, at, span = [], matrices, 1
    pair = lambda df: df.groupBy("row", F.shiftright("no", 1).alias("no"), "n").agg(F.max(F.when(F.col("no") % 2 == 0, F.col("matrix"))).alias("left"), F.max(F.when(F.col("no") % 2 == 1, F.col("matrix"))).alias("right"))
    text = [("matrix", pa.string())]
    while True:
        levels.append((span, at))
        more = at.where(F.col("n") > span)
        if more.isEmpty():
            break
        span *= 2
        multiplied = pair(more).mapInArrow(_with_json(3, text, lambda a, b: (a if b is None else product(a, b),)), "row long, no int, n int, matrix string")
        at = materialise(multiplied)
    ends = lambda df: df.mapInArrow(_with_json(3, [("state", pa.string())], lambda m: (best_ends(m),)), "row long, no int, n int, state string").select("row", "no", "state")
    states = None
    for k in range(len(levels) - 1, -1, -1):
        span, at = levels[k]
        done = ends(at.where((F.col("n") <= span) & (F.col("n") > span // 2)))  # whole texts at this level
        if states is not None:
            handed = pair(at.where(F.col("n") > span)).join(states, ["row", "no"]).select("row", "no", "left", "right", "state")
            handed = handed.mapInArrow(_with_json(2, [("a", pa.string()), ("b", pa.string())], _pair_states), "row long, no int, a string, b string")
            halves = F.explode(F.array(F.struct((F.col("no") * 2).alias("no"), F.col("a").alias("state")), F.struct((F.col("no") * 2 + 1).alias("no"), F.col("b").alias("state")))).alias("x")
            done = done.unionByName(handed.select("row", halves).select("row", "x.no", "x.state").where("state <> 'null'"))
        states = materialise(done)
    return states


def _trace_chunks(path: str, walk_all: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        model = encoder.model
        for batch in small_slices(batches):
            packed = []
            for x in batch.to_pylist():
                (p, s), (q, t) = json.loads(x["state"])
                packed.append(chunk_ids(model, encoder, x["text"], (p + x["a"], s), (q + x["b"], t), x["a"], x["b"], walk_all))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("no"), _id_lists(packed)], ["row", "no", "ids"])

    return run


def encode(df: DataFrame, id_col: str, text_col: str, path: str = MODEL, chunk: int = CHUNK, walk_all: bool = False) -> DataFrame:
    """(id, ids): the model's token ids of each row's whole text, one row per row of df; an empty array for null and empty texts.

    Texts of up to two chunks are one chunk, solved segment by segment (no piece crosses a segment's border, so its
    matrix is one number). Longer ones are cut, and their chunks are spread over tasks three times: for their matrices, for
    tracing, and to be joined in order; of a text no more than two small matrices meet in one task (border_states). walk_all takes all steps of a chunk
    into its matrix and traces all of them back, instead of solving what lies between two borders segment by segment: the same ids, more slowly. path is a file that
    every worker can read. Repeated rows and null ids stay.
    """
    small_batches(df.sparkSession)
    src = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    long = F.length("text") > 2 * chunk
    short = src.where(~long).mapInArrow(_encode_small(path), f"id {kind}, ids array<int>")
    giants = materialise(src.where(long).withColumn("row", F.monotonically_increasing_id()))
    chunks = materialise(giants.select("row", "text").mapInArrow(_cut(path, chunk), "row long, no int, n int, text string, a int, b int, last boolean"))
    dealt = chunks.repartition("row", "no")
    states = border_states(materialise(dealt.mapInArrow(_matrices(path, walk_all), "row long, no int, n int, matrix string")))
    traced = chunks.join(states, ["row", "no"]).mapInArrow(_trace_chunks(path, walk_all), "row long, no int, ids array<int>")
    whole = traced.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("no", "ids"))).alias("parts"))
    whole = whole.select("row", F.flatten(F.transform("parts", lambda x: x["ids"])).alias("ids"))
    return short.unionByName(giants.select("row", "id").join(whole, "row").select("id", "ids"))


def decode(df: DataFrame, id_col: str, ids_col: str, path: str = MODEL) -> DataFrame:
    """(id, text) from token ids; '' for null and empty arrays. Bytes that aren't UTF-8 become U+FFFD; a null id in the array is skipped."""
    src = df.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder_of(path).model
        for batch in small_slices(batches):
            texts = model.decode_all(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, text string")


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, and the ids decoded again: doc_id, n_tokens, token_ids, decoded_chars, decoded_sha256."""
    found = encode(table(spark, sf_dir, "documents"), "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder_of(MODEL).model
        for batch in small_slices(batches):
            ids = batch.column(1)
            texts = model.decode_all(ids)
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.fill_null(pc.list_value_length(ids), 0).cast(pa.int64()), ids, pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts])], ["doc_id", "n_tokens", "token_ids", "decoded_chars", "decoded_sha256"])

    return found.mapInArrow(run, f"doc_id {found.schema['id'].dataType.simpleString()}, n_tokens long, token_ids array<int>, decoded_chars long, decoded_sha256 string")
