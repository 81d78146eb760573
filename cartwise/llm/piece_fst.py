"""SentencePiece encoding and decoding as a transducer.

The machine for a text is the composition of

* the normaliser: a blank in front, blanks become U+2581;
* the pieces: an arc for each piece of the vocabulary;
* byte fallback: a character without a piece becomes its UTF-8 byte pieces;
* the merge order: an acceptor of pairs of neighbouring pieces, which refuses
  a pair that the merges would not leave side by side.

A merge vocabulary leaves exactly one admitted path to each position, so there
is no weight to minimise: whatever the arcs weighed, the shortest path over
(min, +) would be that one, which is the library's encoding.  A depth-first
search, longest arcs first, finds it.  Runs
of U+2581, whose pieces all have one score, are a sub-machine of their own:
an arc for a run's length, with the output of the leftmost merges.

No piece goes on after a word's end, so the path is the concatenation of the
words' paths, and these are remembered (a bounded number) by each worker.
"""

from __future__ import annotations

from array import array
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import arrow_bound, ship_package, slices_by_bytes
from .token_count import TOKENIZER, tokenizer_path

SPACE = "▁"
SLICE_BYTES = 1 << 20
REMEMBERED_WORDS = 700_000
REMEMBERED_SEGMENTS = 500_000
REMEMBERED_PAIRS = 2_000_000
INF = float("inf")


class Memory:
    """A bounded memory of two generations: when the young one is full it
    replaces the old one, and what is asked for again is kept."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most // 2, {}, {}

    def get(self, key):
        got = self.young.get(key)
        if got is None:
            got = self.old.get(key)
            if got is not None:
                self.put(key, got)
        return got

    def put(self, key, value) -> None:
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        self.young[key] = value


class PieceTransducer:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb
        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, trained = model.normalizer_spec, model.trainer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or \
                not norm.add_dummy_prefix or trained.treat_whitespace_as_suffix or \
                trained.model_type != pb.TrainerSpec.BPE or not trained.byte_fallback:
            raise ValueError("only merge models with identity normaliser, prefix blank "
                             "and byte fallback are compiled")
        kinds = pb.ModelProto.SentencePiece
        self.rank: dict[str, tuple] = {}      # smaller merges first
        self.ids: dict[str, int] = {}
        self.out: list[bytes] = []
        self.byte_id = [0] * 256
        for i, p in enumerate(model.pieces):
            if p.type == kinds.BYTE:
                value = int(p.piece[3:5], 16)
                self.byte_id[value] = i
                self.out.append(bytes([value]))
            elif p.type == kinds.NORMAL:
                if SPACE in p.piece.lstrip(SPACE):
                    raise ValueError(f"piece {p.piece!r} goes on after a word's end")
                self.ids[p.piece], self.rank[p.piece] = i, -p.score
                self.out.append(p.piece.encode())
            elif p.type == kinds.UNKNOWN:
                self.out.append(" ⁇ ".encode())
            elif p.type == kinds.CONTROL:
                self.out.append(b"")
            else:
                raise ValueError(f"piece {p.piece!r} is of a kind that isn't compiled")
        # arcs by prefix: a string is in `arcs` if a piece begins with it;
        # its value is the piece's id, or -1
        self.arcs: dict[str, int] = {}
        self.piece: dict[int, str] = {}
        for p, i in self.ids.items():
            if len(p) > 1 and (set(p) == {SPACE} or self.merged(p) != [p]):
                continue          # never the result of the merges of a word
            self.piece[i] = p
            for k in range(1, len(p)):
                self.arcs.setdefault(p[:k], -1)
            self.arcs[p] = i
        self.pairs: dict[int, bool] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        self.joint = {p[k:k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.words, self.segments = Memory(REMEMBERED_WORDS), Memory(REMEMBERED_SEGMENTS)

    def merged(self, s: str) -> list[str]:
        """The merges themselves: best score first, then leftmost."""
        parts = list(s)
        while True:
            best = min(((self.rank[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:]))
                        if a + b in self.rank), default=None)
            if best is None:
                return parts
            k = best[1]
            parts[k:k + 2] = [parts[k] + parts[k + 1]]

    def edge(self, piece: int, right: bool) -> list[tuple[str, float]]:
        """What stands at one edge of a piece while it is merged, from a
        character to the piece, each with the rank of the merge that ends it."""
        known = self.edges[right].get(piece)
        if known is None:
            s = self.piece[piece]
            parts, seen = list(s), [s[-1] if right else s[0]]
            ranks = []
            while len(parts) > 1:
                rank, k = min((self.rank[a + b], k) for k, (a, b)
                              in enumerate(zip(parts, parts[1:])) if a + b in self.rank)
                parts[k:k + 2] = [parts[k] + parts[k + 1]]
                now = parts[-1] if right else parts[0]
                if now != seen[-1]:
                    seen.append(now)
                    ranks.append(rank)
            known = self.edges[right][piece] = list(zip(seen, [*ranks, INF]))
        return known

    def neighbours(self, a: int, b: int) -> bool:
        """Whether the merges leave pieces a and b side by side: none that
        crosses their border comes before those at its two sides."""
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= REMEMBERED_PAIRS:
                self.pairs.clear()
            left, right = iter(self.edge(a, True)), iter(self.edge(b, False))
            (x, until_x), (y, until_y) = next(left), next(right)
            while True:
                across = self.rank.get(x + y, INF)
                if across < until_x and across <= until_y:
                    known = False
                    break
                if until_x == until_y == INF:
                    known = True
                    break
                if until_x <= until_y:
                    x, until_x = next(left)
                else:
                    y, until_y = next(right)
            self.pairs[key] = known
        return known

    def shortest_path(self, s: str) -> list[int]:
        """Ids of the shortest path over a word without unknown characters.

        Every position has one admitted path, so the first one found
        is its shortest; arcs are tried longest first, and the search ends at
        the last position.
        """
        n = len(s)
        arcs, pairs = self.arcs, self.pairs
        whole = arcs.get(s, -1)
        if whole >= 0:                      # a piece that its own merges make
            return [whole]
        reached = [False] * (n + 1)
        path, open_arcs = [-1], []
        at = 0
        while True:
            out = []
            for j in range(at + 1, n + 1):
                p = arcs.get(s[at:j])
                if p is None:
                    break
                if p >= 0 and not reached[j]:
                    out.append((j, p))
            open_arcs.append(out)
            before = path[-1]
            while True:
                while not open_arcs[-1]:    # no way on from here
                    open_arcs.pop()
                    path.pop()
                    before = path[-1]
                at, p = open_arcs[-1].pop()
                if reached[at]:
                    continue
                if before < 0:
                    break
                side = pairs.get(before << 32 | p)
                if side or side is None and self.neighbours(before, p):
                    break
            reached[at] = True
            path.append(p)
            if at == n:
                return path[1:]

    def segment(self, s: str) -> tuple[int, ...]:
        """Ids of a stretch whose characters all may merge with the next."""
        ids = self.segments.get(s)
        if ids is None:
            if s not in self.ids and len(s) == 1:
                ids = tuple(self.byte_id[x] for x in s.encode("utf-8", "replace"))
            else:
                ids = tuple(self.shortest_path(s))
            if len(s) < 64:
                self.segments.put(s, ids)
        return ids

    @lru_cache(maxsize=4096)  # noqa: B019  the transducer lives as long as its worker
    def run(self, n: int) -> tuple[int, ...]:
        """The path over n blanks: merges of equal score, leftmost first."""
        parts, at = [1] * n, 0
        sizes = {len(p) for p in self.ids if set(p) == {SPACE}}
        while at < len(parts) - 1:
            # all merges have one score: the leftmost pair that has a piece goes
            # first, and pairs left of it stay without one until it changes
            if parts[at] + parts[at + 1] in sizes:
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
                at = max(0, at - 1)
            else:
                at += 1
        return tuple(self.ids[SPACE * p] for p in parts)

    def word(self, w: str) -> tuple[int, ...]:
        """Ids of a run of blanks, the prefix one among them, and a word."""
        body = w.lstrip(SPACE)
        if not body:
            return self.run(len(w))
        blanks = len(w) - len(body)
        known, out, start = self.ids, [], 0
        s = SPACE + body
        if blanks == 1 and body.isascii() and body.isalpha():
            return tuple(self.shortest_path(s))     # no character to look out for
        joint = self.joint
        for k in range(1, len(s)):
            # no piece holds these two side by side: the path is cut here
            if s[k - 1:k + 1] not in joint:
                out += self.segment(s[start:k])
                start = k
        out += self.segment(s[start:])
        if blanks == 1:
            return tuple(out)
        if out[0] == known[SPACE]:      # the last blank stays one of the run
            return (*self.run(blanks), *out[1:])
        return (*self.run(blanks - 1), *out)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text; null or empty has none."""
        return memoryview(self.packed(text)).cast("i").tolist()

    def packed(self, text: str | None) -> bytes:
        """Ids of a whole text as 32-bit numbers."""
        if not text:
            return b""
        words = text.replace(" ", SPACE).split(SPACE)
        if "" in words:       # neighbouring blanks: a word with all blanks before it
            joined, blanks = [], 0
            for w in words:
                if w:
                    joined.append(SPACE * blanks + w if blanks else w)
                    blanks = 0
                else:
                    blanks += 1
            if blanks:        # blanks at the end
                joined.append(SPACE * blanks)
            words = joined
        memory = self.words
        young = memory.young
        out = []
        for w in words:
            ids = young.get(w)
            if ids is None:
                ids = memory.get(w)
                young = memory.young
            if ids is None:
                # the key leaves out the blank that every word has before it,
                # save for blanks alone, which have no word
                ids = array("i", self.word(SPACE + w if w.strip(SPACE) else w)).tobytes()
                if len(w) < 64:
                    memory.put(w, ids)
                    young = memory.young
            out.append(ids)
        return b"".join(out)

    def decode(self, ids) -> str:
        """The text of ids; bytes that aren't UTF-8 become U+FFFD."""
        raw = b"".join(map(self.out.__getitem__, ids))
        text = raw.decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def transducer(name: str = TOKENIZER) -> PieceTransducer:
    return PieceTransducer(tokenizer_path(name))


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 model: str = TOKENIZER) -> DataFrame:
    """One row per input row: doc_id, ids, n_tokens, same (the ids decode to
    the text, with U+2581 read as a blank).

    A null or empty text has no ids and decodes to the empty text.  Rows keep
    their null or repeated ids; other columns are not read; no shuffle.
    """
    ship_package(df.sparkSession)
    arrow_bound(df.sparkSession)
    narrow = df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"))
    schema = T.StructType([narrow.schema["doc_id"],
                           T.StructField("ids", T.ArrayType(T.IntegerType())),
                           T.StructField("n_tokens", T.LongType()),
                           T.StructField("same", T.BooleanType())])

    def encode(batches):
        import numpy as np
        import pyarrow as pa

        t = transducer(model)
        for b in slices_by_bytes(batches, 1, SLICE_BYTES):
            texts = b.column(1).to_pylist()
            ids = [t.packed(x) for x in texts]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int64) // 4
            flat = np.frombuffer(b"".join(ids), np.int32)
            same = [t.decode(memoryview(i).cast("i")) == (x or "").replace(SPACE, " ")
                    for i, x in zip(ids, texts)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()),
                                                       pa.array(flat)),
                 pa.array(np.diff(ends)), pa.array(same, pa.bool_())],
                names=["doc_id", "ids", "n_tokens", "same"])

    return narrow.mapInArrow(encode, schema)


def decode_ids(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids",
               model: str = TOKENIZER) -> DataFrame:
    """One row per input row: doc_id, text of its ids.  Null ids give null."""
    ship_package(df.sparkSession)
    arrow_bound(df.sparkSession)
    narrow = df.select(df[id_col].alias("doc_id"), df[ids_col].alias("ids"))
    schema = T.StructType([narrow.schema["doc_id"], T.StructField("text", T.StringType())])

    def decode(batches):
        import pyarrow as pa

        t = transducer(model)
        for b in batches:
            texts = [None if i is None else t.decode(i) for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())],
                                             names=["doc_id", "text"])

    return narrow.mapInArrow(decode, schema)
